"""Evidence states beside values: observed, interpolated, inferred or unknown.

A quality is a struct of state, score, uncertainty and source_ids. Unknown
never becomes a value, interpolated evidence taints what is derived from it,
and a value without sources supports nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names of the evidence states.
OBSERVED, INTERPOLATED, INFERRED, UNKNOWN = "observed", "interpolated", "inferred", "unknown"


def quality(state: Column, score: Column, uncertainty: Column, sources: Column) -> Column:
    """A quality; an unknown one has no score."""
    return F.struct(state.alias("state"), F.when(state != UNKNOWN, score).alias("score"), uncertainty.alias("uncertainty"), sources.alias("source_ids"))


def usable(q: Column, limit: float) -> Column:
    """Known, with sources, and certain enough; interpolated evidence passes."""
    return (q["state"] != UNKNOWN) & (F.size(q["source_ids"]) > 0) & F.coalesce(q["uncertainty"] <= limit, F.lit(False))


def strictly_usable(q: Column, limit: float) -> Column:
    return usable(q, limit) & (q["state"] != INTERPOLATED)


def weak(q: Column, least: float) -> Column:
    """Unknown, or with a score below the least; no score passes."""
    return (q["state"] == UNKNOWN) | F.coalesce(q["score"] < least, F.lit(False))


def combined(q: Column, uncertainty: Column) -> Column:
    """An aggregate: the quality of what all rows' evidence was put together to."""
    state = F.when(F.bool_or(q["state"] == UNKNOWN), UNKNOWN).when(F.bool_or(q["state"] == INTERPOLATED), INTERPOLATED).otherwise(INFERRED)
    return F.struct(state.alias("state"), uncertainty.alias("uncertainty"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(q["source_ids"])))).alias("source_ids"))


def violations(value: Column, q: Column) -> Column:
    """Names of the rules that a value and its quality break; empty if none."""
    rules = {
        "value_without_evidence": value.isNotNull() & (q["state"] == UNKNOWN),
        "evidence_without_value": value.isNull() & (q["state"] != UNKNOWN),
        "score_of_unknown": (q["state"] == UNKNOWN) & q["score"].isNotNull(),
        "score_out_of_range": ~q["score"].between(0, 1),
        "state_name": ~q["state"].isin(OBSERVED, INTERPOLATED, INFERRED, UNKNOWN),
        "value_not_finite": F.isnan(value) | (F.abs(value) == float("inf")),
    }
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
