"""The contact latch of operators.machines as a stateful stream operator.

The state of a key is what the batch machine holds between two rows; rows of a
batch are taken in order of time, and rows older than the last one taken are
left out, as a later row has been decided upon already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "state string, pending string, since long, last long"


def latched(events: DataFrame, key: str, time: str, value: str, id_column: str, enter: float, leave: float, dwell_on: int, dwell_off: int, pause: int) -> DataFrame:
    """key, id, time, state (contact, flight, unknown) for each event; time in integral microseconds."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, pending, since, last = held.get if held.exists else ("unknown", None, None, None)
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        out = []
        for t, v, i in zip(rows[time].tolist(), rows[value].tolist(), rows[id_column].tolist(), strict=True):
            if last is not None and t < last:
                continue
            if last is None or t - last > pause or pd.isna(v):
                state, pending, since = "unknown", None, None
            last = t
            if not pd.isna(v):
                says = "contact" if v <= enter else "flight" if v > leave else state
                if says in (state, "unknown"):
                    pending, since = None, None
                else:
                    if pending != says:
                        pending, since = says, t
                    if t - since >= (dwell_on if says == "contact" else dwell_off):
                        state, pending, since = says, None, None
            out.append((name[0], i, t, state))
        held.update((state, pending, since, last))
        yield pd.DataFrame(out, columns=[key, id_column, time, "state"])

    kind = dict(events.dtypes)
    return events.select(key, time, value, id_column).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind[key]}, `{id_column}` {kind[id_column]}, `{time}` long, state string", STATE, "append", GroupStateTimeout.NoTimeout)
