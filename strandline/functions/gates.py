"""Which landmarks, views and frames may be used, and what time they have.

Gates are columns that are never null, so that they can be filtered by and
counted; reasons accumulate instead of stopping at the first one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.evidence import INTERPOLATED, OBSERVED, strictly_usable, weak


def landmark_usable(selected: Column, x: Column, y: Column, state: Column, visibility: Column, region: Column) -> Column:
    """The point is observed, not known to be invisible, and of the selected subject; no selection, visibility or verdict on its region lets it pass."""
    seen = x.isNotNull() & y.isNotNull() & (state == OBSERVED)
    passes = [F.coalesce(gate, F.lit(True)) for gate in (selected, visibility > 0, region)]
    return F.coalesce(seen, F.lit(False)) & passes[0] & passes[1] & passes[2]


def supported(points: Column, usable) -> Column:
    """Every point of an array passes, and there is one."""
    return (F.size(points) > 0) & F.forall(points, lambda p: F.coalesce(usable(p), F.lit(False)))


def reject_reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order; a rule that can't be told doesn't hold."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))


def view_reasons(joined: Column, x: Column, y: Column, point: Column, visibility: Column, timing: Column, calibration: Column, least: float) -> Column:
    """All reasons against a view of a landmark: its time join, source, synchronisation and calibration.

    point, timing and calibration are qualities; calibration is null where the source has none of its own. No score and
    no visibility lets a view pass.
    """
    rules = {
        "unknown_time_join": ~F.coalesce(joined, F.lit(False)),
        "unsupported_source_landmark": x.isNull() | y.isNull() | ~point["state"].isin(OBSERVED, INTERPOLATED),
        "insufficient_source_quality": weak(point, least) | F.coalesce(visibility <= 0, F.lit(False)),
        "insufficient_synchronization_quality": weak(timing, least),
        "missing_or_mismatched_calibration": calibration.isNull(),
        "insufficient_calibration_quality": calibration.isNotNull() & weak(calibration, least),
    }
    return reject_reasons(rules)


#: Fixed values of the noise model: what a missing score counts as, and the least that a score counts as.
NO_SCORE, LEAST_SCORE = 0.5, 0.05


def view_sigma(pixels: float, point: Column, calibration_pixels: Column, calibration: Column, timing_seconds: Column, timing: Column, speed: float, span: Column) -> Column:
    """A view's noise in pixels, from scores and the errors of calibration and timing at a speed of the image.

    span is the time between the two frames of a bracket, null for an exact frame.
    """
    by = lambda score: F.greatest(F.coalesce(score, F.lit(NO_SCORE)), F.lit(LEAST_SCORE))
    square = F.lit(pixels**2) / by(point) + calibration_pixels * calibration_pixels / by(calibration)
    square = square + (speed * timing_seconds) * (speed * timing_seconds) / by(timing)
    return F.sqrt(square + F.coalesce((speed * span / 2) * (speed * span / 2), F.lit(0.0)))


def effective_offset(manual: Column, auto: Column, correction: Column, is_reference: Column, retained: Column) -> Column:
    """Seconds, null if unknown: a manual offset stands; a source that isn't retained has none.

    The timing reference without an automatic offset is at 0; an automatic offset takes the correction.
    """
    found = F.when(auto.isNotNull(), auto + F.coalesce(correction, F.lit(0.0))).when(is_reference, F.lit(0.0))
    return F.coalesce(manual, F.when(retained, found))


def clock_consistent(source: Column, offset: Column, on_clock: Column, tolerance: float = 1e-9) -> Column:
    """Whether a stated time on the common clock is source + offset."""
    return F.coalesce(F.abs(source + offset - on_clock) <= tolerance, F.lit(False))


def rational_seconds(pts: Column, numerator: Column, denominator: Column) -> Column:
    """Presentation time in seconds from ticks of numerator / denominator; null where the denominator is 0."""
    return F.when(denominator != 0, pts.cast("double") * numerator / denominator)


def movement(rates: list[tuple[Column, Column, float, float]], multiple: float) -> Column:
    """moving, quiet or unknown, from (rate, its quality, enter, leave) of each derivative, with a margin of so many sigmas.

    Moving if any rate is at or above enter by its margin; quiet if all are at or below leave with it; unknown between.
    Evidence that is unknown, interpolated or less certain than leave / multiple proves neither.
    """
    moving, quiet = F.lit(False), F.lit(True)
    for rate, q, enter, leave in rates:
        known = F.coalesce(strictly_usable(q, leave / multiple) & rate.isNotNull(), F.lit(False))
        margin = multiple * q["uncertainty"]
        moving = moving | F.coalesce(known & (rate - margin >= enter), F.lit(False))
        quiet = quiet & F.coalesce(known & (rate + margin <= leave), F.lit(False))
    return F.when(moving, "moving").when(quiet, "quiet").otherwise("unknown")


#: Fixed names of the relations along a frame's axes right, front and up: positive, negative.
RELATIONS = {"right": ("right_of", "left_of"), "front": ("in_front_of", "behind"), "up": ("above", "below")}


def relations(subject: list[Column], other: list[Column], axes: list[list[Column]], sigma: Column, frame_sigma: Column, multiple: float = 2.0, shortest: float = 1e-6) -> list[Column]:
    """How subject lies to other along each axis (right, front, up) of a frame.

    What its margin doesn't prove is unknown, as is all without points or a frame: the margin is multiple times the
    points' sigma and the frame's (an angle) times their distance, and the shortest length.
    """
    delta = [a - b for a, b in zip(subject, other, strict=True)]
    far = F.sqrt(sum((d * d for d in delta), F.lit(0.0)))
    margin = multiple * (sigma + far * frame_sigma) + shortest
    along = [sum((a * d for a, d in zip(axis, delta, strict=True)), F.lit(0.0)) for axis in axes]
    return [F.when(F.abs(v) > margin, F.when(v > 0, above).otherwise(below)).otherwise("unknown") for v, (above, below) in zip(along, RELATIONS.values(), strict=True)]
