"""What feet do, from reconstructed landmarks: contacts, placements, pivots, and bouts of motion, by carried state.

Times are microseconds. Evidence that is unknown, not new, or uncertain proves
nothing: it ends what was going on instead of prolonging it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.carried import carried

#: Fixed names of states, regions and reasons.
CONTACT, FLIGHT, UNKNOWN = "contact", "no_contact", "unknown"
PARTS = ("heel", "forefoot", "outer")
NEAR_GROUND, ALL_RAISED, AMBIGUOUS = "ground_proximity_and_low_vertical_motion", "all_foot_landmarks_above_ground", "insufficient_or_ambiguous_foot_evidence"
NO_POINT, NO_MOTION, GAP, NOT_NEW, PENDING = "missing_or_unusable_landmark", "motion_unavailable", "temporal_gap", "no_new_native_evidence", "temporal_confirmation_pending"


@dataclass(frozen=True)
class ContactConfig:
    """Thresholds in units of the evidence, and times in microseconds; the default values are fixed."""

    enter_height: float = 0.025
    leave_height: float = 0.05
    enter_speed: float = 0.15
    leave_speed: float = 0.3
    contact: int = 80_000
    no_contact: int = 40_000
    max_gap: int = 150_000
    multiple: float = 2.0

    def __post_init__(self) -> None:
        if self.leave_height <= self.enter_height or self.leave_speed <= self.enter_speed:
            raise ValueError("leave thresholds must exceed enter thresholds")


def ground_height(x: Column, y: Column, z: Column, sigma: Column, rms: float, normal_sigma: float, length: Column, length_sigma: Column) -> tuple[Column, Column]:
    """Height over the ground in units of a length, and its uncertainty: the point's, the plane's residual and tilt, and the length's."""
    relative = F.coalesce(length_sigma, F.lit(0.0)) / length
    spread = sigma + F.lit(rms) + F.hypot(x, y) * math.sin(min(normal_sigma, math.pi / 2))
    return z / length, (spread / length + F.abs(z / length) * relative) / (1 - relative)


def _evidence(state: dict, time: int, points: tuple, config: ContactConfig) -> list[dict]:
    """Of each landmark its height, its speed against the last sample, and what is against it."""
    out = []
    for part, (height, sigma, sources) in zip(PARTS, points, strict=True):
        e = {"part": part, "height": height, "sigma": sigma, "speed": None, "speed_sigma": None, "sources": sources or [], "why": []}
        out.append(e)
        if height is None or sigma is None or not sources:
            e["height"] = e["sigma"] = None
            e["why"].append(NO_POINT)
            continue
        before = state["points"].get(part)
        if before is None:
            e["why"].append(NO_MOTION)
        elif time - state["time"] > config.max_gap:
            e["why"].append(GAP)
        elif not set(sources) - set(before[2]):
            e["why"].append(NOT_NEW)
        else:
            dt = (time - state["time"]) / 1e6
            e["speed"], e["speed_sigma"] = (height - before[0]) / dt, (sigma + before[1]) / dt
            e["sources"] = sorted({*sources, *before[2]})
    return out


def _candidate(evidence: list[dict], stable: str, config: ContactConfig) -> tuple[str, str | None, str]:
    near, raised = set(), set()
    for e in evidence:
        if e["height"] is None:
            continue
        margin = config.multiple * e["sigma"]
        if e["height"] + margin < -config.enter_height:  # deep below the ground: the geometry is inconsistent
            continue
        if e["height"] - margin > (config.enter_height if stable == FLIGHT else config.leave_height):
            raised.add(e["part"])
        high, fast = (config.leave_height, config.leave_speed) if stable == CONTACT else (config.enter_height, config.enter_speed)
        if abs(e["height"]) + margin <= high and e["speed"] is not None and abs(e["speed"]) + config.multiple * e["speed_sigma"] <= fast:
            near.add(e["part"])
    if near & {"heel", "forefoot"}:
        if near == set(PARTS):
            region = "flat"
        elif "heel" in near and {"forefoot", "outer"} <= raised:
            region = "heel"
        else:
            region = "forefoot" if {"forefoot", "outer"} <= near and "heel" in raised else None
        return CONTACT, region, NEAR_GROUND
    return (FLIGHT, None, ALL_RAISED) if len(raised) == 3 else (UNKNOWN, None, AMBIGUOUS)


def _contact_step(config: ContactConfig):
    def step(state: dict, emit, time: int, row_id: int, *values) -> None:
        if state["time"] is not None and time - state["time"] > config.max_gap:
            state |= {"stable": UNKNOWN, "pending": UNKNOWN, "window": []}
        points = tuple(zip(values[0::3], values[1::3], values[2::3], strict=True))
        evidence = _evidence(state, time, points, config)
        said, region, reason = _candidate(evidence, state["stable"], config)
        reasons = sorted({reason, *(w for e in evidence for w in e["why"])})
        now = [time, max((e["sigma"] for e in evidence if e["sigma"] is not None), default=None), sorted({s for e in evidence for s in e["sources"]})]
        window, bracket, told = [now], (None, None), said
        settled = said == state["stable"] or said == UNKNOWN
        if settled or any(NOT_NEW in e["why"] for e in evidence):
            told = said if settled else UNKNOWN
            state |= {"stable": UNKNOWN if said == UNKNOWN else state["stable"], "pending": UNKNOWN, "window": []}
        else:
            if state["pending"] != said:
                state |= {"pending": said, "window": [], "before": time if state["time"] is None else state["time"]}
            state["window"].append(now)
            window = list(state["window"])
            if time - window[0][0] >= (config.contact if said == CONTACT else config.no_contact):
                bracket = (state["before"], window[0][0])
                state |= {"stable": said, "pending": UNKNOWN, "window": []}
            else:
                told = UNKNOWN
                reasons.append(PENDING)
        sigma = max((w[1] for w in window if w[1] is not None), default=None)
        sources = sorted({s for w in window for s in w[2]})
        emit((row_id, time, told, region if told == CONTACT else None, said, reasons, sigma, sources, [w[0] for w in window], *bracket))
        known = {part: [e["height"], e["sigma"], p[2]] for part, e, p in zip(PARTS, evidence, points, strict=True) if e["height"] is not None}
        state |= {"time": time, "points": known}

    return step


def contacts(df: DataFrame, by: list[str], time: str, id_column: str, parts: dict[str, tuple[str, str, str]], config: ContactConfig | None = None, span: int = 10_000_000) -> DataFrame:
    """by, the id, time, state, region, candidate, reasons, sigma, source_ids, times and bracket of each sample of a foot.

    parts names the columns (height, its uncertainty, source ids) of heel, forefoot and outer; a point without all of them
    isn't usable. A contact needs the heel or the forefoot near the ground and slow, by their uncertainty and against new
    evidence, a flight all three raised; between the thresholds what holds goes on. A change holds once it has been said
    without a break over its dwell time; until then, and wherever nothing is proven, the state is unknown. A gap starts
    afresh. times are the samples that a change rests on, sigma and source_ids are of those; bracket_from and bracket_to
    enclose the moment of the change.
    """
    config = config or ContactConfig()
    columns = [id_column, *(c for part in PARTS for c in parts[part])]
    start = {"time": None, "points": {}, "stable": UNKNOWN, "pending": UNKNOWN, "window": [], "before": None}
    schema = f"{id_column} long, {time} long, state string, region string, candidate string, reasons array<string>, sigma double, source_ids array<string>, times array<long>, bracket_from long, bracket_to long"
    return carried(df, by, time, span, columns, start, _contact_step(config), schema)


@dataclass(frozen=True)
class PivotConfig:
    """Angles in radians, times in microseconds; the default values are fixed."""

    enter_speed: float = 0.25
    leave_speed: float = 0.1
    quiet: int = 80_000
    max_gap: int = 150_000
    min_excursion: float = 0.12
    multiple: float = 2.0
    half_turn: float = 0.05

    def __post_init__(self) -> None:
        if self.leave_speed >= self.enter_speed:
            raise ValueError("enter speed must exceed leave speed")


def _close_pivot(state: dict, emit, config: PivotConfig) -> None:
    """The turn up to its last motion, if it goes far enough beyond its uncertainty."""
    turn = state["turn"]
    state["turn"] = None
    if turn is not None:
        low, high, sigma, count = turn["kept"]
        if count >= 2 and high - low >= config.min_excursion + 2 * config.multiple * sigma:
            emit((turn["start"], turn["moved"], count, high - low, turn["total"], sigma))


def _pivot_step(config: PivotConfig):
    def step(state: dict, emit, time: int, yaw: float | None, sigma: float | None, supported: bool, sources: list | None) -> None:
        fresh = bool(sources) and all(set(s or []) - set(state["seen"]) for s in sources)
        usable = yaw is not None and fresh
        if not usable or (state["time"] is not None and time - state["time"] > config.max_gap):
            _close_pivot(state, emit, config)
            state |= {"time": None, "seen": []}
        if not usable:
            return
        state["seen"] = sorted({*state["seen"], *(x for s in sources for x in s)})
        sigma, supported, angle = sigma or 0.0, bool(supported), yaw
        last, state_before = state["time"], (state["yaw"], state["angle"], state["supported"], state["sigma"])
        state |= {"time": time, "yaw": yaw, "angle": angle, "supported": supported, "sigma": sigma}
        if last is None:
            return
        old, base, was, old_sigma = state_before
        delta = math.atan2(math.sin(yaw - old), math.cos(yaw - old))
        if abs(delta) >= math.pi - config.half_turn:  # either way round
            _close_pivot(state, emit, config)
            state["supported"] = False
            return
        angle = state["angle"] = base + delta
        if not (supported and was):
            _close_pivot(state, emit, config)
            return
        speed, turn = abs(delta) / ((time - last) / 1e6), state["turn"]
        if turn is None:
            if speed >= config.enter_speed:
                reach = [min(base, angle), max(base, angle), max(old_sigma, sigma), 2]
                state["turn"] = {"start": last, "moved": time, "first": base, "total": angle - base, "all": reach, "kept": reach}
            return
        low, high, most, count = turn["all"]
        turn["all"] = [min(low, angle), max(high, angle), max(most, sigma), count + 1]
        if speed >= config.leave_speed:
            turn |= {"moved": time, "kept": turn["all"], "total": angle - turn["first"]}
        elif time - turn["moved"] >= config.quiet:
            _close_pivot(state, emit, config)

    return step


def pivots(df: DataFrame, by: list[str], time: str, yaw: str, sigma: str, supported: str, sources: str, config: PivotConfig | None = None, span: int = 10_000_000) -> DataFrame:
    """by, start, end, n, excursion, turned and sigma of each turn of a supported foot.

    sources is an array of the source ids of each point of the axis: a sample counts only with new evidence for all of
    them since the last break, so that they are remembered until then. A turn begins with the sample before the first
    speed at or above enter, ends with the last at or above leave, once the foot was quiet for long enough or evidence,
    support or time break off, and counts if its excursion exceeds the least one by its uncertainty. A step near half a
    turn may be either way round and breaks off, too.
    """
    config = config or PivotConfig()
    start = {"time": None, "yaw": None, "angle": None, "supported": False, "sigma": 0.0, "seen": [], "turn": None}
    return carried(df, by, time, span, [yaw, sigma, supported, sources], start, _pivot_step(config), "start long, end long, n long, excursion double, turned double, sigma double", lambda state, emit: _close_pivot(state, emit, config))


@dataclass(frozen=True)
class BoutConfig:
    """Speeds a second, times in microseconds."""

    enter_speed: float
    leave_speed: float
    min_duration: int
    min_excursion: float
    max_gap: int
    multiple: float = 2.0

    def __post_init__(self) -> None:
        if self.leave_speed >= self.enter_speed:
            raise ValueError("enter speed must exceed leave speed")


def _bout_step(config: BoutConfig):
    def step(state: dict, emit, time: int, position: list | None, sigma: float | None, speed: float | None, speed_sigma: float | None) -> None:
        known = position is not None and None not in position
        if not known or (state["time"] is not None and time - state["time"] > config.max_gap):
            state |= {"quiet": None, "since": None, "bout": None}
        state["time"] = time if known else None
        if not known:
            return
        bout, sigma = state["bout"], sigma or 0.0
        if bout is not None:
            bout |= {"n": bout["n"] + 1, "far": max(bout["far"], math.dist(position, bout["at"])), "sigma": max(bout["sigma"], sigma)}
        elif state["quiet"] is not None:  # what a bout that starts at the quiet row would have by now
            q = state["quiet"]
            q |= {"n": q["n"] + 1, "far": max(q["far"], math.dist(position, q["at"])), "sigma": max(q["sigma"], sigma)}
        if speed is None:
            return
        error = config.multiple * (speed_sigma or 0.0)
        if speed + error <= config.leave_speed:
            state["since"] = time if state["since"] is None else state["since"]
            if time - state["since"] < config.min_duration:
                return
            if bout is not None and time - bout["start"] >= config.min_duration and bout["far"] > max(config.min_excursion, config.multiple * bout["sigma"]):
                emit((bout["start"], time, bout["n"], bout["far"], bout["sigma"]))
            state |= {"bout": None, "quiet": {"start": time, "at": position, "n": 1, "far": 0.0, "sigma": sigma}}
        else:
            state["since"] = None
            if bout is None and state["quiet"] is not None and speed - error >= config.enter_speed:
                state |= {"bout": state["quiet"], "quiet": None}

    return step


def motion_bouts(df: DataFrame, by: list[str], time: str, position: str, sigma: str, speed: str, speed_sigma: str, config: BoutConfig, span: int = 10_000_000) -> DataFrame:
    """by, start, end, n, excursion and sigma of bouts of motion between two quiet times.

    position is an array. A bout begins with the last quiet row before a speed that is above enter by its uncertainty, ends
    once speeds have been below leave by theirs for min_duration, and counts if it has lasted as long and has gone farther
    than min_excursion and its uncertainty. Rows without a position, and gaps, start afresh; rows without a speed count
    for the excursion alone.
    """
    start = {"time": None, "quiet": None, "since": None, "bout": None}
    return carried(df, by, time, span, [position, sigma, speed, speed_sigma], start, _bout_step(config), "start long, end long, n long, excursion double, sigma double")


@dataclass(frozen=True)
class PlacementConfig:
    """Distances in units of the evidence, angles in radians, times in microseconds; the default values are fixed."""

    enter_distance: float = 0.015
    leave_distance: float = 0.03
    enter_angle: float = 0.06
    leave_angle: float = 0.12
    stable: int = 120_000
    max_gap: int = 150_000
    multiple: float = 2.0

    def __post_init__(self) -> None:
        if self.leave_distance <= self.enter_distance or self.leave_angle <= self.enter_angle:
            raise ValueError("leave thresholds must exceed enter thresholds")


def _near(points: list, yaw: list, anchor: dict, distance: float, angle: float, multiple: float) -> bool:
    """Every point that both have is near by its uncertainty, and so is the angle: a slide can't hide in the middle of a foot."""
    there = {p[0]: p for p in anchor["points"]}
    for name, x, y, sigma in points:
        if name in there:
            _, u, v, other = there[name]
            if math.hypot(x - u, y - v) + multiple * (sigma + other) > distance:
                return False
    turn = math.atan2(math.sin(yaw[0] - anchor["yaw"][0]), math.cos(yaw[0] - anchor["yaw"][0]))
    return abs(turn) + multiple * (yaw[1] + anchor["yaw"][1]) <= angle


def _tell(group: dict | None, kind: str, emit) -> None:
    """A lone sample doesn't make a placement."""
    if group is not None and group["n"] > 1:
        stable = kind == "stable"
        emit((group["start"], group["end"], kind, group["n"], group["confirmed"] if stable else None, *(group["yaw"][:1] if stable else [None]), group["far"] if stable else None))


def _joined(a: dict | None, b: dict | None) -> dict | None:
    return a or b if a is None or b is None else a | {"end": b["end"], "n": a["n"] + b["n"]}


def _flush(state: dict, emit) -> None:
    _tell(state["placed"], "stable", emit)
    _tell(_joined(state["moving"], state["candidate"]), "moving", emit)
    state |= {"placed": None, "moving": None, "candidate": None, "seen": []}


def _placement_step(config: PlacementConfig):
    def step(state: dict, emit, time: int, contact: bool, points: list | None, yaw: float | None, yaw_sigma: float | None, sources: list | None) -> None:
        if state["time"] is not None and time - state["time"] > config.max_gap:
            _flush(state, emit)
        state["time"] = time
        if not contact or yaw is None or not points:
            _flush(state, emit)
            return
        if not sources or any(not set(s or []) - set(state["seen"]) for s in sources):
            _flush(state, emit)
            return
        state["seen"] = sorted({*state["seen"], *(x for s in sources for x in s)})
        here = [[p["name"], p["x"], p["y"], p["sigma"]] for p in points if None not in (p["x"], p["y"], p["sigma"])]
        facing, enter = [yaw, yaw_sigma or 0.0], (config.enter_distance, config.enter_angle, config.multiple)
        own = {"start": time, "end": time, "n": 1, "points": here, "yaw": facing, "far": max((p[3] for p in here), default=0.0), "confirmed": None}

        def grown(group: dict) -> dict:
            there = {p[0]: p for p in group["points"]}
            far = max((math.hypot(x - there[n][1], y - there[n][2]) + s for n, x, y, s in here if n in there), default=0.0)
            return group | {"end": time, "n": group["n"] + 1, "far": max(group["far"], far)}

        if state["placed"] is not None:
            if _near(here, facing, state["placed"], config.leave_distance, config.leave_angle, config.multiple):
                state["placed"] = grown(state["placed"])
                return
            _tell(state["placed"], "stable", emit)
            state["placed"] = None
        if state["candidate"] is not None and not _near(here, facing, state["candidate"], *enter):
            state |= {"moving": _joined(state["moving"], state["candidate"]), "candidate": None}
        if not _near(here, facing, own, *enter):  # too uncertain to be near itself
            state |= {"moving": _joined(_joined(state["moving"], state["candidate"]), own), "candidate": None}
            return
        state["candidate"] = own if state["candidate"] is None else grown(state["candidate"])
        if time - state["candidate"]["start"] >= config.stable:
            _tell(state["moving"], "moving", emit)
            state |= {"moving": None, "placed": state["candidate"] | {"confirmed": time}, "candidate": None}

    return step


def foot_placements(df: DataFrame, by: list[str], time: str, contact: str, points: str, yaw: str, yaw_sigma: str, sources: str, config: PlacementConfig | None = None, span: int = 10_000_000) -> DataFrame:
    """by, start, end, kind (stable or moving), n, confirmed, yaw and spread of the placements of a foot while it is in contact.

    points is an array of (name, x, y, sigma), sources as in pivots(). A sample opens a candidate with itself as the
    anchor; the candidate is stable once samples near the anchor span the dwell, and stays while samples are within the
    wider thresholds. Samples between are moving. Samples without contact, axis or new evidence, and gaps, end all; a
    placement of one sample isn't told. spread is the largest distance of a point from the anchor's, with its uncertainty.
    """
    config = config or PlacementConfig()
    start = {"time": None, "placed": None, "moving": None, "candidate": None, "seen": []}
    schema = "start long, end long, kind string, n long, confirmed long, yaw double, spread double"
    return carried(df, by, time, span, [contact, points, yaw, yaw_sigma, sources], start, _placement_step(config), schema, _flush)
