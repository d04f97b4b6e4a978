"""A body's axes, bends, frames, crossings and placements from points with uncertainty, as column expressions.

A point is a struct x, y, z, sigma; it is null where it may not be used.
Uncertainties of points add up, as they needn't be independent. A result whose
uncertainty is beyond its limit is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.geometry import cross, dot, length, minus, scaled, vector, wrap_angle

# The shortest length, the least sine between two axes, the most
# angular uncertainty (radians), the multiple of an uncertainty that proves
# something, and the bends (radians) of extended and of flexed fingers.
SHORTEST = 1e-8
LEAST_SINE = 0.1
MOST_ANGLE = 0.25
MULTIPLE = 3.0
EXTENDED = 0.35
FLEXED = 1.0


def bound(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def point(x: Column, y: Column, z: Column, sigma: Column, usable: Column) -> Column:
    return F.when(usable, F.struct(x.alias("x"), y.alias("y"), z.alias("z"), sigma.alias("sigma")))


def total_sigma(*points: Column) -> Column:
    return reduce(lambda total, p: total + p["sigma"], points[1:], points[0]["sigma"])


def middle(a: Column, b: Column) -> Column:
    return vector(*((a[k] + b[k]) / 2 for k in "xyz"))


def long_enough(size: Column) -> Column:
    return F.when(size > SHORTEST, size)


def axis(a: Column, b: Column) -> Column:
    """Unit vector from a to b, with sigma in radians."""

    def told(s: Column) -> Column:
        size = long_enough(length(s["d"]))
        return F.when(s["sigma"] / size <= MOST_ANGLE, F.struct(*((s["d"][k] / size).alias(k) for k in "xyz"), (s["sigma"] / size).alias("sigma")))

    return bound(F.struct(minus(b, a).alias("d"), total_sigma(a, b).alias("sigma")), told)


def bend(a: Column, joint: Column, b: Column) -> Column:
    """The angle by which a chain turns at its joint, 0 where it is straight, with its sigma."""

    def told(s: Column) -> Column:
        first, second = long_enough(length(s["u"])), long_enough(length(s["v"]))
        cosine = dot(s["u"], s["v"]) / (first * second)
        sigma = 2 * s["sigma"] / F.when(first.isNotNull() & second.isNotNull(), F.least(first, second))
        return F.when(sigma <= MOST_ANGLE, F.struct(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("angle"), sigma.alias("sigma")))

    return bound(F.struct(minus(joint, a).alias("u"), minus(b, joint).alias("v"), total_sigma(a, joint, b).alias("sigma")), told)


def axes(first: Column, hint: Column, sigma: Column) -> Column:
    """Right-handed unit axes x, y, z: x along the first vector, y towards the hint; with sigma in radians."""

    def units(s: Column) -> Column:
        one, two = long_enough(length(s["a"])), long_enough(length(s["b"]))
        return F.struct(scaled(s["a"], 1 / one).alias("x"), scaled(s["b"], 1 / two).alias("h"), F.when(one.isNotNull() & two.isNotNull(), F.least(one, two)).alias("size"), s["sigma"].alias("sigma"))

    def normal(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), cross(s["x"], s["h"]).alias("z"), s["size"].alias("size"), s["sigma"].alias("sigma"))

    def told(s: Column) -> Column:
        sine = F.when(length(s["z"]) >= LEAST_SINE, length(s["z"]))
        off = 2 * s["sigma"] / (s["size"] * sine)
        return F.when(off <= MOST_ANGLE, F.struct(s["x"].alias("x"), scaled(cross(s["z"], s["x"]), 1 / sine).alias("y"), scaled(s["z"], 1 / sine).alias("z"), off.alias("sigma")))

    return bound(bound(bound(F.struct(first.alias("a"), hint.alias("b"), sigma.alias("sigma")), units), normal), told)


def body_axes(left_hip: Column, right_hip: Column, left_shoulder: Column, right_shoulder: Column) -> Column:
    """x to the body's right, y to its front, z up its torso."""
    across = minus(right_hip, left_hip)
    up = minus(middle(left_shoulder, right_shoulder), middle(left_hip, right_hip))

    def told(s: Column) -> Column:
        wide, high = long_enough(length(s["across"])), long_enough(length(s["up"]))
        front = cross(s["up"], scaled(s["across"], 1 / wide))
        return F.when(length(front) / high >= LEAST_SINE, axes(s["across"], front, s["sigma"]))

    return bound(F.struct(across.alias("across"), up.alias("up"), total_sigma(left_hip, right_hip, left_shoulder, right_shoulder).alias("sigma")), told)


def hand_axes(wrist: Column, index: Column, pinky: Column) -> Column:
    """x across the palm from the little finger, y towards the fingers."""
    return axes(minus(index, pinky), minus(middle(index, pinky), wrist), total_sigma(wrist, index, pinky))


def foot_axes(heel: Column, toe: Column, outer: Column, is_left: Column) -> Column:
    """x from the heel to the toes, y to the body's right: away from a left foot's outer side, to a right one's."""
    return axes(minus(toe, heel), scaled(minus(outer, toe), F.when(is_left, -1.0).otherwise(1.0)), total_sigma(heel, toe, outer))


def head_axes(left_ear: Column, right_ear: Column, nose: Column) -> Column:
    return axes(minus(right_ear, left_ear), minus(nose, middle(left_ear, right_ear)), total_sigma(left_ear, right_ear, nose))


def within(frame: Column, v: Column) -> Column:
    """A vector's parts along a frame's axes."""
    return vector(*(dot(frame[k], v) for k in "xyz"))


def finger_state(bends: Column, multiple: float = MULTIPLE) -> Column:
    """extended or flexed if all of a finger's bends prove it, else indeterminate; multiple sigmas are held against a limit."""
    known = F.forall(bends, lambda b: b.isNotNull())
    straight = F.forall(bends, lambda b: b["angle"] + multiple * b["sigma"] <= EXTENDED)
    closed = F.forall(bends, lambda b: b["angle"] - multiple * b["sigma"] >= FLEXED)
    return F.when(known & straight, "extended").when(known & closed, "flexed").otherwise("indeterminate")


def hand_state(fingers: Column) -> Column:
    """open or fist if all fingers are extended or all flexed."""
    return F.when(F.forall(fingers, lambda f: f == "extended"), "open").when(F.forall(fingers, lambda f: f == "flexed"), "fist").otherwise("indeterminate")


def crossing(frame: Column, left_elbow: Column, left_wrist: Column, right_elbow: Column, right_wrist: Column) -> Column:
    """Whether forearms cross in the plane of a body's right and up axes (crossed, not_crossed, unknown), and which is in front."""
    joints = {"a": left_elbow, "b": left_wrist, "c": right_elbow, "d": right_wrist}
    given = F.struct(frame.alias("frame"), *(p.alias(n) for n, p in joints.items()), total_sigma(*joints.values()).alias("sigma"))

    def turned(s: Column) -> Column:
        return F.struct(*(within(s["frame"], s[n]).alias(n) for n in joints), s["sigma"].alias("sigma"), s["frame"]["sigma"].alias("angle"))

    def sides(s: Column) -> Column:
        u, v, w = minus(s["b"], s["a"]), minus(s["d"], s["c"]), minus(s["c"], s["a"])
        sigma = s["sigma"] + F.greatest(length(u), length(v), length(w)) * s["angle"]
        return F.struct(s["a"]["y"].alias("left"), s["c"]["y"].alias("right"), u.alias("u"), v.alias("v"), w.alias("w"), sigma.alias("sigma"))

    def solved(s: Column) -> Column:
        u, v, w = s["u"], s["v"], s["w"]
        det = v["x"] * u["z"] - u["x"] * v["z"]
        one, two = long_enough(length(u, "xz")), long_enough(length(v, "xz"))
        sine = F.abs(det) / (one * two)
        clear = sine >= LEAST_SINE
        apart = F.when(clear, det)
        error = MULTIPLE * s["sigma"] / (F.least(one, two) * F.when(clear, sine))
        t, q = (v["x"] * w["z"] - w["x"] * v["z"]) / apart, (u["x"] * w["z"] - u["z"] * w["x"]) / apart
        return F.struct(s["left"].alias("left"), s["right"].alias("right"), u["y"].alias("uy"), v["y"].alias("vy"), s["sigma"].alias("sigma"), error.alias("error"), t.alias("t"), q.alias("q"))

    def told(s: Column) -> Column:
        t, q, error = s["t"], s["q"], s["error"]
        outside = (F.least(t, q) < -error) | (F.greatest(t, q) > 1 + error)
        inside = (F.least(t, q) > error) & (F.greatest(t, q) < 1 - error)
        depth = (s["left"] + t * s["uy"]) - (s["right"] + q * s["vy"])
        margin = MULTIPLE * (s["sigma"] + error * (F.abs(s["uy"]) + F.abs(s["vy"]))) + SHORTEST
        value = F.when(outside, "not_crossed").when(inside, "crossed").otherwise("unknown")
        front = F.when(~outside & inside & (F.abs(depth) > margin), F.when(depth > 0, "left_forearm").otherwise("right_forearm"))
        return F.struct(value.alias("value"), front.alias("front"))

    return bound(bound(bound(bound(given, turned), sides), solved), told)


def placement(first: dict[str, Column], second: dict[str, Column], body: Column, body_sigma: Column) -> list[Column]:
    """How a second placement (x, y, yaw, sigma) lies in the axes of a first: lengths, shares of a body's length, angles.

    Shares are null unless the body's length is above its uncertainty; the angle towards the second is null where both coincide.
    """
    dx, dy = second["x"] - first["x"], second["y"] - first["y"]
    c, s = F.cos(first["yaw"]), F.sin(first["yaw"])
    lengths = {"distance": F.sqrt(dx * dx + dy * dy), "along": dx * c + dy * s, "across": dy * c - dx * s}
    sigma = first["sigma"] + second["sigma"]
    known = (body > 0) & (body_sigma < body)
    shares = {f"{name}_ratio": F.when(known, value / body) for name, value in lengths.items()}
    off = F.when(known, (sigma + F.abs(lengths["distance"] / body) * body_sigma) / (body - body_sigma))
    towards = F.when(lengths["distance"] > 1e-12, wrap_angle(F.atan2(dy, dx) - first["yaw"]))
    angles = {"alignment": towards, "foot_angle": wrap_angle(second["yaw"] - first["yaw"])}
    return [c.alias(name) for name, c in (lengths | {"sigma": sigma} | shares | {"ratio_sigma": off} | angles).items()]
