"""Angles, quaternions, frames and cameras as column expressions.

Vectors are structs x, y, z of doubles; quaternions are structs w, x, y, z.
Everything stays inside Spark's generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    return F.struct(w.alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def wrap_angle(angle: Column) -> Column:
    """The same angle in (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def lerp(a: Column, b: Column, w: Column) -> Column:
    return a + (b - a) * w


def add(a: Column, b: Column) -> Column:
    return vector(*(a[k] + b[k] for k in "xyz"))


def minus(a: Column, b: Column) -> Column:
    return vector(*(a[k] - b[k] for k in "xyz"))


def scaled(a: Column, factor: Column) -> Column:
    return vector(*(a[k] * factor for k in "xyz"))


def dot(a: Column, b: Column, parts: str = "xyz") -> Column:
    return reduce(lambda total, k: total + a[k] * b[k], parts[1:], a[parts[0]] * b[parts[0]])


def cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a: Column, parts: str = "xyz") -> Column:
    return F.sqrt(dot(a, a, parts))


def distance(a: Column, b: Column) -> Column:
    return length(minus(a, b))


def unit(a: Column) -> Column:
    """a with length 1; null where it has none."""
    return F.when(length(a) > 0, scaled(a, 1 / length(a)))


def direction(a: Column, b: Column, uncertainty: Column, most: float) -> Column:
    """The unit vector from a to b; null unless uncertainty is within the share ``most`` of the distance."""
    return F.when(uncertainty <= distance(a, b) * most, unit(minus(b, a)))


def bend(a: Column, joint: Column, b: Column) -> Column:
    """The angle by which a chain turns at its joint, 0 where it is straight."""
    cosine = dot(unit(minus(joint, a)), unit(minus(b, joint)))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def frame(right: Column, up: Column, least_sine: float) -> Column:
    """Right-handed axes (right, front, up) from two directions; null where they are nearly parallel."""
    r, u = unit(right), unit(up)
    front = cross(u, r)
    f = unit(front)
    return F.when(length(front) >= least_sine, F.struct(r.alias("right"), f.alias("front"), cross(r, f).alias("up")))


def conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def compose(a: Column, b: Column) -> Column:
    """The rotation b, then a."""
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
    )


def rotated(q: Column, v: Column) -> Column:
    zero = F.lit(0.0)
    out = compose(compose(q, quaternion(zero, v["x"], v["y"], v["z"])), conjugate(q))
    return vector(out["x"], out["y"], out["z"])


def rotation_angle(q: Column) -> Column:
    """The angle of a rotation, from 0 to pi."""
    return 2 * F.atan2(length(q), F.abs(q["w"]))


def rotation_vector(q: Column) -> Column:
    """Axis times angle."""
    sign = F.when(q["w"] < 0, -1.0).otherwise(1.0)
    size = length(q)
    return vector(*(F.when(size > 0, q[k] * sign * rotation_angle(q) / size).otherwise(0.0) for k in "xyz"))


def slerp(a: Column, b: Column, w: Column) -> Column:
    """The rotation at share w of the shorter way from a to b; nearly equal ones are mixed linearly."""
    cosine = dot(a, b, "wxyz")
    angle = F.acos(F.least(F.lit(1.0), F.abs(cosine)))
    near = F.abs(cosine) > 0.9995
    p = F.when(near, 1 - w).otherwise(F.sin((1 - w) * angle) / F.sin(angle))
    q = F.when(near, w).otherwise(F.sin(w * angle) / F.sin(angle)) * F.when(cosine < 0, -1.0).otherwise(1.0)

    def mixed(share: Column) -> Column:
        return quaternion(*(a[k] * share["p"] + b[k] * share["q"] for k in "wxyz"))

    def normal(m: Column) -> Column:
        return quaternion(*(m[k] / length(m, "wxyz") for k in "wxyz"))

    # each step is bound once by a one-element transform, so that expressions don't multiply
    shares = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), mixed)
    return F.transform(shares, normal)[0]


def projected(point: Column, fx: Column, fy: Column, cx: Column, cy: Column, distortion: Column) -> Column:
    """Pixel of a point in camera axes under radial-tangential distortion (k1, k2, p1, p2, k3); null behind the camera."""
    x, y = point["x"] / point["z"], point["y"] / point["z"]
    k1, k2, p1, p2, k3 = (distortion[i] for i in range(5))
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    u = x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
    v = y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
    return F.when(point["z"] > 0, F.struct((fx * u + cx).alias("x"), (fy * v + cy).alias("y")))


def undistorted(u: Column, v: Column, distortion: Column, rounds: int = 12) -> Column:
    """Normalised image coordinates without distortion, by fixed-point steps inside one expression."""
    k1, k2, p1, p2, k3 = (distortion[i] for i in range(5))

    def step(p: Column, _: Column) -> Column:
        x, y = p["x"], p["y"]
        r2 = x * x + y * y
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        return F.struct(((u - 2 * p1 * x * y - p2 * (r2 + 2 * x * x)) / radial).alias("x"), ((v - p1 * (r2 + 2 * y * y) - 2 * p2 * x * y) / radial).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(u.alias("x"), v.alias("y")), step)


def distorted(x: Column, y: Column, distortion: Column) -> tuple[Column, Column]:
    """Normalised image coordinates under radial-tangential distortion (k1, k2, p1, p2, k3)."""
    k1, k2, p1, p2, k3 = (distortion[i] for i in range(5))
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def pixel_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column, distortion: Column, pose: Column, rounds: int = 60, gate: float = 1e-10) -> Column:
    """The ray (centre, direction, a unit vector, both in the world) that a pixel sees.

    pose is the camera's row-major world-to-camera matrix, an array of 12 or 16. Null where undistortion doesn't settle
    within the gate (in normalised coordinates), as beyond the range in which a distortion can be inverted.
    """
    across, down = (u - cx) / fx, (v - cy) / fy

    def checked(p: Column) -> Column:
        x, y = distorted(p["x"], p["y"], distortion)
        settled = F.coalesce((F.abs(x - across) <= gate) & (F.abs(y - down) <= gate), F.lit(False))
        ray = [pose[j] * p["x"] + pose[4 + j] * p["y"] + pose[8 + j] for j in range(3)]
        size = F.sqrt(sum((c * c for c in ray), F.lit(0.0)))
        centre = [-(pose[j] * pose[3] + pose[4 + j] * pose[7] + pose[8 + j] * pose[11]) for j in range(3)]
        return F.when(settled, F.struct(vector(*centre).alias("centre"), vector(*(c / size for c in ray)).alias("direction")))

    # bound once, so that the expression doesn't multiply; a step off to infinity fails the gate
    return F.transform(F.array(undistorted(across, down, distortion, rounds)), checked)[0]


def ray_angle(a: Column, b: Column, point: Column) -> Column:
    """The angle under which a point sees two centres."""
    cosine = dot(unit(minus(a, point)), unit(minus(b, point)))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def quaternion_to_matrix(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """The nine entries, row by row, of the rotation matrix of a unit quaternion."""
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def matrix_to_quaternion(m: list[Column]) -> list[Column]:
    """The unit quaternion with w at or above 0 of a rotation matrix, from its largest diagonal term."""
    squares = [1 + m[0] + m[4] + m[8], 1 + m[0] - m[4] - m[8], 1 - m[0] + m[4] - m[8], 1 - m[0] - m[4] + m[8]]
    pairs = [m[7] - m[5], m[2] - m[6], m[3] - m[1]], [m[1] + m[3], m[2] + m[6], m[5] + m[7]]
    (wx, wy, wz), (xy, xz, yz) = pairs
    products = [[squares[0], wx, wy, wz], [wx, squares[1], xy, xz], [wy, xy, squares[2], yz], [wz, xz, yz, squares[3]]]
    largest = F.greatest(*squares)
    chosen = F.coalesce(*(F.when(square == largest, F.array(*row)) for square, row in zip(squares, products, strict=True)))
    scaled = [F.get(chosen, F.lit(k)) / (2 * F.sqrt(largest)) for k in range(4)]
    sign = F.when(scaled[0] < 0, -1.0).otherwise(1.0)
    return [c * sign for c in scaled]


def box_area(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Area of a box; 0 where it is turned inside out."""
    return F.greatest(right - left, F.lit(0.0)) * F.greatest(bottom - top, F.lit(0.0))


#: Fixed weights of a match: centres, torso, size; and the least score of a torso point that counts.
MATCH_WEIGHTS, TORSO_SCORE = (0.45, 0.35, 0.2), 0.2


def match_cost(before: list[Column], now: list[Column], torso: Column) -> Column:
    """How far a candidate's box (left, top, right, bottom) is from the last one's, in roots of the last one's area (1 at least).

    torso is an array of (score, distance) of the shoulders and hips that both have, score being the lower of the two; points
    below TORSO_SCORE don't count, and without any the centres stand for them. Areas count as 1 at least.
    """
    old, new = box_area(*before), box_area(*now)
    scale = F.greatest(F.sqrt(old), F.lit(1.0))
    middles = [((a[0] + a[2]) / 2, (a[1] + a[3]) / 2) for a in (before, now)]
    centre = F.hypot(middles[0][0] - middles[1][0], middles[0][1] - middles[1][1]) / scale
    sure = F.filter(torso, lambda p: p["score"] >= TORSO_SCORE)
    total = F.aggregate(sure, F.lit(0.0), lambda so_far, p: so_far + p["distance"])
    points = F.coalesce(F.when(F.size(sure) > 0, total / F.size(sure) / scale), centre)
    size = F.abs(F.log(F.greatest(new, F.lit(1.0)) / F.greatest(old, F.lit(1.0))))
    return MATCH_WEIGHTS[0] * centre + MATCH_WEIGHTS[1] * points + MATCH_WEIGHTS[2] * size


def to_crop(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column, turn: Column, mirror: Column, scale: Column) -> tuple[Column, Column]:
    """Source pixels as pixels of a crop that is turned by quarter turns (0, 90, 180 or 270 degrees, clockwise), mirrored and scaled, in this order."""
    u, v = x - left, y - top
    across = F.when(turn == 90, height - v).when(turn == 180, width - u).when(turn == 270, v).otherwise(u)
    down = F.when(turn == 90, u).when(turn == 180, height - v).when(turn == 270, width - u).otherwise(v)
    wide = F.when(turn.isin(90, 270), height).otherwise(width)
    return F.when(mirror, wide - across).otherwise(across) * scale, down * scale


def from_crop(x: Column, y: Column, left: Column, top: Column, width: Column, height: Column, turn: Column, mirror: Column, scale: Column) -> tuple[Column, Column]:
    """The source pixels that to_crop() sends to these."""
    wide = F.when(turn.isin(90, 270), height).otherwise(width)
    down = y / scale
    across = F.when(mirror, wide - x / scale).otherwise(x / scale)
    u = F.when(turn == 90, down).when(turn == 180, width - across).when(turn == 270, width - down).otherwise(across)
    v = F.when(turn == 90, height - across).when(turn == 180, height - down).when(turn == 270, across).otherwise(down)
    return u + left, v + top


def midpoint_span(a: list[Column], b: list[Column]) -> tuple[list[Column], Column]:
    """The middle of two points, and their distance."""
    return [(p + q) / 2 for p, q in zip(a, b, strict=True)], F.sqrt(sum(((p - q) ** 2 for p, q in zip(a, b, strict=True)), F.lit(0.0)))
