"""Queries of body geometry: each event's value, number and id stand for the joints of a body at one instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import body, geometry
from strandline.plans.base import EVENTS, events

#: Joints as expressions of value, k and event_id that Spark and DuckDB read alike.
JOINTS = {
    "lh": ("value / 200 - 1", "0.1D * sin(k)", "0.0D"),
    "rh": ("1.0D", "0.05D * cos(event_id)", "value / 100"),
    "ls": ("-1.2D", "0.3D * cos(event_id)", "3.0D"),
    "rs": ("1.1D", "k / 100.0D", "3 + value / 100"),
    "le": ("-1.3D", "0.4D + value / 300", "1.5D"),
    "lw": ("1.2D * sin(event_id)", "1 + k / 200.0D", "1.5D + cos(k)"),
    "re": ("1.2D", "0.5D", "1.4D"),
    "rw": ("0.8D * cos(event_id) - 0.2D", "1.2D", "2.2D + sin(value)"),
}


def joints(spark: SparkSession, d: str, names: list[str], sigma: float) -> DataFrame:
    """event_id and joints as points; those of errors may not be used."""
    e = events(spark, d)
    points = {n: body.point(*map(F.expr, JOINTS[n]), F.col("k") * sigma, F.col("event_type") != "error") for n in names}
    return e.select("event_id", "value", "k", *(p.alias(n) for n, p in points.items()))


def rounded(column, name: str):
    return (F.round(column, 6) + 0.0).alias(name)


def limb_axis(spark: SparkSession, d: str) -> DataFrame:
    e = joints(spark, d, ["le", "lw"], 0.003).withColumn("a", body.axis(F.col("le"), F.col("lw")))
    return e.select("event_id", *(rounded(F.col("a")[c], c) for c in ("x", "y", "z", "sigma")))


def joint_bend(spark: SparkSession, d: str) -> DataFrame:
    e = joints(spark, d, ["ls", "le", "lw"], 0.001).withColumn("b", body.bend(F.col("ls"), F.col("le"), F.col("lw")))
    return e.select("event_id", rounded(F.col("b")["angle"], "angle"), rounded(F.col("b")["sigma"], "sigma"))


def body_frame(spark: SparkSession, d: str) -> DataFrame:
    names = ["lh", "rh", "ls", "rs"]
    e = joints(spark, d, names, 0.001).withColumn("f", body.body_axes(*map(F.col, names)))
    f = F.col("f")
    return e.select("event_id", rounded(f["x"]["x"], "right_x"), rounded(f["y"]["y"], "front_y"), rounded(f["z"]["z"], "up_z"), rounded(f["z"]["x"], "up_x"), rounded(f["sigma"], "sigma"))


def palm_frame(spark: SparkSession, d: str) -> DataFrame:
    """The frame of a palm, and the bend of the wrist against it."""
    e = joints(spark, d, ["le", "lw", "rw", "re"], 0.001).withColumn("f", body.hand_axes(F.col("lw"), F.col("rw"), F.col("re")))
    wrist = body.bend(F.col("le"), F.col("lw"), F.struct(*(((F.col("rw")[c] + F.col("re")[c]) / 2).alias(c) for c in "xyz"), (F.col("rw")["sigma"] + F.col("re")["sigma"]).alias("sigma")))
    e = e.withColumn("b", wrist)
    return e.select("event_id", rounded(F.col("f")["x"]["z"], "across_z"), rounded(F.col("f")["z"]["y"], "normal_y"), rounded(F.col("b")["angle"], "wrist"))


def foot_and_head(spark: SparkSession, d: str) -> DataFrame:
    """The axes of a foot and of a head, and the head's front as the foot sees it."""
    e = joints(spark, d, ["lh", "rh", "rs", "ls", "re"], 0.0005)
    e = e.withColumns({"foot": body.foot_axes(F.col("lh"), F.col("rs"), F.col("rh"), F.col("k") % 2 == 0), "head": body.head_axes(F.col("ls"), F.col("re"), F.col("rh"))})
    seen = body.within(F.col("foot"), F.col("head")["y"])
    return e.select("event_id", rounded(F.col("foot")["y"]["y"], "foot_y"), rounded(F.col("head")["y"]["z"], "head_z"), *(rounded(seen[c], f"seen_{c}") for c in "xyz"))


def forearm_crossing(spark: SparkSession, d: str) -> DataFrame:
    trunk, arms = ["lh", "rh", "ls", "rs"], ["le", "lw", "re", "rw"]
    e = joints(spark, d, trunk + arms, 0.00005).withColumn("f", body.body_axes(*map(F.col, trunk)))
    e = e.withColumn("c", body.crossing(F.col("f"), *map(F.col, arms)))
    return e.select("event_id", F.col("c")["value"].alias("crossing"), F.col("c")["front"].alias("front"))


def hand_states(spark: SparkSession, d: str) -> DataFrame:
    """A finger for each of an event's numbers, two bends each; the state of the hand of an hour's first events."""
    e = events(spark, d)

    # the sigma holds all its multiples, as a product rounds otherwise where a bend lies on the limit
    def bend(angle, sigma):
        return F.struct(angle.alias("angle"), sigma.alias("sigma"))

    fingers = [F.array(bend((F.col("value") + j) / 60, body.MULTIPLE * F.col("k") / 2000), F.when((F.col("k") + j) % 9 > 0, bend(F.col("value") / 50, F.lit(body.MULTIPLE * 0.01)))) for j in range(5)]
    e = e.withColumn("fingers", F.array(*(body.finger_state(bends, 1.0) for bends in fingers)))
    return e.select("event_id", F.array_join("fingers", ",").alias("fingers"), body.hand_state(F.col("fingers")).alias("hand"))


def placement_measures(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    first = {"x": F.col("value"), "y": F.col("k") / 2, "yaw": F.col("event_id") / 11, "sigma": F.col("k") / 100}
    second = {"x": F.col("k") + 0.5, "y": F.col("value") / 3, "yaw": F.col("value") / 7, "sigma": F.col("value") / 500}
    out = e.select("event_id", *body.placement(first, second, 20 - F.col("k") / 3, F.lit(1.5)))
    return out.select("event_id", *(rounded(F.col(c), c) for c in out.columns if c != "event_id"))


def ray_angles(spark: SparkSession, d: str) -> DataFrame:
    centre = geometry.vector(F.col("value") / 10, F.col("k") / 10, F.lit(9.0))
    a, b = (geometry.vector(F.lit(x), F.lit(0.5), F.lit(0.25)) for x in (-1.0, 2.0))
    return events(spark, d).select("event_id", rounded(geometry.ray_angle(a, b, centre), "angle"))


QUERIES = {f.__name__: f for f in (limb_axis, joint_bend, body_frame, palm_frame, foot_and_head, forearm_crossing, hand_states, placement_measures, ray_angles)}


# The SQL works on vectors that are columns with endings x, y, z; each step is a table that adds columns to the one before.


def _at(*names: str) -> str:
    """The joints as columns, null for errors."""
    cells = [f"CASE WHEN event_type <> 'error' THEN {JOINTS[n][i].replace('D', '::DOUBLE')} END AS {n}{c}" for n in names for i, c in enumerate("xyz")]
    return f"{EVENTS}, j AS (SELECT event_id, value, k, {', '.join(cells)} FROM e)"


def _minus(a: str, b: str, to: str) -> str:
    return ", ".join(f"{a}{c} - {b}{c} AS {to}{c}" for c in "xyz")


def _mid(a: str, b: str, to: str) -> str:
    return ", ".join(f"({a}{c} + {b}{c}) / 2 AS {to}{c}" for c in "xyz")


def _dot(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _size(a: str) -> str:
    return f"sqrt{_dot(a, a)}"


def _cross(a: str, b: str, to: str) -> str:
    return f"{a}y * {b}z - {a}z * {b}y AS {to}x, {a}z * {b}x - {a}x * {b}z AS {to}y, {a}x * {b}y - {a}y * {b}x AS {to}z"


def _unit(a: str, to: str) -> str:
    return ", ".join(f"{a}{c} / {_size(a)} AS {to}{c}" for c in "xyz")


def _then(name: str, before: str, *columns: str) -> str:
    return f"{name} AS (SELECT *, {', '.join(columns)} FROM {before})"


def _frame(prefix: str, before: str, first: str, hint: str, sigma: str, to: str) -> str:
    """Tables that add axes <to>0, <to>1, <to>2 and their sigma <to>s, null beyond its limit."""
    p, u, h, n = prefix, f"{to}u", f"{to}h", f"{to}n"
    return ", ".join((
        _then(f"{p}1", before, _unit(first, u), _unit(hint, h), f"least({_size(first)}, {_size(hint)}) AS {to}size"),
        _then(f"{p}2", f"{p}1", _cross(u, h, n)),
        _then(f"{p}3", f"{p}2", f"CASE WHEN {_size(n)} >= 0.1 AND 2 * ({sigma}) / ({to}size * {_size(n)}) <= 0.25 THEN 2 * ({sigma}) / ({to}size * {_size(n)}) END AS {to}s"),
        _then(f"{p}4", f"{p}3", ", ".join(f"CASE WHEN {to}s IS NOT NULL THEN {u}{c} END AS {to}0{c}" for c in "xyz"), ", ".join(f"CASE WHEN {to}s IS NOT NULL THEN {n}{c} / {_size(n)} END AS {to}2{c}" for c in "xyz")),
        _then(prefix, f"{p}4", _cross(f"{to}2", f"{to}0", f"{to}1")),
    ))


def _trunk(sigma: str, before: str = "j") -> str:
    return ", ".join((
        _then("t1", before, _minus("rh", "lh", "w"), _mid("lh", "rh", "mh"), _mid("ls", "rs", "ms")),
        _then("t2", "t1", _minus("ms", "mh", "up"), _unit("w", "wu")),
        _then("t3", "t2", _cross("up", "wu", "fr")),
        _frame("b", "t3", "w", "fr", sigma, "f"),
    ))


def _r(expression: str, name: str) -> str:
    return f"round({expression}, 6) + 0.0 AS {name}"


def _bend(before: str, a: str, joint: str, b: str, sigma: str) -> str:
    return ", ".join((
        _then("v1", before, _minus(joint, a, "p"), _minus(b, joint, "q")),
        _then("v", "v1", f"2 * ({sigma}) / least({_size('p')}, {_size('q')}) AS off", f"acos(greatest(-1.0, least(1.0, {_dot('p', 'q')} / ({_size('p')} * {_size('q')})))) AS turn"),
    ))


STATES = [f"CASE WHEN (k + {j}) % 9 = 0 THEN 'indeterminate' WHEN (value + {j}) / 60 + 3 * k / 2000 <= 0.35 AND value / 50 + 0.03 <= 0.35 THEN 'extended' WHEN (value + {j}) / 60 - 3 * k / 2000 >= 1 AND value / 50 - 0.03 >= 1 THEN 'flexed' ELSE 'indeterminate' END" for j in range(5)]

ORACLES = {
    "limb_axis": f"""WITH {_at('le', 'lw')}, {_then('a', 'j', _minus('lw', 'le', 'd'))}, {_then('b', 'a', f"CASE WHEN 0.006 * k / {_size('d')} <= 0.25 THEN 0.006 * k / {_size('d')} END AS s")}
        SELECT event_id, {', '.join(_r(f"CASE WHEN s IS NOT NULL THEN d{c} / {_size('d')} END", c) for c in 'xyz')}, {_r('s', 'sigma')} FROM b""",
    "joint_bend": f"""WITH {_at('ls', 'le', 'lw')}, {_bend('j', 'ls', 'le', 'lw', '0.003 * k')} SELECT event_id, {_r('CASE WHEN off <= 0.25 THEN turn END', 'angle')}, {_r('CASE WHEN off <= 0.25 THEN off END', 'sigma')} FROM v""",
    "body_frame": f"""WITH {_at('lh', 'rh', 'ls', 'rs')}, {_trunk('0.004 * k')} SELECT event_id, {_r('f0x', 'right_x')}, {_r('f1y', 'front_y')}, {_r('f2z', 'up_z')}, {_r('f2x', 'up_x')}, {_r('fs', 'sigma')} FROM b""",
    "palm_frame": f"""WITH {_at('le', 'lw', 'rw', 're')}, {_then('m', 'j', _minus('rw', 're', 'pa'), _mid('rw', 're', 'mi'))}, {_then('m2', 'm', _minus('mi', 'lw', 'fi'))}, {_frame('g', 'm2', 'pa', 'fi', '0.003 * k', 'f')}, {_bend('g', 'le', 'lw', 'mi', '0.004 * k')}
        SELECT event_id, {_r('f0z', 'across_z')}, {_r('f2y', 'normal_y')}, {_r('CASE WHEN off <= 0.25 THEN turn END', 'wrist')} FROM v""",
    "foot_and_head": f"""WITH {_at('lh', 'rh', 'rs', 'ls', 're')}, {_then('m', 'j', _minus('rs', 'lh', 'lo'), ', '.join(f"(rh{c} - rs{c}) * CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END AS la{c}" for c in 'xyz'), _minus('re', 'ls', 'ac'), _mid('ls', 're', 'ce'))},
        {_then('m2', 'm', _minus('rh', 'ce', 'no'))}, {_frame('g', 'm2', 'lo', 'la', '0.0015 * k', 'f')}, {_frame('h', 'g', 'ac', 'no', '0.0015 * k', 'o')}
        SELECT event_id, {_r('f1y', 'foot_y')}, {_r('o1z', 'head_z')}, {', '.join(_r(_dot(f'f{i}', 'o1'), f'seen_{c}') for i, c in enumerate('xyz'))} FROM h""",
    "forearm_crossing": f"""WITH {_at(*JOINTS)}, {_trunk('0.0002 * k')}, {_then('x', 'b', ', '.join(f"{_dot(f'f{i}', n)} AS {to}{c}" for n, to in (('le', 'a_'), ('lw', 'b_'), ('re', 'c_'), ('rw', 'd_')) for i, c in enumerate('xyz')))},
        {_then('y', 'x', _minus('b_', 'a_', 'u_'), _minus('d_', 'c_', 'v_'), _minus('c_', 'a_', 'w_'))},
        {_then('z', 'y', 'v_x * u_z - u_x * v_z AS det', 'sqrt(u_x * u_x + u_z * u_z) AS n1', 'sqrt(v_x * v_x + v_z * v_z) AS n2', f"0.0002 * k + greatest({_size('u_')}, {_size('v_')}, {_size('w_')}) * fs AS pos")},
        {_then('s', 'z', 'CASE WHEN abs(det) / (n1 * n2) >= 0.1 THEN 3 * pos / (least(n1, n2) * abs(det) / (n1 * n2)) END AS err', '(v_x * w_z - w_x * v_z) / det AS t', '(u_x * w_z - u_z * w_x) / det AS q')},
        {_then('c', 's', "CASE WHEN err IS NULL THEN 'unknown' WHEN least(t, q) < -err OR greatest(t, q) > 1 + err THEN 'not_crossed' WHEN least(t, q) > err AND greatest(t, q) < 1 - err THEN 'crossed' ELSE 'unknown' END AS crossing", 'a_y + t * u_y - c_y - q * v_y AS depth', '3 * (pos + err * (abs(u_y) + abs(v_y))) + 1e-8 AS margin')}
        SELECT event_id, crossing, CASE WHEN crossing = 'crossed' AND abs(depth) > margin THEN CASE WHEN depth > 0 THEN 'left_forearm' ELSE 'right_forearm' END END AS front FROM c""",
    "hand_states": f"""WITH {EVENTS}, f AS (SELECT event_id, {', '.join(f'{s} AS f{j}' for j, s in enumerate(STATES))} FROM e)
        SELECT event_id, concat_ws(',', f0, f1, f2, f3, f4) AS fingers, CASE WHEN f0 = 'extended' AND f1 = f0 AND f2 = f0 AND f3 = f0 AND f4 = f0 THEN 'open' WHEN f0 = 'flexed' AND f1 = f0 AND f2 = f0 AND f3 = f0 AND f4 = f0 THEN 'fist' ELSE 'indeterminate' END AS hand FROM f""",
    "placement_measures": f"""WITH {EVENTS}, p AS (SELECT event_id, k + 0.5::DOUBLE - value AS dx, value / 3 - k / 2.0::DOUBLE AS dy, event_id / 11.0::DOUBLE AS yaw, value / 7 AS yaw2, k / 100.0::DOUBLE + value / 500 AS sigma, 20 - k / 3.0::DOUBLE AS body FROM e),
        l AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance, dx * cos(yaw) + dy * sin(yaw) AS along, dy * cos(yaw) - dx * sin(yaw) AS across, CASE WHEN body > 1.5 THEN body END AS b, atan2(dy, dx) - yaw AS a, yaw2 - yaw AS g FROM p)
        SELECT event_id, {_r('distance', 'distance')}, {_r('along', 'along')}, {_r('across', 'across')}, {_r('sigma', 'sigma')}, {', '.join(_r(f'{n} / b', f'{n}_ratio') for n in ('distance', 'along', 'across'))},
            {_r('(sigma + distance / b * 1.5) / (b - 1.5)', 'ratio_sigma')}, {_r('CASE WHEN distance > 1e-12 THEN atan2(sin(a), cos(a)) END', 'alignment')}, {_r('atan2(sin(g), cos(g))', 'foot_angle')} FROM l""",
    "ray_angles": f"""WITH {EVENTS}, p AS (SELECT event_id, value / 10 AS x, k / 10.0::DOUBLE AS y FROM e),
        d AS (SELECT event_id, (-1 - x) * (2 - x) + (0.5 - y) ** 2 + 8.75 ** 2 AS s, sqrt((-1 - x) ** 2 + (0.5 - y) ** 2 + 8.75 ** 2) * sqrt((2 - x) ** 2 + (0.5 - y) ** 2 + 8.75 ** 2) AS m FROM p) SELECT event_id, {_r('acos(s / m)', 'angle')} FROM d""",
}
