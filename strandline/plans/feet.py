"""Queries of the machines with carried state: users are feet, and their events samples hours apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import feet
from strandline.plans.base import DAY, EVENTS, HOUR, events

SPAN = 5 * DAY
CONTACTS = feet.ContactConfig(enter_height=0.03, leave_height=0.06, enter_speed=1e-6, leave_speed=4e-6, contact=6 * HOUR, no_contact=3 * HOUR, max_gap=2 * DAY)
PIVOTS = feet.PivotConfig(enter_speed=2e-5, leave_speed=8e-6, quiet=2 * HOUR, max_gap=2 * DAY)
BOUTS = feet.BoutConfig(enter_speed=60.0, leave_speed=30.0, min_duration=HOUR, min_excursion=5.0, max_gap=2 * DAY)
PLACEMENTS = feet.PlacementConfig(enter_distance=40.0, leave_distance=70.0, enter_angle=1.5, leave_angle=2.5, stable=6 * HOUR, max_gap=2 * DAY)


def foot_contacts(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    sigma = 0.0005 + F.col("k") / 1e5
    heights = {"heel": F.when(F.col("k") % 13 > 0, F.col("value") / 1000), "forefoot": (F.col("value") * 0.8 + F.col("k") * 0.1) / 1000, "outer": F.col("value") * 0.9 / 1000}
    sources = {"heel": F.array("event_type"), "forefoot": F.array((F.col("k") % 5).cast("string")), "outer": F.array((F.col("k") % 3).cast("string"))}
    e = e.withColumns({f"h_{p}": h for p, h in heights.items()} | {f"s_{p}": sigma for p in heights} | {f"from_{p}": s for p, s in sources.items()})
    out = feet.contacts(e, ["user_id"], "us", "event_id", {p: (f"h_{p}", f"s_{p}", f"from_{p}") for p in heights}, CONTACTS, SPAN)
    return out.select("event_id", "state", "region", "candidate", F.array_join(F.array_sort("reasons"), ",").alias("reasons"), F.size("times").alias("n_times"), "bracket_from", "bracket_to")


def foot_pivots(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    e = e.withColumns({"yaw": F.when(F.col("k") % 17 > 0, F.atan2(F.sin("value"), F.cos("value"))), "sigma": F.col("k") / 1e4, "held": F.col("event_type") != "error"})
    e = e.withColumn("sources", F.array(F.array(F.col("event_id").cast("string")), F.array(F.concat(F.lit("k"), F.col("k")))))
    out = feet.pivots(e, ["user_id"], "us", "yaw", "sigma", "held", "sources", PIVOTS, SPAN)
    return out.select("user_id", "start", "end", "n", F.round("excursion", 6).alias("excursion"), F.round("turned", 6).alias("turned"))


def motion_bouts(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    e = e.withColumns({"at": F.when(F.col("event_type") != "error", F.array("value", F.col("k").cast("double"))), "sigma": F.col("k") / 50.0, "speed": F.when(F.col("k") % 9 > 0, F.col("value")), "speed_sigma": F.col("k") / 40.0})
    out = feet.motion_bouts(e, ["user_id"], "us", "at", "sigma", "speed", "speed_sigma", BOUTS, SPAN)
    return out.select("user_id", "start", "end", "n", F.round("excursion", 6).alias("excursion"))


def foot_placements(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    point = lambda name, x, y: F.struct(F.lit(name).alias("name"), x.cast("double").alias("x"), y.cast("double").alias("y"), (F.col("k") / 100.0).alias("sigma"))
    points = F.array(point("heel", F.col("value"), F.col("k") / 10), point("forefoot", F.col("value") + 3, F.col("k") / 10))
    e = e.withColumns({"points": points, "yaw": F.col("k") / 100.0, "contact": F.col("event_type") != "error", "sources": F.array(F.array(F.col("event_id").cast("string")), F.array(F.col("event_id").cast("string")))})
    out = feet.foot_placements(e.withColumn("yaw_sigma", F.lit(0.01)), ["user_id"], "us", "contact", "points", "yaw", "yaw_sigma", "sources", PLACEMENTS, SPAN)
    return out.select("user_id", "start", "end", "kind", "n", "confirmed", F.round("spread", 6).alias("spread"))


QUERIES = {f.__name__: f for f in (foot_contacts, foot_pivots, motion_bouts, foot_placements)}


def _said(stable: str, near: str, raised: str) -> str:
    """Candidate and region of a sample, given what is near and raised in the eyes of a state."""
    flat = f"h_{near} AND f_{near} AND o_{near}"
    heel, fore = f"h_{near} AND f_{raised} AND o_{raised}", f"f_{near} AND o_{near} AND h_{raised}"
    return f"""CASE WHEN h_{near} OR f_{near} THEN 'contact' WHEN h_{raised} AND f_{raised} AND o_{raised} THEN 'no_contact' ELSE 'unknown' END AS {stable}_says,
                CASE WHEN {flat} THEN 'flat' WHEN {heel} THEN 'heel' WHEN {fore} THEN 'forefoot' END AS {stable}_region"""


ORACLES = {
    "foot_contacts": f"""WITH RECURSIVE {EVENTS},
        m AS (SELECT user_id, event_id, us, part, h, 0.0005 + k / 1e5 AS s, src FROM (
            SELECT *, unnest(['h', 'f', 'o']) AS part, unnest([CASE WHEN k % 13 > 0 THEN value / 1000 END, (value * 0.8 + k * 0.1::DOUBLE) / 1000, value * 0.9::DOUBLE / 1000]) AS h,
                unnest([event_type, (k % 5)::VARCHAR, (k % 3)::VARCHAR]) AS src FROM e)),
        l AS (SELECT *, lag(us) OVER w AS t, lag(h) OVER w AS oh, lag(s) OVER w AS os, lag(src) OVER w AS osrc FROM m WINDOW w AS (PARTITION BY user_id, part ORDER BY us)),
        v AS (SELECT *, CASE WHEN h IS NULL THEN 'missing_or_unusable_landmark' WHEN oh IS NULL THEN 'motion_unavailable' WHEN us - t > {2 * DAY} THEN 'temporal_gap' WHEN src = osrc THEN 'no_new_native_evidence' END AS why,
                abs(h - oh) / ((us - t) / 1e6) + 2 * (s + os) / ((us - t) / 1e6) AS fast FROM l),
        g AS (SELECT *, coalesce(why IS NULL AND h + 2 * s <= 0.06 AND fast <= 4e-6, false) AS c, coalesce(why IS NULL AND h + 2 * s <= 0.03 AND fast <= 1e-6, false) AS a,
                coalesce(h - 2 * s > 0.06, false) AS r, coalesce(h - 2 * s > 0.03, false) AS z FROM v),
        b AS (SELECT user_id, event_id, us, any_value(t) AS t, list_distinct(list(why) FILTER (why IS NOT NULL)) AS whys, coalesce(bool_or(why = 'no_new_native_evidence'), false) AS stale,
                {", ".join(f"bool_or({x} AND part = '{p}') AS {p}_{x}" for p in "hfo" for x in "carz")} FROM g GROUP BY 1, 2, 3),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i, {_said("contact", "c", "r")}, {_said("no_contact", "a", "z")}, {_said("unknown", "a", "r")} FROM b),
        f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 'unknown' AS stable, NULL::VARCHAR AS pending, NULL::BIGINT AS since, NULL::BIGINT AS before, 0 AS n, '' AS state, '' AS region, '' AS candidate, []::VARCHAR[] AS reasons, 0 AS n_times, NULL::BIGINT AS bracket_from, NULL::BIGINT AS bracket_to FROM (SELECT DISTINCT user_id FROM e)
            UNION ALL
            SELECT user_id, i, event_id, CASE WHEN says = 'unknown' THEN 'unknown' WHEN turns THEN says ELSE was END, CASE WHEN waits AND NOT turns THEN says END, begun, earlier, many,
                CASE WHEN waits AND NOT turns OR stale AND says <> was THEN 'unknown' ELSE says END, CASE WHEN says = 'contact' AND NOT (waits AND NOT turns) AND NOT (stale AND says <> was) THEN area END, says,
                list_concat(whys, CASE WHEN waits AND NOT turns THEN ['temporal_confirmation_pending'] ELSE [] END),
                CASE WHEN waits THEN many ELSE 1 END, CASE WHEN turns THEN earlier END, CASE WHEN turns THEN begun END
            FROM (SELECT *, waits AND us - begun >= CASE says WHEN 'contact' THEN {6 * HOUR} ELSE {3 * HOUR} END AS turns FROM (
                SELECT *, says NOT IN (was, 'unknown') AND NOT stale AS waits, CASE WHEN pend = says THEN since ELSE us END AS begun, CASE WHEN pend = says THEN before ELSE coalesce(t, us) END AS earlier, CASE WHEN pend = says THEN n + 1 ELSE 1 END AS many
                FROM (SELECT x.*, f.since, f.before, f.n, CASE WHEN fresh THEN 'unknown' ELSE stable END AS was, CASE WHEN fresh THEN NULL ELSE pending END AS pend,
                        CASE WHEN fresh OR stable = 'unknown' THEN unknown_says WHEN stable = 'contact' THEN contact_says ELSE no_contact_says END AS says,
                        CASE WHEN fresh OR stable = 'unknown' THEN unknown_region WHEN stable = 'contact' THEN contact_region ELSE no_contact_region END AS area
                    FROM f JOIN (SELECT *, coalesce(us - t > {2 * DAY}, false) AS fresh FROM n) x ON x.user_id = f.user_id AND x.i = f.i + 1))))
        SELECT event_id, state, region, candidate, array_to_string(list_sort(list_concat(reasons, [CASE candidate WHEN 'contact' THEN 'ground_proximity_and_low_vertical_motion' WHEN 'no_contact' THEN 'all_foot_landmarks_above_ground' ELSE 'insufficient_or_ambiguous_foot_evidence' END])), ',') AS reasons,
            n_times, bracket_from, bracket_to FROM f WHERE i > 0""",
    "foot_pivots": f"""WITH RECURSIVE {EVENTS},
        s AS (SELECT *, CASE WHEN k % 17 > 0 THEN atan2(sin(value), cos(value)) END AS yaw, k / 1e4 AS sg, event_type <> 'error' AS held, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e),
        f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS us, NULL::DOUBLE AS yaw, NULL::DOUBLE AS angle, false AS held, 0::DOUBLE AS sg, []::INTEGER[] AS seen,
                NULL::STRUCT(start BIGINT, moved BIGINT, first DOUBLE, total DOUBLE, lo DOUBLE, hi DOUBLE, sg DOUBLE, n INTEGER, klo DOUBLE, khi DOUBLE, ksg DOUBLE, kn INTEGER) AS turn, NULL::STRUCT(start BIGINT, moved BIGINT, first DOUBLE, total DOUBLE, lo DOUBLE, hi DOUBLE, sg DOUBLE, n INTEGER, klo DOUBLE, khi DOUBLE, ksg DOUBLE, kn INTEGER) AS done
              FROM (SELECT DISTINCT user_id FROM e)
            UNION ALL
            SELECT user_id, i, CASE WHEN usable THEN now END, CASE WHEN usable THEN nyaw END, CASE WHEN usable THEN nangle END, usable AND nheld AND NOT half, nsg, CASE WHEN usable THEN list_append(old, k) ELSE [] END,
                CASE WHEN NOT usable OR cut OR half OR NOT backed THEN NULL WHEN open IS NULL THEN CASE WHEN speed >= 2e-5 THEN {{'start': us, 'moved': now, 'first': angle, 'total': nangle - angle, 'lo': least(angle, nangle), 'hi': greatest(angle, nangle), 'sg': greatest(sg, nsg), 'n': 2, 'klo': least(angle, nangle), 'khi': greatest(angle, nangle), 'ksg': greatest(sg, nsg), 'kn': 2}} END
                     WHEN speed >= 8e-6 THEN {{'start': open.start, 'moved': now, 'first': open.first, 'total': nangle - open.first, 'lo': least(open.lo, nangle), 'hi': greatest(open.hi, nangle), 'sg': greatest(open.sg, nsg), 'n': open.n + 1, 'klo': least(open.lo, nangle), 'khi': greatest(open.hi, nangle), 'ksg': greatest(open.sg, nsg), 'kn': open.n + 1}}
                     WHEN now - open.moved >= {2 * HOUR} THEN NULL
                     ELSE {{'start': open.start, 'moved': open.moved, 'first': open.first, 'total': open.total, 'lo': least(open.lo, nangle), 'hi': greatest(open.hi, nangle), 'sg': greatest(open.sg, nsg), 'n': open.n + 1, 'klo': open.klo, 'khi': open.khi, 'ksg': open.ksg, 'kn': open.kn}} END,
                CASE WHEN NOT usable OR cut OR half OR NOT backed THEN turn WHEN speed < 8e-6 AND now - open.moved >= {2 * HOUR} THEN open END
            FROM (SELECT *, coalesce(abs(delta) >= pi() - 0.05, false) AS half, prev IS NOT NULL AND held AND nheld AS backed, abs(delta) / ((now - prev) / 1e6) AS speed, coalesce(angle + delta, nyaw) AS nangle, CASE WHEN NOT cut THEN turn END AS open
                FROM (SELECT *, CASE WHEN NOT cut THEN us END AS prev, CASE WHEN cut THEN [] ELSE seen END AS old, CASE WHEN NOT cut THEN atan2(sin(nyaw - yaw), cos(nyaw - yaw)) END AS delta
                    FROM (SELECT f.*, s.i AS ni, s.us AS now, s.yaw AS nyaw, s.sg AS nsg, s.held AS nheld, s.k, s.yaw IS NOT NULL AND NOT list_contains(f.seen, s.k) AS usable, f.us IS NULL OR s.us - f.us > {2 * DAY} AS cut FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1))) q (user_id, _i, us, yaw, angle, held, sg, seen, turn, done, i, now, nyaw, nsg, nheld, k, usable, cut, prev, old, delta, half, backed, speed, nangle, open)),
        d AS (SELECT user_id, done AS x FROM f WHERE done IS NOT NULL UNION ALL SELECT user_id, turn FROM f WHERE turn IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1 AND (user_id, i) IN (SELECT (user_id, max(i)) FROM f GROUP BY user_id))
        SELECT user_id, x.start, x.moved AS "end", x.kn::BIGINT AS n, round(x.khi - x.klo, 6) AS excursion, round(x.total, 6) AS turned FROM d WHERE x.khi - x.klo >= 0.12 + 4 * x.ksg""",
    "motion_bouts": f"""WITH RECURSIVE {EVENTS},
        s AS (SELECT user_id, us, CASE WHEN event_type <> 'error' THEN value END AS x, k::DOUBLE AS y, k / 50.0::DOUBLE AS sg, CASE WHEN k % 9 > 0 THEN value END AS v, k / 20.0::DOUBLE AS err, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e),
        f AS (SELECT user_id, 0::BIGINT AS i, NULL::BIGINT AS us, NULL::BIGINT AS since, NULL::STRUCT(start BIGINT, x DOUBLE, y DOUBLE, n INTEGER, far DOUBLE, sg DOUBLE) AS quiet, NULL::STRUCT(start BIGINT, x DOUBLE, y DOUBLE, n INTEGER, far DOUBLE, sg DOUBLE) AS bout, NULL::STRUCT(start BIGINT, x DOUBLE, y DOUBLE, n INTEGER, far DOUBLE, sg DOUBLE) AS done, NULL::BIGINT AS until
              FROM (SELECT DISTINCT user_id FROM e)
            UNION ALL
            SELECT user_id, i, CASE WHEN known THEN now END, begun, CASE WHEN ends THEN {{'start': now, 'x': x, 'y': y, 'n': 1, 'far': 0.0::DOUBLE, 'sg': sg}} WHEN starts THEN NULL ELSE q END, CASE WHEN ends THEN NULL WHEN starts THEN q ELSE b END,
                CASE WHEN ends AND now - b.start >= {HOUR} AND b.far > greatest(5.0, 2 * b.sg) THEN b END, now
            FROM (SELECT *, low AND now - begun >= {HOUR} AS ends, coalesce(NOT low AND v IS NOT NULL AND b IS NULL AND q IS NOT NULL AND v - err >= 60, false) AS starts
                FROM (SELECT *, CASE WHEN NOT known THEN NULL WHEN v IS NULL THEN s0 WHEN low THEN coalesce(s0, now) END AS begun
                    FROM (SELECT *, coalesce(known AND v + err <= 30, false) AS low,
                            CASE WHEN b0 IS NOT NULL THEN {{'start': b0.start, 'x': b0.x, 'y': b0.y, 'n': b0.n + 1, 'far': greatest(b0.far, sqrt((x - b0.x) ** 2 + (y - b0.y) ** 2)), 'sg': greatest(b0.sg, sg)}} END AS b,
                            CASE WHEN b0 IS NOT NULL THEN q0 WHEN q0 IS NOT NULL THEN {{'start': q0.start, 'x': q0.x, 'y': q0.y, 'n': q0.n + 1, 'far': greatest(q0.far, sqrt((x - q0.x) ** 2 + (y - q0.y) ** 2)), 'sg': greatest(q0.sg, sg)}} END AS q
                        FROM (SELECT s.user_id, s.i, s.us AS now, s.x, s.y, s.sg, s.v, s.err, s.x IS NOT NULL AS known, CASE WHEN keep THEN f.since END AS s0, CASE WHEN keep THEN f.quiet END AS q0, CASE WHEN keep THEN f.bout END AS b0
                            FROM (SELECT f.*, s.i AS ni, s.x IS NOT NULL AND (f.us IS NULL OR s.us - f.us <= {2 * DAY}) AS keep FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) f JOIN s ON s.user_id = f.user_id AND s.i = f.ni)))))
        SELECT user_id, done.start, until AS "end", done.n::BIGINT AS n, round(done.far, 6) AS excursion FROM f WHERE done IS NOT NULL""",
}
