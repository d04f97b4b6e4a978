"""All catalogue queries and their SQL."""

from __future__ import annotations

from strandline.plans import assembly, bodies, entities, feet, joins, landmarks, motion, points, recordings, segments, series, states

MODULES = (joins, series, states, entities, landmarks, bodies, segments, recordings, feet, motion, assembly, points)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
