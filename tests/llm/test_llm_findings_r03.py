"""Findings of round 3 on the training-data operators: work that needn't be done."""

from __future__ import annotations

import numpy as np

from strandline.llm import components, suffixes


def test_suffixes_are_induced_once_a_level(monkeypatch):
    """F op1_suffix_array: LMS substrings were sorted by an induction of their own, as long as that of the suffixes."""
    levels, inductions = [], []
    whole, induced = suffixes.suffix_array, suffixes._induced
    monkeypatch.setattr(suffixes, "suffix_array", lambda *a: levels.append(len(a[0])) or whole(*a))
    monkeypatch.setattr(suffixes, "_induced", lambda *a: inductions.append(len(a[0])) or induced(*a))
    rng = np.random.default_rng(3)
    # ends inside one another, runs, the largest symbols, and texts that end in separators
    for text in (rng.integers(0, 3, 400), np.tile([2, 1, 1, 3], 50), np.repeat(rng.integers(0, 3, 60), rng.integers(1, 30, 60)), rng.integers(250, 257, 300), np.append(np.tile([1, 2, 0], 30), [0, 0])):
        levels.clear(), inductions.clear()
        found = suffixes.suffix_array(text, 257)
        assert found.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert inductions[::-1] == levels


def test_stars_take_no_round(spark, monkeypatch):
    """F pipeline: components of what already are stars took a round of joins that only confirmed them."""
    rounds = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a: rounds.append(1) or star(*a))
    label = lambda pairs: {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert label([(1, 5), (9, 1), (1, 7), (4, 3), (1, 5), (2, 2)]) == {1: 1, 5: 1, 9: 1, 7: 1, 3: 3, 4: 3}
    assert not rounds
    assert label([(i, i + 1) for i in range(20)] + [(40, 30), (40, 35)]) == dict.fromkeys(range(21), 0) | {40: 30, 35: 30, 30: 30}
    assert rounds
