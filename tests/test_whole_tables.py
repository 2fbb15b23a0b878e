"""Queries over all points and entities against brute force."""

import numpy as np
import pytest

from geoloom import registry
from geoloom.operators import documents
from geoloom.plans import points, records


@pytest.fixture
def cloud(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    p = [(k, *(float(v) for v in rnd.integers(0, 160, 3)), 2) for k in range(400)]
    monkeypatch.setattr(points, "points", lambda *a: spark.createDataFrame(p, "id long, x double, y double, z double, cls int"))
    return p


def d2(a, b):
    return sum((a[k] - b[k]) ** 2 for k in (1, 2, 3))


def test_nearest_of_all_points(spark, cloud):
    want, one = set(), set()
    for s in cloud[::50]:
        near = sorted((d2(s, t), t[0]) for t in cloud)[:4]
        want |= {(s[0], t, d, k + 1) for k, (d, t) in enumerate(near)}
        one |= {(s[0], t, d) for d, t in near[:1] if d < 1600}
    got = registry.QUERIES["nearest_neighbours_all"](spark, "")
    assert {(r.sid, r.tid, r.d2, r["rank"]) for r in got.collect()} == want
    got = registry.QUERIES["nearest_correspondence_all"](spark, "")
    assert {(r.sid, r.tid, r.d2) for r in got.collect()} == one


def test_clearance_of_all_boxes(spark, cloud):
    size = (8, 16, 4)
    want = {(a[0], b[0]) for a in cloud for b in cloud if a[0] < b[0] and all(a[k + 1] <= b[k + 1] + size[k] + 2 and b[k + 1] <= a[k + 1] + size[k] + 2 for k in range(3))}
    got = registry.QUERIES["clearance_pairs_all"](spark, "").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_replay_keeps_entities_with_a_repeated_last_number(spark, monkeypatch):
    rows = [(1, 5, "a"), (1, 9, "b"), (1, 9, "c"), (1, 9, None), (2, 7, None), (2, 7, None), (3, 1, "x"), (3, 2, None)]
    want = {(1, 3, "c", False), (2, 1, None, True), (3, 1, None, True)}
    for turn in (rows, rows[::-1]):
        j = spark.createDataFrame(turn, "entity long, sequence long, after string").coalesce(1)
        assert {tuple(r) for r in documents.replayed(j).collect()} == want
    monkeypatch.setattr(records, "_journal", lambda *a: j)
    assert {tuple(r) for r in registry.QUERIES["journal_replay_all"](spark, "").collect()} == want
