"""Merged blocks and distances of meshes on small fixtures and by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import merges, meshes
from geoloom.plans import assembly
from geoloom.sources.bindings import points

CORNERS = [f"{c}{k}" for c in "abc" for k in "xyz"]
MESH = "id long, " + ", ".join(f"{c} double" for c in CORNERS)


def nearest_on(p, a, b, c):
    """The squared distance of p to a triangle by minimising over weights of its corners."""
    best = min(segment(p, a, b), segment(p, b, c), segment(p, c, a))
    m = np.stack([b - a, c - a], axis=1)
    if np.linalg.matrix_rank(m) == 2:
        w = np.linalg.lstsq(m, p - a, rcond=None)[0]
        if (w >= 0).all() and w.sum() <= 1:
            best = min(best, float(((m @ w + a - p) ** 2).sum()))
    return best


def segment(p, a, b):
    u = b - a
    t = np.clip(((p - a) @ u) / (u @ u), 0, 1) if u @ u else 0.0
    return float(((a + t * u - p) ** 2).sum())


def as_arrays(df):
    return {r.id: np.array([r[c] for c in CORNERS]).reshape(3, 3) for r in df.collect()}


def test_nearest_triangles_by_brute_force(spark, sf_dir):
    got = {r.sid: r for r in assembly.nearest_triangles(spark, sf_dir).collect()}
    tris = as_arrays(assembly.mesh(spark, sf_dir))
    source = points(spark, sf_dir).where("id % 50 = 0").collect()
    assert len(got) == len(source)
    for r in source:
        p = np.array([r.x, r.y, r.z])
        every = {k: nearest_on(p, *t) for k, t in tris.items()}
        least = min(every.values())
        assert got[r.id].d2 == pytest.approx(least, rel=1e-9, abs=1e-9)
        assert every[got[r.id].tid] == pytest.approx(least, rel=1e-9, abs=1e-9)


def test_mesh_distance_by_brute_force(spark, sf_dir):
    got = assembly.mesh_distance(spark, sf_dir).collect()[0]
    tris = as_arrays(assembly.mesh(spark, sf_dir))
    sides = [{k: t for k, t in tris.items() if k % 2 == s} for s in (0, 1)]
    least = min(nearest_on(p, *t) for a, b in (sides, sides[::-1]) for c in a.values() for p in c for t in b.values())
    assert got.d2 == pytest.approx(least, rel=1e-9, abs=1e-9)


def test_triangles_odd_inputs(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (2, None, 0.0, 0.0), (3, 50.0, 0.0, 0.0), (4, 9.0, 9.0, 9.0)], "id long, x double, y double, z double")
    flat = [-1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 0.0, 2.0, 0.0]
    m = spark.createDataFrame([(7, *flat), (6, *flat), (5, *[9.0] * 9), (8, *[None] * 9)], MESH)
    got = {r.sid: (r.tid, r.d2) for r in meshes.nearest_triangles(p, m, 1.0).collect()}
    assert got[1] == (6, 9.0)  # ties go to the smaller id
    assert got[4] == (5, 0.0)  # a triangle that is a point
    assert got[3][0] == 5 and 2 not in got
    assert meshes.nearest_triangles(p, m.limit(0), 1.0).count() == 0
    assert meshes.nearest_triangles(p.limit(0), m, 1.0).count() == 0
    assert meshes.least_distance(m.limit(0), m, 1.0).count() == 0


def test_merge(spark):
    blocks = spark.createDataFrame([("b", 0, *[1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 2.0, 1.0, 0.0, 0.0), ("a", 1, *[0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], 1.0, 0.0, 0.0, 5.0)], ["block", "ordinal", *merges.MATRIX, "scale", *merges.SHIFT])
    p = spark.createDataFrame([("a", 1, 1.0, 0.0, 0.0), ("b", 9, 1.0, 1.0, 1.0), ("b", 4, 0.0, 0.0, 0.0)], "block string, id long, x double, y double, z double")
    got = {(r.block, r.id): (r.merged, r.x, r.y, r.z) for r in merges.merged_points(p, blocks).collect()}
    assert got == {("b", 4): (1, 1.0, 0.0, 0.0), ("b", 9): (2, 3.0, 2.0, 2.0), ("a", 1): (3, 0.0, 1.0, 5.0)}
    images = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "block string, camera long")
    bad = blocks.withColumn("scale", F.when(F.col("block") == "b", float("nan")).otherwise(F.col("scale")))
    told = {(r.block, r.camera, r.problem) for r in merges.merge_problems(bad, images).collect()}
    assert told == {("b", None, "transform"), ("c", 2, "no block"), ("a", 1, "overlap")}
    assert merges.merged_points(p.limit(0), blocks).count() == 0


def test_copies_of_triangles_count_once_and_are_not_broadcast(spark):
    flat = [-1.0, -1.0, 0.0, 1.0, -1.0, 0.0, 0.0, 2.0, 0.0]
    a = spark.createDataFrame([(k, *flat) for k in range(9, 40)] + [(2, *[9.0] * 9)], MESH)
    b = a.select((F.col("id") + 100).alias("id"), *[(F.col(c) + 0.5 * c.endswith("z")).alias(c) for c in CORNERS])
    assert sorted(r.id for r in meshes._known(a).collect()) == [2, 9]
    got = meshes.least_distance(a, b, 1.0).collect()[0]
    assert (got.d2, got.side, got.id, got.triangle) == (0.25, 0, 2, 102)
    found = meshes.within(spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "sid long, sx double, sy double, sz double"), a, 2.0)
    assert found._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin") == 0
    assert [(r.tid, r.d2) for r in found.collect()] == [(9, 1.0)]


def test_far_points_meet_few_triangles(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    at = rnd.uniform(0, 1000, (600, 1, 3)) * [1, 1, 0.1] + rnd.uniform(0, 9, (600, 3, 3))
    m = spark.createDataFrame([(k, *map(float, t.ravel())) for k, t in enumerate(at)], MESH)
    source = np.concatenate([rnd.uniform(-50, 1050, (60, 3)), rnd.uniform(-1e6, 1e6, (60, 3)), at[:9, 0]])
    p = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(source)], "id long, x double, y double, z double")
    pairs, real = [], meshes.with_distance
    monkeypatch.setattr(meshes, "with_distance", lambda df: pairs.append(df.count()) or real(df))
    got = {r.sid: r for r in meshes.nearest_triangles(p, m, 128.0).collect()}
    assert len(got) == len(source) and sum(pairs) < len(source) * len(at) / 5
    for k, x in enumerate(source):
        every = [nearest_on(x, *t) for t in at]
        assert got[k].d2 == pytest.approx(min(every), rel=1e-6, abs=1e-9) and every[got[k].tid] == pytest.approx(min(every), rel=1e-6, abs=1e-9)
