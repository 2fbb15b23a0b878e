"""Operators on small fixtures with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import batch, documents, filters, fits, graphs, grids, joins, sampling, stats


def cloud(spark, rows):
    return spark.createDataFrame([(k, float(x), float(y), float(z), c) for k, (x, y, z, c) in enumerate(rows)], "id long, x double, y double, z double, cls int")


def scene(spark):
    rows = [(i % 5 if i < 15 else 10, i // 5, 300 if i == 4 else 5 * (i % 5 if i < 15 else 10), 1) for i in range(20)]
    return cloud(spark, rows)


def test_scope_and_histogram(spark):
    p = scene(spark)
    box = {"centre": (2.0, 1.0, 10.0), "half": (2.0, 1.0, 10.0)}
    assert filters.scoped(p, [1], box).count() == 14
    assert filters.scoped(p, [2]).count() == 0
    assert filters.scoped(p, [1], box, keep_inside=False).count() == 6
    with pytest.raises(ValueError):
        filters.scoped(p, [])
    assert stats.class_histogram(p).collect()[0]["n"] == 20


def test_segments(spark):
    p = cloud(spark, [(x, y, 0, x % 2) for x in range(5) for y in range(5)])
    ring = [(1.0, 1.0, 0.0), (3.0, 1.0, 0.0), (3.0, 3.0, 0.0), (1.0, 3.0, 0.0)]
    inside = G.in_prism(filters.xyz(), ring, (0.0, 0.0, 2.0))
    assert filters.segmented(p, inside, [0, 1]).count() == 9
    assert filters.segmented(p, inside, [0, 1], keep=False).count() == 16
    assert filters.segmented(p, inside, [0]).count() == 10 + 3  # odd classes are hidden and stay
    with pytest.raises(ValueError):
        filters.segmented(p, F.lit(True), [0, 1], strict=True)
    assert p.where(G.in_prism(filters.xyz(), ring, (1.0, 0.0, 0.0))).count() == 0
    low = p.where(G.in_frustum(filters.xyz(), (2.0, 2.0, -1.0), [(a, b, 1.0) for a, b, _ in ring])).count()
    high = p.withColumn("z", F.lit(3.0)).where(G.in_frustum(filters.xyz(), (2.0, 2.0, -1.0), [(a, b, 1.0) for a, b, _ in ring])).count()
    assert low < high


def test_pruned_nodes(spark):
    n = spark.createDataFrame([("r", 0), ("r0", 0), ("r01", 3), ("r1", 0)], "name string, n long")
    assert {r.name for r in filters.pruned_nodes(n).collect()} == {"r", "r0", "r01"}


def test_opening_equals_numpy(spark):
    rnd = random.Random(3)
    w, h, r = 13, 9, 2
    a = np.array([[rnd.randint(0, 50) if rnd.random() > 0.1 else np.nan for _ in range(w)] for _ in range(h)])
    g = spark.createDataFrame([(c, q, None if np.isnan(a[q, c]) else float(a[q, c])) for q in range(h) for c in range(w)], "col int, row int, value double")

    def extreme(m, f):
        out = np.full_like(m, np.nan)
        for q in range(h):
            for c in range(w):
                part = m[max(0, q - r) : q + r + 1, max(0, c - r) : c + r + 1]
                if not np.isnan(part).all():
                    out[q, c] = f(part)
        return out

    want = extreme(extreme(a, np.nanmin), np.nanmax)
    got = {(x.col, x.row): x.opened for x in grids.opening(g, r).collect()}
    assert all(got[c, q] == want[q, c] for q in range(h) for c in range(w))
    filled = {(x.col, x.row): x.value for x in grids.inpainted(g, 13).collect()}
    for (c, q), v in filled.items():
        if np.isnan(a[q, c]):
            near = min(((d - c) ** 2 + (e - q) ** 2, e, d) for e in range(h) for d in range(w) if not np.isnan(a[e, d]))
            assert v == a[near[1], near[2]]
        else:
            assert v == a[q, c]


def test_ground_on_ramp_with_boxes(spark):
    rnd = random.Random(7)
    rows, roofs = [], []
    for x in range(0, 70):
        for y in range(0, 60):
            ground = 100 + 0.15 * x + 0.03 * rnd.gauss(0, 1)
            box = next((hgt for cx, cy, s, hgt in ((8, 8, 2, 3), (24, 12, 6, 6), (45, 20, 12, 10)) if abs(x - cx) <= s / 2 and abs(y - cy) <= s / 2), 0)
            roofs.append(bool(box))
            rows.append((x, y, ground + box, 1))
    got = {r.id: r.is_ground for r in grids.ground(cloud(spark, rows), 1.0, 18.0, 0.15, 0.5).collect()}
    assert not any(got[k] for k, roof in enumerate(roofs) if roof)
    assert sum(got[k] for k, roof in enumerate(roofs) if not roof) >= 0.98 * roofs.count(False)


def test_residual_summary_of_nothing(spark):
    assert list(grids.residual_summary(spark.createDataFrame([], "residual double")).first()) == [0, 0.0, 0.0, 0.0, 0.0]


def test_samples_equal_sequential(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 60) / 2, rnd.randint(0, 60) / 2, rnd.randint(0, 8) / 2, 1) for _ in range(300)]
    kept = []
    for k, (x, y, z, _) in enumerate(rows):
        if all((x - rows[j][0]) ** 2 + (y - rows[j][1]) ** 2 + (z - rows[j][2]) ** 2 >= 9 for j in kept):
            kept.append(k)
    assert sorted(r.id for r in sampling.distance_sample(cloud(spark, rows), 3.0).collect()) == kept
    n = sampling.random_sample(spark.range(20_000), 25).count()
    assert abs(n - 5000) < 300
    assert sampling.random_sample(spark.range(10), 0).count() == 0
    assert sampling.farthest_points(cloud(spark, [(0, 0, 0, 1), (1, 0, 0, 1), (9, 0, 0, 1), (4, 0, 0, 1)]), 3) == [0, 2, 3]


def test_frames(spark):
    f = spark.createDataFrame([(1, k, k * 100_000, float(s)) for k, s in enumerate((1, 5, 4, 2, 6, 3))], "video long, frame long, t long, score double")
    got = [r.frame for r in sampling.selected_frames(f, 250_000, 5).orderBy("t").collect()]
    assert got == [1, 4]


def test_neighbours_equal_brute_force(spark):
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 40), rnd.randint(0, 40), rnd.randint(0, 40), 1) for _ in range(150)] + [(900, 900, 900, 1)]
    p = cloud(spark, rows)
    got = {}
    for r in joins.nearest_neighbours(p, p, 3, 4.0).collect():
        got.setdefault(r.sid, []).append((r.d2, r.tid))
    for i, a in enumerate(rows):
        want = sorted((sum((a[k] - b[k]) ** 2 for k in range(3)), j) for j, b in enumerate(rows))[:3]
        assert sorted(got[i]) == want
    ray = joins.nearest_to_ray(p, (900.0, 899.0, 0.0), (0.0, 0.0, 1.0), 2.0).first()
    assert (ray["id"], ray["off2"]) == (150, 1.0)


def test_inherited(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "id long, parent long")
    values = spark.createDataFrame([(3, "a", "far"), (2, "a", "near"), (4, "a", "other"), (3, "b", "x")], "id long, name string, value string")
    got = {(r.id, r.name): (r.value, r.conflict) for r in joins.inherited(edges, values).collect()}
    assert got[1, "a"][1] and got[1, "b"] == ("x", False) and got[2, "a"] == ("near", False)


def test_fits(spark):
    pairs = [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3), (4, 1, 2)]
    rows = [(*map(float, p), *(100.0, 100.0, 100.0), 0.01) if k == 4 else (*map(float, p), 10 - 2.0 * p[1], 20 + 2.0 * p[0], 5 + 2.0 * p[2], 1.0) for k, p in enumerate(pairs)]
    f = fits.robust_pairs(spark.createDataFrame(rows, "sx double, sy double, sz double, tx double, ty double, tz double, w double"), 0.05)
    assert abs(f["scale"] - 2) < 0.1 and np.allclose(f["shift"], (10, 20, 5), atol=0.1)
    one = spark.createDataFrame([(4.0, -2.0, 8.0, 104.0, 18.0, 5.0, 1.0)], "sx double, sy double, sz double, tx double, ty double, tz double, w double")
    assert np.allclose(fits.robust_translation(one, 1.0)["shift"], (100, 20, -3))
    flat = cloud(spark, [(0, 0, 0, 1), (1, 0, 0, 1), (0, 1, 0, 1), (1, 1, 0, 1), (3, 2, 0, 1)]).withColumn("w", F.lit(1.0))
    assert abs(fits.plane(flat)["normal"][2]) > 0.95
    ring = cloud(spark, [(3 + 2 * math.cos(t), 1 + 2 * math.sin(t), 4, 1) for t in range(6)])
    c = fits.circle(ring)
    assert np.allclose((c["x"], c["y"], c["z"], c["radius"]), (3, 1, 4, 2))


def test_icp(spark):
    src = [(0, 0, 0, 1), (1, 0, 0, 1), (0, 1, 0, 1), (0, 0, 1, 1)]
    s, t = cloud(spark, src), cloud(spark, [(x + 0.1, y - 0.05, z + 0.02, 1) for x, y, z, _ in src])
    r = fits.icp(s, t, 0.5)
    assert r["accepted"] and r["matched"] == 4 and np.allclose(r["shift"], (0.1, -0.05, 0.02))
    with pytest.raises(ValueError):
        fits.icp(s, t, 0.5, normals=True)
    with pytest.raises(ValueError):
        fits.icp(s, cloud(spark, [(50, 50, 50, 1)]), 0.5)


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (5, 5)], "a long, b long")
    assert {(r.node, r.component) for r in graphs.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    d = spark.createDataFrame([(1, 2), (2, 3)], "source long, target long")
    assert graphs.cyclic(d).isEmpty()
    assert graphs.cyclic(d.union(spark.createDataFrame([(3, 1)], d.schema))).count() == 3
    p = cloud(spark, [(x, y, 0, 1) for x in range(8) for y in range(8)])
    leaves = graphs.octree_leaves(p, 8.0, 4).collect()
    assert sum(r.n for r in leaves) == 64 and max(r.n for r in leaves) <= 4


def test_tiles(spark):
    t = spark.createDataFrame([(1, None, 8.0, 1.0, "replace"), (2, 1, 2.0, 1.0, "replace"), (3, 1, 8.0, 1.0, "add"), (4, 3, 1.0, 1.0, "replace")], "tile long, parent long, error double, distance double, refine string")
    assert {r.tile for r in graphs.visible_tiles(t, 4.0).collect()} == {2, 3, 4}


def test_mesh(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 6.0, 0.0, 0.0), (2, 0.0, 6.0, 0.0), (3, 0.0, 0.0, 6.0)], "id long, x double, y double, z double")
    t = spark.createDataFrame([(1, 0, 2, 1), (2, 0, 1, 3), (3, 0, 3, 2), (4, 1, 2, 3)], "face int, a long, b long, c long")
    assert stats.mesh_volume(stats.corners(t, v)).first()[0] == 216.0
    assert stats.manifold_statistics(t).first()["watertight"]
    assert not stats.manifold_statistics(t.where("face > 1")).first()["watertight"]
    assert stats.overhangs(stats.corners(t, v)).count() == 0  # the bottom lies on the plate
    up = v.withColumn("z", F.col("z") + 1)
    assert stats.overhangs(stats.corners(t, up)).first()["area2"] == 36.0


def test_fusion_and_blend(spark):
    s = spark.createDataFrame([(k, k % 2, 0.1 * (k // 2), 0.0, 0.0, 0.0, 0.0, 1.0, 10.0, 20.0, 30.0, 1.0, 0.2) for k in range(4)], "ordinal long, view int, x double, y double, z double, nx double, ny double, nz double, red double, green double, blue double, confidence double, footprint double")
    got = stats.fused(s, 1.0).collect()
    assert sum(r.n for r in got) == 4 and all(r.n <= 2 for r in got)
    b = spark.createDataFrame([(1, 7, 1, 1.0, 10.0), (1, 8, 2, 3.0, 20.0)], "cell int, camera int, rank int, q double, c double")
    assert list(stats.blended(b).first()) == [1, 17.5, 20.0, 10.0]


def test_documents(spark):
    state = spark.createDataFrame([(1, 0, "a", "", False), (2, 3, "b", "", True)], "id long, revision int, body string, hash string, deleted boolean")
    m = spark.createDataFrame([(1, "create", 0), (2, "update", 3), (3, "delete", 0), (4, "create", 1)], "entity long, op string, revision int")
    assert {tuple(r) for r in documents.problems(state, m).collect()} == {(1, "exists"), (2, "deleted"), (3, "missing"), (4, "revision")}
    e = spark.createDataFrame([(1, "name", "a", "b")], "entity long, field string, before string, after string")
    now = spark.createDataFrame([(1, "name", "c")], "entity long, field string, value string")
    assert documents.undo_conflicts(e, now).count() == 1
    assert documents.compensation(e).first()["after"] == "a"
    w = spark.createDataFrame([(1, "layer", None, []), (2, "x", 1, [1]), (3, "x", 9, [2])], "id long, type string, owner long, layers array<long>")
    assert {tuple(r) for r in documents.orphans(w).collect()} == {(3, "owner"), (3, "layer")}


def test_batch(spark):
    assert batch.topological({"c": ["a"], "a": [], "b": ["a"]}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        batch.topological({"a": ["b"], "b": ["a"]})
    n = {"a": {"enabled": False, "makes": ["x"], "needs": []}, "b": {"enabled": True, "makes": [], "needs": [("a", "y")]}}
    assert batch.graph_problems(n) == [("b", "a does not make y"), ("b", "a is disabled")]
    one, two = batch.lineage(n, {"a": "1"}), batch.lineage(n, {"a": "2"})
    assert one["b"] != two["b"]
    assert batch.sweep(spark, {"a": batch.axis(1, 2, 3), "b": batch.axis(4, 5, 6)}, {"a": 2, "b": 5}).count() == 5
    with pytest.raises(ValueError):
        batch.sweep(spark, {c: batch.axis(1, 2, 3) for c in "abcd"}, {}, "all")
    j = spark.createDataFrame([(1, 1, "queued", 0), (1, 2, "completed", 0), (2, 1, "running", 5), (2, 2, "running", 3)], "job int, sequence int, state string, progress int")
    assert {(r.job, r.problem) for r in batch.illegal_transitions(j).collect()} == {(1, "transition"), (2, "progress")}


def test_expressions(spark):
    r = spark.createDataFrame([(0, 5, 3.0)], "den long, num long, r double").select(G.per_mille(F.col("num"), F.col("den")), G.per_mille(F.col("num"), F.col("num") + 1), G.huber(F.col("r"), 1.5), G.in_range(F.col("r"), 3.0, None), F.size(G.circle_points(F.lit(0.0), F.lit(0.0), F.col("r"), 0.1, 1.0))).first()
    assert list(r) == [0, 833, 0.5, True, 19]
    m = [0.0, 2.0, 0.0, 0.0, -2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 8.0, 16.0, 4.0, 1.0]
    assert np.allclose(G.compose(m, G.inverse(m)), np.eye(4).ravel())
