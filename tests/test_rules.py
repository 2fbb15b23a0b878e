"""Rules with known answers: pair quality, rescue, positions, masks, control, prints, edits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import batch, control, documents, fits, grids, imagery, sampling, solids, stats
from geoloom.sources import readers
from geoloom.streaming import streams

PAIR = "tentative int, verified int, homography int, cheirality int, cells int, cell_count int, parallax int, cycle int"


def pair(spark, *values):
    return spark.createDataFrame([values], PAIR)


def test_pair_quality(spark):
    good = stats.pair_quality(pair(spark, 100, 70, 20, 65, 14, 16, 2500, 950)).first()
    assert good["quality"] == "strong" and good["score"] == (3 * 700 + 2 * 875 + 2 * 1000 + 2 * 928 + 950) // 10
    flat = stats.pair_quality(pair(spark, 100, 80, 78, 75, 15, 16, 200, 900)).first()
    assert flat["quality"] == "degenerate" and flat["flat"]
    assert stats.pair_quality(pair(spark, 100, 20, 5, 15, 4, 16, 300, 0)).first()["quality"] == "usable"
    assert stats.pair_problems(pair(spark, 10, 20, 5, 15, 4, 16, 300, 0)).first()["problem"] == "inlier counts"
    assert stats.pair_problems(pair(spark, 10, 5, 5, 5, 4, 0, 300, 0)).first()["problem"] == "grid occupancy"


def test_rescue(spark):
    graph = {"profile": F.lit("fast"), "executed": F.array(F.lit("sift")), "first_degree": F.lit(1), "second_degree": F.lit(3), "bridge": F.lit(True), "expected": F.lit(True), "failed": F.lit(False)}
    weak = stats.pair_quality(pair(spark, 40, 8, 3, 7, 2, 16, 500, 500)).withColumns(graph)
    got = stats.rescue(weak).first()
    assert got["actions"] == ["aliked", "dedode", "dense", "expand_graph"]
    assert got["reasons"] == ["weak_pair_quality", "underconnected_image", "weak_component_bridge", "expected_overlap_missing"]
    fine = stats.pair_quality(pair(spark, 100, 70, 20, 65, 14, 16, 2500, 950)).withColumns(graph | {"first_degree": F.lit(2)})
    assert stats.rescue(fine).first()["actions"] == []


def test_positions(spark):
    rows = [(0.5, 1.0, True), (0.05, 1.0, True), (1.6, 1.0, True), (9.0, 1.0, False), (1.0, 11.0, True), (0.0, None, False)]
    got = streams.position_tiers(spark.createDataFrame(rows, "accuracy double, correction_age double, dual_frequency boolean")).collect()
    assert [r.tier for r in got] == ["ntrip_float"] * 4 + ["dual_frequency", "consumer"]
    assert [r.sigma_h for r in got] == [0.5, 0.15, 1.5, 1.5, 3.0, 5.0]
    assert [round(r.sigma_v, 3) for r in got] == [0.95, 0.285, 3.0, 3.0, 1.8, 9.0]


def test_job_states(spark):
    history = [(1, k, s, 0) for k, s in enumerate(["queued", "running", "pause_requested", "paused", "running", "cancel_requested", "cancelled"])]
    history += [(2, 0, "running", 0), (2, 1, "cancelled", 0), (3, 0, "completed", 0), (3, 1, "running", 0)]
    got = batch.illegal_transitions(spark.createDataFrame(history, "job int, sequence int, state string, progress int")).collect()
    assert sorted((r.job, r.problem) for r in got) == [(2, "transition"), (3, "transition")]


def test_icp_with_an_outlier(spark):
    rnd = random.Random(4)
    src = [(rnd.uniform(0, 5), rnd.uniform(0, 5), rnd.uniform(0, 5)) for _ in range(60)]
    frame = lambda rows: spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, x double, y double, z double")
    off = [(x + 0.05, y, z) for x, y, z in src]
    off[:6] = [(x + 0.05, y + 0.4, z) for x, y, z in src[:6]]
    r = fits.icp(frame(src), frame(off), 0.6, delta=0.02)
    assert np.allclose(r["shift"], (0.05, 0, 0), atol=0.02)


def test_polygon_boundary_and_holes(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    p = spark.createDataFrame([(2.0, 0.5), (2.0, 2.0), (0.0, 2.0), (4.0, 4.0), (5.0, 1.0), (2.0, 1.0)], "x double, y double")
    assert [r.ok for r in p.select(G.in_polygon(F.col("x"), F.col("y"), ring).alias("ok")).collect()] == [True, False, True, True, False, True]


def test_spaced_equals_a_walk(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.randint(0, 3), rnd.uniform(0, 20), rnd.uniform(0, 20), rnd.random()) for k in range(400)]
    for closed in (False, True):
        kept = []
        for k, g, x, y, _ in sorted(rows, key=lambda r: r[4]):
            if all(h != g or (math.hypot(x - a, y - b) > 2 if closed else math.hypot(x - a, y - b) >= 2) for _, h, a, b, _ in kept):
                kept.append((k, g, x, y, 0))
        got = sampling.spaced(spark.createDataFrame(rows, "id long, g int, x double, y double, o double"), 2.0, "xy", "o", "g", closed)
        assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in kept)
    line = spark.createDataFrame([(k, float(k), 0.0) for k in range(40)], "id long, x double, y double")
    assert sorted(r.id for r in sampling.spaced(line, 1.5, "xy", "id").collect()) == list(range(0, 40, 2))
    assert sampling.spaced(line.limit(0), 1.5, "xy", "id").count() == 0


def test_merged_features_equal_a_walk(spark):
    rnd = random.Random(3)
    rows = [(k % 2, k % 4, k, rnd.randint(0, 40) / 2, rnd.randint(0, 40) / 2, 10.0 * (k % 4 % 2), 10.0 * (k % 4 // 2), None if k == 4 else float(rnd.randint(0, 9)), float(rnd.randint(0, 9))) for k in range(200)]
    f = spark.createDataFrame(rows, "image int, tile int, id long, x double, y double, origin_x double, origin_y double, score double, proxy double")
    got = {}
    for r in imagery.merged_tile_features(f, 30).collect():
        got.setdefault(r.image, []).append(r.id)
    for image in (0, 1):
        mine = [r for r in rows if r[0] == image]
        use = 7 if all(r[7] is not None for r in mine) else 8
        kept = []
        for r in sorted(mine, key=lambda r: (-r[use], r[3] + r[5], r[4] + r[6], r[1], r[2])):
            x, y = r[3] + r[5], r[4] + r[6]
            if all((x - a) ** 2 + (y - b) ** 2 > 4 for _, a, b in kept):
                kept.append((r[2], x, y))
        assert sorted(got[image]) == sorted(k[0] for k in kept[:30])
    with pytest.raises(ValueError):
        imagery.merged_tile_features(f, 0)


def test_brush_order_and_bits(spark):
    s = spark.createDataFrame([(1, 0, True, 2.0, 2.0, 9.0, 2.0, 1.5), (1, 1, False, 5.0, 2.0, 5.0, 2.0, 1.5), (1, 2, True, -5.0, 0.0, -5.0, 0.0, 1.0)], "image int, ordinal int, add boolean, x0 double, y0 double, x1 double, y1 double, radius double")
    got = {(r.x, r.y) for r in imagery.brushed(s, 12, 6).collect()}
    want = set()
    for x in range(12):
        for y in range(6):
            px, py = x + 0.5, y + 0.5
            near = math.hypot(px - min(9, max(2, px)), py - 2) <= 1.5
            want |= {(x, y)} if near and math.hypot(px - 5, py - 2) > 1.5 else set()
    assert got == want and want
    assert imagery.masked_pixels(imagery.mask_words(imagery.brushed(s, 12, 6), 12)).first()["n"] == len(want)


def test_local_estimate_of_a_disturbed_point(spark):
    eye = [1.0, 0, 0, 0, 1, 0, 0, 0, 1]
    cams = spark.createDataFrame([(k, [float(v) for v in eye], 2.0 * k, 0.5 * (k % 2), 0.0, 1000.0, 500.0, 400.0) for k in range(5)], "image int, rotation array<double>, cx double, cy double, cz double, focal double, pu double, pv double")
    true = np.array([3.0, 1.0, 20.0])
    seen = [(7, k, 1000 * (true[0] - 2.0 * k) / 20 + 500, 1000 * (true[1] - 0.5 * (k % 2)) / 20 + 400) for k in range(5)]
    bad = [(*seen[0][:2], seen[0][2] + 40, seen[0][3]), *seen[1:]]
    frame = lambda rows: spark.createDataFrame([(p, i, float(u), float(v)) for p, i, u, v in rows], "point int, image int, u double, v double")
    got = control.local_estimates(frame(seen), cams).first()
    assert np.allclose((got.x, got.y, got.z), true) and got.rms < 1e-6 and got.n == 5 and got.sxx > 0
    off = control.local_estimates(frame(bad), cams, rounds=40).first()
    assert np.linalg.norm(np.array([off.x, off.y, off.z]) - true) < 0.6
    assert control.local_estimates(frame(seen[:1]), cams).first()["problem"] == "too few observations"
    assert control.local_estimates(frame([seen[0], seen[0]]), cams).first()["problem"] == "repeated image"


def test_grid_methods(spark):
    g = spark.createDataFrame([(c, r, float(c * c + 3 * r)) for c in range(6) for r in range(5)], "col int, row int, value double")
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.5, 1.5), (3, 5.0, 4.0), (4, -0.1, 0.0), (5, 0.25, 0.0)], "id int, u double, v double")
    for method in ("nearest", "bilinear", "cubic"):
        got = {r.id: r for r in grids.grid_values(p, g, 6, 5, method).collect()}
        assert got[1].sampled == 10.0 and got[3].sampled == 37.0 and got[4].problem == "outside"
    assert {r.id: r.sampled for r in grids.grid_values(p, g, 6, 5, "cubic").collect()}[2] == 2.5**2 + 4.5  # exact for parabolas
    hole = g.where("not (col = 2 and row = 2)")
    assert {r.id: r.problem for r in grids.grid_values(p, hole, 6, 5, "bilinear").collect()}[2] == "missing"
    with pytest.raises(ValueError):
        grids.grid_values(p, g, 6, 5, "other")


def test_cascade_policies(spark):
    p = spark.createDataFrame([(1.0, 1.0, 5.0), (9.0, 1.0, 5.0)], "x double, y double, z double")
    cols = [F.col(k) for k in "xyz"]
    run = lambda policy: p.select(*[c.alias(k) for c, k in zip(G.cascade(cols, [("height_offset", 2.0)], (0.0, 0.0, 2.0, 2.0), policy), "xyzf")]).collect()
    assert [tuple(r) for r in run("flag")] == [(1.0, 1.0, 7.0, False), (9.0, 1.0, 5.0, True)]
    assert [r.z for r in run("skip")] == [7.0, None]
    with pytest.raises(Exception, match="outside the domain"):
        run("error")
    with pytest.raises(ValueError):
        G.cascade(cols, [("height_offset", float("nan"))])


def test_orientation_of_a_wedge(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 6.0, 0.0, 0.0), (2, 0.0, 6.0, 0.0), (3, 0.0, 0.0, 6.0)], "id long, x double, y double, z double")
    t = spark.createDataFrame([(1, 0, 2, 1), (2, 0, 1, 3), (3, 0, 3, 2), (4, 1, 2, 3)], "face int, a long, b long, c long")
    got = {r.place: r for r in solids.ranked_orientations(solids.orientations(stats.corners(t, v), degrees=30.0)).collect()}
    assert got[0].overhang2 == 0 and got[0].contact2 == 36.0 and got[0].height == 6.0
    assert got[1].overhang2 > 0 and got[1]["rank"] > got[0]["rank"]


def test_commits(spark):
    rows = [(1, 0, "a", 0), (1, 1, "b", 0), (1, 2, "c", 1), (1, 3, "a", 2), (1, 4, "d", 2), (1, 5, "e", 9), (2, 0, "x", 1), (2, 1, "y", 0), (2, 2, "z", 1)]
    got = documents.commits(spark.createDataFrame(rows, "document int, sequence int, command string, base int"))
    assert sorted((r.document, r.sequence) for r in got.where("accepted").collect()) == [(1, 0), (1, 2), (1, 4), (2, 1), (2, 2)]


def test_step_strings_and_repeats(spark, tmp_path):
    (tmp_path / "a.ifc").write_text("HEADER;\n#1=WALL('a;b',(1,2));#2=DOOR('it''s; #9=X()');\n#3 = SLAB(\n 4);\nEND;\n")
    got = {r.id: (r.type, r.args) for r in readers.step_records(spark, str(tmp_path / "a.ifc")).collect()}
    assert got == {1: ("WALL", "'a;b',(1,2)"), 2: ("DOOR", "'it''s; #9=X()'"), 3: ("SLAB", "\n 4")}
    (tmp_path / "b.ifc").write_text("#1=WALL(1);\n#1=DOOR(2);\n")
    with pytest.raises(ValueError):
        readers.step_records(spark, str(tmp_path / "b.ifc"))


def test_limits_are_errors(spark):
    from geoloom.operators import graphs, joins

    chain = spark.createDataFrame([(k, k + 1) for k in range(6)], "id long, parent long")
    with pytest.raises(RuntimeError):
        joins.inherited(chain, spark.createDataFrame([(6, "a", "x")], "id long, name string, value string"), depth=3)
    with pytest.raises(RuntimeError):
        graphs.cyclic(chain.toDF("source", "target"), rounds=2)
    with pytest.raises(ValueError):
        grids.covered(spark.createDataFrame([(1, None)], "cell int, weighted double"))


def test_arcs_and_keys(spark):
    a = spark.range(1).select(G.arc_points(F.lit(1.0), F.lit(2.0), F.lit(5.0), F.lit(0.0), F.lit(math.pi), 0.01).alias("p")).first()["p"]
    assert (a[0].x, a[0].y) == (6.0, 2.0) and abs(a[-1].x + 4) < 1e-9
    assert all(abs(math.hypot((p.x + q.x) / 2 - 1, (p.y + q.y) / 2 - 2) - 5) <= 0.011 for p, q in zip(a, a[1:]))
    names = spark.createDataFrame([("Img10",), ("img9",), ("IMG009b",), ("a",)], "n string")
    assert [r.n for r in names.orderBy(G.natural_key(F.col("n"))).collect()] == ["a", "img9", "IMG009b", "Img10"]


def test_long_chains_and_many_copies_are_thinned_in_few_jobs(spark):
    line = spark.range(400).selectExpr("id", "double(id) as x", "0d as y")
    copies = spark.range(6000).selectExpr("id + 1000 as id", "double(id % 3) * 1.6 + 5000 as x", "0d as y")
    odd = spark.createDataFrame([(8000, None, 0.0), (8001, float("nan"), 0.0), (8002, float("inf"), 0.0), (8003, float("inf"), 0.0)], "id long, x double, y double")
    spark.sparkContext.setJobGroup("spaced", "spaced")
    got = sorted(r.id for r in sampling.spaced(line.unionByName(copies).unionByName(odd), 1.5, "xy", "id").collect())
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("spaced")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == [*range(0, 400, 2), 1000, 1001, 1002, 8000, 8001, 8002, 8003] and len(jobs) < 150
