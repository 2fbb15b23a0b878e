"""Wall thickness of meshes (body, face, id, ax .. cz) by rays from their surfaces inwards.

Samples are dealt to triangles by area and spread by a low-discrepancy sequence.
Rays walk through the cells of grids: a triangle lies in the grid whose cells are about
its size, so it touches few of them, and a ray visits, in each grid that a body
uses, the cells between two distances. These are rows, joined with triangles by
cell, and the first hit is an aggregate. The distance grows by rounds, and only rays
without a hit go on. Triangles with equal corners, in the same order, are copies of a shape: rays meet shapes, and the
rays from the middles of copies are one ray.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import cross, dot
from geoloom.operators.sampling import running_total_by
from geoloom.session import stored

#: Most samples of a body, and of a unit of area; steps of the sequence; the
#: band along a sharp edge as a multiple of the wall and at least; slack of the ray test.
BUDGET, DENSITY = 12_000, 64.0
PLASTIC = 1.324717957244746
BAND_FACTOR, BAND_LEAST = 2.0, 0.5
FLAT, EDGE = 1e-18, 1e-9
#: Shares that sum to a whole number but for this are that number, in any order of summation.
WHOLE = 1e-9
#: Cells, in the finest grid, that a ray walks in the first round; the distance grows so much a round.
FIRST_CELLS, GROWTH = 4.0, 4.0
_CORNERS = [f"{c}{k}" for c in "abc" for k in "xyz"]


def _corner(c: str) -> list[Column]:
    return [F.col(f"{c}{k}") for k in "xyz"]


def _minus(p: list[Column], q: list[Column]) -> list[Column]:
    return [p[k] - q[k] for k in range(3)]


def shaped(mesh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triangles (body, face, id, area, shape) with known corners, and their shapes (body, shape, shape_face, edge_id,
    edge_face, ax .. cz, nx .. nz, area).

    A shape is named by the smallest id that has it; ``edge_id`` is the smallest of those with a face.
    """
    known = mesh.dropna(subset=_CORNERS).where("body is not null").withColumn("hash", F.xxhash64("body", *_CORNERS))
    same = Window.partitionBy("hash", "body", *_CORNERS)  # the hash goes first, so sorting seldom compares the rest
    faced = F.when(F.col("face").isNotNull(), F.col("id"))
    n = cross(_minus(_corner("b"), _corner("a")), _minus(_corner("c"), _corner("a")))
    t = known.withColumns(dict(zip(("nx", "ny", "nz"), n))).withColumn("area", F.sqrt(dot(_corner("n"), _corner("n"))) / 2)
    t = t.withColumns({"shape": F.min("id").over(same), "edge_id": F.min(faced).over(same), "edge_face": F.min_by("face", faced).over(same)})
    t = stored(t.select("body", "face", "id", "area", "shape", "edge_id", "edge_face", *_CORNERS, "nx", "ny", "nz"), "triangles")
    s = t.where("id = shape").drop("id").withColumnRenamed("face", "shape_face")
    s = s.withColumns({f"n{k}": F.try_divide(F.col(f"n{k}"), 2 * F.col("area")) for k in "xyz"})
    return t.select("body", "face", "id", "area", "shape"), stored(s, "shapes")


def _bodies(triangles: DataFrame, shapes: DataFrame) -> DataFrame:
    """(body, total area, triangles, diagonal of its box) of bodies with an area."""
    ends = {k: (F.min(F.least(*[f"{c}{k}" for c in "abc"])), F.max(F.greatest(*[f"{c}{k}" for c in "abc"]))) for k in "xyz"}
    sides = [high - low for low, high in ends.values()]
    boxes = shapes.groupBy("body").agg(F.sqrt(dot(sides, sides)).alias("diagonal"))
    return stored(triangles.groupBy("body").agg(F.sum("area").alias("total"), F.count("*").alias("n_triangles")).where("total > 0").join(boxes, "body"), "bodies")


def sampled(triangles: DataFrame, bodies: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(body, face, id, area, shape, k, first): the triangles with ``k`` samples, and, of those with more than one,
    ``first``, the place of their samples in the sequence.

    Samples go to triangles in the order of ids, by area with what is left over carried on; the
    largest triangle of a face that has none gets one. Triangles without an area have none.
    """
    m = triangles.join(bodies.select("body", "total"), "body")
    m = m.withColumn("share", F.col("area") * F.least(F.lit(float(budget)) / F.col("total"), F.lit(DENSITY))).drop("total")
    m = running_total_by(m, ["body"], ["id"], "share", "run", "before")
    m = m.withColumn("k", F.greatest(F.lit(0), F.floor(F.col("run") + WHOLE) - F.floor(F.col("before") + WHOLE)).cast("long"))
    m = stored(m.select("body", "face", "id", "area", "shape", "k"), "dealt")
    top = F.max(F.struct("area", (-F.col("id")).alias("last"), "shape"))
    bare = m.where("face is not null").groupBy("body", "face").agg(F.sum("k").alias("all"), top.alias("top")).where("all = 0 and top.area > 0")
    lone = bare.select("body", "face", (-F.col("top.last")).alias("id"), "top.area", "top.shape", F.lit(1).cast("long").alias("k"))
    many = running_total_by(m.where("k > 1"), ["body"], ["id"], "k", "after", "first").drop("after")
    one = m.where("k = 1").unionByName(lone).withColumn("first", F.lit(0).cast("long"))
    return one.unionByName(many.select(*one.columns))


def rays(samples: DataFrame, shapes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(body, ray, s, shape, ox .. dz, eps, diagonal, n_triangles): the inward rays of the samples.

    A triangle's only sample is its middle: that ray is named by the shape, with -1 for ``s``. Others by the triangle's id.
    """
    many = samples.where("k > 1").select("body", F.col("id").alias("ray"), "shape", "k", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("s"))
    one = samples.where("k = 1").select("body", F.col("shape").alias("ray"), "shape", "k", F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("s")).distinct()
    r = many.unionByName(one).join(shapes, ["body", "shape"]).where("area > 0").join(bodies.drop("total"), "body")
    i = F.col("first") + F.col("s") + 1
    u, v = [(F.lit(0.5) + i / g) % 1 for g in (PLASTIC, PLASTIC * PLASTIC)]
    r = r.withColumns({"u": F.when(F.col("k") == 1, 1 / 3).otherwise(u), "v": F.when(F.col("k") == 1, 1 / 3).otherwise(v), "eps": F.greatest(F.lit(1e-5), F.col("diagonal") * 1e-7)})
    over = (F.col("k") > 1) & (F.col("u") + F.col("v") > 1)
    r = r.withColumns({c: F.when(over, 1 - F.col(c)).otherwise(F.col(c)) for c in "uv"})
    w = 1 - F.col("u") - F.col("v")
    o = {f"o{k}": w * F.col(f"a{k}") + F.col("u") * F.col(f"b{k}") + F.col("v") * F.col(f"c{k}") - F.col(f"n{k}") * F.col("eps") for k in "xyz"}
    d = {f"d{k}": -F.col(f"n{k}") for k in "xyz"}
    return r.withColumns(o | d).select("body", "ray", "s", "shape", *o, *d, "eps", "diagonal", "n_triangles")


def _cell_size(level: Column) -> Column:
    """Edge of a grid's cells: the finest are as wide as triangles that share a body's box evenly."""
    return F.col("diagonal") / F.ceil(F.sqrt("n_triangles")) * F.pow(F.lit(2.0), level)


def in_cells(shapes: DataFrame) -> DataFrame:
    """(body, level, cell_x, cell_y, cell_z, hit, hit_face, ax .. cz): at most 3 cells in each direction."""
    extent = F.greatest(*[F.greatest(*[f"{c}{k}" for c in "abc"]) - F.least(*[f"{c}{k}" for c in "abc"]) for k in "xyz"])
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(1e-300)) / _cell_size(F.lit(0))))).cast("int")
    t = shapes.where("area > 0").withColumn("level", level).withColumn("size", _cell_size(F.col("level")))
    for k in "xyz":
        low, high = [f(*[f"{c}{k}" for c in "abc"]) / F.col("size") for f in (F.least, F.greatest)]
        t = t.withColumn(f"cell_{k}", F.explode(F.sequence(F.floor(low - 1e-6), F.floor(high + 1e-6))))
    return t.select("body", "level", "cell_x", "cell_y", "cell_z", F.col("shape").alias("hit"), F.col("shape_face").alias("hit_face"), *_CORNERS)


def walked(segments: DataFrame) -> DataFrame:
    """Rays (ox .. dz, size) between the distances t0 and t1, once for each cell that they cross.

    The distances at which a ray crosses the planes of the grid are sorted, and the
    middle between two following ones lies in the cell.
    """
    s = segments
    for k in "xyz":
        at = [F.floor((F.col(f"o{k}") + F.col(f"d{k}") * F.col(t)) / F.col("size")) for t in ("t0", "t1")]
        low, high = F.least(*at), F.greatest(*at)
        planes = F.when(low < high, F.sequence(low + 1, high)).otherwise(F.expr("cast(array() as array<bigint>)"))
        start, slope = F.col(f"o{k}"), F.col(f"d{k}")
        s = s.withColumn(f"cross_{k}", F.transform(planes, lambda j: (j * F.col("size") - start) / slope))
    ends = F.array_sort(F.concat(F.array("t0", "t1"), "cross_x", "cross_y", "cross_z"))
    s = s.withColumn("ends", ends)
    middles = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: (F.element_at("ends", i) + F.element_at("ends", i + 1)) / 2)
    cell = lambda t: F.struct(*[F.floor((F.col(f"o{k}") + F.col(f"d{k}") * t) / F.col("size")).alias(f"cell_{k}") for k in "xyz"])
    s = s.withColumn("cell", F.explode(F.array_distinct(F.transform(middles, cell))))
    return s.select("*", "cell.*").drop("cell", "ends", "cross_x", "cross_y", "cross_z")


def _met(pairs: DataFrame) -> DataFrame:
    """Pairs of rays (ox .. dz, eps, t1) and triangles that meet beyond eps and before t1, with the distance ``t``.

    What several terms need is a column of its own, and rows go by an empty list: a condition would be
    drawn into the join and work all of it out again for each term.
    """
    e1, e2 = _minus(_corner("b"), _corner("a")), _minus(_corner("c"), _corner("a"))
    d, s = _corner("d"), _minus(_corner("o"), _corner("a"))
    m = pairs.withColumns(dict(zip(("px", "py", "pz", "qx", "qy", "qz"), cross(d, e2) + cross(s, e1))))
    p, q = _corner("p"), _corner("q")
    m = m.withColumns({"det": dot(e1, p), "along_u": dot(s, p), "along_v": dot(d, q), "along_t": dot(e2, q)})
    m = m.withColumns({k: F.try_divide(F.col(f"along_{k}"), F.col("det")) for k in "uvt"})
    u, v, t = F.col("u"), F.col("v"), F.col("t")
    meets = (F.abs("det") >= FLAT) & (u >= -EDGE) & (u <= 1 + EDGE) & (v >= -EDGE) & (u + v <= 1 + EDGE) & (t > F.col("eps")) & (t < F.col("t1"))
    return m.withColumn("met", F.explode(F.when(meets, F.array(t)))).drop("t").withColumnRenamed("met", "t")


def first_hits(left: DataFrame, shapes: DataFrame) -> DataFrame:
    """(body, ray, s, hit, hit_face, t): the first triangle, not of its own shape, that each ray meets beyond eps.

    Rays that leave the mesh have no row. Ties go to the smaller id.
    """
    cells = stored(in_cells(shapes), "cells")
    levels = cells.select("body", "level").distinct()
    key = ["body", "ray", "s"]
    finest = _cell_size(F.lit(0))
    left = left.withColumns({"t0": F.lit(0.0), "t1": finest * FIRST_CELLS})
    done = None
    while True:
        segments = left.join(levels, "body").withColumn("size", _cell_size(F.col("level")))
        steps = walked(segments).drop("diagonal", "n_triangles", "size", "t0")
        # a cell may hold many triangles: copies of them are not sent to all tasks, whatever Spark takes them for
        pairs = steps.join(cells.hint("merge"), ["body", "level", "cell_x", "cell_y", "cell_z"]).where(F.col("hit") != F.col("shape"))
        best = _met(pairs).groupBy(key).agg(F.min(F.struct("t", "hit", "hit_face")).alias("m"))
        found = stored(best.select(*key, "m.hit", "m.hit_face", "m.t"), "hits")
        done = found if done is None else done.unionByName(found)
        over = F.col("t1") > F.col("diagonal") * 1.01
        left = left.where(~over).join(found.select(key), key, "left_anti").withColumns({"t0": F.col("t1") * (1 - 1e-9), "t1": F.col("t1") * GROWTH})
        left = stored(left, "rays")
        if left.isEmpty():
            return done


def shape_edges(shapes: DataFrame) -> DataFrame:
    """(body, shape, one, px .. qz): the edges of shapes, and of each edge the face of its triangle of smallest id and
    that triangle's corners; corners are equal to 1e-6."""
    sides = []
    for p, q in ("ab", "bc", "ca"):
        ends = [F.struct(*[F.col(f"{c}{k}").alias(k) for k in "xyz"]) for c in (p, q)]
        keys = [F.struct(*[F.round(F.col(f"{c}{k}"), 6).alias(k) for k in "xyz"]) for c in (p, q)]
        sides.append(F.struct(F.least(*keys).alias("low"), F.greatest(*keys).alias("high"), ends[0].alias("p"), ends[1].alias("q")))
    e = shapes.where("edge_id is not null").select("body", "shape", "edge_id", "edge_face", F.explode(F.array(*sides)).alias("e"))
    e = e.select("body", "shape", "edge_id", "edge_face", *[F.col(f"e.{end}.{k}").alias(f"{end}_{k}") for end in ("low", "high") for k in "xyz"], *[F.col(f"e.{c}.{k}").alias(f"{c}{k}") for c in "pq" for k in "xyz"])
    key = ["body", *[f"{end}_{k}" for end in ("low", "high") for k in "xyz"]]
    firsts = e.groupBy(key).agg(F.min_by("edge_face", "edge_id").alias("one"), *[F.min_by(f"{c}{k}", "edge_id").alias(f"{c}{k}") for c in "pq" for k in "xyz"])
    return e.select(*key, "shape").join(firsts, key).drop(*key[1:])


def _to_edge() -> Column:
    along, edge = _minus(_corner("o"), _corner("p")), _minus(_corner("q"), _corner("p"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(along, edge), dot(edge, edge)), F.lit(0.0))))
    off = [along[k] - at * edge[k] for k in range(3)]
    return F.sqrt(dot(off, off))


def _near_edges(across: DataFrame, triangles: DataFrame, shapes: DataFrame, band: float) -> DataFrame:
    """(body, id, s) of samples (body, face, id, s, hit_face, ox, oy, oz) within the band of an edge at which the two faces meet.

    Faces meet at an edge where one of them has the edge's smallest id and the other any triangle there.
    """
    edges = stored(shape_edges(shapes), "edges")
    ones = edges.select("body", F.col("one").alias("face")).distinct()
    at = ["body", "id", "s", "ox", "oy", "oz"]
    from_own = across.select(*at, "face", F.col("hit_face").alias("one"))
    from_hit = across.join(ones, ["body", "face"], "left_semi").select(*at, F.col("hit_face").alias("face"), F.col("face").alias("one"))
    faces = triangles.where("face is not null").select("body", "face", "shape")
    met = from_own.unionByName(from_hit).join(faces, ["body", "face"]).join(edges, ["body", "shape", "one"])
    return met.where(_to_edge() < band).select("body", "id", "s").distinct()


def thickness(mesh: DataFrame, least_wall: float, budget: int = BUDGET) -> DataFrame:
    """(body, face, id, area, s, thickness, wedge) of every sample whose ray meets the mesh again.

    ``wedge`` marks samples near a sharp edge, whose ray meets the face across that edge: no walls.
    """
    triangles, shapes = shaped(mesh)
    bodies = _bodies(triangles, shapes)
    samples = stored(sampled(triangles, bodies, budget), "samples")
    every = stored(rays(samples, shapes, bodies), "rays")
    met = first_hits(every, shapes.join(bodies, "body")).select("body", "ray", "s", "hit_face", "t")
    met = every.join(met, ["body", "ray", "s"]).select("body", "ray", F.col("s").alias("ray_s"), "hit_face", (F.col("t") + F.col("eps")).alias("thickness"), "ox", "oy", "oz")
    own = samples.select("body", "face", "id", "area", "shape", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("s"))
    single = F.col("k") == 1
    own = own.withColumns({"ray": F.when(single, F.col("shape")).otherwise(F.col("id")), "ray_s": F.when(single, -1).otherwise(F.col("s"))})
    hits = stored(own.join(met, ["body", "ray", "ray_s"]).drop("ray", "ray_s", "shape", "k"), "hits")
    near = _near_edges(hits.where("face <> hit_face"), triangles, shapes, max(BAND_FACTOR * least_wall, BAND_LEAST))
    marked = hits.join(near.withColumn("near", F.lit(True)), ["body", "id", "s"], "left").withColumn("wedge", F.coalesce("near", F.lit(False)))
    return marked.select("body", "face", "id", "area", "s", "thickness", "wedge")


def wall_report(samples: DataFrame, least_wall: float) -> DataFrame:
    """(body, samples, thin, wedge_samples, min_thickness) of the bodies that have samples."""
    wall = ~F.col("wedge")
    return samples.groupBy("body").agg(
        F.count_if(wall).alias("samples"), F.count_if(wall & (F.col("thickness") < least_wall)).alias("thin"),
        F.count_if("wedge").alias("wedge_samples"), F.min(F.when(wall, F.col("thickness"))).alias("min_thickness"),
    )


def thin_faces(samples: DataFrame, least_wall: float) -> DataFrame:
    """(body, face, area of its thin triangles, least thickness)."""
    thin = samples.where(~F.col("wedge") & (F.col("thickness") < least_wall) & F.col("face").isNotNull())
    each = thin.groupBy("body", "face", "id").agg(F.first("area").alias("area"), F.min("thickness").alias("least"))
    return each.groupBy("body", "face").agg(F.sum("area").alias("area"), F.min("least").alias("min_thickness"))
