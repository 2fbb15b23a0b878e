"""Spatial and key joins.

Spatial joins are equi-joins on cell keys with an exact test after, so they
shuffle on the key and never compare all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut


def _d2(a: str, b: str, dims: str = "xyz") -> Column:
    out = F.lit(0.0)
    for k in dims:
        out = out + (F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}"))
    return out


def within(source: DataFrame, target: DataFrame, reach: float, dims: str = "xyz") -> DataFrame:
    """(sid, tid, d2) of pairs nearer than ``reach`` (strictly)."""
    c = [f"c{k}" for k in dims]
    s = source.select(F.col("id").alias("sid"), *[F.col(k).alias(f"s{k}") for k in dims], *[F.floor(F.col(k) / reach).cast("long").alias(f"c{k}") for k in dims])
    t = target.select(F.col("id").alias("tid"), *[F.col(k).alias(f"t{k}") for k in dims], *[F.floor(F.col(k) / reach).cast("long").alias(f"c{k}") for k in dims])
    for k in dims:  # the source visits the cells around its own
        s = s.withColumn(f"c{k}", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), (lambda k: lambda o: F.col(f"c{k}") + o)(k))))
    return s.join(t, c).withColumn("d2", _d2("s", "t", dims)).where(F.col("d2") < reach * reach).select("sid", "tid", "d2")


def nearest_neighbours(source: DataFrame, target: DataFrame, k: int, reach: float, dims: str = "xyz", growth: float = 2.0, rounds: int = 60) -> DataFrame:
    """(sid, tid, d2, rank): the k nearest targets of each source (ties by id), exactly.

    Sources with k targets nearer than the reach are done; the reach of the
    others grows until all are, or until it spans every target.
    """
    left, done = source, None
    span = target.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    n = target.limit(k).count()
    if not n:
        return within(source, target, reach, dims).withColumn("rank", F.lit(0))
    outer = source.agg(*[F.greatest(F.abs(F.max(d)), F.abs(F.min(d))).alias(d) for d in dims]).first()
    far = sum((span[d] or 0) + 2 * abs(outer[d] or 0) for d in dims) + 1 + sum(abs(v) for v in target.agg(*[F.max(F.abs(d)) for d in dims]).first())
    for _ in range(rounds):
        w = Window.partitionBy("sid").orderBy("d2", "tid")
        near = within(left, target, reach, dims).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        near = near.withColumn("found", F.count("*").over(Window.partitionBy("sid"))).where(F.col("found") >= n).drop("found").transform(cut)
        done = near if done is None else done.unionByName(near)
        left = left.join(near.select(F.col("sid").alias("id")).distinct(), "id", "left_anti").transform(cut)
        if reach > far or left.isEmpty():
            return done
        reach *= growth
    raise RuntimeError(f"neighbours were not found in {rounds} rounds")


def nearest_correspondence(source: DataFrame, target: DataFrame, reach: float) -> DataFrame:
    """(sid, tid, d2): the nearest target strictly within reach; the first id wins ties."""
    return within(source, target, reach).groupBy("sid").agg(F.min(F.struct("d2", "tid")).alias("b")).select("sid", F.col("b.tid").alias("tid"), F.col("b.d2").alias("d2"))


def nearest_to_ray(points: DataFrame, origin: Sequence[float], direction: Sequence[float], most: float) -> DataFrame:
    """The point of least distance to a ray (under ``most``, not behind its start)."""
    d = [F.col(k) - o for k, o in zip("xyz", origin)]
    t = d[0] * direction[0] + d[1] * direction[1] + d[2] * direction[2]
    off = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] - t * t
    hit = points.withColumn("off2", F.greatest(off, F.lit(0.0))).where((t >= 0) & (F.col("off2") < most * most))
    return hit.agg(F.min_by("id", F.struct("off2", "id")).alias("id"), F.min("off2").alias("off2"))


def overlapping_boxes(boxes: DataFrame, gap: float, size: float) -> DataFrame:
    """(a, b) with a < b whose boxes (id, x0..z1) are within ``gap``.

    Boxes are dealt to the cells they cover; a pair is reported once, from
    the cell of its lower common corner.
    """
    def cover(k: str) -> Column:
        return F.sequence(F.floor((F.col(f"{k}0") - gap) / size), F.floor((F.col(f"{k}1") + gap) / size))

    b = boxes.withColumn("cx", F.explode(cover("x"))).withColumn("cy", F.explode(cover("y")))
    l, r = b.alias("l"), b.alias("r")
    near = (F.col("l.cx") == F.col("r.cx")) & (F.col("l.cy") == F.col("r.cy")) & (F.col("l.id") < F.col("r.id"))
    for k in "xyz":
        near = near & (F.col(f"l.{k}0") <= F.col(f"r.{k}1") + gap) & (F.col(f"r.{k}0") <= F.col(f"l.{k}1") + gap)
    once = F.lit(True)
    for k in "xy":
        once = once & (F.floor((F.greatest(F.col(f"l.{k}0"), F.col(f"r.{k}0")) - gap) / size) == F.col(f"l.c{k}"))
    return l.join(r, near & once).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def candidate_cameras(tiles: DataFrame, cameras: DataFrame, most: int = 16, size: float = 64.0) -> DataFrame:
    """(tile, camera, rank): cameras whose bounds overlap a tile, best quality first, then id."""
    cell = lambda p, k: F.explode(F.sequence(F.floor(F.col(f"{p}{k}0") / size), F.floor(F.col(f"{p}{k}1") / size)))
    t = tiles.select(F.col("id").alias("tile"), *[F.col(c).alias(f"t{c}") for c in ("x0", "x1", "y0", "y1")]).withColumn("cx", cell("t", "x")).withColumn("cy", cell("t", "y"))
    c = cameras.select(F.col("id").alias("camera"), "quality", *[F.col(c).alias(f"c{c}") for c in ("x0", "x1", "y0", "y1")]).withColumn("cx", cell("c", "x")).withColumn("cy", cell("c", "y"))
    hit = t.join(c, ["cx", "cy"]).where("tx0 <= cx1 and cx0 <= tx1 and ty0 <= cy1 and cy0 <= ty1").select("tile", "camera", "quality").distinct()
    return hit.withColumn("rank", F.row_number().over(Window.partitionBy("tile").orderBy(F.desc("quality"), "camera"))).where(F.col("rank") <= most).drop("quality")


def exact_selection(refs: DataFrame, live: DataFrame) -> DataFrame:
    """(id, problem): references (id, revision, hash) that are missing, stale or repeated."""
    cur = live.select("id", F.col("revision").alias("r"), F.col("hash").alias("h"), F.lit(True).alias("there"))
    seen = refs.groupBy("id").agg(F.count("*").alias("n"), F.min("revision").alias("revision"), F.min("hash").alias("hash")).join(cur, "id", "left")
    problem = F.when(F.col("n") > 1, "repeated").when(F.col("there").isNull(), "missing").when(~(F.col("revision").eqNullSafe(F.col("r")) & F.col("hash").eqNullSafe(F.col("h"))), "stale")
    return seen.select("id", problem.alias("problem")).where("problem is not null")


def misclosure(control: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean absolute difference of two coordinate sets over the control ids.

    An id missing on either side is counted in ``n_missing`` (the caller's error).
    """
    l = left.select("id", *[F.col(c).alias(f"l{c}") for c in ("x", "y", "z")])
    r = right.select("id", *[F.col(c).alias(f"r{c}") for c in ("x", "y", "z")])
    j = control.select("id").join(l, "id", "left").join(r, "id", "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("lx").isNull() | F.col("rx").isNull()).alias("n_missing"), *[F.avg(F.abs(F.col(f"l{k}") - F.col(f"r{k}"))).alias(f"d{k}") for k in "xyz"])


def usable_observations(observations: DataFrame, cameras: DataFrame) -> DataFrame:
    """Observations with a known camera, of points seen at least twice so."""
    o = observations.join(cameras.select("image"), "image", "left_semi")
    return o.withColumn("_n", F.count("*").over(Window.partitionBy("point"))).where("_n >= 2").drop("_n")


def inherited(edges: DataFrame, values: DataFrame, depth: int = 256) -> DataFrame:
    """(id, name, value, depth, conflict): properties from the nearest ancestors.

    ``edges`` (id, parent); ``values`` (id, name, value). Equal nearest
    depths with different values are a conflict.
    """
    reach = edges.select("id", F.col("id").alias("at")).union(edges.select("parent", "parent")).distinct().withColumn("depth", F.lit(0))
    every, step = reach, reach
    up = edges.select(F.col("id").alias("c"), F.col("parent").alias("p"))
    for k in range(1, depth + 1):
        step = step.join(up, F.col("at") == F.col("c")).select("id", F.col("p").alias("at"), F.lit(k).alias("depth")).distinct().transform(cut)
        if step.isEmpty():
            break
        every = every.unionByName(step)
    else:
        raise RuntimeError(f"ancestors are more than {depth} levels away, or in a circle")
    got = every.join(values.select(F.col("id").alias("at"), "name", "value"), "at").groupBy("id", "name", "depth").agg(F.min("value").alias("value"), (F.min("value") != F.max("value")).alias("conflict"))
    return got.groupBy("id", "name").agg(F.min_by(F.struct("value", "depth", "conflict"), "depth").alias("b")).select("id", "name", "b.*")
