"""Components, hierarchies and tiles as iterated joins.

State between rounds is checkpointed, so lineage stays short and lost
executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.session import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) by hooking every root to its least neighbour root and jumping."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().transform(cut)
    labels = e.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")).transform(cut)
    for _ in range(rounds):
        if e.isEmpty():
            return labels
        up = e.groupBy("a").agg(F.min("b").alias("up")).transform(cut)
        while True:
            far = up.select(F.col("a").alias("m"), F.col("up").alias("far"))
            nxt = up.join(far, F.col("up") == F.col("m"), "left").select("a", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")).transform(cut)
            up = nxt.drop("moved")
            if nxt.where("moved").isEmpty():
                break
        to = up.select(F.col("a").alias("r"), "up")
        labels = labels.join(to, F.col("component") == F.col("r"), "left").select("node", F.coalesce("up", "component").alias("component")).transform(cut)
        e = e.join(to, F.col("a") == F.col("r"), "left").select(F.coalesce("up", "a").alias("a"), "b").join(to, F.col("b") == F.col("r"), "left").select("a", F.coalesce("up", "b").alias("b"))
        e = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().transform(cut)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def cyclic(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Edges (source, target) on or behind a cycle: what peeling leaves (none: acyclic)."""
    e = edges.select("source", "target").distinct().transform(cut)
    for _ in range(rounds):
        n = e.count()
        e = e.join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").transform(cut)
        if e.count() == n:
            return e
    raise RuntimeError(f"a path is longer than {rounds} edges")


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """(source, target, depth): reachable nodes and the least number of steps."""
    every = step = edges.select("source", "target").distinct().withColumn("depth", F.lit(1)).transform(cut)
    nxt = edges.select(F.col("source").alias("mid"), F.col("target").alias("far")).distinct()
    for k in range(2, depth + 1):
        step = step.join(nxt, F.col("target") == F.col("mid")).select("source", F.col("far").alias("target")).distinct().join(every, ["source", "target"], "left_anti").withColumn("depth", F.lit(k)).transform(cut)
        if step.isEmpty():
            break
        every = every.unionByName(step)
    return every


def visible_tiles(tiles: DataFrame, most_error: float, depth: int = 64) -> DataFrame:
    """Tiles (tile, parent, error, distance, refine) that a level-by-level walk shows.

    A tile is refined while its error over its distance is too large and it
    has children; an added tile stays beside its children, a replaced one goes.
    """
    kids = tiles.select(F.col("parent").alias("p")).where("p is not null").distinct()
    t = tiles.join(kids, F.col("tile") == F.col("p"), "left").withColumn("open", F.col("p").isNotNull() & (F.try_divide(F.col("error"), F.greatest(F.col("distance"), F.lit(1e-9))) > most_error)).drop("p").transform(cut)
    level, shown = t.where("parent is null"), None
    for _ in range(depth):
        show = level.where("not open or refine = 'add'")
        shown = show if shown is None else shown.unionByName(show)
        level = t.join(level.where("open").select(F.col("tile").alias("parent")), "parent", "left_semi").transform(cut)
        if level.isEmpty():
            return shown.select("tile")
    raise RuntimeError(f"tiles are deeper than {depth} levels")


def octree_leaves(points: DataFrame, size: float, capacity: int = 1024, depth: int = 20, step: int = 4) -> DataFrame:
    """(node, n): octree leaves by name (a digit 0-7 for each level).

    A point's deepest cell is one long, three bits a level. ``step`` levels are counted
    by one aggregate over the points of cells that are still too full; the counts of
    the levels between come from those counts.
    """
    key = F.lit(0).cast("long")
    for k in range(1, depth + 1):
        bit = lambda c: F.pmod(F.floor(F.col(c) * (1 << k) / size), F.lit(2)).cast("long")  # noqa: E731, B023
        key = F.shiftleft(key, 3).bitwiseOR(4 * bit("x") + 2 * bit("y") + bit("z"))
    rest = points.select(key.alias("key")).transform(cut)
    name = lambda k: F.lpad(F.conv("cell", 10, 8), k, "0") if k else F.lit("")
    full = rest.groupBy(F.lit(0).cast("long").alias("cell")).agg(F.count("*").alias("n"))
    leaves = full.where(F.col("n") <= capacity).select(name(0).alias("node"), "n")
    full = full.where(F.col("n") > capacity).transform(cut)
    for low in range(0, depth, step):
        if full.isEmpty():
            break
        high = min(depth, low + step)
        part = rest.join(full.select(F.col("cell").alias("up")), F.shiftright("key", 3 * (depth - low)) == F.col("up"), "left_semi")
        counts = part.groupBy(F.shiftright("key", 3 * (depth - high)).alias("cell")).agg(F.count("*").alias("n")).transform(cut)
        for k in range(low + 1, high + 1):
            level = counts.groupBy(F.shiftright("cell", 3 * (high - k)).alias("cell")).agg(F.sum("n").alias("n"))
            level = level.join(full.select(F.col("cell").alias("up")), F.shiftright("cell", 3) == F.col("up"), "left_semi")
            leaf = F.col("n") <= capacity if k < depth else F.lit(True)
            leaves = leaves.unionByName(level.where(leaf).select(name(k).alias("node"), "n"))
            full = level.where(~leaf).transform(cut)
    return leaves
