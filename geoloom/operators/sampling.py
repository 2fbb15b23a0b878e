"""Deterministic samples, ranked limits and selections. Every order is total."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import filters
from geoloom.session import cut, stored

#: Fixed value: the seed of the random draw.
SEED = 0x4843414450380001
#: Blocks in which points are thinned are so many spacings wide.
BLOCK = 32


def grid_sample(points: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """One point for each cell: nearest its mean height, then its centre, then by id."""
    c, r = F.floor((F.col("x") - x0) / size), F.floor((F.col("y") - y0) / size)
    p = points.withColumns({"_c": c, "_r": r})
    means = p.groupBy("_c", "_r").agg(F.avg("z").alias("_m"))
    dx, dy = F.col("x") - x0 - (F.col("_c") + 0.5) * size, F.col("y") - y0 - (F.col("_r") + 0.5) * size
    key = F.struct(F.abs(F.col("z") - F.col("_m")).alias("a"), (dx * dx + dy * dy).alias("b"), F.col("id").alias("c"))
    # an aggregate keeps one candidate per task and cell, where a rank would shuffle every point
    best = p.join(means, ["_c", "_r"]).groupBy("_c", "_r").agg(F.min_by(F.struct(*points.columns), key).alias("p"))
    return best.select("p.*")


def random_sample(points: DataFrame, percent: float, seed: int = SEED) -> DataFrame:
    """Points whose hash draw falls under a share; no shuffle, order-independent."""
    draw = F.substring(F.sha2(F.concat(F.lit(f"{seed:016x}"), F.col("id").cast("string")), 256), 1, 13)
    if percent >= 100:
        return points
    return points.where(draw < F.lit(f"{int(percent / 100 * 16**13):013x}"))


def distance_sample(points: DataFrame, spacing: float) -> DataFrame:
    """Points in id order, each at least ``spacing`` (in x, y, z) from all kept before."""
    kept = spaced(points.select("id", "x", "y", "z", F.col("id").alias("_o")), spacing, "xyz", "_o")
    return points.join(kept, "id", "left_semi")


def spaced(points: DataFrame, spacing: float, dims: str, order: str, group: str | None = None, closed: bool = False) -> DataFrame:
    """(id, g, o): points (id, dims..., order) that a walk in ``order`` keeps, each at least
    ``spacing`` from all kept before in its group ``g`` (with ``closed``: more than that).

    Of points at one place only the first can be kept. Rounds of walks in blocks give the sequential result: a block
    knows the points around it, keeps a point once none before it and near is kept or open, and leaves open
    what depends on points of other blocks. Blocks are shifted from round to round, and only open points go on.
    Points without a group, an order or finite coordinates have no neighbours.
    """
    own = F.lit(0) if group is None else F.col(group)
    p = points.select("id", F.col(order).alias("o"), own.alias("g"), *[F.col(k).cast("double").alias(k) for k in dims])
    placed = F.col("g").isNotNull() & F.col("o").isNotNull()
    for k in dims:
        placed = placed & F.coalesce(F.abs(k) < float("inf"), F.lit(False))
    p = p.withColumn("placed", placed)
    first = p.where("placed").groupBy("g", *dims).agg(F.min(F.struct("o", "id")).alias("first"))
    left = first.select("first.id", "first.o", "g", *dims, F.lit(False).alias("kept"))
    kept = p.where("not placed").select("id", "g", "o")
    for turn in itertools.count():
        seen = stored(_walked_blocks(left, spacing, dims, closed, turn % 2 / 2), "spaced")
        kept = kept.unionByName(seen.where("kept").select("id", "g", "o"))
        if seen.where("not kept").isEmpty():
            return kept
        left = seen


def _walked_blocks(points: DataFrame, spacing: float, dims: str, closed: bool, shift: float) -> DataFrame:
    """One round of ``spaced`` over points (id, o, g, dims..., kept): those kept now, and those still open."""
    size = spacing * BLOCK
    blocks = [f"b{k}" for k in dims]
    q = points.withColumns({f"own_{b}": F.floor(F.col(k) / size + shift) for b, k in zip(blocks, dims)})
    reach = spacing * 1.000001
    for b, k in zip(blocks, dims):
        q = q.withColumn(b, F.explode(F.sequence(F.floor((F.col(k) - reach) / size + shift), F.floor((F.col(k) + reach) / size + shift))))
    home = functools.reduce(lambda x, y: x & y, [F.col(b) == F.col(f"own_{b}") for b in blocks])
    q = q.withColumn("home", home).drop(*[f"own_{b}" for b in blocks])
    q = q.repartition("g", *blocks).sortWithinPartitions("g", *blocks, "o")
    number = lambda cell: functools.reduce(lambda n, c: (n << 20) + c, cell)  # noqa: E731; differs for cells of one block
    around = [number(step) for step in itertools.product((-1, 0, 1), repeat=len(dims))]
    limit = spacing * spacing

    def near(cells: dict, cell: int, place: tuple) -> bool:
        for step in around:
            for other in cells.get(cell + step, ()):
                d2 = 0.0
                for x, y in zip(place, other):
                    d2 += (x - y) * (x - y)
                if d2 < limit or closed and d2 == limit:
                    return True
        return False

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, opened = None, {}, {}
        for batch in batches:
            rows, fresh = [], []
            keys = zip(*[batch.column(c).to_pylist() for c in ("g", *blocks)])
            places = zip(*[batch.column(k).to_pylist() for k in dims])
            for i, (key, place, was, at_home) in enumerate(zip(keys, places, batch.column("kept").to_pylist(), batch.column("home").to_pylist())):
                if key != last:
                    last, taken, opened = key, {}, {}
                cell = number([math.floor(x / spacing) for x in place])
                if was:
                    taken.setdefault(cell, []).append(place)
                elif not near(taken, cell, place):
                    keep = at_home and not near(opened, cell, place)
                    (taken if keep else opened).setdefault(cell, []).append(place)
                    if at_home:
                        rows.append(i)
                        fresh.append(keep)
            out = batch.select(["id", "o", "g", *dims]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(fresh, pa.bool_())], [*out.schema.names, "kept"])

    return q.mapInArrow(walk, points.select("id", "o", "g", *dims, "kept").schema)


def strided(df: DataFrame, order: str, every: int) -> DataFrame:
    """Rows at evenly spaced places, by the order column's own arithmetic."""
    return df.where(F.pmod(F.col(order), F.lit(every)) == 0)


def capped_features(features: DataFrame, k: int) -> DataFrame:
    """The k best features of each image by score, then x, y and row."""
    w = Window.partitionBy("image").orderBy(F.desc("score"), "px", "py", "row_index")
    return features.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_pairs(hints: DataFrame, most: int | None = None) -> DataFrame:
    """Candidate pairs with enough evidence, by priority, then pair."""
    p = filters.pair_evidence(hints).where(filters.evidence_passes()).withColumn("priority", filters.priority())
    p = p.orderBy(F.desc("priority"), "a", "b")
    return p if most is None else p.limit(most)


def stratified_checkpoints(points: DataFrame, n: int) -> DataFrame:
    """One point for each cell of an n x n grid over the bounds: nearest the cell's centre, then by id."""
    b = points.agg(*[f(k).alias(f"{m}{k}") for k in "xy" for m, f in (("lo", F.min), ("hi", F.max))])
    p = points.crossJoin(F.broadcast(b))  # one row of bounds
    for k in "xy":
        p = p.withColumn(f"u{k}", F.coalesce(F.try_divide(F.col(k) - F.col(f"lo{k}"), F.col(f"hi{k}") - F.col(f"lo{k}")), F.lit(0.5)))
        p = p.withColumn(f"s{k}", F.least(F.floor(F.col(f"u{k}") * n), F.lit(n - 1)).cast("int"))
    gap = [F.col(f"u{k}") - (F.col(f"s{k}") + 0.5) / n for k in "xy"]
    return p.groupBy("sx", "sy").agg(F.min_by("id", F.struct((gap[0] * gap[0] + gap[1] * gap[1]).alias("d"), "id")).alias("id"))


def farthest_points(points: DataFrame, n: int, id_col: str = "id") -> list:
    """n ids: the least one, then always the point farthest from those chosen (ties: least id).

    One aggregate over the points for each choice; nothing but the choice is collected.
    """
    first = points.agg(F.min_by(F.struct(id_col, "x", "y"), id_col).alias("p")).first()["p"]
    if first is None:
        return []
    chosen = [first]
    while len(chosen) < n:
        d = F.least(*[(F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"]) for c in chosen], F.lit(float("inf")))
        rest = points.where(~F.col(id_col).isin([c[id_col] for c in chosen]))
        nxt = rest.agg(F.min_by(F.struct(id_col, "x", "y"), F.struct((-d).alias("d"), id_col)).alias("p")).first()["p"]
        if nxt is None:
            break
        chosen.append(nxt)
    return [c[id_col] for c in chosen]


def eligible_frames(frames: DataFrame, sharpness: float, motion: float, overlap: tuple[float, float]) -> DataFrame:
    return frames.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("sharpness") >= sharpness) & (F.col("motion") <= motion) & F.col("overlap").between(*overlap))


def selected_frames(frames: DataFrame, interval: int, most: int, video: str = "video") -> DataFrame:
    """(video, frame, t, score): best score first, each at least ``interval`` from all accepted.

    A video's frames are one ordered fold; videos are dealt over tasks.
    """
    kind = frames.schema[video].dataType.simpleString()

    def pick(groups: Iterator[pd.DataFrame]) -> pd.DataFrame:
        g = pd.concat(list(groups)).sort_values(["score", "t", "frame"], ascending=[False, True, True])
        taken: list[int] = []
        rows = []
        for r in g.itertuples(index=False):
            if len(taken) < most and all(abs(r.t - t) >= interval for t in taken):
                taken.append(r.t)
                rows.append(r)
        return pd.DataFrame(rows, columns=g.columns).sort_values("t")

    return frames.select(video, "frame", "t", "score").groupBy(video).applyInPandas(lambda g: pick(iter([g])), f"{video} {kind}, frame long, t long, score double")


def wanted_tiles(tiles: DataFrame, most: int) -> DataFrame:
    """Unloaded tiles by priority, depth, error and key; the best ``most``."""
    return tiles.where("not loaded").orderBy(F.desc("priority"), "depth", F.desc("error"), "key").limit(most)


def running_total(df: DataFrame, order: list[str], value: str, name: str = "total") -> DataFrame:
    """Adds the running sum of ``value`` in a total order, without one task for all rows.

    Rows are dealt to ranges of the order; each range sums by itself and adds the sum of
    the ranges before it (one row a range).
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).transform(cut)
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inner = parts.withColumn("_run", F.sum(value).over(Window.partitionBy("_part").orderBy(*order)))
    joined = inner.join(F.broadcast(before), "_part")  # a row for each range
    return joined.withColumn(name, F.col("_before") + F.col("_run")).drop("_part", "_before", "_run")


def running_total_by(df: DataFrame, group: list[str], order: list[str], value: str, name: str, before: str) -> DataFrame:
    """Adds the running sum of ``value`` within each group in a total order, and the sum
    ``before`` the row; a group of any size is spread over ranges of the order."""
    parts = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()).transform(cut)
    sums = parts.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_part", *group).orderBy(*order)
    inner = parts.withColumns({"_run": F.sum(value).over(within), "_ahead": F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    joined = inner.join(starts, ["_part", *group])
    return joined.withColumns({name: F.col("_start") + F.col("_run"), before: F.col("_start") + F.col("_ahead")}).drop("_part", "_start", "_run", "_ahead")


def admitted(requests: DataFrame, budget: int) -> DataFrame:
    """Requests (lane, dataset, benefit, tile, cost) in lane order, datasets of a
    lane in turn, admitted while the running cost stays within the budget; each
    row gets ``admitted`` and ``reason``."""
    turn = F.row_number().over(Window.partitionBy("lane", "dataset").orderBy(F.desc("benefit"), "tile"))
    r = running_total(requests.withColumn("turn", turn), ["lane", "turn", "dataset", "tile"], "cost", "used")
    ok = F.col("used") <= budget
    return r.select("lane", "dataset", "tile", ok.alias("admitted"), F.when(~ok, F.lit("budget")).alias("reason"))


def journal_page(journal: DataFrame, after: int, size: int = 4096) -> DataFrame:
    """The next rows by sequence: a pushed-down key filter and a top-k."""
    return journal.where(F.col("sequence") > after).orderBy("sequence").limit(min(size, 4096))
