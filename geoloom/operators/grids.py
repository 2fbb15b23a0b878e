"""Grids of cells: aggregation, neighbourhood windows, ground filter, sampling.

A raster is a table (col, row, value), with a row for each cell where
``dense``; null is no data. Windows run over one grid row or column at a
time, so a task holds one line of cells, never the grid.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import cut

MAX_CELLS = 200_000_000


def cell(v: Column, low: float, size: float, n: int) -> Column:
    """The index of a value's cell, within 0..n-1."""
    return F.least(F.lit(n - 1), F.floor((v - low) / size)).cast("int")


def extent(points: DataFrame, size: float) -> dict:
    """Bounds and shape of the grid over the points (one aggregate row)."""
    r = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r["x0"] is None:
        return {"x0": 0.0, "y0": 0.0, "w": 0, "h": 0, "size": size}
    w, h = (int(math.floor((r[b] - r[a]) / size)) + 1 for a, b in (("x0", "x1"), ("y0", "y1")))
    if w * h > MAX_CELLS:
        raise ValueError(f"{w} x {h} cells are too many")
    return {"x0": r["x0"], "y0": r["y0"], "w": w, "h": h, "size": size}


def with_cells(points: DataFrame, g: dict) -> DataFrame:
    return points.withColumns({"col": cell(F.col("x"), g["x0"], g["size"], g["w"]), "row": cell(F.col("y"), g["y0"], g["size"], g["h"])})


def raster(points: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(col, row, n, min_z, max_z, mean_z, var_z) of the occupied cells; population variance."""
    at = points.select(F.floor((F.col("x") - x0) / size).cast("int").alias("col"), F.floor((F.col("y") - y0) / size).cast("int").alias("row"), "z")
    a = at.groupBy("col", "row").agg(F.count("*").alias("n"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    return a.select("col", "row", "n", "min_z", "max_z", (F.col("s") / F.col("n")).alias("mean_z"), ((F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * F.col("n"))).alias("var_z"))


def dense(cells: DataFrame, w: int, h: int, value: str, fill: float | None = None) -> DataFrame:
    """Every cell of a w x h grid with its value, or the fill."""
    every = cells.sparkSession.range(w * h).select((F.col("id") % w).cast("int").alias("col"), F.expr(f"cast(id div {max(1, w)} as int)").alias("row"))
    v = F.col(value) if fill is None else F.coalesce(value, F.lit(float(fill)))
    return every.join(cells.select("col", "row", value), ["col", "row"], "left").select("col", "row", v.cast("double").alias("value"))


def sliding(grid: DataFrame, radius: int, how: str, values: dict[str, str]) -> DataFrame:
    """Adds, for each (new: old) of ``values``, the min or max over a square
    of the radius, clipped at the edges; cells without data are skipped."""
    f = F.min if how == "min" else F.max
    across = Window.partitionBy("row").orderBy("col").rowsBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(-radius, radius)
    grid = grid.withColumns({f"_{n}": f(o).over(across) for n, o in values.items()})
    return grid.withColumns({n: f(f"_{n}").over(down) for n in values}).drop(*[f"_{n}" for n in values])


def opening(grid: DataFrame, radius: int, value: str = "value", out: str = "opened") -> DataFrame:
    """Erosion, then dilation."""
    return sliding(sliding(grid, radius, "min", {"_e": value}), radius, "max", {out: "_e"}).drop("_e")


def object_cells(grid: DataFrame, cell_size: float, max_window: float, slope: float, initial: float) -> DataFrame:
    """(col, row, value, removed): cells that rise over a morphological opening.

    All radii are judged on the same heights, so all erosions along the
    rows are columns of one window pass, and so on: four passes in all.
    """
    w, h = grid.agg(F.max("col") + 1, F.max("row") + 1).first()
    radii = range(1, min(math.ceil(max_window / cell_size), max(w or 0, h or 0)) + 1)
    rows = lambda r: Window.partitionBy("row").orderBy("col").rowsBetween(-r, r)
    cols = lambda r: Window.partitionBy("col").orderBy("row").rowsBetween(-r, r)
    g = grid.withColumns({f"e{r}": F.min("value").over(rows(r)) for r in radii})
    g = g.withColumns({f"e{r}": F.min(f"e{r}").over(cols(r)) for r in radii})
    g = g.withColumns({f"e{r}": F.max(f"e{r}").over(cols(r)) for r in radii})
    g = g.withColumns({f"e{r}": F.max(f"e{r}").over(rows(r)) for r in radii})
    gone = F.lit(False)
    for r in radii:
        gone = gone | F.coalesce(F.col("value") - F.col(f"e{r}") > initial + slope * r * cell_size, F.lit(False))
    return g.select("col", "row", "value", gone.alias("removed"))


def inpainted(grid: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """Cells without data take the value of the nearest cell with data within
    ``radius`` cells (ties: the smaller row, then column), else stay null.

    Exact, by a distance transform in two passes: along its column each cell finds the nearest
    cell with data, and along its row the least of those, with their distances, up to
    ``radius`` columns away. A task holds one line of cells.
    """
    up = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col(value).isNotNull(), F.struct("row", F.col(value).cast("double").alias("v")))
    g = grid.withColumns({"_up": F.last(seen, True).over(up), "_down": F.first(seen, True).over(down)})
    nearer = F.when(F.col("_down").isNull() | (F.col("row") - F.col("_up.row") <= F.col("_down.row") - F.col("row")), F.col("_up")).otherwise(F.col("_down"))
    g = g.withColumn("_near", nearer).select(*grid.columns, F.col("_near.row").cast("long").alias("_row"), F.col("_near.v").alias("_value"))
    names, schema = grid.columns, grid.schema

    def along_row(table: pa.Table) -> pa.Table:
        col, row = table.column("col").to_numpy(), int(table.column("row")[0].as_py())
        first, n = int(col.min()), int(col.max() - col.min()) + 1
        there = table.column("_row").is_valid().to_numpy()
        at, origin = np.full(n, -1, np.int64), col[there] - first
        at[origin] = table.column("_row").drop_null().to_numpy()
        near = np.zeros(n)
        near[origin] = table.column("_value").drop_null().to_numpy()
        far = np.int64(2 * radius * radius + 1)
        own = np.where(at >= 0, np.minimum((at - row) ** 2, far), far)
        best, source, best_row = np.full(n, far), np.full(n, -1), np.full(n, -1)
        for shift in range(-radius, radius + 1):  # from the left, so of equal distances and rows the smaller column stays
            a, z = max(0, -shift), min(n, n - shift)
            if a >= z:
                continue
            d, r = own[a + shift : z + shift] + shift * shift, at[a + shift : z + shift]
            better = (d < best[a:z]) | (d == best[a:z]) & (r < best_row[a:z])
            best[a:z][better], best_row[a:z][better], source[a:z][better] = d[better], r[better], np.arange(a + shift, z + shift)[better]
        ok = best <= radius * radius
        filled = np.where(ok[col - first], near[source[col - first]], np.nan)
        known = table.column(value)
        done = pc.coalesce(known, pa.array(filled, mask=~ok[col - first]).cast(known.type))
        return pa.table([done if c == value else table.column(c) for c in names], names=names)

    return g.groupBy("row").applyInArrow(along_row, schema)


def bilinear(points: DataFrame, grid: DataFrame, g: dict, strict: bool = False) -> DataFrame:
    """Adds ``surface``: the height between four cell centres around a point.

    Points off the grid take its edge; corners without data are left out and
    the weights renormalised, or with ``strict`` the result is null.
    """
    u = F.greatest(F.lit(0.0), F.least(F.lit(float(g["w"] - 1)), (F.col("x") - g["x0"]) / g["size"] - 0.5))
    v = F.greatest(F.lit(0.0), F.least(F.lit(float(g["h"] - 1)), (F.col("y") - g["y0"]) / g["size"] - 0.5))
    p = points.withColumns({"_u": u, "_v": v})
    # each cell carries its right, lower and diagonal neighbour, so a point meets one row
    e = Window.partitionBy("row").orderBy("col")
    s = Window.partitionBy("col").orderBy("row")
    q = grid.withColumn("_10", F.lead("value").over(e)).withColumn("_01", F.lead("value").over(s)).withColumn("_11", F.lead("_10").over(s))
    q = q.select(F.col("col").alias("_c"), F.col("row").alias("_r"), F.col("value").alias("_00"), "_10", "_01", "_11")
    p = p.join(q, (F.floor("_u").cast("int") == F.col("_c")) & (F.floor("_v").cast("int") == F.col("_r")), "left")
    a, b = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    w = {"_00": (1 - a) * (1 - b), "_10": a * (1 - b), "_01": (1 - a) * b, "_11": a * b}
    known = sum((F.when(F.col(k).isNotNull(), x).otherwise(0.0) for k, x in w.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(k) * x, F.lit(0.0)) for k, x in w.items()), F.lit(0.0))
    out = F.try_divide(total, known)
    if strict:
        out = F.when(known >= 1 - 1e-12, out)
    return p.withColumn("surface", out).drop("_u", "_v", "_c", "_r", *w)


def ground(points: DataFrame, cell_size: float = 1.0, max_window: float = 18.0, slope: float = 0.15, initial: float = 0.5) -> DataFrame:
    """Adds surface, residual and is_ground by the progressive morphological filter.

    The lowest point of each cell makes the surface; cells above an opening
    are removed and filled from the nearest that stay.
    """
    g = extent(points, cell_size)
    if not g["w"]:
        return points.withColumns({"surface": F.lit(None).cast("double"), "residual": F.lit(None).cast("double"), "is_ground": F.lit(False)})
    at = with_cells(points, g)
    low = dense(at.groupBy("col", "row").agg(F.min("z").alias("z")), g["w"], g["h"], "z")
    reach = min(math.ceil(max_window / cell_size), max(g["w"], g["h"]))
    filled = inpainted(low, reach).transform(cut)
    marked = object_cells(filled, cell_size, max_window, slope, initial).transform(cut)
    kept = inpainted(marked.withColumn("value", F.when(~F.col("removed"), F.col("value"))), reach).select("col", "row", "value")
    out = bilinear(at, kept, g).join(marked.select("col", "row", "removed"), ["col", "row"], "left")
    r = F.abs(F.col("z") - F.col("surface"))
    return out.withColumn("residual", r).withColumn("is_ground", F.coalesce((r <= initial + slope * cell_size) & ~F.col("removed"), F.lit(False))).drop("col", "row", "removed")


def residual_summary(df: DataFrame) -> DataFrame:
    """Count, mean, population deviation, least and greatest; all zero for none."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(F.count("residual").alias("n"), z(F.avg("residual")).alias("mean"), z(F.stddev_pop("residual")).alias("std"), z(F.min("residual")).alias("least"), z(F.max("residual")).alias("most"))


def holes_filled(image: DataFrame) -> DataFrame:
    """Single empty pixels with three valid neighbours or more take their integer mean."""
    e, s = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    around = F.array_compact(F.array(F.lag("value").over(e), F.lead("value").over(e), F.lag("value").over(s), F.lead("value").over(s)))
    mean = F.expr("aggregate(_a, 0L, (t, v) -> t + cast(v as bigint)) div size(_a)")
    return image.withColumn("_a", around).select("col", "row", F.coalesce("value", F.when(F.size("_a") >= 3, mean).cast("double")).alias("value"))


def stencils(image: DataFrame) -> DataFrame:
    """(col, row, laplacian, sobel_x, sobel_y) of inner pixels; Sobel sums are a quarter."""
    e, s = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    d = image.withColumns({"w": F.lag("value").over(e), "e": F.lead("value").over(e)})
    d = d.withColumns({n + k: f(k).over(s) for n, f in (("n", F.lag), ("s", F.lead)) for k in ("w", "value", "e")})
    lap = F.col("w") + F.col("e") + F.col("nvalue") + F.col("svalue") - 4 * F.col("value")
    sx = (F.col("ne") + 2 * F.col("e") + F.col("se") - F.col("nw") - 2 * F.col("w") - F.col("sw")) / 4
    sy = (F.col("sw") + 2 * F.col("svalue") + F.col("se") - F.col("nw") - 2 * F.col("nvalue") - F.col("ne")) / 4
    return d.select("col", "row", lap.alias("laplacian"), sx.alias("sobel_x"), sy.alias("sobel_y")).dropna()


def cell_triangles(grid: DataFrame) -> DataFrame:
    """(col, row, half): triangles of grid cells whose corners have data."""
    e, s = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    q = grid.withColumn("r", F.lead("value").over(e)).withColumn("d", F.lead("value").over(s)).withColumn("x", F.lead("r").over(s))
    halves = F.array(F.when(F.col("value").isNotNull() & F.col("r").isNotNull() & F.col("d").isNotNull(), 0), F.when(F.col("r").isNotNull() & F.col("d").isNotNull() & F.col("x").isNotNull(), 1))
    return q.select("col", "row", F.explode(F.array_compact(halves)).alias("half"))


def _catmull(t: Column) -> list[Column]:
    """The weights of four values in a row at a place t between the middle two."""
    t2, t3 = t * t, t * t * t
    return [(-t3 + 2 * t2 - t) * 0.5, (3 * t3 - 5 * t2 + 2) * 0.5, (-3 * t3 + 4 * t2 + t) * 0.5, (t3 - t2) * 0.5]


def grid_values(points: DataFrame, grid: DataFrame, w: int, h: int, method: str) -> DataFrame:
    """Adds ``sampled`` and ``problem`` to points (id, u, v) in grid coordinates (nodes are whole numbers).

    ``method``: nearest, bilinear or cubic (Catmull-Rom, rows beyond the edge repeat it).
    A point off the grid is ``outside``; one that needs a node without data is
    ``missing``. A point asks for its 1, 4 or 16 nodes by an equi-join.
    """
    inside = (F.col("u") >= 0) & (F.col("v") >= 0) & (F.col("u") <= w - 1) & (F.col("v") <= h - 1)
    p = points.where(inside)
    if method == "nearest":
        nodes = F.array(F.struct(F.floor(F.col("u") + 0.5).cast("int").alias("col"), F.floor(F.col("v") + 0.5).cast("int").alias("row"), F.lit(1.0).alias("weight")))
    elif method in ("bilinear", "cubic"):
        last = (w - 2, h - 2) if method == "bilinear" else (w - 1, h - 1)
        at = [F.greatest(F.lit(0), F.least(F.lit(n), F.floor(c).cast("int"))) for c, n in zip(("u", "v"), last)]
        t = [F.col(c) - a for c, a in zip(("u", "v"), at)]
        if method == "bilinear":
            taps = [[(0, 1 - x), (1, x)] for x in t]
        else:
            taps = [list(zip((-1, 0, 1, 2), _catmull(x))) for x in t]
        clamp = lambda a, d, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), a + d))
        nodes = F.array(*[F.struct(clamp(at[0], i, w).alias("col"), clamp(at[1], j, h).alias("row"), (x * y).alias("weight")) for j, y in taps[1] for i, x in taps[0]])
    else:
        raise ValueError(f"unknown method {method}")
    asks = p.select("id", F.explode(nodes).alias("n")).select("id", "n.*")
    got = asks.join(grid.where("value is not null").select("col", "row", "value"), ["col", "row"], "left")
    sums = got.groupBy("id").agg(F.sum(F.col("weight") * F.col("value")).alias("_s"), F.count_if(F.col("value").isNull()).alias("_m"))
    j = points.join(sums, "id", "left")
    problem = F.when(F.col("_m").isNull(), "outside").when(F.col("_m") > 0, "missing")
    return j.withColumn("problem", problem).withColumn("sampled", F.when(F.col("problem").isNull(), F.col("_s"))).drop("_s", "_m")


def warped(target: DataFrame, source: DataFrame, w: int, h: int, forward: tuple[float, ...]) -> DataFrame:
    """(col, row, value): a source raster drawn into target cells (col, row) under a plane affine map
    (a, b, c, d, e, f: x' = a x + b y + c, y' = d x + e y + f) from source to target cells.

    Each target cell looks up its source by the inverse map, bilinearly and strictly: a cell
    whose source is outside or touches no-data is null.
    """
    a, b, c, d, e, f = forward
    det = a * e - b * d
    if det == 0:
        raise ValueError("the map has no inverse")
    x, y = F.col("col") - c, F.col("row") - f
    asks = target.select(F.struct("col", "row").alias("id"), ((e * x - b * y) / det).alias("u"), ((a * y - d * x) / det).alias("v"))
    return grid_values(asks, source, w, h, "bilinear").select("id.col", "id.row", F.col("sampled").alias("value"))


def tile_heights(points: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Adds ``height`` to points (id, col, row) from tiled cells (tile_col, tile_row, col, row, value):
    the cell of the point's own tile; cells and points meet by tile and cell."""
    p = points.withColumns({"tile_col": F.expr(f"col div {size}"), "tile_row": F.expr(f"row div {size}")})
    t = tiles.select("tile_col", "tile_row", "col", "row", F.col("value").alias("height"))
    return p.join(t, ["tile_col", "tile_row", "col", "row"], "left").drop("tile_col", "tile_row")


def covered(samples: DataFrame, value: str = "weighted") -> DataFrame:
    """The samples, if any has a value; no coverage at all is an error."""
    if samples.where(F.col(value).isNotNull()).isEmpty():
        raise ValueError("no cell is covered")
    return samples
