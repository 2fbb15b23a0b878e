"""Meshes of height grids (col, row, value) in tiles: a streamed surface and a seamless one.

Every tile has at most a fixed number of cells, so a tile is built in one task with
arrays and no task grows with the grid. Cells without data have no row or a null
value; tiles without any data have no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a tile's side; rings of cells that fill a hole at most.
TILE, RINGS = 512, 8
_COLUMNS = {
    "level": pa.int32(), "tile_col": pa.int64(), "tile_row": pa.int64(), "min_x": pa.float64(), "min_y": pa.float64(), "min_z": pa.float64(), "max_x": pa.float64(), "max_y": pa.float64(), "max_z": pa.float64(),
    "n_vertices": pa.int64(), "n_triangles": pa.int64(), "origin": pa.list_(pa.float64()), "positions": pa.list_(pa.float32()), "indices": pa.list_(pa.int32()),
}
_SCHEMA = (
    "level int, tile_col long, tile_row long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, "
    "n_vertices long, n_triangles long, origin array<double>, positions array<float>, indices array<int>"
)


def sample_stride(faces_per_tile: int, size: int = TILE) -> int:
    """The step between samples at which a tile has about so many triangles."""
    every = 2 * (size - 1) ** 2
    return 1 if faces_per_tile >= every else min(size - 1, max(1, math.ceil(math.sqrt(every / max(1, faces_per_tile)))))


def sample_places(stride: int, size: int = TILE) -> np.ndarray:
    """Every ``stride``-th cell of a side, and the last one."""
    places = np.arange(0, size, stride)
    return places if places[-1] == size - 1 else np.append(places, size - 1)


def filled(heights: np.ndarray) -> np.ndarray:
    """A hole takes the mean of the nearest ring (a square's border clipped at the tile) with data, up to ``RINGS`` cells away."""
    out = heights.copy()
    h, w = heights.shape
    for y, x in np.argwhere(np.isnan(heights)):
        for r in range(1, RINGS + 1):
            top, bottom, left, right = max(0, y - r), min(h - 1, y + r), max(0, x - r), min(w - 1, x + r)
            square = heights[top : bottom + 1, left : right + 1].copy()
            square[1:-1, 1:-1] = np.nan
            if not np.isnan(square).all():
                out[y, x] = np.nanmean(square)
                break
    return out


def triangles(heights: np.ndarray) -> np.ndarray:
    """Corner numbers (row-major) of two triangles for each cell whose four corners have data."""
    h, w = heights.shape
    there = ~np.isnan(heights)
    whole = there[:-1, :-1] & there[:-1, 1:] & there[1:, :-1] & there[1:, 1:]
    a = np.flatnonzero(np.pad(whole, ((0, 1), (0, 1))))
    return np.stack([a, a + w, a + 1, a + 1, a + w, a + w + 1], axis=1).astype(np.int32).ravel()


def _row(level: int, tile: tuple[int, int], size: int, step: float, corner: tuple[float, float], heights: np.ndarray, x: np.ndarray, y: np.ndarray, known: np.ndarray) -> dict:
    """A tile's row: positions are relative to its middle, heights where unknown are the middle's."""
    span = size * step
    min_x, max_y = corner[0] + tile[0] * span, corner[1] - tile[1] * span
    low, high = float(np.nanmin(known)), float(np.nanmax(known))
    origin = [min_x + span / 2, max_y - span / 2, (low + high) / 2]
    gx, gy = np.meshgrid(min_x + (x + 0.5) * step - origin[0], max_y - (y + 0.5) * step - origin[1])
    z = np.where(np.isnan(heights), 0.0, heights - origin[2])
    indices = triangles(heights)
    return {
        "level": level, "tile_col": tile[0], "tile_row": tile[1], "min_x": min_x, "min_y": max_y - span, "min_z": low, "max_x": min_x + span, "max_y": max_y, "max_z": high, "n_vertices": heights.size, "n_triangles": len(indices) // 3,
        "origin": origin, "positions": np.stack([gx, gy, z], axis=-1).astype(np.float32).ravel(), "indices": indices,
    }


def _built(cells: DataFrame, size: int, make: Callable[[int, tuple[int, int], np.ndarray], dict | None]) -> DataFrame:
    """Tiles of cells (level, tile_col, tile_row, x, y, value), each from one array with a column and a row for halos."""

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        level, col, row = (k.as_py() for k in key)
        heights = np.full((size + 1, size + 1), np.nan)
        heights[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("value").to_numpy()
        made = make(level, (col, row), heights)
        return pa.table({n: pa.array([made[n]] if made else [], t) for n, t in _COLUMNS.items()})

    return cells.groupBy("level", "tile_col", "tile_row").applyInArrow(tile, _SCHEMA)


def _valid(grid: DataFrame) -> DataFrame:
    v = F.col("value").cast("double")
    return grid.select(F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), v.alias("value")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e30) & (F.col("col") >= 0) & (F.col("row") >= 0))


def _placed(grid: DataFrame, size: int, level: int) -> DataFrame:
    at = {f"tile_{k}": F.expr(f"{k} div {size}") for k in ("col", "row")}
    return grid.select(F.lit(level).alias("level"), *[c.alias(n) for n, c in at.items()], F.expr(f"cast(col % {size} as int)").alias("x"), F.expr(f"cast(row % {size} as int)").alias("y"), "value")


def section_tiles(grid: DataFrame, width: int, height: int, step: float = 1.0, corner: tuple[float, float] = (0.0, 0.0), size: int = TILE, interpolate: bool = False) -> DataFrame:
    """One row for each tile with data: its mesh at full resolution, without gaps to its neighbours.

    A tile also has the first column of its eastern and the first row of its
    southern neighbour, so both have the same vertices along the seam. ``corner`` is the
    grid's least x and greatest y. With ``interpolate`` holes are filled within each tile before
    neighbours see it.
    """
    own = _placed(_valid(grid).where((F.col("col") < width) & (F.col("row") < height)), size, 0)
    if interpolate:
        own = _filled(own, size)
    last_col, last_row = (width - 1) // size, (height - 1) // size
    west, north = (F.col("x") == 0) & (F.col("tile_col") > 0), (F.col("y") == 0) & (F.col("tile_row") > 0)
    place = lambda c, r, x, y: F.struct((F.col("tile_col") - c).alias("tile_col"), (F.col("tile_row") - r).alias("tile_row"), x.cast("int").alias("x"), y.cast("int").alias("y"))
    x, y, edge = F.col("x"), F.col("y"), F.lit(size)
    places = F.array_compact(F.array(place(0, 0, x, y), F.when(west, place(1, 0, edge, y)), F.when(north, place(0, 1, x, edge)), F.when(west & north, place(1, 1, edge, edge))))
    dealt = own.select("level", F.explode(places).alias("p"), "value").select("level", "p.*", "value")

    def make(level: int, tile: tuple[int, int], heights: np.ndarray) -> dict | None:
        if np.isnan(heights[:size, :size]).all():  # only a neighbour's cells
            return None
        w, h = size + (tile[0] < last_col), size + (tile[1] < last_row)
        heights = heights[:h, :w]
        return _row(level, tile, size, step, corner, heights, np.arange(w), np.arange(h), heights)

    return _built(dealt, size, make)


def _filled(cells: DataFrame, size: int) -> DataFrame:
    """The cells of tiles, with holes near data filled from their own tile."""

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        heights = np.full((size, size), np.nan)
        heights[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("value").to_numpy()
        done = filled(heights)
        y, x = np.nonzero(~np.isnan(done))
        same = [pa.array([k.as_py()] * len(x), t) for k, t in zip(key, (pa.int32(), pa.int64(), pa.int64()))]
        return pa.table([*same, pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(done[y, x])], names=["level", "tile_col", "tile_row", "x", "y", "value"])

    return cells.groupBy("level", "tile_col", "tile_row").applyInArrow(tile, "level int, tile_col long, tile_row long, x int, y int, value double")


def coarser(grid: DataFrame) -> DataFrame:
    """The grid at half its resolution: the mean of a cell's known quarters."""
    return grid.groupBy(F.expr("col div 2").alias("col"), F.expr("row div 2").alias("row")).agg(F.avg("value").alias("value"))


def render_tiles(grid: DataFrame, width: int, height: int, target_faces: int, step: float = 1.0, corner: tuple[float, float] = (0.0, 0.0), size: int = TILE, interpolate: bool = False) -> DataFrame:
    """Tiles to be streamed: one coarse root (the highest level) and, where the grid has several tiles, those of level 0.

    All have the same step between samples, from ``target_faces`` over the tiles with data and
    the root. Adds ``geometric_error`` and ``parent_level`` (null for the root).
    """
    if target_faces < 2:
        raise ValueError("a mesh has at least two triangles")
    valid = _valid(grid).where((F.col("col") < width) & (F.col("row") < height))
    levels, root = max(0, math.ceil(math.log2(max(width, height, 1) / size))), valid
    for _ in range(levels):
        root = coarser(root)
    leaves = _placed(valid, size, 0)
    occupied = leaves.select("tile_col", "tile_row").distinct().count() if levels else 0
    stride = sample_stride(max(2, target_faces // (occupied + 1)), size)
    places = sample_places(stride, size)

    def make(level: int, tile: tuple[int, int], heights: np.ndarray) -> dict:
        heights = heights[:size, :size]
        done = filled(heights) if interpolate else heights
        return _row(level, tile, size, step * 2**level, corner, done[np.ix_(places, places)], places, places, heights)

    cells = _placed(root, size, levels)
    cells = cells.unionByName(leaves) if levels else cells
    error = F.greatest(F.pow(F.lit(2.0), F.col("level")) * step * stride * 2, F.lit(0.001))
    return _built(cells, size, make).withColumns({"geometric_error": error, "parent_level": F.when(F.col("level") < levels, F.lit(levels))})
