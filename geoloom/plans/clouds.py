"""Queries over octree point clouds and height grids made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import grids, terrain
from geoloom.registry import query
from geoloom.session import shared_dir
from geoloom.sources import bindings, octree

EXTRA = {"id": "int64", "classification": "uint8"}


def _cloud(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Octree folders of all orders as points, and their names."""
    folder = f"{shared_dir(spark)}/octree-{uuid.uuid4().hex}"
    points = bindings.points(spark, sf_dir).withColumnRenamed("cls", "classification")
    return folder, octree.write_octrees(points, folder, 1 / 64, EXTRA, tile_points=4000, node_points=100)


@query("octree_scan", f"select id, x, y, z, cls as classification from ({bindings.POINTS_SQL})")
def octree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points, written as octrees of several pages and levels and read back by ranges."""
    folder, names = _cloud(spark, sf_dir)
    return octree.octree_points(spark, folder, list(EXTRA), roots=names).select("id", "x", "y", "z", F.col("classification").cast("int").alias("classification"))


@query("octree_coarse_scan", f"select least(count(*), 1)::bigint as some, (select count(*) from orders)::bigint as points, true as coarser from ({bindings.POINTS_SQL})")
def octree_coarse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first levels of all octrees hold some of the points, and none twice."""
    folder, names = _cloud(spark, sf_dir)
    coarse = octree.octree_points(spark, folder, ["id"], deepest=1, roots=names).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
    every = names.agg(F.sum("points").alias("points"))
    return coarse.join(every, F.lit(True)).select(F.least("n", F.lit(1)).cast("long").alias("some"), "points", ((F.col("n") == F.col("ids")) & (F.col("n") <= F.col("points"))).alias("coarser"))


#: A height grid of lowest points: cells of 64 units, tiles of 8 cells.
_STEP, _TILE = 64.0, 8
_GRID = f"g as (select floor(x / 64)::bigint as col, floor(y / 64)::bigint as row, min(z) as value from ({bindings.POINTS_SQL}) group by all having min(z) < 60), size as (select max(col) + 1 as w, max(row) + 1 as h from g)"


def _heights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    cells = grids.raster(bindings.points(spark, sf_dir), _STEP).select("col", "row", F.col("min_z").alias("value")).where("value < 60")
    size = cells.agg(F.max("col"), F.max("row")).first()
    return cells, (size[0] if size[0] is not None else -1) + 1, (size[1] if size[1] is not None else -1) + 1


@query(
    "seamless_terrain",
    f"""with {_GRID}, own as (select col // {_TILE} as tile_col, row // {_TILE} as tile_row, * from g),
halo as (select tile_col, tile_row, value from own union all select tile_col - 1, tile_row, value from own where col % {_TILE} = 0 union all select tile_col, tile_row - 1, value from own where row % {_TILE} = 0
union all select tile_col - 1, tile_row - 1, value from own where col % {_TILE} = 0 and row % {_TILE} = 0),
z as (select tile_col, tile_row, min(value) as min_z, max(value) as max_z from halo where exists (select 1 from own where own.tile_col = halo.tile_col and own.tile_row = halo.tile_row) group by all),
q as (select a.tile_col, a.tile_row, 2 * count(*) as n from own a join g b on b.col = a.col + 1 and b.row = a.row join g c on c.col = a.col and c.row = a.row + 1 join g d on d.col = a.col + 1 and d.row = a.row + 1 group by all)
select tile_col, tile_row, (({_TILE} + (tile_col < (w - 1) // {_TILE})::int) * ({_TILE} + (tile_row < (h - 1) // {_TILE})::int))::bigint as n_vertices, coalesce(n, 0)::bigint as n_triangles, min_z, max_z from z left join q using (tile_col, tile_row), size""",
)
def seamless_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, w, h = _heights(spark, sf_dir)
    return terrain.section_tiles(cells, w, h, _STEP, size=_TILE).select("tile_col", "tile_row", "n_vertices", "n_triangles", "min_z", "max_z")


@query(
    "streamed_terrain",
    f"""with {_GRID}, own as (select col // {_TILE} as tile_col, row // {_TILE} as tile_row, (col % {_TILE})::int as x, (row % {_TILE})::int as y, value from g),
t as (select greatest(2, 4000 // (count(*) + 1)) as faces from (select distinct tile_col, tile_row from own)),
s as (select case when faces >= {2 * (_TILE - 1) ** 2} then 1 else least({_TILE - 1}, ceil(sqrt({2 * (_TILE - 1) ** 2} / faces)))::int end as stride from t),
p as (select stride, list_distinct(list_append(range(0, {_TILE}, stride), {_TILE - 1})) as ps from s), k as (select stride, unnest(list_sort(ps))::int as x, generate_subscripts(ps, 1) as i, len(ps) as n from p),
v as (select o.*, a.i, b.i as j from own o join k a on a.x = o.x join k b on b.x = o.y),
q as (select a.tile_col, a.tile_row, 2 * count(*) as n from v a join v b on b.tile_col = a.tile_col and b.tile_row = a.tile_row and b.i = a.i + 1 and b.j = a.j join v c on c.tile_col = a.tile_col and c.tile_row = a.tile_row and c.i = a.i and c.j = a.j + 1
join v d on d.tile_col = a.tile_col and d.tile_row = a.tile_row and d.i = a.i + 1 and d.j = a.j + 1 group by all)
select tile_col, tile_row, (select any_value(n * n) from k)::bigint as n_vertices, coalesce(q.n, 0)::bigint as n_triangles, min(value) as min_z, max(value) as max_z, (128 * (select any_value(stride) from k))::double as geometric_error from own left join q using (tile_col, tile_row) group by all""",
)
def streamed_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of the finest level."""
    cells, w, h = _heights(spark, sf_dir)
    tiles = terrain.render_tiles(cells, w, h, 4000, _STEP, size=_TILE).where("level = 0")
    return tiles.select("tile_col", "tile_row", "n_vertices", "n_triangles", "min_z", "max_z", "geometric_error")
