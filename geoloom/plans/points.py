"""Queries over point clouds and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import filters, grids, joins, sampling, stats
from geoloom.registry import query
from geoloom.sources.bindings import POINTS_SQL, points

P = f"with p as ({POINTS_SQL})"
BOX = {"centre": (700.0, 2000.0, 60.0), "half": (600.0, 1600.0, 50.0), "quaternion": (0.0, 0.0, 0.1, 0.995)}
_A = G.axes(BOX["quaternion"])
_INSIDE = " and ".join(f"abs((x - {BOX['centre'][0]!r}::double) * {a[0]!r}::double + (y - {BOX['centre'][1]!r}::double) * {a[1]!r}::double + (z - {BOX['centre'][2]!r}::double) * {a[2]!r}::double) <= {h!r}::double" for a, h in zip(_A, BOX["half"]))
_RASTER = "select floor(x / {s})::int as col, floor(y / {s})::int as row, count(*)::bigint as n, min(z) as min_z, max(z) as max_z, sum(z) / count(*) as mean_z, (count(*) * sum(z * z) - sum(z) * sum(z)) / (count(*) * count(*)) as var_z from {t} group by all"


@query("raster_mean", f"{P}, s as (select * from p where cls in (2, 5) and {_INSIDE}) {_RASTER.format(s=64, t='s')}")
def raster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.raster(filters.scoped(points(spark, sf_dir), (2, 5), BOX), 64.0)


@query("scope_outside", f"{P} select id from p where cls in (1, 2) and not ({_INSIDE})")
def scope_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.scoped(points(spark, sf_dir), (1, 2), BOX, keep_inside=False).select("id")


_M = (0.0, 2.0, 0.0, 0.0, -2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 8.0, 16.0, 4.0, 1.0)


@query("affine_projection", f"{P} select id, -2 * y + 8 as x, 2 * x + 16 as y, z + 4 as z from p")
def affine_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", *[c.alias(k) for c, k in zip(G.transform(_M, filters.xyz()), "xyz")])


@query("class_histogram", f"{P} select cls, count(*)::bigint as n from p group by cls")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_histogram(points(spark, sf_dir))


_SQUARE = [(100.0, 500.0, 0.0), (900.0, 500.0, 0.0), (900.0, 3000.0, 0.0), (100.0, 3000.0, 0.0)]


@query("fence_prism_keep", f"{P} select id from p where cls not in (2, 5) or (x between 100 and 900 and y between 500 and 3000)")
def fence_prism_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.segmented(points(spark, sf_dir), G.in_prism(filters.xyz(), _SQUARE, (0.0, 0.0, 1.0)), (2, 5)).select("id")


@query("fence_prism_remove", f"{P} select id from p where cls not in (2, 5) or not (x between 100 and 900 and y between 500 and 3000)")
def fence_prism_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.segmented(points(spark, sf_dir), G.in_prism(filters.xyz(), _SQUARE, (0.0, 0.0, 1.0)), (2, 5), keep=False).select("id")


@query("fence_box", f"{P} select id from p where abs(x - 700) <= 300 + 1e-9 and abs(y - 2000) <= 500 + 1e-9 and abs(z - 60) <= 30 + 1e-9")
def fence_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(G.in_fence_box(filters.xyz(), (700.0, 2000.0, 60.0), (300.0, 500.0, 30.0), (0.0, 0.0, 0.0, 1.0))).select("id")


@query("fence_frustum", f"{P}, t as (select id, x, y, 128 / (128 - z) as t from p where z < 128) select id from t where 512 + t * (x - 512) between 100 and 900 and 2048 + t * (y - 2048) between 500 and 3000")
def fence_frustum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(G.in_frustum(filters.xyz(), (512.0, 2048.0, 128.0), _SQUARE)).select("id")


@query("grid_sample", f"{P}, m as (select *, avg(z) over (partition by floor(x / 32), floor(y / 32)) as m from p), r as (select *, row_number() over (partition by floor(x / 32), floor(y / 32) order by abs(z - m), (x - (floor(x / 32) + 0.5) * 32) * (x - (floor(x / 32) + 0.5) * 32) + (y - (floor(y / 32) + 0.5) * 32) * (y - (floor(y / 32) + 0.5) * 32), id) as k from m) select id, x, y, z, cls from r where k = 1")
def grid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.grid_sample(points(spark, sf_dir), 32.0)


@query("random_sample", f"{P} select id from p where substr(sha256('{sampling.SEED:016x}' || id), 1, 13) < '{int(0.25 * 16**13):013x}'")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_sample(points(spark, sf_dir), 25).select("id")


@query("distance_sample")
def distance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.distance_sample(points(spark, sf_dir), 24.0).select("id")


@query("strided_sample", f"{P} select id from p where id % 7 = 0")
def strided_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.strided(points(spark, sf_dir), "id", 7).select("id")


@query("preview_points", f"{P} select id, x, y, z from p order by z, id limit 500")
def preview_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", "x", "y", "z").orderBy("z", "id").limit(500)


_GRID = f"{P}, b as (select min(x) as x0, min(y) as y0, floor((max(x) - min(x)) / 64)::int + 1 as w, floor((max(y) - min(y)) / 64)::int + 1 as h from p), c as (select least(w - 1, floor((x - x0) / 64))::int as col, least(h - 1, floor((y - y0) / 64))::int as row, z from p, b), m as (select col, row, min(z) as z from c group by all), g as (select q.col, q.row, m.z as value from (select unnest(range(0, w))::int as col, r as row from (select w, unnest(range(0, h))::int as r from b)) q left join m using (col, row))"


def _minimum(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    p = points(spark, sf_dir)
    g = grids.extent(p, 64.0)
    return grids.dense(grids.with_cells(p, g).groupBy("col", "row").agg(F.min("z").alias("z")), g["w"], g["h"], "z"), g


@query("minimum_grid", f"{_GRID} select * from g")
def minimum_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minimum(spark, sf_dir)[0]


def _extreme(f: str, v: str, source: str, r: int) -> str:
    return f"select *, {f}({v}_h) over (partition by col order by row rows between {r} preceding and {r} following) as {v}_o from (select *, {f}({v}) over (partition by row order by col rows between {r} preceding and {r} following) as {v}_h from {source})"


@query("morphological_opening", f"{_GRID}, e as ({_extreme('min', 'value', 'g', 2)}), d as ({_extreme('max', 'value_o', 'e', 2)}) select col, row, value, value_o_o as opened from d")
def morphological_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.opening(_minimum(spark, sf_dir)[0], 2)


@query("ground_filter")
def ground_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.ground(points(spark, sf_dir), 64.0, 256.0, 0.02, 2.0).select("id", "surface", "residual", "is_ground")


@query("ground_residuals")
def ground_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.residual_summary(grids.ground(points(spark, sf_dir), 64.0, 256.0, 0.02, 2.0).where("is_ground"))


@query("hole_fill", f"{_GRID}, n as (select *, list_filter([lag(value) over e, lead(value) over e, lag(value) over s, lead(value) over s], lambda v: v is not null) as a from g window e as (partition by row order by col), s as (partition by col order by row)) select col, row, coalesce(value, case when len(a) >= 3 then (list_sum(list_transform(a, lambda v: trunc(v)::bigint)) // len(a))::double end) as value from n")
def hole_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.holes_filled(_minimum(spark, sf_dir)[0])


@query("stencils", f"{_GRID}, a as (select *, lag(value) over e as w, lead(value) over e as e from g window e as (partition by row order by col)), st as (select *, lag(w) over s as nw, lag(value) over s as nn, lag(e) over s as ne, lead(w) over s as sw, lead(value) over s as ss, lead(e) over s as se from a window s as (partition by col order by row)) select col, row, w + e + nn + ss - 4 * value as laplacian, (ne + 2 * e + se - nw - 2 * w - sw) / 4 as sobel_x, (sw + 2 * ss + se - nw - 2 * nn - ne) / 4 as sobel_y from st where w + e + nn + ss + value + nw + ne + sw + se is not null")
def stencils(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.stencils(_minimum(spark, sf_dir)[0])


@query("grid_triangles", f"{_GRID}, n as (select *, lead(value) over (partition by row order by col) as r, lead(value) over (partition by col order by row) as d from g), q as (select *, lead(r) over (partition by col order by row) as x from n) select col, row, 0 as half from q where value is not null and r is not null and d is not null union all select col, row, 1 from q where r is not null and d is not null and x is not null")
def grid_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.cell_triangles(_minimum(spark, sf_dir)[0])


_TWO = f"{P}, s as (select * from p where id % 50 = 0), t as (select * from p)"
_D2 = "(s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) + (s.z - t.z) * (s.z - t.z)"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf_dir)
    return p.where("id % 50 = 0"), p


@query("nearest_neighbours", f"{_TWO}, d as (select s.id as sid, t.id as tid, {_D2} as d2 from s, t), r as (select *, row_number() over (partition by sid order by d2, tid)::int as rank from d) select * from r where rank <= 4")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_neighbours(*_two(spark, sf_dir), 4, 64.0)


@query("nearest_correspondence", f"{_TWO}, d as (select s.id as sid, t.id as tid, {_D2} as d2 from s, t where {_D2} < 1600) select sid, (min({{'d': d2, 't': tid}})).t as tid, min(d2) as d2 from d group by sid")
def nearest_correspondence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_correspondence(*_two(spark, sf_dir), 40.0)


@query("nearest_neighbours_all")
def nearest_neighbours_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_neighbours(*_two(spark, sf_dir), 4, 64.0)


@query("nearest_correspondence_all")
def nearest_correspondence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_correspondence(*_two(spark, sf_dir), 40.0)


@query("nearest_to_ray", f"{P}, r as (select id, (x - 500) * (x - 500) + (z - 50) * (z - 50) as o from p where y >= 0) select (min({{'o': o, 'i': id}})).i as id, min(o) as off2 from r where o < 10000")
def nearest_to_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_to_ray(points(spark, sf_dir), (500.0, 0.0, 50.0), (0.0, 1.0, 0.0), 100.0)


_BOXES = f"{P}, b as (select id, x as x0, x + 8 as x1, y as y0, y + 16 as y1, z as z0, z + 4 as z1 from p)"


@query("clearance_pairs", f"{_BOXES} select l.id as a, r.id as b from b l, b r where l.id < r.id and l.x0 <= r.x1 + 2 and r.x0 <= l.x1 + 2 and l.y0 <= r.y1 + 2 and r.y0 <= l.y1 + 2 and l.z0 <= r.z1 + 2 and r.z0 <= l.z1 + 2")
def clearance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlapping_boxes(_boxes(points(spark, sf_dir)), 2.0, 32.0)


@query("clearance_pairs_all")
def clearance_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.overlapping_boxes(_boxes(points(spark, sf_dir)), 2.0, 32.0)


def _boxes(p: DataFrame) -> DataFrame:
    return p.selectExpr("id", "x as x0", "x + 8 as x1", "y as y0", "y + 16 as y1", "z as z0", "z + 4 as z1")


@query("stratified_checkpoints", f"{P}, u as (select id, coalesce((x - min(x) over ()) / nullif(max(x) over () - min(x) over (), 0), 0.5) as ux, coalesce((y - min(y) over ()) / nullif(max(y) over () - min(y) over (), 0), 0.5) as uy from p), s as (select *, least(floor(ux * 6), 5)::int as sx, least(floor(uy * 6), 5)::int as sy from u) select sx, sy, arg_min(id, {{'d': (ux - (sx + 0.5) / 6) * (ux - (sx + 0.5) / 6) + (uy - (sy + 0.5) / 6) * (uy - (sy + 0.5) / 6), 'i': id}}) as id from s group by sx, sy")
def stratified_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_checkpoints(points(spark, sf_dir), 6)


_OCT = " || ".join(f"(4 * (floor(x * {1 << k} / 16384) % 2) + 2 * (floor(y * {1 << k} / 16384) % 2) + (floor(z * {1 << k} / 16384) % 2))::int" for k in range(1, 21))


@query(
    "octree_leaves",
    f"{P}, k as (select {_OCT} as key from p), c as (select substr(key, 1, d) as node, d, count(*)::bigint as n from k, range(0, 21) r(d) group by all) "
    "select node, n from c where (n <= 512 or d = 20) and (d = 0 or exists (select 1 from c u where u.d = c.d - 1 and u.node = substr(c.node, 1, c.d - 1) and u.n > 512))",
)
def octree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.operators import graphs

    return graphs.octree_leaves(points(spark, sf_dir), 16384.0, 512)


@query("quantised_points", f"{P} select id, (x * 8)::int as qx, round_even(y * 8, 0)::int as qy, (z * 8)::int as qz from p")
def quantised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.sources import sinks

    # a step of 1/8 below 1/64 coordinates: y is first cut to whole eighths
    p = points(spark, sf_dir).select("id", "x", F.expr("bround(y * 8) / 8").alias("y"), "z")
    return sinks.quantised(p, 0.125).select("id", "qx", "qy", "qz")


@query("elevation_tiles", f"{_GRID} select col // 16 as tile_col, row // 16 as tile_row, count(*)::bigint as n, count(value)::bigint as valid, min(value) as low, max(value) as high from g group by all")
def elevation_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.sources import sinks

    return sinks.elevation_tiles(_minimum(spark, sf_dir)[0], 16)
