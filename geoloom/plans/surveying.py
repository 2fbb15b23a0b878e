"""Queries over ground control, grids of heights, transforms and solids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import control, grids, joins, sampling, solids
from geoloom.registry import query
from geoloom.sources.bindings import CONTROL_SQL, POINTS_SQL, points, table
from geoloom.sources.bindings import control as control_points

P = f"with p as ({POINTS_SQL})"
_ESTIMATES = "select id as point, east + (id % 5)::double / 8 as e_east, north - (id % 3)::double / 8 as e_north, height + (id % 7)::double / 8 as e_height from c"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_suppkey % 6 <> 4 or l_linenumber > 1").selectExpr("l_suppkey as point", "l_orderkey as image", "double(l_quantity) / 8 as error")


@query(
    "point_residuals",
    f"""with c as ({CONTROL_SQL}), t as ({_ESTIMATES}), s as (select l_suppkey as point, l_orderkey as image, l_quantity::double / 8 as error from lineitem where l_suppkey % 6 <> 4 or l_linenumber > 1),
e as (select point, count(*) as n, count(distinct image) as k, sqrt(avg(error * error)) as rms, max(error) as most from s group by point),
j as (select id as point, role, e_east - east as de, e_north - north as dn, e_height - height as dh, rms, most, role not in (2, 5) as xy, role not in (1, 4) as z,
  case when n is null then 'no samples' when k < n then 'repeated image' end as problem from c join t on t.point = c.id left join e on e.point = c.id where height is not null)
select point, role, case when xy and problem is null then de end as d_east, case when xy and problem is null then dn end as d_north, case when z and problem is null then dh end as d_height,
  case when xy and problem is null then round(sqrt(de * de + dn * dn), 9) end as horizontal, case when xy and z and problem is null then round(sqrt(de * de + dn * dn + dh * dh), 9) end as spatial,
  case when problem is null then round(case when xy and z then sqrt(de * de + dn * dn + dh * dh) when xy then sqrt(de * de + dn * dn) else abs(dh) end, 9) end as norm,
  case when problem is null then round(rms, 9) end as reprojection_rms, case when problem is null then most end as reprojection_max, problem from j""",
)
def point_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = control_points(spark, sf_dir).where("height is not null")
    t = c.selectExpr("id as point", "east + double(id % 5) / 8 as east", "north - double(id % 3) / 8 as north", "height + double(id % 7) / 8 as height")
    r = control.point_residuals(c.withColumnRenamed("id", "point"), t, _samples(spark, sf_dir))
    return r.withColumns({k: F.round(k, 9) for k in ("horizontal", "spatial", "norm", "reprojection_rms")})


_GCP = """with p as (select s_suppkey::varchar as point, case when s_suppkey % 40 = 0 then '  ' else 'P' || (s_suppkey - s_suppkey % 30 // 29) end as name, s_suppkey % 8 > 0 as enabled,
  case when s_suppkey % 33 = 0 then 'NaN'::double else s_acctbal::double end as east, 1.0::double as north, 2.0::double as height from supplier),
o as (select (l_suppkey * (case when l_orderkey % 9000 = 7 then -1 else 1 end))::varchar as point, l_orderkey as image, l_linenumber % 5 = 0 as usable from lineitem where l_suppkey % 13 > 0)"""


@query(
    "control_problems",
    f"""{_GCP}, e as (select point, 'empty' as problem from p where trim(name) = '' union all select point, 'not finite' from p where trim(name) <> '' and not isfinite(east)
union all select min(point), 'repeated name' from p group by trim(name) having count(*) > 1 union all select distinct point, 'unknown' from o where point not in (select point from p)
union all select point, 'observed twice' from o group by point, image having count(*) > 1
union all select p.point, 'too few observations' from p left join (select point, count(*) as n from o where usable group by point) u using (point) where enabled and coalesce(n, 0) < 2) select distinct point, problem from e""",
)
def control_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier").selectExpr(
        "string(s_suppkey) as point", "case when s_suppkey % 40 = 0 then '  ' else concat('P', string(s_suppkey - s_suppkey % 30 div 29)) end as name", "s_suppkey % 8 > 0 as enabled",
        "case when s_suppkey % 33 = 0 then double('NaN') else double(s_acctbal) end as east", "1d as north", "2d as height",
    )
    o = table(spark, sf_dir, "lineitem").where("l_suppkey % 13 > 0").selectExpr("string(l_suppkey * case when l_orderkey % 9000 = 7 then -1 else 1 end) as point", "l_orderkey as image", "l_linenumber % 5 = 0 as usable")
    return control.control_problems(p, o)


def _cameras(spark: SparkSession) -> DataFrame:
    """Four cameras that look down from 1,000 units, turned by quarters."""
    turns = ([1.0, 0, 0, 0, -1, 0, 0, 0, -1], [0.0, 1, 0, 1, 0, 0, 0, 0, -1], [-1.0, 0, 0, 0, 1, 0, 0, 0, -1], [0.0, -1, 0, -1, 0, 0, 0, 0, -1])
    rows = [(k, [float(v) for v in t], 400.0 * (k % 2), 300.0 * (k // 2), 1000.0, 2000.0, 1024.0, 768.0) for k, t in enumerate(turns)]
    return spark.createDataFrame(rows, "image int, rotation array<double>, cx double, cy double, cz double, focal double, pu double, pv double")


@query("local_estimates", "select c_custkey as point, (c_custkey % 300)::double as x, (c_custkey % 200)::double as y, (c_custkey % 50)::double as z, 4 as n from customer")
def local_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").selectExpr("c_custkey as point", "double(c_custkey % 300) as x", "double(c_custkey % 200) as y", "double(c_custkey % 50) as z")
    cams = _cameras(spark)
    seen = p.crossJoin(F.broadcast(cams))  # four cameras
    d = [F.col(k) - F.col(f"c{k}") for k in "xyz"]
    c = [F.col("rotation")[3 * i] * d[0] + F.col("rotation")[3 * i + 1] * d[1] + F.col("rotation")[3 * i + 2] * d[2] for i in range(3)]
    seen = seen.select("point", "image", (F.col("focal") * c[0] / c[2] + F.col("pu")).alias("u"), (F.col("focal") * c[1] / c[2] + F.col("pv")).alias("v"))
    e = control.local_estimates(seen, cams)
    return e.select("point", *[(F.round(k, 5) + 0.0).alias(k) for k in "xyz"], "n")


@query(
    "worst_images",
    "with r as (select l_suppkey as point, l_orderkey as image, l_linenumber::bigint * 100000000 + l_orderkey as ordinal, l_quantity::double as residual from lineitem), k as (select point, image, row_number() over (partition by point order by residual desc, ordinal, image) as k from r where residual < 49), "
    "f as (select point, arg_min(image, ordinal) as first from r group by point) select point, coalesce(k.image, f.first) as image from f left join (select * from k where k = 1) k using (point)",
)
def worst_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as point", "l_orderkey as image", "bigint(l_linenumber) * 100000000 + l_orderkey as ordinal", "double(l_quantity) as residual")
    return control.worst_images(r.where("residual < 49"), r)


_OPT = "select o_custkey % 3 as optimisation, o_orderkey % 100 as point, case when o_orderkey % 100 % 4 = 0 then 'checkpoint' else 'control' end as kind from orders where (o_orderkey % 100) % (o_custkey % 3 + 2) <> 1"


def _optimised(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("(o_orderkey % 100) % (o_custkey % 3 + 2) <> 1")
    return o.selectExpr("o_custkey % 3 as optimisation", "o_orderkey % 100 as point", "case when o_orderkey % 100 % 4 = 0 then 'checkpoint' else 'control' end as kind")


@query("common_controls", f"with r as ({_OPT}) select point from r where kind = 'control' group by point having count(distinct optimisation) = (select count(distinct optimisation) from r)")
def common_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.common_controls(_optimised(spark, sf_dir))


@query("report_scope", f"with r as (select distinct optimisation, kind, point::varchar as point from ({_OPT})) select optimisation, kind, count(*)::bigint as n, sha256(string_agg(point, chr(10) order by point)) as scope from r group by all")
def report_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.report_scope(_optimised(spark, sf_dir))


@query("membership_problems", f"with r as (select point, kind from ({_OPT}) union all select 2, 'checkpoint'), m as (select c_custkey as point from customer where c_custkey % 7 <> 0) select distinct point, 'outside' as problem from r where point not in (select point from m) union all select point, 'two kinds' from r group by point having count(distinct kind) > 1")
def membership_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _optimised(spark, sf_dir).select("point", "kind").union(spark.createDataFrame([(2, "checkpoint")], "point long, kind string"))
    return control.membership_problems(table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("point")), r)


@query("set_overlap", "with l as (select distinct o_custkey as k from orders where o_orderkey % 2 = 0), r as (select distinct o_custkey as k from orders where o_orderkey % 3 = 0), n as (select (select count(*) from l) as n_left, (select count(*) from r) as n_right, (select count(*) from l join r using (k)) as n_common) select *, coalesce(n_common / nullif(least(n_left, n_right), 0), 0) as share from n")
def set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), "o_orderkey")
    return control.set_overlap(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"))


@query("shared_tie_points", "with s as (select distinct l_orderkey as point, l_suppkey % 8 as image from lineitem), g as (select point, string_agg(image::varchar, ',' order by image::varchar) as images from s group by point) select images, count(*)::bigint as n from g group by images")
def shared_tie_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.shared_tie_points(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as point", "l_suppkey % 8 as image"))


@query("mean_spacing", f"{P}, s as (select id, floor(x / 16)::bigint as x, floor(y / 32)::bigint as y from p), c as (select x, y, count(*) as n from s group by all), "
       "e as (select a.x, a.y, a.n, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as m from c a join c b on a.x <> b.x or a.y <> b.y group by all), d as (select n, case when n > 1 then 0 else m end as d2 from e) select sum(n)::bigint as n, round(sum(n * sqrt(d2)) / sum(n), 6) as spacing from d")
def mean_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", F.floor(F.col("x") / 16).cast("double").alias("x"), F.floor(F.col("y") / 32).cast("double").alias("y"))
    near = joins.nearest_neighbours(p, p, 2, 4.0, dims="xy")
    other = near.where("sid <> tid").groupBy("sid").agg(F.min("d2").alias("d2"))
    return other.agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt("d2")), 6).alias("spacing"))


_GRID16 = "g as (select (k % 40)::int as col, (k // 40)::int as row, case when k % 97 > 0 then ((k * 37) % 64)::double / 4 end as value from (select distinct (p_partkey - 1) % 1600 as k from part))"
_ASKS = "q as (select id, (id % 345)::double / 8 as u, (id % 321)::double / 8 as v from p)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of 40 x 40 nodes; small tables leave nodes out."""
    k = table(spark, sf_dir, "part").selectExpr("(p_partkey - 1) % 1600 as k").distinct()
    return k.selectExpr("int(k % 40) as col", "int(k div 40) as row", "case when k % 97 > 0 then double((k * 37) % 64) / 4 end as value")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).selectExpr("id", "double(id % 345) / 8 as u", "double(id % 321) / 8 as v")


_OFF = "u < 0 or v < 0 or u > 39 or v > 39"
_SAMPLED = "select id, case when bad is null then 'outside' when bad > 0 then 'missing' end as problem, case when bad = 0 then s end as sampled from q left join (select id, sum(w * value) as s, count(*) filter (value is null) as bad from a left join g using (col, row) group by id) using (id)"


@query("grid_nearest", f"{P}, {_GRID16}, {_ASKS}, a as (select id, floor(u + 0.5)::int as col, floor(v + 0.5)::int as row, 1.0::double as w from q where not ({_OFF})) {_SAMPLED}")
def grid_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.grid_values(_asked(spark, sf_dir), _nodes(spark, sf_dir), 40, 40, "nearest").select("id", "problem", "sampled")


_TAP = "least(38, floor(u))::int as i, least(38, floor(v))::int as j"


@query("grid_bilinear", f"{P}, {_GRID16}, {_ASKS}, b as (select *, {_TAP} from q where not ({_OFF})), a as (select id, i + di as col, j + dj as row, (case di when 0 then 1 - (u - i) else u - i end) * (case dj when 0 then 1 - (v - j) else v - j end) as w from b, (values (0), (1)) x(di), (values (0), (1)) y(dj)) {_SAMPLED}")
def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.grid_values(_asked(spark, sf_dir), _nodes(spark, sf_dir), 40, 40, "bilinear").select("id", "problem", "sampled")


_CR = lambda t, d: f"(case {d} when -1 then (-{t}*{t}*{t} + 2*{t}*{t} - {t}) / 2 when 0 then (3*{t}*{t}*{t} - 5*{t}*{t} + 2) / 2 when 1 then (-3*{t}*{t}*{t} + 4*{t}*{t} + {t}) / 2 else ({t}*{t}*{t} - {t}*{t}) / 2 end)"


@query("grid_cubic", f"{P}, {_GRID16}, {_ASKS}, b as (select *, floor(u)::int as i, floor(v)::int as j, u - floor(u) as t, v - floor(v) as s from q where not ({_OFF})), a as (select id, greatest(0, least(39, i + di)) as col, greatest(0, least(39, j + dj)) as row, {_CR('t', 'di')} * {_CR('s', 'dj')} as w from b, (values (-1), (0), (1), (2)) x(di), (values (-1), (0), (1), (2)) y(dj)) {_SAMPLED}")
def grid_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.grid_values(_asked(spark, sf_dir), _nodes(spark, sf_dir), 40, 40, "cubic").select("id", "problem", "sampled")


_MINIMA = "g as (select floor(x / 64)::int as col, floor(y / 64)::int as row, min(z) as value from p group by all), size as (select max(col) as w, max(row) as h from g)"


@query(
    "raster_warp",
    f"{P}, {_MINIMA}, t as (select distinct floor(x / 32)::int + 4 as tc, floor(y / 32)::int + 8 as tr from p), q as (select tc, tr, (tc - 4)::double / 2 as u, (tr - 8)::double / 2 as v, w, h from t, size), "
    "b as (select *, least(w - 1, floor(u))::int as i, least(h - 1, floor(v))::int as j from q where not (u < 0 or v < 0 or u > w or v > h)), "
    "a as (select tc, tr, i + di as col, j + dj as row, (case di when 0 then 1 - (u - i) else u - i end) * (case dj when 0 then 1 - (v - j) else v - j end) as weight from b, (values (0), (1)) x(di), (values (0), (1)) y(dj)), "
    "m as (select tc, tr, sum(weight * value) as s, count(*) filter (value is null) as bad from a left join g using (col, row) group by all) select q.tc as col, q.tr as row, case when bad = 0 then s end as value from q left join m on q.tc = m.tc and q.tr = m.tr",
)
def raster_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest points of cells of 64, drawn at twice the resolution into the cells of 32 that have points."""
    p = points(spark, sf_dir)
    source = grids.raster(p, 64.0).select("col", "row", F.col("min_z").alias("value"))
    w, h = source.agg(F.max("col") + 1, F.max("row") + 1).first()
    target = p.select((F.floor(F.col("x") / 32).cast("int") + 4).alias("col"), (F.floor(F.col("y") / 32).cast("int") + 8).alias("row")).distinct()
    return grids.warped(target, source, w, h, (2.0, 0.0, 4.0, 0.0, 2.0, 8.0))


@query("tile_heights", f"{P}, {_GRID16}, q as (select id, (id % 50)::int as col, (id % 45)::int as row from p) select id, q.col, q.row, value as height from q left join g using (col, row)")
def tile_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _nodes(spark, sf_dir).selectExpr("col div 16 as tile_col", "row div 16 as tile_row", "col", "row", "value")
    asked = points(spark, sf_dir).selectExpr("id", "int(id % 50) as col", "int(id % 45) as row")
    return grids.tile_heights(asked, tiles, 16).select("id", "col", "row", "height")


_STAGES = [("height_offset", 2.5), ("similarity", 0.0, 2.0, 8.0, 16.0), ("height_plane", 0.5, 0.25, -1.0), ("affine", 1.0, 0.0, 4.0, 0.0, 0.5, 0.0), ("identity",)]


@query("stage_cascade", f"{P}, s as (select id, x as x0, y as y0, z as z0, -2 * y + 8 as x1, 2 * x + 16 as y1, z + 2.5 as z1 from p), t as (select *, x1 + 4 as x2, y1 / 2 as y2, z1 + 0.5 * x1 + 0.25 * y1 - 1 as z2, not (x0 between 100 and 1200 and y0 between 500 and 3500) as off from s) select id, case when off then x0 else x2 end as x, case when off then y0 else y2 end as y, case when off then z0 else z2 end as z, off as flagged from t")
def stage_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    x, y, z, off = G.cascade([F.col(k) for k in "xyz"], _STAGES, (100.0, 500.0, 1200.0, 3500.0), "flag")
    return p.select("id", x.alias("x"), y.alias("y"), z.alias("z"), off.alias("flagged"))


_B = f"{P}, b as (select id % 64 as key, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from p group by 1)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solids.bounds(points(spark, sf_dir).withColumn("key", F.col("id") % 64), "key")


@query("tile_bounds", f"{_B} select * from b")
def tile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir)


@query(
    "box_octants",
    f"{_B}, h as (select *, greatest(x1 - x0, y1 - y0, z1 - z0) / 2 as h, (x0 + x1) / 2 as mx, (y0 + y1) / 2 as my, (z0 + z1) / 2 as mz from b) "
    "select key, o::int as octant, case when o & 1 > 0 then mx else mx - h end as x0, case when o & 1 > 0 then mx + h else mx end as x1, case when o & 2 > 0 then my else my - h end as y0, case when o & 2 > 0 then my + h else my end as y1, "
    "case when o & 4 > 0 then mz else mz - h end as z0, case when o & 4 > 0 then mz + h else mz end as z1 from h, range(8) r(o)",
)
def box_octants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solids.octants(solids.cube(_boxes(spark, sf_dir)))


@query("box_distances", f"{_B} select key, greatest(x0 - 40, 40 - x1, 0) * greatest(x0 - 40, 40 - x1, 0) + greatest(y0 - 10, 10 - y1, 0) * greatest(y0 - 10, 10 - y1, 0) + greatest(z0 - 200, 200 - z1, 0) * greatest(z0 - 200, 200 - z1, 0) as d2 from b")
def box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select("key", solids.distance2((40.0, 10.0, 200.0)).alias("d2"))


@query("box_ray_hits", f"{_B}, s as (select key, greatest(0.0, x0 / 2, y0 / 4) as near, least(x1 / 2, y1 / 4) as far from b where z0 <= 60 and z1 >= 60) select key, near, far from s where far >= near")
def box_ray_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, near, far = solids.ray_span((0.0, 0.0, 60.0), (2.0, 4.0, 0.0))
    return _boxes(spark, sf_dir).where(hit).select("key", near.alias("near"), far.alias("far"))


@query("section_tiles", f"{P}, b as (select id % 500 as key, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from p group by 1) select key from b where abs((x0 + x1) / 2 - 120) <= (x1 - x0) / 2 + 0.5")
def section_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = solids.bounds(points(spark, sf_dir).withColumn("key", F.col("id") % 500), "key")
    return b.where(~solids.section_misses((120.0, 0.0, 0.0), (4.0, 0.0, 0.0), 0.5)).select("key")


@query("culled_tiles", f"{P} select id from p where x + z - 100 >= -(id % 16) and -y + 3000 >= -(id % 16) and (x - 600) * (x - 600) + (y - 2000) * (y - 2000) + (z - 60) * (z - 60) <= (id % 16 + 800) * (id % 16 + 800)")
def culled_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = points(spark, sf_dir).withColumn("radius", (F.col("id") % 16).cast("double"))
    return t.where(solids.in_frustum([(1.0, 0.0, 1.0, -100.0), (0.0, -1.0, 0.0, 3000.0)]) & solids.clipped([(600.0, 2000.0, 60.0, 800.0)])).select("id")


@query("hierarchy_problems", "with t as (select n_nationkey as tile, case when n_nationkey > 1 then (n_nationkey - 1) // 2 end as parent, n_nationkey // 7 as page from nation union all select 5, 99, 0), u as (select tile, any_value(page) as up_page from t group by tile), f as (select page, min(tile) as first from t group by page) "
       "select tile, 'repeated' as problem from t group by tile having count(*) > 1 union all select tile, 'no parent' from t where parent is not null and parent not in (select tile from t) union all select tile, 'several roots' from t where parent is null "
       "union all select distinct t.tile, 'page' from t join u on t.parent = u.tile join f using (page) where t.page <> up_page and t.tile <> first")
def hierarchy_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").selectExpr("bigint(n_nationkey) as tile", "case when n_nationkey > 1 then bigint((n_nationkey - 1) div 2) end as parent", "bigint(n_nationkey div 7) as page")
    return solids.hierarchy_problems(t.union(spark.createDataFrame([(5, 99, 0)], t.schema)))


def _mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.plans.records import _meshed

    return _meshed(spark, sf_dir)


def _down_sql() -> str:
    from geoloom.plans.records import _T, _VERT

    downs = ", ".join(f"({i}, {-d[0]}::double, {-d[1]}::double, {-d[2]}::double)" for i, d in enumerate(solids.DOWNS))
    return f"""{_T}, {_VERT}, m as (select p.x as ax, p.y as ay, p.z as az, q.x as qx, q.y as qy, q.z as qz, r.x as cx, r.y as cy, r.z as cz, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) as nx,
  (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) as ny, (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) as nz from t join v p on p.id = a join v q on q.id = b join v r on r.id = c),
d(place, x, y, z) as (values {downs}), k as (select place, greatest(ax * x + ay * y + az * z, qx * x + qy * y + qz * z, cx * x + cy * y + cz * z) as top, least(ax * x + ay * y + az * z, qx * x + qy * y + qz * z, cx * x + cy * y + cz * z) as low,
  nx * x + ny * y + nz * z as hn, sqrt(nx * nx + ny * ny + nz * nz) as len from m, d), e as (select place, min(low) as low, max(top) as high from k group by place),
o as (select place, coalesce(sum(len) filter (not top <= e.low + 0.01 and degrees(asin(least(1.0, greatest(-1.0, -hn / len)))) > 45.01), 0) as overhang2, max(high) - max(e.low) as height,
  coalesce(sum(len) filter (top <= e.low + 0.01 and hn / len < -0.999), 0) as contact2, sum(len) as area2 from k join e using (place) where len > 0 group by place)
select place, round(overhang2, 6) as overhang2, height, round(contact2, 6) as contact2, row_number() over (order by round(overhang2 / (area2 * 0.005)), height, contact2 desc, place)::int as rank from o"""


@query("orientation_ranking", _down_sql())
def orientation_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = solids.ranked_orientations(solids.orientations(_mesh(spark, sf_dir)))
    return r.select("place", F.round("overhang2", 6).alias("overhang2"), "height", F.round("contact2", 6).alias("contact2"), "rank")


@query("carried_samples", "with a as (select p_partkey as id, (p_size * 3)::double / 8 as area from part), c as (select id, sum(area) over (order by id) as s, area from a) select id, (floor(s / 4) - floor((s - area) / 4))::bigint as k from c")
def carried_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "double(p_size * 3) / 8 as area")
    t = sampling.running_total(a, ["id"], "area", "s")
    return t.select("id", (F.floor(F.col("s") / 4) - F.floor((F.col("s") - F.col("area")) / 4)).alias("k"))


@query(
    "print_findings",
    "with b as (select p_partkey as body, p_partkey % 9 > 0 as valid, p_partkey % 4 > 0 as watertight, (p_size % 3)::double as z0, (p_size * 5)::double as sx, (p_size * 4 + p_partkey % 50)::double as sy, 100.0::double as sz from part), "
    "f as (select body, 'invalid' as kind, 'error' as severity, null::double as value, null as face from b where not valid union all select body, 'not_watertight', 'error', null, null from b where not watertight "
    "union all select body, 'build_volume', case when sy <= 200.000001 and sx <= 180.000001 then 'warning' else 'error' end, null, null from b where not (sx <= 200.000001 and sy <= 180.000001) "
    "union all select body, 'not_on_plate', 'info', z0, null from b where abs(z0) > 0.01 "
    "union all select body, 'overhang', 'warning', deg, face from (select l_partkey as body, l_orderkey::varchar || '-' || l_linenumber as face, l_quantity::double as deg, row_number() over (partition by l_partkey order by l_extendedprice desc, l_orderkey::varchar || '-' || l_linenumber) as r from lineitem where l_quantity > 45.01) where r <= 40) "
    "select *, (case severity when 'error' then 0 when 'warning' then 1 else 2 end)::int as place from f",
)
def print_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as body", "p_partkey % 9 > 0 as valid", "p_partkey % 4 > 0 as watertight", "0d as x0", "double(p_size * 5) as x1", "0d as y0", "double(p_size * 4 + p_partkey % 50) as y1",
        "double(p_size % 3) as z0", "double(p_size % 3) + 100 as z1",
    )
    hang = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as body", "concat(l_orderkey, '-', l_linenumber) as face", "double(l_extendedprice) as area", "double(l_quantity) as degrees")
    return solids.findings(b, hang, (200.0, 180.0, 180.0))


@query("area_contains", f"{P} select id from p where x between 100 and 900 and y between 500 and 3000")
def area_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(G.in_range(F.col("x"), 100.0, 900.0) & G.in_range(F.col("y"), 500.0, 3000.0)).select("id")

