"""Queries over images: quality, masks, features of tiles, positions, matching plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import imagery
from geoloom.registry import query
from geoloom.sources.bindings import table

_PIXELS = (
    "(p_partkey - 1) // 400 as image", "((p_partkey - 1) % 20)::int as x", "(((p_partkey - 1) // 20) % 20)::int as y",
    "((p_size * 5) % 256)::int as red", "((p_partkey * 37) % 256)::int as green", "((p_partkey * p_partkey) % 251)::int as blue",
)


def _spark(columns: tuple[str, ...]) -> list[str]:
    """The same expressions in Spark's spelling."""
    return [c.replace(" // ", " div ").replace("::int", "").replace("::double", "") for c in columns]


_STENCIL = """n as (select *, lag(l) over e as w, lead(l) over e as e from p window e as (partition by image, y order by x)),
st as (select *, lag(w) over s as nw, lag(l) over s as nl, lag(e) over s as ne, lead(w) over s as sw, lead(l) over s as sl, lead(e) over s as se from n window s as (partition by image, x order by y)),
g as (select image, 4 * l - w - e - nl - sl as lap, ne - nw + 2 * e - 2 * w + se - sw as gx, sw + 2 * sl + se - nw - 2 * nl - ne as gy from st where w + e + nl + sl + nw + ne + sw + se is not null)"""


@query(
    "image_quality",
    f"""with q as (select {", ".join(_PIXELS)} from part), p as (select *, (2126 * red + 7152 * green + 722 * blue)::bigint as l from q), {_STENCIL},
a as (select image, count(*) as n, sum(l)::double as sum_l, count(*) filter (greatest(red, green, blue) <= 2) as dark, count(*) filter (greatest(red, green, blue) >= 253) as light from p group by image),
b as (select image, (l * 255 + 1275000) // 2550000 as bin, count(*) as k from p group by all), h as (select image, round(-sum(k / n * log2(k / n)), 9) as entropy from b join a using (image) group by image),
c as (select image, count(*) as m, sum(lap)::double as lap, sum(lap * lap)::double as lap2, sum(gx * gx)::double as xx, sum(gx * gy)::double as xy, sum(gy * gy)::double as yy,
  count(*) filter (sqrt((gx * gx + gy * gy)::double) >= 0.04::double * 4 * 2550000) as textured from g group by image),
r as (select image, greatest(0.0, lap2 / m - (lap / m) * (lap / m)) / 10200000 / 10200000 as lv, (xx + yy) / m / 10200000 / 10200000 as tenengrad,
  case when xx + yy > 0 then least(1.0, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy)) else 0.0 end as coherence, degrees(atan2(2 * xy, xx - yy)) * 0.5 as angle,
  sum_l / n / 2550000 as mean_luminance, dark / n as shadow, light / n as highlight, entropy, textured / m as textured from a join h using (image) join c using (image))
select image, round(lv, 9) as laplacian_variance, round(tenengrad, 9) as tenengrad, round(coherence, 9) as coherence, round(case when angle < 0 then angle + 180 else angle end, 6) as angle,
  round(mean_luminance, 9) as mean_luminance, round(shadow, 9) as shadow, round(highlight, 9) as highlight, entropy, round(textured, 9) as textured,
  concat_ws(',', case when shadow >= 0.02 then 'shadow_clipping' end, case when highlight >= 0.02 then 'highlight_clipping' end, case when lv < 0.0004 then 'low_sharpness' end,
    case when entropy < 4 then 'low_texture' end, case when coherence >= 0.75 and lv < 0.0016 then 'directional_blur' end) as warnings from r""",
)
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = imagery.image_quality(table(spark, sf_dir, "part").selectExpr(*_spark(_PIXELS)))
    rounded = [F.round(c, 9).alias(c) for c in ("laplacian_variance", "tenengrad", "coherence", "mean_luminance", "shadow", "highlight", "textured")]
    return q.select("image", *rounded, F.round("angle", 6).alias("angle"), "entropy", F.concat_ws(",", "warnings").alias("warnings"))


_STROKES = (
    "c_nationkey as image", "c_custkey as ordinal", "c_custkey % 4 <> 0 as add", "((c_custkey * 7) % 120)::double as x0", "((c_custkey * 5) % 90)::double as y0",
    "((c_custkey * 7) % 120 + c_custkey % 9)::double as x1", "((c_custkey * 5) % 90 + c_custkey % 5)::double as y1", "(c_custkey % 3 + 1)::double as radius",
)
_BRUSH = f"""with s as (select {", ".join(_STROKES)} from customer),
g as (select *, unnest(range(greatest(0, least(119, floor(least(y0, y1) - radius)))::int, greatest(0, least(119, ceil(greatest(y0, y1) + radius)))::int + 1)) as y from s),
h as (select *, unnest(range(greatest(0, least(159, floor(least(x0, x1) - radius)))::int, greatest(0, least(159, ceil(greatest(x0, x1) + radius)))::int + 1)) as x from g),
t as (select *, greatest(0.0::double, least(1.0::double, coalesce(((x + 0.5 - x0) * (x1 - x0) + (y + 0.5 - y0) * (y1 - y0))::double / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0), 0))) as t from h),
d as (select *, (x + 0.5 - x0 - t * (x1 - x0)) * (x + 0.5 - x0 - t * (x1 - x0)) + (y + 0.5 - y0 - t * (y1 - y0)) * (y + 0.5 - y0 - t * (y1 - y0)) as off from t),
m as (select image, x::int as x, y::int as y, arg_max(add, ordinal) as masked from d where off <= radius * radius group by all), k as (select image, x, y from m where masked)"""


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    strokes = table(spark, sf_dir, "customer").selectExpr(*[c.replace("::double", " / 1d") if "::double" in c else c for c in _STROKES])
    return imagery.brushed(strokes, 160, 120)


@query("mask_brush", f"{_BRUSH} select * from k")
def mask_brush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir)


@query("mask_raster", f"{_BRUSH} select image, count(*)::bigint as n from k group by image")
def mask_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imagery.masked_pixels(imagery.mask_words(_masked(spark, sf_dir), 160))


@query("merged_tile_features")
def merged_tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(
        "user_id % 40 as image", "event_id % 4 as tile", "event_id as id", "double(event_id % 97) / 2 as x", "double(event_id % 89) / 2 as y", "double(event_id % 4 % 2) * 40 as origin_x",
        "double(event_id % 4 div 2) * 40 as origin_y", "case when user_id % 40 > 3 then floor(value * 8) end as score", "double(event_id % 31) as proxy",
    )
    return imagery.merged_tile_features(e, 300)


_PHOTOS = (
    "s_suppkey as id", "case when s_suppkey % 3 > 0 then (s_suppkey % 100)::double end as vendor_lat", "case when s_suppkey % 5 > 0 then (s_suppkey % 200)::double end as vendor_lon",
    "case when s_suppkey % 7 > 0 then (s_suppkey % 90)::double end as vendor_alt", "case when s_suppkey % 4 > 0 then 47.5::double end as lat", "case when s_suppkey % 4 > 0 then 9.75::double end as lon",
    "case when s_suppkey % 2 > 0 then 400.0::double end as alt", "case s_suppkey % 6 when 0 then ' Fixed ' when 1 then '50' when 2 then '16' end as rtk_flag",
    "case when s_suppkey % 6 < 4 then (s_suppkey % 16)::double / 64 end as rtk_lon", "case when s_suppkey % 6 < 4 then (s_suppkey % 8)::double / 64 end as rtk_lat", "case when s_suppkey % 6 < 3 then (s_suppkey % 32)::double / 64 end as rtk_alt",
)


@query(
    "position_priors",
    f"""with p as (select {", ".join(_PHOTOS)} from supplier), k as (select *, coalesce(vendor_lat between -90 and 90 and vendor_lon between -180 and 180, false) as ok from p), f as (select *, ok or (lat is not null and lon is not null) as found from k)
select id, case when ok then vendor_lat else lat end as prior_lat, case when ok then vendor_lon else lon end as prior_lon, case when ok then coalesce(vendor_alt, alt) else alt end as prior_alt,
  coalesce(lower(trim(rtk_flag)) in ('fixed', '50') and rtk_lon <= 0.1 and rtk_lat <= 0.1 and coalesce(rtk_alt <= 0.2, true), false) as rtk_fixed,
  case when found then case when rtk_lon is not null and rtk_lat is not null then greatest(rtk_lon, rtk_lat, 0.01::double) else 25.0::double end end as sigma_h,
  case when found then greatest(coalesce(rtk_alt, 50.0::double), 0.02::double) end as sigma_v,
  case when found then case when rtk_flag is not null or rtk_lon is not null or rtk_lat is not null or rtk_alt is not null then 'vendor_rtk' else 'exif' end end as source from f""",
)
def position_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    import re

    photos = table(spark, sf_dir, "supplier").selectExpr(*[re.sub(r"\(([^()]*)\)::double|([0-9.]+)::double", lambda m: f"double({m[1] or m[2]})", c) for c in _PHOTOS])
    return imagery.position_priors(photos).select("id", "prior_lat", "prior_lon", "prior_alt", "rtk_fixed", "sigma_h", "sigma_v", "source")


@query("device_classes", "select case when c_mktsegment = 'AUTOMOBILE' then 'drone' when c_mktsegment = 'BUILDING' then 'smartphone' when c_mktsegment = 'FURNITURE' then 'unknown' when c_mktsegment = 'MACHINERY' then 'action_camera' else 'system_camera' end as kind, count(*)::bigint as n from customer group by kind")
def device_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = F.expr("case c_mktsegment when 'AUTOMOBILE' then 'DJI' when 'BUILDING' then 'Apple' when 'FURNITURE' then null when 'MACHINERY' then 'Insta360' else 'Canon' end")
    return table(spark, sf_dir, "customer").groupBy(imagery.device_class(make, F.lit(None)).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "new_images",
    "with f as (select 'image-' || sha256((o_custkey % 5000)::varchar) as id, min('p' || lpad(o_orderkey::varchar, 12, '0')) as path from orders group by 1) "
    "select id, path from f where id not in (select 'image-' || sha256(c_custkey::varchar) from customer where c_custkey % 3 = 0)",
)
def new_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("path"), F.sha2((F.col("o_custkey") % 5000).cast("string"), 256).alias("hash"))
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("image-"), F.sha2(F.col("c_custkey").cast("string"), 256)).alias("id"))
    return imagery.new_images(found, known)


_REQUESTS = "select o_orderkey as id, case o_orderkey % 4 when 0 then 'fast' when 1 then 'quality' when 2 then 'robust' else 'none' end as profile, (o_custkey % 20)::int as images, case when o_custkey % 3 = 0 then (o_custkey * 50)::int end as edge, case when o_custkey % 5 = 0 then (o_custkey * 90)::int end as keypoints from orders"
_RESOLVED = f"""with q as ({_REQUESTS}), d(profile, wide, learned, large, de, dk, block) as (values ('quality', false, false, true, 8192, 8000, 32), ('robust', true, false, false, 12000, 12000, 16), ('fast', false, true, true, 2400, 5500, 64)),
r as (select id, q.profile, images, coalesce(edge, de) as edge, coalesce(keypoints, dk) as keypoints, learned, large, block, de from q left join d using (profile)),
v as (select *, case when de is null then 'profile' when images < 2 then 'too few images' when edge not between 1024 and 32768 then 'edge' when keypoints not between 500 and 50000 then 'keypoints' end as problem from r)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "case o_orderkey % 4 when 0 then 'fast' when 1 then 'quality' when 2 then 'robust' else 'none' end as profile", "int(o_custkey % 20) as images",
        "case when o_custkey % 3 = 0 then int(o_custkey * 50) end as edge", "case when o_custkey % 5 = 0 then int(o_custkey * 90) end as keypoints",
    )
    return imagery.resolved_profiles(q)


@query("alignment_profiles", f"{_RESOLVED} select id, profile, edge, keypoints, block as pair_block, problem from v")
def alignment_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("id", "profile", "edge", "keypoints", "pair_block", "problem")


@query(
    "matching_passes",
    f"""{_RESOLVED}, p as (select *, case when learned then 'quality_gate' else 'always' end as l, case when large then 'quality_gate' else 'always' end as g from v where problem is null),
u as (select id, unnest(case when profile = 'fast' then [0, 1, 2, 3] else [1, 0, 2, 3] end) as ordinal, unnest(['sift', 'aliked', 'dedode', 'dense']) as backend, unnest(['always', l, g, 'sparse_exhausted']) as condition from p)
select id, ordinal::int as ordinal, backend, condition from u""",
)
def matching_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imagery.matching_passes(_resolved(spark, sf_dir)).select("id", "ordinal", "backend", "condition")
