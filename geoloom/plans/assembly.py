"""Queries over blocks that are merged, meshes and kinds of geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import merges, meshes, walls
from geoloom.registry import query
from geoloom.sources.bindings import POINTS_SQL, points, table

#: A quarter turn about the vertical axis, by rows.
_TURN = (0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    turn = [F.lit(v).alias(f"m{k}") for k, v in enumerate(_TURN)]
    return r.select(F.col("r_regionkey").alias("block"), (4 - F.col("r_regionkey")).alias("ordinal"), *turn, F.expr("if(r_regionkey = 2, 0d, double(r_regionkey) / 2 + 0.5) as scale"), *[(F.col("r_regionkey") * k).cast("double").alias(t) for k, t in zip((16, 8, 4), merges.SHIFT)])


@query(
    "merged_points",
    f"with p as (select id % 5 as block, * from ({POINTS_SQL})) select block, id, (block::double / 2 + 0.5) * -y + 16 * block as x, (block::double / 2 + 0.5) * x + 8 * block as y, (block::double / 2 + 0.5) * z + 4 * block as z, "
    "row_number() over (order by 4 - block, id)::bigint as merged from p where block <> 2",
)
def merged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select((F.col("id") % 5).alias("block"), "id", "x", "y", "z")
    return merges.merged_points(p, _blocks(spark, sf_dir).where("scale > 0"))


@query(
    "merge_problems",
    "with i as (select l_suppkey % 7 as block, l_partkey as camera from lineitem where l_suppkey % 7 <> 1 and l_linenumber = 1) select 2 as block, null::bigint as camera, 'transform' as problem union all select 1, null, 'no images' "
    "union all select distinct block, camera, 'no block' from i where block > 4 union all select min(block), camera, 'overlap' from i group by camera having count(*) > 1",
)
def merge_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "lineitem").where("l_suppkey % 7 <> 1 and l_linenumber = 1").selectExpr("l_suppkey % 7 as block", "l_partkey as camera")
    return merges.merge_problems(_blocks(spark, sf_dir), images)


@query(
    "merged_observations",
    "with i as (select s_nationkey % 5 as block, s_suppkey as image, row_number() over (order by 4 - s_nationkey % 5, s_suppkey) as mi from supplier), p as (select p_partkey % 5 as block, p_partkey as point, row_number() over (order by 4 - p_partkey % 5, p_partkey) as mp from part), "
    "o as (select l_orderkey % 5 as block, l_suppkey as image, case when l_linenumber <> 4 then l_partkey end as point from lineitem) "
    "select block, image, point, mi::bigint as merged_image, mp::bigint as merged_point, case when mi is null then 'image' when point is not null and mp is null then 'point' end as problem from o left join i using (block, image) left join p using (block, point)",
)
def merged_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    i = merges.renumbered(table(spark, sf_dir, "supplier").selectExpr("s_nationkey % 5 as block", "s_suppkey as id"), blocks)
    p = merges.renumbered(table(spark, sf_dir, "part").selectExpr("p_partkey % 5 as block", "p_partkey as id"), blocks)
    o = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 5 as block", "l_suppkey as image", "case when l_linenumber <> 4 then l_partkey end as point")
    return merges.merged_observations(o, i, p)


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ax .. cz): small triangles, one in ten of them without an area."""
    k = F.col("p_partkey")
    a = {"ax": k * 7 % 1500, "ay": k * 11 % 6000, "az": k * 13 % 125}
    b = {"bx": F.col("ax") + 16 + k % 8, "by": F.col("ay") + k % 5, "bz": F.col("az") + 4}
    c = {"cx": F.col("ax") + k % 3, "cy": F.when(k % 10 == 0, F.col("ay")).otherwise(F.col("ay") + 24 + k % 4), "cz": F.col("az") + k % 6}
    t = table(spark, sf_dir, "part").withColumns(a).withColumns(b | c)
    flat = F.col("p_partkey") % 10 == 0
    return t.select(k.alias("id"), *[F.col(f"{p}{x}").cast("double").alias(f"{p}{x}") for p in "ab" for x in "xyz"], *[F.when(flat, F.col(f"b{x}")).otherwise(F.col(f"c{x}")).cast("double").alias(f"c{x}") for x in "xyz"])


#: Sources are every fiftieth point, against all triangles; SQL would compare all pairs, so
#: the test holds it against brute force.
@query("nearest_triangles")
def nearest_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meshes.nearest_triangles(points(spark, sf_dir).where("id % 50 = 0"), mesh(spark, sf_dir), 128.0)


@query("mesh_distance")
def mesh_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mesh(spark, sf_dir)
    return meshes.least_distance(m.where("id % 2 = 0"), m.where("id % 2 = 1"), 16.0)


_KINDS = ("pointSet", "circle", "arc", "analyticCurve", "rigidFrame", "text", "rasterField", "implicitSolid", "hierarchy", "mixedBundle", "other")


@query(
    "transform_classes",
    f"""with t as (select o_orderkey as id, {list(_KINDS)}[o_orderkey % 11 + 1] as kind, o_custkey % 2 = 0 as linear, o_custkey % 3 = 0 as densify, o_custkey % 5 = 0 as strict, o_custkey % 7 < 4 as joined from orders),
c as (select *, kind in ('circle', 'arc') and not linear as bent, strict and (kind in ('analyticCurve', 'implicitSolid') or (kind in ('circle', 'arc') and not linear and not densify)) as refused from t)
select id, case when kind = 'other' then null when refused then 'unsupported' when bent or kind not in ('pointSet', 'circle', 'arc') then 'supportedWithApproximation' else 'fullySupported' end as support,
case when kind = 'other' then null when refused then 'reject' when kind in ('circle', 'arc') then case when bent and densify then 'densifyThenMapVertices' else 'mapCentreAndBestFitRadius' end
when kind = 'analyticCurve' then 'densifyThenMapVertices' when kind = 'rigidFrame' then 'mapFrameWithJacobian' when kind = 'text' then 'mapTextAnchorAndScale' when kind = 'rasterField' then 'warpRasterInverseMap'
when kind = 'implicitSolid' then 'tessellateThenMap' when kind = 'hierarchy' then 'rematerializeHierarchy' else 'mapVertices' end as strategy,
case when kind <> 'other' then concat_ws(',', case kind when 'analyticCurve' then 'analyticDensified' when 'rigidFrame' then 'orientationLinearized' when 'text' then 'textScalePolicy' when 'rasterField' then 'rasterWarpRequired'
when 'implicitSolid' then 'implicitRequiresTessellation' when 'hierarchy' then 'hierarchyMustRematerialize' when 'mixedBundle' then 'mixedRepresentation' end, case when bent and densify then 'analyticDensified' end,
case when bent and densify and joined then 'connectivityRisk' end, case when bent and not densify then 'circleBestFitApproximation' end, case when refused then 'strictExactnessBlocked' end) end as warnings from c""",
)
def transform_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 11 + 1).cast("int"))
    key = F.col("o_custkey")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), G.transform_class(kind, key % 2 == 0, key % 3 == 0, key % 5 == 0, key % 7 < 4).alias("c"))
    return found.select("id", "c.support", "c.strategy", F.when(F.col("c").isNotNull(), F.array_join("c.warnings", ",")).alias("warnings"))


def plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body, face, id, ax .. cz): each part is a plate of twelve triangles, many plates make a body."""
    k = F.col("p_partkey")
    low = [(k * m % n).cast("double") for m, n in ((7, 1500), (11, 6000), (13, 125))]
    side = [(3 + k % 5).cast("double"), (2 + k % 7).cast("double"), (k % 9 + 1).cast("double") / 8]
    corner = lambda c: [low[i] + side[i] * (c >> i & 1) for i in range(3)]
    quads = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]  # corners counterclockwise from outside
    triangles = []
    for face, (p, q, r, s) in enumerate(quads):
        for half, own in enumerate(((p, q, r), (p, r, s))):
            names = [x.alias(f"{c}{axis}") for c, number in zip("abc", own) for axis, x in zip("xyz", corner(number))]
            triangles.append(F.struct((k * 6 + face).alias("face"), (k * 12 + 2 * face + half).alias("id"), *names))
    few = table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")  # a small file, many triangles
    t = few.select((k % 40).alias("body"), F.explode(F.array(*triangles)).alias("t"))
    return t.select("body", "t.*")


#: Not expressible in SQL (a sequence of samples, rays); tested by brute force.
@query("wall_thickness")
def wall_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walls.wall_report(walls.thickness(plates(spark, sf_dir), 0.5, budget=200), 0.5)


@query("thin_faces")
def thin_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walls.thin_faces(walls.thickness(plates(spark, sf_dir), 0.5, budget=200), 0.5)
