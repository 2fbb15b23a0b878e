"""Queries over documents' edits, jobs, recipes, hierarchies and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.operators import batch, documents, filters, graphs, joins
from geoloom.registry import query
from geoloom.sources.bindings import PAIRS_SQL, POINTS_SQL, pair_hints, points, table

_ENTITIES = "select n_nationkey::bigint as id, 3 as revision, 'zone' as type, n_name as name, n_regionkey::varchar as owner, null::varchar as layers, case when n_nationkey % 2 = 0 then 'p' end as placement, 'c' as components, 'a' as attributes, 'r' as relations, 's' as style from nation"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "bigint(n_nationkey) as id", "3 as revision", "'zone' as type", "n_name as name", "string(n_regionkey) as owner", "string(null) as layers",
        "case when n_nationkey % 2 = 0 then 'p' end as placement", "'c' as components", "'a' as attributes", "'r' as relations", "'s' as style",
    )


@query(
    "property_projection",
    "select * from (values ('type', 'shared', 'zone'), ('name', 'mixed', null), ('owner', 'mixed', null), ('layers', 'shared', null), ('placement', 'mixed', null), ('components', 'shared', 'c'), "
    "('attributes', 'shared', 'a'), ('relations', 'shared', 'r'), ('style', 'shared', 's'), ('colour', 'unavailable', null)) v(property, state, value) where (select count(distinct n_name) from nation) > 1",
)
def property_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.projected(_entities(spark, sf_dir), [*documents.PROPERTIES, "colour"])


_EDITS = "select o_custkey % 25 as entity, case o_orderkey % 7 when 0 then 'type' when 1 then 'name' when 2 then 'owner' when 3 then 'placement' when 4 then 'style' when 5 then 'layers' else 'colour' end as property, min(o_orderkey) as k, count(*) as n from orders where o_orderkey % 400 < 40 group by all"


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 400 < 40")
    name = "case o_orderkey % 7 when 0 then 'type' when 1 then 'name' when 2 then 'owner' when 3 then 'placement' when 4 then 'style' when 5 then 'layers' else 'colour' end"
    return o.selectExpr("o_custkey % 25 as entity", f"{name} as property", "o_orderkey as k")


@query("edit_problems", f"with e as ({_EDITS}) select entity, property, case when property = 'colour' then 'unknown' when property = 'type' then 'read-only' else 'repeated' end as problem from e where property in ('colour', 'type') or n > 1")
def edit_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.edit_problems(_edits(spark, sf_dir))


@query(
    "field_edits",
    f"with n as ({_ENTITIES}), e as (select entity, property, 'v' || k as value from ({_EDITS}) where property not in ('colour', 'type')), p as (select n.*, max(value) filter (property = 'name') as a, max(value) filter (property = 'owner') as b, max(value) filter (property = 'placement') as c, "
    "max(value) filter (property = 'style') as d, max(value) filter (property = 'layers') as f, count(value) as k from n left join e on e.entity = n.id group by all) "
    "select id, case when k > 0 then 4 else 3 end::int as revision, coalesce(a, name) as name, coalesce(b, owner) as owner, coalesce(f, layers) as layers, coalesce(c, placement) as placement, coalesce(d, style) as style from p",
)
def field_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edits(spark, sf_dir).where("property not in ('colour', 'type')").groupBy("entity", "property").agg(F.concat(F.lit("v"), F.min("k").cast("string")).alias("value"))
    return documents.edited(_entities(spark, sf_dir), e).select("id", "revision", *documents.EDITABLE)


_TX = "select user_id as document, event_id as sequence, event_id % 5003 as command, greatest(0, (row_number() over (partition by user_id order by event_id) - 1) // 2 - (case when event_id % 5 = 0 then 1 else 0 end)) as base from events"


@query(
    "commits",
    f"""with recursive t as ({_TX}), u as (select *, row_number() over (partition by document, command order by sequence) > 1 as again from t), k as (select * from u where not again),
s(document, base, sequence) as (select document, 0::bigint, min(sequence) from k where base = 0 group by document union all select k.document, k.base, min(k.sequence) from s join k on k.document = s.document and k.base = s.base + 1 and k.sequence > s.sequence group by k.document, k.base)
select t.document, t.sequence, s.sequence is not null as accepted from t left join s on s.document = t.document and s.sequence = t.sequence""",
)
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr(
        "user_id as document", "event_id as sequence", "event_id % 5003 as command",
        "greatest(0, (row_number() over (partition by user_id order by event_id) - 1) div 2 - case when event_id % 5 = 0 then 1 else 0 end) as base",
    )
    return documents.commits(e).select("document", "sequence", "accepted")


_MEASURES = """select o_orderkey as id, ['point', 'distance', 'height_difference', 'angle'][o_orderkey % 4 + 1] as kind, case when o_custkey % 3 = 0 then 'spatial' when o_custkey % 3 = 1 then 'horizontal' end as metric,
  case when o_custkey % 31 = 0 then ' ' else 'l' end as layer, 'p' as provenance, (o_orderkey % 5 > 0)::int + 1 as n, case when o_custkey % 4 > 0 then (o_orderkey % 9)::double end as z,
  (o_custkey % 50)::double as x, (o_custkey % 40)::double as y from orders"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = "slice(array(named_struct('x', 0d, 'y', 0d, 'z', 1d), named_struct('x', double(o_custkey % 50), 'y', double(o_custkey % 40), 'z', case when o_custkey % 4 > 0 then double(o_orderkey % 9) end)), 1, int(o_orderkey % 5 > 0) + 1)"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "array('point', 'distance', 'height_difference', 'angle')[int(o_orderkey % 4)] as kind", "case when o_custkey % 3 = 0 then 'spatial' when o_custkey % 3 = 1 then 'horizontal' end as metric",
        "case when o_custkey % 31 = 0 then ' ' else 'l' end as layer", "'p' as provenance", f"{anchors} as anchors",
    )


_JUDGED = f"""with m as ({_MEASURES}), j as (select *, case when kind = 'angle' then 'kind' when trim(layer) = '' then 'empty' when n <> (case kind when 'point' then 1 else 2 end) then 'anchors'
  when (kind = 'distance') <> (metric is not null) then 'metric' when (kind = 'height_difference' or coalesce(metric = 'spatial', false)) and n = 2 and z is null then 'no height' end as problem from m)"""


@query("measurement_problems", f"{_JUDGED} select id, problem from j where problem is not null")
def measurement_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.measurement_problems(_measures(spark, sf_dir))


@query("measurements", f"{_JUDGED} select id, case when kind = 'distance' and metric = 'spatial' then sqrt(x * x + y * y + (z - 1) * (z - 1)) when kind = 'distance' then sqrt(x * x + y * y) else z - 1 end as value from j where problem is null and kind <> 'point'")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.measured(_measures(spark, sf_dir))


@query("snapshot_problems", "with m as (select o_orderkey as id, case when o_orderkey % 3 = 0 then 'pre_restore' else 'manual' end as kind, o_custkey - 5 as generation, case when o_orderkey % 11 = 0 then '' else 'x' end as created, case when o_custkey % 2 = 0 then 1 end as restore_of from orders), p as (select id, case when generation < 0 then 'generation' when created = '' then 'created' when (kind = 'pre_restore') <> (restore_of is not null) then 'restore_of' end as problem from m) select * from p where problem is not null")
def snapshot_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 3 = 0 then 'pre_restore' else 'manual' end as kind", "o_custkey - 5 as generation", "case when o_orderkey % 11 = 0 then '' else 'x' end as created", "case when o_custkey % 2 = 0 then 1 end as restore_of")
    return documents.snapshot_problems(m)


@query("entities_of_type", "select o_orderkey as id, o_orderpriority as type from orders where o_orderpriority = '1-URGENT' and o_orderkey % 6 > 0")
def entities_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") % 6 == 0).alias("deleted"))
    return documents.of_type(s, "1-URGENT").select("id", "type")


@query("property_rows", "with s as (select l_orderkey as id, list(l_partkey order by l_linenumber, l_partkey, l_suppkey) as part, list(l_suppkey order by l_linenumber, l_partkey, l_suppkey) as supplier from lineitem group by 1) select id, unnest(range(len(part)))::int as row, unnest(part) as part, unnest(supplier) as supplier from s")
def property_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("r"))
    return documents.property_rows(s.select("id", F.col("r.l_partkey").alias("part"), F.col("r.l_suppkey").alias("supplier")), ["part", "supplier"])


@query("orphans", "select o_orderkey as id, 'owner' as problem from orders where o_custkey % 40 = 3 and (o_custkey // 40 * 7) not in (select o_orderkey from orders) union select o_orderkey, 'layer' from orders where o_custkey % 40 = 4 and (o_custkey // 40 * 11) not in (select o_orderkey from orders where o_orderkey % 2 = 0)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "case when o_orderkey % 2 = 0 then 'layer' else 'item' end as type", "case when o_custkey % 40 = 3 then o_custkey div 40 * 7 end as owner",
        "case when o_custkey % 40 = 4 then array(o_custkey div 40 * 11) else array() end as layers",
    )
    return documents.orphans(e)


@query("undo_conflicts", "select o_orderkey as entity, 'priority' as field from orders where o_orderkey % 3 = 0")
def undo_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    effects = o.select(F.col("o_orderkey").alias("entity"), F.lit("priority").alias("field"), F.lit("old").alias("before"), F.col("o_orderpriority").alias("after"))
    state = o.select(F.col("o_orderkey").alias("entity"), F.lit("priority").alias("field"), F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.col("o_orderpriority")).alias("value"))
    return documents.undo_conflicts(effects, state)


@query("assigned_fields", "select distinct o_custkey as entity, f as field, v as value from orders, (values ('layer', 'a'), ('style', 'b')) x(f, v)")
def assigned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = spark.createDataFrame([("layer", "a"), ("style", "b")], "field string, value string")
    return documents.assigned(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity")), a)


@query(
    "inherited_properties",
    "with recursive e as (select n_nationkey::bigint as id, ((n_nationkey - 1) // 2)::bigint as parent from nation where n_nationkey > 0), a(id, node, depth) as (select id, id, 0 from (select id from e union select parent from e) union all select a.id, e.parent, depth + 1 from a join e on a.node = e.id), "
    "v as (select n_nationkey::bigint as node, 'region' as name, n_regionkey::varchar as value from nation where n_nationkey % 3 = 0), m as (select a.id, name, depth, min(value) as value, min(value) <> max(value) as conflict from a join v using (node) group by all) select id, name, value, depth, conflict from (select *, row_number() over (partition by id, name order by depth) as k from m) where k = 1",
)
def inherited_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    edges = n.where("n_nationkey > 0").selectExpr("bigint(n_nationkey) as id", "bigint((n_nationkey - 1) div 2) as parent")
    values = n.where("n_nationkey % 3 = 0").selectExpr("bigint(n_nationkey) as id", "'region' as name", "string(n_regionkey) as value")
    return joins.inherited(edges, values)


@query("candidate_cameras", f"with p as ({POINTS_SQL}), t as (select id, x as x0, x + 20 as x1, y as y0, y + 20 as y1 from p where cls = 2), c as (select s_suppkey as id, (s_suppkey * 13 % 1500)::double as x0, (s_suppkey * 13 % 1500)::double + 60 as x1, (s_suppkey * 29 % 4000)::double as y0, (s_suppkey * 29 % 4000)::double + 60 as y1, (s_suppkey % 10)::double as q from supplier), "
       "h as (select t.id as tile, c.id as camera, row_number() over (partition by t.id order by q desc, c.id)::int as rank from t join c on t.x0 <= c.x1 and c.x0 <= t.x1 and t.y0 <= c.y1 and c.y0 <= t.y1) select * from h where rank <= 4")
def candidate_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = points(spark, sf_dir).where("cls = 2").selectExpr("id", "x as x0", "x + 20 as x1", "y as y0", "y + 20 as y1")
    c = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as id", "double(s_suppkey * 13 % 1500) as x0", "double(s_suppkey * 13 % 1500) + 60 as x1", "double(s_suppkey * 29 % 4000) as y0", "double(s_suppkey * 29 % 4000) + 60 as y1", "double(s_suppkey % 10) as quality",
    )
    return joins.candidate_cameras(t, c, 4)


_PRE = "with n as (select distinct c_mktsegment as product, (c_custkey % 3)::int as grp, c_custkey % 40 as artifact from customer), a as (select distinct o_custkey % 40 as artifact from orders where o_custkey % 40 % 7 = 0 and o_orderkey % 2 = 0), g as (select product, grp, bool_or(a.artifact is not null) as ok from n left join a using (artifact) group by all)"


@query("product_prerequisites", f"{_PRE} select product, bool_and(ok) as met, min(grp) filter (not ok) as missing from g group by product")
def product_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").selectExpr("c_mktsegment as product", "int(c_custkey % 3) as grp", "c_custkey % 40 as artifact").distinct()
    a = table(spark, sf_dir, "orders").where("o_custkey % 40 % 7 = 0 and o_orderkey % 2 = 0").selectExpr("o_custkey % 40 as artifact")
    return batch.prerequisites(n, a)


@query("pipeline_edges", "with s as (select n_nationkey as step, n_nationkey as ordinal, [n_regionkey] as makes, [(n_regionkey + 1) % 5, (n_regionkey + 2) % 5] as needs from nation), m as (select step as source, ordinal as o, unnest(makes) as artifact from s), n as (select step as target, ordinal, unnest(needs) as artifact from s), "
       "j as (select target, artifact, source, row_number() over (partition by target, artifact order by o desc, source desc) as k from n join m using (artifact) where o < ordinal) select source, target, artifact from j where k = 1")
def pipeline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "nation").selectExpr("n_nationkey as step", "n_nationkey as ordinal", "array(n_regionkey) as makes", "array((n_regionkey + 1) % 5, (n_regionkey + 2) % 5) as needs")
    return batch.derived_edges(s)


@query(
    "resume_problems",
    "with j as (select s_suppkey as job, 'k' as kind, 'c' || s_nationkey as config, 'i' as input from supplier), c as (select ps.l_suppkey + (case when ps.l_orderkey % 900 = 5 then 1000000 else 0 end) as job, l_orderkey % 50 as sequence, l_orderkey * 10 + l_linenumber as written, 'k' as kind, "
    "case when l_orderkey % 13 = 0 then 'c' else 'c' || s_nationkey end as config, 'i' as input, l_linenumber <> 3 as committed from lineitem ps join supplier on s_suppkey = l_suppkey), "
    "l as (select *, max(sequence) over (partition by job order by written rows between unbounded preceding and 1 preceding) as last from c), p as (select l.job, l.sequence, case when j.job is null then 'foreign' when j.config <> l.config then 'incompatible' when not committed then 'uncommitted' when sequence <= last then 'order' end as problem from l left join j using (job)) select * from p where problem is not null",
)
def resume_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    jobs = s.selectExpr("s_suppkey as job", "'k' as kind", "concat('c', string(s_nationkey)) as config", "'i' as input")
    c = table(spark, sf_dir, "lineitem").join(s, F.col("s_suppkey") == F.col("l_suppkey")).selectExpr(
        "l_suppkey + case when l_orderkey % 900 = 5 then 1000000 else 0 end as job", "l_orderkey % 50 as sequence", "l_orderkey * 10 + l_linenumber as written", "'k' as kind",
        "case when l_orderkey % 13 = 0 then 'c' else concat('c', string(s_nationkey)) end as config", "'i' as input", "l_linenumber <> 3 as committed",
    )
    return batch.resume_problems(jobs, c)


@query("sweep_report", "select l_suppkey as sweep, count(*)::bigint as n, count(*) filter (l_linenumber % 3 = 0)::bigint as rebuilt, count(*) filter (l_linenumber % 3 = 1)::bigint as refused, count(*) filter (l_linenumber % 3 = 2)::bigint as failed, count(*) filter (l_linenumber % 3 = 0 and l_partkey % 4 = 0)::bigint as passed from lineitem group by 1")
def sweep_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as sweep", "array('rebuilt', 'refused', 'failed')[int(l_linenumber % 3)] as state", "l_partkey % 4 as checks_failed")
    return batch.sweep_report(o)


@query(
    "resolved_parameters",
    "with recursive p as (select p_partkey as k, p_partkey // 3 as ref, case when p_partkey % 89 = 0 then 'circle' when p_partkey % 83 = 0 then 'unknown' when p_partkey < 3 or p_partkey % 5 = 0 then 'constant' else 'term' end as kind, p_size::double as size from part), "
    "v(k, value) as (select k, size from p where kind = 'constant' union all select p.k, p.size + v.value * 0.5 from p join v on p.ref = v.k where kind = 'term') "
    "select 'p' || p.k as name, v.value, case when v.k is null then case kind when 'unknown' then 'unknown' else 'circle' end end as problem from p left join v using (k)",
)
def resolved_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts plus half of that of a third of their number; some refer to themselves or to nothing."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    k = F.col("p_partkey")
    ref = F.when(k % 89 == 0, name).when(k % 83 == 0, F.concat(F.lit("lost"), k.cast("string"))).when((k >= 3) & (k % 5 != 0), F.concat(F.lit("p"), F.expr("string(p_partkey div 3)")))
    terms = p.select(name.alias("name"), ref.alias("ref"), F.lit(0.5).alias("factor")).where("ref is not null")
    return batch.resolved_parameters(p.select(name.alias("name"), F.col("p_size").cast("double").alias("constant")), terms)


@query("artifact_problems", "with a as (select p_partkey as id, p_partkey % 50 - 1 as o, p_size * 24 as len, 4 + p_partkey % 9 as stride, 4 + p_partkey % 5 as width, p_size as n, p_partkey % 7 as m from part), p as (select id, case when o < 0 or o + len > 1200 then 'range' when stride < width then 'stride' when n < 1 or m < 1 then 'shape' when n * m * stride <> len then 'length' end as problem from a) select * from p where problem is not null")
def artifact_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "p_partkey % 50 - 1 as offset", "p_size * 24 as length", "4 + p_partkey % 9 as stride", "4 + p_partkey % 5 as width", "array(bigint(p_size), p_partkey % 7) as shape", "1200 as size")
    return batch.artifact_problems(a)


@query(
    "octree_metadata",
    "with m as (select n_nationkey as id, case when n_nationkey % 6 = 5 then '1.8' else '2.0' end as version, case when n_nationkey % 7 = 6 then 'BROTLI' else 'DEFAULT' end as encoding, case when n_nationkey % 8 = 7 then 0 else 0.5 end as scale from nation), "
    "a(name, k, \"offset\", size) as (values ('position', 0, 0, 12), ('intensity', 1, 12, 2), ('classification', 2, 14, 1)) select id, name as attribute, \"offset\"::bigint as \"offset\", (case when name = 'classification' and id % 5 = 4 then 2 else size end)::bigint as size, "
    "case when version = '1.8' then 'version' when encoding = 'BROTLI' then 'encoding' when scale = 0 then 'scale' when name = 'classification' and id % 5 = 4 then 'size' end as problem from m, a",
)
def octree_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as id", "case when n_nationkey % 6 = 5 then '1.8' else '2.0' end as version", "case when n_nationkey % 7 = 6 then 'BROTLI' else 'DEFAULT' end as encoding",
        "array(1d, 1d, case when n_nationkey % 8 = 7 then 0d else 0.5d end) as scale",
        "array(named_struct('name', 'POSITION', 'size', 12), named_struct('name', 'intensity', 'size', 2), named_struct('name', 'Classi fication', 'size', if(n_nationkey % 5 = 4, 2, 1))) as attributes",
    )
    return batch.octree_metadata(m)


@query("natural_order", "select c_custkey as id, array_to_string(list_transform(regexp_extract_all('img' || (c_custkey * 7 % 1000) || '_' || lower(c_mktsegment) || c_nationkey, '[0-9]+|[^0-9]+'), lambda r: case when regexp_matches(r, '^[0-9]') then lpad(r, 24, '0') else r end), '') as key from customer")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("IMG"), (F.col("c_custkey") * 7 % 1000).cast("string"), F.lit("_"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), G.natural_key(name).alias("key"))


@query("formatted_times", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as rfc3339, epoch_us(ts) // 1000 as millis from events")
def formatted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("rfc3339"), F.unix_millis(t).alias("millis"))


@query("recipe_readiness", "select distinct 'r' || n_regionkey as recipe, n_nationkey as artifact from nation where n_nationkey % 4 <> 0")
def recipe_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    required = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("recipe"), F.col("n_nationkey").alias("artifact"))
    return batch.readiness(required, n.where("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("artifact")))


_STATES = "['queued', 'running', 'pause_requested', 'paused', 'running', 'completed', 'cancel_requested', 'cancelled']"
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in batch.TRANSITIONS.items() for b in dict.fromkeys((a, *bs)))


@query(
    "illegal_transitions",
    f"with h as (select user_id as job, event_id as sequence, {_STATES}[event_id % 8 + 1] as state, event_id % 11 as progress from events), l as (select *, lag(state) over w as s, lag(progress) over w as p from h window w as (partition by job order by sequence)), "
    f"k(a, b) as (values {_LEGAL}), j as (select job, sequence, state, case when s is not null and k.a is null then 'transition' when s = state and progress < p then 'progress' end as problem from l left join k on k.a = s and k.b = state) select * from j where problem is not null",
)
def illegal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _STATES.replace("[", "array(").replace("]", ")")
    return batch.illegal_transitions(table(spark, sf_dir, "events").selectExpr("user_id as job", "event_id as sequence", f"{states}[int(event_id % 8)] as state", "event_id % 11 as progress"))


#: Edges from small to large numbers, but for some among the first twenty, which close circles.
_TURNED = "l_linenumber = 7 and greatest(l_suppkey % 50, l_partkey % 50) < 20"
_ENDS = "least(l_suppkey % 50, l_partkey % 50)", "greatest(l_suppkey % 50, l_partkey % 50)"


@query(
    "cyclic_edges",
    f"with recursive e as (select distinct case when {_TURNED} then {_ENDS[1]} else {_ENDS[0]} end as source, case when {_TURNED} then {_ENDS[0]} else {_ENDS[1]} end as target from lineitem where l_suppkey % 50 <> l_partkey % 50), "
    "p(source, target) as (select source, target from e union select p.source, e.target from p join e on p.target = e.source), c as (select distinct source as n from p where source = target) "
    "select distinct e.* from e where e.source in (select n from c) or exists (select 1 from p join c on p.source = c.n where p.target = e.source)",
)
def cyclic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").where("l_suppkey % 50 <> l_partkey % 50")
    return graphs.cyclic(e.selectExpr(f"if({_TURNED}, {_ENDS[1]}, {_ENDS[0]}) as source", f"if({_TURNED}, {_ENDS[0]}, {_ENDS[1]}) as target"))


@query("pair_components", "with recursive h as (select distinct o_custkey as a, o_orderkey + 10000000 as b from orders), e as (select a, b from h union select b, a from h), r(n, c) as (select a, a from e union select e.b, r.c from r join e on r.n = e.a) select n as node, min(c) as component from r group by n")
def pair_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their customers: one component for each customer."""
    return graphs.components(table(spark, sf_dir, "orders").selectExpr("o_custkey as a", "o_orderkey + 10000000 as b"))


@query("visible_tiles", "with recursive t as (select n_nationkey as tile, case when n_nationkey > 0 then (n_nationkey - 1) // 2 end as parent, (32 - n_nationkey)::double as error, (n_nationkey % 5 + 1)::double as distance, n_nationkey % 3 = 0 as adds from nation), o as (select *, tile in (select parent from t) and error / distance > 8 as open from t), "
       "w(tile, open, adds) as (select tile, open, adds from o where parent is null union all select o.tile, o.open, o.adds from w join o on o.parent = w.tile where w.open) select tile from w where not open or adds")
def visible_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "nation").selectExpr("n_nationkey as tile", "case when n_nationkey > 0 then (n_nationkey - 1) div 2 end as parent", "double(32 - n_nationkey) as error", "double(n_nationkey % 5 + 1) as distance", "if(n_nationkey % 3 = 0, 'add', 'replace') as refine")
    return graphs.visible_tiles(t, 8.0)


@query("pruned_nodes", f"with n as (select substr(lpad((id % 512)::varchar, 3, '0'), 1, 1 + (id % 3)::int) as name, sum(case when cls = 2 and x > 1200 then 1 else 0 end)::bigint as n from ({POINTS_SQL}) group by 1) select name, n from n where n > 0 or exists (select 1 from n d where d.n > 0 and d.name like n.name || '_%')")
def pruned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.substring(F.lpad((F.col("id") % 512).cast("string"), 3, "0"), F.lit(1), (1 + F.col("id") % 3).cast("int"))
    n = points(spark, sf_dir).groupBy(name.alias("name")).agg(F.sum(F.when((F.col("cls") == 2) & (F.col("x") > 1200), 1).otherwise(0)).alias("n"))
    return filters.pruned_nodes(n)
