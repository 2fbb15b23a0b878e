"""Queries over pair hints, control points, features, meshes, entities and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import batch, documents, filters, fits, graphs, joins, sampling, stats, tracking
from geoloom.registry import query
from geoloom.sources.bindings import CONTROL_SQL, FEATURES_SQL, PAIRS_SQL, POINTS_SQL, TRIANGLES_SQL, control, features, pair_hints, points, table, triangles

_EV = f"with h as ({PAIRS_SQL}), e as (select a, b, max(confidence) filter (source = 0) as gnss, max(confidence) filter (source = 1) as seq, max(confidence) filter (source = 2) as frustum, max(confidence) filter (source = 3) as retrieval from h group by a, b)"
_PASS = "coalesce(gnss >= {0}, false) or coalesce(seq >= {1}, false) or coalesce(frustum >= {2}, false) or coalesce(retrieval >= {3}, false)"
_PRIO = "3 * coalesce(gnss, 0) + 2 * coalesce(seq, 0) + 4 * coalesce(frustum, 0) + 2 * coalesce(retrieval, 0)"


@query("pair_evidence", f"{_EV} select * from e")
def pair_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pair_evidence(pair_hints(spark, sf_dir))


@query("evidence_filter", f"{_EV} select a, b from e where {_PASS.format(*filters.EVIDENCE)}")
def evidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.pair_evidence(pair_hints(spark, sf_dir)).where(filters.evidence_passes()).select("a", "b")


@query("ranked_pairs", f"{_EV} select *, {_PRIO} as priority from e where {_PASS.format(*filters.EVIDENCE)} order by priority desc, a, b limit 200")
def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.ranked_pairs(pair_hints(spark, sf_dir), 200)


@query("feature_cap", f"with f as ({FEATURES_SQL}) select * from (select *, row_number() over (partition by image order by score desc, px, py, row_index)::int as rank from f) where rank <= 16")
def feature_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped_features(features(spark, sf_dir), 16)


@query("maximum_rows", f"with f as ({FEATURES_SQL}) select coalesce(max(n), 0)::bigint as n from (select count(*) as n from f group by image)")
def maximum_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("image").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))


@query("footprint_statistics", f"with f as ({FEATURES_SQL}), r as (select image, score, row_number() over (partition by image order by score) - 1 as k, count(*) over (partition by image) as n from f where score > 0 and isfinite(score)) select image, min(score) as least, max(score) filter (k = n // 2) as median, max(score) as most from r group by image")
def footprint_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.footprint_statistics(features(spark, sf_dir), "image", "score")


_ROLE = f"with c as ({CONTROL_SQL}), m as (select id, role, case when role < 3 then 'control' else 'checkpoint' end as kind, case when role not in (2, 5) then east end as east, case when role not in (2, 5) then north end as north, case when role not in (1, 4) then height end as height from c)"


@query("role_mask", f"{_ROLE} select * from m")
def role_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.role_masked(control(spark, sf_dir))


@query("role_statistics", f"{_ROLE} select kind, count(*)::bigint as n, sqrt(sum(east * east) / count(east)) as rms_east, sqrt(sum(north * north) / count(north)) as rms_north, sqrt(sum(height * height) / count(height)) as rms_height, max(abs(east)) as max_east, max(abs(north)) as max_north, max(abs(height)) as max_height from m group by kind")
def role_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.role_statistics(stats.role_masked(control(spark, sf_dir)))


@query("residual_report", f"with c as ({CONTROL_SQL}), k as (select * from c where height is not null) select count(*)::bigint as n, sqrt(sum(east * east + north * north) / count(*)) as rms_h, sqrt(sum(height * height) / count(*)) as rms_v, sqrt(sum(east * east + north * north + height * height) / count(*)) as rms_3d, max(sqrt(east * east + north * north + height * height)) as max_3d from k")
def residual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.residual_report(control(spark, sf_dir).where("height is not null"))


@query("misclosure", f"with c as ({CONTROL_SQL}), j as (select c.id, l.x as lx, r.x as rx, l.y as ly, r.y as ry, l.z as lz, r.z as rz from c left join (select id, east as x, north as y, height as z from c) l using (id) left join (select id, east + 2 as x, north - 1 as y, height as z from c where id % 9 <> 0) r using (id)) select count(*)::bigint as n, count(*) filter (lx is null or rx is null)::bigint as n_missing, sum(abs(lx - rx)) / count(lx - rx) as dx, sum(abs(ly - ry)) / count(ly - ry) as dy, sum(abs(lz - rz)) / count(lz - rz) as dz from j")
def misclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = control(spark, sf_dir)
    left = c.select("id", F.col("east").alias("x"), F.col("north").alias("y"), F.col("height").alias("z"))
    right = c.where("id % 9 <> 0").select("id", (F.col("east") + 2).alias("x"), (F.col("north") - 1).alias("y"), F.col("height").alias("z"))
    return joins.misclosure(c, left, right)


@query("usable_observations", f"with f as ({FEATURES_SQL}), o as (select row_index % 500 as point, image, px from f where image % 4 <> 0) select point, image, px from (select *, count(*) over (partition by point) as n from o) where n >= 2")
def usable_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return joins.usable_observations(f.select((F.col("row_index") % 500).alias("point"), "image", "px"), f.where("image % 4 <> 0").select("image").distinct())


@query("shared_properties", "select 'region' as field, 'mixed' as state, null::varchar as value union all select 'kind', 'shared', 'nation' union all select 'owner', 'shared', null")
def shared_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.lit("nation").alias("kind"), F.lit(None).cast("string").alias("owner"))
    return stats.shared_or_mixed(n, ["region", "kind", "owner"])


_T = f"with t as ({TRIANGLES_SQL})"
_EDGES = f"{_T}, e as (select a as s, b as t from t union all select b, c from t union all select c, a from t), u as (select least(s, t) as lo, greatest(s, t) as hi, count(*) filter (s < t)::bigint as forward, count(*) filter (s >= t)::bigint as back from e group by all)"


@query("edge_uses", f"{_EDGES} select * from u")
def edge_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.edge_uses(triangles(spark, sf_dir))


@query("manifold_statistics", f"{_EDGES} select *, edges > 0 and boundary + non_manifold + inconsistent = 0 as watertight from (select count(*)::bigint as edges, count(*) filter (forward + back = 1)::bigint as boundary, count(*) filter (forward + back > 2)::bigint as non_manifold, count(*) filter (forward + back = 2 and forward <> back)::bigint as inconsistent from u)")
def manifold_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.manifold_statistics(triangles(spark, sf_dir))


_VERT = "v as (select k as id, (k * 31 % 64)::double as x, (k * 17 % 64)::double as y, (k * 7 % 32)::double as z from range(97) r(k))"


def _meshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.range(97).selectExpr("id", "double(id * 31 % 64) as x", "double(id * 17 % 64) as y", "double(id * 7 % 32) as z")
    return stats.corners(triangles(spark, sf_dir), v)


@query("mesh_volume", f"{_T}, {_VERT} select sum(p.x * (q.y * r.z - q.z * r.y) + p.y * (q.z * r.x - q.x * r.z) + p.z * (q.x * r.y - q.y * r.x)) as volume6 from t join v p on p.id = a join v q on q.id = b join v r on r.id = c")
def mesh_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mesh_volume(_meshed(spark, sf_dir))


_NORMAL = f"""{_T}, {_VERT}, m as (select face, p.z as az, q.z as bz, r.z as cz, (q.y - p.y) * (r.z - p.z) - (q.z - p.z) * (r.y - p.y) as nx, (q.z - p.z) * (r.x - p.x) - (q.x - p.x) * (r.z - p.z) as ny,
  (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) as nz from t join v p on p.id = a join v q on q.id = b join v r on r.id = c),
l as (select *, sqrt(nx * nx + ny * ny + nz * nz) as len from m)"""


@query(
    "overhangs",
    f"{_NORMAL} select face, round(sum(len), 6) as area2, count(*)::bigint as n from l where degrees(asin(least(1.0, greatest(-1.0, -nz / nullif(len, 0))))) > 45.01 and not (az <= 0 and bz <= 0 and cz <= 0) group by face",
)
def overhangs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overhangs(_meshed(spark, sf_dir)).withColumn("area2", F.round("area2", 6))


_PAIR_COLUMNS = (
    "l_orderkey as id", "l_linenumber as line", "l_orderkey % 300 as tentative", "(l_orderkey % 300) * (l_partkey % 11) // 10 as verified",
    "(l_orderkey % 300) * (l_suppkey % 10) // 10 as homography", "(l_orderkey % 300) * (l_partkey % 11) // 10 * (l_suppkey % 9 + 2) // 10 as cheirality",
    "l_suppkey % 70 as cells", "64 as cell_count", "(l_partkey * 7) % 3000 as parallax", "(l_orderkey * 3) % 1010 as cycle",
    "case l_linenumber % 3 when 0 then 'fast' when 1 then 'quality' else 'robust' end as profile", "l_partkey % 4 as first_degree", "l_suppkey % 4 as second_degree",
    "l_linenumber % 2 = 0 as bridge", "l_partkey % 3 = 0 as expected", "l_suppkey % 7 = 0 as failed", "l_linenumber % 4 = 1 as tried",
)
_PM = lambda n, d: f"(case when {d} = 0 then 0 else least(1000, ({n}) * 1000 // nullif({d}, 0)) end)::bigint"
_PQ = f"""with m as (select {", ".join(_PAIR_COLUMNS)} from lineitem),
g as (select *, verified > tentative or homography > tentative or cheirality > verified or cells > cell_count or cycle > 1000 as bad from m),
s as (select *, {_PM("verified", "tentative")} as i, {_PM("cells", "cell_count")} as c, {_PM("homography", "verified")} as o, {_PM("cheirality", "verified")} as h,
  least(1000, parallax * 1000 // 2000) as p from g where not bad),
q as (select *, (3 * i + 2 * c + 2 * p + 2 * h + cycle) // 10 as score, case when (o >= 900 and parallax < 1000) or (verified > 0 and h < 600) or parallax < 150 then 'degenerate'
  when verified >= 40 and i >= 300 and c >= 500 and parallax >= 1000 and h >= 800 then 'strong'
  when verified >= 15 and i >= 150 and c >= 250 and parallax >= 300 and h >= 700 then 'usable' else 'weak' end as quality from s)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[c.replace(" // ", " div ") for c in _PAIR_COLUMNS])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pair_quality(_pairs(spark, sf_dir).where(stats.pair_problem().isNull()))


@query("pair_quality", f"{_PQ} select quality, count(*)::bigint as n, sum(score)::bigint as score from q group by quality")
def pair_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy("quality").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


@query("pair_problems", f"{_PQ} select id, line from g where bad group by all")
def pair_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pair_problems(_pairs(spark, sf_dir)).select("id", "line").distinct()


_LONELY = "(first_degree < 2 or second_degree < 2)"


@query(
    "pair_rescue",
    f"""{_PQ}, r as (select *, list_filter([case when quality = 'weak' then 'weak_pair_quality' end, case when quality = 'degenerate' then 'degenerate_geometry' end,
  case when {_LONELY} then 'underconnected_image' end, case when bridge and quality <> 'strong' then 'weak_component_bridge' end,
  case when expected and verified < 30 then 'expected_overlap_missing' end, case when failed then 'registration_failed' end], lambda v: v is not null) as reasons,
  list_filter(case profile when 'fast' then ['aliked', 'dedode', 'dense'] when 'quality' then ['dedode', 'dense'] else ['dense'] end, lambda v: not (tried and v = 'dedode')) as passes from q)
select id, line, array_to_string(reasons, ',') as reasons, case when len(reasons) = 0 then '' else
  array_to_string(list_concat(passes, case when bridge or {_LONELY} then ['expand_graph'] else [] end), ',') end as actions from r group by all""",
)
def pair_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    executed = F.when(F.col("tried"), F.array(F.lit("dedode"))).otherwise(F.array().cast("array<string>"))
    r = stats.rescue(_judged(spark, sf_dir).withColumn("executed", executed))
    return r.select("id", "line", F.array_join("reasons", ",").alias("reasons"), F.array_join("actions", ",").alias("actions")).distinct()


_PARTS = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::bigint) as p{k}" for k in range(4))


@query(
    "content_fingerprint",
    f"with p as ({POINTS_SQL}), h as (select cls, sha256(id::varchar) as h from p), s as (select cls, count(*)::bigint as n, {_PARTS} from h group by cls) "
    "select cls, n, sha256(concat_ws(',', n, p0, p1, p2, p3)) as fingerprint from s",
)
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fingerprint(points(spark, sf_dir), "id", "cls")


# entities: orders; journal: lineitem rows in order
_J = "with j as (select l_orderkey as entity, l_linenumber::bigint * 100000000 + l_partkey as sequence, case when l_returnflag = 'R' then null else l_linestatus || l_quantity::int::varchar end as after from lineitem)"


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as entity", "bigint(l_linenumber) * 100000000 + l_partkey as sequence", "case when l_returnflag = 'R' then null else concat(l_linestatus, cast(cast(l_quantity as int) as string)) end as after")


# of effects with one sequence number the greatest body is the last, an absent one the least
_REPLAY = f"{_J}, r as (select entity, after, count(*) over (partition by entity) as n, row_number() over (partition by entity order by sequence desc, after desc nulls last) as k from j)"


@query("journal_replay", f"{_REPLAY} select entity as id, (n - 1)::bigint as revision, after is null as deleted from r where k = 1")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.replayed(_journal(spark, sf_dir)).select("id", "revision", "deleted")


@query("journal_replay_all", f"{_REPLAY} select entity as id, (n - 1)::bigint as revision, after as body, after is null as deleted from r where k = 1")
def journal_replay_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the bodies."""
    return documents.replayed(_journal(spark, sf_dir)).select("id", "revision", "body", "deleted")


@query("journal_page", f"{_J} select entity, sequence from j where sequence > 300000000 order by sequence, entity limit 100")
def journal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).where("sequence > 300000000").orderBy("sequence", "entity").limit(100).select("entity", "sequence")


@query("exact_selection", "select o_orderkey as id, case when o_orderkey % 11 = 0 then 'missing' else 'stale' end as problem from orders where o_orderkey % 11 = 0 or o_orderkey % 7 = 0")
def exact_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"), F.sha2(F.col("o_orderpriority"), 256).alias("hash"))
    refs = o.withColumn("revision", F.when(F.col("id") % 7 == 0, 2).otherwise(1))
    return joins.exact_selection(refs, o.where("id % 11 <> 0"))


@query("transaction_apply", "select o_orderkey as id, case when o_orderkey % 5 in (0, 1) then 2 else 1 end::int as revision, case when o_orderkey % 5 = 0 then 'edited' else o_orderpriority end as body, o_orderkey % 5 = 1 as deleted from orders union all select -o_orderkey, 0, 'new', false from orders where o_orderkey % 100 = 0 and o_orderkey > 0")
def transaction_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    state = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"), F.col("o_orderpriority").alias("body"), F.lit("").alias("hash"), F.lit(False).alias("deleted"))
    edits = o.where("o_orderkey % 5 = 0").selectExpr("o_orderkey as entity", "'update' as op", "'edited' as body")
    drops = o.where("o_orderkey % 5 = 1").selectExpr("o_orderkey as entity", "'delete' as op", "cast(null as string) as body")
    fresh = o.where("o_orderkey % 100 = 0 and o_orderkey > 0").selectExpr("-o_orderkey as entity", "'create' as op", "'new' as body")
    return documents.applied(state, edits.unionByName(drops).unionByName(fresh)).select("id", "revision", "body", "deleted")


@query("transaction_problems", "select o_orderkey as entity, case when o_orderkey % 3 = 0 then 'stale' else 'missing' end as problem from orders where o_orderkey % 3 <> 1")
def transaction_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    state = o.where("id % 3 <> 2").withColumns({"revision": F.lit(3), "deleted": F.lit(False)})
    b = o.select(F.col("id").alias("entity"), F.lit("update").alias("op"), F.when(F.col("id") % 3 == 0, 2).otherwise(3).alias("revision"))
    return documents.problems(state, b)


@query("undo_activity", "with j as (select user_id as command, ts, event_id, case when event_type in ('error') then 'undo' when event_type = 'view' then 'redo' else 'command' end as kind from events) select command, arg_max(kind, event_id) <> 'undo' as active from j group by command")
def undo_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("command"), F.col("user_id").alias("related"), F.col("event_id").alias("sequence"), F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo").otherwise("command").alias("kind"))
    return documents.active_roots(e)


@query("selection_toggle", "select o_orderkey as id from orders where (o_orderkey % 2 = 0) <> (o_orderkey % 3 = 0) and o_orderkey % 5 <> 0")
def selection_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return documents.updated_selection(o.where("id % 2 = 0"), o.where("id % 3 = 0"), "toggle", o.where("id % 5 <> 0"))


@query("duplicate_contents", "select p_brand as key, count(*)::bigint as n from part group by p_brand having count(*) > 1")
def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.duplicate_ids(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")), "key")


@query("stored_checks", "with r(rule, low, high) as (values ('small', 0.0, 1000.0), ('large', 1500.0, null), ('any', null, null)), o as (select rule, case when p_retailprice is null then 'error' when coalesce(p_retailprice >= low, true) and coalesce(p_retailprice <= high, true) then 'pass' else 'fail' end as o from r, part) select rule, count(*) filter (o = 'pass')::bigint as n_pass, count(*) filter (o = 'fail')::bigint as n_fail, count(*) filter (o = 'error')::bigint as n_error from o group by rule")
def stored_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("small", "length", 0.0, 1000.0), ("large", "length", 1500.0, None), ("any", "length", None, None)], "rule string, kind string, low double, high double")
    metrics = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.lit("length").alias("kind"), F.col("p_retailprice").alias("value"))
    return batch.summary(batch.run_checks(rules, metrics))


@query(
    "parameter_sweep",
    "with ax as (select p_size as sweep, 'x' || p_partkey % 3 as name, list_sort(list(distinct (p_partkey % 5)::double)) as vs from part group by all), s as (select sweep, list({'name': name, 'vs': vs} order by name) as axes from ax group by sweep), "
    "i as (select sweep, axes, unnest(range(list_product(list_transform(axes, lambda a: len(a.vs)))::bigint)) as sample from s), e as (select *, unnest(range(1, len(axes) + 1)) as pos from i), "
    "t as (select *, coalesce(list_product(list_transform(axes[pos + 1:], lambda a: len(a.vs))), 1)::bigint as stride from e) select sweep, sample, axes[pos].name as name, axes[pos].vs[1 + (sample // stride) % len(axes[pos].vs)] as value from t",
)
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = table(spark, sf_dir, "part").selectExpr("p_size as sweep", "concat('x', p_partkey % 3) as name", "double(p_partkey % 5) as value")
    return batch.combinations(axes, 125)


@query("resource_preflight", "select max(p_size) as ram, max(p_size * 2) as vram, sum(p_size)::bigint as scratch, sum(p_size * 3)::bigint as output from part where p_partkey % 4 <> 0")
def resource_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.preflight(table(spark, sf_dir, "part").selectExpr("p_partkey % 4 <> 0 as enabled", "p_size as ram", "p_size * 2 as vram", "p_size as scratch", "p_size * 3 as output"))


@query("windowed_counts", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*)::bigint as n from events group by all")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.streaming import streams

    out = streams.windowed_counts(table(spark, sf_dir, "events"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


_FIXES = """with f as (select event_id, case when user_id % 5 > 0 then (user_id % 20)::double end as age, event_id % 2 = 0 as dual, floor(value * 8) / 64 - 0.25 as acc from events),
g as (select *, coalesce(age < 10, false) as ok, case when acc > 0 then acc else 5.0::double end as h from f)"""


@query(
    "position_tiers",
    f"""{_FIXES} select event_id, case when ok then 'float' else 'single' end as fix, case when ok then 'ntrip_float' when dual then 'dual_frequency' else 'consumer' end as tier,
  case when ok and dual and h < 1.5 then greatest(0.15::double, least(h, 0.9::double)) when ok then greatest(0.25::double, least(h, 1.5::double)) when h < 2 then 3.0::double else h end as sigma_h,
  case when ok and dual and h < 1.5 then greatest(0.15::double, least(h, 0.9::double)) * 1.9::double when ok then greatest(0.25::double, least(h, 1.5::double)) * 2 else h * 1.8::double end as sigma_v from g""",
)
def position_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geoloom.streaming import streams

    f = table(spark, sf_dir, "events").selectExpr(
        "event_id", "case when user_id % 5 > 0 then double(user_id % 20) end as correction_age", "event_id % 2 = 0 as dual_frequency", "floor(value * 8) / 64 - 0.25d as accuracy"
    )
    return streams.position_tiers(f).select("event_id", "fix", "tier", "sigma_h", "sigma_v")


@query("video_frames")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("value") * 8).cast("double").alias("score"))
    return sampling.selected_frames(e, 3_600_000_000, 12)


@query("budgeted_admission", "with r as (select o_orderstatus as lane, o_custkey % 8 as dataset, floor(o_totalprice)::bigint as benefit, o_orderkey as tile, o_custkey % 13 + 1 as cost from orders), t as (select *, row_number() over (partition by lane, dataset order by benefit desc, tile) as turn from r), u as (select *, sum(cost) over (partition by lane order by turn, dataset) as used from t), b as (select lane, coalesce(sum(c) over (order by lane rows between unbounded preceding and 1 preceding), 0) as before from (select lane, sum(cost) as c from r group by lane)) select lane, dataset, tile, before + used <= 20000 as admitted, case when before + used > 20000 then 'budget' end as reason from u join b using (lane)")
def budgeted_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").selectExpr("o_orderstatus as lane", "o_custkey % 8 as dataset", "floor(o_totalprice) as benefit", "o_orderkey as tile", "o_custkey % 13 + 1 as cost")
    return sampling.admitted(r, 20_000)


@query("hierarchy_closure", "with recursive e as (select n_nationkey as source, (n_nationkey - 1) // 2 as target from nation where n_nationkey > 0), c as (select source, target, 1 as depth from e union all select c.source, e.target, c.depth + 1 from c join e on e.source = c.target) select source, target, min(depth)::int as depth from c group by all")
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "nation").where("n_nationkey > 0").selectExpr("n_nationkey as source", "cast((n_nationkey - 1) div 2 as int) as target")
    return graphs.closure(e, 16)


def _observation(image: str, family: str, feature: str) -> str:
    return f"named_struct('image', {image}, 'family', {family}, 'feature', {feature})"


#: An order of merges is no SQL; tested against the ordered loop.
@query("feature_tracks")
def feature_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").where("l_suppkey % 20 <> l_partkey % 20")
    family = "l_linenumber % 2"
    first, second = _observation("l_suppkey % 20", family, "l_orderkey % 700"), _observation("l_partkey % 20", family, "l_orderkey % 700")
    alias = table(spark, sf_dir, "orders").selectExpr(f"{_observation('o_custkey % 20', '0', 'o_orderkey % 700')} as first", f"{_observation('o_custkey % 20', '1', 'o_orderkey % 700')} as second", "o_totalprice as confidence")
    members, _ = tracking.feature_tracks(e.selectExpr(f"{first} as first", f"{second} as second", "l_quantity as confidence"), alias)
    name = lambda c: F.concat_ws(":", *[F.col(f"{c}.{k}").cast("string") for k in ("image", "family", "feature")])
    return members.select(name("track").alias("track"), "image", name("primary").alias("primary"), name("observation").alias("observation"))


def _facts(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "name string, value double")


@query("similarity_fit", "select * from (values ('a', 0.0::double), ('b', 2.0), ('tx', 8.0), ('ty', 16.0)) v(name, value)")
def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select(F.col("x").alias("sx"), F.col("y").alias("sy"), (-2 * F.col("y") + 8).alias("tx"), (2 * F.col("x") + 16).alias("ty"), F.lit(1.0).alias("w"))
    return _facts(spark, **{k: round(v, 6) + 0.0 for k, v in fits.similarity_2d(p).items()})


@query("robust_fit")
def robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = control(spark, sf_dir).where("height is not null")
    p = c.select(F.col("east").alias("sx"), (F.col("north") + F.col("id") % 17).alias("sy"), (F.col("height") + F.col("id") % 7).alias("sz"), F.lit(1.0).alias("w"))
    p = p.select("sx", "sy", "sz", (100 - F.col("sy")).alias("tx"), (F.col("sx") + 20).alias("ty"), (F.col("sz") - 3).alias("tz"), "w")
    f = fits.robust_pairs(p, 0.5)
    return _facts(spark, scale=round(f["scale"], 6), **{f"shift_{k}": round(float(v), 4) for k, v in zip("xyz", f["shift"])})


@query("plane_fit")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fits.plane(points(spark, sf_dir).withColumn("w", F.lit(1.0)))
    return _facts(spark, planarity=round(f["planarity"], 9), **{f"c{k}": round(v, 6) for k, v in zip("xyz", f["centroid"])})


@query("circle_fit")
def circle_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, **{k: round(v, 4) for k, v in fits.circle(points(spark, sf_dir)).items()})
