"""Batch graphs, sweeps and checks. Graphs are small and planned on the driver."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topological(nodes: Mapping[str, Sequence[str]]) -> list[str]:
    """Node names, each after those it depends on; ties by name. A cycle is an error."""
    left = {n: set(d) for n, d in nodes.items()}
    if missing := {d for ds in left.values() for d in ds} - left.keys():
        raise ValueError(f"unknown nodes: {sorted(missing)}")
    out: list[str] = []
    while left:
        free = sorted(n for n, d in left.items() if not d)
        if not free:
            raise ValueError(f"a cycle through {sorted(left)}")
        out.append(free[0])
        del left[free[0]]
        for d in left.values():
            d.discard(free[0])
    return out


def graph_problems(nodes: Mapping[str, dict]) -> list[tuple[str, str]]:
    """(node, problem): nodes have enabled, makes, needs [(node, artifact)]."""
    out = []
    for n in topological({k: [d for d, _ in v["needs"]] for k, v in nodes.items()}):
        for d, artifact in nodes[n]["needs"]:
            if artifact not in nodes[d]["makes"]:
                out.append((n, f"{d} does not make {artifact}"))
            if nodes[n]["enabled"] and not nodes[d]["enabled"]:
                out.append((n, f"{d} is disabled"))
    return out


def canonical(value: object) -> str:
    """JSON with sorted members and finite numbers only."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def lineage(nodes: Mapping[str, dict], inputs: Mapping[str, str]) -> dict[str, str]:
    """A hash of each node's configuration, membership and inputs."""
    out: dict[str, str] = {}
    for n in topological({k: [d for d, _ in v["needs"]] for k, v in nodes.items()}):
        told = [n, nodes[n].get("members", []), nodes[n].get("config", {}), inputs.get(n), [[d, a, out[d]] for d, a in sorted(nodes[n]["needs"])]]
        out[n] = hashlib.sha256(canonical(told).encode()).hexdigest()
    return out


def plan_chunks(need: float, available: float) -> int:
    """Chunks so that each fits; no room at all is an error."""
    if available <= 0:
        raise ValueError("no room")
    return max(1, math.ceil(need / available))


def prefix_hashes(features: Sequence[dict]) -> list[str]:
    """A running hash of a feature list; equal prefixes can be reused."""
    out, h = [], ""
    for f in features:
        h = hashlib.sha256((h + canonical(f)).encode()).hexdigest()
        out.append(h)
    return out


def axis(low: float, nominal: float, high: float, n: int | None = None) -> list[float]:
    """Low, nominal and high, or n even steps; rounded, distinct and sorted."""
    values = (low, nominal, high) if n is None else [low + (high - low) * k / max(1, n - 1) for k in range(n)]
    return sorted({round(v, 9) for v in values})


def sweep(spark: SparkSession, axes: Mapping[str, list[float]], nominal: Mapping[str, float], mode: str = "each", most: int = 64) -> DataFrame:
    """(sample, parameter columns): one at a time around the nominal, or all combinations."""
    names = sorted(axes)
    if mode == "each":
        rows = [tuple(nominal[n] for n in names)] + [tuple(v if m == n else nominal[m] for m in names) for n in names for v in axes[n] if v != nominal[n]]
    else:
        rows = list(itertools.islice(itertools.product(*(axes[n] for n in names)), most + 1))
        if len(rows) > most:
            raise ValueError(f"more than {most} samples")
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "sample int, " + ", ".join(f"`{n}` double" for n in names))


def combinations(axes: DataFrame, most: int = 64) -> DataFrame:
    """(sweep, sample, name, value): all combinations of the values of each sweep's axes (sweep, name, value).

    Samples are numbered as nested loops over the names in order would. A sample's values follow
    from its number, so nothing is joined; a sweep of more than ``most`` samples is an error.
    """
    each = axes.groupBy("sweep", "name").agg(F.array_sort(F.collect_set("value")).alias("values"))
    sweeps = each.groupBy("sweep").agg(F.array_sort(F.collect_list(F.struct("name", "values"))).alias("axes"))
    product = lambda a: F.aggregate(a, F.lit(1).cast("long"), lambda n, x: n * F.size(x["values"]))
    total = product(F.col("axes"))
    sound = F.when(total <= most, total).otherwise(F.raise_error(F.concat(F.lit(f"more than {most} samples in sweep "), F.col("sweep").cast("string"))).cast("long"))
    samples = sweeps.select("*", F.explode(F.sequence(F.lit(0).cast("long"), sound - 1)).alias("sample"))
    each = samples.select("sweep", "sample", "axes", F.posexplode("axes").alias("at", "axis"))
    stride = product(F.slice("axes", F.col("at") + 2, F.size("axes")))
    place = F.expr("sample div stride") % F.size("axis.values")
    return each.withColumn("stride", stride).select("sweep", "sample", F.col("axis.name").alias("name"), F.element_at("axis.values", (place + 1).cast("int")).alias("value"))


#: Kinds of stored checks and the metric column each reads; see ``register_check``.
CHECKS: dict[str, str] = {}


def register_check(kind: str, metric: str) -> None:
    if kind in CHECKS:
        raise ValueError(f"check kind {kind} is registered twice")
    CHECKS[kind] = metric


for _kind in ("distance", "angle", "length", "clearance", "volume", "mass", "body_count"):
    register_check(_kind, _kind)


def run_checks(rules: DataFrame, metrics: DataFrame) -> DataFrame:
    """(rule, subject, outcome): rules (rule, kind, low, high) over (subject, kind, value).

    A missing or non-finite value is an error; bounds are inclusive, null is open.
    """
    v = F.col("value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    ok = F.coalesce(v >= F.col("low"), F.lit(True)) & F.coalesce(v <= F.col("high"), F.lit(True))
    return rules.join(metrics, "kind", "left").select("rule", "subject", F.when(bad, "error").when(ok, "pass").otherwise("fail").alias("outcome"))


def summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("rule").agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("pass", "fail", "error")])


def readiness(required: DataFrame, available: DataFrame) -> DataFrame:
    """(recipe, artifact) required but not available."""
    return required.join(available.select("artifact").distinct(), "artifact", "left_anti").select("recipe", "artifact")


#: The legal transitions of a job.
TRANSITIONS = {
    "queued": ("running", "failed", "cancel_requested"),
    "paused": ("running", "failed", "cancel_requested"),
    "running": ("pause_requested", "completed", "failed", "cancel_requested"),
    "pause_requested": ("running", "paused", "failed", "cancel_requested"),
    "cancel_requested": ("cancelled", "failed", "cancel_requested"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}


def illegal_transitions(history: DataFrame) -> DataFrame:
    """(job, sequence, state, problem): illegal state changes and progress that falls."""
    from pyspark.sql import Window

    w = Window.partitionBy("job").orderBy("sequence")
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in (a, *bs)]
    h = history.withColumns({"_s": F.lag("state").over(w), "_p": F.lag("progress").over(w)})
    p = F.when(F.col("_s").isNotNull() & ~F.concat_ws(">", "_s", "state").isin(pairs), "transition").when((F.col("_s") == F.col("state")) & (F.col("progress") < F.col("_p")), "progress")
    return h.select("job", "sequence", "state", p.alias("problem")).where("problem is not null")


def prerequisites(needs: DataFrame, available: DataFrame) -> DataFrame:
    """(product, met, missing): products whose every group of artifacts (product, grp, artifact)
    has one that is available (artifact); ``missing`` is the first group without."""
    a = available.select("artifact").distinct().withColumn("_there", F.lit(True))
    g = needs.join(a, "artifact", "left").groupBy("product", "grp").agg(F.bool_or(F.coalesce("_there", F.lit(False))).alias("ok"))
    return g.groupBy("product").agg(F.bool_and("ok").alias("met"), F.min(F.when(~F.col("ok"), F.col("grp"))).alias("missing"))


def derived_edges(steps: DataFrame) -> DataFrame:
    """(source, target, artifact): each step (step, ordinal, makes, needs: arrays) depends on the last
    step before it that makes what it needs."""
    m = steps.select(F.col("step").alias("source"), F.col("ordinal").alias("o"), F.explode("makes").alias("artifact"))
    n = steps.select(F.col("step").alias("target"), "ordinal", F.explode("needs").alias("artifact"))
    j = n.join(m, "artifact").where("o < ordinal")
    return j.groupBy("target", "artifact").agg(F.max_by("source", F.struct("o", "source")).alias("source")).select("source", "target", "artifact")


def resume_problems(jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(job, sequence, problem) of checkpoints (job, sequence, kind, config, input, committed) against
    jobs (job, kind, config, input): foreign, of other settings, uncommitted or out of order."""
    from pyspark.sql import Window

    j = jobs.select("job", F.col("kind").alias("_k"), F.col("config").alias("_c"), F.col("input").alias("_i"))
    c = checkpoints.withColumn("_last", F.max("sequence").over(Window.partitionBy("job").orderBy("written").rowsBetween(Window.unboundedPreceding, -1)))
    same = F.col("kind").eqNullSafe(F.col("_k")) & F.col("config").eqNullSafe(F.col("_c")) & F.col("input").eqNullSafe(F.col("_i"))
    p = F.when(F.col("_k").isNull(), "foreign").when(~same, "incompatible").when(~F.col("committed"), "uncommitted").when(F.col("sequence") <= F.col("_last"), "order")
    return c.join(j, "job", "left").select("job", "sequence", p.alias("problem")).where("problem is not null")


def sweep_report(outcomes: DataFrame) -> DataFrame:
    """(sweep, n, rebuilt, refused, failed, passed): counts of samples (sweep, state, checks_failed)."""
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    ok = (F.col("state") == "rebuilt") & (F.col("checks_failed") == 0)
    return outcomes.groupBy("sweep").agg(F.count("*").alias("n"), state("rebuilt"), state("refused"), state("failed"), F.count_if(ok).alias("passed"))


def resolved_parameters(constants: DataFrame, terms: DataFrame) -> DataFrame:
    """(name, value, problem): parameters (name, constant) plus terms (name, ref, factor) of others.

    Each round resolves what refers to resolved values only. What is left refers to a
    circle; an unknown or unresolved reference and a sum that is not finite have a problem
    and no value.
    """
    from geoloom.session import cut

    known = constants.select(F.col("name").alias("ref")).distinct()
    unknown = terms.join(known, "ref", "left_anti").select("name").distinct().withColumn("_u", F.lit(True))
    done = constants.join(terms.select("name").distinct(), "name", "left_anti").select("name", F.col("constant").alias("value")).transform(cut)
    left = constants.join(done.select("name"), "name", "left_anti").transform(cut)
    while True:
        v = done.select(F.col("name").alias("ref"), F.col("value").alias("_v"), F.lit(True).alias("_known"))
        sums = terms.join(left.select("name"), "name", "left_semi").join(v, "ref", "left").groupBy("name")
        sums = sums.agg(F.sum(F.col("factor") * F.col("_v")).alias("_s"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("_all"))
        fresh = left.join(sums.where("_all"), "name").select("name", (F.col("constant") + F.col("_s")).alias("value")).transform(cut)
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh).transform(cut)
        left = left.join(fresh.select("name"), "name", "left_anti").transform(cut)
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    good = done.select("name", F.when(~bad, F.col("value")).alias("value"), F.when(bad, "not finite").alias("problem"))
    rest = left.join(unknown, "name", "left").select("name", F.lit(None).cast("double").alias("value"), F.when(F.col("_u"), "unknown").otherwise("circle").alias("problem"))
    return good.unionByName(rest)


def artifact_problems(artifacts: DataFrame) -> DataFrame:
    """(id, problem) of typed artifacts (id, offset, length, stride, width, shape: array, size)."""
    n = F.aggregate("shape", F.lit(1).cast("long"), lambda a, v: a * v)
    p = (
        F.when((F.col("offset") < 0) | (F.col("length") < 0) | (F.col("offset") + F.col("length") > F.col("size")), "range")
        .when(F.col("width") < 1, "width")
        .when(F.col("stride") < F.col("width"), "stride")
        .when(F.exists("shape", lambda v: v < 1), "shape")
        .when(n * F.col("stride") != F.col("length"), "length")
    )
    return artifacts.select("id", p.alias("problem")).where("problem is not null")


def octree_metadata(metadata: DataFrame) -> DataFrame:
    """(id, attribute, offset, size, problem): the attributes of point files' metadata (id, version,
    encoding, scale: array, attributes: array of name, size) with their byte offsets by normalised name.

    A problem of the whole file is told on each of its rows; position takes 12 bytes and
    classification one.
    """
    whole = (
        F.when(~F.col("version").startswith("2"), "version")
        .when(~F.col("encoding").isin("DEFAULT", "UNCOMPRESSED"), "encoding")
        .when(F.size("attributes") == 0, "attributes")
        .when(F.exists("scale", lambda s: (s == 0) | F.isnan(s) | (F.abs(s) == float("inf"))), "scale")
    )
    m = metadata.select("id", whole.alias("_w"), "attributes", F.posexplode("attributes").alias("_k", "_a"))
    name = F.regexp_replace(F.lower(F.col("_a.name")), "[^a-z0-9]+", "")
    offset = F.aggregate(F.slice("attributes", F.lit(1), F.col("_k")), F.lit(0).cast("long"), lambda s, a: s + a["size"])
    size = F.col("_a.size")
    own = F.when((name == "position") & (size != 12), "size").when((name == "classification") & (size != 1), "size")
    return m.select("id", name.alias("attribute"), offset.alias("offset"), size.cast("long").alias("size"), F.coalesce("_w", own).alias("problem"))
