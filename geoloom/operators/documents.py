"""Versioned entities: mutations, replay, undo and validation, as joins.

State: (id, revision, body, hash, deleted). Journal: (sequence, command,
kind, related, entity, before, after), one row for each touched field's
entity; before and after are JSON bodies (null: absent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def problems(state: DataFrame, batch: DataFrame) -> DataFrame:
    """(entity, problem) of mutations (entity, op, revision) against the state."""
    s = state.select(F.col("id").alias("entity"), F.col("revision").alias("r"), F.col("deleted").alias("gone"))
    b = batch.withColumn("_n", F.count("*").over(Window.partitionBy("entity"))).join(s, "entity", "left")
    known = F.col("r").isNotNull()
    p = (
        F.when(F.col("_n") > 1, "repeated")
        .when((F.col("op") == "create") & known, "exists")
        .when((F.col("op") == "create") & (F.col("revision") != 0), "revision")
        .when((F.col("op") != "create") & ~known, "missing")
        .when((F.col("op") == "restore") & ~F.col("gone"), "alive")
        .when(F.col("op").isin("update", "delete") & F.col("gone"), "deleted")
        .when((F.col("op") != "create") & (F.col("revision") != F.col("r")), "stale")
    )
    return b.select("entity", p.alias("problem")).where("problem is not null").distinct()


def applied(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The state after valid mutations (entity, op, body): one join on the id."""
    b = batch.select(F.col("entity").alias("id"), "op", F.col("body").alias("new"))
    j = state.join(b, "id", "full_outer")
    body = F.when(F.col("op").isin("create", "update"), F.col("new")).otherwise(F.col("body"))
    return j.select(
        "id",
        F.when(F.col("op").isNull(), F.col("revision")).otherwise(F.coalesce(F.col("revision") + 1, F.lit(0))).alias("revision"),
        body.alias("body"),
        F.sha2(F.coalesce(body, F.lit("")), 256).alias("hash"),
        F.when(F.col("op") == "delete", True).when(F.col("op").isNotNull(), False).otherwise(F.col("deleted")).alias("deleted"),
    )


def replayed(journal: DataFrame) -> DataFrame:
    """(id, revision, body, deleted): the last effect of each entity, with its count of effects.

    Of effects with one sequence number the greatest body is the last; an absent body is the least.
    """
    return journal.groupBy(F.col("entity").alias("id")).agg((F.count("*") - 1).alias("revision"), F.max_by(F.struct("after"), F.struct("sequence", "after")).alias("l")).select("id", "revision", F.col("l.after").alias("body"), F.col("l.after").isNull().alias("deleted"))


def active_roots(journal: DataFrame) -> DataFrame:
    """(command, active): whether the last undo or redo of each root command leaves it done."""
    root = F.when(F.col("kind") == "command", F.col("command")).otherwise(F.col("related"))
    return journal.groupBy(root.alias("command")).agg((F.max_by("kind", "sequence") != "undo").alias("active"))


def undo_conflicts(effects: DataFrame, state: DataFrame) -> DataFrame:
    """Fields (entity, field, before, after) of a command whose current value
    (entity, field, value) is no longer what the command wrote."""
    j = effects.join(state, ["entity", "field"], "left")
    return j.where(~F.col("value").eqNullSafe(F.col("after"))).select("entity", "field")


def compensation(effects: DataFrame) -> DataFrame:
    """The effects that undo a command."""
    return effects.select("entity", "field", F.col("after").alias("before"), F.col("before").alias("after"))


def assigned(selection: DataFrame, assignments: DataFrame) -> DataFrame:
    """A field assignment for each selected entity; assignments are few and broadcast after a check."""
    n = assignments.limit(1001).count()
    if n > 1000:
        raise ValueError("more than 1,000 assignments")
    return selection.select("entity").distinct().join(F.broadcast(assignments), F.lit(True))


def orphans(entities: DataFrame) -> DataFrame:
    """(id, problem): owners and layers that don't exist, or layers of another type."""
    live = entities.select(F.col("id").alias("ref"), F.col("type").alias("t"))
    owner = entities.where("owner is not null").join(live, F.col("owner") == F.col("ref"), "left_anti").select("id", F.lit("owner").alias("problem"))
    layer = entities.select("id", F.explode("layers").alias("layer")).join(live, F.col("layer") == F.col("ref"), "left").where("t is null or t <> 'layer'").select("id", F.lit("layer").alias("problem"))
    return owner.unionByName(layer).distinct()


def updated_selection(selection: DataFrame, change: DataFrame, how: str, live: DataFrame | None = None) -> DataFrame:
    """A selection of ids after replace, union, toggle or subtract, within the live ids."""
    a, b = selection.select("id").distinct(), change.select("id").distinct()
    out = {"replace": b, "union": a.union(b).distinct(), "subtract": a.exceptAll(b), "toggle": a.exceptAll(b).union(b.exceptAll(a))}[how]
    return out if live is None else out.join(live.select("id"), "id", "left_semi")


#: The properties of an entity, and those that an edit may set.
PROPERTIES = ("type", "name", "owner", "layers", "placement", "components", "attributes", "relations", "style")
EDITABLE = ("name", "owner", "layers", "placement", "style")


def projected(entities: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(property, state, value): each property's shared value over the entities, mixed, or
    unavailable where no such property is known. No list asks for all of them."""
    wanted = list(PROPERTIES) if not wanted else wanted
    if len(set(wanted)) < len(wanted):
        raise ValueError("a property is asked for twice")
    known = [p for p in wanted if p in PROPERTIES]
    parts = [F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in known]
    spark = entities.sparkSession
    other = spark.createDataFrame([(p, "unavailable", None) for p in wanted if p not in PROPERTIES], "property string, state string, value string")
    if not parts:
        return other
    u = entities.select(F.explode(F.array(*parts)).alias("p")).groupBy("p.property")
    u = u.agg(F.min("p.value").alias("lo"), F.max("p.value").alias("hi"), F.count("p.value").alias("k"), F.count("*").alias("n"))
    same = (F.col("k") == 0) | ((F.col("k") == F.col("n")) & (F.col("lo") == F.col("hi")))
    return u.select("property", F.when(same, "shared").otherwise("mixed").alias("state"), F.when(same, F.col("lo")).alias("value")).unionByName(other)


def edit_problems(edits: DataFrame) -> DataFrame:
    """(entity, property, problem) of field edits: unknown or fixed properties, repeated fields."""
    n = F.count("*").over(Window.partitionBy("entity", "property"))
    p = F.when(~F.col("property").isin(*PROPERTIES), "unknown").when(~F.col("property").isin(*EDITABLE), "read-only").when(n > 1, "repeated")
    return edits.select("entity", "property", p.alias("problem")).where("problem is not null").distinct()


def edited(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """Entities after valid field edits (entity, property, value); each edited one is a revision on."""
    one = edits.groupBy(F.col("entity").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("_new"))
    j = entities.join(one, "id", "left").withColumn("_edited", F.col("_new").isNotNull())
    has = lambda c: F.coalesce(F.map_contains_key("_new", c), F.lit(False))
    new = {c: F.when(has(c), F.col("_new")[c].cast(entities.schema[c].dataType)).otherwise(F.col(c)) for c in EDITABLE}
    new["revision"] = F.col("revision") + F.col("_edited").cast("int")
    return j.withColumns(new).select(*entities.columns)


def commits(prepared: DataFrame) -> DataFrame:
    """Adds ``accepted`` to prepared transactions (document, sequence, command, base): a
    transaction is accepted if its base is the document's generation when its turn comes,
    which is the number of those accepted before. Commands are unique: of rows
    with one command all but the first are refused.

    Each transaction points to the first later one of the next base; what the first one of
    base 0 reaches is accepted, found by pointer jumping in a logarithmic number of rounds.
    """
    from geoloom.session import cut

    again = F.row_number().over(Window.partitionBy("document", "command").orderBy("sequence")) > 1
    p = prepared.withColumn("_again", again).transform(cut)
    t = p.where("not _again").select("document", "sequence", "base")
    both = t.withColumns({"_at": F.col("base"), "_own": F.lit(True)}).unionByName(t.withColumns({"_at": F.col("base") + 1, "_own": F.lit(False)}))
    later = Window.partitionBy("document", "_at").orderBy(F.desc("sequence")).rowsBetween(Window.unboundedPreceding, -1)
    to = F.last(F.when(F.col("_own"), F.col("sequence")), ignorenulls=True).over(later)
    jumps = both.withColumn("to", to).where("not _own").select("document", "sequence", "to").where("to is not null").transform(cut)
    reached = t.where("base = 0").groupBy("document").agg(F.min("sequence").alias("sequence")).transform(cut)
    n = reached.count()
    while True:
        step = reached.join(jumps, ["document", "sequence"]).select("document", F.col("to").alias("sequence"))
        reached = reached.unionByName(step).distinct().transform(cut)
        now = reached.count()
        if now == n:
            break
        n = now
        far = jumps.select("document", F.col("sequence").alias("to"), F.col("to").alias("far"))
        jumps = jumps.join(far, ["document", "to"]).select("document", "sequence", F.col("far").alias("to")).transform(cut)
    good = reached.withColumn("_ok", F.lit(True))
    return p.join(good, ["document", "sequence"], "left").withColumn("accepted", F.coalesce("_ok", F.lit(False))).drop("_ok", "_again")


#: Anchors that each kind of measurement needs.
ANCHORS = {"point": 1, "distance": 2, "height_difference": 2}


def measurement_problems(measurements: DataFrame) -> DataFrame:
    """(id, problem) of measurements (id, kind, metric, layer, provenance, anchors: x, y, z)."""
    need = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in ANCHORS.items()])
    deep = (F.col("kind") == "height_difference") | F.coalesce(F.col("metric") == "spatial", F.lit(False))
    bad = F.exists("anchors", lambda a: a.x.isNull() | a.y.isNull() | F.isnan(a.x) | F.isnan(a.y) | (F.abs(a.x) == float("inf")) | (F.abs(a.y) == float("inf")))
    flat = F.exists("anchors", lambda a: a.z.isNull())
    p = (
        F.when(need.isNull(), "kind")
        .when((F.trim(F.coalesce("layer", F.lit(""))) == "") | (F.trim(F.coalesce("provenance", F.lit(""))) == ""), "empty")
        .when(F.size("anchors") != need, "anchors")
        .when((F.col("kind") == "distance") != F.col("metric").isNotNull(), "metric")
        .when(bad, "not finite")
        .when(deep & flat, "no height")
    )
    return measurements.select("id", p.alias("problem")).where("problem is not null")


def measured(measurements: DataFrame) -> DataFrame:
    """(id, value): horizontal or spatial distances and height differences of valid measurements."""
    a, b = F.col("anchors")[0], F.col("anchors")[1]
    dx, dy, dz = b.x - a.x, b.y - a.y, b.z - a.z
    flat = dx * dx + dy * dy
    v = F.when((F.col("kind") == "distance") & (F.col("metric") == "spatial"), F.sqrt(flat + dz * dz)).when(F.col("kind") == "distance", F.sqrt(flat)).when(F.col("kind") == "height_difference", dz)
    good = measurements.join(measurement_problems(measurements).select("id"), "id", "left_anti").where("kind <> 'point'")
    return good.select("id", v.alias("value"))


def snapshot_problems(markers: DataFrame) -> DataFrame:
    """(id, problem) of snapshot markers (id, kind, generation, created, restore_of)."""
    p = (
        F.when(~F.col("generation").between(0, 2**53 - 1), "generation")
        .when(F.trim(F.coalesce("created", F.lit(""))) == "", "created")
        .when((F.col("kind") == "pre_restore") != F.col("restore_of").isNotNull(), "restore_of")
    )
    return markers.select("id", p.alias("problem")).where("problem is not null")


def of_type(state: DataFrame, kind: str) -> DataFrame:
    """The live entities of one type, by id: measurements, bookmarks, curves or boxes."""
    return state.where((F.col("type") == kind) & ~F.col("deleted")).orderBy("id")


def property_rows(sets: DataFrame, columns: list[str]) -> DataFrame:
    """(id, row, columns...): the rows of columnar property sets; arrays of unlike length are null-filled."""
    z = sets.select("id", F.posexplode(F.arrays_zip(*columns)).alias("row", "_v"))
    return z.select("id", "row", *[F.col(f"_v.{c}").alias(c) for c in columns])
