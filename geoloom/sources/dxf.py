"""Drawings in ASCII DXF: pairs of lines, records, blocks, and inserts expanded to any depth the format's readers allow.

A file is read by splits. A line's number is its place in its split plus the lines
of the splits before it; two lines are a pair, and a pair of code 0 begins a record.
Which record, block or polyline a row belongs to are running counts over ranges
of the file, so no task holds a file. Inserts are expanded in rounds: each joins
the inserts found last with those inside the inserted blocks and composes the
transforms; then one join places the entities of all blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.sampling import running_total_by
from geoloom.session import cut

#: Inserts within inserts are followed so deep.
DEEPEST = 8
#: Millimetres of a drawing unit by its code; others are unknown.
UNITS = {1: 25.4, 2: 304.8, 3: 1_609_344.0, 4: 1.0, 5: 10.0, 6: 1000.0, 7: 1e6, 8: 2.54e-5, 9: 0.0254, 10: 914.4, 13: 0.001, 14: 100.0, 15: 10_000.0, 16: 100_000.0}
_IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
_POINTS = "array<struct<x:double,y:double>>"
_KEY = ["file", "block"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 0 within each file."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    splits = cut(t.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    counted = running_total_by(splits, ["file"], ["split"], "n", "upto", "before").select("file", "split", "first", "before")
    return t.join(counted, ["file", "split"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line"), "value")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, type, pairs): ``pairs`` are (code, value) in file order without the leading code 0."""
    lines = numbered_lines(spark, path)
    trimmed = F.trim(F.regexp_replace("value", "\r$", ""))
    pairs = lines.groupBy("file", F.expr("line div 2").alias("pair")).agg(F.max(F.when(F.col("line") % 2 == 0, F.expr("try_cast(trim(value) as int)"))).alias("code"), F.max(F.when(F.col("line") % 2 == 1, trimmed)).alias("value"))
    pairs = pairs.withColumn("begins", F.coalesce((F.col("code") == 0).cast("long"), F.lit(0)))
    told = running_total_by(pairs, ["file"], ["pair"], "begins", "record", "before").where("record > 0")
    r = told.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("pair", "code", "value"))).alias("all"))
    return r.select("file", "record", F.upper(F.col("all")[0]["value"]).alias("type"), F.transform(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), lambda p: F.struct(p["code"].alias("code"), p["value"].alias("value"))).alias("pairs"))


def _all(code: int) -> Column:
    return F.filter("pairs", lambda p: p["code"] == code)


def _text(code: int) -> Column:
    return F.try_element_at(_all(code), F.lit(1))["value"]


def _number(code: int, fallback: float = 0.0) -> Column:
    return F.coalesce(_text(code).try_cast("double"), F.lit(float(fallback)))


def _numbers(code: int) -> Column:
    return F.transform(_all(code), lambda p: F.coalesce(p["value"].try_cast("double"), F.lit(0.0)))


def _flag(bit: int) -> Column:
    return _number(70).cast("int").bitwiseAND(bit) != 0


def _listed(first: int, last: tuple[int, ...] = ()) -> Column:
    """Vertices of a record whose coordinates follow each other: each ``first`` begins one, ``last`` codes belong to it."""
    empty = F.expr("cast(array() as array<struct<x:double,y:double,b:double>>)")

    def add(done: Column, p: Column) -> Column:
        v = F.coalesce(p["value"].try_cast("double"), F.lit(0.0))
        top, rest = F.try_element_at(done, F.lit(-1)), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        one = lambda x, y, b: F.array(F.struct(x.alias("x"), y.alias("y"), b.alias("b")))
        begun = F.concat(done, one(v, F.lit(0.0), F.lit(0.0)))
        changed = F.when(p["code"] == last[0], F.concat(rest, one(top["x"], v, top["b"])))
        if len(last) > 1:
            changed = changed.when(p["code"] == last[1], F.concat(rest, one(top["x"], top["y"], v)))
        return F.when(p["code"] == first, begun).when(F.size(done) == 0, done).otherwise(F.coalesce(changed, done))

    return F.aggregate("pairs", empty, add)


def _within(r: DataFrame) -> DataFrame:
    """Adds ``section`` and ``block``, the record that begins a record's block (0 outside blocks)."""
    section = F.when(F.col("type") == "SECTION", F.upper(F.coalesce(_text(2), F.lit(""))))
    begins = {"in_sections": F.col("type").isin("SECTION", "ENDSEC"), "in_blocks": F.col("type").isin("BLOCK", "ENDBLK", "SECTION", "ENDSEC"), "owners": ~F.col("type").isin("VERTEX", "SEQEND")}
    for name, begin in begins.items():
        r = running_total_by(r.withColumn("one", begin.cast("long")), ["file"], ["record"], "one", name, "before").drop("one", "before")
    r = r.transform(cut)
    marks = r.where("type in ('SECTION', 'ENDSEC')").select("file", "in_sections", section.alias("section"))
    opened = r.where("type in ('BLOCK', 'ENDBLK', 'SECTION', 'ENDSEC')").select("file", "in_blocks", F.when(F.col("type") == "BLOCK", F.col("record")).otherwise(0).alias("block"))
    return r.join(marks, ["file", "in_sections"], "left").join(opened, ["file", "in_blocks"], "left").withColumn("block", F.coalesce("block", F.lit(0)))


def _similar(m: str) -> Column:
    """(scale, rotation, mirrored) of a transform that keeps shapes, else null."""
    a, b, _, d, e, _ = [F.col(m)[k] for k in range(6)]
    sx, sy = F.hypot(a, d), F.hypot(b, e)
    bent = (F.abs(sx - sy) > 1e-9 * F.greatest(sx, sy)) | (F.abs(a * b + d * e) > 1e-9 * sx * sy)
    return F.when(~bent, F.struct(sx.alias("scale"), F.atan2(d, a).alias("rotation"), (a * e - b * d < 0).alias("mirrored")))


def _composed(outer: Column, inner: Column) -> Column:
    a, b, c, d, e, f = [outer[k] for k in range(6)]
    p, q, r, s, t, u = [inner[k] for k in range(6)]
    return F.array(a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f)


def _moved(m: Column, points: Column) -> Column:
    return F.transform(points, lambda p: F.struct((m[0] * p["x"] + m[1] * p["y"] + m[2]).alias("x"), (m[3] * p["x"] + m[4] * p["y"] + m[5]).alias("y")))


def _literal(m: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(float(v)) for v in m])


def _insert_matrix() -> Column:
    """Turns, scales and moves a block's base point to the insert's place."""
    turn = F.radians(_number(50))
    cos, sin, sx, sy, x, y, bx, by = F.cos(turn), F.sin(turn), _number(41, 1), _number(42, 1), _number(10), _number(20), F.col("base.x"), F.col("base.y")
    return F.array(cos * sx, -sin * sy, x - (cos * sx * bx - sin * sy * by), sin * sx, cos * sy, y - (sin * sx * bx + cos * sy * by))


def _expanded(inserts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances (file, block, m, path), inserts beyond ``DEEPEST``) from inserts (file, block, target, m, record)."""
    first = inserts.where("block = 0").select("file", F.col("target").alias("block"), "m", F.array("record").alias("path")).transform(cut)
    inner = inserts.where("block > 0").select("file", "block", "target", F.col("m").alias("inner"), F.col("record").alias("next")).transform(cut)
    every, front = first, first
    for _ in range(DEEPEST - 1):
        front = front.join(inner, _KEY).select("file", F.col("target").alias("block"), _composed(F.col("m"), F.col("inner")).alias("m"), F.concat("path", F.array("next")).alias("path")).transform(cut)
        if front.isEmpty():
            return every, front.select("file", F.lit("").alias("problem"))
        every = every.unionByName(front)
    return every, front.join(inner, _KEY).select("file", F.lit("INSERT (nested too deeply)").alias("problem"))


def header(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, units, unit_mm) of the drawings' headers."""
    h = records(spark, path).where("type = 'SECTION'").where(F.upper(_text(2)) == "HEADER")
    after = lambda name: F.try_element_at(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("pairs") - 1, F.lit(1))), lambda i: F.when((F.try_element_at(F.col("pairs"), i)["code"] == 9) & (F.try_element_at(F.col("pairs"), i)["value"] == name), F.try_element_at(F.col("pairs"), i + 1)["value"])), lambda v: v.isNotNull()), F.lit(1))
    units = after("$INSUNITS").try_cast("int")
    mm = F.create_map(*[F.lit(v) for k, x in UNITS.items() for v in (k, x)])
    return h.select("file", after("$ACADVER").alias("version"), units.alias("units")).withColumn("unit_mm", F.try_element_at(mm, "units"))


def entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, problems) of all drawings under ``path``.

    Entities are (file, place, kind, layer, points, bulges, radius, start, end, closed,
    ratio, degree, knots, weights, fit_points), placed in the drawing: ``place`` are the records of
    the inserts that lead to it and its own, so sorting by it gives the order of the
    drawing. Arcs run counterclockwise from ``start`` to ``end`` in radians; an
    ellipse's points are its centre and its major axis. Only what lies in the plane
    is read; problems count by (file, problem) what is left out. Of blocks of one name the last counts; an
    insert that is an array gives its first copy. A file without a section gives nothing.
    """
    r = _within(records(spark, path))
    drawn = r.where("section in ('ENTITIES', 'BLOCKS') and (section = 'ENTITIES' or block > 0) and type not in ('SECTION', 'ENDSEC', 'BLOCK', 'ENDBLK')").withColumn("block", F.when(F.col("section") == "ENTITIES", 0).otherwise(F.col("block")))
    blocks = r.where("section = 'BLOCKS' and type = 'BLOCK'").select("file", F.coalesce(_text(2), F.lit("")).alias("name"), "record", F.struct(_number(10).alias("x"), _number(20).alias("y")).alias("base"))
    blocks = blocks.groupBy("file", "name").agg(F.max("record").alias("target"), F.max_by("base", "record").alias("base"))
    nx, ny, nz = _number(210), _number(220), _number(230, 1)
    planar = (F.abs(nx) < 1e-9) & (F.abs(ny) < 1e-9) & (F.abs(F.abs(nz) - 1) < 1e-9)
    vertex = F.struct("record", F.struct(_number(10).alias("x"), _number(20).alias("y"), _number(42).alias("b")).alias("v"))
    strung = drawn.where("type = 'VERTEX'").where(~_flag(16)).groupBy("file", "owners").agg(F.transform(F.array_sort(F.collect_list(vertex)), lambda s: s["v"]).alias("vertices"))
    own = drawn.where("type not in ('VERTEX', 'SEQEND')").join(strung, ["file", "owners"], "left")
    own = own.withColumns({"planar": planar, "below": nz < 0, "layer": F.nullif(_text(8), F.lit("")), "ocs": F.when(nz < 0, _literal((-1, 0, 0, 0, 1, 0))).otherwise(_literal(_IDENTITY))}).transform(cut)
    found = own.where("type = 'INSERT'").withColumn("name", F.coalesce(_text(2), F.lit(""))).join(blocks, ["file", "name"], "left")
    inserts = found.where("target is not null").select("file", "block", "target", _composed(F.col("ocs"), _insert_matrix()).alias("m"), "record")
    instances, deep = _expanded(inserts)
    lost = found.where("target is null").select("file", "block", F.lit("INSERT (missing block)").alias("problem"))
    top = own.select("file").distinct().select("file", F.lit(0).cast("long").alias("block"), _literal(_IDENTITY).alias("m"), F.expr("cast(array() as array<bigint>)").alias("path"))
    instances = instances.select("file", F.col("block").cast("long").alias("block"), "m", "path").unionByName(top).transform(cut)

    point = lambda x, y: F.array(F.struct(_number(x).alias("x"), _number(y).alias("y")))
    plain = lambda c: F.transform(c, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    kind = {"LINE": "line", "CIRCLE": "circle", "ARC": "arc", "LWPOLYLINE": "polyline", "POLYLINE": "polyline", "SPLINE": "spline", "ELLIPSE": "ellipse", "POINT": "point"}
    is_ = lambda *types: F.col("type").isin(*types)
    strings = F.when(is_("POLYLINE"), F.coalesce("vertices", F.expr("cast(array() as array<struct<x:double,y:double,b:double>>)"))).otherwise(_listed(10, (20, 42)))
    heights = F.array_distinct(F.concat(_numbers(30), _numbers(31)))
    shapes = own.where(is_(*kind)).withColumns({"string": F.when(is_("LWPOLYLINE", "POLYLINE", "SPLINE"), strings)})
    shapes = shapes.withColumns({
        "kind": F.element_at(F.create_map(*[F.lit(v) for k in kind.items() for v in k]), F.col("type")),
        "local": F.when(is_("LINE"), F.concat(point(10, 20), point(11, 21))).when(is_("LWPOLYLINE", "POLYLINE", "SPLINE"), plain(F.col("string"))).otherwise(point(10, 20)),
        "fit": F.when(is_("SPLINE"), plain(_listed(11, (21,)))),
        "bends": F.when(is_("LWPOLYLINE", "POLYLINE"), F.transform("string", lambda v: v["b"])),
        "flat": F.when(is_("LINE"), F.col("planar") & (_number(30) == _number(31))).when(is_("SPLINE"), F.col("planar") & (F.size(heights) <= 1)).when(is_("POINT"), True).when(is_("POLYLINE"), F.col("planar") & ~_flag(8)).otherwise(F.col("planar")),
        "mesh": is_("POLYLINE") & (_flag(16) | _flag(64)),
    }).transform(cut)

    placed = shapes.join(instances, _KEY)
    turned = ~F.col("type").isin("LINE", "POINT", "ELLIPSE")
    placed = placed.withColumn("t", F.when(turned, _composed(F.col("m"), F.col("ocs"))).otherwise(F.col("m"))).withColumn("same", _similar("t"))
    s = F.col("same")
    bent = F.exists("bends", lambda b: b != 0)
    radius = _number(40) * s["scale"]
    plane = F.concat("type", F.lit(" (not in the XY plane)"))
    problem = (
        F.when(F.col("mesh"), "POLYLINE (polygon mesh / polyface)").when(~F.col("flat"), F.when(is_("POLYLINE"), "POLYLINE (3D)").otherwise(plane))
        .when(is_("CIRCLE", "ARC", "ELLIPSE") & s.isNull(), F.concat("type", F.lit(" (non-uniformly scaled block)")))
        .when(is_("CIRCLE", "ARC") & ~F.coalesce(radius > 0, F.lit(False)), F.col("type"))
        .when(is_("LWPOLYLINE") & s.isNull() & bent, "LWPOLYLINE (arc segments in a non-uniformly scaled block)")
    )
    placed = placed.withColumn("problem", problem).transform(cut)
    flip = F.when(s["mirrored"], -1.0).otherwise(1.0)
    a0, a1 = F.radians(_number(50)), F.radians(_number(51))
    back = s["mirrored"] != F.col("below")
    e0, e1 = _number(41, 0), _number(42, 2 * math.pi)
    m = F.col("m")
    major = F.array(F.struct((m[0] * _number(11) + m[1] * _number(21)).alias("x"), (m[3] * _number(11) + m[4] * _number(21)).alias("y")))
    weights = _numbers(41)
    uneven = (F.size(weights) == F.size("local")) & F.exists(weights, lambda w: F.abs(w - 1) > 1e-12)
    at = _moved(F.col("t"), F.col("local"))
    good = placed.where("problem is null").select(
        "file", F.concat("path", F.array("record")).alias("place"), "kind", "layer",
        F.when(is_("ELLIPSE"), F.concat(at, major)).otherwise(at).cast(_POINTS).alias("points"),
        F.transform("bends", lambda b: b * flip).alias("bulges"),
        F.when(is_("CIRCLE", "ARC"), radius).alias("radius"),
        F.when(is_("ARC"), F.when(s["mirrored"], s["rotation"] - a1).otherwise(s["rotation"] + a0)).when(is_("ELLIPSE"), F.when(back, -e1).otherwise(e0)).alias("start"),
        F.when(is_("ARC"), F.when(s["mirrored"], s["rotation"] - a0).otherwise(s["rotation"] + a1)).when(is_("ELLIPSE"), F.when(back, -e0).otherwise(e1)).alias("end"),
        F.when(is_("LWPOLYLINE", "POLYLINE"), _flag(1)).when(is_("SPLINE"), _flag(3)).alias("closed"),
        F.when(is_("ELLIPSE"), _number(40, 1)).alias("ratio"),
        F.when(is_("SPLINE"), _number(71, 3).cast("int")).alias("degree"), F.when(is_("SPLINE"), _numbers(40)).alias("knots"), F.when(is_("SPLINE") & uneven, weights).alias("weights"),
        F.when(is_("SPLINE"), _moved(F.col("t"), F.col("fit"))).cast(_POINTS).alias("fit_points"),
    )
    other = own.where(~is_(*kind, "INSERT")).select("file", "block", F.col("type").alias("problem"))
    per_instance = other.unionByName(lost).join(instances.select(*_KEY), _KEY).select("file", "problem")
    problems = placed.where("problem is not null").select("file", "problem").unionByName(per_instance).unionByName(deep.where("problem <> ''")).groupBy("file", "problem").agg(F.count("*").alias("n"))
    return good, problems
