"""Queries over drawings made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import curves
from geoloom.registry import query
from geoloom.session import shared_dir
from geoloom.sources import dxf
from geoloom.sources.bindings import table

#: Before and after the entities of each drawing: a bar, and a frame of two bars.
_HEAD = "0 SECTION 2 HEADER 9 $INSUNITS 70 6 0 ENDSEC 0 SECTION 2 BLOCKS 0 BLOCK 2 bar 10 1 20 1 0 LINE 8 0 10 1 20 1 11 3 21 1 0 ENDBLK 0 BLOCK 2 frame 10 0 20 0 0 INSERT 2 bar 10 0 20 0 0 INSERT 2 bar 10 10 20 4 41 2 42 2 50 90 0 ENDBLK 0 ENDSEC 0 SECTION 2 ENTITIES"
_TAIL = "0 ENDSEC 0 EOF"


def drawn(spark: SparkSession, sf_dir: str) -> str:
    """A folder of drawings, one for each nation: each customer is an insert of the frame."""
    folder = f"{shared_dir(spark)}/drawings-{uuid.uuid4().hex}"
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("turn"), (F.col("c_custkey") % 100).alias("x"), (F.floor("c_acctbal").cast("double") / 16).alias("y"), (1 + F.col("c_custkey") % 2).alias("s"))
    pairs = [("0", "INSERT"), ("8", "0"), ("2", "frame"), ("10", F.col("x")), ("20", F.col("y")), ("41", F.col("s")), ("42", F.col("s"))]
    body = c.select("c_nationkey", "turn", F.posexplode(F.array(*[v.cast("string") if hasattr(v, "cast") else F.lit(v) for p in pairs for v in p])).alias("at", "value"))
    nations = c.select("c_nationkey").distinct()
    ends = [nations.select("c_nationkey", F.lit(turn).cast("long").alias("turn"), F.posexplode(F.array(*[F.lit(w) for w in words.split()])).alias("at", "value")) for turn, words in ((-1, _HEAD), (1 << 60, _TAIL))]
    every = body.unionByName(ends[0]).unionByName(ends[1]).withColumnRenamed("c_nationkey", "nation")
    every.repartition("nation").sortWithinPartitions("nation", "turn", "at").select("nation", "value").write.partitionBy("nation").text(folder)
    return folder


@query(
    "drawing_lines",
    "with c as (select c_nationkey as nation, (c_custkey % 100)::double as x, floor(c_acctbal) / 16 as y, (1 + c_custkey % 2)::double as s from customer) "
    "select nation, x as x0, y as y0, x + 2 * s as x1, y as y1 from c union all select nation, x + 10 * s, y + 4 * s, x + 10 * s, y + 8 * s from c",
)
def drawing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of blocks in blocks, placed; written as drawings and read back."""
    good, _ = dxf.entities(spark, drawn(spark, sf_dir))
    at = {f"{k}{i}": F.round(F.col("points")[i][k], 6) + F.lit(0.0) for i in (0, 1) for k in "xy"}
    nation = F.regexp_extract("file", r"nation=(\d+)", 1).cast("int")
    return good.select(nation.alias("nation"), *[c.alias(n) for n, c in at.items()])


def order_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cubic spline for each customer with four orders or more: their days and prices in order of time."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey", (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).alias("x"), (F.col("o_totalprice") / 100).alias("y")).alias("o"))
    c = o.groupBy("id").agg(F.array_sort(F.collect_list("o")).alias("all")).where("size(all) >= 4")
    points = F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    n = F.size("all")
    knots = F.concat(F.array_repeat(F.lit(0.0), 3), F.transform(F.sequence(F.lit(0), n - 3), lambda k: k.cast("double")), F.array_repeat((n - 3).cast("double"), 3))
    return c.select("id", F.lit(3).alias("degree"), knots.alias("knots"), points.alias("points"), F.expr("cast(null as array<double>)").alias("weights"))


#: Adaptive pieces are no SQL; tested against dense evaluations.
@query("curve_chords")
def curve_chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.lengths(curves.chords(order_curves(spark, sf_dir), 1.0)).select("id", "n", F.round("length", 6).alias("length"))
