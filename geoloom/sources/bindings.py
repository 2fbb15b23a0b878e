"""Domain inputs made from the given tables.

Coordinates are multiples of powers of two, so sums of them and of their
squares are exact and do not depend on the order of rows. Each relation has
its SQL form beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """select o_orderkey as id, o_custkey::double as x, floor(o_totalprice) / 64 as y, ((o_orderkey * 37) % 1000)::double / 8 as z,
  case o_orderstatus when 'F' then 2 when 'O' then 5 else 1 end as cls from orders"""
PAIRS_SQL = """select least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b, (l_linenumber % 4)::int as source, ((l_orderkey * 37) % 1001)::bigint as confidence
  from lineitem where l_suppkey <> l_partkey"""
CONTROL_SQL = """select s_suppkey as id, (s_suppkey % 6)::int as role, floor(s_acctbal) / 8 as east, floor(s_acctbal) / 16 as north, case when s_suppkey % 5 <> 0 then floor(s_acctbal) / 32 end as height from supplier"""
FEATURES_SQL = """select user_id as image, event_id as row_index, (event_id % 97)::double / 8 as px, (event_id % 89)::double / 8 as py, floor(value * 4) as score from events"""
TRIANGLES_SQL = """select p_partkey as id, (p_partkey % 50)::int as face, (p_partkey % 97)::bigint as a, ((p_partkey * 7 + 1) % 97)::bigint as b, ((p_partkey * 13 + 2) % 97)::bigint as c from part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, z, cls) from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("double").alias("x"),
        (F.floor("o_totalprice").cast("double") / 64).alias("y"),
        (F.pmod(F.col("o_orderkey") * 37, F.lit(1000)).cast("double") / 8).alias("z"),
        F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 5).otherwise(1).alias("cls"),
    )


def pair_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, source, confidence) from lineitem; a < b."""
    t = table(spark, sf_dir, "lineitem").where("l_suppkey <> l_partkey")
    return t.select(F.least("l_suppkey", "l_partkey").alias("a"), F.greatest("l_suppkey", "l_partkey").alias("b"), (F.col("l_linenumber") % 4).cast("int").alias("source"), (F.col("l_orderkey") * 37 % 1001).cast("long").alias("confidence"))


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, role, east, north, height) from supplier; some heights are unknown."""
    s, v = table(spark, sf_dir, "supplier"), F.floor("s_acctbal").cast("double")
    return s.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 6).cast("int").alias("role"), (v / 8).alias("east"), (v / 16).alias("north"), F.when(F.col("s_suppkey") % 5 != 0, v / 32).alias("height"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, row_index, px, py, score) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("image"), F.col("event_id").alias("row_index"), ((F.col("event_id") % 97).cast("double") / 8).alias("px"), ((F.col("event_id") % 89).cast("double") / 8).alias("py"), F.floor(F.col("value") * 4).cast("double").alias("score"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, face, a, b, c) from part: vertex numbers below 97."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (k % 50).cast("int").alias("face"), (k % 97).alias("a"), ((k * 7 + 1) % 97).alias("b"), ((k * 13 + 2) % 97).alias("c"))
