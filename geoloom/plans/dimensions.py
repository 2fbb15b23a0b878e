"""Queries over formulas made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions import formulas
from geoloom.registry import query
from geoloom.sources.bindings import table

#: The formulas of ``parameters_of``, by key modulo six; v is the value of the parameter referred to.
_FORMULAS = [None, "p{ref} * 2 - 1 cm", "-(p{ref} + {size}) / 4", "p{ref} + 1 in", "p{ref} / (p{ref} - p{ref})", "1,5*p{ref} - +2"]


def parameters_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, value, expression): parts whose sizes refer to those of a quarter of their key."""
    k = F.col("p_partkey")
    fill = lambda text: F.concat(*[F.expr("string(p_partkey div 4)") if x == "{ref}" else F.expr("string(p_size)") if x == "{size}" else F.lit(x) for x in _pieces(text)])
    made = F.when(k % 97 == 0, F.concat(F.lit("p"), F.expr("string(p_partkey div 4)"), F.lit(" +"))).when(k % 101 == 0, F.concat(F.lit("q"), k.cast("string"), F.lit(" + 1"))).when(k % 103 == 0, F.concat(F.lit("p"), k.cast("string"), F.lit(" + 1")))
    for rest, text in enumerate(_FORMULAS):
        if text:
            made = made.when((k % 6 == rest) & (k > 3), fill(text))
    made = made.otherwise(F.when(k % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" mm"))))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("p"), k.cast("string")).alias("name"), F.col("p_size").cast("double").alias("value"), made.alias("expression"))


def _pieces(text: str) -> list[str]:
    out = [text]
    for mark in ("{ref}", "{size}"):
        out = [y for x in out for y in ([x] if x in ("{ref}", "{size}") else [z for k, w in enumerate(x.split(mark)) for z in ([mark] if k else []) + [w]])]
    return [x for x in out if x]


@query(
    "parameter_formulas",
    """with recursive f as (select p_partkey as k, p_partkey // 4 as ref, p_size::double as size, case when p_partkey % 97 = 0 then 'syntax' when p_partkey % 101 = 0 then 'unknown' when p_partkey % 103 = 0 then 'self' when p_partkey > 3 and p_partkey % 6 > 0 then 'ref' else 'keep' end as kind from part),
r(k, v, problem) as (select k, case kind when 'keep' then size end, case when kind <> 'keep' then kind end from f where kind in ('keep', 'syntax', 'unknown')
union all select f.k, case when r.problem is null then case f.k % 6 when 1 then r.v * 2 - 10 when 2 then -(r.v + f.size) / 4 when 3 then r.v + 25.4::double when 5 then 1.5::double * r.v - 2 end end,
case when r.problem is not null then 'reference' when f.k % 6 = 4 then 'value' end from f join r on f.ref = r.k where f.kind = 'ref')
select f.k as id, 'p' || f.k as name, r.v as value, case when r.k is null then 'circle' else r.problem end as problem from f left join r on f.k = r.k""",
)
def parameter_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formulas.resolved(parameters_of(spark, sf_dir))


@query("formula_columns", "select p_partkey as id, p_size * 25.4::double + 5 as bore, -(p_size - 2.5::double) / 2 * 3 as offset_mm, case when p_size <> 25 then p_retailprice / (p_size - 25) end as ratio from part")
def formula_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"size": F.col("p_size"), "price": F.col("p_retailprice")}
    told = {"bore": "size * 1 in + 0.5 cm", "offset_mm": "-(size - 2,5) / 2 * 3", "ratio": "price / (size - 25)"}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[formulas.column(text, names).alias(name) for name, text in told.items()])
