"""Formulas of dimensions: numbers with units, names, + - * /, signs and parentheses.

A number may have a unit (lengths become millimetres, angles degrees) and a decimal
comma. One formula over many rows becomes a Column; formulas that are rows
themselves become steps in postfix order, which array functions evaluate, and
parameters that refer to each other are resolved in rounds of joins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import cut

#: What a unit is in millimetres or degrees.
UNITS = {"mm": 1, "cm": 10, "m": 1000, "in": 25.4, "inch": 25.4, '"': 25.4, "ft": 304.8, "'": 304.8, "um": 0.001, "deg": 1, "°": 1, "rad": 180 / math.pi}
_UNIT = "|".join(map(re.escape, sorted(UNITS, key=len, reverse=True)))
_TOKEN = re.compile(rf"[ \t]*(?:(?P<number>[0-9]+\.?[0-9]*|\.[0-9]+)(?:\s*(?P<unit>{_UNIT})(?![A-Za-z0-9_]))?|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<mark>[-+*/()]))[ \t]*", re.I)
_LAST_UNIT, _COMMA = re.compile(r"\s*(mm|°|deg)\s*$", re.I), re.compile(r"([0-9]),([0-9])")
_PLAIN = re.compile(r"\s*[0-9]+([.,][0-9]*)?\s*(mm|°|deg)?\s*|\s*[.,][0-9]+\s*", re.I)
_STRENGTH = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "pos": 3}

#: A step pushes a number or a name's value, or applies an operation to what was pushed last.
Step = tuple[str, float | str | None]


@dataclass(frozen=True)
class Formula:
    steps: tuple[Step, ...]

    @property
    def names(self) -> list[str]:
        return sorted({v for kind, v in self.steps if kind == "name"})


def _tokens(text: str) -> Iterator[tuple[str, float | str]] | None:
    source = _COMMA.sub(r"\1.\2", _LAST_UNIT.sub("", text.strip()))
    at, out = 0, []
    while at < len(source):
        found = _TOKEN.match(source, at)
        if not found:
            return None
        at = found.end()
        if found["number"]:
            unit = UNITS[found["unit"].lower()] if found["unit"] else 1
            out.append(("number", float(found["number"]) * unit))
        else:
            out.append(("name", found["name"]) if found["name"] else ("mark", found["mark"]))
    return out


def parse(text: str) -> Formula | None:
    """The formula, or nothing where it is not one.

    Operators wait on a stack until a weaker one or a closing parenthesis comes;
    ``wanted`` tells whether an operand must be next.
    """
    steps: list[Step] = []
    waiting: list[str] = []
    wanted = True
    tokens = _tokens(text)
    for kind, value in tokens or ():
        if kind != "mark":
            if not wanted:
                return None
            steps.append((kind, value))
            wanted = False
        elif wanted:
            if value not in ("-", "+", "("):
                return None
            waiting.append({"-": "neg", "+": "pos"}.get(value, value))
        elif value == "(":
            return None
        elif value == ")":
            while waiting and waiting[-1] != "(":
                steps.append((waiting.pop(), None))
            if not waiting:
                return None
            waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and _STRENGTH[waiting[-1]] >= _STRENGTH[value]:
                steps.append((waiting.pop(), None))
            waiting.append(value)
            wanted = True
    if wanted or "(" in waiting:
        return None
    steps.extend((kind, None) for kind in reversed(waiting))
    return Formula(tuple(s for s in steps if s[0] != "pos"))


def is_plain_number(text: str) -> bool:
    return bool(_PLAIN.fullmatch(text))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def column(text: str, columns: Mapping[str, Column]) -> Column:
    """The formula over columns of a table; a division by zero and a result that is no finite number are null.

    An unknown name and a text that is no formula are errors.
    """
    formula = parse(text)
    if formula is None:
        raise ValueError(f"not a formula: {text!r}")
    lost = [n for n in formula.names if n not in columns]
    if lost:
        raise ValueError(f"unknown name {lost[0]!r} in {text!r}")
    stack: list[Column] = []
    for kind, value in formula.steps:
        if kind == "number":
            stack.append(F.lit(float(value)))
        elif kind == "name":
            stack.append(columns[value].cast("double"))
        elif kind == "neg":
            stack.append(-stack.pop())
        else:
            right, left = stack.pop(), stack.pop()
            stack.append({"+": left + right, "-": left - right, "*": left * right}[kind] if kind != "/" else F.try_divide(left, right))
    return _finite(stack.pop())


_STEPS = "array<struct<kind:string,value:double,name:string>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.float64()), ("name", pa.string())]))
    for batch in batches:
        rows = []
        for text in batch.column(0).to_pylist():
            formula = parse(text)
            rows.append(formula and [{"kind": k, "value": v if k == "number" else None, "name": v if k == "name" else None} for k, v in formula.steps])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["expression", "steps"])


def parsed(texts: DataFrame) -> DataFrame:
    """(expression, steps) of the distinct texts of ``expression``; steps are null where there is no formula."""
    return texts.where("expression is not null").select("expression").distinct().mapInArrow(_parsed, f"expression string, steps {_STEPS}")


def value(steps: Column, values: Column) -> Column:
    """What steps give with a map of names to values: a finite number or null."""

    def apply(stack: Column, step: Column) -> Column:
        top, below = F.try_element_at(stack, F.lit(-1)), F.try_element_at(stack, F.lit(-2))
        two = F.when(step["kind"] == "+", below + top).when(step["kind"] == "-", below - top).when(step["kind"] == "*", below * top).otherwise(F.try_divide(below, top))
        pushed = F.when(step["kind"] == "number", step["value"]).when(step["kind"] == "name", F.try_element_at(values, step["name"])).when(step["kind"] == "neg", -top).otherwise(two)
        taken = F.when(step["kind"].isin("number", "name"), 0).when(step["kind"] == "neg", 1).otherwise(2)
        return F.concat(F.slice(stack, F.lit(1), F.size(stack) - taken), F.array(pushed))

    return _finite(F.try_element_at(F.aggregate(steps, F.expr("cast(array() as array<double>)"), apply), F.lit(1)))


def resolved(parameters: DataFrame) -> DataFrame:
    """(id, name, value, problem) of parameters (id, name, value, expression).

    A parameter without an expression, or with a plain number, keeps its value. Of
    parameters of one name the others read that with the greatest id. Problems are
    ``syntax``, ``unknown`` (name), ``value`` (none, or not a finite number),
    ``reference`` (to a parameter with a problem) and ``circle`` (on one or
    behind one); a parameter with a problem has no value. Each round resolves what
    refers to resolved ones only, so the rounds are as many as the longest chain.
    """
    p = parameters.select("id", "name", F.col("value").cast("double").alias("stored"), "expression")
    keeps = F.col("expression").isNull() | F.col("expression").rlike(rf"(?i)^(?:{_PLAIN.pattern})$")
    p = p.withColumn("keeps", keeps)
    p = p.join(parsed(p.where("not keeps")), "expression", "left")
    p = p.withColumn("refs", F.when(F.col("keeps") | F.col("steps").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.filter(F.transform("steps", lambda s: s["name"]), lambda n: n.isNotNull()))))
    p = p.transform(cut)
    heads = p.where("name is not null").groupBy(F.col("name").alias("ref")).agg(F.max("id").alias("ref_id"))
    edges = p.select("id", F.explode("refs").alias("ref")).join(heads, "ref", "left").transform(cut)
    lost = edges.where("ref_id is null").select("id").distinct().withColumn("lost", F.lit(True))
    first = p.join(lost, "id", "left")
    kept = _finite(F.col("stored"))
    problem = F.when(F.col("keeps"), F.when(kept.isNull(), F.lit("value"))).when(F.col("steps").isNull(), F.lit("syntax")).when(F.col("lost"), F.lit("unknown"))
    first = first.withColumn("problem", problem)
    done = first.where("keeps or problem is not null").select("id", F.when(F.col("keeps"), kept).alias("v"), "problem").transform(cut)
    left = first.where("not keeps and problem is null").select("id", "steps").transform(cut)
    while not left.isEmpty():
        told = edges.join(left.select("id"), "id", "left_semi").join(done.select(F.col("id").alias("ref_id"), "v", F.col("problem").alias("bad"), F.lit(True).alias("there")), "ref_id", "left")
        seen = told.groupBy("id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("ready"), F.bool_or(F.col("bad").isNotNull()).alias("spoilt"), F.map_from_entries(F.collect_list(F.struct("ref", "v"))).alias("values"))
        nothing = F.expr("cast(map() as map<string, double>)")
        ready = left.join(seen, "id", "left").where(F.coalesce("ready", F.lit(True)))
        fresh = ready.select("id", F.when(~F.coalesce("spoilt", F.lit(False)), value(F.col("steps"), F.coalesce("values", nothing))).alias("v"), F.when(F.col("spoilt"), F.lit("reference")).alias("problem"))
        fresh = fresh.withColumn("problem", F.coalesce("problem", F.when(F.col("v").isNull(), F.lit("value")))).transform(cut)
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh).transform(cut)
        left = left.join(fresh.select("id"), "id", "left_anti").transform(cut)
    circles = left.select("id", F.lit(None).cast("double").alias("v"), F.lit("circle").alias("problem"))
    return p.select("id", "name").join(done.unionByName(circles), "id").select("id", "name", F.col("v").alias("value"), "problem")
