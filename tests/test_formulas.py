"""Formulas: values, what is none, and parameters that refer to each other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import formulas

GOOD = {
    "12 + 3.5": 15.5, "10 mm + 1 in": 35.4, "1,5*2": 3.0, "-(2 + 3) * 4": -20.0, "2 - 3 - 4": -5.0, "24 / 4 / 2": 3.0, "--2": 2.0, "+-+3": -3.0, "2 * -3": -6.0, "90°": 90.0, "2 ft": 609.6, "1' + 2\"": 355.6,
    "3.": 3.0, ".5": 0.5, "2.5CM": 25.0, "1 rad": 180 / math.pi, "1 / 0": None, "0 / 0": None, "1000 um": 1.0, " ( ( 7 ) ) ": 7.0, "1 m - 1 mm": 999.0, "5 deg": 5.0, "9" * 400: None, "1 / 3 * 3": 1.0, "2 inch": 50.8,
}
BAD = ["", "  ", "1 +", "* 2", "(1", "1)", "1 2", "a b", "2 mmx", "1..2", "a.b", "2^3", "()", "3 (4)", "1 mm mm 2", "é", "1,"]


def test_values_of_formulas(spark):
    frame = spark.createDataFrame([(t, 1) for t in [*GOOD, *BAD]], "expression string, n int")
    got = {r.expression: r.v for r in formulas.parsed(frame).select("expression", formulas.value(F.col("steps"), F.expr("map('a', 1d)")).alias("v"), "steps").collect()}
    for text, want in GOOD.items():
        assert got[text] == (want if want is None else pytest.approx(want)), text
        assert spark.range(1).select(formulas.column(text, {})).first()[0] == got[text]
    for text in BAD:
        assert formulas.parse(text) is None and got[text] is None, text
        with pytest.raises(ValueError, match="not a formula"):
            formulas.column(text, {"a": F.lit(1), "b": F.lit(1), "x": F.lit(1)})
    with pytest.raises(ValueError, match="unknown name 'b'"):
        formulas.column("a + b", {"a": F.lit(1)})
    assert [formulas.is_plain_number(t) for t in ("12", " 3,5 mm", ".5", "4.", "7°", "1 in", "-3", "a", "")] == [True] * 5 + [False] * 4


def made(rnd, depth):
    """(text, value) of a random formula; a division by zero gives nothing."""
    if depth == 0 or rnd.random() < 0.2:
        n = rnd.choice([0, 1, 2, 2.5, 7, 0.25])
        return rnd.choice([(str(n), n), (str(n).replace(".", ","), n), (f"{n} cm", n * 10), ("a", 3.0), ("b", -0.5)])
    kind = rnd.choice("+-*/~(")
    text, v = made(rnd, depth - 1)
    if kind in "~(":
        return (f"-({text})", v if v is None else -v) if kind == "~" else (f" ({text} )", v)
    other, w = made(rnd, depth - 1)
    if v is None or w is None or (kind == "/" and w == 0):
        return f"({text}){kind}({other})", None
    return f"({text}){kind} ({other})", {"+": v + w, "-": v - w, "*": v * w, "/": v / w if w else 0}[kind]


def test_random_formulas(spark):
    rnd = random.Random(4)
    every = dict(made(rnd, 4) for _ in range(300))
    frame = spark.createDataFrame([(t,) for t in every], "expression string")
    got = {r.expression: r.v for r in formulas.parsed(frame).select("expression", formulas.value(F.col("steps"), F.expr("map('a', 3d, 'b', -0.5d)")).alias("v")).collect()}
    for text, want in every.items():
        assert got[text] == (want if want is None else pytest.approx(want)), text


def test_parameters(spark):
    rows = [
        (1, "wall", 2.0, None), (2, "d1", 9.0, "wall * 2"), (3, "d2", 9.0, "d1 + wall - 1 mm"), (4, "plain", 7.5, "8 mm"), (5, "a", 1.0, "b + 1"), (6, "b", 1.0, "a"), (7, "behind", 1.0, "a + wall"), (8, "self", 1.0, "self"),
        (9, "lost", 1.0, "nobody + wall"), (10, "bad", 1.0, "wall +"), (11, "zero", 1.0, "wall / (d1 - 2 * wall)"), (12, "of_bad", 1.0, "bad * 2"), (13, "of_of_bad", 1.0, "of_bad"), (14, "empty", None, None), (15, "inf", float("inf"), None),
        (16, "twice", 1.0, None), (17, "twice", 5.0, None), (18, "reads", 0.0, "twice + twice"), (19, "constant", 0.0, "1 in + 2 mm"), (20, None, 3.0, "wall"), (21, "blank", 3.0, ""), (22, "inch", 3.0, "12"),
    ]
    got = {r.id: (r.name, r.value, r.problem) for r in formulas.resolved(spark.createDataFrame(rows, "id long, name string, value double, expression string").repartition(3)).collect()}
    value = {1: 2.0, 2: 4.0, 3: 5.0, 4: 7.5, 16: 1.0, 17: 5.0, 18: 10.0, 19: 27.4, 20: 2.0, 22: 3.0}
    problem = {5: "circle", 6: "circle", 7: "circle", 8: "circle", 9: "unknown", 10: "syntax", 11: "value", 12: "reference", 13: "reference", 14: "value", 15: "value", 21: "syntax"}
    assert got == {k: (n, value.get(k), problem.get(k)) for k, n, _, _ in rows}
    assert formulas.resolved(spark.createDataFrame([], "id long, name string, value double, expression string")).collect() == []
