"""Scopes, fences and evidence filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import geometry as G

#: Least confidence (per mille) of each source of a pair hint
#: (satellite position, sequence, frustum, retrieval), and the expanded ones.
EVIDENCE = (300, 400, 250, 600)
EVIDENCE_EXPANDED = (150, 200, 100, 450)


def xyz() -> list[Column]:
    return [F.col("x"), F.col("y"), F.col("z")]


def scoped(points: DataFrame, classes: Sequence[int], box: dict | None = None, keep_inside: bool = True, placement: Sequence[float] | None = None) -> DataFrame:
    """Points of visible classes, inside (or outside) an oriented box.

    A missing class counts as 0; no visible class at all is an error.
    """
    if not classes:
        raise ValueError("a scope needs a visible class")
    df = points.where(F.coalesce("cls", F.lit(0)).isin(list(classes)))
    if placement is not None:
        df = df.withColumns(dict(zip("xyz", G.transform(placement, xyz()))))
    return df if box is None else df.where(G.in_box(xyz(), **box) == keep_inside)


def segmented(points: DataFrame, inside: Column, visible: Sequence[int], keep: bool = True, strict: bool = False) -> DataFrame:
    """Points a fence leaves. Rows of hidden classes always stay.

    With ``strict`` it is an error to remove nothing or all visible rows.
    """
    seen = F.coalesce("cls", F.lit(0)).isin(list(visible))
    stays = inside if keep else ~inside
    if strict:
        n = points.where(seen).agg(F.count("*").alias("n"), F.count_if(stays).alias("k")).first()
        if n["k"] in (0, n["n"]):
            raise ValueError("the fence removes nothing or everything")
    return points.where(~seen | stays)


def pruned_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (name, n) with points in them or below; an ancestor's name is a prefix."""
    used = nodes.where("n > 0").select(F.explode(F.expr("transform(sequence(1, length(name)), k -> left(name, k))")).alias("name")).distinct()
    return nodes.join(used, "name", "left_semi")


def pair_evidence(hints: DataFrame) -> DataFrame:
    """(a, b, gnss, seq, frustum, retrieval): the best confidence of each source."""
    best = hints.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return best.agg(*[F.max(F.when(F.col("source") == k, F.col("confidence"))).alias(n) for k, n in enumerate(("gnss", "seq", "frustum", "retrieval"))])


def evidence_passes(least: Sequence[int] = EVIDENCE) -> Column:
    out = F.lit(False)
    for n, v in zip(("gnss", "seq", "frustum", "retrieval"), least):
        out = out | F.coalesce(F.col(n) >= v, F.lit(False))
    return out


def priority() -> Column:
    z = lambda n: F.coalesce(n, F.lit(0))
    return 3 * z("gnss") + 2 * z("seq") + 4 * z("frustum") + 2 * z("retrieval")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
