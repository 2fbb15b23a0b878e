"""Tracks of observations: merges in order of confidence that keep the labels of a set apart.

The sequential rule is: the best edge first, two sets are merged unless they share a label.
An edge that is the best of both its sets is decided by the same sets in the
sequence, so all such edges are decided at once, in rounds; and as sets only grow,
two sets that share a label are never merged, so edges between them go at any time.
Components of at most ``FOLD_EDGES`` edges are folded in tasks instead, which gives
the same sets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.graphs import components
from geoloom.session import cut, stored

#: Edges of a component that one task folds at most, and of the small components that a task folds together, about.
FOLD_EDGES, SHARE_EDGES = 500_000, 20_000
MAX_ROUNDS = 10_000


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of the edges of whole components, in order."""
    up: dict[int, int] = {}
    labels: dict[int, set] = {}
    for r in rows.itertuples(index=False):
        for node, label in ((r.a, r.label_a), (r.b, r.label_b)):
            up.setdefault(node, node)
            labels.setdefault(node, {label})

    def root(n: int) -> int:
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for r in rows.sort_values(["confidence", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
        x, y = sorted((root(r.a), root(r.b)))
        if x != y and not labels[x] & labels[y]:
            up[y] = x
            labels[x] |= labels.pop(y)
    return pd.DataFrame({"node": list(up), "root": [root(n) for n in up]}, dtype="int64")


def _kept(df: DataFrame) -> DataFrame:
    return stored(df, "tracks")


def _rounds(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b, label_a, label_b, confidence) of any number."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("label_a").alias("label")), F.struct(F.col("b").alias("node"), F.col("label_b").alias("label"))))
    labels = edges.select(ends.alias("e")).select("e.*").distinct().withColumnRenamed("node", "root").transform(_kept)
    roots = labels.select(F.col("root").alias("node"), "root").distinct().transform(_kept)
    key = F.struct((-F.col("confidence")).alias("worse"), F.col("a").alias("first"), F.col("b").alias("second"))
    left = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), key.alias("key")).transform(_kept)
    for _ in range(MAX_ROUNDS):
        # of edges between two sets the best decides for all; sets with a common label stay apart
        left = left.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("key").alias("key"))
        mine, theirs = labels.select(F.col("root").alias("x"), "label"), labels.select(F.col("root").alias("y"), "label")
        apart = left.select("x", "y").join(mine, "x").join(theirs, ["y", "label"]).select("x", "y").distinct()
        left = left.join(apart, ["x", "y"], "left_anti").transform(_kept)
        if left.isEmpty():
            return roots
        best = left.select(F.explode(F.array("x", "y")).alias("root"), "key").groupBy("root").agg(F.min("key").alias("best"))
        of = lambda end: best.select(F.col("root").alias(end), F.col("best").alias(f"best_{end}"))
        joins = left.join(of("x"), "x").join(of("y"), "y").where((F.col("key") == F.col("best_x")) & (F.col("key") == F.col("best_y")))
        moves = joins.select(F.col("y").alias("was"), F.col("x").alias("now")).transform(_kept)
        moved = lambda df, column: df.join(moves, F.col(column) == F.col("was"), "left").withColumn(column, F.coalesce("now", column)).drop("was", "now")
        labels, roots = moved(labels, "root").transform(_kept), moved(roots, "root").transform(_kept)
        left = moved(moved(left, "x"), "y").transform(_kept)
    raise RuntimeError(f"merges did not settle in {MAX_ROUNDS} rounds")


def constrained_sets(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b, label_a, label_b, confidence) between nodes (longs) of one label each.

    Edges are taken by falling confidence, then by their ends. The root is the least node of a set.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("label_a")).otherwise(F.col("label_b")).alias("label_a"), F.when(F.col("a") < F.col("b"), F.col("label_b")).otherwise(F.col("label_a")).alias("label_b"), F.col("confidence").cast("double").alias("confidence"))
    e = e.groupBy("a", "b", "label_a", "label_b").agg(F.max("confidence").alias("confidence")).transform(cut)
    c = components(e.select("a", "b"))
    e = e.join(c, F.col("a") == F.col("node")).drop("node").transform(cut)
    sizes = e.groupBy("component").agg(F.count("*").alias("n")).transform(cut)
    small = sizes.where(F.col("n") <= FOLD_EDGES)
    shares = -(-(small.agg(F.sum("n")).first()[0] or 0) // SHARE_EDGES) or 1
    share = F.pmod(F.xxhash64("component"), F.lit(shares)).alias("share")
    folded = e.join(small.select("component"), "component", "left_semi").select("*", share)
    done = folded.groupBy("share").applyInPandas(lambda rows: _fold(rows), "node long, root long")
    large = sizes.where(F.col("n") > FOLD_EDGES).select("component")
    if large.isEmpty():
        return done
    return done.unionByName(_rounds(e.join(large, "component", "left_semi").drop("component")))


_SIDES = ("first", "second")


def _observations(*edges: DataFrame) -> DataFrame:
    """(id, o) of all observations (image, family, feature): ids follow their order."""
    every = None
    for e in edges:
        for side in _SIDES:
            own = e.select(F.col(side).alias("o"))
            every = own if every is None else every.unionByName(own)
    placed = every.distinct().orderBy("o").transform(cut)  # partitions are ranges in order
    return placed.select(F.monotonically_increasing_id().alias("id"), "o").transform(cut)


def _numbered(edges: DataFrame, observations: DataFrame) -> DataFrame:
    for side in _SIDES:
        edges = edges.join(observations.select(F.col("id").alias(f"{side}_id"), F.col("o").alias(side)), side)
    return edges


def feature_tracks(correspondences: DataFrame, aliases: DataFrame | None = None, least: float = 0, least_alias: float = 0) -> tuple[DataFrame, DataFrame]:
    """(members, rejected) of edges (first, second, confidence) between observations, structs of image, family and feature.

    Aliases join observations of one image by different families to one; then
    correspondences join those of different images to tracks with one
    observation an image at most. Members are (track, image, primary, observation): the track
    and the primary are named by their least observation, and tracks have two images or more.
    Rejected are (kind, first, second, confidence, reason).
    """
    if aliases is None:
        aliases = correspondences.limit(0)
    c, a = (df.select("first", "second", "confidence") for df in (correspondences, aliases))
    observations = _observations(c, a)
    reason = F.when(F.col("confidence") < least_alias, "below confidence").when(F.col("first.image") != F.col("second.image"), "alias across images").when(F.col("first.family") == F.col("second.family"), "alias within a family")
    a = _numbered(a, observations).withColumn("reason", reason).transform(cut)
    edge = lambda df, label, x, y: df.where("reason is null").select(F.col(x).alias("a"), F.col(y).alias("b"), F.col(f"first.{label}").alias("label_a"), F.col(f"second.{label}").alias("label_b"), "confidence")
    groups = constrained_sets(edge(a, "family", "first_id", "second_id")).transform(cut)
    group = observations.join(groups, F.col("id") == F.col("node"), "left").select("id", "o", F.coalesce("root", "id").alias("group")).transform(cut)

    def in_groups(df: DataFrame) -> DataFrame:
        for side in _SIDES:
            df = df.join(group.select(F.col("id").alias(f"{side}_id"), F.col("group").alias(f"{side}_group")), f"{side}_id")
        return df

    reason = F.when(F.col("confidence") < least, "below confidence").when(F.col("first.image") == F.col("second.image"), "correspondence within an image")
    c = in_groups(_numbered(c, observations)).withColumn("reason", reason).transform(cut)
    sets = constrained_sets(edge(c, "image", "first_group", "second_group")).transform(cut)
    several = sets.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    named = observations.select(F.col("id").alias("of"), F.col("o").alias("name"))
    members = group.join(sets.join(several, "root").select(F.col("node").alias("group"), "root"), "group")
    members = members.join(named, F.col("root") == F.col("of")).withColumnRenamed("name", "track").drop("of").join(named, F.col("group") == F.col("of")).withColumnRenamed("name", "primary")
    members = members.select("track", F.col("o.image").alias("image"), "primary", F.col("o").alias("observation"))

    def rejected(df: DataFrame, kind: str, ends: tuple[str, str], found: DataFrame, conflict: str) -> DataFrame:
        for side, end in zip(_SIDES, ends):
            df = df.join(found.select(F.col("node").alias(end), F.col("root").alias(f"{side}_root")), end, "left")
        why = F.coalesce("reason", F.when(F.coalesce("first_root", ends[0]) != F.coalesce("second_root", ends[1]), F.lit(conflict)))
        return df.select(F.lit(kind).alias("kind"), "first", "second", "confidence", why.alias("reason")).where("reason is not null")

    lost = rejected(a, "alias", ("first_id", "second_id"), groups, "families of the aliases meet")
    return members, lost.unionByName(rejected(c, "correspondence", ("first_group", "second_group"), sets, "another observation of the image"))
