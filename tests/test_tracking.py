"""Merges in order of confidence against the ordered loop."""

import random

import pytest

from geoloom.operators import tracking

EDGES = "first struct<image:long,family:string,feature:long>, second struct<image:long,family:string,feature:long>, confidence double"


def merged(nodes, edges, label):
    """Sets by the sequential rule; edges (a, b, confidence)."""
    sets = {n: {n} for n in nodes}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], *sorted(e[:2]))):
        x, y = sets[a], sets[b]
        if x is not y and not {label(n) for n in x} & {label(n) for n in y}:
            x |= y
            for n in y:
                sets[n] = x
    return sets


def by_hand(corr, alias, least, least_alias):
    nodes = {n for e in corr + alias for n in e[:2]}
    good = [e for e in alias if e[2] >= least_alias and e[0][0] == e[1][0] and e[0][1] != e[1][1]]
    groups = merged(nodes, good, lambda n: n[1])
    head = {n: min(groups[n]) for n in nodes}
    fine = [(head[a], head[b], c) for a, b, c in corr if c >= least and a[0] != b[0]]
    tracks = merged(set(head.values()), fine, lambda n: n[0])
    members = {(min(tracks[head[n]]), n[0], head[n], n) for n in nodes if len(tracks[head[n]]) > 1}
    lost = sorted(("alias", *e) for e in alias if e not in good or head[e[0]] != head[e[1]])
    lost += sorted(("correspondence", *e) for e in corr if e[2] < least or e[0][0] == e[1][0] or tracks[head[e[0]]] is not tracks[head[e[1]]])
    return members, sorted(lost)


def rows(df):
    return {(tuple(r.track), r.image, tuple(r.primary), tuple(r.observation)) for r in df.collect()}


@pytest.mark.parametrize("fold, seed", [(100_000, 1), (0, 2)])
def test_tracks_equal_the_ordered_loop(spark, monkeypatch, fold, seed):
    monkeypatch.setattr(tracking, "FOLD_EDGES", fold)
    rnd = random.Random(seed)
    node = lambda: (rnd.randrange(7), rnd.choice("ab"), rnd.randrange(12))
    corr = [(node(), node(), float(rnd.randrange(5, 12))) for _ in range(140 if fold else 50)]
    alias = [((i := rnd.randrange(7), "a", rnd.randrange(12)), (i if rnd.random() < 0.9 else (i + 1) % 7, rnd.choice("abb"), rnd.randrange(12)), float(rnd.randrange(5, 12))) for _ in range(40 if fold else 16)]
    members, rejected = tracking.feature_tracks(spark.createDataFrame(corr, EDGES).repartition(3), spark.createDataFrame(alias, EDGES), 6, 7)
    want, lost = by_hand(corr, alias, 6, 7)
    assert rows(members) == want and len(want) > 9
    assert sorted((r.kind, tuple(r["first"]), tuple(r["second"]), r.confidence) for r in rejected.collect()) == lost
    assert rejected.where("reason is null").count() == 0 and rejected.select("reason").distinct().count() >= 4


def test_aliases_form_one_observation(spark):
    corr = [((1, "a", 1), (2, "a", 5), 900.0), ((1, "b", 7), (3, "a", 2), 800.0), ((3, "a", 2), (2, "b", 9), 700.0)]
    alias = [((1, "a", 1), (1, "b", 7), 950.0), ((1, "b", 7), (1, "a", 4), 900.0)]
    members, rejected = tracking.feature_tracks(spark.createDataFrame(corr, EDGES), spark.createDataFrame(alias, EDGES))
    assert rows(members) == {((1, "a", 1), i, p, o) for i, p, o in [(1, (1, "a", 1), (1, "a", 1)), (1, (1, "a", 1), (1, "b", 7)), (2, (2, "a", 5), (2, "a", 5)), (3, (3, "a", 2), (3, "a", 2))]}
    assert {(r.kind, r.reason) for r in rejected.collect()} == {("alias", "families of the aliases meet"), ("correspondence", "another observation of the image")}


def test_nothing(spark):
    none = spark.createDataFrame([], EDGES)
    members, rejected = tracking.feature_tracks(none, none)
    assert members.count() == rejected.count() == 0


def test_one_large_component_is_no_group(spark, monkeypatch):
    monkeypatch.setattr(tracking, "FOLD_EDGES", 5)
    monkeypatch.setattr(tracking, "_fold", lambda rows: (_ for _ in ()).throw(AssertionError("folded")))
    corr = [((k, "a", 0), (k + 1, "a", 0), float(k * 7919 % 1000)) for k in range(14)] + [((k, "a", 0), (k + 9, "a", 1), float(k * 104729 % 1000)) for k in range(4)]
    members, _ = tracking.feature_tracks(spark.createDataFrame(corr, EDGES))
    assert rows(members) == by_hand(corr, [], 0, 0)[0]
