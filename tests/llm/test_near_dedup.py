"""Near-duplicate groups: links of single rows, families of several blocks, hot groups."""

import random

import pytest

from geoloom.llm import minhash


def by_row(rows, size=4, threshold=80):
    """(id, component) of every row, rows being the nodes, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), None if d is None else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def compare(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, hash string")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, **options).collect()]
    want = [(d, n, c, d is None or d == c) for d, n, c in by_row(rows, **options)]
    assert sorted(got, key=str) == sorted(want, key=str)


def varied(rnd, words, changes, pool=10**6):
    w = list(words)
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"v{rnd.randrange(pool)}"
    return " ".join(w)


def test_repeated_ids_with_other_texts(spark):
    a = " ".join(f"a{k}" for k in range(40))
    b = " ".join(f"b{k}" for k in range(40))
    compare(spark, [(1, a), (7, a), (7, b), (2, b + " more"), (7, "b c"), (7, None), (7, a), (None, a), (None, None), (9, b), (3, ""), (3, "b  C")])


@pytest.mark.parametrize("size", [4, 5])
def test_boilerplate_joins_no_texts(spark, size):
    # much common text: all are candidates of each other, few are linked
    rnd = random.Random(size)
    common = [f"c{k}" for k in range(70)]
    rows = [(k, " ".join(common + [f"o{k}x{j}" for j in range(rnd.randint(8, 40))])) for k in range(230)]
    rows += [(1000 + k, varied(rnd, rows[k][1].split(), rnd.randint(1, 3))) for k in range(60)]
    compare(spark, rows, size=size)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "PIVOTS", 4)
    monkeypatch.setattr(minhash, "TILE", 8)
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    rows = [(500 - k, varied(rnd, base, rnd.randint(0, 4))) for k in range(300)] + [(1000 + k, varied(rnd, base, 9)) for k in range(40)]
    compare(spark, rows)


def test_chains_over_blocks(spark, monkeypatch):
    # each text is near the next only, so no pivot joins the chain
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "TILE", 4)
    words = [f"w{k}" for k in range(700)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(90)]
    compare(spark, rows)


def test_very_long_texts_and_nothing(spark):
    rnd = random.Random(1)
    long = [f"t{rnd.randrange(10**6)}" for _ in range(60_000)]
    compare(spark, [(5, " ".join(long)), (4, varied(rnd, long, 1500)), (3, varied(rnd, long, 9000)), (8, "x" * 300_000)])
    compare(spark, [])


def test_boilerplate_makes_no_pairs_of_tiles(spark, monkeypatch):
    # 600 texts share 300 of 470 words: one family, few links, and no class is copied more than a few times
    monkeypatch.setattr(minhash, "TILE", 16)
    rows = [(k, " ".join([f"c{j}" for j in range(300)] + [f"o{k}x{j}" for j in range(170)])) for k in range(600)]
    rows += [(1000 + k, rows[k * 7][1] + " tail words here") for k in range(20)] + [(2000, rows[3][1].replace("o3x", "p3x", 40))]
    seen = []
    real = minhash.compared
    monkeypatch.setattr(minhash, "compared", lambda units, threshold: seen.append(units.count()) or real(units, threshold))
    compare(spark, rows)
    assert len(seen) == 2 and seen[0] < 3 * len(rows) and seen[1] < 4 * 21


@pytest.mark.parametrize("seed", range(3))
def test_first_shingles_of_linked_sets_meet(seed):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = []
    for _ in range(80):
        own = np.concatenate([base[rng.random(60) < rng.uniform(0.7, 1)], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])
        sets.append(np.unique(own))
    table = pa.table({"node": list(range(80)), "grams": [s.tobytes() for s in sets], "pivot": [k % 7 == 0 for k in range(80)], "own": [True] * 80})
    for t in (60, 80, 100):
        first = {r["node"]: set(r["first"]) for r in minhash._first_shingles(t)(table).to_pylist()}
        for i in range(80):
            for j in range(i):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if inter and 100 * inter >= t * (len(sets[i]) + len(sets[j]) - inter):
                    assert first[i] & first[j]


def test_rounds_on_few_rows_are_few_tasks(spark, monkeypatch):
    # every round dealt its few rows to all shuffle partitions, and with 211 of them check_h took more disk
    # for the records and files of 79,000 tasks than it may
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "TILE", 4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(34)]
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc, group = spark.sparkContext, "few-tasks"
    for k, v in held.items():
        spark.conf.set(k, v)
    sc.setJobGroup(group, group)
    try:
        compare(spark, rows)
        status = sc.statusTracker()
        stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(status.getStageInfo, stages) if x)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert tasks < 4000, tasks


def test_rounds_on_few_rows_are_few_files(spark, monkeypatch):
    # a local file system without native code starts processes for each new file; one caught while it
    # still shares the executor's memory counted that memory twice (4,483 MB of 3,000 in a check)
    from geoloom.llm import runtime

    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PIVOTS", 2)
    monkeypatch.setattr(minhash, "TILE", 4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100])) for k in range(34)]
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    seen, real = [], runtime.written

    def written(df, name, by=None):
        out = real(df, name, by)
        seen.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr(runtime, "written", written)
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        compare(spark, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    small = [n for name, n in seen if name.startswith("components-") or name in ("minhash-families", "minhash-parts", "minhash-pivots", "minhash-open")]
    assert len(small) < 45 and sum(small) < 150, (len(small), sum(small))


@pytest.mark.parametrize("edges", [1 << 17, 3])
def test_components_of_tasks_and_rounds(spark, monkeypatch, edges):
    from geoloom.llm import components

    rnd = random.Random(edges)
    pairs = [(k, k + 1) for k in range(40)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(230)] + [(2000, k) for k in range(1990, 2030)] + [(7, None), (5000, 5000)]
    up = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a in up and b in up:
            up[max(root(a), root(b))] = min(root(a), root(b))
    monkeypatch.setattr(components, "EDGES", edges)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == {x: root(x) for x in up}
    assert components.connected_components(df.limit(0)).collect() == []


def test_joined_edges_are_stars():
    import numpy as np

    from geoloom.llm import components

    node, least = components.joined(np.array([9, 5, -3, 8, 40]), np.array([5, 2, -7, 9, 41]))
    assert dict(zip(node.tolist(), least.tolist())) == {5: 2, 8: 2, 9: 2, -3: -7, 41: 40}
