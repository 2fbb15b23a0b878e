"""Window removal by row against brute force, with divided buckets."""

import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pytest

from geoloom.llm import substring


def by_row(rows, width=13):
    """The digest of every row; windows are first held by the least id, null being the greatest."""
    key = lambda d: float("inf") if d is None else d
    split = [(key(d), (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            first[g] = min(d, first.get(g, d))
    out = []
    for (d, _), (k, w) in zip(rows, split):
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < k for j in range(i, i + width)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("held", [24 << 20, 600, 1])
def test_divided_buckets_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(substring, "BUCKET_BYTES", held)
    rnd = random.Random(held)
    often = "at the end of"  # a run that many different windows share
    texts = [" ".join(rnd.choice([often, f"w{rnd.randint(0, 60)}", f"x{rnd.randint(0, 9)} y z"]) for _ in range(60)) for _ in range(50)]
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k % 37, t if k % 3 else f"{t} {passage} {t[:90]}") for k, t in enumerate(texts)] + [(None, passage), (None, f"own {passage} words"), (5, None), (5, ""), (6, f"{passage} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in substring.digest(docs).collect()), key=str)
    assert got == sorted(by_row(rows), key=str)


def test_plan_bounds_buckets():
    size = np.zeros(substring.CELLS, np.int64)
    size[:1000] = 50
    size[7] = 10_000
    made = substring.plan_of(size, 1, 400)
    assert made.shares[7] == 25 and (np.delete(made.shares, 7) == 1).all()
    held = np.bincount(made.first, size)
    assert (np.delete(held, made.first[7]) <= 400).all()
    assert made.first[8] == made.first[7] + 25 and (np.diff(made.first) >= 0).all()
    assert (substring.plan_of(np.zeros(substring.CELLS, np.int64), 8, 400).shares == 1).all()


def test_very_long_text_and_clashing_columns(spark):
    long = " ".join(f"l{k}" for k in range(150_000))
    rows = [(2, long, 1, "a"), (1, " ".join(f"l{k}" for k in range(70_000, 70_050)), 2, "b"), (3, "x" * 400_000, 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.row) for r in substring.remove_repeats(docs).collect()}
    assert got == {1: (50, 0, "b"), 2: (150_000, 50, "a"), 3: (1, 0, None)}


#: Runs in a process of its own, as a worker does, and prints the MB held after a task beyond those before.
KEPT = """
import re
import numpy as np
import pyarrow as pa
from geoloom.llm import substring

def held():
    return int(re.search(r"Pss_Anon: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n):
    rng = np.random.default_rng(2)
    words = np.array([f"w{k:05d}" for k in range(50000)])
    passage = " ".join(words[rng.integers(0, 50000, 60)])
    for k in range(n):
        texts = [" ".join(words[rng.integers(0, 50000, 400)]) + " " + passage for _ in range(1024)]
        ids = pa.array(range(k * 1024, k * 1024 + 1024), pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array([0] * 1024, pa.int64()), pa.array(texts, pa.string()).cast(pa.binary())], ["doc", "row", "text"])

for _ in batches(1):
    pass
del _
plan = substring.plan_of(np.full(substring.CELLS, 60000), 12, substring.BUCKET_BYTES)
before = held()
assert sum(len(out) for out in substring._scatter(plan, 13, 4)(batches(5)))
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="Linux only")
def test_an_idle_worker_keeps_little_of_a_task():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-c", KEPT], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert float(ran.stdout) < 48
