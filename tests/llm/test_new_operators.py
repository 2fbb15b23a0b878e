"""Importance resampling, vector codes and packing into windows, against brute force and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import importance, queries, vectorcodes, windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \t\n!?", "one", "One two", "a b c", "tail " * 30, "é ß 中文 😀 x1 " * 9, "A\0b\0C " * 12, "J̌X, a≠b =. a|. b<|endoftext|>. <|startoftext|>x", "x" * 30_000]


def features(text):
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    return words, Counter(zlib.crc32(" ".join(words[i : i + m]).encode()) % 10000 for m in (1, 2, 3) for i in range(len(words) - m + 1))


def resampled_by_hand(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in s}
    rows = []
    for doc, text in docs:
        words, own = features(text)
        weight = sum(gain[b] * n for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, sum(own.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    drawn = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, row in enumerate(drawn[: 5 * len(drawn) // 100], 1):
        row.append(place)
    return sorted(map(str, ((*r[:4], r[5] if len(r) > 5 else None) for r in rows)))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_resampling_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(importance, "LONG_TEXT", 400)  # also for the workers: the function is sent by value or forked after this
    rnd = random.Random(parts)
    texts = [" ".join(rnd.choice("Alpha beta gamma 7 délta 中 x_y z's".split()) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    docs = [*enumerate([*ODD, *texts, texts[5], " ".join(texts)]), (3, "again " * 25), (3, "again " * 25), (None, "no id " * 20)]
    target = [*texts[:9], None, ""]
    frame = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, buckets string, weight double")
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    assert got(importance.resampled(frame.repartition(parts), aims)) == resampled_by_hand(docs, target)


def test_parts_of_a_long_text_have_all_runs(monkeypatch):
    monkeypatch.setattr(importance, "LONG_TEXT", 50)
    text = "Some words, and MORE words:  é中 of a text -- cut anywhere 12 34_56 " * 9 + "y" * 300 + " end of it"
    counter, own = importance._Counter(), Counter()
    parts = list(importance._parts(text))
    assert len(parts) > 8 and "".join(p for p, _ in parts) == text
    for part in parts:
        _, bucket, n = counter.count([part])
        own.update(dict(zip(bucket.tolist(), n.tolist())))
    assert own == features(text)[1]


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none).collect() == []
    assert len(importance.resampled(spark.createDataFrame([(1, "a " * 50)], "doc_id long, text string"), none).collect()) == 1


def coded_by_hand(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    table = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    table = [v for v in table if len(v) == len(table[0])]
    q = len(table[0]) // 4
    parts = [[v[p * q : (p + 1) * q] for v in table] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

    for _ in range(4):
        for p in range(4):
            found = [near(x, books[p])[1] for x in parts[p]]
            for j in set(found):
                own = [x for x, k in zip(parts[p], found) if k == j]
                books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    final = [[near(parts[p][i], books[p]) for p in range(4)] for i in range(len(table))]
    most = 2**63 - 1
    error = [min(sum(d for d, _ in f), most) for f in final]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    text = ",".join(str(x) for b in books for c in b for x in c)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(str((i, "".join(f"{j:02x}" for _, j in f), e, min(by_label[label], most), sha)) for (i, _, label), f, e in zip(kept, final, error))


@pytest.mark.parametrize("big, most", [(1.0, 100), (3000.0, 100_000), (1e9, 0)])
def test_codes_equal_brute_force(spark, monkeypatch, big, most):
    monkeypatch.setattr(vectorcodes, "BROADCAST_LABELS", most)
    rnd = random.Random(3)
    rows = [(k, [round(rnd.gauss(0, 1), 2) * rnd.choice([1, 1, 1, big]) for _ in range(8)], rnd.choice([None, 1, 2])) for k in range(280)]
    rows += [(rows[9][0], rows[9][1], 2), (7, rows[3][1], 1), (None, rows[4][1], None)]  # repeated and null ids, ties
    odd = [(900, None, 1), (901, [None] + [1.0] * 7, 1), (902, [float("nan")] + [1.0] * 7, 1), (903, [float("-inf")] + [1.0] * 7, 2)]
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows + odd], "vec_id long, embedding array<double>, label int, code string, v int")
    want = coded_by_hand(rows)
    for n in (1, 6):
        assert got(vectorcodes.compressed(frame.repartition(n))) == want


def test_codes_of_nothing_and_of_other_lengths(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vectorcodes.compressed(spark.createDataFrame([], kind)).collect() == []
    assert vectorcodes.compressed(spark.createDataFrame([(1, None, 1)], kind)).collect() == []
    rows = [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1), (3, [], 1), (4, [1.5] * 4, 1)]
    assert [r.vec_id for r in vectorcodes.compressed(spark.createDataFrame(rows, kind)).orderBy("vec_id").collect()] == [1, 4]
    with pytest.raises(ValueError, match="do not divide"):
        vectorcodes.compressed(spark.createDataFrame([(1, [1.0] * 6, 1)], kind))


@pytest.mark.parametrize("size", [3, 900, 60_000, 1 << 23])
def test_screening_misses_no_nearest_entry(size):
    rng = np.random.default_rng(size)
    x, book = rng.integers(-size, size, (3000, 16)), rng.integers(-size, size, (256, 16))
    book[40], book[200] = book[7], book[7] + 1  # equal and nearly equal entries
    x[:500] = book[rng.integers(0, 256, 500)]
    exact = ((x[:, None, :] - book[None]) ** 2).sum(2)
    index, least = vectorcodes.nearest(x, book)
    assert (index == exact.argmin(1)).all() and (least == exact.min(1)).all()


def best_fit_by_hand(sizes, capacity):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in rooms if r >= size]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - size)
    return sorted(rooms)


@pytest.mark.parametrize("capacity", [1, 2, 7, 8, 9, 100, 4096])
def test_windows_are_the_tightest(capacity):
    rnd = random.Random(capacity)
    for n in (0, 1, 2, 30, 400):
        sizes = [rnd.randint(1, capacity) for _ in range(n)]
        made = windows.best_fit_decreasing(sizes, capacity)
        assert sorted(i for w in made for i in w) == list(range(n))
        assert sorted(capacity - sum(sizes[i] for i in w) for w in made) == best_fit_by_hand(sizes, capacity)
        full, rest = windows.top_up([[(i, 0, sizes[i]) for i in w] for w in made], capacity)
        last = windows.powers_of_two(rest)
        assert all(sum(z - a for _, a, z in w) == capacity for w in full)
        assert sorted(sum(z - a for _, a, z in w) for w in last) == [1 << b for b in range(13) if (sum(sizes) % capacity) >> b & 1]
        cells = [(i, t) for w in full + last for i, a, z in w for t in range(a, z)]
        assert len(cells) == len(set(cells)) == sum(sizes)


def check_windows(rows, docs):
    """``rows`` are pieces of ``docs`` (id, text), all ids once, without padding."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("word_bpe_49k.json"))
    ids = {}
    for doc, text in docs:
        ids.setdefault(doc, []).append(np.array(coder.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    for doc, texts in ids.items():
        own = [(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc]
        assert sum(n for _, n, _, _ in own) == sum(map(len, texts))
        for a, n, crc, total in own:
            assert any(len(t) == total and zlib.crc32(t[a : a + n].tobytes()) == crc for t in texts)
        if len(texts) == 1:
            at = 0
            for a, n, _, _ in sorted(own):
                assert a == at
                at += n
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    odd = Counter()
    for own in places.values():
        at = 0
        for a, n in sorted(own):
            assert a == at and n > 0
            at += n
        odd[at] += 1
    assert all(n == 4096 or n & (n - 1) == 0 and k == 1 for n, k in odd.items())


@pytest.mark.parametrize("block", [1 << 22, 6000])
def test_windows_of_all_documents(spark, sf_dir, monkeypatch, block):
    monkeypatch.setattr(windows, "BLOCK_TOKENS", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    rows = windows.packed(docs).collect()
    check_windows(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_windows_of_odd_texts(spark):
    long = "Some Words, of a VERY long text. " * 60_000
    docs = [*enumerate([*ODD, long, "word" * 20_000, "é, für*** İ ΑΣ \x85a\x1cb  c"]), (3, "a second three"), (3, "a second three"), (None, "no id"), *((k, None) for k in range(1000, 6000))]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, ids string, sequence_id int")
    check_windows(windows.packed(frame.repartition(4)).collect(), docs)
    assert windows.packed(frame.limit(0)).collect() == []
    assert got(windows.packed(frame.where("doc_id = 4")).select("start", "length", "doc_tokens", "offset")) in (["(0, 3, 3, 0)"], ["(0, 2, 3, 0)", "(2, 1, 3, 0)"])


def test_ids_of_any_characters_are_the_tokenizer_s(monkeypatch):
    monkeypatch.setattr(windows, "CACHE_WORDS", 40)
    monkeypatch.setattr(windows, "SEGMENT_BYTES", 30)
    coder, rnd = windows._tokenizer(windows.TOKENIZER), random.Random(5)
    letters = [*"aBcJ .,;:!?%$&#*<|>='0-9", " ", " ", "\n", "\0", "́", "̌", "ß", "é", "É", "ÿ", "̸", "ͅ", " ", "\x85", "\x1c", "’"]
    for k in range(400):
        texts = ["".join(rnd.choice(letters) if rnd.random() < 0.9 else chr(rnd.randrange(1, 0xD000)) for _ in range(90)) for _ in range(1 + k % 2)]
        for text, ids in zip(texts, windows.token_ids([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == [*coder.encode(text, add_special_tokens=False).ids, 2], repr(text)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_vector_code_compression"])
def test_new_queries_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    frame = queries.queries()[name](spark, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    assert got(frame.select(*map(F.col, columns))) == sorted(str(tuple(r)) for r in want.fetchall())
