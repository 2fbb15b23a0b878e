"""The learned operators against naive loops, and on odd inputs."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat, decontam, langid, packing, toxicity
from geoloom.llm.textkit import ALNUM, Words, chunks


def naive_marginals(emission, trans, start):
    """Toxic and pair marginals of one text by summing over all tag sequences."""
    n, total = len(emission), 0.0
    single, pairs = np.zeros(n), np.zeros((n, 2, 2))
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = np.exp(start[y[0]] + sum(e * t for e, t in zip(emission, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
        total += w
        for i, t in enumerate(y):
            single[i] += w * t
            if i:
                pairs[i, y[i - 1], t] += w
    return single / total, pairs / total


def test_forward_backward_equals_all_sequences():
    rng = np.random.default_rng(2)
    lengths = [1, 2, 7, 10, 1, 9, 10, 10, 10]  # more than one block of the scan
    emission, trans, start = rng.normal(0, 2, sum(lengths)), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    first = np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    p, pair = toxicity.marginals(emission, first, trans, start)
    at = 0
    for n in lengths:
        single, pairs = naive_marginals(emission[at : at + n], trans, start)
        assert np.allclose(p[at : at + n], single, atol=1e-9) and np.allclose(pair[at + 1 : at + n], pairs[1:], atol=1e-9)
        at += n


def test_long_text_equals_step_by_step():
    rng = np.random.default_rng(3)
    n, trans, start = 5000, rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    emission = rng.normal(0, 3, n)
    first = np.zeros(n, bool)
    first[0] = True
    p, _ = toxicity.marginals(emission, first, trans, start)
    e = np.stack([np.zeros(n), emission], 1)
    alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
    alpha[0] = start + e[0]
    for i in range(1, n):
        alpha[i] = np.logaddexp(*(alpha[i - 1][:, None] + trans)) + e[i]
    for i in range(n - 2, -1, -1):
        beta[i] = np.logaddexp(*(trans + e[i + 1] + beta[i + 1]).T)
    both = alpha + beta
    assert np.allclose(p, 1 / (1 + np.exp(both[:, 0] - both[:, 1])), atol=1e-9)


def test_document_scores_equal_a_loop_over_documents():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 0.2, 1 << toxicity.BITS).astype(np.float32), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2), np.array([-1.0, 2.0, 0.3]))
    texts = ["One two three!", "", None, "é über straße 12", "x" * 5000, "a b " * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([None if t is None else t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    out = next(toxicity._score(model, 1)(iter([batch])))
    for text, score, spans in zip(texts, out.column("score").to_pylist(), out.column("spans").to_pylist()):
        _, data, offsets = next(chunks(pa.array([(text or "").encode()])))
        words = Words(data, offsets, lower=True, solid=ALNUM)
        p = model.tag(toxicity.features(words), np.arange(len(words)) == 0)
        want = model.documents(np.array([p.max(initial=0)]), np.array([p.sum()]))[0]
        assert score == pytest.approx(want, abs=1e-6)
        assert all(0 <= s["start"] < s["end"] <= len(text) for s in spans)


def test_decoding_equals_a_loop_over_codewords():
    rng = np.random.default_rng(5)
    for langs in (1, 2, 5, 9):
        code = langid.codewords(langs)
        assert code.shape[0] == langs and len({tuple(c) for c in code.tolist()}) == langs
        bits = code.shape[1]
        model = langid.Model([f"l{k}" for k in range(langs)], code, rng.normal(0, 1, (langid.FEATURES, bits)).astype(np.float32), rng.normal(0, 1, bits).astype(np.float32), rng.uniform(0.5, 2, bits).astype(np.float32))
        texts = ["some words here", "ganz andere Wörter", "x", "mehr", "", None, "12 34"]
        batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([None if t is None else t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
        out = next(langid._predict(model, 1)(iter([batch])))
        x = np.concatenate(list(langid.profiles(batch.column(1))))
        for k, text in enumerate(texts):
            if not text or not any(c.isalpha() for c in text):
                assert out.column("lang_pred")[k].as_py() == "und" and out.column("score")[k].as_py() == 0
                continue
            margin = [float(sum(x[k, f] * model.weights[f, b] for f in np.flatnonzero(x[k]))) + float(model.bias[b]) for b in range(bits)]
            loss = [sum(float(model.trust[b]) * np.log1p(np.exp(-4 * margin[b] * code[l, b])) for b in range(bits)) for l in range(langs)]
            assert out.column("lang_pred")[k].as_py() == f"l{int(np.argmin(loss))}"
            gap = sorted(loss)[1] - min(loss) if langs > 1 else 5.0
            assert out.column("score")[k].as_py() == pytest.approx(1 / (1 + np.exp(-gap)), abs=1e-3)


def rows_of(n, rnd):
    words = {"aa": "kato malo suri tepo", "bb": "grun zwer plock streng"}
    return [(k, " ".join(rnd.choices(words[l].split(), k=30)), l) for k in range(n) for l in [sorted(words)[k % 2]]]


def test_copies_do_not_swell_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PER_LANG", 20)
    rnd = random.Random(0)
    rows = rows_of(300, rnd) + [(1000 + k, "kato kato malo", "aa") for k in range(3000)]
    drawn = []
    real = langid.codewords
    monkeypatch.setattr(langid, "codewords", lambda n: drawn.append(n) or real(n))
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert drawn == [2] and all(got[k] == l for k, _, l in rows)


def test_rows_of_one_id_do_not_swell_the_toxicity_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", (40, 40))
    monkeypatch.setattr(toxicity, "MOST_DOCS", (50, 50))
    sizes = []
    real = toxicity.distinct
    monkeypatch.setattr(toxicity, "distinct", lambda parts: sizes.append(len(parts)) or real(parts))
    one = next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 5)
    rows = [(k, f"plain words number {k}" if k % 3 else f"vile scum number {k}") for k in range(120)]
    rows += [(one, f"vile text {k % 900} of one id") for k in range(20_000)]
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)] + [(one, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert len(sizes) == 1 and sizes[0] <= 100 and model.score is not None


def test_many_languages(spark, monkeypatch):
    rnd = random.Random(1)
    rows = []
    for l in range(230):  # more than any fixed list
        own = ["".join(chr(97 + (l * 7 + 3 * j + i * i) % 26) for i in range(6)) + f"{chr(97 + l % 26)}{chr(97 + l // 26)}" for j in range(5)]
        rows += [(l * 10 + k, " ".join(rnd.choices(own, k=40)), f"l{l:03d}") for k in range(10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(d).collect()}
    assert len(set(got.values())) > 200
    assert sum(got[k] == l for k, _, l in rows) > 0.9 * len(rows)
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 100)
    with pytest.raises(ValueError):
        langid.identify(d)


def test_odd_rows(spark):
    rnd = random.Random(2)
    rows = [*rows_of(60, rnd), (5, "kato malo", "aa"), (5, "grun zwer", "bb"), (None, "kato malo suri", "aa"), (None, None, None), (800, "kato " * 100_000, "aa")]
    d = spark.createDataFrame([(*r, 1, "s", True) for r in rows], "doc_id long, text string, lang string, score int, spans string, held_out boolean")
    labels = spark.createDataFrame([(k, None, k % 2) for k in range(60)] + [(None, 1, 1), (3, 1, None), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (langid.identify(d), toxicity.detect(d, labels)):
        got = out.collect()
        assert len(got) == len(rows) and sum(r.doc_id is None and r.held_out for r in got) == 2 and sum(r.doc_id == 5 for r in got) == 3


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, " \t\n" * 400_000 + "x"])
def test_long_runs_are_packed(spark, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = t.encode(text, add_special_tokens=False).ids + [packing.END_ID]
    assert packing.token_ids(text, encode_special_tokens=False).tolist() == want
    d = spark.createDataFrame([(1, text, 3, 4)], "doc_id long, text string, piece int, members int")
    assert packing.packed(d, encode_special_tokens=False).agg(F.sum("length")).first()[0] == len(want)


def test_packing_of_repeated_and_null_ids(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)], "doc_id long, text string")
    got = packing.packed(d).collect()
    assert len(got) == 5 and sum(r.doc_id is None for r in got) == 2


@pytest.mark.parametrize("broadcast", [True, False])
def test_leaks_of_odd_rows(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    item = [f"t{k}" for k in range(30)]
    rows = [(1, " ".join(item)), (1, "clean text of the same id"), (1, " ".join(item)), (None, " ".join(["x", *item[:22]])), (None, "clean"), (3, " ".join(["f"] * 200_000 + item)), (4, " ".join(item[:10])), (5, " ".join(item + ["y"] + item))]
    docs = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, item int, seed int, start string")
    bench = spark.createDataFrame([(7, " ".join(item), 1), (7, " ".join(item), 1), (None, " ".join(item[10:]), 2)], "item_id long, text string, row int")
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_tokens, r["at"]) for r in decontam.leaks(docs, bench).collect()}
    want = {(d, 7): (30, 30, at) for d, at in ((1, 0), (3, 200_000), (5, 0))} | {(d, None): (20, 20, at + 10) for d, at in ((1, 0), (3, 200_000), (5, 0))} | {(None, 7): (22, 30, 1), (None, None): (12, 20, 11)}
    assert got == want
    assert sorted(map(str, (r.doc_id for r in decontam.without_leaks(docs, bench).collect()))) == ["1", "4", "None"]


def test_branches_with_equal_scores(spark):
    rows = [(1, 0, None, "user", "q", 0.0), *[(1, k, 0, "assistant", f"a{k}", 2.0) for k in (3, 1, 2)], (1, 4, 0, "assistant", "none", None)]
    tree = spark.createDataFrame([(*r, "x", 1) for r in rows], "tree_id long, msg_id long, parent_id long, role string, text string, score double, rank string, formatted int")
    for n in (1, 3):
        a = [(r.tree_id, chat.read_turns(r.formatted)) for r in chat.format_trees(tree, n).orderBy("rank").collect()]
        b = [(r.tree_id, chat.read_turns(r.formatted)) for r in chat.format_trees(tree.repartition(3), n).orderBy("rank").collect()]
        assert a == b and len(a) == n
