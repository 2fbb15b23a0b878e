"""Toxic spans by a linear-chain conditional random field.

Two tags (plain, toxic) over the tokens of a text (runs of letters and
digits). A token's features are hashes of its lower-cased form and of its
first 4, 5 and 6 bytes. Only documents are labelled, so training tokens are
tagged from the labels first: in toxic documents of the sample, tokens with
a feature that is far more frequent in toxic documents than in others. The
field is then fitted to those tags by gradient ascent on the conditional
likelihood, whose expectations come from forward-backward. A logistic
function of the largest and the summed toxic marginals, fitted to the
document labels, gives the document's score; runs of tokens with a toxic
marginal of a half or more are the offending spans, with offsets in code
points.

Forward-backward runs over all texts of a chunk at once: the chain is cut
into blocks whose 2 x 2 matrix products are formed side by side and then
joined in a few rounds, so long texts cost no long Python loop.

The training sample is bounded: about ``SAMPLE_DOCS`` documents of
the two labels, drawn by a hash of the id, without texts over ``SAMPLE_BYTES`` bytes. Equal rows of an id count
once, and of rows with several texts the sample holds at most ``MOST_DOCS`` of a label before
anything is collected. Scores read every whole text, of any length, in chunks.

Defined results: null and empty texts get the score of a text without toxic
tokens; a document with several labels is toxic if one says so; rows with a
null label or id teach nothing and get a score as others do; repeated rows are
scored each by itself; without labels of both kinds every score is 0; an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit
from .langid import held_out
from .textkit import ALNUM, Words

#: Documents of the sample that are toxic and not, and tokens of each kind
#: that the field is fitted to (tags and scores use the whole sample).
SAMPLE_DOCS, SAMPLE_BYTES, FIT_TOKENS = (5000, 1500), 60_000, 60_000
#: The draw of ids meets SAMPLE_DOCS but for chance; ids with several texts are cut to this.
MOST_DOCS = tuple(n * 5 // 4 for n in SAMPLE_DOCS)
BITS = 18
HEADS = (4, 5, 6)
STEPS = 25
_BLOCK = 32
#: A feature marks a token of the sample if it is in at least MIN_DOCS toxic
#: documents and MIN_PART of them, and LIFT times as frequent there as in the
#: others. (Of very many rare words some are in a few toxic ones by chance.)
MIN_DOCS, MIN_PART, LIFT = 4, 0.012, 15.0


def features(words: Words) -> np.ndarray:
    """(tokens x features) buckets."""
    cols = [words.hashes()] + [words.prefixes(k) for k in HEADS]
    return np.stack([(c >> np.uint64(64 - BITS)).astype(np.int32) for c in cols], axis=1)


def _scan(m: np.ndarray) -> np.ndarray:
    """Running products of n 2x2 matrices, each scaled to a largest entry of 1."""
    n = len(m)
    if n <= _BLOCK:
        out = np.empty_like(m)
        have = m[0]
        out[0] = have / have.max()
        for i in range(1, n):
            have = out[i - 1] @ m[i]
            out[i] = have / have.max()
        return out
    blocks = -(-n // _BLOCK)
    padded = np.empty((blocks * _BLOCK, 2, 2))
    padded[:n], padded[n:] = m, np.eye(2)
    inside = padded.reshape(blocks, _BLOCK, 2, 2)
    for i in range(1, _BLOCK):
        step = _times(inside[:, i - 1], inside[:, i])
        inside[:, i] = step / step.max(axis=(1, 2))[:, None, None]
    before = _scan(inside[:, -1].copy())[:-1]
    inside[1:] = _times(before[:, None], inside[1:])
    out = inside.reshape(-1, 2, 2)[:n]
    return out / out.max(axis=(1, 2))[:, None, None]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(np.broadcast_shapes(a.shape, b.shape))
    for i in (0, 1):
        for j in (0, 1):
            out[..., i, j] = a[..., i, 0] * b[..., 0, j] + a[..., i, 1] * b[..., 1, j]
    return out


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over concatenated texts.

    ``emission``: log weight of the toxic tag of each token; ``first``: which
    tokens begin a text. Returns (toxic marginals, marginals of tag pairs
    with the token before, meaningless where ``first``).
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    e = np.exp(np.clip(emission, -30, 30))
    m = np.empty((n, 2, 2))
    m[:] = np.exp(trans)
    m[first] = np.exp(start)[None, None, :]
    m[:, :, 1] *= e[:, None]
    alpha = _scan(m)[:, 0]
    alpha /= alpha.sum(1, keepdims=True)
    # suffix products: transposed matrices in reverse order
    ends = np.append(first[1:], True)
    back = np.empty((n, 2, 2))
    back[:-1] = np.swapaxes(m[1:], 1, 2)
    back[-1] = 1.0
    back[ends] = 1.0
    beta = _scan(back[::-1])[::-1][:, 0]
    beta = beta / beta.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(1, keepdims=True)
    pair = np.zeros((n, 2, 2))
    pair[1:] = alpha[:-1, :, None] * m[1:] * beta[1:, None, :]
    pair[1:] /= pair[1:].sum(axis=(1, 2), keepdims=True)
    return p[:, 1], pair


class Model:
    """Weights of the field and of the document score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray, score: np.ndarray | None):
        self.weights, self.trans, self.start, self.score = weights, trans, start, score

    def tag(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        return marginals(self.weights[feats].sum(1, dtype=np.float64), first, self.trans, self.start)[0]

    def documents(self, top: np.ndarray, total: np.ndarray) -> np.ndarray:
        if self.score is None:
            return np.zeros(len(top))
        return 1 / (1 + np.exp(-(_summary(top, total) @ self.score)))


def _summary(top: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(top)), top, np.log1p(total)], axis=1)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, data, offsets in textkit.chunks(batch.column(1)):
            words = Words(data, offsets, lower=True, solid=ALNUM)
            f = features(words)
            out += [f[a:z].tobytes() for a, z in zip(words.first[:-1], words.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["toxic", "x"])


def distinct(parts: list[np.ndarray], hashes: int = 16) -> list[int]:
    """The documents that share none of their MinHashes of three tokens with
    an earlier one, so that copies do not count as independent evidence."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, f in enumerate(parts):
        x = textkit.fold(f[:, 0].astype(np.uint64) + np.uint64(1), min(3, max(1, len(f))))
        if not len(x):
            continue
        keys = {(k, int(textkit.mix(x + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min())) for k in range(hashes)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


def weak_tags(feats: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens of toxic documents carry a feature typical of those."""
    marked = np.zeros(len(feats), bool)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    for k in range(feats.shape[1]):
        seen = np.unique(doc.astype(np.int64) << BITS | feats[:, k])
        bucket, bad = seen & ((1 << BITS) - 1), toxic[seen >> BITS]
        b = np.bincount(bucket[bad], minlength=1 << BITS)
        g = np.bincount(bucket[~bad], minlength=1 << BITS)
        typical = (b >= max(MIN_DOCS, MIN_PART * n_bad)) & (b / n_bad >= LIFT * (g + 0.5) / n_good)
        marked |= typical[feats[:, k]]
    return marked & toxic[doc]


def fit(feats: np.ndarray, doc: np.ndarray, toxic: np.ndarray, steps: int = STEPS) -> Model:
    """The field by Adagrad on tagged tokens, then the document score."""
    weights, trans, start = np.zeros(1 << BITS), np.zeros((2, 2)), np.zeros(2)
    all_feats, all_doc = feats, doc
    all_tags = weak_tags(feats, doc, toxic)
    # a few whole documents of each kind are enough for the field
    size = np.bincount(doc, minlength=len(toxic))
    mine = np.zeros(len(toxic), bool)
    for kind in (toxic, ~toxic):
        mine |= kind & (np.cumsum(size * kind) <= max(FIT_TOKENS, (size * kind).max(initial=0)))
    feats, doc, tags = feats[mine[doc]], doc[mine[doc]], all_tags[mine[doc]].astype(int)
    first = np.append(True, doc[1:] != doc[:-1])
    inner = np.flatnonzero(~first)
    flat = feats.ravel()
    width = feats.shape[1]
    gold_pair = np.bincount(tags[inner - 1] * 2 + tags[inner], minlength=4).reshape(2, 2)
    gold_start = np.bincount(tags[first], minlength=2)
    sums = [np.full_like(a, 1e-6) for a in (weights, trans, start)]
    for _ in range(steps):
        p, pair = marginals(weights[feats].sum(1), first, trans, start)
        grads = (
            np.bincount(flat, np.repeat(tags - p, width), 1 << BITS) - 0.01 * weights,
            gold_pair - pair[inner].sum(0) - 0.1 * trans,
            gold_start - np.stack([1 - p[first], p[first]], 1).sum(0) - 0.1 * start,
        )
        for value, grad, total in zip((weights, trans, start), grads, sums):
            total += grad**2
            value += 0.5 * grad / np.sqrt(total)
    model = Model(weights.astype(np.float32), trans, start, None)
    p = model.tag(all_feats, np.append(True, all_doc[1:] != all_doc[:-1]))
    top, total = np.zeros(len(toxic)), np.bincount(all_doc, p, len(toxic))
    np.maximum.at(top, all_doc, p)
    x, y, w = _summary(top, total), toxic.astype(float), np.zeros(3)
    even = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    for _ in range(50):  # Newton steps of a ridge-penalised logistic fit
        q = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (even * (y - q)) - 1e-4 * w
        w += np.linalg.solve((x * (even * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(3), grad)
    model.score = w
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model on the labelled rows of ``docs`` (learning rows only)."""
    docs = runtime.bounded_batches(docs)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("toxic"))
    marks = marks.where("toxic in (0, 1)")
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("toxic") == value, min(1.0, SAMPLE_DOCS[value] / n)).otherwise(share)
    drawn = marks.where(F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 30)) / float(1 << 30) < share)
    short = docs.where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= SAMPLE_BYTES)
    rows = short.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "key")  # some ids of each label
    rows = rows.withColumn("hash", F.xxhash64("text"))
    got = _bounded(rows).mapInArrow(_sample, "toxic int, x binary").toArrow()
    toxic = np.array(got.column("toxic").to_pylist(), bool)
    parts = [np.frombuffer(v, np.int32).reshape(-1, 1 + len(HEADS)) for v in got.column("x").to_pylist()]
    order = sorted(range(len(parts)), key=lambda i: (zlib.crc32(parts[i].tobytes()), toxic[i]))
    toxic, parts = toxic[order], [parts[i] for i in order]
    alone = distinct(parts)
    toxic, parts = toxic[alone], [parts[i] for i in alone]
    if not len(toxic) or toxic.all() or not toxic.any() or not sum(map(len, parts)):
        return Model(np.zeros(1 << BITS, np.float32), np.zeros((2, 2)), np.zeros(2), None)
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return fit(np.concatenate(parts), doc, toxic)


def _bounded(rows: DataFrame) -> DataFrame:
    """(toxic, text): each text of an id once, and of each label ``MOST_DOCS`` at most, whatever rows an id has."""
    each = rows.groupBy("toxic", "key", "hash").agg(F.count("*").alias("n"))
    kept = [each.where(F.col("toxic") == label).orderBy(F.xxhash64("key", "hash", F.lit(23)), "key", "hash").limit(most) for label, most in enumerate(MOST_DOCS)]
    kept = runtime.cut(kept[0].unionByName(kept[1]).drop("n"))
    texts = rows.join(F.broadcast(kept), ["toxic", "key", "hash"])
    return texts.groupBy("toxic", "key", "hash").agg(F.first("text").alias("text")).select("toxic", F.col("text").cast("binary").alias("text"))


def _spans(words: Words, data: np.ndarray, a: int, z: int, start: int, p: np.ndarray) -> list[dict]:
    """Runs of toxic tokens of a text, in code points."""
    hit = np.flatnonzero(p[a:z] >= 0.5) + a
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    points = np.concatenate([[0], np.cumsum((data[start : words.ends[z - 1]] & 0xC0) != 0x80)])
    return [{"start": int(points[words.starts[r[0]] - start]), "end": int(points[words.ends[r[-1]] - start]), "p": float(p[r].max())} for r in runs if len(r)]


def _score(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, spans = [], []
            for _, data, offsets in textkit.chunks(batch.column(at), 2 << 20):
                words = Words(data, offsets, lower=True, solid=ALNUM)
                first = np.zeros(len(words), bool)
                first[words.first[:-1][words.counts > 0]] = True
                p = model.tag(features(words), first)
                rows = words.rows()
                total = np.bincount(rows, p, len(words.counts))
                top = np.zeros(len(words.counts))
                some = words.counts > 0
                if some.any():
                    top[some] = np.maximum.reduceat(p, words.first[:-1][some])
                score.append(model.documents(top, total))
                for k in range(len(top)):
                    spans.append(_spans(words, data, words.first[k], words.first[k + 1], offsets[k], p) if top[k] >= 0.5 else [])
            score = np.concatenate(score) if score else np.zeros(0)
            keep = [batch.column(i) for i in range(batch.num_columns) if i != at]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            names = [f for i, f in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, kind)], [*names, "score", "predicted", "spans"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, spans), a row for each row."""
    docs = runtime.bounded_batches(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_score(model, 2), f"doc_id {kind}, held_out boolean, score double, predicted int, spans array<struct<start:int,end:int,p:double>>")


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, train(docs, labels))
