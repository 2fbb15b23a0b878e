"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a linear classifier
over hashed character n-grams (of bytes, lower-cased, everything but letters
one space) predicts it. Decoding takes the language whose codeword has the
least weighted logistic loss against the predicted margins; a bit's weight
is how well its classifier did on the training sample. A small difference to
the second best codeword marks the text as ambiguous.

The classifiers are fitted by ridge regression on a sample of distinct labelled
texts: ``SAMPLE_ROWS`` in all, shared out evenly among the languages and
``SAMPLE_PER_LANG`` of each at most, without texts over ``SAMPLE_BYTES`` bytes. It is
drawn by a hash of the text, so it does not depend on order, partitions or the
number of copies of a text. Predictions read every whole text.

Defined results: ``und`` with score 0 for null texts and texts without a
letter; with no labelled language everything is ``und``; with one, it is
predicted for every text with letters; a row with a null id counts as held
out; rows with a repeated id are predicted each by itself; extra columns are not
read; an empty table gives an empty table. More than ``SAMPLE_ROWS`` different
languages are an error, not a silent cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runtime, textkit

SAMPLE_ROWS, SAMPLE_PER_LANG, SAMPLE_BYTES = 3000, 600, 200_000
BUCKET_BITS = 12
FEATURES = 2 << BUCKET_BITS
RIDGE = 1e-3
#: Loss difference below which a text is ambiguous.
AMBIGUOUS = 0.5


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is outside the learning folds."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed 3-grams and 4-grams of a chunk, row offsets into them).

    Row ends are spaces, so no n-gram of letters reaches into another row.
    """
    low = textkit.lowered(data)
    letter = textkit.ALNUM[low] & ~((low >= 0x30) & (low <= 0x39))
    wide = np.full(len(data) + 2 * len(offsets), 0x20, np.uint8)
    place = np.arange(len(data)) + 2 * np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    wide[place] = np.where(letter, low, 0x20)
    space = wide == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]  # of a run of spaces the first only
    kept = wide[keep].astype(np.uint64)
    count = np.concatenate([[0], np.cumsum(keep)])
    row_at = count[np.minimum(offsets + 2 * np.arange(len(offsets)), len(wide))]
    if len(kept) < 4:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    three = (kept[:-3] << np.uint64(16)) | (kept[1:-2] << np.uint64(8)) | kept[2:-1]
    four = (three << np.uint64(8)) | kept[3:]
    shift = np.uint64(64 - BUCKET_BITS)
    a = (three * np.uint64(0x9E3779B97F4A7C15)) >> shift
    b = ((four * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift) | np.uint64(1 << BUCKET_BITS)
    return np.stack([a, b], axis=1).astype(np.int64), np.minimum(row_at, len(a))


def profiles(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows of n-gram frequencies, in row order."""
    for _, data, offsets in textkit.chunks(column, 1 << 20):
        codes, at = grams(data, offsets)
        rows = len(offsets) - 1
        for first in range(0, rows, 64):
            block = np.zeros((min(64, rows - first), FEATURES), np.float32)
            for k in range(len(block)):
                own = codes[at[first + k] : at[first + k + 1]]
                if len(own):
                    block[k] = np.bincount(own.ravel(), minlength=FEATURES) / len(own)
            yield np.sqrt(block)


def codewords(langs: int) -> np.ndarray:
    """A code (languages x bits) of +1 and -1 without constant columns.

    Up to seven languages: all distinct splits. Beyond: the best of random
    codes of 10 log2(languages) bits by least distance of two codewords (one code
    alone beyond 300 languages, where random ones hardly differ).
    """
    if langs == 1:
        return np.ones((1, 1), np.int8)
    if langs <= 7:
        bits = np.arange(1, 1 << (langs - 1))
        return np.where((bits[None, :] << 1) >> np.arange(langs)[:, None] & 1, 1, -1).astype(np.int8)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200 if langs <= 300 else 1):
        code = rng.choice(np.array([-1, 1], np.int8), (langs, int(10 * np.ceil(np.log2(langs)))))
        agree = code.astype(np.float32) @ code.T.astype(np.float32)
        apart = (code.shape[1] - (agree - 10**6 * np.eye(langs, dtype=np.float32)).max()) / 2
        if apart > far and (np.abs(code.sum(0, dtype=int)) < langs).all():
            best, far = code, apart
    return best


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [row.astype(np.float16).tobytes() for block in profiles(batch.column(1)) for row in block]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], ["lang", "x"])


class Model:
    """Languages, their codewords, and one linear classifier a bit."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The weighted loss of each language for each row."""
        margins = x @ self.weights + self.bias
        return np.logaddexp(0, -4.0 * margins[:, None, :] * self.code[None]) @ self.trust


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits a model on labelled rows of ``docs`` (learning rows only)."""
    docs = runtime.bounded_batches(docs)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= SAMPLE_BYTES))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col, F.lit(17)).alias("hash"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"))
    counts = runtime.written(counts, "language-counts")
    known = counts.count()
    if known > SAMPLE_ROWS:
        raise ValueError(f"{known} languages are more than the sample of {SAMPLE_ROWS} texts can teach")
    quota = min(SAMPLE_PER_LANG, SAMPLE_ROWS // max(1, known))
    # a little more than the quota is drawn by hash, then cut to it: the count of distinct texts is an estimate
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(1.3 * quota + 20) / F.col("n")).alias("share"))
    drawn = rows.join(F.broadcast(share), "lang").where(F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) < F.col("share"))
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash")
    picked = drawn.groupBy("lang", "hash").agg(F.min("text").alias("text")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= quota).select("lang", "text")
    got = picked.mapInArrow(_sample, "lang string, x binary").toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if not langs:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    x = np.stack([np.frombuffer(v, np.float16) for v in got.column("x").to_pylist()]).astype(np.float32)
    order = np.lexsort((x[:, :64].sum(1), np.array(got.column("lang").to_pylist())))
    y = np.searchsorted(langs, np.array(got.column("lang").to_pylist()))[order]
    x, code = x[order], codewords(len(langs))
    weight = 1.0 / np.bincount(y, minlength=len(langs))[y]  # languages count alike
    weight *= len(y) / weight.sum()
    target = code[y].astype(np.float32)
    root = np.sqrt(weight)[:, None].astype(np.float32)
    mean = (x * root**2).sum(0) / (root**2).sum()
    xc = (x - mean) * root
    middle = (target * root**2).sum(0) / (root**2).sum()
    dual = np.linalg.solve(xc @ xc.T + RIDGE * len(y) * np.eye(len(y), dtype=np.float32), (target - middle) * root)
    weights = (xc.T @ dual).astype(np.float32)
    bias = (middle - mean @ weights).astype(np.float32)
    right = (np.sign(x @ weights + bias) == target).mean(0)
    trust = np.log(np.clip(right, 0.55, 0.999) / (1 - np.clip(right, 0.55, 0.999)))
    return Model(langs, code, weights, bias, (trust / trust.sum()).astype(np.float32) * len(trust))


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predict(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_letter = np.zeros(256, bool)
        ascii_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        for batch in batches:
            texts = batch.column(at)
            n = len(texts)
            best, score, close = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            row = 0
            for block in profiles(texts):
                loss = model.losses(block) if model.langs else np.zeros((len(block), 1))
                first = np.argsort(loss, axis=1, kind="stable")
                low = np.take_along_axis(loss, first[:, :2], 1)
                gap = low[:, 1] - low[:, 0] if loss.shape[1] > 1 else np.full(len(block), 5.0)
                best[row : row + len(block)], score[row : row + len(block)] = first[:, 0], 1 / (1 + np.exp(-gap))
                close[row : row + len(block)] = gap < AMBIGUOUS
                row += len(block)
            names = []
            for i in range(n):
                text = texts[i].as_py()
                known = bool(model.langs) and text is not None and (ascii_letter[np.frombuffer(text[:64], np.uint8)].any() or _has_letter(text))
                names.append(model.langs[best[i]] if known else "und")
                if not known:
                    score[i], close[i] = 0.0, True
            keep = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(names), pa.array(score), pa.array(close)], [*(f for i, f in enumerate(batch.schema.names) if i != at), "lang_pred", "score", "ambiguous"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous), a row for each row."""
    docs = runtime.bounded_batches(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model, 2), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs.where(~held_out())))
