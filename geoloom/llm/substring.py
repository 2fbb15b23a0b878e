"""Removal of word windows that other documents hold too (super-k-mers).

A window is ``width`` consecutive words of one document. Every document is
cut into super-k-mers: maximal runs of consecutive windows with the same
minimiser (the least hash of the ``mer``-word runs inside a window). A
super-k-mer travels as one packed string to the bucket of its minimiser.
Equal windows have equal minimisers, so they meet in one bucket, where
sorting finds each window's first document exactly.

Bounds: minimisers fall into ``CELLS`` cells, whose bytes are counted over all
texts first. Light cells share a bucket and heavy ones are divided: their
super-k-mers are cut once more, by the least of another hash of the runs in
each window, so that buckets hold about ``BUCKET_BYTES`` whatever the data is. A
map task holds ``FLUSH_BYTES`` of packed strings. Before the shuffle, each
flush keeps only the first document of equal super-k-mers; later ones are
known to be repeats and send their spans alone, so groups of copies shrink
to one record a flush. A bucket is decoded once and sorted; only one that is
still large (one window in very many flushes) takes several passes over the
windows' hashes, of about ``PASS_WINDOWS`` windows each.

Defined results: a null or empty text has no words and loses none; texts
shorter than a window lose none; of equal windows in one document none is
removed unless a smaller id holds it too; rows with a null or repeated id
are separate rows, and a null id counts as greater than all others, while
rows of one id count as one document; extra columns are kept.

Spans belong to a row: (id, hash of the text), where the hash is 0 for ids that
surely occur once, so that it takes no room in the shuffle.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit
from .textkit import Words, fold, mix, sliding_min, whole

WIDTH, MER = 13, 4
FLUSH_BYTES = 16 << 20
PASS_WINDOWS = 4_000_000
CELLS, BUCKET_BYTES = 4096, 24 << 20
#: Buckets for each shuffle partition at least.
BUCKETS = 6
U = np.uint64
NULL_ID = np.iinfo(np.int64).max
_PACKED = "bucket long, blob binary"
_SPANS = "doc long, row long, lo int, hi int"


def super_kmers(words: Words, hashes: np.ndarray, width: int, mer: int, plan: "Plan | None" = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, bucket) of the super-k-mers of a chunk; without a
    plan the minimiser stands for the bucket."""
    runs = fold(hashes, mer)
    least = sliding_min(runs, width - mer + 1)
    inside = whole(words.counts, width)
    if not inside.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if plan is not None:
        cell = least % U(CELLS)
        shares = plan.shares[cell]
        bucket = plan.first[cell]
        if (shares > 1).any():
            second = sliding_min(mix(runs ^ U(0xA0761D6478BD642F)), width - mer + 1)
            bucket = bucket + (second % shares.astype(np.uint64)).astype(np.int64)
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    if plan is not None:
        new[1:] |= bucket[1:] != bucket[:-1]
        least = bucket
    new[words.first[:-1][words.first[:-1] < len(new)]] = True
    new[1:] |= ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    stop = np.flatnonzero(new | ~inside)  # a run ends at the next start or at a window across rows
    nxt = np.append(stop, len(new))[np.searchsorted(stop, starts, "right")]
    return starts, nxt - starts, least[starts]


class Plan(NamedTuple):
    """Of each cell: its first bucket and the number of buckets it is divided into."""

    first: np.ndarray
    shares: np.ndarray


def plan_of(bytes_of: np.ndarray, parts: int, most: int) -> Plan:
    """Buckets of about ``most`` bytes at most, and about ``BUCKETS * parts`` at least."""
    aim = max(1, min(most, int(bytes_of.sum()) // max(1, BUCKETS * parts)))
    shares = np.maximum(1, -(-bytes_of // aim))
    first, bucket, held = np.zeros(len(bytes_of), np.int64), 0, 0
    for c, size in enumerate(bytes_of.tolist()):
        if held and held + size > aim:
            bucket, held = bucket + 1, 0
        first[c] = bucket
        held += size
        if shares[c] > 1:
            bucket, held = bucket + int(shares[c]), 0
    return Plan(first, shares)


def _weigh(width: int, mer: int):
    """The bytes of a task's super-k-mers in each cell."""

    @runtime.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS)
        for batch in batches:
            for _, data, offsets in textkit.chunks(batch.column(0)):
                words = Words(data, offsets)
                starts, n, least = super_kmers(words, words.hashes(), width, mer)
                if len(starts):
                    size = words.ends[starts + n + width - 2] - words.starts[starts] + 24
                    total += np.bincount((least % U(CELLS)).astype(np.int64), size, CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some].astype(np.int64))], ["cell", "size"])

    return run


def plan(texts: DataFrame, width: int, mer: int) -> Plan:
    """The plan of all texts (one binary column); at most ``CELLS`` rows come to the driver."""
    cells = texts.mapInArrow(_weigh(width, mer), "cell long, size long").groupBy("cell").agg(F.sum("size").alias("size")).collect()
    bytes_of = np.zeros(CELLS, np.int64)
    for row in cells:
        bytes_of[row["cell"]] = row["size"]
    return plan_of(bytes_of, runtime.shuffle_partitions(texts), BUCKET_BYTES)


def _pack(zip_up: zstandard.ZstdCompressor, records: list[tuple[int, int, int, bytes]]) -> bytes:
    head = np.array([len(records)], np.int64).tobytes()
    ids = np.array([r[0] for r in records], np.int64).tobytes()
    tags = np.array([r[1] for r in records], np.int64).tobytes()
    at = np.array([(r[2], len(r[3])) for r in records], np.int32).tobytes()
    return zip_up.compress(head + ids + tags + at + b"".join([r[3] for r in records]))


def _unpack(unzip: zstandard.ZstdDecompressor, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row hashes, first words, offsets, bytes) of a blob's records."""
    raw = unzip.decompress(blob)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    ids = np.frombuffer(raw, np.int64, k, 8)
    tags = np.frombuffer(raw, np.int64, k, 8 + 8 * k)
    at = np.frombuffer(raw, np.int32, 2 * k, 8 + 16 * k).reshape(k, 2)
    offsets = np.zeros(k + 1, np.int64)
    np.cumsum(at[:, 1], out=offsets[1:])
    return ids, tags, at[:, 0], offsets, np.frombuffer(raw, np.uint8, offset=8 + 24 * k)


def _scatter(where_to: Plan, width: int, mer: int):
    """Map side: documents to packed super-k-mers and already known repeats."""

    buckets = int((where_to.first + where_to.shares).max())

    @runtime.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list]] = {}
        known: dict[int, array] = {}
        size = 0
        zip_up = zstandard.ZstdCompressor(level=3)

        def flush() -> pa.RecordBatch:
            keys, blobs = [], []
            for b in list(held):
                group = held.pop(b)  # packed ones make room for the blobs
                keys.append(b)
                blobs.append(_pack(zip_up, [(doc, tag, at, text) for text, (doc, _, where) in group.items() for tag, at in where]))
            for b in list(known):
                keys.append(b)
                blobs.append(zip_up.compress(known.pop(b).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            ids, tags = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for row, data, offsets in textkit.chunks(batch.column(2)):
                words = Words(data, offsets)
                starts, n, bucket = super_kmers(words, words.hashes(), width, mer, where_to)
                if not len(starts):
                    continue
                which = np.searchsorted(words.first, starts, "right") - 1
                docs = ids[row + which].tolist()
                at = zip(tags[row + which].tolist(), (starts - words.first[which]).tolist())
                lo = words.starts[starts].tolist()
                hi = words.ends[starts + n - 1 + width - 1].tolist()
                raw, runs = data.tobytes(), n.tolist()
                for b, doc, pos, a, z, k in zip(bucket.tolist(), docs, at, lo, hi, runs):
                    text = raw[a:z]
                    group = held.get(b)
                    if group is None:
                        group = held[b] = {}
                    first = group.get(text)
                    if first is None:
                        group[text] = (doc, k, [pos])
                        size += len(text) + 200
                        continue
                    size += 100
                    if first[0] == doc:
                        first[2].append(pos)
                    else:
                        if first[0] > doc:
                            group[text] = (doc, k, [pos])
                            late, where = first[0], first[2]
                        else:
                            late, where = doc, [pos]
                        spans = known.setdefault(-1 - late % buckets, array("q"))
                        for tag, x in where:
                            spans.extend((late, tag, x, x + k + width - 1))
                if size > FLUSH_BYTES:
                    yield flush()
                    size = 0
                    runtime.release()
        if held or known:
            yield flush()

    return run


def _repeats(blobs: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, row hashes, first words) of the windows of a bucket that a smaller id holds too."""
    unzip = zstandard.ZstdDecompressor()
    # a word takes about 8 bytes with its space and its share of a record
    total = sum(zstandard.frame_content_size(b) for b in blobs) // 8
    passes = np.uint64(1 + total // PASS_WINDOWS)
    for p in range(int(passes)):
        fps, recs, poss, keys = [], [], [], []
        all_ids, all_tags, base = [], [], 0
        for blob in blobs:
            ids, tags, at, offsets, data = _unpack(unzip, blob)
            all_ids.append(ids.copy())  # views would hold the whole blob
            all_tags.append(tags.copy())
            for row, part, off in textkit.chunks(pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])):
                words = Words(part, off)
                h = words.hashes()
                ok = np.flatnonzero(whole(words.counts, width))
                fp = fold(h, width)[ok]
                if passes > 1:
                    mine = fp % passes == np.uint64(p)
                    ok, fp = ok[mine], fp[mine]
                which = np.searchsorted(words.first, ok, "right") - 1
                fps.append(fp)
                recs.append((base + row + which).astype(np.int32))
                poss.append(at[row + which] + (ok - words.first[which]).astype(np.int32))
                keys.append((h, ok))
            base += len(ids)
        if not fps:
            continue
        fp = np.concatenate(fps)
        order = np.sort(fp)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if not len(twice):
            continue
        slot = np.minimum(np.searchsorted(twice, fp), len(twice) - 1)
        some = twice[slot] == fp
        rows = np.empty((int(some.sum()), width), np.uint64)  # all word hashes of the windows in question
        done = used = 0
        for h, ok in keys:
            mine = ok[some[used : used + len(ok)]]
            rows[done : done + len(mine)] = h[mine[:, None] + np.arange(width)]
            done, used = done + len(mine), used + len(ok)
        fp, rec, pos = fp[some], np.concatenate(recs)[some], np.concatenate(poss)[some]
        doc = np.concatenate(all_ids)[rec]
        order = np.lexsort((doc, fp))
        fp, rec, doc, pos, rows = fp[order], rec[order], doc[order], pos[order], rows[order]
        head = np.ones(len(fp), bool)
        head[1:] = fp[1:] != fp[:-1]
        run = np.cumsum(head) - 1
        first = np.flatnonzero(head)[run]
        same = (rows == rows[first]).all(axis=1)
        bad = (doc > doc[first]) & same
        if not same.all():  # different windows under one hash: group those runs by all their words
            for r in np.unique(run[~same]):
                least: dict[bytes, int] = {}
                members = np.flatnonzero(run == r)
                for i in members:
                    least.setdefault(rows[i].tobytes(), int(doc[i]))
                bad[members] = [doc[i] > least[rows[i].tobytes()] for i in members]
        yield doc[bad], np.concatenate(all_tags)[rec[bad]], pos[bad]


def _gather(width: int):
    """Reduce side: one bucket to the word spans it removes."""

    @runtime.releasing_group
    def run(table: pa.Table) -> pa.Table:
        blobs = [b.as_buffer() for chunk in table.column("blob").chunks for b in chunk]
        out = []
        if table.column("bucket")[0].as_py() < 0:
            unzip = zstandard.ZstdDecompressor()
            out = [np.frombuffer(unzip.decompress(b), np.int64).reshape(-1, 4) for b in blobs]
        else:
            for doc, tag, pos in _repeats(blobs, width):
                order = np.lexsort((pos, tag, doc))
                doc, tag, pos = doc[order], tag[order], pos[order].astype(np.int64)
                head = np.ones(len(doc), bool)
                head[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] > pos[:-1] + width)
                at = np.flatnonzero(head)
                if len(at):
                    last = np.append(at[1:], len(doc)) - 1
                    out.append(np.stack([doc[at], tag[at], pos[at], pos[last] + width], axis=1))
        spans = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
        return pa.table({"doc": spans[:, 0], "row": spans[:, 1], "lo": spans[:, 2].astype(np.int32), "hi": spans[:, 3].astype(np.int32)})

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with __ss_key (the id, or NULL_ID) and __ss_row (0, or a hash of the text where the id may occur again)."""
    key = F.col(id_col).cast("long")
    again = runtime.cut(docs.select(key.alias("__ss_key")).where("__ss_key is not null").groupBy("__ss_key").count().where("count > 1").select("__ss_key"))
    docs = docs.withColumn("__ss_key", F.coalesce(key, F.lit(int(NULL_ID))))
    repeated = F.col("__ss_key") == int(NULL_ID)
    if not again.isEmpty():
        docs, hit = runtime.marked_by_bitmap(docs, "__ss_key", runtime.bitmap(again, "__ss_key"))
        repeated = repeated | hit
    return docs.withColumn("__ss_row", F.when(repeated, F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))).drop("__bm_h", "__bm_word", "__bm_bits")


def repeated_spans(keyed: DataFrame, text_col: str = "text", width: int = WIDTH, mer: int = MER) -> DataFrame:
    """(doc, row, lo, hi): word spans of windows that a document of smaller id holds, of rows from ``_keyed``.

    Spans of a row may overlap; together they cover exactly the words
    to remove.
    """
    texts = keyed.select("__ss_key", "__ss_row", F.col(text_col).cast("binary").alias("text"))
    packed = texts.mapInArrow(_scatter(plan(texts.select("text"), width, mer), width, mer), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_gather(width), _SPANS)


def _cover(spans: list | None, n: int) -> np.ndarray:
    kept = np.zeros(n + 1, np.int64)
    for s in spans or ():
        kept[s["lo"]] += 1
        kept[s["hi"]] -= 1
    return np.cumsum(kept[:-1]) == 0


def _strip(text_at: int):
    """Appends n_words, n_removed and kept_text to rows with gathered spans."""

    @runtime.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_at), batch.column(batch.num_columns - 1)
            n_words, n_removed, kept_text = [], [], []
            for text, span in zip(texts, spans):
                words = (text.as_py() or "").encode().split()
                span = span.as_py()
                if span:
                    keep = _cover(span, len(words))
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                else:
                    kept = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                kept_text.append(b" ".join(kept))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, mer: int = MER) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space).

    Columns of ``docs`` named like an added one are replaced.
    """
    docs = runtime.bounded_batches(docs)
    docs = docs.drop(*[c for c in ("n_words", "n_removed", "kept_text", "__ss_spans", "__ss_key", "__ss_row") if c in docs.columns])
    keyed = _keyed(docs, id_col, text_col)
    spans = runtime.cut(repeated_spans(keyed, text_col, width, mer))
    hit, clean = runtime.split_by_bitmap(keyed, "__ss_key", runtime.bitmap(spans, "doc"))
    lists = spans.groupBy(F.col("doc").alias("__ss_key"), F.col("row").alias("__ss_row")).agg(F.collect_list(F.struct("lo", "hi")).alias("__ss_spans"))
    hit = hit.join(lists, ["__ss_key", "__ss_row"], "left").select(*[F.col(c) for c in hit.columns], "__ss_spans")
    clean = clean.withColumn("__ss_spans", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    both = hit.unionByName(clean).drop("__ss_key", "__ss_row")
    out = both.drop("__ss_spans").withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_text": F.lit("")}).schema
    return both.mapInArrow(_strip(docs.columns.index(text_col)), out)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of the kept text."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> list[tuple[int, int, int, str]]:
    """The same digest by plain dictionaries, for tests."""
    first: dict[tuple, int] = {}
    split = {d: (t or "").encode().split() for d, t in rows}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, w in split.items():
        drop = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                drop.update(range(i, i + width))
        out.append((d, len(w), len(drop), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()))
    return out
