"""Best-fit packing of token pieces into sequences (hierarchical residual).

Documents become token ids (a byte-level BPE) followed by one end id. Longer
documents are cut from the end into pieces of ``capacity`` tokens, so that
only the first piece may be shorter. Every partition packs its own pieces
best-fit, largest first, and emits the nearly full bins; bins that stay
underfull are items of the next round, over an eighth of the partitions,
until one partition is left or merging no longer helps. A partition of a
later round has about ``ROUND_ITEMS`` bins at most, so no task grows with
the data. A bin's members are bounded by its capacity.

The ids are those of the ``tokenizers`` library for the same vocabulary file
(tests compare them). They are computed with the ``tiktoken`` form of that
vocabulary, which is several times faster; its pattern gives up on white space
of some hundred thousand characters in a row, and such a text goes to ``tokenizers``.

Defined results: a null text is empty and gives the end id alone; rows with
repeated or null ids are packed each by itself; special-token strings inside
texts are ordinary text with ``encode_special_tokens`` (as in ``tokenizers``)
and become their own id without it, which is the library's default and what
op9 and the pipeline use; extra columns are not read; an empty table packs into
nothing.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

CAPACITY, END_ID = 2048, 0
TOKENIZER = "byte_bpe_50k"
#: A bin with at most this much room is emitted at once.
SLACK = 2
FAN_IN, ROUND_ITEMS = 8, 20_000
_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
_BIN = f"used int, open boolean, members array<{_MEMBER}>"


@functools.cache
def _encoder(name: str, encode_special_tokens: bool):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    special = {}
    if not encode_special_tokens:
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.cache
def _plain_encoder(name: str, encode_special_tokens: bool):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    made.encode_special_tokens = encode_special_tokens
    return made


def token_ids(text: str, name: str = TOKENIZER, encode_special_tokens: bool = True) -> np.ndarray:
    try:
        ids = _encoder(name, encode_special_tokens).encode_to_numpy(text, allowed_special="all", disallowed_special=())
    except ValueError:  # a run of white space too long for the pattern's engine
        ids = np.array(_plain_encoder(name, encode_special_tokens).encode(text, add_special_tokens=False).ids, "<u4")
    return np.append(ids, END_ID).astype("<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(a, min(z, n) - a) for a, z in zip(starts, starts[1:] + [n])]


def _pieces(name: str, capacity: int, encode_special_tokens: bool):
    @runtime.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(text.as_py() or "", name, encode_special_tokens)
                rows += [(doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts(len(ids), capacity))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, capacity: int = CAPACITY, encode_special_tokens: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    docs = runtime.bounded_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(name, capacity, encode_special_tokens), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of indexes) by best fit in the given order.

    Open bins are kept by their room, with one bit for each room that
    occurs, so the tightest bin is found by a shift.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, bins = 0, []
    for i, size in enumerate(sizes):
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                there &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > size:
            rooms[room - size].append(b)
            there |= 1 << (room - size)
    return bins


def _round(capacity: int, slack: int):
    """Packs a partition's bins, as items, into new bins."""

    @runtime.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not tables:
            return
        table = pa.Table.from_batches(tables).combine_chunks()
        if not len(table):
            return
        used = table.column("used").to_numpy()
        members = table.column("members").combine_chunks()
        flat, off = members.flatten(), members.offsets.to_numpy()
        first = off[:-1]
        order = np.lexsort((flat.field("piece").to_numpy(zero_copy_only=False)[first], flat.field("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)[first], -used))
        bins = best_fit(used[order].tolist(), capacity)
        take, lengths, total = [], [0], []
        for b in bins:
            own = order[b]
            for i in own.tolist():
                take.extend(range(off[i], off[i + 1]))
            lengths.append(len(take))
            total.append(int(used[own].sum()))
        out = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat.take(pa.array(take, pa.int64())))
        total = np.array(total)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(total < capacity - slack), out], ["used", "open", "members"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, slack: int = SLACK) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    parts = runtime.bounded_batches(parts)
    parts = runtime.written(parts, "packing-pieces")
    item = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32"))
    bins = parts.select(F.col("length").cast("int").alias("used"), (F.col("length") < capacity).alias("open"), item.alias("members"))
    done = [bins.where("not open")]
    state = runtime.written(bins.where("open").mapInArrow(_round(capacity, slack), _BIN), "packing-bins")
    tasks, left = max(1, state.rdd.getNumPartitions()), state.where("open").count()
    while left and tasks > 1:
        done.append(state.where("not open"))
        tasks = max(-(-tasks // FAN_IN), -(-left // ROUND_ITEMS))
        state = runtime.written(state.where("open").repartition(tasks).mapInArrow(_round(capacity, slack), _BIN), "packing-bins")
        now = state.where("open").count()
        if tasks > 1 and now > 0.98 * left:
            break
        left = now
    done.append(state)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    placed = every.select(F.monotonically_increasing_id().alias("sequence_id"), "members").select("sequence_id", F.posexplode("members").alias("at", "m"), "members")
    return placed.select("m.*", "sequence_id", F.expr("cast(aggregate(slice(members, 1, at), 0L, (s, x) -> s + x.length) as bigint)").alias("offset"))


def packed(docs: DataFrame, encode_special_tokens: bool = True) -> DataFrame:
    return pack(pieces(docs, encode_special_tokens=encode_special_tokens))
