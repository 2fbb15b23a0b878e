"""Importance resampling of documents towards a target distribution of n-grams.

Features of a text are its runs of one to three words; each falls into one of
``BUCKETS`` by a CRC. Every task reads its texts in groups of bounded size
through DuckDB: SQL splits the words, unnests them, forms the runs with a
window, and counts buckets by a registered zlib CRC function. The counts, one
row for each document and one of sums for each task, are spilled to Parquet in
the shared folder by Spark's writer (a task's own disk would be lost with it).
Spark merges the sums of documents and of the target to a gain for each bucket
(a table of fixed size), adds the gains of each document, and draws those with
the highest scores, to which a Gumbel term from the id's hash is added.

Ranks come from one range-partitioned sort whose partitions are counted, so no
task sees all rows. A text over ``LONG_TEXT`` characters is read in parts that
carry the next two words, so its runs are all counted once.

Defined results: a null text has no words and the weight 0; rows with repeated
ids are scored each by itself; a null id is hashed as an empty string and comes
last of equal scores; an empty target or an empty table gives the gains that the formula
gives; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
#: A task's DuckDB reads so many characters at a time; a longer text is read in parts.
GROUP_CHARS = LONG_TEXT = 1 << 20
MEMORY = "512MB"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters before letters are made lower-case.
_GAP, _ANY_WORD = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ROWS = "total boolean, doc_id long, n_words long, n_features long, buckets array<short>, counts array<long>"

#: ``texts`` (k, part, ahead): runs begin in ``part``; ``ahead`` are the words after it.
COUNT_SQL = f"""
with split as (
  select k, regexp_extract_all(translate(part, '{_UPPER}', '{_LOWER}'), '{_WORD}') as own,
         regexp_extract_all(translate(ahead, '{_UPPER}', '{_LOWER}'), '{_WORD}') as more
  from texts),
words as (
  select k, len(own) as n, unnest(own || more) as w, generate_subscripts(own || more, 1) as i from split),
runs as (
  select k, i <= n as starts, w as one, w || ' ' || lead(w, 1) over text as two,
         w || ' ' || lead(w, 1) over text || ' ' || lead(w, 2) over text as three
  from words window text as (partition by k order by i)),
features as (select k, unnest([one, two, three]) as f from runs where starts)
select k, bucket_of(f) as bucket, count(*) as n from features where f is not null group by all order by all"""


def _bucket_of(column: pa.Array) -> pa.Array:
    """The zlib CRC of each string's UTF-8 bytes, modulo ``BUCKETS``."""
    strings = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = strings.buffers()
    wide = pa.types.is_large_string(strings.type)
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    text, crc32 = data.to_pybytes() if data else b"", zlib.crc32
    crcs = np.array([crc32(text[a:z]) for a, z in zip(at, at[1:])], np.uint32)
    return pa.array((crcs % BUCKETS).astype(np.int32))


def _parts(text: str) -> Iterator[tuple[str, str]]:
    """(part, the two words after it) of a long text; parts end between words."""
    at = 0
    while len(text) - at > LONG_TEXT and (gap := _GAP.search(text, at + LONG_TEXT)):
        ahead = [m.group() for m in islice(_ANY_WORD.finditer(text, gap.start()), 2)]
        yield text[at : gap.start()], " ".join(ahead)
        at = gap.start()
    yield text[at:], ""


class _Counter:
    """A DuckDB connection of one task."""

    def __init__(self) -> None:
        import duckdb

        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.duck.create_function("bucket_of", _bucket_of, ["VARCHAR"], "INTEGER", type="arrow")

    def count(self, texts: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, bucket, n), ordered, of the texts numbered from 0."""
        part, ahead = zip(*texts)
        self.duck.register("texts", pa.table({"k": pa.array(range(len(texts)), pa.int32()), "part": pa.array(part, pa.string()), "ahead": pa.array(ahead, pa.string())}))
        found = self.duck.sql(COUNT_SQL).fetchnumpy()
        return tuple(np.asarray(found[c]) for c in ("k", "bucket", "n"))


def _batch(total: bool, docs: list, ends: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of documents whose buckets end at ``ends``."""
    ends = np.concatenate([[0], ends]).astype(np.int32)
    sums = np.concatenate([[0], np.cumsum(counts)])
    features = sums[ends[1:]] - sums[ends[:-1]]
    words = np.where(features > 1, (features + 3) // 3, features)  # n words have n + (n - 1) + (n - 2) runs
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v, t)) for v, t in ((buckets.astype(np.int16), pa.int16()), (counts.astype(np.int64), pa.int64()))]
    columns = [pa.array([total] * len(docs)), pa.array(docs, pa.int64()), pa.array(words, pa.int64()), pa.array(features, pa.int64()), *lists]
    return pa.RecordBatch.from_arrays(columns, ["total", "doc_id", "n_words", "n_features", "buckets", "counts"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter, sums = _Counter(), np.zeros(BUCKETS, np.int64)

    def of_group(docs: list, texts: list[tuple[str, str]]) -> pa.RecordBatch:
        k, bucket, n = counter.count(texts)
        np.add.at(sums, bucket, n)
        return _batch(False, docs, np.searchsorted(k, np.arange(len(docs)), "right"), bucket, n)

    for batch in batches:
        docs, texts, chars = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if len(text) > LONG_TEXT:
                own = np.zeros(BUCKETS, np.int64)
                for part in _parts(text):
                    _, bucket, n = counter.count([part])
                    np.add.at(own, bucket, n)
                sums += own
                yield _batch(False, [doc], np.array([np.count_nonzero(own)]), np.flatnonzero(own), own[own > 0])
                continue
            docs.append(doc)
            texts.append((text, ""))
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield of_group(docs, texts)
                docs, texts, chars = [], [], 0
        if docs:
            yield of_group(docs, texts)
    yield _batch(True, [None], np.array([np.count_nonzero(sums)]), np.flatnonzero(sums), sums[sums > 0])


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spilled counts: a row for each document, and one (total) for each task."""
    rows = runtime.bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return runtime.written(rows.mapInArrow(_counted, _ROWS), "bucket-counts", by="total")


def bucket_sums(counts: DataFrame) -> np.ndarray:
    """Features by bucket over all tasks: at most ``BUCKETS`` rows come back."""
    each = counts.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("c"))
    sums = np.zeros(BUCKETS, np.int64)
    for bucket, n in each.groupBy("c.buckets").agg(F.sum("c.counts")).collect():
        sums[bucket] = n
    return sums


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rounded log ratios of the smoothed shares of a bucket in the target and in the documents."""
    up = (target + 1).astype(float) * float(documents.sum() + BUCKETS)
    down = (documents + 1).astype(float) * float(target.sum() + BUCKETS)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = batch.column(3), batch.column(4)
            ends = buckets.offsets.to_numpy()
            flat = gain[buckets.values.to_numpy()] * counts.values.to_numpy()
            sums = np.concatenate([[0], np.cumsum(flat)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return run


def ranked(scored: DataFrame, take: int, *order) -> DataFrame:
    """Adds ``rank``, the place in ``order`` (from 1) where that is at most ``take``."""
    rows = runtime.cut(scored.orderBy(*order)).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    sizes = sorted(rows.groupBy(part.alias("part")).count().collect())  # one row for each partition
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    out = rows.withColumn("__part", part).join(F.broadcast(starts), "__part", "left")
    return out.select(*scored.columns, F.when(place <= take, place).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null where it is not drawn."""
    counts = bucket_counts(docs, id_col, text_col)
    aims = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    gain = gains(bucket_sums(counts), bucket_sums(aims))
    own = runtime.bounded_batches(counts.where("not total")).select("doc_id", "n_words", "n_features", "buckets", "counts")
    weighed = own.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = runtime.written(weighed.withColumn("score", F.col("weight") + noise), "scores")
    enough = F.col("n_words") >= least_words
    take = percent * scored.where(enough).count() // 100
    drawn = ranked(scored.where(enough), take, F.desc("score"), F.asc_nulls_last("doc_id"))
    every = drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank")


#: The CRC goes byte by byte over all distinct features at once.
SQL = r"""
with recursive texts as (
  select doc_id, false as aim, text from documents union all select null, true, text from benchmark),
split as (
  select row_number() over () as k, doc_id, aim,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from texts),
words as (select k, unnest(ws) as w, generate_subscripts(ws, 1) as i from split),
runs as (
  select k, w as one, w || ' ' || lead(w, 1) over text as two, w || ' ' || lead(w, 1) over text || ' ' || lead(w, 2) over text as three
  from words window text as (partition by k order by i)),
features as (
  select k, f, count(*) as n from (select k, unnest([one, two, three]) as f from runs) where f is not null group by all),
steps as (
  select i as v, i as c, 0 as turn from range(256) r(i)
  union all
  select v, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, turn + 1 from steps where turn < 8),
bytes as (select v, c from steps where turn = 8),
names as (select f, hex(encode(f)) as h from (select distinct f from features)),
crcs as (
  select f, h, 0 as p, 4294967295 as crc from names
  union all
  select f, h, p + 1, xor(bytes.c, crc >> 8) from crcs
  join bytes on bytes.v = xor(crc, ('0x' || substr(h, 2 * p + 1, 2))::bigint) & 255 where 2 * p < length(h)),
bucketed as (select f, xor(crc, 4294967295) % 10000 as b from crcs where 2 * p = length(h)),
counted as (select k, b, sum(n) as n from features join bucketed using (f) group by all),
sums as (
  select b, coalesce(sum(n) filter (not aim), 0) as s, coalesce(sum(n) filter (aim), 0) as t
  from counted join split using (k) group by b),
total as (select coalesce(sum(s), 0) as s, coalesce(sum(t), 0) as t from sums),
gains as (
  select b, floor(1000 * ln((sums.t + 1)::double * (total.s + 10000)::double / ((sums.s + 1)::double * (total.t + 10000)::double)))::bigint as gain
  from sums, total),
scored as (
  select doc_id, len(ws) as words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from split left join (select k, sum(n) as n_features, sum(n * gain) as weight from counted join gains using (b) group by k) using (k)
  where not aim),
placed as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from scored where words >= 20)
select doc_id, n_features, weight, score, case when place <= 5 * n // 100 then place end as rank
from scored left join placed using (doc_id)
"""
