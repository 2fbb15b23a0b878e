"""Codes of vectors: each of four parts is replaced by the nearest of 256 codebook entries.

Components become integers, so sums and distances are exact. Assignment screens
with a float32 matrix product: for a part x and the entries c it gives
|c|^2 - 2 x.c, which differs from the squared distance by |x|^2 only. The
product's rounding error has a rigorous bound in any order of summation,
gamma(k) * (2 |x| max|c| + max|c|^2); every entry whose interval overlaps that of the
least value is evaluated again in int64, and of equal distances the least index wins.
Nothing depends on the order of rows or on partitions.

Every round reads the vectors once and sends (part, entry, count, sums) of each
task, at most 4 * 256 rows of a quarter of the vector's length; the driver gets
their totals, which have the same bound, and makes the next codebooks.

Defined results: a null vector, and one with null or non-finite components, is
dropped; so is one of another length than the vector of the smallest kept id,
since it has no place in the codebooks; that length must be a multiple of four
(an error otherwise). Rows of one id are coded each by itself; the 256 first
vectors are those of the smallest ids, of one id the smaller vectors first, null ids
last. Fewer kept vectors make smaller codebooks; an unused entry stays. A
component of 24 bits or more is computed with Python's integers in place of
int64; an error, or a label's, over 2**63 - 1 stays there. Null labels are one label. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runtime

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of one matrix product, so that its values stay in the processor's cache.
TILE = 512
#: Components below this keep all int64 sums exact in parts of up to 8,000 components, and are float32 numbers.
SMALL = 1 << 24
#: Labels up to this many are sent to all tasks; more are joined by a shuffle.
BROADCAST_LABELS = 100_000
MOST = 2**63 - 1
_U = 2.0**-24


def integers(flat: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite floats; exact, as ``scale`` is a power of two."""
    wide = np.floor(flat.astype(np.float64) * scale)
    if wide.size and np.abs(wide).max() >= SMALL:
        return np.array([int(x) for x in wide], object)
    return wide.astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    return ((x - c) ** 2).sum(axis=1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of integers."""
    if x.dtype == object or book.dtype == object:
        all_of = [((row - book.astype(object)) ** 2).sum(axis=1) for row in x.astype(object)]
        index = np.array([min(range(len(d)), key=lambda j: (d[j], j)) for d in all_of], np.int64)
        return index, np.array([d[j] for d, j in zip(all_of, index)], object)
    k = x.shape[1] + 6  # products and sums of the row and of |c|^2, roundings of the operands, and one spare
    gamma = k * _U / (1 - k * _U)
    squares = (book**2).sum(axis=1)
    left = np.ones((len(x), x.shape[1] + 1), np.float32)
    left[:, :-1] = x
    right = np.vstack([(-2 * book).T, squares[None, :]]).astype(np.float32)
    longest = np.sqrt(float(squares.max(initial=0)))
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    radius = (gamma * (2 * norms * longest + float(squares.max(initial=0)))) * (1 + 1e-9) + 1e-9
    index, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in range(0, len(x), TILE):
        score = left[a : a + TILE] @ right
        best = score.min(axis=1).astype(np.float64)
        limit = np.nextafter((best + 2 * radius[a : a + TILE]).astype(np.float32), np.float32(np.inf))
        row, entry = np.nonzero(score <= limit[:, None])  # ordered by row, then by entry
        exact = distances(x[a + row], book[entry])
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        low = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == low[row])
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        index[a : a + TILE], least[a : a + TILE] = entry[hit], low
    return index, least


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat).reshape(len(column), -1)


def _split(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, v, label) of the rows whose vector is there, full and finite."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    return rows.where(v.isNotNull() & finite)


def _gathered(books: list[np.ndarray]):
    """For each part and entry that a task's vectors use: their number and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, x in enumerate(_split(_matrix(batch.column(0)))):
                index, _ = nearest(x, books[part])
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                if x.dtype == object:
                    sums[part] = sums[part].astype(object)
                sums[part][used] += np.add.reduceat(x[order], first, axis=0)
                counts[part][used] += n
        rows = [(part, j, int(counts[part][j]), [str(s) for s in sums[part][j]]) for part in range(len(books)) for j in np.flatnonzero(counts[part]).tolist()]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "entry", "n", "sums"])

    return run


def first_books(rows: DataFrame) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids; [] without rows."""
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    length = len(first[0].v) if first else 0
    if length % PARTS:
        raise ValueError(f"vectors of {length} components do not divide into {PARTS} parts")
    if not length:
        return []
    table = integers(np.array([r.v for r in first if len(r.v) == length], np.float64).ravel()).reshape(-1, length)
    return _split(table)


def next_books(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the floor of its parts' means; 4 * 256 rows come back at most."""
    each = rows.mapInArrow(_gathered(books), "part int, entry int, n long, sums array<string>")
    width = books[0].shape[1]
    totals = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = [b.astype(object) for b in books]
    for part, entry, n, *sums in each.groupBy("part", "entry").agg(F.sum("n"), *totals).collect():
        out[part][entry] = [int(s) // n for s in sums]
    return [_narrow(b) for b in out]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(x) < SMALL for x in book.ravel()) else book


def trained(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of the codebooks' length, codebooks)."""
    books = first_books(rows)
    rows = rows.where(F.size("v") == sum(b.shape[1] for b in books)) if books else rows.where("false")
    for _ in range(rounds if books else 0):
        books = next_books(rows.select("v"), books)
    return rows, books


def _coded(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [nearest(x, books[part]) for part, x in enumerate(_split(_matrix(batch.column(1))))]
            codes = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            text = codes.tobytes().hex()
            width = 2 * PARTS
            error = sum(d.astype(object) for _, d in found)
            columns = [batch.column(0), batch.column(2), pa.array([text[a : a + width] for a in range(0, len(text), width)], pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    numbers = ",".join(str(int(x)) for book in books for entry in book for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def with_group_sum(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value``, at most ``MOST``, over rows of equal ``key`` (nulls are equal)."""
    total = F.least(F.sum(F.col(value).cast("decimal(19,0)")), F.lit(MOST)).cast("long")
    sums = runtime.cut(rows.groupBy(F.col(key).alias("__key")).agg(total.alias(name)))
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    same: Column = F.col(key).eqNullSafe(F.col("__key"))
    return rows.join(sums, same, "left").drop("__key")


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    rows, books = trained(kept(runtime.bounded_batches(vectors), id_col, vector_col, label_col))
    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.select("vec_id", "v", "label").mapInArrow(_coded(books), f"vec_id long, label {kind}, code string, error long")
    coded = runtime.written(coded, "vector-codes")
    out = with_group_sum(coded, "label", "error", "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Assignments and updates, written out round by round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} as materialized (
  select id, part, x, arg_min(entry, d * 256 + entry) as entry, min(d) as d from (
    select p.id, p.part, p.x, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::bigint as d
    from parts p join book{r} b on p.part = b.part) group by all)""")
        if r < ROUNDS:
            steps.append(f"""mean{r} as materialized (
  select part, entry, list(m order by i) as c from (
    select part, entry, i, floor_div(sum(x[i]), count(*)) as m from near{r}, range(1, (select len(x) + 1 from parts limit 1)) r(i) group by all) group by all),
book{r + 1} as materialized (
  select b.part, b.entry, coalesce(m.c, b.c) as c from book{r} b left join mean{r} m on b.part = m.part and b.entry = m.entry)""")
    middle = ",\n".join(steps).replace("floor_div(sum(x[i]), count(*))", "((sum(x[i]) - (((sum(x[i]) % count(*)) + count(*)) % count(*))) // count(*))::bigint")
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id, embedding) as id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] as x from kept, range({PARTS}) r(part)),
book0 as materialized (select part, id - 1 as entry, x as c from parts where id <= {ENTRIES}),
{middle},
final as (
  select id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from near{ROUNDS} group by id),
digest as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from book{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from final join kept using (id), digest
"""


SQL = _sql()
