"""What the operators of this subpackage share around Spark: lineage cuts,
written intermediate tables and fixed-size membership bitmaps."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a membership bitmap: 2**22 bits are at most 65,536 rows of 64 bits,
#: whatever the number of members, so its broadcast has a fixed bound (1 MB).
BITMAP_BITS = 22
#: Rows and bytes of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
#: Groups of fewer bytes leave little behind.
RELEASE_BYTES = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where a local session has no such setting (as in tests) one is made; on a
    cluster such a folder would be another one on each machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geoloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable checkpoint files."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` computed once into Parquet in the shared folder and read back, in a folder for
    each value of ``by`` if one is named.

    Unlike a checkpoint it is columnar and compressed, so later readers
    fetch only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bitmap(ids: DataFrame, column: str, bits: int = BITMAP_BITS) -> DataFrame:
    """A one-hash membership bitmap of ``ids[column]`` as rows (word, bits).

    It answers "maybe a member" or "no member", never a wrong "no member".
    The number of rows is bounded by ``2**(bits - 6)``, not by the data.
    """
    return (
        ids.select(F.xxhash64(column).alias("__bm_h"))
        .select(
            F.expr(f"shiftrightunsigned(__bm_h, {64 - bits + 6})").alias("__bm_word"),
            F.expr("shiftleft(1L, cast(__bm_h & 63 as int))").alias("__bm_bit"),
        )
        .groupBy("__bm_word")
        .agg(F.bit_or("__bm_bit").alias("__bm_bits"))
    )


def marked_by_bitmap(df: DataFrame, column: str, marks: DataFrame, bits: int = BITMAP_BITS) -> tuple[DataFrame, Column]:
    """``df`` with columns __bm_*, and whether a row may be a member (false for a null key)."""
    h = F.xxhash64(column)
    tagged = df.withColumn("__bm_h", h).withColumn("__bm_word", F.expr(f"shiftrightunsigned(__bm_h, {64 - bits + 6})"))
    hit = F.coalesce(F.expr("(shiftrightunsigned(__bm_bits, cast(__bm_h & 63 as int)) & 1L) = 1L"), F.lit(False)) & F.col(column).isNotNull()
    return tagged.join(F.broadcast(marks), "__bm_word", "left"), hit


def split_by_bitmap(df: DataFrame, column: str, marks: DataFrame, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows that may be members, rows that surely are not).

    The bitmap is broadcast (its size has a fixed bound), so neither part
    is shuffled. Rows with a null key are in the second part.
    """
    joined, hit = marked_by_bitmap(df, column, marks, bits)
    joined = joined.withColumn("__bm_hit", hit)
    back = [F.col(c) for c in df.columns]
    return joined.where("__bm_hit").select(*back), joined.where("not __bm_hit").select(*back)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches kept small.

    A batch is held by the JVM and by a Python worker at once, so both ends
    stay within a few MB whatever the texts are. Smaller settings are kept.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


@functools.cache
def _malloc_trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library than glibc
        return None


def release() -> None:
    """Gives back to the system what Arrow's and C's allocators keep of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = _malloc_trim()
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory at its end.

    Spark keeps Python workers for later tasks, several for each core where a stage
    needs two at once; what an idle one keeps counts for its executor all the time.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def releasing_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow, after each group but small ones."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        if table.nbytes >= RELEASE_BYTES:
            release()
        return out

    return group


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A hash of a row's id and text: what decides about a row, so that rows of one id are
    told apart."""
    return F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col))


def without_rows(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``rejected`` (__row), with their own columns.

    Texts of rows that surely stay are not shuffled.
    """
    rejected = cut(rejected.select("__row").distinct())
    keyed = docs.withColumn("__row_key", row_key(id_col, text_col))
    maybe, clean = split_by_bitmap(keyed, "__row_key", bitmap(rejected, "__row"))
    return clean.unionByName(maybe.join(rejected, F.col("__row_key") == F.col("__row"), "left_anti")).drop("__row_key")


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
