"""WARC archives through Spark's own file layer, with verified boundaries.

Writing: a record is one row of a text file whose line separator is the
record separator (CRLF CRLF), so Spark's text writer makes valid archives in
any file system it knows, with its commit protocol. A response's block is an
HTTP response with the payload as its body; a revisit names the profile of equal
digests. Record ids are unique; the page ids travel in fields of their own.

Reading takes any WARC/1.1 file: field names in any case, any space around
values, records of any type (those without a page id come out with a null one; a
block that is no HTTP response is the payload itself).

Reading: the archive is read as text whose separator is the magic
``WARC/1.1 CRLF``. That splits large files anywhere, and every row is a
candidate record; magic inside a payload makes false candidates.

1. each file block's task emits its candidates' offsets and, by pointer
   jumping over record-to-successor offsets inside the block, where each
   candidate's chain leaves the block;
2. block lengths give absolute offsets; from every file's start, pointer
   jumping over blocks finds where true chains enter each block;
3. a second pass over the text keeps the records of those chains and adds
   the other candidates' bytes to the payload they were cut from. Pieces of
   a payload that lie in several blocks are joined at the end.

Between the passes only offsets are shuffled, never payloads.

Defined results: a null payload is empty; of records with equal payloads of
at least ``min_bytes`` bytes the one with the largest id is the response and
all others revisit it (rows of one id and payload are all responses); null
ids are written as such and read back, as responses; control characters in a
URL are percent-encoded; a record whose header is damaged (no length, no end) ends its
file's chain and later bytes of that file are not returned; columns other than
the three named ones are not read; an empty table writes and reads nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime

MAGIC, GAP = b"WARC/1.1\r\n", b"\r\n\r\n"
#: Records in one archive file at most.
FILE_RECORDS = 20_000
#: Per-block facts up to this many rows are broadcast.
BROADCAST_ROWS = 100_000
_FACTS = "page_id long, payload_bytes long, payload_digest string"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_LENGTH = re.compile(rb"^Content-Length[ \t]*:[ \t]*(\d+)[ \t]*\r?$", re.M | re.I)
# Fixed values of the format.
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [x.as_py() or b"" for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([payload_digest(b) for b in bodies])], ["page_id", "payload_bytes", "payload_digest"])


def _header(fields: list[tuple[str, object]], body: bytes) -> bytes:
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body


def _records(date: str):
    """Rows (page, url, payload, page that it repeats) to records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                body = html or b""
                fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~ ")), ("WARC-Payload-Digest", f"sha1:{payload_digest(body)}"), ("X-Page-Payload-Length", len(body))]
                if page is not None:
                    fields.append(("X-Page-Id", page))
                block = _HTTP.format(len(body)).encode() + body
                if refers is not None:
                    fields += [("WARC-Profile", _REVISIT), ("X-Page-Refers-To", refers)]
                    block = _HTTP.format(len(body)).encode()
                out.append(_header([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))], block))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """A record for each row, equal payloads once, into text files under ``path``."""
    pages = runtime.bounded_batches(pages)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("body"))
    facts = pages.select("page_id", "body").mapInArrow(_facts, _FACTS).where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    facts = runtime.written(facts, "warc-facts")
    groups = facts.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least")
    again = runtime.cut(facts.join(groups, "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct())
    maybe, plain = runtime.split_by_bitmap(pages, "page_id", runtime.bitmap(again, "page_id"))
    # an id may stand for several payloads: the digest decides too
    marked = maybe.withColumn("hex", F.sha1(F.coalesce("body", F.lit(b"")))).join(again.select(F.col("page_id").alias("id"), F.lower(F.hex(_unbase32())).alias("dig"), "refers_to"), (F.col("page_id") == F.col("id")) & (F.col("hex") == F.col("dig")), "left")
    rows = plain.withColumn("refers_to", F.lit(None).cast("long")).unionByName(marked.select(*plain.columns, "refers_to"))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = rows.select("page_id", "url", "body", "refers_to").mapInArrow(_records(date), "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", GAP.decode()).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "none").text(path)


def _unbase32():
    """The bytes of a 32-character base32 digest column, by column functions."""
    code = "cast(instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(payload_digest, {}, 1)) - 1 as bigint)"
    groups = []
    for g in range(4):  # eight characters are five bytes
        value = " + ".join(f"{code.format(8 * g + k + 1)} * {1 << 5 * (7 - k)}L" for k in range(8))
        groups.append(F.expr(f"lpad(hex({value}), 10, '0')"))
    return F.unhex(F.concat(*groups))


def _parse(head: bytes) -> tuple[int, int] | None:
    """(header bytes after the magic, content length), or None if damaged."""
    end = head.find(GAP)
    found = _LENGTH.search(head, 0, end + 2) if end >= 0 else None
    return (end + 4, int(found[1])) if found else None


def exits(at: np.ndarray, to: np.ndarray, end: int) -> np.ndarray:
    """Where each candidate's chain leaves a block: pointer jumping.

    ``at``: candidates' offsets, ascending; ``to``: successors' offsets. A
    successor inside the block that is no candidate ends the chain (-1).
    """
    to = to.copy()
    slot = np.searchsorted(at, to)
    inside = (to >= 0) & (to < end)
    hit = inside & (slot < len(at)) & (at[np.minimum(slot, len(at) - 1)] == to)
    to[inside & ~hit] = -1
    jump = np.where(hit, slot, np.arange(len(at)))
    while True:
        more = jump[jump]
        if (more == jump).all():
            return to[jump]
        jump = more


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, size, offsets and exits of the candidates, relative to the block)."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            value = value.as_py()
            state = held.setdefault((file, block), [0, [], []])
            if (found := _parse(value)) is not None:
                state[1].append(state[0] - len(MAGIC))
                state[2].append(state[0] + found[0] + found[1] + len(GAP))
            elif value:
                state[1].append(state[0] - len(MAGIC))
                state[2].append(-1)
            state[0] += len(value) + len(MAGIC)
    rows = []
    for (file, block), (size, at, to) in held.items():
        # a record's offset is that of its magic, which ends the row before
        at, to = np.array(at, np.int64), np.array(to, np.int64)
        out = exits(at, to, size - len(MAGIC)) if len(at) else at
        rows.append((file, block, size, at.tolist(), out.tolist()))
    cols = list(zip(*rows)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "block", "size", "at", "to"])


def _rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("value string").option("lineSep", MAGIC.decode()).text(path)
    rows = runtime.bounded_batches(rows)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, base, entry): each block's offset, and where the file's
    true chain enters it (relative; null if a record spans all of it)."""
    blocks = runtime.written(_rows(spark, path).mapInArrow(_blocks, "file string, block long, size long, at array<long>, to array<long>"), "warc-blocks")
    order = Window.partitionBy("file").orderBy("block")
    based = blocks.select("file", "block", "size").withColumn("base", F.sum("size").over(order) - F.col("size"))
    several = not based.where("block > 0").isEmpty()
    starts = based.where("base = 0 and size > 0").select("file", F.lit(0).cast("long").alias("pos"))
    reach = starts
    if several:
        jumps = blocks.join(based.drop("size"), ["file", "block"]).select("file", "base", F.explode(F.arrays_zip("at", "to")).alias("c")).where("c.to >= 0")
        jumps = runtime.cut(jumps.select("file", (F.col("base") + F.col("c.at")).alias("at"), (F.col("base") + F.col("c.to")).alias("to")))
        reach = runtime.cut(starts)
        known = reach.count()
        while True:
            step = reach.join(jumps, (reach["file"] == jumps["file"]) & (reach["pos"] == jumps["at"])).select(reach["file"], F.col("to").alias("pos"))
            reach = runtime.cut(reach.union(step).distinct())
            now = reach.count()
            if now == known:
                break
            known = now
            far = jumps.select(F.col("file").alias("f"), F.col("at").alias("mid"), F.col("to").alias("far"))
            # a jump whose target is no candidate stays as it is
            jumps = runtime.cut(jumps.join(far, (F.col("file") == F.col("f")) & (F.col("to") == F.col("mid")), "left").select("file", "at", F.coalesce("far", "to").alias("to")))
    # a magic may end the block before, so a record belongs to the block of its header
    inside = based.join(reach.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & (F.col("pos") >= F.col("base") - len(MAGIC)) & (F.col("pos") < F.col("base") + F.col("size") - len(MAGIC)), "left")
    return inside.groupBy("file", "block").agg(F.min("base").alias("base"), F.min(F.col("pos") - F.col("base")).alias("entry"))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, record offset, part, last, bytes): true records and the pieces cut from them.

    part 0 holds the header. A piece before the block's entry belongs to the
    record that was open there; its owner is given as null and is filled in
    from the order of offsets.
    """
    state: dict[tuple, list] = {}  # block -> [running offset, expected record, bytes of the open record so far]
    for batch in batches:
        out: list[tuple] = []
        for file, block, base, entry, value in zip(*(c.to_pylist() for c in batch.columns)):
            s = state.setdefault((file, block), [0, entry])
            here = s[0] - len(MAGIC)
            s[0] += len(value) + len(MAGIC)
            if s[1] is not None and here == s[1]:
                found = _parse(value)
                if found is None:
                    s[1] = -(1 << 62)  # damaged: the chain ends
                    continue
                s[1] = here + len(MAGIC) + found[0] + found[1] + len(GAP)
                out.append((file, base + here, True, found[0], found[1], value))
            elif s[1] is None or here < s[1]:
                if base + here >= 0:
                    out.append((file, base + here, False, 0, 0, value))
        cols = list(zip(*out)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "pos", "head", "skip", "length", "value"])


def _fields(head: bytes) -> dict[str, str]:
    """The named fields of a header, names in lower case, continued lines joined."""
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace")).splitlines()
    return {name.strip().lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for skip, length, value in zip(*(c.to_pylist() for c in batch.columns)):
            head = _fields(value[: skip - 4])
            block = value[skip : skip + length]
            if len(block) != length:
                raise ValueError(f"a block of {length} bytes ends after {len(block)}")
            http = head.get("content-type", "").replace(" ", "").lower().startswith("application/http")
            body = block.partition(GAP)[2] if http else block
            page, kind, refers = head.get("x-page-id"), head.get("warc-type", "unknown").lower(), head.get("x-page-refers-to")
            told = head.get("warc-payload-digest", "").removeprefix("sha1:")
            again = kind == "revisit"
            digest = told if again else payload_digest(body)
            if page is not None and digest != told:
                raise ValueError(f"damaged payload of {page}")
            size = int(head.get("x-page-payload-length", 0)) if again else len(body)
            rows.append((None if page is None else int(page), head.get("warc-target-uri"), size, digest, kind, None if refers is None else int(refers), None if again else body))
        cols = list(zip(*rows)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the pieces of records that were cut at magic in their payloads."""
    for batch in batches:
        values = [MAGIC.join(parts) for parts in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], ["skip", "length", "value"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``; a revisit has no payload."""
    known = runtime.cut(entries(spark, path))
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    parts = _rows(spark, path).join(known, ["file", "block"]).select("file", "block", "base", "entry", "value").mapInArrow(_emit, "file string, pos long, head boolean, skip long, length long, value binary")
    fits = F.col("head") & (F.octet_length("value") >= F.col("skip") + F.col("length"))
    whole = parts.where(fits).select("skip", "length", "value")
    # records cut by magic in their payload: few, and joined by the offsets they cover
    torn = parts.where(~fits)
    # (a torn record's pieces follow its header before any other torn record begins)
    before = Window.partitionBy("file").orderBy("pos")
    owner = F.last(F.when(F.col("head"), F.struct(F.col("pos").alias("own"), "skip", "length")), ignorenulls=True).over(before)
    pieces = torn.select("file", "pos", "value", owner.alias("o")).select("file", "pos", "value", "o.*")
    pieces = pieces.where(F.col("pos") < F.col("own") + len(MAGIC) + F.col("skip") + F.col("length"))
    joined = pieces.groupBy("file", "own", "skip", "length").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("p"))
    mended = joined.select("skip", "length", F.col("p.value").alias("parts")).mapInArrow(_mend, "skip long, length long, value binary")
    return whole.unionByName(mended).mapInArrow(_decode, _RECORD)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``pages`` and reads the records back (without the payloads)."""
    spark = pages.sparkSession
    path = path or f"{runtime.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: DuckDB SQL of ``round_trip`` over ``pages`` (base32 from the hex digest).
SQL = r"""
with p as (select page_id, url, coalesce(html, '') as body from pages),
d as (select page_id, url, octet_length(encode(body))::bigint as payload_bytes, sha1(body) as hex from p),
b as (select *, array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8), lambda k:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 10 * g + 1, 10))::bigint >> (35 - 5 * k)) & 31)::int + 1, 1)), '')), '') as payload_digest from d),
m as (select *, max(page_id) over (partition by payload_digest) as top from b)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to, url from m
"""
