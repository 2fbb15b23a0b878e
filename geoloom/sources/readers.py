"""Readers of domain files on Spark's own sources (text, csv, json, xml, binary).

Paths go to Spark's readers only, so any file system works.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header names of control-point columns.
ALIASES = {"name": ("name", "id", "point", "punkt"), "east": ("e", "east", "easting", "x"), "north": ("n", "north", "northing", "y"), "height": ("h", "height", "z", "elevation"), "role": ("role", "type")}
_PLY = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def detect_columns(header: list[str]) -> dict[str, str]:
    """Role -> header, ignoring case and surrounding space."""
    low = {h.strip().lower(): h for h in reversed(header)}
    return {role: low[a] for role, names in ALIASES.items() for a in names[::-1] if a in low}


def control_points(spark: SparkSession, path: str, columns: dict[str, str], delimiter: str = ",", decimal: str = ".") -> tuple[DataFrame, DataFrame]:
    """(valid rows, errors (line, problem)) of a delimited file with a header.

    The caller imports nothing if there are errors. A name that occurs before
    (trimmed) is an error of the later row; rows keep their file order.
    """
    raw = spark.read.csv(path, header=True, sep=delimiter, quote='"', escape='"', mode="PERMISSIVE").withColumn("line", F.monotonically_increasing_id())
    number = lambda c: F.try_to_number(F.lit(None).cast("string"), F.lit("9")) if c not in columns else F.expr(f"try_cast(replace(trim(`{columns[c]}`), '{decimal}', '.') as double)")
    rows = raw.select("line", F.trim(F.col(columns["name"])).alias("name"), *[number(c).cast("double").alias(c) for c in ("east", "north", "height")], *[F.lower(F.trim(F.col(columns["role"]))).alias("role") for _ in [0] if "role" in columns])
    rank = F.row_number().over(Window.partitionBy("name").orderBy("line"))
    text = lambda c: F.trim(F.col(columns[c]))
    bad_height = F.lit(False)
    if "height" in columns:
        told = raw.select(F.col("line").alias("l"), (F.coalesce(text("height"), F.lit("")) != "").alias("has_height"))
        rows = rows.join(told, F.col("line") == F.col("l")).drop("l")
        bad_height = F.col("has_height") & F.col("height").isNull()
    problem = F.when(F.coalesce("name", F.lit("")) == "", "name").when(F.col("east").isNull(), "east").when(F.col("north").isNull(), "north").when(bad_height, "height").when(F.col("_k") > 1, "repeated")
    judged = rows.withColumn("_k", rank).withColumn("problem", problem).drop("_k", "has_height")
    return judged.where("problem is null").drop("problem"), judged.where("problem is not null").select("line", "problem")


def preview(valid: DataFrame, errors: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The first valid rows, and one row of counts."""
    counts = valid.agg(F.count("*").alias("n_valid")).join(errors.agg(F.count("*").alias("n_errors")), F.lit(True))
    return valid.orderBy("line").limit(n), counts.withColumn("truncated", F.col("n_valid") > n)


def ply_points(spark: SparkSession, path: str, rows: int = 65_536) -> DataFrame:
    """(file, x, y, z) of the vertices of PLY files (ascii or binary).

    Files are dealt over tasks whole, as binary files; vertices leave the
    task in batches.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(content.as_buffer())
                head_end = bytes(view[: 1 << 16]).index(b"end_header") + 10
                head_end += bytes(view[head_end : head_end + 2]).index(b"\n") + 1
                kind, count, fields, element = "ascii", 0, [], ""
                for w in (x.split() for x in bytes(view[:head_end]).decode("ascii", "replace").splitlines() if x.strip()):
                    if w[0] == "format":
                        kind = w[1]
                    elif w[0] == "element":
                        element = w[1]
                        count = int(w[2]) if element == "vertex" else count
                    elif w[0] == "property" and element == "vertex":
                        fields.append((w[2], _PLY[w[1]]))
                if kind == "ascii":
                    lines = bytes(view[head_end:]).split(b"\n")[:count]
                    at = [[f for f, _ in fields].index(k) for k in "xyz"]
                    table = np.array([[float(line.split()[i]) for i in at] for line in lines]).reshape(-1, 3)
                else:
                    t = np.dtype([(f, ("<" if "little" in kind else ">") + d) for f, d in fields])
                    table = np.frombuffer(view, t, count, head_end)
                    table = np.stack([table[k].astype(float) for k in "xyz"], axis=1)
                for a in range(0, len(table), rows):
                    part = table[a : a + rows]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), *[pa.array(part[:, k].copy()) for k in range(3)]], ["file", "x", "y", "z"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "file string, x double, y double, z double")


def step_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, args) of STEP instances; the separator makes large files splittable.

    A string may hold semicolons (and never a line end), so rows end at a semicolon
    with a line end, and what lies between is split outside strings. A repeated id
    is an error.
    """
    t = spark.read.option("lineSep", ";\n").text(path)
    one = F.explode(F.regexp_extract_all("value", F.lit(r"((?:[^;']|'[^']*')+)"), 1)).alias("value")
    m = lambda k: F.regexp_extract("value", r"(?s)^\s*#(\d+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)\s*$", k)
    r = t.select(one).select(m(1).alias("id"), F.upper(m(2)).alias("type"), m(3).alias("args")).where("id <> ''").withColumn("id", F.col("id").cast("long"))
    twice = r.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"instance #{twice[0]['id']} is repeated")
    return r


def xml_elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of one name, as rows."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def obj_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, x, y, z) of OBJ vertices."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("w"))
    return t.where("w[0] = 'v'").select("file", "line", *[F.expr(f"try_cast(w[{k + 1}] as double)").alias(n) for k, n in enumerate("xyz")])


def obj_faces(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, a, b, c): polygons as fans of triangles, by vertex number."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"\s+").alias("w")).where("w[0] = 'f' and size(w) >= 4")
    n = "cast(split(w[{}], '/')[0] as int)"
    fan = F.explode(F.expr(f"transform(sequence(2, size(w) - 2), k -> struct({n.format(1)} as a, cast(split(w[k], '/')[0] as int) as b, cast(split(w[k + 1], '/')[0] as int) as c))")).alias("t")
    return t.select("file", "line", fan).select("file", "line", "t.*")


def stl_triangles(spark: SparkSession, path: str) -> DataFrame:
    """(file, ax .. cz) of binary STL files."""
    names = [f"{p}{k}" for p in "abc" for k in "xyz"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("s", "<u2")])
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = memoryview(content.as_buffer())
                n = struct.unpack_from("<I", view, 80)[0]
                v = np.frombuffer(view, kind, n, 84)["v"].astype(float)
                for a in range(0, n, 65_536):
                    part = v[a : a + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), *[pa.array(part[:, k].copy()) for k in range(9)]], ["file", *names])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "file string, " + ", ".join(f"{n} double" for n in names))


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha) of image files below a folder; equal contents have one hash."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.where(F.lower("path").rlike(r"\.(jpe?g|tiff?|png|dng)$")).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"))


def capture_poses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t timestamp, lat double, lon double, h double, sigmaH double, sigmaV double, fix string").json(path)


def optical_grid(spark: SparkSession, path: str) -> DataFrame:
    """(col, row, value) of ESRI ASCII grids; the no-data value is null."""
    t = spark.read.text(path, wholetext=True).select(F.split("value", r"\s+(?=[-0-9.])|\n").alias("w"), "value")
    head = lambda k: F.regexp_extract("value", rf"(?i){k}\s+(\S+)", 1).cast("double")
    body = F.split(F.trim(F.regexp_replace("value", r"(?i)^(\s*[a-z_]+\s+\S+\s*\n)+", "")), r"\s+")
    g = t.select(head("ncols").cast("int").alias("w"), head("nodata_value").alias("none"), F.posexplode(body).alias("i", "v"))
    return g.select((F.col("i") % F.col("w")).alias("col"), F.expr("i div w").cast("int").alias("row"), F.when(~F.col("v").cast("double").eqNullSafe(F.col("none")), F.col("v").cast("double")).alias("value"))
