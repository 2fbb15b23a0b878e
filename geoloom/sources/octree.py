"""Octree point clouds: folders of metadata.json, hierarchy.bin and octree.bin.

The metadata name the attributes of a record, which all have one length. The
hierarchy is pages of 22-byte records in breadth-first order (kind, mask of
children, points, offset, length); a proxy record names a further page, whose
first record describes the same node again. The point file holds each node's
records together.

Reading: metadata are rows. Pages are read in rounds, each round all pages that
the last one named, by byte ranges; nodes become ranges of at most ``RANGE_BYTES``
in the order of the file, and every task reads its own ranges. So no file is read whole
by one task and nothing but a few counts comes to the driver. Files are opened
by their URI with pyarrow's file systems (local, hdfs, s3, gs).

Writing: points are dealt to tiles of bounded size, each an octree folder that
one task writes, with the metadata last.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import cut

#: Fixed values of the format: record length, kind of a proxy, sizes of number types.
RECORD, PROXY = struct.Struct("<BBIQQ"), 2
_NUMBERS = {"int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8", "float": "<f4", "double": "<f8"}
_SQL_TYPES = {"i": "long", "u": "long", "f": "double"}
#: Bytes that are read at a time, and bytes of a task.
RANGE_BYTES, TASK_BYTES = 4 << 20, 64 << 20
MAX_ROUNDS = 64
#: Points of a node and of a tile folder, levels of a hierarchy page, deepest level.
NODE_POINTS, TILE_POINTS, PAGE_LEVELS, DEEPEST = 1000, 1_000_000, 4, 20

_META = (
    "version string, name string, points bigint, encoding string, offset array<double>, scale array<double>, hierarchy struct<firstChunkSize:bigint>, "
    "boundingBox struct<min:array<double>,max:array<double>>, attributes array<struct<name:string,size:int,numElements:int,elementSize:int,type:string>>"
)
_NODE = "root string, node string, points long, at long, bytes long, page_at long, page_bytes long"


def _opened(uri: str) -> pa.NativeFile:
    system, path = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def octree_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each octree folder in ``folder`` (or for ``folder`` itself): root and the metadata's fields.

    An unknown version or encoding, and a step of zero or no number, are errors.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metadata.json").text(folder, wholetext=True)
    told = files.select(F.regexp_replace(F.col("_metadata.file_path"), "/metadata.json$", "").alias("root"), F.from_json("value", _META).alias("m")).select("root", "m.*")
    stride = F.aggregate("attributes", F.lit(0), lambda s, a: s + a["size"])
    wrong = (
        F.when(F.col("version").isNull() | ~F.col("version").startswith("2"), F.lit("version"))
        .when(~F.coalesce("encoding", F.lit("DEFAULT")).isin("DEFAULT", "UNCOMPRESSED"), F.lit("encoding"))
        .when(F.exists("scale", lambda s: (s == 0) | F.isnan(s) | (F.abs(s) == float("inf"))), F.lit("scale"))
        .when(F.coalesce(stride, F.lit(0)) <= 0, F.lit("attributes"))
    )
    sound = F.when(wrong.isNull(), stride).otherwise(F.raise_error(F.concat(F.lit("octree metadata: "), wrong, F.lit(" of "), "root")))
    return told.withColumn("stride", sound.cast("long"))


def _page(root: str, node: str, content: bytes, is_root: bool) -> Iterator[tuple]:
    """(root, node, points, at, bytes, page_at, page_bytes) of a page's records; of a proxy only the page."""
    if not content or len(content) % RECORD.size:
        raise ValueError(f"hierarchy page of {node}: {len(content)} bytes")
    names = [node]
    for k, (kind, mask, points, at, size) in enumerate(RECORD.iter_unpack(content)):
        if k >= len(names):
            raise ValueError(f"hierarchy page of {node}: unreachable record")
        if kind == PROXY and (k or is_root):
            yield root, names[k], None, None, None, at, size
            continue
        names.extend(f"{names[k]}{child}" for child in range(8) if mask >> child & 1)
        yield root, names[k], points, at, size, None, None
    if len(names) * RECORD.size > len(content):
        raise ValueError(f"hierarchy page of {node}: it ends before its children")


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for root, node, at, size, first in zip(*(c.to_pylist() for c in batch.columns)):
            with _opened(f"{root}/hierarchy.bin") as file:
                if at + size > file.size():
                    raise ValueError(f"hierarchy page of {node}: out of range")
                rows += _page(root, node, file.read_at(size, at), first)
        columns = list(zip(*rows)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int64()) for k, c in enumerate(columns)], [c.split()[0] for c in _NODE.split(", ")])


def octree_nodes(metadata: DataFrame) -> DataFrame:
    """(root, node, points, at, bytes) of all nodes; a node's name is its parent's and its octant."""
    pages = metadata.select("root", F.lit("r").alias("node"), F.lit(0).cast("long").alias("at"), F.col("hierarchy.firstChunkSize").alias("bytes"), F.lit(True).alias("first"))
    found = None
    for _ in range(MAX_ROUNDS):
        made = cut(pages.mapInArrow(_pages, _NODE))
        nodes = made.where("page_at is null").select("root", "node", "points", "at", "bytes")
        found = nodes if found is None else found.unionByName(nodes)
        proxies = made.where("page_at is not null")
        if proxies.isEmpty():
            return found
        pages = proxies.select("root", "node", F.col("page_at").alias("at"), F.col("page_bytes").alias("bytes"), F.lit(False).alias("first")).repartition("root", "at")
    raise ValueError(f"the hierarchy has not ended after {MAX_ROUNDS} rounds of pages")


def _records(fields: list[tuple[str, int, int, str, int]], stride: int, kinds: list[pa.DataType]):
    """Decodes ranges (root, node, at, bytes, scale, offset) of attributes (name, offset, elements, number, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["root", "node", "x", "y", "z", *(f[0] for f in fields)]
        for batch in batches:
            for root, node, at, size, place, scale, offset in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(f"{root}/octree.bin") as file:
                    content = file.read_at(size, at)
                if len(content) != size:
                    raise ValueError(f"node {node} of {root}: short point file")
                table = np.frombuffer(content, np.uint8).reshape(-1, stride)
                number = lambda start, n, kind: np.ascontiguousarray(table[:, start : start + n]).view(kind)
                grid = number(place, 12, "<i4").astype(float)
                columns = [pa.array(grid[:, k] * scale[k] + offset[k]) for k in range(3)]
                for (_, start, elements, kind, width), told in zip(fields, kinds):
                    own = number(start, elements * width, kind)
                    own = own.astype(np.float64 if pa.types.is_floating(told if elements == 1 else told.value_type) else np.int64)
                    columns.append(pa.array(own[:, 0], told) if elements == 1 else pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, elements), pa.int32()), pa.array(own.ravel(), told.value_type)))
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(grid)), pa.array([node] * len(grid)), *columns], names)

    return run


def octree_points(spark: SparkSession, folder: str, attributes: list[str] | None = None, deepest: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, x, y, z, attributes) of all points of the octrees in ``folder``, or of
    those of them whose name is in ``roots``.

    ``attributes`` are names as the metadata have them; all folders must have the
    same record layout. With ``deepest`` only nodes down to that level are read (a coarser cloud);
    else the points of each root must be as many as its metadata say.
    """
    metadata = octree_metadata(spark, folder)
    if roots is not None:
        metadata = metadata.join(roots.select(F.col("name")).distinct(), "name", "left_semi")
    metadata = cut(metadata)
    layouts = metadata.select("attributes", "stride").distinct().limit(2).collect()
    if not layouts:
        raise ValueError(f"no octree in {folder}")
    if len(layouts) > 1:
        raise ValueError(f"octrees of several record layouts in {folder}")
    starts, stride = {}, layouts[0].stride
    for a in layouts[0].attributes:
        starts[a.name.lower()] = (sum(s[1] for s in starts.values()), a.size, a)
    if starts.get("position", (0, 0))[1] != 12:
        raise ValueError("the position attribute must have 12 bytes")
    fields, kinds, schema = [], [], "root string, node string, x double, y double, z double"
    for name in attributes or []:
        start, _, a = starts[name.lower()]
        kind = _NUMBERS[a.type]
        one = _SQL_TYPES[kind[-2]]
        told = pa.int64() if one == "long" else pa.float64()
        fields.append((name, start, a.numElements, kind, a.elementSize))
        kinds.append(told if a.numElements == 1 else pa.list_(told))
        schema += f", `{name}` {one}" if a.numElements == 1 else f", `{name}` array<{one}>"
    nodes = octree_nodes(metadata)
    odd = nodes.where((F.col("bytes") != F.col("points") * stride) & (F.col("points") > 0)).select("root", "node").limit(1).collect()
    if odd:
        raise ValueError(f"node {odd[0].node} of {odd[0].root}: its bytes are not its points")
    if deepest is None:
        sums = nodes.groupBy("root").agg(F.sum("points").alias("n"))
        odd = metadata.join(sums, "root", "left").where(~F.col("n").eqNullSafe(F.col("points"))).select("root", "points", "n").limit(1).collect()
        if odd:
            raise ValueError(f"{odd[0].root}: the metadata say {odd[0].points} points, its nodes {odd[0].n}")
    else:
        nodes = nodes.where(F.length("node") - 1 <= deepest)
    step = max(1, RANGE_BYTES // stride) * stride
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step))).alias("skip")
    ranges = nodes.where("points > 0").select("root", "node", "at", "bytes", part)
    ranges = ranges.join(metadata.select("root", "scale", "offset"), "root")
    ranges = ranges.select("root", "node", (F.col("at") + F.col("skip")).alias("at"), F.least(F.lit(step), F.col("bytes") - F.col("skip")).alias("bytes"), F.lit(starts["position"][0]), "scale", "offset")
    total = ranges.agg(F.sum("bytes")).first()[0] or 0
    dealt = ranges.repartitionByRange(max(1, -(-total // TASK_BYTES)), "root", "at").sortWithinPartitions("root", "at")
    return dealt.mapInArrow(_records(fields, stride, kinds), schema)


def _tree(key: np.ndarray, capacity: int) -> list[tuple[str, np.ndarray]]:
    """(node, rows) of points with octant digits ``key`` (rows, levels), in breadth-first order.

    A node keeps its first ``capacity`` rows and hands the others to its octants.
    """
    nodes, front = [], [("r", np.arange(len(key)))]
    while front:
        following = []
        for name, rows in front:
            level = len(name) - 1
            keep = len(rows) if level == key.shape[1] else min(capacity, len(rows))
            nodes.append((name, rows[:keep]))
            rest = rows[keep:]
            for octant in np.unique(key[rest, level]).tolist() if len(rest) else []:
                following.append((f"{name}{octant}", rest[key[rest, level] == octant]))
        front = following
    return nodes


def _hierarchy(nodes: list[tuple[str, np.ndarray]], stride: int, levels: int) -> tuple[bytes, int]:
    """(the pages, length of the first); every ``levels`` levels a node with children gets a page of its own."""
    masks = {name: 0 for name, _ in nodes}
    for name in list(masks)[1:]:
        masks[name[:-1]] |= 1 << int(name[-1])
    place, at = {}, 0
    for name, rows in nodes:
        place[name] = (len(rows), at, len(rows) * stride)
        at += len(rows) * stride
    own_page = lambda name: len(name) > 1 and not (len(name) - 1) % levels and masks[name]
    pages: dict[str, list[str]] = {}
    top = {}
    for name, _ in nodes:  # breadth first, so a parent has been placed
        home = "r" if name == "r" else name[:-1] if own_page(name[:-1]) else top[name[:-1]]
        top[name] = home
        pages.setdefault(home, []).append(name)
        if own_page(name):
            pages.setdefault(name, []).append(name)
    start, at = {}, 0
    for page, names in pages.items():
        start[page] = (at, len(names) * RECORD.size)
        at += start[page][1]
    out = bytearray()
    for page, names in pages.items():
        for name in names:
            if name != page and name in pages:
                out += RECORD.pack(PROXY, masks[name], place[name][0], *start[name])
            else:
                out += RECORD.pack(0 if masks[name] else 1, masks[name], *place[name])
    return bytes(out), start["r"][1]


def _put(uri: str, content: bytes) -> None:
    system, path = pafs.FileSystem.from_uri(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(path) as file:
        file.write(content)


def write_octrees(points: DataFrame, folder: str, scale: float, extra: dict[str, str] | None = None, tile_points: int = TILE_POINTS, node_points: int = NODE_POINTS) -> DataFrame:
    """Writes points (x, y, z, extra columns as name -> number type) as octree folders below ``folder``, a URI.

    A tile is a share of a cell of a coarse grid with at most some ``tile_points``
    points; a cell with more, even at one place, has several. Returns (root, points).
    A task that is run again writes a folder of another name; only folders in the
    returned, checkpointed rows are kept in the list, so read those roots.
    """
    extra = extra or {}
    box = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)], F.count("*").alias("n")).first()
    low = [box[f"min_{c}"] for c in "xyz"]
    side = max([box[f"max_{c}"] - box[f"min_{c}"] for c in "xyz"], default=0) or 1.0 if box.n else 1.0
    cells = max(1, int((box.n / tile_points) ** 0.5))
    cell = [F.least(F.floor((F.col(c) - low[k]) / side * cells), F.lit(cells - 1)).alias(f"__{c}") for k, c in enumerate("xyz")] if box.n else [F.lit(0).alias(f"__{c}") for c in "xyz"]
    placed = cut(points.select("x", "y", "z", *extra, *cell)).withColumn("__row", F.monotonically_increasing_id())
    sizes = placed.groupBy("__x", "__y", "__z").agg(F.ceil(F.count("*") / tile_points).alias("__shares"))
    spread = F.pmod(F.xxhash64("__row"), F.col("__shares")).alias("__share")
    dealt = placed.join(sizes, ["__x", "__y", "__z"]).select("*", spread).drop("__shares", "__row")
    kind = np.dtype([("position", "<i4", 3), *[(n, _NUMBERS[t]) for n, t in extra.items()]])

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        xyz = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        grid = np.rint((xyz - low) / scale)
        if len(grid) and np.abs(grid).max() >= 2**31:
            raise ValueError("a coordinate does not fit 32 bits at this step")
        corner, edge = xyz.min(axis=0), (xyz.max(axis=0) - xyz.min(axis=0)).max() or 1.0
        levels = np.minimum((xyz - corner) / edge * 2**DEEPEST, 2**DEEPEST - 1).astype(np.int64)
        digits = [((levels >> (DEEPEST - 1 - d)) & 1) @ np.array([4, 2, 1]) for d in range(DEEPEST)]
        nodes = _tree(np.stack(digits, axis=1).astype(np.uint8), node_points)
        records = np.zeros(len(grid), kind)
        records["position"] = grid
        for name in extra:
            records[name] = table.column(name).to_numpy()
        root = f"{folder}/{'-'.join(str(k.as_py()) for k in key)}-{uuid.uuid4().hex[:12]}"
        pages, first = _hierarchy(nodes, kind.itemsize, PAGE_LEVELS)
        _put(f"{root}/octree.bin", b"".join(records[rows].tobytes() for _, rows in nodes))
        _put(f"{root}/hierarchy.bin", pages)
        names = {"position": ("int32", 3, 4), **{n: (t, 1, np.dtype(_NUMBERS[t]).itemsize) for n, t in extra.items()}}
        attributes = [{"name": n, "size": k * s, "numElements": k, "elementSize": s, "type": t} for n, (t, k, s) in names.items()]
        bounds = {"min": corner.tolist(), "max": (corner + edge).tolist()}
        told = {"version": "2.0", "name": root.rsplit("/", 1)[1], "points": len(grid), "hierarchy": {"firstChunkSize": first, "stepSize": PAGE_LEVELS}, "offset": low, "scale": [scale] * 3, "boundingBox": bounds, "encoding": "UNCOMPRESSED", "attributes": attributes}
        _put(f"{root}/metadata.json", json.dumps(told).encode())
        return pa.table({"name": [told["name"]], "points": pa.array([len(grid)], pa.int64())})

    return cut(dealt.groupBy("__x", "__y", "__z", "__share").applyInArrow(tile, "name string, points long"))
