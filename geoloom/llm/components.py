"""Connected components of an edge table by Spark joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: Edges that a task joins at a time, and of which a file is made.
EDGES = 1 << 17


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least): every node of the edges but the least one of its component, with that one."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    up = np.arange(len(nodes))
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    lower = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[lower], nodes[up[lower]]


@runtime.releasing
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def star() -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined(a, b)], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= EDGES:
            yield star()
            held, rows = [], 0
    if rows:
        yield star()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge (a, b) of longs.

    The component is its least node. A task first makes stars of the edges it
    happens to hold, ``EDGES`` at a time, so that few edges are one star for each
    component. Each round hooks every node's root to
    the least root seen over its edges, then jumps pointers; edges become
    edges between roots, and edges inside one root disappear, so the table
    shrinks quickly. The state of each round is written as Parquet, in files of
    up to ``EDGES`` rows whatever the number of shuffle partitions: its size is
    known and its files are read together, so that a round on few edges is
    a few tasks and broadcast joins. On a local file system each new file starts processes.
    Rows with a null end and loops are ignored; an empty table gives an empty result.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = lambda table: table.mapInArrow(_joined, "a long, b long")
    edges = runtime.written(stars(edges), "components-edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    nodes = 0
    for _ in range(rounds):
        rows = edges.count()
        if not rows:
            return labels
        few = -(-rows // EDGES)
        nodes = nodes or -(-2 * rows // EDGES)
        # hook each root to its least neighbour root (a > b, so this makes a forest)
        parent = runtime.written(edges.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("up")).coalesce(few), "components-parents")
        for _ in range(rounds):  # pointer jumping up to the forest's roots
            top = parent.select(F.col("root").alias("mid"), F.col("up").alias("far"))
            if parent.join(top, F.col("up") == F.col("mid"), "left_semi").isEmpty():
                break
            parent = runtime.written(parent.join(top, F.col("up") == F.col("mid"), "left").select("root", F.coalesce("far", "up").alias("up")).coalesce(few), "components-parents")
        to = parent.select(F.col("root").alias("r"), "up")
        labels = labels.join(to, F.col("component") == F.col("r"), "left").select("node", F.coalesce("up", "component").alias("component"))
        left = edges.join(to, F.col("a") == F.col("r"), "left").select(F.coalesce("up", "a").alias("a"), "b")
        both = left.join(to, F.col("b") == F.col("r"), "left").select("a", F.coalesce("up", "b").alias("b"))
        labels = runtime.written(labels.coalesce(nodes), "components-labels")
        both = both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        edges = runtime.written(stars(both.coalesce(few)), "components-edges")
    raise RuntimeError("components did not settle")
