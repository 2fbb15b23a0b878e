"""Distances between points and triangles (id, ax .. cz)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import cross, dot
from geoloom.session import cut, stored


CORNERS = {k: [f"{c}{k}" for c in "abc"] for k in "xyz"}
#: A cell of the tree has so many cells below it in each direction; triangles of a finest cell;
#: bounds of squared distances may be off by this share.
BRANCHES, PER_LEAF, SLACK = 4, 16, 1e-6


def _between(p: str, q: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{q}{k}") - F.col(f"{p}{k}") for k in "xyz")


EDGES = ("ab", "bc", "ca")


def with_distance(pairs: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared distance of the point (sx, sy, sz) to the triangle (ax .. cz): to
    its plane above the inside, to the nearest edge elsewhere and for triangles without
    an area. Places on the edges are columns of their own, so that each is found once."""
    places = {}
    for p, q in EDGES:
        w, u = _between(p, "s"), _between(p, q)
        places[f"on_{p}{q}"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(w, u), dot(u, u)), F.lit(0.0))))
    u, v, w = _between("a", "b"), _between("a", "c"), _between("a", "s")
    places |= {f"normal_{k}": c for k, c in zip("xyz", cross(u, v))}
    to_edges = []
    for p, q in EDGES:
        along, edge = _between(p, "s"), _between(p, q)
        d = [along[k] - F.col(f"on_{p}{q}") * edge[k] for k in range(3)]
        to_edges.append(dot(d, d))
    n = [F.col(f"normal_{k}") for k in "xyz"]
    solved = {"area": dot(n, n), "second": dot(cross(w, v), n), "third": dot(cross(u, w), n), "height": dot(w, n)}
    above = (F.col("area") > 0) & (F.col("second") >= 0) & (F.col("third") >= 0) & (F.col("second") + F.col("third") <= F.col("area"))
    d2 = F.when(above, F.try_divide(F.col("height") * F.col("height"), F.col("area"))).otherwise(F.least(*to_edges))
    return pairs.withColumns(places).withColumns(solved).withColumn("d2", d2)


def _span(df: DataFrame, columns: dict[str, list[str]]) -> dict[str, tuple[float, float]]:
    low = {k: reduce(F.least, [F.min(c) for c in cs]) if len(cs) > 1 else F.min(cs[0]) for k, cs in columns.items()}
    high = {k: reduce(F.greatest, [F.max(c) for c in cs]) if len(cs) > 1 else F.max(cs[0]) for k, cs in columns.items()}
    row = df.agg(*[c.alias(f"{k}0") for k, c in low.items()], *[c.alias(f"{k}1") for k, c in high.items()]).first()
    return {k: (row[f"{k}0"], row[f"{k}1"]) for k in columns}


def _sources(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").alias("sid"), *[F.col(k).alias(f"s{k}") for k in "xyz"]).dropna(subset=["sx", "sy", "sz"])


def _known(mesh: DataFrame) -> DataFrame:
    """Triangles with known corners, those with equal corners once, by the smallest id."""
    corners = [c for cs in CORNERS.values() for c in cs]
    return mesh.dropna(subset=corners).groupBy(*corners).agg(F.min("id").alias("id"))


def _far(points: DataFrame, mesh: DataFrame) -> float | None:
    """A length that no distance between the two exceeds; null where one is empty."""
    there, here = _span(mesh, CORNERS), _span(points, {k: [f"s{k}"] for k in "xyz"})
    if there["x"][0] is None or here["x"][0] is None:
        return None
    return sum(max(there[k][1], here[k][1]) - min(there[k][0], here[k][0]) for k in "xyz")


def within(points: DataFrame, mesh: DataFrame, reach: float) -> DataFrame:
    """(sid, tid, d2): the nearest triangle strictly within ``reach`` (ties by id).

    Triangles are dealt to the cells their boxes touch and a point visits the cells around
    its own, so this is one join on cells and one aggregate. Spark takes copies in cells for
    as few as the triangles, so the join is kept from broadcasting them.
    """
    t, s = mesh.withColumnRenamed("id", "tid"), points
    for k in "xyz":
        ends = [F.floor(f(*CORNERS[k]) / reach) for f in (F.least, F.greatest)]
        t = t.withColumn(f"cell_{k}", F.explode(F.sequence(*ends)))
        own = F.floor(F.col(f"s{k}") / reach)
        s = s.withColumn(f"cell_{k}", F.explode(F.sequence(own - 1, own + 1)))
    near = with_distance(s.join(t.hint("merge"), [f"cell_{k}" for k in "xyz"])).groupBy("sid").agg(F.min(F.struct("d2", "tid")).alias("b"))
    return near.select("sid", F.col("b.tid").alias("tid"), F.col("b.d2").alias("d2")).where(F.col("d2") < reach * reach)


def _leaves(mesh: DataFrame, reach: float) -> tuple[DataFrame, int]:
    """(the triangles with the finest cell of the middle of their boxes, the levels above; -1 without triangles).

    The finest cells are at most ``reach`` wide and hold ``PER_LEAF`` triangles where a sheet of them
    is even; of the coarsest there are two in each direction at most.
    """
    ends = {k: (F.min(F.least(*cs)), F.max(F.greatest(*cs))) for k, cs in CORNERS.items()}
    row = mesh.agg(F.count("*").alias("n"), *[c.alias(f"{k}{i}") for k, e in ends.items() for i, c in enumerate(e)]).first()
    if not row["n"]:
        return mesh, -1
    extent = max(row[f"{k}1"] - row[f"{k}0"] for k in CORNERS)
    size = max(min(reach, extent / math.ceil(math.sqrt(row["n"] / PER_LEAF))), extent / 2**20) or reach
    top = max(0, math.ceil(math.log(max(extent / size, 1), BRANCHES)))
    middle = {k: (F.least(*cs) + F.greatest(*cs)) / 2 for k, cs in CORNERS.items()}
    cells = {f"cell_{k}": F.floor((middle[k] - row[f"{k}0"]) / size) for k in CORNERS}
    return mesh.withColumns(cells), top


def _near_cells(pairs: DataFrame) -> DataFrame:
    """Of pairs of a source and the box (low_x .. high_z) of a cell those that may hold its nearest triangle.

    A box is no larger than its triangles, so each of its sides has one that touches it: for each direction
    that triangle is within the nearer side there and the farther ones in the other directions.
    """
    s, low, high = ({k: F.col(f"{name}{k}") for k in "xyz"} for name in ("s", "low_", "high_"))
    out = {k: F.greatest(low[k] - s[k], s[k] - high[k], F.lit(0.0)) for k in "xyz"}
    sides = {k: (F.abs(s[k] - low[k]), F.abs(s[k] - high[k])) for k in "xyz"}
    near, far = [{k: f(*sides[k]) for k in "xyz"} for f in (F.least, F.greatest)]
    square = lambda parts: dot(parts, parts)
    most = F.least(*[square([near[k] if k == own else far[k] for k in "xyz"]) for own in "xyz"])
    p = pairs.withColumns({"least": square(list(out.values())), "most": most})
    p = p.withColumn("bound", F.min("most").over(Window.partitionBy("sid")))
    return p.where(F.col("least") <= F.col("bound") * (1 + SLACK)).select("sid", "sx", "sy", "sz", "cell_x", "cell_y", "cell_z")


def nearest_triangles(points: DataFrame, mesh: DataFrame, reach: float) -> DataFrame:
    """(sid, tid, d2): the triangle of least distance to each point (ties by id), exactly.

    Each triangle lies in one cell of a tree of cells, each cell knows the box of its triangles. From the coarsest
    cells down a point keeps those whose box is not farther than the nearest triangle is at most, so
    that far points, too, meet few triangles. No triangles: no rows; points and triangles with unknown coordinates
    have no distance.
    """
    key = ["cell_x", "cell_y", "cell_z"]
    cells, top = _leaves(stored(_known(mesh), "triangles"), reach)
    s = stored(_sources(points), "points")
    if top < 0:
        return s.select("sid", F.lit(None).cast(mesh.schema["id"].dataType).alias("tid"), F.lit(0.0).alias("d2")).limit(0)
    box = [f(g(*cs)).alias(f"{name}_{k}") for k, cs in CORNERS.items() for name, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))]
    levels = [stored(cells.groupBy(key).agg(*box), "cells")]
    for _ in range(top):
        up = [F.floor(F.col(c) / BRANCHES).alias(c) for c in key]
        levels.append(levels[-1].groupBy(up).agg(*[f(f"{name}_{k}").alias(f"{name}_{k}") for k in "xyz" for name, f in (("low", F.min), ("high", F.max))]))
    left = _near_cells(s.crossJoin(F.broadcast(levels[top])))  # eight rows at most
    for below in levels[:top][::-1]:
        inner = below.withColumns({f"up_{c}": F.floor(F.col(c) / BRANCHES) for c in key})
        left = _near_cells(left.withColumnsRenamed({c: f"up_{c}" for c in key}).join(inner, [f"up_{c}" for c in key]))
    pairs = left.join(cells.withColumnRenamed("id", "tid"), key)
    near = with_distance(pairs).groupBy("sid").agg(F.min(F.struct("d2", "tid")).alias("b"))
    return near.select("sid", F.col("b.tid").alias("tid"), F.col("b.d2").alias("d2"))


def least_distance(a: DataFrame, b: DataFrame, reach: float, growth: float = 2.0) -> DataFrame:
    """(d2, side, id, triangle): the least squared distance between the corners of one mesh and
    the triangles of the other, both ways; ties by side and ids.

    Nearest pairs of two edges are not looked for, so this is an upper bound of the
    distance of the surfaces. The reach grows only until it holds any pair.
    """
    a, b = _known(a).transform(cut), _known(b).transform(cut)
    corner = F.explode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(k) for k in "xyz"]) for c in "abc"]))
    sources = [_sources(m.select("id", corner.alias("p")).select("id", "p.*").groupBy("x", "y", "z").agg(F.min("id").alias("owner")).select(F.struct("owner", "x", "y", "z").alias("id"), "x", "y", "z")).transform(cut) for m in (a, b)]
    far = _far(sources[0], b)
    while True:
        parts = [within(s, m, reach).select("d2", F.lit(side).alias("side"), F.col("sid.owner").alias("id"), F.col("tid").alias("triangle")) for side, (s, m) in enumerate(zip(sources, (b, a)))]
        best = parts[0].unionByName(parts[1]).agg(F.min(F.struct("d2", "side", "id", "triangle")).alias("m")).where("m is not null").select("m.*").transform(cut)
        if far is None or reach > far or not best.isEmpty():
            return best
        reach *= growth
