"""Boxes, tiles and printable bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.stats import _normal

Box = tuple[str, str, str, str, str, str]
BOX: Box = ("x0", "x1", "y0", "y1", "z0", "z1")
#: The plate's thickness in millimetres, the most findings of a kind for each
#: body, and the order of severities.
PLATE, MOST_FINDINGS = 0.01, 40
SEVERITIES = ("error", "warning", "info")


def bounds(points: DataFrame, key: str) -> DataFrame:
    """(key, x0 .. z1): the box of each group's points."""
    return points.groupBy(key).agg(*[f(k).alias(f"{k}{s}") for k in "xyz" for s, f in (("0", F.min), ("1", F.max))])


def cube(boxes: DataFrame) -> DataFrame:
    """Boxes widened to cubes about their centres."""
    half = F.greatest(*[F.col(f"{k}1") - F.col(f"{k}0") for k in "xyz"]) * 0.5
    mid = {k: (F.col(f"{k}0") + F.col(f"{k}1")) * 0.5 for k in "xyz"}
    return boxes.withColumns({f"{k}{s}": mid[k] + half * d for k in "xyz" for s, d in (("0", -1), ("1", 1))})


def octants(boxes: DataFrame) -> DataFrame:
    """The eight parts of each box, with ``octant``: bit 0 is the upper half of x, 1 of y, 2 of z."""
    b = boxes.withColumn("octant", F.explode(F.sequence(F.lit(0), F.lit(7))))
    mid = {k: (F.col(f"{k}0") + F.col(f"{k}1")) * 0.5 for k in "xyz"}
    upper = {k: F.col("octant").bitwiseAND(1 << i) != 0 for i, k in enumerate("xyz")}
    low = {f"{k}0": F.when(upper[k], mid[k]).otherwise(F.col(f"{k}0")) for k in "xyz"}
    return b.withColumns(low | {f"{k}1": F.when(upper[k], F.col(f"{k}1")).otherwise(mid[k]) for k in "xyz"})


def ray_span(origin: Sequence[float], direction: Sequence[float]) -> tuple[Column, Column, Column]:
    """(hit, near, far) of a ray through a box (slab test); a zero direction component must
    lie between the slabs."""
    near, far, ok = F.lit(0.0), F.lit(float("inf")), F.lit(True)
    for k, o, d in zip("xyz", origin, direction):
        if d == 0:
            ok = ok & (F.col(f"{k}0") <= o) & (F.col(f"{k}1") >= o)
            continue
        a, b = (F.col(f"{k}0") - o) / d, (F.col(f"{k}1") - o) / d
        near, far = F.greatest(near, F.least(a, b)), F.least(far, F.greatest(a, b))
    return ok & (far >= near), near, far


def distance2(p: Sequence[float]) -> Column:
    """The squared distance of a point to a box, 0 inside."""
    out = F.lit(0.0)
    for k, v in zip("xyz", p):
        d = F.greatest(F.col(f"{k}0") - v, v - F.col(f"{k}1"), F.lit(0.0))
        out = out + d * d
    return out


def section_misses(origin: Sequence[float], normal: Sequence[float], slack: float) -> Column:
    """Whether a plane surely misses a box (x0 .. z1): a filter before the mesh is read."""
    size = sum(v * v for v in normal) ** 0.5
    if not slack > 0 or not size > 0:
        return F.lit(False)
    n = [v / size for v in normal]
    gap = sum((a * ((F.col(f"{k}0") + F.col(f"{k}1")) * 0.5 - o) for k, a, o in zip("xyz", n, origin)), F.lit(0.0))
    reach = sum((abs(a) * (F.col(f"{k}1") - F.col(f"{k}0")) * 0.5 for k, a in zip("xyz", n)), F.lit(0.0))
    return F.abs(gap) > reach + slack


def in_frustum(planes: Sequence[Sequence[float]]) -> Column:
    """Whether a sphere (x, y, z, radius) meets the inner side of all planes (a, b, c, d)."""
    out = F.lit(True)
    for a, b, c, d in planes:
        out = out & (a * F.col("x") + b * F.col("y") + c * F.col("z") + d >= -F.col("radius"))
    return out


def clipped(spheres: Sequence[Sequence[float]], keep_inside: bool = True) -> Column:
    """Whether a sphere (x, y, z, radius) reaches one of the clip spheres (x, y, z, r), or with
    ``keep_inside`` false whether it is not wholly inside of one."""
    hits = F.lit(not keep_inside)
    for x, y, z, r in spheres:
        d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)
        if keep_inside:
            hits = hits | (d2 <= (F.col("radius") + r) * (F.col("radius") + r))
        else:
            hits = hits & ~((F.col("radius") <= r) & (d2 <= (r - F.col("radius")) * (r - F.col("radius"))))
    return hits


def hierarchy_problems(tiles: DataFrame) -> DataFrame:
    """(tile, problem) of tiles (tile, parent, page): repeated tiles, unknown parents, several
    roots or none, and tiles on another page than their parent that are not a page's first."""
    twice = tiles.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1").select("tile", F.lit("repeated").alias("problem"))
    lost = tiles.where("parent is not null").join(tiles.select(F.col("tile").alias("parent")).distinct(), "parent", "left_anti").select("tile", F.lit("no parent").alias("problem"))
    roots = tiles.where("parent is null").select("tile")
    many = roots.agg(F.count("*").alias("n")).where("n > 1")
    roots = roots.crossJoin(F.broadcast(many)).select("tile", F.lit("several roots").alias("problem"))  # one row or none
    pages = tiles.groupBy("page").agg(F.min("tile").alias("first"))
    up = tiles.select(F.col("tile").alias("u"), F.col("page").alias("up_page")).dropDuplicates(["u"])
    split = tiles.join(up, F.col("parent") == F.col("u")).where("page <> up_page").join(pages, "page").where("tile <> first").select("tile", F.lit("page").alias("problem"))
    return twice.unionByName(lost).unionByName(roots).unionByName(split).distinct()


#: The six principal directions that can face the plate.
DOWNS = ((0.0, 0.0, -1.0), (0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, -1.0, 0.0))


def orientations(meshed: DataFrame, degrees: float = 45.0, downs: Sequence[Sequence[float]] = DOWNS) -> DataFrame:
    """(place, overhang2, height, contact2, area2) for each direction of a mesh (ax .. cz) that
    faces the plate; areas are doubled.

    The directions are a literal array: the mesh is read twice, once for the heights and
    once for the areas, and each pass is one partial aggregate.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("place"), *[F.lit(float(v)).alias(f"d{k}") for k, v in zip("xyz", d)]) for i, d in enumerate(downs)])
    n = _normal()
    m = meshed.select(*[f"{p}{k}" for p in "abc" for k in "xyz"], *[c.alias(f"n{k}") for c, k in zip(n, "xyz")], F.explode(rows).alias("d"))
    up = lambda p: -(F.col("d.dx") * F.col(f"{p}x") + F.col("d.dy") * F.col(f"{p}y") + F.col("d.dz") * F.col(f"{p}z"))
    m = m.select(F.col("d.place").alias("place"), *[up(p).alias(f"h{p}") for p in "abcn"], F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")).alias("len"))
    heights = m.groupBy("place").agg(F.min(F.least("ha", "hb", "hc")).alias("low"), F.max(F.greatest("ha", "hb", "hc")).alias("high"))
    m = m.join(F.broadcast(heights), "place").where("len > 0")  # a row for each direction
    slope = F.col("hn") / F.col("len")
    on_plate = F.greatest("ha", "hb", "hc") <= F.col("low") + PLATE
    hangs = F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -slope)))) > degrees + 0.01
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0.0))
    return m.groupBy("place").agg(
        part(~on_plate & hangs).alias("overhang2"), (F.max("high") - F.max("low")).alias("height"), part(on_plate & (slope < -0.999)).alias("contact2"), F.sum("len").alias("area2")
    )


def ranked_orientations(metrics: DataFrame) -> DataFrame:
    """Adds ``rank``: less overhang (in steps of half a percent of the area), then height, more contact, place."""
    step = F.round(F.coalesce(F.try_divide(F.col("overhang2"), F.col("area2") * 0.005), F.lit(0.0)))
    order = Window.orderBy(step, "height", F.desc("contact2"), "place")  # a row for each direction
    return metrics.withColumn("rank", F.row_number().over(order))


def findings(bodies: DataFrame, overhang: DataFrame, volume: Sequence[float] | None, degrees: float = 45.0) -> DataFrame:
    """(body, kind, severity, face, value, place): what a print of bodies would meet, worst first.

    ``bodies`` (body, valid, watertight, x0 .. z1); ``overhang`` (body, face, area, degrees) of
    hanging faces, of which the largest ``MOST_FINDINGS`` of a body are reported.
    """
    side = [F.col(f"{k}1") - F.col(f"{k}0") for k in "xyz"]
    rules = [F.when(~F.col("valid"), _finding("invalid", "error")), F.when(~F.col("watertight"), _finding("not_watertight", "error"))]
    if volume is not None:
        v = [float(x) + 1e-6 for x in volume]
        fits = (side[0] <= v[0]) & (side[1] <= v[1]) & (side[2] <= v[2])
        turned = (side[1] <= v[0]) & (side[0] <= v[1]) & (side[2] <= v[2])
        rules.append(F.when(~fits & turned, _finding("build_volume", "warning")).when(~fits, _finding("build_volume", "error")))
    rules.append(F.when(F.abs("z0") > PLATE, _finding("not_on_plate", "info", F.col("z0"))))
    whole = bodies.select("body", F.explode(F.array_compact(F.array(*rules))).alias("f")).select("body", "f.*", F.lit(None).cast("string").alias("face"))
    largest = Window.partitionBy("body").orderBy(F.desc("area"), "face")
    faces = overhang.where(F.col("degrees") > degrees + 0.01).withColumn("r", F.row_number().over(largest)).where(F.col("r") <= MOST_FINDINGS)
    faces = faces.select("body", F.lit("overhang").alias("kind"), F.lit("warning").alias("severity"), F.col("degrees").alias("value"), F.col("face").cast("string").alias("face"))
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")).cast("int") - 1
    return whole.unionByName(faces).withColumn("place", place)


def _finding(kind: str, severity: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), (F.lit(None).cast("double") if value is None else value).alias("value"))
