"""Column builders for vectors, boxes, polygons, transforms and rasters.

All are plain column arithmetic, so they stay in generated code and can be
pushed into scans. Parameters are Python numbers and become literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[float, float, float]
#: Slack of fence boxes and polygon boundaries; scope boxes have none.
FENCE_EPS = 1e-9
UNIT_EPS = 1e-6


def dot(a: Sequence, b: Sequence):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Sequence, b: Sequence) -> tuple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def unit(a: Vec) -> Vec:
    n = math.sqrt(dot(a, a))
    if not n > 0:
        raise ValueError("a direction must not be zero")
    return (a[0] / n, a[1] / n, a[2] / n)


def axes(quaternion: tuple[float, float, float, float]) -> tuple[Vec, Vec, Vec]:
    """The rotated unit axes of a quaternion (x, y, z, w), normalised first."""
    n = math.sqrt(sum(v * v for v in quaternion))
    if not n > 0 or not math.isfinite(n):
        raise ValueError("a rotation must be a finite quaternion")
    x, y, z, w = (v / n for v in quaternion)
    return (
        (1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)),
        (2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)),
        (2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)),
    )


def transform(m: Sequence[float], p: Sequence[Column]) -> tuple[Column, Column, Column]:
    """A column-major 4x4 matrix applied to a point."""
    return tuple(m[k] * p[0] + m[4 + k] * p[1] + m[8 + k] * p[2] + m[12 + k] for k in range(3))


def in_box(p: Sequence[Column], centre: Vec, half: Vec, quaternion=(0.0, 0.0, 0.0, 1.0), slack: float = 0.0) -> Column:
    """Whether a point lies in an oriented box; the boundary is inside."""
    d = [p[k] - centre[k] for k in range(3)]
    return reduce(lambda a, b: a & b, [F.abs(dot(d, a)) <= half[k] + slack for k, a in enumerate(axes(quaternion))])


def in_fence_box(p: Sequence[Column], centre: Vec, half: Vec, quaternion) -> Column:
    if abs(math.sqrt(sum(v * v for v in quaternion)) - 1) > UNIT_EPS:
        raise ValueError("a fence's rotation must be a unit quaternion")
    return in_box(p, centre, half, quaternion, FENCE_EPS)


def plane_basis(polygon: Sequence[Vec]) -> tuple[Vec, Vec, Vec, Vec]:
    """(origin, u, v, normal) of a planar polygon in space."""
    o = polygon[0]
    edges = [tuple(q[k] - o[k] for k in range(3)) for q in polygon[1:]]
    for i, a in enumerate(edges):
        for b in edges[i + 1 :]:
            n = cross(a, b)
            if dot(n, n) > 1e-18:
                u, n = unit(a), unit(n)
                if any(abs(dot(n, e)) > 1e-6 for e in edges):
                    raise ValueError("a fence's polygon must be planar")
                return o, u, cross(n, u), n
    raise ValueError("a fence's polygon needs three corners off one line")


def in_polygon(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd rule over a literal ring; points on the boundary are inside.

    The ring is an array, so the generated code does not grow with it, and the point
    is bound once for all edges.
    """
    edges = [(ax, ay, bx - ax, by - ay) for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]) if (ax, ay) != (bx, by)]
    array = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("ax", "ay", "dx", "dy"), e)]) for e in edges])

    def touches(p: Column, e: Column) -> Column:
        length = F.sqrt(e.dx * e.dx + e.dy * e.dy)
        off = (p.x - e.ax) * e.dy - (p.y - e.ay) * e.dx
        along = (p.x - e.ax) * e.dx + (p.y - e.ay) * e.dy
        return (F.abs(off) <= FENCE_EPS * length) & (along >= -FENCE_EPS * length) & (along <= length * length + FENCE_EPS * length)

    def crossed(p: Column, e: Column) -> Column:
        spans = (p.y >= F.least(e.ay, e.ay + e.dy)) & (p.y < F.greatest(e.ay, e.ay + e.dy))
        return spans & (p.x < (p.y - e.ay) * F.try_divide(e.dx, e.dy) + e.ax)

    def inside(p: Column) -> Column:
        odd = F.size(F.filter(array, lambda e: crossed(p, e))) % 2 == 1
        return odd | F.exists(array, lambda e: touches(p, e))

    return F.exists(F.array(F.struct(x.alias("x"), y.alias("y"))), inside)


def _flat(polygon: Sequence[Vec]):
    o, u, v, n = plane_basis(polygon)
    ring = [(dot([q[k] - o[k] for k in range(3)], u), dot([q[k] - o[k] for k in range(3)], v)) for q in polygon]
    return o, u, v, n, ring


def in_prism(p: Sequence[Column], polygon: Sequence[Vec], direction: Vec) -> Column:
    """Whether a point, moved along ``direction`` either way, meets the polygon."""
    o, u, v, n, ring = _flat(polygon)
    d = unit(direction)
    slope = dot(n, d)
    if abs(slope) < 1e-12:
        return F.lit(False)
    t = -(n[0] * (p[0] - o[0]) + n[1] * (p[1] - o[1]) + n[2] * (p[2] - o[2])) / slope
    q = [p[k] + t * d[k] - o[k] for k in range(3)]
    return in_polygon(dot(q, u), dot(q, v), ring)


def in_frustum(p: Sequence[Column], apex: Vec, polygon: Sequence[Vec]) -> Column:
    """Whether the ray from ``apex`` through a point meets the polygon on its way."""
    o, u, v, n, ring = _flat(polygon)
    high = dot(n, [o[k] - apex[k] for k in range(3)])
    if abs(high) < 1e-12:
        return F.lit(False)
    r = [p[k] - apex[k] for k in range(3)]
    t = F.try_divide(F.lit(high), dot(r, n))
    q = [apex[k] + t * r[k] - o[k] for k in range(3)]
    return F.coalesce((t > 0) & in_polygon(dot(q, u), dot(q, v), ring), F.lit(False))


def similarity_2d(x: Column, y: Column, a: float, b: float, tx: float, ty: float) -> tuple[Column, Column]:
    """Scale and turn by the complex number a + ib, then shift."""
    return a * x - b * y + tx, b * x + a * y + ty


def affine_2d(x: Column, y: Column, m: Sequence[float]) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def euler_zyx(rx: float, ry: float, rz: float) -> list[list[float]]:
    """The rotation about x, then y, then z."""
    (cx, sx), (cy, sy), (cz, sz) = ((math.cos(a), math.sin(a)) for a in (rx, ry, rz))
    return [[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]]


def similarity_3d(p: Sequence[Column], rotation: Sequence[Sequence[float]], scale: float, shift: Vec) -> tuple[Column, ...]:
    return tuple(scale * (rotation[k][0] * p[0] + rotation[k][1] * p[1] + rotation[k][2] * p[2]) + shift[k] for k in range(3))


def compose(outer: Sequence[float], inner: Sequence[float]) -> list[float]:
    """The column-major product outer * inner."""
    return [sum(outer[4 * k + r] * inner[4 * c + k] for k in range(4)) for c in range(4) for r in range(4)]


def inverse(m: Sequence[float]) -> list[float]:
    """The inverse of a column-major affine matrix."""
    import numpy as np

    return np.linalg.inv(np.array(m).reshape(4, 4).T).T.ravel().tolist()


def cascade(p: Sequence[Column], stages: Sequence[tuple], domain: Sequence[float] | None = None, outside: str = "error") -> tuple[Column, Column, Column, Column]:
    """(x, y, z, flag) of a point after ordered stages, folded into one expression.

    Stages: ("identity",), ("height_offset", dz), ("height_plane", a, b, c) adding
    a x + b y + c to z, ("similarity", a, b, tx, ty) in the plane, ("affine", 6 numbers) in the
    plane, ("matrix", 16 numbers) in space. ``domain`` (x0, y0, x1, y1) bounds the input;
    outside of it ``error`` raises at run time, ``flag`` keeps the input, ``skip`` gives nulls.
    """
    x, y, z = p
    for name, *v in stages:
        if any(not math.isfinite(a) for a in v):
            raise ValueError(f"stage {name} has a number that is not finite")
        if name == "height_offset":
            z = z + v[0]
        elif name == "height_plane":
            z = z + (v[0] * x + v[1] * y + v[2])
        elif name == "similarity":
            x, y = similarity_2d(x, y, *v)
        elif name == "affine":
            x, y = affine_2d(x, y, v)
        elif name == "matrix":
            x, y, z = transform(v, (x, y, z))
        elif name != "identity":
            raise ValueError(f"unknown stage {name}")
    if domain is None:
        return x, y, z, F.lit(False)
    x0, y0, x1, y1 = domain
    if not (x0 <= x1 and y0 <= y1):
        raise ValueError("the domain is empty")
    off = ~((p[0] >= x0) & (p[0] <= x1) & (p[1] >= y0) & (p[1] <= y1))
    other = {"error": lambda c: F.raise_error(F.lit("a point is outside the domain")).cast("double"), "flag": lambda c: c, "skip": lambda c: F.lit(None).cast("double")}
    if outside not in other:
        raise ValueError(f"unknown policy {outside}")
    return (*[F.when(off, other[outside](c)).otherwise(n) for c, n in zip(p, (x, y, z))], off)


def arc_points(cx: Column, cy: Column, r: Column, start: Column, sweep: Column, chord_error: float, most: int = 4096) -> Column:
    """An array of (x, y) along an arc from ``start`` over ``sweep`` (radians), both ends included."""
    step = 2 * F.acos(F.greatest(F.lit(-1.0), 1 - F.try_divide(F.lit(chord_error), r)))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.coalesce(F.try_divide(F.abs(sweep), step), F.lit(1.0))).cast("int")))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((cx + r * F.cos(start + sweep * k / n)).alias("x"), (cy + r * F.sin(start + sweep * k / n)).alias("y")))


def natural_key(name: Column) -> Column:
    """A sort key under which numbers inside names count by value and letters without case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), 24, "0")).otherwise(r)), "")


def huber(r: Column, delta: float) -> Column:
    return F.when(r <= delta, F.lit(1.0)).otherwise(F.try_divide(F.lit(delta), r))


def per_mille(num: Column, den: Column) -> Column:
    """floor(1000 num / den) up to 1000; 0 for a zero denominator."""
    return F.when(den == 0, F.lit(0)).otherwise(F.least(F.lit(1000).cast("long"), F.floor(F.try_divide(num * 1000, den)))).cast("long")


def in_range(v: Column, low: float | None, high: float | None) -> Column:
    """Inclusive; a missing bound is open."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return ok


def circle_points(cx: Column, cy: Column, r: Column, chord_error: float, max_step: float, most: int = 4096) -> Column:
    """An array of (x, y) on a circle, fine enough for both limits."""
    by_error = F.pi() / F.acos(F.greatest(F.lit(-1.0), 1 - F.try_divide(F.lit(chord_error), r)))
    by_step = 2 * F.pi() * r / max_step
    n = F.least(F.lit(most), F.greatest(F.lit(8), F.ceil(F.greatest(by_error, by_step)).cast("int")))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((cx + r * F.cos(2 * F.pi() * k / n)).alias("x"), (cy + r * F.sin(2 * F.pi() * k / n)).alias("y")))


def distort(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float) -> tuple[Column, Column]:
    """Radial and tangential lens distortion of normalised coordinates."""
    r2 = x * x + y * y
    f = 1 + k1 * r2 + k2 * r2 * r2
    return x * f + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * f + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def project(p: Sequence[Column], rotation: Sequence[Sequence[float]], centre: Vec, focal: float, principal: tuple[float, float]) -> tuple[Column, Column]:
    """Pinhole pixel of a world point; null at or behind the camera."""
    c = [dot(rotation[k], [p[j] - centre[j] for j in range(3)]) for k in range(3)]
    front = c[2] > 0
    return tuple(F.when(front, focal * F.try_divide(c[k], c[2]) + principal[k]) for k in (0, 1))


def local_scale(a: Sequence[Column], b: Sequence[Column], var: Column, length: Column, sigma: Column) -> tuple[Column, Column]:
    """(scale, sigma) from two points, the variance along their line and a target length."""
    d = F.sqrt(sum(((b[k] - a[k]) * (b[k] - a[k]) for k in range(1, 3)), (b[0] - a[0]) * (b[0] - a[0])))
    s = F.try_divide(length, d)
    return s, F.sqrt(F.try_divide(sigma, d) * F.try_divide(sigma, d) + F.try_divide(s, d) * F.try_divide(s, d) * var)


#: Kinds of geometry, each with its strategy and the warning it always has.
STRATEGIES = {
    "pointSet": ("mapVertices", None),
    "polyline": ("mapVertices", None),
    "mesh": ("mapVertices", None),
    "analyticCurve": ("densifyThenMapVertices", "analyticDensified"),
    "rigidFrame": ("mapFrameWithJacobian", "orientationLinearized"),
    "text": ("mapTextAnchorAndScale", "textScalePolicy"),
    "rasterField": ("warpRasterInverseMap", "rasterWarpRequired"),
    "implicitSolid": ("tessellateThenMap", "implicitRequiresTessellation"),
    "hierarchy": ("rematerializeHierarchy", "hierarchyMustRematerialize"),
    "mixedBundle": ("mapVertices", "mixedRepresentation"),
}
#: Kinds that an exact transform must not approximate.
EXACT_KINDS = ("analyticCurve", "implicitSolid")


def transform_class(kind: Column, linear: Column, densify: Column, strict: Column, joined: Column) -> Column:
    """(support, strategy, warnings) of a kind of geometry under a transform.

    ``linear``: all stages are similarities, affine maps or height shifts; ``densify``:
    circles become polylines, else they keep a best-fit radius; ``strict``: no
    approximation of analytic kinds; ``joined``: warn of gaps at joined boundaries.
    An unknown kind gives null.
    """
    rules = F.create_map(*[x for k, (s, w) in STRATEGIES.items() for x in (F.lit(k), F.struct(F.lit(s).alias("strategy"), F.lit(w).cast("string").alias("warning")))])
    rule = F.element_at(rules, kind)
    round_ = kind.isin("circle", "arc")
    bent = round_ & ~linear
    refused = strict & (kind.isin(*EXACT_KINDS) | (bent & ~densify))
    approximate = bent | rule["warning"].isNotNull()
    strategy = F.when(refused, "reject").when(bent & densify, "densifyThenMapVertices").when(round_, "mapCentreAndBestFitRadius").otherwise(rule["strategy"])
    support = F.when(refused, "unsupported").when(approximate, "supportedWithApproximation").otherwise("fullySupported")
    warnings = F.array_compact(F.array(
        rule["warning"],
        F.when(bent & densify, "analyticDensified"),
        F.when(bent & densify & joined, "connectivityRisk"),
        F.when(bent & ~densify, "circleBestFitApproximation"),
        F.when(refused, "strictExactnessBlocked"),
    ))
    return F.when(round_ | rule.isNotNull(), F.struct(support.alias("support"), strategy.alias("strategy"), warnings.alias("warnings")))
