"""Spline curves (id, degree, knots, points, weights) as chords within a tolerance.

Tasks take batches of curves. A knot span has its own few knots and control points, so its pieces are
arrays of places: all pieces of many spans are judged at once by where the curve runs at their quarters, and
those that bend too much are halved. Spark deals the curves and sums what becomes of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A knot span is halved so often at most.
HALVINGS = 10
#: So many pieces are judged at once.
AT_ONCE = 16_384


def at(u: np.ndarray, knots: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(x, y) of n curves at k places ``u`` (n, k) each, by de Boor's scheme.

    ``knots`` (n, 2 p) are those around the span and ``points`` (n, p + 1, 3) its control points, times their
    weights, and the weights. Each step blends neighbours of a list that gets shorter by one.
    """
    p = knots.shape[1] // 2
    d = [points[:, j, None, :] for j in range(p + 1)]
    for r in range(1, p + 1):
        for j in range(p - r + 1):
            low, high = knots[:, r + j - 1, None], knots[:, p + j, None]
            width = high - low
            a = np.divide(u - low, width, out=np.zeros_like(u), where=width != 0)[..., None]
            d[j] = (1 - a) * d[j] + a * d[j + 1]
    weight = d[0][..., 2:]
    if (weight == 0).any():
        raise ZeroDivisionError("the weights of a place on a curve sum to zero")
    return np.broadcast_to(d[0][..., :2] / weight, (*u.shape, 2))


def usable() -> Column:
    """Whether knots and control points of a curve fit its degree, and the knots rise."""
    rising = F.forall(F.sequence(F.lit(1), F.size("knots") - 1), lambda i: F.element_at("knots", i) <= F.element_at("knots", i + 1))
    fits = (F.col("degree") >= 1) & (F.size("points") > F.col("degree")) & (F.size("knots") == F.size("points") + F.col("degree") + 1)
    return F.coalesce(F.when(fits, rising), F.lit(False))


def _off(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared distance of points to chords."""
    d, e = b - a, p - a
    along, long = (e * d).sum(-1), (d * d).sum(-1)
    t = np.clip(np.divide(along, long, out=np.zeros_like(along), where=long != 0), 0.0, 1.0)[..., None]
    return ((e - t * d) ** 2).sum(-1)


def _halved(u0: np.ndarray, u1: np.ndarray, knots: np.ndarray, points: np.ndarray, tolerance: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(span, u0, u1, p0, p1) of the pieces that are flat enough; what is bent goes on a stack, so few pieces are held at once."""
    ends = at(np.stack([u0, u1], 1), knots, points)
    waiting = [(0, np.arange(len(u0)), u0, u1, ends[:, 0], ends[:, 1])]
    while waiting:
        times, *rest = waiting.pop()
        if len(rest[0]) > AT_ONCE:
            waiting += [(times, *[x[k : k + AT_ONCE] for x in rest]) for k in range(0, len(rest[0]), AT_ONCE)]
            continue
        span, a, b, p, q = rest
        places = np.stack([a * 0.75 + b * 0.25, (a + b) / 2, a * 0.25 + b * 0.75], 1)
        inner = at(places, knots[span], points[span])
        bend = _off(inner, p[:, None], q[:, None]).max(1)
        flat = (bend <= tolerance * tolerance) | (times == HALVINGS)
        yield span[flat], a[flat], b[flat], p[flat], q[flat]
        if not flat.all():
            span, a, b, p, q, middle, m = (x[~flat] for x in (span, a, b, p, q, places[:, 1], inner[:, 1]))
            waiting.append((times + 1, *[np.concatenate(x) for x in ((span, span), (a, middle), (middle, b), (p, m), (m, q))]))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(place of the first value, number of values, values) of lists; an unknown list is empty."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.cumsum(size) - size, size, column.flatten()


def _numbers(values: pa.Array, unknown: float) -> np.ndarray:
    return values.cast(pa.float64()).fill_null(unknown).to_numpy(zero_copy_only=False)


def _spans(batch: pa.RecordBatch, degree: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, u0, u1, knots, points) of the knot spans of a batch's curves of one degree, some at once.

    Spans with an unknown control point are none; an unknown weight is 1.
    """
    rows = np.flatnonzero(batch.column("degree").to_numpy() == degree)
    (first_k, n_k, k), (first_p, n_p, p), (first_w, n_w, w) = (_flat(batch.column(c)) for c in ("knots", "points", "weights"))
    k, w = _numbers(k, np.nan), _numbers(w, 1.0)
    xy = [p.field(c) for c in "xy"]
    known = np.logical_and.reduce([x.is_valid().to_numpy(zero_copy_only=False) for x in (p, *xy)])
    xy = [_numbers(x, np.nan) for x in xy]
    per = n_k[rows] - 2 * degree - 1
    row = np.repeat(rows, per)
    span = degree + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    for low in range(0, len(row), AT_ONCE):
        r, s = row[low : low + AT_ONCE], span[low : low + AT_ONCE]
        knots = k[first_k[r, None] + s[:, None] + np.arange(1 - degree, degree + 1)]
        own = s[:, None] + np.arange(-degree, 1)
        at_w = np.minimum(first_w[r, None] + own, max(len(w) - 1, 0))
        weight = np.where(own < n_w[r, None], w[at_w] if len(w) else 1.0, 1.0)
        place = first_p[r, None] + own
        points = np.stack([xy[0][place] * weight, xy[1][place] * weight, weight], 2)
        u0, u1 = knots[:, degree - 1], knots[:, degree]
        use = (u0 < u1) & known[place].all(1)
        yield r[use], u0[use], u1[use], knots[use], points[use]


def chords(curves: DataFrame, tolerance: float) -> DataFrame:
    """(id, u0, u1, x0, y0, x1, y1): chords that the curves leave by ``tolerance`` at most at their quarters.

    Pieces are halves of knot spans, halved ``HALVINGS`` times at most. Curves that are not ``usable`` have no rows.
    """
    tolerance = max(tolerance, 1e-9)
    names = ["u0", "u1", "x0", "y0", "x1", "y1"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for degree in np.unique(batch.column("degree").to_numpy()):
                for row, u0, u1, knots, points in _spans(batch, int(degree)):
                    for span, a, b, p, q in _halved(u0, u1, knots, points, tolerance):
                        columns = [a, b, p[:, 0], p[:, 1], q[:, 0], q[:, 1]]
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[span])), *map(pa.array, columns)], ["id", *names])

    out = T.StructType([T.StructField("id", curves.schema["id"].dataType), *[T.StructField(n, T.DoubleType()) for n in names]])
    return curves.where(usable()).select("id", "degree", "knots", "points", "weights").mapInArrow(pieces, out)


def lengths(pieces: DataFrame) -> DataFrame:
    """(id, n, length) of chords."""
    d = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return pieces.groupBy("id").agg(F.count("*").alias("n"), F.sum(d).alias("length"))
