"""Chords of splines against dense evaluations."""

import math
import random

import numpy as np
import pytest

from geoloom.operators import curves

CURVES = "id long, degree int, knots array<double>, points array<struct<x:double,y:double>>, weights array<double>"


def clamped(n, degree):
    inner = n - degree
    return [0.0] * degree + [k / inner for k in range(inner + 1)] + [1.0] * degree


def basis(i, p, u, knots):
    """The B-spline basis by its recursion; the last span holds its end."""
    if p == 0:
        last = max(k for k in range(len(knots) - 1) if knots[k] < knots[k + 1])
        return float(knots[i] <= u < knots[i + 1] or i == last and u == knots[i + 1])
    part = lambda a, b: a / b if b else 0.0
    return part(u - knots[i], knots[i + p] - knots[i]) * basis(i, p - 1, u, knots) + part(knots[i + p + 1] - u, knots[i + p + 1] - knots[i + 1]) * basis(i + 1, p - 1, u, knots)


def dense(degree, knots, points, weights, us):
    w = weights or [1.0] * len(points)
    out = []
    for u in us:
        b = [basis(i, degree, u, knots) * w[i] for i in range(len(points))]
        out.append(np.array([sum(x * p[k] for x, p in zip(b, points)) for k in (0, 1)]) / sum(b))
    return out


def test_chords_follow_the_curves(spark):
    rnd = random.Random(1)
    rows = [(k, d, clamped(n, d), [(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(n)], None if k % 2 else [rnd.uniform(0.3, 3) for _ in range(n)]) for k, (d, n) in enumerate([(1, 2), (1, 6), (2, 3), (2, 7), (3, 4), (3, 9), (5, 8)])]
    h = math.sqrt(0.5)
    rows.append((50, 2, [0, 0, 0, 0.25, 0.25, 0.5, 0.5, 0.75, 0.75, 1, 1, 1], [(5, 0), (5, 5), (0, 5), (-5, 5), (-5, 0), (-5, -5), (0, -5), (5, -5), (5, 0)], [1.0, h, 1.0, h, 1.0, h, 1.0, h, 1.0]))
    rows[-1] = (*rows[-1][:2], [float(v) for v in rows[-1][2]], [(float(x), float(y)) for x, y in rows[-1][3]], rows[-1][4])
    odd = [(60, 3, [0.0, 1.0], [(0.0, 0.0)], None), (61, 2, clamped(4, 2)[::-1], [(0.0, 0.0)] * 4, None), (62, 0, [0.0, 1.0], [(0.0, 0.0)], None), (63, 2, None, None, None)]
    got = {}
    for r in curves.chords(spark.createDataFrame(rows + odd, CURVES), 0.01).collect():
        got.setdefault(r.id, []).append(r)
    assert got.keys() == {r[0] for r in rows}
    for i, d, knots, points, weights in rows:
        own = sorted(got[i], key=lambda r: r.u0)
        assert own[0].u0 == 0 and own[-1].u1 == 1 and all(a.u1 == b.u0 and (a.x1, a.y1) == pytest.approx((b.x0, b.y0), abs=1e-9) for a, b in zip(own, own[1:]))
        for r in own:
            for u, p in zip(us := np.linspace(r.u0, r.u1, 9), dense(d, knots, points, weights, us)):
                a, b = np.array([r.x0, r.y0]), np.array([r.x1, r.y1])
                t = min(1, max(0, float((p - a) @ (b - a)) / (float((b - a) @ (b - a)) or 1)))
                assert np.linalg.norm(p - a - t * (b - a)) <= 0.0125, (i, u)
    assert len(got[0]) == 1 and len(got[1]) == 5
    circle = {r.id: r for r in curves.lengths(curves.chords(spark.createDataFrame(rows[-1:], CURVES), 0.001)).collect()}[50]
    assert circle.length == pytest.approx(10 * math.pi, rel=1e-3)


def test_halvings_end(spark):
    row = [(1, 2, clamped(3, 2), [(0.0, 0.0), (1e6, 1e6), (2e6, 0.0)], None)]
    assert curves.chords(spark.createDataFrame(row, CURVES), 1e-9).count() == 2**curves.HALVINGS
    assert curves.chords(spark.createDataFrame([], CURVES), 1.0).count() == 0


def test_query(spark, sf_dir):
    from geoloom.plans import drawings

    rows = {r.id: r for r in drawings.order_curves(spark, sf_dir).collect()}
    got = {r.id: r for r in drawings.curve_chords(spark, sf_dir).collect()}
    assert got.keys() == rows.keys() and len(got) > 10
    for i in sorted(rows)[:5]:
        r = rows[i]
        us = [min(k / 400 * r.knots[-1], r.knots[-1]) for k in range(401)]
        p = dense(3, r.knots, [(q.x, q.y) for q in r.points], None, us)
        assert got[i].length == pytest.approx(sum(float(np.linalg.norm(b - a)) for a, b in zip(p, p[1:])), rel=2e-2)


def loop(degree, knots, points, weights, tolerance):
    """[(u0, u1)] of the pieces by one recursion for each span."""
    out = []

    def piece(u0, u1, times):
        p = dense(degree, knots, points, weights, [u0, u0 * 0.75 + u1 * 0.25, (u0 + u1) / 2, u0 * 0.25 + u1 * 0.75, u1])
        d = p[4] - p[0]
        t = [min(1, max(0, float((q - p[0]) @ d) / (float(d @ d) or 1))) for q in p]
        if times == curves.HALVINGS or max(float(np.linalg.norm(q - p[0] - x * d)) for q, x in zip(p[1:4], t[1:4])) <= tolerance:
            return out.append((u0, u1))
        piece(u0, (u0 + u1) / 2, times + 1)
        piece((u0 + u1) / 2, u1, times + 1)

    for k in range(degree, len(knots) - degree - 1):
        if knots[k] < knots[k + 1]:
            piece(knots[k], knots[k + 1], 0)
    return out


def test_pieces_equal_a_loop_in_one_job(spark, monkeypatch):
    monkeypatch.setattr(curves, "AT_ONCE", 7)
    rnd = random.Random(8)
    rows = [(f"c{k}", d, clamped(n, d), [(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(n)], w) for k, (d, n, w) in enumerate([(1, 5, None), (2, 9, [2.0]), (3, 12, [1.0, None, 0.5] * 4), (3, 4, None), (4, 9, [])])]
    rows.append(("gap", 3, clamped(9, 3), [None if k == 0 else (rnd.uniform(-9, 9), None if k == 1 else 1.0 * k) for k in range(9)], None))
    spark.sparkContext.setJobGroup("chords", "chords")
    pieces = curves.chords(spark.createDataFrame(rows, CURVES.replace("id long", "id string")).coalesce(1), 0.01).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chords")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2
    got = {}
    for r in pieces:
        got.setdefault(r.id, []).append((r.u0, r.u1))
    assert min(u for u, _ in got.pop("gap")) == pytest.approx(2 / 6)  # spans with an unknown control point have no pieces
    for i, d, knots, points, weights in rows[:-1]:
        w = [1.0 if k >= len(weights) or weights[k] is None else weights[k] for k in range(len(points))] if weights else None
        assert sorted(got[i]) == loop(d, knots, points, w, 0.01), i
