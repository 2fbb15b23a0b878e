"""Wall thickness against a loop over all triangles."""

import math
from collections import defaultdict

import numpy as np
import pytest

from geoloom.operators import walls
from geoloom.plans import assembly

CORNERS = [f"{c}{k}" for c in "abc" for k in "xyz"]
MESH = "body long, face long, id long, " + ", ".join(f"{c} double" for c in CORNERS)


def box(low, high, inward=False):
    quads = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]
    corner = lambda n: [high[i] if n >> i & 1 else low[i] for i in range(3)]
    out = []
    for f, (p, q, r, s) in enumerate(quads):
        out += [(f, [corner(p), corner(q), corner(r)]), (f, [corner(p), corner(r), corner(s)])]
    return [(f, t[::-1] if inward else t) for f, t in out]


def wedge(angle):
    h = math.tan(math.radians(angle)) * 4
    a, b, c, d, e, f = [0, 0, 0], [4, 0, 0], [4, 0, h], [0, 3, 0], [4, 3, 0], [4, 3, h]
    return [(0, [a, d, e]), (0, [a, e, b]), (1, [a, c, f]), (1, [a, f, d]), (2, [b, e, f]), (2, [b, f, c]), (3, [a, b, c]), (4, [d, f, e])]


def ball(n):
    at = lambda i, j: [math.cos(2 * math.pi * j / n) * math.sin(math.pi * i / n), math.sin(2 * math.pi * j / n) * math.sin(math.pi * i / n), math.cos(math.pi * i / n)]
    return [(None, t) for i in range(n) for j in range(n) for t in ([at(i, j), at(i + 1, j), at(i + 1, j + 1)], [at(i, j), at(i + 1, j + 1), at(i, j + 1)])]


def by_hand(triangles, least, budget):
    """{(triangle, sample): (thickness, wedge)} of one body; triangles (face, corners) in order."""
    t = np.array([c for _, c in triangles], float)
    cross = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    size = np.linalg.norm(cross, axis=1)
    area = size / 2
    if not area.sum():
        return {}
    density, run, count = min(budget / area.sum(), 64), 0.0, []
    for a in area:
        count.append(math.floor(run + a * density + 1e-9) - math.floor(run + 1e-9))
        run += a * density
    faces = defaultdict(list)
    for k, (f, _) in enumerate(triangles):
        if f is not None:
            faces[f].append(k)
    for own in faces.values():
        top = max(own, key=lambda k: (area[k], -k))
        if not any(count[k] for k in own) and area[top] > 0:
            count[top] = 1
    edges = defaultdict(list)
    for k, (f, c) in enumerate(triangles):
        for p, q in ((0, 1), (1, 2), (2, 0)):
            edges[tuple(sorted((tuple(c[p]), tuple(c[q]))))].append(f)
    eps = max(1e-5, np.linalg.norm(t.max((0, 1)) - t.min((0, 1))) * 1e-7)
    place, out = 0, {}
    for k, n in enumerate(count):
        for s in range(n if size[k] else 0):
            u = v = 1 / 3
            if n > 1:
                place += 1
                u, v = (0.5 + place / walls.PLASTIC) % 1, (0.5 + place / walls.PLASTIC**2) % 1
                if u + v > 1:
                    u, v = 1 - u, 1 - v
            normal = cross[k] / size[k]
            o, d = (1 - u - v) * t[k, 0] + u * t[k, 1] + v * t[k, 2] - normal * eps, -normal
            e1, e2, w = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0], o - t[:, 0]
            p, q = np.cross(d, e2), np.cross(w, e1)
            det = (e1 * p).sum(1)
            with np.errstate(all="ignore"):
                x, y, far = (w * p).sum(1) / det, (d * q).sum(1) / det, (e2 * q).sum(1) / det
                ok = (abs(det) >= 1e-18) & (x >= -1e-9) & (x <= 1 + 1e-9) & (y >= -1e-9) & (x + y <= 1 + 1e-9) & (far > eps)
            ok[k] = False
            if not ok.any():
                continue
            far[~ok] = np.inf
            hit = int(far.argmin())
            near = False
            own, other = triangles[k][0], triangles[hit][0]
            if own != other and None not in (own, other):
                for (a, b), fs in edges.items():
                    if {own, other} <= set(fs):
                        a, b = np.array(a), np.array(b)
                        at = min(1, max(0, ((o - a) @ (b - a)) / ((b - a) @ (b - a))))
                        near |= bool(np.linalg.norm(o - a - at * (b - a)) < max(2 * least, 0.5))
            out[k, s] = (far[hit] + eps, near)
    return out


BODIES = {
    1: box([0, 0, 0], [10, 8, 1]),
    2: box([0, 0, 0], [40, 40, 40]) + [(f + 6, t) for f, t in box([1, 1, 1], [39, 39, 38.5], inward=True)],
    3: wedge(20),
    4: wedge(70),
    5: box([0, 0, 0], [3, 3, 3])[:2],
    6: ball(14),
    7: box([0, 0, 0], [900, 2, 2]) + [(f + 6, t) for f, t in box([5, 5, 5], [5.01, 5.02, 5.03])],
    8: [(0, [[0, 0, 0], [1, 0, 0], [2, 0, 0]])],
    9: [(0, [[0, 0, 0], [1, 0, 0], [2, 0, 0]])] + box([-3, -5, 0.25], [1.5, 7, 0.75]),
}


@pytest.mark.parametrize("budget, first", [(150, 4.0), (37, 0.3)])
def test_thickness_equals_a_loop(spark, monkeypatch, budget, first):
    monkeypatch.setattr(walls, "FIRST_CELLS", first)
    rows = [(b, f, 1000 * b + k, *[float(x) for p in t for x in p]) for b, own in BODIES.items() for k, (f, t) in enumerate(own)]
    mesh = spark.createDataFrame([*rows, (1, 5, 1, None, *[0.0] * 8)], MESH).repartition(5)
    samples = walls.thickness(mesh, 0.6, budget).cache()
    got = {(r.body, r.id - 1000 * r.body, r.s): r for r in samples.collect()}
    want = {(b, *k): v for b, own in BODIES.items() for k, v in by_hand(own, 0.6, budget).items()}
    assert got.keys() == want.keys() and len(want) > 200
    for k, (length, near) in want.items():
        assert got[k].thickness == pytest.approx(length, rel=1e-9) and got[k].wedge == near, k
    report = {r.body: r for r in walls.wall_report(samples, 0.6).collect()}
    for b in {b for b, _, _ in want}:
        own = [v for k, v in want.items() if k[0] == b]
        plain = [x for x, near in own if not near]
        assert (report[b].samples, report[b].wedge_samples, report[b].thin) == (len(plain), len(own) - len(plain), sum(x < 0.6 for x in plain))
    assert report[3].wedge_samples > 0 and report[2].min_thickness == pytest.approx(1.0)
    thin = {(r.body, r.face): r for r in walls.thin_faces(samples, 0.6).collect()}
    assert thin[9, 4].min_thickness == pytest.approx(0.5) and thin[9, 4].area <= 4.5 * 12 + 1e-9


def test_nothing(spark):
    none = spark.createDataFrame([], MESH)
    assert walls.thickness(none, 0.5).collect() == []


def test_query_equals_a_loop(spark, sf_dir):
    mesh = defaultdict(list)
    for r in assembly.plates(spark, sf_dir).orderBy("id").collect():
        mesh[r.body].append((r.face, np.array([r[c] for c in CORNERS]).reshape(3, 3).tolist()))
    got = {r.body: r for r in assembly.wall_thickness(spark, sf_dir).collect()}
    assert got.keys() == mesh.keys()
    for b in list(mesh)[:6]:
        own = by_hand(mesh[b], 0.5, 200)
        plain = [x for x, near in own.values() if not near]
        assert (got[b].samples, got[b].wedge_samples, got[b].thin) == (len(plain), len(own) - len(plain), sum(x < 0.5 for x in plain))
        assert got[b].min_thickness == pytest.approx(min(plain))


def test_copies_are_one_ray_and_one_shape(spark, monkeypatch):
    sizes = [[3, 4, 0.4]] * 25 + [[3, 4, 0.7], [5, 4, 0.4]]
    own = [(f + 6 * n, t) for n, high in enumerate(sizes) for f, t in box([0, 0, 0], high)]
    sharp = [(f, [[x / 2 + 100, y / 2, z / 2] for x, y, z in t]) for f, t in wedge(20)]
    own += [(f + 200 + 4 * n, t) for n in range(3) for f, t in sharp]
    rows = [(1, f, k, *[float(x) for p in t for x in p]) for k, (f, t) in enumerate(own)]
    mesh = spark.createDataFrame(rows, MESH).repartition(3)
    counted, real = [], walls.first_hits
    monkeypatch.setattr(walls, "first_hits", lambda left, shapes: counted.append((left.count(), shapes.count())) or real(left, shapes))
    got = {(r.id, r.s): r for r in walls.thickness(mesh, 0.5, 60).collect()}
    want = by_hand(own, 0.5, 60)
    assert got.keys() == want.keys() and len(want) >= 6 * len(sizes)
    assert counted == [(counted[0][0], 40)] and counted[0][0] <= 60 + 40
    for k, (length, near) in want.items():
        assert got[k].thickness == pytest.approx(length, rel=1e-9)
        assert near or not got[k].wedge
    assert 0 < sum(r.wedge for r in got.values()) < len(got)
