"""Tiled meshes of height grids against loops over cells."""

import random

import numpy as np
import pytest

from geoloom.operators import terrain

SIZE = 8


def grid(w, h, holes, seed=1):
    rnd = random.Random(seed)
    return {(x, y): rnd.randint(-50, 50) / 4 for x in range(w) for y in range(h) if rnd.random() >= holes and not (8 <= x < 16 and y < 8)}


def frame(spark, cells):
    rows = [(x, y, v) for (x, y), v in cells.items()] + [(0, 900, 1.0), (900, 0, 1.0), (9, 1, None), (10, 1, float("nan")), (-1, 2, 5.0)]
    return spark.createDataFrame(rows, "col long, row long, value double").repartition(3)


def meshes(df):
    """{(level, col, row): (row, set of triangles as world corners)}."""
    out = {}
    for r in df.collect():
        p = np.array(r.positions, float).reshape(-1, 3) + np.array(r.origin)
        t = np.array(r["indices"], int).reshape(-1, 3)
        assert len(p) == r.n_vertices and len(t) == r.n_triangles
        out[r.level, r.tile_col, r.tile_row] = (r, {tuple(map(tuple, np.round(p[k], 5))) for k in t})
    return out


def quads(cells, step, east, north):
    at = lambda x, y: (east + (x + 0.5) * step, north - (y + 0.5) * step, cells[x, y])
    for x, y in cells:
        if {(x + 1, y), (x, y + 1), (x + 1, y + 1)} <= cells.keys():
            a, b, c, d = at(x, y), at(x + 1, y), at(x, y + 1), at(x + 1, y + 1)
            yield (x, y), [(a, c, b), (b, c, d)]


@pytest.mark.parametrize("w, h, holes", [(20, 19, 0.1), (8, 8, 0.0), (33, 9, 0.3), (3, 2, 0.0)])
def test_seamless_tiles(spark, w, h, holes):
    cells = grid(w, h, holes)
    got = meshes(terrain.section_tiles(frame(spark, cells), w, h, 2.0, (100.0, 50.0), SIZE))
    want = {(0, x // SIZE, y // SIZE): set() for x, y in cells}
    for (x, y), own in quads(cells, 2.0, 100.0, 50.0):
        want[0, x // SIZE, y // SIZE].update(own)
    assert {k: t for k, (_, t) in got.items()} == want
    for (_, col, row), (r, _) in got.items():
        assert r.n_vertices == (SIZE + (col < (w - 1) // SIZE)) * (SIZE + (row < (h - 1) // SIZE))
        assert (r.min_x, r.max_y, r.max_x - r.min_x) == (100 + 16 * col, 50 - 16 * row, 16)
    for (_, col, row), (r, _) in got.items():  # the seam of two neighbours has the same vertices in both
        other = got.get((0, col + 1, row))
        if other:
            side = lambda m, x: sorted(v for v in map(tuple, np.round(np.array(m.positions, float).reshape(-1, 3) + np.array(m.origin), 5)) if v[0] == x and m.min_y < v[1] < m.max_y)
            x = r.max_x + 1.0
            known = {100 + (c + 0.5) * 2 for c in range(w)} if x < 100 + 2 * w else set()
            mine, theirs = side(r, x), side(other[0], x)
            here = [(c, k) for c, k in cells if (c + 0.5) * 2 + 100 == x]
            assert {v for v in mine if v[2] in [cells[p] for p in here]} <= set(theirs) or x not in known


def ring_mean(cells, x, y, low_x, low_y):
    for r in range(1, terrain.RINGS + 1):
        x0, x1, y0, y1 = max(low_x, x - r), min(low_x + SIZE - 1, x + r), max(low_y, y - r), min(low_y + SIZE - 1, y + r)
        ring = [cells[a, b] for a in range(x0, x1 + 1) for b in range(y0, y1 + 1) if (a in (x0, x1) or b in (y0, y1)) and (a, b) in cells]
        if ring:
            return sum(ring) / len(ring)
    return None


def filled_by_hand(cells, w, h):
    done = dict(cells)
    for col, row in {(x // SIZE, y // SIZE) for x, y in cells}:
        for x in range(col * SIZE, col * SIZE + SIZE):
            for y in range(row * SIZE, row * SIZE + SIZE):
                if (x, y) not in cells:
                    v = ring_mean(cells, x, y, col * SIZE, row * SIZE)
                    if v is not None:
                        done[x, y] = v
    return done


def test_filled_holes(spark):
    cells = {(x, y): v for (x, y), v in grid(19, 17, 0.5).items()}
    done = filled_by_hand(cells, 19, 17)
    got = meshes(terrain.section_tiles(frame(spark, cells), 19, 17, 1.0, (0.0, 0.0), SIZE, interpolate=True))
    want = {(0, x // SIZE, y // SIZE): 0 for x, y in cells}
    for (x, y), own in quads(done, 1.0, 0.0, 0.0):
        want[0, x // SIZE, y // SIZE] += 2
    assert {k: r.n_triangles for k, (r, _) in got.items()} == want
    array = np.full((SIZE, SIZE), np.nan)
    for (x, y), v in cells.items():
        if x < SIZE and y < SIZE:
            array[y, x] = v
    mended = terrain.filled(array)
    for y in range(SIZE):
        for x in range(SIZE):
            assert mended[y, x] == pytest.approx(done[x, y])


@pytest.mark.parametrize("faces, stride", [(1_000_000, 1), (98, 1), (97, 2), (24, 3), (2, 7)])
def test_streamed_tiles(spark, faces, stride):
    cells = grid(30, 12, 0.05)
    occupied = len({(x // SIZE, y // SIZE) for x, y in cells})
    target = faces if faces > 1000 else faces * (occupied + 1)
    assert terrain.sample_stride(faces, SIZE) == stride
    got = meshes(terrain.render_tiles(frame(spark, cells), 30, 12, target, 1.0, (0.0, 0.0), SIZE))
    places = terrain.sample_places(stride, SIZE)
    assert {(k[1], k[2]) for k in got if k[0] == 0} == {(x // SIZE, y // SIZE) for x, y in cells}
    for (level, col, row), (r, tris) in got.items():
        assert r.geometric_error == max(0.001, 2.0**level * stride * 2) and r.parent_level == (2 if level == 0 else None)
        if level:
            assert (col, row) == (0, 0) and level == 2
            continue
        want = 0
        for x0, x1 in zip(places, places[1:]):
            for y0, y1 in zip(places, places[1:]):
                want += 2 * all((col * SIZE + x, row * SIZE + y) in cells for x in (x0, x1) for y in (y0, y1))
        assert len(tris) == want and r.n_vertices == len(places) ** 2
    half = {}
    for (x, y), v in cells.items():
        half.setdefault((x // 2, y // 2), []).append(v)
    quarter = {}
    for (x, y), vs in half.items():
        quarter.setdefault((x // 2, y // 2), []).append(sum(vs) / len(vs))
    means = {k: sum(v) / len(v) for k, v in quarter.items()}
    root = got[2, 0, 0][0]
    assert (root.min_z, root.max_z) == (pytest.approx(min(means.values())), pytest.approx(max(means.values())))


def test_nothing(spark):
    none = spark.createDataFrame([], "col long, row long, value double")
    assert terrain.section_tiles(none, 10, 10, size=SIZE).collect() == [] == terrain.render_tiles(none, 10, 10, 50, size=SIZE).collect()
    with pytest.raises(ValueError, match="two triangles"):
        terrain.render_tiles(none, 10, 10, 1)
