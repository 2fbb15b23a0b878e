"""DXF drawings: what nested blocks draw, by complex numbers, and odd files."""

import cmath
import math
import random

import pytest

from geoloom.sources import dxf


def text(*pairs):
    return "".join(f"{c:>3}\n{v}\n" for c, v in pairs)


def drawing(blocks, model, units=4):
    out = [(0, "SECTION"), (2, "HEADER"), (9, "$ACADVER"), (1, "AC1015"), (9, "$INSUNITS"), (70, units), (0, "ENDSEC"), (0, "SECTION"), (2, "BLOCKS")]
    for name, base, own in blocks:
        out += [(0, "BLOCK"), (2, name), (10, base[0]), (20, base[1]), *own, (0, "ENDBLK"), (8, "x")]
    return text(*out, (0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), *model, (0, "ENDSEC"), (0, "EOF"))


def line(a, b, layer="L"):
    return [(0, "LINE"), (8, layer), (10, a[0]), (20, a[1]), (11, b[0]), (21, b[1])]


def insert(name, x, y, turn=0, sx=1, sy=1, *more):
    return [(0, "INSERT"), (8, "0"), (2, name), (10, x), (20, y), (41, sx), (42, sy), (50, turn), *more]


def entities(spark, path):
    good, problems = dxf.entities(spark, str(path))
    return sorted(good.collect(), key=lambda r: (r.file, r.place)), {r.problem: r.n for r in problems.collect()}


def xy(points):
    return [(p.x, p.y) for p in points]


def close(got, want):
    assert len(got) == len(want)
    for p, q in zip(got, want):
        assert p == pytest.approx(q, abs=1e-9)


def test_kinds(spark, tmp_path):
    model = [
        *line((0, 1), (2, 3)), *[(0, "CIRCLE"), (10, 1), (20, 2), (40, 3)], *[(0, "ARC"), (8, "A"), (10, 1), (20, 2), (40, 3), (50, 30), (51, 90)], *[(0, "POINT"), (10, 7), (20, 8)],
        *[(0, "LWPOLYLINE"), (90, 3), (70, 1), (10, 0), (20, 0), (42, 0.5), (10, 4), (20, 0), (10, 4), (20, 3)],
        *[(0, "POLYLINE"), (66, 1), (70, 0), (0, "VERTEX"), (10, 1), (20, 1), (0, "VERTEX"), (10, 9), (20, 9), (70, 16), (0, "VERTEX"), (10, 2), (20, 5), (42, -1), (0, "SEQEND"), (8, "q")],
        *[(0, "SPLINE"), (70, 8), (71, 2), (40, 0), (40, 0), (40, 0), (40, 1), (40, 1), (40, 1), (41, 1), (41, 2), (41, 1), (10, 0), (20, 0), (30, 0), (10, 1), (20, 2), (30, 0), (10, 3), (20, 0), (30, 0), (11, 5), (21, 6)],
        *[(0, "ELLIPSE"), (10, 1), (20, 1), (11, 4), (21, 0), (40, 0.5), (41, 0), (42, 2)], *[(0, "ARC"), (10, 1), (20, 2), (40, 3), (50, 30), (51, 90), (230, -1)], *[(0, "TEXT"), (1, "no")], *[(0, "CIRCLE"), (40, 0)],
        *[(0, "LINE"), (10, 0), (30, 0), (11, 1), (31, 5)], *[(0, "CIRCLE"), (40, 1), (210, 1), (230, 0)], *[(0, "POLYLINE"), (70, 8), (0, "SEQEND"), (8, "q")], *[(0, "POLYLINE"), (70, 64), (0, "SEQEND"), (8, "q")], *insert("nobody", 0, 0),
        *[(0, "SPLINE"), (10, 0), (20, 0), (30, 0), (10, 1), (20, 2), (30, 9)],
    ]
    (tmp_path / "a.dxf").write_text(drawing([], model).replace("\n", "\r\n"))
    got, problems = entities(spark, tmp_path / "a.dxf")
    assert [r.kind for r in got] == ["line", "circle", "arc", "point", "polyline", "polyline", "spline", "ellipse", "arc"]
    a, c, arc, p, lw, pl, sp, el, below = got
    assert (a.layer, c.layer, xy(a.points)) == ("L", None, [(0, 1), (2, 3)]) and (xy(c.points), c.radius) == ([(1, 2)], 3)
    assert (arc.radius, arc.start, arc.end) == (3, pytest.approx(math.pi / 6), pytest.approx(math.pi / 2)) and xy(p.points) == [(7, 8)]
    assert (xy(lw.points), lw.bulges, lw.closed) == ([(0, 0), (4, 0), (4, 3)], [0.5, 0, 0], True)
    assert (xy(pl.points), pl.bulges, pl.closed) == ([(1, 1), (2, 5)], [0, -1], False)
    assert (xy(sp.points), sp.knots, sp.weights, sp.degree, xy(sp.fit_points), sp.closed) == ([(0, 0), (1, 2), (3, 0)], [0, 0, 0, 1, 1, 1], [1, 2, 1], 2, [(5, 6)], False)
    assert (xy(el.points), el.ratio, el.start, el.end) == ([(1, 1), (4, 0)], 0.5, 0, 2)
    assert xy(below.points) == [(-1, 2)] and cmath.exp(1j * below.start) == pytest.approx(cmath.exp(1j * math.pi / 2)) and cmath.exp(1j * below.end) == pytest.approx(cmath.exp(1j * math.pi * 5 / 6))
    assert problems == {"TEXT": 1, "CIRCLE": 1, "LINE (not in the XY plane)": 1, "CIRCLE (not in the XY plane)": 1, "POLYLINE (3D)": 1, "POLYLINE (polygon mesh / polyface)": 1, "INSERT (missing block)": 1, "SPLINE (not in the XY plane)": 1}
    h = dxf.header(spark, str(tmp_path / "a.dxf")).first()
    assert (h.version, h.units, h.unit_mm) == ("AC1015", 4, 1.0)


def rounded(p):
    return round(p[0], 6) + 0.0, round(p[1], 6) + 0.0


def place(chain, z):
    """The point z of the innermost block under inserts (x, y, turn, sx, sy, base), innermost last."""
    for x, y, turn, sx, sy, base in reversed(chain):
        q = z - complex(*base)
        z = complex(x, y) + cmath.exp(1j * math.radians(turn)) * complex(q.real * sx, q.imag * sy)
    return z.real, z.imag


@pytest.mark.parametrize("split", ["2k", "64m"])
def test_blocks_in_blocks(spark, tmp_path, split):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rnd = random.Random(2)
    bases = {"a": (1, 2), "b": (0, 0), "c": (-3, 1)}
    arc = [(0, "ARC"), (8, "A"), (10, 1), (20, 0), (40, 2), (50, 10), (51, 80)]
    blocks = [("a", bases["a"], [*line((1, 0), (2, 5), "deep"), *arc]), ("b", bases["b"], [*insert("a", 3, 4, 90), *insert("a", 0, 1, 45, 2, 2), *line((0, 0), (1, 1))]), ("c", bases["c"], [*insert("b", 5, 5, 30, -1, 1), (0, "CIRCLE"), (10, 0), (20, 0), (40, 1)])]
    tops = [(rnd.choice("abc"), rnd.randint(-9, 9), rnd.randint(-9, 9), rnd.choice([0, 15, 90, 200]), s := rnd.choice([1, 2, 0.5]), rnd.choice([s, -s])) for _ in range(60)] + [("c", 0, 0, 10, 1, 3)]
    model = [p for t in tops for p in insert(*t)]
    inner = {"a": [], "b": [("a", 3, 4, 90, 1, 1), ("a", 0, 1, 45, 2, 2)], "c": [("b", 5, 5, 30, -1, 1)]}
    lines, n_arcs, lost = [], 0, 0
    want_arcs = []

    def walk(name, chain):
        nonlocal lost
        for k in inner[name]:
            walk(k[0], [*chain, (*k[1:], bases[k[0]])])
        bent = any(abs(c[3]) != abs(c[4]) for c in chain)
        if name == "a":
            lines.append((place(chain, 1 + 0j), place(chain, 2 + 5j)))
            lost += bent
            if not bent:
                want_arcs.append((place(chain, 1 + 0j), *sorted([place(chain, 1 + 2 * cmath.exp(1j * math.radians(10))), place(chain, 1 + 2 * cmath.exp(1j * math.radians(80)))], key=rounded)))
        if name == "b":
            lines.append((place(chain, 0j), place(chain, 1 + 1j)))
        if name == "c":
            lost += bent

    for t in tops:
        walk(t[0], [(*t[1:], bases[t[0]])])
    (tmp_path / "n.dxf").write_text(drawing(blocks, model))
    (tmp_path / "other.dxf").write_text(drawing([("a", (0, 0), line((7, 7), (8, 8)))], insert("a", 1, 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got, problems = entities(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    other = [r for r in got if r.file.endswith("other.dxf")]
    assert [xy(r.points) for r in other] == [[(8, 8), (9, 9)]]
    here = [r for r in got if r not in other]
    close(sorted(x for r in here if r.kind == "line" for x in [c for p in xy(r.points) for c in p]), sorted(c for pair in lines for p in pair for c in p))
    ends = []
    for r in here:
        if r.kind == "arc":
            c = complex(*xy(r.points)[0])
            p = [c + r.radius * cmath.exp(1j * a) for a in (r.start, r.end)]
            ends.append((xy(r.points)[0], *sorted(((z.real, z.imag) for z in p), key=rounded)))
            turn = (r.end - r.start) % (2 * math.pi)
            assert turn == pytest.approx(math.radians(70))
    key = lambda e: [rounded(p) for p in e]
    close([v for e in sorted(ends, key=key) for p in e for v in p], [v for e in sorted(want_arcs, key=key) for p in e for v in p])
    assert sum(problems.values()) == lost and all("non-uniformly" in p for p in problems)


def test_circles_of_blocks_end(spark, tmp_path):
    (tmp_path / "a.dxf").write_text(drawing([("a", (0, 0), [*insert("a", 1, 0), *line((0, 0), (1, 0))])], insert("a", 0, 0)))
    got, problems = entities(spark, tmp_path)
    assert [r.points[0].x for r in got if r.kind == "line"] and sorted(r.points[0].x for r in got) == list(range(dxf.DEEPEST))
    assert problems == {"INSERT (nested too deeply)": 1}


def test_what_is_no_drawing(spark, tmp_path):
    (tmp_path / "a.dxf").write_text("")
    (tmp_path / "b.dxf").write_text("hello\nworld\n")
    (tmp_path / "c.dxf").write_text(text((0, "LINE"), (10, 1)))
    assert entities(spark, tmp_path) == ([], {})
