"""Octree clouds: a small one by hand, round trips, and damaged ones."""

import json
import struct

import pytest

from geoloom.sources import octree


def small_cloud(folder, points=20, first=22, kind=0, mask=0, **changed):
    """20 points in one node: x is i % 5 but 10 from 15 on, z is 5 x raw steps but 300 at i = 4."""
    attributes = [{"name": "position", "size": 12, "numElements": 3, "elementSize": 4, "type": "int32"}, {"name": "classification", "size": 1, "numElements": 1, "elementSize": 1, "type": "uint8"}]
    told = {"version": "2.0", "name": folder.name, "points": points, "hierarchy": {"firstChunkSize": first, "stepSize": 4}, "offset": [0, 0, 0], "scale": [0.01] * 3, "boundingBox": {"min": [0, 0, 0], "max": [10, 4, 5]}, "encoding": "UNCOMPRESSED", "attributes": attributes}
    folder.mkdir(parents=True)
    rows = [(i % 5 if i < 15 else 10, i // 5) for i in range(20)]
    body = b"".join(struct.pack("<iiiB", x * 100, y * 100, 300 if i == 4 else 5 * x, 1) for i, (x, y) in enumerate(rows))
    (folder / "octree.bin").write_bytes(body)
    (folder / "hierarchy.bin").write_bytes(octree.RECORD.pack(kind, mask, 20, 0, len(body)))
    (folder / "metadata.json").write_text(json.dumps(told | changed))
    return sorted((float(x), float(y), (300 if i == 4 else 5 * x) * 0.01, 1) for i, (x, y) in enumerate(rows))


def test_small_cloud(spark, tmp_path):
    want = small_cloud(tmp_path / "a")
    got = octree.octree_points(spark, str(tmp_path), ["classification"])
    assert got.columns == ["root", "node", "x", "y", "z", "classification"]
    assert sorted((r.x, r.y, r.z, r.classification) for r in got.collect()) == want
    small_cloud(tmp_path / "b")
    assert octree.octree_points(spark, str(tmp_path)).groupBy("root").count().count() == 2
    names = spark.createDataFrame([("b",), ("b",)], "name string")
    assert octree.octree_points(spark, str(tmp_path), roots=names).count() == 20


@pytest.mark.parametrize(
    "changed, problem",
    [({"points": 21}, "say 21 points"), ({"first": 20}, "20 bytes"), ({"first": 44}, "out of range"), ({"mask": 5}, "ends before"), ({"version": "1.8"}, "version"), ({"encoding": "BROTLI"}, "encoding"), ({"scale": [1, 0, 1]}, "scale"), ({"attributes": []}, "attributes")],
)
def test_damaged_clouds(spark, tmp_path, changed, problem):
    small_cloud(tmp_path / "a", **changed)
    with pytest.raises(Exception, match=problem):
        octree.octree_points(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("tile, node, range_bytes", [(10_000, 7, 40), (60, 1, 1 << 20), (1, 1000, 1 << 20)])
def test_round_trip(spark, tmp_path, monkeypatch, tile, node, range_bytes):
    monkeypatch.setattr(octree, "RANGE_BYTES", range_bytes)
    rows = [(k, (k * 7 % 50) / 4, (k * k % 31) / 4, k % 3 * 1.5, k % 250) for k in range(400)] + [(1000 + k, 2.0, 2.0, 2.0, 7) for k in range(200)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, cls int").repartition(3)
    names = octree.write_octrees(points, str(tmp_path / "out"), 0.25, {"cls": "uint8", "id": "int64"}, tile_points=tile, node_points=node)
    got = octree.octree_points(spark, str(tmp_path / "out"), ["id", "cls"], roots=names)
    assert sorted((r.id, r.x, r.y, r.z, r.cls) for r in got.collect()) == sorted(rows)
    levels = [octree.octree_points(spark, str(tmp_path / "out"), deepest=d).count() for d in (0, 2, 30)]
    assert levels[0] <= levels[1] <= levels[2] == 600
    if node == 7:
        assert got.where("length(node) > 6").count() > 0  # several pages


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "x double, y double, z double")
    names = octree.write_octrees(empty, str(tmp_path / "out"), 0.25)
    assert names.count() == 0
    (tmp_path / "out").mkdir(exist_ok=True)
    with pytest.raises(ValueError, match="no octree"):
        octree.octree_points(spark, str(tmp_path / "out"))
