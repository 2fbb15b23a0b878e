"""Readers, writers and streams."""

import struct

from pyspark.sql import functions as F

from geoloom.sources import readers, sinks
from geoloom.streaming import streams


def test_control_points(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name;E;N;H\n"A";1,5;2;3\nB;x;2;\n A ;1;2;\nC;4;5;\n')
    cols = readers.detect_columns(["name", "E", "N", "H"])
    valid, errors = readers.control_points(spark, str(tmp_path / "c.csv"), cols, ";", ",")
    assert [(r.name, r.east, r.height) for r in valid.orderBy("line").collect()] == [("A", 1.5, 3.0), ("C", 4.0, None)]
    assert sorted(r.problem for r in errors.collect()) == ["east", "repeated"]
    assert readers.preview(valid, errors, 1)[1].first()["truncated"]


def test_ply_stl_obj_step(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    (tmp_path / "b.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty double x\nproperty uchar r\nproperty double y\nproperty double z\nend_header\n" + struct.pack("<dBdd", 7, 1, 8, 9))
    assert {(r.x, r.y, r.z) for r in readers.ply_points(spark, str(tmp_path / "*.ply")).collect()} == {(1, 2, 3), (4, 5, 6), (7, 8, 9)}
    (tmp_path / "t.stl").write_bytes(b" " * 80 + struct.pack("<I12fH", 1, *range(12), 0))
    assert list(readers.stl_triangles(spark, str(tmp_path / "t.stl")).first())[1:] == [float(k) for k in range(3, 12)]
    (tmp_path / "t.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2 3 4\n")
    assert [(r.a, r.b, r.c) for r in readers.obj_faces(spark, str(tmp_path / "t.obj")).collect()] == [(1, 2, 3), (1, 3, 4)]
    assert readers.obj_vertices(spark, str(tmp_path / "t.obj")).count() == 4
    (tmp_path / "m.ifc").write_text("DATA;\n#1=IFCWALL('a',\n(1.,2.));\n#2 = IfcDoor(#1);\nENDSEC;")
    assert [(r.id, r.type) for r in readers.step_records(spark, str(tmp_path / "m.ifc")).orderBy("id").collect()] == [(1, "IFCWALL"), (2, "IFCDOOR")]


def test_publish(spark, tmp_path):
    df = spark.range(10)
    a = sinks.publish(df, str(tmp_path), "id", {"k": 1}, "s")
    assert a == sinks.publish(df.repartition(3), str(tmp_path), "id", {"k": 1}, "s") != sinks.publish(df, str(tmp_path), "id", {"k": 2}, "s")
    assert spark.read.parquet(f"{tmp_path}/{a}/manifest").first()["n"] == 10


def test_streams(spark, tmp_path):
    schema = "key string, ms long, phase string, done long"
    rows = [("a", 0, "x", 1), ("a", 50, "x", 2), ("a", 60, "y", 3), ("a", 200, "y", 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.coalesced_progress(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.ms for r in spark.table("progress").collect()) == [0, 60, 200]
    spark.createDataFrame([(1,), (5,)], "sequence long").write.parquet(str(tmp_path / "j"))
    q = streams.journal_tail(spark, str(tmp_path / "j"), "sequence long", 3).writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.sequence for r in spark.table("tail").collect()] == [5]
    s = streams.quality_summary(spark.createDataFrame([(1.0, True, 0.2), (20.0, True, 0.2)], "correction_age double, dual_frequency boolean, accuracy double")).first()
    assert (s["fixed_share"], s["float_share"]) == (0.0, 0.5)
    assert streams.windowed_counts(spark.createDataFrame([("2024-01-01 00:10:00", "a")], "ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))).count() == 1
