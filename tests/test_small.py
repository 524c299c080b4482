"""Operators that no registered query shows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from pedalgrid.operators import grids, marts as M, quality as Q, ranks as R
from pedalgrid.sources import esri, readers, sinks


def test_average_rank(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 5, 9)] + [("b", 2)], "g string, v int")
    got = {(r.g, r.v): r["rank"] for r in R.average_rank(df, ["g"], "v").collect()}
    assert got == {("a", 1): 1.0, ("a", 5): 2.5, ("a", 9): 4.0, ("b", 2): 1.0}


def test_unmatched_and_catalogue_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    assert {r.v for r in Q.unmatched(a, a.where("k = 1"), ["k"]).collect()} == {"y", "z"}
    m = spark.createDataFrame([("b", "g", True, "2"), ("a", "g", False, "1"), ("c", "g", True, "1")], "slug string, grupo string, vigente boolean, corte string")
    assert [r.slug for r in Q.catalogue_rows(m).collect()] == ["c", "b", "a"]


def test_columns_and_blocks(spark):
    df = spark.createDataFrame([(8101, 1), (8102, 2)], "CUT bigint, n int")
    assert readers.pick_present(df, ["n", "gone"]).columns == ["n"]
    communes = spark.createDataFrame([("08101",), ("08101",)], "cut_com string")
    assert [r.n for r in readers.blocks_of_communes(df, communes).collect()] == [1]


def test_pages(spark, tmp_path):
    page = {"features": [{"attributes": {"i": 1}, "geometry": {"x": 1.0, "y": 2.0}}, {"attributes": {"i": 2}, "geometry": None}]}
    (tmp_path / "p.json").write_text(json.dumps(page, indent=1))
    rows = esri.pages(spark, str(tmp_path / "p.json"), "i:int").select("i", esri.esri_point(F.col("geometry")).alias("p")).collect()
    assert [(r.i, r.p and r.p.y) for r in rows] == [(1, 2.0), (2, None)]


def test_commune_shapes(spark):
    ring = "array(named_struct('x',1.23456789D,'y',2D),named_struct('x',3D,'y',2D),named_struct('x',3D,'y',4.00004D),named_struct('x',1.23456789D,'y',2D))"
    shapes = spark.sql(f"SELECT c AS cut_com, 'n' AS nom, 1 AS other, array(named_struct('shell', {ring}, 'holes', array({ring}))) AS geom FROM VALUES ('1'), ('2') AS t(c)")
    mart = spark.createDataFrame([("1",), ("1",)], "cut_com string")
    rows = M.serve_communes_geo(shapes, mart).collect()
    assert len(rows) == 1 and rows[0].__fields__ == ["cut_com", "nom", "geom"]
    assert rows[0].geom[0].shell[0].x == 1.2346 and rows[0].geom[0].holes[0][2].y == 4.0


def test_hole_of_a_shared_vertex(spark):
    # the hole's first vertex lies on the shell
    shell = [[0.0, 0.0], [0.0, 10.0], [10.0, 10.0], [10.0, 0.0], [0.0, 0.0]]
    hole = [[0.0, 5.0], [4.0, 4.0], [4.0, 6.0], [0.0, 5.0]]
    g = spark.createDataFrame([([shell, hole],)], "rings array<array<array<double>>>").select(F.struct("rings").alias("g"))
    p = g.select(esri.esri_polygon(F.col("g")).alias("p")).first().p
    assert len(p) == 1 and len(p[0].holes) == 1


def test_wkb_columns_equal_single_decoding():
    import struct

    from pedalgrid.sources import wkb

    at = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    ring = lambda k: at((0, 0), (k, 0), (k, k), (0, 0))
    point = b"\x01" + struct.pack("<I2d", 1, 1.0, 2.0)
    blobs = [
        point,
        wkb.encode_lines([at((1, 2), (3, 4))]),
        b"\x01" + struct.pack("<II", 4, 1) + point,
        wkb.encode_lines([at((1, 2), (3, 4)), at((5, 6), (7, 8), (9, 9))]),
        wkb.encode_polygons([{"shell": ring(9), "holes": [ring(1), ring(2)]}]),
        wkb.encode_polygons([{"shell": ring(9), "holes": []}, {"shell": ring(5), "holes": [ring(1)]}]),
        b"\x01" + struct.pack("<II", 2, 0),
        b"\x01" + struct.pack("<I2d", 1, float("nan"), float("nan")),
    ]
    columns = wkb.decoded(blobs)
    for i, b in enumerate(blobs):
        assert {n: c[i].as_py() for n, c in zip(wkb.DECODED.names, columns)} == wkb.decode(b)
    assert wkb.decode(blobs[4])["polygon"] == [{"shell": ring(9), "holes": [ring(1), ring(2)]}]
    assert all(len(c) == 0 for c in wkb.decoded([]))


def test_geo_parquet(spark, tmp_path):
    import struct

    import pyarrow as pa
    import pyarrow.parquet as pq
    import pytest

    def write(name, geo):
        blob = b"\x01" + struct.pack("<I2d", 1, 5.0, 6.0)
        t = pa.table({"id": [1, 2], "other": [0, 0], "geometry": pa.array([blob, None], pa.binary())})
        (tmp_path / name).mkdir()
        pq.write_table(t.replace_schema_metadata(geo and {"geo": json.dumps(geo)}), str(tmp_path / name / "a.parquet"))
        return str(tmp_path / name)

    metric = write("m", {"columns": {"geometry": {"crs": {"id": {"authority": "EPSG", "code": 32719}}}}})
    plain, default = write("p", None), write("d", {"columns": {"geometry": {}}})
    assert [readers.declared_crs(spark, p) for p in (metric, plain, default)] == ["EPSG:32719", None, "OGC:CRS84"]
    row = readers.geo_parquet(spark, metric, crs="EPSG:32719", columns=["id"]).collect()
    assert [(r.id, r.kind, r.point.y) for r in row] == [(1, "point", 6.0)] and "other" not in row[0].asDict()
    with pytest.raises(ValueError, match="CRS84"):
        readers.geo_parquet(spark, default, crs="EPSG:32719")


def test_scan_skips_files_of_other_communes(spark, tmp_path):
    blocks = spark.range(4000).selectExpr("(id * 7919) % 40 AS CUT", "id AS block")
    sinks.write_clustered(blocks, str(tmp_path / "b"), ["CUT", "block"], files=8)
    table = spark.read.parquet(str(tmp_path / "b"))
    ranges = table.groupBy(F.col("_metadata.file_name")).agg(F.min("CUT").alias("lo"), F.max("CUT").alias("hi")).orderBy("lo").collect()
    assert len(ranges) == 8 and all(a["hi"] <= b["lo"] for a, b in zip(ranges, ranges[1:]))
    wanted = spark.createDataFrame([("3",), ("17",), (None,), ("3",)], "cut_com string")
    got = readers.blocks_of_communes(table, wanted)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(CUT, [" in plan
    want = sorted(map(tuple, blocks.where("CUT IN (3, 17)").collect()))
    assert sorted(map(tuple, got.collect())) == want
    joined = readers.blocks_of_communes(table, wanted, listed=1)
    assert sorted(map(tuple, joined.collect())) == want
    assert readers.blocks_of_communes(table, wanted.limit(0)).count() == 0


def test_readers_see_one_whole_version(spark, tmp_path):
    root = str(tmp_path / "t")
    assert sinks.current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, root)
    first = sinks.enrich_table(spark.range(5).toDF("id"), root, ["twice"], lambda d: d.withColumn("twice", F.col("id") * 2))
    assert sinks.current_version(spark, root) == first

    def fails(d):
        return d.withColumn("twice", F.when(F.col("id") > 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long"))

    with pytest.raises(Exception):
        sinks.enrich_table(sinks.read_current(spark, root), root, ["twice"], fails)
    assert sinks.current_version(spark, root) == first
    assert sorted(map(tuple, sinks.read_current(spark, root).collect())) == [(i, 2 * i) for i in range(5)]
    second = sinks.enrich_table(sinks.read_current(spark, root), root, ["twice"], lambda d: d.withColumn("twice", F.col("id") * 3))
    assert second != first and sinks.current_version(spark, root) == second
    assert sinks.read_current(spark, root).agg(F.sum("twice")).first()[0] == 30


def test_concentration_by_brute_force(spark):
    rows = [(0.5, 0.5, 1), (0.7, 0.2, 1), (3.5, -1.5, 1), (40.0, 40.0, 2), (None, 1.0, 2)]
    pts = spark.createDataFrame(rows, "x double, y double, g int")
    got = {(r["g"], r["cx"], r["cy"]): (r["n"], r["heat"]) for r in grids.concentration(pts, "x", "y", 1, 3, ["g"]).collect()}
    want = {}
    for x, y, g in rows[:4]:
        cx, cy = math.floor(x), math.floor(y)
        for i in range(-3, 4):
            for j in range(-3, 4):
                n, h = want.get((g, cx + i, cy + j), (0, 0.0))
                want[g, cx + i, cy + j] = n + (i == j == 0), h + math.exp(-0.5 * (i * i + j * j))
    assert got.keys() == want.keys()
    assert all(got[k][0] == n and abs(got[k][1] - h) < 1e-9 for k, (n, h) in want.items())
    with pytest.raises(ValueError):
        grids.concentration(pts, "x", "y", 2, 1)
