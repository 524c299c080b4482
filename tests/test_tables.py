"""Panel, coverage, marts, quality and sources on small fixtures."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from pedalgrid.functions import geo as G
from pedalgrid.operators import coverage as C, marts as M, panel as P, quality as Q
from pedalgrid.sources import catalog, esri, readers, sinks, wkb


def test_panel_of_two_snapshots(spark):
    a = spark.createDataFrame([("1", "REG", 1.5, " Existentes ", "8101")], "IDENTIFICA string, `REGIÓN` string, KM double, ETAPA string, CUT_COM string")
    b = spark.createDataFrame([("1", "REG", 2.0, "diseño", 8101.0), ("2", None, None, None, None)], "IDENTIFICA string, REGION string, KM double, ETAPA string, CUT_COM double")
    p = P.stage_flags(P.union_snapshots([P.snapshot(a, "2024-09"), P.snapshot(b, "2026-07")]))
    assert p.count() == 3 and dict(p.dtypes)["cut_com_crudo"] == "string" and dict(p.dtypes)["normativa"] == "string"
    assert p.where("existente").select("corte").first()[0] == "2024-09"
    s = P.summary(p, ["corte", "region_txt", "etapa"], ["km"])
    null_group = s.where("region_txt is null").first()
    assert null_group.tramos == 1 and null_group.km == 0.0


def test_key_resolution_and_flags(spark):
    master = spark.createDataFrame([("08101", "Concepción"), ("13101", "Santiago"), ("05502", "Calera")], "cut string, comuna string")
    df = spark.createDataFrame(
        [(1, "8101", "x", "8"), (2, "8101.0", "x", "9"), (3, "0", "La Calera", None), (4, None, "Santiago", "13"), (5, "1", "nada", "5")],
        "i int, code string, place string, cut_reg_declarado string",
    )
    out = P.region_flags(P.resolve_key(df, master, "code", "place"))
    got = [(r.cut_com, r.cut_com_origen, r.cut_reg, r.cut_reg_declarado_discrepa) for r in out.orderBy("i").collect()]
    assert got == [
        ("08101", "declarado", "08", False),
        ("08101", "declarado", "08", True),
        ("05502", "nombre", "05", False),
        ("13101", "nombre", "13", False),
        (None, "sin_resolver", None, True),
    ]
    Q.require_domain(out, master.withColumnRenamed("cut", "cut_com"), "cut_com")
    with pytest.raises(Q.DomainError, match="99999"):
        Q.require_domain(spark.createDataFrame([("99999",)], "cut_com string"), master.withColumnRenamed("cut", "cut_com"), "cut_com")
    with pytest.raises(Q.DomainError):
        Q.require_master(master.union(master), "cut", "comuna")
    with pytest.raises(Q.DomainError):
        Q.require_master(master, "cut", "comuna", 345)


def test_profile_and_extremes(spark):
    df = spark.createDataFrame([("a", "s_i"), ("a", "x"), ("b", None), ("b", "s_i")], "r string, tipo string")
    p = P.null_profile(df, ["tipo"], ["r"])
    assert {r.r: (r.pct_null, r.pct_marked) for r in p.collect()} == {"a": (0.0, 50.0), "b": (50.0, 50.0)}
    w = P.best_and_worst(p, "r").first()
    assert (w.best, w.worst, w.worst_pct) == ("a", "b", 100.0)


def blocks(spark):
    rows = [("A", "URBANO", 1.0, 10, 1, 100.0), ("A", "URBANO", 2.0, 10, 2, 400.0), ("A", "RURAL", None, 20, 0, None), ("B", "URBANO", 3.0, 0, 0, 10.0)]
    return spark.createDataFrame(rows, "cut_com string, area string, score double, people int, riders int, dist double")


def test_coverage_is_monotone(spark):
    curve = C.coverage_curve(blocks(spark), "dist", "people", "riders").orderBy("threshold").collect()
    assert [r.threshold for r in curve] == [150, 300, 500, 694, 1000]
    assert [r.pct_pob for r in curve] == [25.0, 25.0, 50.0, 50.0, 50.0]
    com = {r.cut_com: r for r in C.commune_coverage(blocks(spark), ["cut_com"], "dist", "people", "riders", "score").collect()}
    assert com["A"].nse_score_pob == 1.5 and com["B"].pct_pob_300 is None and com["B"].pob_cub_300 == 0
    strict = C.commune_coverage(blocks(spark), ["cut_com"], "dist", "people", "riders", "score", strict=True).where("cut_com = 'A'").first()
    assert strict.nse_score_pob is None
    assert C.add_flags(blocks(spark), "dist").where("cub_500").count() == 3
    assert C.universe(blocks(spark), "area", "score", "people").count() == 2


def test_equity_gap(spark):
    rows = [("A", float(i), 10, 100.0 if i >= 8 else 900.0) for i in range(10)] + [("B", float(i), 10, 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "cut_com string, score double, people int, dist double")
    got = {r.cut_com: r.brecha_nse for r in C.equity_gap(df, ["cut_com"], "score", "dist", "people").collect()}
    assert got == {"A": 100.0, "B": None}
    empty = df.where("cut_com = 'A'").withColumn("people", F.when(F.col("score") >= 8, 0).otherwise(F.col("people")))
    assert C.equity_gap(empty, ["cut_com"], "score", "dist", "people").first().brecha_nse is None


def test_access(spark):
    df = spark.createDataFrame([("escolar", 100.0, 50), ("escolar", None, 50), ("superior", 200.0, None)], "clase string, dist double, m int")
    got = {r.clase: r for r in C.access_rates(df, "clase", "dist", "m").collect()}
    assert got["escolar"].pct_300 == 50.0 and got["escolar"].pct_matricula == 50.0
    assert got["superior"].pct_300 == 100.0 and got["superior"].n_matricula == 0


def test_mart_keeps_the_spine(spark):
    spine = spark.createDataFrame([("1", 5), ("2", 7)], "cut_com string, bici int")
    cov = spark.createDataFrame([("1", 99, 40.0)], "cut_com string, bici int, cob double")
    out = M.commune_mart(spine, cov)
    assert out.columns == ["cut_com", "bici", "cob"]
    assert {r.cut_com: (r.bici, r.cob) for r in out.collect()} == {"1": (5, 40.0), "2": (7, None)}


def test_scope_precedence(spark):
    df = spark.createDataFrame([("1", "N"), ("2", "N"), ("3", "S")], "cut_com string, reg string")
    pick = lambda **k: sorted(r.cut_com for r in M.scope_communes(df, **k).collect())
    assert pick(commune="3", metro=["1"], region="N") == ["3"]
    assert pick(metro=["1", "3"], region="N") == ["1", "3"]
    assert pick(region="N") == ["1", "2"] and pick() == ["1", "2", "3"]


def test_gate_leaves_breaks_alone(spark):
    df = spark.createDataFrame([(i, float(i), 9.0) for i in range(8)] + [(90, 1000.0, 1.0), (91, 3.0, None)], "z int, v double, n double")
    out = {r.z: (r.respaldo, r.clase) for r in M.classify(df, "v", support="n").collect()}
    assert out[90] == ("insufficient", None) and out[91][0] == "no_data" and out[7] == ("ok", 6)


def test_zone_mart_reports_losses(spark):
    agg = spark.createDataFrame([("z1", 10.0), ("z2", 20.0)], "zona string, pob double")
    crashes = spark.createDataFrame([("z9", 1, 0, 0)], "zona string, sin_bici int, sin_fall int, sin_grav int")
    shapes = spark.createDataFrame([("z1", 1)], "zona string, geom int")
    mart, lost = M.zone_mart(agg, shapes, crashes)
    assert mart.first().sin_bici == 0 and [r.zona for r in lost.collect()] == ["z2"]


def test_measures_and_counters(spark):
    z = spark.createDataFrame([(10.0, 4.0, 6.0, None, 0.0), (10.0, 4.0, 6.0, 5.0, 500.0)], "g double, a double, ng double, na double, pob double")
    r = M.zone_measures(z, "g", "a", "ng", "na", "pob").collect()
    assert r[0].egen_pc is None and r[0].en_sal is None and r[1].egen_pc == 20.0 and r[1].esaldo == 6.0 and r[1].en_sal == 5.0
    c = spark.createDataFrame([(10.0, 5.0), (5.0, 10.0), (None, 1.0)], "h double, f double")
    assert M.counter_split(c, "h", "f").first().pct == 50.0


def test_city_lists(spark):
    cities = spark.createDataFrame([("Gran Concepción", ["Concepción", "Tomé", "Nada"])], "ciudad string, comunas array<string>")
    communes = spark.createDataFrame([("08101", "CONCEPCION"), ("08111", "TOME")], "cut_com string, nom string")
    found, missing = M.resolve_cities(cities, communes)
    assert sorted(r.cut_com for r in found.collect()) == ["08101", "08111"]
    assert [r.comuna for r in missing.collect()] == ["Nada"]
    assert M.listed_cities(spark, {"Gran Santiago": ["Santiago"]}).count() == 19
    census = found.withColumns({"bici": F.lit(2.0), "viajes_modo": F.lit(50.0)})
    row = M.city_census(census).first()
    assert (row.censo_bici_pct, row.censo_comunas) == (4.0, 2)
    pts = spark.createDataFrame([("08111",), ("13101",)], "cut_com string")
    assert {r.cut_com: r.ciudad for r in M.city_of_commune(pts, found).collect()} == {"08111": "Gran Concepción", "13101": None}


def test_crash_table(spark):
    df = spark.createDataFrame([("8101", -36.8, -73.0), (None, -36.8, -73.0), ("1", 10.0, -73.0)], "cut_com string, lat double, lon double")
    assert [r.cut_com for r in M.crash_table(df).collect()] == ["08101", None]


def test_esri_shapes(spark):
    cw = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]
    ccw = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    far = [[9, 9], [10, 9], [10, 10], [9, 10], [9, 9]]
    page = {"features": [{"attributes": {"i": i}, "geometry": {"rings": r}} for i, r in enumerate([[cw, ccw], [ccw, far], [cw[:3]], [cw, far]])]}
    page["features"].append({"attributes": {"i": 4}, "geometry": {"paths": [[[0, 0]], [[0, 0], [3, 4]]]}})
    page["features"].append({"attributes": {"i": 5}, "geometry": {"x": None, "y": 1}})
    raw = spark.createDataFrame([(json.dumps(page),)], "value string")
    schema = f"features array<struct<attributes:struct<i:int>,geometry:{esri.GEOMETRY}>>"
    f = raw.select(F.explode(F.from_json("value", f"struct<{schema.replace('features array', 'features:array')}>")["features"]).alias("f"))
    rows = {r.i: r for r in f.select("f.attributes.i", esri.esri_polygon(F.col("f.geometry")).alias("p"), esri.esri_line(F.col("f.geometry")).alias("l"), esri.esri_point(F.col("f.geometry")).alias("pt")).collect()}
    assert len(rows[0].p) == 1 and len(rows[0].p[0].holes) == 1
    assert len(rows[1].p) == 2  # one sign only: all shells
    assert rows[2].p is None
    assert len(rows[3].p) == 1 and rows[3].p[0].holes == []  # a hole no shell holds
    assert len(rows[4].l) == 1 and rows[5].pt is None


def test_wkb_round_trip_and_variants(spark):
    line = "array(array(named_struct('x',0D,'y',0D),named_struct('x',3D,'y',4D)),array(named_struct('x',9D,'y',9D),named_struct('x',9D,'y',10D)))"
    df = spark.sql(f"SELECT 1 AS i, {line} AS g UNION ALL SELECT 2, cast(null AS {G.LINE_DDL})")
    back = wkb.read_wkb(wkb.write_wkb(df, "g", "line"), "geometry")
    r = back.select("i", "kind", G.line_length(F.col("line")).alias("l")).collect()
    assert [(x.i, x.kind, x.l) for x in r] == [(1, "line", 6.0)]
    big = b"\x00" + struct.pack(">I2d", 1, 1.0, 2.0)
    ewkb = b"\x01" + struct.pack("<II2d", 1 | 0x20000000, 4326, 5.0, 6.0)
    z = b"\x01" + struct.pack("<I3d", 1001, 7.0, 8.0, 9.0)
    assert [wkb.decode(b)["point"] for b in (big, ewkb, z)] == [{"x": 1.0, "y": 2.0}, {"x": 5.0, "y": 6.0}, {"x": 7.0, "y": 8.0}]
    assert wkb.decode(None) is None
    points = b"\x01" + struct.pack("<II", 4, 1) + b"\x01" + struct.pack("<I2d", 1, 1.0, 2.0)
    assert wkb.decode(points) == {"kind": "points", "point": None, "line": None, "polygon": None}


def test_readers(spark, tmp_path):
    one = spark.createDataFrame([("1", 2.0)], "modo string, factor double")
    one.write.parquet(str(tmp_path / "eod" / "Maule__San_Javier_2014"))
    one.withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "eod" / "Biobio__Lota_2010"))
    got = {r.ciudad: (r.anio, r.extra) for r in readers.city_folders(spark, str(tmp_path / "eod")).collect()}
    assert got == {"San Javier": (2014, None), "Lota": (2010, 1)}
    one.select(F.lit(3).alias("modo"), F.lit("x").alias("factor")).write.parquet(str(tmp_path / "eod" / "Arica__Arica_2011"))
    mixed = readers.city_folders(spark, str(tmp_path / "eod"))
    assert {(r.ciudad, r.modo, r.factor) for r in mixed.collect()} == {("San Javier", "1", "2.0"), ("Lota", "1", "2.0"), ("Arica", "3", "x")}

    geo = tmp_path / "geo"
    geo.mkdir()
    ring = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    feature = lambda name: {"type": "Feature", "properties": {name: "7.0"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
    (geo / "Talca.geojson").write_text(json.dumps({"features": [feature("ZONA")]}))
    (geo / "Osorno.geojson").write_text(json.dumps({"features": [feature("otra")]}))
    (geo / "Roto.geojson").write_text("{not json")
    z = readers.survey_zones(spark, str(geo)).select("ciudad", "zona", G.polygon_area(F.col("geom")).alias("a")).collect()
    assert [tuple(r) for r in z] == [("Talca", "7", 1.0)]
    assert [tuple(r) for r in readers.unreadable_geojson(spark, str(geo)).collect()] == [("Roto", "no_features")]
    (geo / "Talca.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("ZONA")] * 2}, indent=2))
    (geo / "Arica.geojson").write_text('{"features": [\n' + ",\n".join(json.dumps(feature("zona")) for _ in range(3)) + "\n]}")
    found = readers.geojson_features(spark, str(geo)).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in found} == {"Talca": 2, "Osorno": 1, "Arica": 3}
    skipped = readers.unreadable_geojson(spark, str(geo), readers.ZONE_NAMES).collect()
    assert {tuple(r) for r in skipped} == {("Roto", "no_features"), ("Osorno", "no_id")}

    (tmp_path / "metros.json").write_text(json.dumps({"metros": {"GC": ["08101", "08102"]}}))
    assert readers.metro_areas(spark, str(tmp_path / "metros.json")).count() == 2
    (tmp_path / "index.json").write_text(json.dumps({"ciudades": [{"ciudad": "Talca", "n_zonas": 3}]}))
    assert readers.city_index(spark, str(tmp_path / "index.json")).first().n_zonas == 3
    (tmp_path / "idx.csv").write_text("ciudad,v_no_motorizado,v_caminata,viajes_diarios\nCuricó,1,2,3\n", encoding="utf-8")
    assert readers.official_index(spark, str(tmp_path / "idx.csv")).first().ciudad == "Curicó"
    missing = readers.optional(spark, str(tmp_path / "none"), "a int")
    assert missing.count() == 0 and missing.columns == ["a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, b"x")], "zona int, old double, geometry binary")
    sinks.write_attributes(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["zona", "old"]
    path = sinks.enrich_table(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "v"), ["old"], lambda d: d.withColumn("old", F.lit(5.0)))
    assert spark.read.parquet(path).first().old == 5.0
    sinks.write_document({"zonas": df.drop("geometry")}, str(tmp_path / "doc"))
    assert sinks.read_document(spark, str(tmp_path / "doc"), "zonas").first().zona == 1
    line = spark.sql("SELECT array(array(named_struct('x',1D,'y',2D),named_struct('x',3D,'y',4D))) AS g, 9 AS id")
    sinks.write_geojson(line, str(tmp_path / "g"), {"id": F.col("id")}, "MultiLineString", sinks.line_coordinates(F.col("g")))
    f = json.loads(spark.read.text(str(tmp_path / "g")).first()[0])
    assert f["geometry"]["coordinates"] == [[[1.0, 2.0], [3.0, 4.0]]] and f["properties"]["id"] == 9
    back = readers.geojson_features(spark, str(tmp_path / "g")).select("properties", readers.line_from_geojson(F.col("kind"), F.col("coordinates")).alias("l")).collect()
    assert [(r.properties["id"], r.l[0][1].y) for r in back] == [("9", 4.0)]


def test_manifest(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "slug string, posicion int, n int")
    new = spark.createDataFrame([("b", 1, 99), ("c", 2, 5)], "slug string, posicion int, n int")
    out = catalog.upsert(old, new).orderBy("posicion").collect()
    assert [(r.slug, r.n) for r in out] == [("a", 10), ("b", 99), ("c", 5)]
    listed = [{"slug": "counters", "grupo": "g", "vigente": True, "titulo": "T", "capa_id": 3}, {"slug": "old", "vigente": False}]
    for k, text in enumerate((json.dumps(listed, indent=1), json.dumps({"capas": listed}))):
        (tmp_path / f"layers{k}.json").write_text(text)
        layers = catalog.registry(spark, str(tmp_path / f"layers{k}.json"))
        one = catalog.by_slug(layers, "counters").first()
        assert layers.count() == 2 and one.vigente and (one.titulo, one.capa_id, one.nota) == ("T", 3, None)
    pts = spark.createDataFrame([(-70.0, -33.0), (None, None)], "x double, y double")
    stats = catalog.layer_stats(pts, "counters", F.col("x"), F.col("y"))
    declared = spark.createDataFrame([("counters", 3)], "slug string, n_declarado_servicio bigint")
    m = catalog.manifest_rows(layers, stats, declared)
    assert m.first().problemas == ["row_count:2/3", "no_shape:1"]
    catalog.write_manifest(m, str(tmp_path / "m"))
    assert Q.problem_list(spark.read.json(str(tmp_path / "m"))).count() == 2


def test_serving_rows(spark):
    crash = spark.createDataFrame([(2020, 8, "08101", None, 1, "Choque muy largo y detallado de verdad", -36.123456, -73.0)], "anio int, hora int, cut_com string, fallecidos int, graves int, tipo_final string, lat double, lon double")
    r = M.serve_crashes(crash).first()
    assert (r.f, r.gr, len(r.t), r.ll) == (0, 1, 26, [-36.12346, -73.0])
    place = spark.createDataFrame([("Liceo", None, "escolar", 12.6, None, -36.0, -73.0)], "nombre string, cut_com string, clase string, dist_existente_m double, matricula int, lat double, lon double")
    p = M.serve_places(place).first()
    assert (p.c, p.k, p.d, p.m) == ("", 0, 13.0, None)


def test_id_blocks_cover_everything_once(spark):
    ids = spark.createDataFrame([(i * 3,) for i in range(1001)] + [(0,), (3,)], "oid bigint")
    out = esri.id_blocks(ids, "oid").orderBy("block").collect()
    assert [len(r.ids) for r in out] == [400, 400, 201]
    assert [i for r in out for i in r.ids] == [i * 3 for i in range(1001)]
    large = spark.range(2**60, 2**60 + 1000).withColumnRenamed("id", "oid")
    for span in (None, 8):
        out = esri.id_blocks(large, "oid", span=span).orderBy("block").collect()
        assert [i for r in out for i in r.ids] == list(range(2**60, 2**60 + 1000))
