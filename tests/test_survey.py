"""Survey operators on hand-computed trips."""

import pytest
from pyspark.sql import functions as F

from pedalgrid.operators import survey as S

COLS = "ciudad string, anio int, modo_agregado string, modo_agregado_desc string, factor string"


def curico(spark):
    rows = [
        ("1", "1.Caminata", "103084.3"),
        ("2", "2.No Caminata", "41401.6"),
        ("3", "Privado", "199041.0"),
        ("4", "Publico", "121047.4"),
        ("5", "Combinado", "9220.5"),
    ]
    return spark.createDataFrame([("Curico", 2014, *r) for r in rows], COLS)


def test_mode_reconstruction(spark):
    r = S.city_summary(curico(spark)).first()
    assert round(r.bici_pct, 2) == 8.74
    assert round(100 * r.caminata_exp / r.viajes_exp, 2) == 21.76
    assert (r.cod_caminata, r.cod_bici, r.n_registros_bici) == ("1", "2", 1)


def test_inseparable_city_and_ties(spark):
    rows = [
        ("A", 2010, "1", "No Motorizado", "5"), ("A", 2010, "9", "Auto", "5"),
        ("B", 2010, "2", "no motorizado", "4"), ("B", 2010, "1", "BICICLETA", "4"), ("B", 2010, None, "Caminata", "1"),
        ("C", 2010, "1", None, "3"), ("D", 2010, "1", "Caminata", "x"),
    ]
    out = {r.ciudad: r for r in S.city_summary(spark.createDataFrame(rows, COLS)).collect()}
    assert not out["A"].separable and out["A"].nomot_pct == 50 and out["A"].bici_pct is None
    # equal weights: the smaller code walks; a missing code is a code of its own
    assert out["B"].cod_caminata == "1" and out["B"].cod_bici == "2, nan"
    assert not out["C"].separable and out["C"].nomot_pct is None
    # no weight at all: the city is listed, and nothing can be told apart
    assert not out["D"].separable and out["D"].viajes_exp == 0 and out["D"].bici_pct is None


def trips(spark):
    rows = [
        # walking dominates; code 2 is the bike
        ("A", 2010, "1", "Caminata", "10", "H", "trabajo", 8.0, 0.4, 10.0, "z1", "z1"),
        ("A", 2010, "2", "Caminata", "4", "M", "trabajo", 8.0, 1.0, 20.0, "z1", "z2.0"),
        ("A", 2010, "2", "Caminata", "2", "H", None, None, 8.0, 400.0, "z2", "z1"),
        ("A", 2010, "3", "Auto", "6", "H", "estudio", 25.0, 9.5, 30.0, "z1", "z2"),
        ("A", 2010, "3", "Auto", "8", "M", "estudio", 9.0, None, 0.0, None, "z2"),
    ]
    cols = COLS + ", sexo_h string, proposito_agregado_h string, hora double, dist_km double, tiempo_viaje double, zona_origen string, zona_destino string"
    return spark.createDataFrame(rows, cols)


def test_crosstab(spark):
    out = {(r.dim, r.valor): (r.bici, r.total, r.part) for r in S.crosstab(trips(spark)).collect()}
    assert out[("sexo", "H")] == (2.0, 18.0, 11.111)
    assert out[("proposito", "trabajo")] == (4.0, 14.0, 28.571)
    assert out[("hora", "8")] == (4.0, 14.0, 28.571) and ("hora", "25") not in out
    assert out[("hora_prop", "8|trabajo")] == (4.0, 14.0, 28.571)
    assert not [k for k in out if k[0] == "edad"]  # the table has no such column
    nat = S.national_crosstab(S.crosstab(trips(spark)).union(S.crosstab(trips(spark)))).where("dim = 'sexo' and valor = 'H'").first()
    assert nat.total == 36.0 and nat.part == pytest.approx(100 * 4 / 36)


def test_bands(spark):
    v = [0.0, 1.0, 8.0, 9.5, None, -1.0]
    df = spark.createDataFrame([(x,) for x in v], "d double").select(S.band_of(F.col("d")).alias("b"))
    assert [S.BANDS[r.b] if r.b is not None else None for r in df.collect()] == ["0-1", "1-2", "8+", "8+", None, None]
    out = {(r.modo, r.tramo): (r.viajes, r.part) for r in S.distance_bands(trips(spark)).collect()}
    assert len(out) == 18
    assert out[("bicicleta", "1-2")] == (4.0, 66.667) and out[("bicicleta", "3-4")] == (0.0, 0.0)
    assert out[("todos", "8+")] == (8.0, 36.364)


def test_distance_and_time(spark):
    out = {r.modo: r for r in S.distance_summary(trips(spark)).collect()}
    assert out["bicicleta"].dist_mediana_km == 1.0 and out["bicicleta"].dist_media_km == 3.333
    assert out["todos"].dist_mediana_km == 1.0 and out["todos"].viajes == 22.0
    k = S.travel_time_medians(trips(spark)).first()
    assert (k.n_bici, k.tiempo_med_min, k.tiempo_med_bici_min) == (2, 10.0, 20.0)
    gap = spark.createDataFrame([(30.0, 20.0), (20.0, 30.0)], "tiempo_med_min double, tiempo_med_bici_min double")
    assert [r.minutos_menos for r in S.time_gap(gap).collect()] == [10.0, None]


def test_trip_distances(spark):
    cent = spark.createDataFrame(
        [("A", "z1.0", 0.0, 0.0, 2.0), ("A", "z2", 1.0, 0.0, None)], "ciudad string, zona string, lon double, lat double, radio_km double"
    )
    got = [r.dist_km for r in S.trip_distances(trips(spark).drop("dist_km"), cent).orderBy("factor", F.col("tiempo_viaje")).collect()]
    far = pytest.approx(111.19, abs=0.01)
    assert got == [1.4, far, far, far, None]


def test_profile_zones_and_hours(spark):
    t = trips(spark).withColumn("hora_inicio", F.lit("1899-12-30 13:20:00")).withColumn("periodo", F.lit("punta"))
    p = S.bike_profile(t)
    assert {(r.dim, r.valor): r.viajes for r in p.collect()} == {("proposito", "trabajo"): 4.0, ("periodo", "punta"): 6.0, ("hora", "13"): 6.0}
    hours = S.hour_vector(p).first().horas
    assert len(hours) == 24 and hours[13] == 6.0 and sum(hours) == 6.0
    z = {(r.lado, r.zona): (r.viajes, r.n) for r in S.zone_sides(t).collect()}
    assert z == {("origen", "z1"): (4.0, 1), ("origen", "z2"): (2.0, 1), ("destino", "z2.0"): (4.0, 1), ("destino", "z1"): (2.0, 1)}


def test_official_index(spark):
    s = spark.createDataFrame([("Curico", 8.7, 30.5, True), ("Talca", 5.0, 20.0, True), ("Lota", 1.0, 2.0, True)], "ciudad string, bici_pct double, nomot_pct double, separable boolean")
    idx = spark.createDataFrame([("Curicó", 87.0, 218.0, 1000.0), ("Talca", 200.0, 0.0, 1000.0)], "ciudad string, v_no_motorizado double, v_caminata double, viajes_diarios double")
    out = {r.ciudad: r for r in S.against_official(s, idx).collect()}
    assert out["Curico"].indice_consistente and out["Curico"].dif_pp == pytest.approx(0.0)
    assert not out["Talca"].indice_consistente  # declares no walking
    assert not out["Lota"].indice_consistente and out["Lota"].ofi_bici_pct is None
    top = S.city_ranking(S.against_official(s, idx)).collect()
    assert [r.ciudad for r in top] == ["Curico", "Talca", "Lota"] and top[1].ofi is None


def test_city_kpis_keep_both_sides(spark):
    idx = spark.createDataFrame([("Curicó", 2014, 9), ("Lota", 2015, 3)], "ciudad string, anio int, n_zonas int")
    own = spark.createDataFrame([("Curico", 2014, 12.0), ("Arica", 2010, 9.0)], "ciudad string, anio int, t double")
    out = {r.k: r for r in S.city_kpis(idx, own).collect()}
    assert set(out) == {"CURICO", "LOTA", "ARICA"}
    assert out["CURICO"].t == 12.0 and out["CURICO"].n_zonas == 9 and out["ARICA"].ciudad is None


def test_published_walking(spark):
    df = spark.createDataFrame([(None, 30.0, 5.0), (None, 0.0, 0.0), (21.8, 30.5, 0.0)], "own double, idx double, nm double")
    got = [r[0] for r in df.select(S.published_walking(F.col("own"), F.col("idx"), F.col("nm"))).collect()]
    assert got == [30.0, None, 21.8]
