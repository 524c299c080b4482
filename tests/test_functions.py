"""Column helpers on hand-computed rows."""

import math

import pytest
from pyspark.sql import functions as F

from pedalgrid.functions import geo as G, numbers as N, text as X, time as T


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(fn(F.col("v"))).first()[0]


def many(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_dirty_text(spark):
    values = ["Viña del  Mar ", "", None, "La Calera", " ", "a b"]
    assert many(spark, values, X.clean_text) == ["Viña del Mar", None, None, "La Calera", None, "a b"]
    assert many(spark, values, X.name_key) == ["VINADELMAR", None, None, "CALERA", None, "AB"]
    assert many(spark, ["Puerto Aysén", "Llay Llay"], X.name_key) == ["AYSEN", "LLAILLAY"]
    assert many(spark, ["Ñuble  (norte)", "São"], X.norm_name) == ["NUBLE (NORTE)", "SAO"]
    assert many(spark, ["Curicó 2014", "á"], X.alnum_key) == ["CURICO2014", "A"]


def test_codes(spark):
    values = ["8101", "8101.0", "0", None, "13101", "123456", " 7 "]
    assert many(spark, values, X.repair_code) == ["08101", "08101", "00000", None, "13101", "123456", "00007"]
    assert many(spark, ["810101001.0", "x", None, "7"], X.code_text) == ["810101001", None, None, "7"]
    assert one(spark, "08101", X.region_of) == "08"
    assert many(spark, ["obra 2019-2", "s_i", None], X.year_of) == [2019, None, None]


def test_hours(spark):
    values = ["1899-12-30 13:20:00", "0.54166666667", "17", "7.0", "0.99", "25", "tarde", None, "08:30", "0"]
    assert many(spark, values, T.trip_hour) == [13, 13, 17, 7, None, None, None, None, 8, 0]
    assert many(spark, ["23", "24", "-1", "x", "4.5", "5.5"], T.valid_hour) == [23, None, None, None, 4, 6]


def test_rounding_and_guards(spark):
    assert many(spark, [2.25, 2.35, -0.5], lambda c: N.half_even(c, 1), "double") == [2.2, 2.4, -0.5]
    # noise from the order of addition does not decide a tie
    assert one(spark, 0.1 + 0.2 + 0.15, lambda c: N.half_even(c, 1), "double") == one(
        spark, 0.45, lambda c: N.half_even(c, 1), "double"
    )
    assert many(spark, ["1.5", "NaN", "Infinity", "x", None], N.safe_double) == [1.5, None, None, None, None]
    assert many(spark, [0.0, 0.1, 300.0, 301.0], lambda c: N.guard_range(c, 0, 300), "double") == [None, 0.1, 300.0, None]
    assert many(spark, ["s_i", "x", None], N.is_informed) == [False, True, False]
    assert many(spark, [None, 4.9, 5.0], N.support_status, "double") == ["no_data", "insufficient", "ok"]
    assert one(spark, 0.0, lambda c: N.ratio(F.lit(3), c), "double") is None
    assert many(spark, [1.005, float("nan"), None], lambda c: N.json_number(c, 2), "double") == [1.0, None, None]


def test_measured_figures_beside_a_half(spark):
    # a millionth beside a half is no noise
    near = [12.3250004, 12.3349997, 0.1250001]
    assert many(spark, near, lambda c: N.json_number(c, 2), "double") == [12.33, 12.33, 0.13]
    assert many(spark, [2.50004, 2.5, None], lambda c: N.half_even(c), "double") == [3.0, 2.0, None]


def test_weighted_mean_with_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 5.0), (4.0, 2.0)], "x double, w double")
    x, w = F.col("x"), F.col("w")
    row = df.agg(
        N.weighted_mean(x, w).alias("a"),
        N.weighted_mean(x, w, strict=True).alias("b"),
        N.weighted_mean(x, w * 0, else_plain=True).alias("c"),
    ).first()
    assert row.a == 3.0 and row.b is None and row.c == 2.5


def test_formats_and_labels(spark):
    assert many(spark, [1234567.891, None], lambda c: X.cl_number(c, 1), "double") == ["1.234.567,9", "s/d"]
    assert one(spark, 12.34, X.cl_percent, "double") == "12,3 %"
    labels = {"smp": "senda"}
    assert many(spark, ["smp", "zona30", None], lambda c: X.label_of(c, labels)) == ["Senda", "Zona30", "Sin dato"]
    assert many(spark, ["b", "a", "z", None], lambda c: X.ordinal_of(c, ["a", "b"], 3)) == [1, 0, 3, 3]
    assert many(spark, ["Ñuñoa", "La Ñ"], lambda c: X.matches_search(c, "ñuñ")) == [True, False]
    assert one(spark, "Concepción", lambda c: X.matches_search(c, "co")) is False
    assert many(spark, ["abcdef", None], lambda c: X.clip(c, 3)) == ["abc", ""]


def test_projection_round_trip_and_scale(spark):
    points = [(-69.0, -33.0), (-70.65, -33.45), (-73.05, -36.83), (-70.9, -53.15), (-68.2, -22.5)]
    df = spark.createDataFrame(points, "lon double, lat double").withColumn("m", G.to_metric(F.col("lon"), F.col("lat")))
    rows = df.withColumn("g", G.to_lonlat(F.col("m.x"), F.col("m.y"))).collect()
    for r in rows:
        assert abs(r.g.x - r.lon) < 1e-9 and abs(r.g.y - r.lat) < 1e-9
    assert abs(rows[0].m.x - 500000) < 1e-6
    # on the central meridian the northing is the scaled meridian arc: 0.9996 * 3652701.4 m at 33 degrees
    arc = sum_meridian(33.0)
    assert abs((10000000 - rows[0].m.y) - 0.9996 * arc) < 0.01


def sum_meridian(deg, steps=200000):
    a, e2 = G.SEMI_MAJOR, G.FLATTENING * (2 - G.FLATTENING)
    h = math.radians(deg) / steps
    f = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    return h * (sum(f(i * h) for i in range(1, steps)) + (f(0) + f(steps * h)) / 2)


def shape(spark, sql):
    return spark.sql(f"SELECT {sql} AS g")


SQUARE_WITH_HOLE = (
    "array(named_struct('shell', array(named_struct('x',0D,'y',0D),named_struct('x',4D,'y',0D),named_struct('x',4D,'y',4D),"
    "named_struct('x',0D,'y',4D),named_struct('x',0D,'y',0D)), 'holes', array(array(named_struct('x',1D,'y',1D),named_struct('x',2D,'y',1D),"
    "named_struct('x',2D,'y',2D),named_struct('x',1D,'y',2D),named_struct('x',1D,'y',1D)))))"
)


def test_polygon_measures(spark):
    r = shape(spark, SQUARE_WITH_HOLE).select(
        G.polygon_area(F.col("g")).alias("a"), G.polygon_centroid(F.col("g")).alias("c")
    ).first()
    assert r.a == 15.0
    assert r.c.x == pytest.approx((16 * 2 - 1.5) / 15) and r.c.y == pytest.approx((16 * 2 - 1.5) / 15)


def test_line_measures(spark):
    line = "array(array(named_struct('x',0D,'y',0D),named_struct('x',3D,'y',4D),named_struct('x',3D,'y',10D)))"
    r = shape(spark, line).select(
        G.line_length(F.col("g")).alias("l"), G.representative_vertex(F.col("g")).alias("v"), F.size(G.line_pieces(F.col("g"))).alias("n")
    ).first()
    assert r.l == 11.0 and (r.v.x, r.v.y) == (3.0, 4.0) and r.n == 2


def test_piece_distance_cases(spark):
    rows = [
        ((0, 0, 10, 0), (5, -1, 5, 1), 0.0),  # crossing
        ((0, 0, 10, 0), (5, 3, 5, 9), 9.0),  # T-junction with a gap
        ((0, 0, 10, 0), (12, 0, 15, 0), 4.0),  # in line
        ((0, 0, 0, 0), (3, 4, 3, 4), 25.0),  # two points
        ((0, 0, 10, 0), (0, 2, 10, 2), 4.0),  # parallel
    ]
    df = spark.createDataFrame(
        [tuple(map(float, a + b)) + (d,) for a, b, d in rows], "a double,b double,c double,d double,e double,f double,g double,h double,want double"
    )
    c = [F.col(n) for n in "abcdefgh"]
    for r in df.select(G.piece_piece_d2(c[:4], c[4:]).alias("d"), "want").collect():
        assert r.d == pytest.approx(r.want)


def test_trip_distance(spark):
    df = spark.createDataFrame([(True, 2.0, 9.0), (True, None, 9.0), (False, 2.0, 9.0)], "s boolean, r double, d double")
    got = [r[0] for r in df.select(G.trip_distance_km(F.col("s"), F.col("r"), F.col("d"))).collect()]
    assert got == [1.4, 0.5, 9.0]
    deg = spark.range(1).select(G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).first()[0]
    assert deg == pytest.approx(6371.0 * math.pi / 180)


def test_same_name(spark):
    from pedalgrid.operators.marts import same_name

    rows = [("Concepción", "CONCEPCION"), ("Ñuñoa", "nunoa centro"), ("Gran Viña", "vina"), ("Maipú", "Maule"), (None, "a")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(same_name(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, True, False, None]
