"""Survey queries: ``events`` stand in for household-survey trips.

City is the user's group, raw mode the event type, weight the event value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.time import trip_hour, valid_hour
from ..operators import marts as M, quality as Q, ranks as R, survey as S
from .base import query, r4, table

# event type -> description: three codes are non-motorised
DESCRIPTIONS = {"view": "1.Caminata", "click": "2.No Caminata", "error": "No Motorizado", "purchase": "Auto", "signup": "Bus"}

TRIPS = """t AS (
  SELECT 'Ciudad ' || CAST(user_id % 15 AS VARCHAR) AS ciudad, CAST(year(ts) AS INTEGER) AS anio, event_type AS cod, value AS f,
         event_type IN ('view', 'click', 'error') AS nm, hour(ts) AS hora,
         CASE WHEN user_id % 2 = 0 THEN 'Hombre' ELSE 'Mujer' END AS sexo,
         nullif('p' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 20 AS VARCHAR), 'p4') AS proposito,
         CASE WHEN hour(ts) < 9 THEN 'punta' ELSE 'valle' END AS periodo,
         'z' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) // 10 AS VARCHAR) AS zona_o, 'z' || CAST(user_id // 15 AS VARCHAR) AS zona_d,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events),
s AS (SELECT ciudad, anio, cod, sum(f) AS f, row_number() OVER (PARTITION BY ciudad, anio ORDER BY sum(f) DESC, cod) AS rn,
             count(*) OVER (PARTITION BY ciudad, anio) AS codes
      FROM t WHERE nm GROUP BY 1, 2, 3),
w AS (SELECT ciudad, anio, cod AS walk FROM s WHERE rn = 1 AND codes >= 2),
b AS (SELECT t.*, w.walk, (nm AND t.cod <> w.walk) AS bici FROM t JOIN w USING (ciudad, anio))"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    described = None
    for code, text in DESCRIPTIONS.items():
        hit = F.col("event_type") == code
        described = F.when(hit, text) if described is None else described.when(hit, text)
    purpose = F.concat(F.lit("p"), F.floor(k / 20).cast("string"))
    return e.select(
        F.concat(F.lit("Ciudad "), (F.col("user_id") % 15).cast("string")).alias("ciudad"),
        F.year("ts").alias("anio"),
        F.col("event_type").alias("modo_agregado"),
        described.alias("modo_agregado_desc"),
        F.col("value").cast("string").alias("factor"),
        F.hour("ts").alias("hora"),
        F.date_format("ts", "HH:mm:ss").alias("hora_inicio"),
        F.when(F.col("user_id") % 2 == 0, "Hombre").otherwise("Mujer").alias("sexo_h"),
        F.nullif(purpose, F.lit("p4")).alias("proposito_agregado_h"),
        F.when(F.hour("ts") < 9, "punta").otherwise("valle").alias("periodo"),
        F.concat(F.lit("z"), F.floor(k / 10).cast("string")).alias("zona_origen"),
        F.concat(F.lit("z"), F.floor(F.col("user_id") / 15).cast("string")).alias("zona_destino"),
        (k / 10).alias("dist_km"),
        (k * 4 - 20).alias("tiempo_viaje"),
        "user_id",
    )


@query(
    "mode_reconstruct",
    f"""
WITH {TRIPS}
SELECT ciudad, anio, TRUE AS separable, round(sum(f), 2) AS viajes_exp, round(sum(f) FILTER (bici), 2) AS bici_exp,
       round(sum(f) FILTER (nm AND NOT bici), 2) AS caminata_exp, round(100 * sum(f) FILTER (nm) / sum(f), 4) AS nomot_pct,
       round(100 * sum(f) FILTER (bici) / sum(f), 4) AS bici_pct, count(*) FILTER (bici) AS n_registros_bici, max(walk) AS cod_caminata,
       max(cods) AS cod_bici
FROM b JOIN (SELECT ciudad, anio, string_agg(cod, ', ' ORDER BY rn) AS cods FROM s WHERE rn > 1 GROUP BY 1, 2) USING (ciudad, anio)
GROUP BY 1, 2
""",
)
def mode_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.city_summary(trips(spark, sf_dir))
    return out.withColumns(
        {
            **{c: F.round(c, 2) for c in ("viajes_exp", "bici_exp", "caminata_exp")},
            **{c: r4(F.col(c)) for c in ("nomot_pct", "bici_pct")},
        }
    )


@query(
    "mode_summary",
    f"""
WITH {TRIPS}
SELECT ciudad, anio, cod, count(*) AS n, round(sum(f), 2) AS viajes,
       round(100 * sum(f) / sum(sum(f)) OVER (PARTITION BY ciudad, anio), 4) AS pct
FROM t GROUP BY 1, 2, 3
""",
)
def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.mode_summary(trips(spark, sf_dir))
    return out.withColumns({"viajes": F.round("viajes", 2), "pct": r4(F.col("pct"))})


@query(
    "survey_profile",
    f"""
WITH {TRIPS}
SELECT ciudad, anio, dim, valor, round(sum(f), 2) AS viajes FROM (
  SELECT ciudad, anio, f, 'proposito' AS dim, proposito AS valor FROM b WHERE bici
  UNION ALL SELECT ciudad, anio, f, 'periodo', periodo FROM b WHERE bici
  UNION ALL SELECT ciudad, anio, f, 'hora', CAST(hora AS VARCHAR) FROM b WHERE bici)
WHERE valor IS NOT NULL GROUP BY 1, 2, 3, 4
""",
)
def survey_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bike_profile(trips(spark, sf_dir)).withColumn("viajes", F.round("viajes", 2))


@query(
    "profile_top",
    f"""
WITH {TRIPS}, p AS (
  SELECT dim, valor, sum(f) AS viajes FROM (
    SELECT f, 'proposito' AS dim, proposito AS valor FROM b WHERE bici
    UNION ALL SELECT f, 'periodo', periodo FROM b WHERE bici
    UNION ALL SELECT f, 'hora', CAST(hora AS VARCHAR) FROM b WHERE bici)
  WHERE valor IS NOT NULL GROUP BY 1, 2)
SELECT dim, valor, round(viajes, 2) AS viajes FROM p QUALIFY row_number() OVER (PARTITION BY dim ORDER BY viajes DESC, valor) <= 10
""",
)
def profile_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = S.top_profile(S.bike_profile(trips(spark, sf_dir)), 10)
    return top.withColumn("viajes", F.round("viajes", 2))


@query(
    "survey_zones",
    f"""
WITH {TRIPS}
SELECT ciudad, anio, lado, zona, round(sum(f), 2) AS viajes, count(*) AS n FROM (
  SELECT ciudad, anio, f, 'origen' AS lado, zona_o AS zona FROM b WHERE bici
  UNION ALL SELECT ciudad, anio, f, 'destino', zona_d FROM b WHERE bici)
GROUP BY 1, 2, 3, 4
""",
)
def survey_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.zone_sides(trips(spark, sf_dir)).withColumn("viajes", F.round("viajes", 2))


_CROSS = f"""
WITH {TRIPS}, x AS (
  SELECT ciudad, anio, dim, valor, round_even(round(coalesce(sum(f) FILTER (bici), 0), 5), 1) AS bici, round_even(round(sum(f), 5), 1) AS total,
         CASE WHEN sum(f) > 0 THEN round_even(round(100 * coalesce(sum(f) FILTER (bici), 0) / sum(f), 7), 3) END AS part
  FROM (
    SELECT ciudad, anio, f, bici, 'sexo' AS dim, sexo AS valor FROM b
    UNION ALL SELECT ciudad, anio, f, bici, 'proposito', proposito FROM b
    UNION ALL SELECT ciudad, anio, f, bici, 'hora', CAST(hora AS VARCHAR) FROM b
    UNION ALL SELECT ciudad, anio, f, bici, 'hora_prop', CAST(hora AS VARCHAR) || '|' || proposito FROM b)
  WHERE valor IS NOT NULL GROUP BY 1, 2, 3, 4)
"""


@query("crosstab_share", _CROSS + "SELECT * FROM x")
def crosstab_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.crosstab(trips(spark, sf_dir))


@query(
    "crosstab_national",
    _CROSS
    + "SELECT dim, valor, round(sum(bici), 1) AS bici, round(sum(total), 1) AS total, round(100 * sum(bici) / nullif(sum(total), 0), 4) AS part FROM x GROUP BY 1, 2",
)
def crosstab_national(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.national_crosstab(S.crosstab(trips(spark, sf_dir)))
    return out.withColumns({"bici": F.round("bici", 1), "total": F.round("total", 1), "part": r4(F.col("part"))})


@query(
    "hour_purpose",
    _CROSS
    + """SELECT ciudad, anio, CAST(split_part(valor, '|', 1) AS INTEGER) AS hora, substr(valor, instr(valor, '|') + 1) AS proposito, bici, total, part
FROM x WHERE dim = 'hora_prop'""",
)
def hour_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hour_purpose(S.crosstab(trips(spark, sf_dir)))


@query(
    "gender_ratio",
    _CROSS
    + """SELECT ciudad, round(max(part) FILTER (valor = 'Hombre') / nullif(max(part) FILTER (valor = 'Mujer'), 0), 4) AS razon
FROM x WHERE dim = 'sexo' GROUP BY 1""",
)
def gender_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gender_ratio(S.crosstab(trips(spark, sf_dir))).withColumn("razon", r4(F.col("razon")))


@query(
    "hour_formats",
    """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS stamp,
       CAST(CASE WHEN round_even((hour(ts) * 60 + minute(ts)) / 1440.0 * 24, 0) <= 23 THEN round_even((hour(ts) * 60 + minute(ts)) / 1440.0 * 24, 0) END AS INTEGER) AS fraction,
       CAST(hour(ts) AS INTEGER) AS bare, CAST(CASE WHEN value <= 23 THEN round_even(value, 0) END AS INTEGER) AS valid
FROM events
""",
)
def hour_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of_day = (F.hour("ts") * 60 + F.minute("ts")) / F.lit(1440.0)
    return e.select(
        "event_id",
        trip_hour(F.date_format("ts", "'1899-12-30 'HH:mm:ss")).alias("stamp"),
        trip_hour(of_day.cast("string")).alias("fraction"),
        trip_hour(F.concat(F.hour("ts").cast("string"), F.lit(".0"))).alias("bare"),
        valid_hour(F.col("value")).alias("valid"),
    )


@query(
    "hour_dense",
    f"""
WITH {TRIPS}, h AS (SELECT ciudad, hora, sum(f) AS f FROM b WHERE bici GROUP BY 1, 2)
SELECT c.ciudad, CAST(g.hora AS INTEGER) AS hora, round(coalesce(h.f, 0), 2) AS viajes
FROM (SELECT DISTINCT ciudad FROM h) c CROSS JOIN (SELECT unnest(range(24)) AS hora) g LEFT JOIN h ON h.ciudad = c.ciudad AND h.hora = g.hora
""",
)
def hour_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = S.prepare(trips(spark, sf_dir))
    marked = S.mark_bike(base, S.walking_codes(base)).where("bici")
    profile = marked.groupBy("ciudad", F.lit("hora").alias("dim"), trip_hour(F.col("hora_inicio")).cast("string").alias("valor")).agg(
        F.sum("f").alias("viajes")
    )
    out = S.hour_rows(S.hour_vector(profile))
    return out.withColumn("viajes", F.round("viajes", 2))


_MEDIAN_SQL = """SELECT {keys}, min({v}) FILTER (cum >= tot / 2) AS {name} FROM (
  SELECT {keys}, {v}, sum(w) OVER (PARTITION BY {keys} ORDER BY {v} ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY {keys}) AS tot
  FROM (SELECT {keys}, {v}, sum({w}) AS w FROM {src} WHERE {v} IS NOT NULL AND {w} > 0 GROUP BY ALL)) GROUP BY ALL"""


@query(
    "weighted_median",
    f"""
WITH m AS ({_MEDIAN_SQL.format(keys='l_returnflag, l_linestatus', v='l_extendedprice', w='l_quantity', src='lineitem', name='median')})
SELECT m.*, a.mean FROM m JOIN (SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean
FROM lineitem GROUP BY 1, 2) a USING (l_returnflag, l_linestatus)
""",
)
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbers import weighted_mean

    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    medians = R.weighted_lower_median(lines, keys, "l_extendedprice", "l_quantity").drop("total_weight")
    means = lines.groupBy(*keys).agg(
        F.round(weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean")
    )
    return medians.join(means, keys)


@query(
    "weighted_median_decimal",
    """
WITH v AS (SELECT l_linenumber, l_quantity AS v, sum(CAST(l_discount AS DECIMAL(28, 12))) AS w FROM lineitem WHERE l_discount > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_linenumber ORDER BY v) AS cum, sum(w) OVER (PARTITION BY l_linenumber) AS total FROM v)
SELECT l_linenumber, min(CAST(v AS DOUBLE)) AS median FROM c WHERE 2 * cum >= total GROUP BY 1
""",
)
def weighted_median_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in hundredths: halves are met exactly, not in binary."""
    lines = table(spark, sf_dir, "lineitem")
    return R.weighted_lower_median(lines, ["l_linenumber"], "l_quantity", "l_discount").drop("total_weight")


@query(
    "travel_times",
    f"""
WITH {TRIPS}, v AS (SELECT *, CASE WHEN k * 4 - 20 > 0 AND k * 4 - 20 <= 300 THEN CAST(k * 4 - 20 AS DOUBLE) END AS tt FROM b), bv AS (SELECT * FROM v WHERE bici),
a AS ({_MEDIAN_SQL.format(keys='ciudad, anio', v='tt', w='f', src='v', name='tiempo_med_min')}),
c AS ({_MEDIAN_SQL.format(keys='ciudad, anio', v='tt', w='f', src='bv', name='tiempo_med_bici_min')})
SELECT n.ciudad, n.anio, n_bici, tiempo_med_min, tiempo_med_bici_min,
       CASE WHEN tiempo_med_min - tiempo_med_bici_min > 0 THEN tiempo_med_min - tiempo_med_bici_min END AS minutos_menos
FROM (SELECT ciudad, anio, count(*) FILTER (bici) AS n_bici FROM b GROUP BY 1, 2) n LEFT JOIN a USING (ciudad, anio) LEFT JOIN c USING (ciudad, anio)
""",
)
def travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.time_gap(S.travel_time_medians(trips(spark, sf_dir)))


_BANDS = f"""
WITH {TRIPS}, d AS (SELECT ciudad, anio, modo, least(floor(k / 10.0), 8) AS band, f FROM (
  SELECT *, 'todos' AS modo FROM b UNION ALL SELECT *, 'bicicleta' FROM b WHERE bici)),
g AS (SELECT c.ciudad, c.anio, c.modo, t.i, coalesce(sum(d.f), 0) AS f, any_value(c.tot) AS tot
      FROM (SELECT ciudad, anio, modo, sum(f) AS tot FROM d GROUP BY 1, 2, 3) c CROSS JOIN (SELECT unnest(range(9)) AS i) t
      LEFT JOIN d ON d.ciudad = c.ciudad AND d.anio = c.anio AND d.modo = c.modo AND d.band = t.i GROUP BY 1, 2, 3, 4),
x AS (SELECT ciudad, anio, modo, CASE WHEN i = 8 THEN '8+' ELSE CAST(i AS VARCHAR) || '-' || CAST(i + 1 AS VARCHAR) END AS tramo,
      round_even(round(f, 5), 1) AS viajes, round_even(round(100 * f / tot, 7), 3) AS part FROM g)
"""


@query("distance_bands", _BANDS + "SELECT * FROM x")
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distance_bands(trips(spark, sf_dir))


@query(
    "distance_cumulative",
    _BANDS
    + """, n AS (SELECT modo, tramo, sum(viajes) AS v FROM x GROUP BY 1, 2), p AS (SELECT modo, tramo, 100 * v / sum(v) OVER (PARTITION BY modo) AS p FROM n)
SELECT modo, tramo, round(sum(p) OVER (PARTITION BY modo ORDER BY tramo ROWS UNBOUNDED PRECEDING), 4) AS acum,
       round(sum(p) FILTER (tramo <> '8+') OVER (PARTITION BY modo), 4) AS bajo_8 FROM p""",
)
def distance_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.cumulative_bands(S.national_bands(S.distance_bands(trips(spark, sf_dir))))
    return out.withColumns({"acum": r4(F.col("acum")), "bajo_8": r4(F.col("bajo_8"))})


_MODED = f"""
WITH {TRIPS}, v AS (SELECT ciudad, anio, modo, k / 10.0 AS d, f FROM (
  SELECT *, 'todos' AS modo FROM b UNION ALL SELECT *, 'bicicleta' FROM b WHERE bici)),
med AS ({_MEDIAN_SQL.format(keys='ciudad, anio, modo', v='d', w='f', src='v', name='dist_mediana_km')}),
avg_ AS (SELECT ciudad, anio, modo, round_even(round(sum(d * f) / sum(f), 7), 3) AS dist_media_km, round_even(round(sum(f), 5), 1) AS viajes FROM v GROUP BY 1, 2, 3)
"""


@query("distance_summary", _MODED + "SELECT ciudad, anio, modo, dist_media_km, viajes, dist_mediana_km FROM avg_ JOIN med USING (ciudad, anio, modo)")
def distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distance_summary(trips(spark, sf_dir))


@query(
    "haversine_od",
    """
WITH z AS (SELECT n_nationkey AS k, -75 + n_nationkey * 0.3 AS lon, -20 - n_nationkey * 1.2 AS lat,
                  CASE WHEN n_regionkey <> 2 THEN sqrt((1 + n_nationkey) / pi()) END AS r FROM nation),
l AS (SELECT l_suppkey, o_custkey, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
t AS (SELECT c_nationkey AS o, s_nationkey AS d, l_quantity FROM l JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
h AS (SELECT a.k AS o, b.k AS d, CASE WHEN a.k = b.k THEN coalesce(0.7 * a.r, 0.5) ELSE
   2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) END AS km
  FROM z a CROSS JOIN z b)
SELECT CAST(o AS INTEGER) AS o, CAST(d AS INTEGER) AS d, count(*) AS n, round(min(km), 4) AS km, round(sum(km * l_quantity) / sum(l_quantity), 4) AS media FROM t JOIN h USING (o, d) GROUP BY 1, 2
""",
)
def haversine_od(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.geo import equivalent_radius
    from ..functions.numbers import weighted_mean

    key = F.col("n_nationkey")
    centroids = table(spark, sf_dir, "nation").select(
        F.lit("todas").alias("ciudad"),
        F.concat(key.cast("string"), F.lit(".0")).alias("zona"),
        (key * 0.3 - 75).alias("lon"),
        (key * -1.2 - 20).alias("lat"),
        equivalent_radius(F.when(F.col("n_regionkey") != 2, 1.0 + key)).alias("radio_km"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("o"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("d"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    moved = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_suppkey", "l_quantity")
        .join(orders, "l_orderkey")
        .join(customers, "o_custkey")
        .join(suppliers, "l_suppkey")
        .groupBy("o", "d")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("w"))
        .withColumns(
            {"ciudad": F.lit("todas"), "zona_origen": F.col("o").cast("string"), "zona_destino": F.col("d").cast("string")}
        )
    )
    out = S.trip_distances(moved, centroids)
    return out.groupBy("o", "d").agg(
        F.sum("n").alias("n"),
        r4(F.min("dist_km")).alias("km"),
        r4(weighted_mean(F.col("dist_km"), F.col("w"))).alias("media"),
    )


_OFFICIAL = f"""
WITH {TRIPS}, c AS (
  SELECT ciudad, anio, sum(f) AS v, sum(f) FILTER (bici) AS bi, sum(f) FILTER (nm AND NOT bici) AS ca, sum(f) FILTER (nm) AS nm FROM b GROUP BY 1, 2),
i AS (SELECT ciudad, v AS viajes_diarios, CASE WHEN ciudad LIKE '%3' THEN 0 ELSE ca * 1.01 END AS w, CASE WHEN ciudad LIKE '%3' THEN nm ELSE bi * 0.97 END AS u FROM c WHERE ciudad <> 'Ciudad 7'),
j AS (SELECT c.ciudad, c.anio, 100 * bi / v AS bici_pct, 100 * u / viajes_diarios AS ofi_bici_pct,
       coalesce(abs(100 * (u + w) / viajes_diarios - 100 * nm / v) <= 2 AND w > 0 AND w > u, FALSE) AS indice_consistente
  FROM c LEFT JOIN i USING (ciudad))
"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = S.city_summary(trips(spark, sf_dir))
    third = F.col("ciudad").endswith("3")
    official = summary.where(F.col("ciudad") != "Ciudad 7").select(
        F.upper("ciudad").alias("ciudad"),
        F.col("viajes_exp").alias("viajes_diarios"),
        F.when(third, F.lit(0.0)).otherwise(F.col("caminata_exp") * 1.01).alias("v_caminata"),
        F.when(third, F.col("bici_exp") + F.col("caminata_exp")).otherwise(F.col("bici_exp") * 0.97).alias("v_no_motorizado"),
    )
    return S.against_official(summary, official)


@query(
    "official_validation",
    _OFFICIAL
    + """SELECT ciudad, anio, round(bici_pct, 4) AS bici_pct, round(ofi_bici_pct, 4) AS ofi_bici_pct, indice_consistente,
       round(bici_pct - ofi_bici_pct, 4) AS dif_pp, CASE WHEN indice_consistente THEN round(ofi_bici_pct, 4) END AS ofi,
       coalesce(abs(bici_pct - ofi_bici_pct) > 0.5, FALSE) AS discrepa FROM j""",
)
def official_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = S.city_ranking(_validated(spark, sf_dir))
    flagged = F.coalesce(F.abs("dif_pp") > 0.5, F.lit(False))
    return ranked.select(
        "ciudad",
        "anio",
        r4(F.col("bici_pct")).alias("bici_pct"),
        r4(F.col("ofi_bici_pct")).alias("ofi_bici_pct"),
        "indice_consistente",
        r4(F.col("dif_pp")).alias("dif_pp"),
        r4(F.col("ofi")).alias("ofi"),
        flagged.alias("discrepa"),
    )


@query(
    "validation_summary",
    _OFFICIAL
    + """SELECT indice_consistente, count(*) AS n, round(corr(bici_pct, ofi_bici_pct), 4) AS r,
       round(avg(abs(bici_pct - ofi_bici_pct)), 4) AS mean_abs, round(max(abs(bici_pct - ofi_bici_pct)), 4) AS max_abs
  FROM j WHERE ofi_bici_pct IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""",
)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _validated(spark, sf_dir).where(F.col("ofi_bici_pct").isNotNull())
    r = R.pearson(v, ["indice_consistente"], "bici_pct", "ofi_bici_pct").drop("n")
    both = [F.lit(True), F.lit(False)]
    parts = [
        Q.difference_summary(v.where(F.col("indice_consistente") == flag), "dif_pp").withColumn("indice_consistente", flag)
        for flag in both
    ]
    out = parts[0].union(parts[1]).join(r, "indice_consistente").where(F.col("n") >= 3)
    return out.withColumns({c: r4(F.col(c)) for c in ("r", "mean_abs", "max_abs")})


@query(
    "difference_report",
    _OFFICIAL
    + "SELECT ciudad, round(bici_pct - ofi_bici_pct, 4) AS dif_pp FROM j WHERE abs(bici_pct - ofi_bici_pct) > 0.3",
)
def difference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.difference_report(_validated(spark, sf_dir), "bici_pct", "ofi_bici_pct", 0.3)
    return out.select("ciudad", r4(F.col("dif_pp")).alias("dif_pp"))


@query(
    "city_kpis",
    _MODED
    + f""", vt AS (SELECT ciudad, anio, CAST(k * 4 - 20 AS DOUBLE) AS tt, f FROM b WHERE k * 4 - 20 > 0 AND k * 4 - 20 <= 300),
tm AS ({_MEDIAN_SQL.format(keys='ciudad, anio', v='tt', w='f', src='vt', name='tiempo_med_min')}),
ix AS (SELECT 'CIUDAD ' || CAST(n_nationkey AS VARCHAR) AS ciudad, n_regionkey AS n_zonas FROM nation)
SELECT coalesce(upper(replace(tm.ciudad, ' ', '')), replace(ix.ciudad, ' ', '')) AS k, ix.ciudad, CAST(n_zonas AS INTEGER) AS n_zonas, tiempo_med_min, a.dist_media_km AS dist_media_bici_km
FROM ix FULL JOIN tm ON upper(tm.ciudad) = ix.ciudad LEFT JOIN avg_ a ON a.ciudad = tm.ciudad AND a.modo = 'bicicleta'
""",
)
def city_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trips(spark, sf_dir)
    index = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("CIUDAD "), F.col("n_nationkey").cast("string")).alias("ciudad"), F.col("n_regionkey").alias("n_zonas")
    )
    bike = S.distance_summary(t).where(F.col("modo") == "bicicleta").select("ciudad", F.col("dist_media_km").alias("dist_media_bici_km"))
    out = S.city_kpis(index, S.travel_time_medians(t), bike)
    return out.select("k", "ciudad", "n_zonas", "tiempo_med_min", "dist_media_bici_km")


@query(
    "rank_correlation",
    """
WITH n AS (SELECT c_nationkey AS k, count(*) AS a, round(sum(c_acctbal), 2) AS b, round(max(c_acctbal), -3) AS c FROM customer GROUP BY 1),
r AS (SELECT c.c_nationkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY round(c_acctbal, -3)) + (count(*) OVER (PARTITION BY c_mktsegment, round(c_acctbal, -3)) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) - 1) / 2.0 AS rb, c_mktsegment
      FROM customer c)
SELECT c_mktsegment, count(*) AS n, round(corr(ra, rb), 4) AS rho,
       (SELECT round(corr(round(c_acctbal, -3), c_nationkey), 4) FROM customer x WHERE x.c_mktsegment = r.c_mktsegment) AS r
FROM r GROUP BY 1
""",
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("saldo", F.round("c_acctbal", -3))
    rho = R.spearman(c, ["c_mktsegment"], "saldo", "c_nationkey")
    r = R.pearson(c, ["c_mktsegment"], "saldo", "c_nationkey").drop("n")
    out = rho.join(r, "c_mktsegment")
    return out.withColumns({"rho": r4(F.col("rho")), "r": r4(F.col("r"))})


@query(
    "support_coverage",
    """
WITH z AS (SELECT user_id, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS zonas, count(*) FILTER (n >= 15) AS con_muestra, round(100.0 * count(*) FILTER (n >= 15) / count(*), 4) AS pct,
       round(quantile_cont(v / n, 0.1), 4) AS p10, round(quantile_cont(v / n, 0.9), 4) AS p90, round(max(v / n), 4) AS mayor
FROM z GROUP BY 1
""",
)
def support_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
        .withColumn("razon", F.col("v") / F.col("n"))
    )
    spread = R.quantile_edges(z, ["event_type"], "razon", [0.1, 0.9, 1.0], "q").select(
        "event_type", *[r4(F.col("q")[i]).alias(c) for i, c in enumerate(("p10", "p90", "mayor"))]
    )
    out = Q.support_coverage(z, ["event_type"], "n", 15).withColumn("pct", r4(F.col("pct")))
    return out.join(spread, "event_type")


@query(
    "counter_split",
    """
WITH c AS (SELECT user_id, event_type, avg(value) FILTER (isodow(ts) <= 5) AS hab, avg(value) FILTER (isodow(ts) > 5) AS fds FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS contadores, count(*) FILTER (fds < hab) AS bajan, round(100.0 * count(*) FILTER (fds < hab) / count(*), 4) AS pct
FROM c WHERE hab IS NOT NULL AND fds IS NOT NULL GROUP BY 1
""",
)
def counter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    weekday = F.weekday("ts") < 5
    counters = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", "event_type")
        .agg(F.avg(F.when(weekday, F.col("value"))).alias("hab"), F.avg(F.when(~weekday, F.col("value"))).alias("fds"))
    )
    return M.counter_split(counters, "hab", "fds", ["event_type"]).withColumn("pct", r4(F.col("pct")))


@query(
    "city_communes",
    """
WITH m AS (SELECT n_nationkey, 'COMUNA ' || CAST(n_nationkey AS VARCHAR) AS k FROM nation),
l AS (SELECT r_name AS ciudad, n_nationkey, 'COMUNA ' || CAST(CASE WHEN n_regionkey = 2 THEN n_nationkey + 100 ELSE n_nationkey END AS VARCHAR) AS k FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT l.ciudad, count(m.n_nationkey) AS comunas, count(*) - count(m.n_nationkey) AS sin_resolver,
       count(c.c_custkey) AS personas, count(DISTINCT m.n_nationkey) FILTER (m.k LIKE 'COMUNA 1%') AS encontradas
FROM l LEFT JOIN m USING (k) LEFT JOIN (SELECT min(c_custkey) AS c_custkey, c_nationkey FROM customer GROUP BY 2) c ON c.c_nationkey = m.n_nationkey GROUP BY 1
""",
)
def city_communes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import matches_search

    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    shown = F.when(F.col("n_regionkey") == 2, key + 100).otherwise(key)
    # a city lists its communes by accented names; the master has none
    listed = (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("ciudad"))
        .agg(F.collect_list(F.concat(F.lit("Cómuna  "), shown.cast("string"))).alias("comunas"))
    )
    master = nation.select(F.concat(F.lit("COMUNA "), key.cast("string")).alias("nom"), key.alias("cut_com"))
    found, missing = M.resolve_cities(listed, master)
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("cut_com")).agg(F.min("c_custkey").alias("persona"))
    located = M.city_of_commune(people, found)
    got = found.groupBy("ciudad").agg(
        F.count(F.lit(1)).alias("comunas"), F.count(F.when(matches_search(F.col("nom"), "comuna 1"), 1)).alias("encontradas")
    )
    lost = missing.groupBy("ciudad").agg(F.count(F.lit(1)).alias("sin_resolver"))
    persons = located.where(F.col("ciudad").isNotNull()).groupBy("ciudad").agg(F.count(F.lit(1)).alias("personas"))
    return (
        listed.select("ciudad")
        .join(got, "ciudad", "left")
        .join(lost, "ciudad", "left")
        .join(persons, "ciudad", "left")
        .na.fill(0)
        .select("ciudad", "comunas", "sin_resolver", "personas", "encontradas")
    )
