"""Coverage and equity queries.

Blocks are customers: nation is the commune, balance the score, orders the
people; the cheapest order stands in for the distance where no geometry is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import coverage as C, nearest, ranks as R
from .base import LIMITS, NEAR, PT, SEG, points, query, r4, segments, table

NEAR_LIMIT = 500

BLOCKS = """o AS (SELECT o_custkey, count(*) AS n_per, count(*) FILTER (o_orderpriority = '1-URGENT') AS bici, min(o_totalprice) / 100 AS dist
      FROM orders GROUP BY 1),
blk AS (SELECT c_custkey, c_nationkey AS cut_com, c_acctbal AS score, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'RURAL' ELSE 'URBANO' END AS area,
        coalesce(n_per, 0) AS n_per, coalesce(bici, 0) AS bici, dist FROM customer LEFT JOIN o ON o_custkey = c_custkey)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count(F.lit(1)).alias("n_per"),
            F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("bici"),
            (F.min("o_totalprice") / 100).alias("dist"),
        )
    )
    return (
        table(spark, sf_dir, "customer")
        .select(
            "c_custkey",
            F.col("c_nationkey").alias("cut_com"),
            F.col("c_acctbal").alias("score"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "RURAL").otherwise("URBANO").alias("area"),
        )
        .join(per, "c_custkey", "left")
        .na.fill(0, ["n_per", "bici"])
    )


def measured_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with their distance to the network."""
    p = points(spark, sf_dir)
    near = nearest.nearest_distance(
        nearest.point_pieces(p, "x", "y", ["vec_id"]), segments(spark, sf_dir), "vec_id"
    )
    return p.join(near, "vec_id", "left")


def _curve_sql() -> str:
    rows = [
        f"""SELECT CAST({u} AS DOUBLE) AS threshold, coalesce(CAST(sum(people) FILTER (dist <= {u}) AS DOUBLE), 0) AS pob,
  round(100.0 * coalesce(sum(people) FILTER (dist <= {u}), 0) / sum(people), 4) AS pct_pob,
  coalesce(CAST(sum(riders) FILTER (dist <= {u}) AS DOUBLE), 0) AS bici, round(100.0 * coalesce(sum(riders) FILTER (dist <= {u}), 0) / sum(riders), 4) AS pct_bici FROM b"""
        for u in LIMITS
    ]
    return f"WITH {SEG}, {PT}, {NEAR}, b AS (SELECT * FROM pt JOIN near USING (vec_id))\n" + "\nUNION ALL ".join(rows)


@query("coverage_curve", _curve_sql())
def coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.coverage_curve(measured_points(spark, sf_dir), "dist", "people", "riders", LIMITS)
    return out.withColumns(
        {
            **{c: F.col(c).cast("double") for c in ("pob", "bici")},
            **{c: r4(F.col(c)) for c in ("pct_pob", "pct_bici")},
        }
    )


def _commune_sql() -> str:
    cols = ", ".join(
        f"CAST(coalesce(sum(n_per) FILTER (dist <= {u}), 0) AS DOUBLE) AS pob_cub_{u}, CAST(coalesce(sum(bici) FILTER (dist <= {u}), 0) AS DOUBLE) AS bici_cub_{u}, "
        f"round(100.0 * coalesce(sum(n_per) FILTER (dist <= {u}), 0) / nullif(sum(n_per), 0), 4) AS pct_pob_{u}, "
        f"round(100.0 * coalesce(sum(bici) FILTER (dist <= {u}), 0) / nullif(sum(bici), 0), 4) AS pct_bici_{u}"
        for u in (150, 500, 1000)
    )
    return f"""WITH {BLOCKS}
SELECT cut_com, CAST(sum(n_per) AS DOUBLE) AS pob, count(*) AS manzanas, CAST(sum(bici) AS DOUBLE) AS bici, round(sum(score * n_per) / nullif(sum(n_per), 0), 4) AS nse_score_pob, {cols}
FROM blk GROUP BY 1"""


@query("commune_coverage", _commune_sql())
def commune_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.commune_coverage(blocks(spark, sf_dir), ["cut_com"], "dist", "n_per", "bici", "score", (150, 500, 1000))
    return out.select(
        "cut_com",
        "manzanas",
        *[F.col(c).cast("double").alias(c) for c in out.columns if c in ("pob", "bici") or "_cub_" in c],
        *[r4(F.col(c)).alias(c) for c in out.columns if c.startswith(("pct_", "nse_"))],
    )


_U = f"WITH {BLOCKS}, u AS (SELECT * FROM blk WHERE area = 'URBANO' AND score IS NOT NULL AND n_per > 0)"
_WITHIN = (
    _U
    + """, e AS (SELECT cut_com, quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q, count(DISTINCT score) AS d FROM u GROUP BY 1),
g AS (SELECT u.*, CASE WHEN d >= 5 THEN len(list_filter(q, lambda x: u.score > x)) END AS q5 FROM u JOIN e USING (cut_com))
"""
)


@query(
    "nse_gradient",
    _U
    + """, e AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM u), g AS (SELECT u.*, len(list_filter(q, lambda x: u.score > x)) AS b FROM u, e)
SELECT CAST(b AS INTEGER) AS q, CAST(sum(n_per) AS DOUBLE) AS pob, round(100.0 * coalesce(sum(n_per) FILTER (dist <= 500), 0) / sum(n_per), 4) AS pct_cubierta,
       round(100.0 * sum(bici) / sum(n_per), 4) AS pct_bici FROM g GROUP BY 1""",
)
def nse_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = C.universe(blocks(spark, sf_dir), "area", "score", "n_per")
    out = C.gradient(u, "score", "dist", "n_per", "bici", "n_per", NEAR_LIMIT)
    return out.select("q", F.col("pob").cast("double").alias("pob"), r4(F.col("pct_cubierta")).alias("pct_cubierta"), r4(F.col("pct_bici")).alias("pct_bici"))


@query(
    "nse_gradient_within",
    _WITHIN
    + """SELECT CAST(q5 AS INTEGER) AS q, CAST(sum(n_per) AS DOUBLE) AS pob, round(100.0 * coalesce(sum(n_per) FILTER (dist <= 500), 0) / sum(n_per), 4) AS pct_cubierta
FROM g WHERE q5 IS NOT NULL GROUP BY 1""",
)
def nse_gradient_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = C.universe(blocks(spark, sf_dir), "area", "score", "n_per")
    out = C.gradient_within(u, ["cut_com"], "score", "dist", "n_per", NEAR_LIMIT)
    return out.select("q", F.col("pob").cast("double").alias("pob"), r4(F.col("pct_cubierta")).alias("pct_cubierta"))


@query(
    "equity_gap",
    _WITHIN
    + """, p AS (SELECT cut_com, q5, 100.0 * coalesce(sum(n_per) FILTER (dist <= 500), 0) / sum(n_per) AS r FROM g GROUP BY 1, 2)
SELECT cut_com, round(max(r) FILTER (q5 = 4) - max(r) FILTER (q5 = 0), 4) + 0.0 AS brecha_nse FROM p GROUP BY 1""",
)
def equity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = C.universe(blocks(spark, sf_dir), "area", "score", "n_per")
    out = C.equity_gap(u, ["cut_com"], "score", "dist", "n_per", NEAR_LIMIT)
    return out.withColumn("brecha_nse", r4(F.col("brecha_nse")))


@query(
    "modal_share",
    """
WITH m AS (SELECT c_nationkey AS cut_com, count(*) FILTER (o_orderpriority = '1-URGENT') AS a, count(*) FILTER (o_orderpriority = '2-HIGH') AS b,
    count(*) FILTER (o_orderpriority = '3-MEDIUM') AS c, count(*) FILTER (o_orderpriority = '5-LOW') AS d
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT cut_com, CAST(a AS DOUBLE) AS auto, CAST(b AS DOUBLE) AS publico, CAST(c AS DOUBLE) AS camina, CAST(d AS DOUBLE) AS bicicleta,
       CAST(a + b + c + d AS DOUBLE) AS viajes_modo, round(100.0 * d / nullif(a + b + c + d, 0), 4) AS bici_pct FROM m
""",
)
def modal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"auto": "1-URGENT", "publico": "2-HIGH", "camina": "3-MEDIUM", "bicicleta": "5-LOW"}
    per = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(*[F.count(F.when(F.col("o_orderpriority") == v, 1)).alias(k) for k, v in codes.items()])
    )
    people = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cut_com"))
    out = C.modal_totals(people.join(per, "c_custkey", "left"), ["cut_com"], list(codes), "bicicleta")
    return out.select(
        "cut_com",
        *[F.col(c).cast("double").alias(c) for c in (*codes, "viajes_modo")],
        r4(F.col("bici_pct")).alias("bici_pct"),
    )


@query(
    "access_rates",
    f"""
WITH {SEG}, {PT}, {NEAR}, b AS (SELECT CASE WHEN score > 0 THEN 'escolar' ELSE 'superior' END AS clase, CASE WHEN score > 0 THEN people END AS m, dist
  FROM pt JOIN near USING (vec_id) WHERE label IN (SELECT n_regionkey FROM nation))
SELECT clase, count(*) AS n, round(100.0 * count(*) FILTER (dist <= 5) / count(*), 4) AS pct_5, round(100.0 * count(*) FILTER (dist <= 20) / count(*), 4) AS pct_20,
       round(100.0 * count(*) FILTER (dist <= 50) / count(*), 4) AS pct_50, count(m) AS n_matricula, CAST(coalesce(sum(m), 0) AS DOUBLE) AS matricula,
       CAST(coalesce(sum(m) FILTER (dist <= 5), 0) AS DOUBLE) AS matricula_cerca, round(100.0 * coalesce(sum(m) FILTER (dist <= 5), 0) / nullif(sum(m), 0), 4) AS pct_matricula
FROM b GROUP BY 1
""",
)
def access_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = measured_points(spark, sf_dir)
    # schools declare enrolment, higher education does not
    schools = p.where(F.col("score") > 0).select(F.lit("escolar").alias("clase"), "label", "dist", F.col("people").alias("matricula"))
    higher = p.where(~(F.col("score") > 0)).select(F.lit("superior").alias("clase"), "label", "dist")
    places = schools.unionByName(higher, allowMissingColumns=True)
    known = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("label")).distinct()
    out = C.access_rates(places.join(known, "label", "left_semi"), "clase", "dist", "matricula", (5, 20, 50))
    return out.withColumns(
        {
            **{c: F.col(c).cast("double") for c in ("matricula", "matricula_cerca")},
            **{c: r4(F.col(c)) for c in out.columns if c.startswith("pct_")},
        }
    )


_ZONES = f"""
WITH {SEG}, {PT}, {NEAR}, z AS (SELECT CAST(floor(x / 100) AS BIGINT) AS zx, CAST(floor(y / 100) AS BIGINT) AS zy, CAST(sum(people) AS DOUBLE) AS pob, CAST(sum(riders) AS DOUBLE) AS bici,
  100.0 * sum(riders) / nullif(sum(people), 0) AS bici_pct, sum(dist * people) / nullif(sum(people), 0) AS dist_m FROM pt JOIN near USING (vec_id) GROUP BY 1, 2)
"""


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.marts import zone_aggregate

    p = measured_points(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 100)
    blocks_ = p.withColumn("zona", F.struct(cell("x").alias("zx"), cell("y").alias("zy")))
    out = zone_aggregate(blocks_, "zona", [], "people", "riders", "people", "dist")
    return out.select("zona", "zona.zx", "zona.zy", "pob", "bici", "bici_pct", "dist_m")


@query(
    "unmet_demand",
    _ZONES + "SELECT zx, zy, pob, bici, round(bici_pct, 4) AS bici_pct, round(dist_m, 4) AS dist_m FROM z WHERE bici_pct > 9 AND dist_m > 15",
)
def unmet_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.unmet_demand(_zones(spark, sf_dir), "bici_pct", "dist_m", 9, 15)
    return out.select(
        "zx", "zy", F.col("pob").cast("double").alias("pob"), F.col("bici").cast("double").alias("bici"),
        r4(F.col("bici_pct")).alias("bici_pct"), r4(F.col("dist_m")).alias("dist_m"),
    )


@query(
    "top_zones",
    _ZONES + "SELECT zx, zy, round(bici_pct, 4) AS bici_pct FROM z WHERE pob >= 500 ORDER BY z.bici_pct DESC, zx, zy LIMIT 10",
)
def top_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.top_zones(_zones(spark, sf_dir), "bici_pct", "pob")
    return out.select("zx", "zy", r4(F.col("bici_pct")).alias("bici_pct"))


@query(
    "quantile_edges",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.0), 4) AS q0, round(quantile_cont(l_extendedprice, 0.2), 4) AS q20, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
       round(quantile_cont(l_extendedprice, 0.8), 4) AS q80, round(quantile_cont(l_extendedprice, 1.0), 4) AS q100, count(*) AS n FROM lineitem GROUP BY 1""",
)
def quantile_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["q0", "q20", "q50", "q80", "q100"]
    edges = R.quantile_edges(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0, 0.2, 0.5, 0.8, 1], "e")
    return edges.select("l_returnflag", *[r4(F.col("e")[i]).alias(n) for i, n in enumerate(names)], "n")
