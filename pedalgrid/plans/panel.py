"""Panel, keys, data quality and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import numbers as N, text as X
from ..operators import panel as P, quality as Q
from ..sources import catalog as C
from .base import query, r4, table


@query(
    "clean_text_key",
    r"""
WITH d AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) || '.0' AS code, '  ' || chr(160) || lang || chr(160) || ' Ñuñoa ' || source || ' ' AS place, text
  FROM documents),
k AS (
  SELECT doc_id, code, place, nullif(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')), '') AS clean,
         regexp_replace(upper(strip_accents(text)), '[^A-Z0-9]', '', 'g') AS k
  FROM d)
SELECT doc_id, CAST(length(clean) AS INTEGER) AS clean_chars, md5(clean) AS clean_md5,
       md5(k) AS key_md5,
       nullif(trim(regexp_replace(place, '[\s\x{00A0}]+', ' ', 'g')), '') AS place_clean,
       regexp_replace(upper(strip_accents(place)), '[^A-Z0-9]', '', 'g') AS place_key,
       CASE WHEN length(regexp_replace(trim(code), '\.0$', '')) < 5
            THEN lpad(regexp_replace(trim(code), '\.0$', ''), 5, '0')
            ELSE regexp_replace(trim(code), '\.0$', '') END AS code
FROM k
""",
)
def clean_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    place = F.concat(F.lit("   "), "lang", F.lit("  Ñuñoa "), "source", F.lit(" "))
    clean = X.clean_text(F.col("text"))
    return d.select(
        "doc_id",
        F.length(clean).alias("clean_chars"),
        F.md5(clean.cast("binary")).alias("clean_md5"),
        F.md5(X.alnum_key(F.col("text")).cast("binary")).alias("key_md5"),
        X.clean_text(place).alias("place_clean"),
        X.name_key(place).alias("place_key"),
        X.repair_code(F.concat(F.col("doc_id").cast("string"), F.lit(".0"))).alias("code"),
    )


_SNAPSHOT_FIELDS = {
    "identifica": ["c_custkey", "s_suppkey"],
    "comuna": ["c_nationkey", "s_nationkey"],
    "km": ["c_acctbal", "s_acctbal"],
    "etapa": ["c_mktsegment"],
}


@query(
    "panel_union",
    """
WITH panel AS (
  SELECT 'customers' AS corte, c_nationkey AS comuna, c_mktsegment AS etapa, c_acctbal AS km FROM customer
  UNION ALL
  SELECT 'suppliers', s_nationkey, NULL, s_acctbal FROM supplier)
SELECT corte, comuna, etapa, round(sum(km), 2) AS km, count(*) AS tramos FROM panel GROUP BY ALL
""",
)
def panel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        P.snapshot(table(spark, sf_dir, "customer"), "customers", _SNAPSHOT_FIELDS),
        P.snapshot(table(spark, sf_dir, "supplier"), "suppliers", _SNAPSHOT_FIELDS),
    ]
    out = P.summary(P.union_snapshots(parts), ["corte", "comuna", "etapa"], ["km"])
    return out.withColumn("km", F.round("km", 2))


@query(
    "network_evolution",
    """
WITH y AS (
  SELECT year(o_orderdate) AS corte, sum(o_totalprice) AS km, count(*) AS tramos, count(DISTINCT o_custkey) AS comunas
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT CAST(corte AS INTEGER) AS corte, round(km, 2) AS km, tramos, comunas,
       round(km - lag(km) OVER (ORDER BY corte), 2) AS delta_km
FROM y
""",
)
def network_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")
    out = P.network_by_snapshot(
        o.withColumn("corte", F.year("o_orderdate")), "corte", "o_totalprice", "o_custkey"
    )
    return out.withColumns({"km": F.round("km", 2), "delta_km": F.round("delta_km", 2)})


_RESOLVED = """
WITH c AS (
  SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
         CASE WHEN c_acctbal < 0 THEN '0.0' WHEN c_acctbal < 1000 THEN '99' ELSE CAST(100 + c_nationkey AS VARCHAR) || '.0' END AS code,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' ELSE 'NATION' || CAST(c_nationkey AS VARCHAR) END AS k
  FROM customer),
m AS (SELECT lpad(CAST(100 + n_nationkey AS VARCHAR), 5, '0') AS cut, replace(n_name, '_', '') AS k FROM nation),
r AS (
  SELECT c.*, coalesce(d.cut, b.cut) AS cut_com,
         CASE WHEN d.cut IS NOT NULL THEN 'declarado' WHEN b.cut IS NOT NULL THEN 'nombre' ELSE 'sin_resolver' END AS cut_com_origen
  FROM c LEFT JOIN m d ON d.cut = lpad(regexp_replace(c.code, '\\.0$', ''), 5, '0') LEFT JOIN m b ON b.k = c.k)
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    nation = F.col("c_nationkey").cast("string")
    customers = table(spark, sf_dir, "customer").select(
        "*",
        F.when(balance < 0, "0.0")
        .when(balance < 1000, "99")
        .otherwise(F.concat((F.col("c_nationkey") + 100).cast("string"), F.lit(".0")))
        .alias("code"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "unknown")
        .otherwise(F.concat(F.lit(" natión "), nation))
        .alias("place"),
    )
    master = table(spark, sf_dir, "nation").select(
        X.zero_pad((F.col("n_nationkey") + 100).cast("string")).alias("cut"), F.col("n_name").alias("comuna")
    )
    found = P.resolve_key(customers, Q.require_master(master, "cut", "comuna"), "code", "place")
    return Q.require_domain(found, master.withColumnRenamed("cut", "cut_com"), "cut_com")


@query(
    "key_resolution",
    _RESOLVED
    + """
SELECT c_custkey, cut_com, cut_com_origen, substr(cut_com, 1, 2) AS cut_reg,
       (c_acctbal > 0 AND coalesce(CAST(floor(c_acctbal / 5000) AS BIGINT) <> CAST(substr(cut_com, 1, 2) AS BIGINT), TRUE)) AS discrepa
FROM r
""",
)
def key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _resolved(spark, sf_dir).withColumn(
        "cut_reg_declarado",
        F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 5000).cast("string")).otherwise("?"),
    )
    return P.region_flags(found).select(
        "c_custkey", "cut_com", "cut_com_origen", "cut_reg", F.col("cut_reg_declarado_discrepa").alias("discrepa")
    )


@query(
    "key_origins",
    _RESOLVED
    + """
SELECT c_mktsegment AS corte, count(*) FILTER (cut_com_origen = 'declarado') AS declarado,
       count(*) FILTER (cut_com_origen = 'nombre') AS nombre, count(*) FILTER (cut_com_origen = 'sin_resolver') AS sin_resolver
FROM r GROUP BY 1
""",
)
def key_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.origin_table(_resolved(spark, sf_dir).withColumn("corte", F.col("c_mktsegment")))


@query(
    "snapshot_diff",
    """
WITH s AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS corte FROM orders),
t AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS corte, sum(o_totalprice) AS km FROM orders GROUP BY 1, 2)
SELECT t.corte, count(*) AS nuevos, round(sum(t.km), 2) AS km
FROM t LEFT JOIN s ON s.o_custkey = t.o_custkey AND s.corte = t.corte - 1
WHERE s.o_custkey IS NULL GROUP BY 1
""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("corte"))
        .agg(F.sum("o_totalprice").alias("km"))
    )
    # each year against the one before it, in a single anti join
    now = per.withColumn("seg", F.struct("o_custkey", "corte"))
    before = per.select(F.struct("o_custkey", (F.col("corte") + 1).alias("corte")).alias("seg"))
    fresh = P.snapshot_diff(now, before, "seg")
    return fresh.groupBy("corte").agg(
        F.count(F.lit(1)).alias("nuevos"), F.round(F.sum("km"), 2).alias("km")
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    marked = docs.withColumn("idioma", F.when(F.col("lang") == "en", N.NO_INFORMATION).otherwise(F.col("lang")))
    return marked.join(table(spark, sf_dir, "labels"), "doc_id", "left")


_PROFILE = """
WITH d AS (
  SELECT d.source, CASE WHEN d.lang = 'en' THEN 's_i' ELSE d.lang END AS idioma, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l USING (doc_id)),
p AS (
  SELECT source, count(*) AS n, 'idioma' AS field, count(*) FILTER (idioma IS NULL) AS nulls, count(*) FILTER (idioma = 's_i') AS marked FROM d GROUP BY 1
  UNION ALL SELECT source, count(*), 'quality', count(*) FILTER (quality IS NULL), 0 FROM d GROUP BY 1
  UNION ALL SELECT source, count(*), 'toxic', count(*) FILTER (toxic IS NULL), 0 FROM d GROUP BY 1)
"""


@query(
    "null_profile",
    _PROFILE
    + """
SELECT source, n, field, nulls, marked, round(100.0 * nulls / n, 4) AS pct_null, round(100.0 * marked / n, 4) AS pct_marked,
       round(100.0 * (nulls + marked) / n, 4) AS pct_uninformed
FROM p
""",
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.null_profile(_labelled(spark, sf_dir), ["idioma", "quality", "toxic"], ["source"])
    return out.withColumns({c: r4(F.col(c)) for c in ("pct_null", "pct_marked", "pct_uninformed")})


@query(
    "null_extremes",
    _PROFILE
    + """
, q AS (SELECT *, 100.0 * (nulls + marked) / n AS u FROM p)
SELECT field, arg_min(source, (u, source)) AS best, round(min(u), 4) AS best_pct,
       arg_min(source, (-u, source)) AS worst, round(max(u), 4) AS worst_pct
FROM q GROUP BY field
""",
)
def null_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = P.null_profile(_labelled(spark, sf_dir), ["idioma", "quality", "toxic"], ["source"])
    out = P.best_and_worst(profile, "source")
    return out.withColumns({c: r4(F.col(c)) for c in ("best_pct", "worst_pct")})


@query(
    "declared_vs_measured",
    """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS declared, round(sum(l_quantity * p_retailprice), 2) AS measured,
       round(abs(100 * (sum(l_extendedprice) - sum(l_quantity * p_retailprice)) / sum(l_extendedprice)), 4) AS pct_diff
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2
""",
)
def declared_vs_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey"
    )
    lines = lines.withColumn("measured", F.col("l_quantity") * F.col("p_retailprice"))
    out = P.declared_vs_measured(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", "measured")
    return out.withColumns(
        {"declared": F.round("declared", 2), "measured": F.round("measured", 2), "pct_diff": r4(F.col("pct_diff"))}
    )


@query(
    "catalogue",
    """
WITH s AS (
  SELECT 'customer' AS slug, 'personas' AS grupo, TRUE AS vigente, count(*) AS n, (SELECT count(DISTINCT o_custkey) FROM orders) AS dec,
         0 AS bare, min(c_acctbal) AS minx, CAST(min(c_nationkey) AS DOUBLE) AS miny FROM customer
  UNION ALL SELECT 'supplier', 'personas', FALSE, count(*), (SELECT count(DISTINCT l_suppkey) FROM lineitem), 0, min(s_acctbal), CAST(min(s_nationkey) AS DOUBLE) FROM supplier
  UNION ALL SELECT 'embeddings', 'formas', TRUE, count(*), count(DISTINCT vec_id), count(*) FILTER (embedding[1] IS NULL),
         min(-70 + CAST(embedding[1] AS DOUBLE)), min(-33 + CAST(embedding[2] AS DOUBLE)) FROM embeddings
  UNION ALL SELECT 'labels', 'formas', TRUE, count(*), (SELECT count(*) FROM documents), count(*) FILTER (quality = 0),
         min(-70.0 - toxic), min(-33.0 - quality) FROM labels)
SELECT grupo, count(*) AS capas, CAST(sum(n) AS BIGINT) AS registros, count(*) FILTER (vigente) AS vigentes,
       CAST(sum((n <> dec)::INT + (bare > 0)::INT + (NOT (minx > -110 AND minx < -60 AND miny > -60 AND miny < -15))::INT) AS BIGINT) AS problemas
FROM s GROUP BY 1
""",
)
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    layers = spark.createDataFrame(
        [
            ("customer", "personas", None, True, True),
            ("supplier", "personas", None, False, True),
            ("embeddings", "formas", None, True, False),
            ("labels", "formas", None, True, False),
        ],
        "slug string, grupo string, corte string, vigente boolean, solo_atributos boolean",
    )
    lon = lambda c: c - 70
    emb = t("embeddings")
    kept = t("labels").where(F.col("quality").isNotNull())
    stats = [
        C.layer_stats(t("customer"), "customer", F.col("c_acctbal"), F.col("c_nationkey").cast("double")),
        C.layer_stats(t("supplier"), "supplier", F.col("s_acctbal"), F.col("s_nationkey").cast("double")),
        C.layer_stats(
            emb, "embeddings", lon(F.col("embedding")[0].cast("double")), F.col("embedding")[1].cast("double") - 33
        ),
        C.layer_stats(
            kept, "labels", F.lit(-70.0) - F.col("toxic"), F.when(F.col("quality") != 0, F.lit(-33.0) - F.col("quality"))
        ),
    ]
    declared = [
        t("orders").agg(F.lit("customer").alias("slug"), F.countDistinct("o_custkey").alias("n_declarado_servicio")),
        t("lineitem").agg(F.lit("supplier").alias("slug"), F.countDistinct("l_suppkey").alias("n_declarado_servicio")),
        emb.agg(F.lit("embeddings").alias("slug"), F.countDistinct("vec_id").alias("n_declarado_servicio")),
        t("documents").agg(F.lit("labels").alias("slug"), F.count(F.lit(1)).alias("n_declarado_servicio")),
    ]
    union = lambda parts: parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    manifest = C.manifest_rows(layers, union(stats), union(declared)).withColumn("parquet_mb", F.lit(0.0))
    return Q.catalogue(manifest).drop("parquet_mb").withColumn("problemas", F.col("problemas").cast("bigint"))


@query(
    "manifest_upsert",
    """
WITH o AS (SELECT p_brand AS slug, min(p_partkey) AS posicion, count(*) AS n FROM part GROUP BY 1),
n AS (SELECT p_brand AS slug, max(p_partkey) AS posicion, 2 * count(*) AS n FROM part WHERE p_brand IN ('Brand#3', 'Brand#12') GROUP BY 1
      UNION ALL SELECT p_type, min(p_partkey), count(*) FROM part GROUP BY 1)
SELECT o.slug, o.posicion, o.n FROM o WHERE o.slug NOT IN (SELECT slug FROM n)
UNION ALL
SELECT n.slug, coalesce(o.posicion, (SELECT max(posicion) FROM o) + n.posicion), n.n FROM n LEFT JOIN o USING (slug)
""",
)
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    entry = [F.min("p_partkey").alias("posicion"), F.count(F.lit(1)).alias("n")]
    old = part.groupBy(F.col("p_brand").alias("slug")).agg(*entry)
    # a partial refresh names the entries it renews
    renewed = part.where(F.col("p_brand").isin("Brand#3", "Brand#12"))
    new = (
        renewed.groupBy(F.col("p_brand").alias("slug"))
        .agg(F.max("p_partkey").alias("posicion"), (2 * F.count(F.lit(1))).alias("n"))
        .union(part.groupBy(F.col("p_type").alias("slug")).agg(*entry))
    )
    return C.upsert(old, new).select("slug", "posicion", "n")


@query(
    "label_dictionary",
    """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'Ciclovía' WHEN '2-HIGH' THEN 'Senda' WHEN '3-MEDIUM' THEN 'Zona 30'
       ELSE upper(substr(o_orderpriority, 1, 1)) || substr(o_orderpriority, 2) END AS label,
       CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS INTEGER) AS orden,
       upper(substr(lower(o_orderstatus), 1, 1)) AS estado,
       count(*) AS n, replace(replace(replace(format('{:,.2f}', round(sum(o_totalprice), 2)), ',', '#'), '.', ','), '#', '.') AS total
FROM orders GROUP BY 1, 2, 3
""",
)
def label_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"1-URGENT": "ciclovía", "2-HIGH": "senda", "3-MEDIUM": "zona 30"}
    o = table(spark, sf_dir, "orders")
    code = F.col("o_orderpriority")
    return o.groupBy(
        X.label_of(code, names).alias("label"),
        X.ordinal_of(code, list(names), 3).alias("orden"),
        X.label_of(F.lower("o_orderstatus"), {}).alias("estado"),
    ).agg(F.count(F.lit(1)).alias("n"), X.cl_number(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "safe_measures",
    """
WITH l AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'sin dato' ELSE CAST(l_quantity AS VARCHAR) END AS q,
         CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice END AS p, l_quantity, l_discount, l_tax
  FROM lineitem)
SELECT l_orderkey, l_linenumber, TRY_CAST(q AS DOUBLE) AS qty,
       CASE WHEN TRY_CAST(q AS DOUBLE) > 5 AND TRY_CAST(q AS DOUBLE) <= 40 THEN TRY_CAST(q AS DOUBLE) END AS guarded,
       round(1000 * p / nullif(TRY_CAST(q AS DOUBLE), 0), 4) AS per_thousand,
       round(100 * p / nullif(l_discount, 0), 4) AS ratio,
       CASE WHEN p IS NOT NULL AND TRY_CAST(q AS DOUBLE) IS NOT NULL THEN least(p, TRY_CAST(q AS DOUBLE)) END AS both,
       coalesce(p, CASE WHEN l_tax > 0 THEN l_quantity END) AS published,
       CASE WHEN TRY_CAST(q AS DOUBLE) IS NULL THEN 'no_data' WHEN TRY_CAST(q AS DOUBLE) < 5 THEN 'insufficient' ELSE 'ok' END AS status,
       coalesce(TRY_CAST(q AS DOUBLE), 0) AS filled,
       CAST(CAST(TRY_CAST(q AS DOUBLE) AS BIGINT) AS VARCHAR) AS code
FROM l
""",
)
def safe_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.survey import published_walking

    lines = table(spark, sf_dir, "lineitem").select(
        "*",
        F.when(F.col("l_tax") == 0, "sin dato").otherwise(F.col("l_quantity").cast("string")).alias("q"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("p"),
    )
    qty, p = N.safe_double(F.col("q")), F.col("p")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        qty.alias("qty"),
        N.guard_range(qty, 5, 40).alias("guarded"),
        F.round(N.per_thousand(p, qty), 4).alias("per_thousand"),
        F.round(N.ratio(p, F.col("l_discount")), 4).alias("ratio"),
        N.lesser_known(p, qty).alias("both"),
        published_walking(p, F.col("l_quantity"), F.col("l_tax")).alias("published"),
        N.support_status(qty).alias("status"),
        F.coalesce(qty, F.lit(0.0)).alias("filled"),
        X.code_text(F.col("q")).alias("code"),
    )
