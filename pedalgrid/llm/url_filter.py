"""URL rules by a sort-merge range join.

A rule is a host and a path prefix; it fits its host and every subdomain. Turned
into ``reversed host # path`` a rule is a key, and the keys it fits are one
interval of the sorted key order, the keys that start with it. A url has such a
key for each suffix of its host, so that a path rule of a parent host is met
too. Rules and urls are sorted together, and a sweep carries the stack of the
rules that are open: each rule row holds the rules around it (the rules that
its own key starts with), the sweep hands the last one to the urls after it, and
a url keeps those whose interval has not ended.

The order is cut into ranges by key, then by host, so that a key that many hosts
share is split as well; a range starts with the stack that the ranges before it
leave open. Equal urls are swept once.

Several rules may fit: the longest host and path together wins, then the longer
host. Two verdicts for one rule: block wins. No rule: ``DEFAULT``.

Defined cases: a NULL url, or one without ``://``, has empty host and path and
meets no rule; rules with a NULL part are ignored; repeated pages each get a
row; empty tables give no rows (pages) or only defaults (rules).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import settle
from .registry import query, table

DEFAULT = "allow"
# The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def stacked(rules: DataFrame) -> DataFrame:
    """``key, stack`` per rule: the rules around it, outermost first, itself last."""
    known = (
        rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
        .select(F.translate("host", *LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat(reversed_host(F.col("host")), F.lit("#"), F.col("path")).alias("key"),
            F.concat("host", "path").alias("rule"),
            F.length("host").alias("reach"),
            "verdict",
        )
    )
    # a rule around another one has a key that the other's key starts with
    starts = known.select(
        F.col("key").alias("inner"),
        F.explode(
            F.transform(
                F.sequence(F.instr("key", "#"), F.length("key")), lambda n: F.left("key", n)
            )
        ).alias("key"),
    )
    return (
        starts.join(known, "key")
        .groupBy(F.col("inner").alias("key"))
        .agg(F.array_sort(F.collect_list(F.struct("key", "rule", "reach", "verdict"))).alias("stack"))
    )


def match(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of those names that
    the input has are replaced."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    pages = pages.withColumns({"host": host, "path": path})
    urls = pages.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    keys = urls.select(
        "host",
        "path",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(labels)),
                lambda n: F.concat(
                    F.array_join(F.slice(F.reverse(labels), F.lit(1), n), "."), F.lit("#"), F.col("path")
                ),
            )
        ).alias("key"),
    )
    stacks = stacked(rules)
    kind = stacks.schema["stack"].dataType
    events = stacks.select("key", F.lit(0).alias("kind"), F.lit("").alias("host"), F.lit("").alias("path"), "stack").unionByName(
        keys.select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast(kind).alias("stack"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written out, so that both readings below see the same ranges
    ranged = settle(events.repartitionByRange(n, "key", "kind", "host").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    left_open = (
        ranged.groupBy("range")
        .agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("stack"))
        .select("range", F.last("stack", True).over(before).alias("outer"))  # a row per range
    )
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    best = (
        ranged.withColumn("inner", F.last("stack", True).over(sweep))
        .where("kind = 1")
        .join(left_open, "range", "left")
        .select(
            "host",
            "path",
            F.array_max(
                F.transform(
                    F.filter(F.coalesce("inner", "outer"), lambda r: F.col("key").startswith(r["key"])),
                    lambda r: F.struct(F.length(r["rule"]).alias("size"), r["reach"].alias("reach"), r["rule"].alias("rule"), r["verdict"].alias("verdict")),
                )
            ).alias("best"),
        )
        .where("best IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.max("best").alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    judged = pages.drop("rule", "verdict").join(best, ["host", "path"], "left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(DEFAULT)))


SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org','/','allow'), ('example.org','/es/','block'),
    ('example.org','/en/1','block'), ('com','/fr/','allow'), ('com','/de/','block')),
 p AS (SELECT page_id, url, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
 u AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*', 0)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
 hit AS (SELECT DISTINCT u.host, u.path, r.host || r.path AS rule, r.verdict
         FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)),
 best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM hit GROUP BY 1, 2)
SELECT u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (host, path)"""


@query("op3_url_filter", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return match(pages, rules).select("page_id", "host", "path", "rule", "verdict")
