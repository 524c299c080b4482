"""Mixing sources to target weights by a time-varying curriculum.

Every source has a share of the mix's words (its target) and a weight schedule over
training time, 0 to 1: straight lines between weights at equally spaced knots. The
schedule's integral, scaled to the target, is the source's cumulative demand. A source's
documents stand in an order drawn by hash; the words before a document, over its copies,
are a point of that demand, and the time at which the demand reaches it is the copy's
training position. So a source weighs at any time what its schedule says, and gives its
target by the end. The last copy is cut where the target is reached.

Targets: sources by code point, NULL last, take ``WEIGHTS`` in turn and share
``SHARE`` = 3/2 of all words; no target is above ``MOST`` = 2 times its source's words,
and what this leaves over is shared again by weight.

A source may hold any part of the rows, so nothing is summed within a source in one task:
its documents fall into bins of the hash, as many as make a bin some ``PER_BIN`` rows,
bins are summed first, and a running sum within one bin is added to what stands before it.

Rows that are equal in source, id and text are counted once and unfolded at the end, so they
may be any part of the rows too.

Defined cases: a NULL text has no words; a document without words is taken with none, at the
position where it stands; documents without a source are a source of their own; a source
without words has target 0; equal rows stand next to each other, each with its own copies; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from ..session import settle
from .registry import query, table

# The weights in turn, and the mix's words and a target's as parts of all
# words and of the source's.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
# even, falling and rising weight; a source has the schedule of its place as well
SCHEDULES = ((1.0, 1.0, 1.0), (2.0, 1.0, 0.5), (0.5, 1.0, 2.0))
PER_BIN = 5_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def drawn(docs: DataFrame) -> DataFrame:
    """``doc_id, source, _s, size, _h`` per row: the source as a key that is never NULL,
    the words, and 60 bits of a hash of id and text that set the order."""
    h = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary"))
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s"),
        n_words(F.col("text")).alias("size"),
        F.conv(F.left(h, F.lit(15)), 16, 10).cast("long").alias("_h"),
    )


def in_order(sources: DataFrame) -> DataFrame:
    """``sources`` with ``_place``, from 0 by code point, NULL last. Ranges are sorted
    each on its own, written with their numbers, and moved on by the sizes of those before."""
    spread = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("source").isNull(), F.col("source")]
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    cut = sources.repartitionByRange(spread, *by).sortWithinPartitions(*by)
    written = settle(cut.withColumns({"_range": F.spark_partition_id(), "_within": within}))
    sizes = written.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    placed = written.join(starts, "_range").withColumn("_place", F.col("_before") + F.col("_within"))
    return placed.drop("_range", "_within", "_before")


def with_targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``sources`` (``source, source_size``) with ``_place`` and ``target``.

    A source at its most stays there while the rest is shared again, so the sources at
    their most are those below a level of target per weight; it only rises, and each round
    needs two sums over the sources.
    """
    named = settle(in_order(sources))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    total = share * (named.agg(F.sum("source_size")).first()[0] or 0)
    level, full, left, over = 0.0, -1, 0.0, 1.0
    while True:
        below = cap < F.lit(level) * weight
        sums = named.agg(
            F.count_if(below).alias("full"),
            F.coalesce(F.sum(F.when(below, cap)), F.lit(0.0)).alias("held"),
            F.sum(F.when(~below, weight)).alias("weight"),
        ).first()
        if sums["full"] == full or not sums["weight"]:
            break
        full, left, over = sums["full"], total - sums["held"], sums["weight"]
        level = left / over
    open_ = weight * F.lit(left) / F.lit(over)
    return named.withColumn("target", F.when(cap < F.lit(level) * weight, cap).otherwise(F.least(open_, cap)))


def position(part: Column, weights: Sequence[float]) -> Column:
    """Time at which ``part`` (0 to 1) of a schedule's integral is reached."""
    n = len(weights) - 1
    if n < 1 or min(weights) < 0 or not sum(weights[:-1]) + sum(weights[1:]):
        raise ValueError("a schedule wants two weights at least, none below 0 and not all 0")
    reached = [0.0]
    for a, b in zip(weights, weights[1:]):
        reached.append(reached[-1] + (a + b) / 2 / n)
    asked = part * F.lit(reached[-1])
    out = None
    for k in reversed(range(n)):
        # the weight grows by ``slope`` from ``first``: first * x + slope * x * x / 2 = rest
        first, slope, rest = weights[k], (weights[k + 1] - weights[k]) * n, asked - F.lit(reached[k])
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(first * first) + F.lit(2 * slope) * rest))
        x = F.when(rest > 0, 2 * rest / (F.lit(first) + root)).otherwise(F.lit(0.0))
        here = F.least(F.lit(k / n) + x, F.lit((k + 1) / n))
        out = here if out is None else F.when(asked < F.lit(reached[k + 1]), here).otherwise(out)
    return out


def curriculum(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    per_bin: int = PER_BIN,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, copies`` per row of ``docs``.

    ``copies`` holds the copies that the mix takes, each with its number from 0, its
    training ``position`` and the words it gives."""
    seen = Observation()
    rows = settle(drawn(docs).observe(seen, F.count(F.lit(1)).alias("n")))
    bits = max(0, math.ceil(math.log2(max(1, seen.get["n"]) / per_bin)))
    each = rows.groupBy("source", "_s", "_h", "doc_id", "size").agg(F.count(F.lit(1)).alias("_n"))
    each = settle(each.withColumn("_bin", F.shiftright("_h", 60 - bits)))
    bins = settle(each.groupBy("source", "_s", "_bin").agg(F.sum(F.col("size") * F.col("_n")).alias("_sum")))
    sources = bins.groupBy("source", "_s").agg(F.sum("_sum").alias("source_size"))
    sources = with_targets(sources, weights, share, most)
    so_far = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select("_s", "_bin", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_before"))
    starts = starts.join(sources.drop("source"), "_s")
    inside = (
        Window.partitionBy("_s", "_bin").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum(F.col("size") * F.col("_n")).over(inside), F.lit(0))
    placed = settle(each.join(starts, ["_s", "_bin"]).withColumn("_at", F.col("_before") + before))
    many = F.col("_n") > per_bin
    parts = placed.where(many).withColumn("_i", F.explode(F.sequence(F.lit(0), F.expr(f"(_n - 1) div {per_bin}"))))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts.repartition(spread, "_s", "_h", "doc_id", "_i")
    of_part = F.sequence(F.col("_i") * per_bin, F.least((F.col("_i") + 1) * per_bin, F.col("_n")) - 1)
    alone = placed.where(~many).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    unfolded = alone.unionByName(parts.withColumn("_i", F.explode(of_part)))
    start = F.col("_at") + F.col("_i") * F.col("size")
    quota = F.floor(F.col("target") + F.lit(0.5))

    def copy(k: int) -> Column:
        at = start + F.lit(k) * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), quota - at))
        part = F.least(F.lit(1.0), F.when(F.col("target") > 0, at / F.col("target")).otherwise(F.lit(0.0)))
        time = position(part, schedules[-1])
        for j, schedule in enumerate(schedules[:-1]):
            time = F.when(F.col("_place") % len(schedules) == j, position(part, schedule)).otherwise(time)
        there = (words > 0) | ((F.col("size") == 0) & (at <= quota) & F.lit(k == 0))
        return F.when(there, F.struct(F.lit(k).alias("copy"), time.alias("position"), words.alias("words")))

    copies = F.filter(F.array(*[copy(k) for k in range(math.ceil(most))]), lambda c: c.isNotNull())
    made = unfolded.withColumn("copies", copies)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    return made.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "copies")


def training_order(mix: DataFrame) -> DataFrame:
    """A row per copy of ``mix``, in ranges by training position."""
    copies = mix.select("doc_id", "source", "size", F.inline("copies"))
    return copies.orderBy("position", "source", "doc_id", "copy")


def _sql() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CAST([{weights}][place % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, {MOST}.0 * source_size AS cap FROM p),
k AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS held, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0) AS over_,
             (SELECT {SHARE} * sum(source_size) FROM w) AS total
      FROM w WINDOW before AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT total - held AS left_, over_ FROM k WHERE cap >= (total - held) / over_ * weight ORDER BY cap / weight, place LIMIT 1),
t AS (SELECT source, source_size, place, least(weight * left_ / over_, cap) AS target FROM w, l),
c AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5) AS quota,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
       CAST({' + '.join(f'greatest(0, least(size, quota - at_ - {k} * source_size))' for k in range(MOST))} AS BIGINT) AS taken
FROM c
"""


@query("op13_curriculum", _sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = curriculum(table(spark, sf_dir, "documents"))
    first = F.try_element_at("copies", F.lit(1))["position"]
    by_time = mix.orderBy(first.asc_nulls_last(), "source", "doc_id")
    return by_time.select("doc_id", "size", "source_size", "target", "taken")
