"""Order statistics that stay distributed.

A window over a whole city, or over the whole table, would send that group to
one task. Here a mergeable quantile sketch cuts every group into slices, slice
totals are accumulated (a few hundred rows per group), and only rows of one
slice are ever sorted together. The sketch decides where the cuts fall, never
the result: totals and ranks are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import finite
from ..session import settle

SLICES = 128
# cuts made at a time; slices that stay too large are cut again
MOST_SLICES = 4096
# distinct values one task may be asked to sort
PER_SLICE = 2_000_000
# with fewer distinct values than this in all, one slice per group is enough
SHORT = 1_000_000
_ALL = "_all"
# weights are added as decimals: a sum then depends on no order of rows or partitions
EXACT = "decimal(38,12)"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be NULL (a NULL group is still a group)."""
    cond = None
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def _values(df: DataFrame, by: list[str], value: str, weight: str | None):
    """Distinct values with their weight, written out once for all later passes.

    A value shared by many rows is one row here, so copies cannot pile up. Whole
    numbers stay whole, so large ids stay apart.
    """
    w = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight).cast(EXACT)).cast(EXACT)
    whole = df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")
    kind = "bigint" if whole else "double"
    kept = df.where(finite(F.col(value).cast("double")).isNotNull())
    if weight is not None:
        kept = kept.where(finite(F.col(weight).cast("double")) > 0)
    if not by:
        kept = kept.withColumn(_ALL, F.lit(0))
        by = [_ALL]
    return by, settle(kept.groupBy(*by, F.col(value).cast(kind).alias("_v")).agg(w.alias("_w")))


def _cut(values: DataFrame, by: list[str], slices: int, n: int):
    """Values with their slice number, and the total of each group.

    There are more slices the more values there are, were they all one group's.

    The cuts are written out: a sketch merged in another order cuts elsewhere,
    and both results must speak of the same slices.
    """
    slices = min(MOST_SLICES, max(slices, n // PER_SLICE))
    step = max(2, round(slices**0.5))
    raw = values.groupBy(*by).agg(
        F.array_distinct(
            F.percentile_approx("_v", [i / slices for i in range(1, slices)], slices * 20)
        ).alias("_cuts"),
        F.sum("_w").alias("_total"),
    )
    every = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("_cuts") / step).cast("int")), lambda i: F.get("_cuts", i * step - 1)
    )
    cuts = settle(
        raw.withColumn(
            "_coarse",
            F.when(F.size("_cuts") >= step, every).otherwise(F.array().cast(raw.schema["_cuts"].dataType)),
        )
    )

    def above(edges: Column) -> Column:
        return F.size(F.filter(edges, lambda e: F.col("_v") > e))

    # two short searches instead of one along all cuts
    keyed = (
        _same(values, cuts.drop("_total"), by)
        .withColumn("_at", above(F.col("_coarse")) * step)
        .withColumn("_slice", F.col("_at") + above(F.slice("_cuts", F.col("_at") + 1, F.lit(step))))
        .drop("_cuts", "_coarse", "_at")
    )
    return keyed.withColumn("_slice", F.col("_slice").cast("bigint")), cuts.select(*by, "_total")


def _cut_again(keyed: DataFrame, large: DataFrame, by: list[str], slices: int, n: int) -> DataFrame:
    """``keyed`` with its ``large`` slices cut, of ``n`` values at most, in the order of values."""
    keys = [*by, "_slice"]
    apart = _same(keyed, large, keys).withColumnRenamed("_slice", "_outer")
    finer, _ = _cut(apart, [*by, "_outer"], slices, n)
    wide = F.lit(MOST_SLICES + 1).cast("bigint")
    finer = finer.withColumn("_slice", F.col("_outer") * wide + F.col("_slice")).drop("_outer")
    kept = _same(keyed, large, keys, "left_anti").withColumn("_slice", F.col("_slice") * wide)
    return kept.unionByName(finer)


def _sliced(values: DataFrame, by: list[str], slices: int, n: int):
    """Values with their slice number, and the running bounds of each slice.

    Slices of more than ``PER_SLICE`` values are cut again until there are none; values of a
    group differ, so there is always a cut.
    """
    keyed, totals = _cut(values, by, slices, n)
    while True:
        sums = settle(keyed.groupBy(*by, "_slice").agg(F.sum("_w").alias("_sw"), F.count(F.lit(1)).alias("_n")))
        large = sums.where(F.col("_n") > PER_SLICE)
        most = large.agg(F.max("_n")).first()[0]
        if most is None:
            break
        keyed = settle(_cut_again(keyed, large.select(*by, "_slice"), by, slices, most))
    order = Window.partitionBy(*by).orderBy("_slice")
    ends = (
        _same(sums.drop("_n"), totals, by)
        .withColumn("_end", F.sum("_sw").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.coalesce(F.lag("_end").over(order), F.lit(0)).cast(values.schema["_w"].dataType))
        .select(*by, "_slice", "_total", "_start", "_end")
    )
    return keyed, ends


def _running(rows: DataFrame, by: list[str]) -> DataFrame:
    w = (
        Window.partitionBy(*by, "_slice")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    kind = rows.schema["_w"].dataType
    return rows.withColumn("_cum", (F.col("_start") + F.sum("_w").over(w)).cast(kind))


def _one_slice(values: DataFrame, by: list[str]) -> DataFrame:
    """All values of a group in one slice, for tables counted to be short."""
    totals = values.groupBy(*by).agg(F.sum("_w").alias("_total"))
    rows = _same(values, totals, by).withColumn("_slice", F.lit(0)).withColumn("_start", F.lit(0).cast("int"))
    return _running(rows, by)


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str | None = None,
    slices: int = SLICES,
    short: int = SHORT,
) -> DataFrame:
    """Per distinct value: ``value, weight, cumulative, total`` (counts are whole
    numbers, sums of weights doubles)."""
    out = "bigint" if weight is None else "double"
    by, values = _values(df, list(by), value, weight)
    n = values.count()
    if n <= short:
        rows = _one_slice(values, by)
    else:
        keyed, ends = _sliced(values, by, slices, n)
        rows = _running(_same(keyed, ends, [*by, "_slice"]), by)
    return rows.select(
        *[c for c in by if c != _ALL],
        F.col("_v").alias(value),
        F.col("_w").cast(out).alias("weight"),
        F.col("_cum").cast(out).alias("cumulative"),
        F.col("_total").cast(out).alias("total"),
    )


def values_at(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    targets: Callable[[Column], Column],
    weight: str | None = None,
    slices: int = SLICES,
    short: int = SHORT,
) -> DataFrame:
    """For each target amount, the first value whose running total reaches it.

    ``targets`` maps a group's total to an array of amounts; the result has
    ``at: array<double>`` in the same order, and ``total``. Only the slices a
    target falls into are sorted.
    """
    by, values = _values(df, list(by), value, weight)
    n = values.count()
    if n <= short:
        rows = _one_slice(values, by).select(
            *by, "_total", "_v", "_cum", F.posexplode(targets(F.col("_total"))).alias("_pos", "_goal")
        )
    else:
        keyed, ends = _sliced(values, by, slices, n)
        asked = ends.select(
            *by, "_slice", "_start", "_end", "_total", F.posexplode(targets(F.col("_total"))).alias("_pos", "_goal")
        ).where(
            (F.col("_end") >= F.col("_goal"))
            & ((F.col("_start") < F.col("_goal")) | ((F.col("_start") == 0) & (F.col("_goal") <= 0)))
        )
        goals = asked.groupBy(*by, "_slice").agg(
            F.first("_start").alias("_start"),
            F.first("_total").alias("_total"),
            F.collect_list(F.struct("_pos", "_goal")).alias("_goals"),
        )
        rows = (
            _running(_same(keyed, goals, [*by, "_slice"]), by)
            .select(*by, "_total", "_v", "_cum", F.explode("_goals").alias("_g"))
            .select(*by, "_total", "_v", "_cum", "_g.*")
        )
    # the last value stands in where rounding leaves its running total a hair
    # below the end
    hits = rows.groupBy(*by, "_total", "_pos").agg(
        F.coalesce(F.min(F.when(F.col("_cum") >= F.col("_goal"), F.col("_v"))), F.max("_v")).cast("double").alias("_v")
    )
    out = hits.groupBy(*by, F.col("_total").cast("double").alias("total")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda s: s["_v"]).alias("at")
    )
    return out.drop(_ALL)


def weighted_lower_median(
    df: DataFrame, by: Sequence[str], value: str, weight: str, name: str = "median"
) -> DataFrame:
    """First value whose cumulative weight reaches half the total."""
    at = values_at(df, by, value, lambda t: F.array(t / 2), weight)
    return at.select(*by, F.col("at")[0].alias(name), F.col("total").alias("total_weight"))


def quantile_edges(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], name: str = "edges"
) -> DataFrame:
    """Exact linearly interpolated quantiles (not sketched) per group."""

    def ranks(total):
        out = []
        for p in probs:
            h = (total - 1) * F.lit(float(p))
            out += [F.floor(h).cast("double") + 1, F.least(F.floor(h).cast("double") + 2, total)]
        return F.array(*out)

    at = values_at(df, by, value, ranks)
    total = F.col("total")
    edges = []
    for i, p in enumerate(probs):
        h = (total - 1) * F.lit(float(p))
        lo, hi = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        edges.append(lo + (hi - lo) * (h - F.floor(h)))
    return at.select(*by, F.array(*edges).alias(name), F.col("total").cast("bigint").alias("n"))


def _probs(n: int) -> list[float]:
    return [i / n for i in range(n + 1)]


def bin_of(v: Column, edges: Column) -> Column:
    """Right-closed bin, lowest value included; equal edges are merged so that
    codes stay dense."""
    uniq = F.array_distinct(edges)
    inner = F.slice(uniq, F.lit(2), F.greatest(F.size(uniq) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda e: v > e))


def quantile_bins(df: DataFrame, value: str, n: int = 5, name: str = "bin") -> DataFrame:
    """Global quantile bin; fails if two edges coincide. Rows without a value drop.

    The edges are one row, so they travel as a broadcast.
    """
    edges = quantile_edges(df, [], value, _probs(n), "_edges")
    checked = edges.withColumn(
        "_edges",
        F.when(F.size(F.array_distinct("_edges")) == n + 1, F.col("_edges")).otherwise(
            F.raise_error(F.lit("quantile edges are not unique"))
        ),
    ).select(F.lit(0).alias("_one"), "_edges")
    rows = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(0))
    return (
        rows.join(F.broadcast(checked), "_one")
        .withColumn(name, bin_of(F.col(value), F.col("_edges")))
        .drop("_one", "_edges")
    )


def group_quantile_bins(
    df: DataFrame, by: Sequence[str], value: str, n: int = 5, name: str = "bin"
) -> DataFrame:
    """Quantile bin inside each group; NULL where a group has too few distinct
    values. One edge row per group is joined back, never a window."""
    edges = quantile_edges(df, by, value, _probs(n), "_edges")
    distinct = (
        df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.countDistinct(value).alias("_distinct"))
    )
    # settled, so that its measured size decides the join and rows stay put
    per_group = settle(_same(edges.drop("n"), distinct, list(by)))
    return (
        _same(df, per_group, list(by), "left")
        .withColumn(
            name,
            F.when(
                (F.col("_distinct") >= n) & F.col(value).isNotNull(),
                bin_of(F.col(value), F.col("_edges")),
            ),
        )
        .drop("_edges", "_distinct")
    )


def class_breaks(df: DataFrame, by: Sequence[str], value: str, n: int = 7) -> DataFrame:
    """Nearest-lower-rank breaks for ``n`` classes (no interpolation)."""
    at = values_at(
        df,
        by,
        value,
        lambda t: F.array(*[F.floor(F.lit(float(i)) / n * (t - 1)) + 1.0 for i in range(1, n)]),
    )
    return at.select(*by, F.col("at").alias("breaks"))


def diverging_breaks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Breaks symmetric about 0, scaled by the lower p90 of the absolute value."""
    absolute = df.withColumn("_abs", F.abs(F.col(value)))
    at = values_at(absolute, by, "_abs", lambda t: F.array(F.floor((t - 1) * 0.9) + 1.0))
    q = F.when(F.col("at")[0] == 0, 1.0).otherwise(F.col("at")[0])
    # fixed values: the fractions of q at which the classes split
    return at.select(*by, F.array(*[q * f for f in (-1.0, -0.5, -0.15, 0.15, 0.5, 1.0)]).alias("breaks"))


def class_of(v: Column, breaks: Column, reverse: bool = False) -> Column:
    """Number of breaks the value exceeds; NULL has no class."""
    i = F.size(F.filter(F.coalesce(breaks, F.array().cast("array<double>")), lambda b: v > b))
    if reverse:
        i = F.size(breaks) - i
    return F.when(finite(v).isNotNull(), i)


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Average rank of each distinct value within its group."""
    return running_totals(df, by, value).select(
        *by, value, (F.col("cumulative") - (F.col("weight") - 1) / 2).alias(name)
    )


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str, name: str = "r") -> DataFrame:
    """Correlation, NULL below three pairs."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = finite(F.corr(F.col(x).cast("double"), F.col(y).cast("double")))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 3, r).alias(name)
    )


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Rank correlation with average ranks for ties.

    Pairs are collapsed with their counts first; the moments of the ranks are
    then weighted sums.
    """
    by = list(by)
    pairs = (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )

    def ranks(col, out):
        return running_totals(pairs, by, col, "_n").select(
            *by, col, (F.col("cumulative") - (F.col("weight") - 1) / 2).alias(out), "total"
        )

    ranked = _same(pairs, ranks("_x", "_rx"), [*by, "_x"])
    ranked = _same(ranked, ranks("_y", "_ry").drop("total"), [*by, "_y"])
    n, mid = F.col("_n"), (F.col("total") + 1) / 2
    dx, dy = F.col("_rx") - mid, F.col("_ry") - mid
    sxy, sxx, syy = F.sum(n * dx * dy), F.sum(n * dx * dx), F.sum(n * dy * dy)
    return ranked.groupBy(*by).agg(
        F.sum(n).cast("bigint").alias("n"),
        F.when(F.sum(n) >= 3, sxy / F.nullif(F.sqrt(sxx * syy), F.lit(0.0))).alias(name),
    )


def share_of_group(df: DataFrame, by: Sequence[str], value: str, name: str = "share") -> DataFrame:
    """Row's part of its group's total, joined back rather than windowed so a
    hot group stays spread over tasks."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_group_total"))
    return (
        _same(df, totals, list(by), "left")
        .withColumn(name, F.col(value) / F.nullif(F.col("_group_total"), F.lit(0.0)))
        .drop("_group_total")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key by an explicit order: a partial aggregate, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(pick.alias("_p")).select(*keys, "_p._row.*")
