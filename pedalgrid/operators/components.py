"""Connected components by alternating stars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import settle
from .skew import attach


def _large_star(links: DataFrame, n_links: int, by: list[str]) -> DataFrame:
    both = links.union(links.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
    return attach(both.where(F.col("v") > F.col("u")), least, [*by, "u"], "_n", 2 * n_links).select(
        *by, F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(links: DataFrame, n_links: int, by: list[str]) -> DataFrame:
    down = links.where(F.col("u") != F.col("v")).select(
        *by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = down.groupBy(*by, "u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    moved = attach(down, least, [*by, "u"], "_n", n_links).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select(*by, "u", F.col("m").alias("v"))
    return moved.union(own).where(F.col("u") != F.col("v")).distinct()


def connected_components(
    vertices: DataFrame,
    links: DataFrame,
    vid: str,
    src: str,
    dst: str,
    name: str = "component",
    by: Sequence[str] = (),
) -> DataFrame:
    """``(vid, component)`` where the component is its smallest vertex id.

    With ``by`` there is a graph per key, all found in one run, and the key comes first.
    Rounds shrink the depth of every tree, so long chains take a logarithmic
    number of them; each round is written out, which keeps plans short and
    lets a lost executor be recovered from files.
    """
    by = list(by)

    def written(df: DataFrame):
        """The links on disk, with their number and a sum of hashes: equal link
        sets give equal marks, in whatever order they were written."""
        seen = Observation()
        mark = F.sum(F.xxhash64(*by, "u", "v").cast("decimal(38,0)")).alias("h")
        out = settle(df.observe(seen, F.count(F.lit(1)).alias("n"), mark))
        return out, (seen.get["n"], seen.get["h"])

    current, before = written(
        links.select(*by, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    while before[0]:
        current, now = written(_small_star(_large_star(current, before[0], by), before[0], by))
        if now == before:
            break
        before = now
    roots = current.select(*by, F.col("u").alias(vid), F.col("v").alias("_root"))
    return (
        vertices.select(*by, vid)
        .distinct()
        .join(roots, [*by, vid], "left")
        .select(*by, vid, F.coalesce("_root", vid).alias(name))
    )
