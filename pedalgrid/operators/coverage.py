"""Coverage thresholds, curves, socio-economic gradients, access rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import count_if, ratio, total, total_if, weighted_mean
from .ranks import group_quantile_bins, quantile_bins

# Coverage thresholds and the one reported everywhere, m.
THRESHOLDS = (150, 300, 500, 694, 1000)
NEAR = 300
# Census transport modes; the commune table has one more than zones.
COMMUNE_MODES = (
    "n_transporte_auto",
    "n_transporte_publico",
    "n_transporte_camina",
    "n_transporte_bicicleta",
    "n_transporte_motocicleta",
    "n_transporte_cab_lan_bote",
    "n_transporte_otros",
)
ZONE_MODES = tuple(m for m in COMMUNE_MODES if m != "n_transporte_cab_lan_bote")
# Fixed value: quantile groups of the socio-economic score.
GROUPS = 5


def within(dist: Column, limit: float) -> Column:
    """Covered? An unknown distance is not."""
    return F.coalesce(dist <= limit, F.lit(False))


def add_flags(df: DataFrame, dist: str, limits: Sequence[float] = THRESHOLDS) -> DataFrame:
    return df.withColumns({f"cub_{u}": within(F.col(dist), u) for u in limits})


def commune_coverage(
    blocks: DataFrame,
    by: Sequence[str],
    dist: str,
    people: str,
    riders: str,
    score: str | None = None,
    limits: Sequence[float] = THRESHOLDS,
    strict: bool = False,
) -> DataFrame:
    """Population, riders, score and covered parts per territory in one pass."""
    p, b, d = F.col(people), F.col(riders), F.col(dist)
    aggs = [total(p).alias("pob"), F.count(F.lit(1)).alias("manzanas"), total(b).alias("bici")]
    if score:
        aggs.append(weighted_mean(F.col(score), p, strict=strict).alias("nse_score_pob"))
    for u in limits:
        covered = within(d, u)
        aggs += [
            total_if(covered, p).alias(f"pob_cub_{u}"),
            total_if(covered, b).alias(f"bici_cub_{u}"),
            ratio(total_if(covered, p), total(p)).alias(f"pct_pob_{u}"),
            ratio(total_if(covered, b), total(b)).alias(f"pct_bici_{u}"),
        ]
    known = blocks
    for k in by:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*by).agg(*aggs)


def coverage_curve(
    blocks: DataFrame, dist: str, people: str, riders: str, limits: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """``threshold, pob, pct_pob, bici, pct_bici`` for the whole table."""
    p, b, d = F.col(people), F.col(riders), F.col(dist)
    points = [
        F.struct(
            F.lit(float(u)).alias("threshold"),
            total_if(within(d, u), p).alias("pob"),
            ratio(total_if(within(d, u), p), total(p)).alias("pct_pob"),
            total_if(within(d, u), b).alias("bici"),
            ratio(total_if(within(d, u), b), total(b)).alias("pct_bici"),
        )
        for u in limits
    ]
    return blocks.agg(F.array(*points).alias("_c")).select(F.inline("_c"))


def modal_totals(df: DataFrame, by: Sequence[str], modes: Sequence[str], bike: str) -> DataFrame:
    """Sum of each mode, of all modes, and the bike's share of them."""
    every = sum((total(F.col(m)) for m in modes[1:]), total(F.col(modes[0])))
    return df.groupBy(*by).agg(
        *[total(F.col(m)).alias(m) for m in modes],
        every.alias("viajes_modo"),
        ratio(total(F.col(bike)), every).alias("bici_pct"),
    )


def universe(blocks: DataFrame, area: str, score: str, people: str, urban: str = "URBANO") -> DataFrame:
    """Urban, scored, inhabited."""
    return blocks.where((F.col(area) == urban) & F.col(score).isNotNull() & (F.col(people) > 0))


def _by_bin(binned: DataFrame, bin_col: str, dist: str, people: str, riders: str, moves: str | None, near: float):
    p = F.col(people)
    aggs = [
        total(p).alias("pob"),
        ratio(total_if(within(F.col(dist), near), p), total(p)).alias("pct_cubierta"),
    ]
    if moves:
        aggs.append(ratio(total(F.col(riders)), total(F.col(moves))).alias("pct_bici"))
    return binned.where(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(*aggs)


def gradient(
    blocks: DataFrame, score: str, dist: str, people: str, riders: str, moves: str, near: float = NEAR
) -> DataFrame:
    """Coverage and bike share by global score quantile."""
    return _by_bin(quantile_bins(blocks, score, GROUPS, "q"), "q", dist, people, riders, moves, near)


def gradient_within(
    blocks: DataFrame, by: Sequence[str], score: str, dist: str, people: str, near: float = NEAR
) -> DataFrame:
    """Coverage by score quantile inside each territory."""
    binned = group_quantile_bins(blocks, by, score, GROUPS, "q")
    return _by_bin(binned, "q", dist, people, people, None, near)


def equity_gap(
    blocks: DataFrame, by: Sequence[str], score: str, dist: str, people: str, near: float = NEAR
) -> DataFrame:
    """Coverage of the top group minus that of the bottom one, per territory.

    NULL with too few distinct scores or an uninhabited end group.
    """
    p = F.col(people)
    binned = group_quantile_bins(blocks, by, score, GROUPS, "_q")
    per = binned.groupBy(*by, "_q").agg(
        total(p).alias("_p"), total_if(within(F.col(dist), near), p).alias("_c")
    )
    rate = ratio(F.col("_c"), F.col("_p"))
    low = F.max(F.when(F.col("_q") == 0, rate))
    return per.groupBy(*by).agg((F.max_by(rate, F.col("_q")) - low).alias("brecha_nse"))


def access_rates(
    places: DataFrame, kind: str, dist: str, enrolment: str, limits: Sequence[float] = (300, 694, 1000)
) -> DataFrame:
    """Share of places near the network per class, and the enrolled near it."""
    d, m = F.col(dist), F.col(enrolment)
    near = within(d, limits[0])
    return places.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"),
        *[ratio(count_if(within(d, u)), F.count(F.lit(1))).alias(f"pct_{u}") for u in limits],
        F.count(m).alias("n_matricula"),
        total(m).alias("matricula"),
        total_if(near, m).alias("matricula_cerca"),
        ratio(total_if(near, m), total(m)).alias("pct_matricula"),
    )


def unmet_demand(zones: DataFrame, share: str, dist: str, over: float = 3.8, beyond: float = 600) -> DataFrame:
    """High bike share and no network near: demand without infrastructure."""
    return zones.where((F.col(share) > over) & (F.col(dist) > beyond))


def top_zones(zones: DataFrame, measure: str, people: str, least: float = 500, k: int = 10, tie: str = "zona") -> DataFrame:
    return zones.where(F.col(people) >= least).orderBy(F.desc_nulls_last(measure), tie).limit(k)
