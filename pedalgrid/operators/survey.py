"""Household-survey operators on expanded trips.

A trip row has ``ciudad, anio, modo_agregado, modo_agregado_desc, factor`` and
whichever dimensions its survey offers. Trips are summed to (city, year, code,
dimension) before anything is joined, so the mode rule only touches totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import guard_range, half_even, ratio, safe_double, total_if, weighted_mean
from ..functions.text import alnum_key
from ..functions.time import trip_hour, valid_hour
from ..session import settle
from .ranks import _same, weighted_lower_median

CITY = ["ciudad", "anio"]

# Descriptions of the non-motorised group.
NON_MOTORISED = "No Motor|No Caminata|BICICLETA|CAMINATA|Caminata"
# Published dimension -> column of the pooled trips.
CROSS_DIMENSIONS = {
    "edad": "grupo_etario",
    "sexo": "sexo_h",
    "quintil": "quintil_ingreso",
    "proposito": "proposito_agregado_h",
    "periodo": "periodo_dia",
    "hora": "hora",
}
# Distance bands in km, the last one open.
BANDS = ["0-1", "1-2", "2-3", "3-4", "4-5", "5-6", "6-7", "7-8", "8+"]
# Longest credible trip (min); tolerance of the official index (points).
LONGEST_MIN = 300
CONSISTENCY_PP = 2.0


def prepare(trips: DataFrame) -> DataFrame:
    """Add weight ``f``, raw code ``cod`` and the non-motorised flag ``nm``."""
    described = F.col("modo_agregado_desc").rlike(f"(?i){NON_MOTORISED}")
    return (
        trips.withColumn("f", F.coalesce(safe_double(F.col("factor")), F.lit(0.0)))
        .withColumn("cod", F.coalesce(F.col("modo_agregado").cast("string"), F.lit("nan")))
        .withColumn("nm", F.coalesce(described, F.lit(False)))
    )


def walking_codes(prepared: DataFrame) -> DataFrame:
    """Per city-year the dominant non-motorised code, if there is a second one.

    The largest is walking, the rest cycling; equal weights fall to the smaller
    code. Fewer than two codes cannot be told apart and get no row.
    """
    codes = prepared.where("nm").groupBy(*CITY, "cod").agg(F.sum("f").alias("f"))
    return (
        codes.groupBy(*CITY)
        .agg(
            F.min_by("cod", F.struct(-F.col("f"), F.col("cod"))).alias("cod_caminata"),
            F.count(F.lit(1)).alias("_codes"),
        )
        .where(F.col("_codes") >= 2)
        .drop("_codes")
    )


def _bike() -> Column:
    return F.col("nm") & F.coalesce(F.col("cod") != F.col("cod_caminata"), F.lit(False))


def mark_bike(rows: DataFrame, walking: DataFrame) -> DataFrame:
    """Flag ``bici`` on trips or on totals that kept ``cod`` and ``nm``."""
    return _same(rows, walking, CITY, "left").withColumn("bici", _bike())


def city_summary(trips: DataFrame) -> DataFrame:
    """Per city-year: expanded trips, bike, walking, shares, codes, separable."""
    codes = prepare(trips).groupBy(*CITY, "cod", "nm").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"))
    marked = mark_bike(codes, walking_codes(codes))
    # a city whose weights add up to nothing is listed, but nothing can be told apart
    separable = F.max(F.col("cod_caminata").isNotNull()) & (F.sum("f") > 0)
    only = lambda c: F.when(separable, c)
    return (
        marked.groupBy(*CITY)
        .agg(
            separable.alias("separable"),
            F.sum("f").alias("viajes_exp"),
            only(total_if(F.col("bici"), F.col("f"))).alias("bici_exp"),
            only(total_if(F.col("nm") & ~F.col("bici"), F.col("f"))).alias("caminata_exp"),
            F.when(F.max("nm"), ratio(total_if(F.col("nm"), F.col("f")), F.sum("f"))).alias("nomot_pct"),
            only(ratio(total_if(F.col("bici"), F.col("f")), F.sum("f"))).alias("bici_pct"),
            only(F.coalesce(F.sum(F.when(F.col("bici"), F.col("n"))), F.lit(0))).alias("n_registros_bici"),
            F.max("cod_caminata").alias("cod_caminata"),
            # heaviest first; a survey has a handful of raw codes
            only(
                F.array_join(
                    F.transform(
                        F.array_sort(
                            F.collect_list(F.when(F.col("bici"), F.struct(-F.col("f"), F.col("cod").alias("cod"))))
                        ),
                        lambda s: s["cod"],
                    ),
                    ", ",
                )
            ).alias("cod_bici"),
        )
    )


def mode_summary(trips: DataFrame) -> DataFrame:
    """Records, expanded trips and share by raw code."""
    per = prepare(trips).groupBy(*CITY, "cod").agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("viajes"))
    sums = per.groupBy(*CITY).agg(F.sum("viajes").alias("_t"))
    return _same(per, sums, CITY).withColumn("pct", ratio(F.col("viajes"), F.col("_t"))).drop("_t")


def _long(rows: DataFrame, dims: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per trip and dimension with a value; NULL values drop."""
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dim"), v.cast("string").alias("valor")) for d, v in dims.items()]
    )
    return rows.select(*keep, F.explode(F.filter(pairs, lambda p: p["valor"].isNotNull())).alias("_d")).select(
        *keep, "_d.dim", "_d.valor"
    )


def bike_profile(trips: DataFrame) -> DataFrame:
    """Expanded bike trips by purpose, period and start hour."""
    dims: dict[str, Column] = {}
    if "proposito_agregado_h" in trips.columns:
        dims["proposito"] = F.col("proposito_agregado_h")
    if "periodo" in trips.columns:
        dims["periodo"] = F.col("periodo")
    if "hora_inicio" in trips.columns:
        dims["hora"] = trip_hour(F.col("hora_inicio"))
    base = prepare(trips)
    totals = (
        _long(base.where("nm"), dims, [*CITY, "cod", "nm", "f"])
        .groupBy(*CITY, "cod", "nm", "dim", "valor")
        .agg(F.sum("f").alias("f"))
    )
    return (
        mark_bike(totals, walking_codes(base))
        .where("bici")
        .groupBy(*CITY, "dim", "valor")
        .agg(F.sum("f").alias("viajes"))
    )


def top_profile(profile: DataFrame, k: int = 30) -> DataFrame:
    """Largest ``k`` values of each dimension over all cities.

    The rank filter is pushed below the shuffle, so a task sees ``k`` rows per
    dimension from each partition.
    """
    per = profile.groupBy("dim", "valor").agg(F.sum("viajes").alias("viajes"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("viajes"), "valor"))
    return per.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def zone_sides(trips: DataFrame) -> DataFrame:
    """Bike trips by zone and side: expanded and surveyed."""
    base = prepare(trips)
    sides = {
        s: F.col(c) for s, c in (("origen", "zona_origen"), ("destino", "zona_destino")) if c in trips.columns
    }
    totals = (
        _long(base.where("nm"), sides, [*CITY, "cod", "nm", "f"])
        .groupBy(*CITY, "cod", "nm", F.col("dim").alias("lado"), F.col("valor").alias("zona"))
        .agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"))
    )
    return (
        mark_bike(totals, walking_codes(base))
        .where("bici")
        .groupBy(*CITY, "lado", "zona")
        .agg(F.sum("f").alias("viajes"), F.sum("n").alias("n"))
    )


def crosstab(trips: DataFrame, dims: Mapping[str, str] = CROSS_DIMENSIONS) -> DataFrame:
    """Bike share inside each group, per city-year, dimension and value.

    Dimensions the table lacks are skipped; hour and purpose also combine to
    ``hour|purpose``.
    """
    base = prepare(trips)
    found = {d: c for d, c in dims.items() if c in trips.columns}
    values = {d: valid_hour(F.col(c)) if d == "hora" else F.col(c) for d, c in found.items()}
    if "hora" in found and "proposito" in found:
        hour, purpose = values["hora"].cast("string"), F.col(found["proposito"])
        values["hora_prop"] = F.concat(hour, F.lit("|"), purpose)
    totals = (
        _long(base, values, [*CITY, "cod", "nm", "f"])
        .groupBy(*CITY, "cod", "nm", "dim", "valor")
        .agg(F.sum("f").alias("f"))
    )
    marked = _same(totals, walking_codes(base), CITY).withColumn("bici", _bike())
    bike, all_ = total_if(F.col("bici"), F.col("f")), F.sum("f")
    return marked.groupBy(*CITY, "dim", "valor").agg(
        half_even(bike, 1).alias("bici"),
        half_even(all_, 1).alias("total"),
        F.when(all_ > 0, half_even(100 * bike / all_, 3)).alias("part"),
    )


def hour_purpose(cross: DataFrame) -> DataFrame:
    """The combined rows of a crosstab with hour and purpose as columns again; a purpose
    keeps bars of its own."""
    bar = F.locate("|", F.col("valor"))
    return cross.where(F.col("dim") == "hora_prop").select(
        *[c for c in CITY if c in cross.columns],
        F.substr("valor", F.lit(1), bar - 1).cast("int").alias("hora"),
        F.substr("valor", bar + 1).alias("proposito"),
        *[c for c in cross.columns if c not in (*CITY, "dim", "valor")],
    )


def national_crosstab(cross: DataFrame) -> DataFrame:
    """The same table over all cities, its share recomputed from the sums."""
    return cross.groupBy("dim", "valor").agg(
        F.sum("bici").alias("bici"),
        F.sum("total").alias("total"),
        ratio(F.sum("bici"), F.sum("total")).alias("part"),
    )


def hour_vector(profile: DataFrame, by: Sequence[str] = ("ciudad",)) -> DataFrame:
    """24 slots per city, absent hours 0; cities with no trips at all drop."""
    hour = F.col("valor").try_cast("int")
    slots = F.array(*[total_if(hour == h, F.col("viajes")) for h in range(24)])
    return (
        profile.where(F.col("dim") == "hora")
        .groupBy(*by)
        .agg(slots.alias("horas"), F.sum("viajes").alias("_t"))
        .where(F.col("_t") > 0)
        .drop("_t")
    )


def hour_rows(vectors: DataFrame, by: Sequence[str] = ("ciudad",)) -> DataFrame:
    return vectors.select(*by, F.posexplode("horas").alias("hora", "viajes"))


def band_of(dist: Column) -> Column:
    """Band number 0-8; negative or missing distance has none."""
    return F.when(dist >= 0, F.least(F.floor(dist), F.lit(len(BANDS) - 1)).cast("int"))


def with_modes(marked: DataFrame) -> DataFrame:
    """A bike trip counts as bike and as one of all trips."""
    modes = F.when(F.col("bici"), F.array(F.lit("bicicleta"), F.lit("todos"))).otherwise(F.array(F.lit("todos")))
    return marked.withColumn("modo", F.explode(modes))


def distance_bands(trips: DataFrame, dist: str = "dist_km") -> DataFrame:
    """Trips and percentage per city, mode and band; empty bands show 0."""
    base = prepare(trips)
    totals = (
        base.withColumn("_band", band_of(F.col(dist)))
        .where(F.col("_band").isNotNull())
        .groupBy(*CITY, "cod", "nm", "_band")
        .agg(F.sum("f").alias("f"))
    )
    slots = F.array(*[total_if(F.col("_band") == i, F.col("f")) for i in range(len(BANDS))])
    names = F.array(*[F.lit(b) for b in BANDS])
    return (
        with_modes(mark_bike(totals, walking_codes(base)))
        .groupBy(*CITY, "modo")
        .agg(slots.alias("_s"), F.sum("f").alias("_t"))
        .where(F.col("_t") > 0)
        .select(*CITY, "modo", "_t", F.posexplode("_s").alias("_i", "_v"))
        .select(
            *CITY,
            "modo",
            F.get(names, F.col("_i")).alias("tramo"),
            half_even(F.col("_v"), 1).alias("viajes"),
            half_even(100 * F.col("_v") / F.col("_t"), 3).alias("part"),
        )
    )


def national_bands(bands: DataFrame) -> DataFrame:
    per = bands.groupBy("modo", "tramo").agg(F.sum("viajes").alias("viajes"))
    sums = per.groupBy("modo").agg(F.sum("viajes").alias("_t"))
    return per.join(sums, "modo").withColumn("part", ratio(F.col("viajes"), F.col("_t"))).drop("_t")


def cumulative_bands(national: DataFrame) -> DataFrame:
    """Running percentage over the nine bands of a mode, and the part under the last."""
    order = F.array(*[F.lit(b) for b in BANDS])
    slot = F.array_position(order, F.col("tramo"))
    run = F.array(*[total_if(slot <= i + 1, F.col("part")) for i in range(len(BANDS))])
    under = total_if(F.col("tramo") != BANDS[-1], F.col("part"))
    return (
        national.groupBy("modo")
        .agg(run.alias("_r"), under.alias("bajo_8"))
        .select("modo", "bajo_8", F.posexplode("_r").alias("_i", "acum"))
        .select("modo", F.get(order, F.col("_i")).alias("tramo"), "acum", "bajo_8")
    )


def distance_summary(trips: DataFrame, dist: str = "dist_km") -> DataFrame:
    """Weighted mean and weighted lower median of the unbinned distance.

    Trips are summed per distinct distance first.
    """
    base = prepare(trips).where(F.col(dist) >= 0)
    totals = base.groupBy(*CITY, "cod", "nm", F.col(dist).alias("_d")).agg(F.sum("f").alias("f"))
    moded = settle(with_modes(mark_bike(totals, walking_codes(prepare(trips)))).where(F.col("f") > 0))
    keys = [*CITY, "modo"]
    means = moded.groupBy(*keys).agg(
        half_even(weighted_mean(F.col("_d"), F.col("f")), 3).alias("dist_media_km"),
        half_even(F.sum("f"), 1).alias("viajes"),
    )
    medians = weighted_lower_median(moded, keys, "_d", "f", "dist_mediana_km").drop("total_weight")
    return _same(means, medians, keys).withColumn("dist_mediana_km", half_even(F.col("dist_mediana_km"), 3))


def travel_time_medians(trips: DataFrame, time: str = "tiempo_viaje") -> DataFrame:
    """Weighted median minutes per city, all modes and bike; out-of-range times drop."""
    base = prepare(trips).withColumn("_t", guard_range(safe_double(F.col(time)), 0, LONGEST_MIN))
    totals = (
        base.groupBy(*CITY, "cod", "nm", "_t").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("n"))
    )
    marked = settle(mark_bike(totals, walking_codes(base)))
    cities = marked.groupBy(*CITY).agg(
        F.coalesce(F.sum(F.when(F.col("bici"), F.col("n"))), F.lit(0)).alias("n_bici")
    )
    every = weighted_lower_median(marked, CITY, "_t", "f", "tiempo_med_min").drop("total_weight")
    bike = weighted_lower_median(marked.where("bici"), CITY, "_t", "f", "tiempo_med_bici_min").drop("total_weight")
    return _same(_same(cities, every, CITY, "left"), bike, CITY, "left")


def trip_distances(trips: DataFrame, centroids: DataFrame) -> DataFrame:
    """Attach ``dist_km`` from zone centroids (``ciudad, zona, lon, lat, radio_km``)."""
    from ..functions.geo import haversine_km, trip_distance_km
    from ..functions.text import strip_decimal

    def side(s: str, zone: str) -> DataFrame:
        return centroids.select(
            "ciudad",
            strip_decimal(F.col("zona")).alias(zone),
            F.col("lon").alias(f"_lon_{s}"),
            F.col("lat").alias(f"_lat_{s}"),
            F.col("radio_km").alias(f"_rad_{s}"),
        )

    keyed = trips.withColumn("_zo", strip_decimal(F.col("zona_origen").cast("string"))).withColumn(
        "_zd", strip_decimal(F.col("zona_destino").cast("string"))
    )
    far = haversine_km(F.col("_lon_o"), F.col("_lat_o"), F.col("_lon_d"), F.col("_lat_d"))
    same = F.coalesce(F.col("_zo") == F.col("_zd"), F.lit(False))
    return (
        keyed.join(side("o", "_zo"), ["ciudad", "_zo"], "left")
        .join(side("d", "_zd"), ["ciudad", "_zd"], "left")
        .withColumn("dist_km", trip_distance_km(same, F.col("_rad_o"), far))
        .drop("_zo", "_zd", "_lon_o", "_lat_o", "_rad_o", "_lon_d", "_lat_d", "_rad_d")
    )


def against_official(summary: DataFrame, official: DataFrame) -> DataFrame:
    """Join the official index by city key and judge whether it can be trusted.

    It must reproduce the survey's own non-motorised share, and declare walking
    that exceeds cycling.
    """
    share = lambda c: ratio(F.col(c), F.col("viajes_diarios"))
    index = official.select(
        alnum_key(F.col("ciudad")).alias("_k"),
        share("v_no_motorizado").alias("ofi_bici_pct"),
        share("v_caminata").alias("ofi_cam_pct"),
        "v_no_motorizado",
        "v_caminata",
    )
    walk, bike = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("v_caminata", "v_no_motorizado"))
    close = F.abs(F.col("ofi_nomot_pct") - F.col("nomot_pct")) <= CONSISTENCY_PP
    return (
        summary.withColumn("_k", alnum_key(F.col("ciudad")))
        .join(index, "_k", "left")
        .withColumn("ofi_nomot_pct", F.col("ofi_bici_pct") + F.col("ofi_cam_pct"))
        .withColumn("indice_consistente", F.coalesce(close, F.lit(False)) & (walk > 0) & (walk > bike))
        .withColumn("dif_pp", F.col("bici_pct") - F.col("ofi_bici_pct"))
        .drop("_k")
    )


def city_kpis(index: DataFrame, computed: DataFrame, *side_tables: DataFrame) -> DataFrame:
    """Published city index, full outer with the computed KPIs and side tables.

    Columns of the computed side that the index also has are dropped first, so
    no name is ever split in two.
    """
    def keyed(df):
        return df.withColumn("k", alnum_key(F.col("ciudad")))

    own = keyed(computed)
    for extra in side_tables:
        clash = [c for c in extra.columns if c in own.columns]
        own = own.join(keyed(extra).drop(*clash), "k", "left")
    left = keyed(index)
    clash = [c for c in own.columns if c in left.columns and c != "k"]
    return left.join(own.drop(*clash), "k", "outer")


def published_walking(own: Column, index: Column, non_motorised: Column) -> Column:
    """Own figure first; the index's zero non-motorised share means unmeasured."""
    return F.coalesce(own, F.when(F.coalesce(non_motorised, F.lit(0.0)) > 0, index))


def city_ranking(validated: DataFrame) -> DataFrame:
    """Cities by bike share; the official figure only where it is consistent."""
    return (
        validated.where("separable")
        .withColumn("ofi", F.when(F.col("indice_consistente"), F.col("ofi_bici_pct")))
        .orderBy(F.desc("bici_pct"), "ciudad")
    )


def gender_ratio(cross: DataFrame, first: str = "Hombre", second: str = "Mujer") -> DataFrame:
    """How many times more one group cycles than the other, per city."""
    part = lambda v: F.max(F.when(F.col("valor") == v, F.col("part")))
    return (
        cross.where(F.col("dim") == "sexo")
        .groupBy("ciudad")
        .agg(part(first).alias("a"), part(second).alias("b"))
        .select("ciudad", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("razon"))
    )


def time_gap(kpis: DataFrame) -> DataFrame:
    """Minutes a bike trip is shorter than the city's median, where it is."""
    gap = F.col("tiempo_med_min") - F.col("tiempo_med_bici_min")
    return kpis.withColumn("minutos_menos", F.when(gap > 0, gap))
