"""Serving tables by commune, zone, segment and point, and scope-filtered KPIs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.geo import in_country, point, round_swapped
from ..functions.numbers import (
    count_if,
    json_number,
    lesser_known,
    per_thousand,
    ratio,
    support_status,
    total,
    total_if,
    weighted_mean,
)
from ..functions.text import clip, code_text, norm_name, ordinal_of, search_key, year_of, zero_pad
from .coverage import NEAR, within
from .ranks import class_breaks, class_of, diverging_breaks

# Stage order of the serving tables; an unknown stage gets the last code.
STAGES = ["existentes", "diseño", "planificadas", "ejecución"]
UNKNOWN_STAGE = 3
# Display labels of infrastructure types and sitings.
TYPE_LABELS = {
    "ciclovía": "Ciclovía",
    "smp": "Senda multipropósito (MOP)",
    "s_i": "Sin información",
    "zona30": "Zona 30",
    "cicloparque": "Cicloparque",
    "ciclovía temporal/piloto": "Ciclovía temporal o piloto",
    "via verde": "Vía verde",
    "zona30/contraflujo": "Zona 30 con contraflujo",
    "ciclovía (rediseño cruce)": "Ciclovía con rediseño de cruce",
}
SITING_LABELS = {"s_i": "Sin información"}
# Communes each survey city covers.
CITY_COMMUNES = {
    "Arica": ["Arica"],
    "Iquique - Alto Hospicio": ["Iquique", "Alto Hospicio"],
    "Antofagasta": ["Antofagasta"],
    "Copiapó": ["Copiapó"],
    "Coquimbo - La Serena": ["La Serena", "Coquimbo"],
    "Gran Valparaíso": ["Valparaíso", "Viña del Mar", "Concón", "Quilpué", "Villa Alemana"],
    "San Antonio": ["San Antonio"],
    "Rancagua - Machalí": ["Rancagua", "Machalí"],
    "Talca": ["Talca"],
    "Curicó": ["Curicó"],
    "Linares": ["Linares"],
    "Chillán": ["Chillán", "Chillán Viejo"],
    "Gran Concepción": [
        "Concepción",
        "Talcahuano",
        "Hualpén",
        "San Pedro de la Paz",
        "Chiguayante",
        "Penco",
        "Tomé",
        "Coronel",
        "Lota",
        "Hualqui",
    ],
    "Temuco - Padre las Casas": ["Temuco", "Padre las Casas"],
    "Valdivia": ["Valdivia"],
    "Osorno": ["Osorno"],
    "Puerto Montt": ["Puerto Montt"],
    "Punta Arenas": ["Punta Arenas"],
}
# Years of execution that are shown, by table and by chart.
YEARS = (1990, 2030)
CHART_YEARS = (2005, 2030)


def drop_clashes(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop from ``other`` what ``df`` already has, so a join never splits a name."""
    return other.drop(*[c for c in other.columns if c in df.columns and c not in keys])


def commune_mart(spine: DataFrame, *tables: DataFrame, key: str = "cut_com") -> DataFrame:
    """Census spine with every other commune table left-joined.

    A commune missing from a table stays NULL there: absence is not zero.
    """
    out = spine
    for t in tables:
        out = out.join(drop_clashes(out, t, [key]), key, "left")
    return out


def km_by_stage(segments: DataFrame, key: str, stage: str, km: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """km per stage in columns; a stage the territory lacks is 0."""
    return segments.groupBy(key).agg(*[total_if(F.col(stage) == s, F.col(km)).alias(f"km_{s}") for s in stages])


def km_by_year(segments: DataFrame, year: str, km: str, years: tuple[int, int] = YEARS) -> DataFrame:
    """km and segments by year of execution, with the running share.

    The window sees one row per year.
    """
    y = year_of(F.col(year).cast("string"))
    per = (
        segments.withColumn("anio", y)
        .where(F.col("anio").between(*years))
        .groupBy("anio")
        .agg(F.sum(km).alias("km"), F.count(F.lit(1)).alias("tramos"))
    )
    all_ = per.agg(F.sum("km").alias("_t"))
    run = F.sum("km").over(Window.orderBy("anio").rowsBetween(Window.unboundedPreceding, 0))
    return (
        per.withColumn("_run", run)
        .withColumn("_one", F.lit(0))
        .join(F.broadcast(all_.withColumn("_one", F.lit(0))), "_one")
        .select("anio", "km", "tramos", ratio(F.col("_run"), F.col("_t")).alias("acum_pct"))
    )


def top_totals(df: DataFrame, group: str, measure: str, k: int, missing: str = "sin dato") -> DataFrame:
    """Largest ``k`` groups by summed measure; NULL groups show as missing."""
    return (
        df.groupBy(F.coalesce(F.col(group), F.lit(missing)).alias(group))
        .agg(F.sum(measure).alias(measure))
        .orderBy(F.desc(measure), group)
        .limit(k)
    )


def type_table(segments: DataFrame, kind: str, existing: Column, km: str, k: int = 12) -> DataFrame:
    """km by type, existing and other in columns, with total; top ``k`` by total."""
    return (
        segments.groupBy(F.coalesce(F.col(kind), F.lit("sin dato")).alias(kind))
        .agg(
            total_if(existing, F.col(km)).alias("km_existentes"),
            total_if(~existing, F.col(km)).alias("km_otras"),
            total(F.col(km)).alias("km_total"),
        )
        .orderBy(F.desc("km_total"), kind)
        .limit(k)
    )


def crash_counts(crashes: DataFrame, by: Sequence[str], deaths: str, serious: str) -> DataFrame:
    known = crashes
    for k in by:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sin_bici"), total(F.col(deaths)).alias("sin_fall"), total(F.col(serious)).alias("sin_grav")
    )


def crash_table(crashes: DataFrame) -> DataFrame:
    """Georeferenced crashes with a repaired commune code (NULL stays NULL)."""
    return crashes.withColumn("cut_com", zero_pad(code_text(F.col("cut_com")))).where(
        in_country(F.col("lat"), F.col("lon"))
    )


def scope_communes(
    communes: DataFrame,
    commune: str | None = None,
    metro: Sequence[str] | None = None,
    region: str | None = None,
    key: str = "cut_com",
    region_col: str = "reg",
) -> DataFrame:
    """Communes in scope: commune beats metro area beats region beats all."""
    if commune:
        return communes.where(F.col(key) == commune)
    if metro:
        return communes.where(F.col(key).isin(list(metro)))
    if region:
        return communes.where(F.col(region_col) == region)
    return communes


def in_scope(df: DataFrame, scope: DataFrame, key: str = "cut_com") -> DataFrame:
    return df.join(scope.select(key), key, "left_semi")


def scope_kpis(mart: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """KPI card of a scope (or of each region) from commune rows.

    Coverage is re-weighted by population; the modal share falls back to riders
    where no mode was declared.
    """
    km = total(F.col("kme"))
    pob, bici = total(F.col("pob")), total(F.col("bici"))
    moves = total(F.col("viajes_modo"))
    covered = total(F.col("cob") / 100 * F.col("pob"))
    riders = total(F.col("cobb") / 100 * F.col("bici"))
    return mart.groupBy(*by).agg(
        F.count(F.lit(1)).alias("comunas"),
        count_if(F.col("kme") > 0).alias("comunas_con_red"),
        km.alias("km_existentes"),
        total(F.coalesce("kmd", F.lit(0.0)) + F.coalesce("kmp", F.lit(0.0))).alias("km_cartera"),
        pob.alias("pob"),
        ratio(covered, pob).alias("pct_pob"),
        bici.alias("bici"),
        ratio(bici, F.when(moves != 0, moves).otherwise(bici)).alias("pct_modal"),
        ratio(riders, bici).alias("pct_bici"),
        total(F.col("sini")).alias("siniestros"),
        total(F.col("sinf")).alias("fallecidos"),
    )


def km_per_fragment(kpis: DataFrame, fragments: Column) -> DataFrame:
    return kpis.withColumn("fragmentos", fragments).withColumn(
        "km_por_fragmento", ratio(F.col("km_existentes"), F.col("fragmentos"), 1.0)
    )


def zone_card(zones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return zones.groupBy(*by).agg(
        F.count(F.lit(1)).alias("zonas"),
        total(F.col("pob")).alias("pob"),
        total(F.col("bici")).alias("bici"),
        total(F.col("sin_bici")).alias("siniestros"),
    )


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups of ``left`` with the figures of ``right``; both one row without ``by``."""
    if by:
        return left.join(right, list(by), "left")
    one = right.withColumn("_one", F.lit(0))
    return left.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")


def scope_card(
    mart: DataFrame, segments: DataFrame, counters: DataFrame, by: Sequence[str] = (), key: str = "cut_com"
) -> DataFrame:
    """KPI card of a scope, or of each group of its communes: the sums of
    ``scope_kpis``, distinct fragments touching the scope with their mean length, and
    flow counters. ``segments`` carry ``component``; both need only the commune key."""
    places = mart.select(key, *by)

    def counted(df: DataFrame, what: Column, name: str) -> DataFrame:
        return df.join(places, key).groupBy(*by).agg(what.alias(name))

    card = scope_kpis(mart, by)
    card = _beside(card, counted(segments.select(key, "component"), F.countDistinct("component"), "_f"), by)
    card = _beside(card, counted(counters.select(key), F.count(F.lit(1)), "contadores"), by)
    card = km_per_fragment(card, F.coalesce("_f", F.lit(0))).drop("_f")
    return card.withColumn("contadores", F.coalesce("contadores", F.lit(0)))


def zone_scope_card(
    zones: DataFrame, mart: DataFrame, counters: DataFrame, by: Sequence[str] = (), key: str = "cut_com"
) -> DataFrame:
    """``zone_card`` of a scope with the modal share of its communes and its counters.

    ``by`` are columns of ``mart`` (or the commune key itself)."""
    by = list(by)
    extra = [c for c in by if c != key]
    places = mart.select(key, *extra)
    share = mart.groupBy(*by).agg(total(F.col("viajes_modo")).alias("_m"))
    posts = counters.select(key).join(places, key).groupBy(*by).agg(F.count(F.lit(1)).alias("contadores"))
    card = _beside(_beside(zone_card(zones.join(places, key), by), share, by), posts, by)
    return card.withColumns(
        {"pct_modal": ratio(F.col("bici"), F.col("_m")), "contadores": F.coalesce("contadores", F.lit(0))}
    ).drop("_m")


def territory_sheet(mart: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Census part of a territory's sheet: people, declared modes, riders, their share,
    riders near the network, length and crashes."""
    bici, modes = total(F.col("bici")), total(F.col("viajes_modo"))
    return mart.groupBy(*by).agg(
        total(F.col("pob")).alias("habitantes"),
        modes.alias("declaran_modo"),
        bici.alias("bici"),
        ratio(bici, modes).alias("pct_modal"),
        ratio(total(F.col("cobb") / 100 * F.col("bici")), bici).alias("pct_bici"),
        total(F.col("kme")).alias("km_existentes"),
        total(F.col("sini")).alias("siniestros"),
    )


def best_city(city_communes: DataFrame, scope: DataFrame, city: str = "ciudad", key: str = "cut_com") -> DataFrame:
    """City sharing most communes with the scope; no row without any overlap."""
    return (
        in_scope(city_communes, scope, key)
        .groupBy(city)
        .agg(F.countDistinct(key).alias("n"))
        .orderBy(F.desc("n"), city)
        .limit(1)
    )


def city_of_commune(points: DataFrame, city_communes: DataFrame, city: str = "ciudad", key: str = "cut_com") -> DataFrame:
    """City of a point through its commune's membership, first city by name."""
    one = city_communes.groupBy(key).agg(F.min(city).alias(city))
    return points.join(one, key, "left")


def resolve_cities(cities: DataFrame, communes: DataFrame, city: str = "ciudad", names: str = "comunas", name: str = "nom"):
    """City lists exploded and matched to communes by accent-free name.

    Returns the matches and, separately, the names nothing matched.
    """
    listed = cities.select(city, F.explode(names).alias("_name")).withColumn("_k", norm_name(F.col("_name")))
    keyed = communes.withColumn("_k", norm_name(F.col(name)))
    found = listed.join(keyed, "_k").drop("_k", "_name")
    missing = listed.join(keyed.select("_k").distinct(), "_k", "left_anti").select(city, F.col("_name").alias("comuna"))
    return found, missing


def display_names(rows: DataFrame, names: DataFrame, code: str, name: str, order: str) -> DataFrame:
    """Rows with the first name of their code by ``order``; NULL where the code has none."""
    one = names.where(F.col(code).isNotNull() & F.col(name).isNotNull())
    one = one.groupBy(code).agg(F.min(F.struct(order, name))[name].alias(name))
    return rows.join(one, code, "left")


def listed_cities(spark: SparkSession, extra: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``(ciudad, comunas)`` of the fixed list, plus cities read elsewhere."""
    cities = {**CITY_COMMUNES, **(extra or {})}
    return spark.createDataFrame(
        [(c, list(names)) for c, names in cities.items()], "ciudad string, comunas array<string>"
    )


def city_census(found: DataFrame, city: str = "ciudad", bike: str = "bici", moves: str = "viajes_modo") -> DataFrame:
    """Census bike share over the communes each city covers."""
    return found.groupBy(city).agg(
        ratio(F.sum(bike), F.sum(moves)).alias("censo_bici_pct"), F.count(F.lit(1)).alias("censo_comunas")
    )


def same_name(a: Column, b: Column) -> Column:
    """Equal without accents or case, or one contained in the other."""
    x, y = search_key(a), search_key(b)
    return (x == y) | x.contains(y) | y.contains(x)


def zone_aggregate(
    blocks: DataFrame,
    zone: str,
    labels: Sequence[str],
    people: str,
    riders: str,
    moves: str,
    dist: str,
    schooling: str | None = None,
    near: float = NEAR,
) -> DataFrame:
    """Blocks summed to zones; distance is weighted by population.

    ``schooling`` counts an unknown value as 0 in ``escolaridad``, and leaves it
    out in ``escolaridad_informada``. Labels are the smallest of the zone's.
    """
    p, b, d = F.col(people), F.col(riders), F.col(dist)
    aggs = [
        *[F.min(c).alias(c) for c in labels],
        total(p).alias("pob"),
        total(b).alias("bici"),
        total(F.col(moves)).alias("viajes_modo"),
        F.count(F.lit(1)).alias("manzanas"),
        weighted_mean(d, p, else_plain=True).alias("dist_m"),
        total_if(within(d, near), p).alias("pob_cub_300"),
        total_if(within(d, near), b).alias("bici_cub_300"),
        ratio(total(b), total(F.col(moves))).alias("bici_pct"),
        ratio(total_if(within(d, near), p), total(p)).alias("cob_pct"),
    ]
    if schooling:
        s = F.col(schooling)
        aggs += [
            weighted_mean(F.coalesce(s, F.lit(0.0)), p).alias("escolaridad"),
            weighted_mean(s, p).alias("escolaridad_informada"),
        ]
    return blocks.where(F.col(zone).isNotNull()).groupBy(zone).agg(*aggs)


def zone_mart(
    aggregate: DataFrame, shapes: DataFrame, crashes: DataFrame, scores: DataFrame | None = None, survey: DataFrame | None = None, zone: str = "zona"
):
    """Zones that have both data and shape, with crash counts filled with 0 and
    survey figures left NULL where there was none; plus the zones without shape."""
    base = aggregate
    if scores is not None:
        base = base.join(scores, zone, "left")
    base = base.join(crashes, zone, "left").na.fill(0, ["sin_bici", "sin_fall", "sin_grav"])
    if survey is not None:
        base = base.join(survey, zone, "left")
    lost = base.join(shapes.select(zone).distinct(), zone, "left_anti")
    return base.join(shapes, zone), lost


def merge_city_pieces(pieces: DataFrame, zone: str, values: Sequence[str], label: str) -> DataFrame:
    """Zones touched by two surveys are summed and keep their first label by name."""
    return pieces.groupBy(zone).agg(*[F.sum(v).alias(v) for v in values], F.min(label).alias(label))


def zone_measures(zones: DataFrame, gen: str, attr: str, n_gen: str, n_attr: str, people: str) -> DataFrame:
    """Trips per 1,000 people, net balance, and the sample each rests on."""
    return zones.withColumns(
        {
            "egen_pc": per_thousand(F.col(gen), F.col(people)),
            "esaldo": F.col(gen) - F.col(attr),
            "en": F.col(n_gen),
            "en_sal": lesser_known(F.col(n_gen), F.col(n_attr)),
        }
    )


def classify(
    zones: DataFrame, measure: str, support: str | None = None, diverging: bool = False, reverse: bool = False
) -> DataFrame:
    """Class and support status of each zone.

    Zones without enough survey behind them stay out of the breaks as well.
    """
    status = support_status(F.col(support)) if support else F.lit("ok")
    marked = zones.withColumn("respaldo", status)
    # an indicator without a survey count is never gated; no count is no gate either
    used = marked.where(F.col("respaldo") != "insufficient")
    breaks = (diverging_breaks if diverging else class_breaks)(used, [], measure)
    one = breaks.withColumn("_one", F.lit(0))
    return (
        marked.withColumn("_one", F.lit(0))
        .join(F.broadcast(one), "_one", "left")
        .withColumn(
            "clase",
            F.when(F.col("respaldo") != "insufficient", class_of(F.col(measure), F.col("breaks"), reverse)),
        )
        .drop("_one", "breaks")
    )


def counter_split(counters: DataFrame, weekday: str, weekend: str, by: Sequence[str] = ()) -> DataFrame:
    """Counters whose use drops at the weekend: the sign of trips that must be made."""
    both = counters.where(F.col(weekday).isNotNull() & F.col(weekend).isNotNull())
    fewer = count_if(F.col(weekend) < F.col(weekday))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("contadores"), fewer.alias("bajan"), ratio(fewer, F.count(F.lit(1))).alias("pct")
    )


def fragmentation_scatter(communes: DataFrame, km: str, largest: str, least: float = 3) -> DataFrame:
    return communes.where((F.col(km) > least) & F.col(largest).isNotNull())


def scenario_compare(base: DataFrame, planned: DataFrame, key: str, index: str) -> DataFrame:
    """Territories that improve or stay equal with the plans, and the mean rise."""
    both = base.select(key, F.col(index).alias("_a")).join(planned.select(key, F.col(index).alias("_b")), key)
    rise = F.col("_b") - F.col("_a")
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        count_if(rise > 0).alias("improve"),
        count_if(rise == 0).alias("equal"),
        count_if(rise < 0).alias("worsen"),
        F.avg(rise).alias("mean_rise"),
    )


def area_recipe(segments: DataFrame, counters: DataFrame, scope: DataFrame, stage: str = "etapa", km: str = "km", km_geom: str = "km_geom") -> DataFrame:
    """Summary of an area: segments, km by stage both ways, components, counters."""
    segs = in_scope(segments, scope)
    built = F.col(stage) == STAGES[0]
    one = segs.agg(
        F.count(F.lit(1)).alias("tramos"),
        count_if(built).alias("existentes"),
        total_if(built, F.col(km)).alias("km_existentes"),
        total_if(built, F.col(km_geom)).alias("km_medidos"),
        *[total_if(F.col(stage) == s, F.col(km)).alias(f"km_{s}") for s in STAGES[1:]],
        F.countDistinct(F.when(built, F.col("component"))).alias("componentes"),
    ).withColumn("_one", F.lit(0))
    posts = in_scope(counters, scope).agg(F.count(F.lit(1)).alias("contadores")).withColumn("_one", F.lit(0))
    return one.join(F.broadcast(posts), "_one").drop("_one")


# serving projections: short names, rounded, display labels, no empty geometry


def serve_segments(segments: DataFrame, line: str = "line") -> DataFrame:
    return segments.where(F.size(F.col(line)) > 0).select(
        ordinal_of(F.col("etapa"), STAGES, UNKNOWN_STAGE).alias("e"),
        clip(F.col("cut_com"), 5).alias("c"),
        clip(F.col("eje_via"), 55).alias("n"),
        json_number(F.col("km")).alias("k"),
        clip(F.col("tipo"), 30).alias("t"),
        clip(F.col("year_ejecucion").cast("string"), 4).alias("a"),
        clip(F.col("emplaza_txt"), 18).alias("em"),
        F.transform(F.col(line), lambda part: round_swapped(part)).alias("g"),
    )


def serve_points(
    df: DataFrame, fields: Mapping[str, Column], lat: str = "lat", lon: str = "lon", digits: int = 5
) -> DataFrame:
    """Point rows with chosen short fields and a rounded ``[lat, lon]``."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        *[c.alias(n) for n, c in fields.items()],
        F.array(F.bround(F.col(lat), digits), F.bround(F.col(lon), digits)).alias("ll"),
    )


def serve_crashes(crashes: DataFrame) -> DataFrame:
    return serve_points(
        crashes,
        {
            "a": F.col("anio").cast("int"),
            "h": F.col("hora").cast("int"),
            "c": F.col("cut_com"),
            "f": F.coalesce(F.col("fallecidos"), F.lit(0)).cast("int"),
            "gr": F.coalesce(F.col("graves"), F.lit(0)).cast("int"),
            "t": clip(F.col("tipo_final"), 26),
        },
    )


def serve_places(places: DataFrame) -> DataFrame:
    return serve_points(
        places,
        {
            "n": clip(F.col("nombre"), 46),
            "c": F.coalesce(F.col("cut_com"), F.lit("")),
            "k": F.when(F.col("clase") == "escolar", 0).otherwise(1),
            "d": json_number(F.col("dist_existente_m"), 0),
            "m": F.col("matricula").cast("int"),
        },
    )


def serve_counters(counters: DataFrame) -> DataFrame:
    return serve_points(
        counters,
        {
            "n": clip(F.col("NOMBRE_CONTADOR"), 50),
            "c": zero_pad(F.coalesce(F.col("CUT_COM").cast("string"), F.lit(""))),
            "m": json_number(F.col("Media_diaria"), 1),
            "x": json_number(F.col("Max_diaria"), 0),
            "hab": json_number(F.col("Promedio_dia_de_semana"), 1),
            "fds": json_number(F.col("Promedio_fin_de_semana"), 1),
            "sem": json_number(F.col("Media_semanal"), 0),
            "prov": clip(F.col("PROVEEDOR"), 20),
            "d0": F.date_format("Primera_fecha_iso", "yyyy-MM-dd"),
            "d1": F.date_format("Ultima_fecha_iso", "yyyy-MM-dd"),
        },
    )


# Short names of survey and crash figures, their column and digits.
ZONE_EXTRAS = {
    "esc": ("escolares", 0),
    "sini": ("sin_bici", 0),
    "sinf": ("sin_fall", 0),
    "egen": ("eod_bici_gen", 0),
    "eatr": ("eod_bici_atr", 0),
    "egpc": ("egen_pc", 1),
    "esal": ("esaldo", 0),
    "en": ("en", 1),
    "ens": ("en_sal", 1),
}


def serve_zones(zones: DataFrame, shape: str = "geom") -> DataFrame:
    """Zone rows with four-decimal outer rings; figures the mart lacks are NULL."""
    n = json_number
    have = lambda c: F.col(c) if c in zones.columns else F.lit(None)
    return zones.where(F.size(F.col(shape)) > 0).select(
        F.col("zona").alias("z"),
        zero_pad(F.col("cut_com")).alias("c"),
        clip(F.col("comuna"), 28).alias("nom"),
        n(F.col("pob"), 0).alias("pob"),
        n(F.col("bici"), 0).alias("bici"),
        n(F.col("bici_pct")).alias("bp"),
        n(F.col("cob_pct")).alias("cob"),
        n(F.col("dist_m"), 0).alias("d"),
        n(F.col("nse_score")).alias("nse"),
        *[n(have(c).cast("double"), digits).alias(short) for short, (c, digits) in ZONE_EXTRAS.items()],
        F.nullif(have("eod_ciudad").cast("string"), F.lit("")).alias("eciu"),
        F.transform(F.col(shape), lambda g: round_swapped(g["shell"], 4)).alias("g"),
    )


def serve_communes_geo(shapes: DataFrame, mart: DataFrame, key: str = "cut_com", name: str = "nom", shape: str = "geom") -> DataFrame:
    """Shapes of the communes in the mart only, reduced to code, name and four decimals."""

    def ring(r: Column) -> Column:
        return F.transform(r, lambda p: point(F.bround(p["x"], 4), F.bround(p["y"], 4)))

    rounded = F.transform(
        F.col(shape),
        lambda g: F.struct(ring(g["shell"]).alias("shell"), F.transform(g["holes"], ring).alias("holes")),
    )
    return shapes.join(mart.select(key).distinct(), key, "left_semi").select(key, name, rounded.alias(shape))
