"""Segment x snapshot panel: homogenised columns, repaired keys, flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import NO_INFORMATION, count_if, ratio, safe_double
from ..functions.text import clean_text, name_key, region_of, repair_code

# Output column -> source names in order of preference.
FIELD_SOURCES = {
    "identifica": ["IDENTIFICA"],
    "region_txt": ["REGIÓN", "REGION"],
    "comuna_txt": ["COMUNA"],
    "eje_via": ["EJE_VIA"],
    "inicio": ["INICIO"],
    "fin": ["FIN"],
    "km": ["KM"],
    "tipo": ["TIPO"],
    "carac_func": ["CARAC_FUNC"],
    "emplaza_txt": ["EMPLAZA_TEX", "EMPLAZA_TE"],
    "emplaza_n": ["EMPLAZA_N"],
    "urbana": ["URBANA"],
    "etapa": ["ETAPA"],
    "etapa_det": ["Etapa_det", "ETAPA_DET"],
    "cartera": ["CARTERA"],
    "bip_pmu": ["BIP_o_PMU", "BIP_PMU"],
    "nombre_proyecto": ["NOMBRE_PROYECTO_BIP_o_PMU", "NOM_PROYECTO", "NOMBRE_PRO"],
    "normativa": ["NORMATIVA"],
    "resolucion": ["RESOLUCION"],
    "comentario": ["COMENTARIO"],
    "cut_reg_declarado": ["CUT_REG"],
    "cut_com_crudo": ["CUT_COM"],
    "year_ejecucion": ["YEAR_EJECUCION", "YEAR_EJECU", "FECHA_EJECUCION", "FECHA_EJE_tex"],
    "fuente_actualiza": ["FUENTE_ACTUALIZA", "FUENTE_UPDATE", "FUENTE_ACT", "FUENTE_UPD"],
}
# Fixed value: stage that counts as built.
EXISTING_STAGE = "existentes"
# Fixed value: the column that is a number in every snapshot, however it came.
MEASURES = ("km",)
# Fixed value: farther than this from its own commune, a segment is no border case (m).
CONFLICT_M = 500


def homogenise(df: DataFrame, fields: Mapping[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Every target column from its first existing source, else NULL without a type,
    so that snapshots which have the column decide its type."""
    present = set(df.columns)

    def pick(target: str, names: Sequence[str]) -> Column:
        for name in names:
            if name in present:
                return F.col(f"`{name}`").alias(target)
        return F.lit(None).alias(target)

    return df.select(*[pick(t, names) for t, names in fields.items()], *keep)


def clean_strings(df: DataFrame, but: Sequence[str] = ()) -> DataFrame:
    texts = {f.name for f in df.schema if f.dataType.simpleString() == "string"} - set(but)
    return df.select(*[clean_text(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns])


def snapshot(
    df: DataFrame, label: str, fields: Mapping[str, Sequence[str]] = FIELD_SOURCES, keep: Sequence[str] = ()
) -> DataFrame:
    """One snapshot on the common schema, its text cleaned, its measures numbers, its
    label added."""
    out = clean_strings(homogenise(df, fields, keep))
    numbers = {c: safe_double(F.col(c)) for c in MEASURES if c in out.columns}
    return out.withColumns({**numbers, "corte": F.lit(label)})


def union_snapshots(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack snapshots; a column typed differently in two of them becomes text, one
    that no snapshot has too."""
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for f in part.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    typed_as = {}
    for name, seen in kinds.items():
        known = seen - {"void"}
        if len(seen) > 1 or not known:
            typed_as[name] = known.pop() if len(known) == 1 else "string"
    out = None
    for part in parts:
        typed = part.select(
            *[F.col(c).cast(typed_as[c]).alias(c) if c in typed_as else F.col(c) for c in part.columns]
        )
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


def resolve_key(
    df: DataFrame,
    master: DataFrame,
    declared: str,
    place: str,
    code: str = "cut",
    name: str = "comuna",
    width: int = 5,
) -> DataFrame:
    """``cut_com`` and how it was found: declared, by name, or unresolved.

    An invalid code never survives as a well-formed key of nowhere.
    """
    codes = master.select(F.col(code).alias("_declared"), F.lit(True).alias("_valid"))
    names = master.select(name_key(F.col(name)).alias("_place"), F.col(code).alias("_by_name"))
    keyed = df.withColumn("_declared", repair_code(F.col(declared), width)).withColumn(
        "_place", name_key(F.col(place))
    )
    valid = F.coalesce(F.col("_valid"), F.lit(False))
    return (
        keyed.join(codes, "_declared", "left")
        .join(names, "_place", "left")
        .withColumn("cut_com", F.when(valid, F.col("_declared")).otherwise(F.col("_by_name")))
        .withColumn(
            "cut_com_origen",
            F.when(valid, "declarado").when(F.col("_by_name").isNotNull(), "nombre").otherwise("sin_resolver"),
        )
        .drop("_declared", "_place", "_valid", "_by_name")
    )


def region_flags(df: DataFrame, declared: str = "cut_reg_declarado") -> DataFrame:
    """Region derived from the key; a different declared one is flagged, not mended."""
    stated = safe_double(F.col(declared)).cast("bigint")
    derived = safe_double(F.col("cut_reg")).cast("bigint")
    return df.withColumn("cut_reg", region_of(F.col("cut_com"))).withColumn(
        "cut_reg_declarado_discrepa",
        stated.isNotNull() & F.coalesce(stated != derived, F.lit(True)),
    )


def stage_flags(df: DataFrame, stage: str = "etapa") -> DataFrame:
    normal = F.lower(F.trim(F.col(stage)))
    return df.withColumn(stage, normal).withColumn(
        "existente", F.coalesce(normal == EXISTING_STAGE, F.lit(False))
    )


def conflict_flag(dist: Column) -> Column:
    return F.coalesce(dist > CONFLICT_M, F.lit(False))


def summary(df: DataFrame, keys: Sequence[str], sums: Sequence[str], count: str = "tramos") -> DataFrame:
    """Totals per key; rows with a NULL key stay, as a group of their own."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums], F.count(F.lit(1)).alias(count)
    )


def network_by_snapshot(df: DataFrame, snapshot_col: str, km: str, commune: str) -> DataFrame:
    """km, segments, communes per snapshot and the change in km from the one before.

    The window sees one row per snapshot.
    """
    per = df.where(F.col(snapshot_col).isNotNull()).groupBy(snapshot_col).agg(
        F.sum(km).alias("km"), F.count(F.lit(1)).alias("tramos"), F.countDistinct(commune).alias("comunas")
    )
    before = F.lag("km").over(Window.orderBy(snapshot_col))
    return per.withColumn("delta_km", F.col("km") - before)


def origin_table(df: DataFrame, snapshot_col: str = "corte", origin: str = "cut_com_origen") -> DataFrame:
    return (
        df.groupBy(snapshot_col)
        .pivot(origin, ["declarado", "nombre", "sin_resolver"])
        .count()
        .na.fill(0)
    )


def snapshot_diff(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose key the earlier snapshot does not have."""
    return now.join(before.select(key).distinct(), key, "left_anti")


def declared_vs_measured(df: DataFrame, by: Sequence[str], declared: str, measured: str) -> DataFrame:
    """Both totals side by side and their absolute difference in percent."""
    return df.groupBy(*by).agg(
        F.sum(declared).alias("declared"),
        F.sum(measured).alias("measured"),
        F.abs(ratio(F.sum(declared) - F.sum(measured), F.sum(declared))).alias("pct_diff"),
    )


def null_profile(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), marker: str = NO_INFORMATION
) -> DataFrame:
    """Share of NULL and of the no-information marker per column (and group).

    Counted in one aggregate and turned long afterwards, so the input is not
    multiplied by the number of columns.
    """
    counts = []
    for c in columns:
        text = F.col(c).cast("string")
        counts.append(
            F.struct(
                F.lit(c).alias("field"),
                count_if(F.col(c).isNull()).alias("nulls"),
                count_if(text == marker).alias("marked"),
            )
        )
    one = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*counts).alias("_f"))
    return (
        one.select(*by, "n", F.explode("_f").alias("_f"))
        .select(*by, "n", "_f.*")
        .withColumn("pct_null", ratio(F.col("nulls"), F.col("n")))
        .withColumn("pct_marked", ratio(F.col("marked"), F.col("n")))
        .withColumn("pct_uninformed", ratio(F.col("nulls") + F.col("marked"), F.col("n")))
    )


def best_and_worst(profile: DataFrame, group: str, measure: str = "pct_uninformed") -> DataFrame:
    """Group with the least and the most missing information, per field."""
    return profile.groupBy("field").agg(
        F.min_by(group, F.struct(F.col(measure), F.col(group))).alias("best"),
        F.min(measure).alias("best_pct"),
        F.min_by(group, F.struct(-F.col(measure), F.col(group))).alias("worst"),
        F.max(measure).alias("worst_pct"),
    )
