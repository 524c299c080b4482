"""Layer registry, manifest rows and partial refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.quality import layer_problems

REGISTRY = (
    "slug string, grupo string, corte string, vigente boolean, solo_atributos boolean,"
    " titulo string, organismo string, nota string, servicio string, capa_id int, fechas array<string>"
)

MANIFEST = (
    "slug string, grupo string, corte string, vigente boolean, solo_atributos boolean,"
    " n_registros bigint, n_declarado_servicio bigint, n_sin_geometria bigint,"
    " problemas array<string>, parquet_mb double, geojson_mb double, descargado_utc timestamp,"
    " titulo string, organismo string, nota string, servicio string, capa_nombre string,"
    " geometria string, campos array<string>"
)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Layers from a JSON file the user keeps, bare or under ``capas``; fields the
    file lacks are NULL."""
    wanted = T._parse_datatype_string(REGISTRY)
    raw = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("value"))
    rows = f"array<struct<{REGISTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' array', ':array')}>>"
    listed = F.when(F.col("value").startswith("["), F.from_json("value", rows)).otherwise(
        F.from_json("value", f"struct<capas:{rows}>")["capas"]
    )
    return raw.select(F.explode(listed).alias("c")).select(*[F.col("c")[f.name].alias(f.name) for f in wanted])


def by_slug(layers: DataFrame, slug: str) -> DataFrame:
    return layers.where(F.col("slug") == slug)


def layer_stats(df: DataFrame, slug: str, x: Column, y: Column) -> DataFrame:
    """Row count, rows without geometry and box of one layer, in one pass."""
    return df.agg(
        F.lit(slug).alias("slug"),
        F.count(F.lit(1)).alias("n_registros"),
        F.count(F.when(x.isNull() | y.isNull(), F.lit(1))).alias("n_sin_geometria"),
        F.min(x).alias("min_x"),
        F.min(y).alias("min_y"),
        F.max(x).alias("max_x"),
        F.max(y).alias("max_y"),
    )


def manifest_rows(layers: DataFrame, stats: DataFrame, declared: DataFrame) -> DataFrame:
    """Manifest entries from registry, measured stats and the declared counts."""
    box = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return (
        layers.join(stats, "slug")
        .join(declared, "slug")
        .withColumn(
            "problemas",
            layer_problems(F.col("n_registros"), F.col("n_declarado_servicio"), F.col("n_sin_geometria"), box),
        )
        .drop("min_x", "min_y", "max_x", "max_y")
    )


def upsert(old: DataFrame, new: DataFrame, key: str = "slug", order: str = "posicion") -> DataFrame:
    """Partial refresh: new entries replace old ones of the same key in place,
    unknown ones go to the end."""
    kept = old.join(new.select(key), key, "left_anti")
    places = old.select(key, order)
    last = old.agg(F.coalesce(F.max(order), F.lit(0)).alias("_last")).withColumn("_one", F.lit(0))
    moved = (
        new.withColumnRenamed(order, "_own")
        .join(places, key, "left")
        .withColumn("_one", F.lit(0))
        .join(F.broadcast(last), "_one")
        .withColumn(order, F.coalesce(F.col(order), F.col("_last") + F.col("_own")))
        .drop("_one", "_last", "_own")
    )
    return kept.unionByName(moved.select(kept.columns))


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)
