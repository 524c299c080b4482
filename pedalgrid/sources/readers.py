"""Scans: Parquet, city folders, GeoJSON, CSV, JSON; optional inputs."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import alnum_key, strip_decimal
from .geojson import geojson_objects
from .wkb import read_wkb

# Fixed value: the coordinate system of a GeoParquet column that states none.
GEO_DEFAULT = {"id": {"authority": "OGC", "code": "CRS84"}}
# so many codes at most are listed in a scan's filter
MOST_LISTED = 1000
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Full scan, or only ``columns`` (pruned in the reader)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def declared_crs(spark: SparkSession, path: str, column: str = "geometry") -> str | None:
    """Coordinate system that a GeoParquet table states for a column, as
    ``AUTHORITY:CODE``, from one file's footer; the format's own default if it states
    none, NULL if the file is plain Parquet."""
    jvm = spark._jvm
    first = jvm.org.apache.hadoop.fs.Path(spark.read.parquet(path).inputFiles()[0])
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(first, spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        stated = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    if stated is None:
        return None
    crs = json.loads(stated)["columns"].get(column, {}).get("crs", GEO_DEFAULT)
    return f"{crs['id']['authority']}:{crs['id']['code']}" if crs and "id" in crs else None


def geo_parquet(
    spark: SparkSession, path: str, column: str = "geometry", crs: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """GeoParquet with its geometry decoded to ``kind, point, line, polygon``.

    With ``crs`` the table must state that coordinate system.
    """
    if crs is not None and (found := declared_crs(spark, path, column)) != crs:
        raise ValueError(f"{path}: coordinate system {found}, not {crs}")
    return read_wkb(parquet(spark, path, None if columns is None else [*columns, column]), column)


def pick_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns the file has."""
    return df.select(*[c for c in wanted if c in df.columns])


def blocks_of_communes(
    blocks: DataFrame, communes: DataFrame, cut: str = "CUT", key: str = "cut_com", listed: int = MOST_LISTED
) -> DataFrame:
    """Only blocks of the given communes. Up to ``listed`` communes become a filter that
    the scan gets, so that it skips files and row groups by their statistics (see
    ``write_clustered``); more are a semi join."""
    codes = communes.select(F.col(key).cast("bigint").alias(cut)).distinct()
    few = [r[0] for r in codes.limit(listed + 1).collect()]
    if len(few) > listed:
        return blocks.join(codes, cut, "left_semi")
    return blocks.where(F.col(cut).isin(sorted(c for c in few if c is not None)))


def optional(spark: SparkSession, path: str, schema: str, reader: str = "parquet") -> DataFrame:
    """The table, or an empty one with the declared schema if it is not there."""
    try:
        return spark.read.format(reader).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def city_folders(spark: SparkSession, root: str, file: str = "*.parquet") -> DataFrame:
    """All city files under ``Region__City_Name_YYYY`` folders, with city and
    year read from the folder name. A column that cities type differently is text;
    one that a city lacks is NULL there."""
    # cities type the same column differently, so files are read group by group of
    # equal schema and such columns become text
    folders = spark.read.format("binaryFile").load(f"{root}/*/{file}").select("path").collect()
    groups: dict[str, list[str]] = {}
    for path in sorted(r["path"] for r in folders):
        groups.setdefault(spark.read.parquet(path).schema.json(), []).append(path)
    parts = [spark.read.parquet(*paths).withColumn("_file", F.col("_metadata.file_path")) for paths in groups.values()]
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for f in part.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    parts = [p.withColumns({c: F.col(c).cast("string") for c in mixed if c in p.columns}) for p in parts]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    folder = F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1)
    return df.withColumn("carpeta", folder).drop("_file").withColumns(
        {
            "ciudad": F.replace(
                F.regexp_extract("carpeta", r"__(.+)_\d{4}$", 1), F.lit("_"), F.lit(" ")
            ),
            "anio": F.regexp_extract("carpeta", r"_(\d{4})$", 1).try_cast("int"),
        }
    )


# GeoJSON coordinates nest to a depth that depends on the geometry type, so they
# are read as text and parsed once the type is known.
_OBJECT = "type string, properties map<string,string>, geometry struct<type:string,coordinates:string>, _bad string"
ZONE_NAMES = ("zona", "ZONA", "Zona")


def _ring(raw: Column) -> Column:
    return F.transform(raw, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def polygon_from_geojson(kind: Column, coordinates: Column) -> Column:
    """GeoJSON (Multi)Polygon coordinates to the polygon type."""
    many = F.when(kind == "Polygon", F.array(F.from_json(coordinates, "array<array<array<double>>>"))).when(
        kind == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>")
    )
    return F.transform(
        many,
        lambda g: F.struct(
            _ring(g[0]).alias("shell"),
            F.transform(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), _ring).alias("holes"),
        ),
    )


def line_from_geojson(kind: Column, coordinates: Column) -> Column:
    many = F.when(kind == "LineString", F.array(F.from_json(coordinates, "array<array<double>>"))).when(
        kind == "MultiLineString", F.from_json(coordinates, "array<array<array<double>>>")
    )
    return F.transform(many, _ring)


def _geojson(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Features with their file, and the files with what is wrong in them."""
    objects, ends = geojson_objects(spark, path)
    file = F.regexp_extract("_path", r"([^/]+)\.[^./]+$", 1).alias("file")
    doc = F.from_json("text", _OBJECT, {"columnNameOfCorruptRecord": "_bad"})
    parsed = objects.select("_path", doc.alias("_d"))
    # a collection's frame has neither the type nor a geometry
    is_feature = (F.col("_d.type") == "Feature") | (F.col("_d.type").isNull() & F.col("_d.geometry").isNotNull())
    features = parsed.where(is_feature & F.col("_d._bad").isNull()).select(
        file,
        "_path",
        "_d.properties",
        F.col("_d.geometry.type").alias("kind"),
        F.col("_d.geometry.coordinates").alias("coordinates"),
    )
    bad = parsed.where(F.col("_d._bad").isNotNull()).select("_path", F.lit(True).alias("broken"))
    broken = bad.unionByName(ends).groupBy("_path").agg(F.max("broken").alias("broken"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_path"))
    return features, files.join(broken, "_path", "left")


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """``(file, properties, kind, coordinates)`` of files of any layout: features on their
    own or in collections, on one line or many, mixed. What does not parse gives no rows
    instead of failing the scan; ``unreadable_geojson`` lists its file."""
    return _geojson(spark, path)[0].drop("_path")


def unreadable_geojson(spark: SparkSession, path: str, names: Sequence[str] = ()) -> DataFrame:
    """``(file, reason)`` of files that give nothing or not all: ``no_features``, ``broken``
    (it ends too early, or a part of it does not parse), or with ``names`` given ``no_id``
    (no feature has one of these properties). A file of no bytes is not seen by a scan."""
    features, files = _geojson(spark, path)
    name = F.regexp_extract("_path", r"([^/]+)\.[^./]+$", 1).alias("file")
    key = F.coalesce(*[F.try_element_at(F.col("properties"), F.lit(n)) for n in names]) if names else F.lit("")
    seen = features.groupBy("_path").agg(F.max(key.isNotNull()).alias("_named"))
    reason = (
        F.when(F.col("_named").isNull(), "no_features").when(F.col("broken"), "broken").when(~F.col("_named"), "no_id")
    )
    return files.join(seen, "_path", "left").select(name, reason.alias("reason")).where("reason IS NOT NULL")


def survey_zones(spark: SparkSession, path: str, names: Sequence[str] = ZONE_NAMES) -> DataFrame:
    """Survey zone polygons, one file per city. Files without an id column give
    no rows; ``unreadable_geojson(spark, path, names)`` lists them."""
    zone = F.coalesce(*[F.try_element_at(F.col("properties"), F.lit(n)) for n in names])
    return (
        geojson_features(spark, path)
        .select(
            F.col("file").alias("ciudad"),
            alnum_key(F.col("file")).alias("k"),
            strip_decimal(zone).alias("zona"),
            polygon_from_geojson(F.col("kind"), F.col("coordinates")).alias("geom"),
        )
        .where(F.col("zona").isNotNull() & F.col("geom").isNotNull())
    )


def official_index(spark: SparkSession, path: str) -> DataFrame:
    """The published city index, UTF-8 CSV with a header."""
    schema = "ciudad string, v_no_motorizado double, v_caminata double, viajes_diarios double"
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    wanted = T._parse_datatype_string(schema)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in wanted])


def city_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON list of cities, bare or under ``ciudades``."""
    df = spark.read.option("multiLine", True).json(path)
    if "ciudades" in df.columns:
        return df.select(F.explode("ciudades").alias("_c")).select("_c.*")
    return df


def metro_areas(spark: SparkSession, path: str) -> DataFrame:
    """``(metro, cut_com)`` from ``{"metros": {name: [codes]}}``."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "struct<metros:map<string,array<string>>>")
    return (
        raw.select(F.explode(parsed["metros"]).alias("metro", "_codes"))
        .select("metro", F.explode("_codes").alias("cut_com"))
    )
