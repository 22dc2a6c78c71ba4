"""Scans: parquet, CSV, key=value metadata text, manifests and JSON payloads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_dataset(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None, merge: bool = False
) -> DataFrame:
    """One lazy frame over one or many parquet paths.  ``merge`` unifies files with different columns."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif merge:
        reader = reader.option("mergeSchema", "true")
    return reader.parquet(*([paths] if isinstance(paths, str) else list(paths)))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, **options: str) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass); a byte-order mark in the header is harmless
    because names come from the schema."""
    return spark.read.schema(schema).options(header="true", enforceSchema="true", **options).csv(path)


def read_disease_rows(
    spark: SparkSession, path: str, schema: T.StructType | str, disease: str, column: str = "standardized_disease_name"
) -> DataFrame:
    """CSV rows of one disease; the comparison ignores case."""
    return read_csv(spark, path, schema).where(F.lower(F.col(column)) == disease.lower())


SPEC_SCHEMA = "var string, aggregating_function string, units string, notes string, source string"


def read_aggregation_spec(spark: SparkSession, path: str) -> DataFrame:
    """The variable -> aggregate table."""
    spec = read_csv(spark, path, SPEC_SCHEMA)
    name = F.trim(F.regexp_replace("var", "﻿", ""))
    return spec.withColumns({"var": name, "aggregating_function": F.nullif(F.upper(F.trim("aggregating_function")), F.lit("NA"))})


def spec_to_dict(spec: DataFrame) -> dict[str, str | None]:
    """Column-level metadata: one entry per variable of the model table."""
    return {r["var"]: r["aggregating_function"] for r in spec.select("var", "aggregating_function").collect()}


def read_for_date(spark: SparkSession, paths: str | Sequence[str], date: str, column: str = "date") -> DataFrame:
    """Parquet rows of one date, through the SQL file relation; pruned by partition or pushed to the scan."""
    return read_dataset(spark, paths).where(F.col(column) == F.lit(date).cast("date"))


def date_from_file_name(path: Column, pattern: str = r"data_(\d{4}-\d{2}-\d{2})\.parquet") -> Column:
    return F.to_date(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), "yyyy-MM-dd")


def read_with_file_date(spark: SparkSession, paths: str | Sequence[str], pattern: str = r"data_(\d{4}-\d{2}-\d{2})") -> DataFrame:
    """Parquet rows plus the date written in their file name."""
    return read_dataset(spark, paths).withColumn("date", date_from_file_name(F.col("_metadata.file_path"), pattern))


def parse_manifest(
    files: DataFrame, name: str = "file_name", kind: str = "file_type", keep_kind: str = "tif", product: str = "NDVI"
) -> DataFrame:
    """Product files of a delivery list with the start date read from ``doy<yyyyDDD>`` in their name."""
    hits = files.where((F.col(kind) == keep_kind) & F.col(name).contains(product))
    year_doy = F.regexp_extract(name, r"doy(\d+)", 1)
    return hits.withColumn("year_doy", year_doy).withColumn("start_date", F.to_date("year_doy", "yyyyDDD")).withColumn(
        "year", F.year("start_date")
    )


def parse_key_value_blocks(
    df: DataFrame,
    text: str,
    names: Sequence[str],
    keys: Sequence[str],
    opener: str = "Description",
) -> DataFrame:
    """``name=value`` lines to one row per block; a block opens at each ``opener`` line.

    ``keys`` name the file; without them lines of all files would be numbered together in one task.

    ``text`` is the whole metadata listing of one file, so lines keep their order inside the row and blocks are
    built per file.  Band and metadata headings, lines without ``=`` and everything before the first block are
    skipped.  Lines stay in arrays, a row per file: only what the blocks are made of is moved, once.
    """
    squish = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))

    def pair(line, pos):
        at = F.instr(line, "=")
        return F.struct(
            pos.alias("pos"),
            squish(F.substring(line, F.lit(1), at - 1)).alias("name"),
            squish(F.substring(line, at + 1, F.length(line))).alias("value"),
        )

    numbered = F.transform(F.split(text, r"\r?\n"), lambda line, pos: F.struct(pos.alias("pos"), line.alias("line")))
    lines = F.filter(numbered, lambda x: F.contains(x["line"], F.lit("=")) & ~F.rlike(x["line"], F.lit("^Band|BAND|Metadata|METADATA")))
    pairs = F.filter(F.transform(lines, lambda x: pair(x["line"], x["pos"])), lambda p: p["name"].isin([opener, *names]))
    files = df.select(*keys, pairs.alias("_pairs")).repartition(*keys).groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list("_pairs"))).alias("_pairs"))
    at = F.filter(F.transform("_pairs", lambda p, i: F.when(p["name"] == opener, i + 1)), lambda i: i.isNotNull())
    opened = files.withColumn("_at", F.concat(at, F.array(F.size("_pairs") + 1)))
    parts = F.transform(
        F.slice("_at", F.lit(1), F.size("_at") - 1), lambda i, n: F.slice("_pairs", i, F.element_at("_at", (n + 2).cast("int")) - i)
    )
    blocks = opened.select(*keys, F.posexplode(parts).alias("_n", "_block"))
    first_of = lambda name: F.get(F.filter("_block", lambda p: p["name"] == name), F.lit(0))["value"]
    return blocks.select(*keys, (F.col("_n") + 1).cast("long").alias("band"), *[first_of(n).alias(n) for n in names])


def grib_fields(meta: DataFrame) -> DataFrame:
    """Typed forecast fields of the band metadata."""
    base = F.to_date(F.timestamp_seconds(F.col("GRIB_REF_TIME").cast("long")))
    end = F.to_date(F.timestamp_seconds(F.col("GRIB_VALID_TIME").cast("long")))
    rest = [c for c in meta.columns if not c.startswith("GRIB_") and c != "Description"]
    return meta.select(
        *rest,
        base.alias("base_date"),
        (F.col("GRIB_FORECAST_SECONDS").cast("double") / F.lit(86400.0)).alias("lead_days"),
        end.alias("forecast_end_date"),
        F.regexp_replace("GRIB_UNIT", "[^A-Za-z0-9]", "").alias("units"),
        F.col("GRIB_COMMENT").alias("var"),
        F.col("GRIB_ELEMENT").alias("var_id"),
        F.floor(F.months_between(end, base)).cast("int").alias("lead_months"),
    )


def explode_payload(df: DataFrame, payload: str, schema: str, items: str, keep: Sequence[str] = ()) -> DataFrame:
    """Stored JSON responses to one row per item of their ``items`` array."""
    parsed = df.select(*keep, F.from_json(payload, schema).alias("_p"))
    return parsed.select(*keep, F.explode(F.col("_p").getField(items)).alias("_i")).select(*keep, "_i.*")


def parameter_table(spark: SparkSession, start: str, end: str, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per month with the given parameter lists packed as array columns."""
    months = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 MONTH)) AS _m")
    packed = {k: F.array(*[F.lit(v) for v in vs]) for k, vs in lists.items()}
    return months.select(F.year("_m").alias("year"), F.month("_m").alias("month"), *[c.alias(k) for k, c in packed.items()])
