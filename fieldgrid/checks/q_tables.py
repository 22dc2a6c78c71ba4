"""Checks of sources, sinks and dataset rules (ids S1..S18, A10, A16, A17, J24)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import key_coverage
from ..operators.regions import check_spec
from ..plans import climatology
from ..sources import readers, validation, writers
from . import adapters as a
from .registry import query


@query("S01_multi_file_scan", "SELECT 'orders' AS t, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY 1 UNION ALL SELECT 'lineitem', count(*), sum(l_tax) FROM lineitem GROUP BY 1", "v")
def _(spark, d):
    both = readers.read_dataset(spark, [f"{d}/orders.parquet", f"{d}/lineitem.parquet"], merge=True)
    t = F.when(F.col("o_orderkey").isNotNull(), "orders").otherwise("lineitem")
    return both.groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("o_totalprice", "l_tax")).alias("v"))


@query("S02_single_parquet", "SELECT c_custkey, c_acctbal FROM customer", "c_acctbal")
def _(spark, d):
    return readers.read_dataset(spark, f"{d}/customer.parquet", "c_custkey bigint, c_acctbal double")


@query("S03_csv_disease_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'", "o_totalprice")
def _(spark, d):
    """Orders stored as CSV and read back with a declared schema and a case-insensitive predicate."""
    path = a.scratch(spark)
    a.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").write.option("header", "true").csv(path)
    schema = "o_orderkey bigint, o_totalprice double, o_orderpriority string"
    return readers.read_disease_rows(spark, path, schema, "1-Urgent", "o_orderpriority").drop("o_orderpriority")


@query(
    "S04_aggregation_spec",
    """SELECT lower(p_type) AS var, CASE WHEN min(p_size) % 3 = 0 THEN NULL ELSE 'AVG' END AS aggregating_function FROM part GROUP BY p_type""",
)
def _(spark, d):
    """A spec table written with a byte-order mark in its header, read back clean."""
    path = a.scratch(spark)
    spec = a.table(spark, d, "part").groupBy("p_type").agg(F.min("p_size").alias("s")).select(
        F.lower("p_type").alias("﻿var"),
        F.when(F.col("s") % 3 == 0, "NA").otherwise("avg").alias("aggregating_function"),
        *[F.lit("-").alias(c) for c in ("units", "notes", "source")],
    )
    spec.write.option("header", "true").csv(path)
    return readers.read_aggregation_spec(spark, path).select("var", "aggregating_function")


@query("S05_key_table_lookup", "SELECT unit, drainage, texture, count(*) AS cells FROM layers JOIN soil_key USING (unit) GROUP BY ALL")
def _(spark, d):
    return a.layers(spark, d).join(a.soil_key(spark, d), "unit").groupBy("unit", "drainage", "texture").agg(F.count(F.lit(1)).alias("cells"))


@query("S06_scan_for_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate = DATE '1998-10-03'")
def _(spark, d):
    return readers.read_for_date(spark, f"{d}/orders.parquet", "1998-10-03", "o_orderdate").select("o_orderkey", F.to_date("o_orderdate").alias("o_orderdate"))


@query("S07_gzip_parquet_sink", "SELECT * FROM daily", " ".join(a.WEATHER))
def _(spark, d):
    path = writers.write_parquet(a.daily(spark, d), a.scratch(spark))
    return spark.read.parquet(path)


@query("S08_copy_of_joined_tables", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    n, r = a.table(spark, d, "nation"), a.table(spark, d, "region")
    joined = n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name")
    return spark.read.parquet(writers.write_parquet(joined, a.scratch(spark)))


@query("S09_hive_partitions", "SELECT ix, iy, date, temperature, CAST(year(date) AS INT) AS year FROM daily", "temperature")
def _(spark, d):
    df = a.daily(spark, d).select("ix", "iy", "date", "temperature", F.year("date").alias("year"))
    path = writers.write_parquet(df, a.scratch(spark), ["year"], ["ix", "iy"])
    return spark.read.parquet(path)


@query("S10_year_month_partitions", "SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, count(*) AS n FROM daily GROUP BY 1, 2")
def _(spark, d):
    df = a.daily(spark, d).withColumns({"year": F.year("date"), "month": F.month("date")})
    path = writers.write_parquet(df, a.scratch(spark), ["year", "month"], files_per_key=2)
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


def _build_twice(spark, d, refresh=None):
    """A first build of the early years, then a build of all years with changed values."""
    df = a.daily(spark, d).select("ix", "iy", "temperature", F.year("date").alias("year"))
    path = a.scratch(spark)
    writers.materialize(df.where("year < 1999").withColumn("build", F.lit(1)), path, ["year"])
    return writers.materialize(df.withColumn("build", F.lit(2)), path, ["year"], refresh=refresh)


@query("S11_materialize_if_absent", "SELECT CAST(year(date) AS INT) AS year, CASE WHEN year(date) < 1999 THEN 1 ELSE 2 END AS build, count(*) AS n FROM daily GROUP BY 1, 2")
def _(spark, d):
    return _build_twice(spark, d).groupBy("year", "build").agg(F.count(F.lit(1)).alias("n"))


@query("S12_refresh_current_period", "SELECT CAST(year(date) AS INT) AS year, CASE WHEN year(date) < 1998 THEN 1 ELSE 2 END AS build, count(*) AS n FROM daily GROUP BY 1, 2")
def _(spark, d):
    return _build_twice(spark, d, F.col("year") >= 1998).groupBy("year", "build").agg(F.count(F.lit(1)).alias("n"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("S13_file_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in _TABLES))
def _(spark, d):
    parts = [validation.file_row_counts(spark, f"{d}/{t}.parquet") for t in _TABLES]
    counts = reduce(DataFrame.unionByName, parts)
    listed = counts.select("file")
    gone = validation.unreadable_files(listed, counts)
    name = F.regexp_extract("file", r"([a-z]+)\.parquet", 1).alias("name")
    return counts.join(gone, "file", "left_anti").select(name, "rows")


@query("S14_schema_equality", "SELECT n_name, TRUE AS same_as_copy, FALSE AS same_as_region FROM nation")
def _(spark, d):
    n = a.table(spark, d, "nation")
    copy = spark.read.parquet(writers.write_parquet(n, a.scratch(spark)))
    return n.select(
        "n_name",
        F.lit(validation.same_schema([n, copy])).alias("same_as_copy"),
        F.lit(validation.same_schema([n, a.table(spark, d, "region")])).alias("same_as_region"),
    )


def _file_names(spark, d):
    """Delivery lists made of order dates: product files, quality files and other formats."""
    o = a.table(spark, d, "orders")
    name = F.concat(
        F.lit("MOD13A2_1_km_"),
        F.when(F.col("o_orderstatus") == "F", "NDVI").otherwise("QA"),
        F.date_format(F.to_date("o_orderdate"), "'_doy'yyyyDDD'_aid0001.tif'"),
    )
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "csv").otherwise("tif")
    return o.select("o_orderkey", name.alias("file_name"), kind.alias("file_type"))


@query(
    "S15_manifest",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start_date, CAST(year(o_orderdate) AS INT) AS year, strftime(o_orderdate, '%Y%j') AS year_doy
    FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'""",
)
def _(spark, d):
    return readers.parse_manifest(_file_names(spark, d)).select("o_orderkey", "start_date", "year", "year_doy")


@query("S16_date_from_file_name", "SELECT CAST(date_trunc('month', date) AS DATE) AS date, count(*) AS n FROM daily GROUP BY 1")
def _(spark, d):
    """Monthly folders whose date is only in their name."""
    path = a.scratch(spark)
    month = F.concat(F.lit("data_"), F.trunc("date", "MM").cast("string"))
    writers.write_parquet(a.daily(spark, d).select("temperature", month.alias("name")), path, ["name"])
    return readers.read_with_file_date(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S17_key_value_blocks",
    """SELECT o_orderkey, CAST(b AS BIGINT) AS band, CAST(o_orderdate AS DATE) AS base_date, CAST(3e1 * b AS DOUBLE) AS lead_days,
      CAST(o_orderdate AS DATE) + CAST(30 * b AS INT) AS forecast_end_date, 'C' AS units, o_orderstatus AS var, '2T' AS var_id,
      CAST(date_diff('month', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(30 * b AS INT)) - CASE WHEN day(CAST(o_orderdate AS DATE) + CAST(30 * b AS INT)) < day(o_orderdate)
        AND NOT (CAST(o_orderdate AS DATE) + CAST(30 * b AS INT) = last_day(CAST(o_orderdate AS DATE) + CAST(30 * b AS INT)) AND CAST(o_orderdate AS DATE) = last_day(CAST(o_orderdate AS DATE))) THEN 1 ELSE 0 END AS INT) AS lead_months
    FROM orders, (VALUES (1), (2)) AS t(b)""",
    "lead_days",
)
def _(spark, d):
    """Band metadata listings with two blocks per order, parsed to typed forecast fields."""
    o = a.table(spark, d, "orders")
    ref = F.unix_date(F.to_date("o_orderdate")) * 86400

    def block(n):
        seconds = F.lit(n * 30 * 86400)
        return F.concat_ws(
            "\n",
            F.lit(f"Band {n} Block=1x1"),
            F.lit("  Description = 0[-] SFC"),
            F.lit("  Metadata:"),
            F.concat(F.lit("    GRIB_COMMENT = "), F.col("o_orderstatus")),
            F.lit("    GRIB_ELEMENT = 2T"),
            F.concat(F.lit("    GRIB_FORECAST_SECONDS = "), seconds.cast("string")),
            F.concat(F.lit("    GRIB_REF_TIME = "), ref.cast("string")),
            F.lit("    GRIB_UNIT = [C]"),
            F.concat(F.lit("    GRIB_VALID_TIME = "), (ref + seconds).cast("string")),
        )

    text = o.select("o_orderkey", F.concat_ws("\n", block(1), block(2)).alias("text"))
    names = ["GRIB_COMMENT", "GRIB_ELEMENT", "GRIB_FORECAST_SECONDS", "GRIB_REF_TIME", "GRIB_UNIT", "GRIB_VALID_TIME"]
    return readers.grib_fields(readers.parse_key_value_blocks(text, "text", names, ["o_orderkey"]))


@query(
    "S18_missing_coverage",
    """SELECT ix, iy, date FROM (SELECT ix, iy, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY ix, iy)
    EXCEPT SELECT ix, iy, date FROM daily""",
)
def _(spark, d):
    return validation.missing_dates(a.daily(spark, d), keys=["ix", "iy"])


@query("S18_duplicate_keys", "SELECT ix, iy, n FROM (SELECT ix, iy, count(*) AS n FROM daily GROUP BY 1, 2) WHERE n > 1")
def _(spark, d):
    return validation.duplicate_keys(a.daily(spark, d), ["ix", "iy"])


@query("S18_even_coverage", "SELECT count(DISTINCT n) AS sizes, count(DISTINCT n) = 1 AS even FROM (SELECT count(*) AS n FROM daily GROUP BY date)")
def _(spark, d):
    return validation.is_even(a.daily(spark, d), "date")


@query("S18_coverage_by_doy", "SELECT CAST(dayofyear(date) AS INT) AS doy, count(*) AS n, count(DISTINCT (ix, iy)) AS units FROM daily GROUP BY 1")
def _(spark, d):
    return validation.coverage_by(a.daily(spark, d).withColumn("doy", F.dayofyear("date")), "doy", ["ix", "iy"])


@query("A10_spec_reconciliation", "SELECT date, avg(temperature) AS temperature_avg FROM daily GROUP BY 1", "temperature_avg")
def _(spark, d):
    """A spec naming an unknown column is refused; a matching one drives the aggregate."""
    from ..functions.aggregates import spec_aggregates

    daily = a.daily(spark, d)
    try:
        check_spec(daily, {"date": None, "no_such_column": "AVG"})
    except ValueError:
        spec = {"date": None, "temperature": "AVG"}
    check_spec(daily, spec)
    keys, aggs = spec_aggregates(spec)
    return daily.groupBy(*keys).agg(*aggs)


_COUNTED = _TABLES


@query("A16_table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _COUNTED))
def _(spark, d):
    return validation.row_counts({t: a.table(spark, d, t) for t in _COUNTED})


@query("A17_any_missing", "SELECT bool_or(temperature IS NULL) AS temperature, bool_or(relative_humidity IS NULL) AS relative_humidity FROM daily")
def _(spark, d):
    return validation.missing_flags(a.daily(spark, d), ["temperature", "relative_humidity"])


@query("A17_nulls_only_in_scaled", "SELECT ix, iy, date, temperature, relative_humidity AS scaled_humidity FROM daily", "temperature scaled_humidity")
def _(spark, d):
    df = a.daily(spark, d).select("ix", "iy", "date", "temperature", F.col("relative_humidity").alias("scaled_humidity"))
    return validation.assert_nulls_only_in(df, "scaled")


@query(
    "J24_key_coverage",
    """SELECT 1 AS step, 'weather' AS source, (SELECT count(*) FROM (SELECT DISTINCT ix, iy, date FROM daily)) AS surviving
    UNION ALL SELECT 2, 'anomalies', (SELECT count(*) FROM (SELECT ix, iy, date FROM daily INTERSECT SELECT ix, iy, date FROM anoms))
    UNION ALL SELECT 3, 'response', (SELECT count(*) FROM (SELECT ix, iy, date FROM daily INTERSECT SELECT ix, iy, date FROM anoms INTERSECT SELECT ix, iy, date FROM response))""",
)
def _(spark, d):
    from ..plans import events

    daily = a.daily(spark, d)
    response = events.outbreak_response(a.outbreaks(spark, d), a.grid_spec(spark, d), a.model_days(spark, d), a.RESPONSE_BREAKS)
    sources = {"weather": daily, "anomalies": climatology.own_anomalies(daily, a.WEATHER), "response": response}
    out = key_coverage(sources, ["ix", "iy", "date"])
    return out.withColumn("surviving", F.col("surviving").cast("long"))
