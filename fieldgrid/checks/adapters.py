"""Views that read the test tables as grid, forecast, event, layer and region tables.

Each view exists twice: as a Spark frame and as SQL text for the comparison.  Cell columns follow the keys in steps
(``l_partkey / 200``), so the grid widens with the scale factor and the rows per cell stay the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import GridSpec
from ..operators.regions import regions_from_edges
from ..session import ensure_checkpoint_dir, spread
from .registry import cte

XMIN, YMIN, RES, NY = 20.0, -10.0, 0.5, 5
BREAKS = (0, 30, 60, 90, 120, 150)
RESPONSE_BREAKS = (1, 30, 60, 90, 120, 150)
WEATHER = ["temperature", "precipitation", "relative_humidity"]

# Fixed outline of a region relative to its corner: an L and a detached triangle.
L_RING = [(0.0, 0.0), (1.25, 0.0), (1.25, 0.25), (0.5, 0.25), (0.5, 0.75), (0.0, 0.75)]
TRIANGLE = [(0.75, 0.5), (1.0, 0.5), (0.75, 0.75)]


def edges_of(ring):
    return [(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]


EDGES = edges_of(L_RING) + edges_of(TRIANGLE)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder on the cluster's shared checkpoint storage."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/fieldgrid-{uuid.uuid4().hex}"


def _cell(key: str, step: int) -> list:
    return [F.expr(f"cast({key} div {step} as int)").alias("ix"), F.expr(f"cast({key} % {NY} as int)").alias("iy")]


def grid_spec(spark: SparkSession, d: str) -> GridSpec:
    """Grid over all parts; its width is the one number read here."""
    last = table(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    return GridSpec(XMIN, YMIN, RES, int(last) // 200 + 1, NY)


cte(
    "grid",
    """SELECT CAST(i AS INT) AS ix, CAST(j AS INT) AS iy, 20 + (i + 5e-1) * 5e-1 AS x, -10 + (j + 5e-1) * 5e-1 AS y
    FROM (SELECT unnest(range(max(p_partkey) // 200 + 1)) AS i FROM part), (SELECT unnest(range(5)) AS j)""",
)


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Shipments as weather by cell and day.

    Rows are placed by cell first: few share a cell and day, so adding up before the shuffle would hold a state for
    nearly every row of a task, and what follows is grouped by cell, too.  All partitions are kept, as the states and
    sorts of a task take many times what it reads.
    """
    ix, _ = _cell("l_partkey", 200)
    li = table(spark, d, "lineitem").select(
        ix,
        F.expr(f"cast(l_suppkey % {NY} as int)").alias("iy"),
        F.to_date("l_shipdate").alias("date"),
        *["l_quantity", "l_extendedprice", "l_linenumber", "l_discount"],
    )
    return spread(li, "ix", "iy").groupBy("ix", "iy", "date").agg(
        F.avg("l_quantity").alias("temperature"),
        (F.avg("l_extendedprice") / 1000).alias("precipitation"),
        (F.avg(F.when(F.col("l_linenumber") < 7, F.col("l_discount"))) * 100).alias("relative_humidity"),
    )


cte(
    "daily",
    """SELECT CAST(l_partkey // 200 AS INT) AS ix, CAST(l_suppkey % 5 AS INT) AS iy, CAST(l_shipdate AS DATE) AS date,
      avg(l_quantity) AS temperature, avg(l_extendedprice) / 1000 AS precipitation,
      avg(CASE WHEN l_linenumber < 7 THEN l_discount END) * 100 AS relative_humidity
    FROM lineitem GROUP BY ALL""",
)
cte(
    "clim",
    """SELECT ix, iy, CAST(dayofyear(date) AS INT) AS doy,
      avg(temperature) AS temperature, stddev_samp(temperature) AS temperature_sd,
      avg(precipitation) AS precipitation, stddev_samp(precipitation) AS precipitation_sd,
      avg(relative_humidity) AS relative_humidity, stddev_samp(relative_humidity) AS relative_humidity_sd
    FROM daily GROUP BY ALL""",
)
cte(
    "anoms",
    "SELECT d.ix, d.iy, d.date, d_doy AS doy, CAST(month(d.date) AS INT) AS month, CAST(year(d.date) AS INT) AS year, "
    + ", ".join(
        f"d.{c} - k.{c} AS anomaly_{c}, CASE WHEN abs(k.{c}_sd) > 1e-12 * abs(k.{c}) THEN (d.{c} - k.{c}) / k.{c}_sd END AS anomaly_scaled_{c}"
        for c in WEATHER
    )
    + " FROM (SELECT *, CAST(dayofyear(date) AS INT) AS d_doy FROM daily) d JOIN clim k ON k.ix = d.ix AND k.iy = d.iy AND k.doy = d_doy WHERE "
    + " AND ".join(f"d.{c} IS NOT NULL AND k.{c} IS NOT NULL AND k.{c}_sd IS NOT NULL" for c in WEATHER),
)


def model_days(spark: SparkSession, d: str) -> DataFrame:
    """The 15th of every month that has an order."""
    month = F.trunc(F.to_date("o_orderdate"), "MM")
    return table(spark, d, "orders").select(F.date_add(month, 14).alias("date")).distinct()


cte("model_days", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) + 14 AS date FROM orders")


def composites(spark: SparkSession, d: str) -> DataFrame:
    """Vegetation composites of two satellites: 16-day and 10-day bins, the second from day 11 on."""
    ev = table(spark, d, "events").withColumn("_d", F.to_date("ts"))
    modis = F.col("event_type").isin("click", "view")
    ev = ev.withColumn("source", F.when(modis, "modis").otherwise("sentinel"))
    ev = ev.where(modis | (F.dayofyear("_d") > 10))
    width = F.when(F.col("source") == "modis", 16).otherwise(10)
    step = F.when(F.col("source") == "modis", 20.0).otherwise(0.4)
    doy = F.dayofyear("_d") - 1
    start = F.date_sub("_d", (doy % width).cast("int"))
    return ev.groupBy(
        "source",
        F.expr("cast(user_id div 15 as int)").alias("ix"),
        F.expr(f"cast(user_id % {NY} as int)").alias("iy"),
        start.alias("start_date"),
    ).agg((F.avg("value") * F.first(step)).alias("ndvi"))


cte(
    "composites",
    """SELECT source, CAST(user_id // 15 AS INT) AS ix, CAST(user_id % 5 AS INT) AS iy,
      CAST(d - CAST((dayofyear(d) - 1) % w AS INT) AS DATE) AS start_date, avg(value) * k AS ndvi
    FROM (SELECT *, CAST(ts AS DATE) AS d,
            CASE WHEN event_type IN ('click', 'view') THEN 'modis' ELSE 'sentinel' END AS source,
            CASE WHEN event_type IN ('click', 'view') THEN 16 ELSE 10 END AS w,
            CASE WHEN event_type IN ('click', 'view') THEN 2e1 ELSE 4e-1 END AS k FROM events)
    WHERE source = 'modis' OR dayofyear(d) > 10
    GROUP BY 1, 2, 3, 4, k""",
)
cte(
    "composite_days",
    """SELECT source, start_date, coalesce(lead(start_date) OVER (PARTITION BY source ORDER BY start_date) - 1, start_date + 15) AS end_date
    FROM (SELECT DISTINCT source, start_date FROM composites)""",
)
cte(
    "veg_daily",
    """SELECT c.ix, c.iy, CAST(u.day AS DATE) AS date, c.source, c.ndvi
    FROM composites c JOIN composite_days k USING (source, start_date),
      unnest(generate_series(CAST(k.start_date AS TIMESTAMP), CAST(k.end_date AS TIMESTAMP), INTERVAL 1 DAY)) AS u(day)""",
)


def forecast_members(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ensemble members: six lead months, three variables, in delivery units."""
    o = table(spark, d, "orders").select(
        *_cell("o_custkey", 150),
        F.trunc(F.to_date("o_orderdate"), "MM").alias("base_date"),
        F.col("o_totalprice").alias("p"),
        F.explode(F.sequence(F.lit(0), F.lit(5))).alias("lead_months"),
    )
    kinds = F.array(
        F.struct(F.lit("temperature").alias("variable"), F.lit("C").alias("units"), (280.0 + F.col("p") / 50000.0 + F.col("lead_months")).alias("value")),
        F.struct(F.lit("dewpoint").alias("variable"), F.lit("C").alias("units"), (275.0 + F.col("p") / 60000.0 + F.col("lead_months") * 0.5).alias("value")),
        F.struct(F.lit("precipitation").alias("variable"), F.lit("").alias("units"), ((F.col("p") - 200000.0) * 1e-13).alias("value")),
    )
    return o.select(
        "ix",
        "iy",
        "base_date",
        "lead_months",
        F.expr("cast(add_months(base_date, lead_months + 1) as date)").alias("forecast_end_date"),
        F.inline(kinds),
    )


cte(
    "members",
    """SELECT CAST(o_custkey // 150 AS INT) AS ix, CAST(o_custkey % 5 AS INT) AS iy, CAST(date_trunc('month', o_orderdate) AS DATE) AS base_date,
      k AS lead_months, CAST(date_trunc('month', o_orderdate) + to_months(CAST(k + 1 AS INT)) AS DATE) AS forecast_end_date,
      v AS variable, CASE WHEN v = 'precipitation' THEN '' ELSE 'C' END AS units,
      CASE v WHEN 'temperature' THEN 28e1 + o_totalprice / 5e4 + k WHEN 'dewpoint' THEN 275e0 + o_totalprice / 6e4 + k * 5e-1
        ELSE (o_totalprice - 2e5) * 1e-13 END AS value
    FROM orders, (SELECT unnest(range(6)) AS k), (SELECT unnest(['temperature', 'dewpoint', 'precipitation']) AS v)""",
)
cte(
    "ensemble",
    """SELECT ix, iy, base_date, CAST(lead_months AS INT) AS lead_months, forecast_end_date, variable, units,
      avg(value) AS mean, stddev_samp(value) AS sd FROM members GROUP BY ALL""",
)
cte(
    "forecast",
    """SELECT *, sqrt(pow(relative_humidity * 17625e-3 * 24304e-2 / pow(24304e-2 + temperature, 2) * temperature_sd, 2)
        + pow(relative_humidity * 17625e-3 * 24304e-2 / pow(24304e-2 + dewpoint, 2) * dewpoint_sd, 2)) AS relative_humidity_sd
    FROM (SELECT *, 100 * exp(17625e-3 * dewpoint / (24304e-2 + dewpoint)) / exp(17625e-3 * temperature / (24304e-2 + temperature)) AS relative_humidity
      FROM (SELECT ix, iy, base_date, CAST(month(base_date) AS INT) AS month, CAST(year(base_date) AS INT) AS year,
          CAST(month(forecast_end_date - 1) AS INT) AS lead_month, CAST(year(forecast_end_date - 1) AS INT) AS lead_year,
          max(CASE WHEN variable = 'temperature' THEN mean - 27315e-2 END) AS temperature,
          max(CASE WHEN variable = 'temperature' THEN sd END) AS temperature_sd,
          max(CASE WHEN variable = 'dewpoint' THEN mean - 27315e-2 END) AS dewpoint,
          max(CASE WHEN variable = 'dewpoint' THEN sd END) AS dewpoint_sd,
          max(CASE WHEN variable = 'precipitation' THEN CASE WHEN mean > 0 THEN mean * 864e5 ELSE 0 END END) AS precipitation,
          max(CASE WHEN variable = 'precipitation' THEN CASE WHEN sd > 0 THEN sd * 864e5 WHEN sd IS NOT NULL THEN 0 END END) AS precipitation_sd
        FROM ensemble GROUP BY ALL))""",
)
cte(
    "spans",
    """SELECT m.date, b.lo, b.hi FROM model_days m,
      (VALUES (0, 30), (30, 60), (60, 90), (90, 120), (120, 150)) AS b(lo, hi)""",
)
cte(
    "span_days",
    """SELECT s.date, s.hi, CAST(u.day AS DATE) AS day
    FROM spans s, unnest(generate_series(CAST(s.date + s.lo AS TIMESTAMP), CAST(s.date + s.hi - 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS u(day)""",
)
cte(
    "forecast_anoms",
    "SELECT ix, iy, date, CAST(dayofyear(date) AS INT) AS doy, CAST(month(date) AS INT) AS month, CAST(year(date) AS INT) AS year, hi AS forecast_interval, "
    + ", ".join(
        f"p_{c} - h_{c} AS anomaly_forecast_{c}, CASE WHEN abs(d_{c}) > 1e-12 * abs(h_{c}) THEN (p_{c} - h_{c}) / d_{c} END AS anomaly_forecast_scaled_{c}"
        for c in WEATHER
    )
    + " FROM (SELECT k.ix, k.iy, s.date, s.hi, "
    + ", ".join(f"avg(k.{c}) AS h_{c}, avg(k.{c}_sd) AS d_{c}, avg(f.{c}) AS p_{c}" for c in WEATHER)
    + """ FROM span_days s JOIN clim k ON k.doy = dayofyear(s.day)
      JOIN (SELECT m.date, max(i.base_date) AS base_date FROM model_days m JOIN (SELECT DISTINCT base_date FROM forecast) i ON i.base_date <= m.date GROUP BY 1) a ON a.date = s.date
      LEFT JOIN forecast f ON f.ix = k.ix AND f.iy = k.iy AND f.base_date = a.base_date AND f.lead_month = month(s.day) AND f.lead_year = year(s.day)
      GROUP BY 1, 2, 3, 4)""",
)


def outbreaks(spark: SparkSession, d: str) -> DataFrame:
    """Urgent orders as point events."""
    o = table(spark, d, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    start = F.to_date("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("outbreak_id"),
        F.expr("CASE WHEN o_orderkey % 11 <> 0 THEN cast(o_custkey % 7 as int) END").alias("cases"),
        start.alias("start_date"),
        F.date_add(start, F.expr("cast(o_orderkey % 5 as int)")).alias("end_date"),
        F.expr("20D + 0.5D * (o_custkey div 150) + 0.01D * (o_custkey % 50)").alias("longitude"),
        F.expr("-10D + 0.5D * (o_custkey % 5) + 0.01D * (o_custkey % 49)").alias("latitude"),
    )


cte(
    "outbreaks",
    """SELECT *, CAST(floor((longitude - 2e1) / 5e-1) AS INT) AS ix,
      CAST(greatest(0, 4 - floor((-75e-1 - latitude) / 5e-1)) AS INT) AS iy
    FROM (SELECT o_orderkey AS outbreak_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey % 7 AS INT) END AS cases,
      CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS end_date,
      2e1 + 5e-1 * (o_custkey // 150) + 1e-2 * (o_custkey % 50) AS longitude,
      -1e1 + 5e-1 * (o_custkey % 5) + 1e-2 * (o_custkey % 49) AS latitude
    FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
cte(
    "response",
    """SELECT o.ix, o.iy, m.date, b.hi AS forecast_interval, m.date + b.lo AS forecast_start, m.date + b.hi AS forecast_end,
      CAST(coalesce(sum(o.cases), 0) AS DOUBLE) AS cases
    FROM outbreaks o JOIN model_days m ON TRUE
      JOIN (VALUES (1, 30), (30, 60), (60, 90), (90, 120), (120, 150)) AS b(lo, hi)
        ON o.start_date >= m.date + b.lo AND o.start_date < m.date + b.hi
    GROUP BY ALL""",
)


def region_edges(spark: SparkSession, d: str) -> DataFrame:
    """A two-part outline for every nation, placed by its number; outlines overlap and touch cell centres."""
    n = F.col("n_nationkey")
    template = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), e)]) for e in EDGES])
    bx, by = F.expr("20D + (n_nationkey % 5) * 1D"), F.expr("-10D + (n_nationkey div 5) * 0.5D")
    rows = table(spark, d, "nation").select(
        F.col("n_name").alias("region"), bx.alias("bx"), by.alias("by"), F.explode(template).alias("e")
    )
    return rows.select(
        "region",
        (F.col("bx") + F.col("e.x1")).alias("x1"),
        (F.col("by") + F.col("e.y1")).alias("y1"),
        (F.col("bx") + F.col("e.x2")).alias("x2"),
        (F.col("by") + F.col("e.y2")).alias("y2"),
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    return regions_from_edges(region_edges(spark, d))


cte(
    "edges",
    "SELECT n_name AS region, bx + x1 AS x1, by_ + y1 AS y1, bx + x2 AS x2, by_ + y2 AS y2 FROM "
    "(SELECT n_name, 20 + (n_nationkey % 5) * 1e0 AS bx, -10 + (n_nationkey // 5) * 5e-1 AS by_ FROM nation), (VALUES "
    + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" for v in e) + ")" for e in EDGES)
    + ") AS t(x1, y1, x2, y2)",
)


def inside_sql(points: str, cols: str, x: str, y: str, boundary: bool = True) -> str:
    """Pairs of points and regions by the even-odd rule, written as one aggregate over all edges."""
    hit = (
        f"(count(*) FILTER (WHERE (e.y1 > p.{y}) <> (e.y2 > p.{y}) AND p.{x} < e.x1 + (p.{y} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) % 2 = 1"
    )
    edge = (
        f"bool_or((e.x2 - e.x1) * (p.{y} - e.y1) - (e.y2 - e.y1) * (p.{x} - e.x1) = 0 AND p.{x} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)"
        f" AND p.{y} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))"
    )
    rule = f"{hit} OR {edge})" if boundary else f"{hit} AND NOT {edge})"
    names = ", ".join(f"p.{c}" for c in cols.split())
    return f"SELECT {names}, e.region FROM {points} p, edges e GROUP BY {names}, e.region HAVING {rule}"


cte("cell_region", inside_sql("grid", "ix iy x y", "x", "y"))


def fine_spec(spec: GridSpec) -> GridSpec:
    """Twice as fine as the target grid."""
    return GridSpec(spec.xmin, spec.ymin, spec.res / 2, spec.nx * 2, spec.ny * 2)


def coarse_spec(spec: GridSpec) -> GridSpec:
    return GridSpec(spec.xmin, spec.ymin, spec.res * 2, (spec.nx + 1) // 2, (spec.ny + 1) // 2)


TYPES = ["ECONOMY", "SMALL", "MEDIUM", "STANDARD", "LARGE", "PROMO"]


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Parts as fine-grid layers: a soil unit, band counts per part type (NULL when none) and two measures."""
    p = table(spark, d, "part")
    count = lambda t: F.nullif(F.sum((F.col("p_type") == t).cast("long")), F.lit(0))
    return p.groupBy(
        F.expr("cast(p_partkey div 100 as int)").alias("ix"), F.expr(f"cast(p_partkey % {2 * NY} as int)").alias("iy")
    ).agg(
        F.max("p_size").alias("unit"),
        F.avg("p_size").alias("wc2.1_30s_elev"),
        F.avg("p_retailprice").alias("price"),
        *[count(t).alias(t.lower()) for t in TYPES],
    )


cte(
    "layers",
    'SELECT CAST(p_partkey // 100 AS INT) AS ix, CAST(p_partkey % 10 AS INT) AS iy, max(p_size) AS unit, avg(p_size) AS "wc2.1_30s_elev", avg(p_retailprice) AS price, '
    + ", ".join(f"nullif(CAST(sum(CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END) AS BIGINT), 0) AS {t.lower()}" for t in TYPES)
    + " FROM part GROUP BY 1, 2",
)


def soil_key(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "part").select(F.col("p_size").alias("unit")).distinct()
    return sizes.select(
        "unit",
        F.expr("get(array('E', 'SE', 'W', 'MW', 'I', 'P', 'VP'), cast(unit % 8 as int))").alias("drainage"),
        F.expr("nullif(unit % 14, 0)").cast("int").alias("texture"),
    )


cte(
    "soil_key",
    """SELECT DISTINCT p_size AS unit, ['E', 'SE', 'W', 'MW', 'I', 'P', 'VP'][CAST(p_size % 8 + 1 AS INT)] AS drainage,
      nullif(p_size % 14, 0) AS texture FROM part""",
)
cte(
    "soil",
    """SELECT l.ix, l.iy, coalesce(k.drainage, 'UNK') AS soil_drainage,
      CASE WHEN k.texture IS NULL THEN 'UNK' ELSE CASE k.texture WHEN 5 THEN '1' WHEN 7 THEN '2' WHEN 8 THEN '3' WHEN 9 THEN '4'
        WHEN 10 THEN '5' WHEN 11 THEN '6' WHEN 12 THEN '7' ELSE '0' END END AS soil_texture
    FROM layers l LEFT JOIN soil_key k USING (unit)""",
)


def districts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000).alias("x"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    return c.join(n, "c_nationkey").select("region", "x", F.col("c_nationkey").cast("double").alias("y"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(
        F.expr("cast(doc_id % 4 as int)").alias("fold"),
        F.col("toxic").alias("outbreak"),
        F.expr("0.6D * ((doc_id * 37) % 101) / 101D + 0.4D * (1 - quality)").alias("pred_1"),
    )


cte(
    "scored",
    """SELECT CAST(doc_id % 4 AS INT) AS fold, toxic AS outbreak, 6e-1 * ((doc_id * 37) % 101) / 101e0 + 4e-1 * (1 - quality) AS pred_1 FROM labels""",
)


def region_rows(spark: SparkSession, d: str) -> DataFrame:
    """District-days of shipments, the rows of the cross-validation tables."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("region"))
    li = table(spark, d, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("q"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("r")
    )
    return li.join(s, "l_suppkey").join(n, "n_nationkey").groupBy("region", "date").agg(
        F.sum("q").alias("quantity"), F.max("r").alias("outbreak")
    )


cte(
    "region_rows",
    """SELECT n_name AS region, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS quantity,
      max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS outbreak
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL""",
)
