"""Registered queries for sources, sinks and rules that read what the library itself has written.

The given tables are written below the shared folder as drifting files, read back, and compared with SQL
over the original tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql
from checks.cases import _FEED, case, feed_tables, predictions, rounded
from checks.incidents import modeled_incidents, table
from priorline.contract import CLEANED_SCHEMA, FEATURES, feature_projection
from priorline.functions import calendar, rows
from priorline.operators import reports
from priorline.plans.clean import clean_all
from priorline.sources import feed, files, tables
from priorline.sources.durable import scratch_folder


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="").csv(path)


def drifting_files(spark: SparkSession, sf: str) -> str:
    """Two headers, one with a canonical name twice; locations with quotes, commas and line breaks."""
    folder = scratch_folder(spark)
    line = table(spark, sf, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    route, delay = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    place = F.concat(F.lit('Stop "'), F.col("l_linenumber").cast("string"), F.lit('", line\n'), F.col("l_returnflag"))
    write_csv(
        line.where("l_linestatus = 'O'").select(
            day.alias("Report Date"), route.alias("Line"), place.alias("Location"), delay.alias(" Delay "),
            route.alias("Vehicle Number"), F.lit("second").alias("Date"),
        ),
        f"{folder}/bus/new",
    )
    write_csv(
        line.where("l_linestatus <> 'O'").select(day.alias("Date"), route.alias("Rte"), place.alias("Loc"), delay.alias("Min Delay")),
        f"{folder}/bus/old",
    )
    return folder


_DRIFTED = """drifted AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, CAST(l_suppkey AS VARCHAR) AS route,
    'Stop "' || l_linenumber || '", line' || chr(10) || l_returnflag AS location, CAST(l_partkey AS VARCHAR) AS min_delay,
    CASE WHEN l_linestatus = 'O' THEN CAST(l_suppkey AS VARCHAR) END AS vehicle FROM lineitem)"""


@case("import_drifting", sql.with_ctes(_DRIFTED) + "SELECT date, route, location, min_delay, vehicle FROM drifted")
def _import_drifting(spark, sf):
    raw = files.read_incident_files(spark, f"{drifting_files(spark, sf)}/bus", "bus")
    return raw.select("date", "route", "location", "min_delay", "vehicle")


@case(
    "import_union",
    sql.with_ctes(_DRIFTED)
    + """SELECT 'bus' AS source_mode, 1 AS source_sheet, vehicle IS NULL AS old_header, count(*) AS n_rows,
       true AS named FROM drifted GROUP BY vehicle IS NULL""",
)
def _import_union(spark, sf):
    raw = files.read_incident_files(spark, f"{drifting_files(spark, sf)}/bus", "bus")
    return raw.groupBy("source_mode", "source_sheet", F.col("vehicle").isNull().alias("old_header")).agg(
        F.count("*").alias("n_rows"), F.bool_and(F.endswith("source_file", F.lit(".csv"))).alias("named")
    )


@case(
    "discover_files",
    "SELECT 'bus' AS mode, count(DISTINCT l_linestatus) AS headers, true AS csv_only FROM lineitem",
)
def _discover(spark, sf):
    found = files.discover_files(spark, f"{drifting_files(spark, sf)}/bus")
    family = F.regexp_extract("path", "/bus/([^/]+)/", 1)
    return found.agg(
        F.lit("bus").alias("mode"), F.count_distinct(family).alias("headers"),
        F.bool_and(F.endswith("name", F.lit(".csv"))).alias("csv_only"),
    )


@case(
    "clean_all",
    """SELECT CASE WHEN l_linestatus = 'O' THEN 'bus' ELSE 'streetcar' END AS mode,
       strftime(l_shipdate, '%Y-%m-%d') AS day, CAST(l_suppkey AS VARCHAR) AS route, CAST(l_linenumber AS DOUBLE) AS min_delay
       FROM lineitem WHERE l_linenumber <> 7""",
)
def _clean_all(spark, sf):
    folder = scratch_folder(spark)
    line = table(spark, sf, "lineitem")
    delay = F.when(F.col("l_linenumber") == 7, "-1").otherwise(F.col("l_linenumber").cast("string"))
    day, route = F.date_format("l_shipdate", "yyyy-MM-dd"), F.concat(F.col("l_suppkey").cast("string"), F.lit(".0"))
    bus, tram = line.where("l_linestatus = 'O'"), line.where("l_linestatus <> 'O'")
    write_csv(bus.select(day.alias("Report Date"), route.alias("Line"), delay.alias("Delay")), f"{folder}/bus")
    write_csv(tram.select(day.alias("Date"), route.alias("Route"), delay.alias("Min Delay")), f"{folder}/streetcar")
    cleaned = clean_all(spark, {"bus": f"{folder}/bus", "streetcar": f"{folder}/streetcar"})
    return cleaned.select("mode", F.date_format("ts", "yyyy-MM-dd").alias("day"), "route", "min_delay")


@case(
    "feed_scan",
    sql.with_ctes(_FEED) + "SELECT 's' || p_partkey AS stop_id, p_name || ' St' AS stop_name, CAST(NULL AS VARCHAR) AS stop_lon FROM part",
)
def _feed_scan(spark, sf):
    folder = scratch_folder(spark)
    stops = feed_tables(spark, sf)["stops"]
    # A byte-order mark, spaces around values, a column that the feed does not have.
    marked = stops.select(F.concat(F.lit(" "), "stop_id").alias("\ufeffstop_id"), "stop_name", "stop_lat")
    write_csv(marked, f"{folder}/stops.txt")
    return feed.read_feed_table(spark, folder, "stops").select("stop_id", "stop_name", "stop_lon")


@case(
    "typed_scan",
    sql.modeled("SELECT mode, route, CAST(count(*) AS BIGINT) AS n_rows, sum(min_delay) AS total FROM model GROUP BY mode, route"),
)
def _typed_scan(spark, sf):
    path = scratch_folder(spark)
    df = modeled_incidents(spark, sf)
    kept = {"mode", "ts", "route", "direction", "incident", "location", "min_delay"}
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in cleaned_fields(spark) if f.name not in kept]
    tables.write_cleaned(df.select(*kept, *blank), path)
    back = tables.read_cleaned(spark, path)
    return back.groupBy("mode", "route").agg(F.count("*").alias("n_rows"), F.sum("min_delay").alias("total"))


def cleaned_fields(spark: SparkSession):
    return spark.createDataFrame([], CLEANED_SCHEMA).schema


@case(
    "split_sink",
    sql.modeled("SELECT split, CAST(count(*) AS BIGINT) AS n_rows FROM model WHERE split = 'test' GROUP BY split"),
)
def _split_sink(spark, sf):
    path = scratch_folder(spark)
    tables.write_splits(modeled_incidents(spark, sf).select("split", "route", "min_delay"), path)
    return tables.read_split(spark, path, "test").groupBy("split").agg(F.count("*").alias("n_rows"))


@case(
    "report_sink",
    """SELECT l_shipmode AS mode, count(*) AS n_rows, CASE WHEN l_shipmode < 'N' THEN avg(l_quantity) END AS mean
       FROM lineitem GROUP BY l_shipmode""".replace("l_shipmode", "l_linestatus"),
)
def _report_sink(spark, sf):
    path = scratch_folder(spark)
    report = table(spark, sf, "lineitem").groupBy(F.col("l_linestatus").alias("mode")).agg(
        F.count("*").alias("n_rows"), F.avg("l_quantity").alias("mean")
    )
    # NaN is no JSON: the sink writes null.
    odd = report.withColumn("mean", F.when(F.col("mode") < "N", F.col("mean")).otherwise(F.lit(float("nan"))))
    tables.write_report(odd, path)
    return spark.read.schema("mode string, n_rows long, mean double").json(path)


@case(
    "holiday_coercion",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 1 END AS INTEGER) AS flag
       FROM orders""",
)
def _holiday_coercion(spark, sf):
    k = F.col("o_orderkey") % 5
    dirty = F.when(k == 0, "1").when(k == 1, " 0.0 ").when(k == 2, "yes").when(k == 4, "1.0")
    return table(spark, sf, "orders").select("o_orderkey", calendar.holiday_coercion(dirty).alias("flag"))


@case(
    "first_present",
    """SELECT l_orderkey, l_linenumber, l_linestatus AS status, CAST(NULL AS VARCHAR) AS nothing FROM lineitem""",
)
def _first_present(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", rows.first_present(line, "status", ["state", "l_linestatus", "l_returnflag"]),
        rows.first_present(line, "nothing", ["state", "status"]),
    )


@case(
    "sample_weight_ranges",
    """SELECT l_orderkey, l_linenumber, v AS value, CAST(CASE WHEN v <= 15 THEN 1.0 WHEN v BETWEEN 16 AND 30 THEN 1.5
       WHEN v BETWEEN 31 AND 60 THEN 2.0 WHEN v BETWEEN 61 AND 120 THEN 3.0 WHEN v BETWEEN 121 AND 240 THEN 4.0 ELSE 1.0 END AS DOUBLE) AS weight
       FROM (SELECT *, floor(l_quantity * l_quantity / 10) AS v FROM lineitem)""",
)
def _sample_weight_ranges(spark, sf):
    value = F.floor(F.col("l_quantity") * F.col("l_quantity") / 10).cast("double")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", value.alias("value"), rows.sample_weight(value).alias("weight")
    )


@case(
    "projected_values",
    sql.modeled(
        """SELECT kind, CAST(count(value) AS BIGINT) AS n_values FROM (
             SELECT 'category' AS kind, unnest([mode, route, direction, incident, location]) AS value FROM model
             UNION ALL SELECT 'number', CAST(hour(ts) AS VARCHAR) FROM model) GROUP BY kind"""
    ),
)
def _projected_values(spark, sf):
    df = modeled_incidents(spark, sf).withColumn("hour", F.hour("ts"))
    inputs, categories, numbers = feature_projection(
        df.columns, allowed=[f for f in FEATURES if f in df.columns], excluded=["is_holiday"]
    )
    cells = [
        F.struct(F.lit("category" if n in categories else "number").alias("kind"), F.col(n).cast("string").alias("value"))
        for n in inputs if n in categories or n in numbers
    ]
    return df.select(F.explode(F.array(*cells)).alias("cell")).groupBy(F.col("cell.kind").alias("kind")).agg(
        F.count("cell.value").alias("n_values")
    )


def _error_case(group: str) -> None:
    @case(
        f"error_by_{group}",
        sql.predicted(
            f"""SELECT split, {group}, round(avg(absolute_error), 6) AS mae, round(sqrt(avg(error * error)), 6) AS rmse,
             round(avg(error), 6) + 0 AS mean_error, count(*) AS row_count,
             round(quantile_cont(absolute_error, 0.5), 6) AS median_absolute_error
             FROM pred GROUP BY ALL HAVING count(*) >= 20"""
        ),
    )
    def _query(spark, sf):
        return rounded(reports.error_by_group(predictions(spark, sf, [group]), group, 20))


for _group in ("mode", "route", "hour", "month", "delay_bucket"):
    _error_case(_group)
