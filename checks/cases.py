"""Registered queries: name -> (Spark query, checking SQL or None)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sql
from checks.incidents import modeled_incidents, raw_incidents, table, with_time
from priorline.contract import BASELINES, CATEGORICAL_FEATURES, HISTORY_FEATURES, feature_projection
from priorline.functions import calendar, rows, text
from priorline.operators import audit, encoding, history, lookup, match, metrics, positions, reports, requests, support
from priorline.plans import explain, models, score
from priorline.plans.clean import clean_incidents, dropped_rows
from priorline.sources import feed
from priorline.sources.durable import durable, scratch_tables
from priorline.sources.files import normalize_columns

Query = Callable[[SparkSession, str], DataFrame]
CASES: dict[str, tuple[Query, str | None]] = {}


def case(name: str, check: str | None = None):
    def register(query: Query) -> Query:
        CASES[name] = (query, check)
        return query

    return register


def rounded(df: DataFrame, digits: int = 6, **casts: str) -> DataFrame:
    """Doubles rounded, timestamps as text: both engines then agree on the written value."""
    columns: list[Column] = []
    for field in df.schema:
        kind, value = field.dataType.simpleString(), F.col(field.name)
        if kind == "double":
            # Adding zero turns a rounded -0.0 into 0.0.
            value = F.round(value, digits) + F.lit(0.0)
        elif kind.startswith("timestamp") or kind == "date":
            value = value.cast("string")
        elif kind in ("tinyint", "smallint"):
            value = value.cast("int")
        columns.append(value.cast(casts[field.name]).alias(field.name) if field.name in casts else value.alias(field.name))
    return df.select(*columns)


# --- row-level rules ------------------------------------------------------------------------

@case(
    "clean_text",
    """SELECT l_orderkey, CASE l_linenumber % 4
      WHEN 0 THEN CAST(l_linenumber AS VARCHAR)
      WHEN 1 THEN NULL WHEN 2 THEN l_returnflag || ' ' || l_linestatus
      ELSE l_linenumber || '.50' END AS cleaned FROM lineitem""",
)
def _clean_text(spark, sf):
    n = F.col("l_linenumber")
    dirty = (
        F.when(n % 4 == 0, F.concat(F.lit("  "), n, F.lit(".0 ")))
        .when(n % 4 == 1, F.lit(" NaN "))
        .when(n % 4 == 2, F.concat(F.lit(" "), "l_returnflag", F.lit(" \t "), "l_linestatus"))
        .otherwise(F.concat(n, F.lit(".50")))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", text.clean_text(dirty).alias("cleaned"))


@case(
    "parse_time",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 5
        WHEN 0 THEN (o_orderkey % 24) * 3600 + (o_custkey % 60) * 60
        WHEN 1 THEN (o_orderkey % 24) * 3600 + (o_custkey % 60) * 60 + 7
        WHEN 2 THEN (o_orderkey % 12) * 3600 + (o_custkey % 60) * 60 + 12 * 3600
        WHEN 3 THEN (o_custkey % 100) * 864 ELSE NULL END AS INTEGER) AS second_of_day FROM orders""",
)
def _parse_time(spark, sf):
    k, minute = F.col("o_orderkey"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0")
    hour12 = F.when(k % 12 == 0, 12).otherwise(k % 12)
    written = (
        F.when(k % 5 == 0, F.concat(k % 24, F.lit(":"), minute))
        .when(k % 5 == 1, F.concat(k % 24, F.lit(":"), minute, F.lit(":07")))
        .when(k % 5 == 2, F.concat(hour12, F.lit(":"), minute, F.lit(" pm")))
        .when(k % 5 == 3, ((F.col("o_custkey") % 100) / 100).cast("string"))
        .otherwise(F.lit("noon"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", calendar.parse_time_seconds(written).alias("second_of_day")
    )


@case(
    "build_ts",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 3 THEN NULL
        WHEN 2 THEN date_trunc('day', o_orderdate)
        ELSE date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey % 24 AS INTEGER))
             + to_minutes(CAST(o_custkey % 60 AS INTEGER)) END AS VARCHAR) AS ts FROM orders""",
)
def _build_ts(spark, sf):
    k = F.col("o_orderkey")
    date = (
        F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 4 == 1, F.date_format("o_orderdate", "d-MMM-yy"))
        .when(k % 4 == 2, F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.lit("not a date"))
    )
    time = F.when(k % 4 != 2, F.concat(k % 24, F.lit(":"), F.lpad((F.col("o_custkey") % 60).cast("string"), 2, "0")))
    return rounded(
        table(spark, sf, "orders").select("o_orderkey", calendar.build_timestamp(date, time).alias("ts"))
    )


def _raw_import(spark, sf) -> DataFrame:
    """The incidents as an import would read them: drifting headers, everything text."""
    raw = raw_incidents(spark, sf)
    bad = F.when(F.col("min_delay") > 230, F.lit("long")).when(F.col("min_delay") == 10, F.lit("-3")).otherwise(
        F.col("min_delay").cast("string")
    )
    return raw.select(
        F.when(F.col("min_delay") != 40, F.date_format("ts", "yyyy-MM-dd")).alias("Report Date"),
        F.date_format("ts", "HH:mm").alias("Time"),
        F.col("route").alias("Line"),
        F.col("direction").alias("Bound"),
        F.col("location").alias("Location"),
        F.col("incident").alias("Incident Type"),
        bad.alias("Min Delay"),
        F.lit("0").alias("Delay"),
        F.col("vehicle").alias("Vehicle ID"),
    )


_IMPORT_OK = "min_delay <= 230 AND min_delay NOT IN (10, 40)"


def _clean_sql(x: str) -> str:
    s = sql.squeeze(x)
    return (
        f"CASE WHEN lower({s}) IN ('', 'nan', 'none', 'nat') THEN NULL "
        f"WHEN regexp_full_match({s}, '[0-9]+\\.0') THEN left({s}, length({s}) - 2) ELSE {s} END"
    )


_EASTER = """
years AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem),
e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM e3),
easter AS (SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS sunday FROM e4),
days AS (
  SELECT y, CAST(d AS DATE) AS day, isodow(d) AS dow, month(d) AS mon, day(d) AS dom
  FROM years, LATERAL (SELECT unnest(generate_series(make_timestamp(y, 1, 1, 0, 0, 0), make_timestamp(y, 12, 31, 0, 0, 0), INTERVAL 1 DAY)) AS d)
),
holidays AS (
  SELECT days.y, day FROM days JOIN easter ON days.y = easter.y WHERE
    (mon = 1 AND dom = 1) OR (mon = 2 AND dow = 1 AND dom BETWEEN 15 AND 21) OR day = sunday - 2
    OR (mon = 5 AND dow = 1 AND dom BETWEEN 18 AND 24) OR (mon = 7 AND dom = 1)
    OR (mon = 9 AND dow = 1 AND dom <= 7) OR (mon = 10 AND dow = 1 AND dom BETWEEN 8 AND 14)
    OR (mon = 12 AND dom IN (25, 26))
)"""


@case(
    "clean_table",
    sql.with_ctes(sql.RAW, _EASTER)
    + f"""SELECT 'bus' AS mode, CAST(ts AS VARCHAR) AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS date,
        {_clean_sql('route')} AS route, {_clean_sql('direction')} AS direction, {_clean_sql('location')} AS location,
        {_clean_sql('incident')} AS incident, min_delay, CAST(NULL AS DOUBLE) AS min_gap, vehicle,
        CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
        CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) IN (6, 7) AS INTEGER) AS is_weekend,
        CAST(CAST(ts AS DATE) IN (SELECT day FROM holidays) AS INTEGER) AS is_holiday,
        CAST(NULL AS VARCHAR) AS source_file, CAST(NULL AS INTEGER) AS source_sheet
      FROM raw WHERE {_IMPORT_OK}""",
)
def _clean_table(spark, sf):
    return rounded(clean_incidents(normalize_columns(_raw_import(spark, sf), "bus"), "bus"))


@case(
    "invalid_filter",
    sql.with_ctes(sql.RAW)
    + f"""SELECT count(*) AS rows_read, count(*) FILTER (WHERE {_IMPORT_OK}) AS rows_kept,
       count(*) FILTER (WHERE NOT ({_IMPORT_OK})) AS rows_dropped FROM raw""",
)
def _invalid_filter(spark, sf):
    return dropped_rows(normalize_columns(_raw_import(spark, sf), "bus"), "bus")


@case(
    "calendar_parts",
    """SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
      CAST(month(ts) AS INTEGER) AS month, CAST(isodow(ts) IN (6, 7) AS INTEGER) AS is_weekend,
      CAST(dayofyear(ts) AS INTEGER) AS day_of_year FROM events""",
)
def _calendar_parts(spark, sf):
    parts = calendar.calendar_parts(F.col("ts"))
    return table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


@case(
    "cyclic",
    """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 9) + 0 AS hour_sin,
      round(cos(2 * pi() * hour(ts) / 24), 9) + 0 AS hour_cos,
      round(sin(2 * pi() * dayofyear(ts) / 366), 9) + 0 AS day_sin,
      round(cos(2 * pi() * dayofyear(ts) / 366), 9) + 0 AS day_cos FROM events""",
)
def _cyclic(spark, sf):
    parts = calendar.cyclic_parts(F.hour("ts"), F.dayofyear("ts"))
    return rounded(table(spark, sf, "events").select("event_id", *[c.alias(n) for n, c in parts.items()]), 9)


@case("holiday_table", sql.with_ctes(_EASTER) + "SELECT y AS year, CAST(day AS VARCHAR) AS day FROM holidays")
def _holiday_table(spark, sf):
    years = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    days = years.select("year", F.explode(calendar.holidays_of_year(F.col("year"))).alias("day"))
    return rounded(days.distinct())


@case(
    "holiday_flag",
    sql.with_ctes(_EASTER)
    + """SELECT l_orderkey, CAST(CAST(l_shipdate AS DATE) IN (SELECT day FROM holidays) AS INTEGER) AS is_holiday,
       CAST(CAST(l_shipdate AS DATE) IN (SELECT day FROM holidays) OR (month(l_shipdate) = 8 AND
         isodow(l_shipdate) = 1 AND day(l_shipdate) <= 7) AS INTEGER) AS is_holiday_request FROM lineitem""",
)
def _holiday_flag(spark, sf):
    ship = F.col("l_shipdate")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", calendar.is_holiday(ship).alias("is_holiday"),
        calendar.is_holiday(ship, "request").alias("is_holiday_request"),
    )


def _norm_case(name: str, answer: str):
    @case(
        f"norm_{name}",
        sql.with_ctes(sql.RAW)
        + f"SELECT {name} AS raw_value, {answer} AS {name}, count(*) AS rows FROM raw GROUP BY ALL",
    )
    def _query(spark, sf):
        raw = raw_incidents(spark, sf)
        return raw.select(F.col(name).alias("raw_value"), text.NORMALIZERS[name](F.col(name)).alias(name)).groupBy(
            "raw_value", name
        ).agg(F.count(F.lit(1)).alias("rows"))


_norm_case("mode", sql.norm_mode("mode"))
_norm_case("route", sql.norm_route("route"))
_norm_case("direction", sql.norm_direction("direction"))
_norm_case("incident", sql.norm_incident("incident"))
_norm_case("location", sql.norm_location("location"))


@case(
    "normalize_table",
    sql.with_ctes(sql.RAW, sql.NORM)
    + """SELECT CAST(ts AS VARCHAR) AS ts, mode, route, direction, incident, location, min_delay, route_raw,
       direction_raw, incident_raw, location_raw FROM norm""",
)
def _normalize_table(spark, sf):
    return rounded(text.normalize_categories(raw_incidents(spark, sf)).drop("min_gap", "vehicle"))


@case(
    "modeling_filter",
    sql.modeled("SELECT mode, split, count(*) AS rows, sum(min_delay) AS total FROM model GROUP BY ALL"),
)
def _modeling_filter(spark, sf):
    return modeled_incidents(spark, sf, False).groupBy("mode", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("min_delay").alias("total")
    )


@case(
    "severe_flags",
    sql.modeled(
        """SELECT min_delay, CAST(min_delay >= 15 AS INTEGER) AS severe_delay_15,
         CAST(min_delay >= 30 AS INTEGER) AS severe_delay_30, CAST(min_delay >= 60 AS INTEGER) AS severe_delay_60
         FROM model"""
    ),
)
def _severe_flags(spark, sf):
    flags = rows.severe_flags(F.col("min_delay"))
    return modeled_incidents(spark, sf, False).select("min_delay", *[c.alias(n) for n, c in flags.items()])


@case(
    "split_label",
    sql.modeled(
        """SELECT split, count(*) AS row_count, CAST(min(ts) AS VARCHAR) AS min_ts, CAST(max(ts) AS VARCHAR) AS max_ts
         FROM model WHERE split IS NOT NULL GROUP BY split
         UNION ALL SELECT 'all', count(*), CAST(min(ts) AS VARCHAR), CAST(max(ts) AS VARCHAR) FROM model"""
    ),
)
def _split_label(spark, sf):
    return rounded(reports.split_summary(modeled_incidents(spark, sf, False)))


@case(
    "calib_split",
    sql.modeled(
        """SELECT CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'base' ELSE 'calibration' END AS calibration_split,
         count(*) AS rows FROM model WHERE split = 'train' GROUP BY 1"""
    ),
)
def _calib_split(spark, sf):
    train = modeled_incidents(spark, sf, False).where("split = 'train'")
    labelled = rows.check_calibration_split(train, "1999-01-01", "2000-01-01")
    return labelled.groupBy("calibration_split").agg(F.count(F.lit(1)).alias("rows"))


@case(
    "delay_bucket",
    sql.with_ctes(sql.RAW)
    + f"SELECT {sql.BUCKET} AS delay_bucket, count(*) AS rows, max(min_delay) AS longest FROM raw GROUP BY 1",
)
def _delay_bucket(spark, sf):
    return raw_incidents(spark, sf, False).groupBy(rows.delay_bucket(F.col("min_delay")).alias("delay_bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("min_delay").alias("longest")
    )


@case(
    "sample_weight",
    """SELECT l_quantity / 2 AS value, CAST(CASE WHEN l_quantity / 2 BETWEEN 0 AND 15 THEN 1.0
      WHEN l_quantity / 2 BETWEEN 16 AND 30 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS weight FROM lineitem""",
)
def _sample_weight(spark, sf):
    value = F.col("l_quantity") / 2
    return table(spark, sf, "lineitem").select(value.alias("value"), rows.sample_weight(value).alias("weight"))


@case(
    "class_weight",
    sql.modeled(
        """SELECT split, count(*) FILTER (WHERE min_delay >= 30) AS positives,
         count(*) FILTER (WHERE min_delay < 30) AS negatives,
         round(count(*) FILTER (WHERE min_delay < 30) / count(*) FILTER (WHERE min_delay >= 30), 6) AS class_weight
         FROM model GROUP BY split"""
    ),
)
def _class_weight(spark, sf):
    df = modeled_incidents(spark, sf, False).withColumns(rows.severe_flags(F.col("min_delay")))
    return rounded(rows.class_weight(df, "severe_delay_30", ["split"]))


@case(
    "risk_band",
    """SELECT l_discount AS p, CASE WHEN l_discount * 5 < 0.2 THEN 'low' WHEN l_discount * 5 < 0.5 THEN 'medium'
      ELSE 'high' END AS plain_band, CASE WHEN l_discount * 5 < 0.1 THEN 'low' WHEN l_discount * 5 < 0.3 THEN 'medium'
      ELSE 'high' END AS calibrated_band FROM lineitem""",
)
def _risk_band(spark, sf):
    p = F.col("l_discount") * 5
    return table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("p"), rows.risk_band(p, rows.PLAIN_BANDS).alias("plain_band"),
        rows.risk_band(p).alias("calibrated_band"),
    )


# --- history --------------------------------------------------------------------------------

_KEYS = "CAST(ts AS VARCHAR) AS ts, mode, route, direction, incident, location, min_delay"


def _history_case(name: str, features: list[str], strategy: str | None = None):
    rounding = ", ".join(f"round({f}, 9) AS {f}" if not f.endswith("count") else f for f in features)

    @case(name, sql.modeled(f"SELECT {_KEYS}, {rounding} FROM hist", sql.history_cte(features)))
    def _query(spark, sf):
        df = history.add_history_features(modeled_incidents(spark, sf), features, strategy=strategy)
        return rounded(
            df.select("ts", "mode", "route", "direction", "incident", "location", "min_delay", *features), 9
        )


for _name, _features in {
    "prior_route_mean": ["prior_route_mean_delay"],
    "prior_route_hour_mean": ["prior_route_hour_mean_delay"],
    "prior_incident_mean": ["prior_incident_mean_delay"],
    "prior_mode_mean": ["prior_mode_mean_delay"],
    "prior_global_mean": ["prior_global_mean_delay"],
    "prior_route_incident_mean": ["prior_route_incident_mean_delay"],
    "prior_mode_incident_mean": ["prior_mode_incident_mean_delay"],
    "prior_route_direction_mean": ["prior_route_direction_mean_delay"],
    "prior_route_incident_count": ["prior_route_incident_count"],
    "prior_location_mean_count": ["prior_location_mean_delay", "prior_location_count"],
    "roll30_route": ["prior_route_30d_mean_delay"],
    "roll30_incident": ["prior_incident_30d_mean_delay"],
    "roll30_severe_rates": [
        "prior_route_30d_severe_rate_30", "prior_incident_30d_severe_rate_30",
        "prior_route_30d_severe_rate_60", "prior_incident_30d_severe_rate_60",
    ],
    "roll7_route_hour_fallback": ["prior_route_hour_7d_mean_delay"],
    "all_history": HISTORY_FEATURES,
}.items():
    _history_case(_name, _features)
_history_case("all_history_sliced", HISTORY_FEATURES, "sliced")


# --- point-in-time look-up ------------------------------------------------------------------

_ASKED = """
asked AS (
  SELECT o_orderkey AS request_id, date_trunc('day', o_orderdate) + to_hours(CAST(o_custkey % 24 AS INTEGER)) AS ts,
    CASE WHEN o_orderkey % 2 = 0 THEN 'BUS' ELSE ' streetcar' END AS mode,
    (o_custkey % 120) || CASE WHEN o_orderkey % 3 = 0 THEN '.0' ELSE '' END AS route,
    CASE o_orderkey % 3 WHEN 0 THEN 'nb' WHEN 1 THEN 'East' ELSE '?' END AS direction,
    CASE o_orderkey % 4 WHEN 0 THEN 'Mech' WHEN 1 THEN 'delay' WHEN 2 THEN 'EMS' END AS incident,
    CASE o_orderkey % 3 WHEN 0 THEN 'red widget stn' WHEN 1 THEN 'n/a' ELSE 'Queen & blue bolt' END AS location
  FROM orders
),
request AS (
  SELECT request_id, ts, lower(trim(mode)) AS mode, regexp_replace(route, '\\.0$', '') AS route,
    CASE direction WHEN 'nb' THEN 'N' WHEN 'East' THEN 'E' ELSE 'Unknown' END AS direction,
    CASE incident WHEN 'Mech' THEN 'Mechanical' WHEN 'delay' THEN 'General Delay'
      WHEN 'EMS' THEN 'Emergency Services' ELSE 'Unknown' END AS incident,
    CASE location WHEN 'red widget stn' THEN 'RED WIDGET STATION' WHEN 'n/a' THEN 'Unknown'
      ELSE 'QUEEN AND BLUE BOLT' END AS location
  FROM asked
),
merged AS (
  SELECT NULL AS request_id, ts, mode, route, direction, incident, location, CAST(hour(ts) AS INTEGER) AS hour,
    min_delay, 1 AS past FROM model
  UNION ALL
  SELECT request_id, ts, mode, route, direction, incident, location, CAST(hour(ts) AS INTEGER), NULL, NULL FROM request
)"""


def order_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as an incident request."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("request_id"),
        (
            F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), (F.col("o_custkey") % 24).cast("int"))
        ).alias("ts"),
        F.when(k % 2 == 0, "BUS").otherwise(" streetcar").alias("mode"),
        F.concat((F.col("o_custkey") % 120).cast("string"), F.when(k % 3 == 0, ".0").otherwise("")).alias("route"),
        F.when(k % 3 == 0, "nb").when(k % 3 == 1, "East").otherwise("?").alias("direction"),
        F.when(k % 4 == 0, "Mech").when(k % 4 == 1, "delay").when(k % 4 == 2, "EMS").alias("incident"),
        F.when(k % 3 == 0, "red widget stn").when(k % 3 == 1, "n/a").otherwise("Queen & blue bolt").alias("location"),
    )


def _past_model(spark, sf):
    return modeled_incidents(spark, sf).drop("split")


_LOOKUP_SQL = {
    name: expr.replace("count(*)", "count(past)")
    for name, expr in sql.HISTORY_SQL.items()
}


@case(
    "point_in_time_lookup",
    sql.modeled(
        "SELECT request_id, "
        + ", ".join(f"round({n}, 9) AS {n}" if not n.endswith("count") else n for n in HISTORY_FEATURES)
        + " FROM (SELECT *, "
        + ", ".join(f"{e} AS {n}" for n, e in _LOOKUP_SQL.items())
        + " FROM merged) WHERE request_id IS NOT NULL",
        _ASKED,
    ),
)
def _point_in_time(spark, sf):
    found = lookup.look_up_history(order_requests(spark, sf), _past_model(spark, sf), with_warnings=False)
    return rounded(found.select("request_id", *HISTORY_FEATURES), 9)


_SUPPORT_SQL = {
    "support_global": sql.over(""), "support_route": sql.over("route"), "support_location": sql.over("location"),
    "support_route_incident": sql.over("route, incident"), "support_mode_incident": sql.over("mode, incident"),
    "support_route_direction": sql.over("route, direction"), "support_incident": sql.over("incident"),
    "support_route_hour": sql.over("route, hour"), "support_mode": sql.over("mode"),
    "support_route_recent": sql.over("route", sql.recent(30)),
    "support_incident_recent": sql.over("incident", sql.recent(30)),
    "support_route_hour_recent": sql.over("route, hour", sql.recent(7)),
}


@case(
    "lookup_support",
    sql.modeled(
        "SELECT request_id, " + ", ".join(_SUPPORT_SQL)
        + ", CAST(1 + CAST(beyond AS INTEGER) + CAST(early OR support_global < 3 AS INTEGER) "
        + "+ CAST(support_route_hour_recent = 0 AND support_global > 0 AS INTEGER) + CAST(support_route = 0 OR support_route_hour = 0 OR "
        + "support_incident = 0 OR support_mode = 0 OR support_global = 0 OR support_route_incident = 0 OR "
        + "support_mode_incident = 0 OR support_route_direction = 0 OR support_route_recent = 0 OR "
        + "support_incident_recent = 0 OR support_location = 0 AS INTEGER) + CAST("
        + " OR ".join(f"{n} BETWEEN 1 AND 2" for n in _SUPPORT_SQL)
        + " AS INTEGER) AS INTEGER) AS warning_count FROM (SELECT *, ts > (SELECT max(ts) FROM model) AS beyond, "
        + "ts <= (SELECT min(ts) FROM model) AS early, "
        + ", ".join(f"count(past) {w} AS {n}" for n, w in _SUPPORT_SQL.items())
        + " FROM merged) WHERE request_id IS NOT NULL",
        _ASKED,
    ),
)
def _lookup_support(spark, sf):
    found = lookup.look_up_history(order_requests(spark, sf), _past_model(spark, sf))
    return found.select("request_id", *_SUPPORT_SQL, F.size("history_warnings").alias("warning_count"))


@case(
    "history_coverage",
    "SELECT count(*) AS row_count, CAST(min(ts) AS VARCHAR) AS min_timestamp, CAST(max(ts) AS VARCHAR) AS max_timestamp FROM (SELECT date_trunc('day', l_shipdate) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts FROM lineitem)",
)
def _coverage(spark, sf):
    return rounded(lookup.history_coverage(raw_incidents(spark, sf, False)))


# --- baselines and residual reports ---------------------------------------------------------

_GRID = """
grid AS (
  SELECT baseline, split, filled, min_delay AS actual, missing,
    CASE WHEN filled THEN coalesce(raw, prior_route_mean_delay, prior_mode_mean_delay, prior_global_mean_delay,
      (SELECT avg(min_delay) FROM model WHERE split = 'train')) ELSE raw END AS prediction
  FROM (SELECT split, min_delay, prior_route_mean_delay, prior_mode_mean_delay, prior_global_mean_delay,
      unnest([%s]) AS baseline, unnest([%s]) AS raw, unnest([%s]) AS missing
    FROM hist WHERE split IN ('validation', 'test')), (VALUES (true), (false)) AS v(filled)
),
graded AS (
  SELECT baseline, CASE WHEN filled THEN baseline || '_filled' ELSE baseline END AS evaluation_name, split, filled,
    %s, count(prediction) AS rows_evaluated, count(*) FILTER (WHERE missing) AS missing_predictions_before_fallback,
    round(count(*) FILTER (WHERE missing) / count(*) * 100, 6) AS missing_predictions_before_fallback_percent
  FROM grid GROUP BY ALL HAVING NOT filled OR count(*) FILTER (WHERE missing) > 0
)""" % (
    ", ".join(f"'{b}'" for b in BASELINES), ", ".join(BASELINES), ", ".join(f"{b} IS NULL" for b in BASELINES),
    sql.fit_sql(),
)


def _baseline_rows(spark, sf):
    return history.add_history_features(modeled_incidents(spark, sf, False), BASELINES)


@case("baseline_grid", sql.modeled("SELECT * FROM graded", sql.history_cte(BASELINES), _GRID))
def _baseline_grid(spark, sf):
    return rounded(reports.baseline_grid(_baseline_rows(spark, sf)))


@case(
    "best_baseline",
    sql.modeled(
        """SELECT baseline, evaluation_name, filled, mae, rmse, r2 FROM (SELECT * FROM graded WHERE split = 'validation'
         QUALIFY row_number() OVER (PARTITION BY baseline ORDER BY filled DESC) = 1)
         ORDER BY mae, rmse, r2 DESC LIMIT 1""",
        sql.history_cte(BASELINES), _GRID,
    ),
)
def _best_baseline(spark, sf):
    best = metrics.pick_baseline(reports.baseline_grid(_baseline_rows(spark, sf)))
    return rounded(best.select("baseline", "evaluation_name", "filled", "mae", "rmse", "r2"))


@case(
    "baseline_comparison",
    sql.modeled(
        """SELECT m.split, round(m.mae, 4) AS mae, round(m.r2, 4) AS r2, b.evaluation_name AS baseline_name, round(b.mae, 4) AS baseline_mae,
           round(b.mae - m.mae, 4) + 0 AS mae_improvement, round((b.mae - m.mae) / nullif(b.mae, 0) * 100, 4) + 0 AS mae_improvement_percent
           FROM graded m JOIN (SELECT g.* FROM graded g JOIN (SELECT baseline, filled FROM (SELECT * FROM graded WHERE split = 'validation'
             QUALIFY row_number() OVER (PARTITION BY baseline ORDER BY filled DESC) = 1) ORDER BY mae, rmse, r2 DESC LIMIT 1) USING (baseline, filled)) b
           USING (split) WHERE m.baseline = 'prior_global_mean_delay' AND m.filled = (SELECT bool_or(filled) FROM graded WHERE baseline = 'prior_global_mean_delay')""",
        sql.history_cte(BASELINES), _GRID,
    ),
)
def _baseline_comparison(spark, sf):
    """The global mean, standing for a model, against the baseline that validation chooses."""
    grid = durable(reports.baseline_grid(_baseline_rows(spark, sf)))
    best = metrics.pick_baseline(grid).select(F.col("baseline").alias("best"), F.col("filled").alias("best_filled"))
    chosen = grid.join(F.broadcast(best), (F.col("baseline") == F.col("best")) & (F.col("filled") == F.col("best_filled")))  # one row
    own = grid.where("baseline = 'prior_global_mean_delay'")
    filled = own.agg(F.max("filled").alias("any_filled"))  # one row
    model = own.join(F.broadcast(filled), F.col("filled") == F.col("any_filled")).select("split", "mae", "r2")
    return rounded(metrics.with_baseline_comparison(model, chosen), 4)


_GRADED = "split in ('validation', 'test')"


def predictions(spark: SparkSession, sf: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Validation and test rows with the filled route-hour baseline as prediction.

    Of the incident's own columns, ``columns`` says which ones are wanted besides the keys and the target;
    hour, month and delay bucket are made below, for all.
    """
    df = modeled_incidents(spark, sf)
    if columns is not None:
        own = [c for c in columns if c not in ("hour", "month", "delay_bucket")]
        df = df.select(*dict.fromkeys(["ts", "mode", "route", "min_delay", "split", *own]))
    df = history.add_history_features(df, sql.PREDICTION_FEATURES, asked=F.expr(_GRADED))
    df = df.withColumns(
        {
            "actual": F.col("min_delay"),
            "prediction": rows.with_fallbacks(F.col("prior_route_hour_mean_delay")),
            "hour": F.hour("ts"),
            "month": F.month("ts"),
        }
    )
    return rows.with_residuals(df)


@case(
    "baseline_by_mode",
    sql.predicted(f"SELECT split, mode, {sql.fit_sql()}, count(prediction) AS rows_evaluated FROM pred GROUP BY ALL"),
)
def _baseline_by_mode(spark, sf):
    return rounded(metrics.regression_metrics(predictions(spark, sf, []), ["split", "mode"]))


@case(
    "metrics_extended",
    sql.predicted(
        f"""SELECT split, {sql.fit_sql()}, round(avg(error), 6) + 0 AS mean_error, count(*) AS row_count,
        round(quantile_cont(absolute_error, 0.5), 6) AS median_absolute_error,
        round(quantile_cont(absolute_error, 0.9), 6) AS p90_absolute_error,
        round(quantile_cont(absolute_error, 0.95), 6) AS p95_absolute_error FROM pred GROUP BY split"""
    ),
)
def _metrics_extended(spark, sf):
    return rounded(metrics.extended_metrics(predictions(spark, sf, []), ["split"]))


@case(
    "residuals",
    sql.predicted(
        """SELECT CAST(ts AS VARCHAR) AS ts, route, actual, round(prediction, 6) AS prediction,
         round(error, 6) + 0 AS error, round(absolute_error, 6) AS absolute_error,
         round(error * error, 4) AS squared_error, delay_bucket FROM pred"""
    ),
)
def _residuals(spark, sf):
    df = predictions(spark, sf, []).withColumn("squared_error", F.round("squared_error", 4))
    return rounded(
        df.select("ts", "route", "actual", "prediction", "error", "absolute_error", "squared_error", "delay_bucket")
    )


@case(
    "error_by_group",
    sql.predicted(
        """SELECT split, incident, round(avg(absolute_error), 6) AS mae, round(sqrt(avg(error * error)), 6) AS rmse,
         round(avg(error), 6) + 0 AS mean_error, count(*) AS row_count,
         round(quantile_cont(absolute_error, 0.5), 6) AS median_absolute_error
         FROM pred GROUP BY ALL HAVING count(*) >= 20"""
    ),
)
def _error_by_group(spark, sf):
    return rounded(reports.error_by_group(predictions(spark, sf, ["incident"]), "incident", 20))


_GROUPED = """
grouped AS (
  SELECT split, actual, prediction, error, absolute_error,
    unnest(['mode', 'route', 'direction', 'incident', 'location', 'hour', 'month', 'delay_bucket']) AS group_column,
    unnest([mode, route, direction, incident, location, CAST(hour AS VARCHAR), CAST(month AS VARCHAR), delay_bucket]) AS group_value
  FROM pred
)"""


@case(
    "error_contribution",
    sql.predicted(
        """SELECT split, group_column, group_value, round(avg(absolute_error), 6) AS mae,
         round(sqrt(avg(error * error)), 6) AS rmse, round(avg(error), 6) + 0 AS mean_error, count(*) AS row_count,
         round(quantile_cont(absolute_error, 0.5), 6) AS median_absolute_error,
         round(quantile_cont(absolute_error, 0.9), 6) AS p90_absolute_error,
         round(count(*) * avg(absolute_error), 4) AS total_error_contribution FROM grouped
         GROUP BY ALL HAVING group_column NOT IN ('route', 'location') OR count(*) >= 100""",
        _GROUPED,
    ),
)
def _error_contribution(spark, sf):
    df = reports.ranked_contribution(reports.error_contribution(predictions(spark, sf)))
    return rounded(df.withColumn("total_error_contribution", F.round("total_error_contribution", 4)))


@case(
    "high_delay",
    sql.predicted(
        """SELECT split, CAST(t AS INTEGER) AS threshold_minutes, count(*) FILTER (WHERE actual >= t) AS actual_high_delay_rows,
        round(count(*) FILTER (WHERE actual >= t) / count(*), 6) AS actual_high_delay_rate,
        round(avg(absolute_error) FILTER (WHERE actual >= t), 6) AS mae_high_delay,
        round(sqrt(avg(error * error) FILTER (WHERE actual >= t)), 6) AS rmse_high_delay,
        round(avg(prediction) FILTER (WHERE actual >= t), 6) AS mean_prediction_high_delay,
        round(avg(actual) FILTER (WHERE actual >= t), 6) AS mean_actual_high_delay,
        round(avg(error) FILTER (WHERE actual >= t), 6) AS mean_error_high_delay,
        round(count(*) FILTER (WHERE actual >= t AND prediction < actual) / count(*) FILTER (WHERE actual >= t) * 100, 6)
          AS underpredicted_high_delay_percent,
        round(avg(actual - prediction) FILTER (WHERE actual >= t AND prediction < actual), 6)
          AS average_underprediction_amount
        FROM pred, (VALUES (15), (30), (60)) AS v(t) GROUP BY split, t"""
    ),
)
def _high_delay(spark, sf):
    return rounded(reports.high_delay(predictions(spark, sf, [])))


@case(
    "severe_by_group",
    sql.predicted(
        """SELECT split, CAST(t AS INTEGER) AS threshold_minutes, group_column, group_value, count(*) AS row_count,
         round(avg(CAST(actual >= t AS INTEGER)), 6) AS actual_severe_delay_rate,
         round(avg(p), 6) AS mean_predicted_severe_delay_probability,
         round(avg(p) - avg(CAST(actual >= t AS INTEGER)), 6) + 0 AS probability_calibration_gap,
         round(count(*) FILTER (WHERE actual >= t AND coalesce(p, 0) < 0.5) / nullif(count(*) FILTER (WHERE actual >= t), 0), 6)
           AS false_negative_rate
         FROM (SELECT split, actual, unnest([30, 60]) AS t,
             unnest([prior_route_30d_severe_rate_30, prior_route_30d_severe_rate_60]) AS p,
             mode, route, direction, incident, location, hour FROM pred),
           LATERAL (SELECT unnest(['mode', 'route', 'direction', 'incident', 'location', 'hour']) AS group_column,
             unnest([mode, route, direction, incident, location, CAST(hour AS VARCHAR)]) AS group_value)
         GROUP BY ALL HAVING group_column NOT IN ('route', 'location') OR count(*) >= 100""",
        features=[*sql.PREDICTION_FEATURES, "prior_route_30d_severe_rate_30", "prior_route_30d_severe_rate_60"],
    ),
)
def _severe_by_group(spark, sf):
    rates = {t: f"prior_route_30d_severe_rate_{t}" for t in (30, 60)}
    df = history.add_history_features(modeled_incidents(spark, sf), list(rates.values()), asked=F.expr(_GRADED))
    df = df.withColumns({"actual": F.col("min_delay"), "hour": F.hour("ts")})
    df = df.withColumns({f"flag_{t}": (F.coalesce(c, F.lit(0.0)) >= 0.5).cast("int") for t, c in rates.items()})
    return rounded(reports.severe_by_group(df, rates, {t: f"flag_{t}" for t in rates}))


@case(
    "worst_predictions",
    sql.predicted(
        """SELECT split, mode, CAST(ts AS VARCHAR) AS ts, route, direction, incident, location, actual,
         round(prediction, 6) AS prediction, round(error, 6) AS error, round(absolute_error, 6) AS absolute_error, delay_bucket
         FROM (SELECT * REPLACE (round(prediction, 6) AS prediction, round(error, 6) AS error,
             round(absolute_error, 6) AS absolute_error) FROM pred)
         QUALIFY row_number() OVER (PARTITION BY split ORDER BY absolute_error DESC, mode, ts, route, direction,
           incident, location, actual, prediction, error, delay_bucket) <= 100"""
    ),
)
def _worst_predictions(spark, sf):
    df = predictions(spark, sf).withColumns(
        {c: F.round(c, 6) for c in ("prediction", "error", "absolute_error")}
    )
    return rounded(reports.worst_predictions(df))


# --- target diagnostics ---------------------------------------------------------------------

@case(
    "target_summary",
    sql.with_ctes(sql.RAW)
    + f"""SELECT count(*) AS total_rows, CAST(min(ts) AS VARCHAR) AS min_ts, CAST(max(ts) AS VARCHAR) AS max_ts,
      count(min_delay) AS target_count, round(avg(min_delay), 6) AS target_mean,
      round(stddev_samp(min_delay), 6) AS target_std, {", ".join(
        f"round(quantile_cont(min_delay, {q}), 6) AS q{str(q).replace('.', '_')}" for q in reports.TARGET_QUANTILES)}
      FROM raw""",
)
def _target_summary(spark, sf):
    return rounded(reports.target_summary(raw_incidents(spark, sf, False)))


@case("rows_by_mode", sql.with_ctes(sql.RAW) + "SELECT mode, count(*) AS row_count FROM raw GROUP BY mode")
def _rows_by_mode(spark, sf):
    return reports.rows_by_mode(raw_incidents(spark, sf, False))


@case(
    "threshold_counts",
    sql.with_ctes(sql.RAW)
    + """, scoped AS (SELECT 'overall' AS scope, 'all' AS mode, min_delay FROM raw
         UNION ALL SELECT 'mode', mode, min_delay FROM raw)
       SELECT scope, mode, CAST(t AS INTEGER) AS threshold_minutes,
         CASE WHEN t = 0 THEN 'min_delay == 0' ELSE 'min_delay > ' || t END AS condition,
         count(*) FILTER (WHERE CASE WHEN t = 0 THEN min_delay = 0 ELSE min_delay > t END) AS count,
         round(count(*) FILTER (WHERE CASE WHEN t = 0 THEN min_delay = 0 ELSE min_delay > t END) / count(*) * 100, 6) AS percentage,
         count(*) AS denominator
       FROM scoped, (VALUES (0), (60), (120), (240), (480), (1440)) AS v(t) GROUP BY scope, mode, t""",
)
def _threshold_counts(spark, sf):
    return rounded(reports.threshold_counts(raw_incidents(spark, sf, False)))


@case(
    "top_outliers",
    sql.with_ctes(sql.RAW)
    + """SELECT mode, CAST(ts AS VARCHAR) AS ts, CAST(NULL AS VARCHAR) AS date, route, direction, location, incident,
      min_delay, min_gap, vehicle, CAST(NULL AS VARCHAR) AS source_file, CAST(NULL AS VARCHAR) AS source_sheet FROM raw
      ORDER BY min_delay DESC, mode NULLS FIRST, ts, route NULLS FIRST, direction NULLS FIRST, location NULLS FIRST,
        incident NULLS FIRST, min_gap, vehicle LIMIT 50""",
)
def _top_outliers(spark, sf):
    return rounded(reports.top_outliers(raw_incidents(spark, sf)))


# --- probability reports --------------------------------------------------------------------


def risks(spark: SparkSession, sf: str) -> DataFrame:
    """Binary target and a probability for validation and test rows."""
    names = ["prior_route_30d_severe_rate_30", "prior_incident_30d_severe_rate_30"]
    keys = modeled_incidents(spark, sf, False).select("ts", "route", "incident", "min_delay", "split")
    df = history.add_history_features(keys, names, asked=F.expr(_GRADED))
    return df.select(
        "split", (F.col("min_delay") >= 30).cast("int").alias("y"),
        F.round(F.coalesce(*names, F.lit(0.0)), 6).alias("p"),
    )


_RATIOS = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy"""
_CUT = """
counted AS (
  SELECT split, CAST(c AS DOUBLE) AS c, count(*) FILTER (WHERE y = 1 AND p >= c) AS tp, count(*) FILTER (WHERE y = 0 AND p >= c) AS fp,
    count(*) FILTER (WHERE y = 0 AND p < c) AS tn, count(*) FILTER (WHERE y = 1 AND p < c) AS fn,
    round(avg(y), 6) AS positive_rate,
    round(avg(CASE WHEN y = 1 THEN -ln(least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
      ELSE -ln(1 - least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END), 6) AS log_loss,
    round(avg((p - y) * (p - y)), 6) AS brier_score
  FROM risk, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS c) GROUP BY split, c
)"""
_RANKS = """
hist_p AS (SELECT split, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM risk GROUP BY split, p),
curve AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY split ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
    sum(pos) OVER (PARTITION BY split ORDER BY p DESC) AS tp, sum(pos + neg) OVER (PARTITION BY split ORDER BY p DESC) AS shown FROM hist_p),
ranks AS (SELECT split, round(sum(neg * (above + pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
    round(sum(pos / (SELECT sum(h.pos) FROM hist_p h WHERE h.split = curve.split) * (tp / shown)), 6) AS pr_auc FROM curve GROUP BY split)"""


@case(
    "confusion",
    sql.risked(
        f"SELECT split, c AS probability_cutoff, tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, tp + tn + fp + fn AS row_count, {_RATIOS} FROM counted",
        _CUT,
    ),
)
def _confusion(spark, sf):
    out = metrics.cutoff_table(risks(spark, sf), ["split"], "y", "p", with_ranks=False)
    return rounded(out.drop("positive_rate", "log_loss", "brier_score"))


@case("roc_auc", sql.risked("SELECT split, roc_auc FROM ranks", _RANKS))
def _roc_auc(spark, sf):
    return rounded(metrics.rank_metrics(risks(spark, sf), ["split"], "y", "p").select("split", "roc_auc"))


@case("average_precision", sql.risked("SELECT split, pr_auc FROM ranks", _RANKS))
def _average_precision(spark, sf):
    return rounded(metrics.rank_metrics(risks(spark, sf), ["split"], "y", "p").select("split", "pr_auc"))


@case(
    "logloss_brier",
    sql.risked("SELECT DISTINCT split, positive_rate, log_loss, brier_score FROM counted", _CUT),
)
def _logloss_brier(spark, sf):
    losses = metrics.probability_losses("y", "p")
    return rounded(risks(spark, sf).groupBy("split").agg(*[c.alias(n) for n, c in losses.items()]))


@case(
    "cutoff_table",
    sql.risked(
        f"""SELECT split, c AS probability_cutoff, positive_rate, log_loss, brier_score, roc_auc, pr_auc, tp AS true_positives,
          fp AS false_positives, tn AS true_negatives, fn AS false_negatives, tp + tn + fp + fn AS row_count, {_RATIOS}
          FROM counted JOIN ranks USING (split)""",
        _CUT, _RANKS,
    ),
)
def _cutoff_table(spark, sf):
    return rounded(metrics.cutoff_table(risks(spark, sf), ["split"], "y", "p"))


@case(
    "pick_cutoff",
    sql.risked(
        f"""SELECT split, c AS probability_cutoff, recall >= 0.7 AS met_min_recall, recall AS validation_recall, f1 AS validation_f1
          FROM (SELECT split, c, {_RATIOS} FROM counted)
          QUALIFY row_number() OVER (PARTITION BY split ORDER BY recall >= 0.7 DESC, f1 DESC, recall DESC, c DESC) = 1""",
        _CUT,
    ),
)
def _pick_cutoff(spark, sf):
    cuts = metrics.cutoff_table(risks(spark, sf), ["split"], "y", "p", with_ranks=False)
    return rounded(metrics.pick_cutoff(cuts, ["split"]))


_BINS = """
edges AS (SELECT i, i * 0.1::DOUBLE AS lower, CASE i WHEN 9 THEN 1.0 ELSE (i + 1) * 0.1::DOUBLE END AS upper FROM range(10) r(i)),
binned AS (
  SELECT s.split, i, lower AS bin_lower, upper AS bin_upper, count(p) AS row_count,
    avg(p) AS mp, avg(y) AS my
  FROM (SELECT DISTINCT split FROM risk) s CROSS JOIN edges
  LEFT JOIN risk ON risk.split = s.split AND p >= lower AND (p < upper OR (i = 9 AND p <= 1))
  GROUP BY s.split, i, lower, upper
)"""


@case(
    "reliability_bins",
    sql.risked(
        """SELECT split, round(CAST(bin_lower AS DOUBLE), 6) AS bin_lower, round(CAST(bin_upper AS DOUBLE), 6) AS bin_upper, row_count,
         round(mp, 6) AS mean_predicted_probability, round(my, 6) AS actual_severe_delay_rate,
         round(abs(mp - my), 6) AS absolute_calibration_error FROM binned""",
        _BINS,
    ),
)
def _reliability_bins(spark, sf):
    return rounded(metrics.reliability_bins(risks(spark, sf), ["split"], "y", "p"))


@case(
    "ece",
    sql.risked(
        "SELECT split, round(sum(row_count * coalesce(abs(mp - my), 0)) / sum(row_count), 6) AS expected_calibration_error FROM binned GROUP BY split",
        _BINS,
    ),
)
def _ece(spark, sf):
    return rounded(metrics.expected_calibration_error(risks(spark, sf), ["split"], "y", "p"))


@case(
    "band_summary",
    sql.risked(
        """SELECT s.split, b AS risk_band, count(p) AS row_count, round(avg(y), 6) AS actual_severe_delay_rate,
         round(avg(p), 6) AS mean_predicted_probability
         FROM (SELECT DISTINCT split FROM risk) s CROSS JOIN (VALUES ('low'), ('medium'), ('high')) v(b)
         LEFT JOIN risk ON risk.split = s.split AND b = CASE WHEN p < 0.1 THEN 'low' WHEN p < 0.3 THEN 'medium' ELSE 'high' END
         GROUP BY s.split, b"""
    ),
)
def _band_summary(spark, sf):
    return rounded(metrics.band_summary(risks(spark, sf), ["split"], "y", "p"))


_METHODS = """
methods AS (
  SELECT 'uncalibrated' AS calibration_method, y, p FROM risk WHERE split = 'validation'
  UNION ALL SELECT 'sigmoid', y, round(p * 0.9 + 0.01, 6) FROM risk WHERE split = 'validation'
  UNION ALL SELECT 'isotonic', y, round(p * p, 6) FROM risk WHERE split = 'validation'
),
mh AS (SELECT calibration_method, p, sum(y) AS pos, count(*) AS n FROM methods GROUP BY ALL),
mc AS (SELECT *, sum(pos) OVER (PARTITION BY calibration_method ORDER BY p DESC) AS tp,
    sum(n) OVER (PARTITION BY calibration_method ORDER BY p DESC) AS shown FROM mh),
mr AS (SELECT calibration_method, sum(pos * (tp / shown)) / sum(pos) AS pr_auc FROM mc GROUP BY 1),
mb AS (SELECT calibration_method, sum(abs(sp - sy)) / sum(n) AS ece FROM (
    SELECT calibration_method, least(floor(p / 0.1::DOUBLE), 9) AS b, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM methods GROUP BY ALL) GROUP BY 1),
ms AS (SELECT calibration_method, avg((p - y) * (p - y)) AS brier_score, any_value(ece) AS expected_calibration_error, any_value(pr_auc) AS pr_auc
  FROM methods JOIN mr USING (calibration_method) JOIN mb USING (calibration_method) GROUP BY 1)"""


@case(
    "pick_calibration",
    sql.risked(
        """SELECT calibration_method, round(brier_score, 6) AS brier_score FROM
         (SELECT * FROM (SELECT * FROM ms WHERE brier_score <= (SELECT min(brier_score) FROM ms) * 1.02)
          QUALIFY expected_calibration_error <= min(expected_calibration_error) OVER () * 1.02)
         QUALIFY pr_auc >= max(pr_auc) OVER () - greatest(1e-12, abs(max(pr_auc) OVER ()) * 0.02)
         ORDER BY list_position(['sigmoid', 'isotonic', 'uncalibrated'], calibration_method) LIMIT 1""",
        _METHODS,
    ),
)
def _pick_calibration(spark, sf):
    df = risks(spark, sf).where("split = 'validation'")
    long = df.select(
        "y",
        F.inline(
            F.array(
                F.struct(F.lit("uncalibrated").alias("calibration_method"), F.col("p")),
                F.struct(F.lit("sigmoid").alias("calibration_method"), F.round(F.col("p") * 0.9 + 0.01, 6).alias("p")),
                F.struct(F.lit("isotonic").alias("calibration_method"), F.round(F.col("p") * F.col("p"), 6).alias("p")),
            )
        ),
    )
    by = ["calibration_method"]
    long = durable(long)  # read for each of the metrics
    table_ = long.groupBy(*by).agg(metrics.probability_losses("y", "p")["brier_score"].alias("brier_score"))
    table_ = table_.join(metrics.rank_metrics(long, by, "y", "p"), by).join(
        metrics.expected_calibration_error(long, by, "y", "p"), by
    )
    best = metrics.pick_calibration(table_.withColumn("split", F.lit("validation")), ["split"])
    return rounded(best.select("calibration_method", "brier_score"))


_EXPERIMENTS = """
tried AS (
  SELECT split, mode, actual, unnest(['combined_fixed', 'combined_weighted', 'combined_log_target']) AS experiment,
    unnest([prediction, prediction * 1.001, prediction * 0.9]) AS prediction FROM pred
),
scores AS (
  SELECT experiment, avg(abs(prediction - actual)) AS mae, avg(abs(prediction - actual)) FILTER (WHERE actual >= 30) AS high,
    avg(abs(prediction - actual)) FILTER (WHERE mode = 'streetcar') AS cars
  FROM tried WHERE split = 'validation' GROUP BY 1
)"""


@case(
    "experiment_pick",
    sql.predicted(
        """SELECT experiment, round(mae, 6) AS mae, round(high, 6) AS high_delay_mae, round(cars, 6) AS streetcar_mae FROM scores
         WHERE mae <= (SELECT min(mae) FROM scores) * 1.01 ORDER BY high, cars LIMIT 1""",
        _EXPERIMENTS,
    ),
)
def _experiment_pick(spark, sf):
    df = predictions(spark, sf, []).select("split", "mode", "actual", "prediction")
    scaled = {"combined_fixed": 1.0, "combined_weighted": 1.001, "combined_log_target": 0.9}
    lines = [F.struct(F.lit(n).alias("experiment"), (F.col("prediction") * k).alias("prediction")) for n, k in scaled.items()]
    long = durable(rows.with_residuals(df.select("split", "mode", "actual", F.inline(F.array(*lines)))))
    best = metrics.pick_experiment(
        metrics.regression_metrics(long, ["experiment", "split"]),
        reports.high_delay(long, ["experiment", "split"]),
        metrics.regression_metrics(long, ["experiment", "split", "mode"]),
    )
    return rounded(best.select("experiment", "mae", "high_delay_mae", "streetcar_mae"))


# --- category audit -------------------------------------------------------------------------


def _sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _words(values) -> str:
    return "regexp_matches(lower(value), '\\b(" + "|".join(values) + ")\\b')"


_CURATED = _sql_list(audit.CURATED_INCIDENTS)
_AUDIT = f"""
cells AS (
  SELECT unnest(['mode', 'route', 'direction', 'incident', 'location']) AS col,
    unnest([mode, route, direction, incident, location]) AS cell FROM raw
),
cleaned AS (
  SELECT col, CASE WHEN lower({sql.squeeze('cell')}) IN ('', 'nan', 'none', 'null', 'unknown', 'n/a', 'na') THEN NULL
    ELSE {sql.squeeze('cell')} END AS value FROM cells
),
counts AS (SELECT col, value, count(*) AS n FROM cleaned GROUP BY ALL),
places AS (SELECT lower(value) AS lv, list(DISTINCT col) AS cols FROM counts WHERE value IS NOT NULL GROUP BY 1),
variants AS (SELECT * FROM (VALUES ('mechanical', 'mech'), ('mechanical', 'mechanical'), ('mechanical', 'mechanical delay'),
  ('general_delay', 'general'), ('general_delay', 'general delay'), ('general_delay', 'delay'),
  ('operations', 'operations'), ('operations', 'operation'), ('operations', 'operator'), ('operations', 'operations - operator')) v(g, variant)),
used AS (SELECT DISTINCT g, variant FROM variants JOIN counts ON col = 'incident' AND lower(value) = variant),
active AS (SELECT g, variant FROM used QUALIFY count(*) OVER (PARTITION BY g) >= 2),
judged AS (
  SELECT c.col, c.value, n, ({sql.norm_route('c.value')}) <> 'Unknown' AS rl, cols, g
  FROM counts c JOIN places ON lower(c.value) = lv LEFT JOIN active ON lower(c.value) = variant WHERE c.value IS NOT NULL
),
reasoned AS (
  SELECT col, value, n, list_filter(CASE col
    WHEN 'mode' THEN [CASE WHEN lower(value) NOT IN ('bus', 'streetcar') THEN 'unexpected mode value' END]
    WHEN 'direction' THEN [
      CASE WHEN value <> upper(value) AND upper(value) IN ('N','S','E','W','B','UNKNOWN') THEN 'lowercase direction variant should be normalized' END,
      CASE WHEN length(value) > 3 THEN 'longer than 3 characters' END,
      CASE WHEN regexp_matches(value, '[0-9]') THEN 'contains digits' END,
      CASE WHEN regexp_matches(lower(value), '{"|".join(audit.DIRECTION_POLLUTION)}') THEN 'contains incident or location word' END,
      CASE WHEN upper(value) NOT IN ('N','S','E','W','B','UNKNOWN') AND length(value) <= 3 AND value <> upper(value) THEN 'lowercase or mixed-case uncommon direction' END]
    WHEN 'route' THEN CASE WHEN rl THEN [] WHEN length(value) <= 8 AND NOT contains(value, ' ') AND NOT {_words(audit.LOCATION_WORDS)} AND NOT {_words(audit.INCIDENT_WORDS)} THEN ['not route-like'] ELSE [
      CASE WHEN length(value) > 8 THEN 'long route value' END, CASE WHEN contains(value, ' ') THEN 'many-word route value' END,
      CASE WHEN {_words(audit.LOCATION_WORDS)} THEN 'looks like a location or intersection' END,
      CASE WHEN {_words(audit.INCIDENT_WORDS)} THEN 'looks like an incident label' END] END
    WHEN 'incident' THEN CASE WHEN lower(value) IN {_CURATED} THEN [] ELSE [
      CASE WHEN rl THEN 'route-like incident value' END, CASE WHEN {_words(audit.LOCATION_WORDS)} THEN 'location-like incident value' END,
      CASE WHEN n <= 2 AND length(value) > 2 THEN 'extremely rare incident label' END,
      CASE WHEN g IS NOT NULL THEN 'possible fragmented incident label: ' || g END] END
    ELSE [CASE WHEN length(value) <= 2 THEN 'too short for a useful location' END, CASE WHEN rl THEN 'route-like location value' END,
      CASE WHEN {_words(audit.INCIDENT_WORDS)} THEN 'incident-like location value' END] END, lambda x: x IS NOT NULL) AS reasons,
    CASE WHEN col = 'mode' OR (col = 'incident' AND lower(value) IN {_CURATED}) THEN [] ELSE
      list_sort(list_distinct(list_filter(list_concat(cols, [CASE WHEN rl THEN 'route' END,
        CASE WHEN upper(value) IN ('N','S','E','W','B') THEN 'direction' END]), lambda x: x IS NOT NULL AND x <> col))) END AS fields
  FROM judged
),
audited AS (
  SELECT col, value, n, round(n * 100.0 / (SELECT count(*) FROM raw), 4) AS percent, len(reasons) > 0 OR len(fields) > 0 AS suspicious,
    array_to_string(reasons, '; ') AS reasons, array_to_string(fields, '; ') AS looks_like_fields FROM reasoned
)"""


@case(
    "audit_values",
    sql.with_ctes(sql.RAW, _AUDIT)
    + """SELECT col AS "column", value, n AS count, CAST(percent AS DOUBLE) AS percent, suspicious, reasons, looks_like_fields FROM audited""",
)
def _audit_values(spark, sf):
    return rounded(audit.audit_values(raw_incidents(spark, sf)))


@case(
    "suspicious_values",
    sql.with_ctes(sql.RAW, _AUDIT)
    + """SELECT col AS "column", value, n AS count, reasons, looks_like_fields FROM audited WHERE suspicious""",
)
def _suspicious_values(spark, sf):
    return audit.suspicious_values(raw_incidents(spark, sf)).drop("percent", "suspicious")


@case(
    "category_audit",
    sql.with_ctes(sql.RAW, _AUDIT)
    + """SELECT c.col AS "column", CAST(sum(c.n) AS BIGINT) AS total_rows,
       CAST(coalesce(sum(c.n) FILTER (WHERE c.value IS NULL), 0) AS BIGINT) AS missing_count, count(c.value) AS unique_count,
       (SELECT count(*) FROM audited a WHERE a.col = c.col AND suspicious) AS suspicious_values_count,
       (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM audited a WHERE a.col = c.col AND suspicious) AS suspicious_rows_count,
       CAST(round(coalesce(sum(c.n) FILTER (WHERE c.value IS NULL), 0) * 100.0 / sum(c.n), 4) AS DOUBLE) AS missing_percent
       FROM counts c GROUP BY c.col""",
)
def _category_audit(spark, sf):
    return rounded(audit.category_audit(raw_incidents(spark, sf)))


@case(
    "top_values",
    sql.with_ctes(sql.RAW, _AUDIT)
    + """SELECT col AS "column", value, n AS count, CAST(row_number() OVER w AS INTEGER) AS place,
       CAST(round(n * 100.0 / (SELECT count(*) FROM raw), 4) AS DOUBLE) AS percent FROM counts WHERE value IS NOT NULL
       WINDOW w AS (PARTITION BY col ORDER BY n DESC, value) QUALIFY row_number() OVER w <= 25""",
)
def _top_values(spark, sf):
    return rounded(audit.top_values(raw_incidents(spark, sf)))


@case(
    "suspicious_examples",
    sql.with_ctes(sql.RAW, _AUDIT)
    + """SELECT col AS "column", value, n AS count, CAST(row_number() OVER w AS INTEGER) AS place FROM audited WHERE suspicious
       WINDOW w AS (PARTITION BY col ORDER BY n DESC, value) QUALIFY row_number() OVER w <= 10""",
)
def _suspicious_examples(spark, sf):
    return audit.suspicious_examples(raw_incidents(spark, sf)).select("column", "value", "count", "place")


def _events_as_labels(spark, sf) -> DataFrame:
    """Incident spellings that split one meaning, spread over the events."""
    spellings = ["Mech", "MECHANICAL", "mechanical delay", "delay", "operator", "operations"]
    k = (F.col("event_id") % len(spellings)).cast("int")
    return table(spark, sf, "events").select(
        F.lit("bus").alias("mode"), F.col("user_id").cast("string").alias("route"), F.lit("N").alias("direction"),
        F.element_at(F.array(*[F.lit(s) for s in spellings]), k + 1).alias("incident"),
        F.col("event_type").alias("location"),
    )


@case(
    "fragment_groups",
    """SELECT DISTINCT CASE event_id % 6 WHEN 4 THEN 'operations' WHEN 5 THEN 'operations' ELSE 'mechanical' END AS fragment_group,
      CASE event_id % 6 WHEN 0 THEN 'mech' WHEN 1 THEN 'mechanical' WHEN 2 THEN 'mechanical delay' WHEN 4 THEN 'operator'
        ELSE 'operations' END AS variant FROM events WHERE event_id % 6 <> 3""",
)
def _fragment_groups(spark, sf):
    return audit.active_fragment_groups(audit.value_counts(_events_as_labels(spark, sf)))


# --- support of candidate groupings ---------------------------------------------------------

_EVAL = "split IN ('validation', 'test')"
_SUPPORTED = "supported AS (SELECT unnest([%s]) AS \"grouping\", unnest([%s]) AS prior_count FROM (SELECT split, %s FROM model) WHERE %s)" % (
    ", ".join("'" + " + ".join(g) + "'" for g in support.SUPPORT_GROUPINGS),
    ", ".join(f"n{i}" for i in range(len(support.SUPPORT_GROUPINGS))),
    ", ".join(f"count(*) {sql.over(', '.join(g))} AS n{i}" for i, g in enumerate(support.SUPPORT_GROUPINGS)),
    _EVAL,
)


@case(
    "support_by_group",
    sql.modeled(
        """SELECT "grouping", count(*) AS row_count, """
        + ", ".join(
            f"round(count(*) FILTER (WHERE prior_count >= {n}) / count(*) * 100, 6) AS pct_with_prior_{n}"
            for n in (1, 5, 20, 50)
        )
        + """, max(prior_count) AS max_prior_count, CAST(quantile_cont(prior_count, 0.5) AS DOUBLE) AS median_prior_count,
           CAST(quantile_cont(prior_count, 0.25) AS DOUBLE) AS p25_prior_count,
           CAST(quantile_cont(prior_count, 0.75) AS DOUBLE) AS p75_prior_count FROM supported GROUP BY 1""",
        _SUPPORTED,
    ),
)
def _support_by_group(spark, sf):
    return rounded(support.support_by_grouping(modeled_incidents(spark, sf)))


_CANDIDATES = support.CANDIDATE_GROUPINGS


@case(
    "candidate_scores",
    sql.modeled(
        """SELECT feature_name, "grouping", count(*) AS row_count, round(count(own) / count(*) * 100, 6) AS coverage_percent,
         round(avg(abs(own - min_delay)), 6) AS mae_where_available, round(avg(abs(filled - min_delay)), 6) AS fallback_mae
         FROM (SELECT min_delay, feature_name, "grouping", own, coalesce(own, fr, fm, fg) AS filled FROM candidate) GROUP BY ALL""",
        "candidate AS (SELECT min_delay, fr, fm, fg, unnest([%s]) AS feature_name, unnest([%s]) AS \"grouping\", unnest([%s]) AS own FROM (SELECT split, min_delay, avg(min_delay) %s AS fr, avg(min_delay) %s AS fm, avg(min_delay) %s AS fg, %s FROM model) WHERE %s)"
        % (
            ", ".join(f"'{n}'" for n in _CANDIDATES),
            ", ".join("'" + " + ".join(g) + "'" for g in _CANDIDATES.values()),
            ", ".join(f"c{i}" for i in range(len(_CANDIDATES))),
            sql.over("route"), sql.over("mode"), sql.over(""),
            ", ".join(f"avg(min_delay) {sql.over(', '.join(g))} AS c{i}" for i, g in enumerate(_CANDIDATES.values())),
            _EVAL,
        ),
    ),
)
def _candidate_scores(spark, sf):
    return rounded(support.candidate_scores(modeled_incidents(spark, sf)))


_ROLLING = [
    ("prior_route_30d_mean_delay", "route", "route", None),
    ("prior_incident_30d_mean_delay", "incident", "incident", None),
    ("prior_route_hour_30d_mean_delay", "route + hour", "route, hour", None),
    ("prior_route_30d_severe_rate_30", "route", "route", 30),
    ("prior_incident_30d_severe_rate_30", "incident", "incident", 30),
    ("prior_route_30d_severe_rate_60", "route", "route", 60),
    ("prior_incident_30d_severe_rate_60", "incident", "incident", 60),
]


@case(
    "rolling_opportunity",
    sql.modeled(
        " UNION ALL ".join(
            f"""SELECT '{name}' AS feature_name, '{"rolling_rate" if t else "rolling_mean"}' AS feature_type,
              '{label}' AS "grouping", '{f"severe_{t}" if t else "regression"}' AS target,
              round(count(v{i}) / count(*) * 100, 6) AS coverage_percent,
              round(count(*) FILTER (WHERE v{i} IS NULL) / count(*) * 100, 6) AS missing_fallback_rate,
              {"CAST(NULL AS DOUBLE)" if t else f"round(avg(abs(v{i} - min_delay)), 6)"} AS mae_where_available,
              {f"round(avg((v{i} - CAST(min_delay >= {t} AS INTEGER)) ** 2), 6)" if t else "CAST(NULL AS DOUBLE)"}
                AS brier_score_where_available FROM rolled WHERE {_EVAL}"""
            for i, (name, label, keys, t) in enumerate(_ROLLING)
        ),
        "rolled AS (SELECT split, min_delay, "
        + ", ".join(
            f"avg({f'CAST(min_delay >= {t} AS INTEGER)' if t else 'min_delay'}) {sql.over(keys, sql.recent(30))} AS v{i}"
            for i, (_, _, keys, t) in enumerate(_ROLLING)
        )
        + " FROM model)",
    ),
)
def _rolling_opportunity(spark, sf):
    return rounded(support.rolling_opportunity(modeled_incidents(spark, sf)))


# --- transit feed ---------------------------------------------------------------------------

_FEED = f"""
routes AS (
  SELECT 'r' || s_suppkey AS route_id, CASE s_suppkey % 5 WHEN 0 THEN s_suppkey || 'a' WHEN 4 THEN 'Blue Line' ELSE CAST(s_suppkey AS VARCHAR) END AS short,
    CASE WHEN s_suppkey % 11 = 0 THEN 'Deep Line' ELSE s_name END AS long, CASE s_suppkey % 3 WHEN 0 THEN '0' WHEN 1 THEN '3' ELSE CASE WHEN s_suppkey % 2 = 0 THEN '3' ELSE '1' END END AS kind
  FROM supplier
),
surface AS (
  SELECT route_id, ({sql.norm_route('short')}) AS route, CASE kind WHEN '3' THEN 'bus' ELSE 'streetcar' END AS mode,
    ({sql.norm_route('short')}) || ' - ' || long AS label
  FROM routes WHERE kind IN ('0', '3') AND ({sql.norm_route('short')}) <> 'Unknown' AND NOT ends_with(upper(long), ' LINE')
),
trips AS (SELECT 'r' || (o_custkey % (SELECT count(*) FROM supplier)) AS route_id, 't' || o_orderkey AS trip_id FROM orders),
stop_times AS (SELECT 't' || l_orderkey AS trip_id, 's' || l_partkey AS stop_id,
  CASE WHEN l_linenumber = 5 THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS seq FROM lineitem),
stops AS (SELECT 's' || p_partkey AS stop_id, p_name || ' St' AS stop_name, 43.0 + (p_partkey % 97) / 100.0 AS lat,
  -79.0 - (p_partkey % 89) / 100.0 AS lon FROM part),
visits AS (SELECT route, trip_id, stop_id, seq FROM stop_times JOIN trips USING (trip_id) JOIN surface USING (route_id)),
ends AS (
  SELECT trip_id, route, arg_min(stop_id, (CAST(seq AS BIGINT), stop_id)) AS first_stop, arg_min(stop_id, (-CAST(seq AS BIGINT), stop_id)) AS last_stop
  FROM visits WHERE seq <> 'x' GROUP BY ALL HAVING first_stop <> last_stop
),
listed AS (SELECT route, ({sql.norm_location('stop_name')}) AS location, min(stop_name) AS label FROM visits JOIN stops USING (stop_id) GROUP BY 1, 2),
moved AS (
  SELECT DISTINCT route, (b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)) AS x, b.lat - a.lat AS y
  FROM ends JOIN stops a ON first_stop = a.stop_id JOIN stops b ON last_stop = b.stop_id WHERE a.lat <> b.lat OR a.lon <> b.lon
),
ways AS (SELECT DISTINCT route, CASE WHEN abs(x) >= abs(y) THEN CASE WHEN x > 0 THEN 'E' ELSE 'W' END WHEN y > 0 THEN 'N' ELSE 'S' END AS d FROM moved),
directions AS (SELECT route, list_sort(list(d)) AS ds FROM ways GROUP BY route)"""


def feed_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A transit feed out of the given tables: routes, trips, stop times and stops."""
    supplier, key = table(spark, sf, "supplier"), F.col("s_suppkey")
    part, p = table(spark, sf, "part"), F.col("p_partkey")
    number = key.cast("string")
    routes = supplier.select(
        F.concat(F.lit("r"), number).alias("route_id"),
        F.when(key % 5 == 0, F.concat(number, F.lit("a"))).when(key % 5 == 4, "Blue Line").otherwise(number).alias("route_short_name"),
        F.when(key % 11 == 0, "Deep Line").otherwise(F.col("s_name")).alias("route_long_name"),
        F.when(key % 3 == 0, "0").when(key % 3 == 1, "3").when(key % 2 == 0, "3").otherwise("1").alias("route_type"),
    )
    size = supplier.agg(F.count(F.lit(1))).scalar()
    trips = table(spark, sf, "orders").select(
        F.concat(F.lit("r"), (F.col("o_custkey") % size).cast("string")).alias("route_id"),
        F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("trip_id"),
    )
    stop_times = table(spark, sf, "lineitem").select(
        F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("trip_id"),
        F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("stop_id"),
        F.when(F.col("l_linenumber") == 5, "x").otherwise(F.col("l_linenumber").cast("string")).alias("stop_sequence"),
    )
    stops = part.select(
        F.concat(F.lit("s"), p.cast("string")).alias("stop_id"),
        F.concat("p_name", F.lit(" St")).alias("stop_name"),
        (F.lit(43.0) + (p % 97) / 100.0).cast("string").alias("stop_lat"),
        (F.lit(-79.0) - (p % 89) / 100.0).cast("string").alias("stop_lon"),
    )
    return {"routes": routes, "trips": trips, "stop_times": stop_times, "stops": stops}


@case(
    "feed_routes",
    sql.with_ctes(_FEED) + "SELECT route, arg_max(label, route_id) AS label, arg_max(mode, route_id) AS mode FROM surface GROUP BY route",
)
def _feed_routes(spark, sf):
    return feed.route_options(feed.feed_routes(feed_tables(spark, sf)["routes"]))


@case("trip_endpoints", sql.with_ctes(_FEED) + "SELECT trip_id, route, first_stop, last_stop FROM ends")
def _trip_endpoints(spark, sf):
    t = feed_tables(spark, sf)
    return feed.trip_endpoints(feed.feed_routes(t["routes"]), t["trips"], t["stop_times"])


@case("route_stops", sql.with_ctes(_FEED) + "SELECT route, location, label FROM listed")
def _route_stops(spark, sf):
    t = feed_tables(spark, sf)
    return feed.ordered_stops(feed.route_stops(feed.feed_routes(t["routes"]), t["trips"], t["stop_times"], t["stops"]))


@case(
    "route_directions",
    sql.with_ctes(_FEED)
    + "SELECT route, array_to_string(list_filter(['N', 'E', 'S', 'W'], lambda x: list_contains(ds, x)), ',') AS directions FROM directions",
)
def _route_directions(spark, sf):
    index = feed.route_index(**feed_tables(spark, sf))
    return index.directions.select("route", F.array_join("directions", ",").alias("directions"))


_ROUTE_REQUESTS = f"""
asked AS (
  SELECT l_orderkey AS request_id, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey || 'B' ELSE CAST(l_suppkey AS VARCHAR) END AS route,
    p_name || ' St' AS location FROM lineitem JOIN part ON l_partkey = p_partkey
),
resolved AS (
  SELECT request_id, route AS asked_route, ({sql.norm_location('location')}) AS location,
    CASE WHEN route IN (SELECT route FROM listed) THEN route
      WHEN regexp_extract(route, '^([0-9]+)[A-Z]+$', 1) IN (SELECT route FROM listed) THEN regexp_extract(route, '^([0-9]+)[A-Z]+$', 1) END AS listed_route,
    CASE WHEN route IN (SELECT route FROM directions) THEN route
      WHEN regexp_extract(route, '^([0-9]+)[A-Z]+$', 1) IN (SELECT route FROM directions) THEN regexp_extract(route, '^([0-9]+)[A-Z]+$', 1) END AS way_route
  FROM asked
)"""


def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    key = F.col("l_suppkey").cast("string")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("request_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(key, F.lit("B"))).otherwise(key).alias("route"),
        F.concat("p_name", F.lit(" St")).alias("location"),
    )


@case(
    "validate_route_location",
    sql.with_ctes(_FEED, _ROUTE_REQUESTS)
    + """SELECT request_id, asked_route AS route, coalesce(listed_route, asked_route) AS matched_route, r.location AS normalized_location,
       label AS route_location_label, label IS NOT NULL AS accepted_for_prediction,
       CASE WHEN listed_route IS NULL THEN 'Route ' || asked_route || ' was not found in the route-stop index.'
         WHEN label IS NULL THEN 'Location ''' || r.location || ''' is not a stop on route ' || listed_route || '. Choose a location from the selected route stop list.'
         WHEN listed_route <> asked_route THEN 'Using base route ' || listed_route || ' stop list for branch route ' || asked_route || '.' END AS warning
       FROM resolved r LEFT JOIN listed l ON l.route = listed_route AND l.location = r.location""",
)
def _validate_route_location(spark, sf):
    index = feed.route_index(**feed_tables(spark, sf))
    out = feed.validate_route_locations(route_requests(spark, sf), index)
    return out.drop("location", "route_location")


@case(
    "resolve_routes",
    sql.with_ctes(_FEED, _ROUTE_REQUESTS)
    + """, options AS (SELECT route, arg_max(mode, route_id) AS mode FROM surface WHERE route IN (SELECT route FROM listed) GROUP BY route)
       SELECT request_id, asked_route AS route,
       coalesce((SELECT mode FROM options o WHERE o.route = asked_route), (SELECT mode FROM options o WHERE o.route = regexp_extract(asked_route, '^([0-9]+)[A-Z]+$', 1))) AS route_mode,
       coalesce(array_to_string(list_filter(['N', 'E', 'S', 'W'], lambda x: list_contains(ds, x)), ',') || CASE WHEN len(ds) >= 2 THEN ',B' ELSE '' END, '') AS direction_options,
       CASE WHEN way_route IS NULL THEN 'Route ' || asked_route || ' directions were not found in the route index.'
         WHEN way_route <> asked_route THEN 'Using base route ' || way_route || ' direction list for branch route ' || asked_route || '.' END AS direction_warning
       FROM resolved LEFT JOIN directions d ON d.route = way_route""",
)
def _resolve_routes(spark, sf):
    index = feed.route_index(**feed_tables(spark, sf))
    out = feed.resolve_routes(route_requests(spark, sf), index)
    return out.select(
        "request_id", "route", "route_mode", F.array_join("direction_options", ",").alias("direction_options"),
        "direction_warning",
    )


# --- requests -------------------------------------------------------------------------------


@case(
    "known_categories",
    sql.modeled(
        """SELECT DISTINCT unnest(['mode', 'route', 'direction', 'incident', 'location']) AS field,
         unnest([mode, route, direction, incident, location]) AS value FROM model WHERE split = 'train'"""
    ),
)
def _known_categories(spark, sf):
    return requests.known_categories(modeled_incidents(spark, sf).where("split = 'train'"))


@case(
    "option_catalogue",
    sql.with_ctes(sql.RAW)
    + f"""SELECT field, option, dropped_values FROM (
        SELECT 'route' AS field, value, nullif({sql.norm_route('value')}, 'Unknown') AS option FROM (SELECT DISTINCT trim(route) AS value FROM raw)
        UNION ALL SELECT 'location', value, nullif({sql.norm_location('value')}, 'Unknown') FROM (SELECT DISTINCT trim(location) AS value FROM raw)
      ) JOIN (SELECT 'route' AS field, count(*) - count(DISTINCT nullif({sql.norm_route('value')}, 'Unknown')) AS dropped_values FROM (SELECT DISTINCT trim(route) AS value FROM raw)
        UNION ALL SELECT 'location', count(*) - count(DISTINCT nullif({sql.norm_location('value')}, 'Unknown')) FROM (SELECT DISTINCT trim(location) AS value FROM raw)) USING (field)
      WHERE option IS NOT NULL GROUP BY ALL""",
)
def _option_catalogue(spark, sf):
    return requests.option_catalogue(requests.known_categories(raw_incidents(spark, sf)))


@case(
    "validate_incidents",
    sql.modeled(
        """SELECT request_id, r.mode, r.route, r.direction, r.incident, r.location,
         array_to_string(list_filter([
           CASE WHEN r.route <> 'Unknown' AND r.route NOT IN (SELECT route FROM model WHERE split = 'train') THEN 'Route ''' || r.route || ''' was not seen in the known category list.' END,
           CASE WHEN r.direction = 'Unknown' THEN 'Direction is missing or unsupported and was set to Unknown.' END,
           CASE WHEN r.direction <> 'Unknown' AND r.direction NOT IN (SELECT direction FROM model WHERE split = 'train') THEN 'Direction ''' || r.direction || ''' was not seen in the known category list.' END,
           CASE WHEN r.incident = 'Unknown' THEN 'Incident is missing and was set to Unknown.' END,
           CASE WHEN r.incident <> 'Unknown' AND r.incident NOT IN (SELECT incident FROM model WHERE split = 'train') THEN 'Incident ''' || r.incident || ''' was not seen in the known category list.' END,
           CASE WHEN r.location = 'Unknown' THEN 'Location is missing and was set to Unknown.' END,
           CASE WHEN r.location <> 'Unknown' AND r.location NOT IN (SELECT location FROM model WHERE split = 'train') THEN 'Location ''' || r.location || ''' was not seen in the known category list.' END], lambda x: x IS NOT NULL), ' | ') AS warnings
         FROM request r""",
        _ASKED,
    ),
)
def _validate_incidents(spark, sf):
    known = requests.known_categories(modeled_incidents(spark, sf).where("split = 'train'"))
    out = requests.validate_requests(order_requests(spark, sf).drop("ts"), known)
    return out.withColumn("warnings", F.array_join("validation_warnings", " | ")).drop("validation_warnings")


@case(
    "fuzzy_location",
    sql.with_ctes(sql.RAW, sql.NORM)
    + """, known AS (SELECT DISTINCT location, lower(trim(regexp_replace(regexp_replace(location, '[^A-Za-z0-9&@/ ]', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM norm WHERE location <> 'Unknown'),
       asked AS (SELECT DISTINCT s_name || ' ' || p_name AS location, lower(regexp_replace(s_name, '[^A-Za-z0-9]', ' ', 'g') || ' ' || p_name) AS t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
          UNION SELECT DISTINCT p_name || ' st west', p_name || ' street west' FROM part UNION SELECT DISTINCT p_name || ' at queen', p_name || ' at queen' FROM part),
       pairs AS (SELECT a.location AS asked, k.location, string_split(a.t, ' ') AS x, string_split(k.t, ' ') AS y, a.t AS s, k.t AS o FROM asked a, known k),
       scored AS (SELECT *, CASE WHEN s = o THEN 100.0 WHEN contains(o, s) OR contains(s, o) THEN greatest(80.0, 100.0 * least(length(s), length(o)) / greatest(length(s), length(o)))
         WHEN len(list_filter(x, lambda w: w NOT IN ('and', 'at', 'the', 'of') AND NOT list_contains(y, w))) = 0 THEN 85.0
         ELSE 200.0 * len(list_intersect(x, y)) / (len(list_distinct(x)) + len(list_distinct(y))) END AS score FROM pairs)
       SELECT asked AS location, CASE WHEN score > 0 THEN location END AS matched_location, CAST(round(score, 1) AS DOUBLE) AS score,
         CASE WHEN score = 100 THEN 'exact' WHEN score >= 75 THEN 'fuzzy' ELSE 'none' END AS match_type, score >= 90 AS accepted_for_prediction
       FROM scored QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, lower(location), location) = 1""",
)
def _fuzzy_location(spark, sf):
    known = modeled_incidents(spark, sf).where("location != 'Unknown'").select("location")
    line, supplier, part = (table(spark, sf, n) for n in ("lineitem", "supplier", "part"))
    joined = (
        line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat("s_name", F.lit(" "), "p_name").alias("location"))
    )
    asked = joined.union(part.select(F.concat("p_name", F.lit(" st west")))).union(
        part.select(F.concat("p_name", F.lit(" at queen")))
    )
    out = match.match_locations(asked.distinct(), known)
    return out.select("location", "matched_location", "score", "match_type", "accepted_for_prediction")


# --- models (rows only: fits differ between engines) ----------------------------------------

# Few, shallow trees: what these queries check is the job, over whole tables.
QUICK = models.TreeConfig(rounds=3, depth=3)
_ARTIFACTS: dict[tuple[str, str], models.Artifact] = {}


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents with what models and their reports read of them; the tables between are deleted here."""
    df = modeled_incidents(spark, sf).select("ts", *CATEGORICAL_FEATURES, "min_delay", "split")
    with scratch_tables(spark):
        return durable(history.add_history_features(with_time(df)), outer=True)


def artifact(spark: SparkSession, sf: str, made: DataFrame | None = None) -> models.Artifact:
    """The models of the whole table, which a query that has ``made`` it hands over."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ARTIFACTS:
        df = model_table(spark, sf) if made is None else made
        train = df.where("split = 'train'")
        risk = models.run_calibration(df, "1999-01-01", "2000-01-01", QUICK).risks
        delay = models.fit_regressor(train, QUICK, log_target=True)
        _ARTIFACTS[key] = models.Artifact(delay, risk, feature_projection(df.columns)[0])
    return _ARTIFACTS[key]


def _fit_case(name: str, fit):
    @case(name)
    def _query(spark, sf):
        df = model_table(spark, sf)
        model = fit(df.where("split = 'train'"))
        scored = models.predict(model, df.where("split in ('validation', 'test')"))
        return metrics.regression_metrics(scored, ["split", "mode"], "min_delay")


_fit_case("gbt_delay", lambda train: models.fit_regressor(train, QUICK))
_fit_case("weighted_delay", lambda train: models.fit_regressor(train, QUICK, weighted=True))
# The whole fits: 400 rounds of depth 6, and of depth 5 for the classifiers.
_fit_case("log_target", lambda train: models.fit_regressor(train, log_target=True))
_fit_case("mode_specific", lambda train: models.fit_mode_models(train))


@case("experiments")
def _experiments(spark, sf):
    return models.run_experiments(model_table(spark, sf), QUICK).selected


@case("risk_calibrated")
def _risk_calibrated(spark, sf):
    return models.run_calibration(model_table(spark, sf), "1999-01-01", "2000-01-01").metrics


@case("two_output_predictions")
def _two_output(spark, sf):
    df = model_table(spark, sf)
    return models.two_output_frame(df.where("split IN ('validation', 'test')"), artifact(spark, sf, df))


@case("permutation_importance")
def _permutation(spark, sf):
    key = ["ts", "mode", "route", "direction", "incident", "location", "min_delay"]
    df = model_table(spark, sf)
    return explain.explain(df, artifact(spark, sf, df), key)[0]


_ENCODED = ["mode", "route", "direction", "incident"]


@case(
    "preprocess_matrix",
    sql.modeled(
        "SELECT split, "
        + ", ".join(
            f"coalesce(d_{c}.nr, (SELECT count(*) FROM words_{c})) AS i_{c}" for c in _ENCODED
        )
        + ", count(*) AS row_count FROM model "
        + " ".join(f"LEFT JOIN words_{c} AS d_{c} ON d_{c}.value = coalesce(model.{c}, 'Unknown')" for c in _ENCODED)
        + " WHERE split <> 'train' GROUP BY ALL",
        *[
            f"words_{c} AS (SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS nr FROM (SELECT coalesce({c}, 'Unknown') AS value, count(*) AS n FROM model WHERE split = 'train' GROUP BY 1))"
            for c in _ENCODED
        ],
    ),
)
def _preprocess_matrix(spark, sf):
    """Numbers of all categories, learned from the training rows; unseen ones share the last."""
    df = durable(modeled_incidents(spark, sf).select("split", *_ENCODED))
    words = encoding.category_dictionary(df.where("split = 'train'"), _ENCODED)
    out = encoding.encoded(df.where("split <> 'train'"), words, _ENCODED)
    return out.groupBy("split", *[f"i_{c}" for c in _ENCODED]).agg(F.count("*").alias("row_count"))


_PERMUTED = ["mode", "route", "incident"]


@case(
    "permuted_multiset",
    sql.modeled(
        """SELECT feature, CAST(repeat AS INTEGER) AS repeat, CASE feature WHEN 'mode' THEN mode WHEN 'route' THEN route ELSE incident END AS value,
           count(*) AS row_count, CAST(sum(min_delay) AS DOUBLE) >= 0 AS summed
           FROM model, (SELECT unnest(['mode', 'route', 'incident']) AS feature), range(2) AS r(repeat)
           WHERE split = 'validation' GROUP BY 1, 2, 3""",
    ),
)
def _permuted_multiset(spark, sf):
    """Each column keeps its values, whatever rows they come to."""
    rows = modeled_incidents(spark, sf).where("split = 'validation'").select(*_PERMUTED, "min_delay")
    value = F.coalesce(*[F.when(F.col("feature") == f, F.col(f)) for f in _PERMUTED])
    return explain.permuted_copies(rows, _PERMUTED, repeats=2).groupBy("feature", "repeat", value.alias("value")).agg(
        F.count("*").alias("row_count"), (F.sum("min_delay") >= 0).alias("summed")
    )


@case(
    "attached_predictions",
    """WITH rows AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'validation' END AS split FROM orders),
       placed AS (SELECT *, row_number() OVER (ORDER BY split, o_orderkey) AS place FROM rows),
       others AS (SELECT o_totalprice * 2 AS prediction, row_number() OVER (ORDER BY split, o_totalprice, o_orderkey) AS place FROM rows)
       SELECT o_orderkey, split, round(prediction, 4) AS prediction, round(prediction - o_totalprice, 4) AS error FROM placed JOIN others USING (place)""",
)
def _attached(spark, sf):
    split = F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("validation")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), split.alias("split"))
    outside = rows.withColumn("prediction", F.col("o_totalprice") * 2)
    out = positions.attach_predictions(rows, outside, ["split", "o_orderkey"], ["split", "o_totalprice", "o_orderkey"])
    return rounded(out.select("o_orderkey", "split", "prediction", (F.col("prediction") - F.col("o_totalprice")).alias("error")), 4)


@case(
    "request_times",
    """WITH asked AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE)::VARCHAR || 'T08:15:00'
         WHEN 1 THEN ' ' || CAST(o_orderdate AS DATE)::VARCHAR || ' 23:59:59 ' WHEN 2 THEN CAST(o_orderdate AS DATE)::VARCHAR ELSE 'soon ' || o_orderkey END AS asked FROM orders)
       SELECT request_id, strftime(TRY_CAST(trim(asked) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts,
         CASE WHEN TRY_CAST(trim(asked) AS TIMESTAMP) IS NULL THEN 'Invalid timestamp ' || chr(39) || asked || chr(39) || '. Provide an ISO-like datetime string.' END AS error FROM asked""",
)
def _request_times(spark, sf):
    day = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    asked = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(day, F.lit("T08:15:00")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" "), day, F.lit(" 23:59:59 ")))
        .when(F.col("o_orderkey") % 4 == 2, day).otherwise(F.concat(F.lit("soon "), F.col("o_orderkey").cast("string")))
    )
    ts, error = calendar.request_timestamp(F.col("asked"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), asked.alias("asked"))
    return rows.select("request_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("ts"), error.alias("error"))


@case("representative_examples")
def _examples(spark, sf):
    df = model_table(spark, sf)
    frame = models.two_output_frame(df.where("split = 'validation'"), artifact(spark, sf, df))
    return explain.representative_examples(frame, ["route", "incident"])


@case("sampled")
def _sampled(spark, sf):
    key = ["ts", "mode", "route", "direction", "incident", "location", "min_delay"]
    return explain.deterministic_sample(modeled_incidents(spark, sf), key)


@case("scored_incidents")
def _scored_incidents(spark, sf):
    known = requests.known_categories(modeled_incidents(spark, sf).where("split = 'train'"))
    return score.score_incidents(
        order_requests(spark, sf), _past_model(spark, sf), artifact(spark, sf), known, history_is_normalized=True
    )


# Registers its queries; it uses this module's helpers, so it comes last.
from checks import files as _files  # noqa: E402,F401
