"""Building blocks of the checking SQL (written for DuckDB, independent of the library)."""

from __future__ import annotations

RAW = """
raw AS (
  SELECT date_trunc('day', l_shipdate) + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS ts,
    CASE WHEN l_linestatus = 'O' THEN ' Bus ' ELSE 'streetcar' END AS mode,
    CASE l_linenumber % 4 WHEN 0 THEN l_suppkey || '.0' WHEN 1 THEN '  ' || l_suppkey || ' '
      WHEN 2 THEN l_suppkey || 'a' ELSE CAST(l_suppkey AS VARCHAR) END AS route,
    CASE l_linenumber WHEN 1 THEN 'N/B' WHEN 2 THEN 'eb' WHEN 3 THEN 'South' WHEN 4 THEN 'W/B/E/B'
      WHEN 5 THEN 'Mechanical' WHEN 7 THEN 'Bothways' END AS direction,
    CASE l_partkey % 12 WHEN 0 THEN 'Mech' WHEN 1 THEN 'Ops' WHEN 2 THEN 'Securitty' WHEN 3 THEN 'delay'
      WHEN 4 THEN 'Late Garage' WHEN 5 THEN 'Rail/Switches' WHEN 6 THEN 'EMS' WHEN 7 THEN 'clean-up'
      WHEN 8 THEN 'Fallen pole' WHEN 10 THEN 'Overhead wire' WHEN 11 THEN 'Diversion' END AS incident,
    CASE l_suppkey % 5 WHEN 0 THEN p_name || ' Stn' WHEN 1 THEN 'Queen & ' || p_name
      WHEN 2 THEN p_name || ' St W' WHEN 3 THEN 'n/a' ELSE p_name || '.' END AS location,
    CAST(floor(l_quantity * l_quantity / 10) AS DOUBLE) AS min_delay,
    l_tax AS min_gap, CAST(l_suppkey AS VARCHAR) AS vehicle
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
)"""


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def category_text(x: str) -> str:
    s = squeeze(x)
    return (
        f"CASE WHEN lower({s}) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '<na>', 'unknown', 'unk') "
        f"THEN NULL ELSE {s} END"
    )


def norm_mode(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ('bus', 'streetcar') THEN lower(trim({x})) ELSE 'Unknown' END"


def norm_route(x: str) -> str:
    t = f"({category_text(x)})"
    return (
        f"CASE WHEN {t} IS NULL THEN 'Unknown' "
        f"WHEN regexp_full_match({t}, '[0-9]+(\\.0+)?') "
        f"THEN regexp_replace(regexp_replace({t}, '\\.0+$', ''), '^0+([0-9])', '\\1') "
        f"WHEN regexp_full_match(replace(upper({t}), ' ', ''), '[0-9]{{1,4}}[A-Z]{{0,2}}|RAD') "
        f"THEN replace(upper({t}), ' ', '') ELSE 'Unknown' END"
    )


def norm_direction(x: str) -> str:
    t = f"regexp_replace(upper({category_text(x)}), '[^A-Z]', '', 'g')"
    flags = " + ".join(f"CAST(contains({t}, '{c}') AS INTEGER)" for c in "NESW")
    return (
        f"CASE WHEN {t} IS NULL THEN 'Unknown' "
        f"WHEN {t} IN ('N','NB','NORTH','NBOUND','NORTHBOUND') THEN 'N' "
        f"WHEN {t} IN ('E','EB','EAST','EBOUND','EASTBOUND') THEN 'E' "
        f"WHEN {t} IN ('S','SB','SOUTH','SBOUND','SOUTHBOUND') THEN 'S' "
        f"WHEN {t} IN ('W','WB','WEST','WBOUND','WESTBOUND') THEN 'W' "
        f"WHEN {t} IN ('B','BW','BOTH','BOTHWAYS','BOTHWAY','BIDIRECTIONAL','BIDIR','MIXED','WBE','WBEB',"
        f"'EBWB','NBSB','SBNB') THEN 'B' "
        f"WHEN regexp_full_match({t}, '[NESWB]*') AND {flags} >= 2 THEN 'B' ELSE 'Unknown' END"
    )


INCIDENT_ANSWERS = {
    "Mech": "Mechanical", "Ops": "Operations", "Securitty": "Security", "delay": "General Delay",
    "Late Garage": "Late Leaving Garage", "Rail/Switches": "Rail/Switches", "EMS": "Emergency Services",
    "clean-up": "Cleaning", "Fallen pole": "Other", "Overhead wire": "Overhead", "Diversion": "Diversion",
}


def norm_incident(x: str) -> str:
    """The expected category of each spelling that occurs in the adapter, written out."""
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INCIDENT_ANSWERS.items())
    return f"CASE {x} {arms} ELSE 'Unknown' END"


def norm_location(x: str) -> str:
    words = {
        "STN": "STATION", "STA": "STATION", "ST": "STREET", "AVE": "AVENUE", "RD": "ROAD", "BLVD": "BOULEVARD",
        "DR": "DRIVE", "CRES": "CRESCENT", "PKWY": "PARKWAY", "HWY": "HIGHWAY", "W": "WEST", "E": "EAST",
        "N": "NORTH", "S": "SOUTH",
    }
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items())
    up = squeeze(f"regexp_replace(upper({category_text(x)}), '[&@/]', ' AND ', 'g')")
    return (
        f"coalesce(array_to_string(list_transform(string_split({up}, ' '), "
        f"lambda w: CASE w {arms} ELSE w END), ' '), 'Unknown')"
    )


NORM = f"""
norm AS (
  SELECT ts, {norm_mode('mode')} AS mode, {norm_route('route')} AS route,
    {norm_direction('direction')} AS direction, {norm_incident('incident')} AS incident,
    {norm_location('location')} AS location, min_delay, min_gap, vehicle,
    route AS route_raw, direction AS direction_raw, incident AS incident_raw, location AS location_raw
  FROM raw
)"""

MODEL = """
model AS (
  SELECT *, CASE WHEN ts < TIMESTAMP '2000-01-01' THEN 'train' WHEN year(ts) = 2000 THEN 'validation'
    WHEN year(ts) = 2001 THEN 'test' END AS split, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(month(ts) AS INTEGER) AS month
  FROM norm WHERE ts IS NOT NULL AND min_delay BETWEEN 0 AND 240
)"""

BEFORE = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def recent(days: int) -> str:
    return f"RANGE BETWEEN INTERVAL {days} DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


def over(keys: str, frame: str = BEFORE) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"OVER ({part}ORDER BY ts {frame})"


HISTORY_SQL = {
    "prior_route_mean_delay": f"avg(min_delay) {over('route')}",
    "prior_route_hour_mean_delay": f"avg(min_delay) {over('route, hour')}",
    "prior_incident_mean_delay": f"avg(min_delay) {over('incident')}",
    "prior_mode_mean_delay": f"avg(min_delay) {over('mode')}",
    "prior_global_mean_delay": f"avg(min_delay) {over('')}",
    "prior_route_hour_7d_mean_delay": (
        f"coalesce(avg(min_delay) {over('route, hour', recent(7))}, avg(min_delay) {over('route')}, "
        f"avg(min_delay) {over('mode')}, avg(min_delay) {over('')})"
    ),
    "prior_route_incident_mean_delay": f"avg(min_delay) {over('route, incident')}",
    "prior_mode_incident_mean_delay": f"avg(min_delay) {over('mode, incident')}",
    "prior_route_direction_mean_delay": f"avg(min_delay) {over('route, direction')}",
    "prior_route_incident_count": f"count(*) {over('route, incident')}",
    "prior_route_30d_mean_delay": f"avg(min_delay) {over('route', recent(30))}",
    "prior_incident_30d_mean_delay": f"avg(min_delay) {over('incident', recent(30))}",
    "prior_route_30d_severe_rate_30": f"avg(CAST(min_delay >= 30 AS INTEGER)) {over('route', recent(30))}",
    "prior_incident_30d_severe_rate_30": f"avg(CAST(min_delay >= 30 AS INTEGER)) {over('incident', recent(30))}",
    "prior_route_30d_severe_rate_60": f"avg(CAST(min_delay >= 60 AS INTEGER)) {over('route', recent(30))}",
    "prior_incident_30d_severe_rate_60": f"avg(CAST(min_delay >= 60 AS INTEGER)) {over('incident', recent(30))}",
    "prior_location_mean_delay": f"avg(min_delay) {over('location')}",
    "prior_location_count": f"count(*) {over('location')}",
}


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def modeled(select: str, *more: str) -> str:
    return with_ctes(RAW, NORM, MODEL, *more) + select


def history_cte(names: list[str], source: str = "model") -> str:
    columns = ", ".join(f"{HISTORY_SQL[n]} AS {n}" for n in names)
    return f"hist AS (SELECT *, {columns} FROM {source})"


# Row-level predictions: the filled route-hour baseline; probabilities: recent severe rates.
PREDICTION_FEATURES = [
    "prior_route_hour_mean_delay", "prior_route_mean_delay", "prior_mode_mean_delay", "prior_global_mean_delay",
]
BUCKET = (
    "CASE WHEN min_delay <= 5 THEN '0-5' WHEN min_delay <= 10 THEN '6-10' WHEN min_delay <= 15 THEN '11-15' "
    "WHEN min_delay <= 30 THEN '16-30' WHEN min_delay <= 60 THEN '31-60' WHEN min_delay <= 120 THEN '61-120' "
    "WHEN min_delay <= 240 THEN '121-240' ELSE '241+' END"
)
PREDICTED = f"""
pred AS (
  SELECT *, min_delay AS actual, prediction - min_delay AS error, abs(prediction - min_delay) AS absolute_error,
    {BUCKET} AS delay_bucket
  FROM (SELECT *, coalesce(prior_route_hour_mean_delay, prior_route_mean_delay, prior_mode_mean_delay,
          prior_global_mean_delay) AS prediction FROM hist)
  WHERE split IN ('validation', 'test')
)"""


def predicted(select: str, *more: str, features: list[str] = PREDICTION_FEATURES) -> str:
    return with_ctes(RAW, NORM, MODEL, history_cte(features), PREDICTED, *more) + select


RISK_FEATURES = [
    "prior_route_30d_severe_rate_30", "prior_route_30d_severe_rate_60", "prior_incident_30d_severe_rate_30",
]
RISKED = """
risk AS (
  SELECT split, CAST(min_delay >= 30 AS INTEGER) AS y,
    round(coalesce(prior_route_30d_severe_rate_30, prior_incident_30d_severe_rate_30, 0), 6) AS p
  FROM hist WHERE split IN ('validation', 'test')
)"""


def risked(select: str, *more: str) -> str:
    return with_ctes(
        RAW, NORM, MODEL,
        history_cte(["prior_route_30d_severe_rate_30", "prior_incident_30d_severe_rate_30"]), RISKED, *more,
    ) + select


def fit_sql(actual: str = "actual", prediction: str = "prediction", digits: int = 6) -> str:
    both = f"FILTER (WHERE {actual} IS NOT NULL AND {prediction} IS NOT NULL)"
    e = f"({prediction} - {actual})"
    return (
        f"round(avg(abs({e})), {digits}) AS mae, round(sqrt(avg({e} * {e})), {digits}) AS rmse, "
        f"round(1 - sum({e} * {e}) / nullif(var_pop({actual}) {both} * count({actual}) {both}, 0), {digits}) AS r2"
    )
