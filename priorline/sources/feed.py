"""Transit-feed tables: scan, and the route tables derived from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline import messages
from priorline.contract import UNKNOWN
from priorline.functions.text import base_route, normalize_location, normalize_route, route_sort_keys
from priorline.messages import fill
from priorline.sources.files import CSV_DIALECT

# Columns read per feed table; everything is text until it is used.
FEED_COLUMNS = {
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["route_id", "trip_id"],
    "stop_times": ["trip_id", "stop_id", "stop_sequence"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
}
@dataclass(frozen=True)
class RouteIndex:
    """Route table, (route, stop) table and (route, directions) table."""

    routes: DataFrame
    stops: DataFrame
    directions: DataFrame


def read_feed_table(spark: SparkSession, directory: str, name: str, suffix: str = ".txt") -> DataFrame:
    """One header CSV of a feed; a byte-order mark before the first header is tolerated."""
    df = spark.read.options(**CSV_DIALECT).csv(f"{directory}/{name}{suffix}")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.select(
        *[F.trim(c).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in FEED_COLUMNS[name]]
    )


def feed_routes(routes: DataFrame) -> DataFrame:
    """Surface routes with normalized name, label and mode; underground lines are dropped.

    When several feed entries normalize to one route, the last by id names it.
    """
    short = F.coalesce(F.nullif(F.trim("route_short_name"), F.lit("")), F.trim("route_id"))
    long_name = F.coalesce(F.trim("route_long_name"), F.lit(""))
    mode = F.when(F.trim("route_type") == "3", "bus").when(F.trim("route_type") == "0", "streetcar")
    out = routes.where(F.coalesce(F.trim("route_id"), F.lit("")) != "").select(
        F.trim("route_id").alias("route_id"),
        normalize_route(short).alias("route"),
        mode.alias("mode"),
        long_name.alias("_long"),
    )
    out = out.where(
        (F.col("route") != UNKNOWN) & F.col("mode").isNotNull() & ~F.upper(F.trim("_long")).endswith(" LINE")
    )
    named = (F.col("_long") != "") & (F.upper("_long") != F.col("route"))
    return out.withColumn(
        "label", F.when(named, F.concat_ws(" - ", "route", "_long")).otherwise(F.col("route"))
    ).drop("_long")


def route_options(routes: DataFrame) -> DataFrame:
    """One line per route with label and mode, in route order."""
    last = F.max_by(F.struct("label", "mode"), "route_id")
    out = routes.groupBy("route").agg(last.alias("_last"))
    return out.select("route", "_last.label", "_last.mode").orderBy(*route_sort_keys(F.col("route")))


def _stop_visits(routes: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    named = trips.join(routes.select("route_id", "route"), "route_id").select("trip_id", "route")
    visits = stop_times.where(F.coalesce(F.col("stop_id"), F.lit("")) != "")
    return visits.join(named.where("trip_id is not null and trip_id != ''"), "trip_id")


def trip_endpoints(routes: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """First and last stop per trip; trips that end where they start are dropped.

    A stop whose sequence is not a whole number is ignored here. Equal sequences: smallest stop id.
    """
    visits = _stop_visits(routes, trips, stop_times)
    visits = visits.withColumn("_seq", F.col("stop_sequence").cast("string").try_cast("bigint")).where("_seq is not null")
    ends = visits.groupBy("trip_id", "route").agg(
        F.min(F.struct("_seq", "stop_id")).getField("stop_id").alias("first_stop"),
        F.min(F.struct((-F.col("_seq")).alias("_back"), F.col("stop_id"))).getField("stop_id").alias("last_stop"),
    )
    return ends.where("first_stop != last_stop")


def travel_direction(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Main compass direction between two points; NULL when a point is missing or they agree."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = lat2 - lat1
    return (
        F.when((lat1 == lat2) & (lon1 == lon2), None)
        .when(F.abs(x) >= F.abs(y), F.when(x > 0, "E").otherwise("W"))
        .when(y.isNotNull() & x.isNotNull(), F.when(y > 0, "N").otherwise("S"))
    )


def route_directions(endpoints: DataFrame, stops: DataFrame) -> DataFrame:
    """Directions of a route's trips in the order N, E, S, W (at most four values per route)."""
    places = stops.select(
        "stop_id", F.col("stop_lat").try_cast("double").alias("lat"), F.col("stop_lon").try_cast("double").alias("lon")
    ).where("lat is not null and lon is not null")
    # Trips of a route share few endpoint pairs: work on the pairs.
    pairs = endpoints.select("route", "first_stop", "last_stop").distinct()
    a = places.select(F.col("stop_id").alias("first_stop"), F.col("lat").alias("_a1"), F.col("lon").alias("_o1"))
    b = places.select(F.col("stop_id").alias("last_stop"), F.col("lat").alias("_a2"), F.col("lon").alias("_o2"))
    moved = pairs.join(a, "first_stop").join(b, "last_stop").withColumn(
        "direction", travel_direction(F.col("_a1"), F.col("_o1"), F.col("_a2"), F.col("_o2"))
    )
    found = moved.where("direction is not null").groupBy("route").agg(F.collect_set("direction").alias("_found"))
    order = F.array(*[F.lit(d) for d in "NESW"])
    return found.select("route", F.array_intersect(order, "_found").alias("directions"))


def route_stops(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """(route, location, label): stops of a route by normalized name; the smallest label names it."""
    served = _stop_visits(routes, trips, stop_times).select("route", "stop_id").distinct()
    named = stops.where("stop_name is not null and stop_name != ''").select("stop_id", "stop_name")
    named = named.withColumn("location", normalize_location(F.col("stop_name"))).where(F.col("location") != UNKNOWN)
    return served.join(named, "stop_id").groupBy("route", "location").agg(F.min("stop_name").alias("label"))


def ordered_stops(stops: DataFrame) -> DataFrame:
    return stops.orderBy("route", F.lower("label"), "label")


def route_index(routes: DataFrame, trips: DataFrame, stop_times: DataFrame, stops: DataFrame) -> RouteIndex:
    surface = feed_routes(routes)
    stop_table = route_stops(surface, trips, stop_times, stops)
    endpoints = trip_endpoints(surface, trips, stop_times)
    options = route_options(surface).join(stop_table.select("route").distinct(), "route", "left_semi")
    return RouteIndex(options, stop_table, route_directions(endpoints, stops))


def _resolve(requests: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Add the known route a request falls back to: itself, else its base route, else NULL."""
    exact = known.select(F.col("route").alias("_exact"))
    base = known.select(F.col("route").alias("_base"))
    out = requests.withColumn("_base_of", base_route(F.col("normalized_route")))
    out = out.join(exact, F.col("normalized_route") == F.col("_exact"), "left")
    out = out.join(base, F.col("_base_of") == F.col("_base"), "left")
    return out.withColumn(name, F.coalesce("_exact", "_base")).drop("_exact", "_base", "_base_of")


def resolve_routes(requests: DataFrame, index: RouteIndex) -> DataFrame:
    """Mode and directions per requested route, from the route or from its base route."""
    asked = requests.withColumn("normalized_route", normalize_route(F.col("route")))
    out = _resolve(asked, index.routes.select("route"), "_mode_route")
    out = _resolve(out, index.directions.select("route"), "_direction_route")
    modes = index.routes.select(F.col("route").alias("_mode_route"), F.col("mode").alias("route_mode"))
    ways = index.directions.select(F.col("route").alias("_direction_route"), "directions")
    out = out.join(modes, "_mode_route", "left").join(ways, "_direction_route", "left")
    both = (F.size("directions") >= 2) & ~F.array_contains("directions", "B")
    options = F.when(both, F.array_append("directions", F.lit("B"))).otherwise(F.col("directions"))
    base, route = F.col("_direction_route"), F.col("normalized_route")
    warning = F.when(base.isNull(), fill(messages.DIRECTIONS_UNKNOWN, route=route)).when(
        base != route, fill(messages.DIRECTIONS_OF_BASE, base=base, route=route)
    )
    return out.select(
        *requests.columns, "normalized_route", "route_mode",
        F.coalesce(options, F.array().cast("array<string>")).alias("direction_options"),
        warning.alias("direction_warning"),
    )


def validate_route_locations(requests: DataFrame, index: RouteIndex) -> DataFrame:
    """Does the requested location lie on the requested route (or on its base route)?"""
    asked = requests.withColumns(
        {
            "normalized_route": normalize_route(F.col("route")),
            "normalized_location": normalize_location(F.col("location")),
        }
    )
    out = _resolve(asked, index.stops.select("route").distinct(), "_list_route")
    hits = index.stops.select(
        F.col("route").alias("_list_route"), F.col("location").alias("normalized_location"),
        F.col("label").alias("route_location_label"), F.lit(True).alias("_hit"),
    )
    out = out.join(hits, ["_list_route", "normalized_location"], "left")
    matched = F.coalesce("_list_route", "normalized_route")
    accepted = F.coalesce("_hit", F.lit(False))
    base, route, place = F.col("_list_route"), F.col("normalized_route"), F.col("normalized_location")
    warning = (
        F.when(base.isNull(), fill(messages.ROUTE_UNKNOWN, route=route))
        .when(~accepted, fill(messages.NO_SUCH_STOP, location=place, route=matched))
        .when(base != route, fill(messages.STOPS_OF_BASE, base=base, route=route))
    )
    return out.select(
        *requests.columns,
        matched.alias("matched_route"), "normalized_location",
        F.when(accepted, F.col("normalized_location")).alias("route_location"),
        "route_location_label", accepted.alias("accepted_for_prediction"), warning.alias("warning"),
    )
