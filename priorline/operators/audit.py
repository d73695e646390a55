"""Quality audit of category values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline import messages
from priorline.functions.text import INCIDENT_CATEGORIES, is_route_like, squeeze
from priorline.operators.quantiles import join_groups

AUDIT_COLUMNS = ["mode", "route", "direction", "incident", "location"]
# Texts that count as missing in the audit.
AUDIT_NULL_LIKE = ["", "nan", "none", "null", "unknown", "n/a", "na"]
# Direction codes that need no attention.
HEALTHY_DIRECTIONS = ["N", "S", "E", "W", "B", "UNKNOWN"]
# Words that hint at a location.
LOCATION_WORDS = [
    "station", "street", "st", "avenue", "ave", "road", "rd", "loop", "garage", "terminal",
    "yard", "division", "and", "&", "at", "north", "south", "east", "west",
]
# Words that hint at an incident label.
INCIDENT_WORDS = [
    "mechanical", "mech", "diversion", "delay", "held", "late", "operations", "operator",
    "investigation", "security", "collision", "emergency", "cleaning", "utilized", "off route",
    "general",
]
# Fragments that do not belong into a direction.
DIRECTION_POLLUTION = [
    "mechanical", "diversion", "delay", "held", "street", "station", "loop", "garage", "mins", "late",
]
# Incident spellings that split one meaning over several labels.
FRAGMENT_GROUPS = {
    "mechanical": ["mech", "mechanical", "mechanical delay"],
    "general_delay": ["general", "general delay", "delay"],
    "operations": ["operations", "operation", "operator", "operations - operator"],
}
CURATED_INCIDENTS = [c.lower() for c in INCIDENT_CATEGORIES if c != "Unknown"]


def _has_word(lower: Column, words: Sequence[str]) -> Column:
    return lower.rlike("\\b(" + "|".join(words) + ")\\b")


def _null_like(value: Column) -> Column:
    return F.lower(value).isin(AUDIT_NULL_LIKE)


def value_counts(df: DataFrame, columns: Sequence[str] = AUDIT_COLUMNS) -> DataFrame:
    """(column, value, count) of the cleaned values, missing ones under a NULL value.

    The rows are read once; a hot value is reduced before the shuffle.
    """
    values = []
    for name in columns:
        cleaned = squeeze(F.col(name))
        values.append(
            F.struct(
                F.lit(name).alias("column"),
                F.when(~_null_like(cleaned), cleaned).alias("value"),
            )
        )
    return df.select(F.inline(F.array(*values))).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count")
    )


def active_fragment_groups(counts: DataFrame) -> DataFrame:
    """(fragment_group, variant) of the groups with two or more spellings in use."""
    rows = counts.where("column = 'incident' and value is not null").select(F.lower("value").alias("variant"))
    group = F.coalesce(
        *[F.when(F.col("variant").isin(v), F.lit(g)) for g, v in FRAGMENT_GROUPS.items()]
    )
    present = rows.withColumn("fragment_group", group).where("fragment_group is not null").distinct()
    busy = present.groupBy("fragment_group").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    return present.join(busy, "fragment_group", "left_semi").select("fragment_group", "variant")


def _reasons(column: Column, value: Column, count: Column, fragment: Column) -> Column:
    lower, upper, size = F.lower(value), F.upper(value), F.length(value)
    route_like = F.col("_route_like")
    curated = lower.isin(CURATED_INCIDENTS)
    healthy = upper.isin(HEALTHY_DIRECTIONS)
    polluted = F.lit(False)
    for fragment_word in DIRECTION_POLLUTION:
        polluted = polluted | lower.contains(fragment_word)
    location_word = _has_word(lower, LOCATION_WORDS)
    incident_word = _has_word(lower, INCIDENT_WORDS)

    def checks(name: str, active: Column, rules) -> list[Column]:
        here = (column == name) & active
        return [F.when(here & test, F.lit(text) if isinstance(text, str) else text) for test, text in rules]

    always = F.lit(True)
    long_route, wordy_route = size > 8, F.size(F.split(value, " ")) >= 2
    none_of_them = ~(long_route | wordy_route | location_word | incident_word)
    found = (
        checks("mode", always, [(~lower.isin("bus", "streetcar"), messages.MODE_ODD)])
        + checks("direction", always, [
            ((value != upper) & healthy, messages.DIRECTION_LOWER),
            (size > 3, messages.DIRECTION_LONG),
            (value.rlike("[0-9]"), messages.DIRECTION_DIGITS),
            (polluted, messages.DIRECTION_POLLUTED),
            (~healthy & (size <= 3) & (value != upper), messages.DIRECTION_UNCOMMON),
        ])
        + checks("route", ~route_like, [
            (long_route, messages.ROUTE_LONG),
            (wordy_route, messages.ROUTE_WORDY),
            (location_word, messages.ROUTE_LOCATION),
            (incident_word, messages.ROUTE_INCIDENT),
            (none_of_them, messages.ROUTE_ODD),
        ])
        + checks("incident", ~curated, [
            (route_like, messages.INCIDENT_ROUTE),
            (location_word, messages.INCIDENT_LOCATION),
            ((count <= 2) & (size > 2), messages.INCIDENT_RARE),
            (fragment.isNotNull(), messages.fill(messages.INCIDENT_FRAGMENT, fragment=fragment)),
        ])
        + checks("location", always, [
            (size <= 2, messages.LOCATION_SHORT),
            (route_like, messages.LOCATION_ROUTE),
            (incident_word, messages.LOCATION_INCIDENT),
        ])
    )
    return F.array_compact(F.array(*found))


def audit_values(df: DataFrame, columns: Sequence[str] = AUDIT_COLUMNS) -> DataFrame:
    """Every distinct value with its share, the reasons against it and the fields it looks like."""
    counts = value_counts(df, columns)
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    present = counts.where("value is not null")

    # Values seen in several columns: at most one entry per audited column and value.
    places = present.groupBy(F.lower("value").alias("_lower")).agg(F.collect_set("column").alias("_columns"))
    shared = present.select("column", "value", "count", F.lower("value").alias("_lower")).join(
        places, "_lower", "left"
    )
    fragments = active_fragment_groups(counts).withColumnRenamed("variant", "_lower")
    shared = shared.join(fragments, "_lower", "left").withColumn("_route_like", is_route_like(F.col("value")))
    column, value = F.col("column"), F.col("value")
    reasons = _reasons(column, value, F.col("count"), F.col("fragment_group"))
    extra = F.array_compact(
        F.array(
            F.when((column != "route") & F.col("_route_like"), "route"),
            F.when(
                (column != "direction") & F.upper(value).isin([d for d in HEALTHY_DIRECTIONS if d != "UNKNOWN"]),
                "direction",
            ),
        )
    )
    fields = F.array_sort(
        F.array_distinct(F.concat(F.array_remove(F.col("_columns"), column), extra))
    )
    exempt = (column == "mode") | ((column == "incident") & F.col("_lower").isin(CURATED_INCIDENTS))
    fields = F.when(exempt, F.array().cast("array<string>")).otherwise(fields)
    audited = shared.select(
        "column", "value", "count", reasons.alias("_reasons"), fields.alias("_fields")
    )
    return audited.select(
        "column", "value", "count",
        F.round(F.col("count") * 100.0 / total.scalar(), 4).alias("percent"),
        ((F.size("_reasons") > 0) | (F.size("_fields") > 0)).alias("suspicious"),
        F.array_join("_reasons", "; ").alias("reasons"),
        F.array_join("_fields", "; ").alias("looks_like_fields"),
    )


def suspicious_values(df: DataFrame) -> DataFrame:
    return audit_values(df).where("suspicious")


def top_values(df: DataFrame, n: int = 25) -> DataFrame:
    """The n most frequent values per column; equal counts are ordered by value."""
    present = value_counts(df).where("value is not null")
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    total = df.agg(F.count(F.lit(1)))
    return (
        present.withColumn("place", place)
        .where(F.col("place") <= n)
        .withColumn("percent", F.round(F.col("count") * 100.0 / total.scalar(), 4))
    )


def category_audit(df: DataFrame) -> DataFrame:
    """One line per audited column: size, missing share, distinct and suspicious values."""
    sizes = value_counts(df).groupBy("column").agg(
        F.sum("count").alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing_count"),
        F.count("value").alias("unique_count"),
    )
    flagged = audit_values(df).groupBy("column").agg(
        F.count_if("suspicious").alias("suspicious_values_count"),
        F.coalesce(F.sum(F.when(F.col("suspicious"), F.col("count"))), F.lit(0)).alias("suspicious_rows_count"),
    )
    out = join_groups(sizes, flagged, ["column"])
    return out.withColumns(
        {
            "suspicious_values_count": F.coalesce("suspicious_values_count", F.lit(0)),
            "suspicious_rows_count": F.coalesce("suspicious_rows_count", F.lit(0)),
            "missing_percent": F.round(F.col("missing_count") * 100.0 / F.col("total_rows"), 4),
        }
    )


def suspicious_examples(df: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent suspicious values per column."""
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return suspicious_values(df).withColumn("place", place).where(F.col("place") <= n)
