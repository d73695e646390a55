"""Strictly-prior history: expanding and time-range means, rates and counts per grouping.

For a row at time t and a grouping g, history is the set of rows with the same values in g and
a smaller timestamp (expanding), or also not older than t minus a horizon (rolling). Rows that
share a timestamp never see each other.

Plan of ``sliced``, the default: the groupings with the route, those with the location and all others are
a family each. A family's rows are dealt once, to cells: the rows of an anchor key (route or location), and
where these are many, or the family has no such key, equi-depth slices of time (see ``slices``) of them. In
a cell each grouping is a plain window; carry rows bring in what lies before a slice. A rolling sum counts
a row again, negatively, one horizon later; sums are whole numbers, so nothing is lost to cancellation.
What happens before the first time that is asked for is summed per keys first; in the family without an
anchor, which has few keys, all of history is summed per keys and time.

Plan of ``bucketed``, for any set of groupings at once:

1. ``GROUPING SETS`` sums the rows per grouping, key values and timestamp in one shuffle, with
   partial aggregation before it.
2. A rolling sum is an expanding sum with a second, negative event one horizon later; events are
   whole numbers, so nothing is lost to cancellation.
3. ``sums_before`` turns events into prefixes without a task that owns a whole key.
4. Rows that agree in timestamp and all categories have the same history: the distinct tuples
   look their groupings up by an equi-join and are pivoted to one line each, and a last
   equi-join hands the features to the rows. Every join has a shuffle of its own on each side,
   so adaptive execution can split a partition with a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.contract import HISTORY_FEATURES, ROLES, SEVERE_THRESHOLDS, Roles
from priorline.functions.calendar import MICROS_PER_DAY, micros
from priorline.operators.prefix import sums_before
from priorline.operators.slices import SLICES_PER_PARTITION, carry_rows, cut_times, with_slices
from priorline.sources.durable import durable

BUCKET_MICROS = MICROS_PER_DAY
EXPANDING = ["v_sum", "v_part", "v_known", "v_rows"]
ROLLING = ["w_sum", "w_part", "w_known", "w_rows", "w_sev30", "w_sev60"]
#: Keys whose rows are kept together, the first one that a grouping has.
ANCHORS = ("route", "location")
#: Events that one task sorts at once, if not more are needed for 4 cells in a shuffle partition.
CELL_ROWS = 50_000
KEY_NAMES = ["mode", "route", "direction", "incident", "location", "hour"]


@dataclass(frozen=True)
class Grouping:
    """Key columns (role names) and the horizon of the rolling window, if any."""

    name: str
    keys: tuple[str, ...]
    horizon_days: int | None = None


@dataclass(frozen=True)
class Feature:
    """One output: ``kind`` is mean, count, rolling_mean, rolling_count, rate_30 or rate_60."""

    name: str
    grouping: str
    kind: str


GROUPINGS = [
    Grouping("global", ()),
    Grouping("mode", ("mode",)),
    Grouping("route", ("route",), 30),
    Grouping("route_hour", ("route", "hour"), 7),
    Grouping("incident", ("incident",), 30),
    Grouping("route_incident", ("route", "incident")),
    Grouping("mode_incident", ("mode", "incident")),
    Grouping("route_direction", ("route", "direction")),
    Grouping("location", ("location",)),
]

FEATURES = [
    Feature("prior_route_mean_delay", "route", "mean"),
    Feature("prior_route_hour_mean_delay", "route_hour", "mean"),
    Feature("prior_incident_mean_delay", "incident", "mean"),
    Feature("prior_mode_mean_delay", "mode", "mean"),
    Feature("prior_global_mean_delay", "global", "mean"),
    Feature("prior_route_hour_7d_mean_delay", "route_hour", "rolling_mean"),
    Feature("prior_route_incident_mean_delay", "route_incident", "mean"),
    Feature("prior_mode_incident_mean_delay", "mode_incident", "mean"),
    Feature("prior_route_direction_mean_delay", "route_direction", "mean"),
    Feature("prior_route_incident_count", "route_incident", "count"),
    Feature("prior_route_30d_mean_delay", "route", "rolling_mean"),
    Feature("prior_incident_30d_mean_delay", "incident", "rolling_mean"),
    Feature("prior_route_30d_severe_rate_30", "route", "rate_30"),
    Feature("prior_incident_30d_severe_rate_30", "incident", "rate_30"),
    Feature("prior_route_30d_severe_rate_60", "route", "rate_60"),
    Feature("prior_incident_30d_severe_rate_60", "incident", "rate_60"),
    Feature("prior_location_mean_delay", "location", "mean"),
    Feature("prior_location_count", "location", "count"),
]
SEVEN_DAY = "prior_route_hour_7d_mean_delay"
SEVEN_DAY_FALLBACKS = ["prior_route_mean_delay", "prior_mode_mean_delay", "prior_global_mean_delay"]


def pick_features(names: Sequence[str]) -> list[Feature]:
    """The listed features, plus what the seven-day fallback needs."""
    wanted = set(names)
    unknown = wanted - set(HISTORY_FEATURES)
    if unknown:
        raise ValueError(f"Unknown history features: {sorted(unknown)}")
    if SEVEN_DAY in wanted:
        wanted |= set(SEVEN_DAY_FALLBACKS)
    return [feature for feature in FEATURES if feature.name in wanted]


def _role_columns(roles: Roles) -> dict[str, Column]:
    """Key columns under their role names; the hour always comes from the timestamp."""
    named = {
        "mode": F.col(roles.mode),
        "route": F.col(roles.route),
        "direction": F.col(roles.direction),
        "incident": F.col(roles.incident),
        "location": F.col(roles.location),
    }
    named["hour"] = F.hour(roles.ts)
    return named


def _keys_in_use(groupings: Sequence[Grouping]) -> list[str]:
    used = {key for grouping in groupings for key in grouping.keys}
    return [name for name in KEY_NAMES if name in used]


def _key_id(grouping: Grouping, keys: Sequence[str]) -> int:
    """The value of ``grouping_id()`` over ``keys`` for this grouping."""
    bits = ["0" if key in grouping.keys else "1" for key in keys]
    return int("".join(bits) or "0", 2)


def _past(
    df: DataFrame, keys: Sequence[str], roles: Roles, detail: DataFrame | None = None, width: int = 1
) -> DataFrame:
    """Rows as (at, keys, y).

    ``detail`` lists the time buckets in which single timestamps matter; in all others the rows
    count at the start of the bucket, which lets partial aggregation shrink them early.
    """
    named = _role_columns(roles)
    rows = df.select(
        micros(F.col(roles.ts)).alias("at"),
        *[named[k].alias(k) for k in keys],
        F.col(roles.target).alias("y"),
    ).where(F.col("at").isNotNull())
    if detail is None:
        return rows
    rows = rows.withColumn("_start", F.col("at") - F.pmod("at", F.lit(width)))
    marked = rows.join(detail.withColumn("_hit", F.lit(True)), "_start", "left")
    return marked.withColumn(
        "at", F.when(F.col("_hit"), F.col("at")).otherwise(F.col("_start"))
    ).drop("_start", "_hit")


def _key(grouping: Column, values: Sequence[Column], keys: Sequence[str]) -> Column:
    """One comparable key; absent and missing values inside a struct compare as equal."""
    return F.struct(grouping.alias("grouping"), *[v.alias(k) for v, k in zip(values, keys)])


def _per_grouping(rows: DataFrame, groupings: Sequence[Grouping], keys: Sequence[str], scale: int):
    """Sums per (grouping, key values, timestamp) in one shuffle."""
    sets = [[F.col("at"), *[F.col(k) for k in g.keys]] for g in groupings]
    # Whole units and the rest are summed apart: neither comes near the range of a long.
    whole = F.floor("y").cast("bigint")
    part = F.round((F.col("y") - F.floor("y")) * scale).cast("bigint")
    sums = rows.groupingSets(sets, "at", *keys).agg(
        F.grouping_id("at", *keys).cast("int").alias("grouping"),
        F.coalesce(F.sum(whole), F.lit(0)).alias("v_sum"),
        F.coalesce(F.sum(part), F.lit(0)).alias("v_part"),
        F.count("y").alias("v_known"),
        F.count(F.lit(1)).alias("v_rows"),
        *[F.count_if(F.col("y") >= t).alias(f"v_sev{t}") for t in SEVERE_THRESHOLDS],
    )
    key = _key(F.col("grouping"), [F.col(k) for k in keys], keys)
    return sums.select("at", key.alias("key"), *[c for c in sums.columns if c.startswith("v_")])


def _events(sums: DataFrame, groupings: Sequence[Grouping], keys: Sequence[str]) -> DataFrame:
    """Expanding values, and rolling values that are taken back one horizon later."""
    horizons = [g for g in groupings if g.horizon_days]
    if not horizons:
        return sums.select("key", "at", *EXPANDING)
    horizon = F.coalesce(
        *[
            F.when(F.col("key.grouping") == _key_id(g, keys), F.lit(g.horizon_days * MICROS_PER_DAY))
            for g in horizons
        ]
    )
    sources = [c.replace("w_", "v_") for c in ROLLING]
    zero = F.lit(0).cast("bigint")
    arriving = sums.select(
        "key", "at", *EXPANDING,
        *[F.when(horizon.isNotNull(), F.col(v)).otherwise(zero).alias(w) for w, v in zip(ROLLING, sources)],
    )
    leaving = sums.where(horizon.isNotNull()).select(
        "key", (F.col("at") + horizon).alias("at"),
        *[zero.alias(v) for v in EXPANDING],
        *[F.negative(v).alias(w) for w, v in zip(ROLLING, sources)],
    )
    return arriving.withColumn("wanted", F.lit(True)).unionByName(leaving.withColumn("wanted", F.lit(False)))


def _spread(tuples: DataFrame, groupings: Sequence[Grouping], keys: Sequence[str]) -> DataFrame:
    """One line per tuple and grouping; key values outside the grouping are NULL."""
    lookups = [
        _key(
            F.lit(_key_id(g, keys)),
            [
                F.col(k) if k in g.keys else F.lit(None).cast("int" if k == "hour" else "string")
                for k in keys
            ],
            keys,
        )
        for g in groupings
    ]
    return tuples.select("at", *keys, F.explode(F.array(*lookups)).alias("key"))


def _value(feature: Feature, scale: int, prefix: str = "") -> Column:
    def mean(kind: str) -> Column:
        total, part, known = (F.col(f"{prefix}{kind}_{m}") for m in ("sum", "part", "known"))
        return F.try_divide(total + part / F.lit(float(scale)), known)

    if feature.kind == "mean":
        return mean("v")
    if feature.kind == "count":
        return F.col(f"{prefix}v_rows")
    if feature.kind == "rolling_mean":
        return mean("w")
    if feature.kind == "rolling_count":
        return F.col(f"{prefix}w_rows")
    if feature.kind in ("rate_30", "rate_60"):
        return F.try_divide(F.col(f"{prefix}w_sev{feature.kind[-2:]}"), F.col(f"{prefix}w_rows"))
    raise ValueError(f"Unknown feature kind: {feature.kind}")


#: What each kind of feature sums: expanding (v) or rolling (w).
_SUMS = {
    "mean": ("v_sum", "v_part", "v_known"), "count": ("v_rows",), "rolling_mean": ("w_sum", "w_part", "w_known"),
    "rolling_count": ("w_rows",), "rate_30": ("w_sev30", "w_rows"), "rate_60": ("w_sev60", "w_rows"),
}


def _asked_and_past(
    rows: DataFrame, history: DataFrame | None, roles: Roles, asked: Column | None = None
) -> DataFrame:
    """Both tables as one, with _at, _asked (a row to return), and _past and _y where the row is history."""
    both = rows.withColumn("_asked", F.lit(True) if asked is None else F.coalesce(asked, F.lit(False)))
    if history is None:
        both = both.withColumn("_y", F.col(roles.target)).withColumn("_past", F.lit(1))
    else:
        both = both.withColumns({"_y": F.lit(None).cast("double"), "_past": F.lit(None).cast("int")})
        past = history.select(
            *roles.categoricals, roles.ts, F.col(roles.target).alias("_y"),
            F.lit(1).alias("_past"), F.lit(False).alias("_asked"),
        )
        both = both.unionByName(past, allowMissingColumns=True)
    return both.withColumn("_at", micros(F.col(roles.ts)))


def _with_undated(dated: DataFrame, both: DataFrame, columns: Sequence[str], features: Sequence[Feature]) -> DataFrame:
    """Rows without a time have no history."""
    kinds = {field.name: field.dataType for field in dated.schema}
    empty = [F.lit(None).cast(kinds[f.name]).alias(f.name) for f in features]
    return dated.union(both.where(F.col("_at").isNull() & F.col("_asked")).select(*columns, *empty))


def _families(groupings: Sequence[Grouping]) -> dict[tuple[str, ...], list[Grouping]]:
    """Groupings by the key that keeps their rows together; those without such a key go by time alone."""
    found: dict[tuple[str, ...], list[Grouping]] = {}
    for grouping in sorted(groupings, key=lambda g: g.horizon_days is None):  # rolling ones first
        anchor = tuple(k for k in ANCHORS if k in grouping.keys)[:1]
        found.setdefault(anchor, []).append(grouping)
    return found


def _sliced(
    rows: DataFrame, history: DataFrame | None, features: Sequence[Feature],
    groupings: Sequence[Grouping], roles: Roles, cell_rows: int, asked: Column | None = None,
) -> DataFrame:
    keys = {k: "_k_hour" if k == "hour" else getattr(roles, k) for k in _keys_in_use(groupings)}
    void = [c for c, kind in rows.dtypes if kind == "void"]  # no file holds them
    both = _asked_and_past(rows.drop(*void), history, roles, asked).withColumn("_k_hour", F.hour(roles.ts))
    # Read once for each family and several times inside one; the rows may be costly to make.
    both = durable(both)
    dated = both.where("_at IS NOT NULL")
    times = F.when(F.col("_asked"), F.col("_at"))
    first, last = dated.agg(F.min(times), F.max(times)).first()
    table = dated.where("_asked")
    others = dated.where("NOT _asked") if history is not None or asked is not None else None
    for anchor, members in _families(groupings).items():
        own = [f for f in features if f.grouping in {g.name for g in members}]
        columns = {k: c for k, c in keys.items() if any(k in g.keys for g in members)}
        table = _family(table, others, dated, own, members, anchor, columns, (first, last), roles.value_scale, cell_rows)
    names = [f.name for f in features]
    kept = [c for c in rows.columns if c not in void]
    out = _with_undated(table.select(*kept, *names), both, kept, features)
    return out.select(*[F.lit(None).alias(c) if c in void else F.col(c) for c in rows.columns], *names)


def _past_events(
    past: DataFrame, others: DataFrame | None, horizons: Sequence[int], keys: Sequence[str], by_time: bool,
    span: tuple[int | None, int | None], signed,
) -> DataFrame:
    """(keys, _at, _leaves, measures): what the rows that are asked for do not bring along themselves.

    past: all rows of history; others: those that nobody asks for; span: the first and the last time asked
    for. What happens before the first of them counts just before it, summed per keys. Families ``by_time``
    have few keys, so there all events are summed per keys and time, those of the asked rows as well.
    """
    first, last = span
    no_horizon = F.lit(None).cast("int").alias("_leaves")
    arriving = past if by_time else others
    events = [] if arriving is None else [
        arriving.where((F.col("_past") == 1) & (F.col("_at") < F.lit(last))).select(*keys, "_at", no_horizon, *signed(1))
    ]
    for days in horizons:
        moved = past.select(
            *keys, (F.col("_at") + days * MICROS_PER_DAY).alias("_at"), F.lit(days).alias("_leaves"), *signed(-1)
        )
        events.append(moved.where(F.col("_at") <= F.lit(last)))  # later ones are asked by no row
    found = reduce(DataFrame.unionByName, events) if events else past.limit(0).select(*keys, "_at", no_horizon, *signed(1))
    if first is None or others is None and not by_time:
        return found
    sums = [F.sum(c).alias(c) for c in found.columns if c.startswith("_m_")]
    floored = found.withColumn("_at", F.greatest("_at", F.lit(first - 1)))
    if by_time:
        return durable(floored.groupBy(*keys, "_at", "_leaves").agg(*sums))
    early = floored.where(F.col("_at") < first).groupBy(*keys, "_at", "_leaves").agg(*sums)
    return durable(early).unionByName(found.where(F.col("_at") >= first))


def _family(
    table: DataFrame, others: DataFrame | None, dated: DataFrame, features: Sequence[Feature],
    groupings: Sequence[Grouping], anchor: Sequence[str], keys: dict[str, str], span: tuple[int | None, int | None],
    scale: int, cell_rows: int,
) -> DataFrame:
    """table (the asked rows) with the features of groupings that hold the anchor key.

    others: rows that are history alone; dated: all rows, both without features; span: the first and last time asked for.
    """
    sums = {g.name: sorted({m for f in features if f.grouping == g.name for m in _SUMS[f.kind]}) for g in groupings}
    measured = sorted({m[2:] for names in sums.values() for m in names})
    y = F.col("_y")
    measures = {
        "sum": F.floor(y).cast("bigint"), "part": F.round((y - F.floor(y)) * scale).cast("bigint"),
        "known": y.isNotNull().cast("bigint"), "rows": F.lit(1).cast("bigint"),
        **{f"sev{t}": (y >= t).cast("bigint") for t in SEVERE_THRESHOLDS},
    }

    def signed(sign: int) -> list[Column]:
        return [(sign * F.coalesce(measures[m], F.lit(0))).cast("bigint").alias(f"_m_{m}") for m in measured]

    columns = list(dict.fromkeys(keys.values()))
    horizons = sorted({g.horizon_days for g in groupings if g.horizon_days})
    moved = _past_events(dated.where("_past = 1"), others, horizons, columns, not anchor, span, signed)
    counts = F.lit(False) if not anchor else F.coalesce(F.col("_past") == 1, F.lit(False))

    def with_own(rows: DataFrame) -> DataFrame:
        """Asked rows with what they add themselves."""
        added = [F.when(counts, m).otherwise(F.lit(0).cast("bigint")).alias(f"_m_{name}") for m, name in zip(signed(1), measured)]
        return rows.select("*", F.lit(None).cast("int").alias("_leaves"), *added)


    # Cells: the rows of an anchor key (all rows without one); a larger one is cut into slices of time.
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asking = dated.where("_asked").select(*columns, "_at")  # as many as in table, which may be costly
    events = asking.unionByName(moved.select(*columns, "_at"))
    anchor_hash = F.xxhash64(*[F.col(keys[k]) for k in anchor]) if anchor else F.lit(0)
    sizes = durable(events.groupBy(anchor_hash.alias("anchor")).count())
    n_events = sizes.agg(F.sum("count")).first()[0] or 0
    cell = max(cell_rows, -(-n_events // (SLICES_PER_PARTITION * partitions)))
    large = {row["anchor"]: row["count"] for row in sizes.where(F.col("count") > cell).collect()}  # under 4 per shuffle partition
    is_large = anchor_hash.isin(list(large)) if anchor else F.lit(True)
    cut = cut_times(events.where(is_large), "_at", -(-sum(large.values()) // cell)) if large else None

    def placed(df: DataFrame) -> DataFrame:
        if cut is None:
            return df.withColumn("_hot", F.lit(False))
        sliced = with_slices(df, "_at", cut)
        return sliced.withColumns(
            {
                "_slice": F.when(is_large, F.col("_slice")).otherwise(-1),
                "_part": F.when(is_large, F.col("_part")).otherwise(0),
                "_hot": is_large & F.col("_hot"),
            }
        )

    def counted(grouping: Grouping, name: str) -> Column:
        """What a row adds to a sum of a grouping."""
        if name not in sums[grouping.name]:
            return F.lit(0).cast("bigint")
        counts = F.col("_leaves").isNull()
        if name[0] == "w":
            counts = counts | (F.col("_leaves") == grouping.horizon_days)
        return F.when(counts, F.col(f"_m_{name[2:]}")).otherwise(0)

    arriving = with_own(table).unionByName(moved.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    dealt = placed(arriving).where("_asked OR NOT _hot")
    if cut is not None:
        values = {m: [counted(g, m) for g in groupings] for m in sorted({m for names in sums.values() for m in names})}
        # Asked rows are among them even where they add nothing: a slice needs the carry of each key in it.
        contributions = placed(with_own(dated.where("_asked")).select(*moved.columns).unionByName(moved).where(is_large))
        carries = carry_rows(contributions, "_at", cut, [[keys[k] for k in g.keys] for g in groupings], values)
        dealt = dealt.unionByName(carries, allowMissingColumns=True)
    # Rows at a hot second come in as carries; there they only ask.
    here = {f"_m_{m}": F.when(F.col("_hot"), 0).otherwise(F.col(f"_m_{m}")) for m in measured}
    cells = [*(["_slice", "_part"] if cut is not None else []), *[keys[k] for k in anchor]]
    local = (dealt.repartition(*cells) if cells else dealt.repartition(1)).withColumns(here).drop("_hot")
    for number, grouping in enumerate(groupings):
        if grouping.horizon_days is None and number and groupings[number - 1].horizon_days:
            local = local.where("_leaves IS NULL")
        window = (
            Window.partitionBy(*dict.fromkeys([*cells, *[keys[k] for k in grouping.keys]]))
            .orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
        )
        added = {m: counted(grouping, m) for m in sums[grouping.name]}
        if cut is not None:
            carried = F.col("_carry") == number
            added = {m: F.when(F.col("_carry").isNull(), v).when(carried, F.col(m)) for m, v in added.items()}
        local = local.withColumns(
            {f"_{grouping.name}_{m}": F.coalesce(F.sum(v).over(window), F.lit(0)) for m, v in added.items()}
        )
        if cut is not None:
            local = local.where(F.col("_carry").isNull() | ~carried)
    outputs = {f.name: _value(f, scale, f"_{f.grouping}_") for f in features}
    return local.where("_asked").withColumns(outputs).select(*table.columns, *outputs)


def _bucketed(
    rows: DataFrame, history: DataFrame | None, features: Sequence[Feature],
    groupings: Sequence[Grouping], roles: Roles, width: int,
) -> DataFrame:
    if any(g.horizon_days and g.horizon_days * MICROS_PER_DAY % width for g in groupings):
        raise ValueError("Every horizon must be a multiple of the bucket width.")
    keys = _keys_in_use(groupings)
    named = _role_columns(roles)
    tuples = (
        rows.select(micros(F.col(roles.ts)).alias("at"), *[named[k].alias(k) for k in keys])
        .where(F.col("at").isNotNull())
        .distinct()
    )
    lookups = _spread(tuples, groupings, keys)
    if history is None:
        past = _past(rows, keys, roles)
        events = _events(_per_grouping(past, groupings, keys, roles.value_scale), groupings, keys)
    else:
        start = F.col("at") - F.pmod("at", F.lit(width))
        shifts = sorted({0, *[g.horizon_days for g in groupings if g.horizon_days]})
        detail = (
            tuples.select(start.alias("_start"))
            .distinct()
            .select(F.explode(F.array(*[F.col("_start") - d * MICROS_PER_DAY for d in shifts])).alias("_start"))
            .distinct()
        )
        past = _past(history, keys, roles, detail, width)
        events = _events(_per_grouping(past, groupings, keys, roles.value_scale), groupings, keys)
        values = [c for c in events.columns if c[:2] in ("v_", "w_")]
        points = lookups.select(
            "key", "at", *[F.lit(0).cast("bigint").alias(v) for v in values], F.lit(True).alias("wanted")
        ).distinct()
        events = events.withColumn("wanted", F.lit(False)).unionByName(points)
    values = [c for c in events.columns if c[:2] in ("v_", "w_")]
    prior = sums_before(events, ["key"], "at", F.floor(F.col("at") / F.lit(width)), values, suffix="")
    if "wanted" in events.columns:
        prior = prior.where("wanted")

    found = lookups.alias("l").join(
        prior.alias("p"), (F.col("l.at") == F.col("p.at")) & (F.col("l.key") == F.col("p.key")), "inner"
    )
    ids = {g.name: _key_id(g, keys) for g in groupings}
    table = (
        found.select(
            F.struct("l.at", *[f"l.{k}" for k in keys]).alias("_tuple"),
            F.col("l.key.grouping").alias("grouping"),
            *[F.col(f"p.{v}").alias(v) for v in values],
        )
        .groupBy("_tuple")
        .agg(
            *[
                F.max(F.when(F.col("grouping") == ids[f.grouping], _value(f, roles.value_scale))).alias(f.name)
                for f in features
            ]
        )
    )
    # Other key columns than the aggregation's: the table gets a shuffle of its own, without which
    # adaptive execution could not split the rows of a hot tuple.
    table = table.select(
        F.col("_tuple.at").alias("_at"), F.struct(F.lit(0), *[F.col(f"_tuple.{k}") for k in keys]).alias("_keys"),
        *[f.name for f in features],
    )
    joined = rows.withColumns(
        {"_row_at": micros(F.col(roles.ts)), "_row_keys": F.struct(F.lit(0), *[named[k].alias(k) for k in keys])}
    ).join(table, (F.col("_row_at") == F.col("_at")) & (F.col("_row_keys") == F.col("_keys")), "left")
    return joined.select(*rows.columns, *[f.name for f in features])


def _ranged(
    rows: DataFrame, history: DataFrame | None, features: Sequence[Feature],
    groupings: Sequence[Grouping], roles: Roles,
) -> DataFrame:
    """Plain RANGE windows, one per grouping: simple, for inputs without dominant keys."""
    named = _role_columns(roles)
    columns = rows.columns
    everything = _asked_and_past(rows, history, roles)
    both = everything.where(F.col("_at").isNotNull())
    shape = {g.name: g for g in groupings}
    outputs = {}
    for feature in features:
        grouping = shape[feature.grouping]
        rolling = feature.kind.startswith(("rolling", "rate"))
        first = -grouping.horizon_days * MICROS_PER_DAY if rolling else Window.unboundedPreceding
        window = (
            Window.partitionBy(*[named[k] for k in grouping.keys]).orderBy("_at").rangeBetween(first, -1)
        )
        if feature.kind.endswith("mean"):
            outputs[feature.name] = F.avg("_y").over(window)
        elif feature.kind.endswith("count"):
            outputs[feature.name] = F.count("_past").over(window)
        else:
            severe = F.coalesce((F.col("_y") >= int(feature.kind[-2:])).cast("int"), F.lit(0))
            outputs[feature.name] = F.avg(F.when(F.col("_past") == 1, severe)).over(window)
    dated = both.withColumns(outputs).where("_asked").select(*columns, *outputs)
    return _with_undated(dated, everything, columns, features)


def with_history(
    rows: DataFrame,
    features: Sequence[Feature] = tuple(FEATURES),
    groupings: Sequence[Grouping] = tuple(GROUPINGS),
    roles: Roles = ROLES,
    history: DataFrame | None = None,
    strategy: str | None = None,
    bucket_micros: int = BUCKET_MICROS,
    cell_rows: int = CELL_ROWS,
    asked: Column | None = None,
) -> DataFrame:
    """Add prior features to ``rows``, from themselves or from a separate ``history`` table.

    Means and rates are NULL without history, counts are 0; so they are for rows without a time.
    With ``asked``, only the rows for which it holds are returned; the others are history alone.
    Strategies: ``sliced`` (windows in cells of a key or a slice of time), ``bucketed`` (prefix sums in
    buckets of a day, the history summed outside of those that are asked for) and ``range`` (plain windows, a
    task for each key); all give the same values. The default is sliced.
    """
    strategy = strategy or "sliced"
    used = {f.grouping for f in features}
    groupings = [g for g in groupings if g.name in used]
    rolling = {f.grouping for f in features if f.kind.startswith(("rolling", "rate"))}
    # A horizon nobody reads would only double the events.
    groupings = [g if g.name in rolling else Grouping(g.name, g.keys) for g in groupings]
    if strategy == "range":
        table = _ranged(rows, history, features, groupings, roles)
    elif strategy == "sliced":
        table = _sliced(rows, history, features, groupings, roles, cell_rows, asked)
    elif strategy == "bucketed":
        table = _bucketed(rows, history, features, groupings, roles, bucket_micros)
    else:
        raise ValueError(f"Unknown history strategy: {strategy}")
    if asked is not None and strategy != "sliced":
        table = table.where(asked)
    # Rows without a time have no history either.
    return table.withColumns(
        {f.name: F.coalesce(f.name, F.lit(0)) for f in features if f.kind.endswith("count")}
    )


def add_history_features(
    rows: DataFrame,
    names: Sequence[str] = tuple(HISTORY_FEATURES),
    roles: Roles = ROLES,
    strategy: str | None = None,
    asked: Column | None = None,
) -> DataFrame:
    """The contract's prior features (all, or the listed ones) with the seven-day fallback, of the rows ``asked`` for."""
    features = pick_features(names)
    table = with_history(rows, features, roles=roles, strategy=strategy, asked=asked)
    if SEVEN_DAY in names:
        table = table.withColumn(SEVEN_DAY, F.coalesce(SEVEN_DAY, *SEVEN_DAY_FALLBACKS))
    return table.select(*rows.columns, *names)
