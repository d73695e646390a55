"""Text cleanup and category normalization as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.contract import OTHER, RAW_CATEGORICALS, UNKNOWN

# Texts that mean "no value" when a category is normalized.
NULL_LIKE = ["", "nan", "none", "null", "n/a", "na", "<na>", "unknown", "unk"]

# The incident categories.
INCIDENT_CATEGORIES = [
    "Mechanical", "Utilized Off Route", "General Delay", "Late Leaving Garage", "Investigation",
    "Operations", "Operations - Operator", "Diversion", "Emergency Services", "Security",
    "Collision - TTC", "Collision - TTC Involved", "Road Blocked - NON-TTC Collision", "Held By",
    "Cleaning", "Cleaning - Unsanitary", "Vision", "Overhead", "Overhead - Pantograph",
    "Rail/Switches", "Unknown", "Other",
]

# Known incident spellings and their category.
INCIDENT_ALIASES = {
    "MECH": "Mechanical",
    "MECHANICAL": "Mechanical",
    "MECHANICAL DELAY": "Mechanical",
    "UTILIZED OFF ROUTE": "Utilized Off Route",
    "OFF ROUTE": "Utilized Off Route",
    "GENERAL": "General Delay",
    "GENERAL DELAY": "General Delay",
    "DELAY": "General Delay",
    "LATE LEAVING GARAGE": "Late Leaving Garage",
    "LATE GARAGE": "Late Leaving Garage",
    "INVESTIGATION": "Investigation",
    "INVESTIGATING": "Investigation",
    "OPS": "Operations",
    "OPERATION": "Operations",
    "OPERATIONS": "Operations",
    "OPERATOR": "Operations - Operator",
    "OPERATIONS OPERATOR": "Operations - Operator",
    "OPERATIONS - OPERATOR": "Operations - Operator",
    "DIVERSION": "Diversion",
    "DIVERSIONS": "Diversion",
    "EMERGENCY": "Emergency Services",
    "EMS": "Emergency Services",
    "EMERGENCY SERVICES": "Emergency Services",
    "SECURITTY": "Security",
    "SECURITY": "Security",
    "COLLISION": "Collision - TTC",
    "ACCIDENT": "Collision - TTC",
    "TTC COLLISION": "Collision - TTC",
    "COLLISION - TTC": "Collision - TTC",
    "TTC INVOLVED": "Collision - TTC Involved",
    "COLLISION - TTC INVOLVED": "Collision - TTC Involved",
    "ROAD BLOCKED": "Road Blocked - NON-TTC Collision",
    "ROAD BLOCKED - NON-TTC COLLISION": "Road Blocked - NON-TTC Collision",
    "NON TTC COLLISION": "Road Blocked - NON-TTC Collision",
    "NON-TTC COLLISION": "Road Blocked - NON-TTC Collision",
    "HELD": "Held By",
    "HELD BY": "Held By",
    "CLEANING": "Cleaning",
    "CLEAN-UP": "Cleaning",
    "CLEAN UP": "Cleaning",
    "UNSANITARY": "Cleaning - Unsanitary",
    "CLEANING - UNSANITARY": "Cleaning - Unsanitary",
    "VISION": "Vision",
    "OVERHEAD": "Overhead",
    "PANTOGRAPH": "Overhead - Pantograph",
    "OVERHEAD - PANTOGRAPH": "Overhead - Pantograph",
    "RAIL": "Rail/Switches",
    "SWITCH": "Rail/Switches",
    "SWITCHES": "Rail/Switches",
    "RAIL/SWITCHES": "Rail/Switches",
}

# Fixed values: (fragments, category), first hit wins, for spellings without an alias.
INCIDENT_FRAGMENTS = [
    (["PANTOGRAPH"], "Overhead - Pantograph"),
    (["OVERHEAD"], "Overhead"),
    (["UNSANITARY"], "Cleaning - Unsanitary"),
    (["CLEAN"], "Cleaning"),
    (["SECUR"], "Security"),
    (["EMERGENCY"], "Emergency Services"),
    (["OPERATOR"], "Operations - Operator"),
    (["OPS", "OPERATION"], "Operations"),
    (["MECH"], "Mechanical"),
    (["DIVERSION"], "Diversion"),
    (["COLLISION", "ACCIDENT"], "Collision - TTC"),
]

# Direction spellings (letters only) per direction code.
DIRECTION_SPELLINGS = {
    "N": ["N", "NB", "NORTH", "NBOUND", "NORTHBOUND"],
    "E": ["E", "EB", "EAST", "EBOUND", "EASTBOUND"],
    "S": ["S", "SB", "SOUTH", "SBOUND", "SOUTHBOUND"],
    "W": ["W", "WB", "WEST", "WBOUND", "WESTBOUND"],
    "B": ["B", "BW", "BOTH", "BOTHWAYS", "BOTHWAY", "BIDIRECTIONAL", "BIDIR", "MIXED", "WBE",
          "WBEB", "EBWB", "NBSB", "SBNB"],
}

# Location abbreviations.
LOCATION_ABBREVIATIONS = {
    "STN": "STATION",
    "STA": "STATION",
    "ST": "STREET",
    "AVE": "AVENUE",
    "RD": "ROAD",
    "BLVD": "BOULEVARD",
    "DR": "DRIVE",
    "CRES": "CRESCENT",
    "PKWY": "PARKWAY",
    "HWY": "HIGHWAY",
    "W": "WEST",
    "E": "EAST",
    "N": "NORTH",
    "S": "SOUTH",
}

# Road words expanded when location texts are compared.
MATCH_ROAD_WORDS = {
    "st": "street",
    "ave": "avenue",
    "rd": "road",
    "blvd": "boulevard",
    "dr": "drive",
    "cres": "crescent",
    "w": "west",
    "e": "east",
    "n": "north",
    "s": "south",
}

ROUTE_SHAPE = r"^([0-9]{1,4}[A-Z]{0,2}|RAD)$"


def squeeze(text: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _squeeze_column(name: str) -> Column:
    """``squeeze`` of a column; only texts with other white space than single blanks meet the regular expression."""
    text = F.col(name)
    marks = ("  ", "\t", "\n", "\x0b", "\f", "\r")
    uneven = reduce(lambda a, b: a | b, [F.contains(text, F.lit(mark)) for mark in marks])
    return F.when(uneven, squeeze(text)).otherwise(F.trim(text))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(item) for pair in pairs.items() for item in pair])


def _expand_tokens(text: Column, expansions: dict[str, str]) -> Column:
    table = _literal_map(expansions)
    return F.array_join(
        F.transform(F.split(text, " "), lambda token: F.coalesce(F.try_element_at(table, token), token)),
        " ",
    )


def clean_text(text: Column) -> Column:
    """Import cleanup: squeeze, drop null words, strip the ``.0`` of integer-like text."""
    squeezed = squeeze(text)
    return F.when(squeezed.rlike(r"^[0-9]+\.0$"), F.regexp_replace(squeezed, r"\.0$", "")).when(
        ~F.lower(squeezed).isin("", "nan", "none", "nat"), squeezed
    )


def _without_null_words(squeezed: Column) -> Column:
    return F.when(~F.lower(squeezed).isin(NULL_LIKE), squeezed)


def category_text(text: Column) -> Column:
    """Squeezed text, NULL when it only says that there is no value."""
    return _without_null_words(squeeze(text))


def _mode_rule(mode: Column) -> Column:
    return F.when(mode.isin("bus", "streetcar"), mode).otherwise(F.lit(UNKNOWN))


def normalize_mode(text: Column, strict: bool = False) -> Column:
    mode = F.lower(category_text(text))
    if not strict:
        return _mode_rule(mode)
    problem = F.concat(F.lit("Unsupported mode: "), F.coalesce(text, F.lit("NULL")))
    return F.when(mode.isin("bus", "streetcar"), mode).otherwise(F.raise_error(problem).cast("string"))


def _route_rule(cleaned: Column) -> Column:
    # Neither expression can match without a point, or a zero in front.
    pointless = F.when(F.contains(cleaned, F.lit(".")), F.regexp_replace(cleaned, r"\.0+$", "")).otherwise(cleaned)
    whole = F.when(F.startswith(cleaned, F.lit("0")), F.regexp_replace(pointless, r"^0+(?=[0-9])", "")).otherwise(pointless)
    compact = F.replace(F.upper(cleaned), F.lit(" "), F.lit(""))
    return (
        F.when(cleaned.isNull(), F.lit(UNKNOWN))
        .when(cleaned.rlike(r"^[0-9]+(\.0+)?$"), whole)
        .when(compact.rlike(ROUTE_SHAPE), compact)
        .otherwise(F.lit(UNKNOWN))
    )


def normalize_route(text: Column) -> Column:
    return _route_rule(category_text(text))


def is_route_like(text: Column) -> Column:
    return normalize_route(text) != UNKNOWN


def _direction_letters(cleaned: Column) -> Column:
    return F.regexp_replace(F.upper(cleaned), "[^A-Z]", "")


def _direction_rule(letters: Column) -> Column:
    compass = sum((letters.contains(c).cast("int") for c in "NESW"), F.lit(0))
    result = F.when(letters.isNull(), F.lit(UNKNOWN))
    for code, spellings in DIRECTION_SPELLINGS.items():
        result = result.when(letters.isin(spellings), F.lit(code))
    return result.when(letters.rlike("^[NESWB]*$") & (compass >= 2), F.lit("B")).otherwise(
        F.lit(UNKNOWN)
    )


def normalize_direction(text: Column) -> Column:
    return _direction_rule(_direction_letters(category_text(text)))


def incident_key(text: Column) -> Column:
    """Canonical spelling used to look incidents up."""
    upper = F.upper(text)
    # All marks, slashes among them, become one blank each run; a known spelling without any is its own key.
    key = F.trim(F.regexp_replace(F.replace(upper, F.lit("&"), F.lit(" AND ")), "[^A-Z0-9-]+", " "))
    return F.when(upper.isin(_PLAIN_KEYS), upper).otherwise(key)


def _incident_lookup() -> dict[str, str]:
    # A category name is its own alias; its key differs from the name when it holds a slash.
    lookup = {name.upper().replace("/", " "): name for name in INCIDENT_CATEGORIES}
    return lookup | INCIDENT_ALIASES


_PLAIN_KEYS = [key for key in _incident_lookup() if re.fullmatch("[A-Z0-9-]+(?: [A-Z0-9-]+)*", key)]


def _incident_rule(key: Column) -> Column:
    lookup = _incident_lookup()
    result = F.when(key.isNull(), F.lit(UNKNOWN)).when(
        key.isin(list(lookup)), F.try_element_at(_literal_map(lookup), key)
    )
    # A higher-order function instead of a chain of conditions: a projection with one is generated in small
    # methods. The chain made the method of a whole stage too long for the JVM to compile.
    fragments = F.array(
        *[F.struct(F.lit(f).alias("fragment"), F.lit(c).alias("category")) for fs, c in INCIDENT_FRAGMENTS for f in fs]
    )
    held = F.filter(fragments, lambda f: F.contains(key, f["fragment"]))
    return result.otherwise(F.coalesce(F.get(held, F.lit(0))["category"], F.lit(OTHER)))


def normalize_incident(text: Column) -> Column:
    return _incident_rule(incident_key(category_text(text)))


def _location_words(cleaned: Column, strip_punctuation: bool = False) -> Column:
    upper = F.regexp_replace(F.upper(cleaned), "[&@/]", " AND ")
    marks = r"[.,;:()\[\]{}]" if strip_punctuation else r"[.,;:()\[\\]\{\}\]"
    return squeeze(F.regexp_replace(upper, marks, " "))


def _location_rule(words: Column) -> Column:
    return F.coalesce(
        F.nullif(_expand_tokens(words, LOCATION_ABBREVIATIONS), F.lit("")), F.lit(UNKNOWN)
    )


def normalize_location(text: Column, strip_punctuation: bool = False) -> Column:
    """Upper case, separators to AND, abbreviations expanded.

    By default punctuation stays (only a punctuation mark followed by ``{}]`` goes), which
    leaves ``ST.`` unexpanded. ``strip_punctuation`` removes the marks first.
    """
    return _location_rule(_location_words(category_text(text), strip_punctuation))


NORMALIZERS = {
    "mode": normalize_mode,
    "route": normalize_route,
    "direction": normalize_direction,
    "incident": normalize_incident,
    "location": normalize_location,
}


# What each rule looks at (made from the cleaned text), and the rule.
_STAGES = {
    "mode": (F.lower, _mode_rule),
    "route": (lambda cleaned: cleaned, _route_rule),
    "direction": (_direction_letters, _direction_rule),
    "incident": (incident_key, _incident_rule),
    "location": (_location_words, _location_rule),
}


def normalize_categories(df: DataFrame) -> DataFrame:
    """Overwrite the five categories by their normal form; keep the raw text once.

    Three projections: each step reads the result of the one before several times, and a
    projection of its own makes Spark compute it once per row.
    """
    present = set(df.columns)
    raw = {
        f"{name}_raw": F.col(name)
        for name in RAW_CATEGORICALS
        if name in present and f"{name}_raw" not in present
    }
    df = df.withColumns(raw) if raw else df
    names = [name for name in _STAGES if name in present]
    df = df.withColumns({f"_{name}_squeezed": _squeeze_column(name) for name in names})
    df = df.withColumns(
        {f"_{name}_text": _STAGES[name][0](_without_null_words(F.col(f"_{name}_squeezed"))) for name in names}
    )
    df = df.withColumns({name: _STAGES[name][1](F.col(f"_{name}_text")) for name in names})
    return df.drop(*[f"_{name}_{step}" for name in names for step in ("squeezed", "text")])


def match_text(text: Column) -> Column:
    """Text used to compare locations; empty when there is no location."""
    location = normalize_location(text)
    plain = F.regexp_replace(F.lower(location), r"[!\"#$%'()*+,\-.:;<=>?\[\\\]^_`{|}~]", " ")
    expanded = squeeze(_expand_tokens(squeeze(plain), MATCH_ROAD_WORDS))
    return F.when(F.lower(location) == UNKNOWN.lower(), F.lit("")).otherwise(expanded)


def base_route(route: Column) -> Column:
    """``29A`` -> ``29``; NULL when the route is not a branch."""
    return F.nullif(F.regexp_extract(route, r"^([0-9]{1,4})[A-Z]{1,2}$", 1), F.lit(""))


def route_sort_keys(route: Column) -> list[Column]:
    """Numbered routes first by number and suffix, then the others by text."""
    numbered = route.rlike(r"^[0-9]+[A-Z]*$")
    number = F.regexp_extract(route, r"^([0-9]+)", 1).try_cast("bigint")
    return [
        F.when(numbered, 0).otherwise(1),
        F.when(numbered, number),
        F.when(numbered, F.regexp_extract(route, r"([A-Z]*)$", 1)).otherwise(F.lower(route)),
    ]


def option_sort_keys(value: Column) -> list[Column]:
    """Digit-only options first by number, then the others by lower-case text."""
    digits = value.rlike("^[0-9]+$")
    return [
        F.when(digits, 0).otherwise(1),
        F.when(digits, value.try_cast("bigint")),
        F.lower(value),
    ]
