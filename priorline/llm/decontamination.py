"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a sequence of template tokens: lower-cased words, and typed placeholders for numbers (in
digits or words), names (a capitalised word inside a sentence) and units (after a number). Any other
capitalised word, as at the beginning of a sentence, may be a word or a name, so a window with some has two
readings: all of them as words, and all as names. Windows of template tokens of all documents are
hash-joined with those of the benchmark, so a question matches although its numbers and names were
replaced. An item shorter than a window is a window by itself. Matches are grouped by alignment into
occurrences. A document leaks an item if an occurrence holds enough of the item's windows and its slots are
consistent: within the matched windows each value of the item stands for one value of the document.

The windows of a document are made and joined in one stage; only matches are shuffled. The benchmark's
windows are broadcast if a count shows that they are few, and joined by their hash otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.rows import id_and_text, sized
from priorline.sources.durable import durable

WINDOW = 5
#: Share of an item's windows that a document must hold.
LEAST_COVERED = 0.5

# Units of measure, in natural order.
UNITS = (
    "%", "c", "cents", "cm", "days", "degrees", "dollars", "euros", "feet", "ft", "g", "gb", "grams", "h", "hours",
    "hz", "inches", "j", "kb", "kg", "khz", "kilograms", "kilometers", "km", "kmh", "kw", "l", "lb", "liters", "m",
    "mb", "meters", "mg", "mhz", "miles", "minutes", "ml", "mm", "months", "mph", "ms", "ounces", "oz", "percent",
    "pounds", "seconds", "tb", "tons", "v", "volts", "w", "watts", "weeks", "yards", "years",
)
# Number words and what they stand for, in natural order.
NUMBER_WORDS = dict(
    zero=0, one=1, two=2, three=3, four=4, five=5, six=6, seven=7, eight=8, nine=9, ten=10, eleven=11, twelve=12,
    thirteen=13, fourteen=14, fifteen=15, sixteen=16, seventeen=17, eighteen=18, nineteen=19, twenty=20, thirty=30,
    forty=40, fifty=50, sixty=60, seventy=70, eighty=80, ninety=90, hundred=100, thousand=1000, million=1_000_000,
)
#: Marks around a slot's value, and before a word that may be a name; these private code points are taken out of texts.
OPEN, CLOSE, MAYBE = "\ue000", "\ue001", "\ue002"
NUMBER = r"\p{Nd}+(?:[.,:/]\p{Nd}+)*"
NUMBER_WORD = "(?:" + "|".join(NUMBER_WORDS) + ")"
#: The same words by their first letter, and the first two letters: most places of a text are left at these.
BY_LETTER = "(?:" + "|".join(
    f"{letter}(?:{'|'.join(w[1:] for w in NUMBER_WORDS if w[0] == letter)})" for letter in sorted({w[0] for w in NUMBER_WORDS})
) + ")"
BEGIN = "".join(f"[{''.join(sorted({w[k] for w in NUMBER_WORDS}))}]" for k in (0, 1))
#: A run of number words, such as twenty-five or three hundred.
SPELLED = rf"(?i)(?={BEGIN})(?<![\p{{L}}\p{{M}}\p{{Nd}}]){BY_LETTER}(?:[ -]{BY_LETTER})*(?![\p{{L}}\p{{M}}\p{{Nd}}])"
UNIT = rf"(?<=[\p{{Nd}}{CLOSE}] ?)(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + r")(?![\p{L}\p{Nd}])"
NAME = rf"(?<=[\p{{Ll}}\p{{Nd}},;{CLOSE}] )\p{{Lu}}[\p{{L}}\p{{M}}]*"
#: The three slots. Names and units stand after one of a few characters (or the half of one): looked at first.
SLOT = rf"{NUMBER}|(?<=[ \p{{Nd}}\p{{Cs}}{CLOSE}])(?:(?=\p{{Lu}}){NAME}|{UNIT})"
CAPITAL = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{Nd}}{OPEN}])\p{{Lu}}[\p{{L}}\p{{M}}]*"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{Nd}}]+|[{OPEN}{MAYBE}][^{CLOSE}]*{CLOSE}"


def raw_tokens(text: Column, both: bool = False) -> Column:
    """Lower-cased tokens of a text; slots keep their value between the marks.

    both: words that may be names are marked as well.
    """
    marked = text.rlike(f"[{OPEN}{CLOSE}{MAYBE}]")
    plain = F.when(marked, F.translate(text, OPEN + CLOSE + MAYBE, "   ")).otherwise(text)
    spelled = F.regexp_replace(plain, SPELLED, f"{OPEN}$0{CLOSE}")
    slotted = F.regexp_replace(spelled, SLOT, f"{OPEN}$0{CLOSE}")
    if both:
        slotted = F.regexp_replace(slotted, CAPITAL, f"{MAYBE}$0{CLOSE}")
    return F.regexp_extract_all(F.lower(slotted), F.lit(TOKEN), F.lit(0))


def is_slot(token: Column) -> Column:
    return F.startswith(token, F.lit(OPEN))


def may_be_name(token: Column) -> Column:
    return F.startswith(token, F.lit(MAYBE))


def value_of(token: Column) -> Column:
    """A token without marks."""
    return F.translate(token, OPEN + CLOSE + MAYBE, "")


def slot_type(token: Column) -> Column:
    value = F.substring(token, 2, 64)
    unit = F.array_contains(F.array(*[F.lit(u + CLOSE) for u in UNITS]), value)
    number = value.rlike(rf"^\p{{Nd}}|^{NUMBER_WORD}[ -{CLOSE}]")
    return F.when(number, f"{OPEN}number").when(unit, f"{OPEN}unit").otherwise(f"{OPEN}name")


def templates(tokens: Column, names: bool = False) -> Column:
    """Hash of each token's template: the type of a slot, a word itself; words that may be names are, if asked for."""
    may = F.lit(f"{OPEN}name") if names else None

    def of_token(token: Column) -> Column:
        word = may if names else F.substring(token, 2, 2**31 - 1)
        read = F.when(is_slot(token), slot_type(token)).when(
            may_be_name(token), word if names else F.regexp_replace(word, CLOSE, "")
        )
        return F.xxhash64(read.otherwise(token))

    return F.transform(tokens, of_token)


def window_hash(tokens: str, size: int) -> Column:
    """Hash of the window that begins at ``place``, the same as that of an array of its tokens."""
    return F.xxhash64(*[F.get(F.col(tokens), F.col("place") + k) for k in range(size)])


def windows(rows: DataFrame, keys: tuple[str, ...], place: str, sizes: list[int]) -> DataFrame:
    """(keys, place, window hash) for each window, of any of the sizes, of rows (keys, text).

    A window whose readings as words and as names differ has a row for each. Places become rows before
    windows are hashed, so the hashes are columns in compiled code rather than parts of a lambda.
    """
    tokens = rows.select(*keys, raw_tokens(F.col("text"), both=True).alias("tokens"))
    read = tokens.select(*keys, templates(F.col("tokens")).alias("words"), templates(F.col("tokens"), True).alias("names"))
    begins = F.slice("words", 1, F.greatest(F.size("words") - min(sizes) + 1, F.lit(0)))
    at = read.select(*keys, "words", "names", F.posexplode(begins).alias("place", "first"))
    readings = []
    for size in sizes:
        word, name = window_hash("words", size), window_hash("names", size)
        whole = F.col("place") + size <= F.size("words")
        readings += [F.when(whole, word), F.when(whole & (word != name), name)]
    found = at.select(*keys, F.col("place").alias(place), F.explode(F.array(*readings)).alias("window"))
    return found.where("window IS NOT NULL")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, item_place, window hash) for each window of items (item, text); a shorter item is one window.

    What stands before an item in a document can make its first word a unit there, or the first of two
    names, so the first window has a second hash for that.
    """
    tokens = raw_tokens(F.col("text"), both=True)
    first = F.element_at("tokens", 1)
    unit = F.array_contains(F.array(*[F.lit(u) for u in UNITS]), first)
    slot = F.when(may_be_name(first), f"{OPEN}name").when(unit, f"{OPEN}unit")
    sized_items = items.select("item", "text", F.least(F.size(tokens), F.lit(window)).alias("length")).where("length > 0")
    began = (
        items.select("item", tokens.alias("tokens")).where(F.size("tokens") > 0)
        .select("item", slot.alias("slot"), F.slice(templates(F.col("tokens")), 2, window - 1).alias("rest"))
        .where("slot IS NOT NULL")
        .select(
            "item", F.lit(0).alias("item_place"),
            F.xxhash64(F.concat(F.array(F.xxhash64("slot")), F.col("rest"))).alias("window"),
        )
    )
    found = began
    for length in range(1, window + 1):
        found = found.unionByName(windows(sized_items.where(F.col("length") == length), ("item",), "item_place", [length]))
    return found.distinct()


def window_sizes(items: DataFrame, window: int) -> list[int]:
    """The window, and the lengths of the items that are shorter: at most ``window`` numbers."""
    lengths = items.select(F.size(raw_tokens(F.col("text"), both=True)).alias("length")).where(f"length BETWEEN 1 AND {window - 1}")
    return sorted({window, *(row.length for row in lengths.distinct().collect())})


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) of the items that have an id and a text, each once."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    ).distinct()


#: A text under an id, and the digest of an item's text.
PAIR = ("doc_id", "text_key", "item")


def aligned_runs(rows: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """(pair, shift, places): the item's windows that a text holds, each ``shift`` places further on."""
    keys = ("doc_id", "text_key")
    found = windows(rows, keys, "doc_place", sizes).withColumnRenamed("window", "seen")
    hits = found.join(sized(known), F.col("seen") == F.col("window"))
    return hits.groupBy(*PAIR, (F.col("doc_place") - F.col("item_place")).alias("shift")).agg(
        F.collect_set("item_place").alias("places")
    )


def covered_pairs(runs: DataFrame, sizes: DataFrame, least_covered: float) -> DataFrame:
    """(pair, n_windows) of the texts that hold enough of an item's windows at all, wherever they stand."""
    held = runs.select(*PAIR, F.explode("places").alias("place")).distinct().groupBy(*PAIR).agg(F.count("*").alias("held"))
    return (
        held.join(sizes, F.col("item") == F.col("sized_item"))
        .where(F.col("held") >= least_covered * F.col("n_windows"))
        .select(*PAIR, "n_windows")
    )


def occurrences(runs: DataFrame, covered: DataFrame, least_covered: float) -> DataFrame:
    """(pair, n_windows, matches): where a text may hold an item; enough of it each time.

    matches: (item_place, doc_place), an item's place at most once. An occurrence is one run; or runs
    one after another, where a text has more or fewer words than the item in between; or the first
    place of each window, where parts of the item stand apart or in another order.
    """
    wanted = covered.select(*[F.col(c).alias(f"c_{c}") for c in PAIR], "n_windows")
    same = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in PAIR]
    of_pairs = runs.join(wanted, same).select(*PAIR, "n_windows", "shift", "places")
    match = F.struct("item_place", "doc_place")
    single = of_pairs.select(
        *PAIR, "n_windows",
        F.transform(
            "places", lambda p: F.struct(p.alias("item_place"), (p + F.col("shift")).alias("doc_place"))
        ).alias("matches"),
    )
    hits = of_pairs.select(
        *PAIR, "n_windows", "shift", F.size("places").alias("support"), F.explode("places").alias("item_place")
    ).withColumn("doc_place", F.col("item_place") + F.col("shift"))
    firsts = (
        hits.groupBy(*PAIR, "n_windows", "item_place").agg(F.min("doc_place").alias("doc_place"))
        .groupBy(*PAIR, "n_windows").agg(F.collect_list(match).alias("matches"))
    )
    # Of several windows of the item at one place of the text, that of the longest run counts.
    best = hits.groupBy(*PAIR, "n_windows", "doc_place").agg(
        F.max(F.struct("support", (-F.abs("shift")).alias("near"), "item_place", "shift")).alias("best")
    ).select(*PAIR, "n_windows", "doc_place", "best.item_place", "best.shift")
    in_text = Window.partitionBy(*PAIR).orderBy("doc_place")
    begins = (
        F.lag("item_place").over(in_text).isNull()
        | (F.col("item_place") <= F.lag("item_place").over(in_text))
        | (F.abs(F.col("shift") - F.lag("shift").over(in_text)) > F.col("n_windows"))
    )
    chained = (
        best.withColumn("begins", begins.cast("int"))
        .withColumn("chain", F.sum("begins").over(in_text))
        .groupBy(*PAIR, "n_windows", "chain").agg(F.collect_list(match).alias("matches")).drop("chain")
    )
    return single.unionByName(chained).unionByName(firsts).where(
        F.size("matches") >= least_covered * F.col("n_windows")
    )


def canonical(value: Column) -> Column:
    """Number words below a hundred in digits, other values as they are."""
    known = F.create_map(*[F.lit(x) for word, n in NUMBER_WORDS.items() if n < 100 for x in (word, n)])
    numbers = F.transform(F.split(value, "[ -]"), lambda word: F.element_at(known, word))
    total = F.aggregate(numbers, F.lit(0), lambda sum, n: sum + n)
    tens = (F.size(numbers) == 1) | (F.size(numbers) == 2) & (F.get(numbers, F.lit(0)) >= 20) & (F.get(numbers, F.lit(1)) < 10)
    return F.when(total.isNotNull() & tens, total.cast("string")).otherwise(value)


def slot_pairs(window: int) -> Column:
    """Distinct (item value, document value, slot) of the slots and possible names in the matched windows."""
    def of_match(match: Column) -> Column:
        steps = F.sequence(F.lit(1), F.least(F.lit(window), F.size("item_tokens")))
        return F.transform(
            steps,
            lambda k: F.struct(
                F.element_at("item_tokens", match["item_place"] + k).alias("item"),
                F.element_at("doc_tokens", match["doc_place"] + k).alias("doc"),
            ),
        )

    pairs = F.flatten(F.transform("matches", of_match))
    slots = F.array_distinct(F.filter(pairs, lambda p: is_slot(p["item"]) | may_be_name(p["item"])))

    def described(p: Column) -> Column:
        item, doc = canonical(value_of(p["item"])), canonical(value_of(p["doc"]))
        return F.struct(item.alias("item"), doc.alias("doc"), (is_slot(p["item"]) | (item != doc)).alias("slot"))

    # A word that stands for itself, because it may be a name, counts for consistency but is no slot.
    return F.array_distinct(F.transform(slots, described))


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_covered: float = LEAST_COVERED
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, n_slots) for each document and item that it leaks.

    Null and empty texts leak nothing, nor does an item without words. Of rows with one id, null included,
    each text is looked at by itself. A document and an item have one line: that of the occurrence with
    the most windows; null-id texts have one for each of them.
    """
    return leaking_texts(docs, benchmark, window, least_covered).groupBy(
        "doc_id", "item_id", F.when(F.col("doc_id").isNull(), F.col("text_key")).alias("text_key")
    ).agg(F.max("most").alias("most")).select("doc_id", "item_id", "most.*")


def leaking_texts(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_covered: float = LEAST_COVERED
) -> DataFrame:
    """(doc_id, text_key, item_id, most) for each text, by id and hash, and item that it leaks.

    most: struct (n_matched, n_windows, n_slots).
    """
    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    items = benchmark_items(benchmark).select("item_id", F.xxhash64("text").alias("item"), "text")
    texts = items.select("item", "text").distinct()
    known = durable(item_windows(texts, window))
    sizes = known.groupBy(F.col("item").alias("sized_item")).agg(F.countDistinct("item_place").alias("n_windows"))
    runs = durable(aligned_runs(rows, known, window_sizes(texts, window)))
    covered = durable(covered_pairs(runs, sizes, least_covered))
    found = durable(occurrences(runs, covered, least_covered))
    same = F.col("doc_id").eqNullSafe(F.col("leaking")) & (F.col("text_key") == F.col("leaking_text"))
    holding = durable(found.select(F.col("doc_id").alias("leaking"), F.col("text_key").alias("leaking_text")).distinct())
    doc_tokens = rows.join(sized(holding), same).select(
        "leaking", "leaking_text", raw_tokens(F.col("text"), both=True).alias("doc_tokens")
    )
    item_tokens = texts.select(F.col("item").alias("known"), raw_tokens(F.col("text"), both=True).alias("item_tokens"))
    checked = (
        found.join(doc_tokens, same)
        .join(item_tokens, F.col("item") == F.col("known"))
        .select("doc_id", "text_key", "item", F.size("matches").alias("n_matched"), "n_windows", slot_pairs(window).alias("slots"))
    )
    # A value of the item stands for one value of the text; two of them may stand for the same.
    consistent = F.size(F.array_distinct("slots.item")) == F.size(
        F.array_distinct(F.transform("slots", lambda p: F.struct(p["item"], p["doc"])))
    )
    n_slots = F.size(F.filter("slots", lambda p: p["slot"])).alias("n_slots")
    most = (
        checked.where(consistent).groupBy("doc_id", "text_key", "item")
        .agg(F.max(F.struct("n_matched", "n_windows", n_slots)).alias("most"))
    )
    ids = items.select("item_id", F.col("item").alias("known"))
    return most.join(ids, F.col("item") == F.col("known")).select("doc_id", "text_key", "item_id", "most")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text leaks no item; other texts under the same id stay."""
    gone = durable(leaking_texts(docs, benchmark).select(F.struct("doc_id", "text_key").alias("leaking")).distinct())
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), mark.alias("text_key"))
    return docs.join(sized(gone), key == gone["leaking"], "left_anti")
