"""Personal data: pattern spans and information-theoretic sanitisation, in DataFrame functions only.

*Entities.* E-mail addresses, IP addresses, payment cards and telephone numbers are found by pattern.
A text is split at a pattern's matches; the lengths of the pieces and matches, summed within the text,
are the places. Only matches are shuffled, never texts.

*Disclosure.* Words near a mention may give its entity away although they are no personal data by
form. Over the whole corpus, counted in different texts, n(e,t) is how many texts that mention entity e
hold term t, of the terms that stand near e in some, and n(t) how many texts hold t at all. The
pointwise mutual information log2(n(e,t) * N / (n(e) * n(t))) and the posterior n(e,t) / n(t) say how
strongly the term reveals the entity. Terms over both thresholds are generalised, those over the higher
posterior are removed, wherever they stand in a text that mentions the entity, or in any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.rows import id_and_text, sized
from priorline.sources.durable import durable

# The base kinds in their order. The patterns match what the plain forms in the comments
# match, without trying again from inside a run: a match starts at the run's first character or where
# the match before ended (\G), and a run is taken whole.
KINDS = ("email", "ip", "card", "phone")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM_KINDS = ("generalised", "removed")
ORDER = {kind: k for k, kind in enumerate((*KINDS, *TERM_KINDS))}
TERM = r"\p{L}{3,}"
#: Code points on each side of a mention in which its terms are looked for.
REACH = 80
LEAST_TOGETHER, LEAST_BITS, LEAST_POSTERIOR, REMOVED_POSTERIOR = 3, 4.0, 0.5, 0.9
REPLACEMENTS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalised": "[TERM]", "removed": ""}


def matches(kind: str) -> Column:
    """Array of what the pattern matches in ``text``, with the piece before and the context around."""
    tried = F.col("text").rlike(HINTS[kind])
    found = F.when(tried, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)))
    pieces = F.when(tried, F.split("text", PATTERNS[kind], -1))
    return F.struct(found.alias("found"), pieces.alias("pieces"))


def spans_of(kind: str) -> Column:
    found, pieces = F.col(f"{kind}.found"), F.col(f"{kind}.pieces")
    described = F.transform(
        found,
        lambda value, k: F.struct(
            F.lit(kind).alias("kind"), k.alias("place"), value.alias("value"),
            F.length(F.element_at(pieces, k + 1)).alias("before"),
            F.right(F.element_at(pieces, k + 1), F.lit(REACH + 1)).alias("left"),
            F.left(F.element_at(pieces, k + 2), F.lit(REACH + 1)).alias("right"),
        ),
    )
    return F.coalesce(described, F.array().cast(
        "array<struct<kind:string,place:int,value:string,before:int,left:string,right:string>>"
    ))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    def step(total: Column, k: Column) -> Column:
        digit = F.substring(F.reverse(number), k, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(k % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) % 10 == 0


def holds(kind: Column, value: Column) -> Column:
    """The check of a kind on a matched value."""
    number = digits(value)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    in_range = F.forall(parts, lambda p: (F.length(p) < 4) & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(0)) <= 255))
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", in_range)
        .when(kind == "card", F.length(number).between(14, 19) & passes_luhn(F.substring(number, 1, 19)))
        .otherwise(F.length(number).between(10, 15))
    )


def entity_spans(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, kind, value, start, end, left, right) of every base span; rows: (doc_id, text).

    digest tells apart texts under one id; a repeated row counts once.
    """
    found = (
        rows.select("doc_id", F.xxhash64("text").alias("digest"), "text", *[matches(k).alias(k) for k in KINDS])
        .select("doc_id", "digest", F.explode(F.concat(*[spans_of(k) for k in KINDS])).alias("span"))
        .select("doc_id", "digest", "span.*")
        .dropDuplicates(["doc_id", "digest", "kind", "place"])
    )
    so_far = Window.partitionBy("doc_id", "digest", "kind").orderBy("place")
    end = F.sum(F.col("before") + F.length("value")).over(so_far)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.where(holds(F.col("kind"), F.col("value"))).select(
        "doc_id", "digest", "kind", "value", "start", "end", "left", "right"
    )


def terms_in(context: Column, cut_left: bool) -> Column:
    """(term, at, length) of the whole words of a context; words that its far end may have cut go."""
    words, pieces = F.regexp_extract_all(context, F.lit(TERM), F.lit(0)), F.split(context, TERM, -1)
    steps = F.sequence(F.lit(1), F.size(words))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<term:string,at:int,length:int>>").alias("out"))

    def step(state: Column, k: Column) -> Column:
        word, at = F.element_at(words, k), state["at"] + F.length(F.element_at(pieces, k))
        item = F.struct(F.lower(word).alias("term"), at.alias("at"), F.length(word).alias("length"))
        return F.struct((at + F.length(word)).alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    found = F.aggregate(steps, start, step)["out"]
    full = F.length(context) > REACH
    cut = (lambda t: t["at"] == 0) if cut_left else (lambda t: t["at"] + t["length"] == F.length(context))
    kept = F.filter(found, lambda t: ~(full & cut(t)))
    return F.when(F.size(words) > 0, kept).otherwise(F.array().cast("array<struct<term:string,at:int,length:int>>"))


def near_terms(spans: DataFrame) -> DataFrame:
    """(doc_id, digest, kind, value, term, start, end): words near each mention, with their place."""
    left = F.transform(
        terms_in(F.col("left"), True),
        lambda t: F.struct(t["term"].alias("term"), (F.col("start") - F.length("left") + t["at"]).alias("start"), t["length"].alias("length")),
    )
    right = F.transform(
        terms_in(F.col("right"), False),
        lambda t: F.struct(t["term"].alias("term"), (F.col("end") + t["at"]).alias("start"), t["length"].alias("length")),
    )
    return spans.select(
        "doc_id", "digest", "kind", "value", F.explode(F.concat(left, right)).alias("near")
    ).select(
        "doc_id", "digest", "kind", "value", "near.term", F.col("near.start").cast("long").alias("start"),
        (F.col("near.start") + F.col("near.length")).cast("long").alias("end"),
    )


def different_texts(rows: DataFrame) -> DataFrame:
    """(text) of rows, each once; only texts that stand in several rows are shuffled."""
    digest = F.xxhash64("text")
    repeated = durable(rows.groupBy(digest.alias("repeated")).agg(F.count("*").alias("n")).where("n > 1").select("repeated"))
    marked = rows.select(digest.alias("digest"), "text")
    known = sized(repeated)
    single = marked.join(known, F.col("digest") == F.col("repeated"), "left_anti").select("text")
    once = marked.join(known, F.col("digest") == F.col("repeated"), "left_semi").groupBy("digest").agg(
        F.first("text").alias("text")
    )
    return single.unionByName(once.select("text"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(held, n_term): in how many different texts each word stands; counted before anything is joined."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    return different_texts(rows).select(F.explode(words).alias("held")).groupBy("held").agg(F.count("*").alias("n_term"))


def revealing_terms(rows: DataFrame, near: DataFrame, spans: DataFrame) -> DataFrame:
    """(kind, value, term, verdict, bits, posterior) of the terms that reveal an entity."""
    together = (
        near.select("kind", "value", "term", "digest").distinct()
        .groupBy("kind", "value", "term").agg(F.count("*").alias("n_near"))
        .where(F.col("n_near") >= LEAST_TOGETHER)
    )
    together = durable(together)
    wanted = together.select(F.col("term").alias("wanted")).distinct()
    n_term = document_frequencies(rows).join(wanted, F.col("held") == F.col("wanted")).select("wanted", "n_term")
    n_entity = (
        spans.select("kind", "value", "digest").distinct()
        .groupBy(F.col("kind").alias("k"), F.col("value").alias("v")).agg(F.count("*").alias("n_entity"))
    )
    n_texts = rows.select(F.xxhash64("text").alias("digest")).distinct().agg(F.count("*").alias("n_texts"))
    # What cannot reach the thresholds goes before n_both is counted: it is at most n_term and n_entity.
    # n_near may be more than n_term, where a mention cuts a run of letters.
    counted = (
        together.join(n_term, F.col("term") == F.col("wanted"))
        .join(n_entity, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")))
        .join(F.broadcast(n_texts))  # one row
        .select("kind", "value", "term", "n_near", "n_term", "n_entity", "n_texts")
    )
    most = F.greatest("n_near", F.least("n_term", "n_entity"))
    candidates = durable(over_thresholds(counted.withColumn("n_both", most)).drop("n_both"))
    return over_thresholds(with_n_both(rows, spans, candidates)).select(
        "kind", "value", "term", "bits", "posterior",
        F.when(F.col("posterior") >= REMOVED_POSTERIOR, "removed").otherwise("generalised").alias("verdict"),
    )


def over_thresholds(counts: DataFrame) -> DataFrame:
    """The rows that reach both thresholds, with their posterior and bits."""
    posterior = F.col("n_both") / F.col("n_term")
    bits = F.log2(posterior * F.col("n_texts") / F.col("n_entity"))
    return counts.withColumn("posterior", posterior).withColumn("bits", bits).where(
        (F.col("posterior") >= LEAST_POSTERIOR) & (F.col("bits") >= LEAST_BITS)
    )


def with_n_both(rows: DataFrame, spans: DataFrame, candidates: DataFrame) -> DataFrame:
    """candidates (kind, value, term, counts) with the number of texts that hold both, near or far."""
    entity = ("kind", "value")
    plain = candidates.select("kind", "value", "term", "n_near", "n_term", "n_entity", "n_texts")
    pairs = durable(spans.select("digest", *entity).distinct().join(plain.select(*entity, "term"), list(entity)))
    per_text = durable(pairs.groupBy(F.col("digest").alias("g")).agg(F.collect_set("term").alias("terms")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    held = (
        rows.select(F.xxhash64("text").alias("digest"), "text").join(sized(per_text), F.col("digest") == F.col("g"))
        .select("g", F.explode(F.array_intersect(words, F.col("terms"))).alias("held")).distinct()
    )
    n_both = (
        pairs.join(held, (F.col("digest") == F.col("g")) & (F.col("term") == F.col("held")))
        .groupBy(*entity, "term").agg(F.count("*").alias("n_whole"))
    )
    return plain.join(n_both, [*entity, "term"], "left").withColumn("n_both", F.greatest("n_near", "n_whole"))


def everywhere(rows: DataFrame, revealing: DataFrame) -> DataFrame:
    """(g, t, verdict): the revealing terms that each text holds, whether it mentions the entity or not."""
    verdicts = durable(revealing.groupBy("t").agg(F.max("verdict").alias("verdict")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    held = rows.select(F.xxhash64("text").alias("g"), F.explode(words).alias("held"))
    return held.join(sized(verdicts), F.col("held") == F.col("t")).select("g", "t", "verdict").distinct()


def term_spans(rows: DataFrame, spans: DataFrame, revealing: DataFrame, all_texts: bool = False) -> DataFrame:
    """(doc_id, digest, start, end, verdict) of each place of a term in a text that mentions its entity.

    revealing: (k, v, t, verdict). all_texts: in the other texts, too. Only matches are shuffled: a text is
    split at its terms.
    """
    of_texts = everywhere(rows, revealing) if all_texts else (
        spans.select("digest", "kind", "value").distinct()
        .join(revealing, (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")))
        .groupBy(F.col("digest").alias("g"), "t").agg(F.max("verdict").alias("verdict"))
    )
    wanted = durable(
        of_texts.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("t", "verdict"))).alias("verdicts"))
    )
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))
    forms = F.filter(words, lambda w: F.map_contains_key(F.col("verdicts"), F.lower(w)))
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("forms", "|"), F.lit(r")(?!\p{L})"))
    pieces = (
        rows.select("doc_id", F.xxhash64("text").alias("digest"), "text")
        .join(sized(wanted), F.col("digest") == F.col("g"))
        .select("doc_id", "digest", "text", "verdicts", forms.alias("forms")).where(F.size("forms") > 0)
        .select("doc_id", "digest", "text", "verdicts", pattern.alias("pattern"))
        .select(
            "doc_id", "digest", "verdicts", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("found"),
            F.split("text", F.col("pattern"), -1).alias("pieces"),
        )
    )
    found = F.transform(
        "found",
        lambda w, k: F.struct(
            k.alias("place"), F.length(w).alias("length"), F.length(F.element_at("pieces", k + 1)).alias("before"),
            F.element_at("verdicts", F.lower(w)).alias("verdict"),
        ),
    )
    placed = pieces.select("doc_id", "digest", F.explode(found).alias("span")).select("doc_id", "digest", "span.*")
    so_far = Window.partitionBy("doc_id", "digest").orderBy("place")
    end = F.sum(F.col("before") + F.col("length")).over(so_far)
    return placed.dropDuplicates(["doc_id", "digest", "place"]).withColumn("end", end).select(
        "doc_id", "digest", (F.col("end") - F.col("length")).alias("start"), "end", "verdict"
    )


def all_spans(rows: DataFrame, all_texts: bool = False) -> DataFrame:
    """(doc_id, digest, kind, start, end) of entities and of their revealing terms, in the same or all texts."""
    spans = durable(entity_spans(rows))
    near = durable(near_terms(spans))
    revealing = durable(revealing_terms(rows, near, spans).select(
        F.col("kind").alias("k"), F.col("value").alias("v"), F.col("term").alias("t"), "verdict"
    ))
    same = (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")) & (F.col("term") == F.col("t"))
    # Beside a mention, a word may be part of a longer run of letters that the mention cuts.
    beside = near.join(revealing, same).select("doc_id", "digest", "start", "end", "verdict")
    found = beside.unionByName(term_spans(rows, spans, revealing, all_texts)).groupBy("doc_id", "digest", "start", "end").agg(
        F.max("verdict").alias("kind")
    )
    base = spans.select("doc_id", "digest", "kind", "start", "end")
    # A term inside a pattern span needs no treatment of its own.
    around = base.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("start").alias("s"), F.col("end").alias("e"))
    inside = (
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))
        & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))
    )
    terms = found.join(around, inside, "left_anti").select("doc_id", "digest", "kind", "start", "end")
    return base.unionByName(terms)


def rendered(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def spans_by_text(rows: DataFrame, all_texts: bool = False) -> DataFrame:
    """(d, g, spans): the sorted spans of each text that has any, as structs (start, rank, kind, end)."""
    ranks = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    span = F.struct("start", F.element_at(ranks, F.col("kind")).alias("rank"), "kind", "end")
    return all_spans(rows, all_texts).groupBy(F.col("doc_id").alias("d"), F.col("digest").alias("g")).agg(
        F.sort_array(F.collect_list(span)).alias("spans")
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def find_personal_data(docs: DataFrame, all_texts: bool = False) -> DataFrame:
    """One line per row: doc_id, counts of base kinds, digest of the base spans, all spans, n_terms.

    all_texts: revealing terms are treated wherever they stand, not only beside a mention of their entity
    in the same text.
    Null and empty texts have no spans. Repeated rows, null ids and different texts under one id each
    give a line of their own.
    """
    rows = id_and_text(docs)
    found = spans_by_text(rows, all_texts)
    keys = rows.select("doc_id", F.xxhash64("text").alias("digest"))
    joined = keys.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,rank:int,kind:string,end:long>>"))
    listed = joined.select("doc_id", spans.alias("spans")).withColumn(
        "base", F.filter("spans", lambda s: s["rank"] < len(KINDS))
    )
    return listed.select(
        "doc_id",
        *[count_of(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(rendered("base"), 256).alias("base_sha256"),
        rendered("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_terms"),
    )


def sanitised(docs: DataFrame, all_texts: bool = False) -> DataFrame:
    """(doc_id, text) of every row with its spans replaced: entities and terms by a class, or nothing.

    all_texts: as in ``find_personal_data``.
    Of overlapping spans the first is replaced, together with what the others reach beyond it.
    """
    rows = id_and_text(docs)
    replaced = F.create_map(*[F.lit(x) for pair in REPLACEMENTS.items() for x in pair])
    joined = rows.join(
        spans_by_text(rows, all_texts), F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("g")), "left"
    )

    def step(state: Column, span: Column) -> Column:
        start, end = span["start"].cast("int"), span["end"].cast("int")
        between = F.substring(F.col("text"), state["at"] + 1, F.greatest(start - state["at"], F.lit(0)))
        put = F.when(start >= state["at"], F.element_at(replaced, span["kind"])).otherwise("")
        return F.struct(F.greatest(state["at"], end).alias("at"), F.concat(state["out"], between, put).alias("out"))

    state = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.expr("substring(text, state.at + 1)")
    return joined.withColumn("state", state).select(
        "doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.col("state.out"), rest)).alias("text")
    )
