"""Document fingerprints by content-defined chunking.

A gear hash rolls over the code points of a text; a chunk ends where its low bits are zero. The cut
is normalised: up to the normal length a stricter mask applies, after it a looser one, so lengths
gather around the normal length. Chunks depend on nearby text only, so an insertion shifts no
boundary that lies further on. A fingerprint is the set of chunk digests, each with its length;
containment is the weighted share of one set that the other holds.

The gear hash of 32 bits forgets a code point after 32 steps, so it is computed for a whole text at
once with five shifted additions (numpy), in memory proportional to that one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.rows import id_and_text

SHORTEST, NORMAL, LONGEST = 12, 32, 128
STRICT_BITS, LOOSE_BITS = 6, 4
FIRST_KEY = -(2**63)


def gear_values(points: np.ndarray) -> np.ndarray:
    """A fixed random-looking 32-bit number for each code point (an integer mixing function)."""
    x = points.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> np.uint32(shift))) * np.uint32(factor)
    return x ^ (x >> np.uint32(16))


def gear_hash(points: np.ndarray) -> np.ndarray:
    """At each position, the sum of the last 32 gear values, each shifted by its distance."""
    rolled = gear_values(points)
    width = 1
    while width < 32:
        further = rolled.copy()
        further[width:] += rolled[:-width] << np.uint32(width)
        rolled = further
        width *= 2
    return rolled


def boundaries(points: np.ndarray) -> list[int]:
    """Ends of the chunks; the last is the length of the text."""
    # The top bits depend on the most code points.
    top = gear_hash(points)
    loose = np.flatnonzero(top >> np.uint32(32 - LOOSE_BITS) == 0) + 1
    strict = (top[loose - 1] >> np.uint32(32 - STRICT_BITS) == 0).tolist()
    n, start, ends = len(points), 0, []
    places = loose.tolist()
    k, last = 0, len(places)
    while start < n:
        end = min(start + LONGEST, n)
        while k < last and places[k] < start + SHORTEST:
            k += 1
        j = k
        while j < last and places[j] <= end:
            if strict[j] or places[j] >= start + NORMAL:
                end = places[j]
                break
            j += 1
        ends.append(end)
        start, k = end, j
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Digest of each distinct chunk, with its length in code points."""
    if not text:
        return {}
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found, start = {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in boundaries(points):
        found[digest(text[start:end].encode("utf-8", "surrogatepass"))] = end - start
        start = end
    return found


def render(chunks: dict[int, int]) -> str:
    """``digest:length`` by digest, joined by commas."""
    return ",".join(f"{digest:016x}:{length}" for digest, length in sorted(chunks.items()))


def containment(own: dict[int, int], other: dict[int, int]) -> float:
    """Share of the own chunks' length that the other holds; two empty sets contain each other."""
    if not own:
        return 0.0 if other else 1.0
    return sum(own[digest] for digest in own.keys() & other.keys()) / sum(own.values())


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One line per row: doc_id and its fingerprint. Null and empty texts have the empty fingerprint."""

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "fingerprint": [render(chunk_set(t)) for t in batch["text"]]}
            )

    return id_and_text(docs, id_column, text_column).mapInPandas(compute, "doc_id long, fingerprint string")


def with_next(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt into buckets of neighbouring ids, each followed by its successor.

    Bucket bounds are ids of the table, at equal ranks. The first rows of a bucket are copied to the
    end of the one before (``tail``), those of the first to the last, so no row needs another
    bucket. A text is shuffled once. Null ids come first.
    """
    spark = rows.sparkSession
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(FIRST_KEY)))
    ranks = [k / count for k in range(1, count)]
    bounds = sorted(set(keyed.approxQuantile("key", ranks, 0.25 / count)))
    lowest = keyed.agg(F.min("key")).first()[0]
    # approxQuantile answers in doubles; an id that a double cannot hold only moves a bound.
    starts = np.array([FIRST_KEY, *sorted({int(b) for b in bounds if int(b) > (lowest or 0)})], dtype=np.int64)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, key.to_numpy(), side="right") - 1, dtype="int32")

    bucketed = keyed.withColumn("bucket", bucket_of("key"))
    heads = bucketed.groupBy("bucket").agg(F.min("key").alias("head"))
    found = sorted((row["head"], row["bucket"]) for row in heads.collect())
    head_keys = np.array([head for head, _ in found], dtype=np.int64)
    before = {head: found[k - 1][1] for k, (head, _) in enumerate(found)}

    @F.pandas_udf("int")
    def copy_for(key: pd.Series) -> pd.Series:
        """The bucket that also needs this row; null for all but heads."""
        is_head = np.isin(key.to_numpy(), head_keys)
        return pd.Series([before[k] if h else None for k, h in zip(key, is_head)], dtype="Int32")

    own = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    copy = F.struct(F.col("copy").alias("bucket"), F.lit(True).alias("tail"))
    return (
        bucketed.withColumn("copy", copy_for("key"))
        .withColumn("place", F.explode(F.when(F.col("copy").isNull(), F.array(own)).otherwise(F.array(own, copy))))
        .select("doc_id", "text", "key", "place.bucket", "place.tail")
        .repartition(count // 4, "bucket")
        .sortWithinPartitions("bucket", "tail", "key", "text")
    )


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edit with the next document's beginning, and likenesses.

    Order is by id (null ids first), equal ids by text; the first row follows the last. A table of one
    row is its own successor. Repeated rows give one line each; an empty table gives none. An empty
    text has the empty fingerprint, and its likeness to another empty text is 1.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def line(key, text, chunks, following, next_chunks):
        changed = edited(text, following)
        changed_chunks = chunk_set(changed)
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (
            key, len(text), digest, render(chunks), render(changed_chunks),
            containment(chunks, changed_chunks), containment(chunks, next_chunks),
        )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lines = []
            columns = (batch.column(c) for c in ("doc_id", "text", "bucket", "tail"))
            for row in zip(*columns):
                key, text, bucket, tail = (value.as_py() for value in row)
                if tail and (held is None or held[0] != bucket):
                    continue  # a further row of a head with several rows
                chunks = chunk_set(text)
                if held is not None and held[0] == bucket:
                    lines.append(line(*held[1:], text, chunks))
                held = None if tail else (bucket, key, text, chunks)
            if lines:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*lines), arrow)], schema=arrow
                )

    arrow = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ]
    )
    rows = id_and_text(docs, id_column, text_column)
    return with_next(rows).mapInArrow(compute, schema)
