"""SuperMinHash near-duplicate detection.

A text is the set of its five-word shingles; a shorter text is one shingle. Texts of the same words are
copies, and a digest of the words stands for them everywhere: ids come in at the very end, so repeated
and null ids lose nothing.

1. *Signatures.* Each shingle deals its ranks to the ``REGISTERS`` registers in the order of a permutation
   of its own: in step j it gives one more register a rank between j and j + 1, and a register keeps the
   smallest. Ranks of one shingle are correlated, which lowers the variance, and once no register holds a
   rank beyond j, later steps cannot change any: long texts stop after a step or two.
2. *Banding.* Texts that agree in a band of registers meet in a cell; cells are bounded. Pairs whose whole
   signatures are far from the threshold are left out, and the others are linked to one row each.
3. *Verification.* In each linked group, all sets are compared exactly with that of the group's smallest
   digest. Only sets that do not match it are compared with the others, in cells of bounded size.
4. *Components* of the confirmed links, and the smallest id in each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.components import connected_components
from priorline.llm.rows import id_and_text, pairs_of, sized
from priorline.llm.similarity import (
    WordHashes, cells_of, joined_labels, meet, mixed, near_hub, signed, similar_rows, whole_cells,
)
from priorline.sources.durable import durable

WORDS, THRESHOLD = 5, 0.85
#: Registers of a signature, and of one band: a pair at the threshold shares a band with 1 - (1 - 0.85**5)**20,
#: all but eight of a million.
REGISTERS, BAND = 100, 5
#: Signatures that agree this much less than the threshold are left out: 4.5 standard errors of plain minima.
MARGIN = 0.16
#: A band that more texts share is cut into blocks of about so many.
CELL_TEXTS = 5_000
#: Bytes of text whose words are held at a time; a longer text is read in pieces.
BYTES_AT_ONCE = 400_000
#: Shingles whose permutations are held at a time.
SHINGLES_AT_ONCE = 50_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class ByteWordHashes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def pieces(data: bytes) -> Iterator[bytes]:
    """The data in pieces that end at white space."""
    at = 0
    while at < len(data):
        end = SPACE.search(data, at + BYTES_AT_ONCE)
        stop = end.end() if end else len(data)
        yield data[at:stop]
        at = stop


def shingles(text: str, hashes: ByteWordHashes) -> tuple[np.ndarray, bytes]:
    """(distinct shingle hashes, sorted; digest of the words). Only A-Z are lower-cased."""
    digest, found = xxhash.xxh3_128(), []
    for piece in pieces(text.encode("utf-8", "surrogatepass")):
        words = piece.lower().split()
        digest.update(b" ".join([*words, b""]))
        found.append(hashes.of(words))
    tokens = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
    if not len(tokens):
        return tokens, digest.digest()
    width = min(WORDS, len(tokens))
    value = np.zeros(len(tokens) - width + 1, dtype=np.uint64)
    for k in range(width):
        value = mixed(value + tokens[k : len(tokens) - width + 1 + k], 70 + k)
    return np.unique(value), digest.digest()


def super_minhash(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The registers (texts, REGISTERS) of texts with so many of the values each: step and rank as one number."""
    out = np.full((len(counts), REGISTERS), 2**64 - 1, dtype=np.uint64)
    flat = out.reshape(-1)
    owners = np.repeat(np.arange(len(counts)), counts)
    for start in range(0, len(values), SHINGLES_AT_ONCE):
        part, owner = values[start : start + SHINGLES_AT_ONCE], owners[start : start + SHINGLES_AT_ONCE]
        texts = slice(owner[0], owner[-1] + 1)
        order = np.tile(np.arange(REGISTERS, dtype=np.uint8), (len(part), 1))
        active = np.arange(len(part))
        for step in range(REGISTERS):
            # The largest rank of each text; where it lies below this step, the text is done.
            top = out[texts].max(axis=1) >> np.uint64(48)
            active = active[top[owner[active] - owner[0]] >= step]
            if not len(active):
                break
            draw = mixed(part[active], 100 + step)
            other = step + (draw % np.uint64(REGISTERS - step)).astype(np.int64)
            register = order[active, other].astype(np.int64)
            order[active, other] = order[active, step]
            rank = np.uint64(step << 48) | (draw >> np.uint64(16))
            np.minimum.at(flat, owner[active] * REGISTERS + register, rank)
    return out


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers as 16-bit numbers; two texts without shingles have equal ones."""
    return (mixed(super_minhash(values, counts), 71) >> np.uint64(48)).astype(np.uint16)


def signed_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, copy, size, signature) of each row; mark: hash of the text, copy: digest of its words."""

    def described(held: list[tuple], hashes: ByteWordHashes) -> pa.RecordBatch:
        sets = [shingles(text, hashes) for _, _, text in held]
        counts = np.array([len(values) for values, _ in sets], dtype=np.int64)
        found = signatures(np.concatenate([values for values, _ in sets]), counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([key for key, *_ in held], pa.int64()), pa.array([mark for _, mark, _ in held], pa.int64()),
                pa.array([digest for _, digest in sets], pa.binary()), pa.array(counts),
                pa.array([row.tobytes() for row in found], pa.binary()),
            ],
            names=["doc_id", "mark", "copy", "size", "signature"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = ByteWordHashes(), [], 0
        for batch in batches:
            for (key, text), mark in zip(pairs_of(batch), batch.column("mark").to_pylist()):
                held.append((key, mark, text))
                size += len(text)
                if size >= BYTES_AT_ONCE:
                    yield described(held, hashes)
                    held, size = [], 0
        if held:
            yield described(held, hashes)

    marked = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return marked.mapInArrow(run, "doc_id long, mark long, copy binary, size long, signature binary")


def registers_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(value.as_py() for value in column), dtype=np.uint16).reshape(-1, REGISTERS)


def bands(texts: DataFrame) -> DataFrame:
    """(band, copy): a row for each band of each text's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = registers_of(batch.column("signature")).reshape(-1, REGISTERS // BAND, BAND)
            value = np.broadcast_to(np.arange(REGISTERS // BAND, dtype=np.uint64), labels.shape[:2])
            for k in range(BAND):
                value = mixed(value + labels[:, :, k], 72 + k)
            copies = batch.column("copy").take(np.repeat(np.arange(len(labels)), REGISTERS // BAND))
            yield pa.RecordBatch.from_arrays([pa.array(signed(value.ravel())), copies], names=["band", "copy"])

    return texts.select("copy", "signature").mapInArrow(run, "band long, copy binary")


def band_links(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links among the texts of a cell whose signatures are alike, one for each row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            cell, side = (rows.column(c).to_numpy() for c in ("cell", "side"))
            labels, copies = registers_of(rows.column("signature")), rows.column("copy").combine_chunks()

            def plausible(u: np.ndarray, v: np.ndarray) -> np.ndarray:
                out = np.zeros(len(u), dtype=bool)
                for start in range(0, len(u), 20_000):  # bounds the comparison's memory
                    a, b = u[start : start + 20_000], v[start : start + 20_000]
                    alike = (labels[a] == labels[b]).mean(axis=1) >= threshold - MARGIN
                    out[start : start + 20_000] = alike & ((side[a] < 0) | (side[a] != side[b]))
                return out

            found = meet(cell, plausible)
            apart = np.flatnonzero(found != np.arange(len(found)))
            if len(apart):
                yield pa.RecordBatch.from_arrays([copies.take(apart), copies.take(found[apart])], names=["a", "b"])

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def candidate_links(texts: DataFrame, threshold: float) -> DataFrame:
    """Links among texts that share a band; texts: (copy, signature), one row for each copy."""
    index = bands(texts)
    met = index.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("band").alias("shared"), F.ceil(F.col("n") / CELL_TEXTS).cast("int").alias("blocks")
    )
    placed = index.join(met, F.col("band") == F.col("shared")).withColumn(
        "block", F.expr("CAST(pmod(xxhash64(copy), blocks) AS int)")
    )
    split = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(F.col("blocks") == 1, F.col("band"))
        .otherwise(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"),
        F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"),
        F.col("copy").alias("c"),
    )
    return band_links(split.join(texts, F.col("c") == F.col("copy")).drop("c"), threshold)


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, component, size, elements): the sets of the wanted texts (d, m: id and hash of one, copy, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = ByteWordHashes(), set()
        for batch in batches:
            for k, copy in enumerate(batch.column("copy").to_pylist()):
                if copy in done:  # a repeated row
                    continue
                if len(done) >= 100_000:
                    done.clear()
                done.add(copy)
                values, _ = shingles(batch.column("text")[k].as_py(), hashes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([copy], pa.binary()), batch.column("component").slice(k, 1),
                        pa.array([len(values)], pa.int64()), pa.array([values.tobytes()], pa.binary()),
                    ],
                    names=["id", "component", "size", "elements"],
                )

    marked = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    same = (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d"))
    found = marked.join(sized(wanted), same).select("text", "copy", "component")
    return found.mapInArrow(run, "id binary, component binary, size long, elements binary").dropDuplicates(["id"])


def confirmed_links(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): exact links that connect what the similar pairs of each component connect."""
    hubs = sets.where("id = component").select(F.col("id").alias("hub"), F.col("elements").alias("hub_elements"))
    others = sets.where("id <> component").join(hubs, F.col("component") == F.col("hub"))
    judged = durable(near_hub(others, threshold, "id binary, component binary, size long"))
    hub_rows = sets.where("id = component").select("id", "component", "size", F.lit(True).alias("core"))
    members = judged.select("id", "component", "size", F.col("near").alias("core")).unionByName(hub_rows)
    cells = cells_of(members, sets.select("id", F.lit(0).alias("rank"), "elements"))
    direct = judged.where("near").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return direct.unionByName(cell_links(cells, threshold))


def cell_links(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b): in each cell, a link for each text that similar pairs join to another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            rows = rows.combine_chunks()
            ids, found = rows.column("id").combine_chunks(), np.arange(rows.num_rows)
            for i, j in similar_rows(rows, threshold):
                found = joined_labels(found, i, j)
            apart = np.flatnonzero(found != np.arange(len(found)))
            if len(apart):
                yield pa.RecordBatch.from_arrays([ids.take(apart), ids.take(found[apart])], names=["a", "b"])

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One line per row of docs: doc_id, n_shingles, component_id, kept.

    component_id: the smallest id that links lead to, the row's own included. kept: whether it is the
    row's. Null texts and texts without words have no shingles and no links, not even with each other.
    Rows with the same words are linked whatever their ids; rows that repeat an id with another text are
    rows of their own. A null id is never the smallest: a null-id row has the smallest other id of its
    component, or null, and is kept then.
    """
    rows = id_and_text(docs)
    texts = durable(signed_texts(rows))
    some = texts.where("size > 0")
    copies = durable(
        some.groupBy("copy").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "mark")).alias("place"))
    )
    distinct = durable(some.select("copy", "signature").dropDuplicates(["copy"]))
    components = durable(connected_components(candidate_links(distinct, threshold)))
    wanted = durable(
        copies.join(components, F.col("copy") == F.col("node"))
        .select(F.col("place.doc_id").alias("d"), F.col("place.mark").alias("m"), "copy", "component")
    )
    links = confirmed_links(durable(shingle_sets(rows, wanted)), threshold)
    classes = durable(connected_components(links))
    least = (
        copies.join(classes, F.col("copy") == F.col("node")).groupBy("component").agg(F.min("first").alias("least"))
        .select(F.col("component").alias("of"), "least")
    )
    of_copy = (
        copies.join(classes, F.col("copy") == F.col("node"), "left").join(least, F.col("component") == F.col("of"), "left")
        .select(F.col("copy").alias("c"), F.when(F.col("of").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    )
    joined = texts.select("doc_id", "size", "copy").join(of_copy, F.col("copy") == F.col("c"), "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
