"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A text is the set of its five-word shingles (lower-cased words; a shorter text is one shingle). Texts
with the same words are copies, and a digest of the words stands for them everywhere; ids come in at the
end, so texts under repeated or null ids are told apart. A signature of 128
minima is cut into 16 trees of depth 8. In each tree the signatures are sorted, so that texts with a
common prefix lie together: a trie. Matched prefixes are shortened step by step, longest first, until
the recall at the threshold reaches the target: a pair of similarity s shares a prefix of length d in
one of l trees with probability 1 - (1 - s^d)^l. Rows joined at a longer prefix are not compared again
at a shorter one, and pairs whose signatures are far from the threshold are left out.

The links so found make components; the shingle sets of their texts are compared exactly in cells of
bounded size, in which every pair of a component meets once. Counts and one link for each text leave
a cell, not its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.components import connected_components
from priorline.llm.rows import id_and_text, sized
from priorline.llm.similarity import (
    WordHashes, cells_of, joined_labels, meet, mixed, signed, similar_rows, whole_cells,
)
from priorline.sources.durable import durable

WORD = re.compile(r"\w+")
WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH = 16, 8
TARGET_RECALL = 0.999
#: Signatures that agree this much less than the threshold are left out: 4.5 standard errors.
MARGIN = 0.16
#: A prefix that more texts share is cut into blocks of about so many.
CELL_TEXTS = 5_000
#: Texts that a task remembers so as to read a repeated one once.
DONE = 100_000
CHARS_AT_ONCE = 400_000


def prefix_depth(threshold: float, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix, shortened from the full depth, at which the recall reaches the target."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def shingles(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashed shingles of all texts, their number for each text, and a digest of each text's words."""
    words, sizes, digests = [], [], []
    for text in texts:
        found = WORD.findall(text.lower())
        words += found
        sizes.append(len(found))
        digests.append(xxhash.xxh3_128_digest(" ".join(found).encode("utf-8", "surrogatepass")))
    sizes = np.array(sizes, dtype=np.int64)
    tokens = hashes.of(words)
    padded = np.append(tokens, np.zeros(WORDS, dtype=np.uint64))
    starts = np.cumsum(sizes) - sizes
    counts = np.where(sizes == 0, 0, np.maximum(sizes - WORDS + 1, 1))
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    room = np.repeat(np.minimum(sizes, WORDS), counts)
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(WORDS):
        word = np.where(k < room, padded[at + k], np.uint64(0))
        value = mixed(value + word, 10 + k)
    return value, counts, digests


def signatures(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of TREES * DEPTH 16-bit numbers for each text: hashed minima; texts without shingles get zeros."""
    out = np.zeros((len(counts), TREES * DEPTH), dtype=np.uint16)
    some = counts > 0
    if not some.any():
        return out
    starts = (np.cumsum(counts) - counts)[some]
    factors = mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64), 99) | np.uint64(1)
    for k, factor in enumerate(factors):
        lowest = np.minimum.reduceat((values * factor) >> np.uint64(24), starts)
        out[some, k] = (mixed(lowest, 7) >> np.uint64(48)).astype(np.uint16)
    return out


def text_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[str]]]:
    """(id, mark) of rows and their texts, about CHARS_AT_ONCE characters at a time."""
    keys, texts, chars = [], [], 0
    for batch in batches:
        for key, mark, text in zip(*(batch.column(c) for c in ("doc_id", "mark", "text"))):
            keys.append((key.as_py(), mark.as_py()))
            texts.append(text.as_py())
            chars += len(texts[-1])
            if chars >= CHARS_AT_ONCE:
                yield keys, texts
                keys, texts, chars = [], [], 0
    if texts:
        yield keys, texts


def signed_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, copy, size, signature) of rows (doc_id, mark, text).

    mark: hash of the text; copy: digest of the words; size: number of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for keys, texts in text_chunks(batches):
            values, counts, digests = shingles(texts, hashes)
            found = signatures(values, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.array(column, pa.int64()) for column in zip(*keys)], pa.array(digests, pa.binary()),
                    pa.array(counts, pa.int64()), pa.array([row.tobytes() for row in found], pa.binary()),
                ],
                names=["doc_id", "mark", "copy", "size", "signature"],
            )

    return rows.mapInArrow(run, "doc_id long, mark long, copy binary, size long, signature binary")


def labels_of(column: pa.Array) -> np.ndarray:
    """Signatures as an array (texts, trees, depth)."""
    joined = b"".join(value.as_py() for value in column)
    return np.frombuffer(joined, dtype=np.uint16).reshape(-1, TREES, DEPTH)


def packed(parts: np.ndarray) -> np.ndarray:
    """Columns of 16-bit numbers as one 64-bit number (up to four) or a hash of them, for each row."""
    value = np.zeros(parts.shape[:-1], dtype=np.uint64)
    for k in range(parts.shape[-1]):
        value = (value << np.uint64(16)) ^ parts[..., k] if parts.shape[-1] <= 4 else mixed(value + parts[..., k], 20 + k)
    return value


def forest(signed_rows: DataFrame, depth: int) -> DataFrame:
    """(cell, id): the trie nodes of the given depth in which each text lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = labels_of(batch.column("signature"))
            node = mixed(packed(labels[:, :, :depth]) + np.arange(TREES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 6)
            tree = np.tile(np.arange(TREES, dtype=np.int32), len(labels))
            ids = batch.column("copy").take(np.repeat(np.arange(len(labels)), TREES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(node.ravel())), pa.array(tree), ids], names=["node", "tree", "id"]
            )

    return signed_rows.select("copy", "signature").mapInArrow(run, "node long, tree int, id binary")


def trie_links(nodes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(a, b): links between texts that share a prefix and have similar signatures.

    nodes: (cell, tree, side, id, signature). In a cell, rows are sorted by the rest of their label, and
    prefixes are shortened from the full label to the cell's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            cells, tree, side = (rows.column(c).to_numpy() for c in ("cell", "tree", "side"))
            labels = labels_of(rows.column("signature"))
            own = labels[np.arange(len(cells)), tree]
            order = np.lexsort([*own.T[::-1], cells])
            ids = rows.column("id").combine_chunks().take(order)
            cells, side, labels, own = cells[order], side[order], labels[order], own[order]
            flat = labels.reshape(len(ids), -1)

            def plausible(u: np.ndarray, v: np.ndarray) -> np.ndarray:
                out = np.zeros(len(u), dtype=bool)
                for start in range(0, len(u), 50_000):  # bounds the comparison's memory
                    a, b = u[start : start + 50_000], v[start : start + 50_000]
                    alike = (flat[a] == flat[b]).mean(axis=1) >= threshold - MARGIN
                    out[start : start + 50_000] = alike & ((side[a] < 0) | (side[a] != side[b]))
                return out

            found = np.arange(len(ids))
            for length in range(DEPTH, depth - 1, -1):
                prefix = mixed(cells.view(np.uint64) + packed(own[:, :length]), 8)
                linked = meet(prefix, lambda u, v: (found[u] != found[v]) & plausible(u, v))
                found = joined_labels(found, np.arange(len(ids)), linked)
            apart = np.flatnonzero(found != np.arange(len(ids)))
            if len(apart):
                yield pa.RecordBatch.from_arrays([ids.take(apart), ids.take(found[apart])], names=["a", "b"])

    spark = nodes.sparkSession
    dealt = nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def candidate_links(signed_rows: DataFrame, threshold: float) -> DataFrame:
    """Links among texts in trie nodes of the depth that reaches the target recall; rows: (copy, signature)."""
    depth = prefix_depth(threshold)
    index = forest(signed_rows, depth)
    met = index.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("node").alias("shared"), F.ceil(F.col("n") / CELL_TEXTS).cast("int").alias("blocks")
    )
    block = F.expr("CAST(pmod(xxhash64(id), blocks) AS int)")
    placed = index.join(met, F.col("node") == F.col("shared")).withColumn("block", block)
    split = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.when(F.col("blocks") == 1, F.col("node"))
        .otherwise(F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))).alias("cell"),
        "tree",
        F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"),
        "id",
    )
    nodes = split.join(signed_rows.select("copy", "signature"), F.col("id") == F.col("copy")).drop("copy")
    return trie_links(nodes, depth, threshold)


def shingle_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, component, size, elements): distinct shingles, sorted, of the wanted texts.

    wanted: (d, m, copy, component), with id and mark of one of a copy's rows. A task leaves out rows that
    repeat a text it has had.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, done = WordHashes(), set()
        for batch in batches:
            names, components = batch.column("copy").to_pylist(), batch.column("component").to_pylist()
            lengths = pc.utf8_length(batch.column("text")).to_pylist()
            held, chars = [], 0
            for k, name in enumerate(names):
                if name not in done:
                    if len(done) >= DONE:
                        done.clear()
                    done.add(name)
                    held.append(k)
                    chars += lengths[k]
                if held and (chars >= CHARS_AT_ONCE or k == len(names) - 1):
                    values, counts, _ = shingles([batch.column("text")[j].as_py() for j in held], hashes)
                    sets = [np.unique(part) for part in np.split(values, np.cumsum(counts)[:-1])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([names[j] for j in held], pa.binary()), pa.array([components[j] for j in held], pa.binary()),
                            pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                        ],
                        names=["id", "component", "size", "elements"],
                    )
                    held, chars = [], 0

    same = (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d"))
    found = rows.join(sized(wanted), same).select("text", "copy", "component")
    return found.mapInArrow(run, "id binary, component binary, size long, elements binary").dropDuplicates(["id"])


def verified(cells: DataFrame, threshold: float) -> DataFrame:
    """(id, n, root): in each cell, a text's number of similar texts and a text that it is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            rows = rows.combine_chunks()
            ids = rows.column("id").combine_chunks()
            found, counts = np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64)
            for i, j in similar_rows(rows, threshold):
                counts += np.bincount(i, minlength=len(ids))
                found = joined_labels(found, i, j)
            linked = np.flatnonzero(counts)
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(linked), pa.array(counts[linked]), ids.take(found[linked])],
                    names=["id", "n", "root"],
                )

    spark = cells.sparkSession
    dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "id binary, n long, root binary")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text); mark: hash of the text."""
    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def classified(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, mark, copy), and what holds of each copy.

    rows: (doc_id, mark, text). The second table: c (the copy), copy_id, class_id, n_copies, n_links, and
    stays, the row (no_id, doc_id, mark) that stands for the class: that of the smallest id, null last.
    """
    texts = durable(signed_texts(rows))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    copies = durable(texts.groupBy("copy").agg(F.min(place).alias("first"), F.count("*").alias("n_copies")))
    distinct = durable(texts.where("size > 0").select("copy", "signature").dropDuplicates(["copy"]))
    components = durable(connected_components(candidate_links(distinct, threshold)))
    wanted = durable(
        copies.join(components, F.col("copy") == F.col("node"))
        .select(F.col("first.doc_id").alias("d"), F.col("first.mark").alias("m"), "copy", "component")
    )
    sets = durable(shingle_sets(rows, wanted))
    members = sets.select("id", "component", "size", F.lit(False).alias("core"))
    found = durable(verified(cells_of(members, sets.select("id", F.lit(0).alias("rank"), "elements")), threshold))
    links = found.groupBy(F.col("id").alias("linked")).agg(F.sum("n").alias("n_links"))
    classes = durable(connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    placed = copies.join(classes, F.col("copy") == F.col("node"), "left").select(
        F.col("copy").alias("c"), "first", "n_copies", "component"
    )
    firsts = placed.where("component IS NOT NULL").groupBy(F.col("component").alias("of")).agg(F.min("first").alias("stays"))
    of_copy = (
        placed.join(firsts, F.col("component") == F.col("of"), "left")
        .join(links, F.col("c") == F.col("linked"), "left")
        .select(
            "c", F.col("first.doc_id").alias("copy_id"), F.coalesce("stays", "first").alias("stays"), "n_copies",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
        .withColumn("class_id", F.col("stays.doc_id"))
    )
    return texts.select("doc_id", "mark", "copy"), of_copy


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One line per row of docs: doc_id, copy_id, class_id, n_copies and n_links.

    copy_id: the smallest id with the same words. n_copies: rows with them. n_links: different texts
    of at least the threshold's similarity. class_id: the smallest copy_id that links lead to.
    Null and empty texts are copies of each other, without links. Rows that repeat an id with another text
    are rows of their own. A null id is never the smallest: where there is no other, copy_id or class_id is null.
    """
    texts, of_copy = classified(marked(docs), threshold)
    return texts.join(of_copy, F.col("copy") == F.col("c")).select("doc_id", "copy_id", "class_id", "n_copies", "n_links")


def one_of_each_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that stand for their near-duplicate class.

    That is the text with the smallest id of the class (null last; of several texts under that id the one
    with the smallest hash). Rows that repeat this id and text all stay, other texts under the id go by
    their own class.
    """
    texts, of_copy = classified(marked(docs), threshold)
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("mark") == F.col("stays.mark"))
    gone = durable(
        texts.join(of_copy, F.col("copy") == F.col("c")).where(~stays)
        .select(F.struct("doc_id", "mark").alias("near_duplicate")).distinct()
    )
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    key = F.struct(docs["doc_id"].cast("long").alias("doc_id"), mark.alias("mark"))
    return docs.join(sized(gone), key == gone["near_duplicate"], "left_anti")
