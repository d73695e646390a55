"""Line dedup by an exact set-similarity join: later lines that match an earlier one are removed.

A line's tokens are its distinct lower-cased words; two lines match if the Jaccard similarity of
their token sets is at least the threshold. Lines of fewer than ``MIN_WORDS`` words never take part.

1. *Lines.* One pass gives each line the digest of its token set and its place, and counts tokens in
   a table of fixed size (all documents). The smallest place of each digest stands for its copies.
2. *Index.* A second pass orders each line's tokens by rarity (that count, then hash) and indexes the
   prefix that a matching line must share a token with. Within the cell of a token the length filter,
   the positional filter and a bound from 128-bit parity maps of the token sets leave few pairs; only
   links to one row of each connected set go out, so the output is linear in the lines.
3. *Verification.* Connected digests (joins and aggregations) get their token sets. Each is compared
   with the earliest of its component by one join; those that match it are done. Only the others are
   compared with all the rest, exactly, in cells of bounded size.
4. *Removal.* A line stays if it is the first of its digest and no earlier digest matches it.

A document is an id with a text: rows that repeat both are one document, different texts under one id
are several, and null ids are ids like others. Places are ordered by id (null first), then by the hash of
the text, then by line number. Null and empty texts have no lines to remove.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.components import connected_components
from priorline.llm.rows import id_and_text, sized
from priorline.llm.similarity import (
    HASH_BITS, cells_of, joined_labels, meet, mixed, near_hub, signed, similar_rows, whole_cells, word_scanner,
)
from priorline.sources.durable import durable

MIN_WORDS = 5
THRESHOLD = 0.8
#: The rarity table: so many counters in blocks, each stored as a rounded logarithm in one byte.
COUNTERS, BLOCK = 1 << 22, 1 << 16
#: A token's cell is cut into blocks of about so many lines.
CELL_LINES = 20_000
#: Index rows go out many at a time, in so many buckets of cells for each shuffle partition.
INDEX_ROWS, BUCKETS = 50_000, 32
INDEX_COLUMNS = ("cell", "packed", "d0", "m0", "m1")
#: Lines of up to so many tokens have a smaller parity map.
SHORT = 64
#: Texts handled at a time, by characters; a longer text is read in pieces of whole lines. A batch has fewer
#: than twice as many lines, and line numbers have 64 - HASH_BITS bits.
CHARS_AT_ONCE = 400_000
#: Digests that a task remembers so as to index a repeated line once.
REMEMBERED = 1 << 18


class LineBatch:
    """The countable lines of some texts as flat arrays: tokens sorted and distinct within a line.

    before: for each text, the number of lines of its document in front of it.
    """

    def __init__(self, texts: list[str], before: list[int], min_words: int):
        tokens, starts, breaks = word_scanner().scan("\n".join(texts).lower())
        line = np.searchsorted(breaks, starts)
        n_lines = np.array([text.count("\n") + 1 for text in texts])
        if n_lines.sum() > 1 << (64 - HASH_BITS):
            raise ValueError(f"{n_lines.sum()} lines in one batch")
        counts = np.bincount(line, minlength=n_lines.sum())
        countable = counts >= min_words
        text = np.repeat(np.arange(len(texts)), n_lines)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n_lines) - n_lines - np.array(before), n_lines)
        self.text, self.numbers = text[countable], number[countable].astype(np.int32)
        kept = countable[line]
        place = (np.cumsum(countable) - 1)[line[kept]].astype(np.uint64)
        # One number holds a token's line and hash: sorting it groups lines and shows repeated tokens.
        both = np.sort(place << np.uint64(HASH_BITS) | tokens[kept])
        both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
        self.tokens = both & np.uint64((1 << HASH_BITS) - 1)
        self.owner = (both >> np.uint64(HASH_BITS)).astype(np.int64)
        self.sizes = np.bincount(self.owner, minlength=len(self.text))
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int64)

    def reduced(self, values: np.ndarray, how=np.add) -> np.ndarray:
        return how.reduceat(values, self.starts) if len(self.starts) else np.zeros(0, values.dtype)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two order-free 64-bit digests of each token set."""
        return self.reduced(mixed(self.tokens, 1)), self.reduced(mixed(self.tokens, 2)) + self.sizes.astype(np.uint64)


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(lines before, piece): the text in pieces that end where a line does; a short text is one."""
    at, before = 0, 0
    while True:
        stop = text.find("\n", at + CHARS_AT_ONCE) if len(text) - at > CHARS_AT_ONCE else -1
        if stop < 0:
            yield before, text[at:]
            return
        piece = text[at:stop]
        yield before, piece
        at, before = stop + 1, before + piece.count("\n") + 1


def in_batches(rows: Iterator[tuple], min_words: int) -> Iterator[tuple[list, LineBatch]]:
    """(what belongs to each text, its lines) for rows (what belongs to it, lines before, text), many texts at a time."""
    owners, before, texts, chars = [], [], [], 0
    for owner, earlier, text in rows:
        owners.append(owner)
        before.append(earlier)
        texts.append(text)
        chars += len(text) + 1
        if chars >= CHARS_AT_ONCE:
            yield owners, LineBatch(texts, before, min_words)
            owners, before, texts, chars = [], [], [], 0
    if texts:
        yield owners, LineBatch(texts, before, min_words)


def line_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[tuple[list, LineBatch]]:
    """Lines of rows (doc_id, mark, text); what belongs to a text is its id and mark."""
    rows = (
        ((key, mark), before, piece)
        for batch in batches
        for key, mark, text in zip(*(batch.column(c) for c in ("doc_id", "mark", "text")))
        for before, piece in pieces(text.as_py())
    )
    for owners, lines in in_batches(rows, min_words):
        yield [(key.as_py(), mark.as_py()) for key, mark in owners], lines


def fresh(digest: np.ndarray, remembered: np.ndarray) -> np.ndarray:
    """Which digests the table of remembered ones does not hold; it then holds them."""
    slots = (digest % np.uint64(len(remembered))).astype(np.int64)
    new = remembered[slots] != digest
    remembered[slots] = digest
    return new


def lines_and_counts(rows: DataFrame, min_words: int) -> DataFrame:
    """Rows of two kinds: a line (d0, d1, doc_id, mark, line), or counters of a block (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.uint32)
        remembered = np.zeros(REMEMBERED, dtype=np.uint64)
        for owners, lines in line_batches(batches, min_words):
            d0, d1 = lines.digests()
            new = fresh(d0, remembered)
            of_lines = pa.array(lines.text)
            np.add.at(counts, (lines.tokens[new[lines.owner]] % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(d0)), pa.array(signed(d1)),
                    *[pa.array(column, pa.int64()).take(of_lines) for column in zip(*owners)],
                    pa.array(lines.numbers, pa.int32()), pa.nulls(len(d0), pa.int32()), pa.nulls(len(d0), pa.binary()),
                ],
                schema=schema,
            )
        for block in range(COUNTERS // BLOCK):
            part = counts[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                packed = at.astype(np.uint32).tobytes() + part[at].tobytes()
                nothing = [pa.nulls(1, field.type) for field in list(schema)[:5]]
                yield pa.RecordBatch.from_arrays(
                    [*nothing, pa.array([block], pa.int32()), pa.array([packed], pa.binary())], schema=schema
                )

    schema = pa.schema(
        [
            ("d0", pa.int64()), ("d1", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32()),
            ("block", pa.int32()), ("counts", pa.binary()),
        ]
    )
    return rows.mapInArrow(run, "d0 long, d1 long, doc_id long, mark long, line int, block int, counts binary")


def rarity_table(counted: DataFrame) -> np.ndarray:
    """Rounded logarithms of the counters (8 steps for each doubling; 8 means one line), in one byte each.

    Blocks are summed as they stream by; ``COUNTERS`` bytes reach the driver, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts")):
                at, values = np.split(np.frombuffer(packed.as_py(), dtype=np.uint32), 2)
                total = sums.setdefault(block, np.zeros(BLOCK, dtype=np.uint64))
                total[at] += values
        for block, total in sums.items():
            steps = np.minimum(np.round(8 * np.log2(np.maximum(total, 0.5) * 2)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["block", "steps"]
            )

    table = np.zeros(COUNTERS, dtype=np.uint8)
    blocks = counted.where("block IS NOT NULL").select("block", "counts").repartition(COUNTERS // BLOCK, "block")
    for row in blocks.mapInArrow(run, "block int, steps binary").collect():
        table[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.steps, dtype=np.uint8)
    return table


def prefix_index(rows: DataFrame, rarity: np.ndarray, threshold: float, min_words: int) -> DataFrame:
    """(bucket, rows): index rows of a bucket of cells, as the bytes of an array of ``INDEX_COLUMNS`` lines.

    An index row stands for a prefix token of a line that another line may share. packed holds the line's
    size, the token's place in the order, and the side of its block. m0 and m1 are its parity map.
    """
    spark = rows.sparkSession
    shared_table = spark.sparkContext.broadcast(rarity)
    buckets = np.uint64(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(held: list[np.ndarray]) -> pa.RecordBatch:
        index = np.concatenate(held, axis=1)
        bucket = index[0].view(np.uint64) % buckets
        order = np.argsort(bucket, kind="stable")
        index, bucket = index[:, order], bucket[order]
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        blocks = [index[:, a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(bucket)])]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[starts].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "rows"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared_table.value
        remembered = np.zeros(REMEMBERED, dtype=np.uint64)
        held: list[np.ndarray] = []
        for _, lines in line_batches(batches, min_words):
            d0, _ = lines.digests()
            tokens, owner, sizes = lines.tokens, lines.owner, lines.sizes
            new = fresh(d0, remembered)
            steps = rarity[(tokens % np.uint64(COUNTERS)).astype(np.int64)]
            # By line, then rarity, then hash (its last bits, in which a token's cell is named).
            ranked = np.sort(
                owner.astype(np.uint64) << np.uint64(HASH_BITS) | steps.astype(np.uint64) << np.uint64(HASH_BITS - 8)
                | tokens & np.uint64((1 << (HASH_BITS - 8)) - 1)
            )
            place = np.arange(len(tokens)) - lines.starts[owner]
            prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
            bit = np.uint64(1) << (tokens & np.uint64(63))
            high = (tokens >> np.uint64(6)) & np.uint64(1) == 1
            # Short lines have a map of 64 bits: both halves of that of 128 folded.
            high &= (sizes > SHORT)[owner]
            m0 = lines.reduced(np.where(high, np.uint64(0), bit), np.bitwise_xor)
            m1 = lines.reduced(np.where(high, bit, np.uint64(0)), np.bitwise_xor)
            steps = (ranked >> np.uint64(HASH_BITS - 8)) & np.uint64(255)
            ranked &= np.uint64((1 << (HASH_BITS - 8)) - 1)
            chosen = np.flatnonzero((place < prefix[owner]) & new[owner] & (steps > 8))
            lines_there = 2.0 ** (steps[chosen].astype(float) / 8 - 1)
            blocks = np.maximum(1, np.ceil(lines_there / CELL_LINES)).astype(np.int64)
            at = np.repeat(chosen, blocks)
            other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            who, blocks = owner[at], np.repeat(blocks, blocks)
            own = (mixed(d0[who], 3) % blocks.astype(np.uint64)).astype(np.int64)
            low, high = np.minimum(own, other), np.maximum(own, other)
            side = np.where(own == other, 2, (own == high).astype(np.int64))
            cell = mixed(ranked[at] + mixed(low.astype(np.uint64) << np.uint64(32) | high.astype(np.uint64), 4), 5)
            packed = sizes[who].astype(np.int64) << 32 | place[at] << 2 | side
            held.append(np.stack([signed(cell), packed, *(signed(x[who]) for x in (d0, m0, m1))]))
            if sum(part.shape[1] for part in held) >= INDEX_ROWS:
                yield dealt(held)
                held = []
        if sum(part.shape[1] for part in held):
            yield dealt(held)

    return rows.mapInArrow(run, "bucket int, rows binary")


def by_cell_and_size(cells: np.ndarray, size: np.ndarray, d0: np.ndarray) -> np.ndarray:
    """An order by cell, then size, in which rows of one digest (mostly) stand side by side."""
    order = np.argsort(cells)
    new = np.append(True, cells[order][1:] != cells[order][:-1])
    number = np.empty(len(cells), dtype=np.uint64)
    number[order] = np.cumsum(new)
    if number[order[-1]] >= 1 << 24 or size.max() >= 1 << 16:
        return np.lexsort((d0, size, cells))
    return np.argsort(number << np.uint64(40) | size.astype(np.uint64) << np.uint64(24) | d0.view(np.uint64) >> np.uint64(40))


def candidate_links(index: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links among digests that the filters leave, one for each row that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches, "bucket", alone=True):
            parts = [np.frombuffer(part.as_py(), dtype=np.int64).reshape(len(INDEX_COLUMNS), -1) for part in rows.column("rows")]
            index = np.concatenate(parts, axis=1)
            index = index[:, by_cell_and_size(index[0], index[1] >> 32, index[2])]
            # A digest that was indexed twice in a cell would meet itself; a cell with one row has no pair.
            new = np.append(True, (index[0, 1:] != index[0, :-1]) | (index[2, 1:] != index[2, :-1]))
            cells = index[0, new]
            met = cells[1:] == cells[:-1]
            cells, packed, d0, m0, m1 = index[:, new][:, np.append(False, met) | np.append(met, False)]
            if not len(cells):
                continue
            m0, m1 = m0.view(np.uint64), m1.view(np.uint64)
            size, place, side = packed >> 32, (packed >> 2) & ((1 << 30) - 1), packed & 3

            def plausible(u: np.ndarray, v: np.ndarray) -> np.ndarray:
                need = np.ceil(threshold / (1 + threshold) * (size[u] + size[v]) - 1e-9)
                around = np.minimum(place[u], place[v]) + 1 + np.minimum(size[u] - place[u], size[v] - place[v]) - 1
                low, high = m0[u] ^ m0[v], m1[u] ^ m1[v]
                fold = (size[u] <= SHORT) | (size[v] <= SHORT)
                low, high = np.where(fold, low ^ high, low), np.where(fold, np.uint64(0), high)
                differ = np.bitwise_count(low).astype(np.int64) + np.bitwise_count(high)
                apart = (side[u] == 2) | (side[u] != side[v])
                return apart & (around >= need) & ((size[u] + size[v] - differ) // 2 >= need)

            labels = meet(cells, plausible, size, threshold)
            linked = np.flatnonzero(labels != np.arange(len(labels)))
            if len(linked):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d0[linked]), pa.array(d0[labels[linked]])], names=["a", "b"]
                )

    spark = index.sparkSession
    dealt = index.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(run, "a long, b long").distinct()


def token_sets(rows: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(d0, d1, component, hub, place, size, elements) of the lines at wanted places.

    wanted: (key, lines), lines being sorted structs (line, component, hub) of a document. A task leaves
    out rows that repeat a document it has had.
    """

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        done = set()
        for batch in batches:
            for key, mark, text, found in zip(*(batch.column(c) for c in ("doc_id", "mark", "text", "lines"))):
                document = (key.as_py(), mark.as_py())
                if document in done:
                    continue
                if len(done) >= REMEMBERED:
                    done.clear()
                done.add(document)
                lines = {line["line"]: line for line in found.as_py()}
                for before, piece in pieces(text.as_py()):
                    # Other lines are emptied, so numbers stay as they are.
                    split = piece.split("\n")
                    here = [lines[k] for k in range(before, before + len(split)) if k in lines]
                    masked = "\n".join(line if before + k in lines else "" for k, line in enumerate(split))
                    yield (document, here), before, masked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owners, lines in in_batches(chosen(batches), min_words):
            d0, d1 = lines.digests()
            # The lines that are left are just those that are wanted, in their order.
            found = [line for _, here in owners for line in here]
            places = [(*document, line["line"]) for document, here in owners for line in here]
            columns = [
                pa.array(signed(d0)), pa.array(signed(d1)), pa.array([line["component"] for line in found], pa.int64()),
                pa.array([line["hub"] for line in found], pa.bool_()),
                *[pa.array([place[k] for place in places], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))],
                pa.array(lines.sizes, pa.int32()),
                pa.array([lines.tokens[a : a + n].tobytes() for a, n in zip(lines.starts, lines.sizes)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["d0", "d1", "component", "hub", "doc_id", "mark", "line", "size", "elements"]
            )

    found = rows.withColumn("own", F.struct("doc_id", "mark")).join(wanted, F.col("own") == F.col("key")).select("doc_id", "mark", "text", "lines")
    return found.mapInArrow(
        run, "d0 long, d1 long, component long, hub boolean, doc_id long, mark long, line int, size int, elements binary"
    )


def matched_digests(cells: DataFrame, threshold: float) -> DataFrame:
    """(d0, d1) of the digests that have an earlier similar one. id: struct of both; rank: place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            rows = rows.combine_chunks().flatten().flatten()
            d0, d1 = (rows.column(c).to_numpy() for c in ("id.d0", "id.d1"))
            place = [
                rows.column("rank.line").to_numpy(), rows.column("rank.mark").to_numpy(),
                rows.column("rank.doc_id").fill_null(0).to_numpy(), rows.column("rank.doc_id").is_valid().to_numpy(),
            ]
            # Equal places (of repeated rows) have one rank: none of them is later.
            rank = np.empty(len(d0), dtype=np.int64)
            order = np.lexsort(place)
            differs = np.any([column[order][1:] != column[order][:-1] for column in place], axis=0)
            rank[order] = np.append(0, np.cumsum(differs))
            later = [i[rank[j] < rank[i]] for i, j in similar_rows(rows, threshold)]
            if later:
                found = np.unique(np.concatenate(later))
                yield pa.RecordBatch.from_arrays([pa.array(d0[found]), pa.array(d1[found])], names=["d0", "d1"])

    spark = cells.sparkSession
    dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "d0 long, d1 long").distinct()


def later_digests(sets: DataFrame, threshold: float) -> DataFrame:
    """(d0, d1) of the digests among sets that match an earlier one of their component.

    The hub is a component's earliest: what matches it is settled by one join. The others have to be
    compared with each other and with the settled ones, which may be earlier as well.
    """
    # Written, so that the join with it has a shuffle of its own and is split at a large component.
    hubs = durable(
        sets.where("hub").select(F.col("component").alias("of"), F.col("elements").alias("hub_elements")).dropDuplicates(["of"])
    )
    others = sets.where("NOT hub").join(hubs, F.col("component") == F.col("of"))
    judged = durable(near_hub(others, threshold, "d0 long, d1 long, component long, size int")).distinct()
    id_of = F.struct("d0", "d1").alias("id")
    hub_rows = sets.where("hub").select(id_of, "component", "size", F.lit(True).alias("core")).distinct()
    members = judged.select(id_of, "component", "size", F.col("near").alias("core")).unionByName(hub_rows)
    cells = cells_of(members, sets.select(id_of, F.struct("doc_id", "mark", "line").alias("rank"), "elements"))
    return judged.where("near").select("d0", "d1").unionByName(matched_digests(cells, threshold)).distinct()


def documents_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): mark is the hash of the text, which with the id names the document."""
    return id_and_text(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")


def removed_lines(
    rows: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS
) -> tuple[DataFrame, DataFrame]:
    """The places (key, line) of all countable lines of rows (doc_id, mark, text), and those of the removed ones.

    key: struct of id and mark. A place has a row for each row of docs that has it, a removed one has one row.
    """
    counted = durable(lines_and_counts(rows, min_words))
    place = F.struct("doc_id", "mark", "line").alias("place")
    lines = counted.where("block IS NULL").select("d0", "d1", place)
    firsts = durable(lines.groupBy("d0", "d1").agg(F.min("place").alias("place"), F.count("*").alias("n")))
    links = candidate_links(prefix_index(rows, rarity_table(counted), threshold, min_words), threshold)
    components = durable(connected_components(links))
    candidates = durable(
        firsts.join(components, F.col("d0") == F.col("node")).select("place", "component")
    )
    earliest = durable(candidates.groupBy(F.col("component").alias("of")).agg(F.min("place").alias("earliest")))
    line = F.struct("place.line", "component", (F.col("place") == F.col("earliest")).alias("hub"))
    wanted = durable(
        candidates.join(earliest, F.col("component") == F.col("of"))
        .groupBy(F.struct("place.doc_id", "place.mark").alias("key")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    )
    sets = durable(token_sets(rows, sized(wanted), min_words))
    later = later_digests(sets, threshold).select(F.col("d0").alias("m0"), F.col("d1").alias("m1"))
    # Only digests that occur again or match an earlier one remove lines; the others are not joined.
    removing = durable(
        firsts.join(later, (F.col("d0") == F.col("m0")) & (F.col("d1") == F.col("m1")), "left")
        .where("n > 1 OR m0 IS NOT NULL")
        .select(F.col("d0").alias("r0"), F.col("d1").alias("r1"), F.when(F.col("m0").isNull(), F.col("place")).alias("stays"))
    )
    gone = lines.join(sized(removing), (F.col("d0") == F.col("r0")) & (F.col("d1") == F.col("r1"))).where(
        F.col("stays").isNull() | (F.col("place") != F.col("stays"))
    )
    at = (F.struct("place.doc_id", "place.mark").alias("key"), F.col("place.line").alias("line"))
    return lines.select(*at), gone.select(*at).distinct()


def per_document(removed: DataFrame) -> DataFrame:
    """(key, n_removed, gone: sorted line numbers) of the documents that lose lines."""
    return removed.groupBy("key").agg(F.sort_array(F.collect_list("line")).alias("gone")).withColumn(
        "n_removed", F.size("gone").cast("long")
    )


def emptied_documents(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(key, gone) of the documents among found (key, n_removed, gone) all of whose countable lines went."""
    losing = found.select(F.col("key").alias("losing"), "n_removed", "gone")
    countable = lines.join(losing.select("losing"), F.col("key") == F.col("losing"), "left_semi").distinct()
    counts = countable.groupBy(F.col("key").alias("counted")).agg(F.count("*").alias("n_countable"))
    return counts.join(losing, F.col("counted") == F.col("losing")).where("n_countable = n_removed").select(
        F.col("counted").alias("key"), "gone"
    )


def dedup_lines(
    docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS
) -> DataFrame:
    """One line per row of docs: doc_id, n_lines, n_removed and removed (line numbers from 0, comma-joined).

    A null or empty text has no lines. Rows that repeat an id with its text have equal results; different
    texts under one id, null included, are documents of their own, the one with the smaller hash first.
    """
    rows = documents_of(docs)
    found = per_document(removed_lines(rows, threshold, min_words)[1])
    # Only the number of lines of a text is shuffled.
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    counts = rows.select(F.struct("doc_id", "mark").alias("own"), F.when(F.col("text") == "", 0).otherwise(breaks + 1).cast("long").alias("n_lines"))
    return counts.join(found, F.col("own") == F.col("key"), "left").select(
        "own.doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"),
    )


def own_short_lines(rows: DataFrame, emptied: DataFrame) -> DataFrame:
    """(own): keys of emptied documents (key, gone) with a line left that no earlier document has.

    rows: (doc_id, mark, text). Lines are compared as they are; blank ones do not count.
    """
    keyed = rows.select(F.struct("doc_id", "mark").alias("key"), "text")

    def lines_of(texts: DataFrame) -> DataFrame:
        split = texts.select("key", F.posexplode(F.split("text", "\n")).alias("line", "words"))
        return split.where(F.col("words").rlike(r"\S")).select("key", "line", F.xxhash64("words").alias("digest"))

    chosen = emptied.select(F.col("key").alias("emptied"))
    removed = emptied.select(F.col("key").alias("k"), F.explode("gone").alias("l"))
    left = durable(
        lines_of(keyed.join(sized(durable(chosen)), F.col("key") == F.col("emptied")))
        .join(removed, (F.col("key") == F.col("k")) & (F.col("line") == F.col("l")), "left_anti")
        .select("key", "digest").distinct()
    )
    wanted = durable(left.select(F.col("digest").alias("wanted")).distinct())
    first = (
        lines_of(keyed).join(sized(wanted), F.col("digest") == F.col("wanted"))
        .groupBy("wanted").agg(F.min("key").alias("first"))
    )
    return (
        left.join(sized(durable(first)), F.col("digest") == F.col("wanted"))
        .where(F.col("first") == F.col("key")).select(F.col("key").alias("own")).distinct()
    )


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the removed lines, all columns kept; n_chars, where there is one, is counted anew.

    A document all of whose countable lines went goes too, unless it still has a line of its own: a
    shorter one that no earlier document has. Others, also those with a null or an empty text, stay.
    Documents are told apart as in ``dedup_lines``: a text loses its own lines only, whatever its id.
    """
    rows = documents_of(docs)
    lines, removed = removed_lines(rows, threshold, min_words)
    found = durable(per_document(removed))
    emptied = durable(emptied_documents(lines, found))
    own = own_short_lines(rows, emptied)
    dropped = durable(emptied.join(own, F.col("key") == F.col("own"), "left_anti").select(F.col("key").alias("dropped")))
    found = found.join(dropped, F.col("key") == F.col("dropped"), "left").select(
        F.struct(F.col("key"), F.col("gone"), F.col("dropped").isNotNull().alias("all")).alias("line_dedup")
    )
    # The added column is a struct of its own, dropped at the end: no name of docs is in the way.
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mark = F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    key = F.struct(F.col("row.doc_id").cast("long").alias("doc_id"), mark.alias("mark"))
    joined = plain.join(found, key == F.col("line_dedup.key"), "left").where(
        ~F.coalesce(F.col("line_dedup.all"), F.lit(False))
    )
    text = F.when(F.col("line_dedup").isNull(), F.col("row.text")).otherwise(
        F.array_join(
            F.filter(F.split("row.text", "\n"), lambda _, k: ~F.array_contains(F.col("line_dedup.gone"), k)), "\n"
        )
    )
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in columns:
        counted = F.when(F.col("line_dedup").isNull(), F.col("row.n_chars")).otherwise(F.length(text))
        columns["n_chars"] = counted.cast(docs.schema["n_chars"].dataType)
    return joined.select(*[column.alias(name) for name, column in columns.items()])
