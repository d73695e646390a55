"""Shared parts of the similarity joins: hashed words, and work on groups that stream in sorted order.

Groups are hash-partitioned by a cell key and sorted, so tasks read them one after another with only
one cell in memory. Cells are bounded: a group that is too large is cut into blocks by a hash of its
members, and each pair of blocks is a cell of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.rows import sized
from priorline.sources.durable import durable


#: Bits of a word's hash; the rest of a 64-bit number can hold a place, so one plain sort orders both.
HASH_BITS = 44


class WordHashes(dict):
    """The hash of each word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mixing of 64-bit numbers, another one for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return np.ascontiguousarray(x).view(np.int64)


class WordScanner:
    """Words of a text and their hashes, computed over the whole array of code points at once.

    A word is a longest run of letters, digits and underscores. Its hash is a polynomial in the code
    points' random values: the difference of two prefix sums, moved to the word's start.
    """

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        points = map(chr, range(0x110000))
        self.is_word = np.fromiter((c.isalnum() or c == "_" for c in points), dtype=bool, count=0x110000)
        self.values = mixed(np.arange(0x110000, dtype=np.uint64), 50)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def power_tables(self, length: int) -> None:
        if len(self.powers) < length:
            size = max(length, 1 << 19)
            inverse = pow(self.FACTOR, -1, 2**64)
            for name, factor in (("powers", self.FACTOR), ("inverses", inverse)):
                table = np.full(size, factor, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.multiply.accumulate(table))

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of the words, their starts, places of the line breaks)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.power_tables(len(points) + 1)
        inside = np.zeros(len(points) + 2, dtype=bool)
        inside[1:-1] = self.is_word[points]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(self.values[points] * self.powers[: len(points)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.inverses[starts], 51) >> np.uint64(64 - HASH_BITS)
        return hashes, starts, np.flatnonzero(points == 10)


@lru_cache(maxsize=1)
def word_scanner() -> WordScanner:
    """One for each worker process."""
    return WordScanner()


#: Bytes of rows that are worked on together, about; a larger cell is still taken whole.
BYTES_AT_ONCE = 4_000_000


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row takes."""
    sizes = np.full(batch.num_rows, 8 * batch.num_columns, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_binary(column.type):
            sizes += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return sizes


def whole_cells(
    batches: Iterator[pa.RecordBatch], column: str = "cell", at_once: int = BYTES_AT_ONCE, alone: bool = False
) -> Iterator[pa.Table]:
    """Tables that hold whole cells, from batches sorted by cell; cells with one row are left out unless ``alone``.

    A table takes cells until they have ``at_once`` bytes, so its size follows the cells and not the
    batches, which are cut by their number of rows.
    """
    taken = (lambda rows, _: iter([rows])) if alone else shared
    held: list[pa.RecordBatch] = []
    weight = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(column).to_numpy(zero_copy_only=False)
        before = np.append(0, np.cumsum(row_bytes(batch)))
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        if held and held[-1].column(column)[-1].as_py() == cells[0]:
            starts = starts[1:]  # its first cell goes on
        at = 0
        while len(starts):
            # As many whole cells as fit, or one.
            fit = int(np.searchsorted(before[starts] - before[at] + weight, at_once, side="right"))
            if fit == len(starts) and before[-1] - before[at] + weight <= at_once:
                break
            stop = int(starts[max(fit - 1, 0)])
            if not held and stop == at:
                if len(starts) == 1:
                    break
                stop = int(starts[1])
            yield from taken(pa.Table.from_batches([*held, batch.slice(at, stop - at)]), column)
            held, weight, at = [], 0, stop
            starts = starts[starts >= at]
        held.append(batch.slice(at))
        weight += int(before[-1] - before[at])
    if held:
        yield from taken(pa.Table.from_batches(held), column)


def shared(rows: pa.Table, column: str) -> Iterator[pa.Table]:
    """The rows whose cell has another row, if there are any."""
    cells = rows.column(column).to_numpy()
    same = cells[1:] == cells[:-1]
    keep = np.zeros(len(cells), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    if keep.any():
        yield rows.filter(pa.array(keep))


def joined_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Component labels (the smallest row) after adding edges between rows u and v."""
    while True:
        low = np.minimum(labels[u], labels[v])
        if np.array_equal(labels[u], labels[v]):
            return labels
        np.minimum.at(labels, labels[u], low)
        np.minimum.at(labels, labels[v], low)
        while not np.array_equal(labels, labels[labels]):
            labels = labels[labels]


def meet(cells: np.ndarray, plausible, ordered_sizes: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
    """Labels that join the rows of a cell which plausible pairs connect.

    Rows are sorted by cell. Pairs are taken by their distance in the table, vectorised over all
    cells; pairs that are joined already are not looked at again. If sizes are given, rows are sorted
    by them within a cell, and a row leaves once the sizes of what follows are too far off.
    """
    labels = np.arange(len(cells))
    rows, distance = np.arange(len(cells) - 1), 1
    while len(rows := rows[rows + distance < len(cells)]):
        rows = rows[cells[rows] == cells[rows + distance]]
        if ordered_sizes is not None:
            rows = rows[ordered_sizes[rows] >= least * ordered_sizes[rows + distance]]
        apart = rows[labels[rows] != labels[rows + distance]]
        if len(apart):
            fit = apart[plausible(apart, apart + distance)]
            if len(fit):
                labels = joined_labels(labels, fit, fit + distance)
        distance += 1
    return labels


#: Elements of the sets in one block of a component; a cell holds at most two blocks (or two sets).
BLOCK_ELEMENTS = 400_000


def cells_of(members: DataFrame, sets: DataFrame, block_elements: int = BLOCK_ELEMENTS) -> DataFrame:
    """Rows (cell, side, id, rank, elements), in which each pair of a component's members meets once.

    members: (id, component, size, core), sets: (id, rank, elements as the bytes of sorted 64-bit numbers).
    A component is cut into blocks by a hash of the id, as many as its total size needs; a cell is a
    pair of blocks. Members of the core need not meet each other: they have blocks of their own, which
    meet those of the others, so a set is copied as often as the rest of its component needs, not the
    whole of it. Components of core members alone have no cell, small ones a single one.
    side: -1 where a block meets itself, else which of the two a row belongs to.
    """
    size_of = {kind: F.sum(F.when(F.col("core") == kind, F.col("size")).otherwise(0)) for kind in (False, True)}
    whole = F.col("rest") + F.col("cores") <= block_elements
    # Written, so that the join with it has a shuffle of its own and is split at a large component.
    totals = durable(
        members.groupBy("component").agg(size_of[False].alias("rest"), size_of[True].alias("cores"))
        .where("rest > 0").select(
            F.col("component").alias("of"), whole.alias("whole"),
            F.when(whole, 1).otherwise(F.ceil(F.col("rest") / block_elements)).cast("int").alias("rests"),
            F.when(whole, 0).otherwise(F.ceil(F.col("cores") / block_elements)).cast("int").alias("cores"),
        )
    )
    in_rest = ~F.col("core") | F.col("whole")
    placed = durable(
        members.join(totals, F.col("component") == F.col("of")).select(
            F.col("id").alias("member"), "component",
            F.when(in_rest, F.expr("CAST(pmod(xxhash64(id), rests) AS int)"))
            .otherwise(F.col("rests") + F.expr("CAST(pmod(xxhash64(id), greatest(cores, 1)) AS int)")).alias("block"),
            F.when(in_rest, F.col("rests") + F.col("cores")).otherwise(F.col("rests")).alias("others"),
        )
    )
    full = sets.join(sized(placed), F.col("member") == F.col("id"))
    met = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    return met.select(
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("cell"),
        F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") > F.col("other")).cast("int")).alias("side"),
        "id", "rank", "elements",
    )


def near_hub(rows: DataFrame, threshold: float, kept: str) -> DataFrame:
    """The columns ``kept`` (as a schema) of rows, and whether their ``elements`` are similar to ``hub_elements``."""
    names = [field.split()[0] for field in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for own, hub in zip(batch.column("elements"), batch.column("hub_elements")):
                a, b = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (own, hub))
                common = len(np.intersect1d(a, b, assume_unique=True))
                near.append(enough(common, len(a) + len(b), threshold))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(near, pa.bool_())], names=[*names, "near"]
            )

    return rows.select(*names, "elements", "hub_elements").mapInArrow(run, f"{kept}, near boolean")


def enough(common, both, threshold: float):
    """Whether sets of ``both`` elements together, ``common`` of them shared, reach the threshold; exact at a tie."""
    return common * 1_000_000 >= round(threshold * 1_000_000) * (both - common)


#: Pairs of equal elements expanded at a time.
PAIRS_AT_ONCE = 500_000


def shared_counts(
    rows: np.ndarray, others: np.ndarray, cell_starts: np.ndarray, cell_sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, how often the pair occurs) of pairs of rows of one cell; rows come in order."""
    first, width = rows[0], int(cell_sizes[rows[0] : rows[-1] + 1].max())
    key = (rows - first) * width + (others - cell_starts[rows])
    # Within a large cell most pairs occur, and counting them in place is cheaper than sorting.
    if (rows[-1] - first + 1) * width <= 4 * len(key):
        dense = np.bincount(key)
        pair = np.flatnonzero(dense)
        common = dense[pair]
    else:
        pair, common = np.unique(key, return_counts=True)
    i = pair // width + first
    return i, pair % width + cell_starts[i], common


def similar_rows(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): rows of whole cells that are compared in their cell and similar, each pair both ways.

    Rows are taken in order, so many at a time that memory is bounded, whatever the size of a cell.
    """
    sets = [np.frombuffer(value.as_py(), dtype=np.uint64) for value in rows.column("elements")]
    sizes = np.array([len(s) for s in sets])
    side, cells = (rows.column(c).to_numpy() for c in ("side", "cell"))
    cell = np.cumsum(np.append(0, cells[1:] != cells[:-1])).astype(np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # An element within its cell; a chance collision of the mixing would need equal 64-bit sums.
    values = mixed(np.concatenate(sets) + mixed(cell[owner], 30), 31)
    order = np.argsort(values, kind="stable")
    sorted_values, holders = values[order], owner[order]
    new = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    run = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(values))))
    first = np.empty(len(values), dtype=np.int64)
    count = np.empty(len(values), dtype=np.int64)
    first[order] = new[run]
    # Holders stand in order, so each meets those before it: a pair is counted once.
    count[order] = np.arange(len(values)) - new[run]
    starts = np.cumsum(sizes) - sizes
    heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    lengths = np.diff(np.append(heads, len(cell)))
    cell_starts, cell_sizes = np.repeat(heads, lengths), np.repeat(lengths, lengths)
    work = np.add.reduceat(count, starts) if len(sets) else count
    done = 0
    for end in np.flatnonzero(np.append(np.diff(np.cumsum(work) // PAIRS_AT_ONCE) > 0, True)).tolist():
        part = slice(starts[done], starts[end] + sizes[end])
        counts = count[part]
        done = end + 1
        if not counts.any():
            continue
        at = np.repeat(first[part] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        i, j, common = shared_counts(np.repeat(owner[part], counts), holders[at], cell_starts, cell_sizes)
        near = enough(common, sizes[i] + sizes[j], threshold)
        near &= (i != j) & ((side[i] < 0) | (side[i] != side[j]))
        if near.any():
            yield np.append(i[near], j[near]), np.append(j[near], i[near])
