"""Gradient-boosted trees over numbers and one-hot categories with many values.

MLlib's learner keeps a dense array of all features for each row, so its memory and time grow with rows x
categories, and both grow with the input. Here a row keeps the bin of each number and the index of each
category. Tasks sum their rows per (node, feature, bin) with numpy. A category adds one cell per row, not one
per value: rows without a value are the node's total less those with it.

All rounds are one job. Its tasks, one for each few million rows as long as the cluster runs as many at once, keep
their rows in mapped files; more than one are barrier tasks: the sums of a level go round by ``allGather``, so every task adds the same numbers and finds the same
splits. Of two children only the smaller one is summed, the other is what is left of the parent. Where executors
come and go, so that not all tasks can run at once, a level is one job: the sums are added by a shuffle, and the
best split of each node (a few rows) reaches the driver. Both ways give the same trees.

Trees, losses and weights are those of MLlib's boosting, and the result is MLlib's model. Bins come from
the quantiles of all rows; rows and features are drawn by hash, so both draws are independent of each other.
"""

from __future__ import annotations

import base64
import math
import pickle
import tempfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priorline.sources.durable import discard, durable

BINS = 32
#: Quantiles that show which values a number has, and their rank error.
QUANTILES, RANK_ERROR = 256, 0.001
#: Rounds after which the sum of the trees is written with the rows.
WRITTEN_EVERY = 10
#: Rows that a task sums at a time.
ROWS_AT_ONCE = 200_000
#: A gain below this share of the node's spread is rounding.
ROUNDING = 1e-12
SUMS = ["n", "w", "s", "q"]
#: Rows of a task, and cells that all tasks together send to one another at a time. Spark looks for the answers of
#: an exchange once a second only, so a level's sums must be worth that.
ROWS_PER_TASK, CELLS_AT_ONCE = 4_000_000, 1 << 23


@dataclass
class Node:
    """A node with its sums (rows, weight, weighted label, weighted square); a leaf has no feature."""

    sums: tuple[float, float, float, float]
    feature: int = -1
    bin: int = 0
    gain: float = 0.0
    left: int = -1
    right: int = -1

    @property
    def value(self) -> float:
        return self.sums[2] / self.sums[1]

    @property
    def impurity(self) -> float:
        _, w, s, q = self.sums
        return max(q / w - (s / w) ** 2, 0.0)


@dataclass
class Layout:
    """Numbers take the first places of the feature vector, then come the values of each category."""

    numbers: list[str]
    categories: list[str]
    sizes: list[int]
    thresholds: list[list[float]] = field(default_factory=list)

    @property
    def offsets(self) -> list[int]:
        return [len(self.numbers) + sum(self.sizes[:k]) for k in range(len(self.sizes))]

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(self.sizes)


def thresholds(rows: DataFrame, numbers: Sequence[str]) -> list[list[float]]:
    """At most ``BINS`` - 1 split points of each number: between all its values if they are few, else quantiles."""
    if not numbers:
        return []
    found = rows.approxQuantile(list(numbers), [k / QUANTILES for k in range(QUANTILES + 1)], RANK_ERROR)
    points = []
    for values in found:
        different = sorted(set(values))
        middles = [(a + b) / 2 for a, b in zip(different, different[1:])]
        if len(different) > BINS:
            at = {float(np.searchsorted(different, values[k * QUANTILES // BINS])) for k in range(1, BINS)}
            middles = [middles[int(k)] for k in sorted(at) if k < len(middles)]
        points.append(middles)
    return points


def binned(rows: DataFrame, layout: Layout) -> DataFrame:
    """(_row, _label, _weight, _margin, b_0 …, c_0 …): the bin of each number, the index of each category."""
    names = [f"b_{k}" for k in range(len(layout.numbers))] + [f"c_{k}" for k in range(len(layout.categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.column(c) for c in ("_row", "_label", "_weight")]
            bins = [
                pa.array(np.searchsorted(points, batch.column(c).to_numpy(zero_copy_only=False), side="left").astype(np.int8))
                for c, points in zip(layout.numbers, layout.thresholds)
            ]
            values = [pa.array(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int32)) for c in layout.categories]
            margin = pa.array(np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([*kept, margin, *bins, *values], names=["_row", "_label", "_weight", "_margin", *names])

    types = ["tinyint"] * len(layout.numbers) + ["int"] * len(layout.categories)
    schema = "_row long, _label double, _weight double, _margin double" + "".join(f", {n} {t}" for n, t in zip(names, types))
    return rows.mapInArrow(run, schema)


class Rows:
    """The binned rows of a batch, or of a task, as arrays."""

    def __init__(self, table: pa.Table | Spool, layout: Layout):
        def column(name: str) -> np.ndarray:
            return table.column(name).to_numpy() if isinstance(table, pa.Table) else table.column(name)

        self.bins = [column(f"b_{k}") for k in range(len(layout.numbers))]
        self.values = [column(f"c_{k}") for k in range(len(layout.categories))]
        self.row, self.label, self.weight = (column(c) for c in ("_row", "_label", "_weight"))
        self.margin = column("_margin") if isinstance(table, pa.Table) else None
        self.offsets = layout.offsets

    def right(self, node: Node, at: np.ndarray) -> np.ndarray:
        """Which of the rows go to the right: those with a larger bin, or with the category."""
        if node.feature < len(self.bins):
            return self.bins[node.feature][at] > node.bin
        k = int(np.searchsorted(self.offsets, node.feature, side="right")) - 1
        # A category without values has the offset of the next one, which comes last.
        return self.values[k][at] == node.feature - self.offsets[k]

    def leaf(self, tree: list[Node]) -> np.ndarray:
        """The number of each row's leaf; parents come before their children."""
        place = np.zeros(len(self.row), dtype=np.int64)
        for k, node in enumerate(tree):
            if node.feature >= 0:
                at = np.flatnonzero(place == k)
                place[at] = np.where(self.right(node, at), node.right, node.left)
        return place

    def add(self, trees: list[tuple[list[Node], float]]) -> None:
        self.margin = self.margin + sum(
            (weight * np.array([node.value for node in tree])[self.leaf(tree)] for tree, weight in trees), np.zeros(len(self.row))
        )

    def residual(self, first: bool, classes: bool) -> np.ndarray:
        """What a tree is fitted to: the label, later the negative gradient of squared or logistic loss."""
        label = 2 * self.label - 1 if classes else self.label
        if first:
            return label
        if classes:
            return 4 * label / (1 + np.exp(np.minimum(2 * label * self.margin, 700)))
        return 2 * (label - self.margin)

    def drawn(self, number: int, share: float, seed: int) -> np.ndarray:
        """Whether a row takes part in a round, by a hash of both."""
        with np.errstate(over="ignore"):
            x = self.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + number) % (1 << 63))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x ^= x >> np.uint64(31)
        return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS_AT_ONCE:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def level_sums(
    rows: DataFrame, layout: Layout, recent: list[tuple[list[Node], float]], tree: list[Node], open_nodes: list[int],
    number: int, classes: bool, share: float, seed: int,
) -> DataFrame:
    """(node, feature, bin, n, w, s, q): sums of the drawn rows in the open nodes; feature -1 is the node's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            part = Rows(table, layout)
            part.add(recent)
            slot = np.full(max(len(tree), 1), -1)
            slot[open_nodes] = np.arange(len(open_nodes))
            slots = slot[part.leaf(tree)]
            at = np.flatnonzero(part.drawn(number, share, seed) & (slots >= 0))
            slots, w, label = slots[at], part.weight[at], part.residual(number == 0, classes)[at]
            sums = [np.ones(len(at)), w, w * label, w * label * label]
            cells = [(-1, np.zeros(len(at), dtype=np.int64), 1)]
            cells += [(k, bins[at].astype(np.int64), BINS) for k, bins in enumerate(part.bins)]
            cells += [(offset, values[at].astype(np.int64), None) for offset, values in zip(layout.offsets, part.values)]
            sizes = [None] * (1 + len(part.bins)) + layout.sizes
            for (first, bins, width), size in zip(cells, sizes):
                many = size + 1 if width is None else width
                used, inverse = np.unique(slots * many + bins, return_inverse=True)
                if not len(used):
                    continue
                added = [np.bincount(inverse, weights=x, minlength=len(used)) for x in sums]
                node, place = np.array(open_nodes)[used // many], used % many
                # The index after the last value stands for unseen ones, which have no feature.
                known = np.full(len(used), True) if width else place < size
                feature = np.full(len(used), first) if width else first + place
                columns = [node, feature, place if width else np.zeros(len(used), dtype=np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(c[known], pa.int32()) for c in columns], pa.array(added[0][known].astype(np.int64)),
                        *[pa.array(x[known]) for x in added[1:]],
                    ],
                    names=["node", "feature", "bin", *SUMS],
                )

    found = rows.mapInArrow(run, "node int, feature int, bin int, n long, w double, s double, q double")
    return found.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in SUMS])


def best_splits(sums: DataFrame, totals: dict[int, tuple], layout: Layout, number: int, share: float, seed: int) -> list:
    """The best split (node, feature, bin, gain, sums of the left side) of each node that has one."""
    of = F.create_map(*[F.lit(x) for node in totals for x in (node, node)])
    at = sums.where("feature >= 0")
    whole = {c: F.element_at(F.create_map(*[F.lit(x) for node, t in totals.items() for x in (node, t[k])]), F.col("node")) for k, c in enumerate(SUMS)}
    numeric = F.col("feature") < len(layout.numbers)
    upto = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    at = at.where(F.element_at(of, F.col("node")).isNotNull()).withColumns({f"t_{c}": whole[c] for c in SUMS})
    at = at.withColumns({f"l_{c}": F.when(numeric, F.sum(c).over(upto)).otherwise(F.col(f"t_{c}") - F.col(c)) for c in SUMS})
    at = at.withColumns({f"r_{c}": F.col(f"t_{c}") - F.col(f"l_{c}") for c in SUMS})
    spread = {x: F.greatest(F.col(f"{x}_q") - F.col(f"{x}_s") ** 2 / F.col(f"{x}_w"), F.lit(0.0)) for x in "tlr"}
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.lit(number), "node", "feature"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)
    valid = at.where(drawn).where("l_n > 0 AND r_n > 0 AND l_w > 0 AND r_w > 0")
    valid = valid.withColumn("gain", (spread["t"] - spread["l"] - spread["r"]) / F.col("t_w")).where(
        F.col("gain") > ROUNDING * F.col("t_q") / F.col("t_w")
    )
    first = F.struct("gain", F.negative("feature"), F.negative("bin"))
    best = valid.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "gain", *[f"l_{c}" for c in SUMS]), first).alias("best"))
    return best.select("node", "best.*").collect()


def grow(
    rows: DataFrame, layout: Layout, recent: list, number: int, classes: bool, depth: int, row_share: float,
    column_share: float, seed: int,
) -> list[Node]:
    """One tree, level by level; nodes in order of their levels."""
    tree: list[Node] = []
    open_nodes = [0]
    for level in range(depth):
        sums = level_sums(rows, layout, recent, tree, open_nodes, number, classes, row_share, seed)
        if level == 0:
            sums = durable(sums)
            root = sums.where("feature = -1").select(*SUMS).first()
            if root is None:
                raise ValueError("No row was drawn for a tree.")
            tree.append(Node(tuple(root)))
        found = best_splits(sums, {k: tree[k].sums for k in open_nodes}, layout, number, column_share, seed)
        if level == 0:
            discard(sums)
        open_nodes = []
        for best in sorted(found, key=lambda b: b.node):
            node, left = tree[best.node], (best.l_n, best.l_w, best.l_s, best.l_q)
            node.feature, node.bin, node.gain = best.feature, best.bin, best.gain
            node.left, node.right = len(tree), len(tree) + 1
            tree += [Node(left), Node(tuple(a - b for a, b in zip(node.sums, left)))]
            open_nodes += [node.left, node.right]
        if not open_nodes:
            break
    return tree


def boosted(
    rows: DataFrame, layout: Layout, classes: bool, rounds: int, step: float, depth: int, row_share: float,
    column_share: float, seed: int,
) -> list[tuple[list[Node], float]]:
    """(tree, weight) of each round, on rows (_label, _weight, numbers, category indices)."""
    held = durable(rows.select(*layout.numbers, *layout.categories, "_label", "_weight").withColumn("_row", F.monotonically_increasing_id()))
    layout.thresholds = thresholds(held, layout.numbers)
    draws = (row_share, column_share, seed)
    found = level_by_level if slots(rows.sparkSession) == 0 else at_once
    trees = found(held, layout, classes, rounds, step, depth, *draws)
    discard(held)
    return [(tree, step if number else 1.0) for number, tree in enumerate(trees)]


def slots(spark: SparkSession) -> int:
    """How many tasks run at once; 0 where executors come and go."""
    context = spark.sparkContext._jsc.sc()
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def level_by_level(
    held: DataFrame, layout: Layout, classes: bool, rounds: int, step: float, depth: int, row_share: float,
    column_share: float, seed: int,
) -> list[list[Node]]:
    """The tree of each round, a job for each level."""
    table = durable(binned(held, layout))
    trees: list[tuple[list[Node], float]] = []
    recent: list[tuple[list[Node], float]] = []
    for number in range(rounds):
        tree = grow(table, layout, recent, number, classes, depth, row_share, column_share, seed)
        trees.append((tree, step if number else 1.0))
        recent.append(trees[-1])
        if len(recent) == WRITTEN_EVERY and number + 1 < rounds:
            before, table = table, durable(with_margin(table, layout, recent))
            discard(before)
            recent = []
    discard(table)
    return [tree for tree, _ in trees]


def with_margin(table: DataFrame, layout: Layout, recent: list[tuple[list[Node], float]]) -> DataFrame:
    """Binned rows with the trees' sum added to what they had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            rows = Rows(part, layout)
            rows.add(recent)
            yield from part.set_column(part.column_names.index("_margin"), "_margin", pa.array(rows.margin)).to_batches()

    return table.mapInArrow(run, table.schema)


class Spool:
    """Columns of a task's rows in mapped files, which are gone when the task ends."""

    def __init__(self, names: Sequence[str]):
        self.files = {name: tempfile.TemporaryFile() for name in names}
        self.types: dict[str, np.dtype] = {}
        self.length = 0

    def write(self, batch: pa.RecordBatch) -> None:
        for name, file in self.files.items():
            values = batch.column(name).to_numpy(zero_copy_only=False)
            self.types[name] = values.dtype
            file.write(values.tobytes())
        self.length += batch.num_rows

    def column(self, name: str) -> np.ndarray:
        if not self.length:
            return np.zeros(0, dtype=np.int64)
        self.files[name].flush()
        return np.memmap(self.files[name], dtype=self.types[name], mode="r")


class Cells:
    """The cells of a node, side by side: the bins of each number, then the values of each category and unseen ones."""

    def __init__(self, layout: Layout):
        k, sizes = len(layout.numbers), [size + 1 for size in layout.sizes]
        self.firsts = [k * BINS + sum(sizes[:j]) for j in range(len(sizes))]
        self.numeric, self.width = k * BINS, k * BINS + sum(sizes)
        values = [np.arange(size) + offset for size, offset in zip(sizes, layout.offsets)]
        self.feature = np.concatenate([np.repeat(np.arange(k), BINS), *values]).astype(np.int64)
        # The index after the last value stands for unseen ones, which have no feature.
        self.known = np.full(self.width, True)
        self.known[[first + size for first, size in zip(self.firsts, layout.sizes)]] = False


def _hashed(values: Sequence[np.ndarray | int]) -> np.ndarray:
    """Spark's xxhash64 of columns of int."""
    one, two, three, five = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    found = np.full(1, 42, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for value in values:
            x = np.asarray(value, dtype=np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            found = (found + np.uint64(five) + np.uint64(4)) ^ (x * np.uint64(one))
            found = ((found << np.uint64(23)) | (found >> np.uint64(41))) * np.uint64(two) + np.uint64(three)
            for shift, factor in ((33, two), (29, three)):
                found = (found ^ (found >> np.uint64(shift))) * np.uint64(factor)
            found = found ^ (found >> np.uint64(32))
    return found.view(np.int64)


class Grower:
    """A task's part of the boosting: its rows, and the sums that all tasks exchange."""

    def __init__(self, layout: Layout, spool: Spool, gather: Callable[[bytes], list[bytes]], tasks: int):
        self.cells, self.gather, self.tasks = Cells(layout), gather, tasks
        self.rows = Rows(spool, layout)
        self.rows.margin = np.zeros(spool.length)
        self.plain = bool((self.rows.weight == 1).all())

    def added(self, *tables: np.ndarray) -> list[np.ndarray]:
        """The sums of the tables (rows, weights, labels, squares) over all tasks."""
        if self.tasks == 1:
            return list(tables)
        out = [np.zeros(len(t)) for t in tables]
        piece = max(CELLS_AT_ONCE // self.tasks**2, 1)
        for start in range(0, len(tables[0]), piece):
            n, *others = (t[start : start + piece] for t in tables)
            at = np.flatnonzero(n)
            parts = [n[at].astype(np.int64), *[None if k == 0 and self.plain else t[at] for k, t in enumerate(others)]]
            for one in self.gather(pickle.dumps((at.astype(np.int32), parts))):
                used, values = pickle.loads(one)
                for total, value in zip(out, values):
                    total[start + used] += values[0] if value is None else value
        return out

    def sums(
        self, whole: Sequence[np.ndarray], members: Sequence[np.ndarray], residual: np.ndarray
    ) -> tuple[list[tuple], list[np.ndarray]]:
        """Over all tasks: rows, weight, weighted label and weighted square of the rows of each of the ``whole``
        nodes; (nodes x cells) the same sums of the ``members``. One exchange for both."""
        width = self.cells.width
        cells = len(members) * width
        # After the cells comes a place for each whole node.
        n, w, s, q = (np.zeros(cells + len(whole)) for _ in SUMS)
        for k, at in enumerate(whole):
            place = cells + k
            for part in np.split(at, range(ROWS_AT_ONCE, len(at), ROWS_AT_ONCE)):
                weight, label = self.rows.weight[part], residual[part]
                n[place] += len(part)
                w[place] += weight.sum()
                s[place] += (weight * label).sum()
                q[place] += (weight * label * label).sum()
        at = np.concatenate(members) if members else np.zeros(0, dtype=np.int32)
        slot = np.repeat(np.arange(len(members)), [len(m) for m in members])
        table = [x[:cells].reshape(len(members), width) for x in (n, w, s, q)]
        ends = [*self.cells.firsts[1:], width]
        columns = [(k * BINS, BINS, bins) for k, bins in enumerate(self.rows.bins)]
        columns += [(a, b - a, values) for a, b, values in zip(self.cells.firsts, ends, self.rows.values)]
        for start in range(0, len(at), ROWS_AT_ONCE):
            part, base = at[start : start + ROWS_AT_ONCE], slot[start : start + ROWS_AT_ONCE]
            weight = self.rows.weight[part]
            label = weight * residual[part]
            square = label * residual[part]
            for first, many, values in columns:
                of = base * many + values[part]
                for total, x in zip(table, (None, weight, label, square)):
                    if total is table[1] and self.plain:
                        continue
                    found = np.bincount(of, weights=x, minlength=many * len(members)).reshape(len(members), many)
                    total[:, first : first + many] += found
        if self.plain:
            w = n
        found = self.added(n, w, s, q)
        totals = [tuple(x) for x in np.array([x[cells:] for x in found]).T]
        return totals, [x[:cells].reshape(len(members), width) for x in found]

    def splits(self, nodes: Sequence[int], tree: list[Node], sums: Sequence[np.ndarray], number: int, share: float, seed: int) -> dict:
        """node -> (cell, gain) of its best split."""
        cells, found = self.cells, {}
        limit = math.ceil(share * 1_000_000)
        for k, node in enumerate(nodes):
            whole, own = tree[node].sums, [x[k] for x in sums]
            upto = [np.cumsum(x[: cells.numeric].reshape(-1, BINS), axis=1).reshape(-1) for x in own]
            left = [np.concatenate([a, t - x[cells.numeric :]]) for a, t, x in zip(upto, whole, own)]
            right = [t - x for t, x in zip(whole, left)]
            drawn = _hashed([seed, number, node, cells.feature]) % 1_000_000 < limit
            valid = cells.known & drawn & (own[0] > 0) & (left[0] > 0) & (right[0] > 0) & (left[1] > 0) & (right[1] > 0)
            at = np.flatnonzero(valid)
            if not len(at):
                continue
            spread = [np.maximum(q - a * a / w, 0.0) for _, w, a, q in ([x[at] for x in left], [x[at] for x in right])]
            _, t_w, t_s, t_q = whole
            gain = (max(t_q - t_s * t_s / t_w, 0.0) - spread[0] - spread[1]) / t_w
            best = int(np.argmax(gain))
            if gain[best] > ROUNDING * t_q / t_w:
                cell = int(at[best])
                found[node] = (cell, float(gain[best]), left[0][cell], right[0][cell])
        return found

    def tree(self, number: int, classes: bool, depth: int, row_share: float, column_share: float, seed: int) -> list[Node]:
        rows, cells = self.rows, self.cells
        residual = rows.residual(number == 0, classes)
        drawn = rows.drawn(number, row_share, seed)
        members = {0: np.arange(len(rows.label), dtype=np.int32)}
        chosen = {0: np.flatnonzero(drawn).astype(np.int32)}
        totals, first = self.sums([chosen[0]], [chosen[0]], residual)
        tree = [Node(totals[0])]
        if not tree[0].sums[0]:
            raise ValueError("No row was drawn for a tree.")
        sums = {0: tuple(x[0] for x in first)}
        open_nodes = [0]
        for level in range(depth):
            found = self.splits(open_nodes, tree, [np.array(x) for x in zip(*[sums[k] for k in open_nodes])], number, column_share, seed)
            smaller, fresh = [], []
            for k in open_nodes:
                if k not in found:
                    continue
                cell, gain, n_left, n_right = found[k]
                node = tree[k]
                node.feature, node.gain = int(cells.feature[cell]), gain
                node.bin = cell % BINS if cell < cells.numeric else 0
                node.left, node.right = len(tree), len(tree) + 1
                tree += [Node((0.0, 0.0, 0.0, 0.0)), Node((0.0, 0.0, 0.0, 0.0))]
                for held in (members, chosen):
                    at = held.pop(k)
                    right = rows.right(node, at)
                    held[node.left], held[node.right] = at[~right], at[right]
                fresh += [node.left, node.right]
                smaller.append((k, *((node.left, node.right) if n_left <= n_right else (node.right, node.left))))
            if not fresh:
                break
            open_nodes, last = fresh, level + 1 == depth
            totals, few = self.sums([chosen[k] for k in fresh], [] if last else [chosen[k] for _, k, _ in smaller], residual)
            for k, total in zip(fresh, totals):
                tree[k].sums = total
            if not last:
                before, sums = sums, {}
                for j, (parent, few_of, rest_of) in enumerate(smaller):
                    sums[few_of] = tuple(x[j] for x in few)
                    sums[rest_of] = tuple(x - y for x, y in zip(before[parent], sums[few_of]))
        self.leaves = members
        return tree

    def move(self, tree: list[Node], weight: float) -> None:
        for k, at in self.leaves.items():
            self.rows.margin[at] += weight * tree[k].value


def at_once(
    held: DataFrame, layout: Layout, classes: bool, rounds: int, step: float, depth: int, row_share: float,
    column_share: float, seed: int,
) -> list[list[Node]]:
    """The tree of each round; all rounds are one job of tasks that run side by side."""
    tasks = max(min(slots(held.sparkSession), -(-held.count() // ROWS_PER_TASK)), 1)
    names = ["_row", "_label", "_weight", *[f"b_{k}" for k in range(len(layout.numbers))], *[f"c_{k}" for k in range(len(layout.categories))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get() if tasks > 1 else TaskContext.get()

        def gather(own: bytes) -> list[bytes]:
            return [base64.b64decode(x) for x in context.allGather(base64.b64encode(own).decode())]

        spool = Spool(names)
        for batch in batches:
            spool.write(batch)
        grower = Grower(layout, spool, gather, tasks)
        for number in range(rounds):
            tree = grower.tree(number, classes, depth, row_share, column_share, seed)
            grower.move(tree, step if number else 1.0)
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_pydict({"number": [number], "tree": [pickle.dumps(tree)]})

    table = binned(held, layout).drop("_margin").repartition(tasks)
    found = table.mapInArrow(run, "number long, tree binary", barrier=tasks > 1).collect()
    return [pickle.loads(row.tree) for row in sorted(found, key=lambda row: row.number)]


def as_model(spark: SparkSession, trees: list[tuple[list[Node], float]], layout: Layout, classes: bool):
    """MLlib's model of the trees, which predicts, saves and loads like one that MLlib fitted."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml, impurity = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity
    kind = ml.regression.DecisionTreeRegressionModel

    def doubles(values: Sequence[float]):
        array = gateway.new_array(jvm.double, len(values))
        for k, value in enumerate(values):
            array[k] = float(value)
        return array

    def node_of(tree: list[Node], k: int):
        node = tree[k]
        stats = impurity.VarianceCalculator(doubles(node.sums[1:]), int(node.sums[0]))
        if node.feature < 0:
            return ml.tree.LeafNode(node.value, node.impurity, stats)
        number = node.feature < len(layout.numbers)
        split = ml.tree.ContinuousSplit(node.feature, layout.thresholds[node.feature][node.bin] if number else 0.5)
        sides = node_of(tree, node.left), node_of(tree, node.right)
        return ml.tree.InternalNode(node.value, node.impurity, node.gain, *sides, split, stats)

    grown = gateway.new_array(kind, len(trees))
    for k, (tree, _) in enumerate(trees):
        grown[k] = kind(f"dtr_{k}", node_of(tree, 0), layout.width)
    weights = doubles([weight for _, weight in trees])
    uid = jvm.org.apache.spark.ml.util.Identifiable.randomUID("gbt")
    if classes:
        return GBTClassificationModel(ml.classification.GBTClassificationModel(uid, grown, weights, layout.width, 2))
    return GBTRegressionModel(ml.regression.GBTRegressionModel(uid, grown, weights, layout.width))
