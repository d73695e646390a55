"""Conversation prefix trie: z-fast tries of batches, merged by prefix digest.

A conversation is the sequence of its turns. The digest of a prefix is the exclusive or of one random-like
128-bit number for each (depth, turn), so digests of all prefixes come from one running operation, and a
node of the trie is named by the digest of its prefix.

1. *Numbering.* Turns are sorted by conversation in ranges; a range adds what its first conversation had
   in the ranges before it. Sequences are cut into segments of ``SEGMENT`` turns, so neither a long
   conversation nor a hot one is ever in one task or row.
2. *Z-fast tries.* Each task inserts its sequences in batches of bounded size into a compacted trie: a
   node is hashed at its handle, the prefix whose depth is the two-fattest number (the one divisible by
   the highest power of two) on its edge. A fat binary search over depths finds the edge on which a
   sequence leaves the trie with a logarithmic number of look-ups; the edge is split there.
3. *Exits.* Edges are expanded to nodes, and tries of all batches are merged by digest, keeping the
   smallest member of each node. A conversation that is the smallest member of a node is so below it as
   well, hence the first such depth is where it leaves the trie of all smaller conversations.
4. *Counts.* Only the part of each conversation that it shares with smaller ones is inserted again, with
   what it adds to the nodes above its exit: one member, the characters it shares, one more leaf. A
   node's smallest member brings the rest, so nothing is gathered below a node.

Members that end at a node are joined in chunks of ``CHUNK`` neighbouring ids and digested as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.similarity import mixed, signed
from priorline.sources.durable import durable

#: A conversation borrows fewer than so many turns from the first of its block of ids.
BORROWED, BLOCK_IDS = 6, 100
#: Turns in one row, at most; more than are borrowed.
SEGMENT = 1024
#: Turns in the sequences of one batch, about.
TURNS_AT_ONCE = 200_000
#: Ids that one chunk of a node's ending members spans.
CHUNK = 4096
KEY = 16


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << (low ^ high).bit_length() - 1)


class ZFastTrie:
    """A compacted trie of sequences, each given by the 16-byte digests of its prefixes."""

    def __init__(self) -> None:
        self.paths: list[bytes] = []
        self.ends: list[int] = []  # the node where each sequence ends
        # For each node: depths where its edge starts and ends, its parent, a sequence that runs through it.
        self.start, self.extent, self.parent, self.owner = [0], [0], [-1], [-1]
        self.handles: dict[bytes, int] = {}
        self.edges: dict[bytes, int] = {}  # by the first digest on the edge

    def key(self, node: int, depth: int) -> bytes:
        return self.paths[self.owner[node]][KEY * (depth - 1) : KEY * depth]

    def locate(self, path: bytes) -> tuple[int, int, int]:
        """(depth, node, edge): how deep a path agrees with the trie, and the last node it passes whole.

        edge: the node on whose edge the path leaves or ends, or -1 if it does so at the node before.
        """
        low, high, node, size = 0, len(path) // KEY, 0, len(path) // KEY
        edge = -1
        while low < high:
            depth = two_fattest(low, high)
            found = self.handles.get(path[KEY * (depth - 1) : KEY * depth])
            if found is None:
                high = depth - 1
                continue
            extent = self.extent[found]
            if extent > size or path[KEY * (extent - 1) : KEY * extent] != self.key(found, extent):
                edge, low = found, depth
                break
            low, node = extent, found
        if edge < 0:
            edge = self.edges.get(path[KEY * low : KEY * (low + 1)], -1) if low < size else -1
            if edge < 0:
                return low, node, -1
            low += 1
        else:
            node = self.parent[edge]
        # The path agrees with the edge up to low; the digests tell how far it does beyond.
        high = min(size, self.extent[edge])
        while low < high:
            middle = (low + high + 1) // 2
            if path[KEY * (middle - 1) : KEY * middle] == self.key(edge, middle):
                low = middle
            else:
                high = middle - 1
        return low, node, edge

    def attach(self, start: int, extent: int, parent: int, owner: int, node: int | None = None) -> int:
        """Put a new node, or one whose edge has changed, below its parent."""
        if node is None:
            node = len(self.extent)
            for column, value in ((self.start, 0), (self.extent, 0), (self.parent, 0), (self.owner, 0)):
                column.append(value)
        self.start[node], self.extent[node], self.parent[node], self.owner[node] = start, extent, parent, owner
        self.edges[self.key(node, start + 1)] = node
        self.handles[self.key(node, two_fattest(start, extent))] = node
        return node

    def insert(self, path: bytes) -> None:
        self.paths.append(path)
        size, own = len(path) // KEY, len(self.paths) - 1
        depth, node, edge = self.locate(path)
        if edge >= 0 and depth < self.extent[edge]:
            start, extent, owner = self.start[edge], self.extent[edge], self.owner[edge]
            del self.handles[self.key(edge, two_fattest(start, extent))]
            node = self.attach(start, depth, node, owner)
            self.attach(depth, extent, node, owner, edge)
        elif edge >= 0:
            node = edge
        if depth < size:
            node = self.attach(depth, size, node, own)
        self.ends.append(node)

    def smallest(self, values: np.ndarray) -> np.ndarray:
        """For each node, the sequence of the smallest value among those that run through it."""
        best = [-1] * len(self.extent)
        for sequence, node in enumerate(self.ends):
            if best[node] < 0 or values[sequence] < values[best[node]]:
                best[node] = sequence
        for node in self.upwards():
            above, found = self.parent[node], best[node]
            if best[above] < 0 or values[found] < values[best[above]]:
                best[above] = found
        return np.array(best, dtype=np.int64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each node, the sums of the values (columns) of the sequences that run through it."""
        total = np.zeros((len(self.extent), values.shape[1]), dtype=np.int64)
        np.add.at(total, np.array(self.ends, dtype=np.int64), values)
        for node in self.upwards():
            total[self.parent[node]] += total[node]
        return total

    def upwards(self) -> list[int]:
        """All nodes but the root, children before their parents."""
        return sorted(range(1, len(self.extent)), key=self.extent.__getitem__, reverse=True)

    def expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, place): each depth on each edge, as a place in the joined paths of all sequences."""
        start, extent, owner = (np.array(x, dtype=np.int64) for x in (self.start, self.extent, self.owner))
        sizes = np.array([len(path) // KEY for path in self.paths], dtype=np.int64)
        firsts = np.cumsum(sizes) - sizes
        counts = extent - start
        node = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(node)) - np.repeat(np.cumsum(counts) - counts, counts) + start[node] + firsts[owner[node]]
        return node, place


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, d0, d1, chars) of each turn; nulls are empty, rows without an id go."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(
        F.col("`conv_id`").cast("long").alias("conv"), F.col("`turn`").alias("turn"),
        F.xxhash64(role, text).alias("d0"), F.xxhash64(F.lit("second"), role, text).alias("d1"),
        F.length(text).cast("long").alias("chars"),
    ).where("conv IS NOT NULL")


def numbered(turns: DataFrame) -> DataFrame:
    """turns with pos, their number from 1 within the conversation; equal turns are ordered by digest."""
    spark = turns.sparkSession
    order = ("conv", "turn", "d0", "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            heads = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            pos = np.arange(1, len(conv) + 1) - np.repeat(heads, np.diff(np.append(heads, len(conv))))
            if conv[0] == last:
                pos[: heads[1] if len(heads) > 1 else len(conv)] += count
            last, count = conv[-1], int(pos[-1])
            columns = [batch.column(c) for c in ("conv", "d0", "d1", "chars")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(pos, pa.int64()), pa.array(np.full(len(conv), part), pa.int32())],
                names=["conv", "d0", "d1", "chars", "pos", "part"],
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = durable(turns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = durable(ranges.mapInArrow(run, "conv long, d0 long, d1 long, chars long, pos long, part int"))
    # A row for each range reaches the driver: the first conversation, and the last one with its turns there.
    place = F.struct("conv", "pos")
    edges = local.groupBy("part").agg(F.min(place).alias("first"), F.max(place).alias("last")).orderBy("part").collect()
    opening, conv, count = [], None, 0
    for edge in edges:
        before = count if edge.first.conv == conv else 0
        opening.append((edge.part, edge.first.conv, before))
        conv, count = edge.last.conv, edge.last.pos + (before if edge.last.conv == edge.first.conv else 0)
    before = spark.createDataFrame(opening, "range int, opened long, before long")
    carried = F.when(F.col("conv") == F.col("opened"), F.col("before")).otherwise(0)
    return local.join(F.broadcast(before), F.col("part") == F.col("range")).select(
        "conv", "d0", "d1", "chars", (F.col("pos") + carried).alias("pos")
    )


def borrowed_turns() -> Column:
    return F.crc32(F.col("conv").cast("string").cast("binary")) % BORROWED


def rebuilt_segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, part, start, size, x0, x1, total, path, chars) of the rebuilt conversations.

    turns: numbered. A part holds the depths after start; path are the digests of its prefixes as if it
    began the conversation, x0 and x1 the last of them, chars the running number of characters. The first
    part is there for conversations without turns, too.
    """
    turn = F.struct("pos", "d0", "d1", "chars")
    openings = turns.where((F.col("pos") < BORROWED) & (F.col("conv") % BLOCK_IDS == 0)).groupBy(
        F.col("conv").alias("block")
    ).agg(F.sort_array(F.collect_list(turn)).alias("opening"))
    own = turns.groupBy("conv", F.floor((F.col("pos") - 1) / segment).cast("int").alias("part")).agg(
        F.sort_array(F.collect_list(turn)).alias("own")
    )
    block = F.col("conv") - F.col("conv") % BLOCK_IDS
    both = own.join(openings, block == F.col("block"), "left").select(
        "conv", "part", borrowed_turns().cast("int").alias("h"),
        *[F.col(f"{side}.{name}").alias(f"{side}_{name}") for side in ("own", "opening") for name in ("d0", "d1", "chars")],
    )

    def values(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
        digests = np.array([row[f"{side}_d0"] or [], row[f"{side}_d1"] or []], dtype=np.int64).T.view(np.uint64)
        return digests.reshape(-1, 2), np.array(row[f"{side}_chars"] or [], dtype=np.int64)

    def rebuilt(row: dict) -> tuple:
        digests, chars = values(row, "own")
        opening, opening_chars = values(row, "opening")
        borrowed = min(row["h"], len(opening))
        if row["part"] == 0:
            digests = np.concatenate([opening[:borrowed], digests[row["h"] :]])
            chars = np.concatenate([opening_chars[:borrowed], chars[row["h"] :]])
            start = 0
        else:
            start = row["part"] * segment - row["h"] + borrowed
        depth = np.arange(start + 1, start + 1 + len(digests), dtype=np.uint64)
        here = np.stack([mixed(digests[:, k] + mixed(depth, 60 + k), 62 + k) for k in (0, 1)], axis=1)
        path = np.bitwise_xor.accumulate(here, axis=0) if len(here) else here
        x0, x1 = signed(path[-1]).tolist() if len(path) else (0, 0)
        running = np.cumsum(chars)
        total = int(running[-1]) if len(running) else 0
        return row["conv"], row["part"], start, len(path), x0, x1, total, path.tobytes(), running.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [rebuilt(row) for row in batch.to_pylist()]
            if lines:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*lines), schema)], schema=schema
                )

    schema = pa.schema(
        [
            ("conv", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("size", pa.int64()), ("x0", pa.int64()),
            ("x1", pa.int64()), ("total", pa.int64()), ("path", pa.binary()), ("chars", pa.binary()),
        ]
    )
    return both.mapInArrow(
        run, "conv long, part int, start long, size long, x0 long, x1 long, total long, path binary, chars binary"
    )


def sequences_of(segments: DataFrame) -> DataFrame:
    """segments with p0, p1, before (digest and characters of what lies before) and length, of all parts.

    Only conversations of several parts need the others; of those, a row without turns for each part.
    """
    several = segments.where("part > 0").select(F.col("conv").alias("of")).distinct()
    narrow = segments.select("conv", "part", "size", "x0", "x1", "total")
    parts = narrow.join(several, F.col("conv") == F.col("of")).select(narrow["*"])
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    opening = parts.select(
        F.col("conv").alias("of"), F.col("part").alias("nr"),
        *[F.expr(f"bit_xor({x})").over(earlier).alias(f"o{k}") for k, x in enumerate(("x0", "x1"))],
        F.sum("total").over(earlier).alias("opened"), F.sum("size").over(Window.partitionBy("conv")).alias("all"),
    )
    joined = segments.join(opening, (F.col("conv") == F.col("of")) & (F.col("part") == F.col("nr")), "left")
    return joined.select(
        "conv", "start", "size", "x0", "x1", "total", "path", "chars", F.coalesce("all", "size").alias("length"),
        *[F.coalesce(f"o{k}", F.lit(0)).alias(f"p{k}") for k in (0, 1)], F.coalesce("opened", F.lit(0)).alias("before"),
    )


class Batch:
    """Sequences of one task with a common start depth, as a z-fast trie and flat arrays."""

    def __init__(self, rows: list[dict], shared: bool):
        self.rows, self.trie = rows, ZFastTrie()
        paths, chars, above, before = [], [], [], []
        for row in rows:
            size = min(row["size"], row["exit"] - row["start"]) if shared else row["size"]
            root = np.array([row["p0"], row["p1"]], dtype=np.int64).view(np.uint64)
            path = np.frombuffer(row["path"], dtype=np.uint64).reshape(-1, 2)[:size] ^ root
            self.trie.insert(path.tobytes())
            paths.append(path)
            above.append(np.concatenate([root[None], path])[:-1] if len(path) else path)
            if not shared:
                running = np.frombuffer(row["chars"], dtype=np.int64) + row["before"]
                before.append(np.append(row["before"], running)[:-1])
                chars.append(running - before[-1])
        self.paths, self.above = np.concatenate(paths), np.concatenate(above)
        if not shared:
            self.chars, self.before = np.concatenate(chars), np.concatenate(before)
        self.node, self.place = self.trie.expanded()

    def column(self, name: str) -> np.ndarray:
        return np.array([row[name] for row in self.rows], dtype=np.int64)

    def keys(self, values: np.ndarray) -> list[pa.Array]:
        return [pa.array(signed(values[self.place, k])) for k in (0, 1)]


def batches_of(batches: Iterator[pa.RecordBatch], shared: bool) -> Iterator[Batch]:
    """Sequences in batches of about ``TURNS_AT_ONCE`` turns, one for each start depth in them."""
    held: dict[int, list[dict]] = {}
    turns = 0
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["start"], []).append(row)
            turns += row["size"] + 1
            if turns >= TURNS_AT_ONCE:
                yield from (Batch(rows, shared) for rows in held.values())
                held, turns = {}, 0
    yield from (Batch(rows, shared) for rows in held.values())


def members(sequences: DataFrame) -> DataFrame:
    """(p0, p1, q0, q1, depth, conv, length, chars, before): nodes below the root with their smallest member.

    q0, q1: the parent's digest. length: turns of that member. chars: characters of the node's last turn,
    before: of those above it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, shared=False):
            best = batch.trie.smallest(batch.column("conv"))[batch.node]
            rel = batch.place - (np.cumsum(batch.column("size")) - batch.column("size"))[
                np.array(batch.trie.owner)[batch.node]
            ]
            numbers = (
                rel + 1 + batch.column("start")[best], batch.column("conv")[best], batch.column("length")[best],
                batch.chars[batch.place], batch.before[batch.place],
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.keys(batch.paths), *batch.keys(batch.above), *map(pa.array, numbers)],
                names=["p0", "p1", "q0", "q1", "depth", "conv", "length", "chars", "before"],
            )

    found = sequences.where("size > 0").mapInArrow(
        run, "p0 long, p1 long, q0 long, q1 long, depth long, conv long, length long, chars long, before long"
    )
    same = ("q0", "q1", "depth", "chars", "before")
    return found.groupBy("p0", "p1").agg(
        F.min(F.struct("conv", "length")).alias("member"), *[F.max(c).alias(c) for c in same]
    ).select("p0", "p1", "member.conv", "member.length", *same)


def shared_parts(sequences: DataFrame, exits: DataFrame) -> DataFrame:
    """(p0, p1, more, x, leaves): what conversations add to the nodes above and at their exits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, shared=True):
            added = np.stack([np.ones(len(batch.rows), dtype=np.int64), batch.column("x"), batch.column("leaf")], axis=1)
            sums = batch.trie.sums(added)[batch.node]
            yield pa.RecordBatch.from_arrays(
                [*batch.keys(batch.paths), *[pa.array(sums[:, k]) for k in range(3)]], names=["p0", "p1", "more", "x", "leaves"]
            )

    inside = exits.where("exit > 0").select(F.col("conv").alias("of"), "exit", "x", "leaf")
    cut = sequences.select("conv", "start", "size", "p0", "p1", "path").join(inside, F.col("conv") == F.col("of"))
    return cut.where("exit > start").mapInArrow(run, "p0 long, p1 long, more long, x long, leaves long")


def ending_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(p0, p1, ends_sha256): digest of the comma-joined ids that end at each node, ascending.

    ends: (p0, p1, conv). Ids are joined in chunks, which a task digests one after another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for p0, p1, text in zip(*(batch.column(c).to_pylist() for c in ("p0", "p1", "ids"))):
                if (p0, p1) == last:
                    state.update(b",")
                else:
                    if last:
                        done.append((*last, state.hexdigest()))
                    last, state = (p0, p1), hashlib.sha256()
                state.update(text.encode())
            if done:
                yield table_of(done)
        if last:
            yield table_of([(*last, state.hexdigest())])

    def table_of(lines: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*lines)], names=["p0", "p1", "ends_sha256"])

    chunks = ends.groupBy("p0", "p1", F.expr(f"conv DIV {chunk}").alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunks.repartition(parts, "p0", "p1").sortWithinPartitions("p0", "p1", "chunk")
    return dealt.select("p0", "p1", "ids").mapInArrow(run, "p0 long, p1 long, ends_sha256 string")


def exits_of(convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each conversation leaves the trie of the smaller ones.

    convs: (conv, length, total, e0, e1), digest of the whole conversation last. Adds: exit, the depth (-1
    for the smallest conversation, which makes the root); u0, u1, its digest; x, characters up to there;
    f0, f1, the first node that the conversation adds, null if none; above, the exit's smallest member;
    leaf, whether the conversation adds a childless node besides those that were there.
    """
    first = nodes.groupBy(F.col("conv").alias("of")).agg(
        F.min(F.struct("depth", "p0", "p1", "q0", "q1", "before")).alias("first")
    )
    left = durable(
        convs.join(first, F.col("conv") == F.col("of"), "left").select(
            "conv", "length", "e0", "e1", F.coalesce(F.col("first.depth") - 1, "length").alias("exit"),
            F.coalesce("first.q0", "e0").alias("u0"), F.coalesce("first.q1", "e1").alias("u1"),
            F.coalesce("first.before", "total").alias("x"), F.col("first.p0").alias("f0"), F.col("first.p1").alias("f1"),
        )
    )
    at = nodes.select("p0", "p1", F.col("conv").alias("above"), F.col("length").alias("above_length"))
    found = durable(left.join(at, (F.col("u0") == F.col("p0")) & (F.col("u1") == F.col("p1")), "left").drop("p0", "p1"))
    # Of those that go on where the exit's smallest member ends, one only lengthens a chain.
    follows = (
        found.where("f0 IS NOT NULL AND above_length = exit AND above <> conv").groupBy("u0", "u1")
        .agg(F.min("conv").alias("follower")).select("follower")
    )
    return found.join(follows, F.col("conv") == F.col("follower"), "left").select(
        *found.columns, (F.col("f0").isNotNull() & F.col("follower").isNull()).cast("long").alias("leaf")
    )


def prefix_nodes(conversations: DataFrame, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """The trie of the rebuilt conversations, one line per node.

    conversations: conv_id, turn, role, text and any other columns. Turns are ordered by ``turn``, null
    first, equal ones by their digests; repeated rows are turns of their own. A null role or text is empty.
    Rows without a conv_id belong to no conversation. Every id c is rebuilt: the first crc32(c) mod 6 turns
    of conversation c - c mod 100, then its own after so many. Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table has no nodes.
    segment: turns in one row, at least BORROWED.
    """
    segments = durable(rebuilt_segments(numbered(turns_of(conversations)), segment))
    sequences = durable(sequences_of(segments))
    last = F.col("start") + F.col("size") == F.col("length")
    convs = durable(
        sequences.where(last).select(
            "conv", "length", (F.col("before") + F.col("total")).alias("total"),
            *[F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"e{k}") for k in (0, 1)],
        )
    )
    root = convs.groupBy().agg(F.min(F.struct("conv", "length")).alias("member")).where("member IS NOT NULL").select(
        F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1"), "member.conv", "member.length",
        *[F.lit(None).cast("long").alias(c) for c in ("q0", "q1")],
        *[F.lit(0).cast("long").alias(c) for c in ("depth", "chars", "before")],
    )
    nodes = durable(members(sequences).unionByName(root))
    exits = durable(exits_of(convs, nodes))
    below = exits.where("exit >= 0")
    added = durable(
        shared_parts(sequences, exits).unionByName(
            below.select(
                *[F.lit(value).cast("long").alias(c) for c, value in (("p0", 0), ("p1", 0), ("more", 1))], "x",
                F.col("leaf").alias("leaves"),
            )
        ).groupBy("p0", "p1").agg(*[F.sum(c).alias(c) for c in ("more", "x", "leaves")])
    )
    created = below.where("f0 IS NOT NULL")
    children = created.groupBy(F.col("u0").alias("p0"), F.col("u1").alias("p1")).agg(F.count("*").alias("children"))
    parents = created.select(F.col("f0").alias("p0"), F.col("f1").alias("p1"), F.col("above").alias("parent"))
    ended = ending_digests(convs.select(F.col("e0").alias("p0"), F.col("e1").alias("p1"), "conv"), chunk)
    tables = (nodes.drop("q0", "q1", "chars"), added, children, parents, ended)
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table, allowMissingColumns=True)
    names = [c for c in union.columns if c not in ("p0", "p1")]
    whole = union.groupBy("p0", "p1").agg(*[F.max(c).alias(c) for c in names])
    more, own = F.coalesce("more", F.lit(0)), (F.col("length") > F.col("depth")).cast("long")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
        (more + 1).alias("n_convs"), (F.coalesce("children", F.lit(0)) + own).alias("n_children"),
        (F.coalesce("leaves", F.lit(0)) + 1).alias("n_leaves"),
        (F.coalesce("x", F.lit(0)) - more * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


TRIE_SQL = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
    ) AS pos, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS item, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    -- crc32: each byte is added and then shifted out bit by bit, which -1 stands for.
    SELECT conv_id, conv_id - conv_id % 100 AS block, xor(list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(
            string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
        ))),
        lambda sum, step: CASE
            WHEN step >= 0 THEN xor(sum, step) WHEN sum % 2 = 1 THEN xor(sum >> 1, 3988292384) ELSE sum >> 1
        END
    ), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT c.conv_id, 0 AS part, pos, item, chars FROM convs AS c JOIN turns AS t ON t.conv_id = c.block AND pos <= h
    UNION ALL
    SELECT c.conv_id, 1, pos, item, chars FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND pos > h
), placed AS (
    SELECT conv_id, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
        list(item) OVER (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS path
    FROM rebuilt
), paths AS (
    SELECT conv_id, depth, chars, sha256(array_to_string(path, '')) AS node FROM placed
    UNION ALL
    SELECT conv_id, 0, 0, '' FROM convs
), steps AS (
    SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
        depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths
), nodes AS (
    SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
        any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends
    FROM steps GROUP BY node
), counted AS (
    SELECT n.*, (SELECT count(*) FROM nodes AS c WHERE c.parent = n.node) AS n_children FROM nodes AS n
), under AS (
    -- A node lies below every prefix of its smallest member, down to itself.
    SELECT s.node, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.chars)::BIGINT AS saved_tokens
    FROM counted AS c JOIN steps AS s ON s.conv_id = c.conv_id AND s.depth <= c.depth GROUP BY s.node
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, u.n_leaves, u.saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted AS c JOIN under AS u USING (node) LEFT JOIN nodes AS p ON p.node = c.parent
"""
