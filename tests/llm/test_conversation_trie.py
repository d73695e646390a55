import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from priorline.llm.conversation_trie import KEY, ZFastTrie, prefix_nodes, two_fattest

SCHEMA = "conv_id long, turn long, role string, text string"


def plainly(rows):
    """The contract read literally: {path: (smallest, depth, parent, members, children, leaves, saved, ends)}."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {conv: [t for _, t in sorted(found)] for conv, found in turns.items()}
    rebuilt = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = tuple(own.get(conv - conv % 100, [])[:h] + own[conv][h:])
    members = defaultdict(list)
    for conv, path in rebuilt.items():
        for depth in range(len(path) + 1):
            members[path[:depth]].append(conv)
    children = Counter(path[:-1] for path in members if path)
    found = {}
    for path, inside in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in inside if len(rebuilt[c]) == len(path))
        found[path] = (
            min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), children[path],
            sum(not children[p] for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return sorted(found.values(), key=repr)


def result(nodes):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(line[n] for n in names) for line in nodes.collect()), key=repr)


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 60):
            assert two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda x: x & -x)


def test_trie_of_a_batch_holds_every_prefix_once():
    rng = random.Random(5)
    for _ in range(60):
        paths = []
        for _ in range(rng.randint(1, 25)):
            word = [rng.choice("ab") for _ in range(rng.randint(0, 12))]
            paths.append([hashlib.md5("".join(word[: d + 1]).encode()).digest() for d in range(len(word))])
        trie = ZFastTrie()
        for path in paths:
            trie.insert(b"".join(path))
        joined = [key for path in paths for key in path]
        nodes, places = trie.expanded()
        keys = [joined[p] for p in places]
        assert len(keys) == len(set(keys)) and set(keys) == set(joined)
        best = trie.smallest(10 - __import__("numpy").arange(len(paths)))
        sums = trie.sums(__import__("numpy").ones((len(paths), 1), dtype=int))[:, 0]
        for node, key in zip(nodes, keys):
            through = [k for k, path in enumerate(paths) if key in path]
            assert sums[node] == len(through) and best[node] == max(through)
        for path in paths:
            depth, node, edge = trie.locate(b"".join(path))
            assert depth == len(path) and edge in (-1, *range(len(trie.extent)))
            unknown = hashlib.md5(b"unknown").digest()
            for cut in range(len(path) + 1):
                assert trie.locate(b"".join(path[:cut]) + unknown)[0] == cut
        assert all(len(key) == KEY for key in trie.handles) and len(trie.handles) == len(trie.extent) - 1


def made(seed, convs=260, longest=9, letters="ab"):
    """Conversations of few different turns, so that prefixes are shared at all depths."""
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(400), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, turn, rng.choice(["user", None]), rng.choice([*letters, "é\U0001f600", ""])))
    return rows


@pytest.mark.parametrize("seed,segment,partitions", [(1, 1024, 1), (2, 6, 3), (3, 7, 7)])
def test_nodes_against_brute_force(spark, frame, seed, segment, partitions):
    rows = made(seed, longest=9 if segment > 100 else 40, letters="a" if seed == 3 else "ab")
    found = prefix_nodes(frame(rows, SCHEMA).repartition(partitions), segment=segment, chunk=8)
    assert result(found) == plainly(rows)


def test_a_hot_conversation_and_a_hot_path(frame):
    rows = [(7, turn, "user", str(turn % 3)) for turn in range(500)]
    rows += [(conv, turn, "user", str(turn % 3)) for conv in range(100, 180) for turn in range(8)]
    assert result(prefix_nodes(frame(rows, SCHEMA).repartition(5), segment=16, chunk=16)) == plainly(rows)


def test_odd_rows(frame):
    rows = [
        (None, 1, "user", "lost"), (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, None, ""),
        (-3, 1, "user", "minus"), (-103, 1, "user", "minus"), (100, 0, "user", "x" * 200_000), (104, 0, "user", "y"), (105, 0, "user", "y"),
    ]
    positive = [row for row in rows if row[0] is None or row[0] >= 0]
    assert result(prefix_nodes(frame(positive, SCHEMA))) == plainly(positive)
    assert sum(line.n_children for line in prefix_nodes(frame(rows, SCHEMA)).collect()) > 0
    assert prefix_nodes(frame([], SCHEMA)).count() == 0
    turnless = [(101, 0, "user", "a")]  # borrows from a conversation that is absent, and skips its own
    assert result(prefix_nodes(frame(turnless, SCHEMA))) == plainly(turnless)
    extra = frame([(1, 0, "u", "t", 5, 6)], SCHEMA + ", conv int, p0 int")
    assert result(prefix_nodes(extra)) == plainly([(1, 0, "u", "t")])
