import random
import re

import pytest

from priorline.llm import near_duplicates as module
from priorline.llm.near_duplicates import near_duplicate_classes, one_of_each_class, prefix_depth


def sets_of(text):
    words = re.findall(r"\w+", (text or "").lower())
    if not words:
        return words, set()
    return words, {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """doc_id: (copy_id, class_id, n_copies, n_links), comparing all pairs of different texts."""
    first, copies = {}, {}
    for key, text in sorted(rows):
        words = tuple(sets_of(text)[0])
        first.setdefault(words, key)
        copies[words] = copies.get(words, 0) + 1
    texts = [(key, set(sets_of(" ".join(words))[1]), words) for words, key in first.items()]
    parent = {key: key for key, _, _ in texts}
    links = dict.fromkeys(parent, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, one, _) in enumerate(texts):
        for b, other, _ in texts[:k]:
            if one and other and 5 * len(one & other) >= 4 * len(one | other):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    of = {words: (key, root(key), copies[words], links[key]) for key, _, words in texts}
    return {key: of[tuple(sets_of(text)[0])] for key, text in rows}


def corpus(seed, groups=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(800)]
    rows, key = [], 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 80, 300]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((key, " ".join(words)))
            key += 1
            if rng.random() < 0.3:
                rows.append((key, " ".join(words).upper() + "!"))
                key += 1
    rng.shuffle(rows)
    return rows


def got(result):
    return {r.doc_id: (r.copy_id, r.class_id, r.n_copies, r.n_links) for r in result.collect()}


def test_recall_of_depths():
    assert prefix_depth(0.8) == 4 and prefix_depth(0.95) > prefix_depth(0.8) > prefix_depth(0.5)


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(frame, monkeypatch, small):
    rows = corpus(1 + small)
    if small:
        monkeypatch.setattr(module, "CELL_TEXTS", 2)
        monkeypatch.setattr(module, "cells_of", lambda m, s, f=module.cells_of: f(m, s, 200))
    want = brute(rows)
    assert sum(v[3] for v in want.values()) > 60
    assert got(near_duplicate_classes(frame(rows).repartition(3))) == want


def test_hot_group_is_whole(frame):
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    rows = []
    for key in range(300):
        words = list(base)
        words[key % 120] = f"new{key}"
        rows.append((key, " ".join(words)))
    found = got(near_duplicate_classes(frame(rows)))
    assert found == brute(rows) and {v[1] for v in found.values()} == {0}


def brute_rows(rows):
    """One line per row, documents told apart by their texts: rows get numbers of their own for ``brute``."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    numbered = [(n, rows[k][1]) for n, k in enumerate(order)]
    found, ids = brute(numbered), {n: rows[k][0] for n, k in enumerate(order)}
    return sorted(((ids[n], ids[c], ids[g], copies, links) for n, (c, g, copies, links) in found.items()), key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_repeated_and_null_ids_lose_nothing(frame, partitions):
    rng = random.Random(11)
    text = lambda: [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(80)]
    one, two, three = text(), text(), text()
    near = lambda words: " ".join([*words[:40], "changed", *words[41:]])
    rows = [
        (1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (1, " ".join(one)),
        (None, " ".join(three)), (None, near(three)), (None, "something else"), (9, "Something, else!"), (-(2**63), "alone here"),
        (None, "alone there"),
    ]
    found = near_duplicate_classes(frame(rows).repartition(partitions))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_rows(rows)
    kept = {tuple(r) for r in one_of_each_class(frame(rows).repartition(partitions)).collect()}
    assert kept >= {rows[0], rows[1], (9, "Something, else!"), (-(2**63), "alone here"), (None, "alone there")}
    assert len(kept) == 6 and len([text for key, text in kept if key is None]) == 2


def test_odd_rows(frame, odd_rows):
    found = near_duplicate_classes(frame(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    of = {r.doc_id: r for r in found}
    assert of[1].class_id == of[2].class_id == 1 and of[3].n_copies == 2 and of[3].class_id == 3
    assert near_duplicate_classes(frame([])).count() == 0
    docs = frame([(*row, 5) for row in odd_rows], "doc_id long, text string, class_id int")
    kept = one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.class_id) for r in kept.collect()) == [(0, 5), (1, 5), (3, 5), (3, 5), (4, 5)]
