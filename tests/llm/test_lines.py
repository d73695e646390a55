import random
import re

import numpy as np
import pytest
import xxhash

from priorline.llm import lines as module
from priorline.llm.components import connected_components
from priorline.llm.lines import dedup_lines, without_repeated_lines


def brute(rows, threshold=0.8, min_words=5):
    """(doc_id, line) of removed lines, comparing all pairs."""
    found = []
    for key, text in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        for number, line in enumerate((text or "").split("\n")):
            words = re.findall(r"\w+", line.lower())
            if len(words) >= min_words:
                found.append((key, number, set(words)))
    removed = set()
    for k, (key, number, words) in enumerate(found):
        for _, _, other in found[:k]:
            if len(words & other) * 5 >= 4 * len(words | other):
                removed.add((key, number))
                break
    return removed


def corpus(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(300)]
    pool = [rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 90])) for _ in range(25)]
    rows = []
    for key in range(docs):
        text = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(pool)) if rng.random() < 0.6 else rng.choices(vocabulary, k=rng.randint(1, 30))
            for _ in range(rng.randint(0, 2) * (rng.random() < 0.7)):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            rng.shuffle(line)
            text.append(" ".join(line).title() + ".")
        rows.append((key * 3, "\n".join(text)))
    return rows


def got(result):
    return {(r.doc_id, int(k)) for r in result.collect() for k in r.removed.split(",") if k}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(frame, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert len(want) > 30
    assert got(dedup_lines(frame(rows).repartition(3))) == want


def test_small_blocks_give_the_same(frame, monkeypatch):
    rows = corpus(3, 40)
    monkeypatch.setattr(module, "cells_of", lambda m, s, f=module.cells_of: f(m, s, 60))
    index = module.prefix_index
    monkeypatch.setattr(module, "CELL_LINES", 2)
    assert got(dedup_lines(frame(rows))) == brute(rows)
    assert index is module.prefix_index


def test_stage(frame):
    one, two = "the quick brown fox jumps over", "lines of some other document here"
    docs = frame(
        [(1, f"{one}\nshort\n{two}", 9, "a"), (2, f"{one}\nshort", 9, "b"), (3, f"{two} now\nown words that are only here", 9, "c"), (4, None, 9, "d"), (5, "", 9, "e"), (6, "tiny", 9, "f")],
        "doc_id long, text string, n_chars long, key string",
    )
    kept = {r.doc_id: r for r in without_repeated_lines(docs).collect()}
    assert sorted(kept) == [1, 3, 4, 5, 6]
    assert kept[3].text == "own words that are only here" and kept[3].n_chars == 28 and kept[3].key == "c"
    assert kept[1].text == f"{one}\nshort\n{two}" and kept[1].n_chars == 9 and kept[4].text is None
    assert without_repeated_lines(docs).columns == docs.columns


def test_stage_keeps_own_short_lines(frame):
    """Under a shared banner line, only a document whose short lines all stand in earlier ones goes."""
    banner = "the quick brown fox jumps over"
    texts = [f"{banner}\nmilk", f"{banner}\nmilk\n\nflour and eggs", f"{banner}\n \nmilk", f"{banner}\nflour and eggs\nmilk", f"sugar\n{banner}"]
    kept = {r.doc_id: r.text for r in without_repeated_lines(frame(list(enumerate(texts)))).collect()}
    assert kept == {0: texts[0], 1: "milk\n\nflour and eggs", 4: "sugar"}


def test_odd_rows(frame, odd_rows):
    assert got(dedup_lines(frame(odd_rows))) == set()
    assert dedup_lines(frame([])).count() == 0
    same = [(k, "one two three four five six") for k in range(200)] + [(None, "one two three four five six")]
    assert got(dedup_lines(frame(same))) == {(k, 0) for k in range(200)}


def mark(text):
    """The hash that orders texts under one id."""
    value = xxhash.xxh64_intdigest((text or "").encode(), seed=42)
    return value - 2**64 if value >= 2**63 else value


def of_documents(rows):
    """(doc_id, text, line) of the removed lines, a document being an id with a text."""
    documents = sorted({(key is not None, key or 0, mark(text), key, text) for key, text in rows})
    removed = brute([(k, text) for k, (*_, text) in enumerate(documents)])
    return {(documents[k][3], documents[k][4], line) for k, line in removed}


def documents_in_question():
    """Repeated rows, null ids, the smallest id and several texts under one id, each case with words of its own."""
    line, near = "one two three four five six seven eight nine", "one two three four five six seven eight ten"
    cases = [
        [(1, line), (1, line), (2, near)], [(None, line), (None, line), (2, near)], [(None, line), (None, near), (2, near)],
        [(0, line), (1, f"{near}\nown words that stand here alone"), (1, "short title\nanother five words that stay")],
        [(-(2**63), line), (None, line), (-(2**63), near)],
    ]
    rows = [
        (key if key is None or key < 0 else 100 * k + key, re.sub(r"(\w+)", rf"{'pqrst'[k]}\1", text))
        for k, case in enumerate(cases) for key, text in case
    ]
    more = corpus(5, 30)
    return rows + [(None if k < 12 else k // 6, text) for k, text in more] + more[10:20] + more[12:14]


@pytest.mark.parametrize("partitions", [1, 7])
def test_documents_are_ids_with_texts(frame, partitions):
    rows = documents_in_question()
    removed = of_documents(rows)
    assert len({key for key, _, _ in removed}) > 5 and len([key for key, _, _ in removed if key is None]) > 2
    of = lambda key, text: sorted(n for k, t, n in removed if (k, t) == (key, text))
    found = dedup_lines(frame(rows).repartition(partitions)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.removed) for r in found) == sorted(
        (key is not None, key or 0, ",".join(map(str, of(key, text)))) for key, text in rows
    )


def test_a_text_loses_its_own_lines_only(frame):
    rows = documents_in_question()
    removed = of_documents(rows)
    left = {(r.doc_id, r.text) for r in without_repeated_lines(frame(rows).repartition(3)).collect()}
    for key, text in rows:
        gone = {n for k, t, n in removed if (k, t) == (key, text)}
        stays = [part for n, part in enumerate(text.split("\n")) if n not in gone]
        if not gone or any(len(re.findall(r"\w+", part)) >= 5 for part in stays):
            assert (key, "\n".join(stays)) in left


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(module, "CHARS_AT_ONCE", 50)
    text = "\n".join(f"line {k} has five words" for k in range(40)) + "\n\n" + "x" * 200 + "\nlast line has five words"
    parts = list(module.pieces(text))
    assert "\n".join(piece for _, piece in parts) == text and len(parts) > 10
    assert all(before == "\n".join(p for _, p in parts[:k]).count("\n") + (k > 0) for k, (before, _) in enumerate(parts))
    numbers = [n for _, lines in module.in_batches(((0, b, p) for b, p in parts), 5) for n in lines.numbers]
    assert numbers == [n for n, line in enumerate(text.split("\n")) if len(line.split()) >= 5]
    with pytest.raises(ValueError):
        module.LineBatch(["\n" * (1 << 20)], [0], 5)


def test_more_than_a_million_lines(frame):
    """Line numbers of one batch have twenty bits; a text of more lines is cut before."""
    distinct = "\n".join(f"a{k} b{k} c{k} d{k} e{k}" for k in range(1_048_590))
    rows = [(1, distinct + "\nsame words in every line here"), (2, "same words in every line here")]
    lines = {r.doc_id: r for r in dedup_lines(frame(rows)).collect()}
    assert lines[1].n_removed == 0 and lines[1].n_lines == 1_048_591 and lines[2].removed == "0"


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)]
    edges += [(k, k + 1) for k in range(2000, 2060)] + [(None, 5), (7, 7)]
    want, parent = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert np.array_equal(module.joined_labels(np.arange(4), np.array([0, 2]), np.array([1, 1])), [0, 0, 0, 3])


def test_index_rows_travel_in_buckets(frame):
    docs = frame(corpus(1)).coalesce(1)
    rarity = np.full(module.COUNTERS, 16, dtype=np.uint8)
    found = module.prefix_index(module.documents_of(docs), rarity, 0.8, 5).collect()
    # A bucket has one row for many index rows; each of these is there, and in the bucket of its cell.
    assert len({row.bucket for row in found}) == len(found)
    buckets = module.BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = [(row.bucket, np.frombuffer(row.rows, dtype=np.int64).reshape(5, -1)) for row in found]
    assert all((part[0].view(np.uint64) % np.uint64(buckets) == bucket).all() for bucket, part in index)
    sets = {frozenset(re.findall(r"\w+", line.lower())) for _, text in corpus(1) for line in (text or "").split("\n") if len(re.findall(r"\w+", line)) >= 5}
    # A line that a batch holds twice is indexed twice.
    rows = {tuple(row) for _, part in index for row in part.T.tolist()}
    assert len(rows) == sum(len(x) - -(-4 * len(x) // 5) + 1 for x in sets)
