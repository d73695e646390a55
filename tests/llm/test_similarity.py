import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from priorline.llm import similarity
from priorline.llm.similarity import cells_of, similar_rows, whole_cells, word_scanner


@pytest.mark.parametrize("at_once", [1, 50, 4_000_000])
def test_similar_rows_against_all_pairs(monkeypatch, at_once):
    monkeypatch.setattr(similarity, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(3)
    rows = []
    for cell in range(30):
        base = rng.sample(range(1000), 20)
        for _ in range(rng.randint(2, 9)):
            side = -1 if cell % 2 else rng.randint(0, 1)
            rows.append((cell, side, sorted(rng.sample(base, rng.randint(15, 20)))))
    table = pa.table({
        "cell": [r[0] for r in rows], "side": [r[1] for r in rows],
        "elements": [np.array(r[2], dtype=np.uint64).tobytes() for r in rows],
    })
    got = {(int(a), int(b)) for i, j in similar_rows(table, 0.8) for a, b in zip(i, j)}
    want = {
        (a, b) for a, x in enumerate(rows) for b, y in enumerate(rows)
        if a != b and x[0] == y[0] and (x[1] < 0 or x[1] != y[1])
        and 5 * len({*x[2]} & {*y[2]}) >= 4 * len({*x[2]} | {*y[2]})
    }
    assert got == want and len(want) > 50


def test_cells_stay_whole_over_batches():
    cells = [1, 2, 2, 3, 3, 3, 3, 4, 5, 5]
    for size in (1, 2, 3, 10):
        batches = [pa.record_batch({"cell": cells[k : k + size]}) for k in range(0, len(cells), size)]
        tables = [t.column("cell").to_pylist() for t in whole_cells(iter(batches))]
        assert [c for t in tables for c in t] == [2, 2, 3, 3, 3, 3, 5, 5]
        assert all(not set(a) & set(b) for a, b in zip(tables, tables[1:]))


def test_tables_follow_the_cells_and_not_the_batches():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 20))]
        cells = [k for k, n in enumerate(sizes) for _ in range(n)]
        values = [bytes(rng.randint(0, 30)) for _ in cells]
        step, at_once = rng.choice([1, 3, 8, 1000]), rng.choice([1, 60, 300, 10_000])
        batches = [
            pa.record_batch({"cell": cells[k : k + step], "value": pa.array(values[k : k + step], pa.binary())})
            for k in range(0, len(cells), step)
        ]
        tables = list(whole_cells(iter(batches), at_once=at_once))
        assert [c for t in tables for c in t.column("cell").to_pylist()] == [c for c in cells if sizes[c] > 1]
        held = [set(t.column("cell").to_pylist()) for t in tables]
        assert all(not a & b for a, b in zip(held, held[1:]))
        if step >= 1000:  # one batch: a table is one cell or within the limit
            for table in tables:
                weight = sum(16 + len(v) for v in table.column("value").to_pylist())
                assert weight <= at_once or len(set(table.column("cell").to_pylist())) == 1


def test_core_members_do_not_meet(frame):
    members = [(k, k % 3, 10, k % 2 == 0) for k in range(60)]
    sets = frame([(k, k, b"") for k, *_ in members], "id long, rank long, elements binary")
    for block in (1_000_000, 35, 10):
        cells = cells_of(frame(members, "id long, component int, size int, core boolean"), sets, block).collect()
        met = Counter()
        inside = defaultdict(list)
        for row in cells:
            inside[row.cell].append((row.id, row.side))
        for rows in inside.values():
            met.update({(a, b) for a, s in rows for b, t in rows if a < b and (s < 0 or s != t)})
        for a, part, _, core in members:
            for b, other, _, too in members:
                if a < b and part == other and not (core and too):
                    assert met[a, b] == 1
                elif a < b and part != other:
                    assert met[a, b] == 0


def test_scanned_words_are_those_of_the_pattern():
    text = "Ünï_code w0rds,\nañd 你好\n\n  x²٣ é _ " + "long" * 300
    hashes, starts, breaks = word_scanner().scan(text)
    words = list(re.finditer(r"\w+", text))
    assert starts.tolist() == [m.start() for m in words] and breaks.tolist() == [k for k, c in enumerate(text) if c == "\n"]
    again = {m[0]: int(h) for m, h in zip(words, hashes)}
    assert len(set(again.values())) == len(again)
    assert word_scanner().scan("Ünï_code")[0][0] == again["Ünï_code"] and word_scanner().scan("x " * 10 + "e")[0][-1] == again["e"]
