import random
import re

import numpy as np
import pytest

from priorline.llm import super_minhash as module
from priorline.llm.super_minhash import REGISTERS, ByteWordHashes, mixed, near_duplicates, shingles, super_minhash


def shingle_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def plainly(rows):
    """(doc_id, n_shingles, component_id, kept) of each row by comparing all pairs."""
    sets = [shingle_set(text) for _, text in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                label[root(i)] = root(j)
    found = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        found.append((key, len(sets[i]), least, key == least))
    return sorted(found, key=repr)


def result(df):
    return sorted((tuple(line) for line in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def one_by_one(values):
    """SuperMinHash with the ranks above, one element after another and no early stop."""
    out = [2**64 - 1] * REGISTERS
    for value in values:
        order = list(range(REGISTERS))
        for step in range(REGISTERS):
            draw = int(mixed(np.array([value], dtype=np.uint64), 100 + step)[0])
            other = step + draw % (REGISTERS - step)
            order[step], order[other] = order[other], order[step]
            out[order[step]] = min(out[order[step]], step << 48 | draw >> 16)
    return out


@pytest.mark.parametrize("at_once", [7, 50_000])
def test_early_stop_changes_nothing(monkeypatch, at_once):
    monkeypatch.setattr(module, "SHINGLES_AT_ONCE", at_once)
    rng = np.random.default_rng(1)
    counts = np.array([1, 3, 0, 40, 300])
    values = rng.integers(0, 2**63, counts.sum(), dtype=np.uint64)
    got, at = super_minhash(values, counts), 0
    for k, n in enumerate(counts):
        assert got[k].tolist() == one_by_one(values[at : at + n])
        at += n


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    errors, plain = [], []
    for _ in range(300):
        pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
        a, b = np.unique(pool[:50]), np.unique(pool[10:])
        got = super_minhash(np.concatenate([a, b]), np.array([len(a), len(b)]))
        errors.append((got[0] == got[1]).mean() - 40 / 60)
        plain.append(rng.binomial(REGISTERS, 40 / 60) / REGISTERS - 40 / 60)
    assert abs(np.mean(errors)) < 0.01
    assert np.var(errors) < 0.75 * np.var(plain)  # lower than that of independent minima


def test_shingles_are_those_of_the_contract(monkeypatch):
    monkeypatch.setattr(module, "BYTES_AT_ONCE", 5)
    hashes = ByteWordHashes()
    for text in ("", " \n", "A b", "a\x0bB\x0cc\x1cd e f", "É é Z z a b c d", "x y z u v w x y z u v w"):
        values, _ = shingles(text, hashes)
        assert len(values) == len(shingle_set(text))
    assert shingles("A  b\nc", hashes)[1] == shingles("a b c ", hashes)[1] != shingles("a bc", hashes)[1]
    assert shingles("É", hashes)[1] != shingles("é", hashes)[1]


def corpus(seed):
    """Bases with chains of edits, so that links lead on, copies, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(rng.randint(1, 12)):
            text = list(text)
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((rng.randrange(500) if base % 3 else len(rows) + 600, " ".join(text).title()))
    rows += [(700, "a b"), (701, "A B"), (702, "a b c"), (703, ""), (704, None), (705, " \n"), (None, "a B"), (None, "lone text")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,partitions,block", [(1, 1, None), (2, 3, 150), (3, 7, 60)])
def test_against_all_pairs(monkeypatch, frame, seed, partitions, block):
    if block:
        monkeypatch.setattr(module, "CELL_TEXTS", 3)
        monkeypatch.setattr(module, "cells_of", lambda m, s, f=module.cells_of: f(m, s, block))
    rows = corpus(seed)
    want = plainly(rows)
    assert len({line[2] for line in want}) < len({line[0] for line in want}) - 20
    assert result(near_duplicates(frame(rows).repartition(partitions))) == want


def test_ties_and_repeated_ids(frame):
    base = [f"t{k}" for k in range(104)]
    tie = [*base[:96], *(f"n{k}" for k in range(8))]  # 92 shared shingles of 108: over 0.85
    apart = [*base[:95], *(f"m{k}" for k in range(9))]  # 91 of 109: below
    rows = [(1, " ".join(base)), (1, "other words that stand alone here"), (2, " ".join(tie)), (3, " ".join(apart)), (4, "other WORDS that stand alone here")]
    assert result(near_duplicates(frame(rows))) == plainly(rows)
    exact = [f"e{k}" for k in range(24)]  # 20 shingles; three of them lost: 17 of 20 is the threshold itself
    rows = [(5, " ".join(exact)), (6, " ".join(exact[:21])), (7, " ".join(exact[:20]))]
    assert result(near_duplicates(frame(rows))) == plainly(rows) and plainly(rows)[1][2] == 5


def test_odd_rows(frame, odd_rows):
    rows = [*odd_rows, (5, "word " * 30_000 + "end"), (None, "NO id"), (9, "x" * 500_000), (-(2**63), "no ID")]
    assert result(near_duplicates(frame(rows))) == plainly(rows)
    assert near_duplicates(frame([])).count() == 0
    extra = frame([(1, "a b", 7, "s", b"")], "doc_id long, text string, component int, mark string, copy binary")
    assert result(near_duplicates(extra)) == [(1, 1, 1, True)]
