import hashlib
import random

import numpy as np

from priorline.llm.fingerprints import (
    boundaries, chunk_set, containment, edit_fingerprints, fingerprints, gear_hash, gear_values,
)


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(n))


def test_gear_hash_is_the_rolling_one():
    points = np.frombuffer(words(1, 40).encode("utf-32-le"), dtype="<u4")
    rolled, state = [], 0
    for value in gear_values(points).tolist():
        state = ((state << 1) + value) % 2**32
        rolled.append(state)
    assert gear_hash(points).tolist() == rolled


def test_chunks_resist_shifts_and_cover_the_text():
    text = words(2, 2000)
    ends = boundaries(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))
    assert ends[-1] == len(text) and ends == sorted(set(ends))
    assert 15 < len(text) / len(ends) < 60
    assert containment(chunk_set(text), chunk_set("inserted " + text)) > 0.97
    assert containment(chunk_set(text), chunk_set(words(3, 2000))) < 0.05
    assert chunk_set("a" * 5000)


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (key, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        out.append((key, len(text), hashlib.sha256(changed.encode()).hexdigest(), containment(chunk_set(text), chunk_set(after))))
    return sorted(out, key=str)


def test_against_brute_force(spark, frame, odd_rows):
    for rows in ([(i * 7 % 1000, words(i, 30)) for i in range(1000)], odd_rows, [(5, "alone")]):
        got = edit_fingerprints(frame(rows).repartition(5)).collect()
        assert sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.near_next) for r in got], key=str) == brute(rows)
    assert edit_fingerprints(frame([])).count() == 0


def test_halves(spark, frame):
    got = edit_fingerprints(frame([(i, words(i, 300)) for i in range(50)])).collect()
    assert all(0.35 < r.near_edited < 0.65 and r.near_next < 0.1 for r in got)
    same = fingerprints(frame([(1, "same text"), (2, "same text")])).collect()
    assert same[0].fingerprint == same[1].fingerprint != ""
