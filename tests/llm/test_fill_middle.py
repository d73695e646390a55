import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from priorline.llm.fill_middle import MIDDLE, PREFIX, SUFFIX, fill_in_middle, fill_in_middle_digests, restored, transform

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(key, text):
    """The contract step by step, unit after unit."""
    units, at = [], 0
    while at < len(text):
        match = UNIT.match(text, at)
        units.append(match[0])
        at = match.end()
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10_000), st.text(alphabet="aé\U0001f600 \n\t\x0b\x1c <PSM>", max_size=40))
def test_one_match_gives_what_a_loop_gives(key, text):
    assert transform(text, key) == plainly(key, text)


TEXTS = [
    (k, text)
    for k, text in enumerate(
        ["", " ", "a", " a", "a b  c\n", "x<P>y", "a<", "<S a<M b", "é \U0001f600 z\x0b", "one two three four five six "] * 6
    )
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rows_and_round_trip(frame):
    lines = {line.doc_id: line for line in fill_in_middle_digests(frame(TEXTS)).collect()}
    assert {line.form for line in lines.values()} == {"plain", "psm", "spm"}
    for key, text in TEXTS:
        n, form, prefix, middle, output = plainly(key, text)
        line = lines[key]
        assert (line.n, line.form, line.prefix_chars, line.middle_chars) == (n, form, prefix, middle)
        assert line.output_sha256 == digest(output) and line.restored_sha256 == digest(text)


def test_outputs_can_be_taken_apart(frame):
    made = fill_in_middle(frame(TEXTS), seed=7, transformed=100, suffix_first=50)
    for line in made.withColumn("again", restored()).collect():
        assert line.again == dict(TEXTS)[line.doc_id]
        if line.form != "plain":
            assert [line.output.count(m) for m in (PREFIX, SUFFIX, MIDDLE)] == [1, 1, 1]


def test_odd_rows(frame, odd_rows):
    rows = [*odd_rows, (5, "w" * 3_000_000), (6, " " * 1_000_000), (7, "<P>")]
    lines = fill_in_middle_digests(frame(rows)).collect()
    assert len(lines) == len(rows)
    for (key, text), line in zip(rows, lines, strict=True):
        assert line.doc_id == key and line.restored_sha256 == digest(text or "")
    assert lines[0].form == lines[1].form == "plain" and lines[0].n == 0
    assert lines[2] == lines[3]
    assert fill_in_middle_digests(frame([])).count() == 0
    extra = frame([(1, "a b", 7, "s")], "doc_id long, text string, n int, output string")
    assert fill_in_middle_digests(extra).collect()[0].n == 2
