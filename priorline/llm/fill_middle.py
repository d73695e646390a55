"""Fill-in-middle transformation by repeated-capture matching.

A text is a row of units: white space with the word behind it, or the white space at the end. One
``fullmatch`` of ``(unit)*`` with the regex library keeps every repetition of the group, so the ends of
the captures give the number of units and both cut offsets at once, without a loop over units.

Numbers drawn from the digest of seed and id choose the form and the cuts; prefix, middle and suffix are
put behind markers in the order of the form. A text that is empty or holds a marker stays plain, so each
other form can be split at its markers again, and the text rebuilt from output and form alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorline.llm.rows import id_and_text, pairs_of

# The unit, the markers, the forms and their shares.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, TRANSFORMED_PERCENT, SUFFIX_FIRST_PERCENT = 42, 50, 80

#: The possessive loop keeps no states to go back to: a unit never gives up what it has taken.
UNITS = regex.compile(f"({UNIT})*+")
#: Characters of output that one Arrow batch gathers, besides those of its last text.
CHARS_AT_ONCE = 4_000_000


def draws(seed: int, key: int | None) -> list[int]:
    """Four numbers of 32 bits from the digest of seed and id; a null id has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def transform(
    text: str, key: int | None, seed: int = SEED, transformed: int = TRANSFORMED_PERCENT,
    suffix_first: int = SUFFIX_FIRST_PERCENT,
) -> tuple[int, str, int | None, int | None, str]:
    """(number of units, form, characters of the prefix and of the middle, output)."""
    ends = UNITS.fullmatch(text).ends(1)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= transformed or any(marker in text for marker in (PREFIX, SUFFIX, MIDDLE)):
        return len(ends), "plain", None, None, text
    first, last = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    cut, end = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:cut], text[cut:end], text[end:]
    if h4 % 100 < suffix_first:
        return len(ends), "spm", cut, end - cut, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", cut, end - cut, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, transformed: int = TRANSFORMED_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """One line per row of docs: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output.

    transformed: percentage of texts that are not plain; suffix_first: that of spm among them. Null and
    empty texts give an empty plain output without units. Rows are independent: rows with one id are cut
    by the same draws, each in its own text, and a null id counts as one without digits.
    """
    arrow = pa.schema(
        [
            ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
            ("middle_chars", pa.int64()), ("output", pa.string()),
        ]
    )

    def table_of(lines: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, field.type) for column, field in zip(zip(*lines), arrow)], schema=arrow
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, chars = [], 0
            for key, text in pairs_of(batch):
                lines.append((key, *transform(text, key, seed, transformed, suffix_first)))
                chars += len(text)
                if chars >= CHARS_AT_ONCE:
                    yield table_of(lines)
                    lines, chars = [], 0
            if lines:
                yield table_of(lines)

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of the given form was made from."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)

    def joined(*order: int) -> Column:
        return F.concat(*[F.get(parts, k) for k in order])

    # In front of the first marker stands nothing; psm is prefix, suffix, middle and spm suffix, prefix, middle.
    return F.when(F.col(form) == "psm", joined(1, 3, 2)).when(F.col(form) == "spm", joined(2, 3, 1)).otherwise(F.col(output))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text rebuilt from it in place of the output."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )


FILL_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS parts
    FROM documents
), drawn AS (
    SELECT doc_id, text, parts, len(parts) AS n, ('0x' || substr(digest, 1, 8))::BIGINT % (len(parts) + 1) AS a,
        ('0x' || substr(digest, 9, 8))::BIGINT % (len(parts) + 1) AS b,
        text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 50 AS plain,
        ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 80 AS suffix_first
    FROM units
), cut AS (
    SELECT *, array_to_string(parts[1:least(a, b)], '') AS prefix,
        array_to_string(parts[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(parts[greatest(a, b) + 1:], '') AS suffix
    FROM drawn
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
    sha256(CASE WHEN plain THEN text WHEN suffix_first THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM cut
"""
