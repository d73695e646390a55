"""Secret scan with multipart credential linking.

A text yields *parts*: access identifiers, secrets and endpoints, each a span with a strength.
Strong parts are reported by themselves. Weak parts (an account name, a random-looking word, a
service address) are reported only when a complementary part lies within the same scope: the parts
are sorted by start and interval-joined, each with the parts whose start is at most ``reach`` code
points away. An identifier complements a secret and the reverse; an endpoint needs a secret, and a
secret is complemented by an endpoint. Two weak parts complement each other.

All parts of one text are in one row, so no rows are shuffled. Null and empty texts have no parts.
Rows are independent: equal ids or repeated rows give one line each.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from priorline.llm.rows import id_and_text, pairs_of

REACH = 200

# The base kinds in their order, and their patterns.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 16 or more: the same matches as runs of any length of which short ones are dropped.
HEX = re.compile(r"[0-9a-f]{16,}")

WEAK_KINDS = ("account", "opaque", "endpoint")
ACCOUNT = re.compile(
    r"""\b(?:user(?:name)?|login|account|client|tenant|access)(?:[_-]?(?:id|key|name))?["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    re.ASCII | re.IGNORECASE,
)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+")
KIND_ORDER = {kind: k for k, kind in enumerate((*BASE_KINDS, *WEAK_KINDS))}
ROLES = {
    "assign": "secret", "hex": "secret", "opaque": "secret",
    "access": "identifier", "account": "identifier", "endpoint": "endpoint",
}
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}


class Part(NamedTuple):
    start: int
    end: int
    kind: str


def base_parts(text: str) -> list[Part]:
    """The strong parts, by start and then kind."""
    found: list[Part] = []
    if any(word in (lower := text.lower()) for word in ("passw", "secret", "token", "api")) or not lower.isascii():
        found += (Part(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12)
    if "AKIA" in text:
        found += (Part(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18)
    found += (Part(*m.span(), "hex") for m in HEX.finditer(text))
    return sorted(found, key=lambda part: (part.start, KIND_ORDER[part.kind]))


def looks_random(word: str) -> bool:
    """Digits, both letter cases and at least 3.5 bits per character."""
    if not (re.search("[0-9]", word) and re.search("[a-z]", word) and re.search("[A-Z]", word)):
        return False
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values()) >= 3.5


def weak_parts(text: str, strong: list[Part]) -> list[Part]:
    """Candidates that do not overlap a strong part."""
    found = [Part(*m.span(), "opaque") for m in OPAQUE.finditer(text) if looks_random(m[0])]
    if "://" in text:
        found += (Part(*m.span(), "endpoint") for m in ENDPOINT.finditer(text))
    if "=" in text or ":" in text:
        found += (Part(*m.span(), "account") for m in ACCOUNT.finditer(text))
    # Strong spans of different kinds may overlap each other, so their ends are not sorted.
    starts = [part.start for part in strong]
    widest = max((part.end - part.start for part in strong), default=0)

    def free(part: Part) -> bool:
        near = strong[bisect_left(starts, part.start - widest) : bisect_left(starts, part.end)]
        return not any(part.start < other.end for other in near)

    return [part for part in found if free(part)]


def linked(strong: list[Part], weak: list[Part], reach: int) -> list[Part]:
    """The weak parts with a complementary part within reach: an interval join on sorted starts."""
    starts: dict[str, list[int]] = {role: [] for role in COMPLEMENTS}
    for part in sorted([*strong, *weak]):
        starts[ROLES[part.kind]].append(part.start)

    def near(part: Part, role: str) -> bool:
        there = starts[role]
        return bisect_left(there, part.start - reach) < bisect_right(there, part.end + reach)

    return [part for part in weak if any(near(part, role) for role in COMPLEMENTS[ROLES[part.kind]])]


def render(parts: list[Part]) -> str:
    return ",".join(f"{part.kind}:{part.start}:{part.end}" for part in parts)


def scan_text(text: str, reach: int = REACH) -> tuple[list[Part], list[Part]]:
    """(base parts, all reported parts), each by start and then kind."""
    strong = base_parts(text)
    more = linked(strong, weak_parts(text, strong), reach)
    return strong, sorted([*strong, *more], key=lambda part: (part.start, KIND_ORDER[part.kind]))


def scan_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", reach: int = REACH
) -> DataFrame:
    """One line per row: doc_id, counts of base kinds, digest of the base spans, all spans.

    Spans are ``kind:start:end`` in code points, joined by commas.
    """
    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    )
    arrow = pa.schema(
        [("doc_id", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in BASE_KINDS)]
        + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for key, text in pairs_of(batch):
                base, parts = scan_text(text, reach)
                kinds = Counter(part.kind for part in base)
                lines.append(
                    (
                        key, *(kinds[kind] for kind in BASE_KINDS),
                        hashlib.sha256(render(base).encode()).hexdigest(), render(parts), len(parts) - len(base),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, field.type) for column, field in zip(zip(*lines), arrow)] if lines
                else [pa.array([], field.type) for field in arrow],
                schema=arrow,
            )

    return id_and_text(docs, id_column, text_column).mapInArrow(scan, schema)
