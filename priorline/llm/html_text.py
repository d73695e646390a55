"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text without a block boundary inside, each with its ancestors,
their class and id words, and how much of it is link text. A binary CRF (one weight for each feature,
four transitions, two starts) says which blocks are main text: P(labels | page) is proportional to
exp(sum of features and transitions). It is trained by gradient ascent on the exact likelihood
(forward-backward), on labelled pages of many layouts, and decoded by Viterbi. Pages are independent
rows, so nothing is shuffled; the model (a few hundred numbers) travels with the task.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorline.llm.labelled_pages import labelled_pages

# Element names, in natural order.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("iframe noembed noframes script style svg template textarea".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK_TAGS - {"body", "button", "caption", "head", "html", "legend", "option", "optgroup", "select", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}

MARKUP = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""",
    re.DOTALL,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An open block element; what its ancestors have in common is shared with them, so depth costs nothing."""

    __slots__ = ("tag", "words", "parent", "names", "score")

    def __init__(self, tag: str, words: list[str], parent: Element | None, known: Container[str] | None):
        self.tag, self.words, self.parent = tag, words, parent
        above = parent.names if parent else frozenset()
        # Names that the model has no weight for are left out, so the set has a bound of its own.
        own = {f"in {w}" for w in (tag, *(f".{w}" for w in words)) if known is None or f"in {w}" in known}
        self.names: frozenset[str] = above if own <= above else above | own
        self.score: float | None = None


class Block(NamedTuple):
    text: str
    element: Element | None
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        """Tags and name words of the ancestors, the outermost first."""
        parts, element = [], self.element
        while element:
            parts.append((element.tag, *(f".{w}" for w in element.words)))
            element = element.parent
        return tuple(part for own in reversed(parts) for part in own)


def name_words(attributes: str) -> list[str]:
    """The lower-cased words of class, id and role values."""
    return [w.lower() for m in NAMES.finditer(attributes) for w in NAME_WORD.findall(m[1] or m[2] or m[3] or "")]


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The blocks with text, in page order; character references decoded, white space made single.

    known: the features that matter, so that no others are kept; all of them by default.
    """
    blocks: list[Block] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = at = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, stack[-1] if stack else None, linked))
            parts.clear()
        linked = 0

    def pop_to(place: int) -> None:
        opened.subtract(element.tag for element in stack[place:])
        del stack[place:]

    def innermost(tags: set[str]) -> int:
        """Place of the innermost open element of these, within the innermost list or table."""
        for place in range(len(stack) - 1 if any(opened[tag] for tag in tags) else -1, -1, -1):
            if stack[place].tag in tags:
                return place
            if stack[place].tag in ("ul", "ol", "dl", "table", "select"):
                return -1
        return -1

    while at < len(page):
        found = MARKUP.search(page, at)
        piece = page[at : found.start()] if found else page[at:]
        if piece:
            piece = html.unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece)
        if not found:
            break
        at = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(found[1] or found[4])
        if tag in RAW_TAGS:
            if not closing and not (found[3] or found[6] or "").endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE)
                end = close.search(page, at)
                at = end.end() if end else len(page)
                # An end tag in a string of the script: its rest stands before another end tag.
                if tag == "script" and (after := MARKUP.search(page, at)) and close.fullmatch(after[0]):
                    at = after.end()
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            end_block()
            if closing:
                if opened[tag]:
                    pop_to(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
                continue
            if tag in CLOSES_P and stack and stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            elif tag in ENDS and (place := innermost(ENDS[tag])) >= 0:
                pop_to(place)
            if tag not in VOID_TAGS:
                stack.append(Element(tag, name_words(found[3] or found[6] or ""), stack[-1] if stack else None, known))
                opened[tag] += 1
    end_block()
    return blocks


def path_features(element: Element | None) -> tuple[str, ...]:
    """The ancestors' tags and name words, the block's own tag."""
    return (*(sorted(element.names) if element else ()), f"own {element.tag if element else ''}")


def text_features(block: Block) -> tuple[str, ...]:
    text = block.text
    size = len(text)
    words = text.count(" ") + 1
    share = min(3, int(4 * block.linked / size)) if block.linked else 0
    stops = sum(map(text.count, ".,;:!?"))
    return (
        f"words {min(7, words.bit_length())}", f"links {share}", f"stops {min(4, stops)}",
        f"ends {text[-1] in '.!?…'}", f"sign {text[0] in '©®'}", "always",
    )


class Model(NamedTuple):
    weights: dict[str, float]
    moves: list[list[float]]
    starts: list[float]

    def score(self, block: Block) -> float:
        get, element = self.weights.get, block.element
        if element is None:
            above = get("own ", 0.0)
        else:
            if element.score is None:
                element.score = sum(get(f, 0.0) for f in path_features(element))
            above = element.score
        return above + sum(get(f, 0.0) for f in text_features(block))


def train(pages: list[list[tuple[Block, int]]], steps: int = 300, rate: float = 0.2, penalty: float = 0.02) -> Model:
    """Gradient ascent (Adam) on the penalised likelihood of labelled pages, all pages at once."""
    pages = [page for page in pages if page]
    names = sorted({f for page in pages for b, _ in page for f in (*path_features(b.element), *text_features(b))})
    index = {name: k for k, name in enumerate(names)}
    longest = max(map(len, pages))
    found = np.zeros((len(pages), longest, len(names)), dtype=np.float32)
    labels = np.zeros((len(pages), longest), dtype=int)
    real = np.zeros((len(pages), longest), dtype=bool)
    for p, page in enumerate(pages):
        for k, (block, label) in enumerate(page):
            for f in (*path_features(block.element), *text_features(block)):
                found[p, k, index[f]] += 1
            labels[p, k], real[p, k] = label, True
    flat = found.reshape(-1, len(names))
    rows = np.arange(len(pages))
    lengths = real.sum(axis=1)
    values = np.zeros(len(names) + 6)
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        weights, moves, starts = values[:-6], values[-6:-2].reshape(2, 2), values[-2:]
        emit = np.zeros((len(pages), longest, 2))
        emit[:, :, 1] = (flat @ weights).reshape(len(pages), longest)
        ahead = np.zeros_like(emit)
        ahead[:, 0] = starts + emit[:, 0]
        for k in range(1, longest):
            ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + moves, axis=1) + emit[:, k]
        back = np.zeros_like(emit)
        for k in range(longest - 2, -1, -1):
            further = np.logaddexp.reduce(moves + (emit[:, k + 1] + back[:, k + 1])[:, None, :], axis=2)
            back[:, k] = np.where(real[:, k + 1, None], further, 0.0)
        total = np.logaddexp.reduce(ahead[rows, lengths - 1], axis=1)
        chance = np.where(real[:, :, None], np.exp(ahead + back - total[:, None, None]), 0.0)
        slope = np.zeros_like(values)
        slope[:-6] = ((labels - chance[:, :, 1]) * real).reshape(-1) @ flat
        for k in range(1, longest):
            on = real[:, k]
            pair = np.exp(
                ahead[:, k - 1, :, None] + moves + (emit[:, k] + back[:, k])[:, None, :] - total[:, None, None]
            )[on].sum(axis=0)
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[on, k - 1], labels[on, k]), 1)
            slope[-6:-2] += (seen - pair).reshape(-1)
        slope[-2:] = np.bincount(labels[:, 0], minlength=2) - chance[:, 0].sum(axis=0)
        slope -= penalty * values
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        values = values + rate * (1 - step / (steps + 1)) * (mean / (1 - 0.9**step)) / (
            np.sqrt(square / (1 - 0.999**step)) + 1e-8
        )
    return Model(dict(zip(names, values[:-6].tolist())), values[-6:-2].reshape(2, 2).tolist(), values[-2:].tolist())


def viterbi(scores: list[float], model: Model) -> list[int]:
    """The most probable labels of blocks with these scores for main text; ties go to other text."""
    (stay, enter), (leave, remain) = model.moves
    other, main = model.starts[0], model.starts[1] + scores[0]
    steps = []
    for score in scores[1:]:
        steps.append((int(main + leave > other + stay), int(main + remain > other + enter)))
        other, main = max(other + stay, main + leave), max(other + enter, main + remain) + score
    labels = [int(main > other)]
    for step in reversed(steps):
        labels.append(step[labels[-1]])
    return labels[::-1]


def main_text(page: str, model: Model) -> str:
    blocks = leaf_blocks(page, model.weights)
    if not blocks:
        return ""
    labels = viterbi([model.score(block) for block in blocks], model)
    return "\n".join(block.text for block, label in zip(blocks, labels) if label)


def with_labels(page: str, content: set[str]) -> list[tuple[Block, int]]:
    """A page's blocks, labelled by whether their text is among the content."""
    return [(block, int(block.text in content)) for block in leaf_blocks(page)]


def clearly_labelled(pages: list[tuple[str, set[str]]]) -> list[list[tuple[Block, int]]]:
    """The labelled blocks of those pages on which no content stands outside the article, too."""
    found = [(with_labels(page, content), content) for page, content in pages]
    return [blocks for blocks, content in found if sum(label for _, label in blocks) == len(content)]


@lru_cache(maxsize=1)
def trained_model() -> Model:
    return train(clearly_labelled(labelled_pages()))


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """One line per row: page_id, url, text and n_chars (code points).

    A null or empty page, or one without main text, has an empty text. Repeated rows give one line each.
    """
    model = model or trained_model()
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", model) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                schema=schema,
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
