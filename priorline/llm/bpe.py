"""Byte-level BPE as a streaming transducer with bounded lookahead, and an incremental decoder.

*Encoding.* A text is read as a stream of pieces (the pre-tokenizer's pattern and the added tokens).
A piece's bytes enter a buffer. Merges are applied by rank, and a token is emitted once it is
*stable*: once no byte that has not been read can change it. The merge list gives the lookahead that
suffices. What follows a token can change it only through a chain of merges from right to left, in
which each merge shares bytes with the next and has a lower rank (an earlier place in the list) than
the one to its left, since a merge is prevented or made possible only by earlier ones. The longest
such chain, in bytes, is found by one pass over the list. Tokens that end that many bytes before the
end of the buffer are emitted and leave it; the tokens of what remains are the same whether or not
the emitted ones precede it. So a piece of any length needs a buffer of fixed size.

*Decoding.* A state machine takes one token at a time, appends its bytes to at most three bytes that
wait for the rest of a character, and gives out whole characters; bytes that cannot be UTF-8 become
U+FFFD, one for each maximal part of a character.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from priorline.llm.rows import id_and_text, pairs_of

# Fixed value: the byte-level pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of up to so many bytes are remembered, up to so many of them.
REMEMBERED_BYTES, REMEMBERED_PIECES = 48, 300_000
#: Bytes read into the buffer beyond the lookahead, and ids hashed at a time.
BLOCK = 4096
IDS_AT_ONCE = 8192
#: Up to so many bytes a plain list of pairs is faster than a heap.
SHORT_PIECE = 64
#: A merge as one number that sorts by rank: rank << 24 | merged id.
MERGED, NO_MERGE = (1 << 24) - 1, 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file.

    Printable bytes stand for themselves, the others for letters from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, byte tokens, merges as pairs of ids, added tokens and the sufficient lookahead."""

    def __init__(self, token_bytes: dict[int, bytes], merges: list[tuple[int, int, int]], added: dict[str, int]):
        """merges: (left id, right id, merged id) by rank. added: content and id of added tokens."""
        self.token_bytes = token_bytes
        self.added = added
        self.byte_ids = {b[0]: i for i, b in token_bytes.items() if len(b) == 1}
        self.merges = {(left, right): (rank, merged) for rank, (left, right, merged) in enumerate(merges)}
        self.codes = {pair: rank << 24 | merged for pair, (rank, merged) in self.merges.items()}
        self.lookahead = sufficient_lookahead(merges, token_bytes)
        self.all_bytes = token_bytes | {i: content.encode() for content, i in added.items()}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_letters()
        ids = model["vocab"]
        added = {token["content"]: token["id"] for token in content["added_tokens"]}
        token_bytes = {
            i: bytes(letters[c] for c in token) for token, i in ids.items() if token not in added
        }
        pairs = (pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"])
        return cls(token_bytes, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], added)


def sufficient_lookahead(merges: list[tuple[int, int, int]], token_bytes: dict[int, bytes]) -> int:
    """Bytes after a token that decide it: the longest chain of merges with falling rank.

    ``reach[t]`` is the most that merges seen so far (of lower rank) take in to the right of a token
    t, themselves and the chains that they start. The right part of a merge ends as all tokens on its
    right edge do, so a merge chains to the merges whose left part is one of those.
    """
    reach: dict[int, int] = {}
    right_of: dict[int, int] = {}
    longest = 0
    for left, right, merged in merges:
        edge, further = right, 0
        while edge is not None:
            further = max(further, reach.get(edge, 0))
            edge = right_of.get(edge)
        taken = len(token_bytes[right]) + further
        reach[left] = max(reach.get(left, 0), taken)
        right_of.setdefault(merged, right)
        longest = max(longest, taken)
    return longest


def merged_ids(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """All merges applied to some bytes: the lowest rank first, the leftmost of equal ones."""
    ids = [vocabulary.byte_ids[b] for b in data]
    if len(ids) < 2:
        return ids
    merges = vocabulary.merges
    if len(ids) <= SHORT_PIECE:
        # Ranks of neighbouring pairs; a merge changes those at its two sides only.
        get, none = vocabulary.codes.get, NO_MERGE
        codes = [get(pair, none) for pair in zip(ids, ids[1:])]
        while codes and (best := min(codes)) != none:
            k = codes.index(best)
            ids[k : k + 2] = [best & MERGED]
            del codes[k]
            if k < len(codes):
                codes[k] = get((ids[k], ids[k + 1]), none)
            if k:
                codes[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    waiting = [(*found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := merges.get((ids[k], ids[k + 1])))]
    waiting = [(rank, k, merged, left, right) for rank, merged, k, left, right in waiting]
    heapq.heapify(waiting)
    while waiting:
        _, k, merged, left, right = heapq.heappop(waiting)
        nxt = after[k]
        if ids[k] != left or nxt < 0 or ids[nxt] != right:
            continue
        ids[k], ids[nxt] = merged, -1
        after[k] = after[nxt]
        if after[nxt] >= 0:
            before[after[nxt]] = k
        for a, b in ((before[k], k), (k, after[k])):
            if a >= 0 and b >= 0 and (found := merges.get((ids[a], ids[b]))):
                heapq.heappush(waiting, (found[0], a, found[1], ids[a], ids[b]))
    return [i for i in ids if i >= 0]


class Encoder:
    """The transducer: pieces in, stable token ids out."""

    def __init__(self, vocabulary: Vocabulary, block: int = BLOCK):
        self.vocabulary = vocabulary
        self.block = block
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(regex.escape(c) for c in sorted(vocabulary.added, key=len, reverse=True)) or r"(?!)")
        self.remembered: dict[str, tuple[int, ...]] = {}

    def long_piece(self, data: bytes) -> Iterator[int]:
        """Tokens of a piece, with a buffer of at most the lookahead, a block and one token."""
        lookahead, sizes = self.vocabulary.lookahead, self.vocabulary.token_bytes
        start, read = 0, 0
        while read < len(data):
            read = min(max(read, start + lookahead) + self.block, len(data))
            end = start
            for token in merged_ids(data[start:read], self.vocabulary):
                end += len(sizes[token])
                if read < len(data) and end + lookahead > read:
                    break
                yield token
                start = end

    def piece(self, piece: str) -> Iterable[int]:
        found = self.remembered.get(piece)
        if found is not None:
            return found
        data = piece.encode("utf-8")
        if len(data) > REMEMBERED_BYTES:
            return self.long_piece(data)
        if len(self.remembered) >= REMEMBERED_PIECES:
            self.remembered.clear()
        found = self.remembered[piece] = tuple(merged_ids(data, self.vocabulary))
        return found

    def spans(self, text: str) -> Iterator[tuple[str, int | None]]:
        """The text cut at added tokens: (ordinary text, None) or (content, id)."""
        at = 0
        if any(content in text for content in self.vocabulary.added):
            for m in self.special.finditer(text):
                yield text[at : m.start()], None
                yield m[0], self.vocabulary.added[m[0]]
                at = m.end()
        yield (text if at == 0 else text[at:]), None

    def encode(self, text: str) -> Iterator[list[int]]:
        """Token ids in blocks, as they become stable."""
        out: list[int] = []
        remembered, pieces = self.remembered, self.pieces
        for span, token in self.spans(text):
            if token is not None:
                out.append(token)
                continue
            for m in pieces.finditer(span):
                piece = m[0]
                out += remembered.get(piece) or self.piece(piece)
                if len(out) >= IDS_AT_ONCE:
                    yield out
                    out = []
        if out:
            yield out


class Decoder:
    """The byte-to-text state machine; its state is the start of a character not yet whole."""

    def __init__(self, vocabulary: Vocabulary):
        self.token_bytes = vocabulary.all_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that these tokens complete; unknown ids stand for nothing."""
        return self.state.decode(b"".join(map(self.token_bytes.get, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(Vocabulary.from_file(path))


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One line per row: doc_id and its token ids (array of int). Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            lines = [(key, [i for block in encoder.encode(text) for i in block]) for key, text in pairs_of(batch)]
            keys, ids = zip(*lines) if lines else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    return id_and_text(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """One line per row of (doc_id, ids): doc_id and text. Null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(path).vocabulary
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                decoder = Decoder(vocabulary)
                texts.append(decoder.feed(i for i in ids.as_py() or () if i in vocabulary.all_bytes) + decoder.finish())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"]
            )

    return tokens.selectExpr("CAST(doc_id AS long) AS doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode every text and decode its ids as they come: counts and digests, one line per row.

    Ids flow from the encoder to both digests in blocks; neither all ids nor the decoded text of a
    document are held. Null and empty texts have no token. Repeated rows give one line each.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lookahead int"
    arrow = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
            ("decoded_sha256", pa.string()), ("lookahead", pa.int32()),
        ]
    )

    def line(key: int | None, text: str, encoder: Encoder) -> tuple:
        ids_digest, text_digest = hashlib.sha256(), hashlib.sha256()
        decoder, count = Decoder(encoder.vocabulary), 0
        for ids in encoder.encode(text):
            ids_digest.update((("," if count else "") + ",".join(map(str, ids))).encode())
            text_digest.update(decoder.feed(ids).encode())
            count += len(ids)
        text_digest.update(decoder.finish().encode())
        return key, count, ids_digest.hexdigest(), text_digest.hexdigest(), encoder.vocabulary.lookahead

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            lines = [line(key, text, encoder) for key, text in pairs_of(batch)]
            columns = zip(*lines) if lines else ([] for _ in arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return id_and_text(docs, id_column, text_column).mapInArrow(run, schema)
