import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from priorline.llm.bpe import Decoder, Encoder, Vocabulary, decode, encode, encoder_of, merged_ids, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(encoder, text):
    return [i for block in encoder.encode(text) for i in block]


TEXTS = [
    "", " ", "  a\n\n b ", "It's we'll I'd", "naïve café ÄÖÜß ñ 你好世界 👩‍👩‍👧 ", "x<|endoftext|>y<|endoftext|>",
    "<|endoftext|>", "a" * 9000, "é" * 5000, "=" * 7000, " " * 5000 + "x", "​﻿ z", "１２３ 4567 ½",
]


def test_equals_the_library(library):
    encoder = encoder_of(PATH)
    rng = random.Random(5)
    noise = ["".join(rng.choices("abcdeinorst éß", k=n)) for n in (10, 100, 3000)]
    solid = ["".join(rng.choices(letters, k=20_000)) for letters in ("abcdefghinorst", "eéèà", "-=_*#", "0123456789")]
    for text in [*TEXTS, *noise, *solid]:
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder, text) == want, text[:40]
        decoder = Decoder(encoder.vocabulary)
        got = "".join(decoder.feed([i]) for i in want) + decoder.finish()
        assert got == library.decode(want, skip_special_tokens=False)


def test_decoder_replaces_what_is_no_text(library):
    vocabulary = encoder_of(PATH).vocabulary
    rng = random.Random(6)
    for _ in range(300):
        ids = rng.choices(range(50257), k=rng.randint(1, 12))
        decoder = Decoder(vocabulary)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def toy(seed):
    """A random merge list over three letters, each merge made of tokens that exist."""
    rng = random.Random(seed)
    token_bytes = {k: bytes([97 + k]) for k in range(3)}
    merges, known = [], {}
    for _ in range(rng.randint(1, 14)):
        left, right = rng.choice(list(token_bytes)), rng.choice(list(token_bytes))
        data = token_bytes[left] + token_bytes[right]
        if data in known or len(data) > 8:
            continue
        known[data] = new = len(token_bytes)
        token_bytes[new] = data
        merges.append((left, right, new))
    return Vocabulary(token_bytes, merges, {})


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10_000), st.text("abc", min_size=1, max_size=120), st.integers(1, 9))
def test_stable_tokens_never_change(seed, text, block):
    vocabulary = toy(seed)
    streamed = list(Encoder(vocabulary, block).long_piece(text.encode()))
    assert streamed == merged_ids(text.encode(), vocabulary)


def test_table(spark, frame, odd_rows, library):
    rows = [*odd_rows, (9, TEXTS[4]), (10, TEXTS[5])]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in round_trip(frame(rows), PATH).collect()}
    want = set()
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.add((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == want
    back = decode(encode(frame(rows), PATH), PATH).collect()
    assert sorted(map(str, back)) == sorted(str(type(back[0])(doc_id=k, text=t or "")) for k, t in rows)
    assert round_trip(frame([]), PATH).count() == 0
