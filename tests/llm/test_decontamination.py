import random
import re

import pytest
from pyspark.sql import functions as F

from priorline.llm.decontamination import UNITS, leaks, raw_tokens, templates, windows, without_leaks

QUESTIONS = [
    (1, "Alice buys 12 apples and Bob buys 7 apples. How many more apples than Bob does Alice have after the market closes today?"),
    (2, "A train moves at 80 km per hour for 3 hours and then stops. How far did the train go in total?"),
    (3, "short item here"), (4, None), (None, "an item without id that has enough words"),
]


def test_tokens(frame):
    text = "On Monday Alice, Bob and Carl ran 3.5 km in 20 minutes. Then Zoe won m 7kg"
    row = frame([(1, text)]).select(raw_tokens(F.col("text"))).first()[0]
    plain = [t.strip("\ue000\ue001") if t[0] == "\ue000" else t for t in row]
    assert plain == ["on", "monday", "alice", "bob", "and", "carl", "ran", "3.5", "km", "in", "20", "minutes", "then", "zoe", "won", "m", "7", "kg"]
    assert [t[0] == "\ue000" for t in row] == [x in "monday alice bob carl 3.5 km 20 minutes zoe 7 kg".split() for x in plain]


def test_reparameterised_questions(frame):
    docs = [
        (10, f"Some words before. {QUESTIONS[0][1]} And after."),
        # Other names and numbers, used consistently.
        (11, "Look: Mary buys 5 apples and John buys 31 apples. How many more apples than John does Mary have after the market closes today? Yes."),
        # Mary becomes someone else in the second sentence.
        (12, "Look: Mary buys 5 apples and John buys 31 apples. How many more apples than Zed does Carla have after the market closes today? Yes."),
        (13, "see: a train moves at 95 miles per hour for 2 hours and then stops. how far did the train go in total?"),
        (14, "A train moves at many stations and nothing else of it is here."),
        (15, None), (16, ""), (None, QUESTIONS[0][1]), (10, f"Some words before. {QUESTIONS[0][1]} And after."),
    ]
    found = leaks(frame(docs), frame(QUESTIONS, "item_id long, text string")).collect()
    # A null-id text is a document, too.
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == [(0, 1), (10, 1), (11, 1), (13, 2)]
    kept = without_leaks(frame([(*d, 1) for d in docs], "doc_id long, text string, item_id int"), frame(QUESTIONS, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [12, 14, 15, 16]


def brute_tokens(text):
    spans = {m.span() for m in re.finditer(r"[0-9]+(?:[.,:/][0-9]+)*", text)}
    spans |= {m.span() for m in re.finditer(r"(?<=[a-z0-9,;] )[A-Z][a-zA-Z]*", text)}
    return [
        "#" if m.span() in spans and m[0][0].isdigit() else "N" if m.span() in spans else m[0].lower()
        for m in re.finditer(r"[0-9]+(?:[.,:/][0-9]+)*|[A-Za-z]+", text)
    ]


def test_against_brute_force(frame):
    rng = random.Random(7)
    words = ["".join(rng.choices("bcdfaeiou", k=rng.randint(3, 8))) for _ in range(200)]
    assert not set(words) & set(UNITS)

    def sentence(n):
        return " ".join(str(rng.randint(1, 99)) if rng.random() < 0.1 else rng.choice(words) for _ in range(n)).capitalize() + "."

    items = [(k, sentence(rng.randint(4, 30))) for k in range(20)]
    docs = []
    for k in range(120):
        parts = [sentence(rng.randint(3, 40)) for _ in range(3)]
        if rng.random() < 0.5:
            text = rng.choice(items)[1].split(" ")
            cut = rng.randint(0, len(text) // 2)
            parts.insert(1, " ".join(text[cut:]))
        docs.append((k, " ".join(parts)))
    want = set()
    for doc, text in docs:
        tokens = brute_tokens(text)
        seen = {tuple(tokens[i : i + 5]) for i in range(len(tokens) - 4)}
        for item, question in items:
            own = brute_tokens(question)
            ours = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
            if ours and sum(w in seen for w in ours) >= 0.5 * len(ours):
                want.add((doc, item))
    found = {(r.doc_id, r.item_id) for r in leaks(frame(docs), frame(items, "item_id long, text string")).collect()}
    # Slots may still be inconsistent by chance; nothing else may differ.
    assert found <= want and len(want) > 30 and len(found) > 0.8 * len(want)


def test_names_that_begin_sentences_and_number_words(frame):
    items = [
        (1, "Tom has 3 apples. Sara has 5 pears. How many do they have?"), (2, "A box weighs twelve kg and holds 25 books."),
        (3, "Yes indeed"), (4, "Ωmega"), (5, "?!"),
    ]
    docs = [
        (1, "Anna has 7 apples. Mary has 9 pears. How many do they have?"),
        (2, "so tom has three apples. Sara has 5 pears. How many do they have?"),
        # Sara becomes Tom as well, which is allowed; Tom becomes two people, which is not.
        (3, "Tom has 3 apples. Tom has 5 pears. How many do they have?"), (4, items[0][1].replace("How", "Then Tom asks. How")),
        (5, "A box weighs 9 kg and holds thirty books."), (6, "A box weighs 12 kg and holds twenty-five books."),
        (7, "Well. Yes indeed, that is so."), (8, "yes, no, indeed"), (9, "Alpha and Ωmega"), (None, items[0][1]), (10, "?!"),
    ]
    found = {(r.doc_id, r.item_id): r for r in leaks(frame(docs), frame(items, "item_id long, text string")).collect()}
    assert {k for k in found if k[1] < 4} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3), (None, 1)}
    assert (9, 4) in found and not [k for k in found if k[1] == 5 or k[0] == 10]
    assert found[1, 1].n_matched == found[1, 1].n_windows == 9 and found[1, 1].n_slots == 4


def test_texts_under_one_id_are_told_apart(frame):
    whole = QUESTIONS[0][1]
    docs = [(7, f"so {whole}"), (7, "a quite different text"), (None, whole), (None, "another text"), (8, None), (7, f"so {whole}")]
    bench = frame(QUESTIONS, "item_id long, text string")
    kept = without_leaks(frame(docs), bench).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([docs[1], docs[3], docs[4]], key=repr)


def test_long_text(frame):
    text = "word " * 200_000 + QUESTIONS[1][1] + " Word." * 100_000
    assert [(r.doc_id, r.item_id) for r in leaks(frame([(1, text)]), frame(QUESTIONS, "item_id long, text string")).collect()] == [(1, 2)]


@pytest.mark.parametrize("rows", [[], [(1, "x y")]])
def test_empty_tables(frame, rows):
    assert leaks(frame(rows), frame([], "item_id long, text string")).count() == 0


def test_verbatim_copies_are_found(frame):
    items = [
        (1, "A shop sells 3 red apples for 5 dollars and 4 red apples for 6 dollars. How much do all of them cost?"),
        (2, "Tom earns 12 dollars an hour for babysitting. Yesterday he worked for 3 hours. How much did Tom earn?"),
        (3, "Carl counts seven small boats"),
    ]
    variant = items[0][1].replace("3", "8").replace("5", "8")
    docs = [
        (1, items[0][1]), (2, f"{variant} {items[0][1]} {variant}"), (3, f"Last year Tom earns 9 dollars an hour for babysitting. {items[1][1]}"),
        # Two values of the item may become one; the name begins inside a sentence here.
        (4, variant), (5, f"today {items[2][1]} again"),
        # An added word, and a variant before.
        (6, f"{variant} And {items[0][1].replace('and', 'and also')}"),
        # Different texts under one id: neither holds enough.
        (7, items[1][1][:37]), (7, items[1][1][50:80]), (8, "A shop sells 3 red apples for 5 dollars and nothing else at all."),
        # Another number, used consistently.
        (9, items[1][1].replace("12", "15") + " x"), (9, None),
    ]
    found = {(r.doc_id, r.item_id): r for r in leaks(frame(docs), frame(items, "item_id long, text string")).collect()}
    assert sorted(found) == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 3), (6, 1), (9, 2)]
    assert found[2, 1].n_matched == found[2, 1].n_windows == found[1, 1].n_matched == 19
    assert found[3, 2].n_matched == found[3, 2].n_windows


def test_windows_become_rows_in_compiled_code(frame):
    texts = [(1, 1, "One two three, Alice and Bob ran 3.5 km. Then Zoe sat"), (2, 2, "Too short"), (3, 3, "")]
    found = windows(frame(texts, "doc_id long, text_key long, text string"), ("doc_id", "text_key"), "at", [3, 5])
    plan = found._jdf.queryExecution().executedPlan().toString()
    generates = [line for line in plan.splitlines() if "Generate " in line]
    assert generates and all("*(" in line for line in generates)
    read = frame(texts, "doc_id long, text_key long, text string").select("doc_id", raw_tokens(F.col("text"), both=True).alias("t"))
    expected = []
    for row in read.select("doc_id", templates(F.col("t")).alias("words"), templates(F.col("t"), True).alias("names")).collect():
        for size in (3, 5):
            for at in range(len(row.words) - size + 1):
                expected += [(row.doc_id, at, list(x)) for x in {tuple(row.words[at : at + size]), tuple(row.names[at : at + size])}]
    hashed = frame(expected, "doc_id long, at int, window array<long>").withColumn("window", F.xxhash64("window"))
    assert sorted(map(tuple, found.select("doc_id", "at", "window").collect())) == sorted(map(tuple, hashed.collect()))
