import hashlib
import random
import re

from priorline.llm.personal_data import find_personal_data, sanitised

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    """The contract read literally."""
    found = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(found))


TEXTS = [
    "mail a.b@c.de or x@y.z.w, not a@b nor @c.d; a@b.c_d@e.f", "é 10.0.0.1 ü 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4041894974608795 5 5", "+1 (386) 555-3733 +12 +1234567 +44 20 7946 0958.",
    "id 1.2.3.4@x.org +1 555 0101010@a.b.c", "😀 a@b.co 😀😀 10.1.2.3", None, "", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "a" * 40_000 + " " + "9" * 40_000 + " " + "x@" * 2000 + "1." * 5000, "a@b.c" * 300,
]


def test_base_spans(frame):
    rng = random.Random(2)
    noise = ["".join(rng.choices("a1.@+- ()é5", k=rng.randint(1, 80))) for _ in range(400)]
    rows = list(enumerate(TEXTS + noise))
    for row in find_personal_data(frame(rows)).collect():
        want = plain(rows[row.doc_id][1])
        base = ",".join(s for s in row.spans.split(",") if s.split(":")[0] in PATTERNS)
        assert base == want, rows[row.doc_id]
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert sum(row[f"n_{kind}"] for kind in PATTERNS) == len(want.split(",")) * (want != "")


def test_revealing_terms(frame):
    rng = random.Random(3)
    words = ["".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(60)]
    rows = []
    for k in range(400):
        text = rng.choices(words, k=20)
        if k % 40 == 0:
            text[10:10] = ["Zorblatt", f"no {k}", "boss@corp.example.com", "himself"]
        if k % 40 == 1:
            text.insert(3, "himself")
        rows.append((k, " ".join(text)))
    found = {r.doc_id: r for r in find_personal_data(frame(rows)).collect()}
    text = rows[40][1]
    at = text.index("Zorblatt")
    kinds = {s.split(":")[0]: s for s in found[40].spans.split(",")}
    assert kinds["removed"] == f"removed:{at}:{at + 8}" and "generalised" in kinds and found[40].n_terms == 2
    assert all(r.spans == "" for k, r in found.items() if k % 40)
    clean = {r.doc_id: r.text for r in sanitised(frame(rows)).collect()}
    assert clean[40] == text.replace("Zorblatt", "").replace("boss@corp.example.com", "[EMAIL]").replace("himself", "[TERM]")
    assert clean[5] == rows[5][1]


def test_revealing_terms_far_from_the_mention(frame):
    rng = random.Random(4)
    words = ["".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=20))) for k in range(400)]
    for k in range(0, 400, 40):
        beside = "Zorblatt Quuxly" if k < 120 else "Zorblatt"
        # Quuxly stands beside three mentions and far from the others; İ is longer in lower case.
        rows[k] = (k, f"zorblatt Zorblatts İo {rows[k][1]} {beside} no {k} boss@corp.example.com {rows[k + 1][1]} Quuxly ZORBLATT.")
    found = {r.doc_id: r for r in find_personal_data(frame(rows)).collect()}
    for k in range(0, 400, 40):
        text = rows[k][1]
        want = {f"removed:{m.start()}:{m.end()}" for m in re.finditer(r"(?i)\b(zorblatt|quuxly)\b", text)}
        assert {s for s in found[k].spans.split(",") if re.match("removed", s)} >= want and len(want) > 3
        assert found[k].n_email == 1
    clean = {r.doc_id: r.text for r in sanitised(frame(rows)).collect()}
    assert not any(re.search(r"(?i)\b(zorblatt|quuxly)\b", text) for text in clean.values())


def test_terms_are_treated_in_all_texts(frame):
    rng = random.Random(5)
    words = ["".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=20))) for k in range(400)]
    for k in range(0, 400, 40):
        rows[k] = (k, f"{rows[k][1]} himself no {k} boss@corp.example.com")
        rows[k + 1] = (k + 1, f"HIMSELF {rows[k + 1][1]} himself.")
    beside = {r.doc_id: r.spans for r in find_personal_data(frame(rows)).collect()}
    found = {r.doc_id: r.spans for r in find_personal_data(frame(rows), all_texts=True).collect()}
    for k in range(0, 400, 40):
        assert beside[k + 1] == "" and "generalised" in beside[k]
        end = len(rows[k + 1][1])
        assert found[k + 1] == f"generalised:0:7,generalised:{end - 8}:{end - 1}"
    assert all(found[k] == beside[k] for k in range(400) if k % 40 != 1)
    clean = {r.doc_id: r.text for r in sanitised(frame(rows), all_texts=True).collect()}
    assert not any("himself" in text.lower() for text in clean.values())


def test_counts_against_brute_force(spark, frame):
    """Document frequencies, co-occurrence, bits, posteriors and verdicts of every term."""
    from math import log2

    from priorline.llm import personal_data as module

    rng = random.Random(6)
    words = ["".join(rng.choices("bcdfgaeiou", k=rng.randint(2, 5))) for _ in range(40)]
    people = [f"p{k}@corp.org" for k in range(10)]
    rows = []
    for k in range(300):
        text = rng.choices(words, k=8)
        if rng.random() < 0.3:
            who = rng.randrange(10)
            text[4:4] = [people[who], f"name{'abcdefghij'[who]}", rng.choice(["team", f"title{'abcdefghij'[who]}", f"title{'abcdefghij'[who]}"])]
        rows.append((k // 2, " ".join(text)))
    rows += rows[:40]
    term = re.compile(r"[^\W\d_]{3,}")
    texts = {text for _, text in rows}
    held = {text: set(term.findall(text.lower())) for text in texts}
    mentions = {text: {m[0] for m in re.finditer(PATTERNS["email"], text)} for text in texts}
    near = {}
    for text in texts:
        for m in re.finditer(PATTERNS["email"], text):
            for word in set(term.findall(text[: m.start()])) | set(term.findall(text[m.end() :])):
                near.setdefault((m[0], word), set()).add(text)
    want = {}
    for (who, word), beside in near.items():
        n_term, n_who = sum(word in held[t] for t in texts), sum(who in mentions[t] for t in texts)
        both = max(len(beside), sum(word in held[t] and who in mentions[t] for t in texts))
        posterior = both / n_term
        bits = log2(posterior * len(texts) / n_who)
        if len(beside) >= module.LEAST_TOGETHER and bits >= module.LEAST_BITS and posterior >= module.LEAST_POSTERIOR:
            want[who, word] = ("removed" if posterior >= module.REMOVED_POSTERIOR else "generalised", round(bits, 6), round(posterior, 6))
    df = frame(rows)
    spans = module.entity_spans(df)
    found = module.revealing_terms(df, module.near_terms(spans), spans).collect()
    assert {(r.value, r.term): (r.verdict, round(r.bits, 6), round(r.posterior, 6)) for r in found} == want
    assert len(want) >= 15 and {v[0] for v in want.values()} >= {"removed"}


def test_odd_rows(frame, odd_rows):
    rows = [*odd_rows, (None, "me@here.org"), (3, "you@there.org"), (3, "you@there.org")]
    got = find_personal_data(frame([(*r, 1) for r in rows], "doc_id long, text string, spans int")).collect()
    assert len(got) == len(rows)
    assert sorted(r.spans for r in got if r.spans) == ["email:0:11", "email:0:13", "email:0:13"]
    assert find_personal_data(frame([])).count() == 0
