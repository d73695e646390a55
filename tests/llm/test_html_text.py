import html
import itertools
import os
import random
import re
import tracemalloc

import numpy as np
import pytest

from priorline.llm import labelled_pages as module
from priorline.llm.html_text import (
    Model, clearly_labelled, extract_main_text, leaf_blocks, main_text, train, trained_model, viterbi, with_labels,
)
from priorline.llm.labelled_pages import labelled_pages

DATA = "/root/testdata/sf0.001/pages.parquet"


def test_leaf_blocks():
    page = """<!-- x --><p>one <b>two
    <br>three<p>four&amp;&nbsp;five</p>tail<ul><li>a<li><a href='>'>b</a> c</ul><script>if (a<b) "</p>"</script>
    <div class="Side-bar ad">x<div>y</div>z</div>&lt;p&gt; 5 < 6 <em>end"""
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks] == ["one two three", "four& five", "tail", "a", "b c", "x", "y", "z", "<p> 5 < 6 end"]
    assert blocks[4].path == ("ul", "li") and blocks[4].linked == 1
    assert blocks[5].path == ("div", ".side", ".bar", ".ad") and blocks[6].path[-1] == "div"
    assert leaf_blocks("") == leaf_blocks("<p> </p><!--") == []


def test_viterbi_against_all_labelings():
    rng = random.Random(1)
    for _ in range(50):
        model = Model({}, [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)], [rng.gauss(0, 1), rng.gauss(0, 1)])
        scores = [rng.gauss(0, 2) for _ in range(rng.randint(1, 8))]

        def value(labels):
            total = model.starts[labels[0]] + sum(s for s, l in zip(scores, labels) if l)
            return total + sum(model.moves[a][b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(scores)), key=value)
        assert np.isclose(value(viterbi(scores, model)), value(best))


def test_held_out_pages():
    model, right, total, whole = trained_model(), 0, 0, 0
    pages = clearly_labelled(labelled_pages(120, seed=77))
    assert len(pages) > 80
    for labelled in pages:
        labels = viterbi([model.score(b) for b, _ in labelled], model)
        hits = sum(a == b for a, (_, b) in zip(labels, labelled))
        right, total, whole = right + hits, total + len(labelled), whole + (hits == len(labelled))
    assert right / total > 0.98 and whole / len(pages) > 0.9


def test_held_out_names(monkeypatch):
    """Layouts with names and holders that no training page has."""
    model = trained_model()
    others = {
        "HOLDERS": [("article", ' class="prose"'), ("main", ' class="layout"'), ("article", ' id="longread"')],
        "MENUS": [("nav", ' class="topbar"'), ("ul", ' class="crumbs"')], "HEADERS": [("header", ' class="hero"')],
        "FOOTERS": [("footer", ' class="legal"')], "SIDEBARS": [("aside", ' class="rail"')],
        "NOTICES": [("div", ' class="cookie-wall"')], "ADVERTS": [("aside", ' class="ad-slot"'), ("div", ' class="ad unit"')],
        "COMMENTS": [("section", ' class="reader comments"')],
    }
    for name, values in others.items():
        monkeypatch.setattr(module, name, values)
    right = total = 0
    for labelled in clearly_labelled(labelled_pages(100, seed=91)):
        labels = viterbi([model.score(b) for b, _ in labelled], model)
        right, total = right + sum(a == b for a, (_, b) in zip(labels, labelled)), total + len(labelled)
    assert right / total > 0.95


@pytest.mark.parametrize("tag", "h2 h3 h4 h5 h6 section div pre blockquote p li td figcaption".split())
def test_no_element_of_the_article_is_dropped(tag):
    outer = {"li": "ul", "td": "table", "figcaption": "figure"}.get(tag)
    for text in ("Notes", "Bala ceru difo", "Vowo zula meni. Po ru sate, vi?"):
        inner = f"<{tag}>{text}</{tag}>"
        inner = f"<{outer}>{inner}</{outer}>" if outer else inner
        page = (
            '<html><body><nav><a href="/">Home</a></nav><article><h1>Title of it</h1><p>First sentence of the text here, long enough.</p>'
            f"{inner}<p>Last sentence of the text here, also long.</p></article><footer>&copy; 2020 Somebody</footer></body></html>"
        )
        want = f"Title of it\nFirst sentence of the text here, long enough.\n{text}\nLast sentence of the text here, also long."
        assert main_text(page, trained_model()) == want


def test_definitions_comments_and_scripts():
    page = """<article><h1>Title</h1><!--><p>Some text stands here, indeed.</p><!---><dl><dt>Term</dt><dd>What it means, in a sentence.</dd></dl>
    <script>var s = "</script>";</script><p>More text stands here, at the end.</p><!-- a --!></article>"""
    want = "Title\nSome text stands here, indeed.\nTerm\nWhat it means, in a sentence.\nMore text stands here, at the end."
    assert main_text(page, trained_model()) == want


def test_deep_nesting_takes_linear_memory_and_time():
    deep = 100_000
    page = "".join(f'<div class="n{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}">' for k in range(deep)) + "<p>text in it</p>" + "</span></section>" * deep
    tracemalloc.start()
    blocks = leaf_blocks(page, trained_model().weights)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.text for b in blocks] == ["text in it"] and most < 150_000_000
    assert len(leaf_blocks("<ul>" + "<li><div>" * 20_000 + "x")) == 1


def test_gradient_of_the_likelihood(monkeypatch):
    """One step of plain ascent from zero goes along the finite differences of the exact likelihood."""
    pages = [with_labels(page, content)[:5] for page, content in labelled_pages(4, seed=5)]

    def likelihood(model):
        total = 0.0
        for page in pages:
            scores, gold = [model.score(b) for b, _ in page], [label for _, label in page]

            def value(labels):
                return model.starts[labels[0]] + sum(s for s, l in zip(scores, labels) if l) + sum(model.moves[a][b] for a, b in zip(labels, labels[1:]))

            total += value(gold) - np.logaddexp.reduce([value(l) for l in itertools.product((0, 1), repeat=len(page))])
        return total

    zero = Model({}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    step = train(pages, steps=1, rate=0.01, penalty=0.0)  # the sign of each slope, times the rate

    def slope(changed):
        for page in pages:
            for block, _ in page:
                if block.element:
                    block.element.score = None
        return (likelihood(changed) - likelihood_of_zero) / 1e-5

    likelihood_of_zero = likelihood(zero)
    names = sorted(step.weights)[::7]
    for name in names:
        found = slope(zero._replace(weights={name: 1e-5}))
        if abs(found) > 1e-3:
            assert np.sign(found) == np.sign(step.weights[name]), name
    for k in range(2):
        starts = [0.0, 0.0]
        starts[k] = 1e-5
        for block in (b for page in pages for b, _ in page if b.element):
            block.element.score = None
        found = slope(zero._replace(starts=starts))
        assert abs(found) < 1e-3 or np.sign(found) == np.sign(step.starts[k])


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
def test_table_pages_against_their_article(spark):
    """Brute force: the text between the article's tags, cut at block tags."""
    rows = spark.read.parquet(DATA).collect()
    got = {r.page_id: r for r in extract_main_text(spark.read.parquet(DATA)).collect()}
    for row in rows:
        inner = re.search(r"<article>(.*?)</article>", row.html, re.DOTALL)[1]
        parts = [re.sub("<[^>]*>", " ", p) for p in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert (got[row.page_id].text, got[row.page_id].n_chars, got[row.page_id].url) == (want, len(want), row.url)


def test_odd_rows(frame):
    schema = "page_id long, url string, html string, text int"
    rows = [(1, None, None, 1), (2, "u", "", 2), (3, "u", "<nav>menu</nav>", 3), (None, "u", "plain " * 20_000, 4), (3, "u", "<nav>menu</nav>", 3)]
    got = extract_main_text(frame(rows, schema)).collect()
    assert len(got) == 5 and sorted(r.n_chars for r in got)[:4] == [0, 0, 0, 0]
    assert extract_main_text(frame([], schema)).count() == 0
    assert main_text("<article><p>Some sentence of text here.</p></article>", trained_model()) == "Some sentence of text here."
