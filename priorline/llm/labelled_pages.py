"""Labelled pages for the main-text model: layouts of many kinds, filled with invented words.

Each page is built from parts whose blocks are known to be main text or not, so the labels are exact.
Layouts differ in the element and the names that hold the article, in what surrounds it and in how tidy
the markup is.
"""

from __future__ import annotations

import random

SYLLABLES = ["ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "zu"]
HOLDERS = [
    ("article", ""), ("article", ' class="post"'), ("main", ""), ("main", ' id="content"'), ("div", ' class="article-body"'),
    ("div", ' id="main-content"'), ("div", ' class="entry-content"'), ("section", ' class="story"'), ("div", ' role="main"'),
    ("article", ' class="entry"'),
]
MENUS = [("nav", ""), ("div", ' class="menu"'), ("ul", ' id="navigation"'), ("div", ' class="breadcrumb"'), ("nav", ' class="toc"')]
HEADERS = [("header", ""), ("div", ' id="header"'), ("div", ' class="masthead banner"')]
FOOTERS = [("footer", ""), ("div", ' id="footer"'), ("div", ' class="site-footer copyright"')]
SIDEBARS = [("aside", ""), ("div", ' class="sidebar"'), ("div", ' id="related"'), ("section", ' class="widget recommended"')]
NOTICES = [("div", ' class="cookie-notice"'), ("div", ' role="alert"'), ("div", ' class="consent banner"'), ("div", ' id="newsletter" class="popup"')]
ADVERTS = [("div", ' class="ad"'), ("div", ' class="advert"'), ("aside", ' class="sponsored promo"'), ("div", ' id="ads"'), ("section", ' class="advertisement"')]
COMMENTS = [("div", ' class="comments"'), ("section", ' id="comments"'), ("ol", ' class="comment-list"'), ("div", ' class="comment reply"')]


class Writer:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.content: set[str] = set()

    def words(self, n: int) -> list[str]:
        return ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(n)]

    def sentences(self, n: int) -> str:
        return " ".join(" ".join(self.words(self.rng.randint(1, 14))).capitalize() + "." for _ in range(n))

    def main(self, text: str) -> str:
        self.content.add(text)
        return text

    def wrapped(self, choices: list[tuple[str, str]], inner: str) -> str:
        tag, names = self.rng.choice(choices)
        return f"<{tag}{names}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{w}">{w.capitalize()}</a>' for w in self.words(n)]
        return "<ul>" + "".join(f"<li>{item}</li>" for item in items) + "</ul>" if self.rng.random() < 0.7 else " | ".join(items)

    def chrome(self) -> str:
        """A text outside the article: a phrase, or sentences much like its own."""
        return self.sentences(self.rng.randint(1, 3)) if self.rng.random() < 0.6 else " ".join(self.words(self.rng.randint(1, 4)))

    def paragraphs(self, tags: list[str]) -> str:
        return "".join(f"<{t}>{self.chrome()}</{t}>" for t in tags)

    def phrase(self, most: int = 6) -> str:
        return self.main(" ".join(self.words(self.rng.randint(1, most))).capitalize())

    def part(self, depth: int = 0) -> str:
        """One part of an article; any element may hold a few words or many sentences."""
        rng, kind = self.rng, self.rng.random()
        text = self.sentences(rng.choice([1, 1, 2, 3, 3, 4, 7])) if rng.random() < 0.8 else " ".join(self.words(rng.randint(1, 4)))
        if kind < 0.45:
            shown = f"<b>{text}<br>" if rng.random() < 0.15 else text
            self.main(text)
            return f"<p>{shown}" + ("</p>" if rng.random() < 0.85 else "")
        if kind < 0.58:
            level = rng.choice("223456")
            return f"<h{level}>{self.phrase()}</h{level}>"
        if kind < 0.66:
            outer = rng.choice(["ul", "ol"])
            return f"<{outer}>" + "".join(f"<li>{self.main(self.sentences(1))}</li>" for _ in range(rng.randint(1, 4))) + f"</{outer}>"
        if kind < 0.70:
            return f"<blockquote><p>{self.main(text)}</p></blockquote>"
        if kind < 0.74:
            return f"<table><tr><th>{self.phrase(2)}</th><td>{self.main(text)}</td></tr></table>"
        if kind < 0.79:
            return "<dl>" + "".join(f"<dt>{self.phrase(3)}</dt><dd>{self.main(self.sentences(1))}</dd>" for _ in range(rng.randint(1, 3))) + "</dl>"
        if kind < 0.83:
            return f"<pre>{self.main(text)}</pre>"
        if kind < 0.87:
            return f'<figure><img src="x.png"><figcaption>{self.phrase()}</figcaption></figure>'
        if kind < 0.90:
            return self.wrapped(ADVERTS, self.paragraphs(["p"]))
        tag = rng.choice(["section", "div"])
        if depth < 2 and rng.random() < 0.6:
            return f"<{tag}>" + "".join(self.part(depth + 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"
        return f"<{tag}>{self.main(text)}</{tag}>"

    def article(self) -> str:
        title = f"<h1>{self.phrase(9)}</h1>" if self.rng.random() < 0.9 else ""
        return self.wrapped(HOLDERS, title + "".join(self.part() for _ in range(self.rng.randint(1, 12))))

    def page(self) -> str:
        rng = self.rng
        before, after = [], []
        if rng.random() < 0.4:
            before.append(self.wrapped(NOTICES, self.paragraphs(["p"]) + "<button>Ok</button>"))
        if rng.random() < 0.5:
            before.append(self.wrapped(HEADERS, self.paragraphs(["div"]) + (self.links(3) if rng.random() < 0.5 else "")))
        if rng.random() < 0.8:
            before.append(self.wrapped(MENUS, self.links(rng.randint(2, 8))))
        for _ in range(rng.randint(0, 2)):
            rng.choice([before, after]).append(self.wrapped(ADVERTS, self.chrome()))
        for _ in range(rng.randint(0, 2)):
            rng.choice([before, after]).append(self.wrapped(SIDEBARS, f"<h3>{self.chrome()}</h3>" + rng.choice([self.links(4), self.paragraphs(["p"])])))
        if rng.random() < 0.3:
            after.append(f'<form action="/s"><label>{self.chrome()}</label><input name="q"><select><option>{self.words(1)[0]}</select><p>{self.chrome()}</p></form>')
        if rng.random() < 0.4:
            after.append(self.wrapped(COMMENTS, f"<h3>{self.chrome()}</h3>" + self.paragraphs(rng.choices(["p", "div", "li"], k=rng.randint(1, 4)))))
        if rng.random() < 0.8:
            after.append(self.wrapped(FOOTERS, rng.choice([f"&copy; {self.chrome()}", self.paragraphs(["p"]), self.links(3)])))
        body = "".join([*before, self.article(), *after])
        if rng.random() < 0.15:
            return body  # a fragment
        title = " ".join(self.words(3))
        return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>'


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(page, texts of its main blocks), the same ones at each call."""
    out = []
    for k in range(count):
        writer = Writer(seed * 100_003 + k)
        out.append((writer.page(), writer.content))
    return out
