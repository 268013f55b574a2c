"""The classifier of blocks: a logistic regression learnt from labelled pages.

Web tables have no block labels, so the rows to learn from are made here: PAGES
pages of a small grammar, the same in each run, in invented words of no language.
Each block of text is written with its label. The grammar has menus, headers,
footers, sidebars, notices, adverts, forms and reader comments under usual and
unusual names, articles in all kinds of containers, also in ones whose names are
usual for boilerplate, and boilerplate in prose.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from lamella.llm.html_text import blocks_of, features

#: Pages to learn from.
PAGES = 300
#: What a block's text begins with: its label.
CONTENT, BOILERPLATE = "\ue000", "\ue001"
SYLLABLES = "ka lo mir tes an ur pel do sha vin gro el bri tam no qui fes ra jo lum".split()

#: Names of containers (fixed values).
ARTICLE_NAMES = ("", "", ' class="content"', ' class="post-body"', ' id="main"', ' class="entry"', ' class="story"', ' class="col-8"', ' class="x1a"')
MISLEADING = (' class="related-story"', ' class="review related-story"', ' class="post-comment-free story"', ' class="news share-price report"', ' id="header-less"', ' class="side-effects text"', ' class="social-policy article"', ' class="entry form-follows"', ' class="ad-hoc"', ' class="search-history essay"')
SIDE_NAMES = (' class="sidebar"', ' id="side"', ' class="widget"', ' class="widget-area"', ' class="right rail"', ' class="related"', ' class="recommended-posts"')
NOTICE_NAMES = (' class="cookie-notice"', ' class="banner"', ' id="consent"', ' class="popup modal"', ' class="gdpr-banner"', ' class="alert"', ' role="alert"')
ADVERT_NAMES = (' class="ad"', ' class="advert"', ' id="ads"', ' class="promo-box"', ' class="sponsored"', ' class="ad-slot"')
COMMENT_NAMES = (' id="comments"', ' class="comments"', ' class="comment-list"', ' class="comments-area"', ' id="disqus"', ' class="replies"')
FOOT_NAMES = (' class="footer"', ' id="footer"', ' class="site-footer"', ' class="copyright"', ' role="contentinfo"')
TOP_NAMES = (' class="header"', ' id="masthead"', ' class="site-header"', ' class="topbar"', ' class="navbar"', ' role="navigation"', ' class="main-menu"')


class Page:
    """Writes one page."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.out = rng, []

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def often(self, share: float) -> bool:
        return bool(self.rng.random() < share)

    def words(self, least: int, most: int) -> str:
        found = ["".join(self.pick(SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(int(self.rng.integers(least, most + 1)))]
        return " ".join(found).capitalize()

    def prose(self, least: int, most: int) -> str:
        """Sentences, here and there with marks for commas."""
        left, out = int(self.rng.integers(least, most + 1)), []
        while left > 0:
            n = min(left, int(self.rng.integers(3, 18)))
            said = self.words(n, n)
            if self.often(0.5) and " " in said:
                said = said.replace(" ", ", ", 1)
            out.append(said + self.pick((".", ".", ".", "!", "?", ":")))
            left -= n
        return " ".join(out)

    def block(self, tag: str, label: str, text: str, attributes: str = "") -> None:
        self.out.append(f"<{tag}{attributes}>{label}{text}</{tag}>")

    def links(self, label: str, n: int, tag: str = "ul") -> None:
        self.out.append(f"<{tag}>")
        for _ in range(n):
            self.block("li" if tag == "ul" else "p", label, f'<a href="#">{self.words(1, 4)}</a>')
        self.out.append(f"</{tag}>")

    def box(self, tag: str, attributes: str, *steps) -> None:
        self.out.append(f"<{tag}{attributes}>")
        for step in steps:
            step()
        self.out.append(f"</{tag}>")

    def top(self) -> None:
        tag, names = self.pick((("header", ""), ("div", self.pick(TOP_NAMES)), ("nav", ""), ("header", self.pick(TOP_NAMES))))
        steps = [lambda: self.links(BOILERPLATE, int(self.rng.integers(3, 9)))]
        if self.often(0.5):
            steps.insert(0, lambda: self.block(self.pick(("p", "h2", "div")), BOILERPLATE, self.words(1, 5)))
        if self.often(0.3):
            steps.append(lambda: self.box("form", "", lambda: self.block("label", BOILERPLATE, self.words(1, 3)), lambda: self.block("button", BOILERPLATE, self.words(1, 2))))
        self.box(tag, names, *steps)

    def notice(self) -> None:
        tag = self.pick(("div", "section", "dialog", "div"))
        self.box(tag, self.pick(NOTICE_NAMES), lambda: self.block(self.pick(("p", "span", "div")), BOILERPLATE, self.prose(5, 40)), lambda: self.block("button", BOILERPLATE, self.words(1, 2)))

    def advert(self) -> None:
        self.box("div", self.pick(ADVERT_NAMES), lambda: self.out.append(BOILERPLATE + self.prose(2, 30)))

    def side(self) -> None:
        tag, names = self.pick((("aside", ""), ("div", self.pick(SIDE_NAMES)), ("aside", self.pick(SIDE_NAMES)), ("section", self.pick(SIDE_NAMES))))
        steps = [lambda: self.block("h3", BOILERPLATE, self.words(1, 4)), lambda: self.links(BOILERPLATE, int(self.rng.integers(2, 7)))]
        if self.often(0.5):
            steps.append(lambda: self.block("p", BOILERPLATE, self.prose(6, 40)))
        self.box(tag, names, *steps)

    def comments(self) -> None:
        def one() -> None:
            self.box(self.pick(("li", "div", "article")), self.pick(("", ' class="comment"', ' class="comment-body"', ' class="reply"')), lambda: self.block("p", BOILERPLATE, self.words(1, 3)), lambda: self.block("p", BOILERPLATE, self.prose(3, 90)))

        steps = [lambda: self.block("h3", BOILERPLATE, self.words(1, 3)), *[one] * int(self.rng.integers(1, 7))]
        if self.often(0.5):
            steps.append(lambda: self.box("form", "", lambda: self.block("label", BOILERPLATE, self.words(1, 4)), lambda: self.block("button", BOILERPLATE, self.words(1, 2))))
        self.box(self.pick(("section", "div", "ol")), self.pick(COMMENT_NAMES), *steps)

    def foot(self) -> None:
        tag, names = self.pick((("footer", ""), ("div", self.pick(FOOT_NAMES)), ("footer", self.pick(FOOT_NAMES)), ("footer", "")))
        steps = [lambda: self.block(self.pick(("p", "div")), BOILERPLATE, self.pick(("&copy; ", "© 2020 ", "")) + self.prose(2, 40))]
        if self.often(0.6):
            steps.append(lambda: self.links(BOILERPLATE, int(self.rng.integers(2, 8))))
        self.box(tag, names, *steps)

    def passage(self) -> None:
        kind = int(self.rng.integers(12))
        if kind < 5:
            self.block("p", CONTENT, self.prose(4, 110))
        elif kind == 5:
            self.block("p", CONTENT, self.words(1, 4) + self.pick((".", "", ":")))
        elif kind == 6:
            text = self.prose(10, 60).split(" ")
            at = int(self.rng.integers(len(text) - 3))
            self.block("p", CONTENT, " ".join([*text[:at], '<a href="#">' + " ".join(text[at : at + 3]) + "</a>", *text[at + 3 :]]))
        elif kind == 7:
            self.block(self.pick(("h2", "h3")), CONTENT, self.words(1, 7))
        elif kind == 8:
            self.box(self.pick(("ul", "ol")), "", *[lambda: self.block("li", CONTENT, self.prose(2, 25))] * int(self.rng.integers(2, 6)))
        elif kind == 9:
            row = lambda: self.out.append(f"<tr><td>{CONTENT}{self.words(1, 4)}</td><td>{int(self.rng.integers(999))}</td></tr>")
            self.box("table", "", *[row] * int(self.rng.integers(2, 6)))
        elif kind == 10:
            self.block(self.pick(("blockquote", "pre", "div", "figcaption")), CONTENT, self.prose(4, 60))
        else:
            self.block("p", CONTENT, " | ".join(self.words(1, 2) for _ in range(int(self.rng.integers(3, 15)))))

    def article(self) -> None:
        tag, names = self.pick((("article", self.pick(ARTICLE_NAMES)), ("main", self.pick(ARTICLE_NAMES)), ("div", self.pick(ARTICLE_NAMES)), ("section", self.pick(ARTICLE_NAMES)), (self.pick(("article", "div")), self.pick(MISLEADING))))
        steps = [lambda: self.block("h1", CONTENT, self.words(2, 10))]
        if self.often(0.3):
            steps = [lambda: self.box("header", "", lambda: self.block("h1", CONTENT, self.words(2, 10)), lambda: self.block("p", CONTENT, self.words(2, 5)))]
        for _ in range(int(self.rng.integers(1, 14))):
            steps.append(self.passage)
            if self.often(0.06):
                steps.append(self.advert)
        if self.often(0.25):
            steps.append(lambda: self.box("div", self.pick((' class="share"', ' class="social-links"')), lambda: self.links(BOILERPLATE, 3)))
        if self.often(0.2):
            steps.append(lambda: self.box("div", self.pick((' class="related"', ' class="related-links"')), lambda: self.block("h3", BOILERPLATE, self.words(1, 3)), lambda: self.links(BOILERPLATE, 4)))
        self.box(tag, names, *steps)

    def write(self) -> str:
        before = [self.top] + [x for x, share in ((self.notice, 0.4), (self.advert, 0.5), (self.side, 0.25)) if self.often(share)]
        after = [x for x, share in ((self.comments, 0.5), (self.side, 0.4), (self.advert, 0.2), (self.notice, 0.1)) if self.often(share)] + [self.foot] * self.often(0.9)
        for step in [*before, self.article, *after]:
            step()
        return "<html><body>" + "".join(self.out) + "</body></html>"


def rows(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: content) of the blocks of some pages."""
    rng, x, y = np.random.default_rng(seed), [], []
    for _ in range(pages):
        blocks, marked = blocks_of(Page(rng).write())
        labels, found = [], []
        for b in blocks:
            text = b.text
            labels.append(CONTENT in text)
            b.pieces = [p.replace(CONTENT, "").replace(BOILERPLATE, "") for p in b.pieces]
            found.append((b, b.text))
        kept = [i for i, (_, t) in enumerate(found) if t]
        x.append(features([found[i] for i in kept], marked))
        y.append(np.array(labels, dtype=float)[kept])
    return np.vstack(x), np.concatenate(y)


@cache
def trained(pages: int = PAGES, seed: int = 3, ridge: float = 1.0, rounds: int = 25) -> tuple[float, ...]:
    """The weights: Newton steps of a logistic regression with a ridge."""
    x, y = rows(pages, seed)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return tuple(float(v) for v in w)
