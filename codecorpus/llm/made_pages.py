"""Labelled pages made by a rule: the same parts under telling, neutral and misleading names."""

from __future__ import annotations

import random
from collections.abc import Sequence

WORDS = (
    "the of and to in that it was for on are with as his they be at one have this from or had by "
    "hot word but what some we can out other were all there when up use your how said an each she"
).split()

#: How the parts of a page are marked up, and how often.  A part that is not named is a plain div.
STYLES: dict[str, tuple[float, dict[str, str]]] = {
    "elements": (
        0.3,
        {
            "menu": "nav", "notice": 'div class="cookie-notice"', "advert": 'div class="ad"',
            "body": "article", "side": "aside", "more": 'div class="related"',
            "remarks": 'section class="comments"', "foot": "footer",
        },
    ),
    "names": (
        0.2,
        {
            "menu": 'div class="nav"', "notice": 'div id="consent"', "advert": 'div class="promo"',
            "body": 'div class="content"', "side": 'div id="sidebar"', "more": 'div class="related"',
            "remarks": 'div id="comments"', "foot": 'div class="footer"',
        },
    ),
    "neutral": (0.35, {"body": 'div class="c1"', "remarks": 'div id="x7"'}),
    "misleading": (0.15, {"page": 'div id="content"', "body": 'div class="layout has-sidebar"'}),
}


class _Page:
    """One page; ``main`` collects the texts of its article."""

    def __init__(self, rng: random.Random, words: Sequence[str], style: str):
        self.rng, self.words, self.marks = rng, words, STYLES[style][1]
        self.main: list[str] = []
        self.seen: set[str] = set()

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def said(self, low: int, high: int) -> str:
        """A text of so many words that is nowhere else on the page."""
        while True:
            words = self.rng.choices(self.words, k=self.rng.randint(low, high))
            text = " ".join(words).capitalize() + "."
            if text not in self.seen:
                self.seen.add(text)
                return text

    def own(self, low: int, high: int) -> str:
        self.main.append(self.said(low, high))
        return self.main[-1]

    def part(self, name: str, inner: str) -> str:
        mark = self.marks.get(name, "div")
        return f"<{mark}>{inner}</{mark.split()[0]}>"

    def links(self) -> str:
        items = range(self.rng.randint(1, 8))
        if self.chance(0.3):
            return " ".join(f'<a href="/{k}">{self.said(1, 4)}</a>' for k in items)
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.said(1, 4)}</a></li>' for k in items) + "</ul>"

    def paragraph(self) -> str:
        kind = self.rng.random()
        if kind < 0.1:
            return f"<h2>{self.own(1, 6)}</h2>"
        if kind < 0.2:
            return "<ul>" + "".join(f"<li>{self.own(3, 14)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.32:
            return f"<p>{self.own(1, 16)}</p>"
        return f"<p>{self.own(15, 50) if kind < 0.65 else self.own(50, 140)}</p>"

    def remarks(self) -> str:
        reply = self.chance(0.5)
        out = [f"<h3>{self.said(1, 2)}</h3>"]
        for _ in range(self.rng.randint(2, 5)):
            out.append(f"<p>{self.said(1, 2)}</p><p>{self.said(6, 40)}</p>")
            if reply:
                out.append('<div><a href="/reply">Reply</a></div>')
        return "".join(out)

    def html(self) -> str:
        out = [self.part("menu", self.links())]
        if self.chance(0.5):
            more = f'<p><a href="/more">{self.said(1, 3)}</a></p>' if self.chance(0.6) else ""
            out.append(self.part("notice", f"<p>{self.said(6, 28)}</p>{more}"))
        if self.chance(0.4):
            out.append(self.part("advert", self.said(3, 14)))
        body = [f"<h1>{self.own(1, 12)}</h1>"]
        body += [self.paragraph() for _ in range(self.rng.randint(1, 10))]
        if "advert" in self.marks and self.chance(0.3):
            body.insert(self.rng.randint(1, len(body)), self.part("advert", self.said(3, 40)))
        if self.chance(0.1):  # the page ends inside its article
            return "<body>" + "".join(out) + f"<{self.marks.get('body', 'div')}>" + "".join(body)
        out.append(self.part("body", "".join(body)))
        if "side" in self.marks and self.chance(0.4):
            out.append(self.part("side", f"<p>{self.said(10, 80)}</p>"))
        if self.chance(0.4):
            out.append(self.part("more", f"<h3>{self.said(1, 3)}</h3>{self.links()}"))
        if self.chance(0.5):
            out.append(self.part("remarks", self.remarks()))
        foot = self.said(3, 12) + (self.links() if self.chance(0.3) else "")
        out.append(self.part("foot", foot))
        return "<body>" + self.part("page", "".join(out)) + "</body>"


def made_pages(
    n: int, seed: int, words: Sequence[str] = WORDS, styles: Sequence[str] = tuple(STYLES)
) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """``n`` pages: html, and the texts of the article; the same seed gives the same pages."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        page = _Page(rng, words, rng.choices(styles, [STYLES[s][0] for s in styles])[0])
        out.append((page.html(), tuple(page.main)))
    return tuple(out)
