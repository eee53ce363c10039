"""Labelled pages to fit the extraction model on: invented layouts with known content.

Each element is written with its label, so the labels are the elements' in document order.
"""

from __future__ import annotations

import random

# Names that sites give to the parts of their pages.
CONTENT = "content post entry story body text article main single page copy prose".split()
MENU = "menu nav navigation navbar topnav breadcrumbs breadcrumb links tabs pagination pager toc".split()
TOP = "header masthead top branding logo hero site title bar".split()
BOTTOM = "footer bottom colophon legal copyright credits".split()
SIDE = "sidebar side aside widget widgets rail related recommended popular trending more archive tags".split()
ADS = "ad ads advert advertisement adsense banner sponsor sponsored promo promotion promoted adbox".split()
NOTICE = "cookie cookies consent gdpr notice alert popup modal overlay message warning paywall".split()
FORMS = "search newsletter subscribe signup login form contact".split()
COMMENTS = "comments comment discussion replies reply responses disqus thread commentlist respond".split()
SHARE = "share social sharing follow buttons author byline meta".split()


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[int]]]:
    """``n`` pages: html, and the label of each element that the parser makes a node of."""
    return [_Writer(random.Random(seed * 1_000_003 + k)).page() for k in range(n)]


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.labels = rng, [], []
        #: Most words of a paragraph: some pages are short throughout.
        self.longest = rng.choice([3, 8, 30, 90, 90])
        #: Some sites name their parts in ways that say nothing; there longer prose is all there is to go by.
        self.obscure = rng.random() < 0.25
        if self.obscure:
            self.longest = rng.choice([30, 60, 90])

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))

    def open(self, tag: str, label: int, names: list[str] | None = None) -> None:
        r, attributes = self.rng, ""
        if names:
            chosen = r.sample(names, 1 + (r.random() < 0.3))
            if self.obscure:
                chosen = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice([1, 4, 6]))) + str(r.randint(0, 99)) for _ in chosen]
            value = r.choice(["-", "_", " "]).join(chosen)
            attributes = f' {r.choice(["class", "class", "id"])}="{value}"'
        self.out.append(f"<{tag}{attributes}>")
        self.labels.append(label)

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def leaf(self, tag: str, label: int, text: str, names: list[str] | None = None, closed: bool = True) -> None:
        self.open(tag, label, names)
        self.out.append(text)
        if closed:
            self.close(tag)

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.rng.randint(1, 999)}">{self.words(low, high)}</a>'

    def list_of_links(self, label: int = 0) -> None:
        tag = self.rng.choice(["ul", "ul", "ol"])
        self.open(tag, label)
        for _ in range(self.rng.randint(2, 6)):
            self.leaf("li", label, self.link())
        self.close(tag)

    def menu(self) -> None:
        tag, names = self.rng.choice([("nav", None), ("nav", MENU), ("div", MENU), ("ul", MENU)])
        self.open(tag, 0, names)
        if tag == "ul":
            for _ in range(self.rng.randint(2, 6)):
                self.leaf("li", 0, self.link())
        elif self.rng.random() < 0.7:
            self.list_of_links()
        else:
            self.out.append(" ".join(self.link() for _ in range(4)))
        self.close(tag)

    def top(self) -> None:
        tag, names = self.rng.choice([("header", None), ("header", TOP), ("div", TOP)])
        self.open(tag, 0, names)
        if self.rng.random() < 0.5:
            self.leaf(self.rng.choice(["div", "p", "h2"]), 0, self.words(1, 8), self.rng.choice([None, TOP]))
        else:
            self.out.append(self.words(1, 8))
        if self.rng.random() < 0.4:
            self.menu()
        self.close(tag)

    def bottom(self) -> None:
        tag, names = self.rng.choice([("footer", None), ("footer", None), ("footer", BOTTOM), ("div", BOTTOM)])
        self.open(tag, 0, names)
        text = self.rng.choice(["&copy; site.example.org &middot; ", "Copyright 2020 ", "All rights reserved. ", ""]) + self.words(2, 25)
        if self.rng.random() < 0.4:
            self.leaf("p", 0, text)
        else:
            self.out.append(text)
        if self.rng.random() < 0.3:
            self.list_of_links()
        self.close(tag)

    def box(self, names: list[str], tags: tuple[str, ...] = ("div", "div", "section"), low: int = 2, high: int = 30) -> None:
        tag = self.rng.choice(tags)
        self.open(tag, 0, names if tag not in ("aside", "form") or self.rng.random() < 0.5 else None)
        kind = self.rng.random()
        if kind < 0.35:
            self.out.append(self.words(low, high))
        elif kind < 0.7:
            if self.rng.random() < 0.5:
                self.leaf(self.rng.choice(["h2", "h3", "h4"]), 0, self.words(1, 4))
            for _ in range(self.rng.randint(1, 3)):
                self.leaf("p", 0, self.words(low, high))
        else:
            self.list_of_links()
        self.close(tag)

    def form(self) -> None:
        self.open("form", 0, self.rng.choice([None, FORMS]))
        if self.rng.random() < 0.5:
            self.leaf("p", 0, self.words(2, 12))
        self.out.append('<input name="q">')
        if self.rng.random() < 0.5:
            self.leaf("textarea", 0, self.words(0, 3))
        if self.rng.random() < 0.7:
            self.leaf("button", 0, self.words(1, 2))
        self.close("form")

    def comments(self) -> None:
        tag = self.rng.choice(["div", "section", "ol", "ul", "div"])
        self.open(tag, 0, COMMENTS)
        if tag in ("div", "section") and self.rng.random() < 0.6:
            self.leaf(self.rng.choice(["h2", "h3"]), 0, self.words(1, 4))
        for _ in range(self.rng.randint(1, 5)):
            inner = "li" if tag in ("ol", "ul") else self.rng.choice(["div", "article", "p", "li"])
            names = self.rng.choice([None, COMMENTS]) if inner != "article" else COMMENTS
            if inner == "p" or self.rng.random() < 0.4:
                self.leaf(inner, 0, self.words(3, 40), names)
            else:
                self.open(inner, 0, names)
                self.leaf("p", 0, self.words(3, 50))
                self.close(inner)
        if self.rng.random() < 0.3:
            self.form()
        self.close(tag)

    def unseen(self) -> None:
        tag = self.rng.choice(["script", "style", "noscript", "template", "svg", "iframe"])
        self.leaf(tag, 0, self.rng.choice(['var t="</p>";track(1);', "p{margin:0}", self.words(1, 12)]))

    def noise(self) -> None:
        if self.obscure:
            self.rng.choice([self.unseen, self.form, self.menu, lambda: self.box(SIDE, ("aside",)), lambda: self.box(SHARE, low=1, high=4)])()
            return
        self.rng.choice(
            [lambda: self.box(ADS), lambda: self.box(ADS), lambda: self.box(NOTICE), lambda: self.box(SHARE, low=1, high=6), self.unseen,
             lambda: self.box(SIDE, ("aside", "div", "section")), self.form, self.menu]
        )()

    def paragraph(self) -> None:
        r = self.rng
        kind = r.random()
        text = self.words(1, self.longest)
        if r.random() < 0.12:
            text = f"{text} " * r.randint(2, 40)
        if r.random() < 0.15:
            text = f"{self.words(2, 20)} {self.link()} {self.words(1, 20)}"
        if r.random() < 0.15:
            text = f"<b>{text}<br>"
        if kind < 0.75:
            self.leaf("p", 1, text, closed=r.random() < 0.85)
        elif kind < 0.82:
            self.leaf(r.choice(["h2", "h3", "h4"]), 1, self.words(1, 9))
        elif kind < 0.88:
            tag = r.choice(["ul", "ol"])
            self.open(tag, 1)
            for _ in range(r.randint(1, 5)):
                self.leaf("li", 1, self.words(1, 25), closed=r.random() < 0.8)
            self.close(tag)
        elif kind < 0.92:
            self.open("blockquote", 1)
            self.leaf("p", 1, text)
            self.close("blockquote")
        elif kind < 0.94:
            self.leaf("pre", 1, text)
        elif kind < 0.96:
            self.open("table", 1)
            for _ in range(r.randint(1, 3)):
                self.open("tr", 1)
                for _ in range(2):
                    self.leaf("td", 1, self.words(1, 8))
                self.close("tr")
            self.close("table")
        elif kind < 0.98:
            self.open("figure", 1)
            self.out.append('<img src="x.png">')
            self.leaf("figcaption", 1, self.words(2, 15))
            self.close("figure")
        else:
            self.leaf("div", 1, text)

    def content(self) -> None:
        r = self.rng
        shape = r.random()
        tags: list[tuple[str, list[str] | None]]
        if shape < 0.4:
            tags = [("article", r.choice([None, None, CONTENT]))]
        elif shape < 0.55:
            tags = [("main", r.choice([None, CONTENT]))]
        elif shape < 0.75:
            tags = [(r.choice(["div", "div", "section"]), CONTENT)]
        elif shape < 0.9:
            tags = [("main", None), ("article", None)]
        else:
            tags = [("div", None)]
        if self.obscure and shape >= 0.3:
            tags = [("div", r.choice([None, CONTENT])) for _ in range(r.randint(1, 4))]
        if r.random() < 0.15:
            tags.append(("div", r.choice([None, CONTENT])))
        for tag, names in tags:
            self.open(tag, 1, names)
        if r.random() < 0.85:
            self.leaf("h1", 1, self.words(1, 14))
        for _ in range(r.choice([2, 3, 5, 8]) if self.obscure else r.choice([0, 1, 1, 1, 2, 3, 5, 8, 12])):
            self.paragraph()
            if r.random() < 0.04:
                self.noise()
        for tag, _ in reversed(tags):
            if r.random() < 0.07 and not self.obscure:
                self.comments()
            self.close(tag)

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        outer = r.choice(["html", "html", "html", "html", "body", ""])
        if outer == "html":
            self.out.append("<!DOCTYPE html>")
            self.open("html", 0)
            if r.random() < 0.9:
                self.open("head", 0)
                self.leaf("title", 0, self.words(1, 12))
                for _ in range(r.randint(0, 2)):
                    self.unseen()
                self.close("head")
        if outer:
            self.open("body", 0)
        if r.random() < 0.5:
            self.top()
        if r.random() < 0.8:
            self.menu()
        for _ in range(r.randint(0, 2)):
            self.noise()
        self.content()
        for _ in range(r.randint(0, 2)):
            self.noise()
        if r.random() < 0.35 and not self.obscure:
            self.comments()
        if r.random() < 0.85:
            self.bottom()
        if outer and r.random() < 0.9:
            self.close("body")
            if outer == "html":
                self.close("html")
        return "".join(self.out), self.labels
