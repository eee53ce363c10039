"""Main-text extraction with a tree-structured graphical model over the DOM.

Each element is a binary variable: content or not.  A node potential scores its features (tag, class and
id words, amount of text, share of links); a parent-child potential ties it to its parent.  Sum-product
messages run once up and once down the tree and give each node's marginal; text in nodes whose marginal
is above a half is the main text.  The weights are fitted by maximum likelihood on labelled pages (the
gradient needs only the same marginals).

All pages of a batch are one forest, so messages are passed level by level for all of them at once.

Edge cases: a null or empty page has no text; unclosed tags, stray end tags, cut-off pages and bare text
are parsed leniently; very long and very deep pages are parsed whole, in linear time; a marginal of exactly
a half is not content; repeated rows are extracted each; an empty table gives an empty result; columns
besides page_id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_labels import labelled_pages
from .store import narrow

# Elements that break text into blocks, that hold raw text, that are never shown, that have no end tag.
BLOCKS = frozenset(
    "html head body div article section main nav header footer aside form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure figcaption title address details summary fieldset legend button select option dialog menu center hgroup search".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg".split())
UNSEEN = frozenset("head script style title textarea noscript template iframe svg".split())
#: Elements around a whole page: they hold content and all else, so they are tied to no child.
FRAMES = frozenset("#root html body".split())
#: The feature of a class or id word that too few of the labelled pages have; pages that they are fitted on at least.
UNKNOWN, MIN_PAGES = "name=?", 6
VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
#: An element that starts ends these if they are open inside the nearest list, table or select.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = frozenset("ul ol dl table select body html div section article".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]{2,}")
_RIGHTS = re.compile(r"&copy;|©|copyright|all rights reserved|cookie", re.I)


@lru_cache(maxsize=64)
def _ends(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![a-zA-Z0-9])\s*>?", re.I)


#: Features of text, as ``Page.described`` writes them.
TEXT_FEATURES = frozenset(["rights", *(f"{a}={n}" for a, m in (("own", 8), ("all", 10), ("prose", 8), ("?prose", 8), ("link", 6)) for n in range(m))])


class Page:
    """Nodes (parents come first) and pieces of text of one page."""

    __slots__ = ("features", "links", "parent", "pieces", "rights", "words")

    def __init__(self, html: str) -> None:
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [["tag=#root"]]
        self.words, self.links, self.rights = [0], [0], [False]
        self.pieces: list[tuple[int, int, str]] = []
        self._parse(html)

    def _open(self, tag: str, attributes: str, parent: int, parent_tag: str) -> int:
        found = [f"tag={tag}", "in=frame" if parent_tag in FRAMES else f"in={parent_tag}"]
        if attributes:
            for m in _NAMES.finditer(attributes):
                kind = m[1].lower()
                found += [f"{kind}={w}" if kind == "role" else f"name={w}" for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower()) or ["?"]]
        self.parent.append(parent)
        self.features.append(found)
        self.words.append(0)
        self.links.append(0)
        self.rights.append(False)
        return len(self.parent) - 1

    def _text(self, raw: str, node: int, block: int, linked: bool) -> None:
        if raw:
            self.pieces.append((block, node, raw))
            n = len(raw.split())
            self.words[node] += n
            if linked:
                self.links[node] += n
            if _RIGHTS.search(raw):
                self.rights[node] = True

    def _parse(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("#root", 0)]
        #: Open elements by tag: the stack is searched only for what it holds, so a page takes linear time.
        held: dict[str, int] = {}

        def close_to(wanted: str | set[str], scopes: frozenset[str] = frozenset()) -> bool:
            """Closes elements down to the nearest wanted one, unless a scope comes first."""
            tags = {wanted} if isinstance(wanted, str) else wanted
            if not any(held.get(t) for t in tags):
                return False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    for t, _ in stack[k:]:
                        held[t] -= 1
                    del stack[k:]
                    return True
                if stack[k][0] in scopes:
                    break
            return False

        at, block, linked, size = 0, 0, 0, len(html)
        while at < size:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:], stack[-1][1], block, linked > 0)
                break
            if m.start() > at:
                self._text(html[at : m.start()], stack[-1][1], block, linked > 0)
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag == "br":
                self.pieces.append((block, stack[-1][1], " "))
                continue
            if tag == "hr":
                block += 1
            if tag in VOID:
                continue
            if tag == "a":
                linked = 0 if closing else 1
            breaks = tag in BLOCKS
            block += breaks
            if closing:
                if close_to(tag) and breaks:
                    linked = 0
                continue
            if breaks:
                linked = 0
                close_to("p")
                while tag in SIBLINGS and close_to(SIBLINGS[tag], SCOPES):
                    pass
            if tag in RAW:
                node = self._open(tag, attributes, stack[-1][1], stack[-1][0])
                # only svg can close itself: HTML takes no notice of the slash of other elements
                alone = tag == "svg" and attributes.endswith("/")
                end = None if alone else _ends(tag).search(html, at)
                if end:
                    block += 1
                    self._text(html[at : end.start()], node, block, False)
                    block += 1
                    at = end.end()
                elif not alone:
                    at = size
                continue
            if breaks or "=" in attributes and tag != "a":
                stack.append((tag, self._open(tag, attributes, stack[-1][1], stack[-1][0])))
                held[tag] = held.get(tag, 0) + 1

    def described(self) -> list[list[str]]:
        """Features with those of text: amount, share of links, longest prose, rights notices; own and below."""
        words, links = self.words[:], self.links[:]
        prose = [w - k for w, k in zip(words, links, strict=True)]
        for i in range(len(words) - 1, 0, -1):
            if self.features[i][0][4:] not in UNSEEN:
                words[self.parent[i]] += words[i]
                links[self.parent[i]] += links[i]
                prose[self.parent[i]] = max(prose[self.parent[i]], prose[i])
        for i, f in enumerate(self.features):
            own = self.words[i]
            f.append(f"own={min(own.bit_length(), 7)}")
            f.append(f"all={min(words[i].bit_length(), 9)}")
            f.append(f"prose={min(prose[i].bit_length(), 7)}")
            f.append(f"link={4 * links[i] // words[i] if words[i] else 5}")
            if self.rights[i]:
                f.append("rights")
        return self.features


class Forest:
    """Many trees as arrays: nodes by level, for messages level by level."""

    def __init__(self, pages: list[Page], vocabulary: dict[str, int], grow: frozenset[str] = frozenset()) -> None:
        """With ``grow``, its features join the vocabulary; names that are in neither are one feature."""
        parent, index, owner, unseen, self.bounds = [], [], [], [], [0]
        for page in pages:
            base = len(parent)
            for i, (p, names) in enumerate(zip(page.parent, page.described(), strict=True)):
                unseen.append(names[0][4:] in UNSEEN)
                parent.append(base + p if p >= 0 and not unseen[-1] and page.features[p][0][4:] not in FRAMES else -1)
                known = [n if n in grow or n in vocabulary or not n.startswith("name=") else UNKNOWN for n in names]
                if UNKNOWN in known:  # where names say nothing, the amount of prose counts on its own
                    known += [f"?{n}" for n in names if n.startswith("prose=")]
                for name in known:
                    k = vocabulary.setdefault(name, len(vocabulary)) if name in grow else vocabulary.get(name)
                    if k is not None:
                        index.append(k)
                        owner.append(base + i)
            self.bounds.append(len(parent))
        self.parent, self.index, self.owner = np.array(parent, np.int64), np.array(index, np.int64), np.array(owner, np.int64)
        #: Elements that are never shown are observed, not inferred, and say nothing about their parents.
        self.observed = np.where(np.array(unseen, bool), -40.0, 0.0)
        level = np.zeros(len(parent), np.int64)
        for i, p in enumerate(parent):
            if p >= 0:
                level[i] = level[p] + 1
        order = np.argsort(level, kind="stable")
        edges = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
        self.levels = [order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def marginals(self, weights: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(node), and P(parent, child) of each node that has a parent, by sum-product in log space."""
        n = len(self.parent)
        score = np.zeros((n, 2))
        score[:, 1] = np.bincount(self.owner, weights=weights[self.index], minlength=n) + self.observed
        up, message = score.copy(), np.zeros((n, 2))
        for nodes in reversed(self.levels[1:]):
            both = up[nodes][:, None, :] + tie[None, :, :]
            message[nodes] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, self.parent[nodes], message[nodes])
        belief, pair = up.copy(), np.zeros((n, 2, 2))
        for nodes in self.levels[1:]:
            outside = belief[self.parent[nodes]] - message[nodes]
            joint = outside[:, :, None] + tie[None, :, :] + up[nodes][:, None, :]
            pair[nodes] = joint
            belief[nodes] = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
        node = np.exp(belief - np.logaddexp(belief[:, :1], belief[:, 1:]))
        top = pair.max(axis=(1, 2), keepdims=True)
        pair = np.exp(pair - top)
        return node, pair / pair.sum(axis=(1, 2), keepdims=True)


class Model:
    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, tie: np.ndarray) -> None:
        self.vocabulary, self.weights, self.tie = vocabulary, weights, tie

    def save(self, path: str) -> None:
        """Writes the model as an ``.npz`` file, so that a fit can be kept between sessions."""
        np.savez_compressed(path, names=np.array(list(self.vocabulary)), weights=self.weights, tie=self.tie)

    @classmethod
    def load(cls, path: str) -> Model:
        with np.load(path) as f:
            return cls({str(n): k for k, n in enumerate(f["names"])}, f["weights"], f["tie"])

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [Page(html or "") for html in pages]
        forest = Forest(parsed, self.vocabulary)
        content = forest.marginals(self.weights, self.tie)[0][:, 1] > 0.5
        out = []
        for page, base in zip(parsed, forest.bounds, strict=False):
            blocks: dict[int, list[str]] = {}
            for block, node, raw in page.pieces:
                if content[base + node]:
                    blocks.setdefault(block, []).append(raw)
            lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
            out.append("\n".join(x for x in lines if x))
        return out


def fit(pages: list[tuple[str, list[int]]], rounds: int = 600, rate: float = 3.0, decay: float = 1e-5) -> Model:
    """Maximum-likelihood weights from labelled pages: html, and the label of each element in order."""
    vocabulary: dict[str, int] = {}
    parsed = [Page(html) for html, _ in pages]
    labels = np.concatenate([np.array([0, *marks]) for _, marks in pages])
    on = Counter(name for page in parsed for name in {x for f in page.features for x in f})
    vocabulary[UNKNOWN] = 0
    # features of text are added to a page when it joins a forest, so they are taken as they come
    forest = Forest(parsed, vocabulary, frozenset(n for n, k in on.items() if k >= MIN_PAGES or not n.startswith("name=")) | TEXT_FEATURES)
    assert len(labels) == len(forest.parent), "labels and nodes differ"
    weights, tie = np.zeros(len(vocabulary)), np.zeros((2, 2))
    child = forest.parent >= 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[forest.parent[child]], labels[child]), 1)
    step_w, step_t = np.zeros_like(weights), np.zeros_like(tie)
    uses = np.bincount(forest.index, minlength=len(weights))
    for _ in range(rounds):
        node, pair = forest.marginals(weights, tie)
        grad = np.bincount(forest.index, weights=(labels - node[:, 1])[forest.owner], minlength=len(weights)) / np.sqrt(uses + 1.0) - decay * uses * weights
        grad_t = (seen - pair[child].sum(axis=0)) / np.sqrt(child.sum())
        step_w, step_t = 0.9 * step_w + grad, 0.9 * step_t + grad_t
        weights = weights + rate * 0.1 * step_w / np.sqrt(len(parsed))
        tie = tie + rate * 0.1 * step_t / np.sqrt(len(parsed))
    return Model(vocabulary, weights, tie)


@lru_cache(maxsize=1)
def default_model(n_pages: int = 800, seed: int = 11) -> Model:
    """The model of the built-in labelled pages; their number is the bound of the training sample."""
    return fit(labelled_pages(n_pages, seed))


def extract_main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """All rows of ``pages(page_id, url, html)`` as page_id, url, text."""
    found = model or default_model()
    parts = (found.vocabulary, found.weights, found.tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*parts)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = own.texts(batch.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    own = narrow(pages, "page_id", "url", "html").withColumn("html", F.col("html").cast("string"))
    return own.mapInArrow(run, own.withColumnRenamed("html", "text").schema)
