"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items go into one suffix automaton.  Training words are streamed through
it; the state and the matched length say, at each word, the longest run of words ending there that
some item holds.  A run of ``window`` words (or a whole shorter item) is an occurrence; its words are
hit.

An automaton is built from a block of items of bounded size, so that it fits a worker; an item larger than
that is cut into pieces that overlap by a window less one word, which loses no window.  A benchmark of one
block is one pass over the rows without a shuffle.  More blocks are as many passes, one after the other: only
one block is sent to the executors at a time, and its hits are stored before the next one is.  Words that no
item holds reset the automaton, so stretches whose word pairs are in no item are skipped by a vectorised test
before the automaton runs.

Edge cases: null or empty texts and items have no words and match nothing; very long texts are streamed in
whole; items with equal ids count once, a null id is written as the empty string; a window that several items
hold counts for each; repeated rows are scanned each; an empty benchmark leaves all documents clean; columns
besides doc_id and text are not read, or pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .store import discard, materialize, narrow, placed

WINDOW = 8
#: Words of benchmark items in one automaton; what is sent to the executors is bounded by it.
BLOCK_WORDS = 200_000
#: Hit spans of so many words are removed; a document of which more than this share is hit is dropped.
MAX_SPAN, MAX_COVERAGE = 8, 0.5

#: A worker keeps one automaton.
_CACHE: dict[str, "Automaton"] = {}


def words_of(text: str | None) -> list[bytes]:
    raw = bk.LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    start, end, _ = bk.runs(raw, np.array([0, len(raw)]), bk.ALNUM)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Automaton:
    """Suffix automaton of several word sequences; windows and items are looked up by its states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items = [name for name, _ in items]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in coded:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.next]
        whole: dict[int, list[int]] = {}
        for k, sequence in enumerate(coded):
            if 0 < len(sequence) < window:
                whole.setdefault(self._state(sequence), []).append(k)
        self.gram = [0] * len(self.next)
        for s in order:
            up = self.link[s]
            self.gram[s] = s if self.length[s] >= window > self.length[up] else self.gram[up]
            self.short[s] = self.short[up] + [(len(coded[k]), k) for k in whole.get(s, ())]
        self.holders: dict[int, set[int]] = {}
        for k, sequence in enumerate(coded):
            s = 0
            for i, symbol in enumerate(sequence):
                s = self.next[s][symbol]
                if i >= window - 1:
                    self.holders.setdefault(self.gram[s], set()).add(k)
        self.least = min([len(x) for x in coded if x], default=window)
        hashes = lambda seqs, n: np.unique(np.concatenate([np.zeros(0, np.uint64), *(bk.ngram_hashes(self._hash(x), n) for x in seqs)]))
        plain = [words for _, words in items]
        self.pair = 2 if self.least >= 2 else 1
        self.pairs = hashes(plain, self.pair)

    @staticmethod
    def _hash(words: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
        end = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
        return bk.word_hashes(raw, end - np.array([len(w) for w in words], np.int64), end, bk.Hasher()) if words else np.zeros(0, np.uint64)

    def _state(self, sequence: list[int]) -> int:
        s = 0
        for symbol in sequence:
            s = self.next[s][symbol]
        return s

    def _clone(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, p: int, symbol: int, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(symbol) == old:
            self.next[p][symbol] = new
            p = self.link[p]

    def _extend(self, last: int, symbol: int) -> int:
        known = self.next[last].get(symbol)
        if known is not None:  # the sequence so far is in the automaton already
            if self.length[known] == self.length[last] + 1:
                return known
            clone = self._clone(known, self.length[last] + 1)
            self.link[known] = clone
            self._redirect(last, symbol, known, clone)
            return clone
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, p = len(self.next) - 1, last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.length[q] != self.length[p] + 1:
                clone = self._clone(q, self.length[p] + 1)
                self._redirect(p, symbol, q, clone)
                self.link[q] = clone
                q = clone
            self.link[new] = q
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Occurrences (first word, end) in a run of words, and the items that have them."""
        spans, items, s, matched = [], set(), 0, 0
        nexts, link, length, window = self.next, self.link, self.length, self.window
        for i, word in enumerate(words):
            symbol = self.vocabulary.get(word)
            if symbol is None:
                s = matched = 0
                continue
            while s and symbol not in nexts[s]:
                s = link[s]
                matched = length[s]
            if symbol in nexts[s]:
                s = nexts[s][symbol]
                matched += 1
            else:
                matched = 0
            if matched >= window:
                spans.append((i + 1 - window, i + 1))
                items |= self.holders[self.gram[s]]
            for n, k in self.short[s]:
                if n <= matched:
                    spans.append((i + 1 - n, i + 1))
                    items.add(k)
        return spans, items

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(first word, end) of stretches all of whose word pairs some item holds."""
        n = self.pair
        inside = np.zeros(len(hashes) + 1, dtype=bool)
        if len(hashes) >= n and len(self.pairs):
            grams = bk.ngram_hashes(hashes, n)
            at = np.minimum(np.searchsorted(self.pairs, grams), len(self.pairs) - 1)
            inside[: len(grams)] = self.pairs[at] == grams
            for k in range(1, n):
                edge = bounds[1:-1] - k
                inside[edge[edge >= 0]] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        # for single words a stretch must not run over the end of its document
        starts, ends = edges[0::2], edges[1::2] + n - 1
        if n == 1 and len(starts):
            cuts = bounds[1:-1]
            starts = np.union1d(starts, cuts[inside[np.minimum(cuts, len(inside) - 1)]])
            ends = np.union1d(ends, cuts[(cuts > 0) & inside[np.maximum(cuts - 1, 0)]])
        keep = ends - starts >= min(self.window, self.least)
        return np.stack([starts[keep], ends[keep]], axis=1)


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> list[DataFrame]:
    """The items, cut into pieces of at most ``block_words`` words, in blocks of about that many."""
    most = max(block_words, 2 * window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                out += [(name, b" ".join(words[a : a + most]).decode()) for a in range(0, max(1, len(words) - window + 1), most - window + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(2)], names=["item_id", "text"])

    items = narrow(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(F.col("text").isNotNull())
    items = materialize(items.mapInArrow(run, "item_id string, text string"), "items")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = total // (4 * block_words) + 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


SPANS = "array<struct<a:int,b:int>>"
FOUND = f"doc_id long, text_hash long, n_words long, hit_spans {SPANS}, hit_items array<string>"


def _keyed(docs: DataFrame) -> DataFrame:
    return narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _scanned(rows: DataFrame, one: tuple) -> DataFrame:
    """The hits of one block in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, hits in _hits(batches, "text", one):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array([h[0] for h in hits], pa.int64()),
                    _ranges([h[1] for h in hits]), pa.array([h[2] for h in hits], pa.list_(pa.string())),
                ],
                names=["doc_id", "text_hash", "n_words", "hit_spans", "hit_items"],
            )

    return rows.mapInArrow(bk.tidy(run), FOUND)


def _ranges(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in own] for own in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits of several blocks as one."""
    for batch in batches:
        spans = [merged([(x["a"], x["b"]) for x in own]) for own in batch.column("hit_spans").to_pylist()]
        items = [sorted(set(own)) for own in batch.column("hit_items").to_pylist()]
        new = {"hit_spans": _ranges(spans), "hit_items": pa.array(items, pa.list_(pa.string()))}
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)


def _over_blocks(rows: DataFrame, blocks: list[DataFrame], window: int) -> DataFrame:
    """The hits of all texts, from a pass over the rows for each block; the first pass keeps every text's n_words."""
    parts = []
    for block in blocks:
        one = _sent(block, window)
        found = _scanned(rows, one)
        parts.append(materialize((found.filter("size(hit_spans) > 0") if parts else found).dropDuplicates(["doc_id", "text_hash"]), "hits"))
        one[0].destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = every.groupBy("doc_id", "text_hash").agg(F.first("n_words").alias("n_words"), flat("hit_spans"), flat("hit_items"))
    found = materialize(found.mapInArrow(bk.tidy(_merged), FOUND), "hits")
    for part in parts:
        discard(part)
    return found


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows: doc_id, n_words, ``hit_spans`` (merged word ranges) and ``hit_items``."""
    rows, blocks = _keyed(docs), _blocks(benchmark, window, block_words)
    if len(blocks) == 1:
        return _scanned(rows, _sent(blocks[0], window)).drop("text_hash")
    found = _over_blocks(rows, blocks, window).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), "n_words", "hit_spans", "hit_items")
    return rows.drop("text").join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))).select("doc_id", "n_words", "hit_spans", "hit_items")


def _sent(block: DataFrame, window: int) -> tuple:
    """(broadcast items, cache key, window) of a block of the benchmark."""
    return block.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.toLocalIterator()]), uuid.uuid4().hex, window


def _automaton(items, key: str, window: int) -> Automaton:
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = Automaton([(name, words_of(text)) for name, text in items.value], window)
    return _CACHE[key]


def _hits(batches: Iterator[pa.RecordBatch], text: str, one: tuple) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list, list]]]]:
    """Batches with each row's number of words, merged hit ranges and items."""
    hasher = bk.Hasher()
    for batch in bk.slices(batches, text):
        raw, bounds = bk.utf8(batch.column(text))
        raw = bk.LOWER[raw]
        start, end, wb = bk.runs(raw, bounds, bk.ALNUM)
        hashes = bk.word_hashes(raw, start, end, hasher)
        touched: dict[int, tuple[list, set]] = {}
        automaton = _automaton(*one)
        for a, b in automaton.candidates(hashes, wb).tolist():
            found, which = automaton.stream([raw[i:j].tobytes() for i, j in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])
            if found:
                row = int(np.searchsorted(wb, a, "right")) - 1
                at = a - int(wb[row])
                own = touched.setdefault(row, ([], set()))
                own[0].extend((at + x, at + y) for x, y in found)
                own[1].update(automaton.items[k] for k in which)
        rows = [(n, [], []) for n in np.diff(wb).tolist()]
        for row, (found, which) in touched.items():
            rows[row] = (rows[row][0], merged(found), sorted(which))
        yield batch, rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without ranges of its words and the separators up to the next word."""
    data = text.encode()
    raw = bk.LOWER[np.frombuffer(data, dtype=np.uint8)]
    start, _, _ = bk.runs(raw, np.array([0, len(raw)]), bk.ALNUM)
    edge = np.append(start, len(data))
    out, place = [], 0
    for a, b in spans:
        out.append(data[place : edge[a]])
        place = int(edge[b])
    return b"".join([*out, data[place:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, max_span: int = MAX_SPAN, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents without their contaminated spans; all columns stay.

    A hit span of ``max_span`` words or more (a whole item, if that is shorter) is cut out of the text with
    the separators up to the next word; a document of which more than ``max_coverage`` is hit goes.
    """
    inner, at = placed(docs)
    names, text = inner.columns, at["text"]
    blocks = _blocks(benchmark, max_span, block_words)
    known = len(blocks) > 1
    rows, one = inner, None if known else _sent(blocks[0], max_span)
    if known:
        found = _over_blocks(_keyed(docs), blocks, max_span).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), F.col("n_words").alias("_n"), F.col("hit_spans").alias("_s"))
        same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_h"))
        rows = inner.join(found, same, "left").drop("_d", "_h")

    def hits(batches):
        if not known:
            yield from _hits(batches, text, one)
            return
        for batch in batches:
            spans = [[(x["a"], x["b"]) for x in own or ()] for own in batch.column("_s").to_pylist()]
            yield batch, [(n or 0, own, []) for n, own in zip(batch.column("_n").to_pylist(), spans, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in hits(batches):
            texts, stays = batch.column(text).to_pylist(), []
            for i, (n, spans, _) in enumerate(found):
                stays.append(sum(b - a for a, b in spans) <= max_coverage * n)
                if spans and stays[-1]:
                    texts[i] = _without(texts[i], spans)
            whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)
            yield whole.filter(pa.array(stays, pa.bool_()))

    return rows.mapInArrow(bk.tidy(run), inner.schema).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of ``scan``'s rows."""
    items = F.array_sort(F.coalesce("hit_items", F.array().cast("array<string>")))
    return found.select(
        "doc_id", "n_words",
        F.coalesce(F.aggregate("hit_spans", F.lit(0), lambda s, x: s + x["b"] - x["a"]), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) >= 2).alias("contaminated"),
    )
