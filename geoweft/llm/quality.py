"""Quality rules by cross-document line frequency.

Lines are normalised (words in lower case) and hashed; for each host (the ``source`` of a document) the
distinct documents that hold a line are counted.  Lines in more documents than the limits allow are
boilerplate and are removed; a document that fails the base rules, or that has too little left, is
rejected.

A document is told by its id, host and text: a repeated row is the same document and counts once, a copy
under another id counts as one more.  Edge cases: a null text has no words and fails the base rules; a
null source is a host of its own; empty lines are never counted; very long texts and lines are counted
whole; a line at a limit stays; an empty table gives an empty result; other columns are matched by place and
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .store import materialize, narrow, placed

# Fixed values of the base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

#: A line is boilerplate of a host if more documents than both of these hold it, or more than ALWAYS, however large the host.
MAX_DOCS, MAX_SHARE, ALWAYS = 20, 0.01, 1000
_KEY = ["doc_id", "host", "text_hash"]
#: A document is depleted if less than this share of its words, or fewer than MIN_WORDS, are left.
MIN_LEFT = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = "doc_id long, source string, text_hash long, " + ", ".join(f"{c} long" for c in _BASE) + ", line_hash array<long>, line_words array<int>"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def line_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of the \n-split lines of all rows (a row has one at least), and their row."""
    breaks = np.flatnonzero(raw == 10)
    row = np.searchsorted(bounds, breaks, "right") - 1
    start = np.concatenate([bounds[:-1], breaks + 1])
    end = np.concatenate([bounds[1:], breaks])
    rows = np.concatenate([np.arange(len(bounds) - 1), row])
    order = np.lexsort((start, rows))
    return start[order], np.sort(end[np.lexsort((end, np.concatenate([np.arange(len(bounds) - 1), row])))]), rows[order]


class LineKit:
    """Words, lines and their hashes of one Arrow batch of texts."""

    def __init__(self, hasher: bk.Hasher, sequences: bk.SequenceHasher, column) -> None:
        self.raw, self.bounds = bk.utf8(column)
        self.start, self.end, self.word_bounds = bk.runs(self.raw, self.bounds, bk.SOLID)
        self.line_start, self.line_end, self.line_row = line_bounds(self.raw, self.bounds)
        self.first_word = np.searchsorted(self.start, self.line_start)
        self.last_word = np.searchsorted(self.start, self.line_end)
        self.lower = bk.word_hashes(bk.LOWER[self.raw], self.start, self.end, hasher)
        self.line_hash = sequences.of_ranges(self.lower, self.first_word, self.last_word)
        self.line_words = self.last_word - self.first_word


def features(docs: DataFrame) -> DataFrame:
    """Base counts of all documents, and each one's distinct lines: hash and number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sequences = bk.Hasher(), bk.SequenceHasher()
        for batch in bk.slices(batches, "text"):
            kit = LineKit(hasher, sequences, batch.column("text"))
            raw, bounds, wb = kit.raw, kit.bounds, kit.word_bounds
            n = len(bounds) - 1
            row_of_word = np.repeat(np.arange(n), np.diff(wb))
            lead = (raw & 0xC0) != 0x80
            chars = bk.range_sums(lead, kit.start, kit.end)
            words = bk.word_hashes(raw, kit.start, kit.end, hasher)
            grams = bk.ngram_hashes(words, WINDOW)
            own = row_of_word[: len(grams)] == row_of_word[WINDOW - 1 :] if len(grams) else np.zeros(0, bool)
            salted = bk.mix(grams ^ bk.mix(row_of_word[: len(grams)].astype(np.uint64)))
            twice = np.zeros(len(grams), dtype=bool)
            twice[own] = _repeated(salted[own])
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, np.flatnonzero(twice), 1)
            np.add.at(cover, np.flatnonzero(twice) + WINDOW, -1)
            repeated = np.cumsum(cover)[:-1] > 0
            with_word = kit.line_words > 0
            rows = kit.line_row[with_word]
            whole = bk.word_hashes(raw, kit.line_start[with_word], kit.line_end[with_word], hasher)
            exact = bk.mix(whole ^ bk.mix(rows.astype(np.uint64)))
            n_distinct = np.bincount(rows[np.unique(exact, return_index=True)[1]], minlength=n)
            normal = kit.line_hash[with_word]
            key = bk.mix(normal ^ bk.mix(rows.astype(np.uint64)))
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            total = np.bincount(inverse, weights=kit.line_words[with_word], minlength=len(first)).astype(np.int64)
            order = np.lexsort((first, rows[first]))
            first, total = first[order], total[order]
            counts = np.bincount(rows[first], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("source"), batch.column("text_hash"),
                    pa.array(np.diff(wb)),
                    pa.array(bk.range_sums(chars, wb[:-1], wb[1:])),
                    pa.array(bk.range_sums(_SYMBOL[raw], bounds[:-1], bounds[1:])),
                    pa.array(np.bincount(rows, minlength=n) - n_distinct),
                    pa.array(bk.range_sums(repeated, wb[:-1], wb[1:])),
                    _lists(normal[first].view(np.int64), counts, pa.int64()),
                    _lists(total.astype(np.int32), counts, pa.int32()),
                ],
                names=["doc_id", "source", "text_hash", *_BASE, "line_hash", "line_words"],
            )

    own = narrow(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"), "text")
    return own.mapInArrow(bk.tidy(run), FEATURES)


def _null_safe(keys: list[str]) -> Column:
    """Equality of columns with those of the same names behind a _."""
    return reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys))


def frequent_lines(found: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, always: int = ALWAYS) -> DataFrame:
    """(host, line, n_docs) above the limits.  Counts are summed before the shuffle, so a hot line is cheap.

    Rows are counted; where rows are repeated, what they count too often is taken off again.
    """
    found = found.withColumn("host", F.coalesce("source", F.lit("\x00")))
    lines = found.select("host", F.explode("line_hash").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    hosts = found.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    repeated = materialize(found.groupBy(*_KEY).agg((F.count(F.lit(1)) - 1).alias("extra")).filter("extra > 0").select(*(F.col(c).alias(f"_{c}") for c in _KEY), "extra"), "repeated")
    if not repeated.isEmpty():
        once = found.select(*_KEY, "line_hash").join(repeated, _null_safe(_KEY)).select(*_KEY, "line_hash", "extra").dropDuplicates(_KEY)
        off = once.select(F.col("host").alias("_h"), F.explode("line_hash").alias("_l"), "extra").groupBy("_h", "_l").agg(F.sum("extra").alias("extra"))
        lines = lines.join(off, (F.col("host") == F.col("_h")) & (F.col("line") == F.col("_l")), "left").select("host", "line", (F.col("n_docs") - F.coalesce("extra", F.lit(0))).alias("n_docs"))
        off = repeated.groupBy("_host").agg(F.sum("extra").alias("extra"))
        hosts = hosts.join(off, F.col("host") == F.col("_host"), "left").select("host", (F.col("host_docs") - F.coalesce("extra", F.lit(0))).alias("host_docs"))
    lines = lines.filter(F.col("n_docs") > max_docs)
    above = (F.col("n_docs") > max_share * F.col("host_docs")) | (F.col("n_docs") > always)
    return lines.join(hosts, "host").filter(above).select("host", "line", "n_docs")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(found: DataFrame, frequent: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """Verdicts of all documents: the base columns, removed lines (their hashes), kept_words and kept.

    Documents are told apart by (doc_id, source, text_hash); equal rows get equal verdicts.
    """
    key = _KEY
    found = found.withColumn("host", F.coalesce("source", F.lit("\x00")))
    lines = found.select(*key, F.explode(F.arrays_zip("line_hash", "line_words")).alias("l")).distinct()
    lines = lines.select(*key, F.col("l.line_hash").alias("line"), F.col("l.line_words").alias("words"))
    hit = lines.join(frequent.select("host", "line"), ["host", "line"]).groupBy(*key).agg(
        F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines")
    )
    hit = hit.select(*(F.col(c).alias(f"_{c}") for c in key), "removed_words", "removed_lines")
    out = found.join(hit, _null_safe(key), "left").select(
        "doc_id", "source", "text_hash", *_BASE, base_failed().alias("base_failed"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "removed_lines",
    )
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words")))


def quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, always: int = ALWAYS) -> DataFrame:
    """Verdicts of all documents; see ``judge``."""
    found = materialize(features(docs), "quality")
    return judge(found, frequent_lines(found, max_docs, max_share, always), min_left)


def drop_lines(docs: DataFrame, text: str, gone: str) -> DataFrame:
    """``docs`` with the lines whose hashes ``gone`` lists taken out of ``text``; the column ``gone`` goes."""
    kept = [c for c in docs.columns if c != gone]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sequences = bk.Hasher(), bk.SequenceHasher()
        for batch in bk.slices(batches, text):
            kit = LineKit(hasher, sequences, batch.column(text))
            texts, lists = batch.column(text).to_pylist(), batch.column(gone).to_pylist()
            at = np.searchsorted(kit.line_row, np.arange(len(texts) + 1))
            hashes = kit.line_hash.view(np.int64)
            for i, hidden in enumerate(lists):
                if hidden:
                    out = np.isin(hashes[at[i] : at[i + 1]], np.array(hidden, np.int64)) & (kit.line_words[at[i] : at[i + 1]] > 0)
                    texts[i] = "\n".join(line for line, x in zip(texts[i].split("\n"), out, strict=True) if not x)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in kept], names=kept)

    return docs.mapInArrow(bk.tidy(run), docs.select(*kept).schema)


def filter_documents(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; all columns stay."""
    verdict = quality(docs, **limits).filter("kept").select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("text_hash").alias("_h"), F.col("removed_lines").alias("_removed")
    )
    verdict = verdict.dropDuplicates(["_d", "_s", "_h"])
    inner, at = placed(docs)
    hashed = inner.withColumn("_t", F.xxhash64(at["text"]))
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_d")) & F.col(at["source"]).eqNullSafe(F.col("_s")) & (F.col("_t") == F.col("_h"))
    # a stored side lets adaptive execution split repeated rows on the other
    joined = hashed.join(materialize(verdict, "verdict"), same).drop("_d", "_s", "_h", "_t")
    return drop_lines(joined, at["text"], "_removed").toDF(*docs.columns)
