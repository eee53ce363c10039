"""Line dedup by a deletion-neighbourhood join.

Lines are sequences of words in lower case.  A line goes if an earlier line (by document id, then line
number) is within one word edit of it: equal, one word replaced, added or left out.  Two such lines
have a deletion variant in common, which is a hashed key of the join:

* a replaced word: both lines without the word at the same place, so (place, variant) is the key and
  all lines of a key are within the bound of each other;
* an added word: the longer line without it is the shorter line.

Each key needs only its earliest line, so keys are aggregated, and no pairs are emitted.  Everything
after the first aggregate works on distinct lines, so a line that a third of all documents hold is one
row there.  Before the variants are made, lines that share no intact half with another line are left
out: one edit leaves one of the halves of the common variant intact in both lines.

Lines of fewer than ``min_words`` words have no variants: they go only if they equal an earlier line.

Edge cases: lines without words stay; null and empty texts have no lines; very long lines have a variant
for each word, made in slices of words; rows without id come last; of repeated rows none is earlier, so
they are treated alike; ties do not arise otherwise, since (id, line number) is a total order; an empty
table gives an empty result; other columns are matched by place and pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .quality import LineKit
from .store import discard, materialize, narrow, placed

#: Shorter lines have too little in common for one edit to mean anything (one word of five is a fifth), so only equal ones count.
MIN_WORDS = 5
LAST = (1 << 63) - 1

_HALVES = ["h0", "h1", "h2", "h3"]
_LINES = "doc_id long, text_hash long, line_no int, n_words int, line long, " + ", ".join(f"{h} long" for h in _HALVES)


def _tagged(hashes: np.ndarray, tag: np.ndarray, kind: int) -> np.ndarray:
    return bk.mix(hashes ^ bk.mix(tag.astype(np.uint64) * np.uint64(4) + np.uint64(kind)))


def _line_table(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sequences = bk.Hasher(), bk.SequenceHasher()
        for batch in bk.slices(batches, "text"):
            kit = LineKit(hasher, sequences, batch.column("text"))
            row, first, last, m = kit.line_row, kit.first_word, kit.last_word, kit.line_words
            number = np.arange(len(row)) - np.searchsorted(row, row)
            keep = m > 0
            row, first, last, m, number = row[keep], first[keep], last[keep], m[keep], number[keep]
            halves = np.empty((len(m), 4), np.uint64)
            for k, size in enumerate((m, m - 1)):
                p = size // 2
                halves[:, 2 * k] = _tagged(sequences.of_ranges(kit.lower, first, first + p), size, 0)
                halves[:, 2 * k + 1] = _tagged(sequences.of_ranges(kit.lower, last - (size - p), last), size, 1)
            short, at = m < min_words, pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(number.astype(np.int32)), pa.array(m.astype(np.int32)),
                    pa.array(kit.line_hash[keep].view(np.int64)), *(pa.array(halves[:, k].copy().view(np.int64), mask=short) for k in range(4)),
                ],
                names=[c.split()[0] for c in _LINES.split(", ")],
            )

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the lines whose numbers ``wanted`` lists."""
    hasher, sequences = bk.Hasher(), bk.SequenceHasher()
    for batch in bk.slices(batches, "text"):
        kit = LineKit(hasher, sequences, batch.column("text"))
        start = np.searchsorted(kit.line_row, np.arange(batch.num_rows))
        wanted = batch.column("wanted").to_pylist()
        picked = np.concatenate([start[i] + np.array(sorted(w), np.int64) for i, w in enumerate(wanted)])
        rows = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
        a, b = kit.first_word[picked], kit.last_word[picked]
        offsets = np.zeros(len(picked) + 1, np.int64)
        np.cumsum(b - a, out=offsets[1:])
        at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - a, b - a)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kit.line_hash[picked].view(np.int64)), batch.column("rank").take(pa.array(rows)), pa.array((picked - start[rows]).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(kit.lower[at].view(np.int64))),
            ],
            names=["line", "rank", "line_no", "words"],
        )


#: Kinds of keys: a place and a variant; a variant; a whole line.
PLACE, SHORTER, WHOLE = 0, 1, 2


_KEYS = "key long, kind byte, line long, rank long, line_no int"


def _variants(place_keys: bool):
    """The keys of each candidate line: its places and variants, or its variants and itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = bk.SequenceHasher()
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                words = batch.column("words")
                offsets = words.offsets.to_numpy().astype(np.int64)
                symbols = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
                start, end = offsets[:-1], offsets[1:]
                m = end - start
                owner = np.repeat(np.arange(len(m)), m)
                place = np.arange(offsets[0], offsets[-1]) - start[owner]
                if place_keys:
                    # a variant is the hash of what stands before the place and of what stands after it
                    before = sequences.of_ranges(symbols, start[owner], start[owner] + place)
                    after = sequences.of_ranges(symbols, start[owner] + place + 1, end[owner])
                    key = bk.mix(before + bk.mix(after ^ bk.mix(place.astype(np.uint64) * np.uint64(65537) + m[owner].astype(np.uint64))))
                    rows, kind = owner, np.full(len(owner), PLACE, np.int8)
                else:
                    shorter = _tagged(_without(sequences, symbols, start, end, owner, place), m[owner] - 1, 2)
                    itself = _tagged(_without(sequences, symbols, start, end, np.arange(len(m)), None), m, 2)
                    key, rows = np.concatenate([shorter, itself]), np.concatenate([owner, np.arange(len(m))])
                    kind = np.repeat(np.array([SHORTER, WHOLE], np.int8), [len(owner), len(m)])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(kind), *(batch.column(c).take(take) for c in ("line", "rank", "line_no"))], names=[c.split()[0] for c in _KEYS.split(", ")])

    return run


def _without(sequences: bk.SequenceHasher, symbols, start, end, owner, place) -> np.ndarray:
    """Hashes of lines without the word at a place (None: whole lines): the polynomial closes the gap."""
    sequences._grow(len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(symbols * sequences.power[: len(symbols)], out=prefix[1:])
        a, b = start[owner], end[owner]
        if place is None:
            return bk.mix((prefix[b] - prefix[a]) * sequences.inverse[a])
        gap = a + place
        closed = (prefix[gap] - prefix[a]) + (prefix[b] - prefix[gap + 1]) * sequences.inverse[1]
        return bk.mix(closed * sequences.inverse[a])


def within_one_edit(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """For each pair of sequences (values and bounds) whether one replaced, added or missing element at most tells them apart."""
    n, m = np.diff(a_at), np.diff(b_at)
    least = np.minimum(n, m)
    owner = np.repeat(np.arange(len(n)), least)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(least) - least, least)

    def agreeing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the run of equal elements from the start of each pair."""
        first = least.copy()
        unequal = np.flatnonzero(a[i] != b[j])
        np.minimum.at(first, owner[unequal], place[unequal])
        return first

    front = agreeing(a_at[:-1][owner] + place, b_at[:-1][owner] + place)
    back = agreeing(a_at[1:][owner] - 1 - place, b_at[1:][owner] - 1 - place)
    return (np.abs(n - m) <= 1) & (front + back >= np.maximum(n, m) - 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [(batch.column(c).values.to_numpy(zero_copy_only=False), batch.column(c).offsets.to_numpy().astype(np.int64)) for c in ("words", "other_words")]
        keep = batch.filter(pa.array(within_one_edit(*sides[0], *sides[1]), pa.bool_()))
        yield pa.RecordBatch.from_arrays([keep.column(c) for c in ("line", "near_rank", "near_line_no")], names=["line", "near_rank", "near_line_no"])


def duplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines that go: doc_id, text_hash, line_no, n_words, edits, and the earliest line within the bound."""
    return _duplicates(docs, min_words)[0]


def _duplicates(docs: DataFrame, min_words: int) -> tuple[DataFrame, list[DataFrame]]:
    """The lines that go, and the tables that they are read from."""
    texts = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rank = F.coalesce("doc_id", F.lit(LAST))
    stored = materialize(texts.mapInArrow(bk.tidy(_line_table(min_words)), _LINES), "lines")
    lines = stored.withColumn("rank", rank)
    firsts = materialize(lines.groupBy("line").agg(F.min(F.struct("rank", "line_no", "text_hash")).alias("first"), *(F.max(h).alias(h) for h in _HALVES)), "distinct-lines")
    halves = firsts.select(F.explode(F.array(*_HALVES)).alias("half"), "line").filter("half IS NOT NULL")
    # stored sides (here and below) let adaptive execution split a hot half, variant or line on the other; they are
    # merged at every size, since a broadcast that small inputs get would hide what large ones shuffle
    met = materialize(halves.groupBy("half").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b").select("half"), "shared-halves")
    candidates = halves.join(met.hint("merge"), "half").select("line").distinct()
    # each step from here is a job of its own, so that the shuffles of all halves, texts and keys are never there at once
    wanted = candidates.join(firsts, "line").groupBy(F.col("first.rank").alias("rank"), F.col("first.text_hash").alias("text_hash")).agg(F.collect_set("first.line_no").alias("wanted"))
    wanted = materialize(wanted, "wanted-lines")
    found = texts.withColumn("rank", rank).select("rank", "text_hash", "text").join(wanted.hint("merge"), ["rank", "text_hash"])
    known = materialize(found.mapInArrow(bk.tidy(_words), "line long, rank long, line_no int, words array<long>").dropDuplicates(["line"]), "line-words")
    at = F.struct("rank", "line_no", "line")
    place = known.mapInArrow(bk.tidy(_variants(True)), _KEYS).drop("kind")
    same = materialize(place.groupBy("key").agg(F.min(at).alias("least"), F.max(at).alias("most")).filter("least <> most").select("key", "least"), "shared-variants")
    replaced = materialize(place.join(same.hint("merge"), "key").filter(F.col("least") < at).groupBy("line").agg(F.min("least").alias("near")), "replaced-words")
    short = known.mapInArrow(bk.tidy(_variants(False)), _KEYS)
    sides = short.groupBy("key").agg(F.min(F.when(F.col("kind") == SHORTER, at)).alias("longer"), F.min(F.when(F.col("kind") == WHOLE, at)).alias("whole"))
    sides = materialize(sides.filter("longer IS NOT NULL AND whole IS NOT NULL"), "shorter-lines")
    other = F.when(F.col("kind") == SHORTER, F.col("whole")).otherwise(F.col("longer"))
    moved = materialize(short.join(sides.hint("merge"), "key").filter(other < at).groupBy("line").agg(F.min(other).alias("near")), "added-words")
    near = replaced.unionByName(moved).groupBy("line").agg(F.min("near").alias("near"))
    pairs = near.join(known.select("line", "words"), "line").select("line", "words", "near").join(
        known.select(F.col("line").alias("_line"), F.col("words").alias("other_words")), F.col("near.line") == F.col("_line")
    )
    pairs = pairs.select("line", "words", "other_words", F.col("near.rank").alias("near_rank"), F.col("near.line_no").alias("near_line_no"))
    good = pairs.mapInArrow(_verified, "line long, near_rank long, near_line_no int")
    best = firsts.join(good, "line", "left").select("line", F.col("first.rank").alias("f_rank"), F.col("first.line_no").alias("f_line"), "near_rank", "near_line_no")
    best = materialize(best, "best")
    for done in (firsts, wanted, known, met, same, replaced, sides, moved):
        discard(done)
    out = lines.join(best.hint("merge"), "line").withColumn("later", F.struct("rank", "line_no") > F.struct(F.col("f_rank").alias("rank"), F.col("f_line").alias("line_no")))
    out = out.filter("later OR near_rank IS NOT NULL")
    to_id = lambda c: F.when(F.col(c) != LAST, F.col(c))
    earlier = "near_rank IS NOT NULL"
    out = out.select(
        "doc_id", "text_hash", "line_no", "n_words", F.expr(f"IF({earlier}, 1, 0)").alias("edits"),
        F.when(F.expr(earlier), to_id("near_rank")).otherwise(to_id("f_rank")).alias("first_doc_id"),
        F.expr(f"IF({earlier}, near_line_no, f_line)").alias("first_line_no"),
    )
    return out, [stored, best]


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the duplicate lines; all columns stay, and so do documents that lose all lines."""
    found, tables = _duplicates(docs, min_words)
    gone = materialize(found.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_set("line_no").alias("_gone")), "gone")
    for done in tables:
        discard(done)
    inner, at = placed(docs)
    hashed = inner.withColumn("_t", F.xxhash64(at["text"]))
    joined = hashed.join(gone.hint("merge"), F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left").drop("_d", "_h", "_t")
    names, text = inner.columns, at["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bk.slices(batches, text):
            texts = batch.column(text).to_pylist()
            for i, lost in enumerate(batch.column("_gone").to_pylist()):
                if lost:
                    lost = set(lost)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in lost)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return joined.mapInArrow(bk.tidy(run), inner.schema).toDF(*docs.columns)
