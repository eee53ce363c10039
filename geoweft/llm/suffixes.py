"""Exact removal of long repeated byte strings, and a count of long repeated word sequences, by sorting suffixes.

Every byte that is covered by a string of ``length`` bytes that also starts anywhere else goes.  A passage
of many short words can be shorter than that, so the words that are covered by a sequence of
``passage`` words (A-Z in lower case) that also starts anywhere else are counted too, in the same way
with word hashes in the place of bytes; they are reported, not removed.  Both kinds of symbols go
through the same tables, told apart by ``unit``.  The
suffixes of a corpus are as many as its symbols, so suffixes are taken at *anchors*: of each window of
``length`` symbols, the place of its least ``gram``-symbol hash.  The choice depends on the window's symbols
alone, so two equal windows have anchors at the same distance from their starts, and comparing anchored
suffixes (with what stands to their left) finds every repeated window.

1. Anchors, each with the range of windows it serves (its context), are counted by gram hash; most are
   alone and done.  Contexts that are equal as a whole are repeated as a whole: copies end here.
2. One context of each kind left is fetched.  Sampled splitters range-partition the anchored suffixes
   by their leading symbols; each bucket is sorted by multikey quicksort, and neighbours' common prefixes
   with hashes of the left contexts give the repeated windows.
3. A bucket's first and last group of suffixes may go on in the next bucket, and a hot group fills many
   buckets: their distinct windows are compared across boundaries by hash, packed by hash range.
4. Repeated windows go back to the documents as byte ranges.

Edge cases: null texts are empty; documents shorter than ``length`` bytes lose nothing; very long texts
are taken piece by piece and keep their windows across pieces; repeated rows are copies of each other, and
of equal strings all go (there is no first one, so no tie to break); an empty table gives an empty result;
results depend on the text alone, so ids may be null or repeated; columns besides doc_id and text are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .decontaminate import merged
from .jaccard import _grouped
from .quality import _repeated
from .store import discard, materialize, narrow

LENGTH, GRAM = 400, 128
#: Words of a repeated passage.
PASSAGE = 50
#: Windows handled at once, and contexts of a bucket.
STEP, BUCKET = 1 << 17, 8_000

#: Rows of a partition of the sort that are compared whole.
SMALL = 48

_ANCHORS = "text_hash long, n_bytes long, key long, context long, unit byte, first int, anchor int, size int"
BYTES, WORDS = 0, 1


@dataclass(frozen=True)
class Unit:
    """One kind of symbols: windows of ``length`` of them, anchored by grams of ``gram``."""

    number: int
    length: int
    gram: int

    @property
    def symbol(self) -> np.dtype:
        return np.dtype(np.uint8 if self.number == BYTES else np.uint64)

    @property
    def lead(self) -> int:
        """Symbols in eight bytes."""
        return 8 // self.symbol.itemsize

    def hasher(self) -> bk.Hasher:
        return bk.Hasher() if self.number == BYTES else bk.SequenceHasher()

    def symbols(self, column) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a string column, and the bounds of its rows."""
        raw, bounds = bk.utf8(column)
        if self.number == BYTES:
            return raw, bounds
        raw = bk.LOWER[raw]
        start, end, bounds = bk.runs(raw, bounds, bk.SOLID)
        return bk.word_hashes(raw, start, end, bk.Hasher()), bounds

    def least_bytes(self) -> int:
        """Bytes of the shortest text that has a window."""
        return self.length if self.number == BYTES else 2 * self.length - 1

    def salt(self, keys: np.ndarray) -> np.ndarray:
        """Hashes that are never equal to another unit's (but for collisions)."""
        return keys if self.number == BYTES else bk.mix(keys ^ np.uint64(self.number))


def units(length: int, gram: int, passage: int) -> list[Unit]:
    return [Unit(BYTES, length, gram), Unit(WORDS, passage, -(-passage // 5))]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its least value, the leftmost of equal ones."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full((-len(values)) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    at = np.arange(padded.size).reshape(padded.shape)
    ahead = np.minimum.accumulate(padded, axis=1)
    fresh = np.ones(padded.shape, dtype=bool)
    fresh[:, 1:] = ahead[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, at, 0), axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]
    behind_at = np.minimum.accumulate(np.where(padded == behind, at, padded.size)[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = behind_at[:n], ahead_at[width - 1 : width - 1 + n]
    flat = padded.ravel()
    return np.where(flat[left] <= flat[right], left, right)


def _anchors(kinds: list[Unit]):
    def rows(unit: Unit, hasher: bk.Hasher, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        length, gram = unit.length, unit.gram
        raw, bounds = unit.symbols(batch.column("text"))
        for begin in range(0, max(0, len(raw) - length + 1), STEP):
            piece = raw[begin : begin + STEP + length - 1]
            prefix = hasher.prefix(piece)
            n = len(piece) - length + 1
            places = np.arange(len(piece))
            at = places[: len(piece) - gram + 1]
            grams = hasher.of(prefix, at, at + gram)
            anchor = window_minima(grams, length - gram + 1)
            row = np.searchsorted(bounds, begin + places[:n], "right") - 1
            whole = begin + places[:n] + length <= bounds[row + 1]
            new = np.ones(n, dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], n) - 1
            keep = whole[first]
            first, last = first[keep], last[keep]
            own, spot = row[first], anchor[first]
            end = last + length
            context = bk.mix(hasher.of(prefix, first, end) ^ bk.mix((spot - first).astype(np.uint64)))
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_hash").take(take), batch.column("n_bytes").take(take),
                    pa.array(unit.salt(grams[spot]).view(np.int64)), pa.array(unit.salt(context).view(np.int64)), pa.array(np.full(len(own), unit.number, np.int8)),
                    pa.array((begin + first - bounds[own]).astype(np.int32)), pa.array((spot - first).astype(np.int32)), pa.array((end - first).astype(np.int32)),
                ],
                names=[c.split()[0] for c in _ANCHORS.split(", ")],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = [u.hasher() for u in kinds]
        for batch in bk.slices(batches, "text"):
            for unit, hasher in zip(kinds, hashers, strict=True):
                yield from rows(unit, hasher, batch)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without a task's later copies of a text, so that copies do not meet in one task after the shuffle."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for key in zip(batch.column("text_hash").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True):
            new.append(key not in seen)
            seen.add(key)
        yield batch.filter(pa.array(new, pa.bool_()))


_CONTEXTS = "unit byte, lead0 long, lead1 long, key long, context long, anchor int, symbols binary"


def _contexts(kinds: list[Unit]):
    """The symbols of the wanted contexts, with the gram's leading ones in order-keeping integers."""

    def lead(unit: Unit, head: np.ndarray) -> list[int]:
        head = head[: 2 * unit.lead]
        if unit.number == WORDS:
            return [int(x) - (1 << 63) for x in head[:2]] + [-(1 << 63)] * (2 - len(head))
        head = head.tobytes().ljust(16, b"\0")
        return [int.from_bytes(head[k : k + 8], "big") - (1 << 63) for k in (0, 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _CONTEXTS.split(", ")]
        for batch in bk.slices(batches, "text"):
            out: dict[str, list] = {c: [] for c in names}
            held = {u.number: (u, *u.symbols(batch.column("text"))) for u in kinds}
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    unit, symbols, bounds = held[w["unit"]]
                    a = bounds[i] + w["first"]
                    piece = symbols[a : a + w["size"]]
                    head = piece[w["anchor"] : w["anchor"] + unit.gram]
                    for c, v in zip(names, (unit.number, *lead(unit, head), w["key"], w["context"], w["anchor"], piece.tobytes()), strict=True):
                        out[c].append(v)
            types = [pa.int8()] + [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=names)

    return run


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned words: three-way partitions by one word at a time, small ones by whole rows."""
    order, stack, width = np.arange(len(words)), [(0, len(words), 0)], 8 * words.shape[1]
    data = words.astype(">u8").tobytes()
    while stack:
        a, b, depth = stack.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        part = order[a:b]
        if b - a < SMALL:
            order[a:b] = sorted(part.tolist(), key=lambda i: data[i * width : (i + 1) * width])
            continue
        column = words[part, depth]
        pivot = np.partition(column, (b - a) // 2)[(b - a) // 2]
        less, equal = column < pivot, column == pivot
        n_less, n_equal = int(less.sum()), int(equal.sum())
        order[a:b] = np.concatenate([part[less], part[equal], part[~less & ~equal]])
        stack += [(a, a + n_less, depth), (a + n_less, a + n_less + n_equal, depth + 1), (a + n_less + n_equal, b, depth)]
    return order


_WINDOW = np.dtype([("hash", "<u8"), ("key", "<i8"), ("context", "<i8"), ("a", "<i4")])


def _sorted_windows(unit: Unit, raw, bounds, spot, anchor, served, inner, hasher, prefix, hits) -> None:
    """Adds to ``hits`` the windows of the contexts ``inner`` that another of them holds.

    The suffixes at the anchors are sorted; windows that begin s symbols before the anchor are equal where
    neighbours share length - s symbols and the s symbols to the left have equal hashes.
    """
    length = unit.length
    width = -(-length // unit.lead) * unit.lead
    right = np.zeros((len(inner), width), unit.symbol)
    for k, i in enumerate(inner.tolist()):
        piece = raw[spot[i] : min(bounds[i + 1], spot[i] + width)]
        right[k, : len(piece)] = piece
    order = multikey_quicksort(right.view(">u8").astype(np.uint64) if unit.number == BYTES else right)
    right, inner = right[order], inner[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    nearest = np.maximum(np.append(common, 0), np.append(0, common))
    # the values of s at which a context has a window and shares enough with a neighbour
    least, most = np.maximum(length - nearest, anchor[inner] - served[inner] + 1), np.minimum(anchor[inner], length - unit.gram)
    for s in range(length - unit.gram + 1):
        has = np.flatnonzero((least <= s) & (s <= most))
        if len(has) < 2:
            continue
        group = np.concatenate([[0], np.cumsum(common < length - s)])
        who = inner[has]
        left = hasher.of(prefix, spot[who] - s, spot[who])
        who = who[_repeated(bk.mix(left ^ bk.mix(group[has].astype(np.uint64))))]
        hits.append((who, anchor[who] - s))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of edge groups that several buckets hold, given back to their buckets."""
    for _, sent in _grouped(batches, "dest"):
        windows = [np.frombuffer(r["packed"], _WINDOW) for r in sent]
        found = _repeated(np.concatenate(windows)["hash"])
        buckets, packed, at = [], [], 0
        for r, w in zip(sent, windows, strict=True):
            hit = w[found[at : at + len(w)] & (w["a"] >= 0)]
            at += len(w)
            if len(hit):
                buckets.append(r["bucket"])
                packed.append(hit.tobytes())
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def _runs(owner: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (owner, first place) as merged ranges: owner, first place, end."""
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return owner[first], at[first], at[last] + length


def _ranges(kinds: list[Unit]):
    """Windows of a bucket as ranges of contexts; a bucket's number is doubled to hold the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, got in _grouped(batches, "bucket"):
            length = kinds[int(bucket) & 1].length
            w = np.concatenate([np.frombuffer(r["packed"], _WINDOW) for r in got])
            w = w[np.lexsort((w["a"], w["context"], w["key"]))]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w["key"][1:] != w["key"][:-1]) | (w["context"][1:] != w["context"][:-1]) | (w["a"][1:] > w["a"][:-1] + length)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(w)) - 1
            columns = [pa.array(w["key"][first]), pa.array(w["context"][first]), pa.array(w["a"][first]), pa.array(w["a"][last] + np.int32(length))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "context", "a", "b"])

    return run


_SORTED = "key long, context long, a int, b int, dest long, bucket long, packed binary"


def _bucket(kinds: list[Unit], bits: int):
    """Repeated windows inside a bucket as ranges of contexts; packed window hashes of the edge groups."""

    def rows(**columns) -> pa.RecordBatch:
        fields = [c.split() for c in _SORTED.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        n = max(map(len, columns.values()))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), types[t]) for c, t in fields], names=[c for c, _ in fields])

    def one(unit: Unit, table: pa.Table, hasher: bk.Hasher) -> Iterator[pa.RecordBatch]:
        length = unit.length
        key, context = (table.column(c).to_numpy() for c in ("key", "context"))
        _, once = np.unique(bk.mix(key.view(np.uint64) ^ bk.mix(context.view(np.uint64))), return_index=True)
        table = table.take(pa.array(once))
        key, context, anchor = key[once], context[once], table.column("anchor").to_numpy().astype(np.int64)
        raw, bounds = bk.utf8(table.column("symbols"))
        raw, bounds = np.ascontiguousarray(raw).view(unit.symbol), bounds // unit.symbol.itemsize
        start = bounds[:-1]
        served = np.diff(bounds) - length + 1
        spot = start + anchor
        prefix = hasher.prefix(raw)
        ends = np.lexsort((key, table.column("lead1").to_numpy(), table.column("lead0").to_numpy()))[[0, -1]]
        edge = np.isin(key, key[ends])
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        who = np.flatnonzero(edge)
        owner = np.repeat(who, served[who])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(served[who]) - served[who], served[who])
        at = start[owner] + offset
        window = bk.mix(hasher.of(prefix, at, at + length) ^ bk.mix(key[owner].view(np.uint64)))
        twice = _repeated(window)
        hits.append((owner[twice], offset[twice]))
        _, once, count = np.unique(window, return_index=True, return_counts=True)
        sent = np.empty(len(once), _WINDOW)
        sent["hash"], sent["key"], sent["context"], sent["a"] = window[once], key[owner[once]], context[owner[once]], np.where(count > 1, -1, offset[once])
        cuts = np.searchsorted(sent["hash"], np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        packed = [(k, x.tobytes()) for k, x in enumerate(np.split(sent, cuts)) if len(x)]
        bucket = 2 * TaskContext.get().partitionId() + unit.number
        yield rows(dest=[k for k, _ in packed], bucket=[bucket] * len(packed), packed=[x for _, x in packed])
        inner = np.flatnonzero(~edge)
        if len(inner):
            _sorted_windows(unit, raw, bounds, spot, anchor, served, inner, hasher, prefix, hits)
        i, at = (np.concatenate(x) for x in zip(*hits, strict=True))
        if len(i):
            i, a, b = _runs(i, at, length)
            yield rows(key=key[i], context=context[i], a=a.astype(np.int32), b=b.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for x in batches if x.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        number = table.column("unit").to_numpy()
        for unit in kinds:
            if (own := np.flatnonzero(number == unit.number)).size:
                yield from one(unit, table.take(pa.array(own)), unit.hasher())

    return run


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> DataFrame:
    """(text_hash, n_bytes, ranges): the repeated ranges of bytes (unit 0) and of words (unit 1), of the texts that have any."""
    spark, kinds = docs.sparkSession, units(length, gram, passage)
    least = min(u.least_bytes() for u in kinds)
    texts = narrow(docs, "text").select(F.xxhash64("text").alias("text_hash"), F.octet_length("text").cast("long").alias("n_bytes"), "text").filter(F.col("n_bytes") >= least)
    anchors = materialize(texts.mapInArrow(bk.tidy(_anchors(kinds)), _ANCHORS), "anchors")
    # columns of fixed width keep this a hash aggregate; all of a group's first values come from one row
    place = ["text_hash", "n_bytes", "unit", "first", "anchor", "size"]
    same = anchors.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in place))
    keys = same.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).filter("total > 1")
    same = materialize(same.join(keys, "key"), "contexts")
    whole = same.filter("n > 1").select("key", "context", F.lit(0).alias("a"), F.col("size").alias("b"))
    mixed = same.filter("kinds > 1")
    wanted = mixed.select("text_hash", "n_bytes", F.struct("unit", "first", "size", "anchor", "key", "context").alias("w")).groupBy("text_hash", "n_bytes").agg(F.collect_list("w").alias("wanted"))
    # a stored side lets adaptive execution split the copies of one text on the other
    wanted = materialize(wanted, "wanted")
    fetched = texts.mapInArrow(_once, texts.schema).join(wanted, ["text_hash", "n_bytes"]).select("text", "wanted")
    suffixes = materialize(fetched.mapInArrow(bk.tidy(_contexts(kinds)), _CONTEXTS), "suffixes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), suffixes.count() // BUCKET + 1)
    bits = max(4, buckets.bit_length() - 1)
    dealt = suffixes.repartitionByRange(buckets, "unit", "lead0", "lead1", "key", "context")
    sorted_ = materialize(dealt.mapInArrow(bk.tidy(_bucket(kinds, bits)), _SORTED), "windows")
    for done in (wanted, suffixes):
        discard(done)
    inside = sorted_.filter("dest IS NULL").select("key", "context", "a", "b")
    sent = sorted_.filter("dest IS NOT NULL").select("dest", "bucket", "packed").repartition(buckets, "dest").sortWithinPartitions("dest")
    met = sent.mapInArrow(_meet, "bucket long, packed binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    across = met.mapInArrow(_ranges(kinds), "key long, context long, a int, b int")
    found = whole.unionByName(inside).unionByName(across)
    spans = anchors.join(found, ["key", "context"]).select("text_hash", "n_bytes", F.struct("unit", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b")).alias("r"))
    ranges = materialize(spans.groupBy("text_hash", "n_bytes").agg(F.collect_set("r").alias("ranges")), "ranges")
    for done in (anchors, same, sorted_):
        discard(done)
    return ranges


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            of = {u: merged([(r["a"], r["b"]) for r in ranges or () if r["unit"] == u]) for u in (BYTES, WORDS)}
            data, at, kept = (text or "").encode(), 0, []
            for a, b in of[BYTES]:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]])
            for col, v in zip(out, (len(data), len(data) - len(left), len(of[BYTES]), sum(b - a for a, b in of[WORDS]), left), strict=True):
                col.append(v)
        columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "n_passage_words", "kept"])


def dedup_suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> DataFrame:
    """All rows: doc_id, n_bytes, n_removed, n_spans, n_passage_words and ``kept``, the bytes left (a cut may split a character).

    ``n_passage_words`` counts the words covered by a sequence of ``passage`` words that also starts anywhere else.
    """
    ranges = repeated_ranges(docs, length, gram, passage).select(F.col("text_hash").alias("_h"), F.col("n_bytes").alias("_n"), "ranges")
    texts = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_t"), F.octet_length("text").cast("long").alias("_b"))
    joined = texts.join(ranges, (F.col("_t") == F.col("_h")) & (F.col("_b") == F.col("_n")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(bk.tidy(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, n_passage_words long, kept binary")
