"""N-gram Jaccard self-join by vertical partitioning.

The n-grams of all documents have one global order, by (document frequency, hash).

1. *Frequencies.*  Documents are taken in chunks; a chunk sends its distinct n-gram hashes, packed, to
   hash ranges, which count documents.  An n-gram that a chunk holds several times is sent once with
   its count, so a hot n-gram costs a row per chunk.  N-grams of one document link nothing; only the
   shared ones come back.
2. *Survivors.*  A document whose shared n-grams are fewer than the threshold's share of its set has no
   link and is done.  Equal sets become one class.
3. *Candidates.*  Linked sets share an n-gram of their prefixes (the rarest n-grams, as many as the
   threshold needs).  The least set of a prefix bucket is its hub; each set first meets the hub that it
   shares most prefix n-grams with, in units of about STAR sets, which is linear in the sets.  The links
   found there settle most buckets: one whose sets are all in one component needs nothing more.
4. *Rest.*  Sets of different components that share a prefix n-gram and can be linked by their sizes are
   tied through their buckets; each component of these ties is cut into blocks of sets by size, and
   blocks whose sizes can link meet in pairs.
5. *Vertical partitioning.*  The global order is cut into fragments.  For each unit (of 3 or 4) and each
   fragment the partial overlaps are counted on their own; they are summed per pair, and compared with
   the threshold.
6. The components of all links are the result.

No pairs are emitted as rows: a unit is one row with a matrix of counts.

Edge cases: null and empty texts have an empty set and no links; a text of fewer words than n is one
n-gram; a very long text is a chunk of its own; repeated rows are equal sets; of equal sizes and
frequencies hashes decide, so there are no ties; null ids never name a component that has another id; an
empty table gives an empty result; columns besides doc_id and text are not read, or pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytekit as bk
from .components import components
from .store import discard, input_bytes, materialize, narrow, placed

#: N-grams and documents of a chunk at most (one longer document is a chunk of its own).
CHUNK_GRAMS, CHUNK_DOCS = 500000, 60_000
#: Input bytes of a hash range; about three times as many n-grams fit as a range has then.
RANGE_BYTES = 6 << 20
#: Ranges up to which a range's bytes stay the same.  Beyond, both the ranges and their bytes grow with the root of the
#: input, since a chunk of n-grams spread over more ranges than it can fill would be sent n-gram by n-gram.
RANGES = 1 << 16
#: N-grams of a range that are counted at once.
SLICE = 1 << 22
#: Sets of a block, of which a pair is compared in one task, and of a unit around a hub.
BLOCK, STAR = 256, 64
#: Document frequencies at which the global order is cut into fragments.
CUTS = (4, 16, 128)
#: Hashes keep their upper 56 bits, so that the packed differences of a chunk need five bytes each.
_DROP = np.uint64(8)
_MANY = 65535

_CHUNK = "chunk long, dest long, hashes binary, ords binary, counts binary, doc_ids binary, has_id binary, sizes binary, signs binary"
_REPLY = "chunk long, hashes binary, ords binary, counts binary, doc_ids binary, has_id binary, sizes binary, signs binary, freq binary"
SETS = "doc_id long, text_hash long, n long, sign1 long, sign2 long, prefix int, tokens array<long>, freqs array<int>"


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte plane by byte plane, without planes of zeros."""
    if not len(sorted_hashes):
        return b"\x00"
    d = np.diff(sorted_hashes, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d[1:].view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + d[:1].tobytes() + planes[:used].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if len(data) < 9:
        return np.zeros(0, np.uint64)
    used, n = data[0], (len(data) - 9) // data[0]
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(data, np.uint8, offset=9).reshape(used, n)
    rest = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(np.concatenate([np.frombuffer(data, np.uint64, 1, 1), rest]), dtype=np.uint64)


def _gram_hashes(column, words: int, hasher: bk.Hasher, sequences: bk.SequenceHasher) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each n-gram of a batch of texts."""
    raw, bounds = bk.utf8(column)
    raw = bk.LOWER[raw]
    start, end, wb = bk.runs(raw, bounds, bk.SOLID)
    hashes = bk.word_hashes(raw, start, end, hasher)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(wb))
    grams = bk.ngram_hashes(hashes, words)
    own = row[: len(grams)] == row[words - 1 :] if len(grams) else np.zeros(0, bool)
    few = np.flatnonzero((np.diff(wb) > 0) & (np.diff(wb) < words))
    whole = bk.mix(sequences.of_ranges(hashes, wb[few], wb[few + 1]) + np.uint64(1))
    return np.concatenate([row[: len(grams)][own], few]), np.concatenate([grams[own], whole])


def _chunks(words: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sequences = bk.Hasher(), bk.SequenceHasher()
        part, number = TaskContext.get().partitionId(), 0
        rows, grams, ids, marks, n_docs, n_grams = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            row, gram, id_ = np.concatenate(rows), np.concatenate(grams) >> _DROP, pa.chunked_array(ids).combine_chunks()
            order = np.lexsort((row, gram)) if len(rows) > 1 else np.argsort(gram, kind="stable")
            row, gram = row[order], gram[order]
            fresh = np.ones(len(gram), dtype=bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            row, gram = row[fresh], gram[fresh]
            sizes = np.bincount(row, minlength=n_docs).astype(np.uint32)
            signs = np.zeros((2, n_docs), np.uint64)
            np.add.at(signs[0], row, bk.mix(gram + np.uint64(11)))
            np.add.at(signs[1], row, bk.mix(gram ^ np.uint64(0xD6E8FEB86659FD93)))
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(gram)))
            distinct, many = gram[first], count > 1
            ords = np.where(many, _MANY, row[first]).astype(np.uint16)
            edge = np.searchsorted(distinct, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(56 - bits))
            edge[-1] = len(distinct)
            chunk = (part << 32) + number
            out = {"chunk": [], "dest": [], "hashes": [], "ords": [], "counts": []}
            for k in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                a, b = edge[k], edge[k + 1]
                for name, value in zip(out, (chunk, k, _pack(distinct[a:b]), ords[a:b].tobytes(), count[a:b][many[a:b]].astype(np.uint32).tobytes()), strict=True):
                    out[name].append(value)
            posting = np.repeat(many, count)
            values = np.stack([id_.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(marks)])
            own = (chunk, -1 - chunk, distinct[many].tobytes(), row[posting].astype(np.uint16).tobytes(), count[many].astype(np.uint32).tobytes())
            for name, value in zip(out, own, strict=True):
                out[name].append(value)
            rest = [None] * (len(out["chunk"]) - 1)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(out["chunk"], pa.int64()), pa.array(out["dest"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("hashes", "ords", "counts")),
                    *(pa.array([*rest, x], pa.binary()) for x in (values.tobytes(), id_.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), sizes.tobytes(), signs.tobytes())),
                ],
                names=[c.split()[0] for c in _CHUNK.split(", ")],
            )

        for batch in bk.slices(batches, "text"):
            for at in range(0, batch.num_rows, CHUNK_DOCS):
                piece = batch.slice(at, CHUNK_DOCS)
                row, gram = _gram_hashes(piece.column("text"), words, hasher, sequences)
                if n_docs and (n_docs + piece.num_rows > CHUNK_DOCS or n_grams + len(gram) > CHUNK_GRAMS):
                    yield flush()
                    number += 1
                    rows, grams, ids, marks, n_docs, n_grams = [], [], [], [], 0, 0
                rows.append(row + n_docs)
                grams.append(gram)
                ids.append(piece.column("doc_id"))
                marks.append(piece.column("text_hash").to_numpy())
                n_docs += piece.num_rows
                n_grams += len(gram)
        if n_docs:
            yield flush()

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches, group by group."""
    now, rows = None, []
    for batch in batches:
        keys, at = batch.column(key).to_numpy(zero_copy_only=False), 0
        for edge in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]:
            if edge == at:
                continue
            if rows and keys[at] != now:
                yield now, rows
                rows = []
            now = keys[at]
            rows.extend(batch.slice(at, edge - at).to_pylist())
            at = edge
    if rows:
        yield now, rows


def _counted(lists: list[np.ndarray], weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each of several sorted lists the summed weights of its hashes over all lists, slice by slice of their range."""
    out = [np.empty(len(h), np.int64) for h in lists]
    n = sum(map(len, lists)) // SLICE + 1
    low, high = (int(f(h[k] for h in lists if len(h))) for f, k in ((min, 0), (max, -1)))
    cuts = [low + (high - low + 1) * k // n for k in range(n)] + [high + 1]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        at = [np.searchsorted(h, np.array([low, high], np.uint64)) for h in lists]
        every, weight = (np.concatenate([x[a:b] for x, (a, b) in zip(of, at, strict=True)]) for of in (lists, weights))
        if not len(every):
            continue
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        freq = np.empty(len(every), np.int64)
        freq[order] = np.add.reduceat(weight[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        done = 0
        for x, (a, b) in zip(out, at, strict=True):
            x[a:b] = freq[done : done + b - a]
            done += b - a
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared n-grams of each chunk in a hash range, with their document frequency."""
    names = [c.split()[0] for c in _REPLY.split(", ")]
    types = [pa.int64()] + [pa.binary()] * (len(names) - 1)
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types, strict=True)], names=names)
    for dest, rows in _grouped(batches, "dest"):
        if dest < 0:
            yield make(rows)
            continue
        lists = [_unpack(r["hashes"]) for r in rows]
        ords = [np.frombuffer(r["ords"], np.uint16) for r in rows]
        weights = []
        for o, r in zip(ords, rows, strict=True):
            w = np.ones(len(o), np.int64)
            w[o == _MANY] = np.frombuffer(r["counts"], np.uint32)
            weights.append(w)
        freqs = _counted(lists, weights)
        out = []
        for r, h, o, f in zip(rows, lists, ords, freqs, strict=True):
            keep = f > 1
            if keep.any():
                out.append({"chunk": r["chunk"], "hashes": _pack(h[keep]), "ords": o[keep].tobytes(), "freq": np.minimum(f[keep], 2**31 - 1).astype(np.int32).tobytes()})
        if out:
            yield make(out)


def _survivors(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "chunk"):
            (own,) = [r for r in rows if r["sizes"] is not None]
            sizes = np.frombuffer(own["sizes"], np.uint32).astype(np.int64)
            n_docs = len(sizes)
            ord_, token, freq, many, many_freq = [], [], [], [], []
            for r in rows:
                if r["sizes"] is None:
                    h, o, f = _unpack(r["hashes"]), np.frombuffer(r["ords"], np.uint16), np.frombuffer(r["freq"], np.int32)
                    one = o != _MANY
                    ord_.append(o[one].astype(np.int64))
                    token.append(h[one])
                    freq.append(f[one])
                    many.append(h[~one])
                    many_freq.append(f[~one])
            many, many_freq = bk.take(many, np.uint64), bk.take(many_freq, np.int32)
            at = np.argsort(many)
            hashes, counts = np.frombuffer(own["hashes"], np.uint64), np.frombuffer(own["counts"], np.uint32)
            assert np.array_equal(many[at], hashes)
            ord_ = np.concatenate([*ord_, np.frombuffer(own["ords"], np.uint16).astype(np.int64)])
            token = np.concatenate([*token, np.repeat(hashes, counts)])
            freq = np.concatenate([*freq, np.repeat(many_freq[at], counts)])
            shared = np.bincount(ord_, minlength=n_docs)
            stays = (sizes > 0) & (100 * shared >= percent * sizes)
            keep = stays[ord_]
            ord_, token, freq = ord_[keep], token[keep], freq[keep]
            order = np.lexsort((token, freq, ord_))
            token, freq = token[order].view(np.int64), freq[order]
            prefix = sizes - (percent * sizes + 99) // 100 + 1 - (sizes - shared)
            signs, ids = (np.frombuffer(own[c], np.int64).reshape(2, n_docs) for c in ("signs", "doc_ids"))
            offsets = np.zeros(n_docs + 1, np.int32)
            np.cumsum(np.where(stays, shared, 0), out=offsets[1:])
            absent = ~stays
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[0], mask=np.frombuffer(own["has_id"], np.uint8) == 0), pa.array(ids[1]),
                    pa.array(sizes), pa.array(signs[0]), pa.array(signs[1]),
                    pa.array(np.where(stays, np.maximum(prefix, 0), 0).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(token), mask=pa.array(absent)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(freq), mask=pa.array(absent)),
                ],
                names=[c.split()[0] for c in SETS.split(", ")],
            )

    return run


def gram_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Set sizes and signatures of all documents; the shared n-grams, in global order, of the survivors."""
    size = input_bytes(docs)
    ranges = size / RANGE_BYTES + 1
    bits = max(4, math.ceil(math.log2(ranges if ranges <= RANGES else math.sqrt(ranges * RANGES))))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)
    texts = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    sent = texts.mapInArrow(bk.tidy(_chunks(words, bits)), _CHUNK).repartition(n, "dest").sortWithinPartitions("dest")
    back = sent.mapInArrow(bk.tidy(_frequencies), _REPLY).repartition(n, "chunk").sortWithinPartitions("chunk")
    return materialize(back.mapInArrow(bk.tidy(_survivors(percent)), SETS), "jaccard-sets")


def _tables(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Groups of sorted batches as tables."""
    now, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if parts and key != now:
                yield pa.Table.from_batches(parts)
                parts = []
            now = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap counts of the sets of a unit, in one fragment of the global order."""
    for group in _tables(batches, "unit", "fragment"):
        n = group.num_rows
        lists = [x for x in group.column("tokens").chunks if len(x)]
        member = np.repeat(np.arange(n), np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]))
        tokens = np.concatenate([x.flatten().to_numpy() for x in lists])
        _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
        both = count[column] > 1
        column = np.unique(column[both], return_inverse=True)[1]
        member = member[both]
        total = np.zeros((n, n), np.float32)
        width, step = int(column.max(initial=-1)) + 1, 4096
        order = np.argsort(column, kind="stable")
        member, column = member[order], column[order]
        for a in range(0, width, step):
            i, j = np.searchsorted(column, (a, a + step))
            bits = np.zeros((n, min(step, width - a)), np.float32)
            bits[member[i:j], column[i:j] - a] = 1
            total += bits @ bits.T
        one = pa.array([0, n], pa.int32())
        cids, sizes = (pa.ListArray.from_arrays(one, pa.concat_arrays(group.column(c).chunks)) for c in ("cid", "n"))
        yield pa.RecordBatch.from_arrays([group.column("unit").chunk(0).slice(0, 1), cids, sizes, pa.array([total.astype(np.uint32).tobytes()], pa.binary())], names=["unit", "cids", "sizes", "overlap"])


def _links(percent: int):
    """Sums the partial overlaps of a unit and ties each linked set to the least set it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "unit"):
            cids, at = np.unique(np.concatenate([np.array(r["cids"], np.int64) for r in rows]), return_index=True)
            size = np.concatenate([np.array(r["sizes"], np.int64) for r in rows])[at]
            total = np.zeros((len(cids), len(cids)), np.int64)
            for r in rows:
                at = np.searchsorted(cids, np.array(r["cids"], np.int64))
                total[np.ix_(at, at)] += np.frombuffer(r["overlap"], np.uint32).reshape(len(at), len(at))
            link = 100 * total >= percent * (size[:, None] + size[None, :] - total)
            np.fill_diagonal(link, True)
            label = np.arange(len(cids))
            while True:
                new = np.where(link, label[None, :], len(cids)).min(axis=1)
                new = new[new]
                if np.array_equal(new, label):
                    break
                label = new
            tied = label != np.arange(len(cids))
            if tied.any():
                yield pa.RecordBatch.from_arrays([pa.array(cids[tied]), pa.array(cids[label[tied]])], names=["a", "b"])

    return run


def _units(members: DataFrame, percent: int) -> DataFrame:
    """(unit, cid, n, tokens, freqs): each set in all the pairs of blocks that it is part of."""
    step = math.log(100 / percent)
    members = members.withColumn("band", F.floor(F.log(F.col("n")) / F.lit(step)).cast("int"))
    bands = members.groupBy("component", "band").agg(F.count(F.lit(1)).alias("m"))
    plan = bands.groupBy("component").agg(
        F.sum("m").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / BLOCK).cast("int")))).alias("blocks")
    )
    rows = members.join(plan, "component").withColumn("i", F.expr("pmod(xxhash64(cid, 'block'), blocks[band])").cast("int"))
    units = F.expr(f"""
      CASE WHEN total <= {BLOCK} THEN array(xxhash64(component)) ELSE concat(
        transform(sequence(0, blocks[band] - 1), j -> xxhash64(component, band, band, least(i, j), greatest(i, j))),
        IF(map_contains_key(blocks, band + 1), transform(sequence(0, blocks[band + 1] - 1), j -> xxhash64(component, band, band + 1, i, j)), cast(array() AS array<bigint>)),
        IF(map_contains_key(blocks, band - 1), transform(sequence(0, blocks[band - 1] - 1), j -> xxhash64(component, band - 1, band, j, i)), cast(array() AS array<bigint>))) END""")
    return rows.select(F.explode(units).alias("unit"), "cid", "n", "tokens", "freqs")


def _fragments(units: DataFrame) -> DataFrame:
    """Cuts each set at the fixed places of the global order."""
    ends = [f"size(filter(freqs, f -> f < {c}))" for c in CUTS] + ["size(freqs)"]
    starts = ["0", *ends[:-1]]
    segments = ", ".join(f"named_struct('fragment', {k}, 'tokens', slice(tokens, {a} + 1, {b} - {a}))" for k, (a, b) in enumerate(zip(starts, ends, strict=True)))
    cut = units.select("unit", "cid", "n", F.expr(f"explode(filter(array({segments}), s -> size(s.tokens) > 0)) AS s"))
    return cut.select("unit", F.col("s.fragment").alias("fragment"), "cid", "n", F.col("s.tokens").alias("tokens"))


def _stars(posts: DataFrame) -> DataFrame:
    """(unit, cid): each set with the hub that it shares most prefix n-grams with, in units of about STAR sets."""
    hubs = posts.groupBy("token").agg(F.min("cid").alias("hub"), F.max("cid").alias("top")).filter("hub <> top")
    shared = posts.join(hubs, "token").filter("cid <> hub").groupBy("cid", "hub").agg(F.count(F.lit(1)).alias("k"))
    best = materialize(shared.groupBy("cid").agg(F.max(F.struct("k", "hub")).alias("best")).select("cid", F.col("best.hub").alias("hub")), "jaccard-hubs")
    loads = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / (STAR - 1)).cast("int").alias("units"))
    own = best.join(loads, "hub").select(F.expr("xxhash64(hub, pmod(xxhash64(cid), units))").alias("unit"), "cid")
    return own.unionByName(loads.select(F.explode(F.expr("transform(sequence(0, units - 1), k -> xxhash64(hub, cast(k AS bigint)))")).alias("unit"), F.col("hub").alias("cid")))


def _linked(units: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (a, b) of ``units(unit, cid, n, tokens, freqs)`` by partial overlaps; each linked set is tied to the least it reaches."""
    cut = _fragments(units).repartition(n, "unit", "fragment").sortWithinPartitions("unit", "fragment")
    partial = cut.mapInArrow(bk.tidy(_partial), "unit long, cids array<long>, sizes array<long>, overlap binary")
    return materialize(partial.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(bk.tidy(_links(percent)), "a long, b long"), "jaccard-links")


def _classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sets`` with the id ``cid`` of their class, and the classes of equal sets.

    A set is told by its size and two 64-bit signatures; should two classes get one id, another salt is taken.
    """
    signs = ["n", "sign1", "sign2"]
    for salt in range(8):
        named = sets.withColumn("cid", F.expr(f"IF(tokens IS NULL, NULL, xxhash64({salt}, sign1, sign2, n))"))
        classes = materialize(
            named.filter("cid IS NOT NULL").groupBy("cid").agg(
                F.min("doc_id").alias("first_doc"), F.first("prefix").alias("prefix"), F.first("tokens").alias("tokens"), F.first("freqs").alias("freqs"),
                *(F.min(c).alias(c) for c in signs), *(F.max(c).alias(f"most_{c}") for c in signs),
            ),
            "jaccard-classes",
        )
        if classes.filter(" OR ".join(f"{c} <> most_{c}" for c in signs)).isEmpty():
            return named, classes
    raise RuntimeError("classes of equal sets cannot be told apart")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, named: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of all rows: documents link whose sets are so similar.

    With ``named`` also ``component``, an id of the component that does not need documents' ids (null for rows
    that can link with nothing).
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets, classes = _classes(gram_sets(docs, words, percent))
    held = classes.select("cid", "n", "tokens", "freqs")
    posts = classes.select("cid", F.explode(F.expr("slice(tokens, 1, prefix)")).alias("token"))
    links = _linked(_stars(posts).join(held, "cid"), percent, n)
    settled = components(links).select(F.col("node").alias("cid"), F.col("component").alias("known"))
    # sets whose sizes can link are in one band or in neighbouring ones, so each posts to its own and to the next
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    open_ = classes.join(settled, "cid", "left").select("cid", F.coalesce("known", "cid").alias("known"), band.alias("own"), F.explode(F.expr("slice(tokens, 1, prefix)")).alias("token"))
    open_ = open_.select("cid", "known", "token", F.explode(F.array("own", F.col("own") + 1)).alias("band"))
    buckets = open_.groupBy("token", "band").agg(F.min("known").alias("least"), F.max("known").alias("most"), F.min("cid").alias("hub")).filter("least <> most")
    ties = open_.join(buckets, ["token", "band"]).filter("cid <> hub").select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    near = components(ties).select(F.col("node").alias("cid"), "component")
    more = _linked(_units(held.join(near, "cid"), percent), percent, n)
    # what is settled is stars already, so only new links between them need rounds
    stars = settled.filter("cid <> known").select(F.col("cid").alias("a"), F.col("known").alias("b"))
    groups = settled.withColumnRenamed("known", "component") if more.isEmpty() else components(stars.unionByName(more)).select(F.col("node").alias("cid"), "component")
    whose = classes.select("cid", "first_doc").join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = whose.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    # a stored side lets adaptive execution split the copies of one set on the other
    whose = materialize(whose.join(least, "component").select("cid", "component", "component_id"), "components")
    for done in (classes, links, more):
        discard(done)
    # sets that can link with nothing have no class, and would all meet in one task of a join
    common = ["doc_id", "text_hash", F.col("n").alias("n_shingles")]
    alone = sets.filter("cid IS NULL").select(*common, F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    out = alone.unionByName(sets.filter("cid IS NOT NULL").join(whose, "cid").select(*common, "component_id", "component"))
    return out if named else out.drop("component")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component; all columns stay.

    The row of the least id stays (rows without id come last), of rows with that id the one of the least text
    hash, and one of equal rows.  Rows that link with nothing all stay.
    """
    found = jaccard_components(docs, words, percent, named=True).filter("component IS NOT NULL")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    keys = found.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).join(first, "component").select(
        F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays"), "copies"
    )
    keys = materialize(keys, "near-duplicates")
    inner, at = placed(docs)
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(at["text"]) == F.col("_h"))
    out = inner.join(keys.filter("NOT stays OR copies > 1"), same, "left_anti")
    repeated = keys.filter("stays AND copies > 1")
    if not repeated.isEmpty():
        # equal rows are cut to one in each task before the shuffle
        out = out.unionByName(inner.join(repeated, same).dropDuplicates(["_d", "_h"]).select(*inner.columns))
    return out.toDF(*docs.columns)
