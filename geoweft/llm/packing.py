"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

The rule takes pieces from the longest to the shortest and puts each into the open sequence with the
least room that still fits it.  Pieces of one length are alike, so the rule is run on the histogram of
lengths, which has at most ``window`` entries whatever the input: a segment tree over remaining
capacities finds the tightest open capacity, and a whole run of equal pieces is placed at once.  The
runs then place all pieces by a join on (length, rank).

Edge cases: a null or empty text is the separator alone (one token); a very long text is many pieces;
strings of special tokens in a text become their ids; pieces of one length are ranked by (id, piece, CRC),
so ties are between equal pieces only; repeated rows are packed once each; an empty table gives an empty
result; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import slices, tidy
from .store import materialize, narrow

#: Beyond so many placement runs the join is left to Spark's own choice instead of a broadcast.
MAX_BROADCAST_RUNS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """A function from text to ids for a tokenizer file.

    A ``.json`` file that has its vocabulary as ranks beside it (``.tiktoken``) is run from the ranks:
    the ids are the same (a test holds them against each other) at about four times the speed.  Strings
    of the file's added tokens become those tokens' ids, as the tokenizer file itself has it.
    """
    if path not in _ENCODERS:
        import base64
        import json
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if path.endswith(".json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(path, encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
            table = {k: v for k, v in table.items() if k.decode("utf-8", "replace") not in added}
            ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)
            names = set(added)
            _ENCODERS[path] = lambda text: ranked.encode(text, allowed_special=names) if any(n in text for n in names) else ranked.encode_ordinary(text)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return _ENCODERS[path]


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens; only the first may be shorter."""
    if n <= window:
        return [(0, n)]
    rest = n % window
    return [(0, rest)] * bool(rest) + [(s, window) for s in range(rest, n, window)]


def tokenize(docs: DataFrame, tokenizer: str, window: int, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their ids where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(5 + with_ids)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), 0], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(ids), window)):
                    part = ids[start : start + length]
                    row = [doc_id, k, start, length, zlib.crc32(part.tobytes())]
                    for col, value in zip(out, row + [part.astype(np.int32)] * with_ids, strict=True):
                        col.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(run), PIECES + ", ids array<int>" * with_ids)


class CapacityTree:
    """Segment tree over capacities 0 to ``window``: the least capacity of at least x that has bins."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.any = np.zeros(2 * self.size, dtype=bool)

    def set(self, capacity: int, value: bool) -> None:
        at = capacity + self.size
        self.any[at] = value
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int:
        """-1 if there is none."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_runs(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placement of all pieces: runs (length, first rank, count, pieces a bin, first bin, first offset).

    Equal to taking the pieces one by one: once a bin of the tightest capacity holds a piece, it stays
    the tightest for the next equal piece until no more fits.
    """
    tree, bins, opened, runs = CapacityTree(window), [deque() for _ in range(window + 1)], 0, []

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            bins[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            fresh = room < 0
            if fresh:
                room = window
            each = min(room // length, left)
            if fresh:
                first, n = opened, left // each
                opened += n
            else:
                first, there = bins[room].popleft()
                n = min(there, left // each)
                put(room, first + n, there - n)
                if not bins[room]:
                    tree.set(room, False)
            runs.append((length, rank, n * each, each, first, window - room))
            put(room - each * length, first, n)
            left -= n * each
            rank += n * each
    return runs


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """All pieces with their place: the columns of ``tokenize``, sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, tokenizer, window, with_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit_runs(histogram, window)
    table = spark.createDataFrame(runs, "length long, first_rank long, n long, each long, first_bin long, first_offset long")
    table = F.broadcast(table) if len(runs) <= MAX_BROADCAST_RUNS else table
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("m")).select(
        "length", "salt", F.expr("coalesce(sum(m) OVER (PARTITION BY length ORDER BY salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("base")
    )
    ranked = salted.withColumn("rank", F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY doc_id, piece, ids_crc32) - 1"))
    ranked = ranked.join(base, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(table, (ranked["length"] == table["length"]) & F.expr("rank >= first_rank AND rank < first_rank + n")).drop(table["length"])
    at = F.col("rank") - F.col("first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("first_bin") + F.expr("(rank - first_rank) div each")).alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("each")) * F.col("length")).alias("offset"),
    )
