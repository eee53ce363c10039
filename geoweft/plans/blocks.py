"""Blocks: an index whose cells hold equal counts, over clouds and primitives of any density.

Rows are dealt out by sample and Morton code, and each partition is cut by medians along its widest axis
into blocks of at most so many rows; a block is one packed row with its box.  Dense places get small boxes
and empty ones large boxes, so skewed clouds need no other plan.  The size of a block grows with the input
once there are MAX_BLOCKS, and samples that are no larger than a block are not indexed but met whole, so
the table of boxes, which goes to every task, is bounded for any number of rows and of samples.

A search is routed by boxes (two levels of them), meets the nearest block first and then only those blocks
whose box is nearer than what it has found.  A block that many searches meet is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.index import morton_encode
from ..storage import materialize

#: Rows of a block at least, blocks at most, rows that one task packs, and blocks under an upper box.
BLOCK_ROWS, MAX_BLOCKS, PARTITION_ROWS, UPPER = 1024, 100_000, 1_000_000, 64
#: Searches that meet a block in one task.
SEARCHES = 65_536
#: Searches routed at once.
STEP = 512

#: The results of searches (a table) among rows with these ids and coordinates.
Search = Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table]


def kd_order(centre: np.ndarray, size: int) -> tuple[np.ndarray, list[int]]:
    """Rows cut by medians along the widest axis: their order and the first place of each cell of at most ``size``."""
    order, stack, starts = np.arange(len(centre)), [(0, len(centre))], []
    while stack:
        a, b = stack.pop()
        if b - a <= size:
            starts.append(a)
            continue
        part = order[a:b]
        own = centre[part]
        middle = (b - a) // 2
        order[a:b] = part[np.argpartition(own[:, int(np.argmax(own.max(axis=0) - own.min(axis=0)))], middle)]
        stack += [(a + middle, b), (a, a + middle)]
    return order, starts


def boxes_of(values: np.ndarray, dims: int, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of the vertices of each cell; a row is its vertices one after another."""
    vertices = values.reshape(len(values), -1, dims)
    return np.minimum.reduceat(vertices.min(axis=1), starts), np.maximum.reduceat(vertices.max(axis=1), starts)


def build(rows: DataFrame, key: str, vertices: Sequence[Sequence[str]], n_rows: int) -> DataFrame:
    """(b, block, n, lo, hi, ids, coordinates): ``rows(b, key, vertices…)`` packed into blocks, as a stored table."""
    spark, names = rows.sparkSession, [c for v in vertices for c in v]
    dims = len(vertices[0])
    size = least_rows(n_rows)
    parts = max(-(-n_rows // PARTITION_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // (8 * size) + 1))
    own = rows.select("b", F.col(key).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(names)))
    centres = {a: sum((F.col(f"v{v * dims + k}") for v in range(1, len(vertices))), F.col(f"v{k}")) / F.lit(float(len(vertices))) for k, a in enumerate("xyz"[:dims])}
    dealt = morton_encode(own.withColumns(centres)).select("b", "code", "id", *(f"v{k}" for k in range(len(names)))).repartitionByRange(parts, "b", "code", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for x in batches if x.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by("b").combine_chunks()
        samples = table.column("b").chunk(0)
        sample = samples.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        values = np.stack([table.column(f"v{k}").to_numpy() for k in range(len(names))], axis=1)
        centre = values.reshape(len(values), -1, dims).mean(axis=1)
        edges = [0, *(np.flatnonzero(np.diff(sample)) + 1).tolist(), len(sample)]
        number = TaskContext.get().partitionId() << 32
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            order, starts = kd_order(centre[a:b], size)
            held, named = values[a:b][order], ids[a:b][order]
            lo, hi = boxes_of(held, dims, starts)
            ends = [*starts[1:], b - a]
            yield pa.RecordBatch.from_arrays(
                [
                    samples.take(pa.array([a] * len(starts))),
                    pa.array(np.arange(number, number + len(starts))), pa.array(np.array(ends) - starts, pa.int64()),
                    pa.array([x.tobytes() for x in lo], pa.binary()), pa.array([x.tobytes() for x in hi], pa.binary()),
                    pa.array([named[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([held[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                ],
                names=["b", "block", "n", "lo", "hi", "ids", "coordinates"],
            )
            number += len(starts)

    kind = rows.schema["b"].dataType.simpleString()
    return materialize(dealt.mapInArrow(run, f"b {kind}, block long, n long, lo binary, hi binary, ids binary, coordinates binary"), "blocks")


def least_rows(n_rows: int) -> int:
    """Rows of a block at least.  Fewer than MAX_BLOCKS samples can be larger than that."""
    return max(BLOCK_ROWS, n_rows // MAX_BLOCKS)


def by_size(rows: DataFrame, n_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of samples that are larger than a block, and those of the others; None where there are none."""
    sizes = rows.groupBy("b").agg((F.count(F.lit(1)) > least_rows(n_rows)).alias("large"))
    found = sizes.agg(F.max("large").alias("some"), F.min("large").alias("all")).first()
    if found["some"] is None or found["some"] == found["all"]:
        return (rows, None) if found["some"] else (None, rows)
    large = materialize(sizes.filter("large").select("b"), "large-samples")
    return rows.join(F.broadcast(large), "b"), rows.join(F.broadcast(large), "b", "left_anti")


def by_sample(asked: DataFrame, rows: DataFrame, key: str, vertices: Sequence[Sequence[str]], keys: Sequence[str], search: Search, schema: str) -> DataFrame:
    """The results of ``search`` for whole samples, each of which is dealt to as many tasks as its searches need."""
    names = [c for v in vertices for c in v]
    # both tables may come from one, so their columns get names of their own here
    mine = rows.select(F.col("b").alias("_s"), F.col(key).cast("long").alias("id"), *(F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(names)))
    loads = asked.groupBy(F.col("b").alias("_l")).agg(F.ceil(F.count(F.lit(1)) / SEARCHES).cast("int").alias("salts"))
    loads = loads.join(mine.select(F.col("_s").alias("_m")).distinct(), F.col("_l") == F.col("_m")).select("_l", "salts")
    left = asked.join(loads, F.col("b") == F.col("_l")).withColumn("salt", F.pmod(F.xxhash64(*keys), F.col("salts")).cast("int")).drop("salts")
    right = mine.join(loads, F.col("_s") == F.col("_l")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts", "_l")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        coordinates = np.stack([held.column(f"v{k}").to_numpy() for k in range(len(names))], axis=1)
        return search(asked, held.column("id").to_numpy(), coordinates)

    return left.groupBy("_l", "salt").cogroup(right.groupBy("_s", "salt")).applyInArrow(run, schema)


class Boxes:
    """The boxes of one sample's blocks, and boxes around runs of them."""

    def __init__(self, block: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.block, self.n, self.lo, self.hi, self.run = block, n, lo, hi, UPPER
        starts = np.arange(0, len(block), self.run)
        self.upper_n, self.upper_lo, self.upper_hi = np.add.reduceat(n, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)

    def under(self, asked: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of searches and upper boxes as pairs of searches and blocks."""
        first = upper * self.run
        count = np.minimum(first + self.run, len(self.block)) - first
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(asked, count), np.repeat(first, count) + within


def boxes(blocks: DataFrame) -> dict[object, Boxes]:
    """The boxes of each sample; at most about MAX_BLOCKS rows in all."""
    found: dict[object, list] = {}
    for r in blocks.select("b", "block", "n", "lo", "hi").orderBy("block").collect():
        found.setdefault(r["b"], []).append(r)
    return {b: Boxes(np.array([r["block"] for r in own]), np.array([r["n"] for r in own]), *(np.stack([np.frombuffer(r[c]) for r in own]) for c in ("lo", "hi"))) for b, own in found.items()}


#: Of searches (rows of coordinates) in a sample's boxes: search, block and order value of all blocks it may need.
Route = Callable[[np.ndarray, Boxes], tuple[np.ndarray, np.ndarray, np.ndarray]]


def routed(asked: DataFrame, names: Sequence[str], sent: Broadcast, route: Route) -> DataFrame:
    """``asked`` once for each block it may need, with ``block``, ``near`` (the route's value) and ``turn`` (0 for the least), as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members: dict[object, list[int]] = {}
            for i, b in enumerate(batch.column("b").to_pylist()):
                members.setdefault(b, []).append(i)
            at = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in names], axis=1)
            for b, own in members.items():
                if b not in sent.value:
                    continue
                for k in range(0, len(own), STEP):
                    rows = np.array(own[k : k + STEP])
                    search, block, near = route(at[rows], sent.value[b])
                    order = np.lexsort((block, near, search))
                    search, block, near = search[order], block[order], near[order]
                    turn = np.arange(len(search)) - np.searchsorted(search, search)
                    take = pa.array(rows[search])
                    columns = [batch.column(c).take(take) for c in batch.schema.names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(sent.value[b].block[block]), pa.array(near), pa.array(turn.astype(np.int32))], names=[*batch.schema.names, "block", "near", "turn"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return materialize(asked.mapInArrow(run, f"{kinds}, block long, near double, turn int"), "routes")


def searched(pairs: DataFrame, blocks: DataFrame, keys: Sequence[str], search: Search, schema: str) -> DataFrame:
    """The results of ``search(searches, ids, coordinates)`` for each block and the searches that meet it."""
    loads = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / SEARCHES).cast("int").alias("salts"))
    left = pairs.join(F.broadcast(loads), "block").withColumn("salt", F.pmod(F.xxhash64(*keys), F.col("salts")).cast("int")).drop("salts")
    right = blocks.select("block", "ids", "coordinates").join(F.broadcast(loads), "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids = np.frombuffer(held.column("ids")[0].as_py(), np.int64)
        return search(asked, ids, np.frombuffer(held.column("coordinates")[0].as_py()).reshape(len(ids), -1))

    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(run, schema)
