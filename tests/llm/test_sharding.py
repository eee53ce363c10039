import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from geoweft.llm import sharding


def test_places(docs, corpus):
    rows = sharding.shard_documents(docs, 4, n_slots=256).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    loads = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(loads) - min(loads) < 500
    assert {(r.law, r.grown_shard, r.map_version) for r in rows} == {("bytes", None, 1)}


def brute(rows, n_shards, n_slots):
    """Sorted (doc_id, size, crc, shard, slot): hash, fold and ranks in plain Python."""
    sized, seen, load = [], Counter(), Counter()
    for i, t in rows:
        data = (t or "").encode()
        key = (i, len(data) + 1, zlib.crc32(data))
        seen[key] += 1
        h = 42
        for v in (i, key[2], seen[key]):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h) if v is not None else h
        slot = (h - (1 << 64) if h >> 63 else h) % n_slots
        sized.append((*key, seen[key], slot))
        load[slot] += key[1]
    shards, at, total = [0] * n_shards, {}, sum(load.values())
    for slot in sorted(range(n_slots), key=lambda s: (-load[s], s)):
        own = slot % n_shards
        at[slot] = own if (shards[own] + load[slot]) * n_shards <= total else shards.index(min(shards))
        shards[at[slot]] += load[slot]
    places, out = Counter(), []
    for i, size, crc, _, slot in sorted(sized, key=lambda r: (r[4], r[0] is not None, r[0] or 0, r[2], r[3])):
        out.append((i, size, crc, at[slot], places[at[slot]]))
        places[at[slot]] += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n_shards", "n_slots", "copies"), [(4, 64, 4096), (16, 8192, 3)])
def test_against_brute_force(spark, monkeypatch, corpus, n_shards, n_slots, copies):
    monkeypatch.setattr(sharding, "COPIES", copies)
    rows = [(i, t) for i, t, _ in corpus] + [(5, "hot row")] * 50 + [(None, "hot row")] * 7 + [(None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.shard_documents(docs, n_shards, n_slots).collect()]
    assert sorted(got, key=repr) == brute(rows, n_shards, n_slots)


def test_a_version_is_written_once(spark, tmp_path):
    sharding.store_map(sharding.initial_map(spark, 2, 8), str(tmp_path / "m"), 0)
    with pytest.raises(AnalysisException):
        sharding.store_map(sharding.initial_map(spark, 2, 8), str(tmp_path / "m"))


def test_equal_rows_spread(spark):
    docs = spark.range(1).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("x")).drop("x")
    loads = [r["count"] for r in sharding.shard_documents(docs, 8).groupBy("shard").count().collect()]
    assert len(loads) == 8 and max(loads) - min(loads) <= 1


def test_map_versions(spark, tmp_path):
    folder = str(tmp_path / "map")
    table = sharding.store_map(sharding.initial_map(spark, 4, 64), folder)
    load = spark.range(64).select(F.col("id").cast("int").alias("virtual_slot"), F.when(F.col("id") % 4 == 0, 30).otherwise(10).cast("long").alias("bytes"))
    table = sharding.store_map(sharding.rebalance(sharding.latest(table), load, 4), folder)
    assert table.groupBy("version").count().orderBy("version").collect() == [(0, 64), (1, 64)]
    loads = {r.shard: r.b for r in sharding.latest(table).join(load, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()}
    assert set(loads.values()) == {240}
    grown = sharding.latest(sharding.store_map(sharding.rebalance(sharding.latest(table), load, 5), folder))
    loads = [r.b for r in grown.join(load, "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert len(loads) == 5 and max(loads) - min(loads) <= 30
    kept = grown.alias("n").join(table.filter("version = 1").alias("o"), "virtual_slot").filter("n.shard = o.shard").count()
    assert kept >= 40
