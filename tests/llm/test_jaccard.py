import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.llm import jaccard
from geoweft.llm.components import components

from .brute import near_groups


def check(spark, pairs, words, percent, parts=3):
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(parts)
    roots, sizes = near_groups(pairs, words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, words, percent).collect()}
    assert got == {i: (sizes[i], roots[i]) for i, _ in pairs}
    return roots


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_corpus(spark, corpus, words, percent):
    roots = check(spark, [(i, t) for i, t, _ in corpus], words, percent)
    assert any(i != r for i, r in roots.items())


def test_near_copies_of_one_text_fill_several_blocks(spark, monkeypatch):
    r = random.Random(1)
    base = [f"w{r.randrange(9999)}" for _ in range(120)]
    pairs = []
    for i in range(90):
        own = base[:]
        for _ in range(r.randint(0, 4)):
            own[r.randrange(120)] = f"x{r.randrange(9999)}"
        pairs.append((i, " ".join(own)))
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "CHUNK_GRAMS", 1500)
    check(spark, pairs, 4, 85)


def test_threshold_is_exact(spark):
    for n in (17, 20, 40):
        a = [f"a{k}" for k in range(n)]
        check(spark, [(0, " ".join(a)), (1, " ".join([*a[:-1], "z"])), (2, " ".join(a[: n * 85 // 100])), (3, " ".join(a[: n * 85 // 100 - 1]))], 1, 85, 1)


def test_packed_hashes():
    import numpy as np

    for n in (0, 1, 2, 1000):
        h = np.sort(np.random.default_rng(n).integers(0, 1 << 56, n).astype(np.uint64))
        assert (jaccard._unpack(jaccard._pack(h)) == h).all()


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    edges = spark.createDataFrame([*path, (100, 102), (101, 102), (102, 100), (200, 200)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0


def test_keep_one(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(5, text, 1), (3, text + " end", 2), (9, "other words stand here now", 3), (None, text, 4), (None, "alone", 5), (3, text + " end", 6)], "doc_id long, text string, Text_Hash int")
    # one row of the group stays, and one of its equal rows
    kept = sorted(r.Text_Hash for r in jaccard.keep_one(docs).collect())
    assert kept in ([2, 3, 5], [3, 5, 6])
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.text for r in jaccard.keep_one(unnamed).collect() if r.text.startswith("w")) in ([text], [text + " end"])


def test_counts_of_slices(monkeypatch):
    """Weights of hashes over several sorted lists, whatever the slices; hashes use all 64 bits."""
    monkeypatch.setattr(jaccard, "SLICE", 7)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 40, dtype=np.uint64)
    lists = [np.unique(rng.choice(pool, n)) for n in (1, 12, 0, 33, 20)]
    weights = [rng.integers(1, 5, len(x)) for x in lists]
    total = {}
    for h, w in zip(lists, weights, strict=True):
        for k, n in zip(h.tolist(), w.tolist(), strict=True):
            total[k] = total.get(k, 0) + n
    got = jaccard._counted(lists, weights)
    assert [g.tolist() for g in got] == [[total[k] for k in h.tolist()] for h in lists]


def test_groups_larger_than_a_unit(spark, monkeypatch):
    """Chains and rings of near copies that meet in many small units, and sets of frequent prefix n-grams that do not link."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "STAR", 3)
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    texts, base = [], [word() for _ in range(60)]
    for _ in range(40):  # each one word from the one before
        base = base[:]
        base[r.randrange(60)] = word()
        texts.append(" ".join(base))
    shared = [word() for _ in range(12)]
    texts += [" ".join(shared + [word() for _ in range(40)]) for _ in range(25)]
    star = [word() for _ in range(50)]
    texts += [" ".join([*star[:k], word(), *star[k + 1 :]]) for k in range(0, 50, 2)]
    docs = list(enumerate(texts))
    want, sizes = near_groups(docs, 5, 80)
    rows = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == {i: (sizes[i], want[i]) for i in sizes}
    assert 1 < len(set(want.values())) < len(docs)
