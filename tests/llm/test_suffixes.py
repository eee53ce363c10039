import random

import numpy as np
import pytest

from geoweft.llm import suffixes

from .brute import repeated_bytes, repeated_words


def check(spark, texts, length, gram, parts=3):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    want = repeated_bytes(texts, length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in suffixes.dedup_suffixes(docs, length, gram).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS sha").collect()}
    assert got == dict(enumerate(want))
    return sum(w[1] for w in want)


@pytest.mark.parametrize(("length", "gram"), [(24, 12), (40, 8), (64, 32)])
def test_corpus(spark, corpus, length, gram):
    assert check(spark, [t for _, t, _ in corpus], length, gram) > 1000


@pytest.mark.parametrize("step", [64, 1 << 19])
def test_random_small_alphabet(spark, monkeypatch, step):
    monkeypatch.setattr(suffixes, "STEP", step)
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 120))) for _ in range(25)] + ["ab" * 40, "a" * 90, "", None]
    assert check(spark, texts, 12, 6) > 500


def test_passages_in_different_surroundings(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(90))
    texts = []
    for _ in range(40):
        a = r.randint(0, 150)
        texts.append(" ".join(word() for _ in range(20)) + passage[a : a + r.randint(380, 460)] + " ".join(word() for _ in range(20)))
    monkeypatch.setattr(suffixes, "BUCKET", 5)
    assert check(spark, texts, 400, 200) > 5000


@pytest.mark.parametrize("passage", [1, 5, 50])
def test_passages_of_words(spark, corpus, monkeypatch, passage):
    """Words of repeated passages, whatever their bytes, case of A-Z and white space."""
    monkeypatch.setattr(suffixes, "STEP", 64)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    lone = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 60)]
    texts = [t for _, t, _ in corpus]
    for k, p in enumerate(lone * 3):
        texts.append(" ".join([f"start{k}", *(p.upper() if k % 2 else p).split(), f"end{k}"] if k % 3 else [f"start{k}\n", *p.replace(" ", " \t ").split(" "), f"end{k}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.n_passage_words for x in suffixes.dedup_suffixes(docs, passage=passage).collect()}
    assert got == dict(enumerate(repeated_words(texts, passage)))
    if passage == 50:
        assert [got[len(corpus) + k] for k in range(4)] == [0, 50, 51, 60]


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (300, 6)).astype(np.uint64)
    order = suffixes.multikey_quicksort(words)
    assert sorted(map(tuple, words.tolist())) == [tuple(x) for x in words[order].tolist()]


def test_window_minima():
    rng = np.random.default_rng(1)
    for n, w in ((30, 7), (50, 50), (64, 8), (9, 1)):
        v = rng.integers(0, 5, n).astype(np.uint64)
        assert suffixes.window_minima(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(n - w + 1)]
