import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from geoweft.llm import packing

from .brute import best_fit, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers(spark, sf_dir, corpus):
    tokenizer = Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t or "" for _, t, _ in corpus]
    encode = packing.encoder(PATH)
    assert all(encode(t) == tokenizer.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "Ünï <|endoftext|>'s"])
def test_special_token_strings_are_their_ids(text):
    assert packing.encoder(PATH)(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_best_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [min(64, 1 + int(r.expovariate(1 / r.choice([5, 20, 40])))) for _ in range(400)]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    used = {}
    for length, rank, n, each, first, offset in packing.best_fit_runs(histogram, 64):
        for k in range(n):
            used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        histogram[length] -= n
        assert rank + n + histogram[length] == lengths.count(length)
    assert not any(histogram.values())
    for own in used.values():
        own.sort()
        assert all(o == sum(x for _, x in own[:k]) for k, (o, _) in enumerate(own)) and sum(x for _, x in own) <= 64
    assert sorted(64 - sum(x for _, x in own) for own in used.values()) == best_fit(lengths, 64)


def test_cut():
    assert packing.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


@pytest.mark.parametrize("window", [2048, 16])
def test_pack(docs, corpus, window):
    encode = packing.encoder(PATH)
    rows = packing.pack(docs, PATH, window, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in corpus:
        own = sorted(by_doc[i], key=lambda r: r.piece)
        ids = [*encode(t or ""), 0]
        assert [x for r in own for x in r.ids] == ids and [r.length for r in own] == pieces(len(ids), window)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == sum(len(q.ids) for q in own[: r.piece]) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert all(r.offset == sum(q.length for q in own[:k]) for k, r in enumerate(own)) and sum(r.length for r in own) <= window
    assert len(by_sequence) == len(best_fit([r.length for r in rows], window))
