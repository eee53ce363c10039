import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from geoweft.llm import decontaminate as dc

from .brute import contamination
from .brute import decontaminate as plain


def test_scan(docs, corpus, benchmark, items):
    want = {}
    for i, t, _ in corpus:
        w, hit, found = contamination(t, items)
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    assert any(w[4] for w in want.values())
    for block_words in (dc.BLOCK_WORDS, 5):
        got = {r.doc_id: tuple(r)[1:] for r in dc.digest(dc.scan(docs, benchmark, block_words=block_words)).collect()}
        assert got == want


def test_texts(docs, corpus, benchmark, items):
    want = {i: plain(t, items) for i, t, _ in corpus}
    for block_words in (5, dc.BLOCK_WORDS):
        got = {r.doc_id: r.text for r in dc.decontaminate(docs, benchmark, block_words=block_words).collect()}
        assert {i: t or "" for i, t in got.items()} == {i: t for i, t in want.items() if t is not None}
    assert any(t != got[i] for i, t, _ in corpus if i in got) and len(got) < len(corpus)


def test_a_huge_item_is_cut_without_loss(spark):
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 8])) for k in range(393)] + [(1000, " ".join(words[5:12]))], "doc_id long, text string")
    found = dc.scan(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"), block_words=20).collect()
    assert {r.doc_id: (sum(x.b - x.a for x in r.hit_spans), r.hit_items) for r in found} == {k: (8, ["1"]) for k in range(393)} | {1000: (0, [])}


def test_empty_benchmark(docs, corpus, benchmark):
    assert dc.scan(docs, benchmark.limit(0)).filter("size(hit_spans) > 0").count() == 0
    assert dc.decontaminate(docs, benchmark.limit(0)).count() == len(corpus)


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(words, max_size=5), words, st.integers(1, 4))
def test_automaton(items, text, window):
    automaton = dc.Automaton([(str(k), w) for k, w in enumerate(items)], window)
    spans, found = automaton.stream(text)
    want, names = set(), set()
    for k, w in enumerate(items):
        for i in range(max(1, len(w) - window + 1) if w else 0):
            g = w[i : i + window]
            for j in range(len(text) - len(g) + 1):
                if text[j : j + len(g)] == g:
                    want.add((j, j + len(g)))
                    names.add(k)
    assert set(spans) == want and found == names
