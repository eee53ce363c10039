from pyspark.sql import functions as F

from geoweft.llm import quality

from .brute import base_counts
from .brute import quality as plain


def test_counts(docs, corpus):
    got = {r.doc_id: tuple(r)[1:6] for r in quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert got == {i: base_counts(t) for i, t, _ in corpus}


def test_verdicts_and_texts(docs, corpus):
    limits = {"max_docs": 2, "max_share": 0.05, "min_left": 0.2}
    want = plain([(i, s, t) for i, t, s in corpus], 2, 0.05, 0.2)
    got = {r.doc_id: r.kept for r in quality.quality(docs, **limits).collect()}
    assert got == {i: k for (i, _, _), (k, _) in zip(corpus, want, strict=True)}
    texts = {r.doc_id: r.text for r in quality.filter_documents(docs, **limits).collect()}
    assert texts == {i: t for (i, _, _), (k, t) in zip(corpus, want, strict=True) if k}
    assert any(t != texts[i] for i, t, _ in corpus if i in texts) and len(texts) < sum(k for k, _ in plain([(i, s, t) for i, t, s in corpus], 999, 1, 0))


def test_lines_are_counted_by_host(spark):
    words = "the very same footer line of one host with enough words in it"
    own = "".join(chr(97 + k) + "x y z q r s t u v " for k in range(3))
    rows = [(i, f"{own} {i}\n{words.upper() if i % 2 else words}", "big" if i < 40 else "small") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.removed_words for r in quality.quality(docs, max_docs=20, max_share=0.01).collect()}
    assert got == {i: 13 if i < 40 else 0 for i in range(50)}


def test_repeated_rows_and_null_hosts(spark):
    text = "some words that are enough for one document to pass the rules"
    docs = spark.createDataFrame([(1, text, None)] * 3 + [(None, text, None)], "doc_id long, text string, source string")
    assert quality.filter_documents(docs).count() == 4
    # the repeated row is one document, the null id another
    assert quality.quality(docs, max_docs=2, max_share=0.0).filter(~F.col("kept")).count() == 0
    assert quality.quality(docs, max_docs=1, max_share=0.0).filter(~F.col("kept")).count() == 4


def test_repeated_rows_against_brute_force(spark, corpus):
    rows = [(i, t, s) for i, t, s in corpus] + [(i, t, s) for i, t, s in corpus[:30]] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = plain([(i, s, t) for i, t, s in rows], 2, 0.05, 0.2, always=4)
    got = sorted((r.doc_id, r.kept) for r in quality.quality(docs, max_docs=2, max_share=0.05, min_left=0.2, always=4).collect())
    assert got == sorted((i, k) for (i, _, _), (k, _) in zip(rows, want, strict=True))


def test_an_absolute_limit(spark):
    line = "one footer that very many documents of a large host have"
    rows = [(i, f"w{i} x y z q r s t u v k l m n o p{i}\n{line if i % 50 == 0 else 'l' + str(i)}", "big") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.quality(docs, max_docs=20, max_share=0.5, always=30).filter("removed_words > 0").count() == 40
    assert quality.quality(docs, max_docs=20, max_share=0.5).filter("removed_words > 0").count() == 0
