"""Every operator and stage on nulls, empty and odd texts, repeated rows, empty tables and clashing names."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoweft.llm import decontaminate, html_tree, jaccard, licences, linededup, packing, quality, sharding, suffixes, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "word " * 30000

DOCS = {
    "sharding": lambda d, b: sharding.shard_documents(d, 4, 64),
    "licences": lambda d, b: licences.scan_licences(d),
    "jaccard": lambda d, b: jaccard.jaccard_components(d),
    "packing": lambda d, b: packing.pack(d, PATH),
    "quality": lambda d, b: quality.quality(d),
    "suffixes": lambda d, b: suffixes.dedup_suffixes(d),
    "decontaminate": lambda d, b: decontaminate.scan(d, b),
}
KEEP = {
    "keep_one": lambda d, b: jaccard.keep_one(d),
    "filter": lambda d, b: quality.filter_documents(d),
    "lines": lambda d, b: linededup.dedup_lines(d),
    "spans": lambda d, b: decontaminate.decontaminate(d, b),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    text = "a plain line of some words\nand one more line of words here"
    rows = [
        (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, None, None, None, None), (None, text, None, None, 3), (None, None, None, None, None), (3, "", "en", "s", 0),
        (4, LONG, "en", "s", 1), (5, "\n\n \n", "en", None, 1), (1, "another text under an id that is taken", "en", "s", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(2).cache()


@pytest.fixture(scope="module")
def clashing(odd):
    """Columns whose names operators use inside, or that differ from documents' by case."""
    for name in ("slot", "shard", "virtual_slot", "copy", "rank", "h", "_t", "_h", "_d", "_s", "_gone", "_removed", "host", "text_hash", "hit_spans", "n_words", "Text", "DOC_ID", "token", "_c0", "length"):
        odd = odd.withColumn("x", F.lit(f"kept {name}")).toDF(*odd.columns, name)
    return odd


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(None, None), (1, ""), (2, "some other words")], "item_id long, text string")


@pytest.mark.parametrize("name", DOCS)
def test_rows(odd, clashing, items, name):
    rows = DOCS[name](odd, items).collect()
    assert len(rows) == (odd.count() if name != "packing" else 9 + 15 - 1)
    assert sorted(map(repr, rows)) == sorted(map(repr, DOCS[name](clashing, items).collect()))


TEXT = "a plain line of some words\nand one more line of words here"
OTHER = "another text under an id that is taken"

#: What each operator gives for the odd rows: columns, and values by (id, text).
VALUES = {
    "sharding": (["size", "text_crc32"], {(2, None): (1, 0), (None, None): (1, 0), (3, ""): (1, 0), (4, LONG): (150001, zlib.crc32(LONG.encode())), (5, "\n\n \n"): (5, zlib.crc32(b"\n\n \n"))}),
    "licences": (["sentence_ids", "licences"], {(2, None): ("", ""), (None, None): ("", ""), (3, ""): ("", ""), (4, LONG): ("", "")}),
    "jaccard": (["n_shingles", "component_id"], {(2, None): (0, 2), (None, None): (0, None), (3, ""): (0, 3), (4, LONG): (1, 4), (5, "\n\n \n"): (0, 5), (1, TEXT): (9, 1), (None, TEXT): (9, 1), (1, OTHER): (4, 1)}),
    "quality": (["n_words", "n_repeat_words", "base_failed", "kept"], {(2, None): (0, 0, True, False), (None, None): (0, 0, True, False), (3, ""): (0, 0, True, False), (4, LONG): (30000, 30000, True, False), (1, TEXT): (13, 0, False, True), (1, OTHER): (8, 0, True, False)}),
    "suffixes": (["n_bytes", "n_removed", "n_spans", "n_passage_words"], {(2, None): (0, 0, 0, 0), (None, None): (0, 0, 0, 0), (3, ""): (0, 0, 0, 0), (4, LONG): (150000, 150000, 1, 30000), (1, TEXT): (len(TEXT), 0, 0, 0)}),
    "decontaminate": (["n_words", "hit_spans", "hit_items"], {(2, None): (0, [], []), (None, None): (0, [], []), (3, ""): (0, [], []), (4, LONG): (30000, [], []), (1, TEXT): (13, [], [])}),
}


@pytest.mark.parametrize("name", VALUES)
def test_values(odd, items, name):
    """Rows are told by their id and a column that the text decides; equal rows give equal values."""
    columns, want = VALUES[name]
    got = [(r.doc_id, tuple(r[c] for c in columns)) for r in DOCS[name](odd, items).collect()]
    copies = {(1, TEXT): 2}
    for (doc_id, text), value in want.items():
        assert got.count((doc_id, value)) >= copies.get((doc_id, text), 1), (doc_id, text, value)


def test_kept_values(odd, items):
    rows = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect())
    plain = lambda *own: sorted((i is None, i or 0, t is None, t or "") for i, t in own)
    assert rows(KEEP["filter"](odd, items)) == plain((1, TEXT), (1, TEXT), (None, TEXT))
    # equal rows are one document; the copy without id goes
    assert rows(KEEP["keep_one"](odd, items)) == plain((1, TEXT), (2, None), (None, None), (3, ""), (4, LONG), (5, "\n\n \n"), (1, OTHER))
    # lines of the rows with an id come first; the long line is a document of its own
    assert rows(KEEP["lines"](odd, items)) == plain((1, TEXT), (1, TEXT), (2, None), (None, None), (3, ""), (4, LONG), (5, "\n\n \n"), (1, OTHER), (None, ""))
    assert rows(KEEP["spans"](odd, items)) == rows(odd)


def test_empty_columns(odd, items):
    """An empty table gives the columns of a full one."""
    for name, f in {**DOCS, **KEEP}.items():
        assert f(odd.limit(0), items).dtypes == f(odd, items).dtypes, name


@pytest.mark.parametrize("name", KEEP)
def test_kept_columns(odd, clashing, items, name):
    plain, more = KEEP[name](odd, items), KEEP[name](clashing, items)
    assert plain.columns == odd.columns and more.columns == clashing.columns
    rows = more.collect()
    assert sorted(repr(tuple(r)[:5]) for r in rows) == sorted(repr(tuple(r)) for r in plain.collect()) and rows
    assert all(v == f"kept {c}" for r in rows for c, v in zip(clashing.columns[5:], tuple(r)[5:], strict=True))


@pytest.mark.parametrize("name", {**DOCS, **KEEP})
def test_empty(odd, items, name):
    assert {**DOCS, **KEEP}[name](odd.limit(0), items).count() == 0


def test_pages(spark):
    rows = [(1, "u", "<article><p>some words</p></article>"), (None, None, None), (2, None, ""), (1, "u", "<article><p>some words</p></article>"), (3, "u", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert html_tree.extract_main_text(pages).count() == 5
    assert warc.resolve_revisits(warc.captures_of_pages(pages)).count() > 5
    more = pages.withColumn("text", F.lit(1)).withColumn("HTML2", F.lit(1)).withColumn("k", F.lit(1)).withColumn("base", F.lit(1))
    assert sorted(map(repr, html_tree.extract_main_text(more).collect())) == sorted(map(repr, html_tree.extract_main_text(pages).collect()))
    assert warc.resolve_revisits(warc.captures_of_pages(more)).count() == warc.resolve_revisits(warc.captures_of_pages(pages)).count()
    assert html_tree.extract_main_text(pages.limit(0)).count() == 0 and warc.resolve_revisits(warc.captures_of_pages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, odd, clashing, items, tmp_path, k):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, odd, str(tmp_path))
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0 and out.count() > 0
    if k < 4:
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
