import corpus_pipeline
from geoweft.llm.queries import QUERIES


def test_short_lines(spark, tmp_path):
    texts = ["Read more\none two three four five\n\nHome", "READ  more\none two three four\n\nread some", "home\none two three four\none two three four six", "Home\nRead more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.edits) for r in QUERIES["op9_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (0, 0, 0), (2, 0): (0, 3, 0), (2, 1): (1, 1, 0), (2, 2): (0, 1, 1), (3, 0): (0, 3, 0), (3, 1): (0, 0, 0)}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {0: texts[0], 1: "one two three four\n\nread some"}


def test_a_copy_leaves_no_stub(spark):
    text = "Haanth.\nthe quick brown fox jumps over it"
    docs = spark.createDataFrame([(0, text), (1, text)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, "").collect()] == [0]
