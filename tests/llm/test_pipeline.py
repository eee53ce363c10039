from collections import Counter

import public_tokenizers

import corpus_pipeline
from geoweft.llm import packing
from geoweft.llm.queries import ORACLE_SQL, QUERIES

from . import brute


def test_stages_against_brute_force(spark, corpus, items, tmp_path):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(i, s, t) for i, t, s in corpus]
    docs = [(i, s, x) for (i, s, _), (kept, x) in zip(docs, brute.quality(docs, 20, 0.01, 0.5), strict=True) if kept]
    gone = brute.duplicate_lines([(i, t) for i, _, t in docs])
    docs = [(i, s, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, s, t in docs]
    docs = [(i, s, t) for i, s, t in docs if brute.SOLID.search(t)]
    roots, _ = brute.near_groups([(i, t) for i, _, t in docs], 5, 80)
    docs = [d for d in docs if roots[d[0]] == d[0]]
    docs = [(i, s, x) for i, s, t in docs if (x := brute.decontaminate(t, items)) is not None]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {i: brute.pieces(len(encode(t)) + 1, 2048) for i, _, t in docs}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length) for r in got) == Counter((i, k, n) for i, own in lengths.items() for k, n in enumerate(own))
    assert len({r.sequence_id for r in got}) == len(brute.best_fit([n for own in lengths.values() for n in own], 2048))
    assert 0 < len(docs) < len(corpus)


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5


def test_sql(spark, sf_dir):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        rows = lambda df: sorted(repr([None if x is None or x != x else x for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
        assert rows(got) == rows(want), name
