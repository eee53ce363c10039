import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from geoweft.llm import linededup

from .brute import duplicate_lines


def test_lines(docs, corpus):
    want = duplicate_lines([(i, t) for i, t, _ in corpus])
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in linededup.duplicate_lines(docs).collect()}
    assert got == want and len(want) > 50
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert texts == {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want) for i, t, _ in corpus}


def test_edits(spark):
    base = "the quick brown fox jumps over it"
    lines = [base, base.replace("fox", "cat"), base + " now", "The  QUICK brown fox jumps over it", base.replace("quick ", ""), base.replace("fox", "cat") + " now", "a b", "a b"]
    docs = spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string")
    got = {r.line_no: (r.first_line_no, r.edits) for r in linededup.duplicate_lines(docs).collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 1), 5: (1, 1), 7: (6, 0)}


def test_repeated_rows_are_not_earlier(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(4, line), (4, line), (None, line), (2, "other line of five words")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.text) for r in linededup.dedup_lines(docs).collect()) == [(False, line), (False, line), (False, "other line of five words"), (True, "")]


def edit(a, b):
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


seq = st.lists(st.integers(0, 2), max_size=6)


@given(st.lists(st.tuples(seq, seq), min_size=1, max_size=4))
def test_within_one_edit(pairs):
    sides = [(np.array(sum(x, []), np.int64), np.cumsum([0, *map(len, x)])) for x in zip(*pairs, strict=True)]
    assert linededup.within_one_edit(*sides[0], *sides[1]).tolist() == [edit(a, b) <= 1 for a, b in pairs]
