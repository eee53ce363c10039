import random

import pytest

WORDS = [a + b for a in "ba ce di fo gu la me ni po ru sa te vi".split() for b in ["", "n", "r", "st", "lo"]]


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared lines, junk and odd rows; ids are distinct."""
    r = random.Random(4)
    line = lambda n: " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."
    text = lambda: "\n".join(line(r.randint(3, 18)) for _ in range(r.randint(1, 8)))
    texts = [text() for _ in range(60)]
    shared = line(25)
    for _ in range(40):
        base = r.choice(texts[:60]).split(" ")
        kind = r.random()
        if kind < 0.3:
            pass
        elif kind < 0.6:
            base[r.randrange(len(base))] = r.choice(WORDS)
        elif kind < 0.8:
            base.insert(r.randrange(len(base)), r.choice(WORDS))
        else:
            base.append("\n" + shared)
        texts.append(" ".join(base))
    texts += [None, "", " \n\t ", "one", "Zwölf Wörter über Öl\nZwölf Wörter über Öl", "x" * 3000, "a b " * 400, "\x00\x01 null\x00byte", "é" * 500 + " " + "é" * 500]
    return [(i, t, f"host{i % 3}") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="session")
def items(spark, corpus):
    long = [t for _, t, _ in corpus if t and len(t.split()) > 30]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    rows = [(0, cut(long[0], 2, 24)), (1, cut(long[1], 0, 9)), (2, "one"), (3, None), (None, cut(long[2], 5, 20)), (5, "never seen words at all in any of these texts"), (5, ""), (6, cut(long[3], 3, 6)), (7, cut(long[0], 12, 22))]
    return rows


@pytest.fixture(scope="session")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")
