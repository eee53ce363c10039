import html
import re
import time

import numpy as np
import pytest

from geoweft.llm import html_tree
from geoweft.llm.html_labels import labelled_pages


@pytest.fixture(scope="module")
def model():
    return html_tree.default_model()


def test_labels_match_nodes():
    for page, labels in labelled_pages(100, 3):
        assert len(html_tree.Page(page).parent) == len(labels) + 1


def test_held_out_accuracy(model):
    right = total = 0
    for page, labels in labelled_pages(150, 2024):
        forest = html_tree.Forest([html_tree.Page(page)], model.vocabulary)
        found = forest.marginals(model.weights, model.tie)[0][1:, 1] > 0.5
        right, total = right + int((found == np.array(labels, bool)).sum()), total + len(labels)
    assert right / total > 0.97


def test_marginals_are_those_of_enumeration(model):
    page = html_tree.Page("<div><p>a b c</p><ul><li>x<li>y</ul></div>")
    forest = html_tree.Forest([page], model.vocabulary)
    n, tie = len(page.parent), model.tie
    assert forest.parent.tolist() == [-1, -1, *page.parent[2:]]  # the frame of the page is tied to nothing
    score = np.bincount(forest.owner, weights=model.weights[forest.index], minlength=n)
    states = np.array([[s >> i & 1 for i in range(n)] for s in range(1 << n)])
    energy = states @ score + sum(tie[states[:, page.parent[i]], states[:, i]] for i in range(2, n))
    p = np.exp(energy - energy.max())
    np.testing.assert_allclose(forest.marginals(model.weights, tie)[0][:, 1], (p / p.sum()) @ states, rtol=1e-8)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><article><h1>Head  line</h1><p>One\n two &amp; three<p>Next <b>bold<br>line</article><footer>&copy; me</footer>", "Head line\nOne two & three\nNext bold line"),
        ("<body><script>var t='</p>';</script><article><p>a b c d e f</p><!-- <p>no</p> --><style>p{}</style></article><aside class=sidebar>More</aside>", "a b c d e f"),
        ("<article><p>5 &lt; 6 &#8212; &eacute;t&eacute; &nbsp; x</p></article>", "5 < 6 — été x"),
        ("<body><header class='site-header'><a href=/>Site</a></header><main><article><p>Main words stand here.</p></article></main><div class='comments'><p>I disagree with this</p></div>", "Main words stand here."),
        ("", ""), (None, ""),
    ],
)
def test_pages(model, page, text):
    assert model.texts([page]) == [text]


PROSE = "The river rose for three days and the bridge at the mill was closed to carts, so the farmers went round by the hill road."
MORE = "Nobody in the village could remember water so high, though the old miller said that his father had marked a stone."

#: Written by hand, not by the generator of the fitting pages: page and the text it should give.
WRITTEN = [
    (f"<div class='x1'><div class='k9'><p>{PROSE}</p><p>{MORE}</p></div></div>", f"{PROSE}\n{MORE}"),
    (f"<html><body><div id=q7><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a></ul></div><div id=zz><h1>High water</h1><p>{PROSE}<p>{MORE}</div><footer><p>&copy; 2020 The Paper</footer></body></html>", f"High water\n{PROSE}\n{MORE}"),
    (f"<body><nav class=mainnav><a href=/a>One</a> <a href=/b>Two</a></nav><section class=story-body><h2>Flood</h2><p>{PROSE}</p><blockquote>{MORE}</blockquote></section><aside><h3>Most read</h3><ol><li><a href=/1>Ten things</a></li><li><a href=/2>Eleven things</a></li></ol></aside></body>", f"Flood\n{PROSE}\n{MORE}"),
    (f"<main id=content><p>{PROSE}</p><script src=x/>var hidden = '{MORE}';</script><form action=/s><label>Search</label><input name=q><button>Go</button></form><p data-u=/a/>{MORE}</p></main>", f"{PROSE}\n{MORE}"),
    (f"<div class=post><p>{PROSE}</p></div><div id=comments class=comment-list><div class=comment><p>{MORE}</p></div></div>", PROSE),
]


@pytest.mark.parametrize(("page", "text"), WRITTEN)
def test_written_pages(model, page, text):
    assert model.texts([page]) == [text]


@pytest.mark.parametrize("page", ["<div>" * 60000 + "deep", "<p><b c=1>" * 30000, "<ul><li>" * 30000, "<span a=1>" * 20000 + "<li>x</li>" * 20000, "</div>" * 60000, "<table><tr><td>" * 20000])
def test_deep_pages_take_linear_time(page):
    began = time.time()
    html_tree.Page(page)
    assert time.time() - began < 5


def test_saved_model(model, tmp_path):
    model.save(str(tmp_path / "model.npz"))
    again = html_tree.Model.load(str(tmp_path / "model.npz"))
    assert again.texts([p for p, _ in WRITTEN]) == model.texts([p for p, _ in WRITTEN])


@pytest.mark.parametrize("page", ["<", "<<<>>>", "</p></p>", "<p", "<a href='", "<!--", "<script>", "x" * 1000, "<p>" * 300, "<div " + "a='b' " * 500 + ">t"])
def test_broken_pages_do_not_fail(model, page):
    model.texts([page])


def test_table(spark, sf_dir, model):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_tree.extract_main_text(pages, model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", r.html or "", re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert got[r.page_id] == "\n".join(x for x in blocks if x)
