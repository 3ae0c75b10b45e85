"""HTML extraction: parser cases, the chain against enumeration, held-out pages."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest

from sparkdoc.llm import html as h


def texts(page: str | None) -> list[str]:
    return [b[2] for b in h.blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b</b> c<br>d<p>e", ["ab c d", "e"]),
        ("<div>x<p>y</div>z", ["x", "y", "z"]),
        ("<ul><li>1<li>2</ul>", ["1", "2"]),
        ("<script>var a='<p>no</p>';</script><style>p{}</style>yes<!-- no <p>no -->!", ["yes!"]),
        ("<p title='a > b' class=\"x\">in</p>", ["in"]),
        ("a < b and c > d", ["a < b and c > d"]),
        ("<p>cut off <a hre", ["cut off"]),
        ("<script>never closed <p>x", []),
        ("<p>&lt;b&gt; &copy; &#65; &#x42; &unknown; &am</p>", ["<b> © A B &unknown; &am"]),
        ("<p> \n many \t spaces&nbsp;here \n</p>", ["many spaces here"]),
        ("<h1>T</h1><table><tr><td>1<td>2<tr><td>3</table>", ["T", "1", "2", "3"]),
        ("<textarea>no</textarea><p>ok", ["ok"]),
        ("<p a=\"un'closed>text</p>more", ["text", "more"]),
        ("<article><p><b>x.<br><p>y</article><footer>z</footer>", ["x.", "y", "z"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a <math><mi>x</mi></math> b<p>c", ["a x b", "c"]),
        ("<p>a<object data=x><p>b<p>c", ["a", "b", "c"]),
        ("<p>a <math>x<p>b", ["a x", "b"]),
        ("<canvas><p>instead</p></canvas><p>b", ["instead", "b"]),
        ("<p>a <svg><title>t</title><style>no</style><text>u</text></svg> b<p>c", ["a tu b", "c"]),
        ("<p>a <svg><path d=''><p>b", ["a", "b"]),
        ("<p><a title=don't href=/x>the link</a> and it's a long story.</p>", ["the link and it's a long story."]),
        ("<p><a href=/x?q=\"y>z</a> \"w\"</p>", ["z \"w\""]),
        ("<p title = 'a > b' x=\"c>d\"y='>'>in</p>", ["in"]),
        ("<p 'a>in</p> it's", ["in", "it's"]),
    ],
)
def test_no_text_is_lost(page, want):
    assert texts(page) == want


def test_ancestors():
    (block,) = h.blocks('<main><div class="advertSlot" role=banner><span class=menu><p>x')
    assert {"in main", "in div", "in p", "hint advert", "role banner"} - {"role banner"} <= block[1]
    assert "hint role banner" in block[1] and "in span" not in block[1]


def test_viterbi_is_the_best_of_all_chains():
    rng = random.Random(2)
    for _ in range(50):
        weights = {f"f{i}": rng.gauss(0, 1) for i in range(5)}
        chain = h.Chain(weights, [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)], [rng.gauss(0, 1) for _ in range(2)])
        rows = [rng.sample(sorted(weights), 2) for _ in range(6)]

        def total(labels):
            s = chain.start[labels[0]] + sum(sum(weights[f] for f in r) for r, y in zip(rows, labels, strict=True) if y)
            return s + sum(chain.moves[a][b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product([0, 1], repeat=6), key=total)
        assert chain.decode(rows) == [bool(y) for y in best]


def test_training_gradient_finds_a_separable_chain():
    pages = [([["a"], ["b"], ["b"], ["a"]], [False, True, True, False])] * 4
    assert h.train(pages, steps=100).decode([["a"], ["b"], ["a"]]) == [False, True, False]


def test_held_out_pages():
    chain = h.model()
    right = total = whole = 0
    pages = h.labelled_pages(250, seed=1234)
    for page, gold in pages:
        found = h.blocks(page)
        want = h.align(found, gold)
        assert sum(want) == len(gold)
        got = chain.decode(h.features(found))
        right += sum(a == b for a, b in zip(got, want, strict=True))
        total += len(want)
        whole += got == want
    assert right / total > 0.99 and whole / len(pages) > 0.9


def test_nested_pages_take_linear_time():
    n = 100_000
    pages = ["<i>" * n + "<a>" * n, "<u><p>" + "<b>" * n + "</u>" * n, "<a>x" * n, "<div>" * n + "</div>" * n, "<b>x</i>" * n, "<ul><li>" * n, "<a href='" * n, "<!--" * n, "<div role=" + "x" * n + ">"]
    pages.append("".join(f"<div role=r{k} class=c{k}>x" for k in range(n)))
    for page in pages:
        begun = time.perf_counter()
        h.blocks(page)
        assert time.perf_counter() - begun < 5, page[:40]
    assert texts("<p>a<i>b<b>c</i>d<p>e</b>f</i>g") == ["abcd", "efg"]
    assert texts("<svg><title>t</title></svg><title>u</title><p>v") == ["t", "u", "v"]


def test_long_and_odd_pages(spark):
    chain = h.model()
    assert h.main_text("<article>" + "<p>some words here.</p>" * 20000 + "</article>", chain).count("some") == 20000
    assert np.isfinite(len(h.blocks("<div>" * 20000 + "deep" + "</p>" * 1000)))
    assert h.blocks("<p a='" * 2000) is not None
    page = "<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>The &amp; text.</p></article><footer>&copy; me</footer>"
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, None), (None, "v", "", "x")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in got) == [("1", "Title The & text.", 17), ("1", "Title The & text.", 17), ("2", "", 0), ("None", "", 0)]
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
