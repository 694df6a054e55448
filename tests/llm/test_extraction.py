from itertools import product

import numpy as np
import pytest

from themeloom.llm import extraction as ex
from themeloom.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def chain():
    return ex.train(labelled_pages())


def test_blocks_of_a_malformed_page():
    page = "<p>a <b>x&amp;y<br>z<p>c<ul><li>d<li>e</ul><script>var t='</p>';</script>f &copy; &am<div>g</div"
    assert [b.text for b in ex.blocks_of(page)] == ["a x&y z", "c", "d", "e", "f © &am", "g"]
    assert ex.blocks_of("") == [] and ex.blocks_of("<head><title>t</title></head>") == []


def test_held_out_pages(chain):
    wrong = total = 0
    for page, labels in labelled_pages(100, seed=5):
        found = ex.viterbi(chain.scores(ex.blocks_of(page)), chain.move)
        wrong, total = wrong + int((np.array(found) != np.array(labels)).sum()), total + len(labels)
    assert wrong / total < 0.02


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(2)
    for n in range(6):
        scores, move = [tuple(x) for x in rng.normal(size=(n, 2))], rng.normal(size=(2, 2))
        value = lambda y: sum(scores[i][y[i]] for i in range(n)) + sum(move[a][b] for a, b in zip(y, y[1:]))
        assert value(ex.viterbi(scores, move)) == pytest.approx(max(value(y) for y in product((0, 1), repeat=n)))


def test_marginals_equal_all_sequences():
    rng = np.random.default_rng(4)
    scores, move = rng.normal(size=(1, 4, 2)), rng.normal(size=(2, 2))
    weigh = {y: np.exp(sum(scores[0, i, y[i]] for i in range(4)) + sum(move[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=4)}
    total = sum(weigh.values())
    padded = np.concatenate([scores, np.zeros((1, 2, 2))], axis=1)
    share, pairs = ex._marginals(padded, np.array([[True] * 4 + [False] * 2]), move)
    for i in range(4):
        assert share[0, i, 1] == pytest.approx(sum(w for y, w in weigh.items() if y[i]) / total)
    assert pairs[0, 1] == pytest.approx(sum(w * sum(a == 0 and b == 1 for a, b in zip(y, y[1:])) for y, w in weigh.items()) / total)


def test_pages_keep_rows_and_other_columns(spark):
    article = "<article><h1>Head line</h1><p>First  sentence\nof it.</p><p>Second &amp; last one here.</p></article>"
    page = f"<html><body><nav><a href='/'>Home</a></nav>{article}<div class='ad'>Buy this now.</div><footer>&copy; us</footer></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<nav>only</nav>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = sorted(ex.page_texts(pages).collect(), key=str)
    expected = "Head line\nFirst sentence of it.\nSecond & last one here."
    assert [tuple(r) for r in out if r.page_id == 1] == [(1, "u", expected, len(expected))] * 2
    assert all((r.text, r.n_chars) == ("", 0) for r in out if r.page_id != 1)
    whole = ex.extracted_text(pages)
    assert whole.columns == [*pages.columns, "_text"]
    assert ex.page_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("start", ["<p>One.", "<div><p>One.</div>", "<article><p>One.</article>", "<b>One.</b>", "One."])
def test_a_head_left_open_ends_where_the_body_begins(start):
    head = "<html><head><title>T</title><meta name=a><style>s</style><template><p>t</p></template><noscript><p>n</p></noscript>"
    for end in ("", "</head>", "</head><body>", "<body>"):
        blocks = ex.blocks_of(f"{head}\n{end}{start}<p>Two.</p></body></html>")
        assert [b.text for b in blocks] == ["One.", "Two."], end


def test_an_article_after_an_open_head_is_main_text(chain):
    article = "<article><h1>Head line</h1><p>First sentence of it.</p><p>Second and last one here.</p></article>"
    page = f"<html><head><title>T</title>{article}<footer>&copy; us</footer></html>"
    assert ex.main_text(page, chain) == "Head line\nFirst sentence of it.\nSecond and last one here."


def test_formulas_and_fallback_text_are_content():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x = 2</annotation></semantics></math>"
    page = f"<p>So {formula} holds, see <object data='a.svg'>a figure</object> here.<p>a<object><p>b</p></object>"
    assert [b.text for b in ex.blocks_of(page)] == ["So x=2 holds, see a figure here.", "a", "b"]
