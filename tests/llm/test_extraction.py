from larder.llm import extraction
from larder.llm.dom import Page
from larder.llm.extraction import _MAIN, Layouts, main_blocks, training_rows
from larder.llm.boosting import boost

SENTENCES = [f"The {a} {b} goes {c} the long road, and nobody {d} it." for a in ("red", "old") for b in ("fox", "house", "man") for c in ("down", "over") for d in ("saw", "liked")]


def test_blocks_of_broken_html():
    page = Page("<p>a &amp;amp; b&nbsp;<b>c<p>d<!-- x > --> e<script>if (a<b) '</p>'</script><br>f<li>g<li>h</ul><style>z</style><a href='x>y'>i</a> < 5 &lt;p&gt;")
    assert [t for t in page.text if t] == ["a &amp; b c", "d e f", "g", "h i < 5 <p>"]
    assert [t for t in Page("").text if t] == [] and [t for t in Page("plain").text if t] == ["plain"]
    assert [t for t in Page("<div><script>never closed <p>x").text if t] == []
    for i, parent in enumerate(page.parent):
        assert parent < i


def test_decoding_is_consistent_and_best():
    import itertools

    import numpy as np

    page = Page("<div>a<section>b<p>c</p></section></div><div>d</div>")
    n = len(page.parent)
    for seed in range(20):
        odds = np.random.default_rng(seed).normal(size=n - 1) * 2
        best, choice = -1e18, None
        for bits in itertools.product([0, 1], repeat=n - 1):
            keep = (1, *bits)
            if all(keep[page.parent[i]] >= keep[i] for i in range(1, n)):
                value = sum(-np.logaddexp(0, -odds[i - 1] if keep[i] else odds[i - 1]) for i in range(1, n))
                if value > best:
                    best, choice = value, keep
        assert main_blocks(page, odds) == [t for i, t in enumerate(page.text) if t and choice[i]]


def test_unseen_layouts():
    short = ["Home", "News", "Sport", "Weather report", "About us"]
    trees = boost(*training_rows(Layouts(SENTENCES, short), 400))
    layouts, right = Layouts(SENTENCES, short, seed=5), 0
    for _ in range(100):
        page = Page(layouts.page())
        want = [t.replace(_MAIN, "") for t in page.text if t and _MAIN in t]
        page.text = [t and t.replace(_MAIN, "") for t in page.text]
        right += main_blocks(page, trees.score(page.features())) == want
    assert right >= 80


def test_whole_pages(spark):
    body = "".join(f"<p>{s}</p>" for s in SENTENCES[:6])
    source = f"<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy now, it is cheap.</div><article><h1>A title</h1>{body}</article><div class=comments><p>I liked it, truly.</p></div><footer>&copy; x</footer></body></html>"
    rows = [(1, "u", source, "clash", 7), (1, "u", source, "clash", 7), (None, None, None, None, None), (3, "v", "", "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, other int")
    got = extraction.extract(pages).orderBy("page_id").collect()
    want = "\n\n".join(["A title", *SENTENCES[:6]])
    assert [(r.page_id, r.text, r.n_chars, r.other) for r in got] == [(None, "", 0, None), (1, want, len(want), 7), (1, want, len(want), 7), (3, "", 0, 1)]
    assert extraction.extract(pages.limit(0)).count() == 0


def texts(source):
    return [t for t in Page(source).text if t]


def test_unclosed_elements_end_with_what_they_stand_in():
    for name in ("button", "select", "svg", "template"):
        assert texts(f"<article><p>A one.</p><div><{name}>Go</div><p>B two.</p></article>") == ["A one.", "B two."]
        assert texts(f"<article><p>A one.</p><div><{name}>Go</{name}> on</div><p>B two.</p></article>") == ["A one.", "on", "B two."]
    for name in ("script", "style", "textarea", "title", "iframe", "noscript"):
        assert texts(f"<article><p>A one.</p><div><{name}>Go</div><p>B two.</p></article>") == ["A one."]
    assert texts("<p>E <math><mi>x</mi><mo>=</mo><mn>2</mn></math> is.</p><div><object data=u>fallback</div><p>B</p>") == ["E x=2 is.", "fallback", "B"]
    assert texts("a<!-- never > closed") == ["a"] and texts("<p>a</p>b<!-- never closed") == ["a", "b"] and texts("a <b") == ["a <b"]


def test_malformed_pages_are_read_in_one_pass():
    import time

    begun = time.perf_counter()
    n = 200_000
    assert len(texts("<a " * (2 * n))) == 1
    assert len(Page("<div>" * n + "</p>" * n).parent) == n + 1
    assert len(Page("<div>" * n + "<td>x" * 1000).parent) == n + 2001
    assert texts("<button>" * n + "x") == [] and texts("<div>a" + "<button>" * n + "</div>b") == ["a", "b"]
    assert time.perf_counter() - begun < 20
