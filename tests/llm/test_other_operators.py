"""Nearest neighbours, URL filter and HTML extraction."""

import html
import re

import numpy as np

from almanac.llm import ann, html_extract, url_filter
from tests.conftest import SF_SMALL

VECTOR_ROWS = "vec_id long, embedding array<float>, label int, q long, c long, score string, rank int"


def brute(rows, every=20, k=20):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in ok.items():
        if i % every == 0:
            near = sorted(((-float((v * w).sum()), j) for j, w in ok.items() if j != i and len(w) == len(v)))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1, 2, "x", 3) for i, v in rows], VECTOR_ROWS)
    got = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    return got


def test_few_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]),
            (7, [inf, 1.0, 1.0]), (8, [-5.0, 1.0, 0.0]), (9, [10.0, 20.0, 30.0]), (None, [1.0, 1.0, 1.0]), (40, [1.0, 2.0]), (60, None), (1, [1.0, 2.0, 3.0])]
    got, want = run(spark, rows), brute(rows)
    assert {q: r for q, r in want.items() if r} == got


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.5] * 4) for i in range(100)] + [(i, [0.5, 1.0] * 4) for i in range(100, 130)] + [(200, [1.0] + [0.0] * 7)]
    assert run(spark, rows) == brute(rows)


def test_no_vectors(spark):
    assert run(spark, []) == {} and run(spark, [(0, [1.0, 1.0])]) == {}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {(q, j): s for q in want for j, s in want[q]}
    assert all(abs(exact[q, j] - s) < 1e-12 for q in got for j, s in got[q] if (q, j) in exact)


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://Blog.Example.NET/en/1", "http://example.net/de/", "https://notexample.net/en/x", "http://x.example.com/de/y?q", "http://x.example.com/dex",
            "http://a.org/fr/", "http://net", "http://net/", "http://xnet/", "https://spam-farm.example.org/en/1", "https://spam-farmer.example.org/", "http://a.com/?affid=3", "http://a.com/AFFID",
            "http://a.bit.ly/x", "http://bit.ly/x", "://h/p#f", "http://a.org/fr/casino/", "http://a.org/casino/", "http://x/de/://example.com/de/", "http://x/net/"]
    want = {"http://Blog.Example.NET/en/1": ("blog.example.net", "/en/1", "example.net/en/", "allow"), "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
            "https://notexample.net/en/x": ("notexample.net", "/en/x", "net/", "block"), "http://x.example.com/de/y?q": ("x.example.com", "/de/y", "example.com/de/", "block"),
            "http://x.example.com/dex": ("x.example.com", "/dex", None, "allow"), "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"), "http://net": ("net", "", None, "allow"),
            "http://net/": ("net", "/", "net/", "block"), "http://xnet/": ("xnet", "/", None, "allow"), "https://spam-farm.example.org/en/1": ("spam-farm.example.org", "/en/1", None, "block"),
            "https://spam-farmer.example.org/": ("spam-farmer.example.org", "/", None, "allow"), "http://a.com/?affid=3": ("a.com", "/", None, "block"), "http://a.com/AFFID": ("a.com", "/AFFID", None, "allow"),
            "http://a.bit.ly/x": ("a.bit.ly", "/x", None, "block"), "http://a.org/fr/casino/": ("a.org", "/fr/casino/", "org/fr/", "allow"), "http://a.org/casino/": ("a.org", "/casino/", None, "block"),
            "://h/p#f": ("h", "/p", None, "allow"), "http://x/net/": ("x", "/net/", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow")}
    df = spark.createDataFrame([(k, u, "c", "t") for k, u in enumerate([*urls, urls[3]])], "page_id long, url string, token string, text string")
    out = url_filter.judge(df).collect()
    assert len(out) == len(urls) + 1 and {r.token for r in out} == {"c"}
    for r in out:
        if r.url in want:
            assert (r.host, r.path, r.rule, r.verdict) == want[r.url], r.url
    assert url_filter.judge(df.limit(0)).collect() == []


def test_index_takes_the_rarest_token(spark):
    tokens = spark.createDataFrame([("u1", "example"), ("u2", "example"), ("u1", "net"), ("u1", "en"), ("u2", "en"), ("u3", "en")], "url string, token string")
    assert url_filter.rarest_tokens(tokens, (url_filter.Rule("example.net/en/", "allow", True),)).first()["token"] == "net"


def test_extraction_of_the_pages(spark):
    """The pages' articles are marked up, so their text is known; the model does not read that mark alone."""
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert rows[p.page_id].text == "\n".join(b for b in blocks if b)


def test_extraction_of_other_layouts():
    model = html_extract.fit(html_extract.labelled_pages())
    read = lambda s: html_extract.main_text(model, s)
    assert read("<body><h1>T</h1><p>One &amp; two&nbsp;words of a paragraph.</p><script>var t='</p><p>x</p>'</script><p>Three.") == "T\nOne & two words of a paragraph.\nThree."
    page = ("<html><body><nav><a>a</a></nav><header><p>Welcome to the page of all pages.</p></header><article><h1>X</h1><p>Y.</p><div class='notice'><p>This article is old and may be out "
            "of date.</p></div><p>Z z z z z.</p></article><aside><p>Read our other things about many other things.</p></aside><form><label>Your mail</label><p>Leave your mail and we write.</p></form>"
            "<section id='comments'><h2>Comments</h2><article><p>First comment with a long text that reads like an article paragraph.</p></article></section><footer>(c)</footer></body></html>")
    assert read(page) == "X\nY.\nZ z z z z."
    assert read("") == "" and read("<!-- x") == "" and read("<script>a") == ""
    deep = "<div>" * 3000 + "<p>" + "word " * 200 + "</p>"
    assert isinstance(read(deep), str)


def test_marginals_equal_enumeration():
    model = html_extract.fit(html_extract.labelled_pages(60))
    page = html_extract.parse("<body><div class=ad><p>Buy it.</p></div><div><h1>T</h1><p>Long enough to be a text of an article, with words.</p></div>")
    n, states = len(page.tags), html_extract.STATES
    assert n <= 7
    f = html_extract.evidence(page)
    total, text = 0.0, [0.0] * n
    import itertools
    for s in itertools.product(states, repeat=n):
        p = 1.0
        for k in range(n):
            p *= model.root[s[k]] if page.parents[k] < 0 else model.pair[s[page.parents[k]]][s[k]]
            for i, v in enumerate(f[k]):
                p *= model.emit[i][s[k]].get(v, model.rare[i][s[k]])
        total += p
        for k in range(n):
            text[k] += p * (s[k] == html_extract.TEXT)
    assert np.allclose(model.marginals(page), [t / total for t in text], atol=1e-9)


def test_extraction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "u", None, "old", 1), (1, "u", "", "old", 1), (None, None, "<p>" + "A long sentence, which is text. " * 3000 + "</p>", None, 2)],
                               "page_id long, url string, html string, text string, row int")
    out = html_extract.extract(df).collect()
    assert out[0].asDict().keys() == {"page_id", "url", "row", "text"}
    assert sorted(len(r.text) for r in out) == [0, 0, len(" ".join(["A long sentence, which is text."] * 3000))]
    assert html_extract.extract(df.limit(0)).collect() == []


def test_extraction_keeps_what_follows_open_tags():
    """Omitted and missing end tags, and elements whose content is text of the page."""
    model = html_extract.fit(html_extract.labelled_pages())
    read = lambda s: html_extract.main_text(model, s)
    one, two = "The river rose for three days and the old bridge was closed.", "On the fourth day the water fell and the people came back."
    for page in (f"<html><head><title>T</title><p>{one}<p>{two}", f"<!doctype html><title>T</title><article><p>{one}</p><p>{two}</p></article>",
                 f"<html><head><meta charset=utf-8><script>var a = '<p>';</script><body><article><p>{one}</p><p>{two}</p></article></body></html>"):
        assert read(page) == f"{one}\n{two}"
    for tag in ("button", "object", "select", "svg", "canvas", "noscript", "video", "math", "template"):
        assert read(f"<html><body><article><p>{one}</p><{tag}><p>{two}</p></article></body></html>") == f"{one}\n{two}", tag
    assert read(f"<body><article><h1>Flood</h1><p>{one}</p><noscript><p>{two}</p></noscript></article>") == f"Flood\n{one}\n{two}"
    assert read(f"<body><article><h1>Flood</h1><p>{one}</p><object data=x><p>{two}</p></object></article>") == f"Flood\n{one}\n{two}"
    assert read(f"<body><article><p>{one} Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><p>{two}</p></article>") == f"{one} Here x=2 holds.\n{two}"
    assert read(f"<body><article><p>{one}</p><button>Share</button><p>{two}</p><script>var x = 1;") == f"{one}\n{two}"
