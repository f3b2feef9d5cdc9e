import random
import re
from html import unescape

import duckdb

from stowage.llm import html_extract as H

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt".split()


def say(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def page(rng, style):
    """A page and its main text."""
    body = [say(rng, rng.randrange(4, 40)) for _ in range(rng.randrange(1, 6))]
    title = say(rng, 4)
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.choices(WORDS, k=5))
    comments = f'<section id="comments"><h3>Comments</h3><div class="comment"><p>{say(rng, 6)}</p></div></section>' if rng.random() < 0.5 else ""
    notice = '<div class="cookie-notice">We use cookies. <button>OK</button></div>' if rng.random() < 0.5 else ""
    form = f'<form action="/s"><label>Search</label><input name="q"><p>{say(rng, 3)}</p></form>' if rng.random() < 0.5 else ""
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{b}" + ("</p>" if rng.random() < 0.7 else "") for b in body)
    if style == 0:
        main = f"<header><nav><ul>{links}</ul></nav>Site name</header><main><article>{inner}</article>{comments}</main><aside>{say(rng, 9)}</aside>"
    elif style == 1:
        main = f'<div id="menu"><ul>{links}</ul></div><div id="content">{inner}<div class="ad">{say(rng, 5)}</div></div>{comments}<div class="sidebar"><p>{say(rng, 8)}</p></div>'
    else:
        main = f"<ul>{links}</ul><div>{inner}</div>{comments}"
    html = f"<!doctype html><html><head><title>x</title><script>var a='<p>no</p>';</script><style>p{{}}</style></head><body>{notice}{main}{form}<footer>&copy; 2020 {say(rng, 3)}</footer></body></html>"
    return html, "\n\n".join([title, *body])


def test_templates(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(240):
        html, text = page(rng, k % 3)
        rows.append((k, f"http://Host{k % 3}.example/x?{k}", html, "h"))
        want[k] = text
    got = {r.page_id: r for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    for k, text in want.items():
        assert got[k].text == text, (k, got[k].text, text)
        assert got[k].n_chars == len(text)


def test_synthetic_pages(spark):
    rows = duckdb.sql("select page_id, html from '/root/testdata/sf0.001/pages.parquet'").fetchall()
    made = {r.page_id: r.text for r in H.op4_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    for k, html in rows:
        article = re.search(r"<article>(.*)</article>", html, re.DOTALL)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", z)).split()) for z in re.split(r"</?(?:p|h1)>", article.replace("<br>", " ")))
        assert made[k] == "\n\n".join(b for b in blocks if b)


def test_joined_by_host_is_the_same(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, f"http://h{k % 4}/", page(rng, k % 3)[0]) for k in range(60)], "page_id long, url string, html string")
    small = sorted(map(str, H.extracted(df).collect()))
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)
    assert sorted(map(str, H.extracted(df).collect())) == small


def test_edges(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "no url", ""), (3, "http://a/", "just text &amp; more\n\t text"), (3, "http://a/", "<p>a<p>b<br>c</i></b> < d &lt;e&gt;"), (4, "http://b/", deep), (5, "http://c/", "<script>never closed <p>x"), (6, "http://d/", "<p>" + "word " * 200_000), (7, "http://e/", '<p title="open>x</p>')]
    got = sorted((r.page_id, r.text) for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got[:6] == [(1, ""), (2, ""), (3, "a\n\nb c < d <e>"), (3, "just text & more text"), (4, "deep"), (5, "")]
    assert len(got[6][1]) == 999_999
    assert H.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def wrapped(*pages):
    w = H.Wrapper()
    for html in pages:
        w.add(H.parsed(html))
    return w


def texts(*pages):
    """The texts of the pages of one host."""
    plan = H.Plan(wrapped(*pages).plan())
    return [plan.text_of(H.parsed(html)) for html in pages]


def test_wrapper():
    w = wrapped("<ul><li>a</ul><p>x</p>", "<ul><li>a<li>b<li><b>c</b></ul><p>x</p>", "<ul><li>a</ul><h2>t</h2><p>x</p><h2>t</h2><p>y</p>")
    assert H.Wrapper.load(w.dump()).expression() == w.expression()
    assert w.expression() == "<ul><li>#text</li> (<li>#text</li>)? (<li>#text</li>)?</ul> ((<p>#text</p>)* (<h2>#text</h2>)*)+"
    w = wrapped("<div class=a>x</div><div class=b>y</div>", "<div class=a>x</div><div class=c><ul><li>z</ul></div><div class=b>w</div>")
    assert w.expression() == "<div a>#text</div> (<div c><ul><li>#text</li></ul></div>)? <div b>#text</div>"
    # what stands once in the same order on all pages is no repetition
    assert wrapped(*(f"<td>menu</td><td>{x}</td><td>promo {x}</td>" for x in "abc")).expression().count("<td>") == 3
    halves = [wrapped("<p>a", "<p>a<p>b"), wrapped("<p>c<p>d<p>e", "<h2>f</h2><p>g<h2>h</h2><p>i")]
    halves[0].join(H.Wrapper.load(halves[1].dump()))
    assert halves[0].pages == 4 and halves[0].expression() == "((<p>#text</p>)* (<h2>#text</h2>)*)+"


def test_counts_of_frequent_texts():
    rng = random.Random(1)
    into = {}
    for _ in range(2000):
        H.counted(into, {1 if rng.random() < 0.4 else rng.randrange(2, 10**6): 1})
    assert len(into) <= H.FREQUENT and max(into, key=into.get) == 1 and 500 < into[1] < 900


def story(rng, k):
    return "".join(f"<{tag}>{say(rng, rng.randrange(12, 40))}</{tag}>" for tag in rng.choices(["p", "p", "h2", "blockquote"], k=k))


def plain(html):
    return "\n\n".join(x for x in re.split("<[^>]*>", html) if x)


def test_pages_without_names():
    """Menu, article and notice in elements that do not say what they are."""
    rng = random.Random(5)
    for shape in (
        "<body><div>Home, About</div><div>{0}</div><div>(c) 2020 all rights</div></body>",
        "<body><table><tr><td>menu alpha</td><td>{0}</td><td>promo {1}</td></tr></table></body>",
        '<body><div class="col1">Side {1}</div><div class="col2">{0}</div></body>',
        '<body><div class="x{2}"><div class="y{2}">{0}</div><div>Weather {1}</div></div><div class="z">imprint</div></body>',
        '<body><form action="/all"><div><a href="/">Home</a></div><div>{0}</div><div>(c) 2020</div></form></body>',
        '<body><div>top</div><article class="story share">{0}</article></body>',
        '<body><article>{0}<p><a href="/x">Read also: {1}</a></p></article><div class="cookie-notice">{1}</div></body>',
    ):
        stories = [story(rng, rng.randrange(1, 9)) for _ in range(12)]
        pages = [shape.format(x, say(rng, 3), k) for k, x in enumerate(stories)]
        assert texts(*pages) == [plain(x) for x in stories], shape
    inner = '<p>{0}</p><section class="notice-board"><p>{1}</p></section>'
    pages = [inner.format(say(rng, 30), say(rng, 10)) for _ in range(6)]
    assert texts(*(f"<article>{x}</article>" for x in pages)) == [plain(x) for x in pages]


def test_template_text_and_copies():
    rng = random.Random(6)
    stories = [f"<p>{say(rng, 30)}</p>" for _ in range(9)]
    # a year that differs on one page, and few pages, do not make template text the article's
    pages = [f"<div>{x}</div><p>All rights reserved {2020 if k else 2019}</p>" for k, x in enumerate(stories)]
    assert texts(*pages) == [plain(x) for x in stories] and texts(*pages[1:4]) == [plain(x) for x in stories[1:4]]
    # a host that is mostly copies of one page keeps them
    pages = [f"<article><h1>title {min(k, 2)}</h1>{stories[min(k, 2)]}</article>" for k in range(9)]
    assert texts(*pages) == [f"title {min(k, 2)}\n\n{plain(stories[min(k, 2)])}" for k in range(9)]
    # a line that is repeated among others is no template
    pages = [f"<article><h1>{say(rng, 3)}</h1>" + "".join(f"<p>{say(rng, 5)}</p><p>again</p><p>again</p>" for _ in range(2 + k % 2)) + f"<p>{say(rng, 4)}</p></article>" for k in range(6)]
    assert texts(*pages) == [plain(x) for x in pages]


def test_text_comes_through_the_wrapper(monkeypatch):
    """Without alignment, or without the roles that it leads to, another text comes out."""
    rng = random.Random(7)
    pages = [f"<div>Home, About</div><div>{story(rng, 3 + k % 3)}</div><div>(c) 2020</div>" for k in range(6)]
    right = texts(*pages)
    monkeypatch.setattr(H, "aligned", lambda a, b, same=False: [])
    assert texts(*pages) != right
    monkeypatch.setattr(H, "aligned", lambda a, b, same=False: a)
    assert texts(*pages) != right


def test_order_of_pages_does_not_matter():
    rng = random.Random(8)
    pages = [page(rng, 2)[0] for _ in range(30)]
    right = dict(zip(pages, texts(*pages), strict=True))
    for _ in range(5):
        rng.shuffle(pages)
        assert dict(zip(pages, texts(*pages), strict=True)) == right


def test_wide_and_long_pages():
    """Thousands of siblings, with and without names of their own, and a wrapper that does not grow with them."""
    rng = random.Random(9)
    pages = []
    for k in range(3):
        many = "".join(f'<div id="post-{rng.randrange(10**9)}"><p>{say(rng, 3)}</p></div>' for _ in range(3000 + k))
        pages.append(f"<main>{many}</main>" + "".join(f"<{tag}>x</{tag}>" for tag in rng.choices(["p", "pre", "h2"], k=2000)))
    w = wrapped(*pages)
    assert len(w.dump()) < 20_000
    assert [x.count("\n\n") for x in texts(*pages)] == [2999, 3000, 3001]


def test_raw_elements_without_an_end():
    read = lambda html: H.parsed(html).blocks
    for start in ('<svg class="x" />', "<math/>", "<noscript>", "<svg>", "<math>", "<template>", "<object>"):
        assert read(f"<div>{start}</div><article><p>one</p>{start}<p>two</p></article>") == ["one", "two"], start
    assert read("<svg/><p>a</p><svg><text>drawn</text></svg><p>b</p>") == ["a", "b"]
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert read(f"<p>a</p><{tag}><p>b</p>") == ["a"]


def test_deep_elements_end_where_they_end():
    for start, end in (("<div>" * 250, "</div>" * 250), ("<b><div>" * 300, "</div></b>" * 300), ("<font>" * 500, "")):
        html = f"<html><body><div><article><p>one</p>{start}<p>two</p><nav>menu</nav><div class=ad>buy</div><p>three</p>{end}<p>four</p></article><p>outside</p></div></body></html>"
        assert texts(html) == ["one\n\ntwo\n\nthree\n\nfour"], start[:20]
    assert texts("<body>" + "<div>" * 250 + "<article><header>head</header><p>one</p></article><header>site</header>" + "</div>" * 250 + "<p>two</p>") == ["head\n\none"]
    assert H.parsed("<font>" * 100_000 + "<p>x" * 2000).blocks[-1] == "x"
    assert texts("<nav><div class=ad><div>" * 2000 + "deep" + "</div></div></nav>" * 2000 + "<p>x") == ["x"]
