"""HTML extraction on pages of several layouts, and votes by host."""

import random
import time

import pytest

from gridloom.llm import html_extract

from .helpers import WORDS

L = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor."
M = f"{L} {L}"


def alone(html):
    return html_extract.text_of(html, html_extract.read_page(html)[1])


PAGES = {
    "divs": (f'<body><div class="header">Site</div><div class="menu"><ul><li><a href=x>One</a></ul></div><div class="content"><h2>Title</h2><p>{M}</p></div><div class="sidebar"><p>{M} {M}</p></div><div id="footer">Foot</div></body>', f"Title {M}"),
    "comments": (f'<main><article><header><h1>T</h1></header><p>{L}</p><section class="comments"><h3>Comments</h3><p>{M} {M}</p></section></article></main>', f"T {L}"),
    "cookies": (f'<div class="cookie-banner">We use cookies {M} {M}</div><div class="story">{L}</div>', L),
    "aside": (f"<article><p>{L}</p><aside>ad</aside><form><input name=q><button>go</button></form><script>var x = '<p>no</p>';</script><style>p{{}}</style><p>{L}</p></article>", M),
    "roles": (f'<div role="main"><p>{L}</p></div><div role="contentinfo">{M} {M}</div>', L),
    "links": (f'<body><div class=x><a href=a>{M}</a> <a href=b>{M}</a></div><div class=y><p>{L}</p></div></body>', L),
    "references": (f"<article><p>a &lt;b&gt; &amp;amp; &#233;&#x4e2d; &nbsp; 1 < 2 {L}</p></article>", f"a <b> &amp; é中 1 < 2 {L}"),
    "inline": (f"<article><p>a<b>b</b>c\n\t d<br>e</p><ul><li>one<li>two</ul><table><tr><td>1</td><td>2</td></tr></table>{L}</article>", f"abc d e one two 1 2 {L}"),
    "cut in a tag": (f"<article><p>{L} end <p clas", f"{L} end"),
    "cut in a closing tag": (f"<article><p>{L}</", L),
    "cut in a comment": (f"<article><p>{L}<!-- ad", L),
    "cut in a reference": (f"<article><p>{L} x &am", f"{L} x &am"),
    "unclosed": (f"<ARTICLE><P>{L}<P>{L}<footer>f</footer>", M),
    "text": ("hello world &amp; more", "hello world & more"),
    "empty": ("", ""),
    "menu alone": ('<nav><a href="/">Home</a></nav>', ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layouts(name):
    html, want = PAGES[name]
    assert alone(html) == want


def test_hosts_vote(spark):
    page = lambda n, m: f'<body><div class="post-1{n}"><p>{" ".join(["word"] * n)}</p></div><div class="extra"><p>{" ".join(["other"] * m)}</p></div></body>'
    rows = [(i, "https://a.example/x", page(20, 5), "z") for i in range(5)] + [(9, "https://A.example/y", page(3, 30), "z"), (10, "http://b.example/", page(3, 30), "z")]
    rows += [(11, None, page(9, 1), "z"), (12, "https://a.example/q", None, "z"), (13, "not a url", "", "z"), (9, "https://A.example/y", page(3, 30), "z"), (None, "https://a.example/", "<p>only a paragraph</p>", "z")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_extract.extracted(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted(((r.page_id, r.text, r.n_chars) for r in got.collect()), key=str)
    w = lambda t, n: " ".join([t] * n)
    want = [(i, w("word", 20)) for i in range(5)] + [(9, w("word", 3))] * 2 + [(10, w("other", 30)), (11, w("word", 9)), (12, ""), (13, ""), (None, "only a paragraph")]
    assert found == sorted(((i, t, len(t)) for i, t in want), key=str)


def test_no_rows(spark):
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_very_long_page():
    body = "".join(f"<p>{L}</p>" for _ in range(20_000))
    assert alone(f"<nav>x</nav><article>{body}</article>") == " ".join([L] * 20_000)


MODIFIED = {
    "modifiers": f'<div class="content has-sidebar"><article><p>{L}</p></article></div><div class="sidebar-left"><p>{M} {M}</p></div>',
    "no sidebar": f'<div id="no-sidebar"><article><p>{L}</p></article></div>',
    "with comments": f'<div class="post-with-comments"><p>{L}</p><div class="comment-list"><p>{M}</p></div></div>',
    "aria": f"<div aria-hidden='false'><p>{L}</p></div>",
    "title": f"<div title='No hidden fees' data-id=nav><p>{L}</p></div><div hidden><p>{M} {M}</p></div>",
    "only noise": f'<div class="widget"><article><p>{L}</p></article></div>',
}


@pytest.mark.parametrize("name", MODIFIED)
def test_names_that_are_no_noise(name):
    assert alone(MODIFIED[name]) == L


SPLIT = {
    "headline and lead": (f'<body><div class="top"><h1>The title</h1><p>A lead.</p></div><div class="story"><p>{M} {M}</p></div><div class="more"><a href=a>Read this.</a></div></body>', f"The title A lead. {M} {M}"),
    "headline alone": (f'<body><div class="top"><h1>The title</h1></div><div class="story"><p>{M}</p></div></body>', f"The title {M}"),
    "second section": (f'<div class="page"><div class="first"><p>{M} {M} {M}</p></div><div class="second"><p>{L}</p></div></div>', f"{M} {M} {M} {L}"),
    "noise beside": (f'<body><div class="story"><p>{M}</p></div><div class="comments"><p>{L}</p></div></body>', M),
    "beside an article": (f'<body><article><p>{M}</p></article><div class="box"><p>{L}</p></div></body>', M),
}


@pytest.mark.parametrize("name", SPLIT)
def test_prose_beside_the_best_container(name):
    html, want = SPLIT[name]
    assert alone(html) == want


def test_a_stub_on_the_winning_path_gives_way():
    stub = f'<body><div class="post"><p>Read on.</p></div><section><div class="story"><p>{M} {M}</p></div></section></body>'
    assert html_extract.text_of(stub, "body/div.post") == f"{M} {M}"
    whole = f'<body><div class="post"><p>{M}</p></div><section><ul><li><a href=x>{L}</a></ul></section></body>'
    assert html_extract.text_of(whole, "body/div.post") == M


UNNAMED = {
    "a reply": (f'<body><div class="k1"><p>{M} {M} {M}</p></div><div class="u9"><p>Reply by Bob: {L[:40]}.</p></div></body>', f"{M} {M} {M}"),
    "replies": (f'<body><div class="k1"><p>{M}</p><div class="u9"><p>Bob says: {L}</p></div><div class="u9"><p>Ann Lee wrote: {L}</p></div></div></body>', M),
    "under a title": (f'<body><div class="k1"><p>{M}</p></div><div class="k2"><h3>Comments (2)</h3><p>{M}</p><p>{M}</p></div></body>', M),
    "a notice": (f'<body><div class="k2"><p>We use cookies. Read our privacy policy on cookies and accept all. {L} {L}</p></div><div class="k1"><p>{L}</p></div></body>', L),
    "about cookies": (f'<body><div class="k1"><p>{M} {M} Cookies are sweet. {M} {M}</p></div></body>', f"{M} {M} Cookies are sweet. {M} {M}"),
    "legal news": (f'<body><div class="legal-news"><p>{M}</p></div></body>', M),
    "tags": (f'<body><div class="post tags-visible"><p>{M}</p></div><div class="tags">a b</div></body>', M),
}


@pytest.mark.parametrize("name", UNNAMED)
def test_signs_of_noise_without_names(name):
    html, want = UNNAMED[name]
    assert alone(html) == want


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def truth(rng, template, notice):
    """A page and its article, known as it is put together."""
    parts = [sentence(rng, rng.randint(6, 14)) for _ in range(rng.randint(4, 12))]
    title = " ".join(rng.choice(WORDS) for _ in range(5))
    text = "".join(f"<p>{x}</p>" for x in parts)
    body = {
        "article": f'<header><a href=/>Home</a></header><article><h1>{title}</h1>{text}</article>',
        "div": f'<div class="x7"><h1>{title}</h1>{text}</div>',
        "deep": f'<div class="wrap"><div class="mid"><div class="t t-{rng.randint(1, 9)}"><h1>{title}</h1>{text}</div></div></div>',
        "main": f'<main id="c"><h1>{title}</h1>{text}<div class="share-box"><a href=s>Share</a></div></main>',
    }[template]
    extra = [
        f'<div class="u1"><p>{notice}</p></div>',
        "<nav><ul>" + "".join(f"<li><a href=/{k}>{rng.choice(WORDS)}</a>" for k in range(6)) + "</ul></nav>",
        f'<div class="comments"><h3>3 comments</h3><p>{sentence(rng, 30)}</p><p>{sentence(rng, 30)}</p></div>',
        f'<div class="u9"><p>Ann says: {sentence(rng, 9)}</p></div><div class="u9"><p>Bo wrote: {sentence(rng, 9)}</p></div>',
        f'<aside><p>{sentence(rng, 40)}</p></aside>', "<script>var a = '<p>no.</p>';</script><style>p{}</style>",
        f'<div class="advert-box"><p>{sentence(rng, 25)}</p></div>', f'<form><input><p>{sentence(rng, 9)}</p></form>',
    ]
    before = [x for x in extra if rng.random() < 0.4]
    after = [x for x in extra if rng.random() < 0.4]
    return f"<html><head><title>{title}</title></head><body>{''.join(before)}{body}{''.join(after)}<footer>{notice}</footer></body></html>", " ".join([title, *parts])


def test_hosts_of_one_and_of_two_templates(spark):
    """Every text equals the article that the page was put together from; the notice is told by its repetition alone."""
    rng = random.Random(4)
    rows, want = [], {}
    for h, templates in enumerate((["article"], ["div"], ["deep"], ["main"], ["article", "div"], ["deep", "main"])):
        notice = " ".join(sentence(rng, 12) for _ in range(5))
        for k in range(30):
            html, text = truth(rng, templates[k % len(templates)], notice)
            rows.append((100 * h + k, f"https://h{h}.example/{k}", html))
            want[100 * h + k] = text
    rows += [(10_000 + k, f"https://h1.example/copy/{k}", rows[30][2]) for k in range(60)]  # an article with many copies is no notice
    want |= {10_000 + k: want[100] for k in range(60)}
    got = {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert [i for i in want if got[i] != want[i]] == []


@pytest.mark.parametrize("html", ["<div>x. " * 100_000, "<div>" * 50_000 + "word." + "</section></div>" * 50_000, "<ul>" + "<li><div>item one." * 50_000, f"<div>{'<p>' * 100_000}{L}"])
def test_deep_nesting_takes_linear_time(html):
    began = time.monotonic()
    assert len(alone(html)) > 4
    assert time.monotonic() - began < 10
