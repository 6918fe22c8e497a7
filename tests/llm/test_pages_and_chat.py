"""Main text of pages, and chat logs."""

import html
import random
import re

import pytest

from concordat.llm import chat, queries, webpages
from tests.llm.data import words

BOILER = """<header class="site-header"><h2>Site</h2><nav><a href="/">Home</a></nav></header>
<div class="cookie-notice">We use cookies. Accept them all, please, dear reader.</div>
<div id="sidebar"><p>Popular stories of the week and other long texts that fill the side.</p></div>"""

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>%s
<div class="wrap"><div class="post post-17"><h1>Head &amp; line</h1><p>First &lt;para&gt; of&nbsp;the
   article, which has some words.<p>Second <b>bold<i>both</b> text<br>goes on.</p>
<ul><li>item one</li><li>item two</li></ul><script>var x = "<p>no</p>";</script>
<div class="ad-slot">Buy now</div><form><p>Sign up</p></form><!-- <p>gone</p> -->
<table><tr><td>cell</td></tr></table><div class="comments"><p>I disagree with all of it, says a reader at length.</p></div>
</div></div><footer>&copy; 2020</footer></body></html>"""

WANT = "Head & line\nFirst <para> of the article, which has some words.\nSecond boldboth text goes on.\nitem one\nitem two\ncell"


def test_extraction():
    page = PAGE % BOILER
    assert webpages.extract(page, None) == WANT
    path = max(webpages.votes(page).items(), key=lambda x: x[1])[0]
    assert path == "#>html>body>div.wrap>div.post.post-#".removeprefix("#") or path.endswith("div.wrap>div.post.post-#")
    assert webpages.extract(page, path) == WANT
    assert webpages.extract(page, ">html>nothing") == WANT


@pytest.mark.parametrize("text", ["", "plain text", "<", "<<p>a", "<p>a<b", "<!-- open", "<script>open", "a &amp b &#x41; &bogus;", "</p></div>x",
                                  "<div class=\"a>b\">x</div>", "<a href='x>y</a>", "<p " + "\"" * 2001, "<div>" * 3000 + "deep", "<p>" * 5000])
def test_broken_pages(text):
    got = webpages.extract(text, None)
    assert isinstance(got, str) and got == "\n".join(" ".join(x.split()) for x in got.split("\n"))


def test_deep_page_stays_small():
    page = "".join(f'<div class="c{i % 7}">w{i} ' for i in range(60_000))
    got = webpages.Page(page)
    assert len(got.blocks) == 60_000 and max(map(len, got.path)) < 5000 and len(got.tag) < 2000


def test_names_of_what_stands_beside():
    page = '<body class="no-sidebar"><main class="content with_ads"><div class="has-sidebar post"><p>Kept text here.</p></div></main><div class="sidebar">Gone.</div></body>'
    assert webpages.extract(page, None) == "Kept text here."


def test_plain_text_and_truncation():
    assert webpages.extract("plain  text &amp; more", None) == "plain text & more"
    assert webpages.extract("<html><body><article><p>One.</p><p><b>Two", None) == "One.\nTwo"


@pytest.mark.parametrize(("inside", "want"), [
    ('One <svg width="9" /> two.</p><p>Three.', "One two.\nThree."),
    ("One <math/> two.</p><p>Three <svg><text>label</text></svg> four.", "One two.\nThree four."),
    ("One <svg><g><text>label</text> two.</p><p>Three.</p><p>Four <svg/>five.", "One\nThree.\nFour five."),
    ("One <svg><text>label</text><p>Two.", "One\nTwo."),
    ("One <svg><foreignObject><div>label</div></foreignObject><svg/><text>label</text></svg> two.", "One two."),
    ("One.</p><div><noscript><div>gone</div><p>gone</p><p>gone</p></div><p>Two.</p><noscript>gone</noscript><p>Three.", "One.\nTwo.\nThree."),
    ("One.</p><div><script>var x = 1;</div><p>Two.", "One.\nTwo."),
    ("One.</p><div><script>x = '</div>gone';</script><p>Two.</p></div><p>Three.", "One.\nTwo.\nThree."),
    ('One.</p><iframe src="a"/><p>Two.</p><iframe>gone</iframe><p>Three.', "One.\nTwo.\nThree."),
    ("The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds.", "The sum a+b holds."),
    ("See <object data='x'><param name='a'>the film as prose</object> and <canvas>the drawing as prose</canvas>.", "See the film as prose and the drawing as prose."),
    ("Sources:</p><ul>" + "".join(f'<li><a href="/{i}">Source {i}</a></li>' for i in range(3)) + "</ul><p>End.", "Sources:\nSource 0\nSource 1\nSource 2\nEnd."),
    ('Text.</p><ul class="menu">' + '<li><a href="/">Link</a></li>' * 3 + "</ul><nav><ul>" + '<li><a href="/">Link</a></li>' * 3 + "</ul></nav><p>End.", "Text.\nEnd.")])
def test_nothing_else_is_dropped(inside, want):
    assert webpages.extract(f"<html><body><article><p>{inside}</p></article></body></html>", None) == want


LONG = "It has a first long paragraph with many words about its subject, and goes on with more of them."


@pytest.mark.parametrize(("page", "want"), [
    ('<form id="aspnetForm"><div class="nav"><a href="/">Home</a></div><div><h1>Title</h1><p>%s</p></div><button>Send</button></form>', "Title\n%s"),
    ('<form id="aspnetForm"><div><p>%s</p></div></form>', "%s"),
    ('<div class="content-with-sidebar"><p>%s</p></div><div class="sidebar"><p>Other things.</p></div>', "%s"),
    ('<div class="social-sciences"><p>%s</p></div><div class="social-links"><p>Follow us.</p></div>', "%s"),
    ('<article><div class="entry-header"><h1>Title</h1></div><p>%s</p></article>', "Title\n%s"),
    ('<article><p>%s</p><section id="related-work"><h2>Related work</h2><p>Others did it too.</p></section><div id="related-articles"><p>Read this.</p></div></article>',
     "%s\nRelated work\nOthers did it too."),
    ('<article><p>%s</p><div class="banner-text"><p>Kept words.</p></div><div class="ad-banner">Gone</div><div class="sponsored-content"><p>Gone</p></div></article>', "%s\nKept words."),
    ('<header><p>Site line.</p></header><article><header><h1>Title</h1><p>The lead.</p><div>Share</div></header><p>%s</p></article>', "Title\nThe lead.\n%s"),
    ('<div class="x"><p>%s</p></div><div class="y"><p>The second half goes on with as many words as that.</p></div><div class="sidebar"><p>Gone words here, quite a few of them.</p></div>',
     "%s\nThe second half goes on with as many words as that."),
    ('<div id="pageHeader"><p>Gone.</p></div><article class="post tag-newsletter"><p>%s</p></article>', "%s"),
    ('<article><p>%s</p></article><ol class="comment-list"><li><article class="comment-body"><h1>Re</h1><p>' + LONG * 5 + '</p></article></li></ol>', "%s"),
    ('<div class="cookie-notice"><p>We use cookies.</p></div>', ""),
    ('<article>' + "<div>" * 600 + '<nav><p>Gone</p><div>too</div></nav><p>%s</p>' + "</div>" * 600 + "</article>", "%s")])
def test_marks_are_weighed(page, want):
    fill = lambda t: t % LONG if "%s" in t else t
    page = fill(page)
    assert webpages.extract(f"<html><body>{page}</body></html>", None) == fill(want)


def test_many_open_elements_stay_fast():
    for piece in ("<svg>", "<div><svg>x</div>", "<div><script></div>", "<iframe/>", "<noscript><p>"):
        assert isinstance(webpages.extract(piece * 20_000, None), str)


def test_hosts_agree(spark, tmp_path):
    """A page whose sidebar is longer than its article follows its host."""
    rng = random.Random(0)
    body = lambda n, m: (f'<html><body><div class="left"><div class="list"><p>{" ".join(words(rng, m))}</p></div></div>'  # noqa: E731
                         f'<div class="right"><div class="item-{n}"><p>{(t := " ".join(words(rng, n)))}</p></div></div></body></html>', t)
    rows, want = [], {}
    for i in range(12):
        page, text = body(80 + i, 30) if i else body(20, 90)
        rows.append((i, "https://u@Host.example.org:80/x", page, "t"))
        want[i] = text
    rows += [(50, None, PAGE % BOILER, "t"), (51, "http://other.example/", None, "t"), (52, "nonsense", "", "t"), (None, None, "<p>x", "t"), rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = webpages.main_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    found = [(r["page_id"], r["text"]) for r in got.collect()]
    assert sorted(map(str, found)) == sorted(map(str, [*want.items(), (50, WANT), (51, ""), (52, ""), (None, "x"), (3, want[3])]))
    assert webpages.main_text(pages.limit(0)).collect() == []


def test_given_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def brute_maximal(log):
    convs = {}
    for c, t, r, x in set(log):
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    full = {c: [(r, x) for _, _, r, x in sorted(set(v), key=lambda y: (*y[:2], y[2].encode(), y[3].encode()))] for c, v in convs.items()}
    return {c: v for c, v in full.items()
            if not any(d != c and w[:len(v)] == v and (len(w) > len(v) or d < c) for d, w in full.items())}


@pytest.mark.parametrize("block", [2, 3, 512])
def test_snapshots(spark, block):
    rng = random.Random(block)
    log = []
    for c in range(60):
        n = rng.randrange(1, 8)
        picked = [rng.choice("ab") for _ in range(n)]
        log += [(c, i, "user" if i % 2 == 0 else "assistant", picked[i]) for i in range(n)]
    log += log[:5]
    log += [(200, None, None, None), (201, 0, None, ""), (None, 0, "user", "a"), (202, 5, "user", "x<|im_end|>y"), (202, 5, "user", "z"), (203, -4, "user", "q")]
    df = spark.createDataFrame([(*r, 0, "x") for r in log], "conv_id long, turn long, role string, text string, block int, place string")
    want = brute_maximal(log)
    placed = chat.turns(df, block=block)
    assert {r["conv"]: r["n"] for r in chat.maximal(placed).collect()} == {c: len(v) for c, v in want.items()}
    parts = {}
    for r in chat.collapse(df, block=block).collect():
        parts.setdefault(r["conv"], []).append((r["first_place"], r["n_turns"], r["text"]))
    assert parts.keys() == want.keys()
    for c, v in want.items():
        text = "".join(f"<|im_start|>{r}\n{x.replace('<|im_end|>', '< |im_end| >')}<|im_end|>\n" for r, x in v)
        assert "".join(t for _, _, t in sorted(parts[c])) == text and sum(n for _, n, _ in parts[c]) == len(v)
    assert chat.collapse(df.limit(0)).collect() == []
