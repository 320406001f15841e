import html
import random
import re
import time
from itertools import product

import pytest

from tidemark.llm.html_text import extract_text, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of its readers.</div><!-- <p>hidden</p> -->
<article><header><h1>Title &amp; more</h1></header><p>First  paragraph with
enough <b>words<br>to count &mdash; yes.<p>Yes.<div class="ad">Buy this great thing now, cheap and good.</div>
<form><label>Mail</label><input></form><blockquote>Quoted &lt;b&gt; text</blockquote><p>Last one
<section id="comments"><p>A reader comment that says quite a lot of words here, really.</p></section></article>
<aside class="sidebar"><p>Related stuff</p></aside><footer>&copy; site</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Title & more\nFirst paragraph with enough words to count — yes.\nYes.\nQuoted <b> text\nLast one"


def test_without_an_article():
    words = "plain text of a paragraph that goes on for a while " * 3
    page = f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div><p>{words}</p><p>{words}</p></div><div><a href=z>Terms of use and privacy</a></div>"
    assert main_text(page) == "\n".join([" ".join(words.split())] * 2)


@pytest.mark.parametrize("page", ["", "<", "<p", "<p class='a", "<!--", "<script>", "&amp", "</", "a < b", "<p>" * 3000 + "x", "<article>" + "<div>" * 2000 + "text here"])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_cut_off_pages_never_fail():
    for n in range(0, len(PAGE), 7):
        main_text(PAGE[:n])


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        score = [rng.uniform(-1, 1) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda x: sum(abs(s) for s, v in zip(score, x, strict=True) if (s > 0) != v) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        assert abs(cost(minimum_cut(score, edges)) - min(map(cost, product((False, True), repeat=n)))) < 1e-9


def test_table(spark):
    rows = [(1, "u", PAGE, "t", 3), (1, "u", PAGE, "t", 3), (2, None, None, "t", 3), (None, "v", "", "t", 3)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")).collect()
    assert [r["n_chars"] for r in got] == [len(main_text(PAGE))] * 2 + [0, 0] and got[3]["url"] == "v"
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_heads_of_articles_stay():
    body = "<p>" + "Body of the article with words enough to count. " * 3 + "</p>"
    page = f"<body><div class='site-header'>The site of all sites</div><nav><a href=x>Home</a></nav><article><div class='entry-header'><h1>A headline</h1></div>{body}<div class='legal-matters'>{body}</div><div class='share-bar'><a href=y>Share</a></div></article><div class='legal'>All rights are reserved by us.</div></body>"
    assert main_text(page) == "\n".join(["A headline", *["Body of the article with words enough to count. Body of the article with words enough to count. Body of the article with words enough to count."] * 2])


def plain(page):
    """The article's blocks by regular expressions, for pages of the plain kind below."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"<(aside|form|script|style)\b.*?</\1>|<div class=\"(?:ad|comments)\">.*?</div>|<!--.*?-->", "\n", inner, flags=re.S)
    cut = re.split(r"</?(?:p|h1|h2|li|ul|blockquote)>", re.sub(r"</?(?:b|i|a)\b[^>]*>", "", re.sub(r"<br>", " ", inner)))
    return "\n".join(t for t in (" ".join(html.unescape(x).split()) for x in cut) if t)


def test_against_plain_pages(sentences):
    rng = random.Random(8)
    for n in range(60):
        text = lambda: sentences(rng.randint(1, 60), rng.randrange(10**6)).capitalize() + rng.choice((".", " &amp; more.", " &#233;t&eacute;.", "<br>on <b>we</b> go <i>now</i>."))
        parts = [f"<p>{text()}</p>" for _ in range(rng.randint(2, 9))] + [f"<h2>{text()}</h2>", f"<ul><li>{text()}</li><li>{text()}</li></ul>", f"<blockquote>{text()}</blockquote>"]
        rng.shuffle(parts)
        parts += [rng.choice(("", f'<div class="ad">{text()}</div>', f"<form>{text()}</form>", f"<aside>{text()}</aside>", f'<div class="comments">{text()}</div>', "<script>x = '<p>'</script>", "<!-- <p>no</p> -->"))]
        page = f"<html><head><title>{text()}</title></head><body><header>{text()}</header><nav><ul><li><a href=/a>{text()}</a></li></ul></nav><article><h1>{text()}</h1>{''.join(parts)}</article><footer>{text()}</footer></body></html>"
        assert main_text(page) == plain(page), n


def test_very_long_and_very_deep_pages():
    long = " ".join(["word"] * 400_000)
    assert main_text(f"<article><p>{long}</p></article>") == long
    began = time.process_time()
    assert main_text("<article>" + "<div>some words of text " * 20_000 + "</article>").count("some words") == 20_000
    assert time.process_time() - began < 20
