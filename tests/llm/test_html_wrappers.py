"""Pages whose classes, links and elements could be taken for boilerplate, or the other way round."""

import random

import pytest

from tidemark.llm.html_text import main_text

LONG = "A paragraph of the article that has enough words to be read as such by any reader."
MORE = "And then another one, which also goes on for some time and ends here at last."
TWO = f"<p>{LONG}</p><p>{MORE}</p>"
KEPT = f"{LONG}\n{MORE}"
NAV = "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
FOOT = "<footer>All rights reserved by this site and nobody else.</footer>"


@pytest.mark.parametrize("wrapper", ["id='main' class='with-comments'", "class='layout layout-sidebar'", "class='page has-sidebar'", "class='sidebar'", "id=page class='menu-open overlay'", "class='cookie-ok ad-free'", "class='widget'"])
def test_wrappers_do_not_empty_the_page(wrapper):
    for inner in (TWO, f"<article>{TWO}</article>", f"<main>{TWO}</main>", f"<main><article>{TWO}</article></main>"):
        assert main_text(f"<body><div {wrapper}>{NAV}{inner}{FOOT}</div></body>") == KEPT
        assert main_text(f"<body>{NAV}<div {wrapper}>{inner}</div>{FOOT}</body>") == KEPT
    assert main_text(f"<body><form id=page action=/x>{NAV}<div>{TWO}</div>{FOOT}</form></body>") == KEPT


def test_names_in_an_article_that_only_sound_like_boilerplate():
    page = f"<article><h1>Head</h1><div class='related-work'>{TWO}</div><p class='share-price'>{LONG}</p><section id='notice-of-rights'>{TWO}</section><p class='social-studies'>Short.</p></article>"
    assert main_text(page) == "\n".join(["Head", KEPT, LONG, KEPT, "Short."])


@pytest.mark.parametrize("name", ["ad", "sidebar", "related-posts", "share-buttons", "cookie-notice", "newsletterSignup", "left sidebar-box", "post-comments", "adBox ad-300", "comment-list"])
def test_boilerplate_within_and_beside_an_article(name):
    junk = f"<div class='{name}'><p>{MORE} {MORE}</p></div>"
    assert main_text(f"<body>{NAV}{junk}<article><h1>Head</h1><p>{LONG}</p>{junk}<p>{MORE}</p></article>{junk}</body>") == f"Head\n{KEPT}"
    assert main_text(f"<body>{NAV}{junk}<div><p>{LONG}</p><p>{MORE}</p></div>{junk}</body>") == KEPT


def test_lists_of_links_in_an_article_stay():
    page = f"<article><h1>Head</h1>{TWO}<h2>Sources</h2><ul><li><a href=/1>First source</a></li><li><a href=/2>Second</a></li></ul></article>"
    assert main_text(f"<body>{NAV}{page}{FOOT}</body>") == f"Head\n{KEPT}\nSources\nFirst source\nSecond"
    assert main_text(f"<article>{NAV}{TWO}<nav><a href=/n>Next</a></nav></article>") == KEPT


def test_short_pages():
    assert main_text("<div><p>Yes.</p></div>") == "Yes."
    assert main_text(f"<body>{NAV}<div><p>Yes.</p></div>{FOOT}</body>") == "Yes."
    assert main_text("Yes.") == "Yes."
    assert main_text(f"<body>{NAV}<div><a href=/x>Home</a></div>{FOOT}</body>") == ""


def test_noscript_in_an_article():
    assert main_text(f"<article><p>{LONG}</p><noscript><p>{MORE}</p></noscript></article>") == KEPT
    assert main_text(f"<body><noscript>Please turn on JavaScript to see the pages of this site.</noscript><article>{TWO}</article></body>") == KEPT


def test_comments_as_articles():
    comment = f"<article><header>Reader 1</header><p>{MORE} I think.</p></article>"
    for section in (f"<h2>Two comments</h2>{comment}{comment}", f"<section><h2>What you say</h2>{comment}<form><p>Your comment</p></form></section>", f"<div class='comments'>{comment}</div>"):
        assert main_text(f"<body><article><h1>Head</h1><p>{LONG}</p><h2>Part</h2><p>{MORE}</p>{section}</article><div><p>x</p></div></body>") == f"Head\n{LONG}\nPart\n{MORE}"
    listed = f"<article class=feed><article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{MORE}</p></article></article>"
    assert main_text(listed) == f"One\n{LONG}\nTwo\n{MORE}"


def test_plain_articles_in_any_wrappers(sentences):
    rng = random.Random(3)
    text = lambda: sentences(rng.randint(1, 50), rng.randrange(10**6)).capitalize() + "."
    names = ["site has-menu", "col-main", "with-sidebar", "entry", "post-1 post", "main-wrapper", "share-of-text", "inner", "ad-free", "related-work"]
    junk = ["<div class='related-links'><a href=/r>{}</a></div>", "<aside><p>{}</p></aside>", "<div class='share'>{}</div>", "<section class='comments'><article><p>{}</p></article></section>", "<ul class=menu><li><a href=/m>{}</a></li></ul>"]
    for _ in range(60):
        kept, inner = [], ""
        for _ in range(rng.randint(1, 6)):
            own = text()
            kept.append(own)
            inner += rng.choice((f"<p>{own}</p>", f"<div class='{rng.choice(names)}'><p>{own}</p></div>", f"<ol><li><a href=/s>{own}</a></li></ol>", f"<blockquote>{own}</blockquote>", f"<h3>{own}</h3><p>Here it is.</p>"))
            kept += ["Here it is."] * inner.endswith("Here it is.</p>")
            if rng.random() < 0.4:
                inner += rng.choice(junk).format(text())
        page = f"<article><h1>Head</h1><p>{LONG}</p>{inner}</article>"
        for _ in range(rng.randint(0, 3)):
            page = f"<div class='{rng.choice(names)}'>{rng.choice(junk[:3]).format(text())}{page}</div>"
        assert main_text(f"<html><body>{NAV}{page}{FOOT}</body></html>").split("\n") == ["Head", LONG, *kept]
