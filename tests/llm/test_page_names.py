"""Ordinary names and attributes lose no text; generated pages against the lines they were made of."""

import html
import random

import pytest


def text(source):
    from polyview.llm.page_text import AWAY, page_lines

    return [t for t, region in page_lines(source) if region != AWAY]


@pytest.mark.parametrize(
    "source",
    [
        '<article class="post category-social"><p>Hello world</p></article>',
        '<article><p title="a hidden gem">Hello world</p></article>',
        '<article><p class="share-price">Hello world</p></article>',
        '<article><p id="search-methods">Hello world</p></article>',
        '<article><p class="lead-menu">Hello world</p></article>',
        '<article><p data-id="ad" data-class=\'nav\' title="display:none">Hello world</p></article>',
        '<article id="search"><p>Hello world</p></article>',
        '<div class="overlay"><main class="menu"><p>Hello world</p></main></div>',
        '<div id="modal"><div class="widget"><article><p>Hello world</p></article></div></div><p class="ad">x</p>',
        '<article><p style="color:red" alt="x hidden y">Hello world</p></article>',
        '<article><p title=">" class="headline">Hello world</p></article>',
        '<article><p class="addition notices-of-1920 commentary">Hello world</p></article>',
    ],
)
def test_ordinary_names_stay(source):
    assert text(source) == ["Hello world"]


@pytest.mark.parametrize("mark", ['class="ad"', 'class="x ad"', "id=ad_top_2", 'class="cookieBanner"', 'class="share-buttons"', 'class="site-footer"', 'role="navigation"', "hidden", "HIDDEN=''", 'style="x:y; display : none"', "class='comment-list'", 'class="newsletter&#45;box"', 'id="social"'])
def test_boilerplate_names_go(mark):
    assert text(f"<article><p>Hello world</p><div {mark}><p>away</p></div><p>end</p></article>") == ["Hello world", "end"]


def test_comments_outside_the_article():
    assert text("<div id='comments'><article>me too</article></div>") == []
    assert text("<article><p>a</p></article><div class='related'><article>b</article></div>") == ["a"]


KEPT = ["lead", "share-price", "search-methods", "social-history", "content", "entry", "menu-of-the-day", "note", "footnote", "adverse", "login-attempts", "column", "body", "title", "section-2", "alertness"]
GONE = ['class="ad"', 'class="social"', 'class="sidebar left"', 'id="newsletter"', 'class="nav-list"', 'role="complementary"', 'class="related-items"', 'id="cookie-notice"', "hidden", 'style="display:none"']
TAGS = ["<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>", "<script>{}</script>", "<style>{}</style>", "<!-- {} -->"]


def page(rnd):
    """A page and the lines of its article, by construction."""
    words = lambda: " ".join(rnd.choice(["alpha", "b < c", "déjà", "q & a", "日本", '"x"', "1 > 0"]) for _ in range(rnd.randrange(1, 9)))
    kept = []

    def blocks(depth):
        out = []
        for _ in range(rnd.randrange(1, 5)):
            kind, line = rnd.random(), words()
            if kind < 0.25:
                out.append(rnd.choice(TAGS).format(html.escape(line)))
            elif kind < 0.45:
                out.append(f"<div {rnd.choice(GONE)}><p>{html.escape(line)}</p></div>")
            elif kind < 0.6 and depth:
                out.append(f'<div class="{rnd.choice(KEPT)}">{blocks(depth - 1)}</div>')
            else:
                kept.append(" ".join(line.split()))
                spaced = html.escape(line).replace(" ", rnd.choice([" ", "\n\t", "&#32;"]), 1)
                out.append(f'<{(tag := rnd.choice(["p", "li", "h2", "blockquote"]))} class="{rnd.choice(KEPT)}" title="hidden ad">{spaced}</{tag}>')
        return rnd.choice(["", "\n  "]).join(out)

    kept.append("first")
    body = "<h1>first</h1>" + blocks(3)
    around = lambda: rnd.choice(["", "<nav>menu</nav>", '<div class="ad">buy</div>', "<header>site</header>", "<footer>f</footer>", '<p class="lead">beside</p>'])
    return f'<html><body class="{rnd.choice(KEPT)}">{around()}<article class="{rnd.choice(KEPT)} social">{body}</article>{around()}</body></html>', "\n\n".join(kept)


def test_generated_pages(spark):
    from polyview.llm.page_text import main_text

    rnd = random.Random(11)
    made = [page(rnd) for _ in range(300)]
    rows = [(i, f"https://h{i % 7}.example/{i % 3}/{i}", source) for i, (source, _) in enumerate(made)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(made)}
