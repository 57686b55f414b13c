"""Page extraction on articles known by construction, on class names and hostile markup; points against a recursive scorer."""

from __future__ import annotations

import random
import time

import pytest

from granary.llm.html_text import choose, main_text, parse

ARTICLE = "<p>This is the first paragraph of the article, with commas, and some length to it so that it counts.</p><p>This is the second paragraph, which is also long enough, and has commas, too.</p>"
PAGE = '<html><body><nav><a href="/">Home</a></nav><div class="{}"><h1>Title</h1>{}</div><div class="comments"><p>I like it, very much, and this is a very long comment indeed, longer than the whole article itself, or so it seems to me.</p></div><footer>Copyright</footer></body></html>'


@pytest.mark.parametrize("name", ["", "no-sidebar", "has-nav", "content has-comments", "related-content", "post search-result", "share-enabled", "login-required", "page-with-sidebar", "ad-free", "sidebar"])
def test_articles_keep_their_text_whatever_their_class(name):
    assert main_text(PAGE.format(name, ARTICLE)) == "Title\n\n" + ARTICLE.replace("</p><p>", "\n\n")[3:-4]


@pytest.mark.parametrize("name", ["sidebar", "side-bar", "sideBar", "comment-list", "ad top", "cookie-notice", "newsletter", "related-posts", "share", "promo-box"])
def test_noise_goes(name):
    html = f'<body><div id="main">{ARTICLE}</div><div class="{name}"><p>Short text, that is not the article.</p></div></body>'
    assert "not the article" not in main_text(html) and "second paragraph" in main_text(html)


@pytest.mark.parametrize(
    "html",
    ['<a x="' * 40_000, "<a b " * 48_000, "<div>" * 20_000 + "</span>" * 20_000 + "x", "<ul><li>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<span>" * 20_000 + "<p>abc, def" * 12_000, "<script></script " * 15_000, "<" * 240_000, "<table>" + "<td>" * 20_000, "&#" + "9" * 100_000 + ";", "<a " + "b " * 100_000 + ">x", "<!--" * 60_000, '<div class="promo"><article>' * 9000 + "<p>abc, def" * 3000, '<main><div class="sidebar"><p>' * 8000 + "x" * 300, "<div><p>" + "a, b " * 20 + "</p><b>c</b></div>" * 2 + ("<div><p>" + "a, b " * 20) * 2000],
    ids=lambda h: h[:12],
)
def test_hostile_pages_take_linear_time(html):
    start = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - start < 3


def _tree(rng, depth):
    """(tag, children): containers, paragraphs and links."""
    if depth == 0 or rng.random() < 0.45:
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) + rng.choice(["", "", ","]) for _ in range(rng.randint(1, 40))]
        cut = rng.randint(0, len(words)) if rng.random() < 0.3 else len(words)
        return ("p", [" ".join(words[:cut]), ("a", [" ".join(words[cut:])])] if cut < len(words) else [" ".join(words)])
    return (rng.choice(["div", "section"]), [_tree(rng, depth - 1) for _ in range(rng.randint(1, 4))])


def _html(x):
    return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(_html, x[1]))}</{x[0]}>"


def _chars(x, linked=False):
    if isinstance(x, str):
        return 0 if linked else len(x.strip())
    if x[0] == "a" and linked:
        return _chars(x)
    return sum(_chars(k, linked) for k in x[1])


def _text(x):
    return x if isinstance(x, str) else "".join(map(_text, x[1]))


def _points(top):
    """The points of every node of body by definition: every node looks at all paragraphs below it."""

    def density(x):
        return _chars(x, True) / _chars(x) if _chars(x) else 0.0

    def paragraphs(x, d=0):
        if x[0] == "p":
            yield x, d
        elif not isinstance(x, str):
            for k in x[1]:
                if not isinstance(k, str):
                    yield from paragraphs(k, d + 1)

    def walk(x):
        points = 0.0
        for p, d in paragraphs(x):
            if 1 <= d <= 3 and _chars(p) and any(_text(k).strip() for k in p[1]):
                points += (1 + _text(p).count(",") + min(3.0, _chars(p) / 100)) * (1 - density(p)) / 2 ** (d - 1)
        yield round(points, 9)
        for k in x[1]:
            if not isinstance(k, str) and x[0] != "p":
                yield from walk(k)

    return list(walk(("body", [top])))


def test_points_equal_a_recursive_scorer():
    rng = random.Random(7)
    for _ in range(300):
        top = ("div", [_tree(rng, 4) for _ in range(rng.randint(1, 4))])
        root = parse(f"<html><body>{_html(top)}</body></html>")
        choose(root)
        got, stack = [], [root.kids[0].kids[0]]
        while stack:
            x = stack.pop()
            if not isinstance(x, str) and x.tag in ("body", "div", "section", "p"):
                got.append(0.0 if x.tag == "p" else round(x.score, 9))
                stack += reversed(x.kids)
        assert got == _points(top)


# articles known by construction: every paragraph has to come back, and none of the noise

NOISE = '<nav><a href="/">Home</a> <a href="/a">About us and all the others</a></nav>{}<div class="sidebar"><p>Noise in the sidebar, which is no part of it, whatever it says.</p></div><ul><li><a href="/1">Noise of a linked headline</a></li><li><a href="/2">Noise of another linked headline</a></li></ul><div class="comments"><p>Noise of a comment that is very long, longer than most, and that goes on, and on, and on, and on, and on, and on.</p></div><footer><p>Noise in the footer</p></footer>'


def _paragraph(rng, k):
    return f"Paragraph {k} " + " ".join(rng.choice(["alpha", "beta,", "gamma", "delta", "of", "the"]) for _ in range(rng.randint(12, 60))) + "."


def _spread_out(rng, paragraphs, tags):
    """The paragraphs under a random tree of containers, in page order."""
    if len(paragraphs) <= 1 or rng.random() < 0.15:
        return "".join(f"<p>{p}</p>" for p in paragraphs)
    cuts = sorted(rng.sample(range(1, len(paragraphs)), rng.randint(1, min(3, len(paragraphs) - 1))))
    return "".join(f"<{(t := rng.choice(tags))}>{_spread_out(rng, paragraphs[a:b], tags)}</{t}>" for a, b in zip([0, *cuts], [*cuts, len(paragraphs)], strict=True))


@pytest.mark.parametrize("tags", [["div"], ["section", "div"], ["div", "section", "article"]], ids="-".join)
def test_no_paragraph_of_a_spread_out_article_is_lost(tags):
    rng = random.Random(len(tags))
    for _ in range(150):
        paragraphs = [_paragraph(rng, k) for k in range(rng.randint(4, 14))]
        inner = _spread_out(rng, paragraphs, [t for t in tags if t != "article"])
        inner = f"<article>{inner}</article>" if "article" in tags else inner
        for _ in range(rng.randint(0, 3)):
            inner = f"<div>{inner}</div>"
        assert main_text(f"<html><body>{NOISE.format(inner)}</body></html>") == "\n\n".join(paragraphs)


def test_rows_of_columns_and_sections_come_back_whole():
    rng = random.Random(2)
    for layout, n, per in (('<div class="row"><div class="col">{}</div></div>', 9, 3), ("<section><div>{}</div></section>", 10, 5), ("<div><div><div>{}</div></div></div>", 12, 4), ("<table><tr><td>{}</td></tr></table>", 6, 3), ("<div>{}</div>", 8, 2)):
        p = [_paragraph(rng, k) for k in range(n)]
        inner = "".join(layout.format("".join(f"<p>{x}</p>" for x in p[k : k + per])) for k in range(0, n, per))
        assert main_text(f"<html><body>{NOISE.format(inner)}</body></html>") == "\n\n".join(p), layout


def test_lists_quotes_and_bare_text_between_parts_stay():
    p = [_paragraph(random.Random(3), k) for k in range(6)]
    inner = f"<div><p>{p[0]}</p><p>{p[1]}</p></div><ul><li>one</li><li>two</li></ul><blockquote>Said.</blockquote>Bare text between the parts, with <b>bold</b> words in it.<div><p>{p[2]}</p><p>{p[3]}</p></div><h2>End</h2><div><p>{p[4]}</p></div>"
    want = [p[0], p[1], "one", "two", "Said.", "Bare text between the parts, with bold words in it.", p[2], p[3], "End", p[4]]
    assert main_text(f"<html><body>{NOISE.format(inner)}</body></html>") == "\n\n".join(want)


@pytest.mark.parametrize("name", ["promo-story", "alert-article", "toc-wrapper content", "footer-fixed content", "nav-next post", "copyright", "disclaimer"])
def test_class_words_do_not_decide_against_the_text(name):
    p = [_paragraph(random.Random(4), k) for k in range(4)]
    for inner in (f'<div class="{name}">' + "".join(f"<p>{x}</p>" for x in p) + "</div>", "".join(f'<div class="{name}"><p>{a}</p><p>{b}</p></div>' for a, b in zip(p[::2], p[1::2], strict=True))):
        got = main_text(f'<html><body><div class="top">A small line that stands in another div, of sixty characters.</div>{NOISE.format(inner)}</body></html>')
        assert got.endswith("\n\n".join(p)) and "Noise" not in got


@pytest.mark.parametrize("name", ["cookie-notice", "newsletter", "promo", "sidebar"])
def test_long_noise_beside_a_short_article_goes(name):
    p = [_paragraph(random.Random(5), k) for k in range(6)]
    noise = f'<div class="{name}">' + "".join(f"<p>{x}</p>" for x in p) + "</div>"
    assert main_text(f"<html><body><article>{ARTICLE}</article>{noise}</body></html>") == ARTICLE.replace("</p><p>", "\n\n")[3:-4]
