"""Parts of a page are kept or left out by what they are called and by where they stand, not by their length."""

import itertools
import time

import pytest

from tarn.llm.html_text import main_text

S = "Some words stand in this sentence here today. "
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News of us</a></li></ul></nav>"
FOOT = "<footer>Copyright of the site</footer>"
TEXT = "".join(f"<p>{S * 3}</p>" for _ in range(4))


def page(x):
    return f"<html><body>{MENU}{x}{FOOT}</body></html>"


def check(html, inside, outside=("Copyright", "News of us")):
    got = main_text(html)
    assert [x for x in inside if x not in got] == [] and [x for x in outside if x in got] == []


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>", "<div>%s</div>", "<main><article>%s</article></main>", "%s"])
@pytest.mark.parametrize("head", ["header", 'header class="entry-header"', 'div class="post-header"', 'div class="page-header"', 'div class="entry-header"'])
def test_a_header_with_the_title_is_kept(wrap, head):
    for k in range(5):
        lead = f"<p>{S * k}</p>" if k else ""
        check(page(wrap % f"<{head}><h1>The Title Here</h1>{lead}</{head.split()[0]}>{TEXT}"), ["The Title Here"])


@pytest.mark.parametrize("element, name, k", itertools.product(("div", "section"), ("", " class='c9'"), (1, 2, 3, 4)))
def test_short_parts_of_an_article_are_kept(element, name, k):
    parts = "".join(f"<{element}{name}><h2>Head {i}</h2><p>{i} {S * k}</p></{element}>" for i in range(4))
    check(page(f"<article><h1>The Title</h1>{parts}</article>"), [f"Head {i}" for i in range(4)] + [f"{i} Some words" for i in range(4)])
    check(page(f"<article><h1>The Title</h1>{TEXT}<{element}{name}>{'Lonely words end it. ' * k}</{element}></article>"), ["Lonely words"])


def test_a_short_article_is_a_text():
    for body in ("<h1>Hi</h1><p>just nine words are standing in this short text</p>", "<div><h1>Hi</h1></div><div><p>just nine words are standing in this short text</p></div>"):
        check(page(f"<div>{body}</div>"), ["Hi", "just nine words"])


@pytest.mark.parametrize(
    "part",
    ["<aside>%s</aside>", '<div class="advertisement">%s</div>', "<footer>%s</footer>", '<div class="cookie-notice">%s</div>', "<form>%s</form>", '<div id="sidebar">%s</div>',
     '<section class="comments">%s</section>', "<nav>%s</nav>", '<div role="complementary">%s</div>'],
)
def test_named_parts_are_left_out_whatever_their_length(part):
    for n, inner in itertools.product((1, 2, 6, 12, 40), ("%s", "<p>%s</p>", "<div><p>%s</p></div>")):
        x = part % (inner % ("Leak is said in this part of it. " * n))
        check(page(f"<article><h1>The Title</h1>{TEXT}{x}{TEXT}</article>"), ["The Title", "Some words"], ["Leak is said", "Copyright"])
        check(page(f"<article><h1>The Title</h1>{TEXT}{TEXT}</article>{x}"), ["The Title", "Some words"], ["Leak is said", "Copyright"])


def test_names_around_the_page_and_parts_of_names_decide_nothing():
    check(f"<html><body><form id='aspnetForm'>{MENU}<div><h1>The Title</h1>{TEXT}</div>{FOOT}</form></body></html>", ["The Title", "Some words"])
    check(page(f"<article><h1>The Title</h1>{TEXT}<p class='share-price'>{S}unique</p></article>"), ["unique"])
    check(f"<html><body><header><h1><a href='/'>Site Name</a></h1>{MENU}</header><article><h2>Title Two</h2>{TEXT}</article>{FOOT}</body></html>", ["Title Two"], ["Site Name", "Copyright"])


@pytest.mark.parametrize("tag", ["div", "h1", "p", "section"])
def test_deep_pages_take_linear_time(tag):
    spans = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        main_text(f"<{tag}>" * n + "x")
        spans.append(time.perf_counter() - start)
    assert spans[1] < 12 * spans[0] + 0.5
