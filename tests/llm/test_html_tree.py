"""Pages whose text the style tree decides."""

import pytest

from wayfind.llm import html_text
from wayfind.llm.html_text import extract_text, main_text


def extracted(spark, pages):
    rows = spark.createDataFrame([(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in extract_text(rows).orderBy("page_id").collect()]


def test_same_advert_inside_articles_goes(spark):
    pages = [("a.org", f"<article><h1>Title {i}</h1><p>One {i}</p><div class='offer'>Buy now</div><p>Two {i}</p></article>") for i in range(30)]
    assert extracted(spark, pages) == [f"Title {i}\nOne {i}\nTwo {i}" for i in range(30)]


def test_other_adverts_inside_articles_go_by_their_kind(spark):
    """Adverts that differ on every page, in a kind of element that stands outside articles elsewhere."""
    pages = [("a.org", f"<div class='promo'>Advert {i}</div><article><p>Text {i}</p></article>") for i in range(40)]
    pages += [("b.org", f"<article><p>First {i}</p><div class='promo'>Special {i}</div><p>Last {i}</p></article>") for i in range(5)]
    got = extracted(spark, pages)
    assert got[:40] == [f"Text {i}" for i in range(40)] and got[40:] == [f"First {i}\nLast {i}" for i in range(5)]


def test_what_differs_inside_articles_stays(spark):
    pages = [("a.org", f"<article><div class='lead'>Lead {i}</div><section><p>Body {i}</p><ul><li>Point {i}</li></ul></section></article>") for i in range(30)]
    assert extracted(spark, pages) == [f"Lead {i}\nBody {i}\nPoint {i}" for i in range(30)]


def test_copies_of_a_page_do_not_make_its_article_low(spark):
    pages = [("a.org", "<article><p>The same text</p><div class='x'>and its box</div></article>")] * 50 + [("a.org", f"<article><p>Text {i}</p><div class='x'>box {i}</div></article>") for i in range(10)]
    got = extracted(spark, pages)
    assert set(got[:50]) == {"The same text\nand its box"} and got[50:] == [f"Text {i}\nbox {i}" for i in range(10)]


def test_pages_without_article(spark):
    pages = [("a.org", f"<div class='top'>Site of all</div><div class='body'><p>Story {i}</p></div><div class='end'>Rights reserved</div>") for i in range(30)]
    assert extracted(spark, pages) == [f"Story {i}" for i in range(30)]


@pytest.mark.parametrize(
    "html, main",
    [
        ("<form><label>Find</label><article><p>One</p></article>Send</form>", "One"),
        ("<form><div><main><p>One</p></main></div></form>", "One"),
        ("<article><p>One</p><form>Name <input></form><p>Two</p></article>", "One\nTwo"),
        ("<nav><form><article>Menu</article></form></nav><p>One</p>", "One"),
        ("<article><p>One</p><form><article>Reply</article></form></article>", "One"),
        ("<p>One <button>Share</button>two</p>", "One two"),
        ("<p>One<button>Open", "One"),
    ],
)
def test_forms_and_buttons(html, main):
    assert main_text(html) == main


def test_low_nodes_inside_articles_are_taken_out():
    page = "<article><p>One</p><div class='offer'>Buy</div></article>"
    node = next(open_[-1] for text, open_ in html_text.blocks_of(page)[0] if text == "Buy")
    article = next(n for _, open_ in html_text.blocks_of(page)[0] for n in open_ if n.tag == "article")
    assert main_text(page, frozenset([node.path])) == "One" and main_text(page, frozenset([article.path])) == "One\nBuy"
