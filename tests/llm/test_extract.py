"""Main texts of pages with known articles, of malformed and bare pages, and of odd rows."""

import html
import re
import time

import pytest

from orderloom.llm import extract
from orderloom.llm.extract import main_text, runs
from orderloom.llm.queries import QUERIES
from tests.conftest import SMALL

P = "<p>This is a paragraph of the article with enough words in it.</p>"
T = "This is a paragraph of the article with enough words in it."


def test_furniture_goes_and_all_else_stays():
    page = f"""<html><head><title>no</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies, accept them all please now.</div><article><h1>Head &amp; title</h1>{P}<div class="ad">Buy now!
    </div><p>Short.</p><script>var x = "</p>";</script><p>a<b>b</b>c &eacute;&#33;<br>d</p><form>Name <input></form></article>
    <aside>Related things to read</aside><section id="comments"><p>First! {T} {T} {T}</p></section><footer>&copy; us</footer></body></html>"""
    assert main_text(page) == f"Head & title {T} Short. abc é! d"


def test_without_article_element():
    page = f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a>Three</a><li><a>Four</a></ul><div>{P}{P}<div class=ads>Buy</div><p>End.</p></div><div id=footer>{T}</div>"
    assert main_text(page) == f"{T} {T} End."


def test_malformed():
    assert main_text(f"<article>{P}<p>last words &am") == f"{T} last words &am"
    assert main_text(f"<article>{P}<p>last <a href=\"x") == f"{T} last"
    assert main_text(f"<head><title>x</title><body>{P}") == T
    assert main_text(f"<article>{P}<!-- open {P}") == T
    assert main_text("just text") == "just text" and main_text("<nav>menu</nav>") == "" and main_text("< 5 > 3") == "< 5 > 3"
    assert main_text("<article>" + "<div>" * 20000 + "deep") == "deep"


def test_runs():
    assert runs([]) == [] and runs([0, 0, 0, 0]) == []
    assert runs([0, 5, 0, 0, 7, 0, 0, 0, 2]) == [(1, 5), (8, 9)]


def test_query_on_all_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op7_extract"](spark, SMALL).collect()}
    assert set(got) == set(pages)
    for k, page in pages.items():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1]
        assert got[k].text == " ".join(html.unescape(re.sub(r"<[^>]*(>|$)", " ", article)).split()), k
        assert got[k].n_chars == len(got[k].text)


def test_odd_rows(spark):
    from orderloom.llm.extract import extract

    df = spark.createDataFrame([(1, None, None, "a"), (2, "u", "", "a"), (None, "u", P, "b"), (2, "u", P, "b")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in extract(df).collect()) == [(0, T), (1, ""), (2, ""), (2, T)]
    assert extract(df.limit(0)).count() == 0


def test_thin_lines_of_other_containers_go():
    cases = ["<div>&copy; 2020 Us</div>", "<p>&copy; 2020 Us</p>", "<div>Home News Contact</div>", "<p><a href=x>Home</a> | <a href=y>News</a></p>"]
    for x in cases:
        assert main_text(f"<body>{x}<div>{P}{P}<p>Short.</p>{P}<p>End.</p></div>{x}") == f"{T} {T} Short. {T} End.", x
    assert main_text(f"<body><table><tr><td>Menu text<td>{P}{P}<td>Site notice</table>") == f"{T} {T}"
    assert main_text(f"<body><p><a href=x>One</a><p><a href=y>Two</a>{P}{P}") == f"{T} {T}"
    assert main_text(f"<body><div>Menu</div><div>{T} {T}</div><div>{T} {T}</div><div>&copy; Us</div>") == f"{T} {T} {T} {T}"


def test_lines_of_the_same_container_stay():
    lines = [f"Line {i} of a poem." for i in range(9)]
    assert main_text("<body><div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>") == " ".join(lines)
    assert main_text(f"<body><div><h1>Title</h1>{P}{P}<p>No.<p>Yes.<p>No.<p>Yes.{P}</div>") == f"Title {T} {T} No. Yes. No. Yes. {T}"


def test_one_class_word_does_not_drop_the_article():
    assert main_text(f"<body><div class='page widget'><article>{P}{P}</article></div><div>Other</div>") == f"{T} {T}"
    assert main_text(f"<body><div>Menu</div><div class=promo>{P}{P}<div class=ad>Buy</div><p>End.</div>") == f"{T} {T} End."
    assert main_text(f"<article><div class=notice>{P}{P}</div></article>") == f"{T} {T}"
    assert main_text(f"<article>{P}{P}<div class=comments>{P}{P}{P}{P}{P}</div></article>") == f"{T} {T}"
    assert main_text(f"<article>{P}</article><div class=related><article>Teaser</article></div>") == T


def test_the_heavier_of_declared_and_undeclared_text():
    teasers = "<article><h2>Other</h2><p>A teaser.</p></article>" * 2
    assert main_text(f"<body><div class=content>{P}{P}{P}</div><div>{teasers}</div>") == f"{T} {T} {T}"
    assert main_text(f"<body><div>{P}</div><article>{P}{P}</article>") == f"{T} {T}"


LEAD = "lead words " * 20


@pytest.mark.parametrize("page, want", [
    # attributes by whole name; quotes open a value directly behind "=" only
    ("<article><p>one</p><p title=\"hidden gems\">two</p><div data-hidden=\"false\">three</div><p data-note='hidden'>four</p></article>", "one two three four"),
    ("<article><p>see <a href='/hidden-gems'>word</a> here</p></article>", "see word here"),
    ("<article><div data-class='menu share'>one</div><p data-id='nav'>two</p><p hidden>gone</p><p HIDDEN=''>gone</p></article>", "one two"),
    ("<article><p title=it's>FIRST</p><p>MID</p><p title=it's>LAST</p></article>", "FIRST MID LAST"),
    ("<article><p title = 'a > b' class = \"share\">no</p><p title=\"x>y\">one two</p></article>", "one two"),
    ("<article><p>one</p><p title=\"open>two</p></article>", "one two"),
    # a class word takes a heading never, and a paragraph of an article only where it is thin
    (f"<article><h1 class='banner'>Title</h1><p class='lead widget'>{LEAD}</p><p>rest</p><p class=share>Share this</p><div class=related>{LEAD}</div></article>",
     f"Title {LEAD.strip()} rest"),
    # parts of one article count together, a card does not
    (f"<article><p>{LEAD}</p></article><article><p>{LEAD}two</p></article><article><p>card</p></article>", f"{LEAD}{LEAD}two"),
])
def test_attributes_classes_and_parts(page, want):
    assert extract.main_text(page) == want


def test_deep_nesting_takes_linear_time():
    def seconds(n):
        begin = time.perf_counter()
        extract.main_text("<div>" * n + "text" + "</div>" * n + "<b>" * n + "x" + "</b>" * n)
        return time.perf_counter() - begin

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)
