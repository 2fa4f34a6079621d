"""Main text of web pages against written-out expectations."""

import html
import random
import re
import time

import duckdb
import pytest

from pathmeter.llm import page_text, queries

PROSE = "The first line, of some length, tells what happened; then it goes on. Nobody knew why, of course."
MORE = "A second one follows, with reasons, names and dates. It is not short, either."
PAGES = "page_id long, url string, html string"

AROUND = {
    "header": "<header><h1>Site name</h1><p>All the news, every day, from here.</p></header>",
    "nav": "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News, sport</a></li></ul></nav>",
    "menu": "<div class='main-menu'><a href=/a>One</a> <a href=/b>Two</a></div>",
    "role": "<div role=navigation><p>Jump to this, or that, or another part.</p></div>",
    "sidebar": f"<div id='leftSidebar'><p>{MORE} sidebar</p></div>",
    "aside": f"<aside><p>{PROSE} aside</p></aside>",
    "notice": "<div class='cookie-notice'><p>We use cookies, as everyone does. Accept them, please.</p></div>",
    "advert": f"<div class=ad><p>{PROSE} advert</p></div>",
    "sponsored": f"<section class='x sponsored-content'>{MORE} sponsored</section>",
    "form": "<form action=/s><label>Your name, please: <input name=q></label><p>Write to us, any time.</p></form>",
    "script": "<script>if (a < b) { document.write('<p>script, written.</p>') }</script>",
    "style": "<style>p > b { color: red }</style>",
    "comment": "<!-- <p>commented out, long ago.</p> -->",
    "comments": f"<section id=comments><h2>3 comments</h2><article class=comment><p>{PROSE} reader</p></article><ol class=commentlist><li><p>{MORE} reader</p></ol></section>",
    "footer": "<footer>&copy; 2020 the site. <a href=/i>Imprint</a>, and so on.</footer>",
    "noscript": "<noscript><p>Turn on scripts, please.</p></noscript>",
    "hidden": f"<div style='display: none'><p>{PROSE} hidden</p></div><p hidden>{MORE}</p>",
    "svg": "<svg><title>Logo, drawn</title><text>svg</text></svg>",
}
ARTICLE = (
    f"<h1>A title &amp; more</h1><p>{PROSE}<p>Short.<ul><li>First <b>bo</b>ld<li>Second</ul><blockquote>Quoted, once.</blockquote>"
    f"<table><tr><td>cell<td>next</table><p>{MORE} <a href=/x>See here.</a></p><pre>code  x\n y</pre>"
)
EXPECTED = f"A title & more {PROSE} Short. First bold Second Quoted, once. cell next {MORE} See here. code x y"


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title of the page, long.</title></head><body>{body}</body></html>"


@pytest.mark.parametrize("name", sorted(AROUND))
@pytest.mark.parametrize("wrap", ["article", "main", "div class=content", "td"])
def test_parts_around_the_article_go(name, wrap):
    around = AROUND[name]
    end = wrap.split()[0]
    inside = f"<table><tr><td>{ARTICLE}</td></tr></table>" if wrap == "td" else f"<{wrap}>{ARTICLE}</{end}>"
    assert page_text.main_text(page(f"{around}{inside}")) == EXPECTED
    assert page_text.main_text(page(f"{inside}{around}")) == EXPECTED


@pytest.mark.parametrize("name", sorted(set(AROUND) - {"header"}))
def test_parts_inside_the_article_go(name):
    assert page_text.main_text(page(f"<article>{ARTICLE}{AROUND[name]}<p>Last, not least.</p></article>")) == EXPECTED + " Last, not least."


def test_everything_around_at_once():
    body = "".join(AROUND.values())
    assert page_text.main_text(page(f"{body}<article>{ARTICLE}</article>{body}")) == EXPECTED
    assert page_text.main_text(page(f"<div class='content-sidebar-wrap'>{body}<main>{ARTICLE}</main></div>{body}")) == EXPECTED
    short = page(f"{body}<article><p>Be.</p></article>{body}")
    assert page_text.main_text(short) == "Be."
    assert page_text.main_text(page(body)) == ""


def test_links_without_names_are_told_by_their_paths():
    links = "".join(f"<tr><td><a href=/{i}>Some section {i}</a></td></tr>" for i in range(12))
    words = " ".join(f"<div class=p>{PROSE} {i}</div>" for i in range(5))
    text = page_text.main_text(page(f"<div class=l><table>{links}</table></div><div class=r>{words}</div>"))
    assert text == " ".join(f"{PROSE} {i}" for i in range(5))


def test_article_headers_keep_their_title():
    head = "<header class='entry-header'><h1>The title</h1><p class=by>By someone, today.</p></header>"
    assert page_text.main_text(page(f"<article>{head}<p>{PROSE}</article>")) == f"The title {PROSE}"
    assert page_text.main_text(page(f"<div class=post><div class='post-header'><h2>The title</h2></div><p>{PROSE}<p>{MORE}</div>")) == f"The title {PROSE} {MORE}"


@pytest.mark.parametrize("source,text", [
    ("", ""), ("   ", ""), ("<", "<"), ("a < b", "a < b"), ("plain words", "plain words"), ("<article></article>", ""),
    ("<article><p>a&nbsp;b &lt;p&gt; &#x41;&eacute; &amp;amp; &unknown; x&amp", "a b <p> Aé &amp; &unknown; x&"),
    ("<article>foo<b>bar</b>baz<br>qux<wbr>quux", "foobarbaz quxquux"),
    ("<article><p><b>One.<br><p>Two.</p><p>Three", "One. Two. Three"),
    ("<ARTICLE><P CLASS=A>One</P></ARTICLE>", "One"),
    ("<article><p title='a > b'>One</p></article>", "One"),
    ("<article><p title=\"open>One</p><p>Two</p></article>", "One Two"),
    ("<article>One<!-- never closed <p>Two</p>", "One"),
    ("<article>One<!-->two<!--x--></article>", "Onetwo"),
    ("<article>One<p clas", "One"),
    ("<article>One<script>x</p>", "One"),
    ("<article><p>One</div></section></p></article><footer>F</footer>", "One"),
])
def test_odd_pages(source, text):
    assert page_text.main_text(source) == text


@pytest.mark.parametrize("piece", ["<a \">", "<a \"'>", "<p>", "<div>", "<b>", "</p>", "<ul><li><a>x", "<p class=x>a.", "&amp;", "<!--", "<p><object><b>"])
def test_long_odd_pages_take_seconds(piece):
    begin = time.time()
    page_text.main_text(piece * (1_000_000 // len(piece)))
    assert time.time() - begin < 15


def test_random_articles_come_back_whole():
    rng = random.Random(5)
    for _ in range(60):
        words = lambda n: " ".join(rng.choice(["lorem", "ipsum,", "dolor.", "a&b", "<x>", "é", "%%%", "sit"]) for _ in range(n))
        blocks = [words(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 30))]
        marked = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<div><p>{}</p></div>", "<p><i>{}</i></p>"]).format(html.escape(b)) for b in blocks)
        around = rng.sample(list(AROUND.values()), 4)
        assert page_text.main_text(page("".join(around[:2]) + f"<article>{marked}</article>" + "".join(around[2:]))) == " ".join(blocks)


def test_tables_of_odd_rows(spark):
    long = page("<nav>x</nav><article>" + f"<p>{PROSE}</p>" * 10_000 + "</article>")
    rows = [(1, "u", None), (2, None, ""), (None, "u", page(f"<article>{ARTICLE}")), (2**53 + 1, "u", "x"), (2**53 + 1, "u", "x"), (5, "u", long)]
    df = spark.createDataFrame([(*r, "t", 7) for r in rows], PAGES + ", text string, n_chars long")
    out = {(r.page_id, r.text): r.n_chars for r in page_text.extract(df).collect()}
    want = ["", "", EXPECTED, "x", "x", " ".join([PROSE] * 10_000)]
    assert out == {(r[0], t): len(t) for r, t in zip(rows, want)}
    assert page_text.extract(df).count() == 6 and page_text.extract(df.limit(0)).count() == 0


def test_registered_query_against_the_article_elements(spark):
    """The pages of the driver hold one article each; its text by regular expressions alone."""
    sf_dir = "/root/testdata/sf0.01"
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.QUERIES["op13_page_text"](spark, sf_dir).collect()}
    want = {}
    for i, url, source in duckdb.sql(f"SELECT page_id, url, html FROM '{sf_dir}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        inner = re.sub(r"</?b>", "", re.sub(r"</?(?:p|br|h1)>", " ", inner))
        text = " ".join(html.unescape(inner).split())
        want[i] = (url, text, len(text))
    assert got == want
