from helpers import empty  # noqa: F401

from skirmish.llm import html_text, queries
from skirmish.llm.html_text import Page

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style></head><body class="ads-page"><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div><article><header>By me</header><h1>Head  &lt;1&gt;</h1><p><b>One
 two<br><p>Thr<i>ee</i> &eacute;&#233;<script>var a = "</p>";</script> four<div class="promo">Buy</div><form><p>Name</p></form><ul><li>a<li>b</ul>
{extra}<section class="comments"><article><p>Nice</p></article></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>"""
TEXT = "Head <1>\nOne two\nThree éé four\na\nb"


def test_main_text_of_an_article():
    assert Page(PAGE.format(extra="")).text() == TEXT


def test_every_prefix_is_read():
    whole = PAGE.format(extra="")
    for n in range(len(whole)):
        Page(whole[:n]).text()
    assert Page(whole[:whole.index(" four")]).text() == "Head <1>\nOne two\nThree éé"


def test_pages_without_article_and_odd_markup():
    assert Page("<div id=main><p>a &amp;amp b</p><p title='x>y'>c</p>text <b>in</b>line</div><div hidden>no</div>").text() == "a &amp b\nc\ntext inline"
    assert Page("<main><p>in</p></main><p>out</p>").text() == "in"
    assert Page("</div></p><p>x</b></p>y &am").text() == "x\ny &am"
    assert Page("<b>" * 20000 + "deep" + "</i>" * 20000).text() == "deep" and Page("").text() == "" and Page("< a & b").text() == "< a & b"
    assert Page("<table><tr><td>1<td>2<tr><td>3</table>").text() == "1\n2\n3"


def test_templates_are_removed_by_host(spark):
    """A box on many pages of a host goes; paragraphs, copies of an article and other hosts stay as they are."""
    box = '<div class="zq"><p>Read our guide</p></div>'
    page = lambda i, extra: PAGE.format(extra=f"<p>Own text {i}</p>{extra}")
    rows = [(i, "http://hot.example/a", page(i, box)) for i in range(60)] + [(100 + i, f"https://HOT.example:80/{i}", page(7, box)) for i in range(40)]
    rows += [(200, "http://b.example", page(1, box)), (201, None, page(2, "")), (202, "no url", None), (203, "http://hot.example", ""), (203, "http://hot.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' host", "'y' text", "'z' templates", "1 salt")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"{TEXT}\nOwn text {i}" for i in range(60)) and all(text[100 + i] == f"{TEXT}\nOwn text 7" for i in range(40))
    assert text[200] == f"{TEXT}\nOwn text 1\nRead our guide" and text[201] == f"{TEXT}\nOwn text 2" and text[202] == text[203] == ""
    assert html_text.extract(df.limit(0)).count() == 0


def test_query_keeps_articles_whole(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*(>|\Z)", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_wrappers_with_marked_names_keep_the_article():
    """Layout words in the names of what surrounds the text, with and without an article; small marked boxes still go."""
    words, ad = "Main words of the page that go on for a while.", "<div class='ad'>Buy</div>"
    for name in ("class='layout has-sidebar'", "class='header-fixed'", "id='page' class='no-comments'"):
        for inner in (f"<article><p>{words}</p>{ad}</article>", f"<main><p>{words}</p>{ad}</main>", f"<p>{words}</p>{ad}"):
            page = html_text.Page(f"<html><head><script>{'x' * 500}</script></head><body><div {name}><div {name}>{inner}</div></div><p>End</p></body></html>")
            assert page.text().split("\n")[0] == words and "Buy" not in page.text(), (name, inner)
    short = html_text.Page(f"<body><div class='has-sidebar'><article>Short</article></div><p>{words}</p></body>")
    assert short.text() == "Short"


LONG = "Main text one goes on for quite a while."


def inside(part):
    return Page(f"<html><body><article><p>{LONG}</p>{part}<p>{LONG}</p></article></body></html>").text().split("\n")


def test_attributes_are_read_one_by_one():
    for attribute in ('style="overflow:hidden"', 'title="hidden gems"', 'data-id="header"', 'data-x="class=ad"', "data-hidden", 'class="market-share"',
                      'id="ad-hoc-networks"', 'id="discussion"', "title='class=ad hidden'", "alt=x class=plain class=ad"):
        assert inside(f"<div {attribute}><h2>Head</h2><p>Own.</p></div>")[1:3] == ["Head", "Own."], attribute
        assert inside(f"<div {attribute}>Own.</div>")[1] == "Own.", attribute
    for attribute in ("hidden", "HIDDEN=''", "aria-hidden = true", "CLASS=ad", "id='cookie-notice'", 'class="x sidebar"', "class=related-links", "role=navigation", "class = 'share'"):
        assert len(inside(f"<div {attribute}>Own.</div>")) == 2, attribute


def test_stray_quotes_stay_inside_their_tag():
    assert Page("<p title=don't>Main text one.</p><p>It's more text.</p>").text() == "Main text one.\nIt's more text."
    assert Page('<p "x>One</p><p y\'>Two</p><p>"Three"</p>').text() == 'One\nTwo\n"Three"'
    assert Page("""<p title="a > b" x='>'>One</p>""").text() == "One"
    assert Page("<p " + "a='x" * 3000 + ">One</p>").text().endswith("One")


def test_rows_and_headed_sections_keep_their_text():
    table = "<table><tr class='header'><th class=banner>Name</th></tr><tr><td>Value</td></tr></table>"
    assert inside(table)[1:3] == ["Name", "Value"]
    assert inside("<section id='related'><h2>Related work</h2><p>Others wrote.</p></section>")[1:3] == ["Related work", "Others wrote."]
    assert len(inside("<section class='comments'><h2>Comments</h2><p>Nice.</p></section>")) == 2


def test_most_text_decides_between_main_and_cards():
    assert Page(f"<main><article><p>Card</p></article><p>{LONG}</p><p>{LONG}</p></main>").text() == f"Card\n{LONG}\n{LONG}"
    assert Page(f"<main><p>Lead</p><article><p>{LONG}</p><p>{LONG}</p></article></main>").text() == f"{LONG}\n{LONG}"
    assert Page(f"<body><form id=all><div class=menu>Menu</div><p>{LONG}</p><p>{LONG}</p></form></body>").text() == f"{LONG}\n{LONG}"
    assert Page(f"<body><form><header><article><p>{LONG}</p></article></header><input></form><nav>Menu</nav></body>").text() == LONG
    assert Page(f"<body><p>{LONG}</p><form>Your mail</form></body>").text() == LONG


def test_lists_and_link_paragraphs_recur_on_a_large_host(spark):
    """Boxes on few of many pages are template as well; paragraphs of text never are; a page with many copies gets all its rows."""
    own = lambda i: f"<p>Own text number {i} that goes on for a while, and then some more.</p>"
    extra = {0: "<ul><li><a href=a>Tip one</a></li><li><a href=b>Tip two</a></li></ul>", 3: "<ol><li>Step one</li></ol>", 1: "<p><a href=x>More</a> <a href=y>Most</a></p>", 2: "<p>A shared passage.</p>"}
    page = lambda i, e: f"<body><article>{own(i)}{e}{own(i)}</article></body>"
    rows = [(i, "http://big.example/p", page(i, extra.get(i % 20, ""))) for i in range(200)]
    rows += [(1000 + i, "http://big.example/p", page(20, extra[0])) for i in range(1500)]
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in got:
        own_lines = 3 if i < 200 and i % 20 in (2, 3) else 2
        assert len(got[i]) == own_lines, got[i]
