import time
import tracemalloc
from html.parser import HTMLParser

import duckdb
import pytest

from rowloom.llm import htmltext as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap"><article class="post-17"><h1>Title &amp; more</h1><p>One   two<br>three<p>Four <b>five</b>&nbsp;six<ul><li>a<li>b</ul>
<div class="ad">Buy!</div><table><tr><td>x<td>y</table><form><input name=q><label>Q</label></form></article>
<aside>Side</aside><section id="comments"><p>First! A reader says something rather long here.</p></section></div>
<footer>&copy; me</footer>"""


def test_page():
    want = "Title & more\n\nOne two three\n\nFour five six\n\na\n\nb\n\nx\n\ny"
    assert h.extract(PAGE, None) == want
    assert h.vote(PAGE)[0] == "body.has-sidebar>div>article.post-#"
    assert h.extract(PAGE, ["body>nothing", "body.has-sidebar>div>article.post-#"]) == want


def test_broken_and_empty():
    assert h.extract("", None) == "" and h.extract("<p>", None) == "" and h.extract("<!-- x", None) == ""
    assert h.extract("a < b & c <b>d", None) == "a < b & c d"
    assert h.extract("<div><p>x</div></p>y</body></body><p>z", None) == "x\n\ny\n\nz"
    assert h.extract("<body><div class=menu>m</div><div><div class='main-text'><p>" + "word " * 50 + "</p></div></div>", None) == ("word " * 50).strip()
    assert h.extract("<script>never ends <p>x</p>", None) == ""


def test_empty_article_is_no_text():
    page = "<body><article></article><p>left over</p></body>"
    assert h.extract(page, ["body>article"]) == "" and h.extract(page, None) == "left over" and h.extract(page, ["body>main"]) == "left over"


def test_consensus_overrules_one_page(spark):
    body = "<p>" + "text " * 20 + "</p>"
    normal = f'<body><div class="story">{body}</div><div class="pile"><p>short</p></div></body>'
    odd = '<body><div class="story"><p>small</p></div><div class="pile"><p>' + "long pile of other things " * 30 + "</p></div></body>"
    rows = [(i, f"https://www.a.example/{i}", normal) for i in range(12)] + [(50, "http://a.example/x", odd), (51, None, odd), (52, "nonsense", None), (53, "https://b.example", "")]
    got = {r.page_id: r for r in h.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 16 and got[50].text == "small" and got[51].text.startswith("long pile")
    assert got[52].text == "" and got[53].text == "" and got[3].text == ("text " * 20).strip()


def test_empty_table(spark):
    assert h.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A long sentence of the article. " * 60


def test_heading_and_lead_outside_the_inner_div_stay(spark):
    page = f"<body><div class=post><h1>T</h1><p>lead</p><div class=text><p>{LONG}</p></div></div></body>"
    want = f"T\n\nlead\n\n{LONG.strip()}"
    assert h.vote(page)[0] == "body>div.post" and h.extract(page, None) == want
    got = h.extracted(spark.createDataFrame([(i, f"https://a.example/{i}", page) for i in range(9)], "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [want] * 9
    parts = f"<body><div class=post><div class=top><h1>T</h1></div><div class=lead>It is a lead.</div><div class=text>{LONG}</div></div></body>"
    assert h.extract(parts, None) == f"T\n\nIt is a lead.\n\n{LONG.strip()}"


def test_long_quotes_and_cells_leave_their_neighbours(spark):
    for inner in ("<blockquote>{}</blockquote>", "<figure>{}</figure>", "<details>{}</details>", "<table><tr><td>a</td><td>{}</td></tr></table>"):
        text = h.extract(f"<body><div class=post><p>before</p>{inner.format(LONG)}<p>after</p></div></body>", None)
        assert text.startswith("before") and text.endswith("after") and LONG.strip() in text
    cells = h.extract(f"<body><div><table><tr><td>a</td><td>{LONG}</td></tr></table></div></body>", None)
    assert cells == f"a\n\n{LONG.strip()}"


def test_links_beside_the_text_are_left_out():
    page = f"<body><p><a href=/home>Home</a> | <a href=/x>More</a></p><div class=col><h3>Archive</h3><ul><li><a href=/1>May</a></ul></div><div class=post><h1>T</h1><p>{LONG}</p></div></body>"
    assert h.vote(page)[0] == "body>div.post" and h.extract(page, None) == f"T\n\n{LONG.strip()}"


def test_a_winning_path_does_not_take_the_lesser_part():
    page = f"<body><div class=post><h1>T</h1><p>{LONG}</p><div class=text><p>One more sentence.</p></div></div></body>"
    assert h.extract(page, ["body>div.post>div.text"]) == f"T\n\n{LONG.strip()}\n\nOne more sentence."
    other = f"<body><div class=b><p>{LONG}</p></div><div class=a><p>Another text.</p></div></body>"
    assert h.extract(other, ["body>div.a", "body"]).endswith("Another text.") and LONG.strip() in h.extract(other, ["body>div.a", "body"])


def test_header_of_an_article_is_part_of_it():
    page = "<body><header><h1>Site</h1></header><article><header class=entry-header><h1>Title</h1></header><p>Body of it.</p><footer>by me</footer></article></body>"
    assert h.extract(page, None) == "Title\n\nBody of it."


def test_quotes_without_their_other_half():
    assert h.extract('<article><p data-x="abc>One two.</p><p>Three.</p></article>', None) == "One two.\n\nThree."
    assert h.extract("<article><p title=it's>One two.</p><p>Don't.</p></article>", None) == "One two.\n\nDon't."
    assert h.extract('<article><p title="a > b">One.</p><p data-y = \'<b>\'>Two.</p></article>', None) == "One.\n\nTwo."


HOSTILE = {
    "open quotes": '<a b="' * 180_000, "open tags": "<a " * 350_000, "quoted ends": "<a b='\">x" * 100_000, "nested": "<div>" * 100_000, "nested with text": "<div>x" * 100_000,
    "nested links": "<div><a>x</a>" * 60_000, "stray ends": "<section>" * 20_000 + "</p>" * 80_000, "inline": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "comments": "<!-- " * 200_000, "items": "<ul><li>" * 60_000 + "<li>" * 60_000,
    "equal signs": "<p class=" * 100_000 + ">", "odd quotes": "<a x=\"y 'z=\">" * 70_000, "spaces": "<p " + " " * 500_000 + "\"" + " " * 500_000 + "'>x",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_seconds(name):
    page = f"<body><article><p>Text.</p></article>{HOSTILE[name]}"
    began = time.time()
    h.extract(page, [h.vote(page)[0]])
    assert time.time() - began < 15
    if not name.startswith("nested"):
        return
    tracemalloc.start()
    h.read(page)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6


class Plain(HTMLParser):
    """A second reader, for the layout of the given pages: blocks of what stands in the article element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.off, self.blocks, self.now = 0, 0, [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.off += tag in ("script", "style")
        if tag == "br":
            self.now.append(" ")
        elif tag in ("p", "h1", "h2", "h3", "article", "ul", "li", "div"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "article", "ul", "li", "div"):
            self.cut()
        self.inside -= tag == "article"
        self.off -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.off:
            self.now.append(data)


def test_equals_a_second_reader_on_the_given_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = duckdb.sql(f"SELECT page_id, html FROM '{folder}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in h.op2_html(spark, folder).collect()}
    assert len(got) == len(pages)
    for page_id, html in pages:
        plain = Plain()
        plain.feed(html or "")
        plain.close()
        plain.cut()
        assert got[page_id] == "\n\n".join(plain.blocks)


def test_long_pages_and_columns_of_other_names(spark, tmp_path):
    page = "<body><article>" + "".join(f"<p>Paragraph {i} of it.</p>" for i in range(60_000)) + "</article><nav>menu</nav>"
    rows = [(1, "https://a.example/1", page, "t", "p", 1), (1, "https://a.example/1", page, "t", None, 2), (None, None, None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, paths string, host long").write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in h.op2_html(spark, str(tmp_path)).collect()]
    want = "\n\n".join(f"Paragraph {i} of it." for i in range(60_000))
    assert sorted(got, key=str) == sorted([(1, "https://a.example/1", want, len(want))] * 2 + [(None, None, "", 0)], key=str)
