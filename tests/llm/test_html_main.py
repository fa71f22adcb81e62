import html
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_main, queries

SF = "/root/testdata/sf0.001"


def plain(page):
    """For the test pages, whose main text is one article of headings and paragraphs."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", body)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_query_against_plain_extraction(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op2_html_main(spark, SF).collect()}
    assert got.keys() == {r.page_id for r in rows}
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


CASES = [
    ("<p>One &amp; two&nbsp;&#233;<br>three</p> <p>four\n\t five", "One & two é three\n\nfour five"),
    ("<body><nav>menu</nav><div>text <b>bold</b>er</div><div class='left sidebar'>x</div><footer>f</footer></body>", "text bolder"),
    ("<main><h1>T</h1><form><p>mail</p></form><p>a</p><section id=comments><p>c</p></section></main><p>outside</p>", "T\n\na"),
    ("<article><header><h1>T</h1></header><p>a<script>'</p>'</script>b<!-- x --></p><div class=ad>x</div><ul><li>1<li>2</ul></article><article>z</article>", "T\n\nab\n\n1\n\n2\n\nz"),
    ("<p title='a > b'>q</p><p hidden>h</p><p style='display: none'>h</p><textarea><p>no</p></textarea>", "q"),
    ("a &lt;p&gt; &notanentity; 1 < 2 <", "a <p> ¬anentity; 1 < 2 <"),
    ("<div role=navigation>m</div><div class='shadow advice'>kept</div><aside>s</aside>", "kept"),
    ("<div class='post-header'><h1>T</h1><p>lead</p></div><p>x</p>", "T\n\nlead\n\nx"),
    ("<article><p class='notice'>n</p><blockquote class='social'>q</blockquote><div class='comments'>c</div><p>x</p></article>", "n\n\nq\n\nx"),
    ("<nav>m</nav><div id=search-results><p>all of the text</p></div>", "all of the text"),
    ("", ""),
]


@pytest.mark.parametrize("page, text", CASES)
def test_rules(page, text):
    assert html_main.main_text(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    assert html_main.main_text(deep) == "x"
    long = "".join(f"<p>paragraph {i}</p>" for i in range(30_000))
    assert html_main.main_text(long).count("\n\n") == 29_999


def test_templates_go_and_shared_articles_stay(spark):
    def page(i):
        return f"<body><div><a href=/>Home</a> Welcome to the site</div><div><p>Story {i} of the day.</p><p>More {i}.</p></div><div>All the best from us</div></body>"

    share = "<ul><li><a href=x>Share</a></li><li><a href=y>Send</a></li></ul>"
    rows = [(i, f"http://one.example/{i}", page(i), "t") for i in range(12)]
    rows += [(100 + i, f"http://One.example:80/c{i}", f"<article><p>same text</p>{share}</article>", "t") for i in range(9)]
    rows += [(200 + i, f"http://one.example/d{i}", f"<article><p>line that recurs</p><p>{i}</p>{share}</article>", "t") for i in range(9)]
    rows += [(300, "http://two.example/", page(1), "t"), (301, None, None, "t"), (302, "x", "", "t"), (0, rows[0][1], rows[0][2], "t"), (None, None, "<p>a</p>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_main.extract(df).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows)
    assert all(got[i] == f"Story {i} of the day.\n\nMore {i}." for i in range(12))
    assert all(got[100 + i] == "same text" and got[200 + i] == f"line that recurs\n\n{i}" for i in range(9))
    assert got[300].startswith("Home Welcome") and got[301] == got[302] == "" and got[None] == "a"
    assert html_main.extract(df.limit(0)).count() == 0


def test_templates_of_a_large_host_go(spark):
    """A menu on every page goes, and so do adverts of a pool, even one that is shown once; comments go by their mark, what many articles say stays."""
    def page(i):
        said = "<p>As we all know.</p>" * (i % 3 == 0)
        return f"<body><div>Section menu</div><div>Buy {i % 40 if i else 'once'}</div><div><p>Story {i}</p>{said}<p>More of {i}</p></div><div class=comments>I say {i}</div></body>"

    rows = [(i, "http://one.example/", page(i)) for i in range(400)]
    got = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "\n\n".join([f"Story {i}", *["As we all know."] * (i % 3 == 0), f"More of {i}"]) for i in range(400))


def test_counts_alone_find_the_text_of_pages_without_marks(spark):
    """With article, nav and footer made div and class names taken out, on hosts that are counted."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", html_main.host(F.col("url")))
    large = pages.join(pages.groupBy("host").count().where("count > 120"), "host").cache()
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(article|nav|footer)>", "<$1div>"), ' class="ad"', "")
    rows = {r.page_id: plain(r.html) for r in large.collect()}
    got = {r.page_id: r.text for r in html_main.extract(large.select("page_id", "url", bare.alias("html"))).collect()}
    assert len(rows) > 400 and got == rows
    assert not any(html_main.main_text(r.html) == rows[r.page_id] for r in large.select("page_id", bare.alias("html")).collect())


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.example", "<p>x</p>", "t", 1, "h", 2)], "page_id long, url string, html string, recurring string, page_key int, host string, slots int")
    assert [tuple(r) for r in html_main.extract(df).collect()] == [(1, "http://a.example", "x", 1)]


def texts(spark, pages, url="http://one.example/"):
    df = spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_main.extract(df).collect()}


def sentence(i, n=12):
    return " ".join(f"w{(i * 7919 + k * 104_729) % 9973}" for k in range(n)) + "."


@pytest.mark.parametrize("articles", [4, 30])
@pytest.mark.parametrize("mark", ["<div class=body>", "<div>", "<section id=story>"])
def test_mirrored_articles_stay(spark, articles, mark):
    """Each article at five addresses with an advert of its own: on no host is the article template."""
    close = f"</{mark[1:].split()[0].rstrip('>')}>"
    pages = [f"<body><div>All sections</div><div>ad {i}</div>{mark}<p>{sentence(i % articles)}</p><p>{sentence(1000 + i % articles)}</p>{close}</body>" for i in range(5 * articles)]
    got = texts(spark, pages)
    for i in range(len(pages)):
        assert f"{sentence(i % articles)}\n\n{sentence(1000 + i % articles)}" in got[i]
        assert "All sections" not in got[i]


@pytest.mark.parametrize("pages", [30, 99, 100, 1000])
def test_an_article_keeps_what_recurs_in_it(spark, pages):
    """An answer that is mostly pending, a sentence that most pages have: text of the article, on hosts of any size. Adverts and sidebars go by their class, boxes of links by the counts."""

    def page(i):
        answer = f"Answer {i}" if i % 3 == 0 else "pending"
        warning = "<p>No warnings are in force today.</p>" if i % 4 else ""
        return f"<div class=sidebar>Side {i}</div><article><h1>Q {i}</h1><div>{answer}</div>{warning}<div class=advert>Buy {i}</div><ul><li><a href=a>Next</a></li></ul></article><div>Below {i}</div>"

    got = texts(spark, [page(i) for i in range(pages)])
    for i in range(pages):
        want = [f"Q {i}", f"Answer {i}" if i % 3 == 0 else "pending", *(["No warnings are in force today."] if i % 4 else [])]
        assert got[i] == "\n\n".join(want)


@pytest.mark.parametrize("pages", [30, 99, 100, 1000])
def test_marks_hold_on_hosts_of_any_size(spark, pages):
    got = texts(spark, [f"<div class='top-banner'>Banner {i}</div><div><p>{sentence(i)}</p></div><div class=sidebar>Side {i}</div><div class=comments>I say {i}</div><div>Imprint</div>" for i in range(pages)])
    assert all(got[i] == sentence(i) for i in range(pages))


def test_a_page_that_recurs_as_a_whole_stays(spark):
    got = texts(spark, ["<div>Nothing here</div>"] * 50 + [f"<div>Nothing here</div><p>{sentence(i)}</p>" for i in range(50)])
    assert all(got[i] == "Nothing here" for i in range(50)) and all(sentence(i) in got[50 + i] for i in range(50))


def test_layouts_that_differ(spark):
    """The first box is a menu on most pages and the article on one: it is too large to be an advert drawn once."""
    pages = [f"<div>Menu of the site</div><div><p>{sentence(i)}</p></div>" for i in range(20)] + [f"<div><p>{sentence(99)}</p><p>{sentence(98)}</p></div>"]
    got = texts(spark, pages)
    assert got[20] == f"{sentence(99)}\n\n{sentence(98)}" and got[3] == sentence(3)
