"""The page scanner: recorded texts of planted pages, and time in proportion to the page."""

import time

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import html
from scriptorium.operators import maintenance
from scriptorium.plans import jobs

BODY = "A sentence that stands alone in the body of the page. "
NESTED = "<nav><aside><header><footer><form>deep</form> five</footer> four</header> three</aside> two <a href=x>one</a></nav>"

#: Page, main content.
PAGES = {
    "five levels of furniture": (f"<body>{NESTED}<p>{BODY}</p>{NESTED}</body>", BODY.strip()),
    "furniture inside content": (f"<article>{BODY}{NESTED}{BODY}</article>", f"{BODY.strip()}\n{BODY.strip()}"),
    "unclosed furniture ends with its parent": (f"<div><nav><ul><li>menu</div><p>{BODY}</p>", BODY.strip()),
    "furniture that is never closed": (f"<p>{BODY}</p><footer>imprint <b>bold", BODY.strip()),
    "a closing tag of nothing": (f"</nav></p><p>{BODY}</nav></aside></p>", BODY.strip()),
    "unclosed paragraphs and items": (f"<ul><li>{BODY}<li>{BODY}</ul><p>{BODY}<p>{BODY}", "\n".join([BODY.strip()] * 4)),
    "an unclosed link ends with the next": (f"<p>{BODY}<a href=x>one<a href=y>two</a> {BODY}</p>", f"{BODY}one two {BODY}".strip()),
    "a block of links": (f"<p><a>{BODY}</a> more</p><p>{BODY}</p>", BODY.strip()),
    "comments hide tags": (f"<!-- <nav> --><p>{BODY}</p><!-- </nav> <p>gone</p> -->", BODY.strip()),
    "a comment without an end": (f"<p>{BODY}</p><!-- <p>kept</p>", f"{BODY.strip()}\nkept"),
    "scripts are no text, whatever they hold": (f"<script>if (a < b) document.write('</p><nav>')</script><p>{BODY}</p><STYLE>p > a {{}}</STYLE >", BODY.strip()),
    "a script without an end": (f"<p>{BODY}</p><script>var x = 1;", BODY.strip()),
    "void and self-closed elements": (f"<p>{BODY}<img src=a><br/>{BODY}<nav/>{BODY}</p>", "\n".join([BODY.strip()] * 3)),
    "signs that are no tags": (f"<p>1 <> 2. {BODY}</p>", f"1 <> 2. {BODY.strip()}"),
    "no end of a tag": (f"<p>{BODY}</p>a < b", f"{BODY.strip()}\na < b"),
    "upper case and attributes": (f'<DIV CLASS="a"><NAV ID=b>menu</NAV><P>{BODY}</P></DIV>', BODY.strip()),
    "entities": (f"<p>{BODY}&lt;nav&gt; &amp;amp; &eacute;</p>", f"{BODY}<nav> &amp; é"),
}


@pytest.mark.parametrize("name", PAGES)
def test_recorded_pages(name):
    page, want = PAGES[name]
    assert html._best(page) == want and html.unescape(html.scan(page)[0]) == want


@pytest.mark.parametrize("piece", ["<", "<p", "<p>", "<!--", "<nav>", "</nav>", "<script>", "<a>", "<>", "<nav><p>x</p>", "&", ">", "<!-- -->"])
def test_time_is_in_proportion_to_the_page(piece):
    def seconds(n):
        began = time.process_time()
        html.scan(piece * n)
        return time.process_time() - began

    seconds(1000)
    small, large = min(seconds(20_000) for _ in range(3)), min(seconds(160_000) for _ in range(3))
    assert large < 8 * 4 * max(small, 0.002)


def test_columns(spark):
    rows = spark.createDataFrame([(k, page) for k, (page, _) in enumerate(PAGES.values())] + [(98, None), (99, "")], "id int, page string")
    got = {r.id: r for r in rows.select("id", html.extract_text(F.col("page")).alias("best"), html.main_text(F.col("page")).alias("main"), html.strip_tags(F.col("page")).alias("bare")).collect()}
    assert [got[k].best for k in range(len(PAGES))] == [want for _, want in PAGES.values()] == [got[k].main for k in range(len(PAGES))]
    assert (got[98].best, got[98].main, got[98].bare, got[99].best, got[99].main, got[99].bare) == (None, None, None, None, "", "")
    assert got[0].bare.startswith("deep five four three two one A sentence")


#: Text with references, and as characters: only what ends with a semicolon and has a known name is one.
REFERENCES = {
    "a title cut within &amp;&amp;am": "a title cut within &&am",
    "a title cut before its end &amp;&amp": "a title cut before its end &&amp",
    "an address /a?b=1&copy=2&lt=3 of parameters": "an address /a?b=1&copy=2&lt=3 of parameters",
    "once only &amp;copy; &amp;amp; &#38;lt;": "once only &copy; &amp; &lt;",
    "numbers &#65; &#x42; and &#66 alone": "numbers A B and &#66 alone",
    "names &quot;&notin;&quot; and &notit; &Eacute;": 'names "∉" and &notit; É',
}


def _of_pages(spark, read, shape="<h1>{}</h1>"):
    rows = spark.createDataFrame([(k, shape.format(text)) for k, text in enumerate(REFERENCES)], "id int, page string")
    return [r.text for r in rows.select("id", read(F.col("page")).alias("text")).orderBy("id").collect()]


def test_all_text_decodes_whole_references_only(spark):
    assert _of_pages(spark, html.strip_tags) == list(REFERENCES.values())


def test_main_content_decodes_whole_references_only(spark):
    body = f"\n{BODY.strip()}"
    assert _of_pages(spark, html.extract_text, f"<h1>{{}}</h1><p>{BODY}</p>") == [text + body for text in REFERENCES.values()]


def test_cleaned_documents_keep_references_that_are_cut_off(spark):
    docs = spark.createDataFrame([(k, "", f"<h1>{text}</h1><p>{BODY}</p>", None) for k, text in enumerate(REFERENCES)], "id long, title string, fulltext string, fulltext_html string")
    chunks = spark.createDataFrame([], "id long, document_id long, chunk_index int, chunk_text string")
    cleaned, _, counters = maintenance.clean_html(docs, chunks)
    assert [r.fulltext for r in cleaned.orderBy("id").collect()] == [f"{text}\n{BODY.strip()}" for text in REFERENCES.values()]
    assert counters.first()[:] == (len(REFERENCES), len(REFERENCES), 0)


def test_captured_pages_keep_references_that_are_cut_off(spark):
    more = BODY * 4  # shorter texts count as failed
    at = lambda k: f"https://pages.example/{k}"
    docs = spark.createDataFrame([(k, at(k), None, None, None) for k in range(len(REFERENCES))], "id long, url_original string, fulltext string, fulltext_source string, fulltext_fetched_at timestamp")
    captured = spark.createDataFrame([(at(k), 200, 1000, f"<h1>{text}</h1><p>{more}</p>", None) for k, text in enumerate(REFERENCES)], "url string, http_status int, content_length int, html string, error_kind string")
    failures = spark.createDataFrame([], "document_id long, job_id string, url string, error_type string, error_message string, http_status int, retry_count int, last_attempt timestamp")
    done = jobs.process_fetches(docs, captured, failures, job_id="j", now="2024-01-31 00:00:00")
    assert [r.fulltext for r in done["documents"].orderBy("id").collect()] == [f"{text}\n{more.strip()}" for text in REFERENCES.values()]
    assert done["counters"].first()[:] == (len(REFERENCES), len(REFERENCES), 0)
