import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import html, text, vectors


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalize_url(spark):
    given = ["HTTP://WWW.Example.com/A/?x=1#f", "https://a.www.b.com/", "https://e.com/x;y?z", "", None, "  ", "https://e.com///", "example.com/a/", "https://e.com/a;b/c"]
    assert column(spark, given, text.normalize_url) == ["https://example.com/a", "https://a.b.com", "https://e.com/x", None, None, None, "https://e.com", "example.com/a", "https://e.com/a;b/c"]
    assert column(spark, ["http://www.e.com/a/"], lambda c: text.normalize_url(c, strip_www=False)) == ["https://www.e.com/a"]


def test_text_hash(spark):
    a, b, c, d, e, f = column(spark, ["a  b", " a b ", "a b", "é", "é", None], text.text_hash)
    assert a == b == c and d == e and len(a) == 16 and f is None


def test_category(spark):
    frame = spark.createDataFrame([("Articles", None), (None, None), ("pdf", "https://www.LinkedIn.com/p"), (" Tweets ", None), ("", None)], "c string, u string")
    assert [r[0] for r in frame.select(text.normalize_category(F.col("c"), F.col("u"))).collect()] == ["article", "article", "linkedin", "tweet", "article"]


def test_small_functions(spark):
    assert column(spark, ["abcdefg", "", None], text.estimate_tokens) == [1, 0, None]
    assert column(spark, [30_000, None, 0], text.reading_hours, "long") == [2.0, 0.0, 0.0]
    assert column(spark, ["2025-12-01T10:00", "", None, "yesterday!!"], text.format_date) == ["01.12.2025", "-", "-", "yesterday!"]
    assert column(spark, ["a, ,b ,", ""], text.split_list) == [["a", "b"], []]
    assert column(spark, ["x" * 81, "short"], text.cap_title) == ["x" * 77 + "...", "short"]
    assert column(spark, ["ABC x", "äÄ", None], lambda c: text.contains_ascii_folded(c, "bc")) == [True, False, None]
    assert column(spark, ["<div>", "a <P> b", "plain", None], text.looks_like_html) == [True, True, False, None]
    assert column(spark, ["https://www.Example.com:80/x", "x"], text.url_host) == ["example.com:80", ""]


@pytest.mark.parametrize("size", [20, 31])
def test_truncate(spark, size):
    def brute(t):
        if len(t) <= size:
            return t
        at = t[:size].rfind(" ")
        return (t[:at] if at > size * 0.8 else t[:size]) + "..."

    given = ["word " * 10, "x" * 50, "short", "a" * 18 + " " + "b" * 30, ""]
    assert column(spark, given, lambda c: text.truncate_at_space(c, size)) == [brute(x) for x in given]


def test_replies(spark):
    given = ['{"topic_name": "T", "summary": "s", "key_points": ["p"]}', '```json\n{"topic_name": "T"}\n```', "{broken", None]
    got = [(r[0].topic_name, r[0].summary, r[0].key_points) for r in spark.createDataFrame([(x,) for x in given], "v string").select(text.topic_reply(F.col("v"), F.lit(2))).collect()]
    assert got == [("T", "s", ["p"]), ("T", "", []), ("Thema 3", "", []), ("Thema 3", "", [])]


def test_html(spark):
    assert column(spark, ["<p>a&amp;b</p><script>x</script>"], html.strip_tags) == ["a&b"]
    assert column(spark, ["<p>0123456789</p>", "<p>0123456789x</p>", "", None, "  "], html.extract_text) == [None, "0123456789x", None, None, None]
    page = "<html><head><title>t</title></head><body><nav><a href=x>menu entry</a></nav><article><p>" + "Real content stands here. " * 4 + "</p><p><a href=y>only a link</a></p></article><footer>imprint</footer></body></html>"
    (found,) = column(spark, [page], html.extract_text)
    assert found.startswith("Real content") and not any(x in found for x in ("menu", "imprint", "only a link"))


def test_vectors(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "v array<float>")
    blob = vectors.encode_vectors(frame, "v")
    assert [len(r.blob) for r in blob.collect()] == [12, 12]
    assert [r.back for r in vectors.decode_vectors(blob, "blob", "back").collect()] == [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]]
    assert [r.back for r in vectors.decode_vectors(blob.withColumn("b", F.base64("blob")), "b", "back").collect()] == [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0]]
    one = F.array(F.lit(2.0), F.lit(4.0), F.lit(6.0))
    assert [round(r[0], 9) for r in frame.select(vectors.cosine_similarity(F.col("v"), one)).collect()] == [1.0, 0.0]


def test_periods(spark):
    at = [datetime.datetime(2025, 1, 31, 5), datetime.datetime(2025, 1, 23), datetime.datetime(2024, 12, 31)]
    for period, want in (("today", [True, False, False]), ("week", [True, False, False]), ("month", [True, True, False]), ("all", [True] * 3)):
        assert column(spark, at, lambda c, p=period: text.in_period(c, p, "2025-01-31 12:00:00"), "timestamp") == want
