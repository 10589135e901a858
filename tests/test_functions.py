"""Golden cases for the column functions (FIXTURES.md section 2)."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import urls as U
from quire.functions.timefmt import iso, parse_source_time
from quire.functions.transcript import chunk_lines, clean_vtt
from quire.operators import alerts, publish


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_video_ids(spark):
    cases = {
        "https://www.youtube.com/watch?v=abc123def45": "abc123def45",
        "https://youtu.be/abc123def45": "abc123def45",
        "https://www.youtube.com/shorts/abc123def45": "abc123def45",
        "https://example.com": None,
        "https://www.youtube.com/watch?t=1&v=abc123def45": None,
        "https://youtu.be/abc123": None,
    }
    for url, want in cases.items():
        assert one(spark, U.video_id, url) == want, url


def test_scrapable(spark):
    cases = {
        "https://netflix.com/a": False,
        "https://github.com/o/r": True,
        "https://github.com/o/r/blob/main/x": False,
        "https://e.com/a.png": False,
        "https://e.com/a.png?x=1": True,
        "nope": False,
    }
    for url, want in cases.items():
        assert one(spark, U.is_scrapable, url) is want, url
    assert one(spark, U.is_scrapable_strict, "https://netflix.com/a") is True
    assert one(spark, U.is_scrapable_strict, "https://x.com/a") is False


def test_url_title(spark):
    assert one(spark, U.url_title, "https://e.com/my-post_one.html") == "my post one"
    assert one(spark, U.url_title, "https://e.com/") == "e.com"
    assert one(spark, U.url_title, "nope") == "nope"


def test_vtt_clean(spark):
    vtt = "WEBVTT\n\n00:00:00.000 --> 00:00:05.000\nThis is the video transcript about AI tools\n"
    df = clean_vtt(spark.createDataFrame([(vtt,)], "v string"), "v", "t")
    assert df.first()["t"] == "This is the video transcript about AI tools"
    vtt2 = "WEBVTT\nKind: captions\n1\n00:01.000 --> 00:02.000\n<c>hello</c> there\nhello there\nnext\nhello there\n42\n12:30 lunch\n"
    df2 = clean_vtt(spark.createDataFrame([(vtt2,)], "v string"), "v", "t")
    assert df2.first()["t"] == "hello there next hello there"


def chunks(spark, text, limit=4000):
    return spark.createDataFrame([(text,)], "v string").select(chunk_lines(F.col("v"), limit).alias("c")).first()["c"]


def test_chunking_golden(spark):
    assert [len(c) for c in chunks(spark, "Line\n" * 1000)] == [3999, 1000]
    assert [len(c) for c in chunks(spark, "x" * 5000)] == [0, 5000]
    assert chunks(spark, "") == []


def test_html_escape(spark):
    out = one(spark, T.html_escape, '<script>alert("xss")</script> & co')
    assert "&lt;script&gt;" in out and "<script>" not in out and "&amp; co" in out


def test_truncate_and_slices(spark):
    assert len(one(spark, lambda c: T.truncate(c, 2000), "a" * 3000)) == 2000
    assert one(spark, lambda c: T.truncate(c, 2000), "a" * 3000).endswith("...")
    assert one(spark, lambda c: T.truncate(c, 50), "short") == "short"
    tags = spark.createDataFrame([(list("abcdefgh"),)], "t array<string>").select(F.slice("t", 1, 7).alias("s")).first()["s"]
    assert len(tags) == 7


def test_priority_and_marks(spark):
    df = spark.createDataFrame([([],)], "a array<struct<action:string,priority:string,context:string>>")
    assert df.select(publish.top_priority(F.col("a")).alias("p")).first()["p"] == "someday"
    got = [one(spark, T.score_marks, s, "double") for s in (10.0, 9.0, 8.0, 7.0, 6.0, 4.0, 3.0)]
    assert [len(g) for g in got] == [3, 3, 2, 2, 1, 1, 0]
    assert one(spark, T.js_number, 9.0, "double") == "9"
    assert one(spark, T.js_number, 8.5, "double") == "8.5"


def test_url_extract_and_spaces(spark):
    assert one(spark, T.extract_urls, "see https://a.b/c, and http://d.e") == ["https://a.b/c,", "http://d.e"]
    assert one(spark, T.extract_urls, "x https://a.b/c tail") == ["https://a.b/c"]
    assert one(spark, T.js_trim, "  hi 　") == "hi"


def test_source_time(spark):
    ts = one(spark, lambda c: iso(parse_source_time(c)), "Wed Oct 10 20:19:24 +0000 2018")
    assert ts == "2018-10-10T20:19:24.000Z"
    assert one(spark, lambda c: iso(parse_source_time(c)), "2024-01-02T03:04:05.678Z") == "2024-01-02T03:04:05.678Z"


def test_error_classification(spark):
    df = spark.createDataFrame(
        [("rate limit exceeded 429", True), ("some network error", True), ("unknown command", True)],
        "raw_message string, auth_valid boolean",
    )
    got = {r["raw_message"]: (r["code"], r["retryable"], r["alert_kind"]) for r in alerts.alerts(df).collect()}
    assert got["rate limit exceeded 429"] == ("RATE_LIMIT", True, "error")
    assert got["some network error"] == ("NETWORK", True, "error")
    assert got["unknown command"] == ("UNKNOWN", False, "error")
    bad = spark.createDataFrame([("some network error", False)], "raw_message string, auth_valid boolean")
    assert alerts.alerts(bad).first()["alert_kind"] == "auth_expired"


def test_status_id_takes_the_part_after_status(spark):
    keys = ["https://x.com/a/status/123", "https://x.com/a/status/123?s=20", "https://x.com/a/status/e2e-1/photo/1", "e2e-tweet-123", "77", ""]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(U.status_id("k")).collect()] == ["123", "123", "e2e-1", "e2e-tweet-123", "77", None]


def test_errors_from_elsewhere_are_unknown_and_not_retried(spark):
    df = spark.createDataFrame(
        [("rate limit 429", True, False), ("rate limit 429", True, True), ("x", True, None), ("x", False, False)],
        "raw_message string, auth_valid boolean, from_source boolean",
    )
    got = [(r["code"], r["retryable"], r["message"], r["alert_kind"]) for r in alerts.alerts(df).collect()]
    assert got[0] == ("UNKNOWN", False, "rate limit 429", "error") and got[1][:2] == ("RATE_LIMIT", True)
    assert got[2] == ("UNKNOWN", False, "x", "error") and got[3][3] == "auth_expired"


def test_article_excerpt_and_site_from_metadata(spark):
    from quire.operators.enrich import parse_articles

    head = {
        "a": """<meta name="description" content="It's short"><meta content='My "Site"' property='og:site_name'/>""",
        "b": """<meta name="keywords" content="k"><meta name="description" content="  ">""",
        "c": "",
    }
    pages = spark.createDataFrame(
        [(f"https://h.example/{k}", f"<html><head>{v}</head><body>t</body></html>") for k, v in head.items()], "url string, html string"
    )
    got = {r["url"][-1]: (r["excerpt"], r["site_name"]) for r in parse_articles(pages).collect()}
    assert got == {"a": ("It's short", 'My "Site"'), "b": (None, "h.example"), "c": (None, "h.example")}


def test_caption_files_by_name_and_folder(spark, tmp_path):
    from quire.operators.ingest import read_captions

    (tmp_path / "abc.en.vtt").write_text("WEBVTT\n\nhello")
    (tmp_path / "12345678901.vtt").write_text("WEBVTT")
    (tmp_path / "blank.vtt").write_text("  ")
    (tmp_path / "video_id=00e1").mkdir()
    (tmp_path / "video_id=00e1" / "part-0.txt").write_text("text")
    got = {r["video_id"]: r["vtt"] for r in read_captions(spark, str(tmp_path)).collect()}
    assert got == {"abc": "WEBVTT\n\nhello", "12345678901": "WEBVTT", "00e1": "text"}
