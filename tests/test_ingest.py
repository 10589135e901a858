"""Ingest and thread golden cases (FIXTURES.md 1-4, 24-26, 29, 30)."""

import json

from pyspark.sql import functions as F

from quire.operators import enrich, ingest


def post(i, **kw):
    p = {"id": str(i), "text": f"post {i}", "createdAt": "2024-01-01T00:00:00.000Z",
         "author": {"username": "u", "name": "U"}}
    p.update(kw)
    return p


def raw_df(spark, objs):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objs], "raw string")


def test_valid_and_quarantine(spark):
    bad = post(9)
    del bad["author"]
    posts, q = ingest.ingest(raw_df(spark, [post(1), bad, post(2), post(3, id=3), "{not json",
                                           post(4, media=[{"type": "sticker", "url": "u"}])]))
    assert sorted(r["id"] for r in posts.collect()) == ["1", "2"]
    assert sorted(r["reason"] for r in q.collect()) == ["author", "id", "malformed_json", "media"]


def test_bookmark_files_array_object_empty(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([post(1), post(2)]))
    (tmp_path / "b.json").write_text(json.dumps(post(3)))
    (tmp_path / "c.json").write_text("[]")
    got = ingest.read_bookmarks(spark, str(tmp_path))
    posts, _ = ingest.ingest(got)
    assert sorted(r["id"] for r in posts.collect()) == ["1", "2", "3"]


def test_thread_flag_urls_images(spark):
    media = [{"type": "video", "url": "https://img/v.jpg", "videoUrl": "https://v/x.mp4"},
             {"type": "photo", "url": "https://img/p.jpg"}]
    objs = [post(1, conversationId="1"), post(2, conversationId="1"), post(3),
            post(4, text="see https://a.b/c", media=media)]
    posts, _ = ingest.ingest(raw_df(spark, objs))
    got = {r["id"]: r for r in posts.collect()}
    assert [got[k]["is_thread"] for k in "123"] == [False, True, False]
    assert got["4"]["urls"] == ["https://a.b/c", "https://v/x.mp4"]
    assert got["4"]["images"] == ["https://img/v.jpg", "https://img/p.jpg"]


def test_best_variant_ties_keep_first(spark):
    variants = [{"bitrate": 1, "content_type": "video/mp4", "url": "one"},
                {"bitrate": 9, "content_type": "video/mp4", "url": "first9"},
                {"bitrate": 9, "content_type": "video/mp4", "url": "second9"}]
    item = {"type": "video", "media_url_https": "m", "sizes": {"medium": {"w": 10, "h": 5}},
            "video_info": {"duration_millis": 5, "variants": variants}}
    schema = ("post_id string, extended_media array<struct<type:string,media_url_https:string,"
              "sizes:struct<large:struct<w:bigint,h:bigint>,medium:struct<w:bigint,h:bigint>,small:struct<w:bigint,h:bigint>>,"
              "video_info:struct<duration_millis:bigint,variants:array<struct<bitrate:bigint,content_type:string,url:string>>>>>,"
              "basic_media array<struct<type:string,media_url_https:string,"
              "sizes:struct<large:struct<w:bigint,h:bigint>,medium:struct<w:bigint,h:bigint>,small:struct<w:bigint,h:bigint>>,"
              "video_info:struct<duration_millis:bigint,variants:array<struct<bitrate:bigint,content_type:string,url:string>>>>>")
    df = spark.createDataFrame([json.dumps({"post_id": "p", "extended_media": [item]})], "string").select(
        F.from_json("value", schema).alias("s")).select("s.*")
    m = ingest.extract_media(df).first()["media"][0]
    assert m["videoUrl"] == "first9" and m["width"] == 10 and m["previewUrl"] is None


def test_thread_expand_excludes_self_and_bad_threads(spark):
    members = spark.createDataFrame(
        [("c1", "thread-1", 0, "a", True), ("c1", "thread-2", 1, "b", True),
         ("c2", "x-1", 0, "a", True), ("c2", "x-2", 1, "b", False)],
        "conversation_id string, member_id string, turn bigint, text string, valid boolean")
    bookmarks = spark.createDataFrame([("thread-1", "c1", True), ("x-1", "c2", True)],
                                      "id string, conversation_id string, is_thread boolean")
    got = [(r["post_id"], r["member_id"]) for r in enrich.expand_threads(bookmarks, members).collect()]
    assert got == [("thread-1", "thread-2")]


def test_bookmark_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(post(i)) for i in range(5)) + "\n")
    posts, q = ingest.ingest(ingest.read_bookmark_lines(spark, str(tmp_path)))
    assert posts.count() == 5 and q.count() == 0
