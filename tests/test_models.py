"""Image and digest models: validation of their answers, and the poll with an image model."""

import json

from pyspark.sql import functions as F

from quire.operators import digest, inference
from test_poll_sinks import NOW, SF, stores
from quire.plans import poll
from quire.sources import fixtures as fx

IMAGE = {"description": "d", "hasText": True, "extractedText": "t", "contentType": "photo", "keyElements": ["a", "b"], "relevance": "r"}
DIGEST = {"digest": "d", "patterns": ["p"], "recommendations": [], "topPicks": [{"summary": "s", "why": "w"}]}


def _answers(spark, answers):
    return spark.createDataFrame([(k, json.dumps(v) if not isinstance(v, str) else v) for k, v in answers.items()], "url string, output string")


def test_images_are_asked_once_and_checked(spark):
    answers = {
        "u1": IMAGE, "u2": "{x", "u3": {**IMAGE, "contentType": "painting"}, "u4": {**IMAGE, "keyElements": None},
        "u5": {k: v for k, v in IMAGE.items() if k != "relevance"}, "u6": {**IMAGE, "extractedText": "", "keyElements": []},
    }
    asked = []

    def model(urls):
        asked.append(sorted(r.url for r in urls.collect()))
        return _answers(spark, answers)

    wanted = spark.createDataFrame([(u,) for u in [*answers, "u1", None]], "url string")
    described, rejected = inference.describe_images(wanted, model)
    assert {r.url: r.description for r in described.collect()} == {"u1": "d\n📝 Text: t\n🔑 Key elements: a, b", "u6": "d"}
    assert {r.url: r.reason for r in rejected.collect()} == {
        "u2": "malformed_json", "u3": "contentType", "u4": "keyElements", "u5": "required_field"
    }
    assert asked == [sorted(answers)]


def test_digest_answers_are_checked(spark):
    answers = {
        "ok": DIGEST, "text": "no", "none": {**DIGEST, "patterns": None}, "picks": {**DIGEST, "topPicks": DIGEST["topPicks"] * 4},
    }
    ok, bad = inference.validate_digests(_answers(spark, answers))
    assert [r.url for r in ok.collect()] == ["ok"]
    assert {r.url: r.reason for r in bad.collect()} == {"text": "malformed_json", "none": "required_field", "picks": "topPicks"}


def test_digest_model_gets_the_request(spark):
    rows = fx.ledger_rows(spark, SF)
    inp = digest.digest_input(rows)

    def model(requests):
        return requests.select(F.when(F.col("prompt").contains("TOP HIGHLIGHTS:"), json.dumps(DIGEST)).alias("output"))

    ok, bad = digest.model_digest(inp, model)
    assert bad.count() == 0
    assert ok.select(digest.render(F.col("digest"))).first()[0].endswith("- p")
    empty, none = digest.model_digest(digest.digest_input(rows.where("false")), model)
    assert empty.count() == none.count() == 0


def test_poll_with_an_image_model(spark, tmp_path):
    raw = fx.raw_posts_pages(spark, SF)
    said = "seen by the model"

    def model(urls):
        return urls.select("url", F.lit(json.dumps({**IMAGE, "description": said})).alias("output"))

    poll.run_poll(spark, raw, stores(spark), str(tmp_path / "l"), str(tmp_path / "p"), 0, NOW, image_model=model, markdown=True)
    texts = spark.read.parquet(str(tmp_path / "l")).where(F.col("raw_data").contains('"imageAnalysis":["'))
    assert texts.count() > 0 and texts.where(~F.col("raw_data").contains(said)).count() == 0
