"""Bookmark files in array form, read by blocks, against the reader of whole files."""

import json
import os
import random

import pytest

from quire.operators import ingest

TRICKY = [
    {"id": "1", "text": 'a } b { "q" \\ [', "author": {"username": "u", "name": "}]\\\\"}},
    {"id": "2", "text": "\\\"}", "media": [{"type": "photo", "url": "x"}, {}], "e": {}},
    {},
    {"deep": [[{"a": [{"b": "}{"}]}], "é}ü", "日本}"]},
]


def texts(rng: random.Random) -> dict[str, str]:
    big = [dict(rng.choice(TRICKY), n=i, pad="}\\\"{é" * rng.randrange(30)) for i in range(400)]
    return {
        "big": json.dumps(big, ensure_ascii=False),
        "indented": json.dumps(big[:50], indent=2),
        "mixed": '﻿ [1, "x}", null, {"a": 1} , [2, {"b": 3}], {"c": "]"}, true ]\n',
        "object": json.dumps(TRICKY[0]),
        "object_newline": json.dumps(TRICKY[1], indent=1) + "\n",
        "empty_array": " [ ] ",
        "one": "[{}]",
        "cut": '[{"a": 1}, {"b": ',
        "scalars": "[1, 2, 3]",
    }


def canonical(rows):
    out = []
    for r in rows:
        try:
            out.append(json.dumps(json.loads(r.raw), sort_keys=True))
        except (TypeError, ValueError):
            out.append("broken")
    return sorted(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("arrays")
    for name, text in texts(random.Random(3)).items():
        os.makedirs(root / name)
        (root / name / "f.json").write_text(text, encoding="utf-8")
    return root


@pytest.mark.parametrize("name", [n for n in texts(random.Random(3)) if n not in ("cut", "mixed")])
def test_blocks_equal_whole_files(spark, folder, name):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        path = str(folder / name)
        got = canonical(ingest.split_bookmarks(spark, path).collect())
        assert got == canonical(ingest.read_bookmarks(spark, path).collect())
        if name == "big":
            parts = spark.read.text(path, lineSep="}").select("_metadata.file_block_start").distinct().count()
            assert parts > 10 and len(got) == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_elements_that_are_not_objects(spark, folder):
    got = canonical(ingest.split_bookmarks(spark, str(folder / "mixed")).collect())
    assert got == sorted(["1", '"x}"', "null", '{"a": 1}', '[2, {"b": 3}]', '{"c": "]"}', "true"])


def test_cut_file_keeps_what_is_whole(spark, folder):
    got = canonical(ingest.split_bookmarks(spark, str(folder / "cut")).collect())
    assert got == ["broken", '{"a": 1}']


def test_several_files_at_once(spark, folder):
    paths = [str(folder / n) for n in ("big", "one", "object")]
    got = canonical(ingest.split_bookmarks(spark, paths).collect())
    assert got == sorted(sum((canonical(ingest.read_bookmarks(spark, p).collect()) for p in paths), []))


def test_caption_lines_of_many_videos_come_from_few_files(spark, tmp_path):
    path = str(tmp_path / "captions")
    rows = [("a", "WEBVTT\n\n00:00.000 --> 00:01.000\nhi"), ("b", "  "), ("c", None), ("a", "WEBVTT")]
    spark.createDataFrame(rows, "video_id string, vtt string").coalesce(1).write.json(path)
    got = ingest.read_caption_lines(spark, path)
    assert len(got.inputFiles()) == 1
    assert sorted(map(tuple, got.collect())) == sorted([rows[0], rows[3]])
