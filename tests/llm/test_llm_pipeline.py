"""The corpus pipeline stage by stage, and the registered queries."""

import random

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
catalog = pytest.importorskip("quire.llm.catalog")

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    clean = [(i, text(80), "en", rng.choice("ab")) for i in range(40)]
    item, passage = text(15), text(70)
    copy = clean[0][1]
    rows = clean + [
        (50, copy, "en", "a"), (51, copy + " one more", "en", "b"), (60, text(30) + " " + item + " " + text(30), "en", "a"),
        (70, text(40) + " " + passage + " " + text(9), "en", "a"), (71, text(20) + " " + passage + " " + text(40), "en", "b"),
        (80, None, "en", "a"), (81, "12 34 ...", "en", "a"), (82, "", None, None), (None, text(50), "en", None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path)).cache()
        seen[name] = {r.doc_id: r for r in now.collect()}
        if name != "source mix":
            assert now.columns == before.columns
    ids = set(range(40)) | {50, 51, 60, 70, 71, None}
    assert set(seen["language ID"]) == ids
    assert set(seen["near-duplicates"]) == ids - {50, 51}
    cut = seen["repeated passages"]
    assert set(cut) == ids - {50, 51} and passage not in cut[70].text and passage not in cut[71].text
    assert len(cut[70].text.split()) >= 45 and all(cut[i].text == t for i, t, *_ in clean)
    assert set(seen["benchmark decontamination"]) == ids - {50, 51, 60}
    mix = seen["source mix"]
    assert set(mix) <= ids and all(1 <= r.copies <= 3 and r.taken == r.copies * r.size for r in mix.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(mix)


def test_language_rejects_what_was_not_learned(spark):
    rng = random.Random(3)
    make = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    one, two = make("aeioustrn"), make("aeiouklmpv")
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(one, 60), "xa") for i in range(30)] + [(30 + i, text(two, 60), "xb") for i in range(30)]
    rows += [(60, text(one, 5), None), (61, text(two, 300), None), (62, "token 9f81 77 " + text(one, 8) + " 123-456-789", None)]
    rows += [(70, text(make("bcdfghjqwxyz"), 60), None), (71, "".join(rng.choice("bcdfghjqwxyz ") for _ in range(400)), None)]
    rows += [(72, "это русский текст который не был выучен", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == set(range(63))


def test_near_copies_from_four_fifths(spark):
    base = [f"w{i}" for i in range(200)]
    edited = lambda k: " ".join(f"edit{k}x{i}" if i % 30 == 15 and i < 30 * k else w for i, w in enumerate(base))
    # 4 edits: 176 of 216 shingles (0.815); 5 edits: 171 of 221 (0.774)
    other = lambda t: t.replace("w", "v")
    rows = [(1, edited(0)), (2, edited(4)), (3, other(edited(0))), (4, other(edited(5)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4}


def test_repeated_ids_keep_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s"), (2, b, "s"), (2, a, "s"), (3, c, "t"), (3, c, "s"), (None, a, "s"), (None, a, "s"), (4, None, "s"), (4, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = [(1, a, "s"), (2, b, "s"), (3, c, "s"), (None, a, "s"), (None, a, "s"), (4, None, "s"), (4, "", "s")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHES = ["key", "row", "hash", "text_hash", "size", "target", "copies", "taken", "whole", "kept_text", "d1", "__key", "__kept", "n_words", "lang_pred"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_columns(spark, tmp_path, name, stage):
    """Columns that are called like helpers, and a map, go through every stage."""
    word = lambda i: f"word{i % 7}{'abcdefgh'[i % 8]}"
    shared = " ".join(f"shared{i}x" for i in range(60))
    rows = [(i, " ".join(word(i * 31 + j * j) + str(i) for j in range(70)) + (" " + shared if i < 2 else ""), "en", "ab"[i % 2], 9) for i in range(12)]
    rows += [rows[3], (None, None, None, None, None), (20, "", "en", "a", 0)]
    spark.createDataFrame([(1, shared)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plain = sorted(map(str, stage(spark, docs, str(tmp_path)).collect()))
    more = docs
    for c in CLASHES:
        more = more.withColumn(c, corpus_pipeline.F.lit(c))
    more = more.withColumn("tags", corpus_pipeline.F.create_map(corpus_pipeline.F.lit("k"), corpus_pipeline.F.col("doc_id")))
    out = corpus_pipeline.staged(stage(spark, more, str(tmp_path)), "clash-" + name.replace(" ", "-"))
    assert out.columns[: len(more.columns)] == more.columns
    assert all(r[c] == c for r in out.select(*CLASHES).collect() for c in CLASHES)
    back = out.drop(*CLASHES, "tags")
    for c in ("size", "source_size", "target", "copies", "taken"):
        back = back.withColumnRenamed(f"mix_{c}", c)
    assert sorted(map(str, back.collect())) == plain


def test_passages_are_counted_in_words(spark):
    long_words = " ".join(f"extraordinarily{i}" for i in range(40))  # over 240 bytes, 40 words
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"one {long_words} end"), (2, f"two {long_words} fin"), (3, f"three {passage} end"), (4, f"four {passage} fin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1]
    assert len(got[3].split()) <= 3 and len(got[4].split()) <= 3


def test_language_takes_one_python_pass(spark):
    from quire.llm import langid

    rng = random.Random(3)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, text("aeiourstln" if i % 2 else "кшнгдемаои"), "en" if i % 2 else "ru") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 ...", "en"), (103, text("漢字仮名交"), None), (104, rows[1][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language(spark, docs, "")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    # the same rows and figures as by one pass for each step
    model = langid.fit(docs.select("lang", "text"))
    by_row = docs.selectExpr("struct(doc_id, text) AS row", "text")
    found = langid.predict(model, by_row)
    two = langid.typical(model, found.selectExpr("row", "lang_pred AS lang", "row.text AS text"))
    want = {(r.row.doc_id, r.lang_pred, r.score) for r in found.collect()}, {(r.row.doc_id, r.lang, r.typical) for r in two.collect()}
    got = langid.judged(model, by_row).collect()
    assert ({(r.row.doc_id, r.lang_pred, r.score) for r in got}, {(r.row.doc_id, r.lang_pred, r.typical) for r in got}) == want
    least = langid.bounds(model, docs.select("lang", "text"))
    assert {r.doc_id for r in kept.collect()} == {d for d, x, t in want[1] if t is not None and t >= least[x]}


def test_small_tables_go_into_few_files(spark, monkeypatch):
    from quire.llm import common, decontaminate, mixing, neardup, suffix_dedup

    files, write = {}, common.staged

    def counted(df, label):
        out = write(df, label)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    for module in (neardup, neardup.connected_components.__globals__, suffix_dedup, decontaminate, mixing):
        (monkeypatch.setitem if isinstance(module, dict) else monkeypatch.setattr)(module, "staged", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, docs, SF).count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    named = ("nd-reps", "nd-heads", "nd-links", "nd-more", "nd-sizes", "cc-edges", "sd-texts", "sd-cores", "sd-twice", "sd-cut")
    named += ("dc-vocabulary", "dc-counts", "dc-rarest", "dc-terms", "dc-hits", "mx-near0", "mx-near1", "mx-near2")
    assert {k for k in named if files[k] > common.FEWEST_TASKS} == set()
