"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from tallyhawk.llm import chat, decontaminate, embed_dedup, html_extract, near_dup, packing, quality, secrets, suffix_tree, token_counts

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [None, "", "one", "one", "two words\x00here", "Ünïcode ſtrange İtext 日本語 😀", 'token = "abcdefABCDEF0123456789"', LONG, LONG + " tail", "a b c d e f g h i j k l"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "en", "s", len(t or ""), "clash", "clash2") for i, t in enumerate(TEXTS)] + [(2, "one", "en", "s", 3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string, _rank string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "b c d e f g h i j k l"), (2, None), (3, "one"), (4, "ONE!"), (None, "two")], "item_id long, text string")


def test_tokens(docs):
    got = token_counts.count_tokens(docs).collect()
    assert len(got) == 11 and {r["n_tokens"] for r in got if r["n_bytes"] == 0} == {0} and any(r["over_limit"] for r in got)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_secrets(docs):
    got = secrets.scan(docs).collect()
    assert len(got) == 11 and sum(r["n_assign"] for r in got) == 1
    out = secrets.scan(docs, redact=True)
    assert out.columns == docs.columns and out.where("text is null").count() == 1 and out.where("text like '%[SECRET:assign]%'").first()["n_chars"] == 16
    assert secrets.scan(docs.limit(0)).count() == 0


def test_suffix_tree(docs):
    got = suffix_tree.score_texts(docs).collect()
    assert len(got) == 11 and all(r["score"] < 0 and r["base_score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert suffix_tree.score_texts(docs.limit(0)).count() == 0


def test_packing(docs):
    got = packing.pack(docs).collect()
    assert sum(r["length"] for r in got) == sum(r["doc_tokens"] for r in got if r["start"] == 0)
    assert packing.pack(docs.limit(0)).count() == 0


def test_quality(docs, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_near_duplicates(docs):
    got = near_dup.near_duplicates(docs).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by[3]["class_id"] == 2 and by[8]["class_id"] == 7 and not by[8]["kept"]
    assert by[None]["kept"] and by[None]["class_id"] is None and by[0]["kept"] and by[1]["kept"] and by[9]["kept"]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_leaks(docs, benchmark, limit):
    got = decontaminate.find_leaks(docs, benchmark, broadcast_words=limit).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 11 and by[9]["n_hit"] == 11 and by[9]["n_items"] == 1
    assert by[2]["n_items"] == 2 and by[3]["contaminated"] and by[None]["n_hit"] == 1 and by[None]["n_items"] == 0
    assert by[0]["n_words"] == 0 and not by[7]["contaminated"]
    assert decontaminate.find_leaks(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0


def test_vectors_of_any_magnitude(spark):
    v = [1.0, 2.0, -3.0, 0.5, 4.0, 1.0, 1.0, 2.0]
    rows = [(i, [c * m for c in v], 1) for i, m in enumerate((1.0, 1e200, 1e-200, 1e300, 1e-300))]
    got = embed_dedup.link_counts(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(4, 0)}


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(12)
    a = rng.normal(size=16)
    rows = [(i, [float(c) for c in a + 0.03 * rng.normal(size=16)], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = {tuple(r) for r in embed_dedup.link_counts(df).collect()}
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "TILE", 5)
    assert {tuple(r) for r in embed_dedup.link_counts(df).collect()} == whole


def test_leaks_keep_no_column_twice(spark, benchmark):
    d = spark.createDataFrame([(1, "b c d", 7, "x")], "doc_id long, text string, n_hit int, term string")
    got = decontaminate.find_leaks(d, benchmark, keep=("n_hit", "term"))
    assert sorted(got.columns) == sorted(set(got.columns)) and got.first()["term"] == "x"


def test_leaks_find_near_phrases(spark, benchmark):
    d = spark.createDataFrame([(1, "b c d e f g h i X j k l")], "doc_id long, text string")
    r = decontaminate.find_leaks(d, benchmark).first()
    assert not r["contaminated"] and r["n_near"] == 1


def test_html(spark):
    pages = [None, "", "plain &amp; text", "<p>a<br>b<p>c", "<script>x<", "<!-- open", "<div class='cookie-notice'>no</div><article><h1>T</h1><p>One, two. Three!</p><div class='comments'><p>no, never. no!</p></div><ul><li>x</li></ul></article><footer>f</footer>", "<div" * 3000, "<p>" + "long, text. " * 20_000]
    df = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[0] == got[1] == got[4] == got[5] == "" and got[2] == "plain & text" and got[3] == "a b\nc"
    assert got[6] == "T\nOne, two. Three!\nx" and len(got[8]) > 200_000
    assert html_extract.extract(df.limit(0)).count() == 0


def test_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.normal(size=16)
    near = [a, a * 2, a + 0.01 * rng.normal(size=16), a + 0.01 * rng.normal(size=16)]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(near)] + [(4, [float(x) for x in a], 2), (5, [float(x) for x in a], None), (6, None, 1), (7, [0.0] * 16, 1), (8, [float("nan")] * 16, 1), (9, [None] * 16, 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, [float(x) for x in a], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embed_dedup.link_counts(df).collect()}
    assert len(got) == 13 and [got[i]["n_links"] for i in range(4)] == [4] * 4 and [got[i]["component_id"] for i in range(4)] == [0] * 4
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(4, 12)) and got[None]["n_links"] == 0 and got[None]["kept"]
    assert embed_dedup.link_counts(df.limit(0)).count() == 0


def test_chat(spark):
    t = spark.createDataFrame([(0, 0, "user", "q", 1), (0, 1, "assistant", "good", 1), (1, 0, "user", "q", 1), (1, 1, "assistant", None, 1), (2, 0, None, "x", 1), (None, 0, "user", "lost", 1)], "conv_id long, turn long, role string, text string, pair_id long")
    got = {r["pair_id"]: r for r in chat.format_preferences(t, chat.neighbours(t)).collect()}
    assert got[0]["n_prefix_turns"] == 1 and got[0]["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    (start, end), text = map(int, got[0]["chosen_mask"].split(":")), None
    text = got[0]["chosen"][start:end]
    assert text == "good<|im_end|>" and got[0]["rejected"][slice(*map(int, got[0]["rejected_mask"].split(":")))] == "<|im_end|>"
    assert got[1]["n_prefix_turns"] == 0 and got[1]["rejected"] == ""
    assert chat.format_preferences(t.limit(0), chat.neighbours(t.limit(0))).count() == 0


def test_pipeline_stages(spark, docs, labels, benchmark, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        assert out.count() >= 0
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {0, 1, 2, None, 5, 6, 7, 9}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()}
    assert kept == {0, 1, 5, 6, 7, 8}


def test_spark_crc_is_the_same(spark):
    got = spark.range(20).select(F.crc32(F.col("id").cast("string").cast("binary"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) for i in range(20)]


def test_quality_bounds_repeated_ids(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(40)] + [(1, "text number 0")] * 40 + [(2, "other words")] * 40, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4)], "doc_id long, quality int")
    learnt = []
    learn = quality.Ftrl.learn
    monkeypatch.setattr(quality.Ftrl, "learn", lambda self, *a: learnt.append(1) or learn(self, *a))
    quality.train(docs, labels, folds=1_000_003, epochs=1)
    assert len(learnt) == 41  # each different text once
    learnt.clear()
    quality.train(docs, labels, folds=1_000_003, epochs=1, sample=10)
    assert len(learnt) == 10
