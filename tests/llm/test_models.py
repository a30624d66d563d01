"""The trained models, held out, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clicksieve.llm import language_id, packing, quality
from clicksieve.llm.common import staged
from tests.conftest import SF_DIR
from tests.llm.test_dedup import ascii_lower, brute_force

BIGGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{BIGGER}/documents.parquet")


def test_language_held_out(spark, documents):
    net = language_id.learn(documents, at_most=400)
    held = documents.where(language_id.held_out(F.col("doc_id")))
    ids = [r.doc_id for r in documents.select("doc_id").collect()]
    assert held.count() == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)
    right = language_id.identify(held, net).join(held.select("doc_id", "lang"), "doc_id").where("lang = lang_pred").count()
    assert right >= 0.97 * held.count()


def test_language_odd_texts(spark):
    net = language_id.train(["the of and " * 20, "der die das " * 20] * 4, ["en", "de"] * 4, epochs=2)
    texts = [None, "", "123 !?", "a", "der die das " * 5000, "\x00\x00b"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language_id.identify(docs, net).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and [got[i].score for i in range(3)] == [0.0] * 3
    assert got[4].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values()) and got[5].lang_pred in ("de", "en")
    assert language_id.identify(docs.limit(0), net).collect() == []
    nothing = language_id.learn(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_both_ways_to_apply_the_filters_agree():
    net = language_id.train(["abc def " * 40, "xyz uvw " * 40], ["a", "b"], epochs=1)
    windows, _ = language_id.windows_of("héllo wörld ".encode() * 60)
    assert abs(net.pooled(windows)[0] - net.maxima(windows)).max() < 1e-4


def test_quality_held_out(spark, documents):
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")
    model = quality.learn(documents, train)
    assert (model.thresholds[1:] >= model.thresholds[:-1]).all()
    judged = quality.score(documents, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r for r in judged if r.quality == 1 and r.toxic == 0]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert sum(not r.kept for r in judged if r.quality == 0) >= 0.8 * sum(r.quality == 0 for r in judged)
    assert all(0 <= r.tail <= 1 and r.tail <= r.expected_grade <= 2 for r in judged)


def test_quality_odd_texts(spark):
    model = quality.fit(["good words here", "bad### bad###"] * 5, [2, 0] * 5)
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (3, "good " * 20_000, 1), (4, "bad###", 1)], "doc_id long, text string, tail int")
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert got[1].tail == got[None].tail and got[3].tail > got[4].tail
    assert quality.score(docs.limit(0), model).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, labels)).count() == 4


def plain_least(least, text):
    """The least score of a text's length band, written plainly."""
    n = len(text.encode())
    return next((score for bound, score in zip(language_id.BANDS, least) if n < bound), least[-1])


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.learn(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    kept = []
    for r in docs.collect():
        slots, values = quality.features(r.text or "")
        if model.tails((model.weights[slots] @ values).reshape(1))[0][1] >= 0.5:
            kept.append(r)
    good = spark.createDataFrame(kept, docs.schema)
    net = language_id.learn(good)
    least = language_id.least_scores(good, net)
    told = []
    for r in kept:
        (name,), (score,) = language_id.predict(net, [r.text])
        if name != "und" and (name == r.lang or score >= plain_least(least, r.text)):
            told.append(r)
    first = {}
    for r in sorted(told, key=lambda r: r.doc_id):
        first.setdefault(ascii_lower(r.text or ""), r)
    left = {i for i, _, _, stays in brute_force([(r.doc_id, r.text) for r in first.values()], 80) if stays}
    got = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in got.select("doc_id").collect()} == left and 0 < len(left) < docs.count()


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_language_stage_keeps_what_it_tells_rightly(spark, scale):
    """In the pipeline's own order of stages; lettered texts of the language they are labelled."""
    sf_dir = f"/root/testdata/sf{scale}"
    docs = staged(corpus_pipeline.good_quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir), "quality-kept")
    told = language_id.identify(docs, language_id.learn(docs), keep=["lang"]).where("lang_pred = lang")
    stayed = corpus_pipeline.known_language(spark, docs, sf_dir)
    assert told.join(stayed, "doc_id", "left_anti").count() == 0


def test_language_stage_drops_what_fits_no_language(spark):
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet")
    odd = [(10_000_000, "12 34 -- !!", "en"), (10_000_001, None, "en"), (10_000_002, "", None)]
    more = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in odd], docs.schema)
    stayed = corpus_pipeline.known_language(spark, docs.unionByName(more), BIGGER)
    assert stayed.where("doc_id >= 10000000").count() == 0


def test_stages_keep_columns_and_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "the good and the fine text", "en", "s", 3, "x", 1.0), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "y", 2.0),
         (None, "some words", "en", None, 1, "z", 0.0), (1, "the good and the fine text", "en", "s", 3, "x", 1.0)],
        "doc_id long, text string, lang string, source string, n_chars long, kept string, `_doc` double",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == 5
    assert packing.pack(docs.limit(0), __import__("public_tokenizers").path("word_bpe_49k.json")).count() == 0
