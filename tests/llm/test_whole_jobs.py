"""Places where an operator once did less than its whole job."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clicksieve.llm import exact_dedup, language_id, license_scan, lm_score, near_dedup
from tests.conftest import SF_DIR
from tests.llm.test_dedup import documents, family, shingles

BIGGER = "/root/testdata/sf0.01"


def components(texts, percent):
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}
    edges = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near_copies():
    """Families whose links lie on both sides of 80 and 85 percent, short sets and long ones."""
    draw = random.Random(8)
    texts = [None, "", "one two"]
    for size, n_words, edits in ((120, 140, 5), (60, 400, 14), (40, 64, 2), (40, 30, 1), (20, 52, 1), (5, 3000, 90)):
        texts += family(draw, size, n_words, edits)
    return list(enumerate(texts))


def test_near_duplicates_at_80(spark):
    listed = near_copies()
    want = components(listed, 80)
    assert want != components(listed, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, listed), percent=80).collect()}
    assert got == want
    assert near_dedup.shared_values(85) == 38 and near_dedup.whole_up_to(85) == 54


def test_near_copies_stage_links_at_80(spark):
    listed = near_copies()
    left = corpus_pipeline.without_near_copies(spark, documents(spark, listed), SF_DIR)
    assert {r.doc_id for r in left.collect()} == {i for i, label in components(listed, 80).items() if i == label}


def test_lm_scores_count_every_word(spark):
    """Rare words beyond any vocabulary: no two of the unrelated pairs of them are one pair."""
    draw = random.Random(5)
    frequent = " ".join(f"f{i} f{i}" for i in range(66_000))
    texts = [frequent, *(" ".join(f"r{draw.randrange(10**9)}" for _ in range(20)) for _ in range(30)), "both here", "both here now"]
    docs = documents(spark, list(enumerate(texts)))
    words = [t.split() for t in texts]
    one, own = Counter(w for t in words for w in t), [Counter(zip(t, t[1:])) for t in words]
    two = sum(own, Counter())
    for block_bytes in (1 << 23, 2_000):
        got = {r.doc_id: r for r in lm_score.lm_scores(docs, block_bytes=block_bytes).collect()}
        assert len(got) == len(texts)
        everything = sum(one.values())
        for i, (t, mine) in enumerate(zip(words, own)):
            score, seen = 0.0, 0
            for pair in zip(t, t[1:]):
                if two[pair] > mine[pair]:
                    score, seen = score + math.log((two[pair] - mine[pair]) / one[pair[0]]), seen + 1
                else:
                    score += math.log(0.4 * one[pair[1]] / everything)
            assert (got[i].n_words, got[i].n_seen) == (len(t), seen) and abs(got[i].log_score - score) < 1e-3


@pytest.mark.parametrize("block_bytes", [1 << 23, 300])
def test_lm_scores_by_ranges_of_keys(spark, monkeypatch, block_bytes):
    """Many ranges and blocks give what one range gives; a word of every text and rows without id are in it."""
    draw = random.Random(8)
    texts = ["the " + " ".join(f"w{int(draw.paretovariate(0.7))}" for _ in range(draw.randrange(60))) for _ in range(120)]
    docs = documents(spark, [*((i if i % 9 else None, t) for i, t in enumerate(texts)), (500, None), (501, ""), (502, "alone")])
    want = sorted(map(tuple, lm_score.lm_scores(docs, block_bytes=block_bytes).collect()), key=repr)
    monkeypatch.setattr(lm_score, "RANGE_ENTRIES", 8)
    got = lm_score.lm_scores(docs, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 123


def test_numbers_are_packed_and_unpacked():
    for values in ([0], [1, 255], [256, 0, 3], [2**64 - 1, 5], [2**47, 2**40 + 1]):
        packed = lm_score.packed_numbers(np.array(values, np.uint64))
        assert lm_score.unpacked_numbers(packed, len(values)).tolist() == values
        assert len(packed) == len(values) * max(1, (max(values).bit_length() + 7) // 8)


def test_lm_scores_of_repeated_rows(spark):
    got = lm_score.lm_scores(documents(spark, [(1, "a b"), (2, "a b c"), (1, "a b")]))
    assert [tuple(r)[:3] for r in got.orderBy("doc_id", "n_words").collect()] == [(1, 2, 1), (1, 2, 1), (2, 3, 1)]


def test_language_stage_goes_by_the_network(spark):
    """Gibberish goes, and with nothing labelled every text with a letter stays."""
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet")
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    gibberish = [" ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(60)) for _ in range(50)]
    strange = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(gibberish)], "doc_id long, text string")
    mixed = docs.unionByName(strange, allowMissingColumns=True)
    left = {r.doc_id for r in corpus_pipeline.known_language(spark, mixed, BIGGER).select("doc_id").collect()}
    assert sum(10**6 + i not in left for i in range(50)) >= 25
    lettered = {r.doc_id for r in docs.collect() if r.text and language_id.has_letter(r.text)}
    assert len(lettered - left) <= 0.005 * len(lettered)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.known_language(spark, unlabelled, BIGGER)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == lettered


def test_license_scan_of_a_long_text_takes_linear_time(spark):
    """A million words with a phrase at every hundredth; a copy of the words per gram would not end."""
    text = " ".join("mit license" if i % 99 == 0 else f"w{i % 9973}" for i in range(1, 1_000_000))
    docs = spark.createDataFrame([(1, text), (2, text), (2, None)], "doc_id long, text string")
    began = time.monotonic()
    got = sorted(license_scan.scan(docs).collect(), key=lambda r: (r.doc_id, r.n_words))
    assert time.monotonic() - began < 120
    n = len(text.split())
    assert [(r.doc_id, r.n_words, r.n_base) for r in got] == [(1, n, n - 999_999), (2, 0, 0), (2, n, n - 999_999)]
    assert got[0].first_word == 98 and got[0].labels == "mit"


def test_license_templates_of_the_caller_are_checked(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    assert license_scan.scan(docs, {}, {"two three four five six": "own"}).first().labels == "own"
    with pytest.raises(ValueError, match="positions"):
        license_scan.scan(docs, {}, {" ".join(map(str, range(license_scan.MOST_POSITIONS + 5))): "long"})


def test_exact_dedup_merges_sorted_runs(spark):
    docs = spark.createDataFrame([(i, f"Text {i % 7}") for i in range(50)] + [(None, "text 1"), (None, "alone")], "doc_id long, text string")
    runs = exact_dedup.signatures(docs, 2, 8, "doc_id", "text").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1))
    merged = exact_dedup._merge(runs, F.min, 0, 2, 8)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("SortAggregate") == 2 and plan.count("Exchange") == 1
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect()}
    sizes = {i: sum(j % 7 == i for j in range(50)) + (i == 1) for i in range(7)}
    assert got == {(i, i % 7, sizes[i % 7], i < 7) for i in range(50)} | {(None, 1, sizes[1], False), (None, None, 1, True)}
