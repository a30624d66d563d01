"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clicksieve.llm import exact_dedup, near_dedup
from clicksieve.llm.common import OTHER_UPPER_CASE, lower_ascii
from tests.conftest import rows

SCHEMA = "doc_id long, text string, keep_id string, _run int, digest string"


def documents(spark, pairs):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in pairs], SCHEMA)


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_lower_ascii_changes_a_to_z_only(spark):
    points = [c for c in range(1, 0x11000) if not 0xD800 <= c <= 0xDFFF]
    texts = spark.createDataFrame([(c, f"aZ{chr(c)}") for c in points], "c int, t string")
    wrong = texts.where(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") != lower_ascii(F.col("t")))
    assert wrong.count() == 0
    assert texts.where(F.col("t").rlike(OTHER_UPPER_CASE)).count() > 500


def test_exact_groups(spark):
    texts = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 50_000), (8, "X" * 50_000), (2, "a b")]
    texts += [(100 + i, "hot") for i in range(300)]
    for keep, best in (("smallest", min), ("largest", max)):
        groups = {}
        for i, t in texts:
            groups.setdefault(ascii_lower(t or ""), []).append(i)
        want = sorted(
            (i, best(g := groups[ascii_lower(t or "")]), len(g), i == best(g), hashlib.sha256(ascii_lower(t or "").encode()).hexdigest())
            for i, t in texts
        )
        got = sorted(tuple(r) for r in exact_dedup.exact_groups(documents(spark, texts), keep, rounds=2, fan=4).collect())
        assert got == want


def test_exact_rows_without_id(spark):
    got = rows(exact_dedup.exact_groups(documents(spark, [(None, "a"), (3, "A"), (None, "b")])).select("doc_id", "keep_id", "kept"))
    assert got == sorted([(None, 3, False), (3, 3, True), (None, None, True)], key=repr)


def test_drop_copies_keeps_columns(spark):
    docs = documents(spark, [(1, "a"), (2, "A"), (3, None), (None, "c")])
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 3]


@pytest.mark.parametrize("operator", [exact_dedup.exact_groups, near_dedup.near_duplicates])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []


def test_exact_has_no_python(spark):
    plan = exact_dedup.exact_groups(documents(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# near dedup ----------------------------------------------------------------------


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(texts, percent=85):
    sets = {i: shingles(t) for i, t in texts}
    label = {i: i for i in sets}
    edges = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i in sets)


def family(draw, size, n_words, edits):
    base = [f"w{draw.randrange(10**6)}" for _ in range(n_words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(n_words)] = f"e{draw.randrange(10**6)}"
        yield " ".join(copy)


def test_near_duplicates(spark, monkeypatch):
    draw = random.Random(4)
    texts = [None, "", " \t\n", "one two", "ONE two", "one  two\x0b", "É a b c d", "é a b c d"]
    for size, n_words, edits in ((300, 140, 4), (60, 700, 14), (40, 30, 1), (30, 9, 1), (5, 4000, 60)):
        texts += family(draw, size, n_words, edits)
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + next(family(draw, 1, 100, 0)) for _ in range(150)]
    listed = list(enumerate(texts))
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(documents(spark, listed)).collect())
    assert got == brute_force(listed)


def test_near_duplicates_odd_rows(spark):
    docs = documents(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A B c d e f"), (9, None)])
    assert rows(near_dedup.near_duplicates(docs)) == sorted(
        [(None, 2, None, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (9, 0, 9, True)], key=repr
    )
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_duplicates(docs).collect()) == [0, 2, 9]
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(docs, percent=60)


def test_components_of_a_long_chain(spark):
    n = 70
    order = list(range(n))
    random.Random(1).shuffle(order)
    nodes = spark.createDataFrame([(i, 1000 + i) for i in range(n)], "node long, label long")
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {r.label for r in near_dedup.smallest_reachable(nodes, edges).collect()} == {1000}
