"""Runs of words against plain loops over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from clicksieve.llm import periodic_runs
from tests.conftest import SF_DIR

SCHEMA = "doc_id long, text string, n_runs string, start int, length string"


def plain_runs(words, repeats=4, least=6):
    """All maximal stretches with their smallest period, from the definition."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
    )


def random_words(draw):
    """Texts in which repetitions are frequent, nested and overlapping."""
    out = []
    while len(out) < draw.randrange(1, 150):
        piece = [draw.randrange(draw.choice([1, 2, 3, 8])) for _ in range(draw.randrange(1, 12))]
        out += (piece * draw.randrange(1, 9))[: draw.randrange(1, 90)]
        if draw.random() < 0.2:
            out += out[-draw.randrange(1, 40) :] * draw.randrange(1, 5)
    return out


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 5)])
def test_runs_equal_the_definition(repeats, least):
    draw = random.Random(repeats)
    for _ in range(1500):
        words = random_words(draw)
        assert periodic_runs.runs(words, repeats, least) == plain_runs(words, repeats, least), words


def test_squares_alone_find_all_runs():
    """Without cutting the text into parts before."""
    draw = random.Random(1)
    for _ in range(400):
        words = random_words(draw)
        found = {}
        for end, length, period in periodic_runs.squares(words):
            assert words[end + 1 - length : end + 1 - period] == words[end + 1 - length + period : end + 1]
            if length >= 6 and length >= 4 * period:
                found[end + 1 - length, period] = length
        assert sorted((s, n, q) for (s, q), n in found.items()) == plain_runs(words)


def test_long_repetitions_take_linear_memory_and_time():
    words = [i % 7 for i in range(60_000)] + [7, 8] * 20_000 + [9] * 20_000
    assert periodic_runs.runs(words) == [(0, 60_000, 7), (60_000, 40_000, 2), (100_000, 20_000, 1)]


def test_rows_against_brute_force(spark):
    draw = random.Random(9)
    texts = [None, "", " \t ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x\x0bx\x0cx x\tx\nx", "é é é é é é ü", "a b c " * 5 + "d"]
    texts += [" ".join(f"w{w}" for w in random_words(draw)) for _ in range(150)]
    texts += ["the same text " * 9] * 50 + [" ".join(str(i * i % 1013) for i in range(30_000)), "ab " * 150_000]
    pairs = [*enumerate(texts), (3, "a a a a a a a"), (3, "a a a a a a a"), (None, "b c " * 8)]
    got = periodic_runs.find_runs(
        spark.createDataFrame([(i, t, "x", 1, "y") for i, t in pairs], SCHEMA), prepare=periodic_runs.repeated_tail
    )
    short = [(i, t) for i, t in pairs if len(t or "") < 100_000]
    want = sorted((plain_row(i, t) for i, t in short), key=repr)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert len(rows) == len(pairs)
    assert [r for r in rows if r[0] not in (len(texts) - 1, len(texts) - 2)] == [r for r in want if r[0] not in (len(texts) - 1, len(texts) - 2)]
    assert [r[2:5] for r in rows if r[0] == len(texts) - 1] == [(0, 150_000, 1)]


def test_collapsed_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "so it goes on and on and on and on and on to here", "", 1, "")], SCHEMA)
    row = periodic_runs.find_runs(df, with_collapsed=True).first()
    assert row.collapsed == "so it goes on and to here" and (row.start, row.length, row.period, row.exponent_milli) == (3, 9, 2, 4500)
    assert periodic_runs.find_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    short = [r for r in docs if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in periodic_runs.op12(spark, SF_DIR).collect()}
    assert len(got) == len(docs) and len(short) > 100
    assert [got[r.doc_id] for r in short] == [plain_row(r.doc_id, r.text) for r in short]
    assert any(r[1] for r in got.values())
