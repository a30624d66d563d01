"""SimHash near-dedup against plain loops over all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from clicksieve.llm import simhash_dedup
from tests.conftest import SF_DIR
from tests.llm.test_dedup import ascii_lower

SCHEMA = "doc_id long, text string, fp string, component_id int, label string"


def plain_fingerprint(text, words=3):
    listed = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(listed[i : i + words]) for i in range(len(listed) - words + 1)] or ([" ".join(listed)] if listed else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=2):
    """Smallest id per position, by joining all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(doc)
    return [min(groups[find(i)]) for i in range(len(prints))]


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_fingerprint_of_odd_texts(monkeypatch):
    texts = [None, "", " \t\r\n", "a", "A b", "a b c", "É é x y Z", "x " * 5000, "one\x0btwo\x0cthree four", "a b c d " * 3 + "tail"]
    assert [simhash_dedup.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    draw = random.Random(3)
    long = " ".join(draw.choice(["lo", "rem", "ipsum", "é", "Dolor"]) + str(draw.randrange(50)) for _ in range(3000))
    for piece in (1, 7, 50, 4096):  # texts are split piece by piece
        monkeypatch.setattr(simhash_dedup, "PIECE", piece)
        assert [simhash_dedup.fingerprint(t) for t in [*texts, long]] == [plain_fingerprint(t) for t in [*texts, long]]


@pytest.mark.parametrize("segments, radius", [(2, 2), (4, 2), (2, 1), (1, 1), (3, 2), (2, 0)])
def test_every_pair_meets_in_a_segment(segments, radius):
    reach = simhash_dedup.radii(segments, radius)
    spread = [0] * segments

    def all_spreads(s, left):
        if s == segments:
            assert any(r >= 0 and d <= r for d, r in zip(spread, reach)), (spread, reach)
            return
        for d in range(left + 1):
            spread[s] = d
            all_spreads(s + 1, left - d)

    all_spreads(0, radius)


@pytest.mark.parametrize("busy", [128, 1, 0])
@pytest.mark.parametrize("segments, radius", [(2, 2), (4, 2), (2, 1)])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, busy, segments, radius):
    """Also where all fingerprints lie under values that count as crowded."""
    monkeypatch.setattr(simhash_dedup, "BUSY", busy)
    draw = random.Random(5)
    prints = {draw.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63}
    for start in list(prints):
        for _ in range(4):
            for _ in range(draw.randrange(4)):
                start ^= 1 << draw.randrange(64)
            prints.add(start)
    low = draw.getrandbits(32)
    prints |= {draw.getrandbits(32) << 32 | low for _ in range(60)} | {low << 32 | 7 << draw.randrange(30) for _ in range(60)}
    named = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in named]
    edges = [tuple(r) for r in simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius, segments).collect()]
    number = {s: i for i, s in enumerate(signed)}
    root = list(range(len(named)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= radius and a != b
        i, j = find(number[a]), find(number[b])
        root[max(i, j)] = min(i, j)
    assert [find(i) for i in range(len(named))] == plain_components(list(enumerate(named)), radius)


def test_duplicates_against_brute_force(spark):
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "a", "A"]
    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.randrange(1, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            changed = list(base)
            for _ in range(draw.randrange(3)):
                changed[draw.randrange(len(changed))] = draw.choice(words)
            texts.append(" ".join(changed).upper() if draw.random() < 0.3 else " ".join(changed))
    texts += ["hot text here and there"] * 200 + ["long " * 200_000]
    pairs = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, "twice"), (7, "twice"), (7, "another text altogether under one id")]
    prints = [(i, plain_fingerprint(t)) for i, t in pairs]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=repr)
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in pairs], SCHEMA)
    got = simhash_dedup.simhash_duplicates(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id", "kept"]
    assert rows_of(got) == want
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).isEmpty()


def test_rows_without_id_and_empty_tables(spark):
    got = simhash_dedup.simhash_duplicates(spark.createDataFrame([(None, "a b", "", 1, ""), (3, "A b", "", 1, ""), (5, None, "", 1, "")], SCHEMA))
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got.collect()), key=repr) == [(3, 3, True), (5, 5, True), (None, None, True)]
    assert simhash_dedup.simhash_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, plain_components(prints))), key=repr)
    assert rows_of(simhash_dedup.op11(spark, SF_DIR)) == want
