"""Search, licenses, tokens, packing, captures and scores against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from datetime import datetime

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import compare, duck
from clicksieve.llm import byte_bpe, license_scan, lm_score, packing, queries, revisits, topk_search
from clicksieve.session import ARROW_BATCH, configure
from tests.conftest import SF_DIR, rows


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, duck(SF_DIR), SF_DIR, name) == ""


def test_all_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


# top-k -----------------------------------------------------------------------------


def best(vectors, asked, k):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            whole[i] = min(whole.get(i, q), q)
    found = []
    for q in set(asked) & set(whole):
        scored = sorted(
            (-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q])
        )
        found += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(found)


def test_top_k(spark):
    draw = random.Random(2)
    vectors = [(i, [draw.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    vectors += [(500 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(80)] + [(3, vectors[3][1])]
    vectors += [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf")] * 4), (904, [1.0]), (None, [1.0] * 4)]
    asked = [0, 50, 100, 500, 550, 900, 904, 7777]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score int")
    for shards in (1, 5):
        got = topk_search.top_k(df, df.where(F.col("vec_id").isin(asked)), k=5, shards=shards, query_block=3, bins=16)
        assert sorted(tuple(r) for r in got.collect()) == best(vectors, asked, 5)


def test_top_k_shards_follow_the_rows(spark, monkeypatch):
    assert [topk_search.shards_for(n) for n in (0, 10**5, 10**9)] == [64, 64, 61_036]
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 20)
    monkeypatch.setattr(topk_search, "LEAST_SHARDS", 2)
    vectors = [(i, [float(i % 7), float(i % 5)]) for i in range(150)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = topk_search.top_k(df, df.where(F.col("vec_id") % 50 == 0))
    assert sorted(tuple(r) for r in got.collect()) == best(vectors, [0, 50, 100], 5)


def test_top_k_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert rows(topk_search.top_k(df, df.where("vec_id = 0"))) == [(0, 1, 1, 256 * 512)]
    assert topk_search.top_k(df.limit(0), df.limit(0)).collect() == []


# licenses --------------------------------------------------------------------------


def test_license_scan(spark):
    notice = next(iter(license_scan.NOTICES))
    texts = {
        1: "GNU General Public License, and the gnu-general public license!", 2: None, 3: "", 4: "CC BY-NC 4.0; cc by",
        5: "Some words. " + notice, 6: notice.replace("free of charge", "quite free of any charge"), 7: "mit license" * 3,
        8: "Licensed under the Apache License, Version 2.0. " * 2 + "é " * 3000, 9: "MİT License K",
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, label string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text in texts.items():
        words = re.findall(license_scan.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        places = sorted(
            (at, label) for phrase, label in license_scan.PHRASES.items() for at in range(len(words))
            if words[at : at + len(phrase.split())] == phrase.split()
        )
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit-text" in got[5].labels and "mit-text" in got[6].labels and "apache-2.0" in got[8].labels
    assert got[9].labels == "" and got[2].score == 0
    assert license_scan.scan(docs.limit(0)).collect() == []


# tokens ------------------------------------------------------------------------------


RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def texts(spark):
    found = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()]
    return found + [
        None, "", " ", "\n\n  \t x", "a" * 3000, "ab" * 700 + "!" * 500, "I'll we've 12345 é  x 　", "🙂🙂 日本語 \x00\x1c\x85b",
        "é Σας ΟΔΟΣ İ", "<|endoftext|> x",
    ]


def test_bpe(spark, texts):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    coded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_characters=50_000, table_words=1_000)
    for r in byte_bpe.decode(coded, RANKS).collect():
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    at_once = byte_bpe.encoded_digests(docs, RANKS, public_tokenizers.PATTERN, block_characters=50_000, table_words=1_000).collect()
    assert len(at_once) == len(texts)
    for r in byte_bpe.digests(coded, RANKS).collect() + at_once:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert byte_bpe.digests(byte_bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).collect() == []
    assert byte_bpe.encoded_digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_every_token_is_itself(spark):
    """Merging a token's bytes gives the token, so whole words need no shortcut."""
    words = spark.createDataFrame([(bytearray(t), r) for t, r in RANKS.items() if len(t) <= byte_bpe.FOLDED_BYTES][::7], "w binary, r int")
    folded = F.get(F.transform(F.array(byte_bpe.rank_literal(RANKS)), lambda known: byte_bpe.fold_merges(F.col("w"), known)), F.lit(0))
    assert words.where(folded != F.array(F.col("r").cast("long"))).count() == 0


def test_pairs_lie_over_one_another():
    """Each pair is found by one lookup, and in no more than a few slots per pair."""
    for ranks in (RANKS, {}, {bytes([b]): b for b in range(256)}):
        offsets, entries = byte_bpe.pair_table(ranks)
        pairs = byte_bpe.pair_ranks(ranks)
        assert all(entries[offsets[left] + right] == left << 20 | rank for (left, right), rank in pairs.items())
        assert len(entries) <= 2 * (len(ranks) + 2 * len(pairs))


def test_words_of_a_block_come_in_rows(spark, monkeypatch):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "ROW_WORDS", 7)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    texts = [" ".join(f"wörd{i * j}" for j in range(9)) + "x" * (40 * i) for i in range(9)] + ["", "wörd1"]
    gather = byte_bpe._gather(public_tokenizers.PATTERN, RANKS, 300, 20)
    rows = [r for b in gather([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]) for r in b.to_pylist()]
    assert max(len(r["starts"]) for r in rows) == 7 and sum(len(r["docs"]) for r in rows) == len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_characters=300, table_words=20).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id])


def test_what_a_task_holds_at_once_is_small():
    """Rows under a megabyte whatever a task reads, and a table of ids that is not copied for each."""
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(400)) for _ in range(900)]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = list(byte_bpe._gather(public_tokenizers.PATTERN, RANKS, byte_bpe.BLOCK_CHARACTERS, byte_bpe.TABLE_WORDS)([docs]))
    assert sum(r.nbytes for r in rows) > 20e6 and max(r.nbytes for r in rows) < 1e6
    held, at, moves = np.empty(0, np.int32), 0, 0
    for r in rows:
        values = np.arange(at, at + len(r.column("starts")[0]), dtype=np.int32)
        moves += (grown := byte_bpe._put(held, at, values)) is not held
        held, at = grown, at + len(values)
    assert held[:at].tolist() == list(range(at)) and moves <= 12 < len(rows)
    assert byte_bpe._put(held, 3, np.array([7], np.int32))[:5].tolist() == [0, 1, 2, 7, 4]  # a table that starts anew is written over


def test_op10_bounds_arrow_batches(spark, tmp_path):
    """The bound is on bytes, and the next query has Spark's own again."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id", F.repeat(F.lit(" x"), 2000)).alias("text"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    try:
        assert byte_bpe.op10(spark, str(tmp_path)).count() == 3000
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        sent = [r.n for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("text").mapInArrow(sizes, "n long").collect()]
        assert max(sent) < 2e6
    finally:
        configure(spark)
    assert spark.conf.get(ARROW_BATCH) == "64m"


def test_a_merge_costs_few_expressions(spark):
    """Lambdas are interpreted: what one step evaluates is what a word costs."""
    known = byte_bpe.rank_literal({bytes([b]): b for b in range(256)})
    q = spark.range(1).select(F.transform(F.array(known), lambda k: byte_bpe.merge_pieces(F.array(F.col("id")), k)).alias("ids"))
    plan = q._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_min") == 1 and plan.count("concat(") == 0 and plan.count("array_remove") == 1


def test_long_word_takes_the_same_merges():
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    draw = random.Random(5)
    for n in (1, 2, 97, 400):
        word = "".join(draw.choice("abcdest") for _ in range(n))
        assert byte_bpe.heap_merges(word.encode(), RANKS) == library.encode_ordinary(word)


# packing -------------------------------------------------------------------------------


def packed(spark, texts, **options):
    path = public_tokenizers.path("word_bpe_49k.json")
    listed = [(i, t, None if i % 7 == 0 else f"s{i % 3}", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(listed, "doc_id long, text string, source string, start int")
    return packing.pack(docs.repartition(3), path, **options)


@pytest.mark.parametrize("options", [{}, {"window": 512, "packet": 64, "length": 256}, {"weights": {"s0": 3, "s1": 1}, "window": 1024, "packet": 128}])
def test_packing(spark, texts, options):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packed(spark, texts, keep_ids=True, **options).collect()
    whole = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in got:
        assert r.ids == whole[r.doc_id][r.start : r.start + r.length] and r.doc_tokens == len(whole[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for runs, sizes in ((pieces, {i: len(x) for i, x in whole.items()}), (sequences, None)):
        for key, parts in runs.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at and length > 0
                at += length
            if sizes is not None:
                assert at == sizes[key]
            else:
                assert at == options.get("length", 4096) or key == max(sequences)
    assert set(pieces) == set(whole)


def test_windows_hold_the_mixture(spark, texts):
    options = {"window": 4096, "packet": 64, "length": 1024}
    got = packed(spark, [t for t in texts if t] * 4, **options).collect()
    source = lambda i: "" if i % 7 == 0 else f"s{i % 3}"
    total, credit = Counter(), Counter()
    for r in got:
        total[source(r.doc_id)] += r.length
    by_window = {}
    for r in got:
        by_window.setdefault(r.window, Counter())[source(r.doc_id)] += r.length
    assert len(by_window) > 5
    for window in sorted(by_window):
        credit.update(by_window[window])
        for queue, n in total.items():
            behind = 4096 * (window + 1) * n / sum(total.values()) - credit[queue]
            assert -1 < behind <= 64 or credit[queue] == n  # the deficit that is carried


def test_packing_nothing(spark, texts):
    assert packed(spark, texts[:1]).limit(0).collect() == []
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).collect() == []


# captures --------------------------------------------------------------------------------


def test_canonical_url(spark):
    cases = {
        " HTTP://User@Example.COM:80/A/b?b=2&a=1#x ": "http://example.com/A/b?a=1&b=2", "https://e.org": "https://e.org/",
        "https://e.org:444?": "https://e.org:444/", "no scheme": "no scheme", "": "", None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", revisits.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_revisits(spark):
    at = lambda s: datetime(2024, 1, 1) if s is None else datetime.fromtimestamp(1704067200 + s)
    full = lambda i, u, s, tag, **h: (i, u, at(s), 200, ({"ETag": tag} if tag else {}) | h, f"p{i}", "z")
    again = lambda i, u, s, tag, **h: (i, u, at(s), 304, ({"etag": tag} if tag else {}) | h, None, "z")
    captures = [
        full(1, "http://a/", 0, "x", Server="one", Date="1"), again(2, "HTTP://A", 10, "W/x", Date="2", Server="two"),
        full(3, "http://a/", 5000, "y"), full(4, "http://a/", 5000, "x"), again(5, "http://a", 5000, "x"), again(6, "http://a", 90000, "x"),
        again(7, "http://b", 1, "x"), full(8, "http://b", 1, "x"), again(9, "http://b", 2, None), again(10, None, 2, "x"),
        (11, "http://b", None, 304, None, None, "z"), (12, "http://b", at(3), 404, None, None, "z"), again(6, "http://a", 90000, "x"),
        (13, "http://c", at(0), 200, {"Last-Modified": "m"}, "p13", "z"), (14, "http://c", at(9), 304, {"Last-Modified": "m"}, None, "z"),
    ]
    df = spark.createDataFrame(captures, "record_id long, url string, captured_at timestamp, status int, headers map<string,string>, payload_digest string, canonical string")
    got = revisits.resolve_revisits(df).select("record_id", "status", "resolved_id", "payload_digest").collect()
    assert rows(spark.createDataFrame(got)) == sorted([
        (2, "resolved", 1, "p1"), (5, "resolved", 1, "p1"), (6, "resolved", 4, "p4"), (6, "resolved", 4, "p4"), (7, "no response", None, None),
        (9, "changed", None, None), (10, "no response", None, None), (11, "no response", None, None), (14, "resolved", 13, "p13"),
    ], key=repr)
    merged = revisits.resolve_revisits(df).where("record_id = 2").select(revisits.header_text(F.col("headers"))).first()[0]
    assert merged == "date: 2\netag: W/x\nserver: one"
    assert revisits.resolve_revisits(df.limit(0)).collect() == []


# scores ------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1 << 16, 40])
def test_lm_scores(spark, size):
    draw = random.Random(3)
    texts = [" ".join(draw.choice("the of a To é x. y".split()) + draw.choice(["", "", str(draw.randrange(30))]) for _ in range(draw.randrange(1, 60))) for _ in range(80)]
    listed = [*enumerate(texts), (900, None), (901, ""), (902, "alone"), (5, texts[5])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in listed], "doc_id long, text string, pair int")
    words = [(t or "").encode().lower().split() for _, t in listed]
    counts = Counter(w for t in words for w in t)
    top = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: size - 1], 1)}
    coded = [[top.get(w, 0) for w in t] for t in words]
    one, own = Counter(i for t in coded for i in t), [Counter(zip(t, t[1:])) for t in coded]
    two = sum(own, Counter())
    want = []
    for (i, _), t, mine in zip(listed, coded, own):
        score, seen = 0.0, 0
        for pair in zip(t, t[1:]):
            if two[pair] > mine[pair]:
                score, seen = score + math.log((two[pair] - mine[pair]) / one[pair[0]]), seen + 1
            else:
                score += math.log(0.4 * one[pair[1]] / sum(one.values()))
        want.append((i, len(t), seen, score))
    got = [tuple(r)[:4] for r in lm_score.lm_scores(docs, size).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        # a row repeated as it is shares its pairs with its copy
        assert a[:2] == b[:2] and (a[0] == 5 or (a[2] == b[2] and abs(a[3] - b[3]) < 1e-5))
    assert lm_score.lm_scores(docs.limit(0)).collect() == []
