"""Prefix trie of conversations against plain dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

import check_oracle
from clicksieve.llm import prefix_trie
from tests.conftest import SF_DIR

SCHEMA = "conv_id long, turn long, role string, text string, path string, n_convs int"


def plain_trie(rows, splice=True):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            order = (turn is not None, turn or 0, hashlib.sha256(said.encode()).hexdigest())
            turns.setdefault(conv, []).append((order, (role or "", text or "")))
    turns = {c: [t for _, t in sorted(ts)] for c, ts in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if splice else 0
        path = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, inside in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(inside) - 1) * len(path[-1][1]) if path else 0
    return sorted((
        (min(inside), len(path), min(members[path[:-1]]) if path else None, len(inside), children.get(path, 0), leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest())
        for path, inside in members.items()
    ), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    result = prefix_trie.prefix_trie(df, **options)
    assert tuple(result.columns) == prefix_trie.COLUMNS
    return sorted((tuple(r) for r in result.collect()), key=repr)


def random_rows(draw):
    rows = []
    for conv in draw.sample(range(-50, 700), 90):
        for turn in range(draw.randrange(0, 9)):
            rows.append((conv, draw.choice([turn, turn, None]), draw.choice(["user", "", None]), draw.choice(["é", "yes", "no", "", None, "😀 long text"])))
        if draw.random() < 0.2:
            rows.append(rows[-1] if rows else (conv, 1, "", ""))
    rows += [(1000 + c, t, "user", f"said {t}") for c in range(120) for t in range(3)]  # equal conversations
    rows += [(2000 + c, t, "user", "hello" if t == 0 else f"{c % 7} {t}") for c in range(120) for t in range(3)]  # a common first turn
    rows += [(None, 1, "user", "nobody's"), (5, 1, "user", "x" * 20_000)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, shards", [(1, 1), (2, 7), (3, 40), (4, None)])
@pytest.mark.parametrize("splice", [True, False])
def test_nodes_against_dictionaries(spark, seed, shards, splice):
    rows = random_rows(random.Random(seed))
    assert found(spark, rows, shards=shards, splice=splice) == plain_trie(rows, splice)


def test_shards_of_single_rows_and_short_pieces(spark, monkeypatch):
    """Every second conversation is a splitter, lists of ids are handed on one by one, paths of splitters are cut."""
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    monkeypatch.setattr(prefix_trie, "MAX_DEPTH", 2)
    rows = random_rows(random.Random(5))
    assert found(spark, rows, shards=200, splice=False) == plain_trie(rows, False)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{t % 3}") for c in (100, 101, 102) for t in range(120)] + [(102, 5000, "user", "more")]
    assert found(spark, rows, shards=3, splice=True) == plain_trie(rows)


def test_turnless_and_no_conversations(spark):
    assert found(spark, [], splice=True) == []
    assert found(spark, [(None, 1, "a", "b")], splice=True) == []
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(lone, 1, "user", "only")]
    assert found(spark, rows, splice=True) == plain_trie(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_query_against_sql_and_dictionaries(spark):
    assert check_oracle.compare(spark, check_oracle.duck(SF_DIR), SF_DIR, "op13_prefix_trie") == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in prefix_trie.op13(spark, SF_DIR).collect()), key=repr) == plain_trie(rows)
