"""Stupid-backoff language model scores, gathered and joined relationally.

All words of all documents are counted, and all pairs of neighbouring words. A
word and a pair are known by a 64-bit hash, their key. Documents lie in blocks
of some megabytes. A block sums up its words and pairs and sends their sorted
keys, as differences, and their counts to a table partitioned by ranges of
keys, one row per range. There they are added up over all blocks; a block gets
back which of its entries others have too, a bit each, and the totals of
these. A range has as many entries on average whatever the input is, and a
frequent word or pair one from each block. A document's own pairs are taken
off their counts; its own words stay in c(w1), which is never zero that way.

    score(w2 | w1) = c(w1 w2) / c(w1)       if others have the pair
                     0.4 * c(w2) / N        otherwise

Per document, the logarithms are summed. What a block gets back goes by the
order of its keys, which is the same each time the block is read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table, whole

BACKOFF = 0.4
BLOCK_BYTES = 8 << 20  # of text, on average; a block is held by a task
WORD = 0  # stands for the second hash in the rows of single words; no word has it
OTHERS = 1  # hash of the class of words outside a vocabulary
RANGE_ENTRIES = 1 << 19  # words and pairs in a range of keys, on average; a range is held by a task
BYTES_PER_ENTRY = 6  # of text; there are hardly more words and pairs than that
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def word_hash(word: bytes) -> int:
    """64 bits; WORD and OTHERS are not among them."""
    import xxhash

    value = xxhash.xxh64_intdigest(word)
    return value if value > OTHERS else value + 2


@dataclass
class Block:
    """Counts of a block. Words are numbered by hash, pairs by the hashes of both words."""

    hashes: np.ndarray  # of the words
    word_n: np.ndarray
    first: np.ndarray  # numbers of the words of each pair
    second: np.ndarray
    pair_n: np.ndarray
    lengths: np.ndarray  # of the documents, in words
    words: np.ndarray  # all places: the word,
    at: np.ndarray  # where a pair begins: the place,
    pairs: np.ndarray  # its pair,
    own: np.ndarray  # how often the document has it,
    document: np.ndarray  # and the document


def counted(texts: list[str], vocabulary: np.ndarray | None = None) -> Block:
    """Counts the words and pairs of texts; words outside the sorted ``vocabulary`` are one class."""
    known = defaultdict()
    known.default_factory = known.__len__
    parts = []
    for text in texts:
        listed = _words(text)
        parts.append(np.fromiter(map(known.__getitem__, listed), np.int64, len(listed)))
    raw = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    hashed = np.fromiter(map(word_hash, known), np.uint64, len(known))
    if vocabulary is not None:
        hashed = np.where(np.isin(hashed, vocabulary), hashed, np.uint64(OTHERS))
    hashes, number = np.unique(hashed, return_inverse=True)
    words, size = number[raw], max(1, len(hashes))
    lengths = np.array([len(p) for p in parts], np.int64)
    document = np.repeat(np.arange(len(parts)), lengths)
    at = np.flatnonzero(document[1:] == document[:-1])
    distinct, pairs = np.unique(words[at] * size + words[at + 1], return_inverse=True)
    _, place, times = np.unique(document[at] * max(1, len(distinct)) + pairs, return_inverse=True, return_counts=True)
    return Block(
        hashes, np.bincount(words, minlength=len(hashes)), distinct // size, distinct % size, np.bincount(pairs, minlength=len(distinct)),
        lengths, words, at, pairs, times[place], document[at],
    )


def keys_of(found: Block) -> np.ndarray:
    """A 64-bit key of each word and pair of a block, words first."""
    a = np.concatenate([found.hashes, found.hashes[found.first]])
    b = np.concatenate([np.full(len(found.hashes), WORD, np.uint64), found.hashes[found.second]])
    x = a ^ (b * _MULTIPLIERS[0])
    for multiplier in _MULTIPLIERS[1:]:
        x = (x ^ (x >> np.uint64(31))) * multiplier
    return x ^ (x >> np.uint64(33))


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, the ranges that have any, and where these begin; one end more."""
    order = np.argsort(keys, kind="stable")
    if not bits:
        return order, np.zeros(min(1, len(keys)), np.int64), np.array([0, len(keys)][: 1 + min(1, len(keys))])
    held, begin = np.unique(keys[order] >> np.uint64(64 - bits), return_index=True)
    return order, held.astype(np.int64), np.append(begin, len(keys))


def packed_numbers(values: np.ndarray) -> bytes:
    """As many low bytes of each as the largest needs, all first bytes first."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked_numbers(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(-1, size)
    wide = np.zeros((size, 8), np.uint8)
    wide[:, : len(planes)] = planes.T
    return wide.view("<u8")[:, 0]


_SENT = pa.schema([("block", pa.int32()), ("range", pa.int64()), ("size", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
_BACK = pa.schema([("block", pa.int32()), ("range", pa.int64()), ("more", pa.binary()), ("totals", pa.binary())])


def _sums(vocabulary, bits: int):
    def run(rows: pa.Table) -> pa.Table:
        """A block to the keys and counts of its words and pairs, a row per range of keys."""
        found = counted(rows["text"].to_pylist(), vocabulary and vocabulary.value)
        keys, n = keys_of(found), np.concatenate([found.word_n, found.pair_n])
        order, held, begin = _ranges(keys, bits)
        keys, n = keys[order], n[order]
        steps = np.diff(keys, prepend=np.uint64(0))
        steps[begin[:-1]] = keys[begin[:-1]]
        if bits:
            steps[begin[:-1]] &= np.uint64((1 << (64 - bits)) - 1)
        cuts = list(zip(begin[:-1].tolist(), begin[1:].tolist()))
        columns = (
            np.full(len(held), rows["block"][0].as_py()), held, np.diff(begin), [packed_numbers(steps[a:z]) for a, z in cuts],
            [packed_numbers(n[a:z]) for a, z in cuts],
        )
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SENT)], schema=_SENT)

    return run


def _added(rows: pa.Table) -> pa.Table:
    """A range of keys from all blocks: which entries of each block others have too, and their totals."""
    sizes = rows["size"].to_pylist()
    keys = np.concatenate([np.cumsum(unpacked_numbers(k, s), dtype=np.uint64) for k, s in zip(rows["keys"].to_pylist(), sizes)])
    n = np.concatenate([unpacked_numbers(c, s) for c, s in zip(rows["n"].to_pylist(), sizes)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.append(True, np.diff(keys[order]) != 0)
    total = np.empty_like(n)
    total[order] = np.add.reduceat(n[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    more = total > n
    ends = np.cumsum(sizes)
    cuts = [slice(z - s, z) for z, s in zip(ends.tolist(), sizes)]
    columns = (
        rows["block"].to_numpy(), rows["range"].to_numpy(), [np.packbits(more[c]).tobytes() for c in cuts],
        [packed_numbers(total[c][more[c]]) if more[c].any() else b"" for c in cuts],
    )
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _BACK)], schema=_BACK)


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_seen", pa.int64()), ("n_backed_off", pa.int64()), ("part", pa.float64()),
])


def _scored(vocabulary, bits: int):
    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        """A block and the totals that exceed its own to scores without N."""
        found = counted(rows["text"].to_pylist(), vocabulary and vocabulary.value)
        n = np.concatenate([found.word_n, found.pair_n])
        order, held, begin = _ranges(keys_of(found), bits)
        places = dict(zip(held.tolist(), zip(begin[:-1].tolist(), begin[1:].tolist())))
        for key_range, more, packed in zip(*(totals[c].to_pylist() for c in ("range", "more", "totals"))):
            if packed:
                a, z = places[key_range]
                there = order[a:z][np.unpackbits(np.frombuffer(more, np.uint8), count=z - a).astype(bool)]
                n[there] = unpacked_numbers(packed, len(there))
        one, two = n[: len(found.hashes)], n[len(found.hashes) :]
        others = two[found.pairs] - found.own
        seen = others > 0
        score = np.where(
            seen,
            np.log(np.maximum(others, 1)) - np.log(one[found.words[found.at]]),
            np.log(BACKOFF * one[found.words[found.at + 1]]),
        )
        documents = len(found.lengths)
        n_seen = np.bincount(found.document, seen, documents).astype(np.int64)
        columns = (
            rows["doc_id"].combine_chunks(), found.lengths, n_seen, np.bincount(found.document, minlength=documents) - n_seen,
            np.bincount(found.document, score, documents),
        )
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCORED)], schema=_SCORED)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to words and counts; a word comes once per batch."""
    for batch in batches:
        counts = Counter(w for text in batch.column(0).to_pylist() for w in _words(text))
        words = pa.array([w.decode() for w in counts], pa.string())
        yield pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["w", "n"])


def _most_frequent(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the ``size`` most frequent words; of equally frequent ones the first in order."""
    words = texts.mapInArrow(_counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    top = words.orderBy(F.desc("n"), "w").limit(size).collect()
    return np.sort(np.array([word_hash(r.w.encode()) for r in top], np.uint64))


def lm_scores(
    documents: DataFrame, vocabulary_size: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_words, n_seen, log_score, mean_log_score.

    ``n_seen`` counts the places whose pair another document has too. Null text
    is empty; a text of less than two words has no pair, log_score 0 and no
    mean. Rows repeated under one id with one text are documents of their own,
    so each is seen in the other. With a ``vocabulary_size`` the words beyond
    the ``vocabulary_size`` - 1 most frequent ones are one class.
    """
    text = whole(text_col)
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    # the block follows from the row alone, however often it is read
    block = F.pmod(F.xxhash64(id_col, text), F.lit(size // block_bytes + 1)).cast("int")
    rows = documents.select(block.alias("block"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    bits = max(0, (size // (BYTES_PER_ENTRY * RANGE_ENTRIES)).bit_length())
    vocabulary = None
    if vocabulary_size is not None:
        found = _most_frequent(rows.select("text"), vocabulary_size - 1)
        vocabulary = documents.sparkSession.sparkContext.broadcast(found)
    blocks = rows.groupBy("block")
    sums = blocks.applyInArrow(_sums(vocabulary, bits), "block int, range long, size int, keys binary, n binary")
    totals = sums.groupBy("range").applyInArrow(_added, "block int, range long, more binary, totals binary")
    scored = staged(
        blocks.cogroup(totals.groupBy("block")).applyInArrow(
            _scored(vocabulary, bits), "doc_id long, n_words long, n_seen long, n_backed_off long, part double"
        ),
        "lm-scored",
    )
    everything = scored.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.round(F.col("part") - F.col("n_backed_off") * F.ln(F.lit(float(max(everything, 1)))), 6)
    return scored.select(
        "doc_id", "n_words", "n_seen", log_score.alias("log_score"),
        F.when(F.col("n_words") > 1, log_score / (F.col("n_words") - 1)).alias("mean_log_score"),
    )


def op8(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
