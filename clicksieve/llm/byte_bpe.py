"""Byte-level BPE encoding and decoding.

Documents are gathered in blocks of a bounded size: rows of the distinct words
that no earlier block of the task had and, per document, which words it has in
which order. A word comes as its bytes' pieces. The merges run over these words
as Spark higher-order functions: a fold whose state is the word's pieces; each
step merges the lowest-ranked neighbouring pair. The table of words that a task has met is
bounded and starts anew when it is full. The ranks are
a literal, a table of pairs of piece ids made from the rank file.
Decoding looks up each id's bytes and concatenates them.

A fold is quadratic in the length of a word. Words over ``FOLDED_BYTES`` bytes
(runs of one kind of character thousands long) take the same merges with a
heap in Python; both ways give the same ids.

Nothing is shuffled: a block depends on the documents of its task only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ARROW_BATCH
from .common import table, whole

FOLDED_BYTES = 96
# What Python, the JVM and Arrow hold of a task at once grows with these. Arrays of
# over half a megabyte are kept apart by the JVM's collector, which costs heap.
BLOCK_CHARACTERS = 250_000
ROW_WORDS = 1 << 12
TABLE_WORDS = 500_000
NO_ENTRY = 1 << 54
NO_RANK = 1 << 20
# of a piece: its id, its place among the pieces of its word, both
ID_BITS, ONE_PLACE = (1 << 17) - 1, 1 << 17
PLACE_BITS = 127 << 17
LOW_BITS = ID_BITS | PLACE_BITS


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a public rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every pair of tokens whose concatenation is a token."""
    return {
        (ranks[token[:cut]], ranks[token[cut:]]): rank
        for token, rank in ranks.items()
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    }


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Offset of each id, and ``left << 20 | rank`` of each pair in slot ``offset of left + right``.

    The rows of all left ids lie over one another in one table, each moved to
    where its entries meet free slots (first fit, longest rows first).
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for (left, right), rank in pair_ranks(ranks).items():
        rows.setdefault(left, []).append((right, rank))
    width = max(ranks.values(), default=-1) + 1
    offsets, free, entries = [0] * width, np.ones(0, bool), np.zeros(0, np.int64)
    for done, (left, row) in enumerate(sorted(rows.items(), key=lambda x: (-len(x[1]), x[0]))):
        rights, values = np.array(row, np.int64).T
        if done % 64 == 0:
            slots = np.flatnonzero(free)
        for at in range(0, len(slots) + 1, 4096):
            fits = slots[at : at + 4096] - rights[0]
            fits = fits[(fits >= 0) & (fits + width <= len(free))]
            for right in rights:
                fits = fits[free[fits + right]]
                if not len(fits):
                    break
            if len(fits):
                break
        else:  # behind all others it fits
            fits = [len(free)]
            free = np.append(free, np.ones(2 * width, bool))
            entries = np.append(entries, np.full(2 * width, NO_ENTRY, np.int64))
            slots = np.flatnonzero(free)
        offset = offsets[left] = int(fits[0])
        free[offset + rights] = False
        entries[offset + rights] = left << 20 | values
    used = np.flatnonzero(~free)
    return offsets, entries[: used[-1] + 1 if len(used) else 0].tolist()


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """Struct of literals: ``offsets`` and ``pairs``, the table of ranks, and ``bytes``, the ids of single bytes."""
    literal = lambda value: F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), "array<bigint>")
    offsets, pairs = pair_table(ranks)
    return F.struct(
        literal(offsets).alias("offsets"), literal(pairs).alias("pairs"),
        literal([ranks.get(bytes([b]), ID_BITS) for b in range(256)]).alias("bytes"),
    )


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's argument is not computed again at each use.

    The value is the start of a fold over nothing. Taking the element of a
    transformed array instead works out the body's type at each use.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda x, _: x, body)


def _piece(known: Column, low: Column, left: Column, right: Column) -> Column:
    """``low`` with the rank of the pair ``left``, ``right`` above it."""
    slot = F.get(known["offsets"], left.cast("int")) + right
    # the entry of another pair keeps a high bit, and behind the last piece is null
    entry = F.get(known["pairs"], slot.cast("int")).bitwiseXOR(F.shiftleft(left, 20))
    return F.shiftleft(F.least(entry, F.lit(NO_RANK)), 24).bitwiseOR(low)


def merge_pieces(start: Column, known: Column) -> Column:
    """Ids of one word, whose bytes are given as pieces.

    A piece is ``rank << 24 | first byte << 17 | id``, the rank being that of
    the pair it starts. So the smallest piece is the leftmost of the lowest
    rank, its rank is the id that it merges to, and a merge looks up two pairs
    and no others. Lambdas are interpreted: a step has one over its pieces,
    which takes less than putting slices together.
    """

    def step(pieces: Column, _: Column) -> Column:
        def merge(best: Column) -> Column:
            merged = F.shiftright(best, 24)
            here = lambda at: _piece(
                known, best.bitwiseAND(PLACE_BITS).bitwiseOR(merged), merged, F.get(pieces, at + 2).bitwiseAND(ID_BITS)
            )
            before = lambda x: _piece(known, x.bitwiseAND(LOW_BITS), x.bitwiseAND(ID_BITS), merged)
            put = lambda at: F.transform(
                F.array_remove(pieces, F.get(pieces, at + 1)),
                lambda x, i: F.when(i == at, here(at)).when(i == at - 1, before(x)).otherwise(x),
            )
            return _let(F.array_position(pieces, best).cast("int") - 1, put)

        return _let(F.array_min(pieces), lambda best: F.when(best < NO_RANK << 24, merge(best)).otherwise(pieces))

    merges = F.slice(start, 2, FOLDED_BYTES)  # one less than there are bytes
    return F.aggregate(merges, start, step, lambda pieces: F.transform(pieces, lambda x: x.bitwiseAND(ID_BITS)))


def fold_merges(word: Column, known: Column) -> Column:
    """Ids of one word: binary or string in, array<bigint> out."""
    # one character per byte, so that the bytes can be split
    one_each = F.decode(word.cast("binary"), "ISO-8859-1")
    ids = F.transform(F.split(one_each, ""), lambda c: F.get(known["bytes"], F.ascii(c)))
    low = lambda x, at: F.shiftleft(at.cast("long"), 17).bitwiseOR(x)
    start = _let(ids, lambda i: F.transform(i, lambda x, at: _piece(known, low(x, at), x, F.get(i, at + 1))))
    empty = F.array().cast("array<bigint>")
    return F.when(F.octet_length(word) == 0, empty).otherwise(merge_pieces(start, known))


def _byte_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Id of each byte, and rank of each pair of bytes."""
    ids = np.array([ranks.get(bytes([b]), ID_BITS) for b in range(256)], np.int64)
    pairs = np.full(1 << 16, NO_RANK, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2 and token[:1] in ranks and token[1:] in ranks:
            pairs[token[0] << 8 | token[1]] = rank
    return ids, pairs


def _start_pieces(words: list[bytes], ids: np.ndarray, pairs: np.ndarray) -> pa.ListArray:
    """The pieces that the merges of each word start with, one per byte."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    rank = np.full(len(flat), NO_RANK, np.int64)
    rank[:-1] = pairs[flat[:-1] << 8 | flat[1:]]
    rank[ends[lengths > 0] - 1] = NO_RANK
    place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(rank << 24 | place << 17 | ids[flat]))


def heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: lowest rank first, leftmost first."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int):
        j = end[i]
        rank = ranks.get(word[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    queue = [p for i in range(n) if (p := pair(i))]
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two has changed since
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and (p := pair(k)):
                heapq.heappush(queue, p)
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


_BLOCK = pa.schema([
    ("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("places", pa.binary()), ("first", pa.int64()),
    ("starts", pa.list_(pa.list_(pa.int64()))), ("long_words", pa.list_(pa.string())), ("long_at", pa.list_(pa.int64())),
])
_BLOCK_DDL = (
    "docs array<long>, ends array<long>, places binary, first long, starts array<array<long>>, long_words array<string>, long_at array<long>"
)


def _gather(pattern: str, ranks: dict[bytes, int], block_characters: int, table_words: int):
    """Batches of (doc_id, text) to rows of words, and behind them one row per block.

    Words are numbered through a task: a row lists those that no row before it
    had, the first of them being word ``first``, and the last row of a block has
    its documents. A full table starts anew at 0. Very long words come with no
    pieces, and apart.
    """
    byte_ids, byte_pairs = _byte_tables(ranks)

    def row(words: list[str], first: int, docs: list, ends: list, places: bytes) -> pa.RecordBatch:
        coded = [w.encode() for w in words]
        long_at = [i for i, w in enumerate(coded) if len(w) > FOLDED_BYTES]
        for i in long_at:
            coded[i] = b""
        starts = _start_pieces(coded, byte_ids, byte_pairs)
        values = (docs, ends, places, first, None, [words[i] for i in long_at], long_at)
        cells = [pa.array([x], f.type) for x, f in zip(values, _BLOCK)]
        cells[4] = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), starts)
        return pa.RecordBatch.from_arrays(cells, schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        numbers: dict[str, int] = {}
        docs, ends, places, new, first, held, total = [], [], [], [], 0, 0, 0

        def block() -> Iterator[pa.RecordBatch]:
            last = max(len(new) - 1, 0) // ROW_WORDS * ROW_WORDS
            for at in range(0, last, ROW_WORDS):
                yield row(new[at : at + ROW_WORDS], first + at, [], [], b"")
            yield row(new[last:], first + last, docs, ends, np.concatenate(places).tobytes())

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                words = split(text)
                unknown = set(words).difference(numbers)
                numbers.update(zip(unknown, range(len(numbers), len(numbers) + len(unknown))))
                new += unknown
                places.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                total += len(words)
                docs.append(doc)
                ends.append(total)
                held += len(text)
                if held >= block_characters:
                    yield from block()
                    if len(numbers) > table_words:
                        numbers.clear()
                    docs, ends, places, new, first, held, total = [], [], [], [], len(numbers), 0, 0
        if docs:
            yield from block()

    return run


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _put(held: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``held`` with ``values`` from place ``at`` on; it grows to twice the size when it is full."""
    if at + len(values) > len(held):
        held = np.concatenate([held[:at], np.empty(max(at, len(values)), held.dtype)])
    held[at : at + len(values)] = values
    return held


def _deal(ranks: dict[bytes, int]):
    """Blocks with the ids of their new words to one row of ids per document.

    Follows the table of the task that gathered; both run in one stage, so the
    blocks of a task come in their order, again too after a lost executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = np.zeros(1, np.int32), np.empty(0, np.int32)  # where the ids of each word of the table start, and its ids
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row].values  # noqa: E731, B023
                ids, words = cell("ids"), cell("long_words").to_pylist()
                if words:  # these have no ids yet
                    listed = ids.to_pylist()
                    for at, word in zip(cell("long_at").to_pylist(), words):
                        listed[at] = heap_merges(word.encode(), ranks)
                    ids = pa.array(listed, pa.list_(pa.int64()))
                first = batch.column("first")[row].as_py()
                start = int(known[first])
                stops = start + np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
                known = _put(known, first + 1, stops)
                flat = _put(flat, start, ids.flatten().to_numpy(zero_copy_only=False))
                if not len(cell("docs")):
                    continue
                words = first + len(ids)
                table = pa.ListArray.from_arrays(pa.array(known[: words + 1]), pa.array(flat[: known[words]]))
                taken = table.take(pa.array(np.frombuffer(batch.column("places")[row].as_py(), np.int32)))
                starts = np.concatenate([[0], np.cumsum(taken.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
                ends = cell("ends").to_numpy(zero_copy_only=False)
                offsets = np.concatenate([[0], starts[ends]]).astype(np.int32)
                per_doc = pa.ListArray.from_arrays(pa.array(offsets), taken.flatten())
                yield pa.RecordBatch.from_arrays([cell("docs"), per_doc], schema=_ENCODED)

    return run


def _folded(
    documents: DataFrame, ranks: dict[bytes, int], pattern: str, block_characters: int, id_col: str, text_col: str, table_words: int
) -> DataFrame:
    """Blocks with the ids of their new words; none for a very long word, which comes with them."""
    plain = documents.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    blocks = plain.mapInArrow(_gather(pattern, ranks, block_characters, table_words), _BLOCK_DDL)
    # naming the literal in a lambda keeps it in the plan once
    folded = F.transform(F.array(rank_literal(ranks)), lambda known: F.transform("starts", lambda start: merge_pieces(start, known)))
    return blocks.select("docs", "ends", "places", "first", F.get(folded, F.lit(0)).alias("ids"), "long_words", "long_at")


def encode(
    documents: DataFrame, ranks: dict[bytes, int], pattern: str, block_characters: int = BLOCK_CHARACTERS, id_col: str = "doc_id", text_col: str = "text",
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """doc_id and ids of each document's whole text; null text has no ids.

    Each match of ``pattern`` is encoded by itself, without special tokens.
    Rows repeated under an id, or without one, each get their own row. A text
    of one very long word is encoded like any other.
    """
    coded = _folded(documents, ranks, pattern, block_characters, id_col, text_col, table_words)
    return coded.mapInArrow(_deal(ranks), "doc_id long, ids array<int>")


def decoded_bytes(ids: pa.ListArray, pieces: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each list's bytes end, and all pieces' bytes one after the other."""
    flat = pieces.take(ids.flatten())
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    lengths = np.concatenate([[0], np.cumsum(pa.compute.binary_length(flat).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ends = lengths[np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)] if len(ids) else lengths[:0]
    buffer = flat.buffers()[2]
    first = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_binary(flat.type) else np.int32)[flat.offset] if len(flat) else 0
    return ends, memoryview(buffer)[int(first):] if buffer is not None else memoryview(b"")


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the concatenated bytes of the ids."""
    return encoded.withColumn("decoded", F.lit(None).cast("binary")).mapInArrow(
        _decoder(ranks, ids_col), encoded.withColumn("decoded", F.lit(None).cast("binary")).schema
    )


def _pieces(ranks: dict[bytes, int]) -> pa.Array:
    listed = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        listed[rank] = token
    return pa.array(listed, pa.large_binary())


def _decoder(ranks: dict[bytes, int], ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks)
        for batch in batches:
            ends, data = decoded_bytes(batch.column(ids_col), pieces)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            texts = pa.array([bytes(data[a:b]) for a, b in zip(starts, ends)], pa.binary())
            columns = [texts if name == "decoded" else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digest(ranks: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks)
        for batch in batches:
            ids = batch.column("ids")
            counts = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            last = np.cumsum(counts)
            values = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends, data = decoded_bytes(ids, pieces)
            sha = lambda parts: [hashlib.sha256(p).hexdigest() for p in parts]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array(sha(values[b - n : b].tobytes() for b, n in zip(last, counts)), pa.string()),
                pa.array(sha(data[a:b] for a, b in zip([0, *ends[:-1]], ends)), pa.string()),
            ], schema=_DIGESTS)

    return run


_DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoded documents."""
    return encoded.mapInArrow(_digest(ranks), _DIGESTS_DDL)


def encoded_digests(
    documents: DataFrame, ranks: dict[bytes, int], pattern: str, block_characters: int = BLOCK_CHARACTERS, id_col: str = "doc_id", text_col: str = "text",
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """``digests`` of ``encode`` in one Python step, so that the ids don't leave it."""
    deal, digest = _deal(ranks), _digest(ranks)
    coded = _folded(documents, ranks, pattern, block_characters, id_col, text_col, table_words)
    return coded.mapInArrow(lambda batches: digest(deal(batches)), _DIGESTS_DDL)


def op10(spark, sf_dir):
    import public_tokenizers

    # by default 64 MB of texts are held in the JVM and in Python, several times over
    spark.conf.set(ARROW_BATCH, "1m")
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
