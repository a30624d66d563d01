"""Packing of documents into sequences, with a controlled mixture of sources.

The sources are queues. Deficit round-robin serves them window by window: in
each round a queue's credit grows by its share of the window, and its next
packets (pieces of a document of a bounded length) leave as soon as the credit
covers them; what is left is carried into the next window. A queue's credit
after j rounds is ``floor(j * window * weight / all weights)``, so the window
in which a packet leaves follows from its place in its queue alone. That makes
the carried deficits the same on every partition, and no scheduler walks over
the data: places in queues and in the output are prefix sums, taken within
chunks of rows and over the totals of chunks.

The stream of all windows is cut every ``length`` ids, so only the last
sequence is short.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ROW, numbered, staged, table, whole, worker_table

CHUNK_ROWS = 4096
CHUNK_WINDOWS = 4096
CACHED_WORDS = 600_000
MET_SLOTS = 1 << 22
_STOPS = frozenset((b".", b","))
ENCODED_AT_ONCE = 1024
TEXTS_AT_ONCE = 512


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def id_type(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


class _Words(dict):
    """Packed ids of words, kept while a Python worker lives; bounded.

    More than half of all words occur once, so a word is kept when it is met
    again. What was met is a table of hashes; two words in one slot only mean
    that a word is kept early.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer, self.kind, self.met = _tokenizer(path), id_type(path), bytearray(MET_SLOTS)

    def _encoded(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Encodes many words at once: white space ends a word for this tokenizer."""
        texts = [w.decode() for w in words]
        coded = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        ids = np.array(coded.ids, self.kind)
        cuts = np.searchsorted([a for a, _ in coded.offsets], starts)
        packed, size = ids.tobytes(), ids.itemsize
        return ((w, packed[a:b]) for w, a, b in zip(words, (cuts[:-1] * size).tolist(), (cuts[1:] * size).tolist()))

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not kept. A full stop or comma behind a letter or digit is a token of its own, so the rest is looked up."""
        ended = {w: w[:-1] for w in words if w[-1:] in _STOPS and w[-2:-1].isalnum()}
        wanted = {w for w in words if w not in ended} | set(ended.values()) | _STOPS
        plain, new = [w for w in wanted if w not in self], {}
        for at in range(0, len(plain), ENCODED_AT_ONCE):
            new.update(self._encoded(plain[at : at + ENCODED_AT_ONCE]))
        known = lambda w: new[w] if w in new else self[w]
        new.update([(word, known(rest) + known(word[-1:])) for word, rest in ended.items()])
        self._keep(new)
        return new

    def _keep(self, new: dict[bytes, bytes]) -> None:
        slots = [hash(w) & MET_SLOTS - 1 for w in new]
        again = [w for w, slot in zip(new, slots) if self.met[slot]]
        if len(self) + len(again) > CACHED_WORDS:
            self.clear()
            self.met = bytearray(MET_SLOTS)
        for slot in slots:
            self.met[slot] = 1
        self.update((w, new[w]) for w in again[:CACHED_WORDS])

    def of(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Packed ids of each text with ``end`` behind; each different word is looked up once."""
        listed = pc.ascii_split_whitespace(texts)
        coded = listed.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, words))
        missing = [w for w, ids in zip(words, found) if ids is None and w]
        new = self.learn(missing) if missing else {}
        new[b""] = b""  # beside white space at the ends of a text
        found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
        starts = listed.offsets.to_numpy().astype(np.int64)
        places = np.insert(coded.indices.to_numpy(), starts[1:], len(found))
        joined = pa.array([*found, end], pa.binary()).take(pa.array(places))
        _, offsets, data = joined.buffers()
        bounds = np.frombuffer(offsets, np.int32)[starts + np.arange(len(starts))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), data])


def tokenise(documents: DataFrame, tokenizer: str, end_id: int, queue: Column, id_col: str, text_col: str) -> DataFrame:
    """doc_id, queue, n and ids, packed little-endian, with the end id at the end.

    The tokenizer must end words at white space; ``tests`` compare with whole texts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kind = worker_table(("ids of words", tokenizer), lambda: _Words(tokenizer)), id_type(tokenizer)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                ids = words.of(part.column("text"), end)
                n = pc.divide(pc.binary_length(ids).cast(pa.int64()), len(end))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("queue"), n, ids], schema=schema)

    plain = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(queue.cast("string"), F.lit("")).alias("queue"), whole(text_col).alias("text")
    )
    return plain.mapInArrow(run, "doc_id long, queue string, n long, ids binary")


def _big(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("decimal(19,0)")


def _places(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids before the row in its queue, and ``queue_ids``, all ids of the queue."""
    chunked = rows.withColumn("_chunk", F.shiftright(F.col(ROW), 12))
    totals = chunked.groupBy("queue", "_chunk").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy("queue").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "queue", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy("queue")).alias("queue_ids"),
    )
    inside = Window.partitionBy("queue", "_chunk").orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    placed = chunked.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return placed.join(bases, ["queue", "_chunk"]).withColumn("start", F.col("_base") + F.col("_inside")).drop(
        "_base", "_inside", "_chunk"
    )


def served(rows: DataFrame, weight: Column, total_weight: int, window: int, packet: int) -> DataFrame:
    """Packets with ``window``, the round of deficit round-robin in which they leave.

    A packet whose last id is number e of its queue leaves in the first round
    j (from 0) with ``(j + 1) * window * weight >= e * total_weight``.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))
    packets = rows.select(
        ROW, "queue", "n", F.col("start").alias("_start"), weight.alias("_weight"), F.explode(starts).alias("begin")
    ).withColumn("size", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("begin")))
    last = _big(F.col("_start") + F.col("begin") + F.col("size"))
    share = _big(window) * _big(F.col("_weight"))
    return (
        packets.withColumn("_needed", last * _big(total_weight))
        .withColumn("_share", share)
        .withColumn("window", F.expr("cast((_needed + _share - 1) div _share as bigint) - 1"))
        .select(ROW, "queue", "begin", "size", "window", (F.col("_start") + F.col("begin")).alias("_place"))
    )


def laid_out(packets: DataFrame) -> DataFrame:
    """Adds ``at``, the packet's first place in the stream of all windows."""
    totals = packets.groupBy("window").agg(F.sum("size").alias("_n")).withColumn("_chunk", F.floor(F.col("window") / CHUNK_WINDOWS))
    chunks = totals.groupBy("_chunk").agg(F.sum("_n").alias("_m"))
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per 4096 windows
    chunk_bases = chunks.select("_chunk", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_chunk_base"))
    within = Window.partitionBy("_chunk").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        totals.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(chunk_bases, "_chunk")
        .select("window", (F.col("_before") + F.col("_chunk_base")).alias("_base"))
    )
    turn = Window.partitionBy("window").orderBy("queue", "_place").rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("_turn", F.coalesce(F.sum("size").over(turn), F.lit(0))).join(bases, "window").withColumn(
        "at", F.col("_base") + F.col("_turn")
    )


def cut(packets: DataFrame, length: int) -> DataFrame:
    """Pieces: packets cut where a sequence ends."""
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("size") - 1) / length)
    pieces = packets.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("at"), F.col("sequence_id") * length)
    high = F.least(F.col("at") + F.col("size"), (F.col("sequence_id") + 1) * length)
    return pieces.select(
        ROW, (F.col("begin") + low - F.col("at")).alias("start"), (high - low).alias("length"), "sequence_id",
        (low - F.col("sequence_id") * length).alias("offset"), "window",
    )


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64()), ("ids", pa.list_(pa.int32())),
])


def _with_ids(kind: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(packed, kind) for packed in batch.column("ids").to_pylist()]
            listed = batch.column("pieces")
            doc = np.repeat(np.arange(len(ids)), listed.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            pieces = pa.RecordBatch.from_struct_array(listed.flatten())
            starts, lengths = pieces.column("start").to_numpy(), pieces.column("length").to_numpy()
            parts = [ids[d][s : s + n] for d, s, n in zip(doc.tolist(), starts.tolist(), lengths.tolist())]
            columns = {name: pieces.column(name) for name in pieces.schema.names} | {
                "doc_id": batch.column("doc_id").take(pa.array(doc)),
                "ids_crc32": pa.array([zlib.crc32(p.astype("<u4")) for p in parts], pa.int64()),
                "doc_tokens": pa.array(np.array([len(i) for i in ids], np.int64)[doc] if len(doc) else [], pa.int64()),
                "ids": pa.array(parts if keep_ids else [None] * len(parts), pa.list_(pa.int32())),
            }
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in _PIECES], schema=_PIECES)

    return run


def pack(
    documents: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    length: int = 4096,
    window: int = 65536,
    packet: int = 1024,
    queue_col: str = "source",
    weights: dict[str, int] | None = None,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, ids.

    Each id of each document, the end id included, lies in exactly one piece;
    all sequences but the last are full. A window holds ``window`` ids on
    average, each queue's share in it within a packet of the target; the
    targets are the queues' shares of all ids, or in proportion to ``weights``
    (a queue not named weighs 1), which holds until a queue is empty. Null and
    empty sources share a queue; null text is the end id alone. Rows repeated
    under one id are packed each. ``ids`` is null unless ``keep_ids``.
    """
    coded = tokenise(documents, tokenizer, end_id, F.col(queue_col), id_col, text_col)
    rows = staged(numbered(coded), "packing-ids")
    lengths = staged(_places(rows.select(ROW, "queue", "n")), "packing-places")
    weight = F.col("queue_ids")
    if weights is not None:
        weight = F.coalesce(*(F.when(F.col("queue") == q, F.lit(w)) for q, w in weights.items()), F.lit(1)).cast("long")
    by_queue = lengths.select("queue", weight.alias("weight")).distinct()
    total = by_queue.agg(F.sum("weight")).first()[0] or 1
    pieces = cut(laid_out(staged(served(lengths, weight, total, window, packet), "packing-packets")), length)
    per_row = pieces.groupBy(ROW).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset", "window")).alias("pieces"))
    joined = rows.select(ROW, "doc_id", "ids").join(per_row, ROW).select("doc_id", "ids", "pieces")
    return joined.mapInArrow(
        _with_ids(id_type(tokenizer), keep_ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, ids array<int>",
    )


def op6(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
