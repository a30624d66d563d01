"""SimHash near-dedup with multi-index hashing.

A fingerprint's bit is 1 where more than half of the text's shingle hashes have
it. Copies share a fingerprint, so links are looked for between different
fingerprints only. The 64 bits are cut into segments, and each segment has a
table from value to fingerprints. Two fingerprints within the radius agree, but
for very few bits, in at least one segment: the small Hamming balls around each
segment's values are enumerated, the values that a table has are met, and the
complete distance of what lies under them is verified.

Balls are enumerated per *value* and not per fingerprint, and only towards
larger values, so that each pair of values is met once. A value under which
many fingerprints lie would give all their pairs. What meets there is linked
another, equally exact way: two fingerprints are within distance 2 if and only
if some word is within 1 of both, so each files itself under its 65 words of
distance up to 1. At most 65 different fingerprints can meet under one word
and all of those are linked, however many lie under a segment's value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table, whole
from .near_dedup import smallest_reachable

BITS = 64
SEED = 42
PIECE = 1 << 20  # bytes of a text that are split at a time
BUSY = 128  # fingerprints under one value of a segment that are compared pair by pair
HOT_PARTS = 1000  # a fingerprint with more than this part of the rows is joined by broadcast; there are fewer than this many
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, some at a time."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()  # of bytes: ASCII white space only
        at = end


def _hashes(data: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included; of all words together if they are fewer."""
    import xxhash

    carried: list[bytes] = []
    several = False
    for piece in _pieces(data):
        listed = carried + piece
        if len(listed) >= words:
            joined = map(b" ".join, zip(*(listed[i:] for i in range(words)))) if words > 1 else listed
            n = len(listed) - words + 1
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, n)
            several = True
            carried = listed[n:]
        else:
            carried = listed
    if not several and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint of a text; 0 without words."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in _hashes((text or "").encode().lower(), words):
        for part in np.array_split(hashes, -(-len(hashes) // 65_536)):
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(t.as_py(), words) for t in part.column("text")], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def radii(segments: int, radius: int) -> list[int]:
    """Ball radius per segment such that every pair within ``radius`` meets in one; -1 needs no look."""
    each, rest = divmod(radius, segments)
    return [each if s <= rest else each - 1 for s in range(segments)]


def _segment(fp: Column, s: int, segments: int) -> Column:
    width = BITS // segments
    low = s * width
    kept = width if s < segments - 1 else BITS - low
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << kept) - 1 if kept < BITS else -1))


def _ball(value: Column, bits: int, radius: int) -> Column:
    """The value itself and all larger values within the radius."""
    masks = [sum(1 << b for b in flipped) for r in range(radius + 1) for flipped in combinations(range(bits), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.filter(F.transform(F.lit(signed).cast("array<bigint>"), lambda m: value.bitwiseXOR(m)), lambda v: v >= value)


def _met_values(filed: DataFrame, segments: int, reach: list[int]) -> DataFrame:
    """(segment, a, b, most): pairs of values within a segment's ball, a = b too, that both have fingerprints."""
    sizes = staged(filed.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n")), "simhash-sizes")
    width = BITS // segments
    asked = None
    for s, radius in enumerate(reach):
        if radius < 0:
            continue
        bits = width if s < segments - 1 else BITS - s * width
        mine = sizes.where(F.col("segment") == s).select(
            "segment", F.col("value").alias("a"), F.col("n").alias("n_a"), F.explode(_ball(F.col("value"), bits, radius)).alias("b")
        )
        asked = mine if asked is None else asked.unionByName(mine)
    there = sizes.select("segment", F.col("value").alias("b"), F.col("n").alias("n_b"))
    # a value with a single fingerprint has nothing to meet under itself
    met = asked.join(there, ["segment", "b"]).where((F.col("a") != F.col("b")) | (F.col("n_a") > 1))
    return met.select("segment", "a", "b", F.greatest("n_a", "n_b").alias("most"))


def links(fingerprints: DataFrame, radius: int = 2, segments: int = 2) -> DataFrame:
    """Edges (a, b) between different fingerprints, enough to connect all pairs within the radius.

    ``fingerprints`` has distinct ``fp``. Under values with at most ``BUSY``
    fingerprints every linked pair is an edge; elsewhere all that lies under
    one of the 65 words near a fingerprint is joined to the smallest.
    """
    if radius > 2:
        raise ValueError("values with many fingerprints are resolved up to a radius of 2")
    fp = F.col("fp")
    places = F.array(*[F.struct(F.lit(s).alias("segment"), _segment(fp, s, segments).alias("value")) for s in range(segments)])
    filed = staged(fingerprints.select("fp", F.inline(places)), "simhash-tables")
    met = staged(_met_values(filed, segments, radii(segments, radius)), "simhash-met")
    calm, busy = met.where(F.col("most") <= BUSY), met.where(F.col("most") > BUSY)

    def under(values: DataFrame, end: str, name: str) -> DataFrame:
        return values.join(filed.select("segment", F.col("value").alias(end), fp.alias(name)), ["segment", end])

    pairs = under(under(calm, "a", "x"), "b", "y").where(
        ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)
    ).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    crowded = staged(busy.select("segment", F.explode(F.array("a", "b")).alias("value")).distinct(), "simhash-busy")
    if crowded.isEmpty():
        return pairs.distinct()
    met_there = filed.join(crowded, ["segment", "value"]).select("fp").distinct()
    return pairs.union(_near_words(met_there, radius)).distinct()


def _near_words(fingerprints: DataFrame, radius: int) -> DataFrame:
    """All links within the radius, each group's to its smallest member."""
    fp = F.col("fp")
    flips = [(1 << b) - (1 << 64) if b == 63 else 1 << b for b in range(BITS)]
    words = F.concat(F.array(fp), F.transform(F.lit(flips).cast("array<bigint>"), lambda m: fp.bitwiseXOR(m)))
    if radius == 0:
        words = F.array(fp)
    filed = fingerprints.select("fp", F.explode(words).alias("word"))
    if radius == 1:  # only the fingerprint itself is met by its neighbours
        filed = filed.withColumn("own", F.col("word") == fp)
        met = filed.groupBy("word").agg(F.max("own").alias("there"), F.collect_set("fp").alias("members"))
        return met.where("there").select(F.explode("members").alias("b"), F.col("word").alias("a")).where("a != b").select("a", "b")
    groups = filed.groupBy("word").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    return groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a != b")


def _with_components(documents: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """Joins classes to their rows; what many rows share comes by broadcast, of fewer than HOT_PARTS rows."""
    hot = F.col("members") * HOT_PARTS > n
    few = found.where(hot).select("fp", "component_id")
    by_hot = documents.join(F.broadcast(few), "fp")
    rest = documents.join(F.broadcast(few.select("fp")), "fp", "left_anti")
    return by_hot.unionByName(rest.join(found.where(~hot).select("fp", "component_id"), "fp", "left"))


def simhash_duplicates(documents: DataFrame, radius: int = 2, segments: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, kept.

    A-Z are lower-cased; words are runs of anything but space and the five
    ASCII controls around tab; shingles of ``words`` words count as often as
    they occur, a shorter text is one shingle, and a text without words (or
    null) has fingerprint zero, which is linked like any other.
    ``component_id`` is the smallest doc_id reachable over fingerprints that
    differ in at most ``radius`` bits. Rows repeated under one id each get a
    row, and with different texts they are not one node. A row without id has a fingerprint and takes no part in links: its
    component is null and it is kept. No rows in, no rows out.
    """
    plain = documents.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    printed = staged(plain.mapInArrow(_fingerprints(words), "doc_id long, fp long"), "simhash-fingerprints")
    named = printed.where(F.col("doc_id").isNotNull())
    classes = staged(named.groupBy("fp").agg(F.min("doc_id").alias("label"), F.count(F.lit(1)).alias("members")), "simhash-classes")
    edges = staged(links(classes.select("fp"), radius, segments), "simhash-links")
    # labels differ between nodes also where one id is repeated with several texts
    labels = smallest_reachable(classes.select(F.col("fp").alias("node"), F.struct("label", "fp").alias("label")), edges)
    found = classes.join(labels.select(F.col("node").alias("fp"), F.col("label.label").alias("low")), "fp", "left").select(
        "fp", F.coalesce("low", "label").alias("component_id"), "members"
    )
    joined = _with_components(named, staged(found, "simhash-components"), named.count()).unionByName(
        printed.where(F.col("doc_id").isNull()).withColumn("component_id", F.lit(None).cast("long"))
    )
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def op11(spark, sf_dir):
    return simhash_duplicates(table(spark, sf_dir, "documents"))
