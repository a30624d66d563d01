"""MinHash near-dedup with bottom-k sketches from one hash function.

A document is the set of its five-word shingles, each one 64-bit hash. Equal
sets form a class, and only one document of each class goes on. Its sketch is
the k smallest hashes. Inverted lists of retained values give the candidates:
as two similar sketches share most of their values, they already share one
among their rarest, so only a short prefix of each sketch, rarest values
first, is listed, and values that occur once are not listed at all. That keeps
passages which many documents quote out of the lists.

A list is compared in blocks of bounded size. Within a pair of blocks, shared
retained values are counted, the sketch of the union estimates similarity, and
what is left is confirmed on the full sets. Of the links that are found only a
spanning forest leaves the task, so a group of copies never becomes all its
pairs. Components are then the smallest ids that can be reached, found by
rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table, whole, worker_table

K = 64
MISSED = 2e-7  # the largest part of the links at exactly ``percent`` that sketches may miss
LEAST_PERCENT = 80
BLOCK = 128
CACHED_WORDS = 500_000
_MIX = tuple(np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    listed = text.encode().lower().split()  # of bytes, both know ASCII only
    known = worker_table("shingle words", _Hashes)
    hashed = np.fromiter(map(known.__getitem__, listed), np.uint64, len(listed))
    size = min(words, len(hashed))
    if not size:
        return hashed
    n = len(hashed) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[i % len(_MIX)] + hashed[i : i + n]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def signature(values: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else b""


def _sets(with_sets: bool):
    """Batches of (doc_id, text) to signatures with sketches, or with full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t) for t in part.column("text").to_pylist()]
                columns = [
                    part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()),
                ]
                if with_sets:
                    columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
                else:
                    columns.append(pa.array([s[:K].view(np.int64) for s in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "full" if with_sets else "sketch"])

    return run


@lru_cache
def shared_values(percent: int) -> int:
    """Of K retained values, how many linked sets share: fewer come with a probability of at most MISSED."""
    likely = percent / 100
    below, fewer = 0, 0.0
    while below < K:
        fewer += comb(K, below) * likely**below * (1 - likely) ** (K - below)
        if fewer > MISSED:
            break
        below += 1
    return below


def whole_up_to(percent: int) -> int:
    """Sizes of sets whose own sketch, and that of any set linked to them, is the whole set."""
    return percent * K // 100


def _prefix_length(n, percent: int):
    """Retained values to list: with fewer the shared ones could be missed."""
    exact = n - F.floor((n * percent + 99) / 100) + 1
    return F.when(n <= whole_up_to(percent), exact).otherwise(F.least(n, F.lit(K)) - shared_values(percent) + 1).cast("int")


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """(list, cid): the inverted lists, each under the most frequent value it is met with.

    Documents of one family share many values, whose lists would hold the same
    members again and again. A list is therefore filed under the most frequent
    value in any prefix that holds it; lists filed together are compared once.
    """
    values = classes.select("cid", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > 1)
    shared = values.join(often, "value").groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("often", "value"))).alias("shared")
    ).join(classes.select("cid", "n"), "cid")
    retained = F.least("n", F.lit(K)).cast("int")
    room = _prefix_length(F.col("n"), percent) - (retained - F.size("shared"))  # the values that occur once come first
    prefixes = shared.where(room > 0).select("cid", F.slice("shared", F.lit(1), F.greatest(room, F.lit(0))).alias("prefix"))
    # one of two equally frequent values must win in all documents
    top = F.element_at("prefix", -1)
    listed = staged(prefixes.select("cid", top.alias("top"), F.explode("prefix").alias("entry")), "neardup-prefixes")
    filed = listed.groupBy("entry").agg(F.max("top").alias("file"))
    return listed.join(filed, "entry").select(F.col("file.value").alias("list"), "cid").distinct()


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the values met on both sides."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    counts = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return counts.astype(np.int64)

    def cells(flat, sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        return row[hit], at[hit]

    (row_a, at_a), (row_b, at_b) = cells(flat_a, a), cells(flat_b, b)
    for start in range(0, len(common), 4096):
        wide = min(4096, len(common) - start)
        m = [np.zeros((len(sets), wide), np.float32) for sets in (a, b)]
        for matrix, row, at in ((m[0], row_a, at_a), (m[1], row_b, at_b)):
            here = (at >= start) & (at < start + wide)
            matrix[row[here], at[here] - start] = 1
        counts += m[0] @ m[1].T
    return np.rint(counts).astype(np.int64)


def union_estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from the sketch of each union; rows are sketches padded with the largest value."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    last = np.iinfo(np.uint64).max
    again = np.zeros(both.shape, bool)
    again[:, 1:] = both[:, 1:] == both[:, :-1]
    real = both != last
    rank = np.cumsum(~again & real, axis=1)
    inside = real & (rank <= K)
    return (again & inside).sum(axis=1) / np.maximum(1, (~again & inside).sum(axis=1))


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of two blocks are linked: 100 * intersection >= percent * union."""
    n_a, n_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    small, large = np.minimum.outer(n_a, n_b), np.maximum.outer(n_a, n_b)
    possible = (100 * small >= percent * large) & (small > 0)
    if not possible.any():
        return possible
    sketch_a, sketch_b = [s[:K] for s in a], [s[:K] for s in b]
    whole_sketches = large <= whole_up_to(percent)
    needed = np.where(whole_sketches, -(-large * percent // 100), np.minimum(small, shared_values(percent)))
    possible &= _overlaps(sketch_a, sketch_b) >= needed
    i, j = np.nonzero(possible)
    if len(i):
        padded = [np.full((len(x), K), np.iinfo(np.uint64).max) for x in (a, b)]
        for matrix, sketches in zip(padded, (sketch_a, sketch_b)):
            for row, s in enumerate(sketches):
                matrix[row, : len(s)] = s
        for at in range(0, len(i), 8192):
            part = slice(at, at + 8192)
            estimate = union_estimates(padded[0][i[part]], padded[1][j[part]])
            possible[i[part], j[part]] = estimate >= (shared_values(percent) - 1) / K
    rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
    if len(rows):
        shared = np.zeros(possible.shape, np.int64)
        shared[np.ix_(rows, columns)] = _overlaps([a[r] for r in rows], [b[c] for c in columns])
        possible &= 100 * shared >= percent * (n_a[:, None] + n_b[None, :] - shared)
    return possible


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _forest(names_a: list, names_b: list, mask: np.ndarray) -> list[tuple]:
    """A spanning forest of the links, each tree as edges to its first member."""
    place = {name: i for i, name in enumerate(dict.fromkeys(names_a + names_b))}
    root = list(range(len(place)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*(x.tolist() for x in np.nonzero(mask))):
        a, b = find(place[names_a[i]]), find(place[names_b[j]])
        root[max(a, b)] = min(a, b)
    names = list(place)
    return [(names[r], names[x]) for x in range(len(names)) if (r := find(x)) != x]


def _compared(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (list, left, right, side); a pair of blocks is held at a time."""
        key, sides, out = None, ([], []), []

        def close():
            left, right = sides
            other = right or left
            if left and (right or len(left) > 1):
                mask = linked([s for _, s in left], [s for _, s in other], percent)
                out.extend(_forest([n for n, _ in left], [n for n, _ in other], mask))

        def emitted():
            batch = pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], schema=_EDGES)
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("list", "left", "right", "side", "cid", "full")]
            for *pair, side, cid, full in zip(*columns):
                if pair != key:
                    close()
                    key, sides = pair, ([], [])
                sides[side].append((cid, np.frombuffer(full, np.uint64)))
            if len(out) > 10_000:
                yield emitted()
        close()
        yield emitted()

    return run


def _links(documents: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges between classes: a spanning forest per pair of blocks."""
    lists = staged(_lists(classes, percent), "neardup-lists")
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    busy = lists.join(sizes, "list")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    # the full sets are made again for members of lists only
    wanted = busy.select("cid").distinct().join(classes.select("cid", "sig", F.col("doc_id").alias("_id")), "cid")
    texts = documents.join(wanted.select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    full = texts.mapInArrow(_sets(True), "doc_id long, n long, sig binary, full binary").join(
        wanted.withColumnRenamed("_id", "doc_id"), ["doc_id", "sig"]
    ).dropDuplicates(["cid"])
    full = staged(full.select("cid", "full"), "neardup-sets")
    met = busy.withColumn("_block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "list", "cid",
        F.least("_block", "_other").alias("left"), F.greatest("_block", "_other").alias("right"),
        (F.col("_block") > F.col("_other")).cast("int").alias("side"),
    )
    pairs = met.join(full, "cid").repartition("list", "left", "right").sortWithinPartitions("list", "left", "right", "side")
    return pairs.mapInArrow(_compared(percent), "a long, b long").distinct()


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest label reachable; ``nodes`` has (node, label), ``edges`` (a, b).

    Each round takes the smallest label of the neighbours, then the label of
    the node that had this label first, which doubles the distance covered.
    """
    both = staged(edges.union(edges.select("b", "a")).toDF("a", "b").distinct(), "components-edges")
    labels = staged(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi"), "components-0")
    first = labels.select(F.col("label").alias("home"), F.col("node").alias("owner"))
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        # owner of the low label, and what that node has reached itself
        reached = first.join(labels.select(F.col("node").alias("owner"), F.col("label").alias("far")), "owner").select(
            F.col("home").alias("low"), "far"
        ).groupBy("low").agg(F.min("far").alias("far"))
        new = staged(
            lower.join(reached, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("label"), F.col("label").alias("old")),
            f"components-{step}",
        )
        labels = new.select("node", "label")
        if new.where(F.col("label") < F.col("old")).isEmpty():
            return labels


def near_duplicates(documents: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but space and the five ASCII controls around
    tab, A-Z lower-cased; a text of fewer than five words is one shingle. Sets
    with ``100 * intersection >= percent * union`` are linked (percent from 80
    on); ``component_id`` is the smallest doc_id reachable. Documents without
    words, and rows without id, are linked with nothing and kept; their
    component is their own id. Rows repeated under one id each get a row.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"the sketches are large enough for {LEAST_PERCENT} percent and more")
    plain = documents.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    sketched = staged(plain.mapInArrow(_sets(False), "doc_id long, n long, sig binary, sketch array<long>"), "neardup-sketches")
    usable = sketched.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    smallest = usable.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    classes = staged(usable.join(smallest, ["sig", "doc_id"]).dropDuplicates(["sig"]).select(
        F.monotonically_increasing_id().alias("cid"), "sig", "doc_id", "n", "sketch"), "neardup-classes")
    labels = smallest_reachable(
        classes.select(F.col("cid").alias("node"), F.col("doc_id").alias("label")), staged(_links(plain, classes, percent), "neardup-links")
    )
    found = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(
        "sig", F.coalesce("label", "doc_id").alias("_component")
    )
    # the class is joined for documents that have one; a hot class is one row there
    joined = sketched.select("doc_id", F.col("n").alias("n_shingles"), "sig").join(found, "sig", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("_component"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each group left, all columns as they are."""
    judged = near_duplicates(documents, percent, id_col, text_col)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def op4(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
