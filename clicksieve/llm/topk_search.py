"""Exact top-k search by distributed histogram selection.

Vectors become integers, so scores are exact. Every query is scored against
every other row, in blocks of queries by shards of candidates. A round counts
the scores of each query in equal bins of an interval that is known to hold
its k-th best score; summed over all shards, the counts name the bin that
holds it, which is the interval of the next round. When the interval is one
value wide, rows above it are taken and ties at it are broken by the smaller
id. Only counts and at most k rows per query and shard leave a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

EXACT_IN_DOUBLE = 2**53
STRIP = 256
SHARD_ROWS = 16_384
LEAST_SHARDS = 64


def shards_for(rows: int) -> int:
    """Enough shards that each holds some ``SHARD_ROWS`` candidates, and that small tables use several tasks."""
    return max(LEAST_SHARDS, -(-rows // SHARD_ROWS))


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and floor(scale * component); vectors with a null or non-finite part are left out.

    Of several rows under one id the smallest vector counts, so repeated rows
    count once. A row without id takes no part.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    )
    return (
        vectors.where(usable)
        .select(F.col(id_col).cast("long").alias("vec_id"),
                F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"))
    )


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    rows = len(column)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(dtype) if rows else np.zeros((0, 0), dtype)


def _strips(queries: pa.Table, rows: pa.Table, dtype) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Scores of a strip of queries against the shard; the query's own row is marked."""
    q, c = _matrix(queries["v"], dtype), _matrix(rows["c"], dtype).T
    ids, own = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    for start in range(0, len(own), STRIP):
        part = slice(start, start + STRIP)
        scores = (q[part] @ c if q.shape[1] else np.zeros((len(own[part]), len(ids)))).astype(np.int64)
        yield part, scores, own[part, None] != ids[None, :]


def _counts(k: int, dtype):
    schema = pa.schema([("query_id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])

    def shard(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """Counts per bin, from the top, until k rows are counted: no lower bin can hold the k-th."""
        if not len(queries) or not len(rows):
            return schema.empty_table()
        low, width = queries["low"].to_numpy(), queries["width"].to_numpy()
        found = []
        for part, scores, other in _strips(queries, rows, dtype):
            bins = np.where(other, (scores - low[part, None]) // width[part, None], -1)
            bins = np.minimum(bins, np.where(other, queries["bins"].to_numpy()[part, None], -1))
            if bins.shape[1] > k:
                floor = np.partition(bins, bins.shape[1] - k, axis=1)[:, bins.shape[1] - k]
            else:
                floor = np.zeros(len(bins), np.int64)
            i, j = np.nonzero((bins >= floor[:, None]) & (bins >= 0))
            keys, n = np.unique(np.stack([i, bins[i, j]]), axis=1, return_counts=True)
            found.append((queries["query_id"].to_numpy()[part][keys[0]], keys[1], n))
        return pa.table([np.concatenate(x).astype(np.int64) for x in zip(*found)], schema=schema)

    return shard, "query_id long, bin long, n long"


def _taken(k: int, dtype):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def shard(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """Rows at or above the query's k-th score; at most the k best of the shard."""
        if not len(queries) or not len(rows):
            return schema.empty_table()
        ids, found = rows["vec_id"].to_numpy(), []
        for part, scores, other in _strips(queries, rows, dtype):
            i, j = np.nonzero((scores >= queries["low"].to_numpy()[part, None]) & other)
            order = np.lexsort((ids[j], -scores[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, i)  # where this query's rows begin
            keep = np.arange(len(i)) - first < k
            i, j = i[keep], j[keep]
            found.append((queries["query_id"].to_numpy()[part][i], ids[j], scores[i, j]))
        return pa.table([np.concatenate(x).astype(np.int64) for x in zip(*found)], schema=schema)

    return shard, "query_id long, vec_id long, score long"


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    bins: int = 4096,
    shards: int | None = None,
    query_block: int = 2048,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query.

    Score: inner product of the vectors scaled by ``scale`` and floored. Ties go
    to the smaller id. ``queries`` holds ids (column ``id_col``) of rows of
    ``vectors``. With fewer than k other rows, all are returned; vectors of
    different lengths have no score. ``shards`` is how many candidate groups a
    block of queries meets; unless given it follows from the number of rows, so
    a task's share does not grow with the table.
    """
    rows = staged(integer_vectors(vectors, scale, id_col, vector_col), "topk-vectors")
    largest = rows.select(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))), F.count(F.lit(1))).first()
    shards = shards or shards_for(largest[2])
    reach = (largest[0] or 0) * (largest[1] or 0) ** 2 + 1
    dtype = np.float64 if reach < EXACT_IN_DOUBLE else np.int64
    asked = rows.join(queries.select(F.col(id_col).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.select(
        F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
    )
    candidates = rows.select(
        "vec_id", F.col("v").alias("c"), F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def met(bounds: DataFrame, kernel) -> DataFrame:
        function, schema = kernel
        left = asked.join(bounds, "query_id").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        keys = ("dim", "block", "shard")
        return left.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(function, schema)

    low, width = -reach, -(-2 * reach // bins)
    bounds = asked.select(
        "query_id", F.lit(low).alias("low"), F.lit(width).alias("width"), F.lit(bins).cast("long").alias("bins"), F.lit(k).cast("long").alias("need"),
    )
    while True:
        counted = met(bounds, _counts(k, dtype)).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        at = counted.withColumn("above", F.sum("n").over(down))
        found = at.join(bounds, "query_id").groupBy("query_id", "low", "width", "bins", "need").agg(
            F.max(F.when(F.col("above") >= F.col("need"), F.col("bin"))).alias("hit"),
            F.min("bin").alias("lowest"),
        )
        # fewer than k rows in all: everything from the lowest bin on is taken
        hit = F.coalesce("hit", "lowest")
        step = max(1, -(-width // bins))
        bounds = staged(
            found.select(
                "query_id", (F.col("low") + hit * F.col("width")).alias("low"), F.lit(step).cast("long").alias("width"),
                F.ceil(F.col("width") / F.lit(step)).cast("long").alias("bins"), "need",
            ),
            "topk-bounds",
        )
        if width == 1:
            break
        width = step
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    taken = met(bounds, _taken(k, dtype)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return taken.select("query_id", "rank", "vec_id", "score")


def op3(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
