"""Exact dedup: a tree of merges of sorted digest runs, in DataFrame functions only.

Every text is reduced to a digest. Rows start in ``fan ** rounds`` leaf runs.
In round r the runs whose numbers agree in all but one base-``fan`` digit
exchange rows: that digit of the run number is replaced by the same digit of
the digest. Each task sorts its rows by (run, digest) and keeps one row per
digest with the best identifier and the number of copies, so what it sends is a
sorted run without repeats; where the ``fan`` runs meet they are put in order
again and neighbours that agree are merged in the same way, and the result is
written as sorted runs for the next round. After the last round a run is a
digest range and every digest is in one place. A run is spread over tasks by
digest. The verdicts then go down the same tree, so a text that fills a third
of the table is spread over all leaf runs on the way up and on the way down,
and no row count of a step depends on the size of a group.

Digests are verified: rows only merge when the SHA-256, the length in bytes
and a second, independent hash of the text all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged, whole

DIGEST = ("digest", "n_bytes", "second_hash")


def _run(level: int, rounds: int, fan: int) -> Column:
    """Run number after ``level`` rounds: digest digits in front, leaf digits behind."""
    below = fan ** (rounds - level)
    return (F.floor(F.col("_range") / below) * below + F.col("_leaf") % below).cast("int")


def signatures(documents: DataFrame, rounds: int, fan: int, id_col: str, text_col: str) -> DataFrame:
    text = lower_ascii(whole(text_col))
    hashed = documents.select(F.col(id_col).alias("doc_id"), text.alias("_text")).select(
        "doc_id",
        F.unhex(F.sha2("_text", 256)).alias("digest"),
        F.octet_length("_text").alias("n_bytes"),
        F.xxhash64("_text").alias("second_hash"),
    )
    runs = fan**rounds
    return hashed.select(
        "*",
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(runs)).cast("int").alias("_leaf"),
        F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(runs)).cast("int").alias("_range"),
    )


def _merge(runs: DataFrame, best, level: int, rounds: int, fan: int) -> DataFrame:
    """One row per run and digest, from sorted rows on both sides of the exchange.

    The best identifier is taken of a struct, which Spark aggregates over
    sorted rows and never in a hash table. A missing identifier is no struct,
    so any other is better.
    """
    located = runs.withColumn("_run", _run(level, rounds, fan))
    below = fan ** (rounds - level)
    return (
        located.groupBy("_run", *DIGEST)
        .agg(
            best(F.when(F.col("keep_id").isNotNull(), F.struct("keep_id"))).alias("_best"),
            F.sum("group_size").alias("group_size"),
            F.first("_range").alias("_range"),
            F.first(F.col("_leaf") % below).alias("_leaf"),
        )
        .withColumn("keep_id", F.col("_best.keep_id"))
        .drop("_best")
    )


def exact_groups(
    documents: DataFrame,
    keep: str = "smallest",
    rounds: int = 2,
    fan: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. ``keep`` names the survivor: the "smallest" or "largest" identifier
    of its group. Rows repeated under one identifier share its verdict and each
    count. A row without identifier never survives a group that has one; in a
    group of such rows alone, all are kept and keep_id is null. No rows in, no
    rows out.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = staged(signatures(documents, rounds, fan, id_col, text_col), "dedup-signatures")
    leaf = rows.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    levels = []
    for level in range(rounds):
        leaf = staged(_merge(leaf, best, level, rounds, fan), f"dedup-run-{level}")
        levels.append(leaf)
    verdict = _merge(leaf, best, rounds, rounds, fan)
    for level in range(rounds - 1, -1, -1):
        lower = levels[level].drop("keep_id", "group_size").withColumn("_up", _run(level + 1, rounds, fan))
        upper = verdict.select(F.col("_run").alias("_up"), *DIGEST, "keep_id", "group_size")
        verdict = lower.join(upper, ["_up", *DIGEST])
    judged = rows.withColumn("_run", _run(0, rounds, fan)).join(
        verdict.select("_run", *DIGEST, "keep_id", "group_size"), ["_run", *DIGEST]
    )
    return judged.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(documents: DataFrame, keep: str = "smallest", **options) -> DataFrame:
    """The documents that survive, all columns as they are.

    Rows repeated under one identifier stay together; see ``exact_groups``.
    Where an identifier is null, the row's group decides by its text.
    """
    id_col = options.get("id_col", "doc_id")
    gone = (
        exact_groups(documents, keep, **options)
        .where(~F.col("kept"))
        .select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
        .dropDuplicates()
    )
    text = lower_ascii(whole(options.get("text_col", "text")))
    marked = documents.withColumn("_id_of_row", F.col(id_col)).withColumn("_sha_of_row", F.sha2(text, 256))
    same = (marked["_id_of_row"].eqNullSafe(gone["_id"])) & (marked["_sha_of_row"] == gone["_sha"])
    return marked.join(gone, same, "left_anti").drop("_id_of_row", "_sha_of_row")


def op1(spark, sf_dir):
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)
"""
