"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and reread as the next one's documents. All but the last keep the
columns of documents as they are and drop rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicksieve.llm import exact_dedup, language_id, near_dedup, packing, quality
from clicksieve.llm.common import staged, table


def _kept(docs: DataFrame, judged: DataFrame, columns: list[str]) -> DataFrame:
    return judged.where(F.col("_keep")).select(*(F.col(f"_doc.`{c}`").alias(c) for c in columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose grade is more likely below the best than not."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    # the whole row goes through the classifier, whatever its columns are called
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id"), F.col("text"))
    return _kept(docs, quality.score(rows, model, keep=["_doc"]).withColumnRenamed("kept", "_keep"), docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the network does not tell.

    That is so where it is less sure than with the held-out texts of that
    length, unless what it predicts is what the document is labelled: a label,
    which is no input of the prediction, confirms a doubtful one. Documents
    without a letter go as well. Where nothing is labelled to learn from, all
    documents are judged the same, but no language is told and no least score
    found, so those with a letter stay.
    """
    net = language_id.learn(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id"), F.col("text"), F.col("lang").alias("_label"))
    least = language_id.least_score(F.col("text"), language_id.least_scores(docs, net))
    judged = language_id.identify(rows.withColumn("_least", least), net, keep=["_doc", "_label", "_least"])
    confirmed = F.col("lang_pred").eqNullSafe(F.col("_label"))
    told = F.col("lang_pred") != language_id.UNDECIDED if net.languages else F.col("lettered")
    return _kept(docs, judged.withColumn("_keep", told & (confirmed | (F.col("score") >= F.col("_least")))), docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, sets that agree by 80 % or more, the one with the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, sources mixed in proportion."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("packing", packed),
]

# Two stages are trained models, which SQL cannot express; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
    return docs
