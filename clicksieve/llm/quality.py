"""Quality classifier: cumulative-link regression on graded ratings.

A text's distinct words, hashed to a table of weights shared by all grades,
give one latent score; ordered thresholds cut the score into grades. The model
says P(grade > g) = sigmoid(score - threshold_g). From these come the expected
grade, for ranking, and a tail probability, for selection.

It is fitted with numpy on a bounded sample of labelled rows and applied to
every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, whole, worker_table

SLOTS = 1 << 16
FULL_WORDS = 30  # up to so many distinct words each counts whole
CACHED_WORDS = 500_000
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s]+")


@dataclass
class OrdinalModel:
    """Weights by slot and increasing thresholds; one threshold fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g, per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


class _Slots(dict):
    """Slots of raw words: the word without its marks, the marks, and its writing."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        letters, marks = _LETTERS.findall(word), _MARKS.findall(word)
        names = [w.lower() for w in letters] + ["\0mark " + m[:3] for m in marks]
        if not letters:
            names.append("\0no letters")
        elif len(word) > 1 and word.upper() == word:
            names.append("\0upper case")
        self[word] = slots = tuple(zlib.crc32(n.encode()) % SLOTS for n in names)
        return slots


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: one value for all distinct words, and shares of marks, capitals and repeats.

    The words of a long text count less each, so that a text isn't judged by
    its length and its shares still show among many words.
    """
    words = text.split()
    known = worker_table("slots of words", _Slots)
    distinct = set(words)
    present = np.fromiter({s for w in distinct for s in known[w]}, np.int64)
    n = len(words)
    value = np.full(len(present), min(1.0, (FULL_WORDS / max(len(present), 1)) ** 0.5))
    if not n:
        return present, value
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?\"')" for w in words) / n
    bare = sum(not any(map(str.isalpha, w)) for w in words) / n
    repeated = 1 - len(distinct) / n if n >= 20 else 0.0
    shares = {"upper": upper, "marked": marked, "bare": bare, "repeated": repeated * repeated}
    slots = [zlib.crc32(("\0share " + k).encode()) % SLOTS for k in shares]
    return np.concatenate([present, slots]), np.concatenate([value, [10 * v for v in shares.values()]])


def fit(texts: list[str], grades: list[int], epochs: int = 8, rate: float = 0.05, decay: float = 2e-5, seed: int = 3) -> OrdinalModel:
    """Fits by stochastic gradient steps with per-weight rates (Adagrad)."""
    top = max(grades, default=1)
    model = OrdinalModel(np.zeros(SLOTS), np.linspace(-3.0, -2.0, max(top, 1)))
    rows = [features(t) for t in texts]
    grown, moved = np.full(SLOTS, 1e-2), np.full(len(model.thresholds), 1e-2)
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            slots, values = rows[i]
            above = (grades[i] > np.arange(len(model.thresholds))).astype(float)
            error = model.tails(np.array([model.weights[slots] @ values]))[0] - above
            step = error.sum() * values + decay * model.weights[slots]
            grown[slots] += step * step
            model.weights[slots] -= rate * step / np.sqrt(grown[slots])
            moved += error * error
            # ordered whatever the step was
            model.thresholds = np.maximum.accumulate(model.thresholds + rate * error / np.sqrt(moved))
    return model


def graded(labels: DataFrame) -> Column:
    """Grade of a rating: 0 poor, 1 well made but toxic, 2 well made and clean; null without a rating."""
    return F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).when(F.col("quality") == 1, 2)


def learn(documents: DataFrame, labels: DataFrame, at_most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most ``at_most`` labelled documents, drawn by a hash of the id over all of them.

    Texts of more than 20,000 characters are not drawn, so the size of the
    sample, the only thing that reaches the driver, is bounded.
    """
    rated = labels.select(F.col("doc_id").alias("_rated"), graded(labels).alias("grade")).where(F.col("grade").isNotNull())
    rated = rated.groupBy("_rated").agg(F.min("grade").alias("grade"))  # of several ratings the lowest counts
    n = rated.count()
    share = min(1.0, 1.3 * at_most / max(n, 1))
    drawn = rated.where(F.pmod(F.xxhash64("_rated", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    short = documents.where(F.length(text_col) <= 20_000)
    rows = short.join(F.broadcast(drawn.limit(2 * at_most)), F.col(id_col) == F.col("_rated")).select(
        F.col(text_col).alias("t"), "grade", F.xxhash64("_rated", F.lit(6)).alias("h")
    )
    sample = sorted(rows.limit(2 * at_most).collect(), key=lambda r: (r.h, r.t))[:at_most]
    return fit([r.t for r in sample], [r.grade for r in sample])


def score(
    documents: DataFrame, model: OrdinalModel, wanted_grade: int = 2, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """doc_id (and the ``keep`` columns), expected_grade, tail and kept, per document.

    ``tail`` is P(grade >= wanted_grade); a document is kept from ``least`` on.
    Null text is empty, and an empty text has the grade of the thresholds alone.
    """
    plain = documents.select(F.col(id_col).alias("doc_id"), *(keep or []), whole(text_col).alias("_text"))
    shape = plain.select("doc_id", *(keep or []), F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                latent = np.zeros(part.num_rows)
                for i, text in enumerate(part.column("_text").to_pylist()):
                    slots, values = features(text)
                    latent[i] = model.weights[slots] @ values
                tails = model.tails(latent)
                columns = [part.column(f.name) for f in shape.fields[:-2]]
                wanted = tails[:, min(wanted_grade, tails.shape[1]) - 1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(tails.sum(axis=1)), pa.array(wanted)], names=shape.names)

    return plain.mapInArrow(run, shape).withColumn("kept", F.col("tail") >= least)


def op2(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, learn(documents, table(spark, sf_dir, "labels")))
