"""Language identification with a small byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; the
largest answer of each filter in a window feeds a softmax over the languages.
The network is trained with numpy on windows of a bounded sample of labelled
documents and applied to all windows of every whole text; a document's
probabilities are the mean of its windows', weighted by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WIDTHS = (2, 3, 4)
WINDOW = 256
UNDECIDED = "und"


@dataclass
class ByteNet:
    """Weights. ``taps[w]`` is (w, 256, filters): the answer of a filter's tap to each byte."""

    languages: list[str]
    taps: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest answers of all filters per window, and where they are."""
        largest, places = [], {}
        for w, taps in self.taps.items():
            n = windows.shape[1] - w + 1
            answer = taps[0][windows[:, :n]]
            for i in range(1, w):
                answer += taps[i][windows[:, i : n + i]]
            places[w] = answer.argmax(axis=1)
            largest.append(np.take_along_axis(answer, places[w][:, None, :], axis=1)[:, 0] + self.bias[w])
        return np.maximum(np.concatenate(largest, axis=1), 0), places

    def maxima(self, windows: np.ndarray) -> np.ndarray:
        """``pooled`` without places, for applying: pairs of bytes are looked up at once."""
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        largest = []
        for w, taps in self._pair_taps().items():
            n = windows.shape[1] - w + 1
            answer = taps[0].take(pairs[:, :n], axis=0)
            for i in range(1, len(taps)):
                answer += taps[i].take(pairs[:, 2 * i : n + 2 * i], axis=0) if 2 * i + 1 < w else taps[i].take(windows[:, 2 * i : n + 2 * i], axis=0)
            largest.append(answer.max(axis=1) + self.bias[w])
        return np.maximum(np.concatenate(largest, axis=1), 0)

    def _pair_taps(self) -> dict[int, list[np.ndarray]]:
        if not hasattr(self, "_pairs"):
            self._pairs = {
                w: [
                    (t[i][:, None, :] + t[i + 1][None, :, :]).reshape(1 << 16, -1) if i + 1 < w else t[i]
                    for i in range(0, w, 2)
                ]
                for w, t in self.taps.items()
            }
        return self._pairs

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pairs"}


def windows_of(text: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last one filled with zeros, and how many bytes of each are text."""
    n = max(1, -(-len(text) // size))
    flat = np.zeros(n * size, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    lengths = np.full(n, size)
    lengths[-1] = len(text) - size * (n - 1)
    return flat.reshape(n, size), lengths


def train(texts: list[str], languages: list[str], filters: int = 8, epochs: int = 6, per_text: int = 6, seed: int = 7) -> ByteNet:
    """Fits a network with Adam. Of each text at most ``per_text`` windows, evenly spread, are used."""
    draw = np.random.default_rng(seed)
    names = sorted(set(languages))
    net = ByteNet(
        names,
        {w: draw.normal(0, 0.3 / w**0.5, (w, 256, filters)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(filters, np.float32) for w in WIDTHS},
        draw.normal(0, 0.3, (len(WIDTHS) * filters, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    x, y = [], []
    for text, language in zip(texts, languages):
        some = windows_of(text.encode())[0]
        some = some[np.unique(np.linspace(0, len(some) - 1, per_text).astype(int))]
        # a short piece of each text as well, as texts may be a few words long
        short = some[:1].copy()
        short[:, int(draw.integers(8, 60)):] = 0
        x += [some, short]
        y += [names.index(language)] * (len(some) + 1)
    if not x:
        return net
    x, y = np.concatenate(x), np.array(y)
    # rare languages weigh as much as frequent ones
    weight = (1 / np.bincount(y, minlength=len(names)).clip(1))[y] * len(y) / len(names)
    params = [net.out, net.out_bias, *net.taps.values(), *net.bias.values()]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(order), 128):
            step += 1
            rows = order[at : at + 128]
            features, places = net.pooled(x[rows])
            error = net.probabilities(features)
            error[np.arange(len(rows)), y[rows]] -= 1
            error *= (weight[rows] / len(rows))[:, None].astype(np.float32)
            back = (error @ net.out.T) * (features > 0)
            tap_grads, bias_grads = [], []
            for k, w in enumerate(WIDTHS):
                part = back[:, k * filters : (k + 1) * filters]
                grad = np.zeros_like(net.taps[w])
                for i in range(w):
                    seen = np.take_along_axis(x[rows], places[w] + i, axis=1)
                    np.add.at(grad[i], (seen, np.arange(filters)[None, :]), part)
                tap_grads.append(grad)
                bias_grads.append(part.sum(axis=0))
            for p, g, (m, v) in zip(params, [features.T @ error, error.sum(axis=0), *tap_grads, *bias_grads], moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(documents: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and whether the text has a letter to the id (and to the ``keep`` columns).

    ``und`` with score 0 if the text is null or has no letter, or if no
    language was learned. The score is the mean probability of the language.
    """
    kept = documents.select(F.col(id_col).alias("doc_id"), *(keep or []), F.col(text_col).alias("_text"))
    shape = kept.select("doc_id", *(keep or []), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("lettered")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column("_text").to_pylist()
                names, scores = predict(net, texts)
                lettered = [t is not None and has_letter(t) for t in texts]
                columns = [part.column(f.name) for f in shape.fields[:-3]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(lettered, pa.bool_())],
                    names=shape.names,
                )

    return kept.mapInArrow(run, shape)


def predict(net: ByteNet, texts: list[str | None]) -> tuple[list[str], list[float]]:
    decided = [t is not None and bool(net.languages) and has_letter(t) for t in texts]
    cut = [windows_of(t.encode()) for t, d in zip(texts, decided) if d]
    names, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
    if not cut:
        return names, scores
    windows, lengths = np.concatenate([w for w, _ in cut]), np.concatenate([n for _, n in cut])
    features = np.concatenate([net.maxima(windows[i : i + 128]) for i in range(0, len(windows), 128)])
    weighted = net.probabilities(features) * lengths[:, None]
    starts = np.cumsum([0] + [len(w) for w, _ in cut[:-1]])
    mean = np.add.reduceat(weighted, starts) / np.add.reduceat(lengths, starts)[:, None]
    for row, at in zip(mean, np.flatnonzero(decided)):
        best = int(row.argmax())
        names[at], scores[at] = net.languages[best], min(1.0, float(row[best]))
    return names, scores


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def learn(documents: DataFrame, at_most: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet:
    """Trains on at most ``at_most`` labelled documents outside the held-out fifth.

    The sample is drawn by a hash of the id, over all labelled documents; only
    it reaches the driver. Texts of more than 20,000 characters are left to
    others of their language, so the sample's size is bounded.
    """
    usable = documents.where(
        F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)) & F.length(text_col).between(1, 20_000)
    )
    n = usable.count()
    rate = min(1.0, 1.2 * at_most / max(n, 1))
    drawn = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1_000_000)) < int(rate * 1_000_000) + 1
    rows = usable.where(drawn).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(id_col, F.lit(18)).alias("h"))
    sample = sorted(rows.limit(2 * at_most).collect(), key=lambda r: (r.h, r.t))[:at_most]
    return train([r.t for r in sample], [r.l for r in sample])


BANDS = (32, 64, 128, WINDOW)  # bytes; texts of one length band are held to one least score
MARGIN = 0.95
LEAST_PIECES = 100  # a band with fewer right pieces says nothing about the scores to expect


PIECES = (8, 16, 48, 100, 200, 300)  # characters


def right_scores(net: ByteNet, texts: list[str], languages: list[str]) -> Iterator[tuple[int, float]]:
    """Length band and score of each text, and of each piece from its start, that is told right."""
    pieces = [piece for t in texts for piece in (t, *(t[:n] for n in PIECES))]
    labels = [l for l in languages for _ in range(len(PIECES) + 1)]
    for piece, label, name, score in zip(pieces, labels, *predict(net, pieces)):
        if name == label:
            yield int(np.searchsorted(BANDS, len(piece.encode()), side="right")), score


def least_scores(documents: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[float]:
    """Per length band, and for longer texts, MARGIN of the lowest score with which a held-out labelled text is told right.

    Texts that score less are unlike what the network was seen to tell, which
    is a hint and no proof. Short texts score less than long ones, so pieces of
    the texts stand for them. All held-out labelled texts are told, whole and in
    pieces, where they lie; a task sends a row per band. A band with fewer than
    LEAST_PIECES right pieces has 0.
    """
    usable = documents.where(F.col(lang_col).isNotNull() & held_out(F.col(id_col)) & (F.length(text_col) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lowest = [0] * (len(BANDS) + 1), [1.0] * (len(BANDS) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                for band, score in right_scores(net, part.column("t").to_pylist(), part.column("l").to_pylist()):
                    counts[band] += 1
                    lowest[band] = min(lowest[band], score)
        yield pa.RecordBatch.from_pydict({"band": list(range(len(counts))), "n": counts, "least": lowest})

    told = usable.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).mapInArrow(run, "band long, n long, least double")
    found = {r.band: r for r in told.groupBy("band").agg(F.sum("n").alias("n"), F.min("least").alias("least")).collect()}
    bands = range(len(BANDS) + 1)
    # no text needs more than a longer one
    lowest = np.minimum.accumulate([found[b].least if b in found else 1.0 for b in reversed(bands)])[::-1]
    return [MARGIN * float(low) if b in found and found[b].n >= LEAST_PIECES else 0.0 for b, low in zip(bands, lowest)]


def least_score(text: Column, least: list[float]) -> Column:
    """The least score of a text's length band."""
    chosen = F.lit(least[-1])
    for bound, score in reversed(list(zip(BANDS, least))):
        chosen = F.when(F.octet_length(text) < bound, F.lit(score)).otherwise(chosen)
    return chosen


def op9(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = identify(documents, learn(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
