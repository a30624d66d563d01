"""The least scores of the language stage come from all held-out texts."""

import random
import zlib

import numpy as np
import pytest

from clicksieve.llm import language_id


@pytest.fixture(scope="module")
def texts():
    """(id, text, label) of 2,000 held-out texts of two languages, one of them long, and some that do not count."""
    draw = random.Random(5)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit", "amet"], "bb": ["zwei", "drei", "vier", "schön", "über"]}
    ids = [i for i in range(12_000) if zlib.crc32(str(i).encode()) % 5 == 0][:2_000]
    found = []
    for n, i in enumerate(ids):
        label = ("aa", "bb")[n % 2]
        mixed = words["aa"] + words["bb"] if n % 7 == 0 else words[label]
        found.append((i, " ".join(draw.choice(mixed) for _ in range(5_000 if n == 8 else draw.randrange(1, 60))), label))
    return found


def test_all_held_out_texts_count(spark, texts):
    net = language_id.train([t for _, t, _ in texts[:200]], [l for _, _, l in texts[:200]], epochs=2)
    other = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    extra = [(other, "zwei lorem ipsum", "aa"), (texts[0][0], None, "aa"), (texts[0][0], "", "aa"), (texts[0][0], "lorem", None)]
    docs = spark.createDataFrame(texts + extra, "doc_id long, text string, lang string").repartition(6)
    right = [[] for _ in range(len(language_id.BANDS) + 1)]
    for _, text, label in texts:
        for piece in (text, *(text[:n] for n in (8, 16, 48, 100, 200, 300))):
            (name,), (score,) = language_id.predict(net, [piece])
            if name == label:
                right[int(np.searchsorted(language_id.BANDS, len(piece.encode()), side="right"))].append(score)
    assert all(len(scores) >= language_id.LEAST_PIECES for scores in right)
    want = [language_id.MARGIN * min(min(s) for s in right[b:]) for b in range(len(right))]
    assert language_id.least_scores(docs, net) == pytest.approx(want, rel=1e-5)


def test_few_pieces_say_nothing(spark, texts):
    net = language_id.train([t for _, t, _ in texts[:50]], [l for _, _, l in texts[:50]], epochs=1)
    docs = spark.createDataFrame(texts[:10], "doc_id long, text string, lang string")
    assert language_id.least_scores(docs, net) == [0.0] * 5
    assert language_id.least_scores(docs.limit(0), net) == [0.0] * 5
