"""ROC of scores with fractions: ranges by rank instead of equal widths."""

import random

import pytest

from clicksieve.operators import evaluation


def scored(n, outlier):
    rng = random.Random(5)
    data = [(rng.random() * 1e-6 + (0.3e-6 if bot else 0), bot) for bot in (rng.random() < 0.3 for _ in range(n))]
    return data + [(outlier, True), (0.0, False), (-0.0, True)]


@pytest.mark.parametrize("outlier", [1e300, 0.5])
def test_area_with_a_far_outlier(spark, outlier):
    data = scored(3000, outlier)
    traffic = spark.createDataFrame(data, "s double, is_actually_bot boolean")
    order = sorted({s for s, _ in data}, reverse=True)
    want, tp, fp = {}, 0, 0
    for s in order:
        tp += sum(b for x, b in data if x == s)
        fp += sum(not b for x, b in data if x == s)
        want[s] = (tp, fp)
    assert {r.score_at_least: (r.tp, r.fp) for r in evaluation.roc_curve(traffic, "s").collect()} == want
    bots = sorted(s for s, b in data if b)
    pairs = [(b > h) + 0.5 * (b == h) for b in bots for h in (s for s, bot in data if not bot)]
    assert evaluation.roc_auc(traffic, "s").first().auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)


def test_ranges_hold_alike_many_scores(spark):
    """Nearly all scores lie in a billionth of the range from the least to the largest."""
    traffic = spark.createDataFrame(scored(20_000, 1e300), "s double, is_actually_bot boolean")
    ranges = evaluation.ranked(evaluation.label_counts(traffic, "s", "double"), "score", rows_per_file=500)
    sizes = [r["count"] for r in ranges.groupBy(evaluation.RANGE).count().collect()]
    assert sum(sizes) == 20_002 and max(sizes) <= 500 and len(sizes) >= 40
    bounds = sorted(ranges.groupBy(evaluation.RANGE).agg({"score": "min"}).collect())
    assert [b[1] for b in bounds] == sorted(b[1] for b in bounds)
