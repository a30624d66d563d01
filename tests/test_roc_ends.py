"""ROC of scores that are NaN or infinite."""

from clicksieve.operators import evaluation


def test_roc_with_nan_and_infinite_scores(spark):
    nan, inf = float("nan"), float("inf")
    traffic = spark.createDataFrame(
        [(nan, True), (inf, True), (0.75, False), (0.5, True), (0.25, False), (-inf, False)], "s double, is_actually_bot boolean"
    )
    points = sorted((r.tp + r.fp, str(r.score_at_least), r.tp, r.fp) for r in evaluation.roc_curve(traffic, "s").collect())
    assert points == [(1, "nan", 1, 0), (2, "inf", 2, 0), (3, "0.75", 2, 1), (4, "0.5", 3, 1), (5, "0.25", 3, 2), (6, "-inf", 3, 3)]
    assert abs(evaluation.roc_auc(traffic, "s").first().auc - 8 / 9) < 1e-12
