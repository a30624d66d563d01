from __future__ import annotations

import random

import pytest

from clicksieve.operators import evaluation
from clicksieve.sources.inline import labelled_sample

# threshold: tp, tn, fp, fn, precision, recall, f1, fp loss, recommendation
SWEEP = {
    30: (10, 6, 5, 0, 66.67, 100.0, 80.0, 775.0, 71.17),
    40: (10, 6, 5, 0, 66.67, 100.0, 80.0, 775.0, 71.17),
    50: (5, 6, 5, 5, 50.0, 50.0, 50.0, 775.0, 44.5),
    60: (5, 8, 3, 5, 62.5, 50.0, 55.56, 550.0, 54.0),
    70: (5, 10, 1, 5, 83.33, 50.0, 62.5, 200.0, 69.33),
    80: (5, 11, 0, 5, 100.0, 50.0, 66.67, 0.0, 80.0),
}


@pytest.fixture(scope="module")
def traffic(spark):
    return evaluation.with_revenue(labelled_sample(spark))


@pytest.fixture(scope="module")
def performance(traffic):
    return evaluation.model_performance(traffic, analysis_date="2024-01-31")


def labels(spark, rows):
    return evaluation.with_revenue(
        spark.createDataFrame(
            [(str(i), n, bot, "x") for i, (n, bot) in enumerate(rows)],
            "ip_address string, total_clicks bigint, is_actually_bot boolean, user_type string",
        )
    )


def test_revenue(traffic):
    got = {(r.user_type, r.revenue_impact) for r in traffic.collect() if not r.is_actually_bot}
    assert got == {("Normal_User", 50.0), ("Gamer_User", 150.0), ("Heavy_Shopper", 200.0), ("Family_Shared_IP", 75.0)}
    assert {r.revenue_impact for r in traffic.collect() if r.is_actually_bot} == {0.0}


def test_profile(traffic):
    got = [tuple(r) for r in evaluation.ground_truth_profile(traffic).collect()]
    assert got[0] == ("Script_Bot", 5, 830, 5)
    assert ("Normal_User", 6, 85, 0) in got and len(got) == 9


def test_metrics(performance):
    row = evaluation.classification_metrics(performance).first()
    assert (row.true_positives, row.true_negatives, row.false_positives, row.false_negatives) == (5, 6, 5, 5)
    assert (row.precision_percent, row.recall_percent, row.f1_score) == (50.0, 50.0, 50.0)
    assert (row.accuracy_percent, row.specificity_percent) == (52.38, 54.55)
    assert (row.users_incorrectly_blocked, row.estimated_revenue_loss_usd, row.bots_missed) == (5, 775.0, 5)


def test_confusion(performance):
    got = {r.evaluation_category: (r.ip_count, r.percentage) for r in evaluation.confusion_summary(performance).collect()}
    assert got == {
        "TRUE_POSITIVE": (5, 23.81), "TRUE_NEGATIVE": (6, 28.57), "FALSE_POSITIVE": (5, 23.81), "FALSE_NEGATIVE": (5, 23.81),
    }
    matrix = {r.actual: (r.predicted_bot, r.predicted_human) for r in evaluation.confusion_matrix(performance).collect()}
    assert matrix == {"Bot": (5, 5), "Human": (5, 6)}


def test_sweep(traffic):
    got = evaluation.threshold_sweep(traffic).collect()
    assert got[0].click_threshold == 80
    for r in got:
        assert (r.tp, r.tn, r.fp, r.fn, r.precision, r.recall, r.f1_score, r.revenue_loss_usd, r.recommendation_score) == SWEEP[
            r.click_threshold
        ]
    assert len(got) == 6


def test_sweep_agrees_with_single_thresholds(spark):
    draw = random.Random(4)
    rows = [(draw.choice([None, *range(100)]), draw.choice([True, False, None])) for _ in range(400)]
    data = labels(spark, rows)
    for r in evaluation.threshold_sweep(data, (10, 55, 90, 200)).collect():
        t = r.click_threshold
        known = [(n, b) for n, b in rows if n is not None and b is not None]
        assert (r.tp, r.tn, r.fp, r.fn) == (
            sum(n > t and b for n, b in known), sum(n <= t and not b for n, b in known),
            sum(n > t and not b for n, b in known), sum(n <= t and b for n, b in known),
        )


def test_sweep_rejects_repeated_thresholds(traffic):
    with pytest.raises(ValueError):
        evaluation.threshold_sweep(traffic, (1, 1))


def test_empty_denominators_give_null(spark):
    none_predicted = evaluation.classification_metrics(evaluation.model_performance(labels(spark, [(1, True), (2, False)]))).first()
    assert (none_predicted.precision_percent, none_predicted.recall_percent, none_predicted.f1_score) == (None, 0.0, None)
    no_bots = evaluation.classification_metrics(evaluation.model_performance(labels(spark, [(99, False)]))).first()
    assert (no_bots.precision_percent, no_bots.recall_percent) == (0.0, None)
    nothing_right = evaluation.classification_metrics(evaluation.model_performance(labels(spark, [(99, False), (1, True)]))).first()
    assert (nothing_right.precision_percent, nothing_right.recall_percent, nothing_right.f1_score) == (0.0, 0.0, None)


def test_unlabelled_has_no_category(spark):
    row = evaluation.model_performance(labels(spark, [(99, None)])).first()
    assert (row.predicted_as_bot, row.evaluation_category, row.business_impact) == (True, None, None)


def test_report_and_savings(performance):
    report = evaluation.evaluation_report(performance, "2024-01-31").first()
    assert (report.total_ips_analyzed, report.true_positives, report.false_positives, report.false_negatives) == (21, 5, 5, 5)
    assert report.estimated_revenue_loss == 775.0
    saved = evaluation.net_savings(performance, budget_per_click=2.0).first()
    assert (saved.fraud_prevented, saved.false_positive_cost, saved.net_savings) == (1660.0, 775.0, 885.0)


def test_breakdown_starts_with_false_positives(performance):
    first = evaluation.user_type_breakdown(performance).first()
    assert (first.evaluation_category, first.user_type, first.revenue_impact) == ("FALSE_POSITIVE", "Heavy_Shopper", 400.0)


def test_review_queue(traffic):
    assert {r.total_clicks for r in evaluation.review_queue(traffic).collect()} == {45, 46, 47, 48, 49, 51, 55}


@pytest.mark.parametrize("spread", [10, 10**6])
def test_roc_against_brute_force(spark, spread):
    draw = random.Random(5)
    rows = [(draw.randrange(-spread, spread), draw.random() < 0.3) for _ in range(300)]
    data = labels(spark, rows)
    bots, humans = sum(b for _, b in rows), sum(not b for _, b in rows)
    expected = {
        s: (sum(n >= s and b for n, b in rows), sum(n >= s and not b for n, b in rows)) for s in {n for n, _ in rows}
    }
    curve = evaluation.roc_curve(data).collect()
    assert {r.score_at_least: (r.tp, r.fp) for r in curve} == expected
    assert all(r.tpr == r.tp / bots and r.fpr == r.fp / humans for r in curve)
    pairs = sum((a > c) + 0.5 * (a == c) for a, x in rows if x for c, y in rows if not y)
    assert evaluation.roc_auc(data).first().auc == pytest.approx(pairs / (bots * humans))


@pytest.mark.parametrize("scores", [[0.9, 0.8, 0.2, 0.1], [0.5, 0.5, 0.5, 0.5], [-1e9, 3.25, 3.5, 1e9]])
def test_roc_of_fractions(spark, scores):
    rows = [(s, i < 2) for i, s in enumerate(scores)]
    data = spark.createDataFrame(rows, "total_clicks double, is_actually_bot boolean")
    pairs = [(a > c) + 0.5 * (a == c) for a, x in rows if x for c, y in rows if not y]
    assert evaluation.roc_auc(data).first().auc == pytest.approx(sum(pairs) / len(pairs))
    assert [r.score_at_least for r in evaluation.roc_curve(data).orderBy("score_at_least").collect()] == sorted(set(scores))


def test_data_quality(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, "x")], "a int, b string")
    got = {r.column_name: (r.row_count, r.null_count, r.null_percent) for r in evaluation.data_quality(df).collect()}
    assert got == {"a": (3, 1, 33.33), "b": (3, 2, 66.67)}


def test_drift(spark):
    df = labels(spark, [(99, True), (1, True), (99, False)]).selectExpr("*", "date'2024-01-01' as evaluation_date")
    row = evaluation.model_drift(evaluation.model_performance(df)).first()
    assert (row.tp, row.fn, row.fp, row.precision_percent, row.recall_percent) == (1, 1, 1, 50.0, 50.0)
