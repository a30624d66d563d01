from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from clicksieve.operators import volume
from tests.conftest import rows


def metrics(spark, **values):
    row = {"ip_address": "a", "total_events": 1, "distinct_uas": 1, "distinct_campaigns": 1, "distinct_publishers": 1}
    row.update(values)
    return spark.createDataFrame([row])


@pytest.mark.parametrize(
    "values, reason, flags",
    [
        ({"total_events": 1000}, None, None),
        ({"total_events": 1001}, "HIGH_VOLUME_SUSPECT", ["HIGH_VOLUME"]),
        ({"total_events": 5000}, "HIGH_VOLUME_SUSPECT", ["HIGH_VOLUME"]),
        ({"total_events": 5001}, "EXTREME_HIGH_VOLUME", ["HIGH_VOLUME"]),
        ({"distinct_uas": 5}, None, None),
        ({"distinct_uas": 6}, "UA_ROTATION_BOT", ["UA_ROTATION"]),
        ({"distinct_uas": 10}, "UA_ROTATION_BOT", ["UA_ROTATION"]),
        ({"distinct_uas": 11}, "AGGRESSIVE_UA_ROTATION", ["UA_ROTATION"]),
        ({"distinct_campaigns": 50}, None, None),
        ({"distinct_campaigns": 51}, "CAMPAIGN_SPAMMER", ["CAMPAIGN_SPAM"]),
        ({"distinct_publishers": 21}, None, None),
        ({"distinct_publishers": 21, "distinct_uas": 6}, "UA_ROTATION_BOT", ["UA_ROTATION", "PUBLISHER_HOPPING"]),
        ({"distinct_publishers": 20, "distinct_uas": 6}, "UA_ROTATION_BOT", ["UA_ROTATION"]),
    ],
)
def test_cut_offs(spark, values, reason, flags):
    found = volume.flag_high_volume(metrics(spark, **values)).collect()
    if reason is None:
        assert found == []
    else:
        assert (found[0].fraud_reason, found[0].fraud_flags) == (reason, flags)


def random_logs(make_logs, seed, n=3000):
    draw = random.Random(seed)
    maybe = lambda v: None if draw.random() < 0.1 else v
    return make_logs(
        (
            "hot" if draw.random() < 0.4 else f"ip{draw.randrange(40)}",
            draw.randrange(86_400_000),
            {
                "user_agent": maybe(f"u{draw.randrange(30)}"),
                "campaign_id": maybe(f"c{draw.randrange(90)}"),
                "publisher_id": maybe(f"p{draw.randrange(9)}"),
                "country_code": maybe(draw.choice(["US", "DE"])),
                "device_type": maybe(draw.choice(["mobile", "tablet"])),
            },
        )
        for _ in range(n)
    )


def test_grouping_sets_equal_plain_distinct_counts(make_logs):
    logs = random_logs(make_logs, 1)
    plain = logs.groupBy("ip_address").agg(
        F.count(F.lit(1)),
        F.count_distinct("user_agent"),
        F.count_distinct("campaign_id"),
        F.count_distinct("publisher_id"),
        F.min("timestamp"),
        F.max("timestamp"),
        F.min("country_code"),
        F.min("device_type"),
    )
    assert rows(volume.volume_metrics(logs)) == rows(plain)


def test_address_with_only_nulls_counts_zero(make_logs):
    nothing = {c: None for c in ("user_agent", "campaign_id", "publisher_id", "country_code", "device_type")}
    row = volume.volume_metrics(make_logs([("a", 1, nothing), ("a", 2, nothing)])).first()
    assert (row.total_events, row.distinct_uas, row.distinct_campaigns, row.country_code) == (2, 0, 0, None)


def test_summary(make_logs):
    logs = make_logs([("a", i, {"user_agent": f"u{i}"}) for i in range(7)] + [("b", 1)])
    row = volume.volume_phase_summary(volume.high_volume_suspects(logs)).first()
    assert tuple(row) == ("HIGH_VOLUME_FILTER", 1, 7, 7.0, 1)
