"""Column layouts of the stored tables.

``timestamp_ntz`` at rest, ``double`` for every score (a 32-bit float would
move scores that sit exactly on a cut-off), ``bigint`` for every count.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_S, _L, _D, _B, _T = StringType(), LongType(), DoubleType(), BooleanType(), TimestampNTZType()
_LIST = ArrayType(StringType())


def _table(required: str, **columns) -> StructType:
    needed = set(required.split())
    return StructType([StructField(name, kind, name not in needed) for name, kind in columns.items()])


BID_LOGS = _table(
    "bid_request_id timestamp ip_address",
    bid_request_id=_S, timestamp=_T, ip_address=_S, user_agent=_S, time_to_click_ms=_L,
    campaign_id=_S, publisher_id=_S, advertiser_id=_S, device_type=_S, country_code=_S,
    region=_S, event_type=_S, processed_at=_T,
)

SUSPECT_IPS = _table(
    "ip_address",
    ip_address=_S, total_clicks=_L, distinct_uas=_L, fastest_click_ms=_L,
    avg_click_interval_ms=_D, fraud_flags=_LIST, fraud_reasons=_LIST, detection_methods=_LIST,
    country_code=_S, device_type=_S, first_seen=_T, last_seen=_T,
    primary_fraud_reason=_S, detected_at=_T,
)

FINAL_RISK_SCORES = _table(
    "ip_address risk_score",
    ip_address=_S, risk_score=_D, risk_level=_S, velocity_score=_D, volume_score=_D,
    ua_rotation_score=_D, fraud_flag=_B, confidence_level=_D, country_code=_S, device_type=_S,
    total_clicks=_L, distinct_uas=_L, fastest_click_ms=_L, fraud_reasons=_LIST,
    detection_methods=_LIST, is_processed=_B, detected_at=_T, scored_at=_T,
)

ACTIONABLE_ALERTS = _table(
    "ip_address final_action",
    alert_id=_S, ip_address=_S, final_action=_S, priority=_S, risk_score=_D, risk_level=_S,
    fraud_reason=_S, evidence_summary=_S, action_status=_S, actioned_by=_S, actioned_at=_T,
    created_at=_T, expires_at=_T, confidence_level=_D, country_code=_S, total_clicks=_L,
    fastest_click_ms=_L,
)

TRAFFIC_EVALUATION = _table(
    "ip_address total_clicks is_actually_bot",
    ip_address=_S, total_clicks=_L, is_actually_bot=_B, user_type=_S, revenue_impact=_D,
    evaluation_date=DateType(),
)

MODEL_PERFORMANCE = _table(
    "ip_address",
    ip_address=_S, total_clicks=_L, user_type=_S, is_actually_bot=_B, revenue_impact=_D,
    predicted_as_bot=_B, evaluation_category=_S, business_impact=_S, analysis_date=_T,
)
