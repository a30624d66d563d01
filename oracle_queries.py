"""The registered queries once more, as SQL for another engine.

Written from the rules and not from the Spark code: plain windows over whole
addresses, ``count(distinct)``, ``stddev_samp`` and so on. The text runs on the
given tables only, so each query starts with the adapter views it needs.
"""

from __future__ import annotations

AS_OF = "timestamp '2024-01-31 00:00:00'"

LOGS = """
keyed_lineitem AS (
  SELECT *, cast(floor(sqrt(l_suppkey)) AS BIGINT) + 1 AS g FROM lineitem
),
bid_logs AS (
  SELECT 'L-' || l_orderkey || '-' || l_linenumber AS bid_request_id,
         timestamp '2024-01-30' + to_milliseconds(
           (l_orderkey * 104729 + l_linenumber::BIGINT * 15485863 + l_partkey * 7919) % 86400000) AS ts,
         '10.1.0.' || g AS ip_address,
         'ua-' || (l_partkey % (3 * g)) AS user_agent,
         cast(l_quantity AS BIGINT) AS time_to_click_ms,
         'c-' || (l_partkey % (8 * g)) AS campaign_id,
         'p-' || (l_orderkey % (4 * g)) AS publisher_id,
         cast(NULL AS VARCHAR) AS advertiser_id,
         ['mobile', 'desktop', 'tablet'][(g % 3)::INT + 1] AS device_type,
         ['US', 'CN', 'RU', 'BR', 'IN', 'DE', 'GB', 'FR'][(g % 8)::INT + 1] AS country_code,
         cast(NULL AS VARCHAR) AS region,
         'click' AS event_type,
         cast(NULL AS TIMESTAMP) AS processed_at
  FROM keyed_lineitem
  UNION ALL
  SELECT 'E-' || event_id, ts,
         '10.2.' || (user_id // 256) || '.' || (user_id % 256),
         props, cast(floor(value * 10) AS BIGINT),
         'c-' || (event_id % 9), 'p-' || (event_id % 4), NULL,
         ['mobile', 'desktop', 'tablet'][(user_id % 3)::INT + 1],
         ['US', 'CN', 'RU', 'BR', 'IN', 'DE', 'GB', 'FR'][(user_id % 8)::INT + 1],
         NULL, event_type, NULL
  FROM events
)"""

RECENT = f"""
recent AS (SELECT * FROM bid_logs WHERE ts >= {AS_OF} - INTERVAL 24 HOUR)"""

BY_DAY = """
recent AS (SELECT *, cast(ts AS DATE) AS event_day FROM bid_logs)"""

# Sliding windows of a day that end on every hour and are closed at the end of
# the stream: the watermark is the newest event less ten minutes.
BY_WINDOW = """
hourly AS (SELECT unnest(range(1, 25)) AS h),
recent AS (
  SELECT b.*, date_trunc('hour', ts) + to_hours(h::INT) AS window_end
  FROM bid_logs b, hourly
  WHERE date_trunc('hour', ts) + to_hours(h::INT)
        <= (SELECT max(ts) FROM bid_logs) - INTERVAL 10 MINUTE
)"""


def detectors(keys: str) -> str:
    return f"""
volume AS (
  SELECT {keys}, count(*) AS total_events, count(DISTINCT user_agent) AS distinct_uas,
         count(DISTINCT campaign_id) AS distinct_campaigns,
         count(DISTINCT publisher_id) AS distinct_publishers,
         min(ts) AS first_seen, max(ts) AS last_seen,
         min(country_code) AS country_code, min(device_type) AS device_type
  FROM recent GROUP BY {keys}
),
gaps AS (
  SELECT *, lag(ts) OVER w AS prev_ts, date_diff('millisecond', lag(ts) OVER w, ts) AS gap
  FROM recent WINDOW w AS (PARTITION BY {keys} ORDER BY ts, bid_request_id)
),
velocity AS (
  SELECT {keys}, count(*) AS total_clicks, min(gap) AS fastest_click_ms,
         avg(gap) AS avg_click_interval_ms, quantile_cont(gap, 0.5) AS median_click_ms,
         stddev_samp(gap) AS click_interval_stddev,
         count(*) FILTER (gap < 50) AS ultra_fast_clicks,
         count(*) FILTER (gap < 100) AS very_fast_clicks,
         min(country_code) AS country_code, min(device_type) AS device_type,
         min(ts) AS first_seen, max(ts) AS last_seen
  FROM gaps WHERE gap IS NOT NULL GROUP BY {keys}
),
high_volume AS (
  SELECT *,
    list_filter([CASE WHEN total_events > 1000 THEN 'HIGH_VOLUME' END,
                 CASE WHEN distinct_uas > 5 THEN 'UA_ROTATION' END,
                 CASE WHEN distinct_campaigns > 50 THEN 'CAMPAIGN_SPAM' END,
                 CASE WHEN distinct_publishers > 20 THEN 'PUBLISHER_HOPPING' END],
                lambda x: x IS NOT NULL) AS fraud_flags,
    CASE WHEN total_events > 5000 THEN 'EXTREME_HIGH_VOLUME'
         WHEN total_events > 1000 THEN 'HIGH_VOLUME_SUSPECT'
         WHEN distinct_uas > 10 THEN 'AGGRESSIVE_UA_ROTATION'
         WHEN distinct_uas > 5 THEN 'UA_ROTATION_BOT'
         WHEN distinct_campaigns > 50 THEN 'CAMPAIGN_SPAMMER'
         ELSE 'VOLUME_ANOMALY' END AS fraud_reason
  FROM volume WHERE total_events > 1000 OR distinct_uas > 5 OR distinct_campaigns > 50
),
high_velocity AS (
  SELECT *,
    list_filter([CASE WHEN fastest_click_ms < 10 THEN 'INHUMAN_SPEED' END,
                 CASE WHEN fastest_click_ms < 50 THEN 'BOT_LIKE_SPEED' END,
                 CASE WHEN fastest_click_ms < 100 THEN 'SUSPICIOUS_SPEED' END,
                 CASE WHEN ultra_fast_clicks > 100 THEN 'REPEATED_ULTRA_FAST' END,
                 CASE WHEN avg_click_interval_ms < 200 THEN 'CONSISTENTLY_FAST' END],
                lambda x: x IS NOT NULL) AS fraud_flags,
    CASE WHEN fastest_click_ms < 10 THEN 'INHUMAN_VELOCITY_BOT'
         WHEN fastest_click_ms < 50 THEN 'HIGH_VELOCITY_BOT'
         WHEN fastest_click_ms < 100 THEN 'SUSPICIOUS_VELOCITY'
         WHEN ultra_fast_clicks > 100 THEN 'REPEATED_FAST_PATTERN'
         ELSE 'VELOCITY_ANOMALY' END AS fraud_reason
  FROM velocity
  WHERE fastest_click_ms < 100 OR ultra_fast_clicks > 100 OR avg_click_interval_ms < 200
)"""


def suspects(keys: str, detected_at: str) -> str:
    return f"""
combined AS (
  SELECT {keys}, total_events AS total_clicks, total_events AS events, distinct_uas,
         NULL::BIGINT AS fastest_click_ms, NULL::DOUBLE AS avg_click_interval_ms, fraud_flags,
         fraud_reason, country_code, device_type, first_seen, last_seen,
         'HIGH_VOLUME' AS detection_method FROM high_volume
  UNION ALL
  SELECT {keys}, total_clicks, total_clicks + 1, NULL, fastest_click_ms, avg_click_interval_ms,
         fraud_flags, fraud_reason, country_code, device_type, first_seen, last_seen,
         'HIGH_VELOCITY' FROM high_velocity
),
merged AS (
  SELECT {keys}, sum(total_clicks)::BIGINT AS total_clicks, max(events) AS events_total,
         max(distinct_uas) AS distinct_uas, min(fastest_click_ms) AS fastest_click_ms,
         avg(avg_click_interval_ms) AS avg_click_interval_ms,
         list_sort(flatten(list(fraud_flags))) AS all_fraud_flags,
         list_sort(list(DISTINCT fraud_reason)) AS fraud_reasons,
         list_sort(list(DISTINCT detection_method)) AS detection_methods,
         min(country_code) AS country_code, min(device_type) AS device_type,
         min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM combined GROUP BY {keys}
),
suspects AS (
  SELECT * EXCLUDE (all_fraud_flags),
    list_sort(list_distinct(all_fraud_flags))[1:10] AS fraud_flags,
    CASE WHEN list_contains(fraud_reasons, 'INHUMAN_VELOCITY_BOT') THEN 'INHUMAN_VELOCITY_BOT'
         WHEN list_contains(fraud_reasons, 'HIGH_VELOCITY_BOT') THEN 'HIGH_VELOCITY_BOT'
         WHEN list_contains(fraud_reasons, 'EXTREME_HIGH_VOLUME') THEN 'EXTREME_HIGH_VOLUME'
         WHEN list_contains(fraud_reasons, 'HIGH_VOLUME_SUSPECT') THEN 'HIGH_VOLUME_SUSPECT'
         WHEN list_contains(fraud_reasons, 'UA_ROTATION_BOT') THEN 'UA_ROTATION_BOT'
         ELSE fraud_reasons[1] END AS primary_fraud_reason,
    {detected_at} AS detected_at
  FROM merged
)"""


SCORES = """
components AS (
  SELECT *,
    (CASE primary_fraud_reason
       WHEN 'INHUMAN_VELOCITY_BOT' THEN 0.98 WHEN 'HIGH_VELOCITY_BOT' THEN 0.90
       WHEN 'EXTREME_HIGH_VOLUME' THEN 0.85 WHEN 'AGGRESSIVE_UA_ROTATION' THEN 0.82
       WHEN 'HIGH_VOLUME_SUSPECT' THEN 0.65 WHEN 'UA_ROTATION_BOT' THEN 0.75
       WHEN 'CAMPAIGN_SPAMMER' THEN 0.70 WHEN 'SUSPICIOUS_VELOCITY' THEN 0.55
       WHEN 'VELOCITY_ANOMALY' THEN 0.45 WHEN 'VOLUME_ANOMALY' THEN 0.40
       ELSE 0.35 END)::DOUBLE AS base_risk_score,
    (CASE WHEN fastest_click_ms IS NULL THEN 0.2 WHEN fastest_click_ms < 10 THEN 1.0
          WHEN fastest_click_ms < 50 THEN 0.9 WHEN fastest_click_ms < 100 THEN 0.7
          WHEN fastest_click_ms < 200 THEN 0.5 ELSE 0.3 END)::DOUBLE AS velocity_score,
    (CASE WHEN total_clicks >= 10000 THEN 1.0 WHEN total_clicks >= 5000 THEN 0.85
          WHEN total_clicks >= 1000 THEN 0.70 WHEN total_clicks >= 500 THEN 0.55
          WHEN total_clicks >= 100 THEN 0.40 ELSE 0.25 END)::DOUBLE AS volume_score,
    (CASE WHEN distinct_uas IS NULL THEN 0.1 WHEN distinct_uas >= 20 THEN 1.0
          WHEN distinct_uas >= 10 THEN 0.85 WHEN distinct_uas >= 5 THEN 0.70
          WHEN distinct_uas >= 3 THEN 0.50 ELSE 0.20 END)::DOUBLE AS ua_rotation_score
  FROM suspects
),
weighted AS (
  SELECT *, greatest(0::DOUBLE, least(1::DOUBLE,
      base_risk_score * 0.40::DOUBLE + velocity_score * 0.30::DOUBLE
      + volume_score * 0.20::DOUBLE + ua_rotation_score * 0.10::DOUBLE)) AS risk_score
  FROM components
),
scores AS (
  SELECT ip_address, risk_score,
    CASE WHEN risk_score >= 0.90::DOUBLE THEN 'CRITICAL' WHEN risk_score >= 0.70::DOUBLE THEN 'HIGH'
         WHEN risk_score >= 0.40::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    velocity_score, volume_score, ua_rotation_score,
    risk_score >= 0.70::DOUBLE AS fraud_flag,
    (CASE WHEN fastest_click_ms IS NOT NULL AND distinct_uas IS NOT NULL AND total_clicks >= 1000 THEN 0.95
          WHEN fastest_click_ms IS NOT NULL OR distinct_uas IS NOT NULL THEN 0.75
          ELSE 0.50 END)::DOUBLE AS confidence_level,
    country_code, device_type, total_clicks, distinct_uas, fastest_click_ms, fraud_reasons,
    detection_methods, TRUE AS is_processed, detected_at
  FROM weighted
)"""

SCORE_TEXT = "cast(round(cast(risk_score AS DECIMAL(6,3)), 2) AS DECIMAL(6,2))::VARCHAR"
RISK_TEXT = f"""CASE WHEN risk_score >= 0.90::DOUBLE THEN 'Critical risk (' || {SCORE_TEXT} || ')'
                     WHEN risk_score >= 0.70::DOUBLE THEN 'High risk (' || {SCORE_TEXT} || ')' END"""
EVIDENCE = f"""coalesce(nullif(concat_ws(' | ',
      {RISK_TEXT},
      CASE WHEN len(fraud_reasons) > 0 THEN 'Flags: ' || array_to_string(fraud_reasons[1:3], ', ') END,
      CASE WHEN total_clicks <> 0 THEN format('{{:,}}', total_clicks) || ' clicks' END,
      CASE WHEN fastest_click_ms <> 0 AND fastest_click_ms < 100
           THEN 'Ultra-fast clicks (' || fastest_click_ms || 'ms)' END,
      CASE WHEN country_code <> '' THEN 'Country: ' || country_code END), ''), 'Standard risk profile')"""
ACTION = """CASE WHEN risk_score IS NULL THEN 'ERROR_MISSING_SCORE'
       WHEN risk_score >= 0.90::DOUBLE THEN 'BLOCK_IP_IMMEDIATELY'
       WHEN risk_score >= 0.70::DOUBLE AND coalesce(confidence_level, 0.5) >= 0.80::DOUBLE THEN 'BLOCK_IP_IMMEDIATELY'
       WHEN risk_score >= 0.40::DOUBLE THEN 'SEND_TO_MANUAL_REVIEW'
       ELSE 'MONITOR_PASSIVELY' END"""
STRICT_ACTION = """CASE WHEN risk_score IS NULL THEN 'ERROR_MISSING_SCORE'
       WHEN risk_score > 0.85::DOUBLE AND coalesce(confidence_level, 0.5) > 0.9::DOUBLE THEN 'BLOCK_IP_IMMEDIATELY'
       WHEN risk_score > 0.6::DOUBLE AND coalesce(confidence_level, 0.5) > 0.7::DOUBLE THEN 'SEND_TO_MANUAL_REVIEW'
       ELSE 'MONITOR_PASSIVELY' END"""
PRIORITY = """CASE WHEN final_action = 'BLOCK_IP_IMMEDIATELY' AND risk_score >= 0.95::DOUBLE THEN 'CRITICAL'
       WHEN final_action = 'BLOCK_IP_IMMEDIATELY' THEN 'HIGH'
       WHEN final_action = 'SEND_TO_MANUAL_REVIEW' AND risk_score >= 0.60::DOUBLE THEN 'MEDIUM'
       ELSE 'LOW' END"""


def alerts(created_at: str) -> str:
    return f"""
acted AS (SELECT *, {ACTION} AS final_action, {created_at} AS created_at FROM scores),
alerts AS (
  SELECT 'ALERT-' || ip_address || '-' || strftime(created_at, '%Y%m%d%H%M%S') AS alert_id, ip_address,
    final_action, {PRIORITY} AS priority, risk_score, risk_level,
    'Automated detection via multi-factor analysis' AS fraud_reason, {EVIDENCE} AS evidence_summary,
    'PENDING' AS action_status, NULL::VARCHAR AS actioned_by, NULL::TIMESTAMP AS actioned_at, created_at,
    created_at + CASE final_action WHEN 'BLOCK_IP_IMMEDIATELY' THEN INTERVAL 7 DAY
                                   WHEN 'SEND_TO_MANUAL_REVIEW' THEN INTERVAL 3 DAY
                                   ELSE INTERVAL 1 DAY END AS expires_at,
    confidence_level, country_code, total_clicks, fastest_click_ms
  FROM acted
)"""


# Blocks executed, then whatever has expired is dismissed.
WORKED = f"""
executed AS (
  SELECT * REPLACE (
    CASE WHEN final_action = 'BLOCK_IP_IMMEDIATELY' THEN 'EXECUTED' ELSE action_status END AS action_status,
    CASE WHEN final_action = 'BLOCK_IP_IMMEDIATELY' THEN 'auto' ELSE actioned_by END AS actioned_by,
    CASE WHEN final_action = 'BLOCK_IP_IMMEDIATELY' THEN {AS_OF} ELSE actioned_at END AS actioned_at)
  FROM alerts
),
worked AS (
  SELECT * REPLACE (
    CASE WHEN action_status = 'PENDING' AND expires_at <= {AS_OF} THEN 'DISMISSED' ELSE action_status END AS action_status,
    CASE WHEN action_status = 'PENDING' AND expires_at <= {AS_OF} THEN 'clean-up' ELSE actioned_by END AS actioned_by,
    CASE WHEN action_status = 'PENDING' AND expires_at <= {AS_OF} THEN {AS_OF} ELSE actioned_at END AS actioned_at)
  FROM executed
)"""

TRAFFIC = """
traffic AS (
  SELECT cast(l.doc_id AS VARCHAR) AS ip_address, d.n_chars AS total_clicks, l.toxic = 1 AS is_actually_bot,
         d.source AS user_type, date '2024-01-01' + (l.doc_id % 30)::INT AS evaluation_date,
         (CASE WHEN l.toxic = 1 THEN 0 WHEN d.source = 'Gamer_User' THEN 150 WHEN d.source = 'Heavy_Shopper' THEN 200
               WHEN d.source = 'Family_Shared_IP' THEN 75 WHEN d.source = 'Normal_User' THEN 50
               ELSE 25 END)::DOUBLE AS revenue_impact
  FROM labels l JOIN documents d USING (doc_id)
),
performance AS (
  SELECT *, total_clicks > 2000 AS predicted_as_bot,
    CASE WHEN total_clicks > 2000 AND is_actually_bot THEN 'TRUE_POSITIVE'
         WHEN total_clicks <= 2000 AND NOT is_actually_bot THEN 'TRUE_NEGATIVE'
         WHEN total_clicks > 2000 AND NOT is_actually_bot THEN 'FALSE_POSITIVE'
         WHEN total_clicks <= 2000 AND is_actually_bot THEN 'FALSE_NEGATIVE' END AS evaluation_category,
    CASE WHEN total_clicks > 2000 AND is_actually_bot THEN 'Fraud Prevention - Budget Saved'
         WHEN total_clicks <= 2000 AND NOT is_actually_bot THEN 'Clean Traffic - Valid Impressions'
         WHEN total_clicks > 2000 AND NOT is_actually_bot THEN 'Lost Revenue - Angry Users/Churn'
         WHEN total_clicks <= 2000 AND is_actually_bot THEN 'Fraud Leakage - Wasted Ad Budget' END AS business_impact
  FROM traffic
)"""

CELLS = """count(*) FILTER (evaluation_category = 'TRUE_POSITIVE') AS tp,
         count(*) FILTER (evaluation_category = 'TRUE_NEGATIVE') AS tn,
         count(*) FILTER (evaluation_category = 'FALSE_POSITIVE') AS fp,
         count(*) FILTER (evaluation_category = 'FALSE_NEGATIVE') AS fn,
         coalesce(sum(revenue_impact) FILTER (evaluation_category = 'FALSE_POSITIVE'), 0) AS loss"""


def pct(part: str, whole: str) -> str:
    return f"(({part})::DOUBLE * 100.0::DOUBLE / nullif(({whole})::DOUBLE, 0))"


def r2(value: str) -> str:
    return f"round(cast({value} AS DECIMAL(38,12)), 2)::DOUBLE"


def mean(value: str) -> str:
    return f"(sum(cast({value} AS DECIMAL(15,9)))::DOUBLE / count({value}))"


PRECISION, RECALL = pct("tp", "tp + fp"), pct("tp", "tp + fn")
F1 = f"(2.0::DOUBLE * {PRECISION} * {RECALL} / nullif({PRECISION} + {RECALL}, 0))"
RATES = f"""{r2(PRECISION)} AS precision_percent, {r2(RECALL)} AS recall_percent,
  {r2(pct('tn', 'tn + fp'))} AS specificity_percent, {r2(F1)} AS f1_score,
  {r2(pct('tp + tn', 'tp + tn + fp + fn'))} AS accuracy_percent"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_METRICS = _with(LOGS, RECENT, detectors("ip_address"))
_SUSPECTS = _with(LOGS, RECENT, detectors("ip_address"), suspects("ip_address", AS_OF))
_SCORES = f"{_SUSPECTS}, {SCORES}"
_ALERTS = f"{_SCORES}, {alerts(AS_OF)}"
_DAILY = "ip_address, event_day"
_HISTORY = _with(
    LOGS, BY_DAY, detectors(_DAILY), suspects(_DAILY, "last_seen"), SCORES, alerts("detected_at")
)
_WORKED = f"{_HISTORY}, {WORKED}"
_WINDOWED = "window_end, ip_address"
_STREAM = _with(LOGS, BY_WINDOW, detectors(_WINDOWED))
_TRAFFIC = _with(TRAFFIC)

_LIST = "array_to_string({0}, ',') AS {0}"
_SUSPECT_COLUMNS = f"""ip_address, total_clicks, events_total, distinct_uas, fastest_click_ms, avg_click_interval_ms,
  {_LIST.format('fraud_flags')}, {_LIST.format('fraud_reasons')}, {_LIST.format('detection_methods')},
  country_code, device_type, first_seen, last_seen, primary_fraud_reason, detected_at"""
_SCORE_COLUMNS = f"""* EXCLUDE (fraud_reasons, detection_methods),
  {_LIST.format('fraud_reasons')}, {_LIST.format('detection_methods')}, {AS_OF} AS scored_at"""
_POSITION = """coalesce(lat, 0)::DOUBLE AS lat, coalesce(lon, 0)::DOUBLE AS lon"""
_POSITIONS = """(VALUES ('US', 37.0902, -95.7129), ('CN', 35.8617, 104.1954), ('RU', 61.5240, 105.3188),
  ('BR', -14.2350, -51.9253), ('IN', 20.5937, 78.9629), ('DE', 51.1657, 10.4515), ('GB', 55.3781, -3.4360),
  ('FR', 46.2276, 2.2137)) AS p(country_code, lat, lon)"""


def oracle_sql() -> dict[str, str]:
    rates = f"""{_with(LOGS)}, counted AS (
      SELECT ip_address, count(*) FILTER (event_type = 'click') AS clicks,
             count(*) FILTER (event_type IN ('impression', 'view')) AS impressions,
             count(*) FILTER (event_type IN ('conversion', 'purchase')) AS conversions
      FROM bid_logs GROUP BY ip_address),
    rates AS (
      SELECT *, clicks::DOUBLE / nullif(impressions::DOUBLE, 0) AS ctr,
             conversions::DOUBLE / nullif(clicks::DOUBLE, 0) AS conversion_rate FROM counted)"""
    roc = f"""{_TRAFFIC}, points AS (
      SELECT total_clicks AS score_at_least, count(*) FILTER (is_actually_bot) AS bots,
             count(*) FILTER (NOT is_actually_bot) AS humans
      FROM traffic WHERE is_actually_bot IS NOT NULL GROUP BY total_clicks),
    curve AS (
      SELECT score_at_least, bots, humans,
             (sum(bots) OVER (ORDER BY score_at_least DESC))::BIGINT AS tp,
             (sum(humans) OVER (ORDER BY score_at_least DESC))::BIGINT AS fp,
             (sum(bots) OVER ())::BIGINT AS all_bots, (sum(humans) OVER ())::BIGINT AS all_humans
      FROM points)"""
    sql: dict[str, str] = {}

    # logs
    sql["trailing_window"] = f"""{_with(LOGS, RECENT)}
      SELECT bid_request_id, ts AS "timestamp", ip_address, event_type FROM recent"""
    sql["json_ingest"] = f"""{_with(LOGS)}
      SELECT event_type, count(*) AS events, count(DISTINCT ip_address) AS addresses, min(ts) AS first_event,
             max(ts) AS last_event, sum(time_to_click_ms)::BIGINT AS click_ms
      FROM bid_logs GROUP BY event_type"""
    sql["dated_layout"] = f"""{_with(LOGS)}
      SELECT cast(ts AS DATE) AS event_date, count(*) AS events, count(DISTINCT ip_address) AS addresses,
             min(ts) AS first_event, max(ts) AS last_event
      FROM bid_logs WHERE ts >= {AS_OF} - INTERVAL 24 HOUR GROUP BY ALL"""
    sql["prev_event_time"] = f"""{_METRICS}
      SELECT bid_request_id, ip_address, ts AS "timestamp", prev_ts AS prev_timestamp FROM gaps"""
    sql["inter_click_gap_ms"] = f"""{_METRICS}
      SELECT bid_request_id, ip_address, gap AS time_diff_ms FROM gaps WHERE gap IS NOT NULL"""

    # detectors
    sql["hourly_medians"] = f"""{_with(LOGS)}, gaps AS (
        SELECT ip_address, ts, date_diff('millisecond', lag(ts) OVER (PARTITION BY ip_address ORDER BY ts, bid_request_id), ts) AS gap
        FROM bid_logs)
      SELECT ip_address, count(*) AS total_clicks, min(gap) AS fastest_click_ms,
             count(*) FILTER (gap < 50) AS ultra_fast_clicks, sum(gap)::DOUBLE / count(*) AS avg_click_interval_ms,
             TRUE AS median_in_bound
      FROM gaps WHERE gap IS NOT NULL AND ts >= {AS_OF} - INTERVAL 24 HOUR GROUP BY ip_address"""
    sql["volume_metrics"] = f"{_METRICS} SELECT * FROM volume"
    velocity = "* EXCLUDE (click_interval_stddev), round(click_interval_stddev, 3) AS click_interval_stddev"
    sql["velocity_metrics"] = f"{_METRICS} SELECT {velocity} FROM velocity"
    flags = "array_to_string(fraud_flags, ',') AS fraud_flags"
    sql["high_volume_suspects"] = f"{_METRICS} SELECT * EXCLUDE (fraud_flags), {flags} FROM high_volume"
    sql["high_velocity_suspects"] = f"""{_METRICS}
      SELECT * EXCLUDE (fraud_flags, click_interval_stddev), {flags},
             round(click_interval_stddev, 3) AS click_interval_stddev FROM high_velocity"""
    sql["volume_phase_summary"] = f"""{_METRICS}
      SELECT 'HIGH_VOLUME_FILTER' AS filter_phase, count(*) AS suspect_count,
             sum(total_events)::BIGINT AS total_events, avg(total_events) AS avg_events_per_ip,
             count(DISTINCT fraud_reason) AS fraud_types FROM high_volume"""
    sql["velocity_phase_summary"] = f"""{_METRICS}
      SELECT 'HIGH_VELOCITY_FILTER' AS filter_phase, count(*) AS suspect_count,
             avg(fastest_click_ms) AS avg_fastest_click, min(fastest_click_ms) AS min_fastest_click,
             sum(ultra_fast_clicks)::BIGINT AS total_ultra_fast_clicks FROM high_velocity"""
    sql["suspects_merged"] = f"""{_SUSPECTS}
      SELECT * EXCLUDE (all_fraud_flags, fraud_reasons, detection_methods),
             {_LIST.format('all_fraud_flags')}, {_LIST.format('fraud_reasons')},
             {_LIST.format('detection_methods')} FROM merged"""
    sql["suspect_ips"] = f"{_SUSPECTS} SELECT {_SUSPECT_COLUMNS} FROM suspects"
    sql["suspect_ips_bucketed"] = sql["suspect_ips"]
    sql["suspect_ips_by_load"] = sql["suspect_ips"]
    sql["velocity_metrics_by_load"] = sql["velocity_metrics"]
    sql["filtering_summary"] = f"""{_SUSPECTS}
      SELECT 'FILTERING_COMPLETE' AS status, count(*) AS total_suspects,
             count(DISTINCT primary_fraud_reason) AS fraud_types_detected,
             sum(total_clicks)::BIGINT AS total_suspicious_clicks, avg(total_clicks) AS avg_clicks_per_suspect,
             count(DISTINCT country_code) AS affected_countries, min(detected_at) AS detection_timestamp
      FROM suspects"""
    sql["top_suspects"] = f"""{_SUSPECTS}
      SELECT {_SUSPECT_COLUMNS} FROM suspects ORDER BY total_clicks DESC, ip_address LIMIT 20"""

    # scores
    sql["risk_scores"] = f"{_SCORES} SELECT {_SCORE_COLUMNS} FROM scores"
    sql["risk_level_summary"] = f"""{_SCORES}
      SELECT risk_level, {mean('risk_score')} AS avg_risk_score, count(ip_address) AS ip_count
      FROM scores GROUP BY risk_level"""
    sql["critical_high_counts"] = f"""{_SCORES}
      SELECT count(*) FILTER (risk_level = 'CRITICAL') AS critical_count,
             count(*) FILTER (risk_level = 'HIGH') AS high_count,
             count(*) FILTER (risk_level IN ('CRITICAL', 'HIGH')) AS action_required FROM scores"""
    sql["signal_weight_score"] = f"""{_SUSPECTS}, devices AS (
        SELECT ip_address, count(DISTINCT device_type) AS distinct_devices FROM recent GROUP BY ip_address),
      summed AS (
        SELECT ip_address, {_LIST.format('fraud_reasons')}, country_code, distinct_devices,
          greatest(0::DOUBLE, least(1::DOUBLE,
            (CASE WHEN list_contains(fraud_reasons, 'HIGH_VELOCITY_BOT') THEN 0.40 ELSE 0 END)::DOUBLE
            + (CASE WHEN list_contains(fraud_reasons, 'UA_ROTATION_BOT') THEN 0.30 ELSE 0 END)::DOUBLE
            + (CASE WHEN list_contains(fraud_reasons, 'EXTREME_HIGH_VOLUME') THEN 0.25 ELSE 0 END)::DOUBLE
            + (CASE WHEN list_contains(fraud_reasons, 'HIGH_VOLUME_SUSPECT') THEN 0.20 ELSE 0 END)::DOUBLE
            + (CASE WHEN country_code IN ('CN', 'RU') THEN 0.10 ELSE 0 END)::DOUBLE
            + (CASE WHEN distinct_devices > 1 THEN 0.05 ELSE 0 END)::DOUBLE)) AS signal_score
        FROM suspects LEFT JOIN devices USING (ip_address))
      SELECT *, CASE WHEN signal_score >= 0.90::DOUBLE THEN 'CRITICAL' WHEN signal_score >= 0.70::DOUBLE THEN 'HIGH'
                     WHEN signal_score >= 0.40::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS signal_level FROM summed"""
    sql["ratio_score"] = f"""{_METRICS}, reputation AS (
        SELECT ip_address, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS reputation_risk
        FROM bid_logs GROUP BY ip_address)
      SELECT ip_address, total_clicks, fastest_click_ms, round(greatest(0::DOUBLE, least(1::DOUBLE,
          0.40 * least(1::DOUBLE, 100::DOUBLE / greatest(fastest_click_ms, 1))
          + 0.30 * least(1::DOUBLE, total_clicks / 5000::DOUBLE)
          + 0.20 * (CASE WHEN click_interval_stddev IS NULL THEN 0 ELSE least(1::DOUBLE, 100::DOUBLE / greatest(click_interval_stddev, 1)) END)
          + 0.10 * coalesce(reputation_risk, 0))), 9) AS ratio_score
      FROM velocity LEFT JOIN reputation USING (ip_address)"""

    # alerts
    sql["classify_action"] = f"""{_SCORES}
      SELECT ip_address, risk_score, confidence_level, {ACTION} AS final_action FROM scores"""
    sql["decision_udf"] = sql["decision_sql"] = sql["classify_action"]
    sql["classify_fraud"] = f"""{_SCORES}
      SELECT ip_address, risk_score, confidence_level, {STRICT_ACTION} AS final_action FROM scores"""
    sql["classify_fraud_udf"] = sql["classify_fraud_sql"] = sql["classify_fraud"]
    sql["evidence_summary"] = f"{_SCORES} SELECT ip_address, {EVIDENCE} AS evidence_summary FROM scores"
    sql["simple_evidence"] = f"""{_SCORES}
      SELECT ip_address, concat_ws(' | ', coalesce({RISK_TEXT}, 'Standard risk'), country_code,
                                   total_clicks::VARCHAR) AS evidence_summary FROM scores"""
    sql["actionable_alerts"] = f"{_ALERTS} SELECT * FROM alerts"
    sql["stored_alerts"] = sql["actionable_alerts"]
    sql["action_summary"] = f"""{_ALERTS}
      SELECT final_action, count(ip_address) AS alert_count, {mean('risk_score')} AS avg_risk_score
      FROM alerts GROUP BY final_action"""
    sql["priority_summary"] = f"""{_ALERTS}
      SELECT priority, count(ip_address) AS alert_count FROM alerts GROUP BY priority"""
    sql["action_required"] = f"""{_ALERTS}
      SELECT count(*) FILTER (final_action = 'BLOCK_IP_IMMEDIATELY') AS blocks_required,
             count(*) FILTER (final_action = 'SEND_TO_MANUAL_REVIEW') AS reviews_pending FROM alerts"""
    sql["alert_history"] = f"{_HISTORY} SELECT * FROM alerts"
    sql["bulk_status_update"] = f"""{_WORKED}
      SELECT alert_id, final_action, action_status, actioned_by, actioned_at FROM worked"""
    sql["status_changes"] = f"""{_HISTORY}, changed AS (
        SELECT *, CASE WHEN final_action = 'BLOCK_IP_IMMEDIATELY' THEN 'EXECUTED' WHEN expires_at <= {AS_OF} THEN 'DISMISSED'
                       WHEN priority = 'MEDIUM' THEN 'ESCALATED' ELSE 'PENDING' END AS now_status FROM alerts)
      SELECT alert_id, priority, final_action, now_status AS action_status,
             CASE now_status WHEN 'EXECUTED' THEN 'auto' WHEN 'DISMISSED' THEN 'clean-up' WHEN 'ESCALATED' THEN 'analyst' END AS actioned_by,
             CASE WHEN now_status <> 'PENDING' THEN {AS_OF} END AS actioned_at FROM changed"""
    sql["expired_cleanup"] = f"""{_HISTORY}
      SELECT alert_id, cast(created_at AS DATE) AS event_day, final_action, expires_at FROM alerts WHERE expires_at > {AS_OF}"""
    sql["unexpired_alerts"] = f"{_HISTORY} SELECT alert_id, expires_at FROM alerts WHERE expires_at > {AS_OF}"
    sql["masked_alerts"] = f"""{_HISTORY}
      SELECT sha256(ip_address || 'pepper') AS ip_address,
             regexp_replace(ip_address, '[^.:]+$', 'xxx') AS network, risk_score FROM alerts"""

    # staged filters
    sql["engagement_rates"] = f"{rates} SELECT * FROM rates"
    sql["basic_filter"] = f"""{_METRICS}
      SELECT {velocity} FROM velocity
      WHERE total_clicks > 50 AND fastest_click_ms < 100
        AND cast(last_seen AS DATE) >= cast({AS_OF} - INTERVAL 30 DAY AS DATE)"""
    trusted = "(SELECT '10.2.' || (c_custkey // 256) || '.' || (c_custkey % 256) FROM customer WHERE c_acctbal > 5000)"
    sql["quality_filter"] = f"""{rates}
      SELECT * FROM rates WHERE ctr BETWEEN 0.01 AND 0.5 AND conversion_rate < 0.3 AND ip_address NOT IN {trusted}"""
    sql["quality_filter_wide"] = f"""{rates}
      SELECT * FROM rates WHERE ctr BETWEEN 0.01 AND 1.2 AND conversion_rate < 1.0 AND ip_address NOT IN {trusted}"""
    sql["without_trusted"] = f"{rates} SELECT * FROM rates WHERE ip_address NOT IN {trusted}"
    sql["fraud_filter"] = f"""{_SCORES}, probable AS (
        SELECT s.ip_address, risk_score, velocity_score, v.ultra_fast_clicks::DOUBLE / nullif(v.total_clicks, 0) AS bot_probability
        FROM scores s LEFT JOIN velocity v USING (ip_address))
      SELECT * FROM probable WHERE risk_score > 0.7::DOUBLE OR bot_probability > 0.8 OR velocity_score > 0.9::DOUBLE"""

    # pages
    sql["alert_kpis"] = f"""{_WORKED}
      SELECT count(*) AS total_alerts, count(*) FILTER (priority = 'CRITICAL') AS critical_alerts,
             count(*) FILTER (final_action = 'BLOCK_IP_IMMEDIATELY') AS ips_blocked,
             count(*) FILTER (action_status = 'PENDING') AS pending_review FROM worked"""
    sql["period_delta"] = f"""{_WORKED}, counted AS (
        SELECT count(*) FILTER (created_at >= {AS_OF} - INTERVAL 24 HOUR) AS current_alerts,
               count(*) FILTER (created_at < {AS_OF} - INTERVAL 24 HOUR) AS previous_alerts,
               count(*) FILTER (created_at >= {AS_OF} - INTERVAL 24 HOUR AND priority = 'CRITICAL') AS current_critical,
               count(*) FILTER (created_at < {AS_OF} - INTERVAL 24 HOUR AND priority = 'CRITICAL') AS previous_critical
        FROM worked WHERE created_at >= {AS_OF} - INTERVAL 48 HOUR AND created_at < {AS_OF})
      SELECT *, {r2(pct('current_alerts - previous_alerts', 'previous_alerts'))} AS alerts_change_percent,
             {r2(pct('current_critical - previous_critical', 'previous_critical'))} AS critical_change_percent
      FROM counted"""
    sql["alerts_by_day"] = f"""{_WORKED}
      SELECT cast(created_at AS DATE) AS alert_date, count(*) AS alert_count FROM worked GROUP BY 1"""
    sql["avg_risk_by_day"] = f"""{_WORKED}
      SELECT cast(created_at AS DATE) AS alert_date, {mean('risk_score')} AS avg_risk_score FROM worked GROUP BY 1"""
    sql["alerts_by_hour"] = f"""{_WORKED}
      SELECT hour(created_at)::INT AS hour_of_day, count(*) AS alert_count FROM worked GROUP BY 1"""
    sql["alerts_by_weekday"] = f"""{_WORKED}
      SELECT (isodow(created_at) - 1)::INT AS weekday, dayname(created_at) AS day_of_week, count(*) AS alert_count
      FROM worked GROUP BY ALL"""
    for name, column in (
        ("action_distribution", "final_action"),
        ("risk_level_distribution", "risk_level"),
        ("alerts_by_country", "country_code"),
    ):
        sql[name] = f"{_WORKED} SELECT {column}, count(*) AS alert_count FROM worked GROUP BY 1"
    sql["avg_risk_by_country"] = f"""{_WORKED}
      SELECT country_code, {mean('risk_score')} AS avg_risk_score FROM worked GROUP BY 1"""
    sql["geo_points"] = f"""{_WORKED}
      SELECT alert_id, country_code, risk_level, total_clicks, {_POSITION}
      FROM worked LEFT JOIN {_POSITIONS} USING (country_code)"""
    sql["geo_heatmap"] = f"""{_WORKED}
      SELECT country_code, risk_level, count(*) AS alert_count, sum(total_clicks)::BIGINT AS total_clicks,
             coalesce(any_value(lat), 0)::DOUBLE AS lat, coalesce(any_value(lon), 0)::DOUBLE AS lon
      FROM worked LEFT JOIN {_POSITIONS} USING (country_code) GROUP BY country_code, risk_level"""
    sql["recent_critical_alerts"] = f"""{_WORKED}
      SELECT alert_id, ip_address, risk_score, final_action, country_code, created_at
      FROM worked WHERE priority = 'CRITICAL' ORDER BY created_at DESC, alert_id LIMIT 10"""
    listed = """alert_id, ip_address, priority, risk_score, final_action, action_status, country_code,
      total_clicks, fastest_click_ms, created_at"""
    sql["alert_list"] = f"""{_WORKED}
      SELECT {listed} FROM worked WHERE priority = 'LOW' AND action_status = 'PENDING'"""
    sql["alert_selection"] = f"""{_WORKED}
      SELECT {listed} FROM worked
      WHERE cast(created_at AS DATE) BETWEEN date '2024-01-24' AND date '2024-01-31'
        AND risk_level IN ('CRITICAL', 'HIGH')
        AND final_action IN ('BLOCK_IP_IMMEDIATELY', 'SEND_TO_MANUAL_REVIEW')"""

    # evaluation
    sql["traffic_evaluation"] = f"{_TRAFFIC} SELECT * FROM traffic"
    sql["ground_truth_profile"] = f"""{_TRAFFIC}
      SELECT user_type, count(*) AS ip_count, sum(total_clicks)::BIGINT AS total_clicks,
             sum(is_actually_bot::INT)::BIGINT AS bot_count FROM traffic GROUP BY user_type"""
    sql["model_performance"] = f"{_TRAFFIC} SELECT *, {AS_OF} AS analysis_date FROM performance"
    sql["confusion_summary"] = f"""{_TRAFFIC}
      SELECT evaluation_category, business_impact, count(*) AS ip_count,
             sum(revenue_impact) AS total_revenue_impact,
             {r2(pct('count(*)', '(sum(count(*)) OVER ())'))} AS percentage
      FROM performance GROUP BY evaluation_category, business_impact"""
    sql["classification_metrics"] = f"""{_TRAFFIC}, cells AS (SELECT {CELLS} FROM performance)
      SELECT tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, {RATES},
             fp AS users_incorrectly_blocked, loss::DOUBLE AS estimated_revenue_loss_usd, fn AS bots_missed,
             tp AS bots_correctly_blocked, tn AS humans_correctly_allowed FROM cells"""
    sql["user_type_breakdown"] = f"""{_TRAFFIC}
      SELECT user_type, evaluation_category, business_impact, count(*) AS ip_count,
             sum(revenue_impact) AS revenue_impact, avg(total_clicks) AS avg_clicks
      FROM performance GROUP BY ALL"""
    sql["threshold_sweep"] = f"""{_TRAFFIC}, cells AS (
        SELECT t AS click_threshold,
               count(*) FILTER (total_clicks > t AND is_actually_bot) AS tp,
               count(*) FILTER (total_clicks <= t AND NOT is_actually_bot) AS tn,
               count(*) FILTER (total_clicks > t AND NOT is_actually_bot) AS fp,
               count(*) FILTER (total_clicks <= t AND is_actually_bot) AS fn,
               coalesce(sum(revenue_impact) FILTER (total_clicks > t AND NOT is_actually_bot), 0)::DOUBLE AS loss
        FROM traffic CROSS JOIN (VALUES (500), (1000), (1500), (2000), (3000), (5000)) AS cuts(t) GROUP BY t)
      SELECT click_threshold, tp, tn, fp, fn, {r2(PRECISION)} AS precision, {r2(RECALL)} AS recall,
             {r2(F1)} AS f1_score, fp AS users_blocked_incorrectly, loss AS revenue_loss_usd, fn AS bots_missed,
             {r2(f"({PRECISION} * 0.4::DOUBLE + {RECALL} * 0.4::DOUBLE + (100::DOUBLE - loss / 10) * 0.2::DOUBLE)")}
               AS recommendation_score
      FROM cells"""
    sql["evaluation_report"] = f"""{_TRAFFIC}
      SELECT 'MODEL_EVALUATION_COMPLETE' AS status, count(*) AS total_ips_analyzed,
             count(*) FILTER (evaluation_category = 'TRUE_POSITIVE') AS true_positives,
             count(*) FILTER (evaluation_category = 'FALSE_POSITIVE') AS false_positives,
             count(*) FILTER (evaluation_category = 'FALSE_NEGATIVE') AS false_negatives,
             sum(revenue_impact) FILTER (evaluation_category = 'FALSE_POSITIVE') AS estimated_revenue_loss,
             {AS_OF} AS analysis_timestamp FROM performance"""
    sql["confusion_matrix"] = f"""{_TRAFFIC}
      SELECT CASE WHEN is_actually_bot THEN 'Bot' ELSE 'Human' END AS actual,
             count(*) FILTER (predicted_as_bot) AS predicted_bot,
             count(*) FILTER (NOT predicted_as_bot) AS predicted_human
      FROM performance WHERE is_actually_bot IS NOT NULL GROUP BY 1"""
    sql["net_savings"] = f"""{_TRAFFIC}, sums AS (
        SELECT coalesce(sum(revenue_impact) FILTER (evaluation_category = 'FALSE_POSITIVE'), 0)::DOUBLE AS false_positive_cost,
               count(*) FILTER (evaluation_category = 'TRUE_POSITIVE') AS bots_blocked,
               count(*) FILTER (evaluation_category = 'FALSE_POSITIVE') AS users_blocked,
               coalesce(sum(total_clicks) FILTER (evaluation_category = 'TRUE_POSITIVE'), 0)::DOUBLE AS fraud_prevented
        FROM performance)
      SELECT *, fraud_prevented - false_positive_cost AS net_savings FROM sums"""
    sql["model_drift"] = f"""{_TRAFFIC}, cells AS (
        SELECT evaluation_date, {CELLS} FROM performance GROUP BY evaluation_date)
      SELECT evaluation_date, tp, tn, fp, fn, {RATES} FROM cells"""
    sql["review_queue"] = f"""{_TRAFFIC}
      SELECT ip_address, total_clicks, user_type FROM traffic WHERE total_clicks BETWEEN 1500 AND 2500"""
    sql["roc_curve"] = f"""{roc}
      SELECT score_at_least, tp, fp, tp::DOUBLE / nullif(all_bots, 0) AS tpr,
             fp::DOUBLE / nullif(all_humans, 0) AS fpr FROM curve"""
    sql["roc_auc"] = f"""{roc}
      SELECT max(all_bots) AS bots, max(all_humans) AS humans,
             round(sum(humans * (2 * tp - bots))::DOUBLE / nullif(2.0::DOUBLE * max(all_bots) * max(all_humans), 0), 12) AS auc
      FROM curve"""
    sql["roc_curve_fractional"] = sql["roc_curve"].replace(
        "SELECT score_at_least, tp,", "SELECT score_at_least::DOUBLE / 1440.0::DOUBLE AS score_at_least, tp,"
    )
    sql["roc_auc_fractional"] = sql["roc_auc"]
    columns = (
        "bid_request_id", "timestamp", "ip_address", "user_agent", "time_to_click_ms", "campaign_id", "publisher_id",
        "advertiser_id", "device_type", "country_code", "region", "event_type", "processed_at",
    )
    quality = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count,
            count(*) FILTER ({'ts' if c == 'timestamp' else c} IS NULL) AS null_count FROM bid_logs"""
        for c in columns
    )
    sql["data_quality"] = f"""{_with(LOGS)}, nulls AS ({quality})
      SELECT *, {r2(pct('null_count', 'row_count'))} AS null_percent FROM nulls"""

    # streams, over the windows the watermark has closed
    sql["stream_dedup"] = f"{_with(LOGS)} SELECT DISTINCT bid_request_id FROM bid_logs"
    sql["stream_high_volume"] = f"{_STREAM} SELECT * EXCLUDE (fraud_flags), {flags} FROM high_volume"
    sql["stream_velocity"] = f"""{_STREAM}
      SELECT * EXCLUDE (fraud_flags, median_click_ms, click_interval_stddev, first_seen),
             date_trunc('millisecond', first_seen) AS first_seen, {flags} FROM high_velocity"""
    sql["stream_velocity_keyed"] = sql["stream_velocity"]
    sql["json_stream_ingest"] = f"""{_with(LOGS)}, told AS (
        SELECT *, CASE WHEN time_to_click_ms % 50 = 7 THEN 'rejected, unreadable' WHEN time_to_click_ms % 50 = 11 THEN 'rejected, ip_address'
                       ELSE 'typed ' || event_type END AS outcome FROM bid_logs)
      SELECT outcome, count(*) AS lines, count(DISTINCT ip_address) FILTER (outcome LIKE 'typed%') AS addresses,
             min(ts) FILTER (outcome LIKE 'typed%') AS first_event, max(ts) FILTER (outcome LIKE 'typed%') AS last_event
      FROM told GROUP BY outcome"""
    sql["stream_alerts"] = f"""{_STREAM}, {suspects(_WINDOWED, 'window_end')}, {SCORES}, {alerts('detected_at')}
      SELECT * FROM alerts"""
    return sql
