"""Detection, scoring and action rules as data.

The numbers and names in this module are fixed values: results are only right
when they are exactly these. Every builder takes a rule object, so a user can
pass other values; the defaults are the executable rules, and two documented
alternatives are given under their own names.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: action, priority and status names -----------------------
BLOCK = "BLOCK_IP_IMMEDIATELY"
REVIEW = "SEND_TO_MANUAL_REVIEW"
MONITOR = "MONITOR_PASSIVELY"
MISSING_SCORE = "ERROR_MISSING_SCORE"

PENDING, EXECUTED, ESCALATED, DISMISSED = "PENDING", "EXECUTED", "ESCALATED", "DISMISSED"

ALERT_REASON_TEXT = "Automated detection via multi-factor analysis"


@dataclass(frozen=True)
class DetectionRules:
    """Cut-offs of the two detectors. All comparisons are strict."""

    window_hours: int = 24

    # volume detector
    high_volume_events: int = 1000
    extreme_volume_events: int = 5000
    rotating_uas: int = 5
    aggressive_uas: int = 10
    many_campaigns: int = 50
    many_publishers: int = 20

    # velocity detector
    inhuman_gap_ms: int = 10
    ultra_fast_gap_ms: int = 50
    very_fast_gap_ms: int = 100
    repeated_ultra_fast: int = 100
    sustained_avg_gap_ms: int = 200

    # At most nine different flags exist, so the list limit never bites.
    max_flags: int = 10

    # Reasons that name a suspect before any other, strongest first.
    reason_priority: tuple[str, ...] = (
        "INHUMAN_VELOCITY_BOT",
        "HIGH_VELOCITY_BOT",
        "EXTREME_HIGH_VOLUME",
        "HIGH_VOLUME_SUSPECT",
        "UA_ROTATION_BOT",
    )


@dataclass(frozen=True)
class ScoringRules:
    """Component scores, weights and levels of the risk score.

    A tier list is read from the top; the first bound that holds gives the
    value. ``below`` tiers compare with ``<``, ``at_least`` tiers with ``>=``.
    """

    base_scores: tuple[tuple[str, float], ...] = (
        ("INHUMAN_VELOCITY_BOT", 0.98),
        ("HIGH_VELOCITY_BOT", 0.90),
        ("EXTREME_HIGH_VOLUME", 0.85),
        ("AGGRESSIVE_UA_ROTATION", 0.82),
        ("HIGH_VOLUME_SUSPECT", 0.65),
        ("UA_ROTATION_BOT", 0.75),
        ("CAMPAIGN_SPAMMER", 0.70),
        ("SUSPICIOUS_VELOCITY", 0.55),
        ("VELOCITY_ANOMALY", 0.45),
        ("VOLUME_ANOMALY", 0.40),
    )
    base_otherwise: float = 0.35

    velocity_below: tuple[tuple[int, float], ...] = ((10, 1.0), (50, 0.9), (100, 0.7), (200, 0.5))
    velocity_otherwise: float = 0.3
    velocity_missing: float = 0.2

    volume_at_least: tuple[tuple[int, float], ...] = (
        (10000, 1.0), (5000, 0.85), (1000, 0.70), (500, 0.55), (100, 0.40),
    )
    volume_otherwise: float = 0.25

    ua_at_least: tuple[tuple[int, float], ...] = ((20, 1.0), (10, 0.85), (5, 0.70), (3, 0.50))
    ua_otherwise: float = 0.20
    ua_missing: float = 0.1

    base_weight: float = 0.40
    velocity_weight: float = 0.30
    volume_weight: float = 0.20
    ua_weight: float = 0.10

    level_at_least: tuple[tuple[float, str], ...] = ((0.90, "CRITICAL"), (0.70, "HIGH"), (0.40, "MEDIUM"))
    level_otherwise: str = "LOW"
    fraud_flag_at_least: float = 0.70

    full_confidence: float = 0.95
    partial_confidence: float = 0.75
    low_confidence: float = 0.50
    full_confidence_clicks: int = 1000


@dataclass(frozen=True)
class ActionRules:
    """Which score and confidence lead to which action.

    Tiers are ``(action, score bound, confidence bound or None)``, read from
    the top. ``inclusive`` chooses ``>=`` or ``>``.
    """

    tiers: tuple[tuple[str, float, float | None], ...] = (
        (BLOCK, 0.90, None),
        (BLOCK, 0.70, 0.80),
        (REVIEW, 0.40, None),
    )
    otherwise: str = MONITOR
    inclusive: bool = True
    missing_confidence: float = 0.5

    critical_block_score: float = 0.95
    medium_review_score: float = 0.60

    expiry_days: tuple[tuple[str, int], ...] = ((BLOCK, 7), (REVIEW, 3))
    expiry_days_otherwise: int = 1


@dataclass(frozen=True)
class SignalWeightRules:
    """Documented alternative score, a weight per signal."""

    reason_weights: tuple[tuple[str, float], ...] = (
        ("HIGH_VELOCITY_BOT", 0.40),
        ("UA_ROTATION_BOT", 0.30),
        ("EXTREME_HIGH_VOLUME", 0.25),
        ("HIGH_VOLUME_SUSPECT", 0.20),
    )
    suspicious_country_weight: float = 0.10
    device_anomaly_weight: float = 0.05


@dataclass(frozen=True)
class RatioScoreRules:
    """Documented alternative score built from ratios."""

    velocity_weight: float = 0.40
    volume_weight: float = 0.30
    pattern_weight: float = 0.20
    reputation_weight: float = 0.10
    gap_scale_ms: float = 100.0
    volume_scale: float = 5000.0


@dataclass(frozen=True)
class StagedFilterRules:
    """The documented three-stage filter."""

    min_clicks: int = 50
    fastest_below_ms: int = 100
    recent_days: int = 30
    ctr_between: tuple[float, float] = (0.01, 0.5)
    conversion_below: float = 0.3
    risk_above: float = 0.7
    bot_probability_above: float = 0.8
    velocity_above: float = 0.9


@dataclass(frozen=True)
class EvaluationRules:
    """The click rule under test, its revenue table and texts."""

    block_above_clicks: int = 50
    revenue_by_user_type: tuple[tuple[str, float], ...] = (
        ("Gamer_User", 150.0),
        ("Heavy_Shopper", 200.0),
        ("Family_Shared_IP", 75.0),
        ("Normal_User", 50.0),
    )
    revenue_otherwise: float = 25.0
    impact_texts: tuple[tuple[str, str], ...] = (
        ("TRUE_POSITIVE", "Fraud Prevention - Budget Saved"),
        ("TRUE_NEGATIVE", "Clean Traffic - Valid Impressions"),
        ("FALSE_POSITIVE", "Lost Revenue - Angry Users/Churn"),
        ("FALSE_NEGATIVE", "Fraud Leakage - Wasted Ad Budget"),
    )
    sweep_thresholds: tuple[int, ...] = (30, 40, 50, 60, 70, 80)
    precision_weight: float = 0.4
    recall_weight: float = 0.4
    revenue_weight: float = 0.2
    revenue_scale: float = 10.0
    review_clicks: tuple[int, int] = (40, 60)


DETECTION = DetectionRules()
SCORING = ScoringRules()
ACTIONS = ActionRules()
EVALUATION = EvaluationRules()
STAGED_FILTERS = StagedFilterRules()
SIGNAL_WEIGHTS = SignalWeightRules()
RATIO_SCORES = RatioScoreRules()

# Documented alternative classification: strict bounds, both must hold.
STRICT_ACTIONS = ActionRules(
    tiers=((BLOCK, 0.85, 0.9), (REVIEW, 0.6, 0.7)),
    inclusive=False,
)
