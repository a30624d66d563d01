"""UDF forms of the action rules, for SQL users.

The column form in ``operators.alerts`` is the default and runs in generated
code. These exist because the rule is also offered as a named SQL function; a
test keeps both equal. They work on whole Arrow batches, and on Arrow arrays
rather than pandas series, which could not tell a NaN score from a missing one.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clicksieve.rules import ACTIONS, MISSING_SCORE, STRICT_ACTIONS, ActionRules

DECISION_FUNCTION = "decision_logic_udf"
STRICT_FUNCTION = "classify_fraud_udf"


def action_udf(rules: ActionRules = ACTIONS):
    """An Arrow UDF ``(score double, confidence double) -> string``.

    The inner function refers only to plain values, so executors need nothing
    but pyarrow to run it.
    """
    tiers, otherwise, inclusive = rules.tiers, rules.otherwise, rules.inclusive
    fallback, missing = rules.missing_confidence, MISSING_SCORE

    def decide(score: pa.Array, confidence: pa.Array) -> pa.Array:
        reaches = pc.greater_equal if inclusive else pc.greater
        sure = pc.fill_null(confidence, fallback)
        action = pa.array([otherwise] * len(score), pa.string())
        for name, min_score, min_confidence in reversed(tiers):
            holds = reaches(score, min_score)
            if min_confidence is not None:
                holds = pc.and_(holds, reaches(sure, min_confidence))
            action = pc.if_else(pc.fill_null(holds, False), name, action)
        return pc.if_else(pc.is_null(score), missing, action)

    return F.arrow_udf(decide, "string")


def register(spark: SparkSession) -> None:
    """Make both rules callable from SQL in this session."""
    spark.udf.register(DECISION_FUNCTION, action_udf(ACTIONS))
    spark.udf.register(STRICT_FUNCTION, action_udf(STRICT_ACTIONS))


def sql_body(rules: ActionRules = ACTIONS) -> str:
    """The rule as a SQL expression of ``score`` and ``confidence``, generated from the same tiers."""
    sign = ">=" if rules.inclusive else ">"

    def reaches(value: str, bound: float) -> str:
        # NaN is greater than every number in Spark; here it reaches no bound
        return f"({value} {sign} {bound!r}D AND NOT isnan({value}))"

    sure = f"coalesce(confidence, {rules.missing_confidence!r}D)"
    chain = [f"WHEN score IS NULL THEN '{MISSING_SCORE}'"]
    for action, min_score, min_confidence in rules.tiers:
        holds = [reaches("score", min_score)] + ([] if min_confidence is None else [reaches(sure, min_confidence)])
        chain.append(f"WHEN {' AND '.join(holds)} THEN '{action}'")
    return f"CASE {' '.join(chain)} ELSE '{rules.otherwise}' END"


def register_in_sql(spark: SparkSession) -> None:
    """Both rules as SQL functions with a body, which the optimizer writes into the query: no Python worker."""
    for name, rules in ((f"{DECISION_FUNCTION}_sql", ACTIONS), (f"{STRICT_FUNCTION}_sql", STRICT_ACTIONS)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(score DOUBLE, confidence DOUBLE) RETURNS STRING RETURN {sql_body(rules)}"
        )
