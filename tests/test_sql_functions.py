"""The action rules as SQL functions with a body."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clicksieve.functions import udfs
from clicksieve.operators.alerts import classify_action
from clicksieve.rules import ACTIONS, STRICT_ACTIONS


@pytest.mark.parametrize("name, rules", [(udfs.DECISION_FUNCTION, ACTIONS), (udfs.STRICT_FUNCTION, STRICT_ACTIONS)])
def test_sql_function_equals_the_columns_and_needs_no_python(spark, name, rules):
    udfs.register_in_sql(spark)
    values = [None, float("nan"), float("inf"), float("-inf"), -1.0, 0.0, 0.3999999, 0.4, 0.6, 0.7, 0.70000001, 0.8, 0.85, 0.9, 0.95, 1.0]
    pairs = spark.createDataFrame([(s, c) for s in values for c in values], "score double, confidence double")
    both = pairs.select("score", "confidence", F.expr(f"{name}_sql(score, confidence)").alias("sql"),
                        classify_action(F.col("score"), F.col("confidence"), rules).alias("columns"))
    assert both.where("sql IS DISTINCT FROM columns").count() == 0 and both.select("sql").distinct().count() >= 3
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEval" not in plan and "Python" not in plan
