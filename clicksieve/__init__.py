"""Ad-traffic fraud analytics as Spark jobs.

Raw bid and click logs go in, suspect addresses, risk scores, alerts and
evaluation reports come out. Every operator is a function from DataFrames to a
DataFrame: it builds a lazy plan and runs nothing by itself. The only code that
triggers jobs is in ``clicksieve.plans`` and ``clicksieve.streaming``.
"""
