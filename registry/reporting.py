"""Recall reports and ablation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geocurate.operators import report
from registry import query
from registry import views as W
from registry.readers import FIRST_METRICS_SQL

REPORT = W.ctes(FIRST_METRICS_SQL)


@query(
    "unique_metrics",
    W.ctes(W.METRIC) + "SELECT run, name, arg_min(value, seq) AS value FROM metric GROUP BY 1, 2",
)
def unique_metrics(spark, sf):
    return report.unique_metrics(W.metric_results(spark, sf))


@query("recall_report", REPORT + "SELECT run, dataset, metric, round(value, 9) AS value FROM report")
def recall_report(spark, sf):
    return report.recall_report(W.metric_results(spark, sf)).withColumn("value", F.round("value", 9))


@query(
    "recall_table",
    REPORT
    + """SELECT run, dataset, coalesce(max(t) FILTER (metric = 'R@1'), '-') AS "R@1", coalesce(max(t) FILTER (metric = 'R@5'), '-') AS "R@5",
    coalesce(max(t) FILTER (metric = 'R@10'), '-') AS "R@10" FROM (SELECT *, format('{:.1f}', value * 100) AS t FROM report) GROUP BY 1, 2""",
)
def recall_table(spark, sf):
    return report.recall_table(report.recall_report(W.metric_results(spark, sf)), ["R@1", "R@5", "R@10"])


def _axis_sql(axis) -> str:
    rows = ", ".join(f"({i}, '{label}', '{run}')" for i, (label, run) in enumerate(axis))
    columns = ", ".join(
        f"round(max(value * 100) FILTER (dataset = '{d}'), 6) AS {d}" for d in (*W.DATASETS, "average")
    )
    return REPORT + f"""SELECT CAST(position AS INTEGER) AS position, label, {columns} FROM (VALUES {rows}) AS axis(position, label, run)
    LEFT JOIN report ON report.run = axis.run AND metric = 'R@1' GROUP BY 1, 2"""


def _axis_query(axis):
    def run(spark, sf):
        out = report.ablation_table(report.recall_report(W.metric_results(spark, sf)), axis, list(W.DATASETS))
        for c in (*W.DATASETS, "average"):
            out = out.withColumn(c, F.round(c, 6))
        return out

    return run


for _name, _axis in (
    ("component_table", report.COMPONENT_RUNS),
    ("threshold_table", report.THRESHOLD_RUNS),
    ("supergroup_size_table", report.SIZE_RUNS),
):
    query(_name, _axis_sql(_axis))(_axis_query(_axis))
