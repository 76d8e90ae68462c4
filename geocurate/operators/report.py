"""Recall reports and ablation tables from metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geocurate.functions import names as N

# Runs of the three ablation studies and their axis values.
COMPONENT_RUNS = [("Raw GPS", "raw_gps"), ("Filter Only", "filter_only"), ("SG Only", "sg_only"), ("Full", "full")]
THRESHOLD_RUNS = [("0.2", "tau02"), ("0.3", "full"), ("0.4", "tau04")]
SIZE_RUNS = [("512", "sg512"), ("1024", "full"), ("2048", "sg2048")]


def unique_metrics(results: DataFrame) -> DataFrame:
    """First value of each metric name, in order of ``seq``."""
    return results.groupBy("run", "name").agg(F.min_by("value", "seq").alias("value"))


def recall_rows(results: DataFrame) -> DataFrame:
    """(run, dataset, metric, value) of the recall metrics; others are left out."""
    return (
        unique_metrics(results).filter(N.is_recall_metric(F.col("name")))
        .select(
            "run", N.metric_dataset(F.col("name")).alias("dataset"),
            N.metric_label(F.col("name")).alias("metric"), "value",
        )
    )


def recall_average(metrics: DataFrame) -> DataFrame:
    """Per run and metric: mean over the datasets that report it."""
    return metrics.groupBy("run", "metric").agg(F.avg("value").alias("value"))


def recall_report(results: DataFrame) -> DataFrame:
    """Recall rows of each dataset, followed by the ``average`` rows."""
    rows = recall_rows(results)
    average = recall_average(rows).select("run", F.lit("average").alias("dataset"), "metric", "value")
    return rows.unionByName(average)


def recall_table(report: DataFrame, metrics: list[str]) -> DataFrame:
    """One line per run and dataset, one text column per metric in percent."""
    shown = report.withColumn("text", N.one_decimal(F.col("value") * 100))
    return shown.groupBy("run", "dataset").pivot("metric", metrics).agg(F.first("text")).fillna("-", metrics)


def ablation_table(
    report: DataFrame, axis: list[tuple[str, str]], datasets: list[str], metric: str = "R@1"
) -> DataFrame:
    """One line per axis value: *metric* of each dataset and of the average, in percent."""
    spark = report.sparkSession
    lines = spark.createDataFrame(
        [(i, label, run) for i, (label, run) in enumerate(axis)], "position int, label string, run string"
    )
    wide = (
        report.filter(F.col("metric") == metric)
        .withColumn("value", F.col("value") * 100)
        .groupBy("run").pivot("dataset", [*datasets, "average"]).agg(F.first("value"))
    )
    return F.broadcast(lines).join(wide, "run", "left").drop("run")
