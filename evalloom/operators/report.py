"""Comparisons and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.cost import METRICS, metric_means
from evalloom.operators.infer import mean_intervals


def compare_runs(run1: DataFrame, run2: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Metric means of two runs by condition and type side by side; missing ones are 0."""
    keys = ("condition", "type")
    a = metric_means(run1, "present", *keys, metrics=metrics).select(*keys, *(F.col(m).alias(f"a_{m}") for m in metrics))
    b = metric_means(run2, "present", *keys, metrics=metrics).select(*keys, *(F.col(m).alias(f"b_{m}") for m in metrics))
    j = a.join(b, list(keys), "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select(*keys, *(x for m in metrics for x in (zero(f"a_{m}").alias(f"a_{m}"), zero(f"b_{m}").alias(f"b_{m}"), (zero(f"b_{m}") - zero(f"a_{m}")).alias(f"diff_{m}"))))


def report_means_ci(per_item: DataFrame) -> DataFrame:
    """Mean and t interval of f1 (open) or em (closed) by temp, condition and type."""
    value = F.when(F.col("type") == "open", F.col("f1")).otherwise(F.col("em"))
    return mean_intervals(per_item, value, "temp", "condition", "type")


def aggregate_trials(per_item: DataFrame) -> DataFrame:
    """Exact match and F1 by trial, in percent, a column for each type."""
    g = per_item.groupBy("trial").pivot("type", ["closed", "open"]).agg(F.round(F.avg("em") * 100, 6).alias("em"), F.round(F.avg("f1") * 100, 6).alias("f1"))
    return g.select("trial", "closed_em", "open_em", "open_f1")


def finish_reason_rates(predictions: DataFrame, *keys: str, limit: float = 0.10) -> DataFrame:
    """Share of each finish reason; alert for length and error above the limit."""
    g = predictions.groupBy(*keys, "finish_reason").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return g.withColumn("share", share).withColumn("alert", F.col("finish_reason").isin("length", "error") & (F.col("share") > limit))
