"""Threshold sweeps and power."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators.pairs import delta_histogram
from evalloom.operators.resample import bootstrap_histogram, bootstrap_keyed
from evalloom.operators.score import with_inputs
from evalloom.sources.shared import stored


def unsupported_sensitivity(predictions: DataFrame, items: DataFrame, thresholds: list[float], strategy: str = "baseline", min_overlap: float = 0.6) -> DataFrame:
    """Paired deltas of the unsupported rate for each threshold: item_key, temp, threshold, delta.

    An answer abstains here if it is empty after normalisation; a missing item has an empty context.
    """
    theirs, _ = with_inputs(predictions, items, strategy)
    p = predictions.where("type = 'open'").join(items.select("type", "item_key", "context", *T.input_columns([c for c in theirs if c != "context"], F.col("context"), items.columns)), ["type", "item_key"], "left")
    gone = (T.normalize_answer(F.col("response_text")) == "").cast("double")
    bad = (~T.is_supported(F.col("response_text"), F.coalesce("context", F.lit("")), strategy, min_overlap, p.columns)).cast("double")
    p = p.select("item_key", "temp", "condition", gone.alias("gone"), bad.alias("bad"))
    p = p.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    flag = F.when(F.col("gone") >= F.col("threshold"), 0.0).otherwise(F.col("bad"))
    side = lambda c: F.avg(F.when(F.col("condition") == c, flag))
    g = p.groupBy("item_key", "temp", "threshold").agg(side("control").alias("c"), side("treatment").alias("t"))
    return g.where("c is not null and t is not null").select("item_key", "temp", "threshold", (F.col("t") - F.col("c")).alias("delta"))


def sensitivity_summary(deltas: DataFrame, replicates: int = 5000, seed: int = 1337, alpha: float = 0.05, keyed: bool = False) -> DataFrame:
    """Pairs, mean delta and its bootstrap interval for each temp and threshold.

    keyed: draws from a hash of seed and item, the same in any engine; else over the histogram.
    """
    keys = ("temp", "threshold")
    if keyed:
        deltas = stored(deltas, "sensitivity")
    h = delta_histogram(deltas, *keys)
    n = F.sum("cnt")
    if keyed:
        mean = h.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col("delta") * F.col("cnt")) / n).alias("mean"))
        return mean.join(bootstrap_keyed(deltas, replicates, seed, alpha, *keys), list(keys))
    return h.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col("delta") * F.col("cnt")) / n).alias("mean")).join(bootstrap_histogram(h, replicates, seed, alpha, *keys), list(keys))


def power_deltas(pairs: DataFrame, unanswerable: DataFrame | None = None) -> DataFrame:
    """Deltas of the false-answer rate on open items, on those in unanswerable (item_key) if it is given and not empty."""
    p = pairs.where("type = 'open'")
    if unanswerable is not None and not unanswerable.isEmpty():
        p = p.join(unanswerable.select("item_key"), "item_key", "left_semi")
    return p.select("item_key", "temp", "type", (F.col("t_false_answer_rate") - F.col("c_false_answer_rate")).alias("delta")).where("delta is not null")


def detectable(deltas: DataFrame, alpha: float = 0.05, power: float = 0.8, *keys: str) -> DataFrame:
    """The smallest detectable effect of each group."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    g = deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd"))
    return g.withColumn("mde", F.when(F.col("n") > 0, F.lit(z) * F.col("sd") / F.sqrt(F.col("n").cast("double"))))


def required_n(groups: DataFrame, targets: list[float], alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """groups (sd, ...) with the number of pairs that each target effect needs; null if it can't be told."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    g = groups.withColumn("target", F.explode(F.array(*(F.lit(float(t)) for t in targets))))
    n: Column = F.lit(z) * F.col("sd") / F.col("target")
    return g.withColumn("n_needed", F.when((F.col("target") > 0) & (F.col("sd") > 0), F.ceil(n * n)))
