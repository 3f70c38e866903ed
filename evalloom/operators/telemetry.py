"""Latency, job and rate telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.pairs import nearest_rank


def telemetry_summary(samples: DataFrame, *keys: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """samples (keys, latency_ms, ...): count, mean, largest and 95th latency, largest of other columns, to 3 places."""
    x = samples.withColumn("latency_ms", F.col("latency_ms").try_cast("double"))
    g = x.groupBy(*keys).agg(F.count("latency_ms").alias("samples"), F.round(F.avg("latency_ms"), 3).alias("mean_ms"), F.round(F.max("latency_ms"), 3).alias("max_ms"), *(F.round(F.max(F.col(c).try_cast("double")), 3).alias(f"max_{c}") for c in extra))
    p95 = nearest_rank(x, "latency_ms", 0.95, *keys).select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.round("q", 3).alias("p95_ms"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return g.join(p95, same, "left").select(*g.columns, "p95_ms")


def job_status_counts(jobs: DataFrame, *keys: str) -> DataFrame:
    """jobs (keys, status, started, ended): jobs by status and the whole span in seconds."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    span = (F.unix_micros(F.max("ended")) - F.unix_micros(F.min("started"))) / 1e6
    return jobs.groupBy(*keys).agg(*(count(s) for s in ("pending", "running", "completed", "failed")), span.alias("seconds"))


def rolling_request_total(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """requests (id, provider, ts): how many of its provider's were in the open window before and at each.

    Rows are dealt by provider and stretch of time. A stretch also gets the rows of the
    window before it, so no provider's rows have to meet in one task.
    """
    us, span = F.unix_micros("ts"), seconds * 1_000_000
    stretch = span * 10
    r = requests.withColumn("_us", us).withColumn("_own", F.floor(F.col("_us") / stretch))
    ahead = F.floor((F.col("_us") + span - 1) / stretch)
    r = r.withColumn("_s", F.explode(F.array_distinct(F.array("_own", ahead))))
    w = Window.partitionBy("provider", "_s").orderBy("_us").rangeBetween(-(span - 1), 0)
    return r.withColumn("in_window", F.count("*").over(w)).where("_s = _own").drop("_us", "_own", "_s")


def cache_token_totals(records: DataFrame, *keys: str) -> DataFrame:
    total = lambda c: F.sum(F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(0))).alias(c)
    return records.groupBy(*keys).agg(total("cache_read_tokens"), total("cache_creation_tokens"))
