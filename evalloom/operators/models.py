"""Regressions with item clusters: sums of products in Spark, a few numbers solved on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.sources.shared import stored

NAMES = ("intercept", "treatment", "temp_c", "treatment_temp")


def design(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """rows with x0..x3: one, treatment, centred temp and their product; weight: how many a row stands for."""
    n = F.lit(1) if weight is None else weight
    centre = rows.agg(F.sum(F.col("temp") * n) / F.sum(n)).first()[0] or 0.0
    t, c = (F.col("condition") == "treatment").cast("double"), F.col("temp") - centre
    return rows.withColumns({"x0": F.lit(1.0), "x1": t, "x2": c, "x3": t * c})


def _independent(xx: np.ndarray) -> list[int]:
    """Columns that are no combination of those before them."""
    keep: list[int] = []
    for i in range(len(xx)):
        if np.linalg.matrix_rank(xx[np.ix_([*keep, i], [*keep, i])], tol=1e-9 * max(1.0, xx.max())) == len(keep) + 1:
            keep.append(i)
    return keep


def _products(x: list[Column], y: Column) -> list[Column]:
    k = len(x)
    return [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(k)]


def _table(spark, names, beta, cov) -> DataFrame:
    rows = []
    for n, b, v in zip(names, beta, np.diag(cov)):
        b, se = float(b), math.sqrt(max(float(v), 0.0))
        z = b / se if se > 0 else float("nan")
        rows.append((n, b, se, z, math.erfc(abs(z) / math.sqrt(2)) if se > 0 else float("nan"), b - 1.96 * se, b + 1.96 * se))
    return spark.createDataFrame(rows, "term string, coef double, se double, z double, p double, ci_low double, ci_high double")


def ols_cluster_robust(rows: DataFrame, y: str = "f1", cluster: str = "item_key", least: int = 5) -> DataFrame:
    """y on condition, temp and both, with cluster-robust errors; no rows for fewer than `least`.

    Two passes: sums of products, then scores summed by cluster.
    """
    spark = rows.sparkSession
    d = design(rows.where(F.col(y).isNotNull()))
    x = [F.col(f"x{i}") for i in range(4)]
    s = d.agg(F.count("*").alias("n"), *_products(x, F.col(y))).first()
    if s["n"] < least:
        return _table(spark, [], [], np.zeros((0, 0)))
    xx = np.array([[s[f"a{min(i, j)}_{max(i, j)}"] for j in range(4)] for i in range(4)])
    keep = _independent(xx)
    inv = np.linalg.inv(xx[np.ix_(keep, keep)])
    beta = inv @ np.array([s[f"b{i}"] for i in keep])
    res = F.col(y) - sum((F.lit(float(b)) * x[i] for b, i in zip(beta, keep)), F.lit(0.0))
    u = d.groupBy(cluster).agg(*(F.sum(x[i] * res).alias(f"u{i}") for i in keep))
    k = len(keep)
    m = u.agg(F.count("*").alias("g"), *(F.sum(F.col(f"u{keep[i]}") * F.col(f"u{keep[j]}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))).first()
    meat = np.array([[m[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    g, n = m["g"], s["n"]
    scale = g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else 1.0
    return _table(spark, [NAMES[i] for i in keep], beta, scale * inv @ meat @ inv)


def gee_logistic(rows: DataFrame, y: str = "binary_correct", cluster: str = "item_key", rounds: int = 25, exchangeable: bool = True) -> DataFrame:
    """Logistic regression of y with exchangeable correlation in clusters and robust errors.

    Rows of one cluster and condition and temp are counted first, and clusters with the
    same counts are one pattern with a number, stored once; a round is one aggregation by
    pattern and one sum over patterns.
    """
    spark = rows.sparkSession
    cells = rows.where(F.col(y).isNotNull()).groupBy(cluster, "condition", "temp").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    cells = design(stored(cells, "cells"), F.col("n")).groupBy(cluster, "x0", "x1", "x2", "x3").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # a cluster has few cells: one for each condition and temp
    cell = F.struct("x0", "x1", "x2", "x3", "n", "s")
    patterns = cells.groupBy(cluster).agg(F.sort_array(F.collect_list(cell)).alias("cells")).groupBy("cells").agg(F.count("*").alias("times"))
    patterns = stored(patterns.withColumn("pattern", F.monotonically_increasing_id()), "patterns")
    cells = patterns.select("pattern", "times", F.explode("cells").alias("c")).select("pattern", "times", "c.*")
    x = [F.col(f"x{i}") for i in range(4)]
    times = F.col("times")
    s = cells.agg(F.sum(times * F.col("n")).alias("n"), *(F.sum(times * F.col("n") * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(4) for j in range(i, 4)), F.sum(times * F.col("s")).alias("s")).first()
    if not s["n"] or s["s"] in (0, s["n"]):
        return _table(spark, [], [], np.zeros((0, 0)))
    keep = _independent(np.array([[s[f"a{min(i, j)}_{max(i, j)}"] for j in range(4)] for i in range(4)]))
    k, beta, rho = len(keep), np.zeros(len(keep)), 0.0
    tri = [(i, j) for i in range(k) for j in range(i, k)]
    full = lambda r, p: np.array([[r[f"{p}{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])

    def sums(beta: np.ndarray, rho: float):
        eta = sum((F.lit(float(b)) * x[i] for b, i in zip(beta, keep)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-eta))
        c = cells.withColumn("mu", mu).withColumn("v", F.sqrt(F.col("mu") * (1 - F.col("mu")))).withColumn("r", (F.col("s") - F.col("n") * F.col("mu")) / F.col("v"))
        # squares of residuals: right answers and wrong ones
        rr = F.col("s") * (1 - F.col("mu")) / F.col("mu") + (F.col("n") - F.col("s")) * F.col("mu") / (1 - F.col("mu"))
        per = c.groupBy("pattern").agg(
            F.first("times").alias("times"), F.sum("n").alias("n"), F.sum("r").alias("r"), F.sum(rr).alias("rr"),
            *(F.sum(F.col("n") * F.col("v") * x[keep[i]]).alias(f"d{i}") for i in range(k)),
            *(F.sum(F.col("v") * x[keep[i]] * F.col("r")).alias(f"e{i}") for i in range(k)),
            *(F.sum(F.col("n") * F.col("v") * F.col("v") * x[keep[i]] * x[keep[j]]).alias(f"h{i}_{j}") for i, j in tri),
        )
        # inverse of (1 - rho) I + rho J: a I - b J
        a = F.lit(1 / (1 - rho))
        b = F.lit(rho) / ((1 - rho) * (1 + (F.col("n") - 1) * rho))
        per = per.withColumns({f"g{i}": a * F.col(f"e{i}") - b * F.col(f"d{i}") * F.col("r") for i in range(k)})
        return per.agg(
            F.sum(times * F.col("n")).alias("n"), F.sum(times * F.col("rr")).alias("rr"), F.sum(times * (F.col("r") * F.col("r") - F.col("rr")) / 2).alias("cross"), F.sum(times * F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
            *(F.sum(times * F.col(f"g{i}")).alias(f"g{i}") for i in range(k)),
            *(F.sum(times * (a * F.col(f"h{i}_{j}") - b * F.col(f"d{i}") * F.col(f"d{j}"))).alias(f"H{i}_{j}") for i, j in tri),
            *(F.sum(times * F.col(f"g{i}") * F.col(f"g{j}")).alias(f"M{i}_{j}") for i, j in tri),
        ).first()

    r = None
    for _ in range(rounds):
        r = sums(beta, rho)
        step = np.linalg.solve(full(r, "H"), np.array([r[f"g{i}"] for i in range(k)]))
        beta = beta + step
        if exchangeable and r["pairs"] > k:
            phi = r["rr"] / max(1, r["n"] - k)
            rho = float(np.clip(r["cross"] / phi / (r["pairs"] - k), -0.2, 0.95))
        if np.abs(step).max() < 1e-9:
            break
    r = sums(beta, rho)
    inv = np.linalg.inv(full(r, "H"))
    out = _table(spark, [NAMES[i] for i in keep], beta, inv @ full(r, "M") @ inv)
    return out.withColumns({"odds_ratio": F.exp("coef"), "or_low": F.exp("ci_low"), "or_high": F.exp("ci_high"), "rho": F.lit(rho)})
