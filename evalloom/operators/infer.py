"""Tests and intervals on paired deltas.

Rows are aggregated to counts, sums or histograms of different deltas first; Python
only finishes a row for each group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions import dist
from evalloom.operators.pairs import EPS, balance_check, delta_histogram, effect_sizes, mcnemar_counts, pair_conditions, paired_deltas, pairing_rate, with_scopes
from evalloom.operators.resample import bootstrap_histogram, permutation_exact
from evalloom.sources.shared import stored


def _udf(f, *columns: Column) -> Column:
    """f on each of the few rows of aggregated columns; null if any is null."""

    @F.udf("double")
    def of(*row):
        return None if any(x is None for x in row) else f(*row)

    return of(*columns)


def binom_two_sided(counts: DataFrame) -> DataFrame:
    """counts (b, c, ...) with p of the exact two-sided test at one half."""
    return counts.withColumn("p", _udf(dist.binom_two_sided, F.col("b"), F.col("c")))


def odds_ratio(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """counts (b, c, ...) with the corrected odds ratio and Clopper-Pearson limits as odds."""
    limit = lambda i: _udf(lambda b, c: dist.odds_ci(b, c, alpha)[i], F.col("b"), F.col("c"))
    return counts.withColumn("odds_ratio", (F.col("b") + 0.5) / (F.col("c") + 0.5)).withColumn("odds_low", limit(0)).withColumn("odds_high", limit(1))


def wilcoxon(histogram: DataFrame, *keys: str, exact_up_to: int = 50) -> DataFrame:
    """Signed ranks from a histogram (keys, delta, cnt): n, w_plus, w_minus, w, z, p.

    Ranks are averages over equal sizes, so they need only a row for each different
    size. p is exact for up to exact_up_to differences without ties, else normal with
    the tie correction; 1 for none or one.
    """
    h = histogram.where(F.abs("delta") > EPS).withColumn("size", F.round(F.abs("delta"), 12))
    by = h.groupBy(*keys, "size").agg(F.sum("cnt").alias("t"), F.sum(F.when(F.col("delta") > 0, F.col("cnt")).otherwise(0)).alias("tp"))
    upto = F.sum("t").over(Window.partitionBy(*keys).orderBy("size"))
    rank = upto - (F.col("t") - 1) / 2.0
    r = by.withColumn("rank", rank)
    g = r.groupBy(*keys).agg(
        F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("tp")).alias("w_plus"), F.sum(F.col("rank") * (F.col("t") - F.col("tp"))).alias("w_minus"),
        F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.max("t").alias("most"),
    )
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    g = g.withColumn("w", F.least("w_plus", "w_minus")).withColumn("z", F.when(sd > 0, (F.col("w") - n * (n + 1) / 4) / sd).otherwise(0.0))

    def p(n, w, z, most):
        if n <= 1:
            return 1.0
        return dist.signed_rank_exact(w, int(n)) if most == 1 and n <= exact_up_to else min(1.0, dist.normal_two_sided(z))

    g = g.withColumn("p", _udf(p, F.col("n"), F.col("w"), F.col("z"), F.col("most")))
    # groups without any difference
    every = histogram.select(*keys).distinct()
    g = every.join(g.drop("ties", "most"), list(keys), "left")
    return g.select(*keys, *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("n", 0), ("w_plus", 0.0), ("w_minus", 0.0), ("w", 0.0), ("z", 0.0), ("p", 1.0))))


def walsh_median(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of (x + y) / 2 over all pairs of items, each with itself too, from different values in order and their counts.

    The pair sum of a given rank is narrowed by halving: how many sums are at most so large
    follows from one binary search for each value, so there is no table of pairs.
    """
    upto = np.concatenate([[0], np.cumsum(counts)])
    n = int(upto[-1])
    pairs = n * (n + 1) // 2
    own = counts.astype(object) if n > 1 << 30 else counts

    def reach(x: float) -> np.ndarray:
        return np.searchsorted(values, x - values, side="right")

    def below(x: float) -> int:
        """Pairs with a sum of at most x: ordered pairs of items, and those of an item with itself once more, halved."""
        return (int((own * upto[reach(x)]).sum()) + int(counts[values + values <= x].sum())) // 2

    def ranked(k: int) -> float:
        low, high = 2 * float(values[0]), 2 * float(values[-1])
        slack = 1e-12 * max(1.0, abs(low), abs(high))
        low -= slack
        high += slack
        while high - low > slack:
            middle = (low + high) / 2
            low, high = (low, middle) if below(middle) >= k else (middle, high)
        at = reach(high + slack) - 1  # the sum itself, as it stands in the data
        sums = (values + values[np.maximum(at, 0)])[at >= 0]
        return float(sums.max())

    return (ranked((pairs + 1) // 2) + ranked(pairs // 2 + 1)) / 4


def hodges_lehmann(deltas: DataFrame, *keys: str, most: int = 2000, counted: bool = False, exact: bool = False) -> DataFrame:
    """Median of the averages of all pairs i <= j.

    By default of groups with more than `most` deltas the plain median; exact: the same
    median at any number, from each group's histogram in one task.
    counted: deltas are a histogram (keys, delta, cnt) already.
    """
    h = deltas if counted else deltas.groupBy(*keys, "delta").agg(F.count("*").alias("cnt"))

    def median(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("delta")
        v, c = p["delta"].to_numpy(dtype=float), p["cnt"].to_numpy(dtype=np.int64)
        if not exact and c.sum() > most:
            at = np.searchsorted(np.cumsum(c), [(c.sum() + 1) // 2, c.sum() // 2 + 1])
            return pd.DataFrame([(*key, float(v[at].mean()))])
        return pd.DataFrame([(*key, walsh_median(v, c))])

    kinds = ", ".join([*(f"{k} {h.schema[k].dataType.simpleString()}" for k in keys), "hl double"])
    return h.groupBy(*keys).applyInPandas(median, kinds)


def selective_risk(pairs: DataFrame, thresholds: list[float], side: str = "t", *keys: str) -> DataFrame:
    """Per threshold, over items that abstain that much at most: coverage, accuracy and risk."""
    marks = sorted({min(1.0, max(0.0, float(t))) for t in thresholds})
    ab, em = F.col(f"{side}_abstain_rate"), F.col(f"{side}_em")
    p = pairs.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in marks))))
    keep = ab <= F.col("threshold")
    g = p.groupBy(*keys, "threshold").agg(F.count_if(keep).alias("kept"), F.sum(F.when(keep, 1 - ab)).alias("answered"), F.sum(F.when(keep, em)).alias("right"))
    ok = (F.col("kept") > 0) & (F.col("answered") > 0)
    accuracy = F.when(ok, F.col("right") / F.col("answered"))
    coverage = F.when(F.col("kept") > 0, F.col("answered") / F.col("kept")).otherwise(0.0)
    return g.select(*keys, "threshold", "kept", coverage.alias("coverage"), accuracy.alias("accuracy"), (1 - accuracy).alias("risk"))


def aurc(risk: DataFrame, *keys: str) -> DataFrame:
    """Area under risk over coverage by trapezoids; null for fewer than two points."""
    w = Window.partitionBy(*keys).orderBy("coverage", "threshold")
    r = risk.where("risk is not null")
    step = (F.col("coverage") - F.lag("coverage").over(w)) * (F.col("risk") + F.lag("risk").over(w)) / 2
    return r.withColumn("area", step).groupBy(*keys).agg(F.when(F.count("*") > 1, F.sum("area")).alias("aurc"))


def meta_analysis(groups: DataFrame, *keys: str) -> DataFrame:
    """Fixed and random effects over groups (keys, n, mean, ci_low, ci_high) with n > 1.

    The variance of a group is from half its interval over 1.96, or .25 / n (at least
    1e-8) where the interval has no width.
    """
    half = (F.col("ci_high") - F.col("ci_low")) / 2 / 1.96
    var = F.when(half > 0, half * half).otherwise(F.greatest(F.lit(1e-8), F.lit(0.25) / F.col("n")))
    g = groups.where("n > 1").withColumn("v", var).withColumn("w", 1 / F.col("v"))
    f = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"), F.sum(F.col("w") * F.col("mean")).alias("swm"), F.sum(F.col("w") * F.col("mean") * F.col("mean")).alias("swmm"))
    fixed, df = F.col("swm") / F.col("sw"), F.greatest(F.lit(1), F.col("k") - 1)
    q = F.greatest(F.lit(0.0), F.col("swmm") - F.col("swm") * F.col("swm") / F.col("sw"))
    f = f.withColumn("fixed", fixed).withColumn("q", q).withColumn("df", df)
    c = F.col("sw") - F.col("sw2") / F.col("sw")
    tau2 = F.when((F.col("k") > 1) & (c > 0), F.greatest(F.lit(0.0), (F.col("q") - (F.col("k") - 1)) / c)).otherwise(0.0)
    f = f.withColumn("tau2", tau2).withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - F.col("df")) / F.col("q"))).otherwise(0.0))
    r = g.join(f.select(*keys, "tau2"), list(keys)).withColumn("u", 1 / (F.col("v") + F.col("tau2")))
    r = r.groupBy(*keys).agg(F.sum("u").alias("su"), F.sum(F.col("u") * F.col("mean")).alias("sum"))
    out = f.join(r, list(keys)).withColumn("random", F.col("sum") / F.col("su")).withColumn("se", F.sqrt(1 / F.col("su")))
    fse = F.sqrt(1 / F.col("sw"))
    return out.select(
        *keys, "k", "fixed", (F.col("fixed") - 1.96 * fse).alias("fixed_low"), (F.col("fixed") + 1.96 * fse).alias("fixed_high"), "q", "df", "i2", "tau2", "random",
        (F.col("random") - 1.96 * F.col("se")).alias("random_low"), (F.col("random") + 1.96 * F.col("se")).alias("random_high"), _udf(dist.chi2_sf, F.col("q"), F.col("df").cast("double")).alias("q_p"),
    )


def fdr_bh(tests: DataFrame, reference: bool = False) -> DataFrame:
    """tests (test, p) with q by Benjamini-Hochberg: the least m p / rank from the rank on upward.

    reference: the least from the smallest p on, as a known faulty form has it. Tests
    are one family of a few rows a group, so one window holds them; NaN and null are left out.
    """
    t = tests.where(F.col("p").isNotNull() & ~F.isnan("p"))
    order = Window.orderBy("p", "test")
    t = t.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy()))
    frame = order.rowsBetween(Window.unboundedPreceding, 0) if reference else order.rowsBetween(0, Window.unboundedFollowing)
    return t.withColumn("q", F.least(F.lit(1.0), F.min(F.col("m") * F.col("p") / F.col("rank")).over(frame)))


def noninferiority(deltas: DataFrame, margin: float, alpha: float = 0.05, *keys: str) -> DataFrame:
    """One-sided t test of mean > -margin, and the 1 - alpha interval of the mean."""
    g = deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.coalesce(F.stddev_samp("delta"), F.lit(0.0)).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    t = F.when(F.col("sd") > 0, (F.col("mean") + margin) / se)
    g = g.withColumn("t", t)

    def p(n, mean, sd, t):
        return (0.0 if mean > -margin else 1.0) if sd == 0 or n < 2 else 1 - dist.t_cdf(t, n - 1)

    g = g.withColumn("p", _udf(p, F.col("n"), F.col("mean"), F.col("sd"), F.coalesce("t", F.lit(0.0))))
    width = _udf(lambda n, sd: 0.0 if n < 2 or sd == 0 else dist.t_ppf(1 - alpha / 2, n - 1) * sd / n**0.5, F.col("n"), F.col("sd"))
    return g.withColumn("half", width).select(*keys, "n", "mean", "sd", "t", "p", (F.col("mean") - F.col("half")).alias("ci_low"), (F.col("mean") + F.col("half")).alias("ci_high"), (F.col("p") < alpha).alias("noninferior"))


def mean_intervals(rows: DataFrame, value: Column, *keys: str, alpha: float = 0.05) -> DataFrame:
    """Mean and t interval of a value per group; null limits for one row."""
    g = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("se"))
    half = _udf(lambda n, se: dist.t_ppf(1 - alpha / 2, n - 1) * se if n > 1 else None, F.col("n"), F.col("se"))
    return g.withColumn("half", half).select(*keys, "n", "mean", "se", (F.col("mean") - F.col("half")).alias("ci_low"), (F.col("mean") + F.col("half")).alias("ci_high"))


def dataset_meta(intervals: DataFrame) -> DataFrame:
    """meta_analysis over the datasets' rows of intervals (temp, type, scope, metric, n, mean, ci_low, ci_high): em always, f1 of open items."""
    g = intervals.where("scope <> 'overall' and (metric = 'em' or (metric = 'f1' and type = 'open'))")
    return meta_analysis(g, "temp", "type", "metric").withColumn("scope", F.lit("overall"))


def risk_report(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """Selective risk of both sides by temp, type and scope: the points, and the area under them on each."""
    p, keys = with_scopes(pairs), ("temp", "type", "scope")
    sides = [selective_risk(p, thresholds, s, *keys).withColumn("condition", F.lit(n)) for s, n in (("c", "control"), ("t", "treatment"))]
    points = sides[0].unionByName(sides[1])
    area = aurc(points, *keys, "condition")
    points = points.groupBy(*keys, "condition").agg(F.sort_array(F.collect_list(F.struct("threshold", "coverage", "accuracy", "risk"))).alias("points"))  # a few thresholds
    return points.join(area, [*keys, "condition"], "left")


def significance(pairs: DataFrame, replicates: int = 5000, seed: int = 1337, margin: float = 0.01, alpha: float = 0.05, thresholds: tuple[float, ...] = (0.0, 0.5, 1.0), reference: bool = False) -> DataFrame:
    """One row for each temp, type, scope (overall or a dataset) and metric with all tests.

    Effects, rank test, Hodges-Lehmann, bootstrap interval and permutation p of every
    metric; McNemar with odds ratio, selective risk and its area on em; on the overall
    scope meta-analysis with heterogeneity over the datasets and non-inferiority with
    its t interval of em and f1; q over the family of McNemar and rank tests (reference:
    see fdr_bh). Pairs and their histogram are stored once, and every test reads them.
    """
    keys = ("temp", "type", "scope", "metric")
    pairs = stored(pairs, "pairs")
    deltas = with_scopes(paired_deltas(pairs)).where("type = 'open' or metric in ('em', 'abstain_rate')")
    h = stored(delta_histogram(deltas, *keys), "histogram")
    n = F.sum("cnt")
    mean = h.groupBy(*keys).agg((F.sum(F.col("delta") * F.col("cnt")) / n).alias("mean"), n.alias("n"))
    boot = stored(bootstrap_histogram(h, replicates, seed, alpha, *keys), "bootstrap")
    hl = hodges_lehmann(h, *keys, counted=True)
    effects = effect_sizes(deltas, *keys)
    wide = [effects, wilcoxon(h, *keys).withColumnsRenamed({"n": "n_nonzero", "p": "p_wilcoxon"}), hl, boot, permutation_exact(h, replicates, seed, *keys).withColumnRenamed("exact", "permutation_exact")]
    out = reduce(lambda a, b: a.join(b, list(keys), "left"), wide)
    mc = odds_ratio(binom_two_sided(mcnemar_counts(with_scopes(pairs), "temp", "type", "scope"))).withColumnsRenamed({"p": "p_mcnemar", "n": "n_pairs"}).withColumn("metric", F.lit("em"))
    meta = dataset_meta(mean.join(boot, list(keys))).withColumnsRenamed({"k": "meta_k"})
    tost = noninferiority(deltas.where("scope = 'overall' and (metric = 'em' or (metric = 'f1' and type = 'open'))"), margin, alpha, *keys)
    tost = tost.select(*keys, F.col("p").alias("p_noninferior"), "noninferior", F.col("ci_low").alias("t_low"), F.col("ci_high").alias("t_high"))
    risk = risk_report(pairs, list(thresholds)).groupBy("temp", "type", "scope").pivot("condition", ["control", "treatment"]).agg(F.first("points").alias("risk"), F.first("aurc").alias("aurc")).withColumn("metric", F.lit("em"))
    for part in (mc, meta, tost, risk):
        out = out.join(part, list(keys), "left")
    out = stored(out, "significance")
    name = F.concat_ws("|", F.col("temp").cast("string"), "type", "scope", "metric")
    family = out.select(F.concat(F.lit("w|"), name).alias("test"), F.col("p_wilcoxon").alias("p")).union(out.where("p_mcnemar is not null").select(F.concat(F.lit("m|"), name), "p_mcnemar"))
    q = fdr_bh(family, reference).select("test", "q")
    for prefix, column in (("w|", "q_wilcoxon"), ("m|", "q_mcnemar")):
        out = out.join(q.select(F.col("test").alias("t"), F.col("q").alias(column)), F.concat(F.lit(prefix), name) == F.col("t"), "left").drop("t")
    return out


def significance_report(per_item: DataFrame, **options) -> DataFrame:
    """significance of the pairs of per_item, and on each row how the rows were balanced and paired.

    n_control, n_treatment, ratio and severity (balance_check), n_rows, n_items, n_pairs_all,
    pairing_rate (pairs an item), pairing_rate_rows and low_pairing: fewer than half as many pairs as the rows could make.
    """
    per_item = stored(per_item, "peritem", by="item_key")
    pairs = pair_conditions(per_item)
    paired = pairing_rate(per_item, pairs).withColumnsRenamed({"n_pairs": "n_pairs_all", "rate": "pairing_rate", "rate_rows": "pairing_rate_rows"})
    design = F.broadcast(balance_check(per_item).crossJoin(F.broadcast(paired)))  # one row
    return significance(pairs, **options).crossJoin(design).withColumn("low_pairing", F.col("pairing_rate_rows") < 0.25)
