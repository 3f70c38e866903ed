"""Pairing of conditions and what follows from the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.sources.shared import stored

METRICS = ("em", "f1", "abstain_rate", "false_answer_rate", "unsupported_rate")
OPEN_ONLY = ("f1", "false_answer_rate", "unsupported_rate")
EPS = 1e-12


def balance_check(per_item: DataFrame) -> DataFrame:
    """Rows of each condition, their ratio and how bad it is."""
    count = lambda c: F.count_if(F.col("condition") == c)
    t = per_item.agg(count("control").alias("n_control"), count("treatment").alias("n_treatment"))
    low, high = F.least("n_control", "n_treatment"), F.greatest("n_control", "n_treatment")
    t = t.withColumn("ratio", F.when(low > 0, high / low))
    severity = F.when(low == 0, "error").when(F.col("ratio") > 5, "severe").when(F.col("ratio") > 2, "moderate").otherwise("ok")
    return t.withColumn("severity", severity)


def pair_conditions(per_item: DataFrame) -> DataFrame:
    """item_key, type, temp, dataset and c_/t_ columns of each metric, where both conditions are there.

    One aggregation: of several rows of a condition the smallest in order of its metrics is taken.
    """
    row = F.struct(*(F.col(m) for m in METRICS))
    side = lambda c: F.min(F.when(F.col("condition") == c, row))
    p = per_item.where("item_key is not null and item_key <> ''").groupBy("item_key", "type", "temp").agg(side("control").alias("c"), side("treatment").alias("t"))
    p = p.where("c is not null and t is not null")
    return p.select("item_key", "type", "temp", F.split("item_key", r"\|")[0].alias("dataset"), *(F.col(f"{s}.{m}").alias(f"{s}_{m}") for s in "ct" for m in METRICS))


def pairing_rate(per_item: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs a distinct item, and pairs a row, which is one half at best."""
    n = per_item.agg(F.count("*").alias("n_rows"), F.count_distinct("item_key", "type", "temp").alias("n_items"))
    both = n.crossJoin(pairs.agg(F.count("*").alias("n_pairs")))  # one row each
    return both.select("n_rows", "n_items", "n_pairs", (F.col("n_pairs") / F.col("n_items")).alias("rate"), (F.col("n_pairs") / F.col("n_rows")).alias("rate_rows"))


def paired_deltas(pairs: DataFrame) -> DataFrame:
    """Treatment minus control in long form."""
    each = [F.struct(F.lit(m).alias("metric"), (F.col(f"t_{m}") - F.col(f"c_{m}")).alias("delta"), F.lit(m in OPEN_ONLY).alias("only")) for m in METRICS]
    d = pairs.select("item_key", "type", "temp", "dataset", F.explode(F.array(*each)).alias("d")).select("item_key", "type", "temp", "dataset", "d.*")
    return d.where("delta is not null and (not only or type = 'open')").drop("only")


def mcnemar_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    """b: wrong to right, c: right to wrong, by majority of em."""
    was, now = F.col("c_em") >= 0.5, F.col("t_em") >= 0.5
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~was & now).alias("b"), F.count_if(was & ~now).alias("c"))


def delta_histogram(deltas: DataFrame, *keys: str) -> DataFrame:
    """How often each delta occurs: what the rank and resampling tests need, whatever the number of items."""
    return deltas.groupBy(*keys, "delta").agg(F.count("*").alias("cnt"))


def effect_sizes(deltas: DataFrame, *keys: str) -> DataFrame:
    """Mean, deviation, Cohen's d of pairs and the sign form of Cliff's delta."""
    pos, neg = F.count_if(F.col("delta") > EPS), F.count_if(F.col("delta") < -EPS)
    e = deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), pos.alias("pos"), neg.alias("neg"))
    d = F.when(F.coalesce("sd", F.lit(0.0)) > 0, F.col("mean") / F.col("sd")).otherwise(0.0)
    cliff = F.when(F.col("pos") + F.col("neg") > 0, (F.col("pos") - F.col("neg")) / (F.col("pos") + F.col("neg"))).otherwise(0.0)
    return e.select(*keys, "n", "mean", F.coalesce("sd", F.lit(0.0)).alias("sd"), d.alias("cohens_d"), cliff.alias("cliffs_delta"))


def with_scopes(pairs_or_deltas: DataFrame) -> DataFrame:
    """Each row twice: in the overall scope and in its dataset's."""
    return pairs_or_deltas.withColumn("scope", F.explode(F.array(F.lit("overall"), F.col("dataset"))))


def subgroup_effects(deltas: DataFrame) -> DataFrame:
    """Counts and means by temp and type, and by dataset as well, in one aggregation."""
    pos, neg = F.count_if(F.col("delta") > EPS), F.count_if(F.col("delta") < -EPS)
    g = deltas.groupingSets([["temp", "type", "metric"], ["temp", "type", "metric", "dataset"]], "temp", "type", "metric", "dataset")
    return g.agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), pos.alias("pos"), neg.alias("neg"), F.grouping("dataset").alias("g")).select("temp", "type", "metric", F.when(F.col("g") == 1, "overall").otherwise(F.col("dataset")).alias("scope"), "n", "mean", "pos", "neg")


def nearest_rank(df: DataFrame, value: str, q: float, *keys: str) -> DataFrame:
    """Per key the element at rank round-half-even(q (n - 1)) of the sorted values.

    Equal values are counted first and dealt by ranges of keys and value; counted ranges
    tell which one holds the rank, and only that one is ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    placed = stored(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "values")
    sizes = placed.groupBy(*keys, "_range").agg(F.sum("cnt").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    at = F.bround(F.lit(q) * (F.sum("_n").over(Window.partitionBy(*keys)) - 1)).cast("long")
    sizes = sizes.withColumn("_before", before).withColumn("_at", at).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_n")))
    sizes = sizes.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), (F.col("_at") - F.col("_before")).alias("_rest"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    upto = F.sum("cnt").over(Window.partitionBy(*keys).orderBy(value))
    held = placed.join(sizes, same).withColumn("_upto", upto)
    return held.where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("cnt") <= F.col("_rest"))).select(*keys, F.col(value).alias("q"))
