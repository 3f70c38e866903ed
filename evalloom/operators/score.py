"""Scoring of predictions against items, and means over replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions import text as T


def by_item(rows: DataFrame) -> DataFrame:
    """Rows dealt by item_key, once: telling copies apart, means over replicates and pairing all group by it and more, and need no further exchange."""
    return rows.repartition("item_key")


def truth_tokens(truths: Column) -> Column:
    """Each truth's normalised tokens and their bag; one empty truth where there are none."""
    one = lambda t: T.once(T.normal_tokens(t), lambda x: F.struct(x.alias("tokens"), T.bag(x).alias("bag")))
    return F.transform(T.or_blank(truths), one)


def with_inputs(predictions: DataFrame, items: DataFrame, strategy: str) -> tuple[list[str], list[str]]:
    """A support strategy's further inputs: those that come from items, and those that predictions have."""
    wanted = T.support_inputs(strategy)
    own = [c for c in wanted if c in predictions.columns]
    theirs = [c for c in wanted if c not in own]
    if missing := [c for c in theirs if c not in items.columns and c not in T.OF_CONTEXT]:
        raise ValueError(f"strategy {strategy} reads {missing}, which neither predictions nor items have")
    return theirs, own


def score_columns(tokens: Column, truths: Column, unanswerable: Column, is_open: Column, markers: str = "fixed") -> dict[str, Column]:
    """em, f1, abstained and false_answer of an open or closed answer; f1 and false_answer are null for closed ones.

    tokens: normal_tokens of the answer; truths: truth_tokens, so that nothing is normalised again for each pair.
    """
    abstains = T.has_marker(F.array_join(tokens, " "), markers)
    em = T.once(tokens, lambda x: F.exists(truths, lambda t: t["tokens"] == x)).cast("double")
    f1 = T.once(T.bag(tokens), lambda x: F.array_max(F.transform(truths, lambda t: T.f1_of_bags(x, t["bag"]))))
    no = is_open & F.coalesce(unanswerable, F.lit(False))
    return {
        "em": F.when(no, abstains.cast("double")).otherwise(em),
        "f1": F.when(no, abstains.cast("double")).when(is_open, f1),
        "abstained": abstains.cast("double"),
        "false_answer": F.when(no, (~abstains).cast("double")).when(is_open, 0.0),
    }


def unmatched(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions without an item."""
    return predictions.join(items.select("type", "item_key"), ["type", "item_key"], "left_anti")


def prepare_items(items: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """What scoring reads of items, with the truths' tokens and bags: to be stored where items are scored against again and again."""
    further = [c for c in more if c not in ("context", "is_unanswerable")]
    return items.select("type", "item_key", "context", *T.input_columns(further, F.col("context"), items.columns), truth_tokens(F.col("answers")).alias("_truths"), "is_unanswerable")


def score_predictions(predictions: DataFrame, items: DataFrame, strategy: str = "baseline", min_overlap: float = 0.6, threshold: float = 0.5, markers: str = "fixed") -> DataFrame:
    """predictions (type, item_key, condition, temp, sample_index, response_text) with their scores.

    Predictions without an item are left out; unmatched() gives them. strategy: a name that
    text.register_support knows. items: as they are, or from prepare_items.
    """
    theirs, _ = with_inputs(predictions, items, strategy)
    i = items if "_truths" in items.columns else prepare_items(items, tuple(theirs))
    p = predictions.withColumn("_tokens", T.normal_tokens(F.col("response_text"))).join(i, ["type", "item_key"])
    is_open = F.col("type") == "open"
    p = p.withColumns(score_columns(F.col("_tokens"), F.col("_truths"), F.col("is_unanswerable"), is_open, markers))
    bad = T.is_unsupported(F.col("response_text"), F.coalesce("context", F.lit("")), F.col("abstained"), threshold, strategy, min_overlap, p.columns)
    return p.withColumn("unsupported", F.when(is_open, bad)).drop("context", "_tokens", "_truths", "is_unanswerable", *theirs)


def scored_long(predictions: DataFrame, items: DataFrame, markers: str = "fixed") -> DataFrame:
    """Replicate rows for regression: a missing item counts as no answers, scored closed unless the type is open."""
    i = items.select("type", "item_key", truth_tokens(F.col("answers")).alias("_truths"), F.coalesce("is_unanswerable", F.lit(False)).alias("unanswerable"))
    p = predictions.join(i, ["type", "item_key"], "left").withColumn("unanswerable", F.coalesce("unanswerable", F.lit(False)))
    p = p.withColumn("_tokens", T.normal_tokens(F.col("response_text"))).withColumn("_truths", F.coalesce("_truths", truth_tokens(F.array().cast("array<string>"))))
    s = score_columns(F.col("_tokens"), F.col("_truths"), F.col("unanswerable"), F.col("type") == "open", markers)
    out = p.select("item_key", F.split("item_key", r"\|")[0].alias("dataset"), "type", "condition", "temp", "sample_index", "unanswerable", s["em"].alias("em"), s["f1"].alias("f1"), s["abstained"].alias("abstained"))
    return out.withColumn("binary_correct", T.majority(F.col("em")))


def aggregate_replicates(scored: DataFrame) -> DataFrame:
    """Mean and sample deviation over replicates of each item, type, condition and temp."""
    is_open = F.col("type") == "open"
    rename = {"em": "em", "f1": "f1", "abstained": "abstain_rate", "false_answer": "false_answer_rate", "unsupported": "unsupported_rate"}
    means = []
    for c, name in rename.items():
        x = F.col(c) if c in ("em", "abstained") else F.when(is_open, F.col(c))
        means.append(F.avg(x).alias(name))
        sd = F.coalesce(F.stddev_samp(x), F.lit(0.0))
        means.append((sd if c in ("em", "abstained") else F.when(F.col("type") == "open", sd)).alias(f"{name}_std"))
    return scored.groupBy("item_key", "type", "condition", "temp").agg(*means, F.count("*").alias("k"))
