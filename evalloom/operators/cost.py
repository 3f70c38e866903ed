"""Usage, prices and cost-effectiveness. A discount always multiplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import estimate_tokens, temp_key

METRICS = ("em", "f1", "abstain_rate", "false_answer_rate", "unsupported_rate")


def usage_totals(predictions: DataFrame, *keys: str) -> DataFrame:
    count = lambda c: F.sum(F.coalesce(F.col(c).try_cast("double").try_cast("long"), F.lit(0)))
    return predictions.groupBy(*keys).agg(F.count("*").alias("records"), count("prompt_tokens").alias("prompt_tokens"), count("completion_tokens").alias("completion_tokens"))


def usage_or(usage: DataFrame, predictions: DataFrame) -> DataFrame:
    """Totals of usage records (prompt_tokens, completion_tokens) if there are any, else of predictions."""
    u = usage_totals(usage).select(F.struct("records", "prompt_tokens", "completion_tokens").alias("u"))
    p = usage_totals(predictions).select(F.struct("records", "prompt_tokens", "completion_tokens").alias("p"))
    some = (F.col("u.records") > 0) | (F.coalesce(F.col("u.prompt_tokens"), F.lit(0)) + F.coalesce(F.col("u.completion_tokens"), F.lit(0)) > 0)
    return u.crossJoin(p).select(F.when(some, F.col("u")).otherwise(F.col("p")).alias("t"), some.alias("from_usage")).select("t.*", "from_usage")  # one row each


def resolve_pricing(models: DataFrame, pricing: DataFrame, default_in: float = 0.0, default_out: float = 0.0) -> DataFrame:
    """models (provider, model, ...) with rates for a million tokens and how they were found.

    pricing (provider, model, input, output, batch_input, batch_output, discount): a row
    of the same name is taken before one that differs in case; batch rates before a
    discount, which counts unless it is null, 0 or 1.
    """
    p = pricing.select(F.lower("provider").alias("_p"), F.lower("model").alias("_m"), F.struct("model", "input", "output", "batch_input", "batch_output", "discount").alias("_r"))
    p = p.groupBy("_p", "_m").agg(F.collect_list("_r").alias("_rows"))  # spellings of one name
    m = models.join(p, (F.lower("provider") == F.col("_p")) & (F.lower("model") == F.col("_m")), "left")
    exact = F.try_element_at(F.filter("_rows", lambda r: r["model"] == F.col("model")), F.lit(1))
    row = F.coalesce(exact, F.try_element_at(F.array_sort("_rows"), F.lit(1)))
    m = m.withColumn("_row", row)
    r = lambda f: F.col(f"_row.{f}")
    batch = r("batch_input").isNotNull() & r("batch_output").isNotNull()
    cut = r("discount").isNotNull() & ~r("discount").isin(0.0, 1.0)
    kind = F.when(F.col("_row").isNull(), "default").when(batch, "batch").when(cut, "batch_discount").otherwise("standard")
    rate = lambda side, default: F.when(kind == "default", default).when(kind == "batch", r(f"batch_{side}")).when(kind == "batch_discount", r(side) * r("discount")).otherwise(r(side))
    return m.select(*models.columns, rate("input", default_in).alias("rate_in"), rate("output", default_out).alias("rate_out"), kind.alias("rate_type"))


def cost_summary(totals: DataFrame) -> DataFrame:
    """totals (prompt_tokens, completion_tokens, rate_in, rate_out, ...) with usd, to 6 places."""
    usd = F.col("prompt_tokens") / 1e6 * F.col("rate_in") + F.col("completion_tokens") / 1e6 * F.col("rate_out")
    return totals.withColumn("usd", F.round(usd, 6))


def costs_by_temp_condition(predictions: DataFrame, rate_in: float, rate_out: float, discount: float = 1.0) -> DataFrame:
    usd = (F.sum(F.coalesce("prompt_tokens", F.lit(0))) / 1e6 * rate_in + F.sum(F.coalesce("completion_tokens", F.lit(0))) / 1e6 * rate_out) * discount
    return predictions.groupBy(temp_key(F.col("temp")).alias("temp_key"), "condition").agg(usd.alias("usd"))


def metric_means(per_item: DataFrame, null_policy: str, *keys: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means under one of three rules: all (sum over all rows), zero (null is 0), present (rows that have a value).

    all and zero differ only in groups without rows of a metric, where both are 0; of a
    column that is missing altogether every rule gives 0.
    """
    rules = {"all": lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / F.count("*"), "zero": lambda c: F.avg(F.coalesce(c, F.lit(0.0))), "present": F.avg}
    if null_policy not in rules:
        raise ValueError(f"unknown null policy {null_policy}")
    have = [rules[null_policy](F.col(m)).alias(m) if m in per_item.columns else F.lit(0.0).alias(m) for m in metrics]
    return per_item.groupBy(*keys).agg(*have) if any(m in per_item.columns for m in metrics) else per_item.select(*keys).distinct().select(*keys, *have)


def cost_effectiveness(costs: DataFrame, means: DataFrame, metric: str = "em") -> DataFrame:
    """costs and means by (temp_key, condition): differences, and usd for one point of the metric."""
    side = lambda c, x: F.max(F.when(F.col("condition") == c, F.col(x)))
    both = costs.join(means.select("temp_key", "condition", metric), ["temp_key", "condition"])
    g = both.groupBy("temp_key").agg((side("treatment", "usd") - side("control", "usd")).alias("usd_diff"), (side("treatment", metric) - side("control", metric)).alias("delta"))
    return g.withColumn("usd_per_point", F.when(F.col("delta") != 0, F.col("usd_diff") / (F.abs("delta") * 100)))


def prompt_audit(prompts: DataFrame, requests: DataFrame, rate_in: float, discount: float = 0.5, reference: bool = False) -> DataFrame:
    """prompts (prompt_set, condition, text) with their tokens, cost over all requests and flags.

    reference: the discount is taken off instead of multiplied.
    """
    n = requests.groupBy("prompt_set", "condition").agg(F.count("*").alias("requests"))
    p = prompts.withColumn("tokens", estimate_tokens(F.col("text"))).join(n, ["prompt_set", "condition"], "left").withColumn("requests", F.coalesce("requests", F.lit(0)))
    factor = 1 - discount if reference else discount
    control = F.max(F.when(F.col("condition") == "control", F.col("tokens"))).over(Window.partitionBy("prompt_set"))
    p = p.withColumn("control_tokens", control)
    flag = F.when(F.col("tokens") == 0, "empty").when((F.col("control_tokens") > 0) & (F.col("tokens") >= 5 * F.col("control_tokens")), "long").otherwise("ok")
    return p.select("prompt_set", "condition", "tokens", (F.col("tokens") - F.col("control_tokens")).alias("delta_tokens"), "requests", F.round(F.col("tokens") * F.col("requests") / 1e6 * rate_in * factor, 6).alias("usd"), flag.alias("flag"))
