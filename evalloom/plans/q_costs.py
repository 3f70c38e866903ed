"""Queries of usage, prices, comparisons and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions.text import job_state, temp_key
from evalloom.operators import cost, report, telemetry
from evalloom.plans import fixtures as X
from evalloom.plans.base import query
from evalloom.plans.q_stats import t_quantile

P, I = f"WITH {X.PREDS}", f"WITH {X.PER_ITEM}"
M = X.METRICS


def _round(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("q_usage_totals", f"{P} SELECT condition, count(*) AS records, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM preds GROUP BY condition")
def _(spark, sf_dir):
    return cost.usage_totals(X.predictions(spark, sf_dir), "condition")


@query("q_usage_or", f"{P} SELECT count(*) AS records, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, false AS from_usage FROM preds")
def _(spark, sf_dir):
    p = X.predictions(spark, sf_dir)
    return cost.usage_or(p.where("false"), p)


_PRICES = [("A", "src0", 1.25, 5.0, None, None, 0.5), ("A", "SRC1", 2.0, 4.0, 1.5, 7.5, 0.5), ("A", "src1", 3.0, 9.0, None, None, 1.0), ("A", "Src2", 1.0, 1.0, None, None, None), ("a", "src3", 2.0, 2.0, None, None, 0.0)]
_PRICE_TYPE = "provider string, model string, input double, output double, batch_input double, batch_output double, discount double"


def _priced(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("prompt_tokens"), F.count("*").alias("completion_tokens"))
    models = d.select(F.lit("A").alias("provider"), F.col("source").alias("model"), "prompt_tokens", "completion_tokens")
    return cost.resolve_pricing(models, spark.createDataFrame(_PRICES, _PRICE_TYPE), 0.1, 0.2)


_PRICED = f"""WITH d AS (SELECT source, sum(n_chars)::BIGINT AS p, count(*) AS c FROM documents GROUP BY source), r AS (SELECT *,
  CASE source WHEN 'src0' THEN 'batch_discount' WHEN 'src1' THEN 'standard' WHEN 'src2' THEN 'standard' WHEN 'src3' THEN 'standard' ELSE 'default' END AS rate_type,
  CASE source WHEN 'src0' THEN 0.625 WHEN 'src1' THEN 3.0 WHEN 'src2' THEN 1.0 WHEN 'src3' THEN 2.0 ELSE 0.1 END::DOUBLE AS rate_in,
  CASE source WHEN 'src0' THEN 2.5 WHEN 'src1' THEN 9.0 WHEN 'src2' THEN 1.0 WHEN 'src3' THEN 2.0 ELSE 0.2 END::DOUBLE AS rate_out FROM d)"""


@query("q_pricing", f"{_PRICED} SELECT source AS model, rate_type, rate_in, rate_out FROM r")
def _(spark, sf_dir):
    return _priced(spark, sf_dir).select("model", "rate_type", "rate_in", "rate_out")


@query("q_costs", f"{_PRICED} SELECT source AS model, round(p / 1e6 * rate_in + c / 1e6 * rate_out, 6) AS usd FROM r")
def _(spark, sf_dir):
    return cost.cost_summary(_priced(spark, sf_dir)).select("model", "usd")


_BY = "c AS (SELECT printf('%.1f', temp) AS temp_key, condition, (sum(prompt_tokens) / 1e6 * 1.25 + sum(completion_tokens) / 1e6 * 5.0) * 0.5 AS usd FROM preds GROUP BY 1, 2)"


@query("q_cost_by_temp", f"{P}, {_BY} SELECT temp_key, condition, round(usd, 9) AS usd FROM c")
def _(spark, sf_dir):
    return _round(cost.costs_by_temp_condition(X.predictions(spark, sf_dir), 1.25, 5.0, 0.5), "usd")


_RULES = {"all": "coalesce(sum({0}), 0) / count(*)", "zero": "avg(coalesce({0}, 0))", "present": "avg({0})"}
for _policy, _rule in _RULES.items():

    @query(f"q_means_{_policy}", f"{I} SELECT temp, condition, type, {', '.join(f'round({_rule.format(m)}, 9) AS {m}' for m in M)} FROM per_item GROUP BY temp, condition, type")
    def _(spark, sf_dir, policy=_policy):
        return _round(cost.metric_means(X.per_item(spark, sf_dir), policy, "temp", "condition", "type"), *M)


@query("q_cost_eff", f"""{I}, {_BY}, m AS (SELECT printf('%.1f', temp) AS temp_key, condition, sum(em) / count(*) AS em FROM per_item GROUP BY 1, 2), j AS (SELECT * FROM c JOIN m USING (temp_key, condition)),
g AS (SELECT temp_key, max(usd) FILTER (condition = 'treatment') - max(usd) FILTER (condition = 'control') AS usd_diff, max(em) FILTER (condition = 'treatment') - max(em) FILTER (condition = 'control') AS delta FROM j GROUP BY temp_key)
SELECT temp_key, round(usd_diff, 9) AS usd_diff, round(delta, 9) AS delta, round(CASE WHEN delta <> 0 THEN usd_diff / (abs(delta) * 100) END, 8) AS usd_per_point FROM g""")
def _(spark, sf_dir):
    means = cost.metric_means(X.per_item(spark, sf_dir).withColumn("temp_key", temp_key(F.col("temp"))), "all", "temp_key", "condition")
    e = cost.cost_effectiveness(cost.costs_by_temp_condition(X.predictions(spark, sf_dir), 1.25, 5.0, 0.5), means)
    return _round(_round(e, "usd_diff", "delta"), "usd_per_point", digits=8)


_AUDIT = f"""WITH {X.PREDS}, n AS (SELECT dataset AS prompt_set, condition, count(*) AS requests FROM preds GROUP BY 1, 2),
p AS (SELECT prompt_set, condition, CASE WHEN condition = 'control' THEN 4 WHEN prompt_set = 'triviaqa' THEN 0 WHEN prompt_set = 'squad_v2' THEN 20 ELSE 6 END AS tokens, requests FROM n)"""


@query("q_audit", f"{_AUDIT} SELECT prompt_set, condition, tokens, tokens - 4 AS delta_tokens, requests, round(tokens * requests / 1e6 * 2.0 * 0.4, 6) AS usd, CASE WHEN tokens = 0 THEN 'empty' WHEN tokens >= 20 THEN 'long' ELSE 'ok' END AS flag FROM p")
def _(spark, sf_dir):
    r = X.predictions(spark, sf_dir).select(F.col("dataset").alias("prompt_set"), "condition")
    text = F.when(F.col("condition") == "control", "w w w w").when(F.col("prompt_set") == "triviaqa", "").when(F.col("prompt_set") == "squad_v2", "w " * 20).otherwise("w w w w w w")
    return cost.prompt_audit(r.distinct().withColumn("text", text), r, 2.0, 0.4)


def _run(spark, sf_dir, first):
    k = F.split("item_key", r"\|")[1].cast("long") % 5
    return X.per_item(spark, sf_dir).where((k < 2) & (F.col("type") == "open") if first else k >= 2)


_SIDE = "SELECT condition, type, {0} FROM per_item WHERE {1} GROUP BY condition, type"
_K = "split_part(item_key, '|', 2)::BIGINT % 5"


@query("q_compare_runs", f"""{I}, a AS ({_SIDE.format(", ".join(f"avg({m}) AS a_{m}" for m in M), f"{_K} < 2 AND type = 'open'")}), b AS ({_SIDE.format(", ".join(f"avg({m}) AS b_{m}" for m in M), f"{_K} >= 2")})
SELECT condition, type, {", ".join(f"round(coalesce(a_{m}, 0), 9) AS a_{m}, round(coalesce(b_{m}, 0), 9) AS b_{m}, round(coalesce(b_{m}, 0) - coalesce(a_{m}, 0), 9) + 0.0 AS diff_{m}" for m in M)} FROM a FULL JOIN b USING (condition, type)""")
def _(spark, sf_dir):
    c = report.compare_runs(_run(spark, sf_dir, True), _run(spark, sf_dir, False))
    return c.select("condition", "type", *((F.round(n, 9) + 0.0).alias(n) for n in c.columns[2:]))


@query("q_report_ci", f"{I}, v AS (SELECT temp, condition, type, CASE WHEN type = 'open' THEN f1 ELSE em END AS x FROM per_item) SELECT temp, condition, type, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_samp(x) / sqrt(count(x)), 9) AS se FROM v GROUP BY temp, condition, type")
def _(spark, sf_dir):
    return _round(report.report_means_ci(X.per_item(spark, sf_dir)).select("temp", "condition", "type", "n", "mean", "se"), "mean", "se")


_HALF = f"{t_quantile('(count(x) - 1)::DOUBLE')} * stddev_samp(x) / sqrt(count(x))"


@query("q_report_limits", f"{I}, v AS (SELECT temp, condition, type, CASE WHEN type = 'open' THEN f1 ELSE em END AS x FROM per_item) SELECT temp, condition, type, round(avg(x) - {_HALF}, 6) AS ci_low, round(avg(x) + {_HALF}, 6) AS ci_high FROM v GROUP BY temp, condition, type")
def _(spark, sf_dir):
    return _round(report.report_means_ci(X.per_item(spark, sf_dir)).select("temp", "condition", "type", "ci_low", "ci_high"), "ci_low", "ci_high", digits=6)


@query("q_trials_pivot", f"{I}, t AS (SELECT *, {_K} AS trial FROM per_item) SELECT trial, round(avg(em) FILTER (type = 'closed') * 100, 6) AS closed_em, round(avg(em) FILTER (type = 'open') * 100, 6) AS open_em, round(avg(f1) FILTER (type = 'open') * 100, 6) AS open_f1 FROM t GROUP BY trial")
def _(spark, sf_dir):
    return report.aggregate_trials(X.per_item(spark, sf_dir).withColumn("trial", F.split("item_key", r"\|")[1].cast("long") % 5))


_FIN = "CASE WHEN event_type = 'error' THEN 'error' WHEN value > 40 THEN 'length' ELSE 'stop' END"


@query("q_finish_reasons", f"WITH e AS (SELECT user_id % 3 AS part, {_FIN} AS finish_reason FROM events), g AS (SELECT part, finish_reason, count(*) AS n FROM e GROUP BY 1, 2) SELECT part, finish_reason, n, round(n / sum(n) OVER (PARTITION BY part), 9) AS share, finish_reason <> 'stop' AND n / sum(n) OVER (PARTITION BY part) > 0.1 AS alert FROM g")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("part"), F.expr(_FIN).alias("finish_reason"))
    return _round(report.finish_reason_rates(e, "part"), "share")


@query("q_telemetry", """WITH r AS (SELECT event_type AS provider, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT provider, count(*) AS samples, round(avg(value), 3) AS mean_ms, round(max(value), 3) AS max_ms, round(max(value) FILTER (i = round_even(0.95 * (n - 1), 0)), 3) AS p95_ms FROM r GROUP BY provider""")
def _(spark, sf_dir):
    return telemetry.telemetry_summary(X.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("value").alias("latency_ms")), "provider")


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' ELSE 'completed' END"


@query("q_status_counts", f"WITH e AS (SELECT user_id % 10 AS part, {_STATUS} AS s, ts FROM events) SELECT part, " + ", ".join(f"count(*) FILTER (s = '{x}') AS {x}" for x in ("pending", "running", "completed", "failed")) + ", (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM e GROUP BY part")
def _(spark, sf_dir):
    t = F.col("ts").cast("timestamp")
    return telemetry.job_status_counts(X.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("part"), F.expr(_STATUS).alias("status"), t.alias("started"), t.alias("ended")), "part")


@query("q_job_state", "SELECT event_id, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'click' THEN 'COMPLETED' ELSE 'PURCHASE' END AS state FROM events")
def _(spark, sf_dir):
    word = F.expr("CASE event_type WHEN 'error' THEN 'job_state_failed' WHEN 'signup' THEN 'Queued' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'JOB_COMPLETED' ELSE event_type END")
    return X.table(spark, sf_dir, "events").select("event_id", job_state(word).alias("state"))


@query("q_rolling_60s", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def _(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("ts"))
    return telemetry.rolling_request_total(e).select("event_id", "in_window")


@query("q_cache_tokens", "SELECT event_type, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) END)::BIGINT AS cache_read_tokens, sum(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS cache_creation_tokens FROM events GROUP BY event_type")
def _(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    e = X.table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "none").otherwise(k).alias("cache_read_tokens"), k.alias("cache_creation_tokens"))
    return telemetry.cache_token_totals(e, "event_type")
