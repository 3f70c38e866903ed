"""Queries of provider records: round trips from conversations, so that the SQL needs no JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import normalize as N
from evalloom.plans import fixtures as X
from evalloom.plans.base import query
from evalloom.sources import io
from evalloom.sources.shared import stored


def _turns(spark, sf_dir):
    c = X.table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    return c.select("conv_id", "turn", "text", F.concat_ws("|", F.lit("conv"), F.col("conv_id").cast("string"), F.lit("control"), F.lit("0.0"), F.col("turn").cast("string"), F.lit("closed")).alias("cid"))


def lines(spark, sf_dir):
    """Result lines of three shapes: every 7th conversation failed, every 11th stands in a second file too, every 13th is cut off."""
    t = _turns(spark, sf_dir)
    S, L = F.struct, F.lit
    use = lambda a, b: S(F.col("turn").alias(a), (F.col("turn") + 2).alias(b))
    # answers have white space around them, which parsing cuts off
    t = t.withColumn("text", F.when(F.col("conv_id") % 4 == 1, F.concat(L("\n\t "), "text", L(" \r\n"))).otherwise(F.col("text")))
    chat = F.to_json(S(F.col("cid").alias("custom_id"), S(L("r1").alias("request_id"), S(F.array(S(S(L("assistant").alias("role"), F.col("text").alias("content")).alias("message"), L("stop").alias("finish_reason"))).alias("choices"), use("prompt_tokens", "completion_tokens").alias("usage")).alias("body")).alias("response")))
    half = F.floor(F.length("text") / 2).cast("int")
    block = lambda s: S(L("output_text").alias("type"), s.alias("text"))
    said = F.array(block(F.substring("text", F.lit(1), half)), block(F.substring("text", half + 1, F.length("text"))))
    responses = F.to_json(S(F.col("cid").alias("custom_id"), S(S(L("r2").alias("id"), L("completed").alias("status"), F.array(S(L("reasoning").alias("type"), L(None).cast("array<struct<type:string,text:string>>").alias("content")), S(L("message").alias("type"), said.alias("content"))).alias("output"), use("input_tokens", "output_tokens").alias("usage")).alias("body")).alias("response")))
    text_block = F.array(S(L("text").alias("type"), F.col("text").alias("text")))
    batch = F.to_json(S(L("wrapped").alias("custom_id"), S(S(F.col("cid").alias("orig_custom_id")).alias("metadata")).alias("request"), S(L("succeeded").alias("type"), S(L("r3").alias("id"), text_block.alias("content"), L("end_turn").alias("stop_reason"), use("input_tokens", "output_tokens").alias("usage")).alias("message")).alias("result")))
    reason = F.when(F.col("conv_id") % 2 == 0, S(L("busy").alias("type"), L("overloaded").alias("message")))
    failed = F.to_json(S(F.col("cid").alias("custom_id"), S(L("errored").alias("type"), reason.alias("error")).alias("result")))
    error = F.to_json(S(F.col("cid").alias("customId"), S(L("boom").alias("message")).alias("error")))
    i = F.col("conv_id")
    line = F.when((i % 7 == 0) & (i % 3 == 2), failed).when(i % 7 == 0, error).when(i % 3 == 0, chat).when(i % 3 == 1, responses).otherwise(batch)
    t = t.withColumn("whole", line)
    t = t.withColumn("line", F.when(i % 13 == 0, F.substring("whole", F.lit(1), F.length("whole") - 5)).otherwise(F.col("whole")))
    twice = t.where("conv_id % 11 = 0").select("conv_id", "line", F.lit("b.jsonl").alias("file"))
    return stored(t.select("conv_id", "line", F.lit("a.jsonl").alias("file")).union(twice), "lines")


_T = r"t AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, concat_ws('|', 'conv', conv_id, 'control', '0.0', turn, 'closed') AS cid FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"
_GOOD = f"WITH {_T}, ok AS (SELECT * FROM t WHERE conv_id % 13 <> 0)"


def _records(spark, sf_dir):
    return N.records(lines(spark, sf_dir).withColumnRenamed("line", "value"))


def _predictions(spark, sf_dir):
    return N.predictions(N.combine_parts(_records(spark, sf_dir)))


@query("q_parse_ids", f"WITH {X.PREDS} SELECT custom_id, dataset, item_id, condition, temp, sample_index, type FROM preds")
def _(spark, sf_dir):
    good, _ = N.parse_custom_id(X.predictions(spark, sf_dir).select("custom_id"))
    return good


@query("q_bad_ids", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'a|' || doc_id ELSE 'a|b|c|x|' || doc_id || '|open' END AS custom_id FROM documents WHERE doc_id % 4 <> 3")
def _(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    ids = F.when(F.col("doc_id") % 4 == 3, F.concat(F.lit("a|b|c|0.5|"), i, F.lit("|open"))).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a|"), i)).otherwise(F.concat(F.lit("a|b|c|x|"), i, F.lit("|open")))
    return N.parse_custom_id(X.table(spark, sf_dir, "documents").select(ids.alias("custom_id")))[1]


@query("q_malformed", f"WITH {_T} SELECT file, count(*) AS n FROM (SELECT 'a.jsonl' AS file FROM t WHERE conv_id % 13 = 0 UNION ALL SELECT 'b.jsonl' FROM t WHERE conv_id % 13 = 0 AND conv_id % 11 = 0) GROUP BY file")
def _(spark, sf_dir):
    return N.rejected(lines(spark, sf_dir), "line").groupBy("file").agg(F.count("*").alias("n"))


@query("q_combine_dedupe", f"{_GOOD} SELECT cid AS custom_id, 'a.jsonl' AS file FROM ok")
def _(spark, sf_dir):
    return N.combine_parts(_records(spark, sf_dir)).select("custom_id", "file")


for _name, _kind, _finish, _id in (("q_norm_chat", 0, "stop", "r1"), ("q_norm_responses", 1, "completed", "r2"), ("q_norm_anthropic", 2, "end_turn", "r3")):

    @query(_name, f"{_GOOD} SELECT cid AS custom_id, '{_id}' AS request_id, '{_finish}' AS finish_reason, text AS response_text, turn AS prompt_tokens, turn + 2 AS completion_tokens, 2 * turn + 2 AS total_tokens FROM ok WHERE conv_id % 3 = {_kind} AND conv_id % 7 <> 0")
    def _(spark, sf_dir, kind=_kind):
        p = _predictions(spark, sf_dir).where(f"cast(item_id as long) % 3 = {kind} and failure is null")
        return p.select("custom_id", "request_id", "finish_reason", "response_text", "prompt_tokens", "completion_tokens", "total_tokens")


@query("q_norm_failure", f"{_GOOD} SELECT cid AS custom_id, CASE WHEN conv_id % 3 = 2 THEN 'errored' ELSE 'error' END AS failure, '' AS response_text, CASE WHEN conv_id % 3 = 2 THEN CASE WHEN conv_id % 2 = 0 THEN 'busy' ELSE 'errored' END END AS error_type, CASE WHEN conv_id % 3 <> 2 THEN 'boom' WHEN conv_id % 2 = 0 THEN 'overloaded' ELSE '{N.NO_MESSAGE}' END AS error_message FROM ok WHERE conv_id % 7 = 0")
def _(spark, sf_dir):
    return _predictions(spark, sf_dir).where("failure is not null").select("custom_id", "failure", "response_text", "error_type", "error_message")


@query("q_predictions", f"{_GOOD} SELECT cid AS custom_id, 'conv' AS dataset, conv_id::VARCHAR AS item_id, 'control' AS condition, 0.0::DOUBLE AS temp, turn::INTEGER AS sample_index, 'closed' AS type, CASE WHEN conv_id % 7 = 0 THEN '' ELSE text END AS response_text FROM ok")
def _(spark, sf_dir):
    return _predictions(spark, sf_dir).select("custom_id", "dataset", "item_id", "condition", "temp", "sample_index", "type", "response_text")


def _split(spark, sf_dir):
    p = _predictions(spark, sf_dir).drop("failure", "error_type", "error_message")
    return p.where("cast(item_id as long) % 2 = 0").withColumn("response_text", F.lit("cached")), p.where("cast(item_id as long) % 4 <> 2")


for _name, _prefer in (("q_union_controls", "cache"), ("q_union_results", "results")):

    @query(_name, f"{_GOOD} SELECT cid AS custom_id, CASE WHEN conv_id % 2 = 0 AND ({'true' if _prefer == 'cache' else 'conv_id % 4 = 2'}) THEN 'cached' WHEN conv_id % 7 = 0 THEN '' ELSE text END AS response_text FROM ok")
    def _(spark, sf_dir, prefer=_prefer):
        return N.union_controls(*_split(spark, sf_dir), prefer).select("custom_id", "response_text")


@query("q_validate_counts", f"{_GOOD} SELECT count(*) AS written, count(*) AS expected, count(*) FILTER (conv_id % 4 = 0) AS overlap, true AS ok FROM ok")
def _(spark, sf_dir):
    cache, results = _split(spark, sf_dir)
    return N.validate_counts(N.union_controls(cache, results), cache, results)


@query("q_duplicate_ids", f"{_GOOD} SELECT cid AS custom_id, 2::BIGINT AS n FROM ok WHERE conv_id % 11 = 0")
def _(spark, sf_dir):
    return N.duplicate_ids(_records(spark, sf_dir))


@query("q_part_outcome", f"WITH {_T}, e AS (SELECT conv_id % 5 AS part, count(*) AS items_in FROM t GROUP BY 1), r AS (SELECT conv_id % 5 AS part, count(*) AS items_out, count(*) FILTER (conv_id % 35 = 0) AS errors FROM t WHERE conv_id % 5 <> 3 OR conv_id % 2 = 0 GROUP BY 1) SELECT part, items_in, items_out, errors, CASE WHEN errors > 0 THEN 'completed_with_errors' WHEN items_in = items_out THEN 'skipped' ELSE 'completed' END AS status FROM e JOIN r USING (part)")
def _(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("part", F.col("conv_id") % 5)
    r = t.where("part <> 3 or conv_id % 2 = 0").select("part", F.col("cid").alias("custom_id"), (F.col("conv_id") % 35 == 0).alias("failed"))
    return N.part_outcome(t.select("part", F.col("cid").alias("custom_id")), r)


@query("q_est_usage", f"WITH {_T}, w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda z: z <> '')) AS n FROM t) SELECT cid, CASE WHEN turn = 1 THEN 5 ELSE greatest(1, 1) END::BIGINT AS prompt_est, (n + 1)::BIGINT AS total_est, greatest(n + 1 - CASE WHEN turn = 1 THEN 5 ELSE 1 END, 0)::BIGINT AS completion_est FROM w")
def _(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumns({"prompt": F.lit("ask"), "prompt_tokens": F.when(F.col("turn") == 1, F.lit(5)).cast("long"), "completion_tokens": F.lit(None).cast("long"), "total_tokens": F.lit(None).cast("long")})
    return N.estimate_usage(t, "prompt", "text").select("cid", "prompt_est", "total_est", "completion_est")


@query("q_read_usage", f"WITH {_T}, ok AS (SELECT * FROM t WHERE conv_id % 13 <> 0 AND conv_id % 7 <> 0) SELECT count(*) AS records, sum(turn)::BIGINT AS prompt_tokens, sum(turn + 2)::BIGINT AS completion_tokens FROM ok")
def _(spark, sf_dir):
    from evalloom.operators.cost import usage_totals

    return usage_totals(io.read_usage(lines(spark, sf_dir).where("file = 'a.jsonl'"), "line"))


@query("q_read_scores", "SELECT event_id, 0.5::DOUBLE AS temp, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 0.0 ELSE round(value, 6) END AS em FROM events WHERE event_id % 5 <> 0")
def _(spark, sf_dir):
    i = F.col("event_id")
    raw = X.table(spark, sf_dir, "events").select("event_id", F.when(i % 5 == 0, "t").otherwise("0.5").alias("temp"), F.when(i % 4 == 0, "").when(i % 4 == 1, "NaN").when(i % 4 == 2, "oops").otherwise(F.round("value", 6).cast("string")).alias("em"))
    return io.typed_scores(raw)
