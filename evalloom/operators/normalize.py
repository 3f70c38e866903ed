"""Provider result records made into predictions, with variant expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import estimate_tokens, stripped

COLUMNS = ("custom_id", "dataset", "item_id", "condition", "temp", "sample_index", "type", "request_id", "finish_reason", "response_text", "prompt_tokens", "completion_tokens", "total_tokens")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A non-empty string at a path."""
    s = _get(v, path)
    return F.when(s != "", s)


def parse_custom_id(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df (custom_id, ...) with its six parts typed, and the rows whose id is malformed."""
    p = F.split("custom_id", r"\|")
    d = df.withColumns({"_p": p, "_temp": F.try_element_at(p, F.lit(4)).try_cast("double"), "_sample": F.try_element_at(p, F.lit(5)).try_cast("int")})
    ok = F.coalesce((F.size("_p") == 6) & F.col("_temp").isNotNull() & F.col("_sample").isNotNull(), F.lit(False))
    good = d.where(ok).withColumns({"dataset": F.col("_p")[0], "item_id": F.col("_p")[1], "condition": F.col("_p")[2], "temp": F.col("_temp"), "sample_index": F.col("_sample"), "type": F.col("_p")[5]})
    return good.drop("_p", "_temp", "_sample"), d.where(~ok).select(*df.columns)


def records(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as variants v with their custom_id; malformed lines and lines without id are left out."""
    r = lines.withColumn("v", F.try_parse_json(column)).where("v is not null")
    orig = F.coalesce(_text(F.col("v"), "$.request.metadata.orig_custom_id"), _text(F.col("v"), "$.request.metadata['orig-custom-id']"))
    own = F.coalesce(_text(F.col("v"), "$.custom_id"), _text(F.col("v"), "$.customId"))
    return r.withColumn("custom_id", F.when(own.isNotNull(), F.coalesce(orig, own))).where("custom_id is not null")


def rejected(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are no JSON."""
    return lines.where(F.try_parse_json(column).isNull() & (F.trim(column) != ""))


def has_response(v: Column) -> Column:
    """Whether a record is an answer and no error stub."""
    return F.coalesce(_get(v, "$.response", "variant").isNotNull() | (_get(v, "$.result.type") == "succeeded"), F.lit(False))


def combine_parts(parts: DataFrame) -> DataFrame:
    """One record for each custom_id of records (custom_id, v, value, file): one with a response, then the first file."""
    w = Window.partitionBy("custom_id").orderBy(F.desc(has_response(F.col("v"))), "file", F.md5("value"))
    return parts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _body(v: Column) -> Column:
    """response.body, or the response itself."""
    body = _get(v, "$.response.body", "variant")
    return F.when(F.schema_of_variant(body).startswith("OBJECT"), body).otherwise(_get(v, "$.response", "variant"))


def _joined(blocks: Column, take) -> Column:
    return F.array_join(F.transform(F.coalesce(blocks, F.array().cast("array<variant>")), take), "")


def predictions(recs: DataFrame, *more: str) -> DataFrame:
    """The 13 columns of predictions, and failure, error_type, error_message and more, from records (custom_id, v, more) of any of three shapes.

    chat: response[.body].choices[0]; responses: response[.body].output[]; message
    batch: result.message. Tokens are taken under either of their names. Records whose
    id is malformed are left out.
    """
    v, b = F.col("v"), F.col("b")
    d = recs.withColumn("b", _body(v)).withColumn("m", _get(v, "$.result.message", "variant"))
    kind = F.when(_get(v, "$.result.type").isNotNull(), "batch").when(_get(b, "$.output", "array<variant>").isNotNull(), "responses").otherwise("chat")
    d = d.withColumn("kind", kind)
    # chat: with a choice its content counts, even an empty one
    first = _get(b, "$.choices[0]", "variant")
    chat = F.when(first.isNotNull(), F.coalesce(_get(b, "$.choices[0].message.content"), F.lit(""))).otherwise(F.coalesce(_get(b, "$.message.content"), _get(b, "$.content"), F.lit("")))
    # responses: text of messages and of bare text items, in order
    output = _get(b, "$.output", "array<variant>")
    is_text = lambda x: F.coalesce(_get(x, "$.type").isin("output_text", "text"), F.lit(False))
    of_item = lambda x: F.when(_get(x, "$.type") == "message", _joined(F.filter(_get(x, "$.content", "array<variant>"), is_text), lambda c: F.coalesce(_get(c, "$.text"), F.lit("")))).when(is_text(x), F.coalesce(_get(x, "$.text"), F.lit(""))).otherwise("")
    told = stripped(_joined(output, of_item))
    told = F.coalesce(F.when(told != "", told), _text(b, "$.output_text"), _text(b, "$.text"), F.lit(""))
    ends = F.filter(F.transform(output, lambda x: F.when(_get(x, "$.type") == "message", F.coalesce(_text(x, "$.finish_reason"), _text(x, "$.status"))).when(is_text(x), _text(x, "$.finish_reason"))), lambda e: e.isNotNull())
    # message batches: a string, or text blocks and strings
    m = F.col("m")
    blocks = _get(m, "$.content", "array<variant>")
    said = F.when(blocks.isNotNull(), _joined(blocks, lambda x: F.coalesce(F.when(_get(x, "$.type") == "text", _get(x, "$.text")), F.when(F.schema_of_variant(x) == "STRING", x.cast("string")), F.lit("")))).otherwise(F.coalesce(_get(m, "$.content"), F.lit("")))
    failed = F.coalesce(F.lower(_text(v, "$.result.type")), F.lit("errored"))
    success = failed == "succeeded"
    error_type, error_message = _error(v, failed, F.col("kind") == "batch")
    batch, responses = F.col("kind") == "batch", F.col("kind") == "responses"
    tokens = lambda new, old: F.coalesce(*(_get(x, f"$.usage.{n}", "long") for x in (_get(v, "$.response", "variant"), b, m) for n in (old, new)))
    p, c = tokens("input_tokens", "prompt_tokens"), tokens("output_tokens", "completion_tokens")
    summed = F.when(p.isNotNull() | c.isNotNull(), F.coalesce(p, F.lit(0)) + F.coalesce(c, F.lit(0)))
    out = d.select(
        "custom_id", *more,
        F.when(batch, F.coalesce(_text(m, "$.id"), F.when(success, _text(v, "$.id")))).otherwise(F.coalesce(_text(v, "$.response.request_id"), _text(v, "$.response.id"), _text(b, "$.id"))).alias("request_id"),
        F.when(batch, F.when(success, F.coalesce(_text(m, "$.stop_reason"), _text(m, "$.stop_sequence"), F.lit("stop"))))
        .when(responses, F.coalesce(F.try_element_at(ends, F.lit(-1)), _text(b, "$.status"), _text(v, "$.response.status"), F.lit("stop")))
        .otherwise(_get(b, "$.choices[0].finish_reason")).alias("finish_reason"),
        stripped(F.when(batch, F.when(success, said).otherwise("")).when(responses, told).otherwise(chat)).alias("response_text"),
        p.alias("prompt_tokens"), c.alias("completion_tokens"), F.coalesce(tokens("total_tokens", "total_tokens"), summed).alias("total_tokens"),
        F.when(batch, F.when(~success, failed)).otherwise(F.when(_get(v, "$.error", "variant").isNotNull() & (F.schema_of_variant(_get(v, "$.error", "variant")) != "VOID"), "error")).alias("failure"),
        F.when(~batch | ~success, error_type).alias("error_type"), F.when(~batch | ~success, error_message).alias("error_message"),
    )
    good, _ = parse_custom_id(out)
    return good.select(*COLUMNS, "failure", "error_type", "error_message", *more)


#: Fixed value: what a failed message-batch record without an error object says.
NO_MESSAGE = "Anthropic batch request failed."


def _error(v: Column, failed: Column, batch: Column) -> tuple[Column, Column]:
    """Type and message of a failed record's error; of a message batch without one they are made from its status."""
    own = F.coalesce(_get(v, "$.result.error", "variant"), _get(v, "$.error", "variant"))
    none = batch & F.coalesce(F.schema_of_variant(own).isin("VOID", "OBJECT<>"), F.lit(True))
    kind = F.when(none, failed).otherwise(_get(own, "$.type"))
    text = F.when(none, F.coalesce(_text(v, "$.result.error_message"), F.lit(NO_MESSAGE))).when(F.schema_of_variant(own) == "STRING", own.cast("string")).otherwise(_get(own, "$.message"))
    return kind, text


def union_controls(cache: DataFrame, results: DataFrame, prefer: str = "cache") -> DataFrame:
    """Rows of both; of an id in both, those of the preferred side."""
    first, second = (cache, results) if prefer == "cache" else (results, cache)
    return first.unionByName(second.join(first.select("custom_id").distinct(), "custom_id", "left_anti"))


def validate_counts(rows: DataFrame, cache: DataFrame, results: DataFrame) -> DataFrame:
    """Rows written against the different ids expected."""
    ids = cache.select("custom_id", F.lit(1).alias("c"), F.lit(0).alias("r")).union(results.select("custom_id", F.lit(0), F.lit(1)))
    per = ids.groupBy("custom_id").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    want = per.agg(F.count("*").alias("expected"), F.count_if((F.col("c") == 1) & (F.col("r") == 1)).alias("overlap"))
    got = rows.agg(F.count("*").alias("written"))
    return got.crossJoin(want).withColumn("ok", F.col("written") == F.col("expected"))  # one row each


def duplicate_ids(recs: DataFrame) -> DataFrame:
    """Ids that occur more than once, and how often; a null id for records without."""
    return recs.groupBy("custom_id").agg(F.count("*").alias("n")).where("n > 1 or custom_id is null")


def part_outcome(expected: DataFrame, results: DataFrame) -> DataFrame:
    """expected (part, custom_id) and results (part, custom_id, failed): counts and status of each part."""
    e = expected.groupBy("part").agg(F.count("*").alias("items_in"))
    r = results.groupBy("part").agg(F.count("*").alias("items_out"), F.count_if("failed").alias("errors"))
    j = e.join(r, "part", "full_outer").select("part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("items_in", "items_out", "errors")))
    status = F.when(F.col("errors") > 0, "completed_with_errors").when((F.col("items_out") == F.col("items_in")) & (F.col("items_in") > 0), "skipped").otherwise("completed")
    return j.withColumn("status", status)


def estimate_usage(df: DataFrame, prompt: str, answer: str) -> DataFrame:
    """Missing token counts filled by estimates: the answer's is what the total has beyond the prompt."""
    p = F.coalesce("prompt_tokens", estimate_tokens(F.col(prompt)).cast("long"))
    t = F.coalesce("total_tokens", estimate_tokens(F.concat_ws("\n", prompt, answer)).cast("long"))
    return df.select("*", p.alias("prompt_est"), t.alias("total_est")).withColumn("completion_est", F.coalesce("completion_tokens", F.greatest(F.col("total_est") - F.col("prompt_est"), F.lit(0)).cast("long")))


