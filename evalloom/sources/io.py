"""Readers and writers of items, requests, results and scores."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators.normalize import COLUMNS, records
from evalloom.sources.shared import stored

ITEM = "dataset string, id string, context string, question string, answers array<string>, is_unanswerable boolean"
REQUEST = "custom_id string, body struct<messages: array<struct<role: string, content: variant>>, stop: array<string>>"
PREDICTION = "custom_id string, dataset string, item_id string, condition string, temp double, sample_index int, type string, request_id string, finish_reason string, response_text string, prompt_tokens long, completion_tokens long, total_tokens long"
METRICS = ("em", "f1", "abstain_rate", "false_answer_rate", "unsupported_rate")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of items; a malformed line fails the read, blank ones are skipped."""
    d = spark.read.schema(ITEM).option("mode", "FAILFAST").json(path)
    return d.withColumn("item_key", F.concat_ws("|", "dataset", "id"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of requests; malformed lines are left out."""
    return spark.read.schema(REQUEST).option("mode", "DROPMALFORMED").json(path).where("custom_id is not null")


def split_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same requests, and what is left out: value and file of lines that are no JSON object with a custom_id."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    d = lines.withColumn("v", F.try_parse_json("value")).withColumn("id", F.try_variant_get("v", "$.custom_id", "string"))
    good = d.where("id is not null").select(F.from_json("value", REQUEST).alias("r")).select("r.*")
    return good, d.where("id is null").select("value", "file")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """A scores table with its header's columns: rows without a temp go; of a metric '' and nan are null, other words 0."""
    raw = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return typed_scores(raw)


def typed_scores(raw: DataFrame) -> DataFrame:
    def metric(c: str) -> Column:
        x = F.col(c)
        return F.when(x.isNull() | F.lower(F.trim(x)).isin("", "nan"), None).otherwise(F.coalesce(x.try_cast("double"), F.lit(0.0)))

    names = [c for c in raw.columns if c in METRICS or c.endswith("_std")]
    return raw.withColumns({"temp": F.col("temp").try_cast("double"), **{c: metric(c) for c in names}}).where("temp is not null")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All result parts below a folder: value, file and the records v with custom_id."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path)
    return records(d.select("value", F.col("_metadata.file_path").alias("file")))


def write_shards(rows: DataFrame, path: str, shard: str = "shard", pos: str = "pos", line: str = "line") -> None:
    """A folder for each shard, its lines in order of pos."""
    out = rows.select(shard, pos, line).repartition(shard).sortWithinPartitions(shard, pos)
    out.select(shard, line).write.mode("overwrite").partitionBy(shard).text(path)


def write_predictions(predictions: DataFrame, path: str, form: str = "parquet") -> None:
    out = predictions.select(*COLUMNS).write.mode("overwrite")
    out.options(header=True, quote='"', escape='"').csv(path) if form == "csv" else out.parquet(path)


def write_results(table: DataFrame, path: str, form: str = "parquet") -> None:
    """A tidy table, or a JSON document for each row."""
    if form == "json":
        table.select(F.to_json(F.struct(*table.columns)).alias("value")).write.mode("overwrite").text(path)
    else:
        table.write.mode("overwrite").parquet(path)


#: Any of these makes an object a usage object: prompt names first, then completion names.
PROMPT_KEYS, COMPLETION_KEYS = ("prompt_tokens", "input_tokens"), ("completion_tokens", "output_tokens")


@F.udtf(returnType="prompt_tokens: long, completion_tokens: long")
class UsageIn:
    """A row for each usage object of a JSON text of any shape; objects inside of one don't count again."""

    def eval(self, text: str):
        import json

        def whole(usage: dict, names: tuple[str, ...]) -> int:
            try:
                return int(float(next(usage[n] for n in names if n in usage)))
            except (StopIteration, TypeError, ValueError, OverflowError):
                return 0

        try:
            todo = [json.loads(text or "null")]
        except ValueError:
            return
        while todo:
            x = todo.pop()
            if isinstance(x, dict) and x.keys().isdisjoint(PROMPT_KEYS + COMPLETION_KEYS):
                todo += x.values()
            elif isinstance(x, dict):
                yield whole(x, PROMPT_KEYS), whole(x, COMPLETION_KEYS)
            elif isinstance(x, list):
                todo += x


def read_usage(texts: DataFrame, column: str = "value") -> DataFrame:
    """(prompt_tokens, completion_tokens) of all usage objects in JSON texts.

    Objects and lists are taken apart level by level, what is a usage object no further;
    each level is stored, and the last is the one without any left.
    """
    names = PROMPT_KEYS + COMPLETION_KEYS
    at = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")

    def whole(v, own: tuple[str, ...]):
        value = F.coalesce(*(at(v, n) for n in own))
        plain = F.schema_of_variant(value)
        number = F.when(plain == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double")).when(~plain.startswith("OBJECT") & ~plain.startswith("ARRAY"), F.try_variant_get(value, "$", "string").try_cast("double"))
        fits = F.when(~F.isnan(number) & (F.abs(number) < float(1 << 62)), number)
        return F.coalesce(fits.cast("long"), F.lit(0)).cast("long")

    is_usage = reduce(or_, (at(F.col("v"), n).isNotNull() for n in names))
    left = texts.select(F.try_parse_json(column).alias("v")).where("v is not null")
    found = []
    while True:
        level = stored(left.select("v", (is_usage & F.schema_of_variant("v").startswith("OBJECT")).alias("usage")), "usage")
        found.append(level.where("usage").select(whole(F.col("v"), PROMPT_KEYS).alias("prompt_tokens"), whole(F.col("v"), COMPLETION_KEYS).alias("completion_tokens")))
        kind = F.schema_of_variant("v")
        rest = level.where(~F.col("usage") & (kind.startswith("OBJECT") | kind.startswith("ARRAY")))
        if rest.isEmpty():
            return reduce(DataFrame.union, found)
        children = texts.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("value").alias("child"))
        left = rest.lateralJoin(children).select(F.col("child").alias("v"))


def read_usage_rows(texts: DataFrame, column: str = "value") -> DataFrame:
    """The same by a Python function of each text."""
    return texts.lateralJoin(UsageIn(F.col(column).outer())).select("prompt_tokens", "completion_tokens")
