"""Queries of readers and writers: tables are written in a format in the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import pairs as P
from evalloom.operators import requests
from evalloom.plans import fixtures as X
from evalloom.plans.base import query
from evalloom.plans.q_requests import _REQ, _SHARDS, _numbered, _requests
from evalloom.plans.q_results import _GOOD, _predictions
from evalloom.plans.q_stats import _MCNEMAR
from evalloom.sources import io
from evalloom.sources.shared import shared_path


@query("q_read_items", f"WITH {X.ITEMS} SELECT item_key, md5(context) AS context, array_to_string(answers, '|') AS answers, is_unanswerable FROM items")
def _(spark, sf_dir):
    path = shared_path(spark, "items")
    items = X.text_items(spark, sf_dir).select("dataset", F.col("item_id").alias("id"), "context", F.lit("q").alias("question"), "answers", "is_unanswerable")
    items.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(""))).alias("value")).write.text(path)  # blank lines between
    return io.read_items(spark, path).select("item_key", F.md5("context").alias("context"), F.array_join("answers", "|").alias("answers"), "is_unanswerable")


def _request_lines(spark, sf_dir):
    """Requests as JSON lines: every fifth item's are cut off, every seventh one's lack their id."""
    path, i = shared_path(spark, "requests"), F.col("id").cast("long")
    body = F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("id").alias("content"))).alias("messages"))
    line = F.to_json(F.struct(F.when(i % 7 != 0, F.col("custom_id")).alias("custom_id"), body.alias("body")))
    _requests(spark, sf_dir).select(F.when(i % 5 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line).alias("value")).write.text(path)
    return path


@query("q_read_requests", f"{_REQ} SELECT custom_id, id AS said FROM req WHERE id::BIGINT % 5 <> 0 AND id::BIGINT % 7 <> 0")
def _(spark, sf_dir):
    r = io.read_requests(spark, _request_lines(spark, sf_dir))
    return r.select("custom_id", T.content_to_text(F.col("body.messages")[0]["content"]).alias("said"))


@query("q_split_requests", f"{_REQ}, k AS (SELECT id::BIGINT % 5 <> 0 AND id::BIGINT % 7 <> 0 AS kept FROM req) SELECT kept, count(*) AS n FROM k GROUP BY kept")
def _(spark, sf_dir):
    good, left = io.split_requests(spark, _request_lines(spark, sf_dir))
    return good.select(F.lit(True).alias("kept")).union(left.select(F.lit(False))).groupBy("kept").agg(F.count("*").alias("n"))


for _name, _form in (("q_csv_predictions", "csv"), ("q_parquet_predictions", "parquet")):

    @query(_name, f"{_GOOD} SELECT cid AS custom_id, conv_id::VARCHAR AS item_id, 0.0::DOUBLE AS temp, turn::INTEGER AS sample_index, text AS response_text, turn AS prompt_tokens FROM ok WHERE conv_id % 7 <> 0")
    def _(spark, sf_dir, form=_form):
        path = shared_path(spark, "predictions")
        io.write_predictions(_predictions(spark, sf_dir).where("failure is null"), path, form)
        p = io.read_predictions(spark, path) if form == "csv" else spark.read.parquet(path)
        return p.select("custom_id", "item_id", "temp", "sample_index", "response_text", "prompt_tokens")


@query("q_write_shards", f"{_SHARDS} SELECT shard, custom_id AS line FROM sh WHERE condition = 'control' AND temp = 0.0")
def _(spark, sf_dir):
    path = shared_path(spark, "shards")
    io.write_shards(requests.assign_shard(_numbered(spark, sf_dir).where("condition = 'control' and temp = 0.0"), 4000), path, line="custom_id")
    return spark.read.text(path).select("shard", F.col("value").alias("line"))


@query("q_write_results", f"{_MCNEMAR} SELECT temp, type, n, b, c FROM m")
def _(spark, sf_dir):
    path = shared_path(spark, "results")
    io.write_results(P.mcnemar_counts(P.pair_conditions(X.per_item(spark, sf_dir)), "temp", "type"), path, "json")
    return spark.read.schema("temp double, type string, n long, b long, c long").json(path)
