"""Cases of the findings of round 3, compared with plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import requests
from evalloom.plans import registry


def test_texts_of_any_length_in_documents(spark, tmp_path):
    """benchmark texts of one, two and more words; the first and last may be parts of words."""
    rng = random.Random(3)
    words = ["ab", "bc", "cab", "abc", "Ähre", "die", "the", "x1"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(60)] + [(60, None)]
    texts = [(i, " ".join(rng.choices(words, k=1 + i % 6))) for i in range(30)] + [(30, "b x1"), (31, "ab b"), (32, "the"), (33, "a")]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = sorted(map(tuple, registry.QUERIES["q_grounded_benchmark"](spark, sf).select("doc_id", "item_id").collect()))
    normal = lambda s: T._normal(s or "")
    assert got == sorted((d, i) for d, t in docs for i, b in texts if normal(b) and normal(b) in normal(t))


@pytest.mark.parametrize("s", ["[1] see the note", '["a"]] more', '["a"]} more', '["a"], ["b"]', '["a"],"b":2', "[ab", "plain", ""])
def test_only_whole_lists_are_lists(spark, s):
    """a text that begins with a list is a text."""
    assert spark.range(1).select(T.content_to_text(F.lit(s))).first()[0] == s


def test_lists_with_space_after_them(spark):
    assert spark.range(1).select(T.content_to_text(F.lit('["a", {"type": "text", "text": "b"}, ""] \n'))).first()[0] == "a\nb"


def test_content_of_any_characters(spark, tmp_path):
    """words with quotes, backslashes, tabs of other kinds and control characters."""
    sf, parts = str(tmp_path), ['"', "\\", "\x01", "\x0b", "\r", "\x1f", "k"]
    docs = [(4 * i + 1, f"w x {a}q r{b} {b}{a} y z") for i, (a, b) in enumerate((a, b) for a in parts for b in parts)] + [(4, "[1] note"), (6, "] note")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    want = sorted(db.execute(registry.ORACLES["q_content_text"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["q_content_text"](spark, sf).select("doc_id", "digest").collect())) == want


@pytest.mark.parametrize("name", ["q_stream_telemetry", "q_stream_late"])
def test_quantile_of_many_different_samples(spark, tmp_path, name):
    """the 95th of more different latencies than a sketch holds is the one at its rank."""
    sf = str(tmp_path)
    e = spark.range(60001).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 10 * (id div 60000))").alias("ts"), (F.col("id") * 7919 % 60000 / 4).alias("value"))
    e.repartition(3).write.parquet(f"{sf}/events.parquet")
    got = registry.QUERIES[name](spark, sf).orderBy("window_start").first()
    assert (got["samples"], got["max_ms"], got["p95_ms"]) == (60000, 59999 / 4, 56999 / 4)


def test_blocks_are_built_once_for_all_caches(spark):
    """lines of several settings are those of each alone; no plan reads the messages more than once."""
    contents = ["null", '"x"', "[]", '["a", "b"]', '[{"text": null, "type": ""}]', '[{"type": "image"}, {"text": "q", "cache_control": null}]', '[{"text": "a", "cache_control": {"type": "mine"}}, "z", 3, null]', "5", '[{"type": "image"}]', "{}"]
    rows = [(f"{i}|{j}", f'[{{"role": "System ", "content": {a}}}, {{"role": " ", "content": {b}}}, {{"content": "u"}}]') for i, a in enumerate(contents) for j, b in enumerate(contents)]
    talks = spark.createDataFrame(rows, "custom_id string, m string").select("custom_id", F.from_json("m", "array<struct<role:string,content:variant>>").alias("messages"), F.array(F.lit("E")).alias("stop"))
    caches = {"default": None, "own": {"type": "kept", "ttl": "1h"}, "off": {"enable_system_cache": False}}
    out = requests.render_anthropic(talks, "m", 0.5, caches=caches)
    got = sorted(map(tuple, out.select("cache", "custom_id", "line").collect()))
    assert got == sorted((name, *r) for name, c in caches.items() for r in requests.render_anthropic(talks, "m", 0.5, cache=c).collect())
    lines = {(c, i): json.loads(x)["params"].get("system") for c, i, x in got}
    assert lines["default", "6|0"] == [{"type": "text", "text": "a", "cache_control": {"type": "mine"}}, {"type": "text", "text": "z"}]
    assert lines["own", "5|1"] == [{"type": "image"}, {"type": "text", "text": "q", "cache_control": {"type": "kept", "ttl": "1h"}}]
    assert lines["off", "4|1"] == [{"type": "text", "text": ""}] and lines["default", "0|1"] is None
    for df in (out, requests.render_anthropic(talks, "m", 0.5)):
        assert df._jdf.queryExecution().executedPlan().toString().count("from_json(ArrayType(StructType(") == 1


def test_ingested_parts_are_written_by_all_tasks(spark, tmp_path):
    """no part of the stream goes through one task, and a part of many files is one batch: revisions are those of its number."""
    import glob

    import duckdb

    sf, found = str(tmp_path), lambda: set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/evalloom-parts-*"))
    c = spark.range(600).selectExpr("id div 2 AS conv_id", "cast(id % 2 AS int) AS turn", "if(id % 50 = 7, null, 'assistant') AS role", "if(id % 40 = 9, null, concat('w ', id)) AS text")
    c.repartition(4).write.parquet(f"{sf}/conversations.parquet")
    before = found()
    got = sorted(map(tuple, registry.QUERIES["q_stream_ingest"](spark, sf).collect()))
    parts = next(iter(found() - before))
    assert all(len(glob.glob(f"{parts}/{i}/*.txt")) > 1 for i in range(4))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet/*.parquet')")
    assert got == sorted(db.execute(registry.ORACLES["q_stream_ingest"]).fetchall()) and {r[-1] for r in got} == {1, 2}
