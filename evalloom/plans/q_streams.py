"""Streaming queries over everything that is there, equal to their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.plans import fixtures as X
from evalloom.plans.q_results import _T, _turns, lines
from evalloom.plans.q_scores import _SCORES
from evalloom.plans.base import query
from evalloom.sources.shared import shared_path, stored
from evalloom.streaming import streams as S


def _to(stream, spark, name, mode="append", conf=None):
    """The stream's result as a table in the shared folder."""
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    if mode == "append":
        S.run_available(stream, out, state, conf=conf)
        return spark.read.schema(stream.schema).parquet(out)
    # the whole result so far is written over at each batch: a row for each group
    S.run_available(stream, out, state, mode, lambda df, i: df.write.mode("overwrite").parquet(out))
    return spark.read.schema(stream.schema).parquet(out)


@query("q_stream_ingest", f"""WITH {_T} SELECT cid AS custom_id, turn::INTEGER AS sample_index, CASE WHEN conv_id % 7 = 0 THEN '' ELSE text END AS response_text,
  conv_id % 7 = 0 AS failed, CASE WHEN conv_id % 7 <> 0 AND conv_id % 5 = 2 THEN 2 ELSE 1 END::BIGINT AS revision FROM t WHERE conv_id % 13 <> 0""")
def _(spark, sf_dir):
    """The lines are written as JSONL parts, some ids in two of them, and ingested as a stream, a part a batch.

    A fifth of the ids has an error stub in an earlier part, which its answer replaces, and
    another fifth one in a later part, which changes nothing.
    """
    path = shared_path(spark, "parts")
    t = lines(spark, sf_dir)
    stub = F.to_json(F.struct(F.col("cid").alias("custom_id"), F.struct(F.lit("late").alias("message")).alias("error")))
    ids = _turns(spark, sf_dir).where("conv_id % 13 <> 0")
    stubs = lambda k: ids.where(f"conv_id % 5 = {k} and conv_id % 7 <> 0").select(stub.alias("value"))
    of = lambda name: t.where(F.col("file") == name).select(F.col("line").alias("value"))
    # a part is a folder of files, which all tasks write; its number orders its records
    stream = S.stream_results(spark, f"{path}/*", names="*.txt", depth=r"/(\d+)/[^/]*$")
    # each part is a start of its own: its stores are closed when it ends, else four copies of the state lie on the executors' disks
    conf = S.RESULTS_CONF | {"spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    p = _phases(stream, spark, "ingest", path, (stubs(2), of("a.jsonl"), of("b.jsonl"), stubs(3)), conf, lambda df, to: df.write.text(to))
    return S.latest(p).join(p.groupBy("custom_id").agg(F.max("revision").alias("revision")), "custom_id").select("custom_id", "sample_index", "response_text", F.col("failure").isNotNull().alias("failed"), "revision")


def _prediction_stream(spark, sf_dir):
    path = shared_path(spark, "predictions")
    items = X.text_items(spark, sf_dir)
    p = X.text_predictions(items)
    p.repartition(3, "item_key").write.parquet(path)
    return spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(path), items


@query("q_stream_scores", f"""{_SCORES} SELECT item_key, type, condition, temp, round(avg(em), 9) AS em, round(coalesce(stddev_samp(em), 0), 7) AS em_std, round(avg(f1), 9) AS f1, round(avg(abstained), 9) AS abstain_rate, count(*) AS k FROM sc GROUP BY ALL""")
def _(spark, sf_dir):
    stream, items = _prediction_stream(spark, sf_dir)
    out = shared_path(spark, "scores")
    S.run_available(stream, out, shared_path(spark, "scores-state"), "append", S.score_batch(items, out))
    m = S.merged_scores(spark, out)
    return m.select("item_key", "type", "condition", "temp", F.round("em", 9).alias("em"), F.round("em_std", 7).alias("em_std"), F.round("f1", 9).alias("f1"), F.round("abstain_rate", 9).alias("abstain_rate"), "k")


_TELEMETRY = "SELECT date_trunc('hour', ts)::VARCHAR AS window_start, event_type AS provider, count(value) AS samples, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS max_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms FROM events GROUP BY 1, 2"


def _shown(t):
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return t.select(start, "provider", "samples", *(F.round(c, 6).alias(c) for c in ("mean_ms", "max_ms", "p95_ms")))


@query("q_stream_late", _TELEMETRY)
def _(spark, sf_dir):
    """Append mode: all events, then late copies of the first day's with other values, which the watermark drops, then a much later event that closes all windows."""
    path = shared_path(spark, "samples")
    e = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))
    ends = e.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    late = e.crossJoin(ends).where(F.col("ts") < F.least(F.col("first") + F.expr("INTERVAL 1 DAY"), F.col("last") - F.expr("INTERVAL 3 HOURS"))).select("provider", "ts", (F.col("latency_ms") + 1000).alias("latency_ms"))
    end = lambda wait: ends.select(F.lit("end").alias("provider"), (F.col("last") + F.expr(f"INTERVAL {wait}")).alias("ts"), F.lit(0.0).alias("latency_ms"))
    # rows are held against the watermark of the batch before the last: one small batch lies between
    stream = spark.readStream.schema(e.schema).parquet(f"{path}/*")
    return _shown(_phases(S.stream_telemetry(stream), spark, "closed", path, (e, end("1 MINUTE"), late, end("2 DAYS"))).where("provider <> 'end'"))


def _phases(stream, spark, name, path, parts, conf=None, write=lambda df, p: df.write.parquet(p)):
    """The stream's result over parts that come one after another: each is written by all tasks, and the stream goes on from where it stopped."""
    out, state = shared_path(spark, name), shared_path(spark, f"{name}-state")
    for i, part in enumerate(parts):
        write(part, f"{path}/{i}")
        S.run_available(stream, out, state, conf=conf)
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: the table can be a file or a folder


@query("q_stream_telemetry", _TELEMETRY)
def _(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))
    t = _to(S.stream_telemetry(e), spark, "telemetry", "complete")
    return _shown(t)


@query("q_sketch_rollup", """WITH e AS (SELECT date_trunc('day', ts)::DATE AS day, event_type AS provider FROM events WHERE value IS NOT NULL),
g AS (SELECT day::VARCHAR AS day, provider, count(*) AS samples FROM e GROUP BY ALL UNION ALL SELECT 'all', provider, count(*) FROM e GROUP BY provider UNION ALL SELECT 'all', 'all', count(*) FROM e) SELECT *, true AS q50_right, true AS q95_right FROM g""")
def _(spark, sf_dir):
    """Hourly sketches merged to days and providers, these to all days and to one; each quantile's true rank, counted over the events, is within a hundredth (and two samples)."""
    e = X.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"))
    hours = stored(S.latency_sketches(e), "sketches")
    days = S.rolled_up(hours, F.to_date("window_start").cast("string").alias("day"), "provider")
    whole = S.rolled_up(days, F.lit("all").alias("day"), "provider")
    every = S.rolled_up(whole, F.lit("all").alias("day"), F.lit("all").alias("provider"))
    merged = stored(days.unionByName(whole).unionByName(every).drop("sketch"), "quantiles")
    at = F.explode(F.array(F.struct(F.to_date("ts").cast("string").alias("day"), F.col("provider").alias("provider")), F.struct(F.lit("all").alias("day"), F.col("provider").alias("provider")), F.struct(F.lit("all").alias("day"), F.lit("all").alias("provider")))).alias("at")
    ranks = e.where("latency_ms is not null").select(at, "latency_ms").join(F.broadcast(merged), (F.col("at.day") == F.col("day")) & (F.col("at.provider") == F.col("provider")))  # a row for each day and provider

    def right(q):
        low, high = (F.count_if(F.col("latency_ms") < F.col(f"q{q}")), F.count_if(F.col("latency_ms") <= F.col(f"q{q}")))
        slack = 0.01 * F.count("*") + 2
        return ((low <= q / 100 * F.count("*") + slack) & (high >= q / 100 * F.count("*") - slack)).alias(f"q{q}_right")

    return ranks.groupBy("day", "provider", "samples").agg(right(50), right(95))


@query("q_stream_progress", "SELECT user_id % 10 AS part, count(*) AS items_out, 900::BIGINT AS items_in, count(*) >= 900 AS done FROM events GROUP BY 1")
def _(spark, sf_dir):
    parts = spark.range(10).select(F.col("id").alias("part"), F.lit(900).cast("long").alias("items_in"))
    return _to(S.stream_part_progress(_events(spark, sf_dir).select((F.col("user_id") % 10).alias("part")), parts), spark, "progress", "complete")
