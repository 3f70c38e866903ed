"""Incremental ingest and running aggregates with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from evalloom.functions import text as T
from evalloom.operators import normalize, score
from evalloom.sources.shared import stored

MEASURES = ("em", "f1", "abstained", "false_answer", "unsupported")


#: What a stream of stream_results starts with: values with a time to live need this store, and would make batches without data for ever.
RESULTS_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_CHOSEN = StructType([StructField("stub", BooleanType()), StructField("file", StringType()), StructField("digest", StringType()), StructField("revision", LongType())])
_CHANGES = StructType([StructField("custom_id", StringType()), StructField("value", StringType()), StructField("revision", LongType())])


class BestRecord(StatefulProcessor):
    """For each custom_id the best record so far: one with a response, then that of the first file, then the least digest.

    A better one is passed on when it comes, with the next revision; so an error stub is
    replaced by the answer that follows it, and an answer never by a stub. What is known of
    an id is dropped when it was not written for ttl_ms.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chosen = handle.getValueState("chosen", _CHOSEN, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        best = min(rows, key=lambda r: (r["stub"], r["file"], r["digest"]))
        own, known = (best["stub"], best["file"], best["digest"]), self.chosen.get()
        if known is None or own < tuple(known[:3]):
            revision = 1 if known is None else known[3] + 1
            self.chosen.update((*own, revision))
            yield Row(custom_id=key[0], value=best["value"], revision=revision)

    def close(self) -> None:
        pass


def stream_results(spark: SparkSession, path: str, ttl: timedelta = timedelta(days=1), files: int | None = None, names: str = "*.jsonl", depth: str | None = None) -> DataFrame:
    """New JSONL parts below a folder as predictions, with the revision of each.

    A custom_id comes again, with the next revision, when a better record of it comes (see
    BestRecord): combine_parts over all files gives what the last revisions have. Ids are
    known for ttl of processing time. depth: a part of the file's path that orders files,
    as a regular expression with one group; the whole path otherwise.
    """
    r = spark.readStream.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", names)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    file = F.col("_metadata.file_path")
    lines = r.load(path).select("value", (F.regexp_extract(file, depth, 1) if depth else file).alias("file"))
    recs = normalize.records(lines).select("custom_id", (~normalize.has_response(F.col("v"))).alias("stub"), "file", F.md5("value").alias("digest"), "value")
    best = recs.groupBy("custom_id").transformWithState(BestRecord(ttl // timedelta(milliseconds=1)), _CHANGES, "append", "processingtime")
    return normalize.predictions(best.withColumn("v", F.try_parse_json("value")), "revision")


def latest(predictions: DataFrame) -> DataFrame:
    """The last revision of each custom_id of what stream_results gave, in one aggregation."""
    rest = [c for c in predictions.columns if c not in ("custom_id", "revision")]
    top = F.max_by(F.struct(*rest), "revision").alias("p")
    return predictions.groupBy("custom_id").agg(top).select("custom_id", "p.*").select(*(c for c in predictions.columns if c != "revision"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", per_batch: Callable | None = None, conf: dict[str, str] | None = None) -> None:
    """Everything that is there now, in as many batches as the source makes, then stop.

    conf: settings that the stream starts with (RESULTS_CONF for stream_results); the session's own stay what they were.
    """
    spark, conf = stream.sparkSession, conf or {}
    before = {k: spark.conf.get(k) for k in conf}
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        q = w.foreachBatch(per_batch).start() if per_batch else w.format("parquet").option("path", path).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    q.awaitTermination()


KEYS = ("item_key", "type", "condition", "temp")
#: Batches whose states are merged into one table.
COMPACTED = 10


def moments(measure: str, prefix: str = "") -> list[Column]:
    """Number, mean and sum of squared distances from the mean of a measure: a state that merges without cancelling."""
    x = F.col(measure)
    n = F.count(x)
    return [n.alias(f"{prefix}{measure}_n"), F.avg(x).alias(f"{prefix}{measure}_mean"), (F.var_pop(x) * n).alias(f"{prefix}{measure}_m2")]


def merged_moments(states: DataFrame, measures: tuple[str, ...], *keys: str) -> DataFrame:
    """States (keys, k, measure_n, measure_mean, measure_m2) merged by key: two at a time by Chan's rule.

    A key has a state for each batch since the last compaction and one for all before.
    """
    kind = "struct<n:bigint,mean:double,m2:double>"

    def merge(a: Column, b: Column) -> Column:
        n, d = a["n"] + b["n"], b["mean"] - a["mean"]
        both = F.struct(n.alias("n"), (a["mean"] + d * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2")).cast(kind)
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)

    state = lambda m: F.struct(F.col(f"{m}_n").alias("n"), F.coalesce(f"{m}_mean", F.lit(0.0)).alias("mean"), F.coalesce(f"{m}_m2", F.lit(0.0)).alias("m2")).cast(kind)
    none = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")).cast(kind)
    g = states.groupBy(*keys).agg(F.sum("k").alias("k"), *(F.sort_array(F.collect_list(state(m))).alias(m) for m in measures))
    g = g.withColumns({m: F.aggregate(m, none, merge) for m in measures})
    parts = {f"{m}_{c}": F.col(f"{m}.{c}") for m in measures for c in ("n", "mean", "m2")}
    return g.select(*keys, "k", *(c.alias(name) for name, c in parts.items()))


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Finished folders below path: numbers of batches, and of tables of all batches before a number."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = {"batch": [], "upto": []}
    for s in fs.listStatus(p) if fs.exists(p) else []:
        kind, _, number = s.getPath().getName().partition("=")
        if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return {k: sorted(v) for k, v in found.items()}


def _states(spark: SparkSession, path: str) -> DataFrame | None:
    """The states that count: the last compacted table and the batches from its number on."""
    f = _folders(spark, path)
    upto = f["upto"][-1:]
    parts = [f"{path}/upto={n}" for n in upto] + [f"{path}/batch={n}" for n in f["batch"] if not upto or n >= upto[0]]
    return spark.read.parquet(*parts) if parts else None


def compact(spark: SparkSession, path: str, before: int) -> None:
    """One table of all batches before a number; what an earlier compaction had already merged is removed.

    Readers of the table before keep their files until the next compaction.
    """
    f = _folders(spark, path)
    last = f["upto"][-1:]
    parts = [f"{path}/upto={n}" for n in last] + [f"{path}/batch={n}" for n in f["batch"] if n < before and (not last or n >= last[0])]
    if last == [before] or not parts:
        return
    merged_moments(spark.read.parquet(*parts), MEASURES, *KEYS).write.mode("overwrite").parquet(f"{path}/upto={before}")
    gone = [f"{path}/upto={n}" for n in f["upto"][:-1]] + [f"{path}/batch={n}" for n in f["batch"] if last and n < last[0]]
    for g in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(g)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def score_batch(items: DataFrame, path: str, every: int = COMPACTED) -> Callable[[DataFrame, int], None]:
    """A batch's predictions scored and added up by item: number, mean and squared distances of each measure.

    Items are prepared and stored once. A batch has a folder of its own that a repeated batch
    overwrites, so each counts once; after so many batches the finished ones are merged.
    """
    items = stored(score.prepare_items(items, T.support_inputs("baseline")), "items")

    def add(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % every == 0:
            compact(batch.sparkSession, path, batch_id)  # only batches that can't come again
        g = score.score_predictions(batch, items).groupBy(*KEYS).agg(F.count("*").alias("k"), *(c for m in MEASURES for c in moments(m)))
        g.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return add


def merged_scores(spark: SparkSession, path: str) -> DataFrame:
    """Means and sample deviations by item over all batches so far."""
    g = merged_moments(_states(spark, path), MEASURES, *KEYS)
    names = dict(zip(MEASURES, ("em", "f1", "abstain_rate", "false_answer_rate", "unsupported_rate")))
    n = lambda m: F.col(f"{m}_n")
    sd = lambda m: F.when(n(m) > 1, F.sqrt(F.col(f"{m}_m2") / (n(m) - 1))).when(n(m) == 1, 0.0)
    return g.select(*KEYS, *(x for m, name in names.items() for x in (F.when(n(m) > 0, F.col(f"{m}_mean")).alias(name), sd(m).alias(f"{name}_std"))), "k")


def stream_telemetry(samples: DataFrame, window: str = "1 hour", slide: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """samples (provider, ts, latency_ms) as a stream: count, mean, largest and 95th latency by window.

    The 95th is exact: a window's state holds its different latencies with their numbers.
    """
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = samples.withWatermark("ts", watermark).groupBy(w.alias("w"), "provider")
    a = g.agg(F.count("latency_ms").alias("samples"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_ms"))
    return a.select(F.col("w.start").alias("window_start"), "provider", "samples", "mean_ms", "max_ms", "p95_ms")


def latency_sketches(samples: DataFrame, window: str = "1 hour", k: int = 800) -> DataFrame:
    """samples (provider, ts, latency_ms), a stream or a table: number and a quantile sketch of latencies by window.

    Sketches of k (8 to 65535) merge without their samples; a rank is off by about 2.3 / k of the samples.
    """
    g = samples.where("latency_ms is not null").groupBy(F.window("ts", window).alias("w"), "provider")
    a = g.agg(F.count("*").alias("samples"), F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("sketch"))
    return a.select(F.col("w.start").alias("window_start"), "provider", "samples", "sketch")


def rolled_up(sketches: DataFrame, *keys: Column | str, quantiles: tuple[float, ...] = (0.5, 0.95), k: int = 800) -> DataFrame:
    """Sketches merged by keys (a day, a provider): samples, the quantiles q50, q95 and so on, and the sketch, to be merged further."""
    m = sketches.groupBy(*keys).agg(F.sum("samples").alias("samples"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return m.withColumns({f"q{round(100 * q)}": F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in quantiles})


def stream_part_progress(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results (part) as a stream against expected (part, items_in): items seen so far."""
    seen = results.groupBy("part").agg(F.count("*").alias("items_out"))
    return seen.join(expected, "part").withColumn("done", F.col("items_out") >= F.col("items_in"))
