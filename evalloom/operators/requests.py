"""Request matrices, shards and provider payloads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import first_filled, temp_key
from evalloom.sources.shared import stored


def coalesce_fields(df: DataFrame, default: str = "unknown", pos: str = "pos") -> DataFrame:
    """Differently named columns made dataset, id and question; rows without a question go."""
    have = lambda *names: [F.col(n).cast("string") for n in names if n in df.columns] or [F.lit(None).cast("string")]
    out = df.select(
        "*", F.coalesce(first_filled(*have("dataset", "source", "collection")), F.lit(default)).alias("_dataset"),
        F.coalesce(first_filled(*have("id", "example_id", "qid", "uuid")), F.col(pos).cast("string")).alias("_id"), first_filled(*have("question", "query", "prompt")).alias("_question"),
    )
    return out.where("_question is not null").select(F.col("_dataset").alias("dataset"), F.col("_id").alias("id"), F.col("_question").alias("question"), pos)


def assemble_user(kind: Column, instructions: Column, context: Column, question: Column) -> Column:
    opened = F.concat(instructions, F.lit("\n\nCONTEXT:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQUESTION:\n"), question)
    return F.when(kind == "open", opened).otherwise(F.concat(instructions, F.lit("\n\nQUESTION:\n"), question))


def encode_custom_id(dataset: Column, item_id: Column, condition: Column, temp: Column, sample: Column, kind: Column) -> Column:
    return F.concat_ws("|", dataset, item_id, condition, temp_key(temp), sample.cast("string"), kind)


def request_matrix(items: DataFrame, samples: dict[float, int], conditions: tuple[str, ...] = ("control", "treatment")) -> DataFrame:
    """items (dataset, id, type, ...) times temps, their samples and conditions, with custom_id."""
    plan = F.array(*(F.struct(F.lit(float(t)).alias("temp"), F.lit(k).alias("k")) for t, k in samples.items()))
    r = items.withColumn("_p", F.explode(plan)).withColumn("temp", F.col("_p.temp"))
    r = r.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.col("_p.k") - 1))).withColumn("condition", F.explode(F.array(*map(F.lit, conditions)))).drop("_p")
    return r.withColumn("custom_id", encode_custom_id(F.col("dataset"), F.col("id"), F.col("condition"), F.col("temp"), F.col("sample_index"), F.col("type")))


def dedupe_custom_id(requests: DataFrame, *order: str) -> DataFrame:
    """The first request of each custom_id in order."""
    w = Window.partitionBy("custom_id").orderBy(*order)
    return requests.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def skipped_ids(requests: DataFrame, *keys: str) -> DataFrame:
    return requests.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct("custom_id").alias("n_ids")).withColumn("skipped", F.col("n_rows") - F.col("n_ids"))


def numbered(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """pos: the row's number in its group, from 1, in an order.

    No window spans a group: rows are dealt by ranges of keys and order together (as many
    as the session has shuffle partitions, or as given), sorted and stored with their place
    in the range; counted ranges tell how many of the group come before. Only rows that are
    equal in keys and order never part. Null keys are groups, too.
    """
    by = [*keys, *order]
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *by).sortWithinPartitions(*by)
    placed = stored(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    starts = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_r"), (before - F.col("_first") + 1).alias("_start"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_start")).alias("pos"))


def assign_shard(df: DataFrame, most: int = 9999, pos: str = "pos") -> DataFrame:
    """shard (0, 1, ...) and file name part of rows numbered by pos."""
    shard = F.floor((F.col(pos) - 1) / most).cast("int")
    part = F.when(shard > 0, F.concat(F.lit("_part"), F.lpad((shard + 1).cast("string"), 2, "0"))).otherwise("")
    return df.withColumn("shard", shard).withColumn("suffix", part)


def shard_manifest(rows: DataFrame, line: str, pos: str, *keys: str) -> DataFrame:
    """Lines, bytes and SHA-256 of each shard's file; a shard's lines are bounded by assign_shard."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(pos, line))), lambda x: x[line])
    g = rows.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum(F.octet_length(line) + 1).alias("bytes"), F.sha2(F.concat(F.array_join(lines, "\n"), F.lit("\n")), 256).alias("sha256"))
    return g


def prune_stale_shards(manifest: DataFrame, fresh: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """manifest and fresh (prompt_set, temp, condition, name, ...): rows of refreshed groups that are not new go.

    A row's group is refreshed if its temp is no further than the tolerance from one of the few fresh groups' temps.
    """
    groups = fresh.select(F.col("prompt_set").alias("_set"), F.col("condition").alias("_condition"), F.col("temp").alias("_temp")).distinct()
    near = (F.col("prompt_set") == F.col("_set")) & (F.col("condition") == F.col("_condition")) & (F.abs(F.col("temp") - F.col("_temp")) <= tolerance)
    return manifest.join(groups, near, "left_anti").unionByName(fresh)


def split_parts(df: DataFrame, parts: int, lines_per_part: int | None = None, pos: str = "pos") -> DataFrame:
    """part (1, 2, ...) in contiguous chunks of rows numbered by pos."""
    n = df.agg(F.count("*").alias("_n"))
    chunk = F.lit(lines_per_part) if lines_per_part else F.greatest(F.lit(1), F.ceil(F.col("_n") / parts))
    return df.crossJoin(F.broadcast(n)).withColumn("part", (F.floor((F.col(pos) - 1) / chunk) + 1).cast("int")).drop("_n")


def part_sizes(split: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows of each part; with parts, empty ones too."""
    g = split.groupBy("part").agg(F.count("*").alias("n"))
    if parts is None:
        return g
    every = split.sparkSession.range(1, parts + 1).select(F.col("id").cast("int").alias("part"))
    return every.join(g, "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def token_limit(kind: Column, limits: Column, anthropic: bool = False) -> Column:
    """The limit of a request's type in a map; of message batches any value, else 1024, when there is none."""
    at = lambda k: F.try_element_at(limits, F.lit(k))
    own = F.when(kind == "open", F.coalesce(at("open_book"), at("open"), at("default"))).when(kind == "closed", F.coalesce(at("closed_book"), at("closed"), at("default"))).otherwise(at("default"))
    return F.coalesce(own, at("default"), F.try_element_at(F.map_values(limits), F.lit(1)), F.lit(1024)) if anthropic else own


def kind_of(custom_id: Column) -> Column:
    return F.element_at(F.split(custom_id, r"\|"), -1)


def _limits(limits: dict[str, int] | None) -> Column:
    return F.create_map(*(x for k, v in (limits or {}).items() for x in (F.lit(k), F.lit(v)))).cast("map<string,int>")


def _overridden(fields: dict[str, Column], overrides: dict | None) -> Column:
    """A struct of fields in order; overrides replace fields of their names and come last."""
    every = fields | {k: F.parse_json(F.lit(json.dumps(v))) for k, v in (overrides or {}).items()}
    return F.struct(*(c.alias(k) for k, c in every.items()))


def _metadata(metadata: dict | None) -> dict[str, Column]:
    return {str(k): F.lit("" if v is None else str(v)) for k, v in (metadata or {}).items() if k is not None}


def render_openai(
    requests: DataFrame, model: str, endpoint: str = "/v1/responses", temperature: float | None = None, top_p: float | None = None, limits: dict[str, int] | None = None, metadata: dict[str, str] | None = None,
    overrides: dict | None = None, allow_temperature: bool = True, allow_top_p: bool = True,
) -> DataFrame:
    """requests (custom_id, messages, stop) as JSON lines; rows without id or messages are left out.

    overrides replace whole fields of the body, last of all; what is not allowed is neither set nor overridden.
    """
    r = requests.where("custom_id is not null and custom_id <> '' and size(messages) > 0")
    responses = endpoint == "/v1/responses"
    f = {"model": F.lit(model)}
    if temperature is not None and allow_temperature:
        f["temperature"] = F.lit(float(temperature))
    if top_p is not None and allow_top_p:
        f["top_p"] = F.lit(float(top_p))
    f["stop"] = F.when(F.size("stop") > 0, F.col("stop"))
    f["max_output_tokens" if responses else "max_tokens"] = token_limit(kind_of(F.col("custom_id")), _limits(limits))
    f["input" if responses else "messages"] = F.col("messages")
    if metadata:
        f["metadata"] = F.struct(*(c.alias(k) for k, c in sorted(_metadata(metadata).items())))
    barred = {k for k, allowed in (("temperature", allow_temperature), ("top_p", allow_top_p)) if not allowed}
    body = _overridden(f, {k: v for k, v in (overrides or {}).items() if k not in barred})
    return r.select("custom_id", F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(endpoint).alias("url"), body.alias("body"))).alias("line"))


def _blocks(content: Column, plain: bool) -> Column:
    """Content, a string or a variant, as a list of blocks, maps of their fields: strings are text blocks, a block without type is a text block."""
    typed = F.create_map(F.lit("type"), F.parse_json(F.lit('"text"')))
    text_block = lambda s: F.map_concat(typed, F.create_map(F.lit("text"), s.cast("variant")))
    if plain:
        return F.when(content.isNotNull(), F.array(text_block(content)))

    def block(x: Column) -> Column:
        fields = F.transform_values(F.try_variant_get(x, "$", "map<string,variant>"), lambda k, v: F.when((k == "text") & F.is_variant_null(v), F.lit("").cast("variant")).otherwise(v))
        untyped = F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("")) == ""
        fields = F.when(untyped, F.map_concat(typed, F.map_filter(fields, lambda k, v: k != "type"))).otherwise(fields)
        return F.coalesce(fields, F.when(F.schema_of_variant(x) == "STRING", text_block(x.cast("string"))))  # only objects have fields

    many = F.try_variant_get(content, "$", "array<variant>")
    blocks = F.coalesce(F.filter(F.transform(many, block), lambda b: b.isNotNull()), F.array(text_block(content.cast("string"))))
    return F.when(content.isNotNull() & ~F.is_variant_null(content), blocks)


def _marked(blocks: Column, bare: Column, first: Column, cache: dict | None) -> Column:
    """Blocks with a cache mark on the first text block; bare: without marks, first: the place of their first text block. See render_anthropic."""
    if cache is not None and cache.get("enable_system_cache") in (False, 0, ""):
        return bare
    mark = {"type": str((cache or {}).get("type") or "ephemeral").strip() or "ephemeral"}
    if cache and cache.get("ttl"):
        mark["ttl"] = str(cache["ttl"])
    put = F.create_map(F.lit("cache_control"), F.parse_json(F.lit(json.dumps(mark))))
    made = F.when(first > 0, F.transform(bare, lambda b, i: F.when(i + 1 == first, F.map_concat(b, put)).otherwise(b)))
    empty = F.map_concat(F.from_json(F.lit('{"type":"text","text":""}'), "map<string,variant>"), put)
    made = F.coalesce(made, F.concat(bare, F.array(empty)))
    if cache is not None:
        return made
    own = lambda b: F.try_element_at(b, F.lit("cache_control"))
    has = F.exists(blocks, lambda b: own(b).isNotNull() & ~F.is_variant_null(own(b)))
    return F.when(has, blocks).otherwise(made)


def render_anthropic(
    requests: DataFrame, model: str, temperature: float, limits: dict[str, int] | None = None, cache: dict | None = None, top_p: float | None = None, top_k: int | None = None, metadata: dict | None = None, overrides: dict | None = None,
    caches: dict[str, dict | None] | None = None,
) -> DataFrame:
    """requests (custom_id, messages, stop) as message-batch lines.

    The content of a message is a string, or a variant of a string or a list of strings
    and blocks, whose fields are kept. The first system message becomes system; later
    ones and empty messages are dropped, a blank role is a user's. cache: none marks the
    first text block of system unless a block has a mark; settings (type, ttl) put their
    own mark in any case, and enable_system_cache = False takes all marks off. caches:
    several of these by name, in place of cache; a request has a line for each, named in
    column cache, and its blocks are built once for all. overrides replace whole
    parameters, last of all.
    """
    plain = requests.schema["messages"].dataType.elementType["content"].dataType.simpleString() == "string"
    role = lambda m: F.lower(F.trim(F.coalesce(m["role"], F.lit(""))))
    said = F.transform("messages", lambda m: F.struct(F.when(role(m) == "", "user").otherwise(role(m)).alias("role"), F.coalesce(_blocks(m["content"], plain), F.array().cast("array<map<string,variant>>")).alias("content")))
    # a generated column is built once a row; a plain one would be built again in the filter and wherever it is named
    r = requests.where("custom_id is not null and custom_id <> ''").select("custom_id", "stop", F.explode(F.array(said)).alias("_said"))
    of_talk = lambda m: (m["role"] != "system") & (F.size(m["content"]) > 0)
    r = r.where(F.exists("_said", of_talk)).withColumn("_talk", F.filter("_said", of_talk))
    r = r.withColumn("_system", F.try_element_at(F.filter("_said", lambda m: (m["role"] == "system") & (F.size(m["content"]) > 0)), F.lit(1))["content"])
    r = r.withColumn("_bare", F.transform("_system", lambda b: F.map_filter(b, lambda k, v: k != "cache_control")))
    is_text = lambda b: F.coalesce(F.element_at(b, F.lit("type")).cast("string"), F.lit("text")) == "text"
    r = r.withColumn("_first", F.array_position(F.transform("_bare", is_text), True))
    system = lambda c: F.when(F.col("_system").isNotNull(), _marked(F.col("_system"), F.col("_bare"), F.col("_first"), c))
    every = F.array(*(F.struct(F.lit(name).alias("cache"), system(c).alias("system")) for name, c in (caches or {"": cache}).items()))
    r = r.select("custom_id", "stop", "_talk", F.explode(every).alias("_c")).select("custom_id", "stop", "_talk", "_c.cache", "_c.system")
    f = {"model": F.lit(model), "temperature": F.lit(float(temperature)), "messages": F.col("_talk")}
    if top_p is not None:
        f["top_p"] = F.lit(float(top_p))
    if top_k is not None:
        f["top_k"] = F.lit(int(top_k))
    f["system"] = F.col("system")
    f["stop_sequences"] = F.when(F.size("stop") > 0, F.col("stop"))
    f["max_tokens"] = token_limit(kind_of(F.col("custom_id")), _limits(limits), True)
    about = F.struct(*(c.alias(k) for k, c in (_metadata(metadata) | {"orig_custom_id": F.col("custom_id")}).items()))
    return r.select("custom_id", *(["cache"] if caches else []), F.to_json(F.struct("custom_id", _overridden(f, overrides).alias("params"), about.alias("metadata"))).alias("line"))


def safe_custom_id(requests: DataFrame, pos: str) -> DataFrame:
    """custom_id with safe_id: letters, digits, _ and -, 64 at most, and different for each row.

    Rows whose ids fall together get _1, _2, ... in order of pos. A suffixed id that is
    another row's own gets a digest of its id instead.
    """
    raw = F.col("custom_id")
    safe = F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_")
    safe = F.when(F.length(safe) > 64, F.concat(F.substring(safe, 1, 32), F.lit("_"), F.substring(F.sha2(raw, 256), 1, 16))).otherwise(safe)
    r = requests.withColumn("_safe", safe).withColumn("_n", F.row_number().over(Window.partitionBy("_safe").orderBy(pos)) - 1)
    suffix = F.concat(F.lit("_"), F.col("_n").cast("string"))
    base = F.rtrim(F.col("_safe"), F.lit("_"))
    r = r.withColumn("safe_id", F.when(F.col("_n") == 0, F.col("_safe")).otherwise(F.concat(F.substring(base, F.lit(1), F.lit(64) - F.length(suffix)), suffix)))
    clash = F.row_number().over(Window.partitionBy("safe_id").orderBy("_n", pos))
    return r.withColumn("_c", clash).withColumn("safe_id", F.when(F.col("_c") == 1, F.col("safe_id")).otherwise(F.substring(F.sha2(F.concat_ws(":", raw, F.col("_n").cast("string")), 256), 1, 64))).drop("_safe", "_n", "_c")


def remap_ids(results: DataFrame, id_map: DataFrame) -> DataFrame:
    """results (custom_id, ...) with the ids of id_map (provider_custom_id, orig_custom_id) put back."""
    m = id_map.select(F.col("provider_custom_id").alias("_p"), "orig_custom_id")
    r = results.withColumnRenamed("custom_id", "provider_custom_id")
    return r.join(m, F.col("provider_custom_id") == F.col("_p"), "left").withColumn("custom_id", F.coalesce("orig_custom_id", "provider_custom_id")).drop("_p", "orig_custom_id")


def oversized(requests: DataFrame, most: int, *keys: str) -> DataFrame:
    """Groups with more requests than a batch may hold."""
    return requests.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)


def render_equivalence(requests: DataFrame) -> DataFrame:
    """Per item, temp and sample: whether the system texts of the conditions differ and the user texts agree."""
    side = lambda c, x: F.max(F.when(F.col("condition") == c, F.sha1(x)))
    g = requests.groupBy("dataset", "id", "type", "temp", "sample_index").agg(side("control", "system").alias("cs"), side("treatment", "system").alias("ts"), side("control", "user").alias("cu"), side("treatment", "user").alias("tu"))
    return g.select("dataset", "id", "type", "temp", "sample_index", (F.col("cs") != F.col("ts")).alias("system_differs"), (F.col("cu") == F.col("tu")).alias("user_equal"))


def filter_condition(df: DataFrame, condition: str, temp: float, tolerance: float = 1e-6) -> DataFrame:
    return df.where((F.col("condition") == condition) & (F.abs(F.col("temp") - temp) <= tolerance))


def control_key(*fields: str) -> Column:
    """A digest of what makes control results the same: columns in order of their names."""
    return F.sha2(F.concat_ws("|", *(F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in sorted(fields))), 256)


def assign_control_producer(trials: DataFrame, pos: str = "trial_pos") -> DataFrame:
    """trials (control_key, ...) with role: the first of a key produces, the others reuse, and its producer."""
    w = Window.partitionBy("control_key").orderBy(pos)
    return trials.withColumn("role", F.when(F.row_number().over(w) == 1, "producer").otherwise("reuse")).withColumn("producer", F.first(pos).over(w))
