"""Queries of preparation, request building and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import prepare, requests
from evalloom.plans import fixtures as X
from evalloom.plans.q_scores import _SPACE
from evalloom.plans.base import query

_CLEAN = lambda x: rf"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"
_PART = X._PART


def _docs(spark, sf_dir):
    w = F.filter(F.split("text", X.WORDS), lambda t: t != "")
    part = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    return X.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "source", part(1, 6).alias("head"), part(3, 3).alias("a1"), part(3, 2).alias("a2"))


_D = f"d AS (SELECT doc_id, text, source, {_PART(1, 6)} AS head, {_PART(3, 3)} AS a1, {_PART(3, 2)} AS a2 FROM documents WHERE text IS NOT NULL)"


@query("q_prepare_open", f"""WITH {_D} SELECT source AS dataset, doc_id::VARCHAR AS id, md5({_CLEAN("text")}) AS context, {_CLEAN("head")} AS question, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {_CLEAN("a1")} || '|' || {_CLEAN("a2")} END AS answers, doc_id % 4 = 0 OR doc_id % 3 = 0 AS is_unanswerable FROM d""")
def _(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("context"), F.col("head").alias("question"), F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("a1", "a2")).alias("answers"), (F.col("doc_id") % 3 == 0).alias("is_impossible"))
    return prepare.prepare_open(d).withColumns({"context": F.md5("context"), "answers": F.array_join("answers", "|")})


@query("q_alias_set", f"""WITH {_D} SELECT source AS dataset, CASE WHEN doc_id % 5 = 0 THEN md5(head) ELSE doc_id::VARCHAR END AS id, {_CLEAN("head")} AS question, array_to_string(list_sort(list_distinct(list_transform(list_filter([a1, a2, '', a1], lambda a: a <> ''), lambda a: {_CLEAN("a")}))), '|') AS answers FROM d""")
def _(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("source").alias("dataset"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("question_id"), F.col("head").alias("question"), F.col("a1").alias("value"), F.array(F.col("a2"), F.lit(""), F.col("a1")).alias("aliases"))
    return prepare.prepare_alias_set(d).withColumn("answers", F.array_join("answers", "|"))


@query("q_answer_list", f"""WITH {_D} SELECT source AS dataset, CASE WHEN doc_id % 5 = 0 THEN md5(head) ELSE doc_id::VARCHAR END AS id, {_CLEAN("head")} AS question, array_to_string(list_transform(list_filter([a2, '', a1], lambda a: a <> ''), lambda a: {_CLEAN("a")}), '|') AS answers FROM d""")
def _(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("source").alias("dataset"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("id"), F.col("head").alias("question"), F.array(F.col("a2"), F.lit(""), F.col("a1")).alias("answer"))
    return prepare.prepare_answer_list(d).withColumn("answers", F.array_join("answers", "|"))


@query("q_fallback_id", f"WITH {_D} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN source ELSE md5(head) END AS id FROM d")
def _(spark, sf_dir):
    d = _docs(spark, sf_dir)
    q, own = F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).otherwise(""), F.when(F.col("doc_id") % 3 == 1, F.col("source"))
    return d.select("doc_id", prepare.fallback_id(q, own, F.col("head")).alias("id"))


@query("q_seeded_sample", "SELECT doc_id, source FROM documents ORDER BY md5('2025|' || doc_id), doc_id LIMIT 100")
def _(spark, sf_dir):
    return prepare.seeded_sample(X.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


def _digest_sql(*columns: str) -> str:
    row = " || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n;')" for c in columns)
    return " || '-' || ".join(f"sum(('0x' || substr(sha256({row}), {1 + 15 * i}, 15))::UBIGINT)::VARCHAR" for i in range(3))


@query("q_manifest", f"SELECT source, count(*) AS n_rows, {_digest_sql('doc_id', 'source', 'text')} AS digest FROM documents GROUP BY source")
def _(spark, sf_dir):
    return prepare.dataset_manifest(X.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source")


@query("q_range_digests", f"""WITH d AS (SELECT doc_id, source, text FROM documents), l AS (SELECT *, unnest([0, 1, 2]) AS level FROM d)
SELECT source, level, floor(floor(doc_id / 64.0) / (16 ** level))::BIGINT AS range, count(*) AS n_rows, {_digest_sql('doc_id', 'source', 'text')} AS digest FROM l GROUP BY ALL""")
def _(spark, sf_dir):
    return prepare.range_digests(X.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", 64, "source")


@query("q_limit_first", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def _(spark, sf_dir):
    return prepare.limit_first(X.table(spark, sf_dir, "documents").select("source", "doc_id"), 5, "doc_id", "source")


@query("q_coalesce_fields", f"WITH {_D} SELECT CASE WHEN doc_id % 2 = 0 THEN source ELSE 'unknown' END AS dataset, CASE WHEN doc_id % 3 = 0 THEN 'q' || doc_id ELSE doc_id::VARCHAR END AS id, CASE WHEN doc_id % 7 = 1 THEN a1 ELSE head END AS question, doc_id AS pos FROM d WHERE doc_id % 7 <> 0 AND CASE WHEN doc_id % 7 = 1 THEN a1 ELSE head END <> ''")
def _(spark, sf_dir):
    i = F.col("doc_id")
    d = _docs(spark, sf_dir).select(i.alias("pos"), F.when(i % 2 == 0, "").alias("dataset"), F.when(i % 2 == 0, F.col("source")).alias("collection"), F.when(i % 3 == 0, F.concat(F.lit("q"), i.cast("string"))).alias("qid"), F.when(i % 7 > 1, F.col("head")).alias("question"), F.when(i % 7 == 1, F.col("a1")).alias("prompt"))
    return requests.coalesce_fields(d)


_REQ = f"""WITH {X.ITEMS}, plan AS (SELECT * FROM (VALUES (0.0::DOUBLE, 1), (0.7::DOUBLE, 3)) t(temp, k)),
req AS (SELECT items.dataset, items.item_id AS id, items.type, context, temp, sample_index, condition, concat_ws('|', dataset, item_id, condition, printf('%.1f', temp), sample_index, type) AS custom_id
  FROM items, plan, (SELECT unnest([0, 1, 2]) AS sample_index), (SELECT unnest(['control', 'treatment']) AS condition) WHERE sample_index < k)"""


def _requests(spark, sf_dir, dealt=False):
    """dealt: items without their texts to all tasks, where a request costs more than reading its item."""
    items = X.text_items(spark, sf_dir).select("dataset", F.col("item_id").alias("id"), "type", "context")
    if dealt:
        items = items.drop("context").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dataset", "id")
    return requests.request_matrix(items, {0.0: 1, 0.7: 3})


@query("q_request_matrix", f"{_REQ} SELECT custom_id, dataset, id, type, temp, sample_index, condition FROM req")
def _(spark, sf_dir):
    return _requests(spark, sf_dir).select("custom_id", "dataset", "id", "type", "temp", "sample_index", "condition")


@query("q_assemble_user", f"{_REQ} SELECT custom_id, md5(CASE WHEN type = 'open' THEN 'Answer.' || chr(10) || chr(10) || 'CONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'QUESTION:' || chr(10) || id ELSE 'Answer.' || chr(10) || chr(10) || 'QUESTION:' || chr(10) || id END) AS digest FROM req")
def _(spark, sf_dir):
    user = requests.assemble_user(F.col("type"), F.lit("Answer."), F.col("context"), F.col("id"))
    return _requests(spark, sf_dir).select("custom_id", F.md5(user).alias("digest"))


@query("q_dedupe_ids", f"WITH {X.PREDS} SELECT custom_id, l_partkey FROM preds")
def _(spark, sf_dir):
    raw = X.table(spark, sf_dir, "lineitem").selectExpr(*X._split_fields("string")).withColumn("custom_id", F.concat_ws("|", "dataset", "item_id", "condition", "temp_s", "sample_index", "type"))
    return requests.dedupe_custom_id(raw, *X._ORDER.split(", ")).select("custom_id", "l_partkey")


@query("q_skipped_ids", f"WITH {X.PREDS} SELECT temp_s, condition, count(*) AS n_rows, count(DISTINCT custom_id) AS n_ids, count(*) - count(DISTINCT custom_id) AS skipped FROM raw GROUP BY temp_s, condition")
def _(spark, sf_dir):
    raw = X.table(spark, sf_dir, "lineitem").selectExpr(*X._split_fields("string")).withColumn("custom_id", F.concat_ws("|", "dataset", "item_id", "condition", "temp_s", "sample_index", "type"))
    return requests.skipped_ids(raw, "temp_s", "condition")


_NUM = "numbered AS (SELECT *, row_number() OVER (PARTITION BY condition, temp ORDER BY item_key, type, sample_index) AS pos FROM preds)"
_SHARDS = f"WITH {X.PREDS}, {_NUM}, sh AS (SELECT *, ((pos - 1) // 4000)::INTEGER AS shard FROM numbered)"


def _numbered(spark, sf_dir):
    p = X.predictions(spark, sf_dir).select("custom_id", "item_key", "type", "sample_index", "condition", "temp")
    return requests.numbered(p, ["condition", "temp"], ["item_key", "type", "sample_index"])


@query("q_shards", f"{_SHARDS} SELECT custom_id, pos, shard, CASE WHEN shard > 0 THEN '_part' || lpad((shard + 1)::VARCHAR, 2, '0') ELSE '' END AS suffix FROM sh")
def _(spark, sf_dir):
    return requests.assign_shard(_numbered(spark, sf_dir), 4000).select("custom_id", F.col("pos").cast("long").alias("pos"), "shard", "suffix")


@query("q_shard_manifest", f"{_SHARDS} SELECT condition, temp, shard, count(*) AS lines, sum(strlen(custom_id) + 1)::BIGINT AS bytes, sha256(string_agg(custom_id, chr(10) ORDER BY pos) || chr(10)) AS sha256 FROM sh GROUP BY condition, temp, shard")
def _(spark, sf_dir):
    s = requests.assign_shard(_numbered(spark, sf_dir), 4000)
    return requests.shard_manifest(s, "custom_id", "pos", "condition", "temp", "shard")


_MANIFEST = "m AS (SELECT l_orderkey AS name, 'set' || l_orderkey % 3 AS prompt_set, CASE WHEN l_linenumber % 2 = 0 THEN 'treatment' ELSE 'control' END AS condition, (l_partkey % 5) / 10.0::DOUBLE + CASE l_orderkey % 4 WHEN 1 THEN 2e-7 WHEN 3 THEN 4e-6 ELSE 0 END AS temp, l_quantity::DOUBLE AS lines FROM lineitem)"


@query("q_stale_shards", f"WITH {_MANIFEST}, g AS (SELECT *, prompt_set = 'set1' AND condition = 'control' AND abs(temp - 0.3) < 1e-6 AS stale FROM m) SELECT name, prompt_set, condition, round(temp, 9) AS temp, lines FROM g WHERE NOT stale OR name % 4 = 0")
def _(spark, sf_dir):
    m = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("name"), F.concat(F.lit("set"), (F.col("l_orderkey") % 3).cast("string")).alias("prompt_set"), F.when(F.col("l_linenumber") % 2 == 0, "treatment").otherwise("control").alias("condition"), ((F.col("l_partkey") % 5) / 10.0 + F.when(F.col("l_orderkey") % 4 == 1, 2e-7).when(F.col("l_orderkey") % 4 == 3, 4e-6).otherwise(0.0)).alias("temp"), F.col("l_quantity").cast("double").alias("lines"))
    fresh = m.where("prompt_set = 'set1' and condition = 'control' and abs(temp - 0.3) < 1e-9 and name % 4 = 0")
    return requests.prune_stale_shards(m, fresh).withColumn("temp", F.round("temp", 9))


@query("q_split_parts", f"WITH {X.PREDS}, n AS (SELECT row_number() OVER (ORDER BY item_key, custom_id) AS pos, (SELECT ceil(count(*) / 7.0)::BIGINT FROM preds) AS chunk FROM preds), p AS (SELECT ((pos - 1) // chunk + 1)::INTEGER AS part, count(*) AS n FROM n GROUP BY 1) SELECT part, n FROM p")
def _(spark, sf_dir):
    p = requests.numbered(X.predictions(spark, sf_dir).select("custom_id", "item_key"), [], ["item_key", "custom_id"])
    return requests.part_sizes(requests.split_parts(p, 7), 7)


@query("q_guard_batch", f"WITH {X.PREDS} SELECT dataset, condition, count(*) AS n FROM preds GROUP BY dataset, condition HAVING count(*) > 7000")
def _(spark, sf_dir):
    return requests.oversized(X.predictions(spark, sf_dir), 7000, "dataset", "condition")


@query("q_token_limit", f"{_REQ} SELECT custom_id, CASE type WHEN 'open' THEN 1024 ELSE 256 END AS own, CASE type WHEN 'open' THEN 64 ELSE 64 END AS fallback FROM req")
def _(spark, sf_dir):
    limits = F.create_map(F.lit("open_book"), F.lit(1024), F.lit("closed"), F.lit(256))
    other = F.create_map(F.lit("some"), F.lit(64))
    kind = requests.kind_of(F.col("custom_id"))
    return _requests(spark, sf_dir).select("custom_id", requests.token_limit(kind, limits).alias("own"), requests.token_limit(kind, other, True).alias("fallback"))


def _talks(spark, sf_dir):
    r = _requests(spark, sf_dir)
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.cast("string").alias("content"))
    messages = F.array(m("system", F.concat(F.lit("Be brief: "), F.col("condition"))), m("", F.col("id")), m("system", F.lit("later")), m("assistant", F.lit(None)))
    return r.select("custom_id", messages.alias("messages"), F.when(F.col("sample_index") == 1, F.array(F.lit("END"))).otherwise(F.array().cast("array<string>")).alias("stop"))


@query("q_openai_req", f"{_REQ} SELECT custom_id, 'm1' AS model, 0.5::DOUBLE AS temperature, CASE type WHEN 'open' THEN 1024 ELSE 256 END AS max_output_tokens, id AS said, CASE WHEN sample_index = 1 THEN 'END' END AS stop, 'r1' AS run FROM req")
def _(spark, sf_dir):
    out = requests.render_openai(_talks(spark, sf_dir), "m1", temperature=0.5, limits={"open_book": 1024, "default": 256}, metadata={"run": "r1"})
    b = F.from_json("line", "custom_id string, url string, body struct<model:string,temperature:double,max_output_tokens:int,input:array<struct<role:string,content:string>>,stop:array<string>,metadata:struct<run:string>>")
    return out.withColumn("b", b).select("custom_id", "b.body.model", "b.body.temperature", "b.body.max_output_tokens", F.col("b.body.input")[1]["content"].alias("said"), F.try_element_at("b.body.stop", F.lit(1)).alias("stop"), "b.body.metadata.run")


@query("q_anthropic_req", f"{_REQ} SELECT custom_id, 'm2' AS model, 'Be brief: ' || condition AS system, 'ephemeral' AS cache, 1::BIGINT AS n_messages, 'user' AS role, id AS said, CASE WHEN sample_index = 1 THEN 'END' END AS stop, 1024 AS max_tokens, custom_id AS orig FROM req")
def _(spark, sf_dir):
    out = requests.render_anthropic(_talks(spark, sf_dir), "m2", 0.5)
    b = F.from_json("line", "params struct<model:string,max_tokens:int,stop_sequences:array<string>,system:array<struct<text:string,cache_control:struct<type:string>>>,messages:array<struct<role:string,content:array<struct<text:string>>>>>, metadata struct<orig_custom_id:string>")
    p = out.withColumn("b", b).withColumn("p", F.col("b.params"))
    return p.select("custom_id", "p.model", F.col("p.system")[0]["text"].alias("system"), F.col("p.system")[0]["cache_control"]["type"].alias("cache"), F.size("p.messages").cast("long").alias("n_messages"), F.col("p.messages")[0]["role"].alias("role"), F.col("p.messages")[0]["content"][0]["text"].alias("said"), F.try_element_at("p.stop_sequences", F.lit(1)).alias("stop"), "p.max_tokens", F.col("b.metadata.orig_custom_id").alias("orig"))


@query("q_openai_overrides", f"{_REQ} SELECT custom_id, 'm9' AS model, 1.5::DOUBLE AS temperature, true AS no_top_p, 'low' AS effort, CASE type WHEN 'open' THEN 1024 ELSE 256 END AS max_tokens, id AS said FROM req")
def _(spark, sf_dir):
    over = {"model": "m9", "temperature": 1.5, "top_p": 0.1, "reasoning": {"effort": "low"}}
    out = requests.render_openai(_talks(spark, sf_dir), "m1", "/v1/chat/completions", 0.5, 0.9, {"open_book": 1024, "default": 256}, overrides=over, allow_top_p=False)
    b = F.from_json("line", "body struct<model:string,temperature:double,top_p:double,max_tokens:int,messages:array<struct<content:string>>,reasoning:struct<effort:string>>")
    return out.withColumn("b", b["body"]).select("custom_id", "b.model", "b.temperature", F.col("b.top_p").isNull().alias("no_top_p"), "b.reasoning.effort", "b.max_tokens", F.col("b.messages")[1]["content"].alias("said"))


#: What is marked by default, with own settings, and with the cache off: of every third request the second block has a mark of its own.
_CACHES = {"default": None, "own": {"type": "kept", "ttl": "1h"}, "off": {"enable_system_cache": False}}
_MARKS = {"default": "CASE WHEN sample_index = 2 THEN '|mine' ELSE 'ephemeral|' END", "own": "'kept1h|'", "off": "'|'"}


@query("q_anthropic_blocks", f"{_REQ} " + " UNION ALL ".join(f"SELECT custom_id, '{c}' AS cache, {m} AS marks, 'Be brief: ' || condition || chr(10) || 'b' AS system, id || chr(10) || 'more' AS said, 2::BIGINT AS n_messages, 7 AS top_k, 1.0::DOUBLE AS temperature, '1' AS run FROM req" for c, m in _MARKS.items()))
def _(spark, sf_dir):
    r = _requests(spark, sf_dir, dealt=True)
    block = lambda text, mark: F.struct(text.alias("text"), F.when(mark, F.struct(F.lit("mine").alias("type"))).alias("cache_control"))
    no = F.lit(False)
    m = lambda role, content: F.to_json(F.struct(F.lit(role).alias("role"), content.alias("content")))
    system = F.array(block(F.concat(F.lit("Be brief: "), F.col("condition")), no), block(F.lit("b"), F.col("sample_index") == 2))
    messages = F.array(m("system", system), m(" ", F.array(block(F.col("id"), no), block(F.lit("more"), no))), m("assistant", F.lit(None).cast("string")), m("assistant", F.lit("ok")))
    talks = r.select("custom_id", F.from_json(F.concat(F.lit("["), F.array_join(messages, ","), F.lit("]")), "array<struct<role:string,content:variant>>").alias("messages"), F.array().cast("array<string>").alias("stop"))
    params = "params struct<temperature:double,top_k:int,system:array<struct<text:string,cache_control:struct<type:string,ttl:string>>>,messages:array<struct<content:array<struct<text:string>>>>>, metadata struct<run:string>"
    out = requests.render_anthropic(talks, "m2", 0.5, caches=_CACHES, top_k=7, metadata={"run": 1}, overrides={"temperature": 1.0})
    p = out.select("custom_id", "cache", F.from_json("line", params).alias("b"))
    mark = lambda s: F.concat_ws("", s["cache_control"]["type"], s["cache_control"]["ttl"])
    texts = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), "\n")
    return p.select("custom_id", "cache", F.array_join(F.transform("b.params.system", mark), "|").alias("marks"), texts(F.col("b.params.system")).alias("system"), texts(F.col("b.params.messages")[0]["content"]).alias("said"), F.size("b.params.messages").cast("long").alias("n_messages"), "b.params.top_k", "b.params.temperature", "b.metadata.run")


@query("q_validate_manifest", """WITH d AS (SELECT doc_id % 5 AS part, doc_id, doc_id // 64 AS r FROM documents), m AS (SELECT part, count(*) AS n_rows FROM d WHERE part <> 3 AND NOT (part = 2 AND doc_id % 2 = 0) GROUP BY part), f AS (SELECT part, count(*) AS found_rows FROM d WHERE part <> 4 GROUP BY part),
c AS (SELECT part, string_agg(r::VARCHAR, ',' ORDER BY r) AS ranges FROM (SELECT DISTINCT part, r FROM d WHERE part = 1 AND r % 3 = 1 OR part = 2 AND doc_id % 2 = 0) GROUP BY part)
SELECT part, n_rows, found_rows, CASE part WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN ranges IS NULL THEN 'ok' ELSE 'digest' END WHEN 2 THEN 'rows' WHEN 3 THEN 'unexpected' ELSE 'missing' END AS status, CASE WHEN part IN (1, 2) THEN ranges END AS ranges FROM m FULL JOIN f USING (part) LEFT JOIN c USING (part)""")
def _(spark, sf_dir):
    """Sets of documents with other texts in some ranges of ids, without some rows, missing and new ones; of the first two the ranges are named."""
    d = X.table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    other = (F.col("part") == 1) & (F.floor(F.col("doc_id") / 64) % 3 == 1)
    before = d.where("part <> 3 and not (part = 2 and doc_id % 2 = 0)").withColumn("text", F.when(other, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    now = d.where("part <> 4")
    trees = [prepare.range_digests(x, "doc_id", 64, "part") for x in (before, now)]
    changed = prepare.changed_ranges(*trees, "part").groupBy("part").agg(F.array_join(F.sort_array(F.collect_list("range")), ",").alias("ranges"))  # a set's changed ranges
    status = prepare.validate_manifest(now, prepare.dataset_manifest(before, "part"), "part")
    return status.join(changed, "part", "left").withColumn("ranges", F.when(F.col("status").isin("digest", "rows"), F.col("ranges")))


_SAFE = "regexp_replace({0}, '[^A-Za-z0-9_-]', '_', 'g')"
_LONG = "CASE WHEN length({0}) > 64 THEN substr({0}, 1, 32) || '_' || substr(sha256(raw), 1, 16) ELSE {0} END"


@query("q_safe_id", f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '|' || doc_id % 50 WHEN doc_id % 3 = 1 THEN source || '/' || doc_id % 50 ELSE repeat('x', 60) || '|' || doc_id END AS raw FROM documents),
s AS (SELECT *, {_LONG.format(_SAFE.format("raw"))} AS safe FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY doc_id) - 1 AS n FROM s)
SELECT doc_id, CASE WHEN n = 0 THEN safe ELSE substr(rtrim(safe, '_'), 1, 64 - length('_' || n)) || '_' || n END AS safe_id FROM n""")
def _(spark, sf_dir):
    i, s = F.col("doc_id"), F.col("source")
    raw = F.when(i % 3 == 0, F.concat(s, F.lit("|"), (i % 50).cast("string"))).when(i % 3 == 1, F.concat(s, F.lit("/"), (i % 50).cast("string"))).otherwise(F.concat(F.lit("x" * 60 + "|"), i.cast("string")))
    return requests.safe_custom_id(X.table(spark, sf_dir, "documents").select("doc_id", raw.alias("custom_id")), "doc_id").select("doc_id", "safe_id")


@query("q_remap", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'p' || doc_id ELSE source || '|' || doc_id END AS custom_id, 'p' || doc_id AS provider_custom_id FROM documents")
def _(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    p = F.concat(F.lit("p"), F.col("doc_id").cast("string"))
    ids = d.where("doc_id % 4 <> 0").select(p.alias("provider_custom_id"), F.concat_ws("|", "source", F.col("doc_id").cast("string")).alias("orig_custom_id"))
    return requests.remap_ids(d.select("doc_id", p.alias("custom_id")), ids).select("doc_id", "custom_id", "provider_custom_id")


@query("q_render_eq", f"{_REQ} SELECT dataset, id, type, temp, sample_index, true AS system_differs, sample_index <> 2 AS user_equal FROM req WHERE condition = 'control'")
def _(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn("system", F.concat(F.lit("s "), "condition")).withColumn("user", F.when(F.col("sample_index") == 2, F.concat("id", "condition")).otherwise(F.col("id")))
    return requests.render_equivalence(r)


@query("q_control_key", f"WITH {X.PREDS} SELECT custom_id, sha256(concat_ws('|', 'dataset=' || dataset, 'temp_s=' || temp_s, 'type=' || type)) AS key FROM preds")
def _(spark, sf_dir):
    return X.predictions(spark, sf_dir).select("custom_id", requests.control_key("type", "dataset", "temp_s").alias("key"))


@query("q_control_reuse", "SELECT o_orderkey AS trial_pos, CASE WHEN row_number() OVER w = 1 THEN 'producer' ELSE 'reuse' END AS role, first(o_orderkey) OVER w AS producer FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def _(spark, sf_dir):
    t = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_pos"), F.col("o_custkey").alias("control_key"))
    return requests.assign_control_producer(t).drop("control_key")


@query("q_filter_condition", f"WITH {X.PREDS} SELECT custom_id FROM preds WHERE condition = 'treatment' AND temp = 0.7")
def _(spark, sf_dir):
    return requests.filter_condition(X.predictions(spark, sf_dir), "treatment", 0.7000001).select("custom_id")
