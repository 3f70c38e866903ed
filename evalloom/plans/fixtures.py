"""Views over the driver's tables that stand in for experiment data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.operators.score import by_item

WORDS = r"[ \n\t]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------- scored predictions from lineitem

_FIELDS = """
  CASE l_orderkey % 3 WHEN 0 THEN 'squad_v2' WHEN 1 THEN 'triviaqa' ELSE 'nq_open' END AS dataset,
  cast(l_orderkey AS {string}) AS item_id,
  CASE WHEN l_linenumber % 2 = 0 THEN 'treatment' ELSE 'control' END AS condition,
  CASE WHEN l_orderkey % 2 = 0 THEN '0.0' ELSE '0.7' END AS temp_s,
  cast(floor(l_linenumber / 2.0) AS int) AS sample_index,
  CASE WHEN l_orderkey % 3 = 0 THEN 'open' ELSE 'closed' END AS type,
  cast(l_returnflag = 'R' AS int) * 1.0D AS em,
  cast(l_discount AS double) * 10 AS f1,
  cast(l_linestatus = 'O' AND l_partkey % 4 = 0 AS int) * 1.0D AS abstained,
  cast(l_returnflag = 'A' AS int) * 1.0D AS false_answer,
  cast(l_tax > 0.04 AS int) * 1.0D AS unsupported,
  cast(l_quantity AS bigint) AS prompt_tokens, cast(floor(l_extendedprice / 1000) AS bigint) AS completion_tokens,
  l_partkey, l_suppkey, l_extendedprice, l_shipdate"""

_ORDER = "l_partkey, l_suppkey, l_extendedprice, l_shipdate, prompt_tokens, f1, unsupported, em, abstained"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored prediction for each custom_id."""
    raw = table(spark, sf_dir, "lineitem").selectExpr(*_split_fields("string"))
    raw = raw.withColumn("custom_id", F.concat_ws("|", "dataset", "item_id", "condition", "temp_s", "sample_index", "type"))
    raw = by_item(raw.withColumn("item_key", F.concat_ws("|", "dataset", "item_id")))
    first = F.row_number().over(Window.partitionBy("item_key", "custom_id").orderBy(*_ORDER.split(", ")))
    return raw.withColumn("n", first).where("n = 1").drop("n").withColumn("temp", F.col("temp_s").cast("double"))


def _split_fields(string: str) -> list[str]:
    out, depth, held = [], 0, ""
    for c in _FIELDS.format(string=string):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(held.strip())
            held = ""
        else:
            held += c
    return [*out, held.strip()]


METRICS = ("em", "f1", "abstain_rate", "false_answer_rate", "unsupported_rate")


def per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalloom.operators.score import aggregate_replicates

    p = predictions(spark, sf_dir)
    return aggregate_replicates(p)


PREDS = f"""raw AS (SELECT *, concat_ws('|', dataset, item_id, condition, temp_s, sample_index, type) AS custom_id FROM (SELECT {_FIELDS.format(string="varchar").replace("1.0D", "1.0::DOUBLE")} FROM lineitem)),
preds AS (SELECT *, cast(temp_s AS double) AS temp, dataset || '|' || item_id AS item_key FROM raw
  QUALIFY row_number() OVER (PARTITION BY custom_id ORDER BY {_ORDER}) = 1)"""

PER_ITEM = PREDS + """,
per_item AS (SELECT item_key, type, condition, temp, avg(em) AS em, CASE WHEN type = 'open' THEN avg(f1) END AS f1, avg(abstained) AS abstain_rate,
  CASE WHEN type = 'open' THEN avg(false_answer) END AS false_answer_rate, CASE WHEN type = 'open' THEN avg(unsupported) END AS unsupported_rate,
  coalesce(stddev_samp(em), 0) AS em_std, count(*) AS k FROM preds GROUP BY item_key, type, condition, temp)"""

PAIRS = PER_ITEM + """,
pairs AS (SELECT item_key, type, temp, split_part(item_key, '|', 1) AS dataset, """ + ", ".join(
    f"max(CASE WHEN condition = '{c}' THEN {m} END) AS {p}_{m}" for c, p in (("control", "c"), ("treatment", "t")) for m in METRICS
) + """ FROM per_item GROUP BY item_key, type, temp HAVING count(DISTINCT condition) = 2),
deltas AS (""" + " UNION ALL ".join(
    f"SELECT item_key, type, temp, dataset, '{m}' AS metric, t_{m} - c_{m} AS delta FROM pairs WHERE t_{m} IS NOT NULL AND c_{m} IS NOT NULL" + (" AND type = 'open'" if m in ("f1", "false_answer_rate", "unsupported_rate") else "")
    for m in METRICS
) + ")"


# ------------------------------------------------------------------ answers from texts

def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open items from documents, closed ones from benchmark: dataset, item_id, type, context, answers, is_unanswerable, off."""
    w = F.filter(F.split("text", WORDS), lambda t: t != "")
    part = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    answers, off = F.array(part(3, 3), part(3, 2)).alias("answers"), part(10, 3).alias("off")
    d = table(spark, sf_dir, "documents").where("text is not null")
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    o = d.select(F.lit("open").alias("type"), F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("context"), answers, (F.col("doc_id") % 3 == 0).alias("is_unanswerable"), off)
    c = b.select(F.lit("closed").alias("type"), F.lit("bench").alias("dataset"), F.col("item_id").cast("string").alias("item_id"), F.lit(None).cast("string").alias("context"), answers, F.lit(False).alias("is_unanswerable"), off)
    return o.union(c).withColumn("item_key", F.concat_ws("|", "dataset", "item_id"))


def text_predictions(items: DataFrame) -> DataFrame:
    """Four answers for each item: right, abstaining in two ways, longer, or off."""
    p = items.withColumn("condition", F.explode(F.array(F.lit("control"), F.lit("treatment")))).withColumn("sample_index", F.explode(F.array(F.lit(0), F.lit(1))))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", "type", "dataset", "item_id", "condition", F.col("sample_index").cast("string"))), 1, 4), 16, 10).cast("int") % 5
    first = F.col("answers")[0]
    text = F.when(h == 0, first).when(h == 1, "I don't know.").when(h == 2, "It is unknown").when(h == 3, F.concat(first, F.lit(" the extra words"))).otherwise(F.col("off"))
    return p.select("type", "dataset", "item_id", "item_key", "condition", "sample_index", F.lit(0.0).alias("temp"), text.alias("response_text"))


_W = "list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda t: t <> '')"
_PART = lambda i, n: f"array_to_string(list_slice({_W}, {i}, {i + n - 1}), ' ')"
ITEMS = f"""items AS (SELECT *, dataset || '|' || item_id AS item_key FROM (
  SELECT 'open' AS type, source AS dataset, doc_id::VARCHAR AS item_id, text AS context, [{_PART(3, 3)}, {_PART(3, 2)}] AS answers, doc_id % 3 = 0 AS is_unanswerable, {_PART(10, 3)} AS off FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'closed', 'bench', item_id::VARCHAR, NULL, [{_PART(3, 3)}, {_PART(3, 2)}], false, {_PART(10, 3)} FROM benchmark WHERE text IS NOT NULL))"""
TEXT_PREDS = ITEMS + """,
crossed AS (SELECT * FROM items, (SELECT unnest(['control', 'treatment']) AS condition), (SELECT unnest([0, 1]) AS sample_index)),
hashed AS (SELECT *, ('0x' || substr(md5(concat_ws('|', type, dataset, item_id, condition, sample_index)), 1, 4))::INTEGER % 5 AS h FROM crossed),
tpreds AS (SELECT type, dataset, item_id, item_key, condition, sample_index, 0.0::DOUBLE AS temp,
  CASE h WHEN 0 THEN answers[1] WHEN 1 THEN 'I don''t know.' WHEN 2 THEN 'It is unknown' WHEN 3 THEN answers[1] || ' the extra words' ELSE off END AS response_text FROM hashed)"""
