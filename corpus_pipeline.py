"""A corpus pipeline: quality, near-duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a
DataFrame; all but the last return the columns of docs. Columns that a stage adds for
itself start with __ep_ and are gone when it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import pieces, quality, secrets
from evalloom.llm.common import read, written
from evalloom.llm.jaccard import shingle_components
from evalloom.llm.mixing import mixed_sizes, n_words, with_copies


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go.

    Null and empty texts are scored like others; rows with one doc_id, or none, are judged each by its text.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return docs.withColumn("__ep_score", quality.score(F.col("text"), model)).where("__ep_score >= 0.3").drop("__ep_score")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Rows without doc_id have no group and stay; of rows with one doc_id all or none stay.
    """
    groups = shingle_components(docs.select("doc_id", "text"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__ep_id")).distinct()
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("__ep_id"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by [SECRET] and n_chars is counted again; every document stays.

    A text decides, not its doc_id: rows with one doc_id, or none, are masked each. Null texts stay null.
    """
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    findings, _ = secrets.scan(versions)
    found = findings.where("size(spans) > 0").groupBy("blob").agg(F.first("spans").alias("__ep_spans")).withColumnRenamed("blob", "__ep_blob")
    found = written(found, "secrets")
    masked = docs.join(found.hint("merge"), F.sha2(F.encode("text", "utf-8"), 256) == F.col("__ep_blob"), "left")
    text = F.when(F.col("__ep_spans").isNotNull(), secrets.masked(F.col("text"), F.col("__ep_spans"))).otherwise(F.col("text"))
    masked = masked.withColumn("text", text)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("__ep_spans").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times; documents without words go.

    Every row is a document of its own, whatever its doc_id. Which are taken follows from
    the content of all columns and, among equal rows, from their number.
    """
    cols = docs.columns
    content = [*(F.col(f"`{c}`").isNull() for c in cols), *(F.col(f"`{c}`") for c in cols)]
    keyed = docs.select("*", F.monotonically_increasing_id().alias("__ep_row"), F.xxhash64(F.lit(1), *content).alias("__ep_k1"), F.xxhash64(F.lit(2), *content).alias("__ep_k2"), n_words("text").alias("__ep_size"))
    keyed = written(keyed, "keyed")
    rows = with_copies(keyed.select("source", F.col("__ep_size").alias("size"), F.col("__ep_row").alias("row"), F.col("__ep_k1").alias("k1"), F.col("__ep_k2").alias("k2")), ["k1", "k2"])
    key = F.struct("k1", "k2", "copy").alias("doc_id")
    taken = mixed_sizes(rows.select(key, "source", "size", "row"), carried=("row",)).where("taken > 0")
    times = written(taken.select(F.col("row").alias("__ep_row"), (F.col("taken") / F.col("size")).cast("int").alias("__ep_n")), "times")
    out = keyed.join(times.hint("merge"), "__ep_row")
    return out.withColumn("__ep_i", F.explode(F.sequence(F.lit(1), F.col("__ep_n")))).select(*cols)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256, round_trip of each row; null for a null text, whatever the doc_id."""
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", mask_secrets),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode),
]

#: The classifier, the knapsack and the segmentation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
