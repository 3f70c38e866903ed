"""The registered queries: each operator over its whole table, in the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, pieces, runs, secrets, urls
from .common import read, written
from .embeddings import near_duplicates
from .fingerprints import fingerprints
from .html import extracted
from .jaccard import shingle_components
from .mixing import mixed_documents
from .quality import scored
from .substring import remove_repeats


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"), F.col("longest").alias("longest_level"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with a ledger between them: about half of the documents come first; the second run over all of them scans only blobs that the first has not seen."""
    docs = read(spark, sf_dir, "documents")
    early = F.coalesce(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8", F.lit(False))
    versions = docs.select(F.col("doc_id").alias("path"), F.when(early, 1).otherwise(2).alias("version"), F.col("text").alias("content"))
    _, ledger = secrets.scan(versions.where("version = 1"))
    ledger = written(ledger, "ledger")
    findings, _ = secrets.scan(versions, ledger=ledger)
    known = ledger.select(F.col("blob").alias("known_blob")).distinct()
    findings = findings.join(known, F.col("blob") == F.col("known_blob"), "left")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return findings.select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(secrets.span_text(base), "utf-8"), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
        F.col("known_blob").isNotNull().alias("known"),
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(read(spark, sf_dir, "documents"), pieces.MODEL)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.3)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(read(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3, seed=2025)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(read(spark, sf_dir, "documents"), k=5, percent=80)


def _list_entries(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages themselves: some are blocked, taken off and blocked again, some allowed."""
    h = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    hosts = pages.select(urls.host_of(F.col("url")).alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n")).select("host", h.alias("h"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1)
    part = lambda where, pattern, action, n: hosts.where(where).select(pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("listed"))
    return (
        part("h % 3 = 0", F.col("host"), "block", F.col("h") % 200)
        .union(part("h % 3 = 0", F.col("host"), "remove", F.col("h") % 200 + 30 + F.col("h") % 50))
        .union(part("h % 6 = 0", F.col("host"), "block", F.col("h") % 200 + 90))
        .union(part("h % 7 = 0", F.col("host"), "allow", F.col("h") % 365))
        .union(part("h % 5 = 0", domain, "block", F.col("h") % 300))
    ).where("pattern <> ''")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))
    out = urls.judged(pages.select(F.col("page_id").alias("id"), "url", fetched.alias("fetched")), _list_entries(pages))
    return out.select(F.col("id").alias("page_id"), "url", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", "pattern", F.col("listed").cast("string").alias("listed"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.decoded(byte_bpe.encoded(read(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.found_runs(read(spark, sf_dir, "documents"), words=24, exponent=3, edit=runs.planted))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
  DATE '2024-01-01' + ((page_id % 365 + 365) % 365)::INTEGER AS fetched FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM p WHERE host <> ''),
e AS (SELECT host AS pattern, 'block' AS action, h % 200 AS d FROM h WHERE h % 3 = 0
  UNION ALL SELECT host, 'remove', h % 200 + 30 + h % 50 FROM h WHERE h % 3 = 0
  UNION ALL SELECT host, 'block', h % 200 + 90 FROM h WHERE h % 6 = 0
  UNION ALL SELECT host, 'allow', h % 365 FROM h WHERE h % 7 = 0
  UNION ALL SELECT regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), 'block', h % 300 FROM h WHERE h % 5 = 0),
one AS (SELECT pattern, d, max_by(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action FROM e WHERE pattern <> '' GROUP BY pattern, d),
iv AS (SELECT pattern, action, DATE '2024-01-01' + d::INTEGER AS f, DATE '2024-01-01' + (lead(d) OVER (PARTITION BY pattern ORDER BY d))::INTEGER AS t FROM one),
m AS (SELECT p.page_id, max_by({'p': iv.pattern, 'a': iv.action, 'f': iv.f}, length(iv.pattern)) AS m FROM p JOIN iv
  ON (p.host = iv.pattern OR ends_with(p.host, '.' || iv.pattern)) AND iv.action <> 'remove' AND p.fetched >= iv.f AND (iv.t IS NULL OR p.fetched < iv.t) GROUP BY p.page_id)
SELECT p.page_id, p.url, p.host, p.fetched::VARCHAR AS fetched, coalesce(m.m.a = 'block', false) AS blocked, m.m.p AS pattern, m.m.f::VARCHAR AS listed
FROM p LEFT JOIN m USING (page_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_secret_scans": op2_secret_scans,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_source_mixing": op5_source_mixing,
    "op6_html_extraction": op6_html_extraction,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_url_filters": op9_url_filters,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES: dict[str, str] = {"op2_secret_scans": secrets.ORACLE, "op9_url_filters": OP9_SQL}
