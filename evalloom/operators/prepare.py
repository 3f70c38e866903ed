"""Raw question sets made into items."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.text import clean_text, first_filled


def _clean_list(xs: Column) -> Column:
    return F.transform(xs, clean_text)


def prepare_open(df: DataFrame) -> DataFrame:
    """df (dataset, id, context, question, answers, is_impossible) as open items."""
    answers = _clean_list(F.coalesce("answers", F.array().cast("array<string>")))
    none = F.coalesce("is_impossible", F.lit(False)) | (F.size(answers) == 0)
    return df.select("dataset", "id", clean_text(F.col("context")).alias("context"), clean_text(F.col("question")).alias("question"), answers.alias("answers"), none.alias("is_unanswerable"))


def prepare_alias_set(df: DataFrame) -> DataFrame:
    """df (dataset, question_id, question, value, aliases) as closed items: sorted different answers."""
    every = F.concat(F.array("value"), F.coalesce("aliases", F.array().cast("array<string>")))
    answers = F.array_sort(F.array_distinct(_clean_list(F.filter(every, lambda a: a.isNotNull() & (a != "")))))
    return df.select("dataset", fallback_id(F.col("question_id"), F.lit(None).cast("string"), F.col("question")).alias("id"), clean_text(F.col("question")).alias("question"), answers.alias("answers"))


def prepare_answer_list(df: DataFrame) -> DataFrame:
    """df (dataset, id, question, answer: array) as closed items: answers in order, empty ones dropped."""
    answers = _clean_list(F.filter(F.coalesce("answer", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != "")))
    return df.select("dataset", fallback_id(F.lit(None).cast("string"), F.col("id"), F.col("question")).alias("id"), clean_text(F.col("question")).alias("question"), answers.alias("answers"))


def fallback_id(question_id: Column, own_id: Column, question: Column) -> Column:
    return F.coalesce(first_filled(question_id, own_id), F.md5(F.coalesce(question, F.lit(""))))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 2025) -> DataFrame:
    """n rows in order of a seeded hash of a key: the same whatever the partitions."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(h, key).limit(n)


#: Hexadecimal digits of a row's SHA-256 that each of three sums takes: 180 bits in all.
_DIGITS = 15


def row_sums(df: DataFrame, columns: list[str]) -> list[Column]:
    """Three sums over rows that say which rows there are, however they are ordered or dealt.

    A row is written column by column, null as n; and a value as its length and itself, so
    that no two different rows are written alike. Sums of parts add up to those of the whole.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    row = F.concat(*(F.coalesce(F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n;")) for c in columns))
    digest = F.sha2(F.encode(row, "utf-8"), 256)
    part = lambda i: F.conv(F.substring(digest, 1 + _DIGITS * i, _DIGITS), 16, 10).cast("decimal(38,0)")
    return [F.sum(part(i)).alias(f"s{i}") for i in range(3)]


def _digest() -> Column:
    return F.concat_ws("-", *(F.col(f"s{i}").cast("string") for i in range(3))).alias("digest")


def dataset_manifest(df: DataFrame, *keys: str) -> DataFrame:
    """Rows and a digest of 180 bits of their contents that doesn't depend on their order."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *row_sums(df, df.columns)).select(*keys, "n_rows", _digest())


def range_digests(df: DataFrame, key: str, width: int, *keys: str, fanout: int = 16, levels: int = 3) -> DataFrame:
    """A tree of digests over ranges of an integer key: (keys, level, range, n_rows, digest).

    Level 0 has ranges of so many keys (range * width on; null: keys that are null), each
    level above fanout times as many. Rows are read once; the levels above add up sums.
    """
    leaf = F.floor(F.col(key) / width).cast("long")
    sums = ["n_rows", "s0", "s1", "s2"]
    level = df.groupBy(*keys, leaf.alias("range")).agg(F.count("*").alias("n_rows"), *row_sums(df, df.columns))
    up = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.floor(F.col("range") / fanout**i).cast("long").alias("range")) for i in range(levels)))).alias("node")
    nodes = level.select(*keys, up, *sums).groupBy(*keys, F.col("node.level").alias("level"), F.col("node.range").alias("range"))
    return nodes.agg(*(F.sum(c).alias(c) for c in sums)).select(*keys, "level", "range", "n_rows", _digest())


def changed_ranges(before: DataFrame, now: DataFrame, *keys: str, fanout: int = 16, levels: int = 3) -> DataFrame:
    """Ranges of level 0 whose rows differ between two trees of range_digests: (keys, range, status).

    status: changed, gone or new. From the top level down only what is below ranges that
    differ is compared.
    """
    same = lambda a, b: reduce(and_, (F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}")) for k in (*keys, "range")))
    differ = None
    for i in range(levels - 1, -1, -1):
        old, new = (t.where(F.col("level") == i).select(*(F.col(c).alias(f"{p}{c}") for c in (*keys, "range", "n_rows", "digest"))) for t, p in ((before, "b_"), (now, "n_")))
        j = old.join(new, same("b_", "n_"), "full_outer")
        status = F.when(F.col("n_n_rows").isNull(), "gone").when(F.col("b_n_rows").isNull(), "new").when((F.col("b_n_rows") != F.col("n_n_rows")) | (F.col("b_digest") != F.col("n_digest")), "changed")
        here = j.select(*(F.coalesce(f"b_{k}", f"n_{k}").alias(k) for k in keys), F.coalesce("b_range", "n_range").alias("range"), status.alias("status")).where("status is not null")
        if differ is not None:
            above = differ.select(*(F.col(c).alias(f"u_{c}") for c in (*keys, "range")))
            below = reduce(and_, (F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in keys), F.floor(F.col("range") / fanout).cast("long").eqNullSafe(F.col("u_range")))
            here = here.join(above, below, "left_semi")
        differ = here
    return differ


def validate_manifest(df: DataFrame, manifest: DataFrame, *keys: str) -> DataFrame:
    """Each set of df or of its manifest with status: ok, rows (their number differs), digest (only their contents do), missing or unexpected."""
    now = dataset_manifest(df, *keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("n_rows").alias("found_rows"), F.col("digest").alias("found_digest"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    j = manifest.select(*keys, "n_rows", "digest").join(now, same, "full_outer")
    status = F.when(F.col("found_rows").isNull(), "missing").when(F.col("n_rows").isNull(), "unexpected").when(F.col("found_rows") != F.col("n_rows"), "rows").when(F.col("found_digest") != F.col("digest"), "digest").otherwise("ok")
    return j.select(*(F.coalesce(k, f"_{k}").alias(k) for k in keys), "n_rows", "found_rows", status.alias("status"))


def limit_first(df: DataFrame, n: int, pos: str, *keys: str) -> DataFrame:
    """The first n rows of each split in order of pos.

    Each input partition of a split gives n rows at most before the last cut.
    """
    if not keys:
        return df.orderBy(pos).limit(n)
    w = Window.partitionBy(*keys).orderBy(pos)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
