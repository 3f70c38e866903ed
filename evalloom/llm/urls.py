"""URL filters with dated lists, in DataFrame functions only.

A list is a log of dated entries: from its date on, a pattern (a host name, which
also covers the hosts below it) is blocked, allowed, or taken off the list. Each
pattern's log becomes validity intervals in order of date, and an as-of join takes
the one interval that had begun last when a capture was fetched. The longest pattern
with an active entry decides.

Captures are first reduced to different hosts and days, so that a host with a third
of all captures is joined once a day. A pattern's log is one row, an entry a day at
most, so each host and day meets it once, however long it is.

Cases: null or unreadable URLs have an empty host, and null dates no active entry:
both pass; entries without pattern or date are ignored; of one pattern's entries of
one day the strictest holds (block, then allow, then remove); repeated captures are
returned each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of entries (pattern, action, listed); valid_to is exclusive, null: open."""
    strict = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    e = entries.where("pattern is not null and listed is not null").groupBy("pattern", "listed").agg(F.max_by("action", strict).alias("action"))
    e = e.withColumn("valid_to", F.lead("listed").over(Window.partitionBy("pattern").orderBy("listed")))
    return e.where("action in ('block', 'allow')").select("pattern", "action", F.col("listed").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (id, url, fetched) with host, blocked, pattern and listed (since when) of the deciding entry."""
    c = captures.select("id", "url", "fetched", host_of(F.col("url")).alias("host"))
    days = c.groupBy("host", "fetched").agg(F.count("*").alias("n"))
    labels = F.split("host", r"\.")
    below = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = days.where("host <> ''").select("host", "fetched", F.explode(below).alias("pattern"))
    log = F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "action")))  # an entry a day at most
    logs = written(intervals(entries).groupBy("pattern").agg(log.alias("log")), "intervals")
    as_of = F.get("log", F.size(F.filter("log", lambda e: e["valid_from"] <= F.col("fetched"))) - 1)  # the last that has begun
    begun = tried.join(logs, "pattern").select("host", "fetched", "pattern", as_of.alias("e")).select("host", "fetched", "pattern", "e.*")
    active = begun.where(F.col("valid_from").isNotNull()).where(F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    # a host has few patterns: one for each of its labels
    best = active.groupBy("host", "fetched").agg(F.max_by(F.struct("pattern", "action", "valid_from"), F.length("pattern")).alias("m"))
    best = written(best.select("host", "fetched", "m.*"), "verdicts")
    out = c.join(best, ["host", "fetched"], "left")
    return out.select("id", "url", "host", "fetched", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"), "pattern", F.col("valid_from").alias("listed"))
