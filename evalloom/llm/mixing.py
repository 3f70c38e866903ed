"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a target in words: its weight's share of all words, stopped at a
multiple of its own size, the excess shared again. A source is taken whole as often
as its target holds it; the rest of the budget is fitted by documents of exact
lengths. Documents are counted by length; most of the rest is met by an equal part
of every length, then by long documents, and the last words, BUDGET or as many as
the longest document has, by a bounded knapsack over the counts that are left. Where that
does not meet the budget and a nearer sum may exist (few or very long documents), sums of
two halves of the documents are matched, which is exact up to HALF squared ways to take them.
Which documents of a length are taken is decided by a seeded hash of their ids.

Only the histogram of lengths of a source meets in one task: as many rows as it
has different lengths, at most its longest document's words.

Cases: null text has no words; a null source is a source, the last in order;
documents without words take nothing; a document longer than the rest of a budget is
not taken for it; repeated rows, and rows with one doc_id or none, are documents of
their own: which of them are taken follows from their texts and, among equal rows,
from their number;
extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: Words of a budget that the exact knapsack fits at least.
BUDGET = 1 << 14
#: Sums that it tells apart in memory.
SUMS = 1 << 21
#: Ways to take documents that are listed for each half of the long ones.
HALF = 1 << 21
#: Documents of one source and length that are ranked together.
TOGETHER = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size): one row a source.

    Shares by weight stop at most * source_size. That is one level of words a unit
    of weight at which the sources below their stop stand: sources are in order of
    stop / weight, and the first whose stop lies above the level of the rest has it.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn("w", w)
    s = s.withColumn("stop", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("stop") / F.col("w"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(after))
    fits = F.when(F.col("level") <= F.col("stop") / F.col("w") * (1 + 1e-12), F.col("level"))
    s = s.withColumn("level", F.coalesce(F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0)))
    return s.select("source", "source_size", F.least("stop", F.col("level") * F.col("w")).alias("target"))


def fitted(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size (in ascending order) to take for the budget."""
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    # the part for the knapsack: no document that fits at all is longer
    last = max(BUDGET, int(sizes[(counts > 0) & (sizes <= budget)].max(initial=0)))
    short = budget % int(np.gcd.reduce(sizes[counts > 0]))  # no sum comes nearer
    best = np.zeros(len(sizes), dtype=np.int64)
    ways = [lambda: _matched(sizes, counts, budget)]
    if last < SUMS // 2:  # the sums of a window fit in memory: most often the first way meets the budget
        ways = [lambda: _fitted(sizes, counts, budget, total, last), *ways, lambda: _fitted(sizes, counts, budget, total, SUMS // 2)]
    for way in ways:
        take = way()
        if (take * sizes).sum() > (best * sizes).sum():
            best = take
        if budget - int((best * sizes).sum()) <= short or (way is ways[-1]):
            break
    return best


def _fitted(sizes: np.ndarray, counts: np.ndarray, budget: int, total: int, last: int) -> np.ndarray:
    """An equal part of every size, then long ones down to the last words, and these by dynamic programming."""
    take = np.array([c * max(0, budget - last) // total for c in counts.tolist()], dtype=np.int64)
    rest = budget - int((take * sizes).sum())
    for i in range(len(sizes) - 1, -1, -1):  # long ones first, down to what the knapsack fits
        if rest > last and sizes[i] > 0:
            n = min(int(counts[i] - take[i]), (rest - last) // int(sizes[i]))
            take[i] += n
            rest -= n * int(sizes[i])
    return take + _knapsack(sizes, counts - take, min(rest, SUMS))


def _matched(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """The best sum of few documents, however long: sums of two halves of them, matched in order.

    All ways to take them are looked at if there are no more than HALF squared. Of more
    documents, as many as make so many ways are chosen among, from the longest down, and
    the others are taken so that about half of the chosen ones' words is left.
    """
    at = np.flatnonzero((sizes > 0) & (sizes <= budget) & (counts > 0))[::-1]
    halves, ways, free = ([], []), [1, 1], np.zeros(len(sizes), dtype=np.int64)
    for i in at.tolist():
        h = 0 if ways[0] <= ways[1] else 1
        n = min(int(counts[i]), budget // int(sizes[i]), HALF // ways[h] - 1)
        if n <= 0:
            break
        halves[h].append((i, n))
        ways[h] *= n + 1
        free[i] = n
    take = np.zeros(len(sizes), dtype=np.int64)
    rest = budget
    if not (free[at] == np.minimum(counts[at], budget // sizes[at])).all():
        aim = int((free * sizes).sum()) // 2
        for i in at.tolist():
            n = max(0, min(int(counts[i] - free[i]), (rest - aim) // int(sizes[i])))
            take[i] = n
            rest -= n * int(sizes[i])

    def sums(half: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """All sums up to rest, each once and in order, and the ways (mixed radix) they are made."""
        out, code, radix = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 1
        for i, n in half:
            k = np.arange(n + 1)
            out, code = (out[:, None] + k * int(sizes[i])).reshape(-1), (code[:, None] + k * radix).reshape(-1)
            fits = out <= rest
            out, first = np.unique(out[fits], return_index=True)
            code, radix = code[fits][first], radix * (n + 1)
        return out, code

    (a, code_a), (b, code_b) = map(sums, halves)
    partner = np.searchsorted(b, rest - a, side="right") - 1
    i = int(np.argmax(a + b[partner]))
    for half, code in ((halves[0], int(code_a[i])), (halves[1], int(code_b[partner[i]]))):
        for k, n in half:
            take[k] += code % (n + 1)
            code //= n + 1
    return take


def _knapsack(sizes: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many of each size make the largest sum up to rest."""
    take = np.zeros(len(sizes), dtype=np.int64)
    # sums that can be reached, and with which size each was reached first
    made = np.zeros(rest + 1, dtype=bool)
    made[0] = True
    last = np.full(rest + 1, -1, dtype=np.int64)
    fit = sizes[(counts > 0) & (sizes > 0)]
    best = rest - rest % int(np.gcd.reduce(fit)) if len(fit) else 0
    for i in np.argsort(-sizes, kind="stable"):
        size, left = int(sizes[i]), int(counts[i])
        if not 0 < size <= rest or left <= 0:
            continue
        rows = -(-(rest + 1) // size)
        grid = np.zeros(rows * size, dtype=bool)
        grid[: rest + 1] = made
        grid = grid.reshape(rows, size)
        at = np.where(grid, np.arange(rows)[:, None], -rows - left - 1)
        steps = np.arange(rows)[:, None] - np.maximum.accumulate(at, axis=0)  # copies since a sum made without this size
        new = ((steps <= left) & ~grid).reshape(-1)[: rest + 1]
        last[new] = i
        made |= new
        if made[best]:
            break
    at = int(np.flatnonzero(made)[-1])
    while at:
        take[last[at]] += 1
        at -= int(sizes[last[at]])
    return take


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 2025) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of docs (doc_id, source, text)."""
    row, text = F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("th")
    sized = written(docs.select("doc_id", "source", n_words("text").alias("size"), text, row), "rows")
    keyed = with_copies(sized, ["doc_id", "source", "th"])
    key = F.struct("doc_id", "th", "copy").alias("doc_id")
    return mixed_sizes(keyed.select(key, "source", "size"), weights, most, seed).withColumn("doc_id", F.col("doc_id.doc_id"))


def with_copies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """copy: the number of a row among those with equal keys, counted in each partition of row (its monotonic id) behind the ones before it."""
    c = rows.withColumn("part", F.shiftright("row", 33))
    counts = c.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")
    counts = counts.select(*(F.col(k).alias(f"c_{k}") for k in keys), F.col("part").alias("c_part"), before.alias("before"))
    same = F.col("part") == F.col("c_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"c_{k}"))
    own = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("row"))
    return c.withColumn("own", own).join(counts, same).select(*rows.columns, (F.col("own") + F.col("before")).alias("copy"))


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed_sizes(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 2025, carried: tuple[str, ...] = ()) -> DataFrame:
    """The same and the columns carried, per row of sized (doc_id, source, size, carried); doc_id can be of any type that has an order."""
    sized = written(sized.withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31))), "sized")
    lengths = written(sized.groupBy("source", "size").agg(F.count("*").alias("c")), "lengths")
    goals = written(targets(lengths.groupBy("source").agg(F.sum(F.col("c") * F.col("size")).alias("source_size")), weights, float(most)), "targets")

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("size")
        size, target = int(p["source_size"].iat[0]), float(p["target"].iat[0])
        whole = min(int(target // size), most) if size else 0
        budget = int(round(target)) - whole * size if whole < most else 0
        n = fitted(p["size"].to_numpy(dtype=np.int64), p["c"].to_numpy(dtype=np.int64), budget)
        return pd.DataFrame({"source": p["source"], "size": p["size"], "source_size": size, "target": target, "c": p["c"], "whole": whole, "n": n})

    plan = lengths.join(goals, lengths["source"].eqNullSafe(goals["source"])).select(lengths["source"], "size", "c", "source_size", "target")
    plan = plan.groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, c long, whole int, n long")
    plan = written(plan.withColumnsRenamed({"source": "p_source", "size": "p_size"}), "plan")
    here = sized["source"].eqNullSafe(plan["p_source"]) & (sized["size"] == plan["p_size"])
    buckets = F.ceil(F.col("c") / TOGETHER)
    rows = sized.join(plan, here).drop("p_source", "p_size").withColumn("bucket", F.floor(F.col("u") * buckets / float(1 << 31)))
    rows = written(rows, "planned")
    part = (F.col("n") > 0) & (F.col("n") < F.col("c"))
    # the bucket in which a length's count is reached, and how many it still gives
    per = rows.where(part).groupBy("source", "size", "bucket").agg(F.count("*").alias("b"), F.max("n").alias("n"))
    so_far = F.sum("b").over(Window.partitionBy("source", "size").orderBy("bucket"))
    edge = per.withColumn("upto", so_far).where((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("b") < F.col("n")))
    edge = written(edge.select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("bucket").alias("edge"), (F.col("n") - F.col("upto") + F.col("b")).alias("give")), "edges")
    cut = rows.where(part).join(edge, rows["source"].eqNullSafe(edge["e_source"]) & (rows["size"] == edge["e_size"]))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("u", "doc_id"))
    columns = ["doc_id", "size", "source_size", "target", "whole", *carried]
    extra = (
        rows.where(~part).select(*columns, (F.col("n") > 0).cast("int").alias("extra"))
        .union(cut.where("bucket <> edge").select(*columns, (F.col("bucket") < F.col("edge")).cast("int")))
        .union(cut.where("bucket = edge").withColumn("rank", rank).select(*columns, (F.col("rank") <= F.col("give")).cast("int")))
    )
    return extra.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long").alias("taken"), *carried)
