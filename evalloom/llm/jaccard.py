"""N-gram Jaccard join: T-occurrence search with DivideSkip.

A document is the set of its distinct word shingles; two documents link when
100 * intersection >= percent * union. The search is exact.

1. Documents with one set are one node, its smallest doc_id (a join key of 128 bits).
2. Of each set the lowest hashes, a quarter and one, are posted. A partner shares
   all but a fifth of a set, so some of these must be in another set too: sets
   that have too few shared ones can't link, and most documents end here.
3. The sets that stay post a prefix of their shingles in one global order: rare
   ones by hash, then a bounded list of frequent ones by frequency. Sets that link
   share a shingle of both prefixes (that many shingles can't all be missing). A
   posting list (shingle, band of set sizes) is named after its smallest id, the
   head; a set is dealt once to each head of its lists. Sets that link share a list
   and so a head; a head's group is its own lists, and never grows along chains.
4. In a group, an inverted index is searched: for each set the longest lists are
   put aside, the short ones heap-merged, and sets with the needed rest of
   occurrences are looked up in the long lists by binary search. Sets that already
   hang together are not compared again.
5. Groups over a cell are dealt as cells, each with the head: every set is searched
   once, and what is like the head hangs together after it. What then is left
   outside the largest component of a group meets the cells of that component and
   the rest. So copies cost one visit each, and no task holds more than two cells.
6. Components of the links; copies take the component of their set.

Cases: null and empty texts have an empty set and link with nothing; texts shorter
than a shingle have one; a null doc_id links with nothing and has a null component;
rows with one doc_id are one document; a very long text is one set, which bounds
the size of a cell from below; sets of one size are searched in order of doc_id;
extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, components, list_column, lists_of, mixed, sorted_runs, written

#: Frequent shingles that go last in the order; a bound on what is sent to tasks (1 MB), not on results.
FREQUENT = 1 << 17
#: A shingle in more posted prefixes than this is frequent.
OFTEN = 8
#: Sets in a cell, and shingles in it.
CELL = 256
SHINGLES = 1 << 20
#: Cost of a binary search against that of a merge step, as in DivideSkip.
MU = 0.01
#: Entries that the heap merges; more are merged by numpy's stable sort of the same sorted runs.
HEAP = 4096


def shingle_sets(texts: list, k: int):
    """For each text its distinct shingle hashes, sorted."""
    for at, held in chunks(texts):
        words = Words(held, lower=True)
        h = words.hashes()
        begin, text, windows = words.windows(h, k)
        counts = np.bincount(text, minlength=len(held)) if len(text) else np.zeros(len(held), dtype=np.int64)
        ends = np.cumsum(counts)
        for i in range(len(held)):
            a, b = words.first[i], words.first[i + 1]
            if b - a >= k:
                yield at + i, np.unique(windows[ends[i] - counts[i] : ends[i]])
            elif b > a:  # the whole sequence is one shingle
                place = np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
                yield at + i, np.array([np.bitwise_xor.reduce(mixed(h[a:b] + place))], dtype=np.uint64)
            else:
                yield at + i, np.empty(0, dtype=np.uint64)


def _key(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        a = mixed(np.bitwise_xor.reduce(mixed(tokens)) + np.uint64(len(tokens)))
        b = mixed(np.add.reduce(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(tokens)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any partner."""
    return -(-percent * n // 100)


def _posted(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + 1 + n // 20)


def shingle_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id, text)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def keys(batches):
        for p in batches:
            n, s1, s2, low = [], [], [], []
            for _, tokens in shingle_sets(p["text"].to_pylist(), k):
                n.append(len(tokens))
                a, b = _key(tokens) if len(tokens) else (None, None)
                s1.append(a)
                s2.append(b)
                low.append(tokens[: _posted(len(tokens), percent)].view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": p["doc_id"], "n": pa.array(n, pa.int64()), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "low": list_column(low)})

    keyed = written(docs.mapInArrow(keys, "doc_id long, n long, s1 long, s2 long, low array<long>"), "keys")
    nodes = written(keyed.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n")), "nodes")
    joined = joined_sets(near_sets(docs, keyed, nodes, k, percent), percent)
    classes = nodes.join(joined, "id", "left").where("copies > 1 or component is not null")
    classes = written(classes.select("s1", "s2", F.coalesce("component", "id").alias("component")), "classes")
    out = keyed.select("doc_id", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def near_sets(docs: DataFrame, keyed: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, tokens, prefix) of the nodes that can link at all."""
    posts = keyed.where("n > 0 and doc_id is not null").select("doc_id", "s1", F.explode("low").alias("token"))
    seen = written(posts.groupBy("token").agg(F.min("s1").alias("x"), F.max("s1").alias("y"), F.count("*").alias("df")).where("x <> y").select("token", "df"), "seen")
    frequent = seen.where(F.col("df") > OFTEN).orderBy(F.desc("df"), "token").limit(FREQUENT).toPandas()  # a bounded list
    last = np.sort(frequent["token"].to_numpy(dtype=np.int64).view(np.uint64)) if len(frequent) else np.empty(0, dtype=np.uint64)
    rank = np.empty(len(last), dtype=np.int64)
    if len(last):
        by_token = np.argsort(frequent["token"].to_numpy(dtype=np.int64).view(np.uint64))
        rank = frequent["df"].to_numpy(dtype=np.int64)[by_token]
    frequent_of = docs.sparkSession.sparkContext.broadcast((last, rank))

    # sets with enough shingles that another set has too
    shared = posts.select("doc_id", "token").join(seen.select("token").hint("merge"), "token").groupBy("doc_id").agg(F.count("*").alias("shared"))
    least = F.col("posted") - (F.col("n") - F.ceil(F.col("n") * percent / 100))
    near = shared.join(nodes.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("posted", _posted_column(percent)).where(F.col("shared") >= least)
    near = written(near.select("doc_id", "s1", "s2"), "near")

    def full(batches):
        last, rank = frequent_of.value
        for p in batches:
            place, size, sets, prefixes = [], [], [], []
            s1, s2 = p["s1"].to_pylist(), p["s2"].to_pylist()
            for i, tokens in shingle_sets(p["text"].to_pylist(), k):
                if len(tokens) and _key(tokens) == (s1[i], s2[i]):
                    n = len(tokens)
                    at = np.searchsorted(last, tokens)
                    hit = at < len(last)
                    hit[hit] = last[at[hit]] == tokens[hit]
                    weight = np.zeros(n, dtype=np.int64)
                    weight[hit] = rank[at[hit]]
                    order = np.argsort(weight, kind="stable")[: n - needed(n, percent) + 1]
                    place.append(i)
                    size.append(n)
                    sets.append(tokens.view(np.int64))
                    prefixes.append(tokens[order].view(np.int64))
            if place:
                yield pa.RecordBatch.from_pydict({"doc_id": p["doc_id"].take(pa.array(place)), "n": pa.array(size, pa.int32()), "tokens": list_column(sets), "prefix": list_column(prefixes)})

    sets = docs.join(near.hint("merge"), "doc_id").select("doc_id", "s1", "s2", "text").mapInArrow(full, "doc_id long, n int, tokens array<long>, prefix array<long>")
    return written(sets, "sets")


def joined_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the sets (doc_id, n, tokens, prefix) that link with another."""
    groups = written(_groups(sets, percent), "groups")
    key = ["head", "band"]
    sizes = written(groups.groupBy(*key).agg(_cells().alias("cells")), "groupsizes")
    g = groups.join(sizes, key)
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("cells")))
    cell = F.explode(F.when(F.col("doc_id") == F.col("head"), F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).otherwise(own))
    first = g.select("doc_id", F.col("doc_id").alias("label"), F.lit(BOTH).alias("side"), *key, cell.alias("cell"))
    first = first.select("doc_id", "label", "side", F.xxhash64(*key, "cell").alias("deal"))
    found = written(_searched(first, sets, percent), "links")
    joined = written(components(found), "joined")
    large = sizes.where("cells > 1").select(*key)
    if large.isEmpty():
        return joined
    # the cells of a large group have met its head alone: what does not hang with the rest meets them now
    m = groups.join(large, key).join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
    m = written(m, "members")
    labels = m.groupBy(*key, "label").agg(F.count("*").alias("c"))
    main = labels.groupBy(*key).agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1").select(*key, "main")
    m = m.join(main, key).withColumn("rest", F.col("label") != F.col("main"))
    split = m.groupBy(*key, "rest").agg(_cells().alias("k")).groupBy(*key).agg(F.max(F.when(~F.col("rest"), F.col("k"))).alias("a"), F.max(F.when(F.col("rest"), F.col("k"))).alias("r"))
    m = m.join(written(split, "split"), key)
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    until = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    against = F.transform(until(F.col("r")), lambda j: task(0, F.col("mine"), j, F.lit(0)))
    tasks = F.concat(
        F.transform(until(F.col("a")), lambda i: task(0, i, F.col("mine"), F.lit(1))),
        F.transform(until(F.col("r")), lambda j: task(1, F.least(j, F.col("mine")), F.greatest(j, F.col("mine")), F.when(j == F.col("mine"), BOTH).otherwise((j < F.col("mine")).cast("int")))),
    )
    second = m.withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("a"))))
    second = second.select("doc_id", "label", *key, F.explode(F.when(F.col("rest"), tasks).otherwise(against)).alias("t"))
    second = second.select("doc_id", "label", "t.side", F.xxhash64(*key, "t.kind", "t.i", "t.j").alias("deal"))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    more = written(components(written(_searched(second, sets, percent, parts), "more")), "rejoined")
    every = joined.union(more.select("id", F.col("id").alias("component"))).distinct()
    again = more.select(F.col("id").alias("component"), F.col("component").alias("low"))
    return every.join(again, "component", "left").select("id", F.coalesce("low", "component").alias("component"))


def _groups(sets: DataFrame, percent: int) -> DataFrame:
    """(head, band, doc_id, n): the heads of each set's posting lists that more sets are in."""
    # a size band holds sizes within 1 / 0.8; partners are in one or in neighbouring bands
    n = F.col("n")
    band = n if percent == 100 else F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent + 1e-9))).cast("int")
    bands = F.array(F.struct(band.alias("band"), F.lit(1).alias("home")), F.struct((band + 1).alias("band"), F.lit(0).alias("home")))
    posted = sets.select("doc_id", "n", "prefix", F.explode(bands).alias("b")).select("doc_id", "n", "b.*", F.explode("prefix").alias("token"))
    lists = posted.groupBy("token", "band").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"), F.max("home").alias("home"))
    # a list without a set of its own band is in the band below too
    heads = written(lists.where("head < last and home = 1").select("token", "band", "head"), "heads")
    return posted.join(heads, ["token", "band"]).select("head", "band", "doc_id", "n").distinct()


def _cells() -> Column:
    """Cells for the sets (n) of a group."""
    return F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum(F.col("n").cast("long")) / SHINGLES)).cast("long")


def _searched(dealt: DataFrame, sets: DataFrame, percent: int, parts: int | None = None) -> DataFrame:
    """Links (a, b) of labels found in each task of dealt (doc_id, label, side, deal)."""
    rows = dealt.join(sets.select("doc_id", "n", "tokens"), "doc_id").select("deal", "n", "doc_id", "label", "side", "tokens")

    def search(t: pa.Table, bounds: list[int]):
        values, ends = lists_of(t["tokens"])
        n, ids, label, side = (t[c].to_numpy() for c in ("n", "doc_id", "label", "side"))
        found = []
        for s, e in zip(bounds, bounds[1:]):
            if e - s > 1:
                order = s + np.lexsort((ids[s:e], n[s:e]))
                pairs = t_occurrence([values[ends[i] : ends[i + 1]] for i in order.tolist()], percent, label[order], side[order])
                found += [(label[order[i]], label[order[j]]) for i, j in pairs]
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sorted_runs(rows, "deal", search, "a long, b long", parts)


def _posted_column(percent: int) -> Column:
    n = F.col("n")
    return F.least(n, n - F.ceil(n * percent / 100) + 1 + F.floor(n / 20))


#: Sides of a task's sets: those of sides 0 and 1 are compared across, BOTH with all.
BOTH = -1


def t_occurrence(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places in sets (in order of size) that link and connect all that do.

    Sets with one label are known to hang together; sets of one side (0 or 1) are not compared.
    """
    many = len(sets)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=many)
    owner = np.repeat(np.arange(many), sizes)
    tokens, which, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[which] > 1  # a shingle of one set alone is in no list
    which, owner = which[shared], owner[shared]
    ends = np.cumsum(np.bincount(owner, minlength=many))
    by_list = np.argsort(which, kind="stable")
    postings = owner[by_list]  # the lists one after another, each in order
    probes = which[by_list] * many + postings  # ascending: a binary search in a list is one in all
    begins = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(tokens)))])
    # each list from the first set that is not too small to the last before the current one
    front, back = begins[:-1].copy(), begins[:-1].copy()
    comp = np.arange(many) if label is None else np.unique(label, return_inverse=True)[1]
    members = {int(c): np.flatnonzero(comp == c).tolist() for c in np.unique(comp)}
    side = np.full(many, BOTH) if side is None else side
    out: list[tuple[int, int]] = []

    def of(q: int) -> np.ndarray:
        return which[ends[q - 1] if q else 0 : ends[q]]

    def found(lists: np.ndarray, c: int) -> int:
        """How many of the lists hold c, by binary search."""
        key = lists * many + c
        at = np.searchsorted(probes, key)
        at[at == len(probes)] = 0
        return int((probes[at] == key).sum())

    def join(q: int, c: int) -> None:
        a, b = int(comp[q]), int(comp[c])
        if len(members[a]) < len(members[b]):
            a, b = b, a
        moved = members.pop(b)
        comp[moved] = a
        members[a] += moved
        out.append((c, q))

    def compared(q: int, places: np.ndarray) -> np.ndarray:
        return (comp[places] != comp[q]) & ((side[places] != side[q]) | (side[q] == BOTH))

    largest, low = 0, 0
    for q in range(many):
        n, lists = int(sizes[q]), of(q)
        t = needed(n, percent)
        while sizes[low] < t:  # too small from here on
            front[of(low)] += 1
            low += 1
        if len(lists) >= t and low < q and compared(q, np.arange(low, q)).any():
            # the head of the largest component first: copies end here
            head = members[int(comp[largest])][0]
            if low <= head < q and compared(q, np.array([head])).any():
                both = found(lists, head)
                if 100 * both >= percent * (n + int(sizes[head]) - both):
                    join(q, head)
            length = back[lists] - front[lists]
            order = np.argsort(length, kind="stable")
            own = lists[order][np.searchsorted(length[order], 1) :]
            if len(own) >= t:
                length = back[own] - front[own]
                aside = min(t - 1, int(t / (MU * log2(int(length[-1]) + 1) + 1)))
                short, long = own[: len(own) - aside], own[len(own) - aside :]
                for c, count in _merged(postings, front[short], back[short], lambda x: compared(q, x), t - aside):
                    if comp[c] == comp[q]:
                        continue
                    count += found(long, c)
                    if 100 * count >= percent * (n + int(sizes[c]) - count):
                        join(q, c)
        back[lists] += 1
        if len(members[int(comp[q])]) > len(members[int(comp[largest])]):
            largest = q
    return out


def _merged(postings: np.ndarray, front: np.ndarray, back: np.ndarray, compared, least: int) -> list[tuple[int, int]]:
    """Places to compare with that occur in so many of the lists postings[front:back] at least, with their counts."""
    length = back - front
    starts = np.cumsum(length) - length
    places = postings[np.arange(int(length.sum())) + np.repeat(front - starts, length)]
    use = compared(places)
    if not use.any():
        return []
    places, of_list = places[use], np.repeat(np.arange(len(length)), length)[use]
    if len(places) <= HEAP:
        runs = np.split(places, np.flatnonzero(np.diff(of_list)) + 1)
        counts = ((c, sum(1 for _ in g)) for c, g in groupby(heapq.merge(*(x.tolist() for x in runs))))
        return [(c, m) for c, m in counts if m >= least]
    found, counts = np.unique(np.sort(places, kind="stable"), return_counts=True)
    return [(int(c), int(m)) for c, m in zip(found, counts) if m >= least]
