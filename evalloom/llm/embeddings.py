"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors of one value are one node. Nodes are normalised and hashed in several tables:
a bucket is K Gaussian projections, shifted and cut to a width. Normalised vectors of
cosine c are sqrt(2 - 2c) apart; from that distance, K follows the number of nodes
(about CROWD strangers a bucket) and the number of tables follows the share of links
at the very threshold that may be missed (MISSED; closer pairs are missed far less).

Only a node's number, its bucket and the signs of 128 further projections travel to
the tables. Inside a bucket, nodes whose signs leave a link possible (all but one in
10**6 of the links at the threshold) form groups, named after the smallest number,
the head. Groups of all tables mostly have the same heads, and a vector travels once
to each different head, where all pairs are checked by cosine in double precision; a
pair that meets at several heads counts at the smallest.

Buckets and groups over CELL nodes are dealt as pairs of cells. A task returns a
count for each node and links that connect its groups, never all pairs.

Cases: null, empty and zero vectors and vectors with null or non-finite components
link with nothing, nor do vectors of different lengths; a null vec_id links with
nothing and has a null component; repeated rows are vectors of their own; vectors
are scaled by their largest component first, so that no finite one overflows;
extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from math import acos, ceil, comb, erfc, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lists_of, mixed, sorted_runs, written

WIDTH = 2.4
CROWD = 200
MISSED = 1e-3
CELL = 2048
#: Signs kept of each vector, and the share of links at the threshold that may differ in too many.
SIGNS = 128
UNLIKE = 1e-6
#: Sides of a task's rows: those of sides 0 and 1 are compared across, BOTH with all.
BOTH = -1


def same_cell(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of points so far apart is equal."""
    t = width / distance
    return 1 - erfc(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def shape(n: int, cosine: float) -> tuple[int, int]:
    """Projections a table and tables for n nodes."""
    near, far = same_cell(sqrt(2 - 2 * cosine) or 1e-9), same_cell(sqrt(2))
    k = max(4, ceil(log(max(n, 2) / CROWD) / -log(far))) if n > CROWD else 4
    return k, max(1, ceil(log(MISSED) / log(1 - near**k)))


def most_unlike(cosine: float) -> int:
    """Signs in which vectors of that cosine differ at most, but for a share of UNLIKE."""
    p, left, at = acos(max(-1.0, min(1.0, cosine))) / pi, 1.0, -1
    while left > UNLIKE and at < SIGNS:
        at += 1
        left -= comb(SIGNS, at) * p**at * (1 - p) ** (SIGNS - at)
    return at


def _projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.standard_normal((dim, SIGNS))


def _usable(v) -> np.ndarray | None:
    """The vector in double precision, or none."""
    if v is None or not len(v):
        return None
    x = np.array([np.nan if c is None else c for c in v], dtype=np.float64) if not isinstance(v, np.ndarray) else v.astype(np.float64)
    x = x + 0.0  # one zero
    return x if np.isfinite(x).all() and x.any() else None


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows with 1 as their largest component: products can't overflow or vanish."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding)."""

    def keys(batches):
        for b in batches:
            h1, h2 = [], []
            values, ends = lists_of(pa.chunked_array([b["embedding"]]))  # a null component is not a number here
            for s, e, none in zip(ends[:-1].tolist(), ends[1:].tolist(), b["embedding"].is_null().to_pylist()):
                x = None if none else _usable(values[s:e])
                d = None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                h1.append(None if d is None else int.from_bytes(d[:8], "big", signed=True))
                h2.append(None if d is None else int.from_bytes(d[8:], "big", signed=True))
            yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "h1": pa.array(h1, pa.int64()), "h2": pa.array(h2, pa.int64()), "v": b["embedding"]})

    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    keyed = written(v.mapInArrow(keys, f"vec_id long, h1 long, h2 long, v {kind}"), "vectors")
    ids = keyed.select("vec_id", "h1", "h2")
    nodes = keyed.where("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    groups = written(_groups(nodes, *shape(nodes.count(), cosine), cosine, seed), "groups")
    found = written(_checked(groups, nodes, cosine), "links")
    counts = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = nodes.select("node", "h1", "h2", "id", "copies").join(counts, "node", "left").join(joined.withColumnRenamed("id", "c_id"), F.col("id") == F.col("c_id"), "left")
    classes = written(classes.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component")).where("n > 0"), "classes")
    out = ids.join(classes, ["h1", "h2"], "left")
    known = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(known, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(known, F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _dealt(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows (node, key, ...) with deal and side: a key of up to CELL rows is one task, a larger one pairs of cells."""
    large = rows.groupBy(key).agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")).where("cells > 1")
    large = written(large.withColumnRenamed(key, "large"), name)
    own = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cells") - 1),
        lambda c: F.struct(F.xxhash64("large", F.least(c, own), F.greatest(c, own)).alias("deal"), F.when(c == own, BOTH).otherwise((c < own).cast("int")).alias("side")),
    )
    # the few large keys are a small table; Spark broadcasts it only below its own threshold
    joined = rows.join(large, rows[key] == large["large"], "left")
    one = F.array(F.struct(F.col(key).alias("deal"), F.lit(BOTH).alias("side")))
    return joined.withColumn("d", F.explode(F.when(F.col("cells").isNull(), one).otherwise(pairs))).select(*rows.columns, "d.deal", "d.side")


def _groups(nodes: DataFrame, k: int, tables: int, cosine: float, seed: int) -> DataFrame:
    """(head, node): the groups of possible links in all buckets."""

    def bucketed(batches):
        for b in batches:
            values, ends = lists_of(pa.chunked_array([b["v"]]))
            dims = np.diff(ends)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _scaled(values[ends[at][:, None] + np.arange(dim)].astype(np.float64))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                a, shift, signs = _projections(int(dim), k, tables, seed)
                cells = np.floor((x @ a + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
                code = np.broadcast_to(mixed(np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)), (len(x), tables))
                for j in range(k):
                    code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j])
                s = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(code.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_pydict({"node": b["node"].take(pa.array(at)), "s1": pa.array(s[:, 0]), "s2": pa.array(s[:, 1]), "codes": codes})

    coded = written(nodes.select("node", "v").mapInArrow(bucketed, "node long, s1 long, s2 long, codes array<long>"), "codes")
    rows = _dealt(coded.select("node", "s1", "s2", F.explode("codes").alias("code")), "code", "buckets")
    most = most_unlike(cosine)

    def near(t: pa.Table, bounds: list[int]):
        node, s1, s2, side = (t[c].to_numpy() for c in ("node", "s1", "s2", "side"))
        heads, members = [], []
        for s, e in zip(bounds, bounds[1:]):
            if e - s > 1:
                own = s + np.argsort(node[s:e])
                signs = np.stack([s1[own], s2[own]]).view(np.uint64)
                label = _labels(own.size, side[own], lambda q, b: (np.bitwise_count(signs[:, q, None] ^ signs[:, None, b]).sum(0, dtype=np.int64) <= most))
                some = np.flatnonzero(np.bincount(label, minlength=len(own))[label] > 1)
                if len(some):
                    heads.append(node[own[label[some]]])
                    members.append(node[own[some]])
        if heads:
            yield pa.RecordBatch.from_pydict({"head": pa.array(np.concatenate(heads)), "node": pa.array(np.concatenate(members))})

    return sorted_runs(rows.select("deal", "side", "node", "s1", "s2"), "deal", near, "head long, node long").distinct()


def _labels(n: int, side: np.ndarray, near, seen=None) -> np.ndarray:
    """For each of n rows the first row of its group: rows that near(rows, columns) links, by blocks of rows.

    Sides 0 and 1 are compared across, BOTH with all. seen gets each block of links.
    """
    left, right = (np.flatnonzero((side == x) | (side == BOTH)) for x in (0, 1))
    label = np.arange(n)
    links = []
    for s in range(0, len(left), 256):
        q = left[s : s + 256]
        ok = near(q, right) & (q[:, None] != right[None, :])
        links.append(ok)
        if seen is not None and ok.any():
            seen(q, right, ok)
    ok = np.concatenate(links) if links else np.zeros((0, len(right)), dtype=bool)
    moved = ok.any()
    while moved:
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(ok, label[right][None, :], n).min(1))
        label[right] = np.minimum(label[right], np.where(ok, label[left][:, None], n).min(0))
        label = label[label]
        moved = (before != label).any()
    return label


def _checked(groups: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """(node, links, id, other) of the groups (head, node): new links of each node, and the id of one it hangs together with."""
    # a node is in a group of each table at most: its list of heads is no longer than their number
    heads = groups.groupBy("node").agg(F.sort_array(F.collect_set("head")).alias("heads"))
    full = nodes.select("node", "id", "copies", "v").join(heads, "node")
    rows = _dealt(groups, "head", "largegroups").join(full, "node").select("deal", "side", "head", "node", "id", "copies", "v", "heads")

    def check(t: pa.Table, bounds: list[int]):
        values, v_at = lists_of(t["v"])
        others, h_at = lists_of(t["heads"])
        head, node, ids, copies, side = (t[c].to_numpy() for c in ("head", "node", "id", "copies", "side"))
        out: list[tuple] = []
        for s, e in zip(bounds, bounds[1:]):
            if e - s < 2:
                continue
            # a group's vectors have one length: it is part of the code
            x = _scaled(values[v_at[s] : v_at[e]].astype(np.float64).reshape(e - s, -1))
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            links, c = np.zeros(e - s, dtype=np.int64), copies[s:e]
            # smaller heads: a pair that has one in common counts there
            own = others[h_at[s] : h_at[e]]
            row = np.repeat(np.arange(e - s), np.diff(h_at[s : e + 1]))[own < head[s]]
            names, at = np.unique(own[own < head[s]], return_inverse=True)
            met = np.zeros((e - s, len(names)), dtype=np.float32)
            met[row, at] = 1

            def count(q: np.ndarray, b: np.ndarray, ok: np.ndarray) -> None:
                new = ok & (met[q] @ met[b].T == 0) if len(names) else ok
                links[q] += new @ c[b]
                links[b] += np.where(side[s:e][b] == BOTH, 0, c[q] @ new)

            label = _labels(e - s, side[s:e], lambda q, b: x[q] @ x[b].T >= cosine, count)
            some = np.flatnonzero((links > 0) | (label != np.arange(e - s)))
            if len(some):
                near = label[some]
                out.append((node[s:e][some], links[some], ids[s:e][some], np.where(near == some, None, ids[s:e][near])))
        if out:
            n, k, i, o = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k), pa.array(i), pa.array(o.tolist(), pa.int64())], names=["node", "links", "id", "other"])

    return sorted_runs(rows, "deal", check, "node long, links long, id long, other long")
