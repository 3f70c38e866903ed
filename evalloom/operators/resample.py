"""Bootstrap and sign-flip tests at any size.

keyed: weights come from a hash of seed and item, signs from hashes of seed, replicate and
item, so any engine gives the same numbers; its cost is replicates times items, spread over
all tasks, and its shuffle a row for each task, group and replicate. histogram: replicates
are drawn over the different deltas of a group with their counts, whose cost does not follow
the number of items.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache
from math import exp, lcm, sin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Cut points of the Poisson distribution with mean 1: P(weight <= k).
POISSON = [sum(exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040)[: k + 1]) for k in range(8)]


# Fixed values of the draws: a step from one replicate to the next and two odd factors that scramble 32 bits.
STEP, FACTORS = 2654435769, (2146121005, 2221713035)


#: Items whose weights, or signs, are made and added up at a time: what stays in a core's cache; more for signs, as a block of any size takes 600 array steps.
BLOCK, SIGNED = 32, 64


def _weights(first: np.ndarray, second: np.ndarray, replicates: int, table: np.ndarray) -> np.ndarray:
    """A row of table entries for each item, from two 32-bit halves of its hash: 16 scrambled bits for each replicate."""
    x = first.astype(np.uint32)[:, None] + np.arange(replicates, dtype=np.uint32) * np.uint32(STEP)
    x ^= second.astype(np.uint32)[:, None]
    shifted = np.empty_like(x)
    for shift, factor in zip((16, 15), FACTORS):
        x ^= np.right_shift(x, np.uint32(shift), out=shifted)
        x *= np.uint32(factor)
    x ^= np.right_shift(x, np.uint32(16), out=shifted)
    return table.take(np.right_shift(x, np.uint32(16), out=shifted).astype(np.intp), mode="clip")


# Fixed values of md5: by how much each of the 64 steps turns, what it adds and which word of a message it reads.
_WORD = lambda x: np.array(x, dtype=np.uint32)
_TURNS = [(_WORD(n), _WORD(32 - n)) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_SINES = [_WORD(int(abs(sin(i + 1)) * 2**32)) for i in range(64)]
_READS = [(i * step + first) % 16 for step, first in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
_START = tuple(map(_WORD, (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)))


@lru_cache(maxsize=4)
def _heads(seed: int, groups: int) -> tuple[list[bytes], np.ndarray, list[tuple[int, int, int]]]:
    """Beginnings seed|group| of messages, the same as 16 words each, and (length, start, end) of stretches of one length."""
    texts = [f"{seed}|{g}|".encode() for g in range(groups)]
    sizes = [len(t) for t in texts]
    words = np.frombuffer(b"".join(t.ljust(64, b"\0") for t in texts), dtype="<u4").reshape(-1, 16)
    return texts, words, [(n, sizes.index(n), sizes.index(n) + sizes.count(n)) for n in sorted(set(sizes))]


def _md5(items: list[bytes], seed: int, groups: int) -> np.ndarray:
    """The bytes of md5(seed|group|item) for each item and each group from 0, of messages of 55 bytes at most, which are one block.

    All messages take each step together in 32-bit arrays: a tenth of the library's time for one after the other.
    """
    _, heads, stretches = _heads(seed, groups)
    tails = b"".join((bytes(n) + i + b"\x80").ljust(56, b"\0") + (8 * (n + len(i))).to_bytes(8, "little") for n, _, _ in stretches for i in items)
    tails = np.frombuffer(tails, dtype="<u4").reshape(len(stretches), len(items), 16)
    words = {k: np.empty((len(items), groups), dtype=np.uint32) for k in np.flatnonzero(heads[-1] | tails.any(axis=(0, 1))).tolist()}
    for k, word in words.items():
        for (_, start, end), tail in zip(stretches, tails):
            np.bitwise_or(heads[start:end, k], tail[:, k, None], out=word[:, start:end])
    a, b, c, d = (np.full((len(items), groups), x) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        if _READS[i] in words:
            f += words[_READS[i]]
        left, right = _TURNS[i]
        np.left_shift(f, left, out=turned)
        f >>= right
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    out = np.empty((len(items), groups, 4), dtype="<u4")
    for k, (x, first) in enumerate(zip((a, b, c, d), _START)):
        np.add(x, first, out=out[:, :, k])
    return out.view(np.uint8).reshape(len(items), 16 * groups)


def _signs(items: list[bytes], replicates: int, seed: int) -> np.ndarray:
    """A row of 1 and -1 for each item: of the 16 bits of md5(seed|replicate // 8|item) that are a replicate's, the first."""
    groups = max(1, -(-replicates // 8))
    texts, _, stretches = _heads(seed, groups)
    short = np.array([stretches[-1][0] + len(i) <= 55 for i in items])
    bits = np.empty((len(items), 16 * groups), dtype=np.uint8)
    if short.any():
        bits[short] = _md5([i for i, s in zip(items, short) if s], seed, groups)
    for k in np.flatnonzero(~short):
        bits[k] = np.frombuffer(b"".join(hashlib.md5(t + items[k]).digest() for t in texts), dtype=np.uint8)
    signs = (bits[:, : 2 * replicates : 2] >> 7) * 2.0
    signs -= 1.0
    return signs


def _keyed(deltas: DataFrame, replicates: int, keys: tuple[str, ...], item: Column, weights: Callable[[np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """(keys, r, n, total, w, wd): per replicate the rows, their sum, and the sums of weights and of weighted deltas.

    weights gives a row of replicates for each of the items of a block. A task adds up its own
    rows in blocks of items, of all groups by one product of matrices, and gives a row for each
    group and replicate.
    """

    def added(batches):
        sums: dict[tuple, list] = {}
        for b in batches:
            p = b.to_pandas()
            group = p.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(len(p), dtype=np.int64)
            names = {int(g): tuple(b[k][i].as_py() for k in keys) for g, i in zip(*np.unique(group, return_index=True))}
            d = p["delta"].to_numpy()
            one, row = np.unique(p["_item"].to_numpy(), return_inverse=True)
            order = np.argsort(row, kind="stable")
            row, group, d = row[order], group[order], d[order]
            ends = np.searchsorted(row, np.arange(0, len(one) + block, block))
            for i, (start, end) in enumerate(zip(ends[:-1], ends[1:])):
                held, own = one[i * block : (i + 1) * block], slice(start, end)
                w = weights(held)
                here, at = np.unique(group[own], return_inverse=True)
                places = (at, row[own] - i * block)
                counts, values = np.zeros((len(here), len(held))), np.zeros((len(here), len(held)))
                np.add.at(counts, places, 1.0)
                np.add.at(values, places, d[own])
                different, which = np.unique(counts, axis=0, return_inverse=True)  # metrics of the same items share their weights
                both = np.concatenate([different, values]) @ w
                n, total = np.bincount(at, minlength=len(here)), np.bincount(at, weights=d[own], minlength=len(here))
                for k, g in enumerate(here.tolist()):
                    s = sums.setdefault(names[g], [0, 0.0, np.zeros(replicates), np.zeros(replicates)])
                    s[0] += int(n[k])
                    s[1] += float(total[k])
                    s[2] += both[which.ravel()[k]]
                    s[3] += both[len(different) + k]
            if len(sums) > 200:
                yield from given(sums)
                sums = {}
        yield from given(sums)

    def given(sums):
        for g, (n, total, w, wd) in sums.items():
            yield pd.DataFrame({**dict(zip(keys, g)), "r": np.arange(replicates, dtype=np.int32), "n": n, "total": total, "w": w, "wd": wd})[[*keys, "r", "n", "total", "w", "wd"]]

    def run(batches):
        for p in added(batches):
            yield pa.RecordBatch.from_pandas(p, schema=schema, preserve_index=False)

    rows = deltas.where("item_key is not null and delta is not null").select(*keys, item.alias("_item"), F.col("delta").cast("double").alias("delta"))
    kinds = ", ".join([*([_type_of(deltas, keys)] if keys else []), "r int, n long, total double, w double, wd double"])
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    parts = rows.mapInArrow(run, kinds)
    return parts.groupBy(*keys, "r").agg(*(F.sum(c).alias(c) for c in ("n", "total", "w", "wd")))


def poisson_table() -> np.ndarray:
    """The Poisson weight of each 16-bit number over 65536."""
    return np.searchsorted(np.array(POISSON), np.arange(65536) / 65536, side="right").astype(np.float64)


def bootstrap_keyed(deltas: DataFrame, replicates: int, seed: int, alpha: float, *keys: str) -> DataFrame:
    """Percentile interval of the mean of deltas (keys, item_key, delta) from keyed Poisson weights."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("item_key").cast("string")))
    half = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
    table = poisson_table()
    weights = lambda held: _weights(held >> 32 & 0xFFFFFFFF, held & 0xFFFFFFFF, replicates, table)
    means = _keyed(deltas, replicates, keys, F.shiftleft(half(0), 32).bitwiseOR(half(1)), weights).where("w > 0").withColumn("m", F.col("wd") / F.col("w"))
    ci = F.percentile("m", [alpha / 2, 1 - alpha / 2])
    return means.groupBy(*keys).agg(ci.alias("ci")).select(*keys, F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"))


def permutation_keyed(deltas: DataFrame, replicates: int, seed: int, *keys: str) -> DataFrame:
    """Share of keyed sign flips whose mean is at least as far from 0; 1 for a mean of 0."""
    item, signs = F.col("item_key").cast("string").cast("binary"), lambda held: _signs(held.tolist(), replicates, seed)
    sums = _keyed(deltas, replicates, keys, item, signs, SIGNED).select(*keys, (F.col("wd") / F.col("n")).alias("m"), (F.col("total") / F.col("n")).alias("obs"))
    far = F.count_if(F.abs("m") >= F.abs("obs") - 1e-12) / F.lit(float(replicates))
    return sums.groupBy(*keys).agg(F.when(F.abs(F.max("obs")) <= 1e-12, 1.0).otherwise(far).alias("p"))


def _rng(seed: int, key: tuple) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, *map(str, key))).encode()).digest()[:8], "big"))


def _type_of(histogram: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} {histogram.schema[k].dataType.simpleString()}" for k in keys)


def bootstrap_histogram(histogram: DataFrame, replicates: int, seed: int, alpha: float, *keys: str) -> DataFrame:
    """Percentile interval of the mean of histogram (keys, delta, cnt) by multinomial draws."""

    def draw(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("delta")
        d, c = p["delta"].to_numpy(dtype=float), p["cnt"].to_numpy(dtype=np.int64)
        n, rng, means = int(c.sum()), _rng(seed, key), []
        for at in range(0, replicates, 100):  # a hundred replicates at a time bound the memory
            means.append(rng.multinomial(n, c / n, size=min(100, replicates - at)) @ d / n)
        low, high = np.quantile(np.concatenate(means), [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([(*key, float(low), float(high))])

    return histogram.groupBy(*keys).applyInPandas(draw, f"{_type_of(histogram, keys)}, ci_low double, ci_high double")


#: Denominators of deltas, and points of the lattice of their sums, up to which a sign-flip test is exact.
DENOMINATOR, LATTICE = 1000, 1 << 24


def lattice(sizes: np.ndarray, counts: np.ndarray, most: int = LATTICE) -> tuple[np.ndarray, int] | None:
    """Sizes as whole multiples of one unit and the units of that in 1, if their sum has so many units at most."""
    unit = 1
    for x in sizes.tolist():
        f = Fraction(x).limit_denominator(DENOMINATOR)
        if abs(float(f) - x) > 1e-9:
            return None
        unit = lcm(unit, f.denominator)
        if unit * x > most:
            return None
    k = np.rint(sizes * unit).astype(np.int64)
    return (k, unit) if int((k * counts).sum()) <= most else None


def flip_tail(k: np.ndarray, counts: np.ndarray, observed: int) -> float:
    """P(|sum of +-k over all counts| >= observed), every sign being as likely.

    The number of units with a plus, 0 to their sum t, is a sum of binomial numbers; the
    convolution of all is a product of cosines on t + 1 frequencies, and what lies between
    -observed and observed is summed by the kernel of a run of ones.
    """
    t = int((k * counts).sum())
    inside = max(0, observed if (t - observed) % 2 else observed - 1)  # places strictly between, of every second one
    if not inside:
        return 1.0
    total, n = 0.0, t + 1
    for start in range(0, n, 1 << 16):
        half = np.pi * np.arange(start, min(n, start + (1 << 16))) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            logs, signs = np.zeros(len(half)), np.ones(len(half))
            for x, c in zip(k.tolist(), counts.tolist()):
                cos = np.cos((x * half) % (2 * np.pi))
                logs += c * np.log(np.abs(cos))
                signs *= np.where((cos < 0) & (c % 2 == 1), -1.0, 1.0)
            kernel = np.sin(inside * half) / np.sin(half)
        if start == 0:
            kernel[0] = inside
        total += float((signs * np.exp(logs) * kernel).sum())
    return min(1.0, max(0.0, 1.0 - total / n))


def permutation_exact(histogram: DataFrame, replicates: int, seed: int, *keys: str, most: int = LATTICE) -> DataFrame:
    """(keys, p_permutation, exact): p over all sign flips of histogram (keys, delta, cnt), without a seed.

    Deltas that are multiples of a common unit give sums on a lattice, whose distribution is
    computed; the cost follows its points and the different sizes, not the number of items.
    Only where there is no such lattice of `most` points p is drawn, as permutation_histogram has it.
    """

    def p_of(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        delta, count = p["delta"].to_numpy(dtype=float), p["cnt"].to_numpy(dtype=np.int64)
        by = pd.DataFrame({"size": np.abs(delta).round(12), "cnt": count}).groupby("size")["cnt"].sum()
        by = by[by.index > 0]
        size, counts = by.index.to_numpy(dtype=float), by.to_numpy(dtype=np.int64)
        found = lattice(size, counts, most)
        if found is None:
            return pd.DataFrame([(*key, _drawn(key, p, replicates, seed), False)])
        k, unit = found
        observed = abs(int((np.rint(delta * unit).astype(np.int64) * count).sum()))
        return pd.DataFrame([(*key, flip_tail(k, counts, observed), True)])

    return histogram.groupBy(*keys).applyInPandas(p_of, f"{_type_of(histogram, keys)}, p_permutation double, exact boolean")


def _drawn(key: tuple, p: pd.DataFrame, replicates: int, seed: int) -> float:
    """Share of random sign flips that are as far from 0: of equal sizes, a binomial number is positive."""
    n = p["cnt"].sum()
    by = p.assign(size=p["delta"].abs()).groupby("size")["cnt"].sum()
    observed = abs((p["delta"] * p["cnt"]).sum() / n)
    if observed <= 1e-12:
        return 1.0
    rng, far = _rng(seed, key), 0
    for at in range(0, replicates, 100):
        plus = rng.binomial(by.to_numpy(), 0.5, size=(min(100, replicates - at), len(by)))
        far += int((np.abs((2 * plus - by.to_numpy()) @ by.index.to_numpy() / n) >= observed - 1e-12).sum())
    return far / replicates


def permutation_histogram(histogram: DataFrame, replicates: int, seed: int, *keys: str) -> DataFrame:
    """p of random sign flips of histogram (keys, delta, cnt)."""

    def draw(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, _drawn(key, p, replicates, seed))])

    return histogram.groupBy(*keys).applyInPandas(draw, f"{_type_of(histogram, keys)}, p_permutation double")
