"""Periodic runs of words by the dictionary of basic factors.

Words of a text are numbers. The dictionary names every factor of length 1, 2, 4, ...
words: equal factors have one name, and the name of a longer one is that of the pair of
its halves. One sort by name and place per length gives both the names and, for each
place, its successor: the next place in the text with the same factor. Successors no
further than twice the length, one after another at one distance, are an arithmetic
progression and propose this distance as a period. A proposal is extended both ways by
comparing basic factors from the longest down, and runs found more than once are one.

Why none is missed: for a run of smallest period q and at least 3q words take the
length f = 2**k with q <= f < 2q. The factor at the run's start comes again q words on,
still inside of the run, and no sooner: a nearer place would give the run a period that
divides q. Why none has a period that is not its smallest: a smaller one would divide
it, and the factor would have had a nearer successor.

A factor that stands once in a text is part of no longer one that repeats, so only
places whose both halves repeat go on to the next length; prose leaves few of them.
Texts are worked on whole and many at a time; no row leaves its task.

Cases: null or blank text has no words and no runs; a null doc_id is a row like others;
very long texts take n log n; repeated rows are answered each; ties of the greatest
exponent go to the smallest start, then period; extra columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import ragged

#: Bytes of texts that are worked on together (one longer text alone).
TOGETHER = 1 << 20


class Factors:
    """The dictionary of basic factors of several texts in one array of numbers."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        """words: numbers of all words; text i has words first[i] to first[i + 1]."""
        self.words, self.size = words.astype(np.int64), len(words)
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.end = np.repeat(first[1:], np.diff(first))  # of the text that a word is in
        self.begin = np.repeat(first[:-1], np.diff(first))
        self.names: list[np.ndarray] = []  # by length 2**k: at each place a name, -1 where the factor stands once
        self.proposed: list[np.ndarray] = []

    def build(self, least: int = 3) -> None:
        """All lengths below twice the longest period of a run of that exponent."""
        longest = int(np.max(self.end - self.begin, initial=0))
        place = np.arange(self.size)
        key, k = self.text * (int(self.words.max(initial=0)) + 1) + self.words, 0
        while len(place) and (1 << k) < max(2, 2 * (longest // least)):
            names = np.full(self.size, -1, dtype=np.int32)
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            again = np.flatnonzero(key[1:] == key[:-1])
            gap = place[again + 1] - place[again]
            near = gap <= 2 << k
            self._propose(place[again[near]], gap[near])
            number = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else key
            repeats = np.zeros(len(key), dtype=bool)
            repeats[again] = repeats[again + 1] = True
            names[place[repeats]] = number[repeats]
            self.names.append(names)
            # both halves of a longer factor that repeats repeat themselves
            place = np.sort(place[repeats])
            other = place + (1 << k)
            fits = place + (2 << k) <= self.end[place]
            place, other = place[fits], other[fits]
            whole = names[other] >= 0
            place, other = place[whole], other[whole]
            key, k = names[place].astype(np.int64) * max(1, len(number)) + names[other], k + 1

    def _propose(self, place: np.ndarray, gap: np.ndarray) -> None:
        """One place of each progression: places in a row whose successors are at one distance."""
        order = np.argsort(place, kind="stable")
        place, gap = place[order], gap[order]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (gap[1:] != gap[:-1])
        self.proposed.append(np.stack([place[new], gap[new]]))

    def _same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = self.names[k][a]
        return (x >= 0) & (x == self.names[k][b])

    def extended(self, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch around each place in which words a period apart are equal: its start and end."""
        right, left = place.copy(), place.copy()
        for k in range(len(self.names) - 1, -1, -1):
            f = 1 << k
            go = np.arange(len(place))
            while len(go):  # more than once at the longest length only
                go = go[right[go] + period[go] + f <= self.end[place[go]]]
                go = go[self._same(k, right[go], right[go] + period[go])]
                right[go] += f
            go = np.arange(len(place))
            while len(go):
                go = go[left[go] - f >= self.begin[place[go]]]
                go = go[self._same(k, left[go] - f, left[go] - f + period[go])]
                left[go] -= f
        return left, right + period

    def runs(self, words: int = 24, exponent: int = 3) -> np.ndarray:
        """(start, period, end) of all runs of so many words and periods, in order."""
        if not self.size:
            return np.empty((0, 3), dtype=np.int64)
        self.build(exponent)
        place, period = np.concatenate(self.proposed, axis=1)
        start, end = self.extended(place, period)
        keep = end - start >= np.maximum(words, exponent * period)
        return np.unique(np.stack([start[keep], period[keep], end[keep]], axis=1), axis=0)


def number_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of several texts as numbers, equal words the same, and where each text begins."""
    first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)))])
    slots: dict[bytes, int] = {}
    numbers = np.fromiter((slots.setdefault(w, len(slots)) for w in chain.from_iterable(texts)), dtype=np.int64, count=int(first[-1]))
    return numbers, first


def found_runs(docs: DataFrame, words: int = 24, exponent: int = 3, edit: Callable | None = None, size: int = TOGETHER) -> DataFrame:
    """(doc_id, n_words, runs, kept_text) per row of docs (doc_id, text).

    runs: (start, length, period) of every run of so many words and so many periods, by start,
    then period. kept_text: the words that no run has behind its first period, joined by one space.
    edit: a function of (doc_id, words) that gives the words to look at, if not those of the text.
    """

    def find(batches):
        for b in batches:
            ids, texts, start = b["doc_id"].to_pylist(), b["text"].to_pylist(), 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held < size):
                    held += len(texts[stop] or "")
                    stop += 1
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[start:stop]]
                if edit:
                    split = [edit(i, w) for i, w in zip(ids[start:stop], split)]
                numbers, first = number_words(split)
                f = Factors(numbers, first)
                runs = f.runs(words, exponent)
                drop = np.zeros(f.size + 1, dtype=np.int64)
                np.add.at(drop, runs[:, 0] + runs[:, 1], 1)
                np.add.at(drop, runs[:, 2], -1)
                kept = np.cumsum(drop)[: f.size] == 0
                cut = np.searchsorted(runs[:, 0], first)
                found, texts_kept = [], []
                for i, w in enumerate(split):
                    own = runs[cut[i] : cut[i + 1]]
                    found.append([{"start": s - int(first[i]), "length": e - s, "period": p} for s, p, e in own.tolist()])
                    texts_kept.append(b" ".join(w if not len(own) else [w[k] for k in np.flatnonzero(kept[first[i] : first[i + 1]])]))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b["doc_id"].slice(start, stop - start), "n_words": pa.array([len(w) for w in split], pa.int64()),
                    "runs": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    "kept_text": pa.array([t.decode("utf-8", "surrogatepass") for t in texts_kept], pa.string()),
                })
                start = stop

    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words asked for: every tenth document, by a checksum of its id, repeats a part of itself to its end."""
    import zlib

    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of found_runs."""
    # exponents are compared by exact products: length * other period against other length * period
    r = F.col("runs")

    def better(a, b):
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (y > x), b).otherwise(a)  # runs come by start, then period: the first of equals stays

    kind = "struct<start:long,length:long,period:long>"
    top = F.aggregate(r, F.lit(None).cast(kind), better)
    listed = F.array_join(F.transform(r, lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    listed = F.when(F.size(r) > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    out = found.withColumn("top", top).withColumn("listed", listed)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.encode("listed", "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("kept_text", "utf-8"), 256).alias("collapsed_sha256"),
    )
