"""Exact substring dedup by level-wise doubling.

A window is a run of consecutive words of one document. Windows repeated at one
length alone are extended to twice that length, until no candidates survive:

* first level, half the wanted length: of the shorter windows inside a window of
  the wanted length only the one with the smallest hash is looked at, its anchor.
  Equal windows have equal anchors, and neighbours mostly share theirs, so one
  anchor for about thirteen words is shuffled. Windows of the wanted length whose
  anchor occurs in two documents are the candidates of the next level.
* every further level: windows whose hash is in one document alone are dropped;
  those that stay are joined with the one right behind them, twice as long.

Windows of the wanted length whose smallest doc_id is another document's mark
words; longer levels tell how long the repeats are. Hashes of windows have 96 bits.
Of documents with one text only the first is looked into.

Cases: null text and empty text are no words; a null doc_id has no place in the
order, so nothing is removed from it or because of it; rows with one doc_id and
the same or another text are one document for the order, and each is returned; a
very long text is read whole, and its lists are as long as it is;
extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, forget, mixed, range_hashes, written


def _runs_of_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of so many values."""
    if len(values) < width:
        return values[:0]
    have, span = values, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    return have if span == width else np.minimum(have[: len(have) - (width - span)], have[width - span :])


def _anchors_of(words: Words, i: int, grams: np.ndarray, offset: int, length: int, gram: int) -> np.ndarray:
    """The anchor of each window of text i; grams: hashes of its grams start at offset."""
    n = words.first[i + 1] - words.first[i]
    if n < length:
        return grams[:0]
    return _runs_of_min(grams[offset : offset + n - gram + 1], length - gram + 1)


def _anchor_lists(texts: list, length: int, gram: int):
    """Place of each text and the anchors of all its windows."""
    for at, held in chunks(texts):
        words = Words(held)
        h = words.hashes()
        _, _, grams = words.windows(h, gram)
        counts = np.maximum(np.diff(words.first) - gram + 1, 0)
        offsets = np.cumsum(counts) - counts
        for i in range(len(held)):
            yield at + i, words, i, h, _anchors_of(words, i, grams, offsets[i], length, gram)


def repeated_spans(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, tk, spans, longest) of the documents (doc_id, tk, text) with words to remove.

    spans: array of word ranges start, end (exclusive) that earlier documents hold
    too; longest: the longest level at which a window of it is in an earlier one.
    """
    if length % 2 or length < 2:
        raise ValueError("the wanted length must be even: the first level is half of it")
    gram = length // 2
    docs = docs.where("doc_id is not null and text is not null")  # joins of texts are by shuffle at every size

    def anchors(batches):
        for p in batches:
            ids, tks, out = [], [], []
            for i, _, _, _, a in _anchor_lists(p["text"].tolist(), length, gram):
                a = np.unique(a)
                out.append(a.view(np.int64))
                ids.append(np.full(len(a), p["doc_id"].iat[i]))
                tks.append(np.full(len(a), p["tk"].iat[i]))
            if out:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "tk": np.concatenate(tks), "anchor": np.concatenate(out)})

    # copies of a whole text: only the first is looked into, of the others every window is in it
    texts = docs.select("doc_id", "tk", F.xxhash64(F.lit(1), "text").alias("tk2"))
    groups = written(texts.groupBy("tk", "tk2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("tk", "tk2", "low"), "texts")
    copies = written(texts.join(groups.hint("merge"), ["tk", "tk2"]).where("doc_id > low").select("doc_id", "tk").distinct(), "copies")
    each = docs.select("doc_id", "tk", "text").mapInPandas(anchors, "doc_id long, tk long, anchor long")
    each = written(each, "anchors")
    shared = written(each.groupBy("anchor").agg(F.min("tk").alias("low"), F.max("tk").alias("high")).where("low < high").select("anchor"), "shared")
    # an anchor is once in a document: its list is no longer than the document
    known = each.join(shared.hint("merge"), "anchor").groupBy("doc_id", "tk").agg(F.collect_list("anchor").alias("anchors"))
    known = known.join(copies, ["doc_id", "tk"], "left_anti")
    known = written(known, "known")
    forget(groups, each, shared)

    def first_level(batches):
        for p in batches:
            known_of, out = p["anchors"].tolist(), []
            for i, words, k, h, a in _anchor_lists(p["text"].tolist(), length, gram):
                at = np.flatnonzero(np.isin(a, np.asarray(known_of[i], dtype=np.int64).view(np.uint64)))
                if len(at):
                    own, own2 = (x[words.first[k] : words.first[k + 1]] for x in (h, _second(words)))
                    out.append((p["doc_id"].iat[i], p["tk"].iat[i], at, _window(own, at, length, 0), _window(own2, at, length, 1) >> 32))
                if len(out) == 500:
                    yield pd.DataFrame(out, columns=["doc_id", "tk", "at", "a", "b"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "tk", "at", "a", "b"])

    state = docs.join(known.hint("merge"), ["doc_id", "tk"]).select("doc_id", "tk", "text", "anchors").mapInPandas(first_level, _STATE)
    level, marks, spent = length, [], []
    while True:
        state = written(state, f"level{level}")
        rows = state.select("doc_id", "tk", F.explode(F.arrays_zip("at", "a", "b")).alias("w")).select("doc_id", "tk", "w.at", "w.a", "w.b")
        groups = written(rows.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "b", "low"), f"groups{level}")
        # the second hash, the place and whether an earlier document has the window, in one number
        packed = F.shiftleft(F.col("b").cast("long"), 32) + F.shiftleft(F.col("at").cast("long"), 1) + (F.col("doc_id") > F.col("low")).cast("long")
        hits = rows.join(groups.hint("merge"), ["a", "b"]).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("a", packed.alias("q"))).alias("w"))
        hits = written(hits, f"hits{level}")
        forget(state, groups, *spent)
        if hits.isEmpty():
            break
        places = F.transform(F.filter("w", lambda w: w["q"] % 2 != 0), lambda w: F.shiftright(w["q"].bitwiseAND(0xFFFFFFFF), 1).cast("int"))
        later = hits.select("doc_id", "tk", F.lit(level).cast("long").alias("level"), places.alias("at")).where("size(at) > 0")
        marks.append(written(later if level == length else later.withColumn("at", F.array().cast("array<int>")), "marks"))
        spent = [hits]
        state = hits.mapInArrow(_doubled(level), _STATE)
        level *= 2
    whole = copies.select("doc_id", "tk", F.array(F.struct(F.lit(0).alias("start"), F.lit(WHOLE).alias("end"))).alias("spans"), F.lit(0).cast("long").alias("longest"))
    if not marks:
        return whole

    def merged(batches):
        for p in batches:
            yield pd.DataFrame({"doc_id": p["doc_id"], "tk": p["tk"], "spans": [_ranges(x, length) for x in p["at"]], "longest": p["longest"]})

    found = reduce(DataFrame.union, marks).groupBy("doc_id", "tk").agg(F.max("level").alias("longest"), F.flatten(F.collect_list("at")).alias("at"))
    found = found.mapInPandas(merged, "doc_id long, tk long, spans array<struct<start:int,end:int>>, longest long")
    return found.select("doc_id", "tk", "spans", "longest").union(whole)


_STATE = "doc_id long, tk long, at array<int>, a array<long>, b array<int>"
#: The end of the span of a copy of an earlier document: all its words, if they are a window at least.
WHOLE = 2**31 - 1


def _second(words: Words) -> np.ndarray:
    if not hasattr(words, "second"):
        words.second = words.hashes(1)
    return words.second


def _window(hashes: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    return range_hashes(hashes, at, at + length, which).view(np.int64)


def _doubled(level: int):
    """Of the windows that are repeated, those with another right behind them, joined to one."""

    def step(batches):
        for p in batches:
            w = p["w"]
            ends = w.offsets.to_numpy()
            values = w.values
            all_a, all_q = (values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            ids, tks = p["doc_id"].to_pylist(), p["tk"].to_pylist()
            out = []
            for i in range(len(ids)):
                q, a = all_q[ends[i] : ends[i + 1]], all_a[ends[i] : ends[i + 1]].view(np.uint64)
                at = (q & 0xFFFFFFFF) >> 1
                order = np.argsort(at)
                at, a, b = at[order], a[order], (q[order] >> 32).view(np.uint64)
                behind = np.searchsorted(at, at + level)
                ok = np.flatnonzero((behind < len(at)) & (at[np.minimum(behind, len(at) - 1)] == at + level))
                if len(ok):
                    j = behind[ok]
                    a, b = (mixed(mixed(x[ok]) + x[j] * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for x in (a, b))
                    out.append((ids[i], tks[i], at[ok].astype(np.int32), a, (b >> 32).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _STATE_ARROW)], schema=_STATE_ARROW)

    return step


_STATE_ARROW = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("at", pa.list_(pa.int32())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int32()))])


def _ranges(at, length: int) -> list[dict]:
    """Word ranges that the windows at these places cover together."""
    at = np.sort(np.asarray(at, dtype=np.int64))
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return [{"start": int(s), "end": int(e) + length} for s, e in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]])]


def _level(n: int, length: int) -> int:
    """The longest level at which n words hold a window."""
    return 0 if n < length else length << (n // length).bit_length() - 1


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans, longest) per row of docs (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"), "text")
    spans = written(repeated_spans(keyed, length), "spans")

    def cut(batches):
        for p in batches:
            n, gone, kept, spans = [], [], [], []
            for t, ranges in zip(p["text"].to_pylist(), p["spans"].to_pylist()):
                w = (t or "").encode("utf-8", "surrogatepass").split()
                n.append(len(w))
                if ranges and ranges[0]["end"] == WHOLE:
                    ranges = [{"start": 0, "end": len(w)}] if len(w) >= length else None
                spans.append(ranges)
                left, at = [], 0
                for r in ranges or ():
                    left += w[at : r["start"]]
                    at = r["end"]
                left += w[at:]
                gone.append(len(w) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            columns = {"doc_id": p["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.string()), "spans": pa.array(spans, p["spans"].type), "longest": pa.array([_level(c, length) if r and r[0]["end"] == c else x for r, c, x in zip(spans, n, p["longest"].to_pylist())], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    out = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<start:int,end:int>>, longest long"
    joined = keyed.join(spans.hint("merge"), ["doc_id", "tk"], "left").select("doc_id", "text", "spans", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
    return joined.mapInArrow(cut, out)
