"""Document fingerprints by content-defined chunking.

A text's UTF-8 bytes are cut where a gear hash of the last bytes meets a mask. The
mask is strict up to the normal chunk size and loose behind it, which narrows the
sizes around the normal one; a least and a most size hold. Cuts depend on nearby
bytes only, so an edit changes the chunks around it and no others. A fingerprint is
the set of chunk digests, each weighted by the bytes of its chunk; the likeness of
A to B is the part of A's weight whose chunks B has too.

Cases: null text is empty; an empty text has an empty fingerprint, like another
only if that is empty too (1). Rows with a null doc_id come last in descending
order; rows with one doc_id (or none) are ordered by a hash of their text, so that
many of them are split too; equal rows are dealt once for each batch that has them;
extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, range_hashes, written

#: Chunk sizes in bytes.
LEAST, NORMAL, MOST = 12, 40, 160
#: Bits of the gear hash that must be zero before and behind the normal size.
STRICT, LOOSE = np.uint32(0x1FC00000), np.uint32(0x07800000)
#: Bytes that the gear hash looks back.
REACH = 32

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of table[data[i - k]] << k over the last bytes, modulo 2**32."""
    h = _GEAR[data]
    span = 1
    while span < REACH:
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = gear(np.frombuffer(text, dtype=np.uint8))
    strict = (np.flatnonzero(h & STRICT == 0) + 1).tolist()
    loose = (np.flatnonzero(h & LOOSE == 0) + 1).tolist()
    out, at = [], 0
    while n - at > LEAST:
        i = bisect_left(strict, at + LEAST)
        end = strict[i] if i < len(strict) and strict[i] <= at + NORMAL else None
        if end is None:
            i = bisect_left(loose, at + NORMAL)
            end = loose[i] if i < len(loose) and loose[i] <= at + MOST else at + MOST
        at = min(end, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Weight in bytes of each chunk digest."""
    data = text.encode("utf-8", "surrogatepass")
    ends = np.array(cuts(data), dtype=np.int64)
    if not len(ends):
        return {}
    starts = np.concatenate([[0], ends[:-1]])
    digests = range_hashes(np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1), starts, ends)
    out: dict[int, int] = {}
    for d, w in zip((digests >> np.uint64(16)).tolist(), (ends - starts).tolist()):
        out[d] = out.get(d, 0) + w
    return out


def written_out(f: dict[int, int]) -> str:
    """digest:weight of all chunks, in order of digest."""
    return ",".join(f"{d:012x}:{f[d]}" for d in sorted(f))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The part of a's weight that is in b, 0 to 1."""
    total = sum(a.values())
    if not total or not b:
        return float(not total and not b)
    return sum(min(w, b[d]) for d, w in a.items() if d in b) / total


def edited(text: str, other: str) -> str:
    """The last third of the text replaced by as much of the start of the other."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _parts(ends: tuple[np.ndarray, np.ndarray, np.ndarray], doc_id: np.ndarray, none: np.ndarray, th: np.ndarray) -> np.ndarray:
    """How many of the sorted keys ends (null last, descending id, hash) are not behind each row's key."""
    e_none, e_id, e_th = ends
    out = np.zeros(len(th), dtype=np.int32)
    last = int(e_none.sum())  # ends of rows without id come last
    with_id = -e_id[: len(e_id) - last]  # ascending
    rows = np.flatnonzero(~none)
    low, high = (np.searchsorted(with_id, -doc_id[rows], side) for side in ("left", "right"))
    out[rows] = low
    for i in np.flatnonzero(low < high):  # the few rows whose id is an end's
        out[rows[i]] = low[i] + np.searchsorted(e_th[low[i] : high[i]], th[rows[i]], "right")
    out[none] = len(with_id) + np.searchsorted(e_th[len(with_id) :], th[none], "right")
    return out


def without_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text, more, salt): of the equal rows of a batch one with more = 0, and one for the others, more of them.

    The next document of all equal rows but the last is one like themselves, so those need no
    neighbour; a hot row is dealt once for each batch that has it, and the others by salt.
    """

    def once(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            counts: dict[tuple, int] = {}
            for key in zip(ids, texts):
                counts[key] = counts.get(key, 0) + 1
            if len(counts) == len(ids):
                out = b
                more = np.zeros(len(ids), dtype=np.int64)
            else:
                again = [k for k, n in counts.items() if n > 1]
                rows = [*counts, *again]
                out = pa.RecordBatch.from_pydict({"doc_id": pa.array([k[0] for k in rows], pa.int64()), "text": pa.array([k[1] for k in rows], pa.string())})
                more = np.array([0] * len(counts) + [counts[k] - 1 for k in again], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([out["doc_id"], out["text"], pa.array(more), pa.array(np.arange(salt, salt + len(more)))], names=["doc_id", "text", "more", "salt"])
            salt += len(more)

    return docs.mapInArrow(once, "doc_id long, text string, more long, salt long")


def with_next(docs: DataFrame, part_bytes: int = 1 << 21, few: int = 512, large_bytes: int = 1 << 26) -> DataFrame:
    """Rows (part, lead, doc_id, th, text, more) in which every document stands before its next one.

    Parts are ranges of (descending doc_id, text hash th) of about part_bytes of text, beyond
    `few` of them of large_bytes. Their first keys, three numbers for each part, are the only
    thing that the driver sees and sends. The first document of a part is copied to the end
    of the part before it (of the first, to the last part), with lead = 1. Rows that stand
    for more copies (see without_copies) have parts below 0. Texts are moved once.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    th = F.xxhash64("text").alias("th")
    keys = written(d.select("doc_id", th, F.octet_length("text").alias("size")), "textkeys")
    d = without_copies(d).select("doc_id", "text", "more", "salt", th)
    total = keys.agg(F.sum("size")).first()[0]
    if total is None:
        return d.select(F.lit(0).alias("part"), F.lit(0).alias("lead"), "doc_id", "th", "text", "more")
    parts = max(1, min(few, total // part_bytes), total // large_bytes)
    order = [F.desc_nulls_last("doc_id"), F.asc("th")]
    key = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("down"), "th")
    ranges = keys.repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("pid")).agg(F.min(key).alias("first"))
    firsts = sorted((r["first"]["none"], r["first"]["down"] or 0, r["first"]["th"]) for r in ranges.collect())  # a row for each part
    ends = (np.array([f[0] for f in firsts]), -np.array([f[1] for f in firsts], dtype=np.int64), np.array([f[2] for f in firsts], dtype=np.int64))
    sent = d.sparkSession.sparkContext.broadcast(ends)

    @F.pandas_udf("int")
    def place(doc_id: pd.Series, none: pd.Series, th: pd.Series) -> pd.Series:
        return pd.Series(_parts(sent.value, doc_id.to_numpy(), none.to_numpy(), th.to_numpy()) - 1)

    table = d.sparkSession.createDataFrame([(i, None if n else -down, th, (i - 1) % len(firsts)) for i, (n, down, th) in enumerate(firsts)], "f_part int, f_id long, f_th long, before int")
    d = d.withColumn("part", place(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "th"))
    d = d.join(F.broadcast(table), (F.col("part") == F.col("f_part")) & F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    spread = (-1 - F.pmod(F.xxhash64("salt"), F.lit(parts))).cast("int")
    own = F.struct(F.when(F.col("more") > 0, spread).otherwise(F.col("part")).alias("part"), F.lit(0).alias("lead"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(1).alias("lead"))
    dealt = d.select(F.explode(F.when(F.col("before").isNull() | (F.col("more") > 0), F.array(own)).otherwise(F.array(own, ahead))).alias("p"), "doc_id", "th", "text", "more")
    return dealt.select("p.part", "p.lead", "doc_id", "th", "text", "more")


def fingerprints(docs: DataFrame, part_bytes: int = 1 << 21) -> DataFrame:
    """Per row of docs (doc_id, text): its fingerprint, that of its edited text, and their likenesses.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)
    """
    rows = with_next(docs, part_bytes)
    rows = rows.repartition("part").sortWithinPartitions("part", "lead", F.desc_nulls_last("doc_id"), "th", "text")

    def pairs(batches):
        """Each document, its fingerprint, and those of the next."""
        held = None
        for b in batches:
            for part, lead, doc_id, text, more in zip(*(b[k].to_pylist() for k in ("part", "lead", "doc_id", "text", "more"))):
                if lead and held is None:
                    continue  # only the first copy counts
                f = fingerprint(text)
                if more:
                    yield doc_id, text, f, text, f, more
                    continue
                if held is not None:
                    yield (*held, text, f, 1)
                held = None if lead else (doc_id, text, f)

    def compared(batches):
        out = []
        for doc_id, text, f, other, g, times in pairs(batches):
            new = edited(text, other)
            e = fingerprint(new)
            out.append((doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written_out(f), written_out(e), containment(f, e), containment(f, g)))
            out += out[-1:] * (times - 1)
            if len(out) >= 500:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return rows.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)
