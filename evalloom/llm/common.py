"""What the training-data operators share: shared tables, word hashes, components.

Documents are rows of (doc_id, text, ...). Operators read only the columns that
they name, so extra columns, whatever they are called, never clash.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where a local session names none (tests) a temporary folder is set; a cluster
    must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="evalloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Set while a table is written: shuffle files are freed when the write ends, as nothing
#: reads them again, and Python gets texts in batches of a few megabytes.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation.

    by: a column that rows are dealt by, to as many buckets as shuffles have partitions; what
    groups or joins by it reads the table without moving it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evalloom-{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    table = f"evalloom_{name}_{uuid.uuid4().hex}"
    try:
        if by:
            df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
        else:
            df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.table(table) if by else spark.read.schema(df.schema).parquet(path)
    if by:  # the catalog forgets the name; the files stay
        spark.sql(f"DROP TABLE {table}")
    out._evalloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._evalloom_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# ---------------------------------------------------------------- word hashes

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        pair = []
        for base in (_BASES[which], np.uint64(pow(int(_BASES[which]), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.cumprod(steps))
        have = (pair[0], pair[1])
        if size <= 1 << 22:
            _POWERS[which] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of values[start:end) by prefix sums of a polynomial modulo 2**64."""
    up, down = _powers(which, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """Words of a chunk of texts: byte offsets and, for text i, words first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b" ".join(texts) + b" "
        b = np.frombuffer(self.buffer, dtype=np.uint8)
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        step = np.diff(space.view(np.int8), prepend=np.int8(1))
        self.bytes, self.starts, self.ends = b, np.flatnonzero(step == -1), np.flatnonzero(step == 1)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, begins)

    def hashes(self, which: int = 0) -> np.ndarray:
        return range_hashes(self.bytes, self.starts, self.ends, which)

    def windows(self, hashes: np.ndarray, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of so many words of one text: first word, text, hash."""
        counts = np.maximum(np.diff(self.first) - length + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        begin = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[text]
        return begin, text, range_hashes(hashes, begin, begin + length, which)


def chunks(texts: list, size: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts (null: empty) of about so many bytes, each with the place of its first."""
    at, held, total = 0, [], 0
    for i, t in enumerate(texts):
        t = (t or "").encode("utf-8", "surrogatepass")
        if held and total + len(t) > size:
            yield at, held
            at, held, total = i, [], 0
        held.append(t)
        total += len(t)
    if held:
        yield at, held


# ----------------------------------------------------------------- Arrow rows


def list_column(arrays: list[np.ndarray]) -> pa.ListArray:
    """A column of lists of longs."""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64), pa.int64()))


def sorted_runs(df: DataFrame, key: str, work: Callable[[pa.Table, list[int]], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """work on whole runs of rows of one key (a long): a table in one piece and the ends of its runs, 0 first.

    Rows meet by hash and come in sorted order, so no more than a batch and a run is held.
    """

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
            k = t[key].to_numpy()
            ends = (np.flatnonzero(k[1:] != k[:-1]) + 1).tolist()
            if ends:
                yield from work(t.slice(0, ends[-1]), [0, *ends])
            held = t.slice(ends[-1]) if ends else t
        if held is not None and held.num_rows:
            yield from work(held.combine_chunks(), [0, held.num_rows])

    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key).mapInArrow(run, schema)


def lists_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in one piece and where each row's begin and end."""
    c = column.combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()


# ----------------------------------------------------------------- components


#: Edges in a partition of the tables between steps.
EDGES = 200_000


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id reachable.

    Large-star and small-star steps by turns until nothing changes; each step is a
    shuffle of edges, whose number never grows. Hubs are reduced by min() before
    the shuffle; joins split hot keys at run time.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    parts = max(8, -(-e.count() // EDGES))  # the number of edges never grows
    before = None
    for _ in range(most):
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts), "low")
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = written(big.coalesce(parts), "large")
        forget(e, low)
        # small star: smaller neighbours and the node itself move to the smallest
        least = written(big.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "least")
        small = big.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(small.coalesce(parts), "small")
        forget(big, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point in {most} steps")
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
