"""Texts in chunks with a dictionary of their own, and values of dictionary entries brought back.

Work on a token's content (its ids, its count over all documents) needs each
different content once, not each occurrence. A task cuts its texts into chunks of a
bounded number of bytes; a chunk keeps the places of its entries, packed, and a list of
its different entries. Only the entries are shuffled; their values meet the chunk's
places again by the chunk's number. So a hot entry is shuffled once for each chunk, and
no document is a group.

The chunks are written before anything reads them, so their numbers stay the same
whatever is computed again.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text in a chunk (one longer text is a chunk of its own).
CHUNK = 1 << 23


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative integers below 2**32, compressed plane of bytes by plane of bytes."""
    n = np.ascontiguousarray(numbers, dtype="<u4")
    planes = n.view(np.uint8).reshape(-1, 4).T
    used = 4 if len(n) and int(n.max()) >> 24 else 3 if len(n) and int(n.max()) >> 16 else 2
    return len(n).to_bytes(8, "little") + bytes([used]) + pa.compress(np.ascontiguousarray(planes[:used]).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:8], "little"), data[8]
    planes = np.zeros((4, n), dtype=np.uint8)
    planes[:used] = np.frombuffer(pa.decompress(data[9:], decompressed_size=n * used, codec="zstd"), dtype=np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each i, lengths[i] of them, in one array."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def runs_of_texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.Array, list]]:
    """(chunk's number, doc_ids, texts) of a task's rows, about so many characters at a time."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, texts, held = [], [], 0
    for b in batches:
        column, start = b["text"].to_pylist(), 0
        for i, t in enumerate(column):
            held += len(t or "")
            if held >= size:
                yield number, pa.concat_arrays([*ids, b["doc_id"].slice(start, i + 1 - start)]), texts + column[start : i + 1]
                number, ids, texts, held, start = number + 1, [], [], 0, i + 1
        ids.append(b["doc_id"].slice(start))
        texts = texts + column[start:]
    if texts:
        yield number, pa.concat_arrays(ids), texts


def parts_of(texts: list, size: int) -> Iterator[tuple[int, int]]:
    """Ends of runs of texts of about so many characters."""
    yield from parts_of_sizes([len(t or "") for t in texts], size)


def parts_of_sizes(sizes, size: int) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def entries(chunks: DataFrame, column: str) -> DataFrame:
    """(chunk, slot, entry) of each entry of a chunk's dictionary."""
    return chunks.select("chunk", F.posexplode(column).alias("slot", "entry"))


def brought_back(chunks: DataFrame, found: DataFrame, work: Callable[[dict, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work on the payload (a pickled dict) of each of chunks (chunk, payload) and the table of its rows of found (chunk, ...).

    chunks are dealt by their numbers as they are written, so only found is shuffled. A
    task holds one chunk at a time.
    """

    def one(head: pa.Table, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([work(pickle.loads(x), rows) for x in head["payload"].to_pylist()], out)

    out = to_arrow_schema(StructType.fromDDL(schema))
    found = found.withColumnRenamed("chunk", "of_chunk")
    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(one, schema)
