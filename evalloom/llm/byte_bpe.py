"""Byte-level BPE: each different word of the corpus is encoded once.

A task explodes its texts into pre-tokens ("words") with their positions and keeps, by
chunk, the list of different words and the position list of each text. The words of
all chunks are shuffled by a checksum, those of one chunk and checksum packed in one
row, so that equal words meet in one task and each is encoded once, by merging its bytes
in order of rank. The ids are joined back to the chunks by number, and a chunk puts them
in the order of the positions. Decoding looks up every id in the token-byte table.

The pattern of pre-tokens is applied to arrays of code points, not by a regular
expression: a contraction ('s 't 're 've 'm 'll 'd), else a run of letters, of numbers
or of other characters, each with a space before it, else white space but for the
character before a word, else white space. Which code points are letters, numbers or
white space is asked of the library whose results must be matched, once, on the driver.

Cases: null text is empty and has no ids; texts are encoded whole, however long;
of equal ranks the leftmost pair merges; repeated rows, and rows with one doc_id or
none, are encoded each; extra columns are not read; an empty table gives an empty
result; ids outside of the table give no bytes. Ids are little-endian unsigned 32-bit
integers in one binary column.
"""

from __future__ import annotations

import base64
import heapq
import pickle
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import CHUNK, brought_back, packed, parts_of, parts_of_sizes, ragged, runs_of_texts, unpacked
from .common import written

RANKS = "byte_bpe_multi_50k.tiktoken"
LETTER, NUMBER, OTHER, WHITE, END = range(5)
#: Code points that are worked on at once.
TOGETHER = 1 << 18
#: Values of the checksum that words are dealt by.
BUCKETS = 128
#: Different words that a task keeps; beyond them it starts anew, and encodes some again.
KEPT = 2_000_000
#: Words of so many bytes or more are merged with a heap.
LONG = 256
_NONE = 1 << 62


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def code_classes() -> bytes:
    """A class for each code point as the library has it, compressed; asked through one-character patterns."""
    import tiktoken

    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, codes))
    out = np.full(0x110001, OTHER, dtype=np.uint8)
    for cls, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        e = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = bytes(e.encode_ordinary(text)).decode("utf-8")
        out[np.frombuffer(found.encode("utf-32-le"), dtype="<u4")] = cls
    out[0x110000] = END
    return zlib.compress(out.tobytes())


def code_points(texts: list) -> tuple[str, np.ndarray, np.ndarray]:
    """Texts in one string, each with one more character behind it; its code points, 0x110000 behind each text; where those stand."""
    joined = "\0".join([t or "" for t in texts]) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
    ends = np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), dtype=np.int64, count=len(texts))) - 1
    codes[ends] = 0x110000
    return joined, codes, ends


def pre_tokens(codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pre-token begins and ends."""
    cls = classes[codes]
    begins = np.ones(len(codes) + 1, dtype=bool)
    begins[1:-1] = (cls[1:] != cls[:-1]) | (cls[1:] == END)
    # the last white space before a word stands alone, or with the word if it is a space
    last = np.flatnonzero((cls[:-1] == WHITE) & (cls[1:] < WHITE))
    begins[last] = True
    begins[last + 1] = codes[last] != 32
    # a contraction begins at an apostrophe that begins a token
    q = np.flatnonzero((codes == 39) & begins[:-1])
    if len(q):
        wide = np.concatenate([codes, [0x110000, 0x110000]])
        one, two = wide[q + 1], wide[q + 2]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        size = np.where(is_(one, "stmd"), 2, np.where((is_(one, "rv") & is_(two, "e")) | (is_(one, "l") & is_(two, "l")), 3, 0))
        q, size = q[size > 0], size[size > 0]
        begins[q + 1] = False
        begins[q + size] = True
    at = np.flatnonzero(begins)
    starts, ends = at[:-1], at[1:]
    word = cls[starts] != END
    return starts[word], ends[word]


def same_words(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal words the same, and where each number stands first."""
    from .common import range_hashes

    sizes = ends - starts
    numbers, _ = pd.factorize(range_hashes(codes, starts, ends))
    first = np.unique(numbers, return_index=True)[1] if len(numbers) else np.empty(0, dtype=np.int64)
    lead = first[numbers]
    own = ragged(starts, sizes)
    if (sizes[lead] != sizes).any() or (codes[own] != codes[own + np.repeat(starts[lead] - starts, sizes)]).any():
        raw = codes.tobytes()  # one hash for two words: compare them themselves
        numbers, _ = pd.factorize(np.array([raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())], dtype=object))
        first = np.unique(numbers, return_index=True)[1]
    return numbers, first


def joined_bytes(items: list[bytes]) -> bytes:
    """Byte strings as one, compressed."""
    sizes = np.fromiter(map(len, items), dtype="<u4", count=len(items))
    raw = len(items).to_bytes(8, "little") + sizes.tobytes() + b"".join(items)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def split_bytes(data: bytes) -> list[bytes]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(raw, dtype="<u4", count=n, offset=8), dtype=np.int64)).tolist()
    return [raw[s:e] for s, e in zip([8 + 4 * n, *ends], ends)]


def chunk_words(docs: DataFrame, size: int = CHUNK, buckets: int = BUCKETS) -> DataFrame:
    """(chunk, payload, packs). payload: doc_ids of a chunk, words of each, their places among
    the chunk's different words, the frequent ones first, and the checksums (bucket) of these.
    packs: the bytes of the words of each checksum, in the same order.
    """
    packed_classes = code_classes()

    def explode(batches):
        classes = np.frombuffer(zlib.decompress(packed_classes), dtype=np.uint8)
        for number, ids, texts in runs_of_texts(batches, size):
            slots, places, n_words = {}, [], []
            for start, end in parts_of(texts, TOGETHER):
                joined, codes, stops = code_points(texts[start:end])
                begins, finishes = pre_tokens(codes, classes)
                local, first = same_words(codes, begins, finishes)
                names = [joined[s:e].encode("utf-8", "surrogatepass") for s, e in zip(begins[first].tolist(), finishes[first].tolist())]
                own = np.fromiter((slots.setdefault(w, len(slots)) for w in names), dtype=np.int64, count=len(names))
                places.append(own[local].astype(np.int32))
                n_words.append(np.diff(np.searchsorted(begins, stops), prepend=0))
            place = np.concatenate(places)
            order = np.argsort(-np.bincount(place, minlength=len(slots)), kind="stable")  # frequent ones first: small numbers pack well
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            words = list(slots)
            bucket = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % buckets
            bucket = bucket[order]
            dealt = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[dealt], np.arange(buckets + 1)).tolist()
            packs = [{"bucket": i, "words": joined_bytes([words[k] for k in order[dealt[s:e]].tolist()])} for i, (s, e) in enumerate(zip(cuts, cuts[1:])) if s < e]
            payload = pickle.dumps({"doc_id": ids.to_pylist(), "n_words": np.concatenate(n_words), "places": packed(rank[place]), "bucket": packed(bucket)})
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()), "payload": pa.array([payload], pa.binary()),
                "packs": pa.array([packs], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())]))),
            })

    schema = "chunk long, payload binary, packs array<struct<bucket:int,words:binary>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(explode, schema)


# ------------------------------------------------------------------------ merging


class Ranks:
    """A file of ranks: a line for each token, base64 of its bytes and its rank."""

    def __init__(self, data: bytes):
        self.of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        size = max(self.of.values(), default=-1) + 1
        names = [b""] * size
        for token, rank in self.of.items():
            names[rank] = token
        self.sizes = np.fromiter(map(len, names), dtype=np.int64, count=size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(names), dtype=np.uint8)

    def encode(self, word: bytes) -> list[int]:
        """Ids of one word: of all neighbouring parts the pair of the lowest rank merges first."""
        rank = self.of
        if word in rank:
            return [rank[word]]
        return self._heaped(word) if len(word) >= LONG else self._listed(word)

    def _listed(self, word: bytes) -> list[int]:
        get = self.of.get
        parts = [word[i : i + 1] for i in range(len(word))]
        pairs = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == _NONE:
                break
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], _NONE)
        return [self.of[p] for p in parts]

    def _heaped(self, word: bytes) -> list[int]:
        """The same for long words: parts are linked, and pairs wait in a heap until their turn or until a part has changed."""
        get, n = self.of.get, len(word)
        end = list(range(1, n + 1))  # of the part that begins here; 0: none does
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (b := before[i]) >= 0 and (r := get(word[b:stop])) is not None:
                heapq.heappush(heap, (r, b, stop))
        out, i = [], 0
        while i < n:
            out.append(self.of[word[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of ids in a row, and how many each id has."""
        known = ids < len(self.sizes)
        at = np.where(known, ids, 0)
        sizes = np.where(known, self.sizes[at] if len(self.sizes) else 0, 0)
        return self.bytes[ragged(self.starts[at], sizes)] if len(self.sizes) else self.bytes, sizes


_LOADED: dict[bytes, Ranks] = {}


def loaded(data: bytes) -> Ranks:
    """The table, read once in each worker."""
    key = data[-64:] + len(data).to_bytes(8, "little")
    if key not in _LOADED:
        _LOADED[key] = Ranks(data)
    return _LOADED[key]


def encode_words(packs: DataFrame, data: bytes, parts: int) -> DataFrame:
    """(chunk, bucket, sizes, ids) of packs (chunk, bucket, words): equal words have one bucket and are encoded once in its task."""

    def encode(batches):
        r, have = loaded(data), {}
        for b in batches:
            sizes, ids = [], []
            for words in b["words"].to_pylist():
                words = split_bytes(words)
                if len(have) > KEPT:
                    have.clear()
                for w in words:
                    if w not in have:
                        have[w] = np.array(r.encode(w), dtype="<u4").tobytes()
                own = [have[w] for w in words]
                sizes.append(packed(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4))
                ids.append(packed(np.frombuffer(b"".join(own), dtype="<u4")))
            yield pa.RecordBatch.from_pydict({"chunk": b["chunk"], "bucket": b["bucket"], "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return packs.repartition(parts, "bucket").mapInArrow(encode, "chunk long, bucket int, sizes binary, ids binary")


def assembled(head: dict, found: pa.Table) -> pa.RecordBatch:
    """Ids of a chunk's texts from those of its words."""
    bucket = unpacked(head["bucket"])
    dealt = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[dealt], np.arange(int(bucket.max(initial=0)) + 2))
    join = lambda arrays: np.concatenate([np.empty(0, dtype="<u4"), *arrays])
    slots = np.concatenate([np.empty(0, dtype=np.int64), *(dealt[cuts[i] : cuts[i + 1]] for i in found["bucket"].to_pylist())])
    sizes, values = join(map(unpacked, found["sizes"].to_pylist())).astype(np.int64), join(map(unpacked, found["ids"].to_pylist()))
    starts = np.empty(len(slots), dtype=np.int64)
    starts[slots] = np.cumsum(sizes) - sizes
    n_ids = np.empty(len(slots), dtype=np.int64)
    n_ids[slots] = sizes
    place, n_words = unpacked(head["places"]), head["n_words"]
    out, word = [], np.concatenate([[0], np.cumsum(n_words)])
    for start, end in parts_of_sizes(n_words, TOGETHER):  # some texts at a time
        own = place[word[start] : word[end]]
        n = n_ids[own]
        ids = values[ragged(starts[own], n)]
        upto = np.concatenate([[0], np.cumsum(n)])[word[start : end + 1] - word[start]].tolist()
        out += [ids[s:e].tobytes() for s, e in zip(upto, upto[1:])]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(head["doc_id"], pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64()), "ids": pa.array(out, pa.binary())})


def encoded(docs: DataFrame, path: str | None = None, size: int = CHUNK, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_tokens, ids) per row of docs (doc_id, text).

    The file of ranks is read on the driver and sent with the tasks: it is 1 MB, whatever the corpus.
    """
    with open(path or public(RANKS), "rb") as f:
        data = f.read()
    chunks = written(chunk_words(docs, size, buckets), "words", by="chunk")
    packs = chunks.select("chunk", F.explode("packs").alias("p")).select("chunk", "p.bucket", "p.words")
    found = encode_words(packs, data, max(8, buckets // 4))
    return brought_back(chunks, found, assembled, "doc_id long, n_tokens long, ids binary")


def decoded(encodings: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with ids (binary) and in column bytes what they stand for; null ids have null bytes.

    The token-byte table has a row for each id of the vocabulary, so each task joins it from memory.
    """
    with open(path or public(RANKS), "rb") as f:
        data = f.read()

    def decode(batches):
        r = loaded(data)
        for b in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            rows = b["ids"].to_pylist()
            out = [None if x is None else r.decode(np.frombuffer(x, dtype="<u4"))[0].tobytes() for x in rows]
            yield b.append_column("bytes", pa.array(out, pa.binary()))

    columns = [f for f in encodings.schema.fields if f.name != "bytes"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", bytes binary"
    return encodings.select(*(f"`{f.name}`" for f in columns)).mapInArrow(decode, schema)
