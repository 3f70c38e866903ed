"""SentencePiece encoding and decoding with batched numpy Viterbi.

The model file gives pieces and scores. A text is normalised as the file says,
split before each run of spaces, and each different word is segmented into the
pieces with the largest sum of scores. Words of one length are a matrix and advance
together: at each place the hashes of the substrings that end there probe the sorted
hashes of pieces of that length, and the maximum of the candidates is stored with
the length that gave it. Characters that no piece covers are bytes (or unknown).

The file's trainer settings say what its scores are. Those of a unigram model are
log-probabilities. Those of a merge model (BPE) are ranks: a piece of rank r gets the
log-probability of Zipf's and Mandelbrot's law, 1 / (r + MANDELBROT) over their sum,
a rule that nothing is fitted for. Ids of a merge model decode exactly but can differ
from those of merging, which no sum of scores gives.

Cases: null text has null pieces, empty text none; texts are encoded whole; of
segmentations with one sum the one whose last piece is shortest; repeated rows are
encoded each;
extra columns are not read, and an empty table gives an empty result. In decoding, ids
that the model does not have give nothing, and bytes that are no whole character U+FFFD.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed

#: The public tokenizers' place; a parameter of the operators.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words kept with their pieces between batches of a task.
CACHE = 200_000
#: So few words of one length from LONG characters on are gone through one by one.
FEW, LONG = 8, 64
#: Shift of the ranks of a merge model in the law of its log-probabilities.
MANDELBROT = 50.0


def fields(data: bytes):
    """(number, value) of each field of a protobuf message; sub-messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """A model file's pieces and its segmentation of texts."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
    UNIGRAM, BPE = 1, 2

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.dummy_prefix, self.squeeze, self.byte_fallback, self.model_type = True, True, False, self.UNIGRAM
        for number, value in fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, self.NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, dtype="<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                spec = dict(fields(value))
                self.byte_fallback, self.model_type = spec.get(35, 0) == 1, spec.get(3, self.UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("only identity normalisation is known")
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == self.BYTE}
        usable = [(p, i) for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (self.NORMAL, self.USER) and p]
        if any(SPACE in p.lstrip(SPACE) for p, _ in usable):
            raise ValueError("a piece has a space inside: words can't be segmented alone")
        if self.model_type == self.BPE:
            ranked = sorted((i for _, i in usable), key=lambda i: (-self.scores[i], i))
            weight = 1 / (np.arange(1, len(ranked) + 1) + MANDELBROT)
            for i, s in zip(ranked, np.log(weight / weight.sum()).tolist()):
                self.scores[i] = s
        elif self.model_type != self.UNIGRAM:
            raise ValueError("only unigram and merge models have scores to sum")
        self.unknown_score = min(self.scores[i] for _, i in usable) - 10.0
        self.longest = max(len(p) for p, _ in usable)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in range(1, self.longest + 1):
            own = [(p, i) for p, i in usable if len(p) == n]
            if own:
                h = self._hashes(self._codes([p for p, _ in own], n), n)[:, 0]
                order = np.argsort(h)
                ids = np.array([i for _, i in own])[order]
                self.by_length[n] = (h[order], ids, np.array(self.scores)[ids])
        shown = {self.UNKNOWN: lambda p: " ⁇ ".encode(), self.CONTROL: lambda p: b"", self.BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.shown = [shown.get(k, lambda p: p.replace(SPACE, " ").encode("utf-8"))(p) for p, k in zip(self.pieces, self.kinds)]
        self.cut_lines = not any("\n" in p for p, _ in usable)
        self.cache: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _codes(words: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), n)

    @staticmethod
    def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
        """Hashes of all substrings of n characters of each row."""
        out = np.zeros((codes.shape[0], codes.shape[1] - n + 1), dtype=np.uint64)
        for k in range(n):
            out = out * _BASE + mixed(codes[:, k : k + out.shape[1]].astype(np.uint64) + np.uint64(1))
        return out

    def segment(self, words: list[str]) -> list[tuple[int, ...]]:
        """The best pieces of each of several different words."""
        out: list[tuple[int, ...]] = [()] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        for n in np.unique(lengths):
            if n:
                at = np.flatnonzero(lengths == n)
                step = max(1, (1 << 19) // int(n))
                for a in range(0, len(at), step):
                    own = at[a : a + step]
                    for i, ids in zip(own, self._viterbi([words[i] for i in own], int(n))):
                        out[i] = ids
        return out

    def _viterbi(self, words: list[str], n: int) -> list[tuple[int, ...]]:
        codes = self._codes(words, n)
        rows = len(words)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((rows, n + 1), dtype=np.int32)
        piece = np.full((rows, n + 1), -1, dtype=np.int32)
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        roll = np.zeros((rows, n + 1), dtype=np.uint64)
        scrambled = mixed(codes.astype(np.uint64) + np.uint64(1))
        for size in range(1, min(n, self.longest) + 1):
            roll = roll[:, : n - size + 1] * _BASE + scrambled[:, size - 1 :]
            if size in self.by_length:
                keys, ids, scores = self.by_length[size]
                at = np.minimum(np.searchsorted(keys, roll), len(keys) - 1)
                hit = keys[at] == roll
                if hit.any():
                    found[size] = (np.where(hit, scores[at], -np.inf), np.where(hit, ids[at], -1))
        if rows < FEW and n >= LONG:
            for row in range(rows):
                self._one_long(n, row, found, best, back, piece)
        for end in range(1, n + 1) if not (rows < FEW and n >= LONG) else ():
            best[:, end] = best[:, end - 1] + self.unknown_score
            if 1 in found:
                score, ids = found[1][0][:, end - 1], found[1][1][:, end - 1]
                use = ids >= 0  # an unknown character only where no piece is the character
                best[:, end] = np.where(use, best[:, end - 1] + score, best[:, end])
                piece[:, end] = ids
            for size, (scores, ids) in found.items():
                if 1 < size <= end:
                    total = best[:, end - size] + scores[:, end - size]
                    more = total > best[:, end]
                    if more.any():
                        best[more, end] = total[more]
                        back[more, end] = size
                        piece[more, end] = ids[more, end - size]
        # all words walk back together; -1 marks characters that no piece covers
        end, row, columns = np.full(rows, n), np.arange(rows), []
        while end.any():
            columns.append(np.where(end > 0, piece[row, end], -2))
            end = np.maximum(end - np.where(end > 0, back[row, end], 0), 0)
        out, names = [], self.pieces
        for word, ids in zip(words, np.stack(columns[::-1], axis=1).tolist()):
            ids = [i for i in ids if i != -2]
            if -1 in ids or "".join([names[i] for i in ids]) != word:
                ids = self._walk(word, back, piece, len(out))
            out.append(tuple(ids))
        return out

    def _one_long(self, n: int, row: int, found: dict, best: np.ndarray, back: np.ndarray, piece: np.ndarray) -> None:
        """The same maxima for a long word without others of its length: from the pieces found, in order of their ends."""
        starts, sizes, scores, ids = [], [], [], []
        for size, (score, i) in sorted(found.items()):
            at = np.flatnonzero(i[row] >= 0)
            starts.append(at)
            sizes.append(np.full(len(at), size))
            scores.append(score[row, at])
            ids.append(i[row, at])
        join = lambda x: np.concatenate([np.empty(0, dtype=np.int64), *x])
        end = join(starts) + join(sizes)
        order = np.argsort(end, kind="stable")  # and by size, as they are
        cuts = np.searchsorted(end[order], np.arange(1, n + 2)).tolist()
        sizes, scores, ids = (join(x)[order].tolist() for x in (sizes, scores, ids))
        sums, length, chosen = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        for e in range(1, n + 1):
            top = sums[e - 1] + self.unknown_score
            for k in range(cuts[e - 1], cuts[e]):
                size = int(sizes[k])
                total = sums[e - size] + scores[k]
                if total > top or size == 1:  # an unknown character only where no piece is the character
                    top, length[e], chosen[e] = total, size, int(ids[k])
            sums[e] = top
        best[row], back[row], piece[row] = sums, length, chosen

    def _walk(self, word: str, back: np.ndarray, piece: np.ndarray, row: int) -> list[int]:
        """One word's pieces, with bytes where none covers a character or a hash was another string's."""
        ids, end = [], len(word)
        while end:
            size, i = int(back[row, end]), int(piece[row, end])
            part = word[end - size : end]
            ids += [i] if i >= 0 and self.pieces[i] == part else self._bytes(part)[::-1]
            end -= size
        return ids[::-1]

    def _bytes(self, text: str) -> list[int]:
        if not self.byte_fallback:
            return [self.unknown]
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def words(self, text: str) -> list[str]:
        """The normalised text cut before each run of spaces, and at line ends where no piece has any."""
        text = self.normalised(text)
        if not self.cut_lines or "\n" not in text:
            return self._spaced(text)
        out = []
        for i, line in enumerate(text.split("\n")):
            out += ["\n"] * (i > 0) + self._spaced(line)
        return out

    @staticmethod
    def _spaced(text: str) -> list[str]:
        first, *parts = text.split(SPACE)
        head = [first] if first else []
        if "" not in parts:
            return head + [SPACE + p for p in parts]
        out, spaces = head, 0
        for p in parts:
            spaces += 1
            if p:
                out.append(SPACE * spaces + p)
                spaces = 0
        return out + [SPACE * spaces] * (spaces > 0)

    def encode(self, texts: list) -> list[np.ndarray | None]:
        """Ids of each text; null stays null."""
        split = [None if t is None else self.words(t) for t in texts]
        used = set(chain.from_iterable(s for s in split if s))
        unseen = list(used - self.cache.keys())
        if len(self.cache) + len(unseen) > CACHE:
            self.cache = {w: self.cache[w] for w in used & self.cache.keys()}
        self.cache |= zip(unseen, self.segment(unseen))
        have = self.cache
        return [None if s is None else np.array(list(chain.from_iterable(map(have.__getitem__, s))), dtype=np.int32) for s in split]

    def decode(self, ids) -> str:
        """The text of ids: those that are none of the model's give nothing, bytes that are no whole character U+FFFD."""
        n = len(self.shown)
        raw = b"".join([self.shown[i] for i in np.asarray(ids, dtype=np.int64).tolist() if 0 <= i < n])
        try:
            text = raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def loaded(name: str, model: bytes) -> Pieces:
    """The model, read once in each worker."""
    if name not in _LOADED:
        _LOADED[name] = Pieces(model)
    return _LOADED[name]


def encoded(docs: DataFrame, model: str = MODEL, batch: int = 1 << 21) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, round_trip) per row of docs (doc_id, text).

    The model file is read on the driver and sent with the task: it is 0.5 MB, whatever the corpus.
    round_trip: whether decoding gives the text again (null text: null).
    """
    with open(model, "rb") as f:
        data = f.read()
    name = f"{os.path.basename(model)}:{len(data)}"

    def encode(batches):
        import hashlib

        p = loaded(name, data)
        for b in batches:
            texts, start = b["text"].to_pylist(), 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size < batch):
                    size += len(texts[end] or "")
                    end += 1
                own = texts[start:end]
                ids = p.encode(own)
                back = [None if x is None else p.decode(x) for x in ids]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": b["doc_id"].slice(start, end - start),
                    "n_tokens": pa.array([None if x is None else len(x) for x in ids], pa.int64()),
                    "ids": pa.array(ids, pa.list_(pa.int32())),
                    "decoded_sha256": pa.array([None if x is None else hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()),
                    "round_trip": pa.array([None if x is None else x == t for x, t in zip(back, own)], pa.bool_()),
                })
                start = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of each array of ids."""
    with open(model, "rb") as f:
        data = f.read()
    name = f"{os.path.basename(model)}:{len(data)}"

    @F.pandas_udf("string")
    def of(col: pd.Series) -> pd.Series:
        p = loaded(name, data)
        return pd.Series([None if x is None else p.decode(x) for x in col], dtype=object)

    return of(ids)
