"""Alignment of two tokenizers by the bytes that both cut at, with an identity-map fast path.

A byte-level BPE (A) encodes a space and the text, a SentencePiece model (B) the text,
which itself puts the space before. Places where tokens of both end cut the bytes into
groups; every token of A in a group is linked with every token of B in it.

For each id of A an array holds the id of B with the same bytes. A group of one token
each is nearly always such a pair: how many documents hold it linked is counted in a
vector as long as A's vocabulary. Only the other pairs are keys of a shuffle, a row for
each chunk of texts that has them, and their counts come back to the chunks by number.

Both encoders cut before a space that stands between a character that is no space and
one that is no white space. A text is split there; each different part of a chunk is
encoded and aligned once, many in one call, and counts as often as it stands.

Cases: texts that are null or empty, and those whose joined bytes of A or B are not the
text's behind a space (a literal U+2581, say), have no tokens: zeros and '' for the
groups; texts are aligned whole, however long; special tokens' strings are ordinary
text; ties of the highest count all are best; repeated rows, and rows with one doc_id or
none, are documents each; extra columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import public
from .chunked import brought_back, entries, packed, parts_of, parts_of_sizes, ragged, runs_of_texts, unpacked
from .common import written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that go to an encoder in one call.
CALL = 1 << 16
#: Parts that more than one chunk had and whose alignments a worker keeps.
KEPT = 200_000
#: Characters of text in a chunk, and of texts that are aligned together.
CHUNK, TOGETHER = 1 << 23, 1 << 20
_CUT = re.compile(r"(?<=[^ ▁])(?= [^\s])")
_ODD = re.compile(r" \s|▁| $")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both encoders, their tokens' bytes and the map of ids with the same bytes."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letters = byte_letters()
        spec = json.loads(a)
        names = {i: t for t, i in spec["model"]["vocab"].items()}
        specials = {x["id"] for x in spec["added_tokens"]}
        self.n_a = max([*names, *specials]) + 1
        self.bytes_a = [b"" if i in specials or i not in names else bytes(letters[c] for c in names[i]) for i in range(self.n_a)]
        self.n_b = self.b.get_piece_size()
        self.bytes_b = [self._piece(i) for i in range(self.n_b)]
        first: dict[bytes, int] = {}
        for i in sorted(range(self.n_b), key=lambda i: (self.b.is_byte(i), i)):  # a piece before a byte
            if self.bytes_b[i]:
                first.setdefault(self.bytes_b[i], i)
        self.same = np.fromiter((first.get(x, -1) if x else -1 for x in self.bytes_a), dtype=np.int64, count=self.n_a)
        self.len_a = np.fromiter(map(len, self.bytes_a), dtype=np.int64, count=self.n_a)
        self.len_b = np.fromiter(map(len, self.bytes_b), dtype=np.int64, count=self.n_b)
        # ids as they stand in a group, with what follows them
        self.shown = [f"{i}{x}" for x in ",|" for i in range(self.n_a)] + [f"{i}{x}" for x in ",;" for i in range(self.n_b)]
        self.last: dict[str, tuple | None] = {}
        self.kept: dict[str, tuple | None] = {}

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def align(self, parts: list[str]) -> list[tuple | None]:
        """For each part (n_a, n_b, n_groups, n_links, groups, links, how often each stands); None where bytes differ.

        Links are longs a * n_b + b as bytes, and so are their numbers; one can come twice. Parts must be such that both encoders cut between any two of them.
        """
        out: list[tuple | None] = []
        for start, end in parts_of(parts, CALL):
            own = parts[start:end]
            # parts in a row are encoded as one text: both encoders cut between them
            sizes = np.fromiter((len(p.encode("utf-8", "surrogatepass")) for p in own), dtype=np.int64, count=len(own))
            text = "".join(own)
            a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int64)
            b = np.array(self.b.encode(text[1:]), dtype=np.int64)
            if self._exact(text, a, b):
                out += self._grouped(a, b, np.cumsum(sizes))
            elif len(own) == 1:
                out.append(None)
            else:
                half = len(own) // 2
                out += self.align(own[:half]) + self.align(own[half:])
        return out

    def _exact(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        whole = text.encode("utf-8", "surrogatepass")
        return b"".join([self.bytes_a[i] for i in a.tolist()]) == whole and b"".join([self.bytes_b[i] for i in b.tolist()]) == whole

    def _grouped(self, a: np.ndarray, b: np.ndarray, stops: np.ndarray) -> list[tuple]:
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        cuts = np.intersect1d(end_a, end_b)  # tokens of no bytes don't come: ends differ from each other
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        n_a, n_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        # ids as text: the tokens of A of a group, then those of B
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        code = np.concatenate([a + self.n_a * last_a, b + 2 * self.n_a + self.n_b * last_b])[order]
        shown = list(map(self.shown.__getitem__, code.tolist()))
        upto = np.searchsorted(cuts, stops, side="right")  # groups of the parts so far
        both = np.concatenate([[0], np.cumsum(n_a + n_b)])[upto]
        starts = np.concatenate([[0], upto[:-1]])
        # links within groups of few tokens: all pairs; of many: pairs of different ids
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        few = n_a * n_b <= 4096
        g = np.flatnonzero(few)
        each = ragged(first_a[g], n_a[g])
        owner = np.repeat(g, n_a[g])
        link_a, link_g = np.repeat(a[each], n_b[owner]), np.repeat(owner, n_b[owner])
        link_b, times = b[ragged(first_b[owner], n_b[owner])], np.ones(len(link_a), dtype=np.int64)
        for i in np.flatnonzero(~few).tolist():
            (xa, ca), (xb, cb) = (np.unique(v[f[i] : f[i] + n[i]], return_counts=True) for v, f, n in ((a, first_a, n_a), (b, first_b, n_b)))
            link_a, link_b = np.concatenate([link_a, np.repeat(xa, len(xb))]), np.concatenate([link_b, np.tile(xb, len(xa))])
            link_g, times = np.concatenate([link_g, np.full(len(xa) * len(xb), i)]), np.concatenate([times, np.outer(ca, cb).reshape(-1)])
        order = np.argsort(link_g, kind="stable")
        pair, times = (link_a * self.n_b + link_b)[order], times[order]
        link_at = np.searchsorted(link_g[order], np.concatenate([[0], upto]))
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in (n_a, n_b, n_a * n_b)]
        counts = [(s[upto] - s[starts]).tolist() for s in sums]
        n_groups, at = (upto - starts).tolist(), (8 * link_at).tolist()
        pair, times, begins = pair.tobytes(), times.tobytes(), [0, *both.tolist()]
        return [
            (*four, "".join(shown[s:e]), pair[x:y], times[x:y])
            for four, s, e, x, y in zip(zip(counts[0], counts[1], n_groups, counts[2]), begins, begins[1:], at, at[1:])
        ]

    def parts(self, text: str) -> list[str]:
        """Where both encoders cut: before a space between a character that is no space and one that is no white space."""
        whole = " " + text
        if _ODD.search(whole):
            return _CUT.split(whole)
        return [" " + p for p in whole[1:].split(" ")]

    def of(self, parts: list[str]) -> list[tuple | None]:
        """The alignment of each of several different parts, from the chunk before or from what two chunks had, if they have it."""
        found = {}
        for p in parts:
            if p in self.kept:
                found[p] = self.kept[p]
            elif p in self.last:
                found[p] = self.kept[p] = self.last[p]
        new = [p for p in parts if p not in found]
        # where encoders need not cut at a part's edge, it is encoded alone
        alone = [p for p in new if p[-1] in " ▁" or p[1].isspace()]
        if alone:
            new = list(set(new) - set(alone))
        found |= zip(new, self.align(new))
        found |= {p: self.align([p])[0] for p in alone}
        return [found[p] for p in parts]

    def remember(self, chunk: dict[str, tuple | None]) -> None:
        """The alignments of a chunk's parts, for the next one; of those of two chunks the newest KEPT stay."""
        self.last = {p: x for p, x in chunk.items() if len(p) < 64}
        if len(self.kept) > KEPT:
            self.kept = dict(islice(self.kept.items(), len(self.kept) - KEPT // 2, None))


class Slots(dict):
    """A number for each different key, in order of the first lookup."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_LOADED: dict[tuple, Pair] = {}


def loaded(a: bytes, b: bytes) -> Pair:
    """The encoders, read once in each worker."""
    key = (len(a), a[-32:], len(b), b[:4096])
    if key not in _LOADED:
        _LOADED[key] = Pair(a, b)
    return _LOADED[key]


def distinct_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, dtype=np.int64)
    return k[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


_CHUNK = "chunk long, payload binary, pairs array<long>, holds array<long>, same array<int>, same_holds array<long>"


def chunk_links(docs: DataFrame, a: bytes, b: bytes, size: int = CHUNK) -> DataFrame:
    """A row for each chunk of texts (schema _CHUNK).

    payload, by text: counts, the digest of its groups, its different parts (places) and how often each
    stands (times). By part: its different links and how often each stands; a link is a number
    below the length of same (an id of A linked with its like) or, from there on, a place in
    pairs (a * pieces of B + b). holds: how many texts of the chunk hold a pair linked.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        import hashlib

        p = loaded(a, b)
        for number, ids, texts in runs_of_texts(batches, size):
            slots, have, shown, counts = Slots(), [], [], np.zeros((5, 0), dtype=np.int64)
            rows, digests, places, place_times = [], [], [], []
            for start, end in parts_of(texts, TOGETHER):
                split = [p.parts(t) if t else [] for t in texts[start:end]]
                n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
                flat = np.fromiter(map(slots.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(n.sum()))
                fresh = p.of(list(islice(slots, len(have), None)))
                have += fresh
                shown += ["" if x is None else x[4] for x in fresh]
                new = np.array([(1, 0, 0, 0, 0) if x is None else (0, *x[:4]) for x in fresh], dtype=np.int64).reshape(-1, 5)
                counts = np.concatenate([counts, new.T], axis=1)
                ends = np.concatenate([[0], np.cumsum(n)])
                sums = np.diff(np.concatenate([np.zeros((5, 1), dtype=np.int64), np.cumsum(counts[:, flat], axis=1)], axis=1)[:, ends], axis=1)
                good = (n > 0) & (sums[0] == 0)  # there is text, and no part's bytes differ
                names, stops = list(map(shown.__getitem__, flat.tolist())), ends.tolist()
                digests += [hashlib.sha256("".join(names[s:e])[:-1].encode()).hexdigest().encode() if g else b"" for s, e, g in zip(stops, stops[1:], good.tolist())]
                key = (np.repeat(np.arange(len(n)), n) * len(slots) + flat)[np.repeat(good, n)]
                key, own = np.unique(key, return_counts=True)
                places.append(key % len(slots) if len(slots) else key)
                place_times.append(own)
                n_parts = np.bincount(key // max(1, len(slots)), minlength=len(n))
                rows.append(np.concatenate([np.where(good, sums[1:], 0), n_parts[None]]).T)
            rows = np.concatenate(rows)
            n_links = np.fromiter((0 if x is None else len(x[5]) for x in have), dtype=np.int64, count=len(have)) // 8
            join = lambda arrays: np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
            pair, link_times = (np.frombuffer(b"".join([x[i] for x in have if x]), dtype=np.int64) for i in (5, 6))
            p.remember(dict(zip(slots, have)))
            del slots, have, shown
            like = p.same[pair // p.n_b] == pair % p.n_b
            others = np.unique(pair[~like])
            link = np.where(like, pair // p.n_b, p.n_a + np.searchsorted(others, pair))
            place, n_parts = join(places), rows[:, 4]
            holds = np.zeros(p.n_a + len(others), dtype=np.int64)  # A's vocabulary, then the other pairs
            first = np.cumsum(n_links) - n_links
            at = 0
            for start, end in parts_of_sizes(n_parts.tolist(), 1 << 18):  # texts at a time: different links of each count once
                m = int(n_parts[start:end].sum())
                own, doc = place[at : at + m], np.repeat(np.arange(start, end), n_parts[start:end])
                key = np.repeat(doc, n_links[own]) * len(holds) + link[ragged(first[own], n_links[own])]
                holds += np.bincount(np.unique(key) % len(holds), minlength=len(holds))
                at += m
            same = np.flatnonzero(holds[: p.n_a])
            payload = pickle.dumps({
                "doc_id": ids.to_pylist(), "counts": rows[:, :4], "groups": digests, "doc_parts": n_parts, "places": packed(place), "times": packed(join(place_times)),
                "part_links": n_links, "links": packed(link), "link_times": packed(link_times),
            })
            columns = [[number], [payload], [others.tolist()], [holds[p.n_a :].tolist()], [same.tolist()], [holds[same].tolist()]]
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _CHUNK.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _CHUNK)


def link_counts(docs: DataFrame, a: bytes, b: bytes, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks; how many documents hold each id of A linked with its like (a, n); the same of all other pairs (pair, n)."""
    chunks = written(chunk_links(docs, a, b, size), "links", by="chunk")
    same = chunks.select(F.explode(F.arrays_zip("same", "same_holds")).alias("x")).groupBy(F.col("x.same").alias("a")).agg(F.sum("x.same_holds").alias("n"))
    others = chunks.select(F.explode(F.arrays_zip("pairs", "holds")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holds").alias("n"))
    return chunks, same, written(others, "pairs")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of docs (doc_id, text).

    A link's count: how many documents hold its pair linked. n_best: links whose count is the
    highest of their id of A; count_sum: over links. Both vocabularies' files (2 MB) and two
    vectors as long as A's vocabulary are sent with the tasks, whatever the corpus.
    """
    with open(a_path or public(A_FILE), "rb") as f:
        a = f.read()
    with open(b_path or public(B_FILE), "rb") as f:
        b = f.read()
    chunks, same, others = link_counts(docs, a, b, size)
    pair = Pair(a, b)
    n_a, n_b, like = pair.n_a, pair.n_b, np.zeros(pair.n_a, dtype=np.int64)
    best = np.zeros(n_a, dtype=np.int64)
    for r in same.collect():  # at most a row for each id of A
        like[r.a] = r.n
    for r in others.groupBy(F.floor(F.col("pair") / n_b).cast("int").alias("a")).agg(F.max("n").alias("n")).collect():  # the same
        best[r.a] = r.n
    best = np.maximum(best, like)

    def total(head: dict, found: pa.Table) -> pa.RecordBatch:
        order = np.argsort(found["slot"].to_numpy())
        counts = np.concatenate([like, found["n"].to_numpy()[order]])
        of_a = np.concatenate([np.arange(n_a), found["entry"].to_numpy()[order] // n_b])
        link, times = unpacked(head["links"]), unpacked(head["link_times"]).astype(np.int64)
        sums = np.concatenate([np.zeros((2, 1), dtype=np.int64), np.cumsum(np.stack([times * counts[link], times * (counts[link] == best[of_a[link]])]), axis=1)], axis=1)
        ends = np.cumsum(head["part_links"])
        by_part = np.diff(sums[:, ends], axis=1, prepend=0) if len(ends) else np.zeros((2, 0), dtype=np.int64)
        place, n = unpacked(head["places"]), unpacked(head["times"]).astype(np.int64)
        sums = np.concatenate([np.zeros((2, 1), dtype=np.int64), np.cumsum(by_part[:, place] * n, axis=1)], axis=1)
        by_text = np.diff(sums[:, np.cumsum(head["doc_parts"])], axis=1, prepend=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(head["doc_id"], pa.int64()), *(pa.array(c, pa.int64()) for c in head["counts"].T), pa.array(by_text[1], pa.int64()), pa.array(by_text[0], pa.int64()), pa.array([x.decode() for x in head["groups"]], pa.string())],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    each = entries(chunks, "pairs")
    found = each.join(others.withColumnRenamed("pair", "entry").hint("merge"), "entry").select("chunk", "slot", "entry", "n")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return brought_back(chunks, found, total, schema)
