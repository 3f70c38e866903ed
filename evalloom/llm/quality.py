"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by what
kinds of characters follow each other and how its words repeat; a small network
learns, from labels of whole documents, an encoding of passages, gated attention
weights (tanh times sigmoid) and the score of the weighted mean encoding.

The network is fitted on at most `sample` labelled documents, chosen by a hash of
their ids, and at most `most` passages of each, evenly spread over the whole text:
both bound what the driver holds (124 MB). Scoring is a map over all texts, uses all
their passages and needs nothing but the text.

Cases: null and empty texts are one empty passage and get a score like others;
labels that are null, and labels of documents that aren't there, are left out; of
several labels of one document the smallest counts; of rows with one doc_id one is
fitted on and each is scored; very long texts are scored whole, passage by passage;
extra columns are not read; without both labels in the sample every text scores the
share of ones (or 0.5).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks

#: Words in a passage.
PASSAGE = 64
#: Labelled documents to fit on, at most.
SAMPLE = 6000
#: Passages of each to fit on, at most.
MOST = 64

KINDS = 12
FEATURES = KINDS * KINDS + KINDS + 6


def _kinds() -> np.ndarray:
    """The kind of each byte."""
    kind = np.full(256, 9, dtype=np.int64)  # other punctuation
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[[32, 9, 11, 12, 13]], kind[10] = 3, 4
    kind[[ord(c) for c in ".,;:"]], kind[[ord(c) for c in "!?"]], kind[ord("|")] = 5, 6, 7
    kind[[ord(c) for c in "#$%&*@^~_=+<>/\\"]] = 8
    kind[128:192], kind[192:] = 10, 11
    return kind


_KIND = _kinds()


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the place of each one's text; every text has one at least."""
    words = Words([t or b" " for t in texts])
    h = words.hashes()
    n = np.diff(words.first)
    per = np.maximum(-(-n // PASSAGE), 1)
    first = np.cumsum(per) - per
    bag = np.repeat(np.arange(len(texts)), per)
    total = int(per.sum())
    doc = np.repeat(np.arange(len(texts)), n)
    of_word = first[doc] + (np.arange(len(h)) - words.first[doc]) // PASSAGE
    x = np.zeros((total, FEATURES), dtype=np.float32)
    if len(h):
        # bytes belong to the passage of the last word that starts at or before them
        of_byte = of_word[np.maximum(np.searchsorted(words.starts, np.arange(len(words.bytes)), side="right") - 1, 0)]
        kind = _KIND[words.bytes]
        x[:, :KINDS] = np.bincount(of_byte * KINDS + kind, minlength=total * KINDS).reshape(total, KINDS)
        pair = np.bincount(of_byte[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:], minlength=total * KINDS * KINDS).reshape(total, -1)
        size = np.maximum(x[:, :KINDS].sum(1, keepdims=True), 1)
        x[:, :KINDS] /= size
        x[:, KINDS : KINDS + KINDS * KINDS] = np.sqrt(pair / size)
        count = np.bincount(of_word, minlength=total)
        some = np.maximum(count, 1)
        order = np.lexsort((h, of_word))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
        length = words.ends - words.starts
        x[:, -6] = np.log1p(count) / 5
        x[:, -5] = np.bincount(of_word, weights=length, minlength=total) / some / 10
        x[:, -4] = np.bincount(of_word[order], weights=new, minlength=total) / some
        x[:, -3] = np.bincount(of_word, weights=again, minlength=total) / some
        x[:, -2] = np.bincount(of_word, weights=length <= 3, minlength=total) / some
        x[:, -1] = count == 0
    else:
        x[:, -1] = 1
    return x, bag


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def scores(self, x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        return _forward(self.weights, (x - self.mean) / self.scale, bag, n)["p"]

    def score_texts(self, texts: list) -> np.ndarray:
        out = [self.scores(*passages(held), len(held)) for _, held in chunks(texts)]
        return np.concatenate(out) if out else np.empty(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins, axis=0)


def _forward(w: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
    """bag: the place of each passage's document, ascending, each 0..n-1 at least once."""
    begins = np.searchsorted(bag, np.arange(n))
    h = np.maximum(x @ w["e"] + w["eb"], 0)
    t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    a = (t * g) @ w["a"]
    a = np.exp(a - np.maximum.reduceat(a, begins)[bag])
    a /= _sums(a, begins)[bag]
    z = _sums(a[:, None] * h, begins)
    return {"begins": begins, "h": h, "t": t, "g": g, "att": a, "z": z, "p": _sigmoid(z @ w["c"] + w["cb"])}


def _gradient(w: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    f = _forward(w, x, bag, len(y))
    d = (f["p"] - y) * weight / weight.sum()
    out = {"c": f["z"].T @ d, "cb": d.sum(keepdims=True)}
    dz = d[:, None] * w["c"]
    dh = f["att"][:, None] * dz[bag]
    da = (f["h"] * dz[bag]).sum(1)
    da = f["att"] * (da - _sums(f["att"] * da, f["begins"])[bag])
    out["a"] = (f["t"] * f["g"]).T @ da
    dt = da[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = da[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    out["v"], out["u"] = f["h"].T @ dt, f["h"].T @ dg
    dh += dt @ w["v"].T + dg @ w["u"].T
    dh *= f["h"] > 0
    out["e"], out["eb"] = x.T @ dh, dh.sum(0)
    return out


def fit_bags(x: np.ndarray, bag: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, seed: int = 7) -> Model:
    if len(y) == 0 or len(np.unique(y)) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(np.mean(y)) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(np.float32)
    init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    w = {"e": init(FEATURES, hidden), "eb": np.zeros(hidden), "v": init(hidden, gate), "u": init(hidden, gate), "a": init(gate, 1)[:, 0], "c": init(hidden, 1)[:, 0], "cb": np.zeros(1)}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    begins = np.searchsorted(bag, np.arange(len(y) + 1))
    balance = np.where(y == 1, 1.0, min(4.0, max(1.0, y.sum() / max(1, (1 - y).sum()))) ** 0.5)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = np.sort(order[at : at + batch])
            rows = np.concatenate([np.arange(begins[d], begins[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), begins[docs + 1] - begins[docs])
            grad = _gradient(w, x[rows], own, y[docs], balance[docs])
            step += 1
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            for k, g in grad.items():
                g = g + 1e-4 * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Model:
    """The model of labels (doc_id, quality) that aren't held out, from docs (doc_id, text)."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = chosen.where(~held_out(F.col("doc_id"))).withColumnRenamed("doc_id", "label_id")
    # twice as many are drawn, as some may have no text here; a bounded number of ids and bits
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(2 * sample)
    d = docs.select("doc_id", "text")
    d = d.join(F.broadcast(chosen), d["doc_id"] == chosen["label_id"]).select("doc_id", "y", "text")

    def encode(batches):
        for p in batches:
            texts = p["text"].tolist()
            for at, held in chunks(texts):
                x, bag = passages(held)
                ends = np.searchsorted(bag, np.arange(len(held) + 1))
                use = [np.unique(np.linspace(ends[i], ends[i + 1] - 1, most).astype(np.int64)) for i in range(len(held))]
                yield pd.DataFrame({"doc_id": p["doc_id"].iloc[at : at + len(held)], "y": p["y"].iloc[at : at + len(held)], "x": [x[rows].astype(np.float16).tobytes() for rows in use]})

    encoded = d.mapInPandas(encode, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    encoded = encoded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = encoded.toPandas()
    bags = [np.frombuffer(b, dtype=np.float16).astype(np.float32).reshape(-1, FEATURES) for b in got["x"]]
    if not bags:
        return fit_bags(np.empty((0, FEATURES)), np.empty(0, dtype=int), np.empty(0))
    return fit_bags(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), got["y"].to_numpy(dtype=float))


def score(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score_texts(texts.tolist()))

    return of(text)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs."""
    model = fit(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
