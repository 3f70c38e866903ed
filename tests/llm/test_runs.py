import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from evalloom.llm import runs as R


def brute(words, least=24, exponent=3):
    """Every stretch of every period, its smallest one tested by all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            length = e - s + q
            if e > s and length >= max(least, exponent * q) and not any(all(words[x] == words[x + d] for x in range(s, e + q - d)) for d in range(1, q)):
                out.append((s, length, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in drop]


def several(texts, least, exponent):
    numbers, first = R.number_words(texts)
    got = R.Factors(numbers, first).runs(least, exponent).tolist()
    out = [[] for _ in texts]
    for s, p, e in got:
        i = int(np.searchsorted(first, s, side="right")) - 1
        while first[i + 1] <= s:
            i += 1
        out[i].append((s - int(first[i]), e - s, p))
    return out


def test_all_runs_against_brute_force():
    rng = random.Random(12)
    texts = []
    for _ in range(1500):
        w = [rng.choice("ab" if rng.random() < 0.5 else "abcd").encode() for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice("abc").encode() for _ in range(rng.randrange(1, 14))]
            w += unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))]
            w += [rng.choice("abx").encode() for _ in range(rng.randrange(4))]
        texts.append(w)
    for least, exponent in ((24, 3), (6, 3)):
        got = several(texts, least, exponent)
        for w, g in zip(texts, got):
            assert g == brute(w, least, exponent), w
    assert sum(map(len, got)) > 1000
    assert several([[], [b"a"], [b"a"] * 24, [b"a"] * 23], 24, 3) == [[], [], [(0, 24, 1)], []]


def test_neighbouring_texts_do_not_join():
    assert several([[b"a"] * 20, [b"a"] * 20], 24, 3) == [[], []]


def test_very_long_texts():
    rng = random.Random(3)
    unit = [str(rng.random()).encode() for _ in range(50_000)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    found = several([unit * 3 + unit[:7], [b"x"] * 300_000, [c.encode() for c in fib[-1]]], 24, 3)
    assert found[0] == [(0, 150_007, 50_000)] and found[1] == [(0, 300_000, 1)] and len(found[2]) > 1000


def expected(doc_id, text):
    w = R.planted(doc_id, (text or "").encode().split())
    found = brute(w)
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return (doc_id, len(found), *top, top[1] and 1000 * top[1] // top[2], sha(lines), sha(b" ".join(kept(w, found))))


def test_table(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["la", "le", "lu", str(rng.random())]) for _ in range(rng.randrange(200))), "x") for i in ids]
    rows += [(1, None, "x"), (ids[0], "", "x"), (ids[1], " \n ", "x"), (None, "a " * 40, "x"), (None, None, "x"), (1, "é b\t" * 30, "x"), (1, "é b\t" * 30, "x"), (2, "a b " * 12 + "c d " * 12, "x"), (3, "no run here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    for size in (1 << 20, 50):
        got = R.digests(R.found_runs(docs, edit=R.planted, size=size)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str(expected(d, t)) for d, t, _ in rows)
    assert R.digests(R.found_runs(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_query_over_the_whole_table(spark):
    from evalloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) < 400}
    got = QUERIES["op12_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id in short:
            assert tuple(r) == expected(r.doc_id, short[r.doc_id])
    assert sum(r.n_runs for r in got) > 10
