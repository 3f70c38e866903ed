import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalloom.llm import alignment as L
from evalloom.llm.byte_bpe import public

pytest.importorskip("public_tokenizers")
pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

TEXTS = [
    "Hello  world\n\tit's fine", "", " ", "a", "ab ab ab", "  two", "end ", "end  ", "x\n y \n\nz", "x\n \nfoo bar", "ß☃é 梦想 \U0001f600!! donaudampfschiff", "<|endoftext|> </s> <s> <unk> <0x0A>",
    "a▁b literal", "tab\there  \t there", "q" * 900, "aGVsbG8gd29ybGQ=" * 60, " nbsp   x", "nul\x00 char", "the cat sat on the mat, the end.", "\n", "12 3456 7.8%",
]


@pytest.fixture(scope="module")
def pair():
    return L.Pair(open(public(L.A_FILE), "rb").read(), open(public(L.B_FILE), "rb").read())


def groups(p, text):
    """Whole texts, token by token."""
    if not text:
        return []
    a = p.a.encode(" " + text, add_special_tokens=False).ids
    b = p.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(p.bytes_a[i] for i in a) != whole or b"".join(p.bytes_b[i] for i in b) != whole:
        return []
    out, i, j = [], 0, 0
    while i < len(a):
        x, y, ga, gb = 0, 0, [], []
        while not x or x != y:
            if x <= y:
                x, i = x + len(p.bytes_a[a[i]]), i + 1
                ga.append(a[i - 1])
            else:
                y, j = y + len(p.bytes_b[b[j]]), j + 1
                gb.append(b[j - 1])
        out.append((ga, gb))
    return out


def brute(p, rows):
    every = [groups(p, t) for _, t in rows]
    links = [Counter((x, y) for ga, gb in g for x in ga for y in gb) for g in every]
    count = Counter(k for own in links for k in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (d, _), g, own in zip(rows, every, links):
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in g)
        out.append((
            d, sum(len(ga) for ga, _ in g), sum(len(gb) for _, gb in g), len(g), sum(own.values()),
            sum(n for k, n in own.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


def test_bytes_of_tokens(pair):
    assert pair.bytes_a[220] == b" " and pair.bytes_b[pair.b.piece_to_id("<0x0A>")] == b"\n" and pair.bytes_b[pair.b.piece_to_id("▁the")] == b" the"
    same = [i for i in range(pair.n_a) if pair.same[i] >= 0]
    assert len(same) > 10_000 and all(pair.bytes_a[i] == pair.bytes_b[pair.same[i]] for i in same)


def test_parts_are_cut_by_both(pair):
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice(["the", "cat", " ", " ", " ", "\n", "\t", "é", "x", "'s", "9", "▁", ".", " "]) for _ in range(rng.randrange(1, 14)))
        parts = pair.parts(t)
        assert "".join(parts) == " " + t
        if "▁" in t:
            continue
        a = [i for q in parts for i in pair.a.encode(q, add_special_tokens=False).ids]
        b = [i for q in parts for i in pair.b.encode(q[1:])]
        assert a == pair.a.encode(" " + t, add_special_tokens=False).ids and b == pair.b.encode(t), t


def test_table_against_brute_force(spark, pair):
    rng = random.Random(7)
    words = "the cat Donau schiff élève habitación über running xqzt foo.bar 12,5 (hello) naïve 梦 ok\nnext".split(" ")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(200 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(120)]
    rows += [(100, None), (None, "the cat"), (0, TEXTS[0]), (0, TEXTS[0]), (101, "habitación der donau " * 4000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_a string")
    want = sorted(map(str, brute(pair, rows)))
    for size in (1 << 24, 300):
        assert sorted(str(tuple(r)) for r in L.aligned(docs, size=size).collect()) == want


def test_parts_of_several_texts_are_encoded_together(pair):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["the", "cat", " ", " ", " ", "\n", "é", "x", "9", ".", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    every = list({p for t in texts for p in pair.parts(t)})
    rng.shuffle(every)
    have = dict(zip(every, pair.of(every)))
    for t in texts:
        assert "".join(have[p][4] for p in pair.parts(t))[:-1] == ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups(pair, t)), t


def test_groups_of_many_tokens_and_small_caches(spark, pair, monkeypatch):
    monkeypatch.setattr(L, "KEPT", 2)
    for t in ["z" * 400 + "日" * 100, "a b c", "日" * 3000, "a b c d", "c b"]:
        got, shown = Counter(), ""
        parts = pair.parts(t)
        have = dict(zip(set(parts), pair.of(list(set(parts)))))
        pair.remember(have)
        for x in parts:
            shown += have[x][4]
            for k, n in zip(np.frombuffer(have[x][5], dtype=np.int64).tolist(), np.frombuffer(have[x][6], dtype=np.int64).tolist()):
                got[divmod(k, pair.n_b)] += n
        want = groups(pair, t)
        assert got == Counter((x, y) for ga, gb in want for x in ga for y in gb)
        assert shown[:-1] == ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in want)


def test_empty_tables(spark):
    assert L.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = L.aligned(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_over_the_whole_table(spark, pair):
    from evalloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op13_tokenizer_alignment"](spark, sf).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, brute(pair, rows)))
