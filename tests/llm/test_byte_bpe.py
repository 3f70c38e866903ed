import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from evalloom.llm import byte_bpe as B

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = [
    "Hello  world\n\tit's we're I'll THEY'VE o'clock 'tis ''s x'd  ", "", " ", "\n\n", "a", "'", "'s", " 's", "''s's", "don't  'stop\r\n 12 34½ x", "ß☃é 　 梦想 \U0001f600!!",
    "x" * 3000, "ab" * 2000 + " " * 50, "<|endoftext|> Ᲊ \U00010940", "tab\t word\n 'm 'lll 'ree", "\x1c\x1d a\x85b c",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(B.RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return B.Ranks(open(public_tokenizers.path(B.RANKS), "rb").read())


def test_pre_tokens_and_merges_as_the_library(library, ranks):
    rng = random.Random(5)
    classes = np.frombuffer(zlib.decompress(B.code_classes()), dtype=np.uint8)
    alphabet = list("''''sstmdrevlx  \n\t\r19½é梦.!-") + [" ", "\x85", "　", "\U0001f600", "\x00", "Ᲊ"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([c for c in (rng.randrange(0x3000), rng.randrange(0x110000)) if not 0xD800 <= c < 0xE000] or [65])) for _ in range(20)) for _ in range(300)]
    joined, codes, stops = B.code_points(texts)
    starts, ends = B.pre_tokens(codes, classes)
    number = np.searchsorted(stops, starts)
    got = [[] for _ in texts]
    for s, e, i in zip(starts.tolist(), ends.tolist(), number.tolist()):
        got[i] += ranks.encode(joined[s:e].encode())
    for t, x in zip(texts, got):
        assert x == library.encode_ordinary(t), t


def test_heap_and_list_merge_alike(ranks):
    rng = random.Random(6)
    for _ in range(200):
        w = "".join(rng.choice("aabthe rin") for _ in range(rng.randrange(2, 400))).encode()
        assert ranks._heaped(w) == ranks._listed(w)


def test_equal_hashes_do_not_join_words(monkeypatch):
    from evalloom.llm import common

    monkeypatch.setattr(common, "range_hashes", lambda c, s, e, which=0: (e - s).astype(np.uint64))
    _, codes, _ = B.code_points(["ab cd ab"])
    n, first = B.same_words(codes, np.array([0, 3, 6]), np.array([2, 5, 8]))
    assert n.tolist() == [0, 1, 0] and first.tolist() == [0, 1]


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (None, "a b", "x"), (0, TEXTS[0], "x"), (101, "word é " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for size in (1 << 24, 40):
        got = B.decoded(B.encoded(docs, size=size)).collect()
        assert len(got) == len(rows)
        want = sorted((str(d), np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for d, t, _ in rows)
        assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.bytes)) for r in got) == want
        assert all(r.n_tokens == len(r.ids) // 4 for r in got)


def test_empty_tables_and_unknown_ids(spark):
    none = B.encoded(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and B.decoded(none).count() == 0
    odd = spark.createDataFrame([(1, np.array([70000, 4294967295], dtype="<u4").tobytes()), (2, None), (3, b"")], "doc_id long, ids binary")
    assert {r.doc_id: r.bytes for r in B.decoded(odd).collect()} == {1: b"", 2: None, 3: b""}


def test_query_over_the_whole_table(spark, library):
    from evalloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()

