import random

import pytest
from pyspark.sql import functions as F

from evalloom.llm.pieces import MODEL, Pieces, decoded, encoded

TEXTS = ["Hello  world\n\tß☃ é", "", " ", "   lead and trail   ", "x" * 50, "\U0001f600 梦想 á", "The quick brown fox, 12345!", "▁ literal", "a\u0000b", "éèç " * 200]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(open(MODEL, "rb").read())


def brute(p, word):
    """Scalar Viterbi over a dictionary."""
    ids = {x: i for i, (x, k) in enumerate(zip(p.pieces, p.kinds)) if k in (1, 4)}
    best = [(0.0, [])]
    for e in range(1, len(word) + 1):
        options = []
        for s in range(max(0, e - p.longest), e):
            x = word[s:e]
            if x in ids:
                options.append((best[s][0] + p.scores[ids[x]], s, [ids[x]]))
            elif e - s == 1:
                options.append((best[s][0] + p.unknown_score, s, p._bytes(x)))
        top = max(o[0] for o in options)
        o = max((o for o in options if o[0] == top), key=lambda o: o[1])
        best.append((o[0], best[o[1]][1] + o[2]))
    return best[-1]


def total(p, ids):
    return sum(p.scores[i] for i in ids if p.kinds[i] != Pieces.BYTE)


def test_best_sum_against_brute_force(pieces):
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choice("thaeinosr.é梦|x0") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    for w, got in zip(words, pieces.segment(words)):
        _, want = brute(pieces, w)
        assert "".join(pieces.pieces[i] for i in got if pieces.kinds[i] == 1) == w or any(pieces.kinds[i] == Pieces.BYTE for i in got)
        assert total(pieces, got) == total(pieces, want), w


def test_long_words_against_brute_force(pieces):
    rng = random.Random(14)
    words = ["".join(rng.choice("thaeinosr.é梦x0") for _ in range(n)) for n in (63, 64, 65, 65, 200, 333)] + ["x" * 500, "日" * 300]
    for w, got in zip(words, pieces.segment(words)):
        assert list(got) == brute(pieces, w)[1], w


def test_unspaced_text_in_linear_time(pieces):
    import time

    for t in ("x" * 200_000, "日本語の文章が続く" * 20_000):
        began = time.process_time()
        ids = pieces.encode([t])[0]
        assert time.process_time() - began < 5 and pieces.decode(ids) == t
        pieces.cache.clear()


def test_decode_of_any_ids(pieces):
    e = pieces._bytes("é")
    assert pieces.decode([-1, 10**6, 2**31 - 1]) == "" and pieces.decode(e[:1]) == "\ufffd" and pieces.decode([*e, -5]) == "é" and pieces.decode([]) == ""


def test_same_sums_as_the_library_with_the_same_pieces(pieces):
    sp = pytest.importorskip("sentencepiece")

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces, segmented by the sum of the scores they have here
    for piece, score in zip(m.pieces, pieces.scores):
        piece.score = score
    lib = sp.SentencePieceProcessor(model_proto=m.SerializeToString())
    rng = random.Random(9)
    texts = TEXTS[:8] + [" ".join("".join(rng.choice("thaeinosrdl") for _ in range(rng.randrange(1, 14))) for _ in range(3)) for _ in range(200)]  # short: the library sums in 32 bits
    for t in texts:
        mine, theirs = pieces.encode([t])[0].tolist(), lib.encode(t)
        assert total(pieces, mine) == pytest.approx(total(pieces, theirs)), t
        assert pieces.decode(mine) == t.replace("▁", " ")


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (None, "a", "x"), (0, TEXTS[0], "x"), (101, "é" * 30000, "x")]
    got = encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), batch=64)
    back = {r.doc_id: r for r in got.select("*", decoded(F.col("ids")).alias("t")).collect()}
    assert got.count() == len(rows) and back[100].ids is None and back[100].round_trip is None
    for i, t in enumerate(TEXTS):
        assert back[i].t == (t if "▁" not in t else t.replace("▁", " ")) and back[i].n_tokens == len(back[i].ids)
    assert encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
