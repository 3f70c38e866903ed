import hashlib
import random

import numpy as np

from evalloom.llm.fingerprints import _GEAR, LEAST, LOOSE, MOST, NORMAL, REACH, STRICT, cuts, edited, fingerprint, fingerprints, written_out, containment


def brute_cuts(data):
    """One byte after another."""
    out, at, n = [], 0, len(data)
    hashes, h = [], 0
    for i in range(n):
        h = sum(int(_GEAR[data[i - k]]) << k for k in range(min(REACH, i + 1))) & 0xFFFFFFFF
        hashes.append(h)
    while n - at > LEAST:
        end = min(n, at + MOST)
        for e in range(at + LEAST, min(n, at + MOST) + 1):
            if (e <= at + NORMAL and hashes[e - 1] & int(STRICT) == 0) or (e >= at + NORMAL and hashes[e - 1] & int(LOOSE) == 0):
                end = e
                break
        at = end
        out.append(at)
    return out + [n] * (at < n)


def test_cuts_against_brute_force():
    rng = random.Random(1)
    for n in (0, 1, 12, 13, 200, 3000):
        data = bytes(rng.randrange(97, 123) for _ in range(n))
        assert cuts(data) == brute_cuts(data)
    assert cuts(b"a" * 1000) == brute_cuts(b"a" * 1000)


def test_an_edit_is_local():
    rng = random.Random(2)
    t = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(800))
    f = fingerprint(t)
    assert containment(f, f) == 1 and containment(f, fingerprint("x" + t)) > 0.95 and containment(f, fingerprint(t[:2000] + "new words" + t[2000:])) > 0.95
    sizes = np.diff([0, *cuts(t.encode())])
    assert sizes.max() <= MOST and 25 < sizes.mean() < 60


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    rows = [(i * 17 % 3001 - 50, " ".join(word() for _ in range(rng.choice([0, 1, 5, 80, 300])))) for i in range(1000)]
    rows += [(5000, None), (None, "zz " * 40), (rows[3][0], "another text of this id"), (6000, "x" * 200_000)]
    rows += [(7000, f"hot {i} " * 30) for i in range(50)] + [(None, f"hot {i} " * 20) for i in range(50)] + [(7001, "same " * 50)] * 5 + [(2**60 + 1, "large id")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, part int, lead int")
    th = {r.t: r.h for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), th[r[1]]))
    want = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        f = fingerprint(t)
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), written_out(f), written_out(fingerprint(new)), containment(f, fingerprint(new)), containment(f, fingerprint(nxt))))
    for part_bytes in (1 << 21, 20_000, 2_000):
        assert sorted(map(tuple, fingerprints(df, part_bytes).collect()), key=str) == sorted(want, key=str)


def test_a_third_of_equal_rows_is_dealt_out(spark):
    from evalloom.llm.fingerprints import with_next

    same = spark.range(100_000).selectExpr("cast(null as long) AS doc_id", "'the same text of all of these' AS text")
    df = same.unionByName(spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
    dealt = with_next(df, 20_000)
    assert dealt.where("more = 0").count() < 3000 and dealt.where("more > 0").agg({"more": "sum"}).first()[0] > 98_000
    got = fingerprints(df, 20_000)
    assert got.count() == 101_000
    hot = got.where("doc_id is null").groupBy("near_next", "edited_sha256").count().collect()
    assert sorted(r["count"] for r in hot) == [1, 99_999] and max(r.near_next for r in hot) == 1.0


def test_small_tables(spark):
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (r,) = fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(edited("abcdef", "abcdef").encode()).hexdigest()
