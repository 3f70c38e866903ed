import hashlib
import random
import re

from evalloom.llm.substring import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, length):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        if d is not None:
            for i in range(len(w) - length + 1):
                if first[tuple(w[i : i + length])] < d:
                    gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = [rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(9)) for _ in range(160)]
    rows = []
    for d in range(60):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 120))]
        if d % 3 == 0:
            a = rng.randrange(0, 90)
            w[10:10] = passage[a : a + rng.randrange(10, 70)]
        rows.append((d * 3 % 61, rng.choice([" ", "\n", "\t ", "  "]).join(w)))
    rows += [(100, None), (101, ""), (None, " ".join(passage)), (102, " ".join(passage)), (102, " ".join(passage)), (103, "x " * 300), (104, "x " * 99), (7, rows[9][1])]
    for length in (50, 8):
        got = remove_repeats(spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, tk string, longest int"), length)
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=str) == brute(rows, length)


def test_empty_table_and_levels(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"w{i}" for i in range(250))
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, text), (2, "a b " + text)], "doc_id long, text string")).collect()}
    assert got[1].longest == 0 and got[2].longest == 200 and got[2].kept_text == "a b"
    assert [(s.start, s.end) for s in got[2].spans] == [(2, 252)]
    assert hashlib.sha256(got[1].kept_text.encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
