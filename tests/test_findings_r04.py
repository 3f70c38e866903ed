"""Cases of the findings of round 4, compared with plain Python."""

import hashlib
import os

import numpy as np
import pytest

from evalloom.operators import resample
from evalloom.plans import q_stats, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def flipped(rows, replicates, seed):
    """{group: p} of rows (group, item, delta), every eight signs of an item from a hash of their own."""
    found = {}
    for group in {g for g, _, _ in rows}:
        own = [(i, d) for g, i, d in rows if g == group and i is not None and d is not None]
        signs = np.array([[1 if hashlib.md5(f"{seed}|{r // 8}|{i}".encode()).digest()[2 * (r % 8)] >= 128 else -1 for r in range(replicates)] for i, _ in own])
        d = np.array([x for _, x in own])
        found[group] = 1.0 if abs(d.mean()) <= 1e-12 else float((abs(d @ signs / len(d)) >= abs(d.mean()) - 1e-12).mean())
    return found


@pytest.mark.parametrize("replicates", [1, 93, 1003])
def test_signs_come_from_a_hash_of_their_own(spark, replicates):
    """items of all lengths around one block of the hash, of any characters; more draws than ten or a hundred hashes give."""
    items = ["", "Ähre|1", "\0\0\0\0\0", *("x" * n for n in range(40, 60)), "y" * 200, *(f"nq|{i}" for i in range(60))]
    rows = [(g, i, float((k * 7 + len(g)) % 5 - 1.6)) for g in ("a", "bb") for k, i in enumerate(items)] + [("a", None, 9.0), ("a", "z", None), ("0", "u", 1.0), ("0", "v", -1.0)]
    d = spark.createDataFrame(rows, "k string, item_key string, delta double").repartition(3)
    got = {r.k: r.p for r in resample.permutation_keyed(d, replicates, 7, "k").collect()}
    assert got == pytest.approx(flipped(rows, replicates, 7), abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_query_hashes_every_item_for_every_eight_draws(spark):
    """the query and so its SQL, which test_queries compares with it."""
    deltas = q_stats._deltas(spark, SF).where("temp = 0 and type = 'open'").select("metric", "item_key", "delta").collect()
    got = {r.metric: r.p for r in registry.QUERIES["q_permutation_keyed"](spark, SF).where("temp = 0 and type = 'open'").collect()}
    assert len(got) == 5 and got == pytest.approx(flipped([tuple(r) for r in deltas], 5000, 2025), abs=1e-12)
