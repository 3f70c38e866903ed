import datetime as dt
import random

from evalloom.llm.urls import judged


def brute(url, day, entries):
    import re

    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "")
    host = m[1].lower() if m else ""
    if not host or day is None:
        return host, False, None
    parts = host.split(".")
    for i in range(len(parts)):
        p = ".".join(parts[i:])
        log = [(d, {"block": 2, "allow": 1, "remove": 0}[a], a) for q, a, d in entries if q == p and d is not None and d <= day]
        if log and max(log)[2] != "remove":
            return host, max(log)[2] == "block", p
    return host, False, None


def test_against_brute_force(spark):
    rng = random.Random(2)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(30))
    hosts = ["a.example.com", "b.example.com", "x.a.example.com", "other.org"]
    entries = [(rng.choice([*hosts, "example.com", "com"]), rng.choice(["block", "allow", "remove"]), day()) for _ in range(40)] + [(None, "block", day()), ("other.org", "block", None)]
    captures = [(i, rng.choice(["http://", "https://me@"]) + rng.choice(hosts).upper() + rng.choice(["", "/p?q", ":80/x", "#t"]), day()) for i in range(300)]
    captures += [(900, None, day()), (901, "no url", day()), (902, "http://other.org/", None), (3, captures[3][1], captures[3][2])]
    got = judged(spark.createDataFrame([(*c, "z") for c in captures], "id long, url string, fetched date, pattern string"), spark.createDataFrame(entries, "pattern string, action string, listed date"))
    want = [(i, *brute(u, d, entries)) for i, u, d in captures]
    assert sorted(((r.id, r.host, r.blocked, r.pattern) for r in got.collect()), key=str) == sorted(want, key=str)
    assert judged(spark.createDataFrame([], "id long, url string, fetched date"), spark.createDataFrame([], "pattern string, action string, listed date")).count() == 0
