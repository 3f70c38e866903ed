import json

import pytest
from pyspark.sql import functions as F

from evalloom.operators import normalize as N
from evalloom.operators import requests as R
from evalloom.sources import io
from evalloom.streaming import streams as S

ID = "quiz|123|control|0.0|0|open"


def frame(spark, *records):
    return N.records(spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), "f") for r in records], "value string, file string"))


def test_message_batch_records(spark):
    ok = {"id": "row", "custom_id": "x", "request": {"metadata": {"orig_custom_id": ID}}, "result": {"type": "succeeded", "message": {"id": "m-77", "content": [{"type": "text", "text": " Nine "}, "rivers\n", {"type": "tool"}], "usage": {"input_tokens": 31, "output_tokens": 6}, "stop_reason": "end_turn"}}}
    bad = {"customId": ID.replace("123", "124"), "result": {"type": "errored", "error": {}}}
    got = {r.item_id: r for r in N.predictions(frame(spark, ok, bad, {"no": "id"}, "{cut")).collect()}
    r = got["123"]
    assert (r.response_text, r.prompt_tokens, r.completion_tokens, r.total_tokens, r.request_id, r.finish_reason, r.failure) == ("Nine rivers", 31, 6, 37, "m-77", "end_turn", None)
    assert (got["124"].failure, got["124"].error_type, got["124"].error_message) == ("errored", "errored", N.NO_MESSAGE)
    assert got["124"].response_text == "" and len(got) == 2


def test_responses_and_chat_records(spark):
    a = {"custom_id": ID, "response": {"body": {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "un"}, {"type": "text", "text": "known"}], "finish_reason": "stop"}], "usage": {"input_tokens": 12, "output_tokens": 2, "total_tokens": 14}}}}
    b = {"custom_id": ID.replace("123", "2"), "response": {"body": {"choices": [{"message": {"content": ""}, "finish_reason": "length"}], "content": "not this"}, "usage": {"prompt_tokens": 3}}}
    c = {"custom_id": ID.replace("123", "3"), "response": {"body": {"output_text": " plain "}, "id": "r"}}
    d = {"custom_id": ID.replace("123", "4"), "response": {"body": {"output": [], "output_text": "\n\tplain\u2003\n", "status": "completed"}}}
    got = {r.item_id: r for r in N.predictions(frame(spark, a, b, c, d)).collect()}
    assert (got["123"].response_text, got["123"].finish_reason, got["123"].prompt_tokens) == ("unknown", "stop", 12)
    assert (got["2"].response_text, got["2"].finish_reason, got["2"].prompt_tokens, got["2"].total_tokens) == ("", "length", 3, 3)
    assert (got["4"].response_text, got["4"].finish_reason) == ("plain", "completed")


def test_combine_prefers_a_response(spark):
    f = N.records(spark.createDataFrame([(json.dumps({"custom_id": ID, "error": {"m": 1}}), "a"), (json.dumps({"custom_id": ID, "response": {"body": {}}}), "b")], "value string, file string"))
    assert [r.file for r in N.combine_parts(f).collect()] == ["b"]


def test_shards_of_eight_by_three(spark):
    rows = spark.range(8).select((F.col("id") + 1).alias("pos"), F.concat(F.lit("line é"), F.col("id").cast("string")).alias("line"))
    m = {r["shard"]: r for r in R.shard_manifest(R.assign_shard(rows, 3), "line", "pos", "shard", "suffix").collect()}
    assert [(m[i].lines, m[i].suffix) for i in range(3)] == [(3, ""), (3, "_part02"), (2, "_part03")] and m[2].bytes == 2 * 9
    parts = R.part_sizes(R.split_parts(rows.limit(2), 4), 4)
    assert [r.n for r in parts.orderBy("part").collect()] == [1, 1, 0, 0]


def test_safe_ids_and_limits(spark):
    ids = spark.createDataFrame([(1, "a|b"), (2, "a/b"), (3, "a_b_1"), (4, "x" * 70)], "pos int, custom_id string")
    got = {r.pos: r.safe_id for r in R.safe_custom_id(ids, "pos").collect()}
    assert len(set(got.values())) == 4 and got[1] == "a_b" and len(got[4]) == 49 and all(len(v) <= 64 for v in got.values())
    limit = lambda kind, m, a=False: spark.range(1).select(R.token_limit(F.lit(kind), F.create_map(*map(F.lit, m)) if m else F.create_map().cast("map<string,int>"), a)).first()[0]
    assert limit("open", ("open", 5, "default", 9)) == 5 and limit("odd", ("default", 9)) == 9 and limit("odd", ("open", 5)) is None
    assert limit("odd", ("open", 5), True) == 5 and limit("odd", (), True) == 1024


def test_numbered_equals_one_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).cast("string").alias("k"), "id")
    got = {(r.g, r.id): r.pos for r in R.numbered(df, ["g"], ["k", "id"], 8).collect()}
    rows = sorted(((r.g, r.k, r.id) for r in df.collect()))
    seen, want = {}, {}
    for g, _, i in rows:
        seen[g] = seen.get(g, 0) + 1
        want[g, i] = seen[g]
    assert got == want


def test_numbered_splits_a_hot_first_value_and_keeps_null_groups(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "g").alias("g"), F.lit("hot").alias("k"), "id")
    got = R.numbered(df, ["g"], ["k", "id"], 8)
    rows = {(r.g, r.id): r.pos for r in got.collect()}
    want = {(g, i): n for g in ("g", None) for n, i in enumerate((i for i in range(4000) if (i % 3 > 0) == (g == "g")), 1)}
    assert rows == want
    assert R.numbered(df.where("false"), ["g"], ["k", "id"]).collect() == []


def test_sources(spark, tmp_path):
    (tmp_path / "items.jsonl").write_text('{"dataset":"squad_v2","id":"ob1","question":"q","answers":["France"],"is_unanswerable":false}\n\n')
    assert io.read_items(spark, str(tmp_path / "items.jsonl")).first().item_key == "squad_v2|ob1"
    (tmp_path / "bad.jsonl").write_text("{cut\n")
    with pytest.raises(Exception):
        io.read_items(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "req.jsonl").write_text(json.dumps({"custom_id": ID, "body": {"messages": [{"role": "user", "content": "x"}]}}) + "\n{cut\n")
    assert io.read_requests(spark, str(tmp_path / "req.jsonl")).count() == 1
    parts = tmp_path / "parts" / "deep"
    parts.mkdir(parents=True)
    record = {"custom_id": ID, "response": {"body": {"choices": [{"message": {"content": 'a "b",\nc'}}]}}}
    (parts / "p1.jsonl").write_text(json.dumps(record) + "\n")
    (parts / "p2.jsonl").write_text(json.dumps(record) + "\n")
    (parts / "p3.txt").write_text(json.dumps({**record, "custom_id": "other"}) + "\n")
    both = io.read_parts(spark, str(tmp_path / "parts"))
    assert both.count() == 2
    p = N.predictions(N.combine_parts(both))
    io.write_predictions(p, str(tmp_path / "csv"), "csv")
    assert io.read_predictions(spark, str(tmp_path / "csv")).first().response_text == 'a "b",\nc'
    (tmp_path / "scores.csv").write_text("item_key,temp,em,f1\na,0.0,1.0,nan\nb,x,1,1\nc,0.7,oops,\n")
    assert [(r.item_key, r.em, r.f1) for r in io.read_scores(spark, str(tmp_path / "scores.csv")).collect()] == [("a", 1.0, None), ("c", 0.0, None)]
    usage = spark.createDataFrame([('[{"response":{"body":{"usage":{"prompt_tokens":5,"completion_tokens":"2"}}}},{"usage":{"input_tokens":1,"x":{"prompt_tokens":9}}}]',), ("{cut",), (None,)], "value string")
    assert sorted(map(tuple, io.read_usage(usage).collect())) == [(1, 0), (5, 2)]
    odd = ['{"a":[[{"input_tokens":"x","output_tokens":true}],[{"b":{"c":{"completion_tokens":"7.9"}}}]]}', '{"prompt_tokens":null,"output_tokens":1e400}', '{"prompt_tokens":{"input_tokens":3}}', "[]", "3", '"prompt_tokens"', '{"input_tokens":2,"prompt_tokens":" 4 "}']
    odd = spark.createDataFrame([(x,) for x in odd], "value string")
    by_level = io.read_usage(odd)
    assert sorted(map(tuple, by_level.collect())) == sorted(map(tuple, io.read_usage_rows(odd).collect())) == [(0, 0), (0, 0), (0, 1), (0, 7), (4, 0)]
    assert "Python" not in by_level._jdf.queryExecution().toString() and "Arrow" not in by_level._jdf.queryExecution().toString()
    shards = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (1, 3, "c")], "shard int, pos int, line string")
    io.write_shards(shards, str(tmp_path / "shards"))
    assert [r.value for r in spark.read.text(str(tmp_path / "shards" / "shard=0")).collect()] == ["a", "b"]


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = lambda i: json.dumps({"custom_id": ID.replace("123", str(i)), "response": {"body": {"choices": [{"message": {"content": f"t{i}"}}]}}})
    (src / "a.jsonl").write_text("\n".join(line(i) for i in range(5)) + "\n")
    run = lambda: S.run_available(S.stream_results(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "state"), conf=S.RESULTS_CONF)
    run()
    (src / "b.jsonl").write_text("\n".join(line(i) for i in range(3, 8)) + "\n{cut\n")
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.response_text for r in out.collect()) == [f"t{i}" for i in range(8)]
    # stubs after answers change nothing; an answer after a stub replaces it, over a restart too
    stub = lambda i: json.dumps({"custom_id": ID.replace("123", str(i)), "error": {"message": "m"}})
    (src / "c.jsonl").write_text("\n".join([stub(1), stub(20), stub(21)]) + "\n")
    run()
    (src / "d.jsonl").write_text("\n".join([line(20), stub(20), stub(22), line(22)]) + "\n")
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r.item_id: (r.response_text, r.failure) for r in S.latest(out).collect()}
    assert got == {**{str(i): (f"t{i}", None) for i in [*range(8), 20, 22]}, "21": ("", "error")}
    assert {r.item_id: r.revision for r in out.where("revision > 1").collect()} == {"20": 2}
    # the same as the batch form over all files
    lines = spark.read.text(str(src)).select("value", F.col("_metadata.file_path").alias("file"))
    batch = {r.item_id: (r.response_text, r.failure) for r in N.predictions(N.combine_parts(N.records(lines))).collect()}
    assert got == batch
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != next(iter(S.RESULTS_CONF.values()))


def test_digests_tell_rows_apart(spark):
    from evalloom.operators import prepare

    def digest(*rows):
        return prepare.dataset_manifest(spark.createDataFrame(list(rows), "a string, b string")).first().digest

    sets = [[("x", None)], [("x", "")], [("x1:", "y")], [("x", "1:y")], [("1:x", "")], [("", "1:x")], [("n;", "")], [(None, "")], [("a", "b"), ("c", "d")], [("a", "d"), ("c", "b")], [("a", "b")], [("a", "b")] * 2]
    assert len({digest(*x) for x in sets}) == len(sets)
    assert digest(("a", "b"), ("c", "d")) == digest(("c", "d"), ("a", "b"))


def test_changed_ranges_are_found_from_the_top(spark):
    from evalloom.operators import prepare

    before = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("x")).union(spark.createDataFrame([(None, "n")], "id long, x string"))
    now = before.where("id is null or (id not between 640 and 703 and id <> 4999)").withColumn("x", F.when(F.col("id") == 70, "other").otherwise(F.col("x"))).union(spark.createDataFrame([(9000, None)], "id long, x string"))
    trees = [prepare.range_digests(t, "id", 64) for t in (before, now)]
    assert sorted((r.range, r.status) for r in prepare.changed_ranges(*trees).collect()) == [(1, "changed"), (10, "gone"), (78, "changed"), (140, "new")]
    assert trees[0].where("level = 2").count() == 2 and prepare.changed_ranges(trees[0], trees[0]).count() == 0


def test_moments_merge_without_cancelling_and_files_stay_few(spark, tmp_path):
    import os
    import random
    import statistics

    rng = random.Random(6)
    rows = [("k", "open", "c", "0.0", i % 50, 1e8 + rng.random()) for i in range(500)]
    d = spark.createDataFrame(rows, "item_key string, type string, condition string, temp string, b int, em double")
    states = d.groupBy(*S.KEYS, "b").agg(F.count("*").alias("k"), *S.moments("em"))
    r = S.merged_moments(states, ("em",), *S.KEYS).first()
    x = [v[-1] for v in rows]
    assert r.k == r.em_n == 500 and abs(r.em_mean - statistics.fmean(x)) < 1e-7 and abs((r.em_m2 / 499) ** 0.5 - statistics.stdev(x)) < 1e-7

    items = spark.createDataFrame([("open", f"i{i}", "c", ["yes"], False) for i in range(3)], "type string, item_key string, context string, answers array<string>, is_unanswerable boolean")
    add = S.score_batch(items, str(tmp_path), every=5)
    every = []
    for b in range(18):
        batch = [("open", f"i{(b + i) % 3}", "control", "0.0", b, "yes" if (b + i) % 4 else "no") for i in range(2)]
        every += batch
        frame = spark.createDataFrame(batch, "type string, item_key string, condition string, temp string, sample_index int, response_text string")
        add(frame, b)
        if b in (5, 12):
            add(frame, b)  # a repeated batch counts once
    assert len([f for f in os.listdir(tmp_path) if "=" in f]) <= 12
    from evalloom.operators import score

    whole = score.aggregate_replicates(score.score_predictions(spark.createDataFrame(every, frame.schema), items))
    want = {r.item_key: (round(r.em, 12), round(r.em_std, 12), round(r.f1, 12), r.k) for r in whole.collect()}
    assert {r.item_key: (round(r.em, 12), round(r.em_std, 12), round(r.f1, 12), r.k) for r in S.merged_scores(spark, str(tmp_path)).collect()} == want
