import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalloom.llm.pieces import MODEL, Pieces


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeinorstl") for _ in range(rng.randrange(2, 9)))
    good = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = lambda: rng.choice([" | ".join(word() for _ in range(70)), " ".join(word().upper() + "!!" for _ in range(70))])
    rows = [(i, junk() if i % 6 == 0 else good(rng.randrange(20, 120)), rng.choice(["a", "b", None])) for i in range(300)]
    copy = rows[1][1] + " extra"
    rows += [(400, copy, "a"), (401, rows[1][1], "b"), (402, good(30) + " password = hunter2hunter2 end", "a"), (403, None, "b"), (404, "", "a")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(d, t, "en", s, len(t or ""), "kept") for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 6 == 0 else 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {d: t for d, t, _ in rows}


def test_stages(spark, corpus, tmp_path):
    path, texts = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append([r.asDict() for r in docs.collect()])
    ids = [{r["doc_id"] for r in k} for k in kept]
    good = {i for i in range(300) if i % 6}
    assert len(good - ids[0]) <= 5 and len([i for i in ids[0] if i < 300 and i % 6 == 0]) <= 2
    assert not ids[1] & {400, 401} and ids[1] == ids[0] - {400, 401}
    (secret,) = [r for r in kept[2] if r["doc_id"] == 402]
    assert secret["text"].endswith(" [SECRET] end") and secret["n_chars"] == len(secret["text"]) and ids[2] == ids[1]
    words = lambda k: sum(len((r["text"] or "").split()) for r in k)
    assert abs(words(kept[3]) - words(kept[2])) <= 9 and ids[3] <= ids[2]
    p = Pieces(open(MODEL, "rb").read())
    assert len(kept[4]) == len(kept[3]) and all(r["round_trip"] for r in kept[4])
    assert all(p.decode(r["ids"]) == texts[r["doc_id"]] for r in kept[4] if r["doc_id"] != 402)
    assert corpus_pipeline.run(spark, path).count() == len(kept[4])


def test_mix_takes_rows_not_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 7, i]), " ".join(["w"] * rng.choice([3, 7, 50, 51])), rng.choice(["a", "b", "c"]), rng.choice([None, "x"])) for i in range(600)]
    rows += [(None, "w w w w", "a", None)] * 150
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    target = {r.source: r.target for r in corpus_pipeline.mixed_sizes(docs.select("doc_id", "source", corpus_pipeline.n_words("text").alias("size")), carried=("source",)).select("source", "target").distinct().collect()}
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    got = sorted(map(tuple, got.collect()), key=str)
    taken = {s: sum(len(t.split()) for _, t, x, _ in got if x == s) for s in target}
    assert all(abs(taken[s] - target[s]) <= 3 for s in target), (taken, target)
    assert all(got.count(r) <= 3 * rows.count(r) for r in set(got))
    again = corpus_pipeline.mix_sources(spark, docs.orderBy(F.rand(3)).repartition(3), "")
    assert sorted(map(tuple, again.collect()), key=str) == got


def test_empty_tables_and_odd_ids(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    text = "one two three four five six seven password=hunter2hunter2"
    rows = [(7, text, "en", "a", 60), (7, text + " more", "en", "a", 65), (None, text, "en", None, 60), (None, "other words", None, "b", 11), (9, None, None, None, None), (9, "", "en", "a", 0)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, kinds)
        out = [stage(spark, docs, str(tmp_path)) for _, stage in corpus_pipeline.STAGES]
        counts = [o.count() for o in out]
        assert all(o.columns == docs.columns for o in out[:4])
        assert counts == [0] * 5 if not data else counts[1:3] == [6, 6] and counts[4] == 6
        if data:
            assert sorted(str(r.text) for r in out[2].collect()).count("one two three four five six seven [SECRET]") == 2
