"""Queries of the text functions and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.functions import text as T
from evalloom.operators import score
from evalloom.plans import fixtures as X
from evalloom.plans.base import query
from evalloom.sources.shared import stored

_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_PUNCT = T.PUNCTUATION.replace("'", "''")


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower(coalesce({x}, '')), '{_PUNCT}', ''), '{_SPACE}'), lambda z: z <> '' AND z NOT IN ('a', 'an', 'the'))"


def norm(x: str) -> str:
    return f"array_to_string({toks(x)}, ' ')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({norm(x)}, '[^\p{{L}}\p{{N}}_]+'), lambda z: z <> '')"


def f1(p: str, t: str) -> str:
    """Of two token lists."""
    common = f"list_sum(list_transform(list_distinct({p}), lambda x: least(len(list_filter({p}, lambda y: y = x)), len(list_filter({t}, lambda y: y = x)))))"
    return f"CASE WHEN len({p}) = 0 AND len({t}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({t}) = 0 OR {common} = 0 THEN 0.0 ELSE 2.0 * ({common} / len({p})) * ({common} / len({t})) / ({common} / len({p}) + {common} / len({t})) END"


def abstains(x: str, mode: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m.replace(chr(39), chr(39) * 2)}')" for m in T.markers_of(mode)) + ")"


_WITH = f"WITH {X.TEXT_PREDS}"
_JOIN = f"""{_WITH},
j AS (SELECT p.*, i.context, i.answers, i.is_unanswerable FROM tpreds p JOIN items i USING (type, item_key)),
t AS (SELECT *, {toks("response_text")} AS pt, {toks("answers[1]")} AS t1, {toks("answers[2]")} AS t2 FROM j),
u AS (SELECT *, array_to_string(pt, ' ') AS np, array_to_string(t1, ' ') AS n1, array_to_string(t2, ' ') AS n2 FROM t)"""


def _joined(spark, sf_dir):
    items = X.text_items(spark, sf_dir)
    return X.text_predictions(items).join(items.select("type", "item_key", "context", "answers", "is_unanswerable"), ["type", "item_key"])


_KEY = ("type", "item_key", "condition", "sample_index")


@query("q_clean_text", rf"SELECT doc_id, trim(regexp_replace(text, '{_SPACE}', ' ', 'g')) AS clean FROM documents")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("q_normalize_answer", f"SELECT doc_id, {norm('text')} AS normal FROM documents")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.normalize_answer(F.col("text")).alias("normal"))


@query("q_tokens", f"SELECT doc_id, len({words('text')})::BIGINT AS n_tokens, md5(array_to_string({words('text')}, '|')) AS digest FROM documents")
def _(spark, sf_dir):
    w = T.word_tokens(F.col("text"))
    return X.table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, "|")).alias("digest"))


@query("q_token_f1", f"{_JOIN} SELECT type, item_key, condition, sample_index, round({f1('pt', 't1')}, 9) AS f1 FROM u")
def _(spark, sf_dir):
    return _joined(spark, sf_dir).select(*_KEY, F.round(T.token_f1(F.col("response_text"), F.col("answers")[0]), 9).alias("f1"))


@query("q_exact_match", f"{_JOIN} SELECT type, item_key, condition, sample_index, np = n1 AS em FROM u")
def _(spark, sf_dir):
    return _joined(spark, sf_dir).select(*_KEY, T.exact_match(F.col("response_text"), F.col("answers")[0]).alias("em"))


@query("q_best_truth", f"{_JOIN} SELECT type, item_key, condition, sample_index, CASE WHEN np = n1 OR np = n2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em, round(greatest({f1('pt', 't1')}, {f1('pt', 't2')}), 9) AS f1 FROM u")
def _(spark, sf_dir):
    return _joined(spark, sf_dir).select(*_KEY, T.best_em(F.col("response_text"), F.col("answers")).alias("em"), F.round(T.best_f1(F.col("response_text"), F.col("answers")), 9).alias("f1"))


for _mode, _name in (("reference", "q_abstention_ref"), ("fixed", "q_abstention_fixed")):

    @query(_name, f"{_JOIN} SELECT type, item_key, condition, sample_index, {abstains('np', _mode)} AS abstained FROM u")
    def _(spark, sf_dir, mode=_mode):
        return _joined(spark, sf_dir).select(*_KEY, T.is_abstention(F.col("response_text"), mode).alias("abstained"))


_OPEN = f"""{_JOIN}, o AS (SELECT *, {norm("context")} AS nc, {words("response_text")} AS pw, {words("context")} AS cw FROM u WHERE type = 'open')"""
_BASE = "(np <> '' AND contains(nc, np))"
_SHARE = "CASE WHEN len(pw) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(pw, lambda z: list_contains(cw, z))) / len(pw) END"


def _open(spark, sf_dir):
    """Open answers with their contexts, normalised once an item."""
    items = X.text_items(spark, sf_dir)
    of = items.select("type", "item_key", "context", "answers", "is_unanswerable", *T.input_columns(list(T.OF_CONTEXT), F.col("context")))
    return X.text_predictions(items).join(of, ["type", "item_key"]).where("type = 'open'")


@query("q_support_baseline", f"{_OPEN} SELECT type, item_key, condition, sample_index, CASE WHEN {_BASE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS supported FROM o")
def _(spark, sf_dir):
    return _open(spark, sf_dir).select(*_KEY, T.support_baseline(F.col("response_text"), F.col("context"), F.col("context_normal")).alias("supported"))


@query("q_support_overlap", f"{_OPEN} SELECT type, item_key, condition, sample_index, round({_SHARE}, 9) AS overlap FROM o")
def _(spark, sf_dir):
    return _open(spark, sf_dir).select(*_KEY, F.round(T.support_overlap(F.col("response_text"), F.col("context"), F.col("context_words")), 9).alias("overlap"))


@query("q_unsupported", f"{_OPEN} SELECT type, item_key, condition, sample_index, CASE WHEN {abstains('np', 'fixed')} THEN 0.0::DOUBLE WHEN {_BASE} OR {_SHARE} >= 0.6 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unsupported FROM o")
def _(spark, sf_dir):
    abst = T.is_abstention(F.col("response_text")).cast("double")
    o = _open(spark, sf_dir)
    return o.select(*_KEY, T.is_unsupported(F.col("response_text"), F.col("context"), abst, 0.5, "combined", ready=o.columns).alias("unsupported"))


@query("q_sweep_thresholds", f"{_OPEN} SELECT type, item_key, condition, sample_index, threshold, CASE WHEN {abstains('np', 'fixed')}::INTEGER >= threshold THEN 0.0::DOUBLE WHEN {_BASE} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS unsupported FROM o, (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS threshold)")
def _(spark, sf_dir):
    abst = T.is_abstention(F.col("response_text")).cast("double")
    p = T.sweep_thresholds(_open(spark, sf_dir), F.col("response_text"), F.col("context"), abst, [0.0, 0.5, 1.0])
    return p.select(*_KEY, "threshold", "unsupported")


def _near_start(prediction, context, min_overlap, unanswerable, normal, words):
    """A strategy of one's own: the answer stands near the context's start, or half of its words anywhere if the item has no answer."""
    early = T.once(T.normalize_answer(prediction), lambda p: (p != "") & F.contains(F.left(normal, F.lit(200)), p))
    return early | (unanswerable & (T.support_overlap(prediction, context, words) >= min_overlap))


T.register_support("near_start", _near_start, inputs=("is_unanswerable", *T.OF_CONTEXT))
_NEAR = f"(np <> '' AND contains(left(nc, 200), np)) OR (is_unanswerable AND {_SHARE} >= 0.5)"


@query("q_support_custom", f"""{_OPEN}, s AS (SELECT *, CASE WHEN {abstains('np', 'fixed')} THEN 1 ELSE 0 END AS gone, CASE WHEN {_NEAR} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS bad FROM o)
SELECT type, item_key, condition, sample_index, threshold, CASE WHEN gone >= 0.5 THEN 0.0::DOUBLE ELSE bad END AS unsupported, CASE WHEN gone >= threshold THEN 0.0::DOUBLE ELSE bad END AS swept FROM s, (SELECT unnest([0.0, 1.0])::DOUBLE AS threshold)""")
def _(spark, sf_dir):
    """Scores and a sweep by a registered strategy that reads a column of the items."""
    items = X.text_items(spark, sf_dir)
    scored = score.score_predictions(X.text_predictions(items), items, "near_start", 0.5).where("type = 'open'").select(*_KEY, "unsupported")
    abst = T.is_abstention(F.col("response_text")).cast("double")
    swept = T.sweep_thresholds(_open(spark, sf_dir), F.col("response_text"), F.col("context"), abst, [0.0, 1.0], "near_start", 0.5)
    return scored.join(swept.select(*_KEY, "threshold", F.col("unsupported").alias("swept")), list(_KEY))


@query("q_grounded_benchmark", f"""WITH d AS (SELECT doc_id, {norm("text")} AS n FROM documents), b AS (SELECT item_id, {norm("text")} AS n FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON b.n <> '' AND contains(d.n, b.n)""")
def _(spark, sf_dir):
    """Which benchmark texts stand in which documents: candidates share a run of up to three whole words, then the exact test.

    Documents are normalised once for the runs; of the texts only candidates' are read again.
    """
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    b = X.table(spark, sf_dir, "benchmark").select("item_id", T.normal_tokens(F.col("text")).alias("bt")).where("size(bt) > 0")
    b = stored(b.select("*", F.array_join("bt", " ").alias("bn"), F.size("bt").alias("n")), "texts")
    inner = stored(b.where("n > 2").select("item_id", F.slice("bt", 2, F.col("n") - 2).alias("i")), "inner")  # the first and last may be parts of words
    of = F.when(F.size("i") >= RUN, _runs(F.col("i"), RUN)).when(F.size("i") == 2, _runs(F.col("i"), 2)).otherwise(_runs(F.col("i"), 1))
    keys = stored(inner.select("item_id", F.array_max(of).alias("r")).select("item_id", "r.len", "r.key"), "keys")  # the longest run looks rarest
    lengths = [r[0] for r in keys.select("len").distinct().collect()]  # at most RUN numbers
    near = _candidates(d, keys, lengths).union(_short(d, b.where("n < 3").select("item_id", "bt")))
    near = stored(near.distinct(), "near")
    found = d.join(near.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.normalize_answer(F.col("text")).alias("text"))
    return near.join(found, "doc_id").join(b.select("item_id", "bn"), "item_id").where(F.contains("text", F.col("bn"))).select("doc_id", "item_id")


#: Words of the runs that candidates share: fewer only where a text has fewer whole ones.
RUN = 3


def _runs(tokens, n):
    """All runs of n neighbours of tokens: their letters, n, and a hash. Words are read by their places: a slice would copy the whole array each time."""
    words = lambda i: [tokens[i + k] for k in range(n)]
    run = lambda i: F.struct(F.length(F.concat(*words(i))).alias("letters"), F.lit(n).alias("len"), F.xxhash64(*words(i)).alias("key"))
    return _each(tokens, n, run)


def _each(tokens, n, of):
    """of(place) for the start of each run of n neighbours; none of fewer tokens."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), lambda i: i + n <= F.size(tokens)), of)


def _candidates(d, keys, lengths):
    """doc_id and item_id where a document has the run of a text."""
    if not lengths:
        return keys.select(F.lit(0).cast("long").alias("doc_id"), "item_id").limit(0)
    runs = d.select("doc_id", F.explode(T.once(T.normal_tokens(F.col("text")), lambda t: F.concat(*(_runs(t, n) for n in lengths)))).alias("r"))
    return runs.select("doc_id", "r.len", "r.key").join(keys, ["len", "key"]).select("doc_id", "item_id")


def _short(d, b):
    """Texts of one or two words can begin or end inside of words: different words that hold one, or end with its first, are found by a few of its characters."""
    one = b.where("size(bt) = 1").select("item_id", F.col("bt")[0].alias("w")).withColumn("g", F.left("w", F.lit(3)))
    two = b.where("size(bt) = 2").select("item_id", F.col("bt")[0].alias("u"), F.col("bt")[1].alias("v")).withColumn("g", F.right("u", F.lit(3)))
    none = b.select(F.lit(0).cast("long").alias("doc_id"), "item_id").limit(0)
    if b.isEmpty():
        return none
    tokens = T.normal_tokens(F.col("text"))
    words = d.select("doc_id", F.explode(F.array_distinct(tokens)).alias("key"))
    known = stored(words.select("key").distinct(), "known")
    # a lambda's second parameter would be the place of its element, so the length is bound outside
    pieces = lambda n: F.when(F.length("key") >= n, F.transform(F.sequence(F.lit(1), F.length("key") - n + 1), lambda i: F.substring("key", i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    holds = known.select("key", F.explode(F.array_distinct(F.flatten(F.array(*(pieces(n) for n in (1, 2, 3)))))).alias("g"))
    holds = holds.join(one, "g").where(F.contains("key", F.col("w"))).select("key", "item_id")
    found = words.join(stored(holds, "holds"), "key").select("doc_id", "item_id").distinct()
    if two.isEmpty():
        return found
    ends = lambda w: F.filter(F.array(*(F.when(F.length(w) >= n, F.right(w, F.lit(n))) for n in (1, 2, 3))), lambda g: g.isNotNull())
    firsts = known.select(F.col("key").alias("x"), F.explode(ends(F.col("key"))).alias("g")).join(two, "g").where(F.endswith("x", F.col("u"))).select("x", "v", "item_id")
    pairs = d.select("doc_id", F.explode(T.once(tokens, lambda t: F.array_distinct(_each(t, 2, lambda i: F.struct(t[i].alias("x"), t[i + 1].alias("y")))))).alias("p"))
    pairs = pairs.select("doc_id", "p.x", "p.y").join(stored(firsts, "firsts"), "x").where(F.startswith("y", F.col("v")))
    return found.union(pairs.select("doc_id", "item_id").distinct())


_DOC = f"d AS (SELECT doc_id, {X._PART(1, 6)} AS head, {X._PART(3, 3)} AS a1, {X._PART(3, 2)} AS a2, text FROM documents WHERE text IS NOT NULL)"


def _parts(spark, sf_dir):
    w = F.filter(F.split("text", X.WORDS), lambda t: t != "")
    part = lambda i, n: F.array_join(F.slice(w, i, n), " ")
    return X.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", part(1, 6).alias("head"), part(3, 3).alias("a1"), part(3, 2).alias("a2"))


@query("q_content_text", f"WITH {_DOC} SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN array_to_string(list_filter([a1, a2, head], lambda x: x <> ''), chr(10)) WHEN 2 THEN '[' || text ELSE '' END) AS digest FROM d")
def _(spark, sf_dir):
    """Strings, lists of strings and blocks, strings that only look like a list, and none."""
    i, block = F.col("doc_id") % 4, lambda c: F.to_json(F.struct(F.lit("text").alias("type"), F.col(c).alias("text")))
    quoted = F.regexp_extract(F.to_json(F.array("a1")), r"(?s)^\[(.*)\]$", 1)
    listed = F.concat(F.lit("["), F.concat_ws(",", quoted, block("a2"), F.lit('{"type":"image"}'), block("head")), F.lit("]"))
    v = F.when(i == 0, F.col("text")).when(i == 1, listed).when(i == 2, F.concat(F.lit("["), "text"))
    return _parts(spark, sf_dir).select("doc_id", F.md5(T.content_to_text(v)).alias("digest"))


@query("q_estimate_messages", rf"WITH {_DOC} SELECT doc_id, greatest(len(list_filter(regexp_split_to_array(concat_ws(' ', a1, a2, head, 'x y', 'z'), '{_SPACE}'), lambda z: z <> '')), 1)::BIGINT AS n FROM d")
def _(spark, sf_dir):
    """Content as a string, as a list of blocks, as one block, and a role without any."""
    s = F.struct
    whole = s(s(F.lit("user").alias("role"), F.concat_ws("\n", "a1", "a2").alias("content")).alias("m1"), s(F.array(s(F.col("head").alias("text")), s(F.lit("x y").alias("text"))).alias("content")).alias("m2"), s(s(F.lit("z").alias("text")).alias("content")).alias("m3"), s(F.lit("user").alias("role")).alias("m4"))
    v = F.to_variant_object(whole)
    messages = F.parse_json(F.concat(F.lit("["), F.concat_ws(",", *(F.to_json(F.try_variant_get(v, f"$.m{k}", "variant")) for k in (1, 2, 3, 4))), F.lit("]")))
    return _parts(spark, sf_dir).select("doc_id", T.estimate_message_tokens(messages).cast("long").alias("n"))


@query("q_temp_label", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '0' || o_orderkey % 5 END AS label FROM orders")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "orders").select("o_orderkey", T.temp_label((F.col("o_orderkey") % 5) / 10.0).alias("label"))


@query("q_estimate_tokens", rf"SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(len(list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda z: z <> '')), 1) ELSE 0 END::BIGINT AS n FROM documents")
def _(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).cast("long").alias("n"))


_SCORES = f"""{_JOIN},
s AS (SELECT *, {abstains("np", "fixed")} AS ab, CASE WHEN np = n1 OR np = n2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS em0, greatest({f1("pt", "t1")}, {f1("pt", "t2")})::DOUBLE AS f0, {norm("context")} AS nc FROM u),
sc AS (SELECT type, dataset, item_key, condition, temp, sample_index, is_unanswerable AND type = 'open' AS un, ab::INTEGER::DOUBLE AS abstained,
  CASE WHEN type = 'open' AND is_unanswerable THEN ab::INTEGER::DOUBLE ELSE em0 END AS em,
  CASE WHEN type = 'open' AND is_unanswerable THEN ab::INTEGER::DOUBLE WHEN type = 'open' THEN f0 END AS f1,
  CASE WHEN type = 'open' AND is_unanswerable THEN (NOT ab)::INTEGER::DOUBLE WHEN type = 'open' THEN 0.0::DOUBLE END AS false_answer,
  CASE WHEN type = 'open' THEN CASE WHEN ab THEN 0.0::DOUBLE WHEN np <> '' AND contains(coalesce(nc, ''), np) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS unsupported FROM s)"""
_FIELDS = "type, item_key, condition, sample_index, em, round(f1, 9) AS f1, abstained, false_answer, unsupported"


def _scored(spark, sf_dir):
    items = X.text_items(spark, sf_dir)
    return score.score_predictions(X.text_predictions(items), items)


@query("q_score_closed", f"{_SCORES} SELECT type, item_key, condition, sample_index, em, abstained FROM sc WHERE type = 'closed'")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).where("type = 'closed'").select(*_KEY, "em", "abstained")


@query("q_score_open", f"{_SCORES} SELECT {_FIELDS} FROM sc WHERE type = 'open'")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).where("type = 'open'").select(*_KEY, "em", F.round("f1", 9).alias("f1"), "abstained", "false_answer", "unsupported")


@query("q_per_item_text", f"""{_SCORES} SELECT item_key, type, condition, temp, round(avg(em), 9) AS em, round(avg(f1), 9) AS f1, round(avg(abstained), 9) AS abstain_rate, round(avg(false_answer), 9) AS false_answer_rate,
  round(avg(unsupported), 9) AS unsupported_rate, round(coalesce(stddev_samp(em), 0), 9) AS em_std, count(*) AS k FROM sc GROUP BY ALL""")
def _(spark, sf_dir):
    a = score.aggregate_replicates(_scored(spark, sf_dir))
    return a.select("item_key", "type", "condition", "temp", *(F.round(c, 9).alias(c) for c in (*X.METRICS, "em_std")), "k")


@query("q_per_item", f"WITH {X.PER_ITEM} SELECT item_key, type, condition, temp, round(em, 9) AS em, round(f1, 9) AS f1, round(abstain_rate, 9) AS abstain_rate, round(false_answer_rate, 9) AS false_answer_rate, round(unsupported_rate, 9) AS unsupported_rate, round(em_std, 9) AS em_std, k FROM per_item")
def _(spark, sf_dir):
    return X.per_item(spark, sf_dir).select("item_key", "type", "condition", "temp", *(F.round(c, 9).alias(c) for c in (*X.METRICS, "em_std")), "k")


@query("q_unmatched", f"WITH {X.TEXT_PREDS} SELECT type, item_key, condition, sample_index FROM tpreds WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.type = tpreds.type AND i.item_key = tpreds.item_key AND i.item_id::BIGINT % 10 <> 0)")
def _(spark, sf_dir):
    items = X.text_items(spark, sf_dir)
    return score.unmatched(X.text_predictions(items), items.where("cast(item_id as long) % 10 <> 0")).select(*_KEY)


@query("q_scored_long", f"""{_SCORES},
gone AS (SELECT * FROM u WHERE split_part(item_key, '|', 2)::BIGINT % 10 = 0)
SELECT item_key, split_part(item_key, '|', 1) AS dataset, type, condition, temp, sample_index, un AS unanswerable, em, round(f1, 9) AS f1, abstained, (em >= 0.5)::INTEGER AS binary_correct FROM sc WHERE split_part(item_key, '|', 2)::BIGINT % 10 <> 0
UNION ALL SELECT item_key, split_part(item_key, '|', 1), type, condition, temp, sample_index, false, (np = '')::INTEGER::DOUBLE, CASE WHEN type = 'open' THEN (np = '')::INTEGER::DOUBLE END, {abstains("np", "fixed")}::INTEGER::DOUBLE, (np = '')::INTEGER FROM gone""")
def _(spark, sf_dir):
    items = X.text_items(spark, sf_dir)
    return score.scored_long(X.text_predictions(items), items.where("cast(item_id as long) % 10 <> 0")).withColumn("f1", F.round("f1", 9))
