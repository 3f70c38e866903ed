"""Text functions of the scorers, as Column expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII punctuation, articles and abstention markers.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
ABSTAIN_MARKERS = (
    "i don't know", "i do not know", "unknown", "not sure", "cannot answer", "can't answer",
    "insufficient information", "not enough information", "not provided in the passage",
)
SPACE = r"(?U)\s+"


def clean_text(s: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(s, SPACE, " "))


def stripped(s: Column) -> Column:
    """White space of any kind cut from both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def first_filled(*columns: Column) -> Column:
    """The first of string columns that is neither null nor empty."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def normal_tokens(s: Column) -> Column:
    """Tokens of the normalised answer: lower case, no punctuation, no articles."""
    bare = F.translate(F.lower(F.coalesce(s, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(bare, SPACE), lambda t: (t != "") & ~t.isin(*ARTICLES))


def normalize_answer(s: Column) -> Column:
    return F.array_join(normal_tokens(s), " ")


def word_tokens(s: Column) -> Column:
    """Runs of letters, digits and underscores of the normalised answer."""
    return F.filter(F.split(normalize_answer(s), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def word_set(s: Column) -> Column:
    """The different word_tokens, by hash sets and without a lambda for each token: for long texts."""
    bare = F.translate(F.lower(F.coalesce(s, F.lit(""))), PUNCTUATION, "")
    tokens = F.array_except(F.split(bare, SPACE), F.array(*map(F.lit, ("", *ARTICLES))))
    return F.array_except(F.split(F.array_join(tokens, " "), r"[^\p{L}\p{N}_]+"), F.array(F.lit("")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use reads it, in lambdas too.

    An array of one element names it: what a lambda reads more than once is computed each time else.
    """
    return F.transform(F.array(value), use)[0]


def bag(tokens: Column) -> Column:
    """A multiset as a set: each token with its number among its equals.

    Sorting brings equal tokens together; a run of n of them gives the numbers 0 to n - 1.
    """

    def numbered(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1) != s[i]))

        def runs(b: Column) -> Column:
            of_run = lambda at, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(b, k + 1), F.size(s)) - at - 1), lambda n: F.concat(s[at], F.lit(" "), n.cast("string")))
            return F.flatten(F.transform(b, of_run))

        return F.when(F.size(s) > 0, once(first, runs)).otherwise(F.array().cast("array<string>"))

    return once(F.sort_array(tokens), numbered)


def f1_of_bags(p: Column, t: Column) -> Column:
    """F1 of two bags: what they share is met by hash."""

    def f1(c: Column) -> Column:
        n, m = F.size(p), F.size(t)
        both = F.lit(2.0) * (c / n) * (c / m) / (c / n + c / m)
        return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (c == 0), 0.0).otherwise(both)

    return once(F.size(F.array_intersect(p, t)), f1)


def f1_of_tokens(p: Column, t: Column) -> Column:
    return once(F.struct(bag(p).alias("p"), bag(t).alias("t")), lambda x: f1_of_bags(x["p"], x["t"]))


def token_f1(prediction: Column, truth: Column) -> Column:
    return f1_of_tokens(normal_tokens(prediction), normal_tokens(truth))


def exact_match(prediction: Column, truth: Column) -> Column:
    return normalize_answer(prediction) == normalize_answer(truth)


def or_blank(truths: Column) -> Column:
    """The truths, or one empty truth where there are none."""
    return F.when(F.coalesce(F.size(truths), F.lit(0)) > 0, truths).otherwise(F.array(F.lit("")))


def best_f1(prediction: Column, truths: Column) -> Column:
    return once(bag(normal_tokens(prediction)), lambda p: F.array_max(F.transform(or_blank(truths), lambda t: once(bag(normal_tokens(t)), lambda x: f1_of_bags(p, x)))))


def best_em(prediction: Column, truths: Column) -> Column:
    return once(normalize_answer(prediction), lambda p: F.exists(or_blank(truths), lambda t: normalize_answer(t) == p)).cast("double")


def _normal(s: str) -> str:
    return " ".join(t for t in s.lower().translate(str.maketrans("", "", PUNCTUATION)).split() if t not in ARTICLES)


def markers_of(mode: str) -> tuple[str, ...]:
    """fixed: markers normalised like answers, so that all can match; reference: as they are."""
    if mode not in ("fixed", "reference"):
        raise ValueError(f"unknown marker mode {mode}")
    return tuple(dict.fromkeys(map(_normal, ABSTAIN_MARKERS))) if mode == "fixed" else ABSTAIN_MARKERS


def is_abstention(s: Column, markers: str = "fixed") -> Column:
    return has_marker(normalize_answer(s), markers)


def has_marker(text: Column, markers: str = "fixed") -> Column:
    """Whether a normalised answer has an abstention marker."""
    found = F.lit(False)
    for m in markers_of(markers):
        found = found | F.contains(text, F.lit(m))
    return found


def support_baseline(prediction: Column, context: Column, normal: Column | None = None) -> Column:
    """1 if the normalised answer is a non-empty part of the normalised context (normal, where it is known)."""
    normal = normalize_answer(context) if normal is None else normal
    return once(normalize_answer(prediction), lambda p: (p != "") & F.contains(normal, p)).cast("double")


def share_in(tokens: Column, others: Column) -> Column:
    """Share of tokens, repeats counted, that others has; 0 without tokens.

    Those of both are met by hash; sorted together with the runs of equal tokens they mark
    the runs that count, so the work follows the sum of both lengths.
    """
    kind = "array<struct<token:string,run:int>>"

    def share(x: Column) -> Column:
        n = F.size(x["tokens"])

        def marked(s: Column) -> Column:
            # a token that both have stands as (token, 0) before its numbered occurrences
            def add(acc: Column, e: Column) -> Column:
                mark = e["run"] == 0
                counted = F.when(~mark & e["token"].eqNullSafe(acc["token"]), acc["n"] + 1).otherwise(acc["n"])
                return F.struct(F.when(mark, e["token"]).otherwise(acc["token"]).alias("token"), counted.alias("n"))

            return F.aggregate(s, F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).alias("n")), add, lambda acc: acc["n"])

        both = F.transform(F.array_intersect(x["tokens"], x["others"]), lambda t: F.struct(t.alias("token"), F.lit(0).alias("run")))
        own = F.transform(x["tokens"], lambda t: F.struct(t.alias("token"), F.lit(1).alias("run")))
        return F.when(n == 0, 0.0).otherwise(once(F.sort_array(F.concat(both.cast(kind), own.cast(kind))), marked) / n)

    return once(F.struct(tokens.alias("tokens"), others.alias("others")), share)


def support_overlap(prediction: Column, context: Column, words: Column | None = None) -> Column:
    """Share of the answer's tokens that the context (its word_set words, where they are known) has."""
    return share_in(word_tokens(prediction), word_set(context) if words is None else words)


#: Inputs of strategies that follow from the context: made once an item, not once an answer, where items are prepared.
OF_CONTEXT: dict[str, Callable[[Column], Column]] = {"context_normal": normalize_answer, "context_words": word_set}


def input_columns(inputs: tuple[str, ...] | list[str], context: Column, ready: tuple[str, ...] | list[str] = ()) -> list[Column]:
    """Inputs by name: columns that are there, or made from the context."""
    return [OF_CONTEXT[c](context).alias(c) if c in OF_CONTEXT and c not in ready else F.col(c) for c in inputs]


#: Support strategies by name: functions of the answer, the context and the least overlap that give a boolean Column.
_SUPPORT: dict[str, Callable[..., Column]] = {}
#: Columns besides answer and context that a strategy reads.
_INPUTS: dict[str, tuple[str, ...]] = {}


def register_support(name: str, supported: Callable[..., Column], inputs: tuple[str, ...] = ()) -> None:
    """A strategy by which scoring, sweeps and sensitivity judge answers.

    supported(prediction, context, min_overlap, *inputs) gives a boolean Column; null counts
    as not supported. It can be made of Column functions or call an Arrow or pandas UDF.
    inputs: further columns that it reads, of the predictions or the items; they are passed
    on to it in this order. Those of OF_CONTEXT are made from the context.
    """
    _SUPPORT[name], _INPUTS[name] = supported, tuple(inputs)


def support_inputs(strategy: str) -> tuple[str, ...]:
    return _INPUTS.get(strategy, ())


register_support("baseline", lambda p, c, least, normal: support_baseline(p, c, normal) > 0, ("context_normal",))
register_support("overlap", lambda p, c, least, words: support_overlap(p, c, words) >= least, ("context_words",))
register_support("combined", lambda p, c, least, normal, words: (support_baseline(p, c, normal) > 0) | (support_overlap(p, c, words) >= least), ("context_normal", "context_words"))
register_support("nli", _SUPPORT["combined"], _INPUTS["combined"])


def is_supported(prediction: Column, context: Column, strategy: str = "baseline", min_overlap: float = 0.6, ready: tuple[str, ...] | list[str] = ()) -> Column:
    """By a registered strategy; nothing is supported by an unknown one. ready: columns that are there, of OF_CONTEXT's."""
    if strategy not in _SUPPORT:
        return F.lit(False)
    return F.coalesce(_SUPPORT[strategy](prediction, context, min_overlap, *input_columns(_INPUTS[strategy], context, ready)), F.lit(False))


def is_unsupported(prediction: Column, context: Column, abstained: Column, threshold: float | Column, strategy: str = "baseline", min_overlap: float = 0.6, ready: tuple[str, ...] | list[str] = ()) -> Column:
    return F.when(abstained >= threshold, 0.0).otherwise((~is_supported(prediction, context, strategy, min_overlap, ready)).cast("double"))


def sweep_thresholds(df: DataFrame, prediction: Column, context: Column, abstained: Column, thresholds: list[float], strategy: str = "baseline", min_overlap: float = 0.6) -> DataFrame:
    """df with a row for each threshold and whether the answer is unsupported at it; support is looked up once a row."""
    bad = df.withColumns({"_bad": (~is_supported(prediction, context, strategy, min_overlap, df.columns)).cast("double"), "_gone": abstained})
    each = bad.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    return each.withColumn("unsupported", F.when(F.col("_gone") >= F.col("threshold"), 0.0).otherwise(F.col("_bad"))).drop("_bad", "_gone")


def estimate_tokens(s: Column) -> Column:
    """Word count; at least 1 where there is any text."""
    words = F.size(F.filter(F.split(F.coalesce(s, F.lit("")), SPACE), lambda t: t != ""))
    return F.when(F.coalesce(F.length(s), F.lit(0)) > 0, F.greatest(words, F.lit(1))).otherwise(0)


def temp_key(t: Column) -> Column:
    return F.format_string("%.1f", t)


def temp_label(t: Column) -> Column:
    s = temp_key(t)
    return F.when(s == "0.0", "0").otherwise(F.replace(s, F.lit("."), F.lit("")))


def job_state(s: Column) -> Column:
    """The state that a provider's status word stands for; an unknown word in upper case."""
    word = F.upper(F.coalesce(s, F.lit("")))
    has = lambda *xs: reduce(or_, (F.contains(word, F.lit(x)) for x in xs))
    return (
        F.when(has("COMPLETED"), "COMPLETED").when(has("FAILED"), "FAILED").when(has("EXPIRED"), "EXPIRED")
        .when(has("RUNNING", "PROCESSING"), "RUNNING").when(has("PENDING", "QUEUED", "SUBMITTED"), "PENDING").otherwise(word)
    )


def majority(x: Column) -> Column:
    return (x >= 0.5).cast("int")


def content_texts(v: Column) -> Column:
    """The texts of a message's content, a variant: a string, a list of strings and blocks, or one block."""
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", x.cast("string")).otherwise(F.try_variant_get(x, "$.text", "string"))
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.filter(F.when(many.isNotNull(), F.transform(many, text)).otherwise(F.array(text(v))), lambda t: t.isNotNull())


def content_to_text(v: Column) -> Column:
    """A message's content as one text, parts that are not empty joined by line ends.

    v: a variant, or a string that may be a JSON list of strings and blocks.
    """
    s = v.cast("string")
    # parsing stops after the first value: what follows it would have to close both a list and an object
    whole = F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), s, F.lit("}"))).isNotNull()
    listed = F.when(s.startswith("["), F.when(whole, F.try_parse_json(s)))
    return F.when(listed.isNotNull(), F.array_join(F.filter(content_texts(listed), lambda t: t != ""), "\n")).otherwise(F.coalesce(v.cast("string"), F.lit("")))


def estimate_message_tokens(messages: Column) -> Column:
    """estimate_tokens of all texts of messages, a variant (a string, or a list of strings and messages), joined by line ends."""
    one = F.when(F.schema_of_variant(messages) == "STRING", F.array(messages.cast("string")))
    text = lambda m: F.when(F.schema_of_variant(m) == "STRING", F.array(m.cast("string"))).otherwise(content_texts(F.try_variant_get(m, "$.content", "variant")))
    every = F.flatten(F.transform(F.try_variant_get(messages, "$", "array<variant>"), lambda m: F.coalesce(text(m), F.array().cast("array<string>"))))
    return estimate_tokens(F.array_join(F.coalesce(one, every, F.array().cast("array<string>")), "\n"))
