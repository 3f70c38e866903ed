"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A blob is
scanned once for each rule version: pairs that the ledger holds are skipped, and
the findings of all blobs, old and new, are joined back to every path and version
that has them. Only keys are shuffled to find blobs; the content of one row of each
unseen blob is moved once.

Cases: null content is empty; very long texts are scanned whole, and no pattern's stack
grows with what it matches; rows with one path, version and content are one blob
and each is returned; a null path is a path like others;
extra columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are secrets if the group has so many characters at least.

    lines: a group at a match's end of which only key_lines belong to the secret. What is
    behind them holds no match of the pattern.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 0
    lines: int = 0


def _either(words: str) -> str:
    """The letters a to z of a pattern in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The base rules as asked for, then well-known token formats.
ASSIGN = Rule("assign", "(" + _either("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6)
ACCESS = Rule("access", "AKIA[A-Z0-9]+", least=20)
HEX = Rule("hex", "[0-9a-f]{24,}", least=24)  # runs are maximal: the same as runs of any length, then 24 or more
BASE = (ASSIGN, ACCESS, HEX)
# A private key from its header to its END line; if that is missing (another ----- comes first, or 64 dashes),
# over the header fields, the lines of base64 (40 characters or more) and the rest of one on the line behind.
_HEAD = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_ENDED = r"[^-]*(?:-{1,4}[^-]+){0,64}-----END [A-Z ]*PRIVATE KEY-----"
_FIELDS = r"(?:[ \t\r\n]*(?:Proc-Type|DEK-Info):[^\n]*){0,4}"
_64, _APART = "A-Za-z0-9+/=", r" \t\r\n\\"
#: The lines in one class of characters, as group 1: a repeated group would take a stack frame for each line.
_PEM = f"{_HEAD}(?:{_ENDED}|{_FIELDS}([{_64}{_APART}]*))"
#: The same in one pattern, for engines that don't backtrack.
_PEM_WHOLE = f"{_HEAD}(?:{_ENDED}|{_FIELDS}(?:[{_APART}]*[{_64}]{{40,}}(?:[{_APART}]+[{_64}]{{40,}})*(?:\\r?\\n[ \\t]*[{_64}]+)?)?)"


def key_lines(tail: Column) -> Column:
    """How many characters at the start of such lines belong to a key: those of 40 and more, and the shorter rest of one on the line behind."""
    apart = F.lit(" \t\r\n\\")
    short = F.regexp_instr(tail, F.lit(f"(?:^|[{_APART}])[{_64}]{{1,39}}(?:[{_APART}]|$)"))
    long = F.rtrim(F.when(short > 0, F.substring(tail, F.lit(1), F.when(F.substring(tail, F.lit(1), F.lit(1)).rlike(f"[{_64}]") & (short == 1), 0).otherwise(short))).otherwise(tail), apart)
    # an array of one element names the length, so that it is computed once
    rest = lambda n: F.char_length(F.regexp_extract(F.substring(tail, n + 1, F.char_length(tail)), rf"^\r?\n[ \t]*[{_64}]+", 0))
    return F.transform(F.array(F.char_length(long)), lambda n: F.when((n > 0) & (short > 0), n + rest(n)).otherwise(n))[0]


MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", _PEM, version=3, lines=1),
)
RULES = BASE + MORE

SPANS = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's matches in code points, leftmost and non-overlapping.

    The text is split at the matches: the lengths of what stands between them and of
    themselves add up to their places, so that no text is searched from its start again.
    """
    none = F.array().cast(SPANS)

    def add(acc: Column, x: Column) -> Column:
        m, start = x["m"], acc["end"] + x["gap"]
        end = start + F.char_length(m)
        stop = end
        if rule.lines:
            tail = F.regexp_extract(m, rule.pattern, rule.lines)
            stop = F.transform(F.array(tail), lambda t: end - F.char_length(t) + key_lines(t))[0]
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), stop.alias("end")))
        value = F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m
        return F.struct(end.alias("end"), F.when(F.char_length(value) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def placed(matches: Column) -> Column:
        found = F.zip_with(F.split(text, rule.pattern, -1), matches, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m")))
        found = F.slice(found, F.lit(1), F.size(matches))  # nothing follows the last gap
        start = F.struct(F.lit(0).alias("end"), none.alias("spans"))
        return F.when(F.size(matches) == 0, none).otherwise(F.aggregate(found, start, add, lambda acc: acc["spans"]))

    # an array of one element names the matches, so that they are looked for once, and gaps only where there are any
    return F.transform(F.array(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))), placed)[0]


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings per path and version, and the ledger after this run.

    versions: path, version, content. ledger: blob, kind, rule_version, spans of
    former runs, or none. Findings: path, version, blob, spans (kind is the rule's
    place in rules) in order of start, then kind.
    """
    v = versions.select("path", "version", F.coalesce("content", F.lit("")).alias("content"))
    v = v.withColumn("blob", F.sha2(F.encode("content", "utf-8"), 256))
    wanted = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules))
    one = v.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("one"))
    if ledger is None:
        todo = one.select("blob", "one.path", "one.version", F.array(*(F.lit(r.kind) for r in rules)).alias("todo"))
    else:
        pairs = one.select("blob", "one", F.explode(wanted).alias("r")).select("blob", "one", "r.kind", "r.rule_version")
        pairs = pairs.join(ledger.select("blob", "kind", "rule_version"), ["blob", "kind", "rule_version"], "left_anti")
        todo = pairs.groupBy("blob").agg(F.first("one").alias("one"), F.collect_set("kind").alias("todo")).select("blob", "one.path", "one.version", "todo")
    todo = todo.select(F.col("blob").alias("todo_blob"), F.col("path").alias("todo_path"), F.col("version").alias("todo_version"), "todo")
    same = (v["blob"] == todo["todo_blob"]) & v["path"].eqNullSafe(todo["todo_path"]) & v["version"].eqNullSafe(todo["todo_version"])
    unseen = v.join(todo.hint("merge"), same).select("blob", "content", "todo")
    each = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), F.when(F.array_contains("todo", r.kind), spans_of(F.col("content"), r, i)).alias("spans")) for i, r in enumerate(rules)))
    scanned = unseen.select("blob", each.alias("found")).groupBy("blob").agg(F.first("found").alias("found"))
    scanned = written(scanned.select("blob", F.filter("found", lambda x: x["spans"].isNotNull()).alias("found")), "scanned")
    fresh = scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.kind", "f.rule_version", "f.spans")
    after = fresh if ledger is None else ledger.select("blob", "kind", "rule_version", "spans").unionByName(fresh)
    # the findings under the rules and versions asked for, from this and former runs
    if ledger is None:
        by_blob = scanned.select("blob", F.flatten(F.transform("found", lambda x: x["spans"])).alias("spans")).where("size(spans) > 0")
    else:
        current = F.broadcast(after.sparkSession.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, rule_version int, place int"))  # a row for each rule
        of_rule = after.join(current, ["kind", "rule_version"])
        by_blob = of_rule.select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("kind"), s["end"].alias("end"))).alias("spans"))
        by_blob = by_blob.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")).where("size(spans) > 0")
    by_blob = written(by_blob, "findings")
    paths = v.select("path", "version", "blob")
    findings = paths.join(by_blob, "blob", "left").select("path", "version", "blob", F.array_sort(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"))
    return findings, after


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of all spans, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced."""

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mask)).alias("out"))
        same = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["at"]), same).otherwise(new)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def _oracle() -> str:
    def spans(i: int, r: Rule) -> str:
        pattern = (_PEM_WHOLE if r.lines else r.pattern).replace("'", "''")
        value = f"regexp_extract(x, '{pattern}', {r.group})" if r.group else "x"
        step = f"lambda a, x: {{'e': a.e + strpos(substr(t, a.e + 1), x) - 1 + length(x), 's': CASE WHEN length({value}) >= {r.least} THEN list_append(a.s, {{'b': a.e + strpos(substr(t, a.e + 1), x) - 1, 'k': {i}, 'e': a.e + strpos(substr(t, a.e + 1), x) - 1 + length(x)}}) ELSE a.s END}}"
        return f"list_reduce(regexp_extract_all(t, '{pattern}', 0), {step}, {{'e': 0::BIGINT, 's': []::STRUCT(b BIGINT, k INTEGER, e BIGINT)[]}}).s AS s{i}"

    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda x: {kinds}[x.k + 1] || ':' || x.b || ':' || x.e), ',')"
    base = "list_concat(list_concat(s0, s1), s2)"
    every = base
    for i in range(3, len(RULES)):
        every = f"list_concat({every}, s{i})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(substr(md5(doc_id::VARCHAR), 1, 1) < '8', false) AS early FROM documents),
e AS (SELECT DISTINCT t FROM d WHERE early),
s AS (SELECT doc_id, t IN (SELECT t FROM e) AS known, {", ".join(spans(i, r) for i, r in enumerate(RULES))} FROM d)
SELECT doc_id, len(s0)::BIGINT AS n_assign, len(s1)::BIGINT AS n_access, len(s2)::BIGINT AS n_hex,
  sha256({text(base)}) AS base_sha256, {text(every)} AS spans, known
FROM s"""


ORACLE = _oracle()
