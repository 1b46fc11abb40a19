"""Secret scans with a trigram index.

From each rule's pattern a Boolean query over trigrams is derived: every match
must hold all trigrams of at least one clause. The index lists, for each trigram
that some rule needs, the documents that hold it; the lists are intersected per
document, and only the documents left are run through the pattern. A pattern
without mandatory trigrams is run over every document. Columns only, no Python
on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, unshielded


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, and how many characters its `group` needs (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The patterns hold for Java and Python alike. The runs of `access` and `hex` have their least length in the pattern:
#: a run that is too short has no longer one inside it, so the matches are the same.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Rules that are added to the base.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE_RULES + MORE_RULES

Clauses = frozenset  # of frozensets of trigrams: one clause must hold, with all its trigrams
ANY: Clauses = frozenset([frozenset()])
#: Sizes up to which strings and clauses are enumerated; beyond, a query says less but stays necessary.
MOST_STRINGS, MOST_CLAUSES, MOST_CLASS = 256, 64, 8


def _least(clauses) -> Clauses:
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MOST_CLAUSES:
        return a if len(a) <= len(b) else b
    return _least({x | y for x, y in product(a, b)})


def _of_strings(strings: set[str]) -> Clauses:
    return _least({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(chr(arg).lower())
        elif op is K.RANGE and arg[1] - arg[0] < MOST_CLASS:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _walk(tree) -> tuple[set[str] | None, Clauses]:
    """The strings that a part of a pattern matches, if they are few, and its query."""
    query, run, whole = ANY, {""}, True
    for op, arg in tree:
        strings, own = _item(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        else:
            query, whole = _both(_both(query, _of_strings(run)), own), False
            run = {""}
    return (run if whole else None), _both(query, _of_strings(run))


def _item(op, arg) -> tuple[set[str] | None, Clauses]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is K.IN:
        return _class(arg), ANY
    if op is K.SUBPATTERN:
        return _walk(arg[3])
    if op is K.BRANCH:
        parts = [_walk(p) for p in arg[1]]
        strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        clauses = _least(set().union(*(q for _, q in parts)))
        return strings, clauses if len(clauses) <= MOST_CLAUSES else ANY
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, body = arg
        strings, own = _walk(body)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ANY
        if low == high and low <= 8 and strings is not None and len(strings) ** low <= MOST_STRINGS:
            return {"".join(p) for p in product(strings, repeat=low)}, ANY
        return None, own if low else ANY
    return None, ANY


def trigram_query(pattern: str) -> Clauses:
    """The necessary query of a pattern over lower-case trigrams; ANY if it has no mandatory ones."""
    return _walk(_parser.parse(pattern, re.ASCII))[1]


def _vocabulary(rules) -> list[str]:
    return sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})


def row_key() -> Column:
    """Names a row by its id and text. Equal keys of unequal rows would only add candidates, which are verified."""
    return F.xxhash64("doc_id", "text")


def _dealt_key() -> Column:
    """The row's key; rows whose text has no trigram are in no list and get any key, so that they do not meet in one task."""
    return F.when(F.length("text") >= 3, row_key()).otherwise(F.xxhash64(F.monotonically_increasing_id()))


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """The index: (trigram, key) for each trigram that a rule needs and each document that holds it in either case."""
    low = docs.filter(F.length("text") >= 3).select(row_key().alias("key"), F.lower("text").alias("low"))
    held = [F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in _vocabulary(rules)]
    return low.select(F.explode(F.array_compact(F.array(*held))).alias("trigram"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """The lists intersected: (key, kinds) of the rules whose query a document meets."""
    words, width = _vocabulary(rules), 60
    number = F.element_at(F.create_map(*[x for i, t in enumerate(words) for x in (F.lit(t), F.lit(i))]), F.col("trigram"))
    blocks = range(-(-len(words) // width))
    bit = F.expr("shiftleft(1L, int(no % 60))")
    held = index.withColumn("no", number).groupBy("key").agg(*[F.bit_or(F.when(F.floor(F.col("no") / width) == b, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{b}") for b in blocks])

    def meets(clause) -> Column:
        test = F.lit(True)
        for b in blocks:
            if mask := sum(1 << (i % width) for i, t in enumerate(words) if t in clause and i // width == b):
                test = test & (F.col(f"b{b}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return test

    kinds = []
    for r in rules:
        if (query := trigram_query(r.pattern)) != ANY:
            hit = F.lit(False)
            for clause in query:
                hit = hit | meets(clause)
            kinds.append(F.when(hit, F.lit(r.kind)))
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).filter(F.size("kinds") > 0)


SPAN = "array<struct<start:long,no:int,kind:string,end:long>>"


def _spans(rule: Rule, no: int) -> Column:
    """A text's matches of one rule, leftmost and not overlapping, as code-point spans; too short ones are dropped."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(no).alias("no"), F.lit(rule.kind).alias("kind"), end.alias("end"))).cast(SPAN)
        good = x["hit"].isNotNull() & (F.length(x["part"]) >= rule.least)
        return F.struct(F.coalesce(end, start).cast("long").alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def secret_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """Documents with `spans`, an array of (start, no, kind, end) ordered by start and rule.

    Null and empty texts have none. Whole texts are searched, however long.
    Repeated rows keep their number and are judged alike; spans that start at
    one place are ordered by rule. A column named spans is replaced; the other
    columns pass through. An empty table gives an empty table.
    """
    columns = [c for c in docs.columns if c.lower() != "spans"]
    inner, other = shielded(docs.select(*[F.col(f"`{c}`") for c in columns]), {"_key", "_kinds"})
    base = inner.withColumn("_key", _dealt_key())
    found = candidates(postings(docs.select("doc_id", "text"), rules), rules).withColumnRenamed("key", "_key").withColumnRenamed("kinds", "_kinds")
    joined = base.join(found, "_key", "left")
    none = F.array().cast(SPAN)
    parts = []
    for no, r in enumerate(rules):
        scan = trigram_query(r.pattern) == ANY
        likely = F.lit(True) if scan else F.array_contains("_kinds", r.kind)
        parts.append(F.when(likely & F.col("text").rlike(r.pattern), _spans(r, no)).otherwise(none))
    return unshielded(joined.withColumn("spans", F.array_sort(F.concat(*parts))), [*columns, "spans"], other)


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every span of every rule replaced by `mark`, and n_chars set anew. Overlapping spans become one mark.

    Rows without secrets, null and empty texts among them, stay as they are;
    columns of the input may have any name and keep their values.
    """
    inner, other = shielded(docs, {"spans", "_gaps"})
    found = secret_spans(inner, rules)

    # pieces between the joined spans, by position
    ends = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<from:long,to:long>>").alias("gaps")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to"))).cast("array<struct<from:long,to:long>>"))).otherwise(acc["gaps"]).alias("gaps"),
        ),
        lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("from"), F.lit(1 << 40).cast("long").alias("to"))).cast("array<struct<from:long,to:long>>")),
    )
    pieces = F.transform("_gaps", lambda g: F.substring(F.col("text"), (g["from"] + 1).cast("int"), F.least(g["to"] - g["from"], F.lit(2147483647)).cast("int")))
    clean = F.when(F.size("spans") > 0, F.array_join(pieces, mark)).otherwise(F.col("text"))
    out = found.withColumn("_gaps", ends).withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return unshielded(out, docs.columns, other)


def _written(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["no"] < len(BASE_RULES))
    return found.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _sql() -> str:
    per = []
    for no, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        per.append(
            f"SELECT rid, {no} AS no, '{r.kind}' AS kind, unnest(range(1, len(hit) + 1)) AS i, hit, part, gap, {r.least} AS least FROM ("
            f"SELECT rid, regexp_extract_all(text, '{p}', 0) AS hit, regexp_extract_all(text, '{p}', {r.group}) AS part, string_split_regex(text, '{p}') AS gap "
            f"FROM d WHERE regexp_matches(text, '{p}'))"
        )
    rules = " UNION ALL ".join(per)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({rules}),
s AS (
  SELECT rid, no, kind, CAST(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(hit[i]) AS n
  FROM m WHERE length(part[i]) >= least
),
w AS (SELECT *, kind || ':' || start || ':' || (start + n) AS said FROM s),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY start, no) FILTER (no < {len(BASE_RULES)}) AS base, string_agg(said, ',' ORDER BY start, no) AS spans
  FROM w GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


OP4_SQL = _sql()
