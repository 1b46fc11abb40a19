"""Statements and relations of papers that are written from the parts, and the ontology of relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import GENERIC, METRIC_NAMES
from ..operators import extract
from ..storage import durable, table

QUERIES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_NAME, _SIZE, _TYPE, _WORD = "p_name", "CAST(p_size AS STRING)", "lower(p_type)", "replace(p_brand, '#', '')"
#: What the paper of a part says: block, section, condition, sentences (parts of text and expressions in turn).
PAPER = [
    (0, None, "true", [["1. Methods"]]),
    (1, "Method", "p_size % 3 = 0", [["We use the ", _WORD, "Net model on the ", _WORD, " images dataset."]]),
    (1, "Method", "p_size % 3 = 1", [["We propose the ", _WORD, "Net method for ", _NAME, " cells."], ["The same paragraph evaluates it on the ", _TYPE, " images dataset."]]),
    (1, "Method", "p_size % 3 = 2", [["The ", _NAME, " problem is known for long."], ["All training took ", _SIZE, " hours on the ", _NAME, " corpus."]]),
    (2, "Method", "p_size % 2 = 0", [["However few studies of the ", _NAME, " exist at all."], ["A large language model is tried here [1, 2]."]]),
    (3, None, "true", [["Results"]]),
    (4, "Results", "p_size % 4 = 0", [["Results show the recall of the ", _TYPE, " model is fine."]]),
    (4, "Results", "p_size % 4 = 1", [["The latency was ", _SIZE, " ms in all of the runs."], ["We extend Smith et al. 2020 and improve on their method."]]),
    (4, "Results", "p_size % 4 = 2", [["Our algorithm does outperform others in recall and precision."]]),
    (4, "Results", "p_size % 4 = 3", [["An ablation experiment on the ", _TYPE, " cohort says the same."], ["Accuracy improved by ", _SIZE, " points with it."]]),
    (5, None, "true", [["Limitations"]]),
    (6, "Limitation", "p_size % 5 < 3", [["A limitation is that the method cannot improve recall on ", _NAME, "."]]),
    (7, None, "true", [["Future work"]]),
    (8, "Future Work", "p_size % 5 > 1", [["In the future we will explore the ", _TYPE, " database."]]),
    (9, "Future Work", "p_size % 4 = 0", [["Results show the recall of the ", _TYPE, " model is fine."]]),
    (10, None, "true", [["References"]]),
    (11, "References", "true", [["Smith et al. 2020 proposed a benchmark dataset."]]),
]


def _text(parts: list[str]) -> str:
    return " || ".join("'" + p + "'" if i % 2 == 0 else p for i, p in enumerate(parts))


def papers(spark, d):
    """Blocks (record, page, block, text) of the parts' papers."""
    blocks = ", ".join(f"CASE WHEN {when} THEN struct({number} AS block, {" || ' ' || ".join(_text(s) for s in said)} AS text) END" for number, _, when, said in PAPER)
    listed = table(spark, d, "part").selectExpr("p_partkey AS record", f"array_compact(array({blocks})) AS b")
    return listed.select("record", F.lit(1).alias("page"), F.explode("b").alias("b")).select("record", "page", "b.block", "b.text")


def _says(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '(?i){pattern}')"


def _first(pattern: str, group: int = 0, flags: str = "(?i)") -> str:
    return f"nullif(trim(regexp_extract(text, '{flags}{pattern}', {group})), '')"


def _key(text: str) -> str:
    """The normalized key of ASCII text."""
    return f"regexp_replace(regexp_replace(lower({text}), '\\b(model|method|framework|dataset|result)s\\b', '\\1', 'g'), '[^a-z0-9]+', '', 'g')"


def _case(names: dict, of: str, other: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


_BODY = " UNION ALL ".join(f"SELECT p_partkey AS record, {b} AS block, '{s}' AS section, {i} AS sentence, {_text(x)} AS text FROM part WHERE {w}" for b, s, w, said in PAPER if s and s != "References" for i, x in enumerate(said))
_KINDS = " UNION ALL ".join(
    f"SELECT *, {i} AS rank, '{k}' AS kind FROM s WHERE " + (f"({_says('text', p)} OR {_says('text', extract.NUMERIC)}) AND NOT {_says('text', extract.LIMITATION)}" if k == "result" else _says("text", p)) for i, (k, p) in enumerate(extract.KINDS.items())
)
_METRICS = f"(SELECT string_agg(v, ' / ' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT unnest(regexp_extract_all(text, '(?i){extract.KINDS['metric']}')) AS v, generate_subscripts(regexp_extract_all(text, '(?i){extract.KINDS['metric']}'), 1) AS i) GROUP BY v))"
_LABEL = f"""CASE WHEN kind = 'metric' THEN {_METRICS}
  WHEN kind IN ('method', 'model') THEN coalesce({_first(extract.METHOD_ALIAS)}, {_first(extract.NAMED, 1, "")}, CASE WHEN lower({_first(extract.DESCRIBED, 1)}) NOT IN ('a', 'an', 'the') THEN {_first(extract.DESCRIBED, 1)} END, {_first(extract.ALONE, 1)})
  WHEN kind = 'dataset' THEN {_first(extract.DATASET)} WHEN kind = 'citation' THEN {_first(extract.KINDS["citation"])} END"""
_GENERIC = ", ".join(f"'{w}'" for w in dict.fromkeys(w.removesuffix("s") if w == "results" else w for w in GENERIC))
_OTHER = f"{_case(extract.PREFIX, 'kind', 'upper(kind[1]) || kind[2:]')} || ' · ' || text[1:72] || CASE WHEN length(text) > 72 THEN '...' ELSE '' END"
_NAMES = f"(SELECT string_agg(v, ' / ' ORDER BY i) FROM (SELECT v, min(i) AS i FROM (SELECT {_case(METRIC_NAMES, _key('w'), 'w')} AS v, i FROM (SELECT unnest(string_split(label, ' / ')) AS w, generate_subscripts(string_split(label, ' / '), 1) AS i)) GROUP BY v))"
_BAD = lambda x: f"CASE WHEN {_key(x)} = '' THEN 'empty_label' WHEN length({_key(x)}) < 3 THEN 'label_too_short' WHEN regexp_full_match({x}, '[\\d\\W_]+') THEN 'non_semantic_label' WHEN {_key(x)} IN ({_GENERIC}) THEN 'generic_label' END"
_MENTIONS = f"""s AS ({_BODY}), t AS ({_KINDS}), r AS (
  SELECT *, lower(regexp_replace(text, '[^A-Za-z0-9_]+', '', 'g'))[1:180] AS key, block * 1000 + sentence AS place FROM t
), q AS (
  SELECT *, min(place) FILTER (kind = 'result') OVER (PARTITION BY record, key) AS res FROM r
), o AS (
  SELECT * FROM q WHERE NOT (kind IN ('method', 'model') AND coalesce(place = res, false)) QUALIFY row_number() OVER (PARTITION BY record, key, kind ORDER BY place) = 1
), l AS (
  SELECT *, coalesce({_LABEL}, {_OTHER}) AS label FROM o
), c AS (
  SELECT *, {_BAD('label')} AS bad, round(least(0.95, 0.58 + CASE WHEN lower(section) IN ('method', 'experiment', 'results', 'discussion', 'conclusion') THEN 0.08 ELSE 0 END
    + CASE WHEN contains(lower(section), kind) OR (kind = 'result' AND section IN ('Results', 'Conclusion')) THEN 0.10 ELSE 0 END + CASE WHEN {_says('text', extract.CLAIM)} THEN 0.08 ELSE 0 END), 3)::DOUBLE AS sure FROM l
), m AS (
  SELECT *, CASE WHEN bad IS NOT NULL THEN least(sure, 0.55) ELSE sure END AS confidence, row_number() OVER (PARTITION BY record ORDER BY place, rank) AS ordinal,
    CASE WHEN kind IN ('method', 'model') AND {_key('label')} IN ('llm', 'largelanguagemodel', 'largelanguagemodels', 'languagemodel', 'languagemodels') THEN 'LLM' WHEN kind = 'metric' THEN {_NAMES} ELSE label END AS name FROM c
), n AS (
  SELECT *, kind || ':' || record || ':' || {_key('name')} AS node FROM m
), g AS (
  SELECT record, node, kind, arg_min(name, ordinal) AS label, count(*) AS mentions, min(ordinal) AS ordinal, max(confidence) AS best, CASE WHEN count(DISTINCT section) = 1 THEN max(section) END AS section, arg_min(text, ordinal) AS text FROM n GROUP BY 1, 2, 3
), e AS (
  SELECT *, round(CASE WHEN kind <> 'citation' AND {_key('label')} IN ({_GENERIC}) THEN least(least(0.98, best + least(0.08, 0.02 * (mentions - 1))), 0.55) ELSE least(0.98, best + least(0.08, 0.02 * (mentions - 1))) END, 3)::DOUBLE AS confidence FROM g
)"""


@query(f"WITH {_MENTIONS} SELECT record, node, kind, label, mentions, ordinal, section, text, confidence, (confidence < 0.6 OR (kind <> 'citation' AND {_BAD('label')} IS NOT NULL)) AS needs_review FROM e")
def statements(spark, d):
    found = extract.with_nodes(extract.mentions(papers(spark, d)))
    return extract.entities(found).select("record", "node", "kind", "label", "mentions", "ordinal", "section", "text", "confidence", "needs_review")


def _found(spark, d):
    found = durable(extract.with_nodes(extract.mentions(papers(spark, d))))
    return found, durable(extract.entities(found))


_ROOTS = ", ".join(f"('{k}', '{t}', {str(out).lower()})" for k, (t, out) in extract.ROOT.items())
_CITED = " UNION ALL ".join(f"SELECT e.record, 'paper:' || e.record AS source, e.node AS target, '{t}' AS type, least(e.confidence, 0.88) AS confidence, 'citation_semantic_cue' AS method FROM e JOIN (SELECT DISTINCT node FROM n WHERE kind = 'citation' AND {_says('text', p)}) USING (node)" for t, p in extract.CITATION.items())


@query(f"""WITH {_MENTIONS}, k(kind, type, out) AS (VALUES {_ROOTS})
SELECT *, confidence < 0.6 AS needs_review FROM (SELECT record, CASE WHEN out THEN 'paper:' || record ELSE node END AS source, CASE WHEN out THEN node ELSE 'paper:' || record END AS target, type, confidence, 'direct_extraction' AS method FROM e JOIN k USING (kind) UNION ALL {_CITED})""")
def statement_roots(spark, d):
    return extract.root_relations(*_found(spark, d))


_PAIRS = ", ".join(f"('{a}', '{b}', '{t}')" for (a, b), t in extract.PAIRS.items())
_CUE = "CASE type " + " ".join(f"WHEN '{t}' THEN {_says('x.text', extract.CUES[t])} OR {_says('y.text', extract.CUES[t])}" for t in dict.fromkeys(extract.PAIRS.values())) + " END"


@query(f"""WITH {_MENTIONS}, k(a, b, type) AS (VALUES {_PAIRS}), x AS (
  SELECT x.record, x.node AS a, y.node AS b, type, x.block = y.block AS one_block, x.block = y.block AND x.sentence = y.sentence AS one, {_CUE} AS cue
  FROM n x JOIN k ON x.kind = k.a JOIN n y ON x.record = y.record AND y.kind = k.b AND x.section = y.section WHERE x.node <> y.node
), z AS (
  SELECT record, a, b, type, bool_or(one) AS one, bool_or(one_block) AS one_block, bool_or(one AND cue) AS cue_one, bool_or(one_block AND cue) AS cue_block, bool_or(cue) AS cue FROM x GROUP BY 1, 2, 3, 4
), w AS (
  SELECT z.*, p.ordinal AS i, q.ordinal AS j, least(p.confidence, q.confidence) AS sure FROM z JOIN e p ON p.node = z.a JOIN e q ON q.node = z.b
), v AS (
  SELECT *, CASE WHEN one THEN 'same_sentence' WHEN one_block THEN 'same_block' ELSE 'same_section' END AS method FROM w WHERE CASE WHEN one THEN cue_one WHEN one_block THEN cue_block ELSE cue END
), u AS (
  SELECT *, row_number() OVER (PARTITION BY method, b, type ORDER BY abs(i - j), i) AS nth FROM v
), f AS (
  SELECT record, a AS source, b AS target, type, round(CASE method WHEN 'same_sentence' THEN sure WHEN 'same_block' THEN sure * 0.95 ELSE least(round(sure * 0.82, 3), 0.58) END, 3)::DOUBLE AS confidence, method FROM u WHERE method <> 'same_section' OR nth = 1
)
SELECT *, method = 'same_section' OR confidence < 0.6 AS needs_review FROM f""")
def statement_relations(spark, d):
    return extract.pair_relations(*_found(spark, d))


_OLD = ["PROPOSES", "USES", "EVALUATES_ON", "MEASURED_BY", "ACHIEVES", "BELONGS_TO_TOPIC", "cites", ""]
_TYPES = ["paper", "model", "dataset", "Research_Gap", "topic", "method", ""]


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_OLD}[l_partkey % 8 + 1] AS old, {_TYPES}[l_suppkey % 7 + 1] AS a, {_TYPES}[l_orderkey % 7 + 1] AS b, CASE WHEN l_linenumber = 1 THEN 'evolution-topic:' ELSE 'n:' END || l_partkey AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN old = 'PROPOSES' AND a = 'paper' AND b = 'Research_Gap' THEN 'ADDRESSES' WHEN old = 'USES' AND b = 'model' THEN 'USES_MODEL' WHEN old = 'USES' AND b = 'dataset' THEN 'USES_DATASET' WHEN old = 'USES' THEN 'USES_METHOD'
WHEN old = 'EVALUATES_ON' THEN 'USES_DATASET' WHEN old = 'MEASURED_BY' THEN 'EVALUATED_BY' WHEN old = 'ACHIEVES' AND a IN ('', 'paper') THEN 'REPORTS_RESULT' WHEN old = 'ACHIEVES' THEN 'SUPPORTS' WHEN old = 'BELONGS_TO_TOPIC' AND (b = 'topic' OR l_linenumber = 1) THEN 'HAS_TOPIC' WHEN old = '' THEN 'MENTIONS' ELSE upper(old) END AS relation FROM x""")
def ontology_mapping(spark, d):
    """Line items as relations of old names between nodes of all types."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    target = F.concat(F.when(F.col("l_linenumber") == 1, "evolution-topic:").otherwise("n:"), F.col("l_partkey").cast("string"))
    relation = extract.canonical_relation(pick(_OLD, "l_partkey"), pick(_TYPES, "l_suppkey"), pick(_TYPES, "l_orderkey"), target)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", relation.alias("relation"))
