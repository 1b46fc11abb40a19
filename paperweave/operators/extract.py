"""Statements of papers: sections, typed mentions by ordered rules, entities merged from them, relations by context, the ontology of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_only, bind, canonical_label, clean_text, fold, generic_label, invalid_label, semantic_key, sentences
from ..storage import durable

#: Kinds of mentions and their patterns, in the order in which they are tried (fixed values). No letter's case counts.
KINDS = {
    "contribution": r"\b(?:we|this (?:paper|work|study)) (?:propose|introduce|present|contribute|develop)\b|(?:本文|本研究|本文工作).{0,8}(?:提出|贡献|设计|开发)",
    "researchgap": r"\b(?:however|remains? (?:unclear|unknown|challenging)|lack(?:s|ing)?|few studies)\b|(?:然而|仍不清楚|研究空白|缺乏研究)",
    "problem": r"\b(?:problem|challenge|bottleneck|difficulty)\b|(?:问题|挑战|瓶颈|难点)",
    "conclusion": r"\b(?:we conclude|this (?:paper|study) concludes|in conclusion|our conclusion)\b|(?:我们得出结论|本文结论|研究结论|综上所述)",
    "result": r"\b(?:results? (?:show|indicate|demonstrate)|outperform|achieve|achieves|improve|improves|improved|reduce|reduced)\b|(?:结果表明|优于|达到|提升|降低)",
    "limitation": r"\b(?:limitation|limitations|limited by|drawback|weakness|constraint)\b|(?:局限|不足|缺点|受限)",
    "futurework": r"\b(?:future work|future research|in the future|will explore|will investigate)\b|(?:未来工作|未来研究|后续工作|将进一步)",
    "dataset": r"\b(?:dataset|corpus|benchmark|database|cohort)\b|(?:数据集|语料库|基准数据|数据库|队列)",
    "metric": r"\b(?:accuracy|precision|recall|f1(?:-score)?|auc|rmse|mae|bleu|rouge|latency|throughput)\b|(?:准确率|精确率|召回率|误差|延迟|吞吐量)",
    "experiment": r"\b(?:experiment|evaluation|ablation|control group|randomized)\b|(?:实验|评估|消融|对照组|随机试验)",
    "model": r"\b(?:[A-Z][A-Za-z0-9_-]{2,}\s+)?(?:model|architecture|large language model|language model|LLM)\b|(?:模型|架构)",
    "method": r"\b(?:we use|we employ|we propose|method|algorithm|model|framework|architecture|large language model|language model|LLM)\b|(?:方法|模型|算法|框架)",
    "citation": r"\[\d+(?:(?:[,-]\s*|\s+)\d+)*[,-]?\s*\]|\b[A-Z][A-Za-z-]+\s+et\s+al\.?(?:,?\s*\d{4})?",
}
#: What makes a sentence one of limits, of the future, of a measured result (fixed values).
LIMITATION = r"\b(?:limitation|limitations|limited by|drawback|weakness|constraint|fail(?:s|ure)?|cannot|unable)\b|(?:局限|不足|缺点|受限|无法|不能)"
FUTURE = r"\b(?:future work|future research|in the future|will explore|will investigate)\b|(?:未来工作|未来研究|后续工作|将进一步)"
NUMERIC = (
    r"\b(?:accuracy|precision|recall|f1(?:-score)?|auc|rmse|mae|bleu|rouge|latency|throughput)\s*(?:=|of|is|was|reaches?|achieves?)\s*\d+(?:\.\d+)?\s*%?\b|"
    r"\b(?:improv(?:e|ed|es)|reduc(?:e|ed|es)|increas(?:e|ed|es))\s+(?:by\s+)?\d+(?:\.\d+)?\s*%?\b|"
    r"(?:准确率|精确率|召回率|延迟|吞吐量).{0,12}(?:提升|降低|达到|为)\s*\d+(?:\.\d+)?%?"
)
#: What names a method, and what a dataset (fixed values).
METHOD_ALIAS = r"\b(?:large language model|language model|LLM)\b"
NAMED = r"\b([A-Z][A-Za-z0-9_-]{2,})\s+(?:framework|model|method|algorithm|architecture)\b"
DESCRIBED = r"\b(?:a|an|the)?\s*([a-z][a-z0-9_-]+)\s+(?:framework|model|method|algorithm|architecture)\b"
ALONE = r"\b(method|model|framework|approach|algorithm|architecture)\b"
DATASET = r"(?:[A-Za-z0-9_-]+\s+){0,3}(?:dataset|corpus|benchmark|database|cohort)|[㐀-鿿A-Za-z0-9_-]{0,12}(?:数据集|语料库|基准数据|队列)"
CLAIM = r"\b(?:we|our|this (?:paper|study|work))\b|(?:本文|本研究)"
#: Labels of mentions that no name stands for begin so (fixed values).
PREFIX = {"contribution": "Contribution", "researchgap": "Research gap", "problem": "Problem", "experiment": "Experiment", "result": "Result", "limitation": "Limitation", "futurework": "Future work", "conclusion": "Conclusion"}
#: Section names by their headings (fixed values).
SECTIONS = {
    "abstract": "Abstract", "摘要": "Abstract",
    "introduction": "Introduction", "background": "Introduction", "引言": "Introduction", "绪论": "Introduction",
    "method": "Method", "methods": "Method", "methodology": "Method", "materials and methods": "Method", "方法": "Method", "材料与方法": "Method",
    "experiment": "Experiment", "experiments": "Experiment", "experimental setup": "Experiment", "evaluation": "Experiment", "实验": "Experiment", "实验设置": "Experiment",
    "result": "Results", "results": "Results", "结果": "Results",
    "discussion": "Discussion", "讨论": "Discussion",
    "limitation": "Limitation", "limitations": "Limitation", "局限": "Limitation", "局限性": "Limitation",
    "conclusion": "Conclusion", "conclusions": "Conclusion", "结论": "Conclusion",
    "future work": "Future Work", "future research": "Future Work", "展望": "Future Work", "未来工作": "Future Work",
    "references": "References", "reference": "References", "bibliography": "References", "参考文献": "References",
}
#: Words by which a text speaks of a relation; a relation without words is never spoken of (fixed values).
CUES = {
    "ADDRESSES": r"\b(?:address|addresses|solve|solves|tackle|tackles|problem|challenge)\b|(?:解决|应对|问题|挑战)",
    "USES_METHOD": r"\b(?:use|uses|using|employ|employs|apply|applies|method|algorithm|experiment|equation|based on)\b|(?:使用|采用|应用|方法|算法|实验|公式|基于)",
    "USES_MODEL": r"\b(?:use|uses|using|employ|employs|model|architecture|based on)\b|(?:使用|采用|模型|架构|基于)",
    "USES_DATASET": r"\b(?:evaluate|evaluates|evaluated|test|tests|tested|train|trained|on|using|with)\b|(?:评估|测试|训练|在.+上)",
    "EVALUATED_BY": r"\b(?:measure|measured|metric|score|accuracy|precision|recall|f1|auc|rmse|mae|latency)\b|(?:指标|准确率|精确率|召回率|延迟)",
    "REPORTS_RESULT": r"\b(?:report|reports|result|conclude|achieve|improve|outperform|show|demonstrate|reduce)\w*\b|(?:报告|结果|结论|达到|提升|优于|表明|降低)",
    "PROPOSES": r"\b(?:propose|proposes|proposed|introduce|introduces|present|presents|use|uses|using|employ|employs)\b|(?:提出|引入|采用|使用)",
    "EVALUATES_ON": r"\b(?:evaluate|evaluates|evaluated|test|tests|tested|train|trained|on|using|with)\b|(?:评估|测试|训练|在.+上)",
    "MEASURED_BY": r"\b(?:measure|measured|metric|score|accuracy|precision|recall|f1|auc|rmse|mae|latency)\b|(?:指标|准确率|精确率|召回率|延迟)",
    "ACHIEVES": r"\b(?:achieve|achieves|achieved|improve|improves|improved|outperform|outperforms|show|shows|demonstrate|demonstrates|reduce|reduced)\b|(?:达到|提升|优于|表明|降低|减少)",
    "LIMITS": LIMITATION,
    "SUPPORTS": r"\b(?:figure|fig\.|table|caption|show|shows|illustrate|illustrates|support|supports)\b|(?:图|表|显示|说明|支持)",
    "USES": r"\b(?:use|uses|using|employ|employs|apply|applies|based on)\b|(?:使用|采用|应用|基于)",
    "CITES": r"\[[\d,\-\s]+\]|\bet\s+al\.?\b",
}
#: The relation of the paper and each kind of entity, and whether it goes out from the paper (fixed values).
ROOT = {
    "contribution": ("PROPOSES", True), "researchgap": ("ADDRESSES", True), "problem": ("ADDRESSES", True), "method": ("USES_METHOD", True), "model": ("USES_MODEL", True), "experiment": ("USES_METHOD", True),
    "dataset": ("USES_DATASET", True), "metric": ("EVALUATED_BY", True), "result": ("REPORTS_RESULT", True), "conclusion": ("REPORTS_RESULT", True), "limitation": ("LIMITS", False), "futurework": ("PROPOSES", True),
    "citation": ("CITES", True), "figure": ("SUPPORTS", False), "table": ("SUPPORTS", False), "paragraph": ("SUPPORTS", False), "equation": ("USES_METHOD", True),
}
#: Relations between kinds of entities (fixed values).
PAIRS = {
    ("contribution", "method"): "PROPOSES", ("method", "dataset"): "USES_DATASET", ("model", "dataset"): "USES_DATASET", ("experiment", "dataset"): "USES_DATASET", ("result", "metric"): "EVALUATED_BY",
    ("method", "result"): "SUPPORTS", ("model", "result"): "SUPPORTS", ("limitation", "method"): "LIMITS", ("limitation", "model"): "LIMITS", ("limitation", "result"): "LIMITS",
    ("figure", "result"): "SUPPORTS", ("table", "result"): "SUPPORTS", ("paragraph", "result"): "SUPPORTS", ("method", "equation"): "USES_METHOD",
}
#: Confidence of a relation by its context, and its most for the last one (fixed values).
CONTEXT = {"same_sentence": 1.0, "same_block": 0.95, "caption": 0.88, "same_section": 0.82}
SECTION_MOST = 0.58
#: What a citation's context says beside citing (fixed values).
CITATION = {"EXTENDS": r"\b(?:extend|extends|extended|extension of)\b|(?:扩展|拓展|延伸)", "IMPROVES_ON": r"\b(?:improve|improves|improved)\s+(?:on|upon)\b|(?:改进自|在.+基础上改进|优于)"}
#: Layout elements that become entities, by the names they come under (fixed values).
ELEMENTS = {"figure": "figure", "chart": "figure", "table": "table", "equation": "equation", "formula": "equation", "paragraph": "paragraph"}
#: Kinds whose generic labels lower the confidence (fixed values).
REVIEWED = ("concept", "researchgap", "problem", "researchquestion", "contribution", "method", "model", "dataset", "metric", "experiment", "result", "conclusion", "limitation", "futurework", "domainentity", "material")


def says(text: Column, pattern: str) -> Column:
    """Whether a text has the pattern, in any case and with letters of all scripts."""
    return F.when(ascii_only(text), text.rlike(f"(?i){pattern}")).otherwise(text.rlike(f"(?iU){pattern}"))


def lookup(names: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in names.items() for x in kv]), key)


def heading(text: Column) -> Column:
    """The section that a heading of at most 90 characters once folded names, without its number; null for other text."""
    number = r"^\s*(?:chapter\s+)?(?:[ivxlcdm]+|\d+)(?:\.\d+)*[).\s:-]+"
    bare = lambda f: F.when(ascii_only(f), F.regexp_replace(f, "(?i)" + number, "")).otherwise(F.regexp_replace(f, "(?iU)" + number, ""))
    named = lambda f: F.when(F.length(f) <= 90, lookup(SECTIONS, F.lower(F.btrim(bare(f), F.lit(" :：.-")))))
    compact = lookup(SECTIONS, F.lower(F.rtrim(F.trim(F.regexp_replace(clean_text(text), r"(?U)^[\d.\s]+", "")), F.lit(":："))))
    return F.when(F.length(text) <= 200, F.coalesce(bind(fold(text), named), compact))


def _texts(blocks: DataFrame) -> DataFrame:
    """(raw, text, _h): each text of the blocks once, cleaned, and the section that it names as a heading."""
    # outer: Spark would clean a text twice to see whether an inner explode has rows
    cleaned = blocks.select(F.col("text").alias("raw")).distinct().withColumn("text", F.explode_outer(F.array(clean_text(F.col("raw")))))
    return durable(cleaned.withColumn("_h", heading(F.col("text"))))


def sections(blocks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """blocks (record, page, block, text, and bbox and height where known) with `section`, that of the last heading, null before the first.

    Headings and references go, as do texts of 2 to 120 characters that stand in
    the upper or lower 12 % of pages as often as on 30 % of them, three times at least.
    Texts that blocks share are cleaned once; `known` is the table of them where it is there.
    """
    known = _texts(blocks) if known is None else known
    # a record's blocks meet once, over as many tasks as a shuffle has; their few bytes would otherwise go to few tasks
    dealt = blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "record").withColumnRenamed("text", "_raw")
    rows = dealt.join(known, F.col("_raw").eqNullSafe(F.col("raw"))).drop("_raw", "raw").filter("text != ''")
    if {"bbox", "height"} <= set(blocks.columns):
        at = lambda i: F.get("bbox", F.lit(i))
        margin = (F.size("bbox") >= 4) & (F.col("height") > 0) & ((at(1) <= 0.12 * F.col("height")) | (at(3) >= 0.88 * F.col("height"))) & F.length("text").between(2, 120)
        pages = blocks.groupBy("record").agg(F.countDistinct("page").alias("_pages"))
        low = F.lower("text").alias("_low")
        often = rows.groupBy("record", low).agg(F.count_if(margin).alias("_n")).filter("_n > 2").join(pages, "record").filter(F.col("_n") >= F.floor(F.col("_pages") * 0.30 + 0.999))
        rows = rows.withColumn("_low", F.lower("text")).join(often.select("record", "_low"), ["record", "_low"], "left_anti").drop("_low")
    w = Window.partitionBy("record").orderBy("page", "block").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumn("section", F.last("_h", ignorenulls=True).over(w))
    return named.filter("_h IS NULL AND coalesce(section, '') != 'References'").drop("_h")


def label_of(kind: Column, sentence: Column) -> Column:
    """What a mention is called: the name it gives, else its kind and the sentence's first 72 characters."""
    def first(p, g=0, flags="(?iU)"):
        found = F.when(ascii_only(sentence), F.regexp_extract(sentence, flags.replace("U", "").replace("(?)", "") + p, g)).otherwise(F.regexp_extract(sentence, flags + p, g))
        return bind(F.trim(found), lambda x: F.nullif(x, F.lit("")))

    excerpt = F.concat(F.substring(sentence, 1, 72), F.when(F.length(sentence) > 72, "...").otherwise(""))
    other = F.concat(F.coalesce(lookup(PREFIX, kind), F.initcap(kind)), F.lit(" · "), excerpt)
    metrics = F.array_join(F.array_distinct(F.regexp_extract_all(sentence, F.lit("(?iU)" + KINDS["metric"]), F.lit(0))), " / ")
    described = bind(first(DESCRIBED, 1), lambda d: F.when(~F.lower(d).isin("a", "an", "the"), d))
    method = F.coalesce(first(METHOD_ALIAS), first(NAMED, 1, "(?U)"), described, first(ALONE, 1))
    named = F.when(kind == "metric", F.nullif(metrics, F.lit(""))).when(kind.isin("method", "model"), method).when(kind == "dataset", first(DATASET)).when(kind == "citation", first(KINDS["citation"]))
    return F.coalesce(named, other)


def confidence(kind: Column, claims: Column, section: Column, boxed: Column) -> Column:
    """0.58, and more in a section of work done, in that of the kind, in the authors' own words, with a place on the page; 0.95 at most."""
    name = F.lower(F.coalesce(section, F.lit("")))
    done = F.when(name.isin("method", "experiment", "results", "discussion", "conclusion"), 0.08).otherwise(0.0)
    fits = F.when(F.contains(name, kind) | ((kind == "result") & section.isin("Results", "Conclusion")), 0.10).otherwise(0.0)
    return F.round(F.least(F.lit(0.95), 0.58 + done + fits + F.when(claims, 0.08).otherwise(0.0) + F.when(boxed, 0.05).otherwise(0.0)), 3)


def _told(texts: DataFrame) -> DataFrame:
    """What the sentences of texts are: (whole, sentence, said, key, rank, kind, label, bad, claims, future), a row a sentence and kind.

    Nothing of it depends on the record, so texts that records share are looked at once.
    """
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = texts.repartition(tasks, "text").select(F.col("text").alias("whole"), F.posexplode_outer(sentences(F.col("text"))).alias("sentence", "text")).filter("text IS NOT NULL")
    said = said.withColumn("folded", fold(F.col("text")))
    limits, measured = says(F.col("folded"), LIMITATION), says(F.col("folded"), NUMERIC)
    tests = [F.when((says(F.col("text"), p) | measured) & ~limits if k == "result" else says(F.col("text"), p), F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"))) for i, (k, p) in enumerate(KINDS.items())]
    key = F.substring(F.when(ascii_only(F.col("text")), F.regexp_replace(F.lower("text"), r"\W+", "")).otherwise(F.regexp_replace(F.lower("text"), r"(?U)\W+", "")), 1, 180)
    # outer explodes: Spark would compute the array of an inner one twice, once to ask whether it is empty
    typed = said.withColumn("kinds", F.array_compact(F.array(*tests))).withColumn("key", key).withColumn("k", F.explode_outer("kinds")).filter("k IS NOT NULL")
    kind, text = F.col("kind"), F.col("said")
    out = typed.select("whole", "sentence", F.col("text").alias("said"), "key", "k.rank", "k.kind")
    return out.withColumn("label", label_of(kind, text)).withColumn("bad", invalid_label(F.col("label"))).withColumn("claims", says(text, CLAIM)).withColumn("future", (kind == "futurework") & says(fold(text), FUTURE))


def mentions(blocks: DataFrame, metadata: DataFrame | None = None, elements: DataFrame | None = None) -> DataFrame:
    """Typed mentions: (record, ordinal, kind, label, text, confidence, section, block_id, sentence, origin, review).

    blocks as `sections` takes them; metadata (record, abstract, summary); elements
    (record, id, kind, page, caption, text, confidence). A sentence is tried with
    all kinds in order: sentences of limits hold no result, measured ones do, and
    one that has just given a result gives no method or model. Sentences that
    agree in their first 180 letters and digits give each kind once a record.
    Lowered confidence has its reason in `review`. Blank texts and null records'
    rows are treated as others; an empty table gives an empty table.
    """
    known = _texts(blocks)
    named = sections(blocks, known)
    boxed = F.size("bbox") >= 4 if "bbox" in named.columns else F.lit(False)
    place = [F.col("page").cast("long"), F.col("block").cast("long")]
    name = F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit("-block-"), F.col("block").cast("string"))
    parts = named.select("record", F.lit("pdf").alias("origin"), F.struct(F.lit(0).alias("m"), *[p.alias(x) for p, x in zip(place, "pb", strict=True)]).alias("at"), name.alias("block_id"), "section", F.coalesce(boxed, F.lit(False)).alias("boxed"), "text")
    texts = known.filter("_h IS NULL").select("text")
    if metadata is not None:
        for i, (column, source, section) in enumerate((("abstract", "metadata.abstract", "Abstract"), ("summary", "metadata.contentSummary", "Summary"))):
            at = F.struct(F.lit(1).alias("m"), F.lit(-1).cast("long").alias("p"), F.lit(i).cast("long").alias("b"))
            parts = parts.unionByName(metadata.select("record", F.lit("metadata").alias("origin"), at.alias("at"), F.lit(source).alias("block_id"), F.lit(section).alias("section"), F.lit(False).alias("boxed"), clean_text(F.col(column)).alias("text")))
            texts = texts.unionByName(metadata.select(F.col(column).alias("text")).distinct().select(clean_text(F.col("text")).alias("text")))
    typed = parts.join(_told(texts.distinct()).withColumnRenamed("whole", "text"), "text").drop("text").withColumn("place", F.struct("at", "sentence"))
    same = Window.partitionBy("record", "key")
    tried = typed.withColumn("_result", F.min(F.when(F.col("kind") == "result", F.col("place"))).over(same))
    open_ = tried.filter(~(F.col("kind").isin("method", "model") & F.coalesce(F.col("place") == F.col("_result"), F.lit(False))))
    once = open_.withColumn("_n", F.row_number().over(Window.partitionBy("record", "key", "kind").orderBy("place"))).filter("_n = 1")
    kind = F.col("kind")
    sure = confidence(kind, F.col("claims"), F.col("section"), F.col("boxed"))
    sure = F.when((kind == "futurework") & ~F.col("future"), F.least(sure, F.lit(0.62))).otherwise(sure)
    out = once.withColumn("confidence", F.when(F.col("bad").isNotNull(), F.least(sure, F.lit(0.55))).otherwise(sure))
    out = out.select("record", "place", "rank", kind, "label", F.col("said").alias("text"), "confidence", "section", "block_id", "sentence", "origin", F.array_compact(F.array("bad")).alias("review"))
    if elements is not None:
        out = out.unionByName(_element_mentions(elements, named))
    ordinal = F.row_number().over(Window.partitionBy("record").orderBy("place", "rank")).cast("long")
    return out.withColumn("ordinal", ordinal).drop("place", "rank")


def _element_mentions(elements: DataFrame, named: DataFrame) -> DataFrame:
    """Figures, tables, equations and paragraphs as mentions, in the last section that begins on their page or before."""
    kind = lookup(ELEMENTS, F.lower("kind"))
    rows = elements.withColumn("kind", kind).filter("kind IS NOT NULL")
    turns = named.filter("section IS NOT NULL").select("record", F.col("page").cast("long").alias("page"), F.lit(0).alias("_late"), F.col("block").cast("long").alias("_b"), "section")
    mine = rows.select("record", F.col("page").cast("long").alias("page"), F.lit(1).alias("_late"), F.lit(0).cast("long").alias("_b"), F.struct("id", "kind", "caption", "text", "confidence").alias("e"))
    w = Window.partitionBy("record").orderBy("page", "_late", "_b").rowsBetween(Window.unboundedPreceding, 0)
    both = turns.withColumn("e", F.lit(None).cast(mine.schema["e"].dataType)).unionByName(mine.withColumn("section", F.lit(None).cast("string")))
    found = both.withColumn("section", F.last("section", ignorenulls=True).over(w)).filter("e IS NOT NULL").select("record", "page", "section", "e.*")
    text = clean_text(F.coalesce(F.nullif("caption", F.lit("")), "text"))
    label = F.coalesce(F.nullif(F.trim("caption"), F.lit("")), F.concat(F.initcap("kind"), F.lit(" "), F.col("id").cast("string")))
    number = F.row_number().over(Window.partitionBy("record").orderBy("page", "id")).cast("long")
    place = F.struct(F.struct(F.lit(2).alias("m"), F.lit(0).cast("long").alias("p"), number.alias("b")).alias("at"), F.lit(0).alias("sentence"))
    origin = F.when(F.coalesce(F.trim("caption"), F.lit("")) != "", "caption").otherwise("element")
    return found.select(
        "record", place.alias("place"), F.lit(0).alias("rank"), "kind", label.alias("label"), text.alias("text"), F.coalesce("confidence", F.lit(1.0)).cast("double").alias("confidence"), "section",
        F.col("id").cast("string").alias("block_id"), F.lit(0).alias("sentence"), origin.alias("origin"), F.array().cast("array<string>").alias("review"),
    )


def with_nodes(found: DataFrame) -> DataFrame:
    """Mentions with `name`, their canonical label, and `node`, kind:record:key; mentions of one kind and key are one entity of the record."""
    found = durable(found)
    own = [F.col("kind").alias("_kind"), F.col("label").alias("_label"), F.substring("text", 1, 120).alias("_start")]
    same = [F.col("kind").eqNullSafe(F.col("_kind")), F.col("label").eqNullSafe(F.col("_label")), F.substring("text", 1, 120).eqNullSafe(F.col("_start"))]
    keyed = bind(canonical_label(F.col("_label"), F.col("_kind")), lambda n: F.struct(n.alias("name"), F.coalesce(F.nullif(semantic_key(n), F.lit("")), semantic_key(F.col("_start"))).alias("key")))
    # mentions that are called alike are named once
    named = found.join(found.select(*own).distinct().withColumn("_n", keyed), same).drop("_kind", "_label", "_start")
    return named.withColumn("name", F.col("_n.name")).withColumn("node", F.concat_ws(":", "kind", F.col("record").cast("string"), "_n.key")).drop("_n")


def entities(found: DataFrame) -> DataFrame:
    """Entities of mentions with nodes: (record, node, kind, label, mentions, ordinal, confidence, section, origins, text, review, needs_review).

    Each further mention adds 0.02 to the best one's confidence, 0.08 at most; a
    generic label holds it at 0.55. The section is that of all mentions that
    have one, null if they differ.
    """
    of = found.groupBy("record", "node", "kind").agg(
        F.min_by("name", "ordinal").alias("label"),
        F.count(F.lit(1)).alias("mentions"),
        F.min("ordinal").alias("ordinal"),
        F.max("confidence").alias("best"),
        F.when(F.count_distinct("section") == 1, F.max("section")).alias("section"),
        F.sort_array(F.collect_set("origin")).alias("origins"),
        F.min_by("text", "ordinal").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("review")))).alias("review"),
    )
    labels = found.select(F.col("name").alias("_label")).distinct().withColumn("_generic", generic_label(F.col("_label"))).withColumn("_bad", invalid_label(F.col("_label")))
    of = of.join(labels, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    reviewed = F.col("kind").isin(*REVIEWED)
    sure = F.least(F.lit(0.98), F.col("best") + F.least(F.lit(0.08), 0.02 * (F.col("mentions") - 1)))
    sure = F.round(F.when(reviewed & F.col("_generic"), F.least(sure, F.lit(0.55))).otherwise(sure), 3)
    bad = F.when(reviewed, F.col("_bad"))
    reasons = F.array_sort(F.array_distinct(F.array_compact(F.concat("review", F.array(bad, F.when(sure < 0.6, "low_confidence"))))))
    out = of.withColumn("confidence", sure).withColumn("review", reasons).drop("best", "_generic", "_bad")
    return out.withColumn("needs_review", F.size("review") > 0)


def root_relations(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record, source, target, type, confidence, method, needs_review): between the paper and each entity, and what citations say beside.

    A citation whose context speaks of extending or improving on gives such a relation too, of 0.88 at most.
    """
    paper = F.concat(F.lit("paper:"), F.col("record").cast("string"))
    spec = lookup({k: F.struct(F.lit(t).alias("type"), F.lit(out).alias("out")) for k, (t, out) in ROOT.items()}, F.col("kind"))
    method = F.when(F.col("origins") == F.array(F.lit("metadata")), "metadata").when(F.array_contains("origins", "caption"), "caption").otherwise("direct_extraction")
    rooted = nodes.withColumn("s", spec).filter("s IS NOT NULL")
    roots = rooted.select("record", F.when(F.col("s.out"), paper).otherwise(F.col("node")).alias("source"), F.when(F.col("s.out"), F.col("node")).otherwise(paper).alias("target"), "s.type", "confidence", method.alias("method"))
    cited = found.filter("kind = 'citation'").groupBy("record", "node").agg(*[F.max(says(F.col("text"), p)).alias(t) for t, p in CITATION.items()])
    said = cited.withColumn("type", F.explode(F.array_compact(F.array(*[F.when(F.col(t), F.lit(t)) for t in CITATION]))))
    more = said.join(nodes.select("record", "node", "confidence"), ["record", "node"]).select("record", paper.alias("source"), F.col("node").alias("target"), "type", F.least("confidence", F.lit(0.88)).alias("confidence"), F.lit("citation_semantic_cue").alias("method"))
    return roots.unionByName(more).withColumn("needs_review", F.col("confidence") < 0.6)


def pair_relations(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record, source, target, type, confidence, method, needs_review) between entities of kinds that relate.

    The best context of two entities is the best over their mentions: one
    sentence, one block, a caption in the section, the section. Joins by block
    come first; pairs without any go on to joins by section, and of those each
    target takes the nearest source (by least ordinals, the earlier in a tie).
    All contexts but captions ask for a cue of the relation in a text that
    the two have there. Pairs grow with a block's or section's mentions.
    """
    kinds = {}
    for (a, b), type_ in PAIRS.items():
        kinds.setdefault(a, []).append(F.struct(F.lit(b).alias("to"), F.lit(type_).alias("type")))
    spoken = F.array_compact(F.array(*[F.when(says(F.col("_text"), CUES[t]), F.lit(t)) for t in dict.fromkeys(PAIRS.values())]))
    least = nodes.select("record", "node", F.col("ordinal").alias("first"), F.col("confidence").alias("sure"))
    # cues are looked for once a text, not once for each side of each join
    cues = found.select(F.col("text").alias("_text")).distinct().select("_text", spoken.alias("cues"))
    told = found.join(cues, F.col("text").eqNullSafe(F.col("_text"))).select("record", "node", "kind", "section", "block_id", "sentence", "origin", "cues")
    told = durable(told.join(least, ["record", "node"]))
    left = told.withColumn("_", F.explode(lookup({k: F.array(*v) for k, v in kinds.items()}, F.col("kind")))).select(
        "record", "section", "block_id", F.col("_.to").alias("to"), F.col("_.type").alias("type"), *[F.col(c).alias(f"a_{c}") for c in ("node", "sentence", "origin", "cues", "first", "sure")]
    )
    right = told.select("record", F.col("kind").alias("to"), "section", "block_id", *[F.col(c).alias(f"b_{c}") for c in ("node", "sentence", "origin", "cues", "first", "sure")])
    pair = ["record", "a_node", "b_node", "type"]
    cue = F.array_contains("a_cues", F.col("type")) | F.array_contains("b_cues", F.col("type"))
    ends = [F.max(c).alias(c) for c in ("a_first", "a_sure", "b_first", "b_sure")]
    near = left.join(right.drop("section"), ["record", "block_id", "to"]).filter("a_node != b_node").withColumn("cue", cue).withColumn("one", F.col("a_sentence") == F.col("b_sentence"))
    near = near.groupBy(*pair).agg(F.max("one").alias("one"), F.max(F.col("cue") & F.col("one")).alias("cue_one"), F.max("cue").alias("cue"), *ends)
    blocks = near.filter(F.when(F.col("one"), F.col("cue_one")).otherwise(F.col("cue"))).withColumn("method", F.when(F.col("one"), "same_sentence").otherwise("same_block"))
    there = left.filter("section IS NOT NULL").join(right.drop("block_id"), ["record", "section", "to"]).filter("a_node != b_node")
    far = there.join(near.select(*pair), pair, "left_anti").withColumn("cue", cue).withColumn("caption", (F.col("a_origin") == "caption") | (F.col("b_origin") == "caption"))
    far = far.groupBy(*pair).agg(F.max("caption").alias("caption"), F.max("cue").alias("cue"), *ends)
    captions = far.filter("caption").withColumn("method", F.lit("caption"))
    nearest = Window.partitionBy("record", "b_node", "type").orderBy(F.abs(F.col("a_first") - F.col("b_first")), "a_first")
    section = far.filter("NOT caption AND cue").withColumn("_n", F.row_number().over(nearest)).filter("_n = 1").withColumn("method", F.lit("same_section"))
    columns = [*pair, "a_sure", "b_sure", "method"]
    out = blocks.select(*columns).unionByName(captions.select(*columns)).unionByName(section.select(*columns))
    sure = F.round(F.least("a_sure", "b_sure") * lookup(CONTEXT, F.col("method")), 3)
    sure = F.when(F.col("method") == "same_section", F.least(sure, F.lit(SECTION_MOST))).otherwise(sure)
    return out.select("record", F.col("a_node").alias("source"), F.col("b_node").alias("target"), "type", sure.alias("confidence"), "method").withColumn("needs_review", (F.col("method") == "same_section") | (F.col("confidence") < 0.6))


def has_cue(relation: str, text: Column) -> Column:
    """Whether a text speaks of a relation; never of one without cue words."""
    return says(fold(text), CUES[relation]) if relation in CUES else F.lit(False)


def canonical_relation(type_: Column, source: Column, target: Column, target_id: Column | None = None) -> Column:
    """The ontology's name of a relation between nodes of these types; upper case of its own name where no rule fits, MENTIONS for none."""
    name = F.upper(F.coalesce(F.nullif(type_, F.lit("")), F.lit("MENTIONS")))
    plain = lambda c: F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"))
    a, b = plain(source), plain(target)
    topic = b == "topic"
    if target_id is not None:
        topic = topic | F.startswith(F.coalesce(target_id, F.lit("")), F.lit("evolution-topic:"))
    return (
        F.when((name == "PROPOSES") & (a == "paper") & b.isin("problem", "researchgap", "researchquestion"), "ADDRESSES")
        .when(name == "USES", F.when(b == "model", "USES_MODEL").when(b == "dataset", "USES_DATASET").otherwise("USES_METHOD"))
        .when(name == "EVALUATES_ON", "USES_DATASET")
        .when(name == "MEASURED_BY", "EVALUATED_BY")
        .when(name == "ACHIEVES", F.when(a.isin("", "paper"), "REPORTS_RESULT").otherwise("SUPPORTS"))
        .when((name == "BELONGS_TO_TOPIC") & topic, "HAS_TOPIC")
        .otherwise(name)
    )


def canonical_filter(type_: Column) -> Column:
    """The same for a stored choice of a relation, without nodes; blank and ALL choose all."""
    return F.when(F.upper(F.coalesce(type_, F.lit(""))).isin("", "ALL"), "all").otherwise(canonical_relation(type_, F.lit(""), F.lit("")))


def graph_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean confidence, share with evidence, share in need of review, share without edges, dangling edges."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("_e", F.lit(1))
    x = nodes.join(ends, "id", "left")
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 4)
    per = x.agg(F.count("*").alias("nodes"), F.round(F.avg("confidence"), 4).alias("confidence"), share(F.col("evidence") > 0).alias("with_evidence"), share(F.coalesce("confidence", F.lit(1.0)) < 0.6).alias("to_review"), share(F.col("_e").isNull()).alias("isolated"))
    lost = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_anti").unionByName(edges.join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select(*edges.columns)).distinct()
    return per.join(edges.agg(F.count("*").alias("edges"))).join(lost.agg(F.count("*").alias("dangling")))


def group_candidates(rows: DataFrame, record: str, kind: str, label: str) -> DataFrame:
    """(record, kind, key, label, mentions): candidates of equal normalized label; the first label in order stands for them. Labels that are none go."""
    good = rows.filter(invalid_label(F.col(label)).isNull()).withColumn("_k", semantic_key(F.col(label)))
    return good.groupBy(record, kind, "_k").agg(F.min(label).alias("label"), F.count("*").alias("mentions")).withColumnRenamed("_k", "key")
