"""Text and token functions as Columns."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic (fixed values of the search-term rule).
STOPWORDS = "a an and are as at be by for from in into is it its of on or that the their this to was were with".split()
#: Short forms of search terms (fixed values).
TERM_ALIASES = {"li": "lithium", "na": "sodium", "s": "sulfur"}


def bind(value: Column, f) -> Column:
    """f of a value that is computed once, however often f looks at it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_only(value: Column) -> Column:
    """Whether a text has one byte a character; there patterns need no tables of Unicode, which cost many times as much."""
    return F.octet_length(value) == F.char_length(value)


def clean_text(value: Column) -> Column:
    """Soft hyphens go, words parted by a hyphen and white space join, white space becomes one space."""
    def cleaned(text):
        plain = F.regexp_replace(F.regexp_replace(text, r"-(?<=\w-)\s+(?=\w)", ""), r"\s+", " ")
        return F.trim(F.when(ascii_only(text), plain).otherwise(F.regexp_replace(F.regexp_replace(text, r"(?U)(?<=\w)-\s+(?=\w)", ""), r"(?U)\s+", " ")))

    return bind(F.replace(F.coalesce(value, F.lit("")), F.lit("\u00ad")), cleaned)


#: Characters of sub- and superscripts (fixed values).
SUB = str.maketrans("0123456789+-=()x", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₓ")
SUPER = str.maketrans("0123456789+-=()n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿ")
#: Replacements after scripts are translated, in order (fixed values): tags of blocks, other tags, white space, split names of elements, spaces before scripts, between elements and counts, MXene, spaces around signs.
MARKUP = [
    (r"(?i)</?(?:p|br|div|li|title|abstract|sec|section)\b[^>]*>", " "),
    (r"<[^>]+>", ""),
    (r"^\s+|\s+$", ""),
    (r"\s+", " "),
    (r"(?<=[A-Z])\s+(?=[a-z](?:\s|$|[^a-z]))", ""),
    (r"\s+(?=[₀-₉₊₋₌₍₎ₓ⁰-⁹⁺⁻⁼⁽⁾ⁿ])", ""),
    (r"\b([A-Z][a-z])\s+(?=[A-Z][a-z]?[₀-₉₊₋₌₍₎ₓ⁰-⁹⁺⁻⁼⁽⁾ⁿ])", r"\1"),
    (r"([A-Za-z][₀-₉₊₋₌₍₎ₓ⁰-⁹⁺⁻⁼⁽⁾ⁿ])\s+(?=[A-Z][₀-₉₊₋₌₍₎ₓ⁰-⁹⁺⁻⁼⁽⁾ⁿ])", r"\1"),
    (r"(?i)\bMX\s+ene\b", "MXene"),
    (r"\s+([,.;:!?%])", r"\1"),
    (r"\s*([-–—/])\s*", r"\1"),
]


def plain_markup(value: str | None) -> str:
    """A text of HTML or JATS markup as plain text: entities decoded, sub and sup in characters of their own, formulas closed up."""
    out = html.unescape(value or "")
    for tag, names in (("sub", SUB), ("sup", SUPER)):
        script = re.compile(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>")
        out = script.sub(lambda m, names=names: html.unescape(re.sub(r"<[^>]+>", "", m[1])).strip().translate(names), out)
    for pattern, plain in MARKUP:
        out = re.sub(pattern, plain, out)
    return out


def clean_markup(value: Column) -> Column:
    """plain_markup of a column, in Arrow batches: what stands in a span decides its letters, which no built-in replacement can. Null gives empty text."""
    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(plain_markup)

    return cleaned(value)


def normalize_term(term: Column) -> Column:
    """Aliases, then ies to y, then a final s off words of more than three letters that do not end in ss."""
    aliased = F.coalesce(*(F.when(term == k, F.lit(v)) for k, v in TERM_ALIASES.items()), term)
    stem = F.when(aliased.rlike("^.{2,}ies$"), F.regexp_replace(aliased, "ies$", "y"))
    return F.coalesce(stem, F.when((F.length(aliased) > 3) & aliased.endswith("s") & ~aliased.endswith("ss"), F.regexp_replace(aliased, "s$", "")), aliased)


def search_terms(value: Column) -> Column:
    """Stemmed terms of a text, in order, with repeats."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), normalize_term)


def keyword_terms(value: Column) -> Column:
    """Distinct stemmed terms of a keyword without stop words."""
    return F.array_except(F.array_distinct(search_terms(value)), F.array(*map(F.lit, STOPWORDS)))


def group_key(value: Column) -> Column:
    return F.array_join(keyword_terms(value), " ")


def keyword_match(keyword: Column, text: Column, ratio: float = 0.75) -> Column:
    """Whether a text has the keyword as a phrase, or enough of its terms: all of two, else the ratio rounded up, two at least."""
    terms = keyword_terms(keyword)
    hits = F.size(F.array_intersect(terms, search_terms(text)))
    need = F.when(F.size(terms) <= 2, F.size(terms)).otherwise(F.greatest(F.lit(2), F.floor(F.size(terms) * ratio + 0.999).cast("int")))
    return F.contains(F.lower(text), F.lower(F.trim(keyword))) | ((F.size(terms) > 0) & (hits >= need))


#: Stands for the full stop of `et al.` while a text is cut.
STOP = "\ue000"


def sentences(value: Column) -> Column:
    """Sentences of 25 to 600 characters, of 12 to 600 with CJK characters; every . ! ? ends one, but not that of `et al.`."""
    def cut(text):
        plain = F.split(F.regexp_replace(text, r"(?i)\b(et\s+al)\.", "$1" + STOP), r"(?<=[.!?])\s*")
        return F.when(ascii_only(text), plain).otherwise(F.split(F.regexp_replace(text, r"(?iU)\b(et\s+al)\.", "$1" + STOP), r"(?U)(?<=[.!?。！？])\s*"))

    parts = F.transform(bind(clean_text(value), cut), lambda x: F.trim(F.replace(x, F.lit(STOP), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s).between(12, 600) & ((F.length(s) >= 25) | s.rlike(r"[\u3400-\u9fff]")))


def summary(abstract: Column, most: int = 360) -> Column:
    """The first sentence, or the first `most` characters where that has less than 80."""
    text = clean_text(abstract)
    first = F.get(F.split(text, r"(?<=[.!?])\s+", 2), 0)
    return F.when(F.length(first) >= 80, F.substring(first, 1, most)).otherwise(F.substring(text, 1, most))


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"(?U)[^\w.-]+", "_"), r"^_+|_+$", "")


def semantic_key(value: Column) -> Column:
    """Folded and in lower case, five nouns made singular, separators and other signs dropped."""
    nouns = r"\b(model|method|framework|dataset|result)s\b"

    def bare(low):
        plain = F.regexp_replace(F.regexp_replace(low, nouns, "$1"), "[^a-z0-9]+", "")
        return F.when(ascii_only(low), plain).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "(?U)" + nouns, "$1"), r"(?U)[\s_-]+", ""), r"(?U)[^\w\u3400-\u9fff]+", ""))

    return bind(F.lower(fold(value)), bare)


#: Names of one method (fixed values).
METHOD_NAMES = {"llm": "LLM", "largelanguagemodel": "LLM", "largelanguagemodels": "LLM", "languagemodel": "LLM", "languagemodels": "LLM"}
#: Names of metrics (fixed values).
METRIC_NAMES = {
    "accuracy": "Accuracy", "auc": "AUC", "bleu": "BLEU", "f1": "F1", "f1score": "F1", "latency": "Latency", "mae": "MAE", "precision": "Precision",
    "recall": "Recall", "rmse": "RMSE", "rouge": "ROUGE", "throughput": "Throughput", "准确率": "Accuracy", "精确率": "Precision", "召回率": "Recall",
}
#: Labels that say nothing (fixed values).
GENERIC = ("approach", "architecture", "dataset", "experiment", "framework", "method", "model", "result", "results", "system", "task", "technique", "方法", "模型", "框架", "数据集", "结果", "实验", "系统")


def _named(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def canonical_label(value: Column, kind: Column | None = None) -> Column:
    """`Long Form (ABC)` becomes ABC; of a method or model, names of language models LLM; of a metric, each part between slashes its usual name."""
    found = r"(?U)\b([A-Za-z][A-Za-z][A-Za-z\s-]{4,80}?)\s*\(([A-Z][A-Z0-9-]{1,12})\)"
    short = lambda f: F.when(F.contains(f, F.lit("(")), F.nullif(F.regexp_extract(f, found, 2), F.lit("")))
    plain = lambda folded: F.coalesce(short(folded), folded)
    if kind is None:
        return bind(fold(value), plain)
    key = lambda v: _named(METHOD_NAMES, semantic_key(v))
    model = lambda f: F.coalesce(short(f), key(f), f)
    metric = lambda v: F.array_join(F.array_distinct(F.transform(F.split(v, r"\s*/\s*"), lambda x: F.coalesce(_named(METRIC_NAMES, semantic_key(x)), F.trim(x)))), " / ")
    method = lambda f: F.coalesce(key(f), plain(f))
    return bind(value, lambda v: F.when(kind == "method", bind(fold(v), method)).when(kind == "model", bind(fold(v), model)).when(kind == "metric", metric(v)).otherwise(bind(fold(v), plain)))


def generic_label(value: Column) -> Column:
    return semantic_key(value).isin(*dict.fromkeys(w.removesuffix("s") if w == "results" else w for w in GENERIC))


def invalid_label(value: Column) -> Column:
    """Why a label is not one, or null."""
    generic = list(dict.fromkeys(w.removesuffix("s") if w == "results" else w for w in GENERIC))

    def why(x):
        folded, key = x["folded"], x["key"]
        return (
            F.when(key == "", F.lit("empty_label"))
            .when((F.length(key) < 3) & ~folded.rlike(r"[\u3400-\u9fff]"), F.lit("label_too_short"))
            .when(folded.rlike(r"(?U)^[\d\W_]+$"), F.lit("non_semantic_label"))
            .when(key.isin(*generic), F.lit("generic_label"))
        )

    return bind(fold(value), lambda f: bind(F.struct(f.alias("folded"), semantic_key(f).alias("key")), why))


def phrases(words: Column, sizes=(3, 2)) -> Column:
    """Runs of neighbouring words of the given sizes, longest first, distinct."""
    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + (n - 1) <= F.size(words))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def compact_length(value: Column) -> Column:
    return F.length(F.regexp_replace(value, r"\s+", ""))


def sentence_ends(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"[.!?。！？]"))


def cjk_chars(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"[一-鿿]"))


def ascii_words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(r"[A-Za-z]+"), F.lit(0))


def protected_word(word: Column) -> Column:
    """Acronyms and formula-like words, which a translation keeps."""
    return word.rlike(r"^(?:[A-Z]{2,}[A-Za-z0-9-]*|[A-Za-z]*\d[A-Za-z0-9-]*)$")


def search_document(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))


def split_values(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, r"[;,|，；、\n]+"), lambda x: F.trim(x)), lambda v: v != "")


#: Characters that are folded to plain ones (fixed values): dashes, Greek letters by name.
DASHES = "‐‑–—"
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}


def _compatibility() -> tuple[str, str, dict[str, str]]:
    """Characters that have a compatibility form, by the rule of NFKC: those with one character for one, and Latin ones with several."""
    single, plain, several = [], [], {}
    for code in range(0x80, 0x10000):
        form = "" if 0xD800 <= code < 0xE000 else unicodedata.normalize("NFKC", chr(code))
        if form != chr(code) and len(form) == 1:
            single.append(chr(code))
            plain.append(form)
        elif len(form) > 1 and form.isascii():
            several[chr(code)] = form
    return "".join(single), "".join(plain), several


WIDE, PLAIN, SEVERAL = _compatibility()


def _ranges(chars) -> str:
    """The characters as ranges of a pattern's class."""
    codes, out = sorted(set(map(ord, chars))), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


#: What folding changes beside white space; only texts that have it are looked at character by character.
FOLDED = rf"[\x80-\uffff&&[{_ranges(WIDE + DASHES + ''.join(SEVERAL) + ''.join(GREEK))}]]"


def fold(value: Column) -> Column:
    """Compatibility characters become plain ones, dashes hyphens, Greek letters their names, white space one space.

    Letters and their accents are not joined where they stand apart.
    """
    spelled = F.str_to_map(F.lit("\ue001".join(f"{k}\ue002{v}" for k, v in SEVERAL.items())), F.lit("\ue001"), F.lit("\ue002"))

    def plain(said):
        chars = F.transform(F.split(F.translate(said, WIDE + DASHES, PLAIN + "-" * len(DASHES)), ""), lambda c: F.when(F.octet_length(c) > 1, F.coalesce(F.try_element_at(spelled, c), c)).otherwise(c))
        out = F.array_join(chars, "")
        for letter, name in GREEK.items():
            out = F.replace(out, F.lit(letter), F.lit(name))
        return F.trim(F.when(ascii_only(said), F.regexp_replace(said, r"\s+", " ")).otherwise(F.regexp_replace(F.when(said.rlike(FOLDED), out).otherwise(said), r"(?U)\s+", " ")))

    return bind(F.coalesce(value, F.lit("")), plain)


def raw_terms(value: Column) -> Column:
    """Distinct terms without stop words, as written."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, STOPWORDS)))


def query_string(keyword: Column, field: str = "all") -> Column:
    """The phrase, or all of its terms."""
    terms = F.array_join(F.transform(raw_terms(keyword), lambda t: F.concat(F.lit(f"{field}:"), t)), " AND ")
    return F.concat(F.lit(f'{field}:"'), F.lower(F.trim(keyword)), F.lit('" OR ('), terms, F.lit(")"))


def between_headings(value: Column, first: str, following: str) -> Column:
    """The text after the heading `first` up to a heading of `following`; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(value, rf"(?is)(?:^|\n)\s*(?:{first})\b[:.\s]*(.+?)(?=\n\s*(?:{following})\b|\z)", 1)), F.lit(""))


def cjk_runs(value: Column) -> Column:
    """Distinct runs of two to eight CJK characters."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(r"[一-鿿]{2,8}"), F.lit(0)))


def alias(value: Column, names: dict[str, str]) -> Column:
    """Lower case without punctuation at the ends, then the name that an alias stands for."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"(?U)^\W+|\W+$", ""), r"\s+", " ")
    if not names:
        return bare
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), bare), bare)


def first_by_key(values: Column, key, most: int) -> Column:
    """The values of an array, of equal keys the first, `most` at the most; empty ones go."""
    def first(kept):
        return bind(F.transform(kept, lambda v: key(v)), lambda keys: F.slice(F.filter(kept, lambda v, i: F.array_position(keys, F.get(keys, i)) == i + 1), 1, most))

    return bind(F.filter(values, lambda v: F.length(F.trim(v)) > 0), first)


def keyword_candidates(explicit: Column, matched: Column, title: Column, most: int = 10) -> Column:
    """Given keywords, matched ones, then phrases of the title; of equal terms the first."""
    return first_by_key(F.concat(F.coalesce(explicit, F.array().cast("array<string>")), F.coalesce(matched, F.array().cast("array<string>")), bind(raw_terms(title), lambda words: phrases(words))), lambda v: F.lower(F.trim(v)), most)
