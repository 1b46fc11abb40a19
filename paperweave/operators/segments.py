"""Batches of text segments: classes, merges of neighbours, size batches, cached results, checks of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ascii_words, cjk_chars, clean_text, compact_length, sentence_ends


def segment_kind(text: Column) -> Column:
    """What a block of a paper is, by its text alone."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"(?i)^(?:doi|arxiv|issn|received|accepted|copyright)\b"), "metadata")
        .when(t.rlike(r"^[^A-Za-z]*=[^A-Za-z]*$"), "equation")
        .when(t.rlike(r"(?i)^references$|^\[\d+\]\s"), "reference")
        .when(t.rlike(r"(?i)^(?:fig(?:ure|\.)|table|scheme)\s*\d+"), "caption")
        .when(t.rlike(r"^\d+(?:\.\d+)*\.?\s+\S") & (F.length(t) <= 90), "heading")
        .when((F.length(t) <= 60) & ~t.rlike(r"[.!?。！？]$"), "title")
        .otherwise("body")
    )


def in_references(segments: DataFrame, doc: str, place: str, text: str) -> DataFrame:
    """Segments with `in_references`: from the references' heading on."""
    w = Window.partitionBy(doc).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("in_references", F.max(F.lower(F.trim(text)) == "references").over(w))


def merge_runs(rows: DataFrame, doc: str, place: str, same: str, text: str) -> DataFrame:
    """(doc, run, same, first, parts, text): neighbours with an equal value become one, in order."""
    w = Window.partitionBy(doc).orderBy(place)
    starts = (~F.col(same).eqNullSafe(F.lag(same).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = rows.withColumn("_s", starts).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.coalesce(text, F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return runs.groupBy(doc, "run", same).agg(F.min(place).alias("first"), F.count("*").alias("parts"), listed.alias("text"))


def size_batches(rows: DataFrame, doc: str, place: str, size: Column, most_rows: int = 20, most_size: int = 6000) -> DataFrame:
    """Rows with `batch`: a new one begins where the next row would pass either limit. Rows of a document are read in order, in batches of Arrow.

    What a batch holds depends on all before it, so a document's rows go through
    one task in order; only the running sums are kept in memory.
    """
    import pandas as pd

    base = rows.withColumn("_size", size.cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    columns = rows.columns

    def run(frames):
        at, batch, count, total = None, 0, 0, 0
        for f in frames:
            out = []
            for d, n in zip(f[doc], f["_size"], strict=True):
                n = 0 if pd.isna(n) else int(n)
                if d != at:
                    at, batch, count, total = d, 0, 0, 0
                elif count and (count >= most_rows or total + n > most_size):
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + n
                out.append(batch)
            yield f[columns].assign(batch=pd.Series(out, index=f.index, dtype="int32"))

    return base.repartition(doc).sortWithinPartitions(doc, place).mapInPandas(run, schema)


def cached_results(segments: DataFrame, cache: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Segments with a cached result, and the distinct keys that miss one. cache (key, result)."""
    named = segments.withColumn("key", key)
    hit = named.join(cache.select("key", "result"), "key")
    miss = named.join(cache.select("key"), "key", "left_anti").select("key").distinct()
    return hit, miss


def suspicious_pair(source: Column, result: Column) -> Column:
    """Whether a result looks cut or padded: its length or its sentence ends are far from the source's."""
    a, b = compact_length(source), compact_length(result)
    ratio = b / F.greatest(a, F.lit(1))
    return (b == 0) | ((a >= 80) & ((ratio < 0.15) | (ratio > 4.0))) | ((sentence_ends(source) >= 3) & (sentence_ends(result) == 0))


def probably_untranslated(source: Column, result: Column, least_overlap: float = 0.7) -> Column:
    """Whether a result in Chinese is missing: few CJK characters, and most of the source's words in it."""
    words = F.array_distinct(ascii_words(F.lower(source)))
    kept = F.size(F.array_intersect(words, ascii_words(F.lower(result))))
    share = cjk_chars(result) / F.greatest(compact_length(result), F.lit(1))
    return (F.size(words) >= 5) & (share < 0.1) & (kept >= least_overlap * F.size(words))


def warning_report(segments: DataFrame, target: str = "zh", preview: int = 90) -> DataFrame:
    """(sid, warning) of segments (sid, text, result, translate) that look untranslated; those without a result, or not to be translated, are left out."""
    lost, what = (cjk_chars(F.col("result")) >= 0.3 * F.greatest(compact_length(F.col("result")), F.lit(1)), "Chinese") if target == "en" else (probably_untranslated(F.col("text"), F.col("result")), "English")
    shown = segments.filter(F.col("translate") & (F.coalesce("result", F.lit("")) != "") & lost)
    said = F.concat(F.col("sid").cast("string"), F.lit(f": possible untranslated {what} remains: "), F.substring(clean_text(F.col("text")), 1, preview))
    return shown.select("sid", said.alias("warning"))


def replace_variants(text: Column, canonical: str, variants: list[str]) -> Column:
    """Each variant, as a whole word in either case, becomes the canonical term."""
    escaped = "|".join(sorted((v.replace(".", r"\.") for v in variants), key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)\b(?:{escaped})\b", canonical)


def guard_term(source: Column, result: Column, trigger: str, canonical: str, variants: list[str]) -> Column:
    return F.when(F.contains(F.lower(source), F.lit(trigger.lower())), replace_variants(result, canonical, variants)).otherwise(result)
