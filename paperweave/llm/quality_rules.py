"""Quality rules: base counts, and a likelihood ratio of hashed n-grams.

Two multinomials over hashed word n-grams are counted, one over the trusted
documents and one over all. A document's score is the mean log ratio of its
n-grams under the two; it is kept if it passes the base rules and its score
reaches a threshold, the fence below which scores lie far outside of those of
the trusted documents. Columns only, no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, shielded, table, unshielded

#: Buckets of the hashed n-grams; the table of weights has this size whatever the corpus.
BUCKETS = 8192
#: Added to each bucket's count, as a share of all n-grams spread evenly.
SMOOTH = 1.0
#: The fence lies so many quartile distances below the lower quartile of the trusted scores (the usual bound of far outliers).
FENCE = 3.0
#: Base rules: fewer words fail, and more than this percentage of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Trusted ids up to this number are broadcast (about 60 bytes each in a join's table).
BROADCAST_IDS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ngram_buckets(name: str, buckets: int = BUCKETS) -> Column:
    """The buckets of the words, and of the pairs of neighbouring words, in the array column of that name.

    It must be a column, not an expression: the lambdas look into it at each position.
    """
    n, words = F.lit(buckets).cast("long"), F.col(name)
    single = F.transform(words, lambda w: F.pmod(F.xxhash64(w), n).cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.get(words, i - 1), F.get(words, i)), n).cast("int"))
    return F.when(F.size(words) > 1, F.concat(single, pairs)).otherwise(single)


def _with_trust(rows: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """Rows with `_trusted`, 1 for trusted ids: by broadcast up to BROADCAST_IDS, else by a join in which rows without id take no part."""
    ids = materialize(trusted_ids.select("doc_id").filter("doc_id IS NOT NULL").distinct()).withColumn("_trusted", F.lit(1))
    if ids.count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(ids), "doc_id", "left")
    return rows.filter("doc_id IS NOT NULL").join(ids, "doc_id", "left").unionByName(rows.filter("doc_id IS NULL").withColumn("_trusted", F.lit(None).cast("int")))


def ngram_weights(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS, smooth: float = SMOOTH) -> list[float]:
    """The log ratio of each bucket, counted over every document; `buckets` numbers, whatever the corpus.

    trusted_ids has the doc_id of trusted documents. Without trusted
    documents, or without any words, all ratios are 0.
    """
    marked = _with_trust(docs.select("doc_id", F.lower("text").alias("low")), trusted_ids)
    grams = (
        marked.select("_trusted", words_of(F.col("low")).alias("words"))
        .select("_trusted", F.explode(ngram_buckets("words", buckets)).alias("bucket"))
    )
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_trusted").alias("target")).collect()
    raw, target = [0] * buckets, [0] * buckets
    for r in counted:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * buckets
    log = lambda counts: [math.log((c + smooth) / (sum_ + smooth * buckets)) for sum_ in [sum(counts)] for c in counts]
    return [a - b for a, b in zip(log(target), log(raw), strict=True)]


def base_counts(docs: DataFrame) -> DataFrame:
    """Documents with words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words added (replaced if present)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.drop("words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_windows", "_lines", "_again")
    out = out.withColumn("words", words_of(F.col("text"))).withColumn("_lines", lines)
    out = (
        out.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )
    window = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("i")),
    )
    out = out.withColumn("_windows", F.when(F.size("words") >= 3, F.sort_array(window)))
    same = lambda x, i: F.coalesce(x["h"] == F.get("_windows", i)["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("_windows", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    out = out.withColumn("_again", again)

    def step(acc, i):
        return F.struct((acc["n"] + i + 3 - F.greatest(acc["end"], i)).alias("n"), (i + 3).alias("end"))

    covered = F.aggregate("_again", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_lines", "_again")


def quality_scores(docs: DataFrame, weights: list[float]) -> DataFrame:
    """Documents with the base counts, base_failed and score (the mean log ratio of a text's n-grams) added (replaced if present).

    Null and empty texts have no words, score 0 and fail the base rules. Whole
    texts count, however long. Repeated rows are judged alike; other columns
    pass through. An empty table gives an empty table.
    """
    own = {"words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed"}
    columns = [c for c in docs.columns if c.lower() not in own]
    inner, other = shielded(docs.select(*[F.col(f"`{c}`") for c in columns]), {"_windows", "_lines", "_again", "_low"})
    scored = base_counts(inner).withColumn("_low", F.transform("words", lambda w: F.lower(w)))
    table_ = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    grams = ngram_buckets("_low", len(weights))
    total = F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.get(table_, b))
    size = F.when(F.col("n_words") > 1, 2 * F.col("n_words") - 1).otherwise(F.col("n_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("score", F.when(F.col("n_words") > 0, total / size).otherwise(F.lit(0.0))).withColumn("base_failed", failed)
    return unshielded(scored, [*columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed"], other)


def trusted_fence(scored: DataFrame, trusted_ids: DataFrame, fence: float = FENCE) -> float:
    """The lower quartile of the trusted documents' scores, less `fence` times the distance of their quartiles.

    Scored documents need doc_id, score and n_words; those without words do not
    count. Scores are rounded to four places, so the exact quartiles need a
    table of bounded size. Without trusted documents the fence is minus infinity.
    """
    rows = _with_trust(scored.filter("n_words > 0").select("doc_id", "score"), trusted_ids).filter("_trusted = 1")
    low, high = rows.agg(F.percentile(F.round("score", 4), F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()["q"] or (float("-inf"), float("-inf"))
    return low - fence * (high - low) if high > float("-inf") else low


def quality_verdicts(scored: DataFrame, least: float) -> DataFrame:
    """Scored documents with `kept`: not failed by the base rules, and a score of `least` or more."""
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Texts are read once to count and once to score; the verdicts come from the scores alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    scored = materialize(quality_scores(docs, ngram_weights(docs, trusted)).drop("text"))
    return quality_verdicts(scored, trusted_fence(scored, trusted))
