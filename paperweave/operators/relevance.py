"""Rule scores of records: topic phrases, keyword hits, thresholds that know missing values, classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_terms, search_terms

#: Points for a phrase in the title or the abstract, and for each shared term up to a limit (fixed values).
TITLE, ABSTRACT, TERM, MOST_TERMS = 6, 4, 2, 6
#: Attempts allowed by class of failure, and days to wait between them (fixed values).
ATTEMPTS = {"transient": 8, "blocked": 3, "terminal": 1}
WAIT_DAYS = 7


def topic_score(title: Column, abstract: Column, phrases: list[str]) -> Column:
    """The best phrase's points, and two for each of its terms that the record has, six at most."""
    terms = search_terms(F.concat_ws(" ", title, abstract))
    best = F.lit(0)
    for p in phrases:
        found = F.when(F.contains(F.lower(title), F.lit(p.lower())), TITLE).when(F.contains(F.lower(abstract), F.lit(p.lower())), ABSTRACT).otherwise(0)
        hits = F.size(F.array_intersect(keyword_terms(F.lit(p)), terms))
        best = F.greatest(best, found + F.least(TERM * hits, F.lit(MOST_TERMS)))
    return best


def matched_phrases(text: Column, phrases: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(p.lower())), F.lit(p)) for p in phrases]))


def at_least(value: Column, least: float, unknown_passes: bool = True) -> Column:
    """Whether a value reaches a floor; a missing value passes or not as said."""
    return F.coalesce(value >= least, F.lit(unknown_passes))


def open_access(*flags: Column) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(f, F.lit(False))
    return out


def retry_due(kind: Column, attempts: Column, last: Column, now: Column) -> Column:
    """Whether a failed record is tried again: attempts left for its class of failure, and the wait over."""
    allowed = F.lit(0)
    for k, n in ATTEMPTS.items():
        allowed = F.when(kind == k, n).otherwise(allowed)
    return (F.coalesce(attempts, F.lit(0)) < allowed) & F.coalesce(last + F.expr(f"INTERVAL {WAIT_DAYS} DAYS") <= now, F.lit(True))


def classify(value: Column, rules: list[tuple[str, str]], otherwise: str = "unknown") -> Column:
    """The name of the first rule whose pattern the text has."""
    out = F.lit(otherwise)
    for name, pattern in reversed(rules):
        out = F.when(value.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def query_relevance(query: str, importance: Column, title: Column, authors: Column, venue: Column, text: Column) -> Column:
    """A quarter of the importance, and points where the query is the title, in it, in the authors, the venue or the text."""
    q = F.lit(query.lower())
    has = lambda c, points: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), q), points).otherwise(0.0)
    whole = F.when(F.lower(title) == q, 3.0).otherwise(has(title, 2.0))
    return F.round(0.25 * F.coalesce(importance, F.lit(0.0)) + whole + has(authors, 1.25) + has(venue, 0.75) + has(text, 0.5), 4)


def weighted_sources(records: DataFrame, source: str, score: Column, where: Column, limit: int) -> DataFrame:
    """(source, count, weight): sum of 1 + score over the records that count, the heaviest first."""
    kept = records.filter(where & F.col(source).isNotNull())
    return kept.groupBy(source).agg(F.count("*").alias("count"), F.round(F.sum(1 + score), 4).alias("weight")).orderBy(F.col("weight").desc(), F.col("count").desc(), source).limit(limit)


def rank_of(level: Column, order: list[str]) -> Column:
    """A level's place in an order from 1; 0 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, order)), level), F.lit(0)).cast("int")


def allowed(grants: DataFrame, by: list[str], level: str, order: list[str], required: str) -> DataFrame:
    """Keys whose highest grant is the required one or above."""
    best = grants.groupBy(*by).agg(F.max(rank_of(F.col(level), order)).alias("rank"))
    return best.withColumn("allowed", F.col("rank") >= order.index(required) + 1)
