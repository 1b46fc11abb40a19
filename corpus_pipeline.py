"""From raw documents to token ids: classify, drop near-duplicates, redact secrets, mix, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next stage
reads what was written of it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperweave.llm import bpe, mixing, neardup, quality_model, secrets
from paperweave.llm.common import discard, materialize, shielded, table, unshielded


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality_model.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    inner, other = shielded(docs, {"score", "predicted"})
    return unshielded(quality_model.score_quality(inner, model).filter("predicted = 1"), docs.columns, other)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays; rows that repeat its id and text become one.

    The verdict is of each id and text. Rows without an id all stay.
    """
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("")))
    columns = docs.columns
    docs, other = shielded(docs, {"_key", "_place"})
    keyed = docs.withColumn("_key", F.unhex(F.sha2(name, 256)))
    kept = neardup.near_duplicates(keyed, "_key").filter("kept").select("_key").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*others))
    mine = keyed.join(kept, "_key", "left_semi")
    once = mine.filter("doc_id IS NOT NULL").withColumn("_place", place).filter("_place = 1").select(*docs.columns)
    out = once.unionByName(mine.filter("doc_id IS NULL").select(*docs.columns))
    return unshielded(out, columns, other)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of their decoded text."""
    return bpe.token_digests(bpe.bpe_encode(docs.select("doc_id", "text", "source"), decode=True))


STAGES = [
    ("quality classifier", classify),
    ("near-duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: SQL cannot express the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and reread by the next; what no later stage reads goes at once, the last table when the driver ends."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
