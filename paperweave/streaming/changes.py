"""Change data: pushes with revisions, pulls by cursor, snapshots, journals with conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once_per_mutation(changes: DataFrame, mutation: str, cursor: str) -> DataFrame:
    """Changes without repeats: the first of each mutation id by the cursor."""
    best = F.min_by(F.struct(*changes.columns), F.col(cursor)).alias("_b")
    return changes.groupBy(mutation).agg(best.alias("_b")).select("_b.*")


def apply_changes(changes: DataFrame, resource: str, cursor: str, base: str) -> DataFrame:
    """Changes with `revision` and `state`: applied if their base is the resource's revision at that time, else conflict.

    Every applied change raises the revision by one; a conflict leaves it. So the
    revision is the length of the longest chain of bases 0, 1, 2 ... in cursor
    order, which needs each resource's changes in order: they stream through one
    task in sorted batches with one number of state.
    """
    import pandas as pd

    schema = T.StructType([*changes.schema.fields, T.StructField("revision", T.LongType()), T.StructField("state", T.StringType())])

    def run(frames):
        at, revision = None, 0
        for f in frames:
            revisions, states = [], []
            for r, b in zip(f[resource], f[base], strict=True):
                if r != at:
                    at, revision = r, 0
                good = not pd.isna(b) and int(b) == revision
                revision += good
                revisions.append(revision)
                states.append("applied" if good else "conflict")
            yield f.assign(revision=pd.Series(revisions, index=f.index, dtype="int64"), state=states)

    return changes.repartition(resource).sortWithinPartitions(resource, cursor).mapInPandas(run, schema)


def pull(changes: DataFrame, cursor: str, after: int, limit: int = 500) -> DataFrame:
    """The next changes after a cursor, with `has_more`."""
    most = min(max(1, limit), 500)
    part = changes.filter(F.col(cursor) > after).orderBy(cursor).limit(most + 1)
    ranked = part.withColumn("_n", F.row_number().over(Window.orderBy(cursor)))  # most + 1 rows
    return ranked.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > most).filter(F.col("_n") <= most).drop("_n")


def snapshot(changes: DataFrame, resource: str, revision: str, operation: str, deleted: str = "delete") -> DataFrame:
    """The latest state of each resource; deleted ones are left out. Of equal revisions the row with the greatest other columns counts."""
    own = F.struct(*[c for c in changes.columns if c != resource])
    last = changes.groupBy(resource).agg(F.max_by(own, F.struct(F.col(revision), own)).alias("_b"))
    return last.select(resource, "_b.*").filter(F.col(operation) != deleted)


def compare_and_set(state: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """requests (key, expected, value) against state (key, revision, value): what is accepted, with the revision after it."""
    x = requests.join(state.select(key, "revision"), key, "left").withColumn("revision", F.coalesce("revision", F.lit(0).cast("long")))
    ok = F.col("expected") == F.col("revision")
    return x.withColumn("accepted", ok).withColumn("revision", F.col("revision") + ok.cast("long"))


def resolve_conflicts(conflicts: DataFrame, resolution: str) -> DataFrame:
    """conflicts (id, local, remote): keep_local, keep_cloud, or copy_local (the remote stays, the local gets an id of its own)."""
    if resolution == "keep_local":
        return conflicts.select("id", F.col("local").alias("value"))
    if resolution == "keep_cloud":
        return conflicts.select("id", F.col("remote").alias("value"))
    both = F.array(F.struct(F.col("id").cast("string").alias("id"), F.col("remote").alias("value")), F.struct(F.concat(F.col("id").cast("string"), F.lit("-copy")).alias("id"), F.col("local").alias("value")))
    return conflicts.select(F.explode(both).alias("r")).select("r.*")


def fold_annotations(events: DataFrame, key: str, revision: str, action: str, keep: int) -> DataFrame:
    """Live annotations: the latest event of each that is no delete, and of these the newest `keep`; of equal revisions the greater key first.

    `keep` is the length of an annotation list, a part of its definition.
    """
    return snapshot(events, key, revision, action).orderBy(F.col(revision).desc(), F.col(key).desc()).limit(keep)


def transitions(events: DataFrame, key: str, order: str, status: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Events with `legal`: whether the status before allows this one; the first may be anything that follows the empty status."""
    before = F.coalesce(F.lag(status).over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    pairs = [F.lit(f"{a}>{b}") for a, to in allowed.items() for b in to]
    return events.withColumn("before", before).withColumn("legal", F.array_contains(F.array(*pairs), F.concat_ws(">", "before", status)))


def needs_rebuild(sources: DataFrame, built: DataFrame, key: str, digest: str) -> DataFrame:
    """Sources whose digest is not the one they were built from."""
    return sources.join(built.select(key, digest), [key, digest], "left_anti")
