"""Helpers shared by the operators: tables, durable intermediate results, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are neither a space nor one of the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)
BASE = 0x100000001B3


#: Rows of whole texts in an Arrow batch; it bounds what a worker and its task hold at once.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, which are tens of megabytes of text. A value of the user's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def release_memory() -> None:
    """At the end of a task: freed memory goes back to the system, as Spark keeps the worker for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one under the warehouse of a local session. A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"


#: Spark's setting for removing the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    The plan that follows starts from files which any executor can read, so a
    lost executor costs a few re-run tasks only. The files go when the driver's
    JVM ends. With `sweep` Spark removes the shuffle files of the job when it is
    over, instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if sweep:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if sweep:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def with_broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a materialized table for broadcast only after its row count was checked against a bound."""
    return F.broadcast(df) if df.count() <= max_rows else df


def shielded(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns of these names (in either case) under other names, and the other names by the old ones."""
    clash = {n.lower() for n in names}
    other = {c: f"_input_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in clash}
    return df.withColumnsRenamed(other), other


def unshielded(df: DataFrame, columns, other: dict[str, str]) -> DataFrame:
    """Those columns, each with the values that it had in the shielded table."""
    return df.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in columns])


def salted_left_join(left: DataFrame, right: DataFrame, key: str, max_rows: int, salts: int) -> DataFrame:
    """A left join to a materialized side with one row a key: by broadcast up to max_rows, beyond with every key dealt over `salts` keys.

    So a key with a third of the left rows goes to many tasks. Null keys find
    nothing and are dealt like any other.
    """
    if right.count() <= max_rows:
        return left.join(F.broadcast(right), key, "left")
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return dealt.join(many, [key, "_salt"], "left").drop("_salt")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the first word's index of each text (one more at the end).

    One pass of array operations over the joined bytes: word bounds from a
    space table, and polynomial hashes from prefix sums, finished by a mixer.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate((np.zeros(1, np.int64), edge))
    start, end = edge[0::2], edge[1::2]
    first = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes + 1)))
    offsets = np.searchsorted(start, first)
    up, down = _powers_upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    raw = (total[end] - total[start]) * down[start]
    return mix(raw + (end - start).astype(np.uint64) * MIX_A), offsets


def text_bytes(column) -> list[bytes]:
    """The texts of an Arrow string column as UTF-8; null counts as empty."""
    return [b"" if t is None else t.encode() for t in column.to_pylist()]


def slices(sizes, most: int):
    """Ranges of rows whose sizes add up to about `most` at the most; a single row may be larger."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def sliced_batches(batches, column: str, most: int):
    """Arrow batches cut so that the text of each is about `most` bytes at the most."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for a, b in slices(sizes, most):
            yield batch.slice(a, b - a)
