"""Writers: JSON lines, node and edge tables, reports, digests, retention, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, kind: str = "csv") -> None:
    """Nodes and edges in two folders; arrays and structs as JSON text in CSV."""
    for name, rows in (("nodes", nodes), ("edges", edges)):
        flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]) if kind == "csv" else rows
        writer = flat.write.mode("overwrite")
        writer.csv(f"{path}/{name}", header=True) if kind == "csv" else writer.json(f"{path}/{name}")


def markdown_lines(nodes: DataFrame) -> DataFrame:
    """A line of a report for each node, in order of type and label."""
    line = F.format_string("- **%s** %s (%.2f)", F.col("type"), F.col("label"), F.coalesce("confidence", F.lit(0.0)))
    return nodes.orderBy("type", "label").select(line.alias("value"))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    safe = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\W", "_")
    return edges.orderBy("source", "target").select(F.concat(safe("source"), F.lit(" -->|"), F.col("type"), F.lit("| "), safe("target")).alias("value"))


def with_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("digest", F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def broken(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose digest is not that of their columns."""
    return rows.filter(~F.col("digest").eqNullSafe(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)))


def keep_newest(rows: DataFrame, by: list[str], order: Column, n: int) -> DataFrame:
    """The newest n of each group."""
    w = Window.partitionBy(*by).orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A stream to Parquet, everything available now; the checkpoint makes each record arrive once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)


def for_each_batch(stream: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """A stream in batches, each given to `apply(rows, batch_id)`; a batch that is repeated after a failure has the same id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
