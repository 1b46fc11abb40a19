"""Repeated lines: which lines of each document stay, as compressed bitmaps.

Hashes of all lines are dealt by range, sorted by document and position, and
read in that order: the first occurrence of a line and the first line of each
document stand out by comparison with the row before. What comes back for a
document is a bitmap of its lines, never text; the texts stay where they are.

A line that a third of all documents hold is dealt over BLOCKS ranges, as the
hash of the document is part of the sort key; the blocks of a line meet again
as one partial count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Characters stripped from both ends of a line: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents are dealt over so many blocks by hash; a line's occurrences in one block are one group.
BLOCKS = 65_536
#: Lines in a word of a bitmap.
BITS = 64


def lines_of(text: Column) -> Column:
    """Lines of a text, split at \\n; null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped at both ends with A-Z in lower case; no other letter changes."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t, pos, h1, h2): a row for each line of at least min_chars, named by 128 bits of its key; t is a hash of the document's text."""
    whole = docs.select("doc_id", F.xxhash64("text").alias("t"), F.transform(lines_of(F.col("text")), line_key).alias("keys"))
    pieces = whole.select("doc_id", "t", F.posexplode("keys").alias("pos", "key"))
    return pieces.filter(F.char_length("key") >= min_chars).select("doc_id", "t", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def first_lines(found: DataFrame) -> DataFrame:
    """The first row of each document for every key and block, and whether it is the first of all in its block (nth = 1).

    Ranges of (h1, h2, block) sorted by document and position; the windows read them as they lie.
    """
    dealt = found.repartitionByRange("h1", "h2", "block").sortWithinPartitions("h1", "h2", "block", "doc_id", "t", "pos")
    order = Window.partitionBy("h1", "h2", "block").orderBy("doc_id", "t", "pos")
    before = F.lag(F.struct("doc_id", "t")).over(order)
    same = before.isNotNull() & before["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("doc_id").isNotNull() | (before["t"] == F.col("t")))
    return dealt.select("*", (~same).alias("opens"), F.row_number().over(order).alias("nth")).filter("opens")


def dropped_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, t, pos) of the lines to drop: those whose key at least min_docs documents hold, all or all but the first.

    Rows of one id are one document; rows without an id are one document for
    each different text. The first occurrence is that of the least id (none
    before all), then of the least hash of the text, then of the least position.
    """
    block = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("t"))), F.lit(BLOCKS)).cast("int")
    found = materialize(occurrences(docs, min_chars).withColumn("block", block))
    per_block = first_lines(found).groupBy("h1", "h2", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("nth") == 1, F.struct("doc_id", "t", "pos"))).alias("first"))
    per_key = per_block.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_list("block").alias("blocks"))
    frequent = materialize(per_key.filter(F.col("n") >= min_docs).select("h1", "h2", "first", F.explode("blocks").alias("block")))
    hits = found.join(frequent, ["h1", "h2", "block"])
    if keep_first:
        is_first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.t") == F.col("t")) & (F.col("first.pos") == F.col("pos"))
        hits = hits.filter(~is_first)
    return hits.select("doc_id", "t", "pos")


def bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, t, n_dropped, bitmap): the words of 64 lines that have dropped ones, by number; words that are absent are kept whole."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % BITS)
    words = dropped.groupBy("doc_id", "t", F.floor(F.col("pos") / BITS).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "t").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("bitmap")
    )


def kept_text(text: Column, bitmap: Column) -> Column:
    """The text without the lines that its bitmap drops; a null bitmap drops none. The words are laid out once for each text."""
    dense = F.flatten(
        F.transform(
            bitmap,
            lambda w, i: F.concat(F.array_repeat(F.lit(0).cast("long"), w["word"] - F.when(i > 0, F.get(bitmap, i - 1)["word"]).otherwise(F.lit(-1)) - 1), F.array(w["bits"])),
        )
    )
    stays = lambda d: lambda line, i: F.coalesce(F.getbit(F.get(d, F.floor(i / BITS).cast("int")), i % BITS), F.lit(0)) == 0
    held = F.transform(F.array(dense), lambda d: F.array_join(F.filter(lines_of(text), stays(d)), "\n"))
    return F.when(bitmap.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.get(held, F.lit(0)))


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Every row of documents with n_lines, n_dropped and bitmap (null where all lines stay) added; `kept_text` applies it.

    Lines are told apart by their stripped, lower-cased keys. Null and empty
    texts are one empty line, whose key is too short to be dropped; rows that
    repeat an id and text share a bitmap; rows of one id with other texts have
    bitmaps of their own but count as one document. A text of any length is
    one row of lines. An empty table gives an empty table. Columns of the
    added names in the input are replaced.
    """
    own = {"n_lines", "n_dropped", "bitmap", "_doc", "_t"}
    base = docs.drop(*own)
    maps = materialize(bitmaps(dropped_lines(base.select("doc_id", "text"), min_docs, min_chars, keep_first)).withColumnsRenamed({"doc_id": "_doc", "t": "_t"}))
    joined = base.join(maps, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_t")), "left")
    return joined.select(*base.columns, F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "bitmap")


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    marked = line_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("bitmap")), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM d
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s
), k AS (
  SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, f.key IS NOT NULL AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r
"""
