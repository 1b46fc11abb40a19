"""Lookups: two-tier dimension joins, graded matches, unique containment, nearest and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import durable

#: Titles from this length on are looked for inside others (a fixed value).
LEAST_TITLE = 16


def two_tier(records: DataFrame, metrics: DataFrame, id_: str, codes: str, name: str, order: str, value: str) -> DataFrame:
    """Each record's metric: the first row by `order` that shares a code, else the first of equal name; else null.

    records have `codes` (array) and `name`; metrics `codes`, `name`, `order` and `value`.
    """
    least = F.min_by(F.col(value), F.col(order))
    # each code's first row before records meet it: a code that many share makes no pairs
    first = metrics.select(F.explode(codes).alias("_c"), order, value).filter("_c != ''").groupBy("_c").agg(least.alias("_v"), F.min(order).alias("_o"))
    by_code = records.select(id_, F.explode(codes).alias("_c")).join(first, "_c").groupBy(id_).agg(F.min_by("_v", "_o").alias("_by_code"))
    by_name = metrics.filter(F.col(name) != "").groupBy(name).agg(least.alias("_by_name"))
    joined = records.join(by_code, id_, "left").join(by_name, name, "left")
    return joined.withColumn(value, F.coalesce("_by_code", "_by_name")).withColumn("match", F.when(F.col("_by_code").isNotNull(), "code").when(F.col("_by_name").isNotNull(), "name").otherwise("none")).drop("_by_code", "_by_name")


def graded_match(records: DataFrame, pack: DataFrame, name: str, code: str) -> DataFrame:
    """records with `match_score`: 3 for an equal code, 2 for an equal name, 1 for a name that contains the other, else 0.

    The pack is a bounded parameter table; only the third grade is a loop over it.
    """
    p = pack.select(F.col(name).alias("_name"), F.col(code).alias("_code"))
    codes = p.filter("_code != ''").select(F.col("_code").alias(code)).distinct().withColumn("_c", F.lit(3))
    names = p.filter("_name != ''").select(F.col("_name").alias(name)).distinct().withColumn("_n", F.lit(2))
    parts = p.filter("_name != ''").agg(F.collect_set("_name").alias("_parts"))
    graded = records.join(F.broadcast(codes), code, "left").join(F.broadcast(names), name, "left").join(F.broadcast(parts))
    partial = F.exists("_parts", lambda x: (F.col(name) != "") & (F.contains(F.col(name), x) | F.contains(x, F.col(name))))
    return graded.withColumn("match_score", F.coalesce("_c", "_n", F.when(partial, 1), F.lit(0))).drop("_c", "_n", "_parts")


#: Characters of a passage that are looked for first, and passages that are searched for at once (about 150 bytes each on the driver).
HEAD, BLOCK_PASSAGES = 32, 200_000


def _hits(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage_id: str, passage: str, block: int = BLOCK_PASSAGES) -> DataFrame:
    """(passage_id, text_id) for every text that contains a passage, wherever it begins, once for each row of texts and passage.

    The passages are the query set: in blocks of a stated size their first
    characters, lengths and digests are broadcast as one search automaton, and
    the texts stream past it; a place where the first characters stand is decided
    by the digest of the passage's length from there. Null and empty passages
    are in no text.
    """
    import hashlib

    import pyarrow as pa

    wanted = passages.filter(F.length(passage) > 0).select(F.col(passage_id).alias("id"), F.substring(passage, 1, HEAD).alias("head"), F.length(passage).alias("n"), F.md5(passage).alias("digest")).distinct()
    blocks = max(1, -(-wanted.count() // block))
    fields = [passages.schema[passage_id], texts.schema[text_id]]
    schema = T.StructType([T.StructField(passage_id, fields[0].dataType), T.StructField(text_id, fields[1].dataType)])
    out = None
    for k in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == k).toArrow()
        kind = rows.schema.field("id").type
        shared = texts.sparkSession.sparkContext.broadcast([rows.column(c).to_pylist() for c in ("head", "n", "digest", "id")])

        def run(batches, shared=shared, kind=kind):
            import ahocorasick

            search, of = ahocorasick.Automaton(), {}
            for head, n, digest, i in zip(*shared.value, strict=True):
                of.setdefault(head, {}).setdefault(n, {}).setdefault(digest, []).append(i)
            for head, sizes in of.items():
                search.add_word(head, (len(head), sizes))
            if of:
                search.make_automaton()
            for batch in batches if of else ():
                left, right = [], []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = set()
                    for end, (m, sizes) in search.iter(t or ""):
                        start = end - m + 1
                        for n, digests in sizes.items():
                            if start + n <= len(t) and (d := hashlib.md5(t[start : start + n].encode()).hexdigest()) in digests:
                                found.update(digests[d])
                    left += found
                    right += [i] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, batch.schema.field(0).type)], [passage_id, text_id])

        part = texts.select(text_id, text).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def containments(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage_id: str, passage: str, block: int = BLOCK_PASSAGES) -> DataFrame:
    """(passage_id, text_id), once each, for every text that contains a passage; the passages are a query set, as in `_hits`."""
    return _hits(texts, passages, text_id, text, passage_id, passage, block).distinct()


def unique_containment(texts: DataFrame, passages: DataFrame, text_id: str, text: str, passage_id: str, passage: str) -> DataFrame:
    """(passage_id, text_id) for passages that exactly one text contains; a passage may begin and end inside words."""
    found = containments(texts, passages, text_id, text, passage_id, passage)
    return found.groupBy(passage_id).agg(F.count("*").alias("_n"), F.min(text_id).alias(text_id)).filter("_n = 1").drop("_n")


def _within(passages: DataFrame, texts: DataFrame, column: str) -> DataFrame:
    """Passages with `_text`, each text of the other table that contains theirs.

    Both meet on a passage's beginning, whose length is the greatest power of
    two that fits, and all pieces of the texts of that length; so passages of
    any number are one join, and a text gives its length times its logarithm.
    """
    digits = lambda c: F.length(F.bin(F.length(c)))
    power = lambda i: F.pow(F.lit(2), i - 1).cast("int")
    pieces = texts.filter(F.length(column) > 0).select(F.col(column).alias("_text"), F.explode(F.transform(F.sequence(F.lit(1), digits(column)), power)).alias("_n"))
    pieces = pieces.select("_text", "_n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_text") - F.col("_n") + 1), lambda i: F.xxhash64(F.substr("_text", i, F.col("_n")))))).alias("_head"))
    begun = passages.filter(F.length(column) > 0).withColumn("_n", power(digits(column))).withColumn("_head", F.xxhash64(F.substr(column, F.lit(1), F.col("_n"))))
    return begun.join(pieces, ["_n", "_head"]).filter(F.contains(F.col("_text"), F.col(column))).drop("_n", "_head")


def resolve_references(references: DataFrame, papers: DataFrame, id_: str = "source", least_chars: int = LEAST_TITLE) -> DataFrame:
    """References with `target` and `tier`: by alias, else by equal title, else by the one title that contains theirs or lies in it.

    references (id_, identifier, title), papers (id, aliases, title), titles and
    aliases normalized alike. References' titles under `least_chars` characters
    are not looked for. Papers' texts are passed twice and shuffled as digests. Several papers of one alias or title: the least id;
    their title counts once.
    """
    aliases = papers.select(F.explode("aliases").alias("identifier"), "id").filter("identifier != ''").groupBy("identifier").agg(F.min("id").alias("_alias"))
    refs = references.select(id_, "identifier", "title", F.sha2("title", 256).alias("_digest"))
    longest = F.broadcast(refs.agg(F.max(F.length("title")).alias("_longest")))
    # papers go by the digests of their titles; a title itself is kept where it can lie in a reference's
    named = papers.filter(F.col("title") != "").join(longest).select("id", F.sha2("title", 256).alias("_digest"), F.when(F.length("title") <= F.col("_longest"), F.col("title")).alias("title"))
    named = durable(named)
    titles = named.groupBy("_digest").agg(F.min("id").alias("_title"))
    tiers = durable(refs.join(aliases, "identifier", "left").join(titles, "_digest", "left"))
    open_ = tiers.filter("_alias IS NULL AND _title IS NULL").filter(F.length("title") >= least_chars).select("title").distinct()
    texts = papers.filter(F.col("title") != "").select(F.struct("id", F.sha2("title", 256).alias("_digest")).alias("of"), "title")
    inside = _hits(texts, open_.select(F.col("title").alias("said"), "title"), "of", "title", "said", "title").select("said", "of.*")
    around = _within(named.filter("title IS NOT NULL"), open_, "title").select(F.col("_text").alias("said"), "id", "_digest")
    # papers of one title are one: of a single digest the least id
    one = inside.unionByName(around).groupBy("said").agg(F.min("_digest").alias("_a"), F.max("_digest").alias("_b"), F.min("id").alias("_inside")).filter("_a = _b").select(F.col("said").alias("title"), "_inside")
    out = tiers.join(one, "title", "left")
    tier = F.when(F.col("_alias").isNotNull(), "alias").when(F.col("_title").isNotNull(), "title").when(F.col("_inside").isNotNull(), "containment").otherwise("none")
    return out.select(id_, F.coalesce("_alias", "_title", "_inside").alias("target"), tier.alias("tier"))


def nearest(points: DataFrame, targets: DataFrame, by: list[str], x: str, target_x: str, value: str) -> DataFrame:
    """Each point with the value of the nearest target of its group; the smaller target wins ties, then the smaller value.

    Points and targets are sorted together, so a group costs its size, not its
    pairs. Groups without targets, and points without x, give no row.
    """
    own = F.struct(F.col(target_x), F.col(value))
    t = targets.filter(F.col(target_x).isNotNull()).groupBy(*by, target_x).agg(F.min(value).alias(value))
    both = points.select(*by, F.col(x).cast("double").alias("_x"), F.struct(*points.columns).alias("_p"), F.lit(None).cast(t.select(own.alias("t")).schema["t"].dataType).alias("_t"))
    both = both.unionByName(t.select(*by, F.col(target_x).cast("double").alias("_x"), F.lit(None).cast(both.schema["_p"].dataType).alias("_p"), own.alias("_t")))
    w = Window.partitionBy(*by).orderBy("_x")
    before = F.last("_t", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("_t", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", before).withColumn("_a", after).filter("_p IS NOT NULL AND _x IS NOT NULL AND (_a IS NOT NULL OR _b IS NOT NULL)")
    far = F.col("_a").isNull() | (F.col("_x") - F.col(f"_b.{target_x}") <= F.col(f"_a.{target_x}") - F.col("_x"))
    return near.withColumn("_n", F.when(F.col("_b").isNotNull() & far, F.col("_b")).otherwise(F.col("_a"))).select("_p.*", f"_n.{target_x}", f"_n.{value}")


def last_before(events: DataFrame, key: str, order: list[str], wanted: Column, value: Column, name: str) -> DataFrame:
    """As-of join within one stream: each row with the value of its key's last earlier row that is wanted."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn(name, F.last(F.when(wanted, value), ignorenulls=True).over(w))


def range_join(points: DataFrame, ranges: DataFrame, x: str, lo: str, hi: str, width: float) -> DataFrame:
    """Points in [lo, hi), meeting on cells of a width so that no pair is tried twice or across the whole table."""
    cell = lambda c: F.floor(c / width).cast("long")
    spread = ranges.withColumn("_cell", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))
    return points.withColumn("_cell", cell(F.col(x))).join(spread, "_cell").filter((F.col(x) >= F.col(lo)) & (F.col(x) < F.col(hi))).drop("_cell")
