"""Repair of the structure of conversations by the cheapest edits.

The initials of a repaired conversation's roles read `(s?(ua)+)?`. Four states
follow that grammar: nothing yet, after the system row, after a user row, after
an assistant row. A forward Viterbi pass carries for each state the least (cost,
audit string), takes every row by keep, rerole or delete, and closes each row's
layer with inserts; two inserts lead from any state to any that inserts can reach.

Rows stream through the tasks in order, conversation by conversation. A long
conversation is cut into chunks: passes from each of the four states over each
chunk run in parallel, and one row of 16 results a chunk is folded in order. Only
the digest of a long conversation reads its rows in one stream, as SHA-256 does.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, release_memory, salted_left_join, with_broadcast_if_small

BLANKS = " \t\n\x0b\x0c\r"
#: State after a role's initial, by state: 0 nothing yet, 1 system, 2 user, 3 assistant.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
REROLE, DELETE, INSERT = 2, 3, 2
LEGAL = {"su", "ua", "au"}
#: Conversations of more rows or bytes of text than this are cut into chunks; a short one is held whole in a task.
LONG_ROWS, LONG_BYTES = 4096, 32_000_000
#: Bits of a row's number inside a chunk of a long conversation.
CHUNK_BITS = 12
#: Up to so many long conversations, or repeated rows of them, are broadcast.
BROADCAST_ROWS = 200_000
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

Cells = dict[int, tuple[int, str]]


def close(cells: Cells) -> Cells:
    """The layer closed under inserts: a user row from any other state, then an assistant row after a user row."""
    for source, target in ((0, 2), (1, 2), (3, 2), (2, 3)):
        if source in cells:
            cost, audit = cells[source]
            _least(cells, target, cost + INSERT, audit + "I")
    return cells


def _least(cells: Cells, state: int, cost: int, audit: str) -> None:
    if state not in cells or (cost, audit) < cells[state]:
        cells[state] = (cost, audit)


def advance(cells: Cells, initial: str, must_go: bool, truncated: bool) -> Cells:
    """One row: kept, given the role that the state asks for, or deleted; then inserts."""
    out: Cells = {}
    for state, (cost, audit) in cells.items():
        _least(out, state, cost + DELETE, audit + "D")
        if not must_go:
            if initial in STEP[state]:
                _least(out, STEP[state][initial], cost + truncated, audit + "K")
            _least(out, 3 if state == 2 else 2, cost + REROLE + truncated, audit + "R")
    return close(out)


def cheapest(cells: Cells) -> tuple[int, str]:
    return min(cells[s] for s in ACCEPTED if s in cells)


def repaired(audit: str, rows):
    """(edit, role, text) of the repaired conversation; rows yields (role, text) and is read as far as the audit goes."""
    state, rows = 0, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == 2 else "user"
        state = STEP[state][role[:1]]
        yield edit, role, text


class Tally:
    """Counts over rows in order: turns, faults and illegal neighbours."""

    def __init__(self):
        self.low = self.high = self.last = self.first = self.end = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        if self.end is None:
            self.first = initial
        else:
            self.illegal += self.end + initial not in LEGAL
        self.end = initial
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated

    def join(self, later: dict) -> None:
        """Takes over the counts of the chunk that follows."""
        if later["low"] is not None:
            self.distinct += later["distinct"] - (later["low"] == self.high)
            self.low = later["low"] if self.low is None else self.low
            self.high = later["high"]
        if self.end is not None:
            self.illegal += self.end + later["first"] not in LEGAL
        self.end = later["last"]
        for k in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, k, getattr(self, k) + later[k])

    def counts(self, cost: int) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost]


def _batches(schema: T.StructType, rows, size: int = 1000):
    """Arrow batches of rows in the schema."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []

    def packed():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(arrow)], schema=arrow)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield packed()
            held = []
    if held:
        yield packed()
    release_memory()


def _rows(batches):
    """Rows of Arrow batches as tuples, read a few hundred at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, 256).columns), strict=True)


def _conversations(rows):
    """Rows grouped by their first value, which comes in order; each group is an iterator."""
    from itertools import groupby

    return groupby(rows, lambda r: r[0])


def _report_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def _row_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _results(conv, counts: list[int], audit: str, rows, as_rows: bool):
    """What a conversation returns: its repaired rows, or its counts and digest."""
    if as_rows:
        for place, (edit, role, text) in enumerate(repaired(audit, rows)):
            yield conv, place, edit, role, text
        return
    digest = hashlib.sha256()
    for place, (_, role, text) in enumerate(repaired(audit, rows)):
        digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
    yield (conv, *counts, audit, digest.hexdigest())


def prepared(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, blank, cut, gone): null roles and texts as one space, and the faults that a row shows alone."""
    text = F.coalesce("text", F.lit(" "))
    bare = F.btrim(text, F.lit(BLANKS))
    gone = F.coalesce("gone", F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), gone.alias("gone")
    )


def _short(rows: DataFrame, as_rows: bool) -> DataFrame:
    schema = _row_schema(rows) if as_rows else _report_schema(rows)

    def run(batches):
        def results():
            for conv, group in _conversations(_rows(batches)):
                tally, cells, seen, held = Tally(), close({0: (0, "")}), set(), []
                for _, turn, role, text, blank, cut, gone in group:
                    if gone:
                        continue
                    name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                    duplicate = not blank and name in seen
                    seen.add(name)
                    truncated = cut and not blank and not duplicate
                    tally.add(turn, role[:1], blank, duplicate, truncated)
                    cells = advance(cells, role[:1], blank or duplicate, truncated)
                    held.append((role, text))
                cost, audit = cheapest(cells)
                yield from _results(conv, tally.counts(cost), audit, held, as_rows)

        yield from _batches(schema, results())

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


CHUNK = T.StructType(
    [
        *[T.StructField(c, T.LongType()) for c in ("chunk", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")],
        T.StructField("first", T.StringType()),
        T.StructField("last", T.StringType()),
        T.StructField("cells", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("state", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]))),
    ]
)


def _chunks(marked: DataFrame) -> DataFrame:
    """One row a chunk: its counts, and the least (cost, audit) from each state to each."""
    schema = T.StructType([marked.schema["conv_id"], *CHUNK.fields])

    def run(batches):
        def results():
            from itertools import groupby

            for (conv, chunk), group in groupby(_rows(batches), lambda r: (r[0], r[1])):
                tally, passes = Tally(), [close({s: (0, "")}) for s in range(4)]
                for _, _, _, turn, initial, blank, duplicate, truncated in group:
                    tally.add(turn, initial, blank, duplicate, truncated)
                    passes = [advance(cells, initial, blank or duplicate, truncated) for cells in passes]
                cells = [{"start": s, "state": e, "cost": c, "audit": a} for s, p in enumerate(passes) for e, (c, a) in p.items()]
                yield conv, chunk, tally.low, tally.high, tally.distinct, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.first, tally.end, cells

        yield from _batches(schema, results(), 50)

    narrow = marked.select("conv_id", F.shiftright("pos", CHUNK_BITS).alias("chunk"), "pos", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "duplicate", "truncated")
    return narrow.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(run, schema)


def _folded(chunks: DataFrame) -> DataFrame:
    """Counts, cost and audit of each long conversation, from its chunks in order.

    What all surviving audits begin with is settled and set aside, so a chunk
    costs its own length; states that can no longer win are dropped for that.
    """
    fields = [chunks.schema["conv_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType())]
    schema, names = T.StructType(fields), chunks.columns

    def run(batches):
        def results():
            for conv, group in _conversations(_rows(batches)):
                tally, cells, settled = Tally(), close({0: (0, "")}), []
                for row in group:
                    chunk = dict(zip(names, row, strict=True))
                    tally.join(chunk)
                    out: Cells = {}
                    for c in chunk["cells"]:
                        if c["start"] in cells:
                            cost, audit = cells[c["start"]]
                            _least(out, c["state"], cost + c["cost"], audit + c["audit"])
                    for state, more in ((0, DELETE), (1, 0)):
                        if state in out and 3 in out and out[state][0] > out[3][0] + more:
                            del out[state]
                    shared = len(os.path.commonprefix([a for _, a in out.values()]))
                    settled.append(next(iter(out.values()))[1][:shared])
                    cells = {s: (c, a[shared:]) for s, (c, a) in out.items()}
                cost, audit = cheapest(cells)
                yield (conv, *tally.counts(cost), "".join(settled) + audit)

        yield from _batches(schema, results(), 50)

    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, schema)


def _long(rows: DataFrame, as_rows: bool) -> DataFrame:
    order = ["conv_id", "turn", "role", "text"]
    placed = materialize(rows.filter("NOT gone").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    name = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role"), "role", "text"))
    named = placed.withColumn("name", F.when(~F.col("blank"), name))
    groups = named.filter("name IS NOT NULL").groupBy("name").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    repeats = materialize(groups.filter("n > 1").select("name", "first"))
    duplicate = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    flagged = salted_left_join(named.drop("text"), repeats, "name", BROADCAST_ROWS, 64).withColumn("duplicate", duplicate)
    marked = flagged.withColumn("truncated", F.col("cut") & ~F.col("blank") & ~F.col("duplicate"))
    folded = materialize(_folded(materialize(_chunks(marked))))
    first = folded.withColumns({"pos": F.lit(-1).cast("long"), "role": F.lit(""), "text": F.lit("")})
    columns = ["conv_id", "pos", "role", "text", *COUNTS, "audit"]
    others = placed.withColumns({c: F.lit(None).cast(folded.schema[c].dataType) for c in [*COUNTS, "audit"]})
    schema = _row_schema(rows) if as_rows else _report_schema(rows)

    def run(batches):
        def results():
            for conv, group in _conversations(_rows(batches)):
                head = next(group)
                yield from _results(conv, list(head[4:-1]), head[-1], (r[2:4] for r in group), as_rows)

        yield from _batches(schema, results())

    stream = first.select(*columns).unionByName(others.select(*columns))
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, schema)


def _repaired(conversations: DataFrame, as_rows: bool, long_rows: int, long_bytes: int) -> DataFrame:
    rows = prepared(conversations)
    sizes = rows.filter("NOT gone").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("b"))
    found = materialize(sizes.filter((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select(F.col("conv_id").alias("_long")))
    if found.isEmpty():
        return _short(rows, as_rows)
    found, same = with_broadcast_if_small(found, BROADCAST_ROWS), F.col("conv_id").eqNullSafe(F.col("_long"))
    return _short(rows.join(found, same, "left_anti"), as_rows).unionByName(_long(rows.join(found, same, "left_semi"), as_rows))


def repair_reports(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    Rows (conv_id, turn, role, text) count in the order of turn (nulls first),
    role and text. A null role or text counts as one space; a null conv_id is a
    conversation of its own. Rows that repeat another's role and text are
    duplicates. Where a column `gone` is true, a row says only that its
    conversation exists; one without other rows has zeros, an empty audit and
    the digest of the empty text. Texts and conversations may be of any
    length: those over long_rows or long_bytes are cut into chunks, with equal
    results. An empty table gives an empty table; other columns are not read.
    """
    return _repaired(conversations, False, long_rows, long_bytes)


def repaired_rows(conversations: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text; rows, nulls and sizes as in repair_reports."""
    return _repaired(conversations, True, long_rows, long_bytes)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of `conv_id:turn` (nulls as one space) modulo 20, with a column `gone` for dropped ones.

    0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it in
    its place, 4 sets its role to user; others stay.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    role, text = part("role"), part("text")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id",
        "turn",
        _by(F.col("kind"), {4: F.lit("user")}, F.col("role")).alias("role"),
        _by(F.col("kind"), {1: F.lit(""), 2: F.translate("text", ".!?", "")}, F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
    )


def _by(kind: Column, values: dict[int, Column], other: Column) -> Column:
    for k, v in values.items():
        other = F.when(kind == k, v).otherwise(other)
    return other


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repair_reports(damaged(table(spark, sf_dir, "conversations")))
