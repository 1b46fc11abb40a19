"""Layout elements: overlap suppression, reading order, tables of markup, charts.

Elements have doc, page, id, kind, box array<double>, and a score. Work is done
page by page; a page's elements are folded in a stated order inside one
expression, as what is kept depends on what was kept before it.
"""

from __future__ import annotations

import html
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geo import box_of, iou
from .lookup import nearest

#: The overlap from which two elements are one (a fixed value).
SAME = 0.82


def suppress_overlaps(elements: DataFrame, order: list[str], least: float = SAME) -> DataFrame:
    """Of elements of a page and kind that overlap by more than `least`, the first by the order (all ascending) stays."""
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    listed = elements.groupBy("doc", "page", "kind").agg(F.sort_array(F.collect_list(F.struct(*keys, F.col("id").alias("id"), F.col("box").alias("box")))).alias("all"))
    kind = listed.schema["all"].dataType.simpleString()

    def step(kept, x):
        clash = F.exists(kept, lambda k: iou(box_of(k["box"]), box_of(x["box"])) > least)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("all", F.array().cast(kind), step)
    ids = listed.select("doc", "page", "kind", F.explode(F.transform(kept, lambda k: k["id"])).alias("id"))
    return elements.join(ids, ["doc", "page", "kind", "id"], "left_semi")


def reading_order(elements: DataFrame, kinds: list[str]) -> DataFrame:
    """Elements with `place`: page, top, left, then kind."""
    kind = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    w = Window.partitionBy("doc").orderBy("page", F.get("box", 1), F.get("box", 0), kind, "id")
    return elements.withColumn("place", F.row_number().over(w))


def size_by_reason(candidates: DataFrame) -> DataFrame:
    """(reason, count, bytes) of files (reason, bytes); a null or empty reason is unknown, a null size 0."""
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit("unknown"))
    return candidates.groupBy(reason.alias("reason")).agg(F.count("*").alias("count"), F.sum(F.coalesce("bytes", F.lit(0))).cast("long").alias("bytes"))


def markdown_rows(text: Column) -> Column:
    """The cells of a Markdown table: array of arrays; the line of dashes is no row."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x.startswith("|") & ~x.rlike(r"^[|\s:-]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x)))


def colour_bucket(r: Column, g: Column, b: Column) -> Column:
    """gray for dull or dark colours, else the three channels in steps of 48."""
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    light = 0.299 * r + 0.587 * g + 0.114 * b
    part = lambda c: F.round(c / 48).cast("int").cast("string")
    return F.when((spread < 34) | (light < 95), F.lit("gray")).otherwise(F.concat_ws("-", part(r), part(g), part(b)))


def curve_by_column(pixels: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return pixels.groupBy(*by, x).agg(F.median(y).alias(y))


#: A fitting line of an axis: ticks that make a pair lie so far apart, in pixels and in spacings; a tick is near
#: within so much, in its unit and in steps of the slope; so many ticks, and such a share, are near (fixed values).
PAIR_PIXELS, PAIR_SPACINGS = 4.0, 0.60
NEAR_UNITS, NEAR_STEPS = 0.18, 0.18
NEAR_TICKS, NEAR_SHARE = 3, 0.45


#: Numbers of one array while lines of several axes are tried together.
AT_ONCE = 1_000_000


def _best_lines(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes, intercepts and numbers of near ticks of axes with as many ticks each, 0 ticks for none.

    Of an axis's lines with as many near ticks the one with the least mean error, then the flattest, then the first, is refitted on those.
    """
    k, n = x.shape
    spacing = np.median(np.diff(x, axis=1), axis=1)
    most, error, flat = np.full(k, max(NEAR_TICKS, math.ceil(n * NEAR_SHARE)) - 1), np.full(k, -np.inf), np.zeros(k)
    ticks = np.zeros((k, n), bool)
    rows = np.arange(k)
    for i in range(n - 1):
        dx = x[:, i + 1 :] - x[:, i : i + 1]
        slope = (y[:, i + 1 :] - y[:, i : i + 1]) / dx
        steep = np.abs(slope)
        off = np.abs(y[:, None] - (slope[:, :, None] * (x - x[:, i : i + 1])[:, None] + y[:, i : i + 1, None]))
        near = off <= np.maximum(NEAR_UNITS, steep * spacing[:, None] * NEAR_STEPS)[:, :, None]
        count = np.where((np.abs(dx) >= np.maximum(PAIR_PIXELS, spacing * PAIR_SPACINGS)[:, None]) & (steep >= 1e-12), near.sum(2), -1)
        best = count.max(1)
        mean = np.where(count == best[:, None], np.round(np.where(near, off, 0.0).sum(2) / np.maximum(count, 1), 12), np.inf)
        least = mean.min(1)
        level = np.where(mean == least[:, None], steep, np.inf)
        at = level.argmin(1)
        lowest = level[rows, at]
        better = (best > most) | ((best == most) & ((least < error) | ((least == error) & (lowest < flat))))
        most, error, flat = np.where(better, best, most), np.where(better, least, error), np.where(better, lowest, flat)
        ticks = np.where(better[:, None], near[rows, at], ticks)
    number = ticks.sum(1)
    mean = lambda v: np.where(ticks, v, 0.0).sum(1) / np.maximum(number, 1)
    mx, my = mean(x), mean(y)
    dx, dy = (np.where(ticks, v - m[:, None], 0.0) for v, m in ((x, mx), (y, my)))
    slope = (dx * dy).sum(1) / (dx * dx).sum(1)
    return slope, my - slope * mx, number


def _lines(px: np.ndarray, py: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the axes that have a line, and its slope, intercept and near ticks; axes of as many ticks are tried together."""
    size = np.diff(offsets)
    out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64))]
    for n in np.unique(size[size >= NEAR_TICKS]):
        own = np.flatnonzero(size == n)
        step = max(1, AT_ONCE // int(n * n))
        for part in (own[a : a + step] for a in range(0, len(own), step)):
            at = offsets[part][:, None] + np.arange(n)
            with np.errstate(all="ignore"):
                slope, intercept, near = _best_lines(px[at], py[at])
            kept = near > 0
            out.append((part[kept], slope[kept], intercept[kept], near[kept]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def robust_line(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, slope, intercept, inliers): of the lines through two ticks of an axis the one that most ticks are near, refitted on those.

    Axes without such a line give no row; ticks without a place or a value do
    not count. The pairs are tried one tick at a time, whatever their number,
    for all axes of a batch that have as many ticks.
    """
    import pyarrow as pa

    # the ticks' few bytes would go to few tasks
    dealt = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)
    listed = dealt.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    schema = T.StructType([points.schema[by], T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType()), T.StructField("inliers", T.LongType())])

    def run(batches):
        for batch in batches:
            ticks = batch.column("p")
            offsets = ticks.offsets.to_numpy()
            px, py = (ticks.values.field(k).to_numpy() for k in (0, 1))
            keep, slope, intercept, near = _lines(px, py, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(keep)), pa.array(slope), pa.array(intercept), pa.array(near, pa.int64())], schema.names)

    found = listed.mapInArrow(run, schema)
    return found.select(by, F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "inliers")


def point_errors(expected: DataFrame, actual: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Per series: coverage, mean absolute and root mean square error of y at the nearest actual x; equal points count once."""
    e = expected.select(by, x, y).distinct()
    near = nearest(e, actual.select(by, F.col(x).alias("_x"), F.col(y).alias("_y")), [by], x, "_x", "_y")
    all_ = e.join(near.select(by, x, y, "_y"), [by, x, y], "left")
    d = F.col("_y") - F.col(y)
    return all_.groupBy(by).agg(F.round(F.count("_y") / F.count("*"), 4).alias("coverage"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


def chart_rows(charts: DataFrame) -> DataFrame:
    """Nested subplots[series[points[]]] as one row a point; missing coordinates stay null."""
    s = charts.select("record_id", "element_id", F.posexplode("subplots").alias("subplot", "_s"))
    t = s.select("record_id", "element_id", "subplot", F.posexplode("_s.series").alias("series", "_t"))
    return t.select("record_id", "element_id", "subplot", "series", F.col("_t.name").alias("series_name"), F.posexplode("_t.points").alias("point", "_p")).select("record_id", "element_id", "subplot", "series", "series_name", "point", "_p.x", "_p.y")


#: Parts of a table's markup.
_TABLE = re.compile(r"(?is)<(/?)(tr|td|th|br)\b([^>]*)>|<[^>]*>")
_SPAN = re.compile(r"(?i)\b(rowspan|colspan)\s*=\s*[\"']?\s*(\d+)")


def html_table(markup: str | None) -> list[list[str]]:
    """The cells of an HTML table. A cell over several rows stands in each of them, over several columns in the first one; rows without text go."""
    rows: list[list[str]] = []
    below: dict[int, tuple[int, str]] = {}  # columns that a cell above reaches into
    row: dict[int, str] | None = None
    parts: list[str] | None = None
    spans: dict[str, int] = {}

    def end_row():
        if row is not None:
            rows.append([row.get(c, "") for c in range(max(row, default=-1) + 1)])

    def end_cell():
        if row is not None and parts is not None:
            value = " ".join(html.unescape("".join(parts)).split())
            at = next(c for c in range(len(row) + 1) if c not in row)
            for k in range(spans["colspan"]):
                row[at + k] = value if k == 0 else ""
                if spans["rowspan"] > 1:
                    below[at + k] = (spans["rowspan"] - 1, row[at + k])

    text, last = markup or "", 0
    for m in _TABLE.finditer(text):
        if parts is not None:
            parts.append(text[last : m.start()])
        last = m.end()
        name = (m[2] or "").lower()
        if name == "tr":
            end_cell()
            parts = None
            end_row()
            row = None if m[1] else {c: v for c, (_, v) in below.items()}
            if row is not None:
                below = {c: (n - 1, v) for c, (n, v) in below.items() if n > 1}
        elif name in ("td", "th"):
            end_cell()
            given = {k.lower(): max(1, int(v)) for k, v in _SPAN.findall(m[3])}
            parts, spans = (None if m[1] else []), {"rowspan": 1, "colspan": 1} | given
        elif name == "br" and parts is not None:
            parts.append(" ")
    end_cell()
    end_row()
    return [r for r in rows if any(r)]


def html_rows(tables: DataFrame, markup: str, out: str = "rows") -> DataFrame:
    """Tables with `out` added, an array of rows of cells from their HTML; null and other text give no rows. The column is replaced if present."""
    import pyarrow as pa

    base = tables.drop(out)
    cells = T.ArrayType(T.ArrayType(T.StringType()))
    schema = T.StructType([*base.schema.fields, T.StructField(out, cells)])

    def run(batches):
        for batch in batches:
            found = [html_table(x) for x in batch.column(markup).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.list_(pa.string())))], schema.names)

    return base.mapInArrow(run, schema)
