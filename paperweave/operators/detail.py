"""A graph's view within a budget: what is in sight is ranked, the best nodes are drawn, the others become at most 32 groups, links follow them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .graphs import in_view

#: Nodes drawn at each level, in all, and groups among them; graphs of so many nodes are drawn whole (fixed values).
BUDGETS = {"overview": 240, "normal": 480, "detail": 900}
MOST_NODES, MOST_GROUPS, SMALL_GRAPH = 1200, 32, 180
#: From these scales on a view is one of detail, or normal (fixed values).
DETAIL, NORMAL = 1.45, 0.78
#: A view's settings: default, least and most (fixed values).
VIEW = {"width": (960.0, 1.0, 16384.0), "height": (640.0, 1.0, 16384.0), "scale": (1.0, 0.25, 8.0), "pan_x": (0.0, -1e6, 1e6), "pan_y": (0.0, -1e6, 1e6), "overscan": (120.0, 0.0, 800.0)}
#: Groups by the types of their members, and their names; other types are concepts (fixed values).
GROUPS = {
    "method": ("method", "algorithm", "model", "contribution", "comparison"),
    "experiment": ("experiment", "dataset", "metric", "baseline"),
    "result": ("result", "claim", "conclusion"),
    "source": ("author", "institution", "venue"),
    "literature": ("citation", "paper"),
    "review": ("limitation", "futurework", "missinginfo", "conflict"),
    "artifact": ("figure", "table", "equation"),
}
LABELS = {"method": "方法", "experiment": "实验", "result": "结果", "source": "作者与来源", "literature": "文献", "review": "局限与冲突", "artifact": "图表与公式", "concept": "概念"}
#: Cells of a group's place, across and down, and what another group's cell is farther away (fixed values).
GRID, OTHER_GROUP = (6, 4), 10


@dataclass
class View:
    """nodes (id, type, label, aggregate, members, importance, confidence, needs_review, x, y), edges (source, target, type, aggregate, count, confidence), and counts."""

    nodes: DataFrame
    edges: DataFrame
    status: dict


def view_settings(**given) -> dict[str, float]:
    """The settings of a view, held within their bounds; what is no finite number counts as not given."""
    out = {}
    for name, (default, low, high) in VIEW.items():
        try:
            value = float(given.get(name, default))
        except (TypeError, ValueError):
            value = default
        out[name] = max(low, min(high, value if abs(value) != float("inf") and value == value else default))
    return out


def render_level(scale: float, total: int) -> str:
    if total <= SMALL_GRAPH or scale >= DETAIL:
        return "detail"
    return "normal" if scale >= NORMAL else "overview"


def render_budget(scale: float, total: int) -> int:
    return max(1, total) if total <= SMALL_GRAPH else min(MOST_NODES, BUDGETS[render_level(scale, total)])


def group_of(type_: Column) -> Column:
    out = F.lit("concept")
    for name, types in GROUPS.items():
        out = F.when(F.lower(type_).isin(*types), name).otherwise(out)
    return out


def _nearest(sizes: list[tuple[int, str, int, int]], reserve: int) -> list[tuple[str, int, int, str, int, int]]:
    """(key, kept key) of all cells: the largest `reserve` stay, others go to the nearest of these, the first in order in a tie."""
    kept = [key for _, *key in sorted((-n, *key) for n, *key in sizes)[:reserve]]
    far = lambda a, b: (0 if a[0] == b[0] else OTHER_GROUP) + abs(a[1] - b[1]) + abs(a[2] - b[2])
    return [(*key, *(key if key in kept else min(kept, key=lambda k: (far(key, k), k)))) for _, *key in sizes]


def project(nodes: DataFrame, edges: DataFrame, pins: list[str] = (), pinned_edges: list[str] = (), spatial: bool = True, **view) -> View:
    """A view of nodes (id, type, label, x, y, importance, confidence, evidence, needs_review) and edges (id, source, target, type, confidence).

    Nodes outside the view go unless pinned (graphs of 180 nodes and views that
    are not `spatial` keep all). Rank: pins, papers, importance, degree up to
    1000, evidence, confidence, label, id, the greatest first. Where more are
    left than the budget, max(8, budget / 8) places, 32 at most, are for groups:
    the others by group and cell, the largest cells kept and the rest added to
    the nearest. Pins are always drawn. Links between drawn nodes stay; others
    are counted by ends and type, those inside a group go; max(400, 3 x budget)
    are returned, pinned and sure ones first, then the counted ones. Nulls count
    as 0, places as 0.5. Cells are at most 192, so their sizes come to the driver.
    """
    settings = view_settings(**view)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    place = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.5))))
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    base = nodes.select("id", "type", "label", place("x").alias("x"), place("y").alias("y"), zero("importance").alias("importance"), zero("confidence").alias("confidence"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"))
    total = base.count()
    budget = render_budget(settings["scale"], total)
    pinned = F.col("id").isin(*pins) if pins else F.lit(False)
    base = base.withColumn("pinned", pinned)
    seen = base if total <= SMALL_GRAPH or not spatial else base.filter(F.col("pinned") | in_view(F.col("x"), F.col("y"), **settings))
    seen = durable(seen.join(degree, "id", "left").withColumn("degree", F.least(F.lit(1000), F.coalesce("degree", F.lit(0)))))
    found, held = seen.agg(F.count(F.lit(1)), F.count_if("pinned")).head()
    order = [F.col("pinned").desc(), (F.lower("type") == "paper").desc(), *[F.col(c).desc() for c in ("importance", "degree", "evidence", "confidence")], F.lower("label").desc(), F.col("id").desc()]
    crowded = found > budget
    reserve = min(MOST_GROUPS, max(8, budget // 8))
    real = max(held, budget - reserve) if crowded else found
    drawn = seen.orderBy(*order).limit(real).select("id", F.lit(True).alias("drawn")) if crowded else seen.select("id", F.lit(True).alias("drawn"))
    cell = lambda c, n: F.least(F.lit(n - 1), F.floor(F.col(c) * n)).cast("int")
    placed = seen.join(F.broadcast(drawn) if crowded else drawn, "id", "left").withColumns({"g": group_of(F.coalesce("type", F.lit(""))), "cx": cell("x", GRID[0]), "cy": cell("y", GRID[1])})
    if crowded:
        placed = durable(placed)
        sizes = [(r.n, r.g, r.cx, r.cy) for r in placed.filter("drawn IS NULL").groupBy("g", "cx", "cy").agg(F.count(F.lit(1)).alias("n")).collect()]
        mapped = placed.sparkSession.createDataFrame(_nearest(sizes, reserve), "g string, cx int, cy int, kg string, kx int, ky int")
        placed = placed.join(F.broadcast(mapped), ["g", "cx", "cy"], "left")
        group = F.concat_ws(":", F.lit("cluster"), "kg", F.col("kx").cast("string"), F.col("ky").cast("string"))
        placed = durable(placed.withColumn("target", F.when(F.col("drawn"), F.col("id")).otherwise(group)))
    else:
        placed = placed.withColumn("target", F.col("id")).withColumn("kg", F.lit(None).cast("string"))
    single = placed.filter("drawn").select("id", "type", "label", F.lit(False).alias("aggregate"), F.lit(1).cast("long").alias("members"), "importance", "confidence", "needs_review", "x", "y")
    name = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.min("kg")), F.lit(" · "), F.count(F.lit(1)).cast("string"))
    groups = placed.filter("drawn IS NULL").groupBy(F.col("target").alias("id")).agg(
        F.lit("cluster").alias("type"), name.alias("label"), F.lit(True).alias("aggregate"), F.count(F.lit(1)).alias("members"), F.max("importance").alias("importance"), F.avg("confidence").alias("confidence"), F.bool_or("needs_review").alias("needs_review"), F.avg("x").alias("x"), F.avg("y").alias("y")
    )
    a, b = placed.select(F.col("id").alias("source"), F.col("target").alias("s")), placed.select(F.col("id").alias("target"), F.col("target").alias("t"))
    kept = edges.join(a, "source").join(b, "target").filter("s != t")
    own = (F.col("s") == F.col("source")) & (F.col("t") == F.col("target"))
    first = F.col("id").isin(*pinned_edges) if pinned_edges else F.lit(False)
    plain = kept.filter(own).select("source", "target", "type", F.lit(False).alias("aggregate"), F.lit(1).cast("long").alias("count"), zero("confidence").alias("confidence"), F.when(first, 0).otherwise(1).alias("_o"), "id")
    kind = F.upper(F.coalesce(F.nullif("type", F.lit("")), F.lit("RELATED_TO")))
    counted = kept.filter(~own).groupBy(F.col("s").alias("source"), F.col("t").alias("target"), kind.alias("type")).agg(F.count(F.lit(1)).alias("count"), F.avg(zero("confidence")).alias("confidence"))
    counted = counted.select("source", "target", "type", F.lit(True).alias("aggregate"), "count", "confidence", F.lit(2).alias("_o"), F.lit(None).cast(plain.schema["id"].dataType).alias("id"))
    most = max(400, budget * 3)
    links = plain.unionByName(counted).orderBy("_o", F.when(F.col("aggregate"), F.col("count").cast("double")).otherwise(F.col("confidence")).desc(), "source", "target", "type", "id").limit(most).drop("_o", "id")
    status = {"level": render_level(settings["scale"], total), "budget": budget, "total": total, "candidates": found, "real": real, "culled": total - found, "edge_budget": most}
    return View(single.unionByName(groups) if crowded else single, links, status)
