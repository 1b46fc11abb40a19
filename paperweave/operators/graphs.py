"""Graph queries as joins: neighbours, paths, components, betweenness, facets, levels of detail.

Edges have `source` and `target`; ids of any orderable type. Iterations write
each round to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

#: Below this confidence a node needs review (a fixed value).
REVIEW = 0.6
#: Relation types of an exploration's modes (fixed values); references are followed from their source, citations from their target.
MODES = {
    "references": ("CITES",),
    "cited_by": ("CITES",),
    "authors": ("AUTHOR_OF", "WRITTEN_BY"),
    "institutions": ("AFFILIATED_WITH", "ASSOCIATED_WITH"),
    "topics": ("HAS_TOPIC", "MENTIONS", "HAS_KEYWORD"),
    "venues": ("PUBLISHED_IN",),
}
#: Links that one task finishes; an edge is two of them, of about 100 bytes each in its tables.
LOCAL_LINKS = 1_000_000


def mode_matches(mode: str, node, source: str = "source", target: str = "target", kind: str = "type") -> Column:
    """Whether an edge belongs to a mode of exploring a node: its relation type, and for citations its direction."""
    if mode == "all":
        return F.lit(True)
    fits = F.upper(F.coalesce(F.col(kind), F.lit(""))).isin(*MODES.get(mode, ("",)))
    if mode == "references":
        return fits & (F.col(source) == F.lit(node))
    if mode == "cited_by":
        return fits & (F.col(target) == F.lit(node))
    return fits & F.lit(mode in MODES)


def in_view(x: Column, y: Column, width: float, height: float, scale: float = 1.0, pan_x: float = 0.0, pan_y: float = 0.0, overscan: float = 0.0) -> Column:
    """Whether a place of the unit square is on a screen of that size, zoomed about its middle and moved, with a margin.

    The margins and least sizes of the drawing are fixed values.
    """
    at_x = 36.0 + x * max(120.0, width - 72.0)
    at_y = 42.0 + y * max(120.0, height - 92.0)
    on_x = (at_x - width / 2.0) * scale + width / 2.0 + pan_x
    on_y = (at_y - height / 2.0) * scale + height / 2.0 + pan_y
    return on_x.between(-overscan, width + overscan) & on_y.between(-overscan, height + overscan)


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct (source, target) in either direction, without loops."""
    one = edges.select("source", "target")
    return one.union(one.select(F.col("target").alias("source"), F.col("source").alias("target"))).filter("source != target").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): distinct neighbours. Spark counts before it shuffles; no list of a hub's neighbours is built."""
    return both_ways(edges).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("degree"))


def neighbour_page(nodes: DataFrame, edges: DataFrame, node, offset: int = 0, limit: int = 20, most: int = 100) -> DataFrame:
    """A page of a node's neighbours: importance down, then label, then id; with `total` and `has_more`."""
    offset, limit = max(0, offset), min(max(1, limit), most)
    near = both_ways(edges).filter(F.col("source") == F.lit(node)).select(F.col("target").alias("id"))
    found = nodes.join(near, "id", "left_semi")
    total = found.agg(F.count("*").alias("total"))
    part = found.orderBy(F.coalesce("importance", F.lit(0.0)).desc(), "label", "id").offset(offset).limit(limit)
    return part.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def _one_task(links: DataFrame, reached: DataFrame, kind, most: int | None):
    """The rest of a breadth-first search over few links, in one task. reached (id, depth) are the nodes found so far."""
    import pyarrow as pa

    value = kind.simpleString()

    def run(batches):
        near: dict = {}
        depth: dict = {}
        for batch in batches:
            for s, t, d in zip(*(batch.column(c).to_pylist() for c in ("source", "target", "depth")), strict=True):
                if d is None:
                    near.setdefault(s, []).append(t)
                else:
                    depth[s] = d
        last = max(depth.values(), default=0)
        frontier = sorted(x for x, d in depth.items() if d == last)
        out = []
        while frontier and (most is None or last < most):
            last += 1
            parent: dict = {}
            for x in frontier:
                for y in near.get(x, ()):
                    if y not in depth and not (y in parent and parent[y] <= x):
                        parent[y] = x
            depth.update(dict.fromkeys(parent, last))
            out += [(y, last, x) for y, x in parent.items()]
            frontier = sorted(parent)
        if out:
            ids, depths, parents = zip(*out, strict=True)
            schema = batch.schema.field("source").type
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema), pa.array(depths, pa.int32()), pa.array(parents, schema)], ["id", "depth", "parent"])

    rows = links.select("source", "target", F.lit(None).cast("int").alias("depth")).union(reached.select("id", "id", "depth"))
    return rows.coalesce(1).mapInArrow(run, f"id {value}, depth int, parent {value}")


def bfs(edges: DataFrame, start, directed: bool = False, max_depth: int | None = None, local: int = LOCAL_LINKS, most_nodes: int | None = None, goal=None, ready: bool = False) -> DataFrame:
    """(id, depth, parent) of all nodes reached; the parent is the least id one step nearer.

    Each round joins the frontier only; the visited set is found again by an
    anti join, so no round holds more than the nodes and the frontier's edges.
    Once at most `local` links lead to nodes that are not reached yet, they are
    finished in one task, so a long line is not a job a step. With `most_nodes`
    the search ends after the round that reaches more, with `goal` after the
    round that reaches that node. A start without edges is reached alone. Edges
    that are `ready` are a stored table of what both_ways gives, or of distinct
    directed links.
    """
    links = edges if ready else durable(edges.select("source", "target").filter("source != target").distinct() if directed else both_ways(edges))
    kind = links.schema["source"].dataType
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"))
    frontier, depth, found = seen, 0, 1
    left = links.count()
    while max_depth is None or depth < max_depth:
        if left <= local and most_nodes is None:
            return seen.unionByName(durable(_one_task(links, seen, kind, max_depth)))
        depth += 1
        step = links.join(frontier.select(F.col("id").alias("source")), "source")
        new = step.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("parent"))
        frontier = durable(new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "parent"))
        size = frontier.count()
        if not size:
            break
        seen, found = seen.unionByName(frontier), found + size
        if most_nodes is not None and found > most_nodes:
            break
        if goal is not None and not frontier.filter(F.col("id") == F.lit(goal)).isEmpty():
            break
        if depth % 4 == 0 and most_nodes is None:  # links to nodes that are reached lead nowhere new
            seen = durable(seen)
            links = durable(links.join(seen.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target"))
            left = links.count()
    return seen


def relation_links(edges: DataFrame, relations=None) -> DataFrame:
    """Edges of the given relation types, in either case; all for none, or with `all` among them."""
    names = {r.upper() for r in relations or () if r and r.strip()}
    return edges.filter(F.upper("type").isin(sorted(names))) if names and "ALL" not in names else edges


def shortest_path(edges: DataFrame, start, end, directed: bool = False, relations=None, local: int = LOCAL_LINKS) -> DataFrame:
    """(position, id) along one shortest path, the first by its ids from the start on; no rows if there is none.

    Levels are counted from the start. Only links from a level to the next that
    lead on to the end are left; of these each node takes the one to the least
    id, and that chain is followed. Lines may have any length.
    """
    edges = relation_links(edges, relations) if relations else edges
    kind = edges.schema["source"].dataType
    links = durable(edges.select("source", "target").filter("source != target").distinct() if directed else both_ways(edges))
    reached = durable(bfs(links, start, directed, local=local, goal=end, ready=True).select("id", "depth"))
    last = reached.filter(F.col("id") == F.lit(end)).first()
    if last is None:
        return edges.sparkSession.createDataFrame([], f"position int, id {kind.simpleString()}")
    # of the last level only the end counts, and nothing that lies behind it
    inner = reached.filter((F.col("depth") < last["depth"]) | (F.col("id") == F.lit(end)))
    levels = links.join(inner.select(F.col("id").alias("source"), F.col("depth").alias("_d")), "source").join(inner.select(F.col("id").alias("target"), F.col("depth").alias("_e")), "target")
    levels = durable(levels.filter("_e = _d + 1").select("source", "target"))
    onward = bfs(levels.select(F.col("target").alias("source"), F.col("source").alias("target")), end, True, local=local).select(F.col("id").alias("target"))
    chosen = durable(levels.join(onward, "target", "left_semi").groupBy("source").agg(F.min("target").alias("target")))
    return bfs(chosen, start, True, local=local).select(F.col("depth").alias("position"), "id")


def path_status(nodes: DataFrame, edges: DataFrame, start, end, directed: bool = False, relations=None, most_visited: int = 50_000, local: int = LOCAL_LINKS) -> dict:
    """A path query: its status, length, and the path's steps as a DataFrame (None without a path).

    nodes (id), edges (id, source, target, type, confidence). The status is
    invalid if an end is no node, too_large if more than most_visited nodes lie
    nearer to the start than the end, no_path, or ready. Edges to ids that are no
    nodes do not count. Steps are (position, source_id, target_id, edge_id,
    relation, forward, confidence): of parallel edges the first by type and id.
    """
    known = {r["id"] for r in nodes.filter(F.col("id").isin(start, end)).select("id").distinct().collect()}
    if start not in known or end not in known:
        return {"status": "invalid", "length": 0, "steps": None}
    if start == end:
        return {"status": "ready", "length": 0, "steps": None}
    inside = relation_links(edges, relations).join(nodes.select(F.col("id").alias("source")).distinct(), "source", "left_semi").join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi")
    inside = durable(inside.select("id", "source", "target", "type", "confidence"))
    near = durable(bfs(inside, start, directed, local=local, most_nodes=most_visited).select("id", "depth"))
    goal = near.filter(F.col("id") == F.lit(end)).first()
    visited = near.count() if goal is None else near.filter(F.col("depth") < goal["depth"]).count()
    if visited > most_visited:
        return {"status": "too_large", "length": 0, "steps": None}
    if goal is None:
        return {"status": "no_path", "length": 0, "steps": None}
    path = durable(shortest_path(inside, start, end, directed, local=local))
    pairs = path.join(path.select((F.col("position") - 1).alias("position"), F.col("id").alias("target_id")), "position").withColumnRenamed("id", "source_id")
    ways = inside.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "id", "type", "confidence", F.lit(True).alias("forward"))
    if not directed:
        ways = ways.unionByName(inside.select(F.col("target").alias("source_id"), F.col("source").alias("target_id"), "id", "type", "confidence", F.lit(False).alias("forward")))
    first = F.min_by(F.struct("id", "type", "confidence", "forward"), F.struct("type", "id", ~F.col("forward")))
    steps = pairs.join(ways, ["source_id", "target_id"]).groupBy("position", "source_id", "target_id").agg(first.alias("e"))
    steps = steps.select("position", "source_id", "target_id", F.col("e.id").alias("edge_id"), F.upper("e.type").alias("relation"), "e.forward", F.round(F.coalesce("e.confidence", F.lit(1.0)), 4).alias("confidence"))
    return {"status": "ready", "length": goal["depth"], "steps": steps}


def components(edges: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(id, component): the least id that each node of an edge reaches.

    Up to `local` edges are joined in one task. Beyond, labels pass to
    neighbours, and in the same round on to the label's own label, so that
    chains halve; rounds end when no label changes.
    """
    once = durable(edges.select("source", "target").filter("source != target").distinct())
    if once.count() <= local:
        return durable(_joined(once))
    links = durable(both_ways(once))
    labels = durable(links.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        at = labels.select(F.col("id").alias("target"), F.col("component").alias("c"))
        near = links.join(at, "target").groupBy(F.col("source").alias("id")).agg(F.min("c").alias("c"))
        low = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("to"))
        new = durable(low.join(jump, "low").select("id", "old", F.least("low", "to").alias("component")))
        labels = new.drop("old")
        if new.filter("old != component").isEmpty():
            return labels


def _joined(edges: DataFrame) -> DataFrame:
    import pyarrow as pa

    kind = edges.schema["source"].dataType.simpleString()

    def run(batches):
        up: dict = {}
        form = None

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            form = batch.schema.field("source").type
            for a, b in zip(batch.column("source").to_pylist(), batch.column("target").to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), form), pa.array([top(x) for x in up], form)], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, f"id {kind}, component {kind}")


def _dependencies(near: DataFrame, most: int | None) -> DataFrame:
    """(id, share): what shortest paths from each s depend on each node. near (s, source, target) are the links that s reaches; a task holds those of one s."""
    import pyarrow as pa

    kind = near.schema["source"].dataType.simpleString()

    def shares(s, links):
        paths, depth, levels = {s: 1.0}, {s: 0}, [[s]]
        while levels[-1] and (most is None or len(levels) <= most):
            new: dict = {}
            for x in levels[-1]:
                for y in links.get(x, ()):
                    if y not in depth:
                        new[y] = new.get(y, 0.0) + paths[x]
            paths.update(new)
            depth.update(dict.fromkeys(new, len(levels)))
            levels.append(list(new))
        share = dict.fromkeys(paths, 0.0)
        for d in range(len(levels) - 1, 0, -1):
            for y in levels[d]:
                part = (1 + share[y]) / paths[y]
                for x in links.get(y, ()):
                    if depth.get(x) == d - 1:
                        share[x] += paths[x] * part
        del share[s]
        return share

    def run(batches):
        at, links, form = None, {}, None

        def told():
            found = shares(at, links)
            return pa.RecordBatch.from_arrays([pa.array(list(found), form), pa.array(list(found.values()), pa.float64())], ["id", "share"])

        for batch in batches:
            form = batch.schema.field("source").type
            for s, x, y in zip(*(batch.column(c).to_pylist() for c in ("s", "source", "target")), strict=True):
                if s != at:
                    if links:
                        yield told()
                    at, links = s, {}
                links.setdefault(x, []).append(y)
        if links:
            yield told()

    rows = near.repartition(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s").sortWithinPartitions("s", "source", "target")
    return rows.mapInArrow(run, f"id {kind}, share double")


def betweenness(edges: DataFrame, sources: int = 48, max_depth: int | None = None, local: int = LOCAL_LINKS) -> DataFrame:
    """(id, score): dependencies of shortest paths from evenly spaced sources, over the largest.

    A source whose component has at most `local` links is finished in one task,
    so a long line is not a job a step. For the others forward rounds count
    paths for all sources at once, backward rounds share dependencies out; both
    are joins on the nodes of one level.
    """
    links = durable(both_ways(edges))
    ids = links.select(F.col("source").alias("id")).distinct()
    n = ids.count()
    step = max(1, -(-n // sources))
    # zipWithIndex-like ranks without a single task: ranks within ordered partitions plus offsets
    ordered = durable(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    offsets = ordered.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ordered.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("id"))).join(F.broadcast(offsets), "part")
    chosen = ranked.filter((F.col("rank") + F.col("before") - 1) % step == 0).select("id")
    # only what a source reaches counts; sources are few
    parts = components(links.filter("source < target"))
    at = durable(chosen.join(parts, "id").select(F.col("id").alias("s"), "component"))
    held = parts.join(F.broadcast(at.select("component").distinct()), "component", "left_semi")
    reached = durable(links.join(held.withColumnRenamed("id", "source"), "source"))
    at = durable(at.join(F.broadcast(reached.groupBy("component").agg((F.count("*") > local).alias("large"))), "component"))
    total = _dependencies(reached.join(F.broadcast(at.filter("NOT large")), "component").select("s", "source", "target"), max_depth)
    if not at.filter("large").isEmpty():
        inside = reached.join(F.broadcast(at.filter("large").select("component").distinct()), "component", "left_semi").select("source", "target")
        total = total.unionByName(_rounds(inside, at.filter("large").select("s"), max_depth))
    sums = total.groupBy("id").agg(F.sum("share").alias("sum"))
    all_ = durable(ids.join(sums, "id", "left").select("id", F.coalesce("sum", F.lit(0.0)).alias("sum")))
    largest = all_.agg(F.max("sum").alias("top"))
    return all_.join(F.broadcast(largest)).select("id", F.when(F.col("top") > 0, F.round(F.col("sum") / F.col("top"), 6)).otherwise(0.0).alias("score"))


def _rounds(links: DataFrame, chosen: DataFrame, max_depth: int | None) -> DataFrame:
    """(id, share) as _dependencies says them, a level of all chosen (s) at a time."""
    levels = [durable(chosen.select("s", F.col("s").alias("id"), F.lit(1.0).alias("paths")))]
    while max_depth is None or len(levels) <= max_depth:
        at = levels[-1].withColumnRenamed("id", "source")
        new = links.join(at, "source").groupBy("s", F.col("target").alias("id")).agg(F.sum("paths").alias("paths"))
        # links go both ways, so what a level leads back to lies on it or on the one before
        for old in levels[-2:]:
            new = new.join(old.select("s", "id"), ["s", "id"], "left_anti")
        new = durable(new)
        if new.isEmpty():
            break
        levels.append(new)
    shares, below = [], levels[-1].withColumn("share", F.lit(0.0))
    for level in reversed(levels[:-1]):
        part = below.select("s", F.col("id").alias("target"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        got = links.join(part, "target").groupBy("s", F.col("source").alias("id")).agg(F.sum("part").alias("part"))
        shares.append(below)
        below = durable(level.join(got, ["s", "id"], "left").select("s", "id", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
    shares.append(below)
    total = shares[0]
    for x in shares[1:]:
        total = total.unionByName(x)
    return total.filter("s != id").select("id", "share")


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("count"))


def needs_review(confidence: Column, flag: Column | None = None) -> Column:
    low = F.coalesce(confidence, F.lit(1.0)) < REVIEW
    return low if flag is None else F.coalesce(flag, F.lit(False)) | low


def induced(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, text: str = "", only_review: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, and the edges between them."""
    test = F.lit(True)
    if types:
        test = test & F.col("type").isin(*types)
    if text:
        test = test & F.contains(F.lower(F.concat_ws(" ", "label", "type")), F.lit(text.lower()))
    if only_review:
        test = test & needs_review(F.col("confidence"))
    kept = nodes.filter(test)
    ids = kept.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, inside


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ends = edges.select("source", "target", F.explode(F.array("source", "target")).alias("id"))
    return ends.join(nodes.select("id"), "id", "left_anti").select("source", "target", F.col("id").alias("missing"))


def merge_graphs(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of several graphs; of equal keys the one of the earliest graph stays."""
    rows = None
    for i, p in enumerate(parts):
        one = p.withColumn("_at", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in key and c != "_at"]
    best = F.min_by(F.struct(*columns), F.struct("_at", *columns)).alias("_b")
    return rows.groupBy(*key).agg(best).select(*key, "_b.*")


def facet_visible(facts: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Ids whose facts (id, facet, value) meet every wanted facet, any of its values."""
    test = F.lit(False)
    for facet, values in wanted.items():
        test = test | ((F.col("facet") == facet) & F.col("value").isin(*values))
    return facts.filter(test).groupBy("id").agg(F.countDistinct("facet").alias("_n")).filter(F.col("_n") == len(wanted)).select("id")


def with_neighbours(ids: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """The ids and all within so many steps."""
    links = both_ways(edges)
    for _ in range(hops):
        ids = ids.union(links.join(ids.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))).distinct()
    return ids
