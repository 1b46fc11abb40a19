"""Analytics of a paper collection: citations, key papers and paths, groups of people, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable
from .pairs import dealt, meetings

#: Weights of scores (fixed values).
COLLABORATION = {"papers": 0.36, "citations": 0.30, "partners": 0.20, "topics": 0.14}
KEY = {"citations": 0.52, "assignment": 0.25, "importance": 0.15, "representative": 0.18}
#: Paths kept, and how much of their nodes two of them may share (fixed values).
PATHS, OVERLAP = 6, 0.72


def classify_citations(links: DataFrame, papers: DataFrame, id_: str = "id", year: str = "year") -> DataFrame:
    """links (source, target) with both years and `state`: valid, chronology_conflict (the cited is younger) or unknown_year.

    Links to papers outside the collection, and of a paper to itself, are left out.
    """
    a = papers.select(F.col(id_).alias("source"), F.col(year).alias("source_year"))
    b = papers.select(F.col(id_).alias("target"), F.col(year).alias("target_year"))
    joined = links.select("source", "target").filter("source != target").distinct().join(a, "source").join(b, "target")
    state = F.when(F.col("source_year").isNull() | F.col("target_year").isNull(), "unknown_year").when(F.col("target_year") > F.col("source_year"), "chronology_conflict").otherwise("valid")
    return joined.withColumn("state", state)


def coverage(links: DataFrame, papers: int) -> DataFrame:
    """One row: links by state, and links per paper."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return links.agg(F.count("*").alias("links"), count("valid"), count("chronology_conflict"), count("unknown_year")).withColumn("per_paper", F.round(F.col("links") / max(1, papers), 4))


def key_score(citations: Column, most: Column, assignment: Column, importance: Column, representative: Column) -> Column:
    """Between 0 and 1; citations count in proportion to the most cited."""
    share = F.when(most > 0, citations / most).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), KEY["citations"] * share + KEY["assignment"] * assignment + KEY["importance"] * importance + F.when(representative, KEY["representative"]).otherwise(0.0)), 4)


def paper_metrics(links: DataFrame, strengths: DataFrame, topics: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """(id, citations_in, degree, cross_links, core_score, bridge_score).

    links (source, target), strengths (id, strength) of coupling and
    co-citation, topics (id, topic), betweenness (id, score).
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.lit(0).alias("cited")), F.struct(F.col("target").alias("id"), F.col("source").alias("other"), F.lit(1).alias("cited")))).alias("e")).select("e.*")
    own, other = topics.select("id", "topic"), topics.select(F.col("id").alias("other"), F.col("topic").alias("_t"))
    counted = ends.join(own, "id", "left").join(other, "other", "left").groupBy("id").agg(F.sum("cited").alias("citations_in"), F.count("*").alias("degree"), F.count_if(F.col("topic") != F.col("_t")).alias("cross_links"))
    all_ = topics.select("id").join(counted, "id", "left").join(strengths, "id", "left").fillna(0)
    most = all_.agg(F.greatest(F.max("citations_in"), F.lit(1)).alias("_in"), F.greatest(F.max("degree"), F.lit(1)).alias("_deg"))
    x = all_.join(F.broadcast(most))
    x = x.join(betweenness.withColumnRenamed("score", "_b"), "id", "left") if betweenness is not None else x.withColumn("_b", F.lit(0.0))
    core = 0.55 * F.col("citations_in") / F.col("_in") + 0.30 * F.col("degree") / F.col("_deg") + 0.15 * F.least(F.lit(1.0), F.col("strength") / 5)
    bridge = 0.62 * F.coalesce("_b", F.lit(0.0)) + 0.38 * F.when(F.col("degree") > 0, F.col("cross_links") / F.col("degree")).otherwise(0.0)
    return x.select("id", "citations_in", "degree", "cross_links", F.round(core, 4).alias("core_score"), F.round(bridge, 4).alias("bridge_score"))


def causal_links(links: DataFrame, papers: DataFrame) -> DataFrame:
    """(from, id): links from a cited to a citing paper that can be followed without going round.

    The cited paper must not be younger. Within a year papers come in the order
    of their links; papers on a cycle of one year, or behind one, come last, by
    id, and of the links between those only the ones that follow that order stay.
    Papers that are cleared one after another along a line are cleared together,
    by doubling.
    """
    a = papers.filter("year IS NOT NULL").select(F.col("id").alias("target"), F.col("year").alias("_ty"))
    b = papers.filter("year IS NOT NULL").select(F.col("id").alias("source"), F.col("year").alias("_sy"))
    steps = durable(links.select("source", "target").filter("source != target").distinct().join(a, "target").join(b, "source").filter("_ty <= _sy").select(F.col("target").alias("from"), F.col("source").alias("id"), (F.col("_ty") == F.col("_sy")).alias("same")))
    same = steps.filter("same").select("from", "id")
    if same.isEmpty():
        return steps.select("from", "id")
    into = durable(same.groupBy("id").agg(F.count("*").alias("n"), F.min("from").alias("up")))
    lines = durable(into.filter("n = 1").select("id", F.col("up").alias("head")))
    single = lines.select("id")
    before = None
    while True:
        up = lines.select(F.col("id").alias("head"), F.col("head").alias("_head"))
        lines = durable(lines.join(up, "head", "left").select("id", F.coalesce("_head", "head").alias("head"), F.col("_head").isNotNull().alias("moved")))
        # a line that ends has papers at every distance from its head: once no more of them arrive, those that still move go round
        moved = lines.filter("moved").count()
        lines = lines.drop("moved")
        if moved in (0, before):
            break
        before = moved
    # heads that are in a line themselves go round for ever
    ring = durable(lines.join(single.select(F.col("id").alias("head")), "head", "left_semi").select("id"))
    lines = lines.join(ring, "id", "left_anti")
    joints = same.join(into.filter("n > 1").select("id"), "id", "left_semi")
    heads = joints.join(lines.select(F.col("id").alias("from"), "head"), "from", "left").join(ring.select(F.col("id").alias("from"), F.lit(True).alias("_ring")), "from", "left")
    open_ = durable(heads.select("id", F.coalesce("head", "from").alias("head"), F.coalesce("_ring", F.lit(False)).alias("ring")).distinct())
    while True:
        # a joint is open as long as one of its heads is a ring or an open joint
        stuck = open_.filter("ring").select("id").union(open_.join(open_.select(F.col("id").alias("head")).distinct(), "head", "left_semi").select("id")).distinct()
        left = durable(open_.join(stuck, "id", "left_semi"))
        if left.count() == open_.count():
            break
        open_ = left
    late = ring.union(open_.select("id")).union(lines.join(open_.select(F.col("id").alias("head")).distinct(), "head", "left_semi").select("id")).distinct()
    late = durable(late.withColumn("_late", F.lit(True)))
    marked = steps.join(late, "id", "left").join(late.select(F.col("id").alias("from"), F.col("_late").alias("_from_late")), "from", "left")
    goes_on = ~F.col("same") | F.col("_late").isNull() | F.col("_from_late").isNull() | (F.col("from") < F.col("id"))
    return marked.filter(goes_on).select("from", "id")


def longest_paths(links: DataFrame, papers: DataFrame, causal: DataFrame | None = None) -> DataFrame:
    """(id, score, length, parent): the best-weighted chain of citations that ends at each paper.

    papers (id, year, key). Influence goes from the cited to the citing paper; a
    paper adds 1 + 0.35 key, and a step 0.04 for each year, 0.6 at most; length
    counts steps. Which links are followed says causal_links. Papers with one
    step into them hang on the paper at the head of their line, found by
    doubling; among the others each round extends chains by one link, until none
    improves. Equal scores take the longer chain, then the greatest parent.
    """
    causal = causal_links(links, papers) if causal is None else causal
    a = papers.select(F.col("id").alias("from"), F.col("year").alias("_ty"))
    b = papers.select("id", F.col("year").alias("_sy"), F.coalesce("key", F.lit(0.0)).alias("_key"))
    steps = durable(causal.join(a, "from").join(b, "id").select("from", "id", (1 + 0.35 * F.col("_key") + F.least(F.lit(0.6), 0.04 * (F.col("_sy") - F.col("_ty")))).alias("gain")))
    into = steps.groupBy("id").agg(F.count("*").alias("steps"), F.min("from").alias("from"), F.min("gain").alias("gain"))
    lines = durable(into.filter("steps = 1").select("id", F.col("from").alias("parent"), F.col("from").alias("head"), "gain", F.lit(1).alias("n"), F.lit(True).alias("moved")))
    while not lines.filter("moved").isEmpty():
        up = lines.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("gain").alias("_gain"), F.col("n").alias("_n"))
        further = F.col("_head").isNotNull()
        lines = durable(lines.join(up, "head", "left").select("id", "parent", F.coalesce("_head", "head").alias("head"), F.when(further, F.col("gain") + F.col("_gain")).otherwise(F.col("gain")).alias("gain"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), further.alias("moved")))
    lines = lines.drop("moved")
    offset = lines.select(F.col("id").alias("from"), "head", F.col("gain").alias("_gain"), F.col("n").alias("_n"))
    joints = steps.join(into.filter("steps > 1").select("id"), "id", "left_semi").join(offset, "from", "left")
    joints = durable(joints.select("from", "id", F.coalesce("head", "from").alias("head"), (F.col("gain") + F.coalesce("_gain", F.lit(0.0))).alias("gain"), (1 + F.coalesce("_n", F.lit(0))).alias("n")))
    kind = papers.schema["id"].dataType
    own = F.round(1 + 0.35 * F.coalesce("key", F.lit(0.0)), 6)
    best = durable(papers.select("id", own.alias("score"), F.lit(0).alias("length"), F.lit(None).cast(kind).alias("parent")).join(lines.select("id"), "id", "left_anti"))
    frontier = best
    while not frontier.isEmpty():
        moved = joints.join(frontier.select(F.col("id").alias("head"), "score", "length"), "head").select("id", F.round(F.col("score") + F.col("gain"), 6).alias("score"), (F.col("length") + F.col("n")).alias("length"), F.col("from").alias("parent"))
        offer = moved.groupBy("id").agg(F.max(F.struct("score", "length", "parent")).alias("o"))
        joined = best.join(offer, "id", "left")
        same = F.col("o.score") == F.col("score")
        longer = (F.col("o.length") > F.col("length")) | ((F.col("o.length") == F.col("length")) & (F.col("o.parent") > F.col("parent")))
        better = F.coalesce((F.col("o.score") > F.col("score")) | (same & longer), F.lit(False))
        new = durable(joined.select("id", *[F.when(better, F.col(f"o.{c}")).otherwise(F.col(c)).alias(c) for c in ("score", "length", "parent")], better.alias("moved")))
        best, frontier = new.drop("moved"), new.filter("moved").drop("moved")
    heads = best.select(F.col("id").alias("head"), "score", "length")
    return best.unionByName(lines.join(heads, "head").select("id", F.round(F.col("score") + F.col("gain"), 6).alias("score"), (F.col("length") + F.col("n")).alias("length"), "parent"))


def walked_back(ends: DataFrame, best: DataFrame, longest: int) -> DataFrame:
    """(end, id, back): the papers of the chains that end at `ends`, so many steps before the end. Pointers double, so it takes log(longest) joins."""
    jumps = [durable(best.filter("parent IS NOT NULL").select("id", F.col("parent").alias("to")))]
    while (1 << len(jumps)) <= longest:
        last = jumps[-1]
        jumps.append(durable(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("_to")), "to").select("id", F.col("_to").alias("to"))))
    rows = ends.select(F.col("id").alias("end"), "id", F.lit(0).alias("back"))
    for k in range(len(jumps) - 1, -1, -1):
        rows = durable(rows.unionByName(rows.join(jumps[k], "id").select("end", F.col("to").alias("id"), (F.col("back") + (1 << k)).alias("back"))))
    return rows


def key_paths(links: DataFrame, papers: DataFrame, most: int = PATHS, overlap: float = OVERLAP, pool: int = 40) -> DataFrame:
    """(path, position, id): the best chains, of which no two share more than `overlap` of their papers.

    Chains end where no followed link leads on. They are taken in order of
    score, length and id, `pool` at a time until `most` are found or none is
    left; chains meet by a join on their papers, and the driver sees how many
    papers two chains share, for `pool` chains at a time, never the papers.
    """
    causal = durable(causal_links(links, papers))
    best = durable(longest_paths(links, papers, causal))
    ends = durable(best.filter("length > 0").join(causal.select(F.col("from").alias("id")).distinct(), "id", "left_anti").select("id", "score", "length"))
    kept = best.sparkSession.createDataFrame([], "path int").join(best.select("id", F.lit(0).alias("back"), F.lit(0).alias("size")).limit(0))
    paths, at = 0, 0
    while paths < most:
        part = durable(ends.orderBy(F.col("score").desc(), F.col("length").desc(), "id").offset(at).limit(pool))
        order = [(r["id"], r["length"] + 1) for r in part.orderBy(F.col("score").desc(), F.col("length").desc(), "id").collect()]
        if not order:
            break
        at += len(order)
        chains = durable(walked_back(part, best, max(n for _, n in order)))
        old = durable(kept.select(F.col("path").cast("string").alias("other"), "id", "size"))
        name = F.concat(F.lit("e"), F.col("end").cast("string"))
        all_ = chains.select(name.alias("other"), "id", F.lit(None).cast("int").alias("size")).unionByName(old)
        meet = chains.select("end", "id").join(all_, "id").groupBy("end", "other").agg(F.count("*").alias("both"), F.max("size").alias("size")).collect()
        shared = {(str(r["end"]), r["other"]): (r["both"], r["size"]) for r in meet}
        size = {f"e{e}": n for e, n in order}
        chosen: list = []
        for e, n in order:
            rivals = [f"e{c}" for c in chosen] + [k for (x, k), (_, z) in shared.items() if x == str(e) and z is not None]
            fits = True
            for k in rivals:
                both, z = shared.get((str(e), k), (0, None))
                fits = fits and both <= overlap * (n + (z or size.get(k, 0)) - both)
            if fits and paths + len(chosen) < most:
                chosen.append(e)
        if chosen:
            number = papers.sparkSession.createDataFrame([(paths + i, e, size[f"e{e}"]) for i, e in enumerate(chosen)], f"path int, end {papers.schema['id'].dataType.simpleString()}, size int")
            kept = durable(kept.unionByName(chains.join(F.broadcast(number), "end").select("path", "id", "back", "size")))
            paths += len(chosen)
    return kept.select("path", (F.col("size") - 1 - F.col("back")).alias("position"), "id")


def collaboration(members: DataFrame, group: str, item: str, cap: int | None = 40, evidence: int = 12, limit: int | None = 600) -> DataFrame:
    """(a, b, count, evidence): pairs that meet in a group; the definition of the report takes `cap` members of a group, in order.

    `evidence` are the least group ids, `limit` the strongest pairs; both belong
    to the report. Without `cap` groups are whole, without `limit` all pairs stay.
    """
    if cap is None:
        met = meetings(members, group, item)
    else:
        order = Window.partitionBy(group).orderBy(item)
        kept = members.select(group, item).distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= cap)
        kept = dealt(kept, group)
        a, b = kept.select(group, F.col(item).alias("a")), kept.select(group, F.col(item).alias("b"))
        met = a.join(b, group).filter("a < b")
    pairs = dealt(met, "a")
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("count"))
    shown = pairs
    if limit is not None:
        counted = counted.orderBy(F.col("count").desc(), "a", "b").limit(limit)
        shown = pairs.join(F.broadcast(counted.select("a", "b")), ["a", "b"], "left_semi")
    rank = Window.partitionBy("a", "b").orderBy(group)
    shown = shown.withColumn("_e", F.row_number().over(rank)).filter(F.col("_e") <= evidence)
    lists = shown.groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_list(F.col(group))).cast("array<string>"), ",").alias("evidence"))
    return counted.join(lists, ["a", "b"]).select("a", "b", "count", "evidence")


def partners(members: DataFrame, group: str, item: str) -> DataFrame:
    """(a, b): all pairs that meet in a group, once, without any limit."""
    return dealt(meetings(members, group, item).select("a", "b"), "a", "b").distinct()


def entity_metrics(rows: DataFrame, entity: str, paper: str, year: str, citations: str, topic: str, partners: DataFrame) -> DataFrame:
    """Per entity: papers, citations, partners, topics, first and last year, and a weighted score against the largest."""
    per = rows.groupBy(entity).agg(
        F.countDistinct(paper).alias("papers"), F.sum(citations).alias("citations"), F.countDistinct(topic).alias("topics"), F.min(year).alias("first_year"), F.max(year).alias("last_year")
    )
    near = partners.select(F.explode(F.array(F.struct(F.col("a").alias(entity), F.col("b").alias("o")), F.struct(F.col("b").alias(entity), F.col("a").alias("o")))).alias("p")).select("p.*").groupBy(entity).agg(F.count("*").alias("partners"))
    # read twice below; as a plan all pairs would be made again
    x = durable(per.join(near, entity, "left").fillna(0, ["partners"]))
    top = x.agg(*[F.greatest(F.max(c), F.lit(1)).alias(f"_{c}") for c in COLLABORATION])
    score = sum(w * F.col(c) / F.col(f"_{c}") for c, w in COLLABORATION.items())
    return x.join(F.broadcast(top)).select(entity, "papers", F.round("citations", 2).alias("citations"), "partners", "topics", "first_year", "last_year", F.round(score, 4).alias("score"))


#: What speaks for reading a paper next, and how much (fixed values).
SIGNALS = {"core_score": 0.30, "bridge_score": 0.20, "key_score": 0.20, "growing": 0.10, "recent": 0.06, "context": 0.08, "available": 0.04, "queued": 0.02}
#: Papers recommended at most, and of each stage on a reading path; so many steps at most, or at least if the stages lack them (fixed values).
RECOMMENDED = 24
PATH = {"foundation": 3, "bridge": 3, "frontier": 4}
STEPS, FEW_STEPS, MORE_STEPS = 10, 5, 8


def stages(metrics: DataFrame) -> DataFrame:
    """Each paper's reading stage: foundation, bridge or frontier."""
    core = (F.col("core_score") >= F.greatest(F.lit(0.28), 1.25 * F.col("bridge_score"))) | (F.col("citations_in") >= 2)
    return metrics.withColumn("stage", F.when(core, "foundation").when((F.col("bridge_score") >= 0.12) | (F.coalesce("cross_links", F.lit(0)) > 0), "bridge").otherwise("frontier"))


def recommendations(metrics: DataFrame) -> DataFrame:
    """(id, stage, score, year, place): the 24 papers to read next by eight signals, without archived ones.

    metrics (id, core_score, bridge_score, citations_in, cross_links) with
    key_score, growing (its topic grows), year, context (a favourite or
    compared), available, queued and archived as far as known. A paper is
    recent within two years of the latest. Nulls speak for nothing; ties go to
    the earlier year, then the lesser id.
    """
    given = {c: F.lit(None).cast("int" if c == "year" else "double") for c in (*SIGNALS, "year", "archived", "citations_in", "cross_links") if c not in metrics.columns}
    known = metrics.withColumns(given)
    latest = known.agg(F.coalesce(F.max("year"), F.lit(0)).alias("_latest"))
    recent = (F.col("_latest") > 0) & (F.col("year") >= F.col("_latest") - 2)
    open_ = known.filter(~F.coalesce(F.col("archived").cast("boolean"), F.lit(False))).join(F.broadcast(latest)).withColumn("recent", recent)
    score = sum((w * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in SIGNALS.items()), F.lit(0.0))
    scored = stages(open_.fillna(0.0, ["core_score", "bridge_score"])).withColumn("score", F.round(score, 4))
    order = [F.col("score").desc(), F.coalesce("year", F.lit(9999)), F.col("id")]
    best = scored.orderBy(*order).limit(RECOMMENDED).select("id", "stage", "score", "year")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def reading_path(recommended: DataFrame, citations: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(id, stage, step, transition): foundations by year, bridges, frontiers, ten at most; with less than five of these up to eight of all.

    The transition says how a step goes on from the one before: it cites it, is
    cited by it, has its topic (topics: id, topic), or leaves for another.
    """
    one = Window.partitionBy(F.lit(0))
    stage = F.array_position(F.array(*map(F.lit, PATH)), F.col("stage"))
    within = F.row_number().over(Window.partitionBy("stage").orderBy(F.when(F.col("stage") == "foundation", F.coalesce("year", F.lit(9999))).otherwise(F.col("place")), "place"))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in PATH.items() for x in kv]), F.col("stage"))
    ranked = recommended.withColumn("_k", within).withColumn("_in", F.col("_k") <= quota).withColumn("_n", F.count_if("_in").over(one))
    ranked = ranked.withColumn("_more", F.row_number().over(Window.partitionBy("_in").orderBy("place")))
    chosen = ranked.filter(F.col("_in") | ((F.col("_n") < FEW_STEPS) & (F.col("_more") <= MORE_STEPS - F.col("_n"))))
    order = [F.when(F.col("_in"), 0).otherwise(1), F.when(F.col("_in"), stage), F.when(F.col("_in"), F.col("_k")), F.col("place")]
    steps = chosen.withColumn("step", F.row_number().over(one.orderBy(*order))).filter(F.col("step") <= STEPS)
    steps = steps.join(topics, "id", "left") if topics is not None else steps.withColumn("topic", F.lit(None).cast("string"))
    w = one.orderBy("step")
    steps = durable(steps.withColumn("_before", F.lag("id").over(w)).withColumn("_topic", F.lag("topic").over(w)).select("id", "stage", "step", "topic", "_before", "_topic"))
    known = citations.select("source", "target").distinct()
    ahead = known.join(F.broadcast(steps.select(F.col("id").alias("source"), F.col("_before").alias("target"))), ["source", "target"], "left_semi").select(F.col("source").alias("id"), F.lit(True).alias("_cites"))
    back = known.join(F.broadcast(steps.select(F.col("_before").alias("source"), F.col("id").alias("target"))), ["source", "target"], "left_semi").select(F.col("target").alias("id"), F.lit(True).alias("_cited"))
    told = steps.join(ahead, "id", "left").join(back, "id", "left")
    kind = F.when(F.col("step") == 1, "start").when(F.col("_cites"), "cites_previous").when(F.col("_cited"), "cited_by_previous").when(F.col("topic") == F.col("_topic"), "shared_topic").otherwise("cross_topic")
    return told.select("id", "stage", "step", kind.alias("transition"))


def topic_transitions(rows: DataFrame, by: str, order: list[str], topic: str) -> DataFrame:
    """Rows with the topic before, where it differs, within each series."""
    before = F.lag(topic).over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("from_topic", before).filter(F.col("from_topic").isNotNull() & (F.col("from_topic") != F.col(topic)))


def turning_points(series: DataFrame, topic: str, year: str) -> DataFrame:
    """(topic, year, kind, score): a topic's first year, its peak after growth, and its last decline. series is dense."""
    w = Window.partitionBy(topic).orderBy(year)
    x = series.withColumn("before", F.lag("count").over(w)).withColumn("peak", F.max("count").over(Window.partitionBy(topic))).withColumn("seen", F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    first = x.filter((F.col("count") > 0) & (F.coalesce("seen", F.lit(0)) == 0)).select(topic, year, F.lit("emergence").alias("kind"), F.lit(0.7).alias("score"))
    at = x.filter((F.col("count") == F.col("peak")) & (F.col("count") > F.coalesce("before", F.lit(0))) & (F.col("peak") >= 2))
    grown = at.groupBy(topic).agg(F.min(year).alias(year), F.min(F.least(F.lit(1.0), 0.5 + 0.08 * F.col("peak"))).alias("score")).select(topic, year, F.lit("expansion").alias("kind"), F.round("score", 4).alias("score"))
    fell = x.filter(F.col("count") * 2 <= F.col("before")).groupBy(topic).agg(F.max(year).alias(year)).select(topic, year, F.lit("decline").alias("kind"), F.lit(0.72).alias("score"))
    return first.unionByName(grown).unionByName(fell)
