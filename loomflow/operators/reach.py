"""Paths and reachability in large graphs without tables of all pairs.

Pointers are doubled: a node that knows where it gets in 2**k steps learns in one
join where it gets in twice as many, so a path of n nodes takes log2(n) rounds.
Rounds are staged.

The reachability index has one row for each node. Strongly connected components
count as one node; what is left has no cycles. Every node but the roots takes one
of its predecessors as parent, and a tour round each tree, ranked as a list, gives
it an interval: what lies in the interval lies below. Other edges are rare in the
graphs of programs; a node knows how many of them begin below it, and only pairs
that neither intervals nor that number decide are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomflow.operators import series, units
from loomflow.operators.graph import owners
from loomflow.stage import Staged

#: Rounds of doubling: lists of 2**62 nodes.
MOST_ROUNDS = 62


def walk(starts: DataFrame, successors: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, depth, node) along (by, node, to) from each (by, node), until there is no successor or a node comes again.

    A node has one successor at most. Small groups are walked in one row each; of
    others, each round adds the nodes that twice as many steps reach; of a node that
    a cycle reaches again, the first visit counts. Numbers of the terms in `by`
    (columns _of_) say where groups are; the result is without them.
    """
    keys = owners(successors, *by)
    successors = Staged(starts.sparkSession, "walk").save(successors.select(*keys, "node", "to").where("node is not null and to is not null"))
    small, large = units.sized(successors, keys, ("node", "to"))
    if not large.count():
        return units.walked(starts, small, keys).select(*by, "start", "depth", "node")
    far = large.select(*keys).distinct()
    near = units.walked(starts.join(far, keys, "left_anti"), small, keys).select(*by, "start", "depth", "node")
    return near.unionByName(_doubled(starts.join(far, keys, "left_semi"), large, by))


def _doubled(starts: DataFrame, successors: DataFrame, by: list[str]) -> DataFrame:
    stage = Staged(starts.sparkSession, "walk", 3.0)
    jump = stage.save(successors.select(*by, "node", "to").where("to is not null"))
    known = stage.save(starts.select(*by, F.col("node").alias("start"), F.lit(0).cast("long").alias("depth"), "node").distinct())
    size, step = known.count(), 1
    for _ in range(MOST_ROUNDS):
        more = known.join(jump, [*by, "node"]).select(*by, "start", (F.col("depth") + step).alias("depth"), F.col("to").alias("node"))
        then = stage.save(known.unionByName(more).groupBy(*by, "start", "node").agg(F.min("depth").alias("depth")).select(*known.columns))
        stage.drop(known)
        known, before, size, step = then, size, then.count(), step * 2
        if size == before:
            return known
        far = jump.select(*by, F.col("node").alias("to"), F.col("to").alias("_far"))
        jump, done = stage.save(jump.join(far, [*by, "to"]).select(*by, "node", F.col("_far").alias("to"))), jump
        stage.drop(done)
    raise RuntimeError("the walks did not end")


def ranked(arcs: DataFrame, sums: list[str]) -> DataFrame:
    """arcs (node, to, sums) of lists: to as the last node of the list, and the sums over the nodes from each up to the last; the last one's to is itself."""
    stage = Staged(arcs.sparkSession, "ranked", 3.0)
    now = stage.save(arcs.select("node", "to", *sums, (F.col("node") == F.col("to")).alias("_end")))
    for _ in range(MOST_ROUNDS):
        open_ = now.where("not _end")
        if open_.isEmpty():
            return now.drop("_end")
        far = now.select(F.col("node").alias("to"), F.col("to").alias("_far"), F.col("_end").alias("_last"), *[F.col(c).alias(f"_{c}") for c in sums])
        # where the next node is the last, its sums are added and the list ends
        moved = open_.join(far, "to").select("node", F.col("_far").alias("to"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums], F.col("_last").alias("_end"))
        then = stage.save(now.where("_end").unionByName(moved))
        stage.drop(now)
        now = then
    raise RuntimeError("the lists do not end")


def _chains(edges: DataFrame, stage: Staged) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core edges (a, b), chain nodes (node, a, b) between them, (node, scc) of cycles of chain nodes only)."""
    inner = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    inner = stage.save(inner.join(edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node"), "node"))
    ends = []
    for a, b in (("a", "b"), ("b", "a")):
        # forward to the core node behind a chain, then backward to the one before it; the least node met tells a cycle's
        now = stage.save(inner.join(edges.select(F.col(a).alias("node"), F.col(b).alias("to")), "node").withColumn("least", F.least("node", "to")))
        seen = -1
        for _ in range(MOST_ROUNDS):
            inside = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
            # chain nodes that still point at chain nodes; in a cycle that never ends, so the least is settled when nothing changes
            then = stage.save(now.join(inside, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), F.least("least", "_least").alias("least")))
            stage.drop(now)
            now = then
            mark = now.join(inner.withColumnRenamed("node", "to"), "to", "left_semi").agg(F.count("*"), F.sum(F.xxhash64("node", "least").cast("decimal(38,0)"))).first()
            if mark[0] == 0 or mark == seen:
                break
            seen = mark
        ends.append(now)
    forward, backward = ends
    cyclic = forward.join(inner.withColumnRenamed("node", "to"), "to", "left_semi").select("node", F.col("least").alias("scc"))
    between = forward.select("node", F.col("to").alias("b")).join(backward.select("node", F.col("to").alias("a")), "node").join(cyclic, "node", "left_anti")
    between = stage.save(between.select("node", "a", "b"))
    plain = edges.join(inner.withColumnRenamed("node", "a"), "a", "left_anti").join(inner.withColumnRenamed("node", "b"), "b", "left_anti")
    core = stage.save(plain.select("a", "b").union(between.select("a", "b")).distinct())
    return core, between, stage.save(cyclic)


def _spread(values: DataFrame, edges: DataFrame, stage: Staged) -> DataFrame:
    """(node, value): the greatest value of the nodes from which edges (a, b) lead there, its own included."""
    while True:
        given = edges.join(values.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "value")
        then = stage.save(values.unionByName(given).groupBy("node").agg(F.max("value").alias("value")))
        changed = not then.exceptAll(values).isEmpty()
        stage.drop(values)
        values = then
        if not changed:
            return values


def components(edges: DataFrame) -> DataFrame:
    """(node, scc): the least node of the strongly connected component of every node of the edges (a, b).

    Chains are contracted. Of the rest, nodes without edges in or out are alone.
    What then remains takes colours, the greatest node that reaches each; who
    reaches the colour's own node in its colour is of its component. Rounds follow
    the number of branchings on a path, not its length.
    """
    stage = Staged(edges.sparkSession, "components", 3.0)
    nodes = stage.save(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    edges = stage.save(edges.select("a", "b").where("a <> b").distinct())
    core, between, found = _chains(edges, stage)
    now = stage.save(core.where("a <> b"))
    told = found.select("node", "scc")
    while True:
        size = now.count()
        while size:
            trimmed = stage.save(now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            size, before = trimmed.count(), size
            stage.drop(now)
            now = trimmed
            if size == before:
                break
        if not size:
            break
        own = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
        colour = _spread(stage.save(own.select("node", F.col("node").alias("value"))), now, stage)
        of_a, of_b = colour.select(F.col("node").alias("a"), F.col("value").alias("_a")), colour.select(F.col("node").alias("b"), F.col("value").alias("_b"))
        inside = stage.save(now.join(of_a, "a").join(of_b, "b").where("_a = _b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        # backward, from the colour's own node
        flags = stage.save(colour.select("node", (F.col("node") == F.col("value")).cast("int").alias("value")))
        member = _spread(flags, inside, stage).where("value = 1").join(colour.withColumnRenamed("value", "_c"), "node").select("node", "_c")
        least = stage.save(member.join(member.groupBy("_c").agg(F.min("node").alias("scc")), "_c").select("node", "scc"))
        told = told.unionByName(least)
        gone = least.select("node")
        then = stage.save(now.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"))
        stage.drop(now)
        now = then
    told = stage.save(told)
    # a chain between two nodes of one component is of it; so is one that leads back to its own node
    of = told.select(F.col("node").alias("a"), "scc")
    chained = between.join(of, "a", "left").join(told.select(F.col("node").alias("b"), F.col("scc").alias("_b")), "b", "left")
    chained = chained.where((F.col("a") == F.col("b")) | (F.col("scc") == F.col("_b"))).select("node", F.coalesce("scc", "a").alias("scc"))
    grouped = told.unionByName(chained)
    every = nodes.join(grouped, "node", "left").select("node", F.coalesce("scc", "node").alias("scc"))
    # the least node of a component may lie on a chain
    least = every.groupBy("scc").agg(F.min("node").alias("least"))
    return stage.save(every.join(least, "scc").select("node", F.col("least").alias("scc")))


def index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, links) of edges (a, b); nulls are no nodes.

    The index has a row (node, scc, cyclic, tree, top, floor, more) for each node:
    of two nodes of one tree, the second lies below the first if its top is in
    (floor, top] of the first; more is the number of links that begin below.
    Links (a, b) are the edges between components.
    """
    stage = Staged(edges.sparkSession, "reach", 3.0)
    edges = stage.save(edges.select("a", "b").where("a is not null and b is not null").distinct())
    scc = components(edges)
    loops = edges.where("a = b").select(F.col("a").alias("node")).join(scc, "node").select("scc").union(scc.groupBy("scc").agg(F.count("*").alias("n")).where("n > 1").select("scc")).distinct()
    links = edges.join(scc.select(F.col("node").alias("a"), F.col("scc").alias("x")), "a").join(scc.select(F.col("node").alias("b"), F.col("scc").alias("y")), "b")
    links = stage.save(links.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    parent = stage.save(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
    others = links.join(parent, (links["b"] == parent["node"]) & (links["a"] == parent["parent"]), "left_anti")
    extra = others.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("more"))
    # brothers in a row, however many a parent has
    placed = stage.save(series.numbered(parent, ["parent"], ["node"], "_i"))
    brother = placed.select("parent", (F.col("_i") - 1).alias("_i"), F.col("node").alias("brother"))
    eldest = placed.where("_i = 0").select(F.col("parent").alias("node"), F.col("node").alias("child"))
    tree = scc.select(F.col("scc").alias("node")).distinct().join(placed.join(brother, ["parent", "_i"], "left").select("node", "parent", "brother"), "node", "left").join(eldest, "node", "left").join(extra, "node", "left")
    tree = stage.save(tree)
    down, up = (lambda c: F.struct(F.col(c).alias("v"), F.lit(0).alias("u"))), (lambda c: F.struct(F.col(c).alias("v"), F.lit(1).alias("u")))
    some = lambda c, kind: F.when(F.col(c).isNotNull(), kind(c))
    arcs = tree.select(down("node").alias("node"), F.coalesce(some("child", down), up("node")).alias("to"), F.lit(1).cast("long").alias("n"), F.coalesce("more", F.lit(0)).cast("long").alias("m"))
    arcs = arcs.unionByName(tree.select(up("node").alias("node"), F.coalesce(some("brother", down), some("parent", up), up("node")).alias("to"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m")))
    rank = ranked(arcs, ["n", "m"])
    begin = rank.where("node.u = 0").select(F.col("node.v").alias("scc"), F.col("to.v").alias("tree"), F.col("n").alias("top"), F.col("m").alias("_m"))
    end = rank.where("node.u = 1").select(F.col("node.v").alias("scc"), F.col("n").alias("floor"), F.col("m").alias("_after"))
    label = begin.join(end, "scc").join(loops.withColumn("cyclic", F.lit(True)), "scc", "left").select("scc", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "tree", "top", "floor", (F.col("_m") - F.col("_after")).alias("more"))
    return stage.save(scc.join(label, "scc").select("node", "scc", "cyclic", "tree", "top", "floor", "more")), links


def _below(upper: str, lower: str) -> Column:
    """Whether the lower one's place is in the upper one's interval."""
    return (F.col(f"{upper}_tree") == F.col(f"{lower}_tree")) & (F.col(f"{lower}_top") <= F.col(f"{upper}_top")) & (F.col(f"{lower}_top") > F.col(f"{upper}_floor"))


def reached(pairs: DataFrame, index: DataFrame, links: DataFrame) -> DataFrame:
    """pairs (a, b) with `reached`: whether one edge or more lead from a to b.

    Both ends meet their labels; most pairs are decided there. The others search
    along links, from a down, through nodes below which links begin that are no
    tree's, each node of a pair once. Ends that are no nodes reach nothing, and a
    node reaches itself if it lies on a cycle.
    """
    stage = Staged(pairs.sparkSession, "reached", 3.0)
    columns = ("scc", "cyclic", "tree", "top", "floor", "more")
    of = lambda side: index.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    met = pairs.select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left")
    same = F.col("a_scc") == F.col("b_scc")
    sure = F.when(F.col("a_scc").isNull() | F.col("b_scc").isNull(), False).when(same, F.col("a_cyclic")).when(_below("a", "b"), True).when(F.col("a_more") == 0, False)
    met = stage.save(met.withColumn("reached", sure))
    labels = index.where("node = scc").select("node", *columns[2:])
    frontier = stage.save(met.where("reached is null").select("a", "b", F.col("a_scc").alias("node"), F.col("b_tree"), F.col("b_top")))
    seen, hits = frontier, met.where("reached").select("a", "b")
    while not frontier.isEmpty():
        near = frontier.join(links.select(F.col("a").alias("node"), F.col("b").alias("to")), "node").select("a", "b", F.col("to").alias("node"), "b_tree", "b_top").distinct()
        near = near.join(seen.select("a", "b", "node"), ["a", "b", "node"], "left_anti").join(labels, "node")
        near = stage.save(near.withColumn("_hit", (F.col("b_tree") == F.col("tree")) & (F.col("b_top") <= F.col("top")) & (F.col("b_top") > F.col("floor"))))
        found = near.where("_hit").select("a", "b").distinct()
        hits = hits.unionByName(found)
        frontier = stage.save(near.where("not _hit and more > 0").join(found, ["a", "b"], "left_anti").select(*seen.columns))
        seen = seen.unionByName(frontier)
    hits = hits.distinct().withColumn("_hit", F.lit(True))
    told = met.select("a", "b", "reached").join(hits, ["a", "b"], "left").select("a", "b", F.coalesce("reached", "_hit", F.lit(False)).alias("reached"))
    return pairs.join(told, ["a", "b"])


def told(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) with `reached`, of edges (a, b); both tell the numbers of their terms, _of_a and _of_b.

    Where no edge leads from one number to another, small groups of one number are
    closed at once and meet the pairs where they are. Other groups are indexed; if
    edges lead from one number to another, so are all.
    """
    edges = Staged(edges.sparkSession, "told").save(edges.select("_of_a", "_of_b", "a", "b").where("a is not null and b is not null"))
    inner = F.when(F.col("_of_a") == F.col("_of_b"), F.col("_of_a"))
    small, large = units.sized(edges.select("_of_a", "a", "b", inner.alias("_inner")), ["_of_a"], ("a", "_inner"))
    n, crossing = large.agg(F.count("*"), F.count_if(F.col("_inner").isNull())).first()
    if crossing:
        return reached(pairs.select("a", "b").distinct(), *index(edges.select("a", "b")))
    hits = units.closed(small, "a", "b", ["_of_a"]).select("_of_a", "a", "b", F.lit(True).alias("_hit"))
    out = pairs.select("_of_a", "a", "b").join(hits, ["_of_a", "a", "b"], "left").select("_of_a", "a", "b", F.coalesce("_hit", F.lit(False)).alias("reached")).distinct()
    if not n:
        return out.select("a", "b", "reached")
    far = reached(out.select("a", "b").distinct(), *index(large.select("a", "b"))).withColumnRenamed("reached", "_far")
    return out.join(far, ["a", "b"]).select("a", "b", (F.col("reached") | F.col("_far")).alias("reached"))
