"""Parent-child links to hierarchies: depth, root and path of every node, all descendants, the nodes on cycles and the links that close them.

Depths and paths follow each node's least parent by pointer jumping, so a chain of n links takes log2(n) rounds. Cycles are sought in what
can hold any: nodes that nothing leads to or from are peeled off, nodes between two links are contracted into one, round by round. The core
that is left is cut into connected components, each co-located as one row and walked depth-first with node colours, which gives the strongly
connected groups and the back links; contracted nodes then get their groups from their neighbours, last round first.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.components import components
from cellweave.session import Stored

#: Links of a component of the core that one task may hold; larger ones are solved by joins, exactly.
MAX_CORE = 500_000


def lineage_links(divisions: DataFrame, cycles: DataFrame) -> DataFrame:
    """(dataset_id, parent, child): mother to daughters of divisions and parent to track of cycles, each link once. Links with a
    NULL or an id below 1 don't count."""
    d = divisions.select("dataset_id", F.col("mother_track_id").alias("parent"), F.explode(F.array("d1_track_id", "d2_track_id")).alias("child"))
    c = cycles.select("dataset_id", F.col("parent_id").alias("parent"), F.col("track_id").alias("child"))
    both = d.union(c).select("dataset_id", F.col("parent").cast("bigint"), F.col("child").cast("bigint"))
    return both.dropna().where("parent >= 1 AND child >= 1").distinct()


def lineage_nodes(divisions: DataFrame, cycles: DataFrame) -> DataFrame:
    """(dataset_id, node): every track that either table names with an id of 1 or more, with links or without."""
    d = divisions.select("dataset_id", F.explode(F.array("mother_track_id", "d1_track_id", "d2_track_id")).alias("node"))
    c = cycles.select("dataset_id", F.explode(F.array("track_id", "parent_id")).alias("node"))
    return d.union(c).select("dataset_id", F.col("node").cast("bigint").alias("node")).dropna().where("node >= 1").distinct()


def _clean(links: DataFrame, part: str, parent: str, child: str) -> DataFrame:
    return links.select(F.col(part).alias("part"), F.col(parent).cast("bigint").alias("parent"), F.col(child).cast("bigint").alias("child")).dropna().distinct()


def _with_parents(e: DataFrame, nodes: DataFrame | None, part: str) -> DataFrame:
    """(part, node, parent): every node once, with its least parent if it has any."""
    least = e.groupBy("part", F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
    every = e.select("part", F.explode(F.array("parent", "child")).alias("node"))
    if nodes is not None:
        every = every.union(nodes.select(F.col(part).alias("part"), F.col("node").cast("bigint")).dropna())
    return every.distinct().join(least, ["part", "node"], "left")


def _jumped(state: Stored, more: dict) -> Stored:
    """The state with each open node's pointer moved to its target's target; more: column to what becomes of it, of _column the target's."""
    s = state.df
    ahead = s.select("part", F.col("node").alias("top"), F.col("top").alias("_top"), F.col("done").alias("_done"), *[F.col(c).alias(f"_{c}") for c in more])
    opened = s.where("NOT done").join(ahead, ["part", "top"])
    rest = [c for c in s.columns if c not in ("top", "done", *more)]
    moved = opened.select(*rest, F.col("_top").alias("top"), *[e.alias(c) for c, e in more.items()], F.col("_done").alias("done"))
    out = Stored(s.where("done").unionByName(moved))
    state.drop()
    return out


def _depths(e: DataFrame, nodes: DataFrame | None, part: str) -> DataFrame:
    first = _with_parents(e, nodes, part).withColumn("top", F.coalesce("parent", "node")).withColumn("done", F.col("parent").isNull())
    state = Stored(first.withColumn("depth", (~F.col("done")).cast("int")))
    opened = state.df.where("NOT done").count()
    while opened:
        state = _jumped(state, {"depth": F.col("depth") + F.col("_depth")})
        before, opened = opened, state.df.where("NOT done").count()
        if opened == before:  # a round in which no node reaches its root: the others run into cycles
            break
    return state.df.select("part", "node", "parent", F.when(F.col("done"), F.col("top")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def depths(links: DataFrame, nodes: DataFrame | None = None, part: str = "dataset_id", parent: str = "parent", child: str = "child") -> DataFrame:
    """(part, node, parent, root, depth) of every node of the links and of nodes(part, node).

    `parent` is the least of a node's parents, `root` and `depth` follow it; both are NULL where that chain runs into a cycle. A node
    without parents is its own root of depth 0. Links with a NULL or twice the same change nothing; empty tables give no rows.
    """
    return _depths(Stored(_clean(links, part, parent, child)).df, nodes, part).withColumnRenamed("part", part)


def paths(links: DataFrame, nodes: DataFrame | None = None, part: str = "dataset_id", parent: str = "parent", child: str = "child") -> DataFrame:
    """`depths` with `path`, the nodes from the root to the node; NULL where there is no root."""
    found = Stored(_depths(Stored(_clean(links, part, parent, child)).df, nodes, part)).df
    return _with_paths(found).withColumnRenamed("part", part)


def _with_paths(found: DataFrame) -> DataFrame:
    rooted = found.where("root IS NOT NULL").withColumn("top", F.coalesce("parent", "node")).withColumn("done", F.col("parent").isNull())
    state = Stored(rooted.withColumn("path", F.array("node")))
    while not state.df.where("NOT done").isEmpty():
        state = _jumped(state, {"path": F.concat("_path", "path")})
    lost = found.where("root IS NULL").withColumn("path", F.lit(None).cast("array<bigint>"))
    return state.df.drop("top", "done").unionByName(lost)


def walk(links: Iterable[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """((node, group) of the nodes on cycles, back links (parent, child)) of one component, without recursion. links: (parent, child,
    the child's parent in the link that this one ends with)."""
    children: dict[int, list[tuple[int, int]]] = {}
    nodes: set[int] = set()
    for p, c, last in sorted(links):
        children.setdefault(p, []).append((c, last))
        nodes.update((p, c))
    # white nodes have no colour; 1 is grey (on the stack), 2 black. A link to a grey node is a back link, low gathers the groups
    colour: dict[int, int] = {}
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    waiting: list[int] = []
    grouped: set[int] = set()
    members: list[tuple[int, int]] = []
    back: list[tuple[int, int]] = []
    for start in sorted(nodes):
        if start in colour:
            continue
        stack = [(start, iter(children.get(start, ())))]
        colour[start], order[start], low[start] = 1, len(order), len(order)
        waiting.append(start)
        while stack:
            node, rest = stack[-1]
            for child, last in rest:
                if child not in colour:
                    colour[child], order[child], low[child] = 1, len(order), len(order)
                    waiting.append(child)
                    stack.append((child, iter(children.get(child, ()))))
                    break
                if colour[child] == 1:
                    back.append((last, child))
                if child not in grouped:
                    low[node] = min(low[node], order[child])
            else:
                stack.pop()
                colour[node] = 2
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(waiting.pop())
                    grouped.update(group)
                    if len(group) > 1:
                        members += [(n, node) for n in group]
    return members, back


def _walk_components(batches):
    for pdf in batches:
        rows: list[tuple] = []
        for part, links in zip(pdf["part"], pdf["links"]):
            members, back = walk((x["u"], x["v"], x["last"]) for x in links)
            rows += [(part, n, g, None, None) for n, g in members]
            rows += [(part, None, None, p, c) for p, c in back]
        out = pd.DataFrame(rows, columns=["part", "node", "cycle", "parent", "child"])
        for c in ("node", "cycle", "parent", "child"):
            out[c] = out[c].astype("Int64")
        yield out


def _by_joins(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of components that are too large for a task: colours spread along the links until they settle, the nodes that lead back to
    their colour's own node are its group, and the rest goes on. Back links are those of a group that lead to a lesser node."""
    left = Stored(edges.select("part", "u", "v").distinct())
    none = left.df.select("part", F.col("u").alias("node"), F.col("v").alias("cycle")).where("false")
    found = none
    while not left.df.isEmpty():
        e = left.df
        colour = Stored(e.select("part", F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("c", F.col("v")))
        mark = None
        while True:
            sent = e.join(colour.df.withColumnRenamed("v", "u"), ["part", "u"]).select("part", "v", "c")
            following = Stored(colour.df.unionByName(sent).groupBy("part", "v").agg(F.min("c").alias("c")))
            now = following.df.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
            colour.drop()
            colour = following
            if now == mark:
                break
            mark = now
        c = colour.df
        inner = Stored(e.join(c.select("part", F.col("v").alias("u"), "c"), ["part", "u"]).join(c.withColumnRenamed("c", "_c"), ["part", "v"]).where("c = _c").drop("_c")).df
        group = Stored(c.where("v = c"))
        size = -1
        while (now := group.df.count()) != size:
            size = now
            more = inner.join(group.df, ["part", "v", "c"]).select("part", F.col("u").alias("v"), "c")
            group = Stored(group.df.unionByName(more).distinct())
        found = found.unionByName(group.df.select("part", F.col("v").alias("node"), F.col("c").alias("cycle")))
        settled = group.df.select("part", "v")
        left = Stored(e.join(settled, ["part", "v"], "left_anti").join(settled.withColumnRenamed("v", "u"), ["part", "u"], "left_anti"))
    sizes = found.groupBy("part", "cycle").count().where("count > 1").drop("count")
    members = Stored(found.join(sizes, ["part", "cycle"], "left_semi").select("part", "node", "cycle")).df
    of = lambda end: members.select("part", F.col("node").alias(end), F.col("cycle").alias(f"_{end}"))
    back = edges.join(of("u"), ["part", "u"]).join(of("v"), ["part", "v"]).where("_u = _v AND u >= v")
    return members, back.select("part", F.col("last").alias("parent"), F.col("v").alias("child"))


def _core(e: DataFrame, max_core: int) -> tuple[DataFrame, DataFrame]:
    """(members, back links) of the links (part, u, v, last) that neither peel nor contract."""
    placed = Stored(e.join(components(e, "part", "u", "v").withColumnRenamed("node", "u"), ["part", "u"])).df
    sizes = placed.groupBy("part", "component").count()
    big = Stored(sizes.where(F.col("count") > max_core).select("part", "component")).df
    some = not big.isEmpty()
    small = placed.join(big, ["part", "component"], "left_anti") if some else placed
    gathered = small.groupBy("part", "component").agg(F.collect_list(F.struct("u", "v", "last")).alias("links"))
    schema = T.StructType([e.schema["part"], *[T.StructField(c, T.LongType()) for c in ("node", "cycle", "parent", "child")]])
    walked = Stored(gathered.select("part", "links").mapInPandas(_walk_components, schema)).df
    members, back = walked.where("node IS NOT NULL").select("part", "node", "cycle"), walked.where("child IS NOT NULL").select("part", "parent", "child")
    if some:
        more, more_back = _by_joins(placed.join(big, ["part", "component"], "left_semi").select("part", "u", "v", "last"))
        members, back = members.unionByName(more), back.unionByName(more_back)
    return members, back


def cycles_of(links: DataFrame, part: str = "dataset_id", parent: str = "parent", child: str = "child", max_core: int = MAX_CORE) -> tuple[DataFrame, DataFrame]:
    """((part, node, cycle), (part, parent, child)): the nodes that are their own ancestors, `cycle` being the least node of those that
    reach each other; and the back links, without which there is no cycle. A link of a node to itself is a cycle. Links with a NULL or
    twice the same change nothing; an empty table gives no rows.
    """
    own = Stored(_clean(links, part, parent, child)).df
    edges = own.where("parent <> child").select("part", F.col("parent").alias("u"), F.col("child").alias("v"), F.col("parent").alias("last"))
    loops = [own.where("parent = child").select("part", F.col("parent").alias("v"), F.col("parent").alias("last"))]
    steps: list[DataFrame] = [loops[0].select("part", F.col("v").alias("node"), F.col("v").alias("before"), F.col("v").alias("after")).where("false")]
    size, shrinks = edges.count(), True
    few = size // 20
    # small enough for one task, whatever its components, and few of all links or no longer shrinking fast: the core is walked
    while size and (size > max_core or shrinks and size > few):
        ends = F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("v").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
        degree = edges.select("part", ends.alias("x")).groupBy("part", "x.n").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i")).where("o > 0 AND i > 0")
        between = (F.col("o") == 1) & (F.col("i") == 1)
        drawn = F.xxhash64("part", "n", F.lit(len(steps))).bitwiseAND(1) == 0
        flags = degree.select("part", "n", between.alias("between"), (between & drawn).alias("pick"))
        of = lambda end: flags.select("part", *[F.col(c).alias(f"{end}{k}") for c, k in (("n", ""), ("between", "_between"), ("pick", "_pick"))])  # noqa: B023, E731
        kept = Stored(edges.join(of("u"), ["part", "u"]).join(of("v"), ["part", "v"]))
        now, chains = kept.df.agg(F.count("*"), F.coalesce(F.bool_or(F.col("u_between")), F.lit(False))).first()
        if now == size and not chains:
            break
        # a picked node whose predecessor isn't goes into the link from its predecessor to its successor
        into = F.col("v_pick") & ~F.col("u_pick")
        entering = kept.df.where(into).select("part", F.col("u").alias("before"), F.col("v").alias("u"))
        onward = kept.df.where(~into)
        contracted = onward.where("u_pick").join(entering, ["part", "u"], "left")
        following = Stored(contracted.select("part", "u", "v", "last", "before").unionByName(onward.where("NOT u_pick").select("part", "u", "v", "last", F.lit(None).cast("bigint").alias("before"))))
        x = following.df
        source = F.coalesce("before", "u")
        steps.append(x.where("before IS NOT NULL").select("part", F.col("u").alias("node"), "before", F.col("v").alias("after")))
        loops.append(x.where(source == F.col("v")).select("part", "v", "last"))
        edges = x.where(source != F.col("v")).select("part", source.alias("u"), "v", "last")
        before, size = size, edges.count()
        shrinks = 3 * size < 2 * before
    back = loops[0].select("part", F.col("last").alias("parent"), F.col("v").alias("child"))
    for x in loops[1:]:
        back = back.unionByName(x.select("part", F.col("last").alias("parent"), F.col("v").alias("child")))
    members = steps[0].select("part", "node", F.col("before").alias("cycle"))
    if size:
        members, more = _core(edges, max_core)
        back = back.unionByName(more)
    for loop, step in zip(reversed(loops), reversed(steps)):
        closed = loop.select("part", F.col("v").alias("node")).distinct().join(members, ["part", "node"], "left_anti")
        members = Stored(members.unionByName(closed.withColumn("cycle", F.col("node")))).df
        of = lambda end: members.select("part", F.col("node").alias(end), F.col("cycle").alias(f"_{end}"))  # noqa: B023, E731
        inside = step.join(of("before"), ["part", "before"]).join(of("after"), ["part", "after"]).where("_before = _after")
        members = members.unionByName(inside.select("part", "node", F.col("_before").alias("cycle")))
    members = Stored(members.distinct()).df
    named = members.groupBy("part", "cycle").agg(F.min("node").alias("least"))
    out = members.join(named, ["part", "cycle"]).select(F.col("part").alias(part), "node", F.col("least").alias("cycle"))
    return out, back.distinct().select(F.col("part").alias(part), "parent", "child")


def descendants(links: DataFrame, wanted: DataFrame | None = None, part: str = "dataset_id", parent: str = "parent", child: str = "child") -> DataFrame:
    """(part, node, descendant): a row for each node reached from `node` over any links, all nodes or those of wanted(part, node). A node is
    its own descendant if it lies on a cycle. As rows, no node's descendants are ever held together.

    Without the back links and all but the least of a node's other parents the links are a forest, whose paths give most pairs; the links
    left out are closed among themselves and then carry the pairs over.
    """
    e = Stored(_clean(links, part, parent, child)).df
    back = Stored(cycles_of(e, "part")[1]).df
    tree = e.join(back, ["part", "parent", "child"], "left_anti").groupBy("part", "child").agg(F.min("parent").alias("parent"))
    tree = Stored(tree.select("part", "parent", "child")).df
    forest = _with_paths(Stored(_depths(tree, e.select("part", F.col("child").alias("node")).union(e.select("part", "parent")).distinct(), "part")).df)
    own = Stored(forest.select("part", F.explode("path").alias("a"), F.col("node").alias("d"))).df
    pairs = own.where("a <> d")
    across = Stored(e.join(tree, ["part", "parent", "child"], "left_anti").select("part", F.col("parent").alias("d"), F.col("child").alias("c"))).df
    if not across.isEmpty():
        reached = Stored(own.join(across, ["part", "d"]).select("part", "a", "c").distinct()).df
        hops = Stored(reached.join(across.select("part", F.col("c").alias("a")).distinct(), ["part", "a"], "left_semi"))
        size = -1
        while (now := hops.df.count()) != size:
            size = now
            longer = hops.df.join(hops.df.select("part", F.col("a").alias("c"), F.col("c").alias("d")), ["part", "c"]).select("part", "a", F.col("d").alias("c"))
            hops = Stored(hops.df.union(longer).distinct())
        further = reached.join(hops.df.select("part", F.col("a").alias("c"), F.col("c").alias("d")), ["part", "c"]).select("part", "a", F.col("d").alias("c"))
        carried = reached.union(further).distinct().join(own.select("part", F.col("a").alias("c"), "d"), ["part", "c"]).select("part", "a", "d")
        pairs = pairs.union(carried).distinct()
    out = pairs.select(F.col("part").alias(part), F.col("a").alias("node"), F.col("d").alias("descendant"))
    return out if wanted is None else out.join(wanted.select(part, F.col("node").cast("bigint").alias("node")).distinct(), [part, "node"], "left_semi")
