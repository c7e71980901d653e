"""Graph routines over edges (src, dst[, w]): components, reachability, levels, shortest paths, spanning trees, colouring, dominators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import cut

#: Parts into which a hub's neighbours are dealt.
SALTS = 16
#: A hub has more neighbours than this, and than this share of all edges, so that there are at most 2 / HUB_SHARE hubs.
HUB_LEAST, HUB_SHARE = 1000, 1e-4
#: Edges of the small components that are walked together.
PART_EDGES = 20_000


def with_least(rows: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) with m, the least of u and all its v, and the work table that they are joined with, by merge so that the driver holds none of it. Only hubs are salted."""
    limit = max(HUB_LEAST, int(n_edges * HUB_SHARE))
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    least = cut(least.select("u", F.least("u", "m").alias("m"), (F.col("d") > limit).alias("hub")))
    if least.where("hub").isEmpty():
        return rows.join(least.select("u", "m").hint("merge"), "u"), least
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    hubs = F.broadcast(least.where("hub").select(F.col("u").alias("h")))  # at most 2 / HUB_SHARE rows
    salt = F.when(F.col("h").isNotNull(), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(hubs, F.col("u") == F.col("h"), "left").select("u", "v", salt.alias("s"))
    return dealt.join(least.select("u", "m", F.explode(F.when(F.col("hub"), salts).otherwise(F.array(F.lit(0)))).alias("s")).hint("merge"), ["u", "s"]), least


def star_components(edges: DataFrame) -> DataFrame:
    """node and root, its smallest node, for the connected components of edges (u, v); nodes without an edge are absent.

    Large-star and small-star rounds in turn until no edge changes, which is
    certain to come. Every half of a round is written, so that no plan grows
    beyond one join, which the driver must plan anew with each of its stages,
    and what came before is removed.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    before = n = None
    while True:
        n = e.count() if n is None else n
        both, least = with_least(e.select("u", "v").union(e.select("v", "u")), n)
        large = cut(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), e, least)
        ends = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        small, least = with_least(large, n)
        e = cut(small.select(ends).select("x.*").where("u != v").distinct(), large, least)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before, n = now, now[0]


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node and component, the smallest node it is connected with. Nodes without edges are their own component."""
    everyone = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    if nodes is not None:
        everyone = everyone.union(nodes.select(nodes.columns[0]))
    root = star_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("node", "n")
    return everyone.distinct().join(root, F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("component"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node and hops: everything that can be reached from the start nodes, by the fewest edges; a round for each hop."""
    seen = cut(start.select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("hops")).distinct())
    front, hop = seen, 0
    while True:
        hop += 1
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hops")), front if hop > 1 else None)
        if front.isEmpty():
            return seen
        seen = cut(seen.union(front), seen)


def kahn_levels(edges: DataFrame) -> DataFrame:
    """node and level: nodes without outgoing edges are level 0 and are removed, and so on; nodes on or before a cycle have a null level."""
    left = cut(edges.select("src", "dst").distinct())
    nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done, level = None, 0
    while True:
        free = nodes.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        free = cut(free.select("node", F.lit(level).alias("level")))
        if free.isEmpty():
            rest = nodes.select("node", F.lit(None).cast("int").alias("level"))
            return rest if done is None else done.union(rest)
        done = free if done is None else cut(done.union(free), done if level > 1 else None)
        nodes = cut(nodes.join(free, "node", "left_anti"), nodes)
        left = cut(left.join(free, left.dst == free.node, "left_anti"), left)
        if nodes.isEmpty():
            return done
        level += 1


def shortest_paths(edges: DataFrame, source) -> DataFrame:
    """node, dist, prev: least total weight from a source; a negative cycle within reach is an error.

    Only nodes whose distance fell send it on in the next round; without a
    negative cycle there are at most as many rounds as nodes.
    """
    kind = edges.schema["src"].dataType
    one = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast(kind).alias("prev"))
    best = cut(one)
    front, rounds, most = best, 0, None
    while True:
        sent = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("prev"))
        offer = sent.groupBy("node").agg(F.min(F.struct("dist", "prev")).alias("o")).select("node", "o.dist", "o.prev")
        better = offer.alias("o").join(best.select(F.col("node").alias("n"), F.col("dist").alias("d")), F.col("node") == F.col("n"), "left").where(F.col("d").isNull() | (F.col("dist") < F.col("d"))).select("node", "dist", "prev")
        front = cut(better, front if rounds else None)
        if front.isEmpty():
            return best
        best = cut(best.join(front.select("node"), "node", "left_anti").unionByName(front), best)
        rounds += 1
        if rounds % 100 == 0:
            most = edges.select(F.explode(F.array("src", "dst"))).distinct().count() if most is None else most
            if rounds > most:
                raise ValueError("a negative cycle is within reach")


def _roots(pick: DataFrame) -> DataFrame:
    """c and root, where the picks (c, o) lead: by pointer jumping, each round doubles the way.

    The picks of a component end in two nodes that chose each other; the smaller is the root.
    """
    other = pick.select(F.col("c").alias("c2"), F.col("o").alias("o2"))
    to = pick.join(other, F.col("o") == F.col("c2")).select("c", F.when((F.col("o2") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("root"))
    to = cut(to)
    while True:
        next_ = to.select(F.col("c").alias("root"), F.col("root").alias("further"))
        to = cut(to.join(next_, "root").select("c", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")), to)
        if to.where("moved").isEmpty():
            return to.select("c", "root")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, w of a forest of least total weight, with src < dst.

    Every node picks its least edge by (w, src, dst), the picked edges are
    contracted, and of parallel edges the least stays. Nodes halve at least in
    each round, so it ends after a logarithm of their number.
    """
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w").where("src != dst")
    e = cut(e.groupBy("src", "dst").agg(F.min("w").alias("w")).select(F.col("src").alias("a"), F.col("dst").alias("b"), "w", "src", "dst"))
    tree = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("c"), F.col("b").alias("o"), "w", "src", "dst").union(e.select("b", "a", "w", "src", "dst"))
        pick = cut(both.groupBy("c").agg(F.min(F.struct("w", "src", "dst", "o")).alias("p")).select("c", "p.*"))
        chosen = pick.select("src", "dst", "w").distinct()
        tree = cut(chosen if tree is None else tree.union(chosen), tree)
        root = _roots(pick.select("c", "o"))
        x, y = root.toDF("a", "ra"), root.toDF("b", "rb")
        moved = e.join(x, "a").join(y, "b").where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "w", "src", "dst")
        e = cut(moved.groupBy("a", "b").agg(F.min(F.struct("w", "src", "dst")).alias("m")).select("a", "b", "m.*"), e, pick)
    return tree if tree is not None else e.select("src", "dst", "w")


def _per_component(edges: DataFrame, f, schema: str) -> DataFrame:
    """Run f on the edges of whole components, about PART_EDGES edges at once; a component must fit one task."""
    comp = cut(connected_components(edges).select(F.col("node").alias("src"), "component"))
    parts = edges.count() // PART_EDGES + 1
    part = F.pmod(F.xxhash64("component"), F.lit(parts)).alias("__part")
    return edges.join(comp.hint("merge"), "src").select("src", "dst", part).groupBy("__part").applyInPandas(f, schema)


def colour(edges: DataFrame) -> DataFrame:
    """node and colour: greedy colouring, breadth first from the smallest node of each component."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf.src, pdf.dst, strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        got: dict = {}
        for root in sorted(near):
            queue = [root] if root not in got else []
            for n in queue:
                if n in got:
                    continue
                used = {got[x] for x in near[n] if x in got and x != n}
                got[n] = next(c for c in range(len(used) + 1) if c not in used)
                queue += sorted(x for x in near[n] if x not in got)
        return pd.DataFrame({"node": list(got), "colour": list(got.values())})

    kind = edges.schema["src"].dataType.simpleString()
    return _per_component(edges, run, f"node {kind}, colour int")


def postorder(edges: DataFrame, root) -> DataFrame:
    """node and position in a depth-first post-order from root, children by value; the part that root reaches must fit one task."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in sorted(zip(pdf.src, pdf.dst, strict=True)):
            near.setdefault(a, []).append(b)
        order, seen, stack = [], {root}, [(root, iter(near.get(root, [])))]
        while stack:
            n, it = stack[-1]
            for x in it:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(near.get(x, []))))
                    break
            else:
                order.append(n)
                stack.pop()
        return pd.DataFrame({"node": order, "position": range(len(order))})

    kind = edges.schema["src"].dataType.simpleString()
    return reached_edges(edges, root).withColumn("__g", F.lit(1)).groupBy("__g").applyInPandas(run, f"node {kind}, position long")


def reached_edges(edges: DataFrame, root) -> DataFrame:
    start = edges.sparkSession.range(1).select(F.lit(root).cast(edges.schema["src"].dataType).alias("node"))
    return edges.join(reachable(edges, start).select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")


def dominators(edges: DataFrame, root) -> DataFrame:
    """node and idom, its immediate dominator, for what root reaches, which must fit one task; root's is null."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        succ: dict = {}
        pred: dict = {}
        for a, b in sorted(zip(pdf.src, pdf.dst, strict=True)):
            succ.setdefault(a, []).append(b)
            pred.setdefault(b, []).append(a)
        post, seen, stack = [], {root}, [(root, iter(succ.get(root, [])))]
        while stack:
            n, it = stack[-1]
            for x in it:
                if x not in seen:
                    seen.add(x)
                    stack.append((x, iter(succ.get(x, []))))
                    break
            else:
                post.append(n)
                stack.pop()
        number = {n: i for i, n in enumerate(post)}
        idom = {root: root}
        changed = True
        while changed:
            changed = False
            for n in reversed(post[:-1]):
                new = None
                for p in pred[n]:
                    if p in idom:
                        if new is None:
                            new = p
                        else:
                            a, b = p, new
                            while a != b:
                                while number[a] < number[b]:
                                    a = idom[a]
                                while number[b] < number[a]:
                                    b = idom[b]
                            new = a
                if idom.get(n) != new:
                    idom[n], changed = new, True
        return pd.DataFrame({"node": post, "idom": [None if n == root else idom[n] for n in post]}).astype({"idom": "Int64"} if pdf.src.dtype.kind == "i" else {})

    kind = edges.schema["src"].dataType.simpleString()
    return reached_edges(edges, root).withColumn("__g", F.lit(1)).groupBy("__g").applyInPandas(run, f"node {kind}, idom {kind}")


def all_pairs(edges: DataFrame) -> DataFrame:
    """src, dst, dist, hop: least distances between all connected pairs by repeated doubling of path lengths; hop is the node before dst.

    For small graphs: the result has a row for each connected pair. A negative cycle is an error.
    """
    best = cut(edges.where("src != dst").groupBy("src", "dst").agg(F.min("w").alias("dist")).withColumn("hop", F.col("src")))
    before, left = None, 2 + best.select(F.explode(F.array("src", "dst"))).distinct().count().bit_length()
    while True:
        a, b = best.alias("a"), best.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).where("a.src != b.dst").select("a.src", "b.dst", (F.col("a.dist") + F.col("b.dist")).alias("dist"), F.col("b.hop").alias("hop"))
        best = cut(best.unionByName(longer).groupBy("src", "dst").agg(F.min(F.struct("dist", "hop")).alias("m")).select("src", "dst", "m.dist", "m.hop"), best)
        now = best.agg(F.count("*"), F.sum("dist")).first()
        if now == before:
            return best
        before, left = now, left - 1
        if not left:
            raise ValueError("a negative cycle")
