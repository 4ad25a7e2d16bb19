"""Graph figures over weighted edges (source, target, weight), each undirected edge given once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written
from .ordered import running


def symmetric(edges: DataFrame) -> DataFrame:
    """(node, other, weight): every edge from both ends."""
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight").unionAll(edges.select("target", "source", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength, centrality): centrality is the degree over the number of other nodes."""
    counted = symmetric(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))
    total = counted.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("node", "degree", "strength", (F.col("degree") / (F.col("total") - 1)).alias("centrality"))  # the total is one row


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by minima over neighbours and pointer doubling.

    Each round contracts the graph to the nodes pointed at, so rounds grow with the logarithm of its size.
    """
    current = written(edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b").distinct(), "edges")
    label = written(symmetric(edges).select("node").distinct().withColumn("component", F.col("node")), "labels")

    def prior(c: str):
        return F.struct(F.xxhash64(c).alias("p"), F.col(c).alias("n"))

    while not current.isEmpty():
        both = current.unionAll(current.select("b", "a"))
        to = both.groupBy("a").agg(F.min(prior("b")).alias("m")).select(F.col("a").alias("u"), F.least("m", prior("a"))["n"].alias("r"))
        to = written(to, "pointers")
        to = written(to.join(to.select(F.col("u").alias("r"), F.col("r").alias("r2")), "r").select("u", F.col("r2").alias("r")), "pointers")
        label = written(label.join(to, F.col("component") == F.col("u"), "left").select("node", F.coalesce("r", "component").alias("component")), "labels")
        moved = current.join(to.select(F.col("u").alias("a"), F.col("r").alias("ra")), "a").join(to.select(F.col("u").alias("b"), F.col("r").alias("rb")), "b")
        current = written(moved.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return label.join(least, "component").select("node", F.col("least").alias("component"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, total weight, density."""
    n = symmetric(edges).agg(F.countDistinct("node").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    return n.crossJoin(e).withColumn("density", F.col("edges") * 2.0 / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0)))  # one row each


#: About so many links at most are in one tile of the matrix of neighbours, and so many nodes on a side of it.
TILE_LINKS, TILE_NODES = 2_000_000, 16_384
#: About so many distances at most are held by one task, of a block of sources to all nodes.
BLOCK_CELLS = 4_000_000
_STATE = "block long, tile long, d binary, x binary, total binary, fresh boolean"


def _take(kind: str, epsilon: float, size: int):
    """One round for a block of sources and a tile of nodes: what comes in along the links from all tiles.

    Matrices have a row for each node of a tile and a column for each source. ``d`` are distances, ``x`` is what a node
    sends on, ``total`` what it has in all. A kind of round: ``far`` brings distances, ``paths`` numbers of shortest paths,
    ``owed`` what nodes owe to those before them.
    """

    def run(key: tuple, ahead: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        table = lambda blob: np.frombuffer(blob).reshape(size, -1)
        own = own.iloc[0]
        here = table(own["d"])
        came = np.full(here.shape, np.inf if kind == "far" else 0.0)
        for row in ahead.itertuples():
            source, target, length = np.frombuffer(row.source, np.int32), np.frombuffer(row.target, np.int32), np.frombuffer(row.length)
            d, x = table(row.d_from), table(row.x_from)
            begins = np.flatnonzero(np.diff(target, prepend=-1))
            step, at = max(1, 2_000_000 // here.shape[1]), 0
            while at < len(begins):  # some links at a time, those of one node together
                to = max(at + 1, int(np.searchsorted(begins, begins[at] + step)))
                first, last = begins[at], begins[to] if to < len(begins) else len(target)
                u, v, k = source[first:last], target[begins[at:to]], begins[at:to] - first
                if kind == "far":
                    came[v] = np.minimum(came[v], np.minimum.reduceat(d[u] + length[first:last, None], k, axis=0))
                else:
                    before, after = (d[u], here[target[first:last]]) if kind == "paths" else (here[target[first:last]], d[u])
                    with np.errstate(invalid="ignore"):
                        shortest = np.abs(before + length[first:last, None] - after) <= epsilon
                    came[v] += np.add.reduceat(np.where(shortest, x[u], 0.0), k, axis=0)
                at = to
        d, x, total = here, here, table(own["total"])
        if kind == "far":
            fresh = came < here - epsilon
            d = x = np.where(fresh, came, here)
        elif kind == "paths":
            fresh, x, total = came > 0, came, total + came
        else:  # total has the numbers of paths in its left half
            paths, owed = np.hsplit(total, 2)
            fresh, x, total = came > 0, came, np.hstack([paths, owed + paths * came])
        return pd.DataFrame({"block": [key[0]], "tile": [key[1]], "d": [d.tobytes()], "x": [x.tobytes()], "total": [total.tobytes()], "fresh": [bool(fresh.any())]})

    return run


def _rounds(state: DataFrame, links: DataFrame, kind: str, epsilon: float, size: int) -> DataFrame:
    """``state`` after rounds of ``kind``, until nothing changes."""
    state = written(state, kind)
    while not state.where("fresh").isEmpty():
        # blocks and tiles are few rows of some MB, which must not go through the driver
        ahead = state.where("fresh").select(F.col("block").alias("of"), F.col("tile").alias("from_tile"), F.col("d").alias("d_from"), F.col("x").alias("x_from")).hint("merge").join(links, ["of", "from_tile"])
        state = written(ahead.groupBy("of", "to_tile").cogroup(state.groupBy("block", "tile")).applyInPandas(_take(kind, epsilon, size), _STATE), kind)
    return state


def path_centrality(edges: DataFrame, epsilon: float = 1e-12, most_rows: int = 200_000_000, tile: int | None = None, block: int | None = None) -> DataFrame:
    """(node, betweenness, closeness) with lengths 1 / weight.

    Betweenness counts the shortest paths through a node, over ordered pairs of others; closeness is scaled by the part
    of the graph that is reached. Sources are taken in passes, so that a pass has about ``most_rows`` pairs of a source and
    a node at most. Within a pass, distances, numbers of paths and what nodes owe to those before them are matrices of a
    ``block`` of sources and a ``tile`` of nodes, and the graph is tiles of links: every round, tiles of nodes that changed
    meet the tiles of links that leave them, and a task works on one block and tile, with numpy. Repeated edges count with
    their weights' sum, self-links and edges without a positive weight are left out; no edges give no rows.
    """
    usable = edges.where("source <> target AND weight > 0").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
    near = symmetric(usable.groupBy("source", "target").agg(F.sum("weight").alias("weight"))).select("node", "other", (1.0 / F.col("weight")).alias("length"))
    near = written(near, "neighbours")
    # by a hash, so that tiles are alike
    names = near.select("node").distinct().select("node", F.xxhash64("node").alias("h"), F.lit(1).cast("long").alias("one"))
    names = written(running(names, ["h", "node"], {"k": "one"}).select("node", (F.col("k") - 1).alias("k")), "nodes")
    n, m = names.count(), near.count()
    if not n:
        return names.select("node", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("closeness"))
    size = tile or min(n, TILE_NODES, max(256, int(n * (TILE_LINKS / m) ** 0.5)))
    width = block or min(-(-n // 8), 128, max(1, BLOCK_CELLS // n))
    numbered = near.join(names.select("node", F.col("k").alias("u")), "node").join(names.select(F.col("node").alias("other"), F.col("k").alias("v")), "other")
    tiles = numbered.select(F.expr(f"u div {size}").alias("from_tile"), F.expr(f"v div {size}").alias("tile"), (F.col("u") % size).cast("int").alias("u"), (F.col("v") % size).cast("int").alias("v"), "length")

    def packed(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values(["v", "u"])
        return pd.DataFrame({"from_tile": [key[0]], "tile": [key[1]], "source": [links["u"].to_numpy(np.int32).tobytes()], "target": [links["v"].to_numpy(np.int32).tobytes()], "length": [links["length"].to_numpy(float).tobytes()]})

    tiles = written(tiles.groupBy("from_tile", "tile").applyInPandas(packed, "from_tile long, tile long, source binary, target binary, length binary"), "links")
    each = max(1, most_rows // n)
    sides = -(-n // size)
    spark, parts = edges.sparkSession, None

    def begun(batches):
        for pdf in batches:
            for b, t, first, last in pdf.itertuples(index=False):
                sources = np.arange(first, last)
                d, ones = np.full((size, len(sources)), np.inf), np.zeros((size, len(sources)))
                mine = sources // size == t
                d[sources[mine] % size, np.flatnonzero(mine)], ones[sources[mine] % size, np.flatnonzero(mine)] = 0.0, 1.0
                yield pd.DataFrame({"block": [b], "tile": [t], "d": [d.tobytes()], "x": [d.tobytes()], "total": [ones.tobytes()], "fresh": [bool(mine.any())]})

    def counting(batches):
        for pdf in batches:
            out = pdf.copy()
            out["x"], out["fresh"] = pdf["total"], [np.frombuffer(x).any() for x in pdf["total"]]
            yield out

    def owing(batches):
        for pdf in batches:
            out = pdf.copy()
            for k, row in enumerate(pdf.itertuples()):
                paths = np.frombuffer(row.total).reshape(size, -1)
                # each node passes one unit to the nodes before it, by their parts of its paths
                out.at[k, "x"] = np.divide(1.0, paths, out=np.zeros(paths.shape), where=paths > 0).tobytes()
                out.at[k, "total"] = np.hstack([paths, np.zeros(paths.shape)]).tobytes()
            out["fresh"] = True
            yield out

    def summed(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                first = row.block * width
                d, (_, owed) = np.frombuffer(row.d).reshape(size, -1), np.hsplit(np.frombuffer(row.total).reshape(size, -1), 2)
                own = np.arange(row.tile * size, row.tile * size + size)[:, None] == np.arange(first, first + d.shape[1])
                through, known = np.where(own, 0.0, owed).sum(axis=1), np.isfinite(d)
                nodes = np.arange(row.tile * size, min(n, row.tile * size + size))
                yield pd.DataFrame({"k": nodes, "through": through[: len(nodes)], "reach": 0, "far": 0.0})
                yield pd.DataFrame({"k": np.arange(first, first + d.shape[1]), "through": 0.0, "reach": known.sum(axis=0), "far": np.where(known, d, 0.0).sum(axis=0)})

    each = -(-each // width) * width if each > width else each
    width = min(width, each)
    each = each // width * width
    for start in range(0, n, each):
        end = min(n, start + each)
        blocks = spark.range(start // width, -(-end // width)).select(F.col("id").alias("block"))
        links = written(blocks.withColumnRenamed("block", "of").crossJoin(tiles).withColumnRenamed("tile", "to_tile").repartition("of", "from_tile"), "block-links")
        cells = blocks.crossJoin(spark.range(sides).select(F.col("id").alias("tile"))).withColumn("first", F.col("block") * width)
        cells = cells.select("block", "tile", "first", F.least(F.col("first") + width, F.lit(end)).alias("last")).repartition("block", "tile")
        state = _rounds(cells.mapInPandas(begun, _STATE), links, "far", epsilon, size)
        state = _rounds(state.mapInPandas(counting, _STATE), links, "paths", epsilon, size)
        state = _rounds(state.mapInPandas(owing, _STATE), links, "owed", epsilon, size)
        part = written(state.mapInPandas(summed, "k long, through double, reach long, far double").groupBy("k").agg(F.sum("through").alias("through"), F.sum("reach").alias("reach"), F.sum("far").alias("far")), "centralities")
        parts = part if parts is None else parts.unionAll(part)
    scale, others = float((n - 1) * (n - 2) or 1), F.col("reach") - 1  # a source reaches itself, too
    close = F.when(F.col("far") > 0, others / F.col("far") * others / F.lit(max(n - 1, 1))).otherwise(0.0)
    found = parts.groupBy("k").agg(F.sum("through").alias("through"), F.sum("reach").alias("reach"), F.sum("far").alias("far"))
    return found.join(names, "k").select("node", (F.col("through") / scale).alias("betweenness"), close.alias("closeness"))


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, community) by weighted label propagation: every round each node takes the label of most weight around it.

    All nodes move at once, in alternating halves (by a hash of the node) so that labels cannot swap for ever; ties go
    to the smallest label. Communities are numbered by size, then by their smallest node, from 1.
    """
    both = written(symmetric(edges).groupBy("node", "other").agg(F.sum("weight").alias("weight")), "graph")
    label = written(both.select("node").distinct().withColumn("label", F.col("node")), "labels")
    still = 0
    for k in range(rounds):
        votes = both.join(label.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("best"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        moved = written(label.join(best, "node").select("node", F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label"), (turn & (F.col("best") != F.col("label"))).alias("changed")), "labels")
        still = 0 if moved.where("changed").limit(1).count() else still + 1
        label = moved.select("node", "label")
        if still > 1:
            break
    size = label.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    ordered = size.select("label", (-F.col("n")).alias("size"), "least", F.lit(1).cast("long").alias("one"))
    numbered = running(ordered, ["size", "least"], {"community": "one"})
    return label.join(numbered.select("label", "community"), "label").select("node", "community")


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: the weighted modularity of a partition (node, community)."""
    both = symmetric(edges).join(groups, "node").join(groups.select(F.col("node").alias("other"), F.col("community").alias("c2")), "other")
    total = both.agg(F.sum("weight").alias("m2"))
    per = both.groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("c2"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("strength"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("strength") / F.col("m2"), 2)).alias("modularity"), F.count("*").alias("communities"))  # the total is one row


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, weight): a maximum spanning forest of edges (a, b, weight), so that the groups of every threshold are in it.

    Ends that edges of at least a weight connect are connected by the forest's edges of at least that weight. Of equal
    weights the smaller ends come first. Every round each tree takes its heaviest edge to another one, trees are
    contracted by pointer doubling, and of the edges between two trees the heaviest stays: joins and minima only, and
    rounds grow with the logarithm of the graph. Self-links, repeats and edges without a weight are no special case.
    """
    usable = edges.where("a <> b AND weight IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("weight").cast("double").alias("weight"))
    heaviest = F.min(F.struct((-F.col("weight")).alias("w"), "a", "b")).alias("e")
    live = written(usable.groupBy(F.col("a").alias("x"), F.col("b").alias("y")).agg(heaviest), "forest-edges")
    taken = None
    while not live.isEmpty():
        ends = live.select(F.col("x").alias("u"), F.col("y").alias("v"), "e").unionAll(live.select("y", "x", "e"))
        best = written(ends.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", F.col("m.v").alias("v"), F.col("m.e").alias("e")), "forest-best")
        chosen = best.select("e").distinct()
        taken = chosen if taken is None else taken.unionAll(chosen)
        # trees point along their edge; of two that point at each other the smaller one is the root
        other = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
        to = best.join(other, "v").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("r"))
        to = written(to, "forest-to")
        while True:
            further = to.select(F.col("u").alias("r"), F.col("r").alias("r2"))
            to = written(to.join(further, "r").select("u", F.col("r2").alias("r"), (F.col("r2") != F.col("r")).alias("moved")), "forest-to")
            if to.where("moved").isEmpty():
                break
            to = to.select("u", "r")
        moved = live.join(to.select(F.col("u").alias("x"), F.col("r").alias("rx")), "x").join(to.select(F.col("u").alias("y"), F.col("r").alias("ry")), "y").where("rx <> ry")
        live = written(moved.groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min("e").alias("e")), "forest-edges")
    if taken is None:
        return usable.limit(0)
    return written(taken.select("e.a", "e.b", (-F.col("e.w")).alias("weight")), "forest")
