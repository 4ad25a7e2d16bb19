import heapq
import random

import pytest

from scholarmill.operators import graph


def plain(edges):
    """Betweenness and closeness by one search from each node."""
    near = {}
    for a, b, w in edges:
        if a != b and w and w > 0:
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + w
            near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0) + w
    n = len(near)
    through, close = dict.fromkeys(near, 0.0), {}
    for s in near:
        dist, done, heap = {}, [], [(0.0, s)]
        best = {s: 0.0}
        while heap:
            d, v = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            done.append(v)
            for w, k in near[v].items():
                if d + 1 / k < best.get(w, 9e99) - 1e-12:
                    best[w] = d + 1 / k
                    heapq.heappush(heap, (best[w], w))
        before = {v: [u for u in near[v] if u in dist and abs(dist[u] + 1 / near[v][u] - dist[v]) <= 1e-12] for v in done}
        paths, owed = {s: 1.0}, dict.fromkeys(done, 0.0)
        for v in done[1:]:
            paths[v] = sum(paths[u] for u in before[v])
        for v in reversed(done[1:]):
            for u in before[v]:
                owed[u] += paths[u] / paths[v] * (1 + owed[v])
            through[v] += owed[v]
        total = sum(dist.values())
        close[s] = (len(done) - 1) / total * (len(done) - 1) / (n - 1) if total else 0.0
    return {v: (through[v] / ((n - 1) * (n - 2) or 1), close[v]) for v in near}


@pytest.mark.parametrize("rows", [200_000_000, 60])
def test_path_centrality_is_that_of_single_searches(spark, rows):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}", rng.choice([1.0, 2.0, 4.0])) for _ in range(26)]
    edges += [("x", "y", 1.0), ("y", "z", 0.5), ("x", "x", 3.0), ("z", "w", 0.0), ("z", "w", None)]
    table = spark.createDataFrame(edges, "source string, target string, weight double").repartition(3)
    got = {r.node: (r.betweenness, r.closeness) for r in graph.path_centrality(table, most_rows=rows).collect()}
    want = plain(edges)
    assert set(got) == set(want)
    for v, (b, c) in want.items():
        assert got[v] == (pytest.approx(b, abs=1e-9), pytest.approx(c, abs=1e-9))
    assert graph.path_centrality(table.limit(0)).count() == 0


@pytest.mark.parametrize("tile, block, rows", [(4, 3, 200_000_000), (5, 2, 150)])
def test_path_centrality_by_tiles_and_blocks(spark, tile, block, rows):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(14):02}", f"n{rng.randrange(14):02}", rng.choice([1.0, 2.0, 4.0])) for _ in range(30)] + [("x", "y", 1.0)]
    got = {r.node: (r.betweenness, r.closeness) for r in graph.path_centrality(spark.createDataFrame(edges, "source string, target string, weight double"), most_rows=rows, tile=tile, block=block).collect()}
    assert got == {v: (pytest.approx(b, abs=1e-9), pytest.approx(c, abs=1e-9)) for v, (b, c) in plain(edges).items()}


def test_path_centrality_of_a_dense_graph(spark, monkeypatch):
    """Every round hands on blocks of sources, not a row for each source and link."""
    most = []
    monkeypatch.setattr(graph, "written", lambda df, name, keep=graph.written: (out := keep(df, name), most.append(out.count()))[0])
    rng = random.Random(3)
    edges = [(f"n{a:03}", f"n{b:03}", float(rng.randint(1, 9))) for a in range(70) for b in range(a)]
    got = {r.node: (r.betweenness, r.closeness) for r in graph.path_centrality(spark.createDataFrame(edges, "source string, target string, weight double")).collect()}
    assert got == {v: (pytest.approx(b, abs=1e-9), pytest.approx(c, abs=1e-9)) for v, (b, c) in plain(edges).items()}
    assert max(most) <= 2 * len(edges)
