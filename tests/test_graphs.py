"""Known answers on small graphs, and invariants of the seeded methods."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import registry
from graphloom.graph import Graph
from graphloom.operators import centrality, community, generators, layered_sphere, layout_force, layout_geometric, paths, spatial, structure, style


def scores(df, column="score"):
    return {r["id"]: r[column] for r in df.collect()}


def pairs(graph):
    return {tuple(sorted((r["src"], r["dst"]))) for r in graph.edges.collect()}


def cliques(spark, k=5):
    e = [(a + s, b + s) for s in (0, k) for a in range(k) for b in range(a + 1, k)] + [(k - 1, k)]
    return Graph(spark.range(2 * k), spark.createDataFrame(e, "src long, dst long"))


def test_ring(spark):
    g = generators.ring(spark)
    assert set(scores(centrality.degree(g)).values()) == {2.0}
    assert paths.diameter(g).first()[0] == 10
    assert paths.average_path_length(g).first()[0] == pytest.approx(100 / 19)
    assert set(round(x, 6) for x in scores(centrality.pagerank(g)).values()) == {0.05}


def test_star(spark):
    g = generators.star(spark)
    assert scores(centrality.degree(g))[0] == 10
    b = scores(paths.betweenness(g))
    assert b[0] == pytest.approx(1) and b[3] == 0
    assert paths.radius(g).first()[0] == 1


def test_full(spark):
    g = generators.full(spark)
    assert structure.density(g).first()[0] == 1 and structure.transitivity(g).first()[0] == 1
    assert set(scores(structure.coreness(g), "coreness").values()) == {9}


def test_lattice(spark):
    g = generators.lattice(spark)
    assert g.edges.count() == 40 and structure.is_bipartite(g).first()[0]
    assert paths.diameter(g).first()[0] == 8
    assert math.isnan(structure.transitivity(generators.star(spark, 2)).first()[0])


def test_zachary(spark):
    g = generators.famous(spark)
    d = scores(centrality.degree(g))
    assert (d[0], d[32], d[33]) == (16, 12, 17) and structure.triangles(g).count() == 45
    assert structure.transitivity(g).first()[0] == pytest.approx(0.2557, abs=1e-4)
    assert paths.average_path_length(g).first()[0] == pytest.approx(2.4082, abs=1e-4)
    assert not structure.is_bipartite(g).first()[0]


def test_cuts_against_removal(spark):
    g = generators.gnp(spark, 24, 0.1, 3)
    e = pairs(g)

    def parts(edges, gone=None):
        left = {v: v for v in range(24) if v != gone}
        find = lambda v: v if left[v] == v else find(left[v])
        for a, b in edges:
            if gone not in (a, b):
                left[find(a)] = find(b)
        return sum(find(v) == v for v in left)

    lone = {v for v in range(24) if not any(v in x for x in e)}
    want = {v for v in range(24) if v not in lone and parts(e, v) > parts(e)}
    assert {r["id"] for r in structure.articulation_points(g).collect()} == want
    assert {(r["src"], r["dst"]) for r in structure.bridges(g).collect()} == {x for x in e if parts(e - {x}) > parts(e)}


def test_filters(spark):
    g = generators.kary_tree(spark)
    kept = structure.filter_degree(g, 3)
    assert kept.vertices.count() == 6 and {r["id"] for r in kept.vertices.collect()} == set(range(6))
    core = structure.filter_coreness(cliques(spark), 4)
    assert core.vertices.count() == 10 and {r["glow"] for r in core.vertices.collect()} == {1.0}


def test_scores_without_range(spark):
    s = spark.createDataFrame([(0, float("nan")), (1, float("nan"))], "id long, score double")
    assert {r["size"] for r in centrality.apply_centrality(s).collect()} == {2.0}
    assert math.isnan(scores(paths.closeness(generators.ring(spark, 5), cutoff=0))[0])


def test_dangling_pagerank(spark):
    g = Graph(spark.range(3), spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long"), True)
    p = scores(centrality.pagerank(g))
    assert sum(p.values()) == pytest.approx(1) and p[1] == pytest.approx(p[2])


def test_eigenvector_and_hits(spark):
    for g in (generators.lattice(spark, 3, 3), generators.star(spark)):
        x = scores(centrality.eigenvector(g))
        assert max(x.values()) == pytest.approx(1) and min(x.values()) >= 0


def test_random_generators(spark):
    assert generators.watts_strogatz(spark).edges.count() == 40 and len(pairs(generators.watts_strogatz(spark))) == 40
    t = generators.random_tree(spark)
    assert t.edges.count() == 19 and structure.connected_components(t).select("component").distinct().count() == 1
    d = scores(centrality.degree(generators.degree_sequence(spark)))
    assert set(d.values()) == {4.0}
    assert all(a < 8 <= b for a, b in pairs(generators.bipartite_gnm(spark))) and generators.bipartite_gnm(spark).edges.count() == 15
    g = generators.barabasi(spark)
    assert structure.connected_components(g).select("component").distinct().count() == 1
    assert generators.forest_fire(spark).vertices.count() == 50
    with pytest.raises(ValueError):
        generators.bipartite_projection(generators.cycle(spark, 5))


@pytest.mark.parametrize("method", [m for m in community.METHODS])
def test_communities_split_cliques(spark, method):
    g = cliques(spark)
    got = scores(community.detect(g, method), "community")
    assert len(got) == 10 and min(got.values()) == 0
    if method != "spinglass":
        assert len({got[v] for v in range(5)}) == 1 and len({got[v] for v in range(5, 10)}) == 1
    m = spark.createDataFrame(list(got.items()), "id long, community long")
    assert community.modularity(g, m).first()[0] >= -1e-9


def test_optimal_is_best(spark):
    g = generators.lattice(spark, 4, 3)
    value = lambda m: community.modularity(g, m).first()[0]
    best = value(community.detect(g, "optimal_modularity"))
    assert all(value(community.detect(g, m)) <= best + 1e-9 for m in ("louvain", "fast_greedy", "walktrap", "leading_eigenvector"))


def test_distributed_communities(spark):
    g = cliques(spark)
    got = scores(community.label_propagation(g), "community")
    assert len({got[v] for v in range(5)}) == 1
    f = scores(community.fluid(g, 2), "community")
    assert set(f.values()) <= {0, 1} and len(f) == 10


@pytest.mark.parametrize("kind", list(layout_force.SOLVERS))
def test_layouts(spark, kind):
    g = generators.lattice(spark, 4, 3)
    rows = layout_force.layout(g, kind).collect()
    assert sorted(r["id"] for r in rows) == list(range(12))
    assert all(math.isfinite(r[c]) for r in rows for c in "xyz")
    assert kind.endswith("3d") or kind == "openord" or all(r["z"] == 0 for r in rows)


def test_layouts_of_tiny_graphs():
    for n in (1, 2):
        e = np.array([[0, 1]])[: n - 1].reshape(-1, 2)
        for kind, f in layout_force.SOLVERS.items():
            assert f(n, e, seed=1).shape[0] == n, kind


def test_mds_reproduces_a_path(spark):
    p = layout_force.mds(6, np.array([(k, k + 1) for k in range(5)]), 2)
    assert np.allclose(np.abs(p[:, None] - p[None]).max(-1), np.abs(np.arange(6)[:, None] - np.arange(6)[None]))


def test_layered_sphere(spark):
    rows = layered_sphere.layout(generators.famous(spark), intra_sweeps=2, inter_sweeps=2).collect()
    assert len(rows) == 34 and max(Counter((round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) for r in rows).values()) == 1
    radius = {}
    for r in rows:
        radius.setdefault(r["sphere"], set()).add(round(math.dist((0, 0, 0), (r["x"], r["y"], r["z"])), 6))
    assert all(len(x) == 1 for x in radius.values())


def test_compact_arrangement_keeps_cells_apart(spark):
    g = generators.famous(spark)
    rows = community.arrange_compact(g, layout_geometric.circle(g.vertices), g.vertices.select("id", F.lit(0).alias("community"))).collect()
    assert len({(round(r["x"], 6), round(r["y"], 6)) for r in rows}) == 34


def test_platonic_solids():
    for (_, s), n in zip(style.SHAPES, (4, 8, 6, 20, 12)):
        p = np.array(style.platonic_mesh(s))
        assert len(p) == n and np.allclose(np.linalg.norm(p, axis=1), 1)


def test_route_without_tangent(spark):
    v = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0)], "id long, x double, y double, z double, size double")
    g = Graph(v, spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "src long, dst long"))
    rows = style.edge_route_spherical(g).collect()
    assert len(rows) == 24 and all(math.isfinite(r[c]) for r in rows for c in "xyz")


def test_pick_nothing(spark):
    v = spark.createDataFrame([(0, 9.0, 9.0, 0.0, 1.0)], "id long, x double, y double, z double, size double")
    assert spatial.pick_object(Graph(v, spark.createDataFrame([], "src long, dst long"))).count() == 0


def test_graphml(spark, tmp_path):
    from graphloom.sources.graphml import read_graphml, write_graphml

    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0"?><graphml><key id="k0" for="node" attr.name="pagerank" attr.type="double"/><key id="k1" for="node" attr.name="label" attr.type="string"/>'
        '<graph id="G" edgedefault="undirected"><node id="n0"><data key="k0">2.0</data><data key="k1">a</data></node><node id="n1"><data key="k0">-1</data></node><node id="n2"/><node id="n3"/>'
        '<edge source="n0" target="n1"/><edge source="n1" target="n0"/><edge source="n2" target="n2"/><edge source="n1" target="n2"/></graph></graphml>'
    )
    g = read_graphml(spark, str(tmp_path / "g.graphml"))
    assert pairs(g) == {(0, 1), (1, 2)} and g.vertices.count() == 4 and not g.directed
    size = scores(g.vertices, "size")
    assert size == {0: 1.0, 1: -0.5, 2: 1.0, 3: 1.0}
    write_graphml(g, str(tmp_path / "out"))
    back = read_graphml(spark, str(tmp_path / "out"))
    assert pairs(back) == pairs(g) and scores(back.vertices, "label")[0] == "a"


def test_command_line(spark, tmp_path, capsys):
    from graphloom.__main__ import main
    from graphloom.sources.graphml import write_graphml

    write_graphml(generators.ring(spark, 6), str(tmp_path / "in"))
    main([str(tmp_path / "in"), "--layout", "kk", "--out", str(tmp_path / "out")])
    assert "Nodes: 6 | Edges: 6" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "out/vertices")).where("x is not null").count() == 6


def test_catalog(spark):
    from graphloom.jobs import Runner

    assert registry.commands(spark).count() == 78
    assert {c for _, c, _ in registry.CATALOG} <= set(registry.COMMANDS)
    run = Runner(spark)
    job = run.submit(lambda: registry.run(generators.ring(spark), "igraph_degree").count())
    assert job.result(60) == 20 and job.status == "COMPLETED"
    bad = run.submit(lambda: None)
    bad.result(60)
    assert bad.status == "FAILED"
    run.close()


def test_file_commands(spark, tmp_path):
    from graphloom.jobs import Runner

    ring = generators.ring(spark, 6)
    empty = registry.run(ring, "file_new")
    assert empty.summary().first().asDict() == {"node_count": 0, "edge_count": 0}
    assert registry.run(ring, "file_save", path=str(tmp_path / "ring")) is ring
    assert pairs(registry.run(empty, "file_open", path=str(tmp_path / "ring"))) == pairs(ring)
    assert pairs(registry.run(None, "file_open", path=str(tmp_path / "ring"), spark=spark)) == pairs(ring)
    runner = registry.run(ring, "app_exit", runner=Runner(spark))
    with pytest.raises(RuntimeError):
        runner.submit(lambda: 1)


def test_constraint_and_coreness_of_a_random_graph(spark):
    """Against sums over all vertices, and against peeling; one hub sees every vertex, some vertices see only it."""
    n = 40
    draw = np.random.default_rng(3)
    a = np.triu(draw.random((n, n)) < 0.12, 1)
    a[:, 30:] = False
    a[0, 1:] = True
    a = a | a.T
    edges = [(int(i), int(j)) for i, j in np.argwhere(np.triu(a))]
    g = Graph(spark.range(n + 1), spark.createDataFrame(edges, "src long, dst long"))
    p = a / a.sum(1, keepdims=True)
    expect = np.where(a, (p + p @ p) ** 2, 0).sum(1)
    got = scores(centrality.constraint(g))
    assert got.pop(n) is None and np.allclose([got[k] for k in range(n)], expect)
    core, left, k = {n: 0}, set(range(n)), 0
    while left:
        low = min(left, key=lambda v: a[v, list(left)].sum())
        k = max(k, int(a[low, list(left)].sum()))
        core[low] = k
        left.remove(low)
    assert scores(structure.coreness(g), "coreness") == core
    with pytest.raises(RuntimeError):
        structure.coreness(Graph.of_edges(spark.range(30).selectExpr("id as src", "id + 1 as dst")), rounds=3).count()


def test_search_is_bounded(spark, monkeypatch):
    assert structure.bridges(cliques(spark)).collect() == [(4, 5)]
    monkeypatch.setattr(structure, "SEARCH_EDGES", 10)
    with pytest.raises(ValueError):
        structure.bridges(cliques(spark))


def test_hubs_start_at_random_edges(spark):
    g = generators.lattice(spark)
    g = layout_geometric.sync_positions(g, layout_geometric.grid(g.vertices, 25, 5))
    one, two = ({tuple(r) for r in structure.kmeans_hubs(g, k=4, rounds=0, seed=s).collect()} for s in (1, 2))
    assert len(one) == len(two) == 4 and one != two


def test_ordering(spark):
    from graphloom.plans.ordering import dense_ids, running_sum, successors

    df = spark.createDataFrame([(k * k,) for k in range(50)], "k long")
    assert [r["id"] for r in dense_ids(df, "k", buckets=7).orderBy("k").collect()] == list(range(50))
    s = running_sum(spark.range(100), F.col("id") * 1.0, "s", block=9)
    assert all(r["s"] == r["id"] * (r["id"] + 1) / 2 for r in s.collect())
    e = spark.createDataFrame([(k // 4, k, k % 5) for k in range(20)], "d int, o int, v int")
    got = sorted((r["s"], r["t"]) for r in successors(e, F.col("d"), ["o"], "v").collect())
    assert got == sorted((k % 5, (k + 1) % 5) for k in range(19))


def test_solvers_run_all_their_rounds(monkeypatch):
    """As many rounds as the fixed values say, at every size."""
    e = np.array([(k, k + 1) for k in range(2100)])
    rounds = []
    monkeypatch.setattr(layout_force.np.random, "default_rng", lambda seed: Counting(rounds))
    monkeypatch.setattr(layout_force, "ROWS", 4096)
    layout_force.openord(3, e[:2], stages=((7, 10, 1, 1.0), (5, 10, 1, 0.5)))
    small = len(rounds)
    rounds.clear()
    layout_force.openord(2101, e, stages=((7, 10, 1, 1.0), (5, 10, 1, 0.5)), dims=1)
    assert len(rounds) == small == 12
    assert sum(s[0] for s in layout_force.OPENORD_STAGES) == sum(s[0] for s in layout_force.DRL_STAGES) == 750


class Counting:
    def __init__(self, rounds):
        self.rounds, self.rng = rounds, np.random.RandomState(1)

    def random(self, shape):
        return self.rng.random_sample(shape)

    def uniform(self, a, b, shape):
        self.rounds.append(shape)
        return self.rng.uniform(a, b, shape)
