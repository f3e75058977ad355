"""Queries of the graph operators over the relational tables, and their SQL counterparts.

Each query is a function of (spark, sf_dir); the SQL of the same name gives the same
rows in another engine.  Real numbers are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry
from .functions.random import uniform
from .functions.vectors import lit3, vec
from .graph import Graph
from .operators import centrality, community, generators, layered_sphere, layout_force, layout_geometric, paths, spatial, structure, style
from .plans.storage import cut
from .sources import derive
from .sources.derive import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """df with doubles to six digits and no negative zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def r(x: str) -> str:
    return f"(round(({x})::DOUBLE, 6) + 0.0::DOUBLE)"


BOTH = "b AS (SELECT src AS u, dst AS v FROM e UNION ALL SELECT dst, src FROM e)"
ENDS = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"
#: The hand-off graph of purchases.
D1 = f"""h AS (SELECT user_id AS s, lead(user_id) OVER (ORDER BY ts, event_id) AS t FROM events WHERE event_type = 'purchase'),
e AS MATERIALIZED (SELECT DISTINCT s AS src, t AS dst FROM h WHERE t IS NOT NULL AND s <> t), {ENDS}, {BOTH}"""
#: The hand-off graph of all events.
D2 = D1.replace(" WHERE event_type = 'purchase'", "")
#: The hand-off graph of purchases without directions.
D1U = D1.replace("SELECT DISTINCT s AS src, t AS dst", "SELECT DISTINCT least(s, t) AS src, greatest(s, t) AS dst")
#: Parts of urgent orders that came back together.
D3 = f"""l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT'),
e AS MATERIALIZED (SELECT DISTINCT a.p AS src, b.p AS dst FROM l a JOIN l b ON a.o = b.o AND a.p < b.p), {ENDS}, {BOTH}"""
#: Trade between nations.
D5 = f"""e AS MATERIALIZED (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(l_extendedprice * (1 - l_discount)) AS weight
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2), {ENDS}, {BOTH}"""
#: Hops between all pairs of a graph of short paths.
HOPS = "p(s, id, d) AS (SELECT id, id, 0 FROM v UNION SELECT p.s, {a}.v, p.d + 1 FROM p JOIN {a} ON {a}.u = p.id WHERE p.d < {k}), q AS MATERIALIZED (SELECT s, id, min(d) AS d FROM p GROUP BY s, id)"
OUT = "a AS (SELECT src AS u, dst AS v FROM e)"


def d1(spark, d) -> Graph:
    return derive.hand_off(spark, d)


def d3(spark, d) -> Graph:
    return derive.co_ordered(spark, d)


# ---- scores -------------------------------------------------------------------------


@query("degree", f"WITH {D1} SELECT u AS id, count(*)::DOUBLE AS score FROM b GROUP BY u")
def _(spark, d):
    return centrality.degree(d1(spark, d))


@query("strength", f"WITH {D5}, w AS (SELECT src AS u, weight FROM e UNION ALL SELECT dst, weight FROM e) SELECT u AS id, {r('sum(weight) / 1e6')} AS score FROM w GROUP BY u")
def _(spark, d):
    return rounded(centrality.strength(derive.nation_trade(spark, d), "weight").withColumn("score", F.col("score") / 1e6), "score")


@query("constraint", f"""WITH {D1U}, t AS (SELECT u, count(*) AS t FROM b GROUP BY u), p AS MATERIALIZED (SELECT b.u, b.v, 1.0::DOUBLE / t AS p FROM b JOIN t USING (u)),
w AS (SELECT x.u AS i, y.v AS j, sum(x.p * y.p) AS way FROM p x JOIN p y ON x.v = y.u WHERE x.u <> y.v GROUP BY 1, 2)
SELECT p.u AS id, {r('sum((p.p + coalesce(way, 0)) ** 2)')} AS score FROM p LEFT JOIN w ON w.i = p.u AND w.j = p.v GROUP BY p.u""")
def _(spark, d):
    return rounded(centrality.constraint(d1(spark, d).undirected()), "score")


@query("apply_centrality", f"""WITH {D1}, s AS (SELECT u AS id, count(*)::DOUBLE AS score FROM b GROUP BY u), m AS (SELECT min(score) AS lo, max(score) AS hi FROM s)
SELECT id, score, {r('0.5 + 1.5 * (score - lo) / (hi - lo)')} AS size, {r('(score - lo) / (hi - lo)')} AS glow FROM s, m""")
def _(spark, d):
    return rounded(centrality.apply_centrality(centrality.degree(d1(spark, d))), "size", "glow")


PAGERANK = f"""o AS (SELECT src, count(*) AS d FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM v),
k(i, id, x) AS (SELECT 0, id, 1.0::DOUBLE / n FROM v, n UNION ALL
  SELECT z.i, z.id, 0.15 / n + 0.85 * (z.got + z.lost / n) FROM n, (
    SELECT c.i + 1 AS i, v.id, sum(CASE WHEN c.id = e.src THEN c.x / o.d ELSE 0 END) AS got,
      0.0 AS lost FROM (SELECT DISTINCT i FROM k) q JOIN k c ON c.i = q.i CROSS JOIN v LEFT JOIN e ON e.dst = v.id AND e.src = c.id LEFT JOIN o ON o.src = e.src WHERE c.i < 60 GROUP BY 1, 2) z)
SELECT id, {r('x')} AS score FROM k WHERE i = 60""".replace("(SELECT DISTINCT i FROM k) q JOIN k c ON c.i = q.i", "k c")


@query("pagerank", f"WITH RECURSIVE {D1}, {PAGERANK}")
def _(spark, d):
    return rounded(centrality.pagerank(d1(spark, d), rounds=100), "score")


@query("pagerank_all_events", f"WITH RECURSIVE {D2}, {PAGERANK}")
def _(spark, d):
    return rounded(centrality.pagerank(derive.hand_off(spark, d, None), rounds=100), "score")


@query("eigenvector", f"""WITH RECURSIVE {D1U}, k(i, id, x) AS (SELECT 0, id, 1.0::DOUBLE FROM v UNION ALL
  SELECT i, id, y / max(y) OVER () FROM (SELECT c.i + 1 AS i, v.id, sum(CASE WHEN b.u IS NOT NULL OR c.id = v.id THEN c.x ELSE 0 END) AS y
    FROM k c CROSS JOIN v LEFT JOIN b ON b.u = v.id AND b.v = c.id WHERE c.i < 200 GROUP BY 1, 2))
SELECT id, {r('x')} AS score FROM k WHERE i = 200""")
def _(spark, d):
    return rounded(centrality.eigenvector(d1(spark, d).undirected()), "score")


@query("hits_hub", f"""WITH RECURSIVE {D1}, k(i, id, x) AS (SELECT 0, id, 1.0::DOUBLE FROM v UNION ALL
  SELECT i, id, y / max(y) OVER () FROM (SELECT c.i + 1 AS i, v.id, sum(CASE WHEN (c.i % 2 = 0 AND f.src IS NOT NULL) OR (c.i % 2 = 1 AND g.src IS NOT NULL) THEN c.x ELSE 0 END) AS y
    FROM k c CROSS JOIN v LEFT JOIN e f ON f.src = c.id AND f.dst = v.id LEFT JOIN e g ON g.src = v.id AND g.dst = c.id WHERE c.i < 161 GROUP BY 1, 2))
SELECT x.id, {r('x.x')} AS score, {r('y.x')} AS authority FROM k x JOIN k y ON x.id = y.id WHERE x.i = 160 AND y.i = 161""")
def _(spark, d):
    return rounded(centrality.hits(d1(spark, d)), "score", "authority")


PAIRS = f"WITH RECURSIVE {D1U}, {HOPS.format(a='b', k=8)}"
DIRECTED = f"WITH RECURSIVE {D1}, {OUT}, {HOPS.format(a='a', k=14)}"


@query("distances", f"{DIRECTED} SELECT s AS source, id, d::INTEGER AS hops FROM q")
def _(spark, d):
    return paths.distances(d1(spark, d))


@query("closeness", f"{PAIRS} SELECT s AS id, {r('(count(*) - 1) / sum(d)')} AS score FROM q GROUP BY s")
def _(spark, d):
    return rounded(paths.closeness(d1(spark, d)), "score")


@query("harmonic", f"{PAIRS} SELECT s AS id, {r('sum(CASE WHEN d > 0 THEN 1.0::DOUBLE / d ELSE 0 END) / ((SELECT count(*) FROM v) - 1)')} AS score FROM q GROUP BY s")
def _(spark, d):
    return rounded(paths.harmonic(d1(spark, d)), "score")


@query("betweenness", f"""WITH RECURSIVE {D1}, {OUT}, {HOPS.format(a='a', k=14)},
g(s, id, d, n) AS (SELECT id, id, 0, 1.0::DOUBLE FROM v UNION ALL
  SELECT g.s, a.v, g.d + 1, sum(g.n) FROM g JOIN a ON a.u = g.id JOIN q ON q.s = g.s AND q.id = a.v AND q.d = g.d + 1 GROUP BY 1, 2, 3)
SELECT v.id, {r('coalesce(sum(x.n * y.n / t.n), 0) / ((SELECT count(*) - 1 FROM v) * (SELECT count(*) - 2 FROM v))')} AS score
FROM v LEFT JOIN g x ON x.id = v.id AND x.s <> v.id LEFT JOIN g y ON y.s = v.id AND y.id <> v.id AND y.id <> x.s
LEFT JOIN g t ON t.s = x.s AND t.id = y.id AND t.d = x.d + y.d WHERE t.n IS NOT NULL OR x.s IS NULL GROUP BY v.id""")
def _(spark, d):
    return rounded(paths.betweenness(d1(spark, d)), "score")


# ---- whole graphs -------------------------------------------------------------------


@query("diameter", f"{PAIRS} SELECT max(d)::BIGINT AS diameter FROM q")
def _(spark, d):
    return paths.diameter(d1(spark, d))


@query("radius", f"{DIRECTED} SELECT min(m)::DOUBLE AS radius FROM (SELECT max(d) AS m FROM q GROUP BY s)")
def _(spark, d):
    return paths.radius(d1(spark, d))


@query("average_path_length", f"{DIRECTED} SELECT {r('avg(d)')} AS average_path_length FROM q WHERE d > 0")
def _(spark, d):
    return rounded(paths.average_path_length(d1(spark, d)), "average_path_length")


@query("assortativity_degree", f"""WITH {D3}, g AS (SELECT u, count(*)::DOUBLE AS d FROM b GROUP BY u)
SELECT {r('corr(x.d, y.d)')} AS assortativity FROM b JOIN g x ON x.u = b.u JOIN g y ON y.u = b.v""")
def _(spark, d):
    return rounded(structure.assortativity(d3(spark, d)), "assortativity")


@query("assortativity_directed", f"""WITH {D1}, o AS (SELECT src, count(*)::DOUBLE AS d FROM e GROUP BY 1), i AS (SELECT dst, count(*)::DOUBLE AS d FROM e GROUP BY 1)
SELECT {r('corr(o.d, i.d)')} AS assortativity FROM e JOIN o USING (src) JOIN i USING (dst)""")
def _(spark, d):
    return rounded(structure.assortativity(d1(spark, d)), "assortativity")


@query("density", f"WITH {D1} SELECT {r('(SELECT count(*) FROM e)::DOUBLE / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1))')} AS density")
def _(spark, d):
    return rounded(structure.density(d1(spark, d)), "density")


TRI = "t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst)"


@query("transitivity", f"WITH {D3}, {TRI}, g AS (SELECT u, count(*) AS d FROM b GROUP BY u) SELECT {r('3.0::DOUBLE * (SELECT count(*) FROM t) / (SELECT sum(d * (d - 1) / 2) FROM g)')} AS transitivity")
def _(spark, d):
    return rounded(structure.transitivity(d3(spark, d)), "transitivity")


@query("local_transitivity", f"""WITH {D3}, {TRI}, g AS (SELECT u, count(*) AS d FROM b GROUP BY u), k AS (SELECT id, count(*) AS k FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id)
SELECT u AS id, {r('CASE WHEN d > 1 THEN coalesce(k, 0) / (d * (d - 1) / 2.0::DOUBLE) ELSE 0 END')} AS transitivity FROM g LEFT JOIN k ON k.id = g.u""")
def _(spark, d):
    return rounded(structure.local_transitivity(d3(spark, d)), "transitivity")


@query("summary", f"WITH {D3} SELECT (SELECT count(*) FROM v) AS node_count, (SELECT count(*) FROM e) AS edge_count")
def _(spark, d):
    return d3(spark, d).summary()


@query("info_card", f"WITH {D1} SELECT 'Density' AS title, 'Density' AS \"key\", printf('%.4f', x) AS value, {r('x')} AS value_num FROM (SELECT (SELECT count(*) FROM e)::DOUBLE / ((SELECT count(*) FROM v) * ((SELECT count(*) FROM v) - 1)) AS x)")
def _(spark, d):
    x = structure.density(d1(spark, d)).first()["density"]
    return rounded(structure.info_card(spark, "Density", [("Density", x, "%.4f")]), "value_num")


# ---- cores, filters, components -------------------------------------------------------


CORE = """c(i, id, x) AS (SELECT 0, u, count(DISTINCT v) FROM nb GROUP BY u UNION ALL
  SELECT i + 1, u, max(least(x, n)) FROM (SELECT c.i, nb.u, c.x, row_number() OVER (PARTITION BY nb.u ORDER BY c.x DESC) AS n FROM c JOIN nb ON nb.v = c.id WHERE c.i < 40) GROUP BY 1, 2)"""
NB = "nb AS MATERIALIZED (SELECT DISTINCT u, v FROM b)"


@query("coreness", f"WITH RECURSIVE {D1}, {NB}, {CORE} SELECT id, x::BIGINT AS coreness FROM c WHERE i = 40")
def _(spark, d):
    return structure.coreness(d1(spark, d)).select("id", F.col("coreness").cast("long").alias("coreness"))


GRID_SQL = "w AS (SELECT ceil(round(pow(count(*), 1.0 / 3), 9))::BIGINT AS w FROM k)"
GRID_COLS = "(k.id % w)::DOUBLE AS x, (k.id // w % w)::DOUBLE AS y, (k.id // (w * w))::DOUBLE AS z"


@query("filter_degree", f"""WITH {D3}, g AS (SELECT u, count(*) AS d FROM b GROUP BY u), k AS (SELECT u AS old_id, row_number() OVER (ORDER BY u) - 1 AS id FROM g WHERE d >= 4), {GRID_SQL}
SELECT k.old_id, k.id, {GRID_COLS} FROM k, w""")
def _(spark, d):
    return structure.filter_degree(d3(spark, d), 4).vertices


@query("filter_degree_edges", f"""WITH {D3}, g AS (SELECT u, count(*) AS d FROM b GROUP BY u), k AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS id FROM g WHERE d >= 4)
SELECT x.id AS src, y.id AS dst FROM e JOIN k x ON x.u = e.src JOIN k y ON y.u = e.dst""")
def _(spark, d):
    return structure.filter_degree(d3(spark, d), 4).edges.select("src", "dst")


@query("filter_coreness", f"""WITH RECURSIVE {D1U}, {NB}, {CORE}, f AS MATERIALIZED (SELECT id AS old_id, x FROM c WHERE i = 40), m AS (SELECT max(x) AS m FROM f),
k AS MATERIALIZED (SELECT old_id, row_number() OVER (ORDER BY old_id) - 1 AS id, x FROM f WHERE x >= 12), {GRID_SQL}
SELECT k.old_id, k.id, k.x::BIGINT AS coreness, {r('k.x::DOUBLE / m')} AS glow, {GRID_COLS} FROM k, w, m""")
def _(spark, d):
    v = structure.filter_coreness(d1(spark, d).undirected(), 12).vertices
    return rounded(v.withColumn("coreness", F.col("coreness").cast("long")), "glow")


@query("connected_components", f"WITH RECURSIVE {D3}, p(s, id) AS (SELECT id, id FROM v UNION SELECT p.s, b.v FROM p JOIN b ON b.u = p.id) SELECT id, min(s) AS component FROM p GROUP BY id")
def _(spark, d):
    return structure.connected_components(d3(spark, d))


@query("bipartite_types", "SELECT y * 5 + x AS id, (x + y) % 2 = 1 AS type FROM (SELECT unnest(range(5)) AS x) CROSS JOIN (SELECT unnest(range(5)) AS y)")
def _(spark, d):
    return structure.bipartite_types(generators.lattice(spark))


@query("is_bipartite", "SELECT true AS bipartite")
def _(spark, d):
    return structure.is_bipartite(derive.customer_part(spark, d))


@query("neighbors", f"WITH {D3} SELECT u AS id, string_agg(v::VARCHAR, ',' ORDER BY v) AS neighbors FROM b GROUP BY u")
def _(spark, d):
    return structure.neighbors(d3(spark, d)).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query("articulation_points", "SELECT unnest(range(7)) AS id")
def _(spark, d):
    return structure.articulation_points(generators.kary_tree(spark))


@query("bridges", "SELECT (i - 1) // 2 AS src, i AS dst FROM (SELECT unnest(range(1, 15)) AS i)")
def _(spark, d):
    return structure.bridges(generators.kary_tree(spark))


REACH = """p(x, s, id) AS (SELECT o.id, s.id, s.id FROM v o, v s WHERE s.id <> o.id AND s.id = (SELECT min(n.v) FROM b n WHERE n.u = o.id)
  UNION SELECT p.x, p.s, b.v FROM p JOIN b ON b.u = p.id WHERE b.v <> p.x)"""


@query("articulation_points_hand_off", f"WITH RECURSIVE {D1U}, {REACH} SELECT DISTINCT b.u AS id FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.x = b.u AND p.id = b.v)")
def _(spark, d):
    return structure.articulation_points(d1(spark, d))


@query("highlight_co_ordered")
def _(spark, d):
    return structure.highlight(d3(spark, d))


KM0 = "h0 AS (SELECT (y * 5 + x) AS hub, x::DOUBLE AS x, y::DOUBLE AS y, 0.0::DOUBLE AS z FROM g WHERE y * 5 + x IN (0, 12, 24))"
_kmeans = ["WITH g AS (SELECT x, y FROM (SELECT unnest(range(5)) AS x) CROSS JOIN (SELECT unnest(range(5)) AS y))", "m AS (SELECT x + 0.5::DOUBLE AS x, y::DOUBLE AS y FROM g WHERE x < 4 UNION ALL SELECT x::DOUBLE, y + 0.5::DOUBLE FROM g WHERE y < 4)", KM0]
for _k in range(10):
    _kmeans.append(f"a{_k} AS (SELECT m.x, m.y, arg_min(h.hub, (round((m.x - h.x) ** 2 + (m.y - h.y) ** 2, 9), h.hub)) AS hub FROM m, h{_k} h GROUP BY m.x, m.y)")
    _kmeans.append(f"h{_k + 1} AS (SELECT h.hub, coalesce(avg(a.x), any_value(h.x)) AS x, coalesce(avg(a.y), any_value(h.y)) AS y, 0.0::DOUBLE AS z FROM h{_k} h LEFT JOIN a{_k} a ON a.hub = h.hub GROUP BY h.hub)")


@query("kmeans_hubs", ", ".join(_kmeans) + f" SELECT hub, {r('x')} AS x, {r('y')} AS y, z FROM h10")
def _(spark, d):
    g = generators.lattice(spark)
    g = layout_geometric.sync_positions(g, layout_geometric.grid(g.vertices, 25, 5))
    start = g.vertices.where("id in (0, 12, 24)").select(F.col("id").alias("hub"), "x", "y", "z")
    return rounded(structure.kmeans_hubs(g, start=start), "x", "y", "z")


@query("simplify", f"WITH {D1U} SELECT src, dst FROM e")
def _(spark, d):
    return d1(spark, d).undirected().edges


@query("refresh_nodes", f"""WITH RECURSIVE {D1U}, {NB}, {CORE} SELECT c.id, NULL::VARCHAR AS label, 1.0::DOUBLE AS size, (SELECT count(*) FROM b WHERE u = c.id)::INTEGER AS degree, x::INTEGER AS coreness FROM c WHERE i = 40""")
def _(spark, d):
    return style.records(d1(spark, d).undirected())


# ---- generators ----------------------------------------------------------------------

_GEN = {
    "gen_ring": (generators.ring, "SELECT i AS src, (i + 1) % 20 AS dst FROM (SELECT unnest(range(20)) AS i)"),
    "gen_star": (generators.star, "SELECT 0::BIGINT AS src, i AS dst FROM (SELECT unnest(range(1, 11)) AS i)"),
    "gen_kary_tree": (generators.kary_tree, "SELECT (i - 1) // 2 AS src, i AS dst FROM (SELECT unnest(range(1, 15)) AS i)"),
    "gen_lattice": (generators.lattice, "SELECT i AS src, i + 1 AS dst FROM (SELECT unnest(range(25)) AS i) WHERE i % 5 < 4 UNION ALL SELECT i, i + 5 FROM (SELECT unnest(range(20)) AS i)"),
    "gen_full": (generators.full, "SELECT a AS src, b AS dst FROM (SELECT unnest(range(10)) AS a) JOIN (SELECT unnest(range(10)) AS b) ON a < b"),
    "gen_cycle": (generators.cycle, "SELECT i AS src, (i + 1) % 12 AS dst FROM (SELECT unnest(range(12)) AS i)"),
    "gen_famous": (generators.famous, "SELECT split_part(p, '-', 1)::BIGINT AS src, split_part(p, '-', 2)::BIGINT AS dst FROM (SELECT unnest(string_split('" + generators.ZACHARY + "', ',')) AS p)"),
    "gen_gnp": (generators.gnp, f"SELECT a AS src, b AS dst FROM (SELECT unnest(range(30)) AS a) JOIN (SELECT unnest(range(30)) AS b) ON a < b WHERE {uniform('a', 'b', 1)} < 0.15"),
    "gen_bipartite_gnm": (generators.bipartite_gnm, f"SELECT a AS src, b AS dst FROM (SELECT unnest(range(8)) AS a) CROSS JOIN (SELECT unnest(range(8, 14)) AS b) ORDER BY {uniform('a', 'b', 1)}, a, b LIMIT 15"),
    "gen_degree_sequence": (generators.degree_sequence, f"WITH s AS (SELECT a AS id, row_number() OVER (ORDER BY {uniform('a', 'k', 1)} * 1e6 + a * 1e-3 + k * 1e-6) - 1 AS p FROM (SELECT unnest(range(20)) AS a) CROSS JOIN (SELECT unnest(range(1, 5)) AS k)) SELECT arg_min(id, p) AS src, arg_max(id, p) AS dst FROM s GROUP BY p // 2"),
    "gen_geometric": (generators.geometric, f"WITH p AS (SELECT i AS id, {uniform('i', '1', 1)} AS x, {uniform('i', '2', 1)} AS y FROM (SELECT unnest(range(25)) AS i)) SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.04"),
    "gen_gabriel": (generators.gabriel, f"WITH p AS (SELECT i AS id, {uniform('i', '1', 1)} AS x, {uniform('i', '2', 1)} AS y FROM (SELECT unnest(range(20)) AS i)) SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.id <> a.id AND c.id <> b.id AND (a.x - c.x) * (b.x - c.x) + (a.y - c.y) * (b.y - c.y) < -1e-15)"),
    "gen_barabasi": (generators.barabasi, None), "gen_watts_strogatz": (generators.watts_strogatz, None), "gen_forest_fire": (generators.forest_fire, None), "gen_random_tree": (generators.random_tree, None),
}
for _name, (_f, _sql) in _GEN.items():
    if _sql:
        query(_name, _sql)(lambda spark, d, _f=_f: _f(spark).edges.select("src", "dst"))


def _sound(g: Graph) -> DataFrame:
    """(vertices, components, faults): loops and repeated edges are faults."""
    g = Graph(cut(g.vertices), cut(g.edges), g.directed)
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    faults = g.edges.agg((F.count("*") - F.count_distinct(F.when(F.col("src") != F.col("dst"), pair))).alias("faults"))
    return structure.connected_components(g).agg(F.count("*").alias("vertices"), F.count_distinct("component").alias("components")).crossJoin(faults)


for _name, _n in (("gen_barabasi", 50), ("gen_forest_fire", 50), ("gen_random_tree", 20)):
    query(_name, f"SELECT {_n}::BIGINT AS vertices, 1::BIGINT AS components, 0::BIGINT AS faults")(lambda spark, d, _f=_GEN[_name][0]: _sound(_f(spark)))
query("gen_watts_strogatz", "SELECT 20::BIGINT AS vertices, 40::BIGINT AS edges, 0::BIGINT AS faults")(lambda spark, d: _sound(generators.watts_strogatz(spark)).select("vertices", F.lit(generators.watts_strogatz(spark).edges.count()).alias("edges"), "faults"))


@query("bipartite_projection", """WITH e AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderpriority = '1-URGENT')
SELECT a.c * 2 AS src, b.c * 2 AS dst, count(*) AS multiplicity FROM e a JOIN e b ON a.p = b.p AND a.c < b.c GROUP BY 1, 2""")
def _(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    g = Graph.of_edges(e)
    return generators.bipartite_projection(g, g.vertices.select("id", (F.col("id") % 2 == 1).alias("type"))).edges


@query("nearest_neighbours_embeddings", "WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 0.0025")
def _(spark, d):
    return generators.nearest_neighbours(derive.points(spark, d).select("id", "x", "y"), 0.05).edges


# ---- closed-form layouts -----------------------------------------------------------------

CUST = "c AS (SELECT c_custkey AS id FROM customer), n AS (SELECT count(*) AS n FROM c)"


def customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"))


def _xyz(x: str, y: str, z: str = "0.0") -> str:
    return f"{r(x)} AS x, {r(y)} AS y, {r(z)} AS z"


_PHI = "CASE WHEN id > 0 AND id < n - 1 THEN 3.6 / sqrt(n * (1 - (-1.0 + id * 2.0 / (n - 1)) ** 2)) ELSE 0 END"
_LAYOUTS = {
    "layout_circle": (layout_geometric.circle, f"WITH {CUST} SELECT id, {_xyz('cos(id * (2 * pi() / n))', 'sin(id * (2 * pi() / n))')} FROM c, n"),
    "layout_star": (layout_geometric.star, f"WITH {CUST} SELECT id, {_xyz('CASE WHEN id = 0 THEN 0 ELSE cos((id - 1) * (2 * pi() / (n - 1))) END', 'CASE WHEN id = 0 THEN 0 ELSE sin((id - 1) * (2 * pi() / (n - 1))) END')} FROM c, n"),
    "layout_grid": (layout_geometric.grid, f"WITH {CUST}, w AS (SELECT ceil(sqrt(n))::BIGINT AS w FROM n) SELECT id, {_xyz('id % w', 'id // w')} FROM c, w"),
    "layout_grid_3d": (layout_geometric.grid_3d, f"WITH {CUST}, w AS (SELECT ceil(round(pow(n, 1.0 / 3), 9))::BIGINT AS w FROM n) SELECT id, {_xyz('id % w', 'id // w % w', 'id // (w * w)')} FROM c, w"),
    "layout_sphere": (layout_geometric.sphere, f"WITH {CUST}, p AS (SELECT id, n, -1.0::DOUBLE + id * 2.0::DOUBLE / (n - 1) AS z, CASE WHEN id > 0 AND id < n - 1 THEN sum({_PHI}) OVER (ORDER BY id) ELSE 0 END AS phi FROM c, n) SELECT id, {_xyz('sqrt(greatest(0, 1 - z * z)) * cos(phi)', 'sqrt(greatest(0, 1 - z * z)) * sin(phi)', 'z')} FROM p"),
    "layout_random_3d": (layout_geometric.random_3d, f"WITH {CUST} SELECT id, {_xyz(*(uniform('id', str(k), 1) + ' * 2 - 1' for k in (1, 2, 3)))} FROM c"),
    "layout_random": (layout_geometric.random_2d, f"WITH {CUST} SELECT id, {_xyz(*(uniform('id', str(k), 1) + ' * 2 - 1' for k in (1, 2)))} FROM c"),
}
_LAYOUTS["layout_circle_2d"] = _LAYOUTS["layout_circle"]
for _name, (_f, _sql) in _LAYOUTS.items():
    query(_name, _sql)(lambda spark, d, _f=_f: rounded(_f(customers(spark, d)), "x", "y", "z"))

PTS = "p AS MATERIALIZED (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 0.1 + label * 0.01::DOUBLE AS size FROM embeddings)"


@query("sync_positions", "WITH " + PTS + f" SELECT c_custkey AS id, {_xyz('coalesce(x, 0)', 'coalesce(y, 0)')} FROM customer LEFT JOIN p ON p.id = c_custkey")
def _(spark, d):
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    g = layout_geometric.sync_positions(Graph(v, v.select(F.col("id").alias("src"), F.col("id").alias("dst"))), derive.points(spark, d).select("id", "x", "y"))
    return rounded(g.vertices, "x", "y", "z")


@query("layout_bounds", "WITH " + PTS + " SELECT " + ", ".join(f"{r(f'{m}({c})')} AS {m}_{c}" for c in "xyz" for m in ("min", "max")) + " FROM p")
def _(spark, d):
    return rounded(layout_geometric.bounds(derive.points(spark, d)), *(f"{m}_{c}" for c in "xyz" for m in ("min", "max")))


@query("center_unit", "WITH " + PTS + ", m AS (SELECT avg(x) AS a, avg(y) AS b, avg(z) AS c FROM p), f AS (SELECT max(sqrt((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2)) AS f FROM p, m)" + f" SELECT id, {_xyz('(x - a) / f', '(y - b) / f', '(z - c) / f')} FROM p, m, f")
def _(spark, d):
    return rounded(layout_geometric.center_unit(derive.points(spark, d)), "x", "y", "z")


# ---- solvers, whose places no SQL computes: what holds for every result ----------------------

#: Trade between nations without directions.
PLACED = f"WITH {D5} SELECT id, 1::BIGINT AS places, true AS finite FROM v"
#: Every vertex in one community, and no worse than one community for all.
SPLIT = "WITH {} SELECT id, 1::BIGINT AS communities, true AS gain FROM v"


def trade(spark, d) -> Graph:
    return derive.nation_trade(spark, d).undirected()


def placed(at: DataFrame) -> DataFrame:
    """How often each vertex is placed, and whether all its coordinates are finite."""
    finite = F.abs("x") + F.abs("y") + F.abs("z") < 1e100
    return at.groupBy("id").agg(F.count("*").alias("places"), F.bool_and(F.coalesce(finite, F.lit(False))).alias("finite"))


def split(graph: Graph, member: DataFrame) -> DataFrame:
    """How many communities each vertex has, and whether their modularity is at least that of a single one."""
    member = cut(member)
    gain = community.modularity(graph, member).select((F.col("modularity") >= -1e-9).alias("gain"))
    return member.groupBy("id").agg(F.count_distinct("community").alias("communities")).crossJoin(F.broadcast(gain))


for _kind in layout_force.SOLVERS:
    query(f"layout_{_kind}", PLACED)(lambda spark, d, _kind=_kind: placed(layout_force.layout(trade(spark, d), _kind)))
query("layout_layered_sphere", PLACED)(lambda spark, d: placed(layered_sphere.layout(trade(spark, d))))
query("layout_step", PLACED)(lambda spark, d: placed(layout_force.layout_step(trade(spark, d), "fr", 50)))
query("spring_step", f"WITH {D1} SELECT id, 1::BIGINT AS places, true AS finite FROM v")(lambda spark, d: placed(layout_force.spring_step(d1(spark, d), layout_geometric.random_3d(d1(spark, d).vertices), 1.0)))
#: Sequential methods of more than quadratic time take the graph of nations.
for _kind in community.METHODS:
    if _kind == "optimal_modularity":
        query("community_optimal_modularity", "SELECT unnest(range(15))::BIGINT AS id, 1::BIGINT AS communities, true AS gain")(lambda spark, d: split(generators.kary_tree(spark), community.detect(generators.kary_tree(spark), "optimal_modularity")))
    elif _kind in ("edge_betweenness", "spinglass"):
        query(f"community_{_kind}", SPLIT.format(D5))(lambda spark, d, _kind=_kind: split(trade(spark, d), community.detect(trade(spark, d), _kind)))
    else:
        query(f"community_{_kind}", SPLIT.format(D1U))(lambda spark, d, _kind=_kind: split(d1(spark, d).undirected(), community.detect(d1(spark, d).undirected(), _kind)))
query("community_label_propagation", SPLIT.format(D3))(lambda spark, d: split(d3(spark, d), community.label_propagation(d3(spark, d))))
query("community_fluid", SPLIT.format(D3).replace(", true AS gain", ""))(lambda spark, d: split(d3(spark, d), community.fluid(d3(spark, d))).drop("gain"))
query("community_louvain_weighted", SPLIT.format(D5))(lambda spark, d: split(trade(spark, d), community.keyboard_clusters(derive.nation_trade(spark, d), "louvain", "weight")))

# ---- memberships -------------------------------------------------------------------------------

MEM = "m AS (SELECT c_custkey AS id, c_nationkey::BIGINT AS community FROM customer)"


def membership(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("community"))


@query("apply_membership", f"""WITH {MEM}, s AS (SELECT community, count(*) AS community_size FROM m GROUP BY 1), k AS (SELECT *, (community * 0.618033988749895 - floor(community * 0.618033988749895)) * 6.0 AS h FROM s), f AS (SELECT *, floor(h)::INTEGER AS i, h - floor(h) AS f FROM k)
SELECT m.id, community, community_size, {r('community_size / (SELECT max(community_size) FROM s)::DOUBLE')} AS glow,
{r('CASE WHEN i IN (0, 5) THEN 1 WHEN i IN (1, 2) THEN 1 - f ELSE f END')} AS r, {r('CASE WHEN i IN (0, 3) THEN f WHEN i IN (1, 2) THEN 1 ELSE 1 - f END')} AS g, {r('CASE WHEN i IN (0, 4) THEN 1 - f WHEN i IN (2, 3) THEN f ELSE 1 END')} AS b FROM m JOIN f USING (community)""")
def _(spark, d):
    return rounded(community.apply_membership(membership(spark, d)), "glow", "r", "g", "b")


@query("modularity", f"""WITH {D5}, m AS (SELECT n_nationkey::BIGINT AS id, n_regionkey AS c FROM nation), w AS (SELECT src AS u, weight FROM e UNION ALL SELECT dst, weight FROM e), t AS (SELECT c, sum(weight) AS s FROM w JOIN m ON m.id = w.u GROUP BY c)
SELECT {r('2 * (SELECT sum(weight) FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.c = b.c) / sum(s) - sum(s * s) / (sum(s) * sum(s))')} AS modularity FROM t""")
def _(spark, d):
    m = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("community"))
    return rounded(community.modularity(derive.nation_trade(spark, d), m, "weight"), "modularity")


_ARR = f"WITH {MEM}, w AS (SELECT ceil(sqrt(count(*)))::BIGINT AS w FROM m), p AS (SELECT m.id, community, (m.id % w)::DOUBLE AS x, (m.id // w)::DOUBLE AS y, row_number() OVER (PARTITION BY community ORDER BY m.id) - 1 AS i FROM m, w), c AS (SELECT community, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY 1)"


def _arranged(spark, d, f, **k):
    return rounded(f(layout_geometric.grid(customers(spark, d)), membership(spark, d), **k), "x", "y", "z")


@query("arrange_kececi_2d", f"{_ARR} SELECT id, {_xyz('cx + (i - n / 2.0) * 0.5', 'cy + CASE WHEN i % 2 = 0 THEN 0.5 ELSE -0.5 END')} FROM p JOIN c USING (community)")
def _(spark, d):
    return _arranged(spark, d, community.arrange_kececi)


@query("arrange_tetra_3d", f"{_ARR} SELECT id, {_xyz('cx + (i - n / 2.0) * 0.5', 'cy + CASE WHEN i % 2 = 0 THEN 0.5 ELSE -0.5 END', 'CASE WHEN i % 4 IN (0, 3) THEN 0.5 ELSE -0.5 END')} FROM p JOIN c USING (community)")
def _(spark, d):
    return _arranged(spark, d, community.arrange_kececi, tetra=True)


@query("arrange_compact_start_2d", f"{_ARR}, s AS (SELECT *, ceil(round(sqrt(n), 9))::BIGINT AS side FROM p JOIN c USING (community)) SELECT id, community, i % side AS gx, i // side AS gy, 0::BIGINT AS gz, side FROM s")
def _(spark, d):
    return community.arrange_compact_start(layout_geometric.grid(customers(spark, d)), membership(spark, d)).drop("cx", "cy", "cz")


@query("arrange_compact_start_3d", f"{_ARR}, s AS (SELECT *, ceil(round(cbrt(n), 9))::BIGINT AS side FROM p JOIN c USING (community)) SELECT id, community, i % side AS gx, i // side % side AS gy, i // (side * side) AS gz, side FROM s")
def _(spark, d):
    return community.arrange_compact_start(layout_geometric.grid(customers(spark, d)), membership(spark, d), 3).drop("cx", "cy", "cz")


def _compact(spark, d, dims: int) -> DataFrame:
    g = d1(spark, d).undirected()
    return placed(community.arrange_compact(g, layout_geometric.circle(g.relabel().vertices.select("id")).join(g.relabel().vertices.select("id", "old_id"), "id").select(F.col("old_id").alias("id"), "x", "y", "z"), g.vertices.select("id", (F.col("id") % 4).alias("community")), dims))


for _dims in (2, 3):
    query(f"arrange_compact_{_dims}d", f"WITH {D1U} SELECT id, 1::BIGINT AS places, true AS finite FROM v")(lambda spark, d, _dims=_dims: _compact(spark, d, _dims))


@query("apply_new_graph", _LAYOUTS["layout_sphere"][1].replace(CUST, "c AS (SELECT unnest(range(20)) AS id), n AS (SELECT 20 AS n)"))
def _(spark, d):
    return rounded(generators.apply_new_graph(generators.ring(spark)).vertices, "x", "y", "z")


# ---- rays and animation ----------------------------------------------------------------------------

CHAIN = "e AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON b.id = a.id + 1)"


def chain(spark, d) -> Graph:
    """Embedding points linked in the order of ids."""
    p = derive.points(spark, d)
    a, b = p.select(F.col("id").alias("src")), p.select((F.col("id") - 1).alias("src"), F.col("id").alias("dst"))
    return Graph(p, a.join(b, "src"))


@query("ray_sphere", "WITH " + PTS + ", q AS (SELECT id, (1.0 - z) * -1.0 AS b, x * x + y * y + (1.0 - z) ** 2 - (size * 0.5) ** 2 AS c FROM p)" + f" SELECT id, {r('-b - sqrt(b * b - c)')} AS t FROM q WHERE b * b - c >= 0")
def _(spark, d):
    t = spatial.ray_sphere(lit3((0, 0, 1)), lit3((0, 0, -1)), vec(), F.col("size") * 0.5)
    return rounded(derive.points(spark, d).select("id", t.alias("t")).where("t is not null"), "t")


# ray from (0, 0, 1) along -z against segment p1 -> p2
_SEG = """s AS (SELECT src, dst, a.x AS x1, a.y AS y1, a.z AS z1, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst),
k AS (SELECT *, ux * ux + uy * uy + uz * uz AS a, -uz AS b, ux * x1 + uy * y1 + uz * (z1 - 1) AS d, -(z1 - 1) AS e FROM s), o AS (SELECT *, a - b * b AS det FROM k),
g AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN det < 1e-6 THEN 0.0 ELSE (b * e - d) / det END)) AS sc, CASE WHEN det < 1e-6 THEN CASE WHEN b > 1 THEN d / b ELSE e END ELSE (a * e - b * d) / det END AS t FROM o),
f AS (SELECT src, dst, t, sqrt((x1 + sc * ux) ** 2 + (y1 + sc * uy) ** 2 + (z1 + sc * uz - (1 - t)) ** 2) AS dist FROM g)"""


@query("ray_segment_distance", f"WITH {PTS}, {CHAIN}, {_SEG} SELECT src, dst, {r('dist')} AS dist, {r('t')} AS t FROM f")
def _(spark, d):
    g = chain(spark, d)
    e = spatial._ends(g)
    p1, p2 = (tuple(F.col(f"{c}{k}") for c in "xyz") for k in (1, 2))
    dist, t = spatial.ray_segment(lit3((0, 0, 1)), lit3((0, 0, -1)), p1, p2)
    return rounded(e.select("src", "dst", dist.alias("dist"), t.alias("t")), "dist", "t")


@query("pick_object", f"""WITH {PTS}, {CHAIN}, {_SEG}, q AS (SELECT id, (1.0 - z) * -1.0 AS b, x * x + y * y + (1.0 - z) ** 2 - (size * 0.5) ** 2 AS c FROM p),
u AS (SELECT 'node' AS kind, 0 AS k, id, NULL::BIGINT AS src, NULL::BIGINT AS dst, -b - sqrt(b * b - c) AS t FROM q WHERE b * b - c >= 0 UNION ALL SELECT 'edge', 1, NULL, src, dst, t FROM f WHERE dist < 0.2)
SELECT kind, id, src, dst, {r('t')} AS t FROM u WHERE t > 0 ORDER BY u.t, k, coalesce(id, src), coalesce(dst, 0) LIMIT 1""")
def _(spark, d):
    return rounded(spatial.pick_object(chain(spark, d), (0, 0, 1), (0, 0, -1)), "t")


@query("ray_quad", "WITH " + PTS + f" SELECT id, {r('1 - z')} AS t FROM p WHERE 1 - z > 0 AND abs(x) <= size * 2 AND abs(y) <= size")
def _(spark, d):
    t = spatial.ray_quad(lit3((0, 0, 1)), lit3((0, 0, -1)), vec(), lit3((1, 0, 0)), lit3((0, 1, 0)), F.col("size") * 4, F.col("size") * 2)
    return rounded(derive.points(spark, d).select("id", t.alias("t")).where("t is not null"), "t")


@query("incident_edges", f"WITH {D1}, k AS (SELECT min(id) AS k FROM v) SELECT src, dst, CASE WHEN src = k THEN 1 ELSE -1 END::INTEGER AS direction FROM e, k WHERE src = k OR dst = k")
def _(spark, d):
    g = d1(spark, d)
    return spatial.incident_edges(g, g.vertices.agg(F.min("id")).first()[0])


@query("resolve_position", "WITH " + PTS + f" SELECT id, {_xyz('x + 2', 'y + 3', 'z - 5')} FROM p")
def _(spark, d):
    at = spatial.resolve_position(vec(), spatial.spatial_basis(lit3((0, 0, -1))), lit3((2, 3, 5)))
    return rounded(derive.points(spark, d).select("id", *(c.alias(k) for c, k in zip(at, "xyz"))), "x", "y", "z")


@query("animate_step", f"""WITH {PTS}, {CHAIN}, s AS (SELECT src, dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS n, (src % 10) / 10.0::DOUBLE AS q, CASE WHEN src % 2 = 0 THEN 1 ELSE -1 END AS w FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst),
m AS (SELECT src, dst, w, q + w * CASE WHEN n > 1e-4 THEN 4.2 / n ELSE 4.2 END * 0.05 AS q FROM s)
SELECT src, dst, {r('greatest(0, least(1, q))')} AS progress, (CASE WHEN q < 0 THEN 1 WHEN q > 1 THEN -1 ELSE w END)::INTEGER AS direction FROM m""")
def _(spark, d):
    g = chain(spark, d)
    g = g.with_edges(g.edges.select("src", "dst", ((F.col("src") % 10) / 10.0).alias("progress"), F.when(F.col("src") % 2 == 0, 1).otherwise(-1).alias("direction")))
    return rounded(spatial.animate_step(g, 0.05), "progress")


# ---- style -------------------------------------------------------------------------------------------

_SHAPE = "CASE WHEN d < 4 THEN 'tetrahedron' WHEN d < 6 THEN 'cube' WHEN d < 8 THEN 'octahedron' WHEN d < 12 THEN 'dodecahedron' ELSE 'icosahedron' END"
_DEG = f"WITH {D3}, g AS (SELECT u AS id, count(*) AS d FROM b GROUP BY u)"


@query("shape_class", f"{_DEG} SELECT id, d AS degree, {_SHAPE} AS shape, greatest(3, least(d, 12))::BIGINT AS sides FROM g")
def _(spark, d):
    g = structure.degree(d3(spark, d))
    return g.select("id", "degree", style.shape_class(F.col("degree")).alias("shape"), style.ngon_sides(F.col("degree")).cast("long").alias("sides"))


@query("shape_groups", f"""{_DEG}, s AS (SELECT {_SHAPE} AS shape, count(*) AS c, min(d) AS o FROM g GROUP BY 1) SELECT shape, c AS count, coalesce(sum(c) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM s""")
def _(spark, d):
    return style.shape_groups(structure.degree(d3(spark, d)))


@query("node_instance", "WITH " + PTS + f" SELECT id, {_xyz('x * 1.2', 'y * 1.2', 'z * 1.2')}, {r('greatest(size, 0.1)')} AS size FROM p")
def _(spark, d):
    return rounded(style.node_instance(derive.points(spark, d), 1.2), "x", "y", "z", "size")


@query("size_from_attr", f"SELECT c_custkey AS id, {r('c_acctbal / (SELECT max(c_acctbal) FROM customer)')} AS size FROM customer")
def _(spark, d):
    return rounded(style.size_from_attr(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "c_acctbal").select("id", "size"), "size")


@query("edge_segments", f"""WITH {PTS}, {CHAIN}, k AS (SELECT id, x, y, z, id % 2 AS r, id % 3 AS g, id % 5 AS b FROM p), u AS (SELECT src, dst, 0 AS seq, src AS id FROM e UNION ALL SELECT src, dst, 1, dst FROM e)
SELECT src, dst, seq::INTEGER AS seq, {_xyz('x', 'y', 'z')}, r, g, b, seq::DOUBLE AS normalized_pos FROM u JOIN k USING (id)""")
def _(spark, d):
    g = chain(spark, d)
    v = g.vertices.select("id", "x", "y", "z", *((F.col("id") % m).alias(c) for m, c in ((2, "r"), (3, "g"), (5, "b"))))
    return rounded(style.edge_segments(g.with_vertices(v)), "x", "y", "z")


@query("edge_brightness", "WITH " + PTS + f" SELECT id, {r('(id % 5) * (0.2 + 0.8 * size)')} AS brightness FROM p")
def _(spark, d):
    return rounded(derive.points(spark, d).select("id", style.edge_brightness(F.col("id") % 5, F.col("size")).alias("brightness")), "brightness")


def _route_sql() -> str:
    """The spherical route as SQL, step by step."""
    n3 = lambda a: f"sqrt({a}x * {a}x + {a}y * {a}y + {a}z * {a}z)"
    each = lambda f: ", ".join(f(c) for c in "xyz")
    s = [PTS, CHAIN]
    s.append("j AS (SELECT src, dst, " + each(lambda c: f"a.{c} AS p{c}, b.{c} AS q{c}") + ", a.size AS ps, b.size AS qs FROM e JOIN p a ON a.id = src JOIN p b ON b.id = dst)")
    s.append("k AS (SELECT *, CASE WHEN " + n3("p") + " < 0.001 THEN 1.0 ELSE " + n3("p") + " END + 0.005 AS hr, " + n3("p") + " AS pn, " + n3("q") + " AS qn, sqrt((qx - px) ** 2 + (qy - py) ** 2 + (qz - pz) ** 2) AS dn FROM j)")
    s.append("t AS (SELECT *, " + each(lambda c: f"(q{c} - p{c}) / dn AS d{c}, p{c} / pn AS m{c}, q{c} / qn AS n{c}") + " FROM k)")
    s.append("u AS (SELECT *, dx * mx + dy * my + dz * mz AS dm, -(dx * nx + dy * ny + dz * nz) AS en FROM t)")
    s.append("w AS (SELECT *, " + each(lambda c: f"d{c} - m{c} * dm AS f{c}, -d{c} - n{c} * en AS g{c}") + " FROM u)")
    s.append("x AS (SELECT *, " + n3("f") + " AS fn, " + n3("g") + " AS gn FROM w)")
    s.append("y AS (SELECT *, " + each(lambda c: f"p{c} + f{c} / fn * ps AS ss{c}, q{c} + g{c} / gn * qs AS ds{c}, p{c} + f{c} / fn * ps * 0.45 AS sp{c}, q{c} + g{c} / gn * qs * 0.45 AS dp{c}") + " FROM x)")
    s.append("z AS (SELECT *, " + n3("ss") + " AS sl, " + n3("ds") + " AS dl FROM y)")
    s.append("o AS (SELECT *, acos(ssy / sl) AS a1, acos(dsy / dl) AS a2, atan2(dsz, dsx) AS lo FROM z)")
    pts = [("spx", "spy", "spz"), ("ssx", "ssy", "ssz"), ("ssx / sl * hr", "ssy / sl * hr", "ssz / sl * hr"), ("sin(a1) * cos(lo) * hr", "cos(a1) * hr", "sin(a1) * sin(lo) * hr"), ("sin(a2) * cos(lo) * hr", "cos(a2) * hr", "sin(a2) * sin(lo) * hr"), ("dsx / dl * hr", "dsy / dl * hr", "dsz / dl * hr"), ("dsx", "dsy", "dsz"), ("dpx", "dpy", "dpz")]
    s.append("route AS (" + " UNION ALL ".join(f"SELECT src, dst, {k} AS seq, {a} AS x, {b} AS y, {c} AS z FROM o" for k, (a, b, c) in enumerate(pts)) + ")")
    return ", ".join(s)


@query("edge_route_spherical", f"WITH {_route_sql()} SELECT src, dst, seq::INTEGER AS seq, {_xyz('x', 'y', 'z')} FROM route")
def _(spark, d):
    return rounded(style.edge_route_spherical(chain(spark, d)), "x", "y", "z")


@query("route_normalized_pos", f"""WITH {_route_sql()}, l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER k) ** 2 + (y - lag(y) OVER k) ** 2 + (z - lag(z) OVER k) ** 2), 0) AS step FROM route WINDOW k AS (PARTITION BY src, dst ORDER BY seq))
SELECT src, dst, seq::INTEGER AS seq, {r('sum(step) OVER (PARTITION BY src, dst ORDER BY seq) / sum(step) OVER (PARTITION BY src, dst)')} AS normalized_pos FROM l""")
def _(spark, d):
    out = style.route_normalized_pos(style.edge_route_spherical(chain(spark, d)))
    return rounded(out.select("src", "dst", "seq", "normalized_pos"), "normalized_pos")


@query("label_glyphs", f"SELECT n_nationkey::BIGINT AS id, (i - 1)::INTEGER AS place, substr(n_name, i, 1) AS glyph, {r('(i - 1) * 0.6')} AS dx, {r('0.5 * 1.0 + 0.3')} AS dy FROM (SELECT *, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
def _(spark, d):
    v = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"), F.lit(1.0).alias("size"))
    return rounded(style.label_glyphs(v), "dx", "dy")


@query("remove_overlaps", f"""WITH {PTS}, j AS (SELECT a.id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS n, 0.5 * (a.size + b.size) AS m FROM p a JOIN p b ON a.id <> b.id),
s AS (SELECT id, sum(dx * (m - n) / n) AS mx, sum(dy * (m - n) / n) AS my, sum(dz * (m - n) / n) AS mz FROM j WHERE n < m AND n * n > 1e-4 GROUP BY id)
SELECT p.id, {_xyz('x + coalesce(mx, 0)', 'y + coalesce(my, 0)', 'z + coalesce(mz, 0)')}, {r('size')} AS size FROM p LEFT JOIN s ON s.id = p.id""")
def _(spark, d):
    return rounded(style.remove_overlaps(derive.points(spark, d)), "x", "y", "z", "size")


@query("platonic_mesh")
def _(spark, d):
    rows = [(s, k, *map(float, p)) for _, s in style.SHAPES for k, p in enumerate(style.platonic_mesh(s))]
    return spark.createDataFrame(rows, "solid string, vertex int, x double, y double, z double")


@query("hud_row", f"WITH {D3} SELECT 'Layout: Sphere | Cluster: Louvain | Nodes: ' || (SELECT count(*) FROM v) || ' | Edges: ' || (SELECT count(*) FROM e) AS status")
def _(spark, d):
    return style.hud_row(d3(spark, d), "Sphere", "Louvain")


_VALUES = ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in registry.CATALOG)


@query("commands", f"SELECT * FROM (VALUES {_VALUES}) t(category_path, command_id, display_name)")
def _(spark, d):
    return registry.commands(spark)


@query("menu", f"WITH c AS (SELECT DISTINCT category_path, string_split(trim(category_path), '/') AS p FROM (VALUES {_VALUES}) t(category_path, command_id, display_name)) SELECT category_path, (i - 1)::INTEGER AS depth, p[i] AS label FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM c)")
def _(spark, d):
    return registry.menu(spark)


# ---- parts of the layered sphere ------------------------------------------------------------------------


@query("ls_comm_stats", f"WITH {_DEG[5:]}, m AS (SELECT id, id % 7 AS community, d FROM g) SELECT community, {r('avg(d)')} AS avg_coreness, count(*) AS size FROM m GROUP BY 1")
def _(spark, d):
    g = structure.degree(d3(spark, d))
    out = layered_sphere.community_stats(g.select("id", F.col("degree").alias("coreness")), g.select("id", (F.col("id") % 7).alias("community")))
    return rounded(out, "avg_coreness")


_SIZES = [(k, 30 + (k * 37) % 50) for k in range(40)]
_SPHERES = "(VALUES " + ", ".join(f"({a}, {b})" for a, b in _SIZES) + ") t(i, size)"


@query("ls_sphere_assign", f"""WITH RECURSIVE t AS (SELECT i::BIGINT AS i, size FROM {_SPHERES}), z AS (SELECT (SELECT size FROM t WHERE i = 0) AS nucleus, greatest(15, trunc(0.015 * ((SELECT sum(size) FROM t) - (SELECT size FROM t WHERE i = 0)))::BIGINT) AS base),
k(i, sphere, load) AS (SELECT 0::BIGINT, 0, size FROM t WHERE i = 0 UNION ALL
  SELECT t.i, CASE WHEN load + size > CASE WHEN sphere = 0 THEN nucleus ELSE base * sphere * sphere END THEN sphere + 1 ELSE sphere END, CASE WHEN load + size > CASE WHEN sphere = 0 THEN nucleus ELSE base * sphere * sphere END THEN size ELSE load + size END FROM k JOIN t ON t.i = k.i + 1, z)
SELECT i AS community, sphere::INTEGER AS sphere FROM k""")
def _(spark, d):
    return spark.createDataFrame(layered_sphere.assign_spheres(_SIZES), "community long, sphere int")


@query("ls_radius", f"""WITH RECURSIVE c AS (SELECT i AS s, size AS n FROM {_SPHERES} WHERE i < 12), k(s, radius) AS (SELECT 0, greatest(5.0, sqrt(40.0 * n / (4 * pi()))) FROM c WHERE s = 0 UNION ALL
  SELECT c.s, greatest(radius + 8 + 20 / log2(c.s + 2), sqrt(40.0 * n / (4 * pi()))) FROM k JOIN c ON c.s = k.s + 1) SELECT s::INTEGER AS sphere, {r('radius')} AS radius FROM k""")
def _(spark, d):
    return rounded(spark.createDataFrame(list(layered_sphere.sphere_radii(dict(_SIZES[:12])).items()), "sphere int, radius double"), "radius")


def _hilbert_sql(x: str, y: str) -> str:
    """The curve round by round, as a chain of subqueries."""
    q = f"SELECT *, ({x})::INTEGER AS hx, ({y})::INTEGER AS hy, 0::INTEGER AS hd FROM src"
    s = layered_sphere.GRID // 2
    while s:
        q = f"""SELECT * EXCLUDE (hx, hy, hd, rx, ry, fx, fy), CASE WHEN ry = 0 THEN fy ELSE fx END AS hx, CASE WHEN ry = 0 THEN fx ELSE fy END AS hy, hd + {s} * {s} * xor(3 * rx, ry) AS hd
          FROM (SELECT *, CASE WHEN ry = 0 AND rx = 1 THEN {s} - 1 - hx ELSE hx END AS fx, CASE WHEN ry = 0 AND rx = 1 THEN {s} - 1 - hy ELSE hy END AS fy
          FROM (SELECT *, CASE WHEN (hx & {s}) > 0 THEN 1 ELSE 0 END AS rx, CASE WHEN (hy & {s}) > 0 THEN 1 ELSE 0 END AS ry FROM ({q})))"""
        s //= 2
    return q


@query("hilbert_index", f"WITH src AS (SELECT c_custkey AS id, (c_custkey * 7919 % 32768) AS gx, (c_custkey * 104729 % 32768) AS gy FROM customer) SELECT id, hd AS h FROM ({_hilbert_sql('gx', 'gy')})")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return c.select("id", layered_sphere.hilbert_index(F.col("id") * 7919 % 32768, F.col("id") * 104729 % 32768).alias("h"))


@query("ls_slots", f"""WITH i AS (SELECT unnest(range(90)) AS i), a AS (SELECT i, acos(1 - 2 * (i + 0.5::DOUBLE) / 90) AS phi, pi() * (1 + sqrt(5)) * i AS th FROM i), src AS (SELECT *, th - 2 * pi() * floor(th / (2 * pi())) AS turn FROM a),
q AS ({_hilbert_sql('floor(turn / (2 * pi()) * 32767)', 'floor(phi / pi() * 32767)')})
SELECT 0::INTEGER AS sphere, (row_number() OVER (ORDER BY hd, i) - 1)::INTEGER AS slot, {_xyz('sin(phi) * cos(th) * 5', 'sin(phi) * sin(th) * 5', 'cos(phi) * 5')}, hd AS h FROM q""")
def _(spark, d):
    s = spark.createDataFrame([(0, 5.0, 90)], "sphere int, radius double, slots int")
    return rounded(layered_sphere.slots(spark, s), "x", "y", "z")


@query("intra_degree", f"WITH {D3} SELECT v.id, count(b.u) FILTER (WHERE b.u % 3 = b.v % 3)::BIGINT AS intra_degree FROM v LEFT JOIN b ON b.u = v.id GROUP BY v.id")
def _(spark, d):
    g = d3(spark, d)
    return layered_sphere.intra_degree(g, g.vertices.select("id", (F.col("id") % 3).alias("community")))


@query("ls_initial_slot", f"""WITH {_DEG[5:]}, o AS (SELECT id, id % 3 AS sphere, row_number() OVER (PARTITION BY id % 3 ORDER BY id % 5, d DESC, id) - 1 AS i, count(*) OVER (PARTITION BY id % 3) AS n FROM g)
SELECT id, sphere::INTEGER AS sphere, least(5000 - 1, i * (5000 // n))::BIGINT AS slot FROM o""")
def _(spark, d):
    g = structure.degree(d3(spark, d))
    placed = g.select("id", (F.col("id") % 3).cast("int").alias("sphere"), (F.col("id") % 5).alias("community"), F.col("degree").alias("intra_degree"), F.lit(0.0).alias("transitivity"))
    return layered_sphere.initial_slots(placed, spark.createDataFrame([(s, 5000) for s in range(3)], "sphere int, slots int"))


@query("davidson_harel_parameters", f"""WITH {D3}, c AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m), q AS (SELECT n, 2.0::DOUBLE * m / (n * (n - 1)) AS dens FROM c)
SELECT trunc(greatest(10, log2(n)))::BIGINT AS fineiter, {r('dens / 10')} AS weight_edge_length, {r('1 - sqrt(dens)')} AS weight_edge_crossing, {r('(1 - dens) / 5')} AS weight_node_edge FROM q""")
def _(spark, d):
    s = d3(spark, d).summary().first()
    q = layout_force.davidson_harel_parameters(s["node_count"], s["edge_count"])
    return rounded(spark.createDataFrame([tuple(q.values())], "fineiter long, weight_edge_length double, weight_edge_crossing double, weight_node_edge double"), "weight_edge_length", "weight_edge_crossing", "weight_node_edge")


@query("forceatlas2_parameters", f"WITH {D3}, c AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m) SELECT least(1500, trunc(50 + 2 * sqrt(n)))::BIGINT AS rounds, {r('1 + ln(1 + m) / 10')} AS scaling, {r('1 + sqrt(n) / 100')} AS gravity FROM c")
def _(spark, d):
    s = d3(spark, d).summary().first()
    q = layout_force.forceatlas2_parameters(s["node_count"], s["edge_count"])
    return rounded(spark.createDataFrame([tuple(q.values())], "rounds long, scaling double, gravity double"), "scaling", "gravity")


@query("fluid_count", f"WITH {D3}, c AS (SELECT count(*) AS n FROM v) SELECT greatest(1, least(floor(sqrt(n / 2.0))::BIGINT + 1, n - 1))::BIGINT AS k FROM c")
def _(spark, d):
    return spark.createDataFrame([(community.fluid_count(d3(spark, d).vertices.count()),)], "k long")


@query("barycentre_order", f"""WITH {D3}, ly AS (SELECT id, (id % 4)::INTEGER AS layer FROM v), m AS (SELECT b.u AS id, avg(b.v) AS m FROM b JOIN ly x ON x.id = b.u JOIN ly y ON y.id = b.v WHERE y.layer = x.layer - 1 GROUP BY 1)
SELECT ly.id, layer, (row_number() OVER (PARTITION BY layer ORDER BY coalesce(m, ly.id::DOUBLE), ly.id) - 1)::INTEGER AS place FROM ly LEFT JOIN m ON m.id = ly.id""")
def _(spark, d):
    g = d3(spark, d)
    return layout_force.barycentre_order(g, g.vertices.select("id", (F.col("id") % 4).cast("int").alias("layer")))


@query("uniform_random", f"SELECT c_custkey AS id, {uniform('c_custkey', 'c_nationkey', 5)} AS u FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(uniform("c_custkey", "c_nationkey", 5)).alias("u"))


@query("graphml_round_trip", f"WITH {D3}, k AS (SELECT id AS old, row_number() OVER (ORDER BY id) - 1 AS id FROM v) SELECT x.id AS src, y.id AS dst FROM e JOIN k x ON x.old = src JOIN k y ON y.old = dst")
def _(spark, d):
    import uuid

    from .plans.storage import checkpoint_root
    from .sources.graphml import read_graphml, write_graphml

    path = f"{checkpoint_root(spark)}/graphml-{uuid.uuid4().hex}"
    write_graphml(d3(spark, d), path)
    return read_graphml(spark, path).edges.select("src", "dst")
