"""The command catalog, and commands as functions of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .jobs import Runner
from .operators import centrality, community, generators, layered_sphere, layout_force, layout_geometric, paths, structure
from .sources.graphml import read_graphml, write_graphml

# Menu category, command and title of the catalog.
CATALOG: list[tuple[str, str, str]] = [
    ("File", "file_new", "New Graph"),
    ("File", "file_open", "Open Graph"),
    ("File", "file_save", "Save Graph"),
    ("File", "app_exit", "Exit"),
    ("Generate/Deterministic Graphs", "igraph_ring", "Ring"),
    ("Generate/Deterministic Graphs", "igraph_star", "Star"),
    ("Generate/Deterministic Graphs", "igraph_kary_tree", "Tree"),
    ("Generate/Deterministic Graphs", "igraph_square_lattice", "Lattice"),
    ("Generate/Deterministic Graphs", "igraph_full", "Full Graph (Clique)"),
    ("Generate/Deterministic Graphs", "igraph_cycle_graph", "Circle"),
    ("Generate/Deterministic Graphs", "igraph_famous", "Notable Graphs"),
    ("Generate/Stochastic Graphs", "igraph_erdos_renyi_game_gnp", "Erdős-Rényi (GNP / GNM)"),
    ("Generate/Stochastic Graphs", "igraph_barabasi_game", "Barabási-Albert (Preferential attachment)"),
    ("Generate/Stochastic Graphs", "igraph_watts_strogatz_game", "Watts-Strogatz (Small-world)"),
    ("Generate/Stochastic Graphs", "igraph_forest_fire_game", "Forest Fire"),
    ("Generate/Stochastic Graphs", "igraph_tree_game", "Random Tree"),
    ("Generate/Stochastic Graphs", "igraph_degree_sequence_game", "Degree Sequence"),
    ("Generate/Bipartite Graphs", "igraph_bipartite_game_gnm", "Generate Random Bipartite"),
    ("Generate/Bipartite Graphs", "igraph_bipartite_projection", "Create Bipartite Projections"),
    ("Generate/Spatial Graphs", "igraph_nearest_neighbor_graph", "Geometric random graphs"),
    ("Generate/Spatial Graphs", "igraph_gabriel_graph", "Gabriel graphs"),
    ("Layout/Force-Directed", "igraph_layout_fruchterman_reingold_3d", "Fruchterman-Reingold (3D)"),
    ("Layout/Force-Directed", "igraph_layout_fruchterman_reingold", "Fruchterman-Reingold (2D)"),
    ("Layout/Force-Directed", "igraph_layout_kamada_kawai_3d", "Kamada-Kawai (3D)"),
    ("Layout/Force-Directed", "igraph_layout_kamada_kawai", "Kamada-Kawai (2D)"),
    ("Layout/Force-Directed", "igraph_layout_drl_3d", "Distributed Recursive Layout (DrL) (3D)"),
    ("Layout/Force-Directed", "igraph_layout_drl", "Distributed Recursive Layout (DrL) (2D)"),
    ("Layout/Force-Directed", "igraph_layout_davidson_harel", "Davidson-Harel"),
    ("Layout/Force-Directed", "igraph_layout_graphopt", "GraphOpt"),
    ("Layout/Force-Directed", "igraph_layout_lgl", "Large Graph Layout (LGL)"),
    ("Layout/Force-Directed", "igraph_layout_gem", "GEM"),
    ("Layout/Force-Directed", "igraph_layout_forceatlas2_3d", "ForceAtlas2 (3D)"),
    ("Layout/Force-Directed", "igraph_layout_yifan_hu", "Yifan Hu"),
    ("Layout/Force-Directed", "igraph_layout_yifan_hu_3d", "Yifan Hu (3D)"),
    ("Layout/Tree & Hierarchical", "igraph_layout_reingold_tilford", "Reingold-Tilford"),
    ("Layout/Tree & Hierarchical", "igraph_layout_sugiyama", "Sugiyama"),
    ("Layout/Tree & Hierarchical", "igraph_layout_sugiyama_radial", "Radial Sugiyama"),
    ("Layout", "lay_layered_sphere", "Layered Sphere"),
    ("Layout/Geometric", "igraph_layout_circle", "Circle (3D)"),
    ("Layout/Geometric", "igraph_layout_circle_2d", "Circle (2D)"),
    ("Layout/Geometric", "igraph_layout_star", "Star"),
    ("Layout/Geometric", "igraph_layout_grid_3d", "Grid (3D)"),
    ("Layout/Geometric", "igraph_layout_grid", "Grid (2D)"),
    ("Layout/Geometric", "igraph_layout_sphere", "Sphere"),
    ("Layout/Geometric", "igraph_layout_random_3d", "Random (3D)"),
    ("Layout/Geometric", "igraph_layout_random", "Random (2D)"),
    ("Layout/Bipartite", "igraph_layout_mds", "MDS"),
    ("Layout/Bipartite", "igraph_layout_bipartite", "Sugiyama (Bipartite)"),
    ("Layout/Bipartite", "igraph_layout_bipartite_simple", "Bipartite (Simple)"),
    ("Layout/Dimension Reduction ", "igraph_layout_umap_2d", "UMAP (2D)"),
    ("Layout/Dimension Reduction ", "igraph_layout_umap_3d", "UMAP (3D)"),
    ("Analysis/Centrality", "igraph_degree", "Degree"),
    ("Analysis/Centrality", "igraph_closeness_cutoff", "Closeness"),
    ("Analysis/Centrality", "igraph_betweenness", "Betweenness"),
    ("Analysis/Centrality", "igraph_eigenvector_centrality", "Eigenvector Centrality"),
    ("Analysis/Centrality", "igraph_pagerank", "PageRank"),
    ("Analysis/Centrality", "igraph_hub_and_authority_scores", "HITS (Hub)"),
    ("Analysis/Centrality", "igraph_harmonic_centrality", "Harmonic"),
    ("Analysis/Centrality", "igraph_strength", "Strength (Weighted Degree)"),
    ("Analysis/Centrality", "igraph_constraint", "Constraint (Structural Holes)"),
    ("Analysis/Global Properties", "igraph_diameter", "Diameter"),
    ("Analysis/Global Properties", "igraph_radius", "Radius"),
    ("Analysis/Global Properties", "igraph_average_path_length", "Average Path Length"),
    ("Analysis/Global Properties", "igraph_assortativity_degree", "Assortativity"),
    ("Analysis/Global Properties", "igraph_density", "Density"),
    ("Analysis/Global Properties", "igraph_transitivity_undirected", "Transitivity (undirected)"),
    ("Communities/Detection", "igraph_community_multilevel", "Louvain Method (Multilevel)"),
    ("Communities/Detection", "igraph_community_leiden", "Leiden"),
    ("Communities/Detection", "igraph_community_walktrap", "Walktrap (Random walks)"),
    ("Communities/Detection", "igraph_community_edge_betweenness", "Edge Betweenness (Girvan-Newman)"),
    ("Communities/Detection", "igraph_community_fastgreedy", "Fast Greedy"),
    ("Communities/Detection", "igraph_community_infomap", "Infomap"),
    ("Communities/Detection", "igraph_community_label_propagation", "Label Propagation"),
    ("Communities/Detection", "igraph_community_spinglass", "Spinglass"),
    ("Communities/Detection", "igraph_community_leading_eigenvector", "Leading Eigenvector"),
    ("Communities/Detection", "igraph_community_optimal_modularity", "Optimal Modularity"),
    ("Communities/Detection", "igraph_community_voronoi", "Voronoi"),
    ("Communities/Detection", "igraph_community_fluid_communities", "Fluid Communities"),
]

COMMANDS: dict[str, Callable] = {}


def register(command_id: str):
    """Adds a function (graph, **options) under a command's name."""

    def add(f: Callable) -> Callable:
        COMMANDS[command_id] = f
        return f

    return add


def _generator(f: Callable) -> Callable:
    return lambda graph, **k: f(graph.vertices.sparkSession, **k)


for _id, _f in {
    "igraph_ring": generators.ring, "igraph_star": generators.star, "igraph_kary_tree": generators.kary_tree, "igraph_square_lattice": generators.lattice,
    "igraph_full": generators.full, "igraph_cycle_graph": generators.cycle, "igraph_famous": generators.famous, "igraph_erdos_renyi_game_gnp": generators.gnp,
    "igraph_barabasi_game": generators.barabasi, "igraph_watts_strogatz_game": generators.watts_strogatz, "igraph_forest_fire_game": generators.forest_fire,
    "igraph_tree_game": generators.random_tree, "igraph_degree_sequence_game": generators.degree_sequence, "igraph_bipartite_game_gnm": generators.bipartite_gnm,
    "igraph_nearest_neighbor_graph": generators.geometric, "igraph_gabriel_graph": generators.gabriel,
}.items():
    COMMANDS[_id] = _generator(_f)
COMMANDS["igraph_bipartite_projection"] = generators.bipartite_projection
for _id, _kind in {
    "fruchterman_reingold_3d": "fr_3d", "fruchterman_reingold": "fr", "kamada_kawai_3d": "kk_3d", "kamada_kawai": "kk", "drl_3d": "drl_3d", "drl": "drl",
    "davidson_harel": "davidson_harel", "graphopt": "graphopt", "lgl": "lgl", "gem": "gem", "forceatlas2_3d": "forceatlas2_3d", "yifan_hu": "yifan_hu",
    "yifan_hu_3d": "yifan_hu_3d", "reingold_tilford": "reingold_tilford", "sugiyama": "sugiyama", "sugiyama_radial": "sugiyama_radial", "mds": "mds",
    "bipartite": "bipartite", "bipartite_simple": "bipartite_simple", "umap_2d": "umap_2d", "umap_3d": "umap_3d",
}.items():
    COMMANDS[f"igraph_layout_{_id}"] = lambda graph, _kind=_kind, **k: layout_force.layout(graph, _kind, **k)
COMMANDS["lay_layered_sphere"] = layered_sphere.layout
for _id, _f in {"circle": layout_geometric.circle, "circle_2d": layout_geometric.circle, "star": layout_geometric.star, "grid_3d": layout_geometric.grid_3d, "grid": layout_geometric.grid, "sphere": layout_geometric.sphere, "random_3d": layout_geometric.random_3d, "random": layout_geometric.random_2d}.items():
    COMMANDS[f"igraph_layout_{_id}"] = lambda graph, _f=_f, **k: _f(graph.vertices, **k)
for _id, _f in {
    "degree": centrality.degree, "closeness_cutoff": paths.closeness, "betweenness": paths.betweenness, "eigenvector_centrality": centrality.eigenvector, "pagerank": centrality.pagerank,
    "hub_and_authority_scores": centrality.hits, "harmonic_centrality": paths.harmonic, "strength": centrality.strength, "constraint": centrality.constraint,
    "diameter": paths.diameter, "radius": paths.radius, "average_path_length": paths.average_path_length, "assortativity_degree": structure.assortativity, "density": structure.density, "transitivity_undirected": structure.transitivity,
    "community_label_propagation": community.label_propagation, "community_fluid_communities": community.fluid,
}.items():
    COMMANDS[f"igraph_{_id}"] = _f
for _id, _kind in {"multilevel": "louvain", "leiden": "leiden", "walktrap": "walktrap", "edge_betweenness": "edge_betweenness", "fastgreedy": "fast_greedy", "infomap": "infomap", "spinglass": "spinglass", "leading_eigenvector": "leading_eigenvector", "optimal_modularity": "optimal_modularity", "voronoi": "voronoi"}.items():
    COMMANDS[f"igraph_community_{_id}"] = lambda graph, _kind=_kind, **k: community.detect(graph, _kind, **k)


@register("file_new")
def _new(graph: Graph) -> Graph:
    """A graph without vertices or edges."""
    spark = graph.vertices.sparkSession
    return Graph(spark.createDataFrame([], "id long"), spark.createDataFrame([], "src long, dst long"))


@register("file_open")
def _open(graph: Graph | None, path: str, spark: SparkSession | None = None, **options) -> Graph:
    """The graph of a GraphML file; the graph open so far, or a session, says where to read."""
    return read_graphml(spark or graph.vertices.sparkSession, path, **options)


@register("file_save")
def _save(graph: Graph, path: str) -> Graph:
    """Writes GraphML to a folder that file_open reads, and gives the graph back."""
    write_graphml(graph, path)
    return graph


@register("app_exit")
def _exit(graph: Graph | None, runner: Runner) -> Runner:
    """Cancels the jobs of a runner that have not ended and closes it; the session stays with its owner."""
    for job in runner.jobs:
        if job.status in ("PENDING", "RUNNING"):
            runner.cancel(job)
    runner.close()
    return runner


def run(graph: Graph, command_id: str, **options):
    """The result of a catalog command: a graph or a DataFrame."""
    if command_id not in COMMANDS:
        raise KeyError(f"no command {command_id!r} with a computation")
    return COMMANDS[command_id](graph, **options)


def commands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG, "category_path string, command_id string, display_name string")


def menu(spark: SparkSession) -> DataFrame:
    """(category_path, depth, label): the levels of the menu tree above each command."""
    parts = F.posexplode(F.split(F.trim("category_path"), "/")).alias("depth", "label")
    return commands(spark).select("category_path", parts).distinct()
