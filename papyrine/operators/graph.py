"""Weighted co-occurrence graph as three relations: nodes, edges (a < b) and provenance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import stored


@dataclass
class Graph:
    """nodes (entity, label, paper_count), edges (a, b, weight), provenance (entity, paper_id) or None."""

    nodes: DataFrame
    edges: DataFrame
    provenance: DataFrame | None = None


def build(entities: DataFrame) -> Graph:
    """The graph of (paper_id, genes, diseases). Every row is one processing of a paper.

    A node counts distinct papers; an edge counts the pairs of list positions in all rows, so a name that
    is both gene and disease of a paper counts twice with the others. Equal pairs are summed before the shuffle.
    """
    none = F.array().cast("array<string>")
    genes, diseases = F.array_distinct(F.coalesce("genes", none)), F.array_distinct(F.coalesce("diseases", none))
    rows = entities.select("paper_id", genes.alias("g"), diseases.alias("d"), F.concat(genes, diseases).alias("all"))
    marks = F.concat(F.transform("g", lambda x: F.struct(x.alias("entity"), F.lit(0).alias("k"))), F.transform("d", lambda x: F.struct(x.alias("entity"), F.lit(1).alias("k"))))
    seen = rows.select("paper_id", F.explode(marks).alias("m")).select("paper_id", "m.entity", "m.k")
    # the first label in order of papers; genes come before diseases within a paper
    nodes = seen.groupBy("entity").agg(F.when(F.min_by("k", F.struct("paper_id", "k")) == 0, "GENE").otherwise("DISEASE").alias("label"), F.count_distinct("paper_id").alias("paper_count"))
    edges = position_pairs(rows.select("all")).groupBy("a", "b").agg(F.count("*").alias("weight"))
    return Graph(nodes, edges, seen.select("entity", "paper_id").distinct())


def position_pairs(rows: DataFrame) -> DataFrame:
    """The other columns with (a, b), a < b, for every two positions of the list `all` with different values.

    The two positions are generated one after the other, so no row ever holds all pairs of a list.
    """
    rest = [c for c in rows.columns if c != "all"]
    first = rows.where(F.size("all") > 1).select(*rest, "all", F.explode(F.sequence(F.lit(1), F.size("all") - 1)).alias("i"))
    both = first.select(*rest, F.element_at("all", F.col("i")).alias("x"), F.explode(F.slice("all", F.col("i") + 1, F.size("all"))).alias("y"))
    return both.where("x <> y").select(*rest, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def degrees(g: Graph) -> DataFrame:
    """(entity, label, degree, centrality): degree over the other nodes; 1 in a graph of one node."""
    n = g.nodes.count()
    ends = g.edges.select(F.explode(F.array("a", "b")).alias("entity")).groupBy("entity").agg(F.count("*").alias("degree"))
    degree = F.coalesce("degree", F.lit(0))
    return g.nodes.join(ends, "entity", "left").select("entity", "label", degree.alias("degree"), (degree / (n - 1) if n > 1 else F.lit(1.0)).alias("centrality"))


def top_entities(g: Graph, label: str | None = None, top: int = 10) -> DataFrame:
    rows = degrees(g)
    return (rows if label is None else rows.where(F.col("label") == label)).orderBy(F.col("centrality").desc(), "entity").limit(top)


def top_edges(g: Graph, top: int = 20) -> DataFrame:
    return g.edges.orderBy(F.col("weight").desc(), "a", "b").limit(top)


def neighbours(g: Graph, entity: str) -> DataFrame:
    """(neighbour, weight) of an entity, heaviest first."""
    hit = g.edges.where((F.col("a") == entity) | (F.col("b") == entity))
    return hit.select(F.when(F.col("a") == entity, F.col("b")).otherwise(F.col("a")).alias("neighbour"), "weight").orderBy(F.col("weight").desc(), "neighbour")


def typed_edges(g: Graph) -> DataFrame:
    """(a, b, type_a, type_b, weight)."""
    t = g.nodes.select("entity", "label")
    return g.edges.join(t.withColumnRenamed("entity", "a").withColumnRenamed("label", "type_a"), "a").join(t.withColumnRenamed("entity", "b").withColumnRenamed("label", "type_b"), "b").select("a", "b", "type_a", "type_b", "weight")


def gene_disease_edges(g: Graph) -> DataFrame:
    """(gene, disease, weight)."""
    e = typed_edges(g).where(F.col("type_a") != F.col("type_b"))
    first = F.col("type_a") == "GENE"
    return e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("gene"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("disease"), "weight")


def ego(g: Graph, entity: str, depth: int = 1) -> Graph:
    """Everything within `depth` hops, by joining the frontier with the edges."""
    start = entity.lower()
    both = g.edges.select("a", "b").unionByName(g.edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = g.nodes.where(F.col("entity") == start).select("entity")
    for _ in range(depth):
        step = both.join(seen.withColumnRenamed("entity", "a"), "a", "left_semi").select(F.col("b").alias("entity"))
        seen = stored(seen.unionByName(step).distinct(), "ego")
    edges = g.edges.join(seen.withColumnRenamed("entity", "a"), "a", "left_semi").join(seen.withColumnRenamed("entity", "b"), "b", "left_semi").select("a", "b", "weight")
    return Graph(g.nodes.join(seen, "entity", "left_semi"), edges)


def components(g: Graph, rounds: int = 60) -> DataFrame:
    """(entity, root): connected components by the smallest label, with pointer jumping; isolated nodes are their own."""
    both = stored(g.edges.select("a", "b").unionByName(g.edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = stored(g.nodes.select("entity", F.col("entity").alias("root")), "label")
    for _ in range(rounds):
        near = both.join(label, both.b == label.entity).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label.entity == near.a, "left").select("entity", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("mid"))
        far = label.select(F.col("entity").alias("k"), F.col("root").alias("far"))
        step = stored(step.join(far, step.mid == far.k, "left").select("entity", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")), "label")
        label = step.select("entity", "root")
        if not step.where("old <> root").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def prune(g: Graph, least: int = 2) -> Graph:
    """Without lighter edges, and without nodes that then have none."""
    edges = g.edges.where(F.col("weight") >= least)
    ends = edges.select(F.explode(F.array("a", "b")).alias("entity")).distinct()
    return Graph(g.nodes.join(ends, "entity", "left_semi"), edges, g.provenance)


def merge(x: Graph, y: Graph) -> Graph:
    """Weights summed; a node of both counts its distinct papers if both know them, the sum otherwise."""
    edges = x.edges.select("a", "b", "weight").unionByName(y.edges.select("a", "b", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    one = x.nodes.select("entity", "label", "paper_count", F.lit(0).alias("side")).unionByName(y.nodes.select("entity", "label", "paper_count", F.lit(1).alias("side")))
    nodes = one.groupBy("entity").agg(F.min_by("label", "side").alias("label"), F.sum("paper_count").alias("paper_count"), F.count("*").alias("sides"))
    if x.provenance is None or y.provenance is None:
        return Graph(nodes.drop("sides"), edges)
    origin = x.provenance.unionByName(y.provenance).distinct()
    known = origin.groupBy("entity").agg(F.count("*").alias("papers"))
    nodes = nodes.join(known, "entity", "left").select("entity", "label", F.when(F.col("sides") > 1, F.coalesce("papers", "paper_count")).otherwise(F.col("paper_count")).alias("paper_count"))
    return Graph(nodes, edges, origin)


def summary(g: Graph) -> DataFrame:
    """One row: nodes, edges, genes, diseases, density, components, largest component, gene-disease pairs, hubs."""
    n = g.nodes.agg(F.count("*").alias("total_nodes"), F.count_if(F.col("label") == "GENE").alias("gene_nodes"), F.count_if(F.col("label") == "DISEASE").alias("disease_nodes"))
    e = g.edges.agg(F.count("*").alias("total_edges"))
    d = degrees(g).agg(F.count_if((F.col("label") == "GENE") & (F.col("centrality") >= 0.3)).alias("hub_genes"), F.count_if((F.col("label") == "DISEASE") & (F.col("centrality") >= 0.3)).alias("hub_diseases"))
    c = components(g).groupBy("root").count().agg(F.count("*").alias("connected_components"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_component_size"))
    gd = gene_disease_edges(g).agg(F.count("*").alias("gene_disease_pairs"))
    one = n
    for part in (e, d, c, gd):  # tables of one row
        one = one.join(F.broadcast(part), F.lit(True))
    nodes, edges = F.col("total_nodes"), F.col("total_edges")
    return one.withColumn("density", F.round(F.when(nodes > 1, 2 * edges / (nodes * (nodes - 1))).otherwise(0.0), 6))


def to_node_link(g: Graph) -> DataFrame:
    """(kind, json): the graph as lines of node and link objects."""
    nodes = g.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("entity").alias("id"), F.col("label").alias("entity_type"), "paper_count")).alias("json"))
    return nodes.unionByName(g.edges.select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("a").alias("source"), F.col("b").alias("target"), "weight")).alias("json")))


def from_node_link(lines: DataFrame) -> Graph:
    """The graph of such lines; it has no provenance."""
    n = lines.where("kind = 'node'").select(F.from_json("json", "id string, entity_type string, paper_count long").alias("j"))
    e = lines.where("kind = 'link'").select(F.from_json("json", "source string, target string, weight long").alias("j"))
    return Graph(n.select(F.col("j.id").alias("entity"), F.col("j.entity_type").alias("label"), "j.paper_count"), e.select(F.least("j.source", "j.target").alias("a"), F.greatest("j.source", "j.target").alias("b"), "j.weight"))


def to_dot(g: Graph, top: int = 150) -> str:
    """Graphviz text of the `top` heaviest edges (a report: the limit is the feature)."""
    rows = typed_edges(g).orderBy(F.col("weight").desc(), "a", "b").limit(top).collect()
    kinds = {r[c]: r[t] for r in rows for c, t in (("a", "type_a"), ("b", "type_b"))}
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"  {quote(k)} [fillcolor={'lightblue' if t == 'GENE' else 'salmon'}];" for k, t in sorted(kinds.items())]
    lines += [f"  {quote(r['a'])} -- {quote(r['b'])} [label={r['weight']}];" for r in rows]
    return "graph G {\n  node [style=filled];\n" + "\n".join(lines) + "\n}\n"


def batch_summary(entities: DataFrame, g: Graph) -> DataFrame:
    """One row: papers processed, edges added or updated, nodes and edges of the graph."""
    done = entities.agg(F.count("*").alias("papers_processed"))
    touched = g.edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("edges_added_or_updated"), F.count("*").alias("total_edges"))
    nodes = g.nodes.agg(F.count("*").alias("total_nodes"))
    return done.join(F.broadcast(touched), F.lit(True)).join(F.broadcast(nodes), F.lit(True))  # tables of one row


def grouped_metrics(entities: DataFrame, keys: list[str], hub: float = 0.3) -> DataFrame:
    """(keys, nodes, edges, gene_disease_pairs, hub_genes, hub_diseases, density) of one graph for every group of rows.

    `entities`: the keys, paper_id, genes, diseases. All graphs are built in the same few aggregations.
    """
    none = F.array().cast("array<string>")
    genes, diseases = F.array_distinct(F.coalesce("genes", none)), F.array_distinct(F.coalesce("diseases", none))
    rows = entities.select(*keys, "paper_id", genes.alias("g"), diseases.alias("d"), F.concat(genes, diseases).alias("all"))
    marks = F.concat(F.transform("g", lambda x: F.struct(x.alias("entity"), F.lit(0).alias("k"))), F.transform("d", lambda x: F.struct(x.alias("entity"), F.lit(1).alias("k"))))
    seen = rows.select(*keys, "paper_id", F.explode(marks).alias("m")).select(*keys, "paper_id", "m.entity", "m.k")
    nodes = seen.groupBy(*keys, "entity").agg((F.min_by("k", F.struct("paper_id", "k")) == 0).alias("gene"))
    edges = position_pairs(rows.select(*keys, "all")).distinct()
    ends = edges.select(*keys, F.explode(F.array("a", "b")).alias("entity")).groupBy(*keys, "entity").agg(F.count("*").alias("degree"))
    size = nodes.groupBy(*keys).agg(F.count("*").alias("nodes"))
    known = nodes.join(ends, [*keys, "entity"], "left").join(size, keys)
    centrality = F.when(F.col("nodes") > 1, F.coalesce("degree", F.lit(0)) / (F.col("nodes") - 1)).otherwise(1.0)
    hubs = known.groupBy(*keys).agg(F.max("nodes").alias("nodes"), F.count_if(F.col("gene") & (centrality >= hub)).alias("hub_genes"), F.count_if(~F.col("gene") & (centrality >= hub)).alias("hub_diseases"))
    kind = nodes.select(*keys, "entity", "gene")
    typed = edges.join(kind.withColumnRenamed("entity", "a").withColumnRenamed("gene", "ga"), [*keys, "a"]).join(kind.withColumnRenamed("entity", "b").withColumnRenamed("gene", "gb"), [*keys, "b"])
    counts = typed.groupBy(*keys).agg(F.count("*").alias("edges"), F.count_if(F.col("ga") != F.col("gb")).alias("gene_disease_pairs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    density = F.when(F.col("nodes") > 1, 2 * F.coalesce("edges", F.lit(0)) / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    every = entities.select(*keys).distinct().join(hubs, keys, "left").join(counts, keys, "left")
    return every.select(*keys, zero("nodes"), zero("edges"), zero("gene_disease_pairs"), zero("hub_genes"), zero("hub_diseases"), F.round(F.coalesce(density, F.lit(0.0)), 6).alias("density"))
