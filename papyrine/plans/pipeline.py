"""The whole analytic as one plan: papers, entities, graph, rankings and the evaluation grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import combined_text, string_list
from papyrine.operators import entities as E
from papyrine.operators import graph as G
from papyrine.operators import metrics as M


def paper_entities(papers: DataFrame, patterns: DataFrame, cached: DataFrame | None = None, statistical: bool = False) -> DataFrame:
    """(paper_id, genes, diseases): cached lists where there are some, extraction for the rest, headings fused into both.

    `papers`: paper_id, title, abstract, keywords_json. `cached`: (paper_id, genes, diseases).
    """
    todo, known = papers, None
    if cached is not None:
        hit, todo = E.missing(papers, cached)
        known = cached.join(hit.select("paper_id").distinct(), "paper_id", "left_semi").select("paper_id", "genes", "diseases")
    docs = todo.select("paper_id", combined_text(F.col("title"), F.col("abstract")).alias("text"))
    found = E.extract(docs, patterns, statistical)
    every = found if known is None else known.unionByName(found)
    headings = papers.select("paper_id", E.heading_diseases(string_list(F.col("keywords_json"))).alias("headings")).groupBy("paper_id").agg(F.first("headings").alias("headings"))
    return E.fuse(every, headings)


def knowledge_graph(papers: DataFrame, patterns: DataFrame, cached: DataFrame | None = None) -> G.Graph:
    return G.build(paper_entities(papers, patterns, cached))


def evaluation_grid(results: DataFrame, entities: DataFrame, depth: int = 10) -> DataFrame:
    """One row for every query and method: score statistics over all results, graph metrics over the first `depth`.

    `results`: query_id, method, paper_id, score, paper_rank; `entities`: paper_id, genes, diseases.
    """
    one = results.groupBy("query_id", "method", "paper_id").agg(F.max("score").alias("score"), F.min("paper_rank").alias("paper_rank"))
    scores = M.score_stats(one, ["query_id", "method"])
    top = one.where(F.col("paper_rank") <= depth).select("query_id", "method", "paper_id")
    graphs = G.grouped_metrics(top.join(entities, "paper_id"), ["query_id", "method"])
    joined = scores.join(graphs, ["query_id", "method"], "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("nodes", "edges", "gene_disease_pairs", "hub_genes", "hub_diseases")]
    return joined.select("query_id", "method", "mean_score", "top_score", "spread", *zero, F.coalesce("density", F.lit(0.0)).alias("density"))


def contrast(grid: DataFrame) -> dict:
    """The paired comparison of graph connectivity between the two methods, over the queries both answered."""
    pairs = M.paired(grid, "gene_disease_pairs", "tfidf", "biobert").orderBy("query_id")
    return M.contrast(pairs.toPandas())  # one row a query
