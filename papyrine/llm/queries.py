"""The queries of this package, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import cooccur, distinctive, fusion, leakage, linkage, packing, survivor, truncation, vectors
from papyrine.llm.common import table
from papyrine.session import scratch, stored, tidy

TERM = r"^[a-z]{6,}$"
DIM = 768


@tidy
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.linked(table(spark, d, "papers")).select("paper_id_a", "paper_id_b")


@tidy
def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of works with their confidence."""
    return linkage.linked(table(spark, d, "papers"))


def _works(papers: DataFrame) -> DataFrame:
    return stored(linkage.works(linkage.scored_pairs(papers)), "works", release=True)


@tidy
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    return survivor.sole_values(survivor.winners(papers, _works(papers)))


@tidy
def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for every work of two or more ids."""
    papers = table(spark, d, "papers")
    return survivor.survivors(papers, _works(papers))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.record_terms(table(spark, d, "papers"), "paper_id", ["title", "abstract"], ["keywords_json"])


def _named(terms: DataFrame) -> DataFrame:
    return terms.withColumn("doc", F.when(~F.col("doc").startswith("\x00"), F.col("doc")))


@tidy
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = _named(distinctive.characteristic(_terms(spark, d), TERM, least_tf=3, most_df=5))
    return found.where("tf >= 3 and df <= 5 and doc is not null").select(F.col("doc").alias("paper_id"), "term").distinct()


@tidy
def p3_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every term of every row, terms of at least two documents."""
    return _named(distinctive.scored(_terms(spark, d), min_df=2)).select("row_key", F.col("doc").alias("paper_id"), "term", "tf", "df", F.round("score", 9).alias("score"))


def _pairs(spark: SparkSession, d: str) -> cooccur.PairTable:
    """The pair table saved after the earlier nine tenths of the rows, opened again and given the later ones."""
    path = scratch(spark, "pair-table")
    first, then = cooccur.increments(table(spark, d, "paper_entities"), "paper_id", ["genes_json", "diseases_json"], "extracted_at")
    cooccur.PairTable(spark, path).add(first)
    return cooccur.PairTable(spark, path).add(then)


@tidy
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s = _pairs(spark, d).scores(least=10)
    return s.where(F.col("n_ab") * F.col("n") >= 5 * F.col("n_a") * F.col("n_b")).select("item_a", "item_b")


@tidy
def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs with counts and how far they exceed chance, as they stand in the pair table after two saved increments."""
    return _pairs(spark, d).scores().select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


@tidy
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return fusion.leaders(fusion.method_ranks(table(spark, d, "search_results")))


@tidy
def p5_order(spark: SparkSession, d: str) -> DataFrame:
    """The fused order of the papers of every query."""
    return fusion.fused(fusion.method_ranks(table(spark, d, "search_results"))).withColumn("fused", F.round("fused", 9))


@tidy
def p5_sheet_order(spark: SparkSession, d: str) -> DataFrame:
    """The same from the ranks of the label sheet."""
    return fusion.fused(fusion.method_ranks(fusion.sheet_scores(table(spark, d, "relevance_sheet")))).withColumn("fused", F.round("fused", 9))


@tidy
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    vecs = vectors.usable(table(spark, d, "embedding_cache"), "paper_id", "model_id", "vector_blob", DIM)
    reps, members = vectors.classes(vecs, 5)
    near = vectors.neighbours(reps, 5, least=0.85, dim=DIM)
    return vectors.mutual(vectors.expanded(near, members, 5), 0.85).select("paper_id_a", "paper_id_b")


@tidy
def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar papers of every paper whose number is divisible by 100, against all papers."""
    vecs = vectors.usable(table(spark, d, "embedding_cache"), "paper_id", "model_id", "vector_blob", DIM)
    reps, members = vectors.classes(vecs, 5)
    asked = vectors.holders(vecs).where(F.regexp_extract("id", r"(\d+)(?:v\d+)?$", 1).try_cast("long") % 100 == 0)
    near = vectors.neighbours(reps, 5, dim=DIM, queries=asked)
    found = vectors.expanded(near, members, 5, asked)
    return found.select(F.col("id_a").alias("paper_id"), F.col("id_b").alias("neighbour"), F.round("sim", 4).alias("cosine"))


@tidy
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The sequence and place of every document, each source with its share of the input in every window."""
    return packing.packed(packing.token_sizes(table(spark, d, "documents")))


@tidy
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How near every run of 64 windows comes to the stated target: the same share of tokens for each source."""
    return packing.mixture_report(packing.packed(packing.token_sizes(table(spark, d, "documents")), mixture=packing.EVEN), packing.EVEN)


@tidy
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("by = 'words'").select("doc_id", "item_id").distinct()


@tidy
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The leaks with what part of the item stands there and how it was changed, re-parameterised ones included."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


@tidy
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged(table(spark, d, "documents")).where("cut").select("doc_id").distinct()


@tidy
def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.by_source(truncation.judged(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_confidence, p2_found, p2_records, p3_found, p3_scores, p4_found, p4_pairs, p5_found, p5_order, p5_sheet_order, p6_found, p6_neighbours, p7_packed, p7_mixture, p8_found, p8_leaks, p9_found, p9_sources)}
