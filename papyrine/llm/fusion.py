"""One ranking from several differently-scaled scores: reciprocal rank fusion.

Every method ranks its items on its own; an item's fused value is the sum over methods of
1 / (constant + rank). Only orders enter, so no method counts more for having larger numbers.

Defined results: a row with a null query, item or method is no evidence and is left out. Of an
item's repeated rows in one method the best score counts (null only if all are null). Items
without a score rank after those with one, by their stated rank. Equal scores share the mean of
their places (mid-ranks), so ties do not depend on names; equal fused values are ordered by item.
Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from papyrine.llm.common import ranked

#: The usual constant of reciprocal rank fusion; it damps the lead of the first places.
CONSTANT = 60.0


def method_ranks(scores: DataFrame) -> DataFrame:
    """(query_id, paper_id, method, score, place): mid-ranks within each query and method.

    `scores` has query_id, paper_id, method, score and paper_rank. A query may hold any share of
    the rows: places come from a distributed rank, ties from a pre-aggregated table.
    """
    best = (
        scores.select("query_id", "paper_id", "method", F.col("score").cast("double").alias("score"), F.col("paper_rank").cast("int").alias("paper_rank"))
        .where("query_id is not null and paper_id is not null and method is not null")
        .withColumn("score", F.when(~F.isnan("score"), F.col("score")))
        .groupBy("query_id", "method", "paper_id")
        .agg(F.max("score").alias("score"), F.min("paper_rank").alias("paper_rank"))
        .withColumn("tie", F.when(F.col("score").isNull(), F.coalesce("paper_rank", F.lit(2147483647))).otherwise(0))
    )
    placed = ranked(best, ["query_id", "method"], [F.col("score").desc_nulls_last(), F.col("tie"), F.col("paper_id")], "row")
    tied = placed.groupBy("query_id", "method", "score", "tie").agg(F.avg("row").alias("place"))
    tied = tied.select(*[F.col(c).alias(f"t_{c}") for c in ("query_id", "method", "score", "tie")], "place")
    cond = F.col("score").eqNullSafe(F.col("t_score"))
    for c in ("query_id", "method", "tie"):
        cond = cond & (F.col(c) == F.col(f"t_{c}"))
    return placed.join(tied, cond).select("query_id", "paper_id", "method", "score", "row", "place")


def _summed(places: DataFrame, constant: float) -> DataFrame:
    """(query_id, paper_id, fused, methods): the sum of 1 / (constant + place)."""
    total = places.groupBy("query_id", "paper_id").agg(F.sum(1.0 / (F.lit(constant) + F.col("place"))).alias("fused"), F.count("*").cast("int").alias("methods"))
    return total.withColumn("fused", F.round("fused", 12))


def fused(places: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """(query_id, paper_id, fused, methods, fused_rank) from places per method."""
    return ranked(_summed(places, constant), ["query_id"], [F.col("fused").desc(), F.col("paper_id")], "fused_rank")


def sheet_scores(sheet: DataFrame) -> DataFrame:
    """The ranks of a pooled label sheet as scores: a smaller rank is a larger score."""
    each = [
        sheet.select("query_id", "paper_id", F.lit(m).alias("method"), (-F.col(f"{m}_rank")).cast("double").alias("score"), F.col(f"{m}_rank").alias("paper_rank")).where(F.col(f"{m}_rank").isNotNull())
        for m in ("tfidf", "biobert")
    ]
    return each[0].unionByName(each[1])


def leaders(places: DataFrame, depth: int = 3, constant: float = CONSTANT) -> DataFrame:
    """(query_id, paper_id): the first of the fused order of the `depth` best of every method, where it alone is in all of them.

    The lists that are fused hold at most `depth` papers of each method, so a query's fused order is
    short whatever its rows. A paper in all lists stands before any that is missing in one (for up to
    31 methods and the usual constant); the exact check that follows asks whether place one is in all lists and
    place two is not.
    """
    n_methods = places.groupBy("query_id").agg(F.countDistinct("method").alias("n_methods")).where("n_methods >= 2")
    top = places.where((F.col("row") <= depth) & F.col("score").isNotNull()).withColumn("place", F.col("row"))
    order = W.Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "paper_id")
    short = _summed(top, constant).withColumn("fused_rank", F.row_number().over(order)).withColumn("next", F.lead("methods").over(order))
    first = short.where("fused_rank = 1").join(n_methods, "query_id")
    return first.where("methods = n_methods and coalesce(next, 0) < n_methods").select("query_id", "paper_id")
