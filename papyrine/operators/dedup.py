"""Exact-key deduplication with a preferred source and a merge log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import content_hash, key_of, plain_doi


def dedup_keys(papers: DataFrame, prefer: str = "pubmed") -> DataFrame:
    """Papers with `_key` (identifier, else content) and `_order` (preferred source, then position).

    A paper with an identifier never merges with one without. `pos` gives the input order; if it is
    missing, the id does. A row without title and abstract hash alike only with its like.
    """
    doi = plain_doi(F.col("doi"))
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("hash:"), content_hash(F.col("title"), F.col("abstract"))))
    pos = F.col("pos") if "pos" in papers.columns else F.col("paper_id")
    order = F.struct(F.when(key_of(F.col("source")) == prefer.lower(), 0).otherwise(1).alias("prefer"), pos.alias("pos"), F.col("source").alias("src"))
    return papers.withColumn("_key", key).withColumn("_order", order)


def deduplicate(papers: DataFrame, prefer: str = "pubmed") -> tuple[DataFrame, DataFrame]:
    """(kept papers, merge log (kept_id, kept_source, dropped)).

    The winner of a key is found by partial aggregation, so a key may hold any share of the rows.
    """
    keyed = dedup_keys(papers, prefer)
    columns = papers.columns
    won = keyed.groupBy("_key").agg(F.min_by(F.struct(*columns, "_order"), F.col("_order")).alias("w"))
    kept = won.select("w.*").drop("_order")
    lead = won.select("_key", F.col("w._order").alias("_first"), F.col("w.paper_id").alias("kept_id"), F.col("w.source").alias("kept_source"))
    log = keyed.join(lead, "_key").where("_order <> _first").select("kept_id", "kept_source", F.concat_ws(":", "source", "paper_id").alias("dropped"))
    return kept, log
