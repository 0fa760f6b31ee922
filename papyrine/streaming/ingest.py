"""Streaming counterparts: deduplicated ingest into the cache, query-log windows, running edge counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import content_hash
from papyrine.operators.cache import newest_fetch, upsert
from papyrine.operators.graph import position_pairs
from papyrine.sources.sinks import exists, swap


def file_stream(spark: SparkSession, path: str, schema: str | object, most_files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def fresh_papers(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Papers whose content was not seen within the watermark of fetched_at; state is bounded by it."""
    keyed = stream.withColumn("_hash", content_hash(F.col("title"), F.col("abstract")))
    return keyed.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that brings the cache at `path` up to date; repeating a batch changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = newest_fetch(batch)
        state = spark.read.parquet(path) if exists(spark, path) else new.limit(0)  # the first batch finds no table
        swap(upsert(state, new, ["paper_id", "source"]), path)

    return apply


def query_windows(log: DataFrame, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """(start, source, runs, results): runs in tumbling windows of ran_at, closed by the watermark."""
    w = log.withWatermark("ran_at", late).groupBy(F.window("ran_at", width), F.lower(F.trim("source")).alias("source"))
    return w.agg(F.count("*").alias("runs"), F.sum("result_count").alias("results")).select(F.col("window.start").alias("start"), "source", "runs", "results")


def edge_counts(entities: DataFrame) -> DataFrame:
    """Running edge weights of a stream of (paper_id, genes, diseases); weights add up, so batches may come in any order."""
    names = F.concat(F.array_distinct("genes"), F.array_distinct("diseases"))
    return position_pairs(entities.select(names.alias("all"))).groupBy("a", "b").agg(F.count("*").alias("weight"))
