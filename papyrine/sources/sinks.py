"""Writers: swap-in tables, label sheets, TREC and BEIR exports, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.text import strip


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _at(spark, old)
    if not fs.rename(at, _at(spark, new)[1]):
        raise OSError(f"{old} could not be renamed")


def swap(df: DataFrame, path: str) -> None:
    """Writes a whole relation beside the old one and renames it into place.

    The old relation stays whole until the new one is written whole; if the new one can't be put in its
    place, the old one is put back. Between the two renames there is no table: readers that must not meet
    that moment read a version (`publish`, `current`).
    """
    spark = df.sparkSession
    old, new, gone = path.rstrip("/"), f"{path.rstrip('/')}.{uuid.uuid4().hex}.new", f"{path.rstrip('/')}.{uuid.uuid4().hex}.old"
    df.write.parquet(new)
    had = exists(spark, old)
    if had:
        _move(spark, old, gone)
    try:
        _move(spark, new, old)
    except Exception:
        if had:
            _move(spark, gone, old)
        raise
    if had:
        fs, at = _at(spark, gone)
        fs.delete(at, True)


def publish(df: DataFrame, path: str) -> str:
    """Writes a whole relation as the next version below `path`; it counts from its success mark on, so readers see the old or the new one."""
    spark = df.sparkSession
    last = _versions(spark, path)
    name = f"{path.rstrip('/')}/v-{(last[-1] if last else 0) + 1:09d}"
    df.write.mode("overwrite").parquet(name)
    return name


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _at(spark, f"{path.rstrip('/')}/v-*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in fs.globStatus(at) or [])


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version below `path`."""
    return spark.read.parquet(f"{path.rstrip('/')}/v-{_versions(spark, path)[-1]:09d}")


def sheet_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def qrels_lines(sheet: DataFrame) -> DataFrame:
    """TREC judgments of a label sheet as text lines; an unlabeled row is an error."""
    label = F.when(F.col("relevant").isNull(), F.raise_error(F.lit("a row has no label"))).otherwise(F.col("relevant"))
    return sheet.select(F.concat_ws("\t", "query_id", F.lit("0"), F.concat_ws(":", strip(F.col("source")), strip(F.col("paper_id"))), label.cast("string")).alias("value"))


def run_lines(sheet: DataFrame, method: str, depth: int = 10) -> DataFrame:
    """TREC run lines of one method of a label sheet, score 1 / rank."""
    rank = F.col(f"{method}_rank")
    doc = F.concat_ws(":", strip(F.col("source")), strip(F.col("paper_id")))
    return sheet.where(rank <= depth).select(F.format_string("%s Q0 %s %d %.6f %s", F.col("query_id"), doc, rank, 1.0 / rank, F.lit(method)).alias("value"))


def beir_tables(sheet: DataFrame, mode: str = "none", papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a label sheet. `mode`: none, preview or full (looked up in `papers`; a missing one is an error)."""
    doc = F.concat_ws(":", strip(F.col("source")), strip(F.col("paper_id")))
    rows = sheet.withColumn("_id", doc)
    first = rows.groupBy("_id").agg(F.min_by(F.struct("title", "abstract_preview", "source", "paper_id", "url"), F.struct("query_id", "title")).alias("r")).select("_id", "r.*")
    if mode == "full":
        text = papers.select("source", "paper_id", F.col("abstract").alias("full"))
        first = first.join(text, ["source", "paper_id"], "left").withColumn("text", F.when(F.coalesce(strip(F.col("full")), F.lit("")) == "", F.raise_error(F.concat(F.lit("no full abstract: "), F.col("_id")))).otherwise(strip(F.col("full"))))
    else:
        first = first.withColumn("text", strip(F.coalesce("abstract_preview", F.lit(""))) if mode == "preview" else F.lit(""))
    corpus = first.select("_id", F.coalesce("title", F.lit("")).alias("title"), "text", F.struct("source", "paper_id", "url").alias("metadata"))
    queries = rows.groupBy(F.col("query_id").alias("_id")).agg(F.min("query_text").alias("text"))
    return corpus, queries, rows.select(F.col("query_id").alias("query-id"), F.col("_id").alias("corpus-id"), F.col("relevant").alias("score")).distinct()


def candidate_rows(sheet: DataFrame) -> DataFrame:
    """The pooled papers of a sheet as an export without labels."""
    doc = F.concat_ws(":", strip(F.col("source")), strip(F.col("paper_id")))
    return sheet.select(F.col("query_id").alias("qid"), doc.alias("docid"), "source", "paper_id", "title", "url")


def metric_rows(per: DataFrame) -> DataFrame:
    """Per-query metrics as text with four places."""
    four = lambda c: F.format_string("%.4f", F.col(c)).alias(c)
    return per.select("qid", "system", four("p_at"), four("mrr"), four("ndcg"), four("unjudged"))


def result_json(results: DataFrame, preview: int | None = None) -> DataFrame:
    """Ranked papers as JSON lines; abstracts whole or cut to a preview."""
    text = F.col("abstract") if preview is None else F.concat(F.substring("abstract", 1, preview), F.lit("..."))
    return results.select(F.to_json(F.struct("rank", "score", "method", "paper_id", "source", "title", text.alias("abstract"))).alias("value"))


def edge_list(typed: DataFrame) -> DataFrame:
    """Edge list lines with types, heaviest first."""
    return typed.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), "type_a", "type_b", "weight").orderBy(F.col("weight").desc(), "entity_a", "entity_b")


def report(summary: list[dict], contrast: dict) -> str:
    """The findings as Markdown: a table of methods, and a sentence that claims no more than test and interval support."""
    lines = ["# Findings", "", "| method | queries | mean connectivity | mean score | mean seconds |", "|---|---|---|---|---|"]
    lines += [f"| {r['method']} | {r['n']} | {r['mean_gcs']:.1f} | {r['mean_score']:.4f} | {r['mean_runtime']:.3f} |" for r in summary]
    if contrast:
        low, high = contrast["ci95"]
        verdict = "The difference is supported by both the sign test and the interval." if contrast["significant"] else "The difference is not statistically supported."
        p = "n/a" if contrast["sign_test_p"] is None else f"{contrast['sign_test_p']:.4f}"
        lines += ["", f"Mean difference {contrast['mean_delta']:.2f}, 95 % interval [{low:.2f}, {high:.2f}], sign test p = {p}. {verdict}"]
    return "\n".join(lines) + "\n"


def summary_json(grid: DataFrame, run: dict) -> DataFrame:
    """An evaluation run as one JSON document: what it was (`run`), and the rows of its grid in order."""
    rows = F.array_sort(F.collect_list(F.struct(*sorted(grid.columns, key=lambda c: (c != "query_id", c != "method", c)))))
    head = [F.lit(v).alias(k) for k, v in run.items()]
    return grid.agg(rows.alias("results")).select(F.to_json(F.struct(*head, F.size("results").alias("n_results"), "results")).alias("value"))


def precision_recall_json(per: DataFrame) -> DataFrame:
    """Per-query precision and recall of each method and their means (query_id, method, precision, recall), as one JSON document."""
    four = lambda c: F.round(c, 4)
    rows = per.select("query_id", "method", four("precision").alias("precision"), four("recall").alias("recall"))
    means = per.groupBy("method").agg(four(F.avg("precision")).alias("precision"), four(F.avg("recall")).alias("recall"))
    a = rows.agg(F.array_sort(F.collect_list(F.struct("query_id", "method", "precision", "recall"))).alias("queries"))
    b = means.agg(F.array_sort(F.collect_list(F.struct("method", "precision", "recall"))).alias("means"))
    return a.join(b, F.lit(True)).select(F.to_json(F.struct("queries", "means")).alias("value"))  # one row each


def manifest_json(files: DataFrame) -> DataFrame:
    """The manifest (path, sha256, bytes) as one JSON document, files in order of path."""
    return files.agg(F.array_sort(F.collect_list(F.struct("path", "sha256", "bytes"))).alias("files")).select(F.to_json(F.struct(F.size("files").alias("n_files"), "files")).alias("value"))
