"""Retrieval metrics, agreement, paired statistics and the evaluation grid."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from papyrine.functions.text import strip

DEPTH = 10


def ranked_run(run: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(system, qid, docid, place): the first `depth` documents of each query by rank, ties by id."""
    by = W.Window.partitionBy("system", "qid").orderBy("rank", "docid")
    return run.withColumn("place", F.row_number().over(by)).where(F.col("place") <= depth).select("system", "qid", "docid", "place")


def query_metrics(run: DataFrame, qrels: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(system, qid, p_at, mrr, ndcg, unjudged), unrounded. `run`: system, qid, docid, rank; `qrels`: qid, docid, grade."""
    top = ranked_run(run, depth).join(qrels.select("qid", "docid", "grade"), ["qid", "docid"], "left")
    grade = F.coalesce("grade", F.lit(0))
    per = top.groupBy("system", "qid").agg(
        (F.count_if(grade >= 1) / depth).alias("p_at"),
        F.coalesce(1.0 / F.min(F.when(grade >= 1, F.col("place"))), F.lit(0.0)).alias("mrr"),
        F.sum(grade / F.log2(F.col("place") + 1)).alias("dcg"),
        (F.count_if(F.col("grade").isNull()) / depth).alias("unjudged"),
    )
    by = W.Window.partitionBy("qid").orderBy(F.col("grade").desc(), "docid")
    ideal = qrels.withColumn("i", F.row_number().over(by)).where(F.col("i") <= depth).groupBy("qid").agg(F.sum(F.col("grade") / F.log2(F.col("i") + 1)).alias("idcg"))
    ndcg = F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)
    return per.join(ideal, "qid", "left").select("system", "qid", "p_at", "mrr", ndcg.alias("ndcg"), "unjudged")


def missing_queries(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(system, qid): judged queries a system does not rank."""
    systems = run.select("system").distinct()
    want = qrels.select("qid").distinct().join(F.broadcast(systems), F.lit(True))  # systems are a handful
    return want.join(run.select("system", "qid").distinct(), ["system", "qid"], "left_anti")


def pooled_precision_recall(sheet: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, method, precision, recall, in_top, relevant_in_top, pooled_relevant), four places.

    The recall's denominator is what is relevant in the union of both methods' first `depth`.
    """
    pool = F.least(F.coalesce("tfidf_rank", F.lit(depth + 1)), F.coalesce("biobert_rank", F.lit(depth + 1))) <= depth
    relevant = F.coalesce(F.col("relevant") == 1, F.lit(False))
    total = F.count_distinct(F.when(pool & relevant, F.struct("source", "paper_id")))
    out: DataFrame | None = None
    for m in ("tfidf", "biobert"):
        top = F.coalesce(F.col(f"{m}_rank") <= depth, F.lit(False))
        hit = F.count_if(top & relevant)
        one = sheet.groupBy("query_id").agg(
            F.lit(m).alias("method"),
            F.round(hit / depth, 4).alias("precision"),
            F.round(F.when(total > 0, hit / total).otherwise(0.0), 4).alias("recall"),
            F.count_if(top).alias("in_top"),
            hit.alias("relevant_in_top"),
            total.alias("pooled_relevant"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def pool(results: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, source, paper_id, tfidf_rank, biobert_rank): union of both methods' first `depth` results."""
    top = results.where(F.col("paper_rank") <= depth)
    rank = lambda m: F.min(F.when(F.col("method") == m, F.col("paper_rank"))).alias(f"{m}_rank")
    return top.groupBy("query_id", "source", "paper_id").agg(rank("tfidf"), rank("biobert"))


def pool_complete(sheet: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query_id, method, complete): whether the ranks 1 to `depth` occur exactly once each."""
    out: DataFrame | None = None
    for m in ("tfidf", "biobert"):
        r = F.col(f"{m}_rank")
        ok = (F.count_if(r <= depth) == depth) & (F.count_distinct(F.when(r.between(1, depth), r)) == depth)
        one = sheet.groupBy("query_id").agg(F.lit(m).alias("method"), ok.alias("complete"))
        out = one if out is None else out.unionByName(one)
    return out


def score_stats(rows: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Mean, best and population deviation of scores; 0 for none."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.groupBy(*keys).agg(zero(F.avg(score)).alias("mean_score"), zero(F.max(score)).alias("top_score"), zero(F.stddev_pop(score)).alias("spread"))


def confusion(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(tp, fp, fn, tn, n, agreement, kappa) of 0/1 columns human and proposed, for each of `keys`."""
    h, p = F.col("human"), F.col("proposed")
    cells = [F.count_if((h == a) & (p == b)).alias(k) for k, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]
    t = pairs.groupBy(*(keys or [])).agg(*cells).withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    po = (F.col("tp") + F.col("tn")) / F.col("n")
    pe = ((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn"))) / (F.col("n") * F.col("n"))
    kappa = F.when(pe >= 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    known = F.col("n") > 0
    return t.withColumn("agreement", F.when(known, F.round(po, 6))).withColumn("kappa", F.when(known, F.round(kappa, 6)))


def cohen_kappa(a: list[int], b: list[int]) -> float:
    """Kappa of two short label lists."""
    if not a or len(a) != len(b):
        raise ValueError("two lists of the same length are needed")
    n = len(a)
    po = sum(x == y for x, y in zip(a, b, strict=True)) / n
    pe = sum((a.count(v) / n) * (b.count(v) / n) for v in set(a) | set(b))
    return (1.0 if po == 1 else 0.0) if pe >= 1 else (po - pe) / (1 - pe)


def sign_test(wins: int, losses: int) -> float | None:
    """Exact two-sided sign test without ties; None if all are ties."""
    n = wins + losses
    if n == 0:
        return None
    return min(1.0, 2.0 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n)


def bootstrap_index_ci(deltas: list[float], rounds: int = 5000, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the mean by index, from Python's generator (the connectivity contrast)."""
    rng, n = random.Random(seed), len(deltas)
    means = sorted(sum(deltas[rng.randrange(n)] for _ in range(n)) / n for _ in range(rounds))
    return means[int(0.025 * (rounds - 1))], means[int(0.975 * (rounds - 1))]


def bootstrap_ci(values: list[float], rounds: int = 1000, seed: int = 2026) -> tuple[float, float]:
    """Percentile interval of the mean with interpolation, from NumPy's generator (the retrieval metrics)."""
    x = np.asarray(values, dtype=float)
    if not len(x):
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    means = [x[rng.integers(0, len(x), len(x))].mean() for _ in range(rounds)]
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def wilcoxon(a: list[float], b: list[float]) -> float | None:
    """Two-sided signed-rank test: zeros dropped, mid-ranks, tie-corrected normal tail; None if all differences are zero."""
    d = np.asarray(a, dtype=float) - np.asarray(b, dtype=float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return None
    size = np.abs(d)
    values, counts = np.unique(size, return_counts=True)
    last = np.cumsum(counts)
    ranks = (last - (counts - 1) / 2)[np.searchsorted(values, size)]
    w = ranks[d > 0].sum()
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    low = min(w, n * (n + 1) / 2 - w)
    return float(math.erfc(abs((low - mean) / math.sqrt(var)) / math.sqrt(2))) if var > 0 else 1.0


def paired(rows: DataFrame, value: str, first: str, second: str, key: str = "query_id", method: str = "method") -> DataFrame:
    """(key, first, second, delta) of queries both methods answered."""
    pick = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    return rows.groupBy(key).agg(pick(first).alias("first"), pick(second).alias("second")).where("first is not null and second is not null").withColumn("delta", F.col("second") - F.col("first"))


def sign_counts(pairs: DataFrame) -> DataFrame:
    """(n_pairs, wins, losses, ties, mean_delta, p): the sign test inside Spark, the binomial tail by logarithms of factorials."""
    c = pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"), F.round(F.avg("delta"), 6).alias("mean_delta"))
    n, k = (F.col("wins") + F.col("losses")).cast("int"), F.least("wins", "losses").cast("int")
    ln = lambda m: F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda s, i: s + F.when(i > 0, F.log(i)).otherwise(0.0))
    tail = F.aggregate(F.sequence(F.lit(0), k), F.lit(0.0), lambda s, i: s + F.exp(ln(n) - ln(i) - ln(n - i) - n * F.log(F.lit(2.0))))
    return c.withColumn("p", F.when(n > 0, F.round(F.least(F.lit(1.0), 2 * tail), 6)))


def significant(p: float | None, ci: tuple[float, float] | None, alpha: float = 0.05) -> bool:
    """Both the test and the interval must speak for a difference."""
    return p is not None and ci is not None and p < alpha and not ci[0] <= 0 <= ci[1]


def contrast(pairs: pd.DataFrame) -> dict:
    """The paired summary of one metric; `pairs` holds first, second and delta of some tens of queries."""
    d = pairs["delta"].tolist()
    if not d:
        return {}
    wins, losses = sum(x > 0 for x in d), sum(x < 0 for x in d)
    p, ci = sign_test(wins, losses), bootstrap_index_ci(d)
    return {"n_pairs": len(d), "wins": wins, "losses": losses, "ties": len(d) - wins - losses, "mean_delta": sum(d) / len(d), "ci95": ci, "sign_test_p": p, "significant": significant(p, ci)}


def cold_warm(rows: DataFrame) -> DataFrame:
    """(method, cold_query, cold_seconds, warm_mean, warm_n): the first successful run of each method against the rest."""
    good = rows.where("error is null")
    first = good.groupBy("method").agg(F.min_by(F.struct("query_id", "runtime", "run_order"), "run_order").alias("cold"))
    joined = good.join(first, "method")
    warm = F.col("run_order") > F.col("cold.run_order")
    return joined.groupBy("method", "cold").agg(F.avg(F.when(warm, F.col("runtime"))).alias("warm_mean"), F.count_if(warm).alias("warm_n")).select("method", F.col("cold.query_id").alias("cold_query"), F.col("cold.runtime").alias("cold_seconds"), "warm_mean", "warm_n")


def method_summary(rows: DataFrame) -> DataFrame:
    """(method, n, mean_gcs, mean_score, mean_runtime): rows with an error left out."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.where("error is null").groupBy("method").agg(F.count_distinct("query_id").alias("n"), mean("gcs").alias("mean_gcs"), mean("mean_score").alias("mean_score"), mean("runtime").alias("mean_runtime"))


def winner(first: Column, second: Column, a: str = "tfidf", b: str = "biobert") -> Column:
    return F.when(first > second, a).when(second > first, b).otherwise("tie")


def provenance(notes: Column) -> Column:
    """Where a label came from, by the beginning of its note."""
    n = strip(F.coalesce(notes, F.lit("")))
    return (
        F.when(n.startswith("reviewed:"), "author_reviewed")
        .when(n.startswith("rule:"), "no_abstract_rule")
        .when(n.startswith("accepted:"), "proposed_audited_accepted")
        .when(n.startswith("proposed:"), "proposed_unreviewed")
        .when(n.startswith("NEEDS_HUMAN"), "author_labeled_after_abstain")
        .otherwise("human")
    )


def shuffled(rows: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Rows with `shuffle_pos`, a seeded order within each query that does not depend on partitions."""
    h = F.xxhash64(F.lit(seed), *keys)
    return rows.withColumn("shuffle_pos", F.row_number().over(W.Window.partitionBy("query_id").orderBy(h, *keys)))


def sampled(rows: DataFrame, share: float, seed: int, keys: list[str]) -> DataFrame:
    """A seeded sample of exactly max(1, round(n * share)) rows."""
    n = rows.count()
    return rows.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(max(1, round(n * share)) if n else 0)


def join_judgments(sheet: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(joined, unknown answers, unanswered open rows, repeated answers) on (query_id, docid)."""
    key = ["query_id", "docid"]
    keyed = sheet.withColumn("docid", F.concat_ws(":", "source", "paper_id"))
    repeated = answers.groupBy(*key).count().where("count > 1")
    return keyed.join(answers, key), answers.join(keyed, key, "left_anti"), keyed.where("relevant is null").join(answers, key, "left_anti"), repeated


def summary_table(per: pd.DataFrame, metrics: tuple[str, ...] = ("p_at", "mrr", "ndcg")) -> pd.DataFrame:
    """Means with intervals for each system, and contrasts of two systems with Wilcoxon and sign test.

    `per`: one row for each system and query (some tens of queries), unrounded.
    """
    systems = list(dict.fromkeys(per["system"]))
    wide = {m: per.pivot(index="qid", columns="system", values=m).sort_index(key=lambda q: q.map(_natural)) for m in metrics}
    rows = []
    for s in systems:
        for m in metrics:
            x = wide[m][s].tolist()
            low, high = bootstrap_ci(x)
            rows.append({"system": s, "metric": m, "mean": float(np.mean(x)), "low": low, "high": high, "wilcoxon_p": None, "wins": None, "losses": None, "ties": None, "sign_test_p": None})
    if len(systems) == 2:
        a, b = systems
        for m in metrics:
            pair = wide[m].dropna()
            d = (pair[a] - pair[b]).to_numpy()
            low, high = bootstrap_ci(d.tolist())
            wins, losses = int((d > 0).sum()), int((d < 0).sum())
            rows.append({"system": f"{a} - {b}", "metric": m, "mean": float(d.mean()), "low": low, "high": high, "wilcoxon_p": wilcoxon(pair[a].tolist(), pair[b].tolist()), "wins": wins, "losses": losses, "ties": len(d) - wins - losses, "sign_test_p": sign_test(wins, losses)})
    return pd.DataFrame(rows)


def _natural(qid: str) -> tuple[str, int]:
    """Q2 before Q10."""
    head = qid.rstrip("0123456789")
    return head, int(qid[len(head) :] or 0)


def rank_delta(sheet: DataFrame) -> DataFrame:
    """(query_id, source, paper_id, delta): places a paper gains with the second method; null where only one ranks it."""
    return sheet.select("query_id", "source", "paper_id", (F.col("tfidf_rank") - F.col("biobert_rank")).alias("delta"))
