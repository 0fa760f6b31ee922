"""Retrieval metrics, tests of significance and agreement against known values."""

import math

import pytest
from pyspark.sql import functions as F

from papyrine.operators import metrics as M
from tests.conftest import rows

RUN = "system string, qid string, docid string, rank int"
QRELS = "qid string, docid string, grade int"


def one(spark, ranking, rels):
    run = spark.createDataFrame([("s", "q", d, i + 1) for i, d in enumerate(ranking)], RUN)
    qrels = spark.createDataFrame([("q", d, g) for d, g in rels.items()], QRELS)
    r = M.query_metrics(run, qrels).collect()[0]
    return r.p_at, r.mrr, r.ndcg, r.unjudged


def test_query_metrics(spark):
    assert one(spark, ["a", "b"], {"a": 0, "b": 0}) == (0, 0, 0, 0)
    assert one(spark, ["a", "b"], {"a": 1, "b": 1}) == (0.2, 1, 1, 0)
    assert one(spark, ["a", "x"], {"a": 1})[3] == 0.1
    p, mrr, ndcg, _ = one(spark, ["x", "a", "b"], {"a": 2, "b": 1, "c": 3, "x": 0})
    dcg, ideal = 2 / math.log2(3) + 1 / 2, 3 + 2 / math.log2(3) + 1 / 2
    assert (p, mrr) == (0.2, 0.5) and abs(ndcg - dcg / ideal) < 1e-12


def test_missing_queries(spark):
    run = spark.createDataFrame([("s", "q1", "d", 1)], RUN)
    qrels = spark.createDataFrame([("q1", "d", 1), ("q2", "d", 1)], QRELS)
    assert rows(M.missing_queries(run, qrels).select("system", "qid")) == [("s", "q2")]


def test_paired_connectivity_numbers():
    tf, bio = [156, 328, 78, 273, 60], [196, 257, 189, 293, 143]
    d = [b - a for a, b in zip(tf, bio, strict=True)]
    assert abs(sum(d) / 5 - 36.6) < 1e-9 and M.bootstrap_index_ci(d) == (-22.0, 85.6) and M.sign_test(4, 1) == 0.375
    assert not M.significant(0.375, (-22.0, 85.6)) and M.significant(0.01, (1.0, 2.0)) and not M.significant(None, (1, 2))


def test_sign_test_inside_spark(spark):
    for d in ([1, 1, 1, 1, -1], [1] * 5, [0, 0], [2, -1, 0, 3, -4, 5, 6]):
        r = M.sign_counts(spark.createDataFrame([(float(x),) for x in d], "delta double")).collect()[0]
        want = M.sign_test(sum(x > 0 for x in d), sum(x < 0 for x in d))
        assert r.p is None if want is None else abs(r.p - want) < 1e-6


def test_bootstrap_and_wilcoxon():
    assert all(map(math.isnan, M.bootstrap_ci([]))) and M.bootstrap_ci([0.5]) == (0.5, 0.5)
    assert M.bootstrap_ci([0.1, 0.9, 0.4]) == M.bootstrap_ci([0.1, 0.9, 0.4])
    assert M.wilcoxon([1, 2], [1, 2]) is None
    # by hand: ranks 1..5 of 5 positive differences, z = 7.5 / sqrt(13.75)
    assert abs(M.wilcoxon([1, 2, 3, 4, 5], [0] * 5) - math.erfc(7.5 / math.sqrt(13.75) / math.sqrt(2))) < 1e-12


def test_kappa(spark):
    assert M.cohen_kappa([1, 0, 1], [1, 0, 1]) == 1 and abs(M.cohen_kappa([1, 1, 0, 0], [1, 0, 0, 0]) - 0.5) < 1e-12 and M.cohen_kappa([1, 1], [1, 1]) == 1
    with pytest.raises(ValueError):
        M.cohen_kappa([], [])
    cells = [(1, 1)] * 48 + [(0, 1)] * 2 + [(1, 0)] * 4 + [(0, 0)] * 12
    r = M.confusion(spark.createDataFrame(cells + [(None, 1)], "human int, proposed int")).collect()[0]
    assert (r.tp, r.fp, r.fn, r.tn) == (48, 2, 4, 12) and round(r.kappa, 4) == 0.7415 and round(r.agreement, 4) == 0.9091


def test_pooled_precision_recall_and_pool(spark):
    sheet = spark.createDataFrame([("Q1", "s", "a", 1, 2, 1), ("Q1", "s", "b", None, 1, 0), ("Q1", "s", "c", 2, None, 1), ("Q1", "s", "d", 11, None, 1)], "query_id string, source string, paper_id string, tfidf_rank int, biobert_rank int, relevant int")
    got = {r.method: (r.precision, r.recall) for r in M.pooled_precision_recall(sheet).collect()}
    assert got == {"tfidf": (0.2, 1.0), "biobert": (0.1, 0.5)}
    assert {r.complete for r in M.pool_complete(sheet, 2).collect()} == {True}
    res = spark.createDataFrame([("Q", "a", "s", 1, "tfidf"), ("Q", "a", "s", 3, "biobert"), ("Q", "b", "s", 12, "tfidf")], "query_id string, paper_id string, source string, paper_rank int, method string")
    assert rows(M.pool(res)) == [("Q", "s", "a", 1, 3)]


def test_score_stats_winner_cold_warm(spark):
    df = spark.createDataFrame([("q", 0.9), ("q", 0.7), ("q", 0.5), ("q", 0.3), ("r", None)], "query_id string, score double")
    assert rows(M.score_stats(df, ["query_id"])) == [("q", 0.6, 0.9, 0.223607), ("r", 0.0, 0.0, 0.0)]
    w = spark.createDataFrame([(3, 5), (7, 3), (4, 4)], "a int, b int").select(M.winner(F.col("a"), F.col("b")).alias("w"))
    assert [r.w for r in w.collect()] == ["biobert", "tfidf", "tie"]
    runs = spark.createDataFrame([("q1", "m", 23.0, 1, None, 1, 0.5), ("q2", "m", 0.2, 2, None, 3, 0.5), ("q3", "m", 0.4, 3, None, 2, 0.5), ("q4", "m", 9.0, 0, "x", 9, 0.5)], "query_id string, method string, runtime double, run_order int, error string, gcs int, mean_score double")
    assert rows(M.cold_warm(runs)) == [("m", "q1", 23.0, pytest.approx(0.3), 2)]
    assert rows(M.method_summary(runs)) == [("m", 3, 2.0, 0.5, pytest.approx(7.866667))]


def test_labels(spark):
    notes = ["proposed: x", "NEEDS_HUMAN y", "other", None, "reviewed: a", "accepted: b", "rule: c"]
    df = spark.createDataFrame([(n,) for n in notes], "notes string").select(M.provenance(F.col("notes")).alias("p"))
    assert [r.p for r in df.collect()] == ["proposed_unreviewed", "author_labeled_after_abstain", "human", "human", "author_reviewed", "proposed_audited_accepted", "no_abstract_rule"]
    sheet = spark.createDataFrame([("Q", "s", str(i), None) for i in range(27)], "query_id string, source string, paper_id string, relevant int")
    a, b = M.shuffled(sheet, 1, ["query_id", "paper_id"]), M.shuffled(sheet.repartition(3), 1, ["query_id", "paper_id"])
    assert rows(a) == rows(b) and [r.paper_id for r in a.orderBy("shuffle_pos").collect()] != [str(i) for i in range(27)]
    assert M.sampled(sheet, 0.1, 7, ["paper_id"]).count() == 3 and M.sampled(sheet.limit(0), 0.1, 7, ["paper_id"]).count() == 0
    ans = spark.createDataFrame([("Q", "s:1", "1"), ("Q", "s:1", "1"), ("Q", "s:99", "0")], "query_id string, docid string, answer string")
    joined, unknown, open_, repeated = M.join_judgments(sheet, ans)
    assert (joined.count(), unknown.count(), open_.count(), repeated.count()) == (2, 1, 26, 1)


def test_summary_table_and_delta(spark):
    import pandas as pd

    per = pd.DataFrame([{"system": s, "qid": f"Q{q}", "p_at": (q % 5) / 10 + (0.1 if s == "b" and q % 3 else 0), "mrr": 1.0, "ndcg": q / 20} for s in "ab" for q in range(1, 11)])
    t = M.summary_table(per)
    assert len(t) == 9
    c = t[(t.system == "a - b") & (t.metric == "p_at")].iloc[0]
    assert (c.wins, c.losses, c.ties) == (0, 7, 3) and abs(c.sign_test_p - 2 / 2**7) < 1e-12 and abs(c["mean"] + 0.07) < 1e-12
    tied = t[(t.system == "a - b") & (t.metric == "mrr")].iloc[0]
    assert tied.ties == 10 and pd.isna(tied.wilcoxon_p) and pd.isna(tied.sign_test_p)
    assert sorted(["Q10", "Q2", "Q1"], key=M._natural) == ["Q1", "Q2", "Q10"]
    sheet = spark.createDataFrame([("Q", "s", "a", 3, 1), ("Q", "s", "b", None, 1)], "query_id string, source string, paper_id string, tfidf_rank int, biobert_rank int")
    assert rows(M.rank_delta(sheet).select("paper_id", "delta")) == [("a", 2), ("b", None)]


def test_pipeline(spark):
    from papyrine.operators import entities as E
    from papyrine.plans import pipeline

    papers = spark.createDataFrame([("1", "KRAS", "in lung cancer", '["Humans", "Lung Neoplasms", "Obesity"]'), ("2", "none", None, None)], "paper_id string, title string, abstract string, keywords_json string")
    cached = spark.createDataFrame([("2", ["tp53"], ["cancer"]), ("9", ["x"], [])], "paper_id string, genes array<string>, diseases array<string>")
    got = {r.paper_id: (r.genes, r.diseases) for r in pipeline.paper_entities(papers, E.pattern_table(spark), cached).collect()}
    assert got == {"1": (["kras"], ["lung cancer", "obesity"]), "2": (["tp53"], ["cancer"])}
    assert pipeline.knowledge_graph(papers, E.pattern_table(spark), cached).edges.count() == 4
    res = spark.createDataFrame([("q", m, "1", 0.5, 1) for m in ("tfidf", "biobert")] + [("q", "tfidf", "2", 0.1, 11)], "query_id string, method string, paper_id string, score double, paper_rank int")
    ents = spark.createDataFrame([("1", ["kras"], ["lung cancer", "obesity"]), ("2", ["tp53"], ["cancer"])], "paper_id string, genes array<string>, diseases array<string>")
    grid = {r.method: r for r in pipeline.evaluation_grid(res, ents).collect()}
    assert (grid["tfidf"].nodes, grid["tfidf"].edges, grid["tfidf"].gene_disease_pairs, grid["tfidf"].density) == (3, 3, 2, 1.0) and grid["biobert"].mean_score == 0.5
    assert pipeline.contrast(pipeline.evaluation_grid(res, ents))["ties"] == 1
