"""Label workflow, search chain, payload parsers, versions and JSON exports."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrine.operators import cache, labels, semantic
from papyrine.operators.graph import position_pairs
from papyrine.sources import readers, sinks
from tests.conftest import rows

SHEET = "query_id string, source string, paper_id string, relevant int, extra string"
REPLY = "query_id string, docid string, relevant string, confidence string, reason string"


def sheet(spark):
    return spark.createDataFrame([("q", " pubmed", "1", 1, "x"), ("q", "pubmed", "2", None, None), ("q", "pubmed", "3", None, "y"), ("q", "pubmed", "4", None, "z"), ("q", None, "5", None, None)], SHEET)


def replies(spark, more=()):
    return spark.createDataFrame([("q", "pubmed:1", "0", "high", "r"), ("q", "pubmed:2", "1", "low", "r"), ("q", "pubmed:3", "NA", "low", "r"), *more], REPLY)


def test_import_never_overwrites_and_names_what_is_open(spark):
    got = {r.paper_id: (r.relevant, r.origin) for r in labels.imported(sheet(spark), replies(spark), spark.createDataFrame([("pubmed:4",)], "docid string")).collect()}
    assert got == {"1": (1, "kept"), "2": (1, "imported"), "3": (0, "no_abstract"), "4": (None, "open"), "5": (None, "open")}
    assert {r.relevant for r in labels.imported(sheet(spark), replies(spark)).where("paper_id = '3'").collect()} == {None}
    assert rows(labels.unlabeled(sheet(spark))) == [("q", 5, 4)]
    assert labels.imported(sheet(spark).limit(0), replies(spark)).count() == 0


def test_problems_and_repeats(spark):
    twice = replies(spark, [("q", "pubmed:2", "0", "low", "s"), ("q", "pubmed:9", "1", "low", "s")])
    named = [(d, p) for _, d, p in rows(labels.problems(sheet(spark).where("source is not null"), twice))]
    assert named == [("pubmed:2", "twice"), ("pubmed:4", "missing"), ("pubmed:9", "unknown")]
    assert labels.merged(replies(spark)).count() == 3
    with pytest.raises(Exception, match="judged twice"):
        labels.merged(twice).collect()


def test_review_acceptance_and_override_rate(spark):
    flagged = labels.review_sheet(sheet(spark), replies(spark), "low")
    assert sorted(r.paper_id for r in flagged.collect()) == ["2", "3"]
    done = spark.createDataFrame([("q", "pubmed:2", "1", "0"), ("q", "pubmed:3", "NA", None), ("q", "pubmed:4", "1", "1")], "query_id string, docid string, proposed string, final string")
    got = {r.paper_id: (r.relevant, r.origin) for r in labels.accepted(sheet(spark), replies(spark), done).collect()}
    assert got == {"1": (1, "kept"), "2": (0, "reviewed"), "3": (None, "open"), "4": (1, "reviewed"), "5": (None, "open")}
    assert rows(labels.override_rate(done)) == [(2, 1, 0.5, 0.0)] and rows(labels.override_rate(done.limit(0))) == [(0, 0, None, None)]


def test_search_tries_links_then_recent_then_text(spark):
    at = dt.datetime(2025, 1, 1)
    papers = spark.createDataFrame([("1", "pubmed", "Gene study", "of mice", at), ("2", "pubmed", "Other", "matter", at + dt.timedelta(1)), ("3", "biorxiv", "Gene", "x", at)], "paper_id string, source string, title string, abstract string, fetched_at timestamp")
    link = spark.createDataFrame([("known", "pubmed", "1", 1)], "query string, source string, paper_id string, paper_rank int")
    log = spark.createDataFrame([(1, "run", "pubmed", 1, at)], "id long, query string, source string, result_count int, ran_at timestamp")
    ask = lambda q: [(r.paper_id, r.via) for r in cache.search(papers, link, log, q, "PubMed").collect()]
    assert ask(" Known ") == [("1", "links")] and ask("run") == [("2", "recent")] and ask("gene") == [("1", "text")] and ask("nothing") == []
    assert [r.paper_id for r in cache.has_abstract(papers.withColumn("abstract", F.when(F.col("paper_id") == "1", " ").otherwise(F.col("abstract")))).collect()] == ["2", "3"]


def test_blank_queries_pass_all_and_empty_runs_are_logged(spark):
    papers = spark.createDataFrame([("1", "pubmed", "gene", None), ("2", "pubmed", "x", "y")], "paper_id string, source string, title string, abstract string")
    queries = spark.createDataFrame([("blank", " ?"), ("null", None), ("g", "gene")], "query_id string, query_text string")
    assert [(q, p, n) for q, p, _, n in rows(cache.keyword_filter(papers, queries))] == [("blank", "1", 0), ("blank", "2", 0), ("g", "1", 1), ("null", "1", 0), ("null", "2", 0)]
    links = spark.createDataFrame([("old", "pubmed", "1", 1)], "query string, source string, paper_id string, paper_rank int")
    log = spark.createDataFrame([], "query string, source string, result_count int, ran_at timestamp")
    none = spark.createDataFrame([], "query string, source string, paper_id string, pos int")
    kept, entries = cache.replace_links(links, log, none, F.lit(dt.datetime(2025, 1, 1)), spark.createDataFrame([("Old ", "pubmed")], "query string, source string"))
    assert kept.count() == 0 and [(r.query, r.result_count) for r in entries.collect()] == [("old", 0)]


def test_payloads_become_papers(spark):
    xml = "<Set><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A title</ArticleTitle><Abstract><AbstractText>Text.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle><PubmedArticle><MedlineCitation><PMID>8</PMID></MedlineCitation></PubmedArticle></Set>"
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "payload string")
    assert [(r.paper_id, r.title, r.abstract) for r in readers.pubmed_payloads(one(xml, None)).collect()] == [("7", "A title", "Text.")]
    assert rows(readers.search_ids(one('{"esearchresult": {"idlist": ["9", "3"]}}', "broken"))) == [(0, "9"), (1, "3")]
    assert [r.paper_id for r in readers.preprint_payloads(one('{"collection": [{"doi": "10.1/a", "title": "T"}, {"doi": "", "title": "T"}]}', "{}")).collect()] == ["10.1/a"]
    assert [r.title for r in readers.europe_pmc_payloads(one('{"resultList": {"result": [{"doi": "10.1/b", "title": "<i>T</i>"}]}}')).collect()] == ["T"]


def test_last_grade_counts(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("q 0 d 1\nq 0 d 0\nq 0 e 0\n")
    (tmp_path / "b.tsv").write_text("q 0 e 1\n")
    assert rows(readers.trec_qrels(spark, str(tmp_path))) == [("q", "d", 0), ("q", "e", 1)]


def test_versions_and_failed_swaps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for k in range(2):
        sinks.publish(spark.range(k + 1), path)
    assert sinks.current(spark, path).count() == 2
    table = str(tmp_path / "s")
    sinks.swap(spark.range(3), table)
    move = sinks._move

    def broken(spark, old, new):
        if new == table and old.endswith(".new"):
            raise OSError("full")
        move(spark, old, new)

    monkeypatch.setattr(sinks, "_move", broken)
    with pytest.raises(OSError, match="full"):
        sinks.swap(spark.range(5), table)
    assert spark.read.parquet(table).count() == 3


def test_json_exports(spark):
    grid = spark.createDataFrame([("q2", "x", 0.5), ("q1", "x", 0.25)], "query_id string, method string, mean_score double")
    got = json.loads(sinks.summary_json(grid, {"seed": 7}).first().value)
    assert got["seed"] == 7 and [r["query_id"] for r in got["results"]] == ["q1", "q2"] and got["n_results"] == 2
    per = spark.createDataFrame([("q1", "x", 0.5, 1.0), ("q2", "x", 1.0, 0.0)], "query_id string, method string, precision double, recall double")
    assert json.loads(sinks.precision_recall_json(per).first().value)["means"] == [{"method": "x", "precision": 0.75, "recall": 0.5}]
    assert json.loads(sinks.manifest_json(spark.createDataFrame([("b", "h", 2), ("a", "g", 1)], "path string, sha256 string, bytes long")).first().value)["files"][0]["path"] == "a"


def test_many_queries_meet_the_rows_in_cells(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)] + [(900, None), (901, [1.0]), (902, [0.0] * 8), (903, [float("nan")] * 8)]
    v = spark.createDataFrame(data, "id long, vector array<double>")
    q = v.where("id < 60").select(F.col("id").alias("query_id"), "vector")
    near = rows(semantic.topk(v, q, 5))
    assert near == rows(semantic.topk(v, q, 5, broadcast_queries=10, cell=17)) and len(near) == 300
    low = semantic.topk(v, q, 200, clip=True)
    assert low.agg(F.min("score")).first()[0] == 0.0 and low.count() == 60 * 124 and semantic.topk(v, q.limit(0), 5).count() == 0


def test_pairs_of_positions(spark):
    df = spark.createDataFrame([("p", ["b", "a", "b"]), ("q", ["x"]), ("r", [])], "k string, `all` array<string>")
    assert rows(position_pairs(df)) == [("p", "a", "b"), ("p", "a", "b")]
