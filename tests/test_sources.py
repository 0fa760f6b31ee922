"""Readers, writers and streams on small files."""

import datetime as dt
import json

import pytest
from papyrine.sources import literature, readers, sinks
from papyrine.streaming import ingest
from tests.conftest import rows

XML = """<?xml version="1.0"?><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="1">11</PMID><Article><ArticleTitle>A <i>bold</i> title</ArticleTitle>
<Abstract><AbstractText Label="A">One &lt;5.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><Initials>JA</Initials></Author><Author><LastName>Roe</LastName></Author></AuthorList>
<Journal><Title>Fiction</Title><JournalIssue><PubDate><Year>2020</Year><Month>Sep</Month><Day>40</Day></PubDate></JournalIssue></Journal></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="x">Humans</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>Second</ArticleTitle>
<Journal><JournalIssue><PubDate><MedlineDate>Winter 1998-1999</MedlineDate></PubDate></JournalIssue></Journal></Article>
<MedlineJournalInfo><MedlineTA>Fict J</MedlineTA></MedlineJournalInfo></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>13</PMID><Article><Journal/></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""


def test_pubmed_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    got = {r.paper_id: r for r in readers.pubmed_xml(spark, str(tmp_path / "a.xml")).collect()}
    assert set(got) == {"11", "12"}
    a = got["11"]
    assert a.title == "A bold title" and a.abstract == "One <5. Two." and a.authors == ["Doe JA", "Roe"] and a.keywords == ["Humans"] and a.journal == "Fiction" and a.doi is None
    assert a.published_date == dt.datetime(2020, 1, 1)  # there is no 31st of September
    assert got["12"].published_date == dt.datetime(1998, 1, 1) and got["12"].journal == "Fict J" and got["12"].abstract == ""


def test_preprints(spark, tmp_path):
    page = {"messages": [{"total": 2}], "collection": [{"doi": "10.1/a", "title": "T", "abstract": "Abstract: x", "authors": "Doe, J.; Roe, K.", "date": "2021-02-03", "category": "genomics"}, {"doi": None, "title": "no id"}]}
    (tmp_path / "p.json").write_text(json.dumps(page))
    r = readers.preprint_json(spark, str(tmp_path / "p.json")).collect()
    assert len(r) == 1 and r[0].authors == ["Doe, J.", "Roe, K."] and r[0].journal == "Biorxiv - genomics" and r[0].keywords == ["genomics"] and r[0].abstract == "x" and r[0].url == "https://doi.org/10.1/a"
    pmc = {"resultList": {"result": [{"doi": "10.1/b", "title": "<b>T</b>", "abstractText": "<p>x</p>", "authorList": {"author": [{"fullName": "Doe J"}]}, "pubYear": "2019"}]}}
    (tmp_path / "e.json").write_text(json.dumps(pmc))
    e = readers.europe_pmc_json(spark, str(tmp_path / "e.json")).collect()[0]
    assert (e.title, e.abstract, e.authors, e.published_date.year) == ("T", "x", ["Doe J"], 2019)


def test_label_sheets_and_exports(spark, tmp_path):
    head = ",".join(readers.SHEET)
    (tmp_path / "s.csv").write_text("﻿" + head + '\nQ1,text,pubmed,5,"T, with\nbreak",prev,http://x,1,,1,\nQ1,text,biorxiv,10.1/x,T2,,,,2,,n\n', encoding="utf-8")
    sheet = readers.label_sheets(spark, str(tmp_path / "s.csv"))
    assert [(r.paper_id, r.tfidf_rank, r.biobert_rank, r.relevant) for r in sheet.orderBy("paper_id").collect()] == [("10.1/x", None, 2, None), ("5", 1, None, 1)]
    assert sinks.run_lines(sheet, "biobert").first().value == "Q1 Q0 biorxiv:10.1/x 2 0.500000 biobert"
    assert sinks.qrels_lines(sheet.where("relevant is not null")).first().value == "Q1\t0\tpubmed:5\t1"
    with pytest.raises(Exception, match="no label"):
        sinks.qrels_lines(sheet).collect()
    (tmp_path / "bad.csv").write_text(head + "\nQ1,t,p,5,T,,,1,,2,\n")
    with pytest.raises(Exception, match="relevant must be"):
        readers.label_sheets(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "lost.csv").write_text("query_id\nQ1\n")
    with pytest.raises(ValueError):
        readers.label_sheets(spark, str(tmp_path / "lost.csv"))
    corpus, queries, qrels = sinks.beir_tables(sheet, "preview")
    assert rows(corpus.select("_id", "text")) == [("biorxiv:10.1/x", ""), ("pubmed:5", "prev")] and queries.count() == 1 and qrels.count() == 2
    papers = spark.createDataFrame([("pubmed", "5", "full text")], "source string, paper_id string, abstract string")
    assert sinks.beir_tables(sheet.where("paper_id = '5'"), "full", papers)[0].first().text == "full text"
    with pytest.raises(Exception, match="no full abstract"):
        sinks.beir_tables(sheet, "full", papers)[0].collect()


def test_trec_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("Q1\t0\ta\t1\nQ1 0 b 0\n")
    (tmp_path / "r.run").write_text("Q1 Q0 a 1 0.9 sys\nQ1 Q0 b 2 0.5 sys\n")
    assert rows(readers.trec_qrels(spark, str(tmp_path / "q.tsv"))) == [("Q1", "a", 1), ("Q1", "b", 0)]
    assert readers.trec_run(spark, str(tmp_path / "r.run")).count() == 2
    (tmp_path / "d.run").write_text("Q1 Q0 a 1 0.9 sys\nQ1 Q0 a 2 0.5 sys\n")
    with pytest.raises(Exception, match="twice"):
        readers.trec_run(spark, str(tmp_path / "d.run")).collect()
    (tmp_path / "x.tsv").write_text("Q1 a 1\n")
    with pytest.raises(Exception, match="not 4 fields"):
        readers.trec_qrels(spark, str(tmp_path / "x.tsv")).collect()


def test_small_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"version": "1", "queries": [{"qid": "Q1", "category": "c", "query": "q", "origin": "o"}]}))
    assert readers.query_catalogue(spark, str(tmp_path / "c.json")).first().query == "q"
    (tmp_path / "j.txt").write_text('```csv\nquery_id,docid,relevant,confidence,reason\nQ1,s:1,1,high,"a, b"\n\nROWS: 1\n```\n')
    assert rows(readers.judge_replies(spark, str(tmp_path / "j.txt"))) == [("Q1", "s:1", "1", "high", "a, b")]
    (tmp_path / "k.txt").write_text("Q1,s:1,2,high,x\n")
    with pytest.raises(Exception, match="relevant must be"):
        readers.judge_replies(spark, str(tmp_path / "k.txt")).collect()
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "f").write_bytes(b"abc")
    m = readers.manifest(spark, str(tmp_path / "m")).first()
    assert m.sha256.startswith("ba7816bf") and m.bytes == 3


def test_literature_source(spark, tmp_path):
    (tmp_path / "one.txt").write_text("payload")
    literature.register(spark)
    df = spark.read.format("literature").option("urls", f"file://{tmp_path}/one.txt\nfile://{tmp_path}/none.txt").option("key", "k").load()
    assert rows(df) == [(0, "payload")]
    slept = []
    assert literature.patient(lambda: (_ for _ in ()).throw(OSError()), sleep=slept.append) is None and slept == [1.0, 2.0, 4.0]
    assert [len(b) for b in literature.id_batches([str(i) for i in range(250)])] == [100, 100, 50]


def test_swap_and_streams(spark, tmp_path):
    t = dt.datetime
    schema = "paper_id string, source string, title string, abstract string, fetched_at timestamp"
    a = spark.createDataFrame([("1", "pubmed", "x", "", t(2025, 1, 1)), ("1", "pubmed", "y", "", t(2025, 1, 2))], schema)
    a.write.parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    for _ in range(2):  # the second run repeats the input and changes nothing
        q = ingest.file_stream(spark, str(tmp_path / "in"), a.schema).writeStream.foreachBatch(ingest.upsert_into(state)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert rows(spark.read.parquet(state).select("paper_id", "title")) == [("1", "y")]
    q = ingest.fresh_papers(ingest.file_stream(spark, str(tmp_path / "in"), a.schema)).writeStream.format("memory").queryName("fresh").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 2
    lists = spark.createDataFrame([("1", ["a"], ["d"]), ("2", ["a"], ["d"])], "paper_id string, genes array<string>, diseases array<string>")
    lists.write.parquet(str(tmp_path / "lists"))
    q = ingest.edge_counts(ingest.file_stream(spark, str(tmp_path / "lists"), lists.schema)).writeStream.format("memory").outputMode("complete").queryName("edges").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("edges")) == [("a", "d", 2)]
    log = spark.createDataFrame([("PubMed", 3, t(2025, 1, 1, 5)), ("pubmed", 4, t(2025, 1, 1, 7))], "source string, result_count int, ran_at timestamp")
    assert rows(ingest.query_windows(log).select("source", "runs", "results")) == [("pubmed", 2, 7)]


def test_report():
    text = sinks.report([{"method": "tfidf", "n": 5, "mean_gcs": 179.0, "mean_score": 0.05, "mean_runtime": 0.026}], {"mean_delta": 36.6, "ci95": (-22.0, 85.6), "sign_test_p": 0.375, "significant": False})
    assert "not statistically supported" in text and "| tfidf | 5 | 179.0 |" in text


def test_addresses_and_exports(spark):
    assert "retmax=5" in literature.search_url("http://x", "a b", 5) and len(literature.fetch_urls("http://x", [str(i) for i in range(150)], "k")) == 2
    start, end = literature.date_range(dt.datetime(2025, 7, 1))
    assert (end - start).days == 180 and literature.page_urls("http://x", "biorxiv", start, end, 100)[1].endswith("/100")
    assert len(literature.page_urls("http://x", "b", start, end, 100, total=150)) == 2 and "pageSize=100" in literature.fallback_url("http://x", "q", 50)
    per = spark.createDataFrame([("q", "s", 0.5, 1.0, 0.25, 0.0)], "qid string, system string, p_at double, mrr double, ndcg double, unjudged double")
    assert sinks.metric_rows(per).first().ndcg == "0.2500"
    res = spark.createDataFrame([(1, 0.5, "m", "1", "s", "t", "abcdef")], "rank int, score double, method string, paper_id string, source string, title string, abstract string")
    assert json.loads(sinks.result_json(res, 3).first().value)["abstract"] == "abc..."
