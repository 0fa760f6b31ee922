"""Deduplication, TF-IDF against brute force, semantic ranking."""

import collections
import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrine.operators import dedup, semantic, tfidf
from tests.conftest import rows

P = "paper_id string, source string, title string, abstract string, doi string"


def test_doi_pair_prefers_a_source(spark):
    df = spark.createDataFrame([("38812345", "pubmed", "KRAS study", "", "10.1/XYZ"), ("10.1101/pre", "biorxiv", "KRAS study preprint", "", "https://doi.org/10.1/xyz")], P)
    kept, log = dedup.deduplicate(df)
    assert rows(kept.select("paper_id")) == [("38812345",)] and rows(log) == [("38812345", "pubmed", "biorxiv:10.1101/pre")]
    assert rows(dedup.deduplicate(df, "BIORXIV")[0].select("paper_id")) == [("10.1101/pre",)]


def test_mixed_and_a_doi_row_never_meets_a_twin_without(spark):
    df = spark.createDataFrame(
        [("1", "pubmed", "a", "x", "10.1/a"), ("2", "biorxiv", "b", "y", "doi:10.1/a"), ("3", "pubmed", "same", "t", None), ("4", "biorxiv", "same", "t", ""), ("5", "pubmed", "same", "t", "10.1/z")], P
    )
    kept, log = dedup.deduplicate(df)
    assert {r.paper_id for r in kept.collect()} == {"1", "3", "5"} and log.count() == 2
    again, none = dedup.deduplicate(kept)
    assert again.count() == 3 and none.count() == 0
    assert dedup.deduplicate(df.limit(0))[0].count() == 0


def brute_tfidf(docs, query, stop):
    """A corpus of the documents and the query, dense."""

    def grams(t):
        w = [x for x in re.findall(r"\b[a-z][a-z0-9\-]+\b", t.lower()) if x not in stop]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    bags = [collections.Counter(grams(t)) for t in [*docs, query]]
    n = len(bags)
    df = collections.Counter(t for b in bags for t in b)
    vecs = [{t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in b.items()} for b in bags]
    norm = [math.sqrt(sum(v * v for v in x.values())) for x in vecs]
    q = vecs[-1]
    return [sum(w * x.get(t, 0) for t, w in q.items()) / (norm[i] * norm[-1]) if norm[i] and norm[-1] else 0.0 for i, x in enumerate(vecs[:-1])]


def test_tfidf_equals_brute_force(spark):
    texts = ["gene gene mutation in cancer", "the cancer study of mice", "mice and gene study", "", "protein folding"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, body string")
    queries = spark.createDataFrame([("q1", "cancer gene mutation"), ("q2", "mice mice study"), ("q3", "the and of")], "query_id string, query_text string")
    stop = ["in", "the", "of", "and"]
    got = {(r.query_id, r.doc): (r.score, r["rank"]) for r in tfidf.rank(docs, queries, text=docs.body, stop=stop, top=None, keep_zero=True).collect()}
    assert len(got) == 15
    for q in queries.collect():
        want = brute_tfidf(texts, q.query_text, stop)
        order = sorted(range(len(texts)), key=lambda i: (-round(want[i], 6), i))
        for i, w in enumerate(want):
            score, rank = got[q.query_id, i]
            assert abs(score - w) < 2e-6 and rank == order.index(i) + 1


def test_top_terms_are_those_of_the_query(spark):
    docs = spark.createDataFrame([(1, "common common"), (2, "common rare")], "doc int, body string")
    q = spark.createDataFrame([("q", "common rare unseen")], "query_id string, query_text string")
    got = [r.term for r in tfidf.top_terms(docs, q, text=docs.body, stop=[], top=1).collect()]
    assert got == ["common rare"] or got == ["rare unseen"] or got == ["unseen"]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_topk_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(40, [0.0] * 8), (41, None)], "id long, vector array<double>")
    q = spark.createDataFrame([(100, x[3].tolist())], "query_id long, vector array<double>")
    got = [(r.id, r.score) for r in semantic.topk(v, q, 5).orderBy("rank").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[3], 6)
    want = sorted(range(40), key=lambda i: (-s[i], i))[:5]
    assert [g[0] for g in got] == want and np.allclose([g[1] for g in got], s[want])


def test_embedding_cache_split_and_writeback(spark):
    papers = spark.createDataFrame([("1", "s", "t", "a"), ("2", "s", "u", None), ("3", "s", "t", "a")], "paper_id string, source string, title string, abstract string")
    empty = spark.createDataFrame([], "content_hash string, model_id string, vector array<float>")
    encoder = lambda: semantic.hashing_encoder(16)
    vecs, new = semantic.cached_embeddings(papers, empty, "m", encoder)
    assert vecs.count() == 3 and new.count() == 2
    hit, miss = semantic.cache_split(papers, new, "m")
    assert hit.count() == 3 and miss.count() == 0
    assert semantic.cache_split(papers, new, "other")[0].count() == 0
    q = semantic.query_vectors(spark.createDataFrame([("q", "t t. a")], "query_id string, query_text string"), encoder)
    assert len(q.collect()[0].vector) == 16


def test_best_of_many_queries_by_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i:03}", f"gene w{i % 5} x{i % 11} y{i} gene") for i in range(120)], "doc string, body string")
    queries = spark.createDataFrame([(f"q{i}", f"gene w{i} y{i * 7}") for i in range(5)] + [("none", "zebra"), ("few", "y3 y4"), ("blank", " ")], "query_id string, query_text string")
    for how in ({}, {"keep_zero": True}, {"keep_zero": True, "most_terms": 30}):
        ask = lambda top, how=how: tfidf.rank(docs, queries, text=docs.body, stop=[], top=top, **how)
        whole = rows(ask(None).where("rank <= 10"))
        assert whole and rows(ask(10)) == whole
        for name, value in (("MOST_TERMS", 7), ("ASKED_TERMS", 8), ("WAITING", 5), ("PIECE", 9)):
            monkeypatch.setattr(tfidf, name, value)
        assert rows(ask(10)) == whole
        monkeypatch.undo()
    plan = tfidf.rank(docs, queries, text=docs.body, stop=[], top=10, keep_zero=True)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "dot" not in plan
