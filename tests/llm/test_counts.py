"""Term scores, pair tables and fused ranks against brute force."""

import collections
import datetime as dt
import itertools
import json
import math
import random
import re

from pyspark.sql import functions as F

from papyrine.llm import cooccur, distinctive, fusion
from papyrine.llm.common import ranked
from tests.conftest import rows

PAPERS = "paper_id string, title string, abstract string, keywords_json string"


def test_scores_equal_brute_force(spark):
    data = [("1", "gene gene study", "of mice", '["Mice", "x"]'), ("1", "gene study", None, None), ("2", None, "study of rats " * 50, "[broken"), ("3", "", " ", "[]"), (None, "lost gene", "", None)]
    df = spark.createDataFrame(data + data[:1], PAPERS).withColumn("term", F.lit("clash")).withColumn("doc", F.lit(1))
    got = distinctive.scored(distinctive.record_terms(df, "paper_id", ["title", "abstract"], ["keywords_json"]))
    bags, docs = [], collections.defaultdict(set)
    for n, (i, t, a, k) in enumerate(data):
        try:
            ks = json.loads(k) if k else []
        except ValueError:
            ks = []
        bag = collections.Counter(re.findall("[a-z0-9]+", " ".join([t or "", a or "", *ks]).lower()))
        bags.append((i, bag))
        for w in bag:
            docs[w].add(i if i is not None else f"#{n}")
    cf = collections.Counter()
    for _, b in bags:
        cf.update(b)
    total = sum(cf.values())
    want = []
    for i, b in bags:
        for w, tf in b.items():
            p, length = cf[w] / total, sum(b.values())
            pd = (tf + distinctive.MU * p) / (length + distinctive.MU)
            want.append((i, w, tf, len(docs[w]), round(pd * math.log(pd / p), 9)))
    have = [(None if r.doc.startswith("\x00") else r.doc, r.term, r.tf, r.df, round(r.score, 9)) for r in got.collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    assert distinctive.scored(distinctive.record_terms(df.limit(0), "paper_id", ["title", "abstract"], ["keywords_json"])).count() == 0
    assert {r.term for r in distinctive.scored(distinctive.record_terms(df, "paper_id", ["title", "abstract"], ["keywords_json"]), min_df=2).collect()} == {w for w in docs if len(docs[w]) >= 2}


def test_rare_terms_are_carried_by_their_score(spark):
    rng = random.Random(2)
    data = [(f"p{i}", " ".join(rng.choice(["common", "usual", "plain"]) for _ in range(30 + i)) + " " + f"rareword{chr(97 + i)} " * (i % 5), None, None) for i in range(20)]
    data += [("q", "shortone shortone shortone", None, None)]
    counted = distinctive.record_terms(spark.createDataFrame(data, PAPERS), "paper_id", ["title", "abstract"], ["keywords_json"])
    every = {(r.doc, r.term): (r.tf, r.df, r.score) for r in distinctive.scored(counted, pattern="^[a-z]{6,}$").collect()}
    got = {(r.doc, r.term) for r in distinctive.characteristic(counted, "^[a-z]{6,}$", 3, 5).collect()}
    cases = {k for k, (tf, df, _) in every.items() if tf >= 3 and df <= 5}
    assert cases and cases <= got and len(got) < len(every)
    assert min(every[k][2] for k in got) > min(v[2] for v in every.values())
    one = distinctive.record_terms(spark.createDataFrame(data[-1:], PAPERS), "paper_id", ["title"], [])
    assert [(r.doc, r.term) for r in distinctive.characteristic(one, "^[a-z]{6,}$", 3, 5).collect()] == [("q", "shortone")]
    assert distinctive.characteristic(counted.limit(0), "^[a-z]{6,}$", 3, 5).count() == 0


ENT = "paper_id string, genes_json string, diseases_json string, extracted_at timestamp"


def brute(baskets):
    n, pairs = collections.Counter(), collections.Counter()
    for items in baskets.values():
        n.update(items)
        pairs.update(itertools.combinations(sorted(items), 2))
    return n, pairs


def test_increments_equal_a_full_count(spark, tmp_path):
    rng = random.Random(3)
    at = dt.datetime(2025, 1, 1)
    names = [f"g{i}" for i in range(12)]
    data = [(f"p{rng.randrange(40)}", json.dumps([rng.choice([x, x.upper(), f" {x}\n"]) for x in rng.sample(names, 3)]), json.dumps(rng.sample(["d1", "d2", "hot"], 2)), at + dt.timedelta(hours=h)) for h in range(120)]
    data += [("bad", '["a", ', "null", at), ("empty", None, "[]", None), (None, '["x", "y"]', None, at), ("blank", '["", " ", "\\u00a0", "z", null]', "[]", at)]
    df = spark.createDataFrame(data, ENT).withColumn("items", F.lit(1)).withColumn("basket", F.lit("clash"))
    first, then = cooccur.increments(df, "paper_id", ["genes_json", "diseases_json"], "extracted_at", share=0.6)
    cooccur.PairTable(spark, str(tmp_path / "t")).add(first)
    table = cooccur.PairTable(spark, str(tmp_path / "t")).add(then)
    want = collections.defaultdict(set)
    for i, g, d, _ in data:
        if i is None:
            continue
        want[i] |= set()
        for j in (g, d):
            try:
                want[i] |= {str(x).strip().lower() for x in json.loads(j or "[]") or [] if x is not None and str(x).strip()}
            except ValueError:
                pass
    n, pairs = brute(want)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in cooccur.PairTable(spark, str(tmp_path / "t")).scores().collect()}
    assert got == {k: (v, n[k[0]], n[k[1]], len(want)) for k, v in pairs.items()}
    table.vacuum()
    assert table.scores().count() == len(pairs) and table.known().count() == len(want)


def test_signed_deltas_take_away_and_only_affected_pairs_are_scored_again(spark, tmp_path):
    make = lambda d: spark.createDataFrame([(k, sorted(v)) for k, v in d.items()], "basket string, items array<string>")
    held = lambda t: {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in t.scores().collect()}
    t = cooccur.PairTable(spark, str(tmp_path / "t"), buckets=4).add(make({"x": {"a", "b", "c"}, "y": {"a", "b"}, "u": {"p", "q"}}))
    assert t.work["scored"] == 4
    t.add(make({"x": {"a", "d"}, "z": set()}), replace=True)
    assert held(t) == {("a", "b"): (1, 2, 1, 4), ("a", "d"): (1, 2, 1, 4), ("p", "q"): (1, 1, 1, 4)}
    assert t.work["scored"] == 4  # (a, b), (a, c), (b, c) and (a, d), not (p, q)
    version = t.state["version"]
    assert t.add(make({"x": {"a", "d"}})).work == {"scored": 0, "buckets": 0} and t.state["version"] == version  # nothing changed
    again = cooccur.PairTable(spark, str(tmp_path / "t"))
    assert held(again) == held(t) and again.state["buckets"] == 4
    t.add(make({"u": {"r"}}))  # q, p keep their marginals, their pair its score
    assert held(t)["p", "q"] == (1, 1, 1, 4) and held(t)["p", "r"] == (1, 1, 1, 4)


def test_a_lost_increment_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    make = lambda d: spark.createDataFrame([(k, sorted(v)) for k, v in d.items()], "basket string, items array<string>")
    path = str(tmp_path / "t")
    cooccur.PairTable(spark, path).add(make({"x": {"a", "b"}}))
    broken = cooccur.PairTable(spark, path)
    monkeypatch.setattr(broken, "_commit", lambda state: 1 / 0)
    try:
        broken.add(make({"y": {"a", "c"}}))
    except ZeroDivisionError:
        pass
    assert [(r.item_a, r.item_b, r.n_a) for r in cooccur.PairTable(spark, path).scores().collect()] == [("a", "b", 1)]


def test_long_baskets_are_paired_in_pieces(spark):
    df = spark.createDataFrame([([f"i{k:03d}" for k in range(23)], 1), (["x", "y"], -1), (["x"], 1), ([], 1)], "items array<string>, d int")
    want = sorted([(f"i{a:03d}", f"i{b:03d}", 1) for a in range(23) for b in range(a + 1, 23)] + [("x", "y", -1)], key=repr)
    assert rows(cooccur.paired(df, long=5)) == want == rows(cooccur.paired(df))


def test_empty_pair_table(spark, tmp_path):
    first, then = cooccur.increments(spark.createDataFrame([], ENT), "paper_id", ["genes_json", "diseases_json"], "extracted_at")
    assert cooccur.PairTable(spark, str(tmp_path / "t")).add(first).add(then).scores().count() == 0


SCORES = "query_id string, paper_id string, source string, score double, paper_rank int, method string"


def test_fusion_ignores_scales_and_orders_ties(spark):
    data = [("q", "a", "s", 0.9, 1, "x"), ("q", "b", "s", 0.8, 2, "x"), ("q", "c", "s", 0.8, 3, "x"), ("q", "a", "s", 40.0, 2, "y"), ("q", "b", "s", 90.0, 1, "y"), ("q", "d", "s", None, 3, "y"), ("q", "e", "s", None, None, "y")]
    df = spark.createDataFrame(data + data[:3] + [("q", "a", "s", 0.1, 9, "x"), (None, "a", "s", 1.0, 1, "x"), ("q", None, "s", 1.0, 1, "x"), ("q", "f", "s", float("nan"), 7, "x")], SCORES).withColumn("fused", F.lit(0)).withColumn("place", F.lit(0))
    places = {(r.method, r.paper_id): r.place for r in fusion.method_ranks(df).collect()}
    assert places == {("x", "a"): 1, ("x", "b"): 2.5, ("x", "c"): 2.5, ("x", "f"): 4, ("y", "b"): 1, ("y", "a"): 2, ("y", "d"): 3, ("y", "e"): 4}
    order = fusion.fused(fusion.method_ranks(df)).orderBy("fused_rank").collect()
    want = sorted({p: sum(1 / (60 + v) for (m, k), v in places.items() if k == p) for p in "abcdef"}.items(), key=lambda x: (-round(x[1], 12), x[0]))
    assert [r.paper_id for r in order] == [p for p, _ in want] and abs(order[0].fused - want[0][1]) < 1e-9
    scaled = spark.createDataFrame([(q, p, s, v * 100 if v is not None and m == "x" else v, r, m) for q, p, s, v, r, m in data], SCORES)
    assert [r.paper_id for r in fusion.fused(fusion.method_ranks(scaled)).orderBy("fused_rank").collect()] == [r.paper_id for r in fusion.fused(fusion.method_ranks(spark.createDataFrame(data, SCORES))).orderBy("fused_rank").collect()]
    assert fusion.fused(fusion.method_ranks(df.limit(0))).count() == 0


def test_leaders(spark):
    data = [("q", p, "s", v, 1, m) for m, order in (("x", "abcde"), ("y", "cfgab")) for v, p in zip((5, 4, 3, 2, 1), order, strict=True)]
    data += [("two", p, "s", v, 1, m) for m in "xy" for v, p in zip((3.0, 2.0), "ab", strict=True)] + [("single", "a", "s", 1.0, 1, "x")]
    places = fusion.method_ranks(spark.createDataFrame([(q, p, s, float(v), r, m) for q, p, s, v, r, m in data], SCORES))
    assert rows(fusion.leaders(places)) == [("q", "c")]
    assert rows(fusion.leaders(places, depth=1)) == [("two", "a")] and fusion.leaders(places.limit(0)).count() == 0


def test_leaders_come_from_the_fused_order(spark, monkeypatch):
    data = [("q", p, "s", float(v), 1, m) for m, order in (("x", "abc"), ("y", "cde")) for v, p in zip((3, 2, 1), order, strict=True)]
    places = fusion.method_ranks(spark.createDataFrame(data, SCORES))
    assert rows(fusion.leaders(places)) == [("q", "c")]
    monkeypatch.setattr(fusion, "_summed", lambda p, c: p.groupBy("query_id", "paper_id").agg(F.max("score").alias("fused"), F.count("*").cast("int").alias("methods")))
    assert rows(fusion.leaders(places)) == []  # without fusion a tied paper of one method comes first


def test_distributed_rank_of_a_hot_group(spark):
    df = spark.createDataFrame([("hot", i % 97, i) for i in range(3000)] + [("cold", 1, -1)], "g string, v int, i int").repartition(6)
    got = {(r.g, r.i): r.n for r in ranked(df, ["g"], [F.col("v").desc(), F.col("i")], "n").collect()}
    order = sorted(range(3000), key=lambda i: (-(i % 97), i))
    assert all(got["hot", i] == k + 1 for k, i in enumerate(order)) and got["cold", -1] == 1
