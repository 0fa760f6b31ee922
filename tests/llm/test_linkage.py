"""Linkage and survivorship: profiles, blocking, label model, works, golden records."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from papyrine.llm import linkage as K
from papyrine.llm import survivor as S
from papyrine.llm.common import components
from tests.conftest import rows

SCHEMA = "paper_id string, source string, title string, abstract string, authors_json string, published_date string, doi string, journal string, keywords_json string, url string, fetched_at timestamp, content_hash string"
T = dt.datetime(2025, 6, 1)


def paper(i, source="pubmed", title=None, abstract=None, authors=None, date=None, doi=None, keywords=None, fetched=T):
    return (i, source, title, abstract, authors, date, doi, None, keywords, None, fetched, None)


def world(n=60):
    """Works of two records (a preprint and an article in other notation), siblings of the same team, and noise."""
    rng = np.random.default_rng(1)
    out = []
    for k in range(n):
        gene, organ, team = f"GEN{k}A", ["renal", "hepatic", "ocular"][k % 3], [f"Sur{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}{'uvw'[j]}" for j in range(3)]
        topic = f"{gene} shapes {organ} stenosis in cohort {k}"
        text = ". ".join(f"Sentence {j} about {gene} and value {rng.integers(100, 999)} in {organ} tissue of group {k * 7 + j}" for j in range(5)) + "."
        names = "[" + ", ".join(f'"{s} {"ABC"[j]}"' for j, s in enumerate(team)) + "]"
        full = "[" + ", ".join(f'"{s}, {"ABC"[j]}elin"' for j, s in enumerate(team)) + "]"
        out.append(paper(f"10.9101/2020.01.01.{k:07d}", "biorxiv", topic, text, full, "2020-01-01", f"10.9101/2020.01.01.{k:07d}"))
        out.append(paper(f"6{k:05d}", "pubmed", f"{topic.upper()}." if k % 2 else f"<i>{topic}</i>.", "BACKGROUND: " + text, names, "2020-09-01T00:00:00Z", f"10.9999/j.{k}"))
        if k % 3 == 0:  # another work of the team
            other = ". ".join(f"Claim {j} on other matters {rng.integers(1000, 9999)} of section {k * 11 + j} goes on" for j in range(5)) + "."
            out.append(paper(f"7{k:05d}", "pubmed", f"{topic}: part II", other, names, "2021-01-01", f"10.9999/k.{k}"))
    return out


def test_author_keys():
    assert {K.author_key(x) for x in ("Vöxen ZD", "Voxen, Zena", "Zena D. Voxen", "Voxen, Z. D.")} == {"voxen|z"}


def test_relations_and_dois(spark):
    titles = ["Erratum to: X", "X: part II", "", "X, version 2", "X: ten-year update"]
    assert [K.relation(t) for t in titles] == ["correction:", "part:ii", "", "", "sequel:"]
    df = spark.createDataFrame([(x,) for x in ("doi: 10.1234/A", "https://doi.org/10.1234/a", "pending", "10.12/x", "10.1234/ ", None)], "d string")
    assert [r.d for r in df.select(K.usable_doi(F.col("d")).alias("d")).collect()] == ["10.1234/a", "10.1234/a", None, None, None, None]


def test_texts_are_read_alike_in_all_notations():
    import pandas as pd

    row = {"id": "x", "doi": None, "own": None, "day": 0.0, "keywords_json": '["A b", " a B"]'}
    one = {**row, "title": "<i>Rôle</i> of GEN-1 &amp; stone", "abstract": "AIM: We saw 12.5 things in all. Too short.", "authors_json": '["Vöxen ZD", "et al.", null]'}
    two = {**row, "title": "role of gen 1 and STONE", "abstract": "we saw 12.5 things in all. Too short.", "authors_json": '["Voxen, Zena"]'}
    r = next(K._read(iter([pd.DataFrame([one, two, {**row, "title": None, "abstract": None, "authors_json": "[", "keywords_json": None}])])))
    for c in ("title", "sentences", "numbers", "authors"):
        assert r[c][0] == r[c][1] and len(r[c][0]), c
    assert len(r["keywords"][0]) == 1 and not any(len(r[c][2]) for c in ("title", "sentences", "numbers", "authors", "keywords")) and K.specifics(one["title"]) == ["gen1"]


def test_works_are_found_and_siblings_are_not(spark):
    data = world()
    got = K.linked(spark.createDataFrame(data, SCHEMA)).collect()
    want = {(f"10.9101/2020.01.01.{k:07d}", f"6{k:05d}") for k in range(60)}
    assert {(r.paper_id_a, r.paper_id_b) for r in got} == want and all(0.5 <= r.confidence <= 1 for r in got)


def test_repeats_nulls_and_empty(spark):
    data = world(30)
    base = {(r.paper_id_a, r.paper_id_b) for r in K.linked(spark.createDataFrame(data, SCHEMA)).collect()}
    odd = [paper(None, None), paper("n1", None), paper("n2", "pubmed", "", "", "[", "soon", "n/a", "[]"), paper("long", "pubmed", "w " * 3000, "Long text goes on and on. " * 2000, "[]")]
    again = spark.createDataFrame(data + data[:20] + odd, SCHEMA).withColumn("id", F.lit(1)).withColumn("a", F.lit(2)).withColumn("key", F.lit(3))
    assert {(r.paper_id_a, r.paper_id_b) for r in K.linked(again).collect()} == base
    assert K.linked(spark.createDataFrame([], SCHEMA)).count() == 0


def consortium(n, size):
    """Works of one team without abstract and doi, each with a title of its own."""
    names = "[" + ", ".join(f'"Sur{c} {c.upper()}"' for c in "abcdefgh"[:size]) + "]"
    return [paper(f"8{k:05d}", "pubmed", f"organ{k}x stenosis{k}y under load{k}z of cohort{k}w", None, names, "2020-01-01") for k in range(n)]


def test_a_record_with_one_large_block_is_compared(spark):
    works = consortium(260, 5)
    short = paper("9", "biorxiv", works[100][2], None, '["Sura A", "Surb B"]', "2019-12-01")
    got = K.scored_pairs(spark.createDataFrame([*works, short], SCHEMA)).where("b = '9'").collect()
    assert max(got, key=lambda r: r.confidence).a == "800100", sorted((-r.confidence, r.a) for r in got)[:3]


SMALL = "id string, authors array<long>, title array<long>, rare array<long>, sentences array<long>, dois array<string>"


def small_profiles(spark, n=400):
    """Ids with one author pair in common; titles, sentences and identifiers agree here and there."""
    data = []
    for k in range(n):
        title = [10_000 + k // 2 * 10 + j + (500_000 if k % 2 and j == 4 else 0) for j in range(5)] + [1, 2]  # by rarity
        data.append((f"i{k:03d}", [1, 2], title if k % 7 else [], title[:4] if k % 7 else [], [k // 3 * 100 + j for j in range(3)] + [7] if k % 5 == 0 else [], [f"d{k // 4}"] if k % 11 == 0 else []))
    return spark.createDataFrame(data, SMALL), {d[0]: d for d in data}


def test_large_blocks_lose_no_pair_that_agrees_in_content(spark):
    p, of = small_profiles(spark)
    keys = {}
    for key, i in K.blocking_keys(p).collect():
        keys.setdefault(i, set()).add(key)

    def agree(a, b):
        share = lambda x, y: len(set(x) & set(y)) / max(1, min(len(x), len(y)))
        rare = len(set(a[3]) & set(b[2])) + len(set(b[3]) & set(a[2]))
        return share(a[2], b[2]) >= 0.8 or share(a[4], b[4]) >= 0.4 or set(a[5]) & set(b[5]) or rare >= 0.6 * max(1, len(a[3]) + len(b[3]))

    every = {(a, b) for a in of for b in of if a < b and keys[a] & keys[b]}
    want = {(a, b) for a, b in every if agree(of[a], of[b])}
    got = set(rows(K.candidates(p, 10)))
    assert want <= got < every and len(got) < len(every) / 10
    assert set(rows(K.candidates(p, 1000))) == every and len(every) == 400 * 399 // 2  # all share the one author pair


def test_pairs_without_agreement_in_content_are_no_matches(spark):
    got = K.scored_pairs(spark.createDataFrame(consortium(60, 5), SCHEMA))
    assert got.count() == 60 * 59 // 2 and got.where("confidence > 0").count() == 0


def test_links_do_not_depend_on_the_block_size(spark):
    df = spark.createDataFrame(world(), SCHEMA)
    found = [{(r.paper_id_a, r.paper_id_b) for r in K.works(K.scored_pairs(df, block=b)).withColumnRenamed("id", "paper_id_b").withColumnRenamed("work", "paper_id_a").where("paper_id_a <> paper_id_b").collect()} for b in (1, 200)]
    assert found[0] == found[1] and len(found[0]) == 60


def test_a_short_list_of_a_large_team_meets_the_full_one(spark):
    title = [11, 12, 13, 14]
    data = [("full", list(range(40)), title, title, [], []), ("short", [37, 38, 39], title, title, [], []), ("mid", [30, 31, 32, 33, 34], title, title, [], [])]
    assert {("full", "short"), ("full", "mid")} <= set(rows(K.candidates(spark.createDataFrame(data, SMALL))))


def test_equal_profiles_are_collapsed(spark):
    one = world(1)[0]
    many = [(f"c{k:03d}", *one[1:6], None, *one[7:]) for k in range(40)]
    got = K.linked(spark.createDataFrame(world(20) + many, SCHEMA)).where("startswith(paper_id_a, 'c') and startswith(paper_id_b, 'c')")
    assert got.count() == 40 * 39 // 2


def test_label_model_learns_accuracy_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.3
    vote = lambda acc, abstain=0.2: np.where(rng.random(len(y)) < abstain, 0, np.where((rng.random(len(y)) < acc) == y, 1, -1))
    good, fair = vote(0.95), vote(0.8)
    votes = np.stack([good, vote(0.9), fair, np.where(rng.random(len(y)) < 0.9, fair, vote(0.8)), vote(0.85)], 1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = K.LabelModel().fit(patterns, counts)
    guess = model.post[inverse.ravel()] > 0.5
    assert (guess == y).mean() > 0.93 and (2, 3) in model.cliques


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(30)] + [("s0", f"s{i}") for i in range(1, 40)] + [("x", "x")]
    got = dict(rows(components(spark.createDataFrame(edges, "a string, b string"))))
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and {v for k, v in got.items() if k[0] == "s"} == {"s0"} and "x" not in got


def test_usable_fields(spark):
    df = spark.createDataFrame([("Whole text.", "2024-01-02T00:00:00Z"), ("Cut off in the mid", "2024-02-30"), ("Cut…", "2024-01"), ("n/a", None), (None, "2026-01-01"), ("No abstract available.", "2025-06-01"), ("Ends here...", " 2024-01-02 "), ('He said "yes."', "n.d.")], "a string, d string")
    got = df.select(S.whole_abstract(F.col("a")).isNotNull().alias("a"), S.whole_date(F.col("d"), F.lit(T)).cast("string").alias("d")).collect()
    assert [r.a for r in got] == [True, False, False, False, False, False, False, True]
    assert [r.d for r in got] == ["2024-01-02", None, None, None, None, "2025-06-01", "2024-01-02", None]


def test_survivors_take_the_latest_and_name_the_sole_source(spark):
    groups, papers = [], []
    for k in range(12):  # preprint before article: learned from the dated groups
        a, b = f"10.9101/p{k}", f"6{k}"
        groups += [(a, a), (b, a)]
        dated = k < 10
        papers += [paper(a, "biorxiv", "t", f"Preprint {k} text.", None, "2020-01-01" if dated else "n.d.", f"10.9101/p{k}"), paper(b, "pubmed", "t", f"Article {k} text.", None, "2021-01-01" if dated else None, None)]
    out = {r.work: r for r in S.survivors(spark.createDataFrame(papers, SCHEMA), spark.createDataFrame(groups, "id string, work string")).collect()}
    assert out["10.9101/p0"].abstract == "Article 0 text." and out["10.9101/p11"].abstract == "Article 11 text."  # the second one has no dates
    assert out["10.9101/p11"].abstract_from == "611" and out["10.9101/p0"].doi_ids == 1
    off = {r.work: r for r in S.survivors(spark.createDataFrame(papers, SCHEMA), spark.createDataFrame(groups, "id string, work string"), learn=False).collect()}
    assert off["10.9101/p11"].abstract == "Preprint 11 text." and off["10.9101/p0"].abstract == "Article 0 text."  # without precedence the fuller of the undated
    sole = set(rows(S.sole_values(S.winners(spark.createDataFrame(papers, SCHEMA), spark.createDataFrame(groups, "id string, work string")))))
    assert ("10.9101/p0", "doi", "10.9101/p0") in sole and not any(f == "abstract" for _, f, _ in sole)
    none = spark.createDataFrame([], "id string, work string")
    assert S.survivors(spark.createDataFrame(papers, SCHEMA), none).count() == 0


def test_incomparable_kinds_stay_so_and_dates_go_before_precedence(spark):
    groups, papers = [], []

    def group(name, *members):
        for i, source, text, date in members:
            groups.append((f"{name}{i}", name))
            papers.append(paper(f"{name}{i}", source, "t", text, None, date))

    for k in range(4):  # one is before two, and three before two; of one and three nothing is known
        group(f"d{k}", (1, "one", "Text.", "2020-01-01"), (2, "two", "Text!", "2021-01-01"))
        group(f"e{k}", (1, "three", "Text.", "2020-01-01"), (2, "two", "Text!", "2021-01-01"))
    group("u", (1, "one", "A short one.", None), (2, "three", "A much longer text.", None))
    group("w", (1, "one", "The longest of these three texts.", None), (2, "two", "Last.", None), (3, "three", "Some text.", None))
    group("x", (1, "two", "Earlier by date.", "2019-01-01"), (2, "one", "Later.", "2022-01-01"))
    group("y", (1, "two", "", None), (2, "one", "Only this.", None))
    out = {r.work: r for r in S.survivors(spark.createDataFrame(papers, SCHEMA), spark.createDataFrame(groups, "id string, work string")).collect()}
    assert [out[k].abstract for k in "uwxy"] == ["A much longer text.", "Last.", "Later.", "Only this."]
    assert out["u"].doi is None and out["u"].doi_ids == 0 and out["w"].abstract_ids == 3


def test_keys_are_shuffled_once_and_released(spark, monkeypatch):
    """The keys of a profile are distinct as they come, only shared ones are written, and shuffle files go when a table is stored."""
    import os

    from papyrine import session

    twice = "We saw that two kinds of stone occur. They are not alike at all. "
    p = K.profiles(spark.createDataFrame([paper(f"p{i}", title=f"Grey w{i}a stones", abstract=twice * 3 + f"Only text {i} says so once.", authors=f'["Lee, A", "Own{i}, B"]') for i in range(40)], SCHEMA))
    p = session.stored(K._enriched(session.stored(p)))
    keys = K.blocking_keys(p)
    assert keys.count() == keys.distinct().count() > 0
    wrote = {}
    kept = session.stored

    def noted(df, name="t", parts=None, release=False):
        wrote[name] = kept(df, name, parts, release)
        return wrote[name]

    monkeypatch.setattr(K, "stored", noted)
    assert K.candidates(p).count() == 40 * 39 // 2
    assert wrote["keys"].where("n < 2").count() == 0 and wrote["keys"].count() < keys.count()

    def files():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(f.startswith("shuffle_") for d in top for _, _, fs in os.walk(d) for f in fs)

    session.released(spark)
    before = files()
    session.stored(spark.range(5000).repartition(7, "id"), "t", release=True)
    assert files() <= before


def test_works_leave_no_shuffle_files(spark):
    import os

    import pandas as pd

    from papyrine import session
    from papyrine.llm import queries as Q

    def files():
        top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(f.startswith("shuffle_") for d in top for _, _, fs in os.walk(d) for f in fs)

    session.released(spark)
    before = files()
    assert Q._works(spark.createDataFrame(world(6), SCHEMA)).count() > 0
    assert files() <= before + 8  # those of the count
    row = {"id": "x", "doi": None, "own": None, "day": 0.0, "title": "A", "abstract": "B", "authors_json": '["Lee, A"]', "keywords_json": None}
    assert [len(x) for x in K._read(iter([pd.DataFrame([row] * 2500)]))] == [1000, 1000, 500]
