"""Entities, headings and the co-occurrence graph on the small fixtures."""

import pytest
from pyspark.sql import functions as F

from papyrine.operators import entities as E
from papyrine.operators import graph as G
from papyrine.sources import sinks
from tests.conftest import rows

DOCS = "paper_id string, text string"


@pytest.fixture(scope="module")
def patterns(spark):
    return E.pattern_table(spark).cache()


def lists(spark, patterns, *texts, statistical=False):
    out = E.extract(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], DOCS), patterns, statistical)
    return {r.paper_id: (r.genes, r.diseases) for r in out.collect()}


def test_dictionary_sentences(spark, patterns):
    got = lists(spark, patterns, "BRCA1 mutations cause breast cancer. brca1 again.", "Cardiac arrhythmia is common.", "EGFR and HER2 expression.", "The weather was sunny.", "", None, "Tumors and HER-2 in type 2 diabetes, Alzheimer's")
    assert got["0"] == (["brca1"], ["breast cancer"]) and got["1"] == ([], ["arrhythmia"]) and got["2"] == (["egfr", "her2"], [])
    assert got["3"] == got["4"] == got["5"] == ([], [])
    assert got["6"] == (["her-2"], ["type 2 diabetes", "alzheimer's"])


def test_runtime_names(spark, patterns):
    more = E.add_pattern(E.add_pattern(patterns, "FOXP3", "GENE"), "Crohn's disease", "DISEASE")
    assert lists(spark, more, "FOXP3 in Crohn's disease")["0"] == (["foxp3"], ["crohn's disease"])
    with pytest.raises(ValueError):
        E.add_pattern(patterns, " ", "GENE")


def test_gene_like(spark):
    good = "TP53 BRCA1 BRCA2 EGFR KRAS APOE PTEN MYC FOXP3 CDK4 HER-2".split()
    bad = "tp53 Tp53 brca1 CI IQR HR OR RR SD SE AUC ROC RNA DNA P5 ABCDEFGHIJ 12345".split() + ["BR CA1"]
    df = spark.createDataFrame([(w,) for w in good + bad], "w string")
    assert {r.w for r in df.where(E.gene_like(F.col("w"))).collect()} == set(good)


def test_dictionary_before_model_and_no_overlaps(spark, patterns):
    docs = spark.createDataFrame([("1", "TP53 and XYZ7 in lung cancer"), ("2", "IQR")], DOCS)
    found = E.dictionary_mentions(docs, patterns).unionByName(E.model_mentions(docs))
    got = rows(E.resolve(found).select("paper_id", "text", "label", "source"))
    assert got == [("1", "lung cancer", "DISEASE", "ruler"), ("1", "tp53", "GENE", "ruler"), ("1", "xyz7", "GENE", "stat")]
    tag = lambda texts: [[(0, 4, "EVENT"), (0, 4, "DATE")] for _ in texts]
    assert rows(E.model_mentions(spark.createDataFrame([("9", "Zika outbreak")], DOCS), tag).select("text", "label")) == [("zika", "DISEASE")]


def test_headings(spark):
    df = spark.createDataFrame([("1", ["Humans", "Female", "Breast Neoplasms", "BRCA1 Protein", "Case Reports", "Neoplasm Staging"]), ("2", ["Carcinoma, Non-Small-Cell Lung"]), ("3", ["Neoplasms", "Carcinoma", "Neoplasms"]), ("4", None)], "paper_id string, k array<string>")
    got = {r.paper_id: r.h for r in df.select("paper_id", E.heading_diseases(F.col("k")).alias("h")).collect()}
    assert got == {"1": ["breast cancer", "brca1 protein", "neoplasm staging"], "2": ["non-small cell lung cancer"], "3": ["cancer"], "4": []}
    ents = spark.createDataFrame([("1", ["g"], ["breast cancer"]), ("x", ["g"], [])], "paper_id string, genes array<string>, diseases array<string>")
    fused = {r.paper_id: r.diseases for r in E.fuse(ents, df.select("paper_id", E.heading_diseases(F.col("k")).alias("headings"))).collect()}
    assert fused == {"1": ["breast cancer", "brca1 protein", "neoplasm staging"], "x": []}


LISTS = "paper_id string, genes array<string>, diseases array<string>"
FIVE = [("p1", ["brca1", "tp53"], ["breast cancer", "cancer"]), ("p2", ["kras", "tp53"], ["lung cancer", "cancer"]), ("p3", ["egfr"], ["lung cancer"]), ("p4", ["brca1"], ["ovarian cancer"]), ("p5", [], [])]


@pytest.fixture(scope="module")
def five(spark):
    return G.build(spark.createDataFrame(FIVE, LISTS))


def test_graph_numbers(five):
    e = {(r.a, r.b): r.weight for r in five.edges.collect()}
    assert len(e) == 13 and e["cancer", "tp53"] == 2 and ("brca1", "lung cancer") not in e
    s = G.summary(five).collect()[0]
    assert (s.total_nodes, s.gene_nodes, s.disease_nodes, s.total_edges, s.gene_disease_pairs, s.density, s.connected_components, s.largest_component_size) == (8, 4, 4, 13, 9, 0.464286, 1, 8)


def test_graph_reads(five):
    assert [r.neighbour for r in G.neighbours(five, "egfr").collect()] == ["lung cancer"] and G.neighbours(five, "none").count() == 0
    assert {r.entity for r in G.ego(five, "EGFR", 1).nodes.collect()} == {"egfr", "lung cancer"}
    assert G.ego(five, "egfr", 2).nodes.count() == 5 and G.ego(five, "nobody").nodes.count() == 0
    assert G.top_edges(five, 1).collect()[0].weight == 2 and G.top_entities(five, "GENE", 1).collect()[0].entity == "tp53"
    assert "tp53" in G.to_dot(five) and sinks.edge_list(G.typed_edges(five)).first().weight == 2


def test_graph_counts(spark):
    build = lambda data: G.build(spark.createDataFrame(data, LISTS))
    twice = build([FIVE[3], FIVE[3]])
    assert rows(twice.edges) == [("brca1", "ovarian cancer", 2)] and {r.paper_count for r in twice.nodes.collect()} == {1}
    assert rows(build([("p", ["a", "a"], ["d"])]).edges) == [("a", "d", 1)]
    assert rows(build([("p", ["tp53"], ["x", "tp53"])]).edges) == [("tp53", "x", 2)]
    islands = build([("p", ["a"], ["b"]), ("q", ["c"], ["d"]), ("r", ["e"], [])])
    assert G.components(islands).select("root").distinct().count() == 3
    pruned = G.prune(islands, 2)
    assert pruned.nodes.count() == 0 and pruned.edges.count() == 0
    empty = build([("p", [], None)])
    s = G.summary(empty).collect()[0]
    assert (s.total_nodes, s.total_edges, s.density, s.connected_components) == (0, 0, 0.0, 0)


def test_graph_merge_and_round_trip(spark, five):
    one = G.build(spark.createDataFrame(FIVE[:1], LISTS))
    m = G.merge(one, G.build(spark.createDataFrame(FIVE[:1], LISTS)))
    assert {r.weight for r in m.edges.collect()} == {2} and {r.paper_count for r in m.nodes.collect()} == {1}
    back = G.from_node_link(G.to_node_link(five))
    assert rows(back.edges) == rows(five.edges) and rows(back.nodes) == rows(five.nodes) and back.provenance is None
    assert {r.paper_count for r in G.merge(G.Graph(one.nodes, one.edges), one).nodes.collect()} == {2}
