"""Dictionary and model-based entities, overlap resolution, subject headings and their fusion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import vocabulary as V
from papyrine.functions.text import canonical_entity, strip

#: Longest dictionary name in tokens; names are looked up as n-grams of one to so many.
MOST_TOKENS = 3
#: Dictionaries of at most so many names (some 5 MB) are broadcast, larger ones are shuffled.
BROADCAST_NAMES = 100_000
#: Dictionaries of at most so many names are looked up inside the row, so only hits leave it.
LITERAL_NAMES = 2_000
#: Pieces of a text: "'s", runs of letters and digits, white space, other signs; together they are the text.
WHITE = r" \t\n\x0b\f\r"
PIECE = r"('s\b|[\p{L}\p{N}]+|[" + WHITE + r"]+|[^\p{L}\p{N}" + WHITE + "])"


def pattern_table(spark: SparkSession, genes: list[str] | None = None, diseases: list[str] | None = None) -> DataFrame:
    """(name, label): dictionary names as tokens joined by blanks, # for a number."""
    g = V.GENES if genes is None else genes
    d = V.DISEASES if diseases is None else diseases
    return spark.createDataFrame([(n, "GENE") for n in g] + [(n, "DISEASE") for n in d], "name string, label string")


def add_pattern(patterns: DataFrame, name: str, label: str) -> DataFrame:
    """The dictionary with one name more; a blank name is an error."""
    if not name.strip():
        raise ValueError("a name must not be blank")
    tokens = name.strip().lower().replace("-", " - ").replace("'s", " 's").split()
    return patterns.unionByName(patterns.sparkSession.createDataFrame([(" ".join(tokens), label)], "name string, label string"))


#: A run of letters, digits and hyphens that is a name by its capitals.
_CAPITALS = re.compile(r"(?<![A-Za-z0-9\-])[A-Z][A-Z0-9\-]{2,7}(?![A-Za-z0-9\-])")


def token_spans(docs: DataFrame) -> DataFrame:
    """(paper_id, body, t): t the array of (token, start, end) of a text: runs of letters and digits, "'s", other signs.

    One pass over each text in Arrow batches; in the expression language a running offset copies its list at every token.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex

        piece = regex.compile(PIECE)
        for b in batches:
            spans = [[{"token": m.group(), "start": m.start(), "end": m.end()} for m in piece.finditer(t) if m.group()[0] not in " \t\n\x0b\f\r"] for t in b["body"]]
            yield b.assign(t=spans)

    texts = docs.select("paper_id", F.coalesce("text", F.lit("")).alias("body"))
    return texts.mapInPandas(run, "paper_id string, body string, t array<struct<token:string,start:int,end:int>>")


def _gram(n: int) -> Callable[[Column], Column]:
    """The n tokens from a position on: names as they are and with # for numbers, and the span."""
    plain = lambda x: F.lower(x["token"])
    typed = lambda x: F.when(x["token"].rlike(r"^\d+$"), "#").otherwise(F.lower(x["token"]))
    joined = lambda i, form: F.array_join(F.transform(F.slice("t", i, n), form), " ")
    return lambda i: F.struct(F.array_distinct(F.array(joined(i, plain), joined(i, typed))).alias("names"), F.element_at("t", i)["start"].alias("start_char"), F.element_at("t", i + (n - 1))["end"].alias("end_char"))


def dictionary_mentions(docs: DataFrame, patterns: DataFrame, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """(paper_id, text, label, source, start_char, end_char) of all dictionary hits, overlaps included.

    `docs`: paper_id, text. n-grams of tokens meet the dictionary in an equi-join; tokens match whole, in any case.
    """
    from papyrine.session import small

    listed = patterns.select("name", "label").distinct().limit(LITERAL_NAMES + 1).collect()  # a bounded number of names
    if len(listed) <= LITERAL_NAMES:
        return _literal_mentions(docs, patterns, sorted({r["name"] for r in listed}), most_tokens)
    spans = token_spans(docs)
    grams = []
    for n in range(1, most_tokens + 1):
        at = F.sequence(F.lit(1), F.greatest(F.size("t") - n + 1, F.lit(1)))
        grams.append(spans.select("paper_id", "body", F.explode(F.when(F.size("t") >= n, F.transform(at, _gram(n)))).alias("g")))
    every = grams[0]
    for g in grams[1:]:
        every = every.unionByName(g)
    table = patterns.select("name", "label").distinct()
    table = F.broadcast(table) if small(table, BROADCAST_NAMES) else table
    hit = every.select("paper_id", "body", F.explode("g.names").alias("name"), "g.start_char", "g.end_char").join(table, "name")
    text = canonical_entity(F.substring("body", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
    return hit.select("paper_id", text.alias("text"), "label", F.lit("ruler").alias("source"), "start_char", "end_char")


def _literal_mentions(docs: DataFrame, patterns: DataFrame, names: list[str], most_tokens: int) -> DataFrame:
    """The same for a short dictionary: n-grams are tested inside the row, offsets come with the tokens."""
    rows = token_spans(docs).withColumn("t", F.transform("t", lambda x: F.struct(F.lower(x["token"]).alias("token"), x["start"].alias("start"), x["end"].alias("end"))))
    hits = F.array().cast("array<struct<name:string,first:int,last:int>>")
    for n in range(1, most_tokens + 1):
        known = sorted(x for x in names if len(x.split(" ")) == n)
        if known:
            hits = F.concat(hits, _literal_grams(n, known))
    spans = rows.select("paper_id", "body", F.explode(hits).alias("h")).select("paper_id", "body", F.col("h.name").alias("name"), F.col("h.first").alias("start_char"), F.col("h.last").alias("end_char"))
    hit = spans.join(F.broadcast(patterns.select("name", "label").distinct()), "name")
    text = canonical_entity(F.substring("body", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")))
    return hit.select("paper_id", text.alias("text"), "label", F.lit("ruler").alias("source"), "start_char", "end_char")


def _literal_grams(n: int, known: list[str]) -> Column:
    """The n-grams of column t that are known names, plain or with # for numbers: (name, first character, character behind the last)."""
    number = lambda x: F.when(x["token"].rlike(r"^\d+$"), "#").otherwise(x["token"])
    plain = lambda x: x["token"]
    out = []
    for form in (plain, number):
        if form is number and not any("#" in x.split(" ") for x in known):
            continue
        if n == 1:
            grams = F.transform("t", _single(form))
        else:
            grams = F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - (n - 1), F.lit(1))), _joined(n, form))).otherwise(F.array().cast("array<struct<name:string,first:int,last:int>>"))
        out.append(F.filter(grams, lambda g: g["name"].isin(known)))
    return F.array_distinct(F.concat(*out))


def _single(form: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(form(x).alias("name"), x["start"].alias("first"), x["end"].alias("last"))


def _joined(n: int, form: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda i: F.struct(F.array_join(F.transform(F.slice("t", i, n), form), " ").alias("name"), F.element_at("t", i)["start"].alias("first"), F.element_at("t", i + (n - 1))["end"].alias("last"))


def gene_like(c: Column) -> Column:
    """No blank, 3 to 8 capitals, digits or hyphens beginning with a capital, two letters at least, no common word."""
    stop = c.isin(V.NOT_GENES) | F.upper(c).isin(V.NOT_GENES)
    return ~c.contains(" ") & c.rlike(r"^[A-Z][A-Z0-9\-]{2,7}$") & ~stop & (F.length(F.regexp_replace(c, r"[^A-Za-z]", "")) >= 2)


def model_mentions(docs: DataFrame, tag: Callable[[list[str]], list[list[tuple[int, int, str]]]] | None = None) -> DataFrame:
    """Mentions of a statistical tagger after filtering; `tag` gives (start, end, label) for each text.

    Without a model every single token is a span without a label, so only gene-like names come out.
    """
    schema = "paper_id string, span string, tag string, start_char int, end_char int"
    if tag is None:

        def capitals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Runs that look like names, in one pass over each text."""
            for b in batches:
                rows = [(i, m.group(), "", m.start(), m.end()) for i, t in zip(b["paper_id"], b["text"], strict=True) for m in _CAPITALS.finditer(t)]
                yield pd.DataFrame(rows, columns=["paper_id", "span", "tag", "start_char", "end_char"])

        spans = docs.select("paper_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(capitals, schema)
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(i, t[s:e], label, s, e) for i, t, found in zip(b["paper_id"], b["text"], tag(list(b["text"])), strict=True) for s, e, label in found]
                yield pd.DataFrame(rows, columns=["paper_id", "span", "tag", "start_char", "end_char"])

        spans = docs.select("paper_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in V.TAGGER_LABELS.items() for x in kv]), F.col("tag"))
    label = F.when(gene_like(F.col("span")), "GENE").otherwise(mapped)
    single = ~strip(F.col("span")).contains(" ")
    return spans.where(single).withColumn("label", label).where("label is not null").select("paper_id", canonical_entity(F.col("span")).alias("text"), "label", F.lit("stat").alias("source"), "start_char", "end_char")


def resolve(mentions: DataFrame) -> DataFrame:
    """Mentions without overlaps: by start, dictionary before model, longer first; kept if it begins after the last kept one ends."""
    order = F.struct("start_char", F.when(F.col("source") == "ruler", 0).otherwise(1).alias("rank"), (-F.col("end_char")).alias("longer"), "end_char", "text", "label", "source")
    spans = mentions.groupBy("paper_id").agg(F.array_sort(F.collect_list(order)).alias("spans"))  # the mentions of one paper
    kind = "array<struct<start_char:int,rank:int,longer:int,end_char:int,text:string,label:string,source:string>>"
    kept = F.aggregate(
        F.col("spans").cast(kind),
        F.struct(F.lit(-1).alias("last"), F.array().cast(kind).alias("out")),
        lambda acc, s: F.when(s["start_char"] >= acc["last"], F.struct(s["end_char"].alias("last"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )
    return spans.select("paper_id", F.explode(kept).alias("s")).select("paper_id", "s.text", "s.label", "s.source", "s.start_char", "s.end_char")


def by_paper(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(paper_id, genes, diseases): distinct names in order of first mention; papers without any have empty lists."""
    first = mentions.groupBy("paper_id", "label", "text").agg(F.min("start_char").alias("at"))
    pick = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("at", "text")))), lambda s: s["text"])
    lists = first.groupBy("paper_id").agg(pick("GENE").alias("genes"), pick("DISEASE").alias("diseases"))
    none = F.array().cast("array<string>")
    return docs.select("paper_id").distinct().join(lists, "paper_id", "left").select("paper_id", F.coalesce("genes", none).alias("genes"), F.coalesce("diseases", none).alias("diseases"))


def extract(docs: DataFrame, patterns: DataFrame, statistical: bool = False) -> DataFrame:
    """(paper_id, genes, diseases) of texts by dictionary, and by capitals with `statistical`."""
    found = dictionary_mentions(docs, patterns)
    if statistical:
        found = found.unionByName(model_mentions(docs))
    return by_paper(docs, resolve(found))


def heading_diseases(keywords: Column, noise: list[str] | None = None, synonyms: dict[str, str] | None = None) -> Column:
    """Disease names of subject headings: noise dropped, canonical form, synonyms merged, distinct in order."""
    noise = [t.lower() for t in (V.HEADING_NOISE if noise is None else noise)]
    synonyms = V.HEADING_SYNONYMS if synonyms is None else synonyms
    names = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), canonical_entity)
    kept = F.filter(names, lambda k: (k != "") & ~k.isin(noise))
    if synonyms:
        mapped = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        kept = F.transform(kept, lambda k: F.coalesce(F.element_at(mapped, k), k))
    return F.array_distinct(kept)


def fuse(entities: DataFrame, headings: DataFrame) -> DataFrame:
    """Entities with the heading diseases appended that they lack. `headings`: (paper_id, headings)."""
    joined = entities.join(headings, "paper_id", "left")
    more = F.array_except(F.coalesce("headings", F.array().cast("array<string>")), F.col("diseases"))
    return joined.select("paper_id", "genes", F.concat("diseases", more).alias("diseases"))


def missing(papers: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers with cached entities and papers without."""
    ids = cached.select("paper_id").distinct()
    return papers.join(ids, "paper_id", "left_semi"), papers.join(ids, "paper_id", "left_anti")
