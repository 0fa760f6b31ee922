"""How distinctive a term is per record: smoothed language-model divergence.

A record's language model is smoothed with the collection's by a Dirichlet prior,
p(t|d) = (tf + mu * p(t|C)) / (length + mu). The score of a term is its contribution to the
relative entropy of the record's model against the collection's, p(t|d) * ln(p(t|d) / p(t|C)):
common terms come out near zero, terms frequent here and rare elsewhere high. Terms named by
fewer than `min_df` documents are cut off.

Defined results: nulls, empty texts and broken JSON lists count as empty; repeated rows give one
result (row_key is a hash of the whole row); documents are counted once however many rows they
have; a null document id is a document of its own; an empty table gives an empty result. Very
long texts are counted whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.common import json_strings
from papyrine.session import small, stored

#: Pseudo-count of the Dirichlet prior; the usual value for short documents.
MU = 300.0
#: Vocabularies of at most so many terms (some 20 MB) are broadcast, larger ones are shuffled.
BROADCAST_TERMS = 300_000
_RUN = re.compile(r"[a-z0-9]+")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        terms, tfs, lengths = [], [], []
        for text in b["text"]:
            c = Counter(_RUN.findall(text.lower()))
            terms.append(list(c))
            tfs.append(list(c.values()))
            lengths.append(sum(c.values()))
        yield pd.DataFrame({"row_key": b["row_key"], "row_key2": b["row_key2"], "doc": b["doc"], "terms": terms, "tfs": tfs, "length": lengths})


def record_terms(rows: DataFrame, doc: str, texts: list[str], lists: list[str]) -> DataFrame:
    """(row_key, row_key2, doc, terms, tfs, length): the term counts of every distinct row, one pass, no shuffle of terms."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in texts] + [F.array_join(json_strings(F.col(c)), "\n") for c in lists]
    values = [F.col(f"`{f.name}`") for f in sorted(rows.schema, key=lambda f: f.name) if "map<" not in f.dataType.simpleString()]
    key = F.xxhash64(*values)
    keyed = rows.select(key.alias("row_key"), F.xxhash64(F.lit("again"), *reversed(values)).alias("row_key2"), F.coalesce(F.col(doc), F.concat(F.lit("\x00"), key.cast("string"))).alias("doc"), F.concat_ws("\n", *parts).alias("text"))
    keyed = keyed.withColumn("text", F.regexp_replace("text", "\x00", " "))
    counted = keyed.mapInPandas(_count, "row_key long, row_key2 long, doc string, terms array<string>, tfs array<int>, length int")
    return counted


def collection(counted: DataFrame) -> DataFrame:
    """(term, cf, df): occurrences in all rows and distinct documents of each term.

    Documents with one row (nearly all) are counted by partial aggregation alone; only those with
    several rows need their (document, term) pairs made distinct.
    """
    n_rows = counted.groupBy("doc").agg(F.count("*").alias("n"))
    many = n_rows.where("n > 1").select("doc")
    multi = counted.join(many, "doc", "left_semi").select("doc", F.explode("terms").alias("term")).distinct()
    extra = multi.groupBy("term").agg(F.count("*").alias("df"), F.lit(0).cast("long").alias("cf"))
    zipped = counted.select("doc", F.explode(F.arrays_zip("terms", "tfs")).alias("z"))
    cf = zipped.groupBy(F.col("z.terms").alias("term")).agg(F.sum(F.col("z.tfs").cast("long")).alias("cf"))
    once = counted.join(many, "doc", "left_anti").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = once.unionByName(extra.select("term", "df"))
    return cf.join(df.groupBy("term").agg(F.sum("df").alias("df")), "term")


def divergence(tf: Column, length: Column, p: Column, mu: float) -> Column:
    """A term's contribution to the relative entropy of a record's smoothed model against the collection's."""
    own = (tf + F.lit(mu) * p) / (length + F.lit(mu))
    return own * F.log(own / p)


def _scored(counted: DataFrame, min_df: int, pattern: str | None, mu: float) -> tuple[DataFrame, DataFrame, float]:
    """The scores, the vocabulary and the number of occurrences in all."""
    # two independent hashes of 64 bits tell rows apart at any number of rows
    counted = stored(counted.dropDuplicates(["row_key", "row_key2"]).drop("row_key2"), "terms")
    vocabulary = stored(collection(counted), "vocabulary")
    total = float(vocabulary.agg(F.sum("cf").alias("n")).collect()[0]["n"] or 1)  # one number
    model = vocabulary.select("term", "df", (F.col("cf") / F.lit(total)).alias("p")).where(F.col("df") >= min_df)
    if pattern:
        model = model.where(F.col("term").rlike(pattern))
    if small(vocabulary, BROADCAST_TERMS):
        model = F.broadcast(model)
    each = counted.select("row_key", "doc", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("z")).select("row_key", "doc", "length", F.col("z.terms").alias("term"), F.col("z.tfs").alias("tf"))
    joined = each.join(model, "term")
    return joined.withColumn("score", divergence(F.col("tf"), F.col("length"), F.col("p"), mu)), vocabulary, total


def scored(counted: DataFrame, min_df: int = 1, pattern: str | None = None, mu: float = MU) -> DataFrame:
    """(row_key, doc, term, tf, df, score) for every row and term with enough documents.

    `pattern` restricts what is returned, never what is counted.
    """
    return _scored(counted, min_df, pattern, mu)[0].select("row_key", "doc", "term", "tf", "df", "score")


def characteristic(counted: DataFrame, pattern: str, least_tf: int, most_df: int, mu: float = MU) -> DataFrame:
    """As scored(), the terms whose score is at least that of a rare term named `least_tf` times in a record of this length.

    The mark is the score with the collection share of the most frequent term that at most `most_df`
    documents name. The score falls with the collection's share and, from a record's share of 1/e of
    the collection's on, rises with the occurrences; below that the mark is the least a score can be. So no term
    named `least_tf` times and by `most_df` documents is below the mark.
    """
    scores, vocabulary, total = _scored(counted, 1, pattern, mu)
    rare = vocabulary.where(F.col("df") <= most_df)
    most = rare.where(F.col("term").rlike(pattern)).agg(F.max("cf").alias("m")).collect()[0]["m"] or 1  # one number
    p = F.lit(most / total)
    at = divergence(F.lit(least_tf), F.col("length"), p, mu)
    rising = (F.lit(least_tf) + F.lit(mu) * p) / (F.col("length") + F.lit(mu)) > p / F.lit(math.e)
    mark = F.when(rising, at).otherwise(-p / F.lit(math.e)) - F.lit(1e-12)
    return scores.where(F.col("score") >= mark).select("row_key", "doc", "term", "tf", "df", "score")
