"""Relevance labels: merging replies, import, review and acceptance, as joins and updates of whole relations.

A sheet has query_id, source, paper_id, relevant and more columns; a document is named source:paper_id.
Labels are never overwritten: only rows without one take a value. Rows of a judge are (query_id, docid,
relevant), relevant 0, 1 or NA. Nulls in a key match nothing; repeated rows of a sheet are all updated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.functions.text import strip

KEY = ["query_id", "docid"]


def docid() -> Column:
    return F.concat(strip(F.col("source")), F.lit(":"), strip(F.col("paper_id")))


def unlabeled(sheet: DataFrame) -> DataFrame:
    """(query_id, rows, unlabeled) of a sheet."""
    return sheet.groupBy("query_id").agg(F.count("*").alias("rows"), F.count_if(F.col("relevant").isNull()).alias("unlabeled"))


def merged(replies: DataFrame) -> DataFrame:
    """Replies of several files as one relation; a document judged twice in a query is an error."""
    one = replies.groupBy(*KEY).agg(F.count("*").alias("n"), F.first("relevant").alias("relevant"), *[F.first(c).alias(c) for c in replies.columns if c not in (*KEY, "relevant")])
    return one.withColumn("relevant", F.when(F.col("n") == 1, F.col("relevant")).otherwise(F.raise_error(F.concat(F.lit("judged twice: "), "query_id", F.lit(" "), "docid")))).drop("n")


def problems(sheet: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, docid, problem): replies to no row of the sheet, open rows without a reply, and documents judged twice."""
    rows = sheet.select("query_id", docid().alias("docid"), F.col("relevant").isNull().alias("open")).groupBy(*KEY).agg(F.max("open").alias("open"))
    judged = replies.groupBy(*KEY).agg(F.count("*").alias("n"))
    both = rows.join(judged, KEY, "full")
    what = F.when(F.col("open").isNull(), "unknown").when(F.col("n") > 1, "twice").when(F.col("open") & F.col("n").isNull(), "missing")
    return both.select(*KEY, what.alias("problem")).where("problem is not null")


def imported(sheet: DataFrame, replies: DataFrame, abstracts: DataFrame | None = None) -> DataFrame:
    """The sheet with the replies as labels of rows that have none, and `origin`: kept, imported, no_abstract or open.

    NA is a label of 0 where `abstracts` (docid) says that the paper has none to judge by; otherwise the row stays open.
    """
    judged = replies.where("relevant is not null").groupBy(*KEY).agg(F.min("relevant").alias("reply"))
    j = sheet.withColumn("docid", docid()).join(judged, KEY, "left")
    if abstracts is None:
        j = j.withColumn("readable", F.lit(True))
    else:
        j = j.join(abstracts.select("docid", F.lit(True).alias("readable")).distinct(), "docid", "left")
    given = F.col("reply").isin("0", "1")
    none = (F.col("reply") == "NA") & F.col("readable").isNull()
    label = F.when(F.col("relevant").isNotNull(), F.col("relevant")).when(given, F.col("reply").try_cast("int")).when(none, 0)
    origin = F.when(F.col("relevant").isNotNull(), "kept").when(given, "imported").when(none, "no_abstract").otherwise("open")
    return j.withColumns({"relevant": label, "origin": origin}).select(*sheet.columns, "origin")


def review_sheet(sheet: DataFrame, proposals: DataFrame, flagged: str | None = None) -> DataFrame:
    """Rows with a proposed label for a human to confirm; with `flagged` only those whose confidence is that word."""
    p = proposals if flagged is None else proposals.where(F.col("confidence") == flagged)
    one = p.groupBy(*KEY).agg(F.min("relevant").alias("proposed"), F.min("confidence").alias("confidence"), F.min("reason").alias("reason"))
    return sheet.withColumn("docid", docid()).join(one, KEY).withColumn("final", F.lit(None).cast("string")).select(*sheet.columns, "proposed", "confidence", "reason", "final")


def accepted(sheet: DataFrame, proposals: DataFrame, reviewed: DataFrame) -> DataFrame:
    """The sheet with final labels: the label there is, else the reviewed one, else the proposal; `origin` says which."""
    human = reviewed.where(F.col("final").isin("0", "1")).groupBy(*KEY).agg(F.min("final").alias("human"))
    machine = proposals.where(F.col("relevant").isin("0", "1")).groupBy(*KEY).agg(F.min("relevant").alias("proposed"))
    j = sheet.withColumn("docid", docid()).join(human, KEY, "left").join(machine, KEY, "left")
    label = F.coalesce(F.col("relevant"), F.col("human").try_cast("int"), F.col("proposed").try_cast("int"))
    origin = F.when(F.col("relevant").isNotNull(), "kept").when(F.col("human").isNotNull(), "reviewed").when(F.col("proposed").isNotNull(), "accepted").otherwise("open")
    return j.withColumns({"relevant": label, "origin": origin}).select(*sheet.columns, "origin")


def override_rate(reviewed: DataFrame) -> DataFrame:
    """(reviewed, overridden, rate, kappa) of rows with a proposed and a final label of 0 or 1."""
    both = reviewed.where(F.col("proposed").isin("0", "1") & F.col("final").isin("0", "1"))
    c = both.agg(F.count("*").alias("reviewed"), F.count_if(F.col("proposed") != F.col("final")).alias("overridden"), F.count_if(F.col("proposed") == "1").alias("p"), F.count_if(F.col("final") == "1").alias("f"))
    n = F.col("reviewed")
    agree = 1 - F.col("overridden") / n
    chance = (F.col("p") * F.col("f") + (n - F.col("p")) * (n - F.col("f"))) / (n * n)
    kappa = F.when(n > 0, F.when(chance == 1, F.lit(1.0)).otherwise((agree - chance) / (1 - chance)))
    return c.select("reviewed", "overridden", F.round(F.when(n > 0, F.col("overridden") / n), 6).alias("rate"), F.round(kappa, 6).alias("kappa"))
