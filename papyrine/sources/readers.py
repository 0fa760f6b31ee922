"""Readers: literature payloads, label sheets, TREC and BEIR files, query catalogues, graphs, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import vocabulary as V
from papyrine.functions.text import clean_abstract, default_url, split_authors, strip

PAPER = "paper_id string, title string, abstract string, authors array<string>, published_date timestamp, source string, doi string, journal string, keywords array<string>, url string"

_XML = """
MedlineCitation struct<
  PMID string,
  Article struct<
    ArticleTitle string,
    Abstract struct<AbstractText array<string>>,
    AuthorList struct<Author array<struct<LastName string, Initials string>>>,
    Journal struct<Title string, JournalIssue struct<PubDate struct<Year string, Month string, Day string, MedlineDate string>>>>,
  MedlineJournalInfo struct<MedlineTA string>,
  MeshHeadingList struct<MeshHeading array<struct<DescriptorName string>>>>
"""


def pub_date(year: Column, month: Column, day: Column, medline: Column) -> Column:
    """Year with a month by name or number (clamped), day (clamped); an impossible day is the first of January; else a year in the free text."""
    months = F.create_map(*[F.lit(x) for kv in V.MONTHS.items() for x in kv])
    m = F.coalesce(F.element_at(months, F.lower(strip(month))), F.least(F.greatest(strip(month).try_cast("int"), F.lit(1)), F.lit(12)), F.lit(1))
    d = F.coalesce(F.least(F.greatest(strip(day).try_cast("int"), F.lit(1)), F.lit(31)), F.lit(1))
    y = strip(year).try_cast("int")
    zero = F.lit(0)
    exact = F.try_make_timestamp(y, m, d, zero, zero, zero)
    first = F.try_make_timestamp(y, F.lit(1), F.lit(1), zero, zero, zero)
    free = F.regexp_extract(F.coalesce(medline, F.lit("")), r"((?:19|20)\d{2})", 1).try_cast("int")
    return F.coalesce(exact, first, F.try_make_timestamp(free, F.lit(1), F.lit(1), zero, zero, zero))


def _plain(c: Column) -> Column:
    """Text of an element with inline markup."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"</?[A-Za-z][^<>]*>", ""))


def pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """PubMed article sets as papers; records without id or title are left out."""
    return _pubmed(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(_XML.replace("\n", " ")).load(path))


def pubmed_payloads(payloads: DataFrame) -> DataFrame:
    """The same from payloads (column payload), as the data source of the fetcher gives them."""
    one = payloads.select(F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)(<PubmedArticle[ >].*?</PubmedArticle>)"), F.lit(1))).alias("x"))
    return _pubmed(one.select(F.from_xml("x", _XML.replace("\n", " ")).alias("r")).select("r.*"))


def search_ids(payloads: DataFrame) -> DataFrame:
    """(place, paper_id) of id-search replies, in the order of the reply."""
    ids = F.from_json("payload", "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]
    return payloads.select(F.posexplode(ids).alias("place", "paper_id"))


def _pubmed(raw: DataFrame) -> DataFrame:
    c, a = "MedlineCitation", "MedlineCitation.Article"
    d = f"{a}.Journal.JournalIssue.PubDate"
    authors = F.filter(F.transform(F.col(f"{a}.AuthorList.Author"), lambda x: F.concat_ws(" ", x["LastName"], x["Initials"])), lambda s: s != "")
    none = F.array().cast("array<string>")
    pid = strip(F.col(f"{c}.PMID"))
    return raw.select(
        pid.alias("paper_id"),
        _plain(F.col(f"{a}.ArticleTitle")).alias("title"),
        clean_abstract(F.concat_ws(" ", F.transform(F.col(f"{a}.Abstract.AbstractText"), _plain))).alias("abstract"),
        F.coalesce(authors, none).alias("authors"),
        pub_date(*[F.col(f"{d}.{x}") for x in ("Year", "Month", "Day", "MedlineDate")]).alias("published_date"),
        F.lit("pubmed").alias("source"),
        F.lit(None).cast("string").alias("doi"),
        F.coalesce(strip(F.col(f"{a}.Journal.Title")), strip(F.col(f"{c}.MedlineJournalInfo.MedlineTA"))).alias("journal"),
        F.coalesce(F.transform(F.col(f"{c}.MeshHeadingList.MeshHeading"), lambda h: h["DescriptorName"]), none).alias("keywords"),
        default_url(F.lit(None).cast("string"), F.lit("pubmed"), pid, F.lit(None).cast("string")).alias("url"),
    ).where("paper_id <> '' and title <> ''")


def preprint_json(spark: SparkSession, path: str, server: str = "biorxiv") -> DataFrame:
    """Preprint pages ({messages, collection}) as papers; items need doi and title."""
    item = "struct<doi:string,title:string,abstract:string,authors:string,date:string,category:string>"
    return _preprints(spark.read.schema(f"collection array<{item}>").option("multiLine", True).json(path), server)


def preprint_payloads(payloads: DataFrame, server: str = "biorxiv") -> DataFrame:
    """The same from payloads (column payload)."""
    item = "struct<doi:string,title:string,abstract:string,authors:string,date:string,category:string>"
    return _preprints(payloads.select(F.from_json("payload", f"collection array<{item}>")["collection"].alias("collection")), server)


def _preprints(pages: DataFrame, server: str) -> DataFrame:
    raw = pages.select(F.explode("collection").alias("i"))
    doi, title = strip(F.col("i.doi")), strip(F.col("i.title"))
    authors = F.when(F.col("i.authors").contains(";"), split_authors(F.col("i.authors"), ";")).otherwise(split_authors(F.col("i.authors"), ","))
    category = strip(F.coalesce("i.category", F.lit("")))
    name = server[:1].upper() + server[1:]
    return raw.select(
        doi.alias("paper_id"), title.alias("title"), clean_abstract(F.col("i.abstract")).alias("abstract"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
        F.try_to_timestamp(F.col("i.date"), F.lit("yyyy-MM-dd")).alias("published_date"), F.lit("biorxiv").alias("source"), doi.alias("doi"),
        F.when(category != "", F.concat(F.lit(f"{name} - "), category)).otherwise(name).alias("journal"),
        F.when(category != "", F.array(category)).otherwise(F.array().cast("array<string>")).alias("keywords"),
        default_url(F.lit(None).cast("string"), F.lit("biorxiv"), doi, doi).alias("url"),
    ).where("paper_id <> '' and title <> ''")


def europe_pmc_json(spark: SparkSession, path: str, server: str = "biorxiv") -> DataFrame:
    """Europe PMC preprint results as papers: tags stripped, the year's first day as date."""
    item = "struct<doi:string,title:string,abstractText:string,authorList:struct<author:array<struct<fullName:string>>>,pubYear:string>"
    return _europe_pmc(spark.read.schema(f"resultList struct<result:array<{item}>>").option("multiLine", True).json(path), server)


def europe_pmc_payloads(payloads: DataFrame, server: str = "biorxiv") -> DataFrame:
    """The same from payloads (column payload)."""
    item = "struct<doi:string,title:string,abstractText:string,authorList:struct<author:array<struct<fullName:string>>>,pubYear:string>"
    return _europe_pmc(payloads.select(F.from_json("payload", f"resultList struct<result:array<{item}>>")["resultList"].alias("resultList")), server)


def _europe_pmc(pages: DataFrame, server: str) -> DataFrame:
    raw = pages.select(F.explode("resultList.result").alias("i"))
    bare = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))
    doi = strip(F.col("i.doi"))
    names = F.filter(F.transform(F.col("i.authorList.author"), lambda x: x["fullName"]), lambda s: F.coalesce(s, F.lit("")) != "")
    return raw.select(
        doi.alias("paper_id"), bare(F.col("i.title")).alias("title"), clean_abstract(bare(F.col("i.abstractText"))).alias("abstract"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.try_make_timestamp(F.col("i.pubYear").try_cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("published_date"), F.lit("biorxiv").alias("source"), doi.alias("doi"),
        F.lit(f"{server[:1].upper()}{server[1:]} (Europe PMC)").alias("journal"), F.array().cast("array<string>").alias("keywords"), default_url(F.lit(None).cast("string"), F.lit("biorxiv"), doi, doi).alias("url"),
    ).where("paper_id <> '' and title <> ''")


SHEET = ["query_id", "query_text", "source", "paper_id", "title", "abstract_preview", "url", "tfidf_rank", "biobert_rank", "relevant", "notes"]


def label_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Label sheets (CSV with header, quoted line breaks, an optional byte-order mark), blanks as null, labels checked."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    lost = [c for c in SHEET if c not in raw.columns]
    if lost:
        raise ValueError(f"columns are missing: {lost}")
    label = strip(F.coalesce("relevant", F.lit("")))
    checked = F.when(label.isin("0", "1"), label.cast("int")).when(label == "", F.lit(None).cast("int")).otherwise(F.raise_error(F.concat(F.lit("relevant must be 0, 1 or blank: "), label)))
    rank = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", strip(F.col(c)).cast("int")).alias(c)
    return raw.select(*SHEET[:7], rank("tfidf_rank"), rank("biobert_rank"), checked.alias("relevant"), "notes")


def _fields(spark: SparkSession, path: str, n: int) -> DataFrame:
    # a file's splits are read in order, so the ids rise with the lines of a file
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    lines = lines.where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"), "value", "file", "line")
    return lines.select(F.when(F.size("f") == n, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"not {n} fields: "), F.col("value")))).alias("f"), "file", "line")


def trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, grade) of four-field judgments; the last grade of a repeated pair counts, files in order of name."""
    f = _fields(spark, path, 4)
    rows = f.select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("docid"), F.col("f")[3].cast("int").alias("grade"), F.struct("file", "line").alias("at"))
    return rows.groupBy("qid", "docid").agg(F.max_by("grade", "at").alias("grade"))


def trec_run(spark: SparkSession, path: str) -> DataFrame:
    """(system, qid, docid, rank, score) of six-field run lines; a document twice in a query is an error."""
    f = _fields(spark, path, 6)
    rows = f.select(F.col("f")[5].alias("system"), F.col("f")[0].alias("qid"), F.col("f")[2].alias("docid"), F.col("f")[3].cast("int").alias("rank"), F.col("f")[4].cast("double").alias("score"))
    one = rows.groupBy("system", "qid", "docid").agg(F.count("*").alias("n"), F.min("rank").alias("rank"), F.max("score").alias("score"))
    return one.select("system", "qid", F.when(F.col("n") == 1, F.col("docid")).otherwise(F.raise_error(F.concat(F.lit("twice in a query: "), F.col("docid")))).alias("docid"), "rank", "score")


def beir(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a BEIR folder."""
    corpus = spark.read.schema("_id string, title string, text string, metadata map<string,string>").json(f"{folder}/corpus.jsonl")
    queries = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl")
    qrels = spark.read.option("header", True).option("sep", "\t").schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels")
    return corpus, queries, qrels


def query_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(qid, category, query, origin) of a catalogue file."""
    item = "struct<qid:string,category:string,query:string,origin:string>"
    return spark.read.schema(f"version string, note string, queries array<{item}>").option("multiLine", True).json(path).select(F.inline("queries"))


def judge_replies(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, docid, relevant, confidence, reason) of reply texts: fences, footers, headers and blank lines dropped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '```') and not startswith(trim(value), 'ROWS:') and not startswith(trim(value), 'query_id,')")
    row = F.from_csv("value", "query_id string, docid string, relevant string, confidence string, reason string", {"quote": '"', "escape": '"'})
    rows = lines.select(row.alias("r")).select("r.*")
    bad = ~F.coalesce(F.trim("relevant"), F.lit("")).isin("0", "1", "NA")
    return rows.withColumn("relevant", F.when(bad, F.raise_error(F.concat(F.lit("relevant must be 0, 1 or NA: "), F.coalesce("docid", F.lit("?"))))).otherwise(F.trim("relevant")))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sha256, bytes) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.regexp_replace("path", r"^file:", "").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
