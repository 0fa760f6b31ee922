"""The queries registered for the driver over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.functions import vocabulary as V
from papyrine.operators import cache, dedup, entities, graph, labels, metrics, semantic, tfidf
from papyrine.session import ship
from papyrine.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with SQL if SQL can express it on whole tables."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def papers(spark: SparkSession, d: str) -> DataFrame:
    """The paper cache: the latest fetch of every paper."""
    return cache.newest_fetch(table(spark, d, "papers"))


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_KEY = "lower(" + _TRIM + ")"
_REST = ["abstract", "authors_json", "content_hash", "doi", "journal", "keywords_json", "published_date", "title", "url"]
PAPERS = f"""p AS (
  SELECT * FROM (
    SELECT * REPLACE ({_KEY.format("source")} AS source),
      row_number() OVER (PARTITION BY paper_id, {_KEY.format("source")} ORDER BY fetched_at DESC, {", ".join(f"coalesce({c}, '')" for c in _REST)}) AS rn
    FROM papers) WHERE rn = 1
)"""
LINKS = f"""links AS (
  SELECT {_KEY.format("query")} AS query, {_KEY.format("source")} AS source, paper_id, min(paper_rank) AS paper_rank FROM query_results GROUP BY 1, 2, 3
)"""
LOG = f"""log AS (SELECT id, {_KEY.format("query")} AS query, {_KEY.format("source")} AS source, result_count, ran_at FROM query_log)"""


# --- fields and the cache -------------------------------------------------------------------------

_DOI = "d0 AS (SELECT *, lower(" + _TRIM.format("doi") + ") AS x0 FROM p), d1 AS (SELECT *, CASE WHEN starts_with(x0, 'https://doi.org/') THEN substr(x0, 17) ELSE x0 END AS x1 FROM d0), d2 AS (SELECT *, CASE WHEN starts_with(x1, 'http://doi.org/') THEN substr(x1, 16) ELSE x1 END AS x2 FROM d1), d3 AS (SELECT *, CASE WHEN starts_with(x2, 'doi:') THEN substr(x2, 5) ELSE x2 END AS x3 FROM d2), n AS (SELECT *, nullif(" + _TRIM.format("x3") + ", '') AS ndoi FROM d3)"


@query(
    f"""WITH {PAPERS}, {_DOI}, a AS (
  SELECT *, CASE WHEN json_valid(authors_json) AND json_type(authors_json) = 'ARRAY' THEN CAST(CAST(authors_json AS JSON) AS VARCHAR[]) ELSE [] END AS names FROM n
)
SELECT paper_id, source, ndoi AS doi, substr(sha256(coalesce(title, '') || coalesce(abstract, '')), 1, 16) AS content_hash,
  CASE WHEN len(names) = 0 THEN 'Unknown authors' WHEN len(names) <= 3 THEN array_to_string(names, ', ') ELSE array_to_string(names[1:3], ', ') || ' et al.' END AS author_string,
  CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN url END AS url,
  substr(coalesce(abstract, ''), 1, 400) AS preview,
  {_TRIM.format("coalesce(title, '') || '. ' || coalesce(abstract, '')")} AS combined
FROM a"""
)
def paper_fields(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms and derived fields of every cached paper."""
    p = papers(spark, d)
    return p.select(
        "paper_id", "source", X.plain_doi(F.col("doi")).alias("doi"), X.content_hash(F.col("title"), F.col("abstract")).alias("content_hash"),
        X.author_string(F.coalesce(X.string_list(F.col("authors_json")), F.array().cast("array<string>"))).alias("author_string"),
        X.http_url(F.col("url")).alias("url"), X.preview(F.col("abstract")).alias("preview"), X.combined_text(F.col("title"), F.col("abstract")).alias("combined"),
    )


@query(f"WITH {PAPERS} SELECT paper_id, source, title, fetched_at FROM p")
def newest_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The upsert of the fetch log by key."""
    return papers(spark, d).select("paper_id", "source", "title", "fetched_at")


@query(f"WITH {PAPERS} SELECT source, count(*) AS papers FROM p GROUP BY source")
def stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    return cache.stats(papers(spark, d), table(spark, d, "query_log"))[0]


@query("SELECT DISTINCT id, query, ran_at FROM (SELECT id, query, ran_at FROM (SELECT DISTINCT id, query, source, result_count, ran_at FROM query_log) ORDER BY ran_at DESC, id LIMIT 5)")
def last_queries(spark: SparkSession, d: str) -> DataFrame:
    """The five latest runs (the limit is the feature)."""
    return cache.stats(papers(spark, d), table(spark, d, "query_log").distinct())[1].select("id", "query", "ran_at").distinct()


@query(f"WITH {PAPERS} SELECT paper_id, source, fetched_at FROM p WHERE source = 'pubmed' ORDER BY fetched_at DESC, paper_id, source LIMIT 50 OFFSET 100")
def page_newest(spark: SparkSession, d: str) -> DataFrame:
    """The third page of fifty of a source (the limit is the feature)."""
    return cache.page(papers(spark, d), "PubMed", 50, 100).select("paper_id", "source", "fetched_at")


@query(f"WITH {PAPERS}, {LINKS} SELECT query, source, paper_id, paper_rank, title FROM links JOIN p USING (paper_id, source)")
def cached_results(spark: SparkSession, d: str) -> DataFrame:
    """The exact cached results of every query."""
    return cache.all_cached_results(papers(spark, d), cache.links(table(spark, d, "query_results"))).select("query", "source", "paper_id", "paper_rank", "title")


@query(f"WITH {PAPERS}, {LINKS} SELECT query, source, paper_id, paper_rank FROM links WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.paper_id = links.paper_id AND p.source = links.source)")
def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to papers that are not cached."""
    return cache.links(table(spark, d, "query_results")).join(papers(spark, d).select("paper_id", "source"), ["paper_id", "source"], "left_anti").select("query", "source", "paper_id", "paper_rank")


@query(f"WITH {LOG} SELECT query, source, arg_max(result_count, (ran_at, id)) AS result_count, max(ran_at) AS ran_at FROM log GROUP BY 1, 2")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return cache.latest_log(table(spark, d, "query_log").distinct())


@query(f"WITH {LOG} SELECT DISTINCT query, source FROM log WHERE ran_at > (SELECT max(ran_at) FROM query_log) - INTERVAL 240 HOURS")
def fresh_queries(spark: SparkSession, d: str) -> DataFrame:
    """Queries that ran in the ten days before the last run."""
    log = table(spark, d, "query_log")
    return cache.fresh(log, F.lit(log.agg(F.max("ran_at")).collect()[0][0]), 240)


@query(
    f"""WITH {PAPERS}, {LINKS}, t AS (SELECT max(fetched_at) - INTERVAL 180 DAYS AS cut FROM papers), kept AS (SELECT paper_id, source FROM p, t WHERE fetched_at >= cut)
SELECT 'papers' AS relation, count(*) AS deleted FROM p, t WHERE fetched_at < cut
UNION ALL SELECT 'query_log', count(*) FROM query_log, t WHERE ran_at < cut
UNION ALL SELECT 'query_results', count(*) FROM links WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.paper_id = links.paper_id AND kept.source = links.source)"""
)
def prune_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a prune of papers older than 180 days deletes from each relation."""
    raw = table(spark, d, "papers")
    now = F.lit(raw.agg(F.max("fetched_at")).collect()[0][0])
    return cache.prune_counts(papers(spark, d), table(spark, d, "query_log"), cache.links(table(spark, d, "query_results")), now)


@query(
    f"""WITH {PAPERS}, {LOG}, runs AS (SELECT query, source, least(arg_max(result_count, (ran_at, id)), 200) AS take FROM log GROUP BY 1, 2),
newest AS (SELECT paper_id, source, row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, paper_id) AS n FROM p)
SELECT query, source, paper_id, n FROM runs JOIN newest USING (source) WHERE n <= take AND take > 0"""
)
def recent_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The fallback of a cache miss: as many newest papers as the latest run had results."""
    return cache.recent_fallback(papers(spark, d), table(spark, d, "query_log").distinct())


@query(f"WITH {PAPERS} SELECT paper_id, source FROM p WHERE lower(title) LIKE '%carcinoma%status%' OR lower(abstract) LIKE '%carcinoma%status%'")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    """Substring search; the wildcard in the query is live."""
    return cache.text_search(papers(spark, d), "Carcinoma%status").select("paper_id", "source")


# --- dedup ----------------------------------------------------------------------------------------

_DEDUP = f"""{PAPERS}, {_DOI}, k AS (
  SELECT *, coalesce('doi:' || ndoi, 'hash:' || substr(sha256(coalesce(title, '') || coalesce(abstract, '')), 1, 16)) AS key FROM n
), o AS (
  SELECT *, row_number() OVER w AS place, first_value(paper_id) OVER w AS kept_id, first_value(source) OVER w AS kept_source
  FROM k WINDOW w AS (PARTITION BY key ORDER BY CASE WHEN source = 'pubmed' THEN 0 ELSE 1 END, paper_id, source)
)"""


@query(f"WITH {_DEDUP} SELECT paper_id, source, title FROM o WHERE place = 1")
def dedup_kept(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(papers(spark, d))[0].select("paper_id", "source", "title")


@query(f"WITH {_DEDUP} SELECT kept_id, kept_source, source || ':' || paper_id AS dropped FROM o WHERE place > 1")
def dedup_log(spark: SparkSession, d: str) -> DataFrame:
    return dedup.deduplicate(papers(spark, d))[1]


# --- ranking --------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in V.STOP_WORDS)


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(regexp_replace(strip_accents(lower({column})), '[^\\x00-\\x7F]', '_', 'g'), '\\b[a-z][a-z0-9\\-]+\\b'), lambda t: t NOT IN ({_STOP}))"


def _grams(rel: str, key: str) -> str:
    """Rows (key, term) of unigrams and bigrams of a relation with a list t."""
    return f"(SELECT {key}, unnest(t) AS term FROM {rel} UNION ALL SELECT {key}, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM {rel} WHERE len(t) > 1)"


_TFIDF = f"""{PAPERS}, dt AS (SELECT source || ':' || paper_id AS doc, {_tokens(_TRIM.format("coalesce(title, '') || '. ' || coalesce(abstract, '')"))} AS t FROM p),
qs AS (SELECT query_id, min(query_text) AS query_text FROM relevance_sheet WHERE query_text IS NOT NULL GROUP BY query_id),
qt AS (SELECT query_id, {_tokens("query_text")} AS t FROM qs),
post AS (SELECT doc, term, count(*) AS tf FROM {_grams("dt", "doc")} GROUP BY 1, 2),
qpost AS (SELECT query_id, term, count(*) AS qtf FROM {_grams("qt", "query_id")} GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
n AS (SELECT count(*) + 1.0 AS n FROM p),
q AS (SELECT query_id, term, ln((1 + n) / (2 + coalesce(df, 0))) + 1 AS idf_q, (1 + ln(qtf)) * (ln((1 + n) / (2 + coalesce(df, 0))) + 1) AS wq FROM qpost LEFT JOIN df USING (term), n)"""


@query(
    f"""WITH {_TFIDF}, base AS (SELECT doc, term, 1 + ln(tf) AS tfw, ln((1 + n) / (1 + df)) + 1 AS idf FROM post JOIN df USING (term), n),
norm AS (SELECT doc, sum((tfw * idf) ** 2) AS norm2 FROM base GROUP BY doc), qn AS (SELECT query_id, sqrt(sum(wq ** 2)) AS qnorm FROM q GROUP BY query_id),
dot AS (SELECT query_id, doc, sum(tfw * idf_q * wq) AS dot, sum((tfw * idf_q) ** 2 - (tfw * idf) ** 2) AS shift FROM base JOIN q USING (term) GROUP BY 1, 2),
s AS (SELECT query_id, doc, round(greatest(0, least(1, dot / (sqrt(norm2 + shift) * qnorm))), 6) AS score FROM dot JOIN norm USING (doc) JOIN qn USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s)
SELECT query_id, doc, score, rank FROM r WHERE rank <= 10"""
)
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten best papers of every query of the label sheet by exact TF-IDF (top-k is the feature)."""
    docs = papers(spark, d).select(F.concat_ws(":", "source", "paper_id").alias("doc"), "title", "abstract")
    return tfidf.rank(docs, _sheet_queries(spark, d))


def _sheet_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relevance_sheet").where("query_text is not null").groupBy("query_id").agg(F.min("query_text").alias("query_text"))


@query(
    f"""WITH {_TFIDF.replace("post AS (", "post0 AS (").replace("df AS (SELECT term", "cap AS (SELECT term FROM post0 GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000), post AS (SELECT * FROM post0 WHERE term IN (SELECT term FROM cap)), df AS (SELECT term", 1).replace("qpost0 AS", "qpost AS")}, base AS (SELECT doc, term, 1 + ln(tf) AS tfw, ln((1 + n) / (1 + df)) + 1 AS idf FROM post JOIN df USING (term), n),
norm AS (SELECT doc, sum((tfw * idf) ** 2) AS norm2 FROM base GROUP BY doc), qn AS (SELECT query_id, sqrt(sum(wq ** 2)) AS qnorm FROM q GROUP BY query_id),
dot AS (SELECT query_id, doc, sum(tfw * idf_q * wq) AS dot, sum((tfw * idf_q) ** 2 - (tfw * idf) ** 2) AS shift FROM base JOIN q USING (term) GROUP BY 1, 2),
s AS (SELECT query_id, doc, round(greatest(0, least(1, dot / (sqrt(norm2 + shift) * qnorm))), 6) AS score FROM dot JOIN norm USING (doc) JOIN qn USING (query_id)),
z AS (SELECT query_id, doc, coalesce(score, 0.0) AS score FROM (SELECT query_id, doc FROM qs, dt) LEFT JOIN s USING (query_id, doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM z)
SELECT query_id, doc, score, rank FROM r WHERE rank <= 10"""
)
def tfidf_capped(spark: SparkSession, d: str) -> DataFrame:
    """The same over the 10,000 most frequent terms, papers without a common term in the list with score 0."""
    docs = papers(spark, d).select(F.concat_ws(":", "source", "paper_id").alias("doc"), "title", "abstract")
    return tfidf.rank(docs, _sheet_queries(spark, d), keep_zero=True, most_terms=10_000)


@query(
    f"""WITH {_TFIDF}, qn AS (SELECT query_id, sqrt(sum(wq ** 2)) AS qnorm FROM q GROUP BY query_id),
w AS (SELECT query_id, term, round(wq / qnorm, 6) AS weight FROM q JOIN qn USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS place FROM w)
SELECT query_id, term, weight, place FROM r WHERE place <= 10"""
)
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten heaviest terms of every query."""
    docs = papers(spark, d).select(F.concat_ws(":", "source", "paper_id").alias("doc"), "title", "abstract")
    return tfidf.top_terms(docs, _sheet_queries(spark, d))


@query(
    f"""WITH {PAPERS}, qs AS (SELECT query_id, min(query_text) AS query_text FROM relevance_sheet WHERE query_text IS NOT NULL GROUP BY query_id),
qt AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS terms FROM qs),
t AS (SELECT query_id, len(terms) AS n_terms, unnest(terms) AS term FROM qt),
m AS (SELECT paper_id, source, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', title, abstract)), '[a-z0-9]+'))) AS term FROM p),
s AS (SELECT query_id, n_terms, paper_id, source, CAST(count(*) AS INTEGER) AS overlap FROM m JOIN t USING (term) GROUP BY 1, 2, 3, 4),
b AS (SELECT *, max(overlap) OVER (PARTITION BY query_id) AS best FROM s)
SELECT query_id, paper_id, source, overlap FROM b WHERE overlap >= CASE WHEN n_terms > 1 AND best >= 2 THEN 2 ELSE 1 END
UNION ALL SELECT query_id, paper_id, source, 0 FROM qt, p WHERE len(terms) = 0"""
)
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    return cache.keyword_filter(papers(spark, d), _sheet_queries(spark, d))


@query(
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, rank FROM r WHERE rank <= 10"""
)
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100, against all vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return semantic.topk(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"))


@query()
def semantic_papers(spark: SparkSession, d: str) -> DataFrame:
    """The ten papers nearest to every cached vector whose paper number is divisible by 100, by the cached vectors of their contents."""
    whole = table(spark, d, "embedding_cache").where("octet_length(vector_blob) = 3072 and paper_id is not null")
    c = semantic.unpacked(whole.select("content_hash", "model_id", "paper_id", "vector_blob"))
    asked = c.where((F.col("model_id") == "biobert-sts-a") & (F.regexp_extract("paper_id", r"(\d+)(?:v\d+)?$", 1).try_cast("long") % 100 == 0)).groupBy(F.col("paper_id").alias("query_id")).agg(F.min("vector").alias("vector"))
    return semantic.rank_papers(papers(spark, d), c, "biobert-sts-a", asked)


@query("SELECT model_id, count(*) AS n, count(DISTINCT content_hash) AS hashes, count(*) FILTER (octet_length(vector_blob) = 3072) AS full_length FROM embedding_cache GROUP BY model_id")
def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "embedding_cache")
    return c.groupBy("model_id").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("hashes"), F.count_if(F.octet_length("vector_blob") == 3072).alias("full_length"))


@query(
    f"""WITH {PAPERS}, k AS (SELECT DISTINCT paper_id, source, substr(sha256(coalesce(title, '') || coalesce(abstract, '')), 1, 16) AS h FROM p), c AS (SELECT DISTINCT content_hash AS h FROM embedding_cache WHERE model_id = 'biobert-sts-a')
SELECT paper_id, source, CAST(EXISTS (SELECT 1 FROM c WHERE c.h = k.h) AS INTEGER) AS hit FROM k"""
)
def embedding_cache_split(spark: SparkSession, d: str) -> DataFrame:
    """Which papers have a cached vector of a model."""
    c = table(spark, d, "embedding_cache").select("content_hash", "model_id", F.col("vector_blob").alias("vector"))
    hit, miss = semantic.cache_split(papers(spark, d), c, "biobert-sts-a")
    return hit.select("paper_id", "source", F.lit(1).alias("hit")).unionByName(miss.select("paper_id", "source", F.lit(0).alias("hit")))


# --- entities and headings ------------------------------------------------------------------------

_NOISE = ", ".join("'" + t.lower().replace("'", "''") + "'" for t in V.HEADING_NOISE)
_SYN = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b.replace(chr(39), chr(39) * 2)}'" for a, b in V.HEADING_SYNONYMS.items()) + " ELSE x END"


@query(
    f"""WITH {PAPERS}, k AS (SELECT paper_id, source, CASE WHEN json_valid(keywords_json) AND json_type(keywords_json) = 'ARRAY' THEN CAST(CAST(keywords_json AS JSON) AS VARCHAR[]) ELSE [] END AS ks FROM p),
e AS (SELECT paper_id, source, unnest(ks) AS raw FROM k), c AS (SELECT paper_id, source, lower({_TRIM.format("raw")}) AS x FROM e)
SELECT DISTINCT paper_id, source, {_SYN} AS disease FROM c WHERE x <> '' AND x NOT IN ({_NOISE})"""
)
def heading_diseases(spark: SparkSession, d: str) -> DataFrame:
    """Disease names from the subject headings of every paper."""
    p = papers(spark, d)
    return p.select("paper_id", "source", F.explode(entities.heading_diseases(X.string_list(F.col("keywords_json")))).alias("disease"))


def _ner_docs(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return p.select(F.concat_ws(":", "source", "paper_id").alias("paper_id"), X.combined_text(F.col("title"), F.col("abstract")).alias("text"))


_NAMES = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{t}')" for t, ns in (("GENE", V.GENES), ("DISEASE", V.DISEASES)) for n in ns)


@query(
    f"""WITH {PAPERS}, names(name, label) AS (VALUES {_NAMES}),
t AS (SELECT source || ':' || paper_id AS doc, list_filter(regexp_extract_all({_TRIM.format("coalesce(title, '') || '. ' || coalesce(abstract, '')")}, '(''s\\b|[\\p{{L}}\\p{{N}}]+|\\s+|[^\\p{{L}}\\p{{N}}\\s])'), lambda x: NOT regexp_matches(x, '^\\s')) AS toks FROM p),
w AS (SELECT doc, list_transform(toks, lambda x: lower(x)) AS p, list_transform(toks, lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN '#' ELSE lower(x) END) AS k FROM t),
g AS (SELECT doc, unnest(flatten(list_transform(range(1, len(k) + 1), lambda i: list_distinct([k[i], p[i]])))) AS name FROM w
  UNION ALL SELECT doc, unnest(flatten(list_transform(range(1, len(k)), lambda i: list_distinct([k[i] || ' ' || k[i + 1], p[i] || ' ' || p[i + 1]])))) FROM w WHERE len(k) > 1
  UNION ALL SELECT doc, unnest(flatten(list_transform(range(1, len(k) - 1), lambda i: list_distinct([k[i] || ' ' || k[i + 1] || ' ' || k[i + 2], p[i] || ' ' || p[i + 1] || ' ' || p[i + 2]])))) FROM w WHERE len(k) > 2)
SELECT name, label, count(*) AS mentions, count(DISTINCT doc) AS papers FROM g JOIN names USING (name) GROUP BY 1, 2"""
)
def dictionary_mentions(spark: SparkSession, d: str) -> DataFrame:
    """How often each dictionary name occurs, before overlaps are resolved."""
    m = entities.dictionary_mentions(_ner_docs(spark, d), entities.pattern_table(spark))
    typed = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\b\d+\b", "#"), r"\s+", " "), r"(?<=\w)'s", " 's")
    return m.groupBy(typed.alias("name"), "label").agg(F.count("*").alias("mentions"), F.count_distinct("paper_id").alias("papers"))


@query()
def ner_entities(spark: SparkSession, d: str) -> DataFrame:
    """Genes and diseases of every paper by dictionary and capitals, overlaps resolved."""
    return entities.extract(_ner_docs(spark, d), entities.pattern_table(spark), statistical=True)


# --- graph ----------------------------------------------------------------------------------------


def _entity_lists(spark: SparkSession, d: str) -> DataFrame:
    """(paper_id, genes, diseases) with canonical names; broken lists are empty; repeated rows are one processing."""
    names = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(X.string_list(F.col(c)), F.array().cast("array<string>")), X.canonical_entity), lambda x: x.isNotNull() & (x != "")))
    return table(spark, d, "paper_entities").select("paper_id", names("genes_json").alias("genes"), names("diseases_json").alias("diseases")).distinct()


def _list_sql(c: str) -> str:
    return f"CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN list_filter(list_transform(CAST(CAST({c} AS JSON) AS VARCHAR[]), lambda x: lower({_TRIM.format('x')})), lambda x: x IS NOT NULL AND x <> '') ELSE [] END"


GRAPH = f"""l AS (SELECT paper_id, {_list_sql("genes_json")} AS g0, {_list_sql("diseases_json")} AS d0 FROM paper_entities),
e0 AS (SELECT DISTINCT paper_id, list_filter(g0, lambda x, i: list_position(g0, x) = i) AS g, list_filter(d0, lambda x, i: list_position(d0, x) = i) AS dd FROM l),
rws AS (SELECT row_number() OVER () AS r, paper_id, g, dd, list_concat(g, dd) AS al FROM e0),
pos AS (SELECT r, paper_id, unnest(al) AS x, unnest(range(1, len(al) + 1)) AS i FROM rws),
seen AS (SELECT paper_id, unnest(g) AS entity, 0 AS k FROM rws UNION ALL SELECT paper_id, unnest(dd), 1 FROM rws),
nodes AS (SELECT entity, CASE WHEN arg_min(k, (paper_id, k)) = 0 THEN 'GENE' ELSE 'DISEASE' END AS label, count(DISTINCT paper_id) AS paper_count FROM seen GROUP BY entity),
edges AS (SELECT least(u.x, v.x) AS a, greatest(u.x, v.x) AS b, count(*) AS weight FROM pos u JOIN pos v ON u.r = v.r AND u.i < v.i AND u.x <> v.x GROUP BY 1, 2),
ends AS (SELECT entity, count(*) AS degree FROM (SELECT a AS entity FROM edges UNION ALL SELECT b FROM edges) GROUP BY entity),
deg AS (SELECT entity, label, coalesce(degree, 0) AS degree, coalesce(degree, 0) / ((SELECT count(*) FROM nodes) - 1) AS centrality FROM nodes LEFT JOIN ends USING (entity))"""


def _graph(spark: SparkSession, d: str) -> graph.Graph:
    return graph.build(_entity_lists(spark, d))


@query(f"WITH {GRAPH} SELECT entity, label, paper_count FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).nodes


@query(f"WITH {GRAPH} SELECT a, b, weight FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).edges


@query(f"WITH {GRAPH} SELECT entity, label, degree, round(centrality, 6) AS centrality FROM deg")
def graph_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_graph(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query(f"WITH {GRAPH} SELECT entity, round(centrality, 6) AS centrality FROM deg WHERE label = 'GENE' ORDER BY deg.centrality DESC, entity LIMIT 10")
def graph_top_genes(spark: SparkSession, d: str) -> DataFrame:
    """The ten genes of the highest centrality (top-k is the feature)."""
    return graph.top_entities(_graph(spark, d), "GENE").select("entity", F.round("centrality", 6).alias("centrality"))


@query(f"WITH {GRAPH} SELECT a, b, weight FROM edges ORDER BY weight DESC, a, b LIMIT 20")
def graph_top_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_edges(_graph(spark, d))


@query(f"WITH {GRAPH} SELECT CASE WHEN a = 'atj4' THEN b ELSE a END AS neighbour, weight FROM edges WHERE a = 'atj4' OR b = 'atj4'")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_graph(spark, d), "atj4")


@query(
    f"""WITH {GRAPH} SELECT CASE WHEN x.label = 'GENE' THEN a ELSE b END AS gene, CASE WHEN x.label = 'GENE' THEN b ELSE a END AS disease, weight
FROM edges JOIN nodes x ON x.entity = a JOIN nodes y ON y.entity = b WHERE x.label <> y.label"""
)
def graph_gene_disease(spark: SparkSession, d: str) -> DataFrame:
    return graph.gene_disease_edges(_graph(spark, d))


_EGO = """both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), h0 AS (SELECT 'atj4' AS entity), h1 AS (SELECT entity FROM h0 UNION SELECT b FROM both_ JOIN h0 ON a = entity), h2 AS (SELECT entity FROM h1 UNION SELECT b FROM both_ JOIN h1 ON a = entity)"""


@query(f"WITH {GRAPH}, {_EGO} SELECT a, b, weight FROM edges WHERE a IN (SELECT entity FROM h2) AND b IN (SELECT entity FROM h2)")
def graph_ego(spark: SparkSession, d: str) -> DataFrame:
    """Edges within two hops of an entity."""
    return graph.ego(_graph(spark, d), "ATJ4", 2).edges


@query(
    f"""WITH RECURSIVE {GRAPH}, both_ AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach(entity, root) AS (
  SELECT entity, entity FROM nodes UNION SELECT b, root FROM reach JOIN both_ ON a = reach.entity WHERE root < b
)
SELECT entity, min(root) AS root FROM reach GROUP BY entity"""
)
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_graph(spark, d))


@query(f"WITH {GRAPH} SELECT a, b, weight FROM edges WHERE weight >= 3")
def graph_pruned(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune(_graph(spark, d), 3).edges


@query(f"WITH {GRAPH} SELECT entity, paper_count FROM nodes WHERE entity IN (SELECT a FROM edges WHERE weight >= 3 UNION SELECT b FROM edges WHERE weight >= 3)")
def graph_pruned_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.prune(_graph(spark, d), 3).nodes.select("entity", "paper_count")


@query(f"WITH {GRAPH} SELECT a, b, weight FROM edges")
def graph_merged(spark: SparkSession, d: str) -> DataFrame:
    """The graphs of preprints and of other papers, merged: the same as the graph of all."""
    lists = _entity_lists(spark, d)
    pre = F.col("paper_id").startswith("10.")
    return graph.merge(graph.build(lists.where(~pre)), graph.build(lists.where(pre))).edges


@query(f"WITH {GRAPH} SELECT entity, paper_count FROM nodes")
def graph_merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    lists = _entity_lists(spark, d)
    pre = F.col("paper_id").startswith("10.")
    return graph.merge(graph.build(lists.where(~pre)), graph.build(lists.where(pre))).nodes.select("entity", "paper_count")


@query(
    f"""WITH {GRAPH}, n AS (SELECT count(*) AS total_nodes, count(*) FILTER (label = 'GENE') AS gene_nodes, count(*) FILTER (label = 'DISEASE') AS disease_nodes FROM nodes), e AS (SELECT count(*) AS total_edges FROM edges),
h AS (SELECT count(*) FILTER (label = 'GENE' AND centrality >= 0.3) AS hub_genes, count(*) FILTER (label = 'DISEASE' AND centrality >= 0.3) AS hub_diseases FROM deg),
gd AS (SELECT count(*) AS gene_disease_pairs FROM edges JOIN nodes x ON x.entity = a JOIN nodes y ON y.entity = b WHERE x.label <> y.label)
SELECT *, round(2.0 * total_edges / (total_nodes * (total_nodes - 1)), 6) AS density FROM n, e, h, gd"""
)
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(_graph(spark, d)).drop("connected_components", "largest_component_size")


# --- evaluation -----------------------------------------------------------------------------------

SHEET = """sh AS (SELECT query_id, source, paper_id, min(tfidf_rank) AS tfidf_rank, min(biobert_rank) AS biobert_rank, max(relevant) AS relevant, min(notes) AS notes FROM relevance_sheet GROUP BY 1, 2, 3)"""


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """The label sheet, one row for each pooled paper."""
    return table(spark, d, "relevance_sheet").groupBy("query_id", "source", "paper_id").agg(F.min("tfidf_rank").alias("tfidf_rank"), F.min("biobert_rank").alias("biobert_rank"), F.max("relevant").alias("relevant"), F.min("notes").alias("notes"))


def _runs(sheet: DataFrame) -> DataFrame:
    docid = F.concat_ws(":", "source", "paper_id")
    one = lambda m: sheet.where(F.col(f"{m}_rank").isNotNull()).select(F.lit(m).alias("system"), F.col("query_id").alias("qid"), docid.alias("docid"), F.col(f"{m}_rank").alias("rank"))
    return one("tfidf").unionByName(one("biobert"))


def _qrels(sheet: DataFrame) -> DataFrame:
    return sheet.where("relevant is not null").select(F.col("query_id").alias("qid"), F.concat_ws(":", "source", "paper_id").alias("docid"), F.col("relevant").alias("grade"))


_RUNS = f"""{SHEET}, run AS (SELECT 'tfidf' AS system, query_id AS qid, source || ':' || paper_id AS docid, tfidf_rank AS rank FROM sh WHERE tfidf_rank IS NOT NULL UNION ALL SELECT 'biobert', query_id, source || ':' || paper_id, biobert_rank FROM sh WHERE biobert_rank IS NOT NULL),
qrels AS (SELECT query_id AS qid, source || ':' || paper_id AS docid, relevant AS grade FROM sh WHERE relevant IS NOT NULL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY system, qid ORDER BY rank, docid) AS place FROM run) LEFT JOIN qrels USING (qid, docid) WHERE place <= 10),
per AS (SELECT system, qid, count(*) FILTER (grade >= 1) / 10 AS p_at, coalesce(1.0 / min(place) FILTER (grade >= 1), 0) AS mrr, sum(coalesce(grade, 0) / log2(place + 1)) AS dcg, count(*) FILTER (grade IS NULL) / 10 AS unjudged FROM top GROUP BY 1, 2),
ideal AS (SELECT qid, sum(grade / log2(i + 1)) AS idcg FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docid) AS i FROM qrels) WHERE i <= 10 GROUP BY qid),
m AS (SELECT system, qid, p_at, mrr, CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0 END AS ndcg, unjudged FROM per LEFT JOIN ideal USING (qid))"""


@query(f"WITH {_RUNS} SELECT system, qid, round(p_at, 6) AS p_at, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round(unjudged, 6) AS unjudged FROM m")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """P@10, MRR@10, nDCG@10 and unjudged share of both methods for every query."""
    s = _sheet(spark, d)
    return metrics.query_metrics(_runs(s), _qrels(s)).withColumns({c: F.round(c, 6) for c in ("p_at", "mrr", "ndcg", "unjudged")})


@query(f"WITH {_RUNS} SELECT system, round(avg(p_at), 6) AS p_at, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS queries FROM m GROUP BY system")
def ir_means(spark: SparkSession, d: str) -> DataFrame:
    s = _sheet(spark, d)
    return metrics.query_metrics(_runs(s), _qrels(s)).groupBy("system").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p_at", "mrr", "ndcg")], F.count("*").alias("queries"))


@query(
    f"""WITH {SHEET}, z AS (SELECT *, coalesce(tfidf_rank <= 10, false) OR coalesce(biobert_rank <= 10, false) AS pooled, coalesce(relevant = 1, false) AS rel FROM sh),
t AS (SELECT query_id, count(*) FILTER (pooled AND rel) AS pooled_relevant FROM z GROUP BY query_id),
u AS (SELECT query_id, 'tfidf' AS method, count(*) FILTER (tfidf_rank <= 10) AS in_top, count(*) FILTER (tfidf_rank <= 10 AND rel) AS relevant_in_top FROM z GROUP BY 1 UNION ALL SELECT query_id, 'biobert', count(*) FILTER (biobert_rank <= 10), count(*) FILTER (biobert_rank <= 10 AND rel) FROM z GROUP BY 1)
SELECT query_id, method, round(relevant_in_top / 10, 4) AS precision, round(CASE WHEN pooled_relevant > 0 THEN relevant_in_top / pooled_relevant ELSE 0 END, 4) AS recall, in_top, relevant_in_top, pooled_relevant FROM u JOIN t USING (query_id)"""
)
def pooled_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pooled_precision_recall(_sheet(spark, d))


@query("SELECT query_id, source, paper_id, min(paper_rank) FILTER (method = 'tfidf') AS tfidf_rank, min(paper_rank) FILTER (method = 'biobert') AS biobert_rank FROM search_results WHERE paper_rank <= 10 GROUP BY 1, 2, 3")
def pool(spark: SparkSession, d: str) -> DataFrame:
    """Both methods' ten best of every query, side by side."""
    return metrics.pool(table(spark, d, "search_results"))


@query(
    f"""WITH {SHEET} SELECT query_id, 'tfidf' AS method, count(*) FILTER (tfidf_rank <= 10) = 10 AND count(DISTINCT CASE WHEN tfidf_rank BETWEEN 1 AND 10 THEN tfidf_rank END) = 10 AS complete FROM sh GROUP BY 1
UNION ALL SELECT query_id, 'biobert', count(*) FILTER (biobert_rank <= 10) = 10 AND count(DISTINCT CASE WHEN biobert_rank BETWEEN 1 AND 10 THEN biobert_rank END) = 10 FROM sh GROUP BY 1"""
)
def pool_complete(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pool_complete(_sheet(spark, d))


@query("SELECT query_id, method, round(coalesce(avg(score), 0), 6) AS mean_score, round(coalesce(max(score), 0), 6) AS top_score, round(coalesce(stddev_pop(score), 0), 6) AS spread FROM search_results GROUP BY 1, 2")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.score_stats(table(spark, d, "search_results"), ["query_id", "method"])


@query(
    f"""WITH {_RUNS}, d AS (SELECT qid, max(ndcg) FILTER (system = 'biobert') - max(ndcg) FILTER (system = 'tfidf') AS delta FROM m GROUP BY qid HAVING count(DISTINCT system) = 2), r AS (SELECT round(delta, 9) AS delta FROM d)
SELECT count(*) AS n_pairs, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, round(avg(delta), 6) AS mean_delta FROM r"""
)
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """Wins, losses and ties of nDCG between the methods (the binomial tail is tested against exact values)."""
    s = _sheet(spark, d)
    m = metrics.query_metrics(_runs(s), _qrels(s))
    pairs = metrics.paired(m, "ndcg", "tfidf", "biobert", key="qid", method="system").withColumn("delta", F.round("delta", 9))
    return metrics.sign_counts(pairs).drop("p")


@query(
    f"""WITH {SHEET}, c AS (SELECT query_id, relevant AS human, CAST(nullif(regexp_extract(notes, 'proposed=([01])', 1), '') AS INTEGER) AS proposed FROM sh),
t AS (SELECT count(*) FILTER (human = 1 AND proposed = 1) AS tp, count(*) FILTER (human = 0 AND proposed = 1) AS fp, count(*) FILTER (human = 1 AND proposed = 0) AS fn, count(*) FILTER (human = 0 AND proposed = 0) AS tn FROM c),
u AS (SELECT *, tp + fp + fn + tn AS n FROM t), v AS (SELECT *, (tp + tn) / n AS po, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (n * n) AS pe FROM u)
SELECT tp, fp, fn, tn, n, CASE WHEN n > 0 THEN round(po, 6) END AS agreement, CASE WHEN n > 0 THEN round(CASE WHEN pe >= 1 THEN CASE WHEN po = 1 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 6) END AS kappa FROM v"""
)
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Confusion, agreement and kappa of proposed and final labels."""
    s = _sheet(spark, d).select(F.col("relevant").alias("human"), F.regexp_extract("notes", "proposed=([01])", 1).try_cast("int").alias("proposed"))
    return metrics.confusion(s)


@query(
    f"""WITH {SHEET} SELECT CASE WHEN starts_with(x, 'reviewed:') THEN 'author_reviewed' WHEN starts_with(x, 'rule:') THEN 'no_abstract_rule' WHEN starts_with(x, 'accepted:') THEN 'proposed_audited_accepted' WHEN starts_with(x, 'proposed:') THEN 'proposed_unreviewed' WHEN starts_with(x, 'NEEDS_HUMAN') THEN 'author_labeled_after_abstain' ELSE 'human' END AS provenance, count(*) AS n
FROM (SELECT {_TRIM.format("coalesce(notes, '')")} AS x FROM sh) GROUP BY 1"""
)
def label_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _sheet(spark, d).groupBy(metrics.provenance(F.col("notes")).alias("provenance")).agg(F.count("*").alias("n"))


@query(f"WITH {SHEET} SELECT printf('%s Q0 %s:%s %d %.6f tfidf', query_id, source, paper_id, tfidf_rank, 1.0 / tfidf_rank) AS value FROM sh WHERE tfidf_rank <= 10")
def trec_run(spark: SparkSession, d: str) -> DataFrame:
    return sinks.run_lines(_sheet(spark, d), "tfidf")


@query(f"WITH {SHEET} SELECT query_id || chr(9) || '0' || chr(9) || source || ':' || paper_id || chr(9) || relevant AS value FROM sh WHERE relevant IS NOT NULL")
def trec_qrels(spark: SparkSession, d: str) -> DataFrame:
    return sinks.qrels_lines(_sheet(spark, d).where("relevant is not null"))


@query(f"WITH {SHEET} SELECT query_id, source, paper_id, tfidf_rank - biobert_rank AS delta FROM sh")
def rank_delta(spark: SparkSession, d: str) -> DataFrame:
    """How many places a paper gains with the second method."""
    return metrics.rank_delta(_sheet(spark, d))


@query(
    f"""WITH {GRAPH}, one AS (SELECT query_id, method, paper_id, max(score) AS score, min(paper_rank) AS paper_rank FROM search_results GROUP BY 1, 2, 3),
sc AS (SELECT query_id, method, round(coalesce(avg(score), 0), 6) AS mean_score, round(coalesce(max(score), 0), 6) AS top_score, round(coalesce(stddev_pop(score), 0), 6) AS spread FROM one GROUP BY 1, 2),
tr AS (SELECT query_id, method, r, rws.paper_id, g, dd, al FROM one JOIN rws ON rws.paper_id = one.paper_id WHERE paper_rank <= 10),
tn AS (SELECT query_id, method, paper_id, unnest(g) AS entity, 0 AS k FROM tr UNION ALL SELECT query_id, method, paper_id, unnest(dd), 1 FROM tr),
nd AS (SELECT query_id, method, entity, arg_min(k, (paper_id, k)) = 0 AS gene FROM tn GROUP BY 1, 2, 3),
tp AS (SELECT query_id, method, r, unnest(al) AS x, unnest(range(1, len(al) + 1)) AS i FROM tr),
ed AS (SELECT DISTINCT u.query_id, u.method, least(u.x, v.x) AS a, greatest(u.x, v.x) AS b FROM tp u JOIN tp v ON u.query_id = v.query_id AND u.method = v.method AND u.r = v.r AND u.i < v.i AND u.x <> v.x),
en AS (SELECT query_id, method, entity, count(*) AS degree FROM (SELECT query_id, method, a AS entity FROM ed UNION ALL SELECT query_id, method, b FROM ed) GROUP BY 1, 2, 3),
sz AS (SELECT query_id, method, count(*) AS nodes FROM nd GROUP BY 1, 2),
hb AS (SELECT query_id, method, max(nodes) AS nodes, count(*) FILTER (gene AND c >= 0.3) AS hub_genes, count(*) FILTER (NOT gene AND c >= 0.3) AS hub_diseases FROM (SELECT nd.query_id, nd.method, gene, nodes, CASE WHEN nodes > 1 THEN coalesce(degree, 0) / (nodes - 1) ELSE 1 END AS c FROM nd JOIN sz USING (query_id, method) LEFT JOIN en USING (query_id, method, entity)) GROUP BY 1, 2),
ec AS (SELECT ed.query_id, ed.method, count(*) AS edges, count(*) FILTER (x.gene <> y.gene) AS gene_disease_pairs FROM ed JOIN nd x ON x.query_id = ed.query_id AND x.method = ed.method AND x.entity = a JOIN nd y ON y.query_id = ed.query_id AND y.method = ed.method AND y.entity = b GROUP BY 1, 2)
SELECT query_id, method, mean_score, top_score, spread, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, coalesce(gene_disease_pairs, 0) AS gene_disease_pairs, coalesce(hub_genes, 0) AS hub_genes, coalesce(hub_diseases, 0) AS hub_diseases,
  round(coalesce(CASE WHEN nodes > 1 THEN 2.0 * coalesce(edges, 0) / (nodes * (nodes - 1)) ELSE 0 END, 0), 6) AS density
FROM sc LEFT JOIN hb USING (query_id, method) LEFT JOIN ec USING (query_id, method)"""
)
def evaluation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Score statistics and graph metrics of every query and method."""
    from papyrine.plans.pipeline import evaluation_grid as grid

    return grid(table(spark, d, "search_results"), _entity_lists(spark, d))


@query()
def knowledge_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph of all papers: cached entities, extraction for the rest, headings fused."""
    from papyrine.plans.pipeline import knowledge_graph

    p = papers(spark, d).select("paper_id", "title", "abstract", "keywords_json").dropDuplicates(["paper_id"])
    lists = _entity_lists(spark, d)
    cached = lists.groupBy("paper_id").agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list("genes")))).alias("genes"), F.array_distinct(F.flatten(F.array_sort(F.collect_list("diseases")))).alias("diseases"))
    return knowledge_graph(p, entities.pattern_table(spark), cached).edges


@query()
def blind_order(spark: SparkSession, d: str) -> DataFrame:
    """The label sheet in a seeded order within each query."""
    return metrics.shuffled(_sheet(spark, d), 2026, ["query_id", "source", "paper_id"])


@query(f"WITH {LOG} SELECT time_bucket(INTERVAL 1 DAY, ran_at) AS start, source, count(*) AS runs, sum(result_count) AS results FROM log GROUP BY 1, 2")
def log_windows(spark: SparkSession, d: str) -> DataFrame:
    """Runs of queries in tumbling windows of a day, the plan of the stream run over the whole log."""
    from papyrine.streaming.ingest import query_windows

    return query_windows(table(spark, d, "query_log"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, max(ts) AS latest, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def event_stats(spark: SparkSession, d: str) -> DataFrame:
    """The log statistics over the event table."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("ts").alias("latest"), F.count_distinct("user_id").alias("users"))


@query("WITH d AS (SELECT md5(coalesce(text, '')) AS h, min(doc_id) AS kept_id, count(*) AS copies FROM documents GROUP BY 1) SELECT kept_id, copies FROM d")
def document_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Documents by content: the smallest id of each text and its copies."""
    return table(spark, d, "documents").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("copies")).drop("h")


# --- labels and knowledge base --------------------------------------------------------------------


@query("SELECT query_id, count(*) AS rows, count(*) FILTER (relevant IS NULL) AS unlabeled FROM relevance_sheet GROUP BY query_id")
def unlabeled_rows(spark: SparkSession, d: str) -> DataFrame:
    return labels.unlabeled(table(spark, d, "relevance_sheet"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in replies to the open rows of the sheet: relevant where both methods place the paper, NA where none does well."""
    s = table(spark, d, "relevance_sheet").where("relevant is null").select("query_id", labels.docid().alias("docid"), "tfidf_rank", "biobert_rank").distinct()
    low = F.least(F.coalesce("tfidf_rank", F.lit(99)), F.coalesce("biobert_rank", F.lit(99)))
    return s.groupBy("query_id", "docid").agg(F.min(F.when(F.col("tfidf_rank").isNotNull() & F.col("biobert_rank").isNotNull(), "1").when(low > 8, "NA").otherwise("0")).alias("relevant"))


_REPLIES = f"""s AS (SELECT *, {_TRIM.format("source")} || ':' || {_TRIM.format("paper_id")} AS docid FROM relevance_sheet),
rep AS (SELECT query_id, docid, min(CASE WHEN tfidf_rank IS NOT NULL AND biobert_rank IS NOT NULL THEN '1' WHEN least(coalesce(tfidf_rank, 99), coalesce(biobert_rank, 99)) > 8 THEN 'NA' ELSE '0' END) AS reply
  FROM s WHERE relevant IS NULL GROUP BY 1, 2),
im AS (SELECT s.query_id, s.docid, CASE WHEN relevant IS NOT NULL THEN relevant WHEN reply IN ('0', '1') THEN CAST(reply AS INTEGER) END AS label,
  CASE WHEN relevant IS NOT NULL THEN 'kept' WHEN reply IN ('0', '1') THEN 'imported' ELSE 'open' END AS origin FROM s LEFT JOIN rep USING (query_id, docid))"""


@query(f"WITH {_REPLIES} SELECT query_id, origin, label, count(*) AS rows FROM im GROUP BY ALL")
def imported_labels(spark: SparkSession, d: str) -> DataFrame:
    """What importing replies into the label sheet gives: labels there are stay, open rows take 0 or 1, NA leaves them open."""
    done = labels.imported(table(spark, d, "relevance_sheet"), _replies(spark, d))
    return done.groupBy("query_id", "origin", F.col("relevant").alias("label")).agg(F.count("*").alias("rows"))


@query(f"WITH {_REPLIES} SELECT DISTINCT query_id, docid, 'unknown' AS problem FROM rep WHERE (query_id, docid) NOT IN (SELECT query_id, docid FROM s) UNION ALL SELECT query_id, docid, 'missing' FROM s WHERE relevant IS NULL AND (query_id, docid) NOT IN (SELECT query_id, docid FROM rep WHERE reply <> 'NA') GROUP BY ALL")
def reply_problems(spark: SparkSession, d: str) -> DataFrame:
    """Open rows that the usable replies leave out, and replies to no row."""
    return labels.problems(table(spark, d, "relevance_sheet"), _replies(spark, d).where("relevant <> 'NA'"))


@query(f"WITH {PAPERS} SELECT source, count(*) AS papers, count(*) FILTER (trim(coalesce(abstract, '')) <> '') AS with_abstract FROM p GROUP BY source")
def abstract_counts(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    have = cache.has_abstract(p).groupBy("source").agg(F.count("*").alias("with_abstract"))
    return p.groupBy("source").agg(F.count("*").alias("papers")).join(have, "source", "left").select("source", "papers", F.coalesce("with_abstract", F.lit(0)).alias("with_abstract"))


@query("SELECT count(*) AS rows, count(DISTINCT paper_id) AS papers, max(extracted_at) AS latest FROM paper_entities")
def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paper_entities").agg(F.count("*").alias("rows"), F.count_distinct("paper_id").alias("papers"), F.max("extracted_at").alias("latest"))
