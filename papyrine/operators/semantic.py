"""Ranking by dense vectors with a content-addressed embedding cache and a pluggable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from papyrine.functions.text import content_hash, embedding_text, first_words

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 768) -> Encoder:
    """A deterministic encoder without a model: signed feature hashing of words, unit length. For tests and as a stand-in."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1.0)

    return encode


def embed(texts: DataFrame, encoder: Callable[[], Encoder], batch: int = 16) -> DataFrame:
    """(key, vector) of (key, text); the encoder is made once in each Python worker and fed in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for b in batches:
            texts_ = [t if t and t.strip() else " " for t in b["text"]]
            vecs = [v for at in range(0, len(texts_), batch) for v in encode(texts_[at : at + batch])]
            yield pd.DataFrame({"key": b["key"], "vector": [v.tolist() for v in vecs]})

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<float>")


def cache_split(papers: DataFrame, cache: DataFrame, model_id: str) -> tuple[DataFrame, DataFrame]:
    """(hits with vector, misses): papers against the vectors of one model by content."""
    keyed = papers.withColumn("content_hash", content_hash(F.col("title"), F.col("abstract")))
    mine = cache.where(F.col("model_id") == model_id).select("content_hash", "vector").dropDuplicates(["content_hash"])
    return keyed.join(mine, "content_hash"), keyed.join(mine, "content_hash", "left_anti")


def unpacked(cache: DataFrame, blob: str = "vector_blob") -> DataFrame:
    """The cache with its blobs of little-endian float32 as column vector."""
    rest = [c for c in cache.columns if c != blob]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[rest].assign(vector=[None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist() for x in b[blob]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cache.schema if f.name != blob)
    return cache.mapInPandas(run, f"{schema}, vector array<float>")


def cached_embeddings(papers: DataFrame, cache: DataFrame, model_id: str, encoder: Callable[[], Encoder]) -> tuple[DataFrame, DataFrame]:
    """(paper_id, source, vector) of all papers, and the cache rows that are new."""
    hit, miss = cache_split(papers, cache, model_id)
    todo = miss.select(F.col("content_hash").alias("key"), embedding_text(F.col("title"), F.col("abstract")).alias("text")).dropDuplicates(["key"])
    new = embed(todo, encoder).select(F.col("key").alias("content_hash"), F.lit(model_id).alias("model_id"), "vector")
    made = miss.join(new.select("content_hash", "vector"), "content_hash")
    return hit.select("paper_id", "source", "vector").unionByName(made.select("paper_id", "source", "vector")), new


def query_vectors(queries: DataFrame, encoder: Callable[[], Encoder], most_words: int = 64) -> DataFrame:
    """(query_id, vector) of the queries; a blank one is an error."""
    text = F.when(F.trim("query_text") == "", F.raise_error(F.lit("a query must not be blank"))).otherwise(first_words(F.col("query_text"), most_words))
    return embed(queries.select(F.col("query_id").alias("key"), text.alias("text")), encoder).withColumnRenamed("key", "query_id")


#: Query vectors that are sent to all tasks, at most (13 MB of float32 at 768 dimensions); more meet the rows in cells.
BROADCAST_QUERIES = 4096
#: Rows and queries in a cell, and queries in one matrix product.
CELL_ROWS, BLOCK_QUERIES = 16_384, 1024


def _units(vectors: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors; one that is null, of another length, not finite or zero is zero."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dim:
            out[i] = v
    out[~np.isfinite(out).all(1)] = 0.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def _best(names: np.ndarray, mat: np.ndarray, rows: pd.DataFrame, top: int) -> Iterator[pd.DataFrame]:
    """The `top` best of some rows for every query; ties go to the smaller id, so rounding comes first and the order is total."""
    if not len(rows) or not len(names):
        return
    x, ids = _units(rows["vector"], mat.shape[1]), rows["id"].to_numpy()
    place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    for at in range(0, len(names), BLOCK_QUERIES):
        s = np.round(mat[at : at + BLOCK_QUERIES] @ x.T, 6)
        order = np.lexsort((np.broadcast_to(place, s.shape), -s), axis=1)[:, :top]
        yield pd.DataFrame({"query_id": np.repeat(names[at : at + BLOCK_QUERIES], order.shape[1]), "id": ids[order.ravel()], "score": np.take_along_axis(s, order, 1).ravel()})


def topk(vectors: DataFrame, queries: DataFrame, top: int = 10, least: float = -1.0, clip: bool = False, broadcast_queries: int = BROADCAST_QUERIES, cell: int = CELL_ROWS) -> DataFrame:
    """(query_id, id, score, rank): cosine of every query with every vector, the best `top` of each.

    `vectors`: (id, vector), `queries`: (query_id, vector). A counted small query set is sent to all tasks and no
    vector is shuffled; a larger one meets the rows in cells of bounded size. Either way a batch of rows is one
    matrix product a block and keeps `top` rows a query. Vectors that are null, of another length, zero or not finite score 0.
    `clip` brings scores into [0, 1].
    """
    spark = vectors.sparkSession
    kind, qkind = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qkind}, id {kind}, score double"
    listed = queries.select("query_id", "vector")
    n = listed.count()
    dim = listed.agg(F.max(F.size("vector")).alias("d")).collect()[0]["d"] or 1  # one number
    if n <= broadcast_queries:
        sent = listed.orderBy("query_id").toPandas()
        mat = spark.sparkContext.broadcast((sent["query_id"].to_numpy(), _units(sent["vector"], dim)))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield from _best(*mat.value, b, top)

        out = vectors.select("id", "vector").mapInPandas(scan, schema)
    else:

        def meet(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            found = list(_best(part["query_id"].to_numpy(), _units(part["vector"], dim), rows, top))
            return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})

        chunks, parts = max(1, -(-vectors.count() // cell)), max(1, -(-n // cell))
        own = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        here = vectors.select("id", "vector", own("id", chunks).alias("chunk"), every(parts).alias("part"))
        there = listed.select("query_id", "vector", own("query_id", parts).alias("part"), every(chunks).alias("chunk"))
        out = here.groupBy("chunk", "part").cogroup(there.groupBy("chunk", "part")).applyInPandas(meet, schema)
    if clip:
        out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))))
    best = W.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.where(F.col("score") >= least).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def rank_papers(papers: DataFrame, cache: DataFrame, model_id: str, queries: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, id, score, rank): papers by the cached vectors of their contents, scores in [0, 1]; a paper without a vector scores 0.

    `papers`: paper_id, source, title, abstract; `cache`: content_hash, model_id, vector. An id is source:paper_id.
    """
    keyed = papers.select(F.concat_ws(":", "source", "paper_id").alias("id"), content_hash(F.col("title"), F.col("abstract")).alias("content_hash"))
    mine = cache.where(F.col("model_id") == model_id).groupBy("content_hash").agg(F.first("vector", ignorenulls=True).alias("vector"))
    return topk(keyed.join(mine, "content_hash", "left").select("id", "vector"), queries, top, clip=True)


def compare_texts(a: str, b: str, encoder: Callable[[], Encoder]) -> float:
    """Cosine of two texts under an encoder."""
    x, y = encoder()([a if a.strip() else " ", b if b.strip() else " "]).astype(np.float64)
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / n) if n > 0 else 0.0
