"""Filling fixed-capacity containers with items: mixture-controlled packing.

Texts are measured in tokens of a public tokenizer and put whole into sequences of `capacity`
tokens. Every source is a queue with a share of all tokens; a window (sequence) is filled from the
queue that is furthest behind its share (deficit round-robin, deficits divided by the shares), each
time with the longest waiting text that still fits. Deficits are carried from window to window and,
through a prefix sum over the shards, from shard to shard. Only texts longer than the capacity are
split: into full sequences of their own and one rest that is packed like any text. A target mixture
holds in every window until a source runs dry, since no text is left out or repeated; mixture_report
states the deviation of every run of windows and what each source had left.

Defined results: rows without an id are left out; repeated rows are packed once; a null source is a source of its own; null and
empty texts have no tokens and come out with a null sequence and place; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from papyrine.session import stored

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The usual pre-tokenisation pattern of this vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A shard is one task's work: at most about so many texts and tokens, whatever the input's size.
SHARD_TEXTS, SHARD_TOKENS = 50_000, 16_000_000
#: The mixture in which every source has the same share.
EVEN = "even"
#: Windows that are reported on together.
RUN = 64
PACKED = "seq_id string, doc_id long, piece int, place int, start_token int, n_tokens int, source string"


def token_counter(name: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts tokens per text; the tokenizer, a file sent along with the application, is loaded once per Python worker."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "digest": b["digest"], "n_tokens": n})

    return count


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every distinct document. `tokenizer`: a path the driver can read."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = documents.where("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), text.alias("text"), F.xxhash64(text).alias("digest"))
    sized = flat.mapInPandas(token_counter(os.path.basename(tokenizer)), "doc_id long, source string, digest long, n_tokens long")
    return sized.distinct().drop("digest")


def fill(sizes: list[int], sources: list[str], shares: dict[str, float], behind: dict[str, float], capacity: int) -> list[list[int]]:
    """Windows of item indexes. `behind`: tokens by which each source trails its share at the start."""
    queues: dict[str, list[tuple[int, int]]] = {}
    for i, (n, s) in enumerate(zip(sizes, sources, strict=True)):
        queues.setdefault(s, []).append((n, i))
    for q in queues.values():
        q.sort()
    # the smallest served/share is furthest behind its share
    heap = [(-behind.get(s, 0.0) / shares[s], s) for s in queues]
    heapq.heapify(heap)
    windows: list[list[int]] = []
    while heap:
        room, window, waiting = capacity, [], []
        while heap and room > 0:
            served, s = heapq.heappop(heap)
            q = queues[s]
            at = bisect.bisect_right(q, (room, len(sizes)))
            if not at:  # its shortest text doesn't fit into what is left
                waiting.append((served, s))
                continue
            n, i = q.pop(at - 1)
            window.append(i)
            room -= n
            if q:
                heapq.heappush(heap, (served + n / shares[s], s))
        for x in waiting:
            heapq.heappush(heap, x)
        windows.append(window)
    return windows


def packer(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["source", "n_tokens", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        first = shard.drop_duplicates("source")
        shares = dict(zip(first["source"], first["share"], strict=True))
        behind = dict(zip(first["source"], first["behind"], strict=True))
        sizes = shard["n_tokens"].tolist()
        rows = []
        name = int(shard["shard"].iloc[0])
        for w, window in enumerate(fill(sizes, shard["source"].tolist(), shares, behind, capacity)):
            start = 0
            for place, i in enumerate(window):
                rows.append((i, f"{name:07d}-{w:07d}", place, start))
                start += sizes[i]
        at = [r[0] for r in rows]
        out = shard.iloc[at].reset_index(drop=True)
        return pd.DataFrame({"seq_id": [r[1] for r in rows], "doc_id": out["doc_id"], "piece": out["piece"], "place": [r[2] for r in rows], "start_token": [r[3] for r in rows], "n_tokens": out["n_tokens"].astype("int32"), "source": out["source"]})

    return pack


def packed(sizes: DataFrame, capacity: int = CAPACITY, mixture: dict[str, float] | str | None = None, shard_texts: int = SHARD_TEXTS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every text's sequence and place (schema PACKED). `mixture`: target shares by source, EVEN for the same share of each, else those of the input.

    The number of shards follows the input, a shard's size does not. The table of tokens by shard
    and source is aggregated before it is used and never leaves the executors.
    """
    sizes = stored(sizes, "sizes")
    total = sizes.agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()[0]  # two numbers
    shards = max(1, -(-total["n"] // shard_texts), -(-(total["t"] or 0) // shard_tokens))
    some = sizes.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "source"), F.lit(shards)).cast("int"))
    by = some.groupBy("shard", "source").agg(F.sum("n_tokens").alias("own"))
    of = by.groupBy("source").agg(F.sum("own").alias("sum"))
    if mixture == EVEN:
        share = F.lit(1.0) / F.lit(float(max(1, of.count())))
    elif mixture:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in mixture.items() for x in kv]), F.col("source")), F.lit(1e-6))
    else:
        share = F.col("sum") / F.lit(float(total["t"] or 1))
    # one row a shard: some tens of bytes for every 16 million tokens, so one task numbers them
    each_shard = by.groupBy("shard").agg(F.sum("own").alias("all"))
    run = W.Window.orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
    before_all = each_shard.select("shard", F.coalesce(F.sum("all").over(run), F.lit(0)).alias("before_all"))
    own_run = W.Window.partitionBy("source").orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
    before = by.select("shard", "source", F.coalesce(F.sum("own").over(own_run), F.lit(0)).alias("before"))
    state = before.join(before_all, "shard").join(of.select("source", share.alias("share"), (F.col("sum") / F.lit(float(total["t"] or 1))).alias("supply")), "source")
    # what earlier shards were given less of, against the whole input; what they could not place for want of a source is no deficit
    state = state.select("shard", "source", "share", (F.col("supply") * F.col("before_all") - F.col("before")).alias("behind"))
    full = some.where(F.col("n_tokens") >= capacity).select("doc_id", "source", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n_tokens") / capacity) - 1).cast("int"))).alias("piece"))
    own = full.select(F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("seq_id"), "doc_id", "piece", F.lit(0).alias("place"), F.lit(0).alias("start_token"), F.lit(capacity).alias("n_tokens"), "source")
    rest = some.select("doc_id", "source", "shard", F.floor(F.col("n_tokens") / capacity).cast("int").alias("piece"), (F.col("n_tokens") % capacity).cast("int").alias("n_tokens")).where("n_tokens > 0")
    placed = rest.join(state, ["shard", "source"]).groupBy("shard").applyInPandas(packer(capacity), PACKED)
    none = sizes.where("n_tokens = 0").select(F.lit(None).cast("string").alias("seq_id"), "doc_id", F.lit(0).alias("piece"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("start_token"), F.lit(0).alias("n_tokens"), "source")
    return placed.unionByName(own).unionByName(none)


def mixture_report(placed: DataFrame, mixture: dict[str, float] | str | None = None, run: int = RUN) -> DataFrame:
    """(shard, run, source, n_tokens, share, target, deviation, left): each source's share of every run of windows.

    `left` is what the shard's source still has after the run; where a source has nothing left the
    target can't be held. Full sequences of split texts hold one text and are left out.
    """
    at = F.split("seq_id", "-")
    w = placed.where("seq_id is not null and not startswith(seq_id, 'full-')").select(at[0].cast("long").alias("shard"), F.floor(at[1].cast("long") / run).alias("run"), "source", "n_tokens")
    got = stored(w.groupBy("shard", "run", "source").agg(F.sum("n_tokens").alias("n")), "runs")
    supply = got.groupBy("shard", "source").agg(F.sum("n").alias("supply"))
    every = got.groupBy("shard", "run").agg(F.sum("n").alias("all")).join(supply, "shard")
    of = supply.groupBy("source").agg(F.sum("supply").alias("t"))
    whole = of.agg(F.count("*").alias("k"), F.sum("t").alias("t")).collect()[0]  # two numbers
    if mixture == EVEN:
        target = F.lit(1.0 / max(1, whole["k"]))
    elif mixture:
        target = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in mixture.items() for x in kv]), F.col("source")), F.lit(0.0))
    else:
        target = F.col("t") / F.lit(float(whole["t"] or 1))
    full = every.join(got, ["shard", "run", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0))).join(of.select("source", target.alias("target")), "source")
    so_far = F.sum("n").over(W.Window.partitionBy("shard", "source").orderBy("run"))
    full = full.withColumn("left", F.col("supply") - so_far).withColumn("share", F.col("n") / F.col("all"))
    return full.select("shard", "run", "source", F.col("n").alias("n_tokens"), F.round("share", 6).alias("share"), F.round("target", 6).alias("target"), F.round(F.col("share") - F.col("target"), 6).alias("deviation"), "left")
