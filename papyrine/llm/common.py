"""Helpers shared by the operators of this package: normal forms, components, distributed ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from papyrine.session import ship, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _letters() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decompositions."""
    import unicodedata

    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case, accents removed, markup and entities blanked."""
    bare = F.regexp_replace(c, r"<[^<>]{0,200}>", " ")
    bare = F.regexp_replace(bare, r"&amp;|&#38;", " and ")
    bare = F.regexp_replace(bare, r"&#?\w{1,10};", " ")
    return F.lower(F.translate(bare, *_letters()))


def words(c: Column) -> Column:
    """The runs of [a-z0-9] of the folded text, in order; an empty list for null."""
    runs = F.split(F.trim(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " ")), " ")
    return F.filter(runs, lambda w: w != "")


def json_strings(c: Column) -> Column:
    """The strings of a JSON array; an empty list for null, empty or incomplete JSON."""
    whole = F.coalesce(c, F.lit("")).rlike(r"(?s)^\s*\[.*\]\s*$")
    parsed = F.from_json(F.when(whole, c), T.ArrayType(T.StringType()), {"mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast("array<string>"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components as (id, root), root the smallest id, by min labels with pointer jumping.

    `edges` has columns a and b. Every round writes its labels to the shared folder, so the plan
    stays short and a lost executor costs one round. Only the number of changes reaches the driver.
    """
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
    label = stored(label, "label")
    for _ in range(rounds):
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(near, label.id == near.a).select("id", "root", F.least("root", "near").alias("mid"))
        far = label.select(F.col("id").alias("k"), F.col("root").alias("far"))
        step = step.join(far, step.mid == far.k, "left").select("id", F.col("root").alias("old"), F.least("mid", F.coalesce("far", "mid")).alias("root"))
        step = stored(step, "label")
        label = step.select("id", "root")
        if not step.where("old <> root").limit(1).count():
            return label
    raise RuntimeError("components did not settle")


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """`df` with `name`, the row's place within its group (1, 2, ...), however large a group is.

    Rows are range-partitioned by group and order, numbered inside each partition, and shifted by
    the counts of the same group in earlier partitions. No group has to fit into one task. The
    table of counts has at most (groups + partitions) rows and is joined by shuffle or broadcast
    as its measured size tells. `order` must be total up to equal rows.
    """
    keys = [F.col(c) for c in group]
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_p", F.spark_partition_id())
    spread = stored(spread, "ranked")
    local = spread.withColumn("_r", F.row_number().over(W.Window.partitionBy(*group, "_p").orderBy(*order)))
    counts = spread.groupBy(*group, "_p").count()
    before = counts.withColumn("_b", F.coalesce(F.sum("count").over(W.Window.partitionBy(*group).orderBy("_p").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    before = before.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*group, "_p"])], "_b")
    cond = F.lit(True)
    for i, c in enumerate([*group, "_p"]):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(before, cond)
    return out.select(*df.columns, (F.col("_r") + F.col("_b")).alias(name))


def met(rows: DataFrame, block: int) -> DataFrame:
    """(a, b), a < b: the `member` structs of `rows` (key, member) that share a key, once for each shared key.

    A key of more than `block` members is dealt into parts, and every part meets every part in a cell of
    its own: a key may hold any share of the rows, no task grows with it, and no pair is left out.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    left = dealt.select("key", F.col("own").alias("x"), F.explode(F.sequence(F.col("own"), F.col("parts") - 1)).alias("y"), F.col("member").alias("a"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("x"), F.col("own").alias("y"), F.col("member").alias("b"))
    return left.join(right, ["key", "x", "y"]).where("x < y or a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def asked(asks: DataFrame, rows: DataFrame, block: int) -> DataFrame:
    """(a, b): every member of `asks` (key, a) with every member of `rows` (key, b) that has its key.

    The rows of a key are dealt into parts of about `block`, each asked in a cell of its own, so a key may
    hold any share of the rows.
    """
    keys = asks.select("key").distinct()
    wanted = rows.join(keys, "key", "left_semi")
    parts = wanted.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    left = asks.join(parts, "key").select("key", "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = wanted.join(parts, "key").select("key", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    return left.join(right, ["key", "part"]).select("a", "b")


#: Bits of a filter of hashes: 8 MB, whatever the number of hashes; beyond some ten million it lets more through and stays right.
BITS = 1 << 26


def bits(df: DataFrame, column: str) -> np.ndarray:
    """A filter of the hashes in `column`: at most BITS / 64 numbers reach the driver."""
    at = df.select(F.pmod(F.col(column), F.lit(BITS)).alias("at"))
    found = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out


def in_bits(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes pass the filter."""
    at = np.mod(hashes, BITS)
    return (mask[at >> 6] >> (at & 63)) & 1 == 1
