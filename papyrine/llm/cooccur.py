"""Items that appear together: an incrementally kept pair table.

The table lives in a folder and is opened by its path. It holds

* the items of every basket, as a log: an increment appends the baskets it changed, the latest entry counts;
* the marginal count of every item, in hash buckets;
* the count of every pair with the marginals and the association score it was last scored with, in hash buckets.

An increment compares the changed baskets with what was stored and emits +1 and -1 deltas for items
and pairs. They are merged into the buckets they fall in. Scores are recomputed for the affected
pairs only: those with a delta and those that hold an item whose marginal moved; buckets without an
affected pair keep their files. The stored score is n_ab / (n_a * n_b): how far a pair exceeds
chance is N times that, so a change of N alone leaves it valid.

Every increment writes new folders and then one manifest that names the folders in force; a reader
takes the latest whole manifest, so a lost job leaves the table as it was.

Defined results: a basket with a null id is ignored; null, empty or incomplete lists are empty;
items are trimmed of white space of any kind and lower-cased, blank ones dropped, repeats count
once; baskets without items count in N; an empty table gives an empty result; an increment without
a change writes no counts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import json_strings, squeeze
from papyrine.session import small, stored

#: Buckets of the pair and marginal tables, and parts a bucket is written in; more for more data, the results do not change.
BUCKETS, PARTS = 16, 2
#: Baskets of more items are paired in pieces of so many, which are spread over the tasks.
LONG = 1000
#: Moved items are broadcast up to this number (some 20 MB).
BROADCAST_ITEMS = 200_000
SCHEMAS = {
    "baskets": "basket string, items array<string>, version int",
    "items": "item string, n long, bucket int",
    "pairs": "item_a string, item_b string, n_ab long, n_a long, n_b long, score double, bucket int",
}
PAIR = ["item_a", "item_b"]


def baskets(rows: DataFrame, basket: str, lists: list[str]) -> DataFrame:
    """(basket, items): the sorted distinct items of all lists over all rows of a basket."""
    items = F.concat(*[json_strings(F.col(c)) for c in lists])
    names = F.filter(F.transform(items, lambda x: F.lower(squeeze(x))), lambda x: x.isNotNull() & (x != ""))
    flat = rows.where(F.col(basket).isNotNull()).select(F.col(basket).alias("basket"), F.explode_outer(F.array_distinct(names)).alias("item"))
    # sets are merged before the shuffle, so a basket with any share of the rows is no more than its distinct items
    return flat.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))


def paired(rows: DataFrame, long: int = LONG) -> DataFrame:
    """(item_a, item_b, d): every pair (smaller, larger) of the sorted distinct `items` of each row, with the row's d.

    Pairs are generated from two indexes, one after the other, so no row ever holds all pairs of a basket;
    a long basket is cut into pieces of its first index, which are spread over the tasks.
    """
    size = F.size("items")
    pieces = rows.where(size > long).select("items", "d", F.explode(F.sequence(F.lit(0), F.ceil(size / long).cast("int") - 1)).alias("piece"))
    pieces = pieces.repartition(F.xxhash64("items"), "piece").select("items", "d", F.explode(F.sequence(F.col("piece") * long, F.least((F.col("piece") + 1) * long, size) - 1)).alias("i"))
    short = rows.where((size > 1) & (size <= long)).select("items", "d", F.explode(F.sequence(F.lit(0), size - 2)).alias("i"))
    first = short.unionByName(pieces).select(F.element_at("items", F.col("i") + 1).alias("item_a"), F.slice("items", F.col("i") + 2, size).alias("rest"), "d")
    return first.select("item_a", F.explode("rest").alias("item_b"), "d")


class PairTable:
    """The pair table in folder `path`, empty if there is none; see the head of the module."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS")
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
        names = [f.getPath().getParent().getName() for f in found]
        self.state = {"version": 0, "n": 0, "buckets": buckets, "logs": [], "items": {}, "pairs": {}}
        if names:
            last = max(names, key=lambda n: int(n.split("-")[1]))
            self.state = json.loads(spark.read.text(f"{path}/{last}", wholetext=True).first()[0])
        #: What the last increment did: pairs scored again and buckets written.
        self.work = {"scored": 0, "buckets": 0}

    def _commit(self, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{state['version']}")
        self.state = state

    def _read(self, name: str) -> DataFrame:
        """A bucketed table: of every version the buckets that are in force."""
        out = self.spark.createDataFrame([], SCHEMAS[name])
        by: dict[int, list[int]] = {}
        for bucket, version in self.state[name].items():
            by.setdefault(version, []).append(int(bucket))
        for version, mine in by.items():
            part = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}-{version}").where(F.col("bucket").isin(mine))
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, df: DataFrame, name: str, version: int, keys: list[str]) -> None:
        df.repartition("bucket", F.pmod(F.xxhash64(F.lit(name), *keys), F.lit(PARTS))).write.partitionBy("bucket").parquet(f"{self.path}/{name}-{version}")

    def _bucketed(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.state["buckets"])).cast("int"))

    def known(self) -> DataFrame:
        """(basket, items) as they stand."""
        logs = [self.spark.read.schema(SCHEMAS["baskets"]).parquet(f"{self.path}/baskets-{v}") for v in self.state["logs"]]
        out = self.spark.createDataFrame([], SCHEMAS["baskets"])
        for log in logs:
            out = out.unionByName(log)
        return out.groupBy("basket").agg(F.max_by("items", "version").alias("items"))

    def add(self, changed: DataFrame, replace: bool = False) -> "PairTable":
        """Takes in `changed` (basket, items): united with, or with `replace` put for, what was stored; returns itself."""
        version = self.state["version"] + 1
        none = F.array().cast("array<string>")
        new = stored(changed.select("basket", F.col("items").alias("new")), "changed")
        old = self.known().join(new.select("basket"), "basket", "left_semi").withColumnRenamed("items", "old")
        both = new.join(old, "basket", "left").withColumn("fresh", F.col("old").isNull()).withColumn("old", F.coalesce("old", none))
        if not replace:
            both = both.withColumn("new", F.array_sort(F.array_union("old", "new")))
        moved = stored(both.where("fresh or old <> new"), "moved")
        counts = moved.agg(F.count("*").alias("all"), F.sum(F.col("fresh").cast("long")).alias("fresh")).collect()[0]  # two numbers
        self.work = {"scored": 0, "buckets": 0}
        if not counts["all"]:
            return self
        moved.select("basket", F.col("new").alias("items"), F.lit(version).alias("version")).write.parquet(f"{self.path}/baskets-{version}")
        signed = moved.select(F.col("new").alias("items"), F.lit(1).alias("d")).unionByName(moved.select(F.col("old").alias("items"), F.lit(-1).alias("d")))
        items = stored(signed.select(F.explode("items").alias("item"), "d").groupBy("item").agg(F.sum("d").alias("d")).where("d <> 0"), "item-deltas")
        pairs = stored(paired(signed).groupBy(*PAIR).agg(F.sum("d").alias("d")).where("d <> 0"), "pair-deltas")
        state = {**self.state, "version": version, "n": self.state["n"] + counts["fresh"], "logs": [*self.state["logs"], version]}

        # marginals: the buckets with a delta
        delta = self._bucketed(items, ["item"])
        touched = sorted(r["bucket"] for r in delta.select("bucket").distinct().collect())  # at most `buckets` numbers
        if touched:
            merged = self._read("items").where(F.col("bucket").isin(touched)).select("item", "n", "bucket").unionByName(delta.select("item", F.col("d").alias("n"), "bucket"))
            self._write(merged.groupBy("item", "bucket").agg(F.sum("n").alias("n")).where("n > 0"), "items", version, ["item"])
        state["items"] = self.state["items"] | {str(b): version for b in touched}

        # pairs: those with a delta and those with a moved item are scored again, in the buckets that hold one
        held = self._read("pairs")
        m = items.select("item", F.lit(True).alias("moved"))
        m = F.broadcast(m) if small(items, BROADCAST_ITEMS) else m
        marked = held
        for c in PAIR:
            marked = marked.join(m.select(F.col("item").alias(c), F.col("moved").alias(f"moved_{c}")), c, "left")
        marked = marked.join(pairs.select(*PAIR, F.col("d")), PAIR, "left")
        again = F.col("moved_item_a").isNotNull() | F.col("moved_item_b").isNotNull() | F.col("d").isNotNull()
        marked = stored(marked.withColumn("again", again), "marked")
        sums = marked.where("again").select(*PAIR, F.col("n_ab").alias("d")).unionByName(pairs).groupBy(*PAIR).agg(F.sum("d").alias("n_ab"))
        sums = stored(self._bucketed(sums, PAIR), "sums")
        touched = sorted(r["bucket"] for r in sums.select("bucket").distinct().collect())  # at most `buckets` numbers
        if touched:
            before, self.state = self.state, state
            n = self._read("items")
            self.state = before
            scored = sums.where("n_ab > 0")
            for c, name in zip(PAIR, ("n_a", "n_b"), strict=True):
                scored = scored.join(n.select(F.col("item").alias(c), F.col("n").alias(name)), c)
            scored = scored.withColumn("score", F.col("n_ab") / (F.col("n_a") * F.col("n_b")))
            rest = marked.where(~F.col("again") & F.col("bucket").isin(touched))
            columns = [*PAIR, "n_ab", "n_a", "n_b", "score", "bucket"]
            self._write(rest.select(*columns).unionByName(scored.select(*columns)), "pairs", version, PAIR)
            self.work = {"scored": sums.count(), "buckets": len(touched)}
        state["pairs"] = self.state["pairs"] | {str(b): version for b in touched}
        self._commit(state)
        return self

    def scores(self, least: int = 1) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, n, lift, npmi) of pairs named together at least `least` times, from the stored counts."""
        full = self._read("pairs").where(F.col("n_ab") >= least).withColumn("n", F.lit(self.state["n"]).cast("long"))
        lift = F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))
        npmi = F.when(F.col("n_ab") == F.col("n"), F.lit(1.0)).otherwise(F.log(lift) / -F.log(F.col("n_ab") / F.col("n")))
        return full.select(*PAIR, "n_ab", "n_a", "n_b", "n", lift.alias("lift"), npmi.alias("npmi"))

    def vacuum(self) -> None:
        """Deletes the folders and manifests that are no longer in force."""
        keep = {f"baskets-{v}" for v in self.state["logs"]} | {f"{t}-{v}" for t in ("items", "pairs") for v in self.state[t].values()} | {f"manifest-{self.state['version']}"}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(root):
            if f.getPath().getName() not in keep:
                fs.delete(f.getPath(), True)


def increments(rows: DataFrame, basket: str, lists: list[str], at: str, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The baskets of the rows up to the `share` quantile of `at`, and those of the later ones."""
    split = rows.agg(F.percentile_approx(F.col(at).cast("double"), share, 1000).alias("s")).collect()[0]["s"]
    late = F.coalesce(F.col(at).cast("double") > F.lit(split), F.lit(True)) if split is not None else F.lit(False)
    return baskets(rows.where(~late), basket, lists), baskets(rows.where(late), basket, lists)
