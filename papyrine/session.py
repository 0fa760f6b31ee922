"""Session helpers: a local session for tests and the shared folder for cut lineage."""

from __future__ import annotations

import functools
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "papyrine") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="papyrine-code-")) / "papyrine"
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
        _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    jsc = spark.sparkContext._jsc.sc()
    known = jsc.getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="papyrine-"))
    return jsc.getCheckpointDir().get()


#: Tables written since the innermost tidy() call began.
_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; deleted with the innermost tidy() call, if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished queries now; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what the listeners still hold goes with the second
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def stored(df: DataFrame, name: str = "t", parts: int | None = None, release: bool = False) -> DataFrame:
    """`df` written once as Parquet to the shared folder and read back; `release`: then the shuffle files behind it are given up.

    Cuts the lineage, survives the loss of executors, and gives the planner real sizes.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    out = df if parts is None else df.coalesce(parts)
    out.write.parquet(path)
    if release:
        released(spark)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote, as soon as nothing reads them any more."""
    for df in tables:
        for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
            _delete(df.sparkSession, path)


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Writes the result of `f` to the shared folder and deletes the tables that were written on the way to it."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args: object, **kwargs: object) -> DataFrame:
        _scopes.append([])
        try:
            out = f(spark, *args, **kwargs)
        finally:
            written = _scopes.pop()
        try:
            return stored(out, f.__name__)
        finally:
            for path in written:
                _delete(spark, path)

    return run


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether `df` has at most `most_rows` rows; reads no more than needed to tell."""
    return df.limit(most_rows + 1).count() <= most_rows
