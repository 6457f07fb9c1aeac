"""Session helpers: settings every entry point wants, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Settings of sessions made here; a session handed in by a caller keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int = 8, name: str = "loomstat", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(cores), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in spark.checkpoint.dir.

    Only a local session where it is unset (tests, a laptop) gets a temporary folder;
    on a cluster, whose executors don't share one, it must be given.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomstat-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back, which cuts the lineage and survives the loss of executors.

    The rows are computed once; a checkpoint of their RDD would compute the last stage twice.
    The folder is removed when the program ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/loomstat-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


@atexit.register
def _remove_written() -> None:
    """Remove the written tables, whether the session has been stopped or not."""
    jvm = SparkContext._jvm
    for path in _WRITTEN:
        try:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)
        except Exception:  # the JVM has ended; the folder's own retention has to remove it
            return


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it wherever it is installed.

    Every operator that runs Python on the executors calls it. The temporary folder holds the zipped code on its way, no data.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomstat-")) / "loomstat.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"loomstat/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def by_group(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``applyInPandas`` with this package sent to the executors first; for groups that stay small, such as a series."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(work, schema)


def map_frames(df: DataFrame, work: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` with this package sent to the executors first."""
    ship(df.sparkSession)
    return df.mapInPandas(work, schema)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")
