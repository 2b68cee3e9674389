"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults that suit every job here; a cluster's own settings win.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a page may be 3 MB, so Arrow batches are kept short
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def carry_code() -> None:
    """Send this package's functions to the workers by value.

    Workers then need neither the package installed nor this process's import path.
    """
    import offerwise

    cloudpickle.register_pickle_by_value(offerwise)


def local_session(app: str = "offerwise", cpus: int | str = "*", **extra: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session; own folder only where unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


#: Where steps are staged instead of the checkpoint folder, if set.
STAGING = "offerwise.staging.dir"


@contextmanager
def passing(spark: SparkSession, folder: str) -> Iterator[None]:
    """Steps that are staged inside lie in ``folder``, which is deleted at the end; what a job
    shuffles is deleted when the job ends.

    For steps whose results are written elsewhere. Only this session's jobs are concerned: a
    stream has its own. What a failed attempt left in ``folder`` is deleted first.
    """
    settings = {STAGING: folder, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key, None) for key in settings}
    delete(spark, folder)
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, key: str | None = None, parts: int | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    As ``cut``, but later steps read only the columns they use; partitions and their order
    are not kept. With ``parts`` it is bucketed by ``key``: later steps that group or join by
    ``key`` need no shuffle. Such a table's name leaves the catalog again, its files stay
    (inside ``passing`` until its end).
    """
    spark, unique = df.sparkSession, uuid.uuid4().hex
    folder = spark.conf.get(STAGING, None) or checkpoint_dir(spark)
    path = f"{folder.rstrip('/')}/staged-{unique}"
    kept = df.select(*(F.col(n).cast("string") if kind == "void" else F.col(n) for n, kind in df.dtypes))
    if parts is None:
        kept.write.parquet(path)
        return spark.read.schema(kept.schema).parquet(path)
    name = f"staged_{unique}"
    # one task, and so one file, a bucket
    writer = kept.repartition(parts, key).write.format("parquet").option("path", path)
    writer.bucketBy(parts, key).saveAsTable(name)
    held = spark.table(name)
    held.schema  # analysed while the name is there
    spark.sql(f"DROP TABLE {name}")
    return held


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy parsing when the input has too few splits.

    A scan that is already as wide as the cluster is left alone, so no shuffle is
    added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
