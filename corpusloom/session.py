"""Session settings, table access and lineage cuts shared by the whole library."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "corpusloom", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is tested under."""
    n = shuffle_partitions or (os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOM_DRIVER_MEMORY", "12g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by spark.checkpoint.dir; where it is unset, a temporary one on a single
    machine, and an error on a cluster, whose executors would each write to a disk of their own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written so far; results that still read them must be stored before."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _tables:
        path = hadoop.Path(_tables.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartitions a scan that has fewer partitions than the cluster has cores; larger scans stay as they are.

    Only for plans without a shuffle: the partition count of others is known no sooner than they run.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: they need not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    own = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    target = os.path.join(own, "corpusloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("corpusloom", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key once, in as many partitions as there are cores or shuffle partitions: one shuffle, which stays that wide
    for the Python work that follows."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key).dropDuplicates([key])
