"""Helpers that every operator shares: reading tables, picking columns, cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, found by exact spelling, so that extra columns whose
    names differ in case alone (or repeat the operator's own names) cannot clash."""
    fields = df.columns
    if len({c.lower() for c in fields}) == len(fields):
        return df.select(*(F.col(f"`{n}`") for n in names))
    plain = df.toDF(*(f"c{i}" for i in range(len(fields))))
    return plain.select(*(F.col(f"c{fields.index(n)}").alias(n) for n in names))


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, wherever they run and whatever their path is."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("graphloom", os.path.relpath(full, root)))
    sc.addPyFile(path)  # Spark copies it to the executors
    _shipped.add(sc.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """At least a partition per core: a few small files would leave costly work to a few tasks."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local.

    On a cluster there is no such folder of one machine: each executor would write its own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors (unlike a local checkpoint) and costs one
    columnar, compressed write. The tables are removed by ``release`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "pos") -> DataFrame:
    """With ``name``: the place from 1 in the order of ``order``, without bringing all rows to one task.

    Rows are partitioned by range and sorted within their partitions; only the number of rows
    of each partition comes to the driver.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid"))
    rows = keep(rows, "numbered")
    at, offsets = 0, []
    for r in rows.groupBy("_pid").agg(F.count("*").alias("n"), F.min("_mid").alias("first")).orderBy("_pid").collect():
        offsets.append((r._pid, at - r.first + 1))
        at += r.n
    table = F.broadcast(spark.createDataFrame(offsets, "_pid int, _off bigint"))  # a row per partition
    return rows.join(table, "_pid").withColumn(name, F.col("_mid") + F.col("_off")).drop("_pid", "_mid", "_off")


@atexit.register
def release() -> None:
    """Removes all kept tables: to be called once the results of the queries so far have been read."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may already be gone
            return
