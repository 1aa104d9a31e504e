"""Session-level helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Inputs of at most so many bytes are spread over all cores before work in Python.
SMALL_BYTES = 16 << 20

_marked: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent and all runs on one machine (unit tests) a folder of this
    machine is made and set for the session, so that later calls agree on it; on a
    cluster, where executors could not read each other's folders, it is an error.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"parolumi-{os.getuid()}")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/parolumi-{spark.sparkContext.applicationId}"
    if path not in _marked:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _marked.add(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lineage ends there, so a
    lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of lowest hash of ``key``, or all of fewer rows.

    A first filter on the hash leaves about twice as many rows before they are
    sorted, so that what reaches the driver does not grow with ``df``.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    if total > 2 * rows:
        df = df.where(place < int((1 << 40) * (2 * rows / total)))
    return df.orderBy(place, key).limit(rows)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if the tables it reads have ``SMALL_BYTES`` in all at most, as one
    small file has; larger inputs are left as they lie. What is moved is thus bounded,
    whatever the data. For work in Python that costs far more than moving the rows."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else df
