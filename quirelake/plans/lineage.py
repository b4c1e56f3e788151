"""Cutting lineage so that a lost executor costs one stage and not the whole job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    `spark.checkpoint.dir` wins; a machine-local folder is made only where the
    session names none, which is the case in tests on one machine.
    """
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir()
    if set_dir:
        return set_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quirelake-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the JVM of the driver ends or by `release`."""
    path = f"{checkpoint_dir(spark)}/quirelake-{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    _written.setdefault(spark.sparkContext.applicationId, []).append(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table to the shared checkpoint folder and read back.

    Unlike rows of a checkpoint, the table is compressed, its columns are read
    only where they are used, and its size is known to the planner. The tables go
    when the JVM of the driver ends, or with `release`.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all that `scratch` and `cut` have written; results that read it must have been stored."""
    for place in _written.pop(spark.sparkContext.applicationId, []):
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
