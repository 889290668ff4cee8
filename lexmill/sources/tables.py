"""Parquet tables of one data directory, and the folder for stages that are written and read again."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_stages: dict[str, list[str]] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table ``<sf_dir>/<table>.parquet``."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset and the master is local
    does this set a folder of its own.
    """
    sc = spark.sparkContext
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = Path(tempfile.mkdtemp(prefix="lexmill-")).as_uri()
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again.

    It is computed once, its lineage ends at the files, and a lost executor loses nothing of it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stages.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` has written in this application, and gives their number.

    For the end of a job: a result that hasn't been computed yet may still read them.
    """
    paths = _stages.pop(spark.sparkContext.applicationId, [])
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(hadoop).delete(at, True)
    return len(paths)


def drop(df: DataFrame) -> None:
    """Deletes the table of ``cut`` that ``df`` was given as, once nothing reads it any more."""
    own = _stages.get(df.sparkSession.sparkContext.applicationId, [])
    for path in {p for f in df.inputFiles() for p in own if f"/{p.rsplit('/', 1)[1]}/" in f}:
        hadoop, jvm = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(hadoop).delete(at, True)
        own.remove(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer parts than they are; a large table stays as it is.

    For stages in Python that would else run in one task on a small file. To be used on a scan: asking for the
    parts of a plan with exchanges would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
