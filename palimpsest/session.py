"""Session and scratch-storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[int, str] = {}
_RUN = uuid.uuid4().hex
_OWNED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing (tests, one JVM) a temporary folder of this
    machine is used; on a cluster without the setting that is refused, because
    other machines could not read it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="palimpsest-")
    return "file://" + _LOCAL_SCRATCH[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, in this process's own part of it.

    Results read these files lazily, so they are deleted when the process ends.
    """
    own = f"{shared_dir(spark)}/palimpsest/{_RUN}"
    if own not in _OWNED:
        _OWNED.add(own)
        atexit.register(_clear, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _clear(spark: SparkSession, path: str) -> None:
    try:
        drop_scratch(path, spark)
    except Exception:  # the session ended before the process; its files stay
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    The files survive the loss of any executor and cut the lineage, which
    ``localCheckpoint`` would not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df_or_path, spark: SparkSession | None = None) -> None:
    """Delete files written by :func:`materialize` that no later step reads."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {p.rsplit("/", 1)[0] for p in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows delivered more than once, kept once per key.

    One grouped aggregate with map-side combine; of rows that differ under one
    key the smallest in column order stays, so that the choice is repeatable.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a frame has at most ``max_rows`` rows, counted without reading on."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """A frame to be broadcast while a count shows it to be small, else as it is."""
    return F.broadcast(df) if small_enough(df, max_rows) else df
