"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package.

    On a cluster the package is installed or sent with --py-files; this only adds the
    source folder to the workers' path, which does no harm there.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local master, whose tasks run on this machine, may do without: a temporary folder is
    chosen there. On a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinquery-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_SCRATCH: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder, for a table written and read again."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def drop_scratch(spark: SparkSession, since: int = 0, but: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables this driver wrote into the shared folder, once nothing reads them any more.

    ``since``: only what came after that ``scratch_mark()``. ``but``: frames whose tables stay.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in but for f in df.inputFiles()}
    stay = []
    while len(_SCRATCH) > since:
        name = _SCRATCH.pop()
        if name.rsplit("/", 1)[-1] in kept:
            stay.append(name)
            continue
        path = at(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _SCRATCH.extend(reversed(stay))


def scratch_mark() -> int:
    return len(_SCRATCH)


#: Rows of a file, where a table's rows are known to be few; a file costs as much as many rows do.
ROWS_A_FILE = 20_000


def stored(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back.

    This cuts the lineage; the shuffle files of the job go with its end, as the table is all that
    later jobs read. ``rows``: how many there are at most, where that is known. Small tables then
    have a file for ``ROWS_A_FILE`` rows instead of one for each shuffle partition, as on a file system
    without native calls every file starts processes; large ones are written as they are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors."""
    return stored(df, "cut", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out over the cores; any other as it is.

    A small file of one row group is one task otherwise. Only for plain scans: of a plan with
    shuffles, asking for the number of partitions would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
