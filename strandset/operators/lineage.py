"""Cutting the lineage of iterative jobs: tables written in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named in ``spark.checkpoint.dir``.

    Only a local session, whose tasks share one machine, may name none: it gets a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandset-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def own_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared one: all that it writes between steps lies there."""
    return f"{shared_folder(spark)}/strandset-{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def told(spark: SparkSession, path: str) -> dict[int, str]:
    """The names of the batches told at ``path``, a row each, by their numbers."""
    if not exists(spark, f"{path}/batches"):
        return {}
    return dict(spark.read.parquet(f"{path}/batches").select("at", "batch").collect())


def tell(spark: SparkSession, path: str, at: int, batch: str) -> None:
    """Tells that all rows of a batch are written; whatever was not told does not count."""
    spark.createDataFrame([(at, batch)], "at int, batch string").repartition(1).write.mode("append").parquet(f"{path}/batches")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside leaves no shuffle files behind: for a table that is written, not for one that is read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: The tables written within each :func:`settled` that is under way.
_within: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again.

    Unlike a checkpoint this gives the next plan true sizes, so that adaptive joins stay right over many
    rounds, and a lost executor costs no earlier round. The shuffle files of the job go when the rows are written.
    """
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    for tables in _within:
        tables.append(out)
    return out


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written; all that was written on the way goes, so nothing else may read that."""
    _within.append([])
    try:
        out = written(make())
    finally:
        on_the_way = _within.pop()
    discard(*(df for df in on_the_way if df is not out))
    return out


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A narrow table to be joined: broadcast if it has at most ``most`` rows, else left to a shuffle.

    Rows are counted, a number a task, and none is moved; of a :func:`written` table the files' footers tell.
    """
    return F.broadcast(df) if df.count() <= most else df


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.written_to)


def remove_intermediates(spark: SparkSession) -> None:
    """Deletes all that this application has written between steps, checkpoints too; its results must have been read or stored."""
    delete(spark, own_folder(spark))
    if (checkpoints := spark.sparkContext.getCheckpointDir()) is not None:
        delete(spark, checkpoints)
