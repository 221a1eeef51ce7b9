"""Shared intermediate storage.

Results that several later jobs read are written once as Parquet into the shared folder named by
`spark.checkpoint.dir`, so a lost executor costs a re-read and not a recomputation, and the written
size lets Spark choose join strategies from facts.
"""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session: `spark.checkpoint.dir`, else one in the warehouse."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _session_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/creaseline/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one intermediate that nothing will read again."""
    _delete(spark, path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediates of this session. Results that were not stored cannot be read on."""
    _delete(spark, _session_folder(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    folder = _run_folder.get() or _session_folder(spark)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Gather what is written inside the block in one folder and delete it at the end.

    Frames that still read from it must not leave the block.
    """
    folder = scratch_path(spark, "run")
    token = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(token)
        _delete(spark, folder)


def written(frame: DataFrame, label: str) -> DataFrame:
    """`frame` stored in the shared folder and read back."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_alone(frame: DataFrame, label: str) -> DataFrame:
    """`written`, whose shuffle files go as soon as it is stored.

    Spark keeps them otherwise until the driver happens to collect garbage, so the disk would hold those
    of all steps at once. The setting is the session's: not for steps that run side by side.
    """
    conf = frame.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, "false")
    conf.set(_FREE_SHUFFLES, "true")
    try:
        return written(frame, label)
    finally:
        conf.set(_FREE_SHUFFLES, before)


def forget(*frames: DataFrame) -> None:
    """Delete intermediates, as `written` returned them, that nothing will read again."""
    for frame in frames:
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            discard(frame.sparkSession, folder)
