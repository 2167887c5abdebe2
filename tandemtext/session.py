"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# Spark then deletes the shuffle files of a query when it ends.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str, master: str | None = None, **overrides: str) -> SparkSession:
    """A session with the settings the jobs are tuned for; a cluster keeps its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        **overrides,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it.

    Only a local session may fall back to a folder of its own: its executors live
    on the driver's machine.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tandemtext-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session has other settings inside this."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written to a table inside this leaves no shuffle files behind.

    They would stay on the disks until the driver happens to collect its garbage, beside those of
    all later steps. A stage that is lost while the table is written runs again as ever.
    """
    return settings(spark, {CLEANUP_KEY: "true"})


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def _deleted(spark: SparkSession, told: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(told)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(*frames: DataFrame) -> int:
    """Deletes the scratch tables that the frames read and nothing reads any more, and tells how many."""
    gone = 0
    for frame in frames:
        files = frame.inputFiles()
        for path in [p for p in _made if any(f"/{os.path.basename(p)}/" in file for file in files)]:
            _made.remove(path)
            gone += _deleted(frame.sparkSession, path)
    return gone


def clear_scratch(spark: SparkSession) -> int:
    """Deletes the scratch tables of this process, and tells how many.

    To be called once the results that read them are stored.
    """
    gone = 0
    while _made:
        gone += _deleted(spark, _made.pop())
    return gone
