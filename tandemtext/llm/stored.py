"""Tables written to the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tandemtext.session import scratch_path


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table that every executor can reach."""
    path = scratch_path(frame.sparkSession, label)
    schema = frame.schema
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(schema).parquet(path)
