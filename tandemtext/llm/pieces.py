"""Arrow batches in small pieces, so that a task holds few texts as Python objects."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 256
BATCH_ROWS = 1024
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def pieces(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``rows`` at a time; every batch gives one piece at least."""
    for batch in batches:
        for a in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(a, rows)


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends fewer of them to Python at a time.

    Rows are whole documents here. Spark's default of 10,000 is made for rows of some bytes, and
    a batch stands in the executor's memory twice while it is built. A smaller setting stays.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(BATCH_KEY)) <= BATCH_ROWS:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return docs
