"""Records of quoted text files, read in several splits of one file.

A line break ends a record if the quotes before it pair up. Each file split counts its quotes
by itself; sums over the splits before tell every split whether it begins inside of a quoted
cell. So a file of any length is read by many tasks. Only the lines of records that have
several meet, by the number of their record; all others stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
LINE = "file string, block long, line long, value string, own long, before long, even long, odd long"


def _numbered(scan: DataFrame) -> DataFrame:
    """Lines with what their split holds before them.

    ``line`` is the position in the split, ``own`` and ``before`` the quotes in the line and in
    front of it, ``even`` and ``odd`` how many records have begun up to here if the split begins
    outside or inside of a quoted cell. Lines pass by in file order and none is kept.
    """
    placed = scan.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy
        import pyarrow
        import pyarrow.compute as pc

        last, line, quotes, even, odd = None, 0, 0, 0, 0
        for batch in batches:
            own = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(numpy.int64)
            blocks = batch.column(1).to_numpy(zero_copy_only=False)
            files = batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cut = numpy.flatnonzero((numpy.diff(blocks) != 0) | (numpy.diff(files) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if a == b:
                    continue
                split = (batch.column(0)[a].as_py(), int(blocks[a]))
                if split != last:
                    last, line, quotes, even, odd = split, 0, 0, 0, 0
                sums = numpy.cumsum(own[a:b])
                before = quotes + sums - own[a:b]
                inside = before % 2
                evens, odds = even + numpy.cumsum(1 - inside), odd + numpy.cumsum(inside)
                columns = [numpy.arange(line, line + b - a), own[a:b], before, evens, odds]
                number, *rest = [pyarrow.array(c, pyarrow.int64()) for c in columns]
                line, quotes, even, odd = line + b - a, quotes + int(sums[-1]), int(evens[-1]), int(odds[-1])
                piece = batch.slice(a, b - a)
                yield pyarrow.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), number, piece.column(2), *rest],
                    ["file", "block", "line", "value", "own", "before", "even", "odd"],
                )

    return placed.mapInArrow(run, LINE)


def _splits(lines: DataFrame) -> DataFrame:
    """What comes before each split: whether it begins inside quotes, lines and records.

    A table with one row for each split of the files.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")

    def before(value: str | Column) -> Column:
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    totals = lines.groupBy("file", "block").agg(
        F.sum("own").alias("quotes"),
        F.count("*").alias("lines"),
        F.max("even").alias("even"),
        F.max("odd").alias("odd"),
    )
    closed = F.sum("quotes").over(whole) % 2 == 0
    unclosed = F.concat(F.lit("a quoted cell has no end in "), "file")
    placed = totals.withColumns(
        {
            "inside": F.when(closed, before("quotes") % 2 == 1).otherwise(F.raise_error(unclosed)),
            "lines_before": before("lines"),
        }
    )
    begun = F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))
    return placed.withColumn("records_before", before(begun)).select(
        "file", "block", "inside", "lines_before", "records_before"
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, value``: the records of quoted text files, numbered from 1 in each file.

    Quotes in cells are doubled. Empty records are left out, but counted; a carriage return in
    front of the line break that ends a record goes. A file that ends in a quoted cell is an
    error. A record is one value, so it has to fit into a task's memory; a file needn't.
    """
    lines = _numbered(spark.read.option("lineSep", "\n").text(path))
    placed = lines.join(_splits(lines), ["file", "block"])
    inside = (F.col("before") + F.col("inside").cast("int")) % 2 == 1
    open_after = (F.col("before") + F.col("inside").cast("int") + F.col("own")) % 2 == 1
    begun = F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))
    numbered = placed.select(
        "file",
        (F.col("records_before") + begun).alias("record"),
        (F.col("lines_before") + F.col("line")).alias("line_no"),
        "value",
        (~inside & ~open_after).alias("whole"),
    )
    parts = F.array_sort(F.collect_list(F.struct("line_no", "value")))
    joined = (
        numbered.where(~F.col("whole"))
        .groupBy("file", "record")
        .agg(F.array_join(parts["value"], "\n").alias("value"))
    )
    records = numbered.where("whole").select("file", "record", "value").union(joined)
    ended = F.when(F.endswith("value", F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)"))
    return records.withColumn("value", ended.otherwise(F.col("value"))).where("value != ''")
