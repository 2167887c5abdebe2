"""Corpus tables, split dictionaries, CSV and sentence files, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tandemtext.session import scratch_path, shuffles_dropped
from tandemtext.sources.records import read_records

# Quotes are doubled, and blanks at the ends of a cell belong to it.
CELLS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


# What placed rows tell: their split, and the rows of it behind them.
SPLIT, REST = "_split", "_rest"
# Of stored tables, which are texts for the most part.
TEXT_CODEC = "zstd"
# Of buckets, whose rows have lost their neighbours: texts are compressed in longer pages.
BUCKET_PAGES = {
    "parquet.page.size": 8 << 20, "parquet.page.row.count.limit": 1 << 20, "parquet.compression.codec.zstd.level": 6
}
# A sentence that is null; an empty one is a pair of quotes.
NULL_SENTENCE = "\u0000"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def with_row_key(scan: DataFrame, name: str = "row_key") -> DataFrame:
    """A unique key for the rows of a parquet table that has none: file and row number.

    ``scan`` has to come straight from the reader.
    """
    metadata = F.col("_metadata")
    key = F.concat_ws("#", metadata["file_path"], metadata["row_index"].cast("string"))
    return scan.select("*", key.alias(name))


def read_splits(spark: SparkSession, path: str, split: str = "") -> DataFrame:
    """A split dictionary, or one of its splits; the filter prunes whole directories."""
    stored = spark.read.parquet(path)
    return stored.where(F.col("split") == split) if split else stored


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists", whole: bool = True) -> None:
    """One directory per split, so a reader of one split never lists the others.

    A table that is not ``whole`` yet has no mark of success.
    """
    options = {"compression": TEXT_CODEC, "mapreduce.fileoutputcommitter.marksuccessfuljobs": whole}
    with shuffles_dropped(df.sparkSession):
        df.write.mode(mode).partitionBy("split").options(**options).parquet(path)


def stored_splits(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut of its lineage."""
    path = scratch_path(df.sparkSession, label)
    write_splits(df, path)
    return read_splits(df.sparkSession, path)


def write_bucketed(
    df: DataFrame, table: str, keys: list[str], buckets: int, path: str | None = None, dealt: bool = False
) -> DataFrame:
    """A table in buckets of ``keys``, a sorted file for each bucket and split, and read back.

    Tables with the same keys and number of buckets meet without a shuffle. A null key is an
    error. Choose so many buckets that one of the largest table fits into a task. Rows that come
    from such a table, one by one, are ``dealt`` already, and written where they are read.
    """
    missing = F.raise_error(F.lit(f"a null key in the table {table}"))
    quoted = {name: F.coalesce(F.col(f"`{name}`"), missing) for name in keys}
    rows = df.withColumns(quoted)
    if not dealt:
        # Dealt out as the buckets are, so that each is written by one task.
        rows = rows.repartition(buckets, *[F.col(f"`{name}`") for name in keys])
    writer = rows.write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    writer = writer.options(compression=TEXT_CODEC, **BUCKET_PAGES)
    if "split" in df.columns and "split" not in keys:
        writer = writer.partitionBy("split")
    if path:
        writer = writer.option("path", path)
    with shuffles_dropped(df.sparkSession):
        writer.saveAsTable(table)
    return df.sparkSession.table(table)


def read_language_pair(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """A bilingual corpus ``id, translation`` of which only two languages are wanted."""
    stored = spark.read.parquet(path)
    # A language that a row lacks stays missing, for who flattens it strictly.
    pair = F.map_filter("translation", lambda language, _: language.isin(source, target))
    return stored.select("id", pair.alias("translation"))


def _parsed(records: DataFrame, schema: str | StructType, **options) -> DataFrame:
    """The columns of records; ``multiLine`` keeps the line breaks of cells as they are."""
    settings = {**CELLS, "multiLine": True, **options}
    text = {name: str(value).lower() if isinstance(value, bool) else value for name, value in settings.items()}
    told = schema if isinstance(schema, str) else schema.toDDL()
    return records.select(F.from_csv("value", told, text).alias("cells")).select("cells.*")


def read_csv(
    spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True
) -> DataFrame:
    """CSV with a header and doubled quotes; without ``schema`` all columns are strings.

    Files are split among tasks. With ``multi_line`` cells may hold line breaks, and the files
    are read three times for that; without, every line break ends a row.
    """
    reader = spark.read.options(header=True, **CELLS)
    if not multi_line:
        return (reader.schema(schema) if schema else reader).csv(path)
    # The names come from the first record of a file.
    told = schema or reader.options(multiLine=True).csv(path).schema
    return _parsed(read_records(spark, path).where("record > 1"), told)


def read_sentences(
    spark: SparkSession, path: str, column: str = "English", multi_line: bool = False
) -> DataFrame:
    """One text column, tab separated, no header.

    Sentences with line breaks need ``multi_line``. Files are split among tasks.
    """
    options = {"sep": "\t", "nullValue": NULL_SENTENCE}
    schema = f"`{column}` STRING"
    if multi_line:
        return _parsed(read_records(spark, path), schema, **options)
    return spark.read.schema(schema).options(lineSep="\n", **options, **CELLS).csv(path)


def write_sentences(df: DataFrame, path: str) -> None:
    """One sentence per row; empty ones and those with line breaks are quoted."""
    df.write.options(sep="\t", nullValue=NULL_SENTENCE, **CELLS).csv(path)


def write_csv(df: DataFrame, path: str, index_by: list[str] | None = None) -> None:
    """CSV with a header; ``index_by`` adds the unnamed running-number column in that order."""
    if index_by:
        numbered = with_row_index(df, *index_by, name="_c0")
        df = numbered.select(
            F.col("_c0").alias(""), *[F.col(f"`{name}`") for name in df.columns]
        )
    df.write.options(header=True, emptyValue="", **CELLS).csv(path)


def number_in_file_order(
    scan: DataFrame, name: str = "line_no", whole: Column | None = None, placed: bool = False
) -> DataFrame:
    """Adds ``file`` and the 0-based position of each row inside its file.

    ``scan`` has to come straight from a file reader. The rows of a file split are
    read in order by one task, so only the number of rows in the earlier splits of
    the same file is missing; that is a table with one row per split, which goes to the lines,
    so that these are not dealt out. ``whole`` is an
    expression of the path in ``file``: files that agree in it are parts of one, in the order of
    their names. ``placed`` keeps two columns that tell where a row was read: ``SPLIT``, a number
    of its split that grows within a file, and ``REST``, how many rows of the split follow.
    """
    rows = scan.select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    if whole is not None:
        rows = rows.withColumn("file", whole)
    earlier = (
        Window.partitionBy("file")
        .orderBy("_part", "_block")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    blocks = (
        rows.groupBy("file", "_part", "_block")
        .agg(F.min("_seq").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows"))
    )
    at = F.col("_seq") - F.col("_first")
    # A split has a row, so the rows before it are a number of its own.
    told = {name: F.col("_before") + at} | ({SPLIT: F.col("_before"), REST: F.col("_rows") - at - 1} if placed else {})
    return (
        rows.join(F.broadcast(blocks), ["file", "_part", "_block"])
        .withColumns(told)
        .drop("_part", "_block", "_seq", "_first", "_before", "_rows")
    )


def with_row_index(df: DataFrame, *order_by: str, name: str = "row_index") -> DataFrame:
    """0-based position of each row in the global order of ``order_by``.

    The sorted rows are written to the shared folder, one file per range of the
    sort. Positions are then row number in the file plus the size of the files
    before it, which does not change when a task is repeated. Rows with equal keys
    are ordered by content, and equal rows by the partition they come from, so the sort
    can cut between them however many there are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "row-index")
    # By content and not by position: a repeated task may see its rows in another order.
    content = F.xxhash64(*[f"`{column}`" for column in df.columns])
    with shuffles_dropped(spark):
        df.orderBy(*order_by, content, F.spark_partition_id()).write.parquet(path)
    return in_written_order(spark, path, name)


def in_written_order(spark: SparkSession, path: str, name: str = "row_index") -> DataFrame:
    """A table that was written sorted, with the 0-based position of each row in it."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    placed = spark.read.parquet(path).select(
        "*",
        part.alias("_part"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_row"),
    )
    # One row per written file, that is per shuffle partition: bounded by the session.
    earlier = Window.orderBy("_part", "_file").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    files = (
        placed.groupBy("_part", "_file")
        .agg(F.count("*").alias("_rows"))
        .select("_file", (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_before"))
    )
    return (
        placed.join(F.broadcast(files), "_file")
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_part", "_file", "_row", "_before")
    )


def read_log_lines(
    spark: SparkSession, path: str, log: Column | None = None, placed: bool = False
) -> DataFrame:
    """``file, line_no, value`` of every log matching a glob, in exact line order.

    A log may be kept in parts, as rotated ones are: ``log`` is an expression of the path in
    ``file`` that names it, and its parts follow each other by their file names. Lines that are
    ``placed`` tell where they were read, so that they need not be shuffled to be numbered.
    """
    lines = number_in_file_order(spark.read.option("lineSep", "\n").text(path), whole=log, placed=placed)
    return lines.select("file", "line_no", "value", *[SPLIT, REST][: 2 * placed])


def write_log_lines(
    lines: DataFrame, path: str, parts: int | None = None, dealt: bool = False, compression: str | None = None
) -> None:
    """Logs ``file, line_no, value`` as a folder each, ``log=<file>``, of ordered part files.

    Lines are written in ranges of their order, so a long log is the work of several tasks. Lines
    that come in such ranges are ``dealt`` already, and sorted where they are. A compressed part
    is read by one task.
    """
    ranges = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named_logs = lines.select(F.col("file").alias("log"), "line_no", "value")
    if not dealt:
        named_logs = named_logs.repartitionByRange(ranges, "log", "line_no")
    writer = named_logs.sortWithinPartitions("log", "line_no").select("log", "value").write.partitionBy("log")
    with shuffles_dropped(lines.sparkSession):
        writer.text(path, compression=compression)


def written_log(path: Column) -> Column:
    """The log that a file of ``write_log_lines`` is a part of."""
    return F.regexp_extract(path, r"log=([^/]*)/", 1)
