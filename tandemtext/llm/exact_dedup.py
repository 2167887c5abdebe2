"""Exact deduplication by a distributed sort of contents.

Contents are the texts without white space. Sampled splitters deal them out by range,
each range is sorted externally, equal contents lie side by side and are compared in
full with their neighbour. A splitter is a short start of the content, its hash, the
length and the id, so that it stays small, and so that the copies of one content are
cut into several ranges however many there are. A content that touches the end of its
range may go on in the next one: such contents, two for each range, are combined at the
end in a table of that bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.text import named
from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.session import scratch_path

SPACE = r"[\x20\x09-\x0D]+"
START = 24


def content_table(docs: DataFrame, id_column: str, text_column: str, heads: bool) -> DataFrame:
    """The sorted contents, run by run, written to the shared folder.

    With ``heads`` one row for each run of equal contents, with the input row in ``row``;
    else one row for each input row, with the size of its run. ``open`` marks runs that
    touch an end of their range.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    kept = [F.struct(*map(named, docs.columns)).alias("row")] if heads else []
    prepared = docs.select(
        F.col(id_column).alias("id"),
        F.length(text).cast("long").alias("length"),
        F.regexp_replace(text, SPACE, "").alias("content"),
        *kept,
    ).withColumns(
        {"start": F.substring("content", 1, START), "hash": F.xxhash64("content")}
    )
    longest, first = F.desc("length"), F.asc_nulls_last("id")
    ordered = prepared.repartitionByRange("start", "hash", longest, first).sortWithinPartitions(
        "start", "hash", "content", longest, first
    )
    fields = [
        T.StructField("id", docs.schema[id_column].dataType),
        T.StructField("length", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("open", T.BooleanType()),
        T.StructField("head", T.BooleanType()),
        T.StructField("keep_id", docs.schema[id_column].dataType),
        T.StructField("size", T.LongType()),
    ]
    if heads:
        fields.append(T.StructField("row", T.StructType(docs.schema.fields)))
    schema = T.StructType(fields)

    def table(runs: list[dict], is_open: bool) -> dict[str, list]:
        columns: dict[str, list] = {f.name: [] for f in fields}
        for run in runs:
            digest = hashlib.sha256(run["content"].encode()).hexdigest()
            n = len(run["ids"])
            columns["id"] += run["ids"]
            columns["length"] += run["lengths"]
            columns["digest"] += [digest] * n
            columns["open"] += [is_open] * n
            columns["head"] += [True] + [False] * (n - 1)
            columns["keep_id"] += [run["ids"][0]] * n
            columns["size"] += [run["size"]] * n
            if heads:
                columns["row"] += run["rows"]
        return columns

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first_key, runs, kinds = None, True, [], None
        out: dict[str, list] = {}

        def batch_of(columns: dict[str, list]) -> pa.RecordBatch:
            arrays = []
            for name, values in columns.items():
                if name == "row":
                    arrays.append(pa.concat_arrays(values) if values else pa.array([], kinds["row"]))
                else:
                    arrays.append(pa.array(values, kinds[name]))
            return pa.RecordBatch.from_arrays(arrays, names=list(columns))

        def add(columns: dict[str, list]) -> None:
            for name, values in columns.items():
                out.setdefault(name, []).extend(values)

        for batch in pieces(batches):
            if kinds is None:
                id_kind = batch.schema.field("id").type
                kinds = {
                    "id": id_kind, "length": pa.int64(), "digest": pa.string(), "open": pa.bool_(),
                    "head": pa.bool_(), "keep_id": id_kind, "size": pa.int64(),
                }
                if heads:
                    kinds["row"] = batch.schema.field("row").type
            columns = [batch.column(c).to_pylist() for c in ("id", "length", "content", "start", "hash")]
            for i, (id_, length, content, start, hashed) in enumerate(zip(*columns)):
                if (start, hashed) != key:
                    if runs:
                        add(table(runs, first_key))
                        first_key = False
                    key, runs = (start, hashed), []
                if not runs or runs[-1]["content"] != content:
                    runs.append({"content": content, "ids": [], "lengths": [], "rows": [], "size": 0})
                run = runs[-1]
                run["size"] += 1
                if not heads or run["size"] == 1:
                    run["ids"].append(id_)
                    run["lengths"].append(length)
                    if heads:
                        run["rows"].append(batch.column("row").slice(i, 1))
            if len(out.get("id", ())) >= 2000:
                yield batch_of(out)
                out = {}
        if runs:
            add(table(runs, True))
        if out:
            yield batch_of(out)

    path = scratch_path(spark, "contents")
    in_small_batches(ordered).mapInArrow(of_range, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def open_contents(table: DataFrame) -> DataFrame:
    """One row for each content that touches the end of a range: a few for each range."""
    best = F.struct((-F.col("length")).alias("shorter"), F.col("id").isNull().alias("none"), "id")
    return (
        table.filter(F.col("open") & F.col("head"))
        .groupBy("digest")
        .agg(F.min(best).alias("best"), F.sum("size").alias("all"), F.count("*").alias("heads"))
    )


def find_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with the row of its content that stays: the longest text, then the smallest id.

    Returns the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, one row for each
    input row. A null text counts as empty, and empty or blank texts are copies of each
    other. A null id comes behind all others. Rows that share id and length are alike to the
    rule: only the first of them in the sort stays. Other columns are not looked at.
    """
    table = content_table(docs.select(id_column, text_column), id_column, text_column, False)
    # The size bound is two contents for each range, so it may be broadcast.
    joined = table.join(F.broadcast(open_contents(table)), "digest", "left")
    across = F.col("best").isNotNull() & F.col("open")
    keep = F.when(across, F.col("best.id")).otherwise(F.col("keep_id"))
    # Equal rows in two ranges: the one whose range sums them up stays.
    kept = F.col("head") & (
        ~across | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("length") == -F.col("best.shorter")))
    )
    return joined.select(
        F.col("id").alias(id_column),
        keep.alias("keep_id"),
        F.when(across, F.col("all")).otherwise(F.col("size")).alias("group_size"),
        kept.alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all columns of the input."""
    table = content_table(docs, id_column, text_column, True)
    joined = table.join(F.broadcast(open_contents(table)), "digest", "left")
    across = F.col("best").isNotNull() & F.col("open")
    stays = ~across | (
        F.col("id").eqNullSafe(F.col("best.id")) & (F.col("length") == -F.col("best.shorter"))
    )
    return joined.filter(stays).select("row.*")
