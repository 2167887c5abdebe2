"""Counts, means, metrics and profiles of corpora and scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions import bleu
from tandemtext.functions.text import named, words
from tandemtext.operators.corpus import good_pair
from tandemtext.operators.ordering import first_rows


def clean_report(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows before and after cleaning, from one pass."""
    return df.agg(
        F.count("*").alias("raw_rows"),
        F.count_if(good_pair(source, target)).alias("clean_rows"),
    )


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"))


def mean_scores(df: DataFrame, models: Sequence[str], key: str = "score") -> DataFrame:
    """``split, model, mean_score``; a missing score is an error, not a smaller count.

    The rows are aggregated wide, and only the means are turned into rows.
    """
    means = []
    for name in models:
        column = named(f"{name}_{key}")
        missing = F.raise_error(F.lit(f"{name} has rows without a score"))
        means.append(
            F.when(F.count(column) == F.count("*"), F.avg(column)).otherwise(missing).alias(name)
        )
    wide = df.groupBy("split").agg(*means)
    return wide.unpivot("split", [named(name) for name in models], "model", "mean_score")


def mean_of_first(df: DataFrame, value: str, *order_by: Column | str, k: int = 10) -> DataFrame:
    """Rounded mean over the first ``k`` rows of an order."""
    head = first_rows(df, *order_by, n=k)
    return head.agg(
        F.count("*").alias("rows"), bleu.rounded(F.avg(named(value))).alias("mean_score")
    )


def corpus_metric(
    df: DataFrame,
    prediction: str,
    reference: str,
    metric: str = "sacrebleu",
    keys: Sequence[str] = ("score",),
    groups: Sequence[str] = (),
) -> DataFrame:
    """Metric of all pairs together, per group: summed statistics, one closing formula.

    A pair without a prediction or reference is an error, as in ``mean_scores``.
    """
    stats = bleu.statistics(named(prediction), named(reference))
    total = (
        df.select(*map(named, groups), stats.alias("_stats"))
        .groupBy(*map(named, groups))
        .agg(
            F.when(F.count("_stats") == F.count("*"), bleu.summed(F.col("_stats")))
            .otherwise(F.raise_error(F.lit("a pair lacks its prediction or reference")))
            .alias("_stats")
        )
    )
    return total.select(*map(named, groups), *bleu.metric_columns(metric, F.col("_stats"), keys))


def column_profile(df: DataFrame, distinct: bool = False) -> DataFrame:
    """``column, type, non_null`` and, if asked for, ``distinct_values``.

    Distinct values are counted by digest in two steps, so that a column in which
    one value fills most rows is combined before it is shuffled.
    """
    types = {name: kind for name, kind in df.dtypes}
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    if not distinct:
        wide = df.agg(*[F.count(named(name)).alias(name) for name in df.columns])
        long = wide.unpivot([], [named(name) for name in df.columns], "column", "non_null")
        return long.select("column", kinds[F.col("column")].alias("type"), "non_null")
    digests = df.select([F.md5(named(name).cast("string")).alias(name) for name in df.columns])
    long = digests.unpivot([], [named(name) for name in df.columns], "column", "digest")
    values = long.groupBy("column", "digest").agg(F.count("digest").alias("rows"))
    counted = values.groupBy("column").agg(
        F.sum("rows").alias("non_null"), F.count("digest").alias("distinct_values")
    )
    # Every column has a row, of an empty table too.
    listed = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(name) for name in df.columns])).alias("column")
    )
    return listed.join(counted, "column", "left").select(
        "column",
        kinds[F.col("column")].alias("type"),
        F.coalesce("non_null", F.lit(0)).alias("non_null"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
    )


def mean_prompt_length(df: DataFrame, source: str, target: str, prompt: str) -> DataFrame:
    """Mean of twice the target words, the source words and the characters of the prompt."""
    length = (
        2 * F.size(words(named(target))) + F.size(words(named(source))) + F.lit(len(prompt))
    )
    return df.agg(F.avg(length).alias("mean_length"))


def transposed_row(df: DataFrame, *order_by: str) -> DataFrame:
    """``NAME: value`` of the first row, one output row per column."""
    head = df.orderBy(*order_by).limit(1)
    texts = head.select([named(name).cast("string").alias(name) for name in df.columns])
    long = texts.unpivot([], [named(name) for name in df.columns], "name", "value")
    value = F.coalesce(F.col("value"), F.lit("nan"))
    return long.select(F.concat(F.upper("name"), F.lit(": "), value).alias("line"))


def run_record(
    run_id: str, stage: str, before: DataFrame, after: DataFrame, key_column: str = "split"
) -> DataFrame:
    """One row per split of a finished stage, to be appended to the run report."""
    rows_in = before.agg(F.count("*").alias("rows_in"))
    columns = ", ".join(after.columns)
    counted = after.groupBy(F.col(key_column).alias("split")).agg(F.count("*").alias("rows_out"))
    return counted.select(
        F.lit(run_id).alias("run_id"),
        F.lit(stage).alias("stage"),
        "split",
        F.lit(rows_in.scalar()).alias("rows_in"),
        "rows_out",
        F.lit(columns).alias("columns"),
        F.current_timestamp().alias("at"),
    )


RUN_RECORD = "split string, rows_in bigint, rows_out bigint, columns string, at timestamp, run_id string, stage string"


def append_run_record(record: DataFrame, path: str) -> None:
    """Adds the rows of a run and stage; those of an earlier try of the same are replaced.

    A run and stage is a folder, and only the folders that ``record`` has rows for are written
    anew, so a stage that is repeated leaves one set of rows.
    """
    rows = record.select("split", "rows_in", "rows_out", "columns", "at", "run_id", "stage").coalesce(1)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id", "stage").parquet(path)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the report, ids as they were told (not as numbers that they look like)."""
    stored = spark.read.schema(RUN_RECORD).parquet(path)
    return stored.select("run_id", "stage", "split", "rows_in", "rows_out", "columns", "at")
