"""Candidate columns from injected functions, and their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from tandemtext.functions import bleu
from tandemtext.functions.text import named, prompt
from tandemtext.session import path_exists, scratch_path

Translator = Callable[[pd.Series], pd.Series]


def batched_column(
    text: Column, load: Callable[[], Translator], batch_size: int | None = None
) -> Column:
    """A string column computed batch by batch.

    ``load`` runs once per task and returns the function to apply, which is where a
    model is read. ``batch_size`` bounds what one call sees; without it a call sees
    an Arrow batch. The column counts as nondeterministic, so that no filter on it
    makes the optimizer call the model twice: filter the rows first.
    """

    @F.pandas_udf("string")
    def translate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pandas

        run = load()
        for batch in batches:
            size = batch_size or max(len(batch), 1)
            pieces = [run(batch.iloc[i:i + size]) for i in range(0, len(batch), size)]
            yield pandas.concat(pieces) if pieces else batch

    return translate.asNondeterministic()(text)


def with_candidates(
    df: DataFrame,
    source: str,
    models: Mapping[str, Callable[[], Translator]],
    task: str | None = None,
    batch_size: int | None = None,
) -> DataFrame:
    """One candidate column per model, named after it; ``task`` prefixes the input.

    A task runs all models in one worker, which reads each text once: the memory of the workers
    does not grow with the number of models. As in ``batched_column``, no filter calls them twice.
    """
    if not models:
        return df
    text = named(source) if task is None else prompt(task, named(source))
    loads = list(models.values())
    # Fields by number, as models may have any name.
    fields = [f"m{i}" for i in range(len(loads))]

    @F.pandas_udf(", ".join(f"{field} string" for field in fields))
    def translate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pandas

        runs = [load() for load in loads]
        for batch in batches:
            size = batch_size or max(len(batch), 1)
            pieces = [batch.iloc[i:i + size] for i in range(0, len(batch), size)]
            told = [
                pandas.concat([run(piece) for piece in pieces], ignore_index=True) if pieces else batch
                for run in runs
            ]
            yield pandas.DataFrame(dict(zip(fields, told)), columns=fields, dtype=object)

    told = df.select("*", translate.asNondeterministic()(text).alias("_candidates"))
    return told.select(
        *map(named, df.columns), *[F.col("_candidates")[field].alias(name) for field, name in zip(fields, models)]
    )


def with_scores(
    df: DataFrame,
    models: Sequence[str],
    reference: str,
    metric: str = "sacrebleu",
    key: str = "score",
) -> DataFrame:
    """One column ``<model>_<key>`` per candidate column, all from one pass over the rows."""
    counted = df.withColumn(
        "_stats", bleu.statistics_of([named(name) for name in models], named(reference))
    )
    values = [
        bleu.METRICS[metric](F.get("_stats", F.lit(i)))[key].alias(f"{name}_{key}")
        for i, name in enumerate(models)
    ]
    return counted.select(*[named(name) for name in df.columns], *values)


def enrich_rows(
    df: DataFrame,
    name: str,
    load: Callable[[], Callable[[dict], str]],
    columns: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """A column from a function that is called once per row, such as a remote service.

    ``partitions`` sets how many calls run side by side. Only ``columns`` travel to
    the function. A repeated task calls it again for its rows, so store the result.
    """
    wanted = list(columns or df.columns)

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        import pandas

        run = load()
        for batch in batches:
            rows = batch.to_dict("records")
            yield pandas.Series([run(row) for row in rows], dtype=object)

    spread = df.repartition(partitions) if partitions else df
    return spread.withColumn(name, call.asNondeterministic()(F.struct(*[named(c) for c in wanted])))


def _ledger(spark: SparkSession, path: str, key: DataType) -> DataFrame:
    kind = StructType(
        [StructField("key", key), StructField("answer", StringType()), StructField("reason", StringType())]
    )
    return spark.read.schema(kind).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], kind)


def enrich_with_ledger(
    df: DataFrame,
    key: str,
    name: str,
    load: Callable[[], Callable[[dict], str]],
    ledger: str,
    columns: Sequence[str] | None = None,
    steps: int = 8,
) -> DataFrame:
    """As ``enrich_rows``, with every answer kept in a ledger, so that a call is not made twice.

    ``key`` is unique and not null. The ledger is a table of ``key, answer, reason`` at a path.
    Only rows without an answer in it are called, in ``steps`` stretches by a hash of the key; each stretch
    is appended when it is done. A run that is stopped loses the stretch it was in, and
    the next one goes on from there. A call that fails is a row with a reason, and is made
    again by the next run. Returns ``df`` with ``name`` and ``<name>_reason``, one of which is null.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType
    wanted = list(columns or df.columns)

    @F.pandas_udf("answer string, reason string")
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas

        run = load()

        def tried(row: dict) -> tuple[str | None, str | None]:
            try:
                answer = run(row)
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"
            return (answer, None) if answer is not None else (None, "no answer")

        for batch in batches:
            rows = [tried(row) for row in batch.to_dict("records")]
            yield pandas.DataFrame(rows, columns=["answer", "reason"], dtype=object)

    answered = _ledger(spark, ledger, kind).where("answer IS NOT NULL").select(F.col("key").alias("_key"))
    row = F.struct(*[named(c) for c in wanted])
    todo = df.select(named(key).alias("key"), row.alias("row")).join(
        answered, F.col("key") == F.col("_key"), "left_anti"
    )
    # The rows to be called are fixed before the first call, a folder for each stretch.
    path = scratch_path(spark, "calls")
    step = F.pmod(F.xxhash64("key"), F.lit(steps)).cast("int")
    todo.withColumn("step", step).write.partitionBy("step").parquet(path)
    for number in range(steps):
        if not path_exists(spark, f"{path}/step={number}"):
            continue
        part = spark.read.schema(todo.schema).parquet(f"{path}/step={number}")
        told = part.select("key", call.asNondeterministic()(F.col("row")).alias("told"))
        told.select("key", "told.*").write.mode("append").parquet(ledger)
    # Several tries of a key: any answer counts, else the reason of one of them.
    tries = _ledger(spark, ledger, kind).groupBy(F.col("key").alias("_key")).agg(
        F.max("answer").alias("_answer"), F.max("reason").alias("_reason")
    )
    return df.join(tries, named(key) == F.col("_key"), "left").select(
        *map(named, df.columns),
        F.col("_answer").alias(name),
        F.when(F.col("_answer").isNull(), F.col("_reason")).alias(f"{name}_reason"),
    )
