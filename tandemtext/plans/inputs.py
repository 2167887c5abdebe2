"""Parallel corpora, candidate translations and run logs, derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.operators.corpus import quality_filter, union_corpora
from tandemtext.operators.logs import RUN_MARKER
from tandemtext.plans.jobs import build_corpus, score_models
from tandemtext.sources.files import read_table, stored_splits

TASK = "English to Spanish"
# Line numbers of a run: more than a document can have lines.
RUN_LINES = 1 << 32


def spread(table: DataFrame, *key: str, partitions: int | None = None) -> DataFrame:
    """The rows dealt out by a key, to as many tasks as a shuffle has or as asked for.

    What is derived from a text is many times its size and is scored by models; a file
    of one row group would leave all of that to one task.
    """
    tasks = partitions or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(tasks, *key)


def spread_documents(
    spark: SparkSession, folder: str, partitions: int | None = None, ordered: bool = False
) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    if ordered:
        tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        return docs.repartitionByRange(tasks, "lang", "doc_id")
    return spread(docs, "doc_id", partitions=partitions)


def line_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of a document with the line after it."""
    docs = spread_documents(spark, folder)
    lines = docs.select(
        "doc_id", "lang", "source", F.split("text", "\n").alias("l")
    )
    count = F.size("l") - 1
    pairs = F.arrays_zip(
        F.slice("l", F.lit(1), count).alias("en"), F.slice("l", F.lit(2), count).alias("es")
    )
    exploded = lines.select(
        "doc_id", "lang", "source", F.posexplode(pairs).alias("pos", "pair")
    )
    return exploded.select(
        F.concat_ws("-", "doc_id", "pos").alias("id"),
        "doc_id", "lang", "source", "pos",
        F.col("pair")["en"].alias("en"),
        F.col("pair")["es"].alias("es"),
    )


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    turns = read_table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("en"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("es")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id", "turn", "en", "es"
    )


def as_translations(pairs: DataFrame) -> DataFrame:
    """``id, translation`` as bilingual corpora are stored."""
    both = F.create_map(F.lit("en"), F.col("en"), F.lit("es"), F.col("es"))
    return pairs.select("id", both.alias("translation"))


def raw_corpora(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "lines": as_translations(line_pairs(spark, folder)),
        "turns": as_translations(turn_pairs(spark, folder)),
    }


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return union_corpora(raw_corpora(spark, folder), "en", "es")


def clean_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return quality_filter(pairs(spark, folder), "en", "es")


def split_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return build_corpus(raw_corpora(spark, folder), "en", "es")


MODELS = ["echo-lower", "drop-third.v1", "words-reversed"]
SCORES = [f"{name}_score" for name in MODELS]


def stand_in_models() -> dict[str, Callable[[], Callable[[pd.Series], pd.Series]]]:
    """Stand-ins for translation models: each garbles the reference in its own way.

    All functions are nested, so they travel to the executors with the plan.
    """

    def lower_cased():
        return lambda texts: texts.str.lower()

    def third_words_dropped():
        def drop(text):
            return " ".join(word for i, word in enumerate(text.split(" "), 1) if i % 3)

        return lambda texts: texts.map(drop)

    def words_reversed():
        return lambda texts: texts.map(lambda text: " ".join(reversed(text.split(" "))))

    return dict(zip(MODELS, (lower_cased, third_words_dropped, words_reversed)))


def stored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The split pairs as the next job finds them: written once, read by split."""
    return stored_splits(split_pairs(spark, folder), "pairs")


def scored_pairs(
    spark: SparkSession, folder: str, pairs: DataFrame | None = None, stored: bool = True
) -> DataFrame:
    """The pairs, read once, with the candidate and the score of every stand-in.

    They are stored, as what follows reads scores and candidates many times and the models run
    once. Who reads them once asks for them as they come, not ``stored``.
    """
    pairs = split_pairs(spark, folder) if pairs is None else pairs
    scored = score_models(pairs, stand_in_models(), "es", "es")
    return stored_splits(scored, "scored") if stored else scored


def log_lines(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """Run logs ``file, line_no, value``: one file per language, one run per document.

    A run has a marker, settings, one of them told twice, two evaluations, and a sample block for each line
    of the document, of which the last line is a continuation without prefix. ``ordered`` deals the documents
    out in ranges of what the lines are ordered by, so that the many times longer lines need not be.
    """
    docs = spread_documents(spark, folder, ordered=ordered)
    runs = docs.withColumn("l", F.split("text", "\n"))
    size = F.length("text").cast("string")
    loss = F.format_string("%d.5", F.col("doc_id"))
    # What a run that diverges may log.
    words = F.array(*[F.lit(word) for word in ("nan", "inf", "-inf", "None", "True")])
    norm = F.get(words, F.pmod("doc_id", F.lit(5)).cast("int"))
    head = F.array(
        F.lit(RUN_MARKER),
        F.concat(F.lit("MODEL: hub/"), F.col("source")),
        F.lit("HYPERPARAMETERS:"),
        F.lit("\tEPOCHS: 9"),
        F.concat(F.lit("\tEPOCHS: 1"), (F.length("source") - 3).cast("string")),
        F.concat(F.lit("\tTRAINING SIZE: "), size),
        F.concat(
            F.lit("PRE-EVALUATION (VALIDATION): {'eval_loss': "), loss,
            F.lit(", 'eval_counts': [1, 2], 'eval_norm': "), norm,
            F.lit(", 'eval_size': "), size, F.lit("}"),
        ),
        F.concat(
            F.lit("POST-EVALUATION (TEST): {'eval_loss': "), loss, F.lit(", 'epoch': 2.0}")
        ),
    )
    count = F.size("l") - 1
    numbered = F.arrays_zip(
        F.slice("l", F.lit(1), count).alias("a"), F.slice("l", F.lit(2), count).alias("b")
    )
    blocks = F.transform(
        F.when(count > 0, numbered).otherwise(F.array().cast("array<struct<a:string,b:string>>")),
        lambda pair, i: F.array(
            F.concat(F.lit("TRANSLATION "), i.cast("string"), F.lit(f' on "{TASK}"')),
            F.concat(F.lit("\tOriginal Text: "), pair["a"]),
            F.concat(F.lit("\tGenerated Translation: "), F.lower(pair["a"])),
            F.concat(F.lit("\tActual Translation: "), pair["b"]),
            pair["a"],
        ),
    )
    messages = F.concat(head, F.flatten(blocks))
    number = F.replace("source", F.lit("src"), F.lit(""))
    lines = runs.select(
        "doc_id", "lang", number.alias("number"), F.posexplode(messages).alias("seq", "message")
    )
    seconds = F.col("doc_id") * 60 + F.col("seq")
    ts = F.timestamp_add(
        "SECOND", seconds, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    ).cast("string")
    prefix = F.concat(F.lit("VERSION 1.1."), "number", F.lit(" : "), ts, F.lit(" : "))
    is_continuation = (F.col("seq") >= 8) & ((F.col("seq") - 8) % 5 == 4)
    return lines.select(
        F.concat(F.lit("finetune-"), F.col("lang"), F.lit(".log")).alias("file"),
        (F.col("doc_id") * RUN_LINES + F.col("seq")).alias("line_no"),
        F.when(is_continuation, F.col("message")).otherwise(F.concat(prefix, "message")).alias("value"),
    )
