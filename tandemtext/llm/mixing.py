"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source takes the documents whose hash lies below a
threshold; a larger budget has a larger threshold, so smaller mixes are nested in larger
ones. The threshold is found without sorting: words are summed by source and hash bucket,
the bucket in which the running sum meets the budget is cut into finer buckets, and so on
until the hash has no more digits. All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions.text import named
from tandemtext.llm.stored import stored

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 13  # hexadecimal digits of the hash: 52 bits
LEVEL_BITS = 13
LEVELS = 4
SALTS = 64


def word_count(text: Column) -> Column:
    """Words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column, seed: str) -> Column:
    """52 bits of the md5 of seed and key; a null key is hashed as the empty text."""
    seeded = F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(seeded), 1, DIGITS), 16, 10).cast("long")


def with_plan(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """The documents with the row of their source.

    One source may have most of the documents: they meet copies of the row, by their hash.
    """
    salted = plan.withColumnRenamed("source", "of").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    return sized.join(
        salted,
        sized["source"].eqNullSafe(salted["of"]) & (F.pmod(sized["hash"], F.lit(SALTS)) == salted["salt"]),
    ).drop("of", "salt")


def source_targets(
    sizes: DataFrame, source: str, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """Targets of the sources: shares by weight, none above ``most`` times the source's size.

    ``sizes`` has one row for each source. Sources take the weights in order of code points,
    null last, over and over. What a full source can't take goes to the others by weight.
    Sources fill up in order of size to weight: the first that its share doesn't fill, and
    all behind it, get the same words for each unit of weight.
    """
    rank = Window.orderBy(F.asc_nulls_last(source))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"),
    )
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last(source))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))})
        .withColumns(
            {
                "budget": F.sum("source_size").over(everything) * F.lit(float(share)),
                "weights": F.sum("weight").over(everything),
            }
        )
        .withColumns({"level": level, "place": F.row_number().over(order)})
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn(
            "level", F.min(F.when(F.col("free"), F.struct("place", "level"))).over(everything)["level"]
        )
        .withColumn(
            "target",
            F.when(F.col("level").isNull(), F.col("cap")).otherwise(
                F.least("cap", F.col("level") * F.col("weight"))
            ),
        )
        .select(source, "source_size", "target")
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash below which the documents of each source meet its budget.

    ``sized`` has ``source``, ``hash`` and ``size``, ``budgets`` has ``source`` and
    ``budget``. The documents that share the last hash are taken if that brings the sum
    nearer to the budget. A source whose documents all fit gets a threshold above every hash.
    """
    # low: the hash at which the open bucket begins; before: words below it.
    state = budgets.withColumns({"low": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for level in range(1, LEVELS + 1):
        width = 1 << (DIGITS * 4 - LEVEL_BITS * level)
        # The width of the bucket that the level before left open.
        above = width << LEVEL_BITS
        inside = with_plan(sized, state).filter(
            (F.col("hash") >= F.col("low")) & (F.col("hash") < F.col("low") + F.lit(above))
        )
        buckets = (
            inside.withColumn("at", F.col("hash") - F.pmod(F.col("hash"), F.lit(width)))
            .groupBy("source", "at")
            .agg(
                F.sum("size").alias("words"),
                F.first("budget").alias("budget"),
                F.first("before").alias("before"),
            )
        )
        running = Window.partitionBy("source").orderBy("at")
        summed = buckets.withColumn("upto", F.col("before") + F.sum("words").over(running))
        met = (
            summed.filter(F.col("upto") > F.col("budget"))
            .groupBy("source")
            .agg(F.min(F.struct("at", (F.col("upto") - F.col("words")).alias("before"), "words")).alias("met"))
        )
        found = met.withColumnRenamed("source", "of")
        state = stored(
            state.join(found, state["source"].eqNullSafe(found["of"]), "left").select(
                "source",
                "budget",
                F.coalesce("met.at", F.lit(1 << (DIGITS * 4))).cast("long").alias("low"),
                F.coalesce("met.before", "before").alias("before"),
                F.col("met.words").alias("words"),
            ),
            "open-buckets",
        )
    nearer = 2 * (F.col("budget") - F.col("before")) >= F.col("words")
    return state.select("source", (F.col("low") + F.when(nearer, 1).otherwise(0)).alias("threshold"))


def sizes_and_hashes(
    docs: DataFrame, id_column: str, text_column: str, source_column: str, seed: str, *more: Column
) -> DataFrame:
    """id, source, size and hash of each document, and ``more`` columns."""
    key = F.concat_ws("|", F.col(id_column).cast("string"), F.length(text_column).cast("string"))
    return docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        hash_of(key, seed).alias("hash"),
        *more,
    )


def mix_plan(sized: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """For each source its size, target, how often it is taken whole, and the hash threshold."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    targets = stored(
        source_targets(sizes, "source", weights, share, most).withColumn("whole", F.coalesce(whole, F.lit(0))),
        "targets",
    )
    budgets = targets.select(
        "source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")
    )
    limits = thresholds(sized, budgets).withColumnRenamed("source", "of")
    return targets.join(limits, targets["source"].eqNullSafe(limits["of"])).select(
        "source", "source_size", "target", "whole", "threshold"
    )


def copies() -> Column:
    taken_once_more = F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return (F.col("whole") + taken_once_more).cast("long")


def mix_sources(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    Returns the id, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``
    (size times copies), one row for each input row. Every document of a source is taken as
    often as its target holds the source, and those below the threshold once more. A null
    text has size 0; null sources are one source. Rows with the same id and text length share
    a hash, and so are taken or left together.
    """
    sized = stored(sizes_and_hashes(docs, id_column, text_column, source_column, seed), "sizes")
    return with_plan(sized, mix_plan(sized, weights, share, most)).select(
        F.col("id").alias(id_column),
        F.col("source").alias(source_column),
        "size",
        "source_size",
        "target",
        copies().alias("copies"),
        (F.col("size") * copies()).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    most: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """The documents that a mix takes: ``row`` with all columns of the input, and ``copies``.

    As ``mix_sources``, without the documents that are not taken.
    """
    sized = stored(sizes_and_hashes(docs, id_column, text_column, source_column, seed), "sizes")
    plan = mix_plan(sized, weights, share, most)
    whole = F.struct(*map(named, docs.columns)).alias("row")
    carried = sizes_and_hashes(docs, id_column, text_column, source_column, seed, whole)
    return with_plan(carried, plan).select("row", copies().alias("copies")).filter("copies > 0")
