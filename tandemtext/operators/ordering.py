"""Seeded orders, exact cuts through them, splits, samples and previews.

A seeded order sorts by ``md5(seed|key)``, so it depends on the rows alone: not on
partitions, files or repeated tasks. The key has to be unique: a cut that would fall
between rows of the same key is an error. Tables without one get it from
``with_row_key``.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tandemtext.functions.text import named

# Leading hex digits that form a bucket of the order, level by level: 65,536 buckets at most
# at each, so that some rows in four billion are ranked in one task.
BUCKET_DIGITS = (4, 4)
# Sampled keys that part the rows on the way to a position, and rows that are ranked at its end.
SPLITTERS, RANKED_ROWS = 1024, 1 << 14


def order_key(key: str | Sequence[str], seed: int | str | Column = 42) -> Column:
    """Sort key of the seeded order: the hash, then the key itself."""
    names = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws("|", *[F.coalesce(named(n).cast("string"), F.lit("")) for n in names])
    salt = F.concat(seed, F.lit("|")) if isinstance(seed, Column) else F.lit(f"{seed}|")
    return F.concat(F.md5(F.concat(salt, text)), F.lit("|"), text)


def _cut_keys(df: DataFrame, order: Column, cuts: dict[str, Column]) -> Column:
    """The order keys of the rows at the given 1-based ranks, as a struct column.

    ``cuts`` are expressions over ``n``, the row count. Rows are counted per bucket
    of the order, which finds the bucket of every cut; these are cut into finer buckets,
    and only the rows of the last ones are ranked. A cut at rank 0 has no row and is null.
    """
    keyed = df.select(order.alias("_order"))
    ranks = F.array(
        *[
            F.struct(F.lit(name).alias("cut"), rank.cast("bigint").alias("rank"))
            for name, rank in cuts.items()
        ]
    )
    whole = Window.partitionBy()
    so_far = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)

    def at_rank(counted: DataFrame) -> DataFrame:
        """One row per cut: the bucket its rank falls into."""
        inside = (F.col("_upto") - F.col("_rows") < F.col("rank")) & (F.col("rank") <= F.col("_upto"))
        before = (F.col("_upto") - F.col("_rows")).alias("_before")
        return counted.where(inside).select("cut", "rank", F.col("_bucket").alias("_prefix"), before)

    # At most 16 ** digits buckets, which also tell the number of rows.
    known = BUCKET_DIGITS[0]
    first = (
        keyed.groupBy(F.substring("_order", 1, known).alias("_bucket"))
        .agg(F.count("*").alias("_rows"))
        .withColumns({"_upto": F.sum("_rows").over(so_far), "n": F.sum("_rows").over(whole)})
    )
    wanted = at_rank(first.select("_bucket", "_rows", "_upto", F.inline(ranks)))
    for digits in BUCKET_DIGITS[1:]:
        running = Window.partitionBy("cut").orderBy("_bucket").rowsBetween(
            Window.unboundedPreceding, 0
        )
        # At most 16 ** digits buckets of every cut.
        finer = (
            keyed.withColumn("_start", F.substring("_order", 1, known))
            .join(F.broadcast(wanted), F.col("_start") == F.col("_prefix"))
            .groupBy("cut", "rank", "_before", F.substring("_order", 1, known + digits).alias("_bucket"))
            .agg(F.count("*").alias("_rows"))
            .withColumn("_upto", F.col("_before") + F.sum("_rows").over(running))
        )
        known += digits
        wanted = at_rank(finer)
    # Rows with the same key are counted before they meet in one task.
    in_bucket = Window.partitionBy("cut").orderBy("_order").rowsBetween(
        Window.unboundedPreceding, 0
    )
    candidates = (
        keyed.withColumn("_start", F.substring("_order", 1, known))
        .join(F.broadcast(wanted), F.col("_start") == F.col("_prefix"))
        .groupBy("cut", "rank", "_before", "_order")
        .agg(F.count("*").alias("_times"))
        .withColumn("_upto", F.col("_before") + F.sum("_times").over(in_bucket))
    )
    found = candidates.where(
        (F.col("_upto") - F.col("_times") < F.col("rank")) & (F.col("rank") <= F.col("_upto"))
    )
    exact = F.when(F.col("_upto") == F.col("rank"), F.col("_order")).otherwise(
        F.raise_error(F.lit("the key is not unique, so the cut is not exact"))
    )
    return found.agg(
        F.struct(
            *[F.max(F.when(F.col("cut") == name, exact)).alias(name) for name in cuts]
        ).alias("cuts")
    ).scalar()


def _up_to(order: Column, cut: Column) -> Column:
    return F.coalesce(order <= cut, F.lit(False))


def split_sizes(
    n: Column, train_size: float | None = 0.7, test_size: float | None = None
) -> tuple[Column, Column]:
    """Exact sizes of ``train`` and ``test``; ``valid`` is what remains.

    A train fraction is rounded down, a held-out fraction up. The held-out rows are
    halved, and an odd one goes to ``test``.
    """
    if test_size is not None:
        train = n - F.ceil(n * F.lit(float(test_size)))
    else:
        train = F.floor(n * F.lit(float(train_size)))
    return train, F.ceil((n - train) * F.lit(0.5))


def exact_split(
    df: DataFrame,
    key: str | Sequence[str],
    train_size: float | None = 0.7,
    test_size: float | None = None,
    seed: int | str = 42,
    order: str | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Adds ``split``; the sizes are exact for every row count.

    Rows are compared with two cut keys, so they stay where they are: the only
    shuffles are those of the bucket counts and of the buckets at the cuts. ``order``
    names a column of ``df`` that already holds the order key. ``counted`` is a table of
    the same keys, row by row, in which the cuts are found instead of in ``df``.
    """
    order = order_key(key, seed) if order is None else named(order)
    n = F.col("n")
    train, test = split_sizes(n, train_size, test_size)
    cuts = _cut_keys(df if counted is None else counted, order, {"train": train, "test": train + test})
    return df.withColumn(
        "split",
        F.when(_up_to(order, cuts["train"]), "train")
        .when(_up_to(order, cuts["test"]), "test")
        .otherwise("valid"),
    )


def _leading_cut(df: DataFrame, order: Column, fraction: float | Fraction) -> Column:
    part = Fraction(str(fraction))
    end = F.expr(f"(n * {part.numerator}L) div {part.denominator}L")
    return _cut_keys(df, order, {"end": end})["end"]


def is_leading(
    df: DataFrame, key: str | Sequence[str], fraction: float | Fraction, seed: int | str = 42
) -> Column:
    """Whether a row is among the first ``floor(n * fraction)`` of the seeded order.

    The fraction is taken as the decimal it is written as.
    """
    order = order_key(key, seed)
    return _up_to(order, _leading_cut(df, order, fraction))


def leading_key(
    df: DataFrame, key: str | Sequence[str], fraction: float | Fraction, seed: int | str = 42
) -> str | None:
    """The order key of the last of those rows, None if there is none."""
    cut = _leading_cut(df, order_key(key, seed), fraction)
    return df.sparkSession.range(1).select(cut.alias("cut")).first()["cut"]


def seeded_shuffle(
    df: DataFrame, key: str | Sequence[str], seed: int | str = 42, partitions: int | None = None
) -> DataFrame:
    """The rows in the seeded order, partition after partition.

    Hashes are even, so the range of a row is known from the first digits of its own: no
    pass over the data looks for the borders of the ranges, as a sort does. Rows of one key
    share a range. Written out, the files in order are the shuffle.
    """
    ranges = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = order_key(key, seed)
    leading = F.conv(F.substring(order, 1, 8), 16, 10).cast("bigint")
    place = F.call_function("div", leading * ranges, F.lit(1 << 32)).cast("int")
    keyed = df.select("*", order.alias("_order")).repartitionById(ranges, place)
    return keyed.sortWithinPartitions("_order").drop("_order")


def shuffle(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """A different order on every run: the seeded order of a seed drawn now.

    Sorting by ``rand()`` instead could lose rows when a task is repeated.
    """
    return seeded_shuffle(df, key, seed=random.getrandbits(64))


def sample_rows(
    df: DataFrame, key: str | Sequence[str], n: int, seed: int | str = 42
) -> DataFrame:
    """``n`` rows at random, without replacement: the first ones of the seeded order.

    Rows stay where they are, whatever ``n`` is. A cut between rows of one key is an error.
    """
    order = order_key(key, seed)
    cuts = _cut_keys(df, order, {"end": F.least(F.col("n"), F.lit(n))})
    return df.where(_up_to(order, cuts["end"]))


def preview_rows(df: DataFrame, *order_by: Column | str, n: int, inclusive: bool = True) -> DataFrame:
    """The first rows, numbered from 0; ``inclusive`` stops after number ``n``."""
    return first_rows(df, *order_by, n=n + 1 if inclusive else n)


def first_rows(df: DataFrame, *order_by: Column | str, n: int, name: str = "i") -> DataFrame:
    head = df.orderBy(*order_by).limit(n)
    # At most n rows are left to number.
    position = F.row_number().over(Window.orderBy(*order_by)) - 1
    return head.withColumn(name, position.cast("bigint"))


def _ranged(keys: DataFrame, borders: list) -> DataFrame:
    """Adds ``_range``, the range of a key among sorted ``borders``.

    Even ranges lie between two borders, odd ones are the border itself, so that a key with
    any number of rows is a range of its own.
    """
    kind = StructType([StructField("_borders", ArrayType(keys.schema["_key"].dataType))])
    # One row, with a key for each splitter.
    beside = keys.crossJoin(F.broadcast(keys.sparkSession.createDataFrame([(borders,)], kind)))
    array, key, step = F.col("_borders"), F.col("_key"), max(1, math.isqrt(len(borders)))

    def smaller(some: Column) -> Column:
        return F.size(F.filter(some, lambda border: border < key))

    # First among every so many, then among those behind the last of them.
    every = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(borders) // step))), lambda i: array[i * step - 1])
    passed = smaller(every) * step if len(borders) >= step else F.lit(0)
    number = passed + smaller(F.slice(array, passed + 1, F.lit(step)))
    place = number * 2 + F.coalesce(F.get(array, number) == key, F.lit(False)).cast("int")
    return beside.withColumn("_range", place).drop("_borders")


def _keys_at(keys: DataFrame, positions: Sequence[int]) -> dict[int, tuple]:
    """The ``_key`` of the rows at 0-based positions of its order.

    Rows are counted in the ranges between sampled keys; ranges that hold a wanted position
    are sampled again, until those are small enough to be ranked. Every pass reads the keys
    and shuffles counts only. What the driver holds is bounded by the splitters and positions.
    """
    spark, kind = keys.sparkSession, StructType([keys.schema["_key"]])
    asked = sorted({p for p in positions if p >= 0})
    open_keys, edges, seed = keys, [], 0
    while True:
        drawn = open_keys.orderBy(F.rand(seed)).limit(SPLITTERS).select("_key").collect()
        told = spark.createDataFrame([(r["_key"],) for r in drawn] + [(e,) for e in edges], kind)
        borders = [r["_key"] for r in told.distinct().orderBy("_key").collect()]
        ranged = _ranged(keys, borders)
        counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
        found, small, large, before, todo = {}, {}, [], 0, list(asked)
        for number in sorted(counts):
            inside = [p for p in todo if p < before + counts[number]]
            if inside and number % 2:
                found |= {p: borders[number // 2] for p in inside}
            elif inside and counts[number] <= RANKED_ROWS:
                small[number] = before
            elif inside:
                large.append(number)
            todo, before = todo[len(inside) :], before + counts[number]
        if not large:
            break
        edges = [borders[i] for n in (*small, *large) for i in (n // 2 - 1, n // 2) if 0 <= i < len(borders)]
        edges += list(found.values())
        open_keys, seed = ranged.where(F.col("_range").isin(large)).select("_key"), seed + 1
    if small:
        start = F.create_map(*[F.lit(x) for pair in small.items() for x in pair])
        upto = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
        ranked = (
            ranged.where(F.col("_range").isin(list(small)))
            .groupBy("_range", "_key")
            .agg(F.count("*").alias("_rows"))
            .withColumn("_upto", start[F.col("_range")] + F.sum("_rows").over(upto))
        )
        wanted = F.filter(
            F.array(*[F.lit(p).cast("bigint") for p in asked]),
            lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_rows")),
        )
        found |= {r["_at"]: r["_key"] for r in ranked.select("_key", F.explode(wanted).alias("_at")).collect()}
    return found


def rows_at(df: DataFrame, positions: Sequence[int], *order_by: str) -> DataFrame:
    """The rows at the given 0-based positions of an order, with ``row_index``.

    Rows with equal keys come in the order of a hash of their content. Nothing is sorted: keys
    are counted in ranges, and the rows are looked up by the keys found. Keys should be short,
    as some of them are the borders of ranges.
    """
    content = F.xxhash64(*map(named, df.columns))
    keyed = df.withColumn("_key", F.struct(*map(named, order_by), content.alias("_content")))
    found = _keys_at(keyed.select("_key"), positions)
    kind = StructType([StructField("row_index", LongType()), StructField("_of", keyed.schema["_key"].dataType)])
    # One row per position.
    wanted = df.sparkSession.createDataFrame(list(found.items()), kind)
    # Rows that are equal in all columns meet each other's positions too.
    return (
        keyed.join(F.broadcast(wanted), F.col("_key").eqNullSafe(F.col("_of")))
        .select(*map(named, df.columns), "row_index")
        .dropDuplicates(["row_index"])
    )


def sort_by_identity(df: DataFrame, key: str = "id") -> DataFrame:
    return df.orderBy("split", key)
