"""Joining the outputs of several models."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.text import named

# Begins the names of columns that only the joins see.
DIGEST = "_digest_of|"


def _stored_join(left: DataFrame, right: DataFrame, meet_on: Sequence[str]) -> DataFrame:
    """As ``_natural_join``, with ``meet_on`` as the only keys rows are brought together by."""
    shared = [name for name in left.columns if name in right.columns]
    if missing := [name for name in meet_on if name not in shared]:
        raise ValueError(f"the tables don't share {missing}")
    keys = {name: f"_key_{i}" for i, name in enumerate(shared)}
    renamed = right.select(*[named(c).alias(keys.get(c, c)) for c in right.columns])

    def equal(name: str) -> Column:
        a, b = named(name), named(keys[name])
        if name in meet_on:
            return a == b
        # Not written with =, which would make it a key of the join.
        return F.coalesce((a >= b) & (a <= b), a.isNull() & b.isNull())

    return left.join(renamed, reduce(lambda a, b: a & b, map(equal, shared))).drop(*keys.values())


def _natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    own = [name for name in left.columns if not name.startswith(DIGEST)]
    shared = [name for name in own if name in right.columns]
    if not shared:
        raise ValueError("the tables share no column to merge on")
    # Strings meet by a digest of 256 bits, over their lengths and bytes: no two texts are known
    # to have the same, so the right table's texts need not travel to be compared. A digest stays
    # for the next join on the same columns.
    kinds = [dict(left.dtypes), dict(right.dtypes)]
    strings = [name for name in shared if all(kind[name] == "string" for kind in kinds)]
    others = [name for name in shared if name not in strings]
    keys = {name: f"_key_{i}" for i, name in enumerate(others)}
    parts = [F.coalesce(F.octet_length(named(name)).cast("string"), F.lit("null")) for name in strings]
    told = F.concat(F.concat_ws(",", *parts), F.lit(":"), *[F.coalesce(named(name), F.lit("")) for name in strings])
    digest = F.unhex(F.sha2(told, 256)) if strings else F.lit(0)
    kept = DIGEST + "|".join(strings)
    if kept not in left.columns:
        left = left.withColumn(kept, digest)
    beside = [name for name in right.columns if name not in strings]
    renamed = right.select(*[named(c).alias(keys.get(c, c)) for c in beside], digest.alias("_right_digest"))
    same = [named(name).eqNullSafe(named(key)) for name, key in keys.items()]
    met = reduce(lambda a, b: a & b, same, named(kept) == F.col("_right_digest"))
    return left.join(renamed, met, "inner").drop(*keys.values(), "_right_digest")


def natural_merge(frames: Sequence[DataFrame], meet_on: Sequence[str] = ()) -> DataFrame:
    """Inner join on every column the tables share, from left to right.

    The shared columns are found again after each join. Nulls match nulls, and
    duplicate keys multiply. ``meet_on`` names columns that all tables share and that are never
    null: rows meet by them alone, and the other shared columns are compared behind it. Tables
    of ``write_bucketed`` on the same columns are then joined as they are stored, any number of
    them without a shuffle.
    """
    if meet_on:
        return reduce(lambda a, b: _stored_join(a, b, meet_on), frames)
    merged = reduce(_natural_join, frames)
    return merged.select([named(c) for c in merged.columns if not c.startswith(DIGEST)])


def in_steps(frames: Sequence[DataFrame], steps: int) -> list[list[DataFrame]]:
    """The tables cut into ``steps`` by a hash of the strings that all of them share.

    Rows of different steps never meet, so the merges of the steps are together the merge of the
    tables. Tables that share no string are one step.
    """
    kinds = [dict(frame.dtypes) for frame in frames]
    shared = [named(c) for c in frames[0].columns if all(kind.get(c) == "string" for kind in kinds)]
    if steps < 2 or not shared:
        return [list(frames)]
    step = F.pmod(F.xxhash64(*shared), F.lit(steps))
    return [[frame.where(step == n) for frame in frames] for n in range(steps)]


def attach_columns(
    df: DataFrame, long: DataFrame, index: str, names: str, values: str, columns: Sequence[str]
) -> DataFrame:
    """Puts the values of ``long`` beside the rows of ``df`` with the same index.

    ``columns`` are the values of ``names`` that become columns, in that order.
    """
    wide = long.groupBy(index).pivot(names, list(columns)).agg(F.first(values))
    return df.join(wide, index, "left")


def long_form(df: DataFrame, models: Sequence[str], key: str = "score") -> DataFrame:
    """One row per candidate: ``model, candidate, <key>`` in place of the model columns."""
    entries = [
        F.struct(
            F.lit(model).alias("model"),
            named(model).alias("candidate"),
            named(f"{model}_{key}").alias(key),
        )
        for model in models
    ]
    wide = {name for model in models for name in (model, f"{model}_{key}")}
    kept = [named(name) for name in df.columns if name not in wide]
    return df.select(*kept, F.inline(F.array(*entries)))
