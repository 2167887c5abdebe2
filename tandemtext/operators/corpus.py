"""From raw bilingual corpora to clean parallel pairs."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.functions.text import named

MIN_SOURCE_LENGTH = 10


def flatten_translation(
    df: DataFrame, source: str, target: str, name: str | None = None, strict: bool = False
) -> DataFrame:
    """``id, translation`` to ``id, <source>, <target>``.

    ``translation`` is a map or a struct by language. ``name`` qualifies the id by
    its corpus. A language missing from a map gives null, or an error if ``strict``;
    one missing from a struct is always an error.
    """
    translation = F.col("translation")
    is_map = isinstance(df.schema["translation"].dataType, T.MapType)

    def text(language: str) -> Column:
        if not is_map:
            return translation.getField(language)
        if not strict:
            return translation[language]
        missing = F.concat(F.lit(f"no language {language} in row "), F.col("id").cast("string"))
        return F.when(F.map_contains_key(translation, language), translation[language]) \
            .otherwise(F.raise_error(missing))

    key = F.col("id").cast("string")
    return df.select(
        (F.concat(F.lit(f"{name}-"), key) if name else key).alias("id"),
        text(source).alias(source),
        text(target).alias(target),
    )


def union_corpora(corpora: Mapping[str, DataFrame], source: str, target: str) -> DataFrame:
    """All corpora in one table, ids qualified by corpus; duplicates stay."""
    parts = [
        flatten_translation(raw, source, target, name=name) for name, raw in corpora.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def both_strings(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows in which both sides hold a string."""

    def is_string(column: str) -> Column:
        kind = df.schema[column].dataType
        if isinstance(kind, T.StringType):
            return named(column).isNotNull()
        if isinstance(kind, T.VariantType):
            return F.coalesce(F.schema_of_variant(named(column)) == "STRING", F.lit(False))
        return F.lit(False)

    return df.where(is_string(source) & is_string(target))


def good_pair(source: str, target: str, min_length: int = MIN_SOURCE_LENGTH) -> Column:
    """The sides differ and the source has at least ``min_length`` characters."""
    return (named(source) != named(target)) & (F.length(named(source)) >= min_length)


def quality_filter(
    df: DataFrame, source: str, target: str, min_length: int = MIN_SOURCE_LENGTH
) -> DataFrame:
    return df.where(good_pair(source, target, min_length))


def alias_valid_as_test(df: DataFrame) -> DataFrame:
    """Evaluates on the validation rows twice: ``test`` becomes a copy of ``valid``.

    The original test rows are dropped. One scan: each validation row is emitted
    under both names.
    """
    names = F.when(F.col("split") == "valid", F.array(F.lit("test"), F.lit("valid"))).otherwise(
        F.array(F.col("split"))
    )
    kept = df.where(F.col("split").isin("train", "valid"))
    others = [named(name) for name in df.columns if name != "split"]
    return kept.select(*others, F.explode(names).alias("split"))
