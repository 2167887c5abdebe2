"""Subword ids by the ranks of a byte-pair vocabulary that others have trained.

Texts are cut into words by a pattern, the distinct words of a corpus are cut into pieces once
each, and the texts get their ids by looking the words up. So the work on pieces grows
with the vocabulary of the corpus and not with its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.functions.encode import _looked_up
from tandemtext.functions.text import named
from tandemtext.session import scratch_path, shuffles_dropped

# Fixed value: how the byte-level vocabularies cut texts before pieces are merged.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces travel to every task; a larger vocabulary is refused.
MOST_PIECES = 1 << 20


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``piece`` (bytes) and ``id`` of a vocabulary file: a line has the piece in base 64 and its rank."""
    fields = F.split("value", " ")
    lines = spark.read.text(path).where("value != ''")
    return lines.select(F.unbase64(fields[0]).alias("piece"), fields[1].cast("int").alias("id"))


def merger(ranks: Mapping[bytes, int]) -> Callable[[bytes], list[int]]:
    """The function from a word's bytes to its ids.

    Of all neighbours whose union is a piece, those of the least rank merge first, equal ranks
    from the left. Pieces are linked and the unions wait in a heap, so a word of n bytes takes
    n log n steps.
    """

    def merged(word: bytes) -> list[int]:
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        end = list(range(1, n + 1))  # of the piece that begins here
        before = list(range(-1, n - 1))  # where the piece before it begins
        alive = [True] * n

        def union(a: int) -> tuple[int, int, int] | None:
            b = end[a]
            rank = ranks.get(word[a : end[b]]) if b < n else None
            return None if rank is None else (rank, a, end[b])

        waiting = [u for u in map(union, range(n)) if u]
        heapq.heapify(waiting)
        while waiting:
            _, a, stop = heapq.heappop(waiting)
            b = end[a]
            # Gone, grown or joined by another since it was put here.
            if not alive[a] or b >= n or end[b] != stop:
                continue
            alive[b] = False
            end[a] = stop
            if stop < n:
                before[stop] = a
            for again in (before[a], a):
                if again >= 0 and (u := union(again)):
                    heapq.heappush(waiting, u)
        return [ranks[word[a : end[a]]] for a in range(n) if alive[a]]

    return merged


def pieces_of(items: DataFrame, ranks: DataFrame) -> DataFrame:
    """``item, value``: the ids of each distinct word, written once."""
    spark = ranks.sparkSession
    held = ranks.limit(MOST_PIECES + 1).collect()
    if len(held) > MOST_PIECES:
        raise ValueError(f"a vocabulary of more than {MOST_PIECES} pieces")
    table = {bytes(r["piece"]): r["id"] for r in held}
    if missing := [b for b in range(256) if bytes([b]) not in table]:
        raise ValueError(f"a vocabulary without the bytes {missing}")
    cut = merger(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow

        for batch in batches:
            ids = [cut(word.encode()) for word in batch.column(0).to_pylist()]
            yield pyarrow.RecordBatch.from_arrays(
                [batch.column(0), pyarrow.array(ids, pyarrow.list_(pyarrow.int32()))], ["item", "value"]
            )

    path = scratch_path(spark, "pieces")
    with shuffles_dropped(spark):
        items.distinct().mapInArrow(run, "item string, value array<int>").write.parquet(path)
    return spark.read.parquet(path)


def subword_words(text: Column) -> Column:
    """The words pieces are cut from: together they are the text, every sign of it."""
    return F.regexp_extract_all(text, F.lit(f"(?U){WORDS}"), F.lit(0))


def encode_subwords(
    df: DataFrame, texts: Mapping[str, str], ranks: DataFrame, keep: Sequence[str] | None = None
) -> DataFrame:
    """Adds subword ids for each text column of ``texts`` (new name to text column).

    A null text has null ids, an empty one none. Special tokens in a text are ordinary text.
    ``keep`` names the columns that stay, all without it.
    """
    words = {f"_pieces_{name}": subword_words(named(column)) for name, column in texts.items()}
    none = F.array().cast("array<int>")
    found = _looked_up(df, words, "string", lambda items: pieces_of(items, ranks), none, keep)
    return found.select(
        *map(named, df.columns if keep is None else keep), *[F.flatten(named(f"_pieces_{name}")).alias(name) for name in texts]
    )


def decode_subwords(df: DataFrame, ids: Mapping[str, str], ranks: DataFrame) -> DataFrame:
    """Adds the text of each id column of ``ids`` (new name to id column); unknown ids are left out.

    The bytes of all pieces are put together before they are read as UTF-8, as a sign can
    span pieces.
    """
    known = ranks.select(F.col("id").alias("item"), F.hex("piece").alias("value"))
    lists = {f"_bytes_{name}": named(column) for name, column in ids.items()}
    found = _looked_up(df, lists, "int", lambda _: known, F.lit(None).cast("string"))
    text = {name: F.unhex(F.array_join(named(f"_bytes_{name}"), "")).cast("string") for name in ids}
    return found.select(*map(named, df.columns), *[value.alias(name) for name, value in text.items()])
