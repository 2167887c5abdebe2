"""Compression of vectors to codes of their parts, the nearest entries found by Orchard's search.

Each part position has a codebook. For every entry a list of all entries by their distance
from it is kept. A search stands at an entry and walks its list; a nearer entry moves it to
that entry's list, entries seen before are passed over, and it ends where the list is further
away than twice the distance reached (by the triangle inequality nothing behind is nearer).
Everything is in integers, so a code, a tie and an error are exact and alike on any cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tandemtext.functions.text import named
from tandemtext.llm.stored import stored
from tandemtext.llm.vectors import floored, matrix, whole_vectors, with_columns

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
# Components below this keep four times a squared distance, and the sums of 2**36 rows, in 64 bits.
LIMIT = 1 << 27
SALTS = 16


class Orchard:
    """The entries of one codebook with their distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None] - entries[None]) ** 2).sum(2)
        self.lists = np.argsort(apart, axis=1, kind="stable")
        gaps = np.take_along_axis(apart, self.lists, 1)
        # Behind the last of a list nothing is near enough to be looked at.
        end = np.full((len(entries), 1), np.iinfo(np.int64).max)
        self.gaps = np.concatenate([gaps, end], 1)
        self.lists = np.concatenate([self.lists, np.zeros_like(end)], 1)
        self.centre = int(apart.max(1).argmin())
        self.looked = 0  # distances taken so far

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (ties: the lower one) and squared distance of each row of integers."""
        entries, lists, gaps = self.entries, self.lists, self.gaps
        best = np.full(len(points), self.centre)
        least = ((points - entries[self.centre]) ** 2).sum(1)
        seen = np.zeros((len(points), len(entries)), bool)
        seen[:, self.centre] = True
        at = np.zeros(len(points), np.int64)
        walking = np.arange(len(points))
        while len(walking):
            # Squared: further than twice the distance reached.
            walking = walking[gaps[best[walking], at[walking]] <= 4 * least[walking]]
            met = lists[best[walking], at[walking]]
            at[walking] += 1
            fresh = ~seen[walking, met]
            who, met = walking[fresh], met[fresh]
            seen[who, met] = True
            self.looked += len(who)
            distance = ((points[who] - entries[met]) ** 2).sum(1)
            nearer = (distance < least[who]) | ((distance == least[who]) & (met < best[who]))
            who = who[nearer]
            best[who], least[who], at[who] = met[nearer], distance[nearer], 0
        return best, least


@dataclass
class Codebooks:
    """``entries`` of each part position: (parts, entries, width) integers of the scaled vectors."""

    entries: np.ndarray
    scale: int

    @property
    def dimensions(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def decoded(self, codes: list[str]) -> np.ndarray:
        """The vectors that the codes stand for: the middle of each integer's interval."""
        parts = len(self.entries)
        digits = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, parts)
        return ((self.entries[np.arange(parts), digits] + 0.5) / self.scale).reshape(len(codes), -1)


def first_codebooks(rows: DataFrame, id_column: str, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the vectors with the smallest ids (null ids last, equal ids by vector)."""
    by = F.col("row").getField(id_column)
    found = rows.orderBy(by.asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    vectors = matrix(pa.array([r.vector for r in found], pa.list_(pa.float64())))
    if vectors.shape[1] % parts:
        raise ValueError(f"vectors of {vectors.shape[1]} components have no {parts} equal parts")
    cut = floored(vectors, scale, LIMIT).reshape(len(vectors), parts, -1)
    return Codebooks(np.ascontiguousarray(cut.transpose(1, 0, 2)), scale)


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Every entry at the floored mean of the parts nearest to it; entries without parts stay.

    A task reports one row for each entry it used, so what meets is no larger than the
    codebooks times the tasks, and what reaches the driver no larger than the codebooks.
    """
    parts, entries, width = books.entries.shape
    scale, dimensions, start = books.scale, books.dimensions, books.entries

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(e) for e in start]
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            cut = floored(matrix(batch.column(0), dimensions), scale, LIMIT).reshape(-1, parts, width)
            for p, search in enumerate(searches):
                nearest, _ = search.nearest(cut[:, p])
                counts[p] += np.bincount(nearest, minlength=entries)
                np.add.at(sums[p], nearest, cut[:, p])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array(counts.reshape(-1)[used]),
                pa.array(sums.reshape(-1, width)[used].tolist(), pa.list_(pa.int64())),
            ],
            names=["cell", "count", "sums"],
        )

    tallies = rows.select("vector").mapInArrow(tally, "cell int, count long, sums array<long>")
    summed = tallies.groupBy("cell").agg(
        F.sum("count").alias("count"), *[F.sum(F.col("sums")[i]).alias(f"sum_{i}") for i in range(width)]
    )
    flat = start.reshape(-1, width).copy()
    for cell, count, *sums in summed.collect():
        flat[cell] = [s // count for s in sums]
    return Codebooks(flat.reshape(start.shape), scale)


def fit_codebooks(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks after some rounds over all vectors, or None if there is no vector.

    Components become floor(``scale`` * x). A vector that is null or holds null or non-finite
    components does not count; vectors of different lengths, of a length that ``parts`` does
    not divide, or with a component beyond ``LIMIT`` / ``scale`` are an error.
    """
    if entries > 256:
        raise ValueError("two hexadecimal digits name 256 entries")
    rows = whole_vectors(vectors, vector_column)
    if rows.isEmpty():
        return None
    books = first_codebooks(rows, id_column, parts, entries, scale)
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, vector_column: str = "embedding") -> DataFrame:
    """``row`` (all columns but the vector), ``code`` and ``error`` of each vector that counts.

    The code has two hexadecimal digits a part; the error is the squared distance from what
    the code stands for, in units of the scaled integers. Without codebooks there is no row.
    """
    rows = whole_vectors(vectors, vector_column)
    schema = with_columns(rows, ("code", StringType()), ("error", LongType()))
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    parts, _, width = books.entries.shape
    scale, dimensions, start = books.scale, books.dimensions, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(e) for e in start]
        for batch in batches:
            cut = floored(matrix(batch.column(1), dimensions), scale, LIMIT).reshape(-1, parts, width)
            found = [search.nearest(cut[:, p]) for p, search in enumerate(searches)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            errors = np.sum([f[1] for f in found], 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())],
                names=["row", "code", "error"],
            )

    return rows.mapInArrow(run, schema)


def with_label_error(coded: DataFrame, label: Column, key: Column) -> DataFrame:
    """Adds ``label_error``, the error summed over all rows with the same label (nulls: one).

    Sums are made map-side; each label's sum stands under several salts, so a label with most
    of the rows is joined in as many tasks.
    """
    coded = stored(coded.withColumns({"label": label, "salt": F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")}), "codes")
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    salted = sums.select(
        F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("under")
    )
    return coded.join(salted, (F.col("salt") == F.col("under")) & F.col("label").eqNullSafe(F.col("of"))).drop(
        "salt", "under", "of"
    )


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    **options: int,
) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors that count by codebooks fitted on all of them, and the codebooks.

    Returns ``row``, ``code``, ``error``, ``label`` and ``label_error``. Rows that repeat are
    coded each; a null id is carried like any other. See ``fit_codebooks`` and ``encode``.
    """
    books = fit_codebooks(vectors, id_column, vector_column, **options)
    coded = encode(vectors, books, vector_column)
    row = F.col("row")
    return with_label_error(coded, row.getField(label_column), row.getField(id_column)), books
