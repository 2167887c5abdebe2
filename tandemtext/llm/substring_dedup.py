"""Removal of repeated passages by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash among its runs of
``MINIMISER`` words, so equal windows have equal minimisers. Consecutive windows with one
minimiser travel as one packed string to the minimiser's bucket. There equal strings are
collapsed first; strings whose minimiser no other string has, and which don't hold it
twice, can't share a window; the windows of the rest are cut out, sorted and compared as
words.

Copies that one task reads are collapsed before they are sent, so the copies of a passage
are as many as there are tasks at most. A minimiser that stands in very many different
surroundings would fill one bucket: a sample of documents names such minimisers, and
their windows travel one by one, by the hash of the window. Any choice of these gives
the same result, as all tasks follow the same one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tandemtext.functions.text import named
from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.words import blank_words
from tandemtext.sources.files import with_row_index

WINDOW = 20
MINIMISER = 5
CHUNK_WORDS = 1 << 19
LONGEST_RUN = 512
SAMPLED_DOCUMENTS = 20_000  # bound of the sample that names frequent minimisers
FREQUENT = 12  # different strings of one minimiser in the sample
PLACE_BITS = 22
BUCKET_LETTERS = 1 << 21  # letters of all texts for each bucket; one is sorted in a task's memory
NO_ID = (1 << 63) - 1
_FACTOR = 0x9E3779B97F4A7C15
_BLOCK_BYTES = 1 << 20


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes, so that their order has nothing to do with the words'."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of a text of words joined by single blanks."""
    bytes_ = np.frombuffer(joined, np.uint8)
    blanks = np.flatnonzero(bytes_ == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(bytes_)]])
    inverse = pow(_FACTOR, -1, 1 << 64)
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + _BLOCK_BYTES, "right")), a + 1)
        low, high = int(starts[a]), int(ends[b - 1])
        size = high - low
        up = np.full(size, _FACTOR, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up), np.cumprod(down)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((bytes_[low:high] + np.uint64(1)) * up)])
        s, e = starts[a:b] - low, ends[a:b] - low
        hashes[a:b] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return hashes, starts, ends


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(least[:n], least[width - size : width - size + n])


def super_kmers(
    hashes: np.ndarray, lengths: np.ndarray, window: int, minimiser: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, minimiser, and whether it stands there twice, of each run.

    ``lengths`` are the numbers of words of the pieces that follow each other in ``hashes``.
    """
    none = np.empty(0, np.int64)
    if len(hashes) < window:
        return none, none, none.astype(np.uint64), none.astype(bool)
    n = len(hashes) - minimiser + 1
    grams = np.zeros(n, np.uint64)
    for i in range(minimiser):
        grams += hashes[i : i + n] * np.uint64(2 * i + 0x2545F4914F6CDD1D)
    grams = mix(grams) >> np.uint64(PLACE_BITS)
    least = sliding_least(grams, window - minimiser + 1)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    open_ = np.zeros(len(hashes) + 1, np.int64)
    fits = lengths >= window
    np.add.at(open_, bounds[:-1][fits], 1)
    np.add.at(open_, bounds[1:][fits] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(open_)[:-1] > 0)
    if not len(at):
        return none, none, none.astype(np.uint64), none.astype(bool)
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(at)]]))
    if size.max() > LONGEST_RUN:
        within = np.arange(len(at)) - np.repeat(first, size)
        new |= within % LONGEST_RUN == 0
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(at)]]))
    start, value = at[first], value[first]
    span = size + window - minimiser
    offsets = np.concatenate([[0], np.cumsum(span)[:-1]])
    places = np.arange(span.sum()) - np.repeat(offsets - start, span)
    twice = np.add.reduceat((grams[places] == np.repeat(value, span)).astype(np.int32), offsets) > 1
    return start, size, value, twice


class Chunk:
    """Pieces of documents of one task, together about as large as the limit."""

    def __init__(self, window: int, minimiser: int) -> None:
        self.window, self.minimiser = window, minimiser
        self.pieces: list[bytes] = []
        self.lengths: list[int] = []
        self.owners: list[tuple[int, int, int]] = []  # id, digest, first word
        self.words = 0

    def add(self, id_: int, digest: int, first: int, words: list[bytes]) -> None:
        self.pieces.append(b" ".join(words))
        self.lengths.append(len(words))
        self.owners.append((id_, digest, first))
        self.words += len(words)

    def strings(self) -> tuple[list[bytes], list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Text, (id, digest, first word), windows, minimiser, twice of each super-k-mer."""
        joined = b" ".join(self.pieces)
        hashes, starts, ends = word_hashes(joined)
        lengths = np.array(self.lengths)
        at, size, value, twice = super_kmers(hashes, lengths, self.window, self.minimiser)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        piece = np.searchsorted(bounds, at, "right") - 1
        low, high = starts[at].tolist(), ends[at + size + self.window - 2].tolist()
        texts = [joined[a:b] for a, b in zip(low, high)]
        shift = (at - bounds[piece]).tolist()
        owners = []
        for p, s in zip(piece.tolist(), shift):
            id_, digest, first = self.owners[p]
            owners.append((id_, digest, first + s))
        return texts, owners, size, value, twice


def chunks_of(
    batches: Iterator[pa.RecordBatch], window: int, minimiser: int, limit: int
) -> Iterator[Chunk]:
    chunk = Chunk(window, minimiser)
    for batch in pieces(batches):
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = blank_words(text)
            if len(words) < window:
                continue
            digest = zlib.crc32(text.encode())
            for a in range(0, len(words) - window + 1, limit):
                piece = words[a : a + limit + window - 1]
                if chunk.pieces and chunk.words + len(piece) > 2 * limit:
                    yield chunk
                    chunk = Chunk(window, minimiser)
                chunk.add(NO_ID if id_ is None else id_, digest, a, piece)
            if chunk.words >= limit:
                yield chunk
                chunk = Chunk(window, minimiser)
    if chunk.pieces:
        yield chunk


def windows_of(text: bytes, window: int) -> list[bytes]:
    words = text.split(b" ")
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def spans_of(owner: tuple, offsets: list[int], window: int) -> Iterator[tuple[int, int, int, int]]:
    """Repeated windows of one string as stretches of words (id, digest, first, end)."""
    id_, digest, start = owner
    first = last = None
    for i in offsets:
        if first is not None and i > last + 1:
            yield id_, digest, start + first, start + last + window
            first = i
        elif first is None:
            first = i
        last = i
    if first is not None:
        yield id_, digest, start + first, start + last + window


def repeated(
    texts: list[bytes], owners: list[tuple], values: list[int], twice: list[bool], window: int
) -> Iterator[tuple[int, int, int, int]]:
    """The stretches of a bucket whose windows start earlier elsewhere."""
    first_of: dict[bytes, int] = {}
    for i, text in enumerate(texts):
        j = first_of.setdefault(text, i)
        if j != i and owners[i] < owners[j]:
            first_of[text] = i
    for i, text in enumerate(texts):
        if owners[i] > owners[first_of[text]]:
            id_, digest, start = owners[i]
            yield id_, digest, start, start + text.count(b" ") + 1
    groups: dict[int, list[int]] = {}
    for i in first_of.values():
        groups.setdefault(values[i], []).append(i)
    for members in groups.values():
        if len(members) == 1 and not twice[members[0]]:
            continue
        cut = sorted(
            (w, owners[i][0], owners[i][1], owners[i][2] + k, i, k)
            for i in members
            for k, w in enumerate(windows_of(texts[i], window))
        )
        later: dict[int, list[int]] = {}
        leader: tuple = (None,)
        for entry in cut:
            if entry[0] != leader[0]:
                leader = entry
            elif entry[1:4] > leader[1:4]:
                later.setdefault(entry[4], []).append(entry[5])
        for i, offsets in later.items():
            yield from spans_of(owners[i], sorted(offsets), window)


def frequent_minimisers(
    docs: DataFrame, window: int, minimiser: int, sampled: int, frequent: int
) -> list[int]:
    """Minimisers with many different strings in a sample of bounded expected size.

    Strings are told apart over the whole sample: a task may see one string of each only.
    """
    sample = docs.sample(min(1.0, sampled / max(1, docs.count())), seed=20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks_of(batches, window, minimiser, CHUNK_WORDS):
            texts, _, _, value, _ = chunk.strings()
            distinct = dict(zip(texts, value.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(distinct.values()), pa.int64()),
                    pa.array(map(zlib.crc32, distinct), pa.int64()),
                ],
                names=["value", "string"],
            )

    strings = sample.mapInArrow(count, "value long, string long")
    counted = strings.groupBy("value").agg(F.count_distinct("string").alias("n"))
    # At most one for each dozen strings of the bounded sample.
    return sorted(r.value for r in counted.filter(F.col("n") >= frequent).select("value").collect())


def repeated_stretches(
    docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, buckets: int | None = None
) -> DataFrame:
    """Stretches of words (id, digest, first, end) covered by windows that start earlier elsewhere.

    ``docs`` has ``id`` (integer) and ``text``; the digest is the crc32 of the text.
    """
    spark = docs.sparkSession
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = buckets or math.ceil(letters / BUCKET_LETTERS) or 1
    split = frozenset(frequent_minimisers(docs, window, minimiser, SAMPLED_DOCUMENTS, FREQUENT))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = pa.Codec("zstd", 6)
        task = TaskContext.get().partitionId()

        def row(bucket: int, texts: list[bytes], numbers: np.ndarray) -> dict:
            joined, raw = b"\n".join(texts), numbers.tobytes()
            return {
                "bucket": bucket,
                "texts": codec.compress(joined, asbytes=True),
                "text_bytes": len(joined),
                "numbers": codec.compress(raw, asbytes=True),
                "n": numbers.shape[1],
            }

        for turn, chunk in enumerate(chunks_of(batches, window, minimiser, CHUNK_WORDS)):
            texts, owners, size, value, twice = chunk.strings()
            values, doubled = value.tolist(), twice.tolist()
            if split and not split.isdisjoint(values):
                wide = [], [], [], []
                for text, owner, v, d in zip(texts, owners, values, doubled):
                    if v in split:
                        for k, w in enumerate(windows_of(text, window)):
                            one = (w, (owner[0], owner[1], owner[2] + k), zlib.crc32(w) | 1 << 44, False)
                            for column, x in zip(wide, one):
                                column.append(x)
                    else:
                        for column, x in zip(wide, (text, owner, v, d)):
                            column.append(x)
                texts, owners, values, doubled = wide
            kept: dict[bytes, int] = {}
            done = []
            for i, text in enumerate(texts):
                j = kept.setdefault(text, i)
                if j != i:
                    if owners[i] < owners[j]:
                        kept[text], i = i, j
                    if owners[i] != owners[kept[text]]:
                        done.append((*owners[i], owners[i][2] + text.count(b" ") + 1))
            index = np.fromiter(kept.values(), np.int64, len(kept))
            numbers = np.array(
                [(*owners[i], values[i], doubled[i]) for i in kept.values()], np.int64
            ).reshape(-1, 5)
            spread = (mix(numbers[:, 3].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(spread, kind="stable")
            bounds = np.flatnonzero(np.diff(spread[order], prepend=-1))
            rows = []
            for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(order)]):
                own = order[a:b]
                rows.append(
                    row(
                        int(spread[own[0]]),
                        [texts[i] for i in index[own].tolist()],
                        np.ascontiguousarray(numbers[own].T),
                    )
                )
            if done:  # known here: nothing else can turn up that would change it
                stretches = np.array(sorted(done), np.int64).T
                rows.append(row(buckets + task + turn, [], np.ascontiguousarray(stretches)))
            yield pa.RecordBatch.from_pylist(rows, schema=packed_kind)

    packed = "bucket int, texts binary, text_bytes long, numbers binary, n long"
    packed_kind = pa.schema(
        [
            ("bucket", pa.int32()),
            ("texts", pa.binary()),
            ("text_bytes", pa.int64()),
            ("numbers", pa.binary()),
            ("n", pa.int64()),
        ]
    )

    def of_bucket(table: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd", 6)
        texts, owners, values, twice, found = [], [], [], [], []
        for r in table.to_pylist():
            wide = 4 if r["bucket"] >= buckets else 5
            raw = codec.decompress(r["numbers"], r["n"] * wide * 8, asbytes=True)
            numbers = np.frombuffer(raw, np.int64).reshape(wide, -1)
            if wide == 4:
                found += zip(*numbers.tolist())
                continue
            texts += codec.decompress(r["texts"], r["text_bytes"], asbytes=True).split(b"\n")
            owners += zip(*numbers[:3].tolist())
            values += numbers[3].tolist()
            twice += numbers[4].tolist()
        found += repeated(texts, owners, values, twice, window)
        found.sort()
        # Stretches that touch are one.
        merged: list[list[int]] = []
        for id_, digest, a, b in found:
            if merged and merged[-1][:2] == [id_, digest] and a <= merged[-1][3]:
                merged[-1][3] = max(b, merged[-1][3])
            else:
                merged.append([id_, digest, a, b])
        columns = np.array(merged, np.int64).reshape(-1, 4).T
        return pa.table([pa.array(c) for c in columns], names=["id", "digest", "first", "end"])

    return (
        docs.select("id", "text")
        .mapInArrow(pack, packed)
        .groupBy("bucket")
        .applyInArrow(of_bucket, "id long, digest long, first long, end long")
    )


def drop_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """Every document without the words of passages that start earlier.

    A word goes if a window of ``window`` words around it has its sequence also at an earlier
    start: in a document with a smaller id, or before in the same one. Windows are those of
    the input. Returns the id, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined
    by one blank), one row for each input row. Null and short texts lose nothing. A null id
    counts as larger than any other; rows that share an id come in order of a digest of the
    text; rows that share id and text don't repeat each other. Ids are whole numbers or anything
    that has an order; these are numbered first, in a sort that is written.
    """
    kind = docs.schema[id_column].dataType
    own = docs.select(named(id_column).alias("id"), named(text_column).alias("text"))
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        cut = without_repeats(own.withColumn("id", F.col("id").cast("long")), window)
        return cut.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_column)
    numbers = with_row_index(own.select(F.col("id").alias("of")).filter("of IS NOT NULL").distinct(), "of")
    numbered = own.join(numbers, F.col("id") == F.col("of"), "left").select(F.col("row_index").alias("id"), "text")
    cut = without_repeats(numbered, window)
    return cut.join(numbers, F.col("id") == F.col("row_index"), "left").select(
        F.col("of").alias(id_column), "n_words", "n_removed", "kept"
    )


def without_repeats(docs: DataFrame, window: int) -> DataFrame:
    """``drop_repeats`` of ``id`` (long) and ``text``."""
    own = in_small_batches(docs)
    stretches = (
        repeated_stretches(own, window)
        .groupBy("id", "digest")
        .agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    )
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 6)
        for batch in pieces(batches):
            raw = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            packed = [None if t is None else codec.compress(t, asbytes=True) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(packed, pa.binary()),
                    pa.array([None if t is None else len(t) for t in raw], pa.int64()),
                    pa.array([zlib.crc32(t or b"") for t in raw], pa.int64()),
                ],
                names=["own_id", "packed", "size", "digest"],
            )

    # Texts are packed before they are shuffled.
    keyed = own.mapInArrow(shrink, "own_id long, packed binary, size long, digest long").withColumn(
        "id", F.coalesce("own_id", F.lit(NO_ID))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 6)
        for batch in pieces(batches):
            n_words, n_removed, kept = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("packed", "size", "spans")]
            for packed, size, spans in zip(*columns):
                words = codec.decompress(packed, size, asbytes=True).split() if packed else []
                n_words.append(len(words))
                if spans:
                    stays = np.ones(len(words), bool)
                    for span in spans:
                        stays[span["first"] : span["end"]] = False
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("own_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return (
        keyed.join(stretches, ["id", "digest"], "left")
        .select("own_id", "packed", "size", "spans")
        .mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    )
