"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams, of one to four letters, that
both have (blended spectrum, presence only), divided by the root of the product of their
numbers. Landmarks are pieces of training texts of each language; the kernel to them is the feature
vector (Nyström), and kernel ridge regression, one language versus the rest, gives the
weights. Texts are scored in batches: presence times landmarks, times weights. The more
letters a text has the more n-grams it shares with every landmark, so long texts are walked
in pieces of like length, and the mean of their kernel rows by letters stands for the text.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.text import named
from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.substring_dedup import mix

SIZES = (1, 2, 3, 4)
FEATURES = 1 << 15  # n-grams are hashed to so many
LANDMARKS = 96
TRAINING_ROWS = 4_000  # bound of the sample the classifier is fitted on
RIDGE = 1e-3
UNKNOWN = "und"
PIECE_SIGNS = 4_096  # longer texts are cut into equal pieces, no longer than this
_BATCH_LETTERS = 1 << 20
_BATCH_TEXTS = 128


def letter_table() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def presence(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashed n-grams each text has (rows of 0 and 1), and how many letters (those in overlaps count twice).

    Letters are lower-cased, and what stands between words is one blank. Texts are walked
    through whole, in pieces that overlap by what an n-gram needs.
    """
    found = np.zeros((len(texts), FEATURES), np.float32)
    counts = np.zeros(len(texts), np.int64)
    overlap = max(SIZES) - 1

    def mark(rows: np.ndarray, signs: np.ndarray) -> None:
        for size in SIZES:
            if len(signs) < size:
                continue
            n = len(signs) - size + 1
            hashed = np.full(n, size * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            inside = rows[:n] == rows[size - 1 :]
            for i in range(size):
                hashed = (hashed ^ signs[i : i + n]) * np.uint64(0x100000001B3 + (i << 33))
            at = (mix(hashed) & np.uint64(FEATURES - 1)).astype(np.int64)
            found[rows[:n][inside], at[inside]] = 1

    waiting: list[tuple[int, str]] = []
    held = 0

    def flush() -> None:
        joined = "".join(t for _, t in waiting)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        rows = np.repeat([i for i, _ in waiting], [len(t) for _, t in waiting])
        is_letter = letters[codes]
        np.add.at(counts, rows, is_letter)
        signs = np.where(is_letter, codes, 32).astype(np.uint64)
        # Of blanks in a row the first stays.
        kept = is_letter.copy()
        kept[1:] |= is_letter[:-1] | (rows[1:] != rows[:-1])
        kept[:1] = True
        mark(rows[kept], signs[kept])

    for i, text in enumerate(texts):
        text = text.lower()
        for a in range(0, len(text), _BATCH_LETTERS):
            piece = text[max(0, a - overlap) : a + _BATCH_LETTERS]
            waiting.append((i, piece))
            held += len(piece)
            if held >= _BATCH_LETTERS:
                flush()
                waiting, held = [], 0
    if waiting:
        flush()
    return found, counts


def text_pieces(text: str) -> Iterator[str]:
    """The text in equal pieces, each with the signs before it that an n-gram needs."""
    many = max(1, -(-len(text) // PIECE_SIGNS))
    for i in range(many):
        yield text[max(0, len(text) * i // many - max(SIZES) + 1) : len(text) * (i + 1) // many]


@dataclass
class Model:
    """Landmarks as packed bits, their roots of numbers of n-grams, and weights for each language."""

    languages: list[str]
    landmarks: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def kernel(self, found: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        roots = np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
        return (found @ landmarks.T) / roots / self.roots

    def features(self, texts: list[str], landmarks: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kernel row of each whole text, the mean of its pieces' by letters, and the numbers of letters."""
        total = np.zeros((len(texts), len(landmarks)))
        counts = np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, str]] = []

        def flush() -> None:
            rows = [i for i, _ in waiting]
            found, n = presence([t for _, t in waiting], letters)
            np.add.at(total, rows, self.kernel(found, landmarks) * n[:, None])
            np.add.at(counts, rows, n)
            waiting.clear()

        for i, text in enumerate(texts):
            for piece in text_pieces(text):
                waiting.append((i, piece))
                if len(waiting) == _BATCH_TEXTS:
                    flush()
        if waiting:
            flush()
        return total / np.maximum(counts, 1)[:, None], counts

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.landmarks, axis=1).astype(np.float32)


def training_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of (key, text, label): every label's share is as large as may be.

    Rows are taken by a hash of their key, whatever order they come in.
    """
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    left, each, take = rows, 0, {}
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        each = left // (len(counts) - i)
        take[label] = min(1.0, each / n)
        left -= min(each, n)
    if not take:
        return labelled.limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for kv in take.items() for x in kv]), F.col("label"))
    at = F.pmod(F.xxhash64("key", F.lit("training")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(at < share)


def fit(
    labelled: DataFrame, rows: int = TRAINING_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE
) -> Model:
    """A model of (key, text, label) rows, from a sample of about ``rows`` of them.

    Rows without label or text, or without a letter, are left out. The landmarks are spread
    evenly over the languages, and are different pieces from anywhere in the texts: those of
    2,000 signs or more by their hash, then the longest. Without any row the model has no language.
    """
    usable = labelled.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    sample = sorted((r.key, r.label, r.text) for r in training_sample(usable, rows).collect())
    letters = letter_table()
    languages = sorted({label for _, label, _ in sample})
    if not sample:
        return Model([], np.zeros((0, FEATURES // 8), np.uint8), np.zeros(0), np.zeros((0, 0)))
    chosen: list[str] = []
    for language in languages:
        own = {piece for r in sample if r[1] == language for piece in text_pieces(r[2])}
        ordered = sorted(own, key=lambda piece: (-min(len(piece), 2_000), zlib.crc32(piece.encode()), piece))
        chosen += ordered[: max(1, landmarks // len(languages))]
    marks, _ = presence(chosen, letters)
    roots = np.sqrt(np.maximum(marks.sum(axis=1), 1))
    model = Model(languages, np.packbits(marks.astype(np.uint8), axis=1), roots, np.zeros((0, 0)))
    features, _ = model.features([r[2] for r in sample], marks, letters)
    truth = np.where(np.array([r[1] for r in sample])[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Every language weighs the same, however many rows it has.
    weight = np.zeros(len(sample))
    for c in range(len(languages)):
        weight[truth[:, c] > 0] = len(sample) / len(languages) / (truth[:, c] > 0).sum()
    own = model.kernel(marks, marks)
    gram = features.T @ (features * weight[:, None]) + ridge * len(sample) * (own + 1e-6 * np.eye(len(own)))
    model.weights = np.linalg.solve(gram, features.T @ (truth * weight[:, None]))
    return model


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The language of each whole text: id, ``lang_pred``, ``score`` and all columns of the input.

    The score is the softmax of the regressions, between 0 and 1. Null texts and texts without
    a letter get ``und`` and 0. The input's columns are in ``row``.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, landmarks = letter_table(), model.unpacked()
        names = np.array(model.languages, object)
        for batch in pieces(batches, _BATCH_TEXTS):
            texts = batch.column("row").field(text_column).to_pylist()
            labels: list[str] = [UNKNOWN] * len(texts)
            scores = np.zeros(len(texts))
            for a in range(0, len(texts) if len(names) else 0, _BATCH_TEXTS):
                rows, counts = model.features([t or "" for t in texts[a : a + _BATCH_TEXTS]], landmarks, letters)
                values = rows @ model.weights
                values = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
                values /= values.sum(axis=1, keepdims=True)
                best = values.argmax(axis=1)
                for i in np.flatnonzero(counts).tolist():
                    labels[a + i] = names[best[i]]
                    scores[a + i] = values[i, best[i]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                names=["row", "lang_pred", "score"],
            )

    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("row", T.StructType(docs.schema.fields)),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return in_small_batches(docs).select(F.struct(*map(named, docs.columns)).alias("row")).mapInArrow(predict, schema)


def held_out(id_column: str, of: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % of == remainder


def fit_documents(docs: DataFrame, **options) -> Model:
    """A model of ``documents`` rows that are not held out (crc32 of the id, modulo 5, not 0)."""
    return fit(
        docs.filter(~held_out("doc_id", 5, 0)).select(
            F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")
        ),
        **options,
    )


def drop_unknown(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents with a language: a letter at least, and a score of ``least`` at least."""
    model = fit_documents(docs)
    return (
        identify(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
    )
