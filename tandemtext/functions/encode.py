"""Token ids: a vocabulary from the corpus, encoding, padding, decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tandemtext.functions.text import named, words
from tandemtext.session import scratch_path, settings, shuffles_dropped
from tandemtext.sources.files import with_row_index

# Ids of the special tokens, and the label the loss leaves out.
PAD, EOS, UNK = 0, 1, 2
SPECIALS = ("<pad>", "</s>", "<unk>")
IGNORED_LABEL = -100
# Items that are dictionary-encoded together: some MB in a task.
CHUNK_ITEMS = 1 << 18
# Rows that wait for more of them, as they may have few items.
CHUNK_BYTES = 1 << 26
# Rows that go to Python at once, of texts that may be long.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512
# Rows of a stretch that travel together.
PART_ROWS = 4096
# Row groups of the stored stretches, and how their items are compressed.
STRETCH_GROUPS = {"parquet.block.size": 32 << 20, "parquet.block.size.row.check.min": 1}
STRETCH_CODEC = "zstd"


def build_vocabulary(texts: DataFrame, max_size: int | None = None) -> DataFrame:
    """``id, token, uses`` of all words, the most used first, after the special tokens.

    ``texts`` has one string column. With ``max_size`` only so many words are kept, as a
    tokenizer of fixed size has them; the others are encoded as unknown.
    """
    [column] = texts.columns
    used = texts.select(F.explode(words(F.col(column))).alias("token")).groupBy("token").agg(
        F.count("*").alias("uses")
    )
    return _ranked(used, max_size)


def _ranked(used: DataFrame, max_size: int | None = None) -> DataFrame:
    ranked = with_row_index(used, F.desc("uses"), "token")
    kept = ranked if max_size is None else ranked.where(F.col("row_index") < max_size)
    return kept.select((F.col("row_index") + len(SPECIALS)).cast("int").alias("id"), "token", "uses")


def _chunks(
    df: DataFrame,
    columns: Mapping[str, Column],
    item: str,
    keep: Sequence[str] | None = None,
    counted: bool = False,
) -> DataFrame:
    """``chunk, items, parts``: stretches of rows in dictionary encoding.

    ``items`` are the distinct items of the arrays ``columns`` in a stretch, in order, and with
    ``counted`` ``uses`` how often each stands there; ``parts`` hold every row of ``df``, or its columns
    ``keep``, and, for each of the columns, the places of its items among them, as compressed Arrow
    tables. A stretch ends at about ``CHUNK_ITEMS`` items, with a row that has more, or with the
    batch in which its rows pass ``CHUNK_BYTES``; it goes on over any number of smaller batches.
    """
    kept = list(map(named, df.columns if keep is None else keep)) or [F.lit(0)]
    staged = df.select(
        F.struct(*kept).alias("row"),
        *[entry.cast(f"array<{item}>").alias(f"at_{i}") for i, entry in enumerate(columns.values())],
    )
    most, most_bytes, width, part_rows = CHUNK_ITEMS, CHUNK_BYTES, len(columns), PART_ROWS

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy
        import pyarrow
        import pyarrow.compute
        from pyspark import TaskContext

        def lists(lengths, values, mask):
            ends = numpy.concatenate([[0], numpy.cumsum(lengths)]).astype(numpy.int32)
            return pyarrow.ListArray.from_arrays(pyarrow.array(ends), values, mask=mask)

        def lengths_of(column):
            return pyarrow.compute.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)

        def written(rows):
            out = pyarrow.BufferOutputStream()
            options = pyarrow.ipc.IpcWriteOptions(compression="zstd")
            with pyarrow.ipc.new_stream(out, rows.schema, options=options) as stream:
                stream.write_batch(rows)
            return out.getvalue().to_pybytes()

        def packed(pieces, number):
            """One stretch of the rows of some batches."""
            flat = [piece.column(i + 1).flatten() for i in range(width) for piece in pieces]
            coded = pyarrow.concat_arrays(flat).dictionary_encode()
            # Neighbours in order are alike, and travel in fewer bytes.
            order = pyarrow.compute.array_sort_indices(coded.dictionary)
            ranks = numpy.empty(len(order), numpy.int32)
            ranks[order.to_numpy()] = numpy.arange(len(order), dtype=numpy.int32)
            small = pyarrow.uint16() if len(order) <= 1 << 16 else pyarrow.int32()
            places = pyarrow.array(ranks).cast(small).take(coded.indices)
            # Places in flat order, given back to the rows of each column.
            sizes = iter(map(len, flat))
            starts, at = [], 0
            for _ in range(width):
                starts.append([])
                for _ in pieces:
                    starts[-1].append(at)
                    at += next(sizes)
            parts = []
            for j, piece in enumerate(pieces):
                own = [
                    lists(lengths_of(column), places.slice(starts[i][j], int(lengths_of(column).sum())), column.is_null())
                    for i, column in enumerate(piece.columns[1:])
                ]
                rows = pyarrow.RecordBatch.from_arrays([piece.column(0), *own], ["row", *[f"at_{i}" for i in range(width)]])
                parts += [written(rows.slice(a, part_rows)) for a in range(0, rows.num_rows, part_rows)]
            held = [
                pyarrow.array([number], pyarrow.int64()),
                lists([len(order)], coded.dictionary.take(order), None),
                pyarrow.array([parts], pyarrow.list_(pyarrow.binary())),
            ]
            if counted:
                known = places.drop_null().to_numpy()
                uses = numpy.bincount(known, minlength=len(order)).astype(numpy.int64)
                held.append(lists([len(uses)], pyarrow.array(uses), None))
            return pyarrow.RecordBatch.from_arrays(held, schema.names)

        number = TaskContext.get().partitionId() << 40
        pieces, waiting = [], 0  # rows of earlier batches, and their items
        for batch in batches:
            sums = numpy.cumsum(numpy.sum([lengths_of(column) for column in batch.columns[1:]], axis=0))
            stretch = (waiting + sums) // most
            begins = waiting // most
            cuts = [0, *(numpy.flatnonzero(numpy.diff(stretch, prepend=begins))).tolist(), batch.num_rows]
            for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if n and pieces:
                    yield packed(pieces, number)
                    pieces, number = [], number + 1
                if a < b:
                    pieces.append(batch.slice(a, b - a))
            waiting = (waiting + int(sums[-1])) % most if batch.num_rows else waiting
            if sum(piece.nbytes for piece in pieces) >= most_bytes:
                yield packed(pieces, number)
                pieces, waiting, number = [], 0, number + 1
        if pieces:
            yield packed(pieces, number)

    schema = StructType(
        [
            StructField("chunk", LongType()),
            StructField("items", staged.schema["at_0"].dataType),
            StructField("parts", ArrayType(BinaryType())),
            *[StructField("uses", ArrayType(LongType()))][: int(counted)],
        ]
    )
    return staged.mapInArrow(pack, schema)


def _looked_up(
    df: DataFrame,
    columns: Mapping[str, Column],
    item: str,
    known: Callable[[DataFrame], DataFrame],
    missing: Column,
    keep: Sequence[str] | None = None,
    counted: bool = False,
) -> DataFrame:
    """Adds, for each name, the values of the items of an array in order; null for a null array.

    ``keep`` names the columns that stay beside them, all without it.

    ``known`` gets the distinct items of each stretch of rows, with their ``uses`` there if
    ``counted``, and returns ``item, value``.
    Only distinct items are joined to it. The rows of a stretch meet its values in one group,
    and take them by place: a task holds one stretch, and its values once.
    """
    spark, kept = df.sparkSession, df.columns if keep is None else list(keep)
    path = scratch_path(spark, "chunks")
    # A stretch is one stored row of some MB: few of them are held by who writes or reads.
    # Texts go to Python in small batches, as a stretch goes on over many.
    rows = min(BATCH_ROWS, int(spark.conf.get(BATCH_KEY, str(BATCH_ROWS))))
    with shuffles_dropped(spark), settings(spark, {BATCH_KEY: str(rows) if rows > 0 else str(BATCH_ROWS)}):
        staged = _chunks(df, columns, item, kept, counted)
        staged.write.options(compression=STRETCH_CODEC, **STRETCH_GROUPS).parquet(path)
    chunks = spark.read.parquet(path)
    distinct = chunks.select("chunk", F.posexplode("items").alias("place", "_item"))
    items = distinct.select(F.col("_item").alias("item"))
    if counted:
        items = chunks.select(F.inline(F.arrays_zip(F.col("items").alias("item"), "uses")))
    values = known(items)
    found = distinct.join(values, F.col("_item") == F.col("item"), "left").select(
        F.col("chunk").alias("stretch"), "place", F.coalesce("value", missing).alias("value")
    )
    names = [f"at_{i}" for i in range(len(columns))]
    taken = [StructField(name, ArrayType(found.schema["value"].dataType)) for name in names]
    unpacked = chunks.select("chunk", F.explode("parts").alias("part"))
    row = df.select(F.struct(*(list(map(named, kept)) or [F.lit(0)])).alias("row")).schema["row"]
    schema = StructType([row, *taken])

    def take(rows: pa.Table, values: pa.Table) -> pa.Table:
        import numpy
        import pyarrow
        import pyarrow.compute

        def whole(column):
            # Of one piece; no piece at all is an array without entries.
            return pyarrow.concat_arrays(column.chunks) if column.num_chunks else pyarrow.array([], column.type)

        held = whole(values.column("value"))
        held = held.take(pyarrow.array(numpy.argsort(whole(values.column("place")).to_numpy())))

        def valued(part):
            out = []
            for places in part.columns[1:]:
                lengths = pyarrow.compute.fill_null(places.value_lengths(), 0).to_numpy(zero_copy_only=False)
                ends = numpy.concatenate([[0], numpy.cumsum(lengths)]).astype(numpy.int32)
                own = held.take(places.flatten())
                out.append(pyarrow.ListArray.from_arrays(pyarrow.array(ends), own, mask=places.is_null()))
            return pyarrow.RecordBatch.from_arrays([part.column(0), *out], ["row", *names])

        parts = [
            valued(part)
            for told in rows.column("part").to_pylist()
            for part in pyarrow.ipc.open_stream(told)
        ]
        return pyarrow.Table.from_batches(parts)

    placed = unpacked.groupBy("chunk").cogroup(found.groupBy("stretch")).applyInArrow(take, schema)
    return placed.select(
        *[F.col("row").getField(name).alias(name) for name in kept],
        *[F.col(f"at_{i}").alias(name) for i, name in enumerate(columns)],
    )


def encode_texts(
    df: DataFrame,
    texts: Mapping[str, str],
    vocabulary: DataFrame,
    first: int | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds a column of token ids for each text column of ``texts`` (new name to text column).

    The vocabulary is joined, so it may have any size; words it lacks are unknown. A null text
    has null ids. With ``first`` only so many words of each text are encoded; ``keep`` names the
    columns that stay, all without it.
    """
    tokens = {name: words(named(column)) for name, column in texts.items()}
    if first is not None:
        tokens = {name: F.slice(entry, 1, first) for name, entry in tokens.items()}
    known = vocabulary.select(F.col("token").alias("item"), F.col("id").cast("int").alias("value"))
    return _looked_up(df, tokens, "string", lambda _: known, F.lit(UNK), keep)


def encode_corpus(
    df: DataFrame, texts: Mapping[str, str], keep: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``encode_texts`` in the vocabulary of these texts themselves, and that vocabulary.

    Words are found once: the stretches that wait for their ids have counted them.
    """
    path = scratch_path(df.sparkSession, "vocabulary")

    def known(items: DataFrame) -> DataFrame:
        used = items.groupBy(F.col("item").alias("token")).agg(F.sum("uses").alias("uses"))
        with shuffles_dropped(df.sparkSession):
            _ranked(used).write.parquet(path)
        vocabulary = df.sparkSession.read.parquet(path)
        return vocabulary.select(F.col("token").alias("item"), F.col("id").cast("int").alias("value"))

    tokens = {name: words(named(column)) for name, column in texts.items()}
    encoded = _looked_up(df, tokens, "string", known, F.lit(UNK), keep, counted=True)
    return encoded, df.sparkSession.read.parquet(path)


def decode_ids(
    df: DataFrame,
    ids: Mapping[str, str],
    vocabulary: DataFrame,
    skip_special: bool = True,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the words of each id column of ``ids`` (new name to id column), joined by blanks.

    Ids that the vocabulary lacks are left out, and special tokens unless asked for. ``keep``
    names the columns that stay, all without it.
    """
    kept = df.columns if keep is None else list(keep)
    known = vocabulary.select("token", F.col("id").cast("int").alias("id"))
    if not skip_special:
        special = [(token, i) for i, token in enumerate(SPECIALS)]
        known = known.unionByName(df.sparkSession.createDataFrame(special, "token string, id int"))
    known = known.select(F.col("id").alias("item"), F.col("token").alias("value"))
    # Names that no column has.
    lists = {f"_words_{name}": named(column) for name, column in ids.items()}
    found = _looked_up(df, lists, "int", lambda _: known, F.lit(None).cast("string"), kept)
    return found.select(
        *map(named, kept), *[F.array_join(named(f"_words_{name}"), " ").alias(name) for name in ids]
    )


def encode_with(tokenize: Callable[[], Callable[[pd.Series], Sequence]], text: Column) -> Column:
    """Ids from an injected tokenizer, loaded once per task."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pandas

        encode = tokenize()
        for batch in batches:
            yield pandas.Series(list(encode(batch)), dtype=object, index=batch.index)

    return run(text)


def fixed_length(ids: Column, length: int = 200, pad: int = PAD, eos: int | None = None) -> Column:
    """Cut or padded to ``length``; ``eos`` ends the text also when it is cut."""
    if eos is not None:
        ids = F.concat(F.slice(ids, 1, length - 1), F.array(F.lit(eos)))
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad), F.lit(length) - F.size(cut)))


def attention_mask(ids: Column, length: int = 200, eos: int | None = None) -> Column:
    """1 for the positions ``fixed_length`` takes from the text, 0 for padding."""
    size = F.least(F.size(ids) + (0 if eos is None else 1), F.lit(length))
    return F.concat(
        F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.lit(length) - size)
    )


def without_ignored(labels: Column, pad: int = PAD, ignored: int = IGNORED_LABEL) -> Column:
    return F.transform(labels, lambda label: F.when(label == ignored, pad).otherwise(label))


def encoded_examples(
    df: DataFrame,
    vocabulary: DataFrame,
    labels: dict[str, str],
    text: str = "prompt",
    length: int = 200,
    eos: int | None = EOS,
) -> DataFrame:
    """Only the columns a trainer reads: ``input_ids, attention_mask`` and the labels.

    ``labels`` names the text column behind each label column.
    """
    wanted = {"input_ids": text, **labels}
    # Names that no text column has; what is cut needs no ids.
    ids = {f"_{name}": column for name, column in wanted.items()}
    raw = encode_texts(df, ids, vocabulary, first=length, keep=[])
    return raw.select(
        fixed_length(F.col("_input_ids"), length, eos=eos).alias("input_ids"),
        attention_mask(F.col("_input_ids"), length, eos=eos).alias("attention_mask"),
        *[fixed_length(F.col(f"_{name}"), length, eos=eos).alias(name) for name in labels],
    )
