"""Benchmark decontamination over a distributed positional inverted index.

The index is stored: segments of whole documents, and in each segment one row for every
term, in their order, with the places at which it stands. Building it needs no shuffle, as
a segment is made by the task that reads its documents. A search cuts the items to phrases
where they are read, counts their terms over the index, and brings each phrase to the
segments that have its rarest term, and the lists of the terms asked for there beside it.
For each phrase the lists, shifted by their offsets, are intersected from the rarest term
on; the others are only searched at the places that are left. Nothing of the items or of
the index goes through the driver.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.stored import stored
from tandemtext.llm.words import folded_words
from tandemtext.session import scratch_path

PHRASE = 10
SEGMENT_WORDS = 1 << 21
BLOCK_WORDS = 1 << 18
SALTS = 16
_BATCH_PHRASES = 1 << 14


def _index_schema(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("term", T.StringType()),
            T.StructField("count", T.LongType()),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("places", T.ArrayType(T.IntegerType())),
        ]
    )


def build_index(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """The index of all words of all documents, written to the shared folder.

    A row has the places of a term in its segment. Documents of a segment follow each other
    with a gap; the row without a term has their ids, their first places and the end. A
    document without words, or without text, takes a place like any other. The segment's
    size is a limit on memory: a longer document is a segment of its own.
    """
    spark = docs.sparkSession
    schema = _index_schema(docs.schema[id_column].dataType)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        kind = None
        ids, starts, runs, end = [], [], [], 0
        terms: defaultdict[bytes, int] = defaultdict()
        terms.default_factory = terms.__len__

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{task}-{number}"
            words = sorted(terms)
            rank = np.empty(len(words) + 1, np.int32)
            rank[np.fromiter(map(terms.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
            rank[-1] = -1  # of a gap
            codes = rank[np.concatenate(runs)]
            counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
            places = np.argsort(codes, kind="stable")[(codes < 0).sum() :].astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]),
                    pa.array([None], pa.string()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([ids], pa.list_(kind)),
                    pa.array([[*starts, end]], pa.list_(pa.int32())),
                ],
                names=schema.names,
            )
            step = 1 << 16
            for a in range(0, len(words), step):
                b = min(a + step, len(words))
                own = offsets[a : b + 1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * (b - a)),
                        pa.array(words[a:b], pa.binary()).cast(pa.string()),
                        pa.array(counts[a:b]),
                        pa.nulls(b - a, pa.list_(kind)),
                        pa.ListArray.from_arrays(pa.array(own - own[0]), pa.array(places[own[0] : own[-1]])),
                    ],
                    names=schema.names,
                )

        for batch in pieces(batches):
            kind = batch.schema.field(0).type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folded_words(text)
                if ids and end + len(words) > segment_words:
                    yield from flush()
                    number += 1
                    ids, starts, runs, end = [], [], [], 0
                    terms.clear()
                ids.append(id_)
                starts.append(end)
                # The gap behind a document has no term.
                codes = np.empty(len(words) + 1, np.int32)
                codes[:-1] = np.fromiter(map(terms.__getitem__, words), np.int32, len(words))
                codes[-1] = -1
                runs.append(codes)
                end += len(words) + 1
        if ids:
            yield from flush()

    path = scratch_path(spark, "index")
    in_small_batches(docs).select(id_column, text_column).mapInArrow(segments, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def indexed_documents(index: DataFrame) -> DataFrame:
    """The documents of the index: segment, ordinal, id and number of words."""
    spread = index.filter(F.col("term").isNull()).select(
        "segment", F.posexplode("ids").alias("ordinal", "id"), "places"
    )
    after = F.element_at("places", F.col("ordinal") + 2)
    n_words = after - F.element_at("places", F.col("ordinal") + 1) - 1
    return spread.select("segment", "ordinal", "id", n_words.cast("long").alias("n_words"))


def phrases_of(
    items: DataFrame, item_column: str = "item_id", text_column: str = "text", phrase: int = PHRASE
) -> DataFrame:
    """The distinct phrases of the items, their words joined by a blank, each with the items that have it.

    Items are cut where they are read, into batches of bounded size, however long an item is.
    Null texts and texts without words have no phrase.
    """
    schema = T.StructType(
        [T.StructField("phrase", T.StringType()), T.StructField("item", items.schema[item_column].dataType)]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, owners = [], []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(owners, kind)]
            texts.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in pieces(batches):
            kind = batch.schema.field(0).type
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = folded_words(text)
                for i in range(max(1, len(words) - phrase + 1) if words else 0):
                    texts.append(b" ".join(words[i : i + phrase]))
                    owners.append(item)
                    if len(texts) == _BATCH_PHRASES:
                        yield flush()
            yield flush()

    return items.select(item_column, text_column).mapInArrow(cut, schema).distinct()


def search(
    index: DataFrame,
    items: DataFrame,
    item_column: str = "item_id",
    text_column: str = "text",
    phrase: int = PHRASE,
    reach: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Where the phrases of the items occur: segment, ordinal, item, first word, length, exact.

    A phrase is ``phrase`` consecutive words of an item, or the whole item if it is shorter.
    With ``reach``, rows with ``exact`` false tell where all words of a phrase stand within
    that many words of its rarest one, in any order: ``first`` is the place of the rarest word.
    Items without words have no phrase. A task has the phrases of a block (one for each of
    ``block_words`` words, about) and the lists of one segment at a time.
    """
    owners = stored(phrases_of(items, item_column, text_column, phrase), "phrases")
    found = stored(_matches(index, owners.select("phrase").distinct(), reach, block_words), "matches")
    return with_owners(found, owners).select("segment", "ordinal", "item", "first", "length", "exact")


def with_owners(found: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows, each with every item that has its phrase: a phrase of very many places meets it under salts."""
    salt = F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")
    salted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", salt).join(salted, ["phrase", "salt"]).drop("salt")


def plans_of(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """The phrases whose words all occur, with ``order``: the offsets of the words from the rarest on, and ``rarest``."""
    words = F.split("phrase", " ")
    each = phrases.select("*", F.posexplode(words).alias("offset", "term"))
    terms = stored(each.select("term").distinct(), "terms")
    counted = index.select("term", "count").join(terms, "term", "left_semi")
    counted = stored(counted.groupBy("term").agg(F.sum("count").alias("count")), "counts")
    order = F.array_sort(F.collect_list(F.struct("count", "term", "offset")))
    return (
        each.join(counted, "term")
        .groupBy(*phrases.columns)
        .agg(order.alias("order"))
        .filter(F.size("order") == F.size(words))
        .select(*phrases.columns, F.col("order.offset").alias("order"), F.col("order")[0]["term"].alias("rarest"))
    )


def _matches(index: DataFrame, phrases: DataFrame, reach: int | None, block_words: int) -> DataFrame:
    """Where each phrase occurs: segment, ordinal, phrase, first word, length, exact.

    A phrase goes to the segments that have its rarest term, by a join on that term; the lists
    of its block's terms go to the segments where the block has a phrase at all. What one
    segment and one block have meets in a group.
    """
    spark = index.sparkSession
    blocks = max(1, -(-phrases.count() // block_words))
    block = F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int")
    plans = stored(plans_of(index, phrases.withColumn("block", block)), "plans")
    standing = index.select("segment", F.col("term").alias("rarest"))
    asked = standing.join(plans, "rarest").select("segment", "block", "phrase", "order")
    live = stored(
        standing.join(plans.select("rarest", "block").distinct(), "rarest").select("segment", "block").distinct(),
        "live",
    )
    # The row without a term has a segment's documents; every block needs it.
    wanted = (
        plans.select("block", F.explode(F.split("phrase", " ")).alias("wanted"))
        .distinct()
        .unionByName(spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(None).alias("wanted")))
    )
    lists = (
        index.join(wanted, F.col("term").eqNullSafe(F.col("wanted")))
        .select("segment", "block", "term", "places")
        .join(live, ["segment", "block"], "left_semi")
        .select(F.col("segment").alias("list_segment"), F.col("block").alias("list_block"), "term", "places")
    )
    schema = T.StructType(
        [
            T.StructField("segment", T.StringType()),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("phrase", T.StringType()),
            T.StructField("first", T.IntegerType()),
            T.StructField("length", T.IntegerType()),
            T.StructField("exact", T.BooleanType()),
        ]
    )

    def in_segment(asked: pa.Table, lists: pa.Table) -> pa.Table:
        starts, places = np.empty(0, np.int32), {}
        for term, chunk in zip(lists.column("term").to_pylist(), lists.column("places")):
            own = chunk.values.to_numpy()
            if term is None:
                starts = own
            else:
                places[term] = own
        rows, firsts, ordinals, lengths, exacts = [], [], [], [], []

        def add(row: int, at: np.ndarray, length: int, exact: bool) -> None:
            own = np.searchsorted(starts, at, "right") - 1
            rows.append(np.full(len(at), row))
            ordinals.append(own)
            firsts.append(at - starts[own])
            lengths.append(np.full(len(at), length))
            exacts.append(np.full(len(at), exact))

        phrases, orders = asked.column("phrase").to_pylist(), asked.column("order").combine_chunks()
        offsets, values = orders.offsets.to_pylist(), orders.values.to_pylist()
        for row, phrase in enumerate(phrases):
            words, order = phrase.split(" "), values[offsets[row] : offsets[row + 1]]
            if not all(word in places for word in words):
                continue
            rarest = places[words[order[0]]].astype(np.int64)
            at = rarest - order[0]
            for i in order[1:]:
                if not len(at):
                    break
                others, shifted = places[words[i]], at + i
                k = np.searchsorted(others, shifted)
                at = at[(k < len(others)) & (others[np.minimum(k, len(others) - 1)] == shifted)]
            if len(at):
                add(row, at, len(order), True)
            if reach is not None:
                own = np.searchsorted(starts, rarest, "right") - 1
                low = np.maximum(starts[own], rarest - reach)
                high = np.minimum(starts[own + 1] - 2, rarest + reach)
                near = np.ones(len(rarest), bool)
                for term in set(words):
                    others = places[term]
                    near &= np.searchsorted(others, low) < np.searchsorted(others, high, "right")
                add(row, rarest[near], len(order), False)

        def joined(arrays: list, kind: type) -> np.ndarray:
            return np.concatenate(arrays).astype(kind) if arrays else np.empty(0, kind)

        which = pa.array(joined(rows, np.int64))
        return pa.table(
            {
                "segment": asked.column("segment").take(which),
                "ordinal": joined(ordinals, np.int32),
                "phrase": asked.column("phrase").take(which),
                "first": joined(firsts, np.int32),
                "length": joined(lengths, np.int32),
                "exact": joined(exacts, bool),
            }
        )

    sides = asked.groupBy("segment", "block").cogroup(lists.groupBy("list_segment", "list_block"))
    return sides.applyInArrow(in_segment, schema)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    phrase: int = PHRASE,
) -> DataFrame:
    """How much of each document is covered by phrases of the items.

    Returns ``segment``, ``ordinal``, the id, ``n_words``, ``n_hit`` (words inside an exact
    occurrence), and ``items`` (the item ids with occurrences as text, sorted), one row for
    each input row, equal ids or not. Null texts and texts without words have no words; no
    items, or empty ones, hit nothing.
    """
    index = build_index(docs, id_column, text_column)
    phrases = stored(phrases_of(items, item_column, item_text_column, phrase), "phrases")
    found = stored(_matches(index, phrases.select("phrase").distinct(), None, BLOCK_WORDS), "matches")
    place = Window.partitionBy("segment", "ordinal").orderBy("first")
    end = F.col("first") + F.col("length")
    before = F.max(end).over(place.rowsBetween(Window.unboundedPreceding, -1))
    covered = F.greatest(F.lit(0), end - F.greatest("first", F.coalesce(before, F.lit(0))))
    hits = (
        found.groupBy("segment", "ordinal", "first")
        .agg(F.max("length").alias("length"))
        .withColumn("covered", covered)
        .groupBy("segment", "ordinal")
        .agg(F.sum("covered").alias("n_hit"))
    )
    owners = (
        with_owners(found.select("segment", "ordinal", "phrase").distinct(), phrases)
        .groupBy("segment", "ordinal")
        .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    return (
        indexed_documents(index)
        .join(hits.join(owners, ["segment", "ordinal"]), ["segment", "ordinal"], "left")
        .select(
            "segment",
            "ordinal",
            F.col("id").alias(id_column),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any phrase of the items, all columns kept.

    Rows go by their id and text: equal rows go or stay together.
    """
    id_column = options.get("id_column", "doc_id")
    text_column = options.get("text_column", "text")
    keyed = docs.select(
        F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("digest")).alias("key"),
        F.col(text_column).alias("text"),
    )
    index = build_index(keyed, "key", "text")
    phrases = phrases_of(
        items, options.get("item_column", "item_id"), options.get("item_text_column", "text"), options.get("phrase", PHRASE)
    )
    found = _matches(index, stored(phrases.select("phrase").distinct(), "phrases"), None, BLOCK_WORDS)
    hit = (
        indexed_documents(index)
        .join(found.select("segment", "ordinal").distinct(), ["segment", "ordinal"], "left_semi")
        .select(F.col("id.id").alias("hit_id"), F.col("id.digest").alias("hit_digest"))
        .distinct()
    )
    return docs.join(
        hit,
        docs[id_column].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs[text_column]) == hit["hit_digest"]),
        "left_anti",
    )
