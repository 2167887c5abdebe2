"""Similarity join of texts on their word n-grams, by MinHash banding.

Texts with equal n-gram sets are one node, represented by the smallest id. The signatures
of the nodes are cut into bands; nodes that share a band's hash are a bucket, and its pairs
are candidates. The texts of a bucket meet in one task, or, if they are many or long, in one
task for each pair of blocks, and there its pairs are verified on the full sets: each pair once, in
the first bucket both are in. A task reports counts and a spanning forest, never the pairs.
Buckets with the same nodes, as copies have in most bands, are one.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.stored import stored
from tandemtext.llm.substring_dedup import mix, word_hashes
from tandemtext.llm.words import folded_words

SIZE = 5
SIMILARITY = 0.8
RECALL = 0.9995
# The most nodes, and letters of text, that a block of a bucket holds on average; and the
# letters of small buckets that share a task.
BLOCK, BLOCK_LETTERS, TASK_LETTERS = 1024, 1 << 22, 1 << 23
CHUNK_WORDS = 1 << 18


def banding(similarity: float, recall: float, chance: float = 0.06) -> tuple[int, int]:
    """Bands and rows: the fewest bands that find a pair at the threshold with this recall.

    Rows are the fewest with which a pair half as similar is a candidate with a probability
    of at most ``chance``.
    """
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= chance:
            break
    return bands, rows


def shingles(documents: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Distinct hashes of the runs of ``size`` words of each text; of all words if it has fewer."""
    lengths = np.array([len(w) for w in documents], np.int64)
    ends = np.cumsum(lengths)
    joined = b" ".join(w for words in documents for w in words)
    if not joined:
        return [np.empty(0, np.uint64) for _ in documents]
    hashes = word_hashes(joined)[0]
    factors = [np.uint64(2 * i + 0x2545F4914F6CDD1D) for i in range(size)]
    n = max(0, len(hashes) - size + 1)
    grams = np.zeros(n, np.uint64)
    for i in range(size):
        grams += hashes[i : i + n] * factors[i]
    grams = mix(grams)
    out = []
    for start, end in zip((ends - lengths).tolist(), ends.tolist()):
        if end - start >= size:
            out.append(np.unique(grams[start : end - size + 1]))
        elif end > start:
            short = sum(int(h) * int(f) for h, f in zip(hashes[start:end], factors)) + (end - start)
            out.append(mix(np.array([short % (1 << 64)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """id, digest of the text, node (digest of the n-gram set; null without words) and band hashes."""
    spread = np.random.default_rng(20).integers(0, 1 << 63, (2, bands * rows), np.uint64)
    factors, shifts = spread[0] * np.uint64(2) + np.uint64(1), spread[1]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def of_chunk(ids: list, digests: list, documents: list[list[bytes]]) -> pa.RecordBatch:
            sets = shingles(documents, size)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            nodes: list[bytes | None] = [None] * len(sets)
            band_hashes: list[list[int] | None] = [None] * len(sets)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                least = np.empty((len(some), bands * rows), np.uint64)
                for j in range(bands * rows):
                    # Multiply, add, and spread the high bits down: their order is the permutation.
                    values = flat * factors[j] + shifts[j]
                    least[:, j] = np.minimum.reduceat(values ^ (values >> np.uint64(32)), starts)
                for i in some.tolist():
                    nodes[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                folded = np.zeros((len(some), bands), np.uint64)
                for r in range(rows):
                    folded = mix(folded + least[:, r::rows])
                folded = mix(folded + np.arange(bands, dtype=np.uint64)).view(np.int64)
                for i, own in zip(some.tolist(), folded.tolist()):
                    band_hashes[i] = own
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, kind),
                    pa.array(digests, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(band_hashes, pa.list_(pa.int64())),
                ],
                names=["id", "digest", "node", "bands"],
            )

        ids, digests, documents, words = [], [], [], 0
        for batch in pieces(batches):
            kind = batch.schema.field(0).type
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(id_)
                digests.append(zlib.crc32((text or "").encode()))
                documents.append(folded_words(text))
                words += len(documents[-1])
                if words >= CHUNK_WORDS:
                    yield of_chunk(ids, digests, documents)
                    ids, digests, documents, words = [], [], [], 0
        if ids:
            yield of_chunk(ids, digests, documents)

    kind = docs.schema["id"].dataType.simpleString()
    return in_small_batches(docs).select("id", "text").mapInArrow(
        sign, f"id {kind}, digest long, node binary, bands array<long>"
    )


def components(edges: DataFrame) -> DataFrame:
    """node and label (the same for connected nodes) of all nodes of ``edges`` (a, b).

    Every node moves to its least neighbour, and edges between nodes that moved to the same
    one vanish; labels are random digests, so the edges shrink by a constant share a round.
    """
    edges = stored(edges.select("a", "b").filter("a != b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        step = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("from"), F.least("a", "least").alias("to")
        ), "moves")
        if labels is None:
            labels = step.select(F.col("from").alias("node"), F.col("to").alias("label"))
        else:
            labels = labels.join(step, labels["label"] == step["from"], "left").select(
                "node", F.coalesce("to", "label").alias("label")
            )
        labels = stored(labels, "labels")
        other = step.select(F.col("from").alias("from_b"), F.col("to").alias("to_b"))
        edges = stored(
            edges.join(step, edges["a"] == step["from"])
            .join(other, F.col("b") == F.col("from_b"))
            .select(F.col("to").alias("a"), F.col("to_b").alias("b"))
            .filter("a != b")
            .distinct(),
            "edges",
        )
        if edges.isEmpty():
            return labels


def candidate_buckets(nodes: DataFrame) -> DataFrame:
    """node and ``buckets``, the band hashes it shares with other nodes.

    Of buckets with the same nodes the one of the least hash stands for all. Buckets are told
    apart by two independent 64-bit sums over their nodes.
    """
    banded = nodes.select("node", F.explode("bands").alias("band"))
    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sum_{i}") for i in range(2)]
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), *sums).filter("n > 1")
    kept = buckets.groupBy("n", "sum_0", "sum_1").agg(F.min("band").alias("band")).select("band")
    return banded.join(kept, "band").groupBy("node").agg(F.array_sort(F.collect_list("band")).alias("buckets"))


def verified(members: DataFrame, size: int, similarity: float, block: int, block_letters: int) -> DataFrame:
    """node, root (of its links in one task) and links, for each task a node takes part in.

    ``members`` has node, buckets (sorted), count (documents of the node) and text. A bucket of up to
    ``block`` nodes and ``block_letters`` letters is dealt to a task whole; of a larger one every pair of
    blocks is a task, so that its nodes travel as often as it has blocks. The number of tasks follows
    from the letters.
    """
    travelling = members.withColumn("letters", F.length("text").cast("long")).withColumn(
        "bucket", F.explode("buckets")
    )
    of_bucket = stored(
        travelling.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("letters").alias("letters")), "buckets"
    ).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("letters") / block_letters)).cast("int"))
    small = of_bucket.filter("blocks = 1").agg(F.sum("letters")).first()[0] or 0
    tasks = max(1, math.ceil(small / TASK_LETTERS))
    cut = (
        travelling.drop("letters").join(of_bucket.select("bucket", "blocks"), "bucket")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    )
    # A task's number: those of small buckets are shared, each pair of blocks has its own.
    place = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("bucket"), F.lit(tasks)).cast("string")).otherwise(
        F.concat_ws("-", F.hex("bucket"), "i", "j")
    )
    ratio = Fraction(similarity).limit_denominator(10**6)
    over, under = ratio.numerator, ratio.denominator

    def compare(bucket: int, rows: list[dict]) -> Iterator[tuple[bytes, bytes, int]]:
        rows = sorted({r["node"]: r for r in rows}.values(), key=lambda r: (r["own"], r["node"]))
        i, j = rows[0]["i"], rows[0]["j"]
        sets = shingles([folded_words(r["text"]) for r in rows], size)
        sizes = np.array([len(s) for s in sets], np.int64)
        counts = np.array([r["count"] for r in rows], np.int64)
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        marked = np.zeros(len(flat), np.int32)
        links = np.zeros(len(rows), np.int64)
        root = list(range(len(rows)))
        # The buckets in front of this one that a row is in, as columns of a table.
        earlier = [[b for b in r["buckets"] if b < bucket] for r in rows]
        column = {b: k for k, b in enumerate(sorted({b for own in earlier for b in own}))}
        shared = np.zeros((len(rows), len(column)), bool)
        for x, own in enumerate(earlier):
            shared[x, [column[b] for b in own]] = True

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        border = sum(r["own"] == i for r in rows) if i != j else len(rows)
        for x in range(border):
            first = border if i != j else x + 1
            fresh = ~shared[first:][:, shared[x]].any(1)
            if not fresh.any():
                continue
            others = np.flatnonzero(fresh) + first
            own = flat[bounds[x] : bounds[x + 1]]
            marked[own] = 1
            rest = marked[flat[bounds[first] :][np.repeat(fresh, sizes[first:])]]
            common = np.add.reduceat(rest, np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
            marked[own] = 0
            union = sizes[x] + sizes[others] - common
            for y in others[common.astype(np.int64) * under >= union * over].tolist():
                links[x] += counts[y]
                links[y] += counts[x]
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
        for x, r in enumerate(rows):
            yield r["node"], rows[find(x)]["node"], int(links[x])

    def of_task(table: pa.Table) -> pa.Table:
        groups: dict[int, list[dict]] = {}
        for r in table.to_pylist():
            groups.setdefault(r["bucket"], []).append(r)
        found = [row for bucket, rows in groups.items() for row in compare(bucket, rows)]
        columns = list(zip(*found)) or [[], [], []]
        return pa.table(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())],
            names=["node", "root", "links"],
        )

    return (
        cut.select("bucket", "node", "buckets", "count", "text", "own", "i", "j", place.alias("task"))
        .groupBy("task")
        .applyInArrow(of_task, "node binary, root binary, links long")
    )


def near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    size: int = SIZE,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    block: int = BLOCK,
    block_letters: int = BLOCK_LETTERS,
) -> DataFrame:
    """Every document with its class of near copies and the number of documents it links to.

    Two documents link if the Jaccard index of their sets of ``size`` consecutive lower-cased
    words reaches ``similarity``; a text with fewer words has one n-gram of all of them. A
    class is what links connect. Returns the id, ``digest`` (crc32 of the text), ``class_id``
    (the smallest id of the class), ``class_size`` and ``n_links``, one row for each input row.
    Texts without words, or null, link to nothing, and are a class of their own each, without
    a ``node``. A null id comes behind all others. Equal sets are found always, others with
    the recall that the bands are chosen for.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    bands, rows = banding(similarity, recall)
    signed = stored(signatures(own, size, bands, rows), "signatures")
    smallest = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    nodes = stored(
        signed.filter("node is not null")
        .groupBy("node")
        .agg(F.min(smallest).alias("first"), F.count("*").alias("count"), F.first("bands").alias("bands")),
        "nodes",
    )
    chosen = candidate_buckets(nodes).join(nodes, "node").select(
        "node", "buckets", "count", F.col("first.id").alias("first_id"), F.col("first.digest").alias("first_digest")
    )
    texts = own.select("id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")
    members = chosen.join(
        texts, F.col("first_id").eqNullSafe(F.col("id")) & (F.col("first_digest") == F.col("digest"))
    ).select("node", "buckets", "count", "text")
    # Written, as its letters are counted before they travel.
    members = stored(members, "members")
    checked = stored(verified(members, size, similarity, block, block_letters), "verified")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    forest = checked.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b")
    labels = components(forest)
    known = (
        nodes.select("node", "first", "count")
        .join(links, "node", "left")
        .join(labels, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    classes = known.groupBy("label").agg(F.min("first").alias("first"), F.sum("count").alias("class_size"))
    placed = known.select("node", "label", "count", "links").join(
        classes.select(
            "label",
            F.col("first.id").alias("class_id"),
            F.col("first.digest").alias("class_digest"),
            "class_size",
        ),
        "label",
    )
    return (
        signed.select("id", "digest", "node")
        .join(placed, "node", "left")
        .select(
            F.col("id").alias(id_column),
            "digest",
            F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("class_size", F.lit(1)).alias("class_size"),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("count") - 1, F.lit(0))).alias("n_links"),
            (
                F.col("label").isNull()
                | (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest")))
            ).alias("kept"),
        )
    )


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One document of each class, the one with the smallest id; all columns kept.

    Rows that share that id and text stay alike.
    """
    gone = (
        near_copies(docs, id_column, text_column, **options)
        .filter(~F.col("kept"))
        .select(F.col(id_column).alias("gone_id"), F.col("digest").alias("gone_digest"))
        .distinct()
    )
    digest = F.crc32(F.coalesce(docs[text_column], F.lit("")).cast("binary"))
    return docs.join(
        gone, docs[id_column].eqNullSafe(gone["gone_id"]) & (digest == gone["gone_digest"]), "left_anti"
    )
