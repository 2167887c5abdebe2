"""Dictionary-encoded lookups of tokens, and subword ids against a public tokenizer."""

import base64
import re
import time

import pytest
import tiktoken
from pyspark.sql import functions as F

from tandemtext.functions import encode, subwords

FOLDER = "/opt/tokenizers"
ODD = [
    None,
    "",
    " ",
    "\n\n  \t x",
    "It's we'll 12345, ÄÖÜ ßß — 中文字 😀😀   end  ",
    "a" * 3000 + " " + "ab" * 2000,
    "<|endoftext|> \x1c\x1d \u0085 é",
]


def public(name):
    lines = [line.split() for line in open(f"{FOLDER}/{name}", "rb")]
    ranks = {base64.b64decode(piece): int(rank) for piece, rank in lines}
    return ranks, tiktoken.Encoding("own", pat_str=subwords.WORDS, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_subwords(spark, sf_small, name):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string")
    both = docs.union(odd).withColumn("again", F.reverse("text"))
    ranks = subwords.read_ranks(spark, f"{FOLDER}/{name}")
    encoded = subwords.encode_subwords(both, {"ids": "text", "again_ids": "again"}, ranks)
    _, known = public(name)
    rows = encoded.collect()
    assert len(rows) == both.count()
    for r in rows:
        wanted = None if r.text is None else known.encode_ordinary(r.text)
        assert r.ids == wanted, r.doc_id
        assert r.again_ids == (None if r.text is None else known.encode_ordinary(r.again))
    back = subwords.decode_subwords(encoded, {"b": "ids", "c": "again_ids"}, ranks).collect()
    assert all((r.b, r.c) == (r.text, r.again) for r in back)


def test_words_of_subwords_are_the_text(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string")
    for r in df.select("t", F.array_join(subwords.subword_words(F.col("t")), "").alias("j")).collect():
        assert r.j == r.t


def test_merges_by_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"abc": 302, b"aa": 299}
    cut = subwords.merger(ranks)
    assert cut(b"abc") == [302]
    assert cut(b"abcd") == [302, 100]  # b and c first, then a with both
    assert cut(b"abbc") == [301, 300]
    assert cut(b"aaaab") == [299, 299, 98]
    assert cut(b"aaab") == [299, 301]
    assert cut(b"") == []


def test_a_vocabulary_has_all_bytes(spark):
    few = spark.createDataFrame([(b"a", 0)], "piece binary, id int")
    with pytest.raises(ValueError, match="without the bytes"):
        subwords.encode_subwords(spark.createDataFrame([("a",)], "t string"), {"ids": "t"}, few)


@pytest.mark.parametrize("most", [1, 7, 50, 1 << 18])
def test_lookup_in_stretches(spark, monkeypatch, most):
    """Stretches of any size give the same; nulls, empty arrays, repeated rows, odd names."""
    monkeypatch.setattr(encode, "CHUNK_ITEMS", most)
    rows = [(i % 5, " ".join(f"w{i * j % 17}" for j in range(i % 9)) or None, "v x w1" if i % 3 else "") for i in range(60)]
    df = spark.createDataFrame(rows, "`k.x` int, `chunk` string, `row` string").repartition(3)
    table = encode.build_vocabulary(df.select("chunk"))
    ids = {r.token: r.id for r in table.collect()}
    encoded = encode.encode_texts(df, {"values": "chunk", "items": "row"}, table)
    assert encoded.columns == ["k.x", "chunk", "row", "values", "items"]
    found = encoded.collect()
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r[:3])) for r in found)
    for r in found:
        assert r["values"] == (None if r.chunk is None else [ids[w] for w in r.chunk.split()])
        assert r["items"] == [ids.get(w, encode.UNK) for w in r.row.split()]
    cut = encode.encode_texts(df, {"two": "chunk"}, table, first=2).collect()
    assert all(r.two == (None if r.chunk is None else [ids[w] for w in r.chunk.split()][:2]) for r in cut)
    back = encode.decode_ids(encoded, {"a": "values", "b": "items"}, table).collect()
    for r in back:
        assert r.a == r.chunk
        assert r.b == " ".join(w for w in r.row.split() if w in ids)


def test_lookup_of_no_rows_and_null_items(spark):
    table = encode.build_vocabulary(spark.createDataFrame([("a b",)], "t string"))
    none = spark.createDataFrame([], "t string")
    assert encode.encode_texts(none, {"ids": "t"}, table).collect() == []
    holes = spark.createDataFrame([([3, None, 4],), ([None],), (None,)], "ids array<int>")
    found = [r.w for r in encode.decode_ids(holes, {"w": "ids"}, table).collect()]
    assert found == ["a b", "", None]


def test_only_distinct_tokens_are_joined(spark, sf_small):
    """Of the rows that meet the vocabulary there are far fewer than tokens."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    table = encode.build_vocabulary(docs.select("text"))
    encoded = encode.encode_texts(docs, {"ids": "text"}, table)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Generate", plan)) == 2  # distinct items of a stretch, and its rows
    tokens = encoded.agg(F.sum(F.size("ids"))).first()[0]
    chunks = encode._chunks(docs, {"ids": encode.words(F.col("text"))}, "string")
    assert chunks.agg(F.sum(F.size("items"))).first()[0] < tokens / 3


def test_short_rows_of_many_words(spark):
    """A stretch holds its values once, and not beside each of its many short rows."""
    words = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.concat_ws("_", F.lit("w"), "id", i))
    rows = spark.range(0, 10_000, 1, 1).select("id", F.array_join(words, " ").alias("t"))
    number = F.col("id") * 25 + F.col("pos") + 3
    known = rows.select("id", F.posexplode(F.split("t", " ")).alias("pos", "token")).select(
        "token", number.alias("id")
    )
    encoded = encode.encode_texts(rows, {"ids": "t"}, known)
    back = encode.decode_ids(encoded, {"again": "ids"}, known)
    right = (F.col("again") == F.col("t")) & (F.get("ids", F.lit(24)) == F.col("id") * 25 + 27)
    assert back.agg(F.count("*"), F.count_if(right)).first() == (10_000, 10_000)



def test_columns_that_stay(spark):
    df = spark.createDataFrame([(1, "b a", None), (2, None, "c"), (3, "", "a zz")], "k int, t string, u string")
    known = spark.createDataFrame([("a", 3), ("b", 4), ("c", 5)], "token string, id int")
    found = encode.encode_texts(df, {"x": "t", "y": "u"}, known, keep=["k"])
    assert found.columns == ["k", "x", "y"]
    assert sorted(map(tuple, found.collect())) == [(1, [4, 3], None), (2, None, [5]), (3, [], [3, 2])]
    assert encode.encode_texts(df, {"x": "t"}, known, keep=[]).columns == ["x"]


def test_a_corpus_in_its_own_vocabulary(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*ODD, "the cat the dog", "dog, dog", None, "x"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted_known = encode.build_vocabulary(docs.select("text"))
    wanted = encode.encode_texts(docs, {"ids": "text"}, wanted_known, keep=["doc_id"])
    # Words are found once: no pass for the vocabulary alone. Stretches end within the rows.
    monkeypatch.setattr(encode, "build_vocabulary", None)
    monkeypatch.setattr(encode, "CHUNK_ITEMS", 7)
    encoded, known = encode.encode_corpus(docs, {"ids": "text"}, keep=["doc_id"])
    assert sorted(known.collect()) == sorted(wanted_known.collect())
    assert known.schema == wanted_known.schema
    assert sorted(encoded.collect(), key=lambda r: r.doc_id) == sorted(wanted.collect(), key=lambda r: r.doc_id)
    back = encode.decode_ids(encoded, {"words": "ids"}, known, keep=["doc_id"])
    assert back.columns == ["doc_id", "words"]
    found = {r.doc_id: r.words for r in back.collect()}
    assert found == {r.doc_id: r.words for r in encode.decode_ids(wanted, {"words": "ids"}, wanted_known).collect()}


@pytest.mark.parametrize("name", ["encoded_documents", "decoded_documents"])
def test_documents_find_their_words_once(spark, sf_small, monkeypatch, name):
    from tandemtext.plans import queries

    monkeypatch.setattr(encode, "build_vocabulary", None)
    assert queries.QUERIES[name](spark, sf_small).count() == spark.read.parquet(f"{sf_small}/documents.parquet").count()


def test_stretches_go_on_over_batches(spark, monkeypatch):
    """A stretch has its items and not one batch; its rows are kept in fewer bytes than ids have."""
    rows = spark.range(0, 4_000, 1, 1).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * i % 977) for i in range(20)]).alias("t"))
    empty = spark.range(4_000, 4_100, 1, 1).select("id", F.lit("").alias("t"))
    docs = rows.union(empty).coalesce(1)
    monkeypatch.setattr(encode, "CHUNK_ITEMS", 30_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        columns = {"ids": encode.words(F.col("t")), "again": encode.words(F.reverse("t"))}
        chunks = encode._chunks(docs, columns, "string", ["id"], counted=True)
        found = chunks.select("chunk", "items", "uses", F.expr("aggregate(parts, 0, (n, p) -> n + length(p))").alias("bytes")).collect()
        assert len(found) == len({r.chunk for r in found}) == 6  # 160,000 items
        assert sum(sum(r.uses) for r in found) == 160_000
        assert all(r["items"] == sorted(set(r["items"])) and len(r["items"]) == len(r.uses) for r in found)
        assert sum(r.bytes for r in found) < 2.5 * 160_000
        # Rows without items wait no longer than their bytes allow.
        monkeypatch.setattr(encode, "CHUNK_BYTES", 1)
        assert encode._chunks(docs, columns, "string", ["id"]).count() == 41
        known = encode.build_vocabulary(docs.select("t"))
        ids = {r.token: r.id for r in known.collect()}
        for r in encode.encode_texts(docs, {"x": "t"}, known).collect():
            assert r.x == [ids[w] for w in r.t.split()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    from tandemtext.session import CLEANUP_KEY, shuffles_dropped

    before = spark.conf.get(CLEANUP_KEY, None)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        names = tracker.getAllFiles().mkString(",").split(",")
        return {name for name in names if name.endswith((".data", ".index"))}

    old, rows = held(), spark.range(0, 10_000, 1, 4).repartition(4, "id")
    with shuffles_dropped(spark):
        rows.write.parquet(str(tmp_path / "kept"))
    for _ in range(50):  # they are deleted behind the query
        if not (left := held() - old):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP_KEY, None) == before
    assert spark.read.parquet(str(tmp_path / "kept")).count() == rows.count() == 10_000


@pytest.mark.parametrize("name", ["encoded_repeat_examples", "encoded_preference_examples"])
def test_scored_rows_are_encoded_as_they_come(spark, tmp_path, monkeypatch, name):
    """Scores are read once, so no table of them is stored beside the stretches."""
    from tandemtext.plans import inputs, queries

    text = "\n".join(f"a line with number {i}, of {i % 3} kinds" for i in range(6))
    docs = [(i, "en", "src1", text.replace("line", f"line{i}")) for i in range(4)]
    spark.createDataFrame(docs, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(1, 0, "user", "what is the first one?"), (1, 1, "assistant", "the first one is this")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(inputs, "stored_splits", None)
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 21
