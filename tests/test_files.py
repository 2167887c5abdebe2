from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tandemtext import session
from tandemtext.functions import encode
from tandemtext.plans import jobs
from tandemtext.session import shared_folder
from tandemtext.sources import files

AWKWARD = ['plain', 'a "quoted" word', 'two\nlines', 'comma, here', 'tab\there', 'ñ🙂', ' spaced ']


def test_csv_keeps_awkward_text(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(AWKWARD)), "i INT, t STRING")
    files.write_csv(df, str(tmp_path / "csv"))
    read = files.read_csv(spark, str(tmp_path / "csv"), "i INT, t STRING")
    assert sorted(map(tuple, read.collect())) == list(enumerate(AWKWARD))


def test_csv_index_column_has_no_name(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "t STRING, n INT").coalesce(1)
    files.write_csv(df, str(tmp_path / "csv"), index_by=["n"])
    [part] = (tmp_path / "csv").glob("*.csv")
    assert part.read_text().splitlines() == [",t,n", "0,a,1", "1,b,2"] or \
        part.read_text().splitlines() == ['"",t,n', "0,a,1", "1,b,2"]


def test_sentences_have_no_header(spark, tmp_path):
    (tmp_path / "s.txt").write_text("First one.\nSecond, one.\n")
    read = files.read_sentences(spark, str(tmp_path / "s.txt"))
    assert [r["English"] for r in read.collect()] == ["First one.", "Second, one."]


def test_split_dictionary_reads_one_split_from_its_directory(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 7, "train").otherwise("valid"))
    files.write_splits(df, str(tmp_path / "d"))
    valid = files.read_splits(spark, str(tmp_path / "d"), "valid")
    assert valid.count() == 3
    plan = valid._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_merged_tables_are_named_after_their_parts(spark, tmp_path):
    paths = []
    for model in ("a", "b"):
        df = spark.range(5).select("id", F.lit("train").alias("split"), F.lit(model).alias(model))
        paths.append(str(tmp_path / f"pairs_{model}"))
        files.write_splits(df, paths[-1])
    out = jobs.merge_scored(spark, paths, str(tmp_path))
    assert out.endswith("/pairs_a_pairs_b")
    assert set(files.read_splits(spark, out).columns) == {"id", "a", "b", "split"}


def test_plain_corpus(spark):
    rows = [("k1", "a long source text", "una"), ("k2", None, "dos"), ("k3", "same text same", "same text same")]
    df = spark.createDataFrame(rows, "id STRING, sp STRING, nah STRING")
    out = jobs.build_plain_corpus(df, "sp", "nah")
    assert [r["id"] for r in out.collect()] == ["k1"]


def test_fixed_length_and_mask(spark):
    df = spark.createDataFrame([([7, 8, 9],), ([],), (list(range(10, 20)),)], "ids ARRAY<INT>")
    rows = df.select(
        encode.fixed_length(F.col("ids"), 5).alias("plain"),
        encode.fixed_length(F.col("ids"), 5, eos=1).alias("ended"),
        encode.attention_mask(F.col("ids"), 5, eos=1).alias("mask"),
    ).collect()
    assert [r["plain"] for r in rows] == [[7, 8, 9, 0, 0], [0] * 5, [10, 11, 12, 13, 14]]
    assert [r["ended"] for r in rows] == [[7, 8, 9, 1, 0], [1, 0, 0, 0, 0], [10, 11, 12, 13, 1]]
    assert [r["mask"] for r in rows] == [[1, 1, 1, 1, 0], [1, 0, 0, 0, 0], [1] * 5]
    labels = spark.createDataFrame([([5, -100, -100],)], "l ARRAY<INT>")
    assert labels.select(encode.without_ignored(F.col("l"))).first()[0] == [5, 0, 0]


def test_vocabulary_round_trip(spark):
    texts = spark.createDataFrame([(1, "b b b a a c"), (2, ""), (3, None)], "id INT, t STRING")
    table = encode.build_vocabulary(texts.select("t"), max_size=2)
    assert sorted(map(tuple, table.collect())) == [(3, "b", 3), (4, "a", 2)]
    encoded = encode.encode_texts(texts, {"ids": "t", "again": "t"}, table)
    words = encode.decode_ids(encoded, {"words": "ids"}, table)
    rows = {r["id"]: r for r in encode.decode_ids(words, {"all": "ids"}, table, skip_special=False).collect()}
    assert rows[1]["ids"] == rows[1]["again"] == [3, 3, 3, 4, 4, 2]
    assert (rows[1]["words"], rows[1]["all"]) == ("b b b a a", "b b b a a <unk>")
    assert (rows[2]["ids"], rows[2]["words"]) == ([], "")
    assert (rows[3]["ids"], rows[3]["words"]) == (None, None)


def test_vocabulary_keeps_every_word(spark):
    texts = spark.range(300_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("t"))
    table = encode.build_vocabulary(texts)
    assert table.count() == 300_000
    some = spark.createDataFrame([(0, "w7 w299999 w300000")], "id INT, t STRING")
    ids = encode.encode_texts(some, {"ids": "t"}, table).first()["ids"]
    assert min(ids[:2]) > 2 and ids[2] == encode.UNK


def test_injected_tokenizer(spark):
    def load():
        return lambda texts: [[ord(c) for c in t] for t in texts]

    df = spark.createDataFrame([("ab",)], "t STRING")
    assert df.select(encode.encode_with(load, F.col("t"))).first()[0] == [97, 98]


def test_only_local_sessions_make_a_shared_folder(tmp_path):
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda key, default: folder)
        return SimpleNamespace(conf=conf, sparkContext=Context(master))

    assert shared_folder(session("spark://host", "hdfs://x/y/")) == "hdfs://x/y"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host"))
    local = session("local[2]")
    assert shared_folder(local) == local.sparkContext.folder


def test_sentences_of_several_lines_and_none(spark, tmp_path):
    told = ["one", "", "two\nlines", "a \"quoted\" one", "\r\n", " ends ", None]
    files.write_sentences(spark.createDataFrame([(t,) for t in told], "t STRING"), str(tmp_path / "s"))
    read = files.read_sentences(spark, str(tmp_path / "s"), multi_line=True)
    assert {r["English"] for r in read.collect()} == set(told) and read.count() == len(told)


def test_csv_read_by_lines(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("a, \"b\" "), "id").alias("t"))
    files.write_csv(df, str(tmp_path / "c"))
    read = files.read_csv(spark, str(tmp_path / "c"), "id BIGINT, t STRING", multi_line=False)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, df.collect()))


def test_equal_rows_are_numbered_in_several_files(spark):
    """Copies of one row don't end in one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000, numPartitions=8).select(F.lit(1).alias("k"))
        found = files.with_row_index(rows, "k")
        assert found.select(F.countDistinct("row_index"), F.max("row_index")).first() == (40_000, 39_999)
        assert len(set(found.inputFiles())) > 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scratch_tables_can_be_cleared(spark):
    path = session.scratch_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert session.clear_scratch(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    assert session.clear_scratch(spark) == 0


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    """The table of splits goes to the lines, however large it is taken to be."""
    lines = spark.range(1000).select(F.lit("a").alias("file"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("value"))
    files.write_log_lines(lines, str(tmp_path / "logs"), parts=5)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = files.read_log_lines(spark, str(tmp_path / "logs/log=*/*.txt"), files.written_log(F.col("file")))
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert read.agg(F.count("*"), F.count_if(F.col("value") == F.col("line_no"))).first() == (1000, 1000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
