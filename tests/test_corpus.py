import pytest
from pyspark.sql import functions as F

from tandemtext.functions import text
from tandemtext.operators import corpus
from tandemtext.sources import files


def test_flatten_map_and_struct(spark):
    maps = spark.createDataFrame([(1, {"en": "a", "es": "b"}), (2, {"en": "c"})],
                                 "id INT, translation MAP<STRING,STRING>")
    flat = corpus.flatten_translation(maps, "en", "es", name="books")
    assert sorted(map(tuple, flat.collect())) == [("books-1", "a", "b"), ("books-2", "c", None)]
    with pytest.raises(Exception, match="no language es in row 2"):
        corpus.flatten_translation(maps, "en", "es", strict=True).collect()
    structs = spark.sql("SELECT 1 AS id, named_struct('en', 'a', 'es', 'b') AS translation")
    assert tuple(corpus.flatten_translation(structs, "en", "es").first()) == ("1", "a", "b")
    with pytest.raises(Exception):
        corpus.flatten_translation(structs, "en", "fr").collect()


def test_union_keeps_duplicates(spark):
    raw = spark.createDataFrame([("1", {"en": "a", "es": "b"})],
                                "id STRING, translation MAP<STRING,STRING>")
    both = corpus.union_corpora({"x": raw, "y": raw.union(raw)}, "en", "es")
    assert sorted(r["id"] for r in both.collect()) == ["x-1", "y-1", "y-1"]


def test_quality_filter_counts_code_points_of_the_source_only(spark):
    rows = [
        ("nine char", "x"), ("ten chars!", "x"), ("ñandú🙂🙂🙂🙂🙂", "x"), ("same text here", "same text here"),
        (None, "x"), ("long enough text", None), ("short", "a very long target text"),
    ]
    df = spark.createDataFrame(rows, "en STRING, es STRING")
    kept = {r["en"] for r in corpus.quality_filter(df, "en", "es").collect()}
    assert kept == {"ten chars!", "ñandú🙂🙂🙂🙂🙂"}


def test_both_strings(spark):
    df = spark.createDataFrame([("a", "b", 1), (None, "b", 2), ("a", None, 3)], "x STRING, y STRING, n INT")
    assert corpus.both_strings(df, "x", "y").count() == 1
    assert corpus.both_strings(df, "x", "n").count() == 0
    mixed = spark.createDataFrame([('"s"',), ("1",), ("null",), (None,)], "j STRING").select(
        F.parse_json("j").alias("v"), F.lit("t").alias("t"))
    assert corpus.both_strings(mixed, "v", "t").count() == 1


def test_valid_as_test_drops_the_test_rows(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "valid")], "id INT, split STRING")
    found = sorted(map(tuple, corpus.alias_valid_as_test(df).collect()))
    assert found == [(1, "train"), (3, "test"), (3, "valid")]


def test_text_functions(spark):
    df = spark.createDataFrame([("\t a b \n",), ("Generated Translation: x",), (None,)], "t STRING")
    rows = df.select(
        text.strip(F.col("t")).alias("s"),
        text.without_prefix(F.col("t"), "Generated Translation: ").alias("w"),
        text.prompt("task", "t").alias("p"),
    ).collect()
    assert [r["s"] for r in rows] == ["a b", "Generated Translation: x", None]
    assert [r["w"] for r in rows] == ["\t a b \n", "x", None]
    assert rows[2]["p"] == "task: None"
    wide = spark.createDataFrame([("  x\x1c　",)], "t STRING")
    assert wide.select(text.strip(F.col("t"))).first()[0] == "  x\x1c　".strip()
    assert text.output_name(["data/pairs_a", "data/pairs_b"]) == "pairs_a_pairs_b"
    assert df.select(text.last_segment(F.lit("hub/flan-t5"))).first()[0] == "flan-t5"


def test_cut_words_early_and_exact(spark):
    df = spark.createDataFrame([("uno dos, tres",)], "t STRING")
    row = df.select(
        text.cut_words(F.col("t"), 3).alias("early"),
        text.cut_words(F.col("t"), 3, exact=True).alias("exact"),
        text.cut_words(F.col("t"), 99, exact=True).alias("all"),
    ).first()
    # Three words of 3, 3 and 1 characters: seven characters, blanks not counted.
    assert tuple(row) == ("uno dos", "uno dos,", "uno dos, tres")


def test_a_missing_language_stays_missing_after_reading(spark, tmp_path):
    rows = [("1", {"en": "a", "es": "b", "fr": "c"}), ("2", {"en": "a"})]
    spark.createDataFrame(rows, "id STRING, translation MAP<STRING,STRING>").write.parquet(str(tmp_path / "t"))
    read = files.read_language_pair(spark, str(tmp_path / "t"), "en", "es")
    assert {r["id"]: r["translation"] for r in read.collect()} == {"1": {"en": "a", "es": "b"}, "2": {"en": "a"}}
    with pytest.raises(Exception):
        corpus.flatten_translation(read, "en", "es", strict=True).collect()


def test_words_by_hand(spark):
    told = {
        "It's 3.5 km!": ["It", "'", "s", "3", ".", "5", "km", "!"],
        "naïve_x Ünï 日本語": ["naïve_x", "Ünï", "日本語"],
        " -- a\tb\n": ["-", "-", "a", "b"],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in told], "t STRING")
    found = {r["t"]: r["w"] for r in df.select("t", text.words(F.col("t")).alias("w")).collect()}
    assert found == told
