import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandemtext.operators import ordering
from tandemtext.sources import files


def sizes(df, **options):
    rows = ordering.exact_split(df, "id", **options).groupBy("split").count().collect()
    found = {row["split"]: row["count"] for row in rows}
    return tuple(found.get(name, 0) for name in ("train", "test", "valid"))


@pytest.mark.parametrize("n, wanted", [
    (88, (61, 14, 13)),
    (1000, (700, 150, 150)),
    (1_699_661, (1_189_762, 254_950, 254_949)),
    (0, (0, 0, 0)), (1, (0, 1, 0)), (2, (1, 1, 0)), (3, (2, 1, 0)),
])
def test_sizes_from_a_train_fraction(spark, n, wanted):
    assert sizes(spark.range(n)) == wanted


def test_sizes_from_a_held_out_fraction(spark):
    found = sizes(spark.range(1_904_898), test_size=0.3)
    assert found == (1_333_428, 285_735, 285_735)


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 400), st.sampled_from([0.0, 0.1, 0.5, 0.7, 0.99, 1.0]))
def test_every_row_gets_one_split_of_exact_size(spark, n, fraction):
    train = int(n * fraction)
    test = -(-(n - train) // 2)
    found = sizes(spark.range(n), train_size=fraction)
    assert found == (train, test, n - train - test)


def test_split_does_not_depend_on_partitions(spark):
    ids = spark.range(500)
    one = ordering.exact_split(ids.coalesce(1), "id")
    many = ordering.exact_split(ids.repartition(7), "id")
    assert sorted(one.collect()) == sorted(many.collect())
    other = ordering.exact_split(ids, "id", seed=1)
    assert sorted(one.collect()) != sorted(other.collect())


def test_cut_between_equal_keys_is_an_error_and_never_inexact(spark):
    same = spark.range(10).select(F.lit(1).alias("id"))
    with pytest.raises(Exception, match="not unique"):
        ordering.exact_split(same, "id").collect()


def test_a_hot_key_away_from_the_cuts_does_no_harm(spark):
    # All copies sort behind every other row of this seed or in front of it.
    hot = spark.range(100).select(F.lit(-1).alias("id"))
    ids = spark.range(300).select(F.col("id").cast("int").alias("id")).union(hot)
    for seed in range(20):
        key = ordering.order_key("id", seed)
        behind = ids.where("id = -1").select(key).first()[0] > \
            ids.where("id >= 0").agg(F.max(key)).first()[0]
        if behind:
            break
    members = ordering.exact_split(ids, "id", train_size=0.5, seed=seed)
    assert members.where("split = 'train'").count() == 200


def test_rows_without_a_key_get_one_from_their_file(spark, tmp_path):
    spark.range(100).select(F.lit("same").alias("t")).repartition(4).write.parquet(str(tmp_path / "t"))
    keyed = files.with_row_key(spark.read.parquet(str(tmp_path / "t")))
    assert keyed.select("row_key").distinct().count() == 100
    split = ordering.exact_split(keyed, "row_key")
    assert split.where("split = 'train'").count() == 70


def test_samples_of_any_size(spark):
    """The same rule on both sides of any size: smaller samples are inside larger ones."""
    ids = spark.range(20_000)
    small, large = (ordering.sample_rows(ids, "id", n).collect() for n in (37, 10_001))
    assert (len(small), len(large)) == (37, 10_001)
    assert set(small) < set(large)
    assert ordering.sample_rows(ids, "id", 50_000).count() == 20_000


@pytest.mark.parametrize("n", [5, 10_001])
def test_samples_do_not_cut_between_equal_keys(spark, n):
    twice = spark.range(20_000).select((F.col("id") % 10_000 * 0).alias("id"))
    with pytest.raises(Exception, match="not unique"):
        ordering.sample_rows(twice, "id", n).collect()


def test_cuts_in_refined_buckets(spark, monkeypatch):
    ids = spark.range(3000)
    wanted = sorted(ordering.sample_rows(ids, "id", 1234).collect())
    for digits in ((1,), (1, 1), (2, 2, 2)):
        monkeypatch.setattr(ordering, "BUCKET_DIGITS", digits)
        assert sorted(ordering.sample_rows(ids, "id", 1234).collect()) == wanted


def test_preview_stops_after_number_n(spark):
    ids = spark.range(50)
    assert [r["i"] for r in ordering.preview_rows(ids, "id", n=5).collect()] == [0, 1, 2, 3, 4, 5]
    assert ordering.preview_rows(ids, "id", n=5, inclusive=False).count() == 5


def test_rows_at_positions(spark):
    ids = spark.range(100, 20_200).repartition(5)
    wanted = [(134, 34), (158, 58), (12_100, 12_000)]
    found = ordering.rows_at(ids, [34, 58, 12_000, 90_000], "id").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_rows_at_positions_of_ties(spark):
    """Ties come in one order, whatever the position and the partitions."""
    rows = spark.range(500).select((F.col("id") % 2).alias("k"), "id")
    every = {r["row_index"]: r["id"] for r in ordering.rows_at(rows, range(500), "k").collect()}
    assert sorted(every.values()) == list(range(500))
    again = ordering.rows_at(rows.repartition(7), [5, 400], "k").collect()
    assert {r["row_index"]: r["id"] for r in again} == {5: every[5], 400: every[400]}
    copies = spark.range(30).select(F.lit(1).alias("k"))
    assert sorted(map(tuple, ordering.rows_at(copies, [3, 4], "k").collect())) == [(1, 3), (1, 4)]


def test_row_index_numbers_equal_keys_without_gaps(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    found = sorted(files.with_row_index(rows, "k").collect(), key=lambda r: r["row_index"])
    assert [r["row_index"] for r in found] == list(range(1000))
    assert [r["k"] for r in found] == [0] * 500 + [1] * 500
    again = files.with_row_index(rows.repartition(5), "k").collect()
    assert sorted(again) == sorted(found)


def test_unseeded_shuffle_keeps_all_rows(spark):
    assert sorted(r["id"] for r in ordering.shuffle(spark.range(100), "id").collect()) == list(range(100))


@pytest.mark.parametrize("splitters, ranked", [(4, 8), (1, 1), (16, 100), (1024, 1 << 14)])
def test_positions_by_few_splitters(spark, monkeypatch, splitters, ranked):
    """Nulls, strings, a key that most rows have: the positions of a sort, at any fineness."""
    monkeypatch.setattr(ordering, "SPLITTERS", splitters)
    monkeypatch.setattr(ordering, "RANKED_ROWS", ranked)
    words = ["b", None, "ä", "", "b", "a" * 50]
    rows = [(words[i % 6] if i % 3 else "hot", i % 7 - 3.5 if i % 5 else None, i) for i in range(300)]
    df = spark.createDataFrame(rows, "`w.x` string, d double, i long").repartition(4)
    wanted = files.with_row_index(df.withColumnRenamed("w.x", "w"), "w", "d").collect()
    at = [0, 1, 99, 150, 298, 299, 300, -1]
    found = {r["row_index"]: r for r in ordering.rows_at(df, at, "w.x", "d").collect()}
    assert sorted(found) == [p for p in sorted(at) if 0 <= p < 300]
    keys = {r["row_index"]: (r["w"], r["d"]) for r in wanted}
    assert all((r["w.x"], r["d"]) == keys[p] for p, r in found.items())
    assert len({r["i"] for r in found.values()}) == len(found)
    assert ordering.rows_at(df.limit(0), at, "d").collect() == []


def test_positions_are_found_without_a_sort(spark):
    plan = ordering.rows_at(spark.range(1000), [7], "id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_seeded_shuffle_is_read_in_written_order(spark, tmp_path):
    ids = spark.range(3000).repartition(5)
    ordering.seeded_shuffle(ids, "id", seed=9, partitions=7).write.parquet(str(tmp_path / "s"))
    found = files.in_written_order(spark, str(tmp_path / "s")).orderBy("row_index").collect()
    key = {r["id"]: r["k"] for r in ids.select("id", ordering.order_key("id", 9).alias("k")).collect()}
    assert [r["id"] for r in found] == sorted(key, key=key.get)
    assert [r["row_index"] for r in found] == list(range(3000))
    plan = ordering.seeded_shuffle(ids, "id")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
