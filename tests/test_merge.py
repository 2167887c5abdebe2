import pytest
from pyspark.sql import functions as F

from tandemtext.operators import merge
from tandemtext.operators.merge import attach_columns, natural_merge
from tandemtext.sources.files import write_bucketed


def test_null_keys_match_and_missing_rows_drop_out(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "id INT, `flan-t5.v1` STRING")
    b = spark.createDataFrame([(1, 0.5), (None, 0.7), (4, 0.9)], "id INT, `b-score` DOUBLE")
    merged = natural_merge([a, b])
    assert merged.columns == ["id", "flan-t5.v1", "b-score"]
    assert sorted(map(tuple, merged.collect()), key=str) == [(1, "x", 0.5), (None, "y", 0.7)]


def test_duplicate_keys_multiply(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "id INT, a STRING")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "id INT, b STRING")
    assert natural_merge([a, b]).count() == 4


def test_all_shared_columns_are_keys_and_order_does_not_matter(spark):
    a = spark.createDataFrame([(1, "s", "m1")], "id INT, en STRING, m1 STRING")
    b = spark.createDataFrame([(1, "s", "m2"), (1, "other", "m2")], "id INT, en STRING, m2 STRING")
    c = spark.createDataFrame([("m2", 7)], "m2 STRING, n INT")
    forth = natural_merge([a, b, c])
    assert [tuple(r) for r in forth.collect()] == [(1, "s", "m1", "m2", 7)]
    back = natural_merge([b, a, c]).select(forth.columns)
    assert back.collect() == forth.collect()
    with pytest.raises(ValueError):
        natural_merge([a, c.drop("m2")])


def test_tables_joined_on_the_same_keys_are_shuffled_once_each(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [
            spark.range(100).select("id", F.col("id").cast("string").alias("en"), F.lit(i).alias(f"m{i}"))
            for i in range(3)
        ]
        plan = natural_merge(parts)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_attached_columns_keep_every_row(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b")], "i INT, English STRING")
    long = spark.createDataFrame([(0, "x.log", "t")], "i INT, file STRING, v STRING")
    out = attach_columns(left, long, "i", "file", "v", ["x.log", "y.log"])
    assert sorted(map(tuple, out.collect())) == [(0, "a", "t", None), (1, "b", None, None)]


def bucketed(spark, tmp_path, name, df, buckets=4):
    return write_bucketed(df, f"merge_{tmp_path.name}_{name}".replace("-", "_"), ["id"], buckets, str(tmp_path / name))


def test_bucketed_tables_merge_without_a_shuffle(spark, tmp_path):
    """Three stored tables meet by id; equal ids with other values drop out, null values match."""
    def rows(model, skipped, other):
        base = spark.range(200).where(F.col("id") != skipped)
        en = F.when(F.col("id") == other, F.lit("other")).when(F.col("id") % 10 != 0, F.concat(F.lit("s"), "id"))
        return base.select("id", en.alias("en"), F.lit("train").alias("split"), F.concat(F.lit(model), "id").alias(model))

    frames = {m: rows(m, i, i + 50) for i, m in enumerate(("m.1", "m-2", "m3"), 3)}
    tables = [bucketed(spark, tmp_path, f"t{i}", df) for i, df in enumerate(frames.values())]
    merged = natural_merge(tables, meet_on=["id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
        found = sorted(map(str, merged.select("id", "en", "split", "`m.1`", "m-2", "m3").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = natural_merge(list(frames.values())).select("id", "en", "split", "`m.1`", "m-2", "m3")
    assert found == sorted(map(str, plain.collect())) and len(found) == 200 - 3 - 3


def test_null_keys_are_not_stored_in_buckets(spark, tmp_path):
    with pytest.raises(Exception, match="null key"):
        bucketed(spark, tmp_path, "nulls", spark.createDataFrame([(None, 1)], "id int, v int"))
    a, b = spark.range(3).withColumn("a", F.lit(1)), spark.range(3).withColumn("b", F.lit(1))
    with pytest.raises(ValueError, match="share"):
        natural_merge([a, b], meet_on=["a"])


def test_texts_of_the_right_table_do_not_travel(spark):
    """Strings meet by a digest of lengths and bytes: shifted borders, nulls and empty texts are not equal."""
    texts = [("a", "bc"), ("ab", "c"), ("", None), (None, ""), (None, None), ("", ""), ("null", ""), ("1,1:ab", "c")]
    rows = [(f"{en}|{es}", en, es) for en, es in texts]
    left = spark.createDataFrame(rows, "m1 string, en string, es string")
    right = spark.createDataFrame(rows, "m2 string, en string, es string")
    merged = natural_merge([left, right])
    assert merged.columns == ["m1", "en", "es", "m2"]
    assert sorted((r.m1, r.m2) for r in merged.collect()) == sorted((k, k) for k, _, _ in rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = natural_merge([left, right])._jdf.queryExecution().executedPlan()
        dealt = [str(e.output()) for e in _exchanges(plan)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [("en#" in e, "es#" in e) for e in dealt] == [(True, True), (False, False)], dealt


def _exchanges(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    found = [plan] if plan.nodeName() == "Exchange" else []
    return found + [e for i in range(plan.children().size()) for e in _exchanges(plan.children().apply(i))]


def test_rows_that_are_dealt_already_are_written_where_they_are(spark, tmp_path):
    pairs = spark.range(500).select("id", F.concat(F.lit("s"), "id").alias("en"), F.lit("train").alias("split"))
    name = f"dealt_{tmp_path.name}".replace("-", "_")
    base = write_bucketed(pairs, name, ["id"], 4, str(tmp_path / "pairs"))
    tables = [
        write_bucketed(base.withColumn(m, F.concat(F.lit(m), "id")), f"{name}_{m}", ["id"], 4, str(tmp_path / m), dealt=True)
        for m in ("m1", "m2")
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merged = natural_merge(tables, meet_on=["id"])
        assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
        found = sorted((r.id, r.en, r.m1, r.m2) for r in merged.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == [(i, f"s{i}", f"m1{i}", f"m2{i}") for i in range(500)]


def test_large_tables_are_merged_in_steps(spark, tmp_path, monkeypatch):
    """Rows of all steps together are the merge; no step's shuffle stays, and nulls and copies meet."""
    from tandemtext.plans import jobs
    from tandemtext.sources.files import read_splits, write_splits

    ids = [None, "a", "a", *[f"r{i}" for i in range(60)]]
    rows = [(key, f"text {i % 7}", "train" if i % 3 else "valid") for i, key in enumerate(ids)]
    base = spark.createDataFrame(rows, "id string, en string, split string")
    paths = [str(tmp_path / name) for name in ("m1", "m2", "m3")]
    for n, path in enumerate(paths):
        write_splits(base.withColumn(f"m{n}", F.concat(F.lit(f"{n}-"), F.col("en"))), path)
    parts = merge.in_steps([read_splits(spark, path) for path in paths], 5)
    assert len(parts) == 5 and sum(part[0].count() for part in parts) == len(rows)
    assert all(0 < part[0].count() == part[1].count() < len(rows) for part in parts)
    wanted = merge.natural_merge([read_splits(spark, path) for path in paths])
    written = []
    write = jobs.write_splits
    monkeypatch.setattr(jobs, "write_splits", lambda df, path, *a, **b: written.append(b["whole"]) or write(df, path, *a, **b))
    monkeypatch.setattr(jobs, "STEP_BYTES", 4 << 10)
    path = jobs.merge_scored(spark, paths, str(tmp_path / "out"))
    assert len(written) > 2 and written == [*[False] * (len(written) - 1), True]
    found = read_splits(spark, path).select(wanted.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() >= len(rows)
    # Tables that share no string are merged at once.
    numbers = [spark.range(3), spark.range(2)]
    assert merge.in_steps(numbers, 5) == [numbers]


@pytest.mark.parametrize("name", ["natural_merge", "bucketed_merge"])
def test_tables_that_are_read_no_more_are_deleted(spark, sf_small, monkeypatch, name):
    from tandemtext import session
    from tandemtext.plans import queries

    made = []
    for module in (queries, queries.files, queries.jobs):
        monkeypatch.setattr(module, "scratch_path", lambda s, label: made.append(session.scratch_path(s, label)) or made[-1])
    found = queries.QUERIES[name](spark, sf_small)
    left = {path.rsplit("/", 1)[-1].split("-")[0] for path in made if session.path_exists(spark, path)}
    assert left == {"keys", "merged" if name == "natural_merge" else "buckets"}
    assert found.count() > 0 and set(made) & set(session._made) == {p for p in made if session.path_exists(spark, p)}
