import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandemtext.operators import generate, report, tasks

M, K = ["m-a", "m.b"], ["m-a_score", "m.b_score"]


def scored(spark, rows):
    return spark.createDataFrame(
        rows, "id STRING, en STRING, es STRING, `m-a` STRING, `m.b` STRING, "
        "`m-a_score` DOUBLE, `m.b_score` DOUBLE")


def test_best_and_worst_take_the_first_of_equals(spark):
    df = scored(spark, [("1", "e", "s", "A", "B", 1.0, 2.0), ("2", "e", "s", "A", "B", 3.0, 3.0)])
    rows = sorted(tasks.preference_pairs(df, M, K, target="es").collect())
    assert [tuple(r) for r in rows] == [("1", ": e", "s", "B", "A"), ("2", ": e", "s", "A", "A")]
    assert tasks.preference_pairs(df, M, K, drop_ties=True).count() == 1
    assert tasks.preference_pairs(df, M, K, min_margin=1.5).count() == 0


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_an_error(spark, bad):
    df = scored(spark, [("1", "e", "s", "A", "B", 1.0, bad)])
    with pytest.raises(Exception, match="null or NaN score"):
        tasks.preference_pairs(df, M, K).collect()
    assert df.where(tasks.has_invalid_score(K)).count() == 1


def test_published_best_and_worst(spark):
    # Scores of a published row.
    df = scored(spark, [("1", "e", "s", "flan text", "nllb text", 25.211936184349828, 38.16330911371339)])
    row = tasks.preference_pairs(df, M, K).first()
    assert (row["good"], row["bad"]) == ("nllb text", "flan text")


def test_repeat_prompt_keeps_the_candidates(spark):
    df = scored(spark, [(str(i), f"src{i}", "s", "A", "B", 1.0, 2.0) for i in range(40)])
    orders = set()
    for row in tasks.repeat_examples(df, M, K).collect():
        task, *candidates, source = row["prompt"].split("\n")
        assert task == "Repeat the best translation:" and source == f"src{row['id']}"
        assert sorted(candidates) == ["A", "B"] and row["label"] == "B"
        orders.add(tuple(candidates))
    assert len(orders) == 2


def test_staged_mixture_orders_and_epochs(spark):
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("id"), F.lit("p").alias("prompt"), F.lit("l").alias("label"))
    both = tasks.staged_mixture(rows, rows, 0, 3)
    counts = {(r["stage"], r["task"], r["epoch"]): r["count"]
              for r in both.groupBy("stage", "task", "epoch").count().collect()}
    assert counts == {(1, "judge", 1): 10, (1, "judge", 2): 5,
                      (2, "translate", 1): 10, (2, "translate", 2): 5}
    assert tasks.stages(1, 2) == [("translate", 1.0), ("judge", 1.0)]
    assert tasks.stages(2, 2) == [("judge", 2)]
    assert tasks.epochs_of(rows, 0.25).count() == 2
    assert tasks.epochs_of(rows, 0).count() == 0


def test_step_plan(spark):
    steps = tasks.step_plan(spark.range(1000), 16, 0.5).first()
    assert (steps["train_rows"], steps["strategy"], steps["save_steps"]) == (1000, "steps", 31)
    assert tasks.step_plan(spark.range(1000), 16, 1).first()["strategy"] == "epoch"


def test_hinge_margin(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (9.0, 1.0), (nan, 1.0)], "g DOUBLE, b DOUBLE")
    found = [r[0] for r in df.select(tasks.hinge_margin(F.col("g"), F.col("b"), 4.0)).collect()]
    assert found == [5.0, 0.0, 0.0]


def test_models_are_loaded_per_task_and_called_per_batch(spark):
    def load():
        return lambda texts: pd.Series([f"{len(texts)}:{t}" for t in texts], index=texts.index)

    df = spark.range(10).select("id", F.col("id").cast("string").alias("t")).coalesce(1)
    out = generate.with_candidates(df, "t", {"m": load}, task="do", batch_size=4)
    rows = [r["m"] for r in out.orderBy("id").collect()]
    assert rows == [f"{4 if i < 8 else 2}:do: {i}" for i in range(10)]


def test_a_filter_on_a_score_does_not_run_the_models_twice(spark):
    def load():
        return lambda texts: texts

    df = spark.createDataFrame([("1", "a b c d", "a b c d")], "id STRING, en STRING, es STRING")
    out = generate.with_scores(generate.with_candidates(df, "es", {"m": load}), ["m"], "es")
    plan = out.where(F.col("m_score") > 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2, plan
    assert out.where(F.col("m_score") > 50).count() == 1


def test_rows_are_enriched_one_by_one(spark):
    def connect():
        return lambda row: f"{row['a']}/{row['b']}"

    df = spark.createDataFrame([("x", 1), ("y", 2)], "a STRING, b INT")
    out = generate.enrich_rows(df, "c", connect, partitions=2)
    assert sorted(r["c"] for r in out.collect()) == ["x/1", "y/2"]


def test_means_and_reports(spark):
    df = scored(spark, [("1", "e", "s", "A", "B", 1.0, 2.0), ("2", "e", "s", "A", "B", 3.0, 6.0)])
    split = df.withColumn("split", F.lit("train"))
    rows = {r["model"]: r["mean_score"] for r in report.mean_scores(split, M).collect()}
    assert rows == {"m-a": 2.0, "m.b": 4.0}
    holes = split.withColumn("m.b_score", F.when(F.col("id") == "1", F.lit(2.0)))
    with pytest.raises(Exception, match="without a score"):
        report.mean_scores(holes, M).collect()
    lines = [r["line"] for r in report.transposed_row(df.select("id", "m-a"), "id").collect()]
    assert lines == ["ID: 1", "M-A: A"]


@pytest.mark.parametrize("bad", [None, float("nan")])
@pytest.mark.parametrize("options", [{"drop_ties": True}, {"min_margin": 0.5}])
def test_missing_scores_are_an_error_with_margins_too(spark, bad, options):
    df = scored(spark, [("1", "e", "s", "A", "B", 1.0, bad)])
    with pytest.raises(Exception, match="null or NaN score"):
        tasks.preference_pairs(df, M, K, **options).collect()


@pytest.mark.parametrize("epochs, rows", [(2.3, 23), (1.1, 11), (0.7, 7), (2.9, 29), (0.07, 0)])
def test_broken_epochs_are_exact(spark, epochs, rows):
    assert tasks.epochs_of(spark.range(10), epochs).count() == rows


def test_pairs_without_a_side_are_an_error(spark):
    pairs = spark.createDataFrame([("a b c d", "a b c d"), (None, "a b")], "p STRING, r STRING")
    with pytest.raises(Exception, match="lacks its prediction"):
        report.corpus_metric(pairs, "p", "r").collect()


def test_profile_of_an_empty_table(spark):
    none = spark.createDataFrame([], "a INT, b STRING")
    found = sorted(map(tuple, report.column_profile(none, distinct=True).collect()))
    assert found == [("a", "int", 0, 0), ("b", "string", 0, 0)]


def test_null_sources_are_spelled_out(spark):
    df = spark.createDataFrame([("1", None)], "id STRING, en STRING")

    def load():
        return lambda texts: texts

    assert generate.with_candidates(df, "en", {"m": load}, task="T").first()["m"] == "T: None"


def test_models_share_a_worker(spark):
    """All candidates of a text come from one pass over it, whatever the models are called."""

    def prefixed(sign):
        return lambda: lambda texts: sign + texts

    df = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, t string").repartition(2)
    models = {"a.b-c": prefixed("x"), "plain": prefixed("y"), "`q`": prefixed("z")}
    out = generate.with_candidates(df, "t", models, batch_size=3)
    assert out.columns == ["id", "t", *models]
    assert sorted(map(tuple, out.collect())) == [(i, f"t{i}", f"xt{i}", f"yt{i}", f"zt{i}") for i in range(7)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["preference_triples", "preference_pairs", "repeat_prompts"])
def test_what_is_read_once_is_not_stored(spark, sf_small, name):
    """Only the keys are, in which the cuts of the split are found."""
    from tandemtext import session
    from tandemtext.plans.queries import QUERIES

    before = len(session._made)
    assert QUERIES[name](spark, sf_small).count() > 0
    [path] = session._made[before:]
    assert spark.read.parquet(path).columns == ["id"]


@pytest.mark.parametrize("name", ["staged_repeat_mixture", "staged_preference_mixture", "staged_judge_only"])
def test_models_answer_once_for_what_is_trained_on(spark, sf_small, name):
    from tandemtext import session
    from tandemtext.plans.queries import QUERIES

    before = len(session._made)
    mixed = QUERIES[name](spark, sf_small)
    # The keys, and the pairs of the split that is asked for; no scores.
    keys, pairs = [spark.read.parquet(path) for path in session._made[before:]]
    assert keys.columns == ["id"]
    assert [r.split for r in pairs.select("split").distinct().collect()] == ["train"]
    # One worker call for the models and one for the scores, none in the passes for the cuts.
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
