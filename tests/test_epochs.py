"""Resumed calls, and epochs replayed from a manifest."""

import pytest
from pyspark.sql import functions as F

from tandemtext.operators import generate, ordering, tasks


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, f"text {i}") for i in range(60)], "`k.e` long, text string").repartition(3)


def counting(path, stop_at=None, fails=()):
    """A service that writes down every call; it dies at a row, or fails for some."""

    def load():
        def call(row):
            with open(path, "a") as out:
                out.write(f"{row['k.e']}\n")
            if row["k.e"] == stop_at:
                raise SystemExit("the run is stopped")
            if row["k.e"] in fails:
                raise ValueError("no luck")
            return row["text"].upper()

        return call

    return load


def calls(path):
    return [int(line) for line in path.read_text().split()] if path.exists() else []


def test_a_stopped_run_goes_on(spark, rows, tmp_path):
    ledger, told = str(tmp_path / "ledger"), tmp_path / "calls"
    step = rows.select("`k.e`", F.pmod(F.xxhash64("`k.e`"), F.lit(5)).alias("s")).collect()
    of_step = {s: {r["k.e"] for r in step if r.s == s} for s in range(5)}
    stop = min(of_step[3])
    with pytest.raises(Exception):
        generate.enrich_with_ledger(rows, "k.e", "out", counting(told, stop), ledger, steps=5).collect()
    kept = {r.key for r in spark.read.parquet(ledger).collect()}
    assert kept == of_step[0] | of_step[1] | of_step[2]
    before = len(calls(told))
    found = generate.enrich_with_ledger(rows, "k.e", "out", counting(told), ledger, steps=5)
    assert {r["k.e"]: (r.out, r.out_reason) for r in found.collect()} == {i: (f"TEXT {i}", None) for i in range(60)}
    # Only what had no answer was called again.
    assert sorted(calls(told)[before:]) == sorted(of_step[3] | of_step[4])
    generate.enrich_with_ledger(rows, "k.e", "out", counting(told), ledger, steps=5)
    assert len(calls(told)) - before == len(of_step[3] | of_step[4])


def test_failed_calls_have_a_reason_and_are_made_again(spark, rows, tmp_path):
    ledger, told = str(tmp_path / "ledger"), tmp_path / "calls"
    first = generate.enrich_with_ledger(rows, "k.e", "out", counting(told, fails=(1, 2)), ledger)
    told_reasons = {r["k.e"]: r.out_reason for r in first.collect() if r.out is None}
    assert told_reasons == {1: "ValueError: no luck", 2: "ValueError: no luck"}
    second = generate.enrich_with_ledger(rows, "k.e", "out", counting(told, fails=(2,)), ledger).collect()
    assert {r["k.e"] for r in second if r.out is None} == {2} and len(second) == 60
    assert len(calls(told)) == 62
    more = spark.createDataFrame([(100, "new")], "`k.e` long, text string")
    assert generate.enrich_with_ledger(more, "k.e", "out", counting(told), ledger).first().out == "NEW"
    assert generate.enrich_with_ledger(rows.limit(0), "k.e", "out", counting(told), ledger).collect() == []


@pytest.mark.parametrize("mixture, epochs", [(0, 3), (1, 2), (2, 2.3), (0, 0.5), (2, 0.001)])
def test_replayed_epochs_are_those_of_the_mixture(spark, mixture, epochs):
    judge = spark.range(40).select(F.concat(F.lit("j"), "id").alias("id"), F.lit("p").alias("prompt"))
    translate = spark.range(33).select(F.concat(F.lit("t"), "id").alias("id"), F.lit("q").alias("prompt"))
    examples = {"judge": judge, "translate": translate}
    wanted = tasks.staged_mixture(judge, translate, mixture, epochs).select("id", "prompt", "task", "stage", "epoch")
    stored = judge.withColumn("task", F.lit("judge")).union(translate.withColumn("task", F.lit("translate")))
    manifest = tasks.epoch_manifest(examples, mixture, epochs)
    found = tasks.replay(stored, manifest)
    assert sorted(found.drop("place").select(wanted.columns).collect()) == sorted(wanted.collect())
    orders = {}
    for row in manifest.collect():
        rows = found.where(f"stage = {row.stage} and epoch = {row.epoch}").orderBy("place").collect()
        orders[row.stage, row.epoch] = [r.id for r in rows]
        read = tasks.read_epoch(stored, manifest, row.stage, row.epoch, partitions=3).collect()
        assert [r.id for r in read] == orders[row.stage, row.epoch]
    whole = [tuple(o) for o in orders.values() if len(o) == 40]
    assert len(set(whole)) == len(whole)
    with pytest.raises(ValueError, match="no epoch"):
        tasks.read_epoch(stored, manifest, 9, 1)
