import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tandemtext.operators import logs
from tandemtext.sources import files

# Lines in the shape of published run logs.
LOG = """VERSION 2.0.1 : 2031-02-03 04:05:06 : ===================== RUN =====================
VERSION 2.0.1 : 2031-02-03 04:05:06 : MODEL: maker/some-model
VERSION 2.0.1 : 2031-02-03 04:06:50 : PRE-EVALUATION: {'eval_score': 0.5, 'eval_counts': [9, 8, 7, 6], 'eval_runtime': 12.5}
VERSION 2.3.4 : 2031-05-06 07:08:10 : ===================== RUN =====================
VERSION 2.3.4 : 2031-05-06 07:08:10 : HYPERPARAMETERS (HINGE LOSS TRAINING):
VERSION 2.3.4 : 2031-05-06 07:08:10 : \tEPOCHS: 2
VERSION 2.3.4 : 2031-05-06 07:08:11 : TRANSLATION 0 on "English to Spanish"
VERSION 2.3.4 : 2031-05-06 07:08:11 : \tOriginal Text: one : two
VERSION 2.3.4 : 2031-05-06 07:08:11 : \tGenerated Translation: uno : dos
VERSION 2.3.4 : 2031-05-06 07:08:11 : \tActual Translation: uno : dos
VERSION 2.3.4 : 2031-05-06 07:08:13 : Example: Dataset({
    features: ['id'],
})
VERSION 2.3.4 : 2031-05-06 07:08:14 : TRANSLATION 0 on "English to Spanish"
VERSION 2.3.4 : 2031-05-06 07:08:14 : \tOriginal Text: second
VERSION 2.3.4 : 2031-05-06 07:08:14 : \tGenerated Translation: not the first
"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "a.log").write_text(LOG)
    (folder / "b.log").write_text("orphan line\n" + LOG.split("\n")[0] + "\n")
    return files.read_log_lines(spark, str(folder / "*.log")).withColumn(
        "file", F.element_at(F.split("file", "/"), -1)).cache()


def test_lines_are_numbered_in_file_order(lines):
    rows = lines.where("file = 'a.log'").orderBy("line_no").collect()
    assert [r["value"] for r in rows] == LOG.rstrip("\n").split("\n")
    assert [r["line_no"] for r in rows] == list(range(16))


def test_numbers_run_on_over_the_splits_of_a_file(spark, tmp_path):
    path = tmp_path / "big.log"
    path.write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = files.read_log_lines(spark, str(path))
        assert read.rdd.getNumPartitions() > 1
        wrong = read.where(F.split("value", " ")[1].cast("bigint") != F.col("line_no"))
        assert (read.count(), wrong.count()) == (20_000, 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_runs_and_continuations(lines):
    numbered = logs.number_records(logs.parse_lines(lines))
    records = logs.fold_continuations(numbered)
    a = {r["record_no"]: r for r in records.where("file = 'a.log'").collect()}
    assert len(a) == 14 and a[3]["run_no"] == 1 and a[4]["run_no"] == 2
    assert a[11]["message"] == "Example: Dataset({\n    features: ['id'],\n})"
    assert str(a[1]["ts"]) == "2031-02-03 04:05:06" and a[4]["version"] == "2.3.4"
    b = records.where("file = 'b.log'").orderBy("line_no").collect()
    assert [(r["record_no"], r["message"][:6]) for r in b] == [(0, "orphan"), (1, "======")]


def test_metrics_settings_and_durations(lines):
    numbered = logs.number_records(logs.parse_lines(lines))
    metrics = {r["metric"]: r["value"] for r in logs.evaluation_metrics(numbered).collect()}
    assert metrics == {"eval_score": 0.5, "eval_counts": None, "eval_runtime": 12.5}
    settings = logs.run_settings(numbered, ["MODEL", "EPOCHS"]).collect()
    assert sorted((r["run_no"], r["section"], r["MODEL"], r["EPOCHS"]) for r in settings) == [
        (1, "", "maker/some-model", None), (2, "HYPERPARAMETERS (HINGE LOSS TRAINING)", None, "2")]
    durations = logs.stage_durations(numbered).where("file = 'a.log'")
    assert {r["record_no"]: r["seconds"] for r in durations.where("seconds > 0").collect()} == {
        2: 104, 6: 1, 10: 2, 11: 1}
    assert durations.where("record_no = 3").count() == 0


def test_samples_take_the_first_and_leave_missing_ones_null(lines):
    parsed = logs.parse_lines(lines)
    found = logs.sample_translations(parsed, "English to Spanish", [0, 7])
    assert sorted(map(tuple, found.collect()), key=str) == [
        ("a.log", 0, "uno : dos"), ("a.log", 7, None), ("b.log", 0, None), ("b.log", 7, None)]


def test_running_sums_equal_one_window(spark):
    rows = spark.range(3000).select(
        (F.col("id") % 2).alias("g"), (F.col("id") * 3).alias("p"), (F.hash("id") % 5).alias("v"))
    whole = Window.partitionBy("g").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    wanted = rows.select("g", "p", F.sum("v").over(whole).alias("s")).collect()
    found = logs.running_sums(rows, ["g"], "p", {"s": F.col("v")}, spans=(16, 256)).select("g", "p", "s")
    assert sorted(found.collect()) == sorted(wanted)


def test_values_of_diverging_runs_are_kept(spark):
    told = {"a": "nan", "b": "inf", "c": "-inf", "d": "None", "e": "True", "f": "[1, nan]", "g": "1e-3"}
    text = "{" + ", ".join(f"'{k}': {v}" for k, v in told.items()) + "}"
    prefix = "VERSION 1.0 : 2031-01-01 00:00:00 : "
    rows = [("x", 0, prefix + "PRE-EVALUATION: " + text), ("x", 1, prefix + "POST-EVALUATION: {broken: }")]
    lines = spark.createDataFrame(rows, "file STRING, line_no BIGINT, value STRING")
    found = logs.evaluation_metrics(logs.number_records(logs.parse_lines(lines))).collect()
    first = {r["metric"]: r["value"] for r in found if r["line_no"] == 0}
    assert list(first) and first.keys() == told.keys()
    assert first["a"] != first["a"] and first["b"] == float("inf") == -first["c"]
    assert (first["d"], first["e"], first["f"], first["g"]) == (None, None, None, 0.001)
    assert [(r["metric"], r["value"]) for r in found if r["line_no"] == 1] == [(None, None)]


def test_the_last_of_repeated_settings_counts(spark):
    prefix = "VERSION 1.0 : 2031-01-01 00:00:00 : "
    rows = [("x", i, prefix + t) for i, t in enumerate([logs.RUN_MARKER, "EPOCHS: 9", "EPOCHS: 10", "EPOCHS: 2"])]
    lines = spark.createDataFrame(rows, "file STRING, line_no BIGINT, value STRING")
    found = logs.run_settings(logs.number_records(logs.parse_lines(lines)), ["EPOCHS"])
    assert [r["EPOCHS"] for r in found.collect()] == ["2"]


STRETCH = logs.SPANS[0]


def test_records_that_go_on_in_later_stretches(spark):
    """Continuations across one border, across whole stretches, and lines before any record."""
    told = "VERSION 1.0 : 2031-02-03 04:05:06 : "
    rows = [
        ("a", 0, "before"), ("a", STRETCH, "any"),
        ("a", STRETCH + 1, told + "one"), ("a", 2 * STRETCH - 1, told + "two"),
        ("a", 2 * STRETCH, "two b"), ("a", 3 * STRETCH, "two c"), ("a", 3 * STRETCH + 1, ""),
        ("a", 3 * STRETCH + 2, told + "three"), ("a", 3 * STRETCH + 3, "three b"), ("b", 0, told + "four"),
    ]
    parsed = logs.parse_lines(spark.createDataFrame(rows, "file string, line_no bigint, value string"))
    folded = logs.fold_continuations(logs.number_records(parsed, stretches=True))
    plain = logs.fold_continuations(logs.number_records(parsed))
    assert folded.columns == plain.columns
    found = sorted((r.file, r.record_no, r.line_no, r.message) for r in folded.collect())
    assert found == sorted((r.file, r.record_no, r.line_no, r.message) for r in plain.collect())
    assert found == [
        ("a", 0, 0, "before"), ("a", 0, STRETCH, "any"), ("a", 1, STRETCH + 1, "one"),
        ("a", 2, 2 * STRETCH - 1, "two\ntwo b\ntwo c\n"), ("a", 3, 3 * STRETCH + 2, "three\nthree b"),
        ("b", 1, 0, "four"),
    ]


def test_samples_read_the_lines_once(spark, tmp_path):
    """Also when the translation stands behind the border of a stretch, or lines are missing."""
    told = 'VERSION 1.0 : 2031-02-03 04:05:06 : TRANSLATION %d on "English to Spanish"'
    rows = [
        ("a", STRETCH - 2, told % 1), ("a", STRETCH - 1, told % 2), ("a", STRETCH, "uno"), ("a", STRETCH + 1, "dos"),
        ("a", STRETCH + 5, told % 1), ("a", STRETCH + 7, "not the first"),
        ("a", 2 * STRETCH, told % 3), ("a", 2 * STRETCH + 2, "tres"), ("a", 3 * STRETCH, told % 4),
        ("a", 3 * STRETCH + 1, "x"), ("a", 3 * STRETCH + 3, "three below"), ("b", 7, "no sample"),
    ]
    lines = spark.createDataFrame(rows, "file string, line_no bigint, value string")
    lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    wanted = [("a", 1, "uno"), ("a", 2, "dos"), ("a", 3, "tres"), ("a", 4, None)]
    found = logs.sample_translations(logs.parse_lines(lines), "English to Spanish")
    assert sorted(tuple(r) for r in found.collect()) == wanted
    listed = logs.sample_translations(logs.parse_lines(lines), "English to Spanish", [3, 9])
    assert sorted(tuple(r) for r in listed.select("file", "i", "translation").collect()) == [
        ("a", 3, "tres"), ("a", 9, None), ("b", 3, None), ("b", 9, None),
    ]
    for frame in (found, listed):
        plan = frame.select("*")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1


@pytest.fixture(scope="module")
def placed(spark, tmp_path_factory):
    """Lines of two logs in splits of a few lines, and the same without their places."""
    folder, told = tmp_path_factory.mktemp("placed"), random.Random(7)
    stamp = "VERSION 1.2.3 : 2031-02-03 04:05:06 : "
    for name, size in (("a", 400), ("b", 90)):
        lines = []
        for i in range(size):
            number = told.choice([0, 1, 1, 2, 5, 34, 35, 40 + i])
            kind = told.choice(["announce"] * 4 + ["text"] * 4 + ["run", "section", "more", "other"])
            lines.append({
                "announce": f'{stamp}TRANSLATION {number} on "English to Spanish"',
                "text": f"{stamp}\tGenerated Translation: line {i}",
                "run": f"{stamp}{logs.RUN_MARKER}",
                "section": f"{stamp}HYPERPARAMETERS:",
                "more": f'no prefix, TRANSLATION 3 on "English to Spanish" {i}',
                "other": f'{stamp}TRANSLATION {number} on "English to French"',
            }[kind])
        (folder / f"{name}.log").write_text("\n".join([*lines, f'TRANSLATION 9{size} on "English to Spanish"']) + "\n")
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    for key in keys:
        spark.conf.set(key, "260")
    read = [files.read_log_lines(spark, str(folder / "*.log"), placed=kind) for kind in (True, False)]
    assert read[0].rdd.getNumPartitions() > 30
    assert read[0].columns == ["file", "line_no", "value", files.SPLIT, files.REST]
    yield read
    for key in keys:
        spark.conf.unset(key)


def _same(found, wanted):
    assert found.columns == wanted.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))


def test_placed_lines_are_numbered_where_they_are(placed):
    inside, outside = (logs.number_records(logs.parse_lines(lines)) for lines in placed)
    _same(inside, outside)
    # Of the lines only their flags are summed by split.
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "message" not in "".join(line for line in plan.split("\n") if "Exchange hash" in line or "Sort [" in line)
    folded = [logs.fold_continuations(logs.number_records(logs.parse_lines(lines), stretches=True)) for lines in placed]
    _same(*folded)
    _same(*[logs.evaluation_metrics(numbered) for numbered in (inside, outside)])


@pytest.mark.parametrize("indices", [None, (0, 1, 35, 9999, 9400, 990)])
def test_samples_of_placed_lines(placed, indices):
    found, wanted = (logs.sample_translations(logs.parse_lines(lines), "English to Spanish", indices) for lines in placed)
    _same(found, wanted)
    rows = {(r.file[-5:], r.i): r.translation for r in wanted.collect()}
    assert rows["a.log", 9400] is None and rows["a.log", 1] is not None


def test_placed_lines_that_were_filtered_are_an_error(placed):
    some = placed[0].where("line_no % 7 <> 3")
    with pytest.raises(Exception, match="not as they were read"):
        logs.number_records(logs.parse_lines(some)).collect()


def test_lines_in_ranges_are_written_where_they_are(spark, tmp_path):
    rows = [(f"{'ab'[i % 2]}.log", i * 10, f"line {i} " + "x" * 50) for i in range(500)]
    lines = spark.createDataFrame(rows, "file string, line_no long, value string").repartitionByRange(6, "file", "line_no")
    files.write_log_lines(lines, str(tmp_path / "kept"), dealt=True, compression="lz4")
    parts = list((tmp_path / "kept").glob("log=*/*.lz4"))
    assert len(parts) > 4 and sum(part.stat().st_size for part in parts) < 500 * 50 / 2
    read = files.read_log_lines(spark, f"{tmp_path}/kept/log=*/*.txt*", files.written_log(F.col("file")), placed=True)
    wanted = sorted((file, n // 20, value) for file, n, value in rows)
    assert sorted(map(tuple, read.select("file", "line_no", "value").collect())) == wanted
    assert logs.number_records(logs.parse_lines(read)).count() == 500


@pytest.mark.parametrize("name", ["log_files_numbered", "log_files_compared", "log_files_scanned"])
def test_logs_are_written_and_read_in_place(spark, sf_small, name):
    from tandemtext.plans import queries
    from tandemtext.session import _made

    before = set(_made)
    queries.QUERIES[name](spark, sf_small)
    [path] = [p for p in _made if p not in before]
    size = sum(row.length for row in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").collect())
    read = spark.read.option("recursiveFileLookup", True).text(path)
    assert size < read.agg(F.sum(F.length("value") + 1)).first()[0] / 2
