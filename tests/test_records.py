"""Quoted files and logs in several splits and parts, against readers of one task."""

import pytest
from pyspark.sql import functions as F

from tandemtext.operators import logs, report
from tandemtext.sources import files

SCHEMA = "i BIGINT, t STRING, u STRING"


def whole_reader(spark, path, **options):
    return spark.read.options(header=True, multiLine=True, **files.CELLS, **options).schema(SCHEMA).csv(path)


@pytest.fixture
def splits(spark):
    """File splits of any size in bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def of(size):
        for key in keys:
            spark.conf.set(key, str(size))

    yield of
    for key in keys:
        spark.conf.unset(key)


def awkward(i):
    texts = ["plain", 'a "quoted" one', "two\nlines", "\n\n", 'ends with "', '"', "", None, "a,b\r\nc", '""\n""', " x ", "é\n🙂" * 9]
    return (i, texts[i % 12], texts[i * 7 % 11])


@pytest.mark.parametrize("size", [97, 1000, 1 << 20])
def test_csv_in_splits(spark, tmp_path, splits, size):
    rows = [awkward(i) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    files.write_csv(df.coalesce(1), str(tmp_path / "one"))
    files.write_csv(df.repartition(3), str(tmp_path / "three"))
    for name in ("one", "three"):
        path = str(tmp_path / name)
        wanted = sorted(map(str, whole_reader(spark, path).collect()))
        assert len(wanted) == 200
        splits(size)
        read = files.read_csv(spark, path, SCHEMA)
        assert sorted(map(str, read.collect())) == wanted
        if size < 1000:
            assert spark.read.text(path).rdd.getNumPartitions() > 5
        splits(1 << 27)


def test_csv_without_a_schema_and_with_other_line_ends(spark, tmp_path, splits):
    (tmp_path / "crlf.csv").write_bytes(b'"a.b",c\r\n1,"x\r\ny"\r\n\r\n,""\r\n3,last')
    splits(9)
    read = files.read_csv(spark, str(tmp_path / "crlf.csv"))
    assert read.columns == ["a.b", "c"]
    assert sorted(map(tuple, read.collect()), key=str) == [("1", "x\r\ny"), ("3", "last"), (None, None)]


def test_a_cell_without_an_end_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('a\n"never closed\n')
    with pytest.raises(Exception, match="has no end"):
        files.read_csv(spark, str(tmp_path / "bad.csv"), "a STRING").collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("a\n")
    assert files.read_csv(spark, str(tmp_path / "*.csv"), "a STRING").collect() == []


def test_sentences_in_splits(spark, tmp_path, splits):
    told = ["one", "", "two\nlines", 'a "quoted" one', "\r\n", " ends ", None, "\t"] * 20
    files.write_sentences(spark.createDataFrame([(t,) for t in told], "t STRING").coalesce(1), str(tmp_path / "s"))
    splits(11)
    read = files.read_sentences(spark, str(tmp_path / "s"), multi_line=True)
    assert sorted(str(r["English"]) for r in read.collect()) == sorted(map(str, told))


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_logs_in_parts(spark, tmp_path, splits, size):
    """Each log is written by several tasks, and its lines are numbered over all parts and splits."""
    rows = [(f"{'ab'[i % 3 == 0]}.log", i * 5, f"line {i}" if i % 4 else "") for i in range(300)]
    lines = spark.createDataFrame(rows, "file string, line_no long, value string").repartition(3)
    path = str(tmp_path / "logs")
    files.write_log_lines(lines, path, parts=6)
    assert all(len(list((tmp_path / "logs").glob(f"log={x}.log/*.txt"))) > 1 for x in "ab")
    splits(size)
    read = files.read_log_lines(spark, f"{path}/log=*/*.txt", files.written_log(F.col("file")))
    found = {}
    for r in read.orderBy("file", "line_no").collect():
        found.setdefault(r["file"], []).append((r["line_no"], r["value"]))
    for name in ("a.log", "b.log"):
        assert found[name] == list(enumerate(v for f, _, v in rows if f == name))


def test_runs_over_rotated_parts(spark, tmp_path):
    marker = f"VERSION 1.0.0 : 2031-02-03 04:05:06 : {logs.RUN_MARKER}"
    (tmp_path / "x.log.1").write_text(f"{marker}\nmore\n{marker}\n")
    (tmp_path / "x.log.2").write_text(f"goes on\n{marker}\n")
    log = F.regexp_extract("file", r"([^/]*)\.\d+$", 1)
    lines = files.read_log_lines(spark, str(tmp_path / "x.log.*"), log)
    numbered = logs.number_records(logs.parse_lines(lines)).orderBy("line_no").collect()
    assert [(r["file"], r["run_no"]) for r in numbered] == [("x.log", n) for n in (1, 1, 2, 2, 3)]


def test_a_repeated_stage_replaces_its_record(spark, tmp_path):
    path = str(tmp_path / "report")
    some = spark.range(10).withColumn("split", F.when(F.col("id") < 6, "train").otherwise("test"))
    for run, rows in (("7", some), ("8", some), ("7", some.where("id > 2")), ("7", some.where("id > 4"))):
        report.append_run_record(report.run_record(run, "build", some, rows), path)
    report.append_run_record(report.run_record("7", "score", some, some), path)
    found = {(r.run_id, r.stage, r.split): r.rows_out for r in report.read_run_records(spark, path).collect()}
    assert found == {
        ("7", "build", "train"): 1, ("7", "build", "test"): 4,
        ("8", "build", "train"): 6, ("8", "build", "test"): 4,
        ("7", "score", "train"): 6, ("7", "score", "test"): 4,
    }
    assert report.read_run_records(spark, path).count() == 6
