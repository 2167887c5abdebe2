"""Run logs as tables: records, runs, metrics, settings, sample translations.

Input is ``file, line_no, value``. No step gathers a whole file: running numbers
are built from stretches of bounded length, and neighbouring lines are found by
joining on their line number. Lines that are ``placed`` where they were read are numbered there,
and stay there.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemtext.functions.text import named, without_prefix
from tandemtext.sources.files import REST, SPLIT

# Fixed values of the log format.
FIELD_SEPARATOR = " : "
VERSION = r"^VERSION \S+$"
TIME_STAMP = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"
RUN_MARKER = "===================== RUN ====================="
EVALUATION = r"(?s)^((?:PRE|POST)-EVALUATION[^:]*): (\{.*\})$"
BARE_WORD = r"([:\[,]\s*)(-?inf|nan|None|True|False)(?=\s*[,\]}])"
SETTING = r"(?s)^([A-Z() ]+): (.*)$"
SECTION = r"^([A-Z() ]+):$"
GENERATED = "Generated Translation: "
# Line spans of the stretches, from the finest to the coarsest.
SPANS = (1 << 17, 1 << 30)
# Begins the names of columns that tell the stretch of a line.
STRETCH = "_stretch"


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    sums: Mapping[str, Column],
    spans: Sequence[int] = SPANS,
    stretch: str | None = None,
) -> DataFrame:
    """Adds running sums over ``position`` within ``group``.

    Rows are summed within spans of positions, and the totals of the spans in the
    same way with the next coarser span. So a window holds one span of one group,
    however large the group is. With ``stretch`` rows keep the number of their finest span in a
    column of that name, and in ``<stretch>_<name>`` what a sum is at its end.
    """
    valued = df.withColumns({name: value.cast("bigint") for name, value in sums.items()})
    if not spans:
        window = Window.partitionBy(*group).orderBy(position)
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return valued.withColumns({name: F.sum(name).over(upto) for name in sums})
    span, *coarser = spans
    level = f"_span_{len(spans)}"
    # Never null, so that no null filter keeps the totals from being computed once.
    number = F.coalesce(F.call_function("div", F.col(position), F.lit(span)), F.lit(0))
    stretched = valued.withColumn(level, number.cast("bigint"))
    keys = [*group, level]
    totals = stretched.groupBy(*keys).agg(*[F.sum(name).alias(f"_of_{name}") for name in sums])
    before = running_sums(
        totals,
        group,
        level,
        {f"_upto_{name}": F.col(f"_of_{name}") for name in sums},
        [s // span for s in coarser],
    ).select(
        *keys,
        *[(F.col(f"_upto_{n}") - F.col(f"_of_{n}")).alias(f"_before_{n}") for n in sums],
        *[F.col(f"_upto_{n}").alias(f"{stretch}_{n}") for n in sums if stretch],
    )
    window = Window.partitionBy(*keys).orderBy(position)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = stretched.withColumns({name: F.sum(name).over(upto) for name in sums})
    summed = (
        within.join(before, keys)
        .withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums})
        .drop(*[f"_before_{name}" for name in sums])
    )
    return summed.withColumnRenamed(level, stretch) if stretch else summed.drop(level)


def _in_place(line_no: Column, split: Column, *values: Column, lag: int = 0) -> Column:
    """Of lines that are placed: the sums of values so far in their split, as fields ``s0, s1``, ...

    With ``lag`` not the sums, but the values so many lines above, -1 where the split has no such
    line. The rows of a task have to be all lines of its splits in their order; it is an error
    if they are not. Only the numbers travel to Python.
    """
    fields = [f"s{i}" for i in range(len(values))]

    @F.pandas_udf(", ".join(f"{field} bigint" for field in fields))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        import numpy
        import pandas

        last, held = None, numpy.zeros((lag or 1, len(fields)), numpy.int64)
        for line_no, split, *told in batches:
            if not len(line_no):
                yield pandas.DataFrame({field: pandas.Series([], dtype="int64") for field in fields})
                continue
            numbers, begins = line_no.to_numpy(), split.to_numpy()
            first = numbers == begins
            before = numpy.concatenate([[numbers[0] - 1 if last is None else last], numbers[:-1]])
            if (last is None and not first[0]) or not (first | (numbers == before + 1)).all():
                raise ValueError("lines that are not as they were read can't be numbered in place")
            values = numpy.stack([value.to_numpy() for value in told], axis=1)
            if lag:
                both = numpy.concatenate([held, values])
                out = numpy.where((numbers - begins >= lag)[:, None], both[:-lag], -1)
                held = both[-lag:]
            else:
                sums = numpy.cumsum(values, axis=0)
                since = numpy.maximum.accumulate(numpy.where(first, numpy.arange(len(first)), -1))
                out = sums + numpy.where((since < 0)[:, None], held, values[since] - sums[since])
                held = out[-1:]
            last = numbers[-1]
            yield pandas.DataFrame(out, columns=fields)

    # Rows before a filter count, so that none may be pushed below.
    return run.asNondeterministic()(line_no, split, *values)


def _sums_in_place(df: DataFrame, sums: Mapping[str, Column], stretch: str | None) -> DataFrame:
    """As ``running_sums`` within files, for placed lines: no line is shuffled.

    What stands in the splits before is a table of one row a split, which goes to the lines.
    """
    valued = df.withColumns({name: F.coalesce(value.cast("bigint"), F.lit(0)) for name, value in sums.items()})
    upto = Window.partitionBy("file").orderBy(SPLIT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = valued.groupBy("file", SPLIT).agg(*[F.sum(name).alias(f"_of_{name}") for name in sums])
    before = totals.select(
        F.col("file").alias("_file"),
        F.col(SPLIT).alias("_its_split"),
        *[(F.sum(f"_of_{name}").over(upto) - F.col(f"_of_{name}")).alias(f"_before_{name}") for name in sums],
        *[F.sum(f"_of_{name}").over(upto).alias(f"{stretch}_{name}") for name in sums if stretch],
    )
    same = F.col("file").eqNullSafe(F.col("_file")) & (F.col(SPLIT) == F.col("_its_split"))
    within = valued.withColumn("_sums", _in_place(F.col("line_no"), F.col(SPLIT), *map(F.col, sums)))
    summed = within.join(F.broadcast(before), same).withColumns(
        {name: F.col("_sums")[f"s{i}"] + F.col(f"_before_{name}") for i, name in enumerate(sums)}
    )
    if stretch:
        summed = summed.withColumn(stretch, F.col(SPLIT))
    return summed.drop("_sums", "_file", "_its_split", SPLIT, REST, *[f"_before_{name}" for name in sums])


def _message_of(value: Column) -> Column:
    """What ``parse_lines`` takes as the message of a line."""
    fields = F.split(value, FIELD_SEPARATOR, 3)
    version, ts, message = (F.get(fields, F.lit(i)) for i in range(3))
    is_record = F.startswith(value, F.lit("VERSION ")) & message.isNotNull() & version.rlike(VERSION) & ts.rlike(TIME_STAMP)
    return F.when(is_record, message).otherwise(value)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``version, ts, message``; a line without the prefix is all message."""
    fields = F.split("value", FIELD_SEPARATOR, 3)
    begins = F.startswith("value", F.lit("VERSION "))
    split = lines.withColumn("_f", F.when(begins, fields))
    version, ts, message = (F.get("_f", F.lit(i)) for i in range(3))
    is_record = (
        begins & message.isNotNull() & version.rlike(VERSION) & ts.rlike(TIME_STAMP)
    )
    return split.withColumn("_is_record", is_record).select(
        *map(named, lines.columns),
        F.when(F.col("_is_record"), F.substring(version, len("VERSION ") + 1, 1 << 30)).alias("version"),
        F.when(F.col("_is_record"), ts).try_cast("timestamp_ntz").alias("ts"),
        F.when(F.col("_is_record"), message).otherwise(F.col("value")).alias("message"),
    )


def _bare(message: Column) -> Column:
    return F.btrim(message, F.lit(" \t\r\n"))


def number_records(parsed: DataFrame, stretches: bool = False) -> DataFrame:
    """Adds running numbers per file: ``run_no, record_no, section_no``.

    A continuation line has the number of the record it continues. ``stretches`` adds columns
    that tell ``fold_continuations`` which lines stand together already.
    """
    message = _bare(F.col("message"))
    is_record = F.col("version").isNotNull()
    is_section = is_record & F.endswith(message, F.lit(":")) & message.rlike(SECTION)
    sums = {
        "run_no": (is_record & (message == RUN_MARKER)).cast("int"),
        "record_no": is_record.cast("int"),
        "section_no": is_section.cast("int"),
    }
    stretch = STRETCH if stretches else None
    if SPLIT in parsed.columns:
        return _sums_in_place(parsed, sums, stretch)
    return running_sums(parsed, ["file"], "line_no", sums, stretch=stretch)


def fold_continuations(numbered: DataFrame) -> DataFrame:
    """One row per record, its continuation lines joined to the message by newlines.

    A record is one value, so its lines have to fit into a task's memory.

    Lines before the first record of a file belong to none and stay as they are. Lines that were
    numbered with ``stretches`` are joined where they are, and only records that go on in the
    next stretch are dealt out again.
    """
    stretch = [STRETCH, f"{STRETCH}_record_no"] if STRETCH in numbered.columns else []

    def joined(lines: DataFrame, *keys: str) -> DataFrame:
        told = F.array_sort(F.collect_list(F.struct("line_no", "message")))["message"]
        return lines.groupBy("file", "record_no", *keys).agg(
            # A marker is a record of its own, so all its lines have one run number.
            F.max("run_no").alias("run_no"),
            F.min("line_no").alias("line_no"),
            F.max("version").alias("version"),
            F.max("ts").alias("ts"),
            F.when(F.count("message") > 0, F.array_join(told, "\n")).alias("message"),
        )

    alone = F.when(F.col("record_no") == 0, F.col("line_no"))
    pieces = joined(numbered.withColumn("_alone", alone), "_alone", *stretch)
    names = ["file", "run_no", "record_no", "line_no", "version", "ts"]
    message = F.when(F.col("record_no") > 0, F.coalesce("message", F.lit(""))).otherwise(F.col("message"))
    if not stretch:
        return pieces.select(*names, message.alias("message"))
    # Only the last record of a stretch goes on in later ones, where its lines come before the
    # first record; the others are whole, and stay where their lines met.
    goes_on = F.col("version").isNull() | (F.col("record_no") == F.col(stretch[1]))
    is_open = (F.col("record_no") > 0) & goes_on
    again = joined(pieces.where(is_open).select(*names, "message"))
    whole = pieces.where(~is_open).select(*names, "message").unionByName(again.select(*names, "message"))
    return whole.select(*names, message.alias("message"))


def evaluation_metrics(numbered: DataFrame) -> DataFrame:
    """``file, run_no, line_no, stage, metric, value`` of the evaluation records.

    ``nan`` and ``inf`` are numbers; lists, truth values and ``None`` have a null value. A
    record whose text can't be read has one row, with a null metric.
    """
    is_evaluation = F.col("message").rlike(EVALUATION)
    # The text is Python's; the JSON reader takes its single quotes, but not its bare words.
    told = F.regexp_extract("message", EVALUATION, 2)
    quoted = F.regexp_replace(told, BARE_WORD, "$1'$2'")
    entries = F.from_json(quoted, "map<string,string>")
    found = numbered.where(is_evaluation & F.col("version").isNotNull()).select(
        "file",
        "run_no",
        "line_no",
        F.regexp_extract("message", EVALUATION, 1).alias("stage"),
        F.explode_outer(entries).alias("metric", "text"),
    )
    return found.withColumn("value", F.col("text").try_cast("double")).drop("text")


def run_settings(numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per file, run and section, with the settings ``keys`` as columns.

    A setting belongs to the last section header of its run, or to section ''. If it is
    told more than once, the last line counts.
    """
    message = _bare(F.col("message"))
    wanted = list(keys)

    def setting(group: int) -> Column:
        return F.regexp_extract("m", SETTING, group)

    lines = numbered.where(F.col("version").isNotNull()).select(
        "file", "run_no", "section_no", "line_no", message.alias("m")
    )
    is_header = F.endswith("m", F.lit(":")) & F.col("m").rlike(SECTION)
    told = lines.select(
        "file",
        "run_no",
        "section_no",
        "line_no",
        F.when(is_header, F.regexp_extract("m", SECTION, 1)).alias("section"),
        F.when(~is_header & F.col("m").rlike(SETTING), setting(1)).alias("key"),
        F.when(~is_header, setting(2)).alias("text"),
    ).where(F.col("section").isNotNull() | F.col("key").isin(wanted))
    last = F.struct("line_no", "text")
    values = [F.max(F.when(F.col("key") == key, last)).alias(key) for key in wanted]
    # A section of an earlier run has no header in this one.
    sections = told.groupBy("file", "run_no", "section_no").agg(
        F.coalesce(F.max("section"), F.lit("")).alias("section"), *values
    )
    found = sections.where(F.coalesce(*map(named, wanted)).isNotNull())
    return found.groupBy("file", "run_no", "section").agg(
        *[F.max(named(key))["text"].alias(key) for key in wanted]
    )


def stage_durations(numbered: DataFrame) -> DataFrame:
    """Seconds from each record to the next one of the same run.

    Every record reports its time to itself and to the record before it, so that a
    group of two holds both times.
    """
    records = numbered.where(F.col("version").isNotNull() & F.col("ts").isNotNull())
    own = F.struct(F.col("record_no").alias("record_no"), F.col("line_no").alias("line_no"),
                   F.col("message").alias("message"), F.col("ts").alias("ts"),
                   F.lit(None).cast("timestamp_ntz").alias("next_ts"))
    next_one = F.struct((F.col("record_no") - 1).alias("record_no"),
                        F.lit(None).cast("bigint").alias("line_no"),
                        F.lit(None).cast("string").alias("message"),
                        F.lit(None).cast("timestamp_ntz").alias("ts"),
                        F.col("ts").alias("next_ts"))
    reports = records.select("file", "run_no", F.inline(F.array(own, next_one)))
    both = reports.groupBy("file", "run_no", "record_no").agg(
        *[F.max(name).alias(name) for name in ("line_no", "message", "ts", "next_ts")]
    )
    known = both.where(F.col("ts").isNotNull() & F.col("next_ts").isNotNull())
    return known.withColumn("seconds", F.timestamp_diff("SECOND", F.col("ts"), F.col("next_ts")))


def sample_translations(
    parsed: DataFrame, task: str, indices: Sequence[int] | None = None
) -> DataFrame:
    """``file, i, translation`` of the samples of a task in lines, which need not be parsed yet.

    A sample is the first line of a file announcing its number; its translation
    stands two lines below. With ``indices`` every file has a row for each of them,
    and a missing sample is null.
    """
    header = rf'^TRANSLATION (\d+) on "\Q{task}\E"$'
    message = _bare(F.col("message"))
    if SPLIT in parsed.columns:
        return _listed(_first_in_place(parsed, task, header, indices), indices)

    def stretch(line_no: Column) -> Column:
        return F.call_function("div", line_no, F.lit(SPANS[0]))

    # The lines are read once. Those of a stretch meet in one window, and its last announcements
    # find their translation there too: the first two lines of the next one are in both.
    own, above = stretch(F.col("line_no")), stretch(F.col("line_no") - 2)
    places = F.when(own == above, F.array(own)).otherwise(F.array(above, own))
    held = parsed.select("file", "line_no", "value", F.explode(places).alias("_stretch"))
    window = Window.partitionBy("file", "_stretch").orderBy("line_no")
    below = F.coalesce(*[
        F.when(F.lead("line_no", n).over(window) == F.col("line_no") + 2, F.lead("value", n).over(window))
        for n in (1, 2)
    ])
    placed = held.select(
        "file",
        "line_no",
        "value",
        # Lines of no file belong together in nothing.
        F.when(F.col("file").isNotNull(), below).alias("_below"),
        (own == F.col("_stretch")).alias("_own"),
        (F.row_number().over(window) == 1).alias("_first"),
    )
    # Raw lines are looked at first, so that only candidates are parsed. The first line of a
    # stretch stays to tell that there is such a file.
    likely = F.col("_own") & F.contains("value", F.lit(f' on "{task}"'))
    kept = parse_lines(placed.where(likely if indices is None else likely | F.col("_first")))
    announces = F.col("_own") & F.startswith(message, F.lit("TRANSLATION ")) & message.rlike(header)
    number = F.when(announces, F.regexp_extract(message, header, 1).cast("bigint"))
    told = kept.select("file", number.alias("i"), "line_no", "_below")
    if indices is None:
        told = told.where(F.col("i").isNotNull())
    else:
        told = told.where(F.col("i").isNull() | F.col("i").isin(list(indices)))
    first = told.groupBy("file", "i").agg(F.min(F.struct("line_no", "_below")).alias("_at"))
    return _listed(first.select("file", "i", F.col("_at")["_below"].alias("value")), indices)


def _first_in_place(
    lines: DataFrame, task: str, header: str, indices: Sequence[int] | None
) -> DataFrame:
    """``file, i, value``: the line two below the first announcement of each sample, of placed lines.

    Only announcements at the end of a split and the lines at the beginning of one have to meet; of
    the others a task keeps the first of each sample. With ``indices`` each file has a row without ``i``.
    """
    value, line_no, at = F.col("value"), F.col("line_no"), F.col("line_no") - F.col(SPLIT)
    message = _bare(_message_of(value))
    told = F.startswith(message, F.lit("TRANSLATION ")) & message.rlike(header)
    # Raw lines are looked at first, so that only candidates are parsed.
    announces = F.when(F.contains(value, F.lit(f' on "{task}"')) & told, F.regexp_extract(message, header, 1).cast("bigint"))
    numbered = lines.select("file", "line_no", "value", SPLIT, REST, announces.alias("_own"))
    above = _in_place(line_no, F.col(SPLIT), F.coalesce("_own", F.lit(-1)), lag=2)
    seen = numbered.select("*", above["s0"].alias("_above"))
    if indices is not None:
        wanted = list(indices)
        seen = seen.withColumns({n: F.when(F.col(n).isin(wanted), F.col(n)) for n in ("_own", "_above")})

    def entry(when: Column, i: Column | None = None, key: Column | None = None, own: Column | None = None, text: Column | None = None):
        number = F.lit(None).cast("bigint")
        parts = [(i, "i"), (key, "key"), (own, "own")]
        numbers = [(number if part is None else part).alias(name) for part, name in parts]
        return F.when(when, F.struct(*numbers, (F.lit(None).cast("string") if text is None else text).alias("text")))

    ends, begins = F.col(REST) < 2, at < 2
    entries = [
        entry(F.col("_above") >= 0, i=F.col("_above"), key=line_no - 2, text=value),
        entry(F.col("_own").isNotNull() & ends, key=line_no, own=F.col("_own")),
        entry(begins & (line_no >= 2), key=line_no - 2, text=value),
        *([] if indices is None else [entry(at == 0)]),
    ]
    met = seen.select("file", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
    # At the ends of splits the two lines of an announcement meet by its line number.
    apart = F.when(F.col("i").isNull(), F.col("key"))
    pairs = met.groupBy("file", "i", apart.alias("_apart")).agg(
        F.min(F.when(F.col("i").isNotNull(), F.struct("key", "text"))).alias("_inside"),
        F.max("own").alias("_own"),
        F.max(F.when(F.col("i").isNull(), F.col("text"))).alias("_text"),
    )
    across = F.struct(F.col("_apart").alias("key"), F.col("_text").alias("text"))
    both = pairs.select(
        "file",
        F.coalesce("i", "_own").alias("i"),
        F.coalesce("_inside", across).alias("_at"),
        F.col("_apart").isNull().alias("_known"),
    ).where(F.col("i").isNotNull() | F.col("_known"))
    first = both.groupBy("file", "i").agg(F.min("_at").alias("_at"))
    return first.select("file", "i", F.col("_at")["text"].alias("value"))


def _listed(first: DataFrame, indices: Sequence[int] | None) -> DataFrame:
    """``file, i, translation`` from the line ``value`` below an announcement."""
    message = _bare(F.col("message"))
    samples = parse_lines(first)
    found = samples.select("file", "i", without_prefix(message, GENERATED).alias("translation"))
    if indices is None:
        return found
    listed = F.array(*[F.lit(i).cast("bigint") for i in indices])
    known = F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "translation")))
    files = found.groupBy("file").agg(F.map_from_entries(known).alias("_known"))
    asked = files.select("file", "_known", F.explode(listed).alias("i"))
    return asked.select("file", "i", F.try_element_at("_known", F.col("i")).alias("translation"))
