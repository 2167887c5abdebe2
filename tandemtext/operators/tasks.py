"""Training tables: best and worst candidates, prompts, staged mixtures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.functions.text import named, prompt
from tandemtext.operators.ordering import is_leading, leading_key, order_key, seeded_shuffle

REPEAT_TASK = "Repeat the best translation"


def has_invalid_score(keys: Sequence[str]) -> Column:
    """A score is missing or not a number, so the row has no best candidate."""
    return reduce(
        lambda a, b: a | b, [named(k).isNull() | F.isnan(named(k).cast("double")) for k in keys]
    )


def _pick(translations: Sequence[str], keys: Sequence[str], extreme: Column) -> Column:
    scores = F.array(*[named(k) for k in keys])
    texts = F.array(*[named(t) for t in translations])
    chosen = F.element_at(texts, F.array_position(scores, extreme).cast("int"))
    invalid = F.raise_error(F.lit("null or NaN score among " + ", ".join(keys)))
    return F.when(has_invalid_score(keys), invalid).otherwise(chosen)


def best_candidate(translations: Sequence[str], keys: Sequence[str]) -> Column:
    """The candidate with the highest score, the first of equals."""
    return _pick(translations, keys, F.greatest(*map(named, keys)) if len(keys) > 1 else named(keys[0]))


def worst_candidate(translations: Sequence[str], keys: Sequence[str]) -> Column:
    """The candidate with the lowest score, the first of equals."""
    return _pick(translations, keys, F.least(*map(named, keys)) if len(keys) > 1 else named(keys[0]))


def score_margin(keys: Sequence[str]) -> Column:
    """Highest minus lowest score; a missing score is an error, not a row less."""
    scores = F.array(*[named(k) for k in keys])
    invalid = F.raise_error(F.lit("null or NaN score among " + ", ".join(keys))).cast("double")
    margin = F.array_max(scores) - F.array_min(scores)
    return F.when(has_invalid_score(keys), invalid).otherwise(margin)


def preference_pairs(
    df: DataFrame,
    translations: Sequence[str],
    keys: Sequence[str],
    source: str = "en",
    task: str = "",
    target: str | None = None,
    drop_ties: bool = False,
    min_margin: float | None = None,
) -> DataFrame:
    """``prompt, good, bad``, and the gold ``label`` if a target column is given.

    Rows whose scores are all equal have the same good and bad text; ``drop_ties``
    leaves them out, ``min_margin`` also the near ties.
    """
    kept = df
    if drop_ties:
        kept = kept.where(score_margin(keys) > 0)
    if min_margin is not None:
        kept = kept.where(score_margin(keys) >= min_margin)
    return kept.select(
        *[c for c in ("id", "split") if c in df.columns],
        prompt(task, named(source)).alias("prompt"),
        *([named(target).alias("label")] if target else []),
        best_candidate(translations, keys).alias("good"),
        worst_candidate(translations, keys).alias("bad"),
    )


def shuffled_candidates(translations: Sequence[str], key: str = "id", seed: int | str = 42) -> Column:
    """The candidates of a row in a random order that only depends on the row."""
    entries = [
        F.struct(
            F.md5(F.concat(F.lit(f"{seed}|"), named(key).cast("string"), F.lit(f"|{i}"))).alias("h"),
            F.lit(i).alias("i"),
            named(name).alias("text"),
        )
        for i, name in enumerate(translations)
    ]
    return F.array_sort(F.array(*entries))["text"]


def repeat_examples(
    df: DataFrame,
    translations: Sequence[str],
    keys: Sequence[str],
    source: str = "en",
    key: str = "id",
    seed: int | str = 42,
) -> DataFrame:
    """Prompt with all candidates and the source below each other; the best is the label."""
    lines = F.concat_ws(
        "\n",
        F.lit(f"{REPEAT_TASK}:"),
        shuffled_candidates(translations, key, seed),
        named(source),
    )
    # concat_ws leaves nulls out, which would hide a missing candidate.
    missing = reduce(lambda a, b: a | b, [named(c).isNull() for c in [*translations, source]])
    return df.select(
        *[c for c in ("id", "split") if c in df.columns],
        F.when(missing, F.raise_error(F.lit("missing text in a repeat example")))
        .otherwise(lines)
        .alias("prompt"),
        best_candidate(translations, keys).alias("label"),
    )


def repeat_preview(df: DataFrame, source: str = "en") -> DataFrame:
    """Previews of the repeat task show the source alone, without candidates."""
    return df.select("id", prompt(REPEAT_TASK, named(source)).alias("prompt"))


def translation_examples(
    df: DataFrame, task: str, source: str = "en", target: str = "es"
) -> DataFrame:
    label = F.coalesce(named(target).cast("string"), F.lit("None"))
    return df.select(
        *[c for c in ("id", "split") if c in df.columns],
        prompt(task, named(source)).alias("prompt"),
        label.alias("label"),
    )


def epochs_of(
    df: DataFrame, epochs: float | Fraction, key: str = "id", seed: int | str = 42
) -> DataFrame:
    """Each row once per epoch, with ``epoch`` from 1.

    A last, broken epoch holds the leading part of the seeded order; its size is exact in
    the decimals ``epochs`` is written in. Every row is read once and repeated in place.
    """
    exact = Fraction(str(epochs))
    whole = int(exact)
    listed = F.array(*[F.lit(epoch) for epoch in range(1, whole + 1)]).cast("array<int>")
    if exact > whole:
        longer = F.array(*[F.lit(epoch) for epoch in range(1, whole + 2)])
        leading = is_leading(df, key, exact - whole, seed)
        listed = F.when(leading, longer).otherwise(listed)
    return df.withColumn("epoch", F.explode(listed))


def stages(mixture: int, epochs: float) -> list[tuple[str, Fraction]]:
    """Order of the tasks and their epochs: judge first, translate first, or judge only."""
    if mixture == 2:
        return [("judge", Fraction(str(epochs)))]
    order = {0: ("judge", "translate"), 1: ("translate", "judge")}[mixture]
    return [(task, Fraction(str(epochs)) / 2) for task in order]


def staged_mixture(
    judge: DataFrame,
    translate: DataFrame,
    mixture: int,
    epochs: float,
    key: str = "id",
    seed: int | str = 42,
) -> DataFrame:
    """The rows every stage trains on, with ``stage, task, epoch``."""
    examples = {"judge": judge, "translate": translate}
    parts = [
        epochs_of(examples[task], length, key, f"{seed}|{task}")
        .withColumn("stage", F.lit(number))
        .withColumn("task", F.lit(task))
        for number, (task, length) in enumerate(stages(mixture, epochs), 1)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def epoch_manifest(
    examples: Mapping[str, DataFrame],
    mixture: int,
    epochs: float,
    key: str = "id",
    seed: int | str = 42,
) -> DataFrame:
    """``stage, task, epoch, order_seed, cut_seed, cut``: a row for each epoch of a staged mixture.

    The examples themselves are stored once, whatever the number of epochs. An epoch goes
    through its task's rows in an order of its own, by ``order_seed``. A broken epoch holds the
    rows up to the key ``cut`` in the order of ``cut_seed``; whole ones have no cut.
    """
    rows, spark = [], next(iter(examples.values())).sparkSession
    for number, (task, length) in enumerate(stages(mixture, epochs), 1):
        whole, part = int(length), length - int(length)
        told = [(number, task, epoch, f"{seed}|{task}|{number}|{epoch}") for epoch in range(1, whole + 2)]
        rows += [(*row, None, None) for row in told[:whole]]
        if part:
            cut_seed = f"{seed}|{task}"
            last = leading_key(examples[task], key, part, cut_seed)
            # An epoch without a row has no line.
            rows += [(*told[whole], cut_seed, last)] if last is not None else []
    schema = "stage int, task string, epoch int, order_seed string, cut_seed string, cut string"
    return spark.createDataFrame(rows, schema).coalesce(1)


def replay(examples: DataFrame, manifest: DataFrame, key: str = "id") -> DataFrame:
    """The rows of every epoch of a manifest, with ``stage, epoch, place``.

    ``examples`` are stored once with their ``task``. Within an epoch rows are read in the order
    of ``place``. The manifest has a row an epoch, and is what meets the examples.
    """
    of_task = manifest.withColumnRenamed("task", "_task")
    met = examples.join(F.broadcast(of_task), F.col("task") == F.col("_task"))
    inside = F.col("cut").isNull() | (order_key(key, F.col("cut_seed")) <= F.col("cut"))
    return met.where(inside).select(
        *map(named, examples.columns), "stage", "epoch", order_key(key, F.col("order_seed")).alias("place")
    )


def read_epoch(
    examples: DataFrame, manifest: DataFrame, stage: int, epoch: int, key: str = "id", partitions: int | None = None
) -> DataFrame:
    """The examples of one epoch in its order, partition after partition; no other is touched."""
    told = manifest.where((F.col("stage") == stage) & (F.col("epoch") == epoch)).collect()
    if not told:
        raise ValueError(f"stage {stage} has no epoch {epoch}")
    [row] = told
    rows = examples.where(F.col("task") == row["task"])
    if row["cut"] is not None:
        rows = rows.where(order_key(key, row["cut_seed"]) <= row["cut"])
    return seeded_shuffle(rows, key, row["order_seed"], partitions)


def step_plan(
    df: DataFrame, batch_size: int, save_at: float, groups: Sequence[str] = ()
) -> DataFrame:
    """How often to save while training on the given rows: every so many steps, or per epoch."""
    counted = df.groupBy(*groups).agg(F.count("*").alias("train_rows"))
    batches = F.floor(F.col("train_rows") / batch_size)
    steps = F.lit(1) if save_at == 1 else F.floor(batches * F.lit(float(save_at)))
    return counted.withColumns(
        {
            "strategy": F.lit("epoch" if save_at == 1 else "steps"),
            "save_steps": steps.cast("bigint"),
        }
    )


def hinge_margin(good: Column, bad: Column, gamma: float = 1.0) -> Column:
    """``max(0, gamma - good + bad)`` as the trainer computes it; NaN counts as 0."""
    value = F.lit(float(gamma)) - good + bad
    return F.when(~F.isnan(value) & (value > 0), value).otherwise(F.lit(0.0))
