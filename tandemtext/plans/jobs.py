"""The three jobs: build a corpus, score models on it, build training tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tandemtext.functions.text import named, output_name
from tandemtext.operators import corpus, generate, merge, ordering, tasks
from tandemtext.session import scratch_path, shuffles_dropped
from tandemtext.sources.files import read_splits, write_splits

# Stored tables that are merged in one step, and the most steps, each of which reads all of them.
STEP_BYTES, MOST_STEPS = 1 << 27, 8


def _split_by_keys(
    clean: DataFrame,
    key: str | Sequence[str],
    train_size: float,
    test_size: float | None,
    seed: int | str,
) -> DataFrame:
    """The keys of the clean pairs are written once, and the cuts are found in them.

    The texts are not stored for that: the pairs are derived again when the split is added.
    """
    path, names = scratch_path(clean.sparkSession, "keys"), [key] if isinstance(key, str) else list(key)
    with shuffles_dropped(clean.sparkSession):
        clean.select(*map(named, names)).write.parquet(path)
    keys = clean.sparkSession.read.parquet(path)
    return ordering.exact_split(clean, key, train_size, test_size, seed, counted=keys)


def build_corpus(
    corpora: Mapping[str, DataFrame],
    source: str,
    target: str,
    train_size: float = 0.7,
    test_size: float | None = None,
    seed: int | str = 42,
) -> DataFrame:
    """Bilingual corpora to clean pairs ``id, <source>, <target>, split``."""
    pairs = corpus.union_corpora(corpora, source, target)
    return _split_by_keys(corpus.quality_filter(pairs, source, target), "id", train_size, test_size, seed)


def build_plain_corpus(
    table: DataFrame,
    source: str,
    target: str,
    key: str | Sequence[str] = "id",
    train_size: float = 0.7,
    test_size: float | None = None,
    seed: int | str = 42,
) -> DataFrame:
    """The same from one table that already has a column per language."""
    pairs = corpus.both_strings(table, source, target)
    clean = corpus.quality_filter(pairs, source, target)
    return _split_by_keys(clean, key, train_size, test_size, seed)


def score_models(
    pairs: DataFrame,
    models: Mapping[str, Callable[[], generate.Translator]],
    source: str,
    target: str,
    task: str | None = None,
    batch_size: int | None = None,
    metric: str = "sacrebleu",
    key: str = "score",
) -> DataFrame:
    """Adds ``<model>`` and ``<model>_<key>`` for every model, in one pass."""
    candidates = generate.with_candidates(pairs, source, models, task, batch_size)
    return generate.with_scores(candidates, list(models), target, metric, key)


def merge_scored(spark, paths: Sequence[str], folder: str, steps: int | None = None) -> str:
    """Merges stored score tables into one, and returns where it is stored.

    Large tables are merged in ``steps``, as their size tells without it: what is shuffled for
    one of them is deleted before the next.
    """
    frames = [read_splits(spark, path) for path in paths]
    if steps is None:
        stored = sum(int(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for f in frames)
        steps = min(MOST_STEPS, 1 + stored // STEP_BYTES)
    path = f"{folder.rstrip('/')}/{output_name(paths)}"
    parts = merge.in_steps(frames, steps)
    for number, part in enumerate(parts, 1):
        mode = "errorifexists" if number == 1 else "append"
        write_splits(merge.natural_merge(part), path, mode, whole=number == len(parts))
    return path


def preference_mixture(
    scored: DataFrame,
    pairs: DataFrame,
    models: Sequence[str],
    mixture: int,
    epochs: float,
    task: str,
    source: str = "en",
    target: str = "es",
    seed: int | str = 42,
) -> DataFrame:
    """What a preference run trains on: (good, bad) pairs and plain translation, in stages."""
    keys = [f"{model}_score" for model in models]
    judge = tasks.preference_pairs(
        scored.where("split = 'train'"), models, keys, source
    ).withColumnRenamed("good", "label")
    translate = tasks.translation_examples(pairs.where("split = 'train'"), task, source, target)
    return tasks.staged_mixture(judge, translate, mixture, epochs, seed=seed)


def repeat_mixture(
    scored: DataFrame,
    pairs: DataFrame,
    models: Sequence[str],
    mixture: int,
    epochs: float,
    task: str,
    source: str = "en",
    target: str = "es",
    seed: int | str = 42,
) -> DataFrame:
    """What a repeat run trains on: repeat-the-best and plain translation, in stages."""
    keys = [f"{model}_score" for model in models]
    judge = tasks.repeat_examples(scored.where("split = 'train'"), models, keys, source, seed=seed)
    translate = tasks.translation_examples(pairs.where("split = 'train'"), task, source, target)
    return tasks.staged_mixture(judge, translate, mixture, epochs, seed=seed)
