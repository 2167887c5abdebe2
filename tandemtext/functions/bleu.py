"""BLEU: one Arrow pass for the n-gram statistics, columns for everything else.

A (prediction, reference) pair is reduced to ten integers: both lengths, the
clipped matches and the n-gram totals of orders 1 to 4. They add up, so the score
of a corpus is a plain sum of integers followed by the same closing formula.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import log

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ORDER = 4
PARTS = (
    "sys_len", "ref_len",
    "match_1", "match_2", "match_3", "match_4",
    "total_1", "total_2", "total_3", "total_4",
)

# Fixed values of the public 13a tokenization, in the order they apply.
SKIPPED = "<skipped>"
BROKEN_WORD = "-\n"
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
SIGNS = "!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"
STOP_AFTER_NON_DIGIT = (r"([^0-9])([\.,])", r"\1 \2 ")
STOP_BEFORE_NON_DIGIT = (r"([\.,])([^0-9])", r" \1 \2")
DASH_AFTER_DIGIT = (r"([0-9])(-)", r"\1 \2 ")


def spacer_13a() -> Callable[[pa.Array], pa.Array]:
    """Puts blanks between the 13a tokens of an Arrow array of texts.

    Patterns only run on texts that need them: a stop keeps its place only in front
    of a digit, and elsewhere plain replacement comes to the same. All it needs is
    local, so it travels with the plan. Single signs get their blanks in one pass over the bytes.
    """
    skipped, broken, entities, signs = SKIPPED, BROKEN_WORD, ENTITIES, SIGNS
    stops, dash = (STOP_AFTER_NON_DIGIT, STOP_BEFORE_NON_DIGIT), DASH_AFTER_DIGIT

    def spaced(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def replace(array, pairs):
            for old, new in pairs:
                array = pc.replace_substring(array, old, new)
            return array

        def apart(array, wanted):
            """Blanks around single signs, all of them one byte in UTF-8."""
            if not len(array):
                return array
            is_sign = np.zeros(256, dtype=bool)
            is_sign[list(wanted.encode())] = True
            ends = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset:array.offset + len(array) + 1]
            told = np.frombuffer(array.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
            at = np.flatnonzero(is_sign[told])
            if not len(at):
                return array
            if len(told) + 2 * len(at) >= 1 << 31:
                return replace(array, [(sign, f" {sign} ") for sign in wanted])
            # Each sign takes its place behind the blanks of the signs before it.
            earlier = 2 * np.searchsorted(at, ends - ends[0]).astype(np.int32)
            spread = np.insert(told, np.concatenate([at, at + 1]), 32)
            moved = (ends - ends[0] + earlier).astype(np.int32)
            return pa.StringArray.from_buffers(len(array), pa.py_buffer(moved), pa.py_buffer(spread))

        def where(mask, change, array):
            """``change`` applied to the texts of the mask."""
            if not pc.any(mask).as_py():
                return array
            return pc.replace_with_mask(array, mask, change(array.filter(mask)))

        def by_pattern(array):
            array = pc.binary_join_element_wise(" ", array, " ", "")
            for pattern, spacing in stops:
                array = pc.replace_substring_regex(array, pattern, spacing)
            return array

        out = replace(pc.utf8_rtrim_whitespace(texts), [(skipped, ""), (broken, ""), ("\n", " ")])
        out = where(pc.match_substring(out, "&"), lambda a: replace(a, entities), out)
        out = apart(out, signs)
        numeric = pc.match_substring_regex(out, "[.,][0-9]")
        plain = apart(out, ".,")
        if pc.any(numeric).as_py():
            plain = pc.replace_with_mask(plain, numeric, by_pattern(out.filter(numeric)))
        return where(
            pc.match_substring(plain, "-"), lambda a: pc.replace_substring_regex(a, *dash), plain
        )

    return spaced


def _counting_udf() -> Callable[..., Column]:
    max_order, spaced = MAX_ORDER, spacer_13a()
    # Texts are counted together up to this size, which bounds memory and key width.
    chunk_bytes = 1 << 19

    def count(references: pa.Array, *predictions: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        def packed(high, low, low_size):
            """Pairs of numbers as one number; the first is renumbered if it gets too wide."""
            if len(high) and (int(high.max()) + 1) * low_size >= 1 << 63:
                high = np.unique(high, return_inverse=True)[1]
            return high * low_size + low

        def chunk(columns):
            rows, texts = len(columns[0]), pa.concat_arrays(columns).fill_null("")
            tokens = pc.utf8_split_whitespace(spaced(texts))
            encoded = tokens.flatten().dictionary_encode()
            codes = encoded.indices.to_numpy().astype(np.int64)
            text_of = np.repeat(np.arange(len(texts)), pc.list_value_length(tokens).to_numpy())
            blank = pc.index(encoded.dictionary, "").as_py()
            if blank >= 0:
                codes, text_of = codes[codes != blank], text_of[codes != blank]
            vocabulary = len(encoded.dictionary) + 1
            lengths = np.bincount(text_of, minlength=len(texts)).reshape(len(columns), rows)
            row_of = text_of % rows
            out = np.zeros((rows, len(columns) - 1, 2 + 2 * max_order), dtype=np.int32)
            out[:, :, 0], out[:, :, 1] = lengths[1:].T, lengths[0][:, None]
            grams = codes
            for order in range(1, max_order + 1):
                if order > 1:
                    grams = packed(grams[:-1], codes[order - 1:], vocabulary)
                inside = text_of[:len(grams)] == text_of[order - 1:]
                of_row, of_text = row_of[:len(grams)][inside], text_of[:len(grams)][inside]
                keys = packed(grams[inside], of_row, rows)
                ends = np.searchsorted(of_text, np.arange(len(columns) + 1) * rows)
                wanted, wanted_times = np.unique(keys[:ends[1]], return_counts=True)
                out[:, :, 1 + max_order + order] = np.maximum(lengths[1:].T - order + 1, 0)
                if not len(wanted):
                    continue
                for i in range(len(columns) - 1):
                    found, times = np.unique(keys[ends[i + 1]:ends[i + 2]], return_counts=True)
                    at = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                    same = wanted[at] == found
                    clipped = np.minimum(times[same], wanted_times[at[same]])
                    out[:, i, 1 + order] = np.bincount(found[same] % rows, clipped, rows)
            return out

        columns = [references, *predictions]
        sizes = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy() for c in columns))
        parts, start = [], 0
        while start < len(references):
            before = sizes[start - 1] if start else 0
            stop = max(int(np.searchsorted(sizes, before + chunk_bytes)), start + 1)
            parts.append(chunk([c.slice(start, stop - start) for c in columns]))
            start = stop
        width, parts_per_row = 2 + 2 * max_order, len(predictions)
        flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, dtype=np.int32)
        n = len(references) * parts_per_row
        missing = np.zeros(n, dtype=bool)
        for i, column in enumerate(predictions):
            unknown = pc.or_(pc.is_null(column), pc.is_null(references))
            missing[i::parts_per_row] = unknown.to_numpy(zero_copy_only=False)
        stats = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(flat), mask=pa.array(missing)
        )
        bounds = np.arange(len(references) + 1) * parts_per_row
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), stats)

    # Counted as nondeterministic, so that a filter on a score does not count twice.
    return F.arrow_udf(count, T.ArrayType(T.ArrayType(T.IntegerType()))).asNondeterministic()


def statistics_of(predictions: Sequence[Column], reference: Column) -> Column:
    """Array with the ten statistics of each prediction against one reference.

    The reference is tokenized and counted once, however many predictions it has.
    """
    return _counting_udf()(reference, *predictions)


def statistics(prediction: Column, reference: Column) -> Column:
    return statistics_of([prediction], reference)[0]


def part(stats: Column, name: str) -> Column:
    return F.get(stats, F.lit(PARTS.index(name)))


def summed(stats: Column) -> Column:
    """Aggregate: the statistics of many pairs added up, as an array."""
    return F.array(*[F.sum(F.get(stats, F.lit(i))) for i in range(len(PARTS))])


def _parts(stats: Column, kind: str) -> list[Column]:
    return [part(stats, f"{kind}_{order}") for order in range(1, MAX_ORDER + 1)]


def _brevity(stats: Column) -> Column:
    sys_len, ref_len = part(stats, "sys_len"), part(stats, "ref_len")
    return (
        F.when(sys_len >= ref_len, F.lit(1.0))
        .when(sys_len == 0, F.lit(0.0))
        .otherwise(F.exp(1 - ref_len / sys_len))
    )


def _smoothed_precisions(stats: Column) -> list[Column]:
    """Percent precisions; the k-th order without a match counts as 1 / 2^k of a match."""
    precisions, misses = [], F.lit(0)
    matches, totals = _parts(stats, "match"), _parts(stats, "total")
    for match, total in zip(matches, totals):
        misses = misses + (match == 0).cast("int")
        precisions.append(
            F.when((total == 0) | (matches[0] == 0), F.lit(0.0))
            .when(match == 0, 100.0 / (F.pow(F.lit(2.0), misses) * total))
            .otherwise(100.0 * match / total)
        )
    return precisions


def _mean_log_precision(stats: Column) -> Column:
    """Mean of ``ln(matches / totals)`` over the orders, an order without a match left as 1.

    Written as sums of logarithms: each statistic occurs once, which keeps the
    generated code small for wide tables.
    """
    one = F.lit(1)
    terms = [F.ln(F.greatest(match, one)) for match in _parts(stats, "match")]
    terms += [-F.ln(F.greatest(total, one)) for total in _parts(stats, "total")]
    return reduce(lambda a, b: a + b, terms) / MAX_ORDER


def _smoothing(stats: Column) -> Column:
    """Mean logarithm of what smoothing takes off.

    Without a match of one order there is none of a longer one, so the last ``z``
    orders are the missing ones, and they are halved 1, 2, .. z times.
    """
    z = reduce(lambda a, b: a + b, [(m == 0).cast("int") for m in _parts(stats, "match")])
    return F.element_at(F.array(*[F.lit(log(2) * k * (k + 1) / 2 / MAX_ORDER)
                                  for k in range(MAX_ORDER + 1)]), z + 1)


def _known(stats: Column, value: Column) -> Column:
    return F.when(stats.isNotNull(), value)


def score(stats: Column) -> Column:
    """Smoothed BLEU, 0 to 100."""
    empty = (part(stats, "match_1") == 0) | (part(stats, f"total_{MAX_ORDER}") == 0)
    value = 100.0 * _brevity(stats) * F.exp(_mean_log_precision(stats) - _smoothing(stats))
    return _known(stats, F.when(empty, F.lit(0.0)).otherwise(value))


def metric(stats: Column) -> Column:
    """All keys of the smoothed metric."""
    return F.struct(
        score(stats).alias("score"),
        F.array(*_parts(stats, "match")).alias("counts"),
        F.array(*_parts(stats, "total")).alias("totals"),
        F.array(*_smoothed_precisions(stats)).alias("precisions"),
        _brevity(stats).alias("bp"),
        part(stats, "sys_len").alias("sys_len"),
        part(stats, "ref_len").alias("ref_len"),
    )


def plain_metric(stats: Column) -> Column:
    """All keys of the unsmoothed metric, scaled 0 to 1."""
    sys_len, ref_len = part(stats, "sys_len"), part(stats, "ref_len")
    precisions = [
        F.when(total > 0, match / total).otherwise(F.lit(0.0))
        for match, total in zip(_parts(stats, "match"), _parts(stats, "total"))
    ]
    missing = part(stats, f"match_{MAX_ORDER}") == 0
    value = _brevity(stats) * F.exp(_mean_log_precision(stats))
    return F.struct(
        _known(stats, F.when(missing, F.lit(0.0)).otherwise(value)).alias("bleu"),
        F.array(*precisions).alias("precisions"),
        _brevity(stats).alias("brevity_penalty"),
        F.when(ref_len > 0, sys_len / ref_len).alias("length_ratio"),
        sys_len.alias("translation_length"),
        ref_len.alias("reference_length"),
    )


METRICS: dict[str, Callable[[Column], Column]] = {"sacrebleu": metric, "bleu": plain_metric}


def metric_columns(name: str, stats: Column, keys: Sequence[str]) -> list[Column]:
    """The chosen keys of a metric as columns ``<metric>_<key>``."""
    if isinstance(keys, str):
        raise TypeError("keys has to be a list of key names")
    values = METRICS[name](stats)
    return [values[key].alias(f"{name}_{key}") for key in keys]


def rounded(value: Column, digits: int = 4) -> Column:
    """Rounds half to even on the shortest decimal form of the number."""
    return F.bround(value, digits)
