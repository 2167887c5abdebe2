"""Secret scan: known forms, and strings that pass a battery of randomness tests.

A long run of letters, digits and the signs of base64 is a candidate, and so are its long parts
between slashes and pluses, between dashes and underscores, and between any of them; of those
that count and overlap the longest is reported. Dashes between hexadecimal digits are no signs. By its signs it gets
the smallest alphabet it fits, and under the hypothesis that it is drawn evenly from that
alphabet three tests are made: chi-squared for even use of the signs, runs above and below
the middle, and serial correlation; Fisher's method combines them. Plain words must fail,
and short ones often don't. So the share of plain text that passes is measured by length
and alphabet, each on the letters of all documents cut to such lengths (for hexadecimal alphabets
on their digits and letters a to f outside candidates), and the level at
which a candidate counts is set by length and alphabet such that false discoveries stay below a
share of all discoveries; where no level does that, nothing is reported. Texts are cut one by
one, and those shorter than a length are joined by their hash, so the shares are the same
however rows are ordered, batched and dealt out.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.spans import touching
from tandemtext.llm.stored import stored

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
# A match of the assign form has one of these, whatever its case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 24 at least are the same as runs, filtered.
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
SEPARATORS = tuple(re.compile(f"[^{signs}]{{20,}}") for signs in ("/+", "_-", "/+_-"))
DASHED = re.compile(r"(?=[^A-F]*$|[^a-f]*$)[0-9A-Fa-f]+(?:-[0-9A-Fa-f]+)+")
LENGTHS = (20, 28, 40, 64)  # lower ends of the classes of length
LEVELS = (0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5)
FALSE_SHARE = 0.05
POOL_LETTERS = 1 << 12  # about so many letters of short texts are joined
_WINDOWS = 1 << 13
_DEAD = 12.0  # from this sum of Fisher's on no level is reached


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the known forms, in code points."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def parts(run: str) -> list[tuple[int, int]]:
    """Start and end of the run, without its padding, and of its parts of 20 signs at least."""
    word = run.rstrip("=")
    found = {(m.start(), m.end()): None for pattern in SEPARATORS for m in pattern.finditer(word)}
    return list({(0, len(word)): None} | found)


def longest(spans: list[dict]) -> list[dict]:
    """The spans of known forms, and random ones from the longest on that touch none before them."""
    starts: list[int] = []
    ends: list[int] = []
    out = [s for s in spans if s["kind"] < 3]
    for s in sorted((s for s in spans if s["kind"] == 3), key=lambda s: (s["start"] - s["end"], s["start"])):
        i = bisect(starts, s["start"])
        if (i == 0 or ends[i - 1] <= s["start"]) and (i == len(starts) or s["end"] <= starts[i]):
            starts.insert(i, s["start"])
            ends.insert(i, s["end"])
            out.append(s)
    return sorted(out, key=lambda s: (s["start"], s["kind"], s["end"]))


def tail(z: np.ndarray) -> np.ndarray:
    """Probability above z of the normal distribution, to seven places (rational approximation)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = series * np.exp(-x * x) / 2
    return np.where(z >= 0, half, 1 - half)


def battery(indices: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Combined probability, for strings of an alphabet of ``size``, of looking less even by chance.

    ``indices`` are the signs' places in the alphabet, string after string.
    """
    n = lengths.astype(float)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    rows = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.bincount(rows * size + indices, minlength=len(lengths) * size).reshape(-1, size)
    chi = (counts.astype(float) ** 2).sum(axis=1) * size / n - n
    even = tail((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n))
    high = (indices >= size // 2).astype(np.int64)
    inner = np.ones(len(indices), bool)
    inner[ends - 1] = False
    follow = np.flatnonzero(inner)
    change = np.bincount(rows[follow], high[follow] != high[follow + 1], len(lengths))
    share = 2 * (size // 2) * (size - size // 2) / size**2
    runs = 2 * tail(np.abs((change - (n - 1) * share) / np.sqrt((n - 1) * share * (1 - share))))
    centred = (indices - (size - 1) / 2) / np.sqrt((size * size - 1) / 12)
    product = np.bincount(rows[follow], centred[follow] * centred[follow + 1], len(lengths))
    serial = 2 * tail(np.abs(product / np.sqrt(n - 1)))
    x = -sum(np.log(np.clip(p, 1e-300, 1)) for p in (even, runs, serial))
    return np.exp(-x) * (1 + x + x * x / 2)


def alphabet_tables() -> tuple[list[frozenset], np.ndarray]:
    tables = np.full((len(ALPHABETS), 128), 0, np.int64)
    for i, signs in enumerate(ALPHABETS):
        tables[i, [ord(c) for c in signs]] = np.arange(len(signs))
    return [frozenset(a) for a in ALPHABETS], tables


def is_hexadecimal(signs: str) -> bool:
    return not {"z", "Z"} & set(signs)


def plain_tallies(
    letters: np.ndarray, sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, hexadecimal: bool = False
) -> np.ndarray:
    """For each cell how many strings plain text gives, and how many of them reach each level.

    ``letters`` are the ASCII letters of texts one after the other, ``sizes`` their numbers. A text
    is cut to each length from its start, and once more at its end where letters are left; every
    alphabet that has the letters sees all of these strings. The probabilities are those of ``battery``.
    With ``hexadecimal`` they are hexadecimal signs, and only alphabets of these see them.
    """
    tallies = np.zeros((len(ALPHABETS) * len(LENGTHS), len(LEVELS) + 1), np.int64)
    # The tests see the places of signs and the size only, so alphabets can share them.
    alike: dict[tuple[bool, int], list[int]] = {}
    for i, signs in enumerate(ALPHABETS):
        if is_hexadecimal(signs) == hexadecimal:
            alike.setdefault(({"z", "Z"} <= set(signs), len(signs)), []).append(i)
    folded = (letters & 31) - 1
    places = {False: (folded, 26), True: (folded + 26 * (letters >= 97).astype(np.uint8), 52)}
    if hexadecimal:
        places = {False: (np.where(letters <= 57, letters & 15, (letters & 31) + 9), 16)}
    starts = np.cumsum(sizes) - sizes
    for length in lengths:
        if len(letters) < length:
            continue
        many = sizes // length
        first = np.cumsum(many) - many
        at = np.repeat(starts - first * length, many) + np.arange(many.sum()) * length
        at = np.concatenate([at, (starts + sizes - length)[(sizes > length) & (sizes % length > 0)]])
        for mixed, (values, used) in places.items():
            strings = np.lib.stride_tricks.sliding_window_view(values, length)
            for a in range(0, len(at), _WINDOWS):
                part = strings[at[a : a + _WINDOWS]]
                rows = np.arange(len(part)) * used
                counts = np.bincount((part + rows[:, None]).ravel(), minlength=len(part) * used).reshape(-1, used)
                squares = np.einsum("ij,ij->i", counts, counts)
                for size in [n for m, n in alike if m == mixed]:
                    chi = squares * (size / length) - length
                    even = tail((chi - (size - 1)) / np.sqrt(2 * (size - 1) * (length - 1) / length))
                    x = -np.log(np.clip(even, 1e-300, 1))
                    alive = np.flatnonzero(x < _DEAD)
                    own, x = part[alive], x[alive]
                    high = own >= size // 2
                    change = (high[:, 1:] != high[:, :-1]).sum(axis=1)
                    share = 2 * (size // 2) * (size - size // 2) / size**2
                    spread = np.sqrt((length - 1) * share * (1 - share))
                    runs = 2 * tail(np.abs((change - (length - 1) * share) / spread))
                    centred = 2 * own.astype(np.int32) - (size - 1)
                    product = np.einsum("ij,ij->i", centred[:, 1:], centred[:, :-1]) * (3 / (size * size - 1))
                    serial = 2 * tail(np.abs(product / np.sqrt(length - 1)))
                    x = x - np.log(np.clip(runs, 1e-300, 1)) - np.log(np.clip(serial, 1e-300, 1))
                    p = np.exp(-x) * (1 + x + x * x / 2)
                    row = [len(part), *[int((p >= level).sum()) for level in LEVELS]]
                    for i in alike[mixed, size]:
                        tallies[i * len(LENGTHS) + LENGTHS.index(length)] += row
    return tallies


def ascii_letters(texts: list[str | None], hexadecimal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ASCII letters, or hexadecimal signs, of all texts, and how many each has."""
    signs = [(t or "").encode("ascii", "ignore") for t in texts]
    flat = np.frombuffer(b"".join(signs), np.uint8)
    is_letter = ((flat | 32) >= 97) & ((flat | 32) <= 122)
    if hexadecimal:
        is_letter = is_letter & ((flat | 32) <= 102) | ((flat >= 48) & (flat <= 57))
    upto = np.concatenate([[0], np.cumsum(is_letter)])
    ends = np.cumsum([len(b) for b in signs], dtype=np.int64)
    return flat[is_letter], np.diff(upto[ends], prepend=0)


def length_class(length: int) -> int:
    return sum(length >= n for n in LENGTHS) - 1


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Spans of secrets of each whole text: the id and ``spans`` of (start, kind, end, level), sorted.

    ``kind`` indexes ``KINDS``; the level of known forms is null. Offsets are code points, the end
    exclusive. A random string that touches a known form is not reported again. Digits alone are
    no candidate, however many: numbers are even without being secret. A null text
    counts as empty; empty tables give no rows. The levels at which strings count come from
    all documents of the table.
    """
    span = "struct<start: int, kind: int, end: int, cell: int, p: double>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, tables = alphabet_tables()
        kinds = pa.struct(
            [(name, pa.int32()) for name in ("start", "kind", "end", "cell")] + [("p", pa.float64())]
        )
        for batch in pieces(batches, 2048):
            texts = batch.column(1).to_pylist()
            spans: list[list[dict]] = []
            candidates: dict[int, list[tuple[dict, str]]] = {}
            outside: list[str] = []
            for text in texts:
                text = text or ""
                rest, behind = [], 0
                known = known_spans(text)
                touches_known = touching((a, b) for _, a, b in known)
                own = [{"start": a, "kind": k, "end": b, "cell": None, "p": None} for k, a, b in known]
                for m in CANDIDATE.finditer(text):
                    rest.append(text[behind : m.start()])
                    behind = m.end()
                    for start, end in parts(m[0]):
                        word = m[0][start:end]
                        # Padding belongs to what stands before it.
                        a, b = m.start() + start, m.end() if not m[0][end:].strip("=") else m.start() + end
                        if touches_known(a, b):
                            continue
                        if DASHED.fullmatch(word):
                            word = word.replace("-", "")
                        signs = set(word)
                        fits = next((i for i, s in enumerate(sets) if signs <= s), None)
                        if fits is None or len(word) < LENGTHS[0] or signs <= set("0123456789"):
                            continue
                        cell = fits * len(LENGTHS) + length_class(len(word))
                        own.append({"start": a, "kind": 3, "end": b, "cell": cell, "p": None})
                        candidates.setdefault(fits, []).append((own[-1], word))
                spans.append(own)
                outside.append("".join(rest) + text[behind:])
            for i, found in candidates.items():
                for a in range(0, len(found), 4096):
                    part = found[a : a + 4096]
                    codes = np.frombuffer("".join(w for _, w in part).encode(), np.uint8)
                    lengths = np.array([len(w) for _, w in part])
                    for (entry, _), p in zip(part, battery(tables[i][codes], lengths, len(ALPHABETS[i])).tolist()):
                        entry["p"] = p
            # Plain text as the tests see it: the letters of these documents, cut to the lengths.
            tallies, short = 0, []
            for plain, hexadecimal in ((texts, False), (outside, True)):
                letters, sizes = ascii_letters(plain, hexadecimal)
                tallies = tallies + plain_tallies(letters, sizes, hexadecimal=hexadecimal)
                ends = np.cumsum(sizes)
                short.append(
                    [
                        letters[end - n : end].tobytes().decode() if 0 < n < max(LENGTHS) else None
                        for n, end in zip(sizes.tolist(), ends.tolist())
                    ]
                )
            cells, places = np.nonzero(tallies)
            measured = [
                {"cell": c, "level": j, "n": int(tallies[c, j])} for c, j in zip(cells.tolist(), places.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([False] * len(texts) + [True]),
                    pa.concat_arrays([batch.column(0), pa.nulls(1, batch.schema.field(0).type)]),
                    pa.array([*short[0], None], pa.string()),
                    pa.array([*short[1], None], pa.string()),
                    pa.array([*spans, []], pa.list_(kinds)),
                    pa.array(
                        [[]] * len(texts) + [measured],
                        pa.list_(pa.struct([("cell", pa.int32()), ("level", pa.int32()), ("n", pa.int64())])),
                    ),
                ],
                names=["tally", "id", "short", "short_hex", "spans", "plain"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    found = stored(
        in_small_batches(docs).select(id_column, text_column).mapInArrow(
            find,
            f"tally boolean, id {kind}, short string, short_hex string, spans array<{span}>, plain array<struct<cell: int, level: int, n: long>>",
        ),
        "secrets",
    )
    limits = levels(found)
    level_of = F.array(*[F.lit(float(x)) for x in limits])
    kept = F.filter(
        "spans", lambda s: (s["kind"] < 3) | (s["p"] >= F.element_at(level_of, s["cell"] + 1))
    )
    names = ("start", "kind", "end", "p")
    rows = F.transform(kept, lambda s: F.struct(*[s[n].alias(n) for n in names]))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [longest(own) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, batch.schema.field(1).type)], names=[id_column, "spans"]
            )

    return found.filter(~F.col("tally")).select("id", rows.alias("spans")).mapInArrow(
        settle, f"`{id_column}` {kind}, spans array<struct<start: int, kind: int, end: int, p: double>>"
    )


def of_short_texts(found: DataFrame, hexadecimal: bool = False) -> DataFrame:
    """cell, level and n of the plain text in texts that are shorter than a length.

    For each length they are dealt into parts by hash, as many as their letters ask for, and the
    texts of a part are joined in the order of their hashes.
    """
    length = F.explode(F.array(*[F.lit(n) for n in LENGTHS]))
    short = (
        found.withColumn("short", F.col("short_hex" if hexadecimal else "short"))
        .filter("short IS NOT NULL")
        .select("short", F.xxhash64("id", "short").alias("hash"), length.alias("length"))
        .filter(F.length("short") < F.col("length"))
    )
    letters = {r.length: r.n for r in short.groupBy("length").agg(F.sum(F.length("short")).alias("n")).collect()}
    parts = F.array(*[F.lit(-(-letters.get(n, 1) // POOL_LETTERS)) for n in LENGTHS])
    of_length = F.element_at(parts, F.array_position(F.array(*[F.lit(n) for n in LENGTHS]), F.col("length")).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("hash", "short")))
    joined = short.groupBy("length", F.pmod("hash", of_length).alias("part")).agg(
        F.array_join(F.transform(ordered, lambda x: x["short"]), "").alias("letters")
    )

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((len(ALPHABETS) * len(LENGTHS), len(LEVELS) + 1), np.int64)
            for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += plain_tallies(*ascii_letters([text], hexadecimal), (n,), hexadecimal)
            cells, places = np.nonzero(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int32()), pa.array(places, pa.int32()), pa.array(rows[cells, places], pa.int64())],
                names=["cell", "level", "n"],
            )

    return joined.select("length", "letters").mapInArrow(tally, "cell int, level int, n long")


def levels(found: DataFrame) -> list[float]:
    """For each alphabet and class of length the least level that keeps false discoveries rare.

    Expected false ones are the share of plain text at that level times all candidates. A length
    that all plain text together doesn't reach takes the share of the next shorter one, which is
    no smaller. 2, which nothing reaches, stands where no level will do, or where there is no plain
    text of any length. The tables have a row for each cell and level.
    """
    counted = found.filter("tally").select(F.explode("plain").alias("x")).select("x.*")
    plain = {
        (r.cell, r.level): r.n
        for r in counted.unionByName(of_short_texts(found))
        .unionByName(of_short_texts(found, hexadecimal=True))
        .groupBy("cell", "level")
        .agg(F.sum("n").alias("n"))
        .collect()
    }
    passed = [F.count("*").alias("n0")] + [
        F.count_if(F.col("x.p") >= level).alias(f"n{j}") for j, level in enumerate(LEVELS, 1)
    ]
    candidates = {
        r["cell"]: r
        for r in found.select(F.explode("spans").alias("x"))
        .filter("x.kind = 3")
        .groupBy("x.cell")
        .agg(*passed)
        .collect()
    }
    out = []
    for cell in range(len(ALPHABETS) * len(LENGTHS)):
        own, best = candidates.get(cell), 2.0
        measured = cell
        while (measured, 0) not in plain and measured % len(LENGTHS):
            measured -= 1
        total = plain.get((measured, 0), 0)
        if own:
            for j, level in reversed(list(enumerate(LEVELS, 1))):
                share = plain.get((measured, j), 0) / total if total else 1.0
                if own[f"n{j}"] and share * own["n0"] <= FALSE_SHARE * own[f"n{j}"]:
                    best = level
        out.append(best)
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
