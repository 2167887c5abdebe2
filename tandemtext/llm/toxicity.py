"""Toxicity scores from a subsequence string-kernel support vector machine.

The kernel of two stretches of letters weighs the letter triples they share in order, gaps
allowed: a triple that spans more letters than three counts less, and blanks inside are gaps.
So an insult with inserted signs, letters or blanks stays near the plain one. The stretches are windows that slide over
the letters of a sentence, across its blanks: every word, every run of neighbouring words of
up to ``WIDTH`` letters, and the overlapping parts of longer words up to their last letter.
Landmarks are windows of the labelled texts (Nyström); the machine is trained on the sentences
of labelled documents, where a toxic document only says that some window in it is toxic: its
most toxic windows so far stand for it, in rounds, while every window of every clean document
of the sample is a candidate for the other side. As the kernel is an inner product, the sum
over the landmarks is taken once; running sums over the letters then give every window's score
in a constant number of steps. A text's score is that of its worst window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemtext.llm.language import held_out, training_sample
from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.substring_dedup import mix

FEATURES = 1 << 16  # triples are hashed to so many
SPAN = 6
DECAY = 0.75
WIDTH = 24  # places of a window: a mark for each word and its letters
WORDS = 4  # of a window
LANDMARKS = 192
TRAINING_ROWS = 4_000  # bound of the sample of labelled documents
ROUNDS = 4
WITNESSES = 4  # windows of a toxic text that may stand for it
COMMON = 2_000  # windows most frequent in clean texts, trained in every round
BACKGROUND = 2  # more windows of each clean text that are, beside its worst one
RIDGE = 0.5
MARK = 1  # code of the blank before a word
_CHUNK = 1 << 19  # letters
_STRETCH = 1 << 17
_WIDE_WINDOWS = 1 << 11
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_WORD, _SIGN, _BLANK, _STOP, _BREAK = range(5)


def classes_of(points: np.ndarray) -> np.ndarray:
    """What each code point is: part of a word, sign, blank, sign that may end a sentence, or line end."""
    word = ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57)) | (points >= 0xC0)
    kind = np.where(word, _WORD, _SIGN).astype(np.uint8)
    kind[(points >= 0x2010) & (points <= 0x206F)] = _SIGN
    blank = (points <= 32) | (points == 0xA0) | (points == 0x3000)
    kind[blank | ((points >= 0x2000) & (points <= 0x200A))] = _BLANK
    kind[(points == 33) | (points == 46) | (points == 63)] = _STOP
    kind[points == 10] = _BREAK
    return kind


@dataclass
class Letters:
    """Texts as one row of codes: a mark before each word, its letters, and 0 for digits."""

    codes: np.ndarray
    starts: np.ndarray  # the mark of each word
    ends: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    n_texts: int

    def piece(self, start: int, end: int) -> str:
        return "".join(" " if c == MARK else chr(c) if c else "0" for c in self.codes[start:end].tolist())


def letters_of(texts: list[str | None]) -> Letters:
    """Words, sentences and texts of the lower-cased letters.

    A sentence ends at a full stop, exclamation or question mark before a blank, and at a line
    end. Other signs end a word, but not between two runs of up to four letters, nor does a
    blank between two runs of up to two.
    """
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes_of(points)
    inside = kind == _WORD
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, behind = edges[::2], edges[1::2]
    if not len(first):
        none = np.empty(0, np.int64)
        return Letters(np.empty(0, np.uint32), none, none, none, none, len(texts))
    length = behind - first
    # The signs between a run and the next one.
    stop, blank, line = ((np.cumsum(kind == k)) for k in (_STOP, _BLANK, _BREAK))

    def between(total: np.ndarray) -> np.ndarray:
        return total[first[1:] - 1] > total[behind[:-1] - 1]

    has_blank, has_line = between(blank), between(line)
    ended = has_line | (between(stop) & has_blank)
    longer = np.maximum(length[1:], length[:-1])
    glued = ~ended & np.where(has_blank, longer <= 2, longer <= 4)
    new_word = np.concatenate([[True], ~glued])
    word = np.cumsum(new_word) - 1
    own = np.flatnonzero(inside)
    run = np.repeat(np.arange(len(first)), length)
    place = np.arange(len(own)) + word[run] + 1
    values = points[own]
    codes = np.full(len(own) + int(word[-1]) + 1, MARK, np.uint32)
    codes[place] = np.where((values >= 48) & (values <= 57), 0, values)
    starts = place[np.cumsum(length) - length][new_word] - 1
    offsets = np.cumsum([len(t) + 1 for t in lowered])
    return Letters(
        codes,
        starts,
        np.append(starts[1:], len(codes)),
        np.concatenate([[0], np.cumsum(ended)])[new_word],
        np.searchsorted(offsets, first[new_word], "right"),
        len(texts),
    )


def windows_of(letters: Letters, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of all windows of up to ``words`` words, by start within each text.

    A word longer than a window gives windows that overlap by half; the last one ends with it.
    """
    starts, ends, sentence = letters.starts, letters.ends, letters.sentence
    parts = np.maximum(1, -(-(ends - starts - WIDTH) // (WIDTH // 2)) + 1)
    row = np.repeat(np.arange(len(starts)), parts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.minimum(starts[row] + step * (WIDTH // 2), np.maximum(starts[row], ends[row] - WIDTH))
    found = [(begin, np.minimum(begin + WIDTH, ends[row]), letters.text[row])]
    for n in range(1, min(words, len(starts))):
        fits = (sentence[:-n] == sentence[n:]) & (ends[n:] - starts[:-n] <= WIDTH)
        at = np.flatnonzero(fits)
        found.append((starts[at], ends[at + n], letters.text[at]))
    begin, end, text = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(begin, kind="stable")
    return begin[order], end[order], text[order]


def hashed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The feature of a triple, from its codes times the three factors."""
    value = a + b
    value += c
    value ^= value >> np.uint32(15)
    value *= np.uint32(0x2C1B3C6D)
    value >>= np.uint32(32 - FEATURES.bit_length() + 1)
    return value


def window_sums(codes: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The normalised inner product of each window's triples with the weights.

    The norm counts every occurrence of a triple once. Windows come by their start.
    """
    out = np.zeros(len(starts), np.float32)
    cuts = np.flatnonzero(np.diff(starts // _STRETCH, prepend=-1)) if len(starts) else []
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        base = int(starts[a])
        own = codes[base : int(ends[a:b].max())]
        s, e = starts[a:b] - base, ends[a:b] - base
        x, y, z = (own * f for f in _FACTORS)
        letter, mark = own > MARK, own == MARK
        total, norm = np.zeros(b - a), np.zeros(b - a)
        for k in range(2, SPAN):
            if k >= len(own):
                break
            outer = (own[:-k] > 0) & letter[k:]
            sums, many = np.zeros(len(own) - k, np.float32), np.zeros(len(own) - k, np.int8)
            for j in range(1, k):
                whole = outer & letter[j : j - k]
                sums += weights[hashed(x[:-k], y[j : j - k], z[k:])] * whole
                many += whole
            # A mark counts where the window begins with it; those inside are gaps.
            at = np.flatnonzero((e - s > k) & mark[s])
            total[at] += sums[s[at]] * DECAY ** (k - 2)
            norm[at] += many[s[at]] * DECAY ** (2 * (k - 2))
            sums[mark[:-k]] = 0
            many[mark[:-k]] = 0
            running = np.concatenate([[0], np.cumsum(sums, dtype=np.float64)])
            counted = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
            begin = np.minimum(s, len(sums))
            last = np.maximum(e - k, begin)
            total += (running[last] - running[begin]) * DECAY ** (k - 2)
            norm += (counted[last] - counted[begin]) * DECAY ** (2 * (k - 2))
        out[a:b] = total / np.sqrt(np.maximum(norm, 1))
    return out


def window_keys(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the codes of each window, wherever it stands."""
    factor = 0x5851F42D4C957F2D
    powers = np.cumprod(np.full(len(codes) + 1, factor, np.uint64))
    back = np.cumprod(np.full(len(codes) + 1, pow(factor, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(2)) * powers[:-1])])
    return mix((sums[ends] - sums[starts]) * back[starts])


def piece_codes(windows: list[str]) -> np.ndarray:
    """A row of codes for each window: a mark if it begins with a blank; digits and other blanks are gaps."""
    codes = np.zeros((len(windows), max((len(w) for w in windows), default=1)), np.uint32)
    lengths = np.array([len(w) for w in windows], np.int64)
    flat = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(windows)), lengths)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes[rows, columns] = np.where(flat == 32, np.where(columns == 0, MARK, 0), np.where(flat == 48, 0, flat))
    return codes


def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Rows, hashed triples and weight of each pair of gaps."""
    for k in range(2, min(SPAN, codes.shape[1])):
        for j in range(1, k):
            a, b, c = codes[:, :-k], codes[:, j : j - k], codes[:, k:]
            at = np.nonzero((a > 0) & (b > 0) & (c > 0))
            yield at[0], hashed(a[at] * _FACTORS[0], b[at] * _FACTORS[1], c[at] * _FACTORS[2]), DECAY ** (k - 2)


def inner(windows: list[str], weights: np.ndarray) -> np.ndarray:
    """The normalised inner product of each window's triples with the columns of ``weights``."""
    if len(windows) > _WIDE_WINDOWS:
        parts = range(0, len(windows), _WIDE_WINDOWS)
        return np.concatenate([inner(windows[a : a + _WIDE_WINDOWS], weights) for a in parts])
    total = np.zeros((len(windows), weights.shape[1]))
    norm = np.zeros(len(windows))
    for rows, features, weight in triples(piece_codes(windows)):
        if len(rows):
            starts = np.flatnonzero(np.diff(rows, prepend=-1))
            total[rows[starts]] += np.add.reduceat(weights[features] * weight, starts, axis=0)
        norm += np.bincount(rows, minlength=len(windows)) * weight**2
    return total / np.sqrt(np.maximum(norm, 1))[:, None]


def landmark_features(windows: list[str]) -> np.ndarray:
    """The normalised triples of each window, one column for each."""
    mapped, norms = np.zeros((FEATURES, len(windows)), np.float32), np.zeros(len(windows))
    for rows, features, weight in triples(piece_codes(windows)):
        np.add.at(mapped, (features, rows), weight)
        norms += np.bincount(rows, minlength=len(windows)) * weight**2
    return mapped / np.sqrt(np.maximum(norms, 1)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -30, 30)))


def with_inserted(window: str, signs: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """The window with one sign more behind a letter, at a place and of a kind that its hash names."""
    at = zlib.crc32(window.encode("utf-8", "surrogatepass"))
    place = 2 + at % max(1, len(window) - 2)
    return window[:place] + signs[at // 64 % len(signs)] + window[place:]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        own = x[active] * weight[active, None]
        new = np.linalg.solve(own.T @ x[active] + ridge * np.eye(len(w)), own.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def calibrate(decisions: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through decisions, with a small ridge on the slope."""
    x, t = np.stack([decisions, np.ones_like(decisions)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        gradient = x.T @ (weight * (p - labels)) + np.array([1e-2, 0]) * t
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        t = t - np.linalg.solve(curve, gradient)
    return float(max(t[0], 0)), float(t[1])


def worst_windows(score: np.ndarray, text: np.ndarray, key: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``many`` different windows of each text with the highest scores, and their ranks."""
    order = np.lexsort((key, -score, text))
    text, key = text[order], key[order]
    new = np.diff(text, prepend=-1) != 0
    new[1:] |= key[1:] != key[:-1]
    order, text = order[new], text[new]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    rank = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text))))
    return order[rank < many], rank[rank < many]


@dataclass
class Sample:
    """Windows of some labelled texts; ``short`` ones have one or two words and are counted."""

    letters: Letters
    rows: np.ndarray  # places of the texts in the sample
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    short: np.ndarray
    keys: np.ndarray  # of the short ones

    @classmethod
    def of(cls, texts: list[str], rows: list[int]) -> Sample:
        letters = letters_of(texts)
        starts, ends, text = (x.astype(np.int32) for x in windows_of(letters))
        marks = np.concatenate([[0], np.cumsum(letters.codes == MARK)])
        short = np.flatnonzero(marks[ends] - marks[starts] <= 2).astype(np.int32)
        keys = window_keys(letters.codes, starts[short], ends[short])
        return cls(letters, np.array(rows), starts, ends, text, short, keys)

    def piece(self, at: int) -> str:
        return self.letters.piece(int(self.starts[at]), int(self.ends[at]))


def samples_of(texts: list[str]) -> list[Sample]:
    out, own, size = [], [], 0
    for i, text in enumerate(texts):
        own.append(i)
        size += len(text)
        if size >= _CHUNK or i + 1 == len(texts):
            out.append(Sample.of([texts[j] for j in own], own))
            own, size = [], 0
    return out


def fit_rows(sample: list[tuple], totals: dict[int, int], landmarks: int = LANDMARKS) -> Model:
    """A model of (key, label 0 or 1, text) rows; ``totals`` has the numbers of rows they stand for."""
    labels = np.array([label for _, label, _ in sample], np.int64)
    n = {v: int((labels == v).sum()) for v in (0, 1)}
    if not (n[0] and n[1]):
        share = min(max(totals.get(1, 0) / max(1, sum(totals.values())), 1e-3), 1 - 1e-3)
        return Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    chunks = samples_of([t for _, _, t in sample])

    # Of how many toxic and clean texts each short window is a part.
    seen: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for c in chunks:
        text = c.text[c.short]
        order = np.lexsort((c.keys, text))
        new = (np.diff(text[order], prepend=-1) != 0) | (np.diff(c.keys[order], prepend=np.uint64(0)) != 0)
        own = order[new]
        toxic = labels[c.rows[text[own]]] == 1
        seen[1].append(c.keys[own[toxic]])
        seen[0].append(c.keys[own[~toxic]])
    clean_keys, clean_n = np.unique(np.concatenate(seen.pop(0)), return_counts=True)
    toxic_keys, toxic_n = np.unique(np.concatenate(seen.pop(1)), return_counts=True)

    def counted(keys: np.ndarray, of: np.ndarray, many: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(of, keys), max(0, len(of) - 1))
        return np.where(of[at] == keys, many[at], 0) if len(of) else np.zeros(len(keys), np.int64)

    def lift(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
        return np.log((toxic + 0.5) / (n[1] + 1) / ((clean + 0.5) / (n[0] + 1)))

    # Half of the landmarks tell toxic texts apart, half are the most common others.
    worth = toxic_n * lift(toxic_n, counted(toxic_keys, clean_keys, clean_n))
    telling = toxic_keys[np.lexsort((toxic_keys, -worth))[: landmarks // 2]]
    common = clean_keys[np.lexsort((clean_keys, -clean_n))[:COMMON]]
    common = common[~np.isin(common, telling)]
    wanted = np.concatenate([telling, common])
    named: dict[int, str] = {}
    for c in chunks:
        for at in np.flatnonzero(np.isin(c.keys, wanted)).tolist():
            if int(c.keys[at]) not in named:
                named[int(c.keys[at])] = c.piece(int(c.short[at]))
    marks = [named[int(k)] for k in wanted[:landmarks]]
    mapped = landmark_features(marks)
    values, vectors = np.linalg.eigh(inner(marks, mapped) + 1e-6 * np.eye(len(marks)))
    strong = values > 1e-3 * values.max()
    root = vectors[:, strong] / np.sqrt(values[strong])

    part = np.array([hash_share(k) for k, _, _ in sample])
    own_rows = part < 0.75
    if not own_rows.any():
        own_rows[:] = True
    background: dict[str, int] = {}
    for c in chunks:
        text, of = c.text[c.short], labels[c.rows]
        clean = np.flatnonzero((of == 0)[text] & own_rows[c.rows][text])
        # By their hash: the same windows, whatever the order of the texts.
        at, _ = worst_windows(-(c.keys[clean] >> np.uint64(11)).astype(np.float64), text[clean], c.keys[clean], BACKGROUND)
        for i in clean[at].tolist():
            background.setdefault(c.piece(int(c.short[i])), int(counted(c.keys[i : i + 1], clean_keys, clean_n)[0]))
    for k, many in zip(common.tolist(), counted(common, clean_keys, clean_n).tolist()):
        background[named[k]] = many

    weights, bias = None, 0.0
    for _ in range(ROUNDS):
        positive: list[str] = []
        for c in chunks:
            text, of = c.text[c.short], labels[c.rows]
            chosen = np.flatnonzero((of == 1)[text] & own_rows[c.rows][text])
            keys = c.keys[chosen]
            many, few = counted(keys, toxic_keys, toxic_n), counted(keys, clean_keys, clean_n)
            if weights is None:  # The first round takes the windows that tell most by their counts.
                score = np.minimum(many, 20) / 20 + lift(many, few)
            else:
                score = window_sums(c.letters.codes, weights, c.starts[c.short[chosen]], c.ends[c.short[chosen]])
                worst = window_sums(c.letters.codes, weights, c.starts, c.ends)
                for at in worst_of_texts(worst, c.text)[1].tolist():
                    row = c.rows[c.text[at]]
                    if labels[row] == 0 and own_rows[row]:
                        background.setdefault(c.piece(at), 1)
            at, rank = worst_windows(score, text[chosen], keys, WITNESSES)
            # A window that clean texts have as often says nothing: such a label has no witness.
            # Further windows of a text stand for it if they are toxic elsewhere too.
            share = few[at] / n[0] / (many[at] / n[1])
            kept = (share < 0.2) & ((rank == 0) | (share < 0.02) & (many[at] > 4))
            positive += [c.piece(int(c.short[chosen[i]])) for i in at[kept]]
        plain = set(positive)
        positive += [with_inserted(w) for w in positive] + [with_inserted(w, " ") for w in positive]
        negative = [w for w in sorted(background) if w not in plain]
        x = inner(positive + negative, mapped) @ root
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        weight = np.concatenate([np.ones(len(positive)), np.log1p([background[w] for w in negative])])
        weight[: len(positive)] *= weight[len(positive) :].sum() / max(1, len(positive))
        w = squared_hinge(x, y, weight, RIDGE)
        weights, bias = (mapped @ (root @ w[:-1]).astype(np.float32)).astype(np.float32), float(w[-1])
    rest = part >= 0.75
    if len(set(labels[rest].tolist())) < 2:
        rest[:] = True
    worst = np.full(len(sample), bias)
    for c in chunks:
        score = window_sums(c.letters.codes, weights, c.starts, c.ends)
        texts, at = worst_of_texts(score, c.text)
        worst[c.rows[texts]] = score[at] + bias
    truth = labels[rest]
    prior = np.array([totals[int(v)] / n[int(v)] for v in truth])
    # The margins of the machine count as some observations, or the curve of two groups that
    # lie far apart could turn anywhere between them.
    weight = np.append(prior / prior.mean(), [0.05 * len(truth)] * 2)
    slope, offset = calibrate(np.append(worst[rest], [1.0, -1.0]), np.append(truth, [1, 0]), weight)
    return Model(weights, bias, slope, offset)


def worst_of_texts(score: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have windows, and the place of the first window with the highest score of each."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    if not len(first):
        return first, first
    top = np.repeat(np.maximum.reduceat(score, first), np.diff(np.append(first, len(text))))
    at = np.flatnonzero(score == top)
    at = at[np.diff(text[at], prepend=-1) != 0]
    return text[at], at


def hash_share(key: object) -> float:
    return zlib.crc32(f"part|{key}".encode()) / (1 << 32)


def score_texts(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """id, ``score`` (0 to 1, higher: toxic) and ``worst`` (the window that gave it) of each whole text.

    Texts without words, or null, get the score of no window at all, and a null ``worst``.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_chunk(texts: list[str | None]) -> tuple[list[float], list[str | None]]:
            letters = letters_of(texts)
            starts, ends, text = windows_of(letters)
            found = window_sums(letters.codes, model.weights, starts, ends)
            own, at = worst_of_texts(found, text)
            values, worst = np.full(len(texts), model.bias), [None] * len(texts)
            values[own] += found[at]
            for row, i in zip(own.tolist(), at.tolist()):
                worst[row] = letters.piece(int(starts[i]), int(ends[i])).strip()
            return model.probability(values).tolist(), worst

        for batch in pieces(batches, 2048):
            texts = batch.column(1).to_pylist()
            scores, worst = [], []
            a = size = 0
            for b, text in enumerate(texts, 1):
                size += len(text or "")
                if size >= _CHUNK or b == len(texts):
                    found = of_chunk(texts[a:b])
                    scores += found[0]
                    worst += found[1]
                    a, size = b, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(worst, pa.string())],
                names=[id_column, "score", "worst"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return in_small_batches(docs).select(id_column, text_column).mapInArrow(
        score, f"`{id_column}` {kind}, score double, worst string"
    )


def fit_documents(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, landmarks: int = LANDMARKS
) -> Model:
    """A model of labelled documents that are not held out (crc32 of the id, modulo 4, not 2).

    It is fitted on a sample of about ``rows`` labels. Labels other than 0 and 1, and labels of
    no document or of one without text, are left out. Without both labels every text gets the
    share of label 1.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out("doc_id", 4, 2)).select(
        F.col("doc_id").alias("key"), F.col("toxic").cast("int").alias("label")
    )
    # The sample is drawn from the labels alone; its size is bounded, so no text is shuffled.
    drawn = training_sample(usable, rows)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("key"))
    totals = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sample = sorted((r.key, r.label, r.text) for r in joined.select("key", "label", "text").collect())
    return fit_rows(sample, totals, landmarks)
