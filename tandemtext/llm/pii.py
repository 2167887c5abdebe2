"""Personal data: known forms, and spans that a linear-chain conditional random field finds.

The field's features are word shapes: runs of letters and digits, with the numbers of digits,
of the word and its neighbours, and the words before it. It is trained here on a small
labelled table, some hundred lines with many that only look alike, and decoded by Viterbi in
batches of padded lines. It reports numbers that the
known forms miss, such as telephone numbers without a plus and numbers of identity papers.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemtext.llm.pieces import in_small_batches, pieces
from tandemtext.llm.spans import touching

KINDS = ("email", "ip", "card", "phone", "crf_phone", "crf_id")
LABELS = ("O", "phone", "id")
NEVER = -1e4
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No earlier start in the same run of digits: it would fail for the same reason.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
_SLOT = re.compile(r"\{([a-z]+)\}")
_PIECES = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]")
NEAR = 3  # words before a word that may be its cue

# Forms of numbers in the training table: # is drawn as a digit, @ as a capital.
FORMS = {
    "phone": (
        "###-###-####", "(###) ###-####", "###.###.####", "### ### ####", "(###) ### ####", "0## #######",
        "00## ## #### ####", "07### ######", "01 ## ## ## ##", "(0##) ######", "1-###-###-####", "0### #######",
    ),
    "id": (
        "@#######", "@@#######", "@##@##@##", "###-##-####", "@@## #### #### #### #### ##", "########@",
        "@@######@", "@@##@@@@##########", "#########",
    ),
    "code": (
        "@#######", "@@####", "@@###", "@@#######", "@##@##@##", "########", "@@-####", "######-##", "#####",
        "########@", "@@#########@@", "#@ ### ### ## #### ####", "##-####", "###-###-####", "### ### ####",
    ),
    "few": ("#", "##", "###", "####", "1#", "1##"),
    "price": ("##.##", "#,###.##", "###.##", "#,###", "##,###", "#.#"),
    "date": ("20##-0#-1#", "1#.0#.20##", "0#/1#/20##", "1#-0#-199#", "20##1#0#"),
    "time": ("1#:##", "0#:##", "1#:##:##", "0#.##"),
    "dotted": ("#.#.#", "#.##", "1#.#", "192.168.#.##", "1#.0.#.##"),
    "hash": ("#@##@##@@##@@###", "########@@##@###########@@#####@"),
    "long": ("################", "##############", "###########"),
}
# Lines of the training table. {phone} and {id} are personal, all other forms are not; hard cases are
# numbers of the same forms that belong to flights, parts, orders and parcels.
TEMPLATES = """
call me at {phone} tomorrow
please call {phone} today
my phone is {phone} , thanks
tel {phone} or by mail
Tel. {phone}
Phone: {phone}
phone number {phone} is on the door
fax {phone} please
mobile {phone}
my mobile is {phone} and I answer at night
reach him on {phone} after {few} pm
telephone {phone}
cell {phone} or home {phone}
her number is {phone} .
{phone} is the office line
{phone}
text {phone} for details
you can ring {phone} until {time}
contact us: {phone}
hotline {phone} from {few} to {few}
dial {phone} and ask for room {few}
whatsapp {phone}
the phone {phone} was busy on {date}
call {phone} about order {code}
SSN {id} on file
SSN: {id}
social security number {id}
social security {id}
passport {id} issued in 20{few}
passport no {id}
passport number: {id}
my passport {id} expired on {date}
id {id}
ID card {id}
identity number {id}
identity card no. {id} , valid
IBAN {id}
iban {id} please transfer {price}
driving licence {id}
licence {id}
tax id {id}
national id {id} and phone {phone}
insurance number {id}
born {date} , passport {id}
flight {code} to Rome
flight {code} departs at {time}
our flight {code} was late
part no. {code}
part number {code} is out of stock
spare part {code} fits model {code}
order {code} was shipped on {date}
order no {code}
order number {code} for {price}
your order {code} has {few} items
tracking {code}
tracking number {code}
parcel {code} arrives {date}
shipment {code} weighs {few} kg
invoice {code} of {date}
invoice no. {code} over {price}
invoice number: {code}
model {code} costs {price}
model number {code}
serial {code}
serial number {code} on the back
batch {code} was tested
item {code} and item {code}
article {code} , section {dotted}
article number {code}
isbn {code}
catalogue no {code}
ticket {code} was closed
ticket number {code} , seat {few}
gate {few} , train {code}
train {code} at {time}
bus {few} or bus {few}
bug {code} is open since {date}
case {code} of {date}
commit {hash}
key {hash}
token = "{hash}"
build {code} of version {dotted}
release {dotted} and {dotted}
version {dotted} of 20{few}
product code {code}
room {code} on floor {few}
plate {code} in car park {few}
sample {code} contains {price} g
{code} is the code of the product
the code {code} works until {date}
reference {code}
reference number {code}
account code {code}
sku {code}
on {date} we met at {time}
from {date} to {date}
in 1999 and 20{few} there were {few} of {few}
page {few} of {few}
{price} people in {few} towns
it costs {price} or {price}
chapter {few} , section {dotted}
from {few} to {few} at night
{few}-{few} people came {few}-{few} times
{long} items were counted
{dotted} is down
{few} {few} {few} {few}
row {code} has {few} of {few} columns
mail 5{few}@mail{few}.example.com now
a{few} b{few} c{few}
{price} rows and {long} cells
ratio {few}:{few} or {few}:{few}
the 1st , 2nd and 3rd
score {few}-{few} , {few}-{few}
+1 ({few}) 555-7713 here
ISO {code} and RFC {few}
temperature -{few} to {few}
the number {few} is even
number of rows {long}
no {few} in the list
call it {dotted}
phone model {code}
section {dotted} line {few}
latitude {price} longitude {price}
{time} {time} {time}
population {long} in 20{few}
""".strip().splitlines()
COPIES = 4  # lines drawn from each template


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the known forms, in code points, kind by kind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and at >= last and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def shape(word: str) -> str:
    """Runs of letters as X or x, digits with their number, other signs as they are."""
    if len(word) > 40:
        return "long"
    parts = []
    for piece in _PIECES.findall(word):
        first = piece[0]
        if first in "0123456789":
            parts.append(f"d{min(len(piece), 9)}")
        elif first.isascii() and first.isalpha():
            parts.append("X" if first.isupper() else "x")
        else:
            parts.append(first if first.isascii() else "x")
    return "".join(parts) if len(parts) <= 12 else "mixed"


def features(words: list[str]) -> list[list[str]]:
    """Names of the features of each word of a line."""
    shapes = [shape(w) for w in words]
    cues = [c if (c := w.strip(".,:;()\"").lower()).isalpha() and len(c) <= 14 else "" for w in words]
    out = []
    for i, own in enumerate(shapes):
        before = shapes[i - 1] if i else "^"
        after = shapes[i + 1] if i + 1 < len(words) else "$"
        named = ["bias", f"s {own}", f"b {before}", f"a {after}"]
        digits = sum(c in "0123456789" for c in words[i])
        named.append(f"digits {min(digits, 12)}" if digits else "none")
        if digits:  # the words before it, the nearest one once more
            named += [f"cue {cues[j]}" for j in range(max(0, i - NEAR), i) if cues[j]]
            named.append(f"last {cues[i - 1]}" if i and cues[i - 1] else "no cue")
        out.append(named)
    return out


@dataclass
class Field:
    """Feature weights for each label, and weights of label after label."""

    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        rows = np.zeros((len(words), len(LABELS)))
        for i, named in enumerate(features(words)):
            for n in named:
                if n in self.names:
                    rows[i] += self.weights[self.names[n]]
        return rows


def labelled_lines(templates: list[str] | None = None, copies: int = COPIES) -> list[tuple[list[str], list[int]]]:
    """Words and labels of the lines of the templates, their numbers drawn by a fixed rule."""
    out = []
    for template in TEMPLATES if templates is None else templates:
        for copy in range(copies):
            draw = random.Random(f"{template}|{copy}")
            words: list[str] = []
            labels: list[int] = []
            for word in template.split():
                kinds = _SLOT.findall(word)
                filled = _SLOT.sub(lambda m: _drawn(draw, draw.choice(FORMS[m[1]])), word).split()
                words += filled
                labels += [LABELS.index(kinds[0]) if kinds and kinds[0] in LABELS else 0] * len(filled)
            out.append((words, labels))
    return out


def _drawn(draw: random.Random, form: str) -> str:
    return "".join(
        draw.choice("0123456789") if c == "#" else draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c == "@" else c
        for c in form
    )


def log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def train(
    lines: list[tuple[list[str], list[int]]] | None = None, rounds: int = 150, rate: float = 0.3, ridge: float = 0.02
) -> Field:
    """Weights that make the labelled lines likely, by gradient steps with adaptive rates.

    A word without a digit never has a label: that is part of the model. All lines are one
    padded batch.
    """
    lines = labelled_lines() if lines is None else lines
    named = [n for words, _ in lines for n in features(words)]
    names = {n: i for i, n in enumerate(sorted({n for word in named for n in word}))}
    of_word = np.array([len(word) for word in named])
    ids = np.array([names[n] for word in named for n in word])
    word_starts = np.cumsum(of_word) - of_word
    lengths = np.array([len(words) for words, _ in lines])
    row = np.repeat(np.arange(len(lines)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    truth = np.array([y for _, labels in lines for y in labels])
    size, longest = len(LABELS), int(lengths.max())
    hits = np.zeros((len(lines), longest, size))
    hits[row, column, truth] = 1
    moved = np.einsum("lti,ltj->ij", hits[:, :-1], hits[:, 1:])
    weights, moves = np.zeros((len(names), size)), np.zeros((size, size))
    weights[names["none"], 1:] = NEVER
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(rounds):
        score = np.zeros((len(lines), longest, size))
        score[row, column] = np.add.reduceat(weights[ids], word_starts, axis=0)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = score[:, t] + log_sum(ahead[:, t - 1, :, None] + moves, 1)
            ahead[:, t] = np.where((t < lengths)[:, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = log_sum(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t + 1 < lengths)[:, None], step, 0)
        whole = log_sum(ahead[:, -1], 1)
        share = np.exp(ahead + behind - whole[:, None, None])
        slope_w = -ridge * weights
        np.add.at(slope_w, ids, np.repeat((hits - share)[row, column], of_word, axis=0))
        slope_m = moved - ridge * moves
        for t in range(1, longest):
            both = ahead[:, t - 1, :, None] + moves + (score[:, t] + behind[:, t])[:, None, :]
            slope_m -= np.exp(both - whole[:, None, None])[t < lengths].sum(axis=0)
        seen_w += slope_w**2
        seen_m += slope_m**2
        slope_w[names["none"]] = 0
        weights += rate * slope_w / np.sqrt(seen_w)
        moves += rate * slope_m / np.sqrt(seen_m)
    return Field(names, weights, moves)


def decode(scores: list[np.ndarray], moves: np.ndarray, cells: int = 1 << 16) -> list[np.ndarray]:
    """The best labels of each line: lines of about one length are padded to a batch."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
    order = sorted((i for i in range(len(scores)) if len(scores[i])), key=lambda i: len(scores[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * len(scores[order[b]]) <= cells:
            b += 1
        own = order[a:b]
        lengths = np.array([len(scores[i]) for i in own])
        longest = int(lengths[-1])
        padded = np.zeros((len(own), longest, moves.shape[0]))
        for k, i in enumerate(own):
            padded[k, : len(scores[i])] = scores[i]
        best = padded[:, 0]
        back = np.zeros((len(own), longest, moves.shape[0]), np.int8)
        for t in range(1, longest):
            paths = best[:, :, None] + moves[None]
            back[:, t] = paths.argmax(axis=1)
            # A line that has ended keeps its score.
            best = np.where((t < lengths)[:, None], paths.max(axis=1) + padded[:, t], best)
        label = best.argmax(axis=1)
        labels = np.zeros((len(own), longest), np.int64)
        for t in range(longest - 1, -1, -1):
            inside = t < lengths
            labels[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[np.arange(len(own)), t, label], label)
        for k, i in enumerate(own):
            out[i] = labels[k, : len(scores[i])]
        a = b
    return out


def field_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the labelled words of each text; words in a row with one label are one span."""
    places: list[tuple[int, list[tuple[int, int]]]] = []
    scores = []
    for k, text in enumerate(texts):
        if not _DIGIT.search(text):
            continue
        start = 0
        for line in text.split("\n"):
            if _DIGIT.search(line):  # others have no labels, see train()
                spans = [(start + m.start(), start + m.end()) for m in _WORD.finditer(line)]
                places.append((k, spans))
                scores.append(field.scores([text[a:b] for a, b in spans]))
            start += len(line) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (k, spans), labels in zip(places, decode(scores, field.moves)):
        before = 0
        for (a, b), label in zip(spans, labels.tolist()):
            if label and label == before:
                kind, first, _ = out[k][-1]
                out[k][-1] = (kind, first, b)
            elif label:
                out[k].append((3 + label, a, b))
            before = label
    return out


def find_personal(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", field: Field | None = None
) -> DataFrame:
    """Spans of personal data of each whole text: the id and ``spans`` of (kind, start, end), sorted.

    ``kind`` indexes ``KINDS``. Offsets are code points, the end exclusive. What the field finds
    is left out where it touches a known form. A null text counts as empty.
    """
    field = field or train()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            spans = []
            for text, more in zip(texts, field_spans(texts, field)):
                known = known_spans(text)
                touches_known = touching((a, b) for _, a, b in known)
                more = [s for s in more if not touches_known(s[1], s[2])]
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in sorted(known + more)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, kinds)], names=[id_column, "spans"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return in_small_batches(docs).select(id_column, text_column).mapInArrow(
        find, f"`{id_column}` {kind}, spans array<struct<kind: int, start: int, end: int>>"
    )


def joined(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined in their order."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
