"""String columns: names, prompts, stripping, word tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space at the ends of a text, and as a word.
BLANKS = r"[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"

# The stages of the published Treebank word rules, pattern and replacement. The
# first ends a line behind a sentence, so that its period stands at the end of one.
GAP = r"[ \t\n\r\f]"
TREEBANK = (
    (rf"([.?!][\"')\]]*){GAP}+([\"'(\[]*[A-Z0-9])", "\\1\n\\2"),
    # Quotes that open.
    ("(?m)^\"", "`` "),
    ("(``)", " \\1 "),
    (r"([ (\[{<])\"", "\\1 `` "),
    # Signs, commas but not between digits, the last period of a sentence.
    (r"([:,])([^0-9])", " \\1 \\2"),
    (r"(?m)([:,])$", " \\1 "),
    (r"(\.\.\.+)", " \\1 "),
    (r"([;@#$%&?!])", " \\1 "),
    (r"(?m)([^.])(\.)([\])}>\"']*)[ \t\r\f]*$", "\\1 \\2\\3 "),
    (r"([^'])' ", "\\1 ' "),
    (r"([\]\[(){}<>])", " \\1 "),
    ("(--+)", " \\1 "),
    # Quotes that close, genitives and shortened verbs.
    ("\"", " '' "),
    (rf"([^' ])('[sSmMdD]|')({GAP}|$)", "\\1 \\2\\3"),
    (rf"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)({GAP}|$)", "\\1 \\2\\3"),
    # Words that are two.
    (r"(?i)\b(can)(not)\b", "\\1 \\2"),
    (r"(?i)\b(d)('ye)\b", "\\1 \\2"),
    (r"(?i)\b(gim|lem)(me)\b", "\\1 \\2"),
    (r"(?i)\b(gon|wan)(na)\b", "\\1 \\2"),
    (r"(?i)\b(got)(ta)\b", "\\1 \\2"),
    (r"(?i)\b(more)('n)\b", "\\1 \\2"),
    (r"(?i)('t)(is|was)\b", "\\1 \\2"),
)
# By the number of a stage, what a text has to hold for it to change anything, in small letters.
TREEBANK_SIGNS = {
    1: ('"',), 2: ("``",), 3: ('"',), 6: ("...",), 9: ("' ",), 11: ("--",), 12: ('"',), 13: ("'",), 14: ("'",),
    15: ("cannot",), 16: ("d'ye",), 17: ("gimme", "lemme"), 18: ("gonna", "wanna"), 19: ("gotta",),
    20: ("more'n",), 21: ("'tis", "'twas"),
}
# The first of the stages that go by letters; they only put blanks into words, so one copy in small letters serves all.
TREEBANK_LETTERS = 15


def named(name: str) -> Column:
    """A column by its literal name, which may hold dots, dashes or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def last_segment(path: Column | str) -> Column:
    """Model name: what follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def output_name(paths: Sequence[str]) -> str:
    """Name of a data set built from several: their last segments, joined."""
    return "_".join(path.rsplit("/", 1)[-1] for path in paths)


def prompt(task: str, text: Column | str) -> Column:
    """``task: text``; a missing text is spelled ``None``."""
    value = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(f"{task}: "), F.coalesce(value.cast("string"), F.lit("None")))


def newlines_to_blanks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def strip_end(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){BLANKS}+\z", "")


def strip(text: Column) -> Column:
    """Removes white space of every kind at both ends; ``trim`` removes blanks only."""
    return F.regexp_replace(text, rf"(?U)\A{BLANKS}+|{BLANKS}+\z", "")


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, len(prefix) + 1, 2**31 - 1)) \
        .otherwise(text)


def treebank_words(text: Column) -> Column:
    """Words as the Treebank has them: contractions, quotes and the last period stand alone.

    Every stage rewrites the whole text, so all of it stays in the JVM; a stage is left out for the
    texts that lack its signs. A sentence is taken to end at its sign before white space and a
    capital or digit.
    """

    def given(value: Column, use: Callable[[Column], Column]) -> Column:
        # A name for the value: written out in two places, it would double with every stage.
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def rewritten(number: int, value: Column, letters: Column | None = None) -> Column:
        pattern, replacement = TREEBANK[number]

        def stage(told: Column) -> Column:
            # Lines end at a line feed only.
            return F.regexp_replace(told, F.lit(f"(?d){pattern}"), F.lit(replacement.replace("\\", "$")))

        def where_held(told: Column) -> Column:
            within = told if letters is None else letters
            held = [F.contains(within, F.lit(sign)) for sign in TREEBANK_SIGNS[number]]
            return F.when(reduce(lambda a, b: a | b, held), stage(told)).otherwise(told)

        return given(value, where_held) if number in TREEBANK_SIGNS else stage(value)

    def split_words(told: Column) -> Column:
        def with_letters(letters: Column) -> Column:
            return reduce(lambda a, n: rewritten(n, a, letters), range(TREEBANK_LETTERS, len(TREEBANK)), told)

        return given(F.lower(told), with_letters)

    text = given(reduce(lambda a, n: rewritten(n, a), range(TREEBANK_LETTERS), text), split_words)
    return F.array_remove(F.split(text, f"{GAP}+"), "")


def words(text: Column) -> Column:
    """Runs of letters and digits, and single other signs."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def cut_words(text: Column, limit: int = 256, exact: bool = False) -> Column:
    """The text up to its ``limit``-th word.

    The default cuts at the summed length of those words, blanks not counted, and
    so a little early; ``exact`` cuts right behind the word.
    """
    if exact:
        head = rf"\A(?:\s*+(?:[\p{{L}}\p{{N}}_]++|[^\s\p{{L}}\p{{N}}_])){{0,{limit}}}+"
        return F.regexp_extract(text, head, 0)
    kept = F.length(F.array_join(F.slice(words(text), 1, limit), ""))
    return F.substring(text, F.lit(1), kept)
