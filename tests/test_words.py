"""Treebank words, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tandemtext.functions.text import GAP, TREEBANK, TREEBANK_SIGNS, treebank_words

CASES = [
    ("They'll save and invest more.", "They 'll save and invest more ."),
    ("Good muffins cost $3.88 in New York.  Please buy me two of them.", "Good muffins cost $ 3.88 in New York . Please buy me two of them ."),
    ('He said "hi, can\'t stop" to her.', "He said `` hi , ca n't stop '' to her ."),
    ("I cannot go; it's Peter's, isn't it?", "I can not go ; it 's Peter 's , is n't it ?"),
    ("gonna, gotta. 'Twas 1,000:30 -- no...", "gon na , got ta . 'T was 1,000:30 -- no ..."),
    ("(a [b] {c} <d>)", "( a [ b ] { c } < d > )"),
    ("we've\nthe dogs' bone\tI'm you'd", "we 've the dogs ' bone I 'm you 'd"),
    ("e.g. this v1.2.3, at 10% & more!", "e.g. this v1.2.3 , at 10 % & more !"),
    ("The end.\nAnd so on.", "The end . And so on ."),
    ("ends here,", "ends here ,"),
    ("", ""),
    (" \t\n ", ""),
    ("Ünï can’t — 中文。", "Ünï can’t — 中文。"),
]


@pytest.mark.parametrize("text, wanted", CASES)
def test_treebank_words(spark, text, wanted):
    found = spark.createDataFrame([(text,)], "t string").select(treebank_words(F.col("t")).alias("w")).first().w
    assert found == wanted.split()


def test_no_text_no_words(spark):
    assert spark.range(1).select(treebank_words(F.lit(None).cast("string")).alias("w")).first().w is None


def test_stages_that_are_left_out_change_nothing(spark):
    """Texts with and without the signs of each stage, against all stages one after the other."""
    told = ["cannot", "CANNOT", "D'ye", "Gimme", "lemme", "gonna", "Wanna", "gotta", "more'n", "'Tis", "'twas", "can't",
            "it's", "dogs'", '"so"', "``so", "``", "a--b", "wait...", "' ", "x,", "y:", "(z)", "e.g.", "Ünï", "İs"]
    texts = told + [f"{a} {b}. {c}\n{a}'" for a, b, c in zip(told, told[3:] + told[:3], told[7:] + told[:7])]
    text = F.col("t")
    for pattern, replacement in TREEBANK:
        text = F.regexp_replace(text, F.lit(f"(?d){pattern}"), F.lit(replacement.replace("\\", "$")))
    plain = F.filter(F.split(text, f"{GAP}+"), lambda word: word != "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.select(treebank_words(F.col("t")).alias("a"), plain.alias("b")).where("a <> b").collect() == []
    # Every stage with signs has texts that lack them, and texts that hold them.
    for signs in TREEBANK_SIGNS.values():
        assert 0 < sum(any(sign in t.lower() for sign in signs) for t in texts) < len(texts)
