import itertools
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandemtext.functions import bleu
from tandemtext.plans import oracles

HAMMER = "Su símbolo era la hoz y el martillo sobre el mundo."
BLOG = (
    "Engadget es un miembro de Weblogs, Inc., una red de blogs con más de 75 weblogs, "
    "incluyendo Autoblog y Joystiq; y, anteriormente, Hack-A-Day."
)
CITY = (
    "=== Investigación ===Además de los centros de investigación e institutos de la "
    "universidad, existen numerosas instituciones de investigación situadas en la ciudad de "
    "Heidelberg."
)
# Published sentence scores of (prediction, reference).
GOLDEN = [
    ("Es endémico de Italia.", "Es originaria de Italia.", 42.72870063962342),
    ("Es endemica en Italia.", "Es originaria de Italia.", 23.643540225079384),
    ("Su smbolo fue el hilo y la cinta sobre el mundo.", HAMMER, 25.211936184349828),
    ("Su símbolo era el martillo y la hoz sobre el mundo.", HAMMER, 38.16330911371339),
    (
        "Engadget fue el blog más grande de Weblogs, Inc., una red de blogs con más de 75 blogs "
        "incluyendo Autoblog y Joystiq y antes incluyendo Hack-A-Day.",
        BLOG,
        53.772283073230966,
    ),
    (
        "Engadget era el blog más grande de Weblogs, Inc., una red de blogs con más de 75 blogs "
        "incluyendo Autoblog y Joystiq y anteriormente incluyendo Hack-A-Day.",
        BLOG,
        54.37318396709828,
    ),
    (
        '"Lo luchó junto a Ka-Zar contra Saurón, y por la segura regresión de Shanna, el diablo '
        "senor, que Saurón captura.",
        "Luchó junto a Ka-Zar contra Sauron, y para el retorno seguro de Shanna la Diablesa, "
        "quien fue capturada por Sauron.",
        14.385017556508675,
    ),
    (
        "===Resea===Además de los centros y institutos de investigación de la universidad, hay "
        "numerosas instituciones de investigación situadas en la ciudad de Heidelberg.",
        CITY,
        65.88852581937098,
    ),
    (
        "Además de los centros e institutos de investigación de la universidad, hay numerosas "
        "instituciones de investigación situadas en la ciudad de Heidelberg.",
        CITY,
        52.28027711881673,
    ),
]


def stats_rows(spark, pairs):
    rows = [(i, p, r) for i, (p, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i INT, p STRING, r STRING").repartition(3)
    stats = bleu.statistics(F.col("p"), F.col("r"))
    return df.select("i", stats.alias("s"))


def scores(spark, pairs):
    out = stats_rows(spark, pairs).select("i", bleu.score(F.col("s")).alias("v"))
    return [row["v"] for row in sorted(out.collect())]


def test_golden_sentence_scores(spark):
    found = scores(spark, [(p, r) for p, r, _ in GOLDEN])
    assert found == pytest.approx([v for _, _, v in GOLDEN], abs=1e-9)


def test_edge_scores(spark):
    pairs = [
        ("uno dos tres", "uno dos tres"),
        ("a b c d", "e f g h"),
        ("", "a b c d"),
        ("a b c d", ""),
        ("", ""),
        (None, "a"),
        ("a", None),
        ("uno dos tres cuatro", "uno dos tres cuatro"),
        ("a b c d x", "a b c d y z"),
    ]
    found = scores(spark, pairs)
    last = math.exp(1 - 6 / 5) * 100 * (4 / 5 * 3 / 4 * 2 / 3 * 1 / 2) ** 0.25
    assert found[:5] == [0.0, 0.0, 0.0, 0.0, 0.0]
    assert found[5:7] == [None, None]
    assert found[7:] == pytest.approx([100.0, last], abs=1e-9)


def test_exponential_smoothing_doubles_per_missing_order(spark):
    # Orders 1 to 4: 2 of 5, 0 of 4, 0 of 3, 0 of 2.
    [found] = scores(spark, [("a x b y z", "b q a r s")])
    want = (40 * 100 / (2 * 4) * 100 / (4 * 3) * 100 / (8 * 2)) ** 0.25
    assert found == pytest.approx(want, abs=1e-9)


def test_13a_tokens():
    cases = {
        "5.906 units, 3-4 (7/km²).": "5.906 units , 3 - 4 ( 7 / km² ) .",
        "a &quot;b&quot; &amp; &lt;c&gt;": 'a " b " & < c >',
        "split-\nword": "splitword",
        "<skipped>one\ntwo\n": "one two",
        "ends-\n\t ": "ends-",
        "1,000.5 is 1,000": "1,000.5 is 1,000",
        "año 1990-1991, 1ª.": "año 1990 - 1991 , 1ª .",
    }
    assert {text: " ".join(tokens_of([text])[0]) for text in cases} == cases


def tokens_of(texts):
    return [text.split() for text in bleu.spacer_13a()(pa.array(texts, pa.string())).to_pylist()]


def test_corpus_score_from_published_counts(spark):
    # Statistics and score of a published evaluation run.
    stats = [23310, 79588, 1679, 12, 7, 3, 23310, 20306, 17302, 14298]
    df = spark.createDataFrame([(stats,)], "s ARRAY<BIGINT>")
    value = df.select(bleu.metric(F.col("s")).alias("m")).first()["m"]
    assert value["score"] == pytest.approx(0.012329590439627326, rel=1e-12)
    assert value["bp"] == pytest.approx(0.08942735901865709, rel=1e-12)
    assert value["precisions"] == pytest.approx(
        [7.202917202917203, 0.059095833743721064, 0.04045775054906947, 0.0209819555182543],
        rel=1e-12,
    )


def test_corpus_score_is_not_the_mean(spark):
    pairs = [("a b c d e", "a b c d e"), ("a b x d e", "a b c d e")]
    df = stats_rows(spark, pairs)
    total = df.agg(bleu.summed(F.col("s")).alias("s"))
    value = total.select(bleu.score(F.col("s")).alias("v")).first()["v"]
    want = 100 * (9 / 10 * 6 / 8 * 3 / 6 * 2 / 4) ** 0.25
    assert value == pytest.approx(want, abs=1e-9)


def test_unsmoothed_metric(spark):
    pairs = [("Here you are", "Here we are"), ("This is more text", "This is more text")]
    out = stats_rows(spark, pairs).select("i", bleu.plain_metric(F.col("s")).alias("m"))
    first, second = [row["m"] for row in sorted(out.collect(), key=lambda r: r["i"])]
    assert first["bleu"] == 0.0 and first["precisions"][0] == pytest.approx(2 / 3)
    assert second["bleu"] == 1.0 and second["length_ratio"] == 1.0


def test_metric_keys_are_a_list():
    with pytest.raises(TypeError):
        bleu.metric_columns("sacrebleu", F.lit(None), "score")


def test_several_predictions_share_one_reference(spark):
    df = spark.createDataFrame([("a b c d", "a x c d", "a b c d", None)],
                               "p STRING, q STRING, r STRING, n STRING")
    both = df.select(
        bleu.statistics_of([F.col("p"), F.col("q"), F.col("n")], F.col("r")).alias("both"),
        bleu.statistics(F.col("p"), F.col("r")).alias("p"),
        bleu.statistics(F.col("q"), F.col("r")).alias("q"),
    ).first()
    assert both["both"] == [both["p"], both["q"], None]


token = st.sampled_from(["a", "b", "c", "dd", ",", "5.9", "é"])
sentence = st.lists(token, max_size=12).map(" ".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(sentence, sentence), min_size=20, max_size=40))
def test_bounds_and_identity(spark, pairs):
    for value in scores(spark, pairs):
        assert 0 <= value <= 100 + 1e-9
    same = [(r, r) for _, r in pairs]
    for (text, _), value in zip(same, scores(spark, same)):
        long_enough = len(text.replace(",", " , ").split()) >= 4
        assert value == pytest.approx(100.0 if long_enough else 0.0)


def published_13a(text):
    """The published steps one by one, to compare the shortcuts with."""
    out = text.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, sign in bleu.ENTITIES:
        out = out.replace(entity, sign)
    out = f" {out} "
    for pattern, spacing in (
        oracles.SIGN, bleu.STOP_AFTER_NON_DIGIT, bleu.STOP_BEFORE_NON_DIGIT, bleu.DASH_AFTER_DIGIT
    ):
        out = re.sub(pattern, spacing, out)
    return out.split()


piece = st.sampled_from([".", ",", "5", "a", "-", " ", "\n", "-\n", "&lt;", "&", "é", "(", "'", "\t"])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(piece, max_size=9).map("".join), min_size=50, max_size=150))
def test_shortcuts_tokenize_as_published(texts):
    assert tokens_of(texts) == [published_13a(text) for text in texts]


def test_runs_of_stops():
    runs = ["".join(run) for n in range(1, 6) for run in itertools.product(".,", repeat=n)]
    texts = [p + run + q for p, q in itertools.product(["a", "5", " "], repeat=2) for run in runs]
    assert tokens_of(texts) == [published_13a(text) for text in texts]


def test_counts_are_exact_on_random_pairs(spark):
    """Against counting with tuples, on texts that repeat words."""
    rng = random.Random(5)
    pairs = [
        tuple(" ".join(rng.choices("abcde", k=rng.randint(0, 30))) for _ in range(2))
        for _ in range(300)
    ]

    def grams(text, n):
        tokens = text.split()
        return Counter(zip(*(tokens[i:] for i in range(n))))

    for row in stats_rows(spark, pairs).collect():
        p, r = pairs[row["i"]]
        matches = [sum((grams(p, n) & grams(r, n)).values()) for n in range(1, 5)]
        totals = [sum(grams(p, n).values()) for n in range(1, 5)]
        assert row["s"] == [len(p.split()), len(r.split()), *matches, *totals]


def test_signs_are_set_apart_in_one_pass():
    """As one replacement after the other does it, also in a slice, in empty texts and beside other letters."""
    texts = ["", "a!b", "!!", "ü(é)—“x”", "no sign", "", "a=b&c;[d]{e}~", "€%", "x."] * 3
    called = []
    replace = pa.compute.replace_substring
    wanted = pa.array(texts)
    for sign in bleu.SIGNS:
        wanted = replace(wanted, sign, f" {sign} ")
    wanted = [t.replace(".", " . ").split() for t in wanted.to_pylist()]
    for start in (0, 5):
        held = pa.array(["left out"] * start + texts)[start:]
        try:
            pa.compute.replace_substring = lambda *a, **k: called.append(a[1]) or replace(*a, **k)
            found = bleu.spacer_13a()(held).to_pylist()
        finally:
            pa.compute.replace_substring = replace
        assert [t.split() for t in found] == wanted
    assert not set(called) & set(bleu.SIGNS)
    assert bleu.spacer_13a()(pa.array([], pa.string())).to_pylist() == []
