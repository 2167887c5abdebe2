"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest

import corpus_pipeline
from tandemtext.llm import (
    decontamination,
    exact_dedup,
    html_text,
    jaccard_join,
    language,
    mixing,
    pii,
    secret_scan,
    substring_dedup,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, content string, node string, score string"
PROSE = "The quick brown fox jumps over the lazy dog and runs far away from the big house near the old river bank today"
LONG = " ".join(f"word{i % 977} turns{i % 31}" for i in range(30_000))
ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (2, PROSE, "en", "a"),
    (3, PROSE.upper() + " ", None, None),
    (None, PROSE, "en", None),
    (None, None, None, None),
    (4, None, "de", "b"),
    (5, "", "de", "b"),
    (6, " \n\t ", None, "b"),
    (7, "Das ist ein kurzer Text", "de", "c"),
    (8, "12345 67890 !!!", "de", "c"),
    (9, LONG, "en", "c"),
    (9, "other text with the same id", "en", "c"),
    (10, "x" * 100_000, "en", "d"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "i", "c", "n", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PROSE[20:90]), (2, "kurzer text"), (3, None), (4, ""), (5, "kurzer text"), (None, "no such words")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_exact_copies(odd, none):
    found = exact_dedup.find_copies(odd).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for r in found:
        groups.setdefault(r.text_sha256, []).append(r)
    for rows in groups.values():
        assert {r.group_size for r in rows} == {len(rows)}
        assert sum(r.kept for r in rows) == 1
        assert len({r.keep_id for r in rows}) == 1
    blank = next(rows for rows in groups.values() if any(r.doc_id == 5 for r in rows))
    assert {r.doc_id for r in blank} == {4, 5, 6, None} and {r.keep_id for r in blank} == {6}
    same = next(rows for rows in groups.values() if any(r.doc_id == 1 for r in rows))
    assert {r.keep_id for r in same} == {1} and len(same) == 4
    assert exact_dedup.find_copies(none).collect() == []
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.drop_copies(none).columns == odd.columns


@pytest.fixture
def uncoalesced(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_copies_across_ranges(spark, uncoalesced):
    rows = [(i, "same  text" if i % 3 else "same text") for i in range(4000)] + [(9000 + i, f"t {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    table = exact_dedup.content_table(docs, "doc_id", "text", False)
    assert table.filter("length >= 9 and head").count() > 2  # the copies lie in several ranges
    found = {r.doc_id: r for r in exact_dedup.find_copies(docs).collect()}
    assert len(found) == 4500
    assert all(r.keep_id == 1 and r.group_size == 4000 for i, r in found.items() if i < 4000)
    assert [i for i, r in found.items() if r.kept and i < 4000] == [1]
    assert exact_dedup.drop_copies(docs).filter("doc_id < 4000").collect()[0].doc_id == 1


def test_contamination(odd, none, items):
    found = decontamination.contamination(odd, items).collect()
    assert len(found) == len(ROWS)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[7].n_hit == 2 and by_id[7]["items"] == ["2", "5"]
    assert by_id[1].n_hit >= 10 and by_id[1]["items"] == ["1"]
    assert by_id[3].n_hit == by_id[1].n_hit
    assert (by_id[4].n_words, by_id[4].n_hit, by_id[4]["items"]) == (0, 0, [])
    assert decontamination.contamination(none, items).collect() == []
    clean = decontamination.contamination(odd, items.limit(0)).collect()
    assert len(clean) == len(ROWS) and not any(r.n_hit for r in clean)
    left = decontamination.drop_contaminated(odd, items)
    assert left.columns == odd.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["10", "4", "5", "6", "8", "9", "9", "None"])


def test_mixing(odd, none):
    found = mixing.mix_sources(odd).collect()
    assert len(found) == len(ROWS)
    assert {r.source for r in found} == {None, "a", "b", "c", "d"}
    for r in found:
        assert r.taken == r.size * r.copies <= 3 * r.size and r.target <= 3 * r.source_size
    assert {r.source_size for r in found if r.source == "b"} == {0}
    assert mixing.mix_sources(none).collect() == []
    assert mixing.mixed_documents(odd).columns == ["row", "copies"]
    assert mixing.mixed_documents(none).collect() == []


def test_repeats(odd, none):
    found = substring_dedup.drop_repeats(odd).collect()
    assert len(found) == len(ROWS)
    first = [r for r in found if r.doc_id == 1]
    assert first[0].n_removed == 0
    assert all(r.n_removed == r.n_words and r.kept == "" for r in found if r.doc_id == 2)
    assert [r.n_removed for r in found if r.doc_id == 3] == [0]
    assert {r.n_removed for r in found if r.doc_id is None} == {0, 23}
    # The pairs of words of the long text come round after 977 * 31 of them: it has fewer.
    assert {r.n_removed for r in found if r.doc_id == 9} == {0}
    assert substring_dedup.drop_repeats(none).collect() == []


def test_near_copies(odd, none):
    found = jaccard_join.near_copies(odd).collect()
    assert len(found) == len(ROWS)
    assert all(r.class_id == 1 and r.class_size == 5 and r.n_links == 4 for r in found if r.doc_id in (1, 2, 3))
    assert all(r.class_size == 1 and r.class_id == r.doc_id for r in found if r.doc_id in (4, 5, 6))
    assert jaccard_join.near_copies(none).collect() == []
    left = jaccard_join.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 9, 9, 10]


def test_language(odd, none):
    model = language.fit_documents(odd)
    found = language.identify(odd, model).select("row.doc_id", "lang_pred", "score").collect()
    assert len(found) == len(ROWS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in found if r.doc_id in (4, 5, 6, 8))
    assert all(0 <= r.score <= 1 for r in found)
    assert language.identify(none, model).collect() == []
    empty = language.identify(odd, language.fit_documents(none)).collect()
    assert {r.lang_pred for r in empty} == {"und"}
    assert language.drop_unknown(odd).columns == odd.columns


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (7, 0, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        model = toxicity.fit_documents(odd, marks)
        found = toxicity.score_texts(odd, model).collect()
        assert len(found) == len(ROWS) and all(0 <= r.score <= 1 for r in found)
    assert toxicity.score_texts(none, model).collect() == []


def test_spans(odd, none):
    for found, empty in (
        (secret_scan.scan(odd), secret_scan.scan(none)),
        (pii.find_personal(odd), pii.find_personal(none)),
    ):
        assert found.count() == len(ROWS)
        assert all(r.spans == [] for r in found.collect() if r.doc_id in (1, 4, 5, 6))
        assert empty.collect() == []


def test_pages(spark):
    rows = [
        (1, "http://h/a", "<article><p>one</p></article>", "x"),
        (1, "http://h/a", "<article><p>one</p></article>", "x"),
        (2, None, None, "x"),
        (3, "http://[bad", "", "x"),
        (None, "http://h/b", "<p>two", None),
        (4, "http://h/b", "just text &amp; more", "x"),
        (5, "", "<div>" * 3000 + "deep" + "</div>" * 3000, "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.main_text(pages).collect()
    assert len(found) == len(rows)
    assert sorted(r.text for r in found) == sorted(["one", "one", "", "", "two", "just text & more", "deep"])
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_pipeline_on_odd_rows(spark, odd, none, items, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = frame.columns
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns[: len(columns)] == columns, name
            frame.count()


def test_repeats_keep_the_type_of_ids(spark):
    """Ids of any type with an order; the order of their values decides which passage stays."""
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [("b", passage), ("a", "x " + passage), (None, passage), ("c", None), ("d", "few words")]
    docs = spark.createDataFrame(rows, "`key` string, text string")
    found = {r.key: (r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(docs, "key").collect()}
    assert found == {"a": (31, 0), "b": (30, 30), None: (30, 30), "c": (0, 0), "d": (2, 0)}
    small = spark.createDataFrame([(2, passage), (1, passage)], "doc_id int, text string")
    cut = substring_dedup.drop_repeats(small)
    assert dict(cut.dtypes)["doc_id"] == "int"
    assert {r.doc_id: r.n_removed for r in cut.collect()} == {1: 0, 2: 30}


def test_names_with_dots(spark, odd):
    docs = odd.withColumnRenamed("content", "some.content").withColumnRenamed("n_chars", "n`chars")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == exact_dedup.drop_copies(odd).count()
    assert jaccard_join.drop_near_copies(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).select("row.*").columns == docs.columns
    assert language.drop_unknown(docs).columns == docs.columns


def test_touching_spans():
    from tandemtext.llm.spans import touching

    spans = [(5, 9), (0, 3), (2, 30), (40, 41)]
    touches = touching(spans)
    for a in range(45):
        for b in range(a + 1, 46):
            assert touches(a, b) == any(a < e and s < b for s, e in spans)
    assert not touching([])(0, 5)


def test_long_texts_full_of_hits(spark):
    """200,000 lines of hits in one text, in seconds a scan."""
    import time

    keys = "\n".join(f"{i * 2654435761 % 2**64:016x}{i * 40503 % 2**64:016x} part{i}" for i in range(200_000))
    mails = "\n".join(f"u{i}@example.com 10.0.{i % 256}.7" for i in range(200_000))
    docs = spark.createDataFrame([(1, keys), (2, mails)], "doc_id long, text string")
    begun = time.time()
    found = {r.doc_id: len(r.spans) for r in secret_scan.scan(docs).collect()}
    assert found[1] >= 200_000
    assert time.time() - begun < 120
    begun = time.time()
    found = {r.doc_id: len(r.spans) for r in pii.find_personal(docs.where("doc_id = 2")).collect()}
    assert found[2] >= 400_000 and time.time() - begun < 120
