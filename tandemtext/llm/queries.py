"""The queries of the operators, one for each, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtext.llm import (
    decontamination,
    exact_dedup,
    graph_search,
    html_text,
    jaccard_join,
    language,
    mixing,
    oracles,
    pii,
    secret_scan,
    substring_dedup,
    toxicity,
    vector_codes,
    whitening,
)
from tandemtext.llm.stored import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(oracles.CONTAMINATION)
def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(oracles.MIXING)
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(oracles.EXACT_COPIES)
def op7_exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, folder, "documents"))


@query(oracles.REPEATS)
def op4_drop_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.drop_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(oracles.NEAR_COPIES)
def op8_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document, with its class and its number of links."""
    found = jaccard_join.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "class_size", "n_links")


@query()
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = language.fit_documents(documents)
    found = language.identify(documents.select("doc_id", "text"), model)
    return found.select("row.doc_id", "lang_pred", "score").select(
        "doc_id", language.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score"
    )


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.fit_documents(documents, table(spark, folder, "labels"))
    found = toxicity.score_texts(documents, model)
    return found.select(
        "doc_id",
        language.held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query()
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def many(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        many(0).alias("n_assign"),
        many(1).alias("n_access"),
        many(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query()
def op10_personal(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 4)

    def many(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        many(0).alias("n_email"),
        many(1).alias("n_ip"),
        many(2).alias("n_card"),
        many(3).alias("n_phone"),
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"),
    )


@query()
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query(oracles.VECTOR_CODES)
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, folder, "embeddings"))
    return coded.select(
        "row.vec_id",
        "code",
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


@query()
def op12_whiten(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit_whitening(vectors)
    shares = F.array(*[F.lit(float(e)) for e in model.explained]) if model else F.array().cast("array<double>")
    found = whitening.whiten(vectors, model).select(
        "row.vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    )
    return found.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.count if model else 0).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )


@query()
def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    index = stored(graph_search.build_index(vectors), "graphs")
    asked = vectors.where(F.col("vec_id") % 100 == 0).select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector")
    )
    found = graph_search.search(index, asked)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
