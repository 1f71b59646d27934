"""The queries of the operators in this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import decontaminate as dec
from recengine.llm import exactdup, jaccard, lmscore, mixing, pii, secrets, tokens, toxicity, urls
from recengine.llm.sql import SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, read and handed to Python workers in batches that are bounded by bytes as far as Spark has a setting for it: columns of
    512 rows, Arrow batches of 2000 rows and, but for one longer text, about 4 MB. The settings are the session's and change no result."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where the environment keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dec.decontaminate(spark, docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), dec.contaminated().alias("contaminated"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lmscore.score(spark, docs, toxicity.remainder("doc_id", 7) != 2, scanned=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text")


def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(toxicity.remainder("doc_id", 5) != 0)
    scored = toxicity.score(spark, docs, toxicity.train(spark, docs, labels))
    return scored.select("doc_id", (toxicity.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: (host, path, verdict); the operator takes any table of rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    return urls.filter_urls(pages, rules).drop("url")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {name: f for name, f in globals().items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return SQL
