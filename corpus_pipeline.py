"""A corpus made ready for training: five operators in a row, each over all that the one before it kept.

toxicity: documents that the classifier rejects go. near duplicates: of each group of texts that share 80 % of their 5-word
shingles one document stays, the one with the smallest id. decontamination: documents of which a benchmark's passages are a twentieth or more go. mixing: a row for each time a
document is taken, the last one cut where the mix ends. token files: ids in Arrow files, read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import decontaminate, jaccard, mixing, queries, tokens, toxicity
from recengine.llm.shared import bounded, folder, kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _aside(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns that are none of a document's in one struct, so that no name of theirs meets one of an operator's; and the way back."""
    others = [c for c in docs.columns if c not in DOCUMENT]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("_others")] if others else []
    packed = docs.select(*(c for c in docs.columns if c in DOCUMENT), *rest)
    return packed, lambda out: out.select(*(F.col(c) if c in DOCUMENT else F.col("_others").getField(c).alias(c) for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of ``docs`` whose crc32(doc_id) modulo 5 is not 0, and judges all rows; null and empty texts get the
    prior's score, and stay unless most labels are toxic."""
    labels = queries.table(spark, sf_dir, "labels").where(toxicity.remainder("doc_id", 5) != 0)
    rows, back = _aside(docs)
    return back(toxicity.score(spark, rows, toxicity.train(spark, docs, labels)).where("predicted = 0"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts one row stays, that with the smallest id. Every row is a document of its own: if ids are missing or
    repeat, rows are numbered first, and of a group the first row stays. Texts without words are in no group and stay."""
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids"), F.countDistinct("doc_id").alias("different")).first()
    alone = ids["n"] == ids["ids"] == ids["different"]
    packed, back = _aside(docs)
    rows = packed.withColumn("_id", F.col("doc_id").cast("long")) if alone else kept(packed.withColumn("_id", F.monotonically_increasing_id()))
    groups = jaccard.similar_groups(rows.select(F.col("_id").alias("doc_id"), "text"), words=5, percent=80)
    stay = kept(groups.where("doc_id = component_id").select(F.col("doc_id").alias("_id")), ids["n"])
    return back(rows.join(bounded(stay), "_id", "left_semi"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the benchmark's passages make up a twentieth of, or more, go. Null and empty texts have no words and stay; each
    row is judged by itself, whatever its id; an empty benchmark or table changes nothing."""
    rows, back = _aside(docs)
    return back(decontaminate.decontaminate(spark, rows, queries.table(spark, sf_dir, "benchmark")).where(~decontaminate.contaminated()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a row of ``docs``, at most three, the last cut after as many words as are still taken; n_chars is
    that of the text as it is then. Rows without words are not taken. A null source is a source. An empty table stays empty."""
    rows, back = _aside(docs)
    return back(mixing.written_out(mixing.mix(spark, rows)).withColumn("n_chars", F.length("text").cast("long")))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row in Arrow files, read back: doc_id, start, n_tokens, ids_crc32. Null and empty texts are an end id alone; rows that
    share an id follow each other; rows without id come first. An empty table writes no file."""
    return tokens.round_trip(spark, docs, queries.tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("n-gram jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed),
    ("token files", token_files),
]

#: A fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written as Parquet to the shared folder and read by the next."""
    queries.table(spark, sf_dir, "documents")
    where, docs = f"{folder(spark)}/recengine/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return done
        done.write.parquet(f"{where}/{k}")
        docs = spark.read.schema(done.schema).parquet(f"{where}/{k}")
    return docs
