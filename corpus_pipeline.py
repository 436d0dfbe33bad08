"""From raw documents to token ids: five stages, each on all rows its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``. ``run`` writes each result to the folder the executors share and reads
it again, so a lost executor costs at most the stage at work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoweave.llm import bpe, mixing, neardup_text, secrets, toxicity
from ontoweave.llm.common import fresh_folder, table, written

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that a classifier trained on the labels calls toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, "__toxicity").where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, the one with the smallest doc_id.

    Rows are linked under keys of their own, so null and repeated doc_ids decide nothing: a null
    doc_id is larger than any other, and of rows that repeat the smallest doc_id any one stays.
    Rows without text are linked with nothing and all stay.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    links = neardup_text.link_documents(rows.select(F.col("__row").alias("doc_id"), "text"))
    links = links.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    doc_id = F.col("doc_id").cast("bigint")
    named = written(rows.select("__row", F.struct(doc_id.isNull(), doc_id, "__row").alias("__order")).join(links, "__row"), "named")
    first = named.groupBy("__group").agg(F.min("__order").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    dropped = named.join(first, "__group").where("__order.__row <> __first.__row").select("__row")
    return rows.join(dropped, "__row", "left_anti").drop("__row")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets inside the texts; ``n_chars`` follows the text where the column exists."""
    found = secrets.find(docs, name="__spans").withColumn("text", secrets.redacted("text", "__spans"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(F.size("__spans") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return found.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's weight asks for."""
    return mixing.emit(mixing.plan(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the text they decode to."""
    path = public_tokenizers.path(TOKENIZER)
    return bpe.encode(docs.select("doc_id", "text"), path, decoded=True).select(
        "doc_id",
        "n_tokens",
        "ids",
        F.col("decoded").alias("text"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

# A trained classifier decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
