"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept; all but
the last return the columns of ``documents``.

Edge cases: a null text is never toxic, links with nothing, has no personal data, has size 0 (so mixing
takes no copy of it) and packs as the end id alone; empty texts likewise. A null doc_id is a document of its own in every stage. Rows
that repeat each other are near-duplicates, of which one stays. Null languages and sources are values
like others, null sources last. Texts are processed whole, however long. Ties (equal texts) go to the
smaller doc_id, rows without one coming last. Empty tables give empty tables. Further columns of
``documents`` stay until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetmill.llm import mixing, neardup, packing, pii, toxicity
from facetmill.llm.queries import vocabulary
from facetmill.llm.shared import table, written
from facetmill.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression doesn't reject."""
    return toxicity.without_rejected(docs, toxicity.train_on(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Rows that repeat a doc_id are documents of their own, and so are rows without one, which come last.
    """
    ship_package(spark)
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 OR doc_id IS NULL")
    key = "doc_id"
    if not odd.isEmpty():
        key = next(n for k in range(len(docs.columns) + 1) if (n := f"row{k}") not in docs.columns)
        rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(key, F.monotonically_increasing_id())
        docs_ = written(rows, "rows")
    else:
        docs_ = docs
    groups = neardup.near_duplicates(docs_.select(F.col(key).alias("doc_id"), "text"), percent=80)
    copies = groups.filter(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct()
    return docs_.join(copies, key, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data redacted; n_chars follows the text."""
    ship_package(spark)
    redacted = pii.redact(docs, pii.train())
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their source's target asks for."""
    ship_package(spark)
    return mixing.copied(docs, written(mixing.mix_sources(docs).select("doc_id", "draw", "source_key", "copies"), "copies"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its sequence and its place there."""
    ship_package(spark)
    packed, _ = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    sequence = F.shiftleft(F.col("part").cast("long"), 32) + F.col("sequence")
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express these stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}-{name}")
    return docs
