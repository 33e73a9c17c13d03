"""From raw documents to packed training sequences, in stages that are each written and read again.

quality: documents that the classifier rejects go.
near_dedup: one document of each group of near copies stays.
secrets: spans that the scan finds are replaced by a mark.
packing: the documents' tokens in as few sequences as the plan finds.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import neardup, packing, quality, secret_scan
from tidegauge.llm.common import checkpoint, small_batches, table
from tidegauge.llm.queries import quality_model, tokenizer_file
from tidegauge.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3.  Only labelled rows outside the held-out fifth train."""
    _ready(spark)
    return quality.score(docs, quality_model(spark, sf_dir, docs), out="_score").filter("_score >= 0.3").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each component, as one row.

    Rows that repeat a doc_id are one document, that of the smallest text.  A row without an id is a
    document of its own, behind all that have one: a number that follows from its columns stands in.
    """
    _ready(spark)
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64(*COLUMNS), F.lit(1 << 61))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("bigint"), stand_in))
    found = neardup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    # a key that isn't kept, or stands in several rows, has to be looked up; all other rows stay where they are
    loose = checkpoint(neardup.thin(found.groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept")).filter("n > 1 or not kept")))
    asked, alone = neardup.mapped(keyed, loose, "_key")
    row = F.min(F.struct("text", *[c for c in COLUMNS if c != "text"])).alias("_row")
    repeated = asked.join(loose.filter("kept"), "_key", "left_semi").groupBy("_key").agg(row).select(*[F.col(f"_row.{c}").alias(c) for c in COLUMNS])
    return alone.unionByName(asked.join(loose, "_key", "left_anti")).select(*COLUMNS).unionByName(repeated)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span replaced by a mark; all documents stay."""
    found = secret_scan.redact(docs.select(*COLUMNS), text="text")
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it stands in which sequence."""
    _ready(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: A trained classifier and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the shared checkpoint folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="pipeline-")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
