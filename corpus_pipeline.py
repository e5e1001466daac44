"""The corpus pipeline: raw documents in, packed token rows out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm.decontamination import decontaminate
from stackloom.llm.idfilter import IdFilter
from stackloom.llm.jaccard_join import near_duplicates
from stackloom.llm.mixing import mix
from stackloom.llm.quality_rules import quality_rules
from stackloom.llm.scratch import Scratch, opened, release
from stackloom.llm.session import table
from stackloom.llm.token_packing import pack_tokens

#: Texts go to Python workers in batches of this size at most (the default of 64 MB stands several times in an executor: as rows, as vectors and in the worker).
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
#: The pipeline's near-duplicate stage: five-word shingles, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that the rules reject; n_chars follows the text."""
    judged = quality_rules(docs)
    verdict = judged.columns[-1]
    kept = judged.filter(F.col(f"{verdict}.kept"))
    new = {"text": F.col(f"{verdict}.clean_text"), "n_chars": F.length(f"{verdict}.clean_text").cast("long")}
    return kept.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays, that with the smallest id, then the smallest digest of its text.

    Rows are told apart by id and text, so a null or shared id costs no other row
    its place; of rows alike in both one stays.  Rows whose key is not among those
    with something to drop, by a bitmap, are not shuffled.
    """
    scratch = Scratch(spark, "deduplicate")
    tag = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    found = near_duplicates(docs, SHINGLE_WORDS, *SIMILARITY, tag=tag)
    gone = found.groupBy("doc_id", "tag").agg(F.max("first").alias("stays"), F.count("*").alias("times")).filter("times > 1 or not stays")
    gone = scratch.write(gone.select(F.col("doc_id").alias("__gone_id"), F.col("tag").alias("__gone_tag"), "stays"), "gone")
    own = F.xxhash64(F.col("doc_id").cast("long"), tag)
    suspects, rest = IdFilter(scratch, "bits", gone.select(F.xxhash64("__gone_id", "__gone_tag").alias("key"))).split(docs, own)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    suspects = suspects.select(row.alias("__row"), F.col("doc_id").cast("long").alias("__id"), tag.alias("__tag"))
    suspects = suspects.join(gone, F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__tag") == F.col("__gone_tag")), "left")
    # of rows alike in id and text, the first by all columns
    alike = suspects.filter("stays").groupBy("__id", "__tag").agg(F.min_by("__row", F.to_json("__row")).alias("__row"))
    kept = suspects.filter("stays is null").select("__row.*").unionByName(alike.select("__row.*"))
    return rest.unionByName(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice stands twice."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_tokens(docs)


def bounded(stage):
    """The stage with BATCH_BYTES in its session, also when its result is written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", bounded(clean)),
    ("near duplicates", bounded(deduplicate)),
    ("decontamination", bounded(remove_leaks)),
    ("source mixing", bounded(mix_sources)),
    ("token packing", bounded(pack)),
]

#: A latent-space search and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, own = table(spark, sf_dir, "documents"), opened()
    before = spark.conf.get(BATCH)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage_{k}")
            # a stage's own tables, and its input, are not needed once its output is written
            release(spark, own)
            if k:
                scratch.drop(f"stage_{k - 1}")
    finally:
        spark.conf.set(BATCH, before)
    return docs
