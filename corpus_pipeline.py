"""From raw documents to training tokens: five stages, each over all rows that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between
stages the rows are written as Parquet in the shared folder and read again.

Texts, ids and other columns may be null, tables empty and rows repeated: a row with a null doc_id is judged by its text
like any other, and each copy of a row counts as a row, save that of near duplicates one row stays.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringproof.llm import decontaminate, line_dedup, pieces, quality_classifier, simhash
from ringproof.llm.common import Scratch, join_sized, table

#: Words of a shingle.
SHINGLE = 5
#: The digest of a row's text, by which stages decide: ids may be null or repeat.
KEY = "_text_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("text"))


def _wordless():
    return ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    found = quality_classifier.classified(docs, table(spark, sf_dir, "labels"), *quality_classifier.document_sites(), keep=docs.columns)
    return found.where("accepted").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go."""
    return line_dedup.apply(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (similarity of the sets of shingles of 0.8 or more, found by 256 bits and tested on the shingles) the document of the smallest id stays, of its repeated rows one.

    Documents without a word are no copies of each other: all stay."""
    scratch = Scratch(spark, "pipeline-simhash")
    keyed = _keyed(docs)
    worded = keyed.where(~_wordless())
    # Of all rows, copies too: no text moves for it.
    known = scratch.save(simhash.fingerprints(worded, KEY, width=SHINGLE, wide=True), "prints")
    texts = worded.groupBy(F.col(KEY).alias("id")).agg(F.first("text").alias("text"))
    found = simhash.similar_classes(known, texts, scratch, SHINGLE)
    classes = scratch.save(known.select(F.col("id").alias(KEY), "node").distinct().join(found, "node").drop("node"), "classes")
    # Of each text the row of the smallest id, then of each class the text of the smallest id; null ids come last.
    least = worded.groupBy(KEY).agg(F.min("doc_id").alias("doc_id")).join(classes, KEY)
    first = least.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", KEY)).alias("f"))
    stay = scratch.save(first.select(F.col(f"f.{KEY}").alias(KEY), F.col("f.doc_id").alias("_least")), "kept")
    rows = join_sized(worded, stay, [KEY], "inner").where(F.col("doc_id").eqNullSafe(F.col("_least")))
    return rows.dropDuplicates([KEY]).select(docs.columns).unionByName(docs.where(_wordless()))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.apply(_keyed(docs), table(spark, sf_dir, "benchmark"), KEY).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, ids_sha256, round_trip."""
    return pieces.encoded(docs).select(F.col("id").alias("doc_id"), "n_pieces", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("quality classifier", accept),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding", encode),
]
#: The classifier is learned and SQL has no Viterbi search: stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
