"""A training-data pipeline over ``documents``: quality, exact and near dedup, mixing, tokens.

Every stage takes (session, documents, folder) and returns rows with the columns of
``documents``, fewer or repeated; the last returns the token digests. Decisions are
made on light columns and joined back by the row's id and a hash of its text, so
rows that repeat an id stay apart if their texts differ. A dedup stage keeps one row
of each group, also where rows repeat both or have no id.

In every stage a null text counts as empty, whole texts count however long, an empty
table gives an empty result, and further columns, whatever their names, are kept as
they are (the last stage returns its own columns).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import exact_dedup, mixing, quality, sentencepieces, simhash
from siltstone.llm.common import checkpointed, deleted, free_names, shared_folder, table, text_of


def _keep(docs: DataFrame, kept: DataFrame, text_hash) -> DataFrame:
    """One row of ``docs`` for each (doc_id, hash of the text) in ``kept`` (doc_id, key, n).

    ``n`` is the number of rows that have both. Only those that repeat are grouped
    with their texts, combined before they are shuffled; the least row stays.
    """
    of_text, row_id, row_key, row_count = free_names(docs, "text hash", "row id", "row key", "row count")
    wanted = checkpointed(kept.select(F.col("doc_id").alias(row_id), F.col("key").alias(row_key), F.col("n").alias(row_count)))
    keyed = docs.withColumn(of_text, text_hash)

    def found(side: DataFrame, how: str) -> DataFrame:
        # hashed on the light side, so that the rows with texts needn't be sorted
        side = side.drop(row_count).hint("shuffle_hash")
        return keyed.join(side, keyed["doc_id"].eqNullSafe(side[row_id]) & (keyed[of_text] == side[row_key]), how)

    repeated = wanted.where(F.col(row_count) > 1)
    single = found(wanted.where(F.col(row_count) == 1), "left_semi").drop(of_text)
    if repeated.isEmpty():
        return single
    row = F.min(F.struct(*[docs[c] for c in docs.columns])).alias("row")
    return single.union(found(repeated, "inner").groupBy(row_id, row_key).agg(row).select("row.*"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents given.

    A null text is scored as an empty one. Rows that repeat are judged alike, and a score
    that ties with the threshold passes. Without labels every score is one half, so
    that all go; rows without doc_id are judged, but can't be learned from.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside), one row with the smallest doc_id stays.

    Null and empty texts are equal. A null doc_id stays only if its group has no other;
    of rows that tie in doc_id and text the least by all columns stays.
    """
    found = exact_dedup.find_copies(docs.select("doc_id", "text")).where("kept")
    return _keep(docs, found.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")), F.xxhash64(exact_dedup.normalised(docs)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays: one with the smallest doc_id.

    Texts without words (null, empty, white space) are one group, with what is near their
    fingerprint. Ties and null ids as in exact dedup, the least hash of a text first.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text"), roots=True)
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    kept = least.groupBy("root").agg(F.min(F.struct("doc_id", "key", "n")).alias("x")).select("x.*")
    return _keep(docs, kept, F.xxhash64(text_of(docs)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their targets.

    A text without words counts nothing for its source but is drawn like others; a null
    source is a source; rows that repeat a doc_id draw alike, rows without one by text.
    """
    return mixing.emitted(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the round trip's digests of every row that the mix takes, repeats
    included; a null or empty text has no ids."""
    return sentencepieces.encoded(docs, ids=False)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A trained model, XXH64 fingerprints and SentencePiece can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder
    named by spark.checkpoint.dir (a temporary one in a local session without that
    setting) and reread. A stage's rows are deleted once the next stage's are written;
    the last stage's, a small part of them, are settled in a checkpoint."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            deleted(spark, before)
        before = path
    last = checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    deleted(spark, folder)
    return last
