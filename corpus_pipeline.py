"""The corpus pipeline: toxicity, near-dedup, decontamination, secret scan, BPE; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, decontaminate, neardup, secrets, toxicity
from cohortloom.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the lexicon is learned from the stage's own documents and `labels`."""
    return toxicity.non_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


#: Keys from here on are made from content; ids of documents are taken to be smaller.
OWN = 1 << 62


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays (five words, similarity 0.8).

    Rows without an id, and rows whose id others have too, are keyed on id and text: they are deduplicated like
    others, a group keeps a row with an id of its own before them, and of rows of equal id and text one stays.
    """
    ids = checkpointed(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id")))
    shared = ids.count()
    if not shared:
        return _of_kept(docs)
    if shared <= neardup.BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = F.lit(OWN) + F.xxhash64("row.doc_id", F.coalesce("row.text", F.lit(""))).bitwiseAND(F.lit(OWN - 1))
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.join(ids.select("id", F.lit(True).alias("many")), F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    rows = checkpointed(_of_kept(rows.select("row", "row.text", F.when(F.col("many"), own).otherwise(F.col("row.doc_id")).alias("doc_id"))))
    return rows.where(F.col("doc_id") < OWN).union(rows.where(F.col("doc_id") >= OWN).dropDuplicates(["doc_id"])).select("row.*")


def _of_kept(docs: DataFrame) -> DataFrame:
    kept = neardup.near_duplicates(docs, shingle=5, percent=80).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the token ids of each remaining document."""
    out = bpe.with_tokens(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("secret_scan", hide_secrets), ("bpe", encode)]

#: SQL cannot express the learned lexicon or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
