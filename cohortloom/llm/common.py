"""Helpers shared by the text operators: inputs, checkpoints, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; a null text is the empty text. All other columns are pruned at the scan."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 5; remainder 0 is the held-out fold. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(1)).cast("int")


SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in batches of at most `rows`, so that a worker holds few texts and results at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder. Without one only a single machine gets a folder of its own; elsewhere it is an error."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cohortloom-"))
    return df.checkpoint(eager=True)


def _one_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; nodes are longs, edges (a, b)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.col("b").alias("x"), "a", "m")
    return small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("x").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


EDGES_A_TASK = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node that has an edge (a, b); component is the smallest id reachable.

    Alternating large-star and small-star steps (O(log^2 n) rounds), each cut by a checkpoint, so
    that no component is ever gathered in one task. Null ends and loops are ignored.
    """
    now = checkpointed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum((F.xxhash64("a", "b") % 1000003))).first())
    seen = print_of(now)
    #: A round has at most twice the first one's edges; many near-empty tasks cost more than the edges.
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, 1 + 2 * seen[0] // EDGES_A_TASK)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = checkpointed(_one_round(now).coalesce(tasks))
        if (then := print_of(now)) == seen:
            break
        seen = then
    else:
        raise RuntimeError("components did not converge")
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(now.select("b", "b").distinct())
