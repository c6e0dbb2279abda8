"""Shards by extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a 60-bit hash of the document id. It starts as one
bucket; only a bucket over the byte limit splits, on the next bit, until every bucket fits. The
directory is made from sums of bytes over hash prefixes, never from documents: one shuffle of
(prefix, bytes) partial sums, and sums of those for each shorter prefix. Buckets that are still too
large after `step` more bits go through another round over their rows alone. What no bit can split,
rows with the very same id, is numbered within the id and laid out in runs that fit the limit.

Defined results: null texts have no bytes, null ids hash as an empty string; a document larger than
the limit has a shard of its own with oversize = true; repeated rows are spread over runs; an empty
table gives an empty result; other columns are ignored by `shards` and kept by `write_shards`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BITS = 60
LIMIT = 32 << 20


def hash60(key: Column) -> Column:
    """The first 60 bits of the md5 of the key's text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, F.lit(BITS) - depth) if isinstance(depth, Column) else F.shiftright(h, BITS - depth)


def directory(sizes: DataFrame, limit: int, step: int | None = None) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows, fits) of the buckets for rows (h, n_bytes); fits is false where no bit helps."""
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    step = step or 4
    base, todo, done = 0, sizes, None
    depth = max(1, math.ceil(math.log2(max(1, total / limit)))) + step
    while True:
        top = min(BITS, base + depth)
        fine = todo.groupBy(_prefix(F.col("h"), top).alias("p")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"))
        each = fine.select("n_bytes", "n", "p", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        nodes = each.groupBy("depth", F.expr(f"shiftright(p, {top} - depth)").alias("prefix")).agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        nodes = checkpointed(nodes)
        over = nodes.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        kids = nodes.withColumn("up", F.shiftright("prefix", 1))
        leaf = nodes.where((F.col("depth") == base) & (F.col("shard_bytes") <= limit)) if not base else nodes.limit(0)
        leaf = leaf.union(kids.where(F.col("shard_bytes") <= limit).join(over, ["depth", "up"], "left_semi").select("depth", "prefix", "shard_bytes", "shard_rows"))
        leaf = leaf.withColumn("fits", F.lit(True))
        done = leaf if done is None else done.union(leaf)
        left = nodes.where((F.col("depth") == top) & (F.col("shard_bytes") > limit))
        n_left = left.count()
        if not n_left:
            return done
        if top == BITS:
            return done.union(left.withColumn("fits", F.lit(False)))
        p = left.select(F.col("prefix").alias("_p"))
        todo = todo.join(p, _prefix(todo.h, top) == p._p, "left_semi")
        base, depth = top, 16


def assign(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows with (h, n_bytes) get depth, prefix, run, shard_bytes, shard_rows, oversize and shard_id."""
    leaves = checkpointed(directory(rows.select("h", "n_bytes"), limit))
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())
    small = leaves.count() <= 100_000
    out = None
    keyed = rows.withColumn("_at", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths else rows.withColumn("_at", F.lit(0))
    leaves = leaves.withColumnRenamed("depth", "_at").withColumnRenamed("prefix", "_prefix")
    keyed = keyed.withColumn("_prefix", F.expr(f"shiftright(h, {BITS} - _at)"))
    out = keyed.join(F.broadcast(leaves) if small else leaves, ["_at", "_prefix"])
    fits = out.where("fits").withColumn("run", F.lit(0).cast("long"))
    stuck = out.where("not fits")
    #: Rows of one id: numbered in an order that only ties can vary, and cut into runs of at most the limit.
    w = Window.partitionBy("h").orderBy("n_bytes", *[c for c in ("doc_id",) if c in rows.columns])
    one = Window.partitionBy("h")
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.max("n_bytes").over(one)))).cast("long")
    stuck = stuck.withColumn("run", F.floor((F.row_number().over(w) - 1) / per).cast("long"))
    run = Window.partitionBy("h", "run")
    stuck = stuck.withColumn("shard_bytes", F.sum("n_bytes").over(run)).withColumn("shard_rows", F.count("*").over(run))
    out = fits.unionByName(stuck) if leaves.where("not fits").limit(1).count() else fits
    bits = F.lpad(F.conv(F.col("_prefix").cast("string"), 10, 2), F.col("_at"), "0")
    name = F.concat(F.lit("b"), F.when(F.col("_at") > 0, bits).otherwise(""), F.when(F.col("fits"), "").otherwise(F.concat(F.lit("-"), F.col("run").cast("string"))))
    out = out.withColumn("shard_id", name).withColumn("oversize", F.col("shard_bytes") > limit)
    return out.withColumnRenamed("_at", "depth").drop("_prefix", "fits", "run", "h")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard_id, shard_bytes, shard_rows, oversize for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hash60(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return assign(rows, limit).select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "shard_id", "shard_bytes", "shard_rows", "oversize")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write docs as Parquet, one directory for each shard; every column is kept."""
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    rows = docs.select(row, hash60(F.col("doc_id")).alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = assign(rows, limit).select("_row", F.col("shard_id").alias("_shard"))
    out.repartition("_shard").select("_row.*", "_shard").write.partitionBy("_shard").parquet(path)
