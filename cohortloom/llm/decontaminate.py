"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Both sides are sets of distinct n-word shingles. Documents are partitioned by set size into doubling
classes; class u (sets of at most u shingles) has its own one-permutation MinHash sketch of 2u bins,
so that its load per bin, and with it the chance that a shared shingle is a bin's minimum, does not
fall with the length of a document: a short item finds its bins in a 20,000-word document as surely
as in a short one. Items get one such sketch for each class. A document is a candidate for an item
when at least `HITS` coordinates agree; each candidate is then verified on the exact shingles.

At a load of 1/2 a shared shingle is its bin's minimum on the document's side with a chance of over
0.78, so an item of 20 shingles of which 16 are shared is missed with a chance under 1e-9. Items of
fewer than `SMALL` shingles are looked up in a sketch with one bin for every shingle value (that is,
by every shingle), so they are never missed.

The item sketches are broadcast only when their number of coordinates is under `broadcast_limit`;
beyond that the same coordinates are joined by a shuffle on (class, bin, value).

Defined results: null or wordless texts and items match nothing; items with fewer than n words are
one shingle of their own length; rows that repeat a doc_id or item_id give one pair; other columns
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, ship, slices
from .text import ALNUM, blocks, mix, shingles, word_hashes

_U = np.uint64
SMALL = 12
HITS = 1
FIRST, CLASSES = 64, 26


def size_class(size: int) -> int:
    """0 for sets of up to FIRST, then one more for each doubling."""
    return max(0, int(np.ceil(np.log2(max(size, 1) / FIRST))))


def coordinates(values: np.ndarray, cls: int) -> np.ndarray:
    """The non-empty coordinates of the sketch of `values` for size class cls: a hash of (class, bin, minimum) each."""
    bins = 2 * FIRST << cls
    h = mix(values + _U(0xC2B2AE3D27D4EB4F))
    where = (h >> _U(20)) % _U(bins)
    order = np.lexsort((h, where))
    where, h = where[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = where[1:] != where[:-1]
    return mix(h[first] * _U(0x9DDFEA08EB382D69) + where[first] * _U(64) + _U(cls))


def _sets(texts: list[str], n: int, short: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its sorted distinct n-word shingles, and those of the lengths in `short` (for shorter items)."""
    for _, raw in blocks(texts):
        words, upto = word_hashes(raw, ALNUM)
        a = 0
        for b in upto:
            w = words[a:b]
            a = b
            few = [shingles(w, m) for m in short if len(w) >= m]
            yield (np.unique(shingles(w, n)) if len(w) >= n else np.zeros(0, _U)), (np.unique(np.concatenate(few)) if few else np.zeros(0, _U))


def _item_rows(n: int):
    """item_id, its shingles, its word count if under n (else 0)."""

    def run(batches):
        for batch in slices(batches):
            ids, sets, few = [], [], []
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = word_hashes([t.encode("utf-8", "surrogatepass")], ALNUM)[0]
                if len(words):
                    ids.append(i)
                    sets.append(np.unique(shingles(words, n)).view(np.int64))
                    few.append(len(words) if len(words) < n else 0)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(few, pa.int32())], names=["item_id", "s", "few"])

    return run, "item_id long, s array<long>, few int"


def _item_sketch_rows():
    def run(batches):
        for batch in slices(batches):
            ids, sketch = [], []
            for i, s in zip(batch.column("item_id").to_pylist(), batch.column("s").to_pylist(), strict=True):
                v = np.array(s, np.int64).view(_U)
                c = [mix(v)] if len(v) < SMALL else [coordinates(v, k) for k in range(CLASSES)]
                c = np.unique(np.concatenate(c))
                ids.append(np.full(len(c), i, np.int64))
                sketch.append(c.view(np.int64))
            if ids:
                yield pa.record_batch([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sketch))], names=["item_id", "c"])

    return run, "item_id long, c long"


def _document_rows(n: int, short: list[int], known: np.ndarray | None):
    """doc_id, coordinate for each coordinate of a document's sketch (only the known ones, if known is given), with the shingles."""

    def run(batches):
        for batch in slices(batches):
            ids, found, sets = [], [], []
            for i, (s, few) in zip(batch.column("doc_id").to_pylist(), _sets(batch.column("text").to_pylist(), n, short), strict=True):
                c = np.concatenate([coordinates(s, size_class(len(s))), mix(s), mix(few)])
                if known is not None:
                    at = np.minimum(np.searchsorted(known, c), len(known) - 1)
                    c = c[known[at] == c]
                if len(c):
                    ids.append(i), found.append(np.unique(c).view(np.int64)), sets.append(np.concatenate([s, few]).view(np.int64))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "c", "s"])

    return run, "doc_id long, c array<long>, s array<long>"


def _searched(n: int, short: list[int], items: list[tuple[int, np.ndarray]], sketch: tuple[np.ndarray, np.ndarray]):
    """The whole search in one pass over the documents, for a broadcast set of items."""
    coords, owner = sketch
    sets = dict(items)

    def run(batches):
        for batch in slices(batches):
            out: list[tuple] = []
            for i, (s, few) in zip(batch.column("doc_id").to_pylist(), _sets(batch.column("text").to_pylist(), n, short), strict=True):
                c = np.concatenate([coordinates(s, size_class(len(s))), mix(s), mix(few)])
                lo, hi = np.searchsorted(coords, c), np.searchsorted(coords, c, "right")
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                for item in sorted({int(owner[k]) for h in hit for k in range(lo[h], hi[h])}):
                    q = sets[item]
                    shared = int(np.isin(q, s).sum() + np.isin(q, few).sum())
                    out.append((i, item, len(q), shared))
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run, "doc_id long, item_id long, n_item long, n_shared long"


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80, broadcast_limit: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) where a document holds `percent` of an item's shingles."""
    docs = id_and_text(docs)
    ship(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["item_id"])
    run, schema = _item_rows(n)
    items = checkpointed(items.mapInArrow(run, schema))
    size, lengths = items.agg(F.sum(F.size("s").cast("long") * F.when(F.size("s") < SMALL, 1).otherwise(CLASSES)), F.collect_set("few")).first()
    short = sorted(x for x in lengths if x)
    run, schema = _item_sketch_rows()
    sketch = items.mapInArrow(run, schema)
    if not size:
        pairs = docs.select("doc_id", F.col("doc_id").alias("item_id"), F.lit(0).cast("long").alias("n_item"), F.lit(0).cast("long").alias("n_shared")).limit(0)
    elif size <= broadcast_limit:
        rows = sketch.toArrow()
        c = rows.column("c").to_numpy().view(_U)
        order = np.argsort(c, kind="stable")
        held = [(r.item_id, np.array(r.s, np.int64).view(_U)) for r in items.select("item_id", "s").collect()]
        run, schema = _searched(n, short, held, (c[order], rows.column("item_id").to_numpy()[order]))
        pairs = docs.mapInArrow(run, schema)
    else:
        run, schema = _document_rows(n, short, None)
        own = docs.mapInArrow(run, schema)
        found = own.select("doc_id", F.explode("c").alias("c")).join(sketch, "c").select("doc_id", "item_id").distinct()
        both = found.join(own.select("doc_id", "s"), "doc_id").join(items.select("item_id", F.col("s").alias("q")), "item_id")
        pairs = both.select("doc_id", "item_id", F.size("q").cast("long").alias("n_item"), F.size(F.array_intersect("q", "s")).cast("long").alias("n_shared"))
    return pairs.where(100 * F.col("n_shared") >= percent * F.col("n_item")).distinct().withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (all their columns) that hold no item."""
    found = contained_items(docs, items, n, percent).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs["doc_id"] == found["_leak"], "left_anti")
