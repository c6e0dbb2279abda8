"""MinHash near-duplicate groups over fast similarity sketches.

A document's set holds its distinct word shingles. Each set gets a sketch of `bands * rows`
coordinates by rounds of hashed bin placement: in round i every element falls into one bin (a
random one in the first t rounds, bin i - t in the t rounds after), with value i + fraction; the
least value wins. So every coordinate fills, and the coordinates are concentrated better than
independent MinHash. Bands of the sketch are buckets; candidates are confirmed on the full sets.

Work stays linear in large groups: equal sets collapse first; a bucket links each member to its
smallest id only (a star), and a second pass looks for links between different components of a bucket
with exact prefix and position filters. Nothing is capped, no bucket is gathered in one task: the pairs
of one text are dealt to parts by the other text's hash, and the text goes once to each part that has some.

Defined results: null or wordless texts have the empty set and link with nothing; fewer words than
the shingle length make one shingle; rows that repeat a doc_id are one document (if their texts differ, the
one with the least text hash) and all get its results; a null doc_id has
the smallest id of its group for component_id, if there is one, and a null `kept` (the pipeline's
stage gives such rows keys of their own); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, id_and_text, slices
from .text import mix, shingle_sets

_U = np.uint64
BROADCAST_IDS, HOT = 1_000_000, 500


def sketch(values: np.ndarray, t: int, seed: int = 0) -> np.ndarray:
    """Fast similarity sketch of a non-empty array of distinct uint64: t uint64 coordinates.

    A coordinate's top byte pair holds the round, the rest the fraction; equal coordinates mean that
    the same element won the same bin in the same round.
    """
    empty = np.iinfo(np.uint64).max
    out = np.full(t, empty, _U)
    #: Rounds are placed a block at a time: later rounds never change a filled coordinate.
    step = int(np.ceil(t * (np.log(t) + 1) / len(values)))
    for i in range(0, t, step):
        rounds = np.arange(i, min(t, i + step), dtype=_U)[:, None]
        h = mix(values + (rounds + _U(1 + seed)) * _U(0x9E3779B97F4A7C15))
        bins = ((h >> _U(40)) * _U(t) >> _U(24)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), ((mix(h) >> _U(16)) | (rounds << _U(48))).ravel())
        if out.max() != empty:
            return out
    for j in np.flatnonzero(out == empty):
        h = mix(values + _U(0x9E3779B97F4A7C15 * (int(j) + t + 1 + seed) & 0xFFFFFFFFFFFFFFFF))
        out[j] = (mix(h) >> _U(16)).min() | _U((int(j) + t) << 48)
    return out


def _sketcher(n: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = mix(np.arange(1, bands + 1, dtype=_U))
        for batch in slices(batches):
            size, h1, h2, keys = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), n):
                size.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), keys.append([])
                    continue
                h1.append(int(np.add.reduce(mix(s)).view(np.int64)))
                h2.append(int(np.add.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5))).view(np.int64)))
                lines = sketch(s, bands * rows).reshape(bands, rows)
                key = place.copy()
                for r in range(rows):
                    key = mix(key * _U(0x9DDFEA08EB382D69) + lines[:, r])
                keys.append(key.view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(map(_unpacked, batch.column("z").to_pylist()), n)]
            yield pa.record_batch([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return run, "id long, s array<long>"


def _unpacked(z: bytes) -> str:
    return zlib.decompress(z).decode("utf-8", "surrogatepass")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        z = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(z, pa.binary())], names=["id", "z"])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, z): the packed whole text of each id of ids, once. A packed text is about a quarter of its shingles' size.

    The ids are broadcast only if there are at most BROADCAST_IDS (8 MB); more of them meet the texts in a shuffle.
    """
    ids = ids.distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs.doc_id == ids.id, "left_semi").mapInArrow(_packed, "id long, z binary").dropDuplicates(["id"])


def _verifier(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            b, right = batch.column("b").to_pylist(), batch.column("zb").to_pylist()
            #: Rows of one b in a part follow each other; its set is then made once.
            starts = [not i or b[i] != b[i - 1] for i in range(len(b))]
            sets = shingle_sets((_unpacked(z) for z, new in zip(right, starts, strict=True) if new), n)
            ok = []
            for x, new in zip(shingle_sets(map(_unpacked, batch.column("za").to_pylist()), n), starts, strict=True):
                if new:
                    y = next(sets)
                common = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run, "a long, b long"


PARTS, PAIRS_A_PART = 64, 20_000


def _beside(pairs: DataFrame, texts: DataFrame, side: str, other: str, parts: int) -> DataFrame:
    """The pairs with the packed text of one side as `z<side>`. A text's pairs go to `parts` parts, so a text of very many pairs makes no hot task."""
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64(other), F.lit(parts)))
    wanted = pairs.select(side, "part").distinct()
    held = texts.join(wanted, texts.id == wanted[side]).select(side, "part", F.col("z").alias(f"z{side}"))
    return pairs.join(held.hint("merge"), [side, "part"]).drop("part")


def _confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets reach the similarity."""
    pairs = checkpointed(pairs)
    parts = max(PARTS, pairs.count() // PAIRS_A_PART)
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    run, schema = _verifier(n, percent)
    both = _beside(_beside(pairs, texts, "a", "b", parts), texts, "b", "a", parts)
    return both.select("a", "b", "za", "zb").mapInArrow(run, schema)


def _prefix_pairs(ids: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components among ids (rep, comp) that can reach the similarity: an exact filter.

    Shingles are ordered from rare to common. Sets that reach the similarity share a shingle in their
    prefixes, and the places of their first common shingle bound the intersection (prefix and position
    filters). A heavily edited copy has its own rare shingles first, so it meets few of its large group.
    """
    run, schema = _setter(n)
    sets = _texts(docs, ids.select(F.col("rep").alias("id"))).mapInArrow(run, schema)
    each = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("t"))
    shared = each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    each = each.join(shared, "t")
    own = Window.partitionBy("id")
    each = each.withColumn("k", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("df", "t")))
    each = each.withColumn("pos", F.col("n") - F.col("k") + F.col("r"))
    each = each.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    each = checkpointed(each.join(ids, each.id == ids.rep).select("t", "id", "n", "pos", "comp"))
    x, y = each.toDF("t", "a", "na", "pa", "ca"), each.toDF("t", "b", "nb", "pb", "cb")
    most = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    can = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))
    return x.join(y, (x.t == y.t) & (F.col("ca") != F.col("cb")) & (F.col("b") < F.col("a")) & can).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links at 100 * intersection >= percent * union.

    At a similarity of 0.8 a pair shares none of the 48 bands of 6 with a chance of 5e-7.
    """
    docs = id_and_text(docs)
    of_text = F.xxhash64("text")
    torn = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min(of_text).alias("lo"), F.max(of_text).alias("hi")).where("lo <> hi")
    torn = checkpointed(torn.select("id", "lo"))
    if torn.isEmpty():
        return _grouped(docs, shingle, percent, bands, rows)
    found = _grouped(docs.join(torn, docs.doc_id == torn.id, "left").where("lo IS NULL OR lo = xxhash64(text)").select("doc_id", "text"), shingle, percent, bands, rows)
    found = checkpointed(found)
    one = found.join(torn, found.doc_id == torn.id, "left_semi").dropDuplicates(["doc_id"])
    whole = found.join(torn, found.doc_id == torn.id, "left_anti")
    return whole.union(docs.select("doc_id").join(one, "doc_id").select(*whole.columns))


def _grouped(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """near_duplicates of (doc_id, text) where rows of one id have one text."""
    run, schema = _sketcher(shingle, bands, rows)
    sk = checkpointed(docs.mapInArrow(run, schema))
    same = sk.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    same = checkpointed(same)
    banded = same.select("rep", F.explode("bands").alias("key"))
    centres = checkpointed(banded.groupBy("key").agg(F.min("rep").alias("c"), F.count("*").alias("n")).where("n > 1"))
    #: Keys of more than HOT members meet them by broadcast, if they are few enough, so that none of them lands in one task.
    hot, cold = centres.where(F.col("n") > HOT), centres.where(F.col("n") <= HOT)
    split = 0 < hot.count() <= BROADCAST_IDS
    if split:
        rest = banded.join(F.broadcast(hot.select("key")), "key", "left_anti")
        members = banded.join(F.broadcast(hot), "key").unionByName(rest.join(cold, "key"))
    else:
        members = banded.join(centres, "key")
    members = checkpointed(members)
    tested = members.where("rep <> c").select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct()
    links = checkpointed(_confirmed(tested, docs, shingle, percent))
    #: The second pass: links between different components of a bucket, which the stars need not show.
    comp = components(links)
    wide = members.where("n > 2").join(comp, members.rep == comp.id, "left").select("key", "n", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = wide.groupBy("key", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "n")
    if split:
        few, many = F.col("n") <= HOT, F.col("n") > HOT
        open_rows = wide.where(few).join(mixed.where(few).select("key"), "key", "left_semi").unionByName(wide.where(many).join(F.broadcast(mixed.where(many).select("key")), "key", "left_semi"))
    else:
        open_rows = wide.join(mixed.select("key"), "key", "left_semi")
    open_ids = checkpointed(open_rows.select("rep", "comp").distinct())
    more = checkpointed(_confirmed(_prefix_pairs(open_ids, docs, shingle, percent), docs, shingle, percent))
    comp = components(links.union(more))
    classes = same.join(comp, same.rep == comp.id, "left").select("h1", "h2", F.col("n_shingles").alias("n_set"), F.coalesce("component", "rep").alias("class_id"))
    cond = (sk.h1 == classes.h1) & (sk.h2 == classes.h2) & (sk.n_shingles == classes.n_set)
    out = sk.join(classes, cond, "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
