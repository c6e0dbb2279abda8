"""Document fingerprints by a randomised edit embedding.

All texts share one random walk: at step j the embedding emits the current character and moves on by
one or stays, as a random bit for (j, character) says. Texts at a small edit distance fall into step
again after each edit, so edit distance becomes Hamming distance. A fingerprint samples the embedding
at fixed steps: `PER_OCTAVE` in each doubling of the step, so that texts of all lengths share their
samples; each sample is one hex digit of the character's hash. Likeness is the share of equal samples,
each weighted by the length that it stands for. Near texts are found by banding samples drawn by weight
(two prints that share the key of a band are candidates) and verified on the whole fingerprint:
`fingerprinted` does so for each text and its edited text and its successor, `near_groups` for all documents.

The walk of many texts runs in step (numpy), whole texts always.

Defined results: null texts are empty; the empty text has an empty fingerprint, alike only to itself;
rows are ordered by descending doc_id, then text (null ids last); a lone row follows itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, id_and_text, slices
from .text import mix

PER_OCTAVE, FIRST_OCTAVE, OCTAVES = 32, 5, 40
PERIOD = 1 << 12


def _shared() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The walk's bits (period x 256), the sampled steps in order, and the weight of each sample."""
    rng = np.random.Generator(np.random.PCG64(20240607))
    bits = rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    steps, weight = [np.arange(1 << FIRST_OCTAVE)], [np.ones(1 << FIRST_OCTAVE)]
    for k in range(FIRST_OCTAVE, OCTAVES):
        n = min(PER_OCTAVE, 1 << k)
        width = (1 << k) / n
        at = (1 << k) + ((np.arange(n) + rng.random(n)) * width).astype(np.int64)
        steps.append(at), weight.append(np.full(n, width))
    return bits, np.concatenate(steps), np.concatenate(weight)


BITS, STEPS, WEIGHTS = _shared()
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def characters(text: str) -> np.ndarray:
    """Each code point as a byte: itself in ASCII, else a hash in 128..255."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) == len(text):
        return np.frombuffer(raw, np.uint8)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < 128, c, 128 + (((c * np.uint32(0x9E3779B1)) & np.uint32(0xFFFFFFFF)) >> np.uint32(25))).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text; all walks advance together, the shorter ones ending first."""
    chars = [characters(t) for t in texts]
    size = np.array([len(c) for c in chars], np.int64)
    flat = np.concatenate([*chars, np.zeros(1, np.uint8)])
    end = np.cumsum(size)
    live = np.flatnonzero(size)
    at, stop = (end - size)[live], end[live]
    out: list[list[np.ndarray]] = []
    owners: list[np.ndarray] = []
    step, sample = 0, 0
    nibble = HEX[(np.arange(256, dtype=np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(28)) & np.uint32(15)]
    while len(live):
        here = flat[at]
        if step == STEPS[sample]:
            owners.append(live)
            out.append(nibble[here])
            sample += 1
            while STEPS[sample] == step:
                sample += 1
        at += BITS[step & (PERIOD - 1)][here]
        step += 1
        if step & 7 == 0 or len(live) < 64 or step == STEPS[sample]:
            going = at < stop
            if not going.all():
                live, at, stop = live[going], at[going], stop[going]
        else:
            np.minimum(at, stop, out=at)  # an ended walk waits behind its text for the next look
    if not owners:
        return [""] * len(texts)
    who, what = np.concatenate(owners), np.concatenate(out)
    order = np.argsort(who, kind="stable")
    joined, upto = what[order].tobytes().decode(), np.cumsum(np.bincount(who, minlength=len(texts)))
    return [joined[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]


def likeness(a: str, b: str) -> float:
    """Weighted share of equal samples; 1 for equal fingerprints, the longer one's rest counts as unequal."""
    if a == b:
        return 1.0
    k, n = min(len(a), len(b)), max(len(a), len(b))
    x, y = np.frombuffer(a[:k].encode(), np.uint8), np.frombuffer(b[:k].encode(), np.uint8)
    return float(WEIGHTS[:k][x == y].sum() / WEIGHTS[:n].sum())


def edited(text: str, following: str) -> str:
    """The text, its last third (rounded down) replaced by as many first code points of the following one, or all."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


CHUNK = 16_000_000


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (b, carry, doc_id, text) in order: each row's successor is the next row of its bucket; carried rows only follow."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "found_edited", "found_next"]

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        """All rows but the last get a successor within the same bucket."""
        pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
        if not pairs:
            return None
        new = [edited(x[3], y[3]) for x, y in pairs]
        texts = [r[3] for r in rows]
        prints = fingerprints(texts + new)
        own = dict(zip(map(id, rows), prints, strict=False))
        mine, mine_new = [own[id(x)] for x, _ in pairs], prints[len(rows) :]
        following = [own[id(y)] for _, y in pairs]
        near_new, near_next = [likeness(a, b) for a, b in zip(mine, mine_new, strict=True)], [likeness(a, b) for a, b in zip(mine, following, strict=True)]
        #: The likeness of these pairs is wanted anyway, so bands are made only for those that verification passes.
        found = [[y >= LEAST and _candidates(a, b) for a, b, y in zip(mine, other, near, strict=True)] for other, near in ((mine_new, near_new), (following, near_next))]
        cols = [
            pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
            pa.array(mine), pa.array(mine_new), pa.array(near_new, pa.float64()), pa.array(near_next, pa.float64()), *(pa.array(x, pa.bool_()) for x in found),
        ]
        return pa.record_batch(cols, names=names)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("b", "carry", "doc_id", "text")), strict=True):
            held.append(row)
            size += len(row[3])
            if size > CHUNK and len(held) > 1:
                if (out := flush(held)) is not None:
                    yield out
                held = held[-1:]
                size = len(held[0][3])
    if (out := flush(held)) is not None:
        yield out


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, found_edited boolean, found_next boolean"
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 100_000


def fingerprinted(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, found_edited, found_next for every row.

    found_*: banding makes the pair a candidate and verification finds it alike by `LEAST` or more.
    The order is by ranges of ids, one for each `BUCKET_BYTES` of text: their bounds come from approximate quantiles
    of the ids, and the first row of each range is also sent, once, to the range before it. Each text is shuffled
    once. All rows of one id are in one range, which one task reads as a stream.
    """
    docs = id_and_text(docs)
    spark = docs.sparkSession
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    n = buckets
    if n is None:
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
        n = min(MOST_BUCKETS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES)))
    cut = docs.select(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("q")).first().q
    cut = sorted(set(cut or []), reverse=True)
    #: Bucket 0 holds the largest ids: a row's bucket is the number of (descending) bounds over its id.
    shared = docs.withColumn("k", key)
    shared = shared.withColumn("b", _above(F.col("k"), cut))
    heads = {r.b: r.k for r in shared.groupBy("b").agg(F.max("k").alias("k")).collect()}
    order = sorted(heads)
    #: By bucket: its largest id, and the bucket before it that has rows (the last one for the first).
    head, back = [None] * (len(cut) + 1), [None] * (len(cut) + 1)
    for i, b in enumerate(order):
        head[b], back[b] = heads[b], order[i - 1]
    at = F.col("b") + 1
    pick = F.when(F.element_at(F.lit(head).cast("array<long>"), at) == F.col("k"), F.element_at(F.lit(back).cast("array<int>"), at))
    sent = shared.withColumn("to", F.array(F.struct("b", F.lit(False).alias("carry")), F.struct(pick.alias("b"), F.lit(True).alias("carry"))))
    sent = sent.select("doc_id", "text", "k", F.explode(F.filter("to", lambda x: x.b.isNotNull())).alias("to")).select(F.col("to.b").alias("b"), F.col("to.carry").alias("carry"), "doc_id", "text", "k")
    dealt = sent.repartition(n, "b").sortWithinPartitions("b", "carry", F.desc("k"), "text")
    return dealt.select("b", "carry", "doc_id", "text").mapInArrow(_walks, RESULT)


def _above(k: Column, cut: list[int]) -> Column:
    """How many of the descending bounds exceed k: a binary search in a constant array."""
    if not cut:
        return F.lit(0)
    bounds, steps = F.lit(cut).cast("array<long>"), F.lit([1 << i for i in range(len(cut).bit_length() - 1, -1, -1)]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(cut)) & (F.get(bounds, at + s - 1) > k), at + s).otherwise(at))


LEAST, BAND = 0.8, 8
STRIDE, MISS = 1.1, 1e-5
TOTAL = np.cumsum(WEIGHTS)


def _lengths() -> np.ndarray:
    """Print lengths at which bands are drawn: each the longest of at most STRIDE times the weight before it, or the next one."""
    out = [1]
    while out[-1] < len(TOTAL):
        out.append(max(out[-1] + 1, int(np.searchsorted(TOTAL, STRIDE * TOTAL[out[-1] - 1], "right"))))
    return np.array(out[:-1])


LENGTHS = _lengths()


def bands_of(least: float, band: int) -> int:
    """How many bands miss a pair of that likeness with a chance of at most MISS, wherever its unequal samples are."""
    share = 1 - STRIDE * (1 - least)
    if share <= 0:
        raise ValueError(f"a likeness of {least} is too small for bands")
    return 1 if share >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-(share**band))))


@lru_cache(maxsize=512)
def _drawn(level: int, bands: int, band: int) -> np.ndarray:
    """The samples of each band, drawn by weight from the first LENGTHS[level] samples."""
    n = LENGTHS[level]
    return np.random.Generator(np.random.PCG64([20240607, level])).choice(n, (bands, band), p=WEIGHTS[:n] / TOTAL[n - 1])


def band_keys(p: str, least: float, band: int) -> np.ndarray:
    """The bucket keys of a fingerprint: all bands at each length that a print alike by `least` can have as its own last one."""
    if not p:
        return np.empty(0, np.int64)
    raw, bands = np.frombuffer(p.encode(), np.uint8), bands_of(least, band)
    fits = np.flatnonzero((LENGTHS <= len(p)) & (TOTAL[LENGTHS - 1] * (STRIDE + 1e-9) >= least * TOTAL[len(p) - 1]))
    out = []
    for level in fits.tolist():
        key = mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(level << 32))
        for column in raw[_drawn(level, bands, band)].T:
            key = mix(key * np.uint64(0x9DDFEA08EB382D69) + column)
        out.append(key.view(np.int64))
    return np.concatenate(out)


def _candidates(a: str, b: str) -> bool:
    """Whether banding makes a pair of two prints: they are equal or share a bucket."""
    return a == b or bool(len(np.intersect1d(band_keys(a, LEAST, BAND), band_keys(b, LEAST, BAND))))


def near_groups(docs: DataFrame, least: float = LEAST, band: int = BAND) -> DataFrame:
    """(doc_id, component_id): documents whose fingerprints are alike by at least `least`, by banded samples and verification.

    Bands of `band` samples are buckets. They are drawn by weight from the print's first samples, at lengths that
    grow by a tenth, as many as miss a pair at `least` with a chance of at most 1e-5, short prints like long ones.
    Each member is verified against the bucket's smallest id; then all pairs of a bucket whose members are still in
    different components (n unlike texts of one bucket so cost up to n * n / 2 verifications). Texts of null id link only to those of equal fingerprint.
    """
    docs = id_and_text(docs)

    def run(batches):
        for batch in slices(batches):
            p = fingerprints(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(p, pa.string())], names=["doc_id", "p"])

    def deal(batches):
        for batch in slices(batches):
            keys = [band_keys(p, least, band) for p in batch.column("p").to_pylist()]
            yield pa.record_batch([batch.column("rep"), pa.array(keys, pa.list_(pa.int64()))], names=["rep", "keys"])

    def verify(batches):
        for batch in batches:
            keep = [likeness(x, y) >= least for x, y in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    prints = checkpointed(docs.mapInArrow(run, "doc_id long, p string").groupBy("p").agg(F.min("doc_id").alias("rep")))

    def verified(pairs):
        both = pairs.join(prints.select(F.col("rep").alias("a"), F.col("p").alias("pa")), "a").join(prints.select(F.col("rep").alias("b"), F.col("p").alias("pb")), "b")
        return checkpointed(both.select("a", "b", "pa", "pb").mapInArrow(verify, "a long, b long"))

    banded = prints.where("p <> '' AND rep IS NOT NULL").mapInArrow(deal, "rep long, keys array<long>").select("rep", F.explode("keys").alias("key"))
    centres = banded.groupBy("key").agg(F.min("rep").alias("c"), F.count("*").alias("n")).where("n > 1")
    members = checkpointed(banded.join(centres, "key"))
    links = verified(members.where("rep <> c").select(F.col("rep").alias("a"), F.col("c").alias("b")).distinct())
    #: The second pass: pairs in different components of a bucket, which its star need not show.
    comp = components(links)
    wide = members.where("n > 2").join(comp, members.rep == comp.id, "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = wide.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    unlinked = checkpointed(wide.join(mixed, "key", "left_semi"))
    x, y = unlinked.toDF("key", "a", "ca"), unlinked.toDF("key_b", "b", "cb")
    more = verified(x.join(y, (x.key == y.key_b) & (F.col("b") < F.col("a")) & (F.col("ca") != F.col("cb"))).select("a", "b").distinct())
    comp = components(links.union(more))
    classes = prints.join(comp, prints.rep == comp.id, "left").select("p", F.coalesce("component", "rep").alias("component_id"))
    again = docs.mapInArrow(run, "doc_id long, p string")
    return again.join(classes, "p").select("doc_id", "component_id")
