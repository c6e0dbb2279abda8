"""Language identification by multilingual mixture inference.

Each language has a distribution over hashed byte trigrams of words, learned from a bounded sample of
the labelled rows outside the held-out fold. A document is a mixture: expectation-maximisation over
its words estimates the proportion of each language. The language set starts with the leading language
and takes the next ones in the order of their proportions for as long as the penalised likelihood rises;
the set's largest member is predicted. A document whose words, each at its own best language, could not
pay for a second language keeps one without a search (an exact bound). The score is the predicted
language's proportion, among all languages if the set has one, else within the set.

Words of any length count: a word's likelihoods are compared relative to its best language, and only
the ratio is floored, at exp(`FLOOR`), so that no language is impossible.

`fit_rows` bounds the sample (rows are taken by a hash of the id; a table with fewer training rows
gives all of them); every document is scored on its whole text.

Defined results: a null text or one without a letter is `und` with score 0; rows with a null lang are
not learned from; without any training row all are `und`; repeated rows are scored alike; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, ship
from .text import ALNUM, LOWER, blocks

BUCKETS = 1 << 16
FIT_ROWS = 6000
ROUNDS, PENALTY, FLOOR = 8, 4.0, -60.0
LETTER = re.compile(r"[^\W\d_]")


def trigrams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each byte trigram within words (with one blank at each end), first trigram of each word, words up to each text."""
    data = LOWER[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n\n", np.uint8)]
    ends = np.cumsum([len(x) + 1 for x in raw]) + 1
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    data = np.where(after_c3 & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + 32, data).astype(np.uint8)
    inside = ALNUM[data]
    data = np.where(inside, data, 32).astype(np.uint32)
    gram = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    keep = inside[1:-1]
    bucket = (gram[keep] >> np.uint32(16)).astype(np.int64)
    start = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0) == 1)
    upto = np.searchsorted(start, ends)
    before = np.cumsum(inside)
    return bucket, before[start] - 1, upto


def _counts(batches):
    for batch in batches:
        for lang in sorted(set(batch.column("lang").to_pylist())):
            texts = [t for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if x == lang]
            total = np.zeros(BUCKETS, np.int64)
            for _, raw in blocks(texts):
                total += np.bincount(trigrams(raw)[0], minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (buckets x languages), from rows outside the held-out fold."""
    ship(docs.sparkSession)
    train = docs.where((fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    n = train.select("doc_id").count()
    if n > fit_rows:
        train = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))
    rows = train.select("lang", "text").mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(langs)), 0.1)
    at = {x: i for i, x in enumerate(langs)}
    cols = np.array([at[x] for x in rows.column("lang").to_pylist()], np.int64)
    np.add.at(table, (rows.column("bucket").to_numpy().astype(np.int64), cols), rows.column("n").to_numpy())
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def mixture(word_ll: np.ndarray, first: np.ndarray, size: np.ndarray, allowed: np.ndarray | None = None, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) and log likelihood of each document, for words of documents that all have some."""
    top = word_ll.max(1, keepdims=True)
    lik = np.exp(np.maximum(word_ll - top, FLOOR)).astype(np.float32)
    k = word_ll.shape[1]
    p = np.full((len(size), k), 1.0 / k, np.float32) if allowed is None else (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
    for _ in range(rounds):
        r = np.repeat(p, size, 0) * lik
        total = np.maximum(r.sum(1, keepdims=True), np.float32(1e-37))
        p = np.add.reduceat(r / total, first, 0) / size[:, None]
    total = np.maximum((np.repeat(p, size, 0) * lik).sum(1), np.float32(1e-37))
    ll = np.add.reduceat(np.log(total, dtype=np.float64) + top[:, 0], first)
    return p, ll


def language_sets(word_ll: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the languages by proportion, how many of them are in the set, proportions) of documents that all have words."""
    p, _ = mixture(word_ll, first, size)
    order = np.argsort(-p, 1, kind="stable")
    fee = PENALTY * np.log(size + 1)
    own = word_ll[np.arange(len(word_ll)), np.repeat(order[:, 0], size)]
    value = np.add.reduceat(own, first) - fee
    chosen, best = np.ones(len(size), np.int64), p
    rising = np.flatnonzero(np.add.reduceat(word_ll.max(1), first) - 2 * fee > value)
    for k in range(2, word_ll.shape[1] + 1):
        if not len(rising):
            break
        n = size[rising]
        start = np.cumsum(n) - n
        words = np.repeat(first[rising] - start, n) + np.arange(n.sum())
        allowed = np.zeros((len(rising), word_ll.shape[1]))
        np.put_along_axis(allowed, order[rising, :k], 1, 1)
        q, ll = mixture(word_ll[words], start, n, allowed)
        up = ll - k * fee[rising] > value[rising]
        rising, q, ll = rising[up], q[up], ll[up]
        value[rising], best[rising], chosen[rising] = ll - k * fee[rising], q, k
    return order, chosen, best


def identify(texts: list[str | None], langs: list[str], table: np.ndarray) -> list[tuple[str, float, str]]:
    """(language, its proportion, the chosen set as "en+fr") of each text."""
    out = [("und", 0.0, "")] * len(texts)
    if not langs:
        return out
    use = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    for base, raw in blocks([texts[i] for i in use], 2 << 20):
        bucket, first, upto = trigrams(raw)
        size = np.diff(upto, prepend=0)
        full = np.flatnonzero(size)
        if not len(full):
            continue
        word_ll = np.add.reduceat(table[bucket], first, 0, dtype=np.float64)
        order, chosen, best = language_sets(word_ll, (upto - size)[full], size[full])
        for row, f in enumerate(full):
            lead = int(np.argmax(best[row]))
            members = [langs[j] for j in order[row, : chosen[row]]]
            out[use[base + int(f)]] = (langs[lead], float(min(1.0, max(0.0, best[row, lead]))), "+".join(sorted(members)))
    return out


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_set for every row."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches):
        langs, table = model.value
        for batch in batches:
            found = identify(batch.column("text").to_pylist(), langs, table)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "lang_set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, lang_set string")


def languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return predict(docs, *fit(docs, fit_rows))
