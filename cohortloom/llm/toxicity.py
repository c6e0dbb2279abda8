"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding maps case, diacritics, homoglyphs and digit substitutions to plain letters, and everything else
to a space. The lexicon is learned from labelled rows outside the held-out fold: whole words, word
beginnings of `SHORTEST` to `LONGEST` letters, and families, by the smoothed log ratio of their
frequencies in toxic and other texts. A family is a beginning that counts only where at least `SEVERAL`
different words of the text have it, and one for each `SPARSE` words of it: that tells a text that keeps
deriving words from a slur's stem from one that has a chance word. Near copies count once (by the least word hash), and terms
are taken greedily by the toxic texts that no earlier term covers, so that a term must explain labels by
itself. A score is the logistic of the hits' weight, itself and relative to the length, calibrated on
the same rows. A hit inside an exception phrase does not count.

`fit_rows` bounds the labelled sample, taken by a hash of the id and read once; every document is scored
whole. The driver gets, of that sample only, the pure terms with the rows that hold them, and two features
of each row.

Defined results: a null or empty text scores as a text without hits; repeated rows alike; without
labels of both values the score is 0; other columns are ignored, or kept by `non_toxic`.
"""

from __future__ import annotations

import heapq
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fold_of, ship, slices

FIT_ROWS = 25_000
SHORTEST, LONGEST = 4, 7
LEAST, PURE, PURE_FAMILY = 3, 0.9, 0.8
SEVERAL, SPARSE = 2, 150
#: Look-alike characters and substitutions, and phrases that are harmless.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɩ": "i", "ℓ": "l", "ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
EXCEPTIONS = ("trash can", "trash cans", "clown fish", "pond scum", "sore loser")


class _Fold(dict):
    """str.translate table made as characters come."""

    def __missing__(self, c: int) -> str:
        ch = chr(c).lower()
        if ch in HOMOGLYPHS:
            out = HOMOGLYPHS[ch]
        elif ch in DIGITS:
            out = DIGITS[ch]
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
            out = "".join(HOMOGLYPHS.get(x, x) if x.isalpha() else DIGITS.get(x, " ") for x in plain.lower())
            if not plain:
                out = ""  # a combining mark joins the letter before it
        self[c] = out
        return out


FOLD = _Fold()


def folded(text: str) -> str:
    """Words of folded letters between single or more spaces, with one at each end."""
    if "$" in text or "@" in text:
        text = "".join(("s" if c == "$" else "a") if c in "$@" and i + 1 < len(text) and text[i + 1].isalpha() else c for i, c in enumerate(text))
    return " " + text.translate(FOLD) + " "


def family(different: int, words: int) -> bool:
    """Whether so many different words of one beginning make a family in a text of so many words."""
    return different >= SEVERAL and different * SPARSE >= words


def terms_of(text: str) -> tuple[set[str], int, int]:
    """Terms ("word " whole, "pref" a beginning, "pref*" a family), number of words, least word hash."""
    words = folded(text).split()
    kinds = set(words)
    begin = Counter(w[:k] for w in kinds for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    terms = {w + " " for w in kinds} | set(begin)
    terms |= {t + "*" for t, n in begin.items() if family(n, len(words))}
    return terms, len(words), min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in kinds), default=0)


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of labelled rows outside the held-out fold; the ids that are broadcast are about `fit_rows` at most."""
    marks = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id")) != 0)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    docs = docs.where(fold_of(F.col("doc_id")) != 0)
    if n > fit_rows:
        few = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n)
        marks, docs = marks.where(few("_id")), docs.where(few("doc_id"))
    both = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marks), F.col("doc_id") == marks._id)
    return both.select("doc_id", "text", "toxic")


class Model:
    def __init__(self, weights: dict[str, float], bias: float, on_sum: float, on_rate: float):
        self.weights, self.bias, self.on_sum, self.on_rate = weights, bias, on_sum, on_rate
        self.auto = None

    def __getstate__(self):
        return self.weights, self.bias, self.on_sum, self.on_rate

    def __setstate__(self, x):
        self.__init__(*x)

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + weight of hits), and the same for hits in 100 words; of terms that start at one word the weightiest counts."""
        if self.auto is None:
            import ahocorasick

            self.auto = ahocorasick.Automaton()
            found: dict[str, list] = {}
            for t, w in self.weights.items():
                found.setdefault(" " + t.removesuffix("*"), []).append((w, t.endswith("*")))
            for t in EXCEPTIONS:
                found.setdefault(" " + t + " ", []).append((None, False))
            for t, what in found.items():
                self.auto.add_word(t, (t, what))
            self.auto.make_automaton()
        flat = folded(text)
        words = max(1, flat.count(" ") - 1)
        best: dict[int, float] = {}
        clear: list[tuple[int, int]] = []
        kin: dict[tuple[str, float], list[int]] = {}
        for end, (t, what) in self.auto.iter(flat) if self.weights else ():
            start = end - len(t) + 1
            for w, many in what:
                if w is None:
                    clear.append((start, end))
                elif many:
                    kin.setdefault((t, w), []).append(start)
                else:
                    best[start] = max(w, best.get(start, 0.0))
        for (_, w), at in kin.items():
            if family(len({flat[s + 1 : flat.find(" ", s + 1)] for s in at}), words):
                for s in at:
                    best[s] = max(w, best.get(s, 0.0))
        if clear:
            best = {s: w for s, w in best.items() if not any(a <= s < b for a, b in clear)}
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100.0 * total / words))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.bias + self.on_sum * a + self.on_rate * b
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    ship(docs.sparkSession)
    sample = checkpointed(_sample(docs, labels, fit_rows))

    def rows(batches):
        for batch in slices(batches):
            sig, toxic, terms = [], [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                t, _, s = terms_of(text)
                sig.append(s), toxic.append(y), terms.append(sorted(t))
            yield pa.record_batch([batch.column("row"), pa.array(sig, pa.int64()), pa.array(toxic, pa.int32()), pa.array(terms, pa.list_(pa.string()))], names=["row", "sig", "toxic", "terms"])

    total = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    n_toxic, n_other = total.t, total.c
    if not n_toxic or not n_other:
        return Model({}, -40.0, 0.0, 0.0)
    #: One text for each label; near copies mostly share the least word hash.
    once = sample.groupBy(F.xxhash64("text").alias("row"), "toxic").agg(F.first("text").alias("text"))
    flat = once.mapInArrow(rows, "row long, sig long, toxic int, terms array<string>")
    each = checkpointed(flat.select("row", "toxic", "sig", F.explode("terms").alias("term")))
    often = each.groupBy("term").agg(F.sum("toxic").alias("all_t"), F.count("*").alias("n")).where((F.col("all_t") >= LEAST) & (F.col("all_t") >= F.when(F.col("term").endswith("*"), PURE_FAMILY).otherwise(PURE) * F.col("n")))
    pure = each.where("toxic = 1").join(often, "term").groupBy("term").agg(F.countDistinct("sig").alias("t"), F.first(F.col("n") - F.col("all_t")).alias("c"), F.collect_list(F.struct("row", "sig")).alias("rows")).where(F.col("t") >= LEAST).toArrow()
    table, families = {}, {}
    held: dict[int, list[str]] = {}
    for term, t, c, where in zip(*(pure.column(k).to_pylist() for k in ("term", "t", "c", "rows")), strict=True):
        table[term] = (t, c)
        for r in where:
            families[r["row"]] = r["sig"]
            held.setdefault(r["row"], []).append(term)
    held = [(families[r], held[r]) for r in sorted(held)]
    weights = _greedy(held, table, n_toxic, n_other)
    model = Model(weights, 0.0, 0.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def marks(batches):
        for batch in slices(batches):
            f = [shared.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("toxic"), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64())], names=["toxic", "a", "b"])

    x = sample.select("text", "toxic").mapInArrow(marks, "toxic int, a double, b double").toPandas()
    return Model(weights, *_logistic(x[["a", "b"]].to_numpy(), x["toxic"].to_numpy()))


def _greedy(held: list[tuple[int, list[str]]], table: dict[str, tuple[int, int]], n_toxic: int, n_other: int) -> dict[str, float]:
    """Take the term that explains most families of uncovered toxic texts, until none explains LEAST of them."""
    weight = lambda t: float(np.log((table[t][0] + 0.5) / (n_toxic + 1)) - np.log((table[t][1] + 0.5) / (n_other + 1)))
    where: dict[str, set[int]] = {}
    sig = [s for s, _ in held]
    for i, (_, terms) in enumerate(held):
        for t in terms:
            where.setdefault(t, set()).add(i)
    taken: dict[str, float] = {}
    left = set(range(len(held)))
    live = {t: len({sig[i] for i in rows}) for t, rows in where.items()}
    first_gain = max(live.values(), default=0)
    #: Gains are renewed when they come up: the largest that is still true wins; ties go to the longer, then the last term.
    rank = {t: i for i, t in enumerate(sorted(live, reverse=True))}
    heap = [(-n, -len(t), rank[t], t) for t, n in live.items()]
    heapq.heapify(heap)
    while heap:
        was, size_, at, t = heapq.heappop(heap)
        gain = len({sig[i] for i in where[t] & left})
        if gain < LEAST:
            continue
        if gain < -was:
            heapq.heappush(heap, (-gain, size_, at, t))
            continue
        taken[t] = max(0.1, weight(t))
        left -= where[t]
    #: Terms as frequent as those taken are toxic words too, though others cover their texts already.
    strong = 0.25 * first_gain
    size = {t: len({sig[i] for i in rows}) for t, rows in where.items()}
    bare = lambda t: t.removesuffix("*")
    within = lambda t, k: bare(k).startswith(bare(t)) and size[k] >= 0.8 * size[t]  # noqa: E731  a beginning that is little more than one known word
    for t in sorted(where, key=lambda k: (-len(k), k)):
        known = [k for k in taken if k.endswith("*") == t.endswith("*")]
        if t not in taken and size[t] >= max(LEAST, strong) and not any(bare(t).startswith(bare(k)) or within(t, k) for k in known):
            taken[t] = max(0.1, weight(t))
    return taken


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> tuple[float, float, float]:
    """Newton steps for a logistic regression; both slopes are kept from going below 0."""
    z = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        g = z.T @ (y - p) - ridge * np.array([0, b[1], b[2]])
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(3)
        step = np.linalg.solve(h, g)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if b[1] < 0 or b[2] < 0:
        keep = 2 if b[1] < 0 else 1
        c = _single(x[:, keep - 1], y, ridge)
        return (c[0], c[1], 0.0) if keep == 1 else (c[0], 0.0, c[1])
    return float(b[0]), float(b[1]), float(b[2])


def _single(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[float, float]:
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        b = b + np.clip(np.linalg.solve(h, z.T @ (y - p) - ridge * np.array([0, b[1]])), -2, 2)
    return float(b[0]), float(max(0.0, b[1]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            s = [shared.value.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    return predict(docs, fit(docs, labels, fit_rows))


def non_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that do not score as toxic."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            keep = [shared.value.score(t or "") < 0.5 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
