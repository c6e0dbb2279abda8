"""Quality classifier from weak labels.

Overlapping heuristic labellers fire or abstain on each document. Expectation-maximisation over the
counts of vote patterns (at most 2^11 rows, whatever the corpus) estimates how often each
labeller fires in either class, and the class prior; posteriors of the patterns are the labels
of a hashed linear scorer over word shapes, their pairs, repetition and words, trained on a bounded sample of
documents (about `fit_rows`, twice that at most where rows repeat, of at most WIDTH entries each) and applied to all. True labels are never read.

Defined results: on a text of fewer than five words all abstain; null and empty texts are scored by their
features like any other; a null doc_id stays null; repeated rows are scored alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices

FIT_ROWS, WIDTH = 6_000, 1 << 14
_UPPER, _LETTER, _DIGIT, _MARK = (np.zeros(256, np.int64) for _ in range(4))
_UPPER[65:91] = 1
_LETTER[[*range(65, 91), *range(97, 123)]] = 1
_DIGIT[48:58] = 1
_MARK[[ord(c) for c in "#$%&*@^~<>{}[]\\|_=+!"]] = 1


def measures(text: str) -> dict[str, float]:
    """What the labellers look at: rates over the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    n = len(words)
    size = max(1, len(raw))
    letters = int((h * _LETTER).sum())
    same = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    return {
        "words": n, "mark": float((h * _MARK).sum()) / max(1, n), "upper": float((h * _UPPER).sum()) / max(1, letters), "same": same / max(1, n), "kinds": len(set(words)) / max(1, n), "length": len(text) / max(1, n),
        "digit": float((h * _DIGIT).sum()) / size, "stop": float(h[46] + h[33] + h[63]) / max(1, n), "pipe": float(h[124]) / max(1, n), "lines": 1 - len(set(lines)) / max(1, len(lines)), "marked": sum(not w[-1].isalnum() and not w[-2].isalnum() for w in words if len(w) > 2) / max(1, n),
        "shout": sum(map(str.isupper, words)) / max(1, n), "lone": sum(len(w) == 1 and not w.isalnum() for w in words) / max(1, n),
    }


#: (name, measure, fires at, when small). Each fires for bad; they overlap in pairs. "plain" fires for good.
LABELLERS = (
    ("marks", "mark", 0.35, False),
    ("marked_words", "marked", 0.25, False),
    ("capitals", "upper", 0.45, False),
    ("shouted_words", "shout", 0.3, False),
    ("stutter", "same", 0.15, False),
    ("few_kinds", "kinds", 0.15, True),
    ("digits", "digit", 0.35, False),
    ("table", "pipe", 0.1, False),
    ("lone_marks", "lone", 0.1, False),
    ("same_lines", "lines", 0.7, False),
)
PLAIN = {"mark": 0.1, "marked": 0.08, "upper": 0.2, "shout": 0.1, "same": 0.04, "pipe": 0.02, "lone": 0.03, "lines": 0.6, "digit": 0.3}
GOOD = len(LABELLERS)
NAMES = (*[x[0] for x in LABELLERS], "plain")


def votes(m: dict[str, float]) -> list[int]:
    """1 where a labeller fires, 0 where it abstains."""
    if m["words"] < 5:
        return [0] * (GOOD + 1)
    out = [int(m[key] <= at if small else m[key] >= at) for _, key, at, small in LABELLERS]
    return [*out, int(all(m[k] <= v for k, v in PLAIN.items()))]


_RUN = re.compile(r"([^ \n])\1+")


class _Classes(dict):
    """Code point -> class: A and a for letters, 0 for digits, white space kept, * for every other character."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "\n" if c == "\n" else " " if c.isspace() else "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "*"
        return out


_CLASSES = _Classes()


def _grade(kind: str, n: int, of: int) -> str:
    """A feature's name with its share of `of` in half octaves."""
    return f"{kind}:{int(np.floor(2 * np.log2(n / of)))}"


def hashed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the hashed features, none of them a labeller's measure.

    Single shapes of words and pairs of neighbouring ones (runs of capitals, small letters, digits and marks, one
    character each) and how often each word and line comes back, all graded by their share; lower-cased words by presence.
    """
    words = text.split()
    shapes = _RUN.sub(r"\1", text.translate(_CLASSES)).split()
    grams = Counter(shapes)
    grams.update(zip(shapes, shapes[1:]))  # noqa: B905
    grams.update(("=",) for a, b in zip(words, words[1:]) if a == b)  # noqa: B905
    out = {_grade(f"s{g}", n, len(shapes)) for g, n in grams.items() if n * 200 >= len(shapes)}
    lines = text.split("\n")
    for kind, items in (("w", words), ("l", lines)):
        again = Counter(Counter(items).values())
        out |= {_grade(f"{kind}{int(np.log2(n))}", n * k, len(items)) for n, k in again.items() if n * k * 20 >= len(items)}
    kinds = {w.lower() for w in words}
    at = [zlib.crc32(x.encode()) % WIDTH for x in out] + [zlib.crc32(w.encode("utf-8", "surrogatepass")) % WIDTH for w in kinds]
    value = np.concatenate([np.ones(len(out)), np.full(len(kinds), 1 / max(1, len(kinds)))])
    at, where = np.unique(np.array(at, np.int32), return_inverse=True)
    return at, np.bincount(where, value, len(at)).astype(np.float32)


def accuracies(patterns: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior of good, chance that each labeller fires given bad and given good, the patterns' posteriors of good).

    patterns: 0 or 1 for each labeller, the last one firing for good; n: how many documents have each. It
    starts from labellers that seldom fire wrongly and each see a part of the bad documents.
    """
    k = patterns.shape[1]
    fire = np.tile([0.3, 0.01], (k, 1))
    fire[GOOD] = [0.05, 0.7]
    start, weight, prior = fire.copy(), 20.0, 0.85
    for _ in range(rounds):
        post = _posterior(patterns, prior, fire)
        w = np.stack([(1 - post) * n, post * n], 1)
        prior = float(np.clip((w[:, 1].sum() + 8.5) / (n.sum() + 10), 0.02, 0.98))
        new = np.clip((patterns.T @ w + weight * start) / (w.sum(0) + weight), 1e-4, 1 - 1e-4)
        moved, fire = np.abs(new - fire).max(), new
        if moved < 1e-8:
            break
    return prior, fire, _posterior(patterns, prior, fire)


def _posterior(patterns: np.ndarray, prior: float, fire: np.ndarray) -> np.ndarray:
    on, off = np.log(fire[:, 1] / fire[:, 0]), np.log((1 - fire[:, 1]) / (1 - fire[:, 0]))
    z = np.log(prior / (1 - prior)) + patterns @ on + (1 - patterns) @ off
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _voted(batches):
    for batch in slices(batches):
        out = []
        for text in batch.column("text").to_pylist():
            out.append("".join(map(str, votes(measures(text or "")))))
        yield pa.record_batch([pa.array(out, pa.string())], names=["pattern"])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float, dict]:
    """Weights of the hashed features, bias, and the labellers' estimated accuracies."""
    ship(docs.sparkSession)
    n = docs.select("doc_id").count()
    rows = docs.select("text").mapInArrow(_voted, "pattern string").groupBy("pattern").count().collect()
    if not rows:
        return np.zeros(WIDTH), 0.0, {}
    patterns = np.array([[int(c) for c in r.pattern] for r in rows])
    prior, table, post = accuracies(patterns, np.array([r["count"] for r in rows], float))
    target = {r.pattern: float(p) for r, p in zip(rows, post, strict=True)}
    sample = docs if n <= fit_rows else docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / n))

    def features(batches):
        for batch in slices(batches):
            at, value, y = [], [], []
            for text in batch.column("text").to_pylist():
                i, v = hashed(text or "")
                at.append(i)
                value.append(v)
                y.append(target.get("".join(map(str, votes(measures(text or "")))), prior))
            yield pa.record_batch([pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(y, pa.float64())], names=["at", "value", "y"])

    got = sample.select("text").mapInArrow(features, "at array<int>, value array<float>, y double").limit(2 * fit_rows).toArrow().combine_chunks()
    sizes = pc.list_value_length(got.column("at")).to_numpy()
    w, bias = _linear(sizes, pc.list_flatten(got.column("at")).to_numpy(), pc.list_flatten(got.column("value")).to_numpy(), got.column("y").to_numpy())
    return w, bias, {"prior": prior, **{name: (float(table[j, 0]), float(table[j, 1])) for j, name in enumerate(NAMES)}}


def _linear(sizes: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on the soft labels, full-batch Adam with a ridge; rows one after another, `sizes` entries each."""
    if not len(sizes):
        return np.zeros(WIDTH), 0.0
    row, k = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
    w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col] * value, k) + w[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        g = np.append(np.bincount(col, e[row] * value, WIDTH), e.sum()) / k
        g[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def predict(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score (0 to 1, higher is better), kept for every row."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        w, b = model.value
        for batch in slices(batches):
            z = np.array([b + w[at] @ value for at, value in (hashed(t or "") for t in batch.column("text").to_pylist())])
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array(s >= 0.5, pa.bool_())], names=["doc_id", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, kept boolean")


def quality(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    w, bias, _ = fit(docs, fit_rows)
    return predict(docs, w, bias)
