"""Row-wise and whole-column preparation. Bounds, levels and column tests are single aggregations."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _need(df: DataFrame, cols: Sequence[str]) -> None:
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")


def replace_missing(df: DataFrame, cols: Sequence[str], value: float) -> DataFrame:
    """Nulls and NaNs of the columns become the value."""
    _need(df, cols)
    if value is None or value != value:
        raise ValueError("the value is missing itself")
    kinds = dict(df.dtypes)
    fill = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(float(value))) if kinds[c] in ("double", "float") else F.col(c), F.lit(value))
    return df.withColumns({c: fill(c) for c in cols})


def truncation_fill(df: DataFrame, start: str | None, end: str | None) -> tuple[DataFrame, str, str]:
    """A missing start is min(end) - 1 for all rows, a missing end max(start) + 1; the names of both columns come back."""
    if start is None and end is None or start == end:
        raise ValueError("one of two different interval columns is needed")
    if start is None:
        _need(df, [end])
        return df.withColumn("right_trunc", F.lit(df.agg(F.min(end)).first()[0] - 1)), "right_trunc", end
    if end is None:
        _need(df, [start])
        return df.withColumn("left_trunc", F.lit(df.agg(F.max(start)).first()[0] + 1)), start, "left_trunc"
    _need(df, [start, end])
    return df, start, end


def levels(df: DataFrame, col: str, most: int = 10_000) -> list:
    """Sorted distinct values without nulls; a column of more than `most` is not a factor."""
    _need(df, [col])
    got = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{col} has over {most} levels")
    return sorted(got)


def factorize(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One 0/1 column `col_level` for each level; with several inputs, copies of one column are dropped."""
    new = {f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1).otherwise(0) for c in cols for v in levels(df, c)}
    out = df.withColumns(new)
    names = list(new)
    if len(cols) > 1:
        names = distinct_columns(out, names)
        out = out.drop(*[n for n in new if n not in names])
    return out, names


def distinct_columns(df: DataFrame, cols: Sequence[str], terms: Sequence[int] | None = None) -> list[str]:
    """Columns of one term that equal an earlier one go, as do columns of zeros and, beside others, constants: one aggregation."""
    terms = terms or [0] * len(cols)
    pairs = [(a, b) for (a, ta), (b, tb) in itertools.combinations(zip(cols, terms, strict=True), 2) if ta == tb]
    same = [F.min((F.col(a).eqNullSafe(F.col(b))).cast("int")).alias(f"s{i}") for i, (a, b) in enumerate(pairs)]
    bounds = [f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]
    r = df.agg(*same, *bounds).first()
    gone = {b for i, (_, b) in enumerate(pairs) if r[f"s{i}"] == 1}
    constant = {c: r[f"lo{i}"] for i, c in enumerate(cols) if r[f"lo{i}"] == r[f"hi{i}"]}
    kept = [c for c in cols if c not in gone]
    out = [c for c in kept if c not in constant]
    if not out and len(cols) == 1 and constant.get(cols[0]):
        return list(cols)
    return out


def interactions(df: DataFrame, specs: Sequence[str], names: Sequence[str | None] | None = None) -> tuple[DataFrame, list[str]]:
    """Specs "a?*?b" or "a?+?b"; repeats and reversals are skipped; default name `a*b`."""
    names = names or [None] * len(specs)
    new: dict[str, Column] = {}
    seen = set()
    for spec, name in zip(specs, names, strict=True):
        a, op, b = spec.split("?")
        if op not in "*+":
            raise ValueError(f"unknown operation {op}")
        _need(df, [a, b])
        if (op, frozenset((a, b))) in seen:
            continue
        seen.add((op, frozenset((a, b))))
        new[name or f"{a}{op}{b}"] = F.col(a) * F.col(b) if op == "*" else F.col(a) + F.col(b)
    return df.withColumns(new), list(new)


def formula_interaction(df: DataFrame, parts: Sequence[Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """a*b*c: every non-empty subset; each part is the columns it stands for; constant products go."""
    new: dict[str, Column] = {}
    for k in range(1, len(parts) + 1):
        for chosen in itertools.combinations(parts, k):
            for cols in itertools.product(*chosen):
                x = F.col(cols[0])
                for c in cols[1:]:
                    x = x * F.col(c)
                new[":".join(cols)] = x
    single = [n for n in new if ":" not in n]
    made = {n: c for n, c in new.items() if ":" in n}
    out = df.withColumns(made) if made else df
    return out, [*single, *[n for n in distinct_columns(out, list(made)) if n in made]] if made else single


def power(df: DataFrame, col: str, n: float) -> DataFrame:
    return df.withColumn(f"{col}^{n:g}", F.pow(F.col(col), F.lit(float(n))))


def knots(df: DataFrame, col: str, count: int) -> tuple[list[float], float, float]:
    """Inner knots at equal quantiles, and the bounds."""
    r = df.agg(F.percentile(col, F.array(*[F.lit((i + 1) / (count + 1)) for i in range(count)])) if count else F.lit(None), F.min(col), F.max(col)).first()
    return list(r[0] or []), float(r[1]), float(r[2])


def b_spline(x: Column, inner: Sequence[float], low: float, high: float, degree: int = 3, intercept: bool = False) -> list[Column]:
    """B-spline basis by the Cox-de Boor recursion, as Columns; the last basis is closed at the upper bound."""
    t = [low] * (degree + 1) + list(inner) + [high] * (degree + 1)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    basis = [F.when((x >= t[i]) & ((x <= t[i + 1]) if i == last else (x < t[i + 1])), 1.0).otherwise(0.0) for i in range(len(t) - 1)]
    for d in range(1, degree + 1):
        new = []
        for i in range(len(t) - 1 - d):
            a = (x - t[i]) / (t[i + d] - t[i]) * basis[i] if t[i + d] > t[i] else F.lit(0.0)
            b = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1] if t[i + d + 1] > t[i + 1] else F.lit(0.0)
            new.append(a + b)
        basis = new
    return basis if intercept else basis[1:]


def _spline_values(t: np.ndarray, degree: int, x: float, order: int) -> np.ndarray:
    """Derivatives of the given order of all B-splines over the knots t at x, by the difference formula of their derivatives."""
    if order:
        lower = _spline_values(t, degree - 1, x, order - 1)
        n = len(t) - degree - 1
        over = lambda i: lower[i] / (t[i + degree] - t[i]) if t[i + degree] > t[i] else 0.0
        return np.array([degree * (over(i) - over(i + 1)) for i in range(n)])
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    b = np.array([float(t[i] <= x and (x < t[i + 1] or i == last and x <= t[i + 1])) for i in range(len(t) - 1)])
    for d in range(1, degree + 1):
        share = lambda a, i, j: a / (t[j] - t[i]) if t[j] > t[i] else 0.0
        b = np.array([share(x - t[i], i, i + d) * b[i] + share(t[i + d + 1] - x, i + 1, i + d + 1) * b[i + 1] for i in range(len(t) - 1 - d)])
    return b


def natural_spline(x: Column, inner: Sequence[float], low: float, high: float, intercept: bool = False) -> list[Column]:
    """Natural cubic splines: B-splines turned into the space whose second derivatives vanish at both bounds; linear beyond them.

    The turn is the orthogonal factor of the bounds' second derivatives, so the columns and their coefficients are
    those of the usual statistical packages.
    """
    t = np.array([low] * 4 + list(inner) + [high] * 4, float)
    keep = slice(0 if intercept else 1, None)
    bend = np.array([_spline_values(t, 3, b, 2) for b in (low, high)])[:, keep]
    turn = np.linalg.qr(bend.T, mode="complete")[0][:, 2:]
    basis = b_spline(x, inner, low, high, 3, True)[keep]
    edge = {b: (_spline_values(t, 3, b, 0)[keep] @ turn, _spline_values(t, 3, b, 1)[keep] @ turn) for b in (low, high)}
    out = []
    for c in range(turn.shape[1]):
        inside = sum((b * float(q) for b, q in zip(basis[1:], turn[1:, c], strict=True)), basis[0] * float(turn[0, c]))
        line = lambda b, c=c: F.lit(float(edge[b][0][c])) + (x - b) * float(edge[b][1][c])
        out.append(F.when(x < low, line(low)).when(x > high, line(high)).otherwise(inside))
    return out


def strata(cols: Sequence[str]) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])


def strata_with_events(df: DataFrame, cols: Sequence[str], event: Column) -> DataFrame:
    """Rows of the strata that have an event: a left semi join, so no stratum is listed on the driver."""
    own = df.withColumn("_strata_col", strata(cols))
    some = own.where(event).select("_strata_col").distinct()
    return own.join(some, "_strata_col", "left_semi")


def combined_strata(df: DataFrame, cols: Sequence[str], event: str) -> DataFrame:
    """`comb_strata` of the columns, without the strata whose events sum to 0."""
    own = df.withColumn("comb_strata", F.concat_ws(":", *[F.concat_ws("_", F.lit(c), F.col(c).cast("string")) for c in cols]))
    some = own.groupBy("comb_strata").agg(F.sum(event).alias("_n")).where("_n > 0").select("comb_strata")
    return own.join(some, "comb_strata", "left_semi")


def event_window(df: DataFrame, start: str, end: str, event: str) -> DataFrame:
    """Rows that meet the range of event times; the bounds are literals, so they reach the scan."""
    lo, hi = df.where(F.col(event) == 1).agg(F.min(end), F.max(end)).first()
    if lo is None:
        raise ValueError("there is no event")
    return df.where((F.col(end) >= F.lit(lo)) & (F.col(start) <= F.lit(hi)))


def event_times(df: DataFrame, end: str, event: str) -> DataFrame:
    return df.where(F.col(event) == 1).select(F.col(end).alias("t")).distinct().orderBy("t")


def normalization(df: DataFrame, cols: Sequence[str], norm: str) -> dict[str, float]:
    """Weights for each column: the largest absolute value, or the mean; 0 counts as 1."""
    if norm not in ("max", "mean"):
        raise ValueError("norm is max or mean")
    r = df.agg(*[(F.max(F.abs(F.col(c))) if norm == "max" else F.avg(c)).alias(f"w{i}") for i, c in enumerate(cols)]).first()
    return {c: float(r[f"w{i}"] or 1.0) for i, c in enumerate(cols)}


def normalized(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) / F.lit(w) for c, w in weights.items()})


def independent_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that do not depend linearly on earlier ones: one aggregation of the Gram matrix, then pivots on the driver."""
    k = len(cols)
    at = [(i, j) for i in range(k) for j in range(i, k)]
    x = [F.lit(1.0) if c == "CONST" and c not in df.columns else F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols]
    r = df.agg(*[F.sum(x[i] * x[j]).alias(f"g{n}") for n, (i, j) in enumerate(at)]).first()
    g = np.zeros((k, k))
    for n, (i, j) in enumerate(at):
        g[i, j] = g[j, i] = r[f"g{n}"] or 0.0
    scale = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1))
    g = g / np.outer(scale, scale)
    kept: list[int] = []
    for i in range(k):
        if g[i, i] > 0 and (not kept or g[i, i] - g[i, kept] @ np.linalg.solve(g[np.ix_(kept, kept)], g[kept, i]) > 1e-9):
            kept.append(i)
    return [cols[i] for i in kept]


def joint_events(df: DataFrame, events: Sequence[str], shared: Sequence[str] = (), specific: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The table once for each event: `events` holds its value, the event columns become indicators, `cov_event` is cov * indicator."""
    specific = specific or {}
    choice = F.explode(F.array(*[F.struct(F.lit(e).alias("name"), F.col(e).alias("n")) for e in events])).alias("_e")
    out = df.select(*df.columns, choice).withColumn("events", F.col("_e.n"))
    out = out.withColumns({e: F.when(F.col("_e.name") == e, 1).otherwise(0) for e in events})
    out = out.withColumns({f"{c}_{e}": F.col(c) * F.col(e) for e, cols in specific.items() for c in cols})
    return out.drop("_e")


def _date(cols: Sequence[str]) -> Column:
    month, day, year = (F.col(c).cast("int") for c in cols)
    return F.make_date(year, month, day)


UNITS = {"days": 1.0, "weeks": 7.0, "hours": 1 / 24, "mins": 1 / 1440, "secs": 1 / 86400}


def date_shift(df: DataFrame, first: Sequence[str], second: Sequence[str], name: str, units: str = "days") -> DataFrame:
    """second - first; each is (month, day, year) columns."""
    return df.withColumn(name, F.datediff(_date(second), _date(first)) / F.lit(UNITS[units]))


def time_since(df: DataFrame, cols: Sequence[str], reference, name: str, units: str = "days") -> DataFrame:
    """Time from a date to the (month, day, year) columns."""
    if isinstance(reference, str):
        raise TypeError("the reference is a date, not text")
    return df.withColumn(name, F.datediff(_date(cols), F.lit(reference)) / F.lit(UNITS[units]))
