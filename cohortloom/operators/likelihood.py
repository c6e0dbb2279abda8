"""Log likelihoods with exact gradient and Hessian: each evaluation is one aggregation that returns one row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import normal_cdf_col, normal_pdf_col
from ..functions.risk import Jet, Model, risk
from ..functions.ship import ship
from .riskset import Shape, competing_sums, risk_sums


@dataclass
class Point:
    value: float
    gradient: np.ndarray
    hessian: np.ndarray
    feasible: bool = True
    deviance: float | None = None


def _finite(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def _gather(df: DataFrame, total: Jet, free: Sequence[int], lowest: Column, order: int, more: dict[str, Column] | None = None) -> Point:
    """Sum a per-row Jet. lowest: the least risk; at or below 0 the point is infeasible."""
    more = more or {}
    pairs = [(i, j) for a, i in enumerate(free) for j in free[a:]] if order > 1 else []
    aggs = [F.sum(total.v).alias("v"), F.min(lowest).alias("low"), F.count("*").alias("n")]
    aggs += [F.sum(total.g.get(i, F.lit(0.0))).alias(f"g{i}") for i in free] if order else []
    aggs += [F.sum(total.h.get(k, F.lit(0.0))).alias(f"h{k[0]}_{k[1]}") for k in pairs]
    r = df.agg(*aggs, *[F.sum(c).alias(k) for k, c in more.items()]).first()
    p = len(free)
    g, h = np.zeros(p), np.zeros((p, p))
    ok = r["n"] > 0 and r["low"] is not None and r["low"] > 0 and r["v"] is not None and np.isfinite(r["v"])
    if order and ok:
        g = np.array([r[f"g{i}"] or 0.0 for i in free])
        for i, j in pairs:
            a, b = free.index(i), free.index(j)
            h[a, b] = h[b, a] = r[f"h{i}_{j}"] or 0.0
    return Point(r["v"] if ok else -np.inf, g, h, ok, r["deviance"] if "deviance" in more else None)


def _expected(r: Jet, free: Sequence[int]) -> Jet:
    """The risk with R'R'/R for R'': then (ln R)'' is 0, and a likelihood's negative Hessian is its expected information."""
    return Jet(r.v, r.g, {(i, j): r.g[i] * r.g[j] / r.v for a, i in enumerate(free) for j in free[a:] if i in r.g and j in r.g})


def poisson(df: DataFrame, model: Model, pyr: str, event: str, strata: Sequence[str] = (), order: int = 2, expected: bool = False) -> Point:
    """Sum of e ln(pyr R) - pyr R; with strata the background of each is profiled out by s = sum e / sum pyr R.

    expected: the Hessian is the negative expected information, here and in the other families.
    """
    r, free = risk(model), model.free
    r = _expected(r, free) if expected else r
    e, t = F.col(event).cast("double"), F.col(pyr).cast("double")
    if not strata:
        mu = r.scaled(t)
        ll = mu.log().scaled(e) + mu.scaled(-1.0)
        dev = 2 * (F.when(e > 0, e * F.ln(e / mu.v)).otherwise(0.0) - (e - mu.v))
        return _gather(df, ll, free, r.v, order, {"deviance": dev})
    #: Within a stratum: sum e ln(pyr R) + E ln(E / sum pyr R) - E.
    pairs = [(i, j) for a, i in enumerate(free) for j in free[a:]] if order > 1 else []
    mu, own = r.scaled(t), r.scaled(t).log().scaled(e)
    cols = {"E": e, "M": mu.v, "L": own.v} | {f"g{i}": mu.g.get(i, F.lit(0.0)) for i in free} | {f"l{i}": own.g.get(i, F.lit(0.0)) for i in free}
    cols |= {f"h{i}_{j}": mu.h.get((i, j), F.lit(0.0)) for i, j in pairs} | {f"k{i}_{j}": own.h.get((i, j), F.lit(0.0)) for i, j in pairs}
    per = df.groupBy(*strata).agg(*[F.sum(c).alias(k) for k, c in cols.items()], F.min(r.v).alias("low")).where("E > 0")
    m = Jet(F.col("M"), {i: F.col(f"g{i}") for i in free}, {(i, j): F.col(f"h{i}_{j}") for i, j in pairs})
    l_ = Jet(F.col("L"), {i: F.col(f"l{i}") for i in free}, {(i, j): F.col(f"k{i}_{j}") for i, j in pairs})
    total = l_ + m.log().scaled(-F.col("E")) + Jet(F.col("E") * F.ln("E") - F.col("E"))
    return _gather(per, total, free, F.col("low"), order)


def poisson_information(df: DataFrame, model: Model, pyr: str) -> np.ndarray:
    """Expected information: sum of pyr R (R'/R)(R'/R)."""
    r, free = risk(model), model.free
    pairs = [(i, j) for a, i in enumerate(free) for j in free[a:]]
    got = df.agg(*[F.sum(F.col(pyr) * r.g.get(i, F.lit(0.0)) * r.g.get(j, F.lit(0.0)) / r.v).alias(f"h{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(free),) * 2)
    for i, j in pairs:
        a, b = free.index(i), free.index(j)
        out[a, b] = out[b, a] = got[f"h{i}_{j}"] or 0.0
    return out


def link(r: Jet, kind: str) -> Jet:
    """Probability of a risk: odds R/(1+R), ident R, loglink exp(-R), probit Phi(R)."""
    if kind == "odds":
        q = 1 + r.v
        return r.apply(r.v / q, 1 / (q * q), -2 / (q * q * q))
    if kind == "ident":
        return r
    if kind == "loglink":
        return r.scaled(-1.0).exp()
    if kind == "probit":
        d = normal_pdf_col(r.v)
        return r.apply(normal_cdf_col(r.v), d, -r.v * d)
    raise ValueError(f"unknown link {kind}")


def logistic(df: DataFrame, model: Model, trials: str | None, event: str, kind: str = "odds", order: int = 2, expected: bool = False) -> Point:
    """Sum of y ln p + (n - y) ln(1 - p); expected information: sum of n p'p' / (p (1 - p))."""
    r = risk(model)
    p = link(r, kind)
    y, n = F.col(event).cast("double"), F.col(trials).cast("double") if trials else F.lit(1.0)
    inside = F.when((p.v > 0) & (p.v < 1), r.v if kind != "probit" else F.lit(1.0)).otherwise(-1.0)
    safe = Jet(F.when((p.v > 0) & (p.v < 1), p.v), p.g, p.h)
    ll = safe.log().scaled(y) + (safe.scaled(-1.0) + 1.0).log().scaled(n - y)
    if expected:
        free = model.free
        ll = Jet(ll.v, ll.g, {(i, j): -n * safe.g[i] * safe.g[j] / (safe.v * (1 - safe.v)) for a, i in enumerate(free) for j in free[a:] if i in safe.g and j in safe.g})
    return _gather(df, ll, model.free, inside, order)


def cox(df: DataFrame, model: Model, start: str, end: str, event: str, strata: Sequence[str] = (), ties: str = "breslow", order: int = 2, weight: str | None = None, parts: bool = False, expected: bool = False, shape: Shape | None = None):
    """Partial likelihood by Breslow or Efron, with strata or competing-risk weights. parts: the per-time frame instead of the point.
    shape: of competing_shape, for weights, if it is known.

    The expected information of the reference, sum of d [sum R'R'/R / S0 - S1 S1 / S0^2], is that of Breslow's ties.
    """
    r, free = risk(model), model.free
    r = _expected(r, free) if expected else r
    pairs = [(i, j) for a, i in enumerate(free) for j in free[a:]] if order > 1 else []
    sums = {"SR": r.v} | ({f"S{i}": r.g.get(i, F.lit(0.0)) for i in free} if order else {}) | {f"S{i}_{j}": r.h.get((i, j), F.lit(0.0)) for i, j in pairs}
    log = r.log()
    lowest = F.when(r.v > 0, 0.0).otherwise(1.0)
    at = {"L": log.v} | ({f"l{i}": log.g.get(i, F.lit(0.0)) for i in free} if order else {}) | {f"l{i}_{j}": log.h.get((i, j), F.lit(0.0)) for i, j in pairs}
    if ties == "efron":
        at |= {"E" + k[1:]: c for k, c in sums.items()}
    sums = sums | {"bad": lowest}
    per = competing_sums(df, start, end, event, sums, F.col(weight), at, strata, shape) if weight else risk_sums(df, start, end, event, sums, at, strata)
    if parts:
        return per
    if ties == "efron":
        per = per.select("*", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int"))).alias("_k"))
        share, times, once = F.col("_k") / F.col("d"), F.lit(1.0), F.when(F.col("_k") == 0, 1.0).otherwise(0.0)
        S = lambda k: F.col(f"S{k}") - share * F.col(f"E{k}")
    else:
        times, once = F.col("d").cast("double"), F.lit(1.0)
        S = lambda k: F.col(f"S{k}")
    s = Jet(S("R"), {i: S(i) for i in free} if order else {}, {(i, j): S(f"{i}_{j}") for i, j in pairs})
    own = Jet(F.col("L") * once, {i: F.col(f"l{i}") * once for i in free} if order else {}, {(i, j): F.col(f"l{i}_{j}") * once for i, j in pairs})
    total = own + Jet(F.when(s.v > 0, s.v), s.g, s.h).log().scaled(times * -1.0)
    total = Jet(_finite(total.v), {k: _finite(c) for k, c in total.g.items()}, {k: _finite(c) for k, c in total.h.items()})
    return _gather(per, total, free, 1.0 - F.col("bad") * 2, order)


def cox_null(df: DataFrame, start: str, end: str, event: str, strata: Sequence[str] = (), ties: str = "breslow") -> float:
    """The partial likelihood with all risks 1: counts only."""
    return cox(df, Model((), null=True), start, end, event, strata, ties, 0).value


#: Sums of products of k risks, for k up to a bound, with first and second derivatives; risks are divided by `scale`, their sum, so no entry exceeds 1 / k!.
_Products = tuple[float, np.ndarray, np.ndarray, np.ndarray]


def _products(r: np.ndarray, g: np.ndarray, h: np.ndarray, most: int) -> _Products:
    """Elementary symmetric polynomials of r up to min(most, rows): B(m, n) = B(m, n - 1) + r_n B(m - 1, n - 1)."""
    p, m = g.shape[1], min(most, len(r))
    b, bg, bh = np.zeros(m + 1), np.zeros((m + 1, p)), np.zeros((m + 1, p, p))
    b[0] = 1.0
    scale = float(r.sum()) or 1.0
    for x, dx, ddx in zip(r / scale, g / scale, h / scale, strict=True):
        cross = bg[:-1, :, None] * dx
        bh[1:] += x * bh[:-1] + cross + cross.transpose(0, 2, 1) + b[:-1, None, None] * ddx
        bg[1:] += x * bg[:-1] + b[:-1, None] * dx
        b[1:] += x * b[:-1]
    return scale, b, bg, bh


def _merged(one: _Products, two: _Products, most: int) -> _Products:
    """The products over the rows of both."""
    scale, p = one[0] + two[0], one[2].shape[1]
    m = min(most, len(one[1]) + len(two[1]) - 2)
    b, bg, bh = np.zeros(m + 1), np.zeros((m + 1, p)), np.zeros((m + 1, p, p))
    (x, xg, xh), (y, yg, yh) = [[c * ((s / scale) ** np.arange(len(c))).reshape(-1, *[1] * (c.ndim - 1)) for c in rest] for s, *rest in (one, two)]
    for i in range(min(len(x), m + 1)):
        k = min(len(y), m + 1 - i)
        at = slice(i, i + k)
        cross = yg[:k, :, None] * xg[i]
        bh[at] += x[i] * yh[:k] + y[:k, None, None] * xh[i] + cross + cross.transpose(0, 2, 1)
        bg[at] += x[i] * yg[:k] + y[:k, None] * xg[i]
        b[at] += x[i] * y[:k]
    return scale, b, bg, bh


def _log_product(got: _Products, m: int) -> tuple[float, np.ndarray, np.ndarray]:
    """ln B(m, n) with derivatives."""
    scale, b, bg, bh = got
    lg = bg[m] / b[m]
    return float(np.log(b[m]) + m * np.log(scale)), lg, bh[m] / b[m] - np.outer(lg, lg)


def _cases(r: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum of ln r over cases with derivatives."""
    rel = g / r[:, None]
    return float(np.log(r).sum()), rel.sum(0), (h / r[:, None, None]).sum(0) - rel.T @ rel


def _tilt(r: np.ndarray, m: int) -> float:
    """The log odds a at which risks times exp(a) expect m cases, 0 < m < rows."""
    a = np.log(m / (len(r) - m))
    for _ in range(50):
        q = 1 / (1 + np.exp(-a) / r)
        step = (m - q.sum()) / max(1e-12, (q * (1 - q)).sum())
        a += np.clip(step, -2, 2)
        if abs(step) < 1e-12:
            break
    return a


def _log_product_many(r: np.ndarray, g: np.ndarray, h: np.ndarray, m: int) -> tuple[float, np.ndarray, np.ndarray]:
    """ln B(m, n) with derivatives for any m, without products of m factors that leave the range of a double.

    With odds c r, c such that m cases are expected, B(m, n) c^m / prod(1 + c r) is the chance of m cases: about 1 / sd,
    whatever m. It is a Fourier sum of prod(1 + q (e^iw - 1)); frequencies are so many that the aliased chances,
    12 sd and 40 cases away at least, are below exp(-70) by Bernstein's bound.
    """
    if m == len(r):
        return _cases(r, g, h)
    p, a = g.shape[1], _tilt(r, m)
    q = 1 / (1 + np.exp(-a) / r)
    k = min(len(r) + 1, int(12 * np.sqrt((q * (1 - q)).sum())) + 40) | 1
    turn = np.exp(2j * np.pi * np.arange(k // 2 + 1) / k)
    f, first, second = np.ones(len(turn), complex), np.zeros((p, len(turn)), complex), np.zeros((p * p, len(turn)), complex)
    rows = max(1, (1 << 19) // len(turn))
    for i in range(0, len(r), rows):
        at = slice(i, i + rows)
        one = 1 + q[at, None] * (turn - 1)
        f *= one.prod(0)
        w = (q[at] / r[at])[:, None] * turn / one
        first += g[at].T @ w
        second += h[at].reshape(-1, p * p).T @ w - (g[at][:, :, None] * g[at][:, None, :]).reshape(-1, p * p).T @ (w * w)
    f *= np.where(np.arange(len(turn)) > 0, 2, 1) / k * turn ** -m
    chance = f.sum().real
    lg = (first @ f).real / chance
    both = (((first[:, None] * first[None]).reshape(p * p, -1) + second) @ f).real.reshape(p, p) / chance
    return float(np.log(chance) + np.logaddexp(0, a + np.log(r)).sum() - m * a), lg, both - np.outer(lg, lg)


def _unconditional(r: np.ndarray, g: np.ndarray, h: np.ndarray, m: int, expected: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """What stands for ln B(m, n) where the set's log odds is profiled out."""
    if m == len(r):
        return _cases(r, g, h)
    a = _tilt(r, m)
    z = np.exp(a) * r
    q = z / (1 + z)
    u = g / r[:, None]
    w = q * (1 - q)
    full = (q[:, None, None] * h / r[:, None, None]).sum(0) - ((q - w)[:, None] * u).T @ u
    cross = -(w[:, None] * u).sum(0)
    return float(np.log1p(z).sum() - a * m), (q[:, None] * u).sum(0), full if expected else full - np.outer(cross, cross) / w.sum()


def _log_products(r: np.ndarray, g: np.ndarray, h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ln B(m, n) with derivatives of many sets of m cases at once: the steps of `_products`, each for all sets that have such a row."""
    p, turn = g.shape[1], np.argsort(-sizes, kind="stable")
    starts, sizes = starts[turn], sizes[turn]
    scale = np.array([r[a : a + n].sum() for a, n in zip(starts, sizes, strict=True)])
    b, bg, bh = np.zeros((len(turn), m + 1)), np.zeros((len(turn), m + 1, p)), np.zeros((len(turn), m + 1, p, p))
    b[:, 0] = 1.0
    for j in range(sizes[0]):
        k = int(np.searchsorted(-sizes, -j, side="left"))
        at, by = starts[:k] + j, scale[:k]
        x, dx, ddx = (r[at] / by)[:, None], (g[at] / by[:, None])[:, None], (h[at] / by[:, None, None])[:, None]
        cross = bg[:k, :-1, :, None] * dx[:, :, None]
        bh[:k, 1:] += x[..., None, None] * bh[:k, :-1] + cross + cross.transpose(0, 1, 3, 2) + b[:k, :-1, None, None] * ddx
        bg[:k, 1:] += x[..., None] * bg[:k, :-1] + b[:k, :-1, None] * dx
        b[:k, 1:] += x * b[:k, :-1]
    back, top = np.argsort(turn), b[:, m]
    lg = bg[:, m] / top[:, None]
    return (np.log(top) + m * np.log(scale))[back], lg[back], (bh[:, m] / top[:, None, None] - lg[:, :, None] * lg[:, None])[back]


def _sets(r: np.ndarray, g: np.ndarray, h: np.ndarray, case: np.ndarray, starts: np.ndarray, threshold: int | None, expected: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Value, least risk, gradient and Hessian of each set; the rows of a set are adjacent, from one of `starts` on."""
    p, sizes = g.shape[1], np.diff(np.append(starts, len(r)))
    cases, low = np.add.reduceat(case.astype(int), starts), np.minimum.reduceat(r, starts)
    value, grad, hess = np.zeros(len(starts)), np.zeros((len(starts), p)), np.zeros((len(starts), p, p))
    good = (cases > 0) & (low > 0)
    safe = np.where(r > 0, r, 1.0)
    rel = g / safe[:, None]
    own = [np.where(case, np.log(safe), 0.0), case[:, None] * rel, case[:, None, None] * (h / safe[:, None, None] - rel[:, :, None] * rel[:, None])]
    for out, x in zip((value, grad, hess), own, strict=True):
        if x.size:
            out[good] = np.add.reduceat(x, starts, axis=0)[good]
    most = PRODUCTS if threshold is None else min(threshold, PRODUCTS)
    for m in np.unique(cases[good]):
        chosen = np.flatnonzero(good & (cases == m))
        if m <= most:
            v, vg, vh = _log_products(r, g, h, starts[chosen], sizes[chosen], int(m))
        else:
            got = []
            for i in chosen:
                at = slice(starts[i], starts[i] + sizes[i])
                got.append(_log_product_many(r[at], g[at], h[at], int(m)) if threshold is None or m <= threshold else _unconditional(r[at], g[at], h[at], int(m), expected))
            v, vg, vh = (np.array(x) for x in zip(*got, strict=True))
        value[chosen] -= v
        grad[chosen] -= vg
        hess[chosen] -= vh
    return value, low, grad, hess


#: Products are formed of so many risks at most: beyond, they may leave the range of a double.
PRODUCTS = 100
#: Sets of more rows are worked on in parts, one for each partition of the input.
PART_ROWS = 20_000
#: Parts are first merged in so many groups.
PART_GROUPS = 512
#: Small sets are worked on together, so many rows at a time (fewer if there are many parameters).
CHUNK_ROWS = 16_384


def case_control(df: DataFrame, model: Model, event: str, sets: Sequence[str], threshold: int | None = 50, odds: DataFrame | None = None, expected: bool = False, part_rows: int = PART_ROWS) -> Point:
    """Conditional likelihood of matched sets: sum of ln r over cases less ln B(m, n).

    A set of more than `threshold` cases has its own log odds, which is profiled out by Newton steps within the set
    (the unconditional form; its expected information holds the log odds, as the reference does); threshold None
    takes the conditional form for all. A set of more than `part_rows` rows is worked on where its rows lie: the products
    of its parts are merged. Only one of more than `threshold` or `PRODUCTS` cases must fit in one task. Other
    sets stream through sorted by their keys, many in one step of arrays.
    """
    r, free = risk(model), model.free
    r = _expected(r, free) if expected else r
    p = len(free)
    pairs = [(i, j) for a, i in enumerate(free) for j in free[a:]]
    cols = [r.v.alias("r"), *[r.g.get(i, F.lit(0.0)).alias(f"g{i}") for i in free], *[r.h.get(k, F.lit(0.0)).alias(f"h{k[0]}_{k[1]}") for k in pairs]]
    rows = df.select(*[F.col(s) for s in sets], (F.col(event) == 1).cast("int").alias("case"), *cols)
    keys = list(sets)
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(1)), ["_all"]

    def arrays(x) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """From a pandas frame or a dict of arrays."""
        h = np.zeros((len(x["r"]), p, p))
        for i, j in pairs:
            a, b = free.index(i), free.index(j)
            h[:, a, b] = h[:, b, a] = x[f"h{i}_{j}"]
        return np.asarray(x["r"], float), np.array([np.asarray(x[f"g{i}"], float) for i in free]).reshape(p, len(h)).T, h, np.asarray(x["case"]) == 1

    def stream(batches):
        import pyarrow as pa

        limit = min(CHUNK_ROWS, max(256, (1 << 19) // (1 + p + p * p)))
        kept: list[dict[str, np.ndarray]] = []
        held = 0

        def results(x: dict[str, np.ndarray]):
            value, low, grad, hess = _sets(*arrays(x), np.flatnonzero(x["_first"]), threshold, expected)
            out = [value, low, *grad.T, *[hess[:, free.index(i), free.index(j)] for i, j in pairs]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out], names)

        def joined() -> dict[str, np.ndarray]:
            return {c: np.concatenate([k[c] for k in kept]) for c in kept[0]}

        for batch in batches:
            x = {c: v.to_numpy(zero_copy_only=False) for c, v in zip(batch.schema.names, batch.columns, strict=True)}
            if not len(x["r"]):
                continue
            begins = np.flatnonzero(x["_first"])
            #: What lies before the last beginning is whole.
            if len(begins) and held + begins[-1] >= limit:
                kept.append({c: v[: begins[-1]] for c, v in x.items()})
                yield results(joined())
                kept, held = [{c: v[begins[-1] :] for c, v in x.items()}], len(x["r"]) - begins[-1]
            else:
                kept.append(x)
                held += len(x["r"])
        if held:
            yield results(joined())

    names = ["v", "low", *[f"g{i}" for i in free], *[f"h{i}_{j}" for i, j in pairs]]
    ship(df.sparkSession)
    types = ", ".join(f"{n} double" for n in names)
    size = [F.count("*").alias("_n"), F.sum("case").alias("_m")]
    most = PRODUCTS if threshold is None else min(threshold, PRODUCTS)
    large = rows.groupBy(*keys).agg(*size).where((F.col("_n") > part_rows) & F.col("_m").between(1, most)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_m")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))

    def streamed(some: DataFrame) -> DataFrame:
        #: Brings the rows of each set together, in order, and marks where one begins.
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))) == 1
        return some.withColumn("_first", first).select("_first", "case", "r", *names[2:]).mapInArrow(stream, types)

    if large.limit(1).count():
        per = streamed(rows.join(large, same, "left_anti")).union(_in_parts(rows.withColumn("_part", F.spark_partition_id()).join(large, same), keys, arrays, free, pairs, types))
    else:
        per = streamed(rows)
    total = Jet(F.col("v"), {i: F.col(f"g{i}") for i in free}, {k: F.col(f"h{k[0]}_{k[1]}") for k in pairs})
    return _gather(per, total, free, F.col("low"), 2)


def _in_parts(rows: DataFrame, keys: list[str], arrays, free: Sequence[int], pairs: Sequence[tuple[int, int]], types: str) -> DataFrame:
    """The results of sets whose rows are dealt by `_part`; a part is a state of at most `_m` + 1 products, and states merge in two steps."""
    p = len(free)
    state = "scale double, b array<double>, bg array<double>, bh array<double>, lr double, dg array<double>, dh array<double>, low double"

    def row(got: _Products, own: tuple[float, np.ndarray, np.ndarray], low: float) -> list:
        return [got[0], *[c.ravel().tolist() for c in got[1:]], own[0], own[1].tolist(), own[2].ravel().tolist(), low]

    def read(x) -> tuple[_Products, tuple, float]:
        n = len(x.b)
        return (x.scale, np.array(x.b), np.array(x.bg).reshape(n, p), np.array(x.bh).reshape(n, p, p)), (x.lr, np.array(x.dg).reshape(p), np.array(x.dh).reshape(p, p)), x.low

    names = [c.split()[0] for c in state.split(", ")]

    def start(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        r, g, h, case = arrays(x)
        low = float(r.min())
        own = _cases(r[case], g[case], h[case]) if low > 0 else (0.0, np.zeros(p), np.zeros((p, p)))
        return pd.DataFrame([[*key, *row(_products(np.abs(r), g, h, int(key[-1])), own, low)]], columns=[*keys, "_part", "_m", *names])

    def together(x: pd.DataFrame, m: int):
        got, own, low = None, (0.0, np.zeros(p), np.zeros((p, p))), np.inf
        for y in x.itertuples():
            one, mine, least = read(y)
            got = one if got is None else _merged(got, one, m)
            own, low = tuple(a + b for a, b in zip(own, mine, strict=True)), min(low, least)
        return got, own, low

    def merge(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, *row(*together(x, int(key[-1])))]], columns=[*keys, "_part", "_m", *names])

    def finish(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        m = int(key[-1])
        got, (lr, dg, dh), low = together(x, m)
        out = [0.0, low, *[0.0] * (p + len(pairs))]
        if low > 0:
            v, vg, vh = _log_product(got, m)
            hess = dh - vh
            out = [lr - v, low, *(dg - vg), *[hess[free.index(i), free.index(j)] for i, j in pairs]]
        return pd.DataFrame([out], columns=[c.split()[0] for c in types.split(", ")])

    kept = [f for f in rows.schema.fields if f.name in (*keys, "_part", "_m")]
    head = ", ".join(f"`{n}` {next(f for f in kept if f.name == n).dataType.simpleString()}" for n in (*keys, "_part", "_m"))
    parts = rows.groupBy(*keys, "_part", "_m").applyInPandas(start, f"{head}, {state}")
    parts = parts.withColumn("_part", F.col("_part") % PART_GROUPS).groupBy(*keys, "_part", "_m").applyInPandas(merge, f"{head}, {state}")
    return parts.groupBy(*keys, "_m").applyInPandas(finish, types)


def matched_rows(df: DataFrame, start: str, end: str, event: str, strata: Sequence[str] = ()) -> DataFrame:
    """Rows of each event-time risk set (start < t <= end), one copy for each set, with `_t`: matched sets by time."""
    keys = list(strata)
    times = df.where(F.col(event) == 1).select(*keys, F.col(end).alias("_t")).distinct()
    r, t = df.alias("r"), times.alias("t")
    cond = (F.col(f"r.{start}") < F.col("t._t")) & (F.col("t._t") <= F.col(f"r.{end}"))
    for k in keys:
        cond = (F.col(f"r.{k}") == F.col(f"t.{k}")) & cond
    here = F.when((F.col(f"r.{end}") == F.col("t._t")) & (F.col(f"r.{event}") == 1), 1).otherwise(0)
    return r.join(t, cond).select("r.*", F.col("t._t"), here.alias("_case"))
