"""Tables after a fit: risks, survival, residuals, assigned events."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.risk import Model, risk
from .prefix import running
from .riskset import risk_sums


def _filled(df: DataFrame, model: Model) -> DataFrame:
    return df.withColumns({c: F.lit(0.0) for c in model.columns() if c not in df.columns})


def relative_risk(df: DataFrame, model: Model, name: str = "risk") -> DataFrame:
    """The risk of each row; model columns that are missing count as 0."""
    df = _filled(df, model)
    return df.withColumn(name, risk(model).v)


def risk_curve(df: DataFrame, model: Model, column: str, index: int, error: float, z: float = 1.96) -> DataFrame:
    """(x, y, lower, upper): the risk at the estimate and at beta -+ z * error of one parameter."""
    at = lambda d: risk(model.at([v + d if i == index else v for i, v in enumerate(model.values)])).v
    return df.select(F.col(column).cast("double").alias("x"), at(0.0).alias("y"), at(-z * error).alias("lower"), at(z * error).alias("upper"))


def baseline(df: DataFrame, model: Model, start: str, end: str, event: str, strata: Sequence[str] = (), covariance: np.ndarray | None = None, legacy_greenwood: bool = False, limits: tuple[float, float] | None = None) -> DataFrame:
    """t, d, n, base (d / sum of R over rows with start <= t <= end), h, ch (strictly before t), surv, surv_se.

    Start is closed here without strata: a row that starts at t is at risk at t. With strata the fitting rule holds.
    limits: only times within them come back; the sums run over all times.
    """
    r, free = risk(model), model.free
    keys = list(strata)
    sums = {"SR": r.v, "n": F.lit(1.0)} | {f"S{i}": r.g.get(i, F.lit(0.0)) for i in free}
    per = risk_sums(df, start, end, event, sums, {}, keys) if keys else _closed(df, start, end, event, sums)
    d = F.col("d").cast("double")
    green = F.floor(F.floor(d / F.col("n")) / F.nullif(F.col("n") - d, F.lit(0.0))) if legacy_greenwood else d / F.col("n") / F.nullif(F.col("n") - d, F.lit(0.0))
    per = per.withColumns({"base": d / F.col("SR"), "_green": F.coalesce(green, F.lit(0.0))} | {f"_b{i}": d * F.col(f"S{i}") / (F.col("SR") * F.col("SR")) for i in free})
    tracks = {"ch": F.col("base"), "_var": F.col("_green")} | ({f"_slope{i}": F.col(f"_b{i}") for i in free} if covariance is not None else {})
    per = running(per, "t", tracks, keys, before=[*tracks], previous={"h": "base"})
    per = per.withColumns({"h": F.coalesce("h", F.lit(0.0)), "surv": F.exp(-F.col("ch"))})
    var = F.col("_var")
    if covariance is not None and len(free):
        slope = [F.col(f"_slope{i}") for i in free]
        for a in range(len(free)):
            for b in range(len(free)):
                var = var + slope[a] * slope[b] * float(covariance[a, b])
    out = per.withColumn("surv_se", F.col("surv") * F.sqrt(var)).select(*keys, "t", "d", "n", "base", "h", "ch", "surv", "surv_se")
    return out if limits is None else out.where(F.col("t").between(*map(float, limits)))


def _closed(df: DataFrame, start: str, end: str, event: str, sums: dict[str, Column]) -> DataFrame:
    """Risk sums with start <= t <= end: sum(end >= t) - sum(start > t)."""
    rows = df.select(F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_b"), (F.col(event) == 1).cast("int").alias("_e"), *[c.cast("double").alias(f"_s{i}") for i, c in enumerate(sums.values())])
    both = F.array(F.struct(F.col("_b").alias("t"), F.lit(1.0).alias("w")), F.struct(F.col("_a").alias("t"), F.lit(-1.0).alias("w")))
    flat = rows.select("*", F.explode(both).alias("_p"))
    n = range(len(sums))
    up, down = F.col("_p.w") > 0, F.col("_p.w") < 0
    per = flat.groupBy(F.col("_p.t").alias("t")).agg(F.sum(F.when(up, F.col("_e")).otherwise(0)).alias("d"), *[F.sum(F.when(up, F.col(f"_s{i}")).otherwise(0.0)).alias(f"_u{i}") for i in n], *[F.sum(F.when(down, F.col(f"_s{i}")).otherwise(0.0)).alias(f"_d{i}") for i in n])
    per = running(per, "t", {f"{c}{i}": F.col(f"{c}{i}") for c in ("_u", "_d") for i in n}, descending=True, before=[f"_d{i}" for i in n])
    return per.where("d > 0").select("t", "d", *[(F.col(f"_u{i}") - F.col(f"_d{i}")).alias(k) for i, k in enumerate(sums)])


def kaplan_meier(df: DataFrame, subject: str, start: str, end: str, event: str) -> DataFrame:
    """t, d, n, n_t, n_se by subject: a subject's last end and event; at risk are subjects whose end exceeds the previous event time."""
    one = df.groupBy(subject).agg(F.max(F.col(end).cast("double")).alias("t"), F.max((F.col(event) == 1).cast("int")).alias("e"))
    per = one.groupBy("t").agg(F.sum("e").alias("d"), F.count("*").alias("m"))
    per = running(per, "t", {"_left": F.col("m")}, descending=True)
    #: Subjects that left between two event times still count for the later one.
    per = running(per, "t", {"_k": F.when(F.col("d") > 0, 1).otherwise(0)}, before=["_k"])
    per = per.groupBy("_k").agg(F.max(F.when(F.col("d") > 0, F.col("t"))).alias("t"), F.max("d").alias("d"), F.max("_left").alias("n")).where("d > 0").drop("_k")
    log = F.when(F.col("d") < F.col("n"), F.ln(1 - F.col("d") / F.col("n"))).otherwise(0.0)
    green = F.coalesce(F.col("d") / F.col("n") / F.nullif(F.col("n") - F.col("d"), F.lit(0)), F.lit(0.0))
    per = running(per, "t", {"_log": log, "_gone": F.when(F.col("d") >= F.col("n"), 1).otherwise(0), "_g": green})
    n_t = F.when(F.col("_gone") > 0, 0.0).otherwise(F.exp("_log"))
    return per.select("t", "d", "n", n_t.alias("n_t"), (F.sqrt("_g") * n_t).alias("n_se"))


def _curve(times: np.ndarray, ch: np.ndarray) -> tuple[list, list, list, float, float]:
    """Times, hazards, and for equal cells over their range how many times lie before each: a search of constant cost."""
    cells = max(1, len(times))
    low, width = float(times[0]), max(1e-300, float(times[-1] - times[0]) / cells)
    before = np.searchsorted(times, low + width * np.arange(cells + 1), "left")
    return times.tolist(), ch.tolist(), [int(x) for x in np.append(before, len(times))], low, width


def _hazard_at(x: Column, low: float, width: float) -> Column:
    """Linear interpolation of the cumulative hazard in the arrays `_t` and `_h`, clamped at their ends."""
    cell = F.least(F.greatest(F.floor((x - low) / width).cast("int"), F.lit(0)), F.size("_n") - 2)
    #: One cell further on both sides absorbs rounding at the cells' bounds.
    first = F.element_at("_n", F.greatest(cell, F.lit(1)))
    last = F.element_at("_n", F.least(cell + 3, F.size("_n")))
    n = first + F.size(F.filter(F.slice("_t", first + 1, last - first), lambda t: t <= x))
    i, j = F.greatest(n, F.lit(1)), F.least(n + 1, F.size("_t"))
    t0, t1, h0, h1 = F.element_at("_t", i), F.element_at("_t", j), F.element_at("_h", i), F.element_at("_h", j)
    return h0 + F.when((n >= 1) & (t1 > t0), (x - t0) / F.nullif(t1 - t0, F.lit(0.0)) * (h1 - h0)).otherwise(0.0)


def martingale(df: DataFrame, model: Model, start: str, end: str, event: str, subject: str | None = None, most: int = 100_000) -> DataFrame:
    """Row residuals e - (H(end) - H(start)) R; with a subject their sums with the last time.

    The hazard curve is one value per distinct event time; up to `most` of them travel as one broadcast row.
    """
    base = baseline(df, model, start, end, event).select("t", "ch").limit(most + 1).toPandas().sort_values("t")
    if len(base) > most:
        raise ValueError("the curve has too many times to broadcast: bin the times first")
    if base.empty:
        raise ValueError("there is no event")
    t, h, n, low, width = _curve(base["t"].to_numpy(), base["ch"].to_numpy())
    curve = df.sparkSession.createDataFrame([(t, h, n)], "_t array<double>, _h array<double>, _n array<int>")
    rows = df.crossJoin(F.broadcast(curve))
    at = lambda c: _hazard_at(F.col(c).cast("double"), low, width)
    out = rows.withColumn("residual", (F.col(event) == 1).cast("double") - (at(end) - at(start)) * risk(model).v).drop("_t", "_h", "_n")
    if subject is None:
        return out
    return out.groupBy(subject).agg(F.sum("residual").alias("residual"), F.sum((F.col(event) == 1).cast("int")).alias("event"), F.max(end).alias("time"))


def schoenfeld(df: DataFrame, model: Model, start: str, end: str, event: str, columns: Sequence[str], legacy: bool = False) -> DataFrame:
    """For each event time and column: mean of the events less the risk-weighted mean of the risk set."""
    r = risk(model).v
    sums = {"SR": r} | {f"X{i}": r * F.col(c).cast("double") for i, c in enumerate(columns)}
    at = {f"own{i}": F.col(c).cast("double") for i, c in enumerate(columns)}
    per = risk_sums(df, start, end, event, sums, at)
    expected = lambda i: F.col(f"X{i}") / F.col("SR") / (F.col("d") if legacy else F.lit(1.0))
    return per.select("t", "d", *[(F.col(f"own{i}") / F.col("d") - expected(i)).alias(f"residual_{c}") for i, c in enumerate(columns)])


def scaled_schoenfeld(per: DataFrame, columns: Sequence[str], covariance: np.ndarray, beta: Sequence[float]) -> DataFrame:
    """Residuals times the covariance and the number of event times, plus beta."""
    n = per.count()
    out = {}
    for i, c in enumerate(columns):
        x = F.lit(float(beta[i]))
        for j, o in enumerate(columns):
            x = x + F.col(f"residual_{o}") * float(covariance[j, i] * n)
        out[f"scaled_{c}"] = x
    return per.withColumns(out)


def event_assignment(df: DataFrame, model: Model, pyr: str, event: str, strata: Sequence[str] = ()) -> DataFrame:
    """Expected background, excess and total events, and the observed ones shared in the same parts; others where not finite are 0."""
    first = min(e.term for e in model.elements)
    part = Model(tuple(e for e in model.elements if e.term == first), "M")
    t0, r = risk(part).v, risk(model).v
    t = F.col(pyr).cast("double")
    out = df.withColumns({"_bg": t0 * t, "_total": r * t})
    if strata:
        w = Window.partitionBy(*strata)
        s = F.sum(event).over(w) / F.sum("_total").over(w)
        out = out.withColumn("_s", s).withColumns({"_bg": F.col("_bg") * F.col("_s"), "_total": F.col("_total") * F.col("_s")}).drop("_s")
    safe = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    share = F.try_divide(F.col("_bg"), F.col("_total"))
    return out.withColumns({
        "predict_bg": safe(F.col("_bg")), "predict_excess": safe(F.col("_total") - F.col("_bg")), "predict_total": safe(F.col("_total")),
        "caused_bg": safe(share * F.col(event)), "caused_excess": safe((1 - share) * F.col(event)), "caused_total": safe(share * F.col(event)) + safe((1 - share) * F.col(event)),
    }).drop("_bg", "_total")


def event_assignment_bounds(df: DataFrame, models: dict[str, Model], pyr: str, event: str, strata: Sequence[str] = ()) -> dict[str, DataFrame]:
    """event_assignment at several models, such as lower, mid and upper."""
    return {k: event_assignment(df, m, pyr, event, strata) for k, m in models.items()}


def poisson_residual(df: DataFrame, model: Model, pyr: str, event: str, kind: str = "risk", strata: Sequence[str] = ()) -> DataFrame:
    """`Residual`: the risk (times the stratum's background), or the Pearson or deviance residual."""
    e, t = F.col(event).cast("double"), F.col(pyr).cast("double")
    out = df.withColumn("_r", risk(model).v)
    if strata:
        w = Window.partitionBy(*strata)
        out = out.withColumn("_r", F.col("_r") * F.sum(event).over(w) / F.sum(t * F.col("_r")).over(w))
    mu = t * F.col("_r")
    dev = 2 * (F.when(e > 0, e * F.ln(e / mu)).otherwise(0.0) - (e - mu))
    value = {"risk": F.col("_r"), "pearson": (e - mu) / F.sqrt(mu), "deviance": F.signum(e - mu) * F.sqrt(F.greatest(dev, F.lit(0.0)))}[kind]
    return out.withColumn("Residual", value).drop("_r")


def cox_after(kind: str, df: DataFrame, model: Model, start: str, end: str, event: str, **more) -> DataFrame:
    """Any table after a Cox fit by name: survival, km (needs subject), martingale, schoenfeld (needs columns), risk (needs column, index, error)."""
    needs = {"survival": (), "km": ("subject",), "martingale": (), "schoenfeld": ("columns",), "risk": ("column", "index", "error")}
    if kind not in needs:
        raise ValueError(f"{kind!r} is none of {sorted(needs)}")
    if missing := [n for n in needs[kind] if n not in more]:
        raise ValueError(f"{kind} needs {missing}")
    if kind == "km":
        return kaplan_meier(df, more["subject"], start, end, event)
    if kind == "risk":
        return risk_curve(df, model, **more)
    return {"survival": baseline, "martingale": martingale, "schoenfeld": schoenfeld}[kind](df, model, start, end, event, **more)
