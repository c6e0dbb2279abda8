"""Time-dependent covariates: rows expanded to event times or to a grid, with interpolated values."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running

#: A list of event times up to this size is a literal array (it is one column of the plan); longer ones are joined by range.
MOST_TIMES = 20_000


def _step(spec: str, x: Column, scale: float = 1.0) -> Column:
    """"step?0g?7l?..." counts the conditions that hold: g >=, l <=, a >, b <."""
    total = F.lit(0)
    for value, mark in re.findall(r"(-?[\d.]+)([glab])", spec.split("?", 1)[1]):
        v = F.lit(float(value))
        total = total + F.when({"g": x >= v, "l": x <= v, "a": x > v, "b": x < v}[mark], 1).otherwise(0)
    return total.cast("double")


def _values(out: DataFrame, names, forms, functions, start, end, ratio: Column, at: Column) -> DataFrame:
    new = {}
    for name, form, f in zip(names, forms, functions, strict=True):
        y0, y1 = f(F.col(start)), f(F.col(end))
        if form == "lin":
            new[name] = ratio * y1 + (1 - ratio) * y0
        elif form.startswith("step?"):
            new[name] = _step(form, ratio * y1 + (1 - ratio) * y0)
        else:
            raise ValueError(f"unknown form {form}")
    return out.withColumns(new)


def at_event_times(df: DataFrame, start: str, end: str, event: str, names: Sequence[str], functions: Sequence[Callable[[Column], Column]], forms: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each event time t in [start, end]: (t - d/2, t], d the least gap of event times; the event is on the last."""
    times = df.where(F.col(event) == 1).select(F.col(end).cast("double").alias("_t")).distinct()
    n = times.count()
    ordered = sorted(r[0] for r in times.collect()) if n <= MOST_TIMES else None
    if ordered is not None:
        gap = min((b - a for a, b in zip(ordered, ordered[1:], strict=False)), default=1.0)
        hit = F.filter(F.array(*[F.lit(t) for t in ordered]), lambda t: (t >= F.col(start)) & (t <= F.col(end)))
        out = df.select("*", F.explode(hit).alias("_t"))
    else:
        gap = running(times, "_t", {"_r": F.lit(1)}, previous={"_before": "_t"}).agg(F.min(F.col("_t") - F.col("_before"))).first()[0]
        out = df.join(times, (F.col("_t") >= F.col(start)) & (F.col("_t") <= F.col(end)))
    width = F.col(end) - F.col(start)
    ratio = F.when(width == 0, F.lit(1.0)).otherwise((F.col("_t") - F.col(start)) / F.nullif(width, F.lit(0.0)))
    out = _values(out, names, forms, functions, start, end, ratio, F.col("_t"))
    flag = F.when((F.col("_t") == F.col(end)) & (F.col(event) == 1), 1).otherwise(0)
    return out.select((F.col("_t") - gap / 2).alias(start), F.col("_t").alias(end), *names, *keep, flag.alias(event))


def on_grid(df: DataFrame, start: str, end: str, event: str, dt: float, names: Sequence[str], functions: Sequence[Callable[[Column], Column]], forms: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """ceil((end - start) / dt) rows of width dt; the last ends at `end` and carries the event; values at (k + 0.5) / n."""
    n = F.greatest(F.lit(1), F.ceil((F.col(end) - F.col(start)) / F.lit(dt)).cast("int"))
    out = df.withColumn("_n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    low = F.col(start) + F.col("_k") * dt
    high = F.when(F.col("_k") == F.col("_n") - 1, F.col(end)).otherwise(F.col(start) + (F.col("_k") + 1) * dt)
    out = _values(out, names, forms, functions, start, end, (F.col("_k") + 0.5) / F.col("_n"), low)
    flag = F.when(F.col("_k") == F.col("_n") - 1, F.col(event)).otherwise(0)
    return out.select(low.alias("_a"), high.alias("_b"), *names, *keep, flag.alias("_e")).select((F.col("_a") + 0.1 * (F.col("_b") - F.col("_a"))).alias(start), F.col("_b").alias(end), *names, *keep, F.col("_e").alias(event))
