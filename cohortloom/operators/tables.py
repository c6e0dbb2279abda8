"""Person-count and person-time tables: categories, interval splitting on time scales, summaries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import levels

UNASSIGNED = "Unassigned"
DAYS = {"days": 1.0, "months": 30.4375, "years": 365.25}


@dataclass(frozen=True)
class Bin:
    low: float
    high: float
    closed: bool
    label: str

    def holds(self, x: Column) -> Column:
        if self.low == self.high:
            return x == F.lit(self.low)
        return (x >= F.lit(self.low)) & ((x <= F.lit(self.high)) if self.closed else (x < F.lit(self.high)))


def _number(text) -> float:
    return float(str(text).replace("]", "").strip())


def _name(x: float) -> str:
    return f"{x:g}"


def parse_bins(spec) -> list[Bin]:
    """"0/10/25]50" (the mark after a bound: / half-open, ] closed at the next), or {"lower", "upper"[, "name"]} with "]10" closed."""
    if isinstance(spec, str):
        parts = re.split(r"([/\]])", spec.replace(" ", ""))
        bounds = [float(x) for x in parts[0::2]]
        return [Bin(a, b, m == "]", f"{_name(a)} - {_name(b)}") for a, b, m in zip(bounds, bounds[1:], parts[1::2], strict=False)]
    lower, upper = spec["lower"], spec["upper"]
    names = spec.get("name") or range(1, len(lower) + 1)
    return [Bin(_number(a), _number(b), "]" in str(b), str(n)) for a, b, n in zip(lower, upper, names, strict=True)]


def bounds_text(bins: Sequence[Bin]) -> str:
    return "".join(f" [{_name(b.low)}, {_name(b.high)}{']' if b.closed or b.low == b.high else ')'}" for b in bins)


def category(df: DataFrame, key: str, spec) -> tuple[str, Column, str]:
    """(name, Column, bounds text) of a category "col" or "col AS name"; the first bin that holds a value wins."""
    col, _, name = (x.strip() for x in re.sub(r"\s+", " ", key).partition(" AS "))
    name = name or f"{col}_category"
    if col not in df.columns:
        raise ValueError(f"column {col} is missing")
    x = F.col(col)
    if spec == "factor":
        return name, F.coalesce(x.cast("string"), F.lit(UNASSIGNED)), "factor"
    bins = parse_bins(spec)
    if dict(df.dtypes)[col] == "string":
        lv = levels(df, col)
        x = F.element_at(F.create_map(*[y for i, v in enumerate(lv) for y in (F.lit(v), F.lit(float(i + 1)))]), x)
    out = F.lit(UNASSIGNED)
    for b in reversed(bins):
        out = F.when(b.holds(x), F.lit(b.label)).otherwise(out)
    return name, out, bounds_text(bins)


#: The summaries' names.
METHODS = ("count", "sum", "rsum", "mean", "rmean", "weighted_sum", "weighted_mean", "xsum", "xmean", "weighted_xsum", "weighted_xmean")
WEIGHTED = {"count": "weighted_sum", "rsum": "weighted_sum", "sum": "weighted_sum", "mean": "weighted_mean", "rmean": "weighted_mean", "xsum": "weighted_xsum", "xmean": "weighted_xmean"}


def summary(col: str, spec: str, aliases: Mapping[str, str], time_table: bool) -> tuple[str, Column]:
    """(name, aggregate) of "method [AS name] [BY|WEIGHT column]" in any order."""
    words = spec.split()
    if len(words) not in (1, 3, 5):
        raise ValueError(f"summary {spec!r} has {len(words)} words")
    given: dict[str, str] = {}
    method = None
    i = 0
    while i < len(words):
        if words[i].upper() in ("AS", "BY", "WEIGHT"):
            given["BY" if words[i].upper() != "AS" else "AS"] = words[i + 1]
            i += 2
        elif method is None:
            method, i = words[i].lower(), i + 1
        else:
            raise ValueError(f"summary {spec!r} has two methods")
    if method not in METHODS:
        raise ValueError(f"unknown summary {method}")
    name = given.get("AS", col)
    by = given.get("BY")
    if by:
        method = WEIGHTED.get(method, method)
    elif method.startswith("weighted") and not time_table:
        raise ValueError(f"{method} needs BY")
    x = F.col(col).cast("double")
    w = F.col(aliases.get(by, by)).cast("double") if by else F.col("PYR") if time_table else None
    last = F.col("L_AT_RISK").cast("double")
    ratio = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.nullif(F.sum(b), F.lit(0.0))), F.lit(0.0))
    return name, {
        "count": lambda: F.sum(x), "sum": lambda: F.sum(x), "rsum": lambda: F.sum(x), "mean": lambda: F.avg(x), "rmean": lambda: F.avg(x), "weighted_sum": lambda: F.sum(x * w), "weighted_mean": lambda: ratio(x * w, w),
        "xsum": lambda: F.sum(x * last), "xmean": lambda: ratio(x * last, last), "weighted_xsum": lambda: F.sum(x * last * w), "weighted_xmean": lambda: ratio(x * last * w, last * w),
    }[method]()


def _events(events: Sequence[str]) -> dict[str, str]:
    """alias -> column of "col" or "col AS alias"."""
    out = {}
    for e in events:
        col, _, alias = (x.strip() for x in e.partition(" AS "))
        out[alias or col] = col
    return out


def _summaries(specs, aliases: Mapping[str, str], time_table: bool) -> dict[str, Column]:
    """Events become counts; a summary of the same name is dropped for one."""
    out = {a: F.sum(F.col(c).cast("double")) for a, c in aliases.items()}
    for col, given in (specs or {}).items():
        for spec in [given] if isinstance(given, str) else given:
            name, agg = summary(col, spec, aliases, time_table)
            out.setdefault(name, agg)
    return out


def event_count(df: DataFrame, categories: Mapping, summaries: Mapping | None = None, events: Sequence[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """Rows grouped by category with COUNT and summaries: one shuffle of partial aggregates."""
    cats = [category(df, k, v) for k, v in categories.items()]
    binned = df.select("*", *[c.alias(n) for n, c, _ in cats])
    aggs = _summaries(summaries, _events(events), False)
    out = binned.groupBy(*[n for n, _, _ in cats]).agg(F.count("*").alias("COUNT"), *[a.alias(n) for n, a in aggs.items()])
    return out, {n: b for n, _, b in cats}


def at_risk_flags(df: DataFrame, subject: str, entry: Column, leave: Column) -> DataFrame:
    """F_AT_RISK and L_AT_RISK mark each subject's first and last interval; ties go by the other end."""
    w = Window.partitionBy(subject)
    first = F.row_number().over(w.orderBy(entry, leave))
    last = F.row_number().over(w.orderBy(leave.desc(), entry.desc()))
    return df.withColumns({"F_AT_RISK": F.when(first == 1, 1).otherwise(0), "L_AT_RISK": F.when(last == 1, 1).otherwise(0)})


def _overlaps(df: DataFrame, bins: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Each row with each bin, as an explode of a constant array: no join and no shuffle."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, b, strict=True)]) for b in bins])
    return df.select("*", F.explode(rows).alias("_bin"))


def split_user(df: DataFrame, entry: str, leave: str, bins: Sequence[Bin], name: str, events: Sequence[str] = ()) -> DataFrame:
    """Pieces [max(entry, L), min(exit, U)] for each bin with entry <= U and exit >= L; events stay where L <= exit < U."""
    out = _overlaps(df, [(float(b.low), float(b.high), b.label) for b in bins], ("L", "U", "label"))
    low, high = F.col("_bin.L"), F.col("_bin.U")
    a, b = F.coalesce(F.col(entry).cast("double"), low - 1), F.coalesce(F.col(leave).cast("double"), high + 1)
    out = out.withColumns({"_a": a, "_b": b}).where((F.col("_a") <= high) & (F.col("_b") >= low))
    here = (F.col("_b") >= low) & (F.col("_b") < high)
    new = {e: F.when(here, F.col(e)).otherwise(0) for e in events}
    new |= {entry: F.greatest("_a", low), leave: F.least("_b", high), name: F.col("_bin.label")}
    out = out.withColumns(new)
    return out.withColumn(f"{name}_mid", (F.col(entry) + F.col(leave)) / 2).drop("_bin", "_a", "_b")


def split_calendar(df: DataFrame, entry: str, leave: str, starts: Sequence, names: Sequence[str] | None, name: str, events: Sequence[str] = ()) -> DataFrame:
    """Pieces of date intervals by calendar bins [start_i, start_{i+1}); the last start is the end of the last bin.

    A piece that runs past its bin ends where the next bin starts; events stay in the bin that holds the exit. In the
    last bin an exit on its end belongs to it. Rows whose exit is before their entry are dropped.
    """
    starts = list(starts)
    if any(a >= b for a, b in zip(starts, starts[1:], strict=False)):
        raise ValueError("calendar bins decrease")
    pairs = list(zip(starts, starts[1:], strict=False))
    names = names or [f"[{a}, {b})" for a, b in pairs]
    out = df.where(F.coalesce(F.col(leave) >= F.col(entry), F.lit(True)))
    out = _overlaps(out, [(a, b, n, i == len(pairs) - 1) for i, ((a, b), n) in enumerate(zip(pairs, names, strict=True))], ("L", "U", "label", "last"))
    low, high, last = F.col("_bin.L"), F.col("_bin.U"), F.col("_bin.last")
    a = F.coalesce(F.col(entry), F.add_months(low, -12))
    b = F.coalesce(F.col(leave), F.add_months(high, 12))
    out = out.withColumns({"_a": a, "_b": b}).where(((F.col("_a") < high) | (last & (F.col("_a") <= high))) & (F.col("_b") >= low))
    here = (F.col("_b") >= low) & ((F.col("_b") < high) | (last & (F.col("_b") <= high)))
    new = {e: F.when(here, F.col(e)).otherwise(0) for e in events}
    new |= {entry: F.greatest("_a", low), leave: F.least("_b", high), name: F.col("_bin.label")}
    return out.withColumns(new).drop("_bin", "_a", "_b")


def _added(date: Column, amount: float, unit: str) -> Column:
    """A date moved by years or months with the day clamped to the month's end, the fraction in days; or by days."""
    if unit == "days":
        return F.date_add(date, round(amount))
    whole = int(amount // 1)
    part = round((amount - whole) * 365.242199 / (1 if unit == "years" else 12))
    moved = F.add_months(date, whole * (12 if unit == "years" else 1))
    return F.date_add(moved, part) if part else moved


def split_age(df: DataFrame, entry: str, leave: str, reference: str, bins: Sequence[Bin], unit: str, name: str, events: Sequence[str] = ()) -> DataFrame:
    """Pieces of date intervals by time since each row's reference date; rows that enter before it are dropped."""
    out = df.where((F.col(leave) >= F.col(entry)) & (F.col(entry) >= F.col(reference)))
    spans = F.array(*[F.struct(_added(F.col(reference), b.low, unit).alias("L"), _added(F.col(reference), b.high, unit).alias("U"), F.lit(b.label).alias("label"), F.lit(i == len(bins) - 1).alias("last")) for i, b in enumerate(bins)])
    out = out.select("*", F.explode(spans).alias("_bin"))
    low, high, last = F.col("_bin.L"), F.col("_bin.U"), F.col("_bin.last")
    out = out.where(((F.col(entry) < high) | (last & (F.col(entry) <= high))) & (F.col(leave) >= low))
    here = (F.col(leave) >= low) & ((F.col(leave) < high) | (last & (F.col(leave) <= high)))
    new = {e: F.when(here, F.col(e)).otherwise(0) for e in events}
    new |= {entry: F.greatest(F.col(entry), low), leave: F.least(F.col(leave), high), name: F.col("_bin.label")}
    out = out.withColumns(new)
    mid = (F.datediff(entry, reference) + F.datediff(leave, reference)) / 2 / DAYS[unit]
    return out.withColumn(f"{name}_mid", mid).drop("_bin")


def person_time(df: DataFrame, entry: str, leave: str, scales: Sequence[Mapping], categories: Mapping | None = None, summaries: Mapping | None = None, events: Sequence[str] = (), subject: str | None = None, unit: str = "years", first: bool = True, last: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """Split on every scale in turn, bin, and sum: AT_RISK, PYR, F_AT_RISK, L_AT_RISK and summaries where PYR > 0.

    A scale is {"kind": "user", "name", "bins"}, {"kind": "calendar", "name", "starts"[, "names"]} or
    {"kind": "age", "name", "reference", "bins", "unit"}. Without a kind, a scale with a reference is an age scale, one
    with starts a calendar scale, any other one is unitless. Dates are DateType columns (or use `dated`).
    """
    scales = [{"kind": "age" if "reference" in s else "calendar" if "starts" in s else "user"} | dict(s) for s in scales]
    aliases = _events(events)
    cols = list(aliases.values())
    out, bounds, dates = df, {}, False
    for s in scales:
        if s["kind"] == "user":
            bins = parse_bins(s["bins"])
            out, bounds[s["name"]] = split_user(out, entry, leave, bins, s["name"], cols), bounds_text(bins)
        elif s["kind"] == "calendar":
            out, bounds[s["name"]], dates = split_calendar(out, entry, leave, s["starts"], s.get("names"), s["name"], cols), " ".join(map(str, s["starts"])), True
        else:
            bins = parse_bins(s["bins"])
            out, bounds[s["name"]], dates = split_age(out, entry, leave, s["reference"], bins, s.get("unit", "years"), s["name"], cols), bounds_text(bins), True
    pyr = F.datediff(leave, entry) / F.lit(DAYS[unit]) if dates else F.col(leave) - F.col(entry)
    out = out.withColumn("PYR", pyr.cast("double"))
    if subject:
        out = at_risk_flags(out, subject, F.col(entry), F.col(leave))
    cats = [category(out, k, v) for k, v in (categories or {}).items()]
    out = out.select("*", *[c.alias(n) for n, c, _ in cats])
    aggs = {"PYR": F.sum("PYR")}
    if subject:
        aggs |= {"AT_RISK": F.countDistinct(subject)}
        aggs |= ({"F_AT_RISK": F.sum("F_AT_RISK")} if first else {}) | ({"L_AT_RISK": F.sum("L_AT_RISK")} if last else {})
    aggs |= _summaries(summaries, aliases, True)
    keys = [s["name"] for s in scales] + [n for n, _, _ in cats]
    table = out.groupBy(*keys).agg(*[a.alias(f"_{i}") for i, a in enumerate(aggs.values())]).toDF(*keys, *aggs).where("PYR > 0")
    return table, bounds | {n: b for n, _, b in cats}


def dated(df: DataFrame, name: str, day: str | int, month: str | int, year: str | int) -> DataFrame:
    """A date column of day, month and year columns or numbers; missing parts are 1/1/1900."""
    part = lambda x, d: F.lit(d) if x is None else F.col(x).cast("int") if isinstance(x, str) else F.lit(x)
    return df.withColumn(name, F.make_date(part(year, 1900), part(month, 1), part(day, 1)))
