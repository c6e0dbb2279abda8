"""Risk sets as differences of cumulative sums, without a range join.

For a summand v: S(t) = sum of v with end >= t, less the sum with start >= t. Two partial aggregations by
(stratum, time) and sums that run over distinct times replace the join of rows and event times. Rows of no
length (start = end) are at risk at their own time without strata, at all times up to it with strata.

Competing-risk weights min(w / w_t, 1) make it a sum over rows with w < w_t and one over the others: sums over
a quadrant of (time, weight). Weights are ranked; each cell of a time and a rank goes to the nodes of a
tree over the ranks that a query can use, and each event time reads the nodes that make up the ranks below its
own, by cumulative sums over time within each node. So rows and event times are never joined by range. The more
rows there are for an event time, the wider and flatter the tree: a cell goes to few nodes, a time reads many.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def risk_sums(df: DataFrame, start: str, end: str, event: str, sums: Mapping[str, Column], at_events: Mapping[str, Column] | None = None, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, t, d, sums over the risk set, at_events over the events) for each event time t."""
    at_events = at_events or {}
    keys = list(strata)
    n = [*sums]
    rows = df.select(*keys, F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_b"), (F.col(event) == 1).alias("_e"), *[c.cast("double").alias(f"_s{i}") for i, c in enumerate(sums.values())], *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(at_events.values())])
    #: Each row gives +v at its end and -v at its start.
    both = F.array(F.struct(F.col("_b").alias("t"), F.lit(1.0).alias("w")), F.struct(F.col("_a").alias("t"), F.lit(-1.0).alias("w")))
    if keys:
        both = F.when(F.col("_a") == F.col("_b"), F.slice(both, 1, 1)).otherwise(both)
    flat = rows.select("*", F.explode(both).alias("_p"))
    one = F.col("_p.w") > 0
    level = F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0) if not keys else F.lit(0.0)
    per = flat.groupBy(*keys, F.col("_p.t").alias("t")).agg(
        F.sum(F.when(one & F.col("_e"), 1).otherwise(0)).alias("d"),
        *[F.sum(F.col("_p.w") * F.col(f"_s{i}")).alias(f"_c{i}") for i in range(len(n))],
        *[F.sum(F.when(one, level * F.col(f"_s{i}")).otherwise(0.0)).alias(f"_z{i}") for i in range(len(n))],
        *[F.sum(F.when(one & F.col("_e"), F.col(f"_x{i}")).otherwise(0.0)).alias(f"_y{i}") for i in range(len(at_events))],
    )
    per = running(per, "t", {f"_S{i}": F.col(f"_c{i}") for i in range(len(n))}, keys, descending=True)
    return per.where("d > 0").select(*keys, "t", "d", *[(F.col(f"_S{i}") + F.col(f"_z{i}")).alias(k) for i, k in enumerate(n)], *[F.col(f"_y{i}").alias(k) for i, k in enumerate(at_events)])


#: With at most so many distinct times, the sums of a node run in one window: it holds each time twice at most.
FEW_TIMES = 100_000


@dataclass(frozen=True)
class Shape:
    """How the tree over weights is built; results do not depend on it."""

    bits: int  # of a rank that one level of the tree takes
    few: bool  # times


def competing_shape(df: DataFrame, start: str, end: str, event: str, weight: Column, strata: Sequence[str] = ()) -> Shape:
    """By rough counts of rows, event times, times and weights: one pass, the same for all models."""
    own = F.when(F.col(event) == 1, F.hash(*strata, end))
    r = df.agg(F.count("*").alias("n"), F.approx_count_distinct(own).alias("q"), (F.approx_count_distinct(start) + F.approx_count_distinct(end)).alias("t"), F.approx_count_distinct(weight).alias("w")).first()
    most = min(10, max(1, int(math.log2(max(2, r.n / max(1, r.q))))))
    depth = math.ceil(max(1, math.log2(r.w + 1)) / most)
    return Shape(math.ceil(max(1, math.log2(r.w + 1)) / depth), r.t <= FEW_TIMES)


def competing_sums(df: DataFrame, start: str, end: str, event: str, sums: Mapping[str, Column], weight: Column, at_events: Mapping[str, Column] | None = None, strata: Sequence[str] = (), shape: Shape | None = None) -> DataFrame:
    """As risk_sums, with rows of a competing event (2) at risk for ever and each row of a risk set weighted by min(w / w_t, 1).

    w_t is the weight of the first event at t: the one with the least start, then the least weight. At risk at t are
    rows with (start < t or start = end) and end >= t, and competing ones with end <= t. shape: of competing_shape, if it is known.
    """
    shape = shape or competing_shape(df, start, end, event, weight, strata)
    at_events = at_events or {}
    keys, k = list(strata), range(len(sums))
    rows = df.select(*keys, F.col(start).cast("double").alias("_a"), F.col(end).cast("double").alias("_b"), F.col(event).cast("int").alias("_e"), weight.cast("double").alias("_w"), *[c.cast("double").alias(f"_s{i}") for i, c in enumerate(sums.values())], *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(at_events.values())])
    times = rows.where("_e = 1").groupBy(*keys, F.col("_b").alias("t")).agg(F.count("*").alias("d"), F.min_by("_w", F.struct("_a", "_w")).alias("_wt"), *[F.sum(f"_x{i}").alias(f"_y{i}") for i in range(len(at_events))])
    #: A row is at risk at the times up to its upper end (for ever if competing), less those up to its start.
    upto = F.struct(F.when(F.col("_e") == 2, float("inf")).otherwise(F.col("_b")).alias("t"), F.lit(1.0).alias("w"))
    after = F.struct(F.col("_a").alias("t"), F.lit(-1.0).alias("w"))
    flat = rows.select("*", F.explode(F.when(F.col("_a") == F.col("_b"), F.array(upto)).otherwise(F.array(upto, after))).alias("_p"))
    cells = flat.groupBy(*keys, F.col("_p.t").alias("t"), "_w").agg(*[F.sum(F.col("_p.w") * F.col(f"_s{i}")).alias(f"_v{i}") for i in k])
    weights = rows.select("_w").where("_w is not null").distinct()
    ranks = running(weights, "_w", {"_r": F.lit(1)}).withColumn("_r", (F.col("_r") - 1).cast("int")).crossJoin(F.broadcast(weights.agg(F.count("*").alias("_n"))))
    #: Level -1 holds everything; a node of level l holds the ranks that agree but for their last l * bits bits.
    last, levels = (1 << shape.bits) - 1, f"sequence(0, cast(log2(_n) as int) div {shape.bits})"
    node, digit = f"shiftright(_r, l * {shape.bits})", f"shiftright(_r, l * {shape.bits}) % {last + 1}"
    all_ = "array(struct(-1 as l, 0 as node))"
    places = F.expr(f"concat({all_}, transform(filter({levels}, l -> {digit} < {last}), l -> struct(l, {node} as node)))")
    below = F.expr(f"concat({all_}, flatten(transform({levels}, l -> transform(filter(sequence(1, {last}), j -> j <= {digit}), j -> struct(l, {node} - j as node)))))")
    at = [F.col("_p.l").alias("_l"), F.col("_p.node").alias("_node")]
    put = cells.join(ranks, "_w").select("*", F.explode(places).alias("_p")).select("*", *at)
    put = put.groupBy(*keys, "_l", "_node", "t").agg(*[F.sum(f"_v{i}").alias(f"_v{i}") for i in k], *[F.sum(F.col("_w") * F.col(f"_v{i}")).alias(f"_u{i}") for i in k])
    ask = times.select(*keys, "t", "_wt").join(ranks, F.col("_wt") == F.col("_w")).select(*keys, "t", "_wt", F.explode(below).alias("_p")).select(*keys, "t", "_wt", *at)
    none = [F.lit(0.0).alias(f"_{c}{i}") for c in "vu" for i in k]
    both = put.withColumns({"_q": F.lit(0), "_wt": F.lit(None).cast("double")}).unionByName(ask.select(*keys, "_l", "_node", "t", *none, F.lit(1).alias("_q"), "_wt"))
    nodes, sums_ = [*keys, "_l", "_node"], {f"_{c}{i}": F.col(f"_{c}{i}") for c in "vu" for i in k}
    if shape.few:
        over = Window.partitionBy(*nodes).orderBy(F.desc("t"), "_q").rowsBetween(Window.unboundedPreceding, 0)
        read = both.withColumns({n: F.sum(c).over(over) for n, c in sums_.items()}).where("_q = 1")
    else:
        read = running(both, "t", sums_, nodes, descending=True, then=["_q"]).where("_q = 1")
    part = lambda i: F.when(F.col("_l") < 0, F.col(f"_v{i}")).otherwise(F.col(f"_u{i}") / F.col("_wt") - F.col(f"_v{i}"))
    total = read.groupBy(*keys, "t").agg(*[F.sum(part(i)).alias(n) for i, n in enumerate(sums)])
    return times.join(total, [*keys, "t"]).select(*keys, "t", "d", *sums, *[F.col(f"_y{i}").alias(n) for i, n in enumerate(at_events)])
