"""The catalogue of queries: name to DataFrame function, and name to SQL over the same tables.

The cohort of most queries: per customer, intervals between orders in days since 1995-01-01 with
event 1 where the order status is F; its covariates are the price (in 100,000) and the segment.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.risk import Element, Model, risk
from ..operators import likelihood as L
from ..operators import post, prep, tables, timedep
from ..operators.riskset import risk_sums
from ..sources.io import parquet
from ..streaming.counts import windowed_counts
from . import fit as fits

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, a (start), b (end), e (event), x (price / 100000), s (segment of the customer)."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit(dt.date(1995, 1, 1))).cast("double")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = parquet(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    o = o.withColumns({"b": day}).withColumn("a", F.lag("b").over(w)).where("a is not null")
    c = parquet(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), "a", "b", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("e"), (F.col("o_totalprice") / 100000).alias("x"), F.col("c_mktsegment").alias("s"))


COHORT = """cohort AS (SELECT * FROM (SELECT o_custkey AS id, o_orderkey AS k, lag(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a,
 datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))::DOUBLE AS b, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS e, o_totalprice / 100000 AS x, c_mktsegment AS s FROM orders JOIN customer ON o_custkey = c_custkey) WHERE a IS NOT NULL)"""


def person_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier's nation-free key: flag, tax band, pyr, events, dose."""
    li = parquet(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_quantity").alias("pyr"), F.sum(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("n"), F.avg("l_tax").alias("_t"), F.count("*").alias("_c")).select("l_returnflag", "l_suppkey", "pyr", "n", (F.col("l_suppkey") % 7).cast("double").alias("dose"))


PY = "py AS (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS pyr, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS n, (l_suppkey % 7)::DOUBLE AS dose FROM lineitem GROUP BY 1, 2)"

_QUANTITY = "CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN '0 - 10' WHEN l_quantity >= 10 AND l_quantity < 25 THEN '10 - 25' WHEN l_quantity >= 25 AND l_quantity <= 50 THEN '25 - 50' ELSE 'Unassigned' END"


def _six(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# ---- tables


@query(f"SELECT {_QUANTITY} AS l_quantity_category, l_returnflag AS l_returnflag_category, count(*) AS COUNT, sum(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END) AS cases, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1, 2")
def count_table(spark, sf_dir):
    li = parquet(spark, sf_dir, "lineitem").withColumn("closed", F.when(F.col("l_linestatus") == "F", 1).otherwise(0))
    out, _ = tables.event_count(li, {"l_quantity": "0/10/25]50", "l_returnflag": "factor"}, {"l_discount": "mean AS mean_discount"}, ["closed AS cases"])
    return _six(out, "mean_discount")


@query("SELECT CASE WHEN l_discount >= 0 AND l_discount < 0.03 THEN 'low' WHEN l_discount >= 0.03 AND l_discount < 0.07 THEN 'medium' WHEN l_discount >= 0.07 AND l_discount <= 0.09 THEN 'high' ELSE 'Unassigned' END AS band, count(*) AS COUNT, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def count_table_named_bins(spark, sf_dir):
    spec = {"lower": [0, 0.03, 0.07], "upper": [0.03, 0.07, "]0.09"], "name": ["low", "medium", "high"]}
    return tables.event_count(parquet(spark, sf_dir, "lineitem"), {"l_discount AS band": spec}, {"l_quantity": "sum AS quantity"})[0]


@query("SELECT CAST(l_linenumber AS VARCHAR) AS line, count(*) AS COUNT FROM lineitem GROUP BY 1")
def count_table_factor(spark, sf_dir):
    return tables.event_count(parquet(spark, sf_dir, "lineitem"), {"l_linenumber AS line": "factor"})[0]


@query("SELECT l_returnflag AS flag, count(*) AS COUNT, round(sum(l_tax * l_quantity), 4) AS wsum, round(coalesce(sum(l_tax * l_quantity) / nullif(sum(l_quantity), 0), 0), 6) AS wmean FROM lineitem GROUP BY 1")
def count_table_weighted(spark, sf_dir):
    out, _ = tables.event_count(parquet(spark, sf_dir, "lineitem"), {"l_returnflag AS flag": "factor"}, {"l_tax": ["weighted_sum AS wsum BY l_quantity", "mean BY l_quantity AS wmean"]})
    return out.withColumns({"wsum": F.round("wsum", 4), "wmean": F.round("wmean", 6)})


_USER = f"""WITH {COHORT}, bins(L, U, label) AS (VALUES (0.0, 500.0, '0 - 500'), (500.0, 1200.0, '500 - 1200'), (1200.0, 3000.0, '1200 - 3000')),
p AS (SELECT id, greatest(a, L) AS a, least(b, U) AS b, CASE WHEN b >= L AND b < U THEN e ELSE 0 END AS e, x, label FROM cohort JOIN bins ON a <= U AND b >= L),
f AS (SELECT *, b - a AS pyr, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS f1, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY b DESC, a DESC) = 1 THEN 1 ELSE 0 END AS l1 FROM p)
"""


@query(_USER + "SELECT label AS period, sum(pyr) AS PYR, count(DISTINCT id) AS AT_RISK, sum(f1)::BIGINT AS F_AT_RISK, sum(l1)::BIGINT AS L_AT_RISK, sum(e)::DOUBLE AS events FROM f GROUP BY 1 HAVING sum(pyr) > 0")
def person_time_user(spark, sf_dir):
    return tables.person_time(cohort(spark, sf_dir), "a", "b", [{"kind": "user", "name": "period", "bins": "0/500/1200]3000"}], events=["e AS events"], subject="id")[0]


@query(_USER + "SELECT label AS period, sum(pyr) AS PYR, count(DISTINCT id) AS AT_RISK, sum(f1)::BIGINT AS F_AT_RISK, sum(l1)::BIGINT AS L_AT_RISK, round(sum(pyr * l1), 4) AS last_time, round(coalesce(sum(pyr * l1) / nullif(sum(l1), 0), 0), 4) AS mean_last, round(coalesce(sum(e * l1 * pyr) / nullif(sum(l1 * pyr), 0), 0), 6) AS weighted_last FROM f GROUP BY 1 HAVING sum(pyr) > 0")
def person_time_xsum(spark, sf_dir):
    out = tables.person_time(cohort(spark, sf_dir), "a", "b", [{"kind": "user", "name": "period", "bins": "0/500/1200]3000"}], summaries={"PYR": ["xsum AS last_time", "xmean AS mean_last"], "e": "weighted_xmean AS weighted_last"}, subject="id")[0]
    return out.withColumns({"last_time": F.round("last_time", 4), "mean_last": F.round("mean_last", 4), "weighted_last": F.round("weighted_last", 6)})


def _spans(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("entry"), F.max(F.to_date("o_orderdate")).alias("leave"), F.max(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("e"))


_SPANS = "spans AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS entry, max(CAST(o_orderdate AS DATE)) AS leave, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS e FROM orders GROUP BY 1)"
_YEARS = [dt.date(y, 1, 1) for y in range(1995, 2004)]


@query(f"""WITH {_SPANS}, bins AS (SELECT make_date(y, 1, 1) AS L, make_date(y + 1, 1, 1) AS U, CAST(y AS VARCHAR) AS label, y = 2002 AS last FROM (SELECT unnest(range(1995, 2003)) AS y)),
p AS (SELECT id, greatest(entry, L) AS a, least(leave, U) AS b, CASE WHEN leave < U OR (last AND leave <= U) THEN e ELSE 0 END AS e, label FROM spans JOIN bins ON (entry < U OR (last AND entry <= U)) AND leave >= L)
SELECT label AS year, sum(datediff('day', a, b))::DOUBLE AS PYR, count(DISTINCT id) AS AT_RISK, sum(e)::DOUBLE AS events FROM p GROUP BY 1 HAVING sum(datediff('day', a, b)) > 0""")
def person_time_calendar(spark, sf_dir):
    scale = {"kind": "calendar", "name": "year", "starts": _YEARS, "names": [str(d.year) for d in _YEARS[:-1]]}
    return tables.person_time(_spans(spark, sf_dir), "entry", "leave", [scale], events=["e AS events"], subject="id", unit="days", first=False, last=False)[0]


@query(f"""WITH {_SPANS}, bins(lo, hi, label, last) AS (VALUES (0, 1, '0 - 1', FALSE), (1, 3, '1 - 3', FALSE), (3, 10, '3 - 10', TRUE)),
s AS (SELECT *, make_date(year(entry) - 1, month(entry), 1) AS ref FROM spans),
p AS (SELECT id, greatest(entry, CAST(ref + to_years(lo) AS DATE)) AS a, least(leave, CAST(ref + to_years(hi) AS DATE)) AS b, label FROM s JOIN bins ON (entry < ref + to_years(hi) OR (last AND entry <= ref + to_years(hi))) AND leave >= ref + to_years(lo))
SELECT label AS since, sum(datediff('day', a, b))::DOUBLE AS PYR, count(DISTINCT id) AS AT_RISK FROM p GROUP BY 1 HAVING sum(datediff('day', a, b)) > 0""")
def person_time_age(spark, sf_dir):
    df = _spans(spark, sf_dir).withColumn("ref", F.make_date(F.year("entry") - 1, F.month("entry"), F.lit(1)))
    return tables.person_time(df, "entry", "leave", [{"kind": "age", "name": "since", "reference": "ref", "bins": "0/1/3/10", "unit": "years"}], subject="id", unit="days", first=False, last=False)[0]


@query(f"WITH {COHORT} SELECT k, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY a, b, k) = 1 THEN 1 ELSE 0 END AS F_AT_RISK, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY b DESC, a DESC, k DESC) = 1 THEN 1 ELSE 0 END AS L_AT_RISK FROM cohort")
def first_last_at_risk(spark, sf_dir):
    return tables.at_risk_flags(cohort(spark, sf_dir), "id", F.col("a"), F.struct("b", "k")).select("k", "F_AT_RISK", "L_AT_RISK")


@query("SELECT date_trunc('day', ts) AS window_start, CASE WHEN value >= 0 AND value < 10 THEN '0 - 10' WHEN value >= 10 AND value <= 1000 THEN '10 - 1000' ELSE 'Unassigned' END AS value_category, count(*) AS COUNT FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, sf_dir):
    return windowed_counts(parquet(spark, sf_dir, "events"), "ts", "1 day", {"value": "0/10]1000"})


# ---- preparation


@query("SELECT event_id, coalesce(CASE WHEN value > 10 THEN NULL ELSE value END, -1.0) AS v FROM events")
def replace_missing(spark, sf_dir):
    df = parquet(spark, sf_dir, "events").select("event_id", F.when(F.col("value") > 10, None).otherwise(F.col("value")).alias("v"))
    return prep.replace_missing(df, ["v"], -1.0)


@query(f"WITH {COHORT} SELECT k, b, (SELECT min(b) - 1 FROM cohort) AS right_trunc FROM cohort")
def truncation_fill(spark, sf_dir):
    return prep.truncation_fill(cohort(spark, sf_dir), None, "b")[0].select("k", "b", "right_trunc")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus_F, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P FROM orders")
def factorize(spark, sf_dir):
    return prep.factorize(parquet(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])[0].drop("o_orderstatus")


@query('SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS "l_quantity*l_tax", l_tax + l_discount AS both FROM lineitem')
def interactions(spark, sf_dir):
    df, names = prep.interactions(parquet(spark, sf_dir, "lineitem"), ["l_quantity?*?l_tax", "l_tax?*?l_quantity", "l_tax?+?l_discount"], [None, None, "both"])
    return df.select("l_orderkey", "l_linenumber", *names)


@query('SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS "l_quantity^2" FROM lineitem')
def power(spark, sf_dir):
    return prep.power(parquet(spark, sf_dir, "lineitem"), "l_quantity", 2).select("l_orderkey", "l_linenumber", "l_quantity^2")


@query("SELECT o_orderkey, concat_ws('_', CAST(o_custkey AS VARCHAR), o_orderpriority) AS _strata_col FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority AND p.o_orderstatus = 'F')")
def strata_semi_filter(spark, sf_dir):
    return prep.strata_with_events(parquet(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F").select("o_orderkey", "_strata_col")


@query("SELECT l_orderkey, l_linenumber, l_quantity / (SELECT max(abs(l_quantity)) FROM lineitem) AS l_quantity FROM lineitem")
def normalize_max(spark, sf_dir):
    df = parquet(spark, sf_dir, "lineitem")
    return prep.normalized(df, prep.normalization(df, ["l_quantity"], "max")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT avg(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem")
def normalize_mean(spark, sf_dir):
    df = parquet(spark, sf_dir, "lineitem")
    return _six(prep.normalized(df, prep.normalization(df, ["l_quantity"], "mean")), "l_quantity").select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"WITH {COHORT} SELECT k, e AS events, 1 AS e, 0 AS g, x AS x_e, 0.0 AS x_g FROM cohort UNION ALL SELECT k, CASE WHEN x > 3 THEN 1 ELSE 0 END, 0, 1, 0.0, x FROM cohort")
def joint_stack(spark, sf_dir):
    df = cohort(spark, sf_dir).withColumn("g", F.when(F.col("x") > 3, 1).otherwise(0))
    return prep.joint_events(df, ["e", "g"], (), {"e": ["x"], "g": ["x"]}).select("k", "events", "e", "g", "x_e", "x_g")


@query("SELECT o_orderkey, datediff('day', DATE '1995-01-01', make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate)))::DOUBLE AS days FROM orders")
def time_since(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))
    return prep.time_since(o, ["m", "d", "y"], dt.date(1995, 1, 1), "days").select("o_orderkey", "days")


@query("SELECT l_orderkey, l_linenumber, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) / 7.0 AS weeks FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_shift(spark, sf_dir):
    part = lambda c, p: [F.month(c).alias(p + "m"), F.day(c).alias(p + "d"), F.year(c).alias(p + "y")]
    df = parquet(spark, sf_dir, "lineitem").join(parquet(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.select("l_orderkey", "l_linenumber", *part("o_orderdate", "o"), *part("l_shipdate", "s"))
    return prep.date_shift(df, ["om", "od", "oy"], ["sm", "sd", "sy"], "weeks", "weeks").select("l_orderkey", "l_linenumber", "weeks")


@query(f"WITH {COHORT} SELECT DISTINCT b AS t FROM cohort WHERE e = 1")
def event_times(spark, sf_dir):
    return prep.event_times(cohort(spark, sf_dir), "b", "e")


@query(f"WITH {PY}, c AS (SELECT *, 'l_returnflag_' || l_returnflag || ':dose_' || CASE WHEN dose = 0 THEN '0.0' ELSE CAST(dose AS VARCHAR) END AS comb_strata FROM py) SELECT l_returnflag, l_suppkey, comb_strata FROM c WHERE comb_strata IN (SELECT comb_strata FROM c GROUP BY 1 HAVING sum(n) > 0)")
def combined_strata(spark, sf_dir):
    return prep.combined_strata(person_years(spark, sf_dir), ["l_returnflag", "dose"], "n").select("l_returnflag", "l_suppkey", "comb_strata")


# ---- risk sets

_AT = "c.a < t.t AND t.t <= c.b OR c.a = c.b AND c.b = t.t"


@query(f"WITH {COHORT}, t AS (SELECT b AS t, count(*) AS d FROM cohort WHERE e = 1 GROUP BY 1) SELECT t.t, d, count(*)::DOUBLE AS n FROM t JOIN cohort c ON {_AT} GROUP BY 1, 2")
def risk_set_counts(spark, sf_dir):
    return risk_sums(cohort(spark, sf_dir), "a", "b", "e", {"n": F.lit(1.0)})


@query(f"WITH {COHORT}, t AS (SELECT b AS t, count(*) AS d, sum(x) AS ex FROM cohort WHERE e = 1 GROUP BY 1) SELECT t.t, d, round(sum(exp(0.1 * x)), 4) AS S0, round(sum(x * exp(0.1 * x)), 4) AS S1, round(ex, 4) AS ex FROM t JOIN cohort c ON {_AT} GROUP BY t.t, d, ex")
def risk_set_sums(spark, sf_dir):
    r = F.exp(0.1 * F.col("x"))
    out = risk_sums(cohort(spark, sf_dir), "a", "b", "e", {"S0": r, "S1": F.col("x") * r}, {"ex": F.col("x")})
    return out.withColumns({c: F.round(c, 4) for c in ("S0", "S1", "ex")})


@query(f"WITH {COHORT}, t AS (SELECT s, b AS t, count(*) AS d FROM cohort WHERE e = 1 GROUP BY 1, 2) SELECT t.s, t.t, d, count(*)::DOUBLE AS n FROM t JOIN cohort c ON c.s = t.s AND (c.a < t.t OR c.a = c.b) AND c.b >= t.t GROUP BY 1, 2, 3")
def risk_set_strata(spark, sf_dir):
    return risk_sums(cohort(spark, sf_dir), "a", "b", "e", {"n": F.lit(1.0)}, strata=["s"])


# ---- risk algebra

_E = (Element("l_tax", 0, "loglin", 0.5), Element("l_discount", 1, "lin", 0.8), Element("l_quantity", 1, "plin", 0.01), Element("l_quantity", 2, "lin", 0.02))
_T0, _T1, _T2 = "exp(0.5 * l_tax)", "(0.8 * l_discount * (1 + 0.01 * l_quantity))", "(0.02 * l_quantity)"


def _relative(form: str, sql: str, **more):
    def f(spark, sf_dir):
        out = post.relative_risk(parquet(spark, sf_dir, "lineitem"), Model(_E, form, **more))
        return _six(out, "risk").select("l_orderkey", "l_linenumber", "risk")

    f.__name__ = f"relative_risk_{form.lower()}"
    query(f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS risk FROM lineitem")(f)


_relative("M", f"{_T0} * {_T1} * {_T2}")
_relative("ME", f"{_T0} * (1 + {_T1}) * (1 + {_T2})")
_relative("A", f"{_T0} + {_T1} + {_T2}")
_relative("PA", f"{_T0} * ({_T1} + {_T2})")
_relative("PAE", f"{_T0} * (1 + {_T1} + {_T2})")
_relative("GMIX", f"{_T0} * pow((1 + {_T1}) * {_T2}, 0.3) * pow(1 + {_T1} + {_T2} - 1, 0.7)", theta=0.3, excess=(True, False))


def _dosed(name: str, elements, sql: str):
    def f(spark, sf_dir):
        out = parquet(spark, sf_dir, "lineitem").withColumn("risk", F.round(risk(Model(tuple(Element("l_quantity", 0, s, v) for s, v in elements))).v, 6))
        return out.select("l_orderkey", "l_linenumber", "risk")

    f.__name__ = f"dose_{name}"
    query(f"SELECT l_orderkey, l_linenumber, round({sql}, 6) AS risk FROM lineitem")(f)


_dosed("linthresh", [("lin_slope", 0.3), ("lin_int", 20)], "CASE WHEN l_quantity > 20 THEN 0.3 * (l_quantity - 20) ELSE 0 END")
_dosed("step", [("step_slope", 0.3), ("step_int", 20)], "CASE WHEN l_quantity >= 20 THEN 0.3 ELSE 0 END")
_dosed("quad", [("quad_slope", 0.3)], "0.3 * l_quantity * l_quantity")
_dosed("linquad", [("lin_quad_slope", 0.3), ("lin_quad_int", 20)], "CASE WHEN l_quantity < 20 THEN 0.3 * l_quantity ELSE 0.3 * l_quantity * l_quantity / 40 + 3.0 END")
_dosed("linexp", [("lin_exp_slope", 0.3), ("lin_exp_int", 20), ("lin_exp_exp_slope", 0.1)], "CASE WHEN l_quantity < 20 THEN 0.3 * l_quantity ELSE 6 + exp(ln(3.0) + 2 - 2) - exp(ln(3.0) + 2 - 0.1 * l_quantity) END")
_dosed("loglin", [("loglin_slope", 0.3), ("loglin_top", 0.05)], "0.3 * exp(0.05 * l_quantity)")


@query("SELECT l_quantity AS x, round(exp(0.02 * l_quantity), 6) AS y, round(exp((0.02 - 1.96 * 0.01) * l_quantity), 6) AS lower, round(exp((0.02 + 1.96 * 0.01) * l_quantity), 6) AS upper FROM lineitem")
def risk_curve_bounds(spark, sf_dir):
    return _six(post.risk_curve(parquet(spark, sf_dir, "lineitem"), Model((Element("l_quantity", 0, "loglin", 0.02),)), "l_quantity", 0, 0.01), "y", "lower", "upper")


# ---- likelihoods

_PM = Model((Element("CONST", 0, "loglin", -3.0), Element("dose", 1, "plin", 0.05)), "M")
_PR = "exp(-3.0) * (1 + 0.05 * dose)"


def _row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} double" for k in values))


@query(f"WITH {PY} SELECT round(sum(n * ln(pyr * {_PR}) - pyr * {_PR}), 4) AS loglik, round(2 * sum(CASE WHEN n > 0 THEN n * ln(n / (pyr * {_PR})) ELSE 0 END - (n - pyr * {_PR})), 4) AS deviance FROM py")
def poisson_loglik(spark, sf_dir):
    p = L.poisson(person_years(spark, sf_dir), _PM, "pyr", "n", order=0)
    return _row(spark, loglik=round(p.value, 4), deviance=round(p.deviance, 4))


@query(f"WITH {PY} SELECT round(sum(n - pyr * {_PR}), 4) AS score_0, round(sum(dose / (1 + 0.05 * dose) * (n - pyr * {_PR})), 4) AS score_1 FROM py")
def poisson_score(spark, sf_dir):
    p = L.poisson(person_years(spark, sf_dir), _PM, "pyr", "n", order=1)
    return _row(spark, score_0=round(float(p.gradient[0]), 4), score_1=round(float(p.gradient[1]), 4))


@query(f"WITH {PY}, s AS (SELECT l_returnflag, sum(n) AS e, sum(pyr * (1 + 0.05 * dose)) AS m, sum(n * ln(pyr * (1 + 0.05 * dose))) AS l FROM py GROUP BY 1) SELECT round(sum(l + e * ln(e / m) - e), 4) AS loglik FROM s WHERE e > 0")
def poisson_loglik_strata(spark, sf_dir):
    return _row(spark, loglik=round(L.poisson(person_years(spark, sf_dir), Model((Element("dose", 0, "plin", 0.05),)), "pyr", "n", ["l_returnflag"], 0).value, 4))


def _trials(spark, sf_dir):
    o = parquet(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("y")).withColumn("z", (F.col("o_custkey") % 5).cast("double"))


_TRIALS = "tr AS (SELECT o_custkey, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS y, (o_custkey % 5)::DOUBLE AS z FROM orders GROUP BY 1)"


def _logit(kind: str, elements, p: str):
    def f(spark, sf_dir):
        return _row(spark, loglik=round(L.logistic(_trials(spark, sf_dir), Model(tuple(elements)), "n", "y", kind, 0).value, 4))

    f.__name__ = f"logit_loglik_{kind}"
    query(f"WITH {_TRIALS}, q AS (SELECT *, {p} AS p FROM tr) SELECT round(sum(y * ln(p) + (n - y) * ln(1 - p)), 4) AS loglik FROM q")(f)


_LIN = [Element("CONST", 0, "loglin", -0.7), Element("z", 0, "loglin", 0.02)]
_logit("odds", _LIN, "exp(-0.7 + 0.02 * z) / (1 + exp(-0.7 + 0.02 * z))")
_logit("ident", _LIN, "exp(-0.7 + 0.02 * z)")
_logit("loglink", _LIN, "exp(-exp(-0.7 + 0.02 * z))")

_XM = Model((Element("x", 0, "loglin", 0.1),))
_PER = f"WITH {COHORT}, t AS (SELECT b AS t, count(*) AS d, sum(0.1 * x) AS l, sum(x) AS ex, sum(exp(0.1 * x)) AS e0 FROM cohort WHERE e = 1 GROUP BY 1), s AS (SELECT t.t, d, l, ex, e0, sum(exp(0.1 * x)) AS s0, sum(x * exp(0.1 * x)) AS s1, sum(x * x * exp(0.1 * x)) AS s2 FROM t JOIN cohort c ON {_AT} GROUP BY 1, 2, 3, 4, 5)"


@query(f"WITH {COHORT}, t AS (SELECT b AS t, count(*) AS d FROM cohort WHERE e = 1 GROUP BY 1), s AS (SELECT t.t, d, count(*) AS n FROM t JOIN cohort c ON {_AT} GROUP BY 1, 2) SELECT round(-sum(d * ln(n)), 4) AS loglik FROM s")
def cox_null_loglik(spark, sf_dir):
    return _row(spark, loglik=round(L.cox_null(cohort(spark, sf_dir), "a", "b", "e"), 4))


@query(_PER + " SELECT round(sum(l - d * ln(s0)), 4) AS loglik, round(sum(ex - d * s1 / s0), 4) AS score FROM s")
def cox_loglik_breslow(spark, sf_dir):
    p = L.cox(cohort(spark, sf_dir), _XM, "a", "b", "e", order=1)
    return _row(spark, loglik=round(p.value, 4), score=round(float(p.gradient[0]), 4))


@query(_PER + " SELECT round(sum(l) - sum(list_sum(list_transform(range(0, d), lambda i: ln(s0 - i / d * e0)))), 4) AS loglik FROM s")
def cox_loglik_efron(spark, sf_dir):
    return _row(spark, loglik=round(L.cox(cohort(spark, sf_dir), _XM, "a", "b", "e", ties="efron", order=0).value, 4))


@query(f"WITH {COHORT}, t AS (SELECT s, b AS t, count(*) AS d, sum(0.1 * x) AS l FROM cohort WHERE e = 1 GROUP BY 1, 2), q AS (SELECT t.s, t.t, d, l, sum(exp(0.1 * x)) AS s0 FROM t JOIN cohort c ON c.s = t.s AND (c.a < t.t OR c.a = c.b) AND c.b >= t.t GROUP BY 1, 2, 3, 4) SELECT round(sum(l - d * ln(s0)), 4) AS loglik FROM q")
def cox_loglik_strata(spark, sf_dir):
    return _row(spark, loglik=round(L.cox(cohort(spark, sf_dir), _XM, "a", "b", "e", ["s"], order=0).value, 4))


@query(_PER + " SELECT round(sum(d * (s2 / s0 - s1 * s1 / (s0 * s0))), 4) AS information FROM s")
def cox_information_fixed_beta(spark, sf_dir):
    return _row(spark, information=round(float(-L.cox(cohort(spark, sf_dir), _XM, "a", "b", "e").hessian[0, 0]), 4))


# ---- fits

_TIGHT = fits.Control(rate=1.0, rounds=40, epsilon=1e-10, ll_epsilon=1e-12, gradient_epsilon=1e-7, step_max=2.0)


@query(f"WITH {PY} SELECT round(sum(n) / sum(pyr * (1 + dose)), 6) AS smr FROM py")
def smr_fit(spark, sf_dir):
    df = person_years(spark, sf_dir).withColumn("rate", 1 + F.col("dose"))
    f = fits.fit_poisson(df, Model((Element("rate", 0, "lin", 0.1),)), "pyr", "n", control=_TIGHT)
    return _row(spark, smr=round(f.beta[0], 6))


@query(f"WITH {PY} SELECT 'l_returnflag_' || l_returnflag AS covariate, round(ln(sum(n) / sum(pyr)), 5) AS estimate FROM py GROUP BY 1")
def poisson_factor_fit(spark, sf_dir):
    df, names = prep.factorize(person_years(spark, sf_dir), ["l_returnflag"])
    f = fits.fit_poisson(df, Model(tuple(Element(c, 0, "loglin", -3.0) for c in names)), "pyr", "n", control=_TIGHT)
    return f.to_df(spark).select("covariate", F.round("estimate", 5).alias("estimate"))


@query(f"WITH {_TRIALS} SELECT 'z_' || CAST(CAST(z AS INTEGER) AS VARCHAR) AS covariate, round(ln(sum(y) / (sum(n) - sum(y))), 5) AS estimate FROM tr GROUP BY 1")
def logit_factor_fit(spark, sf_dir):
    df, names = prep.factorize(_trials(spark, sf_dir).withColumn("z", F.col("z").cast("int")), ["z"])
    f = fits.fit_logistic(df, Model(tuple(Element(c, 0, "loglin", -0.5) for c in names)), "n", "y", control=_TIGHT)
    return f.to_df(spark).select("covariate", F.round("estimate", 5).alias("estimate"))


@query(f"WITH {COHORT} SELECT round(sum(l), 4) AS loglik FROM (SELECT id, sum(CASE WHEN e = 1 THEN 0.1 * x END) - ln(sum(exp(0.1 * x))) AS l FROM cohort GROUP BY 1 HAVING sum(e) = 1)")
def matched_sets_b1(spark, sf_dir):
    df = cohort(spark, sf_dir)
    one = df.groupBy("id").agg(F.sum("e").alias("m")).where("m = 1").select("id")
    return _row(spark, loglik=round(L.case_control(df.join(one, "id", "left_semi"), _XM, "e", ["id"]).value, 4))


# ---- after a fit


@query(f"""WITH {COHORT}, o AS (SELECT id, max(b) AS t, max(e) AS e FROM cohort GROUP BY 1), v AS (SELECT t, sum(e)::BIGINT AS d FROM o GROUP BY 1 HAVING sum(e) > 0),
p AS (SELECT t, d, lag(t) OVER (ORDER BY t) AS pt FROM v), r AS (SELECT p.t, d, count(*) AS n FROM p JOIN o ON p.pt IS NULL OR o.t > p.pt GROUP BY 1, 2)
SELECT t, d, n, round(CASE WHEN max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS n_t,
round(sqrt(sum(coalesce(d / n / nullif(n - d, 0), 0)) OVER w) * CASE WHEN max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END, 6) AS n_se FROM r WINDOW w AS (ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def kaplan_meier(spark, sf_dir):
    return _six(post.kaplan_meier(cohort(spark, sf_dir), "id", "a", "b", "e"), "n_t", "n_se")


_BASE = f"""WITH {COHORT}, t AS (SELECT b AS t, count(*)::BIGINT AS d FROM cohort WHERE e = 1 GROUP BY 1), q AS (SELECT t.t, d, sum(exp(0.1 * x)) AS s0 FROM t JOIN cohort c ON c.a <= t.t AND t.t <= c.b GROUP BY 1, 2),
h AS (SELECT t, d, d / s0 AS base, coalesce(sum(d / s0) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ch FROM q)"""


@query(_BASE + " SELECT t, d, round(base, 6) AS base, round(ch, 6) AS ch, round(exp(-ch), 6) AS surv FROM h")
def baseline_survival(spark, sf_dir):
    return _six(post.baseline(cohort(spark, sf_dir), _XM, "a", "b", "e").select("t", "d", "base", "ch", "surv"), "base", "ch", "surv")


@query(f"""WITH {COHORT}, t AS (SELECT s, b AS t, count(*)::BIGINT AS d FROM cohort WHERE e = 1 GROUP BY 1, 2), q AS (SELECT t.s, t.t, d, sum(exp(0.1 * x)) AS s0 FROM t JOIN cohort c ON c.s = t.s AND (c.a < t.t OR c.a = c.b) AND c.b >= t.t GROUP BY 1, 2, 3)
SELECT s, t, round(exp(-coalesce(sum(d / s0) OVER (PARTITION BY s ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 6) AS surv FROM q""")
def stratified_survival(spark, sf_dir):
    return _six(post.baseline(cohort(spark, sf_dir), _XM, "a", "b", "e", ["s"]).select("s", "t", "surv"), "surv")


def _martingale_sql(select: str) -> str:
    at = lambda v: f"(SELECT CASE WHEN count(*) FILTER (t <= {v}) = 0 OR count(*) FILTER (t > {v}) = 0 THEN CASE WHEN count(*) FILTER (t <= {v}) = 0 THEN min(ch) ELSE max(ch) END ELSE max(ch) FILTER (t <= {v}) + ({v} - max(t) FILTER (t <= {v})) / (min(t) FILTER (t > {v}) - max(t) FILTER (t <= {v})) * (min(ch) FILTER (t > {v}) - max(ch) FILTER (t <= {v})) END FROM h)"
    return f"{_BASE}, times AS (SELECT DISTINCT v FROM (SELECT a AS v FROM cohort UNION ALL SELECT b FROM cohort)), z AS (SELECT v, {at('v')} AS hv FROM times), m AS (SELECT id, k, e, b, e - (y.hv - w.hv) * exp(0.1 * x) AS residual FROM cohort JOIN z w ON w.v = a JOIN z y ON y.v = b) {select}"


@query(_martingale_sql("SELECT k, round(residual, 6) AS residual FROM m"))
def martingale_rows(spark, sf_dir):
    return _six(post.martingale(cohort(spark, sf_dir), _XM, "a", "b", "e"), "residual").select("k", "residual")


@query(_martingale_sql("SELECT id, round(sum(residual), 6) AS residual, sum(e)::BIGINT AS event, max(b) AS time FROM m GROUP BY 1"))
def martingale_subjects(spark, sf_dir):
    return _six(post.martingale(cohort(spark, sf_dir), _XM, "a", "b", "e", "id"), "residual")


@query(_PER + " SELECT t, d, round(ex / d - s1 / s0, 6) AS residual_x FROM s")
def schoenfeld(spark, sf_dir):
    return _six(post.schoenfeld(cohort(spark, sf_dir), _XM, "a", "b", "e", ["x"]), "residual_x")


_AE = Model((Element("CONST", 0, "loglin", -3.0), Element("dose", 1, "lin", 0.05)), "PAE")


@query(f"WITH {PY} SELECT l_returnflag, l_suppkey, round(exp(-3.0) * pyr, 6) AS predict_bg, round(exp(-3.0) * 0.05 * dose * pyr, 6) AS predict_excess, round(n / (1 + 0.05 * dose), 6) AS caused_bg, round(n * (1 - 1 / (1 + 0.05 * dose)), 6) AS caused_excess FROM py")
def event_assignment(spark, sf_dir):
    cols = ["predict_bg", "predict_excess", "caused_bg", "caused_excess"]
    return _six(post.event_assignment(person_years(spark, sf_dir), _AE, "pyr", "n"), *cols).select("l_returnflag", "l_suppkey", *cols)


@query(f"WITH {PY}, s AS (SELECT *, sum(n) OVER w / sum(pyr * exp(-3.0) * (1 + 0.05 * dose)) OVER w AS s FROM py WINDOW w AS (PARTITION BY l_returnflag)) SELECT l_returnflag, l_suppkey, round(s * exp(-3.0) * pyr, 6) AS predict_bg, round(s * exp(-3.0) * (1 + 0.05 * dose) * pyr, 6) AS predict_total FROM s")
def event_assignment_strata(spark, sf_dir):
    cols = ["predict_bg", "predict_total"]
    return _six(post.event_assignment(person_years(spark, sf_dir), _AE, "pyr", "n", ["l_returnflag"]), *cols).select("l_returnflag", "l_suppkey", *cols)


@query(f"WITH {PY} SELECT l_returnflag, l_suppkey, round({_PR}, 6) AS Residual FROM py")
def poisson_residual(spark, sf_dir):
    return _six(post.poisson_residual(person_years(spark, sf_dir), _PM, "pyr", "n"), "Residual").select("l_returnflag", "l_suppkey", "Residual")


@query(f"WITH {PY} SELECT l_returnflag, l_suppkey, round((n - pyr * {_PR}) / sqrt(pyr * {_PR}), 6) AS Residual FROM py")
def poisson_pearson(spark, sf_dir):
    return _six(post.poisson_residual(person_years(spark, sf_dir), _PM, "pyr", "n", "pearson"), "Residual").select("l_returnflag", "l_suppkey", "Residual")


# ---- time-dependent covariates


def _users(spark, sf_dir):
    ev = parquet(spark, sf_dir, "events")
    hour = (F.unix_timestamp("ts") - F.lit(1704067200)) / 3600.0
    return ev.groupBy("user_id").agg(F.floor(F.min(hour)).cast("double").alias("a"), F.ceil(F.max(hour)).cast("double").alias("b")).withColumn("e", F.when(F.col("user_id") % 3 == 0, 1).otherwise(0))


_USERS = "u AS (SELECT user_id, floor(min(epoch(date_trunc('second', ts)) - 1704067200) / 3600.0)::DOUBLE AS a, ceil(max(epoch(date_trunc('second', ts)) - 1704067200) / 3600.0)::DOUBLE AS b, CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS e FROM events GROUP BY 1)"


@query(f"WITH {_USERS}, t AS (SELECT DISTINCT b AS t FROM u WHERE e = 1), g AS (SELECT coalesce(min(n - t), 1.0) AS gap FROM (SELECT t, lead(t) OVER (ORDER BY t) AS n FROM t)) SELECT user_id, t - gap / 2 AS a, t AS b, round(2 * ((t - a) / nullif(b - a, 0) * b + (1 - (t - a) / nullif(b - a, 0)) * a), 6) AS v, CASE WHEN t = b AND e = 1 THEN 1 ELSE 0 END AS e FROM u JOIN t ON t.t >= a AND t.t <= b CROSS JOIN g")
def time_dep_cox(spark, sf_dir):
    out = timedep.at_event_times(_users(spark, sf_dir), "a", "b", "e", ["v"], [lambda t: 2 * t], ["lin"], ["user_id"])
    return _six(out, "v")


_GRID = f"WITH {_USERS}, n AS (SELECT *, greatest(1, ceil((b - a) / 100.0))::INTEGER AS n FROM u), k AS (SELECT *, unnest(range(0, n)) AS k FROM n), p AS (SELECT user_id, a + k * 100.0 AS lo, CASE WHEN k = n - 1 THEN b ELSE a + (k + 1) * 100.0 END AS hi, (k + 0.5) / n * b + (1 - (k + 0.5) / n) * a AS v, CASE WHEN k = n - 1 THEN e ELSE 0 END AS e FROM k)"


@query(_GRID + " SELECT user_id, round(lo + 0.1 * (hi - lo), 6) AS a, hi AS b, round(v, 6) AS v, e FROM p")
def time_dep_grid(spark, sf_dir):
    return _six(timedep.on_grid(_users(spark, sf_dir), "a", "b", "e", 100.0, ["v"], [lambda t: t], ["lin"], ["user_id"]), "a", "v")


@query(_GRID + " SELECT user_id, hi AS b, (CASE WHEN v >= 200 THEN 1 ELSE 0 END + CASE WHEN v < 500 THEN 1 ELSE 0 END)::DOUBLE AS v FROM p")
def time_dep_step(spark, sf_dir):
    return timedep.on_grid(_users(spark, sf_dir), "a", "b", "e", 100.0, ["v"], [lambda t: t], ["step?200g?500b?"], ["user_id"]).select("user_id", "b", "v")
