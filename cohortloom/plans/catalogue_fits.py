"""Queries of fits, formulas, bounds and tables after a fit; their SQL finds estimates by its own Newton steps (recursive queries)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions.risk import Element, Model
from ..operators import likelihood as L
from ..operators import post, prep, tables
from ..operators.riskset import competing_sums
from ..sources import io
from . import fit as fits
from .catalogue import _AT, _LIN, _PER, _PM, _PR, _TIGHT, _TRIALS, _USER, _USERS, _XM, COHORT, PY, _row, _six, _trials, _users, cohort, person_years, query
from .formula import parse, register
from .runs import run, run_joint

STILL = fits.Control(rounds=0)
Q95 = 3.841458820694124


def _estimates(spark, fit, digits=5):
    return fit.to_df(spark).select("covariate", F.round("estimate", digits).alias("estimate"), F.round("standard_error", digits).alias("standard_error"))


# ---- Poisson: exp(b0) (1 + b1 dose), by Fisher steps over the seven doses


def _fisher(doses: str = "SELECT 0 AS r, dose, sum(n)::DOUBLE AS n, sum(pyr)::DOUBLE AS t FROM py GROUP BY 2", link: str = "1 + b1 * dose", slope: str = "dose / (1 + b1 * dose)", start: str = "-3.0::DOUBLE, 0.05::DOUBLE") -> str:
    """CTE best(r, b0, b1, i00, i01, i11): the estimates for each realization r and their information."""
    mu, v = f"exp(b0) * ({link}) * t", f"({slope})"
    sums = f"sum(n - {mu}) AS u0, sum({v} * (n - {mu})) AS u1, sum({mu}) AS i00, sum({mu} * {v}) AS i01, sum({mu} * {v} * {v}) AS i11"
    step = "b0 + (i11 * u0 - i01 * u1) / (i00 * i11 - i01 * i01), b1 + (i00 * u1 - i01 * u0) / (i00 * i11 - i01 * i01)"
    return f"""cells AS ({doses}), it AS (SELECT DISTINCT r, 0 AS k, {start.replace(",", " AS b0,", 1)} AS b1 FROM cells
UNION ALL SELECT r, k + 1, {step} FROM (SELECT r, k, b0, b1, {sums} FROM it JOIN cells USING (r) GROUP BY r, k, b0, b1) WHERE k < 25),
best AS (SELECT r, b0, b1, {sums} FROM it JOIN cells USING (r) WHERE k = 25 GROUP BY r, b0, b1)"""


_TWO = "SELECT 'CONST' AS covariate, round(b0, 5) AS estimate, round(sqrt(i11 / (i00 * i11 - i01 * i01)), 5) AS standard_error FROM best UNION ALL SELECT 'dose', round(b1, 5), round(sqrt(i00 / (i00 * i11 - i01 * i01)), 5) FROM best"


@query(f"WITH RECURSIVE {PY}, {_fisher()} {_TWO}")
def poisson_fit(spark, sf_dir):
    return _estimates(spark, fits.fit_poisson(person_years(spark, sf_dir), _PM, "pyr", "n", control=_TIGHT))


_LOGLINEAR = Model((Element("CONST", 0, "loglin", -3.0), Element("dose", 0, "loglin", 0.0)))
_LOGCELLS = _fisher(link="exp(b1 * dose)", slope="dose", start="-3.0::DOUBLE, 0.0::DOUBLE")


@query(f"WITH {PY} SELECT 'CONST' AS covariate, round(ln(sum(n) / sum(pyr * exp(0.01 * dose))), 5) AS estimate FROM py UNION ALL SELECT 'dose', 0.01")
def poisson_constraint_fit(spark, sf_dir):
    f = fits.fit_poisson(person_years(spark, sf_dir), _LOGLINEAR, "pyr", "n", constraints=([[0.0, 1.0]], [0.01]), control=_TIGHT)
    return f.to_df(spark).select("covariate", F.round("estimate", 5).alias("estimate"))


@query(f"WITH {PY} SELECT method, round(ln(sum(n) / sum(pyr)), 2) AS estimate FROM py, (SELECT unnest(['gradient']) AS method) GROUP BY 1")
def poisson_gradient_fit(spark, sf_dir):
    df = person_years(spark, sf_dir).persist()
    n = df.agg(F.sum("n")).first()[0]
    got = []
    for method, rate in (("gradient", 0.5 / n),):
        c = fits.Control(method=method, rate=rate, rounds=15, epsilon=1e-7, ll_epsilon=1e-9, gradient_epsilon=1e-3)
        got.append((method, round(fits.fit_poisson(df, Model((Element("CONST", 0, "loglin", -3.5),)), "pyr", "n", control=c).beta[0], 2)))
    df.unpersist()
    return spark.createDataFrame(got, "method string, estimate double")


@query(f"WITH {PY} SELECT 'l_returnflag_' || l_returnflag AS covariate, round(ln(sum(n) / sum(pyr)), 4) AS estimate FROM py GROUP BY 1")
def best_start_fit(spark, sf_dir):
    """Several starting points, one of them infeasible."""
    df, names = prep.factorize(person_years(spark, sf_dir).persist(), ["l_returnflag"])
    m = Model(tuple(Element(c, 0, "lin", 0.1) for c in names))
    best = fits.fit_best(lambda x: fits.fit_poisson(df, x, "pyr", "n", control=_TIGHT), m, [[-1.0] * len(names), [0.02] * len(names), [0.03] * len(names)])
    return spark.createDataFrame([(e.column, e.value) for e in best.model.elements], "covariate string, value double").select("covariate", F.round(F.ln("value"), 4).alias("estimate"))


@query(f"WITH RECURSIVE {PY}, {_fisher('SELECT r, CASE WHEN r = 0 THEN dose ELSE dose * 1.1 END AS dose, sum(n)::DOUBLE AS n, sum(pyr)::DOUBLE AS t FROM py, (SELECT unnest([0, 1]) AS r) GROUP BY 1, 2')} SELECT r AS realization, round(b0, 5) AS b0, round(b1, 5) AS b1 FROM best")
def multi_realization_fit(spark, sf_dir):
    df = person_years(spark, sf_dir).withColumns({"dose_0": F.col("dose"), "dose_1": F.col("dose") * 1.1})
    got = fits.fit_realizations(lambda m: fits.fit_poisson(df, m, "pyr", "n", control=_TIGHT), _PM, {"dose": ["dose_0", "dose_1"]})
    return spark.createDataFrame([(i, round(f.beta[0], 5), round(f.beta[1], 5)) for i, f in enumerate(got)], "realization int, b0 double, b1 double")


@query(f"WITH RECURSIVE {PY}, {_fisher('SELECT 0 AS r, CASE WHEN q = 0 THEN dose ELSE dose * 1.1 END AS dose, sum(n)::DOUBLE AS n, sum(pyr)::DOUBLE AS t FROM py, (SELECT unnest([0, 1]) AS q) GROUP BY 2')} SELECT round(b0, 4) AS b0, round(b1, 4) AS b1 FROM best")
def averaged_fit(spark, sf_dir):
    """Monte Carlo maximum likelihood: the mean of the realizations' likelihoods is maximized."""
    df = person_years(spark, sf_dir).withColumns({"dose_0": F.col("dose"), "dose_1": F.col("dose") * 1.1}).persist()
    f = fits.fit_averaged(lambda m, order: L.poisson(df, m, "pyr", "n", (), order), _PM, {"dose": ["dose_0", "dose_1"]}, _TIGHT)
    df.unpersist()
    return _row(spark, b0=round(f.beta[0], 4), b1=round(f.beta[1], 4))


@query(f"WITH RECURSIVE {PY}, {_fisher()} {_TWO}")
def normalized_fit(spark, sf_dir):
    """A run on columns divided by their largest value gives the estimates and errors of the columns as given."""
    return _estimates(spark, run("Poisson(pyr, n) ~ loglinear(CONST, 0) + plinear(dose, 0)", person_years(spark, sf_dir), [-3.0, 0.05], control=_TIGHT, norm="max"))


@query(f"WITH {PY} SELECT 'one_' || event AS covariate, round(ln(sum(y) / sum(pyr)), 5) AS estimate FROM (SELECT 'n' AS event, n AS y, pyr FROM py UNION ALL SELECT 'many', CASE WHEN pyr > 400 THEN 1 ELSE 0 END, pyr FROM py) GROUP BY 1 HAVING sum(y) > 0")
def joint_poisson_fit(spark, sf_dir):
    df = person_years(spark, sf_dir).withColumns({"one": F.lit(1.0), "many": F.when(F.col("pyr") > 400, 1).otherwise(0)})
    f = run_joint(["Poisson(pyr, n) ~ loglinear(one, 0)", "Poisson(pyr, many) ~ loglinear(one, 0)"], df, [-3.0, -6.0], control=_TIGHT)
    return f.to_df(spark).select("covariate", F.round("estimate", 5).alias("estimate"))


@query(f"WITH {_TRIALS} SELECT event, 'z_' || CAST(CAST(z AS INTEGER) AS VARCHAR) AS covariate, round(ln(sum(q) / (sum(n) - sum(q))), 5) AS estimate FROM (SELECT 'y' AS event, z, n, y AS q FROM tr UNION ALL SELECT 'y2', z, n, n - y FROM tr) GROUP BY 1, 2")
def logit_outcomes_fit(spark, sf_dir):
    df, names = prep.factorize(_trials(spark, sf_dir).withColumns({"z": F.col("z").cast("int"), "y2": F.col("n") - F.col("y")}), ["z"])
    got = fits.fit_outcomes(df, Model(tuple(Element(c, 0, "loglin", 0.1) for c in names)), "n", ["y", "y2"], control=_TIGHT)
    rows = [(e, c, b) for e, f in zip(("y", "y2"), got, strict=True) for c, b in zip(names, f.beta, strict=True)]
    return spark.createDataFrame(rows, "event string, covariate string, estimate double").withColumn("estimate", F.round("estimate", 5))


# ---- Cox, Fine-Gray: one slope, by Newton steps over risk sets


def _newton(pairs: str, score: str, rounds: int = 9, weight: str = "1") -> str:
    """CTE best(beta, i) from pairs (t and other keys, d, ex, x, own); score uses s0, s1, e0, e1, d, ex."""
    sums = f"sum({weight} * exp(beta * x)) AS s0, sum({weight} * x * exp(beta * x)) AS s1, sum({weight} * x * x * exp(beta * x)) AS s2, sum(own * exp(beta * x)) AS e0, sum(own * x * exp(beta * x)) AS e1"
    both = f"SELECT k, beta, sum({score}) AS u, sum(d * (s2 / s0 - s1 * s1 / (s0 * s0))) AS i FROM (SELECT k, beta, g, t, d, ex, {sums} FROM it, pairs WHERE %s GROUP BY k, beta, g, t, d, ex) GROUP BY k, beta"
    return f"pairs AS MATERIALIZED ({pairs}), it AS (SELECT 0 AS k, 0.0::DOUBLE AS beta UNION ALL SELECT k + 1, beta + u / i FROM ({both % f'k < {rounds}'})), best AS ({both % f'k = {rounds}'})"


_ONE = "SELECT 'x' AS covariate, round(beta, 5) AS estimate, round(1 / sqrt(i), 5) AS standard_error FROM best"
_BRESLOW = "ex - d * s1 / s0"
_EFRON = "ex - list_sum(list_transform(range(0, d), lambda j: (s1 - j / d * e1) / (s0 - j / d * e0)))"
_COX = f"WITH RECURSIVE {COHORT}, t AS (SELECT b AS t, count(*) AS d, sum(x) AS ex FROM cohort WHERE e = 1 GROUP BY 1), " + _newton(f"SELECT 0 AS g, t.t, d, ex, x, 0 AS own FROM t JOIN cohort c ON {_AT}", _BRESLOW) + " " + _ONE
_STRATA = f"WITH RECURSIVE {COHORT}, t AS (SELECT s, b AS t, count(*) AS d, sum(x) AS ex FROM cohort WHERE e = 1 GROUP BY 1, 2), " + _newton(
    "SELECT t.s AS g, t.t, d, ex, x, CASE WHEN c.e = 1 AND c.b = t.t THEN 1 ELSE 0 END AS own FROM t JOIN cohort c ON c.s = t.s AND (c.a < t.t OR c.a = c.b) AND c.b >= t.t", _EFRON, 12
) + " " + _ONE


@query(_COX)
def cox_fit(spark, sf_dir):
    return _estimates(spark, fits.fit_cox(cohort(spark, sf_dir), _XM.at([0.0]), "a", "b", "e", control=_TIGHT))


@query(_STRATA)
def cox_fit_strata_efron(spark, sf_dir):
    c = fits.Control(**{**vars(_TIGHT), "ties": "efron"})
    return _estimates(spark, fits.fit_cox(cohort(spark, sf_dir), _XM.at([0.0]), "a", "b", "e", ["s"], control=c))


@query(_COX)
def formula_cox_fit(spark, sf_dir):
    return _estimates(spark, run("Cox(a, b, e) ~ loglinear(x, 0)", cohort(spark, sf_dir), [0.0], control=_TIGHT))


#: Competing events and weights that differ at one time; w_t is that of the event with the least start, then the least weight.
_CRW = f"{COHORT}, r AS (SELECT *, CASE WHEN e = 0 AND k % 5 = 0 THEN 2 ELSE e END AS ev, (1 + (k % 3) / 10.0) / (1 + b / 1000) AS w FROM cohort)"


def _first_weight(keys: str) -> str:
    return f"f AS (SELECT *, row_number() OVER (PARTITION BY {keys}b ORDER BY a, w) AS rn FROM r WHERE ev = 1), t AS (SELECT {keys}b AS t, count(*) AS d, sum(x) AS ex, max(CASE WHEN rn = 1 THEN w END) AS wt FROM f GROUP BY ALL)"


_IN = "((c.a < t.t OR c.a = c.b) AND c.b >= t.t OR c.ev = 2 AND c.b <= t.t)"


def _competing(spark, sf_dir):
    return cohort(spark, sf_dir).withColumns({"ev": F.when((F.col("e") == 0) & (F.col("k") % 5 == 0), 2).otherwise(F.col("e")), "w": (1 + (F.col("k") % 3) / 10.0) / (1 + F.col("b") / 1000)})


@query(f"WITH {_CRW}, {_first_weight('s, ')} SELECT t.s, t.t, d, round(sum(least(w / wt, 1)), 5) AS n FROM t JOIN r c ON c.s = t.s AND {_IN} GROUP BY 1, 2, 3")
def risk_set_competing(spark, sf_dir):
    return competing_sums(_competing(spark, sf_dir), "a", "b", "ev", {"n": F.lit(1.0)}, F.col("w"), strata=["s"]).withColumn("n", F.round("n", 5))


@query(f"WITH {_CRW}, {_first_weight('')} SELECT t.t, d, round(sum(least(w / wt, 1) * x), 4) AS n FROM t JOIN r c ON {_IN} GROUP BY 1, 2")
def risk_set_competing_all(spark, sf_dir):
    return competing_sums(_competing(spark, sf_dir), "a", "b", "ev", {"n": F.col("x")}, F.col("w")).withColumn("n", F.round("n", 4))


@query(f"WITH {_CRW}, {_first_weight('s, ')}, q AS (SELECT t.s, t.t, d, ex, sum(least(w / wt, 1) * exp(0.1 * x)) AS s0 FROM t JOIN r c ON c.s = t.s AND {_IN} GROUP BY 1, 2, 3, 4) SELECT round(sum(0.1 * ex - d * ln(s0)), 4) AS loglik FROM q")
def fine_gray_loglik(spark, sf_dir):
    return _row(spark, loglik=round(L.cox(_competing(spark, sf_dir), _XM, "a", "b", "ev", ["s"], order=0, weight="w").value, 4))


@query(f"WITH {_CRW}, {_first_weight('s, ')}, q AS (SELECT t.s, t.t, d, ex, sum(least(w / wt, 1) * exp(0.1 * x)) AS s0 FROM t JOIN r c ON c.s = t.s AND {_IN} GROUP BY 1, 2, 3, 4) SELECT round(sum(0.1 * ex - d * ln(s0)), 4) AS loglik FROM q")
def formula_fine_gray(spark, sf_dir):
    """Score-only: no rounds, the likelihood at the given value."""
    return _row(spark, loglik=round(run("FineGray_Strata(a, b, ev, s, w) ~ loglinear(x, 0)", _competing(spark, sf_dir), [0.1], control=STILL).loglik, 4))


@query(f"WITH RECURSIVE {_CRW}, {_first_weight('')}, " + _newton(f"SELECT 0 AS g, t.t, d, ex, x, 0 AS own, least(w / wt, 1) AS wr FROM t JOIN r c ON {_IN}", _BRESLOW, 7, "wr") + " " + _ONE)
def fine_gray_fit(spark, sf_dir):
    return _estimates(spark, run("fg(a, b, ev, w) ~ loglinear(x, 0)", _competing(spark, sf_dir), [0.0], control=_TIGHT))


@query(f"WITH {COHORT}, t AS (SELECT b AS t, count(*) AS d FROM cohort WHERE e = 1 GROUP BY 1), s AS (SELECT t.t, d, count(*) AS n FROM t JOIN cohort c ON {_AT} GROUP BY 1, 2) SELECT round(-sum(d * ln(n)), 4) AS loglik FROM s")
def formula_null(spark, sf_dir):
    return _row(spark, loglik=round(run("coxph(a, b, e) ~ null()", cohort(spark, sf_dir)).loglik, 4))


@query(f"WITH {COHORT}, t AS (SELECT s, b AS t, count(*) AS d, sum(0.1 * x) AS l FROM cohort WHERE e = 1 GROUP BY 1, 2), q AS (SELECT t.s, t.t, d, l, sum(exp(0.1 * x)) AS s0 FROM t JOIN cohort c ON c.s = t.s AND (c.a < t.t OR c.a = c.b) AND c.b >= t.t GROUP BY 1, 2, 3, 4) SELECT round(sum(l - d * ln(s0)), 4) AS loglik FROM q")
def formula_cox_strata(spark, sf_dir):
    return _row(spark, loglik=round(run("Cox_Strata(tstart = a, tend = b, ev = e, str = s) ~ loglinear(x, 0)".replace("ev =", "event ="), cohort(spark, sf_dir), [0.1], control=STILL).loglik, 4))


# ---- expected information


@query(f"WITH {COHORT}, t AS (SELECT b AS t, count(*) AS d FROM cohort WHERE e = 1 GROUP BY 1), q AS (SELECT d, t.t, sum(1 + 0.5 * x) AS s0, sum(x) AS s1, sum(x * x / (1 + 0.5 * x)) AS s2 FROM t JOIN cohort c ON {_AT} GROUP BY 1, 2) SELECT round(sum(d * (s2 / s0 - s1 * s1 / (s0 * s0))), 3) AS information FROM q")
def cox_expected_information(spark, sf_dir):
    m = Model((Element("x", 0, "plin", 0.5),))
    return _row(spark, information=round(float(-L.cox(cohort(spark, sf_dir), m, "a", "b", "e", expected=True).hessian[0, 0]), 3))


@query(f"WITH {PY} SELECT round(sum(i), 4) AS information FROM (SELECT sum(n) * (sum(pyr * dose * dose / (1 + 0.05 * dose)) / sum(pyr * (1 + 0.05 * dose)) - power(sum(pyr * dose) / sum(pyr * (1 + 0.05 * dose)), 2)) AS i FROM py GROUP BY l_returnflag)")
def poisson_expected_information(spark, sf_dir):
    p = L.poisson(person_years(spark, sf_dir), Model((Element("dose", 0, "plin", 0.05),)), "pyr", "n", ["l_returnflag"], expected=True)
    return _row(spark, information=round(float(-p.hessian[0, 0]), 4))


@query(f"WITH {_TRIALS}, q AS (SELECT n, z, exp(-0.7 + 0.02 * z) AS p FROM tr) SELECT round(sum(n * p / (1 - p)), 4) AS i00, round(sum(n * p / (1 - p) * z), 4) AS i01, round(sum(n * p / (1 - p) * z * z), 4) AS i11 FROM q")
def logit_expected_information(spark, sf_dir):
    h = -L.logistic(_trials(spark, sf_dir), Model(tuple(_LIN)), "n", "y", "ident", expected=True).hessian
    return _row(spark, i00=round(float(h[0, 0]), 4), i01=round(float(h[0, 1]), 4), i11=round(float(h[1, 1]), 4))


_PHI = "(0.5 + list_sum(list_transform(range(0, 400), lambda i: exp(-power((i + 0.5) * u / 400, 2) / 2))) * u / 400 / sqrt(2 * pi()))"


@query(f"WITH {_TRIALS}, c AS (SELECT z, sum(n) AS n, sum(y) AS y, exp(-0.7 + 0.02 * z) AS u FROM tr GROUP BY 1), q AS (SELECT n, y, {_PHI} AS p FROM c) SELECT round(sum(y * ln(p) + (n - y) * ln(1 - p)), 1) AS loglik FROM q")
def logit_loglik_probit(spark, sf_dir):
    return _row(spark, loglik=round(L.logistic(_trials(spark, sf_dir), Model(tuple(_LIN)), "n", "y", "probit", 0).value, 1))


# ---- matched sets: B(m, n) and its derivatives over the rows of each set, so the conditional form (threshold None) whatever the cases


def _sets(name: str, beta: str, rows: str = "sets") -> str:
    """CTEs: the polynomials of each set with risks exp(beta x), then name(score, info, loglik)."""
    up = lambda q, more: f"list_transform(range(1, m + 2), lambda j: {q}[j] + CASE WHEN j > 1 THEN {more} ELSE 0 END)"
    zero = "list_transform(range(0, m + 1), lambda j: 0.0::DOUBLE)"
    return f"""{name}_p AS (SELECT id, 0 AS n, any_value(c) AS c, any_value(m) AS m, list_transform(range(0, any_value(m) + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, {zero.replace("m + 1", "any_value(m) + 1")} AS p1, {zero.replace("m + 1", "any_value(m) + 1")} AS p2 FROM {rows} GROUP BY id
UNION ALL SELECT id, n, c, m, {up("p", "r * p[j - 1]")}, {up("p1", "r * p1[j - 1] + x * r * p[j - 1]")}, {up("p2", "r * p2[j - 1] + 2 * x * r * p1[j - 1] + x * x * r * p[j - 1]")} FROM (SELECT w.id, w.n, w.c, w.m, p, p1, p2, w.x AS x, exp({beta} * w.x) AS r FROM {name}_p s JOIN {rows} w ON w.id = s.id AND w.n = s.n + 1)),
{name} AS (SELECT (SELECT sum(x) FROM {rows} WHERE e = 1) - sum(p1[m + 1] / p[m + 1]) AS score, sum(p2[m + 1] / p[m + 1] - power(p1[m + 1] / p[m + 1], 2)) AS info, (SELECT sum({beta} * x) FROM {rows} WHERE e = 1) - sum(ln(p[m + 1])) AS loglik FROM {name}_p WHERE n = c)"""


_SETS = f"{COHORT}, sets AS (SELECT * FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) AS n, x, e, (sum(e) OVER (PARTITION BY id))::BIGINT AS m, count(*) OVER (PARTITION BY id) AS c FROM cohort) WHERE m > 0)"
_SETS_NEWTON = f"WITH RECURSIVE {_SETS}, b0 AS (SELECT 0.0::DOUBLE AS beta), " + ", ".join(_sets(f"s{i}", f"(SELECT beta FROM b{i})") + f", b{i + 1} AS (SELECT (SELECT beta FROM b{i}) + score / info AS beta FROM s{i})" for i in range(4)) + ", " + _sets("s4", "(SELECT beta FROM b4)")


@query(f"WITH RECURSIVE {_SETS}, {_sets('q', '0.1')} SELECT round(loglik, 4) AS loglik, round(score, 4) AS score, round(info, 4) AS information FROM q")
def matched_sets_loglik(spark, sf_dir):
    """All sets, of one case or many; the information is the observed one, which for log-linear risks is the expected one."""
    p = L.case_control(prep.strata_with_events(cohort(spark, sf_dir), ["id"], F.col("e") == 1), _XM, "e", ["id"], threshold=None)
    return _row(spark, loglik=round(p.value, 4), score=round(float(p.gradient[0]), 4), information=round(float(-p.hessian[0, 0]), 4))


@query(_SETS_NEWTON + " SELECT 'x' AS covariate, round((SELECT beta FROM b4), 4) AS estimate, round(1 / sqrt(info), 4) AS standard_error FROM s4")
def casecontrol_fit(spark, sf_dir):
    return _estimates(spark, fits.fit_case_control(cohort(spark, sf_dir), _XM.at([0.0]), "e", ["id"], threshold=None, control=_TIGHT), 4)


@query(f"WITH RECURSIVE {_SETS}, {_sets('q', '0.1')} SELECT round(loglik, 4) AS loglik FROM q")
def formula_casecontrol_strata(spark, sf_dir):
    return _row(spark, loglik=round(run("CaseControl_Strata(e, id) ~ loglinear(x, 0)", cohort(spark, sf_dir), [0.1], control=STILL, threshold=None).loglik, 4))


_UAT = "c.a < t.t AND t.t <= c.b"


def _dosed_users(spark, sf_dir):
    return _users(spark, sf_dir).withColumns({"x": (F.col("user_id") % 11) / 10, "g": F.col("user_id") % 4})


_DOSED = f"{_USERS}, du AS (SELECT *, (user_id % 11) / 10 AS x, user_id % 4 AS g FROM u)"


@query(f"WITH {_DOSED}, t AS (SELECT DISTINCT b AS t FROM du WHERE e = 1) SELECT t.t, count(*) AS n, count(*) FILTER (c.b = t.t AND c.e = 1) AS cases, round(sum(x), 4) AS x FROM t JOIN du c ON {_UAT} GROUP BY 1")
def matched_time_sets(spark, sf_dir):
    m = L.matched_rows(_dosed_users(spark, sf_dir), "a", "b", "e")
    return m.groupBy(F.col("_t").alias("t")).agg(F.count("*").alias("n"), F.sum("_case").alias("cases"), F.round(F.sum("x"), 4).alias("x"))


@query(f"WITH {_DOSED}, t AS (SELECT DISTINCT g, b AS t FROM du WHERE e = 1) SELECT t.g, t.t, count(*) AS n, count(*) FILTER (c.b = t.t AND c.e = 1) AS cases, round(sum(x), 4) AS x FROM t JOIN du c ON c.g = t.g AND {_UAT} GROUP BY 1, 2")
def matched_time_strata_sets(spark, sf_dir):
    m = L.matched_rows(_dosed_users(spark, sf_dir), "a", "b", "e", ["g"])
    return m.groupBy("g", F.col("_t").alias("t")).agg(F.count("*").alias("n"), F.sum("_case").alias("cases"), F.round(F.sum("x"), 4).alias("x"))


_TSETS = f"{_DOSED}, t AS (SELECT DISTINCT g, b AS t FROM du WHERE e = 1), tr0 AS (SELECT t.g || ':' || t.t AS id, c.user_id, x, CASE WHEN c.b = t.t AND c.e = 1 THEN 1 ELSE 0 END AS e FROM t JOIN du c ON c.g = t.g AND {_UAT}), sets AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY user_id) AS n, x, e, (sum(e) OVER (PARTITION BY id))::BIGINT AS m, count(*) OVER (PARTITION BY id) AS c FROM tr0)"


@query(f"WITH RECURSIVE {_TSETS}, {_sets('q', '0.1')} SELECT round(loglik, 4) AS loglik FROM q")
def formula_casecontrol_time_strata(spark, sf_dir):
    """The conditional form for every set, as in the SQL: more users, more cases at a time."""
    return _row(spark, loglik=round(run("case_control_time_strata(a, b, e, g) ~ loglinear(x, 0)", _dosed_users(spark, sf_dir), [0.1], control=STILL, threshold=None).loglik, 4))


# ---- formulas


@query(f"""WITH {PY}, r AS (SELECT l_returnflag AS f, ln(sum(n) / sum(pyr)) AS b, sum(n) AS n, count(*) AS c FROM py GROUP BY 1), base AS (SELECT b FROM r WHERE f = 'A'), ll AS (SELECT sum(n * ln(pyr * exp(b)) - pyr * exp(b)) AS v, count(*) AS c FROM (SELECT py.*, r.b FROM py JOIN r ON l_returnflag = f))
SELECT CASE WHEN f = 'A' THEN 'CONST' ELSE 'l_returnflag_' || f END AS covariate, round(CASE WHEN f = 'A' THEN b ELSE b - (SELECT b FROM base) END, 5) AS estimate, round((SELECT 2 * 3 - 2 * v FROM ll), 3) AS aic, round((SELECT 3 * ln(c) - 2 * v FROM ll), 3) AS bic FROM r""".replace("n * ln(pyr * exp(b)) - pyr * exp(b)", "py_n * ln(pyr * exp(b)) - pyr * exp(b)").replace("SELECT py.*, r.b FROM", "SELECT py.n AS py_n, py.pyr, r.b FROM"))
def formula_poisson_factor(spark, sf_dir):
    f = run("pois(pyr, n) ~ loglinear(CONST, factor(l_returnflag), 0)", person_years(spark, sf_dir), [-3.0, 0.0, 0.0], control=_TIGHT)
    return f.to_df(spark).select("covariate", F.round("estimate", 5).alias("estimate"), F.lit(round(f.aic, 3)).alias("aic"), F.lit(round(f.bic, 3)).alias("bic"))


@query(f"WITH {PY}, s AS (SELECT l_returnflag, sum(n) AS e, sum(pyr * (1 + 0.05 * dose)) AS m, sum(n * ln(pyr * (1 + 0.05 * dose))) AS l FROM py GROUP BY 1) SELECT round(sum(l + e * ln(e / m) - e), 4) AS loglik FROM s WHERE e > 0")
def formula_poisson_strata(spark, sf_dir):
    return _row(spark, loglik=round(run("Poisson_Strata(pyr, n, l_returnflag) ~ plinear(dose, 0)", person_years(spark, sf_dir), [0.05], control=STILL).loglik, 4))


@query(f"WITH {_TRIALS}, r AS (SELECT z, ln(sum(y) / (sum(n) - sum(y))) AS b FROM tr GROUP BY 1) SELECT CASE WHEN z = 0 THEN 'CONST' ELSE 'z_' || CAST(CAST(z AS INTEGER) AS VARCHAR) END AS covariate, round(CASE WHEN z = 0 THEN b ELSE b - (SELECT b FROM r WHERE z = 0) END, 5) AS estimate FROM r")
def formula_logit_factor(spark, sf_dir):
    """The sixth column, a sum of others, depends on them and goes."""
    df = _trials(spark, sf_dir).withColumns({"z": F.col("z").cast("int"), "again": F.when(F.col("z").isin(1, 2), 2).otherwise(0)})
    f = run("logistic(n, y) ~ loglinear(CONST, factor(z), again, 0)", df, [-0.5, 0.0, 0.0, 0.0, 0.0], control=_TIGHT)
    return f.to_df(spark).select("covariate", F.round("estimate", 5).alias("estimate"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS l_returnflag_N, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS l_returnflag_R, round(power(l_quantity, 2), 6) AS \"l_quantity^2\", round(exp(l_tax), 6) AS l_tax_exp, round(l_discount * 2, 6) AS l_discount_twice, round(l_quantity * l_tax, 6) AS \"l_quantity:l_tax\" FROM lineitem")
def formula_columns(spark, sf_dir):
    register("twice", lambda x: 2 * x)
    f = parse("Poisson(l_quantity, l_linenumber) ~ loglinear(factor(l_returnflag), I(l_quantity^2), exp(l_tax), twice(l_discount), 0) + linear(l_quantity * l_tax, 1)", io.parquet(spark, sf_dir, "lineitem"))
    return _six(f.data, "l_quantity^2", "l_tax_exp", "l_discount_twice", "l_quantity:l_tax").select("l_orderkey", "l_linenumber", "l_returnflag_N", "l_returnflag_R", "l_quantity^2", "l_tax_exp", "l_discount_twice", "l_quantity:l_tax")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P FROM orders WHERE o_orderstatus <> 'O'")
def formula_replay(spark, sf_dir):
    """Columns of a factor made again on other rows: the levels are those of the first rows."""
    o = io.parquet(spark, sf_dir, "orders").withColumn("one", F.lit(1))
    f = parse("Poisson(o_totalprice, one) ~ loglinear(factor(o_orderstatus), 0)", o)
    return f.on(o.where("o_orderstatus <> 'O'")).select("o_orderkey", "o_orderstatus_O", "o_orderstatus_P")


def _b_spline_sql(x: str, knots: list[str], degree: int, i: int) -> str:
    """Cox and de Boor's recursion as text; the last piece is closed."""
    t = knots
    if degree == 0:
        return f"CASE WHEN {x} >= {t[i]} AND ({x} < {t[i + 1]} OR {t[i + 1]} = {t[-1]} AND {x} <= {t[i + 1]}) AND {t[i]} < {t[i + 1]} THEN 1.0 ELSE 0.0 END"
    low, high = (_b_spline_sql(x, t, degree - 1, j) for j in (i, i + 1))
    return f"(coalesce(({x} - {t[i]}) / nullif({t[i + degree]} - {t[i]}, 0) * {low}, 0) + coalesce(({t[i + degree + 1]} - {x}) / nullif({t[i + degree + 1]} - {t[i + 1]}, 0) * {high}, 0))"


_KNOTS = ["lo"] * 3 + ["mid"] + ["hi"] * 3


@query("WITH k AS (SELECT min(l_quantity) AS lo, quantile_cont(l_quantity, 0.5) AS mid, max(l_quantity) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({_b_spline_sql('l_quantity', _KNOTS, 2, i)}, 6) AS l_quantity_bs{i}" for i in (1, 2, 3)) + " FROM lineitem, k")
def formula_b_spline(spark, sf_dir):
    f = parse("Poisson(l_quantity, l_linenumber) ~ loglinear(bs(l_quantity, df=3, degree=2), 0)", io.parquet(spark, sf_dir, "lineitem"), check_rank=False)
    return _six(f.data, *[f"l_quantity_bs{i}" for i in (1, 2, 3)]).select("l_orderkey", "l_linenumber", *[f"l_quantity_bs{i}" for i in (1, 2, 3)])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_quantity AS c, 0.0 AS d FROM lineitem), f AS (SELECT bool_and(a = b) AS ab, bool_and(a = c) AS ac, bool_and(b = c) AS bc, min(a) = max(a) AS ka, min(b) = max(b) AS kb, min(c) = max(c) AS kc, min(d) = max(d) AS kd FROM l)
SELECT unnest(list_filter([CASE WHEN NOT ka THEN 'l_quantity' END, CASE WHEN NOT kb AND NOT ab THEN 'l_tax' END, CASE WHEN NOT kc AND NOT ac AND NOT bc THEN 'same' END, CASE WHEN NOT kd THEN 'zero' END], lambda v: v IS NOT NULL)) AS kept FROM f""")
def duplicate_columns(spark, sf_dir):
    df = io.parquet(spark, sf_dir, "lineitem").withColumns({"same": F.col("l_quantity"), "zero": F.lit(0.0)})
    return spark.createDataFrame([(c,) for c in prep.distinct_columns(df, ["l_quantity", "l_tax", "same", "zero"])], "kept string")


@query("""WITH l AS (SELECT l_quantity AS a, l_tax AS b, 2 * l_quantity - l_tax AS c FROM lineitem), g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc FROM l)
SELECT unnest(list_filter(['l_quantity', CASE WHEN 1 - ab * ab / (aa * bb) > 1e-9 THEN 'l_tax' END, CASE WHEN (aa * bb * cc + 2 * ab * bc * ac - ac * ac * bb - bc * bc * aa - ab * ab * cc) / (cc * (aa * bb - ab * ab)) > 1e-9 THEN 'mixed' END], lambda v: v IS NOT NULL)) AS kept FROM g""")
def independent_columns(spark, sf_dir):
    df = io.parquet(spark, sf_dir, "lineitem").withColumn("mixed", 2 * F.col("l_quantity") - F.col("l_tax"))
    return spark.createDataFrame([(c,) for c in prep.independent_columns(df, ["l_quantity", "l_tax", "mixed"])], "kept string")


# ---- bounds and tests


def _bound_sql() -> str:
    """Bisection of the profile of b1, in which b0 has a closed form, between the estimate and 20 errors beside it."""
    ll = "(SELECT sum(n) * ln(sum(n) / sum(t * exp({0} * dose))) - sum(n) + {0} * sum(n * dose) FROM cells)"
    half = lambda side: f"""{side}_it AS (SELECT 0 AS k, b1 AS near, b1 {'-' if side == 'lo' else '+'} 20 / sqrt(i11 - i01 * i01 / i00) AS far FROM best UNION ALL SELECT k + 1, CASE WHEN over THEN mid ELSE near END, CASE WHEN over THEN far ELSE mid END FROM (SELECT k, near, far, (near + far) / 2 AS mid, {ll.format('((near + far) / 2)')} >= (SELECT {ll.format('b1')} FROM best) - {Q95} / 2 AS over FROM {side}_it WHERE k < 60))"""
    return f"WITH RECURSIVE {PY}, {_LOGCELLS}, {half('lo')}, {half('hi')} SELECT round((SELECT near FROM lo_it WHERE k = 60), 3) AS lower, round((SELECT b1 FROM best), 4) AS estimate, round((SELECT near FROM hi_it WHERE k = 60), 3) AS upper"


def _bounded(spark, sf_dir, how):
    df = person_years(spark, sf_dir).persist()
    refit = lambda m: fits.fit_poisson(df, m, "pyr", "n", control=_TIGHT)
    best = refit(_LOGLINEAR)
    lo, hi = how(refit, lambda x, order: L.poisson(df, x, "pyr", "n", (), order), best)
    df.unpersist()
    return _row(spark, lower=round(lo, 3), estimate=round(best.beta[1], 4), upper=round(hi, 3))


@query(_bound_sql())
def likelihood_bound(spark, sf_dir):
    return _bounded(spark, sf_dir, lambda refit, evaluate, best: fits.venzon_moolgavkar(evaluate, best, 1))


@query(_bound_sql())
def likelihood_bound_bisection(spark, sf_dir):
    return _bounded(spark, sf_dir, lambda refit, evaluate, best: fits.likelihood_bound(refit, best, 1, tolerance=1e-5))


@query(_bound_sql())
def likelihood_bound_starts(spark, sf_dir):
    return _bounded(spark, sf_dir, lambda refit, evaluate, best: fits.bound_from_starts(refit, evaluate, best, 1, [[-2.0, 0.1], [-4.0, -0.1]]))


@query(f"WITH {PY}, r AS (SELECT sum(n) AS n, sum(pyr) AS t FROM py GROUP BY l_returnflag) SELECT round(x, 4) AS value, 2.0 AS df, round(exp(-x / 2), 5) AS p FROM (SELECT 2 * (sum(n * ln(n / t)) - sum(n) * ln(sum(n) / sum(t))) AS x FROM r)")
def ratio_test(spark, sf_dir):
    df, names = prep.factorize(person_years(spark, sf_dir), ["l_returnflag"])
    wide = fits.fit_poisson(df, Model(tuple(Element(c, 0, "loglin", -3.0) for c in names)), "pyr", "n", control=_TIGHT)
    narrow = fits.fit_poisson(df, Model((Element("CONST", 0, "loglin", -3.0),)), "pyr", "n", control=_TIGHT)
    r = fits.likelihood_ratio(wide, narrow)
    return _row(spark, value=round(r["value"], 4), df=float(r["df"]), p=round(r["p"], 5))


_AT_SLOPE = "round(pyr * exp(c), 3) AS predict_bg, round(pyr * exp(c) * (1 + s * dose), 3) AS predict_total"
_SLOPES = "SELECT 'mid' AS part, b0 AS c, b1 AS s FROM best UNION ALL SELECT part, ln((SELECT sum(n) FROM cells) / (SELECT sum(t * (1 + q * dose)) FROM cells)), q FROM (SELECT 'lower' AS part, b1 - 1.96 * se AS q FROM w UNION ALL SELECT 'upper', b1 + 1.96 * se FROM w)"


@query(f"WITH RECURSIVE {PY}, {_fisher()}, w AS (SELECT b1, sqrt(i00 / (i00 * i11 - i01 * i01)) AS se FROM best), m AS ({_SLOPES}) SELECT part, l_returnflag, l_suppkey, {_AT_SLOPE} FROM py, m")
def event_assignment_bounds(spark, sf_dir):
    df = person_years(spark, sf_dir).persist()
    m = Model((Element("CONST", 0, "loglin", -3.0), Element("dose", 1, "lin", 0.05)), "PAE")
    refit = lambda x: fits.fit_poisson(df, x, "pyr", "n", control=_TIGHT)
    out = None
    for part, one in fits.assigned_bounds(df, refit, refit(m), 1, "pyr", "n").items():
        rows = one.select(F.lit(part).alias("part"), "l_returnflag", "l_suppkey", F.round("predict_bg", 3).alias("predict_bg"), F.round("predict_total", 3).alias("predict_total"))
        out = rows if out is None else out.union(rows)
    return out


# ---- after a fit


_SE = f"""WITH {COHORT}, t AS (SELECT b AS t, count(*)::BIGINT AS d FROM cohort WHERE e = 1 GROUP BY 1), q AS (SELECT t.t, d, count(*) AS n, sum(exp(0.1 * x)) AS s0, sum(x * exp(0.1 * x)) AS s1 FROM t JOIN cohort c ON c.a <= t.t AND t.t <= c.b GROUP BY 1, 2),
h AS (SELECT t, coalesce(sum(d / s0) OVER w, 0) AS ch, coalesce(sum(coalesce(d / n / nullif(n - d, 0), 0)) OVER w, 0) AS g, coalesce(sum(d * s1 / (s0 * s0)) OVER w, 0) AS b FROM q WINDOW w AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(_SE + " SELECT t, round(ch - coalesce(lag(ch) OVER (ORDER BY t), ch), 6) AS h, round(exp(-ch), 5) AS surv, round(exp(-ch) * sqrt(g + 0.0004 * b * b), 5) AS surv_se FROM h")
def survival_errors(spark, sf_dir):
    import numpy as np

    out = post.cox_after("survival", cohort(spark, sf_dir), _XM, "a", "b", "e", covariance=np.array([[0.0004]]))
    return out.select("t", F.round("h", 6).alias("h"), F.round("surv", 5).alias("surv"), F.round("surv_se", 5).alias("surv_se"))


@query(_SE + " SELECT t, round(exp(-ch), 5) AS surv FROM h WHERE t BETWEEN 500 AND 900")
def survival_limits(spark, sf_dir):
    return post.baseline(cohort(spark, sf_dir), _XM, "a", "b", "e", limits=(500, 900)).select("t", F.round("surv", 5).alias("surv"))


@query(_PER + ", z AS (SELECT count(*) AS n FROM s) SELECT t, round((ex / d - s1 / s0) * 0.0004 * z.n + 0.1, 5) AS scaled_x FROM s, z")
def schoenfeld_scaled(spark, sf_dir):
    import numpy as np

    per = post.schoenfeld(cohort(spark, sf_dir), _XM, "a", "b", "e", ["x"])
    return post.scaled_schoenfeld(per, ["x"], np.array([[0.0004]]), [0.1]).select("t", F.round("scaled_x", 5).alias("scaled_x"))


@query(f"WITH {PY}, m AS (SELECT *, pyr * {_PR} AS mu FROM py) SELECT l_returnflag, l_suppkey, round(sign(n - mu) * sqrt(greatest(0, 2 * (CASE WHEN n > 0 THEN n * ln(n / mu) ELSE 0 END - (n - mu)))), 5) AS Residual FROM m")
def poisson_deviance(spark, sf_dir):
    return post.poisson_residual(person_years(spark, sf_dir), _PM, "pyr", "n", "deviance").select("l_returnflag", "l_suppkey", F.round("Residual", 5).alias("Residual"))


# ---- tables, files


_PIECES = _USER.replace("WITH ", "WITH h(hl, hu, half) AS (VALUES (0.0, 800.0, '0 - 800'), (800.0, 3000.0, '800 - 3000')), ", 1)


@query(_PIECES + ", g AS (SELECT id, greatest(a, hl) AS a, least(b, hu) AS b, label, half FROM p JOIN h ON a <= hu AND b >= hl) SELECT label AS period, half, sum(b - a) AS PYR, count(DISTINCT id) AS AT_RISK FROM g GROUP BY 1, 2 HAVING sum(b - a) > 0")
def person_time_two_scales(spark, sf_dir):
    scales = [{"name": "period", "bins": "0/500/1200]3000"}, {"name": "half", "bins": "0/800]3000"}]
    return tables.person_time(cohort(spark, sf_dir), "a", "b", scales, subject="id", first=False, last=False)[0]


@query(_USER + "SELECT label AS period, sum(pyr) AS PYR, count(DISTINCT id) AS AT_RISK, sum(f1)::BIGINT AS F_AT_RISK, sum(l1)::BIGINT AS L_AT_RISK, round(sum(x * l1 * pyr), 2) AS last_x, round(avg(x), 6) AS mean_x FROM f GROUP BY 1 HAVING sum(pyr) > 0")
def person_time_weighted_xsum(spark, sf_dir):
    out = tables.person_time(cohort(spark, sf_dir), "a", "b", [{"name": "period", "bins": "0/500/1200]3000"}], summaries={"x": ["weighted_xsum AS last_x", "rmean AS mean_x"]}, subject="id")[0]
    return out.withColumns({"last_x": F.round("last_x", 2), "mean_x": F.round("mean_x", 6)})


@query("SELECT 'quantity' AS category, ' [0, 10) [10, 25) [25, 50]' AS bounds, count(*) FILTER (l_quantity >= 0 AND l_quantity < 10) AS first_bin FROM lineitem")
def bounds_report(spark, sf_dir):
    out, bounds = tables.event_count(io.parquet(spark, sf_dir, "lineitem"), {"l_quantity AS quantity": "0/10/25]50"})
    return out.where("quantity = '0 - 10'").select(F.lit("quantity").alias("category"), F.lit(bounds["quantity"]).alias("bounds"), F.col("COUNT").alias("first_bin"))


def _folder(spark) -> str:
    """Where files may be shared: the checkpoint folder; a folder of its own only on one machine."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import uuid

    return f"{shared or tempfile.mkdtemp(prefix='cohortloom-')}/{uuid.uuid4().hex}"


@query(f"WITH {COHORT} SELECT id, k, a, b, e, x, s FROM cohort")
def csv_round_trip(spark, sf_dir):
    """The cohort written without a header and read again with a declared schema."""
    df, path = cohort(spark, sf_dir), _folder(spark)
    io.write(df, path, "csv")
    return io.csv(spark, path, df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), header=False)


@query(f"WITH {PY} SELECT l_returnflag, l_suppkey, dose, dose * 1.1 AS dose_0, CASE WHEN l_suppkey % 2 = 0 THEN dose + 1 END AS dose_1 FROM py")
def realization_tables(spark, sf_dir):
    """Versions of the dose from tables of their own; rows that a version lacks are null."""
    df = person_years(spark, sf_dir).withColumn("key", F.concat_ws(":", "l_returnflag", "l_suppkey"))
    versions = [df.select("key", (F.col("dose") * 1.1).alias("dose")), df.where("l_suppkey % 2 = 0").select("key", (F.col("dose") + 1).alias("dose"))]
    return io.realizations(df, versions, "key", "dose")[0].select("l_returnflag", "l_suppkey", "dose", "dose_0", "dose_1")


@query(f"WITH {COHORT}, r AS (SELECT min(b) AS lo, max(b) AS hi FROM cohort WHERE e = 1) SELECT k FROM cohort, r WHERE b >= lo AND a <= hi")
def event_window(spark, sf_dir):
    return prep.event_window(cohort(spark, sf_dir), "a", "b", "e").select("k")
