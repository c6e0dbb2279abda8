import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.dist import chi2_quantile_1, chi2_tail, normal_cdf, normal_cdf_col
from cohortloom.functions.risk import Element, Model, linked_exp_slope, risk
from cohortloom.operators import likelihood as L
from cohortloom.operators import post, prep, tables
from cohortloom.plans import fit as fits
from cohortloom.plans.formula import literal, parse, split_args
from cohortloom.plans.runs import run, run_joint

TIGHT = fits.Control(rate=1.0, rounds=60, epsilon=1e-10, ll_epsilon=1e-12, gradient_epsilon=1e-8)
SEVEN = [(a, a + 1, e, a + 3) for a, e in zip(range(7), (1, 0, 1, 0, 1, 0, 0), strict=True)]
GRADES = "alcohol int, socio int, smoker int, x int, n int"


def frame(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def test_distributions(spark):
    assert chi2_tail(2.200062, 3) == pytest.approx(0.5319362, abs=1e-6)
    assert chi2_quantile_1(0.95) == pytest.approx(3.841459, abs=1e-5)
    got = spark.range(1).select(*[normal_cdf_col(F.lit(x)).alias(str(i)) for i, x in enumerate((-2.5, 0.0, 1.3))]).first()
    assert list(got) == pytest.approx([normal_cdf(x) for x in (-2.5, 0.0, 1.3)], abs=1e-6)


@pytest.mark.parametrize("form", ["M", "ME", "A", "PA", "PAE", "GMIX"])
def test_derivatives_match_differences(spark, form):
    df = frame(spark, [(1.5, 3.0)], "x double, y double")
    parts = (Element("x", 0, "loglin", 0.2), Element("y", 0, "plin", 0.3), Element("x", 1, "lin", 0.4), Element("y", 1, "lin_exp_slope", 0.5), Element("y", 1, "lin_exp_int", 1.0), Element("y", 1, "lin_exp_exp_slope", 0.7), Element("y", 2, "lin_quad_slope", 0.3), Element("y", 2, "lin_quad_int", 2.0), Element("x", 2, "loglin_slope", 0.3), Element("x", 2, "loglin_top", 0.2))
    m = Model(parts, form, 0.4, (True, False))
    beta = np.array(m.values)
    value = lambda b: risk(m.at(b)).v
    r, step = risk(m), 1e-4
    cols = [r.v.alias("v")] + [r.g.get(i, F.lit(0.0)).alias(f"g{i}") for i in range(len(beta))] + [r.h.get((i, i), F.lit(0.0)).alias(f"h{i}") for i in range(len(beta))]
    for i in range(len(beta)):
        d = np.eye(len(beta))[i] * step
        cols += [value(beta + d).alias(f"u{i}"), value(beta - d).alias(f"d{i}")]
    got = df.select(*cols).first()
    for i in range(len(beta)):
        assert got[f"g{i}"] == pytest.approx((got[f"u{i}"] - got[f"d{i}"]) / 2 / step, rel=1e-4, abs=1e-6)
        assert got[f"h{i}"] == pytest.approx((got[f"u{i}"] - 2 * got["v"] + got[f"d{i}"]) / step**2, rel=1e-2, abs=1e-4)


def test_dates(spark):
    rows = [(1, 1, 1990, 2, 6, 2001), (1, 2, 1991, 2, 7, 2003), (2, 3, 1997, 3, 8, 2005), (2, 4, 1998, 3, 9, 2006)]
    df = frame(spark, rows, "m0 int, d0 int, y0 int, m1 int, d1 int, y1 int")
    out = prep.date_shift(df, ["m0", "d0", "y0"], ["m1", "d1", "y1"], "t")
    assert [r.t for r in out.orderBy("y0").collect()] == [4054, 4419, 2955, 2955]
    out = prep.time_since(df, ["m1", "d1", "y1"], dt.date(1997, 3, 22), "t")
    assert [r.t for r in out.orderBy("y0").collect()] == [1417, 2148, 2908, 3274]
    with pytest.raises(TypeError):
        prep.time_since(df, ["m1", "d1", "y1"], "1997-03-22", "t")


def test_factorize_names(spark):
    df = frame(spark, [(i, 1) for i in range(7)], "a int, c int")
    assert prep.factorize(df, ["a"])[1] == [f"a_{i}" for i in range(7)]
    assert prep.factorize(df, ["c"])[1] == ["c_1"]


def test_bins():
    b = tables.parse_bins("-1/-1/3/5]7")
    assert [(x.low, x.high, x.closed) for x in b] == [(-1, -1, False), (-1, 3, False), (3, 5, False), (5, 7, True)]
    assert tables.bounds_text(tables.parse_bins("0/3/5]7")) == " [0, 3) [3, 5) [5, 7]"
    with pytest.raises(ValueError):
        tables.summary("x", "mean AS y BY", {}, False)
    with pytest.raises(ValueError):
        tables.summary("x", "weighted_mean", {}, False)


def test_survival_hazards(spark):
    df = frame(spark, SEVEN, "a double, b double, c int, d double") if False else frame(spark, [(float(a), float(b), e, float(d)) for a, b, e, d in SEVEN], "a double, b double, c int, d double")
    filled, start, end = prep.truncation_fill(df, None, "b")
    got = post.baseline(filled, Model((Element("d", 0, "loglin", -0.1),)), start, end, "c").orderBy("t").collect()
    assert [r.h for r in got] == pytest.approx([0, 0.2551694, 0.3987517], abs=1e-4)


def test_logistic_goldens(spark):
    rows = [(1, 1, 1, 25, 300), (2, 1, 1, 10, 100), (3, 2, 2, 30, 250)]
    df = frame(spark, rows, GRADES)
    f = run("logit(n, x) ~ linear(CONST, 0)", df, [0.1], control=TIGHT)
    assert f.beta[0] == pytest.approx(65 / (650 - 65), abs=1e-6)
    f = run("logit(n, x) ~ linear(CONST, 0)", df, [2.0], control=TIGHT, link="loglink")
    assert f.beta[0] == pytest.approx(-math.log(65 / 650), abs=1e-5)
    assert f.aic == pytest.approx(2 - 2 * f.loglik)


def test_joint_poisson(spark):
    t0, e0, e1, fac = (0, 0, 0, 1, 1, 1), (0, 1, 2, 2, 1, 0), (1, 1, 0, 0, 1, 1), (0, 1, 1, 1, 0, 0)
    df = frame(spark, list(zip(map(float, t0), [t + 1.0 for t in t0], e0, e1, map(float, fac), [1.0] * 6, strict=True)), "t0 double, t1 double, e0 int, e1 int, fac double, pyr double")
    f = run_joint(["Poisson(pyr, e0) ~ loglin(fac, 0)", "Poisson(pyr, e1) ~ loglin(fac, 0)", "Poisson(pyr, shared) ~ plinear(t0, 0)"], df, [0.1, 0.1, 0.1], control=TIGHT)
    got = {e.column: e.value for e in f.model.elements}
    assert (got["fac_e0"], got["fac_e1"], got["t0"]) == pytest.approx((0.5742, -1.0347, -0.1845), abs=1e-2)


def test_cox_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 5, 60).astype(float)
    b = a + rng.integers(0, 6, 60)
    e, x = rng.integers(0, 2, 60), rng.normal(size=60)
    df = frame(spark, [(float(p), float(q), int(r), float(s)) for p, q, r, s in zip(a, b, e, x, strict=True)], "a double, b double, e int, x double")
    m, beta = Model((Element("x", 0, "loglin", 0.3),)), 0.3
    want = 0.0
    for t in sorted(set(b[e == 1])):
        own = (b == t) & (e == 1)
        at = ((a < t) & (t <= b)) | ((a == b) & (b == t))
        want += (beta * x[own]).sum() - own.sum() * math.log(np.exp(beta * x[at]).sum())
    p = L.cox(df, m, "a", "b", "e")
    assert p.value == pytest.approx(want, abs=1e-8)
    up, down = (L.cox(df, m.at([beta + d]), "a", "b", "e", order=0).value for d in (1e-4, -1e-4))
    assert p.gradient[0] == pytest.approx((up - down) / 2e-4, rel=1e-5)
    assert p.hessian[0, 0] == pytest.approx((up - 2 * p.value + down) / 1e-8, rel=1e-3)
    f = fits.fit_cox(df, m.at([0.0]), "a", "b", "e")
    assert f.converged and abs(f.gradient[0]) < 1e-2
    one, two = fits.likelihood_ratio(f, f)["value"], L.cox_null(df, "a", "b", "e")
    assert one == 0 and two < f.loglik


def test_matched_sets_against_enumeration(spark):
    from itertools import combinations

    x, case = [0.1, 0.5, 0.9, 1.4], [1, 0, 1, 0]
    df = frame(spark, list(zip(x, case, strict=True)), "x double, c int")
    r = np.exp(0.7 * np.array(x))
    want = math.log(r[0] * r[2]) - math.log(sum(r[i] * r[j] for i, j in combinations(range(4), 2)))
    assert L.case_control(df, Model((Element("x", 0, "loglin", 0.7),)), "c", []).value == pytest.approx(want, abs=1e-9)


def test_matched_sets_in_parts(spark):
    """Sets cut over partitions give what whole sets give: value, gradient, Hessian, a set under a null key, too low risks."""
    rng = np.random.default_rng(3)
    rows = [(s, float(rng.normal()), float(rng.normal()), int(i < m)) for s, m, n in (("a", 3, 60), (None, 2, 40), ("b", 1, 5), ("c", 0, 30), ("d", 9, 30)) for i in range(n)]
    df = frame(spark, rows, "s string, x double, z double, c int").repartition(7)
    m = Model((Element("x", 0, "loglin", 0.4), Element("z", 1, "plin", 0.05)))
    for threshold in (50, 5):
        whole, parts = (L.case_control(df, m, "c", ["s"], threshold, part_rows=k) for k in (10**6, 20))
        assert whole.value == pytest.approx(parts.value, rel=1e-10)
        assert np.allclose(whole.gradient, parts.gradient, rtol=1e-9) and np.allclose(whole.hessian, parts.hessian, rtol=1e-9)
    low = m.at([0.4, 9.0])
    whole, parts = (L.case_control(df, low, "c", ["s"], part_rows=k) for k in (10**6, 20))
    assert not whole.feasible and not parts.feasible


def brute_sets(sets, beta):
    """Value of matched sets by the plain recursion, for (x, cases) pairs of one covariate with risks exp(beta x)."""
    total = 0.0
    for x, case in sets:
        r, m = np.exp(beta * x), int(case.sum())
        b = np.eye(1, m + 1)[0]
        for one in r:
            b[1:] += one * b[:-1]
        total += beta * x[case == 1].sum() - math.log(b[m])
    return total


def test_many_small_sets_share_steps(spark, monkeypatch):
    """no call of Python for each set; sets of different sizes, over the border of a chunk, as by plain recursion."""
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(3000):
        n = int(rng.integers(1, 14))
        case = (rng.random(n) < 0.4).astype(int)
        case[0] = 1
        sets.append((rng.normal(size=n), case))
    df = frame(spark, [(i, float(v), int(c)) for i, (x, case) in enumerate(sets) for v, c in zip(x, case, strict=True)], "s int, x double, c int").coalesce(1)
    assert df.count() > L.CHUNK_ROWS

    def each(*_):
        raise AssertionError("a call for each set")

    monkeypatch.setattr(type(df.groupBy("s")), "applyInPandas", each)
    got = L.case_control(df, Model((Element("x", 0, "loglin", 0.3),)), "c", ["s"])
    at, up, down = (brute_sets(sets, 0.3 + d) for d in (0, 1e-4, -1e-4))
    assert got.value == pytest.approx(at, rel=1e-11)
    assert got.gradient[0] == pytest.approx((up - down) / 2e-4, rel=1e-5, abs=1e-4)
    assert got.hessian[0, 0] == pytest.approx((up - 2 * at + down) / 1e-8, rel=1e-3)


def test_sets_of_many_cases_keep_the_conditional_form(spark):
    """without a threshold, sets of 60 to 130 cases, nearly all rows or all of them; far more cases against closed forms."""
    rng = np.random.default_rng(9)
    sets = []
    for m, n in ((60, 90), (130, 160), (120, 400), (101, 102), (110, 110), (3, 8)):
        sets.append((rng.normal(size=n), rng.permutation(np.arange(n) < m).astype(int)))
    df = frame(spark, [(i, float(v), int(c)) for i, (x, case) in enumerate(sets) for v, c in zip(x, case, strict=True)], "s int, x double, c int")
    got = L.case_control(df, Model((Element("x", 0, "loglin", 0.3),)), "c", ["s"], threshold=None)
    at, up, down = (brute_sets(sets, 0.3 + d) for d in (0, 1e-3, -1e-3))
    assert got.value == pytest.approx(at, rel=1e-11)
    assert got.gradient[0] == pytest.approx((up - down) / 2e-3, rel=1e-5, abs=1e-4)
    assert got.hessian[0, 0] == pytest.approx((up - 2 * at + down) / 1e-6, rel=1e-3)

    #: 3,000 of 9,000: B is a double no more. Equal risks have binomials; the linear term's second derivative is not 0.
    x, g = np.full(9000, 2.0), np.column_stack([np.full(9000, 6.0), np.arange(9000) % 2.0])
    v, first, second = L._log_product_many(x, g, np.zeros((9000, 2, 2)), 3000)
    choose = math.lgamma(9001) - math.lgamma(3001) - math.lgamma(6001)
    assert v == pytest.approx(choose + 3000 * math.log(2), rel=1e-12)
    assert first == pytest.approx([9000, 750])
    #: ln B is 3000 ln(1 + 3 t) for the first; the second's score has the variance of a hypergeometric number, halved risks squared.
    assert second[0, 0] == pytest.approx(-3000 * 9, rel=1e-6)
    assert second[1, 1] == pytest.approx(3000 * (1 / 4) * (6000 / 8999) / 4 - 3000 / 8, rel=1e-6)


def expected_case(spark):
    """A table, a model that is not canonical, its risks and R'/R."""
    rng = np.random.default_rng(8)
    n = 40
    a = rng.integers(0, 5, n).astype(float)
    b, s, x, z = a + rng.integers(1, 6, n), rng.integers(0, 2, n), rng.random(n), rng.random(n)
    e, pyr, w = rng.integers(0, 3, n), 1 + rng.random(n), 0.2 + rng.random(n)
    cols = "a double, b double, s int, x double, z double, e int, pyr double, w double, y int"
    df = frame(spark, [tuple(v.item() for v in r) for r in zip(a, b, s, x, z, e, pyr, w, (e == 1).astype(int), strict=True)], cols)
    m = Model((Element("x", 0, "plin", 0.7), Element("z", 1, "loglin", 0.4)))
    r, u = (1 + 0.7 * x) * np.exp(0.4 * z), np.column_stack([x / (1 + 0.7 * x), z])
    return df, m, r, u, (a, b, s, e, pyr, w), fits.Control(rounds=0), lambda i: pytest.approx(np.linalg.inv(i), rel=1e-8)


def test_expected_information(spark):
    df, m, r, u, (a, b, s, e, pyr, w), still, cov = expected_case(spark)
    n = len(r)

    def cox(strata, weighted):
        out = np.zeros((2, 2))
        for k in (0, 1) if strata else (None,):
            g = np.ones(n, bool) if k is None else s == k
            for t in sorted(set(b[(e == 1) & g])):
                own = (b == t) & (e == 1) & g
                c = ((a < t) & (t <= b) & g).astype(float)
                if weighted:  # all rows of the set are weighted, against the first event's weight
                    c = (g & ((((a < t) | (a == b)) & (b >= t)) | ((e == 2) & (b <= t)))) * np.minimum(w / sorted(zip(a[own], w[own], strict=True))[0][1], 1)
                q = c * r / (c * r).sum()
                mean = q @ u
                out += own.sum() * ((u.T * q) @ u - np.outer(mean, mean))
        return out

    for ties in ("breslow", "efron"):
        got = fits.fit_cox(df, m, "a", "b", "e", control=fits.Control(rounds=0, ties=ties))
        assert got.covariance == cov(cox(False, False))
    assert fits.fit_cox(df, m, "a", "b", "e", ["s"], control=still).covariance == cov(cox(True, False))
    assert fits.fit_cox(df, m, "a", "b", "e", weight="w", control=still).covariance == cov(cox(False, True))
    assert fits.fit_cox(df, m, "a", "b", "e", ["s"], weight="w", control=still).covariance == cov(cox(True, True))
    seen = fits.fit_cox(df, m, "a", "b", "e", control=still, observed=True)
    assert seen.covariance == cov(-seen.hessian) and not seen.covariance == cov(cox(False, False))

    assert fits.fit_poisson(df, m, "pyr", "y", control=still).covariance == cov((u.T * (pyr * r)) @ u)
    info = np.zeros((2, 2))
    for k in (0, 1):
        g = s == k
        q = pyr[g] * r[g] / (pyr * r)[g].sum()
        info += (e[g] == 1).sum() * ((u[g].T * q) @ u[g] - np.outer(q @ u[g], q @ u[g]))
    assert fits.fit_poisson(df, m, "pyr", "y", ["s"], control=still).covariance == cov(info)


def test_expected_information_of_chances(spark):
    from itertools import combinations

    df, m, r, u, _, still, cov = expected_case(spark)
    odds = r / (1 + r)
    assert fits.fit_logistic(df, m, None, "y", control=still).covariance == cov((u.T * (odds * (1 - odds))) @ u)
    p = np.exp(-r)
    got = run("logit(y) ~ plinear(x, 0) + loglinear(z, 1) + multiplicative()", df, [0.7, 0.4], control=still, link="loglink")
    assert got.covariance == cov((u.T * (p * r * r / (1 - p))) @ u)
    got = run("logit(y) ~ plinear(x, 0) + loglinear(z, 1) + multiplicative()", df, [0.7, 0.4], control=still, link="loglink", observed=True)
    assert got.covariance == cov(-got.hessian)

    few = df.limit(8).toPandas()
    rr, uu = (1 + 0.7 * few.x.to_numpy()) * np.exp(0.4 * few.z.to_numpy()), np.column_stack([few.x / (1 + 0.7 * few.x), few.z])
    few.y = [1, 1, 0, 0, 1, 0, 0, 0]
    few = spark.createDataFrame(few)
    pick = [list(c) for c in combinations(range(8), 3)]
    chance = np.array([np.prod(rr[c]) for c in pick])
    score = np.array([uu[c].sum(0) for c in pick])
    chance /= chance.sum()
    mean = chance @ score
    assert fits.fit_case_control(few, m, "y", control=still).covariance == cov((score.T * chance) @ score - np.outer(mean, mean))
    lo, hi = -20.0, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (1 / (1 + np.exp(-mid) / rr)).sum() < 3 else (lo, mid)
    q = 1 / (1 + np.exp(-lo) / rr)
    assert fits.fit_case_control(few, m, "y", threshold=2, control=still).covariance == cov((uu.T * (q * (1 - q))) @ uu)


def test_bounds_agree(spark):
    df = frame(spark, [(10.0, 3, 0.0), (20.0, 9, 1.0), (15.0, 9, 2.0)], "pyr double, e int, x double")
    m = Model((Element("CONST", 0, "loglin", -1.0), Element("x", 0, "loglin", 0.1)))
    best = fits.fit_poisson(df, m, "pyr", "e", control=TIGHT)
    lo, hi = fits.venzon_moolgavkar(lambda q, o: L.poisson(df, q, "pyr", "e", (), o), best, 1)
    lo2, hi2 = fits.likelihood_bound(lambda q: fits.fit_poisson(df, q, "pyr", "e", control=TIGHT), best, 1, tolerance=1e-3)
    assert (lo, hi) == pytest.approx((lo2, hi2), abs=5e-3)


def test_constrained_steps_at_size():
    """with information of 1e9 and constraints of 1, the step still goes to the maximum on the plane."""
    for size in (1.0, 1e9, 1e12):
        h = -size * np.array([[1.0, 3.0], [3.0, 13.0]])
        g = size * np.array([0.2, 0.7])
        point = L.Point(0.0, g, h)
        step = fits._step(point, fits.Control(), {}, (np.array([[0.0, 1.0]]), np.array([0.01])), np.array([-3.0, 0.0]))
        assert step == pytest.approx([0.2 - 3 * 0.01, 0.01], rel=1e-9)


def test_constraints():
    with pytest.raises(ValueError):
        fits.reduce_constraints([[1, 1], [1, 1]], [0, 1], 2)
    a, b = fits.reduce_constraints([[1, 1], [2, 2]], [1, 2], 2)
    assert a.tolist() == [[1, 1]] and b.tolist() == [1]


def test_formula(spark):
    df = frame(spark, [(0.0, 1.0, 1, 2.0, "u"), (0.0, 2.0, 0, 3.0, "v"), (1.0, 3.0, 1, 4.5, "u")], "a double, b double, c int, d double, f string")
    p = parse("Cox(a, b, c) ~ loglinear(d, factor(f), 0) + plinear(d, 1) + multiplicative-excess()", df)
    assert [(e.column, e.term, e.subterm) for e in p.model.elements] == [("d", 0, "loglin"), ("f_v", 0, "loglin"), ("d", 1, "plin")]
    assert p.model.form == "ME" and p.survival.end == "b"
    assert parse("Cox(b, c) ~ loglinear(I(d^2))", df).model.elements[0].column == "d^2"
    assert parse("Poisson_Strata(d, c, f) ~ plin(d)", df).survival.strata == ["f"]
    assert split_args("a,c(1,2),f(x,y)") == ["a", "c(1,2)", "f(x,y)"] and literal("c(1,TRUE,'x')") == [1, True, "x"]
    with pytest.raises(ValueError):
        parse("Nope(a, c) ~ lin(d)", df)
    again = p.on(frame(spark, [(0.0, 1.0, 1, 2.0, "v")], "a double, b double, c int, d double, f string"))
    assert again.first().f_v == 1


def test_splines_and_doses(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x"))
    cols = prep.b_spline(F.col("x"), [3.0, 6.0], 0.0, 10.0, intercept=True)
    total = df.select(sum(cols[1:], cols[0]).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in total)
    assert len(prep.natural_spline(F.col("x"), [3.0, 6.0], 0.0, 10.0)) == 3
    assert linked_exp_slope(2.0, 0.5, 3.0) == pytest.approx(0.25)
    with pytest.raises(ValueError):
        linked_exp_slope(2.0, 0.5, 0.5)


def test_calendar_last_bin(spark):
    d = dt.date
    df = spark.createDataFrame([(1, d(2000, 1, 1), d(2001, 1, 1), 1)], "id int, a date, b date, e int")
    out = tables.split_calendar(df, "a", "b", [d(2000, 1, 1), d(2000, 7, 1), d(2001, 1, 1)], None, "y", ["e"]).orderBy("a").collect()
    assert [(r.a, r.b, r.e) for r in out] == [(d(2000, 1, 1), d(2000, 7, 1), 0), (d(2000, 7, 1), d(2001, 1, 1), 1)]


def test_assignment_adds_up(spark):
    df = frame(spark, [(10.0, 3, 1.0), (20.0, 0, 2.0)], "pyr double, e int, x double")
    m = Model((Element("CONST", 0, "loglin", -1.0), Element("x", 1, "lin", 0.5)), "PAE")
    for r in post.event_assignment(df, m, "pyr", "e").collect():
        assert r.predict_bg + r.predict_excess == pytest.approx(r.predict_total)
        assert r.caused_total == pytest.approx(r.e)


def test_running_sums_against_a_plain_walk(spark):
    """Cells over signs, powers of two, zero and infinity; groups with a null key; both directions; the value before."""
    import random

    from cohortloom.operators.prefix import cell_of, running

    rng = random.Random(5)
    inf = float("inf")
    times = sorted({0.0, inf, -inf, 8.0, 7.999999999999999, 2.0**-1074, -(2.0**40), 1e300, *[rng.uniform(-50, 50) for _ in range(60)], *[float(i) for i in range(-5, 40)]})
    rows = [(k, t, rng.randrange(100)) for k in ("a", None) for t in times]
    df = spark.createDataFrame(rows, "k string, t double, v int")
    cells = [r.c for r in df.where("k = 'a'").orderBy("t").select(cell_of(F.col("t")).alias("c")).collect()]
    assert cells == sorted(cells) and len(set(cells)) > 80
    for down in (False, True):
        got = {(r.k, r.t): r for r in running(df, "t", {"s": F.col("v"), "b": F.col("v")}, ["k"], down, before=["b"], previous={"p": "v"}).collect()}
        for key in ("a", None):
            total, last = 0, None
            for _, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: -r[1] if down else r[1]):
                r = got[key, t]
                assert (r.s, r.b, r.p) == (total + v, total, last)
                total, last = total + v, v
    assert running(df.where("false"), "t", {"s": F.col("v")}).count() == 0


def test_running_sums_read_their_input_once(spark):
    """Both uses of the input read one exchange, and no window but that over the totals of cells is in one task."""
    from cohortloom.operators.riskset import risk_sums

    df = spark.range(3000).selectExpr("cast(id % 7 as double) a", "cast(id % 7 + id % 900 as double) b", "cast(id % 3 as int) e", "cast(id as double) x")
    out = risk_sums(df, "a", "b", "e", {"S": F.col("x")}, {"X": F.col("x")})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Generate explode") == 1 and "ReusedExchange" in plan
    assert plan.count("SinglePartition") == 1
