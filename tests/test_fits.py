"""Parts of the fits that no query with SQL reaches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.risk import Element, Model
from cohortloom.operators import post, prep, tables
from cohortloom.operators.riskset import Shape, competing_sums
from cohortloom.plans import fit as fits
from cohortloom.plans.formula import left_side, parse
from cohortloom.plans.runs import run

TIGHT = fits.Control(rate=1.0, rounds=40, epsilon=1e-10, ll_epsilon=1e-12, gradient_epsilon=1e-8)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    rows = [(float(1 + rng.random()), int(rng.poisson(2)), float(rng.random()), float(7 * rng.random())) for _ in range(60)]
    return spark.createDataFrame(rows, "pyr double, n int, x double, z double").persist()


def test_gradient_methods_rise(people):
    m = Model((Element("CONST", 0, "loglin", 0.0), Element("x", 0, "loglin", 0.0)))
    best = fits.fit_poisson(people, m, "pyr", "n", control=TIGHT).loglik
    start = fits.fit_poisson(people, m, "pyr", "n", control=fits.Control(rounds=0)).loglik
    for method, rate in (("momentum", 1e-3), ("adadelta", 1.0), ("adam", 0.1)):
        got = fits.fit_poisson(people, m, "pyr", "n", control=fits.Control(method=method, rate=rate, rounds=8))
        values = [v for _, v in got.path]
        assert values == sorted(values) and start < got.loglik <= best + 1e-9


def test_normalized_runs_agree(people):
    text = "Poisson(pyr, n) ~ loglinear(CONST, x, 0) + quadratic(z, 1) + multiplicative-excess()"
    plain = run(text, people, [0.1, 0.1, 0.01], control=TIGHT)
    for norm in ("max", "mean"):
        got = run(text, people, [0.1, 0.1, 0.01], control=TIGHT, norm=norm)
        assert got.beta == pytest.approx(plain.beta, abs=1e-5) and got.standard_error == pytest.approx(plain.standard_error, rel=1e-4)
        assert got.hessian == pytest.approx(plain.hessian, rel=1e-3)


def test_spellings(spark, people):
    for text, family in (("cx(a,b,e)", "cox"), ("coxph_strata(a,b,e,s)", "cox"), ("fg_strata(a,b,e,s,w)", "finegray"), ("fine_gray(a,b,e,w)", "finegray"), ("casecon_strata_time(a,b,e,s)", "casecontrol"), ("logis(n,e)", "logit"), ("poisson_s(p,e,s)", "poisson")):
        assert left_side(text).family == family
    assert left_side("Cox(tst=a,te=b,ev=e)").start == "a"
    for wrong in ("co(a,b)", "nothing(a,b)", "Cox(a,b,c,d)"):
        with pytest.raises(ValueError):
            left_side(wrong)
    both = parse("Poisson(pyr, n) ~ loglinear(CONST, x, z, 0)", people.withColumn("z", 2 * F.col("x") + 1))
    assert [e.column for e in both.model.elements] == ["CONST", "x"]


def test_no_events_and_kinds(spark, people):
    none = people.withColumn("n", F.lit(0))
    m = Model((Element("x", 0, "loglin", 0.0),))
    for f in (lambda: fits.fit_poisson(none, m, "pyr", "n"), lambda: fits.fit_logistic(none, m, None, "n"), lambda: fits.fit_cox(none, m, "x", "pyr", "n")):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(ValueError):
        post.cox_after("nothing", people, m, "x", "pyr", "n")
    with pytest.raises(ValueError):
        post.cox_after("km", people, m, "x", "pyr", "n")
    table, _ = tables.person_time(people.withColumn("id", F.monotonically_increasing_id()), "x", "pyr", [{"name": "part", "bins": "0/1]3"}], subject="id")
    assert table.count() == 2


def test_competing_sums_against_brute_force(spark):
    rng = np.random.default_rng(1)
    for strata in ([], ["s"]):
        n = 70
        a = rng.integers(0, 6, n).astype(float)
        b, e, w, v, s = a + rng.integers(0, 5, n), rng.integers(0, 3, n), np.round(rng.random(n), 1) + 0.1, rng.random(n), rng.integers(0, 2, n)
        df = spark.createDataFrame([tuple(x.item() for x in r) for r in zip(a, b, e, w, v, s, strict=True)], "a double, b double, e int, w double, v double, s int")
        got = {(r["s"] if strata else 0, r.t): (r.d, r.total, r.own) for r in competing_sums(df, "a", "b", "e", {"total": F.col("v")}, F.col("w"), {"own": F.col("v")}, strata).collect()}
        want = {}
        for k in (0, 1) if strata else (0,):
            g = (s == k) if strata else np.ones(n, bool)
            for t in set(b[(e == 1) & g]):
                own = (b == t) & (e == 1) & g
                first = sorted(zip(a[own], w[own], strict=True))[0][1]
                at = g & ((((a < t) | (a == b)) & (b >= t)) | ((e == 2) & (b <= t)))
                want[k, t] = (own.sum(), (v[at] * np.minimum(w[at] / first, 1)).sum(), v[own].sum())
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_trees_of_all_shapes_agree(spark):
    """wide and narrow trees, sums in one window or in cells."""
    rng = np.random.default_rng(4)
    n = 300
    a = rng.integers(0, 9, n).astype(float)
    b, e, w, v, s = a + rng.integers(0, 5, n), rng.integers(0, 3, n), np.round(rng.random(n), 2) + 0.1, rng.random(n), rng.integers(0, 2, n)
    df = spark.createDataFrame([tuple(x.item() for x in r) for r in zip(a, b, e, w, v, s, strict=True)], "a double, b double, e int, w double, v double, s int").persist()
    want = {}
    for k in (0, 1):
        for t in set(b[(e == 1) & (s == k)]):
            own = (b == t) & (e == 1) & (s == k)
            first = sorted(zip(a[own], w[own], strict=True))[0][1]
            at = (s == k) & ((((a < t) | (a == b)) & (b >= t)) | ((e == 2) & (b <= t)))
            want[k, t] = (v[at] * np.minimum(w[at] / first, 1)).sum()
    for shape in (Shape(1, False), Shape(1, True), Shape(2, False), Shape(3, True), Shape(10, True)):
        got = {(r.s, r.t): r.total for r in competing_sums(df, "a", "b", "e", {"total": F.col("v")}, F.col("w"), strata=["s"], shape=shape).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want), shape
    df.unpersist()


def _generated(node) -> int:
    """Rows that the explodes of an executed plan made."""
    name = node.getClass().getSimpleName()
    if name == "ReusedExchangeExec":
        return 0
    if name == "AdaptiveSparkPlanExec":
        return _generated(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _generated(node.plan())
    own = node.metrics().apply("numOutputRows").value() if name == "GenerateExec" else 0
    return own + sum(_generated(node.children().apply(i)) for i in range(node.children().size()))


def test_many_rows_for_a_time_go_to_few_nodes(spark):
    """6,000 rows of 30 times and 2,000 weights; a binary tree made 27 rows of each."""
    n = 6000
    df = spark.range(n, numPartitions=4).selectExpr("double(pmod(hash(id), 26)) AS a", "int(id % 3) AS e", "(1 + id * 37 % 2000) / 2000.0 AS w", "id").selectExpr("*", "a + 1 + id % 5 AS b")
    out = competing_sums(df, "a", "b", "e", {"n": F.lit(1.0)}, F.col("w"))
    assert len(out.collect()) == 30
    assert 2 * n < _generated(out._jdf.queryExecution().executedPlan()) < 9.5 * n


def test_natural_splines(spark):
    """Second derivatives vanish at the bounds, lines go on beyond them, and the space is that of the truncated powers."""
    df = spark.range(-20, 121).select((F.col("id") / 10).alias("x"))
    cols = prep.natural_spline(F.col("x"), [3.0, 6.0], 0.0, 10.0)
    x = np.array([r.x for r in df.collect()])
    v = np.array([list(r) for r in df.select(*cols).collect()])
    bend = np.diff(v, 2, axis=0) / 0.01
    assert np.abs(bend[x[1:-1] < -0.05]).max() < 1e-6 and np.abs(bend[x[1:-1] > 10.05]).max() < 1e-6
    cube = lambda k: np.maximum(x - k, 0) ** 3
    d = [(cube(k) - cube(10.0)) / (10.0 - k) for k in (0.0, 3.0, 6.0)]
    basis = np.column_stack([np.ones(len(x)), x, d[0] - d[2], d[1] - d[2]])
    fit = basis @ np.linalg.lstsq(basis, v, rcond=None)[0]
    assert np.abs(fit - v).max() < 1e-8 and np.linalg.matrix_rank(v) == 3


def test_bounds_of_assigned_events(people):
    df = people.withColumn("x", F.col("x") + 0.1)
    refit = lambda m: fits.fit_poisson(df, m, "pyr", "n", control=TIGHT)
    best = refit(Model((Element("CONST", 0, "loglin", 0.5), Element("x", 1, "lin", 0.2)), "PAE"))
    got = fits.assigned_bounds(df, refit, best, 1, "pyr", "n", limits=(None, best.beta[1] + 0.1))
    assert set(got) == {"mid", "upper"}
    total = {k: v.agg(F.sum("predict_total")).first()[0] for k, v in got.items()}
    events = people.agg(F.sum("n")).first()[0]
    assert total["mid"] == pytest.approx(events, rel=1e-4) and total["upper"] == pytest.approx(events, rel=1e-4)
