"""Model fitting: one driver loop over likelihood aggregations for every family."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_tail, normal_cdf
from ..functions.risk import Model
from ..operators import likelihood as L
from ..operators.prep import strata_with_events, truncation_fill
from ..operators.riskset import competing_shape


@dataclass
class Control:
    rate: float = 0.75
    rounds: int = 20
    halvings: int = 5
    epsilon: float = 1e-4
    ll_epsilon: float = 1e-4
    gradient_epsilon: float = 1e-4
    step_max: float = 1.0
    threshold_step_max: float = 100.0
    ties: str = "breslow"
    method: str = "newton"  # or gradient, momentum, adadelta, adam
    momentum_decay: float = 0.9
    learning_decay: float = 0.999


@dataclass
class Fit:
    family: str
    model: Model
    loglik: float
    gradient: np.ndarray
    hessian: np.ndarray
    covariance: np.ndarray
    converged: bool
    rounds: int
    n: int
    deviance: float | None = None
    setup: dict = field(default_factory=dict)
    path: list[tuple[list[float], float]] = field(default_factory=list)

    @property
    def beta(self) -> list[float]:
        return self.model.values

    @property
    def standard_error(self) -> list[float]:
        out = [0.0] * len(self.beta)
        for k, i in enumerate(self.model.free):
            v = self.covariance[k, k] if len(self.covariance) else float("nan")
            out[i] = math.sqrt(v) if v > 0 else float("nan")
        return out

    @property
    def aic(self) -> float:
        return 2 * len(self.model.free) - 2 * self.loglik

    @property
    def bic(self) -> float:
        return len(self.model.free) * math.log(max(1, self.n)) - 2 * self.loglik

    def wald(self, z: float = 1.96) -> list[tuple[float, float, float]]:
        """(lower, upper, two-sided p) of each parameter."""
        return [(b - z * s, b + z * s, 2 * (1 - normal_cdf(abs(b / s))) if s and s == s else float("nan")) for b, s in zip(self.beta, self.standard_error, strict=True)]

    def to_df(self, spark) -> DataFrame:
        rows = [(e.column, e.subterm, e.term, e.value, s, lo, hi, p, e.fixed) for e, s, (lo, hi, p) in zip(self.model.elements, self.standard_error, self.wald(), strict=True)]
        return spark.createDataFrame(rows, "covariate string, subterm string, term int, estimate double, standard_error double, lower double, upper double, p double, fixed boolean")

    def __str__(self) -> str:
        head = f"{self.family} model, form {self.model.form}: log likelihood {self.loglik:.6g}, AIC {self.aic:.6g}, BIC {self.bic:.6g}, {self.rounds} rounds, {'converged' if self.converged else 'not converged'}"
        rows = [f"{e.column:>20} {e.subterm:>16} {e.term:>4} {e.value:>12.6g} {s:>12.6g}" for e, s in zip(self.model.elements, self.standard_error, strict=True)]
        return "\n".join([head, f"{'covariate':>20} {'subterm':>16} {'term':>4} {'estimate':>12} {'std. error':>12}", *rows])


def likelihood_ratio(alternative: Fit, null: Fit) -> dict[str, float]:
    """Twice the gain in log likelihood, its degrees of freedom, and the chi-square tail."""
    df = len(alternative.model.free) - (0 if null.model.null else len(null.model.free))
    stat = 2 * (alternative.loglik - null.loglik)
    return {"value": stat, "df": df, "p": chi2_tail(stat, df) if df > 0 else 1.0}


def reduce_constraints(matrix, vector, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Row echelon form of the constraints A beta = b; a contradiction or a wrong width is an error, repeats go."""
    a = np.column_stack([np.atleast_2d(np.array(matrix, float)), np.array(vector, float).reshape(-1)])
    if a.shape[1] != p + 1:
        raise ValueError(f"constraints need {p} columns")
    row = 0
    for col in range(p):
        if row == len(a):
            break
        k = row + int(np.argmax(np.abs(a[row:, col])))
        if abs(a[k, col]) < 1e-12:
            continue
        a[[row, k]] = a[[k, row]]
        a[row] /= a[row, col]
        for r in range(len(a)):
            if r != row:
                a[r] -= a[r, col] * a[row]
        row += 1
    if any(abs(r[-1]) > 1e-9 for r in a[row:]):
        raise ValueError("the constraints contradict each other")
    return a[:row, :-1], a[:row, -1]


def _step(point: L.Point, control: Control, state: dict, cons, beta: np.ndarray) -> np.ndarray:
    g, h = point.gradient, point.hessian
    if control.method == "newton":
        if cons is not None:
            #: Onto the plane, then along it: h grows with the rows and a does not, so one system of both loses its small singular values.
            a, b = cons
            onto = a.T @ np.linalg.solve(a @ a.T, b - a @ beta)
            along = np.linalg.svd(a)[2][len(b) :].T
            return onto + along @ np.linalg.lstsq(-along.T @ h @ along, along.T @ (g + h @ onto), rcond=None)[0]
        step = np.linalg.lstsq(-h, g, rcond=None)[0] * control.rate
        if step @ g < 0:  # the likelihood is not concave here: turn the directions that lead down
            size, axes = np.linalg.eigh(-h)
            step = axes @ ((axes.T @ g) / np.maximum(np.abs(size), 1e-8 * np.abs(size).max())) * control.rate
        return step
    if control.method == "gradient":
        step = control.rate * g
    elif control.method == "momentum":
        state["m"] = control.momentum_decay * state.get("m", 0) + control.rate * g
        step = state["m"]
    elif control.method == "adadelta":
        state["g"] = control.learning_decay * state.get("g", 0) + (1 - control.learning_decay) * g * g
        step = np.sqrt(np.array(state.get("d", 0.0)) + 1e-4) / np.sqrt(state["g"] + 1e-4) * g
        state["d"] = control.learning_decay * state.get("d", 0) + (1 - control.learning_decay) * step * step
    elif control.method == "adam":
        t = state["t"] = state.get("t", 0) + 1
        state["m"] = control.momentum_decay * state.get("m", 0) + (1 - control.momentum_decay) * g
        state["v"] = control.learning_decay * state.get("v", 0) + (1 - control.learning_decay) * g * g
        step = control.rate * (state["m"] / (1 - control.momentum_decay**t)) / (np.sqrt(state["v"] / (1 - control.learning_decay**t)) + 1e-8)
    else:
        raise ValueError(f"unknown method {control.method}")
    if cons is not None:  # onto the plane of the constraints
        a, b = cons
        step = step - a.T @ np.linalg.solve(a @ a.T, a @ (beta + step) - b)
    return step


THRESHOLDS = ("lin_int", "step_int", "lin_quad_int", "lin_exp_int")


def maximize(evaluate: Callable[[Model, int], L.Point], model: Model, control: Control, constraints=None, ranges: dict[str, tuple[float, float]] | None = None) -> tuple[Model, L.Point, bool, int, list]:
    """Steps with clipping and halving: a step that leaves the feasible region or lowers the likelihood is halved."""
    free = model.free
    state: dict = {}
    point = evaluate(model, 2)
    path = [(model.values, point.value)]
    if not point.feasible:
        raise ValueError("the starting point is infeasible: some risk is not positive")
    cap = np.array([control.threshold_step_max if model.elements[i].subterm in THRESHOLDS else control.step_max for i in free])
    cons = None if constraints is None else reduce_constraints(constraints[0], constraints[1], len(free))
    shrink, converged, r = 1.0, False, 0
    for r in range(1, control.rounds + 1):
        if np.abs(point.gradient).max(initial=0) < control.gradient_epsilon and cons is None:
            converged = True
            break
        beta = np.array(model.values)
        step = _step(point, control, state, cons, beta[free])
        if cons is None and control.method == "newton":
            step = step * min(1.0, float(np.min(cap * shrink / np.maximum(np.abs(step), 1e-300))))  # as a whole: its direction leads up
        elif cons is None:
            step = np.clip(step, -cap * shrink, cap * shrink)
        gain, better = abs(point.gradient @ step), None
        for _ in range(control.halvings + 1):
            new = beta.copy()
            new[free] += step
            for i in free:
                e = model.elements[i]
                if e.subterm in THRESHOLDS and ranges and e.column in ranges:
                    new[i] = min(max(new[i], ranges[e.column][0]), ranges[e.column][1])
            trial = model.at(new)
            got = evaluate(trial, 2)
            #: Values that differ by rounding only are told apart by their gradients.
            level = got.feasible and abs(got.value - point.value) <= 1e-12 * (1 + abs(point.value)) and np.abs(got.gradient).max() < np.abs(point.gradient).max()
            if got.feasible and (got.value > point.value or level or cons is not None and r == 1):
                better = (trial, got)
                break
            if cons is None and got.feasible and gain < 1e-11 * (1 + abs(point.value)):
                break
            step = step / (2 if got.feasible else 1.5)
        if better is None:
            if cons is None and gain < 1e-11 * (1 + abs(point.value)):
                converged = True  # what a step can still gain is below rounding
                break
            shrink /= 2
            if shrink < control.epsilon:
                converged = True
                break
            continue
        change, moved = better[1].value - point.value, np.abs(step).max(initial=0)
        model, point = better
        path.append((model.values, point.value))
        if abs(change) < control.ll_epsilon and moved < max(control.epsilon, 1e-3) or moved < control.epsilon:
            converged = True
            break
    return model, point, converged, r, path


def _information(observed: bool, evaluate: Callable[[Model], L.Point]):
    """The expected information of a model from an evaluation with it for its Hessian; None where the observed one is wanted."""
    return None if observed else (lambda m: -evaluate(m).hessian)


def _finish(family: str, evaluate, model: Model, control: Control, n: int, constraints=None, ranges=None, information=None, setup: dict | None = None) -> Fit:
    if model.null:
        v = evaluate(model, 0)
        return Fit(family, model, v.value, np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), True, 0, n, v.deviance, setup or {})
    if not model.free:
        v = evaluate(model, 1)
        return Fit(family, model, v.value, v.gradient, v.hessian, np.zeros((0, 0)), True, 0, n, v.deviance, setup or {})
    if control.rounds == 0:
        point, done, r, path = evaluate(model, 2), False, 0, []
    else:
        model, point, done, r, path = maximize(evaluate, model, control, constraints, ranges)
    info = information(model) if information else -point.hessian
    cov = np.linalg.pinv(info)
    return Fit(family, model, point.value, point.gradient, point.hessian, cov, done, r, n, point.deviance, setup or {}, path)


def _ready(df: DataFrame, model: Model, keep: Sequence[str]) -> tuple[DataFrame, Model, dict, int]:
    """Pruned and persisted rows with missing covariates as 0; constant covariates are held; ranges of the columns; the count."""
    cols = model.columns()
    if missing := [c for c in [*cols, *keep] if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *cols])])
    df = df.withColumns({c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols if c not in keep})
    df = df.persist()
    r = df.agg(F.count("*").alias("n"), *[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = {c: (r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols)}
    return df, model, ranges, r["n"]


def _hold_constant(model: Model, ranges: dict) -> Model:
    from dataclasses import replace

    held = tuple(replace(e, fixed=True) if e.column in ranges and ranges[e.column][0] == ranges[e.column][1] else e for e in model.elements)
    if model.elements and all(e.fixed for e in held) and not all(e.fixed for e in model.elements):
        raise ValueError("no parameter is free: all covariates are constant")
    return replace(model, elements=held)


def fit_cox(df: DataFrame, model: Model, start: str | None, end: str | None, event: str, strata: Sequence[str] = (), weight: str | None = None, control: Control | None = None, constraints=None, observed: bool = False) -> Fit:
    """Cox regression; with a weight column Fine-Gray (event 2 is competing). observed: the covariance is from the observed, not the expected information."""
    control = control or Control()
    df, start, end = truncation_fill(df, start, end)
    need = [start, end, event, *([weight] if weight else [])]
    #: The cohort is made once: pruned, kept, and its checks and bounds are one aggregation.
    whole = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*need, *strata, *model.columns()])]).persist()
    own = F.when(F.col(event) == 1, F.col(end))
    r = whole.agg(F.min(event).alias("lo"), F.max(event).alias("hi"), F.min(own).alias("first"), F.max(own).alias("last")).first()
    if r.lo is None or r.lo < 0 or r.hi > 2:
        raise ValueError("event status is 0, 1 or 2")
    if r["first"] is None:
        raise ValueError("there is no event")
    df = whole if weight else whole.where((F.col(end) >= F.lit(r["first"])) & (F.col(start) <= F.lit(r["last"])))
    if strata:
        df = strata_with_events(df, strata, F.col(event) == 1)
    keys = ["_strata_col"] if strata else []
    rows, model, ranges, n = _ready(df, model, [*need, *keys])
    whole.unpersist()
    model = model if model.null else _hold_constant(model, ranges)
    try:
        shape = competing_shape(rows, start, end, event, F.col(weight), keys) if weight else None
        info = _information(observed, lambda m: L.cox(rows, m, start, end, event, keys, "breslow", 2, weight, expected=True, shape=shape))
        return _finish("Fine-Gray" if weight else "Cox", lambda m, order: L.cox(rows, m, start, end, event, keys, control.ties, order, weight, shape=shape), model, control, n, constraints, ranges, info, setup={"start": start, "end": end, "event": event, "strata": list(strata)})
    finally:
        rows.unpersist()


def _with_events(rows: DataFrame, event: str) -> None:
    if not rows.agg(F.sum(event)).first()[0]:
        rows.unpersist()
        raise ValueError("there is no event")


def fit_poisson(df: DataFrame, model: Model, pyr: str, event: str, strata: Sequence[str] = (), control: Control | None = None, constraints=None, observed: bool = False) -> Fit:
    control = control or Control()
    rows, model, ranges, n = _ready(df.where(F.col(pyr) > 0), model, [pyr, event, *strata])
    _with_events(rows, event)
    try:
        info = _information(observed, lambda m: L.poisson(rows, m, pyr, event, strata, 2, expected=True))
        return _finish("Poisson", lambda m, order: L.poisson(rows, m, pyr, event, strata, order), model, control, n, constraints, ranges, info, {"pyr": pyr, "event": event, "strata": list(strata)})
    finally:
        rows.unpersist()


def fit_logistic(df: DataFrame, model: Model, trials: str | None, event: str, link: str = "odds", control: Control | None = None, constraints=None, observed: bool = False) -> Fit:
    control = control or Control()
    rows, model, ranges, n = _ready(df.where(F.col(trials) > 0) if trials else df, model, [event, *([trials] if trials else [])])
    _with_events(rows, event)
    try:
        info = _information(observed, lambda m: L.logistic(rows, m, trials, event, link, 2, expected=True))
        return _finish("Logistic", lambda m, order: L.logistic(rows, m, trials, event, link, order), model, control, n, constraints, ranges, info, setup={"trials": trials, "event": event, "link": link})
    finally:
        rows.unpersist()


def fit_case_control(df: DataFrame, model: Model, event: str, strata: Sequence[str] = (), start: str | None = None, end: str | None = None, threshold: int | None = 50, control: Control | None = None, constraints=None, observed: bool = False) -> Fit:
    """Matched sets: the whole table, strata, event times, or both. Strata without a case are dropped.

    Sets of more than `threshold` cases take the unconditional form, with None none does.
    """
    control = control or Control()
    sets = list(strata)
    if start or end:
        df, start, end = truncation_fill(df, start, end)
        df = L.matched_rows(df, start, end, event, strata)
        sets, event = [*sets, "_t"], "_case"
    elif strata:
        df = strata_with_events(df, strata, F.col(event) == 1)
    rows, model, ranges, n = _ready(df, model, [event, *sets])
    try:
        info = _information(observed, lambda m: L.case_control(rows, m, event, sets, threshold, expected=True))
        return _finish("Case-control", lambda m, order: L.case_control(rows, m, event, sets, threshold), model, control, n, constraints, ranges, info, setup={"event": event, "strata": sets, "threshold": threshold})
    finally:
        rows.unpersist()


def fit_best(fit: Callable[[Model], Fit], model: Model, guesses: Sequence[Sequence[float]]) -> Fit:
    """The best of several starting points; infeasible ones are passed over."""
    found = []
    for g in guesses:
        try:
            found.append(fit(model.at(g)))
        except ValueError:
            continue
    if not found:
        raise ValueError("every starting point is infeasible")
    return max(found, key=lambda f: f.loglik)


def fit_realizations(fit: Callable[[Model], Fit], model: Model, columns: dict[str, Sequence[str]]) -> list[Fit]:
    """One fit for each realization: model column -> its versions (frequentist model averaging keeps them apart)."""
    from dataclasses import replace

    k = len(next(iter(columns.values())))
    return [fit(replace(model, elements=tuple(replace(e, column=columns[e.column][i]) if e.column in columns else e for e in model.elements))) for i in range(k)]


def fit_averaged(evaluate: Callable[[Model, int], L.Point], model: Model, columns: dict[str, Sequence[str]], control: Control | None = None, n: int = 0, family: str = "Averaged") -> Fit:
    """Monte Carlo maximum likelihood: likelihood, gradient and Hessian are means over the realizations."""
    from dataclasses import replace

    k = len(next(iter(columns.values())))

    def mean(m: Model, order: int) -> L.Point:
        points = [evaluate(replace(m, elements=tuple(replace(e, column=columns[e.column][i]) if e.column in columns else e for e in m.elements)), order) for i in range(k)]
        ok = all(p.feasible for p in points)
        return L.Point(float(np.mean([p.value for p in points])), np.mean([p.gradient for p in points], 0), np.mean([p.hessian for p in points], 0), ok)

    return _finish(family, mean, model, control or Control(), n)


def fit_outcomes(df: DataFrame, model: Model, trials: str | None, events: Sequence[str], **more) -> list[Fit]:
    """Logistic fits of several outcome columns."""
    return [fit_logistic(df, model, trials, e, **more) for e in events]


def likelihood_bound(refit: Callable[[Model], Fit], best: Fit, index: int, alpha: float = 0.05, step: float = 0.5, rounds: int = 40, tolerance: float = 1e-4) -> tuple[float | None, float | None]:
    """Likelihood-based bounds by expanding and bisecting the profile: the parameter is held, the others are fitted again."""
    from dataclasses import replace

    from ..functions.dist import chi2_quantile_1

    goal = best.loglik - chi2_quantile_1(1 - alpha) / 2

    def profile(x: float) -> float:
        held = replace(best.model, elements=tuple(replace(e, value=x, fixed=True) if i == index else e for i, e in enumerate(best.model.elements)))
        try:
            return refit(held).loglik
        except ValueError:
            return -math.inf

    out: list[float | None] = []
    se = best.standard_error[index]
    width = step * (se if se == se and se > 0 else max(0.1, abs(best.beta[index])))
    for sign in (-1, 1):
        inside, outside = best.beta[index], None
        for k in range(rounds):
            x = best.beta[index] + sign * width * (k + 1)
            if profile(x) < goal:
                outside = x
                break
            inside = x
        if outside is None:
            out.append(None)
            continue
        while abs(outside - inside) > tolerance * max(1.0, abs(outside)):
            mid = (inside + outside) / 2
            inside, outside = (mid, outside) if profile(mid) >= goal else (inside, mid)
        out.append((inside + outside) / 2)
    return out[0], out[1]


def venzon_moolgavkar(evaluate: Callable[[Model, int], L.Point], best: Fit, index: int, alpha: float = 0.05, rounds: int = 30, tolerance: float = 1e-6) -> tuple[float | None, float | None]:
    """Bounds by Newton steps on [LL - goal, the other partial derivatives] = 0, starting along the profile's curvature."""
    from ..functions.dist import chi2_quantile_1

    free = best.model.free
    k = free.index(index)
    rest = [i for i in range(len(free)) if i != k]
    q = chi2_quantile_1(1 - alpha)
    goal = best.loglik - q / 2
    h = best.hessian
    along = -np.linalg.solve(h[np.ix_(rest, rest)], h[rest, k]) if rest else np.zeros(0)
    curve = h[k, k] + (h[k, rest] @ along if rest else 0.0)
    out: list[float | None] = []
    for sign in (-1, 1):
        size = sign * math.sqrt(q / max(1e-12, -curve)) * 0.5
        beta = np.array(best.beta, float)
        move = np.zeros(len(free))
        move[k] = size
        move[rest] = along * size
        beta[free] += move
        found = None
        for _ in range(rounds):
            p = evaluate(best.model.at(beta), 2)
            if not p.feasible:
                move /= 2
                beta[free] -= move
                continue
            target = np.concatenate([[p.value - goal], p.gradient[rest]])
            if np.abs(target).max() < tolerance * max(1.0, abs(goal)) or abs(target[0]) < 1e-6 and np.abs(target[1:]).max(initial=0) < 1e-4:
                found = float(beta[index])
                break
            jac = np.vstack([p.gradient, p.hessian[rest]])
            move = np.linalg.lstsq(jac, -target, rcond=None)[0]
            move = np.clip(move, -2 * abs(size) - 1, 2 * abs(size) + 1)
            beta[free] += move
        out.append(found)
    return out[0], out[1]


def held_at(refit: Callable[[Model], Fit], best: Fit, index: int, value: float) -> Model:
    """The model with one parameter held at a value and the others, if any, fitted again."""
    from dataclasses import replace

    held = replace(best.model, elements=tuple(replace(e, value=float(value), fixed=True) if i == index else e for i, e in enumerate(best.model.elements)))
    got = refit(held).model if held.free else held
    return replace(got, elements=tuple(replace(g, fixed=e.fixed) for g, e in zip(got.elements, best.model.elements, strict=True)))


def assigned_bounds(df: DataFrame, refit: Callable[[Model], Fit], best: Fit, index: int, pyr: str, event: str, strata: Sequence[str] = (), z: float = 1.96, limits: tuple[float | None, float | None] | None = None) -> dict[str, DataFrame]:
    """Assigned events at the estimate and with one parameter at beta -+ z SE, or at given limits of a bound; the others are fitted again."""
    from ..operators.post import event_assignment

    b, se = best.beta[index], best.standard_error[index]
    lower, upper = limits or (b - z * se, b + z * se)
    at = {"lower": lower, "mid": None, "upper": upper}
    out = {}
    for k, x in at.items():
        if k != "mid" and x is None:
            continue  # a bound that was not found
        out[k] = event_assignment(df, best.model if x is None else held_at(refit, best, index, x), pyr, event, strata)
    return out


def bound_from_starts(refit: Callable[[Model], Fit], evaluate: Callable[[Model, int], L.Point], best: Fit, index: int, guesses: Sequence[Sequence[float]], alpha: float = 0.05) -> tuple[float | None, float | None]:
    """Bounds by Newton steps from the best of several starting points: a better maximum found on the way replaces the first."""
    top = fit_best(refit, best.model, [best.beta, *guesses])
    return venzon_moolgavkar(evaluate, top if top.loglik > best.loglik else best, index, alpha)
