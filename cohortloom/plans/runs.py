"""Runs from formulas: text and a table in, a fit out."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..operators import prep
from . import fit as fits
from .formula import parse, parse_joint

#: By which power of a column's weight a parameter grows when the column is divided by it (1 if not listed).
POWER = {"loglin_slope": 0, "step_slope": 0, "quad_slope": 2, "lin_int": -1, "step_int": -1, "lin_quad_int": -1, "lin_exp_int": -1}


def _with(model, values, fixed):
    from dataclasses import replace

    values = values if values is not None else [0.01] * len(model.elements)
    fixed = fixed or [False] * len(model.elements)
    if len(values) != len(model.elements) or len(fixed) != len(model.elements):
        raise ValueError(f"the model has {len(model.elements)} parameters")
    return replace(model, elements=tuple(replace(e, value=float(v), fixed=bool(k)) for e, v, k in zip(model.elements, values, fixed, strict=True)))


def run(formula: str, df: DataFrame, values: Sequence[float] | None = None, fixed: Sequence[bool] | None = None, control: fits.Control | None = None, constraints=None, link: str = "odds", threshold: int | None = 50, observed: bool = False, norm: str | None = None) -> fits.Fit:
    """Fit whatever family the formula names. observed: standard errors from the observed, not the expected information.

    threshold: matched sets of more cases take the unconditional form; None: none does.

    norm: "max" or "mean" divides the columns by their largest absolute value or mean for the fit; estimates,
    gradient, Hessian and covariance come back on the scale of the columns as given.
    """
    f = parse(formula, df)
    s, m = f.survival, f.model if f.model.null else _with(f.model, values, fixed)
    scale = None
    if norm and norm.lower() != "null" and not m.null:
        weights = prep.normalization(f.data, m.columns(), norm)
        scale = np.array([weights.get(e.column, 1.0) ** POWER.get(e.subterm, 1) for e in m.elements])
        f.data, m = prep.normalized(f.data, weights), m.at(np.array(m.values) * scale)
        if constraints is not None:
            constraints = (np.atleast_2d(np.array(constraints[0], float)) / scale[m.free], constraints[1])
    if s.family in ("cox", "finegray"):
        out = fits.fit_cox(f.data, m, s.start, s.end, s.event, s.strata, s.weight, control, constraints, observed)
    elif s.family == "poisson":
        out = fits.fit_poisson(f.data, m, s.pyr, s.event, s.strata, control, constraints, observed)
    elif s.family == "logit":
        out = fits.fit_logistic(f.data, m, s.trials, s.event, link, control, constraints, observed)
    else:
        out = fits.fit_case_control(f.data, m, s.event, s.strata, s.start, s.end, threshold, control, constraints, observed)
    out.setup["formula"] = f
    return out if scale is None else _rescaled(out, scale)


def _rescaled(out: fits.Fit, scale: np.ndarray) -> fits.Fit:
    free = scale[out.model.free]
    both = np.outer(free, free)
    out.model = out.model.at(np.array(out.model.values) / scale)
    out.gradient = out.gradient * free if len(out.gradient) else out.gradient
    out.hessian = out.hessian * both if out.hessian.size else out.hessian
    out.covariance = out.covariance / both if out.covariance.size else out.covariance
    out.path = [((np.array(b) / scale).tolist(), v) for b, v in out.path]
    return out


def run_joint(formulas: Sequence[str], df: DataFrame, values: Sequence[float] | None = None, fixed: Sequence[bool] | None = None, control: fits.Control | None = None, observed: bool = False) -> fits.Fit:
    s, m, data = parse_joint(formulas, df)
    return fits.fit_poisson(data, _with(m, values, fixed), s.pyr, s.event, s.strata, control, observed=observed)
