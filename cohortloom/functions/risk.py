"""Risk models as Columns: terms and subterms, their combination, and exact first and second derivatives.

A `Jet` is a Column with its gradient and Hessian over the parameters. Entries that are zero for
structural reasons are absent, so a log-linear model makes no more expressions than it needs, and
everything stays in whole-stage codegen.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that belong to the dose subterm opened by the one before.
PARTNERS = {"loglin_slope": ("loglin_top",), "lin_slope": ("lin_int",), "step_slope": ("step_int",), "lin_quad_slope": ("lin_quad_int",), "lin_exp_slope": ("lin_exp_int", "lin_exp_exp_slope")}
SUBTERMS = ("loglin", "lin", "plin", "quad_slope", *PARTNERS, *(x for p in PARTNERS.values() for x in p))
FORMS = ("A", "PA", "PAE", "M", "ME", "GMIX")


@dataclass(frozen=True)
class Element:
    """One parameter: the column it acts on, its term, its subterm, its value, and whether it is held."""

    column: str
    term: int = 0
    subterm: str = "loglin"
    value: float = 0.0
    fixed: bool = False


@dataclass(frozen=True)
class Model:
    elements: tuple[Element, ...]
    form: str = "M"
    theta: float = 0.5
    excess: tuple[bool, ...] = ()  # GMIX: for each term whether it enters as 1 + T
    null: bool = False

    def __post_init__(self):
        if self.form not in FORMS:
            raise ValueError(f"unknown model form {self.form}")
        for e in self.elements:
            if e.subterm not in SUBTERMS:
                raise ValueError(f"unknown subterm {e.subterm}")

    @property
    def values(self) -> list[float]:
        return [e.value for e in self.elements]

    @property
    def free(self) -> list[int]:
        return [i for i, e in enumerate(self.elements) if not e.fixed]

    def at(self, values: Sequence[float]) -> Model:
        return replace(self, elements=tuple(replace(e, value=float(v)) for e, v in zip(self.elements, values, strict=True)))

    def columns(self) -> list[str]:
        return sorted({e.column for e in self.elements if e.column != "CONST"})


def _plus(a, b):
    return b if a is None else a if b is None else a + b


@dataclass
class Jet:
    v: Column
    g: dict[int, Column] = field(default_factory=dict)
    h: dict[tuple[int, int], Column] = field(default_factory=dict)

    def __add__(self, o: Jet | float) -> Jet:
        if not isinstance(o, Jet):
            return Jet(self.v + o, self.g, self.h)
        return Jet(self.v + o.v, {k: _plus(self.g.get(k), o.g.get(k)) for k in {*self.g, *o.g}}, {k: _plus(self.h.get(k), o.h.get(k)) for k in {*self.h, *o.h}})

    def __mul__(self, o: Jet) -> Jet:
        g = {k: _plus(self.g[k] * o.v if k in self.g else None, o.g[k] * self.v if k in o.g else None) for k in {*self.g, *o.g}}
        h = {k: _plus(self.h[k] * o.v if k in self.h else None, o.h[k] * self.v if k in o.h else None) for k in {*self.h, *o.h}}
        for i in self.g:
            for j in o.g:
                k = (min(i, j), max(i, j))
                h[k] = _plus(h.get(k), self.g[i] * o.g[j] * (2.0 if i == j else 1.0))
        return Jet(self.v * o.v, g, h)

    def scaled(self, c: Column | float) -> Jet:
        return Jet(self.v * c, {k: x * c for k, x in self.g.items()}, {k: x * c for k, x in self.h.items()})

    def apply(self, f: Column, d: Column, dd: Column) -> Jet:
        """Chain rule for a function with value f and derivatives d and dd at v."""
        h = {k: x * d for k, x in self.h.items()}
        keys = sorted(self.g)
        for a, i in enumerate(keys):
            for j in keys[a:]:
                h[(i, j)] = _plus(h.get((i, j)), dd * self.g[i] * self.g[j])
        return Jet(f, {k: x * d for k, x in self.g.items()}, h)

    def exp(self) -> Jet:
        e = F.exp(self.v)
        return self.apply(e, e, e)

    def log(self) -> Jet:
        return self.apply(F.ln(self.v), 1 / self.v, -1 / (self.v * self.v))

    def power(self, p: float) -> Jet:
        return self.apply(F.pow(self.v, F.lit(p)), p * F.pow(self.v, F.lit(p - 1)), p * (p - 1) * F.pow(self.v, F.lit(p - 2)))

    def inverse(self) -> Jet:
        return self.apply(1 / self.v, -1 / (self.v * self.v), 2 / (self.v * self.v * self.v))


def choose(cond: Column, a: Jet, b: Jet) -> Jet:
    pick = lambda x, y: F.when(cond, F.lit(0.0) if x is None else x).otherwise(F.lit(0.0) if y is None else y)
    return Jet(pick(a.v, b.v), {k: pick(a.g.get(k), b.g.get(k)) for k in {*a.g, *b.g}}, {k: pick(a.h.get(k), b.h.get(k)) for k in {*a.h, *b.h}})


def _parameter(i: int, value: float, fixed: bool) -> Jet:
    return Jet(F.lit(float(value)), {} if fixed else {i: F.lit(1.0)})


def _constant(x: Column | float) -> Jet:
    return Jet(x if isinstance(x, Column) else F.lit(float(x)))


def _dose(parts: list[tuple[int, Element]], x: Column) -> Jet:
    """A dose subterm of one to three parameters."""
    b = [_parameter(i, e.value, e.fixed) for i, e in parts]
    kind, v = parts[0][1].subterm, [e.value for _, e in parts]
    if kind == "loglin_slope":
        return b[0] * b[1].scaled(x).exp() if len(b) > 1 else b[0].scaled(F.exp(x * 0.0))
    if kind == "loglin_top":
        return b[0].scaled(x).exp()
    if kind == "quad_slope":
        return b[0].scaled(x * x)
    if kind == "lin_slope":
        return choose(x - v[1] > 0, b[0] * (b[1].scaled(-1.0) + x), _constant(0.0))
    if kind == "step_slope":
        return choose(x >= v[1], b[0], _constant(0.0))
    if kind == "lin_quad_slope":
        beyond = b[0] * b[1].inverse().scaled(x * x / 2) + b[0] * b[1].scaled(0.5)
        return choose(x < v[1], b[0].scaled(x), beyond)
    sign = 1.0 if v[0] >= 0 else -1.0
    size = b[0].scaled(sign)
    c = size.log() + b[2].log().scaled(-1.0) + b[1] * b[2]
    top = size * b[1] + (c + (b[1] * b[2]).scaled(-1.0)).exp()
    beyond = (top + (c + b[2].scaled(-x)).exp().scaled(-1.0)).scaled(sign)
    return choose(x < v[1], b[0].scaled(x), beyond)


def _term(parts: list[tuple[int, Element]], column: Callable[[str], Column]) -> Jet:
    """LIN * PLIN * LOGLIN * DOSE of one term; empty LIN and DOSE count as 1, PLIN starts at 1."""
    groups: dict[str, Jet] = {}
    product: Jet | None = None
    i = 0
    while i < len(parts):
        at, e = parts[i]
        x = column(e.column)
        width = 1
        if e.subterm in ("loglin", "lin", "plin"):
            one = _parameter(at, e.value, e.fixed).scaled(x)
            if e.subterm == "loglin":
                product = one if product is None else product + one
            else:
                groups[e.subterm] = groups[e.subterm] + one if e.subterm in groups else one
        else:
            want = PARTNERS.get(e.subterm, ())
            while width <= len(want) and i + width < len(parts) and parts[i + width][1].subterm == want[width - 1]:
                width += 1
            if width - 1 < len(want) and e.subterm != "loglin_slope":
                raise ValueError(f"{e.subterm} needs {want}")
            if not want and e.subterm not in ("quad_slope", "loglin_top"):
                raise ValueError(f"{e.subterm} has no slope before it")
            dose = _dose(parts[i : i + width], x)
            groups["dose"] = groups["dose"] + dose if "dose" in groups else dose
        i += width
    out = product.exp() if product is not None else None
    if "plin" in groups:
        p = groups["plin"] + 1.0
        out = p if out is None else out * p
    for k in ("lin", "dose"):
        if k in groups:
            out = groups[k] if out is None else out * groups[k]
    return out


def risk(model: Model, column: Callable[[str], Column] | None = None) -> Jet:
    """R(x; beta) with derivatives over the free parameters (indices of model.elements)."""
    column = column or (lambda c: F.lit(1.0) if c == "CONST" else F.col(f"`{c}`").cast("double"))
    if model.null or not model.elements:
        return Jet(F.lit(1.0))
    numbers = sorted({e.term for e in model.elements})
    terms = [_term([(i, e) for i, e in enumerate(model.elements) if e.term == t], column) for t in numbers]
    form = "M" if len(terms) == 1 and model.form != "GMIX" else model.form
    first, rest = terms[0], terms[1:]
    if form == "A":
        return sum(rest, first)
    if form in ("PA", "PAE"):
        total = sum(rest[1:], rest[0])
        return first * (total + 1.0 if form == "PAE" else total)
    if form == "M":
        for t in rest:
            first = first * t
        return first
    if form == "ME":
        for t in rest:
            first = first * (t + 1.0)
        return first
    if not rest:
        return first
    flags = model.excess or (True,) * len(rest)
    star = [t + 1.0 if e else t for t, e in zip(rest, flags, strict=True)]
    product, added = star[0], star[0] + -1.0
    for s in star[1:]:
        product, added = product * s, added + (s + -1.0)
    return first * product.power(model.theta) * (added + 1.0).power(1 - model.theta)


def linked_dose(kind: str, slope: float, y: float, goal: float = 0.0) -> dict[str, float]:
    """Parameters that join the two parts of a linear-quadratic or linear-exponential dose smoothly at y."""
    if kind == "quad":
        return {"threshold": y, "slope": slope, "quad_slope": slope / 2 / y, "quad_intercept": slope * y / 2}
    if kind == "exp":
        c = math.log(abs(slope / goal)) + goal * y
        return {"threshold": y, "slope": slope, "plateau": slope * y + math.copysign(math.exp(c - goal * y), slope), "exp_slope": goal, "exp_constant": c}
    raise ValueError("kind is quad or exp")


def linked_exp_slope(y: float, slope: float, plateau: float) -> float:
    """The exponential slope with which a linear-exponential dose reaches the plateau."""
    if slope == 0 or y < 0 or plateau == slope * y or (plateau - slope * y) * slope < 0:
        raise ValueError("the plateau must lie beyond the linear part")
    return slope / (plateau - slope * y)
