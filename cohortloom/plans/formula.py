"""The formula language: "Cox(t0, t1, e) ~ loglinear(a, 0) + plinear(b, 0) + multiplicative()"."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import Element, Model
from ..operators import prep

#: Spellings of subterms and model forms.
SUBTERM_NAMES = {
    "loglin": ("loglin",), "loglinear": ("loglin",), "log_linear": ("loglin",), "lin": ("lin",), "linear": ("lin",), "plin": ("plin",), "plinear": ("plin",), "product_linear": ("plin",),
    "loglin_dose": ("loglin_slope", "loglin_top"), "loglinear_dose": ("loglin_slope", "loglin_top"), "lin_dose": ("lin_slope", "lin_int"), "linear_dose": ("lin_slope", "lin_int"), "linear_piecewise": ("lin_slope", "lin_int"),
    "quad": ("quad_slope",), "quadratic": ("quad_slope",), "quad_dose": ("quad_slope",), "step": ("step_slope", "step_int"), "step_dose": ("step_slope", "step_int"),
    "lin_quad": ("lin_quad_slope", "lin_quad_int"), "linear_quadratic_dose": ("lin_quad_slope", "lin_quad_int"), "linquad": ("lin_quad_slope", "lin_quad_int"),
    "lin_exp": ("lin_exp_slope", "lin_exp_int", "lin_exp_exp_slope"), "linear_exponential_dose": ("lin_exp_slope", "lin_exp_int", "lin_exp_exp_slope"), "linexp": ("lin_exp_slope", "lin_exp_int", "lin_exp_exp_slope"),
}
FORM_NAMES = {"m": "M", "multiplicative": "M", "me": "ME", "multiplicative_excess": "ME", "multiplicative-excess": "ME", "a": "A", "additive": "A", "pa": "PA", "product_additive": "PA", "product-additive": "PA", "pae": "PAE", "product_additive_excess": "PAE", "product-additive-excess": "PAE", "gmix": "GMIX", "geometric_mixture": "GMIX"}
FAMILIES = {
    "cox": "cox", "coxph": "cox", "cx": "cox", "cox_strata": "cox", "coxph_strata": "cox",
    "finegray": "finegray", "fine_gray": "finegray", "fg": "finegray", "finegray_strata": "finegray", "fine_gray_strata": "finegray", "fg_strata": "finegray",
    "poisson": "poisson", "pois": "poisson", "poisson_strata": "poisson", "pois_strata": "poisson",
    "casecon": "casecontrol", "casecontrol": "casecontrol", "case_control": "casecontrol", "casecon_time": "casecontrol", "casecontrol_time": "casecontrol", "case_control_time": "casecontrol",
    "casecon_strata": "casecontrol", "casecontrol_strata": "casecontrol", "case_control_strata": "casecontrol", "casecon_strata_time": "casecontrol", "casecontrol_strata_time": "casecontrol",
    "case_control_strata_time": "casecontrol", "casecon_time_strata": "casecontrol", "casecontrol_time_strata": "casecontrol", "case_control_time_strata": "casecontrol",
    "logit": "logit", "logistic": "logit",
}
FUNCTIONS = {"exp": F.exp, "log": F.ln, "sqrt": F.sqrt, "abs": F.abs, "log2": F.log2, "log10": F.log10, "sin": F.sin, "cos": F.cos, "floor": F.floor, "ceiling": F.ceil}


def register(name: str, function: Callable[[Column], Column]) -> None:
    """Let formulas use `name(x)`, which makes the column `x_name`."""
    FUNCTIONS[name] = function


def matched(name: str, choices) -> str | None:
    """The choice of that name, or the only one that starts with it."""
    if name in choices:
        return name
    found = [c for c in choices if c.startswith(name)]
    return found[0] if len(found) == 1 else None


@dataclass
class Survival:
    family: str
    start: str | None = None
    end: str | None = None
    event: str = ""
    pyr: str | None = None
    trials: str | None = None
    weight: str | None = None
    strata: list[str] = field(default_factory=list)


def split_args(text: str) -> list[str]:
    """Split at commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return [x for x in out if x]


def literal(text: str):
    """A number, true or false, a quoted string, or c(...) and list(...) of them."""
    if m := re.fullmatch(r"(?:c|list)\((.*)\)", text):
        items = split_args(m[1])
        if all("=" in x for x in items) and items:
            return {k: literal(v) for k, v in (x.split("=", 1) for x in items)}
        return [literal(x) for x in items]
    if text.upper() in ("TRUE", "T", "FALSE", "F"):
        return text.upper() in ("TRUE", "T")
    try:
        return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
    except ValueError:
        return text.strip("\"'")


def left_side(text: str) -> Survival:
    m = re.fullmatch(r"(\w+)\((.*)\)", text)
    kind = matched(m[1].lower(), FAMILIES) if m else None
    if not kind:
        raise ValueError(f"unknown survival type in {text!r}")
    family = FAMILIES[kind]
    free, named = [], {}
    for a in split_args(m[2]):
        if "=" in a:
            k, v = a.split("=", 1)
            named[k] = v
        else:
            free.append(a)
    s = Survival(family)
    wants = {"cox": ["start", "end", "event"], "finegray": ["start", "end", "event"], "poisson": ["pyr", "event"], "logit": ["trials", "event"], "casecontrol": ["start", "end", "event"] if "time" in kind else ["event"]}[family]
    wants = [*wants, *(["strata"] if "strata" in kind else []), *(["weight"] if family == "finegray" else [])]
    rename = {"tstart": "start", "tend": "end", "person_years": "pyr", "strata": "strata", "weight": "weight"}
    named = {matched(k.lower(), ("tstart", "tend", "start", "end", "event", "strata", "weight", "pyr", "person_years", "trials")) or k: v for k, v in named.items()}
    for k, v in named.items():
        k = rename.get(k, k)
        if k not in wants:
            raise ValueError(f"unknown argument {k}")
        setattr(s, k, [x.strip() for x in split_args(v[2:-1])] if k == "strata" and v.startswith("c(") else [v] if k == "strata" else v)
    left = [w for w in wants if w not in {rename.get(k, k) for k in named}]
    if family == "poisson" and "strata" in left:
        if len(free) < 3:
            raise ValueError("strata are missing")
        s.pyr, s.event, s.strata = free[0], free[1], free[2:]
    else:
        if len(free) == len(left) - 1 and "start" in left:
            left.remove("start")
        elif len(free) == len(left) - 1 and "trials" in left:
            left.remove("trials")
        if len(free) != len(left):
            raise ValueError(f"{text!r} has {len(free)} arguments for {left}")
        for w, v in zip(left, free, strict=True):
            setattr(s, w, [v] if w == "strata" else v)
    if not s.event:
        raise ValueError("the event column is missing")
    return s


@dataclass
class Formula:
    survival: Survival
    model: Model
    data: DataFrame
    replay: list[tuple]

    def on(self, df: DataFrame) -> DataFrame:
        """The same derived columns on other rows: levels and knots are those of the first."""
        for step in self.replay:
            df = _apply(df, step)
        return df


def _apply(df: DataFrame, step: tuple) -> DataFrame:
    kind, col, *rest = step
    if kind == "levels":
        return df.withColumns({n: F.when(F.col(col) == F.lit(v), 1).otherwise(0) for n, v in rest[0]})
    if kind == "power":
        return prep.power(df, col, rest[0])
    if kind == "product":
        x = F.col(rest[0][0])
        for c in rest[0][1:]:
            x = x * F.col(c)
        return df.withColumn(col, x)
    if kind == "ns":
        inner, lo, hi, intercept = rest
        return df.withColumns({f"{col}_ns{i + 1}": c for i, c in enumerate(prep.natural_spline(F.col(col).cast("double"), inner, lo, hi, intercept))})
    if kind == "bs":
        inner, lo, hi, degree, intercept = rest
        return df.withColumns({f"{col}_bs{i + 1}": c for i, c in enumerate(prep.b_spline(F.col(col).cast("double"), inner, lo, hi, degree, intercept))})
    if kind == "function":
        return df.withColumn(f"{col}_{rest[0]}", FUNCTIONS[rest[0]](F.col(col)))
    raise ValueError(kind)


def _derived(df: DataFrame, text: str, replay: list[tuple]) -> tuple[DataFrame, list[str]]:
    """The columns that one item of a subterm stands for, made where needed."""
    if "*" in text and not re.match(r"I\(", text):
        parts = []
        for p in re.split(r"\*(?![^(]*\))", text):
            df, cols = _derived(df, p, replay)
            parts.append(cols)
        df, names = prep.formula_interaction(df, parts)
        replay += [("product", n, n.split(":")) for n in names if ":" in n]
        return df, names
    m = re.fullmatch(r"([A-Za-z_.]\w*)\((.*)\)", text)
    if not m:
        if text != "CONST" and text not in df.columns:
            raise ValueError(f"column {text} is missing")
        return df, [text]
    name, args = m[1], split_args(m[2])
    named = {k: literal(v) for k, v in (a.split("=", 1) for a in args if re.match(r"[A-Za-z.]+=", a))}
    col = next(a for a in args if not re.match(r"[A-Za-z.]+=", a)) if name != "I" else args[0]
    if name == "factor":
        lv = named.get("levels") or prep.levels(df, col)
        labels = named.get("labels") or lv
        step = ("levels", col, [(f"{col}_{b}", v) for v, b in list(zip(lv, labels, strict=True))[1:]])
        out = [n for n, _ in step[2]]
    elif name == "I":
        base, n = args[0].split("^")
        step, out = ("power", base, float(n)), [f"{base}^{float(n):g}"]
    elif name in ("ns", "bs"):
        degree = int(named.get("degree", 3))
        count = max(0, int(named["df"]) - (1 if name == "ns" else degree) - bool(named.get("intercept"))) if "df" in named else 0
        inner, lo, hi = prep.knots(df, col, 0 if "knots" in named else count)
        if "knots" in named:
            inner = [float(k) for k in (named["knots"] if isinstance(named["knots"], list) else [named["knots"]])]
        if "Boundary.knots" in named:
            lo, hi = map(float, named["Boundary.knots"])
        step = ("ns", col, inner, lo, hi, bool(named.get("intercept"))) if name == "ns" else ("bs", col, inner, lo, hi, degree, bool(named.get("intercept")))
        k = len(inner) + (1 if name == "ns" else degree) + bool(named.get("intercept"))
        out = [f"{col}_{name}{i + 1}" for i in range(k)]
    elif name in FUNCTIONS:
        step, out = ("function", col, name), [f"{col}_{name}"]
    else:
        raise ValueError(f"unknown function {name}; register it in FUNCTIONS")
    replay.append(step)
    return _apply(df, step), out


def _independent(df: DataFrame, elements: list[Element]) -> list[Element]:
    """Without the columns that depend linearly on earlier ones of the same subterm and term."""
    groups: dict[tuple, list[str]] = {}
    for e in elements:
        groups.setdefault((e.subterm, e.term), []).append(e.column)
    kept = {k: prep.independent_columns(df, list(dict.fromkeys(c))) if len(c) > 1 else c for k, c in groups.items()}
    out, seen = [], set()
    for e in elements:
        at = (e.subterm, e.term, e.column)
        if e.column in kept[at[:2]] and at not in seen:
            out.append(e)
        seen.add(at)
    return out


def parse(text: str, df: DataFrame, check_rank: bool = True) -> Formula:
    """Model, data with derived columns, and the steps to derive them again; dependent columns of a subterm and term go."""
    text = re.sub(r"\s+", "", text)
    left, _, right = text.partition("~")
    survival = left_side(left)
    elements: list[Element] = []
    form, theta, excess, null = "ME", 0.5, (), False
    replay: list[tuple] = []
    given = False
    for piece in _pieces(right):
        m = re.fullmatch(r"([\w-]+)\((.*)\)", piece)
        if not m:
            raise ValueError(f"cannot read {piece!r}")
        name, args = m[1].lower(), split_args(m[2])
        if name == "null":
            null = True
        elif name in FORM_NAMES or name in ("gmix-r", "gmix-e"):
            if given:
                raise ValueError("two model forms")
            given = True
            form = FORM_NAMES.get(name, "GMIX")
            if form == "GMIX":
                values = [literal(a.split("=")[-1]) for a in args]
                theta = float(values[0]) if values else 0.5
                excess = tuple(str(v).lower() in ("e", "1", "true") for v in values[1:])
        elif name in SUBTERM_NAMES:
            term = int(args[-1]) if re.fullmatch(r"\d+", args[-1]) else 0
            items = args[:-1] if re.fullmatch(r"\d+", args[-1]) else args
            for item in items:
                df, cols = _derived(df, item, replay)
                elements += [Element(c, term, s) for c in cols for s in SUBTERM_NAMES[name]]
        else:
            raise ValueError(f"unknown subterm {name}")
    if check_rank:
        elements = _independent(df, elements)
    if not null and not elements:
        raise ValueError("the model has no parameters")
    terms = sorted({e.term for e in elements})
    if terms and terms != list(range(len(terms))):
        raise ValueError("term numbers must be 0, 1, 2, ...")
    if len(terms) == 1:
        form = "M"
    order = sorted(range(len(elements)), key=lambda i: (elements[i].term, i))
    return Formula(survival, Model(tuple(elements[i] for i in order), form, theta, excess, null), df, replay)


def _pieces(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "+" and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def parse_joint(formulas: Sequence[str], df: DataFrame) -> tuple[Survival, Model, DataFrame]:
    """Poisson formulas with one event each, and at most one without an event column of its own ("shared"), on the stacked table."""
    parsed, events, specific, shared = [], [], {}, []
    for f in formulas:
        p = parse(f, df)
        df = p.data
        parsed.append(p)
        if p.survival.event != "shared":
            events.append(p.survival.event)
    first = parsed[0]
    if any(p.survival.pyr != first.survival.pyr or p.survival.strata != first.survival.strata for p in parsed):
        raise ValueError("person-years and strata must agree")
    elements: list[Element] = []
    for p in parsed:
        e = p.survival.event
        if e == "shared":
            shared += p.model.elements
        else:
            specific[e] = [x.column for x in p.model.elements]
            elements += [Element(f"{x.column}_{e}", x.term, x.subterm, x.value, x.fixed) for x in p.model.elements]
    stacked = prep.joint_events(df, events, (), specific)
    s = Survival("poisson", event="events", pyr=first.survival.pyr, strata=first.survival.strata)
    forms = {p.model.form for p in parsed if p.model.form != "M"} or {"M"}
    every = sorted([*elements, *shared], key=lambda x: x.term)
    return s, Model(tuple(every), forms.pop() if len({e.term for e in every}) > 1 else "M"), stacked
