"""Bivariate copula families.

A family gives C(u, v), the conditional h = ∂C/∂u and the density of its unrotated form;
rotations follow by the chain rule. Archimedean families come from their generator φ:
C = φ⁻¹(φ(u) + φ(v)), h = φ'(u)/φ'(C), c = −φ''(C)/φ'(C) · φ'(u)/φ'(C) · φ'(v)/φ'(C).
Only built-in functions are used on Columns. The same formulas accept numpy arrays: the
θ-grid likelihood evaluates them on Arrow batches inside the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meteospan.functions.normal import bind, norm_cdf, norm_cdf_array, norm_ppf, norm_ppf_array

EDGE = 1e-9
ROTATIONS = (0, 90, 180, 270)


def _is_column(*xs) -> bool:
    return any(isinstance(x, Column) for x in xs)


def _div(a, b):
    """Division that yields null (or inf) instead of an ANSI error."""
    if _is_column(a, b):
        return F.try_divide(a if isinstance(a, Column) else F.lit(float(a)), b)
    return a / b


def _pow(x, k):
    if _is_column(x, k):
        return F.pow(x, k if isinstance(k, Column) else F.lit(float(k)))
    return np.power(x, k)


def _log(x):
    return F.log(x) if _is_column(x) else np.log(x)


def _exp(x):
    return F.exp(x) if _is_column(x) else np.exp(x)


def _sqrt(x):
    return F.sqrt(x) if _is_column(x) else np.sqrt(x)


def _within(x, lo: float, hi: float):
    if _is_column(x):
        return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    return np.clip(x, lo, hi)


def clamp(x):
    return _within(x, EDGE, 1.0 - EDGE)


@dataclass(frozen=True)
class Family:
    """``cdf``, ``h``, ``density`` take (u, v, θ); ``h`` is P(V ≤ v | U = u)."""

    name: str
    start: float
    lo: float
    hi: float
    rotates: bool
    symmetric: bool
    cdf: Callable
    h: Callable
    density: Callable
    inverse: Callable | None = None


def _archimedean(phi, d1, d2, inv):
    def joint(u, v, k):
        # far in a corner C underflows; keep it inside the domain of the generator
        return _within(inv(phi(u, k) + phi(v, k), k), 1e-300, 1.0 - 1e-16)

    def h(u, v, k):
        return _div(d1(u, k), d1(joint(u, v, k), k))

    def density(u, v, k):
        c = joint(u, v, k)
        slope = d1(c, k)
        return -_div(d2(c, k), slope) * _div(d1(u, k), slope) * _div(d1(v, k), slope)

    return dict(cdf=joint, h=h, density=density)


def _clayton():
    def base(u, v, k):
        return _pow(u, -k) + _pow(v, -k) - 1.0

    return dict(
        cdf=lambda u, v, k: _pow(base(u, v, k), _div(-1.0, k)),
        h=lambda u, v, k: _pow(u, -k - 1.0) * _pow(base(u, v, k), _div(-1.0, k) - 1.0),
        density=lambda u, v, k: (k + 1.0) * _pow(u * v, -k - 1.0) * _pow(base(u, v, k), _div(-1.0, k) - 2.0),
        inverse=lambda u, q, k: _pow((_pow(q, _div(-k, k + 1.0)) - 1.0) * _pow(u, -k) + 1.0, _div(-1.0, k)),
    )


def _gumbel_barnett():
    def bend(u, v, k):
        return _exp(-k * _log(u) * _log(v))

    return dict(
        cdf=lambda u, v, k: u * v * bend(u, v, k),
        h=lambda u, v, k: v * bend(u, v, k) * (1.0 - k * _log(v)),
        density=lambda u, v, k: bend(u, v, k) * ((1.0 - k * _log(u)) * (1.0 - k * _log(v)) - k),
    )


def _joe():
    def parts(u, v, k):
        a, b = _pow(1.0 - u, k), _pow(1.0 - v, k)
        return a, b, a + b - a * b

    def cdf(u, v, k):
        return 1.0 - _pow(parts(u, v, k)[2], _div(1.0, k))

    def h(u, v, k):
        _, b, s = parts(u, v, k)
        return _pow(s, _div(1.0, k) - 1.0) * _pow(1.0 - u, k - 1.0) * (1.0 - b)

    def density(u, v, k):
        s = parts(u, v, k)[2]
        corner = _pow((1.0 - u) * (1.0 - v), k - 1.0)
        return corner * _pow(s, _div(1.0, k) - 2.0) * (k - 1.0 + s)

    return dict(cdf=cdf, h=h, density=density)


def _ali_mikhail_haq():
    def low(u, v, k):
        return 1.0 - k * (1.0 - u) * (1.0 - v)

    def density(u, v, k):
        d = low(u, v, k)
        top = 1.0 + k * (u + v + u * v - 2.0) + k * k * (1.0 - u) * (1.0 - v)
        return _div(top, d * d * d)

    return dict(
        cdf=lambda u, v, k: _div(u * v, low(u, v, k)),
        h=lambda u, v, k: _div(v * (1.0 - k * (1.0 - v)), low(u, v, k) * low(u, v, k)),
        density=density,
    )


def _plackett():
    def parts(u, v, k):
        # the independent case k = 1 is the limit; step off the removable singularity
        if _is_column(k):
            e = F.when(F.abs(k - 1.0) < 1e-7, F.lit(1e-7)).otherwise(k - 1.0)
        else:
            e = np.where(np.abs(k - 1.0) < 1e-7, 1e-7, k - 1.0)
        s = 1.0 + e * (u + v)
        return e, s, s * s - 4.0 * (e + 1.0) * e * u * v

    def cdf(u, v, k):
        e, s, r = parts(u, v, k)
        return _div(s - _sqrt(r), 2.0 * e)

    def h(u, v, k):
        e, _, r = parts(u, v, k)
        return 0.5 - 0.5 * _div(e * u + 1.0 - (e + 2.0) * v, _sqrt(r))

    def density(u, v, k):
        e, _, r = parts(u, v, k)
        return _div((e + 1.0) * (1.0 + e * (u + v - 2.0 * u * v)), r * _sqrt(r))

    return dict(cdf=cdf, h=h, density=density)


def _legendre(n: int) -> list[tuple[float, float]]:
    """Nodes and weights of Gauss–Legendre quadrature on (0, 1) by Newton steps."""
    rule = []
    for i in range(1, n + 1):
        x = math.cos(math.pi * (i - 0.25) / (n + 0.5))
        for _ in range(50):
            p0, p1 = 1.0, x
            for j in range(2, n + 1):
                p0, p1 = p1, ((2 * j - 1) * x * p1 - (j - 1) * p0) / j
            slope = n * (x * p1 - p0) / (x * x - 1.0)
            x -= p1 / slope
        rule.append(((1.0 - x) / 2.0, 1.0 / ((1.0 - x * x) * slope * slope)))
    return rule


def _scores(u, v, body) -> Column:
    """``body`` of the two normal scores."""
    return bind(norm_ppf(u), lambda x: bind(norm_ppf(v), lambda y: body(x, y)))


def gaussian_density(x, y, k):
    """Density from normal scores x = Φ⁻¹(u), y = Φ⁻¹(v)."""
    rest = 1.0 - k * k
    return _exp((2.0 * k * x * y - k * k * (x * x + y * y)) / (2.0 * rest)) / _sqrt(rest)


def _gaussian():
    rule = _legendre(32)

    def cdf(u, v, k):
        if not _is_column(u, v, k):
            x, y, total = norm_ppf_array(u), norm_ppf_array(v), 0.0
            for t, w in rule:
                s = np.sin(np.arcsin(k) * t)
                total = total + w * np.exp(-(x * x + y * y - 2.0 * x * y * s) / (2.0 * (1.0 - s * s)))
            return u * v + np.arcsin(k) / (2.0 * math.pi) * total
        # Φ₂(x, y; ρ) = uv + ∫₀^asin ρ exp(−(x² + y² − 2xy sin t)/(2 cos² t)) dt / 2π
        nodes = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in rule])

        def integral(x, y):
            def add(total, node):
                return total + bind(
                    F.sin(F.asin(k) * node["t"]),
                    lambda s: node["w"]
                    * F.exp(-(x * x + y * y - 2.0 * x * y * s) / (2.0 * (1.0 - s * s))),
                )

            return F.aggregate(nodes, F.lit(0.0), add)

        return u * v + F.asin(k) / (2.0 * math.pi) * _scores(u, v, integral)

    def scored(u, v, k, body):
        """Φ of ``body`` of the two normal scores, for Columns and for arrays."""
        if _is_column(u, v, k):
            return _scores(u, v, lambda x, y: norm_cdf(body(x, y, F.sqrt(1.0 - k * k))))
        return norm_cdf_array(body(norm_ppf_array(u), norm_ppf_array(v), np.sqrt(1.0 - k * k)))

    return dict(
        cdf=cdf,
        h=lambda u, v, k: scored(u, v, k, lambda x, y, rest: (y - k * x) / rest),
        density=lambda u, v, k: _scores(u, v, lambda x, y: gaussian_density(x, y, k))
        if _is_column(u, v, k)
        else gaussian_density(norm_ppf_array(u), norm_ppf_array(v), k),
        inverse=lambda u, q, k: scored(u, q, k, lambda x, z, rest: k * x + rest * z),
    )


def _nelsen10():
    return _archimedean(
        lambda t, k: _log(2.0 * _pow(t, -k) - 1.0),
        lambda t, k: _div(-2.0 * k, t * (2.0 - _pow(t, k))),
        lambda t, k: _div(
            2.0 * k * (2.0 - (k + 1.0) * _pow(t, k)), _pow(t * (2.0 - _pow(t, k)), 2.0)
        ),
        lambda x, k: _pow((_exp(x) + 1.0) / 2.0, _div(-1.0, k)),
    )


def _nelsen12():
    odds = lambda t: 1.0 / t - 1.0
    return _archimedean(
        lambda t, k: _pow(odds(t), k),
        lambda t, k: -k * _pow(odds(t), k - 1.0) / (t * t),
        lambda t, k: k * _pow(odds(t), k - 2.0) * (k + 1.0 - 2.0 * t) / _pow(t, 4.0),
        lambda x, k: 1.0 / (_pow(x, _div(1.0, k)) + 1.0),
    )


def _nelsen13():
    m = lambda t: 1.0 - _log(t)
    return _archimedean(
        lambda t, k: _pow(m(t), k) - 1.0,
        lambda t, k: -k * _pow(m(t), k - 1.0) / t,
        lambda t, k: k * _pow(m(t), k - 2.0) * (k - 1.0 + m(t)) / (t * t),
        lambda x, k: _exp(1.0 - _pow(x + 1.0, _div(1.0, k))),
    )


def _nelsen14():
    s = lambda t, k: _pow(t, _div(-1.0, k)) - 1.0

    def second(t, k):
        root = _pow(t, _div(-1.0, k))
        lead = _pow(s(t, k), k - 2.0) * root / (t * t)
        return lead * (_div(k - 1.0, k) * root + s(t, k) * (_div(1.0, k) + 1.0))

    return _archimedean(
        lambda t, k: _pow(s(t, k), k),
        lambda t, k: -_pow(s(t, k), k - 1.0) * _pow(t, _div(-1.0, k) - 1.0),
        second,
        lambda x, k: _pow(_pow(x, _div(1.0, k)) + 1.0, -k),
    )


def _gumbel():
    m = lambda t: -_log(t)
    return _archimedean(
        lambda t, k: _pow(m(t), k),
        lambda t, k: -k * _pow(m(t), k - 1.0) / t,
        lambda t, k: k * _pow(m(t), k - 2.0) * (k - 1.0 + m(t)) / (t * t),
        lambda x, k: _exp(-_pow(x, _div(1.0, k))),
    )


def _independence():
    one = lambda u, k: 1.0 + 0.0 * u
    return dict(
        cdf=lambda u, v, k: u * v,
        h=lambda u, v, k: v,
        density=lambda u, v, k: one(u, k),
        inverse=lambda u, q, k: q,
    )


# Start and bounds of θ, whether 90/180/270 degree rotations exist, and
# whether the copula equals its own 180 degree rotation.
_TABLE = [
    ("alimikailhaq", 0.9, -1.0 + 1e-6, 1.0 - 1e-6, True, False, _ali_mikhail_haq),
    ("clayton", 0.05, 1e-8, 0.1, True, False, _clayton),
    ("gaussian", 0.75, -1.0 + 1e-6, 1.0 - 1e-6, False, True, _gaussian),
    ("gumbel", 1.5, 1.0 + 1e-9, 15.0, True, False, _gumbel),
    ("gumbelbarnett", 0.9, 1e-9, 1.0 - 1e-9, False, False, _gumbel_barnett),
    ("independence", 0.0, 0.0, 0.0, False, True, _independence),
    ("joe", 5.0, 1.0 + 1e-9, 22.5, False, False, _joe),
    ("nelsen10", 0.5, 0.05, 1.0, True, False, _nelsen10),
    ("nelsen12", 1.5, 1.0, 21.0, True, False, _nelsen12),
    ("nelsen13", 0.5, 1e-12, 125.0, True, False, _nelsen13),
    ("nelsen14", 3.0, 1.0, 19.0, True, False, _nelsen14),
    ("plackett", 2.0, 1e-5, 20.0, True, True, _plackett),
]
FAMILIES: dict[str, Family] = {
    name: Family(name, start, lo, hi, rotates, symmetric, **{"inverse": None, **make()})
    for name, start, lo, hi, rotates, symmetric, make in _TABLE
}


def members(families=None) -> list[tuple[str, int]]:
    """(family, rotation) pairs: 36 for all families."""
    names = list(FAMILIES) if families is None else list(families)
    out = []
    for entry in names:
        name, rotation = entry if isinstance(entry, tuple) else (entry, None)
        if rotation is not None:
            out.append((name, rotation))
        else:
            out += [(name, r) for r in (ROTATIONS if FAMILIES[name].rotates else (0,))]
    return out


def _theta(theta) -> Column:
    return theta if isinstance(theta, Column) else F.lit(float(theta))


def turned(u: Column, v: Column, rotation: int) -> tuple[Column, Column]:
    """Arguments of the base copula for a rotated density."""
    return {
        0: (u, v), 90: (u, 1.0 - v), 180: (1.0 - u, 1.0 - v), 270: (1.0 - u, v),
    }[rotation]


def rotate(cdf: Callable, degrees: int) -> Callable:
    """Rotated copula from a function (u, v) → C."""
    return {
        0: cdf,
        90: lambda u, v: u - cdf(u, 1.0 - v),
        180: lambda u, v: u + v - 1.0 + cdf(1.0 - u, 1.0 - v),
        270: lambda u, v: v - cdf(1.0 - u, v),
    }[degrees]


def copula_cdf(family: str, u: Column, v: Column, theta, rotation: int = 0) -> Column:
    k, f = _theta(theta), FAMILIES[family]
    return rotate(lambda a, b: f.cdf(a, b, k), rotation)(clamp(u), clamp(v))


def copula_density(family: str, u: Column, v: Column, theta, rotation: int = 0) -> Column:
    a, b = turned(clamp(u), clamp(v), rotation)
    return FAMILIES[family].density(a, b, _theta(theta))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(x, F.lit(None).cast("double"))))


def h_v_given_u(family: str, u: Column, v: Column, theta, rotation: int = 0) -> Column:
    """P(V ≤ v | U = u) = ∂C/∂u."""
    a, b = turned(clamp(u), clamp(v), rotation)
    base = FAMILIES[family].h(a, b, _theta(theta))
    return _unit(1.0 - base if rotation in (90, 180) else base)


def h_u_given_v(family: str, u: Column, v: Column, theta, rotation: int = 0) -> Column:
    """P(U ≤ u | V = v) = ∂C/∂v; every base family is exchangeable."""
    a, b = turned(clamp(u), clamp(v), rotation)
    base = FAMILIES[family].h(b, a, _theta(theta))
    return _unit(1.0 - base if rotation in (180, 270) else base)


def _bisect(h: Callable, q: Column, steps: int) -> Column:
    """Root of the increasing h(x) = q on (0, 1) by halving, inside one expression."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def halve(state, _):
        mid = (state["lo"] + state["hi"]) / 2.0
        low = F.coalesce(h(mid), F.lit(0.0)) < q
        return F.struct(
            F.when(low, mid).otherwise(state["lo"]).alias("lo"),
            F.when(low, state["hi"]).otherwise(mid).alias("hi"),
        )

    middle = lambda s: (s["lo"] + s["hi"]) / 2.0
    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, middle)
    return F.when(q.isNotNull(), root)


def h_inverse(
    family: str, u: Column, q: Column, theta, rotation: int = 0, steps: int = 45, given: str = "u"
) -> Column:
    """x with h(x | u) = q. ``given="v"``: u holds the value of V and x is on the U axis."""
    k, f = _theta(theta), FAMILIES[family]
    u, q = clamp(u), clamp(q)
    # for a condition on V the roles of 90 and 270 swap, as the base is exchangeable
    r = rotation if given == "u" else {90: 270, 270: 90}.get(rotation, rotation)
    a = 1.0 - u if r in (180, 270) else u
    p = 1.0 - q if r in (90, 180) else q
    if f.inverse is not None:
        x = f.inverse(a, p, k)
        return _unit(1.0 - x if r in (90, 180) else x)
    x = _bisect(lambda mid: f.h(a, clamp(mid), k), p, steps)
    return _unit(1.0 - x if r in (90, 180) else x)


def h_array(family: str, u, v, theta, rotation: int = 0, given: str = "u"):
    """P(V ≤ v | U = u) of numpy arrays; with ``given="v"`` P(U ≤ u | V = v)."""
    a, b = turned(clamp(u), clamp(v), rotation)
    with np.errstate(all="ignore"):
        base = FAMILIES[family].h(a, b, theta) if given == "u" else FAMILIES[family].h(b, a, theta)
    turn = (90, 180) if given == "u" else (180, 270)
    return np.clip(1.0 - base if rotation in turn else base, 0.0, 1.0)


def h_inverse_array(family: str, u, q, theta, rotation: int = 0, given: str = "u", tolerance: float = 1e-14):
    """The array x with h(x | u) = q: closed form, or Newton steps along the density (which is ∂h/∂x)
    inside a bracket, halved where a step would leave it."""
    f, u, q = FAMILIES[family], clamp(np.asarray(u, float)), clamp(np.asarray(q, float))
    r = rotation if given == "u" else {90: 270, 270: 90}.get(rotation, rotation)
    a = 1.0 - u if r in (180, 270) else u
    p = 1.0 - q if r in (90, 180) else q
    k = np.broadcast_to(np.asarray(theta, float), np.broadcast_shapes(np.shape(a), np.shape(p), np.shape(theta)))
    a, p = np.broadcast_to(a, k.shape), np.broadcast_to(p, k.shape)
    with np.errstate(all="ignore"):
        x = f.inverse(a, p, k) if f.inverse is not None else _solve(f, a, p, k, tolerance)
    return np.clip(1.0 - x if r in (90, 180) else x, 0.0, 1.0)


def _solve(f: Family, a, p, k, tolerance: float):
    x = p.copy()
    lo, hi = np.zeros_like(x), np.ones_like(x)
    left = np.flatnonzero(np.isfinite(a + p + k))
    x[~np.isfinite(a + p + k)] = np.nan
    for _ in range(200):
        at, u, goal, theta = x[left], a[left], p[left], k[left]
        inside = clamp(at)
        gap = f.h(u, inside, theta) - goal
        # far in a corner h may not be a number; it counts as too low there
        low = ~(gap >= 0)
        lo[left] = np.where(low, at, lo[left])
        hi[left] = np.where(low, hi[left], at)
        step = at - gap / f.density(u, inside, theta)
        bad = ~((step > lo[left]) & (step < hi[left]))
        after = np.where(bad, (lo[left] + hi[left]) / 2.0, step)
        x[left] = np.where(gap == 0, at, after)
        going = (gap != 0) & (np.abs(after - at) > tolerance) & (hi[left] - lo[left] > tolerance)
        left = left[going]
        if not len(left):
            break
    return x


def by_family(
    build: Callable, used, family: str = "family", rotation: str = "rotation"
) -> Column:
    """``build(name, degrees)`` chosen by two columns, for the members in ``used``."""
    out = None
    for name, degrees in used:
        test = (F.col(family) == name) & (F.col(rotation) == degrees)
        out = F.when(test, build(name, degrees)) if out is None else out.when(test, build(name, degrees))
    return out


def symmetry_flags(spark: SparkSession) -> DataFrame:
    """The families table with bounds and symmetry flags.

    symmetry1: C equals its 180° rotation. symmetry2: C(u, v) = C(v, u). All families are symmetric in
    their arguments; a rotation by 180° keeps that, one by 90° or 270° only for Plackett, whose
    rotation is the Plackett copula of 1/θ.
    """
    rows = []
    for name, degrees in members():
        f = FAMILIES[name]
        second = degrees in (0, 180) or name == "plackett"
        rows.append((name, degrees, f.start, f.lo, f.hi, f.symmetric, second))
    return spark.createDataFrame(
        rows,
        "family string, rotation int, theta_start double, lo double, hi double, symmetry1 boolean, symmetry2 boolean",
    )


def copula_grid(
    spark: SparkSession, family: str, theta: float, n: int = 100, rotation: int = 0
) -> DataFrame:
    """CDF and density at the cell centres of an n × n unit grid."""
    cell = spark.range(n * n)
    u = (F.floor(F.col("id") / n) + 0.5) / n
    v = (F.col("id") % n + 0.5) / n
    return cell.select(u.alias("u"), v.alias("v")).withColumns(
        {
            "cdf": copula_cdf(family, F.col("u"), F.col("v"), theta, rotation),
            "density": copula_density(family, F.col("u"), F.col("v"), theta, rotation),
        }
    )
