"""Standard normal distribution as Column expressions (Spark has no erf)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Rational approximation of the normal integral (Hart 1968, West 2005).
CDF_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)

# Inverse normal, algorithm AS 241 (Wichura 1988), highest power first.
PPF_CENTRE = (
    (2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4,
     4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3,
     1.3314166789178437745e+2, 3.3871328727963666080e+0),
    (5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4,
     2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2,
     4.2313330701600911252e+1, 1.0),
)
PPF_MIDDLE = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0,
     4.63033784615654529590e+0, 1.42343711074968357734e+0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0,
     2.05319162663775882187e+0, 1.0),
)
PPF_TAIL = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0,
     5.46378491116411436990e+0, 6.65790464350110377720e+0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0),
)


def _poly(coefficients, x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def bind(x: Column, body) -> Column:
    """``body(x)`` with x evaluated once: a one-element array keeps the tree small when the
    argument is itself a long expression."""
    return F.transform(F.array(x), body)[0]


def _upper_tail(a: Column) -> Column:
    bell = F.exp(-a * a / 2.0)
    near = bell * _poly(CDF_NUMERATOR, a) / _poly(CDF_DENOMINATOR, a)
    fraction = a + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = a + F.lit(k) / fraction
    far = bell / fraction / 2.506628274631
    return F.when(a > 37.0, 0.0).when(a < 7.07106781186547, near).otherwise(far)


def _signed(z: Column, upper: Column) -> Column:
    return F.when(z > 0, 1.0 - upper).when(z.isNotNull(), upper)


def _tail_root(p: Column) -> Column:
    return F.sqrt(-F.log(F.least(p, 1.0 - p)))


def _quantile(p: Column, r: Column) -> Column:
    q = p - 0.5
    centre_r = F.lit(0.180625) - q * q
    centre = q * _poly(PPF_CENTRE[0], centre_r) / _poly(PPF_CENTRE[1], centre_r)
    middle = _poly(PPF_MIDDLE[0], r - 1.6) / _poly(PPF_MIDDLE[1], r - 1.6)
    tail = _poly(PPF_TAIL[0], r - 5.0) / _poly(PPF_TAIL[1], r - 5.0)
    outer = F.signum(q) * F.when(r <= 5.0, middle).otherwise(tail)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (F.abs(q) <= 0.425), centre).when(inside, outer)


def norm_cdf(z: Column) -> Column:
    """Φ(z); null stays null."""
    return bind(z, lambda x: _signed(x, _upper_tail(F.abs(x))))


def norm_ppf(p: Column) -> Column:
    """Φ⁻¹(p); null outside (0, 1)."""
    return bind(p, lambda x: bind(_tail_root(x), lambda r: _quantile(x, r)))


def with_norm_cdf(df: DataFrame, out: str, z: Column) -> DataFrame:
    """Column ``out`` = Φ(z), staged over projections so that all of it is compiled."""
    return (
        df.withColumn("_z", z)
        .withColumn("_a", F.abs("_z"))
        .withColumn(out, _signed(F.col("_z"), _upper_tail(F.col("_a"))))
        .drop("_z", "_a")
    )


def with_norm_ppf(df: DataFrame, out: str, p: Column) -> DataFrame:
    """Column ``out`` = Φ⁻¹(p), staged over projections so that all of it is compiled."""
    return (
        df.withColumn("_p", p)
        .withColumn("_r", _tail_root(F.col("_p")))
        .withColumn(out, _quantile(F.col("_p"), F.col("_r")))
        .drop("_p", "_r")
    )


def norm_ppf_array(p):
    """Φ⁻¹ of a numpy array, from the same rational functions."""
    p = np.asarray(p, dtype=float)
    with np.errstate(all="ignore"):
        q = p - 0.5
        c = 0.180625 - q * q
        r = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
        value = lambda pair, x: np.polyval(pair[0], x) / np.polyval(pair[1], x)
        outer = np.where(r <= 5.0, value(PPF_MIDDLE, r - 1.6), value(PPF_TAIL, r - 5.0))
        return np.where(np.abs(q) <= 0.425, q * value(PPF_CENTRE, c), np.sign(q) * outer)


def norm_cdf_array(z):
    """Φ of a numpy array, from the same rational functions."""
    z = np.asarray(z, dtype=float)
    with np.errstate(all="ignore"):
        a = np.minimum(np.abs(z), 40.0)
        bell = np.exp(-a * a / 2.0)
        near = bell * np.polyval(CDF_NUMERATOR, a) / np.polyval(CDF_DENOMINATOR, a)
        fraction = a + 0.65
        for k in (4.0, 3.0, 2.0, 1.0):
            fraction = a + k / fraction
        upper = np.where(a > 37.0, 0.0, np.where(a < 7.07106781186547, near, bell / fraction / 2.506628274631))
        return np.where(z > 0, 1.0 - upper, np.where(np.isnan(z), np.nan, upper))
