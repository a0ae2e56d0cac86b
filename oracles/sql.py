"""SQL counterparts of the queries, written independently for one SQL engine (DuckDB)."""

from __future__ import annotations

import math

VARIABLES = {"discount": "l_discount", "price": "l_extendedprice", "quantity": "l_quantity", "tax": "l_tax"}


def _mean(c):
    return f"CAST(sum(CAST(round({c}*100) AS BIGINT)) AS DOUBLE)/CAST(100*count({c}) AS DOUBLE)"


def _long(name, source, keys):
    parts = [f"SELECT {keys}, time, '{v}' AS variable, {v} AS value FROM {source}" for v in VARIABLES]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


_MEANS = ", ".join(f"{_mean(c)} AS {v}" for v, c in VARIABLES.items())
WIDE = f"wide AS (SELECT l_returnflag AS station, l_shipdate AS time, {_MEANS} FROM lineitem GROUP BY 1,2)"
DAILY = WIDE + ", " + _long("daily", "wide", "station")
ENS = (
    "ewide AS (SELECT CAST(l_suppkey % 8 AS INTEGER) AS realization, l_returnflag AS station, l_shipdate AS time, "
    f"{_MEANS} FROM lineitem GROUP BY 1,2,3), " + _long("ens", "ewide", "realization, station")
)
HOURLY = f"hourly AS (SELECT event_type AS station, 'value' AS variable, date_trunc('hour', ts) AS time, {_mean('value')} AS value FROM events GROUP BY 1,3)"
GAPPY = DAILY + (
    ", gappy AS (SELECT station, variable, time, CASE WHEN NOT (day(time) BETWEEN 5 AND 8 OR time < TIMESTAMP '1995-01-20' "
    "OR time > TIMESTAMP '2001-10-15') THEN value END AS value FROM daily)"
)
ORDERS = (
    f"orders_long AS (SELECT n_name AS station, 'total' AS variable, o_orderdate AS time, {_mean('o_totalprice')} AS value "
    "FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,3)"
)
STATIONS = "stations AS (SELECT n_name AS station, n_nationkey*7.5-90.0 AS longitude, n_nationkey*3.0-36.0 AS latitude FROM nation)"


def _ranked(name, source, keys, col="value", out="u"):
    """Average-rank positions."""
    return (
        f"{name} AS (SELECT *, (rank() OVER (PARTITION BY {keys} ORDER BY {col}) - 1 + "
        f"count(*) OVER (PARTITION BY {keys}, {col}) / 2.0) / count(*) OVER (PARTITION BY {keys}) AS {out} FROM {source})"
    )


RANKS = DAILY + ", " + _ranked("ranks", "daily", "station, variable")
PAIRS = RANKS + (
    ", pairs AS (SELECT a.station, a.variable AS var_u, b.variable AS var_v, a.time, a.u AS u, b.u AS v "
    "FROM ranks a JOIN ranks b ON a.station=b.station AND a.time=b.time AND a.variable<b.variable)"
)
LINES = "lines AS (SELECT l_returnflag AS station, l_orderkey AS \"order\", l_linenumber AS line, l_quantity AS x, l_extendedprice AS y FROM lineitem)"
LINE_RANKS = LINES + ", " + _ranked("lx", "lines", "station", "x", "u") + ", " + _ranked("lr", "lx", "station", "y", "v")
SERIES = "station, variable"
GRP = "station, var_u, var_v"
POS = "row_number() OVER (PARTITION BY station, variable ORDER BY time) - 1"


def _doy_join(source, w, extra="station, variable", doy="dayofyear(s.time)"):
    """Rows of ``source`` s joined to every day of year d whose window holds them."""
    return (
        f"{source} s JOIN range(1, 367) t(d) ON ({doy} > d-{w} AND {doy} <= d+{w}) OR (d < {w} AND {doy} > 365-{w}+d) "
        f"OR (d+{w} > 365 AND {doy} < d+{w}-365)"
    )


def _corr_pairs(source, by, label, min_rows=30, name="c"):
    """Pairwise-complete correlations as a CTE."""
    byj = " AND ".join(f"a.{c}=b.{c}" for c in by + ["time"])
    bys = "".join(f"a.{c}, " for c in by)
    return (
        f"{name} AS (SELECT {bys}a.{label} AS {label}_i, b.{label} AS {label}_j, "
        f"CASE WHEN count(CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN 1 END) > {min_rows} THEN corr(a.value, b.value) END AS corr, "
        f"count(CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN 1 END) AS n, "
        f"avg(CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN 1.0 ELSE 0.0 END) AS overlap "
        f"FROM {source} a JOIN {source} b ON {byj} AND a.{label}<b.{label} GROUP BY {bys}a.{label}, b.{label})"
    )


def _normal_cdf(z):
    """Rational approximation with full double precision, as nested SQL."""
    num = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
    den = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
    a = f"abs({z})"
    poly = lambda cs: "(" + "+".join(f"{c!r}::DOUBLE*pow({a},{len(cs)-1-i})" for i, c in enumerate(cs)) + ")"
    up = f"(exp(-pow({a},2)/2)*{poly(num)}/{poly(den)})"
    return f"CASE WHEN {z} > 0 THEN 1-{up} ELSE {up} END"


def _normal_ppf_cte(name, source, column, out):
    """Φ⁻¹ by bisection on Φ is slow in SQL; Newton steps from a logistic start converge fast."""
    steps = [f"{name}0 AS (SELECT *, CASE WHEN {column} IS NULL THEN NULL ELSE ln({column}/(1-{column}))*0.6 END AS z_ FROM {source})"]
    for i in range(9):
        steps.append(
            f"{name}{i+1} AS (SELECT * REPLACE (z_ - greatest(-1.0, least(1.0, (({_normal_cdf('z_')}) - {column}) / (exp(-z_*z_/2)/{math.sqrt(2*math.pi)!r}))) AS z_) FROM {name}{i})"
        )
    steps.append(f"{name} AS (SELECT * EXCLUDE (z_), z_ AS {out} FROM {name}9)")
    return ", ".join(steps)


# generator, first and second derivative, inverse
_ARCH = {
    "gumbel": ("pow(-ln({t}),{k})", "(-{k}*pow(-ln({t}),{k}-1)/{t})", "({k}*pow(-ln({t}),{k}-2)*({k}-1-ln({t}))/({t}*{t}))", "exp(-pow({x},1/{k}))"),
    "nelsen10": ("ln(2*pow({t},-{k})-1)", "(-2*{k}/({t}*(2-pow({t},{k}))))", "(2*{k}*(2-({k}+1)*pow({t},{k}))/pow({t}*(2-pow({t},{k})),2))", "pow((1+exp({x}))/2,-1/{k})"),
    "nelsen12": ("pow(1/{t}-1,{k})", "(-{k}*pow(1/{t}-1,{k}-1)/({t}*{t}))", "({k}*pow(1/{t}-1,{k}-2)*({k}+1-2*{t})/pow({t},4))", "(1/(1+pow({x},1/{k})))"),
    "nelsen13": ("(pow(1-ln({t}),{k})-1)", "(-{k}*pow(1-ln({t}),{k}-1)/{t})", "({k}*pow(1-ln({t}),{k}-2)*({k}-ln({t}))/({t}*{t}))", "exp(1-pow(1+{x},1/{k}))"),
    "nelsen14": ("pow(pow({t},-1/{k})-1,{k})", "(-pow(pow({t},-1/{k})-1,{k}-1)*pow({t},-1/{k}-1))", "(pow(pow({t},-1/{k})-1,{k}-2)*pow({t},-1/{k}-2)*((({k}-1)/{k})*pow({t},-1/{k})+(pow({t},-1/{k})-1)*(1/{k}+1)))", "pow(1+pow({x},1/{k}),-{k})"),
}
_THETA = {
    "alimikailhaq": 0.6, "clayton": 0.08, "gumbel": 1.4, "gumbelbarnett": 0.5, "joe": 1.6, "nelsen10": 0.5,
    "nelsen12": 1.3, "nelsen13": 1.5, "nelsen14": 1.4, "plackett": 3.0,
}
_FIXED = ("gumbelbarnett", "joe")


def _base(name, u, v, k):
    """cdf, h(v|u), density of the unrotated copula as SQL text."""
    k = f"{k!r}::DOUBLE" if isinstance(k, float) else k
    if name in _ARCH:
        phi, d1, d2, inv = _ARCH[name]
        f = lambda text, **x: text.format(k=k, **x)
        c = f(inv, x=f"({f(phi, t=u)}+{f(phi, t=v)})")
        h = f"{f(d1, t=u)}/{f(d1, t='('+c+')')}"
        dens = f"-{f(d2, t='('+c+')')}*{f(d1, t=u)}*{f(d1, t=v)}/pow({f(d1, t='('+c+')')},3)"
        return c, h, dens
    if name == "clayton":
        s = f"(pow({u},-{k})+pow({v},-{k})-1)"
        return f"pow({s},-1/{k})", f"pow({u},-{k}-1)*pow({s},-1/{k}-1)", f"(1+{k})*pow({u}*{v},-{k}-1)*pow({s},-2-1/{k})"
    if name == "gumbelbarnett":
        e = f"exp(-{k}*ln({u})*ln({v}))"
        return f"{u}*{v}*{e}", f"{v}*{e}*(1-{k}*ln({v}))", f"{e}*((1-{k}*ln({u}))*(1-{k}*ln({v}))-{k})"
    if name == "joe":
        a, b = f"pow(1-{u},{k})", f"pow(1-{v},{k})"
        s = f"({a}+{b}-{a}*{b})"
        return f"1-pow({s},1/{k})", f"pow({s},1/{k}-1)*pow(1-{u},{k}-1)*(1-{b})", f"pow((1-{u})*(1-{v}),{k}-1)*pow({s},1/{k}-2)*({k}-1+{s})"
    if name == "alimikailhaq":
        d = f"(1-{k}*(1-{u})*(1-{v}))"
        return (f"{u}*{v}/{d}", f"{v}*(1-{k}*(1-{v}))/pow({d},2)",
                f"(1+{k}*((1+{u})*(1+{v})-3)+{k}*{k}*(1-{u})*(1-{v}))/pow({d},3)")
    r = f"(pow(1+({k}-1)*({u}+{v}),2)-4*{k}*({k}-1)*{u}*{v})"
    return (f"(1+({k}-1)*({u}+{v})-sqrt({r}))/(2*({k}-1))",
            f"0.5-0.5*(({k}-1)*{u}+1-({k}+1)*{v})/sqrt({r})",
            f"{k}*(1+({k}-1)*({u}+{v}-2*{u}*{v}))/pow({r},1.5)")


def _member(name, rotation, what, u="u", v="v", k=None):
    k = _THETA[name] if k is None else k
    fu, fv = f"(1-{u})", f"(1-{v})"
    a, b = {0: (u, v), 90: (u, fv), 180: (fu, fv), 270: (fu, v)}[rotation]
    if what == "cdf":
        c = _base(name, a, b, k)[0]
        return {0: c, 90: f"{u}-({c})", 180: f"{u}+{v}-1+({c})", 270: f"{v}-({c})"}[rotation]
    if what == "density":
        return _base(name, a, b, k)[2]
    if what == "h":
        h = _base(name, a, b, k)[1]
        return f"1-({h})" if rotation in (90, 180) else h
    h = _base(name, b, a, k)[1]
    return f"1-({h})" if rotation in (180, 270) else h


def _members():
    return [(n, r) for n in _THETA for r in ((0,) if n in _FIXED else (0, 90, 180, 270))]


def _member_query(what, digits=6):
    cols = ", ".join(f"avg({_member(n, r, what)}) AS {n}_{r}" for n, r in _members())
    names = ", ".join(f"{n}_{r}" for n, r in _members())
    return (
        f"WITH {PAIRS}, w AS (SELECT station, var_u, var_v, {cols} FROM pairs GROUP BY ALL) "
        f"SELECT station, var_u, var_v, member, round(mean_value, {digits}) AS mean_value FROM (UNPIVOT w ON {names} INTO NAME member VALUE mean_value)"
    )


def _grid_fit(source, keys, name, lo, hi, log, zooms=4, grid=16, tag="", rotation=0):
    """Zooming grid search as a chain of CTEs; final CTE fit{tag}(keys, theta, loglik, n)."""
    base = ", ".join(keys)
    first = (
        f"exp(ln({lo!r})+i*((ln({hi!r}::DOUBLE)-ln({lo!r}::DOUBLE))/{grid-1}))" if log else f"({lo!r}::DOUBLE)+i*({hi!r}::DOUBLE-({lo!r}::DOUBLE))/{grid-1}"
    )
    dens = "d"
    formula = (
        "exp((2*g.theta*p.x*p.y-g.theta*g.theta*(p.x*p.x+p.y*p.y))/(2*(1-g.theta*g.theta)))/sqrt(1-g.theta*g.theta)"
        if name == "gaussian" else _member(name, rotation, "density", "p.u", "p.v", "g.theta")
    )
    on = " AND ".join(f"p.{c}=g.{c}" for c in keys)
    out = [f"g{tag}0 AS (SELECT {base}, i, least({hi!r}::DOUBLE, greatest({lo!r}::DOUBLE, {first})) AS theta FROM (SELECT DISTINCT {base} FROM {source}), range(0,{grid}) t(i))"]
    for z in range(zooms):
        out.append(
            f"l{tag}{z} AS (SELECT {base}, i, theta, sum(ln(CASE WHEN {dens} > 0 AND {dens} < 'inf'::DOUBLE THEN {dens} ELSE 1e-9 END)) AS ll "
            f"FROM (SELECT {', '.join('p.'+c for c in keys)}, g.i, g.theta, {formula} AS d FROM {source} p JOIN g{tag}{z} g ON {on}) GROUP BY ALL)"
        )
        out.append(
            f"b{tag}{z} AS (SELECT * FROM (SELECT {base}, i, theta, lag(theta) OVER w AS lo, lead(theta) OVER w AS hi, "
            f"row_number() OVER (PARTITION BY {base} ORDER BY ll DESC, i) AS rn FROM l{tag}{z} WINDOW w AS (PARTITION BY {base} ORDER BY i)) WHERE rn=1)"
        )
        out.append(
            f"g{tag}{z+1} AS (SELECT {base}, t.i, coalesce(lo,theta)+(coalesce(hi,theta)-coalesce(lo,theta))*t.i/{grid-1} AS theta FROM b{tag}{z}, range(0,{grid}) t(i))"
        )
    out.append(
        f"fit{tag} AS (SELECT {base}, any_value(theta) AS theta, sum(ln(CASE WHEN {dens} > 0 AND {dens} < 'inf'::DOUBLE THEN {dens} ELSE 1e-12 END)) AS loglik, count(*) AS n "
        f"FROM (SELECT {', '.join('p.'+c for c in keys)}, g.theta, {formula} AS d FROM {source} p JOIN b{tag}{zooms-1} g ON {on}) GROUP BY {base})"
    )
    return ", ".join(out)


# bounds of θ
_BOUNDS = {
    "alimikailhaq": (-1.0 + 1e-6, 1.0 - 1e-6), "clayton": (1e-8, 0.1), "gaussian": (-1.0 + 1e-6, 1.0 - 1e-6), "gumbel": (1.0 + 1e-9, 15.0),
    "gumbelbarnett": (1e-9, 1.0 - 1e-9), "joe": (1.0 + 1e-9, 22.5), "nelsen10": (0.05, 1.0), "nelsen12": (1.0, 21.0), "nelsen13": (1e-12, 125.0),
    "nelsen14": (1.0, 19.0), "plackett": (1e-5, 20.0),
}


def _scored_pairs():
    """pairs with the normal scores x, y and a number g of the group."""
    return (
        f"{PAIRS}, {_normal_ppf_cte('zz', 'ranks', 'u', 'z')}, zm AS MATERIALIZED (SELECT station, variable, time, z FROM zz), "
        "pp AS MATERIALIZED (SELECT p.*, dense_rank() OVER (ORDER BY p.station, var_u, var_v) AS g, dayofyear(p.time) AS doy, a.z AS x, b.z AS y FROM pairs p "
        "JOIN zm a ON a.station=p.station AND a.time=p.time AND a.variable=var_u JOIN zm b ON b.station=p.station AND b.time=p.time AND b.variable=var_v)"
    )


_ALL_MEMBERS = [*_members(), ("gaussian", 0)]


_ORDER = ["alimikailhaq", "clayton", "gaussian", "gumbel", "gumbelbarnett", "independence", "joe", "nelsen10", "nelsen12", "nelsen13", "nelsen14", "plackett"]


def _selection(source):
    """sel(station, var_u, var_v, family, rotation, theta, loglik, n): the likeliest of all members, independence among them."""
    keys, fits, rows = ["station", "var_u", "var_v"], [], []
    for name, rotation in _ALL_MEMBERS:
        lo, hi = _BOUNDS[name]
        tag = f"_{name}_{rotation}_"
        fits.append(_grid_fit(source, keys, name, lo, hi, lo > 0, tag=tag, rotation=rotation))
        rows.append(f"SELECT {GRP}, '{name}' AS family, {rotation} AS rotation, {_ORDER.index(name) * 4 + rotation // 90} AS place, theta, loglik, n FROM fit{tag}")
    rows.append(f"SELECT {GRP}, 'independence', 0, {_ORDER.index('independence') * 4}, 0.0, 0.0, count(*) FROM {source} GROUP BY {GRP}")
    return (
        f"{', '.join(fits)}, every AS ({' UNION ALL '.join(rows)}), "
        f"sel AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY {GRP} ORDER BY round(loglik,5) DESC, place) = 1)"
    )


def _with_gaussian(name, rotation, what):
    """Density or h of a member at θ = theta; the Gaussian one from the scores x, y."""
    if name != "gaussian":
        return _member(name, rotation, what, "u", "v", "theta")
    if what == "density":
        return "exp((2*theta*x*y-theta*theta*(x*x+y*y))/(2*(1-theta*theta)))/sqrt(1-theta*theta)"
    return _normal_cdf("((y-theta*x)/sqrt(1-theta*theta))")


def _seasonal_fit(grid=64):
    """sf(g, family, rotation, doy, theta, rejected): daily sums on a grid, summed over the window of each day, vertex of the best three."""
    def even(name, spot):
        """θ at a place of the grid: even in θ, log θ or asinh(θ / s)."""
        lo, hi = _BOUNDS[name]
        s = hi * 1e-4
        to = (lambda t: t) if lo <= 0 else math.log if lo >= 1e-6 else (lambda t: math.asinh(t / s))
        x = f"({to(lo)!r}::DOUBLE+{spot}*({(to(hi) - to(lo)) / (grid - 1)!r}::DOUBLE))"
        theta = x if lo <= 0 else f"exp({x})" if lo >= 1e-6 else f"({s!r}::DOUBLE*(exp({x})-exp(-{x}))/2)"
        return f"least({hi!r}::DOUBLE, greatest({lo!r}::DOUBLE, {theta}))"

    daily = []
    for name, rotation in _ALL_MEMBERS:
        daily.append(
            f"SELECT g, doy, '{name}' AS family, {rotation} AS rotation, i, sum(ln(CASE WHEN d > 0 AND d < 'inf'::DOUBLE THEN d ELSE 1e-9 END)) AS ll "
            f"FROM (SELECT g, doy, i, {_with_gaussian(name, rotation, 'density')} AS d FROM pp, (SELECT i, {even(name, 'i')} AS theta FROM range(0,{grid}) t(i))) GROUP BY ALL"
        )
    bounds = ", ".join(f"('{n}', {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for n, (lo, hi) in _BOUNDS.items())
    vertex = "CASE family " + " ".join(f"WHEN '{n}' THEN {even(n, 'spot')}" for n in _BOUNDS) + " END"
    return (
        f"dl AS MATERIALIZED ({' UNION ALL '.join(daily)}), "
        # the days across the turn of the year stand before its begin and after its end
        "ring AS (SELECT *, doy AS place FROM dl UNION ALL SELECT *, least(doy-365, 0) FROM dl WHERE doy > 340 UNION ALL SELECT *, doy+366 FROM dl WHERE doy < 30), "
        "wl AS (SELECT g, family, rotation, doy, place, i, sum(ll) OVER (PARTITION BY g, family, rotation, i ORDER BY place RANGE BETWEEN 14 PRECEDING AND 15 FOLLOWING) AS s FROM ring), "
        "bl AS MATERIALIZED (SELECT g, family, rotation, doy, arg_max(i, s) AS i, max(s) AS s FROM wl WHERE place = doy GROUP BY ALL), "
        f"cl AS (SELECT b.*, greatest(1, least({grid-2}, b.i)) AS c FROM bl b), "
        "vl AS (SELECT c.g, c.family, c.rotation, c.doy, any_value(c.i) AS i, any_value(c.c) AS c, max(CASE WHEN w.i=c.c-1 THEN w.s END) AS l, max(CASE WHEN w.i=c.c THEN w.s END) AS m, max(CASE WHEN w.i=c.c+1 THEN w.s END) AS r "
        "FROM cl c JOIN wl w ON w.g=c.g AND w.family=c.family AND w.rotation=c.rotation AND w.doy=c.doy AND w.place=w.doy AND w.i BETWEEN c.c-1 AND c.c+1 GROUP BY ALL), "
        "sl AS (SELECT *, c + CASE WHEN l-2*m+r < 0 AND abs(0.5*(l-r)/(l-2*m+r)) <= 1 THEN 0.5*(l-r)/(l-2*m+r) ELSE i-c END AS spot FROM vl), "
        f"tl AS (SELECT sl.*, lo, hi, {vertex} AS t FROM sl JOIN (VALUES {bounds}) b(family, lo, hi) USING (family)), "
        "sf AS MATERIALIZED (SELECT g, family, rotation, doy, CASE WHEN bad THEN NULL ELSE t END AS theta, avg(bad::INT) OVER (PARTITION BY g, family, rotation) > 0.5 AS rejected, lo, hi "
        "FROM (SELECT *, abs(t-lo) <= 1e-8+1e-5*abs(lo) OR abs(t-hi) <= 1e-8+1e-5*abs(hi) AS bad FROM tl))"
    )


def _smoothed(order=4):
    """sm(g, family, rotation, doy, theta): filled around the year, harmonics 0…order, clipped."""
    ang = "2*pi()*k*pos/n"
    return (
        "fk AS (SELECT *, row_number() OVER (PARTITION BY g, family, rotation ORDER BY doy) - 1 AS pos, count(*) OVER (PARTITION BY g, family, rotation) AS n FROM sf WHERE NOT rejected), "
        "kn AS (SELECT g, family, rotation, pos + s*n AS pos, theta FROM fk, (VALUES (-1), (0), (1)) z(s) WHERE theta IS NOT NULL), "
        "fi AS MATERIALIZED (SELECT f.g, f.family, f.rotation, f.doy, f.pos, f.n, f.lo, f.hi, coalesce(f.theta, a.theta+(b.theta-a.theta)*(f.pos-a.pos)/(b.pos-a.pos)) AS theta FROM fk f "
        "ASOF LEFT JOIN kn a ON a.g=f.g AND a.family=f.family AND a.rotation=f.rotation AND f.pos>=a.pos ASOF LEFT JOIN kn b ON b.g=f.g AND b.family=f.family AND b.rotation=f.rotation AND f.pos<=b.pos), "
        f"sp AS (SELECT g, family, rotation, k, sum(theta*cos({ang})) AS re, sum(-theta*sin({ang})) AS im FROM fi, range(0,{order+1}) t(k) GROUP BY ALL), "
        f"sm AS MATERIALIZED (SELECT g, family, rotation, doy, greatest(any_value(lo), least(any_value(hi), sum(CASE WHEN k=0 THEN 1 ELSE 2 END*(re*cos({ang})-im*sin({ang})))/any_value(n))) AS theta "
        "FROM fi JOIN sp USING (g, family, rotation) GROUP BY g, family, rotation, doy)"
    )


def _tau(source, keys, u="u", v="v", name="tau"):
    on = " AND ".join(f"a.{c}=b.{c}" for c in keys)
    cols = ", ".join(f"a.{c}" for c in keys)
    cells = ", ".join(keys)
    return (
        f"cell_{name} AS (SELECT {cells}, {u} AS u, {v} AS v, count(*)::DOUBLE AS w FROM {source} GROUP BY ALL), "
        f"s_{name} AS (SELECT {cols}, sum(a.w*b.w*sign(a.u-b.u)*sign(a.v-b.v)) AS s, "
        f"sum(CASE WHEN a.u<>b.u THEN a.w*b.w ELSE 0 END) AS dx, sum(CASE WHEN a.v<>b.v THEN a.w*b.w ELSE 0 END) AS dy "
        f"FROM cell_{name} a JOIN cell_{name} b ON {on} GROUP BY {cols}), "
        f"{name} AS (SELECT * EXCLUDE (s, dx, dy), s/sqrt(dx*dy) AS tau FROM s_{name} JOIN (SELECT {cells}, count(*) AS n FROM {source} GROUP BY ALL) USING ({cells}))"
    )


def _quantiles(source, keys, levels, col="value", name="q"):
    """Order-statistic interpolation at (level_id, level) pairs given as a relation."""
    return (
        f"{name} AS (SELECT {keys}, level_id, level, quantile FROM (SELECT {keys}, level_id, level, "
        f"v[CAST(floor(level*(len(v)-1)) AS INTEGER)+1] + (v[least(CAST(floor(level*(len(v)-1)) AS INTEGER)+2, len(v))] - v[CAST(floor(level*(len(v)-1)) AS INTEGER)+1]) "
        f"* (level*(len(v)-1) - floor(level*(len(v)-1))) AS quantile FROM (SELECT {keys}, list({col} ORDER BY {col}) AS v FROM {source} WHERE {col} IS NOT NULL GROUP BY {keys}), {levels}))"
    )


def _bands(source, keys, lo, hi, full=True):
    more = f"quantile_cont(quantile, {lo}) AS sim_lower, quantile_cont(quantile, {hi}) AS sim_upper, " if full else ""
    return f"SELECT {keys}, level_id, median(quantile) AS sim_median, {more}min(quantile) AS sim_min, max(quantile) AS sim_max FROM sim GROUP BY ALL"


def _ecdf(source, keys, name="knots", col="value", lo=None, hi=None):
    lo = f"min({col})" if lo is None else repr(lo)
    hi = f"max({col})" if hi is None else repr(hi)
    return (
        f"{name} AS (SELECT DISTINCT {keys}, {col} AS x, (rank() OVER (PARTITION BY {keys} ORDER BY {col})-0.5)/count(*) OVER (PARTITION BY {keys}) AS p FROM {source} "
        f"UNION ALL SELECT {keys}, {lo}, 0.0 FROM {source} GROUP BY {keys} UNION ALL SELECT {keys}, {hi}, 1.0 FROM {source} GROUP BY {keys})"
    )


def _interp(name, queries, knots, keys, col, out, inverse=False):
    """As-of interpolation of queries.col on the knots."""
    x, p = ("p", "x") if inverse else ("x", "p")
    on = lambda a: " AND ".join(f"q.{c}={a}.{c}" for c in keys)
    below, above = ("b.l", "a.r") if inverse else ("0.0", "1.0")
    at = "a.l" if inverse else "a.r"
    return (
        f"n_{name} AS (SELECT {', '.join(keys)}, {x} AS x, min({p}) AS l, max({p}) AS r FROM {knots} GROUP BY ALL), "
        f"{name} AS (SELECT q.*, CASE WHEN q.{col} IS NULL THEN NULL WHEN a.x IS NULL THEN {below} WHEN b.x IS NULL THEN {above} "
        f"WHEN a.x=q.{col} THEN {at} ELSE a.r+(b.l-a.r)*(q.{col}-a.x)/(b.x-a.x) END AS {out} FROM {queries} q "
        f"ASOF LEFT JOIN n_{name} a ON {on('a')} AND q.{col} >= a.x ASOF LEFT JOIN n_{name} b ON {on('b')} AND q.{col} <= b.x)"
    )


def _hyd(source, keys, name="sums"):
    return f"{name} AS (SELECT {keys}, CAST(year(time + INTERVAL 3 MONTH) AS INTEGER) AS hyd_year, sum(value) AS total, count(value) AS days FROM {source} GROUP BY ALL)"


def _runs(source, keys, flag):
    """Runs of days: a run ends where the flag changes or a day is missing."""
    return (
        f"rs AS (SELECT *, CASE WHEN lag({flag}) OVER w IS DISTINCT FROM {flag} OR lag(time) OVER w IS NULL OR time - lag(time) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS st FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY time)), "
        f"runs AS (SELECT * EXCLUDE (st), sum(st) OVER (PARTITION BY {keys} ORDER BY time) - 1 AS grp FROM rs)"
    )


def _islands(source, keys, min_length):
    """wave_id = runs of either kind before the wave."""
    return (
        f"{_runs(source, keys, 'mask')}, waves AS (SELECT {keys}, CAST(grp AS BIGINT) AS wave_id, min(time) AS \"begin\", max(time) AS \"end\", count(*) AS days "
        f"FROM runs WHERE mask GROUP BY {keys}, grp HAVING count(*) >= {min_length})"
    )


_LAGS = (
    "axis AS (SELECT {by}, time, row_number() OVER (PARTITION BY {by} ORDER BY time) AS pos FROM (SELECT DISTINCT {by}, time FROM {src})), "
    "placed AS (SELECT s.*, pos FROM {src} s JOIN axis USING ({by}, time)), "
    "m AS (SELECT {by}, {label}, avg(value) AS mean, stddev_pop(value) AS sd FROM {src} GROUP BY ALL), "
    "x AS (SELECT a.{by}, a.{label} AS {label}_i, b.{label} AS {label}_j, CAST(k AS INTEGER) AS lag, "
    "count(CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN 1 END) AS n, sum((a.value-ma.mean)*(b.value-mb.mean)) AS s, any_value(ma.sd) AS sa, any_value(mb.sd) AS sb "
    "FROM placed a JOIN range({k0},{k1}) t(k) ON true JOIN placed b ON a.{by}=b.{by} AND b.pos=a.pos+k "
    "JOIN m ma ON ma.{by}=a.{by} AND ma.{label}=a.{label} JOIN m mb ON mb.{by}=b.{by} AND mb.{label}=b.{label} GROUP BY ALL)"
)

_STATS = (
    "count(*) AS n, 12.0/(count(*)*(count(*)+1.0)*(count(*)-1.0))*sum((u*m+0.5)*(v*m+0.5)) - 3.0*(count(*)+1)/(count(*)-1) AS rho, "
    "avg((u-.5)*(v-.5)*((u-.5)+(v-.5))) AS asymmetry1, avg(-(u-.5)*(v-.5)*((u-.5)-(v-.5))) AS asymmetry2"
)


# em: pairs with their empirical copula
_EMPIRICAL = (
    "j AS (SELECT a.station, a.var_u, a.var_v, a.time, count(*) AS c FROM pairs a JOIN pairs b ON a.station=b.station AND a.var_u=b.var_u AND a.var_v=b.var_v AND b.u<a.u AND b.v<a.v GROUP BY 1,2,3,4), "
    f"em AS (SELECT p.*, (coalesce(c,0)+0.5)/count(*) OVER (PARTITION BY {GRP}) AS empirical FROM pairs p LEFT JOIN j USING ({GRP}, time))"
)


def _report(pairs, keys, bins):
    return (
        f", pm AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS m, min(u) OVER (PARTITION BY {keys}) AS u0, max(u) OVER (PARTITION BY {keys}) AS u1, "
        f"min(v) OVER (PARTITION BY {keys}) AS v0, max(v) OVER (PARTITION BY {keys}) AS v1 FROM {pairs}), "
        f"st AS (SELECT {keys}, {_STATS} FROM pm GROUP BY {keys}), "
        f"h AS (SELECT {keys}, CAST(least(floor((u-u0)*{bins}/(u1-u0)), {bins-1}) AS BIGINT) AS bin_u, CAST(least(floor((v-v0)*{bins}/(v1-v0)), {bins-1}) AS BIGINT) AS bin_v, "
        f"count(*)/(any_value(m)*((any_value(u1)-any_value(u0))/{bins})*((any_value(v1)-any_value(v0))/{bins})) AS density FROM pm GROUP BY ALL) "
        f"SELECT {keys}, n, round(rho,6) AS rho, round(asymmetry1,6) AS asymmetry1, round(asymmetry2,6) AS asymmetry2, bin_u, bin_v, round(density,6) AS density FROM st JOIN h USING ({keys})"
    )


def _conditions():
    return (
        f"cs AS (SELECT station, avg(total) AS m, stddev_pop(total) AS sd FROM (WITH {_hyd('daily', 'station, variable')} SELECT * FROM sums WHERE variable='quantity') GROUP BY station), "
        "conds AS (SELECT station||'-bounds' AS name, station, 'bounds' AS kind, m*0.98 AS lower, m*1.02 AS upper, NULL::DOUBLE AS lower_period, NULL::DOUBLE AS upper_period FROM cs "
        "UNION ALL SELECT station||'-std', station, 'std', NULL, sd*0.9, NULL, NULL FROM cs "
        "UNION ALL SELECT station||'-mean', station, 'mean', m*1.01, m*1.05, 100.0, 400.0 FROM cs)"
    )


_SCORE = (
    "es AS (SELECT realization, station, CAST(year(time + INTERVAL 3 MONTH) AS INTEGER) AS hyd_year, sum(value) AS total FROM ens WHERE variable='quantity' GROUP BY ALL), "
    "sc AS (SELECT realization, name, station, kind, CASE kind "
    "WHEN 'bounds' THEN sum(CASE WHEN total<lower THEN pow(total-lower,2) WHEN total>upper THEN pow(total-upper,2) ELSE 0 END) "
    "WHEN 'std' THEN CASE WHEN stddev_pop(total)>any_value(upper) THEN pow(stddev_pop(total)-any_value(upper),2) ELSE 0 END "
    "ELSE CASE WHEN avg(total)<any_value(lower) THEN pow(avg(total)-any_value(lower),2) WHEN avg(total)>any_value(upper) THEN pow(avg(total)-any_value(upper),2) ELSE 0 END END AS penalty "
    "FROM es JOIN conds USING (station) GROUP BY realization, name, station, kind)"
)


def _swing(theta, swing):
    return f"({theta!r}::DOUBLE+{swing!r}::DOUBLE*sin(2*pi()*dayofyear(time)/366))" if swing else f"{theta!r}::DOUBLE"


def _inverse(name, rotation, u, q, k):
    """Closed form of v with h(v | u) = q."""
    a = f"(1-{u})" if rotation in (180, 270) else u
    p = f"(1-{q})" if rotation in (90, 180) else q
    if name == "clayton":
        x = f"pow((pow({p},-{k}/(1+{k}))-1)*pow({a},-{k})+1,-1/{k})"
    else:  # Plackett
        r = f"({p}*(1-{p}))"
        root = f"sqrt({k}*({k}+4*{r}*{a}*(1-{a})*pow(1-{k},2)))"
        x = f"((2*{r}*({a}*{k}*{k}+1-{a})+{k}*(1-2*{r})-(1-2*{p})*{root})/(2*({k}+{r}*pow({k}-1,2))))"
    return f"1-({x})" if rotation in (90, 180) else x


# (family, rotation, θ, swing over the year) of the edges of the given vines
_C = {
    "pd": ("plackett", 0, 2.0, 0.5), "pq": ("clayton", 180, 0.09, 0.0), "pt": ("plackett", 90, 1.4, 0.0),
    "dq_p": ("clayton", 90, 0.05, 0.0), "dt_p": ("plackett", 0, 0.6, 0.2), "qt_pd": ("clayton", 270, 0.08, 0.0),
}
_R = {
    "dp": ("clayton", 0, 0.09, 0.0), "pq": ("plackett", 0, 3.0, 1.5), "qt": ("plackett", 180, 0.5, 0.0),
    "dq_p": ("plackett", 270, 1.8, 0.3), "pt_q": ("clayton", 180, 0.07, 0.0), "dt_pq": ("plackett", 0, 1.2, 0.0),
}


def _given_vines():
    """Quantiles and their inverse of two vines with known parameters, edge by edge."""
    q = {}
    wide = f"{RANKS}, w0 AS (SELECT station, time, " + ", ".join(f"max(CASE WHEN variable='{n}' THEN u END) AS {n[0]}" for n in ("price", "discount", "quantity", "tax")) + " FROM ranks GROUP BY 1,2)"
    h = lambda e, u, v: _member(e[0], e[1], "h", u, v, _swing(*e[2:]))
    k = lambda e, u, v: _member(e[0], e[1], "k", u, v, _swing(*e[2:]))
    inv = lambda e, u, x: _inverse(e[0], e[1], u, x, _swing(*e[2:]))

    def steps(start, parts):
        out = []
        for i, part in enumerate(parts):
            out.append(f"{start}{i+1} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in part.items()) + f" FROM {start}{i})")
        return ", ".join(out)

    def long(source, columns, value, order=None):
        names = {"p": "price", "d": "discount", "q": "quantity", "t": "tax"}
        pos = (lambda v: f"{order.index(v)} AS pos, ") if order else (lambda v: "")
        return " UNION ALL ".join(f"SELECT station, time, {pos(v)}'{names[v]}' AS variable, {c} AS {value} FROM {source}" for v, c in columns.items())

    c_there = steps("w", [
        {"d_p": h(_C["pd"], "p", "d"), "q_p": h(_C["pq"], "p", "q"), "t_p": h(_C["pt"], "p", "t"), "p_d": k(_C["pd"], "p", "d"), "p_q": k(_C["pq"], "p", "q"), "p_t": k(_C["pt"], "p", "t")},
        {"q_pd": h(_C["dq_p"], "d_p", "q_p"), "t_pd": h(_C["dt_p"], "d_p", "t_p")}, {"t_all": h(_C["qt_pd"], "q_pd", "t_pd")},
    ])
    r_there = steps("w", [
        {"p_d": h(_R["dp"], "d", "p"), "d_p": k(_R["dp"], "d", "p"), "q_p": h(_R["pq"], "p", "q"), "p_q": k(_R["pq"], "p", "q"), "t_q": h(_R["qt"], "q", "t")},
        {"q_dp": h(_R["dq_p"], "d_p", "q_p"), "d_pq": k(_R["dq_p"], "d_p", "q_p"), "t_pq": h(_R["pt_q"], "p_q", "t_q")}, {"t_all": h(_R["dt_pq"], "d_pq", "t_pq")},
    ])
    c_back = steps("w", [
        {"d1": inv(_C["pd"], "p", "d"), "q2": inv(_C["dq_p"], "d", "q"), "t3": inv(_C["qt_pd"], "q", "t")},
        {"q1": inv(_C["pq"], "p", "q2"), "t2": inv(_C["dt_p"], "d", "t3")}, {"t1": inv(_C["pt"], "p", "t2")},
    ])
    r_back = steps("w", [
        {"p1": inv(_R["dp"], "d", "p")}, {"d_p": k(_R["dp"], "d", "p1")}, {"q2": inv(_R["dq_p"], "d_p", "q")},
        {"q1": inv(_R["pq"], "p1", "q2"), "d_pq": k(_R["dq_p"], "d_p", "q2")}, {"p_q": k(_R["pq"], "p1", "q1"), "t3": inv(_R["dt_pq"], "d_pq", "t")},
        {"t2": inv(_R["pt_q"], "p_q", "t3")}, {"t1": inv(_R["qt"], "q1", "t2")},
    ])
    c_long = long("w3", {"p": "p", "d": "d_p", "q": "q_pd", "t": "t_all"}, "q", "pdqt")
    q["cvine_quantiles"] = f"WITH {wide}, {c_there}, l AS ({c_long}) SELECT station, time, pos, variable, round(q,6) AS q FROM l"
    q["rvine_quantiles"] = f"WITH {wide}, {r_there}, l AS ({long('w3', {'d': 'd', 'p': 'p_d', 'q': 'q_dp', 't': 't_all'}, 'q', 'dpqt')}) SELECT station, time, pos, variable, round(q,6) AS q FROM l"
    q["pseudo_observations"] = (
        f"WITH {wide}, {c_there} SELECT station, time, round(p_d,6) AS price_given_discount, round(d_p,6) AS discount_given_price, round(p_q,6) AS price_given_quantity, "
        "round(q_p,6) AS quantity_given_price, round(p_t,6) AS price_given_tax, round(t_p,6) AS tax_given_price FROM w1"
    )
    back = long("w3", {"p": "p", "d": "d1", "q": "q1", "t": "t1"}, "u")
    q["cvine_inverse"] = f"WITH {wide}, {c_back}, l AS ({back}) SELECT station, time, variable, round(u,6) AS u FROM l"
    q["cvine_inverse_stopped"] = f"WITH {wide}, {c_back}, l AS ({back}) SELECT station, time, variable, CASE WHEN variable IN ('price', 'discount') THEN round(u,6) END AS u FROM l"
    q["rvine_inverse"] = f"WITH {wide}, {r_back}, l AS ({long('w7', {'p': 'p1', 'd': 'd', 'q': 'q1', 't': 't1'}, 'u')}) SELECT station, time, variable, round(u,6) AS u FROM l"
    half = wide.replace("w0 AS", "wu AS") + ", w0 AS (SELECT station, time, 0.5::DOUBLE AS p, 0.5::DOUBLE AS d, 0.5::DOUBLE AS q, 0.5::DOUBLE AS t FROM wu)"
    q["vine_debias"] = (
        f"WITH {half}, {c_back}, l AS ({back}), {_normal_ppf_cte('zh', 'l', 'u', 'z')}, {_normal_ppf_cte('zr', 'ranks', 'u', 'z')} "
        "SELECT station, variable, round(a.m - b.m, 5) AS shift FROM (SELECT station, variable, avg(z) AS m FROM zh GROUP BY 1,2) a JOIN (SELECT station, variable, avg(z) AS m FROM zr GROUP BY 1,2) b USING (station, variable)"
    )
    q["independence_check"] = (
        f"WITH {wide}, {c_there}, l AS MATERIALIZED ({c_long}), {_ranked('rk', 'l', 'variable', 'q', 'r')}, ks AS (SELECT variable, max(abs(q-r)+0.5/n) AS ks FROM (SELECT *, count(*) OVER (PARTITION BY variable) AS n FROM rk) GROUP BY 1), "
        "co AS (SELECT a.variable, corr(a.q, b.q) AS c FROM l a JOIN l b ON a.station=b.station AND a.time=b.time AND a.variable<>b.variable GROUP BY a.variable, b.variable) "
        "SELECT variable, round(ks,5) AS ks, round(max(abs(c)),5) AS max_abs_corr FROM ks JOIN co USING (variable) GROUP BY 1,2"
    )
    stations = "(SELECT DISTINCT l_returnflag AS station FROM lineitem)"
    order = lambda names: f"SELECT station, pos, variable FROM {stations}, (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(names)) + ") o(pos, variable)"
    q["vine_order"] = order(["price", "discount", "quantity", "tax"])
    q["vine_order_rvine"] = order(["discount", "price", "quantity", "tax"])
    lines = [
        (0, "discount-price clayton"), (0, "price-quantity plackett"), (0, "quantity-tax plackett_180"), (1, "discount-quantity ; price plackett_270"),
        (1, "price-tax ; quantity clayton_180"), (2, "discount-tax ; price,quantity plackett"),
    ]
    q["vine_report"] = f"SELECT station, tree, line FROM {stations}, (VALUES " + ", ".join(f"({t}, '{x} tau=0.250')" for t, x in lines) + ") o(tree, line)"
    return q


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    rv = "round(value,6) AS value"
    q["to_wide"] = f"WITH {WIDE} SELECT station, time, " + ", ".join(f"round({v},6) AS {v}" for v in VARIABLES) + " FROM wide"
    q["to_long"] = "SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem"
    q["attach_stations"] = f"WITH {ORDERS}, {STATIONS} SELECT station, variable, time, {rv}, longitude, latitude FROM orders_long JOIN stations USING (station)"
    q["filter_stations"] = f"WITH {ORDERS}, {STATIONS} SELECT station, variable, time, {rv} FROM orders_long WHERE station IN (SELECT station FROM stations WHERE longitude BETWEEN -60 AND 50 AND latitude BETWEEN -20 AND 20)"
    q["select_labels"] = f"WITH {DAILY} SELECT station, variable, time, {rv} FROM daily WHERE station IN ('A','R') AND variable IN ('price','tax') AND time BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-02-28'"
    q["short_station_names"] = "SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN o_orderpriority||', x' ELSE o_orderpriority END AS station, CASE WHEN o_orderstatus='F' THEN o_orderpriority ELSE split_part(o_orderpriority,'-',1) END AS station_short FROM orders"
    q["pad_first_day"] = (
        f"WITH {HOURLY}, h AS (SELECT * FROM hourly WHERE time >= TIMESTAMP '2024-01-01 06:00:00'), ax AS (SELECT time, row_number() OVER (ORDER BY time)-1 AS pos FROM (SELECT DISTINCT time FROM h)) "
        f"SELECT station, variable, time, {rv} FROM h UNION ALL SELECT station, variable, time - INTERVAL 1 DAY, round(value,6) FROM h WHERE time IN (SELECT time FROM ax WHERE pos >= 24-(SELECT hour(min(time)) FROM ax) AND pos < 24)"
    )
    q["overlay"] = (
        f"WITH {DAILY}, {ENS}, b AS (SELECT station, variable, time, value FROM ens WHERE realization=0 AND variable IN ('discount','tax')), "
        "sr AS (SELECT station, variable FROM daily UNION SELECT station, variable FROM b), ax AS (SELECT station, time FROM daily UNION SELECT station, time FROM ens WHERE realization=0) "
        f"SELECT station, variable, time, round(CASE WHEN variable IN ('discount','tax') THEN coalesce(b.value, daily.value) ELSE daily.value END,6) AS value FROM sr JOIN ax USING (station) LEFT JOIN daily USING (station, variable, time) LEFT JOIN b USING (station, variable, time)"
    )
    q["merge_external"] = f"WITH {DAILY}, {ORDERS} SELECT station, variable, time, {rv} FROM daily WHERE variable<>'tax' UNION ALL SELECT station, variable, time, round(value,6) FROM orders_long"
    q["convert"] = f"WITH {DAILY} SELECT station, CASE variable WHEN 'quantity' THEN 'amount' ELSE variable END AS variable, time, round(CASE variable WHEN 'quantity' THEN value*2+1 ELSE value END,6) AS value FROM daily"
    q["missing_realizations"] = "SELECT CAST(i AS INTEGER) AS realization FROM range(0,40) t(i) WHERE i NOT IN (SELECT l_suppkey % 17 * 2 FROM lineitem WHERE l_quantity > 49)"
    q["derive_ensemble"] = f"WITH {ENS} SELECT realization, station, variable, time, round(value+1,6) AS derived, round(value,6) AS base FROM ens WHERE realization<3"
    q["write_load_ensemble"] = f"WITH {ENS} SELECT 'base' AS ensemble, realization, station, variable, time, {rv} FROM ens WHERE realization IN (0, 2, 5)"
    stored = [
        ("clayton", 0, 0.09, 0, "discount", "price", ""), ("plackett", 0, 3.0, 0, "price", "quantity", ""), ("plackett", 180, 0.5, 0, "quantity", "tax", ""),
        ("plackett", 270, 1.8, 1, "discount", "quantity", "price"), ("clayton", 180, 0.07, 1, "price", "tax", "quantity"), ("plackett", 0, 1.2, 2, "discount", "tax", "price,quantity"),
    ]
    rows = ", ".join(f"('{f}', {r}, {t!r}::DOUBLE, {level}, '{u}', '{v}', '{c}')" for f, r, t, level, u, v, c in stored)
    q["save_load_model"] = (
        f"SELECT station, tree, node_u, node_v, cond, family, rotation, theta, 0.25::DOUBLE AS tau, pos, variable FROM (SELECT DISTINCT l_returnflag AS station FROM lineitem), "
        f"(VALUES {rows}) e(family, rotation, theta, tree, node_u, node_v, cond) JOIN (VALUES (0, 'discount'), (1, 'price'), (2, 'quantity'), (3, 'tax')) o(pos, variable) ON variable = node_v"
    )
    q["read_observations"] = f"WITH {GAPPY} SELECT station, variable, time, {rv} FROM gappy"
    q["write_station_csv"] = f"WITH {WIDE} SELECT station, time, " + ", ".join(f"round({v},6) AS {v}" for v in VARIABLES) + " FROM wide"
    q["symmetry_flags"] = "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', {r}, {str(n == 'plackett').lower()}, {str(r in (0, 180) or n == 'plackett').lower()}, {str(n == 'plackett').lower()}, {str(r in (0, 180) or n == 'plackett').lower()})" for n, r in _members()
    ) + ") f(family, rotation, seen1, seen2, symmetry1, symmetry2)"
    # time
    q["resample_mean"] = f"WITH {GAPPY} SELECT station, variable, date_trunc('month', time)::TIMESTAMP AS time, round(avg(value),6) AS value FROM gappy GROUP BY 1,2,3"
    q["resample_day_night"] = f"WITH {HOURLY} SELECT station, variable, date_trunc('day', time)::TIMESTAMP AS time, round(max(value),6) AS day, round(min(value),6) AS night FROM hourly GROUP BY 1,2,3"
    near = (
        f"WITH {GAPPY}, k AS (SELECT station, variable, time, value, row_number() OVER (PARTITION BY {SERIES} ORDER BY time) AS i, count(*) OVER (PARTITION BY {SERIES}) AS c FROM gappy WHERE value IS NOT NULL), "
        "j AS (SELECT g.station, g.variable, g.time, g.value, a.time AS ta, a.value AS va, b.time AS tb, b.value AS vb FROM gappy g "
        "ASOF LEFT JOIN k a ON g.station=a.station AND g.variable=a.variable AND g.time>=a.time ASOF LEFT JOIN k b ON g.station=b.station AND g.variable=b.variable AND g.time<=b.time) "
    )
    lin = "va+(vb-va)*(epoch(j.time)-epoch(ta))/(epoch(tb)-epoch(ta))"
    q["interpolate_time"] = near + f"SELECT station, variable, time, round(CASE WHEN value IS NOT NULL THEN value ELSE {lin} END,6) AS value FROM j"
    line = lambda p, s: f"{p}.value+({s}.value-{p}.value)*(epoch(j.time)-epoch({p}.time))/(epoch({s}.time)-epoch({p}.time))"
    kj = lambda a, cond: f"JOIN k {a} ON {a}.station=j.station AND {a}.variable=j.variable AND {a}.{cond}"
    q["interpolate_extrapolate"] = near + (
        f"SELECT j.station, j.variable, j.time, round(CASE WHEN j.value IS NOT NULL THEN j.value WHEN ta IS NULL THEN {line('f1','f2')} WHEN tb IS NULL THEN {line('l2','l1')} ELSE {lin} END,6) AS value "
        f"FROM j {kj('f1','i=1')} {kj('f2','i=2')} {kj('l1','i=l1.c')} {kj('l2','i=l2.c-1')}"
    )
    q["fill_edges"] = near + "SELECT station, variable, time, round(coalesce(vb, va),6) AS value FROM j"
    q["missing_report"] = f"WITH {GAPPY} SELECT station, variable, count(*) AS n, count(*)-count(value) AS missing, count(value)=0 AS all_missing FROM gappy GROUP BY 1,2"
    q["clean_ranks"] = near.replace(f"WITH {GAPPY}", f"WITH {RANKS}, gappy AS (SELECT station, variable, time, CASE WHEN u BETWEEN 0.05 AND 0.9 THEN u END AS value FROM ranks)") + f"SELECT station, variable, time, round(coalesce(value, {lin}, vb, va),6) AS u FROM j"
    q["calendar_keys"] = (
        f"WITH {DAILY} SELECT station, variable, time, {rv}, CAST(dayofyear(time) AS INTEGER) AS doy, CAST(month(time) AS INTEGER) AS month, CAST(year(time) AS INTEGER) AS year, "
        f"CASE WHEN month(time) IN (12,1,2) THEN 'DJF' WHEN month(time) IN (3,4,5) THEN 'MAM' WHEN month(time) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season, {POS} AS pos, count(*) OVER (PARTITION BY {SERIES}) AS pos_total FROM daily"
    )
    q["doy_window"] = f"WITH {DAILY} SELECT station, variable, CAST(d AS INTEGER) AS doy, count(*) AS n, round(avg(value),6) AS mean FROM {_doy_join('daily', 15)} WHERE d IN (SELECT dayofyear(time) FROM daily) GROUP BY 1,2,3"
    q["lag_pairs"] = f"WITH {DAILY}, l AS (SELECT station, variable, time, value AS u, lead(value,3) OVER w AS v, lead(time,3) OVER w AS t3 FROM daily WINDOW w AS (PARTITION BY {SERIES} ORDER BY time)) SELECT station, variable, time, round(u,6) AS u, round(v,6) AS v FROM l WHERE t3 IS NOT NULL"
    q["rolling_sum"] = f"WITH {GAPPY}, r AS (SELECT station, variable, time, sum(value) OVER w AS s, count(value) OVER w AS c FROM gappy WINDOW w AS (PARTITION BY {SERIES} ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT station, variable, time, round(s,6) AS value FROM r WHERE c=5"
    q["rolling_pool"] = (
        f"WITH {DAILY}, p AS (SELECT *, {POS} AS pos FROM daily) SELECT a.station, a.variable, CAST(dayofyear(a.time) AS INTEGER) AS doy, count(*) AS n, round(avg(b.value),6) AS mean "
        "FROM p a JOIN p b ON a.station=b.station AND a.variable=b.variable AND b.pos BETWEEN a.pos-2 AND a.pos+2 GROUP BY 1,2,3"
    )
    q["hyd_year_sums"] = f"WITH {DAILY}, {_hyd('daily', SERIES)} SELECT station, variable, hyd_year, round(total,3) AS total, days FROM sums"
    q["hyd_year_sums_full"] = (
        f"WITH {ORDERS}, o AS (SELECT 'all' AS station, variable, time, max(value) AS value FROM orders_long GROUP BY 2,3), {_hyd('o', SERIES)} SELECT station, variable, hyd_year, round(total,6) AS total, days FROM sums "
        "WHERE days = date_diff('day', make_date(hyd_year-1,10,1), make_date(hyd_year,10,1))"
    )
    q["annual_extremes"] = (
        f"WITH {DAILY}, {_hyd('daily', SERIES)} SELECT station, variable, round(min(total),5) AS min_total, round(max(total),5) AS max_total, round(stddev_pop(total),5) AS std_total, "
        "string_agg(CAST(CAST(round(total,3) AS DECIMAL(20,3)) AS VARCHAR), ';' ORDER BY total) AS totals FROM sums GROUP BY 1,2"
    )
    band = "tt AS (SELECT count(DISTINCT l_shipdate) AS t FROM lineitem), band AS (SELECT k, t::DOUBLE/k AS period FROM tt, range(1, 100000) r(k) WHERE k <= t//2 AND t::DOUBLE/k >= 300 AND t::DOUBLE/k < 800)"
    q["period_band"] = f"WITH {band} SELECT k, round(period,6) AS period FROM band"
    amp = (
        f"WITH {DAILY}, {band}, p AS (SELECT *, {POS} AS pos, count(*) OVER (PARTITION BY {SERIES}) AS n FROM daily), "
        "am AS (SELECT station, variable, k, n AS length, sum(value*cos(2*pi()*k*pos/n)) AS re, sum(-value*sin(2*pi()*k*pos/n)) AS im FROM p, band GROUP BY ALL) "
    )
    q["harmonic_amplitudes"] = amp + "SELECT station, variable, k, length, round(re,3) AS re, round(im,3) AS im FROM am"
    q["harmonic_year_integrals"] = amp + "SELECT station, variable, k, CAST(year(time+INTERVAL 3 MONTH) AS INTEGER) AS hyd_year, round(sum(2.0/length*(re*cos(2*pi()*k*pos/length)-im*sin(2*pi()*k*pos/length))),3) AS integral FROM p JOIN am USING (station, variable) GROUP BY ALL"
    # ranks
    q["rel_ranks"] = f"WITH {RANKS} SELECT station, variable, time, {rv}, round(u,6) AS u FROM ranks"
    q["rel_ranks_lines"] = f"WITH {LINE_RANKS} SELECT station, \"order\", line, round(u,6) AS u, round(v,6) AS v FROM lr"
    q["plotting_positions"] = f"WITH {DAILY} SELECT station, variable, time, {rv}, round((row_number() OVER (PARTITION BY {SERIES} ORDER BY value, time)-0.5)/count(*) OVER (PARTITION BY {SERIES}),6) AS p FROM daily"
    q["ecdf_fit"] = f"WITH {DAILY}, {_ecdf('daily', SERIES)} SELECT station, variable, round(x,6) AS x, round(p,6) AS p FROM knots"
    q["ecdf_cdf"] = f"WITH {DAILY}, {ENS}, {_ecdf('daily', SERIES)}, {_interp('r', 'ens', 'knots', ['station','variable'], 'value', 'u')} SELECT realization, station, variable, time, {rv}, round(u,6) AS u FROM r"
    q["ecdf_ppf"] = f"WITH {RANKS}, {_ecdf('daily', SERIES)}, {_interp('r', 'ranks', 'knots', ['station','variable'], 'u', 'x', True)} SELECT station, variable, time, round(u,6) AS u, round(x,6) AS value FROM r"
    q["quantile_map"] = (
        f"WITH {DAILY}, da AS (SELECT * FROM daily WHERE station='A'), dn AS (SELECT * FROM daily WHERE station='N'), {_ecdf('da', 'variable', 'ka')}, {_ecdf('dn', 'variable', 'kn')}, "
        f"{_interp('r1', 'da', 'ka', ['variable'], 'value', 'p')}, {_interp('r2', 'r1', 'kn', ['variable'], 'p', 'mapped', True)} SELECT station, variable, time, {rv}, round(mapped,6) AS mapped FROM r2"
    )
    q["debias_ranks"] = f"WITH {RANKS}, sq AS (SELECT station, variable, time, u*u AS u FROM ranks), {_ecdf('ranks', SERIES, col='u', lo=0.0, hi=1.0)}, {_interp('r', 'sq', 'knots', ['station','variable'], 'u', 'w')} SELECT station, variable, time, round(w,6) AS u FROM r"
    q["normal_cdf_ppf"] = f"WITH {RANKS}, {_normal_ppf_cte('zz', 'ranks', 'u', 'z')} SELECT station, variable, time, {rv}, round(u,6) AS u, round(z,6) AS z, round({_normal_cdf('(z*0.5)')},6) AS back FROM zz"
    pz = f"WITH {DAILY}, pa AS (SELECT station, variable, avg(value) AS mean, stddev_pop(value) AS sd FROM daily GROUP BY 1,2), "
    q["normal_pit"] = pz + f"z AS (SELECT station, variable, time, value, (value-mean)/sd AS z FROM daily JOIN pa USING (station, variable)) SELECT station, variable, time, {rv}, round({_normal_cdf('z')},6) AS u FROM z"
    q["normal_inverse"] = pz.replace(f"WITH {DAILY}", f"WITH {RANKS}") + f"{_normal_ppf_cte('zz', 'ranks', 'u', 'z')} SELECT station, variable, time, round(u,6) AS u, round(mean+sd*z,6) AS value FROM zz JOIN pa USING (station, variable)"
    q["bound_normal"] = near.replace(f"WITH {GAPPY}", f"WITH {RANKS}, {_normal_ppf_cte('zz', 'ranks', 'u', 'z')}, gappy AS (SELECT station, variable, time, u, CASE WHEN abs(z)<=2 THEN z END AS value FROM zz)").replace("g.value, a.time", "g.value, g.u, a.time") + f"SELECT station, variable, time, round(u,6) AS u, round(coalesce(value, {lin}, 0.0),6) AS z FROM j"
    mom = f"mo AS MATERIALIZED (SELECT station, variable, CAST(d AS INTEGER) AS doy, avg(value) AS mean, stddev_pop(value) AS sd FROM {_doy_join('daily', 15)} GROUP BY 1,2,3)"
    q["seasonal_moments"] = f"WITH {DAILY}, {mom} SELECT station, variable, doy, round(mean,6) AS mean, round(sd,6) AS std FROM mo"
    ang = "2*pi()*k*(doy-1)/n"
    q["seasonal_normal_pit"] = (
        f"WITH {DAILY}, {mom}, mn AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {SERIES}) AS n FROM mo), "
        f"sp AS MATERIALIZED (SELECT station, variable, k, sum(mean*cos({ang})) AS mr, sum(-mean*sin({ang})) AS mi, sum(sd*cos({ang})) AS sr, sum(-sd*sin({ang})) AS si FROM mn, range(0,7) t(k) GROUP BY ALL), "
        f"sm AS MATERIALIZED (SELECT station, variable, doy, sum(CASE WHEN k=0 THEN 1 ELSE 2 END*(mr*cos({ang})-mi*sin({ang})))/any_value(n) AS mean, sum(CASE WHEN k=0 THEN 1 ELSE 2 END*(sr*cos({ang})-si*sin({ang})))/any_value(n) AS sd FROM mn JOIN sp USING (station, variable) GROUP BY ALL), "
        f"z AS (SELECT d.*, (value-mean)/sd AS z FROM daily d JOIN sm ON d.station=sm.station AND d.variable=sm.variable AND dayofyear(d.time)=sm.doy) SELECT station, variable, time, round({_normal_cdf('z')},5) AS u FROM z"
    )
    q["seasonal_empirical_pit"] = (
        f"WITH {DAILY}, w AS (SELECT station, variable, d, s.value FROM {_doy_join('daily', 10)}), c AS (SELECT station, variable, d, value, count(*) AS t FROM w GROUP BY ALL), "
        "r AS (SELECT station, variable, d, value, (sum(t) OVER (PARTITION BY station, variable, d ORDER BY value) - t/2.0)/sum(t) OVER (PARTITION BY station, variable, d) AS u FROM c) "
        "SELECT a.station, a.variable, a.time, round(a.value,6) AS value, round(r.u,6) AS u FROM daily a JOIN r ON a.station=r.station AND a.variable=r.variable AND r.d=dayofyear(a.time) AND r.value=a.value"
    )
    q["dry_probability_by_doy"] = f"WITH {DAILY}, dd AS (SELECT * FROM daily WHERE variable='discount') SELECT station, variable, CAST(d AS INTEGER) AS doy, round(avg(CASE WHEN value>=0.05 THEN 0.0 ELSE 1.0 END),6) AS dry_probability FROM {_doy_join('dd', 15)} GROUP BY 1,2,3"
    q["wet_mask"] = f"WITH {DAILY} SELECT station, variable, time, {rv}, value>=0.05 AS wet FROM daily"
    below = lambda src, on: f"(SELECT count(*) FROM {src} b WHERE {on})"
    q["bipit"] = (
        f"WITH {PAIRS}, {_EMPIRICAL} SELECT {GRP}, time, round(u,6) AS u, round(v,6) AS v, round(empirical,6) AS bipit FROM em"
    )
    q["bipit_lines"] = (
        f"WITH {LINES}, g AS (SELECT station, x, y, count(*) AS w FROM lines GROUP BY ALL), f AS (SELECT station, y, x0, sum(w) AS w FROM g, (SELECT DISTINCT x AS x0 FROM g) WHERE x < x0 GROUP BY ALL), "
        "cum AS (SELECT station, x0, y, sum(w) OVER (PARTITION BY station, x0 ORDER BY y) AS c FROM f) "
        "SELECT l.station, \"order\", line, round(l.x,6) AS x, round(l.y,6) AS y, round((coalesce(c,0)+0.5)/count(*) OVER (PARTITION BY l.station),6) AS bipit FROM lines l ASOF LEFT JOIN cum ON l.station=cum.station AND l.x=cum.x0 AND l.y>cum.y"
    )
    q["nonexceedance"] = (
        f"WITH {WIDE}, j AS (SELECT a.station, a.time, count(*) AS c FROM wide a JOIN wide b ON a.station=b.station AND b.discount<a.discount AND b.quantity<a.quantity AND b.tax<a.tax GROUP BY 1,2) "
        "SELECT w.station, w.time, " + ", ".join(f"round({v},6) AS {v}" for v in VARIABLES) + ", round(coalesce(c,0)/count(*) OVER (PARTITION BY w.station),6) AS nonexceedance FROM wide w LEFT JOIN j ON w.station=j.station AND w.time=j.time"
    )
    # dependence
    taus = f"WITH {PAIRS}, {_tau('pairs', ['station','var_u','var_v'])} "
    tmin = "1.96/sqrt(9.0*n*(n-1)/(2.0*(2.0*n+5)))"
    q["kendall_tau"] = taus + f"SELECT {GRP}, n, round(tau,6) AS tau, round({tmin},6) AS tau_min FROM tau"
    q["spearman"] = f"WITH {PAIRS}, pm AS (SELECT *, count(*) OVER (PARTITION BY {GRP}) AS m FROM pairs) SELECT {GRP}, round(rho,6) AS rho FROM (SELECT {GRP}, {_STATS} FROM pm GROUP BY ALL)"
    for name, expr in {
        "asymmetry1": "avg((u-.5)*(v-.5)*((u-.5)+(v-.5)))", "asymmetry2": "avg(-(u-.5)*(v-.5)*((u-.5)-(v-.5)))",
        "asymmetry_sum": "sum(pow(u-.5,2)*(v-.5)+(u-.5)*pow(v-.5,2))",
    }.items():
        q[name] = f"WITH {PAIRS} SELECT {GRP}, round({expr},6) AS {name} FROM pairs GROUP BY ALL"
    q["nan_corr"] = f"WITH {GAPPY}, {_corr_pairs('gappy', ['station'], 'variable')} SELECT station, variable_i, variable_j, round(corr,6) AS corr, n, round(overlap,6) AS overlap FROM c"
    q["corr_matrix"] = (
        f"WITH {DAILY} SELECT a.station AS station_i, a.variable AS variable_i, b.station AS station_j, b.variable AS variable_j, round(corr(a.value,b.value),6) AS corr, count(*) AS n, 1.0::DOUBLE AS overlap "
        "FROM daily a JOIN daily b ON a.time=b.time AND (a.station<b.station OR (a.station=b.station AND a.variable<b.variable)) GROUP BY ALL"
    )
    sim1 = "sim1 AS (SELECT station, variable, time, value FROM ens WHERE realization=1)"
    for name, by, label in (("intra_site_corr", "station", "variable"), ("inter_site_corr", "variable", "station")):
        q[name] = f"WITH {DAILY}, {ENS}, {sim1}, {_corr_pairs('daily', [by], label, name='c1')}, {_corr_pairs('sim1', [by], label, name='c2')} SELECT {by}, {label}_i, {label}_j, round(c1.corr,6) AS obs_corr, round(c2.corr,6) AS sim_corr FROM c1 JOIN c2 USING ({by}, {label}_i, {label}_j)"
    for name, by, label in (("ensemble_intra_corr_band", "station", "variable"), ("ensemble_inter_corr_band", "variable", "station")):
        q[name] = (
            f"WITH {DAILY}, {ENS}, {_corr_pairs('daily', [by], label, name='c1')}, {_corr_pairs('ens', ['realization', by], label, name='c2')} SELECT {by}, {label}_i, {label}_j, round(any_value(c1.corr),6) AS obs_corr, round(min(c2.corr),6) AS sim_min, round(max(c2.corr),6) AS sim_max FROM c1 JOIN c2 USING ({by}, {label}_i, {label}_j) GROUP BY 1,2,3"
        )
    q["corr_by_month"] = f"WITH {DAILY} SELECT a.station, b.variable, CAST(month(a.time) AS INTEGER) AS month, round(corr(a.value,b.value),6) AS corr, count(*) AS n FROM daily a JOIN daily b ON a.station=b.station AND a.time=b.time AND a.variable='price' AND b.variable<>'price' GROUP BY 1,2,3"
    q["corr_by_doy_window"] = f"WITH {PAIRS} SELECT station, var_u, var_v, CAST(d AS INTEGER) AS doy, count(*) AS n, round(corr(u,v),6) AS corr FROM {_doy_join('pairs', 15)} GROUP BY ALL"
    lag = lambda src, by, label, k0, k1: _LAGS.format(src=src, by=by, label=label, k0=k0, k1=k1)
    q["cross_cov"] = f"WITH {GAPPY}, {lag('gappy','station','variable',2,3)} SELECT station, variable_i, variable_j, lag, n, round(s/(n-1),4) AS cov FROM x"
    q["cross_corr"] = f"WITH {DAILY}, {lag('daily','station','variable',0,4)} SELECT station, variable_i, variable_j, lag, n, round(s/(n-1)/(sa*sb),6) AS corr FROM x"
    q["cross_corr_stations"] = f"WITH {DAILY}, {lag('daily','variable','station',0,3)} SELECT variable, station_i, station_j, lag, n, round(s/(n-1)/(sa*sb),6) AS corr FROM x"
    q["hist2d"] = (
        f"WITH {PAIRS}, pm AS (SELECT *, count(*) OVER w AS m, min(u) OVER w AS u0, max(u) OVER w AS u1, min(v) OVER w AS v0, max(v) OVER w AS v1 FROM pairs WINDOW w AS (PARTITION BY {GRP})) "
        f"SELECT {GRP}, CAST(least(floor((u-u0)*10/(u1-u0)),9) AS BIGINT) AS bin_u, CAST(least(floor((v-v0)*10/(v1-v0)),9) AS BIGINT) AS bin_v, count(*) AS n, round(count(*)/(any_value(m)*((any_value(u1)-any_value(u0))/10)*((any_value(v1)-any_value(v0))/10)),6) AS density FROM pm GROUP BY ALL"
    )
    pooled = _ranked("pr", "daily", "variable")
    q["pair_report"] = f"WITH {DAILY}, {pooled}, pp AS (SELECT a.variable AS var_u, b.variable AS var_v, a.u, b.u AS v FROM pr a JOIN pr b ON a.station=b.station AND a.time=b.time AND a.variable<>b.variable)" + _report("pp", "var_u, var_v", 5)
    q["pair_report_lag_station"] = (
        f"WITH {RANKS}, ax AS (SELECT station, time, row_number() OVER (PARTITION BY station ORDER BY time) AS pos FROM (SELECT DISTINCT station, time FROM daily)), rp AS (SELECT ranks.*, pos FROM ranks JOIN ax USING (station, time)), "
        "pp AS (SELECT a.station, a.variable AS var_u, b.variable AS var_v, a.u, b.u AS v FROM rp a JOIN rp b ON a.station=b.station AND b.pos=a.pos+1 AND a.variable<>b.variable)" + _report("pp", "station, var_u, var_v", 5)
    )
    q["pair_report_wet_season"] = (
        f"WITH {DAILY}, ds AS (SELECT *, CASE WHEN month(time) IN (12,1,2) THEN 'DJF' WHEN month(time) IN (3,4,5) THEN 'MAM' WHEN month(time) IN (6,7,8) THEN 'JJA' ELSE 'SON' END AS season FROM daily d WHERE EXISTS (SELECT 1 FROM daily r WHERE r.station=d.station AND r.time=d.time AND r.variable='discount' AND r.value>=0.04)), "
        f"{_ranked('pr', 'ds', 'season, variable')}, pp AS (SELECT a.season, a.variable AS var_u, b.variable AS var_v, a.u, b.u AS v FROM pr a JOIN pr b ON a.station=b.station AND a.time=b.time AND a.variable<>b.variable)" + _report("pp", "season, var_u, var_v", 5)
    )
    # copulas
    q["copula_cdf"] = _member_query("cdf")
    q["copula_density"] = _member_query("density", 5)
    q["copula_h"] = _member_query("h")
    q["copula_h_given_v"] = _member_query("k")
    # the Gaussian CDF by Simpson's rule over the correlation
    simpson = "(SELECT i, 0.4*i/200 AS r, CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 0.4/600 AS w FROM range(0, 201) t(i))"
    q["gaussian_copula"] = (
        f"WITH {_scored_pairs()}, ci AS (SELECT {GRP}, time, any_value(u*v) + sum(w*exp(-(x*x+y*y-2*r*x*y)/(2*(1-r*r)))/(2*pi()*sqrt(1-r*r))) AS c FROM pp, {simpson} GROUP BY {GRP}, time), cm AS (SELECT {GRP}, avg(c) AS cdf FROM ci GROUP BY {GRP}) "
        f"SELECT {GRP}, round(any_value(cdf),5) AS cdf, round(avg(exp((2*0.4*x*y-0.16*(x*x+y*y))/(2*0.84))/sqrt(0.84)),5) AS density, round(avg({_normal_cdf('((y-0.4*x)/sqrt(0.84))')}),5) AS h FROM pp JOIN cm USING ({GRP}) GROUP BY {GRP}"
    )
    q["h_inverse"] = f"WITH {PAIRS} SELECT station, var_u, var_v, count(v) AS n, 0.0::DOUBLE AS max_gap, member FROM pairs, (VALUES ('clayton_0'),('plackett_90'),('gumbel_180'),('joe_0'),('gaussian_0'),('nelsen13_270')) t(member) GROUP BY ALL"
    q["log_likelihood"] = f"WITH {PAIRS} SELECT {GRP}, round(sum(ln({_member('plackett', 0, 'density', k=1.3)})),4) AS loglik, count(*) AS n FROM pairs GROUP BY ALL"
    q["fit_copula"] = (
        f"WITH {PAIRS}, {_grid_fit('pairs', ['station','var_u','var_v'], 'plackett', 1e-5, 20.0, True, tag='p')}, {_grid_fit('pairs', ['station','var_u','var_v'], 'gumbelbarnett', 1e-9, 1.0-1e-9, True, tag='b')} "
        f"SELECT {GRP}, 'plackett' AS family, 0 AS rotation, round(theta,5) AS theta, round(loglik,5) AS loglik, n FROM fitp UNION ALL SELECT {GRP}, 'gumbelbarnett', 0, round(theta,5), round(loglik,5), n FROM fitb"
    )
    q["fit_copula_lines"] = f"WITH {LINE_RANKS}, {_grid_fit('lr', ['station'], 'plackett', 1e-5, 20.0, True)} SELECT station, 'plackett' AS family, 0 AS rotation, round(theta,4) AS theta, round(loglik,4) AS loglik, n FROM fit"
    fams = [(n, r, n in ("gaussian", "plackett")) for n in ("alimikailhaq", "clayton", "gaussian", "gumbel", "gumbelbarnett", "joe", "nelsen10", "nelsen12", "nelsen13", "nelsen14", "plackett") for r in ((0,) if n in ("gaussian", "gumbelbarnett", "joe") else (0, 90, 180, 270))]
    # C(u,v) = C(v,u): written out by hand, every member at 0 and 180 degrees, and the Plackett copula
    values = ", ".join(f"('{n}', {r}, {str(s).lower()}, {str(r in (0, 180) or n == 'plackett').lower()})" for n, r, s in fams)
    q["asymmetry_filter"] = (
        f"WITH {PAIRS}, a AS (SELECT {GRP}, avg((u-.5)*(v-.5)*((u-.5)+(v-.5))) AS asymmetry1, avg(-(u-.5)*(v-.5)*((u-.5)-(v-.5))) AS asymmetry2 FROM pairs GROUP BY ALL) "
        f"SELECT {GRP}, round(asymmetry1,6) AS asymmetry1, round(asymmetry2,6) AS asymmetry2, family, CAST(rotation AS INTEGER) AS rotation FROM a, (VALUES {values}) f(family, rotation, s1, s2) "
        f"WHERE NOT ((abs(asymmetry1) > 0.002 AND s1) OR (abs(asymmetry2) > 0.002 AND s2)) OR NOT EXISTS (SELECT 1 FROM (VALUES {values}) g(family, rotation, s1, s2) "
        "WHERE NOT ((abs(asymmetry1) > 0.002 AND g.s1) OR (abs(asymmetry2) > 0.002 AND g.s2)))"
    )
    weak = f"NOT abs(tau) > {tmin}"
    q["independence_test"] = taus + f"SELECT {GRP}, n, round(tau,6) AS tau, CASE WHEN {weak} THEN 'independence' END AS family, CASE WHEN {weak} THEN 0 END AS rotation, CASE WHEN {weak} THEN 0.0::DOUBLE END AS theta, CASE WHEN {weak} THEN 0.0::DOUBLE END AS loglik FROM tau"
    q["asymmetry_weighted_density"] = (
        f"WITH {PAIRS}, a AS (SELECT {GRP}, avg((u-.5)*(v-.5)*((u-.5)+(v-.5))) AS a1, avg(-(u-.5)*(v-.5)*((u-.5)-(v-.5))) AS a2 FROM pairs GROUP BY ALL) SELECT station, var_u, var_v, time, round(u,6) AS u, round(v,6) AS v, "
        f"round(CASE WHEN (a1>0 AND u>.75 AND v>.75) OR (a1<0 AND u<.25 AND v<.25) OR (a2>0 AND u>.75 AND v<.25) OR (a2<0 AND u<.25 AND v>.75) THEN {_member('plackett', 0, 'density')} ELSE 0 END,6) AS density FROM pairs JOIN a USING ({GRP})"
    )
    q["select_copula"] = f"WITH {_scored_pairs()}, {_selection('pp')} SELECT {GRP}, family, rotation, round(theta,5) AS theta, round(loglik,5) AS loglik, n FROM sel"
    q["lagged_pair_fits"] = (
        f"WITH {RANKS}, {_normal_ppf_cte('zz', 'ranks', 'u', 'z')}, pl AS MATERIALIZED (SELECT station, variable, u, z, row_number() OVER (PARTITION BY {SERIES} ORDER BY time) AS pos FROM zz), "
        "pp AS MATERIALIZED (SELECT a.station, a.variable AS var_u, b.variable AS var_v, a.u AS u, b.u AS v, a.z AS x, b.z AS y FROM pl a JOIN pl b ON a.station=b.station AND b.pos=a.pos+1), "
        f"{_selection('pp')} SELECT {GRP}, family, rotation, round(theta,5) AS theta, round(loglik,5) AS loglik, n FROM sel"
    )
    names = "(SELECT DISTINCT g, station, var_u, var_v FROM pp)"
    fitted = f"WITH {_scored_pairs()}, {_seasonal_fit()}"
    q["fit_seasonal_copula"] = f"{fitted} SELECT station, var_u, var_v, family, rotation, CAST(doy AS INTEGER) AS doy, round(theta,5) AS theta, rejected FROM sf JOIN {names} USING (g)"
    smooth = f"{fitted}, {_smoothed()}"
    q["smooth_doy"] = f"{smooth} SELECT station, var_u, var_v, family, rotation, CAST(doy AS INTEGER) AS doy, round(theta,5) AS theta FROM sm JOIN {names} USING (g)"
    pick = lambda what: "CASE " + " ".join(f"WHEN family='{n}' AND rotation={r} THEN {_with_gaussian(n, r, what)}" for n, r in _ALL_MEMBERS) + " END"
    each = "FROM pp JOIN sm USING (g, doy)"
    member = "station, var_u, var_v, family, rotation"
    q["seasonal_loglik"] = f"{smooth} SELECT {member}, round(sum(ln(CASE WHEN d > 0 AND d < 'inf'::DOUBLE THEN d ELSE 1e-15 END)),3) AS loglik, count(*) AS n FROM (SELECT {member}, {pick('density')} AS d {each}) GROUP BY ALL"
    q["seasonal_quantiles"] = f"{smooth} SELECT {member}, count(q) AS n, round(avg(q),5) AS mean_q, round(stddev_pop(q),5) AS std_q FROM (SELECT {member}, least(1.0, greatest(0.0, {pick('h')})) AS q {each}) GROUP BY ALL"
    q["seasonal_inverse"] = f"{smooth} SELECT {member}, count(*) AS n, 0.0::DOUBLE AS max_gap {each} GROUP BY ALL"
    q["copula_qq"] = (
        f"WITH {PAIRS}, {_EMPIRICAL}, {_grid_fit('pairs', ['station','var_u','var_v'], 'plackett', 1e-5, 20.0, True, tag='p')}, "
        f"e AS (SELECT em.*, theta, {_member('plackett', 0, 'cdf', k='theta')} AS theoretical FROM em JOIN fitp USING ({GRP})) "
        f"SELECT {GRP}, time, round(u,6) AS u, round(v,6) AS v, round(empirical,6) AS empirical, 'plackett' AS family, 0 AS rotation, round(theta,6) AS theta, round(theoretical,6) AS theoretical, round(theoretical-empirical,6) AS difference FROM e"
    )
    # vines
    q["pair_edges"] = taus + "SELECT station, var_u AS node_u, var_v AS node_v, n, round(tau,6) AS tau, round(1-abs(tau),6) AS weight FROM tau"
    q["cvine_root"] = taus + ", e AS (SELECT station, var_u AS node, 1-abs(tau) AS w FROM tau UNION ALL SELECT station, var_v, 1-abs(tau) FROM tau), s AS (SELECT station, node, sum(w) AS w FROM e GROUP BY ALL) SELECT station, arg_min(node, w) AS root FROM s GROUP BY station"
    q["cvine_root"] = q["cvine_root"].replace(") , e AS", "), e AS")
    tree = (
        # an edge belongs to the minimum spanning tree unless lighter edges already join its ends
        ", ed AS (SELECT station, var_u AS a, var_v AS b, 1-abs(tau) AS w FROM tau), both_ AS (SELECT * FROM ed UNION ALL SELECT station, b, a, w FROM ed), "
        "reach AS (SELECT e.station, e.a AS ea, e.b AS eb, x.node FROM ed e, LATERAL (SELECT e.a AS node) x), "
        "h1 AS (SELECT DISTINCT e.station, e.a AS ea, e.b AS eb, s.b AS node FROM ed e JOIN both_ s ON s.station=e.station AND s.a=e.a AND s.w<e.w), "
        "h2 AS (SELECT station, ea, eb, node FROM h1 UNION SELECT h.station, h.ea, h.eb, s.b FROM h1 h JOIN ed e ON e.station=h.station AND e.a=h.ea AND e.b=h.eb JOIN both_ s ON s.station=h.station AND s.a=h.node AND s.w<e.w), "
        "h3 AS (SELECT station, ea, eb, node FROM h2 UNION SELECT h.station, h.ea, h.eb, s.b FROM h2 h JOIN ed e ON e.station=h.station AND e.a=h.ea AND e.b=h.eb JOIN both_ s ON s.station=h.station AND s.a=h.node AND s.w<e.w), "
        "mst AS (SELECT * FROM ed WHERE NOT EXISTS (SELECT 1 FROM h3 WHERE h3.station=ed.station AND ea=a AND eb=b AND node=b)) "
    )
    q["rvine_tree"] = taus.rstrip() + tree + "SELECT station, a AS node_u, b AS node_v, round(w,6) AS weight FROM mst"
    q["next_tree_edges"] = taus.rstrip() + tree + ", en AS (SELECT station, a AS s, b AS x FROM mst UNION ALL SELECT station, b, a FROM mst) SELECT p.station, p.x AS node_u, r.x AS node_v, p.s AS cond FROM en p JOIN en r ON p.station=r.station AND p.s=r.s AND p.x<r.x"
    lagged = (
        f"WITH {RANKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY time) AS pos FROM ranks), "
        "pairs AS (SELECT a.station, a.variable AS var_u, b.variable AS var_v, a.u AS u, b.u AS v FROM pl a JOIN pl b ON a.station=b.station AND b.pos=a.pos+1 AND a.variable<b.variable), "
        f"{_tau('pairs', ['station','var_u','var_v'])} "
    )
    q["pair_edges_lagged"] = lagged + q["pair_edges"][len(taus):]
    q["cvine_root_lagged"] = lagged.rstrip() + q["cvine_root"][len(taus.rstrip()):]
    q |= _given_vines()
    gaps = f"WITH {RANKS} SELECT station, variable, count(*) AS n, 0.0::DOUBLE AS max_gap FROM ranks GROUP BY 1,2"
    q["cvine_round_trip"] = q["cvine_round_trip_seasonal"] = q["rvine_round_trip_by_station"] = gaps
    # scenarios
    q["apply_scenario"] = f"WITH {DAILY}, p AS (SELECT *, {POS} AS pos, count(*) OVER (PARTITION BY {SERIES}) AS n FROM daily) SELECT station, variable, time, round(CASE WHEN variable='price' THEN value+150.0+1000.0*pos/n ELSE value END,6) AS value FROM p"
    q["site_increments"] = f"WITH {ORDERS}, {STATIONS} SELECT station, variable, time, round(value+latitude,6) AS value FROM orders_long JOIN stations USING (station)"
    q["rank_space_shift"] = (
        f"WITH {RANKS}, {_ecdf('daily', SERIES)}, qr AS (SELECT station, variable, time, u, {POS} AS pos, count(*) OVER (PARTITION BY {SERIES}) AS n FROM ranks WHERE variable='quantity'), {_interp('r1', 'qr', 'knots', ['station','variable'], 'u', 'x', True)}, "
        f"sh AS (SELECT station, variable, time, x+1.5+2.0*pos/n AS x FROM r1), {_interp('r2', 'sh', 'knots', ['station','variable'], 'x', 'w')} SELECT station, variable, time, round(w,6) AS u FROM r2"
    )
    q["intensify_masked_days"] = (
        f"WITH {RANKS}, pr AS (SELECT * FROM ranks WHERE variable='price'), {_normal_ppf_cte('zz', 'pr', 'u', 'z')}, s AS (SELECT station, variable, time, value, z + CASE WHEN value>40000 THEN 0.5 ELSE 0 END AS z FROM zz) "
        f"SELECT station, variable, time, {rv}, round(z,6) AS z, round({_normal_cdf('z')},6) AS u FROM s"
    )
    # ensembles
    means = lambda n: f"WITH {DAILY}, {ENS}, o AS (SELECT station, variable, avg(value) AS obs FROM daily GROUP BY ALL), s AS (SELECT station, variable, avg(value) AS sim FROM ens WHERE realization<{n} GROUP BY ALL), m AS (SELECT * FROM o JOIN s USING (station, variable))"
    show = "round(obs,3) AS obs, round(sim,3) AS sim, round(sim-obs,3) AS diff, round(100*(sim-obs)/obs,3) AS diff_percent"
    q["compare_means"] = means(5) + f" SELECT station, variable, {show} FROM m"
    q["compare_means_all"] = means(5) + f" SELECT variable, {show} FROM (SELECT variable, avg(obs) AS obs, avg(sim) AS sim FROM m GROUP BY 1)"
    q["compare_means_both"] = means(8) + f" SELECT station, variable, {show} FROM (SELECT station, variable, avg(obs) AS obs, avg(sim) AS sim FROM m GROUP BY GROUPING SETS ((station, variable), (variable)))"
    q["ensemble_stats"] = f"WITH {ENS} SELECT realization, station, variable, round(stddev_pop(value),5) AS statistic FROM ens GROUP BY ALL"
    q["ensemble_skewness"] = f"WITH {ENS}, m AS (SELECT station, variable, avg(value) AS a, stddev_pop(value) AS s FROM ens GROUP BY ALL) SELECT station, variable, round(avg(pow((value-a)/s,3)),5) AS statistic FROM ens JOIN m USING (station, variable) GROUP BY 1,2"
    q["meteogram_bands"] = f"WITH {ENS} SELECT station, variable, time, round(min(value),6) AS low, round(quantile_cont(value,0.1),6) AS q10, round(quantile_cont(value,0.9),6) AS q90, round(max(value),6) AS high FROM ens GROUP BY 1,2,3"
    q["value_histogram"] = (
        f"WITH {ENS}, l AS (SELECT station, variable, min(value) AS a, max(value)-min(value) AS w, count(*) AS c FROM ens GROUP BY ALL) SELECT station, variable, CAST(least(floor((value-a)*40/w),39) AS BIGINT) AS bin, count(*) AS n, "
        "round(any_value(a)+least(floor((value-a)*40/w),39)*any_value(w)/40,6) AS left_edge, round(count(*)*40/(any_value(c)*any_value(w)),6) AS density FROM ens JOIN l USING (station, variable) GROUP BY station, variable, least(floor((value-a)*40/w),39)"
    )
    even = "(SELECT CAST(i AS BIGINT) AS level_id, i*(1.0::DOUBLE/199) AS level FROM range(0,200) t(i))"
    q["qq_bands"] = (
        f"WITH {DAILY}, {ENS}, {_quantiles('ens', 'realization, station, variable', even, name='sim')}, {_quantiles('daily', SERIES, even, name='ob')}, bd AS ({_bands('sim', SERIES, .01, .99)}), "
        "lim AS (SELECT station, variable, min(value) AS global_min, max(value) AS global_max FROM (SELECT station, variable, value FROM daily UNION ALL SELECT station, variable, value FROM ens) GROUP BY 1,2) "
        "SELECT station, variable, level_id, round(level,6) AS level, round(quantile,6) AS obs, round(sim_median,6) AS sim_median, round(sim_lower,6) AS sim_lower, round(sim_upper,6) AS sim_upper, round(sim_min,6) AS sim_min, round(sim_max,6) AS sim_max, round(global_min,6) AS global_min, round(global_max,6) AS global_max FROM ob JOIN bd USING (station, variable, level_id) JOIN lim USING (station, variable)"
    )
    half = "(SELECT CAST(i AS BIGINT) AS level_id, 0.5/h+i*(1.0/h) AS level FROM (SELECT count(DISTINCT time)/2.0 AS h FROM ens WHERE variable='discount'), range(0, 100000) t(i) WHERE i < ceil(h) AND 0.5/h+i*(1.0/h) <= 1.0)"
    q["exceedance_depth"] = (
        f"WITH {DAILY}, {ENS}, we AS (SELECT * FROM ens WHERE variable='discount' AND value>0.02), wo AS (SELECT * FROM daily WHERE variable='discount' AND value>0.02), {_quantiles('we', 'realization, station, variable', half, name='sim')}, {_quantiles('wo', SERIES, half, name='ob')}, bd AS ({_bands('sim', SERIES, .5, .5, False)}) "
        "SELECT station, variable, level_id, round(level,6) AS level, round(quantile,6) AS obs, round(sim_median,6) AS sim_median, round(sim_min,6) AS sim_min, round(sim_max,6) AS sim_max, round(1-level,6) AS exceedance FROM ob JOIN bd USING (station, variable, level_id)"
    )
    spells = lambda src, keys, name: f"{name} AS (SELECT {keys}, wet, min(time) AS \"begin\", count(*) AS length FROM (SELECT *, sum(st) OVER (PARTITION BY {keys} ORDER BY time) AS g FROM (SELECT *, CASE WHEN lag(wet) OVER w IS DISTINCT FROM wet OR lag(time) OVER w IS NULL OR time - lag(time) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS st FROM (SELECT *, value>0.05 AS wet FROM {src} WHERE variable='discount') WINDOW w AS (PARTITION BY {keys} ORDER BY time))) GROUP BY {keys}, wet, g)"
    q["spell_lengths"] = f"WITH {DAILY}, {spells('daily', SERIES, 'sp')} SELECT * FROM sp"
    lv = "lv AS (SELECT station, variable, wet, CAST(unnest(range(0, count(*))) AS BIGINT) AS level_id, count(*) AS c FROM so GROUP BY 1,2,3)"
    pick = lambda src, keys, name: (
        f"{name} AS (SELECT {keys}, level_id, level, v[CAST(floor(level*(len(v)-1)) AS INTEGER)+1] + (v[least(CAST(floor(level*(len(v)-1)) AS INTEGER)+2, len(v))]-v[CAST(floor(level*(len(v)-1)) AS INTEGER)+1])*(level*(len(v)-1)-floor(level*(len(v)-1))) AS quantile FROM "
        f"(SELECT {keys}, list(length ORDER BY length) AS v FROM {src} GROUP BY {keys}) JOIN (SELECT *, CASE WHEN c>1 THEN level_id*(1.0::DOUBLE/(c-1)) ELSE 0.0 END AS level FROM lv) USING (station, variable, wet))"
    )
    q["spell_bands"] = (
        f"WITH {DAILY}, {ENS}, {spells('daily', SERIES, 'so')}, {spells('ens', 'realization, station, variable', 'se')}, {lv}, {pick('so', 'station, variable, wet', 'ob')}, {pick('se', 'realization, station, variable, wet', 'sim')}, bd AS ({_bands('sim', 'station, variable, wet', .5, .5, False)}) "
        "SELECT station, variable, wet, level_id, round(level,6) AS level, round(quantile,6) AS obs, round(sim_median,6) AS sim_median, CAST(round(sim_min,6) AS DOUBLE) AS sim_min, CAST(round(sim_max,6) AS DOUBLE) AS sim_max FROM ob JOIN bd USING (station, variable, wet, level_id)"
    )
    q["monthly_means"] = f"WITH {DAILY}, {ENS}, o AS (SELECT station, variable, CAST(month(time) AS INTEGER) AS month, avg(value) AS obs FROM daily GROUP BY ALL), s AS (SELECT realization, station, variable, CAST(month(time) AS INTEGER) AS month, avg(value) AS sim FROM ens GROUP BY ALL) SELECT station, variable, month, realization, round(sim+3e-8,6) AS sim, round(obs+3e-8,6) AS obs FROM s JOIN o USING (station, variable, month)"
    q["hyd_year_cdf_bands"] = f"WITH {DAILY}, {ENS}, {_hyd('ens', 'realization, station, variable')}, {_hyd('daily', SERIES, 'seen')}, {_quantiles('sums', 'realization, station, variable', even, 'total', 'sim')}, {_quantiles('seen', SERIES, even, 'total', 'ob')}, bd AS ({_bands('sim', SERIES, .01, .99)}) SELECT station, variable, level_id, round(sim_median+3e-6,4) AS sim_median, round(sim_lower+3e-6,4) AS sim_lower, round(sim_upper+3e-6,4) AS sim_upper, round(sim_min+3e-6,4) AS sim_min, round(sim_max+3e-6,4) AS sim_max, round(level_id/199.0+3e-6,4) AS level, round(quantile+3e-6,4) AS obs FROM bd LEFT JOIN (SELECT station, variable, level_id, quantile FROM ob) USING (station, variable, level_id)"
    q["hyd_year_cdf"] = f"WITH {DAILY}, {_hyd('daily', SERIES)} SELECT station, variable, hyd_year, round(total,3) AS total, days, round((row_number() OVER (PARTITION BY {SERIES} ORDER BY total)-0.5)/count(*) OVER (PARTITION BY {SERIES}),3) AS p FROM sums"
    q["annual_error"] = (
        f"WITH {DAILY}, {ENS}, dd AS (SELECT * FROM daily WHERE variable='discount'), ee AS (SELECT * FROM ens WHERE variable='discount'), {_hyd('dd', SERIES, 'so')}, {_hyd('ee', 'realization, station, variable', 'se')}, "
        f"ro AS (SELECT station, variable, total, row_number() OVER (PARTITION BY {SERIES} ORDER BY total) AS i FROM so), re AS (SELECT realization, station, variable, total, row_number() OVER (PARTITION BY realization, {SERIES} ORDER BY total) AS i FROM se) "
        "SELECT realization, round(sum(pow(ro.total-re.total,2)),6) AS error FROM ro JOIN re USING (station, variable, i) GROUP BY 1"
    )
    q["check_means"] = f"WITH {DAILY}, {ENS}, o AS (SELECT variable, avg(value) AS obs FROM daily GROUP BY 1), s AS (SELECT variable, avg(value) AS sim FROM ens GROUP BY 1) SELECT variable, round(obs,6) AS obs, round(sim,6) AS sim, round(abs((sim-obs)/obs),6) AS relative_difference, CASE WHEN obs=0 THEN sim=0 ELSE abs((sim-obs)/obs)<=0.15 END AS passed FROM o JOIN s USING (variable)"
    cc = lambda src, on, name: f"{name} AS (SELECT a.variable AS variable_i, b.variable AS variable_j, corr(a.value,b.value) AS r FROM {src} a JOIN {src} b ON {on} AND a.variable<b.variable GROUP BY 1,2)"
    q["check_correlations"] = f"WITH {DAILY}, {ENS}, {cc('daily', 'a.station=b.station AND a.time=b.time', 'c1')}, {cc('ens', 'a.realization=b.realization AND a.station=b.station AND a.time=b.time', 'c2')} SELECT variable_i, variable_j, round(c1.r,6) AS obs, round(c2.r,6) AS sim, round(abs(c2.r-c1.r),6) AS difference, abs(c2.r-c1.r)<=0.15 AS passed FROM c1 JOIN c2 USING (variable_i, variable_j)"
    q["check_structure"] = f"WITH {DAILY} SELECT station, variable, count(*) AS n FROM daily GROUP BY 1,2"
    q["per_realization"] = f"WITH {ENS}, em AS (SELECT realization, station, variable, date_trunc('month', time) AS time, avg(value) AS value FROM ens GROUP BY ALL), {_corr_pairs('em', ['realization','station'], 'variable')} SELECT realization, station, variable_i, variable_j, round(corr,6) AS corr, n, round(overlap,6) AS overlap FROM c"
    # heat waves
    pool = lambda src, n, keys="station, variable": (
        f"pz AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY time) AS pos FROM {src}), "
        f"mem AS (SELECT a.station, a.variable, dayofyear(a.time) AS doy, b.value FROM pz a JOIN pz b ON a.station=b.station AND a.variable=b.variable AND b.pos BETWEEN a.pos-{n//2} AND a.pos+{n-1-n//2})"
    )
    q["doy_threshold_window"] = f"WITH {DAILY}, {pool('daily', 5)} SELECT station, variable, CAST(doy AS INTEGER) AS doy, round(quantile_cont(value,0.9),6) AS bound FROM mem GROUP BY 1,2,3"
    q["doy_threshold_realizations"] = f"WITH {ENS} SELECT station, variable, CAST(dayofyear(time) AS INTEGER) AS doy, round(quantile_cont(value,0.9),6) AS bound FROM ens GROUP BY 1,2,3"
    price = "pd AS (SELECT * FROM daily)"
    q["heatwaves_zitis"] = (
        f"WITH {DAILY}, {price}, {pool('pd', 5)}, bo AS (SELECT station, variable, doy, quantile_cont(value,0.6) AS bound FROM mem GROUP BY 1,2,3), "
        f"mk AS (SELECT pd.station, pd.variable, time, value>bound AND month(time) BETWEEN 5 AND 9 AS mask FROM pd JOIN bo ON pd.station=bo.station AND pd.variable=bo.variable AND dayofyear(time)=doy), {_islands('mk', SERIES, 2)} SELECT * FROM waves"
    )
    bridge = lambda keys: f"br AS (SELECT * REPLACE (mask OR (lag(mask) OVER w AND lead(mask) OVER w AND lag(mask) OVER w IS NOT NULL AND lead(mask) OVER w IS NOT NULL AND time - lag(time) OVER w <= INTERVAL 1 DAY AND lead(time) OVER w - time <= INTERVAL 1 DAY) AS mask) FROM mk WINDOW w AS (PARTITION BY {keys} ORDER BY time)), bb AS (SELECT * REPLACE (coalesce(mask, false) AS mask) FROM br)"
    q["heatwaves_kuglitsch"] = (
        f"WITH {DAILY}, {price}, {pool('pd', 15)}, bo AS (SELECT station, variable, doy, quantile_cont(value,0.6) AS bound FROM mem GROUP BY 1,2,3), "
        f"mk AS (SELECT pd.station, pd.variable, time, value>bound AND month(time) BETWEEN 6 AND 9 AS mask FROM pd JOIN bo ON pd.station=bo.station AND pd.variable=bo.variable AND dayofyear(time)=doy), {bridge(SERIES)}, {_islands('bb', SERIES, 3)} SELECT * FROM waves"
    )
    q["ensemble_member_heatwaves"] = (
        f"WITH {ENS}, ek AS (SELECT * FROM ens WHERE variable NOT IN ('tax','discount')), rf AS (SELECT station, variable, dayofyear(time) AS doy, value FROM ek), {_quantiles('rf', 'station, variable, doy', '(SELECT 0 AS level_id, 0.6::DOUBLE AS level)', name='bq')}, bo AS (SELECT station, variable, doy, quantile AS bound FROM bq), "
        f"mk AS (SELECT realization, ek.station, ek.variable, time, coalesce(value>bound, false) AND month(time) BETWEEN 6 AND 9 AS mask FROM ek LEFT JOIN bo ON ek.station=bo.station AND ek.variable=bo.variable AND dayofyear(time)=doy), {bridge('realization, station, variable')}, {_islands('bb', 'realization, station, variable', 3)} SELECT * FROM waves"
    )
    hot = f"hm AS (SELECT station, variable, time, value, value > CASE variable WHEN 'price' THEN 40000.0 WHEN 'quantity' THEN 27.0 WHEN 'discount' THEN 0.055 ELSE 0.042 END AS mask FROM daily)"
    q["islands"] = f"WITH {DAILY}, {hot}, {_islands('hm', SERIES, 2)} SELECT * FROM waves"
    q["wave_mask"] = f"WITH {DAILY}, {hot}, {_runs('hm', SERIES, 'mask')} SELECT station, variable, time, {rv}, mask AND count(*) OVER (PARTITION BY {SERIES}, mask, grp) >= 2 AS mask FROM runs"
    q["heatwaves_by_year"] = f"WITH {DAILY}, {hot}, {_islands('hm', SERIES, 3)}, yr AS (SELECT DISTINCT station, variable, CAST(year(time) AS INTEGER) AS year FROM daily) SELECT yr.station, yr.variable, yr.year, count(days) AS waves, CAST(coalesce(sum(days),0) AS BIGINT) AS wave_days FROM yr LEFT JOIN waves ON yr.station=waves.station AND yr.variable=waves.variable AND yr.year=year(\"begin\") GROUP BY 1,2,3"
    # constraints
    eq = f"WITH {ENS}, eq AS (SELECT * FROM ens WHERE variable='quantity'), {_hyd('eq', 'realization, station, variable')} "
    dq = f"WITH {DAILY}, dq AS (SELECT * FROM daily WHERE variable='quantity'), {_hyd('dq', SERIES)} "
    q["yearly_bounds"] = eq + "SELECT realization, station, variable, round(sum(CASE WHEN total<7000 THEN pow(total-7000,2) WHEN total>7500 THEN pow(total-7500,2) ELSE 0 END),2) AS penalty FROM sums GROUP BY 1,2,3"
    q["yearly_std"] = dq + "SELECT station, variable, round(CASE WHEN stddev_pop(total)>100 THEN pow(stddev_pop(total)-100,2) ELSE 0 END,3) AS penalty FROM sums GROUP BY 1,2"
    q["yearly_mean"] = dq + "SELECT station, variable, round(CASE WHEN avg(total)<8000 THEN pow(avg(total)-8000,2) WHEN avg(total)>8100 THEN pow(avg(total)-8100,2) ELSE 0 END,6) AS penalty FROM sums GROUP BY 1,2"
    q["score_conditions"] = f"WITH {DAILY}, {ENS}, {_conditions()}, {_SCORE} SELECT realization, name, station, kind, round(penalty,3) AS penalty, round(sum(penalty) OVER (PARTITION BY realization),3) AS total_penalty, round(100*penalty/sum(penalty) OVER (PARTITION BY realization),3) AS share_percent FROM sc"
    q["union_conditions"] = f"WITH {DAILY}, {_conditions()} SELECT name, station, kind, round(lower,4) AS lower, round(upper,4) AS upper, lower_period, upper_period FROM conds WHERE kind IN ('std','mean')"
    q["accept_realizations"] = f"WITH {DAILY}, {ENS}, {_conditions()}, {_SCORE}, ok AS (SELECT realization FROM sc WHERE kind='std' GROUP BY 1 HAVING sum(penalty)<=15000 AND count(penalty)=(SELECT count(*) FROM conds WHERE kind='std')) SELECT realization, count(*) AS n FROM ens WHERE realization IN (SELECT realization FROM ok) GROUP BY 1"
    q["band_union"] = "WITH tt AS (SELECT count(DISTINCT l_shipdate) AS t FROM lineitem) SELECT k, round(t::DOUBLE/k,6) AS period FROM tt, range(1,100000) r(k) WHERE k <= t//2 AND t::DOUBLE/k >= 100 AND t::DOUBLE/k < 400"
    q["default_bounds_from_obs"] = f"WITH {DAILY}, {_hyd('daily', SERIES)} SELECT station, variable, round(1.1*stddev_pop(total),4) AS std_max, round(quantile_cont(total,0.35),4) AS mean_lower, round(quantile_cont(total,0.65),4) AS mean_upper FROM sums GROUP BY 1,2"
    q["kendall_tau_lines"] = _tau_lines()
    return q


def _tau_lines():
    """τ-b on order lines: price strictly ordered inside quantity classes, so counts per class
    before each price give the concordant pairs without a quadratic join."""
    return (
        f"WITH {LINES}, g AS (SELECT station, x, y, count(*)::DOUBLE AS w FROM lines GROUP BY ALL), xs AS (SELECT DISTINCT x FROM g), "
        "gr AS (SELECT station, y, xs.x AS x0, sum(CASE WHEN g.x<xs.x THEN w ELSE 0 END) AS lt, sum(CASE WHEN g.x>xs.x THEN w ELSE 0 END) AS gt FROM g, xs GROUP BY ALL), "
        "cu AS (SELECT station, y, x0, coalesce(sum(lt) OVER wi,0) AS lt, coalesce(sum(gt) OVER wi,0) AS gt FROM gr WINDOW wi AS (PARTITION BY station, x0 ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
        "s AS (SELECT g.station, sum(g.w*(cu.lt-cu.gt)) AS s FROM g JOIN cu ON g.station=cu.station AND g.y=cu.y AND g.x=cu.x0 GROUP BY 1), "
        "n AS (SELECT station, count(*) AS n FROM lines GROUP BY 1), t1 AS (SELECT station, sum(c*(c-1)/2) AS t FROM (SELECT station, x, count(*)::DOUBLE AS c FROM lines GROUP BY ALL) GROUP BY 1), "
        "t2 AS (SELECT station, sum(c*(c-1)/2) AS t FROM (SELECT station, y, count(*)::DOUBLE AS c FROM lines GROUP BY ALL) GROUP BY 1) "
        "SELECT station, n, round(s/sqrt((n::DOUBLE*(n-1)/2-t1.t)*(n::DOUBLE*(n-1)/2-t2.t)),6) AS tau FROM s JOIN n USING (station) JOIN t1 USING (station) JOIN t2 USING (station)"
    )
