"""Likelihood, fitting and selection of copulas on pair tables.

Fitting is a search on a θ grid that zooms in. Pairs are packed into blocks once; in every
round each block meets all families and grid points inside its task (numpy on Arrow batches)
and leaves one partial sum per grid point, which Spark adds up per group. A large group has
many blocks, so it is never collected, and only one bracket row per group is joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meteospan.functions.copula import (
    FAMILIES,
    by_family,
    clamp,
    copula_cdf,
    copula_density,
    h_array,
    h_inverse_array,
    members,
    rotate,
    symmetry_flags,
    turned,
)
from meteospan.operators.pairs import asymmetry1, asymmetry2, asymmetry_means, tau_min
from meteospan.operators.ranks import bipit
from meteospan.operators.timeops import lag_pairs
from meteospan.schema import finite, pair_keys
from meteospan.session import cut_lineage

FIT_FLOOR, SCORE_FLOOR, SEASONAL_FLOOR = 1e-9, 1e-12, 1e-15
ONEISH = 1.0 - 1e-9
PACK = 8192


def log_density(density: Column, floor: float) -> Column:
    """log of a density; what is not positive and finite counts as ``floor``."""
    usable = (density > 0) & (density < F.lit(float("inf")))
    return F.log(F.when(usable, density).otherwise(F.lit(floor)))


def log_likelihood(
    pairs: DataFrame, family: str, theta, floor: float = SCORE_FLOOR, rotation: int = 0,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Σ log density per group for one family and parameter (number or column)."""
    keys = pair_keys(pairs) if keys is None else list(keys)
    rows = pairs.filter(finite("u") & finite("v"))
    density = copula_density(family, F.col("u"), F.col("v"), theta, rotation)
    return rows.groupBy(*keys).agg(F.sum(log_density(density, floor)).alias("loglik"), F.count("*").alias("n"))


def _first_grid(name: str, grid: int) -> np.ndarray:
    """θ of the first round: even in log θ where the lower bound is positive."""
    f = FAMILIES[name]
    if f.lo > 0:
        return np.exp(np.linspace(math.log(f.lo), math.log(f.hi), grid)).clip(f.lo, f.hi)
    return np.linspace(f.lo, f.hi, grid)


def _packed(pairs: DataFrame, keys: Sequence[str], wet: str | None) -> DataFrame:
    """Pairs in blocks of about ``PACK`` distinct (u, v), written once for all rounds.

    Equal pairs become one weighted entry first, so the hash that assigns blocks spreads
    them evenly however large a group is.
    """
    cells = (
        pairs.filter(finite("u") & finite("v"))
        .select(
            *keys, clamp(F.col("u")).alias("u"), clamp(F.col("v")).alias("v"),
            (F.lit(True) if wet is None else F.coalesce(F.col(wet), F.lit(False))).alias("wet"),
        )
        .groupBy(*keys, "u", "v", "wet")
        .agg(F.count("*").alias("w"))
    )
    sizes = cells.groupBy(*keys).agg(
        F.count("*").alias("_cells"), F.sum("w").alias("n_all"),
        F.sum(F.when(~F.col("wet"), F.col("w")).otherwise(0)).alias("n_dry"),
        F.max(F.when(~F.col("wet"), F.col("u"))).alias("u_max"),
        F.max(F.when(~F.col("wet"), F.col("v"))).alias("v_max"),
    )
    facts = ["n_all", "n_dry", "u_max", "v_max"]
    sizes = sizes.withColumn("_blocks", F.ceil(F.col("_cells") / PACK).cast("int"))
    lists = [F.collect_list(c).alias(c) for c in ("u", "v", "w", "wet")]
    block = F.pmod(F.xxhash64("u", "v", "wet"), F.coalesce("_blocks", F.lit(1))).cast("int").alias("_block")
    if keys:
        # a group of one block needs no number of blocks; of the others there are fewer than one for PACK cells
        large = sizes.filter("_blocks > 1").select(*keys, "_blocks")
        packed = cells.join(F.broadcast(large), list(keys), "left").groupBy(*keys, block).agg(*lists)
        packed = packed.join(_by_block(sizes.select(*keys, *facts, "_blocks")), [*keys, "_block"])
    else:
        one = sizes.select(F.struct("_blocks", *facts).alias("s")).scalar()
        sized = cells.withColumn("_s", one).select(*cells.columns, "_s.*")
        packed = sized.groupBy(block).agg(*lists, *[F.first(c).alias(c) for c in [*facts, "_blocks"]])
    return cut_lineage(packed)


def _by_block(table: DataFrame) -> DataFrame:
    """A row of each group for every one of its blocks, so that a join deals out the blocks and not the groups."""
    return table.withColumn("_block", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_blocks"), F.lit(1)) - 1)))


def _grid_sums(packed: DataFrame, keys, chosen, grid: int, floor: float, masked: bool) -> DataFrame:
    """(keys, m, i, theta, ll, n): summed log densities on the θ grid of every member.

    ``packed`` may carry the arrays ``lo`` and ``hi`` (one entry per member); without them
    the first grid is used. Each task reduces its blocks before anything is shuffled.
    """
    first = "lo" not in packed.columns
    start = np.stack([_first_grid(name, grid) for name, _ in chosen])
    columns = [*keys, "u", "v", "w", "wet", "n_all", "n_dry", "u_max", "v_max", "_blocks"]
    columns += [] if first else ["lo", "hi"]

    def evaluate(batches):
        with np.errstate(all="ignore"):
            for frame in batches:
                theta_rows, ll_rows, counts = [], [], []
                for row in frame.itertuples(index=False):
                    wet = np.asarray(row.wet, dtype=bool)
                    u, v = np.asarray(row.u, dtype=float), np.asarray(row.v, dtype=float)
                    w = np.asarray(row.w, dtype=float)
                    share = w.sum() / row.n_all
                    counts.append(int(w.sum()))
                    if masked:
                        u, v, w = u[wet], v[wet], w[wet]
                    lls = []
                    if first:
                        thetas = start
                    else:
                        lo, hi = np.asarray(row.lo, dtype=float), np.asarray(row.hi, dtype=float)
                        thetas = np.linspace(lo, hi, grid, axis=1)
                    for (name, rotation), theta in zip(chosen, thetas):
                        a, b = turned(u, v, rotation)
                        d = FAMILIES[name].density(a[:, None], b[:, None], theta[None, :])
                        d = np.where((d > 0) & np.isfinite(d), d, floor)
                        ll = w @ np.log(d)
                        if masked and row.n_dry > 0:
                            right = row.u_max > row.v_max
                            cu = np.full(grid, ONEISH if right else row.u_max)
                            cv = np.full(grid, row.v_max if right else ONEISH)
                            base = lambda p, q: FAMILIES[name].cdf(p, q, theta)
                            corner = rotate(base, rotation)(cu, cv)
                            # the corner belongs to the group: each block adds its part
                            ll = ll + share * row.n_dry * np.log(np.maximum(corner, 1e-300))
                        lls.append(np.where(np.isnan(ll), -1e300, ll))
                    theta_rows.append(np.ravel(thetas))
                    ll_rows.append(np.ravel(lls))
                out = frame[list(keys)].copy()
                out["thetas"], out["lls"], out["n"], out["_blocks"] = theta_rows, ll_rows, counts, frame["_blocks"]
                yield out

    fields = [f for f in packed.schema.fields if f.name in keys]
    schema = T.StructType(
        [
            *fields,
            T.StructField("thetas", T.ArrayType(T.DoubleType())),
            T.StructField("lls", T.ArrayType(T.DoubleType())),
            T.StructField("n", T.LongType()),
            T.StructField("_blocks", T.IntegerType()),
        ]
    )
    parts = packed.select(*columns).mapInPandas(evaluate, schema)
    spots = parts.select(
        *keys, "n", "_blocks", F.posexplode(F.arrays_zip("thetas", "lls")).alias("at", "s")
    )
    return spots.groupBy(
        *keys, F.floor(F.col("at") / grid).cast("int").alias("m"), (F.col("at") % grid).alias("i")
    ).agg(F.max("s.thetas").alias("theta"), F.sum("s.lls").alias("ll"), F.sum("n").alias("n"), F.max("_blocks").alias("_blocks"))


def _brackets(sums: DataFrame, keys) -> DataFrame:
    """One row per group: arrays lo, hi (by member) around the best grid point, and the number of its blocks."""
    points = F.sort_array(F.collect_list(F.struct("i", "theta")))  # one entry per grid point
    best = F.max_by("i", F.struct("ll", -F.col("i")))
    at = lambda j: F.col("_p")[j]["theta"]
    per_member = (
        sums.groupBy(*keys, "m")
        .agg(points.alias("_p"), best.alias("_i"), F.max("_blocks").alias("_blocks"))
        .select(
            *keys, "m", "_blocks",
            at(F.greatest(F.col("_i") - 1, F.lit(0))).alias("lo"),
            at(F.least(F.col("_i") + 1, F.size("_p") - 1)).alias("hi"),
            at(F.col("_i")).alias("theta"),
        )
    )
    by_member = lambda c: F.transform(
        F.sort_array(F.collect_list(F.struct("m", c))), lambda e: e[c]
    ).alias(c)
    return per_member.groupBy(*keys).agg(by_member("lo"), by_member("hi"), by_member("theta"), F.max("_blocks").alias("_blocks"))


def _attach_by(df: DataFrame, table: DataFrame, keys) -> DataFrame:
    """``table``, a row per group, joined to ``df``; without keys it is a single row."""
    return _attach(df, table, keys, [c for c in table.columns if c not in keys])


def _attach(packed: DataFrame, table: DataFrame, keys, columns) -> DataFrame:
    table = table.select(*keys, *columns)
    if keys:
        return packed.join(table, list(keys))
    row = table.select(F.struct(*columns).alias("r")).scalar()
    return packed.withColumn("_r", row).select(*packed.columns, "_r.*")


def _attach_brackets(packed: DataFrame, around: DataFrame, keys) -> DataFrame:
    """``lo`` and ``hi`` of the group of each block."""
    if not keys:
        return _attach(packed, around, keys, ["lo", "hi"])
    return packed.join(_by_block(around.select(*keys, "lo", "hi", "_blocks")).drop("_blocks"), [*keys, "_block"])


def _zoomed(packed: DataFrame, keys, chosen, zooms: int, grid: int, masked: bool) -> DataFrame:
    """One row per group: arrays lo, hi, theta (by member) after the last zoom."""
    rows = packed
    for _ in range(zooms):
        around = _brackets(_grid_sums(rows, keys, chosen, grid, FIT_FLOOR, masked), keys)
        rows = _attach_brackets(packed, around, keys)
    return around


def fit_copula(
    pairs: DataFrame,
    families=None,
    keys: Sequence[str] | None = None,
    wet_col: str | None = None,
    zooms: int = 4,
    grid: int = 16,
) -> DataFrame:
    """Maximum-likelihood θ of every family and rotation per group.

    With ``wet_col`` the density is taken over wet rows only and the dry ones enter as the
    probability of their corner. A masked search that ends at a bound of θ, or has no wet row, has not converged: the member is
    fitted to all rows of that group instead, and ``masked`` tells which of both θ comes from.
    ``loglik`` is the likelihood of all rows at the fitted θ.
    Returns (keys, family, rotation, theta, loglik, n[, masked]).
    """
    keys = pair_keys(pairs) if keys is None else list(keys)
    chosen = [m for m in members(families) if m[0] != "independence"]
    packed = _packed(pairs, keys, wet_col)
    around = _zoomed(packed, keys, chosen, zooms, grid, wet_col is not None)
    if wet_col is not None:
        ends = lambda side: F.array(*[F.lit(float(getattr(FAMILIES[n], side))) for n, _ in chosen])
        near = lambda x, bound: F.abs(x - bound) <= 1e-8 + 1e-5 * F.abs(bound)
        wet = packed.groupBy(*keys).agg((F.max("n_all") > F.max("n_dry")).alias("_wet"))
        inside = F.transform("theta", lambda x, i: F.col("_wet") & ~near(x, F.get(ends("lo"), i)) & ~near(x, F.get(ends("hi"), i)))
        around = cut_lineage(_attach_by(around, wet, keys).withColumn("ok", inside).drop("_wet"))
        failed = around.filter(F.exists("ok", lambda x: ~x))
        again = packed.join(failed.select(*keys), list(keys), "left_semi") if keys else packed.crossJoin(failed.select(F.lit(1).alias("_f"))).drop("_f")
        plain = _zoomed(again, keys, chosen, zooms, grid, False).select(*keys, F.col("theta").alias("plain"))
        around = around.join(plain, list(keys), "left") if keys else around.crossJoin(plain) if not failed.isEmpty() else around.withColumn("plain", F.col("theta"))
        around = around.withColumn("theta", F.transform("theta", lambda x, i: F.when(F.get("ok", i), x).otherwise(F.get("plain", i))))
    at_best = _attach_brackets(packed, around.select(*keys, "_blocks", F.col("theta").alias("lo"), F.col("theta").alias("hi")), keys)
    scored = _grid_sums(at_best, keys, chosen, 1, SCORE_FLOOR, False)
    names = F.array(*[F.lit(n) for n, _ in chosen])
    turns = F.array(*[F.lit(r) for _, r in chosen])
    which = []
    if wet_col is not None:
        scored = _attach_by(scored, around.select(*keys, "ok"), keys)
        which = [F.get("ok", F.col("m")).alias("masked")]
    out = scored.select(
        *keys, names[F.col("m")].alias("family"), turns[F.col("m")].alias("rotation"),
        "theta", F.col("ll").alias("loglik"), "n", *which,
    )
    if any(n == "independence" for n, _ in members(families)):
        flat = packed.groupBy(*keys).agg(F.max("n_all").alias("n")).select(
            *keys, F.lit("independence").alias("family"), F.lit(0).alias("rotation"),
            F.lit(0.0).alias("theta"), F.lit(0.0).alias("loglik"), "n", *[F.lit(True).alias("masked") for _ in which],
        )
        out = out.unionByName(flat)
    return out


def _best_member(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    order = {name: i for i, name in enumerate(FAMILIES)}
    rank = F.create_map(*[F.lit(x) for item in order.items() for x in item])[F.col("family")]
    place = rank * 4 + F.col("rotation") / 90
    # some rotations are the same copula with another θ; rounding makes that tie exact
    best = F.max_by(
        F.struct("family", "rotation", "theta", "loglik", "n"),
        F.struct(F.round("loglik", 5), -place),
    )
    return fits.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def asymmetry_filter(
    pairs: DataFrame, families: DataFrame | None = None, threshold: float = 0.002,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Candidates per group: an asymmetry above the threshold drops the families with that
    symmetry; if none is left all are candidates. Independence is not among them."""
    keys = pair_keys(pairs) if keys is None else list(keys)
    families = symmetry_flags(pairs.sparkSession) if families is None else families
    table = families.filter(F.col("family") != "independence")
    a, b = asymmetry1(pairs, keys), asymmetry2(pairs, keys)
    if keys:
        both = a.join(b, keys)
    else:
        both = a.withColumn("asymmetry2", b.select("asymmetry2").scalar())
    entries = table.select(
        F.collect_list(F.struct("family", "rotation", "symmetry1", "symmetry2"))
    ).scalar()  # 35 entries
    fits = lambda e: ~((F.abs("asymmetry1") > threshold) & e["symmetry1"]) & ~(
        (F.abs("asymmetry2") > threshold) & e["symmetry2"]
    )
    rows = both.withColumn("_all", entries).withColumn("_some", F.filter("_all", fits))
    chosen = F.when(F.size("_some") > 0, F.col("_some")).otherwise(F.col("_all"))
    return rows.select(*keys, "asymmetry1", "asymmetry2", F.inline(chosen)).drop(
        "symmetry1", "symmetry2"
    )


def select_copula(
    pairs: DataFrame,
    keys: Sequence[str] | None = None,
    families=None,
    seasonal: bool = False,
    asymmetry: bool = False,
    wet_col: str | None = None,
    w: int = 15,
    order: int = 4,
    **options,
) -> DataFrame:
    """Family with the highest likelihood per group; likelihood 0 means independence.

    With ``seasonal`` the families with a θ that varies over the year compete as well; ``pairs`` needs a time column then.
    A seasonal winner has ``seasonal`` set, its θ of the days 1…366 in ``thetas``, and a null ``theta``. With ``asymmetry``
    only the families that can have the asymmetry of the group compete, seasonal or not, and the seasonal
    density counts in the corners that carry it.
    """
    keys = pair_keys(pairs) if keys is None else list(keys)
    fits = fit_copula(pairs, families, keys, wet_col, **options)
    allowed = asymmetry_filter(pairs, keys=keys).select(*keys, "family", "rotation") if asymmetry else None
    only = lambda df: df if allowed is None else df.join(allowed, [*keys, "family", "rotation"], "left_semi")
    fits = only(fits).drop("masked")
    if not seasonal:
        best = _best_member(fits, keys)
    else:
        smooth = cut_lineage(only(smooth_doy(fit_seasonal_copula(pairs, families, w, keys, wet_col), order, keys)))
        scores = seasonal_loglik(pairs, smooth, keys, asymmetry)
        both = fits.withColumn("seasonal", F.lit(False)).unionByName(
            scores.withColumns({"seasonal": F.lit(True), "theta": F.lit(None).cast("double")})
        )
        top = F.max_by(
            F.struct("family", "rotation", "theta", "loglik", "n", "seasonal"),
            F.struct("loglik", ~F.col("seasonal"), "family", "rotation"),
        )
        best = both.groupBy(*keys).agg(top.alias("_b")).select(*keys, "_b.*")
        best = best.join(every_day(smooth, keys).withColumn("seasonal", F.lit(True)), [*keys, "family", "rotation", "seasonal"], "left")
        best = best.withColumn("thetas", F.when(F.col("seasonal") & (F.col("loglik") != 0), F.col("thetas")))
    flat = F.col("loglik") == 0
    return best.withColumns(
        {
            "family": F.when(flat, "independence").otherwise(F.col("family")),
            "rotation": F.when(flat, 0).otherwise(F.col("rotation")),
            "theta": F.when(flat, 0.0).otherwise(F.col("theta")),
        }
    )


def independence_test(edges: DataFrame, minimum: Column | float | None = None) -> DataFrame:
    """|τ| up to the bound becomes independence; default bound from the number of rows."""
    bound = tau_min(F.col("n")) if minimum is None else minimum
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    weak = ~(F.abs("tau") > bound)
    values = {"family": F.lit("independence"), "rotation": F.lit(0), "theta": F.lit(0.0), "loglik": F.lit(0.0)}
    if "thetas" in edges.columns:
        values |= {"seasonal": F.lit(False), "thetas": F.lit(None).cast("array<double>")}
    return edges.withColumns(
        {c: F.when(weak, x).otherwise(F.col(c)) if c in edges.columns else F.when(weak, x) for c, x in values.items()}
    )


def lagged_pair_fits(ranks: DataFrame, k: int = 1, families=None, **options) -> DataFrame:
    """Best family for every ordered variable pair, v taken k steps later."""
    from meteospan.operators.pairs import _lagged

    pairs = _lagged(ranks.withColumnRenamed("u", "value"), [k], "variable").select(
        *[c for c in ("station",) if c in ranks.columns],
        F.col("variable_i").alias("var_u"), F.col("variable_j").alias("var_v"),
        F.col("x").alias("u"), F.col("y").alias("v"),
    )
    return select_copula(pairs, families=families, **options)


DAYS = 366


def window_table(w: int) -> np.ndarray:
    """Row d − 1 marks the days of year that the window of day d holds (see ``doy_targets``)."""
    d, x = np.arange(1, DAYS + 1)[:, None], np.arange(1, DAYS + 1)[None, :]
    early = (d < w) & (x > DAYS - 1 - w + d)
    late = (d + w > DAYS - 1) & (x < d + w - (DAYS - 1))
    return ((x > d - w) & (x <= d + w)) | early | late


def _even_scale(name: str):
    """(scale, back): the grid of a year is even in θ, in log θ where the lower bound is positive, and in
    asinh(θ / s) where it is positive but so small that most of a log grid would lie next to it."""
    f = FAMILIES[name]
    if f.lo <= 0:
        return lambda x: x, lambda x: x
    if f.lo >= 1e-6:
        return np.log, np.exp
    s = f.hi * 1e-4
    return lambda x: np.arcsinh(x / s), lambda x: s * np.sinh(x)


def _year_grid(name: str, grid: int) -> np.ndarray:
    f, (scale, back) = FAMILIES[name], _even_scale(name)
    return back(np.linspace(scale(f.lo), scale(f.hi), grid)).clip(f.lo, f.hi)


def _daily_curves(packed: DataFrame, keys, chosen, grid: int, masked: bool) -> DataFrame:
    """(keys, _x, m, lls): log densities of each member on its grid, summed for each day of year.

    A row is an array of sums; the blocks of a large day are added as arrays."""
    start = np.stack([_year_grid(name, grid) for name, _ in chosen])

    def evaluate(batches):
        for frame in batches:
            u, v, w, wet = (np.concatenate([np.asarray(x) for x in frame[c]] or [np.zeros(0)]) for c in ("u", "v", "w", "wet"))
            row = np.repeat(np.arange(len(frame)), [len(x) for x in frame["u"]])
            if masked:
                row, u, v, w = (x[wet.astype(bool)] for x in (row, u, v, w))
            for m, (name, rotation) in enumerate(chosen):
                sums = np.zeros((len(frame), grid))
                for at in range(0, len(u), PACK):
                    part = slice(at, at + PACK)
                    a, b = turned(u[part], v[part], rotation)
                    with np.errstate(all="ignore"):
                        d = FAMILIES[name].density(a[:, None], b[:, None], start[m][None, :])
                        d = np.log(np.where((d > 0) & np.isfinite(d), d, FIT_FLOOR)) * w[part, None]
                    begin = np.flatnonzero(np.diff(row[part], prepend=-1))
                    sums[row[part][begin]] += np.add.reduceat(d, begin, axis=0)
                out = frame[[*keys, "_x"]].copy()
                out["m"], out["lls"] = m, list(sums)
                yield out

    fields = [f for f in packed.schema.fields if f.name in (*keys, "_x")]
    schema = T.StructType([*fields, T.StructField("m", T.IntegerType()), T.StructField("lls", T.ArrayType(T.DoubleType()))])
    parts = packed.select(*keys, "_x", "u", "v", "w", "wet").mapInPandas(evaluate, schema)
    total = F.array(*[F.sum(F.get("lls", F.lit(i))) for i in range(grid)])
    return parts.groupBy(*keys, "_x", "m").agg(total.alias("lls"))


def _around_the_year(chosen, keys, grid: int, w: int, masked: bool):
    """θ of every day from the sums over its window; one call holds a member of a group, 366 arrays at most."""
    holds = window_table(w)

    def fit(frame):
        m = int(frame["m"].iloc[0])
        name, rotation = chosen[m]
        f, theta = FAMILIES[name], _year_grid(name, grid)
        day = frame["_x"].to_numpy() - 1
        order = np.argsort(day)
        day, frame = day[order], frame.iloc[order]
        inside = holds[np.ix_(day, day)]
        sums = inside.astype(float) @ np.stack(frame["lls"].to_list())
        out = frame[list(keys)].copy()
        if masked:
            rows, dry = (inside @ frame[c].to_numpy(float) for c in ("rows", "n_dry"))
            top = lambda c: np.where(inside, frame[c].to_numpy(float, na_value=-np.inf)[None, :], -np.inf).max(1)
            u_max, v_max = top("u_max"), top("v_max")
            right = u_max > v_max
            corner = rotate(lambda p, q: f.cdf(p, q, theta[None, :]), rotation)
            with np.errstate(all="ignore"):
                share = corner(np.where(right, ONEISH, u_max)[:, None], np.where(right, v_max, ONEISH)[:, None])
                sums = sums + np.where(dry > 0, dry, 0.0)[:, None] * np.where(dry[:, None] > 0, np.log(np.maximum(share, 1e-300)), 0.0)
        best = np.argmax(sums, axis=1)
        around = np.clip(best, 1, grid - 2)
        each = np.arange(len(day))
        low, mid, high = (sums[each, around + i] for i in (-1, 0, 1))
        bend = low - 2.0 * mid + high
        with np.errstate(all="ignore"):
            vertex = 0.5 * (low - high) / bend
        shift = np.where((bend < 0) & (np.abs(vertex) <= 1.0), vertex, best - around)
        scale, back = _even_scale(name)
        step = (scale(f.hi) - scale(f.lo)) / (grid - 1)
        found = np.clip(back(scale(f.lo) + step * (around + shift)), f.lo, f.hi)
        near = lambda bound: np.abs(found - bound) <= 1e-8 + 1e-5 * abs(bound)
        bad = near(f.lo) | near(f.hi)
        if masked:
            bad |= 1.0 - dry / rows < 0.05
        out["family"], out["rotation"], out["doy"] = name, rotation, day + 1
        out["theta"] = np.where(bad, np.nan, found)
        out["rejected"] = bool(bad.mean() > 0.5)
        return out

    return fit


def fit_seasonal_copula(
    pairs: DataFrame,
    families=None,
    w: int = 15,
    keys: Sequence[str] | None = None,
    wet_col: str | None = None,
    grid: int = 64,
) -> DataFrame:
    """θ per day of year from the window around it.

    All days share one θ grid. The log densities of a day are one array of sums for each member, so what is shuffled
    has a row for each group, day and member. A member's year then meets in one task, where every window is a sum over its
    days; the vertex of the parabola through the best three grid points refines θ. A window with less than
    5 % wet rows, and a θ at a bound, gives null; ``rejected`` marks a member with more than half of its days null.
    Returns (keys, family, rotation, doy, theta, rejected).
    """
    keys = pair_keys(pairs) if keys is None else list(keys)
    chosen = [m for m in members(families) if m[0] != "independence"]
    packed = _packed(pairs.withColumn("_x", F.dayofyear("time")), [*keys, "_x"], wet_col)
    curves = _daily_curves(packed, keys, chosen, grid, wet_col is not None)
    if wet_col is not None:
        dry = packed.groupBy(*keys, "_x").agg(
            F.max("n_all").alias("rows"), F.max("n_dry").alias("n_dry"), F.max("u_max").alias("u_max"), F.max("v_max").alias("v_max")
        )
        curves = curves.join(dry, [*keys, "_x"])
    fields = [f for f in packed.schema.fields if f.name in keys]
    schema = T.StructType(
        [*fields, T.StructField("family", T.StringType()), T.StructField("rotation", T.IntegerType()), T.StructField("doy", T.IntegerType()),
         T.StructField("theta", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    found = curves.groupBy(*keys, "m").applyInPandas(_around_the_year(chosen, keys, grid, w, wet_col is not None), schema)
    # at most 366 rows per member, and every later step reads them more than once
    return cut_lineage(found.withColumn("theta", F.nanvl("theta", F.lit(None).cast("double"))))


def smooth_doy(fits_doy: DataFrame, order: int = 4, keys: Sequence[str] | None = None) -> DataFrame:
    """Fill null θ linearly around the year, keep harmonics 0…order, clip to the bounds; rejected members are left out.

    The days of a member (366 rows at most) are the circle: half of them are put before the first and after the last
    for filling, and their places give the angles of the harmonics.
    """
    keys = pair_keys(fits_doy) if keys is None else list(keys)
    kept = fits_doy.filter(~F.col("rejected")).drop("rejected") if "rejected" in fits_doy.columns else fits_doy

    def smooth(frame):
        frame = frame.sort_values("doy")
        f, theta = FAMILIES[frame["family"].iloc[0]], frame["theta"].to_numpy(float)
        n, known = len(theta), np.flatnonzero(np.isfinite(theta))
        if not len(known):
            return frame.assign(theta=np.nan)
        ring = np.concatenate([known - n, known, known + n])
        filled = np.interp(np.arange(n), ring, np.tile(theta[known], 3))
        # harmonics 0…order of the real series; one at half the number of days counts once
        spectrum = np.fft.rfft(filled)
        spectrum[order + 1 :] = 0.0
        return frame.assign(theta=np.clip(np.fft.irfft(spectrum, n), f.lo, f.hi))

    done = kept.groupBy(*keys, "family", "rotation").applyInPandas(smooth, kept.schema)
    return done.withColumn("theta", F.nanvl("theta", F.lit(None).cast("double")))


def used_members(fits: DataFrame) -> list[tuple[str, int]]:
    """Families and rotations that occur in a table of fits (at most 36)."""
    return sorted((r[0], r[1]) for r in fits.select("family", "rotation").distinct().collect())


def every_day(fits_doy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, family, rotation, thetas): θ of the days 1…366 as an array; a day that was never fitted takes the nearest fitted day."""
    member = [*keys, "family", "rotation"]
    days = fits_doy.groupBy(*member).agg(F.collect_list(F.struct("doy", "theta")).alias("_d"))
    nearest = lambda day: F.array_min(
        F.transform("_d", lambda d: F.struct(F.abs(d["doy"] - day).alias("gap"), d["doy"].alias("at"), d["theta"].alias("theta")))
    )["theta"]
    return days.select(*member, F.transform(F.sequence(F.lit(1), F.lit(DAYS)), nearest).alias("thetas"))


def _with_theta(pairs: DataFrame, fits_doy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """θ of the day for every member of the group, or for the member that the row names."""
    on = [*keys, *[c for c in ("family", "rotation") if c in pairs.columns]]
    joined = pairs.join(every_day(fits_doy, keys), on) if on else pairs.crossJoin(every_day(fits_doy, keys))
    rows = joined.withColumn("doy", F.dayofyear("time"))
    return rows.withColumn("theta", F.get("thetas", F.col("doy") - 1)).drop("thetas")


def _by_member(df: DataFrame, out: dict) -> DataFrame:
    """Columns computed on Arrow batches: ``name: function(family, rotation, rows)`` gives an array for the rows of one member."""

    def evaluate(batches):
        for frame in batches:
            values = {c: np.full(len(frame), np.nan) for c in out}
            for (name, rotation), at in frame.groupby(["family", "rotation"]).indices.items():
                rows = {c: frame[c].to_numpy(float, na_value=np.nan)[at] for c in ("u", "v", "q_u", "q_v", "theta") if c in frame}
                for c, function in out.items():
                    values[c][at] = function(name, int(rotation), rows)
            yield frame.assign(**values)

    schema = T.StructType([*[f for f in df.schema.fields if f.name not in out], *[T.StructField(c, T.DoubleType()) for c in out]])
    done = df.drop(*out).mapInPandas(evaluate, schema)
    return done.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in out})


def _density_array(name: str, rotation: int, x: dict) -> np.ndarray:
    a, b = turned(clamp(x["u"]), clamp(x["v"]), rotation)
    with np.errstate(all="ignore"):
        return FAMILIES[name].density(a, b, x["theta"])


def seasonal_density(pairs: DataFrame, fits_doy: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Density of every pair under every seasonal member of its group."""
    keys = pair_keys(pairs) if keys is None else list(keys)
    rows = _with_theta(pairs.filter(finite("u") & finite("v")), fits_doy, keys)
    return _by_member(rows, {"density": _density_array})


def _corner(u, v, a1: float, a2: float, lower: float = 0.25, upper: float = 0.75):
    """Where the corners lie that carry the asymmetries a1 and a2."""
    return (
        ((a1 > 0) & (u > upper) & (v > upper)) | ((a1 < 0) & (u < lower) & (v < lower))
        | ((a2 > 0) & (u > upper) & (v < lower)) | ((a2 < 0) & (u < lower) & (v > upper))
    )


def seasonal_loglik(
    pairs: DataFrame, fits_doy: DataFrame, keys: Sequence[str] | None = None, asymmetry: bool = False
) -> DataFrame:
    """Log-likelihood of every seasonal member of a group, (keys, family, rotation, loglik, n).

    Pairs are packed by day of year; a block meets the θ of its day for all members at once, so no pair is copied.
    With ``asymmetry`` the density counts only in the corners that carry the asymmetry of the group.
    """
    keys = pair_keys(pairs) if keys is None else list(keys)
    used = pairs.filter(finite("u") & finite("v"))
    packed = _packed(used.withColumn("_x", F.dayofyear("time")), [*keys, "_x"], None).select(*keys, "_x", "u", "v", "w")
    if asymmetry:
        sums = used.groupBy(*keys).agg(asymmetry_means(F.col("u"), F.col("v"))[0].alias("_a1"), asymmetry_means(F.col("u"), F.col("v"))[1].alias("_a2"))
        packed = _attach_by(packed, sums, keys)
    else:
        packed = packed.withColumns({"_a1": F.lit(0.0), "_a2": F.lit(0.0)})
    thetas = every_day(fits_doy, keys).select(*keys, "family", "rotation", F.posexplode("thetas").alias("_x", "theta"))
    by_day = thetas.withColumn("_x", F.col("_x") + 1).groupBy(*keys, "_x").agg(*[F.collect_list(c).alias(c) for c in ("family", "rotation", "theta")])

    def evaluate(batches):
        for frame in batches:
            out = {c: [] for c in (*keys, "family", "rotation", "loglik", "n")}
            for row in frame.to_dict("records"):
                u, v, w = (np.asarray(row[c], float) for c in ("u", "v", "w"))
                for name, rotation, theta in zip(row["family"], row["rotation"], row["theta"]):
                    d = _density_array(name, int(rotation), {"u": u, "v": v, "theta": theta})
                    if asymmetry:
                        d = np.where(_corner(u, v, row["_a1"], row["_a2"]), d, 0.0)
                    d = np.where((d > 0) & np.isfinite(d), d, SEASONAL_FLOOR)
                    for c, x in zip(out, (*[row[k] for k in keys], name, int(rotation), float(w @ np.log(d)), int(w.sum()))):
                        out[c].append(x)
            yield pd.DataFrame(out)

    fields = [f for f in packed.schema.fields if f.name in keys]
    schema = T.StructType(
        [*fields, T.StructField("family", T.StringType()), T.StructField("rotation", T.IntegerType()), T.StructField("loglik", T.DoubleType()), T.StructField("n", T.LongType())]
    )
    parts = packed.join(by_day, [*keys, "_x"]).mapInPandas(evaluate, schema)
    return parts.groupBy(*keys, "family", "rotation").agg(F.sum("loglik").alias("loglik"), F.sum("n").alias("n"))


def seasonal_quantiles(pairs: DataFrame, fits_doy: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """q_u = u and q_v = h(v | u; θ of the day)."""
    keys = pair_keys(pairs) if keys is None else list(keys)
    rows = _with_theta(pairs, fits_doy, keys)
    found = _by_member(rows, {"q_v": lambda n, r, x: h_array(n, x["u"], x["v"], x["theta"], r)})
    return found.withColumn("q_u", F.col("u"))


def seasonal_inverse(uniforms: DataFrame, fits_doy: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """v = h⁻¹(q_v | u = q_u; θ of the day) for a given table of quantiles; with the columns family and
    rotation in the table each row goes back through its own member, else through every member of its group."""
    keys = pair_keys(uniforms) if keys is None else list(keys)
    rows = _with_theta(uniforms, fits_doy, keys)
    found = _by_member(rows, {"v": lambda n, r, x: h_inverse_array(n, x["q_u"], x["q_v"], x["theta"], r)})
    return found.withColumn("u", F.col("q_u"))


def asymmetry_weighted_density(
    rows: DataFrame, keys: Sequence[str] | None = None, lower: float = 0.25, upper: float = 0.75
) -> DataFrame:
    """Keep ``density`` only in the corners that carry the asymmetry of (u, v), else 0."""
    keys = pair_keys(rows) if keys is None else list(keys)
    a, b = asymmetry1(rows, keys), asymmetry2(rows, keys)
    if keys:
        joined = rows.join(a, keys).join(b, keys)
    else:
        joined = rows.withColumns({"asymmetry1": a.scalar(), "asymmetry2": b.scalar()})
    u, v, a1, a2 = F.col("u"), F.col("v"), F.col("asymmetry1"), F.col("asymmetry2")
    corner = _corner(u, v, a1, a2, lower, upper)
    return joined.withColumn("density", F.when(corner, F.col("density")).otherwise(0.0)).drop(
        "asymmetry1", "asymmetry2"
    )


def copula_qq(
    pairs: DataFrame, fits: DataFrame, keys: Sequence[str] | None = None, used=None
) -> DataFrame:
    """Empirical copula, fitted copula and their difference at every pair."""
    keys = pair_keys(pairs) if keys is None else list(keys)
    used = used_members(fits) if used is None else used
    rows = bipit(pairs.filter(finite("u") & finite("v")), keys).withColumnRenamed("bipit", "empirical")
    joined = rows.join(fits.select(*keys, "family", "rotation", "theta"), keys)
    u, v, theta = F.col("u"), F.col("v"), F.col("theta")
    theory = by_family(lambda n, r: copula_cdf(n, u, v, theta, r), used)
    return joined.withColumn("theoretical", theory).withColumn(
        "difference", F.col("theoretical") - F.col("empirical")
    )
