"""Pair-copula (vine) decomposition.

While a vine is fitted, state is one row per observation time with a map from "variable|given" to its
conditional rank, so going into the next tree is a narrow projection; only likelihoods and rank
correlations are shuffled. Trees are tables of edges that name the conditioned pair and the conditioning
set; a group (all stations pooled, or one station) has at most d² edges, so per-group edge lists are
small by definition. An edge may have a θ for each day of year (``thetas``, 366 entries).

A finished vine is a program: ``vine_quantiles`` and ``vine_inverse`` deal the long table out by series
and year once, and run all edges on the arrays of a block (``_replay_block``, ``_invert_block``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meteospan.functions.copula import h_array, h_inverse_array, h_u_given_v, h_v_given_u
from meteospan.functions.normal import with_norm_ppf
from meteospan.operators.fit import independence_test, select_copula, used_members
from meteospan.operators.ordering import with_halo, with_position
from meteospan.operators.pairs import kendall_tau, nan_corr, tau_min
from meteospan.operators.ranks import rel_ranks
from meteospan.session import cut_lineage

EDGE_COLUMNS = ["node_u", "node_v", "cond"]
TINY = 1e-15


def label(node: Column, cond: Column) -> Column:
    """Name of a conditional rank: "x|a,b", "x|" without a condition."""
    return F.concat(node, F.lit("|"), F.array_join(F.sort_array(cond), ","))


def vine_rows(ranks: DataFrame, variables: Sequence[str], column: str = "u", lag: int = 0) -> DataFrame:
    """One row per time with all variables in the map ``us``; incomplete rows are dropped. With ``lag`` the map
    ``later`` holds the ranks so many steps on in the same series, and the last rows of a series fall away."""
    rest = [c for c in ranks.columns if c not in ("variable", column)]
    chosen = ranks.filter(F.col("variable").isin(list(variables)) & F.col(column).isNotNull())
    entry = F.struct(F.concat("variable", F.lit("|")).alias("k"), F.col(column).alias("u"))
    rows = chosen.groupBy(*rest).agg(F.map_from_entries(F.collect_list(entry)).alias("us"))
    rows = rows.filter(F.size("us") == len(variables))
    if not lag:
        return rows
    keys = [c for c in rest if c != "time"]
    ahead = {"later": lambda w: F.lead("us", lag).over(w)}
    return with_halo(with_position(rows, keys), keys, 0, lag, ahead).filter("later IS NOT NULL").drop("pos", "pos_total")


def _end(rows: DataFrame, node: Column, other: Column, cond: Column) -> Column:
    """Rank at an end of an edge: in a lagged first tree the end whose name comes last stands ``lag`` steps later."""
    now = F.element_at("us", label(node, cond))
    if "later" not in rows.columns:
        return now
    return F.when((F.size(cond) == 0) & (node > other), F.element_at("later", label(node, cond))).otherwise(now)


def _edge_pairs(rows: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows × edges of their group: (by, edge, u, v, other columns of rows)."""
    packed = edges.groupBy(*by).agg(F.collect_list(F.struct(*EDGE_COLUMNS)).alias("_edges"))
    joined = _bring(rows, packed, by, "_edges")
    rest = [c for c in rows.columns if c not in ("us", "later")]
    maps = [c for c in rows.columns if c not in rest]
    out = joined.select(*rest, *maps, F.inline("_edges"))
    at = lambda node, other: _end(rows, F.col(node), F.col(other), F.col("cond"))
    return out.select(*rest, *EDGE_COLUMNS, at("node_u", "node_v").alias("u"), at("node_v", "node_u").alias("v"))


def _bring(rows: DataFrame, packed: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    if by:
        return rows.join(packed, list(by))
    return rows.withColumn(column, packed.select(column).scalar())


def _first_edges(rows: DataFrame, variables: Sequence[str], by: Sequence[str]) -> DataFrame:
    names = sorted(variables)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    entries = F.array(*[F.struct(F.lit(a).alias("node_u"), F.lit(b).alias("node_v")) for a, b in pairs])
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    empty = F.array().cast("array<string>")
    return groups.select(*by, F.inline(entries)).withColumn("cond", empty)


def _weighted(rows, edges, by, weights, families, options) -> DataFrame:
    """τ (and fit) of every candidate edge, weight 1 − |τ| or −log-likelihood."""
    keys = [*by, *EDGE_COLUMNS]
    pairs = _edge_pairs(rows, edges, by)
    tau = kendall_tau(pairs, keys)
    if weights == "tau":
        return tau.withColumn("weight", 1.0 - F.abs("tau"))
    best = select_copula(pairs, keys, families, **options)
    return tau.join(best.select(*keys, "loglik"), keys).withColumn(
        "weight", -F.col("loglik")
    ).drop("loglik")


def pair_edges(
    ranks: DataFrame, variables: Sequence[str], weights: str = "tau", by: Sequence[str] = (),
    families=None, lag: int = 0, **options,
) -> DataFrame:
    """Complete graph of the variables with τ and weight per edge. With ``lag`` the first variable of an edge
    (by name) stands against the second one so many steps later, so ``n`` is the length less the lag."""
    rows = vine_rows(ranks, variables, lag=lag)
    edges = _first_edges(rows, variables, by)
    return _weighted(rows, edges, list(by), weights, families, options)


def cvine_root(edges: DataFrame, by: Sequence[str] = (), central: str | None = None) -> DataFrame:
    """Node with the smallest sum of weights (its own entry counts 1) per group."""
    if central is not None:
        return edges.select(*by).distinct().withColumn("root", F.lit(central)) if by else (
            edges.limit(1).select(F.lit(central).alias("root"))
        )
    ends = F.array(F.col("node_u"), F.col("node_v"))
    sums = (
        edges.select(*by, "weight", F.explode(ends).alias("node"))
        .groupBy(*by, "node")
        .agg((F.sum("weight") + 1.0).alias("s"))
    )
    return sums.groupBy(*by).agg(F.min_by("node", F.struct("s", "node")).alias("root"))


def _star(edges: DataFrame, by: Sequence[str], central: str | None) -> DataFrame:
    """Edges at the root, which becomes node_u."""
    root = cvine_root(edges, by, central)
    joined = _bring(edges, root, by, "root")
    touch = joined.filter((F.col("node_u") == F.col("root")) | (F.col("node_v") == F.col("root")))
    other = F.when(F.col("node_u") == F.col("root"), F.col("node_v")).otherwise(F.col("node_u"))
    return touch.withColumns({"node_v": other, "node_u": F.col("root")}).drop("root")


def rvine_tree(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minimum spanning tree of every group: its sorted edges are folded, an edge is taken
    when its ends have different component names."""
    left = F.array_join(F.sort_array(F.array_append("cond", F.col("node_u"))), ",")
    right = F.array_join(F.sort_array(F.array_append("cond", F.col("node_v"))), ",")
    carried = [c for c in edges.columns if c not in by]
    entry = F.struct(
        F.col("weight").alias("w"), left.alias("a"), right.alias("b"), F.struct(*carried).alias("e")
    )
    listed = edges.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    nodes = F.array_distinct(F.flatten(F.transform("_all", lambda e: F.array(e["a"], e["b"]))))
    names = F.map_from_arrays(nodes, nodes)
    listed = listed.withColumns({"_names": names, "_none": F.filter("_all", lambda e: F.lit(False))})
    start = F.struct(F.col("_names").alias("names"), F.col("_none").alias("picked"))

    def fold(state, e):
        old, new = F.element_at(state["names"], e["b"]), F.element_at(state["names"], e["a"])
        merged = F.transform_values(state["names"], lambda _, v: F.when(v == old, new).otherwise(v))
        return F.when(
            old != new,
            F.struct(
                merged.alias("names"), F.concat(state["picked"], F.array(e)).alias("picked")
            ),
        ).otherwise(state)

    tree = listed.select(*by, F.aggregate("_all", start, fold, lambda s: s["picked"]).alias("_t"))
    return tree.select(*by, F.explode("_t").alias("_t")).select(*by, "_t.e.*")


def next_tree_edges(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of edges that share exactly one node become the candidates of the next tree."""
    ends = F.array(
        *[F.sort_array(F.array_append("cond", F.col(n))) for n in ("node_u", "node_v")]
    )
    partner = F.array(F.col("node_v"), F.col("node_u"))
    spread = edges.select(*by, F.explode(F.arrays_zip(ends.alias("s"), partner.alias("x"))).alias("_z")).select(
        *by, F.col("_z.s").alias("cond"), F.col("_z.x").alias("x")
    )
    # a shared node gathers the edges at it, fewer than there are variables
    met = spread.groupBy(*by, "cond").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return (
        met.withColumn("node_u", F.explode("xs"))
        .withColumn("node_v", F.explode("xs"))
        .filter(F.col("node_u") < F.col("node_v"))
        .select(*by, *EDGE_COLUMNS)
    )


def pseudo_observations(
    rows: DataFrame, edges: DataFrame, by: Sequence[str] = (), used=None
) -> DataFrame:
    """Add u given v and v given u of every edge to the map, one projection per tree."""
    used = used_members(edges) if used is None else used
    entry = F.struct(*EDGE_COLUMNS, "family", "rotation", "theta", *[c for c in ("thetas",) if c in edges.columns])
    packed = edges.groupBy(*by).agg(F.collect_list(entry).alias("_edges"))
    joined = _bring(rows, packed, by, "_edges")
    at_day = lambda e: F.coalesce(F.get(e["thetas"], F.dayofyear("time") - 1), e["theta"]) if "thetas" in edges.columns else e["theta"]

    def conditional(e):
        at = lambda node, other: _end(rows, e[node], e[other], e["cond"])

        def build(which):
            out = None
            for name, r in used:
                test = (e["family"] == name) & (e["rotation"] == r)
                value = which(name, at("node_u", "node_v"), at("node_v", "node_u"), at_day(e), r)
                out = F.when(test, value) if out is None else out.when(test, value)
            return out

        # kept off 0 and 1 so that the next tree can use it
        safe = lambda x: F.greatest(F.lit(TINY), F.least(F.lit(1.0 - TINY), x))
        u_name = label(e["node_u"], F.array_append(e["cond"], e["node_v"]))
        v_name = label(e["node_v"], F.array_append(e["cond"], e["node_u"]))
        return F.array(
            F.struct(u_name.alias("k"), safe(build(h_u_given_v)).alias("u")),
            F.struct(v_name.alias("k"), safe(build(h_v_given_u)).alias("u")),
        )

    new = F.map_from_entries(F.flatten(F.transform("_edges", conditional)))
    return joined.withColumn("us", F.map_concat("us", new)).select(*rows.columns)


def fit_vine(
    ranks: DataFrame,
    variables: Sequence[str],
    kind: str = "C",
    by: str | None = None,
    central: str | None = None,
    minimum: float | None = 0.0,
    wet_col: str | None = None,
    rain: str = "R",
    weights: str = "tau",
    families=None,
    seasonal: bool = False,
    lag: int = 0,
    **options,
) -> DataFrame:
    """Fit a C- or R-vine, pooled or one per ``by``; returns the table of edges.

    The wet mask applies in the first tree to pairs with rain only, later to all pairs.
    ``minimum`` is the |τ| up to which a pair counts as independent (None: 5 % bound). With ``seasonal`` every edge may take a
    θ for each day of year (``thetas``) where that is likelier. ``lag`` sets the first tree between the variables of one
    time and those so many steps later (see ``pair_edges``).
    """
    group = [by] if by else []
    keys = [*group, *EDGE_COLUMNS]
    options = {**options, "seasonal": seasonal}
    rows = cut_lineage(vine_rows(ranks, variables, lag=lag))
    candidates = _first_edges(rows, variables, group)
    trees = []
    for level in range(len(variables) - 1):
        weighted = cut_lineage(_weighted(rows, candidates, group, weights, families, options))
        if kind == "C":
            chosen = _star(weighted, group, central if level == 0 else None)
        else:
            chosen = rvine_tree(weighted, group)
        pairs = _edge_pairs(rows, chosen.select(*keys), group)
        mask = None
        if wet_col is not None:
            mask = "_mask"
            with_rain = (F.col("node_u") == rain) | (F.col("node_v") == rain)
            dry_counts = F.lit(True) if level else with_rain
            pairs = pairs.withColumn(mask, F.when(dry_counts, F.col(wet_col)).otherwise(True))
        best = select_copula(pairs, keys, families, wet_col=mask, **options).drop("n")
        bound = tau_min(F.col("n")) if minimum is None else minimum
        fitted = independence_test(chosen.drop("weight").join(best, keys), bound)
        fitted = cut_lineage(fitted.withColumn("tree", F.lit(level)))
        trees.append(fitted)
        if level < len(variables) - 2:
            rows = cut_lineage(pseudo_observations(rows, fitted, group))
            candidates = next_tree_edges(fitted, group)
    out = trees[0]
    for tree in trees[1:]:
        out = out.unionByName(tree)
    year = ["seasonal", "thetas"] if seasonal else []
    return out.select(*group, "tree", *EDGE_COLUMNS, "tau", "family", "rotation", "theta", "loglik", "n", *year)


def vine_order(vine_edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Natural order: every variable is joined to the earlier ones by one edge per tree.

    Read from the last tree: a variable of its edge goes last and is taken out; the deepest
    edge among the remaining variables names the next one. C-vines get their roots in order.
    """
    entry = F.struct(
        (-F.col("tree")).alias("depth"), "node_u", "node_v",
        F.array_union(F.array("node_u", "node_v"), "cond").alias("full"),
    )
    listed = vine_edges.groupBy(*by).agg(
        F.sort_array(F.collect_list(entry)).alias("_edges"), F.max("tree").alias("_depth")
    )
    names = F.array_distinct(F.flatten(F.transform("_edges", lambda e: e["full"])))
    listed = listed.withColumns({"_left": names, "_order": F.filter(names, lambda x: F.lit(False))})
    start = F.struct(F.col("_left").alias("left"), F.col("_order").alias("order"))

    def fold(state, e):
        whole = (F.size(e["full"]) == F.size(state["left"])) & (
            F.size(F.array_except(e["full"], state["left"])) == 0
        )
        last = e["node_v"]
        return F.when(
            whole,
            F.struct(
                F.array_remove(state["left"], last).alias("left"),
                F.concat(F.array(last), state["order"]).alias("order"),
            ),
        ).otherwise(state)

    final = F.aggregate(
        "_edges", start, fold, lambda s: F.concat(s["left"], s["order"])
    )
    return listed.select(*by, F.posexplode(final).alias("pos", "variable"))


def _order_list(vine: DataFrame, by: Sequence[str]) -> DataFrame:
    order = vine_order(vine, by)
    return order.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "variable"))), lambda e: e["variable"]).alias("_names")
    )


def _name(node: str, cond) -> str:
    return f"{node}|{','.join(sorted(cond))}"


def _keep(x):
    return np.clip(x, TINY, 1.0 - TINY)


def _thetas_of(edge: dict, doy):
    """θ of an edge: one number, or that of each row's day of year."""
    if edge.get("thetas") is None:
        return edge["theta"]
    return np.asarray(edge["thetas"], float)[doy - 1]


def _replay_block(us: dict, edges: list[dict], doy) -> dict:
    """Conditional ranks of all edges, tree by tree, from the ranks ``us`` of the variables."""
    us = {_name(x, ()): u for x, u in us.items()}
    for e in sorted(edges, key=lambda e: e["tree"]):
        u, v = us[_name(e["node_u"], e["cond"])], us[_name(e["node_v"], e["cond"])]
        at = (u, v, _thetas_of(e, doy), int(e["rotation"]))
        us[_name(e["node_u"], [*e["cond"], e["node_v"]])] = _keep(h_array(e["family"], *at, given="v"))
        us[_name(e["node_v"], [*e["cond"], e["node_u"]])] = _keep(h_array(e["family"], *at))
    return us


def _invert_block(q: dict, names: list[str], edges: list[dict], doy, stop: int) -> dict:
    """Ranks from uniforms: the k-th variable is taken back through its edges from the deepest tree up."""
    ranks = {names[0]: q[names[0]]}
    us = {_name(names[0], ()): q[names[0]]}
    for k in range(1, stop):
        x, now, before = names[k], q[names[k]], set(names[:k])
        for level in range(k - 1, -1, -1):
            # the edge of this tree that joins the k-th variable to earlier ones only
            (e,) = (
                e for e in edges
                if e["tree"] == level and x in (e["node_u"], e["node_v"]) and {e["node_u"], e["node_v"], *e["cond"]} - {x} <= before
            )
            first = e["node_u"] == x
            y = e["node_v"] if first else e["node_u"]
            other, theta, turn = us[_name(y, e["cond"])], _thetas_of(e, doy), int(e["rotation"])
            us[_name(x, [*e["cond"], y])] = now
            now = _keep(h_inverse_array(e["family"], other, now, theta, turn, "v" if first else "u"))
            # what later variables need: the partner given x
            pair, given = ((now, other), "u") if first else ((other, now), "v")
            us[_name(y, [*e["cond"], x])] = _keep(h_array(e["family"], *pair, theta, turn, given=given))
        us[_name(x, ())] = ranks[x] = now
    return ranks


def _by_blocks(long: DataFrame, column: str, vine: DataFrame, by: Sequence[str], out: list[tuple[str, T.DataType]], run) -> DataFrame:
    """``run(values by variable, names, edges, doy)`` on blocks of one series and year (or a hash of the row without a time).

    The long table is shuffled once; a block carries the edges of its group, whose table has a row for each group.
    """
    rest = [c for c in long.columns if c not in ("variable", column)]
    timed = "time" in rest
    outer = [c for c in rest if c != "time"] if timed else []
    inner = ["time"] if timed else rest
    block = F.year("time") if timed else F.pmod(F.xxhash64(*rest), F.lit(4096)) if rest else F.lit(0)
    outer += [] if timed else list(by)
    inner = [c for c in inner if c not in outer]
    stamp = F.struct(*inner) if inner else F.struct(F.lit(0).alias("_none"))
    entry = F.struct("variable", F.col(column).alias("_value"))
    # one entry per row of the wide table, with the values of its variables; dealt out once, by what both groupings have
    dealt = long.filter(F.col(column).isNotNull()).withColumn("_block", block).repartition(*outer, "_block")
    wide = dealt.groupBy(*outer, "_block", *inner).agg(F.collect_list(entry).alias("_values"))
    doy = F.dayofyear("time") if timed else F.lit(1)
    item = F.struct(stamp.alias("stamp"), doy.alias("doy"), F.map_from_entries("_values").alias("values"))
    packed = wide.groupBy(*outer, "_block").agg(F.collect_list(item).alias("_rows"))
    parts = ["tree", *EDGE_COLUMNS, "family", "rotation", "theta", *[c for c in ("thetas",) if c in vine.columns]]
    edges = vine.groupBy(*by).agg(F.collect_list(F.struct(*parts)).alias("_edges"))
    packed = _bring(_bring(packed, edges, by, "_edges"), _order_list(vine, by), by, "_names")

    def evaluate(batches):
        for frame in batches:
            for row in frame.to_dict("records"):
                items, names = row["_rows"], list(row["_names"])
                table = [dict(x["values"]) for x in items]
                values = {x: np.array([t.get(x, np.nan) for t in table], float) for x in names}
                edges = [dict(e, cond=list(e["cond"])) for e in row["_edges"]]
                found = run(values, names, edges, np.array([x["doy"] for x in items]))
                for i, x in enumerate(names):
                    if x in found:
                        done = pd.DataFrame([dict(y["stamp"]) for y in items])[inner] if inner else pd.DataFrame(index=range(len(items)))
                        for c in outer:
                            done[c] = row[c]
                        done["variable"], done[out[-1][0]] = x, found[x]
                        if len(out) > 1:
                            done["pos"] = i
                        kept = done[np.isfinite(found[x])] if column == "u" else done
                        yield kept[[*outer, *inner, *([] if len(out) == 1 else ["pos"]), "variable", out[-1][0]]]

    fields = [long.schema[c] for c in [*outer, *inner]]
    more = [T.StructField(c, t) for c, t in out[:-1]]
    schema = T.StructType([*fields, *more, T.StructField("variable", T.StringType()), T.StructField(*out[-1])])
    done = packed.mapInPandas(evaluate, schema)
    value = out[-1][0]
    return done.withColumn(value, F.nanvl(value, F.lit(None).cast("double"))).select(*[c for c in rest], *[c for c, _ in out[:-1]], "variable", value)


def vine_quantiles(
    ranks: DataFrame, vine: DataFrame, variables: Sequence[str], by: str | None = None
) -> DataFrame:
    """Independent uniforms from ranks: every variable given all earlier ones (Rosenblatt).

    Works for C- and R-vines, with θ by day of year where an edge has ``thetas``; returns the long table with column
    ``q`` and ``pos``. Times with a missing variable are left out.
    """
    group = [by] if by else []

    def run(values, names, edges, doy):
        us = _replay_block(values, edges, doy)
        whole = np.all([np.isfinite(values[x]) for x in names], axis=0)
        return {x: np.where(whole, us[_name(x, names[:i])], np.nan) for i, x in enumerate(names)}

    chosen = ranks.filter(F.col("variable").isin(list(variables)))
    return _by_blocks(chosen, "u", vine, group, [("pos", T.IntegerType()), ("q", T.DoubleType())], run)


def vine_inverse(
    quantiles: DataFrame, vine: DataFrame, variables: Sequence[str], by: str | None = None, stop_at: int | None = None,
) -> DataFrame:
    """Ranks from a given table of independent uniforms ``q`` (inverse Rosenblatt).

    With ``stop_at`` variables from that position on stay null, and so does what lacks an earlier variable.
    """
    group = [by] if by else []
    given = quantiles.drop(*[c for c in ("pos", "u") if c in quantiles.columns])

    def run(values, names, edges, doy):
        ranks = _invert_block(values, names, edges, doy, len(names) if stop_at is None else min(stop_at, len(names)))
        return {x: ranks.get(x, np.full(len(doy), np.nan)) for x in names}

    return _by_blocks(given, "q", vine, group, [("u", T.DoubleType())], run)


def cvine_quantiles(ranks, vine, variables, by=None) -> DataFrame:
    return vine_quantiles(ranks, vine, variables, by)


def cvine_inverse(quantiles, vine, variables, by=None, stop_at=None) -> DataFrame:
    return vine_inverse(quantiles, vine, variables, by, stop_at)


def rvine_quantiles(ranks, vine, variables, by=None) -> DataFrame:
    return vine_quantiles(ranks, vine, variables, by)


def rvine_inverse(quantiles, vine, variables, by=None) -> DataFrame:
    return vine_inverse(quantiles, vine, variables, by)


def vine_report(vine_edges: DataFrame, tree: int | None = None, names: tuple[str, str] | None = None) -> DataFrame:
    """One line per edge; optionally one tree or the edge between two variables."""
    out = vine_edges
    if tree is not None:
        out = out.filter(F.col("tree") == tree)
    if names is not None:
        a, b = names
        out = out.filter(
            ((F.col("node_u") == a) & (F.col("node_v") == b))
            | ((F.col("node_u") == b) & (F.col("node_v") == a))
        )
    text = F.concat_ws(
        " ", F.concat(F.col("node_u"), F.lit("-"), F.col("node_v")),
        F.when(F.size("cond") > 0, F.concat(F.lit("; "), F.array_join("cond", ","))),
        F.concat(F.col("family"), F.when(F.col("rotation") > 0, F.concat(F.lit("_"), F.col("rotation"))).otherwise("")),
        F.concat(F.lit("tau="), F.format_number("tau", 3)),
    )
    return out.withColumn("line", text)


def vine_debias(
    ranks: DataFrame, vine: DataFrame, variables: Sequence[str], by: str | None = None
) -> DataFrame:
    """Shift per variable in normal space: score of the vine at constant 0.5 minus the mean
    score of the ranks. Returns (by, variable, shift)."""
    group = [by] if by else []
    chosen = ranks.filter(F.col("variable").isin(list(variables)))
    # without θ by day of year the vine at 0.5 is the same at all times
    times = chosen.drop("u") if "thetas" in vine.columns else chosen.select(*group, "variable").distinct()
    middle = vine_inverse(times.withColumn("q", F.lit(0.5)), vine, variables, by)
    at_half = with_norm_ppf(middle, "z_half", F.col("u")).groupBy(*group, "variable").agg(F.avg("z_half").alias("z_half"))
    scores = with_norm_ppf(ranks.filter(F.col("variable").isin(list(variables))), "z", F.col("u"))
    means = scores.groupBy(*group, "variable").agg(F.avg("z").alias("z_mean"))
    return at_half.join(means, [*group, "variable"]).select(
        *group, "variable", (F.col("z_half") - F.col("z_mean")).alias("shift")
    )


def independence_check(quantiles: DataFrame, by: str | None = None) -> DataFrame:
    """Kolmogorov–Smirnov distance from uniform and largest |correlation| per variable."""
    group = [by] if by else []
    ranked = rel_ranks(quantiles, "q", [*group, "variable"], "_r")
    sized = ranked.join(ranked.groupBy(*group, "variable").agg(F.count("q").alias("_n")), [*group, "variable"])
    half = 0.5 / F.col("_n")
    ks = sized.groupBy(*group, "variable").agg(F.max(F.abs(F.col("q") - F.col("_r")) + half).alias("ks"))
    rest = [c for c in quantiles.columns if c not in ("variable", "q", "pos")]
    sample = F.struct(*rest).alias("time")
    rows = quantiles.select(*[g for g in group], "variable", F.col("q").alias("value"), sample)
    corr = nan_corr(rows, ("variable",), group)
    ends = F.explode(F.array("variable_i", "variable_j"))
    largest = corr.select(*group, ends.alias("variable"), "corr").groupBy(*group, "variable").agg(
        F.max(F.abs("corr")).alias("max_abs_corr")
    )
    return ks.join(largest, [*group, "variable"], "left")
