"""Discordant pairs and dominated weights of a table of weighted cells, counted block by block.

Both axes are cut at approximate quantiles of the group; a value that equals a cut is a block of its own. Pairs of
cells in different blocks of both axes are counted from the table of block counts. Pairs in one block of
the first axis, and pairs in one block of the second but not of the first, are counted inside these blocks by a merge count. Cells of one
value never are discordant, so a block of a single value is only summed, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meteospan.schema import finite
from meteospan.session import cut_lineage

#: Cells of a block, and blocks of an axis at most.
CELLS = 1 << 16
BLOCKS = 512


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Σ w_i w_j over pairs with x_i < x_j and y_i > y_j, by one stable partition for each bit of the rank of y."""
    order = np.lexsort((y, x))
    _, rank = np.unique(y[order], return_inverse=True)
    w, total = w[order].astype(float), 0.0
    for bit in range(max(int(rank.max(initial=0)).bit_length() - 1, -1), -1, -1):
        high = (rank >> bit) & 1 == 1
        prefix = rank >> (bit + 1)
        start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        before = np.cumsum(np.where(high, w, 0.0))
        base = np.concatenate([[0.0], before])[start]
        before -= np.repeat(base, np.diff(np.append(start, len(rank))))
        total += float(w[~high] @ before[~high])
        at = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[at], w[at]
    return total


def _ties(values: np.ndarray, w: np.ndarray) -> float:
    """Σ t (t − 1) / 2 over the values, t being their weight."""
    _, at = np.unique(values, return_inverse=True)
    t = np.bincount(at, weights=w)
    return float((t * (t - 1) / 2).sum())


def dominated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Σ w_j over the cells with x_j < x_i and y_j < y_i, for each i."""
    _, rank = np.unique(y, return_inverse=True)
    at = np.lexsort((-rank, x))  # of equal x, none comes after one of smaller y
    rank, total = rank[at], np.zeros(len(x), np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        high = (rank >> bit) & 1 == 1
        prefix = rank >> (bit + 1)
        start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        before = np.concatenate([[0], np.cumsum(np.where(high, 0, w[at]))])
        inside = before[:-1] - np.repeat(before[start], np.diff(np.append(start, len(rank))))
        total[at[high]] += inside[high]
        order = np.argsort(rank >> bit, kind="stable")
        rank, at = rank[order], at[order]
    return total


def _block(column: Column, cuts: Column) -> Column:
    """Even numbers between two cuts, odd ones at a cut; ``cuts`` are searched by halves."""
    steps = F.array(*[F.lit(1 << i) for i in range((BLOCKS - 1).bit_length() - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(cuts, a + s - 1) < column, a + s).otherwise(a))
    return F.when(cuts.isNull(), 0).otherwise(F.transform(F.array(below), lambda n: 2 * n + F.when(F.get(cuts, n) == column, 1).otherwise(0))[0])


def placed_in_blocks(cells: DataFrame, keys: Sequence[str], u: str, v: str, weight: str) -> DataFrame:
    """``keys, x, y, w, bx, by``: the cells with their block on either axis. Cells that are not finite in both have ``by`` of -1 and a
    negative ``bx``, which spreads them. Written once.

    Only groups of more than ``CELLS`` cells have cuts, two for each ``CELLS`` cells at most, so the table of cuts is
    broadcast: (cells / CELLS) · 16 bytes and the keys.
    """
    keys = list(keys)
    x, y = F.col(u).cast("double"), F.col(v).cast("double")
    cells = cells.select(*keys, x.alias("x"), y.alias("y"), F.col(weight).cast("long").alias("w"))
    usable = finite("x") & finite("y")
    levels = [i / BLOCKS for i in range(1, BLOCKS)]
    quantiles = lambda c: F.percentile_approx(F.when(usable, F.col(c)), levels, 10_000).alias(f"_c{c}")
    # the weight is summed so that this reads the same shuffled cells as the rest does
    axes = cells.groupBy(*keys).agg(F.count("*").alias("_cells"), F.sum("w").alias("_n"), quantiles("x"), quantiles("y")).filter(F.col("_n") > 0)
    axes = axes.withColumn("_blocks", F.least(F.ceil(F.col("_cells") / CELLS), F.lit(BLOCKS)).cast("int")).filter("_blocks > 1")
    some = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_blocks") - 1), lambda i: F.get(c, F.floor(i * BLOCKS / F.col("_blocks")).cast("int") - 1))).alias(c)
    axes = axes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_blocks", some("_cx"), some("_cy"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    spread = F.pmod(F.xxhash64("x", "y"), F.coalesce("_blocks", F.lit(1))).cast("int")
    placed = cells.join(F.broadcast(axes), same, "left").select(
        *keys, "x", "y", "w",
        F.when(usable, _block(F.col("x"), F.col("_cx"))).otherwise(-1 - spread).alias("bx"),
        F.when(usable, _block(F.col("y"), F.col("_cy"))).otherwise(-1).alias("by"),
    )
    # read by several counts
    return cut_lineage(placed)


def tie_and_pair_counts(cells: DataFrame, keys: Sequence[str], u: str, v: str, weight: str) -> DataFrame:
    """(keys, n, n1, n2, n3, d): weight, pairs tied in u, in v and in both, and discordant pairs of each group."""
    keys = list(keys)
    placed = placed_in_blocks(cells, keys, u, v, weight)
    names = ("n", "n1", "n2", "n3", "d")
    fields = [f for f in placed.schema.fields if f.name in keys]
    schema = T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in names]])

    def row(frame, **values):
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in keys}, **{c: [float(values.get(c, 0.0))] for c in names}})

    def along_u(frame):
        a, b, t = (frame[c].to_numpy() for c in ("x", "y", "w"))
        return row(frame, d=inversions(a, b, t), n1=_ties(a, t))

    def along_v(frame):
        return row(frame, d=inversions(frame["bx"].to_numpy(), frame["y"].to_numpy(), frame["w"].to_numpy()), n2=_ties(frame["y"].to_numpy(), frame["w"].to_numpy()))

    counts = placed.groupBy(*keys, "bx", "by").agg(F.sum("w").alias("c"), F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("both"))
    tables = counts.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in ("bx", "by", "c", "both")])

    def across(batches):
        for frame in batches:
            for r in frame.to_dict("records"):
                i, j, c = np.asarray(r["bx"], int), np.asarray(r["by"], int), np.asarray(r["c"], float)
                if not len(c):  # no keys and no rows
                    continue
                table = np.zeros((i.max() + 1, j.max() + 1))
                table[i, j] = c
                # weight with a later block of u and an earlier one of v
                after = np.cumsum(np.cumsum(table[::-1], axis=0)[::-1], axis=1)
                right = np.zeros_like(table)
                right[:-1, 1:] = after[1:, :-1]
                rows, columns = table.sum(1), table.sum(0)
                pairs = lambda t: float((t * (t - 1) / 2).sum())
                one = pd.DataFrame({k: [r[k]] for k in keys})
                yield row(one if keys else pd.DataFrame([0]), n=c.sum(), n1=pairs(rows[1::2]), n2=pairs(columns[1::2]), n3=np.sum(r["both"]), d=float((table * right).sum()))

    inside_u = placed.filter(F.col("bx") % 2 == 0).groupBy(*keys, "bx").applyInPandas(along_u, schema)
    inside_v = placed.filter(F.col("by") % 2 == 0).groupBy(*keys, "by").applyInPandas(along_v, schema)
    parts = tables.mapInPandas(across, schema).union(inside_u).union(inside_v)
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def dominated_weights(cells: DataFrame, keys: Sequence[str], u: str, v: str, weight: str) -> DataFrame:
    """``keys, x, y, below, n``: for each cell the weight strictly below it in both, and the weight of its group. Cells that are
    not finite in both are below and above none; their NaN come as null.

    What lies in smaller blocks of both axes comes from the table of block counts. The cells of a block of ``v`` meet in a task, which
    adds those in smaller blocks of ``u``; those of one block of ``u`` are added in another. A block of a single value of ``v``
    needs the table only and is dealt out by the blocks of ``u``.
    """
    keys = list(keys)
    placed = placed_in_blocks(cells, keys, u, v, weight)
    alone = F.when(F.col("by") % 2 == 0, 0).otherwise(F.col("bx"))
    placed = placed.withColumn("part", alone)
    fields = [f for f in placed.schema.fields if f.name in keys]
    of = lambda *more: T.StructType([*fields, *[T.StructField(c, t) for c, t in more]])
    result = of(("x", T.DoubleType()), ("y", T.DoubleType()), ("below", T.LongType()), ("n", T.LongType()))

    counts = placed.groupBy(*keys, "bx", "by").agg(F.sum("w").alias("c"))
    tables = counts.groupBy(*keys).agg(*[F.collect_list(c).alias(c) for c in ("bx", "by", "c")])

    def across(batches):
        for frame in batches:
            for r in frame.to_dict("records"):
                i, j, c = (np.asarray(r[k], np.int64) for k in ("bx", "by", "c"))
                if not len(c):  # no keys and no rows
                    continue
                table = np.zeros((max(i.max(), 0) + 1, max(j.max(), 0) + 1), np.int64)
                table[i[i >= 0], j[i >= 0]] = c[i >= 0]
                below = np.zeros_like(table)
                below[1:, 1:] = np.cumsum(np.cumsum(table, axis=0), axis=1)[:-1, :-1]
                rows = [(b, 0, below[:, b]) for b in np.unique(j[j % 2 == 0])]
                rows += [(b, a, below[a : a + 1, b] if a >= 0 else np.zeros(1, np.int64)) for a, b in zip(i, j) if b % 2]
                out = pd.DataFrame({"by": [b for b, _, _ in rows], "part": [a for _, a, _ in rows], "base": [v for _, _, v in rows]})
                yield out.assign(n=int(c.sum()), **{k: [r[k]] * len(out) for k in keys})[[*keys, "by", "part", "base", "n"]]

    bases = tables.mapInPandas(across, of(("by", T.IntegerType()), ("part", T.IntegerType()), ("base", T.ArrayType(T.LongType())), ("n", T.LongType())))

    def along_v(frame, base):
        total, bx = np.asarray(base["base"].iloc[0], np.int64), frame["bx"].to_numpy()
        if base["by"].iloc[0] % 2:
            below = np.full(len(frame), total[0])
        else:
            below = total[bx] + dominated(bx, frame["y"].to_numpy(), frame["w"].to_numpy())
        return frame[[*keys, "x", "y"]].assign(below=below, n=base["n"].iloc[0])

    def along_u(frame):
        below = dominated(frame["x"].to_numpy(), frame["y"].to_numpy(), frame["w"].to_numpy())
        return frame[[*keys, "x", "y"]].assign(below=below, n=0)

    by_v = placed.groupBy(*keys, "by", "part").cogroup(bases.groupBy(*keys, "by", "part")).applyInPandas(along_v, result)
    by_u = placed.filter((F.col("bx") >= 0) & (F.col("bx") % 2 == 0)).groupBy(*keys, "bx").applyInPandas(along_u, result)
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return by_v.union(by_u).select(*keys, known("x"), known("y"), "below", "n").groupBy(*keys, "x", "y").agg(F.sum("below").alias("below"), F.max("n").alias("n"))
