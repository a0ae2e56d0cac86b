"""Ordered computations that never hold a whole group in one task.

A station, or one tied value, may own a large share of all rows, so a window over
``partitionBy(keys)`` is avoided. Rows are cut into blocks along the order (calendar
blocks for time, ranges for values and positions); a window runs inside a block, one
summary row per block is scanned per key, and the carried state is joined back on
(keys, block), for which the rows are already partitioned. Blocks are pure functions of
the row, so a recomputed stage puts every row in the same block again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from meteospan.schema import finite

BLOCK = "_block"
POSITIONS_PER_BLOCK = 65536


def calendar_block(time: str = "time", unit: str = "year") -> Column:
    return F.date_trunc(unit, time)


def value_block(column: str, resolution: int = 4096) -> Column:
    """Monotone block number with a relative width of 1/resolution."""
    x = F.col(column).cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x) * 1e9) * resolution)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on the keys; without keys ``right`` is one group, a single row or one of a short list."""
    return left.join(right, list(keys), how) if keys else left.join(right, F.lit(True), how)


def position_block(column: str, size: int = POSITIONS_PER_BLOCK) -> Column:
    return F.floor(F.col(column) / size)


def _over(keys: Sequence[str], *order) -> W:
    return W.partitionBy(*keys).orderBy(*order) if order else W.partitionBy(*keys)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    measures: dict[str, Column],
    block: Column,
    totals: bool = False,
) -> DataFrame:
    """Add exclusive running sums of ``measures`` along ``order`` within ``keys``.

    With ``totals`` the sum over the whole group is added as ``<name>_total``.
    """
    parts = [*keys, BLOCK]
    names = list(measures)
    rows = df.withColumn(BLOCK, block).withColumns(
        {f"_m_{n}": e for n, e in measures.items()}
    )
    sums = rows.groupBy(*parts).agg(*[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in names])
    before = _over(keys, BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = [
        F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names
    ]
    if totals:
        carried += [F.sum(f"_s_{n}").over(_over(keys)).alias(f"{n}_total") for n in names]
    offsets = sums.select(*parts, *carried)
    inside = _over(parts, *order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumns(
        {n: F.coalesce(F.sum(f"_m_{n}").over(inside), F.lit(0)) for n in names}
    )
    out = local.join(offsets, parts)
    return out.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in names}).drop(
        BLOCK, *[f"_m_{n}" for n in names], *[f"_o_{n}" for n in names]
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence = ("time",), block: Column | None = None
) -> DataFrame:
    """Add the 0-based position ``pos`` and group size ``pos_total``.

    ``order`` has to be unique within ``keys``.
    """
    block = calendar_block() if block is None else block
    return running_sums(df, keys, order, {"pos": F.lit(1).cast("long")}, block, totals=True)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    payload: dict[str, Column],
    block: Column,
    before: bool = True,
    after: bool = True,
) -> DataFrame:
    """Add ``prev_<name>`` / ``next_<name>``: nearest non-null payload at or before / after.

    Payload columns should be structs that contain ``order`` and be null where there is
    nothing to carry.
    """
    parts = [*keys, BLOCK]
    rows = df.withColumn(BLOCK, block).withColumns(
        {f"_p_{n}": e for n, e in payload.items()}
    )
    names = list(payload)
    sides = [s for s, wanted in (("prev", before), ("next", after)) if wanted]
    ends = []
    for n in names:
        at = F.when(F.col(f"_p_{n}").isNotNull(), F.col(order))
        if before:
            ends.append(F.max_by(f"_p_{n}", at).alias(f"_e_prev_{n}"))
        if after:
            ends.append(F.min_by(f"_p_{n}", at).alias(f"_e_next_{n}"))
    edges = rows.groupBy(*parts).agg(*ends)
    back = _over(keys, BLOCK).rowsBetween(W.unboundedPreceding, -1)
    ahead = _over(keys, F.col(BLOCK).desc()).rowsBetween(W.unboundedPreceding, -1)
    scans = {"prev": back, "next": ahead}
    edges = edges.select(
        *parts,
        *[
            F.last(f"_e_{s}_{n}", ignorenulls=True).over(scans[s]).alias(f"_c_{s}_{n}")
            for n in names
            for s in sides
        ],
    )
    local = {
        "prev": _over(parts, order).rowsBetween(W.unboundedPreceding, 0),
        "next": _over(parts, F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0),
    }
    out = rows.withColumns(
        {
            f"{s}_{n}": F.last(f"_p_{n}", ignorenulls=True).over(local[s])
            for n in names
            for s in sides
        }
    ).join(edges, parts)
    return out.withColumns(
        {
            f"{s}_{n}": F.coalesce(F.col(f"{s}_{n}"), F.col(f"_c_{s}_{n}"))
            for n in names
            for s in sides
        }
    ).drop(
        BLOCK,
        *[f"_p_{n}" for n in names],
        *[f"_c_{s}_{n}" for n in names for s in sides],
    )


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    before: int,
    after: int,
    columns: dict,
    size: int = 4096,
) -> DataFrame:
    """Evaluate window expressions that look ``before``/``after`` rows around each row.

    ``df`` has to carry ``pos``. ``columns`` maps a name to a function of a WindowSpec
    (ordered, without frame). Rows near a block edge are copied into the neighbour block,
    so every window sees what it needs and no window holds more than one block.
    """
    first = F.floor(F.greatest(F.col("pos") - after, F.lit(0)) / size)
    last = F.floor((F.col("pos") + before) / size)
    rows = df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
    window = _over([*keys, BLOCK], "pos")
    out = rows.withColumns({n: make(window) for n, make in columns.items()})
    return out.filter(F.col(BLOCK) == F.floor(F.col("pos") / size)).drop(BLOCK)


def value_counts(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    block: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """One row per distinct finite value: ``ties``, rows ``below``, ``total``, ``dense``.

    Ties are collapsed before anything is ordered, so a value that fills a third of the
    table is one row here.
    """
    block = value_block(column) if block is None else block
    counts = (
        df.filter(finite(column))
        .groupBy(*keys, column)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("ties"))
    )
    out = running_sums(
        counts,
        keys,
        [column],
        {"below": F.col("ties"), "dense": F.lit(1).cast("long")},
        block,
        totals=True,
    )
    return out.withColumnsRenamed({"below_total": "total", "dense_total": "distinct"})


def _order_statistics(hits: DataFrame, keys: Sequence[str], column: str, ids: Sequence[str]):
    """Linear interpolation between the two order statistics next to ``h``."""
    lower = F.floor("_h")
    upper = F.least(lower + 1, F.col("total") - 1)
    covers = lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("ties"))
    return (
        hits.groupBy(*keys, *ids)
        .agg(
            F.max(F.when(covers(lower), F.col(column))).alias("_lo"),
            F.max(F.when(covers(upper), F.col(column))).alias("_hi"),
            F.max(F.col("_h") - lower).alias("_f"),
        )
        .select(
            *keys,
            *ids,
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("quantile"),
        )
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    levels: Sequence[float],
    block: Column | None = None,
) -> DataFrame:
    """Exact quantiles (linear interpolation) for a short fixed list of levels.

    Returns (keys, level_id, level, quantile). Unlike ``percentile`` this does not build
    a map of all values of a group in one task.
    """
    df, column = df.withColumn("_x", F.col(column)).select(*keys, "_x"), "_x"
    counts = value_counts(df, keys, column, block)
    grid = F.array(
        *[F.struct(F.lit(i).alias("id"), F.lit(float(p)).alias("p")) for i, p in enumerate(levels)]
    )
    span = F.col("total") - 1

    def near(e):
        h = F.floor(e["p"] * span)
        return (h + 1 >= F.col("below")) & (h < F.col("below") + F.col("ties"))

    hits = (
        counts.withColumn("_l", F.explode(F.filter(grid, near)))
        .withColumns({"level_id": F.col("_l.id"), "level": F.col("_l.p")})
        .withColumn("_h", F.col("level") * span)
    )
    return _order_statistics(hits, keys, column, ["level_id", "level"])


def regular_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    start: Column,
    step: Column,
    count: Column,
    extra: DataFrame | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Exact quantiles at ``start + i * step``, i = 0 … count−1.

    The three expressions may use ``total`` and the columns of ``extra`` (joined on the
    keys they share), so the number of levels may grow with the series.
    """
    df, column = df.withColumn("_x", F.col(column)).select(*keys, "_x"), "_x"
    counts = value_counts(df, keys, column, block)
    if extra is not None:
        counts = counts.join(extra, [k for k in keys if k in extra.columns])
    span = F.col("total") - 1
    rows = counts.withColumns(
        {"_start": start.cast("double"), "_step": step.cast("double"), "_count": count.cast("long")}
    ).filter(F.col("_count") > 0)
    # index range whose lower or upper order statistic falls on this value, one spare each side
    unit = F.when(span * F.col("_step") > 0, span * F.col("_step"))
    lo = F.floor((F.col("below") - 1 - F.col("_start") * span) / unit) - 1
    hi = F.floor((F.col("below") + F.col("ties") - F.col("_start") * span) / unit) + 1
    lo = F.greatest(F.coalesce(lo, F.lit(0)), F.lit(0))
    hi = F.least(F.coalesce(hi, F.col("_count") - 1), F.col("_count") - 1)
    ids = F.when(lo <= hi, F.sequence(lo, hi))
    hits = (
        rows.withColumn("level_id", F.explode(ids))
        .withColumn("level", F.col("_start") + F.col("level_id") * F.col("_step"))
        .withColumn("_h", F.col("level") * span)
    )
    low = F.floor("_h")
    hits = hits.filter((low + 1 >= F.col("below")) & (low < F.col("below") + F.col("ties")))
    return _order_statistics(hits, keys, column, ["level_id", "level"])
