"""Moments of all pairs of series as blocked Gram matrices.

Rows of one group and stretch of time become a matrix with a column for each label, and two masks (observed, finite). The
moments of all pairs are products of such matrices, XᵀX and its kin, cut into blocks of ``LABELS`` x ``LABELS``
labels. A task adds the blocks it makes and ships arrays; no row per pair exists before the sums are final. Values
are taken about the mean of their series, so sums of squares do not cancel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from meteospan.operators.ordering import join_on, with_position
from meteospan.schema import finite

#: Labels of a block of the matrix.
LABELS = 64
#: Steps of a stretch when lags are asked for.
STRETCH = 4096
#: Bytes of sums that a task holds before it ships them.
HELD = 1 << 26
MOMENTS = ("rows", "n", "sx", "sy", "sxx", "syy", "sxy")


def _stretches(df: DataFrame, by: Sequence[str], span: int) -> tuple[DataFrame, Column]:
    """Rows with ``_at``, their place in time, and the stretch. With lags the first ``span`` places of a stretch are
    copied to the one before it."""
    if not span and isinstance(df.schema["time"].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn("_at", F.unix_micros(F.col("time").cast("timestamp"))), F.date_trunc("month", "time")
    if not span:  # any other key of an observation
        return df.withColumn("_at", F.xxhash64("time")), F.pmod(F.xxhash64("time"), F.lit(256))
    axis = with_position(df.select(*by, "time").distinct(), by).withColumnRenamed("pos", "_at").drop("pos_total")
    placed = df.join(axis, [*by, "time"])
    first = F.floor(F.greatest(F.col("_at") - span, F.lit(0)) / STRETCH)
    return placed.withColumn("_part", F.explode(F.sequence(first, F.floor(F.col("_at") / STRETCH)))), F.col("_part")


def pair_moments(
    df: DataFrame, by: Sequence[str], label: Sequence[str], lags: Sequence[int] = (0,), value: str = "value", ordered: bool = False,
) -> DataFrame:
    """(by, <label>_i, <label>_j, lag, rows, n, sx, sy, sxx, syy, sxy, mean_i, mean_j) of the pairs of series that are observed at the
    same time, the second one ``lag`` steps later on the time axis of the group.

    ``rows`` are the times with both, ``n`` those with two finite values; the sums are over the latter and about the series
    means ``mean_i`` and ``mean_j``. Pairs are i < j, or all of them with ``ordered``.
    """
    by, label, span = list(by), list(label), max(lags)
    good = F.when(finite(value), F.col(value))
    names = df.groupBy(*by, *label).agg(F.avg(good).alias("_mean"))
    names = names.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*label, "_mean"))).alias("_names"))
    rows, stretch = _stretches(df.select(*by, *label, "time", good.alias("_x")), by, span)
    key = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in label])
    lists = {"_ats": F.col("_at"), "_labels": key, "_values": F.coalesce("_x", F.lit(float("nan")))}
    packed = rows.filter("_at IS NOT NULL").groupBy(*by, stretch.alias("_part")).agg(*[F.collect_list(c).alias(n) for n, c in lists.items()])
    names = names.withColumn("_keys", F.transform("_names", lambda e: F.concat_ws("\x01", *[F.coalesce(e[c].cast("string"), F.lit("\x00")) for c in label])))
    packed, names = join_on(packed, names, by), names.drop("_keys")

    def evaluate(batches):
        sums, size = {}, 0

        def ship():
            out = [(*key[: len(by)], *key[len(by) :], table.ravel()) for key, table in sums.items()]
            return pd.DataFrame(out, columns=[*by, "_bi", "_bj", "lag", "_sums"])

        for frame in batches:
            for row in frame.to_dict("records"):
                mean = np.array([np.nan if x["_mean"] is None else x["_mean"] for x in row["_names"]])
                at, got = np.asarray(row["_ats"]), np.asarray(row["_values"], float)
                column = pd.Index(row["_keys"]).get_indexer(row["_labels"])
                if span:
                    begin, n = row["_part"] * STRETCH, min(STRETCH + span, int(at.max()) - row["_part"] * STRETCH + 1)
                    line, own = at - begin, STRETCH
                else:
                    times, line = np.unique(at, return_inverse=True)
                    n = own = len(times)
                present, x = np.zeros((n, len(mean)), bool), np.full((n, len(mean)), np.nan)
                present[line, column], x[line, column] = True, got
                held = np.isfinite(x)
                x = np.where(held, x - mean, 0.0)
                for lag in lags:
                    for i in range(0, len(mean), LABELS):
                        for j in range(0 if ordered else i, len(mean), LABELS):
                            a, b = slice(i, i + LABELS), slice(j, j + LABELS)
                            end = min(own, n - lag)
                            if end <= 0:
                                continue
                            key = (*[row[c] for c in by], i // LABELS, j // LABELS, lag)
                            now = (present[:end, a], held[:end, a], x[:end, a])
                            then = (present[lag : lag + end, b], held[lag : lag + end, b], x[lag : lag + end, b])
                            table = _cross(now, then)
                            if key in sums:
                                sums[key] += table
                            else:
                                sums[key] = table
                                size += table.nbytes
                if size > HELD:
                    yield ship()
                    sums, size = {}, 0
        if sums:
            yield ship()

    keys = [df.schema[c] for c in by]
    spot = [T.StructField("_bi", T.IntegerType()), T.StructField("_bj", T.IntegerType()), T.StructField("lag", T.IntegerType())]
    schema = T.StructType([*keys, *spot, T.StructField("_sums", T.ArrayType(T.DoubleType()))])
    parts = packed.mapInPandas(evaluate, schema)

    def add(frame):
        out = frame.iloc[:1].copy()
        out["_sums"] = [np.sum(np.stack(frame["_sums"].to_list()), axis=0)]
        return out

    # few arrays at a time: those of some tasks, then the sums of these
    block = [*by, "_bi", "_bj", "lag"]
    some = parts.withColumn("_some", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = some.groupBy(*block, "_some").applyInPandas(lambda f: add(f.drop(columns="_some")), schema)
    total = join_on(once.groupBy(*block).applyInPandas(add, schema), names, by)

    def spread(batches):
        for frame in batches:
            for row in frame.to_dict("records"):
                entries = row["_names"]
                left, right = (entries[row[c] * LABELS : (row[c] + 1) * LABELS] for c in ("_bi", "_bj"))
                table = np.asarray(row["_sums"]).reshape(len(MOMENTS), len(left), len(right))
                i, j = np.nonzero(table[0] > 0)
                if not ordered:
                    i, j = (x[i + row["_bi"] * LABELS < j + row["_bj"] * LABELS] for x in (i, j))
                out = pd.DataFrame({c: [row[c]] * len(i) for c in by})
                for side, names_, at in (("i", left, i), ("j", right, j)):
                    for c in label:
                        out[f"{c}_{side}"] = [names_[k][c] for k in at]
                out["lag"] = row["lag"]
                for m, name in enumerate(MOMENTS):
                    out[name] = table[m, i, j]
                for side, names_, at in (("i", left, i), ("j", right, j)):
                    out[f"mean_{side}"] = [names_[k]["_mean"] for k in at]
                yield out

    double = lambda c: T.StructField(c, T.DoubleType())
    fields = [T.StructField(f"{c}_{s}", df.schema[c].dataType) for s in "ij" for c in label]
    result = T.StructType([*keys, *fields, T.StructField("lag", T.IntegerType()), *[double(c) for c in MOMENTS], double("mean_i"), double("mean_j")])
    found = total.mapInPandas(spread, result)
    return found.withColumns({"rows": F.round("rows").cast("long"), "n": F.round("n").cast("long")})


def _cross(now, then) -> np.ndarray:
    """The seven moments of all pairs from two sets of (observed, finite, values)."""
    (p, m, u), (q, k, v) = now, then
    p, q, m, k = (x.astype(float) for x in (p, q, m, k))
    return np.stack([p.T @ q, m.T @ k, u.T @ k, m.T @ v, (u * u).T @ k, m.T @ (v * v), u.T @ v])


def correlation() -> Column:
    """Pearson correlation from the moments; null without spread."""
    n = F.col("n")
    about = lambda s, t, st: F.col(st) - F.col(s) * F.col(t) / n
    spread = lambda s, ss, mean: F.when(about(s, s, ss) > n * F.pow(F.coalesce(F.col(mean), F.lit(0.0)) * 1e-14, 2.0), about(s, s, ss))
    return F.when(n > 0, F.try_divide(about("sx", "sy", "sxy"), F.sqrt(spread("sx", "sxx", "mean_i") * spread("sy", "syy", "mean_j"))))
