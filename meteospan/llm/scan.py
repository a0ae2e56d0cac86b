"""Running values along an order, and lookups of keys that may own a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meteospan.llm.store import written

MASK = (1 << 64) - 1
#: A key is hot if it has more than one in so many rows, and more than ``COLD`` of them; so there are fewer hot keys than this.
SHARES = 4096
COLD = 256

_power: dict[int, np.ndarray] = {}


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo 2**64, from a table for the low 16 bits of the exponent and squaring above."""
    if base not in _power:
        table = np.full(1 << 16, base, np.uint64)
        table[0] = 1
        _power[base] = np.cumprod(table, dtype=np.uint64)
    out = _power[base][exponents & 0xFFFF]
    high = exponents >> 16
    if high.any():
        for h in np.unique(high[high > 0]).tolist():
            at = high == h
            out[at] = out[at] * np.uint64(pow(base, h << 16, 1 << 64))
    return out


def running(df: DataFrame, key: str, order: Sequence[Column], values: dict[str, tuple[str, int]], name: str) -> DataFrame:
    """``df`` with ``pos``, counted from 1 within ``key`` along ``order``, and for each ``name: (column, base)`` the
    sum of ``column * base ** pos`` over the rows up to this one, modulo 2**64 (base 1: the plain sum).

    Rows are dealt out by ranges of the order, so a key with a third of all rows fills many tasks, each reading its rows in a stream.
    Sums of parts compose: (n, s) before (m, t) gives (n + m, s + base ** n * t). What a part is preceded by is found on the
    driver from two rows for each partition, whatever the number of rows.
    """
    spark = df.sparkSession
    columns = df.columns

    def local(number: int, batches):
        held, n, sums, first = None, 0, {v: 0 for v in values}, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(key))
            first = keys[0] if first is None else first
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(start, len(keys)))
            go_on = keys[0] == held
            pos = np.arange(1, len(keys) + 1) - np.repeat(start, size)
            pos[: size[0]] += n if go_on else 0
            out = [pa.array(np.full(len(keys), number)), pa.array(pos)]
            for v, (column, base) in values.items():
                total = np.zeros(len(keys) + 1, np.uint64)
                np.cumsum(np.asarray(batch.column(column)).astype(np.int64).view(np.uint64) * powers(base, pos), out=total[1:])
                run = total[1:] - np.repeat(total[start], size)
                run[: size[0]] += np.uint64(sums[v] if go_on else 0)
                sums[v] = int(run[-1])
                out.append(pa.array(run.view(np.int64)))
            held, n = keys[-1], int(pos[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "_part", "pos", *values])

    def tag(batches):
        from pyspark import TaskContext

        yield from local(TaskContext.get().partitionId(), batches)

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    schema = f"{kinds}, _part long, pos long, " + ", ".join(f"{v} long" for v in values)
    dealt = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    rows = written(dealt.mapInArrow(tag, schema), name)
    ends = rows.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    edge = rows.join(F.broadcast(ends), "_part").filter(F.col(key).isin(F.col("low"), F.col("high")))
    edge = edge.groupBy("_part", "low", "high", key).agg(F.max("pos").alias("n"), *[F.max_by(v, "pos").alias(v) for v in values])
    parts: dict[int, dict] = {}
    for r in edge.collect():  # two rows for a partition at most
        parts.setdefault(r["_part"], {"low": r["low"], "high": r["high"]})[r[key]] = (r["n"], {v: r[v] & MASK for v in values})
    before: dict[int, tuple] = {}
    state = None
    for part in sorted(parts):
        one = parts[part]
        if state and state[0] == one["low"]:
            before[part] = state
            n, sums = state[1:]
            m, more = one[one["low"]]
            joined = (n + m, {v: (sums[v] + pow(base, n, 1 << 64) * more[v]) & MASK for v, (_, base) in values.items()})
            state = (one["low"], *joined) if one["high"] == one["low"] else (one["high"], *one[one["high"]])
        else:
            state = (one["high"], *one[one["high"]])
    if not before:
        return rows.select(*columns, "pos", *values)

    def carry(batches):
        for batch in batches:
            part, keys = np.asarray(batch.column("_part")), np.asarray(batch.column(key))
            pos = np.array(batch.column("pos"))
            out = {v: np.array(batch.column(v)).view(np.uint64) for v in values}
            for p in np.unique(part).tolist():
                if p in before:
                    at = (part == p) & (keys == before[p][0])
                    n, sums = before[p][1:]
                    pos[at] += n
                    for v, (_, base) in values.items():
                        out[v][at] = np.uint64(sums[v]) + np.uint64(pow(base, n, 1 << 64)) * out[v][at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(pos), *[pa.array(x.view(np.int64)) for x in out.values()]], [*columns, "pos", *values]
            )

    return rows.mapInArrow(carry, f"{kinds}, pos long, " + ", ".join(f"{v} long" for v in values))


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], times: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, whose keys are unique and which says in ``times`` how many rows have each key at most.

    Keys with more than a share of 1 / ``SHARES`` of ``total`` are broadcast, and there are fewer than ``SHARES`` of them if the times
    add up to ``total`` or less; all others are shuffled, and none of those is large. ``rows`` and ``table`` are read twice.
    """
    bound = max(COLD, total // SHARES)
    keys = list(keys)
    hot = table.filter(F.col(times) > bound)
    names = [c for c in table.columns if c not in keys]
    with_hot = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.filter(F.col(times) <= bound), keys, how)
    order = [*rows.columns, *names]
    return with_hot.select(*order).union(rest.select(*order))
