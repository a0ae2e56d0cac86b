"""Hard negatives by slot-decomposed selection.

An anchor has up to ``n_positives`` positives with scores p1 >= p2 >= ..., and each asks for the best
negatives inside its window ``[share * p, p]``. The upper ends of the windows cut the scores into
disjoint slots (slot s: at most p_s, above p_(s+1)). A window is a stretch that begins at an upper end and goes down,
so the best ``top`` negatives of each slot answer all windows, however they overlap:

1. Rows are packed, ``PACK`` to a block of integers. Blocks of rows meet blocks of anchors (the stated queries
   against all rows), and a task keeps the best positives of each anchor only.
2. With the limits known, blocks meet again; a task keeps the best ``top`` of each (anchor, slot).
3. Slots are merged from the lowest up: what the slots from s on hold in descending order begins the answer of window s.

Shuffled are at most ``n_positives`` * ``top`` short rows for each anchor and task, never vectors. Nothing is
grouped by label, so a frequent label is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from meteospan.llm.store import written

#: Rows of a block and anchors of a block.
PACK = 1024
#: Place of a null id in comparisons: after all others.
NO_ID = np.iinfo(np.int64).max
_DOUBLE = (np.finfo(np.float64).min, np.finfo(np.float64).max)
_LONG = (np.iinfo(np.int64).min, np.iinfo(np.int64).max)


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector`` (doubles) of the rows with a label and a vector of finite components."""
    x = F.col("vector")
    broken = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    read = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return read.filter(F.col("label").isNotNull() & x.isNotNull() & ~broken)


def _pack(rows: DataFrame, limits: bool = False) -> DataFrame:
    """Blocks of up to ``PACK`` rows: ids, labels, limits, sizes and scaled components, each joined to one value."""

    def pack(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                vectors = part.column("vector")
                size = np.diff(np.asarray(vectors.offsets))
                flat = np.clip(np.floor(256.0 * np.asarray(vectors.flatten(), np.float64)), *_DOUBLE)
                wide = np.zeros((len(size), int(size.max(initial=0))))
                wide[np.arange(wide.shape[1]) < size[:, None]] = flat
                small = wide.size == 0 or np.abs(wide).max() < 2**15
                own = [pa.array([np.asarray(part.column(c).fill_null(NO_ID)).astype("<i8").tobytes()]) for c in ("id", "label", "number") if c in part.schema.names]
                if limits:
                    held = part.column("limits")
                    own += [pa.array([np.asarray(held.flatten()).astype("<i8").tobytes()]), pa.array([np.diff(np.asarray(held.offsets)).astype("<i4").tobytes()])]
                body = wide.astype("<i2" if small else "<f8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array([body]), pa.array([wide.shape[1]], pa.int32()), pa.array([small])],
                    [f.split()[0] for f in fields],
                )

    fields = ["ids binary", "labels binary", *(["numbers binary"] if "number" in rows.columns else []),
              *(["limits binary", "held binary"] if limits else []), "body binary", "width int", "small boolean"]
    return rows.mapInArrow(pack, ", ".join(fields))


def _matrix(body: bytes, width: int, small: bool) -> np.ndarray:
    flat = np.frombuffer(body, "<i2" if small else "<f8").astype(np.float64)
    return flat.reshape(-1, width) if width else flat.reshape(0, 0)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows; the narrower side goes on with zeros. Exact: in doubles while every
    sum stays below 2**53, else in Python's integers, cut to the range of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
    return np.vectorize(lambda x: min(max(x, _LONG[0]), _LONG[1]), otypes=[np.int64])(exact)


def _first(top: int, score: np.ndarray, ids: np.ndarray, *groups: np.ndarray) -> np.ndarray:
    """Positions of the first ``top`` of each group, highest score first, then smallest id."""
    order = np.lexsort((ids, ~score, *groups[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for g in groups:
        new[1:] |= g[order][1:] != g[order][:-1]
    begin = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[rank < top]


def _met(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Blocks of rows beside blocks of anchors. Spark broadcasts the anchors by its own size rule, or else deals out pairs of partitions."""
    return rows.crossJoin(anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns]))


def _best(blocks: DataFrame, top: int, pick, extra: list[str]) -> DataFrame:
    """Best rows of all block pairs by group: each task keeps ``top`` of a group among what it has seen, then all tasks' rows are ranked."""
    names = ["number", *extra, "score", "id"]

    def keep(batches) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, 1 << 18
        combine = lambda parts: (lambda t: t[:, _first(top, t[-2], t[-1], *t[:-2])])(np.concatenate(parts, 1))
        for batch in batches:
            for pair in batch.to_pylist():
                found = pick(pair)
                held.append(found)
                n += found.shape[1]
                if n > least:
                    held = [combine(held)]
                    n = held[0].shape[1]
                    least = max(least, 2 * n)
        if held:
            best = combine(held)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names)

    kept = blocks.mapInArrow(keep, ", ".join(f"{c} long" for c in names))
    order = Window.partitionBy("number", *extra).orderBy(F.desc("score"), "id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _positives(pair: dict, top: int) -> np.ndarray:
    ids, labels = np.frombuffer(pair["ids"], "<i8"), np.frombuffer(pair["labels"], "<i8")
    a_ids, a_labels, numbers = (np.frombuffer(pair[f"a_{c}"], "<i8") for c in ("ids", "labels", "numbers"))
    score = scores(_matrix(pair["a_body"], pair["a_width"], pair["a_small"]), _matrix(pair["body"], pair["width"], pair["small"])) if len(ids) else None
    a, r = np.nonzero((a_labels[:, None] == labels) & (a_ids[:, None] != ids))
    table = np.stack([numbers[a], score[a, r], ids[r]])
    return table[:, _first(top, table[1], table[2], table[0])]


def _negatives(pair: dict, top: int, low: int, high: int) -> np.ndarray:
    ids, labels = np.frombuffer(pair["ids"], "<i8"), np.frombuffer(pair["labels"], "<i8")
    a_labels, numbers, flat = (np.frombuffer(pair[f"a_{c}"], "<i8") for c in ("labels", "numbers", "limits"))
    held = np.frombuffer(pair["a_held"], "<i4")
    score = scores(_matrix(pair["a_body"], pair["a_width"], pair["a_small"]), _matrix(pair["body"], pair["width"], pair["small"]))
    # limits in descending order; an anchor with fewer positives has its lowest again, whose slot stays empty
    at = np.cumsum(held) - held
    slot = np.zeros(score.shape, np.int8)
    lowest = np.full(score.shape, _LONG[1])
    for s in range(int(held.max(initial=0))):
        limit = flat[at + np.minimum(s, held - 1)][:, None]
        under = (score <= limit) & (s < held)[:, None]
        slot[under] += 1
        lowest[under] = np.broadcast_to(limit, score.shape)[under]
    # a slot serves the windows that end at its own limit or higher; the lowest of their lower ends is that of its own
    enough = score.astype(object) * high >= lowest.astype(object) * low if np.abs(score).max(initial=0) > 2**50 else score * high >= np.minimum(lowest, 2**51) * low
    a, r = np.nonzero((a_labels[:, None] != labels) & (slot > 0) & enough)
    table = np.stack([numbers[a], slot[a, r].astype(np.int64), score[a, r], ids[r]])
    return table[:, _first(top, table[2], table[3], table[0], table[1])]


def _answers(top: int, low: int, high: int):
    """Suffix merge: from the lowest slot up, the ``top`` first of all slots so far begin the answer of the slot's window."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (anchor, _), one in frame.groupby(["anchor_id", "number"], sort=True):
            limits = one[one["kind"] == 0].sort_values(["slot", "id"])
            slots = {s: list(zip(x["score"], x["id"])) for s, x in one[one["kind"] == 1].groupby("slot")}
            merged: list[tuple[int, int]] = []
            for s, p, positive in reversed(list(zip(limits["slot"], limits["score"], limits["id"]))):
                merged = sorted([*merged, *slots.get(s, [])], key=lambda x: (-int(x[0]), x[1]))[:top]
                inside = [(x, i) for x, i in merged if low * int(p) <= high * int(x) <= high * int(p)]
                out += [(anchor, positive, rank, i, p, x) for rank, (x, i) in enumerate(inside, 1)]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return merge


def hard_negatives(
    rows: DataFrame, anchors: Column, n_positives: int = 5, top: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``anchors``
    (a condition on ``id``) chooses.

    Components become ``floor(256 * x)``; a score is the inner product with the anchor, higher ones first, ties by smaller id.
    Positives are the first ``n_positives`` other rows of the anchor's label; each gets the first ``top`` rows of other labels
    with ``low * positive <= high * negative <= high * positive``, ranked from 1, all if fewer. A negative positive score
    has an empty window.

    Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different length are
    compared as if the shorter went on with zeros; an empty vector scores 0. A null id is no anchor and comes
    last among ties. Rows that bear the anchor's id are not its others; repeated rows count each by itself, and a repeated anchor
    answers each time. Scores beyond a long are cut to its ends. Other columns play no part; an empty table gives no rows.
    """
    read = usable(rows, id_col, vector_col, label_col)
    packed = written(_pack(read), "packs")
    numbered = written(read.filter(F.coalesce(anchors, F.lit(False))).withColumn("number", F.monotonically_increasing_id()), "anchors")
    found = _best(_met(packed, written(_pack(numbered), "anchor-packs")), n_positives, lambda p: _positives(p, n_positives), [])
    positives = written(found, "positives")
    limits = positives.groupBy("number").agg(F.sort_array(F.collect_list("score"), asc=False).alias("limits"))
    asking = numbered.join(limits, "number")
    slots = _best(_met(packed, written(_pack(asking, limits=True), "asking-packs")), top, lambda p: _negatives(p, top, low, high), ["slot"])
    # rank and slot agree unless positives tie; then the slot of the last of them holds the scores
    both = positives.select("number", F.lit(0).alias("kind"), F.col("rank").cast("long").alias("slot"), "score", "id").union(
        slots.select("number", F.lit(1), "slot", "score", "id")
    )
    named = both.join(numbered.select("number", F.col("id").alias("anchor_id")), "number").withColumn("part", F.floor(F.col("number") / 64))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    done = named.groupBy("part").applyInPandas(_answers(top, low, high), schema)
    null = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return done.select("anchor_id", null("positive_id"), "rank", null("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def op13_sql() -> str:
    return """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""
