"""Hard negatives against all pairs, with exact integers."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meteospan.llm import hard_negatives as hn


def brute_negatives(rows, n_positives=5, top=5):
    """Rows (id, vector, label)."""
    key = lambda i: hn.NO_ID if i is None else i
    bad = lambda v: v is None or any(x is None or not math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if label is not None and not bad(v)]
    cut = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    out = Counter()
    for anchor, a, label in rows:
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-cut(sum(x * y for x, y in zip(a, v))), key(i), i, other) for i, v, other in rows if i != anchor), key=lambda r: r[:2])
        for p, _, positive, _ in [r for r in scored if r[3] == label][:n_positives]:
            inside = [r for r in scored if r[3] != label and 80 * -p <= 100 * -r[0] <= 100 * -p][:top]
            for rank, r in enumerate(inside, 1):
                out[anchor, positive, rank, r[2], -p, -r[0]] += 1
    return out


def rows_of(found):
    return Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    extra = [(i, v, label, "x", "x") for i, v, label in rows]
    return spark.createDataFrame(extra, "vec_id long, embedding array<double>, label int, score string, number string").repartition(3)


def odd_rows(seed=1, n=400):
    r = random.Random(seed)
    vector = lambda: [r.choice([0.0, 0.25, 0.5, 1.0, -0.1]) for _ in range(4)]  # many ties
    rows = [(i * 10, vector(), r.choice([0, 0, 0, 1, 2])) for i in range(n)]
    rows += [(5, None, 1), (6, [1.0, None, 1.0, 1.0], 1), (7, [float("nan")] * 4, 1), (8, [float("inf")] * 4, 0), (9, [1.0] * 4, None), (None, [1.0] * 4, 1), (None, [1.0] * 4, 0)]
    rows += [(11, [], 1), (12, [0.5], 0), (13, [0.5] * 9, 1), (-100, [0.5] * 4, 2), (-3, [2.0] * 4, 1), (4100, [0.5] * 4, 77), (4200, [-1.0] * 4, 0), (14, [1.0] * 4, 1), (14, [1.0] * 4, 1)]
    return rows


@pytest.mark.parametrize("pack", [1024, 37])
def test_odd_table(spark, monkeypatch, pack):
    monkeypatch.setattr(hn, "PACK", pack)
    rows = odd_rows()
    df = frame(spark, rows)
    found = rows_of(hn.hard_negatives(df, F.col("id") % 100 == 0))
    assert found == brute_negatives(rows) and len(found) > 300
    assert hn.hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(False)).count() == 0


def test_other_numbers(spark):
    rows = odd_rows(2, 200)
    found = hn.hard_negatives(frame(spark, rows), F.col("id") % 100 == 0, n_positives=12, top=2)
    assert rows_of(found) == brute_negatives(rows, 12, 2)


def test_large_components_are_exact(spark):
    r = random.Random(3)
    scale = lambda: r.choice([1e6, 3e5, 1.0, 1e300 if r.random() < 0.02 else 2e6])
    rows = [(i * 20, [r.random() * scale() for _ in range(3)], i % 3) for i in range(60)]
    assert rows_of(hn.hard_negatives(frame(spark, rows), F.col("id") % 100 == 0)) == brute_negatives(rows)


def test_scores():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**15), 2**15, (20, 64)).astype(float), rng.integers(-(2**15), 2**15, (30, 64)).astype(float)
    assert (hn.scores(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    assert (hn.scores(a * 2**11, b * 2**11) == (a.astype(np.int64) @ b.astype(np.int64).T) * 2**22).all()
    assert hn.scores(a, b[:, :3]).tolist() == (a[:, :3] @ b[:, :3].T).tolist() and hn.scores(a, b[:, :0]).sum() == 0
