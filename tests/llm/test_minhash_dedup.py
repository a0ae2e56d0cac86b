"""Near-duplicates by bottom-k sketches against all pairs."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from meteospan.llm import minhash_dedup


def found_rows(found):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect())


def wanted(rows, size, percent):
    return Counter((i, n, c, i == c) for i, n, c in brute.components(rows, size, percent))


@pytest.mark.parametrize("size, percent", [(4, 80), (5, 90)])
def test_odd_table(docs, empty, rows, size, percent):
    assert found_rows(minhash_dedup.minhash_components(docs, size, percent)) == wanted(rows, size, percent)
    if size == 4:
        assert minhash_dedup.minhash_components(empty, size, percent).count() == 0


def families():
    """Near copies of some texts at all degrees around the bound, short and long, with a passage that many share."""
    r = random.Random(8)
    shared, rows = [f"s{i}" for i in range(60)], []
    for n in (5, 12, 40, 55, 63, 80, 150, 600):
        base = [f"w{r.randint(0, 9999)}" for _ in range(n)]
        for _ in range(12):
            text = list(base)
            for _ in range(r.randint(0, max(1, n // 25))):
                text[r.randrange(n)] = f"x{r.randint(0, 9999)}"
            rows.append((len(rows), " ".join(text if r.random() < 0.7 else text + shared)))
    return rows + [(None, rows[3][1]), (5, rows[30][1]), (None, None)]


@pytest.mark.parametrize("block, frequent", [(1 << 19, 1 << 18), (400, 1 << 18), (400, 0)])
def test_families_in_blocks(spark, monkeypatch, block, frequent):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(minhash_dedup, "HELD", 5 if block == 400 else 4096)  # values of more nodes are dealt out by blocks
    rows = families()
    df = spark.createDataFrame([(*x, "x", "x") for x in rows], "doc_id long, text string, node string, kept string").repartition(3)
    assert found_rows(minhash_dedup.minhash_components(df, 4, 80)) == wanted(rows, 4, 80)


def test_null_ids_do_not_multiply(spark):
    texts = [" ".join(f"t{i} {j}" for j in range(30)) for i in range(60)]
    df = spark.createDataFrame([(None, t) for t in texts + texts], "doc_id long, text string")
    assert found_rows(minhash_dedup.minhash_components(df, 4, 80)) == Counter({(None, 57, None, True): 120})


def test_links_make_the_components_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(80):
        base = np.unique(rng.integers(0, 1 << 62, int(rng.choice([20, 60, 70, 300]))).astype(np.uint64))
        sets = []
        for _ in range(rng.integers(2, 15)):
            x = base[rng.random(len(base)) < rng.choice([1, 0.97, 0.9])]
            sets.append(np.unique(np.concatenate([x, rng.integers(0, 1 << 62, rng.integers(0, len(base) // 8 + 1)).astype(np.uint64)])))
        both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
        want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * both(i, j) >= 80 * (len(sets[i]) + len(sets[j]) - both(i, j))}
        got = {tuple(sorted(p)) for p in minhash_dedup.sketch_links(sets, [None] * len(sets), 80)}
        group = lambda pairs: [min(g) for i in range(len(sets)) for g in [reach(i, pairs)]]
        assert got <= want and group(got) == group(want) and len(got) <= len(sets) - 1


def reach(i, pairs):
    seen = {i}
    while True:
        more = {x for p in pairs for x in p if seen & set(p)} | seen
        if more == seen:
            return seen
        seen = more


def test_union_sketch_estimate_is_a_sample():
    """Pairs at the bound keep far more than LEAST percent in their union sketch."""
    rng = np.random.default_rng(4)
    shares = []
    for _ in range(2000):
        values = rng.permutation(900)
        common, a = values[:720], values[720:810]
        b = values[810:]
        x, y = (np.sort(np.concatenate([common, z])) for z in (a, b))
        union = np.union1d(x[:64], y[:64])[:64]
        shares.append(np.isin(union, common).mean())
    assert min(shares) > 0.55 and abs(np.mean(shares) - 0.8) < 0.01


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_second_search_reads_few_texts(spark, monkeypatch, few):
    """What is left of a long group is looked up among the texts that it needs; all texts were shuffled anew."""
    seen, search = [], minhash_dedup._search

    def spy(tasks, *rest, **options):
        seen.append(options)
        return search(tasks, *rest, **options)

    monkeypatch.setattr(minhash_dedup, "_search", spy)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 400)
    monkeypatch.setattr(minhash_dedup, "FEW", few)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_rows(minhash_dedup.minhash_components(df, 4, 80)) == wanted(rows, 4, 80)
    assert seen == [{}, {"few": True}]
