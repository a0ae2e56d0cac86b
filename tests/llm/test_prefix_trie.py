"""The prefix trie against rebuilt texts, and the running values below it."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meteospan.llm import prefix_trie, scan

HEAD = lambda: F.crc32(F.col("conv").cast("string").cast("binary")) % 9
BASE = lambda: F.col("conv") - F.pmod("conv", F.lit(5))


def brute_trie(rows):
    """Rows (conv, turn, role, text) without ties of different turns."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in stored.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(stored.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    found = []
    for node, of in members.items():
        d = len(node)
        below = [x for x in members if x[:d] == node]
        leaf = lambda x: not any(len(y) == len(x) + 1 and y[:-1] == x for y in members)
        ends = sorted(c for c in of if len(rebuilt[c]) == d)
        found.append((
            min(of), d, min(members[node[:-1]]) if d else None, len(of), sum(len(x) == d + 1 for x in below), sum(map(leaf, below)),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return found


def odd_rows():
    r = random.Random(5)
    say = lambda: r.choice(["yes", "no", "é ü", "", None, "a longer answer"])
    rows = [(c, t, r.choice(["user", "assistant", None]), say()) for c in range(40) for t in r.sample(range(20), r.randint(1, 14))]
    same = [(t, "user", f"turn {t % 3}") for t in range(12)]
    rows += [(c, *t) for c in range(100, 130) for t in same] + [(c, *t) for c in range(130, 135) for t in same[:5]]
    rows += [(200, t, "user", f"long {t}") for t in range(150)] + [(201, t, "user", f"long {t}") for t in range(140)] + [(202, t, "x", "y") for t in range(60)]
    rows += [(303, 0, "a", "base is absent"), (303, 1, "a", "b"), (None, 0, "user", "no conversation"), (-3, 0, "user", "x"), (-5, 0, "user", "y"), (-5, None, "user", "z")]
    rows += [(400, None, "user", "first"), (400, -7, "user", "second"), (400, 3, None, None), (400, 5, "", "")]
    rows += [(500, 1, "user", "twice")] * 2 + [(500, 2, "user", "end")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = [(*x, "x", "x", "x") for x in odd_rows()]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, conv string, f1 string").repartition(5)


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_trie_against_rebuilt_texts(table, monkeypatch, small):
    if small:  # every key that repeats is hot, and texts of ids are cut
        for name in ("COLD", "SHARES"):
            monkeypatch.setattr(scan, name, 3)
        monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    found = prefix_trie.prefix_trie(table, HEAD(), BASE(), 8)
    got = found.collect()
    assert Counter(tuple(r[c] for c in NAMES) for r in got) == Counter(brute_trie(odd_rows()))
    assert all((r.from_conv is None) == (r.depth == 0) for r in got)


def test_stored_turn_of_a_node(spark):
    rows = [(0, t, "user", f"base {t}") for t in range(9)] + [(c, t, "user", f"own {c} {t}") for c in (1, 2, 3) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    stored = {(c, t + 1): text for c, t, _, text in rows}
    for r in prefix_trie.prefix_trie(df, HEAD(), BASE(), 8).filter("depth > 0").collect():
        h = zlib.crc32(str(r.conv_id).encode()) % 9
        want = f"base {r.depth - 1}" if r.depth <= h or r.conv_id == 0 else f"own {r.conv_id} {r.depth - 1}"
        assert stored[r.from_conv, r.from_turn] == want


def test_empty_and_turnless(spark, table):
    assert prefix_trie.prefix_trie(table.limit(0), HEAD(), BASE(), 8).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "lost: the head is longer")], "conv_id long, turn long, role string, text string")
    (root,) = prefix_trie.prefix_trie(one, F.lit(4), F.lit(0).cast("long"), 8).collect()
    assert (root.conv_id, root.depth, root.n_convs, root.n_leaves, root.ends_sha256) == (1, 0, 1, 1, hashlib.sha256(b"1").hexdigest())


@pytest.mark.parametrize("partitions", [1, 7])
def test_running_products_over_parts(spark, partitions):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, int(x)) for i, (k, x) in enumerate(zip(rng.choice([1, 2, 2, 2, 2, 3], 3000), rng.integers(-(1 << 62), 1 << 62, 3000)))]
    base, old = 0xD1342543DE82EF95, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "key long, at long, x long").repartition(4)
        got = scan.running(df, "key", [F.col("at")], {"s": ("x", base), "t": ("x", 1)}, "test").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want, mask = [], (1 << 64) - 1
    for key in (1, 2, 3):
        s = t = 0
        for pos, (_, at, x) in enumerate(sorted(r for r in rows if r[0] == key), 1):
            s, t = s + x * pow(base, pos, 1 << 64) & mask, t + x & mask
            want.append((key, at, x, pos, s, t))
    assert sorted((r.key, r.at, r.x, r.pos, r.s & mask, r.t & mask) for r in got) == sorted(want)


def test_powers_above_the_table():
    exponents = np.array([0, 1, 65535, 65536, 65537, 1 << 20, (1 << 33) + 5])
    assert scan.powers(prefix_trie.BASES[0], exponents).tolist() == [pow(prefix_trie.BASES[0], int(e), 1 << 64) for e in exponents]
