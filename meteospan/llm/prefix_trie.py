"""Prefix trie of conversations that share a head, by composable fingerprints.

A rebuilt conversation is a head of a base conversation and a suffix of its own. Its texts are never put together:

1. Turns get digests, and each stored conversation the running products of the monoid of (length, sum of digest * base ** position)
   modulo 2**64, two of them with independent digests and bases. The head of the base composes with the quotient of two of
   the own products to the fingerprint of every rebuilt prefix.
2. A fingerprint at a depth is a node. All members have to refer to stored turns of one digest there; as a fingerprint without its
   last turn is the parent's, that proves the prefixes equal turn by turn. That a digest stands for one role and text is proved on the stored turns.
3. A node's representative is its smallest member, so each conversation represents a chain of nodes down to its own end
   (or none). Sums over a subtree are those of the rest of the representative's chain, and of the whole chains of the other members. So
   the depth of the trie costs no rounds.
4. Members that end at a node are dealt out by ranges and become stretches of text; a digest reads stretches in a stream.

No conversation, node or base is gathered in one task: running products go by ranges (``scan.running``), and lookups of keys with many rows
go by a broadcast of fewer than ``scan.SHARES`` keys (``scan.lookup``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from meteospan.llm.columns import whole
from meteospan.llm.scan import lookup, powers, running
from meteospan.llm.store import written

#: Odd bases of the two fingerprints.
BASES = (0xD1342543DE82EF95, 0x9FB21C651E98DF25)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Ids of a stretch of text under one digest.
STRETCH = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _digests(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(0x2545F491), text, F.char_length(text), role).alias("d2")]


def _turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    read = rows.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), whole(F.col(role_col)).alias("role"), whole(F.col(text_col)).alias("text"))
    return read.filter("conv IS NOT NULL")


def _one_text_per_digest(turns: DataFrame) -> None:
    """Fails if two different turns have the same digest (chance below n**2 / 2**128)."""
    distinct = turns.select("role", "text", *_digests(F.col("role"), F.col("text"))).distinct()
    if not distinct.groupBy("d1", "d2").count().filter("count > 1").isEmpty():
        raise ValueError("two different turns have the same digest")


def _paths(placed: DataFrame, head: Column, base: Column, longest_head: int) -> tuple[DataFrame, int, int]:
    """``conv, depth, f1, f2, d1, d2, bytes, last, from_conv, from_pos`` of every rebuilt prefix, and the numbers of rows and conversations."""
    turn = F.struct("pos", "s1", "s2", "d1", "d2", "bytes")
    convs = placed.groupBy("conv").agg(
        F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") <= longest_head, turn))).alias("head")
    )
    convs = written(convs, "convs")
    bases = convs.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    at = lambda column, field: F.coalesce(F.get("head", (F.col("h") - 1).cast("int"))[field], F.lit(0).cast("long")).alias(column)
    k = F.least("h", F.coalesce(F.size("base_head"), F.lit(0)))
    plans = convs.withColumns({"h": F.least(head, F.lit(longest_head)), "base": base}).join(bases, "base", "left").withColumn("k", k)
    plans = plans.select(
        "conv", "n", "h", "k", "base", F.slice(F.coalesce("base_head", F.array().cast(convs.schema["head"].dataType)), F.lit(1), F.col("k")).alias("base_head"),
        at("own1", "s1"), at("own2", "s2"), (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
    )
    plans = written(plans, "plans")
    zero = F.lit(0).cast("long")
    root = plans.select("conv", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("d1"), zero.alias("d2"), zero.alias("bytes"),
                        (F.col("length") == 0).alias("last"), F.lit(None).cast("long").alias("from_conv"), F.lit(None).cast("long").alias("from_pos"))
    t = F.explode("base_head").alias("t")
    heads = plans.select("conv", "base", "length", t).select(
        "conv", F.col("t.pos").alias("depth"), F.col("t.s1").alias("f1"), F.col("t.s2").alias("f2"), "t.d1", "t.d2", "t.bytes",
        (F.col("t.pos") == F.col("length")).alias("last"), F.col("base").alias("from_conv"), F.col("t.pos").alias("from_pos"),
    )

    def compose(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: np.asarray(batch.column(c))
            shift = col("h") - col("k")
            depth = col("pos") - shift
            f = []
            for i, inverse in enumerate(INVERSES, 1):
                own = col(f"s{i}").astype(np.int64).view(np.uint64) - col(f"own{i}").astype(np.int64).view(np.uint64)
                f.append((col(f"top{i}").astype(np.int64).view(np.uint64) + own * powers(inverse, shift)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), pa.array(depth), *map(pa.array, f), *[batch.column(c) for c in ("d1", "d2", "bytes")],
                 pa.array(depth == col("length")), batch.column("conv"), batch.column("pos")],
                ["conv", "depth", "f1", "f2", "d1", "d2", "bytes", "last", "from_conv", "from_pos"],
            )

    numbers = plans.agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("length").alias("l")).first()
    end = lambda i: F.coalesce(F.element_at("base_head", -1)[f"s{i}"], zero).alias(f"top{i}")
    top = F.when(F.col("k") > 0, F.col("base_head"))
    asked = plans.withColumn("base_head", top).select("conv", "n", "h", "k", "own1", "own2", end(1), end(2), "length")
    own = lookup(placed, asked, ["conv"], "n", numbers["n"] or 0).filter("pos > h")
    own = own.select("conv", "pos", "s1", "s2", "d1", "d2", "bytes", "h", "k", "own1", "own2", "top1", "top2", "length")
    suffixes = own.mapInArrow(compose, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in root.schema))
    return written(root.union(heads).union(suffixes), "paths"), (numbers["l"] or 0) + numbers["c"], numbers["c"]


def _end_digests(paths: DataFrame) -> DataFrame:
    """``f1, f2, depth, ends_sha256``: SHA-256 of the ids that end at a node, ascending, joined by commas."""

    def stretches(batches) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        emit = lambda: pa.RecordBatch.from_arrays(
            [pa.array([node[0]]), pa.array([node[1]]), pa.array([node[2]]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["depth", "f1", "f2", "first", "ids"]
        )
        for batch in batches:
            for d, f1, f2, conv in zip(*[batch.column(c).to_pylist() for c in ("depth", "f1", "f2", "conv")]):
                if (d, f1, f2) != node or len(ids) == STRETCH:
                    if ids:
                        yield emit()
                    node, ids = (d, f1, f2), []
                ids.append(conv)
        if ids:
            yield emit()

    def digest(batches) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        take = lambda: pa.RecordBatch.from_pylist(out, pa.schema([("depth", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("ends_sha256", pa.string())]))
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["depth"], row["f1"], row["f2"])
                if key != node:
                    if state:
                        out.append(dict(zip(("depth", "f1", "f2"), node), ends_sha256=state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
            yield take()
            out = []
        if state:
            out.append(dict(zip(("depth", "f1", "f2"), node), ends_sha256=state.hexdigest()))
            yield take()

    keys = ["depth", "f1", "f2"]
    ends = paths.filter("last").select(*keys, "conv")
    pieces = ends.repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").mapInArrow(stretches, "depth long, f1 long, f2 long, first long, ids string")
    return pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, "depth long, f1 long, f2 long, ends_sha256 string")


def prefix_trie(
    rows: DataFrame, head: Column, base: Column, longest_head: int,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` of the subtree, ``ends_sha256``, and ``from_conv, from_turn``: which
    stored conversation holds the last turn, and at which place from 1 (null at the root).

    ``head`` and ``base`` are expressions of ``conv``: a conversation is rebuilt from the first ``head`` turns (at most ``longest_head``) of
    conversation ``base``, all if it has fewer, none if it is absent, and from its own turns after its first ``head``.

    Turns stand in the order of their number, a null number first; equal numbers in the order of a hash of role and text, so repeated rows are
    turns of their own. A null role or text is empty. Rows with a null conversation id take no part. Other columns
    play no part. An empty table has no node, not even a root.
    """
    turns = _turns(rows, conv_col, turn_col, role_col, text_col)
    _one_text_per_digest(turns)
    short = turns.select("conv", "turn", *_digests(F.col("role"), F.col("text")), F.octet_length("text").cast("long").alias("bytes"))
    products = {"s1": ("d1", BASES[0]), "s2": ("d2", BASES[1])}
    placed = running(short, "conv", [F.col("turn"), F.col("d1"), F.col("d2")], products, "turns")
    paths, n_paths, n_convs = _paths(placed, head, base, longest_head)

    keys = ["depth", "f1", "f2"]
    same = (F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2"))
    proved = F.when(same, F.count("*")).otherwise(F.raise_error(F.lit("different turns under one fingerprint")).cast("long"))
    nodes = paths.groupBy(*keys).agg(
        F.min("conv").alias("conv"), proved.alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"), F.max("bytes").alias("bytes"),
        F.min_by("from_conv", "conv").alias("from_conv"), F.min_by("from_pos", "conv").alias("from_turn"),
    )
    nodes = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("bytes"), "leaf": (F.col("n_convs") == F.col("n_ends")).cast("long")})
    # the rest of a chain below each of its nodes, that node included
    rest = written(running(nodes, "conv", [F.col("depth").desc()], {"rest_saved": ("saved", 1), "rest_leaves": ("leaf", 1)}, "nodes"), "rest")
    chains = written(
        rest.groupBy("conv").agg(F.min("depth").alias("top"), F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves"), F.count("*").alias("length")), "chains"
    )
    # a chain counts in whole at every node above its top; the rows of a path there are those of no representative
    lengths = chains.withColumn("length", F.col("length") + F.col("top"))
    above = lookup(paths.select("conv", *keys), lengths, ["conv"], "length", n_paths).filter("depth < top")
    above = written(above.select(*keys, "conv", "top", "all_saved", "all_leaves"), "above")
    more = above.groupBy(*keys).agg(
        F.sum("all_saved").alias("more_saved"), F.sum("all_leaves").alias("more_leaves"), F.count(F.when(F.col("top") == F.col("depth") + 1, 1)).alias("branches")
    )
    owners = rest.select(*keys, F.col("conv").alias("parent"), "n_convs")
    hung = lookup(above.filter("top = depth + 1").select(*keys, "conv", "top"), owners, keys, "n_convs", n_paths)
    hung = hung.select("conv", F.col("top").alias("depth"), "parent")
    found = rest.join(more, keys, "left").join(_end_digests(paths), keys, "left").join(hung, ["conv", "depth"], "left")
    or_none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return found.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"), "n_convs",
        ((F.col("pos") > 1).cast("long") + or_none("branches")).alias("n_children"),
        (F.col("rest_leaves") + or_none("more_leaves")).alias("n_leaves"), (F.col("rest_saved") + or_none("more_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "from_conv", "from_turn",
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    return prefix_trie(rows, head, F.col("conv") - F.pmod("conv", F.lit(5)), longest_head=8).drop("from_conv", "from_turn")


def op11_sql() -> str:
    return """
WITH table8 AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) t(i)),
turns AS MATERIALIZED (
  SELECT conv_id AS conv, list({r: coalesce(role, ''), t: coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS MATERIALIZED (
  SELECT conv, ts, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 9 AS h FROM turns, table8),
rebuilt AS MATERIALIZED (
  SELECT a.conv, list_concat(coalesce(b.ts[1 : a.h], []), a.ts[a.h + 1 :]) AS ts
  FROM heads a LEFT JOIN turns b ON b.conv = a.conv - a.conv % 5),
paths AS MATERIALIZED (
  SELECT conv, d AS depth, ts[1 : d] AS p, len(ts) = d AS last FROM (SELECT conv, ts, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
nodes AS MATERIALIZED (
  SELECT depth, p, min(conv) AS conv_id, count(*) AS n_convs, bool_and(last) AS leaf, (count(*) - 1) * coalesce(strlen(p[-1].t), 0) AS saved,
    sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (WHERE last), '')) AS ends_sha256 FROM paths GROUP BY depth, p),
up AS (
  SELECT a.depth, a.p, sum(n.leaf::INT) AS n_leaves, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE n.depth = a.depth + 1) AS n_children
  FROM (SELECT depth, leaf, saved, p, unnest(range(0, depth + 1)) AS d FROM nodes) n JOIN nodes a ON a.depth = n.d AND a.p = n.p[1 : n.d] GROUP BY a.depth, a.p)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN up USING (depth, p) LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = n.p[1 : n.depth - 1]"""
