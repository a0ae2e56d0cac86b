"""Near-duplicates by bottom-k sketches from one hash function.

1. A text's sketch is the ``SKETCH`` smallest of its hashed shingles; equal sets are one node (128-bit key).
2. Inverted lists of retained values bring nodes together. A link needs ``needed`` values in both sketches, so it is enough
   to deal out the values of a sketch but for the last ``needed - 1``, frequent values coming last (any order gives the same links).
   Values with many holders are dealt out by blocks of nodes. Lists with the same smallest node are one group.
3. A task gets groups with the texts of their nodes, inverts the sketches, and reads the overlaps of every node with all
   others from the lists. The k smallest values of the union of two sketches are a sample of the union of the sets; pairs whose
   share of common values there is below ``LEAST`` percent are left. Sketches that hold their whole set give the exact value.
4. The rest is confirmed on the full sets. Nodes already in one component are not compared again, so a task returns a forest.
   A long group is cut into blocks, each with the group's first node; what is not in one component by then is compared block by block.
5. Components by large-star/small-star.

With similarity s of 0.8 or more the number of common values in a union sketch of 64 is binomial at least; it is below
45 % with a chance under 1e-8 for a single link. Nothing else can lose a link: no group, partner or candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meteospan.llm.components import components
from meteospan.llm.ngram_join import _node_keys, shingle_sets
from meteospan.llm.pieces import gather
from meteospan.llm.scan import SHARES, lookup
from meteospan.llm.store import written

SKETCH = 64
LEAST = 45
#: Values known as frequent, at most; they decide the order of the values only.
FREQUENT = 1 << 18
#: Nodes of one list at least, before a value's list is dealt out by blocks.
HELD = 4096
#: Shingles of one search task.
BLOCK = 1 << 19
#: Texts that are looked up with a broadcast list of their ids; if there are more, all texts are shuffled.
FEW = 1 << 19


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Values that two sketches have in common at least, if the larger set of a linked pair has ``n`` shingles."""
    return np.where(100 * n <= percent * SKETCH, -(-percent * n // 100), -(-LEAST * np.minimum(n, SKETCH) // 100))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """``id, hash, n, node, sketch`` of every row of ``id, hash, text``."""

    def encode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, code, cut in shingle_sets(batch.column(2), size):
                n = np.diff(cut)
                held = np.minimum(n, SKETCH)
                offsets = np.concatenate([[0], np.cumsum(held)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(n.astype(np.int64)), pa.array(_node_keys(code, cut), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(code[gather(cut[:-1], held)].view(np.int64))),
                    ],
                    ["id", "hash", "n", "node", "sketch"],
                )
                at += len(n)

    return docs.mapInArrow(encode, "id long, hash long, n long, node binary, sketch array<long>")


def _frequent(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Values of many nodes, sorted, with their counts; every partition counts all of its values and names those that it saw more than once."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[times > 1]), pa.array(times[times > 1])], ["value", "times"])

        for batch in batches:
            held.append(np.asarray(batch.column(0).flatten()))
            n += len(held[-1])
            if n >= 1 << 21:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    counts = nodes.select("sketch").mapInArrow(count, "value long, times long").groupBy("value").agg(F.sum("times").alias("times"))
    top = counts.filter("times > 4").orderBy(F.desc("times"), "value").limit(FREQUENT).toPandas()
    order = np.argsort(top["value"].to_numpy(np.int64))
    return top["value"].to_numpy(np.int64)[order], top["times"].to_numpy(np.int64)[order]


def _entries(nodes: DataFrame, percent: int, frequent) -> DataFrame:
    """``value, block, blocks, node, n``: the values by which a node is brought together with others, rare ones first."""

    def deal(batches) -> Iterator[pa.RecordBatch]:
        value, times, blocks = frequent.value
        for batch in batches:
            lists = batch.column("sketch")
            code, size = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
            row = np.repeat(np.arange(len(size)), size)
            count = np.zeros(len(code), np.int64)
            cut = np.ones(len(code), np.int64)
            if len(value):
                at = np.minimum(np.searchsorted(value, code), len(value) - 1)
                known = value[at] == code
                count[known], cut[known] = times[at[known]], blocks[at[known]]
            n = np.asarray(batch.column("n"))
            take = size - needed(n, percent) + 1
            order = np.lexsort((code, count, row))
            rank = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
            order = order[rank < take[row]]
            node = batch.column("node").take(pa.array(row[order]))
            key = np.frombuffer(b"".join(batch.column("node").to_pylist()), ">u8").reshape(-1, 2)[:, 0].astype(np.int64)
            block = (key[row[order]] & 0x7FFFFFFF) % cut[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(code[order]), pa.array(block.astype(np.int32)), pa.array(cut[order].astype(np.int32)), node, pa.array(n[row[order]])],
                ["value", "block", "blocks", "node", "n"],
            )

    return nodes.select("node", "n", "sketch").mapInArrow(deal, "value long, block int, blocks int, node binary, n long")


def candidate_groups(entries: DataFrame, percent: int) -> DataFrame:
    """``hub, node, n``: nodes that hold a value, and whose sizes allow a link with another holder, under the smallest of them.

    The many lists of a family mostly begin with the same node, so they become one group. What meets in a list meets in its group.
    """

    def runs(batches) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            value, block = np.asarray(table.column("value")), np.asarray(table.column("block"))
            new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (block[1:] != block[:-1])])) if len(value) else np.zeros(0, int)
            if len(new) > 1:
                yield from lists(table.slice(0, new[-1]).combine_chunks(), new)
            rest = table.slice(new[-1]) if len(new) else rest
        if rest is not None and rest.num_rows:
            yield from lists(rest.combine_chunks(), np.array([0, rest.num_rows]))

    def lists(table: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, value, blocks = (np.asarray(table.column(c)) for c in ("n", "value", "blocks"))
        run = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        inner = np.flatnonzero(run[1:] == run[:-1])
        # in order of size within the run: a neighbour close enough, or in another block
        near = 100 * n[inner] >= percent * n[inner + 1]
        keep = blocks > 1
        keep[inner[near]] = True
        keep[inner[near] + 1] = True
        at = np.flatnonzero(keep)
        if not len(at):
            return
        node = table.column("node").combine_chunks().take(pa.array(at))
        names = np.array(node.to_pylist(), object)
        begin = np.flatnonzero(np.concatenate([[True], run[at][1:] != run[at][:-1]]))
        size = np.diff(np.append(begin, len(at)))
        hubs = [None if blocks[at[i]] > 1 else min(names[i : i + k]) for i, k in zip(begin, size)]
        hub = pa.array(np.repeat(np.array(hubs, object), size).tolist(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(value[at]), hub, node, pa.array(n[at])], ["value", "hub", "node", "n"])

    dealt = entries.repartition("value", "block").sortWithinPartitions("value", "block", "n")
    found = written(dealt.mapInArrow(runs, "value long, hub binary, node binary, n long"), "lists")
    # fewer than SHARES values are dealt out by blocks, so this table is small
    split = found.filter("hub IS NULL").drop("hub")
    first = split.groupBy("value").agg(F.min("node").alias("hub"))
    return found.filter("hub IS NOT NULL").select("hub", "node", "n").union(split.join(F.broadcast(first), "value").select("hub", "node", "n")).distinct()


def sketch_links(sets: list[np.ndarray], groups: list, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets, each sorted, into their components. Sets of one value in ``groups`` (not None) count as joined."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, groups = [sets[i] for i in order], [groups[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    held = np.minimum(size, SKETCH)
    need = needed(size, percent)
    heads: dict = {}
    comp = np.array([i if g is None else heads.setdefault(g, i) for i, g in enumerate(groups)], np.int64)
    value = np.concatenate([s[:SKETCH] for s in sets]) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), held)
    place = np.arange(len(value)) - np.repeat(np.cumsum(held) - held, held)
    by = np.argsort(value, kind="stable")
    value, owner, place = value[by], owner[by], place[by]
    links = []
    for i, s in enumerate(sets):
        sketch = s[:SKETCH]
        first, end = np.searchsorted(value, sketch, "left"), np.searchsorted(value, sketch, "right")
        met = gather(first, end - first)
        mine = np.repeat(np.arange(len(sketch)), end - first)
        j = owner[met]
        fit = (j < i) & (100 * size[j] >= percent * size[i]) & (comp[j] != comp[i])
        j, mine, theirs = j[fit], mine[fit], place[met[fit]]
        if len(j) < need[i]:
            continue
        at = np.argsort(j, kind="stable")
        j, mine, theirs = j[at], mine[at], theirs[at]
        begin = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
        overlap = np.diff(np.append(begin, len(j)))
        # values below a common one in the union: those of both sketches, common ones once
        before = mine + theirs - (np.arange(len(j)) - np.repeat(begin, overlap))
        common = np.add.reduceat((before < SKETCH).astype(np.int64), begin)
        other = j[begin]
        union = np.minimum(SKETCH, held[i] + held[other] - overlap)
        exact = (size[i] + size[other] - overlap <= SKETCH) & (size[i] <= SKETCH) & (size[other] <= SKETCH)
        able = (overlap >= need[i]) & (100 * common >= np.where(exact, percent, LEAST) * union)
        other, common = other[able], common[able]
        for k in other[np.argsort(-common, kind="stable")].tolist():
            if comp[k] == comp[i]:
                continue
            t = sets[k]
            spot = np.searchsorted(s, t)
            spot[spot == len(s)] = len(s) - 1
            both = int(np.count_nonzero(s[spot] == t))
            if 100 * both >= percent * (len(s) + len(t) - both):
                low, high = sorted((int(comp[i]), int(comp[k])))
                comp[comp == high] = low
                links.append((order[k], order[i]))
    return links


def _search(tasks: DataFrame, sources: DataFrame, docs: DataFrame, size: int, percent: int, few: bool = False) -> DataFrame:
    """Links ``a, b`` found inside each task of ``task, node, group``; a node's text is that of the row which ``sources`` names.
    With ``few`` the texts that no task needs are left out before the shuffle, if up to ``FEW`` are needed."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, tuple[np.ndarray, object]] = {}
        want, group, row = frame["node"].tolist(), frame["group"].tolist(), 0
        for _, code, cut in shingle_sets(pa.array(frame["text"], pa.large_string()), size):
            for d, key in enumerate(_node_keys(code, cut)):
                if key == want[row]:
                    found[key] = (code[cut[d] : cut[d + 1]], group[row])
                row += 1
        names = sorted(found)
        links = sketch_links([found[k][0] for k in names], [found[k][1] for k in names], percent)
        return pd.DataFrame({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, dtype=object)

    placed = tasks.join(sources.select("node", F.col("from.id").alias("_id"), F.col("from.hash").alias("_hash")), "node")
    if few:
        placed = written(placed, "placed")
        needed_ids = written(placed.select("_id", "_hash").distinct(), "needed")
        if needed_ids.count() <= FEW:
            held = needed_ids.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"))
            docs = docs.join(F.broadcast(held), F.col("_i").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("hash")), "left_semi")
    texts = placed.join(docs, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_hash") == F.col("hash")))
    return texts.select("task", "node", "group", "text").groupBy("task").applyInPandas(solve, "a binary, b binary")


def minhash_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row of ``docs``.

    Words are runs without white space, A-Z lower-cased; a text of fewer than ``size`` words is one shingle, a null text or one
    without words has none and is linked with nothing. Texts link when ``100 * |intersection| >= percent * |union|`` of their
    sets (``percent`` of 80 or more, for the bound above to hold). ``component_id`` is the smallest id reachable by links, and
    ``kept`` says whether it is the row's own. Rows with equal ids stay rows of their own. A null id
    never becomes a component_id unless no other is there (then null, and kept). Other columns of the input
    play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    coded = written(sketches(read, size), "sketches")
    nodes = coded.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("id"), F.min(F.struct("id", "hash")).alias("from"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"),
    )
    nodes = written(nodes, "nodes")
    sources = nodes.select("node", "id", "from", "rows")
    value, times = _frequent(nodes)
    bound = max(HELD, int(times.sum()) // SHARES)
    frequent = spark.sparkContext.broadcast((value, times, -(-times // bound)))
    groups = written(candidate_groups(_entries(nodes, percent, frequent), percent), "groups")
    sized = groups.groupBy("hub").agg(F.sum("n").alias("total"), F.count("*").alias("times"))
    sized = written(sized.filter("times > 1").withColumn("blocks", F.ceil(F.col("total") / BLOCK)), "sized")
    rows, shingles = sized.agg(F.sum("times"), F.sum("total")).first()
    whole = lookup(groups, sized, ["hub"], "times", rows or 0)
    block = F.pmod(F.xxhash64("node"), "blocks")
    shared = F.pmod(F.xxhash64("hub"), F.lit(max(1, -(-(shingles or 0) // BLOCK))))
    own = whole.select(F.when(F.col("blocks") > 1, F.xxhash64("hub", block)).otherwise(shared).alias("task"), "node")
    hubs = sized.filter("blocks > 1").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    first = own.union(hubs.select(F.xxhash64("hub", "block"), "hub")).distinct()
    links = written(_search(first.withColumn("group", F.lit(None).cast("binary")), sources, read, size, percent), "links")

    if not sized.filter("blocks > 1").isEmpty():
        # what is outside a long group's largest component is compared with the blocks of the group
        joined = written(components(links), "components").withColumnRenamed("root", "group")
        split = whole.filter("blocks > 1").join(joined, "node", "left").withColumn("group", F.coalesce("group", "node"))
        split = written(split.select("hub", "node", "n", "group", "blocks", "times"), "split")
        share = split.groupBy("hub", "group").agg(F.count("*").alias("members"), F.max("times").alias("times"))
        main = share.groupBy("hub").agg(F.max_by("group", F.struct("members", "group")).alias("main"), F.count("*").alias("parts"), F.max("times").alias("times"))
        rest = lookup(split.drop("times"), main.filter("parts > 1"), ["hub"], "times", rows or 0).withColumn("block", block)
        rest = written(rest.select("hub", "node", "n", "group", "main", "block", "blocks"), "rest")
        few = rest.filter(F.col("group") != F.col("main"))
        # these few fill blocks of their own, so that the whole group is not copied to each block that one of them is in
        parts = written(few.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).alias("parts")), "parts")
        few = few.join(parts, "hub").withColumn("few_block", F.pmod(F.xxhash64(F.lit(1), "node"), "parts"))
        task = lambda a, b: F.xxhash64("hub", a, b).alias("task")
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        left = few.select("hub", "node", "group", "few_block", others).select(task(F.col("few_block"), F.col("other")), "node", "group")
        right = rest.join(parts, "hub").select("hub", "block", "node", "group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("few_block"))
        right = right.select(task(F.col("few_block"), F.col("block")), "node", "group")
        links = links.union(_search(left.union(right).distinct(), sources, read, size, percent, few=True))

    comp = components(links)
    labels = comp.join(sources, "node").groupBy("root").agg(F.min("id").alias("label"))
    known = sources.join(comp.join(labels, "root").select("node", "label"), "node", "left")
    known = known.select("node", F.coalesce("label", "id").alias("component_id"), "rows")
    total = known.agg(F.sum("rows")).first()[0] or 0
    # a node may be a third of all rows
    linked = lookup(coded.filter("node IS NOT NULL").select("id", "n", "node"), known, ["node"], "rows", total).select("id", "n", "component_id")
    alone = coded.filter("node IS NULL").select("id", "n", F.col("id").alias("component_id"))
    done = linked.union(alone).withColumn("component_id", F.coalesce("component_id", "id"))
    return done.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op12_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return minhash_components(docs, size=4, percent=80)


def op12_sql() -> str:
    return """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id)
SELECT *, doc_id = component_id AS kept FROM c"""
