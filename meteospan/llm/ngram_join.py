"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Steps, all exact:

1. Equal sets are one node (128-bit key), so copies are joined once.
2. Tokens (hashed shingles) get a global order: tokens that repeat often inside some partition come
   last. By the prefix principle two sets with enough overlap share one of their first
   ``n - ceil(threshold * n) + 1`` tokens; only these are dealt out. Copies of a passage hardly ever
   get into a prefix.
3. Nodes that meet in a token and pass the length and position filters form a candidate list; equal
   lists (a family of near copies makes one for each shared token) are kept once.
4. A task gets one or more lists with the texts of their nodes and runs a T-occurrence search: an inverted index
   over the sets, short lists merged on a heap, long ones probed by binary search (DivideSkip).
   Nodes already in one component are not compared again, so a task returns a forest, not pairs.
   A long list is cut into blocks, each with the list's hub; blocks whose nodes are not in one
   component by then are searched against each other in a second round.
5. Components of the links by large-star/small-star.

Broadcast: the list of frequent tokens, at most ``HEAVY`` of 8 bytes. It decides the order only;
any order gives the same links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from meteospan.llm import textscan as ts
from meteospan.llm.components import components
from meteospan.llm.pieces import gather
from meteospan.llm.store import written

HEAVY = 1 << 20
#: Tokens sorted at once when frequent ones are counted.
COUNT_AT_ONCE = 1 << 22
#: Shingles of one search task: a longer list of candidates is cut into blocks, short ones share a task.
BLOCK = 1 << 19


def _in_groups(number: np.ndarray, n: int) -> np.ndarray:
    """Order of rows by numbers below ``n``, rows of equal number as they are; small integers are sorted by digits."""
    return np.argsort(number.astype(np.min_scalar_type(n)), kind="stable")


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[ts.Words, np.ndarray, np.ndarray]]:
    """For slices of the texts: distinct shingles, sorted per text, and where each text begins."""
    for w in ts.words(column):
        code, doc, _ = ts.shingles(w.hashes(), w.doc, w.counts(), w.first, size)
        order = np.argsort(code)
        order = order[_in_groups(doc[order], w.n_docs)]
        code, doc = code[order], doc[order]
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        code, doc = code[keep], doc[keep]
        yield w, code, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _node_keys(code: np.ndarray, cut: np.ndarray) -> list[bytes | None]:
    """128-bit keys of the sets: sums over their tokens under two scramblings, and the size."""
    keys = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(ts.mix(code ^ np.uint64(salt)), out=sums[1:])
        keys.append(ts.mix((sums[cut[1:]] - sums[cut[:-1]]) + np.diff(cut).astype(np.uint64) * np.uint64(salt | 1)))
    raw = np.stack(keys, 1).astype(">u8").tobytes()
    sizes = np.diff(cut)
    return [raw[16 * i : 16 * i + 16] if sizes[i] else None for i in range(len(sizes))]


def _heavy_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """Tokens of many texts, most frequent first, bounded by ``HEAVY``. Every partition counts
    all of its tokens in runs and names those that it saw more than once."""

    def count(batches):
        held, n = [], 0

        def flush():
            token, times = np.unique(np.concatenate(held), return_counts=True)
            token, times = token[times > 1], times[times > 1]
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(times)], ["token", "times"])

        for batch in batches:
            for _, code, _ in shingle_sets(batch.column(0), size):
                held.append(code)
                n += len(code)
                if n >= COUNT_AT_ONCE:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    top = counts.filter("times > 8").orderBy(F.desc("times"), "token").limit(HEAVY).select("token")
    return np.sort(np.fromiter((r[0] for r in top.toLocalIterator()), np.int64).view(np.uint64))


def _prefixes(docs: DataFrame, size: int, percent: int, heavy) -> DataFrame:
    """``id, n, node, tokens``: set size, key and prefix tokens in the global order of every text."""

    def encode(batches):
        top = heavy.value
        table = np.zeros(1 << 22, bool)
        table[(top & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            at = 0
            for w, code, cut in shingle_sets(batch.column(1), size):
                late = table[(code & np.uint64((1 << 22) - 1)).astype(np.int64)]
                maybe = np.flatnonzero(late)
                if len(maybe):
                    found = np.minimum(np.searchsorted(top, code[maybe]), len(top) - 1)
                    late[maybe] = top[found] == code[maybe]
                n = np.diff(cut)
                doc = np.repeat(np.arange(len(n)), n)
                order = _in_groups(2 * doc + late, 2 * len(n))
                ranked = code[order]
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                rank = np.arange(len(code)) - np.repeat(cut[:-1], n)
                first = ranked[rank < np.repeat(length, n)].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(n)), pa.array(n.astype(np.int64)), pa.array(_node_keys(code, cut), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(first)),
                    ],
                    ["id", "n", "node", "tokens"],
                )
                at += len(n)

    return docs.mapInArrow(encode, "id long, n long, node binary, tokens array<long>")


def _able(small, large, percent: int):
    """Whether sets of these sizes can have the similarity: the smaller inside the larger."""
    return 100 * small >= percent * large


def candidate_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """``list, node, n``: nodes that meet in a prefix token and may be similar, each list once."""

    def runs(batches):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1], "left"))
            rest = batch.slice(cut)
            yield from shared(batch.slice(0, cut), token[:cut])
        if rest is not None:
            yield from shared(rest, rest.column("token").to_numpy())

    def shared(batch, token):
        """Most tokens have one node; only the others are looked at."""
        like = np.zeros(len(token) + 1, bool)
        like[1:-1] = token[1:] == token[:-1]
        several = like[:-1] | like[1:]
        if several.any():
            yield from lists(batch.filter(pa.array(several)).to_pandas())

    def lists(frame):
        token = frame["token"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        end = np.concatenate([start[1:], [len(token)]])
        n, left, node = frame["n"].to_numpy(), frame["left"].to_numpy(), frame["node"].to_numpy()
        out_list, out_node, out_n = [], [], []
        fit = end - start > 1
        two = np.flatnonzero(end - start == 2)  # most groups; all at once
        a, b = start[two], start[two] + 1
        fit[two] = _able(np.minimum(n[a], n[b]), np.maximum(n[a], n[b]), percent) & (np.minimum(left[a], left[b]) * (100 + percent) >= percent * (n[a] + n[b]))
        for a, b in zip(start[fit], end[fit]):
            order = np.argsort(n[a:b], kind="stable") + a
            m, r = n[order], left[order]
            if len(order) <= 1024:
                small, large = np.minimum(m[:, None], m), np.maximum(m[:, None], m)
                able = _able(small, large, percent) & (np.minimum(r[:, None], r) * (100 + percent) >= percent * (m[:, None] + m))
                np.fill_diagonal(able, False)
                keep = able.any(1)
            else:
                near = _able(m[:-1], m[1:], percent)
                keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            members = sorted(set(node[order[keep]]))
            if len(members) > 1:
                raw = np.frombuffer(b"".join(members), ">u8").reshape(-1, 2).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = ts.mix(raw).sum(0, dtype=np.uint64).astype(">u8").tobytes()
                size = dict(zip(node[order], m))
                out_list += [key] * len(members)
                out_node += members
                out_n += [size[x] for x in members]
        if out_list:
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_list, pa.binary()), pa.array(out_node, pa.binary()), pa.array(out_n, pa.int64())], ["list", "node", "n"]
            )

    entries = nodes.select("node", "n", F.posexplode("tokens").alias("pos", "token")).select(
        "token", "node", "n", (F.col("n") - F.col("pos")).alias("left")
    )
    dealt = entries.repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(runs, "list binary, node binary, n long").distinct()


def merge_counts(ids: np.ndarray, run: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of some joined lists and how often each occurs. Stretches of ``run`` ids are
    counted first; the counted runs are merged two by two, the shortest first, from a heap."""
    heap = []
    for i, at in enumerate(range(0, max(len(ids), 1), run)):
        x, n = np.unique(ids[at : at + run], return_counts=True)
        heap.append((len(x), i, x, n))
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, m = heapq.heappop(heap)
        _, _, b, n = heapq.heappop(heap)
        place = np.searchsorted(b, a)
        met = place < len(b)
        met[met] = b[place[met]] == a[met]
        n = n.copy()
        n[place[met]] += m[met]
        x, n = np.insert(b, place[~met], a[~met]), np.insert(n, place[~met], m[~met])
        heapq.heappush(heap, (len(x), turn, x, n))
        turn += 1
    return heap[0][2:]


def divide_skip(ids: np.ndarray, length: np.ndarray, least: int, mu: float = 0.01, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur in at least ``least`` of the lists, and their counts. ``ids`` are the lists, each
    sorted, one after the other, and ``length`` their lengths.

    The longest lists are set aside and the others merged; ids that the merge counts often enough
    are looked up in the long lists by binary search, as long as they can still reach ``least``.
    """
    if least < 1 or len(length) < least:
        return merge_counts(ids[:0])
    start = np.cumsum(length) - length
    order = np.argsort(length, kind="stable")
    n_long = min(least - 1, int(least / (mu * max(int(length.max()), 2).bit_length() + 1)))
    short, long = order[: len(order) - n_long], order[len(order) - n_long :]
    found, count = merge_counts(ids[gather(start[short], length[short])])
    top = int(ids.max()) + 1
    for at in range(0, n_long, block):
        able = count + (n_long - at) >= least
        found, count = found[able], count[able]
        if not len(found):
            return found, count
        part = long[at : at + block]
        keys = np.repeat(np.arange(len(part)) * top, length[part]) + ids[gather(start[part], length[part])]
        asked = (np.arange(len(part))[:, None] * top + found).ravel()
        place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        count = count + (keys[place] == asked).reshape(len(part), -1).sum(0)
    return found[count >= least], count[count >= least]


def search_links(sets: list[np.ndarray], groups: list, percent: int) -> list[tuple[int, int]]:
    """Links that join the sets into their components: a forest of pairs with
    ``100 * overlap >= percent * union``. Sets of one value in ``groups`` (not None) count as joined."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sets, groups = [sets[i] for i in order], [groups[i] for i in order]
    size = np.array([len(s) for s in sets])
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    heads: dict = {}
    for i, g in enumerate(groups):
        if g is not None:
            parent[i] = heads.setdefault(g, i)
    comp = np.array([root(i) for i in range(len(sets))])
    links = []

    def join(i, j):
        a, b = sorted((int(comp[i]), int(comp[j])))
        comp[comp == b] = a
        parent[b] = a
        links.append((order[i], order[j]))

    owner = np.repeat(np.arange(len(sets)), size)
    tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    by = np.argsort(tokens, kind="stable")
    token, owner = tokens[by], owner[by]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    key, stop = token[begin], np.concatenate([begin[1:], [len(token)]])
    shared = stop - begin > 1
    key, begin, stop = key[shared], begin[shared], stop[shared]
    last_heads: list[int] = []
    for i, s in enumerate(sets):
        n = len(s)
        low = -(-percent * n // 100)
        # a set of a known component is most often close to the first one of it: one exact comparison
        for h in last_heads:
            if comp[h] != comp[i] and size[h] >= low:
                both = len(np.intersect1d(sets[h], s, assume_unique=True))
                if 100 * both >= percent * (n + size[h] - both):
                    join(h, i)
        place = np.searchsorted(key, s)
        inside = place < len(key)
        place, own = place[inside], s[inside]
        place = place[key[place] == own]
        length = stop[place] - begin[place]
        ids = owner[gather(begin[place], length)]
        of = np.repeat(np.arange(len(place)), length)
        fit = (ids < i) & (size[ids] >= low) & (comp[ids] != comp[i])
        ids, of = ids[fit], of[fit]
        # as many lists as have an id left; fewer than the overlap asked for are not worth a merge
        cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, int)
        least = -(-percent * (n + low) // (100 + percent))
        if len(cut) < least:
            continue
        near, overlap = divide_skip(ids, np.diff(np.concatenate([cut, [len(ids)]])), least)
        for j, both in zip(near.tolist(), overlap.tolist()):
            if comp[j] != comp[i] and 100 * both >= percent * (n + size[j] - both):
                join(j, i)
                head = int(comp[i])
                if head not in last_heads:
                    last_heads = [head, *last_heads][:8]
    return links


def _search(tasks: DataFrame, sources: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links ``a, b`` found inside each task of ``task, node, group``.

    A node's text comes from the document that ``sources`` (node, id) names; where several rows
    bear that id, the row whose set has the node's key is taken.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        found: dict[bytes, tuple[np.ndarray, object]] = {}
        want, group, row = frame["node"].tolist(), frame["group"].tolist(), 0
        for w, code, cut in shingle_sets(pa.array(frame["text"], pa.large_string()), size):
            for d, key in enumerate(_node_keys(code, cut)):
                if key == want[row]:
                    found[key] = (code[cut[d] : cut[d + 1]], group[row])
                row += 1
        names = sorted(found)
        links = search_links([found[k][0] for k in names], [found[k][1] for k in names], percent)
        return pd.DataFrame({"a": [names[i] for i, _ in links], "b": [names[j] for _, j in links]}, dtype=object)

    placed = tasks.join(sources, "node").withColumnRenamed("id", "_id")
    texts = placed.join(docs, F.col("_id").eqNullSafe(F.col("id"))).select("task", "node", "group", "text")
    return texts.groupBy("task").applyInPandas(solve, "a binary, b binary")


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` for every row of ``docs``.

    Words are runs without white space, A-Z lower-cased; a text of fewer than ``size`` words is one
    shingle, a null text or one without words has none and is linked with nothing. Two texts link
    when ``100 * |intersection| >= percent * |union|`` of their shingle sets; ``component_id`` is the
    smallest id reachable by links. Rows with equal ids are kept as rows of their own and linked by
    their texts; a null id never becomes a component_id, unless no other is there. An empty table
    gives an empty result; other columns of the input play no part.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    heavy = spark.sparkContext.broadcast(_heavy_tokens(read, size))
    coded = written(_prefixes(read, size, percent, heavy), "prefixes")
    nodes = coded.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sources = written(nodes.select("node", "id"), "nodes")
    lists = written(candidate_lists(nodes, percent), "lists")
    sized = lists.groupBy("list").agg(F.sum("n").alias("total"), F.min("node").alias("hub")).withColumn("blocks", F.ceil(F.col("total") / BLOCK))
    whole = lists.join(sized, "list")
    block = F.pmod(F.xxhash64("node"), "blocks")
    # lists of one hub have most of their nodes in common: in one task each text is needed once, if they are not too many
    load = whole.filter("blocks = 1").select("hub", "node", "n").distinct().groupBy("hub").agg(F.sum("n").alias("load"))
    load = written(load, "loads")
    tasks = max(1, -(-(load.agg(F.sum("load")).first()[0] or 0) // BLOCK))
    whole = whole.join(load, "hub", "left")
    shared = F.pmod(F.when(F.col("load") <= BLOCK, F.xxhash64("hub")).otherwise(F.xxhash64("list")), F.lit(tasks))
    own = whole.select(F.when(F.col("blocks") > 1, F.xxhash64("list", block)).otherwise(shared).alias("task"), "node")
    hubs = sized.filter("blocks > 1").select("list", "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = own.union(hubs.select(F.xxhash64("list", F.col("block").cast("bigint")), "hub")).distinct()
    links = written(_search(first.withColumn("group", F.lit(None).cast("binary")), sources, read, size, percent), "links")

    split = whole.filter("blocks > 1")
    if not split.isEmpty():
        # blocks against each other: nodes outside the list's largest component against all nodes
        joined = written(components(links), "components").withColumnRenamed("root", "group")
        split = written(split.join(joined, "node", "left").withColumn("group", F.coalesce("group", "node")).select("list", "node", "group", "blocks"), "split")
        share = split.groupBy("list", "group").count()
        main = share.groupBy("list").agg(F.max_by("group", "count").alias("main"), F.count("*").alias("parts")).filter("parts > 1")
        rest = split.join(main, "list").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        few = rest.filter("group <> main")
        cut = lambda c: F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
        task = lambda a, b: F.xxhash64("list", a, b).alias("task")
        left = few.select("list", "node", "group", "block", F.explode(cut("blocks")).alias("other")).select(task(F.col("block"), F.col("other")), "node", "group")
        met = few.select("list", F.col("block").alias("few_block")).distinct()
        right = rest.join(met, "list").select(task(F.col("few_block"), F.col("block")), "node", "group")
        links = links.union(_search(left.union(right).distinct(), sources, read, size, percent))

    comp = components(links)
    label = comp.join(sources, "node").groupBy("root").agg(F.min("id").alias("label"))
    labels = comp.join(label, "root").select("node", "label")
    known = sources.join(labels, "node", "left").select("node", F.coalesce("label", "id").alias("component_id"))
    return coded.select("id", "n", "node").join(known, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that bear the smallest id of their component; rows with a null id stay.

    A row equal in id to a kept row is kept with it.
    """
    found = ngram_components(docs, size, percent, id_col, text_col)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ngram_components(docs, size=4, percent=85)


def op1_sql() -> str:
    return """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i : i + 3], ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""
