"""Benchmark decontamination with an Aho-Corasick automaton over normalised items.

Texts are normalised to words: A-Z lower-cased, everything that is no letter, digit or non-ASCII
character is a gap. Windows of ``WINDOW`` words of every benchmark item make one automaton over
word numbers; of each document the stretches of words that the benchmark has are scanned once, if long
enough for a window, and the words of each hit are mapped back to offsets of the original text. The
documents never move: one pass without a shuffle.

Broadcast: the windows of the benchmark, whose text is summed first. Up to ``AT_ONCE`` characters
make one automaton; a larger benchmark is cut into parts by item, each with a pass of its own, and
the hits of the parts are joined by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from meteospan.llm import textscan as ts
from meteospan.llm.columns import fresh, row_keys

WINDOW = 13
AT_ONCE = 1 << 20
#: Fixed value: separators of the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
GAPS = ts.separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_TO_WORDS = bytes(0x20 if GAPS[b] else int(b) for b in ts.FOLD)
#: The same words in a text as it stands, A-Z not lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = "n_words long, n_hit long, items array<string>, contaminated boolean, hits array<struct<first:int,end:int>>, spans array<struct<start:int,end:int>>"


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Matcher:
    """The automaton of some benchmark items; built once in each Python worker."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for window in windows_of(split_words(text), size):
                code = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                owners.setdefault(code, set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for code, items_of in owners.items():
            self.automaton.add_word(code, (len(code), sorted(items_of)))
        self.empty = not owners
        self.long_enough = re.compile(b"\x01{%d,}" % min(map(len, owners), default=1))
        self.automaton.make_automaton()

    def stretches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Begin and end of the stretches of known words that have room for the shortest window: all words of
        a window are known, and most texts have few of them in a row."""
        known = bytes(map(self.number.__contains__, words))
        return (m.span() for m in self.long_enough.finditer(known))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Disjoint word ranges covered by windows, and the items with a window inside."""
        if self.empty or not words:
            return [], set()
        ranges: list[list[int]] = []
        items: set[str] = set()
        for begin, end in self.stretches(words):
            for last, (length, owners) in self.automaton.iter(tuple([self.number[w] for w in words[begin:end]])):
                first, after = begin + last - length + 1, begin + last + 1
                items.update(owners)
                # windows end in order but begin in any: swallow earlier ranges that this one reaches
                while ranges and ranges[-1][0] >= first:
                    ranges.pop()
                if ranges and ranges[-1][1] >= first:
                    ranges[-1][1] = after
                else:
                    ranges.append([first, after])
        return [(a, b) for a, b in ranges], items


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text that the word ranges cover."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


def _scanner(items, size: int, text_col: str, keep: list[str], few: int, of: int):
    """Function for mapInArrow; ``items`` is a broadcast list of benchmark items."""
    schema = T._parse_datatype_string(RESULT)

    def scan(batches):
        matcher = Matcher(items.value, size)
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column(text_col).to_pylist():
                words = split_words(text)
                ranges, found = matcher.scan(words)
                n_hit = sum(b - a for a, b in ranges)
                row = (
                    len(words), n_hit, sorted(found), n_hit > 0 and of * n_hit >= few * len(words),
                    [{"first": a, "end": b} for a, b in ranges],
                    [{"start": a, "end": b} for a, b in (spans_of(text, ranges) if ranges else [])],
                )
                for column, value in zip(columns, row):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()] + [
                pa.list_(pa.struct([(a, pa.int32()), (b, pa.int32())])) for a, b in (("first", "end"), ("start", "end"))
            ]
            arrays = [batch.column(c) for c in keep] + [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, keep + schema.names)

    return scan


def _items(benchmark: DataFrame, parts: int, part: int) -> list[tuple[str, str]]:
    mine = benchmark.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part) if parts > 1 else benchmark
    return [(r[0], r[1]) for r in mine.toLocalIterator()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, few: int = 1, of: int = 20, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", at_once: int = AT_ONCE, keep_text: bool = True,
) -> DataFrame:
    """The columns of ``docs`` and ``n_words, n_hit, items, contaminated, hits, spans``; without ``keep_text``
    the texts do not come back from the scan.

    ``hits`` are disjoint ranges of words and ``spans`` the same ranges as code points of the
    original text. A document is contaminated when it has a hit and ``of * n_hit >= few * n_words``.
    A null or empty text has no words, is not contaminated and, as an item, has no windows; an item
    without id is listed as ``null``. Equal rows get equal results; an empty table on either side is
    fine. Columns of the input that bear the name of a result are replaced.
    """
    spark = docs.sparkSession
    names = T._parse_datatype_string(RESULT).names
    keep = [c for c in docs.columns if c.lower() not in names]
    read = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    read = read.filter("text IS NOT NULL")
    total = read.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // at_once))
    # the parts are joined by the content of the row, so there they need the text
    kept = [c for c in keep if keep_text or c != text_col]
    back = keep if parts > 1 else kept
    own = T.StructType([docs.schema[c] for c in back] + list(T._parse_datatype_string(RESULT)))
    passes = [
        docs.mapInArrow(_scanner(spark.sparkContext.broadcast(_items(read, parts, i)), size, text_col, back, few, of), own)
        for i in range(parts)
    ]
    if parts == 1:
        return passes[0]

    # hits of the parts, joined by the content of the row
    keys = {k: v for k, v in row_keys(docs.columns, *[F.col(c) for c in keep]).items()}
    k = list(keys)
    marks = None
    for one in passes:
        hit = one.filter("n_hit > 0").select(*[v.alias(n) for n, v in keys.items()], "hits", "items", "spans").distinct()
        marks = hit if marks is None else marks.union(hit)
    joined = marks.groupBy(*k).agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )
    merge = lambda a, s, e: F.aggregate(
        F.sort_array(a), F.array().cast(f"array<struct<{s}:int,{e}:int>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)[e] >= x[s]),
            F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)[s].alias(s), F.greatest(F.element_at(out, -1)[e], x[e]).alias(e)))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    base = passes[0].drop("hits", "items", "spans", "n_hit", "contaminated").withColumns(keys)
    full = base.join(joined, k, "left").withColumn("hits", merge(F.coalesce("hits", F.array()), "first", "end"))
    # windows of two parts that touch are one range of words; their spans are merged over the gap as well
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["first"])
    return full.withColumn("n_hit", n_hit).select(
        *kept, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (of * F.col("n_hit") >= few * F.col("n_words"))).alias("contaminated"), "hits",
        merge(F.coalesce("spans", F.array()), "start", "end").alias("spans"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their own columns, that are not contaminated."""
    tmp = fresh(docs.columns, "_text")
    judged = contamination(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias(tmp)), benchmark, text_col=tmp, keep_text=False)
    return judged.filter("NOT contaminated").select("_row.*")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op9_sql() -> str:
    norm = "list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {norm.format("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {norm.format("coalesce(text, '')")} AS ws FROM benchmark),
p AS (SELECT item, least(13, len(ws)) AS k, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS win
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM p),
g AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS win
      FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k WHERE len(ws) >= k)),
h AS (SELECT doc_id, i, g.k, item FROM g JOIN p ON p.win = g.win AND p.k = g.k),
w AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)"""
