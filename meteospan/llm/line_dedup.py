"""Line deduplication with two Bloom filters.

Every task marks the hashes of its long lines in a filter "seen once" and, at the second document,
in a filter "seen twice". Filters of tasks are merged slice by slice: twice = twice | twice |
(once & once). A line that the merged second filter does not know occurs in one document only;
documents without suspects are done in a map-only pass. Only suspects, as 128-bit digests with
the document id, are shuffled to count documents exactly and to choose the one that keeps the
line; only documents with suspects are shuffled to be rewritten.

Broadcast: the second filter, ``2 ** BITS / 8`` bytes (16 MB) at any size of input. With over some
10**8 long lines it fills up: results stay the same, but more lines are suspects and shuffled; raise
``bits`` for such a corpus.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from meteospan.llm import textscan as ts
from meteospan.llm.columns import fresh

BITS = 27
PROBES = 3
SLICE_BYTES = 1 << 16
_STRIP = " \t\n\x0b\x0c\r"
_LOWER = {i: i + 32 for i in range(65, 91)}


def long_lines(column: pa.Array, least: int):
    """For slices of the texts: rows, and for each line whose key has ``least`` code points the text,
    the number of the line in it, the key's bytes (start, end) and hash."""
    for w in ts.words(column):
        breaks = np.flatnonzero(w.body == 10)
        line = np.searchsorted(breaks, w.start) + w.doc  # differs between any two lines
        begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, int)
        ends = np.concatenate([begins[1:], [len(line)]]).astype(int) - 1 if len(line) else begins
        start, end, doc = w.start[begins], w.end[ends], w.doc[begins]
        points = np.zeros(len(w.body) + 1, np.int64)
        np.cumsum((w.body & 0xC0) != 0x80, out=points[1:])
        keep = points[end] - points[start] >= least
        start, end, doc = start[keep], end[keep], doc[keep]
        number = np.searchsorted(breaks, start) - np.searchsorted(breaks, w.base[doc])
        yield w, doc, number, start, end, ts.span_hashes(w.body, start, end)


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, one column for each probe."""
    shift = np.uint64(64 - bits)
    return np.stack([ts.mix(hashes + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) >> shift for j in range(PROBES)], 1).astype(np.int64)


def _set(filter_: np.ndarray, positions: np.ndarray) -> None:
    np.bitwise_or.at(filter_, positions >> 3, (1 << (positions & 7)).astype(np.uint8))


def _has(filter_: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return ((filter_[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1).all(1)


def _packed(part: np.ndarray) -> bytes:
    """Bytes of a slice, or a list of its bits where that is shorter."""
    n = int(np.unpackbits(part).sum())
    if 4 * n < len(part):
        return b"\x00" + np.flatnonzero(np.unpackbits(part, bitorder="little")).astype("<u4").tobytes()
    return b"\x01" + part.tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    if raw[0]:
        return np.frombuffer(raw, np.uint8, offset=1).copy()
    part = np.zeros(size, np.uint8)
    _set(part, np.frombuffer(raw, "<u4", offset=1).astype(np.int64))
    return part


def twice_filter(docs: DataFrame, least: int, bits: int) -> np.ndarray:
    """The merged filter of lines seen in two documents or more. ``docs`` has the column ``text``."""
    size = min(SLICE_BYTES, (1 << bits) // 8)
    schema = "slice int, turn int, once binary, twice binary"

    def rows(once, twice, turn):
        for i in range(0, len(once), size):
            a, b = once[i : i + size], twice[i : i + size]
            if a.any():
                yield i // size, turn, _packed(a), _packed(b)

    def batch_of(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["slice", "turn", "once", "twice"]
        )

    def build(batches):
        once, twice = np.zeros((1 << bits) // 8, np.uint8), np.zeros((1 << bits) // 8, np.uint8)
        turn = 0
        for batch in batches:
            for _, doc, _, _, _, code in long_lines(batch.column(0), least):
                order = np.lexsort((code, doc))
                code, doc = code[order], doc[order]
                first = np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]) if len(code) else np.zeros(0, bool)
                code, times = np.unique(code[first], return_counts=True)
                if not len(code):
                    continue
                turn ^= int(code[0]) & 0x7FFFFFFF
                at = probes(code, bits)
                _set(twice, at[(times > 1) | _has(once, at)].ravel())
                _set(once, at.ravel())
        found = list(rows(once, twice, turn % 64))
        for i in range(0, len(found), 64):
            yield batch_of(found[i : i + 64])

    def merge(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for number, turn, once, twice in zip(*[c.to_pylist() for c in batch.columns]):
                a, b = _unpacked(once, size), _unpacked(twice, size)
                if number in held:
                    _, once_, twice_ = held[number]
                    twice_ |= b | (once_ & a)
                    once_ |= a
                else:
                    held[number] = [turn, a, b]
        for number, (turn, a, b) in held.items():
            yield batch_of([(number, turn, _packed(a), _packed(b))])

    slices = (1 << bits) // 8 // size
    merged = docs.mapInArrow(build, schema).repartition("slice", "turn").mapInArrow(merge, schema).repartition("slice").mapInArrow(merge, schema)
    whole = np.zeros(slices * size, np.uint8)
    for row in merged.select("slice", "twice").toLocalIterator():  # at most 2 ** bits / 8 bytes
        whole[row[0] * size : (row[0] + 1) * size] = _unpacked(bytes(row[1]), size)
    return whole


def line_key(line: str) -> str:
    return line.strip(_STRIP).translate(_LOWER)


def _suspects(filter_, least: int, bits: int, text_col: str, keep: list[str], name: str):
    """Function for mapInArrow: the kept columns and the suspect lines (number, digest) of each text."""
    kind = pa.list_(pa.struct([("line", pa.int32()), ("key", pa.binary())]))

    def mark(batches):
        table = np.frombuffer(filter_.value, np.uint8)
        for batch in batches:
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for w, doc, number, start, end, code in long_lines(batch.column(text_col), least):
                for i in np.flatnonzero(_has(table, probes(code, bits))) if len(code) else ():
                    digest = blake2b(w.body[start[i] : end[i]].tobytes(), digest_size=16).digest()
                    found[w.rows.start + doc[i]].append({"line": int(number[i]), "key": digest})
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(found, kind)], keep + [name])

    return mark


def dedup_lines(
    docs: DataFrame, least: int = 40, repeats: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
) -> DataFrame:
    """The columns of ``docs``, the text without repeated lines, and ``n_lines`` and ``n_dropped``.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at
    least ``least`` code points that occur in at least ``repeats`` documents lose all their lines,
    except in the document of the largest id holding them. Rows of equal id are one document; rows
    without id are one document that never keeps a line others hold. A null or empty text is one
    empty line and stays as it is. An empty table gives an empty result; columns of the input called
    ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    name, drop = fresh(docs.columns, "_suspects"), fresh(docs.columns, "_drop")
    table = spark.sparkContext.broadcast(twice_filter(docs.select(F.col(text_col).alias("text")), least, bits).tobytes())
    field = T._parse_datatype_string(f"{name} array<struct<line:int,key:binary>>")

    def marked(columns: list[str], frame: DataFrame) -> DataFrame:
        schema = T.StructType([frame.schema[c] for c in columns] + list(field))
        return frame.mapInArrow(_suspects(table, least, bits, text_col, columns, name), schema)

    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text_col) if text_col != "id" else F.col(text_col))
    held = marked(["id"], short).select("id", F.explode(F.array_distinct(F.transform(name, lambda s: s["key"]))).alias("key")).distinct()
    repeated = held.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= repeats)
    gone = held.join(repeated, "key").filter(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id").agg(F.collect_set("key").alias(drop))
    gone = gone.withColumnRenamed("id", "_gone_id")

    kept = docs.columns

    def cut(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, suspects, keys in zip(*[batch.column(c).to_pylist() for c in (text_col, name, drop)]):
                keys = set(keys or ())
                lines = (text or "").split("\n")
                out = {s["line"] for s in suspects if s["key"] in keys}
                n_lines.append(len(lines))
                n_dropped.append(len(out))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else text)
            arrays = [pa.array(texts, batch.column(c).type) if c == text_col else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], kept + ["n_lines", "n_dropped"])

    both = marked(docs.columns, docs)
    n_lines = (F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))).cast("bigint")
    done = both.filter(F.size(name) == 0).drop(name).withColumns({"n_lines": n_lines, "n_dropped": F.lit(0).cast("bigint")})
    open_ = both.filter(F.size(name) > 0).join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")), "left").drop("_gone_id")
    result = T.StructType(docs.schema.fields + list(T._parse_datatype_string("n_lines long, n_dropped long")))
    return done.unionByName(open_.mapInArrow(cut, result))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_sql() -> str:
    strip = "regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')"
    return f"""
WITH l AS (SELECT doc_id, line, i, translate({strip}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
r AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT doc_id, line, i, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id"""
