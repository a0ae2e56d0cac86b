"""Token ids in binary shards of independent zstandard frames.

A shard is a row of frames with whole documents, a skippable frame with the index of the documents
and, last, the seek table of the public seekable format: compressed size, size and checksum (low
half of XXH64 of the content) of every frame. Any zstandard tool unpacks a shard to its raw ids; a
reader that wants some documents reads the tail, then only the frames that hold them.

Texts are encoded where they lie; only ids (two bytes each, where the vocabulary allows) are
dealt out to shards by ranges of doc_id, whose bounds come from approximate quantiles of that column.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from meteospan.llm import textscan as ts
from meteospan.llm.files import filesystem, whole_file
from meteospan.llm.pieces import PieceCache
from meteospan.llm.store import new_folder, written

# Fixed values of the public format.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
CHECKSUMS = 1 << 7

FRAME_BYTES = 1 << 18
SHARD_DOCS = 1 << 20
_INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("n_tokens", "<i8"), ("frame", "<u4")])


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class ShardWriter:
    """Writes documents, in the order given, to a binary stream."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.pack = zstandard.ZstdCompressor(level=3)
        self.held: list[bytes] = []
        self.size = 0
        self.entries: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > FRAME_BYTES:
            self._frame()
        self.index.append((doc_id is not None, doc_id or 0, len(ids) // self.width, len(self.entries)))
        self.held.append(ids)
        self.size += len(ids)

    def _frame(self) -> None:
        raw = b"".join(self.held)
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        index = struct.pack("<B", self.width) + self.pack.compress(np.array(self.index, _INDEX).tobytes())
        self.out.write(_skippable(SKIPPABLE, index))
        self.entries.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        self.out.write(_skippable(SEEK_TABLE, table + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_FOOTER)))


class ShardReader:
    """Reads the documents of a shard; ``source`` is a random-access file."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_FOOTER or not flags & CHECKSUMS:
            raise ValueError("the file ends without a seek table with checksums")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.table, self.at = table, np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        raw = source.read_at(int(table[-1, 0]), int(self.at[n - 1]))
        self.width = raw[8]
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:]), _INDEX)

    def documents(self, wanted: set[int] | None = None):
        """``doc_id, ids before it in the shard, ids`` in file order; only frames with a wanted document are unpacked."""
        unpack = zstandard.ZstdDecompressor()
        kind = np.dtype(f"<u{self.width}")
        before = np.cumsum(self.index["n_tokens"]) - self.index["n_tokens"]
        first = np.searchsorted(self.index["frame"], np.arange(len(self.table)))
        loaded, content = -1, b""
        for i, entry in enumerate(self.index):
            doc_id = int(entry["doc_id"]) if entry["known"] else None
            if wanted is not None and doc_id not in wanted:
                continue
            frame = int(entry["frame"])
            if frame != loaded:
                content = unpack.decompress(self.source.read_at(int(self.table[frame, 0]), int(self.at[frame])), max_output_size=int(self.table[frame, 1]))
                if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.table[frame, 2]:
                    raise ValueError(f"checksum of frame {frame} is wrong")
                loaded = frame
            at = int(before[i] - before[first[frame]]) * self.width
            yield doc_id, int(before[i]), np.frombuffer(content, kind, int(entry["n_tokens"]), at)


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(1)
def word_cache(path: str) -> PieceCache:
    """Words that this worker has met, in any of its tasks."""
    library = tokenizer(path)
    return PieceCache(lambda words: [e.ids for e in library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)])


def encode_words(column: pa.Array, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, joined, and the number of each text.

    For a tokenizer that drops white space: words between ASCII white space never share a token, so
    the library encodes each distinct word once and a text is the row of its words.
    """
    flat, counts = [], []
    for w in ts.words(column, fold=ts.SAME, size=ts.SLICE):
        ids, size = cache.look_up(w.hashes(), w.body, w.start, w.end)
        total = np.concatenate([[0], np.cumsum(size)])
        flat.append(ids)
        counts.append(np.diff(total[w.first]))
    return np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate([np.zeros(0, np.int64), *counts])


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes the ids of all texts, each with ``end_id`` appended, to shards in ascending id order.

    Returns the written shard table ``shard, path, n_docs, n_tokens, start`` (ids in all shards
    before). A null or empty text is ``end_id`` alone, a null id comes first, rows of equal id are
    ordered by their ids, an empty table gives no shards. Other columns play no part.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = read.count()
    parts = max(-(-n // shard_docs), min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    cuts = [i / parts for i in range(1, parts)]
    bounds = np.array(sorted(set(read.agg(F.percentile_approx("doc_id", cuts, 10_000)).first()[0] or [])) if cuts else [], np.int64)
    width = 2 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    kind = f"<u{width}"

    def encode(batches):
        for batch in batches:
            ids, counts = encode_words(batch.column(1), word_cache(path))
            ends = np.cumsum(counts)
            flat = np.insert(ids.astype(kind), ends, end_id).tobytes()
            cut = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * width
            doc = batch.column(0)
            shard = np.searchsorted(bounds, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
            rows = [flat[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), doc, pa.array(rows, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches):
        """Rows come sorted by shard and doc_id; a shard may go on in the next batch."""
        open_ = None
        for batch in batches:
            for shard, doc_id, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if open_ is None or open_[0] != shard:
                    if open_ is not None:
                        yield done(open_)
                    name = f"{folder}/shard-{shard:06d}.zst"
                    context = whole_file(name)
                    open_ = [shard, name, context, ShardWriter(context.__enter__(), width)]
                open_[3].add(doc_id, ids)
        if open_ is not None:
            yield done(open_)

    def done(open_):
        shard, name, context, writer = open_
        writer.close()
        context.__exit__(None, None, None)
        row = (shard, name, len(writer.index), sum(x[2] for x in writer.index))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], ["shard", "path", "n_docs", "n_tokens"])

    encoded = read.mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = encoded.repartition(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids")
    shards = written(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(shards: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) from the shards of a shard table, all or some documents."""
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                system, plain = filesystem(path)
                with system.open_input_file(plain) as source:
                    rows, held = [], 0
                    for doc_id, before, ids in ShardReader(source, source.size()).documents(wanted):
                        rows.append((doc_id, start + before, len(ids), ids.astype("<u4").tobytes()))
                        held += len(rows[-1][3])
                        if held > 1 << 23:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids"])

    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or the tiny table would be one task
    spread = shards.repartition(parts, "shard").select("path", "start")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shards = write_tokens(docs, path, new_folder(spark, "tokens"))
    return read_tokens(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
