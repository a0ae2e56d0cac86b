"""WARC archives by way of a table of chunks.

The source row is cut where it is read; from there a payload travels as rows (record, chunk number, bytes): the writer gets
the chunks of a record in order and streams them into a gzip member, the reader gives chunks back as it unpacks them, both with a
running SHA-256. Equal payloads are found by digest; only digests are grouped, so a page that thousands repeat does not
gather its copies. Chunks are shuffled once, by page, and meet there what they revisit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meteospan.llm.files import filesystem, whole_file
from meteospan.llm.store import new_folder, written

CHUNK = 1 << 16
READ = 1 << 20
# Fixed values of the public format.
VERSION = b"WARC/1.1\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, copy, chunk_no, last, data``, made row by row from the scan.

    A null html is empty, and an empty payload has one chunk without bytes. ``copy`` is a number of the source row, so rows that
    repeat page_id and payload stay records of their own. An empty table gives an empty result.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    read = pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("copy"))
    read = read.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    count = F.greatest(F.ceil(F.col("payload_bytes") / chunk), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("payload", i * chunk + 1, F.lit(chunk)))
    rows = read.select(
        "page_id", "url", "payload_bytes", "payload_digest", "copy", count.alias("n_chunks"), F.posexplode(parts).alias("chunk_no", "data")
    )
    return rows.withColumn("last", F.col("chunk_no") == F.col("n_chunks") - 1).drop("n_chunks")


def revisits(chunks: DataFrame, least: int = 100) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of the records that revisit an equal payload of at least ``least`` bytes: all but that of
    the smallest page_id. A null page_id is never the one revisited. Only ids and digests are grouped."""
    keyed = chunks.filter(F.col("chunk_no") == 0).select("page_id", "payload_bytes", "payload_digest").filter(F.col("payload_bytes") >= least)
    first = keyed.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 AND refers_to IS NOT NULL")
    again = keyed.join(first, "payload_digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.select("page_id", "payload_digest", "refers_to").distinct()


def _typed(chunks: DataFrame, least: int) -> DataFrame:
    """Chunk rows with ``record_type`` and ``refers_to``, dealt out by page; what they revisit is joined in that one exchange.
    Of a revisit one chunk without bytes stays."""
    key = F.struct(F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)))
    named = revisits(chunks, least).groupBy(F.xxhash64(key).alias("_key")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_digest"), "refers_to"))).alias("_again")
    )
    dealt = chunks.withColumn("_key", F.xxhash64(key)).repartition("_key")
    own = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_digest")
    rows = dealt.hint("merge").join(named, "_key", "left").withColumn("refers_to", F.try_element_at("_again", own)).drop("_again")
    new = F.col("refers_to").isNull()
    kept = rows.filter(new | (F.col("chunk_no") == 0)).withColumns(
        {"record_type": F.when(new, "response").otherwise("revisit"), "data": F.when(new, F.col("data")).otherwise(F.lit(b"")), "last": F.col("last") | ~new}
    )
    return kept.sortWithinPartitions("_key", "page_id", "copy", "chunk_no").drop("_key", "copy")


def _line(name: str, value) -> bytes:
    return f"{name}: {str(value).replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode()


def _uri(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return None if number == "null" else int(number)


def head_of(row: dict, date: str) -> bytes:
    """Headers of a record, up to the first byte of the payload."""
    new = row["record_type"] == "response"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + _line("Content-Length", row["payload_bytes"]) + b"\r\n"
    head = VERSION + _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", _uri(row["page_id"])) + _line("WARC-Date", date)
    if row["url"] is not None:
        head += _line("WARC-Target-URI", row["url"])
    head += _line("WARC-Payload-Digest", f"sha256:{row['payload_digest']}") + _line("Content-Type", "application/http;msgtype=response")
    if not new:
        head += _line("WARC-Profile", IDENTICAL) + _line("WARC-Refers-To", _uri(row["refers_to"])) + _line("X-Payload-Length", row["payload_bytes"])
    return head + _line("Content-Length", len(http) + (row["payload_bytes"] if new else 0)) + b"\r\n" + http


def write_warc(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", least: int = 100) -> DataFrame:
    """Writes the chunk table to gzipped archives, one for each partition of page_id, and returns the
    written table ``path, n_records``. A lost task writes the same archive again.

    Of records with equal payloads of at least ``least`` bytes the one of the smallest page_id is a response and the others
    revisit it. Rows that repeat page_id and payload are all of the same type. A null page_id or url is written as such; an empty table
    gives no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        context, n, pack, running, due = None, 0, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if context is None:
                    context = whole_file(name)
                    out = context.__enter__()
                if row["chunk_no"] == 0:
                    pack, running, due = zlib.compressobj(1, wbits=31), hashlib.sha256(), row
                    out.write(pack.compress(head_of(row, date)))
                    n += 1
                running.update(row["data"])
                out.write(pack.compress(row["data"]))
                if row["last"]:
                    if due["record_type"] == "response" and running.hexdigest() != due["payload_digest"]:
                        raise ValueError(f"chunks of page {row['page_id']} do not make its payload")
                    out.write(pack.compress(b"\r\n\r\n") + pack.flush())
        if context is not None:
            context.__exit__(None, None, None)
            yield pa.RecordBatch.from_pylist([{"path": name, "n_records": n}])

    return written(_typed(chunks, least).mapInArrow(write, "path string, n_records long"), "archives")


class Unpacker:
    """Unpacks gzip members from a stream; ``take`` gives bytes as they come."""

    def __init__(self, stream):
        self.stream, self.unpack, self.rest = stream, zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """Some bytes, or none at the end."""
        while True:
            data = self.rest or self.stream.read(READ)
            if not data:
                return b""
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            out = self.unpack.decompress(data, READ)
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                return out


def records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of the records of an archive, in order; the row of the last chunk bears the digest
    and the size of the payload."""
    source, held = Unpacker(stream), b""

    def until(mark: bytes) -> bytes:
        nonlocal held
        while (at := held.find(mark)) < 0:
            more = source.more()
            if not more:
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return b""
            held += more
        out, held = held[:at], held[at + len(mark) :]
        return out

    def fields(head: bytes) -> dict[str, str]:
        return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}

    while head := until(b"\r\n\r\n"):
        warc = fields(head)
        http = until(b"\r\n\r\n")
        left = int(warc["content-length"]) - len(http) - 4
        running, number, size = hashlib.sha256(), 0, left
        row = {"page_id": _page(warc["warc-record-id"]), "record_type": warc["warc-type"], "refers_to": None}
        if row["record_type"] == "revisit":
            row["refers_to"] = _page(warc["warc-refers-to"])
        digest = warc["warc-payload-digest"].rpartition(":")[2]
        while True:
            want = min(left, chunk)
            while len(held) < want:
                more = source.more()
                if not more:
                    raise ValueError("the archive ends inside a payload")
                held += more
            data, held = held[:want], held[want:]
            running.update(data)
            left -= want
            last = left == 0
            if last and row["record_type"] == "response" and running.hexdigest() != digest:
                raise ValueError(f"payload of page {row['page_id']} does not have its digest")
            full = int(warc.get("x-payload-length", size))
            yield row | {"chunk_no": number, "data": data, "last": last, "payload_bytes": full if last else None, "payload_digest": digest if last else None}
            number += 1
            if last:
                break
        while len(held) < 4:
            more = source.more()
            if not more:
                raise ValueError("the archive ends inside a record")
            held += more
        held = held[4:]


READ_SCHEMA = "page_id long, record_type string, refers_to long, chunk_no int, data binary, last boolean, payload_bytes long, payload_digest string"


def read_warc(archives: DataFrame) -> DataFrame:
    """The chunk rows of all archives of a table ``path``; rows with ``last`` bear size and digest."""
    kinds = pa.schema(
        [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()),
         ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    )

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, plain = filesystem(path)
                with system.open_input_stream(plain, compression=None) as stream:
                    rows, held = [], 0
                    for row in records(stream):
                        rows.append(row)
                        held += len(row["data"])
                        if held > 1 << 23 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, kinds)

    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or the tiny table would be one task
    return archives.select("path").repartition(parts, "path").mapInArrow(read, READ_SCHEMA)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archives = write_warc(chunk_table(pages), new_folder(spark, "warc"))
    return read_warc(archives).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sql() -> str:
    return """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND payload_bytes >= 100"""
