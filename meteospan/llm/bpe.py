"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs of a piece, keyed by (rank, position); the root is the
leftmost pair of the lowest rank. A merge changes three leaves, each in as many steps as the tree
is high, until the root holds no mergeable pair. The trees of many distinct pieces are kept in
one array and advance together, so that numpy does the work.

Texts are cut into pieces by the classes of their characters, which gives the matches of the
pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ ; a piece that a
task has met is looked up. Rows stay where they are: no shuffle.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from meteospan.llm import textscan as ts
from meteospan.llm.pieces import PieceCache, gather

NONE = np.int64(1) << np.int64(62)
#: Cells of all trees that advance together.
CELLS = 1 << 21
LETTER, NUMBER, BLANK, OTHER = range(4)
# Ranges of letters and numbers that Unicode 16 added; Python's tables may be older.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point; surrogates, which no text holds, are OTHER."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": BLANK}
    classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    classes[[*range(9, 14), 0x85]] = BLANK  # controls that are white space
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            classes[first : last + 1] = kind
    return classes


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: itself where it prints, else
    the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks, ids and bytes of a vocabulary file of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"] if t["special"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes[i] = token
        self.of_byte = np.zeros(256, np.int64)
        for char, b in alphabet.items():
            self.of_byte[b] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; ``NONE`` where they do not merge (or an id is negative)."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[place] == key) & (left >= 0) & (right >= 0), self.order[place], NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece after all merges."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.special:
                out[i] = np.array([self.special[piece]], np.uint32)
            else:
                groups.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for height, members in groups.items():
            step = max(1, CELLS >> (height + 1))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._trees([pieces[i] for i in part], height)):
                    out[i] = ids
        return out

    def _trees(self, pieces: list[bytes], height: int) -> list[np.ndarray]:
        width, n = 1 << height, len(pieces)
        length = np.array([len(p) for p in pieces])
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        inside = np.arange(width) < length[:, None]
        ids[:, :width][inside] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(np.arange(1, width + 1) < length[:, None], np.arange(1, width + 1), width)
        after = np.concatenate([after, np.full((n, 1), width)], 1)
        before = np.tile(np.concatenate([[width], np.arange(width)]), (n, 1))
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.ranks(ids[:, :width], np.take_along_axis(ids, after[:, :width], 1))
        tree[:, width:] = np.where(rank < NONE, (rank << height) | np.arange(width), NONE)
        for level in range(height, 0, -1):
            a = 1 << (level - 1)
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])

        def put(row, leaf, key):
            node = leaf + width
            tree[row, node] = key
            while node[0] > 1:
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            top = tree[row, 1]
            at = top & (width - 1)
            gone = after[row, at]
            far = after[row, gone]
            ids[row, at] = self.made[top >> height]
            ids[row, gone] = -1
            after[row, at] = far
            before[row, far] = at
            put(row, gone, NONE)
            rank = self.ranks(ids[row, at], ids[row, far])
            put(row, at, np.where(rank < NONE, (rank << height) | at, NONE))
            near = before[row, at]
            has = near < width
            r, p = row[has], near[has]
            if len(r):
                rank = self.ranks(ids[r, p], ids[r, at[has]])
                put(r, p, np.where(rank < NONE, (rank << height) | p, NONE))
            row = row[tree[row, 1] < NONE]
        kept = ids[:, :width] >= 0
        flat, count = ids[:, :width][kept].astype(np.uint32), kept.sum(1)
        return np.split(flat, np.cumsum(count)[:-1])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, joined."""
        return self.blob[gather(self.starts[ids], self.sizes[ids])]


def piece_bounds(data: np.ndarray, base: np.ndarray, special: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of all pieces of the texts whose bytes begin at ``base``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = data.tobytes()
    cuts, names = {int(b) for b in base}, []
    for token in special:
        at = raw.find(token)
        while at >= 0:
            end = at + len(token)
            # a special token lies in one text
            if np.searchsorted(base, at, "right") == np.searchsorted(base, end - 1, "right"):
                names.append((at, end))
                cuts |= {at, end}
                at = raw.find(token, end)
            else:
                at = raw.find(token, at + 1)
    code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
    width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    byte = np.concatenate([[0], np.cumsum(width)])
    n = len(code)
    edge = np.zeros(n + 1, bool)  # a text, or the stretch between special tokens, begins or ends
    edge[np.searchsorted(byte, np.array(sorted(cuts)))] = True
    edge[n] = edge[0] = True
    kind = char_classes()[code]
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= edge
    blank = kind == BLANK
    space_before = np.zeros(n, bool)
    space_before[1:] = (code[:-1] == 32) & ~edge[1:n]
    bound = np.zeros(n + 1, bool)
    bound[:n] = change[:n] & (blank | ~space_before)
    bound[:n] |= blank & change[1:] & ~edge[1:]
    bound[n] = True
    quote = np.flatnonzero((code == 39) & bound[:n] & change[1:] & ~edge[1:])
    if len(quote):
        letters = np.concatenate([code, [0, 0]])
        a, b = letters[quote + 1], letters[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~edge[np.minimum(quote + 2, n)]
        size = np.where(one, 1, np.where(two, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        bound[quote + 1] = False
        stop = quote + 1 + size
        inside = ~change[np.minimum(stop, n)]
        bound[stop[inside]] = True
    for at, end in names:
        a, b = np.searchsorted(byte, [at, end])
        bound[a + 1 : b] = False
        bound[[a, b]] = True
    points = byte[np.flatnonzero(bound)]
    return points[:-1], points[1:]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(1)
def piece_cache(path: str) -> PieceCache:
    """Pieces that this worker has met, in any of its tasks."""
    return PieceCache(vocabulary(path).merge, 1 << 19)


def encode_texts(column: pa.Array, vocab: Vocabulary, cache: PieceCache) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    out: list[bytes] = []
    for _, data, base in ts.slices(column):
        start, end = piece_bounds(data, base, list(vocab.special))
        ids, size = cache.look_up(ts.span_hashes(data, start, end), data, start, end)
        total = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(start, base)]
        raw = ids.astype("<u4").tobytes()
        out += [raw[4 * a : 4 * b] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
    return out


def small(batch: pa.RecordBatch, column: str, size: int = 1 << 22):
    """Parts of a batch with about ``size`` bytes of a column, so that a worker holds little at once."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _encoding(docs: DataFrame, path: str, text_col: str):
    """Function for mapInArrow and the schema of ``bpe_encode``."""
    keep = [c for c in docs.columns if c != text_col and c.lower() not in ("ids", "n_tokens")]

    def encode(batches):
        for whole in batches:
            for batch in small(whole, text_col):
                ids = encode_texts(batch.column(text_col), vocabulary(path), piece_cache(path))
                arrays = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + arrays, keep + ["ids", "n_tokens"])

    return encode, T.StructType([docs.schema[c] for c in keep] + list(T._parse_datatype_string("ids binary, n_tokens long")))


def _decoding(tokens: T.StructType, path: str, ids_col: str, text_col: str):
    """Function for mapInArrow and the schema of ``bpe_decode``."""
    keep = [c for c in tokens.names if c.lower() != text_col.lower()]

    def decode(batches):
        vocab = vocabulary(path)
        for whole in batches:
            for batch in small(whole, ids_col):
                texts = []
                for raw in batch.column(ids_col):
                    raw = raw.as_py()
                    texts.append(None if raw is None else vocab.decode(np.frombuffer(raw, "<u4")).tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], keep + [text_col])

    return decode, T.StructType([tokens[c] for c in keep] + list(T._parse_datatype_string(f"`{text_col}` string")))


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``ids`` (little-endian unsigned 32-bit) and ``n_tokens``.

    A null or empty text has no ids. Equal texts get equal ids, every row stays, an empty table
    gives an empty result. Special tokens written out in a text are encoded as such. Columns of the
    input called ``ids`` or ``n_tokens`` are replaced. ``path`` names a vocabulary file that every
    worker can open.
    """
    return docs.mapInArrow(*_encoding(docs, path, text_col))


def bpe_decode(tokens: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The columns of ``tokens`` and the text of its ids; null ids give a null text."""
    return tokens.mapInArrow(*_decoding(tokens.schema, path, ids_col, text_col))


def bpe_round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``bpe_decode`` of ``bpe_encode``, in one pass.

    Each of two passes would have a Python worker of its own in every task, with a vocabulary of its
    own; Spark keeps workers for the next stages, so an executor would hold twice as many of them.
    """
    encode, coded = _encoding(docs, path, text_col)
    decode, schema = _decoding(coded, path, "ids", text_col)

    def both(batches):
        yield from decode(encode(batches))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(both, schema)


def op7_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = bpe_round_trip(docs, path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
