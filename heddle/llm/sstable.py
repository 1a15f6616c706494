"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of identifier:

    data blocks   entries (shared prefix, suffix and value lengths, suffix, value), restart places
                  every RESTART entries, compressed, with a checksum of the compressed bytes
    index         for each block: first key, place, size, entries, ids before it in the shard
    Bloom filter  BITS_PER_KEY bits a key, probed in HASHES places
    footer        where index and filter are, counts, width of an id, magic

Keys are eight bytes whose order is the identifiers' order; a null identifier is the empty key and
comes first. Values are ids of two bytes if the vocabulary allows, else of four. get() asks
the filter, finds the block by binary search in the sparse index and the entry by binary search
over restart places; entries() reads a shard in order, a block at a time.

Documents are range-partitioned by identifier, so shards are disjoint and ordered, and a
document's place in the corpus is its place in the shard plus the ids of the shards before. A task closes a
shard at SHARD_BYTES and goes on with the next, so a shard, its index and filter have a size that doesn't depend on the corpus.

Cases: a null or empty text is the end id alone; documents that repeat an identifier are all kept,
next to each other, in an order that their texts decide (by hash, then text), so many of them spread over several
shards and places are the same in every run; a null identifier sorts first. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import remove, saved, shared_dir
from heddle.llm.encoding import kept_encoder, tokenizer_path, width_of
from heddle.llm.files import arrow_rows, attempt_name, open_fs, partition_id

MAGIC = b"HSSTABL1"
BLOCK, RESTART, BITS_PER_KEY, HASHES, SHARD_BYTES = 1 << 18, 16, 10, 7, 1 << 28
_FOOTER = struct.Struct("<QQQQQQB")  # index place and size, filter place and size, entries, ids, width
_ENTRY = struct.Struct("<BBI")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.index, self.keys = bytearray(), []
        self.entries = self.ids = 0
        self._fresh()

    def _fresh(self):
        self.body, self.restarts, self.n, self.before, self.first, self.last = bytearray(), [], 0, self.ids, b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        """value: ids of the shard's width; keys must ascend."""
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(len(self.body))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if not self.n:
            self.first = key
        self.body += _ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last, self.n, self.entries, self.ids = key, self.n + 1, self.entries + 1, self.ids + len(value) // self.width
        self.keys.append(key)
        if len(self.body) >= BLOCK:
            self._flush()

    def _flush(self):
        if not self.n:
            return
        raw = bytes(self.body) + b"".join(struct.pack("<I", r) for r in self.restarts) + struct.pack("<I", len(self.restarts))
        data = self.pack(raw)
        data += struct.pack("<I", zlib.crc32(data))
        self.out.write(data)
        self.index += struct.pack("<B", len(self.first)) + self.first + struct.pack("<QIIQ", self.at, len(data), self.n, self.before)
        self.at += len(data)
        self._fresh()

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        raw = struct.pack("<Q", bits) + bloom.tobytes()
        self.out.write(bytes(self.index) + raw)
        self.out.write(_FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(raw), self.entries, self.ids, self.width) + MAGIC)


class Reader:
    """A shard opened for lookups and ordered reading; holds its index and filter, and one block at a time."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        size = file.size()
        tail = self._read(size - _FOOTER.size - len(MAGIC), _FOOTER.size + len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or one that was cut off")
        place, length, self.bloom_at, self.bloom_size, self.count, self.ids, self.width = _FOOTER.unpack(tail[: _FOOTER.size])
        raw, at = self._read(place, length), 0
        self.first, self.blocks, self.bloom = [], [], None
        while at < length:
            n = raw[at]
            self.first.append(raw[at + 1 : at + 1 + n])
            self.blocks.append(struct.unpack_from("<QIIQ", raw, at + 1 + n))
            at += 1 + n + 24

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        at, size, _, _ = self.blocks[i]
        data = self._read(at, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        raw = self.unpack(data[:-4])
        n = struct.unpack("<I", raw[-4:])[0]
        return raw[: -4 - 4 * n], list(struct.unpack(f"<{n}I", raw[-4 - 4 * n : -4]))

    def _walk(self, body: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, more, size = _ENTRY.unpack_from(body, at)
            at += _ENTRY.size
            key = key[:shared] + body[at : at + more]
            yield key, np.frombuffer(body, f"<u{self.width}", size // self.width, at + more)
            at += more + size

    def entries(self):
        """(key, ids, ids before it in the shard), in order."""
        for i, (_, _, _, before) in enumerate(self.blocks):
            body, _ = self._block(i)
            for key, ids in self._walk(body, 0, len(body)):
                yield key, ids, before
                before += len(ids)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self._read(self.bloom_at, self.bloom_size)
        bits = struct.unpack_from("<Q", self.bloom)[0]
        return all(self.bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document (the first, if the identifier repeats), or None."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return None
        for i in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.blocks)):
            if self.first[i] > key:
                break
            body, restarts = self._block(i)
            starts = [next(self._walk(body, r, len(body)))[0] for r in restarts]
            for own, ids in self._walk(body, restarts[max(0, bisect.bisect_left(starts, key) - 1)], len(body)):
                if own == key:
                    return ids
                if own > key:
                    return None
        return None


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Tokenises docs into shards below folder; returns a saved row per shard: shard, part, path, entries, ids, base (ids of the shards before)."""
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")

    schema, width = "shard int, part int, path string, entries long, ids long", width_of(tokenizer, end_id)

    def write(batches):
        encoder, end, writer, part = kept_encoder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes(), None, 0
        fs, root = open_fs(folder)

        def close():
            writer.close()
            writer.out.close()
            return arrow_rows([(partition_id(), part, name, writer.entries, writer.ids)], schema)

        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = batch.slice(at, 200)
                for doc, raw in zip(rows["doc_id"].to_pylist(), encoder.encode(rows["text"].to_pylist()), strict=True):
                    if writer is None:
                        fs.create_dir(root, recursive=True)
                        name = attempt_name(partition_id(), ".sst")
                        writer = Writer(fs.open_output_stream(f"{root}/{name}"), width)
                    writer.add(key_of(doc), raw + end)
                    if writer.at + len(writer.body) >= SHARD_BYTES:
                        yield close()
                        writer, part = None, part + 1
        if writer is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    shards = saved(rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(write, schema))
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return shards.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """What the shards hold: doc_id, start, n_tokens, ids_crc32."""

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches):
        fs, root = open_fs(folder)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{path}") as file:
                    rows = []
                    for key, ids, before in Reader(file).entries():
                        rows.append((id_of(key), base + before, len(ids), zlib.crc32(ids.astype("<u4"))))
                        if len(rows) == 20_000:
                            yield arrow_rows(rows, schema)
                            rows = []
                    yield arrow_rows(rows, schema)

    spread = max(1, shards.count())
    return shards.select("path", "base").repartition(min(spread, 100_000)).mapInArrow(read, schema)


def token_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes shards to the shared folder, reads them back and deletes them: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_dir(docs.sparkSession, "sst")
    try:
        return saved(read_shards(write_shards(docs, folder, id_col, text_col, tokenizer, end_id), folder))
    finally:
        remove(docs.sparkSession, folder)
