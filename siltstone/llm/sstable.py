"""Sorted-string tables of token ids.

A shard holds documents in ascending order of their key:

    magic | data blocks | index block | Bloom filter | footer

A data block is a run of entries, compressed as a whole and closed with its crc32; an entry is (length of the prefix it
shares with the key before it, length of the rest of the key, length of the value, rest of the key, value). The index
block has the last key, the place and the length of each data block, so that a lookup reads the footer, asks the Bloom
filter, finds one block by binary search and reads only that. The footer has a fixed length.
"""

from __future__ import annotations

import bisect
import os
import struct
import zlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import binary_list, new_folder, open_store, shuffle_partitions
from siltstone.llm.tokens import encoder

MAGIC = b"SSTOK001"
#: index place, index length, Bloom place, Bloom length, entries, ids, magic
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
#: Bits a key and probes of the Bloom filter: about one wrong "maybe" in a hundred.
BLOOM_BITS, BLOOM_PROBES = 10, 7


def key_of(value) -> bytes:
    """Bytes that sort as the values do: null, then integers by number, then strings by UTF-8."""
    if value is None:
        return b"\x00"
    if isinstance(value, int):
        return b"\x01" + struct.pack(">Q", value + (1 << 63))
    return b"\x02" + str(value).encode()


def value_of(key: bytes):
    if key[:1] == b"\x00":
        return None
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[:1] == b"\x01" else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


def pack_ids(ids: bytes) -> bytes:
    """32-bit ids in the narrowest of 16 and 32 bits, the width first."""
    wide = np.frombuffer(ids, "<u4")
    if wide.size == 0 or wide.max() < 1 << 16:
        return b"\x02" + wide.astype("<u2").tobytes()
    return b"\x04" + ids


def unpack_ids(value: bytes) -> bytes:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4").tobytes()


class Writer:
    """Takes entries in ascending order of key (repeated keys may follow each other) and writes one shard."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self.block, self.last, self.index, self.keys, self.ids = bytearray(), b"", [], [], 0
        self.first_key = None
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes, ids: int) -> None:
        if self.first_key is None:
            self.first_key = key
        elif key < self.last_key:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = self.last_key = key
        self.keys.append(key)
        self.ids += ids
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.pack.compress(bytes(self.block))
            self.index.append((self.last, self.at, len(data) + 4))
            self._put(data + struct.pack("<I", zlib.crc32(data)))
            self.block, self.last = bytearray(), b""

    def finish(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self.index)
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index_at = self.at
        self._put(index)
        bloom_at = self.at
        self._put(struct.pack("<Q", bits) + bytes(bloom))
        self._put(FOOTER.pack(index_at, len(index), bloom_at, len(bloom) + 8, len(self.keys), self.ids, MAGIC))


class Reader:
    """Reads one shard from an open file that can seek."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.entries, self.ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        source.seek(index_at)
        data, at = source.read(index_n), 0
        self.last_keys, self.places = [], []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.last_keys.append(data[at : at + n])
            place, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.places.append((place, length))
        source.seek(bloom_at)
        data = source.read(bloom_n)
        self.bits, self.bloom = struct.unpack("<Q", data[:8])[0], data[8:]

    def _block(self, k: int):
        place, length = self.places[k]
        self.source.seek(place)
        data = self.source.read(length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def __iter__(self):
        for k in range(len(self.places)):
            yield from self._block(k)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key, in the order they were added; empty if there is none."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return []
        out, k = [], bisect.bisect_left(self.last_keys, key)
        while k < len(self.places):
            found = [v for x, v in self._block(k) if x == key]
            out += found
            if self.last_keys[k] != key:
                break
            k += 1
        return out


def write_shards(
    docs: DataFrame, folder: str, *, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES
) -> list[dict]:
    """Encode every whole text, append ``end_id`` and write shards in ascending order of id.

    Returns the manifest, one row for each file, in the order of the ids: path, entries, ids, first and last key. A null text is an empty
    one; a null id comes first; repeated ids keep an entry each, ordered by their texts. Files are written under a
    temporary name and then renamed, so that a repeated task leaves the same files. An empty table gives no file.
    """
    spark = docs.sparkSession

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        encode = encoder(tokenizer_path, words=False).ids
        end = np.asarray([end_id], "<u4").tobytes()
        done, writer, sink, temporary = [], None, None, ""

        def close() -> None:
            writer.finish()
            sink.close()
            # Named by attempt: a repeated or speculative task leaves files of its own, and the manifest names one task's.
            final = f"{root}/part-{task.partitionId():06d}-{len(done):06d}-{task.taskAttemptId()}.sst"
            store.move(temporary, final)
            done.append((task.partitionId(), len(done), final, len(writer.keys), writer.ids, writer.first_key, writer.last_key))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), binary_list(batch.column(1)), strict=True):
                if writer is None:
                    temporary = f"{root}/.part-{task.partitionId():06d}-{len(done):06d}-{task.taskAttemptId()}"
                    sink = store.open_output_stream(temporary)
                    writer = Writer(sink)
                ids = encode(text) + end
                writer.add(key_of(key), pack_ids(ids), len(ids) // 4)
                if writer.at >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            {k: [x[i] for x in done] for i, k in enumerate(("part", "number", "path", "entries", "ids", "first_key", "last_key"))},
            schema=pa.schema([("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]),
        )

    # Range partitions on the id are the global order; a task sorts and encodes its own range.
    ordered = docs.select(F.col(id_col), F.col(text_col)).repartitionByRange(shuffle_partitions(spark), F.col(id_col)).sortWithinPartitions(id_col, text_col)
    manifest = ordered.mapInArrow(run, "part long, number long, path string, entries long, ids long, first_key binary, last_key binary").collect()
    return [r.asDict() for r in sorted(manifest, key=lambda r: (r["part"], r["number"]))]


def read_shards(spark, folder: str, manifest: list[dict], id_type: str = "long") -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    Each file is read by one task; ``start`` needs only the totals in the manifest, which has a row for each file.
    """
    rows, before = [], 0
    for x in manifest:
        rows.append((x["path"], before))
        before += x["ids"]
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, shard string"
    if not rows:
        return spark.createDataFrame([], schema)

    def run(batches):
        import pyarrow as pa

        kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out: list[tuple] = []
                with store.open_input_file(path) as source:
                    for key, value in Reader(source, source.size()):
                        ids = unpack_ids(value)
                        out.append((value_of(key), start, len(ids) // 4, zlib.crc32(ids), os.path.basename(path)))
                        start += len(ids) // 4
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], kinds.get(id_type, pa.string())), *(pa.array(c, pa.int64()) for c in columns[1:4]), pa.array(columns[4], pa.string())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    files = spark.sparkContext.defaultParallelism
    return spark.createDataFrame(rows, "path string, start long").repartition(min(len(rows), 4 * files)).mapInArrow(run, schema)


def lookup(folder: str, manifest: list[dict], key) -> list[np.ndarray]:
    """Ids of every document with that key: binary search of the manifest, then the shard's Bloom filter and block index."""
    store, _ = open_store(folder)
    found, wanted = [], key_of(key)
    for x in manifest[bisect.bisect_left([bytes(x["last_key"]) for x in manifest], wanted) :]:
        if bytes(x["first_key"]) > wanted:
            break
        with store.open_input_file(x["path"]) as source:
            found += [np.frombuffer(unpack_ids(v), "<u4") for v in Reader(source, source.size()).get(key_of(key))]
    return found


def encode_to_shards(docs: DataFrame, *, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards into the shared folder and return what they hold (see :func:`read_shards`)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "sstable")
    manifest = write_shards(docs, folder, tokenizer_path=tokenizer_path, end_id=end_id, id_col=id_col, text_col=text_col)
    return read_shards(spark, folder, manifest, docs.schema[id_col].dataType.simpleString())
