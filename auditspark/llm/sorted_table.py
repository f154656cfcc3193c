"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier; each partition becomes a shard file:

    block ...   entries in key order: shared key bytes, rest of the key, token ids (16 or 32 bits each);
                the first key of a block is whole; a block is compressed and has a crc32
    index       for every block its first key, place, length and number of entries (sparse)
    Bloom       bits for the shard's keys
    footer      places of index and Bloom filter, counts, width of an id, magic

A lookup asks the Bloom filter, finds the block by binary search in the index, and reads that block alone.
Files are written under a name of their task's attempt, and only those in the manifest count, so a lost
executor's half-written file does no harm.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.llm.tokens import encoder, spread
from auditspark.session import materialise, read_table, scratch_path, ship_package

MAGIC = b"ASSTBL01"
FOOTER = struct.Struct("<QQQQQQI8s")
#: Bytes of entries in a block, and of a file at which the next is begun.
BLOCK_BYTES, FILE_BYTES = 64 << 10, 256 << 20
BITS_A_KEY, PROBES = 10, 7
END_ID = 2


def pack_key(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do; the null id has the empty key and comes first."""
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def unpack_key(key: bytes) -> int | None:
    return None if not key else int.from_bytes(key, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class TableWriter:
    """Writes one shard to an open binary stream; keys have to come in order, equal ones side by side."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.at = out, width, 0
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.block, self.block_keys, self.index, self.keys = bytearray(), [], [], []
        self.n_ids = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: packed in the table's width."""
        last = self.block_keys[-1] if self.block_keys else b""
        shared = 0
        while shared < min(len(last), len(key)) and last[shared] == key[shared]:
            shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.block_keys.append(key)
        self.n_ids += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def _end_block(self) -> None:
        if self.block_keys:
            data = self.squeeze.compress(bytes(self.block))
            place = self._put(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append((self.block_keys[0], *place, len(self.block_keys)))
            self.keys += self.block_keys
            self.block, self.block_keys = bytearray(), []

    def close(self) -> None:
        self._end_block()
        listed = bytearray()
        for key, at, length, n in self.index:
            listed += _varint(len(key)) + key + _varint(at) + _varint(length) + _varint(n)
        index = self._put(bytes(listed))
        bits = max(64, BITS_A_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self._put(bytes(bloom))
        self.out.write(FOOTER.pack(*index, *bloom_at, len(self.keys), self.n_ids, self.width, MAGIC))


class TableReader:
    """Reads a shard from a file that can be read at any place."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        *places, self.n_docs, self.n_ids, self.width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted table")
        listed, at, self.index = self._at(places[0], places[1]), 0, []
        while at < len(listed):
            n, at = _read_varint(listed, at)
            key, at = listed[at : at + n], at + n
            place, at = _read_varint(listed, at)
            length, at = _read_varint(listed, at)
            count, at = _read_varint(listed, at)
            self.index.append((key, place, length, count))
        self.first_keys = [x[0] for x in self.index]
        self.bloom = self._at(places[2], places[3])
        self.bits = max(64, BITS_A_KEY * self.n_docs)

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        _, place, length, count = self.index[k]
        stored = self._at(place, length)
        if struct.unpack("<I", stored[-4:])[0] != zlib.crc32(stored[:-4]):
            raise ValueError(f"block {k} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(stored[:-4]), 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            yield key, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The id lists under the key: none, one, or one for each row that had it."""
        key, found = pack_key(doc_id), []
        if not self.index or any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return found
        k = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while k < len(self.index) and self.first_keys[k] <= key:
            found += [ids for at, ids in self.block(k) if at == key]
            k += 1
        return found


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tables(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, wide: bool = False, files: int | None = None) -> DataFrame:
    """Encode docs(doc_id, text) and write shards under path (a URI that all executors reach).

    The manifest: (file, first_key, last_key binary, n_docs, n_ids long), a row for each file, written as a
    table too. wide: 32-bit ids, for vocabularies of more than 65,536 entries.

    Defined results: a null or empty text has the end id only; rows that share an id stay side by side,
    ordered by text; null ids come first; an empty table has no file; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 4 if wide else 2

    def write(batches):
        import pyarrow as pa

        words = encoder(tokenizer, True)
        if not wide and max(len(words.edge) - 1, end_id) > 0xFFFF:
            raise ValueError("the tokenizer's ids need more than 16 bits: write wide tables")
        fs, folder = _open(path)
        fs.create_dir(folder)
        table = out = name = first = last = None
        done = []

        def finish():
            table.close()
            out.close()
            done.append((name, first, last, len(table.keys), table.n_ids))

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for part in spread(texts):
                ids, ends = words.encode_ended(texts[part], end_id)
                stored, stops = ids.astype(f"<u{width}").tobytes(), (width * ends).tolist()
                for doc_id, start, stop in zip(keys[part], [0, *stops], stops, strict=False):
                    key = pack_key(doc_id)
                    if table and table.at >= FILE_BYTES and key != last:
                        finish()
                        table = None
                    if not table:
                        name, first = f"{uuid.uuid4().hex}.sst", key
                        out = fs.open_output_stream(f"{folder}/{name}")
                        table = TableWriter(out, width)
                    table.add(key, stored[start:stop])
                    last = key
        if table:
            finish()
        names, firsts, lasts, counts, totals = zip(*done, strict=True) if done else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(firsts, pa.binary()), pa.array(lasts, pa.binary()), pa.array(counts, pa.int64()), pa.array(totals, pa.int64())],
            names=["file", "first_key", "last_key", "n_docs", "n_ids"],
        )

    # the texts' beginnings deal the rows of one id that has very many of them to several files
    ordered = docs.select("doc_id", "text").repartitionByRange(files, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(write, "file string, first_key binary, last_key binary, n_docs long, n_ids long"), "manifest")


def read_tables(manifest: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 long, ids array<long>) of every document in the files, where start
    is the number of ids of all documents before it; without ids if they are not wanted."""
    ship_package(manifest.sparkSession)

    def read(batches):
        import numpy as np
        import pyarrow as pa

        fs, folder = _open(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/{name}") as file:
                    table = TableReader(file)
                    for k in range(len(table.index)):
                        rows = []
                        for key, stored in table.block(k):
                            ids = np.frombuffer(stored, "<u4" if table.width == 4 else "<u2").astype("<u4")
                            rows.append((unpack_key(key), start, len(ids), zlib.crc32(ids.tobytes()), ids.astype("i8") if keep_ids else None))
                            start += len(ids)
                        cols = list(zip(*rows, strict=True))
                        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
                        if keep_ids:
                            arrays.append(pa.array(cols[4], pa.list_(pa.int64())))
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    # one small row for each file: the running sum needs them in one place
    before = Window.orderBy("first_key", "last_key", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return placed.select("file", "start").repartition(n).mapInArrow(read, columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tables")
    manifest = write_tables(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tables(manifest, path, keep_ids=False)
