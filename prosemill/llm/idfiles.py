"""Files of token ids in fixed-width bits, with random access.

An id takes the least number of bits that holds the vocabulary. A file is a head (magic, width, ids a block), blocks of packed ids, a table of blocks
(byte offset, first id, ids, crc32 of the bytes), a table of documents (key, first id, ids), and a foot with the places of both tables. 64 ids fill
`width` words of 64 bits, so packing and unpacking are 64 shifts of whole numpy columns for any width from 1 to 32; any stretch of ids is read by
seeking to its blocks.

Documents are dealt by ranges of the key and sorted within, so files follow one another in ascending order. Equal keys are ordered by their text's hash and
may spread over several files, so a key that holds a third of all rows is no hot spot. A task writes its ids as they are encoded, holds one block and one
file's table of documents, and starts a new file after file_ids ids. Each attempt of a task writes files of its own name; the manifest, a table that Spark
commits, lists those of successful attempts alone, so lost executors and repeated tasks leave nothing in it twice.

Defined cases: a null or empty text is a document of its end id alone; null keys come first; repeated rows are documents each; extra columns are
ignored, whatever their names; an empty table gives no files and no rows."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import local_file, read_ranks
from .common import CHUNK_CHARS, chunks, materialise, shared_dir
from .packing import _encoder

#: Fixed values of the format: head (magic, width, ids a block) and foot (places and lengths of the tables of blocks and documents, magic), little-endian.
MAGIC, HEAD, FOOT = b"PMILLID1", struct.Struct("<8sII"), struct.Struct("<QQQQ8s")
MANIFEST = "part int, number int, path string, n_ids long, n_docs long, width int, bytes long"


def bits_of(size: int) -> int:
    """Least width that holds the ids from 0 to size - 1."""
    return max(1, (size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """The ids in `width` bits each, least significant first, padded with zeros to a multiple of 64 ids."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"id {ids.max()} needs more than {width} bits")
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(rows), width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_bits(raw: bytes, width: int, count: int) -> np.ndarray:
    """The first `count` ids that pack_bits wrote."""
    words = np.frombuffer(raw, "<u8").reshape(-1, width)
    out, mask = np.empty((len(words), 64), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.reshape(-1)[:count]


def _table(**columns: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Writer:
    """One file; add() takes documents in order, close() gives its numbers of ids, documents and bytes."""

    def __init__(self, uri: str, width: int, block_ids: int, key_type: pa.DataType):
        if block_ids % 64:
            raise ValueError("block_ids is a multiple of 64")
        self.width, self.block_ids, self.key_type = width, block_ids, key_type
        system, path = fs.FileSystem.from_uri(uri)
        self.out = system.open_output_stream(path)
        self.out.write(HEAD.pack(MAGIC, width, block_ids))
        self.at, self.n_ids, self.blocks, self.held, self.n_held = HEAD.size, 0, [], [], 0
        self.keys: list[pa.Array] = []
        self.lens: list[np.ndarray] = []

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.width)
        self.blocks.append((self.at, self.n_ids, len(ids), zlib.crc32(raw)))
        self.out.write(raw)
        self.at, self.n_ids = self.at + len(raw), self.n_ids + len(ids)

    def add(self, keys: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.keys.append(keys)
        self.lens.append(lens)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            flat = np.concatenate(self.held)
            whole = len(flat) - len(flat) % self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.held, self.n_held = [flat[whole:].copy()], len(flat) - whole

    def close(self) -> tuple[int, int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        lens = np.concatenate(self.lens) if self.lens else np.zeros(0, np.int64)
        cols = list(zip(*self.blocks, strict=True)) or [[]] * 4
        blocks = _table(**{n: pa.array(c, pa.int64()) for n, c in zip(("offset", "start", "count", "crc32"), cols, strict=True)})
        docs = _table(key=pa.concat_arrays([pa.array([], self.key_type), *self.keys]), start=pa.array(np.cumsum(lens) - lens, pa.int64()), count=pa.array(lens, pa.int64()))
        self.out.write(blocks)
        self.out.write(docs)
        self.out.write(FOOT.pack(self.at, len(blocks), self.at + len(blocks), len(docs), MAGIC))
        self.out.close()
        return self.n_ids, len(lens), self.at + len(blocks) + len(docs) + FOOT.size


class Reader:
    """Random access to a file's ids; blocks are checked against their crc32."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file, size = system.open_input_file(path), system.get_file_info(path).size
        magic, self.width, self.block_ids = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        b_at, b_len, d_at, d_len, end = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"no file of ids, or cut short: {uri}")
        blocks, self.docs = (pa.ipc.open_stream(self.file.read_at(n, at)).read_all() for at, n in ((b_at, b_len), (d_at, d_len)))
        self.offsets, self.starts, self.counts, self.sums = (blocks[n].to_numpy() for n in ("offset", "start", "count", "crc32"))
        self.n_ids = int(self.counts.sum())

    def block(self, i: int) -> np.ndarray:
        raw = self.file.read_at(-(-int(self.counts[i]) // 64) * self.width * 8, int(self.offsets[i]))
        if zlib.crc32(raw) != self.sums[i]:
            raise ValueError(f"block {i} is damaged")
        return unpack_bits(raw, self.width, int(self.counts[i]))

    def ids(self, start: int, count: int) -> np.ndarray:
        """The ids from start on, read from their blocks alone."""
        if start < 0 or count < 0 or start + count > self.n_ids:
            raise IndexError(f"ids {start} to {start + count} of {self.n_ids}")
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (start + count - 1) // self.block_ids
        flat = np.concatenate([self.block(i) for i in range(first, last + 1)])
        return flat[start - first * self.block_ids :][:count]

    def close(self) -> None:
        self.file.close()


def vocabulary(path: str) -> int:
    """Number of ids of a tokenizers file (.json), or of a file of ranks (any other)."""
    if not path.endswith(".json"):
        return max(read_ranks(local_file(path)).values()) + 1
    with open(local_file(path), encoding="utf-8") as f:
        own = json.load(f)
    return max([*own["model"]["vocab"].values(), *(t["id"] for t in own["added_tokens"])]) + 1


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Spark takes it for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None, block_ids: int = 1 << 16, file_ids: int = 1 << 26) -> DataFrame:
    """Encodes and writes all documents; returns the manifest, a row per file: part, number, path, n_ids, n_docs, width, bytes. folder: a URI that all executors share."""
    folder = _qualified(df.sparkSession, folder or f"{shared_dir(df.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}")
    width = bits_of(max(vocabulary(tokenizer_path), end_id + 1))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).withColumns({"_hash": F.xxhash64("_text"), "_row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("_key", "_hash", "_row").sortWithinPartitions("_key", "_hash").select("_key", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context = _encoder(tokenizer_path, pattern), TaskContext.get()
        part, writer, files = context.partitionId(), None, []
        name = f"{folder}/part-{part:06d}-{context.taskAttemptId()}"

        def close() -> None:
            files.append((part, len(files), f"{name}-{len(files):04d}.ids", *writer.close()))

        for slice_, texts in chunks(batches, "_text", min(CHUNK_CHARS, file_ids)):
            if writer is None:
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                writer = Writer(f"{name}-{len(files):04d}.ids", width, block_ids, slice_.column(0).type)
            flat, lens = encoder.encode(texts)
            ends = np.cumsum(lens)
            writer.add(slice_.column(0), np.insert(flat, ends, end_id), lens + 1)
            if writer.n_ids >= file_ids:
                close()
                writer = None
        if writer:
            close()
        if files:
            parts, numbers, paths, ids, docs, sizes = zip(*files, strict=True)
            cols = [pa.array(parts, pa.int32()), pa.array(numbers, pa.int32()), pa.array(paths), pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.array([width] * len(files), pa.int32()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "number", "path", "n_ids", "n_docs", "width", "bytes"])

    return materialise(rows.mapInArrow(run, MANIFEST), "ids-manifest")


def read(manifest: DataFrame, key_type: str, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """A row per document from the files of a manifest: key, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian; null unless with_ids).

    A task reads whole files block by block. The running sum over the manifest has no partition: it holds a row per file, 2^26 ids or a task's share each."""
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.select("path", "base").repartitionByRange(max(1, manifest.count()), "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                yield from _documents(reader, base)
                reader.close()

    def _documents(reader: Reader, base: int) -> Iterator[pa.RecordBatch]:
        starts, counts = reader.docs["start"].to_numpy(), reader.docs["count"].to_numpy()
        keys = reader.docs["key"].combine_chunks()
        doc, crc, kept, missing = 0, 0, [], int(counts[0]) if len(counts) else 0
        for i in range(len(reader.counts)):
            raw, at, done = memoryview(reader.block(i).astype("<u4").tobytes()), 0, ([], [])
            while at < len(raw):
                take = min(4 * missing, len(raw) - at)
                crc = zlib.crc32(raw[at : at + take], crc)
                if with_ids:
                    kept.append(bytes(raw[at : at + take]))
                at, missing = at + take, missing - take // 4
                if not missing:
                    done[0].append(crc)
                    done[1].append(b"".join(kept) if with_ids else None)
                    crc, kept, nxt = 0, [], doc + len(done[0])
                    missing = int(counts[nxt]) if nxt < len(counts) else 0
            n = len(done[0])
            if n:
                cols = [keys.slice(doc, n), pa.array(starts[doc : doc + n] + base), pa.array(counts[doc : doc + n]), pa.array(done[0], pa.int64()), pa.array(done[1], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "start", "n_tokens", "ids_crc32", "ids"])
                doc += n

    return files.mapInArrow(run, f"_key {key_type}, start long, n_tokens long, ids_crc32 long, ids binary").withColumnRenamed("_key", key)
