"""Token-id files: a zstandard frame for each document, with a trailing seek table.

A file holds, in order, one frame for each document with its ids (little-endian, 2 or 4 bytes an id), one
frame with the index (as int64: the ids' width, then for each document whether its id is known, its id),
and the seek table of the public zstd seekable format: a skippable frame whose entries give each frame's
compressed size, decompressed size and checksum (low 32 bits of XXH64), and whose last nine bytes say how
many they are. Readers take the table, the index and the frames of the documents they want.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korrel.llm.common import filesystem, keep, new_dir, parts_for, slices, tidied
from korrel.llm.encode import encoder

#: Fixed values of the seekable format: magic of its skippable frame, magic at its end, flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
LEVEL = 3
#: Bytes of text that are encoded at a time.
SLICE = 1 << 22


class FrameWriter:
    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.pack = zstandard.ZstdCompressor(level=LEVEL).compress
        self.table, self.index, self.size, self.tokens = [], [width], 0, 0

    def _frame(self, data: bytes) -> None:
        packed = self.pack(data)
        self.stream.write(packed)
        self.size += len(packed)
        self.table.append(struct.pack("<III", len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._frame(ids.astype(f"<u{self.width}").tobytes())
        self.index += [doc_id is not None, doc_id or 0]
        self.tokens += len(ids)

    def close(self) -> int:
        self._frame(np.array(self.index, "<i8").tobytes())
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        return self.size + 8 + len(body)


class FrameReader:
    """Random access to a file's documents; every frame read is held against its checksum."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell()
        stream.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        stream.seek(end - 9 - 12 * count - 8)
        head, size = struct.unpack("<II", stream.read(8))
        if head != SKIPPABLE or size != 12 * count + 9:
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(stream.read(12 * count), "<u4").reshape(-1, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor().decompress
        index = np.frombuffer(self._frame(count - 1), "<i8")
        self.width, known, ids = int(index[0]), index[1::2], index[2::2]
        self.doc_ids = [int(x) if k else None for k, x in zip(known, ids)]

    def _frame(self, k: int) -> bytes:
        self.stream.seek(int(self.begin[k]))
        packed, plain, check = (int(x) for x in self.table[k])
        data = self.unpack(self.stream.read(packed), max_output_size=plain) if plain else b""
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        return np.frombuffer(self._frame(k), f"<u{self.width}")


MANIFEST = "part long, file string, n_docs long, n_tokens long, n_bytes long"


def _write(folder: str, tokenizer: str, end_id: int):
    @tidied
    def run(batches):
        part, files, path = TaskContext.get().partitionId(), *filesystem(folder)
        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.tok"  # an attempt that fails leaves a file no manifest names
        writer = stream = None
        for batch in batches:
            encode = encoder(tokenizer)
            ids, sizes = batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for low, high in slices(sizes, SLICE):
                tokens, first = encode.encode([x or "" for x in batch.column(1)[low:high].to_pylist()])
                if writer is None:
                    files.create_dir(path, recursive=True)
                    stream = files.open_output_stream(name, compression=None)
                    writer = FrameWriter(stream, 2 if max(len(encode.spaced), end_id + 1) <= 1 << 16 else 4)
                for k in range(low, high):
                    writer.add(ids[k], np.append(tokens[first[k - low] : first[k - low + 1]], end_id))
        if writer is not None:
            size = writer.close()
            stream.close()
            row = {"part": [part], "file": [name], "n_docs": [len(writer.table) - 1], "n_tokens": [writer.tokens], "n_bytes": [size]}
            yield pa.RecordBatch.from_pydict(row)

    return run


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token-id files in ascending id order; returns their manifest, itself a written table.

    Null ids come first, and ties in the order of the text's hash. A null text is empty: only ``end_id``.
    An empty table writes no file; other columns are ignored. Only files that the manifest names count. A text of
    any length is encoded in parts; its ids, four bytes each, are one frame.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "token-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts_for(docs), *order).sortWithinPartitions(*order)
    return keep(dealt.mapInArrow(_write(folder, tokenizer, end_id), MANIFEST), "token-id-manifest")


def _read(folder_of):
    @tidied
    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, path = filesystem(folder_of)[0], name
                rows = []
                with files.open_input_file(path) as stream:
                    reader = FrameReader(stream)
                    for k, doc_id in enumerate(reader.doc_ids):
                        ids = reader.ids(k)
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    dealt = files.repartition(max(1, files.count()))  # a file is a task
    return dealt.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def id_files(docs: DataFrame, tokenizer: str, end_id: int = 2, **columns) -> DataFrame:
    """Write the files and read them back: one row for each row of ``docs``; see ``write_ids`` for odd rows."""
    folder = new_dir(docs.sparkSession, "token-ids")
    return read_digests(write_ids(docs, tokenizer, end_id, folder, **columns), folder)
