"""WARC archives in zstandard: a dictionary made of an archive's own records leads it, each record is a frame.

An archive begins with a skippable frame that holds the dictionary, so it can be read without anything else;
then comes one frame for each record, which can be read alone with the dictionary (an index tells where). Pages
of equal payloads are archived once: the page with the largest id is the response, the others are revisits that
name it. Which page that is comes from payload digests alone; a page's text isn't exchanged unless Spark has to
join the repeated digests by shuffling.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korrel.llm.common import filesystem, keep, new_dir, tidied

#: The magic of the dictionary's skippable frame and of a frame of data, the profile of a revisit.
DICTIONARY, FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always archived.
LEAST = 1000
#: Bytes of records that a dictionary is made of, the dictionary's own, those of an archive, and of a read.
SAMPLE, WORDS, ARCHIVE, READ = 4 << 20, 64 << 10, 1 << 30, 1 << 20
LEVEL = 3


def record(kind: str, name: str, url: str | None, date: str, sha1: bytes, size: int, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One record. A revisit has the HTTP head of its page, which tells the payload's size, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>", f"WARC-Refers-To-Date: {date}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    """Nothing in a page's address may end a line of the head."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('WARC-Record-ID')}: the record's length is wrong")
    return fields, rest[:size]


class ArchiveWriter:
    """Records are held back until there are enough for a dictionary; of too few or too like ones none can be made,
    and their archive has none."""

    def __init__(self, stream):
        self.stream, self.size, self.held, self.waiting, self.pack = stream, 0, [], 0, None
        self.places: list[tuple[int, int]] = []

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        words = None
        try:
            words = zstandard.train_dictionary(WORDS, self.held)
        except zstandard.ZstdError:
            pass
        if words is not None:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(words.as_bytes())
            self._write(struct.pack("<II", DICTIONARY, len(packed)) + packed)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True).compress
        for data in self.held:
            self._frame(data)
        self.held = []

    def _frame(self, data: bytes) -> None:
        packed = self.pack(data)
        self.places.append((self.size, len(packed)))
        self._write(packed)

    def add(self, data: bytes) -> None:
        if self.pack is not None:
            self._frame(data)
            return
        self.held.append(data)
        self.waiting += len(data)
        if self.waiting >= SAMPLE:
            self._begin()

    def close(self) -> list[tuple[int, int]]:
        """(offset, bytes) of each record's frame."""
        if self.pack is None:
            self._begin()
        return self.places


def _unpacker(head: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """For an archive that begins with ``head``; and where its first record begins."""
    if len(head) >= 8:
        magic, size = struct.unpack("<II", head[:8])
        if magic == DICTIONARY:
            words = head[8 : 8 + size]
            if words[:4] == struct.pack("<I", FRAME):
                words = zstandard.ZstdDecompressor().decompress(words)
            return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)), 8 + size
    return zstandard.ZstdDecompressor(), 0


def _opened(stream) -> tuple[zstandard.ZstdDecompressor, int]:
    head = stream.read(8)
    more = struct.unpack("<II", head)[1] if len(head) == 8 and head[:4] == struct.pack("<I", DICTIONARY) else 0
    return _unpacker(head + stream.read(more))


def records(stream) -> Iterator[bytes]:
    """The records of an archive one after the other."""
    unpack, at = _opened(stream)
    stream.seek(at)
    data = stream.read(READ)
    while data:
        one, parts = unpack.decompressobj(), []
        while not one.eof:
            if not data and not (data := stream.read(READ)):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else b""
        yield b"".join(parts)
        data = data or stream.read(READ)


def record_at(stream, offset: int, size: int) -> bytes:
    """One record by its place in the index, without reading those before it."""
    unpack, _ = _opened(stream)
    stream.seek(offset)
    return unpack.decompressobj().decompress(stream.read(size))


def _page_name(page_id: int | None, sha1: bytes) -> str:
    return f"urn:page:{'-' if page_id is None else page_id}:{sha1.hex()}"


_NAME = re.compile(r"<urn:page:(-?\d+|-):")


def _page_of(name: str) -> int | None:
    number = _NAME.match(name)[1]
    return None if number == "-" else int(number)


INDEX = "page_id long, file string, offset long, size long, record_type string"


def _write(folder: str, date: str):
    @tidied
    def run(batches):
        part, files, path = TaskContext.get().partitionId(), *filesystem(folder)
        writer = stream = name = None
        told: list[tuple] = []

        def closed() -> pa.RecordBatch:
            places = writer.close()
            stream.close()
            rows = [(page, name, *place, kind) for (page, kind), place in zip(told, places)]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["page_id", "file", "offset", "size", "record_type"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "sha1", "bytes", "kind", "winner", "copies")]
            payloads = batch.column("payload")
            for k, (page, url, sha1, size, kind, winner, copies) in enumerate(zip(*columns)):
                for copy in range(copies):
                    if writer is None:
                        # an attempt that fails leaves a file that no index names
                        name = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.warc.zst"
                        files.create_dir(path, recursive=True)
                        stream = files.open_output_stream(name, compression=None)
                        writer, told = ArchiveWriter(stream), []
                    what = "revisit" if copy else kind
                    own = _page_name(page, sha1)
                    if what == "revisit" or size < LEAST:
                        own += f":{name[-41:-9]}:{len(told)}"
                    writer.add(record(what, own, url, date, sha1, size, None if what == "revisit" else payloads[k].as_py() or b"", _page_name(winner, sha1)))
                    told.append((page, what))
                    if writer.size >= ARCHIVE:
                        yield closed()
                        writer = None
        if writer is not None:
            yield closed()

    return run


def _typed(pages: DataFrame) -> DataFrame:
    """The rows of the archives: (page_id, url, payload, sha1, bytes, kind, winner, copies)."""
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.select("*", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    # Of equal payloads: the page that is archived, and whether rows repeat it. Copies are counted before they meet.
    each = rows.filter(F.col("bytes") >= LEAST).groupBy("digest", "page_id", "url").agg(F.count("*").alias("copies"))
    best = each.groupBy("digest").agg(F.max(F.struct("page_id", "url", "copies")).alias("top"), F.sum("copies").alias("all"))
    repeated = keep(best.filter(F.col("all") > 1).select("digest", F.lit(True).alias("again"), F.col("top.page_id").alias("winner"), F.col("top.url").alias("winner_url"), F.col("top.copies").alias("copies")), "warc-repeated")
    wins = F.col("page_id").eqNullSafe(F.col("winner")) & F.col("url").eqNullSafe(F.col("winner_url"))
    kind = F.when(F.col("again") & ~wins, "revisit").otherwise("response")
    tied = F.coalesce(F.col("again") & wins & (F.col("copies") > 1), F.lit(False))
    met = rows.join(repeated, "digest", "left").filter(~tied)
    columns = ["page_id", "url", F.when(kind == "response", F.col("payload")).alias("payload"), "sha1", "bytes", kind.alias("kind"), "winner"]
    archived_once = met.select(*columns, F.lit(1).alias("copies"))
    ties = repeated.filter("copies > 1")
    if ties.isEmpty():
        return archived_once
    # Rows that repeat the archived page whole become one row that stands for them.
    one = rows.join(ties, "digest").filter(tied).groupBy("page_id", "url", "digest").agg(F.first("payload").alias("payload"), F.first("sha1").alias("sha1"), F.first("bytes").alias("bytes"), F.first("winner").alias("winner"), F.count("*").cast("int").alias("copies"))
    first = one.select("page_id", "url", "payload", "sha1", "bytes", F.lit("response").alias("kind"), "winner", "copies")
    return archived_once.unionByName(first)


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives of about a gigabyte at most; returns their index, a written table.

    Of pages whose payloads of at least 1000 bytes are equal, that of the largest id (then url) is archived and the
    others are revisits. A null html is empty; null ids are smaller than all others; a null url is about:blank.
    Rows that are the same in all three columns are records of their own, one of them the response. An empty table
    writes nothing; other columns are ignored. A page is a record whatever its length, and is held in memory whole.
    Files that the index doesn't name, of attempts that failed, don't count.
    """
    folder = folder or new_dir(pages.sparkSession, "warc")
    return keep(_typed(pages).mapInArrow(_write(folder, date), INDEX), "warc-index")


def _read(folder: str):
    @tidied
    def run(batches):
        files, _ = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_file(name) as stream:
                    for data in records(stream):
                        fields, block = parsed(data)
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                        sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != sha1):
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload is damaged")
                        rows.append((_page_of(fields["WARC-Record-ID"]), size, sha1, kind, _page_of(refers) if refers else None))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each held against its digest."""
    files = index.groupBy("file").count().select("file")
    dealt = files.repartition(max(1, files.count()), "file")
    return dealt.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    folder = new_dir(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, date), folder)


WARC_SQL = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest, CASE WHEN n >= {LEAST} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= {LEAST} AND page_id <> top THEN top END AS refers_to FROM w"""
