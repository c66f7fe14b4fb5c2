"""WARC archives with a two-level capture index.

Tasks write gzip-per-record WARC files into the shared folder and report each record's place.  The index
sorts the captures by reversed-host key; each sorted partition becomes a shard file of compressed blocks
of entries, ended by a sparse directory with the first entry of each block.  A lookup finds the shard by its first entry
(one row a shard), binary-searches the shard's directory, range-reads single blocks, and then single
records.  Files of failed task attempts are never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.session import file_system, materialise, scratch_path

#: Entries of an index block, and bytes after which a task starts a new archive.
BLOCK_ENTRIES = 2048
ARCHIVE_BYTES = 1 << 30

_CAPTURE = "key string, page_id long, record_type string, file string, offset long, length long"
_FIRST_ID = -(1 << 63)


def reversed_host_key(url: Column) -> Column:
    """``com,example,www)/path?query`` for ``http://www.example.com/path?query``; a null URL has the key ``)``."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, "^[^/?#]*(.*)$", 1))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, repeated: bool) -> bytes:
    """A response record, or a revisit record without the payload, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if repeated else http + payload
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if repeated else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        *([f"WARC-Target-URI: {uri}"] if url is not None else []),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"] if repeated else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """Type, ids, length and digest of the payload, and the payload (None in a revisit) of one gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: None if (x := fields[name][10:-1]) == "None" else int(x)
    revisit = fields["WARC-Type"] == "revisit"
    out = {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"][5:],
        "refers_to": number("WARC-Refers-To") if revisit else None,
        "payload": None if revisit else payload,
    }
    if not revisit and (_digest(payload) != out["payload_digest"] or len(payload) != out["payload_bytes"]):
        raise ValueError(f"record {out['page_id']} does not hold the payload it names")
    return out


def write_archives(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html); returns the captures: key, page_id, record_type, file, offset, length.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those with the smallest page_id are responses
    and all others revisits of it; smaller payloads are all responses.  A null html is an empty payload.  Rows that repeat a
    page_id with an equal payload share its record type; a null page_id is never the smallest, and such rows
    revisit the smallest id of their payload, if there is one.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    digests = materialise(rows.filter(F.octet_length("payload") >= least_bytes).select("page_id", "sha"), "digests")
    first = digests.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    again = digests.join(first.select("sha", "refers_to"), "sha").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = materialise(again.select(F.col("page_id").alias("again_id"), F.col("sha").alias("again_sha"), "refers_to"), "revisits")
    same = (F.col("sha") == F.col("again_sha")) & F.col("page_id").eqNullSafe(F.col("again_id"))
    marked = rows.join(again, same, "left").select(reversed_host_key(F.col("url")).alias("key"), "page_id", "url", "payload", "refers_to")
    folder = scratch_path(pages.sparkSession, "archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out, name, offset = None, "", 0
        for batch in batches:
            found = []
            for key, page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or offset >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, offset = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(name, buffer_size=1 << 20, compression=None)
                member = _record(page_id, url, payload, refers_to, refers_to is not None)
                out.write(member)
                found.append((key, page_id, "revisit" if refers_to is not None else "response", name, offset, len(member)))
                offset += len(member)
            columns = list(zip(*found, strict=True)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "page_id", "record_type", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialise(marked.mapInArrow(run, _CAPTURE), "captures")


@dataclass
class CaptureIndex:
    """The upper level: first entry, file and length of every shard, in order; and the folder's address."""

    folder: str
    shards: list[tuple]


def _order(key: str, page_id: int | None) -> tuple[bytes, int]:
    return key.encode(), _FIRST_ID if page_id is None else page_id


def build_index(captures: DataFrame, block_entries: int = BLOCK_ENTRIES) -> CaptureIndex:
    """Shard files of the captures sorted by key and page_id."""
    folder = scratch_path(captures.sparkSession, "capture_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        out, directory, block, offset, name = None, [], [], 0, f"{path}/{uuid.uuid4().hex}.idx"

        def close_block() -> None:
            nonlocal offset, block
            data = zlib.compress("\n".join(map(json.dumps, block)).encode())
            out.write(data)
            directory.append([block[0][0], block[0][1], offset, len(data)])
            offset, block = offset + len(data), []

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(name, buffer_size=1 << 20, compression=None)
                block.append(entry)
                if len(block) >= block_entries:
                    close_block()
        if out is not None:
            if block:
                close_block()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "big"))
            out.close()
            row = (directory[0][0], directory[0][1], name, offset + len(tail) + 8)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["key", "page_id", "file", "length"])

    order = ("key", "page_id", "file", "offset")
    sorted_ = captures.select("key", "page_id", "record_type", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)
    shards = materialise(sorted_.mapInArrow(run, "key string, page_id long, file string, length long"), "shards").collect()  # a row a partition
    return CaptureIndex(folder, sorted((tuple(s) for s in shards), key=lambda s: _order(s[0], s[1])))


class _Reader:
    """Searches of one task: keeps the directory and the block it read last of the shard it is in."""

    def __init__(self, index: CaptureIndex):
        self.fs, _ = file_system(index.folder)
        self.shards, self.firsts = index.shards, [_order(s[0], s[1]) for s in index.shards]
        self.file, self.source, self.directory, self.starts, self.block_at, self.block = "", None, [], [], None, []

    def entries(self, key: str, page_id: int | None) -> Iterator[list]:
        """All entries of a key and id."""
        goal = _order(key, page_id)
        for shard in range(max(0, bisect_left(self.firsts, goal) - 1), len(self.shards)):
            if self.firsts[shard] > goal:
                return
            self._open(shard)
            for block in range(max(0, bisect_left(self.starts, goal) - 1), len(self.directory)):
                if self.starts[block] > goal:
                    break
                entries, orders = self._read(block)
                for i in range(bisect_left(orders, goal), len(orders)):
                    if orders[i] != goal:
                        break
                    yield entries[i]

    def _open(self, shard: int) -> None:
        _, _, file, length = self.shards[shard]
        if file != self.file:
            self.close()
            self.file, self.source, self.block_at = file, self.fs.open_input_file(file), None
            tail = int.from_bytes(self.source.read_at(8, length - 8), "big")
            self.directory = json.loads(zlib.decompress(self.source.read_at(tail, length - 8 - tail)))
            self.starts = [_order(d[0], d[1]) for d in self.directory]

    def _read(self, block: int) -> tuple[list, list]:
        if block != self.block_at:
            _, _, offset, length = self.directory[block]
            entries = [json.loads(x) for x in zlib.decompress(self.source.read_at(length, offset)).split(b"\n")]
            self.block_at, self.block = block, (entries, [_order(e[0], e[1]) for e in entries])
        return self.block

    def close(self) -> None:
        if self.source is not None:
            self.source.close()


def lookup(index: CaptureIndex, wanted: DataFrame) -> DataFrame:
    """The captures of ``wanted`` (page_id, url), each asked once: key, page_id, record_type, file, offset, length.

    Wanted rows are sorted like the index, so a task reads neighbouring blocks, each once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(index)
        for batch in batches:
            keys, ids = (batch.column(c).to_pylist() for c in ("key", "page_id"))
            found = [e for k, p in zip(keys, ids, strict=True) for e in reader.entries(k, p)]
            columns = list(zip(*found, strict=True)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "page_id", "record_type", "file", "offset", "length"])
        reader.close()

    keys = wanted.select(reversed_host_key(F.col("url")).alias("key"), F.col("page_id").cast("long").alias("page_id")).distinct()
    return keys.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, _CAPTURE)


def read_records(places: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at ``places`` (file, offset, length), read in file order by ranges; every payload is checked
    against its digest.  Columns: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and
    payload unless ``payloads`` is False."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    types = dict(zip([*names[:6], "payload"], (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_name, source = "", None
        for batch in batches:
            rows, size = [], 0
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != open_name:
                    if source is not None:
                        source.close()
                    fs, path = file_system(file)
                    open_name, source = file, fs.open_input_file(path)
                rows.append(parse_record(source.read_at(length, offset)))
                size += rows[-1]["payload_bytes"] if payloads else 0
                if size > 1 << 25:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in names], names)
        if source is not None:
            source.close()

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    placed = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, payloads: bool = False) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html; other columns are ignored) written to archives and read back
    by way of the index; see ``write_archives`` and ``read_records``.  Repeated rows and null ids give a
    record each; an empty table gives no archive and no rows."""
    index = build_index(write_archives(pages, least_bytes))
    return read_records(lookup(index, pages.select("page_id", "url")), payloads)
