"""WARC archives of individually compressed records that share an embedded Zstandard dictionary.

Every task writes its rows to archives of about ``archive_bytes``. The first records of an archive
(``sample_records`` at most) train its dictionary, which leads the file in a skippable frame; each
record is then a frame of its own, so any record can be read from its offset with the dictionary. An
archive's name is new for every attempt and is only used once the task has succeeded, so a lost or
repeated task leaves nothing that is read.

Records of one payload: that with the largest page_id is the response, others are revisit records that
refer to it, if the payload has ``least_bytes`` or more. Payloads meet as digests with partial maxima;
the texts themselves stay where they were read.

Defined cases: a null html is an empty payload; a null page_id is written as ``null`` and never the
largest; rows that share the largest page_id and the payload are each a response; a null url is empty, and
line breaks in it are percent-encoded; a very long page is one record, held whole while it is written; no rows make no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import scratch_dir, stored

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 500
SAMPLE_BYTES = 4 << 20
ARCHIVE_BYTES = 256 << 20
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(page_id) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    said = uri.strip("<>").rpartition(":")[2]
    return None if said == "null" else int(said)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, with the payload's length, and leaves out the payload."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(refers_to)}"]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes records to one archive: dictionary frame first, then a frame for each record."""

    def __init__(self, sink, dictionary_bytes: int = DICTIONARY_BYTES):
        self.sink, self.dictionary_bytes = sink, dictionary_bytes
        self.waiting: list[bytes] | None = []
        self.waiting_bytes = self.written = self.records = 0

    def write(self, data: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self._frame(data)
            return
        self.waiting.append(data)
        self.waiting_bytes += len(data)
        if len(self.waiting) >= SAMPLE_RECORDS or self.waiting_bytes >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        waiting, self.waiting = self.waiting, None
        dictionary = None
        try:
            dictionary = zstandard.train_dictionary(min(self.dictionary_bytes, max(1024, self.waiting_bytes // 8)), waiting, level=3)
        except zstandard.ZstdError:  # too few or too small records to train on
            dictionary = zstandard.ZstdCompressionDict(b"".join(waiting)[: self.dictionary_bytes] or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for data in waiting:
            self._frame(data)

    def _frame(self, data: bytes) -> None:
        self._put(self.compressor.compress(data))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.written += len(data)

    def close(self) -> None:
        if self.waiting:
            self._start()
        self.sink.close()


def read_archive(source):
    """(header fields, block) of every record of an archive, a record at a time."""
    head = source.read(8)
    magic, n = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    content = source.read(n)
    while len(content) < n:
        content += source.read(n - len(content))
    if content[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        content = zstandard.ZstdDecompressor().decompress(content)
    dictionary = zstandard.ZstdCompressionDict(content)
    with io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True), 1 << 20) as stream:
        while line := stream.readline():
            if line.rstrip() != b"WARC/1.1":
                raise ValueError(f"not the start of a record: {line[:40]!r}")
            fields = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.decode("utf-8").partition(":")
                fields[name] = value.strip()
            block = stream.read(int(fields["Content-Length"]))
            stream.read(4)
            yield fields, block


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the rows that are to be revisit records."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least_bytes)
    groups = slim.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    own = slim.select("page_id", "sha").join(groups.select("sha", "refers_to"), "sha")
    return own.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row of ``pages`` to archives in ``folder``; returns their paths and numbers of records."""
    again = stored(revisits(pages, least_bytes))
    few = again.count() <= BROADCAST_ROWS
    again = (F.broadcast(again) if few else again).alias("r")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha")).alias("p")
    joined = rows.join(again, F.expr("p.page_id <=> r.page_id and p.sha = r.sha"), "left").select(F.col("p.page_id").cast("long"), "p.url", "p.html", "r.refers_to")

    def scan(batches):
        store, path = pa.fs.FileSystem.from_uri(folder)
        writer, name = None, ""
        done = []
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"{path}/{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(store.open_output_stream(name))
                writer.write(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                if writer.written >= archive_bytes:
                    writer.close()
                    done.append((name, writer.records))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, writer.records))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    store, path = pa.fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return stored(joined.mapInArrow(scan, "path string, records long"))


def read(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives; digests and lengths of responses come from the payloads read."""

    def scan(batches):
        store, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path) as source:
                    for fields, block in read_archive(source):
                        rows.append(_row(fields, block))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    dealt = archives.select("path").repartition(max(1, archives.count()))
    return dealt.mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _row(fields: dict, block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response":
        n, digest = len(payload), base32_sha1(payload)
        if digest != said:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    else:
        n, digest = int(http.rpartition(b"Content-Length:")[2]), said
    refers = fields.get("WARC-Refers-To")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": page_of(refers) if refers else None}


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back."""
    folder = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes), folder)
