"""Zstandard WARC archives: writer and reader.

An archive is a leading skippable frame that holds its dictionary, then one frame a record. The
dictionary comes from the archive's own first records. The reader loads it, walks the frames by
their block headers without inflating them twice, decodes one record at a time and validates
version, headers, lengths and the payload digest.

Archives are cut by size, so a task holds one at a time. They are stored as (path, content) rows of a
Parquet table in the shared folder and read back from there; ``read_archives`` takes files in the
same way, as ``binaryFile`` gives them. Equal payloads meet only as digests: the largest page id of
each repeated digest is aggregated before the shuffle and joined back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlead.llm.common import if_small, written

#: Fixed values of the formats: magic of the skippable frame with a dictionary, and of a frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: A task closes an archive at this many bytes of records.
ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES, DICTIONARY_RECORDS = 16_384, 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four groups of 40 bits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def with_revisits(df: DataFrame, html: str = "html", least_bytes: int = 0) -> DataFrame:
    """``df`` with payload (binary), payload_digest and refers_to.

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest page_id are
    responses (refers_to is null), others refer to that page_id. A null html counts as empty. A
    null page_id is never the largest: such a row revisits, unless all its equals are null too.
    Rows that repeat a page_id and its html are responses both. An empty table stays empty. Columns
    of these names are replaced, others stay.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digest = sha1_base32(payload)
    df = df.drop("payload", "payload_digest", "refers_to")
    known = df.filter(F.octet_length(payload) >= least_bytes) if least_bytes else df
    heads = known.groupBy(digest.alias("payload_digest")).agg(F.max("page_id").alias("_head"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    # only repeated digests come back; few of them are broadcast, and no page is shuffled
    rows = df.withColumn("payload_digest", digest).join(if_small(written(heads, "warc-heads")), "payload_digest", "left")
    refers = F.when(F.col("_head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_head")), F.col("_head"))
    if least_bytes:
        refers = F.when(F.octet_length(payload) >= least_bytes, refers)
    return rows.withColumns({"refers_to": refers, "payload": payload}).drop("_head", html)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or revisit record. A revisit has the response's HTTP header without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{i}")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained from the first records; where these are too few, too short or too much alike to train
    one, the start of the first record itself serves as a raw dictionary."""
    if len(records) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in records[:DICTIONARY_RECORDS]])
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(records[0][:DICTIONARY_BYTES])


def archive(records: list[bytes], level: int = 3) -> bytes:
    """One archive: the dictionary in its leading skippable frame, then a frame for each record."""
    loaded = dictionary(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=loaded, write_checksum=True)
    raw = zstandard.ZstdCompressor(level=level).compress(loaded.as_bytes())
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *(compressor.compress(r) for r in records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its header and block headers."""
    if at + 6 > len(data):
        raise ValueError("WARC: archive is cut off")
    flags = data[at + 4]
    single, has_checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("WARC: archive is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
        if kind == 3 or at > len(data):
            raise ValueError("WARC: damaged frame")
    return at + 4 * has_checksum


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    view, at, trained = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        trained, at = zstandard.ZstdCompressionDict(raw), 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("WARC: archive is cut off")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            if at + 8 > len(data):
                raise ValueError("WARC: archive is cut off")
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("WARC: no frame where a record should start")
        end = frame_end(view, at)
        frame = decompressor.decompressobj()
        raw = frame.decompress(view[at:end])
        if end > len(data) or not frame.eof:
            raise ValueError("WARC: archive is cut off")
        yield raw
        at = end


def parse(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of a record.

    Version, the required headers, both lengths and, for responses, the digest are validated.
    """
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("WARC: version or header")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if missing := [h for h in ("warc-type", "warc-record-id", "warc-date", "content-length") if h not in headers]:
        raise ValueError(f"WARC: no {', '.join(missing)}")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("WARC: Content-Length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}
    length = int(fields["content-length"])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("WARC: payload length or digest")
    url = headers.get("warc-target-uri")
    if url is not None:
        url = url.replace("%20", " ").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    number = lambda k: int(headers[k]) if k in headers else None
    return number("warc-page-id"), url, length, digest, headers["warc-type"], number("warc-refers-to-page-id"), payload


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (path, content) of the rows of ``with_revisits``, stored in the shared folder: one or
    more for each task that has rows. A page longer than ``archive_bytes`` is an archive by itself."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, held = TaskContext.get().partitionId(), 0, 0, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{n:05d}.warc.zst"]), pa.array([archive(held)], pa.binary())], names=schema.names)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                held.append(record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield made()
                    n, size, held = n + 1, 0, []
        if held:
            yield made()

    return written(rows.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(run, schema), "warc-archives")


def read_archives(archives: DataFrame, content: str = "content", with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives in a binary column (such as ``binaryFile`` gives).

    A damaged archive fails the job: records are never skipped. An empty or null archive has none.
    """
    fields = [("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType())]
    fields += [("payload", T.BinaryType())] if with_payload else []
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(fields)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held = []
                for raw in records(data.as_py() or b""):
                    held.append(parse(raw)[: len(fields)])
                    if len(held) == 512:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    return archives.select(content).mapInArrow(run, schema)
