"""WARC archives in Zstandard: one frame for each record, a dictionary in a leading skippable frame.

Writing: tasks gather records into archives of bounded size, train a dictionary on the first payloads of
each, and write it to the shared folder under a name with the number of their attempt. The manifest, a table that Spark
commits, names the archives of the attempts that count: what a lost attempt has left is not read, however a
repeated one cuts its records. Reading: tasks open the archives of the manifest; each frame is decoded alone,
and a damaged record gives a row with an error, not a failed job.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.scratch import Scratch

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20
#: Revisits up to this many (16 bytes each) are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

READ_SCHEMA = "archive string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary, error string"


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    inner = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(inner) if inner else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: the HTTP head, and the payload unless it revisits another page's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode()
    return VERSION + b"\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(payloads: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the archive's first payloads; of their plain bytes where they are too few to train on."""
    sample, size = [], 0
    for p in payloads:
        if len(p) >= 8 and size < SAMPLE_BYTES:
            sample.append(p)
            size += len(p)
    if len(sample) >= 16 and size >= 4 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
        except zstandard.ZstdError:
            pass
    plain = b"".join(sample)[:DICTIONARY_BYTES] or VERSION
    return zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], payloads: list[bytes]) -> bytes:
    held = train(payloads)
    held.precompute_compress(level=3)
    pack = zstandard.ZstdCompressor(dict_data=held, write_checksum=True, write_content_size=True)
    body = held.as_bytes()
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body + b"".join(pack.compress(r) for r in records)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins here ends, from its header and the headers of its blocks."""
    if struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError("no frame begins here")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = 0
    while not last:
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3 or at + 3 > len(data):
            raise ValueError("broken block")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("the frame is cut off")
    return at


def parse(raw: bytes) -> dict:
    """The fields of one record; raises ValueError where a header, a length or a digest is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not found or first != VERSION:
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(": ")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.lower()] = value
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "x-payload-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    length, full = int(fields["content-length"]), int(fields["x-payload-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not match the record")
    _, found, payload = rest[:length].partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if not found or kind not in ("response", "revisit"):
        raise ValueError("no HTTP head, or another type of record")
    if kind == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without its reference")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "record_type": kind,
        "payload_bytes": full,
        "payload_digest": digest,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "url": url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None,
        "payload": payload if kind == "response" else None,
    }


def records_of(data: memoryview) -> Iterator[dict]:
    """The records of one archive; where something is wrong, a row with only ``error``."""
    try:
        magic, size = struct.unpack_from("<II", data, 0)
        if magic != DICTIONARY_FRAME or 8 + size > len(data):
            raise ValueError("no leading dictionary frame")
        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])))
        at = 8 + size
        while at < len(data):
            if len(data) - at < 8:
                raise ValueError("the archive is cut off")
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                at += 8 + size
                continue
            end = frame_end(data, at)
            try:
                yield parse(open_.decompress(data[at:end]))
            except (zstandard.ZstdError, ValueError) as wrong:
                yield {"error": f"byte {at}: {wrong}"}
            at = end
    except (struct.error, IndexError, ValueError, zstandard.ZstdError) as wrong:
        yield {"error": str(wrong)}


def write_archives(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row and returns the manifest of the archives: archive (path), records.

    Of rows with equal payloads of LEAST_REVISIT bytes or more, those with the smallest page_id hold it and
    the others refer to it. Null html is an empty payload. A null page_id never is the smallest, and its row
    holds its payload. Rows that repeat a page_id each get a record; an empty table gives no archive.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    keys = rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    again = scratch.save(keys.join(first, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "revisits")
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    rows = rows.join(side, ["page_id", "digest"], "left")
    folder = scratch.path("archives")
    path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        records: list[bytes] = []
        payloads: list[bytes] = []
        size, number = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            name = f"part-{part:06d}-{attempt}-{number:04d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:  # its own frames, whatever the name says
                out.write(archive(records, payloads))
            done = pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([len(records)], pa.int64())})
            records.clear()
            payloads.clear()
            size, number = 0, number + 1
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                page, uri, payload, digest, refers = (batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                records.append(record(page, uri, payload, digest, refers, date))
                if refers is None:
                    payloads.append(payload)
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    columns = rows.select("page_id", "url", "payload", "digest", "refers_to")
    manifest = scratch.save(columns.mapInArrow(run, "archive string, records long"), "manifest")
    scratch.drop("revisits")
    return manifest


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives of a manifest (READ_SCHEMA); error is null for a sound record, and else alone.

    An archive is one piece of work, so they are dealt out evenly; one that holds fewer or more records than the
    manifest says gives one more row with an error.
    """
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in READ_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, records in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as file:
                    content = file.read_buffer()
                held, size, seen = [], 0, 0
                for r in records_of(memoryview(content)):
                    held.append({n: r.get(n) for n in names} | {"archive": name})
                    seen += "error" not in r
                    size += len(r.get("payload") or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if seen != records:
                    held.append({"archive": name, "error": f"{seen} sound records where the manifest has {records}"})
                if held:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in held], schema)

    tasks = 4 * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive", "records").repartition(tasks, "archive").mapInArrow(run, READ_SCHEMA)
