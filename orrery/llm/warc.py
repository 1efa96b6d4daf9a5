"""WARC archives whose records are compressed one by one with a Zstandard dictionary of their own.

An archive begins with a skippable frame that holds the dictionary, built from records of that archive; each record
then is a frame of its own. Records of equal payload revisit the one with the largest page id. Archives go to the
shared folder under names that hold the attempt; the manifest lists those of committed tasks only, so a task that
runs again leaves nothing that is read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Notes, forget, leave_notes, materialize, placed, shared_dir, store, table, tidy

MAGIC = 0x184D2A5D
#: Payload bytes of one archive, of what a dictionary is built from, and of the dictionary; shortest payload that is revisited.
ARCHIVE_BYTES, SAMPLE_BYTES, DICT_BYTES, REVISIT_BYTES = 32 << 20, 1 << 20, 64 << 10, 1000
LEVEL = 3
#: Tasks that read archives at most; with more archives each task reads several, one after another.
READ_TASKS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(page_id, place: tuple[int, int] | None) -> str:
    """A record's id: a version 5 UUID of page and place, unique among pages that share an id and the same when a task runs again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} at {place}')}>"


def info(date: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: orrery\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_name('info', None)}", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id, url: str | None, payload: bytes, refers_to, date: str, place: tuple[int, int] | None = None) -> bytes:
    """A response, or a revisit of the page refers_to; our own headers X-Page-ID and X-Refers-To hold the pages' ids, absent for null."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, place)}", f"WARC-Date: {date}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    head += [f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"X-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Built from records until SAMPLE_BYTES are used; too few for the trainer make a dictionary of raw content."""
    sample, held = [], 0
    for r in records:
        if held >= SAMPLE_BYTES:
            break
        sample.append(r[:SAMPLE_BYTES])
        held += len(sample[-1])
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICT_BYTES:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A skippable frame with the dictionary, then warcinfo and each record as a frame of its own."""
    zdict = dictionary(records)
    raw = zdict.as_bytes()
    press = zstandard.ZstdCompressor(level=level, dict_data=zdict, write_content_size=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(press.compress, [info(date), *records])])


def parse(data: bytes) -> Iterator[dict]:
    """The records of an archive, payloads restored and checked against their digests."""
    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    raw = data[8 : 8 + n]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    with press.stream_reader(memoryview(data)[8 + n :], read_across_frames=True) as stream:
        held, at = b"", 0
        while True:
            while (end := held.find(b"\r\n\r\n", at)) < 0:
                more = stream.read(1 << 20)
                if not more:
                    return
                held, at = held[at:] + more, 0
            head = dict(x.split(": ", 1) for x in held[at:end].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            while len(held) < end + 4 + size + 4:
                held, end, at = held[at:] + stream.read(max(1 << 20, size)), end - at, 0
            http, _, payload = held[end + 4 : end + 4 + size].partition(b"\r\n\r\n")
            at = end + 4 + size + 4
            if head["WARC-Type"] == "warcinfo":
                continue
            length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
            digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
                raise ValueError("a payload differs from its digest")
            yield {"page_id": int(head["X-Page-ID"]) if "X-Page-ID" in head else None, "url": head["WARC-Target-URI"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": int(head["X-Refers-To"]) if "X-Refers-To" in head else None}


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of pages and returns the manifest (path, records, bytes).

    A null html is an empty payload and a null url an empty one. Of rows whose equal payloads have at least
    REVISIT_BYTES bytes, those with the largest id are responses and the others revisit it; rows with a null id are
    responses and nothing refers to them. An empty table gives no archives; other columns are ignored. date, of all
    records, is the time of the call by default. Digests alone are shuffled; what a page refers to returns to it as a note.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    source = placed(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("payload")), "pages")
    hashed = source.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "file_at", "row_at", F.unhex(F.sha1("payload")).alias("digest"), F.octet_length("payload").alias("size"))
    hashed = materialize(hashed, "digests")
    equal = hashed.groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.min("page_id").alias("least")).where("least < keep").drop("least")
    notes = hashed.join(equal, ["digest", "size"]).where("page_id < keep").select("file_at", "row_at", F.col("keep").alias("note"))
    told = leave_notes(notes, "revisits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        notes, held, size = Notes(told), [], 0

        def flush() -> pa.RecordBatch:
            data, name = archive(held, date=date), f"{base}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            refers = notes.of(batch.column("file_at"), batch.column("row_at"))
            for page_id, url, payload, *place, refers_to in zip(*(c.to_pylist() for c in [*batch.columns, refers]), strict=True):
                held.append(record(page_id, url, payload, refers_to, date, tuple(place)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    manifest = source.mapInArrow(tidy(run), "path string, records long, bytes long")
    manifest = materialize(manifest.select(F.lit(folder).alias("folder"), "path", "records", "bytes"), "manifest")
    forget(hashed, told)
    return manifest


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that a manifest lists, each archive read by one task."""
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, _ = store(folder)
                with fs.open_input_stream(path) as stream:
                    data = stream.read()
                rows, size = [], 0
                for r in parse(data):
                    size += len(r["payload"])
                    rows.append(r if payloads else r | {"payload": None})
                    if size >= 4 << 20:
                        yield _batch(rows, columns)
                        rows, size = [], 0
                yield _batch(rows, columns)

    # A stated number, as the manifest's rows are so small that adaptive execution would put all of them into one task.
    tasks = max(1, min(manifest.count(), READ_TASKS))
    return manifest.repartition(tasks, "path").select("folder", "path").mapInArrow(tidy(run), schema)


def _batch(rows: list[dict], columns: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in columns], names=columns)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    back = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
ORACLE = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, payload_bytes, max(page_id) AS keep FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY ALL)
SELECT page_id, p.payload_bytes, p.payload_digest, CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keep THEN keep END AS refers_to
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND p.payload_bytes = k.payload_bytes
"""
}
