"""7. WARC: archives written and read back, with segment reassembly.

A page becomes a response record whose HTTP message is framed in chunks, or, when another page has the same payload, a
revisit record that names it. A message longer than a segment goes on in continuation records. The reader groups those by
the identifier of their first record, orders them by segment number, verifies the total length and decodes the chunks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fresh_path, in_batches, stored, table
from lexloom.llm.files import opened, shard_name

#: Bytes of a message in one record, of a chunk, and of an archive before the next one begins.
SEGMENT, CHUNK, ARCHIVE = 64 << 10, 16 << 10, 256 << 20
_IDS = uuid.UUID("6f1c3c2e-8f5b-4b0f-9d7e-2b1b5d9a7c11")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id}:{payload_digest}')}>"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[a : a + size] for a in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions of chunks and trailers count for nothing."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(chunk)
        at = end + 4 + size


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_plain(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _plain(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one page, in order."""
    own = digest(payload)
    name = record_id(page_id, own) if not revisit else f"<urn:uuid:{uuid.uuid4()}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z")]
    fields += [("WARC-Target-URI", url)] * (url is not None) + [("WARC-Page-ID", str(page_id))] * (page_id is not None)
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{own}")]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, own)), ("WARC-Refers-To-Page-ID", str(refers_to))]
        yield record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(message) <= segment:
        yield record(fields, message)
        return
    yield record([*fields, ("WARC-Segment-Number", "1")], message[:segment])
    for k, a in enumerate(range(segment, len(message), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        if a + segment >= len(message):
            more.append(("WARC-Segment-Total-Length", str(len(message))))
        yield record(more, message[a : a + segment])


def records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and block of each record of an archive of gzip members."""
    inflate, held, given = zlib.decompressobj(31), bytearray(), b""
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 or len(held) < end + 8 + _length(held, end):
            data = given or file.read(1 << 20)
            if not data:
                if held.strip():
                    raise ValueError("an archive is cut short")
                return
            held += inflate.decompress(data)
            given = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + _length(held, end)
        yield fields, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def _length(held: bytearray, end: int) -> int:
    head = bytes(held[:end]).lower()
    at = head.index(b"\r\ncontent-length:") + 17
    return int(head[at:].split(b"\r\n", 1)[0])


def message_payload(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_RAW = "origin string, number int, total long, kind string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, block binary"
_PAGE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, segment: int = SEGMENT, chunk: int = CHUNK) -> DataFrame:
    """Writes pages (page_id, url, html) to archives below the folder; returns the stored list of their files.

    Of rows with equal payloads of least_bytes or more, those with the largest page_id are responses and all others revisit
    it. A null html is an empty payload. A null page_id is below all others; where a group has no other, its rows are
    responses. Rows that are equal throughout give equal records.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    own = F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload"))
    digests = stored(pages.select(own.alias("d"), "page_id").where("d is not null"), "digests")
    latest = digests.groupBy("d").agg(F.max("page_id").alias("latest"), F.min("page_id").alias("least"), F.count("page_id").alias("n"), F.count(F.lit(1)).alias("all"))
    latest = stored(latest.where("latest is not null and (least < latest or n < all)").select("d", "latest"), "latest")
    marked = pages.withColumn("own", own).join(latest, F.col("own") == F.col("d"), "left")
    marked = marked.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("latest")), F.col("latest"))).select("page_id", "url", "payload", "refers_to")

    def write(batches):
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        sink, name, size, done = None, None, 0, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in columns)
                if sink is None or size >= ARCHIVE:
                    if sink is not None:
                        sink.close()
                    name, size = shard_name(".warc.gz"), 0
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    done.append(name)
                for r in page_records(page_id, url, payload, refers_to, refers_to is not None, segment, chunk):
                    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = pack.compress(r) + pack.flush()
                    sink.write(data)
                    size += len(data)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": done})

    return stored(in_batches(marked, write, "file string"), "archives")


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """A row for each page of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    intact is false where a segment lacks, the total length differs, the chunks can't be decoded or the payload hasn't the
    digest that its record gives; bytes and digest are then those of the record, or null. A revisit tells of the payload
    it refers to.
    """

    def read(batches):
        files, root = opened(folder)
        schema = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as file:
                    for f, block in records(file):
                        number = int(f["warc-segment-number"]) if "warc-segment-number" in f else None
                        page, refers = f.get("warc-page-id"), f.get("warc-refers-to-page-id")
                        row = {"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "number": number, "total": int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "kind": f["warc-type"], "page_id": int(page) if page else None, "url": f.get("warc-target-uri"), "refers_to": int(refers) if refers else None, "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": None, "block": None}
                        if number is not None:
                            row["block"] = block
                        elif row["kind"] == "revisit":
                            row["payload_bytes"] = int(block.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        else:
                            row |= _checked(block, row["payload_digest"])
                        rows.append(row)
                        held += len(row["block"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def join(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
        group: list[dict] = []
        for batch in batches:
            whole = pc.is_null(batch.column("number"))
            plain = batch.filter(whole)
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([plain.column("page_id"), plain.column("url"), plain.column("payload_bytes"), plain.column("payload_digest"), plain.column("kind"), plain.column("refers_to"), pc.is_valid(plain.column("payload_bytes"))], schema=schema)
            parts = batch.filter(pc.invert(whole))
            for i in range(parts.num_rows):
                row = {c: parts.column(c)[i].as_py() for c in parts.schema.names}
                if group and group[0]["origin"] != row["origin"]:
                    yield pa.RecordBatch.from_pylist(_assembled(group), schema)
                    group = []
                # Equal records have equal segments; only the first record of each is needed more than once.
                if not group or row["number"] == 1 or group[-1]["number"] != row["number"]:
                    group.append(row)
        if group:
            yield pa.RecordBatch.from_pylist(_assembled(group), schema)

    listed = listed.repartition(listed.sparkSession.sparkContext.defaultParallelism * 4)
    return in_batches(in_batches(listed, read, _RAW).repartition("origin").sortWithinPartitions("origin", "number"), join, _PAGE)


def _checked(message: bytes, expected: str | None) -> dict:
    """Bytes and digest of the message's payload; null bytes where it isn't what was written."""
    try:
        payload = message_payload(message)
    except ValueError:
        return {"payload_bytes": None}
    own = digest(payload)
    return {"payload_bytes": len(payload) if expected in (None, own) else None, "payload_digest": expected or own}


def _assembled(group: list[dict]) -> list[dict]:
    """Rows of the record, or of equal records, whose segments these are, in order."""
    first = [r for r in group if r["number"] == 1]
    chain = first[:1] + [r for r in group if r["number"] != 1]
    total = next((r["total"] for r in chain if r["total"] is not None), None)
    message = b"".join(r["block"] for r in chain)
    found = {"payload_bytes": None, "payload_digest": first[0]["payload_digest"] if first else None}
    if [r["number"] for r in chain] == list(range(1, len(chain) + 1)) and total == len(message):
        found |= _checked(message, found["payload_digest"])
    head = first or [{"page_id": None, "url": None}]
    return [{"page_id": r["page_id"], "url": r["url"], **found, "record_type": "response", "refers_to": None, "intact": found["payload_bytes"] is not None} for r in head]


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    listed = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(listed, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "url")
