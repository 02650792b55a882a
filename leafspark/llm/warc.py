"""WARC archives, index first.

Tasks write gzip members, one a record, and return for each the file, offset, length, URL and digest. That index is a
written table: of a task that ran twice only the committed try is in it, and what a lost try left behind is never read.
A read selects rows of the index, deals them by file, sorts them by offset, joins ranges that lie close together and
fetches each joined range with one read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leafspark.llm.shared import pick, shared_folder, write_table

#: A file is closed when it is this large.
FILE_BYTES = 256 << 20
#: Ranges at most so far apart are read as one, up to so many bytes a read.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: A reading task gets about so many bytes of archives, whatever the size of the index.
TASK_BYTES = 16 << 20
#: Payloads of fewer bytes are never written as revisits.
REVISIT_BYTES = 1000

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, record_type, refers_to) for every row of pages.

    Of equal payloads (by SHA-1) of at least revisit_bytes, the one with the largest page_id is the response and the
    others revisit it. A null html is an empty payload. A null page_id never owns a payload that a numbered page has;
    rows that repeat the owner's page_id are responses too. Smaller payloads are all responses.
    """
    src = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))
    payload = F.coalesce("html", F.lit(""))
    src = src.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    owners = src.where(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    owners = owners.where("n > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "owner")
    joined = src.join(owners, (src.payload_digest == owners.d) & (src.payload_bytes == owners.b), "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("owner")).alias("refers_to"))


def _record(row: dict) -> bytes:
    """One record; a revisit has no payload. Control characters and % of a URL are percent-encoded."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else (row["html"] or "").encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="".join(chr(c) for c in range(33, 127) if c != 37)))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {row['refers_to']}"]
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: text/html; charset=utf-8",
              f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _parsed(member: bytes) -> dict:
    """The fields of one gzip member; the digest and size of a response are those of the payload that was read."""
    import hashlib
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[:int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-Id"), "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, "record_type": fields["WARC-Type"],
            "refers_to": number("X-Refers-To-Page-Id"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
            "payload_bytes": number("X-Payload-Length") if revisit else len(payload), "payload": None if revisit else payload}


def _store(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def write_archives(records: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Write the rows of plan_records as .warc.gz files under folder; returns the written index of all records.

    folder is a URI that driver and executors share (by default a part of spark.checkpoint.dir). File names are new for
    each try of a task. No rows give no file and an empty index.
    """
    folder = folder or f"{shared_folder(records.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                spots = []
                for row in batch.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(_record(row)) + packer.flush()
                    out.write(member)
                    spots.append((name, at, len(member)))
                    at += len(member)
                kept = [batch.column(c) for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")]
                spot = [pa.array([s[i] for s in spots], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(kept + spot, ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()
    index = records.select("page_id", "url", "html", "payload_digest", "payload_bytes", "record_type", "refers_to").mapInArrow(run, INDEX)
    index = write_table(index, "warc-index")
    index._archive = folder
    return index


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of index (file, offset, length) point at, parsed from the archives.

    Ranges are dealt by file and place, sorted, joined where gaps are small and read in blocks of limited size. The
    same range twice gives two rows; an empty index gives none.
    """
    schema = RECORDS if payloads else RECORDS.removesuffix(", payload binary")

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = _store(folder)
        arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
                           ("payload_bytes", pa.int64())] + ([("payload", pa.binary())] if payloads else []))
        source, opened = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            i = 0
            while i < len(rows):
                name, start, length = rows[i]
                j, end = i + 1, start + length
                while j < len(rows) and rows[j][0] == name and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - start <= READ_BYTES:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if opened != name:
                    if source is not None:
                        source.close()
                    source, opened = store.open_input_file(f"{root}/{name}"), name
                block = source.read_at(end - start, start)
                found = [_parsed(block[o - start:o - start + n]) for _, o, n in rows[i:j]]
                yield pa.RecordBatch.from_pylist(found, schema=arrow)
                i = j
        if source is not None:
            source.close()
    total = index.agg(F.sum("length")).first()[0] or 0
    spots = index.select("file", "offset", "length").repartitionByRange(int(total // TASK_BYTES) + 1, "file", "offset").sortWithinPartitions("file", "offset")
    return spots.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **names: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from its record."""
    index = write_archives(plan_records(pages, **names), folder)
    return read_records(index, index._archive, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
