"""WARC archives: written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, shared_filesystem, stage, utf8

INDEX_SCHEMA = ("file string, offset long, length long, url string, digest string, record_type string, "
                "page_id long, payload_bytes long")
RECORD_SCHEMA = ("page_id long, url string, record_type string, digest string, payload_bytes long, "
                 "refers_to long, payload binary")
_FLUSH = 4 << 20


def _base32_of_hex(col: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five hex digits are four base32 digits."""
    parts = [F.lpad(F.conv(F.substring(col, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """One row per page with its digest and record type; payloads only for responses.

    Of pages with equal payloads of at least ``min_payload`` bytes the one with the
    largest page_id (ties: url, then position) is the response; the others revisit it.
    """
    rows = stage(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                              utf8("html").alias("payload"))
                 .withColumn("digest", _base32_of_hex(F.sha1("payload")))
                 .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
                 .withColumn("row", F.monotonically_increasing_id()))
    # only digests met more than once matter; the narrow aggregate never moves a payload
    again = stage(rows.where(F.col("payload_bytes") >= min_payload)
                  .groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url", "row")).alias("first"))
                  .where("n > 1").select("digest", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")))
    first = F.col("first_row")
    return (rows.join(again, "digest", "left")
            .withColumn("record_type", F.when(first.isNull() | (first == F.col("row")) | (F.col("payload_bytes") < min_payload),
                                              "response").otherwise("revisit"))
            .select("page_id", "url", "digest", "payload_bytes", "record_type", "row",
                    F.when(F.col("record_type") == "revisit", F.col("first_page")).alias("refers_page"),
                    F.when(F.col("record_type") == "revisit", first).alias("refers_row"),
                    F.when(F.col("record_type") == "response", F.col("payload")).alias("payload")))


def _record(r: dict, date: str) -> bytes:
    """One WARC/1.0 record. Control characters of a URL are percent-encoded."""
    def urn(page, row):
        return f"<urn:page:{'' if page is None else page}:{row}>"
    body = b""
    head = [f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {urn(r['page_id'], r['row'])}", f"WARC-Date: {date}"]
    if r["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"]))
    head += [f"WARC-Payload-Digest: sha1:{r['digest']}", f"X-Payload-Length: {r['payload_bytes']}"]
    if r["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {urn(r['refers_page'], r['refers_row'])}"]
    else:
        body = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
                % len(r["payload"])) + r["payload"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _writer(folder: str, date: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = shared_filesystem(folder)
        file = f"{uuid.uuid4().hex}.warc.gz"           # a repeated task writes another file; the index names the one that counts
        out, at, index = None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{file}", compression=None, buffer_size=_FLUSH)
                gz = zlib.compressobj(level, zlib.DEFLATED, 31)      # one gzip member a record
                data = gz.compress(_record(r, date)) + gz.flush()
                out.write(data)
                index.append((f"{folder}/{file}", at, len(data), r["url"], r["digest"], r["record_type"], r["page_id"], r["payload_bytes"]))
                at += len(data)
            if len(index) >= 10_000:
                yield _rows(index)
                index = []
        if out is not None:
            out.close()                                # closed before the last index rows are out
        if index:
            yield _rows(index)
    return run


def _rows(index: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*index), kinds)], names=names)


def write_archive(pages: DataFrame, folder: str | None = None, min_payload: int = 0,
                  date: str = "1970-01-01T00:00:00Z", level: int = 2) -> DataFrame:
    """Write pages (page_id, url, html) as .warc.gz files and return their index.

    The index (one row per record: file, offset, length, url, digest, record_type,
    page_id, payload_bytes) is a written table beside the archives, so it stands
    before anything is read. Only files that it names count: what a lost or
    repeated task left is never read. Null html is an empty payload, a null url
    has no target line, null and repeated page_ids are kept, further columns are
    ignored, and an empty table gives an empty index and no file.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    where = f"{folder}/index"
    (plan_records(pages, min_payload).mapInArrow(_writer(folder, date, level), INDEX_SCHEMA)
     .write.mode("errorifexists").parquet(where))
    return pages.sparkSession.read.parquet(where)


def _parse(data: bytes) -> tuple[dict, bytes]:
    head, _, body = zlib.decompress(data, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, body[: int(fields["Content-Length"])]


def _reader(gap: int, span: int):
    def spans(batches):
        """Runs of index rows of one file whose ranges lie close together."""
        run, begin, end = [], 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if run and (r["file"] != run[-1]["file"] or r["offset"] > end + gap or r["offset"] + r["length"] - begin > span):
                    yield run, begin, end
                    run = []
                if not run:
                    begin, end = r["offset"], r["offset"]
                run.append(r)
                end = max(end, r["offset"] + r["length"])
        if run:
            yield run, begin, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        fs = source = opened = None
        for rows, begin, end in spans(batches):
            if opened != rows[0]["file"]:
                if source is not None:
                    source.close()
                fs, path = shared_filesystem(rows[0]["file"])
                source, opened = fs.open_input_file(path), rows[0]["file"]
            data = source.read_at(end - begin, begin)
            out = []
            for r in rows:
                at = r["offset"] - begin
                fields, body = _parse(data[at: at + r["length"]])
                page = fields["WARC-Record-ID"].split(":")[2]
                target = fields.get("WARC-Refers-To", "<urn:page::>").split(":")[2]
                kind = fields["WARC-Type"]
                out.append((int(page) if page else None, r["url"], kind, fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            int(fields["X-Payload-Length"]), int(target) if target else None,
                            body.partition(b"\r\n\r\n")[2] if kind == "response" else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out), kinds)], names=names)
        if source is not None:
            source.close()
    return run


def read_records(index: DataFrame, gap: int = 1 << 16, span: int = 8 << 20) -> DataFrame:
    """Read the records that ``index`` (all of it or any selection) names.

    Index rows are sorted by file and offset; ranges at most ``gap`` bytes apart are
    fetched with one read of at most ``span`` bytes (or one record, if it is larger).
    Returns page_id, url, record_type, digest, payload_bytes, refers_to and payload
    (null for a revisit; ``resolve`` points it to its response). Repeated index rows
    give repeated records.
    """
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))     # the index is small, what it names isn't
    return (index.select("file", "offset", "length", "url").repartitionByRange(tasks, "file", "offset")
            .sortWithinPartitions("file", "offset").mapInArrow(_reader(gap, span), RECORD_SCHEMA))


def resolve(index: DataFrame) -> DataFrame:
    """The index with every revisit's range replaced by that of its response, so that
    ``read_records`` returns full payloads (under the response's own page_id)."""
    place = (index.where("record_type = 'response'")
             .groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("at")))
    kept = [c for c in index.columns if c not in ("file", "offset", "length")]
    moved = (index.where("record_type = 'revisit'").join(place, "digest")
             .select("at.*", *kept).select(*index.columns))
    return index.where("record_type = 'response'").unionByName(moved)


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1 of a payload, as the records carry it."""
    import hashlib
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()
