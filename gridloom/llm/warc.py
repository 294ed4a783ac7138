"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A record is a row (record_id, type, date, target_uri, headers, block); headers holds
every named field but those with a column of their own.  A derived record names its
source in WARC-Refers-To and keeps the source's URI, date and digests; its own id is
made from the source's, so a task that runs twice makes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_tree import Page
from .shared import written

RECORD = "record_id string, type string, date string, target_uri string, headers map<string,string>, block binary"
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
#: Fixed names of the fields that have columns.
OWN = {"WARC-Record-ID": "record_id", "WARC-Type": "type", "WARC-Date": "date", "WARC-Target-URI": "target_uri"}


@dataclass(frozen=True)
class Crawl:
    """What a page table lacks to be responses.  shared: keys of repeated rows that may be
    broadcast; more are joined by a shuffle."""

    date: str = "2024-01-01T00:00:00Z"
    content_type: str = "text/html; charset=utf-8"
    shared: int = 200_000


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([r | {"headers": list(r["headers"].items())} for r in rows], schema=_ARROW)


def _table(column) -> list[dict | None]:
    return [None if x is None else dict(x) for x in column.to_pylist()]


#: Equal rows that one task makes from their one.
EQUALS = 1000


def responses(pages: DataFrame, crawl: Crawl = Crawl()) -> DataFrame:
    """Response records of (page_id, url, html), with page_id.  A null html is an empty
    payload, a null url leaves the record without a target.

    A record's id is made from page_id, url and the payload's digest.  Of rows that are
    equal in all three all but the first also enter their number among these, so no two records
    share an id, and the ids do not depend on how the input is split.  Such rows are found by
    counting narrow keys, and without any nothing is joined; they are counted as one row and
    made again from it, EQUALS at a time, so many of them do not meet in one task.
    """
    frame = pages.select("page_id", "url", "html")
    key = F.xxhash64(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", F.coalesce("html", F.lit("")))
    again = written(frame.groupBy(key.alias("row_key")).count().where("count > 1").select("row_key", F.lit(True).alias("again")), "repeated")
    n = again.count()
    if n:
        frame = frame.withColumn("row_key", key).join(again.hint("broadcast" if n <= crawl.shared else "merge"), "row_key", "left")
        equal = frame.where("again").groupBy("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).agg(F.count("*").alias("n"))
        last = F.col("n") - 1
        share = equal.withColumn("share", F.explode(F.sequence(F.lit(0), F.floor(last / EQUALS)))).repartition("page_id", "url", "share")
        number = F.explode(F.sequence(F.col("share") * EQUALS, F.least((F.col("share") + 1) * EQUALS - 1, last)))
        frame = frame.where("again is null").select("page_id", "url", "html", F.lit(0).cast("long").alias("number")).unionByName(share.select("page_id", "url", "html", number.alias("number")))
    else:
        frame = frame.withColumn("number", F.lit(0).cast("long"))

    def run(batches):
        for batch in batches:
            rows = []
            for key, url, page, number in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "number")), strict=True):
                payload = (page or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: {crawl.content_type}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                headers = {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block)}
                name = record_id("response", key, url, headers["WARC-Payload-Digest"], *([number] if number else []))
                rows.append({"record_id": name, "type": "response", "date": crawl.date, "target_uri": url, "headers": headers, "block": block})
            out = _batch(rows)
            yield pa.record_batch([batch.column("page_id"), *out.columns], names=["page_id", *_ARROW.names])

    return frame.mapInArrow(run, f"page_id long, {RECORD}")


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes, bool]:
    """Status line, header fields and payload of an HTTP response block, and whether the
    payload's encodings could all be undone, the last first.  Of a broken one what comes before
    the fault is left; one that is not known (`CODINGS`) stays, with those before it."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap and not block.startswith(b"HTTP/"):
        return "", [], block, True
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).decode("latin-1").split("\r\n")
    fields = [(a.strip(), b.strip()) for a, sep, b in (x.partition(":") for x in lines[1:]) if sep]
    names: dict[str, str] = {}
    for a, b in fields:  # a field that is repeated is one list
        names[a.lower()] = f"{names[a.lower()]}, {b.lower()}" if a.lower() in names else b.lower()
    # A message is coded for its content first, and for its transfer over that.
    codings = [c for field in ("content-encoding", "transfer-encoding") for c in re.split(r"[\s,]+", names.get(field, "")) if c]
    for coding in reversed(codings):
        if coding not in CODINGS:
            return lines[0], fields, payload, False
        payload, right = CODINGS[coding](payload)
        if not right:
            return lines[0], fields, payload, False
    return lines[0], fields, payload, True


def _inflate(data: bytes) -> tuple[bytes, bool]:
    """All members of a gzip or zlib stream, or a bare deflate stream."""
    out, rest, kind = [], data, 47
    while rest:
        member = zlib.decompressobj(kind)
        try:
            # In pieces, so that a fault only costs what follows it.
            for k in range(0, len(rest), 4096):
                out.append(member.decompress(rest[k : k + 4096]))
                if member.eof:
                    rest = member.unused_data + rest[k + 4096 :]
                    break
            else:
                return b"".join(out), member.eof
        except zlib.error:
            if kind == 47 and rest is data and not any(out):
                out, kind = [], -15
                continue
            return b"".join(out), False
    return b"".join(out), True


def _unzstd(data: bytes) -> tuple[bytes, bool]:
    """All frames of a zstd stream."""
    import zstandard

    out, rest = [], data
    while rest:
        frame = zstandard.ZstdDecompressor().decompressobj()
        try:
            for k in range(0, len(rest), 4096):
                out.append(frame.decompress(rest[k : k + 4096]))
                if frame.eof:
                    rest = frame.unused_data + rest[k + 4096 :]
                    break
            else:
                return b"".join(out), False
        except zstandard.ZstdError:
            return b"".join(out), False
    return b"".join(out), True


def _unchunk(data: bytes) -> tuple[bytes, bool]:
    """The chunks on end, and whether the last, empty one is there."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return (b"".join(out), False) if out else (data, False)
        if not size:
            return b"".join(out), True
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out), False


#: Codings of a payload that can be undone; others, as br and compress, are not.
CODINGS = {"identity": lambda x: (x, True), "chunked": _unchunk, "gzip": _inflate, "x-gzip": _inflate, "deflate": _inflate, "zstd": _unzstd}


_CHARSET = re.compile(rb"""charset\s*=\s*["']?\s*([\w-]+)""", re.I)


_META = re.compile(rb"<meta\b[^>]*>", re.I)


def decoded(payload: bytes, content_type: str) -> str:
    """Text of a payload: the character set of its header, else of its first meta element that
    names one, else UTF-8; odd bytes are replaced."""
    m = _CHARSET.search(content_type.encode("latin-1", "replace"))
    m = m or next((x for y in _META.finditer(payload, 0, payload.rfind(b">") + 1) if (x := _CHARSET.search(y[0]))), None)
    try:
        return payload.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(record: dict) -> tuple[dict, dict]:
    """The metadata and conversion records of one response."""
    import html

    status, fields, payload, right = http_parts(record["block"] or b"")
    source = record["headers"] or {}
    names = {a.lower(): b for a, b in fields}
    text = decoded(payload, names.get("content-type", ""))
    page = Page(text)
    plain = page.text()
    payload_digest = source.get("WARC-Payload-Digest") or digest(payload)
    lines = [("http-status-line", status), *((f"http-header-{a.lower()}", b) for a, b in fields)]
    lines += [(f"source-{a.lower()}", b) for a, b in sorted(source.items())]
    lines += [("payload-length", str(len(payload))), ("payload-decoded", str(right).lower()), ("payload-digest-matches", str(digest(payload) == payload_digest).lower())]
    lines += [("title", " ".join(html.unescape(page.title or "").split())), ("text-length", str(len(plain)))]
    made = []
    for kind, content_type, block in (
        ("metadata", "application/warc-fields", "".join(f"{a}: {b}\r\n" for a, b in lines).encode()),
        ("conversion", "text/plain; charset=utf-8", plain.encode("utf-8", "replace")),
    ):
        headers = {"WARC-Refers-To": record["record_id"], "WARC-Refers-To-Date": record["date"], "WARC-Refers-To-Target-URI": record["target_uri"], "WARC-Source-Payload-Digest": payload_digest, "Content-Type": content_type, "WARC-Block-Digest": digest(block)}
        if kind == "conversion":
            headers["WARC-Payload-Digest"] = headers["WARC-Block-Digest"]
        made.append({"record_id": record_id(kind, record["record_id"]), "type": kind, "date": record["date"], "target_uri": record["target_uri"], "headers": {a: b for a, b in headers.items() if b is not None}, "block": block})
    return made[0], made[1]


def derivatives(records: DataFrame) -> DataFrame:
    """Two records (RECORD) for each record of type response, with the other columns of
    `records`; records of other types have none."""
    own = _ARROW.names
    rest = [c for c in records.columns if c.lower() not in own]
    frame = records.where(F.col("type") == "response").select(*rest, *own)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in rest), RECORD])

    def run(batches):
        for batch in batches:
            # A few hundred records at a time: what is made is about as large as what is read.
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                columns = {c: _table(part.column(c)) if c == "headers" else part.column(c).to_pylist() for c in own}
                rows = [x for r in range(part.num_rows) for x in derive({c: v[r] for c, v in columns.items()})]
                twice = pa.array([r for r in range(part.num_rows) for _ in range(2)], pa.int64())
                yield pa.record_batch([*(part.column(c).take(twice) for c in rest), *_batch(rows).columns], names=[*rest, *own])

    return frame.mapInArrow(run, schema)


def record_bytes(record: dict) -> bytes:
    """A record as it stands in a WARC file."""
    block = record["block"] or b""
    fields = [("WARC-Type", record["type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["target_uri"])]
    fields += [(a, b) for a, b in sorted((record["headers"] or {}).items()) if a.lower() != "content-length"]
    head = "".join(f"{a}: {b}\r\n" for a, b in fields if b is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_records(stream) -> Iterator[dict]:
    """Records of a WARC byte stream (an object with read and readline).  A record without
    a proper length has an empty block; the reader goes on at the next record's first line."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline().rstrip(b"\r\n")):
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and last:
                headers[last] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            last = name.strip()
            headers[last] = value.strip()
        names = {a.lower(): a for a in headers}
        length = headers.get(names.get("content-length", ""), "")
        block = stream.read(int(length) if re.fullmatch("[0-9]+", length) else 0)
        row = {c: headers.pop(names[a.lower()], None) if a.lower() in names else None for a, c in OWN.items()}
        headers.pop(names.get("content-length", ""), None)
        yield row | {"headers": headers, "block": block}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the .warc and .warc.gz files under `path`.  A file is streamed by one
    task, so only the largest record must fit in memory; files are the unit of work."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.where(F.col("path").rlike(r"\.warc(\.gz)?$")).repartition("path")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", name))
                with store.open_input_stream(inner, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else _Lines(raw)
                    rows, size = [], 0
                    for record in parse_records(stream):
                        rows.append(record)
                        size += len(record["block"])
                        if size > 1 << 24:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    return files.mapInArrow(run, RECORD)


class _Lines:
    """readline and read over a raw stream."""

    def __init__(self, raw):
        import io

        class Reader(io.RawIOBase):
            def readable(self):
                return True

            def readinto(self, buffer):
                data = raw.read(len(buffer))
                buffer[: len(data)] = data
                return len(data)

        self._stream = io.BufferedReader(Reader(), 1 << 20)
        self.read, self.readline = self._stream.read, self._stream.readline


def export(records: DataFrame, uri: str) -> DataFrame:
    """Writes each partition of records to one .warc.gz file under `uri` (a gzip member a
    record) and returns (path, n_records).  A file gets its name when it is whole."""

    def run(batches):
        from pyarrow import fs

        to, top = fs.FileSystem.from_uri(uri)
        to.create_dir(top, recursive=True)
        part = TaskContext.get()
        path = f"{top}/part-{part.partitionId():06d}.warc.gz"
        draft, n = f"{path}.{part.taskAttemptId()}", 0
        with to.open_output_stream(draft, compression=None) as f:
            for batch in batches:
                columns = {c: _table(batch.column(c)) if c == "headers" else batch.column(c).to_pylist() for c in _ARROW.names}
                for r in range(batch.num_rows):
                    f.write(gzip.compress(record_bytes({c: v[r] for c, v in columns.items()}), mtime=0))
                    n += 1
        to.move(draft, path)
        yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n_records"])

    return records.select(*_ARROW.names).mapInArrow(run, "path string, n_records long")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the metadata and conversion records of every page, blocks as text."""
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.select(
        "page_id", "type", "record_id", F.col("headers")["WARC-Refers-To"].alias("refers_to"), "target_uri", "date",
        F.col("headers")["Content-Type"].alias("content_type"), F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.col("headers")["WARC-Source-Payload-Digest"].alias("source_payload_digest"), F.octet_length("block").cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("text"),
    )
