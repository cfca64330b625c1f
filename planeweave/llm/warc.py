"""WARC records: responses, and the metadata and conversion records derived from them.

A metadata record holds as JSON the source record's headers, its HTTP status and headers, and the page's title and links; a
conversion record holds the page's main text. Both name the response in WARC-Refers-To, keep its target and date, and carry
digests of their own block; the metadata keeps the source's digests. Bodies are taken out of chunks and compression, and read in the
character set that the headers or the page name. Records are built where their source is read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.llm.common import bounded
from planeweave.llm.html import decode, main_text, tags

VERSION = b"WARC/1.1"
#: Record ids are made from what a record says, so that a lost task makes the same ones again.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:planeweave:warc")
LINKED = {"a": "href", "link": "href", "img": "src", "script": "src", "iframe": "src"}
REFERENCE = re.compile(r"""(href|src)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.IGNORECASE)
CHARSET = re.compile(rb"""charset\s*+=\s*+["']?([A-Za-z0-9._:-]+)""", re.IGNORECASE)
#: Bytes in which a page names its character set, as browsers have it.
HEAD = 1024
#: Bytes read at once, and the size at which a written file ends.
CHUNK, FILE_BYTES = 1 << 20, 256 << 20
FIELDS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, record binary"


@dataclass
class Record:
    """A record: its headers in order, and its block."""

    headers: list[tuple[str, str]]
    block: bytes

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        lines = [VERSION, *(f"{k}: {v}".encode() for k, v in self.headers if k.lower() != "content-length"), b"Content-Length: %d" % len(self.block)]
        return b"\r\n".join(lines) + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n\0]+", " ", value).strip()


def unzipped(data: bytes) -> bytes:
    """All members of gzipped data, one after the other; what breaks off gives what came before."""
    plain, at = [], 0
    member = zlib.decompressobj(31)
    while at < len(data):
        part = data[at : at + CHUNK]
        at += len(part)
        while part:
            try:
                plain.append(member.decompress(part))
            except zlib.error:
                return b"".join(plain)
            part = member.unused_data  # never more than a chunk
            if member.eof:
                member = zlib.decompressobj(31)
    return b"".join(plain)


def read(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, plain or gzipped by record. A file that breaks off gives the records before that."""
    if data[:2] == b"\x1f\x8b":
        data = unzipped(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = []
        for line in data[at:end].split(b"\r\n")[1:]:
            if line[:1] in b" \t" and headers and line:
                headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.decode("utf-8", "replace").strip())
            elif b":" in line:
                k, _, v = line.partition(b":")
                headers.append((k.decode("utf-8", "replace").strip(), v.decode("utf-8", "replace").strip()))
        size = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit() and len(v) < 19), 0)
        if end + 4 + size > len(data):
            return
        yield Record(headers, data[end + 4 : end + 4 + size])
        at = end + 4 + size


def response(url: str | None, html: str | None, date: str, key: str = "") -> Record:
    """A response record for a page; a null page has an empty body, a null url no target."""
    body = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    target = [("WARC-Target-URI", _clean(url))] if url is not None else []
    return Record([("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url or "", digest(block))), *target, ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))], block)


def _http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [[k.strip(), v.strip()] for k, _, v in (x.partition(":") for x in lines)], body


def _dechunked(body: bytes) -> bytes:
    """The data of chunks; as far as they go where they break off."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip()[:16], 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def _inflated(body: bytes, coding: str) -> bytes:
    """The body out of its coding; as it is if that is not known or does not hold."""
    try:
        if coding in ("gzip", "x-gzip"):
            return unzipped(body) if body[:2] == b"\x1f\x8b" else body
        if coding == "deflate":
            try:
                return zlib.decompressobj().decompress(body)
            except zlib.error:
                return zlib.decompressobj(-15).decompress(body)
        if coding == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(body)
    except (zlib.error, ValueError):
        pass
    return body


def text_of(http: list[list[str]], body: bytes) -> str:
    """The text of a response's body."""
    named = {k.lower(): v for k, v in http}
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    for coding in reversed(named.get("content-encoding", "").lower().split(",")):
        body = _inflated(body, coding.strip())
    found = CHARSET.search(named.get("content-type", "").encode()) or CHARSET.search(body[:HEAD])
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def title_and_links(page: str) -> tuple[str | None, list[list[str]]]:
    """The first title's text and the links of ``LINKED`` elements, in page order."""
    title, links, begun = None, [], -1
    for start, end, closes, tag, attributes in tags(page):
        if tag == "title" and title is None:
            if closes and begun >= 0:
                title = " ".join(decode(page[begun:start]).split())
            elif not closes and begun < 0:
                begun = end
        elif not closes and tag in LINKED:
            if m := next((m for m in REFERENCE.finditer(attributes) if m[1].lower() == LINKED[tag] and (not m.start() or attributes[m.start() - 1].isspace())), None):
                links.append([tag, decode(m[2].strip("\"'"))])
    return title, links


def derive(source: Record) -> list[Record]:
    """The metadata and the conversion record of a response."""
    status, http, body = _http(source.block)
    page = text_of(http, body)
    about = source.get("WARC-Record-ID") or record_id("unnamed", digest(source.block))
    kept = [(k, source.get(k)) for k in ("WARC-Target-URI", "WARC-Date")]
    kept = [(k, v) for k, v in kept if v is not None]
    title, links = title_and_links(page)
    told = {
        "source": {"headers": [list(h) for h in source.headers], "length": len(source.block), "block_digest": digest(source.block), "payload_digest": digest(body)},
        "http": {"status": status, "headers": http},
        "html": {"title": title, "links": links},
    }
    blocks = [("metadata", "application/json", json.dumps(told, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", main_text(page).encode("utf-8", "replace"))]
    return [Record([("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, about)), ("WARC-Refers-To", about), *kept, ("Content-Type", content), ("WARC-Block-Digest", digest(block))], block) for kind, content, block in blocks]


def _rows(keys: list, records: list[Record]) -> list[pa.Array]:
    names = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Block-Digest", "WARC-Payload-Digest")
    return [pa.array(keys, pa.int64()), *(pa.array([r.get(n) for r in records], pa.string()) for n in names), pa.array([len(r.block) for r in records], pa.int64()), pa.array([r.to_bytes() for r in records], pa.binary())]


def _columns(key: str) -> list[str]:
    return [key, *(f.split()[0] for f in FIELDS.split(", "))]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record for each page: id_col and ``FIELDS``.

    A null page has an empty body and a null url no target; a null id stays null. An empty page and one of any length are treated alike.
    Repeated rows give equal records; an empty table gives no rows; further columns, whatever their names, are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "h"):
            keys, urls, htmls = (batch.column(i).to_pylist() for i in range(3))
            made = [response(u, h, date, "" if k is None else str(k)) for k, u, h in zip(keys, urls, htmls, strict=True)]
            yield pa.RecordBatch.from_arrays(_rows(keys, made), _columns(id_col))

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h")).mapInArrow(run, f"{id_col} long, {FIELDS}")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record") -> DataFrame:
    """The metadata and conversion records of the response records in ``record_col``: id_col and ``FIELDS``.

    A row may hold several records; those of other types, and null, empty or broken ones, give none. A null id stays null, a record of
    any length is read whole, repeated rows give equal records each, an empty table gives no rows, and further columns, whatever their
    names, are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "record"):
            keys, made = [], []
            for key, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                for source in read(data or b""):
                    if source.get("WARC-Type") == "response":
                        made += derive(source)
                        keys += [key, key]
                if len(made) > 500:
                    yield pa.RecordBatch.from_arrays(_rows(keys, made), _columns(id_col))
                    keys, made = [], []
            yield pa.RecordBatch.from_arrays(_rows(keys, made), _columns(id_col))

    return records.select(F.col(id_col).cast("long").alias(id_col), F.col(record_col).cast("binary").alias("record")).mapInArrow(run, f"{id_col} long, {FIELDS}")


def write_files(records: DataFrame, folder: str, record_col: str = "record", most: int = FILE_BYTES) -> list[str]:
    """Write the records to ``folder``, a shared one: gzipped WARC files of each task, whose names are returned.

    A file ends with the record by which it reaches ``most`` bytes, appears under its name only when it is whole, and is replaced by a
    task that runs again. ``folder`` is an address with a scheme, or, in local mode alone, a path.
    """
    if "://" not in folder and not records.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster the folder needs a scheme, as file:///shared/folder")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        task = TaskContext.get()
        store.create_dir(base)
        names, out = [], None

        def part() -> str:
            return f"{base}/.part-{task.partitionId():06d}-{len(names):04d}-{task.taskAttemptId()}"

        def close() -> None:
            out.close()
            name = f"part-{task.partitionId():06d}-{len(names):04d}.warc.gz"
            store.move(part(), f"{base}/{name}")
            names.append(name)

        for batch in bounded(batches, record_col):
            for data in batch.column(0).to_pylist():
                if data is not None:
                    out = out or store.open_output_stream(part())
                    out.write(gzip.compress(data, mtime=0))
                    if out.tell() >= most:
                        close()
                        out = None
        if out:
            close()
        yield pa.record_batch({"name": pa.array(names, pa.string())})

    return sorted(r.name for r in records.select(F.col(record_col).cast("binary").alias(record_col)).mapInArrow(run, "name string").collect())


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the WARC files in ``folder``: file and ``FIELDS``. A file is one value of a task, 2 GB at most; ``write_files`` ends
    its files far below."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "content"):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[Record] = []
                for r in read(data):
                    found.append(r)
                    if len(found) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * 500), *_rows([0] * 500, found)[1:]], _columns("file"))
                        found = []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *_rows([0] * len(found), found)[1:]], _columns("file"))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", "content").mapInArrow(run, f"file string, {FIELDS}")
