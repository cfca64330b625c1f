"""TIFF page stacks as DataFrames: an image-directory walker, a writer, and a Spark data source ``tiffpages``.

Planning walks the chain of directories of each file once (a linked list, so in order, but files in parallel) and deals out blocks
of pages by their offsets; a task then reads only the directories, and with ``pixels`` the strips, of its own block.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from planeweave.schema import PAGES, PIXELS

#: Fixed values of the TIFF 6.0 format: bytes of each field type.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TAG_NAMES = {256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 296: "ResolutionUnit", 339: "SampleFormat"}
DESCRIPTION, STRIPS, STRIP_SIZES, SOFTWARE, ARTIST = 270, 273, 279, 305, 315
#: Bytes from which a written file uses 64-bit offsets.
BIG_FROM = 3_900_000_000


class TiffError(ValueError):
    """A file that is no TIFF, or one of a kind that is not read."""


@dataclass
class Layout:
    """Byte order and field widths of a file."""

    order: str
    big: bool
    size: int

    @property
    def count(self) -> tuple[str, int]:
        return (self.order + "Q", 8) if self.big else (self.order + "H", 2)

    @property
    def offset(self) -> tuple[str, int]:
        return (self.order + "Q", 8) if self.big else (self.order + "I", 4)

    @property
    def entry(self) -> int:
        return 20 if self.big else 12


def open_layout(f) -> tuple[Layout, int]:
    """The layout of an open file and the place of its first directory."""
    f.seek(0, os.SEEK_END)
    size = f.tell()
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise TiffError("not a TIFF file")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic == 42:
        return Layout(order, False, size), struct.unpack(order + "I", head[4:8])[0]
    if magic == 43 and len(head) == 16:
        return Layout(order, True, size), struct.unpack(order + "Q", head[8:16])[0]
    raise TiffError("not a TIFF file")


def walk(f, layout: Layout, first: int) -> tuple[list[int], str]:
    """Places of all directories, and a warning if the chain ends oddly: at a place seen before, beyond the file, or cut."""
    places, seen, at = [], set(), first
    fmt, width = layout.count
    ofmt, owidth = layout.offset
    while at:
        if at in seen:
            return places, "the chain of pages comes back to itself"
        if at + width > layout.size:
            return places, "the chain of pages leads beyond the file"
        seen.add(at)
        f.seek(at)
        n = struct.unpack(fmt, f.read(width))[0]
        end = at + width + n * layout.entry
        f.seek(end)
        raw = f.read(owidth)
        if len(raw) < owidth:
            return places, "the last page is cut off"
        places.append(at)
        at = struct.unpack(ofmt, raw)[0]
    return places, ""


def tags(f, layout: Layout, place: int, wanted: set[int]) -> dict[int, object]:
    """The values of ``wanted`` tags: text for strings, else a tuple of numbers."""
    fmt, width = layout.count
    f.seek(place)
    n = struct.unpack(fmt, f.read(width))[0]
    raw = f.read(n * layout.entry)
    found: dict[int, object] = {}
    for i in range(n):
        e = raw[i * layout.entry : (i + 1) * layout.entry]
        if len(e) < layout.entry:
            break
        tag, kind = struct.unpack(layout.order + "HH", e[:4])
        if tag not in wanted or kind not in TYPE_SIZE:
            continue
        count = struct.unpack(layout.order + ("Q" if layout.big else "I"), e[4 : 12 if layout.big else 8])[0]
        value, size = e[12:] if layout.big else e[8:], count * TYPE_SIZE[kind]
        if size > len(value):
            f.seek(struct.unpack(layout.offset[0], value)[0])
            value = f.read(size)
        value = value[:size]
        if kind == 2:
            found[tag] = value.rstrip(b"\0").decode("utf-8", "replace")
        elif kind in (5, 10):
            found[tag] = struct.unpack(f"{layout.order}{2 * count}{'I' if kind == 5 else 'i'}", value)
        elif kind == 7:
            found[tag] = value
        else:
            found[tag] = struct.unpack(f"{layout.order}{count}{TYPE_CODE[kind]}", value)
    return found


def dtype_of(t: dict[int, object]) -> str:
    bits = (t.get(258) or (8,))[0]
    form = (t.get(339) or (1,))[0]
    return f"{ {1: 'uint', 2: 'int', 3: 'float'}.get(form, 'uint') }{bits}"


def pixels(f, layout: Layout, place: int) -> np.ndarray:
    """The pixels of a page, in rows."""
    t = tags(f, layout, place, {256, 257, 258, 259, 277, 339, STRIPS, STRIP_SIZES})
    if (t.get(259) or (1,))[0] != 1:
        raise TiffError("compressed pixels are not read")
    raw = b""
    for at, size in zip(t[STRIPS], t[STRIP_SIZES], strict=True):
        f.seek(at)
        raw += f.read(size)
    h, w, samples = t[257][0], t[256][0], (t.get(277) or (1,))[0]
    kind = np.dtype(dtype_of(t)).newbyteorder(layout.order)
    need = h * w * samples * kind.itemsize
    if len(raw) < need:
        raise TiffError("the pixels of a page are cut off")
    out = np.frombuffer(raw[:need], kind).reshape((h, w) if samples == 1 else (h, w, samples))
    return out if samples == 1 else out[..., 0]


def file_info(path: str) -> dict[str, object]:
    """One file: directory places, a warning, header texts, the first page's tags, shape and dtype."""
    with open(path, "rb") as f:
        layout, first = open_layout(f)
        places, warning = walk(f, layout, first)
        t = tags(f, layout, places[0], {*TAG_NAMES, SOFTWARE, ARTIST}) if places else {}
        return {
            "path": path, "places": places, "warning": warning, "bigtiff": layout.big, "size": layout.size,
            "software": str(t.get(SOFTWARE, "")).replace("\r", ""), "artist": str(t.get(ARTIST, "")),
            "tags": {TAG_NAMES[k]: (v if len(v) > 1 else v[0]) for k, v in t.items() if k in TAG_NAMES},
            "shape": (t[257][0], t[256][0]) if 257 in t and 256 in t else (0, 0), "dtype": dtype_of(t) if t else "",
        }


def resolve(inputs: list[str] | str, pattern: str = "*.tif*") -> list[str]:
    """Files as they are given; folders as their files in order."""
    found: list[str] = []
    for p in [inputs] if isinstance(inputs, str) else inputs:
        p = p.removeprefix("file://")
        found += sorted(str(x) for x in Path(p).glob(pattern)) if os.path.isdir(p) else [p]
    return found


@dataclass
class Block(InputPartition):
    path: str
    file_index: int
    first_page: int
    places: list[int]


class PageReader(DataSourceReader):
    """Plans blocks of pages; ``page_start`` and ``page_stop`` bound the global page index, ``every`` and ``within`` pick
    pages of each volume, so pages that are not wanted are never read."""

    def __init__(self, options: dict):
        self.options = options
        self.with_pixels = options.get("pixels", "false").lower() == "true"

    def partitions(self):
        o = self.options
        paths = json.loads(o["paths"]) if "paths" in o else resolve(o["path"])
        start, stop = int(o.get("page_start", 0)), int(o.get("page_stop", -1))
        every, within = int(o.get("every", 0)), set(json.loads(o.get("within", "[]")))
        size = int(o.get("block", 64 if self.with_pixels else 1024))
        with ThreadPoolExecutor(16) as pool:
            infos = list(pool.map(file_info, paths))
        blocks, offset = [], 0
        for i, info in enumerate(infos):
            pages = [(offset + k, at) for k, at in enumerate(info["places"])]
            offset += len(pages)
            pages = [(p, at) for p, at in pages if p >= start and (stop < 0 or p < stop) and (not every or p % every in within)]
            for k in range(0, len(pages), size):
                part = pages[k : k + size]
                blocks.append(Block(paths[i], i, part[0][0], [x for pair in part for x in pair]))
        return blocks or [Block("", 0, 0, [])]

    def read(self, block: Block) -> Iterator[pa.RecordBatch]:
        if not block.places:
            return
        rows: list[list] = [[] for _ in range(7 if self.with_pixels else 4)]
        with open(block.path, "rb") as f:
            layout, _ = open_layout(f)
            for page, place in zip(block.places[::2], block.places[1::2], strict=True):
                if self.with_pixels:
                    image = pixels(f, layout, place)
                    values = (block.path, block.file_index, page, image.shape[0], image.shape[1], image.dtype.name, image.astype(np.float64).ravel())
                else:
                    text = tags(f, layout, place, {DESCRIPTION}).get(DESCRIPTION, "")
                    values = (block.path, block.file_index, page, text)
                for column, v in zip(rows, values, strict=True):
                    column.append(v)
        types = [pa.string(), pa.int32(), pa.int64(), *([pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64())] if self.with_pixels else [pa.string()])]
        names = (PIXELS if self.with_pixels else PAGES).names
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)


class TiffPages(DataSource):
    """``spark.read.format("tiffpages").option("pixels", ...).load(path)``."""

    @classmethod
    def name(cls):
        return "tiffpages"

    def schema(self):
        return PIXELS if self.options.get("pixels", "false").lower() == "true" else PAGES

    def reader(self, schema):
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, paths: list[str], **options: object) -> DataFrame:
    """Pages of ``paths``, numbered through all files in their order; ``pixels=True`` for pixels instead of header texts."""
    spark.dataSource.register(TiffPages)
    reader = spark.read.format("tiffpages").option("paths", json.dumps(paths))
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v) if isinstance(v, (list, tuple)) else str(v).lower() if isinstance(v, bool) else str(v))
    return reader.load()


class Writer:
    """Writes pages of one shape, a strip each; texts go to the pages that they are given for."""

    def __init__(self, path: str, big: bool = False):
        self.f, self.big = open(path, "wb"), big
        self.f.write(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
        self.link = 8 if big else 4

    def add(self, image: np.ndarray, description: str | bytes = "", software: str = "", artist: str = "") -> None:
        image = np.ascontiguousarray(image)
        form = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
        entries: list[tuple[int, int, int, bytes]] = []
        f = self.f

        def put(raw: bytes) -> int:
            f.seek(0, os.SEEK_END)
            if f.tell() % 2:
                f.write(b"\0")
            at = f.tell()
            f.write(raw)
            return at

        strip = put(image.astype(image.dtype.newbyteorder("<")).tobytes())
        h, w = image.shape
        for tag, v in ((256, w), (257, h), (258, image.dtype.itemsize * 8), (259, 1), (262, 1), (273, strip), (277, 1), (278, h), (279, image.nbytes), (339, form)):
            entries.append((tag, 16 if self.big else 4, 1, struct.pack("<Q" if self.big else "<I", v)))
        for tag, text in ((DESCRIPTION, description), (SOFTWARE, software), (ARTIST, artist)):
            if text:
                raw = (text.encode() if isinstance(text, str) else text) + b"\0"
                entries.append((tag, 2, len(raw), raw))
        width = 8 if self.big else 4
        packed = b""
        for tag, kind, count, raw in sorted(entries):
            value = raw.ljust(width, b"\0") if len(raw) <= width else struct.pack("<Q" if self.big else "<I", put(raw))
            packed += struct.pack("<HHQ" if self.big else "<HHI", tag, kind, count) + value
        at = put(struct.pack("<Q" if self.big else "<H", len(entries)) + packed + b"\0" * width)
        f.seek(self.link)
        f.write(struct.pack("<Q" if self.big else "<I", at))
        self.link = at + (8 if self.big else 2) + len(packed)

    def close(self) -> None:
        self.f.close()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def needs_big(n_pages: int, page_bytes: int) -> bool:
    return n_pages * page_bytes >= BIG_FROM
