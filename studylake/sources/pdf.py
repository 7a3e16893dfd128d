"""Pages of PDF files, counted from their own tables of objects: cross-reference tables, cross-reference streams and object streams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]+\s*)*(?:(<<|>>|\[|\])|/([^\s()<>\[\]{}/%]*)|(\d+)\s+(\d+)\s+R(?![A-Za-z])|([+-]?\d*\.?\d+)|\(|(<[0-9A-Fa-f\s]*>)|([A-Za-z]+))")
#: Links between tables that are followed, objects that stand for others, bytes that a stream may inflate to.
LINKS, HOPS, LARGEST = 4096, 64, 64 << 20


class Broken(ValueError):
    """The file is no PDF that can be read."""


class Reference(tuple):
    """Number of an object that stands elsewhere."""


def _value(data: bytes, at: int) -> tuple[object, int]:
    """The value at a place, and where it ends: dict, list, bytes (names), Reference, int, float, None for strings and words."""
    stack: list[list] = []
    while True:
        found = TOKEN.match(data, at)
        if not found:
            raise Broken("no value")
        at, mark = found.end(), found[1]
        made: object = None
        if mark in (b"<<", b"["):
            stack.append([mark])
            continue
        if mark in (b">>", b"]"):
            if not stack or (stack[-1][0] == b"<<") != (mark == b">>"):
                raise Broken("brackets")
            own = stack.pop()[1:]
            made = own if mark == b"]" else {k: v for k, v in zip(own[::2], own[1::2], strict=False) if isinstance(k, bytes)}
        elif found[2] is not None:
            made = found[2]
        elif found[3]:
            made = Reference((int(found[3]),))
        elif found[5]:
            made = float(found[5]) if b"." in found[5] else int(found[5])
        elif found[0].endswith(b"("):
            depth = 1
            for ch in re.finditer(rb"\\.|[()]", data[at : at + 65_536], re.S):
                depth += {b"(": 1, b")": -1}.get(ch[0], 0)
                if not depth:
                    at += ch.end()
                    break
            else:
                raise Broken("string")
        if not stack:
            return made, at
        stack[-1].append(made)


class File:
    """Objects of one file, found as readers ask for them."""

    def __init__(self, data: bytes):
        self.data, self.places, self.trailer, self.streams = data, {}, {}, {}
        starts = re.findall(rb"startxref\s+(\d+)", data[-2048:])
        if not data[:1024].lstrip().startswith(b"%PDF-") or not starts:
            raise Broken("no PDF")
        todo, seen = [int(starts[-1])], set()
        while todo and len(seen) < LINKS:
            if (at := todo.pop(0)) in seen:
                continue
            seen.add(at)
            held = self._table(at) if re.match(rb"\s*xref", data[at : at + 16]) else self._table_stream(at)
            self.trailer = held | self.trailer
            todo += [held[k] for k in (b"XRefStm", b"Prev") if isinstance(held.get(k), int)]

    def _table(self, at: int) -> dict:
        at = re.compile(rb"\s*xref\s*").match(self.data, at).end()
        while section := re.compile(rb"(\d+)\s+(\d+)\s*").match(self.data, at):
            first, count, at = int(section[1]), int(section[2]), section.end()
            for i in range(count):
                entry = re.compile(rb"(\d{10}) (\d{5}) ([nf])\s*").match(self.data, at)
                if not entry:
                    raise Broken("table of objects")
                at = entry.end()
                if entry[3] == b"n":
                    self.places.setdefault(first + i, (1, int(entry[1]), 0))
        if not self.data.startswith(b"trailer", at):
            raise Broken("trailer")
        held, _ = _value(self.data, at + 7)
        return held

    def _table_stream(self, at: int) -> dict:
        held, raw = self._stream(at)
        if held.get(b"Type") != b"XRef":
            raise Broken("table of objects")
        widths = held[b"W"]
        size = sum(widths)
        index = held.get(b"Index", [0, held[b"Size"]])
        if not all(isinstance(x, int) and x >= 0 for x in [*widths, *index]) or len(widths) != 3 or not size:
            raise Broken("widths")
        numbers = [n for a, k in zip(index[::2], index[1::2], strict=False) for n in range(a, a + min(k, len(raw) // size + 1))]
        for i, number in enumerate(numbers[: len(raw) // size]):
            row, fields, k = raw[i * size : (i + 1) * size], [], 0
            for w in widths:
                fields.append(int.from_bytes(row[k : k + w], "big") if w else None)
                k += w
            kind = 1 if fields[0] is None else fields[0]
            if kind in (1, 2):
                self.places.setdefault(number, (kind, fields[1], fields[2] or 0))
        return held

    def _object(self, at: int) -> tuple[object, int]:
        head = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not head:
            raise Broken("no object")
        return _value(self.data, head.end())

    def _stream(self, at: int) -> tuple[dict, bytes]:
        held, end = self._object(at)
        begin = re.compile(rb"\s*stream\r?\n").match(self.data, end)
        if not begin or not isinstance(held, dict):
            raise Broken("no stream")
        length = self.get(held.get(b"Length"))
        if not isinstance(length, int) or length < 0:
            raise Broken("length")
        raw = self.data[begin.end() : begin.end() + length]
        filters = held.get(b"Filter")
        filters = [filters] if isinstance(filters, bytes) else filters or []
        if filters not in ([], [b"FlateDecode"]):
            raise Broken("filter")
        if filters:
            raw = zlib.decompressobj().decompress(raw, LARGEST)
        parameters = held.get(b"DecodeParms")
        parameters = parameters[0] if isinstance(parameters, list) and parameters else parameters
        if isinstance(parameters, dict) and parameters.get(b"Predictor", 1) >= 10:
            raw = _unfiltered(raw, parameters.get(b"Columns", 1))
        return held, raw

    def get(self, value: object) -> object:
        """What a reference stands for; other values are themselves."""
        for _ in range(HOPS):
            if not isinstance(value, Reference):
                return value
            kind, place, number = self.places.get(value[0], (0, 0, 0))
            if kind == 0:
                return None
            if kind == 1:
                value = self._object(place)[0]
            else:
                if b"Encrypt" in self.trailer:
                    raise Broken("encrypted")
                if place not in self.streams:
                    held, raw = self._stream(self.places[place][1])
                    heads = [*map(int, raw[: held[b"First"]].split())]
                    self.streams[place] = raw, held[b"First"], heads[1::2]
                raw, first, offsets = self.streams[place]
                value = _value(raw, first + offsets[number])[0]
        raise Broken("references")


def _unfiltered(raw: bytes, columns: int) -> bytes:
    """Rows of bytes after the none, sub and up filters that tables of objects are stored with."""
    out, above = bytearray(), bytearray(columns)
    for at in range(0, len(raw) - columns, columns + 1):
        kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + columns])
        if kind not in (0, 1, 2):
            raise Broken("row filter")
        for i in range(columns if kind else 0):
            row[i] = (row[i] + (above[i] if kind == 2 else row[i - 1] if i else 0)) & 255
        out += row
        above = row
    return bytes(out)


def count_pages(data: bytes | None) -> int | None:
    """The number of pages that a file states; null for files that are broken, encrypted in the way, or none."""
    try:
        file = File(data or b"")
        root = file.get(file.trailer.get(b"Root"))
        pages = file.get(root[b"Pages"])
        n = file.get(pages[b"Count"])
        return n if isinstance(n, int) and n >= 0 else None
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, zlib.error, OverflowError, RecursionError):
        return None


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """file, size, sha256, pages (null where they can't be counted) and copies (files with the same bytes) of the PDFs below a folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = pa.array([count_pages(x) for x in batch.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pages], names=["file", "size", "sha256", "pages"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    told = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content").mapInArrow(work, "file string, size long, sha256 string, pages int")
    return told.join(told.groupBy("sha256").agg(F.count("*").alias("copies")), "sha256").select("file", "size", "sha256", "pages", "copies")


def made(pages: int, streams: bool, note: bytes = b"") -> bytes:
    """A file with so many empty pages, its objects in a table or in streams."""
    kids = b" ".join(b"%d 0 R" % (3 + i) for i in range(pages))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (kids, pages), *[b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] >>"] * pages]
    out = bytearray(b"%PDF-1.5\n%" + note + b"\n")
    if not streams:
        places = []
        for i, x in enumerate(objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (i, x)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
    heads, body = [], b""
    for i, x in enumerate(objects, 1):
        heads.append(b"%d %d" % (i, len(body)))
        body += x + b" "
    first = b" ".join(heads) + b" "
    packed, holder = zlib.compress(first + body), len(objects) + 1
    place = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (holder, len(objects), len(first), len(packed)) + packed + b"\nendstream\nendobj\n"
    rows = [b"\0" + bytes(6), *[b"\2" + holder.to_bytes(4, "big") + i.to_bytes(2, "big") for i in range(len(objects))], b"\1" + place.to_bytes(4, "big") + bytes(2), b"\1" + len(out).to_bytes(4, "big") + bytes(2)]
    above, told = bytes(7), b""
    for row in rows:
        told += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    packed, start = zlib.compress(told), len(out)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> /Length %d >>\nstream\n" % (holder + 1, holder + 2, len(packed)) + packed
    return bytes(out + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % start)
