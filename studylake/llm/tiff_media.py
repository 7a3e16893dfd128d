"""TIFF media columns: a reader of classic TIFF files, and a writer for payloads.

The reader walks the chain of image directories, decodes strips or tiles (none, LZW, deflate, PackBits), undoes horizontal differencing
and gives one row per page. It reads both byte orders, 8 and 16 bit unsigned samples, chunky layouts.

Defined results: null media give no page; a broken file or page, or one of a kind that is not read, gives a row whose error says why and
whose samples are null, and other rows go on; a chain of directories that loops ends there; repeated rows are decoded alike; an empty
table gives an empty result. Only the id and media columns are read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studylake.llm._common import bounded, id_type, slices

# Fixed values of the TIFF 6.0 specification: tags, compressions, bytes of a value by field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, FILL_ORDER = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 266
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: Each byte with its bits the other way round, for files that fill bytes from the low end.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Samples that one batch of pages holds at most, unless a page has more.
DECODED_BYTES = 8 << 20
#: Samples of one row of a stored payload, rows of one page and of one strip or tile.
ROW, PAGE_ROWS, PART_ROWS = 64, 4096, 64


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes, and literals of up to 128."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return b""
    heads = np.flatnonzero(np.r_[True, raw[1:] != raw[:-1]])
    sizes = np.diff(np.r_[heads, len(raw)])
    long = sizes >= 3
    out, at = bytearray(), 0

    def literal(stop: int) -> None:
        for i in range(at, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for head, size in zip(heads[long].tolist(), sizes[long].tolist(), strict=True):
        literal(head)
        at = head + size
        for left in range(size, 0, -128):
            n = min(left, 128)
            out += bytes((257 - n, data[head])) if n > 1 else bytes((0, data[head]))
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF's LZW: codes from the high bit, 9 to 12 bits, one code early; 256 clears, 257 ends."""
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, made = list(start), 9, 0, 0, 0
    out: list[bytes] = []
    before = b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code < 256 or code > 257:
            if not before:
                if code > 257:
                    raise ValueError("LZW code without a predecessor")
                word = table[code]
            else:
                if code < len(table):
                    word = table[code]
                elif code == len(table):
                    word = before + before[:1]
                else:
                    raise ValueError("LZW code beyond the table")
                table.append(before + word[:1])
                known = len(table)
                if known >= 511:
                    width = 12 if known >= 2047 else 11 if known >= 1023 else 10
            out.append(word)
            before = word
            made += len(word)
            if made >= size:
                break
        elif code == 256:
            table, width, before = list(start), 9, b""
        else:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    held, bits, width, known = 256, 9, 9, 258
    out = bytearray()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        held, bits = held << width | codes[word], bits + width
        codes[longer] = known
        known += 1
        word = data[i : i + 1]
        if known == 4094:
            held, bits = held << 12 | 256, bits + 12
            codes = {bytes((j,)): j for j in range(256)}
            known, width = 258, 9
        elif known > 511:
            width = 12 if known > 2047 else 11 if known > 1023 else 10
        if bits > 4096:
            rest = bits & 7
            out += (held >> rest).to_bytes((bits - rest) // 8, "big")
            held, bits = held & ((1 << rest) - 1), rest
    if word:
        held, bits = held << width | codes[word], bits + width
        known += 1
        if known > 511:
            width = 12 if known > 2047 else 11 if known > 1023 else 10
    held, bits = held << width | 257, bits + width
    pad = -bits % 8
    return bytes(out + (held << pad).to_bytes((bits + pad) // 8, "big"))


def decompress(kind: int, data: bytes, size: int) -> bytes:
    """Up to `size` bytes, one at least, of what was stored."""
    if size <= 0:
        raise ValueError("nothing is stored there")
    if kind == NONE:
        return data[:size]
    if kind == LZW:
        return lzw_decode(data, size)[:size]
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if kind == PACKBITS:
        return unpack_bits(data, size)[:size]
    raise ValueError(f"compression {kind} is not read")


def compress(kind: int, data: bytes) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: pack_bits}[kind](data)


class Page:
    """One image directory: values by tag."""

    def __init__(self, data: bytes, at: int, order: str):
        (count,) = struct.unpack_from(order + "H", data, at)
        self.tags: dict[int, tuple[int, ...]] = {}
        self.data, self.order = data, order
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            form = {1: "B", 3: "H", 4: "I"}.get(kind)
            if form is None or not n:
                continue
            size = TYPE_BYTES[kind] * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            if size > len(data):
                raise ValueError("a tag has more values than the file has bytes")
            self.tags[tag] = struct.unpack_from(f"{order}{n}{form}", data, place)
        (self.next,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)

    def one(self, tag: int, default: int | None = None) -> int:
        if tag not in self.tags and default is None:
            raise ValueError(f"tag {tag} is missing")
        return self.tags.get(tag, (default,))[0]

    def samples(self) -> np.ndarray:
        """height x width x samples, in native byte order."""
        width, height, per = self.one(WIDTH), self.one(HEIGHT), self.one(SAMPLES, 1)
        bits = set(self.tags.get(BITS, (1,)))
        kind, predictor = self.one(COMPRESSION, NONE), self.one(PREDICTOR, 1)
        if bits not in ({8}, {16}) or self.one(SAMPLE_FORMAT, 1) != 1 or (per > 1 and self.one(PLANAR, 1) != 1) or predictor not in (1, 2):
            raise ValueError("this kind of samples is not read")
        dtype = np.dtype("u1" if bits == {8} else self.order + "u2")
        tiled = TILE_OFFSETS in self.tags
        across, down = (self.one(TILE_WIDTH), self.one(TILE_HEIGHT)) if tiled else (width, min(self.one(ROWS_PER_STRIP, height), height))
        offsets, sizes = self.tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), self.tags.get(TILE_BYTES if tiled else STRIP_BYTES, ())
        if min(width, height, per, across, down) <= 0:
            raise ValueError("a length of zero")
        columns, rows = -(-width // across), -(-height // down)
        if len(offsets) < columns * rows or len(sizes) < columns * rows:
            raise ValueError("strips or tiles are missing")
        fill = self.one(FILL_ORDER, 1)
        if fill not in (1, 2):
            raise ValueError("this order of bits is not read")
        # all parts are decoded before the image is made, so what is held is what the file really has
        parts = []
        for i in range(columns * rows):
            high = down if tiled else min(down, height - i // columns * down)
            size = high * across * per * dtype.itemsize
            stored = self.data[offsets[i] : offsets[i] + sizes[i]]
            raw = decompress(kind, stored.translate(REVERSED) if fill == 2 else stored, size)
            if len(raw) < size:
                raise ValueError("a strip or tile ends early")
            parts.append(np.frombuffer(raw, dtype, high * across * per).reshape(high, across, per))
        image = np.zeros((height, width, per), dtype.newbyteorder("="))
        for i, part in enumerate(parts):
            top, left = i // columns * down, i % columns * across
            part = part.astype(image.dtype)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=image.dtype)
            image[top : top + len(part), left : left + across] = part[: height - top, : width - left]
        return image


def pages(data: bytes) -> Iterator[dict]:
    """One dict per page."""
    fields = dict.fromkeys(("width", "height", "samples_per_pixel", "bits", "compression", "predictor", "tiled", "samples", "error"))
    try:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a classic TIFF file")
        (at,) = struct.unpack_from(order + "I", data, 4)
        seen: set[int] = set()
        number = 0
        while at and at not in seen:
            seen.add(at)
            page = Page(data, at, order)
            row = fields | {"page": number, "width": page.one(WIDTH), "height": page.one(HEIGHT), "samples_per_pixel": page.one(SAMPLES, 1), "bits": page.one(BITS, 1), "compression": page.one(COMPRESSION, NONE), "predictor": page.one(PREDICTOR, 1), "tiled": TILE_OFFSETS in page.tags}
            try:
                row["samples"] = page.samples().tobytes()
            except (ValueError, IndexError, struct.error, zlib.error) as e:
                row["error"] = str(e) or "broken"
            yield row
            number, at = number + 1, page.next
    except (ValueError, IndexError, struct.error) as e:
        yield fields | {"page": -1, "error": str(e) or "broken"}


def write(payload: bytes, kind: int = DEFLATE, predictor: int = 2, tiled: bool = False) -> bytes:
    """A little-endian file of 8-bit grey pages, 64 samples wide, that holds the payload (a multiple of 64 bytes)."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for top in range(0, len(payload), ROW * PAGE_ROWS):
        image = np.frombuffer(payload, np.uint8, min(len(payload) - top, ROW * PAGE_ROWS), top).reshape(-1, ROW)
        offsets, sizes = [], []
        for first in range(0, len(image), PART_ROWS):
            part = image[first : first + PART_ROWS]
            if tiled and len(part) < PART_ROWS:
                part = np.vstack([part, np.zeros((PART_ROWS - len(part), ROW), np.uint8)])
            if predictor == 2:
                part = np.c_[part[:, :1], part[:, 1:] - part[:, :-1]]
            stored = compress(kind, part.tobytes())
            offsets.append(len(out))
            sizes.append(len(stored))
            out += stored + b"\0" * (len(stored) & 1)
        layout = [(TILE_WIDTH, 3, [ROW]), (TILE_HEIGHT, 3, [PART_ROWS]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tiled else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 3, [PART_ROWS]), (STRIP_BYTES, 4, sizes)]
        tags = sorted([(WIDTH, 3, [ROW]), (HEIGHT, 3, [len(image)]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor]), *layout])
        entries = bytearray()
        for tag, form, values in tags:
            raw = struct.pack(f"<{len(values)}{'H' if form == 3 else 'I'}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw
                raw = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, form, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(text: bytes) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


#: How payloads are stored, by their CRC-32: every decoder has its share, and equal texts are stored alike.
STORED = ((DEFLATE, 2, False), (PACKBITS, 1, False), (LZW, 1, True), (DEFLATE, 2, True))


def stored(payload: bytes) -> bytes:
    return write(payload, *STORED[zlib.crc32(payload) % len(STORED)])


PAGE = "page int, width int, height int, samples_per_pixel int, bits int, compression int, predictor int, tiled boolean, samples binary, error string"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, media: each text as a TIFF file."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([stored(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return bounded(rows).mapInArrow(run, f"id {id_type(df, id_col)}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def decode_pages(df: DataFrame, media_col: str = "media", columns: list[str] | None = None) -> DataFrame:
    """The given columns (all others than the media by default) and one row per page; pages of a file stand together, in order."""
    kept = columns if columns is not None else [c for c in df.columns if c != media_col]
    names = [n.split()[0] for n in PAGE.split(", ")]
    if clash := set(names) & set(kept):
        raise ValueError(f"columns named as the pages' own: {sorted(clash)}")

    def give(part: pa.RecordBatch, own: list[int], rows: list[dict]) -> pa.RecordBatch:
        columns = [c.take(pa.array(own, pa.int64())) for c in part.columns[1:]]
        made = [pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *names])

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                own, rows, held = [], [], 0
                for i, data in enumerate(part.column(0).to_pylist()):
                    for row in pages(data) if data is not None else ():
                        own.append(i)
                        rows.append(row)
                        held += len(row["samples"] or b"")
                        if held > DECODED_BYTES:
                            yield give(part, own, rows)
                            own, rows, held = [], [], 0
                yield give(part, own, rows)

    types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return bounded(df).select(media_col, *kept).mapInArrow(run, f"{fields}, {PAGE}" if kept else PAGE)


def features(counts: np.ndarray, rough: int) -> str:
    """A page-independent summary: samples, distinct values, mean, entropy in bits, mean absolute step along rows."""
    n = int(counts.sum())
    p = counts[counts > 0] / n
    return f"n={n};distinct={len(p)};mean={float((counts * np.arange(256)).sum() / n):.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};step={rough / n:.4f}"
