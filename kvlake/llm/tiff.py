"""Operator 6, media columns: TIFF files of 8-bit samples, read and written after the public TIFF 6.0 description.

Reading walks the chain of image directories, decodes PackBits, LZW or deflate strips and tiles, undoes horizontal
prediction and gives one row for each page. Free style: Arrow batches through numpy and zlib, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, by_bytes

#: Tags and codes of the format. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
CLEAR, END, FIRST, LAST_WIDTH, FULL = 256, 257, 258, 12, 4094

ROW = 64
PAGE_ROWS = 4096
STRIP_ROWS = 256
TILE = (64, 64)
#: Samples of a page at most; a directory that claims more is taken for damaged.
MAX_SAMPLES = 1 << 30


def packbits_encode(data: bytes) -> bytes:
    out, n, i = bytearray(), len(data), 0
    a = np.frombuffer(data, np.uint8)
    # starts of runs of equal bytes
    if not n:
        return b""
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))).tolist()
    literal = 0
    for s, e in zip(starts, [*starts[1:], n], strict=True):
        if e - s < 3:
            continue
        for i in range(literal, s, 128):
            part = data[i : min(i + 128, s)]
            out.append(len(part) - 1)
            out += part
        for i in range(s, e, 128):
            k = min(128, e - i)
            out += bytes((257 - k if k > 1 else 0, data[s]))
        literal = e
    for i in range(literal, n, 128):
        part = data[i : i + 128]
        out.append(len(part) - 1)
        out += part
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits, width, code, table, after = bytearray(), CLEAR, 9, 9, -1, {}, FIRST
    for b in data:
        if code < 0:
            code = b
            continue
        key = code << 8 | b
        found = table.get(key)
        if found is not None:
            code = found
            continue
        acc, bits = acc << width | code, bits + width
        table[key] = after
        after += 1
        if after == FULL:
            acc, bits = acc << width | CLEAR, bits + width
            table, after, width = {}, FIRST, 9
        elif after == 1 << width:
            width += 1
        if bits > 512:
            keep = bits & 7
            out += (acc >> keep).to_bytes(bits >> 3, "big")
            acc, bits = acc & (1 << keep) - 1, keep
        code = b
    if code >= 0:
        acc, bits = acc << width | code, bits + width
        after += 1
        if after == FULL:
            acc, bits, width = acc << width | CLEAR, bits + width, 9
        elif after == 1 << width:
            width += 1
    acc, bits = acc << width | END, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) >> 3, "big")


def lzw_decode(data: bytes) -> bytes:
    out, table, width, last = [], [], 9, b""
    acc = bits = at = 0
    single = [bytes((i,)) for i in range(256)] + [b"", b""]
    while True:
        if bits < width:
            more = data[at : at + 64]
            if not more and bits < width:
                break
            acc, bits, at = (acc & (1 << bits) - 1) << 8 * len(more) | int.from_bytes(more, "big"), bits + 8 * len(more), at + 64
            if bits < width:
                break
        bits -= width
        code = acc >> bits & (1 << width) - 1
        if code == CLEAR:
            table, width, last = list(single), 9, b""
            continue
        if code == END:
            break
        if not table:
            table = list(single)
        if last:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) == (1 << width) - 1 and width < LAST_WIDTH:  # it lags one entry behind the writer
                width += 1
        else:
            entry = table[code]
        out.append(entry)
        last = entry
    return b"".join(out)


PACK = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6), PACKBITS: packbits_encode}
UNPACK = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """A TIFF file of grey pages (height, width) or colour pages (height, width, samples) of 8-bit samples."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        a = page.reshape(*page.shape[:2], -1)
        height, width, samples = a.shape
        if tile:
            th, tw = tile
            blocks = []
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    block = np.zeros((th, tw, samples), np.uint8)
                    part = a[y : y + th, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [a[y : y + strip_rows] for y in range(0, height, strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], block[:, 1:] - block[:, :-1]), axis=1)
            data = PACK[compression](block.tobytes())
            out += b"\0" * (len(out) & 1)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tw], TILE_HEIGHT: [th], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {ROWS_PER_STRIP: [strip_rows], STRIP_OFFSETS: offsets, STRIP_COUNTS: counts}
        entries = []
        for tag, values in sorted(tags.items()):
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PREDICTOR) else 4
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) & 1)
                where, raw = len(out), raw
                out += raw
                raw = struct.pack(order + "I", where)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def decode(data: bytes) -> Iterator[tuple[dict[int, tuple], np.ndarray]]:
    """The pages of a TIFF file: its tags and an array (height, width, samples) of 8-bit samples."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags, n = {}, struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, e := at + 2 + 12 * k)
            if kind in TYPES:
                form = f"{order}{count}{TYPES[kind]}"
                where = e + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
                tags[tag] = struct.unpack_from(form, data, where)
        one = lambda tag, default: tags.get(tag, (default,))[0]  # noqa: E731, B023
        width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        if set(tags.get(BITS, (1,))) != {8} or one(284, 1) != 1:
            raise ValueError("only chunky 8-bit samples are supported")
        if width * height * samples > MAX_SAMPLES:
            raise ValueError(f"a page of {width} x {height} x {samples} samples")
        tiled = TILE_OFFSETS in tags
        bw, bh = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        places = zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS], strict=True)
        image = np.zeros((height, width, samples), np.uint8)
        for k, (where, size) in enumerate(places):
            y, x = (k // -(-width // bw) * bh, k % -(-width // bw) * bw) if tiled else (k * bh, 0)
            rows = bh if tiled else min(bh, height - y)
            raw = UNPACK[one(COMPRESSION, NONE)](data[where : where + size])
            block = np.frombuffer(raw, np.uint8, rows * bw * samples).reshape(rows, bw, samples)
            if one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=np.uint8)
            image[y : y + bh, x : x + bw] = block[: height - y, : width - x]
        yield tags, image
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def pages(files: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """(kept columns, page, width, height, samples, compression, predictor, pixels, error): one row for each page, a file's in order.

    Null media give no rows; an empty table gives none; repeated rows give repeated pages. Where a file stops being a TIFF of
    8-bit samples (damaged, cut off, absurdly large, another format), one row with error instead of pixels ends it. A
    kept column named like one of a page is called file_ and its name. A page is in memory as a whole.
    """
    keep = keep or []
    fields = {"page": "int", "width": "int", "height": "int", "samples": "int", "compression": "int", "predictor": "int", "pixels": "binary", "error": "string"}
    kept = [f"file_{c}" if c in fields else c for c in keep]
    types = [pa.int32()] * 6 + [pa.binary(), pa.string()]

    def each(data: bytes) -> Iterator[tuple]:
        k = 0
        try:
            for k, (tags, image) in enumerate(decode(data)):
                h, w, s = image.shape
                yield k, w, h, s, tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0], image.tobytes(), None
                k += 1
        except (ValueError, LookupError, ArithmeticError, struct.error, zlib.error, MemoryError) as e:
            yield k, None, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows, held = [], [], 0

            def made(of=of, rows=rows, b=b) -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                return pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(len(keep))), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))], [*kept, *fields])

            for i in range(b.num_rows):
                data = b.column(len(keep))[i].as_py()
                for row in each(data) if data is not None else ():
                    of.append(i)
                    rows.append(row)
                    held += len(row[6] or b"")
                    if held > BATCH_BYTES:
                        yield made()
                        of.clear(), rows.clear()
                        held = 0
            if rows:
                yield made()

    schema = [f"`{name}` {f.dataType.simpleString()}" for name, f in zip(kept, files.select(keep).schema, strict=True)] + [f"{name} {kind}" for name, kind in fields.items()]
    return files.select(*keep, media_col).mapInArrow(walk, ", ".join(schema))


#: How a payload is stored, by its CRC: compression, predictor, tile. Equal payloads are stored alike.
FORMS = ((DEFLATE, 2, None), (LZW, 1, None), (DEFLATE, 1, TILE), (PACKBITS, 1, None), (DEFLATE, 2, TILE), (LZW, 2, TILE), (DEFLATE, 1, None), (PACKBITS, 2, TILE))


def store(payload: bytes) -> bytes:
    """A TIFF file of pages of at most PAGE_ROWS rows of ROW samples that hold a payload (a multiple of ROW bytes)."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    compression, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    return encode([a[y : y + PAGE_ROWS] for y in range(0, len(a), PAGE_ROWS)], compression, predictor, tile)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as UTF-8 (null: empty), padded with zero bytes to a positive multiple of ROW, in a TIFF file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = [store(r + b"\0" * (-len(r) % ROW or ROW * (not r))) for r in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    one = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(write, f"id {one.schema['id'].dataType.simpleString()}, n_bytes long, media binary")


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """(kept columns, payload_bytes, payload_sha256, tail_crc32, feature): a row for each file, from its rows of pages, which must follow each other; nulls where a page is an error."""
    names = [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    types = [pa.int64(), pa.string(), pa.int64(), pa.string()]

    def one(head: list, parts: list[bytes | None], rows: int) -> pa.RecordBatch:
        if None in parts:
            return pa.RecordBatch.from_arrays([*head, *(pa.nulls(1, t) for t in types)], names)
        payload = b"".join(parts)
        a = np.frombuffer(payload, np.uint8)
        feature = f"pages={len(parts)} rows={rows} mean={a.mean():.4f} deviation={a.std():.4f} values={len(np.flatnonzero(np.bincount(a, minlength=256)))}"
        return pa.RecordBatch.from_arrays([*head, pa.array([len(payload)]), pa.array([hashlib.sha256(payload).hexdigest()]), pa.array([zlib.crc32(payload[-ROW:])]), pa.array([feature])], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts, rows = None, [], 0
        for b in batches:
            out = []
            for i in range(b.num_rows):
                page, height, pixels = (b.column(len(keep) + k)[i].as_py() for k in range(3))
                if page == 0:
                    if head:
                        out.append(one(head, parts, rows))
                    head, parts, rows = [b.column(j).slice(i, 1) for j in range(len(keep))], [], 0
                parts.append(pixels)
                rows += height or 0
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
        if head:
            yield one(head, parts, rows)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(keep).schema)
    return found.select(*keep, "page", "height", "pixels").mapInArrow(gather, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
