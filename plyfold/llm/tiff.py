"""TIFF as a media column: write payloads as 8-bit images, walk image directories, one row per page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, texts

# TIFF 6.0 tags and compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def packbits_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def code_width(following: int) -> int:
    """Bits of a code once the encoder's next free code is `following`."""
    return min(12, max(9, following.bit_length()))


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, one code early to widen: 256 clears the table, 257 ends."""
    acc = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    table, width, have = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, 9)
    nxt = 258
    for c in data:
        more = have + bytes((c,))
        if more in table:
            have = more
            continue
        put(table[have], width)
        table[more] = nxt
        nxt += 1
        if nxt == 4094:
            put(256, width)
            table, width, nxt = {bytes((i,)): i for i in range(256)}, 9, 258
        else:
            width = code_width(nxt)
        have = bytes((c,))
    if have:
        put(table[have], width)
        nxt += 1
        width = code_width(nxt)
    put(257, width)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    acc = bits = at = 0
    table, width, last, out = [], 9, None, []
    while True:
        while bits < width:
            if at == len(data):
                return b"".join(out)
            acc, bits, at = (acc << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = code_width(len(table) + 1)


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), OLD_DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}
DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}


def write(pages: list[tuple[np.ndarray, str]], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF of (samples: height x width or height x width x channels of bytes, description) pages; `tile`, a multiple of 16, cuts tiles and not strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for samples, text in pages:
        cube = samples.reshape(*samples.shape[:2], -1)
        h, w, ch = cube.shape
        if tile:
            full = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile, ch), np.uint8)
            full[:h, :w] = cube
            parts = [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        else:
            parts = [cube[y : y + rows] for y in range(0, h, rows)]
        offsets, counts = [], []
        for p in parts:
            if predictor == 2:
                p = np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1)
            blob = ENCODE[compression](np.ascontiguousarray(p).tobytes())
            offsets.append(len(out))
            counts.append(len(blob))
            out += blob + b"\0" * (len(blob) % 2)
        note = text.encode() + b"\0"
        entries = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * ch), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if ch < 3 else 2]), (DESCRIPTION, 2, note), (SAMPLES, 3, [ch]), (PREDICTOR, 3, [predictor])]
        entries += [(TILE_WIDTH, 3, [tile]), (TILE_HEIGHT, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        fields = []
        for tag, kind, values in sorted(entries):
            raw = bytes(values) if kind == 2 else struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            if len(raw) > 4:
                place, raw = len(out), raw + b"\0" * (len(raw) % 2)
                out += raw
                raw = struct.pack(order + "I", place)
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list | bytes]]]:
    """(byte order, tag values) of every image directory, in the order of their links; a link back ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags: dict[int, list | bytes] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_SIZE.get(kind, 0) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if kind in (2, 7):
                tags[tag] = bytes(data[place : place + size])
            elif kind in TYPE_CODE:
                tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, place))
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def read(data: bytes) -> Iterator[tuple[np.ndarray, str]]:
    """(samples: height x width x channels of bytes, description) of every page."""
    for _, tags in directories(data):
        w, h = tags[WIDTH][0], tags[HEIGHT][0]
        ch, how, predictor = (tags.get(t, [1])[0] for t in (SAMPLES, COMPRESSION, PREDICTOR))
        if set(tags.get(BITS, [8])) != {8} or how not in DECODE or predictor not in (1, 2):
            raise ValueError("unsupported TIFF page")
        note = bytes(tags.get(DESCRIPTION, b"")).rstrip(b"\0").decode()
        tiled = TILE_OFFSETS in tags
        tw, th = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(ROWS_PER_STRIP, [h])[0]))
        across = -(-w // tw)
        out = np.empty((h, w, ch), np.uint8)
        for k, (place, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS])):
            y, x = k // across * th, k % across * tw
            high = th if tiled else min(th, h - y)
            part = np.frombuffer(DECODE[how](data[place : place + size]), np.uint8)[: high * tw * ch].reshape(high, tw, ch)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            out[y : y + high, x : x + tw] = part[: h - y, : w - x]
        yield out, note


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, rows: int = 1024, compression: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media binary): the UTF-8 bytes of every row, padded with zero bytes to a positive multiple of `width`, as one grey 8-bit page `width` wide.

    A null text is empty and gives one row of zero samples. Repeated rows come back repeated, null ids stay; other columns are dropped.
    """

    def run(batches):
        for b in batches:
            media, sizes = [], []
            for t in b.column(1).to_pylist():
                high = max(1, -(-len(t) // width))
                page = np.frombuffer(t.ljust(high * width, b"\0"), np.uint8).reshape(high, width)
                media.append(write([(page, f"n_bytes={len(t)}")], compression, predictor, rows))
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return as_bytes(texts(df, id_col, text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(samples: np.ndarray) -> str:
    """Mean, variance and 16-bin histogram of the samples in whole numbers, so that equal pages give equal strings."""
    n = samples.size
    count = np.bincount(samples.ravel(), minlength=256)
    total, square = int(count @ np.arange(256)), int(count @ np.arange(256) ** 2)
    return f"mean={1000 * total // n};var={1000 * (n * square - total * total) // (n * n)};hist={','.join(map(str, count.reshape(16, 16).sum(axis=1)))}"


def pages(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per page of every TIFF: (doc_id, page, width, height, channels, description, samples binary, feature, error, media_bytes, media_sha256).

    A null or unreadable file gives one row with page -1 and the reason in `error`.
    """
    schema = "doc_id long, page int, width int, height int, channels int, description string, samples binary, feature string, error string, media_bytes long, media_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for key, media, size, sha in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    found = [(key, k, s.shape[1], s.shape[0], s.shape[2], note, s.tobytes(), feature(s), None, size, sha) for k, (s, note) in enumerate(read(media or b""))]
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    found = [(key, -1, None, None, None, None, None, None, f"{type(e).__name__}: {e}", size, sha)]
                rows += found
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"), F.length(media_col).cast("long").alias("media_bytes"), F.sha2(F.col(media_col), 256).alias("media_sha256"))
    return src.mapInArrow(run, schema)
