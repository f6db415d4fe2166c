"""TIFF pages: a writer for 8-bit samples and a reader that walks image directories.

The reader takes either byte order, strips and tiles, no compression, PackBits, LZW or deflate, both fill orders, samples
together or in planes, and undoes horizontal differencing; it gives one page per directory. Damaged input, and layouts that it does not
know (other sample sizes and formats, pages of more than ``MOST_SAMPLES``), raise ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: tags, field types, compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
FILL_ORDER, PLANES, SAMPLE_FORMAT = 266, 284, 339
TYPES = {1: "B", 3: "H", 4: "I"}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773

MOST_SAMPLES = 1 << 28
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out += bytes((i - start - 1,)) + data[start:i]
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; codes widen one entry early, as the format asks."""
    value, bits, out = 0, 0, bytearray()
    width, table = 9, {bytes((i,)): i for i in range(256)}
    free = 258

    def put(code: int) -> None:
        nonlocal value, bits
        value, bits = value << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(value >> bits & 255)
        value &= (1 << bits) - 1

    put(256)
    held = b""
    for byte in data:
        longer = held + bytes((byte,))
        if longer in table:
            held = longer
            continue
        put(table[held])
        table[longer], free = free, free + 1
        if free == 4095:
            put(256)
            width, table, free = 9, {bytes((i,)): i for i in range(256)}, 258
        elif free in (512, 1024, 2048):
            width += 1
        held = bytes((byte,))
    if held:
        put(table[held])
        free += 1
        if free in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append(value << 8 - bits & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, at, width, last = bytearray(), 0, 9, b""
    table: list[bytes] = []
    total = len(data) * 8
    whole = int.from_bytes(data, "big") if len(data) < 512 else None
    while at + width <= total:
        if whole is not None:
            code = whole >> total - at - width & (1 << width) - 1
        else:
            first = at >> 3
            code = int.from_bytes(data[first : first + 4].ljust(4, b"\0"), "big") >> 32 - (at & 7) - width & (1 << width) - 1
        at += width
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or code == len(table) and not last:
            raise ValueError("LZW code out of range")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        if len(out) >= size:
            break
    return bytes(out)


_PACK = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}


def _unpack(scheme: int, data: bytes, size: int) -> bytes:
    if scheme == NONE:
        out = data
    elif scheme == LZW:
        out = lzw_decode(data, size)
    elif scheme in (DEFLATE, DEFLATE_OLD):
        out = zlib.decompressobj().decompress(data, size)
    elif scheme == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"unknown compression {scheme}")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray  # height x width x samples


def write(pages: list[tuple[np.ndarray, int, int, int]]) -> bytes:
    """Little-endian file of grey 8-bit pages: (pixels, compression, predictor, tile side or 0 for one strip)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for pixels, scheme, predictor, side in pages:
        height, width = pixels.shape
        if side:
            rows, cols = -(-height // side), -(-width // side)
            padded = np.zeros((rows * side, cols * side), np.uint8)
            padded[:height, :width] = pixels
            parts = padded.reshape(rows, side, cols, side).swapaxes(1, 2).reshape(-1, side, side)
        else:
            parts = pixels[None]
        if predictor == 2:
            parts = np.concatenate([parts[:, :, :1], np.diff(parts, axis=2)], axis=2)
        offsets, sizes = [], []
        for part in parts:
            coded = _PACK[scheme](part.tobytes())
            offsets.append(len(out))
            sizes.append(len(coded))
            out += coded + b"\0" * (len(coded) & 1)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [scheme], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [side], TILE_HEIGHT: [side], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if side else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [height], STRIP_BYTES: sizes}
        entries = b""
        for tag in sorted(tags):
            raw = struct.pack(f"<{len(tags[tag])}I", *tags[tag])
            if len(raw) > 4:
                raw, place = struct.pack("<I", len(out)), raw
                out += place
            entries += struct.pack("<HHI", tag, 4, len(tags[tag])) + raw
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


def read(data: bytes) -> list[Page]:
    """All pages, in directory order."""
    end = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if end is None:
        raise ValueError("not a TIFF file")
    try:
        at, pages, seen = struct.unpack_from(end + "I", data, 4)[0], [], set()
        while at:
            if at in seen:
                raise ValueError("directories form a ring")
            seen.add(at)
            n = struct.unpack_from(end + "H", data, at)[0]
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
                if kind in TYPES:
                    form = f"{end}{count}{TYPES[kind]}"
                    place = at + 10 + 12 * k
                    if struct.calcsize(form) > 4:
                        place = struct.unpack_from(end + "I", data, place)[0]
                    tags[tag] = struct.unpack_from(form, data, place)
            if not all(tags.values()):
                raise ValueError("a tag has no values")
            pages.append(_page(data, tags, end))
            at = struct.unpack_from(end + "I", data, at + 2 + 12 * n)[0]
        return pages
    except (struct.error, KeyError, zlib.error) as e:
        raise ValueError(f"damaged TIFF: {e}") from e


def _page(data: bytes, tags: dict, end: str) -> Page:
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    samples, bits = tags.get(SAMPLES, (1,))[0], tags.get(BITS, (1,))[0]
    scheme, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
    tags.setdefault(BITS, (1,))
    fill, planes = tags.get(FILL_ORDER, (1,))[0], tags.get(PLANES, (1,))[0]
    if bits not in (8, 16) or len(set(tags[BITS])) > 1 or set(tags.get(SAMPLE_FORMAT, (1,))) - {1, 4}:
        raise ValueError("samples are not unsigned, or not of 8 or 16 bits")
    if fill not in (1, 2) or planes not in (1, 2) or predictor not in (1, 2):
        raise ValueError(f"unknown fill order {fill}, planes {planes} or predictor {predictor}")
    kind = np.dtype(np.uint8 if bits == 8 else end + "u2")
    tiled = TILE_OFFSETS in tags
    if tiled:
        across, down = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
        offsets, sizes = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        across, down = width, min(tags.get(ROWS_PER_STRIP, (height,))[0], height)
        offsets, sizes = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    if not min(width, height, samples, across, down):
        raise ValueError("a page, strip or tile has no samples")
    cols, rows = -(-width // across), -(-height // down)
    deep, layers = (1, samples) if planes == 2 else (samples, 1)
    if rows * down * cols * across * samples > MOST_SAMPLES or len(offsets) != rows * cols * layers or len(sizes) != len(offsets):
        raise ValueError("a page is too large or does not have all its strips or tiles")
    whole = np.zeros((rows * down, cols * across, samples), kind.newbyteorder("="))
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        layer, at = divmod(k, rows * cols)
        top, left = at // cols * down, at % cols * across
        lines = down if tiled else min(down, height - top)
        coded = data[offset : offset + size]
        raw = _unpack(scheme, coded.translate(_REVERSED) if fill == 2 else coded, lines * across * deep * kind.itemsize)
        part = np.frombuffer(raw, kind).reshape(lines, across, deep).astype(whole.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=whole.dtype)
        whole[top : top + lines, left : left + across, layer : layer + deep] = part
    return Page(width, height, samples, bits, scheme, predictor, tiled, whole[:height, :width])
