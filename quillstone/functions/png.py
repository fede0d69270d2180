"""Small plain PNGs, decoded as Spark's image source decodes them."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Bytes of a file, and of its pixels, up to which Python takes less time than the image source.
MOST_BYTES = 16_384

#: Channels and mode of the image source by a PNG's colour type.
_KINDS = {0: (1, 0), 2: (3, 16), 6: (4, 24)}


def _chunks(content: bytes) -> tuple[bytes, bytes] | None:
    """The header and the packed pixels of a PNG of critical chunks only; None for any other content."""
    if not content.startswith(b"\x89PNG\r\n\x1a\n"):
        return None
    at, header, packed = 8, None, []
    while at + 12 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size:
            return None
        if kind == b"IHDR" and header is None and size == 13:
            header = body
        elif kind == b"IDAT" and header:
            packed.append(body)
        elif kind == b"IEND" and packed:
            return header, b"".join(packed)
        else:
            return None
        at += 12 + size
    return None


def _unfiltered(lines: np.ndarray, n: int) -> np.ndarray | None:
    """Pixel bytes from ``lines``, each of which begins with its filter; ``n`` bytes are a pixel."""
    out = np.zeros((lines.shape[0], lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(lines):
        kind, raw = int(line[0]), line[1:]
        if kind == 0:
            out[y] = raw
        elif kind == 1:
            out[y] = np.cumsum(raw.reshape(-1, n), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            out[y] = raw + above
        elif kind in (3, 4):
            up, row = above.tolist(), raw.tolist()
            for x in range(len(row)):
                a, b, c = (row[x - n], up[x], up[x - n]) if x >= n else (0, up[x], 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[x] = (row[x] + guess) & 255
            out[y] = row
        else:
            return None
        above = out[y]
    return out


def decoded(content: bytes) -> tuple[int, int, int, int, bytes] | None:
    """height, width, channels, mode and pixels (blue first) of a PNG of 8 bits, not interlaced, without further chunks; else None."""
    found = _chunks(content)
    if found is None:
        return None
    width, height, depth, kind, *methods = struct.unpack(">IIBBBBB", found[0])
    if depth != 8 or kind not in _KINDS or any(methods) or not 0 < width * height * _KINDS[kind][0] <= MOST_BYTES:
        return None
    n, mode = _KINDS[kind]
    try:
        flat = zlib.decompress(found[1])
    except zlib.error:
        return None
    if len(flat) != height * (1 + width * n):
        return None
    pixels = _unfiltered(np.frombuffer(flat, np.uint8).reshape(height, 1 + width * n), n)
    if pixels is None:
        return None
    pixels = pixels.reshape(height, width, n)
    if n > 1:
        pixels = pixels[:, :, [2, 1, 0, 3][:n]]
    return height, width, n, mode, pixels.tobytes()
