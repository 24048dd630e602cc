"""Images from bytes without other libraries: headers of the usual formats, pixels of PNG and BMP, perceptual hashes.

Where PIL can be imported it decodes whatever else there is. Loose files have another way: Spark's image source.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np


class BadImage(ValueError):
    """Not an image, or a damaged one."""


def png_size(data: bytes) -> tuple[int, int, int]:
    if len(data) < 33:
        raise BadImage("PNG header is cut short")
    w, h, _, colour = struct.unpack(">IIBB", data[16:26])
    return w, h, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[colour]


def jpeg_size(data: bytes) -> tuple[int, int, int]:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            raise BadImage("JPEG marker expected")
        kind = data[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:
            at += 1 if kind == 0xFF else 2
            continue
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, c = struct.unpack(">HHB", data[at + 5 : at + 10])
            return w, h, c
        at += 2 + n
    raise BadImage("JPEG without a frame")


def image_size(data: bytes) -> tuple[int, int, int]:
    """(width, height, channels), from the header."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return png_size(data)
        if data[:2] == b"\xff\xd8":
            return jpeg_size(data)
        if data[:3] == b"GIF":
            return (*struct.unpack("<HH", data[6:10]), 3)
        if data[:2] == b"BM":
            w, h, _, bits = struct.unpack("<iiHH", data[18:30])
            return w, abs(h), 4 if bits == 32 else 3
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), 4 if data[20] & 16 else 3
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF, 3
        if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L":
            (b,) = struct.unpack("<I", data[21:25])
            return (b & 0x3FFF) + 1, (b >> 14 & 0x3FFF) + 1, 4 if b >> 28 & 1 else 3
    except (struct.error, KeyError, IndexError) as e:
        raise BadImage(f"damaged header: {e}") from e
    raise BadImage("cannot identify image file")


def check_whole(data: bytes) -> None:
    """Raises BadImage if a JPEG, GIF, WebP or BMP ends before its own structure does."""
    if data[:2] == b"\xff\xd8":
        # padding may follow the end mark
        if b"\xff\xda" not in data or data.rstrip(b"\0\n\r")[-2:] != b"\xff\xd9":
            raise BadImage("JPEG is cut short")
    elif data[:3] == b"GIF":
        if data.rstrip(b"\0")[-1:] != b";":
            raise BadImage("GIF is cut short")
    elif data[:4] == b"RIFF":
        if len(data) < int.from_bytes(data[4:8], "little") + 8:
            raise BadImage("WebP is cut short")
    elif data[:2] == b"BM":
        w, h, c = image_size(data)
        if len(data) < int.from_bytes(data[10:14], "little") + (w * c + 3) // 4 * 4 * h:
            raise BadImage("BMP is cut short")


def decode_png(data: bytes) -> np.ndarray:
    """height x width x channels, 8 bits a sample, palettes resolved; interlaced images are not read."""
    w, h, _ = png_size(data)
    depth, colour, _, _, interlace = struct.unpack(">BBBBB", data[24:29])
    if interlace or depth not in (8, 16) and colour not in (0, 3):
        raise BadImage("this sort of PNG is not read")
    at, packed, palette = 8, [], None
    while at + 12 <= len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise BadImage("PNG is cut short")
        if kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IEND":
            break
        at += 12 + n
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise BadImage(str(e)) from e
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    row, step = (w * samples * depth + 7) // 8, max(1, samples * depth // 8)
    if len(raw) < h * (row + 1):
        raise BadImage("PNG has too few rows")
    lines, out = np.frombuffer(raw, np.uint8, h * (row + 1)).reshape(h, row + 1), np.zeros((h, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:]
        if kind == 2:
            line = line + above
        elif kind == 1:
            pad = -row % step
            line = np.cumsum(np.pad(line, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)[:row]
        elif kind in (3, 4):
            line, new = line.tolist(), above.tolist()
            for x in range(row):
                a, b, c = line[x - step] if x >= step else 0, new[x], new[x - step] if x >= step else 0
                if kind == 3:
                    p = (a + b) // 2
                else:
                    q = a + b - c
                    pa, pb, pc = abs(q - a), abs(q - b), abs(q - c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[x] = (line[x] + p) & 255
            line = np.array(line, np.uint8)
        elif kind:
            raise BadImage("unknown PNG filter")
        out[y] = above = line
    if depth < 8:
        out = (np.unpackbits(out, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth - 1, -1, -1)))[:, :w].astype(np.uint8)
        if colour == 0:
            out = (out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    elif depth == 16:
        out = out[:, ::2]
    px = out.reshape(h, w, samples)
    if colour == 3:
        if palette is None or px.max(initial=0) >= len(palette):
            raise BadImage("PNG palette is damaged")
        px = palette[px[:, :, 0]]
    return px


def decode(data: bytes) -> np.ndarray:
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] == b"BM":
        w, h, c = image_size(data)
        (start,) = struct.unpack("<I", data[10:14])
        stride = (w * c + 3) // 4 * 4
        if len(data) < start + stride * h:
            raise BadImage("BMP is cut short")
        px = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[::-1, : w * c].reshape(h, w, c)
        return px[:, :, [2, 1, 0, *([3] if c == 4 else [])]]
    try:
        import io

        from PIL import Image
    except ImportError:
        image_size(data)  # says so if it is no image at all
        raise BadImage("no decoder for this format is installed") from None
    try:
        return np.atleast_3d(np.array(Image.open(io.BytesIO(data))))
    except (OSError, ValueError) as e:
        raise BadImage(str(e)) from e


def rgb(px: np.ndarray) -> np.ndarray:
    """Three channels: grey repeated, alpha dropped."""
    n = px.shape[2]
    return np.repeat(px[:, :, :1], 3, 2) if n < 3 else px[:, :, :3]


@lru_cache(64)
def lanczos(size: int, to: int) -> np.ndarray:
    """The matrix that brings a side of that size to another, with a three-lobed window that widens when it shrinks."""
    scale = size / to
    wide = max(scale, 1.0)
    centre = (np.arange(to) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / wide
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)
    return w / w.sum(1, keepdims=True)


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    a = np.tensordot(lanczos(px.shape[1], width), px.astype(float), (1, 1)).transpose(1, 0, 2)
    b = np.tensordot(lanczos(px.shape[0], height), np.clip(np.rint(a), 0, 255), (1, 0))
    return np.clip(np.rint(b), 0, 255).astype(np.uint8)


@lru_cache(8)
def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def perceptual_hash(px: np.ndarray, n: int = 8) -> str:
    """Hexadecimal digits of n x n x 3 bits: where the low frequencies of the three channels, at 4n x 4n, reach their median."""
    side = 4 * n
    d = dct_matrix(side)
    low = np.einsum("ij,jkc,lk->ilc", d, resize(rgb(px), side, side).astype(float), d)[:n, :n]
    bits = (low >= np.median(low)).reshape(-1)
    return "".join(f"{int(''.join('1' if b else '0' for b in bits[i : i + 4]), 2):x}" for i in range(0, len(bits), 4))


def encode_png(px: np.ndarray) -> bytes:
    """A plain PNG of 1, 3 or 4 channels."""
    h, w, c = px.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), px.astype(np.uint8).reshape(h, w * c)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
