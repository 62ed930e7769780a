"""PPM, BMP and PNG: bytes to frames and back."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

# ---- PPM

PPM_HEAD = re.compile(rb"P6(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def read_ppm(data: bytes) -> np.ndarray:
    """P6 with maxval 255; exactly one white space byte ends the header."""
    if data[:2] != b"P6":
        raise ValueError("not a P6 PPM")
    m = PPM_HEAD.match(data)
    if not m:
        raise ValueError("bad PPM header")
    w, h, top = map(int, m.groups())
    if w <= 0 or h <= 0 or top != 255:
        raise ValueError("bad PPM header")
    px = data[m.end() : m.end() + w * h * 3]
    if len(px) < w * h * 3:
        raise ValueError("incomplete PPM data")
    return np.frombuffer(px, np.uint8).reshape(h, w, 3)


def write_ppm(f: np.ndarray) -> bytes:
    if f.shape[2] != 3:
        raise ValueError("PPM needs 3 channels")
    return b"P6\n%d %d\n255\n" % (f.shape[1], f.shape[0]) + np.ascontiguousarray(f).tobytes()


# ---- BMP


def read_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 24 or 32 bits; rows upwards unless the height is negative."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP")
    start = struct.unpack_from("<I", data, 10)[0]
    w, h = struct.unpack_from("<ii", data, 18)
    bits, packing = struct.unpack_from("<HI", data, 28)
    if w <= 0 or h == 0:
        raise ValueError("bad BMP size")
    if packing or bits not in (24, 32):
        raise ValueError("unsupported BMP")
    n, rows = bits // 8, abs(h)
    stride = (w * n + 3) // 4 * 4
    if len(data) < start + stride * rows:
        raise ValueError("incomplete BMP data")
    px = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : w * n].reshape(rows, w, n)
    return (px if h < 0 else px[::-1])[..., [2, 1, 0, 3][:n]]


def write_bmp(f: np.ndarray) -> bytes:
    if f.shape[2] != 3:
        raise ValueError("BMP needs 3 channels")
    h, w = f.shape[:2]
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = f[::-1, :, ::-1].reshape(h, -1)
    body = rows.tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


# ---- PNG

PNG_HEAD = b"\x89PNG\r\n\x1a\n"
#: Samples of each colour type.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_chunks(data: bytes):
    if data[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + size]
        at += size + 12


def defilter(raw: bytes, stride: int, rows: int, step: int) -> np.ndarray:
    """Rows without their filters. None, left and up run over whole rows; average and Paeth by pixel."""
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, up = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 1:
            out[y + 1] = line.reshape(-1, step).cumsum(0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y + 1] = line + up
        elif kind in (3, 4):
            b, cur = up.tolist(), []
            for i, v in enumerate(line.tolist()):
                left, above, corner = (cur[i - step] if i >= step else 0), b[i], (b[i - step] if i >= step else 0)
                if kind == 3:
                    guess = (left + above) >> 1
                else:
                    p = left + above - corner
                    pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
                    guess = left if pa <= pb and pa <= pc else above if pb <= pc else corner
                cur.append((v + guess) & 255)
            out[y + 1] = cur
        else:
            raise ValueError("unknown PNG filter")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """8 or 16 bits (the high byte), all colour types, not interlaced; gray with alpha gives RGBA."""
    head, body, palette, clear = None, [], None, b""
    for kind, chunk in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    if head is None or not body:
        raise ValueError("PNG without IHDR or IDAT")
    w, h, depth, colour, _, _, interlaced = head
    if interlaced or depth not in (8, 16) or colour not in PNG_SAMPLES or colour == 3 and depth != 8:
        raise ValueError("unsupported PNG")
    n = PNG_SAMPLES[colour]
    step = n * depth // 8
    raw = zlib.decompress(b"".join(body))
    if len(raw) < h * (w * step + 1):
        raise ValueError("incomplete PNG data")
    px = defilter(raw, w * step, h, step).reshape(h, w, n, depth // 8)[..., 0]
    if colour == 3:
        if palette is None:
            raise ValueError("palette PNG without PLTE")
        if clear:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            palette = np.column_stack([palette, alpha])
        return palette[px[..., 0]]
    return px[..., [0, 0, 0, 1]] if colour == 4 else px


def deflate_chunks(data: bytes, level: int = 1, chunks: int = 8) -> bytes:
    """A zlib stream made of pieces that are deflated apart, each but the last flushed to a byte, with
    the check sum of the whole. Frames are the parallel unit here, so the PNG writer does not need it."""
    size = max(1, -(-len(data) // max(1, chunks)))
    out = [b"\x78\x9c"]
    starts = range(0, max(1, len(data)), size)
    for at in starts:
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        out.append(z.compress(data[at : at + size]) + z.flush(zlib.Z_FINISH if at == starts[-1] else zlib.Z_SYNC_FLUSH))
    return b"".join(out) + struct.pack(">I", zlib.adler32(data))


def write_png(f: np.ndarray, level: int = 1, filter: str = "none") -> bytes:
    """Colour type by channels, filter none or sub, one IDAT."""
    h, w, n = f.shape
    if filter not in ("none", "sub"):
        raise ValueError("the PNG filter is none or sub")
    px = np.ascontiguousarray(f).reshape(h, w * n)
    if filter == "sub":
        px = np.diff(f, axis=1, prepend=np.zeros((h, 1, n), np.uint8)).reshape(h, w * n)
    rows = np.column_stack([np.full((h, 1), int(filter == "sub"), np.uint8), px])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return PNG_HEAD + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")
