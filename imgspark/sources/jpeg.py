"""JPEG: baseline and progressive, decoding and encoding, with transforms over all blocks at once."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


def _zigzag() -> list[int]:
    """Places of an 8x8 block by diagonals, in alternating direction."""
    return sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


ZIGZAG = np.array(_zigzag())
C8 = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])
C4 = np.array([[np.sqrt((1 if k == 0 else 2) / 4) * np.cos((2 * x + 1) * k * np.pi / 8) for x in range(4)] for k in range(4)])
#: Fixed values of the standard (annex K): quantisation in raster order, Huffman counts and values.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]


# ---- Huffman


def canonical(counts, values):
    """value -> (code, length), by length and order."""
    out, code, at = {}, 0, 0
    for n, k in enumerate(counts, 1):
        for v in values[at : at + k]:
            out[v] = (code, n)
            code += 1
        at += k
        code <<= 1
    return out


@lru_cache(64)
def lookup(counts: bytes, values: bytes) -> np.ndarray:
    """For the next 16 bits: value << 8 | length of the code, or 0 where there is none."""
    spans, held = [], []
    for v, (_, n) in canonical(counts, values).items():
        spans.append(1 << (16 - n))
        held.append(v << 8 | n)
    table = np.zeros(1 << 16, np.int32)
    full = np.repeat(np.array(held, np.int32), spans)
    table[: len(full)] = full[: len(table)]
    return table


def windows(data: np.ndarray, first: int, n: int) -> np.ndarray:
    """The 16 bits from each bit on, for n bytes of data from `first`; past the end come ones."""
    d = np.full(n + 2, 255, np.int32)
    part = data[first : first + n + 2]
    d[: len(part)] = part
    three = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    return (three[:, None] >> (8 - np.arange(8)) & 0xFFFF).ravel()


class Reader:
    """The bits of one restart interval one after another, for refinement scans."""

    def __init__(self, data: np.ndarray):
        self.data = data.tobytes() + b"\xff" * 12
        self.at = 0

    def peek(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "big") >> (16 - (self.at & 7))) & 0xFFFF if i + 4 <= len(self.data) else 0xFFFF

    def bits(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek() >> (16 - n)
        self.at += n
        return v

    def symbol(self, table: np.ndarray) -> int:
        got = int(table[self.peek()])
        if not got:
            raise ValueError("bad Huffman code")
        self.at += got & 255
        return got >> 8


# ---- parsing


class Component:
    def __init__(self, ident, h, v, table):
        self.ident, self.h, self.v, self.table = ident, h, v, table


class Image:
    def __init__(self):
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[tuple[int, int], np.ndarray] = {}
        self.parts: list[Component] = []
        self.restart = 0
        self.scans: list = []
        self.progressive = False


def parse(data: bytes, header_only: bool = False) -> Image:
    """The segments of a file; a broken one is a ValueError."""
    try:
        return _parse(data, header_only)
    except (struct.error, IndexError, StopIteration) as e:
        raise ValueError(f"broken JPEG: {e!r}") from None


def segments(data: bytes):
    """(mark, body, pieces) of each segment with a body; pieces: the coded data after a scan's header, cut at
    its restart markers, else None."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xD9:
            break
        if mark in (0x00, 0x01, 0xFF) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark != 0xDA:
            yield mark, body, None
            continue
        end, pieces, start = at, [], at
        while end + 1 < len(data):
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            m = data[end + 1]
            if m == 0:
                end += 2
            elif 0xD0 <= m <= 0xD7:
                pieces.append(data[start:end])
                end += 2
                start = end
            elif m == 0xFF:
                end += 1
            else:
                break
        pieces.append(data[start:end])
        yield mark, body, pieces
        at = end


def _parse(data: bytes, header_only: bool) -> Image:
    im = Image()
    for mark, seg, pieces in segments(data):
        if mark == 0xDB:
            i = 0
            while i < len(seg):
                wide, k = seg[i] >> 4, seg[i] & 15
                n = 128 if wide else 64
                im.quant[k] = np.frombuffer(seg[i + 1 : i + 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                i += 1 + n
        elif mark in (0xC0, 0xC1, 0xC2):
            im.progressive = mark == 0xC2
            _, im.height, im.width, n = struct.unpack_from(">BHHB", seg)
            im.parts = [Component(seg[6 + 3 * i], seg[7 + 3 * i] >> 4, seg[7 + 3 * i] & 15, seg[8 + 3 * i]) for i in range(n)]
            if n not in (1, 3):
                raise ValueError(f"unsupported JPEG with {n} components")
            if header_only:
                return im
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            raise ValueError("unsupported JPEG process")
        elif mark == 0xC4:
            i = 0
            while i < len(seg):
                counts = bytes(seg[i + 1 : i + 17])
                n = sum(counts)
                im.huff[seg[i] >> 4, seg[i] & 15] = lookup(counts, bytes(seg[i + 17 : i + 17 + n]))
                i += 17 + n
        elif mark == 0xDD:
            im.restart = struct.unpack(">H", seg)[0]
        elif mark == 0xDA:
            n = seg[0]
            which = [(next(c for c in im.parts if c.ident == seg[1 + 2 * i]), seg[2 + 2 * i] >> 4, seg[2 + 2 * i] & 15) for i in range(n)]
            first, last, bits = seg[1 + 2 * n : 4 + 2 * n]
            im.scans.append((which, first, last, bits >> 4, bits & 15, dict(im.huff), im.restart, pieces))
    if not im.parts or not im.scans:
        raise ValueError("JPEG without a frame or a scan")
    return im


def coefficients(im: Image) -> None:
    """Fills every component's blocks (rows, columns, 64 in zig-zag order) from all scans."""
    try:
        _coefficients(im)
    except IndexError:
        raise ValueError("JPEG data ends early") from None
    if any(c.table not in im.quant for c in im.parts):
        raise ValueError("JPEG without a quantisation table")


def measure(im: Image) -> tuple[int, int]:
    """(columns, rows) of units of an interleaved scan; sets each component's blocks across and down."""
    im.hmax, im.vmax = max(c.h for c in im.parts), max(c.v for c in im.parts)
    for c in im.parts:
        c.across, c.down = -(-(-(-im.width * c.h // im.hmax)) // 8), -(-(-(-im.height * c.v // im.vmax)) // 8)
    return -(-im.width // (8 * im.hmax)), -(-im.height // (8 * im.vmax))


def _coefficients(im: Image) -> None:
    mx, my = measure(im)
    for c in im.parts:
        c.blocks = np.zeros((my * c.v, mx * c.h, 64), np.int32)
    for which, first, last, high, low, huff, restart, pieces in im.scans:
        single = len(which) == 1
        units = which[0][0].across * which[0][0].down if single else mx * my
        step = restart or units
        for piece, at in zip(pieces, range(0, units, step)):
            # parts of this interval: (component, DC table, AC table, rows, columns) of its blocks in order
            n = np.arange(at, min(at + step, units))
            parts = []
            for c, dc, ac in which:
                if single:
                    y, x = n // c.across, n % c.across
                else:
                    i = np.arange(c.h * c.v)
                    y, x = ((n // mx * c.v)[:, None] + i // c.h).ravel(), ((n % mx * c.h)[:, None] + i % c.h).ravel()
                wanted = ([(0, dc)] if first == 0 and high == 0 else []) + ([(1, ac)] if last and (first or not im.progressive) else [])
                if any(t not in huff for t in wanted):
                    raise ValueError("JPEG scan without its Huffman table")
                parts.append((c, huff.get((0, dc)), huff.get((1, ac)), y, x))
            data = np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)
            order = [i for i, (c, _, _) in enumerate(which) for _ in range(1 if single else c.h * c.v)]
            if not im.progressive:
                _tokens(data, parts, order, len(n), True, 1, 63, 0)
            elif first == 0 and high == 0:
                _tokens(data, parts, order, len(n), True, 1, 0, low)
            elif first == 0:
                _refine_dc(data, parts, order, len(n), low)
            elif high == 0:
                _tokens(data, parts, order, len(n), False, first, last, low)
            else:
                c, _, table, y, x = parts[0]
                r, run = Reader(data), 0
                for i, j in zip(y.tolist(), x.tolist()):
                    block = c.blocks[i, j].tolist()
                    run = _refine(r, block, first, last, 1 << low, table, run)
                    c.blocks[i, j] = block


#: Bytes whose bits are looked up at a time, bits that one block may take at most, and bytes of ones
#: after the end of the data.
CHUNK, BLOCK_BITS, SPARE = 16384, 2048, 64
#: Added to a place in a block by a token that ends it.
END = 100


def _steps(table: np.ndarray, win: np.ndarray, dc: bool) -> list[int]:
    """For a token at each bit: its bits, times 128, plus how far it moves on in the block."""
    got = table[win]
    length, s = got & 255, got >> 8
    if dc:
        return (length + np.minimum(s, 16)).tolist()
    size, run = s & 15, s >> 4
    # a token without a size ends a block, and may have bits that count further blocks
    move = np.where(size > 0, run + 1, np.where(run == 15, 16, END))
    more = np.where(size > 0, size, np.where(run == 15, 0, run))
    move[length == 0] = END
    return ((length + more) * 128 + move).tolist()


def _values(win: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed numbers of `size` bits at places; a leading 0 means negative."""
    v = win[at] >> (16 - size)
    return np.where((size > 0) & (v >> np.maximum(size - 1, 0) == 0), v - (1 << size) + 1, v)


def _tokens(data: np.ndarray, parts: list, order: list[int], units: int, dc: bool, first: int, last: int, low: int) -> None:
    """Decodes one interval: only the walk from token to token is a loop; what tokens mean at each bit
    of a chunk, and the values of those met, are found for all at once."""
    margin = len(order) * BLOCK_BITS
    size = max(CHUNK, margin // 2)
    p = done = base = 0
    limit, win = -1, np.empty(0, np.int32)
    diffs: list[list[np.ndarray]] = [[] for _ in parts]
    filled = [0] * len(parts)
    met: list[tuple[list[int], list[int], list[int]]] = []  # places of DC tokens, of AC tokens, tokens of each block
    steps: list = []

    def settle() -> None:
        for i, (c, dct, act, y, x) in enumerate(parts):
            dcs, acs, counts = met[i]
            if dcs:
                at = np.array(dcs) - base
                got = dct[win[at]]
                if (got == 0).any() or (got >> 8 > 16).any():
                    raise ValueError("bad Huffman code")
                diffs[i].append(_values(win, at + (got & 255), got >> 8))
            if acs:
                at, per = np.array(acs) - base, np.array(counts)
                got = act[win[at]]
                if (got == 0).any():
                    raise ValueError("bad Huffman code")
                s = got >> 8
                size, run = s & 15, s >> 4
                move = np.where(size > 0, run + 1, np.where(run == 15, 16, 0))
                upto = np.cumsum(move)
                begin = np.cumsum(per) - per
                k = first - 1 + upto - np.repeat((upto - move)[begin[per > 0]], per[per > 0])
                block = np.repeat(np.arange(len(per)) + filled[i], per)
                real = size > 0
                if (k[real] > 63).any():
                    raise ValueError("coefficients run over")
                b = block[real]
                c.blocks[y[b], x[b], k[real]] = _values(win, at[real] + (got[real] & 255), size[real]) << low
            filled[i] += len(counts)

    while done < units:
        if p >= limit:
            if met:
                settle()
            base = p & ~7
            left = len(data) - (base >> 3) + SPARE
            win = windows(data, base >> 3, min(size, left))
            limit = base + size * 8 - margin if left > size else 1 << 62
            met = [([], [], []) for _ in parts]
            steps = [(_steps(d, win, True) if dc else None, _steps(a, win, False) if last else None) for _, d, a, _, _ in parts]
        skip = 0
        for i in order:
            dcs, acs, counts = met[i]
            if dc:
                dcs.append(p)
                p += steps[i][0][p - base]
            n = len(acs)
            k, walk = first, steps[i][1]
            while k <= last:
                acs.append(p)
                e = walk[p - base]
                p += e >> 7
                k += e & 127
            counts.append(len(acs) - n)
            if not dc and k >= END:
                # the run of further blocks that this end of block stands for
                at = acs[-1] - base
                got = int(parts[i][2][win[at]])
                bits = got >> 12
                skip = (1 << bits) - 1 + (int(win[at + (got & 255)]) >> (16 - bits))
                counts.extend([0] * min(skip, units - done - 1))
        done += 1 + skip
    if met:
        settle()
    if dc:
        for (c, _, _, y, x), d in zip(parts, diffs):
            c.blocks[y, x, 0] = np.cumsum(np.concatenate(d)) << low


def _refine_dc(data: np.ndarray, parts: list, order: list[int], units: int, low: int) -> None:
    """One more bit for the DC of each block: the bits in order of blocks."""
    n = units * len(order)
    bits = np.ones(n, np.uint8)
    got = np.unpackbits(data[: -(-n // 8)])[:n]
    bits[: len(got)] = got
    bits = bits.reshape(units, len(order))
    for i, (c, _, _, y, x) in enumerate(parts):
        mine = bits[:, [j for j, o in enumerate(order) if o == i]].ravel()
        c.blocks[y, x, 0] |= mine.astype(np.int32) << low


def _refine(r: Reader, b, first, last, bit, table, run) -> int:
    """One more bit for coefficients that are not 0, new ones in between."""

    def correct(k):
        if r.bits(1) and not abs(b[k]) & bit:
            b[k] += bit if b[k] > 0 else -bit

    k = first
    if not run:
        while k <= last:
            s = r.symbol(table)
            n, new = s >> 4, 0
            if s & 15:
                new = bit if r.bits(1) else -bit
            elif n < 15:
                run = (1 << n) + r.bits(n)
                break
            while k <= last:
                if b[k]:
                    correct(k)
                elif n == 0:
                    if new:
                        b[k] = new
                    k += 1
                    break
                else:
                    n -= 1
                k += 1
    if run:
        while k <= last:
            if b[k]:
                correct(k)
            k += 1
        run -= 1
    return run


def planes(im: Image, half: bool = False) -> list[np.ndarray]:
    """Samples of each component: dequantised blocks through the inverse transform, all at once."""
    out = []
    for c in im.parts:
        z = c.blocks.astype(np.float64)
        rows, cols = z.shape[:2]
        block = np.zeros_like(z)
        block[..., ZIGZAG] = z * im.quant[c.table]
        block = block.reshape(rows, cols, 8, 8)
        if half:
            n, basis = 4, C4
            block = block[..., :4, :4] / 2
        else:
            n, basis = 8, C8
        px = np.einsum("ki,rckl,lj->rcij", basis, block, basis, optimize=True)
        px = np.clip(np.trunc(px + 128.5), 0, 255).astype(np.uint8)
        out.append(px.transpose(0, 2, 1, 3).reshape(rows * n, cols * n))
    return out


def to_frame(im: Image, parts: list[np.ndarray], width: int, height: int) -> np.ndarray:
    """Nearest chroma, then YCbCr to RGB in 8-bit fixed point."""
    if len(parts) == 1:
        return parts[0][:height, :width, None]
    y, cb, cr = (p[(np.arange(height) * c.v // im.vmax)[:, None], (np.arange(width) * c.h // im.hmax)[None, :]].astype(np.int32) for p, c in zip(parts, im.parts))
    cb, cr = cb - 128, cr - 128
    return np.clip(np.stack([y + (359 * cr >> 8), y - ((88 * cb >> 8) + (183 * cr >> 8)), y + (454 * cb >> 8)], 2), 0, 255).astype(np.uint8)


def read_jpeg(data: bytes, target=None, shrink_on_load: bool = False) -> np.ndarray:
    """target: (width, height) that is wanted. With shrink_on_load a progressive file is decoded at
    half size where that is still as large as the target; the caller resizes from there."""
    im = parse(data)
    coefficients(im)
    w, h = im.width, im.height
    half = shrink_on_load and im.progressive and target is not None and target[0] <= -(-w // 2) and target[1] <= -(-h // 2)
    if half:
        w, h = -(-w // 2), -(-h // 2)
    return to_frame(im, planes(im, half), w, h)


# ---- encoding


def scaled(base, quality: int) -> np.ndarray:
    q = min(100, max(1, quality))
    s = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * s + 50) // 100, 1, 255)


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Numbers of so many bits one after another, filled up with ones, with a zero byte after each 255."""
    each = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bits = (values[each] >> (sizes[each] - 1 - place) & 1).astype(np.uint8)
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def optimal(counts: np.ndarray):
    """(counts by length, values) of a Huffman code of at most 16 bits without the code of all ones."""
    import heapq

    used = np.flatnonzero(counts).tolist()
    weights = {v: int(counts[v]) for v in used} | {256: 1}
    heap = [(w, i, [v]) for i, (v, w) in enumerate(sorted(weights.items()))]
    heapq.heapify(heap)
    depth, tick = dict.fromkeys(weights, 0), len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for v in a[2] + b[2]:
            depth[v] += 1
        heapq.heappush(heap, (a[0] + b[0], tick, a[2] + b[2]))
        tick += 1
    n = [0] * 300
    for d in depth.values():
        n[d] += 1
    for d in range(299, 16, -1):  # move pairs of too long codes up
        while n[d] > 0:
            j = d - 2
            while not n[j]:
                j -= 1
            n[d] -= 2
            n[d - 1] += 1
            n[j + 1] += 2
            n[j] -= 1
    top = max(d for d in range(17) if n[d])
    n[top] -= 1  # the reserved code
    values = sorted(used, key=lambda v: (depth[v], v))
    return n[1:17], values


def bit_size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1]


def low_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v >= 0, v, v + (1 << size) - 1)


def dc_tokens(blocks: np.ndarray):
    """(block, order in it, symbol, value, bits) of the DC differences."""
    d = np.diff(blocks[:, 0], prepend=0)
    size = bit_size(d)
    n = np.arange(len(d))
    return n, np.zeros_like(n), size, low_bits(d, size), size


def ac_tokens(blocks: np.ndarray, first: int, last: int):
    """The same of coefficients first to last: runs of zeros, runs of 16, ends of blocks."""
    part = blocks[:, first : last + 1]
    b, k = np.nonzero(part)
    v = part[b, k]
    before = np.full(len(b), -1)
    if len(b):
        before[1:] = np.where(b[1:] == b[:-1], k[:-1], -1)
    run, size = k - before - 1, bit_size(v)
    long = np.repeat(np.arange(len(b)), run // 16)
    ended = np.flatnonzero(part[:, -1] == 0)
    zero = np.zeros(len(long) + len(ended), np.int64)
    return (
        np.concatenate([b, b[long], ended]),
        np.concatenate([2 * k + 2, 2 * k[long] + 1, np.full(len(ended), 200)]),
        np.concatenate([(run % 16) << 4 | size, np.full(len(long), 0xF0), np.zeros(len(ended), np.int64)]),
        np.concatenate([low_bits(v, size), zero]),
        np.concatenate([size, zero]),
    )


#: Scans as (components, first, last coefficient). Progressive: DC of all, then luma 1-5 and 6-63, then each chroma.
SCANS = {True: [([0, 1, 2], 0, 0), ([0], 1, 5), ([0], 6, 63), ([1], 1, 63), ([2], 1, 63)], False: [([0, 1, 2], 0, 63)]}


def segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def restarted(pieces) -> bytes:
    """Intervals with the restart markers between them."""
    return b"".join(p if i == 0 else bytes([0xFF, 0xD0 + (i - 1) % 8]) + p for i, p in enumerate(pieces))


def quantised(f: np.ndarray, quality: int) -> list[np.ndarray]:
    """The blocks of the three components, row by row, in zig-zag order."""
    if f.shape[2] != 3:
        raise ValueError("JPEG needs 3 channels")
    h, w = f.shape[:2]
    r, g, b = (f[..., i].astype(np.int32) for i in range(3))
    ycc = [(77 * r + 150 * g + 29 * b) >> 8, ((-43 * r - 85 * g + 128 * b) >> 8) + 128, ((128 * r - 107 * g - 21 * b) >> 8) + 128]
    rows, cols = -(-h // 8), -(-w // 8)
    out = []
    for p, base in zip(ycc, (LUMA, CHROMA, CHROMA)):
        p = np.pad(np.clip(p, 0, 255), ((0, rows * 8 - h), (0, cols * 8 - w)), mode="edge") - 128.0
        block = np.einsum("ki,ricj,lj->rckl", C8, p.reshape(rows, 8, cols, 8), C8, optimize=True).reshape(rows * cols, 64)
        out.append(np.floor(block / scaled(base, quality) + 0.5).astype(np.int64)[:, ZIGZAG])
    return out


def scan_tokens(comps: list[np.ndarray], which: list[int], first: int, last: int):
    """(table, symbol, value, size) of one interval's tokens in their order. A token's place: its block, the
    component there, the order in it."""
    found = []
    for j, i in enumerate(which):
        kinds = [(0, dc_tokens(comps[i]))] if first == 0 else []
        kinds += [(1, ac_tokens(comps[i], max(1, first), last))] if last else []
        for kind, (block, place, *token) in kinds:
            found.append([(block * len(which) + j) * 256 + place, np.full(len(block), kind << 4 | min(i, 1)), *token])
    place, *token = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(place, kind="stable")
    return [t[order] for t in token]


def symbol_counts(tokens) -> np.ndarray:
    """How often each symbol of each table occurs, at table * 256 + symbol."""
    return np.bincount(tokens[0] * 256 + tokens[1], minlength=0x12 * 256)


def opening(width: int, height: int, quality: int, progressive: bool, restart: int = 0) -> bytes:
    """All up to the first scan; restart: units of an interval."""
    if restart > 0xFFFF:
        raise ValueError("a restart interval is too long")
    tables = b"".join(segment(0xDB, bytes([i]) + bytes(scaled(base, quality)[ZIGZAG].astype(np.uint8).tolist())) for i, base in enumerate((LUMA, CHROMA)))
    parts = b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(3))
    frame = segment(0xC2 if progressive else 0xC0, struct.pack(">BHHB", 8, height, width, 3) + parts)
    return b"\xff\xd8" + tables + frame + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")


def scan_head(which: list[int], first: int, last: int, seen: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The Huffman tables made for the counts of all of a scan's tokens and the scan's header, and (code, length)
    at table * 256 + symbol."""
    out, codes = b"", np.zeros((len(seen), 2), np.int64)
    for t in np.unique(np.flatnonzero(seen) // 256).tolist():
        counts, values = optimal(seen[t * 256 : t * 256 + 256])
        out += segment(0xC4, bytes([t]) + bytes(counts) + bytes(values))
        for v, c in canonical(counts, values).items():
            codes[t * 256 + v] = c
    return out + segment(0xDA, bytes([len(which)]) + b"".join(bytes([i + 1, min(i, 1) * 0x11]) for i in which) + bytes([first, last, 0])), codes


def coded(tokens, codes: np.ndarray) -> bytes:
    """One interval."""
    table, symbol, value, size = tokens
    code, length = codes[table * 256 + symbol].T
    return pack_bits(np.column_stack([code, value]).ravel(), np.column_stack([length, size]).ravel())


def write_jpeg(f: np.ndarray, quality: int = 85, progressive: bool = True, restart_rows: int = 0) -> bytes:
    """4:4:4, with tables of the standard scaled by quality and Huffman codes made for the image.
    Baseline: one scan. restart_rows: rows of blocks after which coding starts anew, so that files can be read by
    intervals; 0: never."""
    comps = quantised(f, quality)
    n, step = len(comps[0]), restart_rows * -(-f.shape[1] // 8)
    out = opening(f.shape[1], f.shape[0], quality, progressive, step)
    for scan in SCANS[progressive]:
        parts = [scan_tokens([c[at : at + (step or n)] for c in comps], *scan) for at in range(0, n, step or n)]
        head, codes = scan_head(*scan, sum(map(symbol_counts, parts)))
        out += head + restarted(coded(p, codes) for p in parts)
    return out + b"\xff\xd9"
