"""Progressive JPEG as a lossless store of bytes, and RGB tensors from it.

Byte p of a payload becomes the quantised coefficient 256 + p. Blocks of 64 coefficients (zigzag order) fill the Y plane of a
4:2:0 image from the left and top, then Cb, then Cr; what is left over holds byte 0. The image is written by spectral selection
and successive approximation: for each component a first DC scan and a first AC scan (1..63) carry the coefficients without
their eight low bits, and eight refinement scans for DC and for AC add one bit each. After the first scans every
coefficient is known to be nonzero, so that AC refinement is an end-of-band run over all blocks followed by plain correction bits,
which are packed and unpacked as arrays. Any decoder of progressive JPEG reads the files.

The reader accumulates the scans of a file into arrays of coefficients. It takes any Huffman-coded scan of a single component without restart
markers; streams whose bits are regular take a path over arrays, others go bit by bit. Tensors come from the inverse transform in
numpy, chroma upsampled by repetition, and the JFIF colour conversion.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np

#: Fixed values of the format: zigzag order of the 64 coefficients.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
BASE, LOW_BITS = 256, 8
#: Symbols of our Huffman tables. DC: categories 0 and 1. AC: one coefficient of category 1, end-of-band runs of 2**0 .. 2**14 blocks.
DC_SYMBOLS = {0: "0", 1: "10"}
AC_SYMBOLS = {0x01: "0"} | {n << 4: "1" + format(n, "04b") for n in range(15)}
LONGEST_RUN = (1 << 15) - 1


def _table(kind: int, symbols: dict[int, str]) -> bytes:
    by_length = sorted(symbols.items(), key=lambda s: (len(s[1]), s[1]))
    counts = [sum(len(c) == n for _, c in by_length) for n in range(1, 17)]
    return bytes([kind, *counts, *(s for s, _ in by_length)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(coded: bytes) -> bytes:
    """Entropy-coded bytes with a zero byte after each 0xFF."""
    return coded.replace(b"\xff", b"\xff\x00")


def _bits(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) - 48


HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0]) + bytes([1] * 64))
TABLES = _segment(0xC4, _table(0x00, DC_SYMBOLS) + _table(0x10, AC_SYMBOLS))
#: Sampling of Y, Cb, Cr.
SAMPLING = ((2, 2), (1, 1), (1, 1))


def layout(blocks: int) -> tuple[int, int]:
    """Columns and rows of units of 16 x 16 pixels (four Y, one Cb and one Cr block) that hold so many blocks."""
    units = max(1, -(-blocks // 6))
    wide = int(np.ceil(np.sqrt(units)))
    return wide, -(-units // wide)


@functools.cache
def _scan(component: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([1, component, 0x00, first, last, high << 4 | low]))


def _ones_after(coded: bytearray, bits: int) -> bytes:
    """The last byte filled up with ones."""
    if spare := -bits % 8:
        coded[-1] |= (1 << spare) - 1
    return bytes(coded)


def _first_dc(n: int) -> bytes:
    """Coefficients without low bits are all 1: a difference of 1 (101), then n - 1 of 0."""
    coded = bytearray(-(-(n + 2) // 8))
    coded[0] = 0xA0
    return _ones_after(coded, n + 2)


def _first_ac(n: int) -> bytes:
    """63 n times "category 1, positive" (01)."""
    bits = 126 * n
    coded = bytearray(b"\x55" * -(-bits // 8))
    return _ones_after(coded, bits)


def _run_code(run: int) -> np.ndarray:
    size = run.bit_length() - 1
    return _bits(AC_SYMBOLS[size << 4] + (format(run - (1 << size), f"0{size}b") if size else ""))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that holds a payload whose length is a multiple of 64."""
    wide, high = layout(len(payload) // 64)
    parts = [HEAD, _segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(SAMPLING))), TABLES]
    units = wide * high
    data = np.zeros((6 * units, 64), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    at = 0
    for component, (h, v) in enumerate(SAMPLING, 1):
        n = units * h * v
        blocks = data[at : at + n]
        at += n
        parts += [_scan(component, 0, 0, 0, LOW_BITS), _stuffed(_first_dc(n)), _scan(component, 1, 63, 0, LOW_BITS), _stuffed(_first_ac(n))]
        # A row of bits for each plane, the highest first; all eight are packed together.
        planes = np.unpackbits(blocks.reshape(-1, 1), axis=1).T.reshape(LOW_BITS, n, 64)
        dc = np.packbits(np.concatenate([planes[:, :, 0], np.ones((LOW_BITS, -n % 8), np.uint8)], axis=1), axis=1)
        pieces = []
        for start in range(0, n, LONGEST_RUN):
            run = min(LONGEST_RUN, n - start)
            pieces += [np.broadcast_to(code := _run_code(run), (LOW_BITS, len(code))), planes[:, start : start + run, 1:].reshape(LOW_BITS, -1)]
        pieces.append(np.ones((LOW_BITS, -sum(x.shape[1] for x in pieces) % 8), np.uint8))
        ac = np.packbits(np.concatenate(pieces, axis=1), axis=1)
        for i, low in enumerate(range(LOW_BITS - 1, -1, -1)):
            parts += [_scan(component, 0, 0, low + 1, low), _stuffed(dc[i].tobytes()), _scan(component, 1, 63, low + 1, low), _stuffed(ac[i].tobytes())]
    return b"".join([*parts, b"\xff\xd9"])


class _Reader:
    """Bits of one scan, one after another: as bytes, and as an array of bits."""

    def __init__(self, coded: bytes, bits: np.ndarray):
        self.coded, self.bits, self.at = coded, bits, 0

    def _ahead(self, n: int) -> int:
        """The next n <= 32 bits, ones past the end."""
        start, shift = self.at >> 3, self.at & 7
        return int.from_bytes(self.coded[start : start + 5].ljust(5, b"\xff"), "big") >> (40 - shift - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self._ahead(n) if n else 0
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        ahead = self._ahead(16)
        for length in range(1, 17):
            if (found := codes.get((length, ahead >> (16 - length)))) is not None:
                self.at += length
                return found
        raise ValueError("bad Huffman code")


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    found, value, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found[length, value] = symbols[at]
            value, at = value + 1, at + 1
        value <<= 1
    return found


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _dc_first(c: np.ndarray, r: _Reader, codes: dict, low: int) -> None:
    ones = codes.get((1, 0)) == 0 and len(c) > 1
    last = 0
    for i in range(len(c)):
        if ones and i and not r.bits[r.at : r.at + len(c) - i].any():  # nothing but differences of 0
            c[i:, 0] = last << low
            return
        size = r.symbol(codes)
        last += _extend(r.take(size), size)
        c[i, 0] = last << low


def _ac_first(c: np.ndarray, r: _Reader, codes: dict, first: int, last: int, low: int) -> None:
    width = last - first + 1
    need = 2 * width * len(c)
    if codes.get((1, 0)) == 0x01 and len(r.bits) >= need:
        pairs = r.bits[:need].reshape(-1, 2)
        if not pairs[:, 0].any():  # every coefficient has category 1, with a sign bit
            c[:, first : last + 1] = ((2 * pairs[:, 1].astype(np.int32) - 1) << low).reshape(-1, width)
            return
    run = 0
    for block in c:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            rs = r.symbol(codes)
            skip, size = rs >> 4, rs & 15
            if size == 0:
                if skip < 15:
                    run = (1 << skip) - 1 + r.take(skip)
                    break
                k += 16
                continue
            k += skip
            block[k] = _extend(r.take(size), size) << low
            k += 1


def _only_runs(r: _Reader, codes: dict, blocks: int, width: int) -> np.ndarray | None:
    """Correction bits of a refinement scan that is nothing but end-of-band runs over blocks without zeros."""
    parts, done = [], 0
    while done < blocks:
        rs = r.symbol(codes)
        if rs & 15 or rs >> 4 == 15:
            return None
        run = (1 << (rs >> 4)) + r.take(rs >> 4)
        if run > blocks - done or r.at + run * width > len(r.bits):
            return None
        parts.append(r.bits[r.at : r.at + run * width])
        r.at += run * width
        done += run
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _ac_refine(c: np.ndarray, r: _Reader, codes: dict, first: int, last: int, low: int) -> None:
    """Any refinement scan, bit by bit."""
    one = 1 << low
    i = 0

    def correct(block: np.ndarray, k: int) -> None:
        if r.take(1) and not abs(int(block[k])) & one:
            block[k] += one if block[k] > 0 else -one

    while i < len(c):
        k, new = first, 0
        while k <= last:
            rs = r.symbol(codes)
            skip, size = rs >> 4, rs & 15
            if size == 0 and skip < 15:
                run = (1 << skip) + r.take(skip)
                for block in c[i : i + run]:
                    for j in range(k, last + 1):
                        if block[j]:
                            correct(block, j)
                    k = first
                i += run - 1
                break
            new = (one if r.take(1) else -one) if size else 0
            while k <= last:
                if c[i, k]:
                    correct(c[i], k)
                elif skip:
                    skip -= 1
                else:
                    break
                k += 1
            if new and k <= last:
                c[i, k] = new
            k += 1
        i += 1


class _Plane:
    """Coefficients of a component. Corrections of blocks without zeros wait until they can be added together."""

    def __init__(self, blocks: int):
        self.c = np.zeros((blocks, 64), np.int32)
        self.waiting: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        self.full: set[tuple[int, int]] = set()

    def has_no_zeros(self, band: tuple[int, int]) -> bool:
        """What is not zero stays so in refinement, so that the answer yes holds for all later scans."""
        if band not in self.full and self.c[:, band[0] : band[1] + 1].all():
            self.full.add(band)
        return band in self.full

    def settle(self) -> np.ndarray:
        for (first, last), scans in self.waiting.items():
            part = self.c[:, first : last + 1]
            if [low for low, _ in scans] == list(range(LOW_BITS - 1, -1, -1)):
                more = np.packbits(np.stack([b for _, b in scans]), axis=0).reshape(part.shape)
            else:
                more = sum(b.astype(np.int32) << low for low, b in scans).reshape(part.shape)
            if first == 0 or (part > 0).all():  # bits of DC coefficients are those of two's complement
                part += more
            else:
                part += np.sign(part) * more.astype(np.int32)
        self.waiting.clear()
        return self.c

    def correct(self, first: int, last: int, low: int, bits: np.ndarray) -> None:
        self.waiting.setdefault((first, last), []).append((low, bits))


#: The end of entropy-coded bytes: a marker.
MARKER = re.compile(rb"\xff[^\x00]")


def decode(data: bytes) -> tuple[int, int, list[np.ndarray], list[tuple[int, int]]]:
    """Height, width, for each component its coefficients (a row of 64 in zigzag order for each block) and its sampling."""
    at, codes, planes, sampling = 2, {}, [], []
    height = width = 0
    scans: list[tuple[bytes, dict, bytes]] = []
    while at < len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big") if data[at + 1] != 0xD9 else 0
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xD9:
            break
        if marker == 0xC4:
            i, codes = 0, dict(codes)
            while i < len(body):
                counts = body[i + 1 : i + 17]
                codes[body[i]] = _codes(counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif marker == 0xC2:
            height, width, n = struct.unpack(">HHB", body[1:6])
            sampling = [(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(n)]
            most = [max(s[j] for s in sampling) for j in (0, 1)]
            units = -(-width // (8 * most[0])) * -(-height // (8 * most[1]))
            planes = [_Plane(units * h * v) for h, v in sampling]
        elif marker == 0xDA:
            end = MARKER.search(data, at).start()
            scans.append((body, codes, data[at:end].replace(b"\xff\x00", b"\xff")))
            at = end
    bits = np.unpackbits(np.frombuffer(b"".join([coded for _, _, coded in scans]), np.uint8))
    start = 0
    for body, codes, coded in scans:
        component, tables, first, last, levels = body[1], body[2], body[3], body[4], body[5]
        plane, high, low = planes[component - 1], levels >> 4, levels & 15
        r = _Reader(coded, bits[start : start + 8 * len(coded)])
        start += 8 * len(coded)
        ac = codes.get(0x10 | tables & 15, {})
        if first == 0 and high:
            plane.correct(0, 0, low, r.bits[: len(plane.c)])
        elif first == 0:
            _dc_first(plane.c, r, codes[tables >> 4], low)
        elif not high:
            _ac_first(plane.c, r, ac, first, last, low)
        else:
            found = _only_runs(r, ac, len(plane.c), last - first + 1) if plane.has_no_zeros((first, last)) else None
            if found is not None:
                plane.correct(first, last, low, found)
            else:
                r.at = 0
                _ac_refine(plane.settle(), r, ac, first, last, low)
    return height, width, [p.settle() for p in planes], sampling


def payload_of(planes: list[np.ndarray], length: int) -> bytes:
    """The first bytes of what ``encode`` stored."""
    data = np.concatenate([(p - BASE).astype(np.uint8) for p in planes])
    return data.reshape(-1)[:length].tobytes()


_K = np.arange(8)
#: One-dimensional inverse transform: samples by coefficients.
INVERSE = (np.where(_K == 0, np.sqrt(0.125), 0.5)[None, :] * np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16)).astype(np.float32)
#: Sample by zigzag coefficient of a block.
INVERSE_2D = np.kron(INVERSE, INVERSE)[:, ZIGZAG].T.copy()


def rgb(height: int, width: int, planes: list[np.ndarray], sampling: list[tuple[int, int]]) -> np.ndarray:
    """Tensor (height, width, 3) of bytes, laid out by channel; all quantisers are 1."""
    most = [max(s[j] for s in sampling) for j in (0, 1)]
    across, down = width // (8 * most[0]), height // (8 * most[1])
    full = []
    for c, (h, v) in zip(planes, sampling, strict=True):
        samples = (c.astype(np.float32) @ INVERSE_2D).reshape(down * v, across * h, 8, 8).transpose(0, 2, 1, 3).reshape(down * v * 8, across * h * 8)
        if (most[0], most[1]) != (h, v):
            samples = samples.repeat(most[1] // v, axis=0).repeat(most[0] // h, axis=1)
        full.append(samples)
    y, cb, cr = full[0] + 128, full[1], full[2]
    out = np.empty((3, *y.shape), np.float32)
    np.add(y, 1.402 * cr, out=out[0])
    np.subtract(y, 0.344136 * cb + 0.714136 * cr, out=out[1])
    np.add(y, 1.772 * cb, out=out[2])
    np.rint(out, out=out)
    return np.clip(out, 0, 255, out=out).astype(np.uint8).transpose(1, 2, 0)
