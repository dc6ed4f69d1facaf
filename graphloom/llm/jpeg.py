"""Baseline and lossless JPEG frames of any writer: the samples of the first component.

Bits are read one symbol at a time, as Huffman codes ask for; frames that the media
column writes itself are read by arrays elsewhere.
"""

from __future__ import annotations

import struct

import numpy as np

# The zigzag order of a block, and the Huffman tables that motion JPEG frames may leave out.
ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))]
DC_LUMINANCE = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMINANCE = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMINANCE = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], list(bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a"
    "535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7"
    "c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")))
AC_CHROMINANCE = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], list(bytes.fromhex(
    "0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a43444546474849"
    "4a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5"
    "c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa".replace(" ", ""))))

_cosines = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def _codes(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            # a reader may look past the end by some bits
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
            if self.at > len(self.data) + 8:
                raise ValueError("data end early")
        self.n -= n
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        if size == 16:  # of lossless frames: no bits follow
            return 32768
        x = self.take(size)
        return x if x >> (size - 1) else x - (1 << size) + 1


def _parts(scan: bytes) -> list[_Bits]:
    """The data between restart markers, unstuffed."""
    parts, at, start = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        mark = scan[at + 1]
        if mark == 0 or mark == 0xFF:
            at += 2 if mark == 0 else 1
        elif 0xD0 <= mark <= 0xD7:
            parts.append(scan[start:at])
            at = start = at + 2
        else:
            break
    parts.append(scan[start : at if at >= 0 else len(scan)])
    return [_Bits(p.replace(b"\xff\x00", b"\xff")) for p in parts]


def first_component(data: bytes) -> np.ndarray:
    """(row, column) of unsigned bytes. Progressive, arithmetic and 12-bit frames raise ValueError."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, every, frame = 2, {}, 0, None
    tables = {(0, 0): _codes(*DC_LUMINANCE), (0, 1): _codes(*DC_CHROMINANCE), (1, 0): _codes(*AC_LUMINANCE), (1, 1): _codes(*AC_CHROMINANCE)}
    while True:
        mark, size = struct.unpack_from(">xBH", data, at)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                wide, ident = divmod(body[0], 16)
                n = 64 * (wide + 1)
                quant[ident] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(float)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[divmod(body[0], 16)] = _codes(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif mark == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif mark in (0xC0, 0xC1, 0xC3):
            bits, rows, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not rows or not width:
                raise ValueError("not of 8 bits")
            frame = mark, rows, width, [(body[6 + 3 * k], *divmod(body[7 + 3 * k], 16), body[8 + 3 * k]) for k in range(n)]
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("another kind of frame")
        elif mark == 0xDA:
            break
    if frame is None:
        raise ValueError("no frame")
    n = body[0]
    chosen = {body[1 + 2 * k]: divmod(body[2 + 2 * k], 16) for k in range(n)}
    kind, rows, width, components = frame
    scanned = [c for c in components if c[0] in chosen]
    parts = _parts(data[at:])
    if kind == 0xC3:
        return _lossless(parts, rows, width, scanned, chosen, tables, body[1 + 2 * n], body[3 + 2 * n] % 16, every)
    return _baseline(parts, rows, width, scanned, chosen, tables, quant, every)


def _baseline(parts, rows, width, components, chosen, tables, quant, every) -> np.ndarray:  # noqa: ANN001
    most_h, most_v = max(c[1] for c in components), max(c[2] for c in components)
    one = len(components) == 1
    first = components[0]
    if one:
        across, down, shape = -(-width // 8), -(-rows // 8), {first[0]: (1, 1)}
    else:
        across, down, shape = -(-width // (8 * most_h)), -(-rows // (8 * most_v)), {c[0]: (c[1], c[2]) for c in components}
    h, v = shape[first[0]]
    out = np.zeros((down * v, across * h, 64))
    last, k, left = dict.fromkeys(chosen, 0), 0, every
    for y in range(down):
        for x in range(across):
            if every and not left:
                k, left, last = k + 1, every, dict.fromkeys(chosen, 0)
            left -= 1
            bits = parts[k]
            for ident, *_ in components:
                dc, ac = (tables[cls, table] for cls, table in enumerate(chosen[ident]))
                for by in range(shape[ident][1]):
                    for bx in range(shape[ident][0]):
                        block = np.zeros(64)
                        last[ident] += bits.signed(bits.symbol(dc))
                        block[0], at = last[ident], 1
                        while at < 64:
                            run, size = divmod(bits.symbol(ac), 16)
                            if not size:
                                if run < 15:
                                    break
                                at += 16
                                continue
                            at += run
                            if at > 63:
                                raise ValueError("block too long")
                            block[at] = bits.signed(size)
                            at += 1
                        if ident == first[0]:
                            out[y * v + by, x * h + bx] = block
    coefficients = np.zeros_like(out)
    coefficients[:, :, ZIGZAG] = out * quant[first[3]]
    blocks = _cosines.T @ coefficients.reshape(*out.shape[:2], 8, 8) @ _cosines
    plane = blocks.transpose(0, 2, 1, 3).reshape(out.shape[0] * 8, out.shape[1] * 8)
    own = (-(-rows * first[2] // most_v), -(-width * first[1] // most_h)) if not one else (rows, width)
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: own[0], : own[1]]


def _lossless(parts, rows, width, components, chosen, tables, predictor, shift, every) -> np.ndarray:  # noqa: ANN001
    """Of components that are sampled alike."""
    planes = {c[0]: np.zeros((rows, width), np.int64) for c in components}
    k, left, fresh = 0, every, True
    for y in range(rows):
        for x in range(width):
            if every and not left:
                k, left, fresh = k + 1, every, True
            left -= 1
            bits = parts[k]
            for ident, *_ in components:
                p = planes[ident]
                if fresh:
                    guess = 1 << (7 - shift)
                elif y == 0 or (every and k and y * width + x < k * every + width):
                    guess = p[y, x - 1] if x else p[y - 1, x]
                elif x == 0:
                    guess = p[y - 1, x]
                else:
                    a, b, c = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
                    guess = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor]
                p[y, x] = (guess + bits.signed(bits.symbol(tables[0, chosen[ident][0]]))) & 0xFFFF
            fresh = False
    return (planes[components[0][0]] << shift).astype(np.uint8)
