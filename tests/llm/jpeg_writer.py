"""A small writer of progressive JPEGs with subsampled chroma, general Huffman tables, runs, and both kinds of refinement; for tests."""

from __future__ import annotations

import struct

import numpy as np

from vitrine.llm.jpeg import ZIGZAG


class Bits:
    def __init__(self) -> None:
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self) -> bytes:
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def tables() -> bytes:
    """All symbols with codes of nine bits, for DC and AC."""
    return b"".join(segment(0xC4, bytes([t, *[0] * 8, 255, *[0] * 7]) + bytes(range(255))) for t in (0x00, 0x10))


def number(out: Bits, v: int) -> None:
    n = abs(v).bit_length()
    out.put(v if v > 0 else v + (1 << n) - 1, n)


def shifted(v: int, low: int) -> int:
    return (abs(v) >> low) * (1 if v > 0 else -1)


def write(components: list[tuple[int, int, np.ndarray]], width: int, height: int, quant: np.ndarray, restart: int = 2) -> bytes:
    """components: (h, v, coefficients [rows of blocks, blocks, 64] in zigzag order)."""
    frame = struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v, _) in enumerate(components))
    out = [b"\xff\xd8", segment(0xDB, bytes([0]) + quant.astype(np.uint8).tobytes()), segment(0xC2, frame), tables()]
    most_h, most_v = max(c[0] for c in components), max(c[1] for c in components)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    out.append(segment(0xDD, struct.pack(">H", restart)))
    for high, low in ((0, 1), (1, 0)):
        pieces, bits, before = [], Bits(), [0] * len(components)
        for m in range(across * down):
            if m and m % restart == 0:
                pieces.append(bits.bytes())
                bits, before = Bits(), [0] * len(components)
            for i, (h, v, c) in enumerate(components):
                for y in range(v):
                    for x in range(h):
                        dc = int(c[m // across * v + y, m % across * h + x, 0])
                        if high:
                            bits.put(dc >> low & 1, 1)
                        else:
                            d = (dc >> low) - before[i]
                            before[i] = dc >> low
                            bits.put(abs(d).bit_length(), 9)
                            number(bits, d)
        pieces.append(bits.bytes())
        head = bytes([len(components), *(x for i in range(len(components)) for x in (i + 1, 0)), 0, 0, high << 4 | low])
        out.append(segment(0xDA, head) + b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k < len(pieces) - 1 else b"") for k, p in enumerate(pieces)))
    out.append(segment(0xDD, b"\x00\x00"))
    for i, (h, v, c) in enumerate(components):
        rows, columns = -(-height * v // (8 * most_v)), -(-width * h // (8 * most_h))
        blocks = [c[y, x] for y in range(rows) for x in range(columns)]
        for first, last in ((1, 5), (6, 63)):
            out.append(segment(0xDA, bytes([1, i + 1, 0, first, last, 0x01])) + first_scan(blocks, first, last))
        out.append(segment(0xDA, bytes([1, i + 1, 0, 1, 63, 0x10])) + refinement(blocks))
    return b"".join([*out, b"\xff\xd9"])


def first_scan(blocks: list[np.ndarray], first: int, last: int) -> bytes:
    bits, run = Bits(), 0

    def flush() -> None:
        nonlocal run
        if run:
            n = run.bit_length() - 1
            bits.put(n << 4, 9)
            bits.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = shifted(int(b[k]), 1)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                bits.put(0xF0, 9)
                zeros -= 16
            bits.put(zeros << 4 | abs(v).bit_length(), 9)
            number(bits, v)
            zeros = 0
        if zeros:
            run += 1
    flush()
    return bits.bytes()


def refinement(blocks: list[np.ndarray]) -> bytes:
    bits = Bits()
    for b in blocks:
        zeros, pending, k = 0, [], 1
        ends = max([k for k in range(1, 64) if abs(int(b[k])) == 1], default=0)
        while k <= ends:
            v = int(b[k])
            if abs(v) > 1:
                pending.append(abs(v) & 1)
            elif v == 0:
                if zeros == 15:
                    bits.put(0xF0, 9)
                    [bits.put(p, 1) for p in pending]
                    zeros, pending = -1, []
                zeros += 1
            else:
                bits.put(zeros << 4 | 1, 9)
                bits.put(v > 0, 1)
                [bits.put(p, 1) for p in pending]
                zeros, pending = 0, []
            k += 1
        if k <= 63:
            bits.put(0x00, 9)
            for v in map(int, b[k:]):
                if abs(v) > 1:
                    bits.put(abs(v) & 1, 1)
    return bits.bytes()


def random_image(rng: np.random.Generator, width: int, height: int, factors: list[tuple[int, int]]) -> tuple[bytes, list[np.ndarray], np.ndarray]:
    most_h, most_v = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    quant = np.full(64, 3)
    planes = []
    for h, v in factors:
        c = np.zeros((down * v, across * h, 64), int)
        c[..., 0] = rng.integers(-200, 200, c.shape[:2])
        few = rng.random(c.shape) < 0.15
        few[..., 0] = False
        c[few] = rng.integers(-9, 10, int(few.sum()))
        rows, columns = -(-height * v // (8 * most_v)), -(-width * h // (8 * most_h))
        c[rows:, :, 1:], c[:, columns:, 1:] = 0, 0
        planes.append(c)
    return write([(h, v, c) for (h, v), c in zip(factors, planes, strict=True)], width, height, quant), planes, quant


def pixels(planes: list[np.ndarray], quant: np.ndarray, factors: list[tuple[int, int]], width: int, height: int) -> np.ndarray:
    """RGB by the sum over all frequencies, block by block."""
    most_h, most_v = max(f[0] for f in factors), max(f[1] for f in factors)
    c = lambda u: 0.5**0.5 if u == 0 else 1.0
    basis = np.array([[[[c(u) * c(w) / 4 * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * w * np.pi / 16) for x in range(8)] for y in range(8)] for w in range(8)] for u in range(8)])
    full = []
    for (h, v), p in zip(factors, planes, strict=True):
        square = np.zeros(p.shape)
        square[..., ZIGZAG] = p * quant
        blocks = np.einsum("abuw,uwyx->abyx", square.reshape(*p.shape[:2], 8, 8), basis) + 128
        plane = blocks.transpose(0, 2, 1, 3).reshape(p.shape[0] * 8, p.shape[1] * 8)
        full.append(np.kron(plane, np.ones((most_v // v, most_h // h)))[:height, :width])
    y, cb, cr = full if len(full) == 3 else (full[0], 128.0, 128.0)
    rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
