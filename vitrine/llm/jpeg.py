"""Progressive JPEG: scans accumulated into coefficient arrays, inverse transform in numpy, chroma upsampled to full resolution.

`decode` reads any progressive (or baseline) Huffman JPEG of 8-bit samples in one or three components. A scan whose tables hold one symbol
each has units of one length, so it is read as a matrix of bits; other scans are read symbol by symbol, by tables of 16 bits.

`encode_payload` stores bytes as coefficients: byte b is the coefficient b above 127 and b - 255 below 128, all of one magnitude
category, so each scan takes such one-symbol tables: DC first, then AC by two spectral bands with the lowest bit left out, then that bit
by successive approximation. The coefficients, and so the bytes, come back exactly. The step of quantisation only counts for the samples:
with STEP most of them lie at an end of their range, so stored tensors are compressible.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

UNIT = 192
#: MCUs in a row of a payload's image; a side has 65,535 pixels at most.
ROW = 4096
#: Blocks that are unpacked at once.
BLOCKS = 1 << 14
STEP = 64
PAYLOAD_COMMENT = b"payload "


def _zigzag() -> np.ndarray:
    """Places of the 64 coefficients, in order of the scan along the anti-diagonals."""
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
_COSINE = np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


@dataclass
class Component:
    h: int
    v: int
    table: int
    across: int = 0  # blocks that hold samples of the image
    down: int = 0
    stride: int = 0  # blocks stored, whole MCUs
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))  # [block, place in zigzag order]


@dataclass
class Image:
    width: int
    height: int
    components: dict[int, Component]
    quantisation: dict[int, np.ndarray]
    comment: bytes = b""


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes) -> None:
        if sum(counts) > len(symbols):
            raise ValueError("a Huffman table is cut short")
        #: For any 16 bits, the length of the code that they start with (0 if none) and its symbol.
        self.lookup = np.zeros(1 << 16, np.uint16)
        at = k = 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[k : k + n]:
                self.lookup[at : at + (1 << (16 - length))] = length << 8 | symbol
                at += 1 << (16 - length)
            k += n
        self.table = memoryview(self.lookup)
        #: (bits of the code, symbol) if there is one symbol only, whose code then is all zeros.
        self.only = divmod(int(self.lookup[0]), 256) if k == 1 else None


class _Bits:
    """A restart interval as the 16 bits that follow each place; a few zeros come after its end."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(16), np.uint8).astype(np.uint32)
        three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        self.window = memoryview((three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32)).astype(np.uint16).ravel())
        self.at = 0

    def take(self, n: int) -> int:
        out = self.window[self.at] >> (16 - n)
        self.at += n
        return out

    def symbol(self, table: _Huffman) -> int:
        length, symbol = divmod(table.table[self.window[self.at]], 256)
        if not length:
            raise ValueError("no such Huffman code")
        self.at += length
        return symbol

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


class BrokenImage(ValueError):
    """Data that isn't a whole image."""


def decode(data: bytes) -> Image:
    """The image in data; BrokenImage if that isn't a whole JPEG of a kind that is read here."""
    try:
        return _decoded(data)
    except BrokenImage:
        raise
    #: What damaged tables, lengths, names and sums lead to; nothing is read beyond the data or written beyond the frame.
    except (ValueError, LookupError, ArithmeticError, AttributeError, TypeError, struct.error) as e:
        raise BrokenImage(f"{type(e).__name__}: {e}") from e


def _decoded(data: bytes) -> Image:
    image, huffman, restart, at = Image(0, 0, {}, {}), {}, 0, 2
    scanned: set[int] = set()
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        while data[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker, at = data[at + 1], at + 2
        if marker == 0xD9:
            break
        size = struct.unpack(">H", data[at : at + 2])[0]
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisation[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC2):
            _frame(image, body, len(data))
        elif marker == 0xDA:
            end = _scan_end(data, at)
            _scan(image, body, data[at:end], huffman, restart)
            if body[1 + 2 * body[0]] == 0:
                scanned.update(body[1 : 1 + 2 * body[0] : 2])
            at = end
        elif 0xC3 <= marker <= 0xCF:
            raise ValueError("neither a baseline nor a progressive Huffman JPEG")
    else:
        raise ValueError("the image has no end")
    if not image.components:
        raise ValueError("no frame")
    if not scanned.issuperset(image.components):
        raise ValueError("a component without a scan")
    return image


def _frame(image: Image, body: bytes, size: int) -> None:
    """size: bytes of the file. A block takes a bit of its first scan at least, so a file can't hold more than 8 blocks a byte."""
    if image.components:
        raise ValueError("a second frame")
    precision, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
    if precision != 8:
        raise ValueError("samples of 8 bits only")
    if n not in (1, 3):
        raise ValueError(f"{n} components, neither grey nor YCbCr")
    if not image.width or not image.height:
        raise ValueError("an image without samples")
    for k in range(n):
        c, hv, table = body[6 + 3 * k : 9 + 3 * k]
        if not 1 <= hv >> 4 <= 4 or not 1 <= hv & 15 <= 4:
            raise ValueError("no such sampling factors")
        image.components[c] = Component(hv >> 4, hv & 15, table)
    most_h, most_v = (max(getattr(c, x) for c in image.components.values()) for x in "hv")
    across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    if across * down * sum(c.h * c.v for c in image.components.values()) > 8 * size:
        raise ValueError("more samples than the data can hold")
    for c in image.components.values():
        c.across, c.down = -(-image.width * c.h // (8 * most_h)), -(-image.height * c.v // (8 * most_v))
        c.stride = across * c.h
        c.coefficients = np.zeros((c.stride * down * c.v, 64), np.int16)


def _scan_end(data: bytes, at: int) -> int:
    while (at := data.index(b"\xff", at)) + 1 < len(data) and (data[at + 1] in (0, 255) or 0xD0 <= data[at + 1] <= 0xD7):
        at += 1 if data[at + 1] == 255 else 2
    return at


def _order(parts: list[Component]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each unit of a scan, its component's place and its block; and the units of an MCU."""
    if len(parts) == 1:
        c = parts[0]
        return np.zeros(c.across * c.down, np.int64), (np.arange(c.down)[:, None] * c.stride + np.arange(c.across)).ravel(), 1
    across, down = parts[0].stride // parts[0].h, len(parts[0].coefficients) // parts[0].stride // parts[0].v
    which = np.concatenate([np.full(c.h * c.v, i) for i, c in enumerate(parts)])
    blocks = [(((np.arange(down) * c.v + y)[:, None] * c.stride) + np.arange(across) * c.h + x).ravel() for c in parts for y in range(c.v) for x in range(c.h)]
    return np.tile(which, across * down), np.stack(blocks, axis=1).ravel(), len(which)


def _scan(image: Image, head: bytes, data: bytes, huffman: dict[int, _Huffman], restart: int) -> None:
    n = head[0]
    ids, tables = head[1 : 1 + 2 * n : 2], head[2 : 2 + 2 * n : 2]
    first, last, bits = head[1 + 2 * n : 4 + 2 * n]
    high, low = bits >> 4, bits & 15
    parts = [image.components[c] for c in ids]
    dc, ac = [huffman.get(t >> 4) for t in tables], [huffman.get(16 + (t & 15)) for t in tables]
    which, blocks, per_mcu = _order(parts)
    if _uniform(parts, data, dc, ac, which, blocks, per_mcu, restart, first, last, high, low):
        return
    pieces = _intervals(data)
    units = per_mcu * restart or len(blocks)
    for k, piece in enumerate(pieces):
        reader, before, run = _Bits(piece), [0] * n, 0
        for i, b in zip(which[k * units : (k + 1) * units], blocks[k * units : (k + 1) * units], strict=True):
            block = parts[i].coefficients[b]
            if first == 0:
                if high:
                    block[0] |= reader.take(1) << low
                else:
                    before[i] += reader.value(reader.symbol(dc[i]))
                    block[0] = before[i] << low
            if last:
                run = (_refine if high else _first)(reader, block, ac[i], max(first, 1), last, low, run)


def _intervals(data: bytes) -> list[bytes]:
    out, start, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0:
        if at + 1 < len(data) and 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[start:at])
            start = at + 2
        at += 2
    return [*out, data[start:]]


def _first(reader: _Bits, block: np.ndarray, table: _Huffman, k: int, last: int, low: int, run: int) -> int:
    if run:
        return run - 1
    while k <= last:
        zeros, size = divmod(reader.symbol(table), 16)
        if size:
            k += zeros
            block[k] = reader.value(size) * (1 << low)
        elif zeros < 15:
            return (1 << zeros) - 1 + reader.take(zeros)
        else:
            k += 15
        k += 1
    return 0


def _refine(reader: _Bits, block: np.ndarray, table: _Huffman, k: int, last: int, low: int, run: int) -> int:
    def correct(k: int) -> None:
        if reader.take(1) and not (abs(int(block[k])) >> low) & 1:
            block[k] = int(block[k]) + ((1 << low) if block[k] > 0 else -(1 << low))

    while k <= last and not run:
        zeros, size = divmod(reader.symbol(table), 16)
        new = 0
        if size:
            new = (1 if reader.take(1) else -1) * (1 << low)
        elif zeros < 15:
            run = (1 << zeros) + reader.take(zeros)
            break
        while k <= last:
            if block[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                break
            k += 1
        if new and k <= last:
            block[k] = new
        k += 1
    if run:
        for j in range(k, last + 1):
            if block[j]:
                correct(j)
        return run - 1
    return 0


def _uniform(parts, data, dc, ac, which, blocks, per_mcu, restart, first, last, high, low) -> bool:  # noqa: ANN001
    """Reads a scan of one-symbol tables as a matrix of bits; False if it isn't one."""
    if last == 0 and not high and restart == 1 and all(t and t.only for t in dc):
        (length, size), *rest = {t.only for t in dc}
        width = (length + size) * per_mcu
        if rest or width % 8:
            return False
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        raw = np.append(raw, np.zeros(2, np.uint8)).reshape(-1, width // 8 + 2)[:, :-2]
        values = _values(np.unpackbits(raw.ravel()).reshape(len(blocks), length + size)[:, length:], size)
        for i, c in enumerate(parts):
            c.coefficients[blocks[which == i], 0] = values[which == i] * (1 << low)
        return True
    if first == 0 or len(parts) != 1 or restart or not (ac[0] and ac[0].only):
        return False
    (length, symbol), place, n = ac[0].only, parts[0].coefficients, last - first + 1
    raw = data.replace(b"\xff\x00", b"\xff") if b"\xff" in data else data
    width = n * (length + symbol) if not high else length + n
    if len(raw) * 8 != width * len(blocks) + (-width * len(blocks)) % 8:
        return False
    if not high and not 0 < symbol < 16 or high and (symbol != 0 or not place[blocks, first : last + 1].all()):
        return False
    step = max(8, BLOCKS // 8 * 8)
    for start in range(0, len(blocks), step):
        some = blocks[start : start + step]
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -(-width * len(some) // 8), start * width // 8))[: width * len(some)].reshape(len(some), width)
        if high:
            old = place[some, first : last + 1]
            place[some, first : last + 1] = old + np.sign(old) * (bits[:, length:].astype(np.int16) << low)
        else:
            place[some, first : last + 1] = _values(bits.reshape(len(some), n, length + symbol)[:, :, length:], symbol) * (1 << low)
    return True


def _values(bits: np.ndarray, size: int) -> np.ndarray:
    """JPEG's signed values of `size` bits in the last axis."""
    v = (np.packbits(bits, axis=-1)[..., 0].astype(np.int16) >> (8 - size)) if size <= 8 else bits @ (1 << np.arange(size - 1, -1, -1)).astype(np.int16)
    return np.where(v >> (size - 1), v, v - (1 << size) + 1)


def rows_of_rgb(image: Image):  # noqa: ANN201
    """The image as RGB, uint8 [rows, width, 3], a row of MCUs at a time."""
    parts = list(image.components.values())
    most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
    for top in range(-(-image.height // (8 * most_v))):
        planes = []
        for c in parts:
            some = c.coefficients[top * c.v * c.stride : (top + 1) * c.v * c.stride] * image.quantisation[c.table]
            square = np.empty(some.shape)
            square[:, ZIGZAG] = some
            samples = np.matmul(_COSINE.T, np.matmul(square.reshape(-1, 8, 8), _COSINE)) + 128
            plane = samples.reshape(c.v, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.v, 8 * c.stride)
            if (c.h, c.v) != (most_h, most_v):
                plane = plane[np.arange(8 * most_v) * c.v // most_v][:, np.arange(image.width) * c.h // most_h]
            planes.append(plane[:, : image.width])
        height = min(8 * most_v, image.height - 8 * most_v * top)
        y, cb, cr = (planes if len(planes) == 3 else [planes[0], *[np.full_like(planes[0], 128.0)] * 2])
        rgb = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=-1)
        yield np.clip(np.rint(rgb), 0, 255).astype(np.uint8)[:height]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_symbol(table: int, length: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([table, *(int(k == length) for k in range(1, 17)), symbol]))


_HEAD_TABLES = _segment(0xDB, bytes([0, *[STEP] * 64]))
_DC = _one_symbol(0x00, 8, 8) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0]))
_AC = _one_symbol(0x10, 1, 7) + _segment(0xDD, b"\x00\x00")
_FINE = _one_symbol(0x10, 1, 0)


def _stuffed(data: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(data == 255)
    return np.insert(data, full + 1, 0) if len(full) else data


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG that holds payload, of a positive multiple of UNIT bytes; each UNIT is one MCU of a Y, a Cb and a Cr block."""
    n = len(payload) // UNIT
    across, down = min(n, ROW), -(-n // ROW)
    data = np.full((across * down, 3, 64), 32, np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    frame = struct.pack(">BHHB", 8, 8 * down, 8 * across, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])
    #: Each MCU is a restart interval, so the prediction of DC is zero and a unit is an 8-bit code (zero) and the byte itself.
    units = np.zeros((len(data), 6), np.uint8)
    units[:, 1::2] = data[:, :, 0]
    marks = np.empty((len(data), 2), np.uint8)
    marks[:, 0], marks[:, 1] = 255, 0xD0 + np.arange(len(data)) % 8
    if (units == 255).any():
        dc = b"".join(_stuffed(u).tobytes() + m.tobytes() for u, m in zip(units, marks, strict=True))
    else:
        dc = np.concatenate([units, marks], axis=1).tobytes()
    out = [b"\xff\xd8", _segment(0xFE, PAYLOAD_COMMENT + b"%d" % len(payload)), _HEAD_TABLES, _segment(0xC2, frame), _DC, dc[:-2], _AC]
    #: A code of one bit (zero) and seven bits of value: the byte without its lowest bit.
    for c in range(3):
        for first, last in ((1, 5), (6, 63)):
            out += [_segment(0xDA, bytes([1, c + 1, 0, first, last, 0x01])), (data[:, c, first : last + 1] >> 1).tobytes()]
    out.append(_FINE)
    for c in range(3):
        low = data[:, c, 1:]
        bits = np.zeros((len(data), 64), np.uint8)
        bits[:, 1:] = (low & 1) ^ (low < 128)
        out += [_segment(0xDA, bytes([1, c + 1, 0, 1, 63, 0x10])), _stuffed(np.packbits(bits, axis=1).ravel()).tobytes()]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Image) -> bytes:
    """The bytes that encode_payload stored, from the coefficients; BrokenImage if the image can't hold them."""
    n, of = image.comment.removeprefix(PAYLOAD_COMMENT), {c.coefficients.size for c in image.components.values()}
    if not n.isdigit() or len(n) > 18 or len(of) != 1 or not 0 < int(n) <= sum(c.coefficients.size for c in image.components.values()):
        raise BrokenImage("no such payload")
    data = np.stack([c.coefficients for c in image.components.values()], axis=1)
    return np.where(data > 0, data, data + 255).astype(np.uint8).tobytes()[: int(n)]
