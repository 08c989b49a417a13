"""Media columns as progressive JPEG (operator 10).

A payload becomes the quantised coefficients of a progressive JPEG, one byte a coefficient in zigzag
order: DC and AC bands by spectral selection, each first without its lowest bit and then refined by
successive approximation.  Coefficients are the format's lossless unit, so reading the scans back into
coefficient arrays returns the payload; the inverse transform, chroma upsampling and colour
conversion then give the full-resolution RGB tensor.

Every block of a scan but the last, one-bit, DC scan is a restart interval of its own, so blocks
are coded and decoded side by side in numpy.  ``decode`` reads any Huffman-coded progressive JPEG of 8-bit samples, serially;
``decode_many`` reads the files written here and hands blocks with unusual refinements to the serial code.

The inverse transform and the colour conversion are integer arithmetic, so equal payloads give equal tensors in any batch.

Nulls and edge cases: a null text is empty; an empty payload is padded to one unit; any byte may
occur; repeated rows are stored each; an empty table gives an empty result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import open_store, scratch_path, table
from helixframe.llm.textbytes import chunks, column, padded, utf8

UNIT = 576
PAD = 255
#: Sampling factors (horizontal, vertical) of Y, Cb and Cr: nine blocks of 64 an MCU of 24 x 16 pixels.
FACTORS = ((3, 2), (1, 1), (1, 2))
MCU_ROWS = 4000
#: (first, last, high, low) of the scans over each component.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (1, 63, 1, 0), (0, 0, 1, 0))


def _zigzag() -> np.ndarray:
    """Place in the 8 x 8 block of each coefficient in coded order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


def _basis() -> np.ndarray:
    """The inverse transform from coded order to samples, times 2^20, in whole numbers."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16)
    both = np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)
    return np.round(both[_zigzag()] * 2**20)


ZIGZAG, BASIS = _zigzag(), _basis()


class Huffman:
    """A code from counts by length (1 to 16) and its symbols in order."""

    def __init__(self, counts: list[int], symbols: list[int]) -> None:
        self.counts, self.symbols = counts, symbols
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.look = np.full((65536, 2), -1, np.int32)  # symbol and length by the next 16 bits
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                self.code[symbol], self.size[symbol] = code, length
                low = code << (16 - length)
                self.look[low : low + (1 << (16 - length))] = (symbol, length)
                code += 1
            at += n
            code <<= 1

    def segment(self, kind: int, slot: int) -> bytes:
        body = bytes([kind << 4 | slot, *self.counts, *self.symbols])
        return struct.pack(">HH", 0xFFC4, len(body) + 2) + body


def _table(short: list[int], rest: list[int], length: int) -> Huffman:
    """Codes of lengths 1, 2, ... for ``short`` and of one length for the rest."""
    counts = [0] * 16
    for k in range(len(short)):
        counts[k] = 1
    counts[length - 1] += len(rest)
    return Huffman(counts, short + rest)


_FIRST = [0x06, 0x05, 0x07, 0x00]
_PAIRS = [r << 4 | s for r in range(16) for s in range(1, 11)]
DC = _table([], list(range(12)), 4)
AC_FIRST = _table(_FIRST, [x for x in _PAIRS + [r << 4 for r in range(1, 16)] if x not in _FIRST], 12)
AC_FINE = _table([0x00], [r << 4 | 1 for r in range(16)] + [r << 4 for r in range(1, 16)], 8)


class Bits:
    """Serial reader of one entropy-coded interval."""

    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data + b"\xff\xff\xff", "big"), 8 * (len(data) + 3)

    def take(self, n: int) -> int:
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def symbol(self, code: Huffman) -> int:
        symbol, length = code.look[self.value >> (self.left - 16) & 0xFFFF]
        self.left -= int(length)
        return int(symbol)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def refine_block(block: np.ndarray, first: int, last: int, low: int, bits: Bits, code: Huffman, run: int) -> int:
    """Refine a block's AC coefficients; returns the end-of-band run that is left."""
    k, bit = first, 1 << low

    def correct(k: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & bit:
            block[k] += bit if block[k] > 0 else -bit

    while not run and k <= last:
        symbol = bits.symbol(code)
        zeros, new = symbol >> 4, 0
        if symbol & 15:
            new = bit if bits.take(1) else -bit
        elif zeros < 15:
            run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
            break
        while k <= last:
            if block[k]:
                correct(k)
            elif zeros:
                zeros -= 1
            else:
                if new:
                    block[k] = new
                k += 1
                break
            k += 1
    if run:
        for k in range(k, last + 1):
            if block[k]:
                correct(k)
        run -= 1
    return run


def _first_block(block: np.ndarray, first: int, last: int, low: int, bits: Bits, code: Huffman, run: int) -> int:
    if run:
        return run - 1
    k = first
    while k <= last:
        symbol = bits.symbol(code)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            block[k] = bits.signed(size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + (bits.take(zeros) if zeros else 0) - 1
    return 0


class Frame:
    """Sizes, tables and coefficient arrays (one a component, a row a block in coded order) of a progressive JPEG."""

    def __init__(self) -> None:
        self.quant: dict[int, np.ndarray] = {}
        self.parts: list[tuple[int, int, int, int]] = []  # id, h, v, quantiser
        self.note, self.height, self.width = b"", 0, 0

    def start(self, body: bytes) -> None:
        self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
        self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        self.h, self.v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcus = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
        self.grid = [(self.mcus[0] * v, self.mcus[1] * h) for _, h, v, _ in self.parts]
        self.blocks = [np.zeros((r * c, 64), np.int32) for r, c in self.grid]

    def order(self, chosen: list[int]) -> list[list[tuple[int, int]]]:
        """The scan's MCUs, each a list of (component, block)."""
        if len(chosen) == 1:
            _, h, v, _ = self.parts[chosen[0]]
            rows, columns = -(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8)
            return [[(chosen[0], r * self.grid[chosen[0]][1] + c)] for r in range(rows) for c in range(columns)]
        return [
            [(k, (y * self.parts[k][2] + v) * self.grid[k][1] + x * self.parts[k][1] + h) for k in chosen for v in range(self.parts[k][2]) for h in range(self.parts[k][1])]
            for y in range(self.mcus[0])
            for x in range(self.mcus[1])
        ]


def quantisers(body: bytes) -> dict[int, np.ndarray]:
    out, at = {}, 0
    while at < len(body):
        wide, slot = body[at] >> 4, body[at] & 15
        out[slot] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int32)
        at += 1 + 64 * (1 + (wide > 0))
    return out


def codes(body: bytes) -> dict[tuple[int, int], Huffman]:
    out, at = {}, 0
    while at < len(body):
        counts = list(body[at + 1 : at + 17])
        out[body[at] >> 4, body[at] & 15] = Huffman(counts, list(body[at + 17 : at + 17 + sum(counts)]))
        at += 17 + sum(counts)
    return out


def decode(data: bytes) -> Frame:
    """Coefficients of any Huffman-coded progressive JPEG, read serially."""
    frame, tables, interval, at = Frame(), {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while data[at + 1] != 0xD9:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            frame.quant |= quantisers(body)
        elif marker == 0xC4:
            tables |= codes(body)
        elif marker == 0xC2:
            frame.start(body)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            frame.note = body
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a Huffman-coded progressive JPEG")
        elif marker == 0xDA:
            end = at
            while data[end] != 0xFF or data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 1
            _scan(frame, body, data[at:end], tables, interval)
            at = end
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
    return frame


def _scan(frame: Frame, head: bytes, data: bytes, tables: dict, interval: int) -> None:
    n = head[0]
    ids = [p[0] for p in frame.parts]
    chosen = [ids.index(head[1 + 2 * k]) for k in range(n)]
    slot = {c: head[2 + 2 * k] for k, c in enumerate(chosen)}
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    parts, start = [], 0
    for k in range(len(data) - 1):
        if data[k] == 0xFF and 0xD0 <= data[k + 1] <= 0xD7:
            parts.append(data[start:k])
            start = k + 2
    parts.append(data[start:])
    mcus, bits, run, before = frame.order(chosen), None, 0, {}
    for number, mcu in enumerate(mcus):
        if bits is None or interval and number % interval == 0:
            bits, run, before = Bits(parts[number // interval if interval else 0].replace(b"\xff\x00", b"\xff")), 0, dict.fromkeys(chosen, 0)
        for c, b in mcu:
            block = frame.blocks[c][b]
            if first == 0 and high == 0:
                before[c] += bits.signed(bits.symbol(tables[0, slot[c] >> 4]))
                block[0] = before[c] * (1 << low)
            elif first == 0:
                block[0] |= bits.take(1) << low
            elif high == 0:
                run = _first_block(block, first, last, low, bits, tables[1, slot[c] & 15], run)
            else:
                run = refine_block(block, first, last, low, bits, tables[1, slot[c] & 15], run)


def samples(blocks: np.ndarray) -> np.ndarray:
    """8 x 8 samples of dequantised blocks in coded order; exact whole-number arithmetic in doubles."""
    raw = np.floor((blocks.astype(np.float64) @ BASIS + 2**19) / 2**20)
    return np.clip(raw + 128, 0, 255).astype(np.int32).reshape(-1, 8, 8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    red = y + ((91881 * cr + 32768) >> 16)
    green = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
    blue = y + ((116130 * cb + 32768) >> 16)
    return np.clip(np.stack([red, green, blue], axis=-1), 0, 255).astype(np.uint8)


def tensor(frame: Frame) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3); one component gives grey."""
    planes = []
    for (rows, columns), (_, h, v, q), blocks in zip(frame.grid, frame.parts, frame.blocks):
        cells = samples(blocks * frame.quant[q]).reshape(rows, columns, 8, 8)
        plane = cells.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane = np.repeat(np.repeat(plane, frame.v // v, axis=0), frame.h // h, axis=1)
        planes.append(plane[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
    return to_rgb(*planes)


def _pack(block: np.ndarray, value: np.ndarray, size: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of tokens ordered by block, each block filled up with ones, and where blocks begin."""
    bits = np.bincount(block, size, blocks).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    into = np.cumsum(size) - size
    at = begin[block] * 8 + into - (np.cumsum(bits) - bits)[block]
    fill = -bits % 8
    at = np.concatenate([at, begin[1:] * 8 - fill])
    value, size = np.concatenate([value, (1 << fill) - 1]), np.concatenate([size, fill])
    wide = value.astype(np.uint64) << (64 - (at & 31) - size).clip(max=63).astype(np.uint64)
    wide[size == 0] = 0
    word = at >> 5
    total = int(begin[-1]) // 4 + 3
    words = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), total) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
    return words.astype(np.uint32).astype(">u4").view(np.uint8)[: begin[-1]], begin


def _stuff(data: np.ndarray, begin: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zero bytes after 255, and a restart marker after each block with ``restart`` >= 0; where blocks begin now."""
    full = data == 0xFF
    grown = np.concatenate([[0], np.cumsum(1 + full)])
    marks = np.where(restart >= 0, 2, 0)
    extra = np.concatenate([[0], np.cumsum(marks)])
    owner = np.repeat(np.arange(len(restart)), np.diff(begin))
    at = grown[:-1] + extra[owner]
    out = np.zeros(int(grown[-1] + extra[-1]), np.uint8)
    out[at] = data
    ends = grown[begin[1:]] + extra[:-1]
    has = restart >= 0
    out[ends[has]], out[ends[has] + 1] = 0xFF, 0xD0 + (restart[has] & 7)
    return out, grown[begin] + extra


def _size(value: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(value + 1.0)).astype(np.int64)


def _first_tokens(coef: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (block, bits, size) of a first AC scan over non-negative ``coef``."""
    band = coef[:, first : last + 1]
    block, k = np.nonzero(band)
    before = np.concatenate([[-1], k[:-1]])
    before[np.concatenate([[True], block[1:] != block[:-1]])] = -1
    run = k - before - 1
    value = band[block, k].astype(np.int64)
    size = _size(value)
    symbol = (run & 15) << 4 | size
    rank = np.arange(len(block)) * 4.0
    t_block, t_rank = [block], [rank + 1]
    t_value, t_size = [AC_FIRST.code[symbol] << size | value], [AC_FIRST.size[symbol] + size]
    long = np.repeat(np.flatnonzero(run > 15), run[run > 15] >> 4)
    if len(long):
        t_block.append(block[long])
        t_rank.append(rank[long])
        t_value.append(np.full(len(long), AC_FIRST.code[0xF0]))
        t_size.append(np.full(len(long), AC_FIRST.size[0xF0]))
    end = np.full(len(coef), -1)
    end[block] = k
    short = np.flatnonzero(end < last - first)
    if len(short):
        t_block.append(short)
        t_rank.append(np.full(len(short), np.inf))
        t_value.append(np.full(len(short), AC_FIRST.code[0]))
        t_size.append(np.full(len(short), AC_FIRST.size[0]))
    if len(t_block) == 1:
        return block, t_value[0], t_size[0]
    block = np.concatenate(t_block)
    order = np.lexsort((np.concatenate(t_rank), block))
    return block[order], np.concatenate(t_value)[order], np.concatenate(t_size)[order]


def _fine_tokens(coef: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the AC refinement: end of band and 63 bits, or serially for blocks with coefficients of 0 or 1."""
    plain = (coef[:, 1:] >= 2).all(axis=1)
    rows = np.flatnonzero(plain)
    bits = (coef[rows, 1:] & 1).astype(np.int64)
    high = bits[:, :31] @ (1 << np.arange(30, -1, -1, dtype=np.int64))
    low = bits[:, 31:] @ (1 << np.arange(31, -1, -1, dtype=np.int64))
    block = np.repeat(rows, 2)
    head = AC_FINE.code[0] << 31
    value = np.stack([high | head, low], axis=1).reshape(-1)
    size = np.tile([31 + int(AC_FINE.size[0]), 32], len(rows))
    odd = []
    for b in np.flatnonzero(~plain):
        odd += [(b, v, n) for v, n in _fine_serial(coef[b])]
    if odd:
        more = np.array(odd, np.int64)
        block, value, size = np.concatenate([block, more[:, 0]]), np.concatenate([value, more[:, 1]]), np.concatenate([size, more[:, 2]])
        order = np.argsort(block, kind="stable")
        block, value, size = block[order], value[order], size[order]
    return block, value, size


def _fine_serial(coef: np.ndarray) -> list[tuple[int, int]]:
    out, wait, zeros = [], [], 0
    ones = [k for k in range(1, 64) if coef[k] == 1]
    for k in range(1, 64):
        v = int(coef[k])
        if v >= 2:
            wait.append((v & 1, 1))
            continue
        if v == 0:
            zeros += 1
            continue
        while zeros > 15:  # corrections belong to the zeros that they stand among
            out, wait, zeros = _long_run(coef, out, k, zeros)
        symbol = zeros << 4 | 1
        out.append((int(AC_FINE.code[symbol]) << 1 | 1, int(AC_FINE.size[symbol]) + 1))
        out += wait
        wait, zeros = [], 0
        ones.pop(0)
    if zeros or wait:
        out.append((int(AC_FINE.code[0]), int(AC_FINE.size[0])))
        out += wait
    return out


def _long_run(coef: np.ndarray, out: list, k: int, zeros: int) -> tuple[list, list, int]:
    """Emit a run of sixteen zeros with the corrections among them; what waits then lies behind it."""
    at, left = k, zeros
    while left:  # the first of the zeros that still wait
        at -= 1
        left -= coef[at] == 0
    while at > 1 and coef[at - 1] >= 2:
        at -= 1
    out.append((int(AC_FINE.code[0xF0]), int(AC_FINE.size[0xF0])))
    seen = 0
    while seen < 16:
        if coef[at] >= 2:
            out.append((int(coef[at]) & 1, 1))
        else:
            seen += 1
        at += 1
    return out, [(int(v) & 1, 1) for v in coef[at:k] if v >= 2], zeros - 16


def layout(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MCU rows and columns of payloads of so many units."""
    columns = -(-units // MCU_ROWS)
    return -(-units // columns), columns


def encode_many(payload: np.ndarray, units: np.ndarray) -> list[bytes]:
    """JPEG files of payloads that lie one after another, ``units`` of 576 bytes each."""
    rows, columns = layout(units)
    mcus = rows * columns
    if (mcus == units).all():
        blocks = payload.reshape(-1, 64)
    else:
        blocks = np.zeros((int(mcus.sum()) * 9, 64), np.uint8)
        at = np.cumsum(mcus * 9) - mcus * 9
        into = np.repeat(at - (np.cumsum(units * 9) - units * 9), units * 9) + np.arange(int(units.sum()) * 9)
        blocks[into] = payload.reshape(-1, 64)
    base = np.cumsum(mcus * 9) - mcus * 9
    pieces: list[list[bytes]] = [[] for _ in units]
    coefs, counts, lead = [], [], 0
    for h, v in FACTORS:
        n = mcus * h * v
        pick = np.repeat(base + mcus * lead - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        coefs.append(blocks[pick].astype(np.int64))
        counts.append(n)
        lead += h * v
    for first, last, high, low in SCANS:
        for c, (coef, n) in enumerate(zip(coefs, counts)):
            total = len(coef)
            if first == 0 and high:
                lengths = (n + 7) // 8
                begin = np.concatenate([[0], np.cumsum(lengths)])
                bits = np.ones(int(begin[-1]) * 8, np.uint8)
                bits[np.repeat(begin[:-1] * 8 - (np.cumsum(n) - n), n) + np.arange(total)] = coef[:, 0] & 1
                data, starts = _stuff(np.packbits(bits), begin, np.full(len(n), -1))
                edges = starts
            else:
                if first == 0:
                    value = coef[:, 0] >> low
                    size = _size(value)
                    tokens = (np.arange(total), DC.code[size] << size | value, DC.size[size] + size)
                elif high == 0:
                    tokens = _first_tokens(coef >> low, first, last)
                else:
                    tokens = _fine_tokens(coef)
                number = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                restart = np.where(number == np.repeat(n, n) - 1, -1, number & 7)
                data, starts = _stuff(*_pack(*tokens, total), restart)
                edges = starts[np.concatenate([[0], np.cumsum(n)])]
            slots = 0x01 if high and first else 0x00
            head = struct.pack(">HHBBBBBB", 0xFFDA, 8, 1, c + 1, slots, first, last, high << 4 | low)
            for k in range(len(n)):
                if first == 0 and high and c == 0:
                    pieces[k].append(struct.pack(">HHH", 0xFFDD, 4, 0))
                pieces[k] += [head, data[edges[k] : edges[k + 1]].tobytes()]
    fixed = struct.pack(">HHB", 0xFFDB, 67, 0) + bytes([1] * 64)
    tables = DC.segment(0, 0) + AC_FIRST.segment(1, 0) + AC_FINE.segment(1, 1) + struct.pack(">HHH", 0xFFDD, 4, 1)
    out = []
    for k, parts in enumerate(pieces):
        note = b"payload bytes %d" % (int(units[k]) * UNIT)
        sof = struct.pack(">HHBHHB", 0xFFC2, 17, 8, int(rows[k]) * 16, int(columns[k]) * 24, 3)
        sof += b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(FACTORS))
        out.append(b"".join([b"\xff\xd8", struct.pack(">HH", 0xFFFE, len(note) + 2), note, fixed, sof, tables, *parts, b"\xff\xd9"]))
    return out


class _Stream:
    """Files laid one after another without stuffed zeros, and a window of 64 bits at any bit."""

    def __init__(self, data: np.ndarray) -> None:
        full = data[:-1] == 0xFF
        keep = np.ones(len(data), bool)
        keep[1:] = ~(full & (data[1:] == 0))
        self.place = np.cumsum(keep) - keep
        self.windows = padded(np.concatenate([data[keep], np.zeros(16, np.uint8)]))
        mark = np.flatnonzero(full & (data[1:] != 0))
        self.restarts = mark[(data[mark + 1] & 0xF8) == 0xD0]

    def peek(self, bit: np.ndarray) -> np.ndarray:
        return self.windows[bit >> 3].byteswap() << (bit & 7).astype(np.uint64)


def _value(window: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The signed number in ``size`` bits after ``skip`` bits."""
    raw = ((window << skip.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
    return np.where((size > 0) & (raw >> np.maximum(size - 1, 0) == 0), raw - (1 << size) + 1, raw)


def decode_many(files: list[bytes]) -> list[Frame]:
    """Frames of files written by ``encode_many``, blocks side by side."""
    data = np.frombuffer(b"".join(files), np.uint8)
    stream = _Stream(data)
    at, frames, scans = 0, [], {}
    for file in files:
        frame, k, tables, interval = Frame(), 2, {}, 0
        marks = None
        while file[k + 1] != 0xD9:
            marker, size = file[k + 1], struct.unpack_from(">H", file, k + 2)[0]
            body, k = file[k + 4 : k + 2 + size], k + 2 + size
            if marker == 0xDB:
                frame.quant |= _cached(quantisers, body)
            elif marker == 0xC4:
                tables |= _cached(codes, body)
            elif marker == 0xC2:
                frame.start(body)
            elif marker == 0xDD:
                interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                frame.note = body
            elif marker == 0xDA:
                if marks is None:
                    marks = _scan_ends(data[at : at + len(file)])
                end = int(marks[np.searchsorted(marks, k)])
                scans.setdefault((body, interval), []).append((len(frames), at + k, at + end, tables))
                k = end
        frames.append(frame)
        at += len(file)
    for (head, interval), found in scans.items():
        _scan_many(frames, stream, head, interval, found)
    return frames


_KEPT: dict[tuple, dict] = {}


def _cached(parse, body: bytes) -> dict:
    if (parse, body) not in _KEPT:
        _KEPT[parse, body] = parse(body)
    return _KEPT[parse, body]


def _scan_ends(file: np.ndarray) -> np.ndarray:
    """Where a marker other than a restart begins."""
    mark = np.flatnonzero(file[:-1] == 0xFF)
    after = file[mark + 1]
    return mark[(after != 0) & ((after & 0xF8) != 0xD0)]


def _scan_many(frames: list[Frame], stream: _Stream, head: bytes, interval: int, found: list) -> None:
    c, first, last, high, low = head[1] - 1, head[3], head[4], head[5] >> 4, head[5] & 15
    tables = found[0][3]
    count = np.array([len(frames[f].blocks[c]) for f, *_ in found])
    coef = np.concatenate([frames[f].blocks[c] for f, *_ in found])
    own = np.cumsum(count) - count
    if interval == 1:
        begin = np.empty(len(coef), np.int64)
        for (f, a, b, _), start, n in zip(found, own, count):
            low_at, high_at = np.searchsorted(stream.restarts, (a, b))
            if high_at - low_at != n - 1:
                raise ValueError("a scan lacks blocks")
            begin[start] = a
            begin[start + 1 : start + n] = stream.restarts[low_at:high_at] + 2
        bit = stream.place[begin] * 8
    else:
        bit = np.repeat(stream.place[[a for _, a, _, _ in found]] * 8 - own, count) + np.arange(len(coef))
    if first == 0 and high:
        coef[:, 0] |= (stream.peek(bit) >> np.uint64(63)).astype(np.int32) << low
    elif first == 0:
        window = stream.peek(bit)
        symbol, length = tables[0, head[2] >> 4].look[(window >> np.uint64(48)).astype(np.int64)].T
        coef[:, 0] = _value(window, length, symbol) << low
    elif high == 0:
        _first_many(coef, bit, stream, tables[1, head[2] & 15], first, last, low)
    else:
        _fine_many(coef, bit, stream, tables[1, head[2] & 15], first, last, low)
    for (f, *_), start, n in zip(found, own, count):
        frames[f].blocks[c] = coef[start : start + n]


def _first_many(coef: np.ndarray, bit: np.ndarray, stream: _Stream, code: Huffman, first: int, last: int, low: int) -> None:
    row, k = np.arange(len(coef)), np.full(len(coef), first)
    while len(row):
        window = stream.peek(bit)
        symbol, length = code.look[(window >> np.uint64(48)).astype(np.int64)].T
        zeros, size = symbol >> 4, symbol & 15
        k = k + np.where((size > 0) | (zeros == 15), zeros, 64)
        some = size > 0
        coef[row[some], k[some]] = _value(window[some], length[some], size[some].astype(np.int64)) << low
        k = k + 1
        bit = bit + length + size
        live = k <= last
        row, k, bit = row[live], k[live], bit[live]


def _fine_many(coef: np.ndarray, bit: np.ndarray, stream: _Stream, code: Huffman, first: int, last: int, low: int) -> None:
    n = last - first + 1
    symbol, length = code.look[(stream.peek(bit) >> np.uint64(48)).astype(np.int64)].T
    plain = (coef[:, first : last + 1] != 0).all(axis=1) & (symbol == 0)
    rows = np.flatnonzero(plain)
    start = bit[rows] + length[rows]
    half = n // 2
    for lead, wide in ((0, half), (half, n - half)):
        window = stream.peek(start + lead)
        shift = np.arange(63, 63 - wide, -1).astype(np.uint64)
        bits = ((window[:, None] >> shift) & np.uint64(1)).astype(np.int32) << low
        span = slice(first + lead, first + lead + wide)
        now = coef[rows, span]
        coef[rows, span] = np.where(now > 0, now + (bits & ~now), now - (bits & ~-now))
    for b in np.flatnonzero(~plain):
        a = int(bit[b]) >> 3
        raw = b"".join(int(stream.windows[min(a + 8 * j, len(stream.windows) - 1)]).to_bytes(8, "little") for j in range(24))
        refine_block(coef[b], first, last, low, Bits(raw), code, 0)


def payload_of(frame: Frame) -> np.ndarray:
    size = int(frame.note.rpartition(b" ")[2])
    return np.concatenate(frame.blocks).astype(np.uint8).reshape(-1)[:size]


def tensors(frames: list[Frame]) -> list[np.ndarray]:
    """RGB tensors; frames of one MCU column, whose MCUs follow each other, are made together."""
    slim = [k for k, f in enumerate(frames) if f.mcus[1] == 1]
    out: list = [None] * len(frames)
    for k, f in enumerate(frames):
        if f.mcus[1] != 1:
            out[k] = tensor(f)
    if slim:
        y, cb, cr = (samples(np.concatenate([frames[k].blocks[c] for k in slim])) for c in range(3))
        n = len(cb)
        y = y.reshape(n, 2, 3, 8, 8).transpose(0, 1, 3, 2, 4).reshape(n * 16, 24)
        cb = np.repeat(np.repeat(cb.reshape(n * 8, 8), 2, axis=0), 3, axis=1)
        rgb = to_rgb(y, cb, np.repeat(cr.reshape(n * 16, 8), 3, axis=1))
        ends = np.cumsum([f.height for f in (frames[k] for k in slim)])
        for k, part in zip(slim, np.split(rgb, ends[:-1])):
            out[k] = part
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and the mean step between rows, to four digits."""
    sums, n = rgb.sum(axis=(0, 1), dtype=np.int64), rgb.shape[0] * rgb.shape[1]
    step = int(np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=0)).sum(dtype=np.int64))
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(f"{int(s) / n:.4f}" for s in sums) + f";{step / n:.4f}"


_FIELDS = [
    ("doc_id", pa.int64(), "long"), ("n_bytes", pa.int64(), "long"), ("payload_bytes", pa.int64(), "long"), ("payload_sha256", pa.string(), "string"),
    ("tail_crc32", pa.int64(), "long"), ("media_bytes", pa.int64(), "long"), ("media_sha256", pa.string(), "string"), ("feature", pa.string(), "string"),
    ("media", pa.binary(), "binary"), ("rgb", pa.binary(), "binary"), ("height", pa.int32(), "int"), ("width", pa.int32(), "int"),
    ("media_path", pa.string(), "string"), ("media_start", pa.int64(), "long"),
]


def _keep(folder: str, files: list[bytes]) -> str:
    """Write the files one after another into a new file of the shared folder."""
    path = f"{folder}/{uuid.uuid4().hex}.jpegs"
    store, name = open_store(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as sink:
        for file in files:
            sink.write(file)
    return path


def _fetch(path: str, sizes: list[int]) -> list[bytes]:
    """The stored files, each read by its range."""
    store, name = open_store(path)
    ends = np.cumsum(sizes).tolist()
    with store.open_input_file(name) as source:
        return [source.read_at(n, end - n) for n, end in zip(sizes, ends)]


def _store(media: bool, rgb: bool, folder: str, files_stay: bool):
    chosen = {"media": media, "rgb": rgb, "height": rgb, "width": rgb, "media_path": files_stay, "media_start": files_stay}
    fields = [f for f in _FIELDS if chosen.get(f[0], True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunks(batches, rows=1000):
            data, at = utf8(column(some, "text"))
            size = np.diff(at)
            units = np.maximum(1, -(-size // UNIT))
            payload = np.full(int(units.sum()) * UNIT, PAD, np.uint8)
            payload[np.repeat((np.cumsum(units) - units) * UNIT - at[:-1], size) + np.arange(len(data))] = data
            files = encode_many(payload, units)
            sizes = [len(f) for f in files]
            path = _keep(folder, files)
            files = _fetch(path, sizes)  # what follows is computed from the stored bytes
            if not files_stay:
                store, name = open_store(path)
                store.delete_file(name)
            frames = decode_many(files)
            rows, start = [], 0
            for k, (frame, image) in enumerate(zip(frames, tensors(frames))):
                read = payload_of(frame)
                values = {"n_bytes": int(size[k]), "payload_bytes": len(read), "payload_sha256": hashlib.sha256(read).hexdigest(), "tail_crc32": zlib.crc32(read[-32:])}
                values |= {"media_bytes": len(files[k]), "media_sha256": hashlib.sha256(files[k]).hexdigest(), "feature": feature(image)}
                values |= {"media": files[k], "media_path": path, "media_start": start}
                start += sizes[k]
                if rgb:
                    values |= {"rgb": image.tobytes(), "height": image.shape[0], "width": image.shape[1]}
                rows.append(values)
            arrays = [column(some, "doc_id") if f[0] == "doc_id" else pa.array([r[f[0]] for r in rows], f[1]) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, [f[0] for f in fields])

    return run, ", ".join(f"{f[0]} {f[2]}" for f in fields)


def store(docs: DataFrame, media: bool = True, rgb: bool = False, folder: str | None = None) -> DataFrame:
    """Each text stored as a progressive JPEG, with digests and features of what is read back.

    The files of a slice of rows are written to one file of the shared folder and read from it by range.  With ``folder``
    they stay there, and media_path and media_start say where; without, a file goes when it has been read, so that the
    disk taken does not grow with the table.  A task that runs again writes files of new names, and only returned rows name
    them.  ``media`` adds the file as a column, ``rgb`` the full-resolution tensor (row-major bytes, height, width).
    """
    run, schema = _store(media, rgb, folder or scratch_path(docs.sparkSession, "jpeg"), folder is not None)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, files = column(batch, "id"), column(batch, "media")
        for k in range(batch.num_rows):
            file = files[k].as_py()
            image = None if file is None else tensor(decode(file))
            shape = (None, None) if image is None else image.shape[:2]
            values = (None if image is None else image.tobytes(), pa.binary()), (shape[0], pa.int32()), (shape[1], pa.int32())
            row = [keys.slice(k, 1), *(pa.array([v], t) for v, t in values)]
            yield pa.RecordBatch.from_arrays(row, ["id", "rgb", "height", "width"])


def decode_media(media: DataFrame) -> DataFrame:
    """RGB tensors of any progressive JPEGs in ``media(id, media)``: id, rgb (row-major bytes), height, width; null stays null."""
    return media.select(F.col("id").cast("long").alias("id"), "media").mapInArrow(_tensors, "id long, rgb binary, height int, width int")


def op10_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents"), media=False)
