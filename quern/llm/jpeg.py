"""Progressive JPEG in numpy: a decoder for spectral selection and successive approximation, and a writer of payloads.

The decoder accumulates the scans of a file into coefficient arrays, transforms them back, upsamples chroma and gives a
full-resolution RGB tensor.  The writer stores one byte in each AC coefficient: byte b is coefficient b + 256, whose
first scan (without its last bit) always takes the same Huffman code and eight bits, and whose last bit is a refinement
scan.  Since the reader rebuilds the coefficients exactly, the payload is lossless whatever the pixels are; and codes
of fixed width are read as arrays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag position, by walking the diagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_SCALE = 13


def _inverse_basis() -> np.ndarray:
    """64 x 64: pixels from coefficients in zigzag order, as whole numbers, so that float64 products are exact."""
    u = np.arange(8)
    d = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) / 2
    d[0] /= np.sqrt(2)
    return np.rint(np.kron(d, d)[ZIGZAG] * (1 << _SCALE))


_BASIS = _inverse_basis()
_SEGMENT_END = re.compile(rb"\xff(?=[^\x00\xd0-\xd7\xff])")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks, padded to whole MCUs
    cols: int = 0
    true_rows: int = 0  # blocks that a scan of this component alone codes
    true_cols: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), dtype=np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    comments: list[bytes]


class _Huffman:
    def __init__(self, counts: list[int], symbols: bytes) -> None:
        self.codes: dict[tuple[int, int], int] = {}
        self.by_symbol: dict[int, tuple[int, int]] = {}
        code, k = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[k]
                self.by_symbol[symbols[k]] = (length, code)
                code, k = code + 1, k + 1
            code <<= 1
        #: Its only symbol, if there is one and its code is a single bit.
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class _Bits:
    """Bits of an entropy-coded segment without stuffing; beyond its end come ones."""

    def __init__(self, data: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8))
        self.at = 0

    def array(self, n: int) -> np.ndarray:
        out = self.bits[self.at : self.at + n]
        self.at += n
        return out if len(out) == n else np.concatenate([out, np.ones(n - len(out), dtype=np.uint8)])

    def number(self, n: int) -> int:
        out = 0
        for b in self.array(n).tolist():
            out = out << 1 | b
        return out

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | (int(self.bits[self.at]) if self.at < len(self.bits) else 1)
            self.at += 1
            found = table.codes.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such Huffman code")


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _block_order(parts: list[Component]) -> tuple[list[tuple[int, np.ndarray]], int]:
    """For each block of an MCU: (which component, its block in every MCU); and the MCUs of the scan."""
    if len(parts) == 1:
        c = parts[0]
        rows, cols = np.divmod(np.arange(c.true_rows * c.true_cols), max(1, c.true_cols))
        return [(0, rows * c.cols + cols)], c.true_rows * c.true_cols
    across, down = parts[0].cols // parts[0].h, parts[0].rows // parts[0].v
    y, x = np.divmod(np.arange(across * down), across)
    order = []
    for k, c in enumerate(parts):
        order += [(k, (y * c.v + i) * c.cols + x * c.h + j) for i in range(c.v) for j in range(c.h)]
    return order, across * down


def _values(bits: np.ndarray) -> np.ndarray:
    """Numbers from rows of bits."""
    return bits.astype(np.int32) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int32))


def _dc_scan(parts, tables, bits: _Bits, order, first: int, last: int, low: int, refine: bool, predict: list[int]) -> None:
    n, per = last - first, len(order)
    if refine:
        got = bits.array(n * per).reshape(n, per)
        for j, (k, block) in enumerate(order):
            parts[k].coefficients[block[first:last], 0] |= got[:, j].astype(np.int32) << low
        return
    sizes = [tables[k].only for k, _ in order]
    if None not in sizes:  # every difference has a fixed width
        widths = [1 + s for s in sizes]
        got = bits.array(n * sum(widths)).reshape(n, sum(widths))
        at, steps = 0, {}
        for (k, block), s, w in zip(order, sizes, widths):
            step = np.zeros(n, dtype=np.int32)
            if s:
                step = _values(got[:, at + 1 : at + w])
                step = np.where(got[:, at + 1] == 1, step, step - (1 << s) + 1)
            steps.setdefault(k, []).append((block, step))
            at += w
        for k, found in steps.items():
            run = np.cumsum(np.stack([s for _, s in found], axis=1).ravel()).reshape(n, len(found)) + predict[k]
            for j, (block, _) in enumerate(found):
                parts[k].coefficients[block[first:last], 0] = run[:, j] << low
        return
    for i in range(first, last):
        for k, block in order:
            size = bits.symbol(tables[k])
            predict[k] += _signed(bits.number(size), size)
            parts[k].coefficients[block[i], 0] = predict[k] << low


def _ac_first(c: Component, table: _Huffman, bits: _Bits, blocks: np.ndarray, begin: int, end: int, low: int) -> None:
    if table.only is not None and 0 < table.only <= 15:  # no runs, no ends: every coefficient has a fixed width
        n, band = len(blocks), end - begin + 1
        got = bits.array(n * band * (1 + table.only)).reshape(n * band, 1 + table.only)[:, 1:]
        value = np.packbits(got, axis=1)[:, 0].astype(np.int32) if table.only == 8 else _values(got)
        value = np.where(got[:, 0] == 1, value, value - (1 << table.only) + 1)
        c.coefficients[blocks, begin : end + 1] = value.reshape(n, band) << low
        return
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k, row = begin, c.coefficients[b]
        while k <= end:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                row[k] = _signed(bits.number(size), size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1 + (bits.number(zeros) if zeros else 0)
                break


def _correct(c: Component, blocks: np.ndarray, begin: int, end: int, low: int, bits: _Bits) -> None:
    """Correction bits for what is nonzero already, in order."""
    band = c.coefficients[blocks, begin : end + 1]
    at = np.flatnonzero(band)
    got = bits.array(len(at)).astype(np.int32) << low
    flat = band.ravel()
    flat[at] += np.where(flat[at] > 0, got, -got)
    c.coefficients[blocks, begin : end + 1] = flat.reshape(band.shape)


def _ac_refine(c: Component, table: _Huffman, bits: _Bits, blocks: np.ndarray, begin: int, end: int, low: int) -> None:
    i, n = 0, len(blocks)
    while i < n:
        k, row = begin, c.coefficients[blocks[i]]
        while k <= end:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:  # an end of band for a run of blocks, of this one from k on
                run = (1 << zeros) + (bits.number(zeros) if zeros else 0)
                if k == begin:
                    _correct(c, blocks[i : i + run], begin, end, low, bits)
                else:
                    _correct(c, blocks[i : i + 1], k, end, low, bits)
                    _correct(c, blocks[i + 1 : i + run], begin, end, low, bits)
                i += run - 1
                break
            new = (1 if bits.number(1) else -1) << low if size else 0
            while k <= end:
                if row[k]:
                    if bits.number(1):
                        row[k] += (1 << low) if row[k] > 0 else -(1 << low)
                elif zeros:
                    zeros -= 1
                else:
                    row[k] = new
                    k += 1
                    break
                k += 1
        i += 1


def read(data: bytes) -> Image:
    """Coefficients of a progressive file, in zigzag order, not yet dequantised."""
    at, interval = 2, 0
    image, tables = Image(0, 0, [], {}, []), {}
    while at + 4 <= len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                n, kind = (128, ">u2") if body[0] >> 4 else (64, "u1")
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=kind).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                tables[body[0]] = _Huffman(counts, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
            for c in image.components:
                c.rows, c.cols = down * c.v, across * c.h
                c.true_cols = -(-(-(-image.width * c.h // most_h)) // 8)
                c.true_rows = -(-(-(-image.height * c.v // most_v)) // 8)
                c.coefficients = np.zeros((c.rows * c.cols, 64), dtype=np.int32)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded file")
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDA:
            end = _SEGMENT_END.search(data, at)
            stop = end.start() if end else len(data)
            _scan(image, tables, body, data[at:stop], interval)
            at = stop
        elif marker == 0xD9:
            break
    return image


def _scan(image: Image, tables: dict, header: bytes, data: bytes, interval: int) -> None:
    n = header[0]
    picked = [(header[1 + 2 * i], header[2 + 2 * i]) for i in range(n)]
    begin, end, high, low = header[1 + 2 * n], header[2 + 2 * n], header[3 + 2 * n] >> 4, header[3 + 2 * n] & 15
    parts = [next(c for c in image.components if c.ident == i) for i, _ in picked]
    order, units = _block_order(parts)
    segments = _RESTART.split(data) if interval else [data]
    for s, segment in enumerate(segments):
        bits = _Bits(segment)
        first, last = (s * interval, min(units, (s + 1) * interval)) if interval else (0, units)
        if begin == 0:
            _dc_scan(parts, [tables.get(t >> 4) for _, t in picked], bits, order, first, last, low, high > 0, [0] * n)
        else:
            step = _ac_refine if high else _ac_first
            step(parts[0], tables[0x10 | picked[0][1] & 15], bits, order[0][1][first:last], begin, end, low)


def rgb(image: Image) -> np.ndarray:
    """The full-resolution tensor (height, width, 3) of bytes."""
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        coefficients = (c.coefficients * image.quantisers[c.table]).astype(np.float64)
        pixels = np.rint(coefficients @ _BASIS * (1.0 / (1 << _SCALE))) + 128.0
        np.clip(pixels, 0, 255, out=pixels)
        plane = pixels.astype(np.uint8).reshape(c.rows, c.cols, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.cols * 8)
        planes.append((plane, most_v // c.v, most_h // c.h))
    luma = planes[0][0].astype(np.int16)
    if len(planes) == 1:
        out = np.repeat(luma[:, :, None], 3, axis=2).astype(np.uint8)
        return out[: image.height, : image.width]
    wide = lambda a, v, h: a.repeat(v, axis=0).repeat(h, axis=1)
    (cb, bv, bh), (cr, rv, rh) = planes[1], planes[2]
    b, r = cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    # JFIF's factors in sixteenths of a twelfth bit; the sums are exact whole numbers
    red = ((91881 * r + 32768) >> 16).astype(np.int16)
    blue = ((116130 * b + 32768) >> 16).astype(np.int16)
    out = np.empty((*luma.shape, 3), dtype=np.uint8)
    out[:, :, 0] = np.clip(luma + wide(red, rv, rh), 0, 255)
    out[:, :, 2] = np.clip(luma + wide(blue, bv, bh), 0, 255)
    green = wide((-22554 * b).astype(np.int32), bv, bh) + wide((-46802 * r).astype(np.int32), rv, rh)
    out[:, :, 1] = np.clip(luma + ((green + 32768) >> 16).astype(np.int16), 0, 255)
    return out[: image.height, : image.width]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _packed(bits: np.ndarray) -> bytes:
    """Bits as an entropy-coded segment: filled with ones, stuffed."""
    pad = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(pad, dtype=np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def _one_code(kind: int, symbol: int) -> bytes:
    return _segment(0xC4, bytes([kind, 1, *([0] * 15), symbol]))


_BANDS = ((1, 5), (6, 63))
_PER_BLOCK = 63


def _layout(units: int) -> tuple[int, int]:
    """MCUs across and down for so many: about square, with as little to spare as nearby widths allow."""
    side = max(1, int(np.ceil(np.sqrt(units))))
    across = min(range(max(1, side - side // 4), side + 1), key=lambda w: (-units % w, -w))
    return across, -(-units // across)


def write(payload: bytes) -> bytes:
    """A 4:2:0 progressive file whose AC coefficients are the payload's bytes; its comment is the payload's length."""
    blocks = -(-len(payload) // _PER_BLOCK)
    across, down = _layout(max(1, -(-blocks // 6)))
    units = across * down
    stored = np.full(units * 6 * _PER_BLOCK, 255, dtype=np.uint8)
    stored[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    stored = stored.reshape(-1, _PER_BLOCK)
    out = [b"\xff\xd8", _segment(0xFE, len(payload).to_bytes(8, "big")), _segment(0xDB, bytes([0]) + bytes([1]) * 64)]
    frame = bytes([8]) + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out += [_segment(0xC2, frame), _one_code(0x00, 0), _one_code(0x10, 8)]
    out += [_segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0])), _packed(np.zeros(units * 6, dtype=np.uint8))]
    parts = [(1, stored[: units * 4]), (2, stored[units * 4 : units * 5]), (3, stored[units * 5 :])]
    for begin, end in _BANDS:  # all but the last bit: b + 256 without it has eight bits, the first a one
        for ident, rows in parts:
            high = (rows[:, begin - 1 : end] >> 1) | 128
            bits = np.zeros((high.size, 9), dtype=np.uint8)
            bits[:, 1:] = np.unpackbits(high.ravel()[:, None], axis=1)
            out += [_segment(0xDA, bytes([1, ident, 0, begin, end, 1])), _packed(bits.ravel())]
    for ident, rows in parts:  # the last bit: an end of band for as many blocks as it can hold
        runs = [32767] * (len(rows) // 32767) + [len(rows) % 32767] * bool(len(rows) % 32767)
        sizes = sorted({run.bit_length() - 1 for run in runs}, reverse=True)  # one or two, of codes 0 and 10
        out.append(_segment(0xC4, bytes([0x11, 1, len(sizes) - 1, *([0] * 14), *(s << 4 for s in sizes)])))
        pieces, at = [], 0
        for run in runs:
            size = run.bit_length() - 1
            code = [0] if size == sizes[0] else [1, 0]
            extra = [run - (1 << size) >> i & 1 for i in range(size - 1, -1, -1)]
            pieces += [np.array([*code, *extra], dtype=np.uint8), (rows[at : at + run] & 1).ravel()]
            at += run
        out += [_segment(0xDA, bytes([1, ident, 1, 1, 63, 0x10])), _packed(np.concatenate(pieces))]
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload(image: Image) -> bytes:
    """The payload that write() stored, from the coefficients."""
    n = int.from_bytes(image.comments[0], "big")
    stored = np.concatenate([c.coefficients[:, 1:].ravel() for c in image.components])[:n]
    return (stored - 256).astype(np.uint8).tobytes()
