"""Baseline JPEG (sequential, 8 bits, Huffman) of gray and colour pictures, by the published format.

The reader takes any sampling factors and restart intervals; progressive and arithmetic files give None.
The writer makes its own code tables: codes of one length, so files are larger than they could be."""

from __future__ import annotations

import struct

import numpy as np

#: Places of the coefficients, diagonal by diagonal, every other one upwards.
ZIGZAG = np.array([u * 8 + v for u, v in sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_N = np.arange(8)
_DCT = np.where(_N[:, None] == 0, np.sqrt(1 / 8), 0.5 * np.cos((2 * _N[None, :] + 1) * _N[:, None] * np.pi / 16))


def _colours(planes: list[np.ndarray]) -> np.ndarray:
    y, cb, cr = (p.astype(np.float64) for p in planes)
    rgb = [y + 1.772 * (cb - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.402 * (cr - 128)]
    return np.clip(np.rint(np.stack(rgb, axis=2)), 0, 255).astype(np.uint8)


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            self.held = (self.held << 8) | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8

    def take(self, n: int) -> int:
        """n bits as a signed magnitude of that category."""
        if not n:
            return 0
        self.need(n)
        self.n -= n
        v = (self.held >> self.n) & ((1 << n) - 1)
        self.held &= (1 << self.n) - 1
        return v if v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: list) -> int:
        self.need(16)
        size, value = table[(self.held >> (self.n - 16)) & 0xFFFF]
        if not size:
            raise ValueError("no such code")
        self.n -= size
        self.held &= (1 << self.n) - 1
        return value


def _code_table(counts: bytes, values: bytes) -> list:
    """(length, value) by the next 16 bits."""
    table, code, k = [(0, 0)] * 65536, 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            first = code << (16 - size)
            table[first : first + (1 << (16 - size))] = [(size, values[k])] * (1 << (16 - size))
            code, k = code + 1, k + 1
        code <<= 1
    return table


def decode(data: bytes) -> np.ndarray | None:
    """The picture, gray or blue-green-red; None for what is not a baseline JPEG or is cut off."""
    try:
        return _decode(data)
    except (IndexError, KeyError, ValueError, struct.error):
        return None


def _decode(data: bytes) -> np.ndarray | None:
    if data[:2] != b"\xff\xd8":
        return None
    at, steps, codes, parts, every, transform = 2, {}, {}, [], 0, 1
    while at < len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                codes[body[0]] = _code_table(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif mark in (0xC0, 0xC1):
            depth, h, w, k = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
            if depth != 8 or k not in (1, 3):
                return None
        elif 0xC2 <= mark <= 0xCF:
            return None
        elif mark == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            transform = body[11]
        elif mark == 0xDA:
            break
    tables = {body[1 + 2 * i]: (codes[body[2 + 2 * i] >> 4], codes[16 + (body[2 + 2 * i] & 15)]) for i in range(body[0])}
    end = at
    while not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
        end += 1
    runs, start, i = [], at, at
    while i < end:
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            runs.append(data[start:i])
            start = i + 2
        i += 2 if data[i] == 0xFF else 1
    runs = [r.replace(b"\xff\x00", b"\xff") for r in [*runs, data[start:end]]]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts, most_h, most_v = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-w // (8 * most_h)), -(-h // (8 * most_v))
    blocks = [np.zeros((down * p[2], across * p[1], 64)) for p in parts]
    unit = 0
    for run in runs:
        bits, before = _Bits(run), [0] * len(parts)
        for _ in range(every or across * down):
            if unit == across * down:
                break
            row, col = divmod(unit, across)
            for c, (name, ph, pv, _) in enumerate(parts):
                dc, ac = tables[name]
                for b in range(ph * pv):
                    block = blocks[c][row * pv + b // ph, col * ph + b % ph]
                    before[c] += bits.take(bits.symbol(dc))
                    block[0] = before[c]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if s & 15:
                            k += s >> 4
                            block[k] = bits.take(s & 15)
                            k += 1
                        elif s == 0xF0:
                            k += 16
                        else:
                            break
            unit += 1
        if bits.at - bits.n // 8 > len(run) + 2:
            return None  # cut off
    if unit < across * down:
        return None
    planes = []
    for (_, ph, pv, q), found in zip(parts, blocks, strict=True):
        flat = np.zeros_like(found)
        flat[..., ZIGZAG] = found * steps[q]
        cells = _DCT.T @ flat.reshape(*flat.shape[:2], 8, 8) @ _DCT + 128
        plane = cells.swapaxes(1, 2).reshape(found.shape[0] * 8, found.shape[1] * 8)
        plane = plane.repeat(most_v // pv, axis=0).repeat(most_h // ph, axis=1)[:h, :w]
        planes.append(np.clip(np.rint(plane), 0, 255).astype(np.uint8))
    if len(planes) == 1:
        return planes[0]
    return _colours(planes) if transform else np.stack(planes[::-1], axis=2)


def _marked(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


def _bits(blocks: np.ndarray, pairs: list[int]) -> bytes:
    """The coded bits of blocks (n, 64), the first of each being a difference; ones fill the last byte."""
    code = np.zeros(256, np.int64)
    code[pairs] = np.arange(len(pairs))
    size = np.frexp(np.abs(blocks).astype(np.float64))[1].astype(np.int64)
    said = np.where(blocks > 0, blocks, blocks + (1 << size) - 1)
    # a place for each coefficient's code and magnitude, and one for the end of the block
    value, wide = np.zeros((len(blocks), 65), np.int64), np.zeros((len(blocks), 65), np.int64)
    value[:, 0], wide[:, 0] = (size[:, 0] << size[:, 0]) | said[:, 0], 4 + size[:, 0]
    row, at = np.nonzero(blocks[:, 1:])
    at += 1
    before = np.where(np.diff(row, prepend=-1) > 0, 0, np.concatenate([[0], at[:-1]])[: len(at)])
    gap, bits = at - before - 1, size[row, at]
    long = gap >> 4  # runs of sixteen zeros, each with a code of its own
    ahead = np.array([0, 1, 0x101, 0x10101])[long] * code[0xF0]
    value[row, at] = (((ahead << 8) | code[(gap & 15) * 16 + bits]) << bits) | said[row, at]
    wide[row, at] = 8 * (long + 1) + bits
    value[:, 64], wide[:, 64] = code[0x00], np.where(blocks[:, 63] == 0, 8, 0)
    value, wide = value.ravel(), wide.ravel()
    value, wide = value[wide > 0], wide[wide > 0]
    left = np.repeat(np.cumsum(wide), wide) - np.arange(wide.sum()) - 1
    stream = ((np.repeat(value, wide) >> left) & 1).astype(np.uint8)
    return np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)])).tobytes()


def encode(img: np.ndarray, step: float = 1.0, halved: bool = False, every: int = 0) -> bytes:
    """step: scale of the quantisation (smaller is finer). halved: colours at half the size. every:
    units between restart marks."""
    h, w = img.shape[:2]
    if img.ndim == 3:
        b, g, r = np.moveaxis(img.astype(np.float64), 2, 0)
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [img.astype(np.float64)]
    f = 2 if halved and len(planes) == 3 else 1
    table = np.clip(np.rint((3 + np.add.outer(_N, _N)) * step), 1, 255).reshape(64)[ZIGZAG]
    down, across = -(-h // (8 * f)), -(-w // (8 * f))
    found = []
    for c, plane in enumerate(planes):
        p = np.pad(plane, [(0, down * 8 * f - h), (0, across * 8 * f - w)], mode="edge")
        if c and f == 2:
            p = p.reshape(down * 8, 2, across * 8, 2).mean(axis=(1, 3))
        cells = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2) - 128
        found.append(np.rint((_DCT @ cells @ _DCT.T).reshape(*cells.shape[:2], 64)[..., ZIGZAG] / table).astype(np.int64))
    # codes of one length each: 4 bits for the 12 sizes, 8 bits for the 162 pairs of run and size
    pairs = [0x00, 0xF0, *(run * 16 + size for run in range(16) for size in range(1, 11))]
    # blocks in the order of the scan: unit by unit, each with its blocks of the first part, then of the others
    units = [x.reshape(down, k, across, k, 64).swapaxes(1, 2).reshape(down * across, k * k, 64) for x, k in zip(found, [f, 1, 1], strict=False)]
    for x in units:
        first, line = x[..., 0].copy(), x.reshape(-1, 64)
        line[1:, 0] -= first.ravel()[:-1]
        if every:
            x[::every, 0, 0] = first[::every, 0]
    blocks = np.concatenate(units, axis=1)
    step_, out = every or len(blocks), bytearray()
    for i, start in enumerate(range(0, len(blocks), step_)):
        if i:
            out += bytes([0xFF, 0xD0 + (i - 1) % 8])
        out += _bits(blocks[start : start + step_].reshape(-1, 64), pairs).replace(b"\xff", b"\xff\x00")
    lengths = lambda size, many: bytes(many if i == size else 0 for i in range(1, 17))
    frame = struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([c + 1, (f << 4 | f) if not c else 0x11, 0]) for c in range(len(planes)))
    scan = bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + b"\x00\x3f\x00"
    return (
        b"\xff\xd8" + _marked(0xDB, b"\x00" + bytes(table.astype(int).tolist())) + _marked(0xC0, frame) + _marked(0xC4, b"\x00" + lengths(4, 12) + bytes(range(12)))
        + _marked(0xC4, b"\x10" + lengths(8, len(pairs)) + bytes(pairs)) + (_marked(0xDD, struct.pack(">H", every)) if every else b"") + _marked(0xDA, scan) + bytes(out) + b"\xff\xd9"
    )
