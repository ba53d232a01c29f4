"""Progressive JPEG in numpy: coefficients to scans and back, and on to RGB.

The decoder reads any 8-bit Huffman-coded progressive file with one or three
components.  Scans whose codes and extra bits always add up to the same number
of bits, and refinements made of end-of-band runs, are read as whole arrays;
all other scans go bit by bit through the general reader.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed values of the format: raster position of each zigzag index, markers.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
SOI, EOI, SOF2, DHT, DQT, DRI, SOS, COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in a row, padded to whole units
    high: int = 0
    seen_wide: int = 0  # blocks that scans of this component alone hold
    seen_high: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))  # raster order of blocks, zigzag order within


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes = b""

    def layout(self) -> tuple[int, int]:
        """Sizes the components; (units in a row, rows of units)."""
        hmax, vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        across, down = -(-self.width // (8 * hmax)), -(-self.height // (8 * vmax))
        for c in self.components:
            c.wide, c.high = across * c.h, down * c.v
            c.seen_wide = -(-(-(-self.width * c.h // hmax)) // 8)
            c.seen_high = -(-(-(-self.height * c.v // vmax)) // 8)
        return across, down


class Huffman:
    """A table from the number of codes of each length and their symbols."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.code: dict[int, tuple[int, int]] = {}
        self.find: dict[tuple[int, int], int] = {}
        code, k = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.code[symbols[k]] = (code, length)
                self.find[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    @staticmethod
    def of(lengths: dict[int, int]) -> Huffman:
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        return Huffman(bytes(sum(v == n for v in lengths.values()) for n in range(1, 17)), bytes(order))

    @property
    def segment(self) -> bytes:
        return self.counts + self.symbols

    @lru_cache(maxsize=None)  # noqa: B019
    def uniform(self) -> tuple[int, np.ndarray] | None:
        """(bits, value of each word) if every symbol is a plain size and all words have the same number of bits, 12 at most."""
        bits = {n + s for s, (_, n) in self.code.items()}
        if len(bits) != 1 or max(self.code) > 15 or max(bits) > 12:
            return None
        total = bits.pop()
        table = np.zeros(1 << total, np.int32)
        for s, (c, n) in self.code.items():
            x = np.arange(1 << s)
            table[(c << (total - n)) + x] = np.where(x >= 1 << s >> 1, x, x - (1 << s) + 1) if s else 0
        return total, table

    def __hash__(self) -> int:
        return hash((self.counts, self.symbols))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Huffman) and self.segment == other.segment


_huffman = lru_cache(maxsize=64)(Huffman)


class Bits:
    """A bit reader over unstuffed bytes; past the end it reads ones."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        byte = self.at >> 3
        out = self.data[byte] >> (7 - (self.at & 7)) & 1 if byte < len(self.data) else 1
        self.at += 1
        return out

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table.find:
                return table.find[length, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        x = self.bits(size)
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def words(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n words of `bits` bits."""
    if bits == 8:
        return np.frombuffer(data, np.uint8, n)
    b = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return b @ (1 << np.arange(bits - 1, -1, -1))


def pack_words(values: np.ndarray, bits: int) -> bytes:
    if bits == 8:
        return values.astype(np.uint8).tobytes()
    b = (values[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return pack_bits(b.ravel())


def pack_bits(b: np.ndarray) -> bytes:
    b = b.astype(np.uint8)
    return np.packbits(np.concatenate([b, np.ones(-len(b) % 8, np.uint8)])).tobytes()


def _order(c: Component, across: int, down: int, alone: bool) -> np.ndarray:
    """Indices of a component's blocks in the order of a scan."""
    make = _orders if c.wide * c.high <= 4096 else _orders.__wrapped__
    return make(c.wide, c.high, c.seen_wide, c.seen_high, c.h, c.v, across, down, alone)


@lru_cache(maxsize=512)
def _orders(wide: int, high: int, seen_wide: int, seen_high: int, h: int, v: int, across: int, down: int, alone: bool) -> np.ndarray:
    grid = np.arange(wide * high).reshape(high, wide)
    if alone:
        return grid[:seen_high, :seen_wide].ravel()
    return np.ascontiguousarray(grid.reshape(down, v, across, h).transpose(0, 2, 1, 3)).reshape(down * across, v * h)


@dataclass
class Scan:
    parts: list[int]  # components
    lo: int
    hi: int
    before: int
    low: int


# ---------------------------------------------------------------- reading


def _read_dc(img: Image, scan: Scan, data: list[bytes], tables: list[Huffman], across: int, down: int, restart: int) -> None:
    comps = [img.components[k] for k in scan.parts]
    alone = len(comps) == 1
    orders = [_order(c, across, down, alone) for c in comps]
    orders = [o.reshape(len(o), -1) for o in orders]
    units, per = len(orders[0]), [o.shape[1] for o in orders]
    total = units * sum(per)
    owner = np.repeat(np.arange(len(comps)), per)
    place = np.concatenate(orders, axis=1)
    if len(data) == 1 and scan.before:
        bit = words(data[0], 1, total).reshape(units, -1)
        for k, c in enumerate(comps):
            c.coef[place[:, owner == k].ravel(), 0] |= (bit[:, owner == k].ravel() << scan.low).astype(np.int16)
        return
    fast = tables[0].uniform() if len(data) == 1 and len({t.segment for t in tables}) == 1 else None
    if fast is not None:
        diff = fast[1][words(data[0], fast[0], total)].reshape(units, -1)
        for k, c in enumerate(comps):
            c.coef[place[:, owner == k].ravel(), 0] = np.cumsum(diff[:, owner == k].ravel()) << scan.low
        return
    source, last = None, [0] * len(comps)
    for u in range(units):
        if source is None or restart and u % restart == 0:
            source, last = Bits(data[u // restart if restart else 0]), [0] * len(comps)
        for j, k in enumerate(owner):
            if scan.before:
                comps[k].coef[place[u, j], 0] |= source.bit() << scan.low
            else:
                last[k] += source.value(source.symbol(tables[k]))
                comps[k].coef[place[u, j], 0] = last[k] << scan.low


def _read_ac_first(c: Component, scan: Scan, data: list[bytes], table: Huffman, order: np.ndarray, restart: int) -> None:
    band = scan.hi - scan.lo + 1
    fast = table.uniform() if len(data) == 1 and 0 not in table.code else None
    if fast is not None:
        got = fast[1][words(data[0], fast[0], len(order) * band)].reshape(-1, band)
        c.coef[order, scan.lo : scan.hi + 1] = np.where(got < 0, -(-got << scan.low), got << scan.low)
        return
    source, run = None, 0
    for u, b in enumerate(order):
        if source is None or restart and u % restart == 0:
            source, run = Bits(data[u // restart if restart else 0]), 0
        if run:
            run -= 1
            continue
        k = scan.lo
        while k <= scan.hi:
            r, s = divmod(source.symbol(table), 16)
            if s:
                k += r
                c.coef[b, k] = source.value(s) * (1 << scan.low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + source.bits(r) - 1
                break


def _read_ac_refine(c: Component, scan: Scan, data: list[bytes], table: Huffman, order: np.ndarray, restart: int) -> None:
    one = 1 << scan.low

    def correct(source: Bits, b: int, k: int) -> None:
        if source.bit() and not abs(int(c.coef[b, k])) & one:
            c.coef[b, k] += one if c.coef[b, k] > 0 else -one

    source, u = None, 0
    while u < len(order):
        if source is None or restart and u % restart == 0:
            source = Bits(data[u // restart if restart else 0])
        k, b, run = scan.lo, order[u], 0
        while k <= scan.hi:
            r, s = divmod(source.symbol(table), 16)
            if not s and r < 15:
                run = (1 << r) + source.bits(r)
                break
            new = (one if source.bit() else -one) if s else 0
            while k <= scan.hi:
                if c.coef[b, k]:
                    correct(source, b, k)
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if new and k <= scan.hi:
                c.coef[b, k] = new
            k += 1
        if not run:
            u += 1
            continue
        # one bit for each nonzero coefficient from here to the end of the run, read at once
        stop = min(u + run, len(order))
        which = order[u:stop]
        part = c.coef[which, scan.lo : scan.hi + 1]
        live = part != 0
        live[0, : k - scan.lo] = False
        n = int(live.sum())
        raw = np.frombuffer(source.data, np.uint8)
        head = source.at & 7
        got = np.unpackbits(raw[source.at >> 3 :], count=head + n)[head:] if n else np.zeros(0, np.uint8)
        source.at += n
        x = part[live]
        add = (got.astype(bool)) & ((np.abs(x) & one) == 0)
        part[live] = x + np.where(x > 0, one, -one) * add
        c.coef[which, scan.lo : scan.hi + 1] = part
        u = stop


def read(raw: bytes) -> Image:
    """Coefficients of a progressive file; ValueError for anything else."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, img, quants, dc, ac, restart, comment = 2, None, {}, {}, {}, 0, b""
    across = down = 0
    while at + 4 <= len(raw):
        if raw[at] != 0xFF:
            raise ValueError("no marker")
        kind = raw[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if kind == EOI:
            break
        (size,) = struct.unpack_from(">H", raw, at + 2)
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == DQT:
            while body:
                wide, ident = divmod(body[0], 16)
                quants[ident] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif kind == SOF2:
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3):
                raise ValueError("unsupported frame")
            comps = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if n == 1:
                comps[0].h = comps[0].v = 1
            img = Image(width, height, comps, quants)
            across, down = img.layout()
            for c in comps:
                c.coef = np.zeros((c.wide * c.high, 64), np.int16)
        elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF and kind != DHT:
            raise ValueError("not progressive")
        elif kind == DHT:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == DRI:
            (restart,) = struct.unpack(">H", body)
        elif kind == COM:
            comment = body
        elif kind == SOS:
            if img is None:
                raise ValueError("scan before frame")
            n = body[0]
            idents = [c.ident for c in img.components]
            parts = [idents.index(body[1 + 2 * k]) for k in range(n)]
            pick = [body[2 + 2 * k] for k in range(n)]
            lo, hi, approx = body[1 + 2 * n :]
            scan = Scan(parts, lo, hi, approx >> 4, approx & 15)
            end = at
            while True:
                end = raw.find(b"\xff", end)
                if end < 0 or end + 1 >= len(raw):
                    end = len(raw)
                    break
                if raw[end + 1] and not 0xD0 <= raw[end + 1] <= 0xD7:
                    break
                end += 2
            data = [raw[at:end]]
            if restart:
                for k in range(8):
                    data = [y for x in data for y in x.split(bytes([0xFF, 0xD0 + k]))]
            data, at = [x.replace(b"\xff\x00", b"\xff") for x in data], end
            if lo == 0:
                _read_dc(img, scan, data, [dc.get(p >> 4) for p in pick], across, down, restart)
            else:
                c = img.components[parts[0]]
                order = _order(c, across, down, True)
                (_read_ac_refine if scan.before else _read_ac_first)(c, scan, data, ac[pick[0] & 15], order, restart)
    if img is None:
        raise ValueError("no frame")
    img.comment = comment
    return img


# ---------------------------------------------------------------- writing


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


#: Code lengths so that code and extra bits are eight bits for every difference of seven bits.
DC_TABLE = Huffman.of({s: 8 - s for s in range(8)})
#: One symbol: no zeros before, seven bits.
AC_TABLE = Huffman.of({7: 1})
#: The end-of-band runs.
RUN_TABLE = Huffman.of({r << 4: 4 for r in range(15)})
_DC_WORD = np.zeros(256, np.uint8)
for _s, (_c, _n) in DC_TABLE.code.items():
    for _x in range(1 << _s):
        _d = _x if not _s or _x >> (_s - 1) else _x - (1 << _s) + 1
        _DC_WORD[_d + 128] = (_c << _s) + _x


@lru_cache(maxsize=1)
def _tables() -> bytes:
    quant = _segment(DQT, bytes([0]) + bytes([1] * 64))
    return quant + _segment(DHT, bytes([0x00]) + DC_TABLE.segment) + _segment(DHT, bytes([0x10]) + AC_TABLE.segment) + _segment(DHT, bytes([0x11]) + RUN_TABLE.segment)


def _scan(idents: list[int], table: int, lo: int, hi: int, before: int, low: int, data: bytes) -> bytes:
    head = bytes([len(idents)]) + b"".join(bytes([i, table]) for i in idents) + bytes([lo, hi, before << 4 | low])
    return _segment(SOS, head) + data.replace(b"\xff", b"\xff\x00")


def write_dense(img: Image) -> bytes:
    """A file of an image whose DC values fit 8 bits signed and whose AC values have 128 to 255 as size.

    DC and AC come first without their lowest bit, in two bands for the first
    component, and are refined by one bit each afterwards.
    """
    across, down = img.layout()
    out = [b"\xff\xd8", _segment(COM, img.comment) if img.comment else b"", _tables()]
    frame = struct.pack(">BHHB", 8, img.height, img.width, len(img.components))
    out.append(_segment(SOF2, frame + b"".join(bytes([c.ident, c.h << 4 | c.v, c.quant]) for c in img.components)))
    idents = [c.ident for c in img.components]
    diff, low = [], []
    for c in img.components:
        dc = c.coef[_order(c, across, down, len(idents) == 1).ravel(), 0]
        high = dc >> 1
        step = high.copy()
        step[1:] -= high[:-1]
        diff.append(step.reshape(across * down, -1))
        low.append((dc & 1).reshape(across * down, -1))
    out.append(_scan(idents, 0x00, 0, 0, 0, 1, _DC_WORD[np.concatenate(diff, axis=1).ravel() + 128].tobytes()))
    bands = [(0, 1, 5), *((k, 1, 63) for k in range(1, len(idents))), (0, 6, 63)]
    for k, lo, hi in bands:
        x = img.components[k].coef[:, lo : hi + 1]
        size = np.abs(x) >> 1
        out.append(_scan([idents[k]], 0x00, lo, hi, 0, 1, np.where(x < 0, 127 - size, size).astype(np.uint8).tobytes()))
    out.append(_scan(idents, 0x00, 0, 0, 1, 0, pack_bits(np.concatenate(low, axis=1).ravel())))
    for k, c in enumerate(img.components):
        bit = (np.abs(c.coef[:, 1:]) & 1).astype(np.uint8)
        parts, at = [], 0
        while at < len(bit):
            run = min(len(bit) - at, 32767)
            r = run.bit_length() - 1
            code, _ = RUN_TABLE.code[r << 4]
            lead = (code << r) | (run - (1 << r))
            parts.append(np.array([lead >> i & 1 for i in range(3 + r, -1, -1)], np.uint8))
            parts.append(bit[at : at + run].ravel())
            at += run
        out.append(_scan([idents[k]], 0x01, 1, 63, 1, 0, pack_bits(np.concatenate(parts))))
    out.append(b"\xff\xd9")
    return b"".join(out)


# ---------------------------------------------------------------- pixels


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    x = np.arange(8)
    a = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) / 2
    a[:, 0] /= np.sqrt(2)
    return a.astype(np.float32)


def inverse(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples [block, 8, 8] (uint8) of zigzag coefficients."""
    raster = np.zeros((len(coef), 64), np.float32)
    raster[:, ZIGZAG] = coef * quant.astype(np.float32)
    a = _basis()
    out = a @ raster.reshape(-1, 8, 8) @ a.T
    return np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)


def plane(samples: np.ndarray, c: Component) -> np.ndarray:
    return samples.reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)


def rgb(img: Image, samples: list[np.ndarray]) -> np.ndarray:
    """Full-resolution [height, width, 3] tensor; chroma is replicated to the size of luma."""
    hmax, vmax = max(c.h for c in img.components), max(c.v for c in img.components)
    planes = []
    for c, s in zip(img.components, samples, strict=True):
        p = plane(s, c)
        if vmax > c.v:
            p = np.repeat(p, vmax // c.v, axis=0)
        if hmax > c.h:
            p = np.repeat(p, hmax // c.h, axis=1)
        planes.append(p[: img.height, : img.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.float32), planes[1].astype(np.float32) - 128, planes[2].astype(np.float32) - 128
    out = np.empty((*y.shape, 3), np.float32)
    out[..., 0] = y + np.float32(1.402) * cr
    out[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
    out[..., 2] = y + np.float32(1.772) * cb
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def decode(raw: bytes) -> np.ndarray:
    """The RGB tensor of a progressive file."""
    img = read(raw)
    return rgb(img, [inverse(c.coef, img.quants[c.quant]) for c in img.components])
