"""Lossless WebP (VP8L), from the public bitstream specification: a reader of the whole format and a writer.

The reader decodes prefix codes (simple, normal, one-symbol), back-references, the colour cache and groups
chosen by an entropy image, and undoes the predictor, cross-colour, subtract-green and palette
transforms. Where one group without a cache is in use, runs of literals are decoded in blocks: the
next symbol is looked up at every bit position at once, and the chain of positions is followed by
repeated squaring of the jumps. The writer makes optimal length-limited prefix codes; it is there for
the media columns and to exercise every feature of the reader.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

MAX_SIDE = 1 << 14
#: Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
_EIGHT = np.arange(8, dtype=np.uint32)
#: Bit positions looked up at once, and how often jumps are squared.
BLOCK, SQUARED = 1 << 17, 4


@lru_cache(maxsize=1)
def near_offsets() -> tuple[tuple[int, int], ...]:
    """The 120 pixel offsets of short distance codes: by Euclidean distance, then |x|, then left before right."""
    points = [(x, y) for x in range(-7, 9) for y in range(8) if (x > 0 or y > 0) and not (x < 0 and y == 0)]
    return tuple(sorted(points, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0])))


class Bits:
    """Reader of little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def read(self, n: int) -> int:
        at = self.pos
        self.pos = at + n
        if self.pos > len(self.data) * 8:
            raise ValueError("the bitstream ends too early")
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def peek15(self) -> int:
        at = self.pos
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & 0x7FFF


@lru_cache(maxsize=16)
def _reversed(n: int) -> np.ndarray:
    """The numbers of n bits, each with its bits in reverse."""
    x = np.arange(1 << n, dtype=np.int32)
    out = np.zeros_like(x)
    for i in range(n):
        out |= ((x >> i) & 1) << (n - 1 - i)
    return out


class Prefix:
    """A canonical prefix code: for each `width` bits that may come next, symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else None
        if self.only is not None:
            return
        own = lengths[used]
        self.width = int(own.max())
        order = np.argsort(own, kind="stable")
        room = 1 << (self.width - own[order])
        if room.sum() != 1 << self.width:
            raise ValueError("a prefix code that is not complete")
        # in canonical order the codes fill the numbers from zero; the stream has them bit-reversed
        self.table = np.repeat((used[order] << 4 | own[order]).astype(np.int32), room)[_reversed(self.width)]

    @classmethod
    def of_one(cls, symbol: int) -> Prefix:
        out = cls.__new__(cls)
        out.only = symbol
        return out

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        x = self.table.item(bits.peek15() & ((1 << self.width) - 1))
        bits.pos += x & 15
        return x >> 4


def _read_prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise ValueError("a symbol beyond the alphabet")
        if len(set(symbols)) == 1:
            return Prefix.of_one(symbols[0])
        lengths = np.zeros(size, np.int64)
        lengths[symbols] = 1
        return Prefix(lengths)
    first = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        first[CODE_ORDER[i]] = bits.read(3)
    code = Prefix(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    lengths, at, last = np.zeros(size, np.int64), 0, 8
    while at < size and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            value, n = (last, 3 + bits.read(2)) if s == 16 else (0, 3 + bits.read(3)) if s == 17 else (0, 11 + bits.read(7))
            if at + n > size:
                raise ValueError("code lengths beyond the alphabet")
            lengths[at : at + n] = value
            at += n
    return Prefix(lengths)


def _prefixed(bits: Bits, code: int) -> int:
    """The number that a length or distance symbol and its extra bits stand for."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _literals(bits: Bits, green: Prefix, limit: int) -> np.ndarray:
    """The green symbols from here on while they are literals, at most limit of them; one-symbol other codes."""
    if green.only is not None:
        return np.full(limit if green.only < 256 else 0, green.only, np.int32)
    raw, out = np.frombuffer(bits.data, np.uint8), []
    while limit:
        start = bits.pos
        n = min(BLOCK, limit * 15, len(bits.data) * 8 - start)
        if n <= 0:
            raise ValueError("the bitstream ends too early")
        first = start >> 3
        part = raw[first : first + (n >> 3) + 4]
        wide = np.zeros((n >> 3) + 4, np.uint32)
        wide[: len(part)] = part
        three = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
        ahead = (three[:, None] >> _EIGHT & np.uint32((1 << green.width) - 1)).ravel()[start & 7 : (start & 7) + n]
        entry = green.table[ahead]
        nxt = np.arange(n + 16, dtype=np.int32)
        nxt[:n] += np.where(entry < 256 << 4, entry & 15, 0)
        far = nxt
        for _ in range(SQUARED):
            far = far[far]
        chain, p, jumps = [0], 0, memoryview(far)
        while (q := jumps[p]) != p and q < n:
            chain.append(q)
            p = q
        grid = np.empty((1 << SQUARED, len(chain)), np.int32)
        grid[0] = chain
        for i in range(1, 1 << SQUARED):
            grid[i] = nxt[grid[i - 1]]
        path = grid.T.ravel()
        path = path[np.concatenate(([True], path[1:] != path[:-1]))]  # it stands still at a symbol that is no literal
        kinds = entry[path[path < n]] >> 4
        ends = np.flatnonzero(kinds >= 256)
        k = min(limit, int(ends[0]) if len(ends) else len(kinds))
        out.append(kinds[:k])
        limit -= k
        if k:
            bits.pos = start + int(nxt[path[k - 1]])
        if len(ends) or not k:
            break
    return np.concatenate(out) if out else np.empty(0, np.int32)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels (ARGB as uint32), row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache of a size that is not allowed")
    groups, of, grid_bits, grid_width = 1, None, 0, 0
    if main and bits.read(1):
        grid_bits = bits.read(3) + 2
        grid_width = -(-width >> grid_bits)
        of = (_read_image(bits, grid_width, -(-height >> grid_bits), False) >> 8 & 0xFFFF).tolist()
        groups = max(of) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    cached, at = 0, 0
    plain = groups == 1 and not cache and all(c.only is not None for c in codes[0][1:4])
    if plain:
        rest = codes[0][1].only << 16 | codes[0][2].only | codes[0][3].only << 24
    near = near_offsets()
    while at < total:
        if plain:
            got = _literals(bits, codes[0][0], total - at)
            if len(got):
                out[at : at + len(got)] = got.astype(np.uint32) << 8 | np.uint32(rest)
                at += len(got)
                continue
        green, red, blue, alpha, dist = codes[0] if of is None else codes[of[(at // width >> grid_bits) * grid_width + (at % width >> grid_bits)]]
        s = green.read(bits)
        if s < 256:
            out[at] = red.read(bits) << 16 | s << 8 | blue.read(bits) | alpha.read(bits) << 24
            at += 1
        elif s < 256 + 24:
            n, d = _prefixed(bits, s - 256), _prefixed(bits, dist.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = near[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference beyond the image")
            if d == 1:
                out[at : at + n] = out[at - 1]
            else:
                for i in range(0, n, d):
                    out[at + i : at + min(i + d, n)] = out[at + i - d : at + min(i + d, n) - d]
            at += n
        else:
            if s - 280 >= len(cache):
                raise ValueError("a cache index beyond the cache")
            while cached < at:
                cache[(HASH * int(out[cached]) & 0xFFFFFFFF) >> (32 - cache_bits)] = int(out[cached])
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return out


def _channels(argb: np.ndarray) -> np.ndarray:
    """Bytes b, g, r, a of each pixel."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _mean(a, b):
    return ((a.astype(np.int32) + b) >> 1).astype(np.uint8)


def predict(mode: int, left, top, top_right, top_left):
    """The predicted channels (uint8, last axis 4), for one pixel or many."""
    if mode in (0, 14, 15):
        out = np.zeros_like(top)
        out[..., 3] = 255
        return out
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode <= 10:
        return {
            5: lambda: _mean(_mean(left, top_right), top),
            6: lambda: _mean(left, top_left),
            7: lambda: _mean(left, top),
            8: lambda: _mean(top_left, top),
            9: lambda: _mean(top, top_right),
            10: lambda: _mean(_mean(left, top_left), _mean(top, top_right)),
        }[mode]()
    a, b, c = (x.astype(np.int32) for x in (left, top, top_left))
    if mode == 11:
        toward = np.abs(b - c).sum(-1) < np.abs(a - c).sum(-1)
        return np.where(toward[..., None], left, top)
    if mode == 12:
        return np.clip(a + b - c, 0, 255).astype(np.uint8)
    half = (a + b) >> 1
    return np.clip(half + np.trunc((half - c) / 2).astype(np.int32), 0, 255).astype(np.uint8)


def _modes(image: np.ndarray, bits: int, width: int, y: int) -> np.ndarray:
    row = (image[y >> bits] >> 8 & 15).astype(np.int64)
    return np.repeat(row, 1 << bits)[:width]


def _undo_predictor(pixels: np.ndarray, image: np.ndarray, bits: int) -> None:
    """In place, on channels (height, width, 4). Runs that do not look left go as one; L alone is a running sum."""
    height, width = pixels.shape[:2]
    pixels[0, 0, 3:] += np.uint8(255)
    pixels[0] = np.cumsum(pixels[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = pixels[y], pixels[y - 1]
        row[0] += above[0]
        if width == 1:
            continue
        modes = _modes(image, bits, width, y)
        right = np.concatenate((above[1:], row[:1]))
        cuts = [1, *(np.flatnonzero(modes[2:] != modes[1:-1]) + 2).tolist(), width]
        for a, z in zip(cuts, cuts[1:], strict=False):
            mode = int(modes[a])
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):
                row[a:z] += predict(mode, None, above[a:z], right[a:z], above[a - 1 : z - 1])
            elif mode == 1:
                row[a - 1 : z] = np.cumsum(row[a - 1 : z], axis=0, dtype=np.uint8)
            else:
                for x in range(a, z):
                    row[x] += predict(mode, row[x - 1], above[x], right[x], above[x - 1])


def _tiled(image: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(image, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def _delta(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (m.view(np.int8).astype(np.int32) * c.view(np.int8) >> 5).astype(np.uint8)


def _undo_cross(pixels: np.ndarray, image: np.ndarray, bits: int) -> None:
    code = _channels(_tiled(image, bits, *pixels.shape[:2]))
    green = np.ascontiguousarray(pixels[..., 1])
    red = pixels[..., 2] + _delta(np.ascontiguousarray(code[..., 0]), green)
    pixels[..., 0] += _delta(np.ascontiguousarray(code[..., 1]), green) + _delta(np.ascontiguousarray(code[..., 2]), red)
    pixels[..., 2] = red


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(packed: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle(len(table))
    green = (packed >> 8 & 255).astype(np.uint32)
    if bits:
        per = 8 >> bits
        green = (green[..., None] >> (np.arange(1 << bits, dtype=np.uint32) * per) & ((1 << per) - 1)).reshape(len(packed), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[green]


def _swapped(px: np.ndarray) -> np.ndarray:
    """b, g, r, a to r, g, b, a, and back."""
    out = px.copy()
    out[..., 0], out[..., 2] = px[..., 2], px[..., 0]
    return out


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file, (height, width, 4) as r, g, b, a."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, body = 12, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            body = data[at + 8 : at + 8 + n]
            break
        at += 8 + n + (n & 1)
    if body is None or body[:1] != b"\x2f":
        raise ValueError("no lossless image in the file")
    bits = Bits(body)
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    full, undo, seen = width, [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform that comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            shape = -(-height >> size), -(-width >> size)
            undo.append((kind, size, _read_image(bits, shape[1], shape[0], False).reshape(shape)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0, dtype=np.uint8).view("<u4").ravel()
            undo.append((kind, full if _bundle(n) else width, table))
            width = -(-width >> _bundle(n))
        else:
            undo.append((kind, 0, None))
    argb = _read_image(bits, width, height, True).reshape(height, width)
    for kind, size, own in reversed(undo):
        if kind == PALETTE:
            argb = _undo_palette(argb, own, size)
            continue
        pixels = _channels(argb).copy()
        if kind == GREEN:
            pixels[..., 0] += pixels[..., 1]
            pixels[..., 2] += pixels[..., 1]
        else:
            (_undo_predictor if kind == PREDICTOR else _undo_cross)(pixels, own, size)
        argb = pixels.view("<u4")[..., 0]
    return _swapped(_channels(argb))


# the writer


class Out:
    """Collects (values, bit counts) and packs them, lowest bit first."""

    def __init__(self):
        self.values, self.counts = [], []

    def put(self, value: int, n: int) -> None:
        self.values.append(np.array([value], np.uint32))
        self.counts.append(np.array([n], np.int64))

    def many(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.values.append(values.astype(np.uint32))
        self.counts.append(counts.astype(np.int64))

    def packed(self) -> bytes:
        if not self.values:
            return b""
        values, counts = np.concatenate(self.values), np.concatenate(self.counts)
        out = []
        for i in range(0, len(values), 1 << 18):
            v, c = values[i : i + (1 << 18)], counts[i : i + (1 << 18)]
            first = np.repeat(np.cumsum(c) - c, c)
            out.append((np.repeat(v, c) >> (np.arange(len(first)) - first).astype(np.uint32)).astype(np.uint8) & 1)
        return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths; counts are flattened until none is over limit."""
    out, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts).tolist()
    if len(used) == 1:
        out[used] = 1
    weights = [int(counts[i]) for i in used]
    while len(used) > 1:
        n = len(used)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        up = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = new
            heapq.heapreplace(heap, (a + b, new))
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth[:n]) <= limit:
            out[used] = depth[:n]
            break
        weights = [(w + 1) // 2 + 1 for w in weights]
    return out


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, bit-reversed for the stream."""
    out, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for s in used[np.argsort(lengths[used], kind="stable")].tolist():
        n = int(lengths[s])
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return out


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra, bits of extra)."""
    out, i, last = [], 0, 8
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n, value = j - i, lengths[i]
        if not value:
            while n >= 11:
                k = min(n, 138)
                out.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                out.append((17, n - 3, 3))
                n = 0
        else:
            if value != last:
                out.append((value, 0, 0))
                n, last = n - 1, value
            while n >= 3:
                k = min(n, 6)
                out.append((16, k - 3, 2))
                n -= k
        out += [(value, 0, 0)] * n
        i = j
    return out


def _write_prefix(out: Out, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write the code for symbols with these counts; (codes, lengths), length 0 where only one symbol is used."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        out.put(1 | (s > 1) << 2, 3)
        out.put(s, 8 if s > 1 else 1)
        return np.zeros(len(counts), np.uint32), np.zeros(len(counts), np.int64)
    lengths = code_lengths(counts)
    tokens = _runs(lengths.tolist())
    first = np.bincount([t[0] for t in tokens], minlength=19)
    own = code_lengths(first, 7)
    last = max(i for i in range(19) if own[CODE_ORDER[i]])
    n = max(4, last + 1)
    out.put(0, 1)
    out.put(n - 4, 4)
    for i in range(n):
        out.put(int(own[CODE_ORDER[i]]), 3)
    out.put(0, 1)
    one = np.count_nonzero(own) == 1
    bits = codes(own)
    kinds = np.array([t[0] for t in tokens])
    values = np.column_stack((bits[kinds], [t[1] for t in tokens])).ravel()
    sizes = np.column_stack((own[kinds] * (not one), [t[2] for t in tokens])).ravel()
    out.many(values, sizes)
    if len(used) == 1:
        return np.zeros(len(counts), np.uint32), np.zeros(len(counts), np.int64)
    return codes(lengths), lengths


def _prefix_of(n: int) -> tuple[int, int, int]:
    """A length or distance as (symbol, extra, bits of extra)."""
    if n <= 4:
        return n - 1, 0, 0
    n -= 1
    top = n.bit_length() - 1
    half = n >> (top - 1) & 1
    return 2 * top + half, n - ((2 + half) << (top - 1)), top - 1


#: A stream of pixels: ("l", pixels), ("c", cache index), ("b", length, distance).
def tokens_of(argb: np.ndarray, references: bool = True, cache_bits: int = 0) -> list[tuple]:
    """Literal runs, and back-references to the pixel before for runs of one colour."""
    edge = np.flatnonzero(np.concatenate(([True], argb[1:] != argb[:-1], [True])))
    out, at = [], 0
    if references:
        long = np.flatnonzero(np.diff(edge) >= 12)
        for a, z in zip(edge[long].tolist(), edge[long + 1].tolist(), strict=True):
            out.append(("l", argb[at : a + 1]))
            at = a + 1
            while at < z:
                n = min(4096, z - at)
                out.append(("b", n, 1))
                at += n
    out.append(("l", argb[at:]))
    if not cache_bits:
        return out
    cache, made, flat = {}, [], argb.tolist()
    for p in flat:
        h = (HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)
        made.append(("c", h) if cache.get(h, 0) == p and h in cache else ("l", np.array([p], np.uint32)))
        cache[h] = p
    return made


def _write_image(out: Out, argb: np.ndarray, main: bool, tokens: list[tuple] | None = None, cache_bits: int = 0) -> None:
    """argb: flat pixels; tokens: how to send them (as tokens_of makes them)."""
    tokens = tokens_of(argb, references=False) if tokens is None else tokens
    out.put(cache_bits << 1 | 1, 5) if cache_bits else out.put(0, 1)
    if main:
        out.put(0, 1)
    literal = np.concatenate([np.empty(0, np.uint32), *(t[1] for t in tokens if t[0] == "l")])
    ch = _channels(literal)
    green = np.bincount(ch[:, 1], minlength=280 + (1 << cache_bits if cache_bits else 0))
    dists = np.zeros(40, np.int64)
    for t in tokens:
        if t[0] == "b":
            green[256 + _prefix_of(t[1])[0]] += 1
            dists[_prefix_of(_dist_code(t[2]))[0]] += 1
        elif t[0] == "c":
            green[280 + t[1]] += 1
    g = _write_prefix(out, green)
    r, b, a = (_write_prefix(out, np.bincount(ch[:, k], minlength=256)) for k in (2, 0, 3))
    d = _write_prefix(out, dists)
    others = [(k, c) for k, c in ((2, r), (0, b), (3, a)) if c[1].any()]
    for t in tokens:
        if t[0] == "l":
            own = _channels(t[1])
            cols = [(own[:, 1], g), *((own[:, k], c) for k, c in others)]
            out.many(np.column_stack([c[0][x] for x, c in cols]).ravel(), np.column_stack([c[1][x] for x, c in cols]).ravel())
        elif t[0] == "b":
            (s, x, n), (s2, x2, n2) = _prefix_of(t[1]), _prefix_of(_dist_code(t[2]))
            out.many(np.array([g[0][256 + s], x, d[0][s2], x2]), np.array([g[1][256 + s], n, d[1][s2], n2]))
        else:
            out.many(g[0][[280 + t[1]]], g[1][[280 + t[1]]])


def _dist_code(d: int) -> int:
    """The code of a distance: 2 is (1, 0), the pixel before; others beyond the short codes."""
    return 2 if d == 1 else d + 120


def _do_predictor(argb: np.ndarray, image: np.ndarray, bits: int) -> np.ndarray:
    px = _channels(argb)
    height, width = argb.shape
    out = px.copy()
    out[0, 1:] -= px[0, :-1]
    out[0, 0, 3:] -= np.uint8(255)
    for y in range(1, height):
        out[y, 0] -= px[y - 1, 0]
        right = np.concatenate((px[y - 1, 1:], px[y, :1]))
        modes = _modes(image, bits, width, y)
        for m in np.unique(modes[1:]).tolist() if width > 1 else ():
            at = np.flatnonzero(modes[1:] == m) + 1
            out[y, at] -= predict(m, px[y, at - 1], px[y - 1, at], right[at], px[y - 1, at - 1])
    return out.view("<u4")[..., 0]


def _do_cross(argb: np.ndarray, image: np.ndarray, bits: int) -> np.ndarray:
    px, code = _channels(argb).copy(), _channels(_tiled(image, bits, *argb.shape))
    g, r = (np.ascontiguousarray(px[..., k]) for k in (1, 2))
    c = [np.ascontiguousarray(code[..., k]) for k in range(3)]
    px[..., 0] -= _delta(c[1], g) + _delta(c[2], r)
    px[..., 2] -= _delta(c[0], g)
    return px.view("<u4")[..., 0]


def encode(rgba: np.ndarray, transforms: tuple = (), tokens=None, cache_bits: int = 0) -> bytes:
    """A lossless WebP file of (height, width, 4) pixels.

    transforms, in the order they are applied: ("green",), ("palette",), ("predictor", bits, image) and
    ("cross", bits, image), where image holds the blocks' codes as ARGB.
    """
    height, width = rgba.shape[:2]
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("a side of the image is out of range")
    argb = _swapped(np.ascontiguousarray(rgba)).view("<u4")[..., 0]
    out = Out()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int((rgba[..., 3] != 255).any()), 1)
    out.put(0, 3)
    for t in transforms:
        out.put(1 | {"predictor": PREDICTOR, "cross": CROSS, "green": GREEN, "palette": PALETTE}[t[0]] << 1, 3)
        if t[0] == "green":
            px = _channels(argb).copy()
            px[..., 0] -= px[..., 1]
            px[..., 2] -= px[..., 1]
            argb = px.view("<u4")[..., 0]
        elif t[0] == "palette":
            table, index = np.unique(argb, return_inverse=True)
            out.put(len(table) - 1, 8)
            ch = _channels(table).copy()
            ch[1:] -= _channels(table)[:-1]
            _write_image(out, ch.view("<u4").ravel(), False)
            bits = _bundle(len(table))
            index = index.reshape(argb.shape).astype(np.uint32)
            if bits:
                index = np.pad(index, ((0, 0), (0, -argb.shape[1] % (1 << bits))))
                index = (index.reshape(len(index), -1, 1 << bits) << (np.arange(1 << bits, dtype=np.uint32) * (8 >> bits))).sum(-1, dtype=np.uint32)
            argb = index << 8 | np.uint32(0xFF000000)
        else:
            out.put(t[1] - 2, 3)
            _write_image(out, t[2].ravel().astype(np.uint32), False)
            argb = (_do_predictor if t[0] == "predictor" else _do_cross)(argb, t[2], t[1])
    out.put(0, 1)
    flat = np.ascontiguousarray(argb).ravel()
    _write_image(out, flat, True, tokens(flat) if tokens else tokens_of(flat, True, cache_bits), cache_bits)
    body = out.packed()
    pad = b"\0" * (len(body) & 1)
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
