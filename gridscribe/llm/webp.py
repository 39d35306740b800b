"""Lossless WebP (RFC 9649): a decoder of the whole format, and an encoder of eight-bit samples.

The decoder reads prefix codes, back-references, the colour cache and meta prefix codes, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Pixels are 32-bit integers, alpha in the highest byte, then red, green and blue.

The encoder writes palettes, predictions and back-references where they save bits. Images whose only coded channel is green, without back-references or a cache, are decoded many at a time:
each step reads one symbol of every image, so the work per symbol is a few array operations shared by all.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: x and y of short back-reference distances, nearest first.
NEAR = (
    "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 "
    "2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 "
    "2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 "
    "7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
)
_NEAR = [tuple(map(int, xy.split(","))) for xy in NEAR.split()]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000
LENGTHS, DISTANCES = 24, 40  # prefix symbols of lengths and of distances
CACHE_FACTOR = 0x1E35A7BD


class WebpError(ValueError):
    """Bytes that are not a lossless WebP image."""


# --- prefix codes -------------------------------------------------------------------------------

_reversed: dict[int, np.ndarray] = {}


def reversed_bits(n: int) -> np.ndarray:
    """Each number below 2**n with its n bits in reverse order."""
    if n not in _reversed:
        x = np.zeros(1, np.int64)
        for _ in range(n):
            x = np.concatenate([x * 2, x * 2 + 1])
        _reversed[n] = x
    return _reversed[n]


@dataclass(frozen=True)
class Code:
    """Lookup by the next `bits` bits: symbol * 16 + length. A code of one symbol takes no bits."""

    bits: int
    table: np.ndarray

    @property
    def only(self) -> int | None:
        return int(self.table[0]) >> 4 if self.bits == 0 else None


def code_of(symbols: np.ndarray, lengths: np.ndarray) -> Code:
    """Canonical code of symbols (ascending) with their lengths (not 0)."""
    if len(symbols) == 0:
        raise WebpError("a prefix code without symbols")
    if len(symbols) == 1:
        return Code(0, symbols.astype(np.int64) << 4)
    order = np.argsort(lengths, kind="stable")
    symbols, lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
    bits = int(lengths[-1])
    span = np.left_shift(1, bits - lengths)
    if span.sum() != 1 << bits:
        raise WebpError("a prefix code that is not complete")
    return Code(bits, np.repeat(symbols << 4 | lengths, span)[reversed_bits(bits)])


def limited_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of symbols with the given counts, none over the limit; counts are flattened until they fit."""
    counts = counts.astype(np.int64).copy()
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    while True:
        heap = [(int(counts[s]), i) for i, s in enumerate(used)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        new = len(used)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = new
            heapq.heapreplace(heap, (a[0] + b[0], new))
            new += 1
        depth = [0] * new
        for i in range(new - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            out[used] = depth[: len(used)]
            return out
        counts[used] = (counts[used] + 1) >> 1


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Words of the canonical code, first bit lowest."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    words, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - last
        words[s] = reversed_bits(n)[code]
        code, last = code + 1, n
    return words


# --- reading ------------------------------------------------------------------------------------


class Bits:
    """Bits of a byte string, lowest first; past its end there are zeros, up to a bound."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data) + 64

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise WebpError("the image is cut short")
        return out

    def symbol(self, code: Code) -> int:
        entry = int(code.table[self.peek(code.bits)])
        self.at += entry & 15 if code.bits else 0
        if self.at > self.end:
            raise WebpError("the image is cut short")
        return entry >> 4


def read_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = {bits.read(8 if wide else 1)}
        if two:
            symbols.add(bits.read(8))
        found = np.array(sorted(symbols))
        if found[-1] >= alphabet:
            raise WebpError("a symbol outside its alphabet")
        return code_of(found, np.ones(len(found), np.int64))
    small = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        small[CODE_LENGTH_ORDER[k]] = bits.read(3)
    used = np.flatnonzero(small)
    meta = code_of(used, small[used])
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise WebpError("more code lengths than symbols")
    lengths, last = [], 8
    while len(lengths) < alphabet and left:
        left -= 1
        s = bits.symbol(meta)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > alphabet:
        raise WebpError("code lengths beyond their alphabet")
    found = np.array(lengths, np.int64)
    used = np.flatnonzero(found)
    return code_of(used, found[used])


@dataclass
class Header:
    width: int
    height: int
    transforms: list[tuple] = field(default_factory=list)  # type, block bits, own image (or palette)
    coded_width: int = 0


def _blocks(size: int, bits: int) -> int:
    return -(-size // (1 << bits))


def read_header(bits: Bits) -> Header:
    if bits.read(8) != 0x2F:
        raise WebpError("not a lossless image")
    head = Header(bits.read(14) + 1, bits.read(14) + 1)
    bits.read(1)  # a hint that alpha is used
    if bits.read(3):
        raise WebpError("an unknown version")
    width, seen = head.width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebpError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            head.transforms.append((kind, block, width, read_image(bits, _blocks(width, block), _blocks(head.height, block))))
        elif kind == SUBTRACT_GREEN:
            head.transforms.append((kind, 0, width, None))
        else:
            colours = bits.read(8) + 1
            steps = channels(read_image(bits, colours, 1))[0]
            packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            head.transforms.append((kind, packed, width, pixels(np.cumsum(steps, axis=0) & 255)))
            width = _blocks(width, packed)
    head.coded_width = width
    return head


def _value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def read_group(bits: Bits, cache_bits: int) -> tuple[Code, ...]:
    greens = 256 + LENGTHS + (1 << cache_bits if cache_bits else 0)
    return tuple(read_code(bits, n) for n in (greens, 256, 256, 256, DISTANCES))


def read_cache_bits(bits: Bits) -> int:
    if not bits.read(1):
        return 0
    n = bits.read(4)
    if not 1 <= n <= 11:
        raise WebpError("a colour cache of a size that is not allowed")
    return n


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    """Pixels (height, width) of an entropy-coded image."""
    cache_bits = read_cache_bits(bits)
    meta, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        meta = (read_image(bits, _blocks(width, block), _blocks(height, block)) >> 8) & 0xFFFF
    groups = [read_group(bits, cache_bits) for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    return _read_pixels(bits, width, height, cache_bits, meta, block, groups)


def _read_pixels(bits: Bits, width: int, height: int, cache_bits: int, meta, block: int, groups) -> np.ndarray:
    total, out = width * height, []
    cache, cached = [0] * (1 << cache_bits) if cache_bits else [], 0
    shift = 32 - cache_bits
    while len(out) < total:
        at = len(out)
        group = groups[0] if meta is None else groups[int(meta[(at // width) >> block, (at % width) >> block])]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue, alpha = (bits.symbol(c) for c in group[1:4])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 256 + LENGTHS:
            length = _value(bits, s - 256)
            code = _value(bits, bits.symbol(group[4]))
            if code > len(_NEAR):
                distance = code - len(_NEAR)
            else:
                x, y = _NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise WebpError("a back-reference outside the image")
            for k in range(at - distance, at - distance + length):
                out.append(out[k])
        else:
            while cached < at:  # pixels since the last use of the cache
                p = out[cached]
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
                cached += 1
            out.append(cache[s - 256 - LENGTHS])
    return np.array(out, np.uint32).reshape(height, width)


# --- transforms ---------------------------------------------------------------------------------


def channels(p: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue of pixels, as a last axis."""
    return np.stack([(p >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def pixels(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predicted(mode: int, left: list, top: list, corner: list, right: list) -> list:
    """Of one pixel's channels, from its neighbours: left, above, above left, above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 11:
        from_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        from_top = sum(abs(a - c) for a, c in zip(left, corner, strict=True))
        return left if from_left < from_top else top
    out = []
    for a, t, c, r in zip(left, top, corner, right, strict=True):
        if mode == 5:
            v = (((a + r) >> 1) + t) >> 1
        elif mode == 6:
            v = (a + c) >> 1
        elif mode == 7:
            v = (a + t) >> 1
        elif mode == 8:
            v = (c + t) >> 1
        elif mode == 9:
            v = (t + r) >> 1
        elif mode == 10:
            v = (((a + c) >> 1) + ((t + r) >> 1)) >> 1
        elif mode == 12:
            v = min(255, max(0, a + t - c))
        else:
            half = (a + t) >> 1
            v = min(255, max(0, half + int((half - c) / 2)))  # rounds towards zero
        out.append(v)
    return out


def _undo_one_mode(image: np.ndarray, mode: int) -> np.ndarray:
    """The predictor undone where all blocks say left (1) or above (2): running sums."""
    c = channels(image)
    c[0, 0, 0] += 255  # the first pixel's prediction is black
    c[0] = np.cumsum(c[0], axis=0)
    if mode == 2:
        c = np.cumsum(c, axis=0)
    else:
        c[:, 0] = np.cumsum(c[:, 0], axis=0)
        c[1:] = np.cumsum(c[1:], axis=1)
    return pixels(c & 255)


def undo_predictor(image: np.ndarray, block: int, modes: np.ndarray) -> np.ndarray:
    height, width = image.shape
    only = np.unique((modes >> np.uint32(8)) & np.uint32(15))
    if len(only) == 1 and only[0] in (1, 2):
        return _undo_one_mode(image, int(only[0]))
    rest, done = channels(image).tolist(), []
    which = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    black = [255, 0, 0, 0]
    for y in range(height):
        row: list = []
        above = done[-1] if y else None
        for x in range(width):
            if y == 0:
                guess = row[-1] if x else black
            elif x == 0:
                guess = above[0]
            else:
                mode = which[y >> block][x >> block]
                # Beyond the right edge the next pixel in memory is this row's first.
                right = above[x + 1] if x + 1 < width else row[0]
                guess = black if mode in (0, 14, 15) else _predicted(mode, row[-1], above[x], above[x - 1], right)
            row.append([(a + b) & 255 for a, b in zip(rest[y][x], guess, strict=True)])
        done.append(row)
    return pixels(np.array(done, np.int64).reshape(height, width, 4))


def _spread(blocks: np.ndarray, block: int, shape: tuple[int, int]) -> np.ndarray:
    """The block image's value at each pixel."""
    return blocks[np.ix_(np.arange(shape[0]) >> block, np.arange(shape[1]) >> block)]


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x + 128) & 255) - 128


def undo_cross_colour(image: np.ndarray, block: int, factors: np.ndarray) -> np.ndarray:
    c, f = channels(image), _signed(channels(_spread(factors, block, image.shape)))
    green = _signed(c[..., 2])
    c[..., 1] = (c[..., 1] + (f[..., 3] * green >> 5)) & 255
    c[..., 3] = (c[..., 3] + (f[..., 2] * green >> 5) + (f[..., 1] * _signed(c[..., 1]) >> 5)) & 255
    return pixels(c)


def undo_subtract_green(image: np.ndarray) -> np.ndarray:
    c = channels(image)
    c[..., 1] = (c[..., 1] + c[..., 2]) & 255
    c[..., 3] = (c[..., 3] + c[..., 2]) & 255
    return pixels(c)


def undo_palette(image: np.ndarray, packed: int, width: int, palette: np.ndarray) -> np.ndarray:
    each = 8 >> packed
    index = (image >> np.uint32(8)) & np.uint32(255)
    index = np.repeat(index, 1 << packed, axis=1)[:, :width]
    index = (index >> ((np.arange(width) % (1 << packed)) * each).astype(np.uint32)) & np.uint32((1 << each) - 1)
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index]  # indices beyond the palette are transparent


def undo(image: np.ndarray, head: Header) -> np.ndarray:
    for kind, block, width, own in reversed(head.transforms):
        if kind == PREDICTOR:
            image = undo_predictor(image, block, own)
        elif kind == CROSS_COLOUR:
            image = undo_cross_colour(image, block, own)
        elif kind == SUBTRACT_GREEN:
            image = undo_subtract_green(image)
        else:
            image = undo_palette(image, block, width, own)
    return image


# --- containers ---------------------------------------------------------------------------------


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    out, at = [], 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        out.append((name, data[at + 8 : at + 8 + size]))
        at += 8 + size + (size & 1)
    return out


def frames(data: bytes) -> list[tuple[int, int, bytes]]:
    """x, y and bit stream of each lossless frame of a file; a still image is one frame."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("not a WebP file")
    out = []
    for name, body in chunks(data[12:]):
        if name == b"VP8L":
            out.append((0, 0, body))
        elif name == b"ANMF":
            x, y = (2 * int.from_bytes(body[k : k + 3], "little") for k in (0, 3))
            out += [(x, y, inner) for kind, inner in chunks(body[16:]) if kind == b"VP8L"]
    if not out:
        raise WebpError("no lossless frame")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _three(x: int) -> bytes:
    return x.to_bytes(3, "little")


def wrap(streams: list[tuple[int, bytes]], width: int) -> bytes:
    """A file of bit streams of (height, bytes) that stand below one another: a still image, or an animation whose frames fill the canvas."""
    if len(streams) == 1:
        inner = _chunk(b"VP8L", streams[0][1])
    else:
        total = sum(h for h, _ in streams)
        parts = [_chunk(b"VP8X", bytes([2, 0, 0, 0]) + _three(width - 1) + _three(total - 1)), _chunk(b"ANIM", bytes(6))]
        y = 0
        for height, stream in streams:
            # No blending, no disposal: each frame stays where it is.
            parts.append(_chunk(b"ANMF", _three(0) + _three(y // 2) + _three(width - 1) + _three(height - 1) + _three(0) + b"\2" + _chunk(b"VP8L", stream)))
            y += height
        inner = b"".join(parts)
    return b"RIFF" + struct.pack("<I", 4 + len(inner)) + b"WEBP" + inner


def decode_stream(stream: bytes) -> np.ndarray:
    bits = Bits(stream)
    head = read_header(bits)
    return undo(read_image(bits, head.coded_width, head.height, main=True), head)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) of a file; frames of an animation are put where they stand on its canvas."""
    placed = [(x, y, decode_stream(s)) for x, y, s in frames(data)]
    canvas = np.zeros((max(y + p.shape[0] for _, y, p in placed), max(x + p.shape[1] for x, _, p in placed)), np.uint32)
    for x, y, p in placed:
        canvas[y : y + p.shape[0], x : x + p.shape[1]] = p
    return canvas


# --- many green images at a time -------------------------------------------------------------------


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """Pixels of each bit stream; those with one coded channel step by step together, others one by one."""
    out: list[np.ndarray | None] = [None] * len(streams)
    plain: list[tuple[int, Header, Code, int, int]] = []  # image, header, code, first bit, fixed channels
    for i, stream in enumerate(streams):
        bits = Bits(stream)
        head = read_header(bits)
        start = bits.at
        if bits.peek(2) == 0:  # neither a cache nor meta codes
            bits.read(2)
            green, red, blue, alpha, _ = read_group(bits, 0)
            if green.bits and int(green.table.max() >> 4) < 256 and None not in (red.only, blue.only, alpha.only):
                plain.append((i, head, green, bits.at, alpha.only << 24 | red.only << 16 | blue.only))
                continue
        bits.at = start
        out[i] = undo(read_image(bits, head.coded_width, head.height, main=True), head)
    if plain:
        plain.sort(key=lambda x: -x[1].coded_width * x[1].height)
        greens = _step_together([(streams[i], code, at, head.coded_width * head.height) for i, head, code, at, _ in plain])
        for k, (i, head, _, _, rest) in enumerate(plain):
            n = head.coded_width * head.height
            image = greens[:n, k].astype(np.uint32) << np.uint32(8) | np.uint32(rest)
            out[i] = undo(image.reshape(head.height, head.coded_width), head)
    return out


def _step_together(images: list[tuple[bytes, Code, int, int]]) -> np.ndarray:
    """Symbols of images (stream, code, first bit, symbols; most symbols first): a column for each."""
    size = np.array([n for *_, n in images])
    place = np.cumsum([0, *(len(s) for s, *_ in images)])
    joined = b"".join([s for s, *_ in images]) + bytes(16)
    window = np.ndarray((len(joined) - 8,), "<u8", joined, strides=(1,))  # eight bytes from each byte on
    table = np.concatenate([c.table for _, c, *_ in images]).astype(np.int32)
    base = np.cumsum([0, *(len(c.table) for _, c, *_ in images)])[:-1]
    mask = np.array([(1 << c.bits) - 1 for _, c, *_ in images], np.int64)
    at = place[:-1] * 8 + np.array([b for _, _, b, _ in images])
    out = np.empty((int(size[0]), len(images)), np.uint8)
    most = int(size[0])
    reads = 56 // max(c.bits for _, c, *_ in images)  # symbols that one window surely holds
    live = len(images)
    for step in range(0, most, reads):
        live = int(np.searchsorted(-size[:live], -step, side="left"))  # images with more symbols than steps so far
        now = at[:live]
        held = (window[np.minimum(now >> 3, len(window) - 1)] >> (now & 7).astype(np.uint64)).astype(np.int64) & ((1 << 57) - 1)
        m, b, moved = mask[:live], base[:live], np.zeros(live, np.int64)
        for k in range(step, min(step + reads, most)):
            entry = table[b + (held & m)]
            out[k, :live] = entry >> 4
            length = entry & 15
            held >>= length
            moved += length
        at[:live] += moved
    return out


# --- writing ------------------------------------------------------------------------------------


class BitWriter:
    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def put_code(out: BitWriter, lengths: np.ndarray) -> None:
    """A code's description, from the code lengths of its whole alphabet."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        out.put(1, 1)
        out.put(int(len(used) == 2), 1)
        out.put(int(first > 1), 1)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(int(used[1]), 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    zeros = 0
    for n in [*lengths.tolist(), -1]:
        if n == 0:
            zeros += 1
            continue
        while zeros >= 11:
            take = min(zeros, 138)
            tokens.append((18, take - 11, 7))
            zeros -= take
        if zeros >= 3:
            tokens.append((17, zeros - 3, 3))
            zeros = 0
        tokens += [(0, 0, 0)] * zeros
        zeros = 0
        if n > 0:
            tokens.append((n, 0, 0))
    small = limited_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    words = code_words(small)
    out.put(0, 1)
    count = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if small[s]))
    out.put(count - 4, 4)
    for s in CODE_LENGTH_ORDER[:count]:
        out.put(int(small[s]), 3)
    out.put(0, 1)
    alone = np.count_nonzero(small) == 1
    for s, extra, bits in tokens:
        if not alone:
            out.put(int(words[s]), int(small[s]))
        out.put(extra, bits)


def _put_fixed(out: BitWriter, symbol: int) -> None:
    only = np.zeros(256, np.int64)
    only[symbol] = 1
    put_code(out, only)


#: Share of pixels that back-references must cover, and of bits that a prediction must save, before they are used; pixels that a copy has at least.
COVERED, SAVES, COPY = 0.85, 0.1, 8


def residuals(samples: np.ndarray, mode: int) -> np.ndarray:
    """Samples (height, width) less their prediction: the first row's from the left, the first column's from above, others by mode 1 (left) or 2 (above)."""
    out = samples.astype(np.int16)
    if mode == 2:
        out[1:] -= samples[:-1]
    else:
        out[:, 1:] -= samples[:, :-1]
        out[1:, 0] -= samples[:-1, 0]
    if mode == 2:
        out[0, 1:] -= samples[0, :-1]
    return (out & 255).astype(np.uint8)


def _bits(values: np.ndarray) -> float:
    """What an ideal code would take for the values."""
    n = np.bincount(values.ravel(), minlength=256)
    n = n[n > 0]
    return float((n * np.log2(values.size / n)).sum())


def _smooth(samples: np.ndarray) -> bool:
    """Whether neighbours, in a row or in a column, are nearer to one another than samples are to their mean: else no prediction pays."""
    flat = samples.astype(np.int16)
    spread = np.abs(flat - int(flat.mean())).sum(dtype=np.int64)
    return any(np.abs(flat[a] - flat[b]).sum(dtype=np.int64) < 0.7 * spread for a, b in ((np.s_[:, 1:], np.s_[:, :-1]), (np.s_[1:], np.s_[:-1])) if flat[a].size * 2 > flat.size)


def _copies(coded: np.ndarray, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of distance 1 and one row, the one that repeats more: the distance, and begins and ends of the runs that it copies; none where too little repeats."""
    best = (0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    for distance in {1, width}:
        equal = coded[distance:] == coded[:-distance]
        if np.count_nonzero(equal) < COVERED * len(coded):
            continue
        same = np.r_[False, equal, False].astype(np.int8)
        begins, ends = np.flatnonzero(np.diff(same) == 1) + distance, np.flatnonzero(np.diff(same) == -1) + distance
        keep = ends - begins >= COPY
        if (ends - begins)[keep].sum() > (best[2] - best[1]).sum():
            best = (distance, begins[keep], ends[keep])
    return best


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    return 2 * high + ((value - 1) >> (high - 1) & 1), (value - 1) & ((1 << (high - 1)) - 1), high - 1


def encode_samples(samples: np.ndarray, longest: int = 14) -> bytes:
    """Bit stream of an image (height, width) of eight-bit samples: they are its green channel, alpha is 255.

    Up to 16 different samples go through a palette that packs two, four or eight of them in a pixel. More are predicted from the left or from above
    where that saves bits. What mostly repeats the pixel or the row before it is written as back-references.
    """
    height, width = samples.shape
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    colours, alpha, coded_width = np.flatnonzero(np.bincount(samples.ravel(), minlength=256)), 255, width
    if len(colours) <= 16:
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        steps = np.diff(colours, prepend=0)  # ascending, so none is below 0
        _put_palette(out, steps)
        rank = np.zeros(256, np.int64)
        rank[colours] = np.arange(len(colours))
        each, group = 8 >> packed, 1 << packed
        coded_width = _blocks(width, packed)
        wide = np.zeros((height, coded_width * group), np.int64)
        wide[:, :width] = rank[samples]
        wide = wide.reshape(height, -1, group) << (np.arange(group) * each)
        coded = wide.sum(axis=2).ravel()
    else:
        made = {mode: residuals(samples, mode) for mode in (1, 2)} if _smooth(samples) else {}
        mode = min(made, key=lambda m: _bits(made[m]), default=0)
        if mode and _bits(made[mode]) < (1 - SAVES) * _bits(samples):
            out.put(1, 1)
            out.put(PREDICTOR, 2)
            out.put(7, 3)  # blocks of 512 pixels: one
            out.put(0, 1)  # of the modes, one for each block: no cache, and each code has one symbol
            for symbol in (mode, 0, 0, 255, 0):
                _put_fixed(out, symbol)
            samples, alpha = made[mode], 0  # all of alpha is predicted
        coded = samples.ravel().astype(np.int64)
    out.put(0, 3)  # no more transforms, no cache, no meta codes
    distance, begins, ends = _copies(coded, coded_width)
    copied = (ends - begins).sum() >= COVERED * len(coded)
    counts = np.bincount(coded, minlength=256 + LENGTHS)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    if copied:
        at = 0
        for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
            tokens += [(v, 0, 0) for v in coded[at:begin].tolist()]
            for k in range(begin, end, 4096):
                symbol, extra, bits = _prefix(min(4096, end - k))
                tokens.append((256 + symbol, extra, bits))
            at = end
        tokens += [(v, 0, 0) for v in coded[at:].tolist()]
        counts = np.bincount([t[0] for t in tokens], minlength=256 + LENGTHS)
    lengths = limited_lengths(counts, longest)
    put_code(out, lengths)
    for symbol in (0, 0, alpha, (0 if distance == coded_width else 1) if copied else 0):
        _put_fixed(out, symbol)
    alone = np.count_nonzero(lengths) == 1
    if copied:
        words = code_words(lengths)
        for symbol, extra, bits in tokens:
            if not alone:
                out.put(int(words[symbol]), int(lengths[symbol]))
            out.put(extra, bits)
    if copied or alone:
        return out.value.to_bytes(-(-out.size // 8), "little")
    return _with_symbols(out, coded, lengths)


def _put_palette(out: BitWriter, steps: np.ndarray) -> None:
    """Palette entries as steps from one to the next: green steps, alpha 255 and then 0."""
    out.put(0, 1)
    lengths = np.zeros(256 + LENGTHS, np.int64)
    lengths[:256] = limited_lengths(np.bincount(steps, minlength=256), 14)
    alpha = np.zeros(256, np.int64)
    alpha[[0, 255] if len(steps) > 1 else [255]] = 1
    put_code(out, lengths)
    _put_fixed(out, 0)
    _put_fixed(out, 0)
    put_code(out, alpha)
    _put_fixed(out, 0)
    words, several = code_words(lengths), np.count_nonzero(lengths) > 1
    for k, s in enumerate(steps.tolist()):
        if several:
            out.put(int(words[s]), int(lengths[s]))
        if len(steps) > 1:
            out.put(int(k == 0), 1)


def _with_symbols(out: BitWriter, symbols: np.ndarray, lengths: np.ndarray) -> bytes:
    """What is written so far, and the symbols' words after it."""
    words = code_words(lengths)
    each = lengths[symbols]
    begins = np.cumsum(each) - each
    total = int(each.sum())
    head = np.unpackbits(np.frombuffer(out.value.to_bytes(-(-out.size // 8), "little"), np.uint8), bitorder="little")[: out.size]
    within = np.arange(total) - np.repeat(begins, each)
    body = (np.repeat(words[symbols], each) >> within) & 1
    return np.packbits(np.concatenate([head, body.astype(np.uint8)]), bitorder="little").tobytes()
