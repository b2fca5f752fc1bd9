"""Lossless WebP (VP8L): a decoder of the whole format and an encoder.

The decoder reads prefix codes, back-references, the colour cache and groups of codes, then inverts predictor, cross-colour, subtract-green and
palette transforms. An image with one group of codes, no cache and one varying channel - what `store` writes - is decoded in numpy: every bit
position gets the symbol that would begin there and the position after it, and the positions that really are beginnings are walked in strides of four.
Everything else is read symbol by symbol."""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, carried_id, modest_batches, restored_id, text_of

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE, CACHE_MULTIPLIER, OPAQUE_BLACK = 0x2F, 0x1E35A7BD, 0xFF000000
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
N_LENGTHS, N_DISTANCES, MAX_BITS = 24, 40, 15
#: Near offsets have short codes: by distance from the pixel, then by |x|, the right one first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))

#: An image of `store` is this wide, and this high at most; a longer payload is a row of images.
WIDTH, MAX_ROWS = 64, 2048
#: Longest code that the encoder gives, so that a decoder's table stays in the cache.
ENCODER_BITS = 12


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at = self.at
        if at + n > 8 * len(self.data):
            raise ValueError("the image is cut off")
        self.at = at + n
        first = at >> 3
        return int.from_bytes(self.data[first : first + 5], "little") >> (at & 7) & ((1 << n) - 1)

    def peek(self) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7) & 0x7FFF


# --- prefix codes


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of symbols with these lengths, first bit lowest."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    used = np.flatnonzero(lengths)
    if not len(used):
        return codes
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order].astype(np.int64)
    top = int(n.max())
    first = np.concatenate(([0], np.cumsum(1 << (top - n))[:-1])) >> (top - n)
    out = np.zeros(len(order), dtype=np.int64)
    for b in range(top):
        on = n > b
        out |= np.where(on, (first >> np.maximum(n - 1 - b, 0)) & 1, 0) << b
    codes[order] = out
    return codes


class Prefix:
    """A prefix code as a table: the next `bits` bits -> symbol and length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.symbol, self.length = np.array([self.only]), np.array([0])
            return
        self.only = None
        self.bits = top = int(lengths.max())
        if int((1 << (top - lengths[used].astype(np.int64))).sum()) != 1 << top:
            raise ValueError("a prefix code isn't complete")
        codes = canonical(lengths)
        self.symbol, self.length = np.zeros(1 << top, dtype=np.int32), np.zeros(1 << top, dtype=np.int32)
        for s, n, c in zip(used.tolist(), lengths[used].tolist(), codes[used].tolist(), strict=True):
            self.symbol[c :: 1 << n] = s
            self.length[c :: 1 << n] = n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        k = bits.peek() & ((1 << self.bits) - 1)
        bits.at += int(self.length[k])
        return int(self.symbol[k])


def read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, dtype=np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if two:
            symbols.append(bits.read(8))
        lengths[symbols] = 1
        return lengths
    of_lengths = np.zeros(19, dtype=np.int64)
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = Prefix(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > alphabet:
                raise ValueError("more code lengths than symbols")
            lengths[at : at + n] = value
            at += n
    return lengths


def prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def prefix_of(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their value, for a length or a distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    extra = v.bit_length() - 2
    return 2 * extra + (v >> extra), extra, v & ((1 << extra) - 1)


# --- decoder


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (ARGB, u32) of an entropy-coded image; only the main one may have groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    group_bits, groups_at, n_groups = 0, None, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        groups_at = read_image(bits, -(-width >> group_bits), -(-height >> group_bits), False)
        groups_at = ((groups_at >> 8) & 0xFFFF).reshape(-(-height >> group_bits), -1)
        n_groups = int(groups_at.max()) + 1
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    groups = [[Prefix(read_lengths(bits, n)) for n in sizes] for _ in range(n_groups)]
    if n_groups == 1 and not cache_bits and all(g.only is not None for g in groups[0][1:4]):
        red, blue, alpha = (g.only for g in groups[0][1:4])
        green = _one_channel(bits, groups[0][0], groups[0][4], width, width * height)
        return green.astype(np.uint32) << 8 | np.uint32(alpha << 24 | red << 16 | blue)
    return _any_channels(bits, groups, groups_at, group_bits, cache_bits, width, height)


def _any_channels(bits: Bits, groups: list, groups_at: np.ndarray | None, group_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    total, out, cache, cached = width * height, [0] * (width * height), [0] * (1 << cache_bits), 0
    at = 0
    while at < total:
        group = groups[0] if groups_at is None else groups[int(groups_at[at // width >> group_bits, at % width >> group_bits])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (g.read(bits) for g in group[1:4])
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + N_LENGTHS:
            n = prefix_value(bits, s - 256)
            d = _distance(prefix_value(bits, group[4].read(bits)), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for at in range(at, at + n):  # noqa: B020  it may overlap itself
                out[at] = out[at - d]
            at += 1
        else:
            for p in out[cached:at]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            cached = at
            out[at] = cache[s - 256 - N_LENGTHS]
            at += 1
    return np.array(out, dtype=np.uint32)


def _one_channel(bits: Bits, green: Prefix, far: Prefix, width: int, total: int) -> np.ndarray:
    out = np.empty(total, dtype=np.uint8)
    if green.only is not None and green.only < 256:
        out[:] = green.only
        return out
    start = bits.at
    body = np.frombuffer(bits.data, dtype=np.uint8, offset=start >> 3)
    n_bytes = len(body)
    padded = np.zeros(n_bytes + 4, dtype=np.uint32)
    padded[:n_bytes] = body
    window = padded[:-4] | padded[1:-3] << 8 | padded[2:-2] << 16
    top = 8 * n_bytes
    key = ((window[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)).reshape(-1)
    # a symbol that is no literal keeps its place, and so does the end: walks stop there
    step = np.where(green.symbol < 256, green.length, 0).astype(np.int32)
    one = np.arange(top + 1, dtype=np.int32)
    one[:-1] += step[key]
    np.minimum(one, top, out=one)
    two = one[one]
    four = memoryview(two[two])
    base, at, p = (start >> 3) * 8, 0, start & 7
    while at < total:
        walked = []
        add, room = walked.append, (total - at + 3) // 4
        while (q := four[p]) != p and room:
            add(p)
            p = q
            room -= 1
        if walked:
            a = np.array(walked, dtype=np.int32)
            b = two[a]
            places = np.stack((a, one[a], b, one[b]), axis=1).reshape(-1)
            # a stride may be cut short by what ends it: equal places are that end
            keep = np.ones(len(places), dtype=bool)
            keep[-4:] = places[-4:] != p
            places = places[keep][: total - at]
            out[at : at + len(places)] = green.symbol[key[places]]
            at += len(places)
            if at == total:  # the last stride may have gone beyond the image
                p = int(one[places[-1]])
        if at < total:
            if p >= top:
                raise ValueError("the image is cut off")
            bits.at = base + p
            s = green.read(bits)
            if s < 256:
                raise ValueError("the image is cut off")
            n = prefix_value(bits, s - 256)
            d = _distance(prefix_value(bits, far.read(bits)), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            while n:  # it may overlap itself
                m = min(n, d)
                out[at : at + m] = out[at - d : at - d + m]
                at, n = at + m, n - m
            p = bits.at - base
        else:
            bits.at = base + p
    return out


def _channels(pixels: np.ndarray) -> np.ndarray:
    """u32 -> int array with a last axis of A, R, G, B."""
    return np.stack([pixels >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = (channels & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The value that a predictor mode gives for a pixel's four channels from its neighbours'."""

    def half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a + b) >> 1

    if mode == 11:  # whichever of left and top is nearer to left + top - top_left
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + _toward_zero(mean - top_left), 0, 255)
    plain = {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left),
        7: lambda: half(left, top), 8: lambda: half(top_left, top), 9: lambda: half(top, top_right), 10: lambda: half(half(left, top_left), half(top, top_right)),
    }
    return plain[mode]() if mode in plain else np.array([255, 0, 0, 0])


def _toward_zero(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * (np.abs(x) >> 1)


def _predicted(flat: np.ndarray, at: int, width: int, mode: int) -> np.ndarray:
    """flat: channels of pixels in reading order. Right of a row's end stands the beginning of the next row, which is this one's left edge."""
    if at == 0:
        return np.array([255, 0, 0, 0])
    if at < width:
        return flat[at - 1]
    if at % width == 0:
        return flat[at - width]
    return predict(mode, flat[at - 1], flat[at - width], flat[at - width + 1], flat[at - width - 1])


def _block(data: np.ndarray, width: int, bits: int, at: int) -> int:
    return int(data[at // width >> bits, at % width >> bits])


def undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """modes: a mode for each block of 2**bits pixels a side. Blocks that all use the left pixel are running sums of a row."""
    c = _channels(pixels)
    if (modes == 1).all():
        rows = c.reshape(-1, width, 4)
        rows[0, 0] += (255, 0, 0, 0)
        rows[:, 0] = np.cumsum(rows[:, 0], axis=0)
        return _packed(np.cumsum(rows, axis=1).reshape(-1, 4))
    for at in range(len(c)):
        c[at] = (c[at] + _predicted(c, at, width, _block(modes, width, bits, at))) & 0xFF
    return _packed(c)


def do_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    c = _channels(pixels)
    return _packed(np.array([c[at] - _predicted(c, at, width, _block(modes, width, bits, at)) for at in range(len(c))]))


def cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """elements: for each block red_to_blue, green_to_blue, green_to_red as signed bytes in the places of R, G, B."""
    at = np.arange(len(pixels))
    e = _channels(elements)[at // width >> bits, at % width >> bits].astype(np.int8).astype(np.int32)
    c = _channels(pixels)

    def share(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
        return factor * (colour & 0xFF).astype(np.int8).astype(np.int32) >> 5

    red = c[:, 1].copy()
    sign = 1 if undo else -1
    c[:, 1] += sign * share(e[:, 3], c[:, 2])
    c[:, 3] += sign * (share(e[:, 2], c[:, 2]) + share(e[:, 1], c[:, 1] if undo else red))
    return _packed(c)


def shift_green(pixels: np.ndarray, undo: bool) -> np.ndarray:
    c = _channels(pixels)
    sign = 1 if undo else -1
    c[:, 1] += sign * c[:, 2]
    c[:, 3] += sign * c[:, 2]
    return _packed(c)


def _bundle_bits(colours: int) -> int:
    """Pixels that share one, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    b = _bundle_bits(len(palette))
    green = (pixels >> 8 & 0xFF).reshape(height, -1)
    part = 8 >> b
    index = (green[:, :, None] >> (np.arange(1 << b) * part).astype(np.uint32)) & ((1 << part) - 1)
    index = index.reshape(height, -1)[:, :width].reshape(-1)
    return np.where(index < len(palette), palette[np.minimum(index, len(palette) - 1)], np.uint32(0)).astype(np.uint32)


def decode_vp8l(data: bytes) -> np.ndarray:
    """Pixels (ARGB, u32) of a VP8L chunk, height x width."""
    bits = Bits(data)
    if bits.read(8) != SIGNATURE:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version of VP8L")
    undo, coded_width = [], width
    seen: set[int] = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform is used twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            across, down = -(-coded_width >> size), -(-height >> size)
            image = read_image(bits, across, down, False).reshape(down, across)
            undo.append((lambda p, w, i=image, s=size: undo_predictor(p, w, i >> 8 & 0xF, s)) if kind == PREDICTOR else (lambda p, w, i=image, s=size: cross_colour(p, w, i, s, True)))
            undo[-1] = (undo[-1], coded_width)
        elif kind == SUBTRACT_GREEN:
            undo.append((lambda p, w: shift_green(p, True), coded_width))
        else:
            deltas = _channels(read_image(bits, bits.read(8) + 1, 1, False))
            palette = _packed(np.cumsum(deltas, axis=0))
            undo.append((lambda p, w, c=palette: undo_palette(p, w, height, c), coded_width))
            coded_width = -(-coded_width >> _bundle_bits(len(palette)))
    pixels = read_image(bits, coded_width, height, True)
    for change, w in reversed(undo):
        pixels = change(pixels, w)
    return pixels.reshape(height, width)


def decode(data: bytes) -> np.ndarray:
    """Pixels of a WebP file with one lossless image."""
    images = list(split_files(data))
    if len(images) != 1:
        raise ValueError("not one WebP file")
    return decode_vp8l(images[0])


def split_files(data: bytes) -> Iterator[bytes]:
    """The VP8L chunks of WebP files that stand one after another."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        (size,) = struct.unpack_from("<I", data, at + 4)
        end, at = at + 8 + size, at + 12
        while at < end:
            kind, (n,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
            if kind == b"VP8L":
                yield data[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)
        at = end


# --- encoder


class Writer:
    """Collects (value, number of bits) and packs them."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self._v: list[int] = []
        self._n: list[int] = []

    def put(self, value: int, n: int) -> None:
        self._v.append(value)
        self._n.append(n)

    def put_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.counts.append(counts)

    def _flush(self) -> None:
        if self._v:
            self.values.append(np.array(self._v, dtype=np.int64))
            self.counts.append(np.array(self._n, dtype=np.int64))
            self._v, self._n = [], []

    def bytes(self) -> bytes:
        self._flush()
        v, n = np.concatenate(self.values), np.concatenate(self.counts)
        ends = np.cumsum(n)
        within = np.arange(int(ends[-1]), dtype=np.int64) - np.repeat(ends - n, n)
        return np.packbits((np.repeat(v, n) >> within & 1).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman lengths of at most `limit` bits; counts are halved until they fit."""
    lengths = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].tolist()
    while True:
        n = len(weights)
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * n - 1)
        for new in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = new
            heapq.heappush(heap, (a + b, new))
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[:n]) <= limit:
            lengths[used] = depth[:n]
            return lengths
        weights = [(w + 1) // 2 for w in weights]


def write_code(w: Writer, counts: np.ndarray, limit: int = ENCODER_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Writes a prefix code for symbols that occur so often; its codes and lengths (0 bits for a single symbol)."""
    used = np.flatnonzero(counts).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        lengths = np.zeros(len(counts), dtype=np.int64)
        if len(used) == 2:
            lengths[used] = 1
        return canonical(lengths), lengths
    lengths = code_lengths(counts, limit)
    tokens: list[tuple[int, int, int]] = []
    at, end = 0, int(np.flatnonzero(lengths)[-1]) + 1
    values = lengths.tolist()
    while at < end:
        if values[at]:
            tokens.append((values[at], 0, 0))
            at += 1
            continue
        n = 1
        while values[at + n] == 0:
            n += 1
        at += n
        while n:
            if n >= 11:
                m = min(n, 138)
                tokens.append((18, m - 11, 7))
            elif n >= 3:
                m = n
                tokens.append((17, m - 3, 3))
            else:
                m = 1
                tokens.append((0, 0, 0))
            n -= m
    of = np.bincount([t for t, _, _ in tokens], minlength=19)
    if np.count_nonzero(of) == 1:
        of[0 if not of[0] else 1] = 1  # a code of code lengths has two symbols at least
    of_lengths = code_lengths(of, 7)
    of_codes, of_n = canonical(of_lengths).tolist(), of_lengths.tolist()
    listed = max(k for k in range(19) if of_n[CODE_LENGTH_ORDER[k]]) + 1
    w.put(0, 1)
    w.put(max(listed, 4) - 4, 4)
    for k in range(max(listed, 4)):
        w.put(of_n[CODE_LENGTH_ORDER[k]], 3)
    # only so many tokens are written as lead up to the last symbol
    w.put(1, 1)
    nbits = max(2, (len(tokens) - 2).bit_length() if len(tokens) > 2 else 2)
    nbits += nbits & 1
    w.put((nbits - 2) // 2, 3)
    w.put(max(0, len(tokens) - 2), nbits)
    if len(tokens) < 2:
        raise AssertionError("a code of one token")
    for s, extra, n in tokens:
        w.put(of_codes[s], of_n[s])
        if n:
            w.put(extra, n)
    return canonical(lengths), lengths


def write_image(w: Writer, pixels: np.ndarray, width: int, *, main: bool = False, cache_bits: int = 0, copies: list[tuple[int, int, int]] = (), group_bits: int = 0) -> None:
    """Any pixels, symbol by symbol. copies: (place, length, distance), in order and apart. group_bits: blocks of 2**group_bits get codes of their own, by their parity."""
    flat = pixels.tolist()
    n_groups, groups_at = 1, None
    if group_bits:
        down, across = -(-(len(flat) // width) >> group_bits), -(-width >> group_bits)
        groups_at = (np.add.outer(np.arange(down), np.arange(across)) % 2).astype(np.uint32)
        n_groups = int(groups_at.max()) + 1
    tokens: list[tuple[int, list[tuple[int, int, int, int]]]] = []  # group, (alphabet, symbol, extra value, extra bits)
    cache: dict[int, int] = {}
    waiting, at = list(copies), 0
    while at < len(flat):
        group = 0 if groups_at is None else int(groups_at[at // width >> group_bits, at % width >> group_bits])
        done = at
        if waiting and waiting[0][0] == at:
            _, n, d = waiting.pop(0)
            code = next((i + 1 for i, (x, y) in enumerate(NEAR) if max(1, x + y * width) == d), d + len(NEAR))
            (ls, le, lv), (ds, de, dv) = prefix_of(n), prefix_of(code)
            tokens.append((group, [(0, 256 + ls, lv, le), (4, ds, dv, de)]))
            at += n
        else:
            p = flat[at]
            key = (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if cache_bits and cache.get(key, 0) == p:
                tokens.append((group, [(0, 256 + N_LENGTHS + key, 0, 0)]))
            else:
                tokens.append((group, [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]))
            at += 1
        if cache_bits:
            for p in flat[done:at]:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    w.put(bool(cache_bits), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(bool(group_bits), 1)
        if group_bits:
            w.put(group_bits - 2, 3)
            write_image(w, (groups_at << 8).reshape(-1), groups_at.shape[1])
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    codes = []
    for g in range(n_groups):
        counts = [np.zeros(n, dtype=np.int64) for n in sizes]
        for group, parts in tokens:
            if group == g:
                for alphabet, s, _, _ in parts:
                    counts[alphabet][s] += 1
        codes.append([write_code(w, c) for c in counts])
    for group, parts in tokens:
        for alphabet, s, value, n in parts:
            c, lengths = codes[group][alphabet]
            w.put(int(c[s]), int(lengths[s]))
            if n:
                w.put(value, n)


def _header(w: Writer, width: int, height: int) -> None:
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)


def _file(chunk: bytes) -> bytes:
    padded = chunk + b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + padded


def encode(pixels: np.ndarray, *, transforms: tuple[int, ...] = (), modes: np.ndarray | None = None, elements: np.ndarray | None = None, block_bits: int = 2, **image) -> bytes:
    """A WebP file of ARGB pixels (height x width) with the transforms asked for, in that order. modes and elements: for each block of 2**block_bits pixels."""
    height, width = pixels.shape
    w, flat = Writer(), pixels.reshape(-1).astype(np.uint32)
    _header(w, width, height)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == SUBTRACT_GREEN:
            flat = shift_green(flat, False)
        elif kind == PALETTE:
            colours = np.unique(flat)
            w.put(len(colours) - 1, 8)
            c = _channels(colours)
            write_image(w, _packed(np.diff(c, axis=0, prepend=0)), len(colours))
            flat, width = _bundled(np.searchsorted(colours, flat).reshape(height, width), len(colours))
        else:
            w.put(block_bits - 2, 3)
            data = (modes.astype(np.uint32) << 8 | np.uint32(OPAQUE_BLACK)) if kind == PREDICTOR else elements
            write_image(w, data.reshape(-1), data.shape[1])
            flat = do_predictor(flat, width, modes, block_bits) if kind == PREDICTOR else cross_colour(flat, width, elements, block_bits, False)
    w.put(0, 1)
    write_image(w, flat, width, main=True, **image)
    return _file(w.bytes())


def _bundled(index: np.ndarray, colours: int) -> tuple[np.ndarray, int]:
    b = _bundle_bits(colours)
    height, width = index.shape
    across = -(-width >> b)
    wide = np.zeros((height, across << b), dtype=np.uint32)
    wide[:, :width] = index
    packed = (wide.reshape(height, across, 1 << b) << (np.arange(1 << b) * (8 >> b)).astype(np.uint32)).sum(axis=2).astype(np.uint32)
    return (packed << 8 | np.uint32(OPAQUE_BLACK)).reshape(-1), across


#: A repeat shorter than this is cheaper as literals.
LEAST_COPY = 12


def _copies(s: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that repeat the sample before or the row above."""
    found: list[tuple[int, int, int]] = []
    for d in (1, WIDTH):
        if len(s) <= d:
            continue
        same = np.concatenate(([0], (s[d:] == s[:-d]).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(same))
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= LEAST_COPY
        found += [(b + d, e - b, d) for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out, free = [], 0
    for at, n, d in found:
        if at < free:
            at, n = free, n - (free - at)
        while n >= LEAST_COPY:
            m = min(n, 4096)
            out.append((at, m, d))
            at, n, free = at + m, n - m, at + m
    return out


#: Predictors that `store` tries: the pixel to the left, the one above. A block of theirs is as large as the format allows.
TRIED_MODES, LARGEST_BLOCK = (1, 2), 9
#: A predictor is tried if the entropy of what it leaves is below this part of the samples' own.
WORTH_TRYING = 0.95


def _entropy(counts: np.ndarray) -> float:
    held = counts[counts > 0]
    return float((held * np.log2(held.sum() / held)).sum())


def _smallest(samples: np.ndarray) -> bytes:
    """The shortest of the files without a predictor and with those that promise to be worth it."""
    files = [_plain(samples)]
    if len(samples) > WIDTH:
        own = WORTH_TRYING * _entropy(np.bincount(samples, minlength=256))
        for mode, distance in zip(TRIED_MODES, (1, WIDTH), strict=True):
            if _entropy(np.bincount(samples[distance:] - samples[:-distance], minlength=256)) < own:
                files.append(_plain(samples, mode))
    return min(files, key=len)


def _plain(samples: np.ndarray, mode: int | None = None) -> bytes:
    """A VP8L file of one channel, in numpy: literals and copies, one group of codes; after a predictor if a mode is given, else few colours go through a palette that bundles pixels."""
    w = Writer()
    rows = len(samples) // WIDTH
    _header(w, WIDTH, rows)
    if mode is not None:
        modes = np.full((-(-rows >> LARGEST_BLOCK), 1), mode)
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(LARGEST_BLOCK - 2, 3)
        write_image(w, (modes.astype(np.uint32) << 8 | np.uint32(OPAQUE_BLACK)).reshape(-1), 1)
        samples = (do_predictor(samples.astype(np.uint32) << 8 | np.uint32(OPAQUE_BLACK), WIDTH, modes, LARGEST_BLOCK) >> 8 & 0xFF).astype(np.uint8)
    present = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(present) <= 16 and mode is None:
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(present) - 1, 8)
        c = np.zeros((len(present), 4), dtype=np.int32)
        c[:, 0], c[:, 2] = 255, present
        write_image(w, _packed(np.diff(c, axis=0, prepend=0)), len(present))
        lookup = np.zeros(256, dtype=np.int64)
        lookup[present] = np.arange(len(present))
        flat, across = _bundled(lookup[samples].reshape(rows, WIDTH), len(present))
        w.put(0, 1)
        write_image(w, flat, across, main=True)
        return _file(w.bytes())
    copies = _copies(samples)
    symbols = samples.astype(np.int64)
    extra_at: list[tuple[int, list[tuple[int, int]]]] = []
    far = np.zeros(N_DISTANCES, dtype=np.int64)
    if copies:
        keep = np.ones(len(samples), dtype=bool)
        for at, n, d in copies:
            keep[at + 1 : at + n] = False
            ls, le, lv = prefix_of(n)
            ds = 1 if d == 1 else 0  # codes 2 and 1: the pixel to the left, the one above
            symbols[at] = 256 + ls
            far[ds] += 1
            extra_at.append((at, [(lv, le), (ds, -1)]))
        place = np.cumsum(keep) - 1
        symbols = symbols[keep]
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no cache
    w.put(0, 1)  # one group
    codes, lengths = write_code(w, np.bincount(symbols, minlength=256 + N_LENGTHS))
    for value in (0, 0, 255 if mode is None else 0):  # a predictor leaves nothing of the opaque alpha
        only = np.zeros(256, dtype=np.int64)
        only[value] = 1
        write_code(w, only)
    far_codes, far_lengths = write_code(w, far)
    values, counts = codes[symbols], lengths[symbols]
    if extra_at:  # a copy's bits follow its symbol in one value
        for at, ((lv, le), (ds, _)) in extra_at:
            k = int(place[at])
            n = int(counts[k])
            values[k] |= (lv | int(far_codes[ds]) << le) << n
            counts[k] = n + le + int(far_lengths[ds])
    w.put_all(values, counts)
    return _file(w.bytes())


def store(payload: bytes) -> bytes:
    """A payload of a multiple of WIDTH bytes as WebP files, one after another."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    tile = WIDTH * MAX_ROWS
    return b"".join(_smallest(samples[at : at + tile]) for at in range(0, len(samples), tile))


def load(stored: bytes) -> bytes:
    return b"".join((decode_vp8l(chunk) >> 8 & 0xFF).astype(np.uint8).tobytes() for chunk in split_files(stored))


def feature_of(payload: bytes) -> str:
    """Rows, sum of the samples and samples in each eighth of the range, as numbers with colons between."""
    s = np.frombuffer(payload, dtype=np.uint8)
    return ":".join(map(str, (len(s) // WIDTH, int(s.sum(dtype=np.int64)), *np.bincount(s >> 5, minlength=8).tolist())))


def media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as lossless WebP, reads it back and describes what was read.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; with keep_media the stored bytes. A null text is empty; equal texts
    have equal values; null ids stay null; an empty table gives no row. Other columns are not read."""

    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_size(batches):
            rows = []
            for t in batch["text"]:
                raw = t.encode()
                stored = store(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                back = load(stored)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(back), *((stored,) if keep_media else ())))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["media"] if keep_media else [])])
            out.insert(0, "no_id", batch["no_id"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    slim = docs.select(*carried_id(F.col(doc_id)), text_of(text).alias("text"))
    schema = "doc_id long, no_id boolean, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return restored_id(slim.mapInPandas(run, schema + ", media binary" * keep_media))


def pixel_arrays(df: DataFrame, media: str, key: str) -> DataFrame:
    """key, width, height, pixels (ARGB, row by row) of a column of WebP files; null where the file is null, broken or lossy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_size(batches, "m", 1 << 18):
            rows = []
            for m in batch["m"]:
                try:
                    p = None if m is None else decode(bytes(m))
                except (ValueError, IndexError, struct.error):
                    p = None
                rows.append((None, None, None) if p is None else (p.shape[1], p.shape[0], p.reshape(-1).astype(np.int64)))
            out = pd.DataFrame(rows, columns=["width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})
            out.insert(0, "key", batch["k"].to_numpy())
            yield out

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(media).alias("m")).mapInPandas(run, f"key {kind}, width int, height int, pixels array<long>")
