"""Lossless WebP (VP8L, RFC 9649): a whole decoder, and a writer.

The decoder reads simple and normal prefix codes, meta prefix codes, back-references, the
colour cache and the predictor, cross-colour, subtract-green and palette transforms. The
writer makes prefix codes from counts, back-references from repeated stretches of pixels, a
colour cache, a palette (pixels of few colours are packed), predictor and cross-colour.
"""

from __future__ import annotations

import bisect
import functools
import heapq

import numpy as np

#: Fixed values of the format: order of the code length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) of distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14
#: The hash of the colour cache.
CACHE_HASH = 0x1E35A7BD
#: Pixels that a back-reference has at least, and at most.
LEAST_COPY, MOST_COPY = 16, 4096
#: Bytes of a stream that are read at once; more bits than any symbol takes with its extra bits.
WINDOW, COPIES = 4096, 64

_EIGHT = np.arange(8)
#: Extra bits of length and distance symbols; colours of a cache have none.
_EXTRA = np.array([max(0, (p - 2) >> 1) if p < 40 else 0 for p in range(24 + (1 << 11))])
_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], dtype=np.uint8)


class Bits:
    """Bits of a stream, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        i = self.at >> 3
        x = int.from_bytes(self.data[i : i + 5], "little") >> (self.at & 7)
        self.at += n
        return x & ((1 << n) - 1)

    def peek15(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 3], "little") >> (self.at & 7)) & 0x7FFF


@functools.cache
def _reversed(n: int) -> np.ndarray:
    """All numbers of n bits, with the first bit last."""
    i = np.arange(1 << n)
    return sum((i >> b & 1) << (n - 1 - b) for b in range(n))


class Code:
    """A canonical prefix code, from the lengths of its symbols."""

    def __init__(self, lengths: list[int]) -> None:
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            raise ValueError("a prefix code without symbols")
        self.symbols, self.lengths = used, lengths
        sizes = [n for n in lengths if n]
        #: Bits of every symbol if all have the same number, else None.
        self.width = 0 if self.only is not None else sizes[0] if len(used) == 1 << sizes[0] and min(sizes) == max(sizes) else None
        self._arrays: tuple[np.ndarray, np.ndarray, int] | None = None
        self._table: tuple[list[int], list[int], int] | None = None
        if self.only is None and sum([1 << (15 - n) for n in sizes]) != 1 << 15:
            raise ValueError("a prefix code that is not complete")

    @classmethod
    def single(cls, symbol: int) -> Code:
        self = cls.__new__(cls)
        self.only, self.symbols, self.lengths, self.width, self._arrays, self._table = symbol, [symbol], [], 0, None, None
        return self

    def arrays(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Symbols and their bits by the next bits of the stream, and the mask of as many bits as the longest code has."""
        if self._arrays is None:
            if self.only is not None:
                self._arrays = np.array([self.only], np.int16), np.zeros(1, np.uint8), 0
                return self._arrays
            symbols = np.array(self.symbols, np.int16)
            sizes = np.array([n for n in self.lengths if n], np.uint8)
            order = np.argsort(sizes, kind="stable")
            longest = int(sizes[order[-1]])
            many, first = 1 << (longest - sizes[order].astype(np.int64)), _reversed(longest)
            self._arrays = symbols[order].repeat(many)[first], sizes[order].repeat(many)[first], (1 << longest) - 1
        return self._arrays

    def table(self) -> tuple[list[int], list[int], int]:
        """The same as lists."""
        if self._table is None:
            symbols, sizes, mask = self.arrays()
            self._table = symbols.tolist(), sizes.tolist(), mask
        return self._table

    def read(self, bits: Bits) -> int:
        symbols, sizes, mask = self.table()
        x = bits.peek15() & mask
        bits.at += sizes[x]
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends too early")
        return symbols[x]


def read_code(bits: Bits, size: int) -> Code:
    x = bits.peek15()
    if x & 7 == 5 and bits.at + 11 <= 8 * len(bits.data):  # one symbol of 8 bits
        bits.at += 11
        return Code.single(x >> 3 & 255)
    lengths = [0] * size
    if bits.read(1):  # one or two symbols, as they are
        two = bits.read(1)
        only = bits.read(8 if bits.read(1) else 1)
        if not two:
            return Code.single(only)
        lengths[only] = lengths[bits.read(8)] = 1
        return Code(lengths)
    first = [0] * 19
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        first[k] = bits.read(3)
    code, left = Code(first), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    symbols, sizes, mask = code.table()
    data, at, x, more = bits.data, bits.at, 0, 0
    i, previous = 0, 8
    while i < size and left:
        left -= 1
        if more < 14:  # x: the next bits of the stream, more of them for certain
            x, more = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7), 57
        n, k = symbols[x & mask], sizes[x & mask]
        x >>= k
        if n < 16:
            lengths[i] = n
            previous = n or previous
            i += 1
        else:
            value, least, extra = (previous, 3, 2) if n == 16 else (0, 3, 3) if n == 17 else (0, 11, 7)
            count = least + (x & ((1 << extra) - 1))
            if i + count > size:
                raise ValueError("more code lengths than symbols")
            if value:
                lengths[i : i + count] = [value] * count
            i += count
            x >>= extra
            k += extra
        at += k
        more -= k
    if at > 8 * len(data):
        raise ValueError("the stream ends too early")
    bits.at = at
    return Code(lengths)


def _amount(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _fixed(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    """n pixels whose channels have codes of one length each: a rectangle of bits."""
    widths = [codes[c].width for c in range(4)]
    total = sum(widths)
    if bits.at + total * n > 8 * len(bits.data):
        raise ValueError("the stream ends too early")
    out = np.empty((n, 4), np.uint8)
    symbols = [np.array(codes[c].symbols, np.uint8) for c in range(4)]
    if widths == [8] * 4:
        raw = np.frombuffer(bits.data, np.uint8, (4 * n * 8 + (bits.at & 7) + 7) // 8, bits.at >> 3)
        shift = bits.at & 7
        if shift:
            low = raw[: 4 * n] >> shift
            high = np.zeros(4 * n, np.uint8)
            high[: len(raw) - 1] = raw[1 : 4 * n + 1] << (8 - shift)
            raw = low | high
        out[:] = _REVERSED[raw[: 4 * n]].reshape(n, 4)  # all bytes are symbols, in order
    else:
        lo = bits.at >> 3
        grid = np.unpackbits(np.frombuffer(bits.data, np.uint8)[lo : (bits.at + total * n + 7) >> 3], bitorder="little")[bits.at & 7 :][: total * n].reshape(n, total)
        at = 0
        for c in range(4):
            place = np.zeros(n, np.int64)
            for b in range(widths[c]):
                place = place << 1 | grid[:, at + b]
            out[:, c] = symbols[c][place]
            at += widths[c]
    bits.at += total * n
    return out[:, [1, 0, 2, 3]]  # green comes first in the stream


_ONE_GROUP = np.zeros((1, 1), np.int64)


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """height x width x 4 (red, green, blue, alpha) of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, per_block = _ONE_GROUP, 0
    if main and bits.read(1):
        per_block = bits.read(3) + 2
        wide = -(-width // (1 << per_block))
        meta = _image(bits, wide, -(-height // (1 << per_block)), False)
        groups = meta[:, :, 0].astype(np.int64) << 8 | meta[:, :, 1]
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, s) for s in sizes] for _ in range(1 if groups is _ONE_GROUP else int(groups.max()) + 1)]
    n = width * height
    if groups.size == 1 and not cache_bits and codes[0][0].width and all(codes[0][c].width is not None for c in range(4)) and codes[0][0].symbols[-1] < 256:
        return _fixed(bits, codes[0], n).reshape(height, width, 4)
    if groups.size == 1:
        return _pixels(bits, codes[0], n, width, cache_bits).reshape(height, width, 4)
    out: list[int] = []
    colours = Cache(cache_bits, out)
    while (i := len(out)) < n:
        group = codes[int(groups[(i // width) >> per_block, (i % width) >> per_block])]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[c].read(bits) for c in (1, 2, 3))
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            _copy(out, *_reference(bits, s, group[4], width), n)
        else:
            out.append(colours.get(s - 280))
    return _channels(out).reshape(height, width, 4)


class Cache:
    """The colour cache; it takes in the pixels read so far when a colour is asked for."""

    def __init__(self, bits: int, out: list[int]) -> None:
        self.shift, self.out, self.seen = 32 - bits, out, 0
        self.held = [0] * (1 << bits) if bits else []

    def get(self, place: int) -> int:
        if place >= len(self.held):
            raise ValueError("a colour that the cache cannot hold")
        held, shift = self.held, self.shift
        for v in self.out[self.seen :]:
            held[(CACHE_HASH * v & 0xFFFFFFFF) >> shift] = v
        self.seen = len(self.out)
        return held[place]


def _reference(bits: Bits, s: int, distances: Code, width: int) -> tuple[int, int]:
    """Length and distance, in pixels, of a back-reference whose first symbol is s."""
    length = _amount(bits, s - 256)
    code = _amount(bits, distances.read(bits))
    return length, code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _copy(out, length: int, back: int, n: int) -> None:
    """Lengthen a list or bytearray of pixels by what lies so far back in it."""
    if back > len(out) or len(out) + length > n:
        raise ValueError("a back-reference beyond the image")
    start = len(out) - back
    if back >= length:
        out += out[start : start + length]
    else:
        unit = out[start:]
        out += (unit * (length // back + 1))[:length]


def _channels(out: list[int]) -> np.ndarray:
    a = np.array(out, np.uint32)
    return np.stack([a >> 16 & 255, a >> 8 & 255, a & 255, a >> 24], -1).astype(np.uint8)


def _pixels(bits: Bits, group: list[Code], n: int, width: int, cache_bits: int) -> np.ndarray:
    """n pixels of an image with one group of codes."""
    others = [group[c] for c in (1, 2, 3)]
    if cache_bits or any(c.only is None for c in others):
        return _channels(_colours(bits, group, n, width, cache_bits))
    # green alone varies
    image = np.full(n, others[0].only | (group[0].only or 0) << 8 | others[1].only << 16 | others[2].only << 24, "<u4").view(np.uint8).reshape(n, 4)
    if group[0].only is None:
        image[:, 1] = np.frombuffer(_greens(bits, group, n, width), np.uint8)
    return image


def _greens(bits: Bits, group: list[Code], n: int, width: int) -> bytearray:
    """The greens of n pixels that vary in nothing else.

    What would be read is looked up at every bit of a window, and with it where the next
    symbol begins; such steps are doubled to sixteen symbols. The window is walked in strides
    of those, and the symbols in between are filled in.
    """
    data, distances = bits.data, group[4]
    symbols, sizes, mask = group[0].arrays()
    copying = symbols >= 256
    if copying.any():
        steps = np.where(copying, sizes + np.uint8(COPIES), sizes)
        far, far_sizes, far_mask = distances.arrays()
    else:
        steps = sizes
    raw = np.frombuffer(data + bytes(16), np.uint8)
    out = bytearray()
    while len(out) < n:
        base = bits.at >> 3
        many = min(WINDOW, len(data) - base)
        if many <= 0:
            raise ValueError("the stream ends too early")
        size = 8 * many
        part = raw[base : base + many + 10].astype(np.int64)
        three = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        ahead = (three[:many, None] >> _EIGHT & mask).reshape(-1)
        step = steps[ahead]
        one = np.arange(size + COPIES)  # what ends beyond the window stays there
        one[:size] += step
        if steps is not sizes:
            # a copy: extra bits of its length, its distance and the extra bits of that
            at = np.flatnonzero(step >= COPIES)
            to = one[at] - COPIES + _EXTRA[symbols[ahead[at]] - 256]
            where = three[to >> 3] >> (to & 7) & far_mask
            one[at] = to + far_sizes[where] + _EXTRA[far[where]]
        two = one[one]
        four = two[two]
        eight = four[four]
        stride = memoryview(eight[eight])
        met, i = [], bits.at & 7
        while i < size:
            met.append(i)
            i = stride[i]
        at = np.array(met)
        for jump in (eight, four, two, one):
            both = np.empty(2 * len(at), np.int64)
            both[::2], both[1::2] = at, jump[at]
            at = both
        at = at[: np.searchsorted(at, size)]
        found = symbols[ahead[at]]
        green, begin = found.astype(np.uint8).tobytes(), 0
        for end in [*(np.flatnonzero(found >= 256).tolist() if steps is not sizes else ()), len(found)]:
            took = begin + min(end - begin, n - len(out))
            out += green[begin:took]
            if len(out) == n or end == len(found):
                bits.at = 8 * base + (int(at[took]) if took < len(at) else i)
                break
            if found[end] >= 280:
                raise ValueError("a colour that the cache cannot hold")
            bits.at = 8 * base + int(at[end]) + int(sizes[ahead[at[end]]])
            _copy(out, *_reference(bits, int(found[end]), distances, width), n)
            begin = end + 1
    if bits.at > 8 * len(data):
        raise ValueError("the stream ends too early")
    return out


def _colours(bits: Bits, group: list[Code], n: int, width: int, cache_bits: int) -> list[int]:
    """n pixels as numbers: alpha, red, green, blue. Pixels from the cache stay where they are in it."""
    data = bits.data
    (greens, sizes, mask), others = group[0].table(), [(*group[c].table(), shift) for c, shift in ((1, 16), (2, 0), (3, 24))]
    fixed = sum(t[0][0] << t[3] for t in others if not t[2])
    others = [t for t in others if t[2]]
    held, down = [0] * (1 << cache_bits) if cache_bits else [], 32 - cache_bits
    out: list[int] = []
    append, at, left, x = out.append, bits.at, 0, 0
    need = 15 * (1 + len(others))
    while len(out) < n:
        if left < need:  # x: the next bits, left of them for certain; at is where it begins
            x = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
            left = 65
        i = x & mask
        s, k = greens[i], sizes[i]
        x >>= k
        if s >= 280:
            if s - 280 >= len(held):
                raise ValueError("a colour that the cache cannot hold")
            append(held[s - 280])
        elif s < 256:
            colour = s << 8 | fixed
            for table, size, m, shift in others:
                i = x & m
                colour |= table[i] << shift
                x >>= size[i]
                k += size[i]
            append(colour)
            if held:
                held[(CACHE_HASH * colour & 0xFFFFFFFF) >> down] = colour
        else:
            bits.at = at + k
            before = len(out)
            _copy(out, *_reference(bits, s, group[4], width), n)
            if held:
                for colour in out[before:]:
                    held[(CACHE_HASH * colour & 0xFFFFFFFF) >> down] = colour
            at, left = bits.at, 0
            continue
        at += k
        left -= k
    bits.at = at
    if at > 8 * len(data):
        raise ValueError("the stream ends too early")
    return out


# --- transforms --------------------------------------------------------------------------


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.view(np.int8).astype(np.int16) * c.view(np.int8) >> 5).astype(np.uint8)


def _spread(image: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return image.repeat(1 << bits, 0)[:height].repeat(1 << bits, 1)[:, :width]


def undo_cross(image: np.ndarray, elements: np.ndarray, bits: int) -> np.ndarray:
    e = np.ascontiguousarray(_spread(elements, bits, *image.shape[:2])) if elements.shape[:2] != (1, 1) else elements
    out = image.copy()
    green = np.ascontiguousarray(image[..., 1])
    red_to_blue, green_to_blue, green_to_red = (np.ascontiguousarray(e[..., c]) for c in range(3))
    red = image[..., 0] + _delta(green_to_red, green)
    out[..., 0] = red
    blue = image[..., 2] + _delta(green_to_blue, green)
    out[..., 2] = blue + _delta(red_to_blue, np.ascontiguousarray(red)) if red_to_blue.any() else blue
    return out


def _average(a, b):
    return (np.asarray(a, np.int32) + b) >> 1


def _predict(mode: int, left, top, top_right, top_left):
    """Prediction of one pixel, or of many where no left neighbour is needed."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(-1), np.abs(left - top_left).sum(-1)
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        half = mean - top_left
        return np.clip(mean + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    return np.array([0, 0, 0, 255])


def undo_predictor(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """modes: one for each block; in the format it is an image's green channel, low 4 bits."""
    height, width = image.shape[:2]
    out = image.copy()
    out[0, 0, 3:] += np.uint8(255)  # the first pixel's prediction is opaque black
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    if (modes == 2).all():
        return np.cumsum(out, axis=0, dtype=np.uint8)
    for y in range(1, height):
        row = modes[y >> bits].repeat(1 << bits)[:width]
        above, now = out[y - 1].astype(np.int32), out[y].astype(np.int32)
        now[0] = (now[0] + above[0]) & 255
        shifted = np.concatenate((above[1:], now[:1]))  # right of the last column comes this row's first pixel
        before = np.concatenate((above[:1], above[:-1]))
        if np.isin(row, (0, 2, 3, 4, 8, 9, 14, 15)).all():
            for m in np.unique(row):
                x = np.flatnonzero(row == m)
                x = x[x > 0]
                now[x] = (now[x] + _predict(int(m), None, above[x], shifted[x], before[x])) & 255
        else:
            for x in range(1, width):
                now[x] = (now[x] + _predict(int(row[x]), now[x - 1], above[x], shifted[x], before[x])) & 255
        out[y] = now
    return out


def undo_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    n = len(palette)
    bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = image[..., 1]
    if bits:
        each = 8 >> bits
        index = np.stack([index >> (k * each) & ((1 << each) - 1) for k in range(1 << bits)], -1).reshape(image.shape[0], -1)[:, :width]
    table = np.zeros((256, 4), np.uint8)
    table[:n] = palette
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """height x width x 4 pixels (red, green, blue, alpha) of a RIFF file with one VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return decode_stream(data[20 : 20 + int.from_bytes(data[16:20], "little")])


def decode_stream(stream: bytes) -> np.ndarray:
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, seen, wide = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform that is there twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            k = bits.read(3) + 2
            undo.append((kind, _image(bits, -(-wide // (1 << k)), -(-height // (1 << k)), False), k, wide))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            undo.append((kind, np.cumsum(_image(bits, n, 1, False)[0], axis=0, dtype=np.uint8), 0, wide))
            wide = -(-wide // (1 << (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0)))
        else:
            undo.append((kind, None, 0, wide))
    image = _image(bits, wide, height, True)
    for kind, extra, k, w in reversed(undo):
        if kind == PREDICTOR:
            image = undo_predictor(image, extra[:, :, 1] & 15, k)
        elif kind == CROSS:
            image = undo_cross(image, extra, k)
        elif kind == PALETTE:
            image = undo_palette(image, extra, w)
        else:
            image = image.copy()
            image[..., 0] += image[..., 1]
            image[..., 2] += image[..., 1]
    return image


# --- writing -----------------------------------------------------------------------------


class Writer:
    """Bits to write, least significant first."""

    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def only(self, symbol: int) -> None:
        """A code of one symbol, which takes no bits."""
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)


def huffman(counts: np.ndarray, longest: int = 15) -> np.ndarray:
    """Lengths of a prefix code for these counts; a single symbol has length 1."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        up, n = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            v, i = heapq.heappop(heap)
            w, j = heap[0]
            heapq.heapreplace(heap, (v + w, n))
            up[i] = up[j] = n
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[up[i]] + 1
        if max(depth) <= longest:
            out[used] = depth[: len(used)]
            return out
        weight = [w // 2 + 1 for w in weight]  # flatter


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bits of each symbol's code, first bit lowest; of no bits if there is one symbol."""
    out = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return out
    used = used[np.argsort(lengths[used], kind="stable")]
    places = 1 << (15 - lengths[used])  # of 15 bits that begin with a code; the codes follow each other
    out[used] = _reversed(15)[np.cumsum(places) - places]
    return out


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist() or [0]
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(1, 1)
        for s in used:
            w.put(s, 8)
        return
    tokens: list[tuple[int, int, int]] = []  # code length symbol, extra bits, their number
    # stretches of equal lengths
    edge = [0, *(np.flatnonzero(np.diff(lengths[: used[-1] + 1])) + 1).tolist(), used[-1] + 1]
    for lo, hi in zip(edge, edge[1:], strict=False):
        n, many = int(lengths[lo]), hi - lo
        if n:
            tokens.append((n, 0, 0))
            many -= 1
        while many:
            if n and many >= 3:
                step = min(many, 6)
                tokens.append((16, step - 3, 2))
            elif not n and many >= 11:
                step = min(many, 138)
                tokens.append((18, step - 11, 7))
            elif not n and many >= 3:
                step = min(many, 10)
                tokens.append((17, step - 3, 3))
            else:
                step = 1
                tokens.append((n, 0, 0))
            many -= step
    if len(tokens) < 2:
        tokens.append((0, 0, 0))
    first = huffman(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = canonical(first).tolist()
    sizes = first.tolist() if np.count_nonzero(first) > 1 else [0] * 19
    shown = max(4, max(i for i, k in enumerate(LENGTH_ORDER) if first[k]) + 1)
    w.put(0, 1)
    w.put(shown - 4, 4)
    for k in LENGTH_ORDER[:shown]:
        w.put(int(first[k]), 3)
    if len(lengths) > used[-1] + 1 or len(tokens) < len(lengths):
        n = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
        w.put(1, 1)
        w.put((n - 2) // 2, 3)
        w.put(len(tokens) - 2, n)
    else:
        w.put(0, 1)
    value = at = 0
    for s, extra, n in tokens:
        value |= (codes[s] | extra << sizes[s]) << at
        at += sizes[s] + n
    w.put(value, at)


def _one(symbol: int) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[symbol] = 1
    return out


def _prefixes(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distance codes."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    extra = np.maximum(top - 1, 0)
    half = v >> extra & 1
    return np.where(v < 4, v, 2 * top + half), np.where(v < 4, 0, v & ((1 << extra) - 1)), np.where(v < 4, 0, extra)


@functools.cache
def _near(width: int) -> dict[int, int]:
    """Distance codes below 121, by distance in pixels."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, x + y * width), code)
    return out


def copies(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that repeat the nearest earlier one with the same LEAST_COPY pixels."""
    n = len(argb) - LEAST_COPY + 1
    if n < 2:
        return []
    key = argb.astype(np.uint64) + np.uint64(1)
    have = 1
    while have < LEAST_COPY:  # a hash of LEAST_COPY pixels, by doubling
        key = (key[:-have] + (key[have:] ^ key[have:] >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
        have *= 2
    # sorted by 16 bits of the hash: stretches that others hide there are not found, which costs a few bytes
    order = np.argsort((key >> np.uint64(48)).astype(np.uint16), kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    before = np.full(len(key), -1)
    before[order[1:][same]] = order[:-1][same]
    raw, wide, out, end = argb.tobytes(), argb.itemsize, [], 0
    places, next_ = np.flatnonzero(before >= 0).tolist(), 0
    while (next_ := bisect.bisect_left(places, end, next_)) < len(places):
        i = places[next_]
        j, m = int(before[i]), 0
        limit = min(MOST_COPY, len(argb) - i)
        step = 64
        while m < limit and step:
            if m + step <= limit and raw[wide * (i + m) : wide * (i + m + step)] == raw[wide * (j + m) : wide * (j + m + step)]:
                m += step
            else:
                step >>= 1
        if m >= LEAST_COPY:
            out.append((i, m, i - j))
            end = i + m
        else:  # another stretch of the same hash
            end = i + 1
    return out


def _pack(code: np.ndarray, size: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """32-bit words of fields (first bit lowest) that follow each other from bit ``start`` of the first word on; and the bits in all."""
    at = np.cumsum(size) + start
    total = int(at[-1]) if len(at) else start
    at -= size
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    value = code << shift
    head = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.zeros((total >> 5) + 2, np.uint64)
    sums[word[head]] = np.add.reduceat(value, head) if len(head) else 0
    out = (sums & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out[1:] |= (sums[:-1] >> np.uint64(32)).astype(np.uint32)
    return out, total


def _put_image(w: Writer, pixels: np.ndarray, width: int, cache_bits: int = 0, references: bool = True, main: bool = True) -> bytes | None:
    """Pixels (n x 4); the whole stream's bytes if this is the main image, which comes last."""
    varies = [c for c in (0, 2, 3) if len(pixels) and (pixels[:, c] != pixels[0, c]).any()]
    if varies or cache_bits:
        argb = np.ascontiguousarray(pixels[:, [2, 1, 0, 3]]).view("<u4").reshape(-1)
    else:
        argb = np.ascontiguousarray(pixels[:, 1])
    found = copies(argb) if references else []
    literal, n = np.ones(len(argb), bool), len(argb)
    for i, m, _ in found:
        literal[i : i + m] = False
    begins = literal
    green = pixels[:, 1].astype(np.int64)
    hit = None
    if cache_bits:
        slot = ((np.uint64(CACHE_HASH) * argb.astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        again = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        hit = np.zeros(n, bool)
        hit[order[1:][again]] = True
        hit &= literal
        green[hit] = 280 + slot[hit]
    if found:
        at, length, back = np.array(found).T
        near = _near(width)
        far = np.array([near.get(d, d + 120) for d in back.tolist()])
        begins = literal.copy()
        begins[at] = True
        by_length, by_far = _prefixes(length), _prefixes(far)
        green[at] = 256 + by_length[0]
    w.put(1 if cache_bits else 0, 1)
    w.put(cache_bits, 4 if cache_bits else 0)
    if main:
        w.put(0, 1)
    direct = literal & ~hit if cache_bits else literal
    tables = [huffman(np.bincount(green[begins], minlength=280 + (1 << cache_bits if cache_bits else 0)))]
    for c in (0, 2, 3):
        tables.append(huffman(np.bincount(pixels[direct, c], minlength=256)) if c in varies else _one(int(pixels[0, c])))
    tables.append(huffman(np.bincount(by_far[0], minlength=40)) if found else np.zeros(40, np.int64))
    for t in tables:
        _put_code(w, t)
    many = [np.count_nonzero(t) > 1 for t in tables]  # a single symbol takes no bits
    # fields of the stream in order: one for a cached colour, one for each varying channel of a literal, four for a copy
    more = [(k, c) for k, c in ((1, 0), (2, 2), (3, 3)) if many[k]]
    fields = np.zeros(n, np.int64)
    fields[begins] = 1
    if more:
        fields[direct] = 1 + len(more)
    if found:
        fields[at] = 4
    first = np.cumsum(fields)
    total = int(first[-1]) if n else 0
    first -= fields
    code, size = np.zeros(total, np.uint64), np.zeros(total, np.int64)
    if many[0]:
        to, of = first[begins], green[begins]
        code[to], size[to] = canonical(tables[0])[of], tables[0][of]
    for k, (t, c) in enumerate(more, 1):
        to, of = first[direct] + k, pixels[direct, c]
        code[to], size[to] = canonical(tables[t])[of], tables[t][of]
    if found:
        to = first[at]
        code[to + 1], size[to + 1] = by_length[1], by_length[2]
        code[to + 3], size[to + 3] = by_far[1], by_far[2]
        if many[4]:
            code[to + 2], size[to + 2] = canonical(tables[4])[by_far[0]], tables[4][by_far[0]]
    if not all(many[:1]) or found:
        some = size > 0
        code, size = code[some], size[some]
    if not main:
        for c, k in zip(code.tolist(), size.tolist(), strict=True):
            w.put(c, k)
        return None
    whole, spare = divmod(w.n, 32)
    head = w.value.to_bytes(4 * whole + 4, "little")
    words, total = _pack(code, size, spare)
    words[0] |= np.uint32(int.from_bytes(head[4 * whole :], "little"))
    return head[: 4 * whole] + words.tobytes()[: -(-total // 8)]


def write(image: np.ndarray, predictor: bool = False, cross: tuple[int, int, int] | None = None, palette: bool = False, cache_bits: int = 0, references: bool = True) -> bytes:
    """A lossless WebP file of height x width x 4 pixels.

    predictor: every pixel from the one above; cross: multipliers of cross-colour, green to
    red, green to blue and red to blue; palette: of an image of up to 256 colours.
    """
    height, width = image.shape[:2]
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ValueError("an image has 1 to 16384 rows and columns")
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    if predictor:
        rest = np.empty_like(image)
        rest[1:] = image[1:] - image[:-1]
        rest[0, 1:] = image[0, 1:] - image[0, :-1]
        rest[0, 0] = image[0, 0] - np.array([0, 0, 0, 255], np.uint8)
        image = rest
        _put_transform(w, PREDICTOR, (0, 2, 0, 255))
    if cross:
        green, red = np.ascontiguousarray(image[..., 1]), np.ascontiguousarray(image[..., 0])
        to = [np.array([m], np.uint8) for m in cross]
        image = image.copy()
        image[..., 0] = red - _delta(to[0], green)
        image[..., 2] -= _delta(to[1], green) + _delta(to[2], red) if cross[2] else _delta(to[1], green)
        _put_transform(w, CROSS, (cross[2], cross[1], cross[0], 255))
    if palette:
        colours, index = np.unique(np.ascontiguousarray(image).view(np.uint32).reshape(-1), return_inverse=True)
        if len(colours) > 256:
            raise ValueError("a palette has up to 256 colours")
        table = colours.view(np.uint8).reshape(-1, 4)
        w.put(1, 1)
        w.put(PALETTE, 2)
        w.put(len(table) - 1, 8)
        _put_image(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)), len(table), references=False, main=False)
        bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        each = 8 >> bits
        grid = np.zeros((height, -(-width // (1 << bits)) << bits), np.uint8)
        grid[:, :width] = index.reshape(height, width)
        packed = np.zeros((height, grid.shape[1] >> bits), np.uint8)
        for k in range(1 << bits):
            packed |= grid[:, k :: 1 << bits] << (k * each)
        width = packed.shape[1]
        image = np.zeros((height, width, 4), np.uint8)
        image[..., 1], image[..., 3] = packed, 255
    w.put(0, 1)  # no more transforms
    stream = _put_image(w, image.reshape(-1, 4), width, cache_bits, references)
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def _put_transform(w: Writer, kind: int, pixel: tuple[int, int, int, int]) -> None:
    """A transform with one setting (red, green, blue, alpha) for all blocks: its image has one colour and takes no bits."""
    w.put(1, 1)
    w.put(kind, 2)
    w.put(7, 3)  # blocks of 512 x 512
    w.put(0, 1)
    for symbol in (pixel[1], pixel[0], pixel[2], pixel[3], 0):
        w.only(symbol)
