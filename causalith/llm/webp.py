"""Lossless WebP images: a decoder for whole batches, and an encoder for payload bytes.

The decoder advances all images of a batch together, one symbol of each per step, so every step is an operation on
arrays: bit windows, prefix-code tables and pixels of all images. Images whose headers differ (transforms, colour cache,
meta prefix codes) part into groups that go on together. It covers the format: prefix codes in both notations, meta
prefix codes, back-references with the two-dimensional distance map, colour cache, and the four transforms with
palettes of bundled pixels.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
#: The order in which the lengths of the code-length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: The neighbours (x to the left, y up) that the distance codes 1 to 120 stand for.
NEIGHBOURS = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_FACTOR = np.uint32(0x1E35A7BD)
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
_CODES = 5  # green with lengths and cache, red, blue, alpha, distance


class Bits:
    """The bit streams of many images, each read at its own place, least significant bit first."""

    def __init__(self, streams: list[bytes]):
        self.data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
        sizes = np.array([len(s) for s in streams], np.int64)
        self.at = (np.cumsum(sizes) - sizes) * 8
        self.windows = np.ndarray((len(self.data) - 8,), "<u8", self.data, strides=(1,))

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits or more from each place."""
        return self.windows[np.minimum(at >> 3, len(self.windows) - 1)] >> (at & 7).astype(np.uint64)

    def read(self, which: np.ndarray, n) -> np.ndarray:
        """The next ``n`` bits (one number or one for each) of some images."""
        n = np.broadcast_to(np.asarray(n, np.int64), which.shape)
        at = self.at[which]
        self.at[which] = at + n
        return (self.peek(at) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)


def _groups(*columns):
    """Parts of the images that agree in all columns: values and positions."""
    rows = np.stack(columns, 1)
    values, back = np.unique(rows, axis=0, return_inverse=True)
    return [(tuple(v.tolist()), np.flatnonzero(back.ravel() == i)) for i, v in enumerate(values)]


def canonical_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each row ordered by code length and value, and their lengths; unused ones come last with length 0."""
    key = np.where(lengths > 0, lengths, 99)
    order = np.argsort(key, axis=1, kind="stable")
    return order, np.take_along_axis(lengths, order, 1)


def _reversed(bits: int) -> np.ndarray:
    x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for k in range(bits):
        out |= ((x >> k) & 1) << (bits - 1 - k)
    return out


def tables(lengths: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, int]:
    """Decoding tables of many prefix codes: entry ``row << bits | next bits`` is ``symbol << 4 | length``.

    ``single``: the only symbol of codes that have one, which take no bits; else -1.
    """
    bits = int(lengths.max(initial=0))
    if (single >= 0).any():
        lengths = lengths.copy()
        lengths[single >= 0] = 0
        bits = int(lengths.max(initial=0))
    m = len(lengths)
    out = np.zeros((m, 1 << bits), np.uint16)
    many = np.flatnonzero(single < 0)
    if len(many):
        order, sorted_lengths = canonical_order(lengths[many])
        span = np.where(sorted_lengths > 0, 1 << (bits - sorted_lengths), 0)
        full = span.sum(1)
        if (full != 1 << bits).any():
            raise ValueError("a prefix code is not complete")
        entry = ((order << 4) | sorted_lengths).astype(np.uint16)
        out[many] = np.repeat(entry.ravel(), span.ravel()).reshape(len(many), -1)[:, _reversed(bits)]
    one = np.flatnonzero(single >= 0)
    out[one] = (single[one] << 4).astype(np.uint16)[:, None]
    return out.ravel(), bits


class Decoder:
    def __init__(self, streams: list[bytes]):
        self.bits = Bits(streams)

    def code(self, which: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """The next prefix code of some images: lengths of all symbols, and the only symbol or -1."""
        read = self.bits.read
        lengths, single = np.zeros((len(which), symbols), np.int64), np.full(len(which), -1)
        simple = read(which, 1) == 1
        rows = np.flatnonzero(simple)
        if len(rows):
            w = which[rows]
            two, wide = read(w, 1) == 1, read(w, 1)
            first = read(w, 1 + 7 * wide)
            single[rows] = first
            pair = np.flatnonzero(two)
            if len(pair):
                second = read(w[pair], 8)
                single[rows[pair]] = -1
                lengths[rows[pair], first[pair]] = 1
                lengths[rows[pair], second] = 1
                same = pair[first[pair] == second]
                single[rows[same]] = first[same]
        rows = np.flatnonzero(~simple)
        if len(rows):
            lengths[rows] = self._normal(which[rows], symbols)
            used = (lengths[rows] > 0).sum(1)
            only = rows[used == 1]
            single[only] = lengths[only].argmax(1)
            single[rows[used == 0]] = 0
        return lengths, single

    def _normal(self, which: np.ndarray, symbols: int) -> np.ndarray:
        read, n = self.bits.read, len(which)
        stored = 4 + read(which, 4)
        small = np.zeros((n, 19), np.int64)
        for k in range(19):
            rows = np.flatnonzero(stored > k)
            if len(rows):
                small[rows, LENGTH_ORDER[k]] = read(which[rows], 3)
        used = (small > 0).sum(1)
        table, bits = tables(small, np.where(used == 1, small.argmax(1), -1))
        limited = read(which, 1) == 1
        left = np.full(n, symbols)
        rows = np.flatnonzero(limited)
        if len(rows):
            left[rows] = 2 + read(which[rows], 2 + 2 * read(which[rows], 3))
        # One place more than the symbols takes what codes beyond the end would write.
        lengths, at, last = np.zeros((n, symbols + 1), np.int64), np.zeros(n, np.int64), np.full(n, 8)
        rows = np.flatnonzero((at < symbols) & (left > 0))
        while len(rows):
            w = which[rows]
            pos = self.bits.at[w]
            window = self.bits.peek(pos)
            entry = table[(rows << bits) + (window & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.int64)
            symbol, took = entry >> 4, entry & 15
            window = (window >> took.astype(np.uint64)).astype(np.int64)
            plain = symbol < 16
            extra = np.where(plain, 0, np.where(symbol == 16, 2, np.where(symbol == 17, 3, 7)))
            repeat = np.where(plain, 1, (window & ((1 << extra) - 1)) + np.where(symbol == 18, 11, 3))
            value = np.where(plain, symbol, np.where(symbol == 16, last[rows], 0))
            self.bits.at[w] = pos + took + extra
            last[rows] = np.where(plain & (symbol > 0), symbol, last[rows])
            set_ = np.flatnonzero(value > 0)
            if len(set_):
                r, count = rows[set_], np.minimum(repeat[set_], symbols - at[rows[set_]])
                ends = np.cumsum(count)
                places = np.repeat(at[r] - (ends - count), count) + np.arange(ends[-1])
                lengths[np.repeat(r, count), places] = np.repeat(value[set_], count)
            at[rows] += repeat
            left[rows] -= 1
            rows = rows[(at[rows] < symbols) & (left[rows] > 0)]
        return lengths[:, :symbols]

    def pixels(self, which: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray]:
        """The entropy-coded pixels of some images, each a flat array of 32-bit ARGB values."""
        read = self.bits.read
        out: list[np.ndarray | None] = [None] * len(which)
        cached = read(which, 1)
        cache = np.zeros(len(which), np.int64)
        rows = np.flatnonzero(cached == 1)
        if len(rows):
            cache[rows] = read(which[rows], 4)
        meta = read(which, 1) if main else np.zeros(len(which), np.int64)
        for (cache_bits, has_meta), rows in _groups(cache, meta):
            w, x, y = which[rows], width[rows], height[rows]
            shift, images = np.zeros(len(rows), np.int64), None
            count = np.ones(len(rows), np.int64)
            if has_meta:
                shift = read(w, 3) + 2
                images = [(p >> 8) & 0xFFFF for p in self.pixels(w, (x + (1 << shift) - 1) >> shift, (y + (1 << shift) - 1) >> shift, False)]
                count = np.array([int(p.max()) + 1 for p in images])
            codes = self._code_groups(w, count, cache_bits)
            for r, p in zip(rows, self._symbols(w, x, x * y, cache_bits, codes, count, shift, images), strict=True):
                out[r] = p
        return out

    def _code_groups(self, which: np.ndarray, count: np.ndarray, cache_bits: int):
        """The tables of all code groups of all images; an image's groups follow each other."""
        sizes = [256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
        first = np.cumsum(count) - count
        total = int(count.sum())
        lengths = [np.zeros((total, s), np.int64) for s in sizes]
        single = [np.full(total, -1) for _ in sizes]
        for g in range(int(count.max())):
            rows = np.flatnonzero(count > g)
            for c, size in enumerate(sizes):
                lengths[c][first[rows] + g], single[c][first[rows] + g] = self.code(which[rows], size)
        return [tables(x, s) for x, s in zip(lengths, single, strict=True)]

    def _symbols(self, which, width, total, cache_bits, codes, count, shift, images):
        bits = self.bits
        ends = np.cumsum(total)
        out = np.zeros(int(ends[-1]), np.uint32)
        p, end = ends - total, ends.copy()
        first_group = np.cumsum(count) - count
        if images is not None:
            meta, meta_first = np.concatenate(images), np.cumsum([0] + [len(i) for i in images[:-1]])
            meta_width = (width + (1 << shift) - 1) >> shift
        cache = np.zeros((len(which), 1 << cache_bits), np.uint32) if cache_bits else None
        (tg, bg), (tr, br), (tb, bb), (ta, ba), (td, bd) = codes
        mask = lambda n: np.uint64((1 << n) - 1)
        mg, mr, mb, ma = mask(bg), mask(br), mask(bb), mask(ba)
        live = np.arange(len(which))
        pos, at, stop, group = bits.at[which], p.copy(), end, first_group
        start = at.copy()
        four = np.uint64(15)
        zero = np.uint64(0)

        def step(table, n, m, g, window):
            e = table[(g << n) + (window & m).astype(np.int64)]
            return e >> 4, window >> (e & 15).astype(np.uint64), e & 15

        while True:
            done = at >= stop
            if done.any():
                bits.at[which[live[done]]] = pos[done]
                keep = ~done
                live, pos, at, stop, group, start = (v[keep] for v in (live, pos, at, stop, group, start))
            if not len(live):
                break
            g = group
            if images is not None:
                q = at - start
                s = shift[live]
                g = group + meta[meta_first[live] + (q // width[live] >> s) * meta_width[live] + (q % width[live] >> s)]
            window = bits.windows[pos >> 3] >> (pos & 7).astype(np.uint64)
            green, window, used = step(tg, bg, mg, g, window)
            literal = green < 256
            if literal.all():
                red, window, n = step(tr, br, mr, g, window)
                used = used + n
                blue, window, n = step(tb, bb, mb, g, window)
                used = used + n
                alpha, window, n = step(ta, ba, ma, g, window)
                used = used + n
                value = (alpha.astype(np.uint32) << 24) | (red.astype(np.uint32) << 16) | (green.astype(np.uint32) << 8) | blue
                out[at] = value
                pos += used
                if cache is not None:
                    cache[live, (value * CACHE_FACTOR) >> np.uint32(32 - cache_bits)] = value
                at += 1
                continue
            rows = np.flatnonzero(literal)
            if len(rows):
                gg, win = g[rows], window[rows]
                red, win, n1 = step(tr, br, mr, gg, win)
                blue, win, n2 = step(tb, bb, mb, gg, win)
                alpha, win, n3 = step(ta, ba, ma, gg, win)
                value = (alpha.astype(np.uint32) << 24) | (red.astype(np.uint32) << 16) | (green[rows].astype(np.uint32) << 8) | blue
                out[at[rows]] = value
                pos[rows] += (used[rows] + n1 + n2 + n3).astype(np.int64)
                if cache is not None:
                    cache[live[rows], (value * CACHE_FACTOR) >> np.uint32(32 - cache_bits)] = value
                at[rows] += 1
            rows = np.flatnonzero(green >= 280)
            if len(rows):
                value = cache[live[rows], green[rows].astype(np.int64) - 280]
                out[at[rows]] = value
                pos[rows] += used[rows]
                cache[live[rows], (value * CACHE_FACTOR) >> np.uint32(32 - cache_bits)] = value
                at[rows] += 1
            rows = np.flatnonzero(~literal & (green < 280))
            if len(rows):
                place = pos[rows] + used[rows]
                length, place = self._number(green[rows].astype(np.int64) - 256, place)
                e = td[(g[rows] << bd) + (bits.peek(place) & mask(bd)).astype(np.int64)].astype(np.int64)
                code, place = self._number(e >> 4, place + (e & 15))
                near = np.array(NEIGHBOURS)[np.minimum(code, 120) - 1]
                distance = np.where(code > 120, code - 120, np.maximum(near[:, 0] + near[:, 1] * width[live[rows]], 1))
                pos[rows] = place
                for r, n, d in zip(rows.tolist(), np.minimum(length, stop[rows] - at[rows]).tolist(), distance.tolist(), strict=True):
                    a = int(at[r])
                    if a - d < start[r]:
                        raise ValueError("a back-reference points before the image")
                    source = out[a - d : a - d + min(n, d)]
                    out[a : a + n] = source if n <= d else np.resize(source, n)
                    if cache is not None:
                        copied = out[a : a + n]
                        cache[live[r], (copied * CACHE_FACTOR) >> np.uint32(32 - cache_bits)] = copied
                    at[r] = a + n
        return np.split(out, ends[:-1])

    def _number(self, prefix: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and distances: a prefix and extra bits."""
        extra = np.maximum(prefix - 2, 0) >> 1
        more = (self.bits.peek(place) & ((np.uint64(1) << extra.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + more + 1), place + extra

    def images(self, which: np.ndarray, width: np.ndarray, height: np.ndarray, seen: tuple = ()) -> list[np.ndarray]:
        """The images after their transforms, flat ARGB."""
        out: list[np.ndarray | None] = [None] * len(which)
        kind = self.bits.read(which, 1)
        rows = np.flatnonzero(kind == 1)
        kind[:] = -1
        if len(rows):
            kind[rows] = self.bits.read(which[rows], 2)
        for (k,), rows in _groups(kind):
            w, x, y = which[rows], width[rows], height[rows]
            if k < 0:
                found = self.pixels(w, x, y, True)
            elif k == SUBTRACT_GREEN:
                found = [add_green(p) for p in self.images(w, x, y)]
            elif k == PALETTE:
                size = 1 + self.bits.read(w, 8)
                deltas = self.pixels(w, size, np.ones(len(w), np.int64), False)
                pack = np.where(size <= 2, 3, np.where(size <= 4, 2, np.where(size <= 16, 1, 0)))
                inner = self.images(w, (x + (1 << pack) - 1) >> pack, y)
                found = [unpalette(p, palette(d), int(b), int(a), int(h)) for p, d, b, a, h in zip(inner, deltas, pack, x, y, strict=True)]
            else:
                shift = 2 + self.bits.read(w, 3)
                side = self.pixels(w, (x + (1 << shift) - 1) >> shift, (y + (1 << shift) - 1) >> shift, False)
                undo = unpredict if k == PREDICTOR else uncross
                found = [undo(p, s, int(b), int(a), int(h)) for p, s, b, a, h in zip(self.images(w, x, y), side, shift, x, y, strict=True)]
            for r, p in zip(rows, found, strict=True):
                out[r] = p
        return out


def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha


def add_green(p: np.ndarray) -> np.ndarray:
    c = _channels(p).copy()
    c[:, 0] += c[:, 1]
    c[:, 2] += c[:, 1]
    return c.view("<u4").ravel()


def palette(deltas: np.ndarray) -> np.ndarray:
    """Colours are stored as differences, channel by channel."""
    return np.cumsum(_channels(deltas), axis=0, dtype=np.uint8).view("<u4").ravel()


def unpalette(p: np.ndarray, colours: np.ndarray, pack: int, width: int, height: int) -> np.ndarray:
    index = ((p >> 8) & 255).astype(np.int64).reshape(height, -1)
    if pack:
        each = 8 >> pack
        index = (index[:, :, None] >> (each * np.arange(1 << pack))) & ((1 << each) - 1)
        index = index.reshape(height, -1)[:, :width]
    # An index beyond the palette is transparent black.
    return np.append(colours, np.zeros(256, np.uint32))[index.ravel()]


def _per_pixel(side: np.ndarray, shift: int, width: int, height: int) -> np.ndarray:
    across = (width + (1 << shift) - 1) >> shift
    return side[((np.arange(height) >> shift) * across)[:, None] + (np.arange(width) >> shift)]


def uncross(p: np.ndarray, side: np.ndarray, shift: int, width: int, height: int) -> np.ndarray:
    m = _channels(_per_pixel(side, shift, width, height).ravel()).view(np.int8).astype(np.int64)
    c = _channels(p).astype(np.int64)
    signed = lambda v: ((v & 255) ^ 128) - 128
    red = (c[:, 2] + (m[:, 0] * signed(c[:, 1]) >> 5)) & 255
    blue = (c[:, 0] + (m[:, 1] * signed(c[:, 1]) >> 5) + (m[:, 2] * signed(red) >> 5)) & 255
    c[:, 0], c[:, 2] = blue, red
    return c.astype(np.uint8).view("<u4").ravel()


def predicted(mode: np.ndarray, left, top, top_left, top_right) -> np.ndarray:
    """The 14 predictors on rows of channels (int64), each row by its own mode; modes 14 and 15 are mode 0."""
    half = lambda a, b: (a + b) >> 1
    clip = lambda v: np.clip(v, 0, 255)
    black = np.array([0, 0, 0, 255])
    average = half(left, top)
    difference = average - top_left
    gradient = left + top - top_left
    to_left, to_top = np.abs(gradient - left).sum(1), np.abs(gradient - top).sum(1)
    choices = [
        np.broadcast_to(black, left.shape), left, top, top_right, top_left,
        half(half(left, top_right), top), half(left, top_left), average, half(top_left, top), half(top, top_right),
        half(half(left, top_left), half(top, top_right)), np.where((to_left < to_top)[:, None], left, top),
        clip(gradient), clip(average + np.where(difference < 0, -(-difference >> 1), difference >> 1)),
    ]
    out = np.zeros_like(left)
    for k, c in enumerate(choices):
        rows = mode == k if k else (mode == 0) | (mode > 13)
        out[rows] = c[rows]
    return out


def unpredict(p: np.ndarray, side: np.ndarray, shift: int, width: int, height: int) -> np.ndarray:
    """Pixels with the same x + 2 y need only earlier ones, so they are done together."""
    c = _channels(p).astype(np.int64).reshape(height, width, 4)
    mode = ((_per_pixel(side, shift, width, height) >> 8) & 15).astype(np.int64)
    c[0, 0] = (c[0, 0] + [0, 0, 0, 255]) & 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    c[:, 0] = np.cumsum(c[:, 0], axis=0) & 255
    flat = c.reshape(-1, 4)
    for t in range(3, width + 2 * height):
        y = np.arange(max(1, (t - width + 2) // 2), min(height - 1, (t - 1) // 2) + 1)
        x = t - 2 * y
        ok = (x >= 1) & (x < width)
        y, x = y[ok], x[ok]
        if not len(y):
            continue
        i = y * width + x
        # The pixel after the last of the row above is the first of this row.
        flat[i] = (flat[i] + predicted(mode[y, x], flat[i - 1], flat[i - width], flat[i - width - 1], flat[i - width + 1])) & 255
    return flat.astype(np.uint8).view("<u4").ravel()


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Pixel arrays (height, width, 4: red, green, blue, alpha) of lossless WebP files."""
    streams, width, height = [], [], []
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or f[20] != SIGNATURE:
            raise ValueError("not a lossless WebP file")
        size = struct.unpack_from("<I", f, 16)[0]
        (head,) = struct.unpack_from("<I", f, 21)
        if head >> 29:
            raise ValueError("unknown version")
        width.append((head & 0x3FFF) + 1)
        height.append((head >> 14 & 0x3FFF) + 1)
        streams.append(f[25 : 20 + size])
    if not files:
        return []
    w, h = np.array(width), np.array(height)
    found = Decoder(streams).images(np.arange(len(files)), w, h)
    return [_channels(p)[:, [2, 1, 0, 3]].reshape(b, a, 4) for p, a, b in zip(found, width, height, strict=True)]


# The encoder.

#: The longest prefix code that the encoder uses: three of them and a shift fit 64 bits.
LONGEST = 11


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete prefix codes of at most ``LONGEST`` bits for rows of counts with two or more used symbols.

    Lengths start as -log2 of the frequencies, rounded up. Rows whose codes do not fit lengthen their rarer symbols; then
    what is left free goes to the symbols in order of their counts.
    """
    used = counts > 0
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    with np.errstate(divide="ignore"):
        length = np.where(used, np.clip(np.ceil(-np.log2(counts / total)), 1, LONGEST), 0).astype(np.int64)
    room = (1 << LONGEST) - np.where(used, 1 << (LONGEST - length), 0).sum(1)
    order = np.argsort(-counts, axis=1, kind="stable")
    most = int(used.sum(1).max(initial=0))
    rows = np.arange(len(counts))
    while (room < 0).any():
        for k in range(most - 1, -1, -1):
            s = order[:, k]
            l = length[rows, s]  # noqa: E741
            go = (room < 0) & (l > 0) & (l < LONGEST)
            room += np.where(go, 1 << np.maximum(LONGEST - l - 1, 0), 0)
            length[rows, s] = l + go
    while (room > 0).any():
        for k in range(most):
            s = order[:, k]
            l = length[rows, s]  # noqa: E741
            cost = 1 << (LONGEST - l)
            go = (l > 1) & (cost <= room)
            room -= np.where(go, cost, 0)
            length[rows, s] = l - go
    return length


def code_words(length: np.ndarray) -> np.ndarray:
    """The canonical codes of rows of lengths, with their first bit lowest."""
    order, sorted_lengths = canonical_order(length)
    span = np.where(sorted_lengths > 0, 1 << (LONGEST - sorted_lengths), 0)
    high = np.cumsum(span, 1) - span
    words = np.zeros_like(length)
    np.put_along_axis(words, order, _reversed(LONGEST)[np.minimum(high, (1 << LONGEST) - 1)], 1)
    return np.where(length > 0, words, 0)


#: Bits of the code-length code that the encoder always writes: it is complete.
_SMALL = {**dict.fromkeys(range(12), 4), 16: 4, 17: 4, 18: 3}
_SMALL_LENGTHS = np.array([[_SMALL.get(s, 0) for s in range(19)]])


def _small_words() -> np.ndarray:
    order, lengths = canonical_order(_SMALL_LENGTHS)
    out, code, last = np.zeros(19, np.int64), 0, 0
    for s, n in zip(order[0].tolist(), lengths[0].tolist(), strict=True):
        if n:
            code <<= n - last
            out[s] = int(format(code, f"0{n}b")[::-1], 2)
            code, last = code + 1, n
    return out


_SMALL_WORDS = _small_words()


class Fields:
    """Bit fields of many images: value, width, image and place in its stream."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, image, stage: int, value, width) -> None:
        image = np.asarray(image, np.int64)
        self.parts.append((image, np.full(len(image), stage), np.broadcast_to(np.asarray(value, np.uint64), image.shape), np.broadcast_to(np.asarray(width, np.int64), image.shape)))

    def streams(self, images: int) -> list[bytes]:
        """Each image's fields by stage, in the order in which they were added, as bytes."""
        image, stage, value, width = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        stages = int(stage.max()) + 1
        order = np.argsort(image * stages + stage, kind="stable")
        image, value, width = image[order], value[order], width[order]
        size = np.bincount(image, width, images).astype(np.int64)
        bytes_ = (size + 7) // 8
        first = np.cumsum(bytes_) - bytes_
        before = np.cumsum(width) - width
        at = before - (np.cumsum(size) - size)[image] + 8 * first[image]
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        moved = value << shift
        n = int(bytes_.sum()) // 4 + 3
        # Bits of different fields never meet, so sums are unions, and doubles hold 32 bits exactly.
        low = np.bincount(word, (moved & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        high = np.bincount(word + 1, (moved >> np.uint64(32)).astype(np.float64), n)
        raw = (low + high).astype("<u4").tobytes()
        return [raw[a : a + b] for a, b in zip(first.tolist(), bytes_.tolist(), strict=True)]


def _write_code(fields: Fields, stage: int, length: np.ndarray, single: np.ndarray) -> None:
    """A prefix code of each image: the simple notation for a single symbol, else lengths with runs of zeros."""
    one = np.flatnonzero(single >= 0)
    fields.add(one, stage, 0b101 | (single[one] << 3), 11)
    many = np.flatnonzero(single < 0)
    if not len(many):
        return
    stored = 19
    fields.add(many, stage, (stored - 4) << 1, 5)
    for s in LENGTH_ORDER[:stored]:
        fields.add(many, stage, _SMALL.get(s, 0), 3)
    fields.add(many, stage, 0, 1)
    flat = length[many].ravel()
    size = length.shape[1]
    image = np.repeat(many, size)
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] > 0) | (flat[:-1] > 0)
    new[::size] = True
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(flat)))
    zero = flat[first] == 0
    # A run of zeros is stored as runs of up to 138 and a rest of up to 10.
    pieces = size // 138 + 1
    value, width, owner, place = [], [], [], []

    def put(which, v, n, order):
        owner.append(image[first[which]])
        place.append(first[which] * (pieces + 3) + order)
        value.append(np.broadcast_to(v, which.shape).astype(np.uint64))
        width.append(np.broadcast_to(n, which.shape))

    put(np.flatnonzero(~zero), _SMALL_WORDS[flat[first[~zero]]], 4, 0)
    z = np.flatnonzero(zero)
    rest = run[z].copy()
    for k in range(pieces):
        go = rest >= 11
        n = np.minimum(rest[go], 138)
        put(z[go], _SMALL_WORDS[18] | ((n - 11) << 3), 10, k)
        rest[go] -= n
    go = rest >= 3
    put(z[go], _SMALL_WORDS[17] | ((rest[go] - 3) << 4), 7, pieces)
    rest[go] = 0
    for k in range(2):
        put(z[rest > k], _SMALL_WORDS[0], 4, pieces + 1 + k)
    place, owner, value, width = (np.concatenate(x) for x in (place, owner, value, width))
    order = np.argsort(place, kind="stable")
    fields.add(owner[order], stage, value[order], width[order])


#: Bits of the colour cache of images that gain by one.
CACHE_BITS = 10


def _slots(colour: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of pixels in their images' colour caches, and whether each finds its colour there."""
    slot = ((colour * CACHE_FACTOR) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    key = image << CACHE_BITS | slot
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = (key[order[1:]] == key[order[:-1]]) & (colour[order[1:]] == colour[order[:-1]])
    hit = np.zeros(len(key), bool)
    hit[order] = same
    return slot, hit


def _bits(symbol: np.ndarray, image: np.ndarray, images: int, size: int) -> np.ndarray:
    """About how many bits each image's symbols take, with those of their code: 8 for each symbol that occurs."""
    key, count = np.unique(image * size + symbol, return_counts=True)
    owner, total = key // size, np.bincount(image, minlength=images)
    return np.bincount(owner, 8 + count * -np.log2(count / total[owner]), images)


def gains_by_cache(rgb: np.ndarray, image: np.ndarray, images: int) -> np.ndarray:
    """Which images are smaller with a colour cache, judged by the entropies of their symbols."""
    slot, hit = _slots(rgb[:, 0].astype(np.uint32) << 16 | rgb[:, 1].astype(np.uint32) << 8 | rgb[:, 2] | np.uint32(0xFF000000), image)
    miss = ~hit
    plain = sum(_bits(rgb[:, c].astype(np.int64), image, images, 256) for c in range(3))
    cached = _bits(np.where(hit, 280 + slot, rgb[:, 1]), image, images, 280 + (1 << CACHE_BITS))
    return plain > cached + sum(_bits(rgb[miss, c].astype(np.int64), image[miss], images, 256) for c in (0, 2))


def encode_rgb(data: np.ndarray, height: np.ndarray, width: int, cache: bool | None = None) -> list[bytes]:
    """Lossless WebP files of images of one width, given as RGB bytes one after the other.

    Runs of equal pixels become back-references to the pixel before; each image has prefix codes of its own, and a colour
    cache if it is smaller with one (or for all or none, if ``cache`` says so).
    """
    height = np.asarray(height, np.int64)
    pixels = height * width
    rgb, image = data.reshape(-1, 3), np.repeat(np.arange(len(height)), pixels)
    chosen = gains_by_cache(rgb, image, len(height)) if cache is None else np.full(len(height), cache)
    out: list[bytes] = [b""] * len(height)
    for cached in (False, True):
        some = np.flatnonzero(chosen == cached)
        if len(some):
            for k, file in zip(some.tolist(), _encode(rgb[chosen[image] == cached], height[some], width, cached), strict=True):
                out[k] = file
    return out


def _encode(rgb: np.ndarray, height: np.ndarray, width: int, cached: bool) -> list[bytes]:
    images = len(height)
    pixels = height * width
    image = np.repeat(np.arange(images), pixels)
    joined = rgb[:, 0].astype(np.uint32) << 16 | rgb[:, 1].astype(np.uint32) << 8 | rgb[:, 2]
    begin = np.ones(len(joined), bool)
    begin[1:] = joined[1:] != joined[:-1]
    begin[np.cumsum(pixels) - pixels] = True
    first = np.flatnonzero(begin)
    run = np.diff(np.append(first, len(joined)))
    # A run is its first pixel and, from 4 pixels on, a copy of length run - 1 (in pieces of 4096); shorter ones are pixels.
    long_ = np.flatnonzero(run >= 4)
    literal = np.ones(len(joined), bool)
    skip = run[long_] - 1
    literal[np.repeat(first[long_] + 1 - (np.cumsum(skip) - skip), skip) + np.arange(int(skip.sum()))] = False
    at = np.flatnonzero(literal)
    pieces = -(-skip // 4096)
    copy_at = np.repeat(first[long_] + 1, pieces)
    piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    copy_length = np.minimum(np.repeat(skip, pieces) - 4096 * piece, 4096)
    copy_at = copy_at + 4096 * piece
    value = copy_length - 1
    extra = np.maximum(np.floor(np.log2(np.maximum(value, 1))).astype(np.int64) - 1, 0)
    prefix = np.where(value < 4, value, 2 * extra + 2 + ((value >> extra) & 1))
    more = np.where(value < 4, 0, value & ((1 << extra) - 1))
    extra = np.where(value < 4, 0, extra)
    owner, copy_owner = image[at], image[copy_at]
    fields = Fields()
    every = np.arange(images)
    # No transform; no or a colour cache; no meta prefix codes.
    fields.add(every, 0, 0b10 | CACHE_BITS << 2 if cached else 0, 7 if cached else 3)
    # Copied pixels have the colour of the one before, so they leave the cache as it is.
    greens = 280 + (1 << CACHE_BITS if cached else 0)
    slot, hit = _slots(joined[at] | np.uint32(0xFF000000), owner) if cached else (0, np.zeros(len(at), bool))
    miss = ~hit
    green = np.where(hit, 280 + slot, rgb[at, 1].astype(np.int64))
    words, lengths = [], []
    for stage, (channel, size) in enumerate(((1, greens), (0, 256), (2, 256)), 1):
        if channel == 1:
            counts = np.bincount(np.concatenate([owner * size + green, copy_owner * size + 256 + prefix]), minlength=images * size)
        else:
            counts = np.bincount(owner[miss] * size + rgb[at[miss], channel], minlength=images * size)
        counts = counts.reshape(images, size)
        used = (counts > 0).sum(1)
        single = np.where(used == 1, counts.argmax(1), -1)
        length = np.zeros_like(counts)
        if (single < 0).any():
            length[single < 0] = code_lengths(counts[single < 0])
        _write_code(fields, stage, length, single)
        words.append(code_words(length).ravel())
        lengths.append(length.ravel())
    # Alpha is 255; the distance's prefix 1 is the code 2, the pixel to the left.
    fields.add(every, 4, 0b101 | (255 << 3), 11)
    fields.add(every, 5, 0b0001 | (1 << 3), 4)
    g, r, b = owner * greens + green, owner * 256 + rgb[at, 0], owner * 256 + rgb[at, 2]
    lg, lr, lb = lengths[0][g], lengths[1][r] * miss, lengths[2][b] * miss
    v = words[0][g] | (words[1][r] << lg | words[2][b] << (lg + lr)) * miss
    c = copy_owner * greens + 256 + prefix
    # Pixels and copies in the order of their places.
    place = np.concatenate([at, copy_at])
    order = np.argsort(place, kind="stable") if len(copy_at) else slice(None)
    fields.add(
        np.concatenate([owner, copy_owner])[order], 6,
        np.concatenate([v, words[0][c] | more << lengths[0][c]]).astype(np.uint64)[order],
        np.concatenate([lg + lr + lb, lengths[0][c] + extra])[order],
    )
    out = []
    for stream, h in zip(fields.streams(images), height.tolist(), strict=True):
        body = bytes([SIGNATURE]) + struct.pack("<I", (width - 1) | (h - 1) << 14) + stream
        pad = len(body) & 1
        out.append(b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(pad))
    return out
