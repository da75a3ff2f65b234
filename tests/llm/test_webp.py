"""The decoder of lossless WebP against files written bit by bit from the format's description."""

import struct

import numpy as np
import pytest

from causalith.llm.webp import CACHE_BITS, LENGTH_ORDER, NEIGHBOURS, decode, encode_rgb, gains_by_cache


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(int(value) >> k) & 1 for k in range(n)]

    def word(self, code):
        self.bits += [int(b) for b in code]

    def file(self, width, height):
        body = b"\x2f" + struct.pack("<I", (width - 1) | (height - 1) << 14) + np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        pad = len(body) & 1
        return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(pad)


def balanced(size, turned):
    """A complete code with two lengths; turned, the last symbols have the short ones."""
    k = size.bit_length() - 1
    lengths = [k] * (2 ** (k + 1) - size) + [k + 1] * (2 * size - 2 ** (k + 1))
    lengths = lengths[::-1] if turned else lengths
    words, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        words[s] = format(code, f"0{n}b")
        code, last = code + 1, n
    return lengths, words


def write_codes(w, cache, turned):
    out = []
    for size in (280 + (1 << cache if cache else 0), 256, 256, 256, 40):
        lengths, words = balanced(size, turned)
        w.put(0, 1)
        w.put(15, 4)
        for s in LENGTH_ORDER:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for n in lengths:
            w.word(format(n, "04b"))
        out.append(words)
    return out


def number(v):
    """Prefix, extra bits and their count for a length or a distance code."""
    if v <= 4:
        return v - 1, 0, 0
    high = (v - 1).bit_length() - 1
    return 2 * high + ((v - 1) >> (high - 1) & 1), (v - 1) & ((1 << (high - 1)) - 1), high - 1


def write_pixels(w, argb, width, rng, main, cache=0, meta=None, copies=False):
    flat = [int(v) for v in np.ravel(argb)]
    w.put(cache > 0, 1)
    if cache:
        w.put(cache, 4)
    groups = np.zeros(len(flat), int)
    if main:
        w.put(meta is not None, 1)
        if meta is not None:
            w.put(meta - 2, 3)
            side = (width + (1 << meta) - 1) >> meta
            rows = (len(flat) // width + (1 << meta) - 1) >> meta
            image = rng.integers(0, 3, (rows, side))
            image.flat[0] = 2
            write_pixels(w, image << 8, side, rng, False)
            at = np.arange(len(flat))
            groups = image[at // width >> meta, at % width >> meta]
    codes = [write_codes(w, cache, g % 2 == 1) for g in range(int(groups.max()) + 1 if meta is None else int(image.max()) + 1)]
    held, i, used = {}, 0, set()
    slot = lambda v: ((v * 0x1E35A7BD) & 0xFFFFFFFF) >> (32 - cache)
    while i < len(flat):
        code, n = codes[groups[i]], 0
        if copies and i and rng.random() < 0.7:
            distance = int(rng.integers(1, i + 1))
            named = [k + 1 for k, (x, y) in enumerate(NEIGHBOURS) if max(x + y * width, 1) == distance]
            number_of = int(rng.choice(named)) if named and rng.random() < 0.8 else distance + 120
            while i + n < len(flat) and flat[i + n] == flat[i + n - distance] and n < 4096:
                n += 1
        if n:
            used.add("copy")
            prefix, extra, bits = number(n)
            w.word(code[0][256 + prefix])
            w.put(extra, bits)
            prefix, extra, bits = number(number_of)
            w.word(code[4][prefix])
            w.put(extra, bits)
        elif cache and held.get(slot(flat[i])) == flat[i]:
            used.add("cache")
            w.word(code[0][280 + slot(flat[i])])
            n = 1
        else:
            v = flat[i]
            for c, shift in ((0, 8), (1, 16), (2, 0), (3, 24)):
                w.word(code[c][v >> shift & 255])
            n = 1
        if cache:
            for v in flat[i : i + n]:
                held[slot(v)] = v
        i += n
    return used


def channels(v):
    return [int(v) >> s & 255 for s in (24, 16, 8, 0)]


def pack(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | c[3] & 255


def predict(mode, left, top, corner, right):
    def mean(a, b):
        return [(x + y) // 2 for x, y in zip(a, b, strict=True)]

    if mode == 11:
        p = [a + b - c for a, b, c in zip(left, top, corner, strict=True)]
        return left if sum(abs(a - b) for a, b in zip(p, left, strict=True)) < sum(abs(a - b) for a, b in zip(p, top, strict=True)) else top
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(mean(left, top), corner, strict=True)]
    return {
        1: left, 2: top, 3: right, 4: corner, 5: mean(mean(left, right), top), 6: mean(left, corner), 7: mean(left, top),
        8: mean(corner, top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right)),
    }.get(mode, [255, 0, 0, 0])


def residuals(argb, modes, shift):
    h, w = argb.shape
    flat, out = argb.ravel(), np.zeros(argb.size, np.int64)
    get = lambda k: channels(flat[k])
    for i in range(argb.size):
        y, x = divmod(i, w)
        if y == 0:
            guess = [255, 0, 0, 0] if x == 0 else get(i - 1)
        elif x == 0:
            guess = get(i - w)
        else:
            guess = predict(int(modes[y >> shift, x >> shift]), get(i - 1), get(i - w), get(i - w - 1), get(i - w + 1))
        out[i] = pack([a - b for a, b in zip(get(i), guess, strict=True)])
    return out.reshape(h, w)


def uncoloured(argb, side, shift):
    signed = lambda v: v - 256 if v > 127 else v
    out = argb.copy()
    for y, x in np.ndindex(argb.shape):
        a, r, g, b = channels(argb[y, x])
        _, red_blue, green_blue, green_red = map(signed, channels(side[y >> shift, x >> shift]))
        out[y, x] = pack([a, r - (green_red * signed(g) >> 5), g, b - (green_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5)])
    return out


def write(argb, rng, transforms=(), **options):
    """A file that holds the image after the transforms, in their order, and which symbols it uses."""
    w, (height, width) = Writer(), argb.shape
    image = argb.astype(np.int64)
    for kind in transforms:
        w.put(1, 1)
        w.put({"predictor": 0, "cross": 1, "green": 2, "palette": 3}[kind], 2)
        h, x = image.shape
        if kind in ("predictor", "cross"):
            shift = int(rng.integers(2, 4))
            w.put(shift - 2, 3)
            across, down = (x + (1 << shift) - 1) >> shift, (h + (1 << shift) - 1) >> shift
            if kind == "predictor":
                modes = np.resize(rng.permutation(16), (down, across))
                image, side = residuals(image, modes, shift), 255 << 24 | modes << 8
            else:
                side = rng.integers(0, 1 << 32, (down, across))
                image = uncoloured(image, side, shift)
            write_pixels(w, side, across, rng, False)
        elif kind == "green":
            image = np.array([pack([a, r - g, g, b - g]) for a, r, g, b in map(channels, image.ravel())]).reshape(h, x)
        else:
            colours = np.unique(image)
            w.put(len(colours) - 1, 8)
            deltas = [pack([p - q for p, q in zip(channels(c), channels(d), strict=True)]) for c, d in zip(colours, [0, *colours[:-1]], strict=True)]
            write_pixels(w, np.array(deltas), len(deltas), rng, False)
            each = 1 if len(colours) <= 2 else 2 if len(colours) <= 4 else 4 if len(colours) <= 16 else 8
            per = 8 // each
            index = np.pad(np.searchsorted(colours, image), ((0, 0), (0, -x % per))).reshape(h, -1, per)
            image = 255 << 24 | (index << each * np.arange(per)).sum(2) << 8
    w.put(0, 1)
    used = write_pixels(w, image, image.shape[1], rng, True, **options)
    return w.file(width, height), used


def images(rng):
    yield rng.integers(0, 1 << 32, (1, 1))
    yield rng.integers(0, 1 << 32, (13, 17))
    for colours in (2, 4, 11, 60):
        yield rng.choice(rng.integers(0, 1 << 32, colours), (11, 19))
    yield np.resize(rng.choice(rng.integers(0, 1 << 32, 5), 7), (9, 16))


OPTIONS = [{}, {"cache": 1}, {"cache": 6}, {"meta": 2}, {"copies": True}, {"copies": True, "cache": 4, "meta": 3}]
TRANSFORMS = [(), ("predictor",), ("cross",), ("green",), ("palette",), ("predictor", "cross", "green"), ("palette", "predictor"), ("cross", "predictor")]


@pytest.mark.parametrize("transforms", TRANSFORMS, ids="+".join)
def test_every_path_of_the_decoder(transforms):
    rng = np.random.default_rng(len(TRANSFORMS) * 7 + TRANSFORMS.index(transforms))
    files, want, used = [], [], set()
    for image in images(rng):
        if "palette" in transforms and len(np.unique(image)) > 256:
            continue
        for options in OPTIONS:
            file, symbols = write(image, rng, transforms, **options)
            files.append(file)
            used |= symbols
            want.append(np.array([[(r, g, b, a) for a, r, g, b in map(channels, row)] for row in image]))
    assert used == {"copy", "cache"}
    for got, pixels in zip(decode(files), want, strict=True):
        assert (got == pixels).all()


def test_the_encoder_uses_a_colour_cache_where_it_gains():
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(40)]
    text = " ".join(rng.choice(words, 8000)).encode()[: 64 * 3 * 128]
    blank, noise = bytes([32]) * 192, rng.integers(0, 256, 64 * 3 * 20, np.uint8).tobytes()
    data, height = np.frombuffer(text + blank + noise, np.uint8), np.array([128, 1, 20])
    image = np.repeat(np.arange(3), height * 64)
    assert gains_by_cache(data.reshape(-1, 3), image, 3).tolist() == [True, False, False]
    plain, cached, chosen = (encode_rgb(data, height, 64, c) for c in (False, True, None))
    assert len(cached[0]) < len(plain[0]) and chosen == [cached[0], plain[1], plain[2]]
    for files in (plain, cached, chosen):
        assert b"".join(p[:, :, :3].tobytes() for p in decode(files)) == data.tobytes()
    # Equal texts are stored alike, whatever lies beside them.
    assert encode_rgb(np.frombuffer(text, np.uint8), np.array([128]), 64)[0] == chosen[0] and CACHE_BITS == 10
