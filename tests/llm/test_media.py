"""Lossless WebP: streams made here, with every part of the format, must come back as they went in."""

import random
import sys

import numpy as np
import pytest

from specweave.llm import media, webp


class Out(webp.Writer):
    def code(self, lengths):
        """A normal prefix code with these lengths; returns (bits reversed, length) of each symbol."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1 and used[0] < 256:
            self.only(used[0])
            return {used[0]: (0, 0)}
        self.put(0, 1)
        self.put(15, 4)  # all 19 code lengths, five bits each; 16 symbols of 4 bits make them complete
        for k in webp.LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)
        table, value, last = {}, 0, 0
        for n, s in sorted((lengths[s], s) for s in used):
            value <<= n - last
            last = n
            table[s] = (int(f"{value:0{n}b}"[::-1], 2), n)
            value += 1
        return table


def lengths_for(symbols, size):
    """Complete lengths: a lopsided code over the symbols."""
    symbols = sorted(symbols)
    out = [0] * size
    if len(symbols) == 1:
        out[symbols[0]] = 1
        return out
    n = len(symbols)
    short = min(n - 1, 6)
    for i, s in enumerate(symbols[:short]):
        out[s] = i + 1
    rest = symbols[short:]
    bits = max(0, (len(rest) - 1).bit_length())
    longer = 2 * len(rest) - (1 << bits) if len(rest) > 1 else 0
    for i, s in enumerate(rest):
        out[s] = short + (bits if len(rest) == 1 or i >= len(rest) - longer or longer == 2 * len(rest) - (1 << bits) and (1 << bits) == len(rest) else bits - 1) if len(rest) > 1 else short
    return out


def amount(value):
    """(prefix, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v & ((1 << (top - 1)) - 1), top - 1


def put_image(o, pixels, width, cache_bits=0, main=True, references=False):
    """Pixels (n x 4: red, green, blue, alpha) as literals, cached colours and back-references."""
    n = len(pixels)
    argb = [int(p[3]) << 24 | int(p[0]) << 16 | int(p[1]) << 8 | int(p[2]) for p in pixels]
    events, cache, i = [], [None] * (1 << cache_bits) if cache_bits else [], 0
    at = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < n:
        best = (0, 0)
        if references:
            for back in {1, width, width + 1, 2 * width, 300} - {0}:
                k = 0
                while back <= i and i + k < n and k < 4000 and argb[i + k] == argb[i + k - back]:
                    k += 1
                best = max(best, (k, back))
        if best[0] >= 3:
            step = best[0]
            code = next((c + 1 for c, (x, y) in enumerate(webp.NEAR) if max(1, x + y * width) == best[1]), best[1] + 120)
            events.append(("copy", step, code))
        elif cache_bits and cache[at(argb[i])] == argb[i]:
            step = 1
            events.append(("cache", at(argb[i])))
        else:
            step = 1
            events.append(("pixel", *(int(v) for v in pixels[i])))
        if cache_bits:
            for k in range(i, i + step):
                cache[at(argb[k])] = argb[k]
        i += step
    o.put(1 if cache_bits else 0, 1)
    if cache_bits:
        o.put(cache_bits, 4)
    if main:
        o.put(0, 1)
    used = [set(), set(), set(), set(), {0}]
    for e in events:
        if e[0] == "pixel":
            for k, v in zip((1, 0, 2, 3), e[1:], strict=True):
                used[k].add(v)
        elif e[0] == "cache":
            used[0].add(280 + e[1])
        else:
            used[0].add(256 + amount(e[1])[0])
            used[4].add(amount(e[2])[0])
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    for u in used:  # symbols that a simple code cannot name need a second one
        if not u or len(u) == 1 and min(u) > 255:
            u |= {0, 1}
    tables = [o.code(lengths_for(u, s)) for u, s in zip(used, sizes, strict=True)]
    for e in events:
        if e[0] == "pixel":
            for k, v in zip((0, 1, 2, 3), (e[2], e[1], e[3], e[4]), strict=True):
                o.put(*tables[k][v])
        elif e[0] == "cache":
            o.put(*tables[0][280 + e[1]])
        else:
            for table, value, base in ((tables[0], e[1], 256), (tables[4], e[2], 0)):
                prefix, extra, bits = amount(value)
                o.put(*table[base + prefix])
                o.put(extra, bits)


def begin(width, height):
    o = Out()
    o.put(0x2F, 8)
    o.put(width - 1, 14)
    o.put(height - 1, 14)
    o.put(1, 1)
    o.put(0, 3)
    return o


def end(o):
    return o.value.to_bytes(-(-o.n // 8), "little")


def picture(seed, height, width, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
        return table[rng.integers(0, colours, (height, width))]
    x = rng.integers(0, 40, (height, width, 4)).astype(np.uint8)
    x[height // 2 :] = x[: height - height // 2]
    return x


@pytest.mark.parametrize("cache_bits", [0, 1, 6])
@pytest.mark.parametrize("references", [False, True])
def test_codes_references_and_cache(cache_bits, references):
    image = picture(cache_bits, 14, 11, 9 if references else None)
    o = begin(11, 14)
    o.put(0, 1)
    put_image(o, image.reshape(-1, 4), 11, cache_bits, references=references)
    assert (webp.decode_stream(end(o)) == image).all()


def predict_forward(image, mode_of):
    """Residuals by the format's rules, pixel by pixel."""
    h, w = image.shape[:2]
    x = image.astype(np.int32)
    out = np.empty_like(image)
    for r in range(h):
        for c in range(w):
            if r == 0 and c == 0:
                p = np.array([0, 0, 0, 255])
            elif r == 0:
                p = x[0, c - 1]
            elif c == 0:
                p = x[r - 1, 0]
            else:
                right = x[r - 1, c + 1] if c + 1 < w else x[r, 0]
                p = webp._predict(mode_of(r, c), x[r, c - 1], x[r - 1, c], right, x[r - 1, c - 1])
            out[r, c] = (x[r, c] - p) & 255
    return out


@pytest.mark.parametrize("mode", [*range(14), "mixed", "above"])
def test_predictors(mode):
    image = picture(3, 13, 10)
    rng = random.Random(1)
    blocks = [[rng.choice(range(14)) if mode == "mixed" else rng.choice((0, 2, 3, 4, 8, 9)) if mode == "above" else mode for _ in range(3)] for _ in range(4)]
    residual = predict_forward(image, lambda r, c: blocks[r >> 2][c >> 2])
    o = begin(10, 13)
    o.put(1, 1)
    o.put(webp.PREDICTOR, 2)
    o.put(0, 3)
    put_image(o, [(0, b, 0, 255) for row in blocks for b in row], 3, main=False)
    o.put(0, 1)
    put_image(o, residual.reshape(-1, 4), 10)
    assert (webp.decode_stream(end(o)) == image).all()


def test_average_predictors_floor_and_half_rounds_to_zero():
    a = lambda *v: np.array(v)
    assert webp._predict(7, a(3), a(4), None, None)[0] == 3
    assert webp._predict(13, a(10), a(13), None, a(14))[0] == 10  # mean 11, half of -3 is -1
    assert webp._predict(12, a(250), a(20), None, a(5))[0] == 255


def test_cross_colour_subtract_green_and_both():
    image = picture(5, 9, 12)
    to = np.random.default_rng(4).integers(0, 256, (3, 3, 3)).astype(np.uint8)  # green to red, green to blue, red to blue
    spread = to.repeat(4, 0)[:9].repeat(4, 1)[:, :12]
    work = image.copy()
    work[..., 0] -= work[..., 1]
    work[..., 2] -= work[..., 1]
    g, red = np.ascontiguousarray(work[..., 1]), np.ascontiguousarray(work[..., 0])
    d = lambda k, c: webp._delta(np.ascontiguousarray(spread[..., k]), c)
    work[..., 0] = red - d(0, g)
    work[..., 2] = work[..., 2] - d(1, g) - d(2, red)
    o = begin(12, 9)
    o.put(1, 1)
    o.put(webp.SUBTRACT_GREEN, 2)
    o.put(1, 1)
    o.put(webp.CROSS, 2)
    o.put(0, 3)
    put_image(o, [(e[2], e[1], e[0], 255) for row in to for e in row], 3, main=False)
    o.put(0, 1)
    put_image(o, work.reshape(-1, 4), 12)
    assert (webp.decode_stream(end(o)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 13, 16, 40])
def test_palettes(colours):
    image = picture(colours, 7, 21, colours)
    table = np.unique(image.reshape(-1, 4), axis=0)
    index = np.array([[int(np.flatnonzero((table == p).all(1))[0]) for p in row] for row in image])
    bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    each, wide = 8 >> bits, -(-21 // (1 << bits))
    packed = np.zeros((7, wide), np.int64)
    for c in range(21):
        packed[:, c >> bits] |= index[:, c] << ((c & ((1 << bits) - 1)) * each)
    o = begin(21, 7)
    o.put(1, 1)
    o.put(webp.PALETTE, 2)
    o.put(len(table) - 1, 8)
    put_image(o, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)), len(table), main=False)
    o.put(0, 1)
    put_image(o, [(0, int(v), 0, 255) for v in packed.reshape(-1)], wide)
    assert (webp.decode_stream(end(o)) == image).all()


def test_fixed_length_codes_unpack_as_the_plain_way_does(monkeypatch):
    image = np.random.default_rng(8).integers(0, 4, (6, 9, 4)).astype(np.uint8)
    o = begin(9, 6)
    o.put(0, 1)
    o.put(0, 1)
    o.put(0, 1)
    for size in (280, 256, 256, 256):
        table = o.code([2] * 4 + [0] * (size - 4))
    o.only(0)
    for p in image.reshape(-1, 4):
        for v in (p[1], p[0], p[2], p[3]):
            o.put(*table[int(v)])
    assert (webp.decode_stream(end(o)) == image).all()


def test_files_round_trip_and_damage_is_told():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (1, 144), (7, 3), (40, 144)):
        image = rng.integers(0, 256, (h, w, 4)).astype(np.uint8)
        data = webp.write(image)
        assert (webp.decode(data) == image).all() and len(data) % 2 == 0
    for bad in (b"", b"RIFF", data[:-40], b"RIFF" + data[4:15] + b"X" + data[16:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


@pytest.mark.parametrize("cache_bits", [0, 3, 9])
@pytest.mark.parametrize("how", [{}, {"predictor": True}, {"cross": (16, 8, 4)}, {"predictor": True, "cross": (32, 32, 0)}, {"references": False}, {"palette": True}])
def test_what_is_written_is_read(how, cache_bits):
    for seed in range(3):
        for colours in (1, 2, 3, 16, 17, 200):
            image = picture(seed, 20 + seed, 33, colours)
            data = webp.write(image, cache_bits=cache_bits, **how)
            assert (webp.decode(data) == image).all()


def test_texts_are_stored_shorter_and_by_every_way(monkeypatch):
    seen, whole = [], webp.write
    monkeypatch.setattr(webp, "write", lambda image, **how: (seen.append(how), whole(image, **how))[1])
    rng = random.Random(0)
    words = ["".join(rng.choice(["th", "on", "er", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "sh", "ly", "ing", "tion", "ble", "wh"]) for _ in range(rng.randrange(1, 5))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    column = b"".join(b"%06d %s\n" % (i, b"".join(rng.choice([b"a", b"b"]) for _ in range(56))) for i in range(40))
    for text in (prose(200), prose(9000), b"0110" * 500 + b"1", prose(30) * 20, bytes(range(32, 64)) * 18 + column):
        stored = media.store(media.payload(text))
        assert len(stored) < len(media.payload(text)) and media.load(stored).tobytes() == media.payload(text)
    assert {"cross", "predictor"} <= set(seen[0]) and "cache_bits" in seen[1] and "palette" in seen[2]
    assert len(media.store(media.payload(prose(30) * 20))) < len(media.payload(prose(30) * 20)) / 8


def test_media_columns(spark, odd, empty):
    import hashlib
    import zlib

    rows = media.media_columns(odd, keep_media=True).collect()
    assert len(rows) == odd.count()
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert media.load(r["media"]).tobytes() == padded
    assert media.media_columns(empty).count() == 0


def test_long_payloads_become_several_files():
    data = media.payload(bytes(range(256)) * 37_000)
    stored = media.store(data)
    assert stored.count(b"WEBPVP8L") == 10 and media.load(stored).tobytes() == data


def _greys(seed: int, n: int = 64 * 400) -> np.ndarray:
    """Grey pixels of skewed samples, with stretches that come again near and far."""
    rng = np.random.default_rng(seed)
    x = np.minimum(rng.geometric(0.06, n), 255).astype(np.uint8)
    for at, back, long in ((3000, 40, 900), (9000, 8000, 70), (15000, 1, 300), (20000, 64, 5000)):
        for i in range(at, at + long):
            x[i] = x[i - back]
    return np.stack([x, x, x, np.full(n, 255, np.uint8)], -1).reshape(-1, 64, 4)


@pytest.mark.parametrize("window", [1, 3, 100, 4096])
def test_what_a_window_of_the_stream_cuts_is_read_whole(monkeypatch, window):
    image = _greys(window % 50)
    monkeypatch.setattr(webp, "WINDOW", window)
    data = webp.write(image, cross=(32, 32, 0))
    assert (webp.decode(data) == image).all()
    with pytest.raises(ValueError):
        webp.decode_stream(data[20:-40])


def test_a_pixel_takes_less_than_a_step_of_python():
    image, steps = _greys(7), 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event == "line"
        return count

    data, before = webp.write(image, cross=(32, 32, 0), references=False), sys.gettrace()
    sys.settrace(count)
    try:
        back = webp.decode(data)
    finally:
        sys.settrace(before)
    assert (back == image).all()
    assert steps < image.shape[0] * image.shape[1] / 2
