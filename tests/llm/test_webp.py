import hashlib
import random
import zlib

import numpy as np
import pytest

from gridscribe.llm import webp
from gridscribe.llm.media import decode_images, padded, read_back, store, store_texts
from gridscribe.llm.webp import BitWriter, code_words, limited_lengths, put_code

from .helpers import docs, odd_rows, prose, with_clashing_columns

# --- an encoder of everything that the decoder reads: transforms forward, matches, a cache, meta codes ---


def tokens_of(flat, width, cache_bits, matches):
    """Literals, back-references ("copy", length, distance) and cache hits of a run of pixels."""
    out, i, cache = [], 0, {}
    key = lambda p: (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)

    def seen(p):
        if cache_bits:
            cache[key(p)] = p

    while i < len(flat):
        best = (0, 0)
        for d in {1, width, width + 1, 2, 130, width - 1} if matches else ():
            n = 0
            while d and d <= i and i + n < len(flat) and flat[i + n] == flat[i + n - d] and n < 4000:
                n += 1
            best = max(best, (n, d))
        if best[0] >= 3:
            out.append(("copy", best[0], best[1], i))
            for p in flat[i : i + best[0]]:
                seen(p)
            i += best[0]
            continue
        p = flat[i]
        out.append(("cache", key(p), 0, i) if cache_bits and cache.get(key(p)) == p else ("pixel", p, 0, i))
        seen(p)
        i += 1
    return out


def prefix(value):
    """Symbol, extra bits and their number of a length or a distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> (top - 1) & 1
    return 2 * top + half, v - ((2 + half) << (top - 1)), top - 1


def distance_code(d, width):
    for k, (x, y) in enumerate(webp._NEAR, 1):
        if max(1, x + y * width) == d:
            return k
    return d + len(webp._NEAR)


def put_image(out, image, cache_bits=0, matches=False, meta=None, block=2, main=False):
    height, width = image.shape
    flat = [int(p) for p in image.ravel()]
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups = 1
    if main:
        out.put(int(meta is not None), 1)
        if meta is not None:
            out.put(block - 2, 3)
            put_image(out, (meta << 8).astype(np.uint32))
            groups = int(meta.max()) + 1
    sizes = (256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    coded = []
    for kind, a, d, at in tokens_of(flat, width, cache_bits, matches):
        g = int(meta[(at // width) >> block, (at % width) >> block]) if meta is not None else 0
        if kind == "pixel":
            parts = [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
        elif kind == "cache":
            parts = [(0, 280 + a, 0, 0)]
        else:
            s, extra, n = prefix(a)
            t, more, m = prefix(distance_code(d, width))
            parts = [(0, 256 + s, extra, n), (4, t, more, m)]
        for code, symbol, _, _ in parts:
            counts[g][code][symbol] += 1
        coded.append((g, parts))
    lengths = [[limited_lengths(c, 15) for c in group] for group in counts]
    for group in lengths:
        for own in group:
            put_code(out, own)
    words = [[code_words(own) for own in group] for group in lengths]
    for g, parts in coded:
        for code, symbol, extra, n in parts:
            if np.count_nonzero(lengths[g][code]) > 1:
                out.put(int(words[g][code][symbol]), int(lengths[g][code][symbol]))
            out.put(extra, n)


def forward_predictor(image, block, modes):
    height, width = image.shape
    c = webp.channels(image).tolist()
    rest = [[None] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = c[0][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = c[y - 1][0]
            else:
                m = int(modes[y >> block, x >> block])
                right = c[y - 1][x + 1] if x + 1 < width else c[y][0]
                guess = [255, 0, 0, 0] if m in (0, 14, 15) else brute_guess(m, c[y][x - 1], c[y - 1][x], c[y - 1][x - 1], right)
            rest[y][x] = [(a - b) & 255 for a, b in zip(c[y][x], guess)]
    return webp.pixels(np.array(rest))


def brute_guess(m, L, T, TL, TR):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if m == 11:
        p = [a + b - c for a, b, c in zip(L, T, TL)]
        return L if sum(abs(a - b) for a, b in zip(p, L)) < sum(abs(a - b) for a, b in zip(p, T)) else T
    if m == 13:
        half = mean(L, T)
        return [clamp(a + (abs(a - c) // 2) * (1 if a >= c else -1)) for a, c in zip(half, TL)]
    return {1: lambda: L, 2: lambda: T, 3: lambda: TR, 4: lambda: TL, 5: lambda: mean(mean(L, TR), T), 6: lambda: mean(L, TL), 7: lambda: mean(L, T), 8: lambda: mean(TL, T), 9: lambda: mean(T, TR), 10: lambda: mean(mean(L, TL), mean(T, TR)), 12: lambda: [clamp(a + b - c) for a, b, c in zip(L, T, TL)]}[m]()


def encode(image, predictor=None, cross=None, green=False, palette=False, **coded):
    height, width = image.shape
    out = BitWriter()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    if palette:
        colours = np.unique(image)
        out.put(1, 1)
        out.put(webp.PALETTE, 2)
        out.put(len(colours) - 1, 8)
        c = webp.channels(colours)
        put_image(out, webp.pixels(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255)[None])
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        index = np.searchsorted(colours, image)
        each, group = 8 >> packed, 1 << packed
        wide = np.zeros((height, -(-width // group) * group), np.int64)
        wide[:, :width] = index
        image = ((wide.reshape(height, -1, group) << (np.arange(group) * each)).sum(axis=2) << 8).astype(np.uint32)
    if predictor is not None:
        block, modes = predictor
        out.put(1, 1)
        out.put(webp.PREDICTOR, 2)
        out.put(block - 2, 3)
        put_image(out, (modes << 8).astype(np.uint32))
        image = forward_predictor(image, block, modes)
    if green:
        out.put(1, 1)
        out.put(webp.SUBTRACT_GREEN, 2)
        c = webp.channels(image)
        c[..., 1] = (c[..., 1] - c[..., 2]) & 255
        c[..., 3] = (c[..., 3] - c[..., 2]) & 255
        image = webp.pixels(c)
    if cross is not None:
        block, factors = cross
        out.put(1, 1)
        out.put(webp.CROSS_COLOUR, 2)
        out.put(block - 2, 3)
        put_image(out, factors)
        signed = lambda v: v - 256 if v > 127 else v
        c = webp.channels(image)
        for y in range(height):
            for x in range(width):
                f = int(factors[y >> block, x >> block])
                to_blue_red, to_blue, to_red = signed(f >> 16 & 255), signed(f >> 8 & 255), signed(f & 255)
                r, g = int(c[y, x, 1]), signed(int(c[y, x, 2]))
                c[y, x, 3] = (c[y, x, 3] - (to_blue * g >> 5) - (to_blue_red * signed(r) >> 5)) & 255
                c[y, x, 1] = (r - (to_red * g >> 5)) & 255
        image = webp.pixels(c)
    out.put(0, 1)
    put_image(out, image, main=True, **coded)
    return out.value.to_bytes(-(-out.size // 8), "little")


def picture(seed, height, width, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint32), (height, width))
    y, x = np.mgrid[:height, :width]
    c = np.stack([np.full_like(x, 255), x * 3 % 256, (x + y) * 2 % 256, (y * 5 + x) % 256], axis=-1) + rng.integers(0, 4, (height, width, 4))
    return webp.pixels(c & 255)


CASES = {
    "plain": ({}, {}),
    "matches": (dict(colours=5), dict(matches=True)),
    "cache": (dict(colours=40), dict(cache_bits=4)),
    "cache and matches": (dict(colours=9), dict(cache_bits=11, matches=True)),
    "green": ({}, dict(green=True)),
    **{f"palette {n}": (dict(colours=n), dict(palette=True, matches=n % 2 == 0)) for n in (1, 2, 3, 16, 17, 200)},
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("shape", [(1, 1), (7, 13), (20, 33)])
def test_round_trip(case, shape):
    how, options = CASES[case]
    image = picture(3, *shape, **how)
    assert (webp.decode_stream(encode(image, **options)) == image).all()


@pytest.mark.parametrize("mode", range(16))
def test_predictors(mode):
    image = picture(mode, 12, 19)
    assert (webp.decode_stream(encode(image, predictor=(2, np.full((3, 5), mode)))) == image).all()


def test_all_transforms_with_meta_codes():
    rng = np.random.default_rng(1)
    image = picture(8, 21, 30)
    modes, factors = rng.integers(0, 14, (6, 8)), rng.integers(0, 1 << 24, (3, 4)).astype(np.uint32) | np.uint32(webp.BLACK)
    data = encode(image, predictor=(2, modes), green=True, cross=(3, factors), cache_bits=3, matches=True, meta=rng.integers(0, 3, (6, 8)), block=2)
    assert (webp.decode_stream(data) == image).all()
    assert (webp.decode(webp.wrap([(21, data)], 30)) == image).all()
    assert [(a == image).all() for a in webp.decode_streams([data, data])] == [True, True]


def test_broken_files_are_refused():
    good = store(padded(b"some text"))
    for bad in (b"", b"RIFF", good[:30], b"x" + good[1:], good[:20] + b"\0" + good[21:]):
        with pytest.raises(webp.WebpError):
            webp.decode(bad)


def test_payloads_round_trip_together():
    rng = random.Random(2)
    raw = [b"", b"a", b"ab" * 500, bytes(range(256)) * 40, prose(1, 9000).encode(), bytes(64), bytes(rng.randrange(256) for _ in range(5000)), bytes([7]) * 9000]
    files = [store(padded(x)) for x in raw]
    assert read_back(files) == [padded(x) for x in raw]
    for data, file in zip(raw, files):  # the general decoder reads the same
        assert ((webp.decode(file) >> 8) & 255).astype(np.uint8).tobytes() == padded(data)


def test_texts(spark):
    rows = odd_rows() + [(100, prose(1, 3000)), (101, "é😀\0x"), (102, prose(1, 3000))]
    got = store_texts(with_clashing_columns(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r["doc_id"] and (i is not None or len(t or "") == r["n_bytes"]))
        payload = padded((text or "").encode())
        assert (r["n_bytes"], r["payload_bytes"]) == (len((text or "").encode()), len(payload))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
    same = [r for r in got if r["doc_id"] in (100, 102)]
    assert same[0]["media"] == same[1]["media"] and same[0]["feature"] == same[1]["feature"]
    assert store_texts(docs(spark, [])).count() == 0


def test_image_column(spark):
    image = picture(4, 5, 6)
    rows = [(1, bytearray(webp.wrap([(5, encode(image))], 6)), "w"), (2, None, None), (3, bytearray(b"no image"), ""), (4, bytearray(), "x")]
    got = {r["id"]: r for r in decode_images(spark.createDataFrame(rows, "id long, media binary, width string")).collect()}
    assert (np.array(got[1]["pixels"], np.int32).view(np.uint32) == image.ravel()).all() and (got[1]["width"], got[1]["height"]) == (6, 5)
    assert all(got[i]["pixels"] is None and got[i]["width"] is None for i in (2, 3, 4))


def structured():
    """Images by what their samples are like, and what should be used for them."""
    rng = np.random.default_rng(8)
    x, y = np.meshgrid(np.arange(64), np.arange(40))
    noise = rng.integers(0, 256, (40, 64))
    row = rng.integers(0, 256, 64)
    return {
        "noise": (noise, set(), False),
        "one value": (np.full((40, 64), 7), {webp.PALETTE}, True),
        "few values": (noise % 5, {webp.PALETTE}, False),
        "long runs": (np.repeat(rng.integers(0, 256, 40), 64).reshape(40, 64), None, True),
        "equal rows": (np.tile(row, (40, 1)), None, True),
        "across": ((x * 3 + y * 7 + rng.integers(0, 2, (40, 64))) % 256, {webp.PREDICTOR}, False),
        "down": (((row[None, :] + y * 3 + rng.integers(0, 2, (40, 64))) % 256), {webp.PREDICTOR}, False),
        "one row": (noise[:1], set(), False),
        "two equal rows": (np.repeat(noise[:1], 2, axis=0), None, False),
    }


def test_encoder_uses_what_saves_bits_and_loses_nothing():
    for name, (samples, transforms, copied) in structured().items():
        samples = samples.astype(np.uint8)
        stream = webp.encode_samples(samples)
        back = webp.decode_stream(stream)
        assert (((back >> 8) & 255) == samples).all() and (back >> 24 == 255).all() and (back & 0xFF00FF == 0).all(), name
        assert ((webp.decode_streams([stream, stream])[1]) == back).all(), name
        bits = webp.Bits(stream)
        head = webp.read_header(bits)
        if transforms is not None:
            assert {t[0] for t in head.transforms} == transforms, name
        bits.read(2)
        assert (webp.read_group(bits, 0)[0].table.max() >> 4 >= 256) == copied, name


def test_random_samples_of_all_kinds_come_back():
    rng = np.random.default_rng(9)
    for k in range(60):
        height, kinds = int(rng.integers(1, 65)), int(rng.choice([1, 2, 3, 5, 17, 40, 256]))
        samples = rng.integers(0, kinds, (height, 64))
        if k % 3 == 0:
            samples = np.cumsum(samples, axis=k % 2) % 256
        if k % 4 == 0:
            samples = np.repeat(samples.ravel(), 16)[: height * 64].reshape(height, 64)
        samples = samples.astype(np.uint8)
        assert (((webp.decode_stream(webp.encode_samples(samples)) >> 8) & 255) == samples).all()


def test_one_mode_is_undone_as_pixel_by_pixel():
    rng = np.random.default_rng(10)
    image = rng.integers(0, 1 << 32, (7, 9), dtype=np.uint32)
    for mode in (1, 2):
        modes = np.full((4, 5), mode << 8, np.uint32)
        modes_mixed = modes.copy()
        want = webp._undo_one_mode(image, mode)
        old, webp._undo_one_mode = webp._undo_one_mode, None
        try:
            modes_mixed[3, 4] = (3 - mode) << 8  # a block beyond the image: makes the modes differ, and is not looked at
            assert (webp.undo_predictor(image, 1, modes_mixed)[:6, :8] == want[:6, :8]).all()
        finally:
            webp._undo_one_mode = old


def test_length_prefixes_come_back():
    for value in [*range(1, 200), 511, 512, 513, 4095, 4096]:
        symbol, extra, bits = webp._prefix(value)
        out = webp.BitWriter()
        out.put(extra, bits)
        assert webp._value(webp.Bits(out.value.to_bytes(8, "little")), symbol) == value
