"""Operator 8: lossless WebP, encoder and both decoders, and streams with every transform."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import media, webp


def test_media_column_round_trip(docs, odd_rows):
    got = media.describe(media.media_column(docs(odd_rows))).collect()
    assert len(got) == len(odd_rows)
    want = []
    for k, t in odd_rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.append((k, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted([(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got], key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        assert by.setdefault(r["payload_sha256"], (r["media_sha256"], r["media_bytes"], r["feature"])) == (r["media_sha256"], r["media_bytes"], r["feature"])
    assert media.describe(media.media_column(docs([]))).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (5, 576), (16, 40)])
def test_both_decoders(shape):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, shape, dtype=np.uint8), np.full(shape, 9, np.uint8), (rng.integers(0, 2, shape) * 200).astype(np.uint8), np.minimum(rng.geometric(0.3, shape), 255).astype(np.uint8)]
    files = [webp.encode_grey(x) for x in images]
    for x, many, f in zip(images, webp.decode_many(files), files):
        assert (many == x).all() and (webp.decode(f)[..., 0] == x).all() and (webp.decode(f)[..., 3] == 255).all()


def test_many_sizes_and_repeats_through_both_decoders():
    rng = np.random.default_rng(3)
    images = []
    for n in (2, 3, 4, 5, 16, 17, 60, 256):
        for height, width in ((1, 1), (1, 9), (3, 576), (16, 576), (7, 33)):
            own = rng.choice(256, n, replace=False).astype(np.uint8)
            words = [own[rng.integers(0, n, rng.integers(3, 40))] for _ in range(12)]
            row = np.concatenate([words[k] for k in rng.integers(0, 12, height * width)])[: height * width]
            images += [row.reshape(height, width), own[rng.integers(0, n, (height, width))], np.tile(own[: 3 % n + 1], height * width)[: height * width].reshape(height, width)]
    files = [webp.encode_grey(x) for x in images]
    for x, many, f in zip(images, webp.decode_many(files), files):
        assert (many == x).all() and (webp.decode(f)[..., :3] == x[..., None]).all()


def test_documents_use_references_and_palettes():
    """On real texts the encoder's features occur, shrink files, and are read back by both decoders."""
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()
    files = [f for t in [*texts, "the lazy dog", "a" * 700, "ab" * 3000] for f in media.split(media.encode((t or "").encode()))]
    heads = [webp._Header(webp._payload(f)) for f in files]
    assert all(h.code is not None for h in heads)
    refs = [any(h.code[256:]) for h in heads]
    assert sum(refs) > len(files) // 2 and sum(h.palette is not None for h in heads) >= 3
    for f, many in zip(files[-12:], webp.decode_many(files)[-12:]):
        assert (webp.decode(f)[..., 0] == many).all()


def _plain_codes(w, alphabet_extra=0):
    """Flat prefix codes: 8 bits for green's literals and for red, blue and alpha, one symbol for distance."""
    green = np.zeros(280 + alphabet_extra, np.int64)
    green[:256] = 8
    for lengths in (green, np.full(256, 8), np.full(256, 8), np.full(256, 8)):
        w.prefix(lengths)
    one = np.zeros(40, np.int64)
    one[0] = 1
    w.prefix(one)


def _flat(v):
    return int(f"{int(v):08b}"[::-1], 2)


def _put_pixels(w, rgba):
    for r, g, b, a in rgba.reshape(-1, 4).tolist():
        for v in (g, r, b, a):
            w.put(_flat(v), 8)


def _file(build, width, height):
    w = webp.Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    build(w)
    return webp.riff(w.done())


def _main(w, rgba):
    for _ in range(3):  # no more transforms, no cache, one group of codes
        w.put(0, 1)
    _plain_codes(w)
    _put_pixels(w, rgba)


def _sub_image(w, rgba):
    w.put(0, 1)
    _plain_codes(w)
    _put_pixels(w, rgba)


@pytest.fixture()
def image():
    return np.random.default_rng(8).integers(0, 256, (6, 7, 4), dtype=np.uint8)


def test_subtract_green(image):
    left = image.copy()
    left[..., 0] -= image[..., 1]
    left[..., 2] -= image[..., 1]

    def build(w):
        w.put(1, 1)
        w.put(2, 2)
        _main(w, left)

    assert (webp.decode(_file(build, 7, 6)) == image).all()


def _guess(mode, px, y, x):
    """Prediction by the format's rules, on (r, g, b, a) integers."""
    h, w, _ = px.shape
    if not y and not x:
        return np.array([0, 0, 0, 255])
    if not y:
        return px[y, x - 1]
    if not x:
        return px[y - 1, x]
    l, t, c = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
    r = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
    avg = lambda a, b: (a + b) // 2
    clip = lambda v: np.clip(v, 0, 255)
    if mode == 11:
        p = l + t - c
        return l if np.abs(p - l).sum() < np.abs(p - t).sum() else t
    if mode == 13:
        m = avg(l, t)
        return clip(m + np.trunc((m - c) / 2).astype(int))
    table = [np.array([0, 0, 0, 255]), l, t, r, c, avg(avg(l, r), t), avg(l, c), avg(l, t), avg(c, t), avg(t, r), avg(avg(l, c), avg(t, r)), None, clip(l + t - c)]
    return table[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(image, mode):
    px = image.astype(int)
    left = np.zeros_like(image)
    for y in range(6):
        for x in range(7):
            left[y, x] = (px[y, x] - _guess(mode, px, y, x)) % 256

    def build(w):
        w.put(1, 1)
        w.put(0, 2)
        w.put(0, 3)  # blocks of 4
        _sub_image(w, np.full((2, 2, 4), (0, mode, 0, 255), np.uint8))
        _main(w, left)

    assert (webp.decode(_file(build, 7, 6)) == image).all()


def test_cross_colour(image):
    to_red, to_blue, red_to_blue = 37, -90, 13
    s = lambda v: v.astype(np.uint8).view(np.int8).astype(int)
    left = image.copy()
    left[..., 0] = (image[..., 0].astype(int) - (to_red * s(image[..., 1]) >> 5)) % 256
    left[..., 2] = (image[..., 2].astype(int) - (to_blue * s(image[..., 1]) >> 5) - (red_to_blue * s(image[..., 0]) >> 5)) % 256

    def build(w):
        w.put(1, 1)
        w.put(1, 2)
        w.put(0, 3)
        _sub_image(w, np.full((2, 2, 4), (red_to_blue % 256, to_blue % 256, to_red % 256, 255), np.uint8))
        _main(w, left)

    assert (webp.decode(_file(build, 7, 6)) == image).all()


@pytest.mark.parametrize("colours", [2, 3, 11, 40])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4), dtype=np.uint8)
    index = rng.integers(0, colours, (6, 7))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, bits = 1 << pack, 8 >> pack
    wide = -(-7 // per)
    packed = np.zeros((6, wide, 4), np.uint8)
    for y in range(6):
        for x in range(7):
            packed[y, x // per, 1] |= index[y, x] << (bits * (x % per)) if pack else index[y, x]

    def build(w):
        w.put(1, 1)
        w.put(3, 2)
        w.put(colours - 1, 8)
        _sub_image(w, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).reshape(1, colours, 4))
        _main(w, packed)

    assert (webp.decode(_file(build, 7, 6)) == table[index]).all()


def test_references_and_cache():
    """A literal, a run copied from one pixel back, a colour from the cache, and the row above by its distance code."""
    a, b = (10, 20, 30, 255), (200, 100, 50, 255)
    number = lambda p: p[3] << 24 | p[0] << 16 | p[1] << 8 | p[2]
    slot = 0x1E35A7BD * number(a) % (1 << 32) >> 28

    def build(w):
        for value, n in ((0, 1), (1, 1), (4, 4), (0, 1)):  # no transform, a cache of 16 colours, one group
            w.put(value, n)
        green = np.zeros(280 + 16, np.int64)
        used = [20, 100, 256 + 2, 280 + slot]  # literals, a run of 3, the cache's slot
        green[used] = 2
        w.prefix(green)
        codes = webp.canonical(green)
        for first, second in ((10, 200), (30, 50)):
            two = np.zeros(256, np.int64)
            two[[first, second]] = 1
            w.prefix(two)
        for n, only in ((256, 255),):
            one = np.zeros(n, np.int64)
            one[only] = 1
            w.prefix(one)
        far = np.zeros(40, np.int64)
        far[[0, 1]] = 1  # distance codes 1: the row above, 2: the pixel before
        w.prefix(far)
        put = lambda s: w.put(int(codes[s]), 2)
        put(20), w.put(0, 1), w.put(0, 1)  # a
        put(100), w.put(1, 1), w.put(1, 1)  # b
        put(258), w.put(1, 1)  # b three times, from the pixel before
        put(280 + slot)  # a
        put(258), w.put(0, 1)  # three of the row above
        put(258), w.put(0, 1)

    want = np.array([a, b, b, b, b, a, a, b, b, b, b, a], np.uint8).reshape(2, 6, 4)
    got = webp.decode(_file(build, 6, 2))
    assert (got == want).all()


def test_damage_is_noticed():
    f = webp.encode_grey(np.arange(256, dtype=np.uint8).reshape(2, 128))
    for broken in (b"", f[:11], b"X" + f[1:], webp.riff(webp._payload(f)[:40])):
        with pytest.raises(Exception):  # noqa: B017
            webp.decode(broken)
