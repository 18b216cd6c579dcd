"""Lossless WebP: a whole decoder, a batch decoder for greyscale streams, and an encoder of greyscale rows.

``decode`` reads any lossless file: prefix codes, back-references, colour cache, and the inverses of the
predictor, cross-colour, subtract-green and palette transforms. ``decode_many`` decodes streams of literals and
back-references, with subtract-green or a palette, side by side, a symbol of each at a time, and hands every
other stream to ``decode``. ``encode_grey`` uses back-references, and a palette of packed pixels instead of
subtract-green, wherever these make a file smaller.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

# Fixed values of the format.
_CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_LITERALS, _LENGTHS, _FAR = 256, 24, 40
_PREDICTOR, _CROSS, _GREEN, _PALETTE = range(4)
_MOST_BITS = 11
# Samples that a back-reference of the encoder repeats at least and at most, and bits for a place in an image;
# symbols that the batch decoder takes of each stream before it looks which have ended.
_SEED, _LONGEST, _PLACE_BITS, _STEPS = 8, 4096, 18, 64


class Bits:
    """Least significant bit first reader over bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.size, self.at = data, 8 * len(data), at

    def read(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the stream ends too early")
        byte = self.at >> 3
        part = int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)
        self.at += n
        return part & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7) & ((1 << n) - 1)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest, for given code lengths."""
    used = np.flatnonzero(lengths)
    codes = np.zeros(len(lengths), np.int64)
    if not len(used):
        return codes
    sizes = lengths[used]
    order = np.argsort(sizes, kind="stable")
    used, sizes = used[order], sizes[order]
    most = int(sizes[-1])
    before = np.cumsum(1 << (most - sizes)) - (1 << (most - sizes))  # room taken so far, in codes of the greatest length
    value = before >> (most - sizes)
    codes[used] = _BACKWARD[value] >> (16 - sizes)
    return codes


_BACKWARD = np.zeros(1 << 16, np.int64)  # 16 bits in the opposite order
for _k in range(16):
    _BACKWARD |= (np.arange(1 << 16) >> _k & 1) << (15 - _k)


class Prefix:
    """A prefix code as a table over its longest code: symbol and length of what the next bits begin with."""

    def __init__(self, lengths):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        self.lengths = lengths
        if len(used) <= 1:  # one symbol takes no bits
            self.bits, self.symbols, self.sizes = 0, [int(used[0]) if len(used) else 0], [0]
            return
        self.bits = int(lengths.max())
        if (2.0 ** -lengths[used].astype(float)).sum() != 1:
            raise ValueError("a prefix code is not complete")
        symbols, sizes = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.int64)
        codes = canonical(lengths)
        for s in used.tolist():
            symbols[codes[s] :: 1 << lengths[s]] = s
            sizes[codes[s] :: 1 << lengths[s]] = lengths[s]
        self.symbols, self.sizes = symbols.tolist(), sizes.tolist()

    def next(self, bits: Bits) -> int:
        if not self.bits:
            return self.symbols[0]
        k = bits.peek(self.bits)
        bits.at += self.sizes[k]
        if bits.at > bits.size:
            raise ValueError("the stream ends too early")
        return self.symbols[k]


@functools.lru_cache(1024)
def _known_prefix(lengths: tuple) -> Prefix:
    """Codes that streams have in common: of code lengths, and of one symbol."""
    return Prefix(lengths)


def _read_prefix(bits: Bits, alphabet: int, make=Prefix):
    """The next prefix code, as ``make`` makes it of its lengths; such as streams have in common are kept."""
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return _known_prefix(tuple(lengths)) if make is Prefix else make(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[_CODE_ORDER[k]] = bits.read(3)
    code = _known_prefix(tuple(own))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    # as one number, lowest bit next: no length takes over 14 bits with what repeats it
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * alphabet + 2], "little") >> (bits.at & 7)
    symbols, sizes, mask, at, last, taken = code.symbols, code.sizes, (1 << code.bits) - 1, 0, 8, 0
    while at < alphabet and left:
        left -= 1
        k = ahead & mask
        s, n = symbols[k], sizes[k]
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
        else:
            more, least, what = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
            again = least + (ahead >> n & ((1 << more) - 1))
            n += more
            if at + again > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + again] = [what] * again
            at += again
        ahead >>= n
        taken += n
    bits.at += taken
    if bits.at > bits.size:
        raise ValueError("the stream ends too early")
    return make(lengths)


def _run(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _up(n: int, shift: int) -> int:
    return (n + (1 << shift) - 1) >> shift


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as ARGB numbers of one entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, shift, which = 1, 0, None
    if main and bits.read(1):
        shift = bits.read(3) + 2
        which = _read_pixels(bits, _up(width, shift), _up(height, shift), False) >> 8 & 0xFFFF
        groups = int(which.max()) + 1
        which = which.reshape(-1, _up(width, shift)).tolist()
    sizes = (_LITERALS + _LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, _FAR)
    codes = [[_read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    cache, drop = [0] * (1 << cache_bits), 32 - cache_bits
    out: list[int] = []
    total, cached = width * height, 0
    green, red, blue, alpha, far = codes[0]
    while len(out) < total:
        at = len(out)
        if which is not None:
            green, red, blue, alpha, far = codes[which[at // width >> shift][at % width >> shift]]
        s = green.next(bits)
        if s < _LITERALS:
            r = red.next(bits)
            b = blue.next(bits)
            out.append(alpha.next(bits) << 24 | r << 16 | s << 8 | b)
        elif s < _LITERALS + _LENGTHS:
            length = _run(s - _LITERALS, bits)
            d = _run(far.next(bits), bits)
            if d > 120:
                d -= 120
            else:
                dx, dy = _DISTANCES[d - 1]
                d = max(1, dx + dy * width)
            if d > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at - d, at - d + length):
                out.append(out[k])
        else:
            while cached < at:
                cache[0x1E35A7BD * out[cached] % (1 << 32) >> drop] = out[cached]
                cached += 1
            out.append(cache[s - _LITERALS - _LENGTHS])
    return np.array(out, np.uint32)


def _bytes(pixels: np.ndarray) -> np.ndarray:
    """ARGB numbers as (..., 4) of blue, green, red, alpha."""
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _predicted(mode: int, left, top, corner, right) -> list:
    """Prediction of a pixel (blue, green, red, alpha) from its neighbours."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clip = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        guess = [x + y - z for x, y, z in zip(left, top, corner, strict=True)]
        to_left = sum(abs(g - x) for g, x in zip(guess, left, strict=True))
        to_top = sum(abs(g - x) for g, x in zip(guess, top, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clip(x + y - z) for x, y, z in zip(left, top, corner, strict=True)]
    if mode == 13:
        out = []
        for m, z in zip(mean(left, top), corner, strict=True):
            half = (m - z) // 2 if m >= z else -((z - m) // 2)
            out.append(clip(m + half))
        return out
    return [0, 0, 0, 255]


def _undo_predictor(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    h, w, _ = image.shape
    px = image.tolist()
    for y in range(h):
        row, above = px[y], px[y - 1] if y else None
        for x in range(w):
            if not y:
                guess = row[x - 1] if x else [0, 0, 0, 255]
            elif not x:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < w else row[0]
                guess = _predicted(int(modes[y >> shift, x >> shift]), row[x - 1], above[x], above[x - 1], right)
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess, strict=True)]
    return np.array(px, np.uint8)


def _undo_cross(image: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    h, w, _ = image.shape
    f = np.repeat(np.repeat(factors, 1 << shift, 0), 1 << shift, 1)[:h, :w].view(np.int8).astype(np.int32)
    signed = lambda a: a.astype(np.uint8).view(np.int8).astype(np.int32)
    green, red, blue = signed(image[..., 1]), image[..., 2].astype(np.int32), image[..., 0].astype(np.int32)
    red = red + (f[..., 0] * green >> 5) & 255  # green to red lies in blue's place, green to blue in green's, red to blue in red's
    blue = blue + (f[..., 1] * green >> 5) + (f[..., 2] * signed(red) >> 5) & 255
    out = image.copy()
    out[..., 2], out[..., 0] = red, blue
    return out


def _undo_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 0] += image[..., 1]
    out[..., 2] += image[..., 1]
    return out


def _undo_palette(image: np.ndarray, table: np.ndarray, width: int, pack: int) -> np.ndarray:
    index = image[..., 1].astype(np.int64)
    if pack:
        bits = 8 >> pack
        index = (index[..., None] >> np.arange(0, 8, bits) & ((1 << bits) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(table)] = table
    return full[index]


def _payload(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file: height x width x (red, green, blue, alpha)."""
    bits = Bits(_payload(data))
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (_PREDICTOR, _CROSS):
            shift = bits.read(3) + 2
            part = _bytes(_read_pixels(bits, _up(now, shift), _up(height, shift), False).reshape(_up(height, shift), -1))
            undo.append((kind, part, shift, now))
        elif kind == _GREEN:
            undo.append((kind, None, 0, now))
        else:
            n = bits.read(8) + 1
            table = np.cumsum(_bytes(_read_pixels(bits, n, 1, False)), axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, table, pack, now))
            now = _up(now, pack)
    image = _bytes(_read_pixels(bits, now, height, True).reshape(height, now))
    for kind, part, n, wide in reversed(undo):
        if kind == _PREDICTOR:
            image = _undo_predictor(image, part[..., 1] & 15, n)
        elif kind == _CROSS:
            image = _undo_cross(image, part, n)
        elif kind == _GREEN:
            image = _undo_green(image)
        else:
            image = _undo_palette(image, part, wide, n)
    return np.ascontiguousarray(image[..., [2, 1, 0, 3]])


def code_lengths(counts: np.ndarray, most: int = _MOST_BITS) -> np.ndarray:
    """Huffman code lengths of at most ``most`` bits; a lone symbol gets 1."""
    counts = counts.astype(np.int64)
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        order = sorted(used, key=counts.tolist().__getitem__)
        weights = [int(counts[k]) for k in order]  # leaves, then inner nodes as they are made, both ascending
        n, parents = len(order), [0] * (2 * len(order) - 1)
        leaf, inner = 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (inner >= new or weights[leaf] <= weights[inner]):
                    pick, leaf = leaf, leaf + 1
                else:
                    pick, inner = inner, inner + 1
                total += weights[pick]
                parents[pick] = new
            weights.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parents[k]] + 1
        if max(depth[:n]) <= most:
            lengths[order] = depth[:n]
            return lengths
        counts = np.where(counts > 0, (counts >> 1) + 1, 0)


# Code lengths of code lengths as the encoder writes them: 1 to 11 and the short run of zeros, 4 bits each; none and the long run, 3 bits.
_OWN = np.array([3] + [4] * _MOST_BITS + [0] * 5 + [4, 3])
_OWN_CODES = canonical(_OWN).tolist()
_OWN_HEAD = [0b11110, *(int(_OWN[k]) for k in _CODE_ORDER), 0]
_OWN_HEAD_SIZES = [5] + [3] * 19 + [1]


class Writer:
    """Least significant bit first writer."""

    def __init__(self):
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values += values.tolist()
        self.sizes += sizes.tolist()

    def prefix(self, lengths: np.ndarray) -> None:
        """A prefix code's lengths, plain or, for one symbol under 256, in the short form."""
        used = np.flatnonzero(lengths)
        if len(used) <= 1:
            self.put(0b101 | (int(used[0]) if len(used) else 0) << 3, 11)
            return
        values, sizes = self.values, self.sizes
        values += _OWN_HEAD
        sizes += _OWN_HEAD_SIZES
        last = 0
        for at, n in zip([*used.tolist(), len(lengths)], [*lengths[used].tolist(), 0], strict=True):
            left = at - last
            while left:
                if left >= 11:
                    run = min(left, 138)
                    self.put(_OWN_CODES[18] | run - 11 << 3, 10)
                elif left >= 3:
                    run = left
                    self.put(_OWN_CODES[17] | run - 3 << 4, 7)
                else:
                    run = 1
                    self.put(_OWN_CODES[0], 3)
                left -= run
            if n:
                values.append(_OWN_CODES[n])
                sizes.append(4)
            last = at + 1

    def done(self) -> bytes:
        sizes = np.array(self.sizes, np.int64)
        return pack_bits(np.array(self.values, np.int64), sizes)


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of given bit sizes (up to 14) one after another, lowest bit first."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    starts = ends - sizes
    word = (values.astype(np.uint64) << (starts & 7).astype(np.uint64)).astype(np.uint64)
    out = np.zeros((total + 7) // 8 + 4, np.int64)
    for k in range(3):  # values of different starts never share a bit, so sums are unions
        out[: len(out)] += np.bincount((starts >> 3) + k, weights=(word >> np.uint64(8 * k) & np.uint64(255)).astype(float), minlength=len(out)).astype(np.int64)[: len(out)]
    return out[: (total + 7) // 8].astype(np.uint8).tobytes()


def riff(stream: bytes) -> bytes:
    body = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def split_run(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distances from 1 on; the inverse of _run()."""
    v = values.astype(np.int64) - 1
    high = np.frexp(np.maximum(v, 1).astype(float))[1].astype(np.int64) - 1
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(extra, 0) & 1)), v & ((1 << extra) - 1), extra


_NONE = (np.zeros(0, np.int64),) * 3


def references(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, distances) of back-references to the last place with the same _SEED samples, first come first served."""
    n = len(flat) - _SEED + 1
    if n < 2:
        return _NONE
    seeds = np.ndarray((n,), "<u8", np.ascontiguousarray(flat), strides=(1,))
    keys = (seeds * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n, dtype=np.uint64)
    keys.sort()
    place = (keys & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    same = seeds[place[1:]] == seeds[place[:-1]]
    far = np.zeros(n, np.int64)
    far[place[1:][same]] = (place[1:] - place[:-1])[same]
    first = np.flatnonzero((far > 0) & (far != np.append(0, far[:-1])))
    edges = np.append(np.flatnonzero(np.diff(far)) + 1, n)
    ends = edges[np.searchsorted(edges, first, "right")] + _SEED - 1
    out, at = [], 0
    for start, end, d in zip(first.tolist(), ends.tolist(), far[first].tolist(), strict=True):
        start = max(start, at)
        while end - start >= _SEED:
            size = min(end - start, _LONGEST)
            out.append((start, size, d))
            start = at = start + size
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _stream(flat: np.ndarray, refs) -> tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bits of a stream of green literals and references, its values and their sizes, and the prefix codes of green and distance."""
    starts, sizes, far = refs
    counts = np.zeros(_LITERALS + _LENGTHS, np.int64)
    if not len(starts):
        counts[:256] = np.bincount(flat, minlength=256)
        lengths = code_lengths(counts)
        if (lengths > 0).sum() < 2:
            none = np.zeros(0, np.int64)
            return 0, none, none, [lengths, _only(0, _FAR)]
        return int(counts @ lengths), canonical(lengths)[flat], lengths[flat], [lengths, _only(0, _FAR)]
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[starts] = 1
    edge[starts + sizes] -= 1
    plain = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    literals = flat[plain]
    sign, more, n_more = split_run(sizes)
    d_sign, d_more, d_n = split_run(far + 120)
    counts[:256] = np.bincount(literals, minlength=256)
    counts[_LITERALS:] = np.bincount(sign, minlength=_LENGTHS)
    lengths, d_lengths = code_lengths(counts), code_lengths(np.bincount(d_sign, minlength=_FAR))
    codes = canonical(lengths)
    if (d_lengths > 0).sum() < 2:
        d_codes, d_bits = np.zeros(_FAR, np.int64), np.zeros(_FAR, np.int64)
    else:
        d_codes, d_bits = canonical(d_lengths), d_lengths
    values, bits = (np.empty(len(plain) + 4 * len(starts), np.int64) for _ in range(2))
    slot = np.arange(len(plain)) + 4 * np.searchsorted(starts, plain)
    values[slot], bits[slot] = codes[literals], lengths[literals]
    slot = 4 * np.arange(len(starts)) + np.searchsorted(plain, starts)
    for k, (v, b) in enumerate(((codes[_LITERALS + sign], lengths[_LITERALS + sign]), (more, n_more), (d_codes[d_sign], d_bits[d_sign]), (d_more, d_n))):
        values[slot + k], bits[slot + k] = v, b
    return int(bits.sum()), values, bits, [lengths, d_lengths]


def _only(symbol: int, alphabet: int) -> np.ndarray:
    out = np.zeros(alphabet, np.int64)
    out[symbol] = 1
    return out


def encode_grey(samples: np.ndarray) -> bytes:
    """A greyscale image, 8-bit samples in rows, as a lossless WebP file.

    Up to 16 different samples become a palette, whose indices are packed into fewer pixels; more of them stay,
    under subtract-green. Back-references are used where they save bits, their codes' lengths included.
    """
    height, width = samples.shape
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (1, 1)):
        w.put(value, n)
    used = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))
    if 1 < len(used) <= 16:
        pack = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1
        w.put(_PALETTE, 2)
        w.put(len(used) - 1, 8)
        w.put(0, 1)  # no colour cache in the palette's image
        steps = np.diff(used, prepend=0)
        table = code_lengths(np.bincount(steps, minlength=_LITERALS + _LENGTHS))
        alpha = code_lengths(np.bincount([255, 0], minlength=256))
        for code in (table, table[:256], table[:256], alpha, _only(0, _FAR)):
            w.prefix(code)
        codes, a_codes = canonical(table), canonical(alpha)
        for k, step in enumerate(steps.tolist()):  # green, red, blue and alpha of each entry less the one before
            for _ in range(3):
                w.put(int(codes[step]), int(table[step]) if (table > 0).sum() > 1 else 0)
            w.put(int(a_codes[0 if k else 255]), 1)
        bits = 8 >> pack
        index = np.zeros((height, _up(width, pack) << pack), np.int64)
        index[:, :width] = np.searchsorted(used, samples)
        flat = (index.reshape(height, -1, 1 << pack) << np.arange(0, 8, bits)).sum(2).astype(np.uint8).reshape(-1)
    else:
        w.put(_GREEN, 2)
        flat = samples.reshape(-1)
    for _ in range(3):  # no further transform, no colour cache, no further prefix codes
        w.put(0, 1)
    refs, best = references(flat), None
    if len(refs[0]):
        best = _stream(flat, refs)
        own = np.bincount(flat, minlength=1)
        own = own[own > 0]
        if best[0] + 8 * (best[3][1] > 0).sum() + 120 > own @ np.log2(len(flat) / own):  # no code of literals alone takes less than the latter
            best = min(best, _stream(flat, _NONE), key=lambda s: s[0] + 8 * sum((c > 0).sum() for c in s[3]))
    _, values, sizes, (green, far) = best or _stream(flat, _NONE)
    w.prefix(green)
    for only in (0, 0, 255):  # red and blue less green, alpha
        w.put(0b101 | only << 3, 11)
    w.prefix(far)
    head, head_sizes = np.array(w.values, np.int64), np.array(w.sizes, np.int64)
    return riff(pack_bits(np.concatenate([head, values]), np.concatenate([head_sizes, sizes])))


# Codes of one symbol for red and blue less green and for alpha, as the encoder writes them.
_GREY_CODES = 0b101 | 0b101 << 11 | (0b101 | 255 << 3) << 22


class _Header:
    """Of a greyscale stream as encode_grey() makes it: shape, palette, the codes of green and distance and where pixels begin; else no code."""

    def __init__(self, stream: bytes):
        bits = Bits(stream)
        bits.read(8)
        self.full, self.height = bits.read(14) + 1, bits.read(14) + 1
        self.width, self.palette, self.pack, self.code = self.full, None, 0, None
        bits.read(4)
        kinds = []
        while bits.read(1):
            kinds.append(bits.read(2))
            if kinds == [_PALETTE]:
                n = bits.read(8) + 1
                self.palette = np.cumsum(_bytes(_read_pixels(bits, n, 1, False)), axis=0, dtype=np.uint8)
                self.pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
                self.width = _up(self.full, self.pack)
            elif kinds != [_GREEN]:
                return
        if len(kinds) != 1 or bits.read(1) or bits.read(1):
            return
        green = _read_prefix(bits, _LITERALS + _LENGTHS, list)
        if bits.read(33) == _GREY_CODES:
            far = _read_prefix(bits, _FAR, list)
            if max(max(green), max(far)) <= _MOST_BITS:
                self.code, self.far, self.at = green, far, bits.at
                self.only = green.index(max(green)) if sum(map(bool, green)) < 2 else None

    def samples(self, pixels: np.ndarray) -> np.ndarray:
        """Rows of grey samples from the stream's green samples."""
        pixels = pixels.reshape(self.height, self.width)
        if self.palette is None:
            return np.ascontiguousarray(pixels)
        image = np.zeros((self.height, self.width, 4), np.uint8)
        image[..., 1] = pixels
        return _grey(_undo_palette(image, self.palette, self.full, self.pack)[..., [2, 1, 0, 3]])


def _grey(rgba: np.ndarray) -> np.ndarray:
    if (rgba[..., 0] != rgba[..., 1]).any() or (rgba[..., 1] != rgba[..., 2]).any():
        raise ValueError("not a greyscale image")
    return np.ascontiguousarray(rgba[..., 1])


def _rebuilt(symbols: np.ndarray, at: list[int], sizes: list[int], far: list[int], total: int) -> np.ndarray:
    """Samples of one stream from its symbols and, in their order, the references among them; nothing follows one at an even place."""
    raw, out, last = symbols.astype(np.uint8).tobytes(), bytearray(), 0
    for k, size, d in zip(at, sizes, far, strict=True):
        if len(out) + k - last >= total:
            break
        out += raw[last:k]
        last = k + 2 - k % 2
        have = len(out)
        if d > have or have + size > total:
            raise ValueError("a back-reference leaves the image")
        if d >= size:
            out += out[have - d : have - d + size]
        else:
            out += (out[have - d :] * (size // d + 1))[:size]
    out += raw[last : last + total - len(out)]
    return np.frombuffer(out, np.uint8)


_TURNED = _BACKWARD[: 1 << _MOST_BITS] >> (16 - _MOST_BITS)


def _tables(lengths: np.ndarray) -> np.ndarray:
    """Of a row of code lengths for each stream: size << 9 | symbol for every run of _MOST_BITS bits, streams one after another."""
    used = lengths > 0
    lone = np.flatnonzero(used.sum(1) < 2)  # one symbol takes no bits
    row, symbol = np.nonzero(used)
    size = lengths[row, symbol].astype(np.int64)
    order = np.lexsort([symbol, size, row])
    row, symbol, size = row[order], symbol[order], size[order]
    room = 1 << (_MOST_BITS - size)
    alone = np.isin(row, lone)
    room[alone] = 1 << _MOST_BITS
    size[alone] = 0
    if (np.bincount(row, weights=room, minlength=len(lengths))[used.any(1)] != 1 << _MOST_BITS).any():
        raise ValueError("a prefix code is not complete")
    out = np.zeros((len(lengths), 1 << _MOST_BITS), np.uint16)
    out[used.any(1)] = np.repeat((size << 9 | symbol).astype(np.uint16), room).reshape(-1, 1 << _MOST_BITS)
    return out[:, _TURNED].reshape(-1)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """Greyscale samples of many files; streams of encode_grey's kind are decoded a symbol of each at a time."""
    streams = [_payload(f) for f in files]
    heads = [_Header(s) for s in streams]
    out: list = [None] * len(files)
    fast = []
    for k, h in enumerate(heads):
        if h.code is None:
            out[k] = _grey(decode(files[k]))
        elif h.only is not None and h.only < _LITERALS:
            out[k] = h.samples(np.full(h.height * h.width, h.only, np.uint8))
        else:
            fast.append(k)
    if not fast:
        return out
    sizes = np.array([heads[k].width * heads[k].height for k in fast])
    joined = b"".join(streams[k] for k in fast) + b"\0" * (8 * _STEPS)
    starts = np.cumsum([0] + [len(streams[k]) for k in fast[:-1]])
    window = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))  # eight bytes from every byte on
    place = 8 * starts + np.array([heads[k].at for k in fast])
    green, far = (_tables(np.array([getattr(heads[k], which) for k in fast], np.uint8)) for which in ("code", "far"))
    near = np.array([[0] * len(fast)] + [[max(1, x + y * heads[k].width) for k in fast] for x, y in _DISTANCES])
    mask = np.uint64((1 << _MOST_BITS) - 1)
    active, left = np.arange(len(fast)), sizes.copy()
    symbols, who, parts = [], [], []
    steps = 0
    while len(active):
        now, base, rest = place[active], active << _MOST_BITS, left[active]
        block = np.empty((_STEPS, len(active)), np.uint16)
        for t in range(0, _STEPS, 2):  # a literal and what follows fit in 57 bits; what follows a reference waits for the next bits
            bits = window[now >> 3] >> (now & 7).astype(np.uint64)
            size = np.zeros(len(active), np.int64)
            for k in (0, 1):
                e = green[base + (bits >> size.view(np.uint64) & mask).view(np.int64)]
                n_bits = (e >> 9).astype(np.int64)
                e &= 511
                if k:
                    n_bits[refs] = e[refs] = 0
                block[t + k] = e
                size += n_bits
                refs = np.flatnonzero(e >= _LITERALS)
                if not len(refs):
                    continue
                n, b, used = _runs(e[refs] - _LITERALS, bits[refs] >> size[refs].view(np.uint64))
                f = far[base[refs] + (b & mask).view(np.int64)]
                f_bits = f >> 9
                d, _, d_used = _runs(f & 511, b >> f_bits)
                d = np.where(d > 120, d - 120, near[np.minimum(d, 120), active[refs]])
                size[refs] += used + f_bits + d_used
                rest[refs] -= n - (1 if k else 2)
                parts.append((active[refs], np.full(len(refs), steps + t + k), n, d))
            now += size
        rest -= _STEPS
        place[active], left[active] = now, rest
        symbols.append(block)
        who.append(active)
        steps += _STEPS
        active = active[(rest > 0) & (now < 8 * (len(joined) - 8 * _STEPS))]
    if (left > 0).any():
        raise ValueError("the stream ends too early")
    every = np.zeros((steps, len(fast)), np.uint16)
    for k, (block, own) in enumerate(zip(symbols, who, strict=True)):
        every[k * _STEPS : (k + 1) * _STEPS, own] = block
    every = np.ascontiguousarray(every.T)
    if parts:
        owner, at, n, d = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(fast) + 1))
        at, n, d = (c[order].tolist() for c in (at, n, d))
    for r, k in enumerate(fast):
        if parts and edges[r + 1] > edges[r]:
            own = slice(edges[r], edges[r + 1])
            pixels = _rebuilt(every[r], at[own], n[own], d[own], int(sizes[r]))
        else:
            pixels = every[r, : sizes[r]].astype(np.uint8)
        out[k] = heads[k].samples(pixels)
    return out


_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(64)])
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(64)])
_MORE = (np.uint64(1) << _EXTRA.astype(np.uint64)) - np.uint64(1)


def _runs(symbol: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_run() of many: values, the bits after them, and how many they took."""
    extra = _EXTRA[symbol]
    return _LEAST[symbol] + (bits & _MORE[symbol]).view(np.int64), bits >> extra.view(np.uint64), extra
