"""Lossless WebP: writing and reading pixel arrays, as small helpers for media columns.

Reading decodes the prefix codes, back-references and colour cache of many images side by side: each image is a lane
with a bit position of its own, and one step gives every lane its next pixel, so a batch of small images costs a few
NumPy calls per pixel position. Transforms are then inverted in reverse order: colour palette (with bundled pixels),
subtracted green, cross-colour and the fourteen predictors, these along the wavefront of pixels whose neighbours
are known.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: the order in which code length code lengths are stored, and the chunk's signature byte.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Neighbours that the first 120 distance codes name, nearest first; to the left before to the right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
CACHE_FACTOR = 0x1E35A7BD
MOST_BITS = 10
#: Of written files: bits of their colour cache, colours up to which they have a palette, images written at a time (so many fit the cache of a core).
CACHE_BITS, BUNDLED, MOST_IMAGES = 8, 16, 64
_U = np.uint32


# ---------------------------------------------------------------- prefix codes


def _reversed(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in the other order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


_REVERSED = {n: _reversed(n) for n in range(16)}


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of complete prefix codes near the entropy, one code a row of counts.

    Rounded-up information, then symbols are shortened, the commonest first, while room is left.
    """
    order = np.argsort(-counts, axis=1, kind="stable")
    ranks = max(1, int((counts > 0).sum(1).max(initial=1)))
    order = order[:, :ranks]
    n = np.take_along_axis(counts, order, 1)
    used = n > 0
    total = np.maximum(1, n.sum(1, keepdims=True))
    length = np.where(used, np.clip(np.ceil(-np.log2(np.maximum(n, 1) / total) - 1e-9), 1, most), 0).astype(np.int64)
    room = (1 << most) - np.where(used, 1 << (most - length), 0).sum(1)
    if (room < 0).any():  # rare symbols were cut to `most` bits: lengthen others, rarest first
        for r in range(ranks - 1, -1, -1):
            for _ in range(most):
                over = (room < 0) & (length[:, r] > 0) & (length[:, r] < most)
                if not over.any():
                    break
                room += np.where(over, 1 << np.maximum(0, most - length[:, r] - 1), 0)
                length[:, r] += over
    live = np.flatnonzero((room > 0) & (used.sum(1) > 1))
    while len(live):
        own, left = length[live], room[live]
        for r in range(int((own > 0).sum(1).max())):
            x = own[:, r]
            gain = 1 << (most - x)
            fits = (x > 1) & (gain <= left)
            left -= gain * fits
            own[:, r] -= fits
        length[live], room[live] = own, left
        live = live[left > 0]
    out = np.zeros(counts.shape, np.int64)
    np.put_along_axis(out, order, length, 1)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes for code lengths, one code a row, bit-reversed as they stand in the stream."""
    order = np.argsort(np.where(lengths > 0, lengths, 99), axis=1, kind="stable")
    own = np.take_along_axis(lengths, order, 1)
    share = np.where(own > 0, 1 << (15 - own), 0)
    codes = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(codes, order, np.where(own > 0, _REVERSED[15][(np.cumsum(share, 1) - share) & 0x7FFF], 0), 1)
    return codes


def lookups(lengths: np.ndarray) -> list[np.ndarray]:
    """A table by the next bits for each row: symbol << 4 | length. A code with one symbol takes no bits."""
    single = (lengths > 0).sum(1) <= 1
    most = np.where(single, 0, lengths.max(1, initial=0))
    at = np.cumsum(1 << most) - (1 << most)
    flat = np.zeros(int((1 << most).sum()), np.uint16)
    flat[at[single]] = lengths[single].argmax(1) << 4
    row, symbol = np.nonzero(np.where(single[:, None], 0, lengths))
    own = lengths[row, symbol]
    times = 1 << (most[row] - own)
    if (np.bincount(row, times, len(lengths))[~single] != (1 << most)[~single]).any():
        raise ValueError("incomplete prefix code")
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    flat[np.repeat(at[row] + canonical(lengths)[row, symbol], times) + (nth << np.repeat(own, times))] = np.repeat(symbol << 4 | own, times)
    return np.split(flat, at[1:])


class BitReader:
    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def get(self, n: int) -> int:
        first = self.at >> 3
        got = int.from_bytes(self.data[first : first + 4], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got


# ---------------------------------------------------------------- side-by-side reading


@dataclass
class Lane:
    """One entropy-coded image: where its bits begin, its size, code groups, colour cache and group map."""

    at: int
    width: int
    count: int
    groups: list[list[np.ndarray]]
    cache_bits: int = 0
    map: np.ndarray | None = None
    map_bits: int = 0
    pixels: np.ndarray = field(default_factory=lambda: np.zeros(0, _U))
    end: int = 0


@dataclass
class Code:
    """A prefix code over `size` symbols, whose bits begin at `at`; reading it gives its table and where it ends."""

    at: int
    size: int
    table: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))
    end: int = 0


def read_codes(words: np.ndarray, codes: list[Code]) -> None:
    """Read the lengths of all codes side by side, one token of each at a step."""
    if not codes:
        return
    pos, size = np.array([c.at for c in codes], np.int64), np.array([c.size for c in codes])
    lengths = np.zeros((len(codes), int(size.max()) + 138), np.int64)
    ahead = words[pos >> 5] >> (pos & 31)
    simple = np.flatnonzero(ahead & 1)
    if len(simple):
        b = ahead[simple] >> 1
        two, wide = b & 1, 1 + 7 * (b >> 1 & 1)
        lengths[simple, (b >> 2) & ((1 << wide) - 1)] = 1
        other = np.flatnonzero(two)
        lengths[simple[other], (b[other] >> (2 + wide[other])) & 255] = 1
        pos[simple] += 3 + wide + 8 * two
    who = np.flatnonzero(~ahead & 1)
    if len(who):
        count = 4 + (ahead[who] >> 1 & 15)
        p = pos[who, None] + 5 + 3 * np.arange(19)
        inner = np.zeros((len(who), 19), np.int64)
        inner[:, LENGTH_ORDER] = np.where(np.arange(19) < count[:, None], (words[p >> 5] >> (p & 31)) & 7, 0)
        now = pos[who] + 5 + 3 * count
        b = words[now >> 5] >> (now & 31)
        wide = 2 + 2 * (b >> 1 & 7)
        left = np.where(b & 1, 2 + ((b >> 4) & ((1 << wide) - 1)), size[who])
        now += np.where(b & 1, 4 + wide, 1)
        tables = lookups(inner)
        mask = np.array([len(t) - 1 for t in tables])
        start, table = np.cumsum(mask + 1) - mask - 1, np.concatenate(tables).astype(np.int64)
        at, last, live = np.zeros(len(who), np.int64), np.full(len(who), 8), np.arange(len(who))
        while len(live):
            p = now[live]
            b = words[p >> 5] >> (p & 31)
            e = table[start[live] + (b & mask[live])]
            b, s = b >> (e & 15), e >> 4
            bits = np.where(s < 16, 0, np.where(s == 16, 2, np.where(s == 17, 3, 7)))
            times = np.where(s < 16, 1, np.where(s == 18, 11, 3) + (b & ((1 << bits) - 1)))
            lengths[who[live], at[live]] = np.where(s < 16, s, 0)
            for i in np.flatnonzero(s == 16).tolist():
                j = live[i]
                lengths[who[j], at[j] : at[j] + times[i]] = last[j]
            last[live] = np.where((s > 0) & (s < 16), s, last[live])
            at[live] += times
            now[live] += (e & 15) + bits
            left[live] -= 1
            live = live[(at[live] < size[who[live]]) & (left[live] > 0)]
        pos[who] = now
    widest = int(size.max())
    for code, table, end in zip(codes, lookups(lengths[:, :widest]), pos.tolist()):
        code.table, code.end = table, end


def _prefix_value(symbol: np.ndarray, peek, skip) -> np.ndarray:
    """Length or distance of prefix symbols, with their extra bits."""
    extra = np.maximum(0, (symbol - 2) >> 1)
    base = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra)
    got = base + (peek() & ((1 << extra) - 1))
    skip(extra)
    return got + 1


def read_lanes(words: np.ndarray, lanes: list[Lane]) -> None:
    """Decode all lanes; `words` holds the 64 bits that begin at every 32nd bit of the streams laid end to end."""
    if not lanes:
        return
    order = sorted(range(len(lanes)), key=lambda i: -lanes[i].count)
    own = [lanes[i] for i in order]
    many = len(own)
    tables, offset, at = [], {}, 0
    first = np.zeros(many, np.int64)
    places, masks, n = [], [], 0
    for j, lane in enumerate(own):
        first[j] = n
        for group in lane.groups:
            row, wide = [], []
            for t in group:
                key = id(t) if len(t) > 1 else int(t[0])
                if key not in offset:
                    offset[key] = at
                    tables.append(t)
                    at += len(t)
                row.append(offset[key])
                wide.append(len(t) - 1)
            places.append(row)
            masks.append(wide)
            n += 1
    table = np.concatenate(tables).astype(np.int64)
    places, masks = np.array(places, np.int64), np.array(masks, np.int64)
    # Green, red and blue of a literal come from one look at the stream where their codes are short enough.
    quick = not masks[:, 3].any() and int(np.log2(masks[:, :3] + 1).sum(1).max()) <= 32
    maps = any(lane.map is not None for lane in own)
    caches = any(lane.cache_bits for lane in own)
    count = np.array([lane.count for lane in own])
    live = np.searchsorted(-count, -np.arange(count[0] if many else 0) - 1, side="right").tolist()
    pos, width = np.array([lane.at for lane in own], np.int64), np.array([lane.width for lane in own])
    out = np.zeros((len(live), many), np.int64)
    left, back = np.zeros(many, np.int64), np.ones(many, np.int64)
    near = np.array(NEAR)
    if caches:
        bits = np.array([lane.cache_bits for lane in own])
        start = np.cumsum(np.where(bits > 0, 1 << bits, 1)) - np.where(bits > 0, 1 << bits, 1)
        cache = np.zeros(int(np.where(bits > 0, 1 << bits, 1).sum()), np.int64)
    group = first.copy()
    place, mask = places[group], masks[group]
    column, wide = np.ascontiguousarray(place.T), np.ascontiguousarray(mask.T)
    alpha = (table[place[:, 3]] >> 4) << 24

    def take(who: np.ndarray, which: int) -> np.ndarray:
        p = pos[who]
        e = table[place[who, which] + ((words[p >> 5] >> (p & 31)) & mask[who, which])]
        pos[who] += e & 15
        return e >> 4

    for t, n in enumerate(live):
        if maps:
            for j in range(n):
                lane = own[j]
                if lane.map is not None:
                    y, x = divmod(t, lane.width)
                    group[j] = first[j] + lane.map[y >> lane.map_bits, x >> lane.map_bits]
            place, mask = places[group], masks[group]
            column, wide, alpha = place.T, mask.T, (table[place[:, 3]] >> 4) << 24
        p = pos[:n]
        ahead = words[p >> 5] >> (p & 31)
        e = table[column[0][:n] + (ahead & wide[0][:n])]
        busy = left[:n] > 0
        symbol = np.where(busy, 256, e >> 4)
        pixel = symbol << 8
        if quick:
            size = e & 15
            red = table[column[1][:n] + (ahead >> size & wide[1][:n])]
            taken = size + (red & 15)
            blue = table[column[2][:n] + (ahead >> taken & wide[2][:n])]
            taken += blue & 15
            pos[:n] += np.where(symbol < 256, taken, np.where(busy, 0, size))
            pixel |= (red >> 4) << 16 | blue >> 4 | alpha[:n]
        else:
            pos[:n] += np.where(busy, 0, e & 15)
            who = np.flatnonzero(symbol < 256)
            red = take(who, 1)
            blue = take(who, 2)
            pixel[who] |= red << 16 | blue | take(who, 3) << 24
        other = np.flatnonzero(symbol >= 256)
        if len(other):
            new = other[(symbol[other] < 280) & ~busy[other]]
            if len(new):
                skip = lambda extra: np.add.at(pos, new, extra)
                peek = lambda: words[pos[new] >> 5] >> (pos[new] & 31)
                left[new] = _prefix_value(symbol[new] - 256, peek, skip)
                code = _prefix_value(take(new, 4), peek, skip)
                x, y = near[np.minimum(code, 120) - 1].T
                back[new] = np.where(code > 120, code - 120, np.maximum(1, x + y * width[new]))
                if (back[new] > t).any():
                    raise ValueError("a back-reference leaves the image")
            copying = other[left[other] > 0]
            pixel[copying] = out[t - back[copying], copying]
            left[copying] -= 1
            kept = other[symbol[other] >= 280]
            if len(kept):
                pixel[kept] = cache[start[kept] + symbol[kept] - 280]
        out[t, :n] = pixel
        if caches:
            with_cache = np.flatnonzero(bits[:n])
            key = ((pixel[with_cache] * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - bits[with_cache])
            cache[start[with_cache] + key] = pixel[with_cache]
    for j, lane in enumerate(own):
        lane.pixels, lane.end = out[: lane.count, j].astype(_U), int(pos[j])


# ---------------------------------------------------------------- transforms


def channels(pixels: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue along the last axis."""
    return np.stack([(pixels >> _U(s)) & _U(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def joined(parts: np.ndarray) -> np.ndarray:
    p = (parts & 255).astype(_U)
    return p[..., 0] << _U(24) | p[..., 1] << _U(16) | p[..., 2] << _U(8) | p[..., 3]


def predictions(left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """Predicted channels by mode from the left, top, top-right and top-left neighbours."""
    half = lambda a, b: (a + b) >> 1
    plane = left + top - corner
    nearer = np.abs(plane - left).sum(-1) < np.abs(plane - top).sum(-1)
    mean = half(left, top)
    # Division towards zero, as for signed integers.
    step = mean - corner
    step = np.where(step < 0, -(-step // 2), step // 2)
    black = np.zeros_like(left)
    black[..., 0] = 255
    every = [black, left, top, right, corner, half(half(left, right), top), half(left, corner), mean, half(corner, top), half(top, right), half(half(left, corner), half(top, right)), np.where(nearer[..., None], left, top), plane.clip(0, 255), (mean + step).clip(0, 255)]
    return np.choose(np.minimum(mode, 15)[..., None], [*every, black, black])


def _waves(h: int, w: int):
    """Pixels (y, x) off the first row and column, in groups whose neighbours lie in earlier groups."""
    for s in range(3, w + 2 * h):
        y = np.arange(max(1, (s - w + 2) // 2), min(h - 1, (s - 1) // 2) + 1)
        if len(y):
            yield y, s - 2 * y


def predict_inverse(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = pixels.shape
    out = channels(pixels)
    out[0, 0, 0] = (out[0, 0, 0] + 255) & 255
    out[0] = np.cumsum(out[0], 0) & 255
    out[:, 0] = np.cumsum(out[:, 0], 0) & 255
    green = channels(modes)[..., 2]
    if (green == 1).all() or (green == 2).all():  # a sum along one axis
        if green.flat[0] == 1:
            out[1:] = np.cumsum(out[1:], 1)
        else:
            out[:, 1:] = np.cumsum(out[:, 1:], 0)
        return joined(out)
    for y, x in _waves(h, w):
        after = np.where(x + 1 < w, x + 1, 0), np.where(x + 1 < w, y - 1, y)
        guess = predictions(out[y, x - 1], out[y - 1, x], out[after[1], after[0]], out[y - 1, x - 1], green[y >> bits, x >> bits])
        out[y, x] = (out[y, x] + guess) & 255
    return joined(out)


def _signed(x: np.ndarray) -> np.ndarray:
    return x - 256 * (x > 127)


def cross_colour(pixels: np.ndarray, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take away (-1) what green says of red, and green and red of blue."""
    h, w = pixels.shape
    c = channels(pixels)
    e = _signed(channels(elements).repeat(1 << bits, 0).repeat(1 << bits, 1)[:h, :w])
    green, red = _signed(c[..., 2]), c[..., 1].copy()
    c[..., 1] = (red + sign * ((e[..., 3] * green) >> 5)) & 255
    full = _signed(c[..., 1] if sign == 1 else red)
    c[..., 3] = (c[..., 3] + sign * (((e[..., 2] * green) >> 5) + ((e[..., 1] * full) >> 5))) & 255
    return joined(c)


def green_added(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = channels(pixels)
    c[..., 1] += sign * c[..., 2]
    c[..., 3] += sign * c[..., 2]
    return joined(c)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def palette_inverse(pixels: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    pack = _bundle(len(colours))
    index = ((pixels >> _U(8)) & _U(255)).astype(np.int64)
    if pack:
        each = 8 >> pack
        index = ((index[:, :, None] >> (np.arange(1 << pack) * each)) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    return np.concatenate([colours, np.zeros(256, _U)])[index]


# ---------------------------------------------------------------- files


@dataclass
class _Image:
    width: int
    height: int
    transforms: list
    main: Lane


def _shrunk(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _open(data: bytes, base: int):
    """Parse a file's headers. Yields each code and each image inside that must be read first; returns the file's own image."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    r = BitReader(data, 21 * 8)
    width, height, _, version = r.get(14) + 1, r.get(14) + 1, r.get(1), r.get(3)
    if version:
        raise ValueError("unknown version")

    def lane(w: int, h: int, main: bool):
        cache = r.get(4) if r.get(1) else 0
        groups, area, size = 1, None, 0
        if main and r.get(1):
            size = r.get(3) + 2
            inner = yield from inside(_shrunk(w, size), _shrunk(h, size))
            area = ((inner >> _U(8)) & _U(0xFFFF)).astype(np.int64)
            groups = int(area.max()) + 1
        tables: list[list[np.ndarray]] = []
        for _ in range(groups):
            tables.append([])
            for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40):
                one = Code(base + r.at, n)
                yield one
                r.at = one.end - base
                tables[-1].append(one.table)
        return Lane(base + r.at, w, w * h, tables, cache, area, size)

    def inside(w: int, h: int):
        one = yield from lane(w, h, False)
        yield one
        r.at = one.end - base
        return one.pixels.reshape(h, w)

    transforms, w = [], width
    while r.get(1):
        kind = r.get(2)
        if kind == SUBTRACT_GREEN:
            transforms.append((kind, None, w))
        elif kind == PALETTE:
            n = r.get(8) + 1
            colours = joined(np.cumsum(channels((yield from inside(n, 1))[0]), 0))
            transforms.append((kind, colours, w))
            w = _shrunk(w, _bundle(n))
        else:
            bits = r.get(3) + 2
            side = yield from inside(_shrunk(w, bits), _shrunk(height, bits))
            transforms.append((kind, (side, bits), w))
    main = yield from lane(w, height, True)
    return _Image(width, height, transforms, main)


def _parsed(files: list[bytes]) -> list[_Image]:
    """Images with their pixels as coded, before transforms are inverted."""
    # Each stream starts at a whole 32-bit word, with room to read past its end.
    starts, at = [], 0
    for f in files:
        starts.append(at)
        at += -(-(len(f) + 12) // 4) * 4
    flat = np.zeros(at + 8, np.uint8)
    for s, f in zip(starts, files):
        flat[s : s + len(f)] = np.frombuffer(f, np.uint8)
    low = flat.view("<u4").astype(np.int64)
    words = low[:-1] | (low[1:] & 0x7FFFFFFF) << 32
    images: list = [None] * len(files)
    waiting = {i: _open(f, 8 * s) for i, (f, s) in enumerate(zip(files, starts))}
    while waiting:
        wanted: list = []
        for i, parse in list(waiting.items()):
            try:
                wanted.append(next(parse))
            except StopIteration as done:
                images[i] = done.value
                del waiting[i]
        read_codes(words, [w for w in wanted if isinstance(w, Code)])
        read_lanes(words, [w for w in wanted if isinstance(w, Lane)])
    read_lanes(words, [i.main for i in images])
    return images


def decode(files: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels (height, width) of lossless WebP files, read side by side."""
    images = _parsed(files) if files else []
    out = []
    for image in images:
        pixels = image.main.pixels.reshape(image.height, image.main.width)
        for kind, what, width in reversed(image.transforms):
            if kind == PALETTE:
                pixels = palette_inverse(pixels, what, width)
            elif kind == SUBTRACT_GREEN:
                pixels = green_added(pixels, 1)
            elif kind == CROSS_COLOUR:
                pixels = cross_colour(pixels, *what, 1)
            else:
                pixels = predict_inverse(pixels, *what)
        out.append(pixels)
    return out


# ---------------------------------------------------------------- side-by-side writing


class Fields:
    """Bit fields of many files. Each file's bits are its fields in the order in which they were put."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, owner: np.ndarray, values, sizes) -> None:
        self.parts.append((owner, np.broadcast_to(values, owner.shape), np.broadcast_to(sizes, owner.shape)))

    def done(self, files: int) -> list[bytes]:
        owner = np.concatenate([p[0] for p in self.parts]).astype(np.uint16 if files < 1 << 16 else np.int64)
        order = np.argsort(owner, kind="stable")
        owner = owner[order].astype(np.int64)
        values, sizes = (np.concatenate([p[i] for p in self.parts])[order] for i in (1, 2))
        after = np.cumsum(sizes)
        ends = after[np.searchsorted(owner, np.arange(files), side="right") - 1]
        length = -(-np.diff(ends, prepend=0) // 8)
        start = np.cumsum(length) - length
        at = after - sizes + (8 * start - np.concatenate([[0], ends[:-1]]))[owner]
        wide = values.astype(np.uint64) << (at & 31).astype(np.uint64)
        n = int(length.sum()) // 4 + 3
        words = np.bincount(at >> 5, (wide & np.uint64(0xFFFFFFFF)).astype(float), n) + np.bincount((at >> 5) + 1, (wide >> np.uint64(32)).astype(float), n)
        flat = words.astype(np.uint32).tobytes()
        return [flat[s : s + k] for s, k in zip(start.tolist(), length.tolist())]


def _put_codes(out: Fields, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for each row of counts; the codes and their lengths in bits."""
    several = (counts > 0).sum(1) > 1
    lengths, codes = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64)
    one = np.flatnonzero(~several)
    out.put(owner[one], 5 | counts[one].argmax(1) << 3, 11)
    rows = np.flatnonzero(several)
    if not len(rows):
        return codes, lengths
    own = lengths[rows] = code_lengths(counts[rows])
    codes[rows] = canonical(own)
    # Runs of equal lengths, without the zeros at a row's end.
    width = own.shape[1]
    flat = own.ravel()
    edge = np.flatnonzero((np.diff(flat, prepend=-1) != 0) | (np.arange(len(flat)) % width == 0))
    size, value, row = np.diff(np.append(edge, len(flat))), flat[edge], edge // width
    keep = (value > 0) | ((edge + size) % width > 0)
    size, value, row = size[keep], value[keep], row[keep]
    whole, rest = size // 138, size % 138
    tokens = np.where(value > 0, size, whole + np.where(rest >= 3, 1, rest))
    of = np.repeat(np.arange(len(size)), tokens)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(tokens) - tokens, tokens)
    zero, r = value[of] == 0, np.where(nth < whole[of], 138, rest[of])
    symbol = np.where(~zero, value[of], np.where(r >= 11, 18, np.where(r >= 3, 17, 0)))
    extra, bits = np.where(symbol == 18, r - 11, np.where(symbol == 17, r - 3, 0)), np.where(symbol == 18, 7, np.where(symbol == 17, 3, 0))
    at = row[of]
    inner_counts = np.bincount(at * 19 + symbol, minlength=19 * len(rows)).reshape(-1, 19)
    inner = code_lengths(inner_counts, 7)
    inner_codes = canonical(inner)
    who, listed = owner[rows], inner[:, LENGTH_ORDER]
    out.put(who, 15 << 1, 5)
    for lo, hi in ((0, 10), (10, 19)):
        out.put(who, (listed[:, lo:hi] << (3 * np.arange(hi - lo))).sum(1), 3 * (hi - lo))
    out.put(who, (np.bincount(at, minlength=len(rows)) - 2) << 4 | 4 << 1 | 1, 14)
    single = (inner > 0).sum(1) == 1
    taken = np.where(single[at], 0, inner[at, symbol])
    out.put(who[at], np.where(single[at], 0, inner_codes[at, symbol]) | extra << taken, taken + bits)
    return codes, lengths


def _references(flat: np.ndarray, image: np.ndarray, least: int = 3, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-overlapping (position, length, distance) of runs seen before in the same image, by equal pairs of pixels."""
    inside = np.flatnonzero(image[1:] == image[:-1])
    low = (flat & _U(0xFFFFFF)).astype(np.int64)
    key = image[inside] << 48 | low[inside] << 24 | low[inside + 1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    back = np.zeros(len(flat), np.int64)
    back[inside[order[1:][same]]] = inside[order[1:][same]] - inside[order[:-1][same]]
    # A run keeps its distance; it reaches one pixel beyond its last pair.
    begins = np.flatnonzero((back > 0) & (back != np.concatenate([[0], back[:-1]])))
    stops = np.flatnonzero((back > 0) & (back != np.append(back[1:], 0))) + 2
    start = np.maximum(begins, np.concatenate([[0], np.maximum.accumulate(stops)[:-1]])) if len(begins) else begins
    size = np.minimum(stops - start, most)
    kept = size >= least
    return start[kept], size[kept], back[begins[kept]]


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and extra bits of lengths or distances."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1))[1] - 1
    extra = np.where(v < 4, 0, high - 1)
    symbol = np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    return symbol, np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def _counts(image: np.ndarray, symbols: np.ndarray, images: int, size: int) -> np.ndarray:
    return np.bincount(image * size + symbols, minlength=images * size).reshape(images, size)


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that symbols so often seen take, one set a row."""
    n = counts.sum(1)
    return n * np.log2(np.maximum(n, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1)


def _put_images(out: Fields, owner: np.ndarray, pixels: list[np.ndarray], main: bool, cache_bits: int = CACHE_BITS) -> None:
    """Entropy-code images, one a file; each uses a colour cache where that takes fewer bits by estimate."""
    n, sizes = len(pixels), np.array([p.size for p in pixels])
    flat, image = np.concatenate([p.ravel() for p in pixels]), np.repeat(np.arange(n), sizes)
    size = dist = np.zeros(len(flat), np.int64)
    at, hit = np.arange(len(flat)), np.zeros(len(flat), bool)
    if main:
        where, long, far = _references(flat, image)
        size, dist, inside = size.copy(), size.copy(), np.zeros(len(flat) + 1, np.int64)
        size[where], dist[where] = long, far
        np.add.at(inside, where + 1, 1)
        np.add.at(inside, where + long, -1)
        at = np.flatnonzero(np.cumsum(inside)[:-1] == 0)
        key = (((flat.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
        slot = image << cache_bits | key
        order = np.argsort(slot, kind="stable")
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
        key = key[at]
    size, dist, hit, own, c = size[at], dist[at], hit[at], image[at], channels(flat[at])
    ref = size > 0
    l_symbol, l_extra, l_bits = _prefixed(size[ref])
    d_symbol, d_extra, d_bits = _prefixed(dist[ref] + 120)
    hit &= ~ref
    green, rest = c[:, 2].copy(), (1, 3, 0)
    green[ref] = 256 + l_symbol
    plain = ~ref
    tall = 280 + ((1 << cache_bits) if main else 0)
    by_green = _counts(own, green, n, tall)
    if main:
        cached = np.where(hit, 280 + key, green)
        other = plain & ~hit
        by_cached = _counts(own, cached, n, tall)
        # A hit saves what red and blue take on average; the used symbols' lengths take about four bits each.
        saved = sum(_entropy(t) for t in (_counts(own[plain], c[plain, ch], n, 256) for ch in (1, 3))) / np.maximum(1, np.bincount(own[plain], minlength=n))
        cost = lambda which: _entropy(which) + 4 * (which > 0).sum(1)
        cache = cost(by_cached) < cost(by_green) + saved * np.bincount(own[hit], minlength=n)
        by_green[cache] = by_cached[cache]
        green, plain = np.where(cache[own], cached, green), np.where(cache[own], other, plain)
        out.put(owner, np.where(cache, cache_bits << 1 | 1, 0), np.where(cache, 5, 1))
    out.put(owner, 0, 1)  # Without a cache in a side image, without a map of code groups in a main one.
    codes, lengths = _put_codes(out, owner, by_green)
    value, bits = codes[own, green], lengths[own, green]
    value[ref] |= l_extra << bits[ref]
    bits[ref] += l_bits
    late, late_bits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for ch in rest:
        codes, lengths = _put_codes(out, owner, _counts(own[plain], c[plain, ch], n, 256))
        k = np.where(plain, lengths[own, c[:, ch]], 0)
        if ch:
            value, bits = value | np.where(plain, codes[own, c[:, ch]] << bits, 0), bits + k
        else:
            late, late_bits = np.where(plain, codes[own, c[:, ch]], 0), k
    codes, lengths = _put_codes(out, owner, _counts(own[ref], d_symbol, n, 40))
    k = lengths[own[ref], d_symbol]
    late[ref], late_bits[ref] = codes[own[ref], d_symbol] | d_extra << k, k + d_bits
    # A token's second field, where it has one, follows the first.
    second = late_bits > 0
    times = 1 + second
    place = np.cumsum(times) - times
    fields = np.zeros((3, int(times.sum())), np.int64)
    fields[:, place] = owner[own], value, bits
    fields[:, place[second] + 1] = owner[own[second]], late[second], late_bits[second]
    out.put(*fields)


def _put_constant(out: Fields, owner: np.ndarray, green, red=0, blue=0) -> None:
    """Side images that are one colour all over: codes of one symbol, so no bits for pixels."""
    out.put(owner, 0, 1)
    for symbol in (green, red, blue, 255, 0):
        out.put(owner, 5 | np.asarray(symbol) << 3, 11)


def _chosen(c: np.ndarray, first: np.ndarray, image: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per image the prediction (0 none, 1 left, 2 top) and what red and blue are told from, by estimated bits.

    c: rows of red, green, blue of all images, first: whether a row is an image's first. Returns the residual rows,
    the predictions, red's choice (1: green) and blue's choice (1: green, 2: red).
    """
    left, top = c.copy(), c.copy()
    left[:, 1:] -= c[:, :-1]
    left[1:, 0] -= np.where(first[1:, None], 0, c[:-1, 0])
    top[1:] -= np.where(first[1:, None, None], 0, c[:-1])
    top[first] = left[first]
    owner = np.repeat(image, c.shape[1])
    bits, told, residuals = [], [], (c, left, top)
    for x in residuals:
        r, g, b = (x[..., i].ravel() for i in range(3))
        of = [_entropy(_counts(owner, s, n, 256)) for s in (g, r, r - g, b, b - g, b - r)]
        red, blue = np.stack(of[1:3]), np.stack(of[3:])
        # What a transform's own header takes.
        side = np.where((red.argmin(0) == 0) & (blue.argmin(0) == 0), 0, 62)
        bits.append(of[0] + red.min(0) + blue.min(0) + side)
        told.append((red.argmin(0), blue.argmin(0)))
    bits[1] = bits[1] + 62
    bits[2] = bits[2] + 62
    mode = np.stack(bits).argmin(0)
    red, blue = (np.choose(mode, [t[i] for t in told]) for i in (0, 1))
    out = np.where((mode[image] == 0)[:, None, None], c, np.where((mode[image] == 1)[:, None, None], left, top))
    r, g, b = out[..., 0].copy(), out[..., 1], out[..., 2].copy()
    how = blue[image][:, None]
    out[..., 2] = b - np.where(how == 1, g, np.where(how == 2, r, 0))
    out[..., 0] = r - np.where(red[image][:, None] == 1, g, 0)
    return out, mode, red, blue


def encode(images: list[np.ndarray]) -> list[bytes]:
    """Lossless WebP files of opaque ARGB images (height, width), all of one width, written side by side.

    Each file uses what its own estimate favours: a palette for at most 16 colours, else a prediction from the left or
    the top, red and blue told from green or red by the cross-colour transform (or by subtracting green), a colour
    cache; and back-references and prefix codes always.
    """
    out: list[bytes] = []
    for lo in range(0, len(images), MOST_IMAGES):
        out += _encoded(images[lo : lo + MOST_IMAGES])
    return out


def _encoded(images: list[np.ndarray]) -> list[bytes]:
    n, width = len(images), images[0].shape[1]
    height = np.array([len(p) for p in images])
    image, every = np.repeat(np.arange(n), height), np.arange(n)
    whole = np.concatenate(images)
    colour = np.sort(np.repeat(image, width).astype(np.int64) << 32 | whole.ravel())
    fresh = np.diff(colour, prepend=-1) != 0
    few = np.bincount(colour[fresh] >> 32, minlength=n) <= BUNDLED
    fields = Fields()
    fields.put(every, width - 1, 14)
    fields.put(every, (height - 1) | 1 << 14, 18)
    c = np.stack([(whole >> _U(s)).astype(np.uint8) for s in (16, 8, 0)], -1)
    c, mode, red, blue = _chosen(c, np.diff(image, prepend=-1) != 0, image, n)
    mode[few] = red[few] = blue[few] = 0
    who = np.flatnonzero(mode)
    fields.put(who, 1 | PREDICTOR << 1 | 7 << 3, 6)
    _put_constant(fields, who, mode[who])
    green = (red == 1) & (blue == 1)
    fields.put(np.flatnonzero(green), 1 | SUBTRACT_GREEN << 1, 3)
    who = np.flatnonzero(~green & ((red > 0) | (blue > 0)))
    fields.put(who, 1 | CROSS_COLOUR << 1 | 7 << 3, 6)
    # An element of 32 adds the whole of the other channel.
    _put_constant(fields, who, 32 * (blue[who] == 1), 32 * (blue[who] == 2), 32 * (red[who] == 1))
    alpha = np.where(mode > 0, 0, 255)[image].astype(_U)[:, None]
    left = alpha << _U(24) | c[..., 0].astype(_U) << _U(16) | c[..., 1].astype(_U) << _U(8) | c[..., 2]
    coded = np.split(left, np.cumsum(height)[:-1])
    listed = []
    for i in np.flatnonzero(few).tolist():
        colours, index = np.unique(images[i], return_inverse=True)
        parts, pack = channels(colours), _bundle(len(colours))
        listed.append((i, len(colours), joined(np.diff(parts, axis=0, prepend=0 * parts[:1]))))
        index = index.reshape(images[i].shape)
        index = np.pad(index, ((0, 0), (0, (_shrunk(width, pack) << pack) - width))).reshape(len(index), -1, 1 << pack)
        coded[i] = (index << (np.arange(1 << pack) * (8 >> pack))).sum(-1).astype(_U) << _U(8) | _U(0xFF000000)
    if listed:
        who = np.array([i for i, *_ in listed])
        fields.put(who, np.array([k for _, k, _ in listed]) - 1 << 3 | 1 | PALETTE << 1, 11)
        _put_images(fields, who, [x for *_, x in listed], False)
    fields.put(every, 0, 1)
    _put_images(fields, every, coded, True)
    out = []
    for bits in fields.done(n):
        body = bytes([SIGNATURE]) + bits
        chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
        out.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return out


def split(media: bytes) -> list[bytes]:
    """The files laid end to end in a column's value."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + n])
        at += n
    return out
