"""A plain writer of lossless WebP, one image at a time, with every part of the format: files for the reader to read."""

import struct

import numpy as np

from tallyforge.llm.webp import CACHE_FACTOR, CROSS_COLOUR, LENGTH_ORDER, NEAR, PALETTE, SIGNATURE, SUBTRACT_GREEN, _U, _bundle, _REVERSED, _shrunk, channels, cross_colour, green_added, joined, predictions
MOST_BITS = 11


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes for code lengths, bit-reversed as they stand in the stream."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    share = 1 << (15 - lengths[order])
    codes[order] = _REVERSED[15][(np.cumsum(share) - share) & 0x7FFF]
    return codes


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of a complete prefix code near the entropy: rounded-up information, then shortened while room is left."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        out[used] = 1
        return out
    n = counts[used].astype(float)
    need = np.clip(np.ceil(-np.log2(n / n.sum()) - 1e-9).astype(np.int64), 1, most)
    order = np.argsort(-n, kind="stable")
    lengths, room = need[order].tolist(), 1 << most
    room -= sum(1 << (most - x) for x in lengths)
    i = len(lengths) - 1
    while room < 0:  # rare symbols were cut to `most` bits: lengthen others, rarest first
        if lengths[i] < most:
            room += 1 << (most - lengths[i] - 1)
            lengths[i] += 1
        else:
            i -= 1
    while room:
        for i, x in enumerate(lengths):
            if x > 1 and 1 << (most - x) <= room:
                room -= 1 << (most - x)
                lengths[i] = x - 1
    out[used[order]] = lengths
    return out


class BitWriter:
    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[tuple[int, int]] = []

    def put(self, value: int, bits: int) -> None:
        self.few.append((value, bits))

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.few:
            few, self.few = np.array(self.few, np.int64), []
            self.values.append(few[:, 0])
            self.sizes.append(few[:, 1])
        self.values.append(values)
        self.sizes.append(sizes)

    def done(self) -> bytes:
        self.many(np.zeros(0, np.int64), np.zeros(0, np.int64))
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        at = np.repeat(np.cumsum(sizes) - sizes, sizes)
        bit = np.arange(int(sizes.sum())) - at
        return np.packbits(((np.repeat(values, sizes) >> bit) & 1).astype(np.uint8), bitorder="little").tobytes()


def put_code(out: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1 | (len(used) == 2) << 1 | 1 << 2, 3)
        for s in used:
            out.put(s, 8)
        return
    out.put(0, 1)
    edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
    runs: list[tuple[int, int, int]] = []
    for lo, hi in zip(edges, edges[1:]):
        value, n = int(lengths[lo]), hi - lo
        while value == 0 and n >= 3:
            part = min(n, 138)
            runs.append((18, part - 11, 7) if part >= 11 else (17, part - 3, 3))
            n -= part
        runs += [(value, 0, 0)] * n
    symbols = np.array([r[0] for r in runs])
    inner = code_lengths(np.bincount(symbols, minlength=19), 7)
    out.put(15, 4)
    for i in LENGTH_ORDER:
        out.put(int(inner[i]), 3)
    out.put(0, 1)
    codes = canonical(inner)
    single = (inner > 0).sum() == 1
    out.many(np.stack([codes[symbols], np.array([r[1] for r in runs])], 1).ravel(), np.stack([0 * inner[symbols] if single else inner[symbols], np.array([r[2] for r in runs])], 1).ravel())


def predict_forward(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    h, w = pixels.shape
    c = channels(pixels)
    left, top, corner, right = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
    left[:, 1:], top[1:], corner[1:, 1:], right[1:, :-1], right[1:, -1] = c[:, :-1], c[:-1], c[:-1, :-1], c[:-1, 1:], c[1:, 0]
    mode = channels(modes)[..., 2].repeat(1 << bits, 0).repeat(1 << bits, 1)[:h, :w].copy()
    mode[0], mode[1:, 0] = 1, 2
    mode[0, 0] = 0
    return joined(c - predictions(left, top, right, corner, mode))


def _matches(flat: np.ndarray, most: int = 4096) -> list[tuple[int, int, int]]:
    """Non-overlapping (position, length, distance) of runs seen before, by equal windows of twelve pixels."""
    least = 12
    n = len(flat) - least + 1
    if n < 2:
        return []
    # Windows of 1, 2, 4, 8 and then 12 pixels, each from two shorter ones.
    factor = np.uint64(0x9E3779B97F4A7C15)
    one = (flat.astype(np.uint64) + np.uint64(1)) * factor
    two = one[:-1] * factor + one[1:]
    four = (two[:-2] ^ two[:-2] >> np.uint64(29)) * factor + two[2:]
    key = (four[:n] ^ four[:n] >> np.uint64(31)) * factor + four[4 : 4 + n]
    key = (key ^ key >> np.uint64(30)) * factor + four[8 : 8 + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    seen, before = order[1:][same], order[:-1][same]
    place = np.argsort(seen)
    out, end = [], 0
    for i, j in zip(seen[place].tolist(), before[place].tolist()):
        if i < end:
            continue
        top = min(most, len(flat) - i)
        differ = np.flatnonzero(flat[i : i + top] != flat[j : j + top])
        size = int(differ[0]) if len(differ) else top
        if size >= least:
            out.append((i, size, i - j))
            end = i + size
    return out


def _prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra value and extra bits of lengths or distances."""
    v = values - 1
    high = np.frexp(np.maximum(v, 1))[1] - 1
    extra = np.where(v < 4, 0, high - 1)
    symbol = np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1))
    return symbol, np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def _put_image(out: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int = 0, group_bits: int = 0, near: bool = False) -> None:
    """Entropy-code pixels; group_bits gives every other tile codes of its own, near names neighbours by plane codes."""
    h, w = pixels.shape
    flat = pixels.ravel()
    out.put(cache_bits << 1 | 1 if cache_bits else 0, 5 if cache_bits else 1)
    areas = None
    if main:
        out.put(1 if group_bits else 0, 1)
        if group_bits:
            out.put(group_bits - 2, 3)
            tiles = np.indices((_shrunk(h, group_bits), _shrunk(w, group_bits))).sum(0) % 2
            _put_image(out, tiles.astype(_U) << _U(8), False)
            areas = tiles.repeat(1 << group_bits, 0).repeat(1 << group_bits, 1)[:h, :w].ravel()
    found = _matches(flat) if main else []
    at = np.arange(len(flat))
    size = dist = np.zeros(len(flat), np.int64)
    if found:
        copy, size, dist = np.zeros(len(flat), bool), size.copy(), size.copy()
        for i, n, d in found:
            copy[i + 1 : i + n] = True
            size[i], dist[i] = n, d
        at = np.flatnonzero(~copy)
        size, dist = size[at], dist[at]
    c = channels(flat[at])
    symbols = np.where(size > 0, 0, c[:, 2])
    plain = size == 0
    if cache_bits:
        cache: dict[int, int] = {}
        key = ((flat.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)
        hit = np.zeros(len(flat), bool)
        for i, (k, p) in enumerate(zip(key.tolist(), flat.tolist())):
            hit[i] = cache.get(k, 0) == p
            cache[k] = p
        hit = hit[at] & plain
        symbols = np.where(hit, 280 + key[at].astype(np.int64), symbols)
        plain &= ~hit
    ref = size > 0
    l_symbol, l_extra, l_bits, d_symbol, d_extra, d_bits = np.zeros((6, len(at)), np.int64)
    codes = dist + 120
    if near:
        plane = {max(1, x + y * w): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
        codes = np.array([plane.get(d, d + 120) for d in dist.tolist()])
    if found:
        l_symbol[ref], l_extra[ref], l_bits[ref] = _prefixed(size[ref])
        d_symbol[ref], d_extra[ref], d_bits[ref] = _prefixed(codes[ref])
    symbols = np.where(ref, 256 + l_symbol, symbols)
    # Literals: green, red, blue, alpha. References: length, its extra bits, distance, its extra bits.
    values, bits = np.zeros((len(at), 5), np.int64), np.zeros((len(at), 5), np.int64)
    every = np.ones(len(at), bool)
    for g in range(1 if areas is None else int(areas.max()) + 1):
        own = every if areas is None else areas[at] == g
        kinds = [(symbols, own, 280 + (1 << cache_bits if cache_bits else 0)), (c[:, 1], own & plain, 256), (c[:, 3], own & plain, 256), (c[:, 0], own & plain, 256), (d_symbol, own & ref, 40)]
        for place, (s, who, n) in zip((0, 2, 3, 4, 2), kinds):
            seen = s[who]
            if not len(seen) or (seen[0] < 256 and (seen == seen[0]).all()):
                out.put(5, 3)
                out.put(int(seen[0]) if len(seen) else 0, 8)
                continue
            lengths = code_lengths(np.bincount(seen, minlength=n))
            put_code(out, lengths)
            values[who, place] = canonical(lengths)[seen]
            bits[who, place] = lengths[seen] if (lengths > 0).sum() > 1 else 0
    if found:
        values[ref, 1], bits[ref, 1] = l_extra[ref], l_bits[ref]
        values[ref, 3], bits[ref, 3] = d_extra[ref], d_bits[ref]
    used = np.flatnonzero(bits.any(0))
    out.many(values[:, used].ravel(), bits[:, used].ravel())


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, group_bits: int = 0, near: bool = False) -> bytes:
    """A lossless WebP file of ARGB pixels (height, width).

    transforms, in order: (PREDICTOR, modes, bits), (CROSS_COLOUR, elements, bits), (SUBTRACT_GREEN,) or (PALETTE,).
    """
    h, w = pixels.shape
    out = BitWriter()
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, *what in transforms:
        out.put(1 | kind << 1, 3)
        if kind == PALETTE:
            colours, index = np.unique(pixels, return_inverse=True)
            index = index.reshape(h, w)
            out.put(len(colours) - 1, 8)
            parts = channels(colours)
            _put_image(out, joined(np.diff(parts, axis=0, prepend=0 * parts[:1]))[None, :], False)
            pack = _bundle(len(colours))
            wide = _shrunk(w, pack) << pack
            index = np.concatenate([index, np.zeros((h, wide - w), index.dtype)], 1).reshape(h, -1, 1 << pack)
            pixels = (index << (np.arange(1 << pack) * (8 >> pack))).sum(-1).astype(_U) << _U(8)
            w = pixels.shape[1]
        elif kind == SUBTRACT_GREEN:
            pixels = green_added(pixels, -1)
        else:
            side, bits = what
            out.put(bits - 2, 3)
            _put_image(out, side, False)
            pixels = cross_colour(pixels, side, bits, -1) if kind == CROSS_COLOUR else predict_forward(pixels, side, bits)
    out.put(0, 1)
    _put_image(out, pixels, True, cache_bits, group_bits, near)
    body = bytes([SIGNATURE]) + out.done()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
