"""Media columns of lossless WebP: texts stored as 8-bit samples, read back to pixel arrays and features.

A payload becomes rows of 64 pixels of three samples, red, green and blue, in images of at most 32 rows laid end to end.
Each image has prefix codes of its own and back-references, and what its estimate favours of a colour cache, a palette,
a prediction from the left or the top, and the cross-colour transform. The images of many rows are written side by
side, and read side by side. Long texts are many small images, so memory is bounded by the batch.

Defined results: null and empty text give one payload of spaces; equal texts give equal bytes; repeated rows are
stored each; an empty table gives no rows; other columns pass through, but those named as the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import webp
from tallyforge.llm.common import map_text

#: Bytes a payload is filled up to (a row of samples), pixels in a row, rows in an image.
UNIT, WIDTH, ROWS = 192, 64, 32


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def write(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: files of at most ROWS rows laid end to end, all written side by side."""
    rows = [np.frombuffer(raw, np.uint8).reshape(-1, WIDTH, 3).astype(np.uint32) for raw in payloads]
    images = [own[lo : lo + ROWS] for own in rows for lo in range(0, len(own), ROWS)]
    if not images:
        return []
    c = np.concatenate(images)
    pixels = np.uint32(0xFF000000) | c[..., 0] << np.uint32(16) | c[..., 1] << np.uint32(8) | c[..., 2]
    files = iter(webp.encode(np.split(pixels, np.cumsum([len(p) for p in images])[:-1])))
    return [b"".join(next(files) for _ in range(0, len(own), ROWS)) for own in rows]


def read(values: list[bytes | None]) -> list[np.ndarray]:
    """The samples (rows, 192) of each value; images of all values are decoded together."""
    files = [webp.split(v or b"") for v in values]
    pixels = iter(webp.decode([f for own in files for f in own]))
    out = []
    for own in files:
        p = np.concatenate([next(pixels) for _ in own] or [np.zeros((0, WIDTH), np.uint32)])
        out.append(np.stack([(p >> np.uint32(s)).astype(np.uint8) for s in (16, 8, 0)], -1).reshape(len(p), UNIT))
    return out


def feature(samples: np.ndarray) -> str:
    """Rows, mean and contrast in thousandths, mean step along rows and between rows, and shares of eight tones."""
    x = samples.astype(np.int64)
    if not x.size:
        return ""
    step, drop = np.abs(np.diff(x, axis=1)).mean(), np.abs(np.diff(x, axis=0)).mean() if len(x) > 1 else 0.0
    tones = np.bincount((samples >> 5).ravel(), minlength=8) * 1000 // x.size
    return f"rows={len(x)};mean={int(x.mean() * 1000)};std={int(x.std() * 1000)};step={int(step * 1000)};drop={int(drop * 1000)};tones=" + ",".join(map(str, tones.tolist()))


def _stored(texts: list[str | None]):
    raw = [payload(t) for t in texts]
    return [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], write(raw)


def store(docs: DataFrame) -> DataFrame:
    """All columns of docs, `_n_bytes` of the text and `_media`, the stored form."""
    return map_text(docs, "_n_bytes long, _media binary", _stored, rows=1000)


def _loaded(values: list[bytes | None]):
    arrays = read(values)
    raw = [a.tobytes() for a in arrays]
    return raw, [feature(a) for a in arrays]


def load(media: DataFrame) -> DataFrame:
    """All columns of media, `_payload` as read back from `_media`, and `_feature`."""
    return map_text(media, "_payload binary, _feature string", _loaded, column="_media", rows=1000, size="_n_bytes")


def digest(media: DataFrame) -> DataFrame:
    """load() with the payload and the stored form as digests; neither leaves the task whole."""

    def per_values(values: list[bytes | None]):
        arrays = read(values)
        raw = [a.tobytes() for a in arrays]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return [len(r) for r in raw], [sha(r) for r in raw], [zlib.crc32(r[-16:]) for r in raw], [len(v or b"") for v in values], [sha(v or b"") for v in values], [feature(a) for a in arrays]

    names = "_payload_bytes long, _payload_sha256 string, _tail_crc32 long, _media_bytes long, _media_sha256 string, _feature string"
    return map_text(media, names, per_values, column="_media", rows=1000, size="_n_bytes").drop("_media")


def prefixed(media: DataFrame) -> DataFrame:
    return media.select(*[F.col(c).alias(c.lstrip("_")) for c in media.columns])
