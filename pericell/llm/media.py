"""Media columns: PNG images held in binary columns, and a low-frequency hash of each.

``encode`` stores a payload as an 8-bit grey PNG: signature, IHDR, one zlib IDAT
and IEND, each chunk with its CRC-32, each row with the cheapest of the filters
None, Sub and Up. ``decode`` reads PNG bytes back: it tests signature, chunk
checksums, header and stream length, and undoes all five filters by NumPy.
``feature`` is the sign of the low-frequency cosine-transform coefficients of
the image averaged down to 32 x 32, against their median.

A null or empty text is the empty payload. Texts are padded with byte 255 to a
positive multiple of 576; a very long one is one image, which takes memory in
proportion. ``decode`` raises ``ValueError`` for a damaged image; ``read_media`` then
gives a null payload and feature, so that one image does not end the job. A null
image has neither. Repeated rows give repeated results, an empty table gives none,
and there are no ties. Other columns are not read, so clashing names cannot arise.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 576
GRID, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(payload: bytes, unit: int = WIDTH) -> bytes:
    return payload + b"\xff" * (max(1, -(-len(payload) // unit)) * unit - len(payload))


def encode(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """The PNG of ``payload``, a positive multiple of ``width``, as rows of grey samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    kinds = np.empty((3, *rows.shape), np.uint8)
    kinds[0] = rows
    kinds[1] = rows
    kinds[1, :, 1:] -= rows[:, :-1]
    kinds[2] = rows
    kinds[2, 1:] -= rows[:-1]
    cost = np.minimum(kinds, 256 - kinds.astype(np.int16)).sum(axis=2)
    cost[0] = np.minimum(rows, 256 - rows.astype(np.int16)).sum(axis=1)
    best = cost.argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(len(rows))]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(png: bytes) -> np.ndarray:
    """Samples as (rows, columns) of a PNG with 8-bit grey samples and no interlacing."""
    try:
        return _decoded(png)
    except (zlib.error, struct.error) as e:
        raise ValueError(f"damaged image: {e}") from e


def _decoded(png: bytes) -> np.ndarray:
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, header, body, ended = 8, None, [], False
    while at < len(png) and not ended:
        if at + 12 > len(png):
            raise ValueError("a chunk is cut short")
        (size,) = struct.unpack_from(">I", png, at)
        kind, data, tail = png[at + 4 : at + 8], png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(tail) < 4 or struct.unpack(">I", tail)[0] != zlib.crc32(kind + data):
            raise ValueError(f"wrong checksum in chunk {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    width, height, *form = header
    if form != [8, 0, 0, 0, 0]:
        raise ValueError(f"unsupported form {form}")
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if len(lines) != height * (width + 1):
        raise ValueError("wrong length of the pixel data")
    return unfilter(lines.reshape(height, width + 1))


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Undo the filters; the first column tells each row's. Runs of rows with one filter go together."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    lone = np.flatnonzero(kinds >= 2)
    if not lone.size:
        return out
    for run in np.split(lone, np.flatnonzero(np.diff(lone) != 1) + 1):
        lo, hi = run[0], run[-1] + 1
        if (kinds[lo:hi] == 2).all():
            first = max(lo - 1, 0)
            out[lo:hi] = np.cumsum(out[first:hi], axis=0, dtype=np.uint8)[lo - first :]
            continue
        for y in range(lo, hi):
            above = out[y - 1] if y else np.zeros_like(out[y])
            if kinds[y] == 2:
                out[y] += above
            else:
                out[y] = _average(out[y], above) if kinds[y] == 3 else _paeth(out[y], above)
    return out


def _average(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    left, out = 0, np.empty_like(row)
    for x, (v, b) in enumerate(zip(row.tolist(), above.tolist(), strict=True)):
        left = out[x] = (v + (left + b) // 2) & 255
        left = int(left)
    return out


def _paeth(row: np.ndarray, above: np.ndarray) -> np.ndarray:
    left = corner = 0
    out = []
    for v, b in zip(row.tolist(), above.tolist(), strict=True):
        guess = left + b - corner
        near = min((abs(guess - left), 0, left), (abs(guess - b), 1, b), (abs(guess - corner), 2, corner))
        left, corner = (v + near[2]) & 255, b
        out.append(left)
    return np.array(out, np.uint8)


def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(GRID)[None]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * GRID))


COSINES = _cosines()


def shrink(image: np.ndarray) -> np.ndarray:
    """Block means on a GRID x GRID raster; a side shorter than the raster repeats its samples."""
    sums = image.astype(np.int64)
    for axis in (0, 1):
        n = sums.shape[axis]
        if n < GRID:
            sums = np.take(sums, np.arange(GRID) * n // GRID, axis=axis)
    edge = [np.arange(GRID) * n // GRID for n in sums.shape]
    size = np.diff(np.append(edge[0], sums.shape[0]))[:, None] * np.diff(np.append(edge[1], sums.shape[1]))[None]
    return np.add.reduceat(np.add.reduceat(sums, edge[0], axis=0), edge[1], axis=1) / size


def feature(image: np.ndarray) -> str:
    """63 signs of low-frequency coefficients against their median, as 16 hex digits."""
    low = np.round(COSINES @ shrink(image) @ COSINES.T, 6).ravel()[1:]
    bits = np.append(low > np.median(low), False)
    return np.packbits(bits).tobytes().hex()


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the PNG of each whole text."""
    from .store import tidy
    from .words import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "payload"):
                body = batch.column("payload").to_pylist()
                media = [encode(pad(x)) for x in body]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(x) for x in body], pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "media"])
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    return given.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary")


def _image(png: bytes | None) -> np.ndarray | None:
    try:
        return None if png is None else decode(png)
    except ValueError:
        return None


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds payload and feature, both made from the stored bytes; null for a damaged image."""
    from .store import tidy
    from .words import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "media", 2 << 20):
                images = [_image(x) for x in batch.column("media").to_pylist()]
                payload = pa.array([None if x is None else x.tobytes() for x in images], pa.binary())
                features = pa.array([None if x is None else feature(x) for x in images], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, payload, features], [*batch.schema.names, "payload", "feature"])
        tidy()

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, media binary, payload binary, feature string")
