"""Media columns of lossless WebP images: payload bytes stored as pixels, and pixels decoded to features.

A payload's bytes are the samples of an RGB image 64 pixels wide, so a row holds 192 bytes. A payload of more than
``TILE_ROWS`` rows is stored as several images, tiles from top to bottom, each a complete file, one after the other; a
file's own header says where it ends. Thus no image grows with the text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ragged, slices, table, text_buffer
from .webp import decode, encode_rgb

WIDTH, TILE_ROWS = 64, 128
_ROW = 3 * WIDTH


def store(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The stored form of each payload: its bytes padded with blanks to whole rows, one at least, as WebP tiles."""
    size = np.diff(offsets)
    rows = np.maximum(1, -(-size // _ROW))
    bounds = np.concatenate([[0], np.cumsum(rows * _ROW)])
    padded = np.full(bounds[-1], 32, np.uint8)
    padded[ragged(bounds[:-1], size)] = data
    tiles = -(-rows // TILE_ROWS)
    owner = np.repeat(np.arange(len(rows)), tiles)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    height = np.minimum(rows[owner] - index * TILE_ROWS, TILE_ROWS)
    files = encode_rgb(padded, height, WIDTH)
    ends = np.cumsum(tiles).tolist()
    return [b"".join(files[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def tiles(media: bytes) -> list[bytes]:
    """The files that a stored form consists of."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at:end])
        at = end
    return out


def store_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``media``, the stored form of ``text``, in place of it, and ``n_bytes``, the text's bytes.

    Null texts are empty; an empty text is one row of blanks. Equal texts have equal stored forms. Columns of those names
    are replaced; other columns stay.
    """
    kept = docs.drop("media", "n_bytes")
    rest = [c for c in kept.columns if c != "text"]

    def save(batches):
        for batch in slices(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            out = batch.select(rest) if rest else pa.RecordBatch.from_arrays([], [])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.diff(offsets)), pa.array(store(data, offsets), pa.binary())], [*rest, "n_bytes", "media"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"), "n_bytes long", "media binary"])
    return kept.mapInArrow(save, fields)


def pixels(media: list[bytes]) -> list[np.ndarray]:
    """Rows of RGB samples of each stored form, all tiles of all forms decoded together."""
    files = [tiles(m) for m in media]
    decoded = iter(decode([t for f in files for t in f]))
    return [np.concatenate([next(decoded)[:, :, :3].reshape(-1, _ROW) for _ in f]) for f in files]


def feature(rows: np.ndarray) -> str:
    """Rows, mean and deviation of the samples, mean absolute step to the next pixel's samples, and a 64-bit average hash.

    The hash has a bit for each cell of an 8 by 8 grid over the image: whether its mean is above the image's.
    """
    flat = rows.reshape(-1).astype(np.int64)
    n, total, square = len(flat), int(flat.sum()), int((flat * flat).sum())
    step = int(np.abs(np.diff(flat.reshape(-1, 3), axis=0)).sum()) if n > 3 else 0
    edge = np.arange(8) * len(rows) // 8
    bands = np.add.reduceat(rows.reshape(len(rows), 8, -1).sum(2).astype(np.int64), np.minimum(edge, len(rows) - 1), axis=0)
    height = np.maximum(np.diff(np.append(edge, len(rows))), 1)
    bits = (bands * n > total * (height * (_ROW // 8))[:, None]).ravel()
    mean = total / n
    return f"{len(rows)}:{mean:.4f}:{max(square / n - mean * mean, 0) ** 0.5:.4f}:{step / max(1, n - 3):.4f}:{int(np.packbits(bits).view('>u8')[0]):016x}"


def decode_media(stored: DataFrame) -> DataFrame:
    """``stored`` (with ``media``) and what its pixels say: ``payload_bytes``, ``payload_sha256``, ``tail_crc32`` (of the last 16
    bytes), ``media_bytes``, ``media_sha256`` and ``feature``; ``media`` itself goes. Broken files raise an error."""
    rest = [c for c in stored.columns if c != "media"]

    def read(batches):
        for batch in slices(batches, "media", 3 << 20):
            media = batch.column("media").to_pylist()
            found = pixels(media)
            raw = [p.tobytes() for p in found]
            cols = [
                pa.array([len(r) for r in raw], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                pa.array([zlib.crc32(r[-16:]) for r in raw], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([feature(p) for p in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *cols], [*rest, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema if f.name != "media"]
    return stored.mapInArrow(read, ", ".join([*fields, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"]))


def op1_media(spark, sf_dir: str) -> DataFrame:
    return decode_media(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")))


