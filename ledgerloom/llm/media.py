"""Media columns: payloads kept as lossless WebP images and read back as pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm import common, webp

WIDTH = 576
# Rows of an image; longer payloads take several images, so that decoding stays bounded and side by side.
ROWS = 16
_TILES_AT_ONCE = 2500


def payload(raw: bytes) -> np.ndarray:
    """Bytes as rows of samples, filled up with 255 to a positive multiple of the width."""
    rows = max(1, -(-len(raw) // WIDTH))
    return np.frombuffer(raw + b"\xff" * (rows * WIDTH - len(raw)), np.uint8).reshape(rows, WIDTH)


def encode(raw: bytes) -> bytes:
    """WebP files one after another, each of at most ROWS rows."""
    grid = payload(raw)
    return b"".join(webp.encode_grey(grid[k : k + ROWS]) for k in range(0, len(grid), ROWS))


def split(media: bytes) -> list[bytes]:
    """The files of a media value; each begins with its own size."""
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(media[at : at + size])
        at += size
    return out


def feature(pixels: np.ndarray) -> str:
    """Mean brightness and a 64-bit difference hash: whether each of 8 x 9 cells is brighter than the next."""
    flat = pixels.reshape(-1)
    edges = np.arange(73) * flat.size // 72
    sums = np.add.reduceat(flat.astype(np.int64), np.minimum(edges[:-1], flat.size - 1))
    means = (sums * 1000 // np.maximum(np.diff(edges), 1)).reshape(8, 9)
    bits = "".join("1" if x else "0" for x in (means[:, :-1] > means[:, 1:]).reshape(-1))
    return f"{int(flat.sum(dtype=np.int64)) * 1000 // flat.size}:{int(bits, 2):016x}"


def _encode(batches):
    for b in batches:
        for ids, texts in common.text_slices(b, 2 << 20):
            raws = [t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(map(encode, raws), pa.binary())], ["doc_id", "n_bytes", "media"])


def decode_all(medias: list[bytes]) -> list[np.ndarray]:
    """Rows of samples of each media value."""
    files = [split(m) for m in medias]
    flat = [f for own in files for f in own]
    tiles = [x for at in range(0, len(flat), _TILES_AT_ONCE) for x in webp.decode_many(flat[at : at + _TILES_AT_ONCE])]
    out, at = [], 0
    for own in files:
        out.append(np.concatenate(tiles[at : at + len(own)]))
        at += len(own)
    return out


def _describe(batches):
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            medias = part.column("media").to_pylist()
            rows = []
            for pixels, media in zip(decode_all(medias), medias, strict=True):
                raw = pixels.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pixels)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes and media, the text's bytes as lossless greyscale WebP.

    Null and empty texts give one row of samples 255. Null ids stay null; repeated rows each give a row; other
    columns are not read; an empty table gives an empty one. Texts are stored whole, in images of 16 rows. No
    shuffle.
    """
    return common.arrow_map(common.id_text(docs, id_col, text_col), "ledgerloom.llm.media:_encode", "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Of a media column, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return common.arrow_map(media.select("doc_id", "n_bytes", "media"), "ledgerloom.llm.media:_describe", "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _pixels(batches):
    for b in batches:
        for key, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
            for k, f in enumerate(split(m)):
                image = webp.decode(f)
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([k], pa.int32()), pa.array([image.shape[1]], pa.int32()), pa.array([image.shape[0]], pa.int32()), pa.array([image.tobytes()], pa.binary())], ["doc_id", "part", "width", "height", "rgba"])


def pixel_arrays(media: DataFrame) -> DataFrame:
    """Pixel arrays of any lossless WebP media column: doc_id, part, width, height, rgba bytes."""
    return common.arrow_map(media.select("doc_id", "media"), "ledgerloom.llm.media:_pixels", "doc_id long, part int, width int, height int, rgba binary")
