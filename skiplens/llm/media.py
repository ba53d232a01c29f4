"""Media columns: payloads stored losslessly in progressive JPEG files.

64 bytes make a block: the first is the DC coefficient (minus 128), each other
one an AC coefficient of eight bits in size.  Blocks fill Y, Cb and Cr of a
4:2:0 image in raster order; the file's comment holds the payload's length.
Reading back goes through the decoder of jpeg.py: scans into coefficient
arrays, from these the payload, the samples and the RGB tensor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import text_slices

UNIT = 64
#: Blocks of which the pixels are made at once.
BAND_BLOCKS = 8_192
_QUANT = np.ones(UNIT, np.int32)


def padded(data: bytes) -> bytes:
    """`data` with bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_image(payload: bytes) -> jpeg.Image:
    n = len(payload) // UNIT
    units = -(-n // 6)
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    blocks = np.zeros((across * down * 6, UNIT), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    coef = blocks.astype(np.int16)
    coef[:, 1:] -= np.where(coef[:, 1:] < 128, 255, 0).astype(np.int16)
    coef[:, 0] -= 128
    k = across * down
    comps = [jpeg.Component(1, 2, 2, 0, coef=coef[: 4 * k]), jpeg.Component(2, 1, 1, 0, coef=coef[4 * k : 5 * k]), jpeg.Component(3, 1, 1, 0, coef=coef[5 * k :])]
    return jpeg.Image(16 * across, 16 * down, comps, {0: _QUANT}, str(len(payload)).encode())


def from_image(img: jpeg.Image) -> bytes:
    coef = np.concatenate([c.coef for c in img.components])
    out = np.where(coef < 0, coef + 255, coef).astype(np.uint8)
    out[:, 0] = (coef[:, 0] + 128).astype(np.uint8)
    return out.tobytes()[: int(img.comment)]


class Sums:
    """Whole-number sums over the channels of a tensor that comes in bands."""

    def __init__(self) -> None:
        self.n, self.total, self.square = 0, np.zeros(3, np.int64), np.zeros(3, np.int64)

    def add(self, tensor: np.ndarray) -> None:
        flat = tensor.reshape(-1, 3).astype(np.int64)
        self.n += len(flat)
        self.total += flat.sum(axis=0)
        self.square += (flat * flat).sum(axis=0)

    def feature(self, img: jpeg.Image) -> str:
        """Size, mean and deviation of each channel."""
        mean = self.total / self.n
        dev = np.sqrt(np.maximum(self.square / self.n - mean * mean, 0))
        return f"{img.width}x{img.height} mean " + ",".join(f"{x:.4f}" for x in mean) + " dev " + ",".join(f"{x:.4f}" for x in dev)


def bands(img: jpeg.Image) -> Iterator[jpeg.Image]:
    """An image of to_image() in bands of whole rows of units, of BAND_BLOCKS blocks at most where a row has fewer."""
    across, down = img.layout()
    step = max(1, BAND_BLOCKS // (6 * across))
    for lo in range(0, down, step):
        hi = min(lo + step, down)
        comps = []
        for c in img.components:
            row = c.h * c.v * across
            comps.append(jpeg.Component(c.ident, c.h, c.v, c.quant, coef=c.coef[lo * row : hi * row]))
        band = jpeg.Image(img.width, 16 * (hi - lo), comps, img.quants)
        band.layout()
        yield band


def tensors(images: list[jpeg.Image]) -> tuple[list[bytes], list[str]]:
    """(RGB bytes, feature) of each image; bands of many images go through the inverse transform together."""
    parts: list[list[bytes]] = [[] for _ in images]
    sums = [Sums() for _ in images]

    def flush(held: list[tuple[int, jpeg.Image]]) -> None:
        samples, at = jpeg.inverse(np.concatenate([c.coef for _, b in held for c in b.components]), _QUANT), 0
        for k, band in held:
            cut = []
            for c in band.components:
                cut.append(samples[at : at + len(c.coef)])
                at += len(c.coef)
            t = jpeg.rgb(band, cut)
            sums[k].add(t)
            parts[k].append(t.tobytes())

    held, size = [], 0
    for k, img in enumerate(images):
        for band in bands(img):
            held.append((k, band))
            size += sum(len(c.coef) for c in band.components)
            if size >= BAND_BLOCKS:
                flush(held)
                held, size = [], 0
    if held:
        flush(held)
    return [b"".join(p) for p in parts], [s.feature(i) for s, i in zip(sums, images, strict=True)]


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, payload, media, width, height, feature, rgb`` for each row.

    `media` is the file, `payload` what is read back from it, `rgb` the bytes
    of the [height, width, 3] tensor at full resolution.

    * null and empty texts: 64 bytes 0.
    * very long texts: one file each; pixels are made in bands, so a task holds some ten bytes a byte of the text.
    * null ids are passed on; equal texts give equal values.
    * empty table: empty result; other columns are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in text_slices(batches, max_bytes=1 << 19):
            raw = s.data.tobytes()
            files = [jpeg.write_dense(to_image(padded(raw[lo:hi]))) for lo, hi in zip(s.starts[:-1].tolist(), s.starts[1:].tolist(), strict=True)]
            images = [jpeg.read(f) for f in files]
            rgb, feature = tensors(images)
            cols = [s.column("doc_id"), pa.array(np.diff(s.starts)), pa.array([from_image(i) for i in images], pa.binary()), pa.array(files, pa.binary()), pa.array([i.width for i in images], pa.int32()), pa.array([i.height for i in images], pa.int32()), pa.array(feature), pa.array(rgb, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "payload", "media", "width", "height", "feature", "rgb"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload binary, media binary, width int, height int, feature string, rgb binary")


def digest(result: DataFrame) -> DataFrame:
    """The thin view of the query: sizes and hashes of what was stored and read back."""
    n = F.length("payload")
    return result.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.length("rgb").cast("long").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"),
    )
