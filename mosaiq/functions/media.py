"""Images and embeddings: header checks and the embedder protocol.

No image decoder is assumed. image_size() reads width and height from the headers of the common formats; an ONNX embedder
is used if its model file is given, and a deterministic hash embedder stands in for it otherwise.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

LEAST_BYTES = 500
LEAST_EDGE = 32


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG, GIF, BMP, JPEG or WebP image; None if it is none of them or cut off."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return abs(w), abs(h)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return None


def is_valid_image(data: bytes | None) -> bool:
    """Whether the bytes are an image of at least LEAST_BYTES with both edges at least LEAST_EDGE."""
    size = image_size(data) if data is not None and len(data) >= LEAST_BYTES else None
    return size is not None and min(size) >= LEAST_EDGE


def valid_image(content: Column | str) -> Column:
    """is_valid_image() of a column; null counts as not."""

    @arrow_udf("boolean")
    def check(values: pa.Array) -> pa.Array:
        return pa.array([is_valid_image(x) for x in values.to_pylist()], pa.bool_())

    return check(content)


class Embedder(Protocol):
    """Unit vectors of a batch of inputs (texts or image bytes); made once per Python worker."""

    dim: int

    def embed(self, inputs: list) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic stand-in: words (or 64-byte pieces) hashed to signed coordinates. A blank text counts as one word."""

    def __init__(self, dim: int = 64, blank: str = "blank"):
        self.dim, self.blank = dim, blank

    def embed(self, inputs: list) -> np.ndarray:
        out = np.zeros((len(inputs), self.dim))
        for row, x in enumerate(inputs):
            if isinstance(x, (bytes, bytearray)):
                parts = [bytes(x[k : k + 64]) for k in range(0, len(x), 64)]
            else:
                parts = [w.encode() for w in (x or "").split()] or [self.blank.encode()]
            for part in parts:
                word = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little")
                out[row, word % self.dim] += 1 if word >> 32 & 1 else -1
            if not out[row].any():
                out[row, 0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)


class OnnxEmbedder:
    """A model file run by onnxruntime: one input of preprocessed rows, one output of `dim` numbers a row."""

    def __init__(self, model: str, prepare: Callable[[list], np.ndarray], dim: int):
        import onnxruntime

        self.session, self.prepare, self.dim = onnxruntime.InferenceSession(model), prepare, dim

    def embed(self, inputs: list) -> np.ndarray:
        (found,) = self.session.run(None, {self.session.get_inputs()[0].name: self.prepare(inputs)})
        if found.shape != (len(inputs), self.dim):
            raise ValueError(f"the model gives {found.shape}, not {(len(inputs), self.dim)}")
        size = np.linalg.norm(found, axis=1, keepdims=True)
        return np.where(size > 1e-9, found / np.where(size > 1e-9, size, 1), found)


def embed_with(make: Callable[[], Embedder], column: Column | str) -> Column:
    """array<float> column of unit vectors; make() is called once per worker and task."""

    @arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = make()
        for values in batches:
            found = model.embed(values.to_pylist()).astype(np.float32) if len(values) else np.empty((0, model.dim), np.float32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * model.dim), pa.array(found.ravel()))

    return run(column)
