"""Vectors in blocks of neighbours: the shared search structure of clustering, near-duplicate and neighbour operators.

A vector is comparable if it has the right length, is finite and not all zero. It travels as bytes (pack): rotated by a
fixed random rotation and kept as 16- or 24-bit integers, with cosines off by some 1e-6 or 1e-8, or as its own 32- or
64-bit numbers. Records with the same bytes are copies; one row stands for them.

Blocks have two levels. Pivots are a sample of the vectors themselves, one for ROWS_PER_PIVOT of them and at most
MOST_PIVOTS (34 MB in a worker), broadcast as a tree of two levels of which a vector is compared with about SCANNED
pivots, whatever their number. Each vector joins the blocks of its `probes` nearest pivots, so two similar vectors share
at least one block almost surely (recall: README). As pivots follow the density of the data, dense regions get more of
them and blocks keep about the same size. Where a block still holds more than SUB_ROWS vectors, as all do once MOST_PIVOTS is
reached, its task picks pivots among them and makes smaller blocks of the same kind; so the work a vector takes doesn't
grow with the number of vectors. Only a block that is expected, by the sample, to exceed PART_ROWS is spread over
several tasks: its vectors are hashed into parts, and each pair of parts is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.runtime import cut_lineage

DIM = 64
ROTATION_SEED = 20_240_117
ROWS_PER_PIVOT = 1024
MOST_PIVOTS = 131_072
SCANNED = 2048  # pivots that a vector is compared with
SORTED_SAMPLE = 2048  # up to so many pivots are the first by hash; more are those of a share of all hashes
SUB_ROWS = 20_000
PART_ROWS = 262_144
TILE = 1 << 23  # numbers of a similarity matrix held at once
PART_BITS = 12
CELL_BYTES = 3
HASH = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def rotation(dim: int = DIM) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(ROTATION_SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _fitting(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the comparable vectors of a list column, and their numbers in double precision."""
    offsets = column.offsets.to_numpy()
    fit = (np.diff(offsets) == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.nonzero(fit)[0]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    found = values[offsets[rows][:, None] + np.arange(dim)] if len(rows) else np.empty((0, dim))
    good = np.isfinite(found).all(1) & (np.abs(found).max(1, initial=0) > 0)
    return rows[good], found[good]


def unit_rows(found: np.ndarray) -> np.ndarray:
    found = found / np.abs(found).max(1, keepdims=True, initial=0)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def comparable(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places of the comparable vectors of a list column, and the vectors in double precision, of unit length."""
    rows, found = _fitting(column, dim)
    return rows, unit_rows(found)


def pack(vectors: np.ndarray, width: int = 2) -> np.ndarray:
    """Rows as bytes. Width 2 or 3: rotated unit rows as integers of so many bytes; 4 or 8: the numbers as they are."""
    if width >= 4:
        return np.ascontiguousarray(vectors.astype(f"<f{width}")).view(np.uint8).reshape(len(vectors), -1)
    turned = vectors @ rotation(vectors.shape[1])
    whole = np.rint(turned * (((1 << (8 * width - 1)) - 1) / np.abs(turned).max(1, keepdims=True))).astype("<i4")
    return np.ascontiguousarray(whole.view(np.uint8).reshape(*whole.shape, 4)[:, :, :width]).reshape(len(whole), -1)


def as_binary(packed: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(packed.shape[1]), len(packed), [None, pa.py_buffer(np.ascontiguousarray(packed))]).cast(pa.binary())


def _bytes(column: pa.Array) -> np.ndarray:
    """The rows of a binary column of one length, as a matrix of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    start = column.offset
    offsets = np.frombuffer(column.buffers()[1], "<i4")[start : start + 2].tolist()
    size = offsets[1] - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8, count=len(column) * size, offset=offsets[0]).reshape(-1, size)


def unpack(column: pa.Array | np.ndarray, dim: int = DIM) -> np.ndarray:
    """Unit rows: of rotated integers in single precision, of whole numbers in double."""
    if not len(column):
        return np.empty((0, dim), np.float32)
    raw = column if isinstance(column, np.ndarray) else _bytes(column)
    width = raw.shape[1] // dim
    if width >= 4:
        return unit_rows(np.ascontiguousarray(raw).view(f"<f{width}").astype(np.float64))
    whole = np.zeros((len(raw), dim, 4), np.uint8)
    whole[:, :, 4 - width :] = raw.reshape(-1, dim, width)  # the scale doesn't matter
    found = whole.view("<i4")[:, :, 0].astype(np.float64)
    return (found / np.linalg.norm(found, axis=1, keepdims=True)).astype(np.float32)


def packed_points(df: DataFrame, key: str = "point_id", vector: str = "image_vec", dim: int = DIM, width: int = 2) -> DataFrame:
    """(id, vec) of the rows with a key and a comparable vector; equal rows of a batch are folded."""
    source = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") == dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = _fitting(batch.column(1), dim)
            if len(rows):
                ids, small = batch.column(0).to_numpy()[rows], pack(found if width >= 4 else unit_rows(found), width)
                both = np.concatenate([ids.view(np.uint8).reshape(len(ids), 8), small], axis=1)
                _, first = np.unique(np.ascontiguousarray(both).view(f"V{both.shape[1]}").ravel(), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first]), as_binary(small[first])], names=["id", "vec"])

    return source.mapInArrow(run, "id long, vec binary")


def distinct_vectors(points: DataFrame) -> DataFrame:
    """(vec, rep, top): each distinct vector with the least and the greatest id that carries it; checkpointed."""
    return cut_lineage(points.groupBy("vec").agg(F.min("id").alias("rep"), F.max("id").alias("top")))


def copies_of(points: DataFrame, vectors: DataFrame) -> DataFrame | None:
    """(id, rep) of all points whose vector several points carry; None if there are none."""
    shared = vectors.where(F.col("top") != F.col("rep")).select("vec", "rep")
    if shared.isEmpty():
        return None
    return cut_lineage(points.join(shared, "vec").select("id", "rep").distinct())


class Pivots:
    """The pivots, numbered so that those under one coarse pivot stand together."""

    def __init__(self, points: np.ndarray):
        self.points, self.coarse = np.ascontiguousarray(points, np.float32), None
        count = len(points)
        if count > SCANNED:
            self.coarse = self.points[: round(count**0.5)].copy()
            home = np.concatenate([(self.points[s : s + 4096] @ self.coarse.T).argmax(1) for s in range(0, count, 4096)])
            self.points = self.points[np.argsort(home, kind="stable")]
            self.start = np.searchsorted(np.sort(home), np.arange(len(self.coarse) + 1))
            self.opened = min(len(self.coarse), -(-SCANNED * len(self.coarse) // count))

    def __len__(self) -> int:
        return len(self.points)

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Numbers of the `probes` nearest pivots of each row, in no order; -1 where fewer were met."""
        unit, probes = unit.astype(np.float32, copy=False), min(probes, len(self))
        out = np.empty((len(unit), probes), np.int32)
        step = 1024 if self.coarse is None else 8192
        for s in range(0, len(unit), step):
            part = unit[s : s + step]
            if self.coarse is None:
                out[s : s + step] = _greatest(part @ self.points.T, probes)
                continue
            chosen = _greatest(part @ self.coarse.T, self.opened)
            near = np.full((len(part), self.opened * probes), -2, np.float32)
            number = np.full(near.shape, -1, np.int32)
            at = np.argsort(chosen.ravel(), kind="stable")
            cuts = np.searchsorted(chosen.ravel()[at], np.arange(len(self.coarse) + 1))
            for cell in np.nonzero(np.diff(cuts))[0].tolist():
                row, slot = np.divmod(at[cuts[cell] : cuts[cell + 1]], self.opened)
                a, b = self.start[cell], self.start[cell + 1]
                if a == b:
                    continue
                cos = part[row] @ self.points[a:b].T
                best = _greatest(cos, min(probes, b - a))
                places = (slot * probes)[:, None] + np.arange(best.shape[1])
                near[row[:, None], places] = np.take_along_axis(cos, best, 1)
                number[row[:, None], places] = a + best
            out[s : s + step] = np.take_along_axis(number, _greatest(near, probes), 1)
        return out


def _greatest(values: np.ndarray, count: int) -> np.ndarray:
    """Places of the `count` greatest entries of each row, in no order."""
    size = values.shape[1]
    if count >= size:
        return np.broadcast_to(np.arange(size), values.shape)
    return np.argpartition(values, size - count, axis=1)[:, size - count :]


def sample_pivots(vectors: DataFrame, rows: int, dim: int = DIM, rows_per_pivot: int | None = None) -> Pivots:
    """About one pivot for rows_per_pivot vectors, at most about MOST_PIVOTS, the same on every run."""
    count = int(min(MOST_PIVOTS, max(1, rows // (rows_per_pivot or ROWS_PER_PIVOT))))
    if count <= SORTED_SAMPLE:
        found = vectors.select("vec", "rep").orderBy(F.xxhash64("rep"), "rep").limit(count)
    else:  # no sort of that many in one task
        found = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) < int(count / rows * (1 << 40))).select("vec", "rep")
    found = found.toArrow().sort_by("rep")
    order = np.argsort(found["rep"].to_numpy().astype(np.uint64) * HASH, kind="stable")
    return Pivots(unpack(found["vec"], dim)[order])


def in_blocks(vectors: DataFrame, probes: int, dim: int = DIM, rows_per_pivot: int | None = None, with_cells: bool = False) -> DataFrame:
    """(block, id, tag, vec): each distinct vector of (vec, rep[, weight]) once for each of its blocks.

    tag is twice the weight (1 by default), plus 1 in the second part of a pair of parts. with_cells: the numbers of all
    blocks of a vector follow its bytes, so that a pair that meets in several blocks can be told to the least of them.
    """
    rows = vectors.count()
    schema = "block long, id long, tag int, vec binary"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    pivots = sample_pivots(vectors, rows, dim, rows_per_pivot)
    near = pivots.nearest(pivots.points, probes)
    load = np.bincount(near[near >= 0], minlength=len(pivots)) * (rows / len(pivots))
    parts = np.clip(np.ceil(load / PART_ROWS), 1, (1 << PART_BITS) - 1).astype(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, parts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.sort(pivots.nearest(unpack(batch.column(2), dim), probes), axis=1)
            ids, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            row, cell = np.repeat(np.arange(len(ids)), cells.shape[1]), cells.ravel().astype(np.int64)
            row, cell = row[cell >= 0], cell[cell >= 0]
            times = parts[cell]
            row, cell, split = np.repeat(row, times), np.repeat(cell, times), np.repeat(times, times)
            other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            own = (ids[row].astype(np.uint64) * HASH >> np.uint64(33)).astype(np.int64) % split
            block = (cell << (2 * PART_BITS)) | (np.minimum(own, other) << PART_BITS) | np.maximum(own, other)
            code = batch.column(2)
            if with_cells:
                numbers = np.ascontiguousarray(cells, "<i4").view(np.uint8).reshape(len(ids), -1, 4)[:, :, :CELL_BYTES]
                code = as_binary(np.concatenate([_bytes(code), numbers.reshape(len(ids), -1)], axis=1))
            tag = (2 * weight[row] + (own > other)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(ids[row]), pa.array(tag), code.take(pa.array(row))], names=["block", "id", "tag", "vec"])

    weight = F.col("weight") if "weight" in vectors.columns else F.lit(1)
    return vectors.select("rep", weight.cast("long").alias("weight"), "vec").mapInArrow(run, schema)


@dataclass
class Block:
    """Vectors to be compared with each other, or, if side is given, each with those of the other side only.

    earlier: for each row the codes of blocks with a lesser number that hold it too; a pair that has one in common was
    met there. Negative entries are no codes.
    """

    ids: np.ndarray
    unit: np.ndarray
    weight: np.ndarray
    side: np.ndarray | None
    earlier: np.ndarray

    def take(self, rows: np.ndarray, earlier: np.ndarray) -> Block:
        return Block(self.ids[rows], self.unit[rows], self.weight[rows], None if self.side is None else self.side[rows], earlier)

    def first_met(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Whether the pairs of rows (r, c) meet in no earlier block."""
        out = np.ones(len(r), bool)
        if self.earlier.shape[1]:
            for s in range(0, len(r), 1 << 18):
                a, b = self.earlier[r[s : s + (1 << 18)]], self.earlier[c[s : s + (1 << 18)]]
                for k in range(a.shape[1]):
                    out[s : s + (1 << 18)] &= ~((a[:, k, None] == b) & (b >= 0)).any(1)
        return out


def smaller_blocks(block: Block, probes: int, most: int, rows_per_pivot: int) -> Iterator[Block]:
    """The block itself, or blocks around pivots of its own if it has more than `most` rows."""
    size = len(block.ids)
    if size <= most:
        yield block
        return
    order = np.argsort(block.ids.astype(np.uint64) * HASH, kind="stable")
    cells = np.sort(Pivots(block.unit[order[: max(1, size // rows_per_pivot)]]).nearest(block.unit, probes), axis=1).astype(np.int64)
    at = np.argsort(cells.ravel(), kind="stable")
    numbers = cells.ravel()[at]
    for s, e in zip(*_runs(numbers)):
        if numbers[s] >= 0 and e - s > 1:
            rows = np.sort(at[s:e] // cells.shape[1])
            own = cells[rows]
            yield block.take(rows, np.concatenate([block.earlier[rows], np.where(own < numbers[s], own + (1 << 40), -1)], axis=1))


def _runs(keys: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
    return cuts[:-1], cuts[1:]


def tile_rows(size: int, most: int = 512) -> int:
    """Rows of a `size`-column matrix to take at once."""
    return max(1, min(most, TILE // max(size, 1)))


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true entries; faster than nonzero() of two dimensions."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def by_key(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal keys in sorted batches, each as one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        for s, e in zip(*_runs(keys)):
            if held and held[-1].column(column)[0].as_py() != keys[s]:
                yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield held[0].column(column)[0].as_py(), pa.Table.from_batches(held)


def per_block(blocks: DataFrame, work: Callable[[Block], pa.RecordBatch | None], schema: str, probes: int, code_bytes: int, dim: int = DIM) -> DataFrame:
    """work() of each block of in_blocks(), ids in order and each once; blocks of one vector are left out.

    code_bytes is the length of a packed vector; what follows it are the numbers of the vector's blocks.
    """

    most, rows_per_pivot = SUB_ROWS, ROWS_PER_PIVOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_key(batches):
            if rows.num_rows < 2:
                continue
            ids = rows.column("id").to_numpy()
            ids, order = np.unique(ids, return_index=True)
            if len(ids) < 2:
                continue
            raw, tag = _bytes(rows.column("vec"))[order], rows.column("tag").to_numpy()[order]
            earlier = np.empty((len(ids), 0), np.int64)
            if raw.shape[1] > code_bytes:
                cells = np.zeros((len(ids), (raw.shape[1] - code_bytes) // CELL_BYTES, 4), np.uint8)
                cells[:, :, :CELL_BYTES] = raw[:, code_bytes:].reshape(len(ids), -1, CELL_BYTES)
                cells = cells.view("<i4")[:, :, 0].astype(np.int64)
                earlier = np.where(cells < number >> (2 * PART_BITS), cells, -1)  # no cell at all is a great number
            first, second = (number >> PART_BITS) & ((1 << PART_BITS) - 1), number & ((1 << PART_BITS) - 1)
            whole = Block(ids, unpack(raw[:, :code_bytes], dim), tag.astype(np.int64) >> 1, (tag & 1).astype(bool) if first != second else None, earlier)
            for block in smaller_blocks(whole, probes, most, rows_per_pivot):
                out = work(block)
                if out is not None and out.num_rows:
                    yield out

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)
