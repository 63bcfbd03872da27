"""Filling containers of fixed token capacity along a space-filling curve.

Each text gets its size in tokens and a hashed vector: its token ids are hashed into BUCKETS counters, scaled to unit
length and projected to a few dimensions; the place of that point on a Hilbert curve is the text's key. Texts are
range-sorted by key, so like stands by like, and each range packs its texts in curve order: a window of neighbours is
taken at a time, largest first, each into the open container that it fills best. At most OPEN containers stay open;
those left unfilled at the end of a range are few and packed once more, whole.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm import tokens as T
from mosaiq.llm.hilbert import hilbert_keys
from mosaiq.runtime import cut_lineage

CAPACITY = 2048
BUCKETS = 1024
DIMS = 4
BITS = 12
WINDOW = 1024
OPEN = 256
LOOSE = 0.98  # containers less full than this are packed again


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((BUCKETS, DIMS))


def curve_keys(hashed: np.ndarray) -> np.ndarray:
    """Hilbert keys of rows of hashed counts. Coordinates are near normal; the tanh spreads them over the cube."""
    norm = np.linalg.norm(hashed, axis=1, keepdims=True)
    place = hashed / np.where(norm > 0, norm, 1) @ _projection()
    cells = np.minimum(((np.tanh(place * 0.8) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return hilbert_keys(cells, BITS)


def sized_documents(documents: DataFrame, key: str, text: str, name: str, folder: str | None) -> DataFrame:
    """(id, n_tokens, curve) of each row; an empty or null text has no tokens."""
    path = T.vocabulary_path(name, folder)
    source = documents.select(F.col(key).alias("id"), text)
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = T.table_for(path)
        for batch in batches:
            sizes, hashed = [], np.zeros((batch.num_rows, BUCKETS), np.float32)
            for r, x in enumerate(batch.column(1).to_pylist()):
                ids = np.frombuffer(T.encode(x, table), "<i4")
                sizes.append(len(ids))
                # multiplicative hash of the id to 10 bits
                hashed[r] = np.bincount((ids.astype(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(22), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(curve_keys(np.log1p(hashed)))], names=["id", "n_tokens", "curve"])

    return source.mapInArrow(run, f"id {kind}, n_tokens long, curve long")


class Packer:
    """Best fit over a bounded number of open containers."""

    def __init__(self, capacity: int, first: int, most_open: int = OPEN):
        self.capacity, self.next, self.most = capacity, first, most_open
        self.open: list[tuple[int, int]] = []  # (free, container)

    def put(self, size: int) -> int:
        k = bisect_left(self.open, (size, -1))
        if k < len(self.open):
            free, container = self.open.pop(k)
        else:
            free, container = self.capacity, self.next
            self.next += 1
        if free > size or size == 0:
            insort(self.open, (free - size, container))
            if len(self.open) > self.most:
                self.open.pop(0)
        return container


def fill_containers(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, name: str = T.BYTE_BPE, folder: str | None = None) -> DataFrame:
    """(container, doc_id, part, n_parts, first_token, n_tokens): every row of documents once, or once per part.

    A text of more than `capacity` tokens is cut into full containers and a rest, which is packed like any other text;
    all others stay whole. Empty and null texts have size 0 and take a place in some container.
    """
    size = F.col("n_tokens")
    n_parts = F.greatest(F.lit(1), F.ceil(size / capacity)).cast("int")
    items = (
        cut_lineage(sized_documents(documents, key, text, name, folder))
        .withColumn("n_parts", n_parts)
        .withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n_parts"))))
        .withColumn("first_token", (F.col("part") - 1) * F.lit(capacity).cast("long"))
        .withColumn("size", F.least(F.lit(capacity).cast("long"), size - F.col("first_token")))
        .select("curve", "id", "part", "n_parts", "first_token", "size")
    )
    kind = items.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            sizes = batch.column(5).to_numpy()
            container = np.empty(len(sizes), np.int64)
            for s in range(0, len(sizes), WINDOW):
                for r in (np.argsort(-sizes[s : s + WINDOW], kind="stable") + s).tolist():
                    container[r] = packer.put(int(sizes[r]))
            yield pa.RecordBatch.from_arrays([pa.array(container), *batch.columns[1:]], names=["container", "id", "part", "n_parts", "first_token", "size"])

    ranged = items.repartitionByRange("curve", "id", "part").sortWithinPartitions("curve", "id", "part")
    packed = cut_lineage(ranged.mapInArrow(run, f"container long, id {kind}, part int, n_parts int, first_token long, size long"))

    # what is left open at the end of each range, about OPEN containers of it; neighbouring ranges are merged
    loose = packed.groupBy("container").agg(F.sum("size").alias("fill")).where(F.col("fill") < F.lit(LOOSE * capacity))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, (1 << 62) + (TaskContext.get().partitionId() << 40))
        for batch in batches:
            fills = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.put(x) for x in fills], pa.int64())], names=["container", "merged"])

    moved = loose.repartitionByRange(F.shiftright("container", 44)).sortWithinPartitions(F.desc("fill"), "container").mapInArrow(again, "container long, merged long")
    return packed.join(moved, "container", "left").select(
        F.coalesce("merged", "container").alias("container"), F.col("id").alias(key), "part", "n_parts", "first_token", F.col("size").alias("n_tokens")
    )
