"""Per-key results although a few keys hold most rows.

Each map task folds its rows into mergeable key states; only those compact states are shuffled. Counts, minima and maxima
are Spark's own partial aggregates, over the key as it is written: few spellings, brought to one form only when they
have been counted. The set of distinct items of a key is such a state too: a map task holds the ids it has met in
bounded tables, one for each key and range of 2^RANGE_BITS ids, and gives out their sorted gaps as bytes, one to four a number; states
of a key and range meet in one task, which merges them, many by a bit map, so neither a hot key nor its set is
ever in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mosaiq.runtime import cut_lineage

RANGE_BITS = 22
DENSE_ITEMS = 1 << 16  # from so many on, a bit map is made
HELD_ITEMS = 2_000_000  # of a map task, before its states are given out


def counted_keys(df: DataFrame, key: str, form: Callable[[str], Column], measure: Column | None = None) -> DataFrame:
    """One row per key in its `form`: n_rows, and first_value and last_value of measure; null keys form a row."""
    states = df.select(F.col(key).alias("key"), (F.lit(None).cast("long") if measure is None else measure).alias("measure"))
    by_spelling = states.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("measure").alias("lo"), F.max("measure").alias("hi"))
    return by_spelling.groupBy(form("key").alias("key")).agg(F.sum("n").alias("n_rows"), F.min("lo").alias("first_value"), F.max("hi").alias("last_value"))


def to_gaps(sorted_values: np.ndarray) -> bytes:
    """Rising numbers below 2^32 as gaps in groups of 7 bits, the last group of each marked."""
    gaps = np.diff(sorted_values, prepend=0).astype(np.uint64)
    groups = np.stack([(gaps >> np.uint64(7 * k)) & np.uint64(127) for k in range(5)], axis=1).astype(np.uint8)
    last = np.where(gaps > 0, (np.frexp(gaps.astype(np.float64))[1] - 1) // 7, 0)
    groups[np.arange(len(gaps)), last] |= 128
    return groups[np.arange(5) <= last[:, None]].tobytes()


def from_gaps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.nonzero(raw & 128)[0]
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), starts)) if len(ends) else np.empty(0, np.int64)


def distinct_items(df: DataFrame, key: str, form: Callable[[str], Column], item: str) -> DataFrame:
    """(key, n_items): the number of distinct whole numbers `item` of each key in its form; nulls don't count."""
    source = df.select(F.col(key).alias("key"), F.col(item).cast("long").alias("item")).where(F.col("item").isNotNull())

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str | None, list[np.ndarray]] = {}
        held = 0

        def take() -> Iterator[pa.RecordBatch]:
            for name, parts in tables.items():
                items = np.unique(np.concatenate(parts))
                spans = items >> RANGE_BITS
                cuts = [0, *(np.nonzero(spans[1:] != spans[:-1])[0] + 1).tolist(), len(items)]
                low = items & ((1 << RANGE_BITS) - 1)
                states = [to_gaps(low[s:e]) for s, e in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(states), pa.string()), pa.array(spans[cuts[:-1]]), pa.array(states, pa.binary())], names=["key", "span", "state"])
            tables.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            codes, items = names.indices.to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
            for name, s, e in zip(names.dictionary.to_pylist(), cuts, cuts[1:]):
                found = np.unique(items[order[s:e]])
                tables.setdefault(name, []).append(found)
                held += len(found)
            if held > HELD_ITEMS:
                yield from take()
                held = 0
        yield from take()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, names, counts = None, [], [], []

        def merged() -> np.ndarray:
            if sum(map(len, held)) < DENSE_ITEMS:
                return np.unique(np.concatenate(held))
            bits = np.zeros(1 << RANGE_BITS, bool)
            for x in held:
                bits[x] = True
            return np.flatnonzero(bits)

        def take() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["key", "n"])
            names.clear()
            counts.clear()
            return out

        for batch in batches:
            for name, span, state in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (name, span) != now:
                    names.append(now[0])
                    counts.append(len(merged()))
                    held = []
                now = name, span
                held.append(from_gaps(state))
                if len(held) > 64:
                    held = [merged()]
            if len(names) > 10_000:
                yield take()
        if held:
            names.append(now[0])
            counts.append(len(merged()))
        yield take()

    states = source.mapInArrow(fold, "key string, span long, state binary")
    # spellings are states of their own until here; there are few for many rows
    formed = states.select(form("key").alias("key"), "span", "state").repartition("key", "span").sortWithinPartitions("key", "span")
    return formed.mapInArrow(add, "key string, n long").groupBy("key").agg(F.sum("n").alias("n_items"))


def per_key(df: DataFrame, key: str, form: Callable[[str], Column], item: str, measure: Column) -> DataFrame:
    """One row per key: n_rows, n_items (distinct whole numbers, nulls don't count), first_value and last_value of measure.

    A null key forms a row of its own. Null measures are ignored; a key with none has null there. An empty table gives
    no rows.
    """
    items = distinct_items(df, key, form, item).withColumnRenamed("key", "__key")
    found = counted_keys(df, key, form, measure).join(items, F.col("key").eqNullSafe(F.col("__key")), "left")
    return found.select("key", "n_rows", F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_value", "last_value")


def heavy_keys(summary: DataFrame, share: float) -> DataFrame:
    """Rows of counted_keys() whose key isn't null and holds at least `share` of all rows, null keys counting in the total.

    The total comes from the summary, one row per key, which is kept so that the data are read once.
    """
    summary = cut_lineage(summary)
    total = summary.agg(F.sum("n_rows")).first()[0] or 0
    return summary.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(round(share * total, 6))))
