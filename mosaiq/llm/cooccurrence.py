"""Items that appear together: heavy-light decomposition.

Only items that can belong to a reported pair are kept: both items of a pair with n_ab >= s have at least s records.
With s = n/1000 there are at most 1000 times the mean number of items per record of them, whatever n is, so their
dictionary may be broadcast. In each partition (records complete, sorted by id, taken in blocks) the most frequent
items form a bit matrix whose rows are ANDed and popcounted; pairs of the rest are counted by hash of the pair code; for
mixed pairs the posting list of a light item probes the bit matrix. Partial counts are added up and the lift scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mosaiq.llm.frequency import count_points, term_frequencies
from mosaiq.operators.packed import segment
from mosaiq.runtime import cut_lineage

MIN_TOGETHER = 5
MIN_SHARE = 1000  # 1000 * n_ab >= n
MIN_LIFT = 4.0
HEAVY_ITEMS = 256
BLOCK = 1 << 16
HELD_PAIRS = 4_000_000  # counts that a task keeps before it gives them out


def _popcounts(bits: np.ndarray) -> np.ndarray:
    """Upper triangle (diagonal left out) of |row a AND row b| for a bit matrix of 64-bit words."""
    size = len(bits)
    out = np.zeros((size, size), np.int64)
    for a in range(size - 1):
        out[a, a + 1 :] = np.bitwise_count(bits[a] & bits[a + 1 :]).sum(1, dtype=np.int64)
    return out


def count_block(record: np.ndarray, item: np.ndarray, heavy: int, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair codes a * items + b (a < b) and counts over one block. record: 0.., item: ids by falling frequency; unique."""
    n = int(record.max()) + 1 if len(record) else 0
    dense = np.zeros((heavy, -(-n // 64) * 64), bool)
    is_heavy = item < heavy
    dense[item[is_heavy], record[is_heavy]] = True
    bits = np.packbits(dense, axis=1, bitorder="little").view(np.uint64)
    both = _popcounts(bits)
    a, b = np.nonzero(both)
    codes, counts = [a * items + b], [both[a, b]]

    r, x = record[~is_heavy], item[~is_heavy]
    order = np.lexsort((x, r))
    r, x = r[order], x[order]
    step, light = 1, []
    while step < len(r):  # the step-th next item of the same record, until no record is so long
        same = r[step:] == r[:-step]
        if not same.any():
            break
        light.append(x[:-step][same].astype(np.int64) * items + x[step:][same])
        step += 1
    if light:
        found = np.unique(np.concatenate(light), return_counts=True)
        codes.append(found[0])
        counts.append(found[1])

    by_item = np.argsort(x, kind="stable")
    x, r = x[by_item], r[by_item]
    starts = np.nonzero(np.append(True, x[1:] != x[:-1]))[0] if len(x) else []
    for s, e in zip(starts, np.append(starts[1:], len(x)) if len(x) else []):
        hits = dense[:, r[s:e]].sum(1)
        a = np.nonzero(hits)[0]
        codes.append(a * items + x[s])
        counts.append(hits[a])
    return np.concatenate(codes), np.concatenate(counts)


def merge_counts(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def term_lists(posts: DataFrame, record: str = "point_id", packed: str = "tags") -> DataFrame:
    """(record, terms array<string>): the terms of the rows with a record id and a packed field, each once a batch and record."""
    source = posts.select(F.col(record).alias("record"), packed).where(F.col(record).isNotNull() & F.col(packed).isNotNull())
    kind = source.schema["record"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged: dict = {}  # rows of one record are folded before the shuffle
            for rec, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if found := segment(s):
                    merged.setdefault(rec, set()).update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), batch.schema.field(0).type), pa.array([sorted(x) for x in merged.values()], pa.list_(pa.string()))], names=["record", "terms"])

    return source.mapInArrow(run, f"record {kind}, terms array<string>")


def pair_counts(lists: DataFrame, ids: dict[str, int], heavy: int = HEAVY_ITEMS, block: int = BLOCK) -> DataFrame:
    """(a, b, n_ab) of all pairs of the given items (ids by falling frequency) that occur on one record of term_lists().

    Rows of one record count together; its repeated items count once.
    """
    items, heavy = len(ids), min(heavy, len(ids))
    shared = lists.sparkSession.sparkContext.broadcast(ids)
    kind = lists.schema["record"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            column = batch.column(1)
            coded = column.flatten().dictionary_encode()
            number = np.array([get(t, -1) for t in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
            row, number = row[number >= 0], number[number >= 0]
            order = np.lexsort((number, row))
            row, number = row[order], number[order]
            held, starts = np.unique(row, return_index=True)
            offsets = pa.array(np.append(starts, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int16 if items < 32_768 else np.int32)))], names=["record", "items"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, offset = [], [], 0
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def flush() -> None:
            nonlocal codes, counts, offset
            if parts:
                pair = np.unique(np.concatenate([p[0] for p in parts]).astype(np.int64) * items + np.concatenate([p[1] for p in parts]))
                got = count_block(pair // items, pair % items, heavy, items)
                codes.append(got[0])
                counts.append(got[1])
                if len(codes) > 8:
                    merged = merge_counts(codes, counts)
                    codes, counts = [merged[0]], [merged[1]]
            parts.clear()
            offset = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            if len(codes) == 1 and len(codes[0]) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(codes[0] // items), pa.array(codes[0] % items), pa.array(counts[0])], names=["a", "b", "n_ab"])
                codes, counts = [], []
            rec = batch.column(0).dictionary_encode()
            code = rec.indices.to_numpy()
            change = np.append(batch.column(0)[0].as_py() != last, code[1:] != code[:-1])
            last = batch.column(0)[batch.num_rows - 1].as_py()
            if offset > block and change[0]:
                flush()
            place = np.cumsum(change) - 1 + offset
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            parts.append((np.repeat(place, lengths), lists.flatten().to_numpy().astype(np.int64)))
            offset = int(place[-1]) + 1
            if len(parts) > 64:  # rows of one record without end
                pair = np.unique(np.concatenate([p[0] for p in parts]).astype(np.int64) * items + np.concatenate([p[1] for p in parts]))
                parts[:] = [(pair // items, pair % items)]
        flush()
        if codes:
            key, n = merge_counts(codes, counts)
            yield pa.RecordBatch.from_arrays([pa.array(key // items), pa.array(key % items), pa.array(n)], names=["a", "b", "n_ab"])

    encoded = lists.mapInArrow(encode, f"record {kind}, items array<{'smallint' if items < 32_768 else 'int'}>")
    partial = encoded.repartition("record").sortWithinPartitions("record").mapInArrow(count, "a long, b long, n_ab long")
    return partial.groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))


def items_together(posts: DataFrame, record: str = "point_id", packed: str = "tags", min_together: int = MIN_TOGETHER, min_share: int = MIN_SHARE, min_lift: float = MIN_LIFT) -> DataFrame:
    """term_a, term_b, n_ab, n_a, n_b, lift of every pair, term_a < term_b in code point order, with n_ab >=
    min_together, min_share * n_ab >= n and n_ab * n >= min_lift * n_a * n_b. Rows without a record id count nowhere; no pairs give an empty result.
    """
    spark, posts = posts.sparkSession, posts.where(F.col(record).isNotNull())
    n = count_points(posts, record)
    least = max(min_together, -(-n // min_share))
    lists = cut_lineage(term_lists(posts, record, packed))  # fields are cut once
    pairs = lists.select(F.lit(packed).alias("field_name"), F.explode("terms").alias("term"), "record", F.lit(1).cast("long").alias("n"))
    frequent = term_frequencies(pairs).where(F.col("n_points") >= least).select("term", "n_points").collect()  # min_share * items a record at most
    frequent.sort(key=lambda r: (-r.n_points, r.term))
    terms, sizes = [r.term for r in frequent], [r.n_points for r in frequent]
    schema = "term_a string, term_b string, n_ab long, n_a long, n_b long, lift double"
    if len(terms) < 2:
        return spark.createDataFrame([], schema)
    counted = pair_counts(lists, {t: i for i, t in enumerate(terms)}).where(F.col("n_ab") >= least)
    names = spark.createDataFrame(list(zip(range(len(terms)), terms, sizes)), "id long, term string, size long")
    a, b = names.toDF("a", "t_a", "s_a"), names.toDF("b", "t_b", "s_b")
    joined = counted.join(F.broadcast(a), "a").join(F.broadcast(b), "b")  # at most min_share * items per record entries
    swap = F.col("t_a") > F.col("t_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return joined.select(
        pick("t_a", "t_b").alias("term_a"), pick("t_b", "t_a").alias("term_b"), "n_ab", pick("s_a", "s_b").alias("n_a"), pick("s_b", "s_a").alias("n_b"),
        (F.col("n_ab") * F.lit(float(n)) / (F.col("s_a") * F.col("s_b"))).alias("lift"),
    ).where(F.col("n_ab") * F.lit(n) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
