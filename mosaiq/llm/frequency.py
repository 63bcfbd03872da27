"""Frequency of every distinct term: range-partitioned external sort and run-length scan.

(term, record) pairs are range-partitioned and sorted on both parts, so that a term holding a third of all pairs is
spread over many tasks while equal pairs meet in one. A run-length scan over each sorted partition counts occurrences
and distinct records; the few partial counts per term are then added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mosaiq.functions.text import normalize_array
from mosaiq.operators.packed import segment

RARE_POINTS = 3
COMMON_SHARE = 0.15


def term_pairs(posts: DataFrame, record: str = "point_id", packed: str = "tags", single: str | None = "rating") -> DataFrame:
    """(field_name, term, record, n) of every value of the packed column and, if given, of the single-valued one.

    n counts the equal pairs of one batch, folded before the shuffle.

    Null, empty and blank values give no pair; a null record id is kept as a record of its own.
    """
    columns = [record, packed] + ([single] if single else [])
    source = posts.select(*columns)
    kind = source.schema[record].dataType.simpleString()

    def fold(name: str, term: pa.Array, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        counted = pa.table({"term": term, "record": ids}).group_by(["term", "record"]).aggregate([([], "count_all")])
        for x in counted.to_batches():
            yield pa.RecordBatch.from_arrays([pa.array([name] * x.num_rows, pa.string()), x["term"], x["record"], x["count_all"]], names=["field_name", "term", "record", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = [], []
            for r, field in enumerate(batch.column(1).to_pylist()):
                if field:
                    cut = segment(field)
                    rows += [r] * len(cut)
                    values += cut
            yield from fold(packed, pa.array(values, pa.string()), batch.column(0).take(pa.array(rows, pa.int64())))
            if single:
                term = normalize_array(batch.column(2))
                keep = pc.is_valid(term)
                yield from fold(single, term.filter(keep), batch.column(0).filter(keep))

    return source.mapInArrow(run, f"field_name string, term string, record {kind}, n long")


def _differs(values: pa.Array) -> np.ndarray:
    """For each entry but the first, whether it differs from the one before; nulls are equal."""
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each run of equal (field_name, term) in sorted batches, at most one row per run and batch.

    A record whose run reaches over a batch boundary is counted in the first of the batches only.
    """
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new_term = np.concatenate([[True], _differs(batch.column(0)) | _differs(batch.column(1))])
        new_pair = new_term.copy()
        new_pair[1:] |= _differs(batch.column(2))
        first = tuple(batch.column(k)[0].as_py() for k in range(3))
        new_pair[0] = first != last
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(3))
        starts = np.nonzero(new_term)[0]
        at = pa.array(starts)
        occurrences = np.add.reduceat(batch.column(3).to_numpy(), starts)
        records = np.add.reduceat(new_pair.astype(np.int64), starts)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(occurrences), pa.array(records)], names=["field_name", "term", "n", "records"])


def term_frequencies(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """field_name, term, occurrences, n_points (distinct records) of every term in term_pairs()."""
    keys = ["field_name", "term", "record"]
    ranged = pairs.repartitionByRange(partitions, *keys) if partitions else pairs.repartitionByRange(*keys)
    partial = ranged.sortWithinPartitions(*keys).mapInArrow(run_lengths, "field_name string, term string, n long, records long")
    return partial.groupBy("field_name", "term").agg(F.sum("n").alias("occurrences"), F.sum("records").alias("n_points"))


def mark_terms(frequencies: DataFrame, n_points: int, rare: int = RARE_POINTS, common: float = COMMON_SHARE) -> DataFrame:
    """frequencies with mark: 'rare' up to `rare` points, 'common' above the share `common` of n_points, else null."""
    mark = F.when(F.col("n_points") <= rare, "rare").when(F.col("n_points") > F.lit(round(common * n_points, 6)), "common")
    return frequencies.withColumn("mark", mark)


def count_points(posts: DataFrame, record: str = "point_id") -> int:
    return posts.select(record).where(F.col(record).isNotNull()).distinct().count()
