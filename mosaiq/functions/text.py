"""Normal form of short strings, as plain Python and as an Arrow column function."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def normal_form(value: str) -> str:
    """NFKC, lower case, trimmed, each run of white space one underscore."""
    if not value.isascii():
        value = unicodedata.normalize("NFKC", value)
    return "_".join(value.lower().split())


def normalize_array(values: pa.Array) -> pa.Array:
    """normal_form of each entry, computed once per distinct value of the batch; null and blank become null."""
    coded = values.dictionary_encode()
    names = [normal_form(x) if x is not None else "" for x in coded.dictionary.to_pylist()]
    return pa.array([x or None for x in names], pa.string()).take(coded.indices)


def normal_form_col(col: Column | str) -> Column:
    """Column in normal form; null, empty and blank give null."""

    @arrow_udf("string")
    def apply(values: pa.Array) -> pa.Array:
        return normalize_array(values)

    return apply(col)
