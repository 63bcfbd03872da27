"""Several values packed in one string field: dictionary-guided segmentation.

A multi-pattern automaton finds the known whole values of a dictionary in a field; dynamic programming then picks the
cheapest cover of the field by known values, quoted literals, plain runs and delimiters. A delimiter inside a known or
quoted value is thereby kept. Costs: known value 1, unknown quoted literal 2, unknown plain run 3, delimiters 0; of
equally cheap covers the one with the longer first value is taken.

Defined results: null, empty and blank fields give no rows; an opening quote that is never closed is ordinary content;
a quote inside a plain run is content; repeated values are all kept, with their own place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: fixed values: the list punctuation of a field (besides any white space)
LIST_PUNCTUATION = ",;|、"
#: at most so many known values are broadcast, the most frequent ones; rarer ones are still cut right by the grammar
DICTIONARY_BOUND = 65_536

_DELIMITERS = re.compile(rf"[\s{LIST_PUNCTUATION}]+")
_QUOTED = re.compile(r'"(?:[^"\\]|\\.|"")*"', re.S)
_RUN = re.compile(rf"[^\s{LIST_PUNCTUATION}]+")
_ESCAPED = re.compile(r'\\"|""')


def fold(field: str) -> str:
    """The field after NFKC and lower case, without enclosing white space and list brackets."""
    if not field.isascii():
        field = unicodedata.normalize("NFKC", field)
    field = field.lower().strip()
    if field[:1] == "[" and field[-1:] == "]" and len(field) > 1:
        field = field[1:-1]
    return field


def unquote(literal: str) -> str:
    return _ESCAPED.sub('"', literal[1:-1])


@lru_cache(maxsize=4)
def automaton(known: tuple[str, ...]) -> ahocorasick.Automaton | None:
    if not known:
        return None
    found = ahocorasick.Automaton()
    for value in known:
        found.add_word(value, len(value))
    found.make_automaton()
    return found


def best_cover(s: str, matches: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Spans of the values in the cheapest cover of s. matches: ends of known values by their start."""
    size = len(s)
    cost: dict[int, tuple[int, int]] = {size: (0, size)}  # boundary -> (cost of the rest, next boundary)
    edges: dict[int, list[tuple[int, int]]] = {}
    todo, seen = [0], {0}
    while todo:  # boundaries that a cover can reach
        i = todo.pop()
        if i == size:
            continue
        out = edges[i] = []
        if gap := _DELIMITERS.match(s, i):
            out.append((gap.end(), 0))
        else:
            for j in matches.get(i, ()):
                if j == size or _DELIMITERS.match(s, j):
                    out.append((j, 1))
            literal = _QUOTED.match(s, i) if s[i] == '"' else None
            if literal:
                out.append((literal.end(), 2))
            else:
                out.append((_RUN.match(s, i).end(), 3))
        for j, _ in out:
            if j not in seen:
                seen.add(j)
                todo.append(j)
    for i in sorted(edges, reverse=True):
        cost[i] = min((price + cost[j][0], -j) for j, price in edges[i])
        cost[i] = (cost[i][0], -cost[i][1])
    spans, i = [], 0
    while i < size:
        j = cost[i][1]
        if not _DELIMITERS.match(s, i):
            spans.append((i, j))
        i = j
    return spans


def segment(field: str, known: tuple[str, ...] = ()) -> list[str]:
    """The values of one field in the order written, in normal form; empty ones are dropped."""
    s = fold(field)
    machine = automaton(known)
    matches: dict[int, list[int]] = {}
    if machine is not None:
        for last, length in machine.iter(s):
            matches.setdefault(last + 1 - length, []).append(last + 1)
    if '"' not in s and not matches:
        return _RUN.findall(s)  # plain runs only: the cover is unique
    out = []
    for i, j in best_cover(s, matches):
        value = s[i:j]
        if value[0] == '"' and (m := _QUOTED.match(value)) and m.end() == len(value):
            value = unquote(value)
        value = "_".join(value.split())
        if value:
            out.append(value)
    return out


def known_values(df: DataFrame, column: str, bound: int = DICTIONARY_BOUND) -> tuple[str, ...]:
    """Dictionary for segment(): the written literals of the whole column that hold a delimiter, most frequent first.

    Only quoted spellings enter, so a known value never joins what stands unquoted beside a delimiter. At most `bound`
    entries reach the driver; the result of segment() doesn't depend on the bound.
    """
    literal = r'"(?:[^"\\]|\\.|"")*"'
    found = (
        df.select(F.lower(F.col(column)).alias("s"))
        .where(F.col("s").contains('"'))
        .select(F.explode(F.regexp_extract_all("s", F.lit(f"({literal})"), F.lit(1))).alias("v"))
        .where(F.col("v").rlike(rf"[\s{LIST_PUNCTUATION}]"))
        .groupBy("v").count()
        .orderBy(F.desc("count"), "v").limit(bound)
    )
    folded = {fold(r.v) for r in found.collect()}
    return tuple(sorted(v for v in folded if _QUOTED.fullmatch(v)))


def split_packed(df: DataFrame, column: str, keys: Iterable[str], known: tuple[str, ...] | None = None, value_name: str = "term", pos_name: str = "pos") -> DataFrame:
    """One row per value of df[column]: the key columns, pos (int, from 1 in the order written), value.

    known: the dictionary; None collects it from the column itself. One scan without a shuffle; other columns of df are
    never read.
    """
    keys = list(keys)
    if known is None:
        known = known_values(df, column)
    shared = df.sparkSession.sparkContext.broadcast(known)
    source = df.select(*keys, F.col(column).alias("__packed"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            fields = batch.column(batch.num_columns - 1).to_pylist()
            rows, places, values = [], [], []
            for r, field in enumerate(fields):
                if field:
                    cut = segment(field, words)
                    rows += [r] * len(cut)
                    places += range(1, len(cut) + 1)
                    values += cut
            take = pa.array(rows, pa.int64())
            columns = [batch.column(k).take(take) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int32()), pa.array(values, pa.string())], names=[*keys, pos_name, value_name])

    return source.mapInArrow(run, f"{schema}, `{pos_name}` int, `{value_name}` string")
