"""Cutting oversized texts at natural boundaries: structure-tree packing.

A subtitle text is parsed into a tree: the file, its cues (blocks after a blank line, or from a timing line on), their
lines, and the words of a line; a word beyond WORD_TOKENS tokens is parted at character borders. Bottom-up, neighbouring
subtrees are merged while they stay within what the piece's lead leaves of the limit; only nodes beyond the limit, or
beyond that rest at the start of a piece, are descended into. Each piece but the first is led in by the end of the text
before it: the least number of whole words with at least `overlap` tokens.

All cuts lie between pre-tokens, so a piece has the tokens it has within the file, but for white space at its end, which
is counted apart; n_tokens is the exact count of the piece by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mosaiq.llm import tokens as T

LIMIT = 512
OVERLAP = 32
WORD_TOKENS = 16

_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_LINE_GAP = re.compile(f"[\n\r\x0b\x0c\x85\u2028\u2029][{T.SPACE}]*")
_IN_LINE = "[^\\S\n\r\x0b\x0c\x85\u2028\u2029]*"
#: fixed pattern: start and end time of a cue in the three formats, as srt, vtt or sbv write it
_TIMING = re.compile(rf"(?:\d+:)?\d+:\d+[.,]\d+{_IN_LINE}(?:-->|,){_IN_LINE}(?:\d+:)?\d+:\d+[.,]\d")
_NUMBER = re.compile(r"\s*\d+\s*$")


def atoms(text: str, table: T._Table) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Character starts (with the end), token counts and texts of the smallest units: pre-tokens, long ones in parts."""
    pieces = T.pretokens(text)
    counts = np.fromiter(map(len, map(table.__getitem__, pieces)), np.int64, len(pieces)) // 4
    if len(counts) and counts.max() > WORD_TOKENS:
        tokens = table.merges.tokens
        out: list[str] = []
        sizes: list[int] = []
        for piece, n in zip(pieces, counts.tolist()):
            if n <= WORD_TOKENS:
                out.append(piece)
                sizes.append(n)
                continue
            held, size = b"", 0
            for i in np.frombuffer(table[piece], "<i4").tolist():
                part = tokens[i]
                if size >= WORD_TOKENS and part[0] & 0xC0 != 0x80:  # a character starts here
                    out.append(held.decode())
                    sizes.append(size)
                    held, size = b"", 0
                held, size = held + part, size + 1
            out.append(held.decode())
            sizes.append(size)
        pieces, counts = out, np.array(sizes, np.int64)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    return starts, counts, pieces


def structure(text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the atoms at which cues and lines start (0 is among both)."""
    gaps = [(m.end(), m.group()) for m in _LINE_GAP.finditer(text)]
    if gaps and gaps[-1][0] == len(text):
        gaps.pop()
    ends = [end for end, _ in gaps]
    # the atom that holds the first character of the line, or the space before it
    heads = (np.searchsorted(starts, ends, side="right") - 1).tolist()
    lines = [0, *heads]
    blank = {0, *(k for k, (_, gap) in zip(heads, gaps) if len(gap) > 1 and _is_blank_line(gap))}
    place = {end: n for n, end in enumerate(ends, 1)}  # the number of the line by its first character
    place[len(text) - len(text.lstrip())] = 0
    for found in _TIMING.finditer(text):
        if (n := place.get(found.start())) is not None:
            before = lines[n - 1] if n else 0
            numbered = n and _NUMBER.match(text, int(starts[before]), int(starts[lines[n]]))
            blank.add(before if numbered else lines[n])
    return np.array(sorted(blank)), np.array(lines)


@lru_cache(maxsize=4096)
def _is_blank_line(gap: str) -> bool:
    return len(_LINE_END.findall(gap)) > 1


def leaves(first: int, last: int, level: int, cum: np.ndarray, levels: list[np.ndarray], limit: int) -> list[int]:
    """Ends of the subtrees of at most `limit` tokens that cover the atoms [first, last) in order."""
    if cum[last] - cum[first] <= limit or last - first == 1:
        return [last]
    if level == len(levels):
        return list(range(first + 1, last + 1))
    inner = levels[level]
    cuts = inner[np.searchsorted(inner, first, side="right") : np.searchsorted(inner, last)].tolist()
    return [end for a, b in zip([first, *cuts], [*cuts, last]) for end in leaves(a, b, level + 1, cum, levels, limit)]


def cut_text(text: str, table: T._Table, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, own start, end, tokens) of the pieces of a text in characters; one piece if it is within the limit.

    A piece is text[start:end]; text[start:own start] is what it shares with the piece before.
    """
    starts, counts, pieces = atoms(text, table)
    cum = np.concatenate([[0], np.cumsum(counts)])
    if cum[-1] <= limit:
        return [(0, 0, len(text), int(cum[-1]))]
    levels, size = list(structure(text, starts)), len(pieces)
    ends = np.array(leaves(0, size, 0, cum, levels, limit))
    lines = np.append(levels[1], size)

    def tokens(lead: int, b: int) -> int:
        tail = b
        while tail > lead and T.is_space(pieces[tail - 1]):
            tail -= 1
        return int(cum[tail] - cum[lead]) + (len(table["".join(pieces[tail:b])]) // 4 if tail < b else 0)

    out, a = [], 0
    while a < size:
        lead = max(int(np.searchsorted(cum, cum[a] - overlap, side="right")) - 1, 0) if a else 0
        most = cum[lead] + limit
        while True:
            furthest = int(np.searchsorted(cum, most, side="right")) - 1  # the last atom's end within the limit
            b = max((int(x[k]) for x in (ends, lines) if (k := int(np.searchsorted(x, furthest, side="right")) - 1) >= 0 and x[k] > a and (x is ends or not _reaches(ends, a, furthest))), default=max(furthest, a + 1))
            if (n := tokens(lead, b)) <= limit or b == a + 1:
                break
            most = cum[b] - 1  # white space at the end takes more tokens by itself
        out.append((int(starts[lead]), int(starts[a]), int(starts[b]), n))
        a = b
    return out


def _reaches(ends: np.ndarray, a: int, furthest: int) -> bool:
    """Whether a subtree ends after a, up to furthest."""
    k = int(np.searchsorted(ends, furthest, side="right")) - 1
    return k >= 0 and ends[k] > a


def split_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, name: str = T.BYTE_BPE, folder: str | None = None) -> DataFrame:
    """(key, piece, start, own_start, stop, n_tokens, text) of every text of more than `limit` tokens.

    piece counts from 1; start, own_start and stop are characters from 0: the piece is [start, stop), and [start,
    own_start) is shared with the piece before it: the fewest whole words (in parts of WORD_TOKENS, long ones) before it
    that have `overlap` tokens. The own parts cover the text without gap. Texts within the limit, empty and null ones give no
    rows. One scan, no shuffle.
    """
    if not 0 <= overlap + 2 * WORD_TOKENS < limit:
        raise ValueError("limit must exceed the overlap and twice WORD_TOKENS")
    path = T.vocabulary_path(name, folder)
    source = documents.select(key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = T.table_for(path)
        for batch in batches:
            rows, found, parts = [], [], []
            for r, x in enumerate(batch.column(1).to_pylist()):
                if x and (len(x) * 4 > limit) and len(x.encode()) > limit:  # a token has a byte or more
                    pieces = cut_text(x, table, limit, overlap)
                    if len(pieces) > 1:
                        rows += [r] * len(pieces)
                        found += [(k + 1, *p) for k, p in enumerate(pieces)]
                        parts += [x[p[0] : p[2]] for p in pieces]
            columns = list(zip(*found)) if found else [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(parts, pa.string())],
                names=[key, "piece", "start", "own_start", "stop", "n_tokens", "text"],
            )

    return source.mapInArrow(run, f"`{key}` {kind}, piece int, start long, own_start long, stop long, n_tokens long, text string")
