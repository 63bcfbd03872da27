"""Byte-level BPE of a whole corpus by a bounded-lookahead streaming transducer.

Text is fed in windows of any size. Two stages hold back only what later text can still change:

1. Pre-tokens. A window ends where the next character can't change the cut before it (_safe_cut), so whole pre-tokens
   are emitted and a short tail is carried over.
2. Merges. A pre-token is a sequence of bytes. For each byte position the last token of the encoding of the prefix
   ending there is unique: the longest vocabulary token t ending there whose predecessor's last token p is compatible
   with it, that is, whose pair encodes to (p, t) again. No token is longer than `lookahead` bytes, computed from the
   merge list, so every later path passes through one of the last `lookahead` positions; tokens before their common
   ancestor are stable and emitted, and positions before it forgotten.

Short pre-tokens repeat, so their ids are kept in a bounded table. Decoding is the reverse: ids to bytes, through an
incremental UTF-8 decoder that holds at most three bytes.
"""

from __future__ import annotations

import base64
import codecs
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BYTE_BPE = "byte_bpe_50k"
WINDOW = 1 << 16  # characters fed at once
LONGEST_KEPT = 64  # characters of a pre-token whose ids are kept
TABLE_BOUND = 200_000  # entries of that table; it is emptied when full


def vocabulary_path(name: str = BYTE_BPE, folder: str | None = None) -> str:
    """Path of a public tokenizer's rank file; folder defaults to the installed public_tokenizers."""
    if folder:
        return f"{folder}/{name}.tiktoken"
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


#: fixed values: the white space of the public pre-token pattern, as a regex class
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(maxsize=2)
def _classes(limit: int = sys.maxunicode) -> tuple[str, str]:
    """Regex classes of the letters and the numbers up to a code point, by this Python's Unicode tables."""
    spans: dict[str, list[list[int]]] = {"L": [], "N": []}
    for code in range(limit + 1):
        kind = unicodedata.category(chr(code))[0]
        if kind in spans:
            last = spans[kind]
            if last and last[-1][1] == code - 1:
                last[-1][1] = code
            else:
                last.append([code, code])
    text = {k: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in v) for k, v in spans.items()}
    return text["L"], text["N"]


@lru_cache(maxsize=2)
def pretoken_pattern(limit: int = sys.maxunicode) -> re.Pattern:
    """The public pre-token pattern, with the letter and number properties written out for the standard library.

    Its white space is Unicode's property, which unlike Python's leaves out the four separators 1C-1F. A limit of FFFF
    makes character classes that are looked up in a table, several times as fast.
    """
    letter, number = _classes(limit)
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


_BEYOND_TABLE = re.compile("[\U00010000-\U0010ffff]")


_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{SPACE}]", c))


def is_space(pretoken: str) -> bool:
    return pretoken[-1] in _SPACES  # a word may begin with a space, but not end with one


def pretokens(text: str) -> list[str]:
    return pretoken_pattern(sys.maxunicode if _BEYOND_TABLE.search(text) else 0xFFFF).findall(text)


#: characters that must follow a pre-token's end before it is certain (a contraction has up to three)
PRETOKEN_LOOKAHEAD = 3


class Merges:
    """A rank file: token ids by bytes, and the compatibility of neighbouring tokens."""

    def __init__(self, path: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                token, _, rank = line.partition(b" ")
                if rank:
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {i: t for t, i in self.ranks.items()}
        #: sufficient lookahead in bytes: no token is longer
        self.lookahead = max(map(len, self.ranks))
        self.suffixes = {t[k:] for t in self.ranks for k in range(len(t))}
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, text: bytes) -> list[bytes]:
        """Merges by rank, the leftmost first of equal ones, until none is left. Quadratic: for a token or two."""
        pieces = [text[k : k + 1] for k in range(len(text))]
        while len(pieces) > 1:
            rank, k = min((self.ranks.get(pieces[k] + pieces[k + 1], sys.maxsize), k) for k in range(len(pieces) - 1))
            if rank == sys.maxsize:
                break
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        return pieces

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether left and right stay these two tokens when they meet."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self.merge(left + right) == [left, right]
        return known


class MergeState:
    """Encoding of one pre-token whose bytes arrive bit by bit."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.text = b""  # bytes from the last stable border on
        self.starts: list[int] = []  # for each byte, where the last token of the prefix ending with it starts

    def feed(self, data: bytes) -> list[int]:
        """The ids that became stable."""
        base, m = len(self.text), self.m
        self.text += data
        text, starts, ranks, suffixes = self.text, self.starts, m.ranks, m.suffixes
        for end in range(base + 1, len(text) + 1):
            found, start = -1, end - 1
            options = []
            while start >= 0 and (piece := text[start:end]) in suffixes:
                if piece in ranks:
                    options.append((start, piece))
                start -= 1
            for start, piece in reversed(options):
                if start == 0 or m.fits(text[starts[start - 1] : start], piece):
                    found = start
                    break
            starts.append(found)
        return self._emit() if len(text) > 4 * m.lookahead else []

    def _path(self, end: int) -> list[int]:
        """Borders of the encoding of text[:end], from the last to the first."""
        out = []
        while end:
            out.append(end)
            end = self.starts[end - 1]
        return out

    def _emit(self) -> list[int]:
        """Ids up to the common ancestor of all positions that a later token can start at."""
        size = len(self.text)
        common = set(self._path(size))
        for end in range(max(1, size - self.m.lookahead), size):
            common &= {*self._path(end)}
        if not common:
            return []
        border = max(common)
        ids = self._ids(border)
        self.text = self.text[border:]
        self.starts = [max(x - border, 0) for x in self.starts[border:]]
        return ids

    def _ids(self, end: int) -> list[int]:
        borders = self._path(end)[::-1]
        return [self.m.ranks[self.text[a:b]] for a, b in zip([0, *borders], borders)]

    def finish(self) -> list[int]:
        return self._ids(len(self.text))


class _Table(dict):
    """Ids of short pre-tokens as packed 32-bit integers, made when first asked for."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        state = MergeState(self.merges)
        out = np.array(state.feed(piece.encode()) + state.finish(), "<i4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= TABLE_BOUND:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """feed() windows of a text, the last with final=True; each call returns the ids certain by then, packed."""

    def __init__(self, table: _Table):
        self.table, self.held, self.run = table, "", None

    def feed(self, window: str, final: bool = False) -> bytes:
        out, text = [], self.held + window
        if self.run is not None:
            text = self._continue(text, final, out)
        if self.run is None and text:
            pieces = pretokens(text)
            if final:
                text = ""
            else:
                end, certain = len(text), len(text) - PRETOKEN_LOOKAHEAD
                while pieces and end > certain:
                    end -= len(pieces.pop())
                text = text[end:]
            out.append(b"".join(map(self.table.__getitem__, pieces)))
            if len(text) > max(WINDOW, 16):  # begins with a pre-token about as long as a window
                run, state = _run_of(text[0]), MergeState(self.table.merges)
                if text[0] == " " and not run.match(text[1]).end():  # a space before a word belongs to it
                    state.feed(b" ")
                    text, run = text[1:], _run_of(text[1])
                self.run = (run, state)
                text = self._continue(text, False, out)
        self.held = text
        return b"".join(out)

    def _continue(self, text: str, final: bool, out: list[bytes]) -> str:
        """Takes the rest of a long pre-token from the start of text; returns what it leaves."""
        more, state = self.run
        end = more.match(text).end()
        closed = end < len(text) or final
        blank = more is _runs()[0]
        keep = 1 if blank and not (final and end == len(text)) and end else 0  # the last space may belong to the next word
        ids = state.feed(text[: end - keep].encode())
        if closed:
            ids += state.finish()
            self.run = None
        out.append(np.array(ids, "<i4").tobytes())
        return text[end - keep :]


@lru_cache(maxsize=1)
def _runs() -> tuple[re.Pattern, ...]:
    letter, number = _classes()
    return tuple(re.compile(f"[{x}]*") for x in (SPACE, letter, number, f"^{SPACE}{letter}{number}"))


def _run_of(character: str) -> re.Pattern:
    return next(run for run in _runs() if run.fullmatch(character))


@lru_cache(maxsize=4)
def table_for(path: str) -> _Table:
    return _Table(Merges(path))


def encode(text: str | None, table: _Table) -> bytes:
    """Ids of a whole text, packed; nothing for an empty or null one."""
    if not text:
        return b""
    state = Encoder(table)
    if len(text) <= WINDOW:
        return state.feed(text, True)
    return b"".join(state.feed(text[k : k + WINDOW], k + WINDOW >= len(text)) for k in range(0, len(text), WINDOW))


def decode(ids: Iterable[int], table: _Table) -> Iterator[str]:
    """The text of the ids, bit by bit; a character is given out once its last byte has come."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    tokens = table.merges.tokens
    for i in ids:
        yield machine.decode(tokens[i])
    yield machine.decode(b"", True)


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = BYTE_BPE, folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) of each row of documents, without special tokens; [] for an empty or null text.

    One scan of the two columns, no shuffle; a text of any length takes constant memory beside its own.
    """
    path = vocabulary_path(name, folder)
    source = documents.select(key, text)
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_for(path)
        for batch in batches:
            packed = [encode(x, table) for x in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")
