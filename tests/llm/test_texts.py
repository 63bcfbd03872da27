import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from mosaiq.llm import containers as B
from mosaiq.llm import pieces as P
from mosaiq.llm import tokens as T
from mosaiq.llm.hilbert import hilbert_keys

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def table():
    return T.table_for(T.vocabulary_path())


@pytest.fixture(scope="module")
def library(table):
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.merges.ranks, special_tokens={})


def ids(text, table):
    return np.frombuffer(T.encode(text, table), "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("ab 's'\n\t1!漢字é　\x1c😀"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_and_round_trip(text):
    table = T.table_for(T.vocabulary_path())
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table.merges.ranks, special_tokens={})
    got = ids(text, table)
    assert "".join(T.decode(got, table)) == text
    if all(c.isascii() or c in "漢字é　😀" for c in text):  # newer characters depend on the Unicode version
        assert got == library.encode_ordinary(text)


def test_any_window(table, library, monkeypatch):
    words = ["a", "the", " ", "  ", "\n", "'", "'s", "'re", "r", "e", "1", "23", "!", "é", "漢字", "　", "\t", "😀"]
    pick = random.Random(4)
    for window in (1, 2, 3, 7, 40):
        monkeypatch.setattr(T, "WINDOW", window)
        for k in range(150):
            text = "".join(pick.choice(words) for _ in range(pick.randint(1, 120)))
            if k % 3 == 0:
                text = pick.choice(words) * pick.randint(1, 200) + text
            assert ids(text, table) == library.encode_ordinary(text)


def test_long_runs_take_constant_memory(table, library, monkeypatch):
    monkeypatch.setattr(T, "WINDOW", 256)
    most = 0
    feed = T.MergeState.feed

    def watched(self, data):
        nonlocal most
        out = feed(self, data)
        most = max(most, len(self.text))
        return out

    monkeypatch.setattr(T.MergeState, "feed", watched)
    for text in ("漢字かな" * 3000, "supercalifragilistic" * 800, "=" * 20_000, " " * 9000 + "x", "1234567890" * 900):
        assert ids(text, table) == library.encode_ordinary(text)
    assert most < 3000


def test_documents(spark, library):
    rows = [(1, "Hello  world\n", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (5, " \n ", "x"), (6, "word " * 40_000, "x"), (1, "Hello  world\n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in T.encode_documents(df).collect()]
    assert sorted(got, key=repr) == sorted([(i, library.encode_ordinary(t) if t else []) for i, t, _ in rows], key=repr)
    assert T.encode_documents(df.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        path = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check_containers(rows, sizes, capacity):
    parts, fill = defaultdict(list), defaultdict(int)
    for r in rows:
        parts[r.doc_id].append((r.part, r.n_parts, r.first_token, r.n_tokens))
        fill[r.container] += r.n_tokens
    assert max(fill.values(), default=0) <= capacity
    assert set(parts) == set(sizes)
    for doc, found in parts.items():
        found.sort()
        assert [p for p, *_ in found] == list(range(1, found[0][1] + 1))
        assert sum(n for *_, n in found) == sizes[doc] and len(found) == max(1, -(-sizes[doc] // capacity))
        assert [f for _, _, f, _ in found] == [capacity * k for k in range(len(found))]
    return fill


def test_containers(spark, table):
    pick = random.Random(1)
    texts = [None, "", " ", *[" ".join(pick.choice(["red", "blue", "fox", "1"]) for _ in range(pick.choice([3, 10, 40, 90, 200]))) for _ in range(300)], "word " * 1500, "same text" * 20, "same text" * 20]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, container string").repartition(3)
    sizes = {k: len(ids(t, table)) for k, t in enumerate(texts)}
    fill = check_containers(B.fill_containers(df, capacity=512).collect(), sizes, 512)
    assert sum(sizes.values()) / (512 * len(fill)) > 0.95
    assert B.fill_containers(df.limit(0)).count() == 0


SRT = "".join(f"{k}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\nLine one of cue {k}, spoken.\nAnd a second line.\n\n" for k in range(1, 120))


def check_pieces(text, table, limit, overlap):
    found = P.cut_text(text, table, limit, overlap)
    at = 0
    for k, (start, own, stop, n) in enumerate(found):
        assert start <= own == at < stop and n == len(ids(text[start:stop], table)) <= limit
        if k and overlap:
            shared = len(ids(text[start:own], table))
            assert shared >= min(overlap, len(ids(text[:own], table))) - 2  # white space at its end may join
            assert shared <= overlap + P.WORD_TOKENS + 2
        at = stop
    assert at == len(text)
    return found


@pytest.mark.parametrize("text", [SRT, SRT.replace("\n", "\r\n"), SRT.replace("\n", " "), "漢字かな交じり文" * 900, "a" * 9000, "\n" * 3000 + "x" + " " * 3000, "\x1c\n \x1c" * 900, "WEBVTT\n\n" + SRT, "x. " * 4000])
@pytest.mark.parametrize("limit, overlap", [(128, 16), (512, 32), (100, 0)])
def test_pieces_cover_within_the_limit(table, text, limit, overlap):
    check_pieces(text, table, limit, overlap)


def test_pieces_are_full(table):
    found = check_pieces(SRT, table, 512, 32)
    cue = max(len(ids(x, table)) for x in SRT.split("\n\n"))
    assert all(n > 512 - cue - P.WORD_TOKENS for *_, n in found[:-1])  # the next cue wouldn't fit
    words = check_pieces("x. " * 4000, table, 512, 32)
    assert all(n >= 510 for *_, n in words[:-1])


def test_cuts_are_natural(table):
    own = [SRT[o:] for _, o, _, _ in P.cut_text(SRT, table, 256, 16)][1:]
    assert all(x.split("\n")[0].isdigit() and "-->" in x.split("\n")[1] for x in own)  # each at a cue
    bare = "\n".join(line for line in SRT.split("\n") if line)
    own = [bare[o:] for _, o, _, _ in P.cut_text(bare, table, 256, 16)][1:]
    assert all(x.split("\n")[0].isdigit() and "-->" in x.split("\n")[1] for x in own)  # known by their timing lines


def test_piece_rows(spark, table):
    rows = [(1, SRT, "x"), (2, "short", "x"), (3, "", "x"), (4, None, "x"), (None, SRT, "x"), (5, "a" * 5000, "x"), (1, SRT, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = P.split_documents(df).collect()
    assert {r.doc_id for r in got} == {1, None, 5} and all(r.n_tokens <= P.LIMIT for r in got)
    one = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece)
    assert "".join(SRT[r.own_start : r.stop] for r in one[::2]) == SRT
    assert all(r.text == SRT[r.start : r.stop] for r in one)
    assert P.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.split_documents(df, limit=60, overlap=32)
