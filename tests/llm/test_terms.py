from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa

from mosaiq.llm import cooccurrence as O
from mosaiq.llm import frequency as Q
from mosaiq.operators.packed import segment

ROWS = [(1, "a b c", "S", "x"), (1, "a,b", " s ", "x"), (2, "a", None, "y"), (2, None, "", "y"), (3, '"b c" a a', "q", None), (None, "a z", "e", "n"), (4, " ", "  ", "w"), (5, "w " * 3000 + "a", "s", "v")]
SCHEMA = "point_id long, tags string, rating string, term string"  # term clashes with the result's column


def test_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r.field_name, r.term): (r.occurrences, r.n_points) for r in Q.term_frequencies(Q.term_pairs(df), 3).collect()}
    want, having = Counter(), defaultdict(set)
    for p, tags, rating, _ in ROWS:
        for t in segment(tags) if tags else ():
            want["tags", t] += 1
            having["tags", t].add(p)
        if rating and rating.strip():
            want["rating", rating.strip().lower()] += 1
            having["rating", rating.strip().lower()].add(p)
    assert got == {k: (n, len(having[k])) for k, n in want.items()}
    assert Q.term_frequencies(Q.term_pairs(df.limit(0))).count() == 0


def test_marks(spark):
    df = spark.createDataFrame([("t", str(n), n) for n in (3, 4, 15, 16)], "field_name string, term string, n_points long")
    assert {r.term: r.mark for r in Q.mark_terms(df, 100).collect()} == {"3": "rare", "4": None, "15": None, "16": "common"}


def test_run_lengths_over_batch_borders():
    rows = sorted([("tags", t, i) for t, i in zip("aaabbbbcc", (1, 1, 2, 2, 2, 3, 3, 3, 4))])
    for size in (1, 2, 3, 9):
        batches = [pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*rows[k : k + size])), pa.array([1] * len(rows[k : k + size]))], names=["field_name", "term", "record", "n"]) for k in range(0, 9, size)]
        total = Counter()
        for b in Q.run_lengths(iter(batches)):
            for _, t, n, r in zip(*(c.to_pylist() for c in b.columns)):
                total[t, "n"] += n
                total[t, "r"] += r
        assert total == Counter({("a", "n"): 3, ("a", "r"): 2, ("b", "n"): 4, ("b", "r"): 2, ("c", "n"): 2, ("c", "r"): 2})


def test_block_counts_agree_with_pairs():
    rng = np.random.default_rng(0)
    for heavy in (0, 1, 5, 12):
        sets = [set(rng.choice(12, rng.integers(0, 9), replace=False).tolist()) for _ in range(150)]
        record = np.array([r for r, s in enumerate(sets) for _ in s])
        item = np.array([x for s in sets for x in sorted(s)])
        codes, counts = O.merge_counts(*([x] for x in O.count_block(record, item, heavy, 12)))
        want = Counter(a * 12 + b for s in sets for a, b in combinations(sorted(s), 2))
        assert dict(zip(codes.tolist(), counts.tolist())) == dict(want)


def test_together(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 180, " ".join(rng.choice(list("abcdefgh"), 3, p=[0.3, 0.2, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05])), "clash") for k in range(200)]
    rows += [(300 + k, "p q", "x") for k in range(6)] + [(None, "p q", "x"), (400, None, "x"), (401, "", "x")]
    df = spark.createDataFrame(rows, "point_id long, tags string, term_a string")
    terms = defaultdict(set)
    for p, t, _ in rows:
        if p is not None:
            terms[p] |= set(segment(t) if t else ())
    n, single, pair = len(terms), Counter(), Counter()
    for s in terms.values():
        single.update(s)
        pair.update(combinations(sorted(s), 2))
    got = {(r.term_a, r.term_b): (r.n_ab, r.n_a, r.n_b, round(r.lift, 6)) for r in O.items_together(df, min_lift=1.0).collect()}
    want = {(a, b): (k, single[a], single[b], round(k * n / single[a] / single[b], 6)) for (a, b), k in pair.items() if k >= 5 and 1000 * k >= n and k * n >= single[a] * single[b]}
    assert got == want and ("p", "q") in got
    assert O.items_together(df.limit(0)).count() == 0


def test_one_record_with_very_many_rows(spark):
    df = spark.range(30_000).selectExpr("1L AS point_id", "concat('t', id % 7, ' u') AS tags").unionAll(spark.range(6).selectExpr("id + 2 AS point_id", "'t0 u' AS tags"))
    got = {(r.term_a, r.term_b): r.n_ab for r in O.items_together(df, min_lift=0.0).collect()}
    assert got == {("t0", "u"): 7}
