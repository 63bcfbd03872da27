from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from mosaiq.llm import clusters as C
from mosaiq.llm import duplicates as D
from mosaiq.llm import neighbours as N
from mosaiq.operators import blocks as V
from mosaiq.operators.packed import segment

DIM = 64


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    """Groups of near vectors with near tag sets, lone vectors, exact copies, dirty and repeated rows."""
    rng = np.random.default_rng(5)
    vectors, tags = [], []
    for g in range(12):
        centre, words = unit(rng.standard_normal(DIM)), [f"g{g}w{k}" for k in range(8)]
        for _ in range(int(rng.integers(3, 20))):
            vectors.append(unit(centre + rng.uniform(0.1, 0.55) * unit(rng.standard_normal(DIM))))
            tags.append(" ".join(rng.permutation(rng.choice(words, rng.integers(4, 8), replace=False))) + " solo")
    for k in range(80):
        vectors.append(unit(rng.standard_normal(DIM)))
        tags.append("solo" if k % 3 else None)
    for _ in range(9):  # copies
        vectors.append(vectors[0])
        tags.append(tags[0])
    ids = rng.permutation(len(vectors)) * 7 + 100
    rows = [(int(i), (v * (127 if k % 11 == 0 else 1)).astype(np.float32).tolist(), t) for k, (i, v, t) in enumerate(zip(ids, vectors, tags))]
    dirty = [(1, None, "a"), (2, [0.0] * DIM, "a"), (3, [float("nan")] * DIM, "a"), (4, [1.0] * 5, "a"), (None, [1.0] * DIM, "a"), (5, [None] * DIM, "a"), (6, [float("inf")] + [1.0] * 63, None)]
    df = spark.createDataFrame(rows + rows[:40] + dirty, "point_id long, image_vec array<float>, tags string").selectExpr("*", "'c' AS id", "'c' AS vec", "'c' AS block", "'c' AS term").repartition(3)
    found = {i: unit(np.array(v, np.float64)) for i, v, _ in rows}
    return df, found, {i: set(segment(t)) if t else set() for i, _, t in rows}


def cosines(found):
    ids = np.array(sorted(found))
    m = np.stack([found[i] for i in ids])
    return ids, m @ m.T


def test_packing():
    rng = np.random.default_rng(0)
    u = unit(rng.standard_normal((50, DIM)))
    for width, error in ((2, 2e-5), (3, 5e-7)):
        back = V.unpack(V.as_binary(V.pack(u, width)).slice(7), DIM)
        assert np.abs(back @ back.T - (u @ u.T)[7:, 7:]).max() < error
    assert V.unpack(pa.array([], pa.binary())).shape == (0, DIM)
    assert (V.pack(u) == V.pack(u * 127)).all()


def test_clusters(data):
    df, found, _ = data
    ids, cos = cosines(found)
    label = np.arange(len(ids))
    while True:
        new = np.array([label[cos[k] >= 0.86].min() for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    sizes = Counter(label.tolist())
    want = {(int(ids[label[k]]), int(ids[k])) for k in range(len(ids)) if sizes[label[k]] >= 8}
    members = C.similarity_clusters(df)
    assert {(r.cluster_key, r.point_id) for r in members.collect()} == want and want
    posts = df.selectExpr("point_id", "point_id * 2 AS post_id")
    for r in C.describe_clusters(members, posts).collect():
        assert r.n_points == sum(k == r.cluster_key for k, _ in want)
        own = np.array([k for k, i in enumerate(ids) if (r.cluster_key, int(i)) in want])
        links = {int(ids[k]): int((cos[k] >= 0.86).sum()) - 1 for k in own}
        assert r.typical_posts == ",".join(f"{2 * i}:{i} {links[i]}" for i in sorted(links, key=lambda i: (-links[i], i))[:5])
    assert C.similarity_clusters(df.limit(0)).count() == 0


def test_density_and_pointers_of_a_whole_block():
    rng = np.random.default_rng(2)
    u = unit(np.concatenate([unit(rng.standard_normal(8)) + 0.05 * rng.standard_normal((20, 8)) for _ in range(3)])).astype(np.float32)
    ids, one = np.arange(60) * 3, np.ones(60, np.int64)
    got = list(zip(*C.block_groups(V.Block(ids, u, one, None, np.empty((60, 0), np.int64)), 0.9)))
    cos = u @ u.T
    links = (cos >= 0.9).sum(1) - 1
    assert {i: n for i, _, n, _, _ in got} == {int(i): int(n) for i, n in zip(ids, links) if n}
    for i, _, n, target, cosine in got:
        denser = [k for k in range(60) if (links[k], -k) > (n, -i // 3) and cos[i // 3, k] >= 0.9]
        assert target == (3 * max(denser, key=lambda k: cos[i // 3, k]) if denser else -1)


@pytest.fixture(scope="module")
def dense(spark):
    """400 vectors near each other, of which one has 22 copies, and 600 lone ones."""
    rng = np.random.default_rng(12)
    centre = unit(rng.standard_normal(DIM))
    vectors = [unit(centre + 0.2 * unit(rng.standard_normal(DIM))) for _ in range(400)]
    vectors += [vectors[7]] * 22 + list(unit(rng.standard_normal((600, DIM))))
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "point_id long, image_vec array<float>").repartition(4), [i for i, _ in rows[:422]]


@pytest.mark.parametrize("changed", [{}, {"PART_ROWS": 100}, {"SUB_ROWS": 60, "ROWS_PER_PIVOT": 100}, {"MOST_PIVOTS": 8, "ROWS_PER_PIVOT": 60, "SUB_ROWS": 200, "PART_ROWS": 300}, {"ROWS_PER_PIVOT": 80, "SCANNED": 8}])
def test_density_is_whole_however_blocks_are_cut(dense, monkeypatch, changed):
    """All 422 are linked with each other: each has 421 links, whether blocks are whole, split or made smaller."""
    df, group = dense
    for name, value in changed.items():
        monkeypatch.setattr(V, name, value)
    got = {r.point_id: (r.cluster_key, r.density) for r in C.similarity_clusters(df).collect()}
    assert set(got) == set(group) and {k for k, _ in got.values()} == {min(group)}
    links = np.array([n for _, n in got.values()])
    assert links.max() <= 421 and (links.min() == 421 if "ROWS_PER_PIVOT" not in changed else links.mean() > 0.95 * 421)


def test_pointers_lead_to_denser_vectors(spark):
    found = spark.createDataFrame(
        [(1, 1, 5, None, None), (2, 1, 3, 1, 0.9), (2, 2, 1, 3, 0.95), (3, 2, 2, 2, 0.95), (4, 2, 1, 3, 0.9), (5, 5, 4, None, None), (4, 5, 1, 5, 0.88)], C.FOUND
    )
    peaks, labels = C.density_peaks(found)
    assert {r.id: (r.density, r.up, None if r.delta is None else round(r.delta, 2)) for r in peaks.collect()} == {1: (5, 1, None), 2: (4, 1, 0.1), 3: (2, 2, 0.05), 4: (2, 3, 0.1), 5: (4, 5, None)}
    assert {r.id: r.peak for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    chain = spark.range(200).selectExpr("id", "greatest(id - 1, 0) AS up")
    assert C.follow_pointers(chain).where("peak = 0").count() == 200


def test_many_pivots_by_a_tree():
    rng = np.random.default_rng(1)
    u = unit(rng.standard_normal((6000, 16))).astype(np.float32)
    V_scanned = V.SCANNED
    try:
        V.SCANNED = 400
        tree = V.Pivots(u[:3000])
        got = tree.nearest(u, 5)
    finally:
        V.SCANNED = V_scanned
    want = np.argsort(-(u @ tree.points.T), axis=1)[:, :5]
    assert len(tree) == 3000 and tree.opened < len(tree.coarse)
    assert np.mean([len({*a} & {*b}) / 5 for a, b in zip(got.tolist(), want.tolist())]) > 0.6
    assert np.mean([b in a for a, b in zip(got.tolist(), want[:, 0].tolist())]) > 0.8


def test_neighbours(data):
    df, found, _ = data
    ids, cos = cosines(found)
    np.fill_diagonal(cos, -2)
    place = {int(i): k for k, i in enumerate(ids)}
    got = {}
    for r in N.most_similar(df).orderBy("point", "place").collect():
        got.setdefault(r.point, []).append(r.other)
        assert abs(r.cosine - cos[place[r.point], place[r.other]]) < 1e-6
    for k, i in enumerate(ids.tolist()):  # copies by different scales are as good as each other
        best = np.sort(cos[k][cos[k] >= 0.9])[::-1][:5]
        mine = cos[k][[place[j] for j in got.get(i, [])]]
        assert len(mine) == len(best) == len(set(got.get(i, []))) and np.allclose(mine, best, atol=1e-7)
    pairs = N.neighbour_pairs(N.most_similar(df)).collect()
    assert {(r.point_a, r.point_b) for r in pairs} == {(min(i, j), max(i, j)) for i, x in got.items() for j in x} and len(set(pairs)) == len(pairs)
    assert N.most_similar(df.limit(0)).count() == 0


def test_scan_abandons_little():
    rng = np.random.default_rng(9)
    base = unit(rng.standard_normal((300, DIM)))
    near = unit(base + rng.uniform(0.1, 0.5, (300, 1)) * unit(rng.standard_normal((300, DIM))))
    u = (np.concatenate([base, near]) @ V.rotation()).astype(np.float32)
    a, b, _ = N.scan_list(np.arange(600), u, 5, 0.9)
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    want = {(k, int(j)) for k in range(600) for j in np.nonzero(cos[k] >= 0.9)[0]}
    assert len(want - set(zip(a.tolist(), b.tolist()))) <= 0.01 * len(want) and not set(zip(a.tolist(), b.tolist())) - want


def test_split_blocks_lose_nothing(data, monkeypatch):
    df, found, _ = data
    monkeypatch.setattr(V, "PART_ROWS", 40)
    whole = {(r.cluster_key, r.point_id) for r in C.similarity_clusters(df).collect()}
    monkeypatch.undo()
    assert whole == {(r.cluster_key, r.point_id) for r in C.similarity_clusters(df).collect()}


def test_near_duplicates(data):
    df, found, terms = data
    ids, cos = cosines(found)
    near = set()
    for x, y in zip(*np.nonzero(np.triu(cos >= 0.965, 1))):
        a, b = int(ids[x]), int(ids[y])
        shared = len(terms[a] & terms[b])
        if shared and shared >= 0.5 * len(terms[a] | terms[b]):
            near.add((a, b))
    classes = {}
    for i in sorted(found):
        classes.setdefault((found[i].astype(np.float32).tobytes(), frozenset(terms[i])), []).append(i)
    copies = [c for c in classes.values() if len(c) > 1]
    first = {i: c[0] for c in classes.values() for i in c}
    got = {(r.point_a, r.point_b) for r in D.near_duplicates(df).collect()}
    assert got <= near  # no false pair
    # no link between different classes is lost, and each class hangs together
    assert {tuple(sorted((first[a], first[b]))) for a, b in near if first[a] != first[b]} == {tuple(sorted((first[a], first[b]))) for a, b in got if first[a] != first[b]}
    groups = {r.point_id: r.group_id for r in D.duplicate_groups(D.near_duplicates(df)).collect()}
    assert copies and all(len({groups[i] for i in c}) == 1 for c in copies)
    assert D.near_duplicates(df.limit(0)).count() == 0


def test_hot_copies_stay_linear(spark):
    """A third of all rows are copies of one record: no pair of each with each."""
    v = [1.0] + [0.0] * 63
    df = spark.range(3000).selectExpr("id AS point_id").rdd.map(lambda r: (r.point_id, v if r.point_id % 3 == 0 else np.random.default_rng(r.point_id).standard_normal(64).tolist(), "a b c" if r.point_id % 3 == 0 else f"t{r.point_id}")).toDF("point_id long, image_vec array<float>, tags string")
    pairs = D.near_duplicates(df)
    assert pairs.count() < 1100
    assert {(r.group_id, r.point_id) for r in D.duplicate_groups(pairs).collect()} == {(0, i) for i in range(0, 3000, 3)}
    near = N.most_similar(df)
    assert near.count() == 5000 and {r.other for r in near.collect()} == {0, 3, 6, 9, 12, 15}
    assert C.similarity_clusters(df).count() == 1000


def test_split_lists_lose_nothing(data, monkeypatch):
    df, _, _ = data
    whole = {(r.point_a, r.point_b) for r in D.near_duplicates(df).collect()}
    monkeypatch.setattr(D, "LIST_ROWS", 8)
    monkeypatch.setattr(D, "ROWS", 7)
    groups = lambda pairs: {r.point_id: r.group_id for r in D.duplicate_groups(pairs).collect()}
    again = D.near_duplicates(df)
    assert groups(again) == groups(D.near_duplicates(df)) and {(r.point_a, r.point_b) for r in again.collect()} == whole


def test_lists_hold_every_pair_similar_enough():
    """Of all small sets over a few terms, any two that share half of their union meet in the list of their first terms."""
    sets = [sorted(c) for n in range(1, 6) for c in combinations([x << 65 if x < 0 else x for x in range(-3, 5)], n)]
    for frequent in (0, 2, 9):
        lists = [dict(D.lists_of(s, frequent, 0.5)) for s in sets]
        for x, lx in zip(sets, lists):
            for y, ly in zip(sets, lists):
                common = sorted({*x} & {*y})
                if common and len(common) >= 0.5 * len({*x} | {*y}):
                    number = common[0] if common[0] >= 0 else common[0] >> 65
                    if common[0] >= frequent and len(common) > 1:
                        number = D.PAIR + (common[0] << D.PAIR_BITS) + common[1]
                    assert number in lx and number in ly
                    assert min(len(x) - lx[number], len(y) - ly[number]) >= len(common)


def test_term_sets_as_bytes():
    for terms in ({5, 0, 16_383}, {-1, -(1 << 128), D.term_hash("x"), 3}, {D.term_hash("a")}, set(range(-9, 9)), set()):
        assert D.set_terms(D.set_bytes(terms)) == sorted(terms)
    many = {D.term_hash(str(k)) for k in range(70_000)}
    assert D.set_terms(D.set_bytes(many)) == sorted(many)


def test_terms_of_equal_short_hashes_differ(spark, monkeypatch):
    """Two terms that a 31-bit hash can't tell apart, and two whose lists share a name."""
    monkeypatch.setattr(D, "DICTIONARY", 1)
    v = [1.0] + [0.5] * 63
    df = spark.createDataFrame([(1, v, "rare20343"), (2, v, "rare114237"), (3, v, "often x"), (4, v, "often y z w"), (5, v, "rare114237 x")], "point_id long, image_vec array<float>, tags string")
    want = {(2, 5)}  # the third and the fifth share one term of three
    assert {(r.point_a, r.point_b) for r in D.near_duplicates(df).collect()} == want
    plain = D.term_hash
    monkeypatch.setattr(D, "term_hash", lambda t: (plain(t) & ((1 << 65) - 1)) - (1 << 128))  # all lists of rare terms share one name
    u = np.tile(unit(np.array(v)), (5, 1)).astype(np.float32)
    terms = [sorted(map(D.term_hash, t.split())) for t in ("rare20343", "rare114237", "often x", "often y z w", "rare114237 x")]
    rows = [r for r in range(5) for _ in D.lists_of(terms[r], 1, 0.5)]
    places = np.array([p for t in terms for _, p in D.lists_of(t, 1, 0.5)])
    (name,) = {n for t in terms for n, _ in D.lists_of(t, 1, 0.5)}
    a, b = D.join_list(name, np.array(rows) + 1, places, u[rows], [terms[r] for r in rows], None, 0.9, 0.5)
    assert set(zip(a.tolist(), b.tolist())) == want


def test_the_same_rows_on_any_number_of_partitions(spark):
    """Eight exact copies, one near copy and others: neither pairs nor links depend on where rows lie."""
    rng = np.random.default_rng(3)
    centre = unit(rng.standard_normal(DIM))
    rows = [(k + 1, centre.astype(np.float32).tolist(), "a b c") for k in range(8)] + [(9, unit(centre + 0.05 * unit(rng.standard_normal(DIM))).astype(np.float32).tolist(), "a b c d")]
    rows += [(20 + k, unit(rng.standard_normal(DIM)).astype(np.float32).tolist(), f"a t{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "point_id long, image_vec array<float>, tags string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            given = df.repartition(n)
            assert {(r.point_a, r.point_b) for r in D.near_duplicates(given).collect()} == {(1, k) for k in range(2, 10)}
            assert {(r.point_id, r.group_id, r.n_links) for r in D.linked_groups(given).collect()} == {(k, 1, 8) for k in range(1, 10)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_prefix_length():
    assert [D.prefix_length(n, 0.5) for n in (1, 2, 3, 10, 11)] == [1, 2, 2, 6, 6]


@pytest.mark.parametrize("small", [False, True])
def test_links_of_copies_are_all_counted(spark, monkeypatch, small):
    """A class of copies of a third of all records, two records near it and another class: links as by brute force."""
    if small:
        monkeypatch.setattr(D, "LIST_ROWS", 8)
    rng = np.random.default_rng(8)
    hot, other = unit(rng.standard_normal((2, DIM)))
    rows = [(hot, "a b c")] * 60 + [(unit(hot + 0.1 * unit(rng.standard_normal(DIM))), t) for t in ("a b c d", "a b")] + [(other, "x y")] * 5
    rows += [(unit(rng.standard_normal(DIM)), f"t{k}") for k in range(110)]
    rows = [(int(i), v.astype(np.float32).tolist(), t) for i, (v, t) in zip(rng.permutation(len(rows)), rows)]
    df = spark.createDataFrame(rows, "point_id long, image_vec array<float>, tags string").repartition(5)
    ids, cos = cosines({i: unit(np.array(v, np.float64)) for i, v, _ in rows})
    terms = {i: set(t.split()) for i, _, t in rows}
    links = Counter(int(ids[x]) for x, y in zip(*np.nonzero(cos >= 0.965)) if x != y and len(terms[ids[x]] & terms[ids[y]]) >= 0.5 * len(terms[ids[x]] | terms[ids[y]]))
    got = {r.point_id: (r.group_id, r.n_links) for r in D.linked_groups(df).collect()}
    assert {i: n for i, (_, n) in got.items()} == links and len(links) == 67
    groups = {}
    for i, (g, _) in got.items():
        groups.setdefault(g, set()).add(i)
    assert sorted(map(len, groups.values())) == [5, 62] and all(g == min(x) for g, x in groups.items())
    assert D.linked_groups(df.limit(0)).count() == 0
