import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import blocks as B
from mosaiq.operators import components
from mosaiq.operators import density as D

SEED_STEP = 0x9E3779B97F4A7C15


def planted(groups, size, noise, dim=16):
    """Unit vectors around axes, then noise, from a fixed stream of hashed words."""
    state = 7

    def word():
        nonlocal state
        state = D.splitmix64(state)
        return (state >> 11) / 2**53 * 2 - 1

    out, truth = [], []
    for g in range(groups):
        for _ in range(size):
            v = np.array([0.05 * word() for _ in range(dim)])
            v[g] += 1
            out.append(v / np.linalg.norm(v))
            truth.append(g)
    for _ in range(noise):
        v = np.array([word() for _ in range(dim)])
        out.append(v / np.linalg.norm(v))
        truth.append(-1)
    return np.array(out), truth


def labels(spark, vectors, dim=16, **params):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "point_id long, image_vec array<double>")
    found = D.density_clusters(df, D.DensityParams(min_cluster_size=10, neighbours=8, pivots=16, capped=True, **params), dim=dim)
    return [r.label for r in found.orderBy("idx").collect()]


def brute(vectors, params):
    """The rules read once more, pair by pair: core distance, edges, tree of merges, selection."""
    n = len(vectors)
    k = min(params.k, n - 1)
    pivots = D.choose_pivots(n, min(params.pivots, n), params.seed)
    far = np.maximum(0, 1 - vectors @ vectors.T)
    tops = [sorted(range(len(pivots)), key=lambda s: (far[i, pivots[s]], s))[: params.top_pivots] for i in range(n)]
    buckets = [[i for i in range(n) if s in tops[i]] for s in range(len(pivots))]
    near = []
    for i in range(n):
        found = []
        for s in tops[i]:
            for j in buckets[s]:
                if j != i and j not in found and len(found) < params.max_candidates:
                    found.append(j)
        step = 1
        while len(found) < k and step < n:
            if (j := (i + step) % n) not in found and j != i:
                found.append(j)
            step += 1
        near.append(sorted(found, key=lambda j: (far[i, j], j))[:k])
    core = [far[i, x[-1]] for i, x in enumerate(near)]
    edges = {}
    for i in range(n):
        for j in near[i]:
            key = (min(i, j), max(i, j))
            edges[key] = min(edges.get(key, 9), max(core[i], core[j], far[i, j] + params.epsilon))
    tree, out = {i: ([i], 0.0, None) for i in range(n)}, []
    owner = {i: i for i in range(n)}
    nodes, fresh = dict(tree), n
    for (u, v), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        a, b = owner[u], owner[v]
        if a != b:
            nodes[fresh] = (nodes[a][0] + nodes[b][0], w, (a, b))
            for x in nodes[fresh][0]:
                owner[x] = fresh
            fresh += 1

    def best(node, above, root):
        members, height, kids = nodes[node]
        if len(members) < params.min_cluster_size:
            return 0.0, []
        below, chosen = 0.0, []
        for kid in kids or ():
            s, c = best(kid, height, False)
            below, chosen = below + s, chosen + c
        own = -np.inf if root else max(above - height, 0) * len(members)
        return (max(own, 0.0), [members]) if own >= below else (below, chosen)

    for root in {owner[i] for i in range(n)}:
        out += best(root, 0, True)[1]
    return {frozenset(c) for c in out}


@pytest.mark.parametrize("shape", [(3, 40, 12), (1, 40, 0), (1, 11, 0), (1, 10, 0)])
def test_planted_groups(spark, shape):
    vectors, _ = planted(*shape)
    params = D.DensityParams(min_cluster_size=10, neighbours=8, pivots=16)
    found = labels(spark, vectors)
    groups = {frozenset(i for i, x in enumerate(found) if x == label) for label in set(found) - {-1}}
    assert groups == brute(vectors, params)


def test_too_few(spark):
    with pytest.raises(D.TooFewPoints):
        labels(spark, planted(1, 5, 0)[0])
    assert labels(spark, planted(0, 0, 0)[0]) == []


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(2000, 2300)] + [(7, 7), (None, 1)]
    want = {}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, b in edges:
        if a is not None:
            want.setdefault(a, a)
            want.setdefault(b, b)
            x, y = find(a), find(b)
            want[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.vertex: r.component for r in components.connected_components(df).collect()} == {x: find(x) for x in want}
    assert components.connected_components(df.limit(0)).count() == 0


def test_projection_matches_its_rule():
    m = D.projection_matrix(64, 32)
    assert m.shape == (64, 32) and (np.abs(m).sum(1) <= 2 / np.sqrt(2) + 1e-9).all()
    even = m[:, 0::2]
    assert (even >= 0).all()  # for an even size the sign follows the place


def test_max_points_keeps_the_first(spark):
    df = spark.createDataFrame([(9 - k, [1.0, float(k)]) for k in range(8)] + [(1, None)], "point_id long, image_vec array<double>")
    assert [(r.idx, r.id) for r in D.index_points(df, dim=2, max_points=3).orderBy("idx").collect()] == [(0, 2), (1, 3), (2, 4)]
    assert [r.idx for r in D.index_points(df, dim=2).orderBy("id").collect()] == list(range(8))


def nearest_by_brute_force(vectors, k):
    far = np.maximum(0, 1 - vectors @ vectors.T)
    np.fill_diagonal(far, np.inf)
    return np.sort(far, axis=1)[:, :k]


@pytest.mark.parametrize("part_rows", [20_000, 300])
def test_blocks_are_scored_whole(spark, monkeypatch, part_rows):
    """More points in one block than max_candidates, a tenth of them copies of one: neighbours of any index are found."""
    monkeypatch.setattr(B, "PART_ROWS", part_rows)
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 16))
    vectors[::10] = vectors[7]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "point_id long, image_vec array<double>")
    params = D.DensityParams(min_cluster_size=5, neighbours=6)
    got = {}
    for r in D.approximate_knn(D.index_points(df, dim=16), params, 16).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, r.dist))
    want = nearest_by_brute_force(vectors, 6)
    assert len(got) == 1500 and all(len({j for j, _ in x} - {i}) == 6 for i, x in got.items())
    assert np.allclose([[far for _, far in got[i]] for i in range(1500)], want, atol=1e-12)
    assert all(abs(1 - vectors[i] @ vectors[j] - far) < 1e-12 for i, x in got.items() for j, far in x)


@pytest.mark.parametrize("name, rows", [("sf0.01", 2_000), ("sf0.1", 20_000)])
def test_recall_of_the_neighbours(spark, name, rows):
    """Of the 32 nearest of all points, at least nine tenths are found."""
    df = spark.read.parquet(f"/root/testdata/{name}/cluster_points.parquet")
    points = D.index_points(df)
    got = {r.src: r.found for r in D.approximate_knn(points, D.DensityParams()).groupBy("src").agg(F.collect_set("dst").alias("found")).collect()}
    unit = B.unpack(points.orderBy("idx").select("vec").toArrow().column(0)).astype(np.float32)
    asked = np.random.default_rng(1).choice(len(unit), 1000, replace=False)
    cos = unit[asked] @ unit.T
    cos[np.arange(1000), asked] = -2
    want = np.argpartition(-cos, 31, axis=1)[:, :32]
    assert len(unit) > rows and np.mean([len({*w} & {*got[i]}) / 32 for i, w in zip(asked.tolist(), want.tolist())]) > 0.9


def test_spanning_tree_by_merging():
    rng = np.random.default_rng(6)
    for n, m in ((2, 1), (40, 30), (60, 400), (300, 2000)):
        u, v = rng.integers(0, n, (2, m))
        u, v, w = u[u != v], v[u != v], rng.integers(0, 9, int((u != v).sum())).astype(float)
        sets, want = D._Sets(n), []
        for k in np.lexsort((v, u, w)).tolist():
            x, y = sets.find(int(u[k])), sets.find(int(v[k]))
            if x != y:
                sets.parent[x] = y
                want.append(k)
        got = D.spanning_tree(u, v, w)
        assert sorted(w[got]) == sorted(w[want]) and len(got) == len(want)


def test_the_cap_is_an_option(spark):
    vectors, _ = planted(1, 60, 0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "point_id long, image_vec array<double>")
    params = D.DensityParams(min_cluster_size=5, neighbours=5, pivots=1, top_pivots=1, max_candidates=10, capped=True)
    assert {r.dst for r in D.approximate_knn(D.index_points(df, dim=16), params, 16).collect()} <= set(range(11))


def test_components_of_all_neighbours(spark):
    from conftest import SF
    from mosaiq.plans import reference

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], np.float64)
    cos = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    np.fill_diagonal(cos, -2)
    near = np.argsort(-cos, axis=1, kind="stable")[:, :8]
    label = np.arange(len(rows))
    while True:
        new = label.copy()
        np.minimum.at(new, near.ravel(), np.repeat(label, 8))
        new = np.minimum(new, new[near].min(1))
        if (new == label).all():
            break
        label = new
    want = {r.vec_id: rows[label[k]].vec_id for k, r in enumerate(rows)}
    assert {r.vertex: r.component for r in reference.QUERIES["knn_components"](spark, SF).collect()} == want
