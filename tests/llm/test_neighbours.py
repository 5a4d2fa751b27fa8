import numpy as np

from quiver.llm.neighbours import Settings, fit_cells, nearest_pairs
from quiver.llm.pruned_graph import PrunedGraph

SCHEMA = "vec_id long, index_name string, dimension int, embedding array<float>, other string, similarity int"


def clustered(n, d, seed, size=5, noise=0.15):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(max(1, n // size), d))
    x = centre[rng.integers(0, len(centre), n)] + noise * rng.normal(size=(n, d))
    return (x * rng.uniform(0.1, 9, size=(n, 1))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def truth(rows, k=5, least=0.9):
    out, by = set(), {}
    for i, name, d, e in {(r[0], r[1], r[2], tuple(r[3]) if r[3] is not None else None) for r in rows}:
        if e is not None and len(e) == d and any(e) and np.isfinite(e).all():
            by.setdefault((name, d), []).append((i, np.array(e, np.float64)))
    for members in by.values():
        members.sort(key=lambda m: m[0])
        ids, x = np.array([m[0] for m in members]), np.stack([m[1] for m in members])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 12)
        np.fill_diagonal(s, -2)
        for i, row in enumerate(s):
            for j in np.argsort(-row, kind="stable")[:k]:
                if row[j] >= least:
                    out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def pairs(df):
    return {(min(r.vec_id, r.other), max(r.vec_id, r.other)) for r in df.collect()}


def test_graph_recall():
    x = clustered(1500, 32, 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = PrunedGraph(x, degree=16, beam=40)
    found, sim = g.search(x, np.arange(len(x), dtype=np.int32)[:, None], beam=16)
    s = x @ x.T
    want = np.argsort(-s, axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, want)]) > 0.9
    assert (np.diff(sim, axis=1) <= 0).all() and (g.edges >= 0).sum(1).max() <= 16
    tiny = PrunedGraph(x[:1])
    assert tiny.search(x[:1], np.array([[0]], dtype=np.int32), beam=4)[0].tolist() == [[0, -1, -1, -1]]


def test_recall_over_cells(spark):
    rows = [(i, "a", 24, e.tolist()) for i, e in enumerate(clustered(3000, 24, 2))] + [(10_000 + i, "b", 8, e.tolist()) for i, e in enumerate(clustered(60, 8, 3))]
    want = truth(rows)
    for s in (Settings(cell=300, sample=1500), Settings(cell=5000, shard=700, sample=3100)):
        got = pairs(nearest_pairs(frame(spark, rows), s))
        assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_many_cells_are_found_through_groups():
    x = clustered(6000, 16, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = fit_cells(x, 6000, Settings(cell=10))
    assert c.coarse is not None and len(c.centroids) > 256
    exact = np.argsort(-(x @ c.centroids.T), axis=1)[:, 0]
    assert (c.nearest(x, 2)[:, 0] == exact).mean() > 0.8


def test_odd_vectors_ties_copies_and_repeats(spark):
    same = [1.0, 2.0, 0.0, 0.5]
    rows = [(i, "a", 4, same) for i in range(40)]  # a crowd of copies
    rows += [(100, "a", 4, None), (101, "a", 4, [0.0] * 4), (102, "a", 4, [1.0] * 3), (103, "a", 4, [float("nan"), 1.0, 1.0, 1.0]), (104, "a", 4, [1.01, 2.0, 0.0, 0.5])]
    rows += [(1, "a", 4, same), (200, "b", 4, same), (201, "b", 4, [2 * v for v in same]), (300, "c", 4, same)]
    got = pairs(nearest_pairs(frame(spark, rows)))
    assert got == truth(rows)
    assert nearest_pairs(frame(spark, rows).limit(0)).count() == 0
    assert nearest_pairs(frame(spark, [(1, "a", 4, same)])).count() == 0
    assert nearest_pairs(frame(spark, [(None, "a", 4, same), (2, None, 4, same)])).count() == 0


def test_routing_meets_close_pairs_however_many_cells():
    d, rng = 48, np.random.default_rng(9)
    x = rng.normal(size=(120_000, d)).astype(np.float32)  # an index of more than 102,400 vectors
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[:4000] + 0.22 / d**0.5 * rng.normal(size=(4000, d)).astype(np.float32)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = Settings()
    c = fit_cells(x[::4], len(x), s)
    assert len(c.centroids) == 300 and c.coarse is not None
    assert (c.nearest(x[:4000], 1)[:, 0] == np.argmax(x[:4000] @ c.centroids.T, axis=1)).mean() > 0.9999
    met = np.zeros(4000, dtype=bool)
    for a, b in ((x[:4000], y), (y, x[:4000])):
        _, who, cell = c.visited(a, s.visits, s.margin)
        home = c.visited(b, s.visits, s.margin)[0]
        met[who[cell == home[who]]] = True
    assert met.mean() > 0.99, met.mean()


def test_crowds_of_one_direction_at_many_norms(spark):
    rng = np.random.default_rng(21)
    rows = [(1000 + i, "a", 24, e.tolist()) for i, e in enumerate(clustered(300, 24, 6))]
    v, w, edge = rng.normal(size=24), rng.normal(size=24), rng.normal(size=24)
    for first, base in ((2000, v), (100, w)):
        rows += [(first + int(i), "a", 24, (base * s).astype(np.float32).tolist()) for i, s in zip(rng.permutation(40), rng.uniform(0.1, 9, 40))]
    edge[0] = 0.0  # scaled copies lie on a border of a grid, and half of them beyond it
    rows += [(3000 + i, "a", 24, (np.r_[(-1) ** i * 1e-9, edge[1:]] * (i + 1)).astype(np.float32).tolist()) for i in range(40)]
    got, want = pairs(nearest_pairs(frame(spark, rows))), truth(rows)
    crowd = lambda found: {p for p in found if not 1000 <= p[0] < 2000}
    assert crowd(got) == crowd(want) and len(crowd(want)) > 500
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_large_cells_get_cells_of_their_own(spark):
    rows = [(i, "a", 24, e.tolist()) for i, e in enumerate(clustered(3000, 24, 2))] + [(10_000 + i, "b", 8, e.tolist()) for i, e in enumerate(clustered(400, 8, 3))]
    rows += [(20_000 + i, f"c{i % 9}", 5, e.tolist()) for i, e in enumerate(clustered(60, 5, 4))]
    want = truth(rows)
    s = Settings(cell=20, shard=64, sample=160, known=2)  # beyond two collections the driver fits no cells
    got = pairs(nearest_pairs(frame(spark, rows + rows[:50]), s))
    assert len(got & want) / len(want) >= 0.95 and len(got & want) / len(got) >= 0.95


def test_collections_that_the_sample_misses(spark):
    rows = [(i, "a", 8, e.tolist()) for i, e in enumerate(clustered(400, 8, 2))] + [(900 + i, "b", 8, [1.0 + i / 50] + [1.0] * 7) for i in range(3)]
    got = pairs(nearest_pairs(frame(spark, rows), Settings(sample=5)))
    assert {(900, 901), (900, 902), (901, 902)} <= got and len(got & truth(rows)) > 0.9 * len(truth(rows))


def test_an_id_with_several_contents_keeps_those_outside_a_crowd(spark):
    crowd, other = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.1]
    rows = [(i, "a", 4, crowd) for i in range(10)] + [(100, "a", 4, crowd), (100, "a", 4, other), (15, "a", 4, [0.0, 0.0, 1.0, 0.0])]
    assert (15, 100) in pairs(nearest_pairs(frame(spark, rows)))


def test_graphs_of_a_cell_do_not_grow_with_the_vectors():
    s = Settings(sample=8000)
    x = clustered(8000, 32, 7)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graphs = []
    for size in (2_000_000, 20_000_000, 200_000_000):  # a fifth of the sample for a fifth of the vectors
        c = fit_cells(x, size, s)
        own = fit_cells(x[: int(8 * size / len(c.centroids) / s.cell)], int(size / len(c.centroids)), s, last=True)
        assert c.deep.mean() > 0.9 or size == 2_000_000
        graphs.append(((own if c.deep.any() else c).shards * (own if c.deep.any() else c).copies).mean())
    assert max(graphs) < 4, graphs
