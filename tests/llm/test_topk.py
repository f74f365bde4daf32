"""The M-tree of exact top-k search: what it passes over, and its edge cases."""

import numpy as np
import pytest

from minuteloom.llm import topk


def brute(rows, k, every, scale=64):
    use = [(i, np.floor(scale * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in use)
    use = [(i, np.pad(v, (0, width - len(v)))) for i, v in use]
    queries = {}
    for i, v in use:
        if i % every == 0:
            queries[i] = min(queries.get(i, tuple(v)), tuple(v))
    out = []
    for i, q in queries.items():
        best = sorted((-int(np.dot(q, v)), j) for j, v in use if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.fixture
def asked(monkeypatch):
    """Rows of what the search stores, by name."""
    counts = {}

    def stored(df, name, keep=topk.stored):
        out = keep(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(topk, "stored", stored)
    return counts


def clustered(n, clusters, width, spread):
    r = np.random.default_rng(11)
    return r.normal(size=(clusters, width))[np.arange(n) % clusters] + r.normal(size=(n, width)) * spread


def test_most_nodes_are_never_asked(spark, asked):
    v = clustered(20_000, 50, 16, 0.05)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_products(df, 20, 101).collect())
    q = np.floor(64 * v)
    ids = np.arange(0, 20_000, 101)  # of all clusters
    s = q[ids] @ q.T
    s[np.arange(len(ids)), ids] = -np.inf
    want = []
    for i, row in enumerate(s):
        best = np.lexsort((np.arange(20_000), -row))[:20]
        want += [(int(ids[i]), r + 1, int(j), int(row[j])) for r, j in enumerate(best)]
    assert got == sorted(want)
    assert sum(asked["asks"]) < 0.25 * len(ids) * asked["nodes"][0]


def test_most_products_are_never_computed():
    q = np.floor(64 * clustered(20_000, 50, 16, 0.05))
    node = topk.Node.of(np.arange(20_000), q)
    assert all(np.all(np.diff(node.dist[a:b]) <= 0) and b - a <= topk.PAGE for a, b in zip(node.starts, node.ends))
    found, scores, seen = node.search(np.arange(-40, 0), q[:40], np.full(40, -np.inf), 10)
    assert seen < 0.1 * 40 * 20_000
    s = q[:40] @ q.T
    for i in range(40):
        best = np.lexsort((np.arange(20_000), -s[i]))[:10]
        assert found[i].tolist() == best.tolist() and scores[i].tolist() == s[i][best].tolist()


def test_stored_distances_save_products_within_a_page():
    r = np.random.default_rng(3)
    v = np.floor(64 * r.normal(size=(128, 6)) * r.choice([0.05, 1.0], size=(128, 1)))
    node = topk.Node.of(np.arange(128), v)
    assert len(node.ends) == 1
    q = v[[int(np.abs(v).sum(axis=1).argmax())]] * 2
    bar = np.sort(q @ v.T, axis=1)[:, -3]
    found, _, seen = node.search(np.array([-1]), q, bar, 3)
    assert seen < 128 and sorted(found[0]) == sorted(np.argsort(-(q @ v.T)[0])[:3])


@pytest.mark.parametrize("node, page", [(8192, 128), (16, 4)])
def test_odd_rows(spark, monkeypatch, node, page):
    monkeypatch.setattr(topk, "NODE", node)
    monkeypatch.setattr(topk, "COPY", 3)
    r = np.random.default_rng(9)
    rows = [(i, r.normal(size=4).round(1).tolist()) for i in range(150)]
    rows += [(300 + i, rows[0][1]) for i in range(70)] + rows[:3] + [(20, [0.5, 0.5, 0.5, 0.5]), (None, [1.0] * 4), (400, None), (401, []), (420, [1.0]), (403, [float("inf")] * 4), (404, [None] * 4), (440, [0.0] * 4), (460, [-3.0] * 4)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.top_products(df, 5, 20).collect())
    assert got == brute(rows, 5, 20)
    assert sorted(x["rank"] for x in topk.top_products(df.filter("vec_id in (0, 1, 2)"), 5, 20).collect()) == [1, 2, 3, 4]
