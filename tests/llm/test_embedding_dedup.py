import numpy as np
import pytest

from quarry.llm import embedding_dedup as E
from quarry.llm.cover_tree import CoverTree, threshold_pairs


def made(seed, dim=8):
    r = np.random.default_rng(seed)
    x = r.normal(size=(300, dim))
    near = np.repeat(x[:6], 25, 0) + r.normal(size=(150, dim)) * 0.06 * np.linalg.norm(x[:6], axis=1).repeat(25)[:, None] / np.sqrt(dim)
    x = np.concatenate([x, near, np.repeat(x[10:11], 40, 0)]).astype(np.float32)
    label = r.integers(0, 3, len(x))
    label[300:] = 0
    return x, label


def brute(x, label, cosine):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = (u @ u.T >= cosine) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min(comp[k], comp[link[k]].min() if link[k].any() else k) for k in range(len(x))])
        if (new == comp).all():
            return link.sum(1), comp
        comp = new


@pytest.mark.parametrize("block", [2048, 9])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "GUESTS", 4 * block)
    x, label = made(1)
    n, comp = brute(x, label, 0.98)
    df = spark.createDataFrame([(k, v.tolist(), int(g)) for k, (v, g) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_duplicates(df).collect()}
    assert got == {k: (int(n[k]), int(comp[k]), bool(comp[k] == k)) for k in range(len(x))}


def test_edge_cases(spark):
    v, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(5, v, 1), (5, v, 1), (9, [2.0, 4.0], 1), (6, v, None), (7, None, 1), (8, [0.0, 0.0], 1), (10, [nan, 1.0], 1), (11, [inf, 1.0], 1), (12, [None, 1.0], 1), (13, [], 1), (14, [1.0, 2.0, 0.0], 1), (None, v, 1), (15, v, 2)]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "vec_id long, embedding array<float>, label int, n long, cell string")
    out = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_duplicates(df).collect()]
    assert sorted((str(r) for r in out)) == sorted(str(r) for r in [(5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False), (None, 0, None, True), *((k, 0, k, True) for k in (6, 7, 8, 10, 11, 12, 13, 14, 15))])
    assert E.embedding_duplicates(df.limit(0)).count() == 0


def test_cover_tree_invariants():
    x, _ = made(3)
    x = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    t = CoverTree(x)
    for level, below in zip(t.levels, t.levels[1:]):
        assert level.first[-1] == len(below.center) and level.start[-1] == len(x)
        for i in range(len(level.center)):
            members = t.order[level.start[i] : level.start[i + 1]]
            assert np.linalg.norm(x[members] - x[level.center[i]], axis=1).max() <= level.radius[i] + 1e-12
    pairs = set()
    for kind, p, q in threshold_pairs(t, t, 0.98):
        if kind == "point":
            pairs |= {tuple(sorted(z)) for z in zip(p.tolist(), q.tolist())}
        else:
            pairs |= {tuple(sorted((a, b))) for a in p.tolist() for b in q.tolist() if a != b}
    want = np.argwhere(np.triu(x @ x.T >= 0.98, 1))
    assert pairs == {tuple(z) for z in want.tolist()}
