import numpy as np
import pytest

from helixframe.llm import sphericalcaps as S


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], "vec_id long, embedding array<float>, label int, n_links string")


def brute(rows):
    ids = [i for i, _ in rows]
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    links = [[] for _ in rows]
    units = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v), g in zip(rows, good)]
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9 - 1e-12:
                links[a].append(b)
                links[b].append(a)
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            label[a] = min([label[a], *(label[b] for b in links[a])])
    order = {}
    for a, k in enumerate(label):
        order.setdefault(k, []).append(ids[a])
    return [(ids[a], len(links[a]), ids[a] if not links[a] else min(order[label[a]])) for a in range(len(rows))]


def made(rng, n=260, d=64):
    rows, base = [], rng.standard_normal((n, d))
    for k in range(n):
        v = base[k] if k % 3 else base[k // 30 * 30] + 0.22 * rng.standard_normal(d)
        rows.append((k, np.float32(v).tolist()))
    return rows


def test_equal_to_brute_force_and_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(8)
    rows = made(rng)
    one = rows[5][1]
    rows += [(900, one), (901, one), (902, [x * 3 for x in one]), (903, None), (904, []), (905, [0.0] * 64), (906, [float("nan")] * 64), (907, [1.0, None]), (908, [1.0, 2.0]), (909, [2.0, 4.0]), (910, [float("inf"), 1.0]), (902, [x * 3 for x in one]), (None, one)]
    got = {}
    for r in S.near_vectors(frame(spark, rows)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    want = brute(rows)
    total = sum(n for _, n, _ in want)
    found = sum(n for v in got.values() for n, _, _ in v)
    assert 0.97 * total <= found <= total
    for i, n, component in want:
        if i is None:
            assert got[None] == [(0, None, True)]
        elif i >= 900:
            assert all(x == (n, component, i == component) for x in got[i]), i


def test_vectors_that_share_an_id_keep_their_links(spark):
    rng = np.random.default_rng(3)
    u, v = rng.standard_normal((2, 16)).round(3)
    rows = [(1, u.tolist()), (2, (2 * u).tolist()), (1, v.tolist()), (4, (3 * v).tolist()), (9, rng.standard_normal(16).tolist())]
    for parts in (1, 3, 8):
        frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = sorted(tuple(r) for r in S.near_vectors(frame_).collect())
        assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (4, 1, 1, False), (9, 0, 9, True)]


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.905 * a + np.sqrt(1 - 0.905**2) * b
    rows = [(k, v.tolist()) for k, v in enumerate(np.vstack([a, near]))]
    linked = S.near_vectors(frame(spark, rows)).where("n_links > 0").count()
    assert linked >= 0.97 * 800


def test_parameters_grow_with_the_input():
    few, many = S.parameters(1000), S.parameters(10**10)
    assert few[0] == 2 and many[0] == 4 and many[1] < 10_000


@pytest.mark.parametrize("n", [51_282, 200_000, 3_000_000, 30_000_000])
def test_filters_keep_recall_as_the_input_grows(n):
    rng = np.random.default_rng(5)
    a = rng.standard_normal((200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((200, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9 * a + np.sqrt(1 - 0.9**2) * b
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(S.decode(a, *S.parameters(n)), S.decode(near, *S.parameters(n)))]
    assert np.mean(met) >= 0.94


def test_empty(spark):
    assert S.near_vectors(frame(spark, [])).count() == 0
