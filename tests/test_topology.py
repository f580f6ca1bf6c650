import numpy as np
import pytest

from corvid.functions import topology as M


def sheet(n=6, bump=0.0):
    x, y = np.meshgrid(np.arange(n, dtype=float), np.arange(n, dtype=float))
    v = np.stack([x.ravel(), y.ravel(), bump * np.sin(x.ravel()) * np.sin(y.ravel())], axis=1)
    q = [(r * n + c, r * n + c + 1, (r + 1) * n + c, (r + 1) * n + c + 1) for r in range(n - 1) for c in range(n - 1)]
    return v, np.array([t for a, b, c, d in q for t in ((a, b, c), (b, d, c))])


def test_quadrics_measure_distances_to_planes():
    v, f = sheet()
    q = M.quadrics(v, f)
    p = np.array([2.0, 2.0, 0.5, 1.0])
    assert p @ q[14] @ p == pytest.approx(0.25 * (f == 14).any(axis=1).sum())
    assert np.allclose(q, np.swapaxes(q, 1, 2))


def test_decimation_keeps_a_flat_sheet_flat():
    v, f = sheet()
    g, kept = M.decimate(v, f, 12)
    assert len(kept) <= 12 and g.max() == len(kept) - 1 and (np.diff(kept) > 0).all()
    assert all(len(set(t)) == 3 for t in g.tolist())
    assert [r for r, _, _ in M.selection(kept)] == list(range(len(kept)))


def test_barycentric_equals_a_search():
    rng = np.random.default_rng(0)
    tri = rng.normal(size=(12, 3, 3))
    p = rng.normal(size=3)
    w, far = M.barycentric(p, tri)
    assert np.allclose(w.sum(axis=1), 1) and (w >= -1e-12).all()
    grid = np.array([(i, j, 60 - i - j) for i in range(61) for j in range(61 - i)]) / 60
    for t, d in zip(tri, far, strict=True):
        sampled = ((grid @ t - p) ** 2).sum(axis=1).min()
        assert d <= sampled + 1e-12 and d == pytest.approx(sampled, abs=0.05)


def test_upsampling_returns_to_the_surface():
    v, f = sheet(6, 0.3)
    g, kept = M.decimate(v, f, 20)
    back = np.zeros_like(v)
    for r, c, w in M.upsampling(v, v[kept], g):
        back[r] += w * v[kept][c]
    assert np.allclose(back[kept], v[kept]) and np.abs(back - v).max() < 1.5


def test_spirals_grow_by_rings():
    v, f = sheet(7)
    s = M.spirals(v, f, 9)
    assert s.shape == (49, 9) and (s[:, 0] == np.arange(49)).all()
    assert all(len(set(r)) == 9 for r in s.tolist())
    ring = M.rings(f, 49)[24]
    assert sorted(ring) == sorted(set(f[(f == 24).any(axis=1)].ravel()) - {24}) and set(s[24][1 : 1 + len(ring)]) == set(ring)
    assert M.spirals(v, f, 4, dilation=2).shape == (49, 4)
    assert M.spirals(v[:3], np.array([[0, 1, 2]]), 3).tolist() == [[0, 1, 2], [1, 2, 0], [2, 0, 1]]
    assert len(M.edge_list(f)) == 3 * 36 + 12


def plain_decimation(v, f, keep):
    """Collapses with a list searched at each step: the smallest (price, a, b) whose price is up to date."""
    q, faces = M.quadrics(v, f), [list(t) for t in f.tolist()]
    h = np.concatenate([v, np.ones((len(v), 1))], axis=1)

    def prices(a, b):
        both = q[a] + q[b]
        return float(h[a] @ both @ h[a]), float(h[b] @ both @ h[b])

    queue = [[min(prices(a, b)), a, b] for a, b in M.edge_list(f).tolist()]
    while len({x for t in faces for x in t}) > keep and queue:
        e = min(queue)
        queue.remove(e)
        if e[1] == e[2]:
            continue
        a, b = e[1:]
        pa_, pb = prices(a, b)
        if min(pa_, pb) > e[0]:
            queue.append([min(pa_, pb), a, b])
            continue
        stay, gone = (a, b) if pa_ < pb else (b, a)
        faces = [t for t in ([stay if x == gone else x for x in t] for t in faces) if len(set(t)) == 3]
        for x in queue:
            x[1:] = [stay if y == gone else y for y in x[1:]]
        q[a] = q[b] = q[a] + q[b]
    return faces


@pytest.mark.parametrize("keep", [3, 9, 20, 33])
def test_decimation_equals_a_plain_list(keep):
    rng = np.random.default_rng(keep)
    v, f = sheet(6)
    v = v + rng.normal(size=v.shape) * 0.2  # no two edges cost the same
    g, kept = M.decimate(v, f, keep)
    assert kept[g].tolist() == plain_decimation(v, f, keep)
    c = M.Collapses(v, f)
    while c.step():
        assert c.alive == len({x for t in c.faces.values() for x in t}) and all(i in c.at[x] for i, t in c.faces.items() for x in t)


def test_blocks_find_the_nearest_triangle_of_all():
    rng = np.random.default_rng(3)
    v, f = sheet(14, 1.5)
    blocks, looked = M.TriangleBlocks(v[f], 8), 0
    for p in rng.uniform(-2, 15, size=(60, 3)):
        best, weights, far, n = blocks.nearest(p)
        w, d = M.barycentric(p, v[f])
        assert far == d.min() and best == int(d.argmin()) and (weights == w[best]).all()
        looked += n
    assert looked < 0.4 * 60 * len(f)


def test_many_meshes_at_once(spark):
    from corvid.operators import surface

    rng = np.random.default_rng(1)
    v, f = sheet(5, 0.4)
    verts = [(m, i, *map(float, x * (m + 1))) for m in range(3) for i, x in enumerate(v)]
    faces = [(m, i, *map(int, t)) for m in range(3) for i, t in enumerate(f)]
    points = [(m, k, *map(float, rng.uniform(0, 5, 3))) for m in (0, 1, 2, 9) for k in range(6)]
    V = spark.createDataFrame(verts, "mesh long, id long, x double, y double, z double").repartition(4)
    T = spark.createDataFrame(faces, "mesh long, face long, i long, j long, k long").repartition(3)
    got = surface.nearest_on_surface(spark.createDataFrame(points, "mesh long, point long, x double, y double, z double"), V, T).collect()
    assert len(got) == 18
    at = {(m, k): np.array(p) for m, k, *p in points}
    for r in got:
        d = M.barycentric(at[r.mesh, r.point], (v * (r.mesh + 1))[f])[1]
        assert r.face == int(d.argmin()) and r.distance == pytest.approx(d.min() ** 0.5) and r.wi + r.wj + r.wk == pytest.approx(1)
    small = surface.decimated(V, T, 9).collect()
    g, kept = M.decimate(v, f, 9)
    assert sorted((r.i, r.j, r.k) for r in small if r.mesh == 0) == sorted(map(tuple, kept[g].tolist()))
