"""Template meshes on the driver: quadrics, decimation, upsampling weights and spiral neighbourhoods.

A template has a few hundred vertices and is shared by all meshes, so these run once in numpy; their results are
small tables (row, col, val) or index lists that joins and array functions apply to any number of meshes.
"""

from __future__ import annotations

import heapq

import numpy as np


def quadrics(vertices: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """For each vertex the sum over its faces, in their order, of the outer product of the face's unit plane with itself.

    The plane is the direction in which the corners' homogeneous places don't extend.
    """
    out = np.zeros((len(vertices), 4, 4))
    if len(faces):
        corners = np.concatenate([vertices[faces], np.ones((len(faces), 3, 1))], axis=2)
        plane = np.linalg.svd(corners)[2][:, -1, :]
        size = np.linalg.norm(plane[:, :3], axis=1, keepdims=True)
        plane = np.divide(plane, size, out=np.zeros_like(plane), where=size > 0)
        outer = plane[:, :, None] * plane[:, None, :]
        np.add.at(out, faces.ravel(), np.repeat(outer, 3, axis=0))
    return out


def edge_list(faces: np.ndarray) -> np.ndarray:
    """Undirected edges, smaller vertex first, sorted."""
    sides = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    return np.unique(np.sort(sides, axis=1), axis=0)


class Collapses:
    """Edges by price in a heap whose entries may be out of date, and the faces at each vertex.

    A vertex that goes hands its faces and its edges' entries to the one that stays; entries keep their old price until
    they are taken out, and go back in if the edge has become dearer.
    """

    def __init__(self, vertices: np.ndarray, faces: np.ndarray):
        self.places = np.concatenate([vertices, np.ones((len(vertices), 1))], axis=1)
        self.q = quadrics(vertices, faces)
        self.faces = {i: list(f) for i, f in enumerate(faces.tolist())}
        self.at: list[set[int]] = [set() for _ in vertices]
        for i, f in self.faces.items():
            for v in f:
                self.at[v].add(i)
        self.alive = sum(map(bool, self.at))
        self.heap: list[list] = []
        self.of: list[list[list]] = [[] for _ in vertices]
        # Entries go in by their larger vertex, then by the smaller one.
        for a, b in sorted(edge_list(faces).tolist(), key=lambda e: (e[1], e[0])) if len(faces) else []:
            entry = [min(self.prices(a, b)), a, b]
            heapq.heappush(self.heap, entry)
            self.of[a].append(entry)
            self.of[b].append(entry)

    def prices(self, a: int, b: int) -> tuple[float, float]:
        """What it costs to keep a, and to keep b."""
        both = self.q[a] + self.q[b]
        return float(self.places[a] @ both @ self.places[a]), float(self.places[b] @ both @ self.places[b])

    def step(self) -> bool:
        """Collapse the cheapest edge whose price is still right; False if there is none."""
        while self.heap:
            entry = heapq.heappop(self.heap)
            price, a, b = entry
            if a == b:
                continue
            keep_a, keep_b = self.prices(a, b)
            if min(keep_a, keep_b) > price:
                entry[0] = min(keep_a, keep_b)
                heapq.heappush(self.heap, entry)
                continue
            stay, gone = (a, b) if keep_a < keep_b else (b, a)
            self.q[a] = self.q[b] = self.q[a] + self.q[b]
            self._merge(stay, gone)
            return True
        return False

    def _merge(self, stay: int, gone: int) -> None:
        for entry in self.of[gone]:
            entry[1:] = [stay if v == gone else v for v in entry[1:]]
        self.of[stay] += self.of[gone]
        self.of[gone] = []
        touched = {stay, gone}
        before = sum(bool(self.at[v]) for v in touched)
        for i in sorted(self.at[gone]):
            face = [stay if v == gone else v for v in self.faces[i]]
            if len(set(face)) < 3:
                for v in set(self.faces.pop(i)) | {stay}:
                    if i in self.at[v]:
                        if v not in touched:
                            touched.add(v)
                            before += 1
                        self.at[v].discard(i)
            else:
                self.faces[i] = face
                self.at[stay].add(i)
        self.at[gone] = set()
        self.alive += sum(bool(self.at[v]) for v in touched) - before


def decimate(vertices: np.ndarray, faces: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(faces over the kept vertices, kept vertices of the original): cheapest edges collapse onto one of their ends.

    The cost of keeping an end is the summed quadric of both at that end; of equal costs the second end stays. Ends when
    at most `keep` vertices have faces, or no edge is left.
    """
    c = Collapses(vertices, faces)
    while c.alive > keep and c.step():
        pass
    left = np.array([c.faces[i] for i in sorted(c.faces)], dtype=np.int64).reshape(-1, 3)
    kept = np.unique(left)
    return np.searchsorted(kept, left), kept


def selection(kept: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, col, val) that picks the kept vertices."""
    return [(i, int(v), 1.0) for i, v in enumerate(kept)]


def barycentric(point: np.ndarray, triangles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of each triangle's point nearest to a point, and the squared distances: the best of face, edges and corners."""
    a, b, c = triangles[:, 0], triangles[:, 1], triangles[:, 2]
    ab, ac, ap = b - a, c - a, point - a
    d00, d01, d11, d20, d21 = ((x * y).sum(axis=1) for x, y in ((ab, ab), (ab, ac), (ac, ac), (ap, ab), (ap, ac)))
    det = d00 * d11 - d01 * d01
    safe = np.where(det > 0, det, 1.0)
    v, w = (d11 * d20 - d01 * d21) / safe, (d00 * d21 - d01 * d20) / safe
    options = [(np.stack([1 - v - w, v, w], axis=1), (det > 0) & (v >= 0) & (w >= 0) & (v + w <= 1))]
    for i, j in ((0, 1), (1, 2), (2, 0)):
        start, side = triangles[:, i], triangles[:, j] - triangles[:, i]
        length = (side * side).sum(axis=1)
        t = np.clip(((point - start) * side).sum(axis=1) / np.where(length > 0, length, 1.0), 0, 1)
        weights = np.zeros((len(triangles), 3))
        weights[:, i], weights[:, j] = 1 - t, t
        options.append((weights, np.ones(len(triangles), dtype=bool)))
    far = np.stack([np.where(ok, ((np.einsum("nk,nkd->nd", w_, triangles) - point) ** 2).sum(axis=1), np.inf) for w_, ok in options])
    best = far.argmin(axis=0)
    rows = np.arange(len(triangles))
    return np.stack([w_ for w_, _ in options])[best, rows], far[best, rows]


class TriangleBlocks:
    """Triangles in blocks of near ones with their bounding boxes: a point looks into the nearest boxes only."""

    def __init__(self, triangles: np.ndarray, size: int = 16):
        self.triangles, self.size = triangles, size
        centers = triangles.mean(axis=1)
        span = np.maximum(np.ptp(centers, axis=0), 1e-300) if len(centers) else np.ones(3)
        cell = np.minimum(((centers - centers.min(axis=0)) / span * 1023).astype(np.int64), 1023) if len(centers) else np.empty((0, 3), np.int64)
        code = np.zeros(len(cell), dtype=np.int64)
        for bit in range(10):
            for axis in range(3):
                code |= (cell[:, axis] >> bit & 1) << (3 * bit + axis)
        self.order = np.argsort(code, kind="stable")
        begins = np.arange(0, len(triangles), size)
        corners = triangles[self.order]
        self.low = np.array([corners[b : b + size].min(axis=(0, 1)) for b in begins]).reshape(-1, 3)
        self.high = np.array([corners[b : b + size].max(axis=(0, 1)) for b in begins]).reshape(-1, 3)

    def nearest(self, point: np.ndarray) -> tuple[int, np.ndarray, float, int]:
        """(triangle, weights of its corners, squared distance, triangles looked at); the first triangle of equally near ones."""
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        least = (gap * gap).sum(axis=1)
        best, weights, far, seen = -1, None, np.inf, 0
        for b in np.argsort(least, kind="stable").tolist():
            if least[b] > far * (1 + 1e-12):
                break
            own = np.sort(self.order[b * self.size : (b + 1) * self.size])
            w, d = barycentric(point, self.triangles[own])
            seen += len(own)
            k = int(d.argmin())
            if d[k] < far or d[k] == far and own[k] < best:
                best, weights, far = int(own[k]), w[k], float(d[k])
        return best, weights, far, seen


def upsampling(points: np.ndarray, vertices: np.ndarray, faces: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, col, val) that places each point at the weights of its nearest point on a coarser mesh."""
    blocks, out = TriangleBlocks(vertices[faces]), []
    for row, p in enumerate(points):
        f, weights, _, _ = blocks.nearest(p)
        out += [(row, int(v), float(w)) for v, w in zip(faces[f], weights, strict=True) if w]
    return out


def rings(faces: np.ndarray, n: int) -> list[list[int]]:
    """The neighbours of each vertex in the order in which its faces follow each other, from the smallest on."""
    after: list[dict[int, int]] = [{} for _ in range(n)]
    for f in faces.tolist():
        for k in range(3):
            after[f[k]][f[(k + 1) % 3]] = f[(k + 2) % 3]
    out = []
    for nxt in after:
        around: list[int] = []
        left = sorted({*nxt, *nxt.values()})
        heads = [v for v in left if v not in nxt.values()] or left[:1]
        for v in [*heads, *left]:
            while v is not None and v not in around:
                around.append(v)
                v = nxt.get(v)
        out.append(around)
    return out


def spirals(vertices: np.ndarray, faces: np.ndarray, length: int, dilation: int = 1) -> np.ndarray:
    """For each vertex `length` vertices ring by ring, every dilation-th; where the mesh ends before, its nearest vertices."""
    around, need = rings(faces, len(vertices)), length * dilation
    out = []
    for start in range(len(vertices)):
        seen, ring = [start], around[start]
        while ring and len(seen) < need:
            seen += ring
            known = set(seen)
            ring = list(dict.fromkeys(w for v in ring for w in around[v] if w not in known))
        if len(seen) < need:
            seen = np.argsort(((vertices - vertices[start]) ** 2).sum(axis=1), kind="stable").tolist()
        out.append(seen[:need][::dilation])
    return np.array(out)
