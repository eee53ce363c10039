"""Dense NumPy oracles."""

import numpy as np


def frame(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


def cloud(spark, xyz, b=0, key="pid"):
    xyz = np.asarray(xyz, float)
    names = "x double, y double" + ", z double" * (xyz.shape[1] == 3)
    return spark.createDataFrame([(b, i, *map(float, r)) for i, r in enumerate(xyz)], f"b int, {key} long, {names}")


def knn(points, queries, k):
    d = ((queries[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    order = np.lexsort((np.broadcast_to(np.arange(len(points)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def mls(points, queries, f, k):
    """Values and slopes; the factorisation with floors and jitter as specified."""
    idx, d2 = knn(points, queries, k)
    dims = points.shape[1]
    size, out = dims + 1, []
    for q, own, dist in zip(queries, idx, d2, strict=True):
        exact = dist <= 1e-12
        if exact.any():
            out.append(np.concatenate([[f[own][exact].mean()], np.zeros(dims)]))
            continue
        h = max(dist[(k - 1) // 2], 1e-12)
        w = np.exp(-dist / (2 * h))
        phi = np.concatenate([np.ones((k, 1)), q - points[own]], axis=1)
        a = (w[:, None, None] * phi[:, :, None] * phi[:, None, :]).sum(axis=0) + 1e-6 * np.eye(size)
        r = (w[:, None] * phi * f[own][:, None]).sum(axis=0)
        for jitter in (0.0, max(1e-5, 1e-4 * np.trace(a) / size)):
            m, low, stable = a + jitter * np.eye(size), np.zeros((size, size)), True
            for i in range(size):
                for j in range(i + 1):
                    s = m[i, j] - low[i, :j] @ low[j, :j]
                    if i == j:
                        floor = max(1e-12, min(1e-5, 1e-3 * abs(m[i, i])))
                        if s <= floor:
                            s, stable = floor, False
                        low[i, i] = np.sqrt(s)
                    else:
                        low[i, j] = s / low[j, j]
            if stable:
                break
        out.append(np.linalg.solve(low.T, np.linalg.solve(low, r)))
    return np.array(out)
