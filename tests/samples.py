"""Small planted inputs and plain-Python statements of what the operators compute."""

import numpy as np


def planted(seed=3, groups=12, rows=140, dim=12, noise=0.45, hot=60, hot_noise=0.02):
    """Rows around some centres; the last ``hot`` rows are near copies of one centre."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    loose = base[rng.integers(0, groups, rows)] + noise * rng.normal(size=(rows, dim))
    near = base[0] + hot_noise * rng.normal(size=(hot, dim))
    return np.concatenate([loose, near]), base


def frame(spark, matrix, key="id", vector="v", parts=4):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} long, {vector} array<double>").repartition(parts)


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1)[:, None]


def cosines(matrix, other=None):
    return unit(matrix) @ unit(matrix if other is None else other).T


def pairs_over(sims, threshold):
    n = len(sims)
    return {(i, j) for i in range(n) for j in range(i + 1, n) if sims[i, j] >= threshold}


def components(n, edges):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def greedy(edges):
    used, taken = set(), []
    for a, b in sorted(edges):
        if a not in used and b not in used:
            used |= {a, b}
            taken.append((a, b))
    return taken


def average_linkage(matrix, limit):
    """Merge the pair of clusters with the least average cosine distance while it is < limit."""
    distance = 1 - cosines(matrix)
    clusters = [[i] for i in range(len(matrix))]
    while len(clusters) > 1:
        best = min(
            (distance[np.ix_(clusters[i], clusters[j])].mean(), i, j)
            for i in range(len(clusters))
            for j in range(i + 1, len(clusters))
        )
        if not best[0] < limit:
            break
        _, i, j = best
        clusters[i] = clusters[i] + clusters.pop(j)
    labels = [0] * len(matrix)
    for members in clusters:
        for m in members:
            labels[m] = min(members)
    return labels


def dbscan(matrix, bound, min_samples):
    sims = cosines(matrix)
    n = len(matrix)
    near = [[j for j in range(n) if j != i and sims[i, j] >= bound] for i in range(n)]
    core = [len(near[i]) + 1 >= min_samples for i in range(n)]
    edges = [(i, j) for i in range(n) for j in near[i] if core[i] and core[j]]
    label = components(n, edges)
    out = []
    for i in range(n):
        if core[i]:
            out.append(label[i])
        else:
            out.append(min((label[j] for j in near[i] if core[j]), default=None))
    return out
