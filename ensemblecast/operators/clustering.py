"""Partitioning around medoids on a distance matrix, and the number of clusters by silhouette."""

from __future__ import annotations

import numpy as np


def distances(rows: np.ndarray) -> np.ndarray:
    """Euclidean, all with all."""
    rows = np.asarray(rows, float)
    return np.stack([np.sqrt(((rows - r) ** 2).sum(axis=1)) for r in rows])


def distance_sums(a: np.ndarray, b: np.ndarray, member: np.ndarray, same: np.ndarray, rows: int = 256) -> np.ndarray:
    """Sum of the distances of each row of ``a`` to the rows of ``b``, by column of ``member`` (b's clusters).

    ``same`` holds the row of ``b`` that is the same point, or -1; it adds nothing. Products give the distances;
    close pairs, where these cancel, are taken again by differences.
    """
    size_b, out = (b * b).sum(axis=1), np.empty((len(a), member.shape[1]))
    for lo in range(0, len(a), rows):
        x = a[lo : lo + rows]
        scale = (x * x).sum(axis=1)[:, None] + size_b
        square = scale - 2 * (x @ b.T)
        i, j = np.nonzero(square <= 1e-6 * scale)
        square[i, j] = 0
        for at in range(0, len(i), 1 << 16):
            u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            square[u, v] = ((x[u] - b[v]) ** 2).sum(axis=1)
        own = same[lo : lo + rows]
        square[np.flatnonzero(own >= 0), own[own >= 0]] = 0
        out[lo : lo + rows] = np.sqrt(square) @ member
    return out


def _two_nearest(d: np.ndarray, medoids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = d[:, medoids]
    first = own.argmin(axis=1)
    rows = np.arange(len(d))
    near = own[rows, first]
    if len(medoids) == 1:
        return first, near, np.full(len(d), np.inf)
    own = own.copy()
    own[rows, first] = np.inf
    return first, near, own.min(axis=1)


def _swap_gains(d: np.ndarray, medoids: np.ndarray) -> np.ndarray:
    """Change of the total distance for each (candidate, medoid) swap."""
    first, near, second = _two_nearest(d, medoids)
    closer = np.minimum(d - near[:, None], 0)
    leaving = np.minimum(d, second[:, None]) - near[:, None] - closer
    member = (first[:, None] == np.arange(len(medoids))).astype(float)
    change = closer.sum(axis=0)[:, None] + leaving.T @ member
    change[medoids] = np.inf
    return change


def build(d: np.ndarray, k: int) -> np.ndarray:
    """Medoids added one at a time, the one that shortens the total most."""
    medoids = [int(d.sum(axis=0).argmin())]
    near = d[:, medoids[0]].copy()
    while len(medoids) < k:
        gain = np.maximum(near[:, None] - d, 0).sum(axis=0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
        near = np.minimum(near, d[:, medoids[-1]])
    return np.array(medoids)


def pam(d: np.ndarray, k: int, variant: str = "pam", seed: int = 0) -> np.ndarray:
    """Labels 0..k-1. ``pam`` builds, then takes the best swap each time; ``fasterpam`` starts at random and swaps eagerly."""
    n = len(d)
    if not 1 <= k <= n:
        raise ValueError(f"{k} clusters of {n} points")
    if variant == "pam":
        medoids = build(d, k)
        while True:
            change = _swap_gains(d, medoids)
            at, out = np.unravel_index(change.argmin(), change.shape)
            if not change[at, out] < -1e-12 * max(1.0, d.max()):
                break
            medoids[out] = at
    elif variant == "fasterpam":
        medoids = np.random.default_rng(seed).choice(n, k, replace=False)
        idle, at = 0, 0
        while idle < n and k < n:
            change = _swap_gains(d, medoids)
            gains = change.min(axis=1)
            better = np.flatnonzero(gains < -1e-12 * max(1.0, d.max()))
            if not len(better):
                break
            at = int(better[np.searchsorted(better, at) % len(better)])  # the next candidate that helps
            medoids[change[at].argmin()] = at
    else:
        raise ValueError(f"unknown variant {variant!r}; pam or fasterpam")
    return d[:, medoids].argmin(axis=1)


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Average width; a point alone in its cluster counts zero."""
    k = int(labels.max()) + 1
    member = (labels[:, None] == np.arange(k)).astype(float)
    size = member.sum(axis=0)
    total = d @ member
    rows = np.arange(len(d))
    own = size[labels]
    with np.errstate(all="ignore"):
        inside = total[rows, labels] / (own - 1)
        between = np.where(size > 0, total / size, np.inf)
        between[rows, labels] = np.inf
        outside = between.min(axis=1)
        width = (outside - inside) / np.maximum(inside, outside)
    return float(np.where((own > 1) & np.isfinite(width), width, 0.0).mean())


def best_k(d: np.ndarray, least: int = 2, most: int = 100, variant: str = "pam", seed: int = 0) -> tuple[int, np.ndarray]:
    """The number of clusters with the widest silhouette; the smallest in a tie."""
    most = min(most, len(d) - 1)
    if most < least:
        raise ValueError(f"{len(d)} points allow no {least} clusters")
    found = [(k, pam(d, k, variant, seed)) for k in range(least, most + 1)]
    return max(found, key=lambda x: (silhouette(d, x[1]), -x[0]))
