"""Community detection and layout of small graphs (metacells), in one task each."""

from __future__ import annotations

import numpy as np


def modularity(src, dst, w, labels, resolution: float = 1.0) -> float:
    """Edges in both directions."""
    m2 = w.sum()
    k = np.bincount(src, w, len(labels))
    inside = w[labels[src] == labels[dst]].sum()
    return float(inside / m2 - resolution * (np.bincount(labels, k) ** 2).sum() / m2**2) if m2 else 0.0


def _move(adj, k, m2, labels, resolution, only_within=None):
    """Local moving: nodes in order, revisited when a neighbour moves. only_within: communities
    that may not be left (refinement), where only nodes alone in theirs move."""
    n, totals, size = len(k), np.bincount(labels, k, len(k)), np.bincount(labels, minlength=len(k))
    queue, waiting = list(range(n)), np.ones(n, bool)
    at = 0
    while at < len(queue):
        v = queue[at]
        at += 1
        waiting[v] = False
        own = labels[v]
        if only_within is not None and size[own] > 1:
            continue
        gains: dict[int, float] = {own: 0.0}
        for u, w in adj[v]:
            if u != v and (only_within is None or only_within[u] == only_within[v]):
                gains[labels[u]] = gains.get(labels[u], 0.0) + w
        base = gains[own] - resolution * k[v] * (totals[own] - k[v]) / m2
        best, best_gain = own, base
        for c in sorted(gains):
            g = gains[c] - resolution * k[v] * (totals[c] - (k[v] if c == own else 0)) / m2
            if g > best_gain + 1e-12:
                best, best_gain = c, g
        if best != own:
            totals[own] -= k[v]
            totals[best] += k[v]
            size[own] -= 1
            size[best] += 1
            labels[v] = best
            for u, _ in adj[v]:
                if not waiting[u] and labels[u] != best:
                    waiting[u] = True
                    queue.append(u)
    return labels


def _split_connected(adj, labels):
    """Cut communities into connected parts."""
    out, number = np.full(len(labels), -1), 0
    for v in range(len(labels)):
        if out[v] >= 0:
            continue
        stack, out[v] = [v], number
        while stack:
            for u, _ in adj[stack.pop()]:
                if out[u] < 0 and labels[u] == labels[v]:
                    out[u] = number
                    stack.append(u)
        number += 1
    return out


def leiden(n: int, src, dst, w, resolution: float = 1.0) -> np.ndarray:
    """Labels 0.. of connected communities: local moving, refinement within communities,
    aggregation of the refined parts, until nothing moves."""
    src, dst, w = np.asarray(src, int), np.asarray(dst, int), np.asarray(w, float)
    node_of = np.arange(n)  # aggregate node of each original node
    labels, size = np.arange(n), n
    while True:
        m2 = w.sum()
        if not m2:
            break
        adj = [[] for _ in range(size)]
        for a, b, x in zip(src.tolist(), dst.tolist(), w.tolist(), strict=True):
            adj[a].append((b, x))
        k = np.bincount(src, w, size)
        labels = _move(adj, k, m2, labels.copy(), resolution)
        refined = _move(adj, k, m2, np.arange(size), resolution, only_within=labels)
        refined = _split_connected(adj, refined)
        parts = refined.max() + 1
        if parts == size:
            break
        above = np.zeros(parts, int)
        above[refined] = labels
        node_of = refined[node_of]
        key, where = np.unique(refined[src] * parts + refined[dst], return_inverse=True)
        w = np.bincount(where, w)
        src, dst, size = key // parts, key % parts, parts
        labels = np.unique(above, return_inverse=True)[1]
    flat = labels[node_of]
    return flat


def fuzzy_graph(idx: np.ndarray, dist: np.ndarray):
    """k-NN lists to the symmetric fuzzy graph (src, dst, weight) in both directions."""
    n, k = idx.shape
    rho = dist[:, 0]
    target, lo, hi, sigma = np.log2(max(2, k)), np.zeros(n), np.full(n, np.inf), np.ones(n)
    gap = np.maximum(0, dist - rho[:, None])
    for _ in range(64):
        s = np.exp(-gap / np.maximum(sigma, 1e-12)[:, None]).sum(1)
        high = s > target
        hi, lo = np.where(high, sigma, hi), np.where(high, lo, sigma)
        sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
    p = np.exp(-gap / np.maximum(sigma, 1e-12)[:, None]).ravel()
    src, dst = np.repeat(np.arange(n), k), idx.ravel()
    key = np.concatenate([src * n + dst, dst * n + src])
    both, where = np.unique(key, return_inverse=True)
    a = np.zeros(len(both))
    b = np.zeros(len(both))
    np.maximum.at(a, where[: len(p)], p)
    np.maximum.at(b, where[len(p) :], p)
    return both // n, both % n, a + b - a * b


def umap_layout(x: np.ndarray, src, dst, w, epochs: int = 200, seed: int = 0) -> np.ndarray:
    """Two dimensions: principal axes, then attraction along edges and repulsion from samples."""
    n, rng = len(x), np.random.default_rng(seed)
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    y = np.zeros((n, 2))
    y[:, : min(2, u.shape[1])] = (u * s)[:, :2]
    y = 10 * y / (np.abs(y).max() or 1.0) + rng.normal(0, 1e-4, (n, 2))
    a, b = 1.577, 0.895  # fitted for a least distance of 0.1
    p = w / (w.max() if len(w) else 1.0)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        on = rng.random(len(p)) < p
        i, j = src[on], dst[on]
        d = y[i] - y[j]
        r = (d * d).sum(1)
        pull = -2 * a * b * np.maximum(r, 1e-12) ** (b - 1) / (1 + a * r**b)
        step = np.clip(pull[:, None] * d, -4, 4) * rate
        np.add.at(y, i, step)
        np.add.at(y, j, -step)
        i = np.repeat(i, 5)
        d = y[i] - y[rng.integers(0, n, len(i))]
        r = (d * d).sum(1)
        push = 2 * b / ((0.001 + r) * (1 + a * r**b))
        np.add.at(y, i, np.clip(push[:, None] * d, -4, 4) * rate)
    return y
