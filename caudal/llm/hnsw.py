"""A hierarchical navigable small-world graph in flat arrays, built and searched in lockstep.

Nodes are in order of their level, highest first, so a layer is a prefix of the nodes
and an array of neighbours (``-1``: none). Nodes enter a layer in batches: a batch looks
for its neighbours in the graph so far and among itself. Closeness is the inner product;
``lifted`` vectors all have one length, which makes it the order of distances as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M = 16  # links of a node above the ground layer; twice as many on it
_BATCH = 256
_WIDE = 4  # nodes a search expands at a time


@dataclass
class Graph:
    vectors: np.ndarray  # lifted, float32, in order of level
    order: np.ndarray  # row of each node in the input
    layers: list[np.ndarray]  # neighbours, ground first


def lifted(vectors: np.ndarray) -> np.ndarray:
    """With one more component that brings every vector to the length of the longest."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    extra = np.sqrt(np.maximum(0, squares.max(initial=0) - squares))
    return np.concatenate([vectors, extra[:, None]], axis=1).astype(np.float32)


def _levels(n: int) -> np.ndarray:
    """Level of each row: geometric, from a fixed mix of its number."""
    x = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(u, 1e-18)) / np.log(M)).astype(np.int64)


def beam(x: np.ndarray, links: np.ndarray, query: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` closest nodes found for each query, closest first; ``-1`` where fewer."""
    n = len(query)
    ids = np.full((n, width), -1, np.int64)
    near = np.full((n, width), -np.inf, np.float32)
    open_ = np.zeros((n, width), bool)
    seen = np.zeros((n, len(x)), bool)
    rows = np.arange(n)
    ids[:, 0], open_[:, 0] = entry, True
    near[:, 0] = np.einsum("ij,ij->i", query, x[entry])
    seen[rows, entry] = True
    while True:
        pick = np.argsort(~open_[rows], axis=1, kind="stable")[:, :_WIDE]
        real = open_[rows[:, None], pick]
        going = real[:, 0]
        rows, pick, real = rows[going], pick[going], real[going]
        if not len(rows):
            return ids, near
        open_[rows[:, None], pick] = False
        nodes = np.where(real, ids[rows[:, None], pick], 0)
        next_ = np.where(real[:, :, None], links[nodes], -1).reshape(len(rows), -1)
        next_[seen[rows[:, None], next_] & (next_ >= 0)] = -1
        fresh = next_ >= 0
        at, col = np.nonzero(fresh)
        seen[rows[at], next_[at, col]] = True
        found = np.full(next_.shape, -np.inf, np.float32)
        found[at, col] = np.einsum("ij,ij->i", query[rows[at]], x[next_[at, col]])
        all_near = np.concatenate((near[rows], found), axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        line = np.arange(len(rows))[:, None]
        new_ids = np.concatenate((ids[rows], next_), axis=1)[line, best]
        new_near = all_near[line, best]
        new_open = np.concatenate((open_[rows], fresh), axis=1)[line, best]
        twice = np.zeros_like(new_open)
        twice[:, 1:] = (new_ids[:, 1:] == new_ids[:, :-1]) & (new_ids[:, 1:] >= 0)
        new_open &= ~twice
        new_near[twice] = -np.inf
        new_ids[twice] = -1
        ids[rows], near[rows], open_[rows] = new_ids, new_near, new_open


def choose(x: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the candidates (closest first): those closer to the node than to any
    chosen before; places left over go to the closest of the others."""
    n, k = ids.shape
    vectors = x[np.maximum(ids, 0)]
    among = np.matmul(vectors, vectors.transpose(0, 2, 1))
    real = ids >= 0
    closest = np.full((n, k), -np.inf, np.float32)
    taken = np.zeros((n, k), bool)
    count = np.zeros(n, np.int64)
    for i in range(k):
        keep = real[:, i] & (near[:, i] > closest[:, i]) & (count < most)
        taken[:, i] = keep
        count += keep
        np.maximum(closest, np.where(keep[:, None], among[:, i, :], -np.inf), out=closest)
    rank = np.where(taken, 0, np.where(real, 1, 2))
    best = np.argsort(rank, axis=1, kind="stable")[:, :most]
    line = np.arange(n)[:, None]
    out = np.where(rank[line, best] < 2, ids[line, best], -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _sorted_unique(ids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -near), axis=1)
    line = np.arange(len(ids))[:, None]
    ids, near = ids[line, best], near[line, best]
    twice = np.zeros(ids.shape, bool)
    twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
    return np.where(twice, -1, ids), np.where(twice, -np.inf, near)


def _link_back(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, most: int) -> None:
    """Add each new node to the lists of its neighbours; lists that overflow are chosen anew."""
    to, source = links[nodes].ravel(), np.repeat(nodes, most)
    to, source = to[to >= 0], source[to >= 0]
    if not len(to):
        return
    near = np.einsum("ij,ij->i", x[to], x[source])
    order = np.lexsort((-near, to))
    to, source = to[order], source[order]
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    place = np.arange(len(to)) - np.repeat(first, np.diff(np.concatenate((first, [len(to)]))))
    held = place < most
    targets = to[first]
    row = np.cumsum(np.concatenate(([False], to[1:] != to[:-1])))
    extra = np.full((len(targets), min(most, int(place.max(initial=0)) + 1)), -1, np.int64)
    extra[row[held], place[held]] = source[held]
    ids = np.concatenate((links[targets], extra), axis=1)
    near = np.einsum("ij,ikj->ik", x[targets], x[np.maximum(ids, 0)])
    near[ids < 0] = -np.inf
    ids, near = _sorted_unique(ids, near)
    links[targets] = choose(x, ids, near, most)


def build(vectors: np.ndarray, width: int = 96) -> Graph:
    """The graph of the rows of ``vectors`` (no two rows need differ)."""
    levels = _levels(len(vectors))
    order = np.argsort(-levels, kind="stable")
    x = lifted(vectors)[order]
    sizes = [int((levels >= level).sum()) for level in range(int(levels.max(initial=0)) + 1)]
    layers: list[np.ndarray] = []
    for level in range(len(sizes) - 1, -1, -1):
        n, most = sizes[level], M if level else 2 * M
        links = np.full((n, most), -1, np.int64)
        at = 0
        while at < n:
            to = min(n, at + max(16, min(_BATCH, at)))
            new = np.arange(at, to)
            own = np.einsum("ij,kj->ik", x[new], x[new])
            np.fill_diagonal(own, -np.inf)
            ids = np.broadcast_to(new, own.shape)
            if at:
                entry = _descend(x, layers, x[new], 1) if layers else np.zeros(len(new), np.int64)
                found, near = beam(x[:n], links, x[new], np.minimum(entry, at - 1), width)
                ids, own = np.concatenate((found, ids), axis=1), np.concatenate((near, own), axis=1)
            own = np.where(np.isfinite(own), own, -np.inf)
            best = np.argsort(-own, axis=1, kind="stable")[:, : 2 * most + 16]
            line = np.arange(len(new))[:, None]
            ids, own = ids[line, best], own[line, best]
            links[new] = choose(x, np.where(np.isfinite(own), ids, -1), own, most)
            _link_back(x, links, new, most)
            at = to
        layers.insert(0, links)
    return Graph(x, order, layers)


def _descend(x: np.ndarray, layers: list[np.ndarray], query: np.ndarray, stop: int) -> np.ndarray:
    """The closest node found on the lowest of the given layers, from the top."""
    entry = np.zeros(len(query), np.int64)
    for links in layers[::-1]:
        entry = beam(x[: len(links)], links, query, entry, 8)[0][:, 0]
    return entry


def search(graph: Graph, queries: np.ndarray, width: int) -> np.ndarray:
    """Rows of the input closest to each query, closest first; ``-1`` where fewer were found."""
    query = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    entry = _descend(graph.vectors, graph.layers[1:], query, 0)
    ids, _ = beam(graph.vectors, graph.layers[0], query, entry, max(1, min(width, len(graph.vectors))))
    return np.where(ids >= 0, graph.order[np.maximum(ids, 0)], -1)
