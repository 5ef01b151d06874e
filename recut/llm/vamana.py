"""A directed neighbour graph over one bounded shard of vectors, with robust pruning, in numpy.

Vectors are scaled by the largest norm of the shard and get one more component that makes all of them unit vectors, so
that the largest inner product with a query is the smallest distance.  Points enter in blocks: a greedy search proposes
neighbours for every point of a block at once; pruning keeps, nearest first, those that no kept one is nearer to by
the factor ALPHA; every kept edge is offered in the other direction as well.  A node whose list is full is pruned anew.
At last every node that the start cannot reach gets an edge from a reachable one near it, so a beam as wide as the
shard finds all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Out-edges of a node after pruning, and how many it may gather before it is pruned anew.
DEGREE, ROOM = 32, 48
#: Width of the beam while the graph is built.
PROPOSED = 64
#: A candidate goes if a kept neighbour is nearer to it by this factor; squared, as distances are.
ALPHA = 1.2**2
#: Points of one block, nodes expanded at once, and pairs of candidates compared at once.
BLOCK, STEP, PRUNED = 512, 4, 256
SEED = 7


@dataclass(frozen=True)
class Graph:
    """``unit`` has one more row than there are nodes: the last stands for "no neighbour"."""

    unit: np.ndarray
    edges: np.ndarray
    start: int

    @property
    def size(self) -> int:
        return len(self.unit) - 1


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """float32 unit vectors of one more component, and a last row of zeros."""
    wide = vectors.astype(np.float64)
    top = np.abs(wide).max(initial=0.0)
    wide = wide / top if top > 0 else wide
    norms = np.sqrt((wide * wide).sum(axis=1))
    scale = norms.max(initial=0.0) or 1.0
    extra = np.sqrt(np.maximum(0.0, 1.0 - (norms / scale) ** 2))
    return np.vstack([np.column_stack([wide / scale, extra]), np.zeros(wide.shape[1] + 1)]).astype(np.float32)


def distinct_left(ids: np.ndarray, none: int) -> np.ndarray:
    """Each row sorted and without repeats, filled up with ``none``, the largest id, and cut to the longest row."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = none
    ids.sort(axis=1)
    return ids[:, : max(1, int((ids < none).sum(axis=1).max(initial=0)))]


def beam_search(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the ``width`` nearest nodes found, nearest first, their products, and the nodes expanded."""
    unit, edges, none = graph.unit, graph.edges, graph.size
    n = len(queries)
    found = np.full((n, width), none, dtype=np.int32)
    near = np.full((n, width), -np.inf, dtype=np.float32)
    closed = np.ones((n, width), dtype=bool)
    seen = np.zeros((n, none + 1), dtype=bool)
    seen[:, none] = True
    if none:
        found[:, 0], near[:, 0], closed[:, 0] = graph.start, queries @ unit[graph.start], False
        seen[:, graph.start] = True
    visited = []
    step = min(STEP, width)
    while len(live := np.flatnonzero(~closed.all(axis=1))):
        waiting = np.where(closed[live], -np.inf, near[live])
        picked = np.argpartition(-waiting, step - 1, axis=1)[:, :step]
        rows = live[:, None]
        usable = np.take_along_axis(waiting, picked, axis=1) > -np.inf
        nodes = np.where(usable, found[rows, picked], none)
        closed[rows, picked] = True
        step_visited = np.full((n, step), none, dtype=np.int32)
        step_visited[live] = nodes
        visited.append(step_visited)
        new = edges[nodes].reshape(len(live), -1)
        new = distinct_left(np.where(seen[rows, new], none, new), none)
        seen[rows, new] = True
        products = np.matmul(unit[new], queries[live][:, :, None])[:, :, 0]
        products[new == none] = -np.inf
        all_found = np.concatenate([found[live], new], axis=1)
        all_near = np.concatenate([near[live], products], axis=1)
        all_closed = np.concatenate([closed[live], new == none], axis=1)
        best = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
        found[live], near[live], closed[live] = (np.take_along_axis(x, best, axis=1) for x in (all_found, all_near, all_closed))
    order = np.argsort(-near, axis=1, kind="stable")
    expanded = np.concatenate(visited, axis=1) if visited else np.full((n, 1), none, dtype=np.int32)
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(near, order, axis=1), expanded


def prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """At most DEGREE of each point's candidates, nearest first, each nearer to the point than to any kept before it."""
    none = len(unit) - 1
    kept = np.full((len(points), ROOM), none, dtype=np.int32)
    for at in range(0, len(points), PRUNED):
        p = points[at : at + PRUNED]
        c = candidates[at : at + PRUNED]
        c = distinct_left(np.where(c == p[:, None], none, c), none)
        v = unit[c]
        far = 1.0 - np.matmul(v, unit[p][:, :, None])[:, :, 0]
        far[c == none] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        c, far = np.take_along_axis(c, order, axis=1), np.take_along_axis(far, order, axis=1)
        v = np.take_along_axis(v, order[:, :, None], axis=1)
        between = 1.0 - np.matmul(v, v.transpose(0, 2, 1))
        alive = c != none
        rows = np.arange(len(p))
        for k in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            kept[at + rows[some], k] = c[rows[some], first[some]]
            alive &= ALPHA * between[rows, first] > far
            alive[rows, first] = False
    return kept


def offer(unit: np.ndarray, edges: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Add the edges sources -> targets to the lists; lists that overflow are pruned."""
    none = len(unit) - 1
    far = -np.einsum("ij,ij->i", unit[sources], unit[targets])
    order = np.lexsort((far, sources))
    sources, targets = sources[order], targets[order]
    nodes, first, counts = np.unique(sources, return_index=True, return_counts=True)
    place = np.arange(len(sources)) - np.repeat(first, counts)
    row = np.repeat(np.arange(len(nodes)), counts)
    use = place < 2 * ROOM  # a list never keeps more: the nearest offers of one block are looked at
    offers = np.full((len(nodes), int(min(counts.max(initial=0), 2 * ROOM))), none, dtype=np.int32)
    offers[row[use], place[use]] = targets[use]
    both = distinct_left(np.concatenate([edges[nodes], offers], axis=1), none)
    full = (both < none).sum(axis=1) > ROOM
    fits = both[~full][:, :ROOM]
    edges[nodes[~full], : fits.shape[1]] = fits
    if full.any():
        edges[nodes[full]] = prune(unit, nodes[full], both[full])


def connect(graph: Graph) -> None:
    """Give every node that the start does not reach an edge from a reachable node near it."""
    unit, edges, none = graph.unit, graph.edges, graph.size
    reached = np.zeros(none + 1, dtype=bool)
    reached[none] = True

    def spread(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            front = np.unique(edges[front])
            front = front[~reached[front]]

    spread(np.array([graph.start]))
    while not reached.all():
        lost = int(np.flatnonzero(~reached)[0])
        spare = np.flatnonzero(reached[:none] & (edges[:none] == none).any(axis=1))
        # Every list has ROOM - DEGREE free places after its last pruning, and each reached node brings as many.
        host = int(spare[np.argmax(unit[spare] @ unit[lost])])
        edges[host, int(np.flatnonzero(edges[host] == none)[0])] = lost
        spread(np.array([lost]))


def build(vectors: np.ndarray) -> Graph:
    """The graph of distinct vectors, the rows of a matrix."""
    unit = unit_vectors(vectors)
    none = len(vectors)
    edges = np.full((none + 1, ROOM), none, dtype=np.int32)
    if not none:
        return Graph(unit, edges, 0)
    start = int(np.argmax(unit[:none] @ unit[:none].mean(axis=0)))
    graph = Graph(unit, edges, start)
    turn = np.random.default_rng(SEED).permutation(none)
    turn = np.concatenate(([start], turn[turn != start])).astype(np.int32)
    first = turn[: min(none, BLOCK // 2)]
    for again in range(2):
        done = 0
        while done < none:
            if not again and not done:
                points, proposed = first, np.broadcast_to(first, (len(first), len(first)))
            else:
                points = turn[done : done + min(BLOCK, max(len(first), done if not again else BLOCK))]
                found, _, expanded = beam_search(graph, unit[points], PROPOSED)
                proposed = np.concatenate([found, expanded, edges[points]], axis=1)
            edges[points] = prune(unit, points, proposed)
            targets = edges[points]
            some = targets < none
            offer(unit, edges, targets[some], np.repeat(points, some.sum(axis=1)))
            done += len(points)
    # Lists are cut to DEGREE once more, so that each has free places for connect().
    long = np.flatnonzero((edges[:none] < none).sum(axis=1) > DEGREE).astype(np.int32)
    if len(long):
        edges[long] = prune(unit, long, edges[long])
    connect(graph)
    return graph
