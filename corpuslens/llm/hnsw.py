"""Hierarchical navigable small-world graphs as flat neighbour arrays, built and searched in batches.

Level 0 holds all vectors, each level above about one in ``DEGREE`` of the one below; the top one
has at most ``TOP`` and is scanned whole. A level's graph is an ``int32`` array of ``width``
neighbours per node, -1 where there are fewer. Inner products become nearness on a sphere by one
more coordinate that gives all vectors the same length; queries have 0 there.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

DEGREE = 16  # neighbours of a node above level 0; twice as many on it
TOP = 256
EF_BUILD, EF_SEARCH = 96, 160
ENTRIES, STEP = 8, 4  # entry points handed down; nodes expanded at once
CELLS = 1 << 25  # of the table of visited nodes


class Level(NamedTuple):
    nodes: np.ndarray  # its vectors, as numbers on level 0
    links: np.ndarray  # (nodes, width), numbers within the level


def on_sphere(vectors: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", vectors, vectors)
    rest = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype("f4")


def diverse(points: np.ndarray, near: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Up to ``keep`` of each row's candidates: in order of nearness those that are nearer to the
    row than to any candidate taken before, then the nearest of the others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
    near = np.where(np.isfinite(sims), near, -1)
    own = points[near]
    between = own @ own.transpose(0, 2, 1)
    rows, width = near.shape
    taken, count = np.zeros((rows, width), bool), np.zeros(rows, int)
    for j in range(width):
        closest = np.where(taken[:, :j], between[:, j, :j], -np.inf).max(axis=1, initial=-np.inf)
        taken[:, j] = (near[:, j] >= 0) & (sims[:, j] > closest) & (count < keep)
        count += taken[:, j]
    rank = np.where(near < 0, 2 * width, np.where(taken, 0, width)) + np.arange(width)
    best = np.argsort(rank, axis=1)[:, :keep]
    out = np.take_along_axis(near, best, 1)
    return np.pad(out, ((0, 0), (0, max(0, keep - width))), constant_values=-1).astype("i4")


def beam(
    points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest nodes found from the entry points of each query, nearest first."""
    chunk = min(512, max(1, CELLS // max(1, len(points))))
    parts = [
        _beam(points, links, queries[at : at + chunk], entry[at : at + chunk], ef)
        for at in range(0, len(queries), chunk)
    ]
    if not parts:
        return np.empty((0, ef), "i4"), np.empty((0, ef), "f4")
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _beam(points, links, queries, entry, ef):
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(points) + 1), bool)  # the last column takes the missing ones
    seen[:, -1] = True

    def fresh(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.sort(nodes, axis=1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
        nodes = np.where(seen[rows, nodes], -1, nodes)
        seen[rows, nodes] = True
        sims = np.einsum("nd,nkd->nk", queries, points[nodes], optimize=True)
        return nodes, np.where(nodes < 0, -np.inf, sims)

    ids, sims = fresh(entry)
    done = ids < 0
    while True:
        order = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        ids, sims, done = (np.take_along_axis(x, order, 1) for x in (ids, sims, done))
        next_ = np.argsort(done, axis=1, kind="stable")[:, :STEP]
        todo = ~np.take_along_axis(done, next_, 1)
        if not todo.any():
            break
        np.put_along_axis(done, next_, True, 1)
        from_ = np.take_along_axis(ids, next_, 1)
        reached = np.where(todo[:, :, None], links[from_], -1).reshape(n, -1)
        new, new_sims = fresh(reached)
        ids = np.concatenate([ids, new], axis=1)
        sims = np.concatenate([sims, new_sims], axis=1)
        done = np.concatenate([done, new < 0], axis=1)
    pad = max(0, ef - ids.shape[1])
    return (
        np.pad(np.where(np.isfinite(sims), ids, -1), ((0, 0), (0, pad)), constant_values=-1),
        np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf),
    )


def descend(points: np.ndarray, levels: list[Level], queries: np.ndarray) -> np.ndarray:
    """Entry points on the level below the given ones, as numbers on level 0."""
    top = levels[-1].nodes
    sims = queries @ points[top].T
    entry = np.argsort(-sims, axis=1, kind="stable")[:, :ENTRIES]
    entry = top[entry]
    for level in reversed(levels[:-1]):
        local = np.searchsorted(level.nodes, entry)
        found, _ = beam(points[level.nodes], level.links, queries, local, ENTRIES)
        entry = np.where(found < 0, entry[:, :1], level.nodes[found])
    return entry


def build(vectors: np.ndarray) -> list[Level]:
    """Levels from 0 up; a vector's level comes from a hash of its number."""
    points, n = on_sphere(vectors), len(vectors)
    draw = np.random.default_rng(n).permutation(n)
    sizes = [n]
    while sizes[-1] > TOP:
        sizes.append(-(-sizes[-1] // DEGREE))
    levels: list[Level] = []
    for depth in range(len(sizes) - 1, -1, -1):
        nodes = np.sort(draw[: sizes[depth]])
        width = DEGREE * (2 if depth == 0 else 1)
        if not levels:
            own = points[nodes]
            sims = own @ own.T
            np.fill_diagonal(sims, -np.inf)
            near = np.broadcast_to(np.arange(len(nodes)), sims.shape)
            links = diverse(own, near, sims, width)
        else:
            links = _grow(points, nodes, levels, width)
        levels.insert(0, Level(nodes.astype("i4"), links))
    return levels


def _grow(points: np.ndarray, nodes: np.ndarray, above: list[Level], width: int) -> np.ndarray:
    """Links of a level: nodes of the level above first, the others in batches."""
    own, links = points[nodes], np.full((len(nodes), width), -1, "i4")
    first = np.searchsorted(nodes, above[0].nodes)
    rest = np.setdiff1d(np.arange(len(nodes)), first)
    todo, placed = [first], 0
    while placed < len(rest):
        size = min(1024, max(64, (len(first) + placed) // 2))
        todo.append(rest[placed : placed + size])
        placed += size
    for batch in todo:
        mutual = own[batch] @ own[batch].T
        np.fill_diagonal(mutual, -np.inf)
        close = np.argsort(-mutual, axis=1)[:, : min(width, len(batch))]
        near, sims = batch[close], np.take_along_axis(mutual, close, 1)
        if batch is not first:
            entry = np.searchsorted(nodes, descend(points, above, own[batch]))
            found, found_sims = beam(own, links, own[batch], entry, EF_BUILD)
            near, sims = np.concatenate([near, found], 1), np.concatenate([sims, found_sims], 1)
        for at in range(0, len(batch), 256):
            part = batch[at : at + 256]
            links[part, :DEGREE] = diverse(own, near[at : at + 256], sims[at : at + 256], DEGREE)
        _link_back(own, links, batch, width)
    return links


def _link_back(own: np.ndarray, links: np.ndarray, batch: np.ndarray, width: int) -> None:
    """Add the batch to its neighbours' links; where these are full, keep the diverse ones."""
    source = np.repeat(batch, width)
    target = links[batch].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    sims = np.einsum("nd,nd->n", own[source], own[target])
    order = np.lexsort((-sims, target))
    source, target = source[order], target[order]
    start = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.empty(0, int)
    place = np.arange(len(target)) - np.repeat(start, np.diff(np.r_[start, len(target)]))
    fits = place < 2 * width  # the nearest of a hub's new neighbours; it keeps fewer anyway
    heads = target[start]
    row = np.searchsorted(heads, target)
    more = np.full((len(heads), 2 * width), -1, "i4")
    more[row[fits], place[fits]] = source[fits]
    for at in range(0, len(heads), 256):
        head = heads[at : at + 256]
        both = np.concatenate([links[head], more[at : at + 256]], axis=1)
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sims = np.einsum("nd,nkd->nk", own[head], own[both])
        links[head] = diverse(own, both, np.where(both < 0, -np.inf, sims), width)


def search(vectors: np.ndarray, levels: list[Level], queries: np.ndarray, ef: int) -> np.ndarray:
    """Numbers of the ``ef`` vectors of largest inner product found for each query, -1 if fewer."""
    flat = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype("f4")
    points = on_sphere(vectors)
    if len(levels) == 1:
        sims = flat @ points.T
        return np.argsort(-sims, axis=1, kind="stable")[:, :ef].astype("i4")
    entry = descend(points, levels[1:], flat)
    return beam(points, levels[0].links, flat, entry, ef)[0]
