"""Hierarchical navigable small-world graphs over unit vectors, many queries at a time."""

from __future__ import annotations

import numpy as np

from sedge.llm import common as C

LINKS = 16
BUILD_BEAM = 48
BATCH = 256


class Graph:
    """levels: for each layer (ground first) its nodes and each node's neighbours, -1 filling up."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers
        self.place = []
        for nodes, _ in layers:
            place = np.full(len(x), -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            self.place.append(place)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and similarities of the best `beam` found for each query, best first, -1 filling up."""
        entry = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.layers) - 1, 0, -1):
            nodes, links = self.layers[k]
            found, _ = beam_search(self.x[nodes], links, q, entry, 1)
            entry = self.place[k - 1][nodes[found]]
        nodes, links = self.layers[0]
        found, sims = beam_search(self.x[nodes], links, q, entry, beam)
        return np.where(found >= 0, nodes[found], -1), sims


def beam_search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in one layer; all numbers are the layer's own. Several nodes open at a time."""
    n, many = len(q), 1 if beam == 1 else 4
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True
    k = min(beam, entry.shape[1])
    ids[:, :k] = entry[:, :k]
    sims[:, :k] = np.einsum("qkd,qd->qk", x[entry[:, :k]], q)
    opened[:, :k] = False
    np.put_along_axis(seen, entry[:, :k], True, 1)
    active = np.arange(n)
    while len(active):
        s = np.where(opened[active], -np.inf, sims[active])
        top = np.argpartition(-s, min(many, beam) - 1, axis=1)[:, :many]
        value = np.take_along_axis(s, top, 1)
        live = value[:, :].max(axis=1) > -np.inf
        active, top, value = active[live], top[live], value[live]
        if not len(active):
            break
        row = np.arange(len(active))[:, None]
        o = opened[active]
        o[row, top] = True
        opened[active] = o
        near = links[np.where(value > -np.inf, ids[active][row, top], 0)]
        near = np.where((value > -np.inf)[:, :, None], near, -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = ~seen[active[:, None], near] & (near >= 0)
        near = np.where(fresh, near, -1)
        got = fresh.any(axis=1)
        a, near = active[got], near[got]
        if not len(a):
            continue
        room = int((near >= 0).sum(axis=1).max())
        near = -np.sort(-near, axis=1)[:, :room]
        seen[a[:, None], near] = True
        new = np.einsum("qkd,qd->qk", x[near], q[a]).astype(np.float32)
        new[near < 0] = -np.inf
        all_ids = np.concatenate((ids[a], near), 1)
        all_sims = np.concatenate((sims[a], new), 1)
        all_open = np.concatenate((opened[a], near < 0), 1)
        best = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[a], sims[a], opened[a] = (np.take_along_axis(t, best, 1) for t in (all_ids, all_sims, all_open))
        opened[a] |= sims[a] == -np.inf
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(sims > -np.inf, ids, -1), sims


def choose(x: np.ndarray, node: int, near: np.ndarray, sims: np.ndarray, n: int) -> np.ndarray:
    """Up to n neighbours, nearest first, of those that are nearer to the node than to one chosen before; then the rest."""
    if len(near) <= n:
        return near
    order = np.argsort(-sims, kind="stable")
    near, sims = near[order], sims[order]
    among = x[near] @ x[near].T
    blocked, mine, left = np.zeros(len(near), bool), np.zeros(len(near), bool), n
    for k in range(len(near)):
        if not blocked[k]:
            mine[k] = True
            left -= 1
            if not left:
                break
            # nearer to this one than to the node
            blocked |= among[k] >= sims
    return near[np.concatenate((np.flatnonzero(mine), np.flatnonzero(~mine)))[:n]]


def layer_links(x: np.ndarray, links: int, beam: int) -> np.ndarray:
    """Neighbours of each row of x: rows come in batches, each searches those before it and its own batch."""
    n = len(x)
    out = np.full((n, links), -1, np.int64)
    done = 0
    while done < n:
        size = min(n - done, max(1, min(done, BATCH)))
        new = np.arange(done, done + size)
        own = x[new] @ x[new].T
        found, sims = (np.zeros((size, 0), np.int64), np.zeros((size, 0), np.float32)) if not done else beam_search(x[:done], np.where(out[:done] < done, out[:done], -1), x[new], np.zeros((size, 1), np.int64), min(beam, done))
        back: dict[int, list[int]] = {}
        for k in range(size):
            ok = found[k] >= 0
            mates = np.argsort(-own[k], kind="stable")[: links + 1]
            mates = mates[mates != k]
            near = np.concatenate((found[k][ok], new[mates]))
            s = np.concatenate((sims[k][ok], own[k][mates]))
            pick = choose(x, done + k, near, s, max(1, links // 2))
            out[done + k, : len(pick)] = pick
            for p in pick.tolist():
                back.setdefault(p, []).append(done + k)
        for p, add in back.items():
            have = out[p][out[p] >= 0]
            every = np.unique(np.concatenate((have, add)))
            every = every[every != p]
            if len(every) > links:
                every = choose(x, p, every, x[every] @ x[p], links)
            out[p] = -1
            out[p, : len(every)] = every
        done += size
    return out


def build(x: np.ndarray, keys: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
    """Graph over the rows of x; keys (longs) fix each row's top layer, row 0 is on all."""
    u = (C.mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
    top = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(links)).astype(int)
    top[0] = max(top.max(), 0)
    layers = []
    for k in range(top[0] + 1):
        nodes = np.flatnonzero(top >= k)
        layers.append((nodes, layer_links(x[nodes], links * (2 if k == 0 else 1), beam)))
    return Graph(x, layers)
