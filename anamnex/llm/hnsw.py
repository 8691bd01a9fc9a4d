"""Hierarchical navigable small-world graphs in numpy, built and searched for many vectors in step.

Vectors are unit rows of float32; nearness is the inner product. Levels are drawn from a geometric distribution. New
nodes come in batches: each finds candidates by beam search in the graph so far and among its batch, keeps up to M of
them that are nearer to it than to one another's choice, and is linked back; full lists are chosen anew.
"""

from __future__ import annotations

import numpy as np

M, BUILD_BEAM, BATCH = 16, 40, 512
#: Candidates whose neighbours are looked up in one step, for each query.
AT_ONCE = 4


def cells(width: int) -> int:
    return 1 << max(8, (16 * width - 1).bit_length())


class Graph:
    def __init__(self, x: np.ndarray, seed: int = 11):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        self.level = np.minimum(level, 6)
        if n:
            self.level[0] = self.level.max()
        self.links = [np.full((n, 2 * M if l == 0 else M), -1, np.int32) for l in range(int(self.level.max()) + 1 if n else 1)]
        self.entry = 0
        done, size = min(1, n), 1
        while done < n:
            size = min(BATCH, max(1, done), n - done)
            self.insert(np.arange(done, done + size))
            done += size

    @classmethod
    def of(cls, x: np.ndarray, links: list[np.ndarray]) -> Graph:
        own = cls.__new__(cls)
        own.x, own.links, own.entry = np.ascontiguousarray(x, np.float32), links, 0
        return own

    def beam(self, q: np.ndarray, starts: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and inner products of the `width` best found for each query, best first; -1 pads. starts: nodes by query.

        What was looked at is remembered in a table of cells(width) places a query, whatever the size of the graph. A
        place that a later node took over is no proof, so such nodes are held against the beam itself; one that has left
        the beam cannot come back, as the beam only gets better.
        """
        links, rows, places = self.links[level], len(q), cells(width)
        seen = np.full((rows, places + 1), -1, np.int32)

        def place(nodes: np.ndarray) -> np.ndarray:
            return np.where(nodes >= 0, nodes & (places - 1), places)

        line = np.arange(rows)[:, None]
        ids = np.full((rows, width), -1, np.int64)
        sim = np.full((rows, width), -np.inf, np.float32)
        k = min(width, starts.shape[1])
        ids[:, :k] = starts[:, :k]
        sim[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qd,qkd->qk", q, self.x[np.maximum(ids[:, :k], 0)]), -np.inf)
        seen[line, place(ids[:, :k])] = ids[:, :k]
        order = np.argsort(-sim, 1, kind="stable")
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        fresh = ids >= 0
        live = np.arange(rows)
        while len(live):
            f = fresh[live]
            rank = np.cumsum(f, 1)
            take = f & (rank <= AT_ONCE)
            some = take.any(1)
            live, take = live[some], take[some]
            if not len(live):
                break
            at = np.argsort(~take, 1, kind="stable")[:, :AT_ONCE]
            nodes = np.where(np.take_along_axis(take, at, 1), np.take_along_axis(ids[live], at, 1), -1)
            fr = fresh[live]
            fr[take] = False
            fresh[live] = fr
            near = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(live), -1).astype(np.int64)
            there = seen[live[:, None], place(near)]
            near[there == near] = -1
            doubt = np.argwhere((there >= 0) & (near >= 0))
            if len(doubt):
                held = (ids[live[doubt[:, 0]]] == near[doubt[:, 0], doubt[:, 1]][:, None]).any(1)
                near[doubt[held, 0], doubt[held, 1]] = -1
            near = np.sort(near, 1)[:, ::-1]
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            wide = int((near >= 0).sum(1).max(initial=0))
            if not wide:
                continue
            near = np.sort(near, 1)[:, ::-1][:, :wide]
            seen[live[:, None], place(near)] = near
            seen[:, places] = -1
            s = np.where(near >= 0, np.einsum("qd,qkd->qk", q[live], self.x[np.maximum(near, 0)]), -np.inf)
            all_sim = np.concatenate([sim[live], s], 1)
            best = np.argsort(-all_sim, 1, kind="stable")[:, :width]
            sim[live] = np.take_along_axis(all_sim, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), best, 1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], near >= 0], 1), best, 1) & (sim[live] > -np.inf)
        return ids, sim

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(q), 1), self.entry, np.int64)
        for level in range(len(self.links) - 1, 0, -1):
            at = self.beam(q, at, level, 4)[0]
        return self.beam(q, at, 0, width)

    def insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        at = np.full((len(new), 1), self.entry, np.int64)
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        for level in range(len(self.links) - 1, -1, -1):
            joins = self.level[new] >= level
            found, sim = self.beam(q, at, level, BUILD_BEAM if joins.any() else 4)
            at = found[:, :8]
            if not joins.any():
                continue
            mine = np.flatnonzero(joins)
            k = min(BUILD_BEAM, len(mine))
            inner = among[np.ix_(mine, mine)]
            best = np.argsort(-inner, 1, kind="stable")[:, :k]
            own_sim = np.take_along_axis(inner, best, 1)
            own_ids = np.where(own_sim > -np.inf, new[mine][best], -1)
            ids, s = np.concatenate([found[mine], own_ids], 1), np.concatenate([sim[mine], own_sim], 1)
            chosen = self.choose(new[mine], ids, s, M)
            self.links[level][new[mine], :M] = chosen
            self.back(level, np.repeat(new[mine], M), chosen.ravel())

    def choose(self, nodes: np.ndarray, ids: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of the candidates: first those nearer to the node than to any chosen one, then the best others."""
        out = np.full((len(nodes), most), -1, np.int64)
        for a in range(0, len(nodes), 128):
            i, s = ids[a : a + 128], np.where(ids[a : a + 128] >= 0, sim[a : a + 128], -np.inf)
            order = np.argsort(-s, 1, kind="stable")[:, : 3 * most]
            i, s = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
            v = self.x[np.maximum(i, 0)]
            inner = np.einsum("qad,qbd->qab", v, v)
            taken = np.zeros(i.shape, bool)
            closest = np.full(i.shape, -np.inf, np.float32)
            for k in range(i.shape[1]):
                good = (s[:, k] > closest[:, k]) & (taken.sum(1) < most) & (s[:, k] > -np.inf)
                taken[good, k] = True
                closest[good] = np.maximum(closest[good], inner[good, k])
            rank = np.argsort(np.where(s > -np.inf, np.where(taken, 0, 1), 2), 1, kind="stable")[:, :most]
            out[a : a + 128, : rank.shape[1]] = np.where(np.take_along_axis(s, rank, 1) > -np.inf, np.take_along_axis(i, rank, 1), -1)
        return out

    def back(self, level: int, sources: np.ndarray, targets: np.ndarray) -> None:
        links = self.links[level]
        good = targets >= 0
        sources, targets = sources[good], targets[good]
        order = np.argsort(targets, kind="stable")
        sources, targets = sources[order], targets[order]
        nodes, starts, counts = np.unique(targets, return_index=True, return_counts=True)
        have = (links[nodes] >= 0).sum(1)
        place = np.arange(len(targets)) - np.repeat(starts, counts) + np.repeat(have, counts)
        wide = np.full((len(nodes), int((have + counts).max(initial=0))), -1, np.int64)
        w = min(wide.shape[1], links.shape[1])
        wide[:, :w] = links[nodes][:, :w]
        wide[np.repeat(np.arange(len(nodes)), counts), place] = sources
        fits = have + counts <= links.shape[1]
        links[nodes[fits], :w] = wide[fits, :w]
        for a in range(0, int((~fits).sum()), 256):
            some, rows = nodes[~fits][a : a + 256], wide[~fits][a : a + 256]
            sim = np.einsum("qd,qkd->qk", self.x[some], self.x[np.maximum(rows, 0)])
            links[some] = self.choose(some, rows, sim, links.shape[1])
