"""A robust-pruned directed graph over unit vectors, built and searched for many points at once.

Points join in batches that double in size.  A batch searches the graph so far
greedily with a beam; what each search has met is pruned by relaxed distance: a
candidate goes when a kept neighbour is nearer to it by a factor than the point
itself is, so that edges point in different directions.  Edges are also put in
the other way round, and lists that grow too long are pruned again.  All steps
work on arrays over a whole batch.
"""

from __future__ import annotations

import numpy as np


class PrunedGraph:
    """Graph over the rows of ``x`` (unit vectors, float32).

    degree: most edges of a point; beam: width of the searches; alpha: the
    relaxation (>= 1) of pruning.  Equal points are allowed.
    """

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 24, alpha: float = 1.2, first: int = 32, starts: int = 4, seed: int = 7):
        self.x, self.degree, self.beam, self.alpha = np.ascontiguousarray(x, dtype=np.float32), degree, beam, alpha
        n = len(x)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        head = order[: max(first, degree + 1)]
        self.entry = order[:starts]
        self._link(head, np.broadcast_to(head, (len(head), len(head))))
        done = len(head)
        while done < n:
            batch = order[done : 2 * done]
            found, _ = self.search(self.x[batch], np.broadcast_to(self.entry, (len(batch), len(self.entry))))
            self._link(batch, found)
            done += len(batch)

    # -- building ---------------------------------------------------------
    def _prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Up to ``degree`` diverse neighbours for each point of its candidates (-1: none)."""
        out = np.full((len(points), self.degree), -1, dtype=np.int32)
        step = max(1, 2_000_000 // max(1, candidates.shape[1] * self.x.shape[1]))
        for lo in range(0, len(points), step):
            p, c = points[lo : lo + step], candidates[lo : lo + step]
            near = np.einsum("bd,bcd->bc", self.x[p], self.x[c])
            near[(c < 0) | (c == p[:, None])] = -np.inf
            by = np.argsort(-near, axis=1, kind="stable")
            c, near = np.take_along_axis(c, by, 1), np.take_along_axis(near, by, 1)
            repeated = np.zeros(c.shape, dtype=bool)
            v = self.x[c]
            among = np.matmul(v, v.transpose(0, 2, 1))
            repeated = np.triu(np.ones(c.shape[1:] * 2, dtype=bool), 1)[None] & (c[:, :, None] == c[:, None, :])
            alive = np.isfinite(near) & ~repeated.any(axis=1)
            gap = 1.0 - near  # half the squared distance
            kept = np.zeros(len(p), dtype=np.int64)
            for j in range(c.shape[1]):
                take = np.flatnonzero(alive[:, j] & (kept < self.degree))
                if not len(take):
                    continue
                out[lo + take, kept[take]] = c[take, j]
                kept[take] += 1
                covered = self.alpha * (1.0 - among[take, j]) <= gap[take] - 1e-6  # equal points, within single precision, keep their edges
                alive[take] &= ~covered
        return out

    def _link(self, points: np.ndarray, candidates: np.ndarray) -> None:
        chosen = self._prune(points, candidates)
        self.edges[points] = chosen
        src = np.repeat(points, self.degree)
        dst = chosen.ravel()
        real = dst >= 0
        src, dst = src[real], dst[real]
        if not len(dst):
            return
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        nodes, start, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(count.max())
        back = np.full((len(nodes), width), -1, dtype=np.int32)
        row = np.repeat(np.arange(len(nodes)), count)
        back[row, np.arange(len(dst)) - np.repeat(start, count)] = src
        # a list with room takes the new edges as they are; a longer one is pruned again
        own = self.edges[nodes]
        both = np.concatenate([own, back], axis=1)
        order = np.argsort(both < 0, axis=1, kind="stable")
        both = np.take_along_axis(both, order, 1)
        fits = (both >= 0).sum(axis=1) <= self.degree
        self.edges[nodes[fits]] = both[fits][:, : self.degree]
        rest = np.flatnonzero(~fits)
        if len(rest):
            used = int((both[rest] >= 0).sum(axis=1).max())
            self.edges[nodes[rest]] = self._prune(nodes[rest], both[rest][:, :used])

    # -- searching --------------------------------------------------------
    def search(self, q: np.ndarray, starts: np.ndarray, beam: int | None = None, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` points found nearest to each row of ``q`` (-1: none) and their similarities, nearest first."""
        parts = [self._search(q[i : i + block], starts[i : i + block], beam or self.beam) for i in range(0, len(q), block)]
        if not parts:
            return np.zeros((0, beam or self.beam), np.int32), np.zeros((0, beam or self.beam), np.float32)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, q: np.ndarray, starts: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        n, m, expand = len(q), len(self.x), min(expand, beam)
        seen = np.zeros((n, m + 1), dtype=bool)  # the last column stands for "no point"
        seen[:, m] = True
        every = np.arange(n)[:, None]
        ids = np.full((n, beam), m, dtype=np.int32)
        sim = np.full((n, beam), -np.inf, dtype=np.float32)
        opened = np.ones((n, beam), dtype=bool)
        k = min(beam, starts.shape[1])
        ids[:, :k] = starts[:, :k]
        sim[:, :k] = np.einsum("nd,nkd->nk", q, self.x[starts[:, :k]])
        opened[:, :k] = False
        seen[every, ids] = True
        live = np.arange(n)
        while len(live):
            o = np.where(opened[live], -np.inf, sim[live])
            pick = np.argpartition(-o, expand - 1, axis=1)[:, :expand]
            real = np.isfinite(np.take_along_axis(o, pick, 1))
            going = real.any(axis=1)
            live, pick, real = live[going], pick[going], real[going]
            if not len(live):
                break
            rows = live[:, None]
            opened[rows, pick] |= real
            node = np.where(real, ids[rows, pick], m)
            new = np.where(node[:, :, None] < m, self.edges[np.minimum(node, m - 1)], -1).reshape(len(live), -1)
            new = np.where(new < 0, m, new)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = m
            fresh = ~seen[rows, new]
            seen[rows, new] = True
            r, c = np.nonzero(fresh)
            s = np.full(new.shape, -np.inf, dtype=np.float32)
            target = new[r, c]
            s[r, c] = np.einsum("kd,kd->k", q[live[r]], self.x[target])
            all_sim = np.concatenate([sim[live], s], axis=1)
            best = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            all_ids = np.concatenate([ids[live], np.where(fresh, new, m)], axis=1)
            all_open = np.concatenate([opened[live], ~fresh], axis=1)
            ids[live] = np.take_along_axis(all_ids, best, 1)
            sim[live] = np.take_along_axis(all_sim, best, 1)
            opened[live] = np.take_along_axis(all_open, best, 1)
        by = np.argsort(-sim, axis=1, kind="stable")
        ids, sim = np.take_along_axis(ids, by, 1), np.take_along_axis(sim, by, 1)
        return np.where(ids == m, -1, ids), sim
