"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

from __future__ import annotations

import numpy as np


class Graph:
    """x: unit vectors, float32. links[l]: for each node its neighbours in layer l, filled up with -1."""

    def __init__(self, x: np.ndarray, level: np.ndarray, links: list[np.ndarray]):
        self.x, self.level, self.links = x, level, links

    @property
    def entry(self) -> int:
        return int(np.argmax(self.level))

    @classmethod
    def build(cls, x: np.ndarray, m: int = 12, ef: int = 48, seed: int = 1) -> Graph:
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64), 6)
        g = cls(x, level, [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)])
        done = 0
        while done < n:
            ids = np.arange(done, min(n, done + min(1024, max(32, done // 2))))
            g._insert(ids, done, ef)
            done = int(ids[-1]) + 1
        return g

    def _insert(self, ids: np.ndarray, done: int, ef: int) -> None:
        peers = self.x[ids] @ self.x[ids].T
        at = None
        if done:
            top = int(np.argmax(self.level[:done]))
            at = np.full((len(ids), 1), top)
            first = int(self.level[top])
        for l in range(len(self.links) - 1, -1, -1):
            mine = np.flatnonzero(self.level[ids] >= l)
            cand, sims = np.zeros((len(mine), 0), dtype=np.int64), np.zeros((len(mine), 0), dtype=np.float32)
            if done and l <= first:
                got, s = self.beam(self.x[ids], at, l, ef if l == 0 or len(mine) else 4)
                at = got[:, :8]
                cand, sims = got[mine], s[mine]
            if not len(mine):
                continue
            own = peers[np.ix_(mine, mine)].copy()
            np.fill_diagonal(own, -np.inf)
            k = min(len(mine) - 1, self.links[l].shape[1])
            if k > 0:
                best = np.argpartition(-own, k - 1, axis=1)[:, :k]
                cand = np.concatenate([cand, ids[mine][best]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, best, 1)], axis=1)
            if not cand.shape[1]:
                continue
            chosen = self._diverse(cand, sims, self.links[l].shape[1] // (2 if l == 0 else 1))
            self.links[l][ids[mine], :chosen.shape[1]] = chosen
            self._link_back(ids[mine], chosen, l)

    def _diverse(self, cand: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates up to `width`: near ones first, none nearer to one taken than to the row's own vector; then fills up."""
        order = np.argsort(-sims, axis=1)[:, : 3 * width]
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        rows, n = cand.shape
        v = self.x[np.maximum(cand, 0)]
        between = np.einsum("rid,rjd->rij", v, v)
        taken = np.zeros((rows, n), dtype=bool)
        valid = (cand >= 0) & np.isfinite(sims)
        count = np.zeros(rows, dtype=np.int64)
        for i in range(n):
            close = (np.where(taken[:, :i], between[:, i, :i], -2).max(axis=1, initial=-2)) > sims[:, i]
            ok = valid[:, i] & ~close & (count < width)
            taken[:, i] = ok
            count += ok
        rank = np.where(taken, 0, 1) * n + np.arange(n) + np.where(valid, 0, 3 * n)
        pick = np.argsort(rank, axis=1)[:, :width]
        return np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(cand, pick, 1), -1).astype(np.int32)

    def _link_back(self, ids: np.ndarray, chosen: np.ndarray, l: int) -> None:
        links, width = self.links[l], self.links[l].shape[1]
        src, dst = np.repeat(ids, chosen.shape[1]), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, begin, count = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(nodes), 512):
            part = slice(a, a + 512)
            most = int(count[part].max())
            add = np.full((len(nodes[part]), most), -1, dtype=np.int64)
            for r, (b, c) in enumerate(zip(begin[part], count[part])):
                add[r, :c] = src[b:b + c]
            cand = np.concatenate([links[nodes[part]].astype(np.int64), add], axis=1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.einsum("rid,rd->ri", self.x[np.maximum(cand, 0)], self.x[nodes[part]])
            sims[cand < 0] = -np.inf
            chosen = self._diverse(cand, sims, width)
            links[nodes[part]] = -1
            links[nodes[part], :chosen.shape[1]] = chosen

    def beam(self, q: np.ndarray, starts: np.ndarray, l: int, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ef nodes of layer l found nearest to each row of q, nearest first (-1 where fewer), and their similarities."""
        links, n = self.links[l], len(q)
        seen = np.zeros((n, len(self.x)), dtype=bool)
        ids, sims, open_ = np.full((n, ef), -1, dtype=np.int64), np.full((n, ef), -np.inf, dtype=np.float32), np.zeros((n, ef), dtype=bool)
        rows, new = np.arange(n), starts.astype(np.int64)
        while len(rows):
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            fresh = (new >= 0) & ~seen[rows[:, None], np.maximum(new, 0)]
            r, c = np.nonzero(fresh)
            seen[rows[r], new[r, c]] = True
            s = np.full(new.shape, -np.inf, dtype=np.float32)
            s[r, c] = np.einsum("id,id->i", self.x[new[r, c]], q[rows[r]])
            all_ids, all_sims = np.concatenate([ids[rows], np.where(fresh, new, -1)], axis=1), np.concatenate([sims[rows], s], axis=1)
            all_open = np.concatenate([open_[rows], fresh], axis=1)
            top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
            ids[rows], sims[rows], open_[rows] = (np.take_along_axis(y, top, 1) for y in (all_ids, all_sims, all_open))
            live = open_[rows].any(axis=1)
            rows = rows[live]
            if not len(rows):
                break
            k = min(step, ef)
            score = np.where(open_[rows], sims[rows], -np.inf)
            pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
            ok = np.isfinite(np.take_along_axis(score, pick, 1))
            node = np.where(ok, np.take_along_axis(ids[rows], pick, 1), -1)
            open_[rows[:, None], pick] = False
            new = np.where(node[:, :, None] >= 0, links[np.maximum(node, 0)], -1).reshape(len(rows), -1).astype(np.int64)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def within(self, q: np.ndarray, least: float, ef: int, slack: float, slice_: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, node) pairs found with a similarity of at least `least`: a beam, then every node above least - slack is followed up."""
        at = np.full((len(q), 1), self.entry)
        for l in range(len(self.links) - 1, 0, -1):
            at = self.beam(q, at, l, 4)[0]
        ids, sims = self.beam(q, at, 0, min(ef, max(1, len(self.x))))
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        r, c = np.nonzero(ids >= 0)
        seen[r, ids[r, c]] = True
        r, c = np.nonzero(sims >= least)
        found = [(r, ids[r, c])]
        r, c = np.nonzero(sims >= least - slack)
        front = [(r, ids[r, c])]
        while front:
            r, node = front.pop()
            if len(r) > slice_:
                front += [(r[a:a + slice_], node[a:a + slice_]) for a in range(0, len(r), slice_)]
                continue
            nb = self.links[0][node]
            rr, nn = np.repeat(r, nb.shape[1]), nb.ravel().astype(np.int64)
            ok = nn >= 0
            rr, nn = rr[ok], nn[ok]
            ok = ~seen[rr, nn]
            key = np.unique(rr[ok] * len(self.x) + nn[ok])
            if not len(key):
                continue
            rr, nn = key // len(self.x), key % len(self.x)
            seen[rr, nn] = True
            s = np.concatenate([np.einsum("id,id->i", self.x[nn[a:a + slice_]], q[rr[a:a + slice_]]) for a in range(0, len(key), slice_)])
            hit = s >= least
            if hit.any():
                found.append((rr[hit], nn[hit]))
            on = s >= least - slack
            if on.any():
                front.append((rr[on], nn[on]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def audited(self, least: float, recall: float, foreign: np.ndarray, sample: int = 128, seed: int = 3) -> tuple[int, float, float]:
        """Beam width and slack at which queries find `recall` of what a full scan finds, and that recall; widens until it passes.

        Queries are `foreign` vectors, none of which is a node, and vectors made from nodes by turning them away so
        far that their node is near the limit; so there are queries with links however few links the data have.
        The recall is a mean over queries with links, so that one with thousands counts as much as one with a
        single link, and the worse of both kinds decides.
        """
        rng = np.random.default_rng(seed)
        some = self.x[rng.permutation(len(self.x))[:sample]].astype(np.float64)
        turn = rng.standard_normal(some.shape)
        turn -= (turn * some).sum(1, keepdims=True) * some
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        cos = least + (1 - least) * rng.uniform(0.02, 0.5, (len(some), 1))
        made = cos * some + np.sqrt(1 - cos * cos) * turn
        kinds = [q.astype(np.float32) for q in (made, foreign[:sample]) if len(q)]
        true = [np.concatenate([(q[a:a + 64] @ self.x.T >= least).sum(1) for a in range(0, len(q), 64)]) for q in kinds]
        ef, slack = 48, 0.05
        while True:
            worst = 1.0
            for q, n in zip(kinds, true):
                got = np.bincount(self.within(q, least, ef, slack)[0], minlength=len(q))
                if (n > 0).any():
                    worst = min(worst, float((got[n > 0] / n[n > 0]).mean()))
            if worst >= recall or ef >= len(self.x):
                return ef, slack, worst
            ef, slack = min(2 * ef, len(self.x)), min(slack + 0.05, 2.0)
