"""Linear-chain conditional random fields over padded batches of chains, in numpy.

A batch has emissions (chains, steps, labels) and the chains' lengths.  Steps beyond a chain's length
are ignored.  One pass over the steps serves all chains of the batch.
"""

from __future__ import annotations

import numpy as np


def viterbi(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best label of every step (0 beyond a chain's end)."""
    chains, steps, _ = emissions.shape
    score = emissions[:, 0] + start
    back = np.zeros(emissions.shape, np.int8)
    for t in range(1, steps):
        through = score[:, :, None] + transitions
        best = through.argmax(1)
        back[:, t] = best
        live = (t < lengths)[:, None]
        score = np.where(live, np.take_along_axis(through, best[:, None], 1)[:, 0] + emissions[:, t], score)
    out = np.zeros((chains, steps), np.int8)
    label = score.argmax(1)
    rows = np.arange(chains)
    for t in range(steps - 1, -1, -1):
        live = t < lengths
        out[live, t] = label[live]
        label = np.where(live, back[rows, t, label], label)
    return out


def marginals(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Posterior label probabilities of every step by forward-backward, and expected transition counts if asked for."""
    chains, steps, labels = emissions.shape
    local = np.exp(emissions - emissions.max(2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    ahead = np.empty_like(local)
    first = local[:, 0] * np.exp(start - start.max())
    ahead[:, 0] = first / first.sum(1, keepdims=True)
    for t in range(1, steps):
        now = (ahead[:, t - 1] @ move) * local[:, t]
        ahead[:, t] = now / now.sum(1, keepdims=True)
    behind = np.full((chains, labels), 1.0 / labels, local.dtype)
    post = np.empty_like(local)
    expected = np.zeros((labels, labels)) if pairs else None
    for t in range(steps - 1, -1, -1):
        both = ahead[:, t] * behind
        post[:, t] = both / both.sum(1, keepdims=True)
        if t:
            weighted = local[:, t] * behind
            if pairs:
                joint = ahead[:, t - 1, :, None] * move * weighted[:, None, :]
                joint /= joint.sum((1, 2), keepdims=True)
                expected += joint[t < lengths].sum(0)
            before = weighted @ move.T
            before /= before.sum(1, keepdims=True)
            behind = np.where((t < lengths)[:, None], before, behind)
    post[np.arange(steps) >= lengths[:, None]] = 0
    return post, expected


class Adagrad:
    def __init__(self, shape: tuple[int, ...], rate: float) -> None:
        self.w, self.g, self.rate = np.zeros(shape), np.full(shape, 1e-8), rate

    def step(self, grad: np.ndarray) -> None:
        self.g += grad * grad
        self.w -= self.rate * grad / np.sqrt(self.g)


class RaggedFeatures:
    """Feature numbers of many types in one array; sums of a weight table's rows per type."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def sums(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.sizes), table.shape[1]), table.dtype)
        full = self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(table[self.flat], self.starts[full], axis=0)
        return out

    def spread(self, per_type: np.ndarray, size: int) -> np.ndarray:
        """The transpose of ``sums``: each type's row added to all of its features."""
        each = np.repeat(per_type, self.sizes, axis=0)
        return np.stack([np.bincount(self.flat, each[:, k], size) for k in range(per_type.shape[1])], axis=1)


def train(chains: list[np.ndarray], golds: list[np.ndarray], types: RaggedFeatures, cells: int, labels: int, passes: int, rate: float = 0.3, l2: float = 1e-4, batch: int = 256, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (cells, labels), transitions and start by maximum likelihood; a chain is a list of type numbers."""
    table, moves, start = Adagrad((cells, labels), rate), Adagrad((labels, labels), rate), Adagrad((labels,), rate)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        shuffled = order.permutation(len(chains))
        for at in range(0, len(shuffled), batch):
            own = shuffled[at : at + batch]
            lengths = np.array([len(chains[i]) for i in own])
            ids, gold = np.zeros((len(own), lengths.max()), np.int64), np.zeros((len(own), lengths.max()), np.int64)
            for r, i in enumerate(own):
                ids[r, : lengths[r]], gold[r, : lengths[r]] = chains[i], golds[i]
            live = np.arange(ids.shape[1]) < lengths[:, None]
            used, inside = np.unique(ids, return_inverse=True)
            part = RaggedFeatures([types.flat[types.starts[u] : types.starts[u] + types.sizes[u]] for u in used])
            emissions = part.sums(table.w)[inside.reshape(ids.shape)]
            post, expected = marginals(emissions, lengths, moves.w, start.w, pairs=True)
            post[live, gold[live]] -= 1
            per_type = np.stack([np.bincount(inside.ravel(), post[:, :, k].ravel(), len(used)) for k in range(labels)], axis=1)
            scale = 1 / len(own)
            table.step(part.spread(per_type, cells) * scale + l2 * table.w)
            follow = live[:, 1:]
            np.subtract.at(expected, (gold[:, :-1][follow], gold[:, 1:][follow]), 1)
            moves.step(expected * scale + l2 * moves.w)
            first = post[:, 0].sum(0)
            start.step(first * scale + l2 * start.w)
    return table.w, moves.w, start.w
