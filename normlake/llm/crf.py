"""A small linear-chain conditional random field over feature vectors, in NumPy.

Sequences are handled in batches, padded to the longest: features (sequences,
positions, features) and lengths.
"""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class LinearChainCRF:
    """Labels 0..n-1."""

    def __init__(self, labels: int, features: int) -> None:
        self.emit = np.zeros((features, labels))
        self.move = np.zeros((labels, labels))

    def fit(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray, rounds: int = 200, rate: float = 0.3, l2: float = 0.02) -> LinearChainCRF:
        """Gradient ascent on the penalised log likelihood with Adagrad steps; deterministic."""
        n, most, _ = x.shape
        k = len(self.move)
        inside = np.arange(most)[None] < lengths[:, None]
        target = np.zeros((n, most, k))
        target[np.arange(n)[:, None], np.arange(most)[None], y] = 1
        target *= inside[:, :, None]
        moved = np.einsum("nij,nik->jk", target[:, :-1] * inside[:, 1:, None], target[:, 1:])
        se, sm = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        for _ in range(rounds):
            score = x @ self.emit
            ahead, back = score.copy(), np.zeros_like(score)
            for i in range(1, most):
                step = _logsumexp(ahead[:, i - 1, :, None] + self.move[None], 1) + score[:, i]
                ahead[:, i] = np.where(inside[:, i, None], step, ahead[:, i - 1])
            for i in range(most - 2, -1, -1):
                step = _logsumexp(self.move[None] + (score[:, i + 1] + back[:, i + 1])[:, None, :], 2)
                back[:, i] = np.where(inside[:, i + 1, None], step, 0.0)
            z = _logsumexp(ahead[:, -1], 1)
            p = np.exp(ahead + back - z[:, None, None]) * inside[:, :, None]
            ge = np.einsum("nif,nik->fk", x, target - p) - l2 * n * self.emit / 50
            gm = moved - l2 * n * self.move / 50
            for i in range(1, most):
                both = np.exp(ahead[:, i - 1, :, None] + self.move[None] + (score[:, i] + back[:, i])[:, None, :] - z[:, None, None])
                gm = gm - (both * inside[:, i, None, None]).sum(0)
            se += ge**2
            sm += gm**2
            self.emit += rate * ge / np.sqrt(se)
            self.move += rate * gm / np.sqrt(sm)
        return self

    def tag(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The most probable labels (Viterbi) of sequences that follow each other in x, `sizes` rows each."""
        score = x @ self.emit
        out = np.zeros(len(x), dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        # Longest first: the sequences that reach a position are a leading part.
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], starts[order]
        if not len(sizes) or not sizes[0]:
            return out
        alive = [int((sizes > i).sum()) for i in range(int(sizes[0]))]
        best = score[starts[: alive[0]]]
        from_ = np.zeros((len(x), score.shape[1]), dtype=np.int8)
        for i in range(1, len(alive)):
            n = alive[i]
            step = best[:n, :, None] + self.move[None]
            at = starts[:n] + i
            from_[at] = step.argmax(1)
            best[:n] = step.max(1) + score[at]
        label = best.argmax(1)
        for i in range(len(alive) - 1, -1, -1):
            at = starts[: alive[i]] + i
            # A sequence whose last position this is starts with its best end.
            out[at] = label[: alive[i]]
            label[: alive[i]] = from_[at, label[: alive[i]]]
        return out
