"""A linear-chain conditional random field over sparse binary features, in numpy, batched over sequences."""

from __future__ import annotations

import numpy as np


class Sequences:
    """Sequences of items, each with active features, laid out flat and padded."""

    def __init__(self, items: list[list[list[int]]]):
        self.lengths = np.array([len(s) for s in items], np.int64)
        self.steps = int(self.lengths.max(initial=0))
        self.mask = np.arange(self.steps) < self.lengths[:, None]
        number: dict[tuple[int, ...], int] = {}  # items with the same features are scored once
        self.kind = np.array([number.setdefault(tuple(f), len(number)) for s in items for f in s], np.int64)
        sizes = np.array([len(f) for f in number], np.int64)
        self.n_kinds = len(number)
        self.features = np.fromiter((x for f in number for x in f), np.int64, int(sizes.sum()))
        self.kind_of = np.repeat(np.arange(self.n_kinds), sizes)
        order = np.argsort(self.features, kind="stable")
        self.kinds_by_feature = self.kind_of[order]
        self.each_feature, self.feature_starts = np.unique(self.features[order], return_index=True)
        self.some = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.some]

    def sums(self, of_items: np.ndarray, n_features: int) -> np.ndarray:
        """For each feature, the sum of its items' rows."""
        out = np.zeros((n_features, of_items.shape[1]))
        if len(self.features):
            kinds = np.stack([np.bincount(self.kind, of_items[:, k], self.n_kinds) for k in range(of_items.shape[1])], axis=1)
            out[self.each_feature] = np.add.reduceat(kinds[self.kinds_by_feature], self.feature_starts)
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(sequence, step, label) scores; 0 where padded."""
        kinds = np.zeros((self.n_kinds, weights.shape[1]))
        if len(self.features):
            kinds[self.some] = np.add.reduceat(weights[self.features], self.starts)
        flat = kinds[self.kind]
        out = np.zeros((*self.mask.shape, weights.shape[1]))
        out[self.mask] = flat
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class ChainField:
    def __init__(self, n_features: int, n_labels: int):
        self.weights = np.zeros((n_features, n_labels))
        self.moves = np.zeros((n_labels, n_labels))

    def _marginals(self, seq: Sequences, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label marginals and expected moves, each sequence counted so many times."""
        emit, mask = seq.scores(self.weights), seq.mask
        n, steps, labels = emit.shape
        fore = np.zeros_like(emit)
        fore[:, 0] = emit[:, 0]
        for t in range(1, steps):
            step = _lse(fore[:, t - 1, :, None] + self.moves, 1) + emit[:, t]
            fore[:, t] = np.where(mask[:, t, None], step, fore[:, t - 1])
        total = _lse(fore[:, -1], 1)
        back = np.zeros_like(emit)
        for t in range(steps - 2, -1, -1):
            step = _lse(self.moves + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], step, 0)
        # past its end a sequence's forward row repeats; only true steps count below
        single = np.exp(np.minimum(0, fore + back - total[:, None, None])) * (mask * times[:, None])[:, :, None]
        moves = np.zeros((labels, labels))
        for t in range(1, steps):
            both = fore[:, t - 1, :, None] + self.moves + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None]
            moves += (np.exp(np.minimum(0, both)) * (mask[:, t] * times)[:, None, None]).sum(axis=0)
        return single, moves

    def fit(self, seq: Sequences, labels: np.ndarray, times: np.ndarray, rounds: int = 150, l2: float = 2.0, rate: float = 0.2, allowed: np.ndarray | None = None) -> ChainField:
        """labels: flat, one an item; times: how often each sequence occurs. Full-batch Adam on the penalised likelihood; the same data give the same field.

        allowed: which features may tell which labels (features by labels); by default all.
        """
        told = np.zeros((len(labels), self.moves.shape[0]))
        told[np.arange(len(labels)), labels] = np.repeat(times, seq.lengths)
        seen = seq.sums(told, len(self.weights))
        padded = np.full(seq.mask.shape, -1)
        padded[seq.mask] = labels
        a, b = padded[:, :-1], padded[:, 1:]
        seen_moves = np.zeros_like(self.moves)
        np.add.at(seen_moves, (a[b >= 0], b[b >= 0]), np.repeat(times, np.maximum(0, seq.lengths - 1)))
        mean, square = [np.zeros_like(self.weights), np.zeros_like(self.moves)], [np.zeros_like(self.weights), np.zeros_like(self.moves)]
        for i in range(1, rounds + 1):
            single, moves = self._marginals(seq, times)
            expected = seq.sums(single[seq.mask], len(self.weights))
            step = seen - expected - l2 * self.weights
            if allowed is not None:
                step *= allowed
            for j, (w, g) in enumerate(((self.weights, step), (self.moves, seen_moves - moves - l2 * self.moves))):
                mean[j] = 0.9 * mean[j] + 0.1 * g
                square[j] = 0.99 * square[j] + 0.01 * g * g
                w += rate * (mean[j] / (1 - 0.9**i)) / (np.sqrt(square[j] / (1 - 0.99**i)) + 1e-6)
        return self

    def likelihoods(self, seq: Sequences, label: int) -> np.ndarray:
        """The probability of a label for each item, flat."""
        return self._marginals(seq, np.ones(len(seq.lengths)))[0][seq.mask][:, label] if seq.steps else np.zeros(0)

    def tag(self, seq: Sequences) -> np.ndarray:
        """The best labels, flat (Viterbi)."""
        if not seq.steps:
            return np.zeros(0, np.int64)
        emit, mask = seq.scores(self.weights), seq.mask
        n, steps, labels = emit.shape
        best = emit[:, 0]
        came = np.zeros((n, steps, labels), np.int64)
        for t in range(1, steps):
            step = best[:, :, None] + self.moves
            came[:, t] = step.argmax(axis=1)
            best = np.where(mask[:, t, None], step.max(axis=1) + emit[:, t], best)
        out = np.zeros((n, steps), np.int64)
        at = best.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            here = mask[:, t]
            out[here, t] = at[here]
            if t:
                at = np.where(here, came[np.arange(n), t, at], at)
        return out[mask]
