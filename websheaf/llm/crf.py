"""A linear-chain conditional random field over sparse binary features, vectorised across sequences."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chains:
    """Items of many sequences end to end. Item i looks like row kind[i]; row r has the features flat[ptr[r]:ptr[r+1]]
    (at least one); sequence s holds the items of [seq[s], seq[s+1])."""

    flat: np.ndarray
    ptr: np.ndarray
    kind: np.ndarray
    seq: np.ndarray


def chains(rows: list[list[int]], kind: np.ndarray, seq: np.ndarray) -> Chains:
    flat = np.array([f for row in rows for f in row], np.int64)
    return Chains(flat, np.cumsum([0, *map(len, rows)], dtype=np.int64), np.asarray(kind, np.int64), np.asarray(seq, np.int64))


def _steps(seq: np.ndarray) -> list[np.ndarray]:
    """For each position, the item at that place in every sequence that reaches it; longer sequences first."""
    lengths = np.diff(seq)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = seq[:-1][order], lengths[order]
    reach = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
    return [starts[:n] + t for t, n in enumerate(reach)]


class ChainModel:
    """Weights (features x labels), transitions (labels x labels) and start scores."""

    def __init__(self, n_features: int, n_labels: int):
        self.weights = np.zeros((n_features, n_labels))
        self.transitions = np.zeros((n_labels, n_labels))
        self.start = np.zeros(n_labels)

    def emissions(self, x: Chains) -> np.ndarray:
        if not len(x.kind):
            return np.zeros((0, self.weights.shape[1]))
        return np.add.reduceat(self.weights[x.flat], x.ptr[:-1], axis=0)[x.kind]

    def marginals(self, emissions: np.ndarray, seq: np.ndarray, pairs: bool = False):
        """P(label) of each item by forward-backward; with `pairs` also the expected transitions and log partition sum.

        Each step is scaled to sum to 1, so lengths do not matter.
        """
        shift = emissions.max(axis=1, keepdims=True) if len(emissions) else emissions
        e = np.exp(emissions - shift)
        t = np.exp(self.transitions)
        steps = _steps(seq)
        forward, backward, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
        for k, at in enumerate(steps):
            a = e[at] * (np.exp(self.start) if k == 0 else forward[at - 1] @ t)
            scale[at] = a.sum(axis=1)
            forward[at] = a / scale[at][:, None]
        expected = np.zeros_like(t)
        for at in reversed(steps[1:]):
            later = e[at] * backward[at] / scale[at][:, None]
            backward[at - 1] = later @ t.T
            if pairs:
                expected += t * (forward[at - 1].T @ later)
        gamma = forward * backward
        gamma /= gamma.sum(axis=1, keepdims=True)
        return (gamma, expected, float(np.log(scale).sum() + shift.sum())) if pairs else gamma

    def viterbi(self, emissions: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """The best label sequence; ties go to the smaller label."""
        best, back = emissions.copy(), np.zeros(emissions.shape, np.int64)
        steps = _steps(seq)
        for k, at in enumerate(steps):
            if k == 0:
                best[at] += self.start
            else:
                scores = best[at - 1][:, :, None] + self.transitions
                back[at] = scores.argmax(axis=1)
                best[at] += scores.max(axis=1)
        labels = np.zeros(len(emissions), np.int64)
        ends = seq[1:][np.diff(seq) > 0] - 1
        labels[ends] = best[ends].argmax(axis=1)
        for at in reversed(steps[1:]):
            labels[at - 1] = back[at, labels[at]]
        return labels

    def fit(self, x: Chains, labels: np.ndarray, *, rounds: int = 60, rate: float = 0.3, l2: float = 1e-4) -> ChainModel:
        """Maximises the penalised mean log-likelihood with Adam over the whole sample; deterministic."""
        n, k = len(labels), len(self.start)
        row = np.repeat(np.arange(len(x.ptr) - 1), np.diff(x.ptr))
        own = np.eye(k)[labels]
        first = x.seq[:-1][np.diff(x.seq) > 0]
        inner = np.setdiff1d(np.arange(n), first)
        seen = np.zeros((k, k))
        np.add.at(seen, (labels[inner - 1], labels[inner]), 1)
        params = [self.weights, self.transitions, self.start]
        mean, var = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, rounds + 1):
            gamma, expected, _ = self.marginals(self.emissions(x), x.seq, pairs=True)
            gap = own - gamma
            by_row = [np.bincount(x.kind, gap[:, j], len(x.ptr) - 1) for j in range(k)]
            grad = np.stack([np.bincount(x.flat, g[row], len(self.weights)) for g in by_row], axis=1)
            for i, g in enumerate((grad, seen - expected, gap[first].sum(axis=0))):
                g = g / n - l2 * params[i]
                mean[i] += 0.1 * (g - mean[i])
                var[i] += 0.01 * (g * g - var[i])
                params[i] += rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(var[i] / (1 - 0.99**step)) + 1e-9)
        return self
