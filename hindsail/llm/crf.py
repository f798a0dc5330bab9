"""A linear-chain conditional random field in numpy: batched training and Viterbi."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _grid(features: Sequence[Sequence[Sequence[int]]], width: int, pad: int) -> np.ndarray:
    """(sequences, steps, width) of feature numbers; empty places hold pad."""
    out = np.full((len(features), max(map(len, features)), width), pad, np.int64)
    for i, steps in enumerate(features):
        for t, ids in enumerate(steps):
            out[i, t, : len(ids)] = ids
    return out


#: Steps of sequences that are decoded together, and of these whose features are held at once.
CELLS, HELD = 1 << 16, 1 << 13


@dataclass
class Crf:
    """vocabulary: feature -> number; weights: (features + 1, labels), the last row zero for unknown features; moves: (labels, labels); starts: (labels)."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def numbers(self, steps: Sequence[Sequence[str]]) -> list[list[int]]:
        get = self.vocabulary.get
        return [[k for f in names if (k := get(f)) is not None] for names in steps]

    def decode(self, lengths: Sequence[int], features: Callable[[int, int, int], Sequence[Sequence[str]]]) -> list[list[int]]:
        """Best label sequence of each sequence, ties to the lower label. features(i, lo, hi): those of sequence i's steps from lo to hi.

        Sequences are decoded longest first, so many together that they have
        CELLS steps at most (one that is longer goes alone), and step by step:
        features and scores are made for HELD steps at once, and what is carried
        on is a score a label. Of all steps only a byte a label is kept.
        """
        out: list[list[int]] = [[] for _ in lengths]
        order, at = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i]), 0
        while at < len(order):
            longest = lengths[order[at]]
            part = order[at : at + max(1, CELLS // longest)]
            at += len(part)
            own, back = np.array([lengths[i] for i in part]), np.zeros((len(part), longest, len(self.starts)), np.int8)
            best = last = np.zeros((len(part), len(self.starts)))
            for lo in range(0, longest, span := max(1, HELD // len(part))):
                hi = min(longest, lo + span)
                numbered = [self.numbers(features(i, lo, min(hi, lengths[i]))) if lengths[i] > lo else [] for i in part]
                grid = np.full((len(part), hi - lo, max((len(x) for s in numbered for x in s), default=0) or 1), len(self.vocabulary), np.int32)
                for row, steps in enumerate(numbered):
                    for t, ids in enumerate(steps):
                        grid[row, t, : len(ids)] = ids
                scores = self.weights[grid].sum(axis=2)
                for t in range(lo, hi):
                    if t:
                        paths = best[:, :, None] + self.moves
                        back[:, t] = paths.argmax(axis=1)
                        best = paths.max(axis=1) + scores[:, t - lo]
                    else:
                        best = self.starts + scores[:, 0]
                    last = np.where((own > t)[:, None], best, last)
            label, rows = last.argmax(axis=1), np.arange(len(part))
            labels = np.zeros((len(part), longest), np.int8)
            for t in range(longest - 1, -1, -1):
                live = own > t
                labels[live, t] = label[live]
                label = np.where(live, back[rows, t, label], label)
            for row, i in enumerate(part):
                out[i] = labels[row, : lengths[i]].tolist()
        return out


def train(sequences: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[int]], n_labels: int, rounds: int = 120, rate: float = 0.2, ridge: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam on the whole table; deterministic."""
    vocabulary: dict[str, int] = {}
    for steps in sequences:
        for names in steps:
            for f in names:
                vocabulary.setdefault(f, len(vocabulary))
    numbered = [[[vocabulary[f] for f in names] for names in steps] for steps in sequences]
    width = max(len(x) for s in numbered for x in s)
    pad = len(vocabulary)
    grid, lengths = _grid(numbered, width, pad), np.array([len(s) for s in sequences])
    n, steps = grid.shape[:2]
    gold = np.zeros((n, steps), np.int64)
    live = np.arange(steps)[None] < lengths[:, None]
    for i, own in enumerate(labels):
        gold[i, : len(own)] = own
    hot = np.eye(n_labels)[gold] * live[:, :, None]
    model = [np.zeros((pad + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    mean, spread = [np.zeros_like(w) for w in model], [np.zeros_like(w) for w in model]
    pairs = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    for step in range(1, rounds + 1):
        weights, moves, starts = model
        scores = weights[grid].sum(axis=2)
        ahead = np.empty_like(scores)
        ahead[:, 0] = starts + scores[:, 0]
        for t in range(1, steps):
            ahead[:, t] = np.where(live[:, t, None], _lse(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t], ahead[:, t - 1])
        total = _lse(ahead[:, -1], 1)
        behind, expected = np.zeros_like(scores), np.zeros_like(moves)
        for t in range(steps - 2, -1, -1):
            onward = scores[:, t + 1] + behind[:, t + 1]
            behind[:, t] = np.where(live[:, t + 1, None], _lse(moves[None] + onward[:, None], 2), 0)
            joint = np.exp(ahead[:, t, :, None] + moves + onward[:, None] - total[:, None, None]) * live[:, t + 1, None, None]
            expected += joint.sum(axis=0)
        single = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
        error = single - hot
        slope = np.zeros_like(weights)
        np.add.at(slope, grid.reshape(-1), np.repeat(error.reshape(-1, n_labels), width, axis=0))
        slope[pad] = 0
        for k, g in enumerate((slope / n + ridge * weights, (expected - pairs) / n + ridge * moves, error[:, 0].sum(axis=0) / n)):
            mean[k] += 0.1 * (g - mean[k])
            spread[k] += 0.01 * (g * g - spread[k])
            model[k] = model[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-8)
    model[0][pad] = 0
    return Crf(vocabulary, *model)
