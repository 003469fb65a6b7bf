"""A linear-chain conditional random field with two labels, trained by its exact gradient in numpy and decoded by Viterbi."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights: `weights[f]` speaks for label 1 against 0, `moves[a, b]` for b after a, `first[a]` and `last[a]` for the ends."""

    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def viterbi(self, scores: Sequence[float]) -> list[int]:
        """The likeliest labels of a sequence whose items speak with `scores` for label 1; a tie goes to label 0."""
        if not len(scores):
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        zero, one = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for score in scores[1:]:
            from_zero = (zero + m00 >= one + m10, zero + m01 >= one + m11)
            zero, one = max(zero + m00, one + m10), max(zero + m01, one + m11) + score
            back.append(from_zero)
        label = int(one + self.last[1] > zero + self.last[0])
        labels = [label]
        for from_zero in reversed(back):
            label = 0 if from_zero[label] else 1
            labels.append(label)
        return labels[::-1]


def likelihood(chain: Chain, scores: np.ndarray, labels: np.ndarray, sizes: np.ndarray):
    """(log likelihood, gradient by score, by moves, by first, by last) over sequences padded to one length, longest first.

    `scores` and `labels` are sequences by places; places beyond `sizes` don't count.
    """
    rows, width = scores.shape
    every = np.arange(rows)
    going = (sizes[None, :] > np.arange(width)[:, None]).sum(1)      # sequences with a place t
    m = chain.moves
    zero, one = np.zeros((width, rows)), np.zeros((width, rows))     # log weight of all ways up to place t that end in a label
    zero[0], one[0] = chain.first[0], chain.first[1] + scores[:, 0]
    for t in range(1, width):
        k = going[t]
        z, o = zero[t - 1, :k], one[t - 1, :k]
        zero[t, :k] = np.logaddexp(z + m[0, 0], o + m[1, 0])
        one[t, :k] = np.logaddexp(z + m[0, 1], o + m[1, 1]) + scores[:k, t]
    end = sizes - 1
    total = np.logaddexp(zero[end, every] + chain.last[0], one[end, every] + chain.last[1])
    after_zero, after_one = np.full((width, rows), chain.last[0]), np.full((width, rows), chain.last[1])
    for t in range(width - 2, -1, -1):
        k = going[t + 1]
        z, o = after_zero[t + 1, :k], after_one[t + 1, :k] + scores[:k, t + 1]
        after_zero[t, :k] = np.logaddexp(m[0, 0] + z, m[0, 1] + o)
        after_one[t, :k] = np.logaddexp(m[1, 0] + z, m[1, 1] + o)
    inside = (np.arange(width)[:, None] < sizes[None, :])
    sure = np.where(inside, np.exp(np.minimum(one + after_one - total, 0.0)), 0.0)
    truth = labels.T * inside
    by_score = (truth - sure).T
    by_moves = np.zeros((2, 2))
    pairs = inside[1:]
    before, after = (zero, one), (after_zero, after_one + scores.T)
    for a in range(2):
        for b in range(2):
            seen = ((labels.T[:-1] == a) & (labels.T[1:] == b) & pairs).sum()
            by_moves[a, b] = seen - np.exp(np.minimum(before[a][:-1] + m[a, b] + after[b][1:] - total, 0.0))[pairs].sum()
    by_first = np.array([(1 - truth[0] - (1 - sure[0])).sum(), (truth[0] - sure[0]).sum()])
    gap = (truth[end, every] - sure[end, every]).sum()
    own = (truth * scores.T).sum() + chain.first[labels[:, 0]].sum() + chain.last[labels[every, end]].sum() + m[labels[:, :-1], labels[:, 1:]].T[pairs].sum()
    return own - total.sum(), by_score, by_moves, by_first, np.array([-gap, gap])


def fit(items: list[list[list[int]]], labels: list[list[int]], features: int, rounds: int = 250, penalty: float = 1e-4, rate: float = 0.2) -> Chain:
    """A chain fitted to labelled sequences; `items[s][t]` are the features of place t of sequence s.  Sequences may be empty."""
    chain = Chain(np.zeros(features), np.zeros((2, 2)), np.zeros(2), np.zeros(2))
    used = sorted((s for s in range(len(items)) if items[s]), key=lambda s: -len(items[s]))
    if not used:
        return chain
    sizes = np.array([len(items[s]) for s in used])
    width = int(sizes.max())
    truth = np.zeros((len(used), width), np.int64)
    place, feature = [], []
    for r, s in enumerate(used):
        truth[r, : sizes[r]] = labels[s]
        for t, own in enumerate(items[s]):
            place += [r * width + t] * len(own)
            feature += own
    place, feature = np.array(place), np.array(feature)
    parts = [chain.weights, chain.moves, chain.first, chain.last]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        scores = np.bincount(place, chain.weights[feature], len(used) * width).reshape(len(used), width)
        _, by_score, *by_rest = likelihood(chain, scores, truth, sizes)
        slopes = [np.bincount(feature, by_score.ravel()[place], features), *by_rest]
        for i, (part, slope) in enumerate(zip(parts, slopes)):
            slope = slope / len(used) - penalty * part
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope * slope
            part += rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-6)
    return chain
