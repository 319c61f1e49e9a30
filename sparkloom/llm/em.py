"""Expectation-maximisation over votes of labelers, and the classifier trained on its posteriors.

Both read a table of distinct patterns with their counts over all documents. A pattern is a kind and one vote
(1, 0 or -1) per labeler, so there are at most kinds * 3**labelers of them, whatever the corpus.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[int, ...]  # kind, then one vote per labeler


def posteriors(counts: dict[Pattern, float], kinds: int, labelers: int, rounds: int = 1000, trust: float = 0.8) -> dict[Pattern, float]:
    """Probability that a pattern is a true case.

    Each kind has its own share of true cases, each labeler its own rates of votes on true and on false ones.
    The start trusts all labelers alike, with ``trust`` as their accuracy.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    rows = np.array(patterns)
    weight = np.array([counts[p] for p in patterns], float)
    kind, votes = rows[:, 0], rows[:, 1:] + 1
    # the start counts as some observations, so a rate needs evidence to move
    prior_true = np.tile(np.array([1 - trust, 0.5, trust]) * 20, (labelers, 1))
    prior_false = prior_true[:, ::-1]
    share = np.full(kinds, 0.5)
    rate_true, rate_false = (x / x.sum(axis=1, keepdims=True) for x in (prior_true, prior_false))
    true = np.full(len(rows), 0.5)
    for _ in range(rounds):
        odds = np.log(share[kind]) - np.log(1 - share[kind])
        for j in range(labelers):
            odds = odds + np.log(rate_true[j, votes[:, j]]) - np.log(rate_false[j, votes[:, j]])
        fresh = 1 / (1 + np.exp(-odds))
        done = np.abs(fresh - true).max() < 1e-7
        true = fresh
        if done:
            break
        share = (np.bincount(kind, weight * true, kinds) + 1) / (np.bincount(kind, weight, kinds) + 2)
        for j in range(labelers):
            on_true = np.bincount(votes[:, j], weight * true, 3) + prior_true[j]
            on_false = np.bincount(votes[:, j], weight * (1 - true), 3) + prior_false[j]
            rate_true[j], rate_false[j] = on_true / on_true.sum(), on_false / on_false.sum()
    return dict(zip(patterns, true.tolist()))


def features(pattern: Pattern, kinds: int) -> np.ndarray:
    """Kind one-hot, and the votes for and against of each labeler."""
    kind, votes = pattern[0], np.array(pattern[1:])
    return np.concatenate([np.eye(kinds)[kind], votes > 0, votes < 0]).astype(float)


def train(soft: dict[Pattern, float], counts: dict[Pattern, float], kinds: int, rounds: int = 300, decay: float = 0.01) -> np.ndarray:
    """Weights of a logistic classifier that learns the posteriors, each pattern by its count."""
    if not soft:
        return np.zeros(0)
    patterns = sorted(soft)
    x = np.array([features(p, kinds) for p in patterns])
    y = np.array([soft[p] for p in patterns])
    w = np.sqrt(np.array([counts[p] for p in patterns], float))
    w /= w.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (w * (p - y)) + decay * weights * 0.01
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(weights)) * 1e-3
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def score(weights: np.ndarray, pattern: Pattern, kinds: int) -> float:
    return float(1 / (1 + np.exp(-features(pattern, kinds) @ weights)))
