"""A linear-chain conditional random field over two line labels, good and bad.

The chain's state is the log-odds of good against bad, so forward and backward steps
are one vector operation over all documents that still have a line at that place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    weights: np.ndarray  # of a line's features, for good
    moves: np.ndarray  # 2 x 2, from label to label
    slope: float = 1.0  # of the document's score over its log-odds
    level: float = 0.0


def _log_ratio(up: float, down: float, x: np.ndarray, on_up: float, on_down: float) -> np.ndarray:
    """log((e^up + e^(x + on_up)) / (e^down + e^(x + on_down)))."""
    return np.logaddexp(up, x + on_up) - np.logaddexp(down, x + on_down)


def forward_backward(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages from the left (with the line's own score) and from the right, as log-odds."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    left, right = unary.astype(np.float64).copy(), np.zeros(len(unary))
    longest = int(lengths[0]) if len(lengths) else 0
    for t in range(1, longest):
        at = starts[: np.searchsorted(-lengths, -t)] + t  # chains longer than t
        left[at] = unary[at] + _log_ratio(moves[0, 1], moves[0, 0], left[at - 1], moves[1, 1], moves[1, 0])
    for t in range(longest - 1, 0, -1):
        at = starts[: np.searchsorted(-lengths, -t)] + t
        right[at - 1] = _log_ratio(moves[1, 0], moves[0, 0], unary[at] + right[at], moves[1, 1], moves[0, 1])
    return left, right


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -700, 700)))


def marginals(chain: Chain, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The probability of good for every line."""
    left, right = forward_backward(rows @ chain.weights, counts, chain.moves)
    return sigmoid(left + right)


def quality(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Marginals averaged by line length, for every document."""
    weight = np.maximum(1, size).astype(np.float64)
    begin = np.cumsum(counts) - counts
    return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin) if len(counts) else np.zeros(0)


def _odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def scores(chain: Chain, rows: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    share = quality(marginals(chain, rows, counts), size, counts)
    return sigmoid(chain.slope * _odds(share) + chain.level)


def _fit_chain(chain: Chain, rows: np.ndarray, counts: np.ndarray, good: np.ndarray, weight: np.ndarray, steps: int) -> Chain:
    """Adam on the likelihood of the line labels, ``weight`` per line, with a little shrinkage."""
    x = rows.astype(np.float64)
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - counts] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (good[here - 1].astype(int), good[here].astype(int)), weight[here])
    theta = np.concatenate((chain.weights, chain.moves.ravel()))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = weight.sum()
    for step in range(1, steps + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        unary = x @ w
        left, right = forward_backward(unary, counts, moves)
        p = sigmoid(left + right)
        a, b = left[here - 1], unary[here] + right[here]
        joint = np.stack([np.full(len(here), moves[0, 0]), moves[0, 1] + b, moves[1, 0] + a, moves[1, 1] + a + b], axis=1)
        joint -= joint.max(axis=1, keepdims=True) if len(here) else 0
        joint = np.exp(joint)
        joint /= joint.sum(axis=1, keepdims=True)
        expected = (joint * weight[here, None]).sum(axis=0).reshape(2, 2)
        gradient = np.concatenate((x.T @ (weight * (good - p)), (seen - expected).ravel())) / total - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Chain(theta[:-4], theta[-4:].reshape(2, 2))


def fit(rows: np.ndarray, size: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 3, steps: int = 120) -> Chain:
    """Learn from document labels.

    Lines start with their document's label. In later rounds the lines of a bad
    document that look good to the chain become good, all but its worst. Both labels
    weigh the same, and long documents no more than the square root of their lines.
    Last, the documents' scores are calibrated. One label only, or none: every score
    is that label's share, shrunk towards one half.
    """
    chain = Chain(np.zeros(rows.shape[1]), np.zeros((2, 2)))
    share = (label.sum() + 1) / (len(label) + 2)
    if len(set(label.tolist())) < 2:
        return Chain(chain.weights, chain.moves, 0.0, float(np.log(share / (1 - share))))
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = 1 / np.sqrt(counts[doc])
    side = label[doc]
    for y in (0, 1):
        weight[side == y] /= weight[side == y].sum()
    weight *= len(weight) / 2
    good = side.astype(np.float64)
    for turn in range(rounds):
        chain = _fit_chain(chain, rows, counts, good, weight, steps)
        if turn + 1 < rounds:
            p = marginals(chain, rows, counts)
            worst = np.full(len(counts), np.inf)
            np.minimum.at(worst, doc, p)
            good = np.where(side == 1, 1.0, ((p > 0.5) & (p > worst[doc])).astype(np.float64))
    odds = _odds(quality(marginals(chain, rows, counts), size, counts))
    slope, level = 1.0, 0.0
    for _ in range(200):  # Newton steps of a one-column logistic regression
        p = sigmoid(slope * odds + level)
        w, r = p * (1 - p) + 1e-9, label - p
        a, b, c = (w * odds * odds).sum() + 1e-2, (w * odds).sum(), w.sum() + 1e-2
        g, h = (r * odds).sum() - 1e-2 * slope, r.sum()
        d = a * c - b * b
        slope, level = slope + 0.5 * (c * g - b * h) / d, level + 0.5 * (a * h - b * g) / d
    return Chain(chain.weights, chain.moves, float(slope), float(level))
