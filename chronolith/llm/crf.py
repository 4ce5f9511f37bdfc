"""Linear-chain conditional random fields over many sequences at once, in numpy.

Sequences lie one after another in the rows of an emission matrix. They are taken in order of length, so step t
works on one block of rows for all that are longer than t; a pass costs one small matrix product for each step
of the longest sequence, and no padding.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Where step t of each sequence lies, longest sequence first."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.start = start[self.order]
        self.length = lengths[self.order]
        self.steps = int(lengths.max(initial=0))
        # active[t]: sequences longer than t
        self.active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(self.steps), side="right") if self.steps else np.zeros(0, np.int64)

    def rows(self, t: int) -> np.ndarray:
        return self.start[: self.active[t]] + t


def forward_backward(emission: np.ndarray, trans: np.ndarray, first: np.ndarray, lengths: np.ndarray, *, pairs: bool = False):
    """Marginals of every row; with pairs also the summed marginals of label pairs, those of first labels, and the log partition sum."""
    lay = Layout(lengths)
    top = emission.max(axis=1, keepdims=True) if len(emission) else np.zeros((0, 1), emission.dtype)
    em = np.exp(emission - top)
    m, f0 = np.exp(trans).astype(em.dtype), np.exp(first).astype(em.dtype)
    alpha, scale = np.empty_like(em), np.empty(len(em), em.dtype)
    prev = None
    for t in range(lay.steps):
        rows = lay.rows(t)
        cur = (f0 if t == 0 else prev[: len(rows)] @ m) * em[rows]
        z = cur.sum(axis=1)
        cur /= z[:, None]
        alpha[rows], scale[rows], prev = cur, z, cur
    gamma = np.empty_like(em)
    xi = np.zeros(trans.shape)
    beta = None
    for t in range(lay.steps - 1, -1, -1):
        rows = lay.rows(t)
        b = np.ones((len(rows), em.shape[1]), em.dtype)
        if beta is not None:
            k = len(beta)
            nxt = lay.rows(t + 1)
            out = em[nxt] * beta / scale[nxt][:, None]
            if pairs:
                xi += (alpha[rows[:k]].T @ out) * m
            b[:k] = out @ m.T
        gamma[rows], beta = alpha[rows] * b, b
    gamma /= gamma.sum(axis=1, keepdims=True)
    if not pairs:
        return gamma
    return gamma, xi, gamma[lay.rows(0)].sum(axis=0) if lay.steps else 0, float(np.log(scale).sum() + top.sum())


def marginals(emission: np.ndarray, trans: np.ndarray, first: np.ndarray, lengths: np.ndarray, *, part: int = 64) -> np.ndarray:
    """The marginals of forward_backward(), for which a long sequence takes no more steps than a short one: sequences
    are cut into parts, all parts are passed at once. A part's transfer matrix (from the label before it to its last)
    carries the forward and backward vectors over it, so the result is that of the whole sequence."""
    lengths = np.asarray(lengths, dtype=np.int64)
    n, k = emission.shape
    em = np.exp(emission - emission.max(axis=1, keepdims=True)) if n else emission
    m, f0 = np.exp(trans).astype(em.dtype), np.exp(first).astype(em.dtype)
    n_parts = -(-lengths // part)
    sequences = Layout(n_parts)
    within = np.arange(int(n_parts.sum())) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    lay = Layout(np.minimum(part, np.repeat(lengths, n_parts) - within * part))
    begins = (within == 0)[lay.order][:, None]

    over = np.empty((len(within), k, k), em.dtype)
    for t in range(lay.steps):
        rows = lay.rows(t)
        cur = np.where(begins[:, :, None], f0, m) if t == 0 else (over[: len(rows)].reshape(-1, k) @ m).reshape(-1, k, k)
        cur *= em[rows][:, None, :]
        over[: len(rows)] = cur / cur.sum(axis=(1, 2), keepdims=True)
    own = np.empty_like(over)
    own[lay.order] = over
    before, after = np.full((len(within), k), 1 / k, em.dtype), np.ones((len(within), k), em.dtype)
    for i in range(1, sequences.steps):
        at = sequences.rows(i)
        x = np.einsum("pi,pij->pj", before[at - 1], own[at - 1])
        before[at] = x / x.sum(axis=1, keepdims=True)
    for i in range(sequences.steps - 1, 0, -1):
        at = sequences.rows(i)
        x = np.einsum("pij,pj->pi", own[at], after[at])
        after[at - 1] = x / x.sum(axis=1, keepdims=True)

    gamma, prev = np.empty_like(em), before[lay.order]
    for t in range(lay.steps):
        rows = lay.rows(t)
        cur = prev[: len(rows)] @ m
        if t == 0:
            cur = np.where(begins, f0, cur)
        cur *= em[rows]
        cur /= cur.sum(axis=1, keepdims=True)
        gamma[rows], prev = cur, cur
    beta = after[lay.order]
    for t in range(lay.steps - 1, -1, -1):
        rows = lay.rows(t)
        b = beta[: len(rows)]
        out = (em[rows] * b) @ m.T
        gamma[rows] *= b
        beta[: len(rows)] = out / out.sum(axis=1, keepdims=True)
    gamma /= gamma.sum(axis=1, keepdims=True)
    return gamma


def viterbi(emission: np.ndarray, trans: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of every row; of equals the lowest label."""
    lay = Layout(lengths)
    back = np.zeros(emission.shape, np.int16)
    best = np.zeros(len(emission), np.int64)
    score = np.empty((len(lay.order), emission.shape[1]), emission.dtype)
    for t in range(lay.steps):
        rows = lay.rows(t)
        if t == 0:
            score[:] = 0
            score[: len(rows)] = first + emission[rows]
            continue
        every = score[: len(rows), :, None] + trans
        back[rows] = every.argmax(axis=1)
        score[: len(rows)] = every.max(axis=1) + emission[rows]
    label = None
    for t in range(lay.steps - 1, -1, -1):
        rows = lay.rows(t)
        now = score[: len(rows)].argmax(axis=1)
        if label is not None:
            k = len(label)
            now[:k] = back[lay.rows(t + 1), label]
        best[rows], label = now, now
    return best


def train(features: list[np.ndarray], labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, *, epochs: int = 6, batch: int = 64, rate: float = 0.3, l2: float = 1e-6, seed: int = 7):
    """(weights, trans, first) that raise the conditional log-likelihood, by AdaGrad over batches of sequences.

    features: the feature numbers of each row, a fixed set of rows in all. The same input gives the same model.
    """
    rng = np.random.default_rng(seed)
    w, tr, fi = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    gw, gt, gf = np.full(w.shape, 1e-2), np.full(tr.shape, 1e-2), np.full(fi.shape, 1e-2)
    lengths = np.asarray(lengths)
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for _ in range(epochs):
        order = rng.permutation(len(lengths))
        for i in range(0, len(order), batch):
            seqs = order[i : i + batch]
            rows = np.concatenate([np.arange(start[s], start[s] + lengths[s]) for s in seqs])
            sizes = np.fromiter((len(features[r]) for r in rows), np.int64, len(rows))
            flat, owner = np.concatenate([features[r] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
            em = np.zeros((len(rows), n_labels))
            for k in range(n_labels):
                em[:, k] = np.bincount(owner, w[flat, k], len(rows))
            gamma, xi, begin, _ = forward_backward(em, tr, fi, lengths[seqs], pairs=True)
            y = labels[rows]
            diff = -gamma
            diff[np.arange(len(rows)), y] += 1
            ends = np.cumsum(lengths[seqs])
            starts = ends - lengths[seqs]
            inner = np.ones(len(rows), bool)
            inner[starts] = False
            at = np.flatnonzero(inner)
            dt = -xi
            np.add.at(dt, (y[at - 1], y[at]), 1)
            df = np.bincount(y[starts], minlength=n_labels) - begin
            used, where = np.unique(flat, return_inverse=True)
            dw = np.stack([np.bincount(where, diff[owner, k], len(used)) for k in range(n_labels)], axis=1) / len(seqs)
            dw -= l2 * w[used]
            gw[used] += dw * dw
            w[used] += rate * dw / np.sqrt(gw[used])
            for p, g, d in ((tr, gt, dt / len(seqs)), (fi, gf, df / len(seqs))):
                g += d * d
                p += rate * d / np.sqrt(g)
    return w, tr, fi
