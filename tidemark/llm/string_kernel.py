"""Gap-weighted subsequence kernel of short byte strings, in numpy over many pairs at once,
and a linear support vector machine on Nyström features.
"""

from __future__ import annotations

import numpy as np

ORDER, DECAY = 3, np.float32(0.6)
#: Bytes of a string at most; longer words are cut into overlapping parts by the caller.
LENGTH = 32


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Sum over common subsequences of ORDER bytes of DECAY^(span in s + span in t), per pair
    of rows. Rows are padded with 0 (s) and 1 (t), which match nothing."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    total = np.zeros(n, np.float32)
    # prime[i][j]: weights of common subsequences of i bytes that end before s's place, within t[:j]
    prime = [np.ones((lt + 1, n), np.float32)] + [np.zeros((lt + 1, n), np.float32) for _ in range(ORDER - 1)]
    tt = np.ascontiguousarray(t.T)
    for a in range(ls):
        same = (tt == s[:, a]).astype(np.float32) * (DECAY * DECAY)
        total += (same * prime[ORDER - 1][:-1]).sum(0)
        for i in range(ORDER - 1, 0, -1):
            step = same * prime[i - 1][:-1]
            running = np.zeros(n, np.float32)
            for b in range(lt):
                running *= DECAY
                running += step[b]
                prime[i][b + 1] *= DECAY
                prime[i][b + 1] += running
    return total


def letters(x: np.ndarray) -> np.ndarray:
    """Bytes per bin of 5 bits (a letter each, in lower case), padding left out."""
    key = np.arange(len(x))[:, None] * 32 + (x & 31)
    return np.bincount(key[x > 1], minlength=32 * len(x)).astype(np.uint8).reshape(-1, 32)


def neighbours(x: np.ndarray) -> np.ndarray:
    """A set of 1024 bits: ordered pairs of letters at most three letters apart, whatever
    punctuation stands between them."""
    letter = (x >= 97) & (x <= 122) | (x >= 128) | (x >= 48) & (x <= 57)
    packed = np.take_along_axis(np.where(letter, x, 0), np.argsort(~letter, axis=1, kind="stable"), 1).astype(np.int64)
    bits = np.zeros((len(x), 1024), bool)
    for gap in (1, 2, 3):
        a, b = packed[:, :-gap], packed[:, gap:]
        i, j = np.nonzero((a > 0) & (b > 0))
        bits[i, (a[i, j] & 31) * 32 + (b[i, j] & 31)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


class KernelMachine:
    """sign(w . phi(s) + b) with phi(s) = M^(-1/2) k(s, landmarks), k the square of the normalised kernel.

    A kernel value is computed only where the string has at least `SHARED` of the landmark's
    letters and `NEAR` of its pairs of neighbouring letters and is not over `LONGER` times as
    long and 4 bytes; else it counts as 0, in training as in scoring."""

    SHARED, NEAR, LONGER = 0.7, 0.4, 2.0

    def __init__(self, landmarks: np.ndarray):
        self.z = landmarks
        self.zt = np.where(landmarks == 0, 1, landmarks).astype(np.uint8)
        self.z_letters = letters(landmarks)
        self.z_size = np.maximum((landmarks > 1).sum(1), 1)
        self.z_near = neighbours(landmarks)
        self.z_pairs = np.maximum(np.bitwise_count(self.z_near).sum(1), 1)
        self.z_self = np.maximum(kernel(self.z, self.zt), 1e-12)
        m = self.features(landmarks, raw=True)
        m = (m + m.T) / 2
        e, v = np.linalg.eigh(m.astype(np.float64))
        self.root = ((v / np.sqrt(np.maximum(e, 1e-3))) @ v.T).astype(np.float32)
        self.w, self.b = np.zeros(len(landmarks), np.float32), np.float32(-1)

    def features(self, x: np.ndarray, raw: bool = False) -> np.ndarray:
        out = np.zeros((len(x), len(self.z)), np.float32)
        size = (x > 1).sum(1)
        order = np.argsort(size, kind="stable")
        for a in range(0, len(x), 4096):  # of similar length, so that little is padding
            rows = order[a : a + 4096]
            out[rows] = self._features(x[rows, : max(3, int(size[rows].max()))], size[rows])
        return out if raw else out @ self.root

    def _features(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        own = letters(x)
        k = np.zeros((len(x), len(self.z)), np.float32)
        shared = np.zeros((len(x), len(self.z)), np.uint8)
        least = np.empty_like(shared)
        for bin_ in range(32):
            if own[:, bin_].any() and self.z_letters[:, bin_].any():
                np.minimum(own[:, bin_, None], self.z_letters[None, :, bin_], out=least)
                shared += least
        i, j = np.nonzero(shared >= (self.SHARED * self.z_size)[None, :])
        fits = size[i] <= self.LONGER * self.z_size[j] + 4
        i, j = i[fits], j[fits]
        if len(i):
            rows, at = np.unique(i, return_inverse=True)
            near = neighbours(x[rows])
            live = np.bitwise_count(near[at] & self.z_near[j]).sum(1) >= self.NEAR * self.z_pairs[j]
            i, j = i[live], j[live]
        if len(i):
            rows, at = np.unique(i, return_inverse=True)
            part = x[rows]
            own_k = kernel(part, np.where(part == 0, 1, part).astype(np.uint8))[at]
            for a in range(0, len(i), 20_000):
                p, q = i[a : a + 20_000], j[a : a + 20_000]
                z = self.zt[q, : int(self.z_size[q].max())]
                k[p, q] = kernel(x[p], z) / np.sqrt(np.maximum(own_k[a : a + 20_000] * self.z_self[q], 1e-12))
        k *= k  # a kernel again, and a more local one
        return k

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, c: float = 10.0, rounds: int = 60, seed: int = 0) -> None:
        """Hinge loss by dual coordinate descent; y is 1 or -1, weight scales c per row."""
        phi = np.c_[self.features(x), np.ones(len(x), np.float32)].astype(np.float64)
        alpha, w = np.zeros(len(x)), np.zeros(phi.shape[1])
        norm = (phi * phi).sum(1)
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for i in rng.permutation(len(x)):
                old = alpha[i]
                alpha[i] = min(max(old - (y[i] * (w @ phi[i]) - 1) / norm[i], 0.0), c * weight[i])
                if alpha[i] != old:
                    w += (alpha[i] - old) * y[i] * phi[i]
        self.w, self.b = w[:-1].astype(np.float32), np.float32(w[-1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.w + self.b
