"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by Adam, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

EMBED, HIDDEN = 12, 20


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Tagger:
    """Parameters by name; every input has the same length in a batch, filled up with code 0."""

    codes: int
    tags: int
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 1) -> Tagger:
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        put = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"E": put(self.codes, e) * 3, "O": put(2 * h, self.tags), "o": np.zeros(self.tags, np.float32), "A": np.zeros((self.tags, self.tags), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1  # remember at first
            self.p |= {f"W{d}": put(e, 4 * h), f"U{d}": put(h, 4 * h), f"c{d}": bias}
        return self

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        h = HIDDEN
        n, length, _ = x.shape
        pre = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        out = np.zeros((n, length, h), np.float32)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = pre[:, t] + state @ self.p[f"U{d}"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, last = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, t] = state
            if keep is not None:
                keep.append((t, i, f, o, g, before, squashed, last))
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        x = self.p["E"][codes]
        return np.concatenate([self._lstm(x, "f", None), self._lstm(x, "b", None)], axis=2) @ self.p["O"] + self.p["o"]

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, out: dict) -> np.ndarray:
        h = HIDDEN
        dpre = np.zeros((x.shape[0], x.shape[1], 4 * h), np.float32)
        ds = dc = np.zeros((x.shape[0], h), np.float32)
        dU = np.zeros_like(self.p[f"U{d}"])
        for t, i, f, o, g, before, squashed, last in reversed(kept):
            ds = ds + grad[:, t]
            dc = dc + ds * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            dU += last.T @ dz
            dpre[:, t] = dz
            ds, dc = dz @ self.p[f"U{d}"].T, dc * f
        out[f"U{d}"], out[f"W{d}"] = dU, np.tensordot(x, dpre, ([0, 1], [0, 1]))
        out[f"c{d}"] = dpre.sum(axis=(0, 1))
        return dpre @ self.p[f"W{d}"].T

    def _forward_backward(self, em: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        A, length = self.p["A"], em.shape[1]
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0]
        for t in range(1, length):
            alpha[:, t] = em[:, t] + _logsumexp(alpha[:, t - 1, :, None] + A, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsumexp(A + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        return alpha, beta, _logsumexp(alpha[:, -1], 1)

    def marginals(self, em: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probability of every tag at every place; places from ``sizes`` on are outside."""
        em = em.copy()
        em[np.arange(em.shape[1]) >= sizes[:, None], 1:] = -1e6
        alpha, beta, z = self._forward_backward(em)
        return np.exp(alpha + beta - z[:, None, None])

    def gradient(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss, gradient of it) of tag sequences under the CRF."""
        n, length = codes.shape
        x, kf, kb = self.p["E"][codes], [], []
        hidden = np.concatenate([self._lstm(x, "f", kf), self._lstm(x, "b", kb)], axis=2)
        em, A = hidden @ self.p["O"] + self.p["o"], self.p["A"]
        alpha, beta, z = self._forward_backward(em)
        rows = np.arange(n)
        gold = em[rows[:, None], np.arange(length), tags].sum(axis=1) + A[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_em = np.exp(alpha + beta - z[:, None, None])
        d_em[rows[:, None], np.arange(length), tags] -= 1
        d_em /= n
        joint = alpha[:, :-1, :, None] + A + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        dA = np.exp(joint).sum(axis=(0, 1))
        np.subtract.at(dA, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        out = {"A": dA / n, "O": np.tensordot(hidden, d_em, ([0, 1], [0, 1])), "o": d_em.sum(axis=(0, 1))}
        back = d_em @ self.p["O"].T
        dx = self._lstm_back(x, "f", kf, back[:, :, :HIDDEN], out) + self._lstm_back(x, "b", kb, back[:, :, HIDDEN:], out)
        out["E"] = np.zeros_like(self.p["E"])
        np.add.at(out["E"], codes.ravel(), dx.reshape(-1, EMBED))
        return float((z - gold).mean()), out

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int, batch: int = 32, rate: float = 0.02, seed: int = 2) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        order = np.empty(0, int)
        for step in range(1, steps + 1):
            if not len(order):
                order = rng.permutation(len(codes))
            pick, order = order[:batch], order[batch:]
            _, grad = self.gradient(codes[pick], tags[pick])
            size = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            now = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = (g * min(1.0, 5 / max(size, 1e-9))).astype(np.float32)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                self.p[k] -= (now * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        return self

    def viterbi(self, em: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best tags of each row; positions from ``sizes`` on are 0."""
        n, length, _ = em.shape
        score, back = em[:, 0], np.zeros(em.shape, np.int8)
        final = score.copy()
        for t in range(1, length):
            step = score[:, :, None] + self.p["A"]
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + em[:, t]
            final = np.where((t < sizes)[:, None], score, final)
        tags, now = np.zeros((n, length), np.int8), final.argmax(axis=1)
        for t in range(length - 1, -1, -1):
            live = t < sizes
            tags[:, t] = np.where(live, now, 0)
            if t:
                now = np.where(live, back[np.arange(n), t, now], now)
        return tags
