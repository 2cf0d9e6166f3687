"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN, WINDOW = 10, 16, 64
STEPS, BATCH, RATE = 500, 48, 0.02
_NEVER = -1e4
_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789@.-+ ()_%:/,\n[]{}"
#: Class of a character: padding, others, capital letters, then one for each of _CHARS.
CLASSES = 3 + len(_CHARS)
_CLASS = np.full(0x110000, 1, np.uint8)
_CLASS[[ord(c) for c in _CHARS]] = np.arange(3, CLASSES)
_CLASS[65:91] = 2


def classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """tags: 0 is outside; kind k has 1 + 2k for its first character and 2 + 2k for the others."""

    def __init__(self, kinds: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.kinds, self.tags = kinds, 1 + 2 * kinds
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": draw(CLASSES, EMBED) * 2, "out": draw(2 * HIDDEN, self.tags), "out_b": np.zeros(self.tags, np.float32), "trans": np.zeros((self.tags, self.tags), np.float32), "first": np.zeros(self.tags, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": draw(EMBED, 4 * HIDDEN), f"h{side}": draw(HIDDEN, 4 * HIDDEN), f"b{side}": np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)}
        self.barred = np.zeros((self.tags, self.tags), np.float32)
        for k in range(kinds):
            own = [1 + 2 * k, 2 + 2 * k]
            self.barred[[t for t in range(self.tags) if t not in own], 2 + 2 * k] = _NEVER
        self.first_barred = np.where(np.arange(self.tags) % 2 == 0, _NEVER, 0.0).astype(np.float32)
        self.first_barred[0] = 0
        self.first_barred[2::2] = 0  # a window may begin inside a span

    def _side(self, side: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        n, steps = x.shape[:2]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, kept = np.empty((steps, n, HIDDEN), np.float32), []
        into = x @ self.p[f"x{side}"] + self.p[f"b{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = into[:, t] + h @ self.p[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h0 = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            kept.append((t, i, f, o, g, before, tc, h0))
        return out, kept

    def scores(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Emission scores (steps, rows, tags) of windows of character classes."""
        x = self.p["emb"][ids]
        (f, kf), (b, kb) = self._side("f", x), self._side("b", x)
        hidden = np.concatenate([f, b], axis=2)
        return hidden @ self.p["out"] + self.p["out_b"], (ids, x, hidden, kf, kb)

    def _side_back(self, side: str, x: np.ndarray, kept: list, grad: np.ndarray, into: dict) -> np.ndarray:
        n, steps = x.shape[:2]
        dh = dc = np.zeros((n, HIDDEN), np.float32)
        dz_all = np.empty((n, steps, 4 * HIDDEN), np.float32)
        wh = self.p[f"h{side}"].T
        for t, i, f, o, g, before, tc, h0 in reversed(kept):
            dh = dh + grad[t]
            do = dh * tc
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), do * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            dz_all[:, t] = dz
            into[f"h{side}"] += h0.T @ dz
            dh = dz @ wh
            dc = dc * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        into[f"x{side}"] += x.reshape(-1, EMBED).T @ flat
        into[f"b{side}"] += flat.sum(axis=0)
        return dz_all @ self.p[f"x{side}"].T

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """The mean negative log-likelihood and its gradients."""
        scores, (_, x, hidden, kf, kb) = self.scores(ids)
        steps, n, _ = scores.shape
        trans, first = self.p["trans"] + self.barred, self.p["first"] + self.first_barred
        a = np.empty_like(scores)
        a[0] = scores[0] + first
        for t in range(1, steps):
            a[t] = scores[t] + _logsum(a[t - 1][:, :, None] + trans, 1)
        b = np.zeros_like(scores)
        for t in range(steps - 2, -1, -1):
            b[t] = _logsum(trans + (scores[t + 1] + b[t + 1])[:, None, :], 2)
        total = _logsum(a[-1], 1)
        rows = np.arange(n)
        gold = first[tags[:, 0]] + sum(scores[t, rows, tags[:, t]] for t in range(steps)) + sum(trans[tags[:, t - 1], tags[:, t]] for t in range(1, steps))
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        ds = np.exp(a + b - total[:, None])
        for t in range(steps):
            ds[t, rows, tags[:, t]] -= 1
        for t in range(1, steps):
            grad["trans"] += np.exp(a[t - 1][:, :, None] + trans + (scores[t] + b[t])[:, None, :] - total[:, None, None]).sum(axis=0)
            np.add.at(grad["trans"], (tags[:, t - 1], tags[:, t]), -1)
        grad["first"] = ds[0].sum(axis=0)
        grad["out"] = hidden.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, self.tags)
        grad["out_b"] = ds.sum(axis=(0, 1))
        dh = ds @ self.p["out"].T
        dx = self._side_back("f", x, kf, dh[:, :, :HIDDEN], grad) + self._side_back("b", x, kb, dh[:, :, HIDDEN:], grad)
        np.add.at(grad["emb"], ids, dx)
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 11) -> list[float]:
        """Adam over random batches; returns the losses."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        losses = []
        for t in range(1, steps + 1):
            rows = r.integers(0, len(ids), min(BATCH, len(ids)))
            loss, grad = self.step(ids[rows], tags[rows])
            losses.append(loss)
            size = float(np.sqrt(sum((g * g).sum() for g in grad.values())))
            rate = RATE * (1 - t / (steps + 1)) + RATE / 20
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return losses

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The likeliest tags of each window."""
        scores, _ = self.scores(ids)
        steps, n, _ = scores.shape
        trans = self.p["trans"] + self.barred
        best = scores[0] + self.p["first"] + self.first_barred
        back = np.empty((steps, n, self.tags), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + trans
            back[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[t]
        found = np.empty((n, steps), np.int8)
        found[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            found[:, t - 1] = back[t][np.arange(n), found[:, t]]
        return found
