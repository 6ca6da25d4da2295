"""A bidirectional LSTM over characters with a CRF on top, in numpy: training by Adam, decoding by Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

NEVER = -1e4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """``forbidden`` marks transitions (from, to) that never happen; ``barred`` tags open no sequence."""

    weights: dict[str, np.ndarray]
    forbidden: np.ndarray
    barred: np.ndarray

    @classmethod
    def fresh(cls, symbols: int, tags: int, width: int, hidden: int, forbidden: np.ndarray, barred: np.ndarray, seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        w = {"embed": draw(symbols, width) * 3, "out": draw(2 * hidden, tags), "out_b": np.zeros(tags, np.float32), "next": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
        for side in "fb":
            w[f"x{side}"], w[f"h{side}"] = draw(width, 4 * hidden), draw(hidden, 4 * hidden)
            w[f"b{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        return cls(w, forbidden, barred)

    def _steps(self, chars: np.ndarray, side: str, keep: bool):
        """Hidden states of one direction over ``chars`` (time, batch); with what the way back needs if ``keep``."""
        w = self.weights
        n = w[f"h{side}"].shape[0]
        table = w["embed"] @ w[f"x{side}"] + w[f"b{side}"]
        h, c = (np.zeros((chars.shape[1], n), np.float32) for _ in range(2))
        out, saved = np.empty((*chars.shape, n), np.float32), {}
        for t in range(len(chars)) if side == "f" else range(len(chars) - 1, -1, -1):
            z = table[chars[t]] + h @ w[f"h{side}"]
            gates = _sigmoid(z[:, : 3 * n])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            before = h, c
            c = f * c + i * g
            tanh = np.tanh(c)
            h = o * tanh
            out[t] = h
            if keep:
                saved[t] = (i, f, o, g, tanh, *before)
        return out, saved

    def emissions(self, chars: np.ndarray, keep: bool = False):
        ahead, saved_f = self._steps(chars, "f", keep)
        back, saved_b = self._steps(chars, "b", keep)
        both = np.concatenate([ahead, back], 2)
        return both @ self.weights["out"] + self.weights["out_b"], (both, saved_f, saved_b)

    def _scores(self):
        return np.where(self.forbidden, NEVER, self.weights["next"]), np.where(self.barred, NEVER, self.weights["first"])

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best tag sequences of ``chars`` (time, batch)."""
        scores, _ = self.emissions(chars)
        step, first = self._scores()
        best, ways = scores[0] + first, []
        for t in range(1, len(scores)):
            each = best[:, :, None] + step
            ways.append(each.argmax(1))
            best = each.max(1) + scores[t]
        tags = np.empty(chars.shape, np.int8)
        tags[-1] = at = best.argmax(1)
        for t in range(len(scores) - 2, -1, -1):
            tags[t] = at = np.take_along_axis(ways[t], at[:, None], 1)[:, 0]
        return tags

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradient."""
        scores, (both, saved_f, saved_b) = self.emissions(chars, True)
        step, first = self._scores()
        length, batch, n = scores.shape
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + first
        for t in range(1, length):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + step, 1) + scores[t]
        for t in range(length - 2, -1, -1):
            back[t] = _log_sum(step + (scores[t + 1] + back[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        gold = np.take_along_axis(scores, tags[:, :, None], 2).sum((0, 2)) + first[tags[0]] + step[tags[:-1], tags[1:]].sum(0)
        d_scores = np.exp(ahead + back - total[:, None]) / batch
        grad = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for t in range(1, length):
            pair = np.exp(ahead[t - 1][:, :, None] + step + (scores[t] + back[t])[:, None, :] - total[:, None, None]) / batch
            grad["next"] += pair.sum(0)
        np.add.at(grad["next"], (tags[:-1], tags[1:]), -1 / batch)
        grad["next"][self.forbidden] = 0
        grad["first"] = d_scores[0].sum(0)
        np.add.at(grad["first"], tags[0], -1 / batch)
        grad["first"][self.barred] = 0
        np.put_along_axis(d_scores, tags[:, :, None], np.take_along_axis(d_scores, tags[:, :, None], 2) - 1 / batch, 2)
        flat = d_scores.reshape(-1, n)
        grad["out"], grad["out_b"] = both.reshape(len(flat), -1).T @ flat, flat.sum(0)
        d_both = d_scores @ self.weights["out"].T
        half = both.shape[2] // 2
        self._back(chars, "f", saved_f, d_both[:, :, :half], grad)
        self._back(chars, "b", saved_b, d_both[:, :, half:], grad)
        return float((total - gold).mean()), grad

    def _back(self, chars, side, saved, d_out, grad):
        w, n = self.weights, d_out.shape[2]
        dh, dc = (np.zeros(d_out.shape[1:], np.float32) for _ in range(2))
        d_table = np.zeros((len(w["embed"]), 4 * n), np.float32)
        one_hot = np.eye(len(d_table), dtype=np.float32)
        for t in range(len(chars) - 1, -1, -1) if side == "f" else range(len(chars)):
            i, f, o, g, tanh, h, c = saved[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - tanh**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g**2)], 1)
            d_table += one_hot[chars[t]].T @ dz
            grad[f"h{side}"] += h.T @ dz
            dh, dc = dz @ w[f"h{side}"].T, dc * f
        grad[f"x{side}"] += w["embed"].T @ d_table
        grad[f"b{side}"] += d_table.sum(0)
        grad["embed"] += d_table @ w[f"x{side}"].T

    def train(self, chars: np.ndarray, tags: np.ndarray, steps: int, size: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam over ``steps`` shuffled batches of (batch, time) arrays, at a rate that falls to nought; their losses."""
        rng, t, history = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(x) for k, x in self.weights.items()} for _ in range(2))
        while t < steps:
            order = rng.permutation(len(chars))
            for k in range(0, min(len(order), size * (steps - t)), size):
                some = order[k : k + size]
                loss, grad = self.loss(chars[some].T, tags[some].T.astype(np.int64))
                history.append(loss)
                t += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                for name, g in grad.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g**2
                    self.weights[name] -= (rate * (1 - (t - 1) / steps) * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return history
