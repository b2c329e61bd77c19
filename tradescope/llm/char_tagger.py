"""A character tagger in numpy: bidirectional LSTM, with a CRF over the tag transitions.

It works on batches of windows of one length.  Tags are 0 for outside and, for every kind
k, 1 + 2k for a span's first and 2 + 2k for its further characters.
"""

from __future__ import annotations

import numpy as np

# Characters: ASCII as it is but for digits, which are all one, other letters, everything
# else, and padding behind a text.
LETTER, OTHER, PAD = 128, 129, 130
_CODE = {chr(i): ord("0") if chr(i).isdigit() else i for i in range(128)}
CHARACTERS = 131
_NEVER = -1e4


def codes(text: str, length: int) -> np.ndarray:
    """The characters of a window as numbers, padded to ``length``."""
    found = [_CODE[c] if c in _CODE else LETTER if c.isalpha() else OTHER for c in text[:length]]
    return np.array(found + [PAD] * (length - len(found)), np.int64)


def allowed(kinds: int) -> np.ndarray:
    """0 where a tag may follow a tag, a very small number elsewhere; the last row is the beginning."""
    tags = 1 + 2 * kinds
    table = np.zeros((tags + 1, tags))
    for k in range(kinds):
        inner = 2 + 2 * k
        table[:, inner] = _NEVER
        table[[inner - 1, inner], inner] = 0
    return table


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of every step of ``x`` (batch, steps, width), and what the way back needs."""
    n, steps, _ = x.shape
    size = u.shape[0]
    given = x @ w + b
    h, c, out, kept = np.zeros((n, size)), np.zeros((n, size)), np.empty((n, steps, size)), []
    for t in range(steps):
        z = given[:, t] + h @ u
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        before, earlier = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        kept.append((i, f, o, g, before, earlier, tc))
    return out, kept


def _lstm_back(slope: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, ...]:
    """Gradients of (x, w, u, b) from those of the hidden states."""
    n, steps, size = slope.shape
    dz = np.empty((n, steps, 4 * size))
    dh, dc, du = np.zeros((n, size)), np.zeros((n, size)), np.zeros_like(u)
    for t in reversed(range(steps)):
        i, f, o, g, before, earlier, tc = kept[t]
        dh = dh + slope[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz[:, t] = np.concatenate(
            [dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1
        )
        du += earlier.T @ dz[:, t]
        dh, dc = dz[:, t] @ u.T, dc * f
    flat = dz.reshape(-1, 4 * size)
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


class Tagger:
    """The weights, and what is computed from them."""

    def __init__(self, kinds: int, width: int = 12, hidden: int = 16, seed: int = 5) -> None:
        draw = np.random.default_rng(seed)
        tags = 1 + 2 * kinds
        self.allowed = allowed(kinds)
        self.weights = {"embed": draw.normal(0, 0.5, (CHARACTERS, width)), "move": np.zeros((tags + 1, tags))}
        for side in ("l", "r"):
            self.weights["w" + side] = draw.normal(0, width**-0.5, (width, 4 * hidden))
            self.weights["u" + side] = draw.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            self.weights["b" + side] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
        self.weights["out"] = draw.normal(0, (2 * hidden) ** -0.5, (2 * hidden, tags))
        self.weights["bias"] = np.zeros(tags)

    def _scores(self, chars: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores of every character before the transitions, and what the way back needs."""
        p = self.weights
        x = p["embed"][chars]
        left, kept_l = _lstm(x, p["wl"], p["ul"], p["bl"])
        right, kept_r = _lstm(x[:, ::-1], p["wr"], p["ur"], p["br"])
        both = np.concatenate([left, right[:, ::-1]], axis=2)
        return both @ p["out"] + p["bias"], (x, both, kept_l, kept_r)

    def _moves(self) -> tuple[np.ndarray, np.ndarray]:
        move = self.weights["move"] + self.allowed
        return move[:-1], move[-1]

    def _chances(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log of the forward and backward sums, and of the whole."""
        move, begin = self._moves()
        steps = scores.shape[1]
        ahead, behind = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = begin + scores[:, 0]
        for t in range(1, steps):
            ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + move, 1) + scores[:, t]
        for t in range(steps - 2, -1, -1):
            behind[:, t] = _log_sum(move + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        return ahead, behind, _log_sum(ahead[:, -1], 1)

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags of a batch of windows, and its gradients."""
        p, n = self.weights, len(chars)
        scores, (x, both, kept_l, kept_r) = self._scores(chars)
        move, begin = self._moves()
        ahead, behind, whole = self._chances(scores)
        row, step = np.arange(n)[:, None], np.arange(chars.shape[1])
        path = begin[tags[:, 0]] + scores[row, step, tags].sum(axis=1) + move[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        slope = np.exp(ahead + behind - whole[:, None, None])
        first = slope[:, 0].sum(axis=0)
        pairs = sum(
            np.exp(
                ahead[:, t - 1, :, None] + move + (scores[:, t] + behind[:, t])[:, None, :] - whole[:, None, None]
            ).sum(axis=0)
            for t in range(1, chars.shape[1])
        )
        slope[row, step, tags] -= 1
        grads = {"move": np.vstack([pairs, first])}
        np.subtract.at(grads["move"], (tags[:, :-1], tags[:, 1:]), 1)
        np.subtract.at(grads["move"][-1], tags[:, 0], 1)
        grads["out"] = both.reshape(-1, both.shape[2]).T @ slope.reshape(-1, slope.shape[2])
        grads["bias"] = slope.sum(axis=(0, 1))
        back = slope @ p["out"].T
        size = both.shape[2] // 2
        dx, grads["wl"], grads["ul"], grads["bl"] = _lstm_back(back[:, :, :size], x, p["wl"], p["ul"], kept_l)
        mirrored = x[:, ::-1]
        dr, grads["wr"], grads["ur"], grads["br"] = _lstm_back(back[:, ::-1, size:], mirrored, p["wr"], p["ur"], kept_r)
        grads["embed"] = np.zeros_like(p["embed"])
        np.add.at(grads["embed"], chars, dx + dr[:, ::-1])
        return float((whole - path).mean()), {k: g / n for k, g in grads.items()}

    def train(self, chars: np.ndarray, tags: np.ndarray, steps: int, batch: int = 32, rate: float = 0.03) -> None:
        """``steps`` steps of Adam over batches in a fixed random order."""
        draw = np.random.default_rng(9)
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            at = draw.integers(0, len(chars), min(batch, len(chars)))
            _, grads = self.loss(chars[at], tags[at])
            for k, g in grads.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
                self.weights[k] -= rate * (1 - step / (steps + 1)) * move

    def decode(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest tags of every window (Viterbi), and the probability of each tag chosen."""
        scores, _ = self._scores(chars)
        move, begin = self._moves()
        n, steps, width = scores.shape
        best, came = begin + scores[:, 0], np.zeros((n, steps, width), np.int8)
        for t in range(1, steps):
            ways = best[:, :, None] + move
            came[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
        ahead, behind, whole = self._chances(scores)
        row, step = np.arange(n)[:, None], np.arange(steps)
        return tags, np.exp(ahead[row, step, tags] + behind[row, step, tags] - whole[:, None])
