"""A gated recurrent network with a class-factored softmax, in numpy: windows of truncated backpropagation, and scoring.

Symbols are numbered by falling count and cut into classes of equal size, so p(symbol) = p(class) * p(symbol in class).
Output biases start at the counts' logarithms: the untrained network is a unigram model.
"""

from __future__ import annotations

import numpy as np


class Network:
    def __init__(self, counts: np.ndarray, hidden: int = 16, seed: int = 5):
        """counts: of each symbol, falling."""
        self.symbols, self.hidden = len(counts), hidden
        self.per = int(np.ceil(np.sqrt(len(counts))))
        self.classes = -(-len(counts) // self.per)
        rng = np.random.default_rng(seed)
        h, c, m = hidden, self.classes, self.per
        padded = np.concatenate([counts + 0.5, np.zeros(c * m - len(counts))]).reshape(c, m)
        with np.errstate(divide="ignore"):
            inner = np.maximum(np.log(padded / padded.sum(1, keepdims=True)), -60)
        self.p = {
            "x": rng.normal(0, 0.3, (len(counts), 3 * h)), "u": rng.normal(0, 0.6 / np.sqrt(h), (h, 3 * h)),
            "wc": rng.normal(0, 0.02, (h, c)), "bc": np.log(padded.sum(1) / padded.sum()),
            "wo": rng.normal(0, 0.02, (c, h, m)), "bo": inner,
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step from states h with inputs x: gates and the new states."""
        n = self.hidden
        a, b = self.p["x"][x], h @ self.p["u"]
        gates = 1 / (1 + np.exp(-(a[:, : 2 * n] + b[:, : 2 * n])))
        z, r, hun = gates[:, :n], gates[:, n:], b[:, 2 * n :]
        new = np.tanh(a[:, 2 * n :] + r * hun)
        return z, r, hun, new, new + z * (h - new)

    def predict(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None):
        """log p(y) (natural) from states h; with grads also the loss's gradient by h, and the weights' added to grads."""
        kind, inner = np.divmod(y, self.per)
        logits = h @ self.p["wc"] + self.p["bc"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        total = e.sum(1)
        rows = np.arange(len(y))
        out = logits[rows, kind] - np.log(total)
        dh = None
        if grads is not None:
            e /= total[:, None]
            e[rows, kind] -= 1
            grads["wc"] += h.T @ e
            grads["bc"] += e.sum(0)
            dh = e @ self.p["wc"].T
        order = np.argsort(kind.astype(np.int16), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.classes + 1))
        for k in range(self.classes):
            which = order[ends[k] : ends[k + 1]]
            if not len(which):
                continue
            hk = h[which]
            logits = hk @ self.p["wo"][k] + self.p["bo"][k]
            logits -= logits.max(1, keepdims=True)
            e = np.exp(logits)
            total = e.sum(1)
            at = np.arange(len(which))
            out[which] += logits[at, inner[which]] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[at, inner[which]] -= 1
                grads["wo"][k] += hk.T @ e
                grads["bo"][k] += e.sum(0)
                dh[which] += e @ self.p["wo"][k].T
        return out, dh

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, start: int):
        """Gradients of the mean loss over a window (time, stream) from states h; input `start` begins from nothing."""
        t, b = x.shape
        n, g = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        before, after, parts, keep = np.empty((t, b, n), np.float32), np.empty((t, b, n), np.float32), [], (x != start)[:, :, None]
        for k in range(t):
            h = h * keep[k]
            before[k] = h
            z, r, hun, new, h = self.step(x[k], h)
            parts.append((z, r, hun, new))
            after[k] = h
        logp, d = self.predict(after.reshape(t * b, n), y.reshape(-1), g)
        d = d.reshape(t, b, n)
        du, dx, back = np.empty((t, b, 3 * n), np.float32), np.empty((t, b, 3 * n), np.float32), np.zeros((b, n), np.float32)
        for k in range(t - 1, -1, -1):
            z, r, hun, new = parts[k]
            back = back + d[k]
            dz = back * (before[k] - new) * z * (1 - z)
            dn = back * (1 - z) * (1 - new * new)
            dr = dn * hun * r * (1 - r)
            du[k, :, :n], du[k, :, n : 2 * n], du[k, :, 2 * n :] = dz, dr, dn * r
            dx[k, :, :n], dx[k, :, n : 2 * n], dx[k, :, 2 * n :] = dz, dr, dn
            back = (back * z + du[k] @ self.p["u"].T) * keep[k]
        g["u"] = before.reshape(-1, n).T @ du.reshape(-1, 3 * n)
        seen = x.reshape(-1)
        order = np.argsort(seen.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.diff(seen[order], prepend=-1))
        g["x"][seen[order][first]] = np.add.reduceat(dx.reshape(-1, 3 * n)[order], first)
        for v in g.values():
            v /= t * b
        return g, float(logp.mean()), h


class Trainer:
    """Adam over windows of streams; the state is carried from window to window."""

    def __init__(self, net: Network, start: int, streams: int = 128, steps: int = 24, rate: float = 0.01):
        self.net, self.start, self.streams, self.steps, self.rate = net, start, streams, steps, rate
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.n = 0

    def feed(self, symbols: np.ndarray) -> None:
        """Trains on all of a sequence of documents, each ended by `start`, cut into parallel streams."""
        inputs = np.concatenate([[self.start], symbols[:-1]])
        streams = max(1, min(self.streams, len(symbols) // self.steps))
        length = -(-len(symbols) // streams)
        short = streams * length - len(symbols)  # the last stream is filled up from the beginning
        x = np.concatenate([inputs, np.resize(inputs, short)]).reshape(streams, length).T
        y = np.concatenate([symbols, np.resize(symbols, short)]).reshape(streams, length).T
        h = np.zeros((streams, self.net.hidden), np.float32)
        for a in range(0, length, self.steps):
            g, _, h = self.net.window(x[a : a + self.steps], y[a : a + self.steps], h, self.start)
            self.n += 1
            size = self.rate * np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
            for k, p in self.net.p.items():
                self.m[k] += 0.1 * (g[k] - self.m[k])
                self.v[k] += 0.01 * (g[k] * g[k] - self.v[k])
                p -= size * self.m[k] / (np.sqrt(self.v[k]) + 1e-6)


def score_documents(net: Network, symbols: np.ndarray, begins: np.ndarray, start: int, steps: int = 32) -> np.ndarray:
    """log p (natural) of each document symbols[begins[k]:begins[k + 1]], the last of which is `start`, from its first symbol to its last.

    Documents run side by side, longest first; the state goes on from window to window, so length has no limit."""
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes))
    h = np.zeros((len(sizes), net.hidden), np.float32)
    at, live = 0, len(sizes)
    longest = int(sizes.max()) if len(sizes) else 0
    ahead = -sizes[order]  # rising
    while at < longest:
        states, targets, owners = [], [], []
        for t in range(at, min(at + steps, longest)):
            live = int(np.searchsorted(ahead, -t, "left"))  # those longer than t
            which = begins[order[:live]] + t
            x = symbols[which - 1] if t else np.full(live, start)
            h = net.step(x, h[:live])[4]
            states.append(h)
            targets.append(symbols[which])
            owners.append(order[:live])
        logp, _ = net.predict(np.concatenate(states), np.concatenate(targets))
        out += np.bincount(np.concatenate(owners), logp, len(sizes))
        at += steps
    return out
