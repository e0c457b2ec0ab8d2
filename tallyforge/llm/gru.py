"""A gated recurrent word model in numpy with a class-factored softmax.

Inputs are word ids (0: end of document) or, for words outside the vocabulary, bucket ids.
Outputs are classes: `words / SIZE` classes of frequent words, each with a softmax of its
own, and one class for each bucket, whose words are told apart by counts elsewhere.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

F32 = np.float32


def _sig(x: np.ndarray) -> np.ndarray:
    np.multiply(x, F32(0.5), out=x)
    np.tanh(x, out=x)
    x += 1
    x *= F32(0.5)
    return x


def _log_share(mass: np.ndarray) -> np.ndarray:
    """Logarithms of what each column has of its row."""
    return np.log((mass + 0.5) / (mass + 0.5).sum(1, keepdims=True)).astype(F32)


class Gru:
    SIZE = 64

    def __init__(self, word_mass: np.ndarray, bucket_mass: np.ndarray, hidden: int = 16, embed: int = 16, seed: int = 5):
        """Masses: training counts of the words (by id) and buckets, for the output biases."""
        rng = np.random.default_rng(seed)
        self.words, self.buckets, self.hidden = len(word_mass), len(bucket_mass), hidden
        self.classes = -(-self.words // self.SIZE)
        pad = np.zeros(self.classes * self.SIZE)
        pad[: self.words] = word_mass
        pad = pad.reshape(self.classes, self.SIZE)
        real = np.arange(self.classes * self.SIZE).reshape(self.classes, -1) < self.words
        g = lambda *s, k=0.1: rng.standard_normal(s) * k
        start = {
            "emb": g(self.words + self.buckets, embed, k=0.3), "wx": g(embed, 3 * hidden, k=1 / math.sqrt(embed)), "bx": np.zeros(3 * hidden),
            "u": g(hidden, 3 * hidden, k=1 / math.sqrt(hidden)), "bn": np.zeros(hidden),
            "wc": g(hidden, self.classes + self.buckets, k=0.02), "bc": _log_share(np.concatenate([pad.sum(1), bucket_mass])[None])[0],
            "wo": g(self.classes, hidden, self.SIZE, k=0.02), "bo": np.where(real, _log_share(pad), -30),
        }
        self.shapes = {k: v.shape for k, v in start.items()}
        self.load(np.concatenate([v.ravel() for v in start.values()]).astype(F32))

    def load(self, flat: np.ndarray) -> None:
        """Takes all weights from one vector; p has them by name, as parts of it."""
        self.flat, self.p = flat, self.parts(flat)

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, shape in self.shapes.items():
            out[k] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def _step(self, xg: np.ndarray, h: np.ndarray) -> tuple:
        k = self.hidden
        hg = h @ self.p["u"]
        zr = _sig(xg[:, : 2 * k] + hg[:, : 2 * k])
        z, r = zr[:, :k], zr[:, k:]
        c = hg[:, 2 * k :] + self.p["bn"]
        n = np.tanh(xg[:, 2 * k :] + r * c)
        return n + z * (h - n), z, r, n, c

    def _heads(self, hs: np.ndarray, target: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of targets at states hs, and the gradient at hs.

        Biases start at log-probabilities, so logits stay small: their maxima needn't be taken off.
        """
        p = self.p
        word = target < self.words
        cls = np.where(word, target // self.SIZE, target - self.words + self.classes)
        out, d = np.empty(len(hs), F32), None if grads is None else np.empty_like(hs)
        ones = np.ones(p["wc"].shape[1], F32)
        for lo in range(0, len(hs), 512):  # what fits a processor's cache
            h, own = hs[lo : lo + 512], cls[lo : lo + 512]
            rows = np.arange(len(h))
            a = h @ p["wc"]
            a += p["bc"]
            mine = a[rows, own]
            np.exp(a, out=a)
            s = a @ ones
            out[lo : lo + 512] = mine - np.log(s)
            if grads is not None:
                a *= (1 / s)[:, None]
                a[rows, own] -= 1
                grads["wc"] += h.T @ a
                grads["bc"] += a.sum(0)
                np.matmul(a, p["wc"].T, out=d[lo : lo + 512])
        at = np.flatnonzero(word)
        at = at[np.argsort(cls[at], kind="stable")]
        edges = np.searchsorted(cls[at], np.arange(self.classes + 1))
        sorted_h, sorted_t = hs[at], target[at] % self.SIZE
        inner, back = np.empty(len(at), F32), None if grads is None else np.empty_like(sorted_h)
        for c in np.flatnonzero(np.diff(edges)):
            i = slice(edges[c], edges[c + 1])
            h, t = sorted_h[i], sorted_t[i]
            b = h @ p["wo"][c]
            b += p["bo"][c]
            k = np.arange(len(h))
            own = b[k, t]
            np.exp(b, out=b)
            s = b.sum(1)
            inner[i] = own - np.log(s)
            if grads is not None:
                b *= (1 / s)[:, None]
                b[k, t] -= 1
                grads["wo"][c] += h.T @ b
                grads["bo"][c] += b.sum(0)
                np.matmul(b, p["wo"][c].T, out=back[i])
        out[at] += inner
        if grads is not None:
            d[at] += back
        return out, d

    def score(self, docs: list[np.ndarray], streams: int = 384, window: int = 48) -> np.ndarray:
        """Natural log-probability of each whole document; each ends with id 0."""
        out = np.zeros(len(docs))
        ids, first, owner = lay_out(docs, max(1, min(streams, len(docs))))
        if not ids.size:
            return out
        gates = self.p["emb"] @ self.p["wx"] + self.p["bx"]
        h = np.zeros((ids.shape[1], self.hidden), F32)
        for a in range(0, len(ids), window):
            y, new, own = ids[a : a + window], first[a : a + window], owner[a : a + window]
            live = int((y >= 0).any(0).sum())  # streams are sorted by length, the longest first
            y, new, own, h = y[:, :live], new[:, :live], own[:, :live], h[:live]
            x = np.vstack([ids[a - 1 : a, :live] if a else np.zeros((1, live), ids.dtype), y[:-1]])
            x = np.where(new | (x < 0), 0, x)
            hs = np.empty((len(y), live, self.hidden), F32)
            for t in range(len(y)):
                if new[t].any():
                    h = h * (~new[t])[:, None]
                h = self._step(gates[x[t]], h)[0]
                hs[t] = h
            valid = y >= 0
            logs, _ = self._heads(hs[valid], y[valid], None)
            out += np.bincount(own[valid], logs, len(docs))
        return out


class Trainer:
    """Truncated backpropagation through a model's weights, for documents that come in chunks."""

    def __init__(self, model: Gru, expected: int, streams: int = 192, window: int = 24, rate: float = 0.01, longest: int = 4096):
        """expected: tokens to come, for the rate's schedule; documents are cut into pieces of `longest` tokens."""
        self.model, self.streams, self.window, self.rate, self.longest = model, streams, window, rate, longest
        self.step, self.total = 0, max(1, expected // (streams * window))
        self.m1, self.m2, self.tmp, self.grad = (np.zeros_like(model.flat) for _ in range(4))

    def feed(self, docs: list[np.ndarray]) -> None:
        """One pass over parallel streams of documents; the state goes on across windows."""
        pieces = [d[a : a + self.longest] for d in docs for a in range(0, len(d), self.longest)]
        ids, first, _ = lay_out(pieces, max(1, min(self.streams, len(pieces))))
        h = np.zeros((ids.shape[1], self.model.hidden), F32)
        for a in range(0, len(ids), self.window):
            y, new = ids[a : a + self.window], first[a : a + self.window]
            live = int((y >= 0).any(0).sum())  # streams are sorted by length, the longest first
            y, new, h = y[:, :live], new[:, :live], h[:live]
            x = np.vstack([ids[a - 1 : a, :live] if a else np.zeros((1, live), y.dtype), y[:-1]])
            h = self._window(np.where(new | (x < 0), 0, x), y, new, h)
            self._update()

    def _window(self, x: np.ndarray, y: np.ndarray, new: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Gradients of one window, added up in self.grad; returns the last state."""
        model, p, k = self.model, self.model.p, self.model.hidden
        self.grad[:] = 0
        g = model.parts(self.grad)
        ex = p["emb"][x]
        xg = ex @ p["wx"] + p["bx"]
        kept, hs_all = [], np.empty((*y.shape, k), F32)
        for t in range(len(y)):
            keep = (~new[t])[:, None].astype(F32) if new[t].any() else None
            h0 = h if keep is None else h * keep
            h, z, r, n, c = model._step(xg[t], h0)
            kept.append((h0, z, r, n, c, keep))
            hs_all[t] = h
        valid = y >= 0
        d_all = np.zeros_like(hs_all)
        # the state after the inputs up to t - 1 predicts token t
        _, d = model._heads(hs_all[valid], y[valid], g)
        scale = F32(1 / max(int(valid.sum()), 1))
        d_all[valid] = d * scale
        for name in ("wc", "bc", "wo", "bo"):
            g[name] *= scale
        dh, dxg, dhgs = np.zeros_like(h), np.empty_like(xg), np.empty_like(xg)
        back, h0s = np.ascontiguousarray(p["u"].T), np.empty_like(hs_all)
        for t in range(len(y) - 1, -1, -1):
            h0, z, r, n, c, keep = kept[t]
            h0s[t] = h0
            dh += d_all[t]
            dn = dh * (1 - z) * (1 - n * n)
            dxg[t, :, :k] = dh * (h0 - n) * z * (1 - z)
            dxg[t, :, k : 2 * k] = dn * c * r * (1 - r)
            dxg[t, :, 2 * k :] = dn
            dhgs[t, :, : 2 * k] = dxg[t, :, : 2 * k]
            dhgs[t, :, 2 * k :] = dn * r
            dh = dh * z + dhgs[t] @ back
            if keep is not None:
                dh *= keep
        flat, hidden = dxg.reshape(-1, 3 * k), dhgs.reshape(-1, 3 * k)
        g["u"] += h0s.reshape(-1, k).T @ hidden
        g["bn"] += hidden[:, 2 * k :].sum(0)
        g["wx"] += ex.reshape(len(flat), -1).T @ flat
        g["bx"] += flat.sum(0)
        np.add.at(g["emb"], x.ravel(), flat @ p["wx"].T)
        return h

    def _update(self) -> None:
        """One step of Adam, with the gradient's length limited to 1."""
        g, m1, m2, tmp = self.grad, self.m1, self.m2, self.tmp
        self.step += 1
        g *= F32(min(1.0, 1.0 / max(math.sqrt(float(g @ g)), 1e-9)))
        rate = self.rate * min(1, self.step / 10) * max(0.1, 1 - 0.9 * self.step / self.total)
        np.subtract(g, m1, out=tmp)
        tmp *= F32(0.1)
        m1 += tmp
        np.multiply(g, g, out=tmp)
        tmp -= m2
        tmp *= F32(0.01)
        m2 += tmp
        np.multiply(m2, F32(1 / (1 - 0.99**self.step)), out=tmp)
        np.sqrt(tmp, out=tmp)
        tmp += F32(1e-6)
        np.divide(m1, tmp, out=tmp)
        tmp *= F32(rate / (1 - 0.9**self.step))
        self.model.flat -= tmp


def lay_out(docs: list[np.ndarray], streams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, owner) of steps x streams: documents one after the other, the longest dealt first; -1 pads the ends."""
    heap = [(0, s) for s in range(streams)]
    where: list[list[int]] = [[] for _ in range(streams)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, s = heapq.heappop(heap)
        where[s].append(i)
        heapq.heappush(heap, (n + len(docs[i]), s))
    where.sort(key=lambda w: -sum(len(docs[i]) for i in w))
    steps = max((sum(len(docs[i]) for i in w) for w in where), default=0)
    ids, first, owner = np.full((steps, streams), -1, np.int32), np.zeros((steps, streams), bool), np.zeros((steps, streams), np.int32)
    for s, w in enumerate(where):
        at = 0
        for i in w:
            n = len(docs[i])
            ids[at : at + n, s], owner[at : at + n, s] = docs[i], i
            if n:
                first[at, s] = True
            at += n
    return ids, first, owner
