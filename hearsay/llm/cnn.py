"""A small convolutional network over bytes, in numpy: embedding, filters of several widths, max pooling, softmax.

Filters of all widths are one matrix over the widest window, with zeros held where a narrow filter
doesn't reach; a batch is then one product. Training is Adam over the given windows, on the driver or, block by block, in
tasks; the fitted arrays (some 10 KB) travel with the tasks, which apply them to batches of fixed-length windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD = 0
#: Windows that are multiplied at a time: their product stays within a core's cache.
BATCH = 64


@dataclass
class ByteCNN:
    emb: np.ndarray  # 256 x dim
    kernel: np.ndarray  # width * dim x filters
    mask: np.ndarray  # as kernel: 0 where a narrow filter doesn't reach
    bias: np.ndarray
    out: np.ndarray  # filters x classes
    out_bias: np.ndarray

    @classmethod
    def new(cls, n_classes: int, widths: tuple[int, ...] = (2, 3, 4), filters: int = 12, dim: int = 6, seed: int = 7) -> ByteCNN:
        rng = np.random.default_rng(seed)
        widest, n = max(widths), filters * len(widths)
        mask = np.zeros((widest, dim, n), np.float32)
        for k, w in enumerate(widths):
            mask[:w, :, k * filters : (k + 1) * filters] = 1
        mask = mask.reshape(widest * dim, n)
        f = lambda *s: rng.standard_normal(s).astype(np.float32)
        emb = f(256, dim) * np.float32(0.5)
        emb[PAD] = 0
        return cls(emb, f(widest * dim, n) * np.float32((widest * dim) ** -0.5) * mask, mask, np.zeros(n, np.float32), f(n, n_classes) * np.float32(n**-0.5), np.zeros(n_classes, np.float32))

    @property
    def width(self) -> int:
        return len(self.kernel) // self.emb.shape[1]

    def _columns(self, x: np.ndarray) -> np.ndarray:
        e = self.emb[x]
        w = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), self.width * e.shape[2], axis=1)
        return np.ascontiguousarray(w[:, :: e.shape[2]])

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of windows (n x length, uint8)."""
        parts = []
        for k in range(0, len(x), BATCH):
            h = self._columns(x[k : k + BATCH]) @ self.kernel
            parts.append(np.maximum(h.max(axis=1) + self.bias, 0) @ self.out + self.out_bias)
        return np.concatenate(parts) if parts else np.zeros((0, len(self.out_bias)), np.float32)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        z = self.logits(x).astype(np.float64)
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def _arrays(self) -> list[np.ndarray]:
        return [self.emb, self.kernel, self.bias, self.out, self.out_bias]

    def copy(self) -> ByteCNN:
        return self.like(self.flat())

    def flat(self) -> np.ndarray:
        """All weights end to end."""
        return np.concatenate([a.ravel() for a in self._arrays()])

    def like(self, flat: np.ndarray) -> ByteCNN:
        """The network of this shape with the given weights."""
        parts, at = [], 0
        for a in self._arrays():
            parts.append(flat[at : at + a.size].astype(np.float32).reshape(a.shape))
            at += a.size
        emb, kernel, bias, out, out_bias = parts
        return ByteCNN(emb, kernel, self.mask, bias, out, out_bias)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, batch: int = 128, seed: int = 11, part: int = 0, parts: int = 1) -> ByteCNN:
        """Adam on cross entropy; ``y`` are class numbers. The rate falls over all ``parts`` of a training, of which this is one."""
        rng = np.random.default_rng(seed)
        params = self._arrays()
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        dim, steps = self.emb.shape[1], max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                pick = order[k : k + batch]
                xb, yb, n = x[pick], y[pick], len(pick)
                cols = self._columns(xb)
                h = cols @ self.kernel
                top = h.argmax(axis=1)  # n x filters
                pre = np.take_along_axis(h, top[:, None, :], 1)[:, 0] + self.bias
                pooled = np.maximum(pre, 0)
                z = pooled @ self.out + self.out_bias
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), yb] -= 1
                p /= n
                g = (p @ self.out.T) * (pre > 0)
                seen = cols[np.arange(n)[:, None], top]  # n x filters x width*dim
                d_kernel = np.einsum("nfk,nf->kf", seen, g) * self.mask
                d_seen = (g[:, :, None] * self.kernel.T[None]).reshape(n, -1, self.width, dim)
                at = xb[np.arange(n)[:, None, None], top[:, :, None] + np.arange(self.width)]
                d_emb = np.zeros_like(self.emb)
                # One number at a time: numpy is quicker at that than at rows, and adds in the same order.
                np.add.at(d_emb.reshape(-1), (at.reshape(-1, 1).astype(np.int64) * dim + np.arange(dim)).reshape(-1), d_seen.reshape(-1))
                d_emb[PAD] = 0
                t += 1
                step = rate * min(1.0, 2 * (1 - (part * steps + t) / (parts * steps + 1)))
                for j, grad in enumerate((d_emb, d_kernel, g.sum(0), pooled.T @ p, p.sum(0))):
                    m[j] += 0.1 * (grad - m[j])
                    v[j] += 0.001 * (grad * grad - v[j])
                    params[j] -= (step * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows_of(text: bytes, length: int, overlap: int) -> np.ndarray:
    """All of ``text`` as windows of ``length`` bytes, each overlapping the one before; the last one padded."""
    step = length - overlap
    n = max(1, -(-(len(text) - overlap) // step))
    buf = np.zeros((n - 1) * step + length, np.uint8)
    buf[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(buf, length)[::step]
