"""A small character tagger in numpy: bidirectional LSTM with CRF transitions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WIDTH = 96  # characters of a window
STRIDE = 48  # windows overlap by half
_CELLS = 1 << 19  # window characters tagged at a time

PAD, LETTER, LINE, SYMBOLS = 0, 96, 97, 98


def codes(text: str) -> np.ndarray:
    """A class for each code point: printable ASCII one each, all beyond ASCII one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.where((points >= 32) & (points < 127), points - 31, LINE)
    return np.where(points > 127, LETTER, out).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """``tags`` names the classes; ``allowed[i, j]`` says whether class j may follow class i."""

    tags: list[str]
    allowed: np.ndarray
    size: int = 12
    hidden: int = 20
    seed: int = 7
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            rng, k, h, d = np.random.default_rng(self.seed), len(self.tags), self.hidden, self.size
            init = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
            self.p = {"E": init(SYMBOLS, d), "Wo": init(2 * h, k), "bo": np.zeros(k, np.float32), "A": np.zeros((k, k), np.float32)}
            for s in "fb":
                bias = np.zeros(4 * h, np.float32)
                bias[h : 2 * h] = 1  # open forget gates
                self.p |= {f"Wx{s}": init(d, 4 * h), f"Wh{s}": init(h, 4 * h), f"b{s}": bias}

    # LSTM

    def _run(self, x: np.ndarray, s: str, keep: bool) -> tuple[np.ndarray, list]:
        h, (n, steps, _) = self.hidden, x.shape
        pre = x @ self.p[f"Wx{s}"] + self.p[f"b{s}"]
        out = np.zeros((n, steps, h), np.float32)
        state, cell, saved = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(steps):
            g = pre[:, t] + state @ self.p[f"Wh{s}"]
            i, f, o = np.split(_sigmoid(g[:, : 3 * h]), 3, axis=1)
            u, before = np.tanh(g[:, 3 * h :]), (state, cell)
            cell = f * cell + i * u
            tc = np.tanh(cell)
            state = o * tc
            out[:, t] = state
            if keep:
                saved.append((i, f, o, u, tc, *before))
        return out, saved

    def _back(self, dout: np.ndarray, x: np.ndarray, s: str, saved: list, grad: dict) -> np.ndarray:
        h, (n, steps, _) = self.hidden, x.shape
        dg = np.zeros((n, steps, 4 * h), np.float32)
        dstate, dcell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, o, u, tc, state0, cell0 = saved[t]
            ds = dout[:, t] + dstate
            dc = dcell + ds * o * (1 - tc * tc)
            g = np.concatenate([dc * u * i * (1 - i), dc * cell0 * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dg[:, t] = g
            dstate, dcell = g @ self.p[f"Wh{s}"].T, dc * f
            grad[f"Wh{s}"] += state0.T @ g
        grad[f"Wx{s}"] += np.einsum("ntd,ntg->dg", x, dg)
        grad[f"b{s}"] += dg.sum((0, 1))
        return dg @ self.p[f"Wx{s}"].T

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Class scores ``(windows, characters, classes)``; windows do not meet, so any number is tagged in even parts."""
        part = max(1, _CELLS // max(1, ids.shape[1]))
        out = []
        for lo in range(0, len(ids), part):
            x = self.p["E"][ids[lo : lo + part]]
            forth, back = self._run(x, "f", False)[0], self._run(x[:, ::-1], "b", False)[0][:, ::-1]
            out.append(np.concatenate([forth, back], axis=2) @ self.p["Wo"] + self.p["bo"])
        return np.concatenate(out) if out else np.zeros((0, ids.shape[1], len(self.tags)), np.float32)

    # CRF

    @property
    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p["A"], -1e4).astype(np.float32)

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss and its gradients by emissions and transitions, from forward and backward sums."""
        a, (n, steps, k) = self.transitions.astype(np.float64), e.shape
        e = e.astype(np.float64)
        fwd, bwd = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        fwd[:, 0] = e[:, 0]
        for t in range(1, steps):
            fwd[:, t] = e[:, t] + _logsumexp(fwd[:, t - 1, :, None] + a, 1)
        for t in range(steps - 2, -1, -1):
            bwd[:, t] = _logsumexp(a + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        z = _logsumexp(fwd[:, -1], 1)
        rows, at = np.arange(n)[:, None], np.arange(steps)[None]
        de = np.exp(fwd + bwd - z[:, None, None])
        da = np.zeros((k, k))
        for t in range(1, steps):
            da += np.exp(fwd[:, t - 1, :, None] + a + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None]).sum(0)
        gold = e[rows, at, y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
        de[rows, at, y] -= 1
        np.subtract.at(da, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        return float((z - gold).sum()), de.astype(np.float32), da.astype(np.float32)

    def best(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best class path of each padded row of ``e``, whose true lengths are given."""
        a, (n, steps, k) = self.transitions, e.shape
        back = np.zeros((n, steps, k), np.int8)
        score = e[:, 0].copy()
        for t in range(1, steps):
            step = score[:, :, None] + a
            back[:, t] = step.argmax(1)
            score = np.where((t < lengths)[:, None], step.max(1) + e[:, t], score)
        path = np.zeros((n, steps), np.int8)
        state, rows = score.argmax(1), np.arange(n)
        for t in range(steps - 1, -1, -1):
            path[:, t] = state
            if t:
                state = np.where(t < lengths, back[rows, t, state], state)
        return path

    def margin(self, e: np.ndarray, path: np.ndarray, start: int, end: int) -> float:
        """How much more a path scores with its classes from ``start`` to ``end`` than with the first class in their place."""
        a, rows = self.transitions, np.arange(start, end)
        lo, hi = max(0, start - 1), min(len(path), end + 1)
        own, none = path[lo:hi].astype(np.int64), path[lo:hi].astype(np.int64)
        none[start - lo : end - lo] = 0
        steps = a[own[:-1], own[1:]].sum() - a[none[:-1], none[1:]].sum()
        return float((e[rows, path[start:end]] - e[rows, 0]).sum() + steps)

    def fit(self, ids: np.ndarray, y: np.ndarray, updates: int = 240, batch: int = 48, rate: float = 0.01) -> list[float]:
        """Adam over shuffled batches of equal windows, so many updates at least; padding carries the first class. Returns the loss per epoch."""
        rng, step, losses = np.random.default_rng(self.seed), 0, []
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        while step < updates and len(ids):
            total = 0.0
            order = rng.permutation(len(ids))
            for lo in range(0, len(ids), batch):
                rows = order[lo : lo + batch]
                x = self.p["E"][ids[rows]]
                forth, saved_f = self._run(x, "f", True)
                back, saved_b = self._run(x[:, ::-1], "b", True)
                both = np.concatenate([forth, back[:, ::-1]], axis=2)
                loss, de, da = self._crf(both @ self.p["Wo"] + self.p["bo"], y[rows])
                total += loss
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["A"] = np.where(self.allowed, da, 0)
                grad["Wo"] = np.einsum("nth,ntk->hk", both, de)
                grad["bo"] = de.sum((0, 1))
                dboth = de @ self.p["Wo"].T
                h = self.hidden
                dx = self._back(dboth[:, :, :h], x, "f", saved_f, grad)
                dx = dx + self._back(dboth[:, ::-1, h:], x[:, ::-1], "b", saved_b, grad)[:, ::-1]
                np.add.at(grad["E"], ids[rows], dx)
                step += 1
                scale = min(1.0, 5.0 * len(rows) / (np.sqrt(sum(float((g * g).sum()) for g in grad.values())) + 1e-9)) / len(rows)
                for k, g in grad.items():
                    m, v = moments[k]
                    g = g * scale
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / max(1, len(ids)))
        return losses


def windows_of(length: int) -> list[int]:
    """Starts of the overlapping windows of a region."""
    return list(range(0, max(1, length - WIDTH + STRIDE), STRIDE)) if length > WIDTH else [0]


def decode(tagger: Tagger, regions: list[str]) -> list[np.ndarray]:
    """One class path per region of any length."""
    return [path for path, _ in decode_scored(tagger, regions)]


def decode_scored(tagger: Tagger, regions: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One class path per region of any length, with the class scores of its characters.

    Windows are scored each for itself; where they overlap their scores are averaged, the middle of a window weighing more
    than its ends, and one Viterbi pass over the whole region reconciles them.
    """
    if not regions:
        return []
    starts = [windows_of(len(r)) for r in regions]
    ids = np.zeros((sum(map(len, starts)), WIDTH), np.int64)
    row = 0
    for region, at in zip(regions, starts, strict=True):
        own = codes(region)
        for s in at:
            part = own[s : s + WIDTH]
            ids[row, : len(part)] = part
            row += 1
    scores = tagger.emissions(ids)
    weight = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)[:, None]
    merged, row = [], 0
    for region, at in zip(regions, starts, strict=True):
        n = len(region)
        total, seen = np.zeros((n, scores.shape[2]), np.float32), np.zeros((n, 1), np.float32)
        for s in at:
            m = min(WIDTH, n - s)
            total[s : s + m] += weight[:m] * scores[row, :m]
            seen[s : s + m] += weight[:m]
            row += 1
        merged.append(total / seen)
    out: list[np.ndarray] = [np.empty(0)] * len(regions)
    order = sorted(range(len(regions)), key=lambda i: len(regions[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(regions[order[hi]]) <= _CELLS // 4:
            hi += 1
        part = order[lo:hi]
        lengths = np.array([len(regions[i]) for i in part])
        e = np.zeros((len(part), int(lengths.max()), scores.shape[2]), np.float32)
        for k, i in enumerate(part):
            e[k, : lengths[k]] = merged[i]
        for k, path in enumerate(tagger.best(e, lengths)):
            out[part[k]] = path[: lengths[k]]
        lo = hi
    return list(zip(out, merged, strict=True))
