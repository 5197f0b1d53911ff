"""Character-level bidirectional LSTM with a CRF on top, in numpy.

All windows have the same length; arrays are (time, window, feature).
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def create(chars: int, tags: int, seed: int, embed: int = 12, hidden: int = 16) -> Params:
    rng = np.random.default_rng(seed)

    def matrix(*shape: int) -> np.ndarray:
        return rng.normal(0.0, 1.0 / np.sqrt(shape[0]), shape)

    out = {"embed": rng.normal(0.0, 0.5, (chars, embed)), "out": matrix(2 * hidden, tags), "bias": np.zeros(tags),
           "trans": np.zeros((tags, tags)), "first": np.zeros(tags), "last": np.zeros(tags)}
    for way in ("f", "b"):
        out |= {f"wx_{way}": matrix(embed, 4 * hidden), f"wh_{way}": matrix(hidden, 4 * hidden),
                f"b_{way}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states, and of each step what the way back needs.  Gates stand
    in the order input, forget, output, candidate."""
    steps, size = x.shape[:2]
    n = wh.shape[0]
    h = c = np.zeros((size, n))
    pre, states, kept = x @ wx + b, np.empty((steps, size, n)), []
    for t in range(steps):
        z = pre[t] + h @ wh
        gates, new = _sigmoid(z[:, :3 * n]), np.tanh(z[:, 3 * n:])
        before, c = c, gates[:, n:2 * n] * c + gates[:, :n] * new
        bent = np.tanh(c)
        kept.append((h, before, gates, new, bent))
        h = states[t] = gates[:, 2 * n:] * bent
    return states, kept


def _lstm_back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, grad: np.ndarray) -> tuple:
    steps, size = x.shape[:2]
    n = wh.shape[0]
    dz = np.empty((steps, size, 4 * n))
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((size, n)), np.zeros((size, n))
    for t in range(steps - 1, -1, -1):
        before_h, before_c, gates, new, bent = kept[t]
        i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
        dh = dh + grad[t]
        dc = dc + dh * o * (1.0 - bent * bent)
        dz[t] = np.concatenate([dc * new * i * (1 - i), dc * before_c * f * (1 - f),
                                dh * bent * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        dwh += before_h.T @ dz[t]
        dh, dc = dz[t] @ wh.T, dc * f
    return np.tensordot(x, dz, ([0, 1], [0, 1])), dwh, dz.sum((0, 1)), dz @ wx.T


def emissions(p: Params, chars: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Tag scores of windows (windows x time)."""
    x = p["embed"][chars.T]
    ahead, kept_f = _lstm(x, p["wx_f"], p["wh_f"], p["b_f"])
    back, kept_b = _lstm(x[::-1], p["wx_b"], p["wh_b"], p["b_b"])
    both = np.concatenate([ahead, back[::-1]], axis=2)
    return both @ p["out"] + p["bias"], (x, both, kept_f, kept_b)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(p: Params, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward scores, the log partition, tag marginals."""
    steps = len(e)
    a, b = np.empty_like(e), np.empty_like(e)
    a[0], b[-1] = p["first"] + e[0], p["last"]
    for t in range(1, steps):
        a[t] = _lse(a[t - 1][:, :, None] + p["trans"], 1) + e[t]
        b[-1 - t] = _lse(p["trans"] + (e[-t] + b[-t])[:, None, :], 2)
    z = _lse(a[-1] + p["last"], 1)
    return a, b, z, np.exp(a + b - z[None, :, None])


def viterbi(p: Params, e: np.ndarray) -> np.ndarray:
    """Best tags (windows x time)."""
    steps, size, _ = e.shape
    best, came = p["first"] + e[0], []
    for t in range(1, steps):
        all_ = best[:, :, None] + p["trans"]
        came.append(all_.argmax(axis=1))
        best = all_.max(axis=1) + e[t]
    tags = np.empty((size, steps), dtype=np.int64)
    tags[:, -1] = (best + p["last"]).argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = came[t - 1][np.arange(size), tags[:, t]]
    return tags


def gradients(p: Params, chars: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood of the windows' tags, and its gradients."""
    size, steps = chars.shape
    e, (x, both, kept_f, kept_b) = emissions(p, chars)
    a, b, z, m = marginals(p, e)
    y, w = tags.T, np.arange(size)
    gold = p["first"][y[0]] + p["last"][y[-1]] + e[np.arange(steps)[:, None], w, y].sum(0) \
        + p["trans"][y[:-1], y[1:]].sum(0)
    g = {"trans": np.zeros_like(p["trans"]), "first": m[0].sum(0), "last": m[-1].sum(0)}
    for t in range(1, steps):
        g["trans"] += np.exp(a[t - 1][:, :, None] + p["trans"] + (e[t] + b[t])[:, None, :] - z[:, None, None]).sum(0)
    np.subtract.at(g["trans"], (y[:-1].ravel(), y[1:].ravel()), 1.0)
    np.subtract.at(g["first"], y[0], 1.0)
    np.subtract.at(g["last"], y[-1], 1.0)
    de = m.copy()
    de[np.arange(steps)[:, None], w, y] -= 1.0
    g["out"], g["bias"] = np.tensordot(both, de, ([0, 1], [0, 1])), de.sum((0, 1))
    dboth = de @ p["out"].T
    n = p["wh_f"].shape[0]
    g["wx_f"], g["wh_f"], g["b_f"], dx = _lstm_back(x, p["wx_f"], p["wh_f"], kept_f, dboth[:, :, :n])
    g["wx_b"], g["wh_b"], g["b_b"], dx_b = _lstm_back(x[::-1], p["wx_b"], p["wh_b"], kept_b, dboth[::-1, :, n:])
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], chars.T, dx + dx_b[::-1])
    return float((z - gold).mean()), {k: v / size for k, v in g.items()}


def fit(p: Params, chars: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01,
        seed: int = 42) -> Params:
    """Adam over shuffled batches."""
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    power = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(chars))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            _, g = gradients(p, chars[some], tags[some])
            step += 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                power[k] = 0.999 * power[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (mean[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(power[k] / (1 - 0.999 ** step)) + 1e-8)
    return p
