"""A small causal self-attention model in numpy: forward, backward, Adam, and batched scoring."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

Params = dict[str, np.ndarray]


def init(inputs: int, classes: int, window: int, width: int = 16, hidden: int = 32, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    shapes = {"emb": (inputs, width), "pos": (window, width), "q": (width, width), "k": (width, width), "v": (width, width), "o": (width, width), "w1": (width, hidden), "w2": (hidden, width), "out": (width, classes)}
    params = {k: (rng.standard_normal(s) * (0.5 if k in ("emb",) else s[0] ** -0.5)).astype(np.float32) for k, s in shapes.items()}
    params["pos"] *= np.float32(0.1)
    params["out"] *= np.float32(0.1)
    return params


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def forward(p: Params, tokens: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, tuple]:
    """tokens (windows, length): inputs.  prior (windows, length, classes): logits that the model adds to.

    Returns log-probabilities of the next token's class, and what backward needs.
    Places after a window's end may hold anything: the mask lets no place look ahead.
    """
    n, t = tokens.shape
    d = p["q"].shape[0]
    x = p["emb"][tokens] + p["pos"][:t]
    q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
    s = q @ k.transpose(0, 2, 1)
    s *= np.float32(d**-0.5)
    s += np.triu(np.full((t, t), -1e9, np.float32), 1)
    a = _softmax(s)
    c = a @ v
    h = x + c @ p["o"]
    r = np.maximum(h @ p["w1"], 0)
    y = h + r @ p["w2"]
    z = y @ p["out"]
    z += prior
    z -= z.max(axis=-1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=-1, keepdims=True))
    return z, (tokens, x, q, k, v, a, c, h, r, y)


def _exp(x: np.ndarray) -> np.ndarray:
    """In place, of logits bounded by 60, so that sums can't overflow; the highest one alone tells whether any has to be cut."""
    if x.max() > 60:
        np.minimum(x, x.dtype.type(60), out=x)
    return np.exp(x, out=x)


@lru_cache
def _mask(t: int, dtype: np.dtype) -> np.ndarray:
    """1 where a place may look: at itself and what is before it."""
    return np.tril(np.ones((t, t), dtype))


class Room:
    """Memory for arrays of one batch that the next batch uses again, by name: fresh pages cost more than what is written to them."""

    def __init__(self):
        self._held: dict[str, np.ndarray] = {}

    def of(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        held = self._held.get(name)
        if held is None or held.size < size or held.dtype != dtype:
            held = self._held[name] = np.empty(size, dtype)
        return held[:size].reshape(shape)

    def rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """table[at]."""
        out = self.of(name, table.dtype, *at.shape, table.shape[1])
        return np.take(table, at, axis=0, out=out, mode="clip")  # other modes copy once more

    def product(self, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a @ b."""
        out = self.of(name, a.dtype, *a.shape[:-1], b.shape[-1])
        if a.ndim > 2:
            return np.matmul(a, b, out=out)
        (some, rest), (to, last) = _blocks(a), _blocks(out)
        np.matmul(some, b, out=to)
        if len(rest):
            np.matmul(rest, b, out=last)
        return out


#: Rows that are multiplied at once: BLAS has a faster way for small products, without copies.
BLOCK = 256


def _blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in blocks, and those that are left."""
    whole = len(x) // BLOCK * BLOCK
    return x[:whole].reshape(-1, BLOCK, x.shape[1]), x[whole:]


def _outer(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for many rows."""
    (some, rest), (with_, last) = _blocks(a), _blocks(b)
    out = np.matmul(some.transpose(0, 2, 1), with_).sum(axis=0)
    if len(rest):
        out += rest.T @ last
    return out


class Scorer:
    """forward() for scoring, with fewer passes over memory: products of parameters alone are made once."""

    def __init__(self, p: Params, prior: np.ndarray):
        self.p, self.prior, self.room = p, prior, Room()
        one, d = p["q"].dtype.type, p["q"].shape[0]
        # A place's vector itself, its query, its key, what attention to it adds, and 1, which adds up attention.
        columns = np.concatenate([np.eye(d, dtype=one), p["q"] * one(d**-0.5), p["k"], p["v"] @ p["o"]], axis=1)
        self.emb, self.pos = (np.concatenate([x @ columns, np.full((len(x), 1), last, one)], axis=1) for x, last in ((p["emb"], 1), (p["pos"], 0)))

    def __call__(self, inputs: np.ndarray, before: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The log-probability of each wanted class, as forward() has it.

        inputs is (windows, length); before and wanted are of each window's last
        places, all or fewer: those ahead of them only give context.
        prior[before] is what the model's logits add to.
        """
        p, room, d = self.p, self.room, self.p["q"].shape[0]
        t, (n, m) = inputs.shape[1], before.shape
        x = room.rows("x", self.emb, inputs)
        x += self.pos[:t]
        late = x[:, t - m :]
        s = _exp(room.product("s", late[..., d : 2 * d], x[..., 2 * d : 3 * d].transpose(0, 2, 1)))
        s *= _mask(t, s.dtype)[t - m :]
        c = room.product("c", s, x[..., 3 * d :])
        h = np.divide(c[..., :d], np.maximum(c[..., d:], c.dtype.type(1e-30)), out=room.of("h", c.dtype, n, m, d))
        h += late[..., :d]
        h = h.reshape(-1, d)
        r = room.product("r", h, p["w1"])
        np.maximum(r, 0, out=r)
        h += room.product("y", r, p["w2"])
        z = room.product("z", h, p["out"])
        z += room.rows("prior", self.prior, before.ravel())
        chosen = z.ravel()[np.arange(0, z.size, z.shape[1]) + wanted.ravel()]
        _exp(z)
        return (chosen - np.log(z @ np.ones(z.shape[1], z.dtype))).reshape(n, m)


def score(p: Params, inputs: np.ndarray, before: np.ndarray, prior: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Scorer for one batch."""
    return Scorer(p, prior)(inputs, before, wanted)


def _by_row(places: np.ndarray, rows: int, x: np.ndarray, room: Room) -> np.ndarray:
    """Sums of the rows of x by their places."""
    order = np.argsort(places.astype(np.uint16 if rows <= 1 << 16 else np.int64), kind="stable")
    sorted_ = places[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    out = np.zeros((rows, x.shape[1]), x.dtype)
    out[sorted_[first]] = np.add.reduceat(room.rows("by row", x, order), first, axis=0)
    return out


def gradients(p: Params, inputs: np.ndarray, before: np.ndarray, prior: np.ndarray, wanted: np.ndarray, weight: np.ndarray, room: Room | None = None) -> Params:
    """Of the weighted mean of the negative log-probabilities that score() has for the wanted classes: forward and backward in one."""
    n, t = inputs.shape
    d = p["q"].shape[0]
    one, room = p["q"].dtype.type, room or Room()
    x = room.rows("x", p["emb"], inputs)
    x += p["pos"][:t]
    flat = x.reshape(-1, d)
    into = np.concatenate([p["q"] * one(d**-0.5), p["k"], p["v"]], axis=1)
    qkv = room.product("qkv", flat, into).reshape(n, t, 3 * d)
    q, k, v = qkv[..., :d], qkv[..., d : 2 * d], qkv[..., 2 * d :]
    a = _exp(room.product("a", q, k.transpose(0, 2, 1)))
    a *= _mask(t, a.dtype)
    a /= (a @ np.ones(t, a.dtype))[..., None]
    c = room.product("c", a, v).reshape(-1, d)
    h = room.product("h", c, p["o"])
    h += flat
    r = room.product("r", h, p["w1"])
    np.maximum(r, 0, out=r)
    y = room.product("y", r, p["w2"])
    y += h
    e = room.product("e", y, p["out"])
    e += room.rows("wide", prior, before.ravel())
    _exp(e)
    # e isn't divided by its sums: the narrower arrays that go with it are.
    total = e @ np.ones(e.shape[1], e.dtype)
    e.reshape(-1)[np.arange(0, e.size, e.shape[1]) + wanted.ravel()] -= total
    share = (weight.ravel().astype(e.dtype) / one(max(1.0, float(weight.sum()))) / total)[:, None]
    y *= share
    g = {"out": _outer(y, e)}
    dy = room.product("dy", e, p["out"].T)
    dy *= share
    g["w2"] = _outer(r, dy)
    dr = room.product("wide", dy, p["w2"].T)
    dr *= r > 0
    g["w1"] = _outer(h, dr)
    dy += room.product("y", dr, p["w1"].T)
    g["o"] = _outer(c, dy)
    dc = room.product("y", dy, p["o"].T).reshape(n, t, d)
    ds = room.product("wide", dc, v.transpose(0, 2, 1))
    ds -= np.einsum("ntd,ntd->nt", dc, c.reshape(n, t, d))[..., None]  # as the rows of a @ (dc v) are
    ds *= a
    dqkv = room.of("e", qkv.dtype, *qkv.shape)
    np.matmul(ds, k, out=dqkv[..., :d])
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., d : 2 * d])
    np.matmul(a.transpose(0, 2, 1), dc, out=dqkv[..., 2 * d :])
    dflat = dqkv.reshape(-1, 3 * d)
    g["q"], g["k"], g["v"] = np.split(_outer(flat, dflat), 3, axis=1)
    g["q"] *= one(d**-0.5)
    dy += room.product("y", dflat, into.T)
    g["pos"] = np.zeros_like(p["pos"])
    g["pos"][:t] = dy.reshape(n, t, d).sum(axis=0)
    g["emb"] = _by_row(inputs.ravel(), len(p["emb"]), dy, room)
    return g


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.n = rate, np.float32(0), np.float32(0), 0

    def step(self, p: Params, g: Params) -> None:
        """All parameters at once, laid side by side."""
        self.n += 1
        x = np.concatenate([g[k].ravel() for k in p])
        self.m = self.m * np.float32(0.9) + np.float32(0.1) * x
        x *= x
        self.v = self.v * np.float32(0.98) + np.float32(0.02) * x
        move = self.v * np.float32(1 / (1 - 0.98**self.n))
        np.sqrt(move, out=move)
        move += np.float32(1e-8)
        np.divide(self.m, move, out=move)
        move *= np.float32(self.rate / (1 - 0.9**self.n))
        at = 0
        for k, y in p.items():
            y -= move[at : at + y.size].reshape(y.shape)
            at += y.size


def pack(p: Params) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64)


def unpack(like: Params, flat: np.ndarray) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out
