"""A causal self-attention model in numpy that predicts the class of the next word.

A word enters as the sum of its subword ids' vectors (the first id has a table
of its own).  A window holds CONTEXT words that are only looked at and SPAN
places whose next word (or end of text) is predicted; each place of a text is
in the SPAN of exactly one window.  Attention is batched, masked and sees no
later word.  Distances enter as a learned bias.
"""

from __future__ import annotations

import math

import numpy as np

CONTEXT, SPAN = 8, 24
T = CONTEXT + SPAN
DIM, HIDDEN, CLASSES = 16, 32, 64
#: class CLASSES is the end of a text
OUT = CLASSES + 1
ROWS = 4096
BATCH = 128
#: logits and attention scores stay under it, so that their exponentials are finite
LIMIT = np.float32(30.0)

SHAPES = {"first": (ROWS + 1, DIM), "rest": (ROWS, DIM), "far": (T,), "q": (DIM, DIM), "kv": (DIM, 2 * DIM), "out": (DIM, DIM), "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, DIM), "wc": (DIM, OUT), "bc": (OUT,)}
#: how many words back each key is from each place; negative: not to be seen
_BACK = np.arange(SPAN)[:, None] + CONTEXT - np.arange(T)
_SEEN = _BACK >= 0
_FAR = _BACK[_SEEN]
#: so many further ids of a word are added one by one, all words at once
FEW = 4


def initial(share: np.ndarray, first: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Fixed random weights; the output starts at the classes' shares (logarithms), first ids at the vectors given."""
    r = np.random.default_rng(6)
    p = {k: (r.standard_normal(s) * (0.3 if k in ("first", "rest") else s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}
    p["wc"] *= np.float32(0.1)
    p["far"][:] = 0
    p["b1"][:] = 0
    p["bc"] = share.astype(np.float32)
    if first is not None:
        p["first"] = first + p["first"] * np.float32(0.1)
        p["rest"] *= np.float32(0.1)
    return p


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def restore(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


_PLACES = np.arange(2 * ROWS * DIM).reshape(-1, DIM)


def summed(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of x, of DIM numbers, by their places in 0 .. n - 1."""
    got = np.zeros(n * DIM)
    place = _PLACES.take(at, axis=0) if n <= len(_PLACES) else at[:, None] * DIM + np.arange(DIM)
    np.add.at(got, place.ravel(), x.astype(np.float64).ravel())
    return got.reshape(n, DIM).astype(x.dtype)


def by_row(row: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(different rows of a table of n, sums of the rows of x that are theirs)."""
    lut, nth = np.empty(n, np.int64), np.arange(len(row))
    lut[row] = nth  # one of a row's places stands for it
    here = row[lut.take(row) == nth]
    lut[here] = nth[: len(here)]
    return here, summed(lut.take(row), x, len(here))


def falling(size: np.ndarray) -> np.ndarray:
    """The order of words from long to short."""
    return np.argsort(65535 - np.minimum(size, 65535).astype(np.uint16), kind="stable")


class Words:
    """The words of a batch of windows: rows of first ids, and where in ``ids`` the others' rows begin and how many they are."""

    def __init__(self, first: np.ndarray, ids: np.ndarray, size: np.ndarray, upto: np.ndarray | None = None):
        self.first, self.ids, self.size = first, ids, size
        self.upto = np.cumsum(size) - size if upto is None else upto
        self.lut: np.ndarray | None = None
        self.layers: list[tuple[slice | np.ndarray, np.ndarray]] | None = None

    @property
    def rest(self) -> np.ndarray:
        return self.ids[self._from(np.arange(len(self.size)), 0)[1]]

    def _from(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, places in ids) of all further ids of these words but the first k of each."""
        n = self.size[at] - k
        return np.repeat(at, n), np.repeat(self.upto[at] + k - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def take(self, pick: np.ndarray) -> "Words":
        return Words(self.first[pick], self.ids, self.size[pick], self.upto[pick])

    def further(self) -> list[tuple[slice | np.ndarray, np.ndarray]]:
        """(words, rows) of their first further ids, their second ones and so on up to FEW, then of all others."""
        if self.layers is None:
            most = int(self.size.max(initial=0))
            long_first = bool((self.size[1:] <= self.size[:-1]).all())
            self.layers = []
            for k in range(min(FEW, most)):
                at = slice(0, int(np.count_nonzero(self.size > k))) if long_first else np.flatnonzero(self.size > k)
                self.layers.append((at, self.ids.take(self.upto[at] + k)))
            if most > FEW:
                at, place = self._from(np.flatnonzero(self.size > FEW), FEW)
                self.layers.append((at, self.ids.take(place)))
        return self.layers

    def within(self, win: np.ndarray) -> tuple["Words", np.ndarray]:
        """(the different words of windows, each once; the windows' places in these)."""
        if self.lut is None:
            self.lut = np.empty(len(self.first) + 1, np.int64)
        flat, nth = win.ravel(), np.arange(win.size)
        self.lut[flat] = nth  # one of a word's places stands for it
        here = flat[self.lut.take(flat, mode="wrap") == nth]
        here = here[here >= 0]
        here = here[falling(self.size[here])]
        self.lut[here] = nth[: len(here)]
        self.lut[-1] = -1
        return self.take(here), self.lut.take(win, mode="wrap")

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        out = p["first"].take(self.first, axis=0)
        for k, (at, row) in enumerate(self.further()):
            if k < FEW:
                out[at] += p["rest"].take(row, axis=0)
            else:
                here = np.flatnonzero(self.size > FEW)
                out[here] += summed(np.searchsorted(here, at), p["rest"].take(row, axis=0), len(here))
        return out


def bias(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(_SEEN, p["far"][np.maximum(_BACK, 0)], p["far"].dtype.type(-1e9))


def _and_one(n: int, dtype) -> np.ndarray:
    """Room for rows of DIM numbers and a one, which takes a bias in."""
    out = np.empty((n, DIM + 1), dtype)
    out[:, DIM] = 1
    return out


def forward(p: dict[str, np.ndarray], h0: np.ndarray, real: np.ndarray, far: np.ndarray):
    """Logits (windows * SPAN, OUT) for word vectors (windows, T, DIM); real: which of them are words (the others are 0)."""
    w = len(h0)
    kv = h0.reshape(-1, DIM) @ p["kv"]
    v1 = np.empty((w, T, DIM + 1), h0.dtype)
    v1[..., :DIM] = kv[:, DIM:].reshape(w, T, DIM)
    v1[..., DIM] = real  # the others are 0 already where no word is
    k = np.ascontiguousarray(kv[:, :DIM].reshape(w, T, DIM).transpose(0, 2, 1))
    return _attend(p, np.ascontiguousarray(h0[:, CONTEXT:]).reshape(-1, DIM), k, v1, far)


def forward_along(p: dict[str, np.ndarray], h: np.ndarray, real: np.ndarray, far: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The logits of neighbouring windows, whose places follow each other after CONTEXT others; opens: which windows begin a text."""
    w = len(opens)
    kv = h @ p["kv"]
    v1 = np.empty((len(h), DIM + 1), h.dtype)
    v1[:, :DIM] = kv[:, DIM:]
    v1[:, DIM] = real

    def seen(x: np.ndarray) -> np.ndarray:
        row, col = x.strides
        return np.lib.stride_tricks.as_strided(x, (w, T, x.shape[1]), (SPAN * row, row, col), writeable=False)

    k = np.ascontiguousarray(seen(kv[:, :DIM]).transpose(0, 2, 1))
    return _attend(p, h[CONTEXT:], k, seen(v1), far, opens)[0]


def _attend(p: dict[str, np.ndarray], own: np.ndarray, k: np.ndarray, v1: np.ndarray, far: np.ndarray, opens: np.ndarray | None = None):
    q = own @ (p["q"] * own.dtype.type(DIM**-0.5))
    a = q.reshape(-1, SPAN, DIM) @ k
    a += far
    np.clip(a, -np.inf, LIMIT, out=a)
    np.exp(a, out=a)
    if opens is not None:
        a[opens, :, :CONTEXT] = 0  # the places before are another text's
    o1 = (a @ v1).reshape(-1, DIM + 1)
    total = np.maximum(o1[:, DIM:], own.dtype.type(1e-30))
    o = o1[:, :DIM] / total
    h1, h2 = _and_one(len(own), own.dtype), _and_one(len(own), own.dtype)
    np.add(own, o @ p["out"], out=h1[:, :DIM])
    r = h1 @ np.concatenate([p["w1"], p["b1"][None]])
    np.clip(r, 0, np.inf, out=r)
    np.add(h1[:, :DIM], r @ p["w2"], out=h2[:, :DIM])
    z = h2 @ np.concatenate([p["wc"], p["bc"][None]])
    return z, (own, q, k, v1, a, total, o, h1, r, h2)


def log_probs(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural logarithms of the targets' probabilities; z is overwritten."""
    np.clip(z, -LIMIT, LIMIT, out=z)
    got = z.ravel().take(np.arange(0, z.size, OUT) + target)
    np.exp(z, out=z)
    return got - np.log(z @ np.ones(OUT, z.dtype))


def _over_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x.T @ y of many rows (a multiple of 8) and few columns: quicker in blocks of rows."""
    return (x.reshape(8, -1, x.shape[1]).transpose(0, 2, 1) @ y.reshape(8, -1, y.shape[1])).sum(axis=0)


def gradients(p: dict[str, np.ndarray], words: Words, win: np.ndarray, target: np.ndarray):
    """Of the mean negative log probability.  win: (windows, T) places in words, -1 for none; targets under 0 don't count.

    Returns dense gradients, and for each table of vectors (rows, gradients).
    """
    real = (win >= 0).astype(p["q"].dtype)
    table = np.concatenate([words.vectors(p), np.zeros((1, DIM), p["q"].dtype)])
    h0 = table.take(win, axis=0, mode="wrap")
    far = bias(p)
    z, (own, q, k, v1, a, total, o, h1, r, h2) = forward(p, h0, real, far)
    w = len(win)
    flat = target.ravel()
    use = flat >= 0
    np.clip(z, -LIMIT, LIMIT, out=z)
    g = np.exp(z, out=z)
    share = (use / max(1, use.sum())).astype(g.dtype)
    mass = g @ np.ones(OUT, g.dtype)
    g.ravel()[np.arange(0, g.size, OUT) + np.maximum(flat, 0)] -= mass
    share = (share / mass)[:, None]  # of each row, which its narrower factors take
    both = _over_rows(h2 * share, g)
    out = {"wc": both[:DIM], "bc": both[DIM]}
    d2 = g @ p["wc"].T
    d2 *= share
    out["w2"] = _over_rows(r, d2)
    dr = d2 @ p["w2"].T
    dr *= r > 0
    both = _over_rows(h1, dr)
    out["w1"], out["b1"] = both[:DIM], both[DIM]
    d1 = d2 + dr @ p["w1"].T
    out["out"] = _over_rows(o, d1)
    do1 = np.empty((len(own), DIM + 1), h0.dtype)  # of the unnormalised sums
    np.divide(d1 @ p["out"].T, total, out=do1[:, :DIM])
    np.einsum("ij,ij->i", do1[:, :DIM], o, out=do1[:, DIM])
    np.negative(do1[:, DIM], out=do1[:, DIM])
    do1 = do1.reshape(w, SPAN, DIM + 1)
    dkv = np.empty((w, T, 2 * DIM), h0.dtype)
    np.matmul(a.transpose(0, 2, 1), do1[..., :DIM], out=dkv[..., DIM:])  # what falls to no word is dropped below
    ds = do1 @ np.ascontiguousarray(v1.transpose(0, 2, 1))
    ds *= a
    scale = h0.dtype.type(DIM**-0.5)
    dq = (ds @ np.ascontiguousarray(k.transpose(0, 2, 1))).reshape(-1, DIM)
    np.matmul(ds.transpose(0, 2, 1), q.reshape(w, SPAN, DIM), out=dkv[..., :DIM])
    out["far"] = np.bincount(_FAR, weights=ds.sum(axis=0)[_SEEN], minlength=T).astype(h0.dtype)
    out["q"] = _over_rows(own, dq) * scale
    dkv = dkv.reshape(-1, 2 * DIM)
    out["kv"] = _over_rows(h0.reshape(-1, DIM), dkv)
    d0 = (dkv @ p["kv"].T).reshape(h0.shape)
    d0[:, CONTEXT:] += (d1 + dq @ (p["q"].T * scale)).reshape(w, SPAN, DIM)
    place = win.ravel()
    of_word = summed(place + 1, d0.reshape(-1, DIM), len(words.first) + 1)[1:]
    more = words.further()
    rest = np.concatenate([row for _, row in more]) if more else words.ids[:0]
    of_rest = np.concatenate([of_word[at] for at, _ in more]) if more else of_word[:0]
    return out, {"first": by_row(words.first, of_word, len(p["first"])), "rest": by_row(rest, of_rest, len(p["rest"]))}


class Adam:
    """One shard's training: the tables' rows are only touched where a batch has them."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.t, self.seen = rate, 0, 0
        # all but the tables are one vector, which their arrays are views of
        self.names = [k for k in SHAPES if k not in ("first", "rest")]
        flat, at = np.concatenate([p[k].ravel() for k in self.names]), 0
        self.p = {k: p[k].copy() for k in ("first", "rest")} | {"": flat}
        for k in self.names:
            self.p[k] = flat[at : at + p[k].size].reshape(p[k].shape)
            at += p[k].size
        self.m = {k: np.zeros_like(self.p[k]) for k in ("first", "rest", "")}
        self.s = {k: np.zeros_like(self.p[k]) for k in ("first", "rest", "")}

    def step(self, words: Words, win: np.ndarray, target: np.ndarray) -> None:
        here, win = words.within(win)
        dense, rows = gradients(self.p, here, win, target)
        self.t += 1
        self.seen += len(win)
        rate = np.float32(self.rate / (1 - 0.9**self.t))
        upto = np.float32(1 / (1 - 0.99**self.t))
        for k, (at, g) in (rows | {"": (..., np.concatenate([dense[k].ravel() for k in self.names]))}).items():
            m, s = (self.m[k], self.s[k]) if at is ... else (self.m[k].take(at, axis=0), self.s[k].take(at, axis=0))
            m = m + np.float32(0.1) * (g - m)
            s = s + np.float32(0.01) * (g * g - s)
            self.m[k][at], self.s[k][at] = m, s
            self.p[k][at] -= rate * m / (np.sqrt(s * upto) + np.float32(1e-6))


def windows(n: np.ndarray):
    """For texts of n words: (text, first place of the SPAN) of each window; place j predicts word j, place n the end."""
    m = -(-(n + 1) // SPAN)
    doc = np.repeat(np.arange(len(n)), m)
    nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    return doc, nth * SPAN


def window_words(seq: np.ndarray, first: np.ndarray, n: np.ndarray, doc: np.ndarray, at: np.ndarray, target: np.ndarray, end: int):
    """(win, goals, places) of windows.

    seq: words of all texts, each text led by the start word; first: where each
    text begins in it; target: the class of each of its places.  Place j of a text holds its
    j-th word (0: the start) and predicts word j + 1.
    """
    place = at[:, None] + np.arange(-CONTEXT, SPAN)
    inside = (place >= 0) & (place <= n[doc][:, None])
    flat = np.where(inside, first[doc][:, None] + place, 0)
    win = np.where(inside, seq.take(flat), -1)
    q = flat[:, CONTEXT:]
    use = inside[:, CONTEXT:]
    last = place[:, CONTEXT:] == n[doc][:, None]
    nxt = np.minimum(q + 1, len(seq) - 1)
    goal = np.where(use, np.where(last, end, target.take(nxt)), -1)
    return win, goal, q


def score_places(p: dict[str, np.ndarray], words: Words, seq: np.ndarray, first: np.ndarray, n: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 P(class of what follows) at each place of seq."""
    table = np.concatenate([words.vectors(p), np.zeros((1, DIM), p["q"].dtype)])
    far = bias(p)
    _, at = windows(n)
    opens = at == 0
    # each text fills up its last window: windows are neighbours, and look back over the places before
    begin = np.flatnonzero(opens) * SPAN
    place = np.arange(len(seq)) + np.repeat(begin - first, n + 1)
    laid = np.full(CONTEXT + len(at) * SPAN, -1)
    laid[CONTEXT + place] = seq
    goal = np.zeros(len(at) * SPAN, np.int64)
    goal[place] = np.r_[target[1:], CLASSES] if len(seq) else target
    goal[begin + n] = CLASSES
    got = np.empty(len(goal), p["q"].dtype)
    for i in range(0, len(at), BATCH):
        j = min(i + BATCH, len(at))
        here = laid[i * SPAN : CONTEXT + j * SPAN]
        z = forward_along(p, table.take(here, axis=0, mode="wrap"), here >= 0, far, opens[i:j])
        got[i * SPAN : j * SPAN] = log_probs(z, goal[i * SPAN : j * SPAN])
    return got[place].astype(np.float64) / math.log(10)
