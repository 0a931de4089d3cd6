"""A gated recurrent language model in numpy, with a class-factored output softmax.

Word ids are ranks by frequency.  A word's probability is that of its class of
`SLOTS` ids times its share within the class, so the cost of a token is the number
of classes plus the slots of one class.  Training is by truncated back-propagation:
windows of a few steps, with the state carried from one to the next and put to zero
where a document begins; every word of every document is trained once.  Scoring
carries the state through the whole document.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

SLOTS = 64
#: Windows that are taken as one where a few long documents are left.
LONGER = 16
F32 = np.float32


class Moments:
    """Adam's running moments of the gradients."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.first, self.second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        self.turn = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float, words: int) -> None:
        """Move `p` against the gradients of `words` words, whose mean has a norm of 1 at most."""
        self.turn += 1
        scale = F32(1 / max(1, words))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values())) * scale
        scale *= F32(min(1.0, 1.0 / (norm + 1e-6)))
        speed = F32(rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn))
        for k, v in p.items():
            d, m, s = g[k] * scale, self.first[k], self.second[k]
            m += F32(0.1) * (d - m)
            s += F32(0.001) * (d * d - s)
            v -= speed * m / (np.sqrt(s) + F32(1e-8))


@dataclass
class Gru:
    """Parameters: embedding, input, recurrent, class and word weights, with biases."""

    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, shares: np.ndarray, hidden: int, seed: int = 11) -> Gru:
        """Small random weights; biases that give each id its share before anything is learnt."""
        rng = np.random.Generator(np.random.PCG64(seed))
        n = len(shares)
        classes = n // SLOTS
        by_class = shares.reshape(classes, SLOTS)
        total = by_class.sum(axis=1)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(F32)

        p = {"e": draw(n, hidden) * F32(np.sqrt(n) * 0.3), "w": draw(hidden, 3 * hidden), "u": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, F32)}
        p |= {"cw": draw(hidden, classes) * F32(0.1), "cb": np.log(total).astype(F32), "ww": draw(hidden, n).reshape(hidden, classes, SLOTS).transpose(1, 0, 2).copy() * F32(0.1), "wb": np.log(by_class / total[:, None]).astype(F32)}
        return cls(p)

    @property
    def hidden(self) -> int:
        return self.p["e"].shape[1]

    def gates(self, weights: np.ndarray) -> np.ndarray:
        """Columns of the three gates (update, reset, candidate) apart, each in one piece of memory."""
        return np.ascontiguousarray(weights.reshape(len(weights), 3, self.hidden).transpose(1, 0, 2))

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state from projected inputs and recurrent weights, by gates; and gates for training."""
        a = np.matmul(h, u)
        zr = x[:2] + a[:2]
        zr *= F32(0.5)
        np.tanh(zr, out=zr)
        zr *= F32(0.5)
        zr += F32(0.5)
        c = zr[1] * a[2]
        c += x[2]
        np.tanh(c, out=c)
        new = h - c
        new *= zr[0]
        new += c
        return new, zr, c, a[2]

    def _shares(self, states: np.ndarray, weights: np.ndarray, biases: np.ndarray, edges: np.ndarray, picked: np.ndarray, g: tuple | None) -> tuple[np.ndarray, np.ndarray | None]:
        """log softmax of each row's `picked` output; rows `edges[c]:edges[c + 1]` take the weights c."""
        logits = np.empty((len(states), weights.shape[2]), states.dtype)
        groups = [(c, slice(edges[c], edges[c + 1])) for c in np.flatnonzero(np.diff(edges)).tolist()]
        for c, part in groups:
            np.matmul(states[part], weights[c], out=logits[part])
            logits[part] += biases[c]
        if np.abs(weights).sum(axis=1).max() + np.abs(biases).max() > 60:  # else no exponential can overflow: states are within 1
            logits -= logits.max(axis=1, keepdims=True)
        rows = np.arange(len(states))
        out = logits[rows, picked]
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        out -= np.log(total)
        if g is None:
            return out, None
        logits /= total[:, None]
        logits[rows, picked] -= 1
        back = np.empty_like(states)
        for c, part in groups:
            g[0][c] += states[part].T @ logits[part]
            g[1][c] += np.ones(part.stop - part.start, logits.dtype) @ logits[part]
            np.matmul(logits[part], weights[c].T, out=back[part])
        return out, back

    def log_shares(self, states: np.ndarray, ids: np.ndarray, gradients: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each id's probability after its state; with `gradients`, those are added up and the states' returned."""
        p, g, n = self.p, gradients, len(ids)
        kind, slot = np.divmod(ids, SLOTS)
        order = np.argsort(kind.astype(np.min_scalar_type(len(p["ww"]))), kind="stable")  # by radix, where numbers are small
        edges = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=len(p["ww"])))])
        out, back = self._shares(states, p["cw"][None], p["cb"][None], np.array([0, n]), kind, g and (g["cw"][None], g["cb"][None]))
        inner, after = self._shares(states[order], p["ww"], p["wb"], edges, slot[order], g and (g["ww"], g["wb"]))
        out[order] += inner
        if g:
            back[order] += after
        return out, back

    def lost(self, ids: np.ndarray, fresh: np.ndarray, inside: np.ndarray, before: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """(gradients, last state, log probability) of one window: steps x lanes of ids.

        `fresh` marks first words of documents, which follow a zero state, and `inside`
        the places that lanes still have; `before` are the words in front of the window.
        """
        p, n = self.p, self.hidden
        steps, lanes = ids.shape
        g = {k: np.zeros_like(v) for k, v in p.items()}
        inputs = np.concatenate([before[None], ids[:-1]]).ravel()
        there = np.bincount(inputs, minlength=len(p["e"])) > 0
        words, inverse = np.flatnonzero(there), (np.cumsum(there) - 1)[inputs]
        x = self.gates(p["e"][words] @ p["w"] + p["b"]).take(inverse, axis=1).reshape(3, steps, lanes, n)
        u = self.gates(p["u"])
        live = (~fresh)[:, :, None].astype(x.dtype)
        ends = fresh.any(axis=1)
        old, c, a, states = (np.empty((steps, lanes, n), x.dtype) for _ in range(4))
        zr = np.empty((2, steps, lanes, n), x.dtype)
        for t in range(steps):
            old[t] = h
            h, zr[:, t], c[t], a[t] = self.step(x[:, t], h, u)
            if ends[t]:
                h = h * live[t]
            states[t] = h
        if inside.all():
            logs, back = self.log_shares(states.reshape(-1, n), ids.ravel(), g)
            back = back.reshape(states.shape)
        else:
            logs, some = self.log_shares(states[inside], ids[inside], g)
            back = np.zeros_like(states)
            back[inside] = some
        z, r = zr
        by_c = (1 - z) * (1 - c * c)
        by = np.empty_like(x)  # of a state's gradient, what the gates' recurrent inputs get
        by[0] = (old - c) * z * (1 - z)
        np.multiply(by_c, r, out=by[2])
        np.multiply(by[2], a * (1 - r), out=by[1])
        da, dhs, dh, turned = np.empty_like(x), np.empty_like(states), np.zeros((lanes, n), x.dtype), np.ascontiguousarray(u.transpose(0, 2, 1))
        for t in range(steps - 1, -1, -1):
            dh = np.add(dh, back[t], out=dhs[t])
            if ends[t]:
                dh *= live[t]
            d = np.multiply(by[:, t], dh, out=da[:, t])
            through = np.matmul(d, turned)
            dh = dh * z[t]
            for gate in through:
                dh += gate
        g["u"] += np.concatenate(old.reshape(-1, n).T @ da.reshape(3, -1, n), axis=1)
        np.multiply(by_c, dhs, out=da[2])
        order = np.argsort(inverse.astype(np.min_scalar_type(len(words))), kind="stable")
        sorted_by_word = np.concatenate(da.reshape(3, -1, n).take(order, axis=1), axis=1)
        by_word = np.add.reduceat(sorted_by_word, np.concatenate([[0], np.cumsum(np.bincount(inverse))[:-1]]), axis=0)
        g["b"] += by_word.sum(axis=0)
        g["w"] += p["e"][words].T @ by_word
        g["e"][words] = by_word @ p["w"].T
        return g, h, float(logs.sum())

    def train(self, documents: list[np.ndarray], rate: float = 4e-3, window: int = 16, most: int = 512, moments: Moments | None = None) -> Gru:
        """Adam over windows of all words of all documents, by truncated back-propagation.

        Documents follow each other in lanes, each in the shortest so far.  A lane that
        ends drops out, so lanes of any lengths are trained to their ends and nothing is
        padded; where few are left, windows are up to `LONGER` times as long, so that an
        update still has many words.  There are as many lanes, up to `most`, as leave some 64 windows in each.
        """
        documents = [d for d in documents if len(d)]
        if not documents:
            return self
        moments = moments or Moments(self.p)
        total = sum(map(len, documents))
        lanes = max(1, min(most, len(documents), total // (64 * window)))
        streams: list[list[np.ndarray]] = [[] for _ in range(lanes)]
        sizes = [(0, k) for k in range(lanes)]
        for d in documents:
            size, k = heapq.heappop(sizes)
            streams[k].append(d)
            heapq.heappush(sizes, (size + len(d), k))
        streams.sort(key=lambda s: -sum(map(len, s)))
        length = np.array([sum(map(len, s)) for s in streams])
        begin = np.cumsum(length) - length
        rows = [d for s in streams for d in s]
        ids, fresh = np.concatenate(rows), np.zeros(total, dtype=bool)
        fresh[np.cumsum([0, *map(len, rows[:-1])])] = True
        h, before = np.zeros((lanes, self.hidden), F32), np.zeros(lanes, dtype=np.int64)
        at = 0
        while at < length[0]:
            live = int(np.searchsorted(-length, -at, side="left"))  # lanes longer than `at`
            steps = min(window * min(LONGER, lanes // live), int(length[0]) - at)
            step = np.arange(at, at + steps)[:, None]
            inside, place = step < length[:live], step + begin[:live]
            w, new = np.where(inside, ids.take(place, mode="clip"), 0), inside & fresh.take(place, mode="clip")
            g, h, _ = self.lost(w, new, inside, before[:live], h[:live])
            moments.step(self.p, g, rate, int(inside.sum()))
            before = w[-1]
            at += steps
        return self

    def score(self, ids: np.ndarray, bounds: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Natural log probability of each document `ids[bounds[i]:bounds[i + 1]]`, its state carried to its end.

        Documents go side by side, the longest first; outputs are worked out for
        blocks of states, so memory follows the block and not the longest document.
        """
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        begin, left = bounds[:-1][order], size[order]
        out = np.zeros(len(size))
        table, u = self.gates(self.p["e"] @ self.p["w"] + self.p["b"]), self.gates(self.p["u"])
        lanes = int((left > 0).sum())
        h = np.zeros((lanes, self.hidden), F32)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = t = 0

        def flush() -> None:
            states, words = np.concatenate([s for s, _ in held]), np.concatenate([w for _, w in held])
            logs = self.log_shares(states, words)[0]
            at = 0
            for s, _ in held:
                out[order[: len(s)]] += logs[at : at + len(s)]
                at += len(s)
            held.clear()

        while lanes:
            words = ids[begin[:lanes] + t]
            held.append((h, words))
            n += lanes
            if n >= block:
                flush()
                n = 0
            t += 1
            lanes = int(np.searchsorted(-left[:lanes], -t, side="left"))  # those longer than t
            if lanes:
                h = self.step(table.take(words[:lanes], axis=1), h[:lanes], u)[0]
        if held:
            flush()
        return out
