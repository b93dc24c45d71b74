"""A gated recurrent language model in numpy with a class-factored output softmax.

P(token) = P(class | state) * P(token | class, state). Trained by backpropagation truncated at window
ends, the state being carried from window to window; scored the same way, without truncating a document.
"""

from __future__ import annotations

import ctypes
import heapq

import numpy as np

WINDOW = 32
#: Bytes of freed memory that a worker keeps.
KEPT = 64 << 20
#: Documents that are trained on side by side.
LANES = 256
#: Added to the root of the mean square of gradients: a token that occurs in few steps is not moved by the full rate in all others.
DAMP = 1e-5


def keep_freed_memory() -> None:
    """Let the C library keep the memory that a window's arrays free for the next one, up to KEPT bytes, in place of having the
    kernel clear new pages for each: a quarter of the time of training. Other C libraries are left as they are."""
    try:
        call = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    call(-1, KEPT)  # the trim threshold
    call(-3, KEPT)  # the least size that is mapped by itself


def laid_out(docs: list[np.ndarray], lanes: int, as_given: bool = False) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Documents in lanes of about equal length, longest lane first: their order, and where each lane begins and how long it is.

    A lane's documents run longest first, or in the order given.
    """
    lanes = max(1, min(lanes, len(docs)))
    heads: list[list[int]] = [[] for _ in range(lanes)]
    load = [(0, k) for k in range(lanes)]
    for d in np.argsort([-len(x) for x in docs], kind="stable"):
        n, k = heapq.heappop(load)
        heads[k].append(int(d))
        heapq.heappush(load, (n + len(docs[d]), k))
    size = {k: n for n, k in load}
    by_size = sorted(range(lanes), key=lambda k: -size[k])
    long = np.array([size[k] for k in by_size])
    return [d for k in by_size for d in (sorted(heads[k]) if as_given else heads[k])], np.append(0, np.cumsum(long)[:-1]), long


def starts(docs: list[np.ndarray], order: list[int]) -> np.ndarray:
    """Which tokens of the documents in this order begin one."""
    lengths = np.array([len(docs[d]) for d in order], np.int64)
    fresh = np.zeros(lengths.sum(), bool)
    fresh[np.append(0, np.cumsum(lengths)[:-1])[lengths > 0]] = True
    return fresh


class Model:
    """Tokens 0..n-1 in order of class; bounds: the first token of each class, and n."""

    #: Where training sums up gradients.
    sums: dict | None = None
    NAMES = ("embed", "wx", "wh", "b", "wc", "bc", "wo", "bo")

    def __init__(self, counts: np.ndarray, bounds: np.ndarray, width: int, seed: int = 1) -> None:
        self.bounds, n, c = bounds, len(counts), len(bounds) - 1
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 else 1)).astype(np.float32)
        mass = np.maximum(counts, 0.5).astype(np.float64)
        total = np.add.reduceat(mass, bounds[:-1])
        # small integers are sorted by their digits
        self.of = np.repeat(np.arange(c), np.diff(bounds)).astype(np.uint8 if c <= 256 else np.uint16 if c <= 65536 else np.int64)
        # without its state the model is the unigram model
        self.p = {
            "embed": draw(n, width) * np.float32(np.sqrt(n) * 0.3), "wx": draw(width, 3 * width), "wh": draw(width, 3 * width), "b": np.zeros(3 * width, np.float32),
            "wc": draw(width, c) * np.float32(0.05), "bc": np.log(total / total.sum()).astype(np.float32),
            "wo": np.zeros((n, width), np.float32), "bo": np.log(mass / total[self.of]).astype(np.float32),
        }
        self.width = width

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters by name, as views of a flat array."""
        out, at = {}, 0
        for k in self.NAMES:
            size = self.p[k].size
            out[k] = flat[at : at + size].reshape(self.p[k].shape)
            at += size
        return out

    def load(self, flat: np.ndarray) -> None:
        self.p = self.views(flat.astype(np.float32))

    def run(self, ids: np.ndarray, h: np.ndarray, fresh: np.ndarray, keep: bool = True) -> dict[str, np.ndarray]:
        """The states of a window (steps x lanes) from h (width x lanes) on, which is zero again where fresh, and, if kept, what led to them.

        Arrays are steps x rows x lanes: a step's rows are contiguous, so that each operation runs over whole lanes.
        """
        p, w = self.p, self.width
        steps, lanes = ids.shape
        x = np.ascontiguousarray(p["embed"].take(ids, axis=0).transpose(0, 2, 1))
        gates = np.matmul(p["wx"].T, x)
        gates += p["b"][:, None]
        # what is not kept shares one step's room
        made = lambda rows: np.empty((steps, rows, lanes), gates.dtype) if keep else [np.empty((rows, lanes), gates.dtype)] * steps
        after = np.empty((steps, w, lanes), gates.dtype)
        before, zr, n, rec = (made(r) for r in (w, 2 * w, w, w))
        turn, half, one = np.ascontiguousarray(p["wh"].T), gates.dtype.type(0.5), gates.dtype.type(1)
        cut = fresh.any(axis=1)
        for t in range(steps):
            old = before[t]
            np.copyto(old, h)
            if cut[t]:
                old[:, fresh[t]] = 0
            r = turn @ old
            np.copyto(rec[t], r[2 * w :])
            # the logistic function by way of tanh
            g = np.add(gates[t, : 2 * w], r[: 2 * w], out=zr[t])
            g *= half
            np.tanh(g, out=g)
            g += one
            g *= half
            new = np.multiply(g[w:], r[2 * w :], out=n[t])
            new += gates[t, 2 * w :]
            np.tanh(new, out=new)
            h = np.subtract(old, new, out=after[t])
            h *= g[:w]
            h += new
        if not keep:
            return {"after": after}
        return {"x": x, "before": before, "z": zr[:, :w], "r": zr[:, w:], "n": n, "rec": rec, "after": after}

    def outputs(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights of classes and of tokens with their biases, and whether they are small: states lie within (-1, 1), so then no exponential overflows or vanishes."""
        p = self.p
        outer, inner = np.concatenate([p["wc"], p["bc"][None]]), np.concatenate([p["wo"], p["bo"][:, None]], axis=1)
        return outer, inner, float(max(np.abs(outer).sum(axis=0).max(), np.abs(inner).sum(axis=1).max())) < 75

    def log_probs(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None, outputs: tuple[np.ndarray, np.ndarray, bool] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of targets at states h (width x targets); with grad, also adds the loss's gradients and gives that of h.

        Targets are handled in order of their class, so that each class has a slice of them. outputs: those of the model, if they are at hand.
        """
        p, n = self.p, len(target)
        own = self.of[target]
        order = np.argsort(own, kind="stable")
        # a row of ones takes the biases into the products; taking columns is several times as fast as indexing them
        put = np.ones((len(h) + 1, n), h.dtype)
        np.take(h, order, axis=1, out=put[:-1], mode="clip")
        h, target, own = put, target[order], own[order]
        every = np.arange(n)
        outer, inner, small = outputs or self.outputs()
        e = outer.T @ h
        if not small:
            e -= e.max(axis=0)
        found = e[own, every]
        np.exp(e, out=e)
        total = e.sum(axis=0)
        found -= np.log(total)
        dh = None
        if grad is not None:
            e /= total
            e[own, every] -= 1
            g = h @ e.T
            grad["wc"] += g[:-1]
            grad["bc"] += g[-1]
            dh = p["wc"] @ e
        ends = np.searchsorted(own, np.arange(len(self.bounds)))
        total = np.ones_like(found)
        turned = None if grad is None else np.zeros_like(inner)
        for c in np.flatnonzero(np.diff(ends)):
            a, b = self.bounds[c], self.bounds[c + 1]
            if b - a == 1:
                continue
            x, y = ends[c], ends[c + 1]
            hc, at = h[:, x:y], (target[x:y] - a) * (y - x) + every[: y - x]
            e = inner[a:b] @ hc
            if not small:
                e -= e.max(axis=0)
            flat = e.reshape(-1)
            found[x:y] += flat[at]
            np.exp(e, out=e)
            e.sum(axis=0, out=total[x:y])
            if grad is not None:
                e /= total[x:y]
                flat[at] -= 1
                np.matmul(e, hc.T, out=turned[a:b])
                dh[:, x:y] += p["wo"][a:b].T @ e
        if grad is not None:
            grad["wo"] += turned[:, :-1]
            grad["bo"] += turned[:, -1]
        found -= np.log(total)
        out = np.empty_like(found)
        out[order] = found
        if dh is None:
            return out, None
        back = np.empty_like(order)
        back[order] = every
        return out, dh.take(back, axis=1)

    def backward(self, ids: np.ndarray, target: np.ndarray, valid: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
        """Gradients over one window (steps x lanes) from state h (lanes x width) on, which is zero again where fresh; the state after it; the loss per token.

        Gradients are per token; while there are sums, those of all tokens are added to them.
        """
        p, w, sums = self.p, self.width, self.sums
        steps, lanes = ids.shape
        fresh = np.zeros((steps, lanes), bool) if fresh is None else fresh
        f = self.run(ids, h.T, fresh)
        grad = {k: np.zeros_like(v) for k, v in p.items()} if sums is None else sums
        states = f["after"].transpose(1, 0, 2).reshape(w, -1)
        at = np.flatnonzero(valid.ravel())
        if len(at) == valid.size:
            logp, direct = self.log_probs(states, target.ravel(), grad)
        else:
            logp, dh = self.log_probs(states.take(at, axis=1), target.ravel()[at], grad)
            direct = np.zeros((w, steps * lanes), dh.dtype)
            direct[:, at] = dh
        kind = direct.dtype
        direct = np.ascontiguousarray(direct.reshape(w, steps, lanes).transpose(1, 0, 2))
        z, r, n = f["z"], f["r"], f["n"]
        rest = 1 - z
        to_n = n * n
        np.subtract(1, to_n, out=to_n)
        to_n *= rest
        to_z = f["before"] - n
        to_z *= z
        to_z *= rest
        to_r = 1 - r
        to_r *= r
        to_r *= f["rec"]
        into, gated = np.empty((steps, 3 * w, lanes), kind), np.empty((steps, w, lanes), kind)
        back = np.zeros((w, lanes), kind)
        cut = fresh.any(axis=1)
        first, last = np.ascontiguousarray(p["wh"][:, : 2 * w]), np.ascontiguousarray(p["wh"][:, 2 * w :])
        for t in range(steps - 1, -1, -1):
            d, i = direct[t], into[t]
            d += back
            np.multiply(d, to_z[t], out=i[:w])
            np.multiply(d, to_n[t], out=i[2 * w :])
            np.multiply(i[2 * w :], to_r[t], out=i[w : 2 * w])
            np.multiply(i[2 * w :], r[t], out=gated[t])
            back = first @ i[: 2 * w]
            back += last @ gated[t]
            d *= z[t]
            back += d
            if cut[t]:
                back[:, fresh[t]] = 0
        turned = into.transpose(0, 2, 1)
        grad["wh"][:, : 2 * w] += np.matmul(f["before"], turned[:, :, : 2 * w]).sum(axis=0)
        grad["wh"][:, 2 * w :] += np.matmul(f["before"], gated.transpose(0, 2, 1)).sum(axis=0)
        grad["b"] += np.matmul(into, np.ones(lanes, kind)).sum(axis=0)
        grad["wx"] += np.matmul(f["x"], turned).sum(axis=0)
        found = ids.ravel().astype(np.uint16 if len(p["embed"]) <= 65536 else np.int64)
        order = np.argsort(found, kind="stable")
        found = found[order]
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        each = np.matmul(p["wx"], into).transpose(0, 2, 1).reshape(-1, w)
        grad["embed"][found[starts]] += np.add.reduceat(each.take(order, axis=0), starts, axis=0)
        scale = kind.type(1 / max(1, len(at)))
        return grad if sums is not None else {k: g * scale for k, g in grad.items()}, f["after"][-1].T, -float(logp.sum()) / max(1, len(at))

    def train(self, docs: list[np.ndarray], start: int, lanes: int = LANES, rate: float = 0.02, window: int = WINDOW) -> int:
        """One pass of Adam over all tokens of docs, each from a zero state carried to its end. Tokens seen.

        A step takes half as many tokens as the first window has, at least: once the shorter lanes have ended, windows are summed
        up, so that the ends of a few very long documents do not make most of the steps.
        """
        now = self.flat()
        self.p = self.views(now)
        first, second, part = np.zeros_like(now), np.zeros_like(now), np.empty_like(now)
        steps = seen = 0
        if not sum(map(len, docs)):
            return 0
        order, begin, long = laid_out(docs, lanes, True)
        tokens, fresh = np.concatenate([docs[d] for d in order]), starts(docs, order)
        h = np.zeros((len(long), self.width), np.float32)
        summed, g, waiting = np.zeros_like(now), np.empty_like(now), 0
        self.sums = self.views(summed)
        enough = int(np.minimum(long, window).sum()) // 2
        for t in range(0, int(long[0]), window):
            live = int(np.searchsorted(-long, -t, "left"))
            at = begin[:live] + t + np.arange(min(window, int(long[0]) - t))[:, None]
            valid = at < (begin + long)[:live]
            at = np.where(valid, at, 0)
            clear = fresh[at] & valid
            target = tokens[at].astype(np.int64)
            ids = np.where(clear, start, tokens[at - 1].astype(np.int64))
            _, h, _ = self.backward(ids, target, valid, h[:live], clear)
            tokens_here = int(valid.sum())
            seen += tokens_here
            waiting += tokens_here
            if waiting < enough and t + window < long[0]:
                continue
            g = np.divide(summed, np.float32(waiting), out=g)
            summed[:] = 0
            waiting = 0
            steps += 1
            np.clip(g, -1, 1, out=g)
            part = np.subtract(g, first, out=part)
            part *= np.float32(0.1)
            first += part
            g *= g
            g -= second
            g *= np.float32(0.01)
            second += g
            part = np.sqrt(second, out=part)
            part += np.float32(DAMP)
            np.divide(first, part, out=part)
            part *= np.float32(rate * np.sqrt(1 - 0.99**steps) / (1 - 0.9**steps))
            now -= part
        self.sums = None
        return seen

    def score(self, docs: list[np.ndarray], start: int, lanes: int = 512, window: int = WINDOW) -> np.ndarray:
        """Natural log-likelihood of each whole document, its state carried across windows.

        Documents run one after the other in lanes of about equal length; a lane that has ended drops out.
        """
        lengths = np.array([len(d) for d in docs], np.int64)
        out = np.zeros(len(docs))
        if not lengths.sum():
            return out
        order, begin, long = laid_out(docs, lanes)
        target = np.concatenate([docs[d] for d in order]).astype(np.int64)
        owner = np.repeat(order, lengths[order])
        fresh = starts(docs, order)
        ids = np.append(start, target[:-1])
        ids[fresh] = start
        h, outputs = np.zeros((self.width, len(long)), np.float32), self.outputs()
        for t in range(0, int(long[0]), window):
            live = int(np.searchsorted(-long, -t, "left"))
            at = begin[:live] + t + np.arange(min(window, int(long[0]) - t))[:, None]
            valid = (at < (begin + long)[:live]).ravel()
            at = np.where(valid.reshape(at.shape), at, 0)
            states = self.run(ids[at], h[:, :live], fresh[at], keep=False)["after"]
            h = states[-1]
            pick, states = at.ravel(), states.transpose(1, 0, 2).reshape(self.width, -1)
            if not valid.all():
                pick, states = pick[valid], states.take(np.flatnonzero(valid), axis=1)
            logp, _ = self.log_probs(states, target[pick], outputs=outputs)
            out += np.bincount(owner[pick], logp, len(docs))
        return out
