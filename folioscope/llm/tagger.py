"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by back-propagation, decoding by Viterbi.

Tags are O and, for each kind, B (first character) and I (later ones); I follows only B or I of its kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
#: Characters with an input of their own; digits share one, as do other letters by case, accented letters and all else.
_OWN = "@.-+()[]{}/:_,;#= \n\t%\"'"
#: Letters, in either case, that addresses are spelled out with.
_SPELLED = "atdo"
INPUTS = len(_OWN) + 5 + len(_SPELLED)
_TABLE = np.full(128, len(_OWN) + 4, np.int64)
_TABLE[[ord(c) for c in _OWN]] = np.arange(len(_OWN))
_TABLE[48:58], _TABLE[65:91], _TABLE[97:123] = len(_OWN), len(_OWN) + 1, len(_OWN) + 2
for _i, _c in enumerate(_SPELLED):
    _TABLE[[ord(_c), ord(_c.upper())]] = len(_OWN) + 5 + _i
NEVER = -1e4
#: Weight of the loss of each character by itself, beside that of the whole path.
ALONE = 0.5


def encode(text: str) -> np.ndarray:
    """Input numbers of a text's characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], len(_OWN) + 3)


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """0 or NEVER for each step from a tag to the next, and for each first tag."""
    step, first = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        step[[t for t in range(TAGS) if t not in (inside - 1, inside)], inside] = NEVER
        first[inside] = NEVER
    return step, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """wx, wh, b of the forward and the backward LSTM, the output layer and the transitions."""

    params: dict[str, np.ndarray]
    hidden: int

    @staticmethod
    def new(hidden: int, seed: int) -> Tagger:
        rng, p = np.random.default_rng(seed), {}
        for way in "fb":
            p["x" + way] = rng.normal(0, 0.3, (INPUTS, 4 * hidden))
            p["h" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            p["c" + way] = np.r_[np.ones(hidden), np.zeros(3 * hidden)]  # the forget gate begins open
        p["out"], p["bias"], p["trans"], p["start"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        return Tagger(p, hidden)

    def _run(self, way: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (T, B, H) of the inputs (B, T), and what the backward pass needs."""
        p, n, (rows, steps) = self.params, self.hidden, x.shape
        inputs, inner = p["x" + way] + p["c" + way], p["h" + way]
        h, c = np.zeros((rows, n), inner.dtype), np.zeros((rows, n), inner.dtype)
        out, kept = np.empty((steps, rows, n), inner.dtype), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inputs[x[:, t]] + h @ inner
            gates, cell = 0.5 * np.tanh(0.5 * z[:, : 3 * n]) + 0.5, np.tanh(z[:, 3 * n :])
            old, c = c, gates[:, :n] * c + gates[:, n : 2 * n] * cell
            shown = np.tanh(c)
            kept.append((t, h, old, gates, cell, shown))
            h = gates[:, 2 * n :] * shown
            out[t] = h
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (T, TAGS, B) of the inputs (T, B), in single precision; sigmoids are halved tangents of half their argument."""
        p, n, (steps, rows) = self.params, self.hidden, x.shape
        scale = np.r_[np.full(3 * n, 0.5), np.ones(n)]
        scores = np.empty((steps, TAGS, rows), np.float32)
        scores[:] = p["bias"][:, None]
        for k, way in enumerate("fb"):
            inputs = np.ascontiguousarray(((p["x" + way] + p["c" + way]) * scale).T.astype(np.float32))
            inner = np.ascontiguousarray((p["h" + way] * scale).T.astype(np.float32))
            out = np.ascontiguousarray(p["out"][k * n : (k + 1) * n].T.astype(np.float32))
            h, c = np.zeros((n, rows), np.float32), np.zeros((n, rows), np.float32)
            z, here = np.empty((4 * n, rows), np.float32), np.empty((4 * n, rows), np.float32)
            gates, forget, let_in, show, cell = z[: 3 * n], z[:n], z[n : 2 * n], z[2 * n : 3 * n], z[3 * n :]
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                np.dot(inner, h, out=z)
                z += np.take(inputs, x[t], axis=1, out=here)
                np.tanh(z, out=z)
                gates *= 0.5
                gates += 0.5
                c *= forget
                let_in *= cell
                c += let_in
                np.tanh(c, out=h)
                h *= show
                scores[t] += out @ h
        return scores

    def safe(self) -> tuple[float, float, float]:
        """(margin, fixed, each): where O leads all other tags by more than the margin, no best path has another tag, but perhaps for the
        last ``(fixed + over) / each`` such characters before one where O doesn't lead so, with over what an inner tag scores there above
        a first one of its kind.

        Another tag there loses the margin each time and wins no more than the transitions' lead over staying O; a span that ends later
        than it must wins nothing; one that begins earlier, or goes on from one before, wins that much at the next character.
        """
        p, inner = self.params, np.arange(2, TAGS, 2)
        trans = p["trans"] + allowed()[0]
        lead = max(0.0, float(trans.max() - trans[0, 0]))
        first = max(0.0, float(p["start"].max() - p["start"][0]))
        margin = max(2 * lead, lead + first) + 1.0
        onward = max(0.0, max(float(trans[k, n] - trans[k - 1, n]) for k in inner for n in range(TAGS) if trans[k, n] > NEVER / 2))
        change = max(0.0, float(trans[0, 0] - trans[1:, 0].min())) + max(0.0, float(trans[0, 0] - trans[0, inner - 1].min()))
        return margin, onward + change + lead, margin - lead

    def decode(self, stretches: list[np.ndarray], begins: list[bool], ends: list[bool], rows: int = 256) -> list[np.ndarray]:
        """The best tags of each stretch of emissions (T, TAGS); where it begins or ends no text, an O stands before or behind it."""
        step, first = allowed()
        step, first = step + self.params["trans"], first + self.params["start"]
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        for a in range(0, len(order), rows):
            part = order[a : a + rows]
            length = np.array([len(stretches[i]) for i in part])
            e = np.zeros((len(part), length.max(), TAGS))
            for k, i in enumerate(part):
                e[k, : length[k]] = stretches[i]
            score = np.where(np.array([begins[i] for i in part])[:, None], first, step[0]) + e[:, 0]
            back = np.tile(np.arange(TAGS, dtype=np.int8), (e.shape[1], len(part), 1))
            for t in range(1, e.shape[1]):
                both = score[:, :, None] + step
                on = (t < length)[:, None]
                back[t] = np.where(on, both.argmax(1), back[t])
                score = np.where(on, both.max(1) + e[:, t], score)
            score += np.where(np.array([ends[i] for i in part])[:, None], 0.0, step[:, 0])
            tags = np.empty((len(part), e.shape[1]), np.int64)
            tags[:, -1] = score.argmax(1)
            for t in range(e.shape[1] - 1, 0, -1):
                tags[:, t - 1] = back[t, np.arange(len(part)), tags[:, t]]
            for k, i in enumerate(part):
                found[i] = tags[k, : length[k]]
        return found

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Loss a row, and gradients by emissions (T, B, TAGS), transitions and start; forward and backward sums are scaled at each step."""
        step, first = allowed()
        step, first = step + self.params["trans"], first + self.params["start"]
        steps, rows, _ = e.shape
        top = e.max(2, keepdims=True)
        w, move = np.exp(e - top), np.exp(step).astype(e.dtype)
        a, b, scale = np.empty_like(e), np.ones_like(e), np.empty((steps, rows, 1), e.dtype)
        for t in range(steps):
            a[t] = w[t] * (np.exp(first).astype(e.dtype) if t == 0 else a[t - 1] @ move)
            scale[t] = a[t].sum(1, keepdims=True)
            a[t] /= scale[t]
        ahead = w / scale
        for t in range(steps - 2, -1, -1):
            b[t] = (ahead[t + 1] * b[t + 1]) @ move.T
        total = float(np.log(scale).sum() + top.sum())
        grad = a * b
        start = grad[0].sum(0)
        trans = move * np.tensordot(a[:-1], (ahead * b)[1:], ([0, 1], [0, 1]))
        spot, at = np.arange(steps)[:, None], np.arange(rows)[None, :]
        gold = float(first[y[:, 0]].sum() + e[spot, at, y.T].sum() + step[y[:, :-1], y[:, 1:]].sum())
        grad[spot, at, y.T] -= 1
        np.subtract.at(start, y[:, 0], 1)
        np.subtract.at(trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        # each character's own tag is learned too, so that emissions alone tell how sure the network is
        share = w.sum(2, keepdims=True)
        own = w / share
        own[spot, at, y.T] -= 1
        gold += ALONE * float((e - top - np.log(share))[spot, at, y.T].sum())
        return (total - gold) / rows, (grad + ALONE * own) / rows, trans / rows, start / rows

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss a row of the inputs x and tags y (B, T), and the gradients of all parameters."""
        p, n = self.params, self.hidden
        runs = {way: self._run(way, x) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        inputs = (x.T[:, :, None] == np.arange(INPUTS)).astype(both.dtype)
        loss, de, trans, start = self._crf(both @ p["out"] + p["bias"], y)
        g = {"trans": trans, "start": start, "out": np.tensordot(both, de, ([0, 1], [0, 1])), "bias": de.sum((0, 1))}
        dboth = de @ p["out"].T
        for k, way in enumerate("fb"):
            back = np.ascontiguousarray(p["h" + way].T)
            dh, dc = np.zeros((len(x), n), both.dtype), np.zeros((len(x), n), both.dtype)
            dz, before = np.empty((x.shape[1], len(x), 4 * n), both.dtype), np.empty((x.shape[1], len(x), n), both.dtype)
            for t, h, old, gates, cell, shown in reversed(runs[way][1]):
                dh = dh + dboth[t, :, k * n : (k + 1) * n]
                dc = dc + dh * gates[:, 2 * n :] * (1 - shown**2)
                now = dz[t]
                now[:, :n], now[:, n : 2 * n], now[:, 2 * n : 3 * n] = dc * old, dc * cell, dh * shown
                now[:, : 3 * n] *= gates * (1 - gates)
                now[:, 3 * n :] = dc * gates[:, n : 2 * n] * (1 - cell**2)
                before[t] = h
                dh, dc = now @ back, dc * gates[:, :n]
            g["x" + way] = np.tensordot(inputs, dz, ([0, 1], [0, 1]))
            g["h" + way] = np.tensordot(before, dz, ([0, 1], [0, 1]))
            g["c" + way] = dz.sum((0, 1))
        return loss, g


def train(x: np.ndarray, y: np.ndarray, hidden: int = 12, steps: int = 1500, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
    """Fit to inputs x and tags y (N, T) by Adam with a falling rate, in single precision."""
    model, rng = Tagger.new(hidden, seed), np.random.default_rng(seed)
    model.params = {k: a.astype(np.float32) for k, a in model.params.items()}
    m, v = ({k: np.zeros_like(a) for k, a in model.params.items()} for _ in range(2))
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        _, g = model.gradients(x[rows], y[rows])
        norm = float(np.sqrt(sum((a.astype(float) ** 2).sum() for a in g.values())))
        now = rate * (1 - 0.95 * t / steps)
        for k, a in g.items():
            a = a.astype(np.float32) * np.float32(min(1.0, 5 / max(norm, 1e-9)))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            model.params[k] = model.params[k] - np.float32(now) * (m[k] / np.float32(1 - 0.9**t)) / (np.sqrt(v[k] / np.float32(1 - 0.99**t)) + np.float32(1e-8))
    return model
