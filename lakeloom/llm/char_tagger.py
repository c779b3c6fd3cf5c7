"""A character-level bidirectional LSTM with CRF transitions, in NumPy: fitting from tagged windows, and decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAD, LETTER, DIGIT, BLANK, OTHER = 0, 96, 97, 98, 99  # besides 1 to 95 for printable ASCII
CODES = 100
HIDDEN = 16
STEPS, BATCH, RATE = 320, 48, 0.02
ROWS = 512  # windows that are read side by side, so that they stay in the cache


def char_codes(text: str) -> np.ndarray:
    """The class of each character of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((points >= 32) & (points < 127), points.astype(np.int64) - 31, OTHER).astype(np.int16)
    others = np.flatnonzero(codes == OTHER)
    if len(others):
        distinct, which = np.unique(points[others], return_inverse=True)
        kinds = [LETTER if c.isalpha() else DIGIT if c.isdigit() else BLANK if c.isspace() else OTHER for c in map(chr, distinct.tolist())]
        codes[others] = np.array(kinds, np.int16)[which]
    return codes


def encoded(texts: list[str], width: int) -> np.ndarray:
    """Character classes of each text, padded to ``width``."""
    out = np.zeros((len(texts), width), np.int16)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = char_codes(text)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Tagger:
    """Weights by name; directions are the first axis of ``inputs`` and ``recurrent``: forward, backward."""

    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, tags: int, hidden: int = HIDDEN, seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        inputs = draw(2, CODES, 4 * hidden, scale=0.3)
        inputs[:, :, hidden : 2 * hidden] += 1  # forget gates start open
        return cls({"inputs": inputs, "recurrent": draw(2, hidden, 4 * hidden, scale=hidden**-0.5), "out": draw(2 * hidden, tags, scale=0.2), "bias": np.zeros(tags, np.float32), "moves": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32)})

    def _states(self, codes: np.ndarray, keep: bool):
        """Hidden states (rows, width, both directions), and what backpropagation needs."""
        w = self.weights
        hidden, (rows, width) = w["recurrent"].shape[1], codes.shape
        both = np.stack([codes, codes[:, ::-1]])
        slope = np.full(4 * hidden, 0.5, np.float32)
        slope[3 * hidden :] = 1  # tanh for the candidate, the logistic function, as a tanh, for the gates
        h, c = np.zeros((2, 2, rows, hidden), np.float32)
        out, kept = np.empty((2, rows, width, hidden), np.float32), []
        for t in range(width):
            z = np.matmul(h, w["recurrent"])
            z += np.stack([w["inputs"][d][both[d, :, t]] for d in (0, 1)])
            z *= slope
            np.tanh(z, out=z)
            z[..., : 3 * hidden] += 1
            z[..., : 3 * hidden] *= 0.5
            i, f, o, g = (z[..., k * hidden : (k + 1) * hidden] for k in range(4))
            before, c = (h, c), f * c + i * g
            told = np.tanh(c)
            h = o * told
            out[:, :, t] = h
            if keep:
                kept.append((*before, z, told))
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2), both, kept

    def _emitted(self, codes: np.ndarray) -> np.ndarray:
        """Emissions as (width, tags, rows): the gates of ``_states`` with rows last, so that they are next to each other in memory."""
        w = self.weights
        hidden, (rows, width) = w["recurrent"].shape[1], codes.shape
        slope = np.full(4 * hidden, 0.5, np.float32)
        slope[3 * hidden :] = 1
        inputs = np.ascontiguousarray((w["inputs"] * slope).transpose(0, 2, 1))
        recurrent = np.ascontiguousarray((w["recurrent"] * slope).transpose(0, 2, 1))
        told = np.ascontiguousarray(w["out"].reshape(2, hidden, -1).transpose(0, 2, 1))
        out = np.empty((width, told.shape[1], rows), np.result_type(told, w["bias"]))
        out[:] = w["bias"][:, None]
        for first in range(0, rows, ROWS):
            steps = np.ascontiguousarray(codes[first : first + ROWS].T).astype(np.intp)
            h, c = np.zeros((2, 2, hidden, steps.shape[1]), inputs.dtype)
            x = np.empty((2, 4 * hidden, steps.shape[1]), inputs.dtype)
            for t in range(width):
                for d, at in enumerate((t, width - 1 - t)):
                    np.take(inputs[d], steps[at], axis=1, out=x[d], mode="clip")
                z = np.matmul(recurrent, h)
                z += x
                np.tanh(z, out=z)
                z[:, : 3 * hidden] += 1
                i, f, o, g = (z[:, k * hidden : (k + 1) * hidden] for k in range(4))
                c *= f
                i *= g
                c += i
                c *= 0.5
                np.tanh(c, out=h)
                h *= o
                h *= 0.5
                said = np.matmul(told, h)
                out[t, :, first : first + ROWS] += said[0]
                out[width - 1 - t, :, first : first + ROWS] += said[1]
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        return self._emitted(codes).transpose(2, 0, 1)

    def _quiet(self, emitted: np.ndarray) -> np.ndarray:
        """Rows of (width, tags, rows) whose best path is outside all along for certain.

        A path gains at most the lead of its tags, what moves into, within and out of a run of tags add,
        and the ends; where that is below 0 for the first tag of a run and not above it for any further
        one, no path is as good.
        """
        w = self.weights
        moves = w["moves"] - w["moves"][0, 0]
        opens = max(0.0, float(moves[0, 1:].max())) + max(0.0, float(moves[1:, 0].max())) + float(w["first"].max() - w["first"][0] + w["last"].max() - w["last"][0])
        lead = (emitted[:, 1:].max(1) - emitted[:, 0]).max(0)
        return (lead + opens < -1e-3) & (lead + float(moves[1:, 1:].max()) < 0)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, confidence) of each character: the best path of each row, and the softmax of its emissions (1 in rows that are outside for certain)."""
        w, emitted = self.weights, self._emitted(codes)
        width, _, rows = emitted.shape
        tags, sure = np.zeros((rows, width), np.int64), np.ones((rows, width), emitted.dtype)
        read = np.flatnonzero(~self._quiet(emitted))
        if not len(read):
            return tags, sure
        emitted = np.ascontiguousarray(emitted[:, :, read].transpose(2, 0, 1))
        best, back = emitted[:, 0] + w["first"], np.empty(emitted.shape, np.int8)
        for t in range(1, width):
            step = best[:, :, None] + w["moves"]
            back[:, t] = step.argmax(1)
            best = step.max(1) + emitted[:, t]
        path = np.empty((len(read), width), np.int64)
        path[:, -1] = (best + w["last"]).argmax(1)
        for t in range(width - 1, 0, -1):
            path[:, t - 1] = np.take_along_axis(back[:, t], path[:, t, None], 1)[:, 0]
        weight = np.exp(emitted - emitted.max(2, keepdims=True))
        tags[read], sure[read] = path, np.take_along_axis(weight / weight.sum(2, keepdims=True), path[..., None], 2)[..., 0]
        return tags, sure

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the rows' tags under the CRF, and its gradients."""
        w = self.weights
        states, both, kept = self._states(codes, True)
        emitted = (states @ w["out"] + w["bias"]).astype(np.float64)
        rows, width, n = emitted.shape
        moves = w["moves"].astype(np.float64)
        ahead, behind = np.empty_like(emitted), np.empty_like(emitted)
        ahead[:, 0], behind[:, -1] = emitted[:, 0] + w["first"], w["last"]
        for t in range(1, width):
            ahead[:, t] = _log_sum(ahead[:, t - 1, :, None] + moves, 1) + emitted[:, t]
            behind[:, -1 - t] = _log_sum(moves + (emitted[:, -t] + behind[:, -t])[:, None, :], 2)
        whole = _log_sum(ahead[:, -1] + w["last"], 1)
        at = np.exp(ahead + behind - whole[:, None, None])
        pairs = np.exp(ahead[:, :-1, :, None] + moves + (emitted + behind)[:, 1:, None, :] - whole[:, None, None, None]).sum((0, 1))
        real = np.eye(n)[tags]
        score = (emitted * real).sum((1, 2)) + moves[tags[:, :-1], tags[:, 1:]].sum(1) + w["first"][tags[:, 0]] + w["last"][tags[:, -1]]
        np.subtract.at(pairs, (tags[:, :-1], tags[:, 1:]), 1)
        slope = ((at - real) / rows).astype(np.float32)
        out = {"moves": pairs / rows, "first": slope[:, 0].sum(0), "last": slope[:, -1].sum(0), "bias": slope.sum((0, 1)), "out": np.tensordot(states, slope, ((0, 1), (0, 1)))}
        out |= self._through_time(slope @ w["out"].T, both, kept)
        return float((whole - score).mean()), out

    def _through_time(self, slope: np.ndarray, both: np.ndarray, kept: list) -> dict[str, np.ndarray]:
        w = self.weights
        hidden, width = w["recurrent"].shape[1], both.shape[2]
        recurrent, slopes = np.zeros_like(w["recurrent"]), np.empty((2, width, both.shape[1], 4 * hidden), np.float32)
        due = np.stack([slope[:, :, :hidden], slope[:, ::-1, hidden:]])
        h_due, c_due = np.zeros((2, *kept[0][0].shape), np.float32)
        for t in range(width - 1, -1, -1):
            h0, c0, z, told = kept[t]
            i, f, o, g = (z[..., k * hidden : (k + 1) * hidden] for k in range(4))
            h_due = h_due + due[:, :, t]
            c_due = c_due + h_due * o * (1 - told**2)
            gates = np.concatenate([c_due * g * i * (1 - i), c_due * c0 * f * (1 - f), h_due * told * o * (1 - o), c_due * i * (1 - g**2)], axis=2)
            slopes[:, t] = gates
            recurrent += np.matmul(h0.transpose(0, 2, 1), gates)
            h_due, c_due = np.matmul(gates, w["recurrent"].transpose(0, 2, 1)), c_due * f
        met = (both.transpose(0, 2, 1).reshape(2, -1, 1) == np.arange(CODES)).astype(np.float32)
        return {"inputs": np.matmul(met.transpose(0, 2, 1), slopes.reshape(2, -1, 4 * hidden)), "recurrent": recurrent}

    def fit(self, draw, steps: int = STEPS, rate: float = RATE) -> list[float]:
        """Adam over batches that ``draw()`` gives as (codes, tags); the losses of the steps."""
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            loss, slopes = self.gradients(*draw())
            losses.append(loss)
            norm = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
            now = rate * (1 - step / (steps + 1))
            for k, g in slopes.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                self.weights[k] = (self.weights[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses
