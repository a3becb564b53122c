"""A character tagger in numpy: embeddings, a bidirectional LSTM, and a linear-chain CRF over its scores; with training."""

from __future__ import annotations

import numpy as np

#: Symbols: 0 beside a text, 1 any digit, 2 white space, 3 other letters, 4 others, then ASCII letters (as lower case) and marks.
_MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
SYMBOLS = 5 + 26 + len(_MARKS)


def _symbol(c: str) -> int:
    if c in _MARKS:
        return 31 + _MARKS.index(c)
    if c.isascii() and c.isalpha():
        return 5 + ord(c.lower()) - ord("a")
    return 1 if "0" <= c <= "9" else 2 if c.isspace() else 3 if c.isalpha() else 4


_ASCII = np.array([_symbol(chr(c)) for c in range(128)], np.int64)


def symbols(text: str) -> np.ndarray:
    """Symbol of every code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _ASCII[np.minimum(points, 127)]
    for i in np.flatnonzero(points > 127):
        out[i] = _symbol(text[i])
    return out


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    """log of the sum of exp along an axis."""
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Weights by name; windows are rows of symbols, all of one length. Gates are in the order input, forget, output, new."""

    def __init__(self, tags: int, width: int = 12, hidden: int = 24, seed: int = 7):
        make = np.random.default_rng(seed)
        normal = lambda *shape: make.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.w = {
            "embed": make.normal(0, 0.5, (SYMBOLS, width)).astype(np.float32), "into": normal(2, width, 4 * hidden), "back": normal(2, hidden, 4 * hidden), "bias": np.zeros((2, 1, 4 * hidden), np.float32),
            "out": normal(2 * hidden, tags), "base": np.zeros(tags, np.float32), "step": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32), "end": np.zeros(tags, np.float32),
        }
        self.w["bias"][:, :, hidden : 2 * hidden] = 1

    def states(self, windows: np.ndarray, keep: bool = False):
        """Hidden states (length x 2 x windows x hidden), both directions side by side: the second reads from the end. With ``keep`` gates and cells too."""
        n, length = windows.shape
        h = self.hidden
        table = np.matmul(self.w["embed"], self.w["into"]) + self.w["bias"]  # what a symbol adds to the gates
        turned = np.stack([windows.T, windows.T[::-1]], 1)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, gates, cells = np.empty((length, 2, n, h), np.float32), [], []
        for t in range(length):
            z = np.stack([table[0][turned[t, 0]], table[1][turned[t, 1]]]) + state @ self.w["back"]
            g = np.concatenate([_squash(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])], -1)
            cell = g[..., h : 2 * h] * cell + g[..., :h] * g[..., 3 * h :]
            state = g[..., 2 * h : 3 * h] * np.tanh(cell)
            states[t] = state
            if keep:
                gates.append(g)
                cells.append(cell)
        return (states, gates, cells) if keep else states

    def scores(self, states: np.ndarray) -> np.ndarray:
        """Scores of the tags (length x windows x tags)."""
        h = self.hidden
        return states[:, 0] @ self.w["out"][:h] + states[::-1, 1] @ self.w["out"][h:] + self.w["base"]

    def posteriors(self, scores: np.ndarray):
        """(log of the partition sum by window, tag chances, sums of chances of steps from tag to tag)."""
        step, ahead, behind = self.w["step"], [self.w["start"] + scores[0]], [np.broadcast_to(self.w["end"], scores[0].shape)]
        for s in scores[1:]:
            ahead.append(_total(ahead[-1][:, :, None] + step, 1) + s)
        for s in scores[:0:-1]:
            behind.append(_total(step + (behind[-1] + s)[:, None, :], 2))
        behind.reverse()
        total = _total(ahead[-1] + self.w["end"], 1)
        chances = np.exp(np.stack(ahead) + np.stack(behind) - total[:, None])
        pairs = np.zeros_like(step)
        for t in range(1, len(scores)):
            pairs += np.exp(ahead[t - 1][:, :, None] + step + (scores[t] + behind[t])[:, None, :] - total[:, None, None]).sum(0)
        return total, chances, pairs

    def chances(self, windows: np.ndarray) -> np.ndarray:
        """Chance of every tag at every place (windows x length x tags)."""
        scores = self.scores(self.states(windows))
        step, ahead, behind = np.exp(self.w["step"]), [], [np.broadcast_to(np.exp(self.w["end"]), scores[0].shape)]
        lift = np.exp(scores - scores.max(2, keepdims=True))
        scale = lambda x: x / x.sum(1, keepdims=True)
        ahead.append(scale(np.exp(self.w["start"]) * lift[0]))
        for s in lift[1:]:
            ahead.append(scale(ahead[-1] @ step * s))
        for s in lift[:0:-1]:
            behind.append(scale((behind[-1] * s) @ step.T))
        both = np.stack(ahead) * np.stack(behind[::-1])
        return (both / both.sum(2, keepdims=True)).transpose(1, 0, 2)

    def slopes(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean negative log-likelihood of the tags, its slope by each weight)."""
        n, length = windows.shape
        h, w = self.hidden, self.w
        states, gates, cells = self.states(windows, keep=True)
        scores = self.scores(states)
        total, chances, pairs = self.posteriors(scores)
        gold = tags.T
        place = np.arange(length)[:, None], np.arange(n)[None, :], gold
        loss = total.sum() - scores[place].sum() - w["start"][gold[0]].sum() - w["end"][gold[-1]].sum() - w["step"][gold[:-1], gold[1:]].sum()
        d = chances.astype(np.float32)
        d[place] -= 1
        taken = np.zeros_like(pairs)
        np.add.at(taken, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        g = {"step": pairs - taken, "start": d[0].sum(0), "end": d[-1].sum(0), "base": d.sum((0, 1))}
        both = np.concatenate([states[:, 0], states[::-1, 1]], -1)
        g["out"] = np.einsum("tnh,tnk->hk", both, d, optimize=True)
        up = d @ w["out"].T
        up = np.stack([up[..., :h], up[::-1, :, h:]], 1)  # length x 2 x n x h, in each direction's own time
        turned = np.stack([windows.T, windows.T[::-1]], 1)
        later, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        zs = np.empty((length, 2, n, 4 * h), np.float32)
        for t in range(length - 1, -1, -1):
            i, f, o, new = (gates[t][..., k * h : (k + 1) * h] for k in range(4))
            bent = np.tanh(cells[t])
            out = up[t] + later
            cell = cell + out * o * (1 - bent * bent)
            before = cells[t - 1] if t else np.zeros_like(cell)
            z = np.concatenate([cell * new * i * (1 - i), cell * before * f * (1 - f), out * bent * o * (1 - o), cell * i * (1 - new * new)], -1)
            zs[t] = z
            later, cell = z @ w["back"].transpose(0, 2, 1), cell * f
        flat = lambda x, k: x[:, k].reshape(-1, x.shape[-1])
        g["back"] = np.stack([flat(states[:-1], k).T @ flat(zs[1:], k) for k in (0, 1)])
        one_hot = np.eye(SYMBOLS, dtype=np.float32)
        by_symbol = np.stack([one_hot[turned[:, k].ravel()].T @ flat(zs, k) for k in (0, 1)])
        g["bias"] = by_symbol.sum(1, keepdims=True)
        g["into"] = w["embed"].T @ by_symbol
        g["embed"] = (by_symbol @ w["into"].transpose(0, 2, 1)).sum(0)
        return float(loss) / n, {k: v / n for k, v in g.items()}

    def fit(self, windows: np.ndarray, tags: np.ndarray, rounds: int, batch: int = 24, rate: float = 0.015, seed: int = 11) -> list[float]:
        """Train with moving means of slopes and squares (Adam), the rate falling to a tenth; mean loss of each round."""
        make, first, second, at, losses = np.random.default_rng(seed), {}, {}, 0, []
        steps = rounds * -(-len(windows) // batch)
        for _ in range(rounds):
            order, seen = make.permutation(len(windows)), []
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                loss, slopes = self.slopes(windows[rows], tags[rows])
                size = np.sqrt(sum(float((s**2).sum()) for s in slopes.values()))
                at, speed = at + 1, rate * (1 - 0.9 * at / steps)
                for name, s in slopes.items():
                    s = (s * min(1.0, 5 / max(size, 1e-9))).astype(np.float32)
                    first[name] = 0.9 * first.get(name, 0) + 0.1 * s
                    second[name] = 0.99 * second.get(name, 0) + 0.01 * s * s
                    self.w[name] -= speed * first[name] / (1 - 0.9**at) / (np.sqrt(second[name] / (1 - 0.99**at)) + 1e-6)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses


def best_path(chances: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Most likely tags of a stretch (length x tags) of which every step is ``allowed`` (tags x tags); a stretch begins after tag 0."""
    log = np.log(np.maximum(chances, 1e-12))
    bar = np.where(allowed, 0.0, -1e9)
    score, came = log[0] + bar[0], np.zeros(log.shape, np.int64)
    for t in range(1, len(log)):
        every = score[:, None] + bar
        came[t] = every.argmax(0)
        score = every[came[t], np.arange(len(score))] + log[t]
    path = np.empty(len(log), np.int64)
    path[-1] = int(score.argmax())
    for t in range(len(log) - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path
