"""A small gated recurrent language model in numpy.

Inputs are word numbers. The output softmax is factored: a class of SIZE words, then the word in
its class. Word numbers go by frequency, so class c holds words c * SIZE and following.
"""

from __future__ import annotations

import numpy as np

SIZE = 64
WINDOW = 32
LANES = 512  # documents that are scored at a time


def logistic(x: np.ndarray) -> np.ndarray:
    x = np.negative(x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def start(counts: np.ndarray, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters of a model that knows the word frequencies only; recurrent weights are random."""
    rng = np.random.default_rng(seed)
    groups = -(-len(counts) // SIZE)
    padded = np.zeros(groups * SIZE)
    padded[: len(counts)] = counts + 0.5
    by_class = padded.reshape(groups, SIZE)
    with np.errstate(divide="ignore"):
        inner = np.maximum(np.log(by_class / by_class.sum(1, keepdims=True)), -1e4)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "input": draw(groups * SIZE, 3 * hidden, scale=0.3), "hidden": draw(hidden, 3 * hidden, scale=hidden**-0.5), "bias": np.zeros(3 * hidden, np.float32),
        "class": draw(groups, hidden, scale=0.05), "class_bias": np.log(by_class.sum(1) / padded.sum()).astype(np.float32),
        "word": draw(groups, SIZE, hidden, scale=0.05), "word_bias": inner.astype(np.float32),
    }


def flatten(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in sorted(model)])


def restore(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def step(model: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple:
    """One step for rows of word numbers ``x`` and states ``h``: new state and what the gradient needs."""
    size = h.shape[1]
    given, own = model["input"][x], h @ model["hidden"]
    given += model["bias"]
    gates = logistic(given[:, : 2 * size] + own[:, : 2 * size])
    reset, update = gates[:, :size], gates[:, size:]
    new = reset * own[:, 2 * size :]
    new += given[:, 2 * size :]
    np.tanh(new, out=new)
    after = h - new
    after *= update
    after += new
    return after, (reset, update, new, own[:, 2 * size :])


LARGE = 60.0  # exponents up to here are safe in single precision, sums over thousands of words included


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
    """exp(x - top) in place, row by row, and top: 0 where no exponent is large, which saves two passes over the rows."""
    top = 0.0
    if x.size and x.max() > LARGE:
        top = x.max(1)
        x -= top[:, None]
    return np.exp(x, out=x), top


def _entries(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where ``place`` of each row is in the flat array."""
    return np.arange(0, x.size, x.shape[1]) + place


def _log_softmax(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Logarithm of each row's softmax at ``place``; overwrites the logits."""
    own = x.take(_entries(x, place))
    x, top = _exp(x)
    return own - top - np.log(x @ np.ones(x.shape[1], x.dtype))


def _softmax_error(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Derivative of the mean loss by the logits, in place."""
    x, _ = _exp(x)
    x *= (1 / (len(x) * (x @ np.ones(x.shape[1], x.dtype))))[:, None]
    x.reshape(-1)[_entries(x, place)] -= x.dtype.type(1 / len(x))
    return x


def _with_bias(model: dict[str, np.ndarray], name: str) -> np.ndarray:
    return np.concatenate([model[name], model[f"{name}_bias"][..., None]], -1)


def _groups(keys: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of small numbers, and where each of ``kinds`` begins in it."""
    order = np.argsort(keys.astype(np.int16 if kinds < 1 << 15 else np.int64), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(keys, minlength=kinds)))


def log_prob(model: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log-probability of words ``y`` after states ``h``."""
    group = y // SIZE
    order, cuts = _groups(group, len(model["class"]))
    group, place = group[order], y[order] % SIZE
    ordered = np.ones((len(y), h.shape[1] + 1), h.dtype)  # the last column meets the biases
    ordered[:, :-1] = h.take(order, 0)
    found = _log_softmax(ordered @ _with_bias(model, "class").T, group)
    words, inner = _with_bias(model, "word"), np.empty((len(y), SIZE), h.dtype)
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        rows = slice(cuts[c], cuts[c + 1])
        np.matmul(ordered[rows], words[c].T, out=inner[rows])
    found += _log_softmax(inner, place)
    out = np.empty_like(found)
    out[order] = found
    return out


def score(model: dict[str, np.ndarray], words: np.ndarray, first: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
    """Log-probability of every document: words[first : first + count]. Documents of about equal length move on
    together, ``LANES`` at a time, so that a window's arrays stay small; states are carried from window to window."""
    order = np.argsort(-count, kind="stable")
    out = np.empty(len(order))
    size = model["hidden"].shape[0]
    sign = np.array([-1, -1, 1], np.float32)  # gates negated, for the logistic function
    # one block of memory per gate
    given = np.ascontiguousarray(((model["input"] + model["bias"]).reshape(-1, 3, size) * sign[:, None]).transpose(1, 0, 2))
    own = np.ascontiguousarray((model["hidden"].reshape(size, 3, size) * sign[:, None]).transpose(1, 0, 2))
    for low in range(0, len(order), LANES):
        lanes = order[low : low + LANES]
        out[lanes] = _score(model, given, own, words, first[lanes], count[lanes], end)
    return out


def _score(model: dict[str, np.ndarray], given: np.ndarray, own: np.ndarray, words: np.ndarray, first: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
    """``score`` of documents that move on together, longest first."""
    total = np.zeros(len(count))
    h = np.zeros((len(count), own.shape[1]), np.float32)
    last = np.full(len(count), end, np.int64)
    longest = int(count[0])
    open_ = np.searchsorted(-count, -np.arange(longest), "left")  # documents with more than t words
    for at in range(0, longest, WINDOW):
        many = open_[at : at + WINDOW]
        cuts = np.concatenate([[0], np.cumsum(many)])
        states, targets = np.empty((cuts[-1], own.shape[1]), np.float32), np.empty(cuts[-1], np.int64)
        read = np.arange(at, at + len(many))[:, None] + first[: many[0]]
        read = words.take(np.minimum(read, len(words) - 1, out=read))
        for t, n in enumerate(many.tolist()):
            now = h[:n]
            gates, passed = given.take(last[:n], 1), now @ own
            both = gates[:2]
            both += passed[:2]
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            new = np.multiply(both[0], passed[2], out=passed[2])
            new += gates[2]
            np.tanh(new, out=new)
            now -= new
            now *= both[1]
            now += new
            states[cuts[t] : cuts[t + 1]] = now
            targets[cuts[t] : cuts[t + 1]] = last[:n] = read[t, :n]
        lanes = np.arange(cuts[-1]) - np.repeat(cuts[:-1], many)
        total += np.bincount(lanes, log_prob(model, states, targets), minlength=len(total))
    return total


def _packed(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The form of a model in training: reset and update negated for the logistic function, biases of
    the output as a last column. It is linear, so gradients take it as well."""
    size = model["hidden"].shape[0]
    sign = np.where(np.arange(3 * size) < 2 * size, -1, 1).astype(model["hidden"].dtype)
    out = {k: model[k] * sign for k in ("input", "hidden", "bias")}
    return out | {k: _with_bias(model, k) for k in ("class", "word")}


def _unpacked(model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    size = model["hidden"].shape[0]
    sign = np.where(np.arange(3 * size) < 2 * size, -1, 1).astype(model["hidden"].dtype)
    out = {k: model[k] * sign for k in ("input", "hidden", "bias")}
    for k in ("class", "word"):
        out |= {k: np.ascontiguousarray(model[k][..., :size]), f"{k}_bias": np.ascontiguousarray(model[k][..., size])}
    return out


OFTEN = 16


def _sums(rows: np.ndarray, keys: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that occur, and the sum of the rows of each. A key's k-th rows are added for all keys at once,
    those of a frequent key by a product."""
    order, cuts = _groups(keys, kinds)
    count = np.diff(cuts)
    by = np.flatnonzero(count)
    by = by[np.argsort(-count[by], kind="stable")]
    count, heads = count[by], cuts[by]
    more = np.searchsorted(-count, -np.arange(OFTEN + 1), "left").tolist()  # keys with more than k rows
    out = rows.take(order[heads], 0)
    often = more[OFTEN]
    for k in range(1, min(OFTEN, int(count[0]) if len(count) else 0)):
        out[often : more[k]] += rows.take(order[heads[often : more[k]] + k], 0)
    ones = np.ones(int(count[0]) if often else 0, rows.dtype)
    for i, (low, n) in enumerate(zip(heads[:often].tolist(), count[:often].tolist())):
        np.matmul(ones[:n], rows.take(order[low : low + n], 0), out=out[i])
    return by, out


def _window(model: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradient of the mean loss over a window (time, lanes) by backpropagation cut at its start, of a
    packed model; states are reset where ``fresh``. Returns per parameter (the rows that have a gradient,
    it), where rows are all or those that occurred, and the state at the end."""
    steps, lanes = x.shape
    size = h.shape[1]
    kind = model["hidden"].dtype
    keep, some = (~fresh).astype(kind)[:, None, :], fresh.any(1).tolist()
    # units by lanes, so that every gate is one block of memory
    given = model["input"].take(x, 0)
    given += model["bias"]
    given = np.ascontiguousarray(given.transpose(0, 2, 1))
    forth = np.ascontiguousarray(model["hidden"].T)
    own, gates = np.empty((steps, 3 * size, lanes), kind), np.empty((steps, 2 * size, lanes), kind)
    states, news = np.empty((steps + 1, size, lanes), kind), np.empty((steps, size, lanes), kind)
    states[0] = h.T
    for t in range(steps):
        h = states[t] * keep[t] if some[t] else states[t]
        np.matmul(forth, h, out=own[t])
        g = np.add(given[t, : 2 * size], own[t, : 2 * size], out=gates[t])
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        new = np.multiply(g[:size], own[t, 2 * size :], out=news[t])
        new += given[t, 2 * size :]
        np.tanh(new, out=new)
        h = np.subtract(h, new, out=states[t + 1])
        h *= g[size:]
        h += new
    end = np.ascontiguousarray(h.T)
    target = y.ravel()
    group = target // SIZE
    n = len(target)
    flat = np.ones((n, size + 1), kind)  # the last column meets the biases
    flat.reshape(steps, lanes, size + 1)[:, :, :size] = states[1:].transpose(0, 2, 1)
    grad = {}
    p = _softmax_error(flat @ model["class"].T, group)
    grad["class"] = slice(None), p.T @ flat
    back = p @ model["class"][:, :size]
    order, cuts = _groups(group, len(model["class"]))
    used = np.flatnonzero(np.diff(cuts))
    spans = [(c, slice(cuts[c], cuts[c + 1])) for c in used.tolist()]
    sorted_states = flat.take(order, 0)
    p = np.empty((n, SIZE), kind)
    for c, rows in spans:
        np.matmul(sorted_states[rows], model["word"][c].T, out=p[rows])
    p = _softmax_error(p, target[order] - group[order] * SIZE)
    inner, through = np.empty((len(used), SIZE, size + 1), kind), np.empty((n, size), kind)
    for i, (c, rows) in enumerate(spans):
        np.matmul(p[rows].T, sorted_states[rows], out=inner[i])
        np.matmul(p[rows], model["word"][c, :, :size], out=through[rows])
    grad["word"] = slice(None) if len(used) == len(model["word"]) else used, inner
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    back += through.take(place, 0)
    back = np.ascontiguousarray(back.reshape(steps, lanes, size).transpose(0, 2, 1))
    # derivatives of the gates by that of the state don't depend on later steps: all steps at once
    reset, update = gates[:, :size], gates[:, size:]
    left = 1 - update
    by_new = news * news
    np.subtract(1, by_new, out=by_new)
    by_new *= left
    factor = np.empty((steps, 3, size, lanes), kind)
    by_reset, by_update = factor[:, 0], factor[:, 1]
    np.multiply(np.multiply(by_new, reset, out=factor[:, 2]), own[:, 2 * size :], out=by_reset)
    by_reset *= reset - 1
    before = states[:-1] * keep
    np.subtract(news, before, out=by_update)
    by_update *= update
    by_update *= left
    inside, outer = given.reshape(factor.shape), own.reshape(steps, lanes, 3, size)  # both have been read
    carried = np.zeros((size, lanes), kind)
    for t in range(steps - 1, -1, -1):
        dh = np.add(back[t], carried, out=back[t])
        np.multiply(dh, factor[t], out=inside[t])
        np.matmul(model["hidden"], inside[t].reshape(3 * size, lanes), out=carried)
        carried += dh * update[t]
        if some[t]:
            carried *= keep[t]
    outer[:, :, :2] = inside[:, :2].transpose(0, 3, 1, 2)
    back *= by_new
    outer[:, :, 2] = back.transpose(0, 2, 1)
    outer = outer.reshape(n, 3 * size)
    grad["hidden"] = slice(None), np.matmul(before, inside.reshape(steps, 3 * size, lanes).transpose(0, 2, 1)).sum(0)
    grad["bias"] = slice(None), np.ones(n, kind) @ outer
    grad["input"] = _sums(outer, x.ravel(), len(model["input"]))
    return grad, end


def gradient(model: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, h: np.ndarray, fresh: np.ndarray) -> tuple[dict, np.ndarray]:
    """The gradient of ``_window`` with all rows, and the state at the end."""
    packed = _packed(model)
    found, h = _window(packed, x, y, h, fresh)
    grad = {k: np.zeros_like(v) for k, v in packed.items()}
    for k, (rows, g) in found.items():
        grad[k][rows] = g
    return _unpacked(grad), h


def train(model: dict[str, np.ndarray], words: np.ndarray, end: int, lanes: int = 96, window: int = 16, rate: float = 0.07,
          seen: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """One pass over a stream of documents, each closed by ``end``: truncated backpropagation
    through time with Adagrad. The stream is read in parallel lanes. ``seen`` carries Adagrad's sums
    from one part of a stream to the next, in the packed form; it is filled in place."""
    lanes = max(1, min(lanes, len(words) // (2 * window)))
    length = len(words) // lanes
    y = words[: lanes * length].reshape(lanes, length).T
    x = np.concatenate([np.full((1, lanes), end, words.dtype), y[:-1]])
    model = _packed(model)
    seen = {} if seen is None else seen
    for k, v in model.items():
        seen.setdefault(k, np.full_like(v, 1e-4))
    h = np.zeros((lanes, model["hidden"].shape[0]), np.float32)
    for at in range(0, length, window):
        part = slice(at, at + window)
        grad, h = _window(model, x[part], y[part], h, x[part] == end)
        norm = np.sqrt(sum(float(np.vdot(g, g)) for _, g in grad.values()))
        for k, (rows, g) in grad.items():  # other rows have no gradient and stay
            if norm > 1:
                g *= np.float32(1 / norm)
            total = seen[k][rows]
            total += g * g
            if not isinstance(rows, slice):
                seen[k][rows] = total
            g *= rate
            g /= np.sqrt(total)
            model[k][rows] -= g
    return _unpacked(model)
