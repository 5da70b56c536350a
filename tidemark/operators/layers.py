"""Layers of the encoders and heads in numpy, each with its gradient.

Weights and gradients are arrays by name.  A recurrent layer gives the mean of
its states only, so it holds one state at a time, unless it is told to keep
them; its gradient goes backward in segments, of which states that weren't kept
are worked out anew from the first.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]
#: Readouts whose states are held at a time on the way back.
SEGMENT = 64
#: What is added to variances, and the share of a new moment in a running one.
EPSILON, MOMENTUM = 1e-5, 0.1
#: exp(-v) is 2 to the power of v times this; powers of 2 are worked out quicker.
GATE = -1 / np.log(2)


def gru_sizes(name: str, width: int, hidden: int, decay: bool) -> dict[str, tuple[int, ...]]:
    more = {f"{name}_decay_w": (hidden,), f"{name}_decay_b": (hidden,)} if decay else {}
    return {f"{name}_w": (3 * hidden, width), f"{name}_u": (3 * hidden, hidden), f"{name}_b": (3 * hidden,), f"{name}_c": (3 * hidden,)} | more


def dense_sizes(name: str, width: int, out: int) -> dict[str, tuple[int, ...]]:
    return {f"{name}_w": (out, width), f"{name}_b": (out,)}


def head_sizes(name: str, width: int, hidden: int, out: int) -> dict[str, tuple[int, ...]]:
    scale = {f"{name}_scale": (hidden,), f"{name}_shift": (hidden,), f"{name}_mean": (hidden,), f"{name}_var": (hidden,)}
    return dense_sizes(f"{name}_1", width, hidden) | scale | dense_sizes(f"{name}_2", hidden, out)


def first_weights(sizes: dict[str, tuple[int, ...]], seed: int = 42) -> Weights:
    """Uniform weights, within one by the square root of what goes in; scales and variances are 1, shifts and means 0."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in sizes.items():
        if name.endswith(("_scale", "_var")):
            out[name] = np.ones(shape)
        elif name.endswith(("_shift", "_mean")):
            out[name] = np.zeros(shape)
        else:
            stem, part = name.rsplit("_", 1)
            wide = 1 if stem.endswith("_decay") else sizes[f"{stem}_u"][1] if f"{stem}_u" in sizes else sizes[f"{stem}_w"][1]
            out[name] = rng.uniform(-1, 1, shape) / max(1, wide) ** 0.5
    return out


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def _segment(x: np.ndarray, spans: list[tuple[int, int, int]], h: np.ndarray, total: np.ndarray | None, gaps: np.ndarray | None, w: Weights, name: str, keep: bool) -> tuple | None:
    """Moves ``h`` over the readouts of ``x``, adding states to ``total``; with ``keep``, what the gradient needs: (old, fade, slope, reset and update one after the other, new, the part that is reset)."""
    n, hidden = h.shape
    # gates are 1 / (1 + 2 ** v): what that makes of v goes into the weights
    scale = np.array([GATE, GATE, 1])[:, None, None]
    by_gate = lambda v: v.reshape(3, hidden, -1).transpose(0, 2, 1) * scale
    c = by_gate(w[f"{name}_c"])
    b = by_gate(w[f"{name}_b"])
    b[:2] += c[:2]
    # each gate's values lie together, so that a readout's are long rows of numbers
    ins = _with_ones(x) @ np.concatenate([by_gate(w[f"{name}_w"]), b], 1)
    u, shift = np.ascontiguousarray(by_gate(w[f"{name}_u"])), np.repeat(c[2], n, 0)
    fade = slope = None
    if gaps is not None:
        slope = _with_ones(gaps[:, None]) @ np.stack([w[f"{name}_decay_w"], w[f"{name}_decay_b"]])
        fade = np.maximum(0, slope)
        fade *= GATE
        np.exp2(fade, out=fade)
    held = len(x) if keep else n
    olds, gates, news, parts, inners = np.empty((held, hidden)), np.empty((2, held, hidden)), np.empty((held, hidden)), np.empty((held, hidden)), np.empty(3 * n * hidden)
    gate_ins, new_ins = ins[:2], ins[2]
    with np.errstate(over="ignore"):
        for k, at, to in spans:
            on, m = h[k:], to - at
            place = slice(at, to) if keep else slice(m)
            old, gate, new, part = olds[place], gates[:, place], news[place], parts[place]
            if fade is None:
                old[...] = on
            else:
                np.multiply(on, fade[at:to], out=old)
            inner = np.matmul(old, u, out=inners[: 3 * m * hidden].reshape(3, m, hidden))
            np.add(inner[:2], gate_ins[:, at:to], out=gate)
            np.exp2(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            np.add(inner[2], shift[:m], out=part)
            np.multiply(part, gate[0], out=new)
            new += new_ins[at:to]
            np.tanh(new, out=new)
            np.subtract(old, new, out=on)
            on *= gate[1]
            on += new
            if total is not None:
                total[k:] += on
    return (olds, fade, slope, gates, news, parts) if keep else None


def _spans(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Of each readout the first sequence that still goes on, and from where to where its values are."""
    first = np.searchsorted(lengths, np.arange(lengths.max(initial=0)), "right")
    ends = np.cumsum(len(lengths) - first)
    return list(zip(first.tolist(), [0, *ends.tolist()], ends.tolist()))


def by_readout(lengths: np.ndarray) -> np.ndarray:
    """Where the values of sequences, one after the other, go: all first readouts, then all second ones and so on."""
    at = np.arange(lengths.max(initial=0))[:, None]
    return (at + (np.cumsum(lengths) - lengths))[at < lengths]


def _segments(lengths: np.ndarray) -> list[tuple[slice, list[tuple[int, int, int]]]]:
    """The values of each segment, and its spans from 0."""
    spans, out = _spans(lengths), []
    for at in range(0, len(spans), SEGMENT):
        some = spans[at : at + SEGMENT]
        begin = some[0][1]
        out.append((slice(begin, some[-1][2]), [(k, a - begin, b - begin) for k, a, b in some]))
    return out


def pooled_states(x: np.ndarray, lengths: np.ndarray, w: Weights, name: str, gaps: np.ndarray | None = None, keep: bool = False) -> tuple[np.ndarray, tuple[list[np.ndarray], list]]:
    """The mean state of a gated recurrent unit over x (values by readout, features) of sequences by length, and the state before each segment; with ``keep`` also what the gradient needs.

    With ``gaps`` the state fades before each readout by exp(-relu(gap * decay_w
    + decay_b)).  Only the sequences that still go on at a readout are worked on.
    """
    h = np.zeros((len(lengths), w[f"{name}_u"].shape[1]))
    total, starts, held = np.zeros_like(h), [], []
    for some, spans in _segments(lengths):
        starts.append(h.copy())
        held.append(_segment(x[some], spans, h, total, None if gaps is None else gaps[some], w, name, keep))
    return total / np.maximum(1, lengths)[:, None], (starts, held)


def pooled_states_back(x: np.ndarray, lengths: np.ndarray, w: Weights, name: str, gaps: np.ndarray | None, found: tuple[list[np.ndarray], list], d: np.ndarray, grads: Weights) -> None:
    """Adds the gradient for ``d``, that of the mean state, to ``grads``."""
    share, dh = d / np.maximum(1, lengths)[:, None], np.zeros_like(d)
    hidden = d.shape[1]
    u = w[f"{name}_u"].reshape(3, hidden, hidden)
    for start, kept, (place, spans) in reversed(list(zip(*found, _segments(lengths)))):
        some, before = x[place], None if gaps is None else gaps[place]
        old, fade, slope, gates, new, part = kept or _segment(some, spans, start.copy(), None, before, w, name, True)
        r, z = gates
        rise = (1 - z) * (1 - new * new)
        # of the gradient of a new state, what goes to the reset and update gates and the candidate's state; then that times the gradient
        slopes, ones = np.empty((3, len(some), hidden)), np.ones(len(some))
        np.multiply(rise, r, out=slopes[2])
        np.subtract(1, r, out=slopes[0])
        slopes[0] *= slopes[2]
        slopes[0] *= part
        np.subtract(old, new, out=slopes[1])
        slopes[1] *= z
        slopes[1] *= 1 - z
        d_new, d_old, inners = np.empty_like(new), np.empty_like(new), np.empty(3 * len(dh) * hidden)
        for k, at, to in reversed(spans):
            on, before_fade, back, m = dh[k:], d_old[at:to], slopes[:, at:to], to - at
            on += share[k:]
            d_new[at:to] = on
            back *= on
            inner = np.matmul(back, u, out=inners[: 3 * m * hidden].reshape(3, m, hidden))
            np.add(inner[0], inner[1], out=before_fade)
            before_fade += inner[2]
            on *= z[at:to]
            if fade is None:
                on += before_fade
            else:
                before_fade += on
                np.multiply(before_fade, fade[at:to], out=on)
        grads[f"{name}_u"] += (slopes.transpose(0, 2, 1) @ old).reshape(-1, hidden)
        grads[f"{name}_c"] += (ones @ slopes).ravel()
        np.multiply(d_new, rise, out=slopes[2])
        grads[f"{name}_w"] += (slopes.transpose(0, 2, 1) @ some).reshape(3 * hidden, -1)
        grads[f"{name}_b"] += (ones @ slopes).ravel()
        if fade is not None:
            d_old *= old
            d_old *= slope > 0
            grads[f"{name}_decay_w"] -= before @ d_old
            grads[f"{name}_decay_b"] -= ones @ d_old


def dense(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}_w"].T + w[f"{name}_b"]


def dense_back(x: np.ndarray, w: Weights, name: str, d: np.ndarray, grads: Weights) -> np.ndarray:
    grads[f"{name}_w"] += d.T @ x
    grads[f"{name}_b"] += d.sum(0)
    return d @ w[f"{name}_w"]


def head(x: np.ndarray, w: Weights, name: str, moments: list | None = None) -> tuple[np.ndarray, tuple]:
    """Dense, batch norm, relu, dense.  With ``moments`` the batch's own mean and variance are used and added to the list; else the running ones."""
    a = dense(x, w, f"{name}_1")
    mean, var = (a.mean(0), a.var(0)) if moments is not None else (w[f"{name}_mean"], w[f"{name}_var"])
    if moments is not None:
        moments.append((name, mean, var * len(a) / max(1, len(a) - 1)))
    scale = 1 / np.sqrt(var + EPSILON)
    norm = (a - mean) * scale
    on = np.maximum(0, norm * w[f"{name}_scale"] + w[f"{name}_shift"])
    return dense(on, w, f"{name}_2"), (x, norm, scale, on, moments is not None)


def head_back(held: tuple, w: Weights, name: str, d: np.ndarray, grads: Weights) -> np.ndarray:
    x, norm, scale, on, own = held
    d = dense_back(on, w, f"{name}_2", d, grads) * (on > 0)
    grads[f"{name}_scale"] += (d * norm).sum(0)
    grads[f"{name}_shift"] += d.sum(0)
    d = d * w[f"{name}_scale"]
    d = scale * (d - d.mean(0) - norm * (d * norm).mean(0)) if own else scale * d
    return dense_back(x, w, f"{name}_1", d, grads)


def merged_moments(w: Weights, moments: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
    """Moves the running mean and variance of each head towards those of its batches, one after the other."""
    for name, mean, var in moments:
        w[f"{name}_mean"] = (1 - MOMENTUM) * w[f"{name}_mean"] + MOMENTUM * mean
        w[f"{name}_var"] = (1 - MOMENTUM) * w[f"{name}_var"] + MOMENTUM * var


def stack(x: np.ndarray, w: Weights, names: list[str], drops: dict[str, float], rng: np.random.Generator | None, last_relu: bool = False) -> tuple[np.ndarray, list]:
    """Dense layers with relu between them; after those in ``drops`` a share of the values is dropped where ``rng`` is given, and the others scaled up."""
    held = []
    for i, name in enumerate(names):
        y, keep = dense(x, w, name), None
        on = i < len(names) - 1 or last_relu
        if on:
            y = np.maximum(0, y)
            if rng is not None and drops.get(name):
                keep = (rng.random(y.shape) >= drops[name]) / (1 - drops[name])
                y = y * keep
        held.append((x, y, keep, on))
        x = y
    return x, held


def stack_back(held: list, w: Weights, names: list[str], d: np.ndarray, grads: Weights) -> np.ndarray:
    for (x, y, keep, on), name in zip(reversed(held), reversed(names)):
        if on:
            d = d * (y > 0) * (1 if keep is None else keep)
        d = dense_back(x, w, name, d, grads)
    return d


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    return v / size, size


def _unit_back(unit: np.ndarray, size: np.ndarray, d: np.ndarray) -> np.ndarray:
    return (d - unit * (unit * d).sum(1, keepdims=True)) / size


def nt_xent_gradient(a: np.ndarray, b: np.ndarray, temperature: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss of two views of the same rows, with all other vectors of the batch as negatives, and the gradient of each view."""
    unit, size = _unit(np.concatenate([a, b]))
    sim, n = unit @ unit.T / temperature, len(a)
    np.fill_diagonal(sim, -np.inf)
    top = sim.max(1, keepdims=True)
    share = np.exp(sim - top)
    total = share.sum(1, keepdims=True)
    other = np.concatenate([np.arange(n) + n, np.arange(n)])
    rows = np.arange(2 * n)
    loss = float((np.log(total[:, 0]) + top[:, 0] - sim[rows, other]).mean())
    d = share / total
    d[rows, other] -= 1
    d /= 2 * n
    out = _unit_back(unit, size, (d + d.T) @ unit / temperature)
    return loss, out[:n], out[n:]


def consistency_gradient(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """One less the mean cosine of rows, and the gradient of both sides."""
    (u, m), (v, n) = _unit(a), _unit(b)
    return float(1 - (u * v).sum(1).mean()), _unit_back(u, m, -v / len(a)), _unit_back(v, n, -u / len(a))


def cox_gradient(risk: np.ndarray, duration: np.ndarray, event: np.ndarray) -> tuple[float, np.ndarray]:
    """The negative partial log likelihood of a batch, averaged over its events, and its gradient.

    Rows are at risk from the longest duration on; of equal durations those that
    come first are at risk first, without regard to ties.  Without events both are 0.
    """
    order = np.argsort(-duration, kind="stable")
    r, e = risk[order], event[order].astype(float)
    if not e.sum():
        return 0.0, np.zeros(len(risk))
    w = np.exp(r - r.max())
    at_risk = np.cumsum(w)
    loss = -float((e * (r - np.log(at_risk) - r.max())).sum() / e.sum())
    out = np.empty(len(risk))
    out[order] = (w * np.cumsum((e / at_risk)[::-1])[::-1] - e) / e.sum()
    return loss, out
