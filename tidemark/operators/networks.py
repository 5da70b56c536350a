"""Networks over packed sequences: two contrastive ones, and survival heads on their time encoders.

A batch is a bounded number of sequences.  They are encoded in groups of like
length, whose padded values are bounded; the states of the first groups are kept
for the way back, of further ones only the mean, and they are encoded again.
Noise and drops are drawn by seed, epoch, batch, view and place, so they don't
depend on groups or tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa

from tidemark.operators import layers
from tidemark.operators.layers import Weights

#: Padded values of a group of sequences that is encoded at a time (one sequence at least).
GROUP_VALUES = 1 << 20
#: Padded values whose states a branch keeps for the way back; groups beyond are encoded again.
KEPT_VALUES = 1 << 20
FUSIONS = ("direct", "mlp")


@dataclass(frozen=True)
class Network:
    """``kind``: "tfc" has a time and a spectrum branch over all features; "simple" a recurrent branch over numerical and a dense one over histogram features.

    ``survival``: no head, "plain" (two layers on the pooled time states),
    "guided" (three, with drops) or "static" (three, on pooled states and
    static features, as they are or by layers of their own: ``fusion``).
    """

    kind: str
    numerical: int
    histogram: int
    hidden: int = 128
    head: int = 128
    projection: int = 64
    survival: str | None = None
    survival_hidden: int = 64
    static: int = 0
    fusion: str = "direct"
    static_hidden: int = 32
    static_out: int = 16
    dropout: float = 0.2

    def __post_init__(self) -> None:
        if self.kind not in ("tfc", "simple"):
            raise ValueError("kind must be tfc or simple")
        if self.survival not in (None, "plain", "guided", "static"):
            raise ValueError("survival must be plain, guided or static")
        if self.fusion not in FUSIONS:
            raise ValueError("fusion must be direct or mlp")

    @property
    def parts(self) -> tuple[str, ...]:
        """The branches that are pooled for a survival head."""
        return ("time",) if self.kind == "tfc" else ("time", "bins")

    @property
    def encoder(self) -> tuple[str, ...]:
        """The first parts of the names of the weights below a survival head."""
        return ("time_w", "time_u", "time_b", "time_c", "time_decay", "bins_")

    @property
    def survival_layers(self) -> list[str]:
        return [f"survival_{i}" for i in range(1, (2 if self.survival == "plain" else 3) + 1)]

    @property
    def drops(self) -> dict[str, float]:
        some = {"guided": ["survival_1"], "static": ["survival_1", "survival_2", "static_1"]}.get(self.survival, [])
        return dict.fromkeys(some, self.dropout)

    def sizes(self) -> dict[str, tuple[int, ...]]:
        wide = self.numerical + self.histogram
        if self.kind == "tfc":
            out = layers.gru_sizes("time", wide, self.hidden, True) | layers.gru_sizes("freq", wide, self.hidden, False)
            out |= layers.head_sizes("time_head", self.hidden, self.head, self.projection) | layers.head_sizes("freq_head", self.hidden, self.head, self.projection)
        else:
            out = layers.gru_sizes("time", self.numerical, self.hidden, True)
            out |= layers.dense_sizes("bins_1", self.histogram, self.hidden) | layers.dense_sizes("bins_2", self.hidden, self.hidden)
            out |= layers.head_sizes("time_head", 2 * self.hidden, self.head, self.projection)
        pooled = self.hidden * len(self.parts)
        deep = self.survival_hidden
        if self.survival == "plain":
            out |= layers.dense_sizes("survival_1", pooled, deep) | layers.dense_sizes("survival_2", deep, 1)
        elif self.survival == "guided":
            out |= layers.dense_sizes("survival_1", pooled, deep) | layers.dense_sizes("survival_2", deep, deep) | layers.dense_sizes("survival_3", deep, 1)
        elif self.survival == "static":
            more = self.static
            if self.fusion == "mlp":
                out |= layers.dense_sizes("static_1", self.static, self.static_hidden) | layers.dense_sizes("static_2", self.static_hidden, self.static_out)
                more = self.static_out
            out |= layers.dense_sizes("survival_1", pooled + more, deep) | layers.dense_sizes("survival_2", deep, deep // 2) | layers.dense_sizes("survival_3", deep // 2, 1)
        return out

    def weights(self, seed: int = 42, start: Weights | None = None) -> Weights:
        """Drawn weights; those that ``start`` has of the same shape are taken from it."""
        out = layers.first_weights(self.sizes(), seed)
        return out | {n: w.copy() for n, w in (start or {}).items() if n in out and out[n].shape == w.shape}


@dataclass
class Batch:
    """Sequences (readouts, numerical and then histogram features), gaps before readouts, targets, static features; ``number`` tells batches of an epoch apart.

    ``made``: groups that were drawn ahead, by what reads them and their number.
    """

    x: list[np.ndarray]
    gaps: list[np.ndarray]
    numerical: int
    duration: np.ndarray | None = None
    event: np.ndarray | None = None
    static: np.ndarray | None = None
    number: int = 0
    spectra: dict[int, np.ndarray] = field(default_factory=dict)
    lengths: list[int] = field(default_factory=list)
    made: dict[tuple, dict[int, tuple]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.lengths = self.lengths or [len(x) for x in self.x]

    def spectrum(self, i: int) -> np.ndarray:
        """That of the differences of a sequence, which both views read."""
        if i not in self.spectra:
            self.spectra[i] = spectrum(differences(self.x[i]))
        return self.spectra[i]


def batch_of(table: pa.Table, columns: list[str], numerical: int, gaps: str, static: list[str] | None = None, key: str = "vehicle_id", number: int = 0) -> Batch:
    """The packed rows of a batch, by key."""
    table = table.sort_by(key).combine_chunks()
    flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(table.column("sequence_length").to_numpy())[:-1]
    values = np.stack([flat(c) for c in columns], 1) if columns else np.zeros((0, 0))
    one = lambda c: table.column(c).to_numpy(zero_copy_only=False).astype(float) if c in table.column_names else None
    fixed = np.stack([one(c) for c in static], 1) if static else None
    return Batch(np.split(values, ends), np.split(flat(gaps), ends), numerical, one("duration"), one("event"), fixed, number)


def differences(x: np.ndarray) -> np.ndarray:
    """Of each readout to the one before; the first has none."""
    return np.diff(x, axis=0, prepend=x[:1])


def spectrum(x: np.ndarray) -> np.ndarray:
    """log1p of the sizes of the Fourier transform of a sequence over its own readouts."""
    return np.log1p(np.abs(np.fft.rfft(x, axis=0)) + 1e-8) if len(x) else np.zeros((1, x.shape[1]))


@dataclass(frozen=True)
class Draws:
    """What is drawn for a batch: a share of the values masked, normal noise of a deviation added, then a share dropped."""

    seed: int = 42
    epoch: int = 0
    noise: float = 0.01
    share: float = 0.05
    mask: float = 0.0

    def moved(self, x: np.ndarray, batch: Batch, place: int, *name: int) -> np.ndarray:
        rng = self._rng(batch, place, *name)
        if self.mask:
            x = x * (rng.random(x.shape) >= self.mask)
        return (x + self.noise * rng.standard_normal(x.shape)) * (rng.random(x.shape) > self.share)

    def masked(self, x: np.ndarray, batch: Batch, place: int, *name: int) -> np.ndarray:
        return x * (self._rng(batch, place, *name).random(x.shape) >= self.mask)

    def _rng(self, batch: Batch, *name: int) -> np.random.Generator:
        words = [self.seed, self.epoch, batch.number, *name]
        return np.random.default_rng(np.array(words, np.uint32) if max(words) < 1 << 32 else words)  # the same either way, an array is quicker

    def rng(self, batch: Batch) -> np.random.Generator:
        """For what is drawn once a batch."""
        return self._rng(batch)


#: Draws of the simple network's views; histogram features are masked only.
SIMPLE_DRAWS = Draws(noise=0.01, share=0.1, mask=0.15)

Packed = tuple[np.ndarray, np.ndarray, np.ndarray | None]


@dataclass(frozen=True)
class Getter:
    """What a branch reads of each sequence: values and gaps; and of groups of them, some of which may be ``made`` ahead."""

    of: Callable[[int], tuple[np.ndarray, np.ndarray | None]]
    part: str
    made: dict[int, Packed]

    def __call__(self, i: int) -> tuple[np.ndarray, np.ndarray | None]:
        return self.of(i)

    def group(self, number: int, some: list[int]) -> Packed:
        return self.made[number] if number in self.made else _packed([self.of(i) for i in some], self.part)


def _groups(lengths: list[int], width: int) -> Iterator[list[int]]:
    """Places of sequences of like length, with a bounded number of padded values."""
    group: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if group and (len(group) + 1) * max(1, lengths[i]) * max(1, width) > GROUP_VALUES:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def _packed(some: list[tuple[np.ndarray, np.ndarray | None]], part: str) -> Packed:
    """Values by readout, lengths of the sequences, and gaps where they have them; of ``bins`` one sequence after the other."""
    lengths = np.array([len(x) for x, _ in some])
    x = np.concatenate([x for x, _ in some])
    if part == "bins":
        return x, lengths, None
    order = layers.by_readout(lengths)
    return x[order], lengths, None if some[0][1] is None else np.concatenate([gaps for _, gaps in some])[order]


def pooled(get: Getter, lengths: list[int], w: Weights, name: str, held: list | None = None) -> np.ndarray:
    """The mean state of each sequence; of ``bins`` that of two dense layers a readout.

    ``held`` gets what :func:`pooled_back` needs of each group: its states, while there is room for them, or else how to get them again.
    """
    out, room = np.zeros((len(lengths), w["bins_2_b" if name == "bins" else f"{name}_u"].shape[-1])), KEPT_VALUES
    for number, some in enumerate(_groups(lengths, out.shape[1])):
        packed = get.group(number, some)
        x, sizes, gaps = packed
        room -= int(sizes.sum()) * out.shape[1]
        keep = held is not None and room >= 0
        found = None
        if name == "bins":
            y, layer = layers.stack(x, w, ["bins_1", "bins_2"], {}, None, last_relu=True)
            sums, full = np.zeros((len(some), out.shape[1])), sizes > 0
            if full.any():
                sums[full] = np.add.reduceat(y, (np.cumsum(sizes) - sizes)[full])
            out[some] = sums / np.maximum(1, sizes)[:, None]
            found = layer if keep else None
        else:
            out[some], found = layers.pooled_states(x, sizes, w, name, gaps, keep)
        if held is not None:
            held.append((some, (get, number), packed if keep else None, found))
    return out


def pooled_back(held: list, w: Weights, name: str, d: np.ndarray, grads: Weights) -> None:
    """Adds the gradient for ``d``, that of what :func:`pooled` gave with ``held``, to ``grads``."""
    for some, (get, number), packed, found in held:
        x, sizes, gaps = packed or get.group(number, some)
        if name == "bins":
            layer = found or layers.stack(x, w, ["bins_1", "bins_2"], {}, None, last_relu=True)[1]
            share = d[some] / np.maximum(1, sizes)[:, None]
            layers.stack_back(layer, w, ["bins_1", "bins_2"], np.repeat(share, sizes, 0), grads)
        else:
            layers.pooled_states_back(x, sizes, w, name, gaps, found, d[some], grads)


def _views(net: Network, batch: Batch, part: str, draws: Draws, before: bool = False, plain: bool = False) -> tuple[Getter, list[int]]:
    """Both views of a batch, the sequences of the second after those of the first; then, with ``plain``, the sequences as they are."""
    several = [inputs(net, batch, part, draws, view, before) for view in (1, 2)] + ([inputs(net, batch, part)] if plain else [])
    lengths = several[0][1]
    n = len(lengths)
    return Getter(lambda i: several[i // n][0](i % n), part, batch.made.get((part, len(several)), {})), lengths * len(several)


def inputs(net: Network, batch: Batch, part: str, draws: Draws | None = None, view: int = 0, before: bool = False) -> tuple[Getter, list[int]]:
    """What a branch reads of each sequence, and how long it is: a view by ``draws``, or as it is.

    Spectra are of differences.  Draws go over the spectrum, or ``before`` it over the differences.
    """
    lengths, made = batch.lengths, batch.made.get((part, 1), {}) if draws is None else {}
    moved = lambda x, i, *name: x if draws is None else draws.moved(x, batch, i, view, *name)
    if part == "freq":
        if before:
            return Getter(lambda i: (spectrum(moved(differences(batch.x[i]), i, 1)), None), part, made), [n // 2 + 1 for n in lengths]
        return Getter(lambda i: (moved(batch.spectrum(i), i, 1), None), part, made), [n // 2 + 1 for n in lengths]
    if net.kind == "tfc":
        return Getter(lambda i: (moved(batch.x[i], i), batch.gaps[i]), part, made), lengths
    k = batch.numerical
    if part == "bins":
        return Getter(lambda i: (batch.x[i][:, k:] if draws is None else draws.masked(batch.x[i][:, k:], batch, i, view, 2), None), part, made), lengths
    return Getter(lambda i: (moved(batch.x[i][:, :k], i), batch.gaps[i]), part, made), lengths


def drawn_ahead(net: Network, batch: Batch, draws: Draws, loss: str) -> Batch:
    """``batch`` with what its branches read in ``loss``, which needs no weights: of each the first groups, as many as states are kept of; without its sequences where these are all."""
    if loss == "survival":
        read = {(p, 1): inputs(net, batch, p) for p in net.parts}
    elif loss == "guided":
        read = {("time", 3): _views(net, batch, "time", draws, True, True), ("freq", 2): _views(net, batch, "freq", draws, True)}
    else:
        read = {(p, 2): _views(net, batch, p, draws) for p in (net.parts if loss == "simple" else ("time", "freq"))}
    made, whole = {}, True
    for name, (get, lengths) in read.items():
        made[name], room = {}, KEPT_VALUES
        for number, some in enumerate(_groups(lengths, net.hidden)):
            room -= sum(lengths[i] for i in some) * net.hidden
            if room < 0:
                whole = False
                break
            made[name][number] = get.group(number, some)
    return replace(batch, x=[] if whole else batch.x, gaps=[] if whole else batch.gaps, spectra={}, made=made)


def _none(w: Weights) -> Weights:
    return {n: np.zeros_like(v) for n, v in w.items() if not n.endswith(("_mean", "_var"))}


def _diagnostics(prefix: str, z: np.ndarray) -> dict[str, float]:
    return {f"{prefix}_std": float(z.std(0, ddof=1).mean()), f"{prefix}_norm": float(np.linalg.norm(z, axis=1).mean())}


Result = tuple[dict[str, float], Weights | None, list]


def simple_loss(net: Network, batch: Batch, w: Weights, draws: Draws, temperature: float = 0.5, train: bool = True) -> Result | None:
    """NT-Xent of two views; none of a batch of fewer than two."""
    if len(batch.lengths) < 2:
        return None
    moments: list | None = [] if train else None
    n, seen, z = len(batch.lengths), [], []
    held: dict[str, list] = {p: [] for p in net.parts}
    every = np.concatenate([pooled(*_views(net, batch, p, draws), w, p, held[p] if train else None) for p in net.parts], 1)
    for states in (every[:n], every[n:]):
        out, layer = layers.head(states, w, "time_head", moments)
        seen.append((layer, states))
        z.append(out)
    loss, *d = layers.nt_xent_gradient(*z, temperature)
    u, v = (x / np.maximum(1e-8, np.linalg.norm(x, axis=1, keepdims=True)) for x in z)
    cosines = u @ v.T
    same = float(np.trace(cosines))
    metrics = {"loss": loss} | _diagnostics("pooled", seen[0][1]) | _diagnostics("proj", z[0]) | {"pos_sim": same / n, "neg_sim": float((cosines.sum() - same) / (n * (n - 1)))}
    if not train:
        return metrics, None, []
    grads = _none(w)
    dp = np.concatenate([layers.head_back(layer, w, "time_head", dz, grads) for (layer, _), dz in zip(seen, d)])
    for i, part in enumerate(net.parts):
        pooled_back(held[part], w, part, dp[:, i * net.hidden : (i + 1) * net.hidden], grads)
    return metrics, grads, moments


def tfc_loss(net: Network, batch: Batch, w: Weights, draws: Draws, temperature: float = 0.2, share: float = 0.5, train: bool = True, before: bool = False) -> Result | None:
    """``share`` of NT-Xent over time and over spectra, and the rest of the distance between the two; none of a batch of fewer than two."""
    if len(batch.lengths) < 2:
        return None
    held: dict[str, list] = {"time": [], "freq": []}
    states = {p: pooled(*_views(net, batch, p, draws, before), w, p, held[p] if train else None) for p in held}
    grads = _none(w) if train else None
    metrics, d, moments = _contrast(states, w, temperature, share, grads)
    if not train:
        return metrics, None, []
    for part in held:
        pooled_back(held[part], w, part, d[part], grads)
    return metrics, grads, moments


def _contrast(states: dict[str, np.ndarray], w: Weights, temperature: float, share: float, grads: Weights | None) -> tuple[dict[str, float], dict[str, np.ndarray], list]:
    """Metrics of the contrastive loss of pooled states, those of the second view after those of the first; where there are ``grads``, the gradient of the states, and that of the heads is added to them."""
    moments: list | None = None if grads is None else []
    n, z, layer = len(states["time"]) // 2, {}, {}
    for view, rows in ((1, slice(n)), (2, slice(n, None))):
        for part in ("time", "freq"):
            z[part, view], layer[part, view] = layers.head(states[part][rows], w, f"{part}_head", moments)
    d = {k: np.zeros_like(v) for k, v in z.items()}
    found = {}
    for part in ("time", "freq"):
        found[part], a, b = layers.nt_xent_gradient(z[part, 1], z[part, 2], temperature)
        d[part, 1] += share * a
        d[part, 2] += share * b
    apart = 0.0
    for view in (1, 2):
        gap, a, b = layers.consistency_gradient(z["time", view], z["freq", view])
        apart += gap / 2
        d["time", view] += (1 - share) / 2 * a
        d["freq", view] += (1 - share) / 2 * b
    metrics = {"loss": share * (found["time"] + found["freq"]) + (1 - share) * apart, "loss_time": found["time"], "loss_freq": found["freq"], "loss_consistency": apart}
    metrics |= _diagnostics("time_proj", z["time", 1]) | _diagnostics("freq_proj", z["freq", 1])
    if grads is None:
        return metrics, {}, []
    back = {part: [layers.head_back(layer[part, view], w, f"{part}_head", d[part, view], grads) for view in (1, 2)] for part in ("time", "freq")}
    return metrics, {part: np.concatenate(some) for part, some in back.items()}, moments


def risks(net: Network, batch: Batch, w: Weights, rng: np.random.Generator | None = None, back: bool = False) -> tuple[np.ndarray, np.ndarray, tuple]:
    """The pooled states, the risk of each sequence, and what the gradient needs, with ``back`` that of the encoder too; drops are drawn where ``rng`` is given."""
    below: dict[str, list] = {part: [] for part in net.parts}
    states = np.concatenate([pooled(*inputs(net, batch, p), w, p, below[p] if back else None) for p in net.parts], 1)
    risk, held = _risk(net, batch, w, states, rng)
    return states, risk, (below, held)


def _risk(net: Network, batch: Batch, w: Weights, states: np.ndarray, rng: np.random.Generator | None) -> tuple[np.ndarray, tuple]:
    """The risk of each sequence by its pooled state, and what the gradient needs."""
    fused, fixed = states, None
    if net.survival == "static":
        more = batch.static
        if net.fusion == "mlp":
            more, fixed = layers.stack(batch.static, w, ["static_1", "static_2"], net.drops, rng, last_relu=True)
        fused = np.concatenate([states, more], 1)
    risk, held = layers.stack(fused, w, net.survival_layers, net.drops, rng)
    return risk[:, 0], (fixed, held)


def _risk_back(net: Network, w: Weights, held: tuple, d: np.ndarray, grads: Weights) -> np.ndarray:
    """The gradient of the pooled states; that of the survival head is added to ``grads``."""
    fixed, layer = held
    d = layers.stack_back(layer, w, net.survival_layers, d[:, None], grads)
    wide = net.hidden * len(net.parts)
    if fixed is not None:
        layers.stack_back(fixed, w, ["static_1", "static_2"], d[:, wide:], grads)
    return d[:, :wide]


def risk_back(net: Network, w: Weights, held: tuple, d: np.ndarray, grads: Weights, frozen: bool = False) -> None:
    below, above = held
    d = _risk_back(net, w, above, d, grads)
    if not frozen:
        for i, part in enumerate(net.parts):
            pooled_back(below[part], w, part, d[:, i * net.hidden : (i + 1) * net.hidden], grads)


def survival_loss(net: Network, batch: Batch, w: Weights, draws: Draws, frozen: bool = False, train: bool = True) -> Result | None:
    """The Cox loss of a batch; none where it has no event."""
    if not batch.event.sum():
        return None
    _, risk, held = risks(net, batch, w, draws.rng(batch) if train else None, train and not frozen)
    loss, d = layers.cox_gradient(risk, batch.duration, batch.event)
    if not train:
        return {"loss": loss}, None, []
    grads = _none(w)
    risk_back(net, w, held, d, grads, frozen)
    return {"loss": loss}, grads, []


def guided_loss(net: Network, batch: Batch, w: Weights, draws: Draws, temperature: float = 0.2, share: float = 0.5, weight: float = 0.3, train: bool = True) -> Result | None:
    """The contrastive loss, its spectra of moved differences, and ``weight`` times the Cox loss of the sequences as they are; none where a batch has no event.

    Without ``train`` the Cox loss alone.
    """
    if not train or not batch.event.sum():
        return survival_loss(net, batch, w, draws, train=train)
    n = len(batch.lengths)
    if n < 2:
        return None
    held: dict[str, list] = {"time": [], "freq": []}
    every = pooled(*_views(net, batch, "time", draws, True, True), w, "time", held["time"])  # views and sequences in one go
    states = {"time": every[: 2 * n], "freq": pooled(*_views(net, batch, "freq", draws, True), w, "freq", held["freq"])}
    grads, head = _none(w), _none(w)
    contrast, d, moments = _contrast(states, w, temperature, share, grads)
    risk, above = _risk(net, batch, w, every[2 * n :], draws.rng(batch))
    cox, d_risk = layers.cox_gradient(risk, batch.duration, batch.event)
    d_plain = weight * _risk_back(net, w, above, d_risk, head)
    pooled_back(held["time"], w, "time", np.concatenate([d["time"], d_plain]), grads)
    pooled_back(held["freq"], w, "freq", d["freq"], grads)
    metrics = {"loss": contrast["loss"] + weight * cox, "loss_tfc": contrast["loss"], "loss_cox": cox}
    metrics |= {k: contrast[k] for k in ("loss_time", "loss_freq", "loss_consistency")}
    return metrics, {m: g + weight * head[m] for m, g in grads.items()}, moments
