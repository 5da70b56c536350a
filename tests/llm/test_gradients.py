"""The gradients that toxicity and quality train with, against differences of their losses as scoring gives them."""

import numpy as np
import pytest

from tidemark.llm import quality, toxicity


def sample(seed=11):
    """Texts of 1 to 90 words, some of which only one label has."""
    rng = np.random.default_rng(seed)
    words = [["plain", "river", "Stone.", "walk", "blue", "seven", "it's"], ["vile", "vi1e", "rotten", "Scum!", "blue"]]
    rows = []
    for i in range(60):
        label = int(i % 3 == 0)
        own = [str(rng.choice(words[label] if rng.random() < 0.4 else words[0])) for _ in range(int(rng.integers(1, 90)))]
        rows.append((" ".join(own), label))
    return rows


def log_loss(probability: np.ndarray, label: np.ndarray) -> float:
    """Both classes of equal weight."""
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / len(label)
    return float(-(weight * np.log(np.where(label == 1, probability, 1 - probability))).sum())


@pytest.mark.parametrize(("module", "noise", "step"), [(toxicity, 0.01, 1e-3), (quality, 0.05, 1e-5)])
def test_gradients_equal_differences(monkeypatch, module, noise, step):
    rows = sample()
    texts, label = [t for t, _ in rows], np.array([y for _, y in rows])

    def at(shift, each):
        """The loss where training would begin, moved by noise and by ``shift`` along a direction; there, the slope that ``gradients`` gives."""
        slope = {}

        def instead(parameters, gradients, steps, rate):
            rng = np.random.default_rng(each)
            begin = [p.copy() for p in parameters]
            for p in parameters:
                p += (noise * rng.normal(size=p.shape)).astype(p.dtype)
            way = [rng.normal(size=p.shape) * (each in (k, len(parameters))) for k, p in enumerate(parameters)]
            slope["along"] = sum(float((g * w).sum()) for g, w in zip(gradients(), way))
            for p, w in zip(parameters, way):
                p += (shift * w).astype(p.dtype)
            if module is toxicity:
                held = toxicity.PULL / 2 * ((parameters[0].astype(float) - begin[0]) ** 2).sum() + 0.5e-5 * (parameters[1] ** 2).sum()
            else:
                held = 0.5e-4 * sum((p**2).sum() for p in parameters)
            slope["held"] = float(held)

        monkeypatch.setattr(module, "adam", instead)
        model = module.fit(rows)
        return log_loss(model.scores(texts), label) + slope["held"], slope["along"]

    count = 3 if module is toxicity else 7
    for each in range(count + 1):  # each array by itself, then all
        along = at(0.0, each)[1]
        difference = (at(step, each)[0] - at(-step, each)[0]) / (2 * step)
        assert difference == pytest.approx(along, rel=2e-2, abs=1e-4), (each, difference, along)
