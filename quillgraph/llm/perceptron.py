"""Averaged perceptron over sparse features: one decision is a choice among candidates."""

from __future__ import annotations


class Perceptron:
    """Scores candidates by the sum of the weights of their features; ties go to the first candidate."""

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.w: dict[str, float] = weights or {}
        self.memo: dict = {}  # decisions of a trained model by what they were made from
        self._sum: dict[str, float] = {}
        self._at: dict[str, int] = {}
        self._n = 0

    def best(self, candidates: list[list[str]]) -> int:
        get = self.w.get
        top, at = None, 0
        for k, features in enumerate(candidates):
            score = 0.0
            for f in features:
                score += get(f, 0.0)
            if top is None or score > top:
                top, at = score, k
        return at

    def _add(self, features: list[str], by: float) -> None:
        for f in features:
            w = self.w.get(f, 0.0)
            self._sum[f] = self._sum.get(f, 0.0) + (self._n - self._at.get(f, 0)) * w
            self._at[f] = self._n
            self.w[f] = w + by

    def learn(self, candidates: list[list[str]], truth: int) -> bool:
        self._n += 1
        guess = self.best(candidates)
        if guess != truth:
            self._add(candidates[truth], 1.0)
            self._add(candidates[guess], -1.0)
        return guess == truth

    def averaged(self) -> dict[str, float]:
        out = {f: (self._sum.get(f, 0.0) + (self._n - self._at.get(f, 0)) * w) / max(1, self._n) for f, w in self.w.items()}
        return {f: w for f, w in out.items() if w}
