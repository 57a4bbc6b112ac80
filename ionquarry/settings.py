"""Settings, with the defaults that make results comparable."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class MergeSettings:
    """How near-identical spectra are merged when a library is built."""

    mz_tol: float = 0.01
    min_frac: float = 0.25
    cosine_threshold: float = 0.95
    intensity_power: float = 0.5
    mz_power: float = 0.0
    fragment_tol: float = 0.1
    normalize_sum: bool = True
    merge_unannotated: bool = False  # spectra without a key share one group only if asked for
    metadata_policy: str = "concat"  # or "vote"
    scorer: str = "cosine_greedy"  # a name in operators.peaks.SCORERS

    @classmethod
    def of(cls, given: dict | None) -> MergeSettings:
        """Defaults overridden by ``given``; unknown names raise ``TypeError``."""
        return replace(cls(), **(given or {}))

    def to_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class FingerprintSettings:
    fp_type: str = "morgan"
    n_bits: int = 4096
    radius: int = 9
    sparse: bool = True
    count: bool = True
    scaling: str | None = None  # or "log"; of counts only
    weights: dict | list | None = None  # factor by bit (sparse) or by position (dense); of counts only

    def __post_init__(self):
        if not self.count and (self.scaling is not None or self.weights is not None):
            raise NotImplementedError("only count fingerprints are scaled or weighted")
        if self.scaling not in (None, "log"):
            raise ValueError(f"unknown scaling {self.scaling!r}: use 'log' or None")
        if self.weights is not None and not isinstance(self.weights, dict if self.sparse else list):
            raise TypeError("weights are a dict from bit to factor, or a list for dense fingerprints")
        if isinstance(self.weights, list) and len(self.weights) != self.n_bits:
            raise ValueError(f"{len(self.weights)} weights for {self.n_bits} bits")
        if isinstance(self.weights, dict):  # keys are text in a manifest
            object.__setattr__(self, "weights", {int(b): float(w) for b, w in self.weights.items()})

    def to_dict(self) -> dict:
        return asdict(self)
